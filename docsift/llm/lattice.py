"""Near-duplicate vectors by hashing to cells of the E8 lattice.

Each of several tables projects the unit vector at random to 8 dimensions, shifts and scales it, and
decodes it to the nearest E8 point: its home cell. A vector also probes the neighbouring cells nearest
to it (of the 240 at minimum distance). Two vectors meet in a table if one is at home in a cell that the
other is at home in or probes; every pair that meets is verified by its cosine in double precision and is
counted once, in the first table and cell where it meets. Cells with many vectors are split into blocks,
and pairs of blocks are compared by separate tasks. A task returns sums per vector and, for the links
found, each vector's smallest linked relative; pairs are never rows.

Equal vectors are one node with a count, linked with one another. Null and zero vectors and those with
null or non-finite components are linked with nothing; vectors of different length are never linked.
Every row is a vector of its own, with a repeated vec_id or a null one too; a null vec_id is never the
smallest of a component that holds another. Labels and other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docsift.llm.blocks import blocked, links_frame
from docsift.llm.common import mixed, table
from docsift.llm.components import components


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minuses."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([-0.5 if bits >> i & 1 else 0.5 for i in range(8)])
        if bits.bit_count() % 2 == 0:
            out.append(signs)
    return np.array(out)


MINIMAL = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors with an even sum: round, and where the sum is odd round the worst entry the other way."""
    r = np.rint(x)
    off = x - r
    rows = np.flatnonzero(r.sum(axis=1) % 2)
    at = np.abs(off[rows]).argmax(axis=1)
    r[rows, at] += np.where(off[rows, at] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice point of each row: the better of the two cosets."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """(vectors, tables, 1 + probes) cell hashes, the home cell first."""
    n, dim = unit.shape
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    weights = np.random.default_rng(8).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
    for t in range(tables):
        rng = np.random.default_rng([t, dim])
        basis = np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim]
        # a random projection of a unit vector keeps sqrt(8 / dim) of its length; scale is in units of that
        x = unit @ basis * (np.sqrt(max(dim, 8) / 8) / scale) + rng.uniform(0, 2, 8)
        home = nearest_e8(x)
        near = np.argsort(-(x - home) @ MINIMAL.T, axis=1, kind="stable")[:, :probes]
        all_cells = np.concatenate([home[:, None], home[:, None] + MINIMAL[near]], axis=1)
        doubled = np.rint(all_cells * 2).astype(np.int64).astype(np.uint64)
        out[:, t] = mixed((doubled * weights).sum(axis=2, dtype=np.uint64) + np.uint64(t * 1000 + dim))
    return out


def _unit(raw: pd.Series, dtype: str) -> np.ndarray:
    x = np.stack([np.frombuffer(r, dtype) for r in raw]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _raw(dtype: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for v in batch:
                x = None if v is None or any(e is None for e in v) else np.asarray(v, dtype)
                out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "binary")


def _by_length(raw: pd.Series) -> Iterator[np.ndarray]:
    size = raw.str.len().to_numpy()
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def _places(dtype: str, tables: int, probes: int, scale: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in _by_length(batch["raw"]):
                for part in np.array_split(at, -(-len(at) // 2000)):
                    c = cells(_unit(batch["raw"].iloc[part], dtype), tables, probes, scale)
                    home = np.zeros(c.shape, bool)
                    home[:, :, 0] = True
                    node = np.repeat(batch["node"].to_numpy()[part], c[0].size)
                    yield pd.DataFrame({"node": node, "cell": c.ravel().view(np.int64), "home": home.ravel()})

    return run


def _compare(dtype: str, tables: int, probes: int, scale: float, least: float):
    """Verified links of a bundle of block pairs, each counted in the first cell where it is met."""

    def run(bundle: pd.DataFrame) -> pd.DataFrame:
        # one row per vector, then positions into them
        raw_of = bundle.drop_duplicates("node").set_index("node")
        x = {}
        nodes = raw_of.index.to_numpy()
        for at in _by_length(raw_of["raw"]):
            for i, v in zip(at, _unit(raw_of["raw"].iloc[at], dtype)):
                x[nodes[i]] = v
        found = []
        for (cell, lo, hi), g in bundle.groupby(["cell", "lo", "hi"], sort=False):
            node, home, mine = g["node"].to_numpy(), g["home"].to_numpy(), g["mine"].to_numpy()
            left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
            if not len(left) or not len(right) or len({len(x[n]) for n in node}) > 1:
                continue
            xs = np.stack([x[n] for n in node])
            ok = (xs[left] @ xs[right].T >= least) & (home[left][:, None] | home[right][None, :])
            ok &= node[left][:, None] < node[right][None, :] if lo == hi else node[left][:, None] != node[right][None, :]
            a, b = np.nonzero(ok)
            if len(a):
                found.append((cell, node[left[a]], node[right[b]]))
        empty = pd.DataFrame({"node": [], "links": [], "root": []}).astype(np.int64)
        if not found:
            return empty
        involved = np.unique(np.concatenate([np.concatenate(f[1:]) for f in found]))
        own = {}
        sizes = np.array([len(x[n]) for n in involved])
        for d in np.unique(sizes):
            part = involved[sizes == d]
            own |= dict(zip(part, cells(np.stack([x[n] for n in part]), tables, probes, scale)))
        stack = np.stack([own[n] for n in involved])
        out = []
        for cell, a, b in found:
            a, b = np.minimum(a, b), np.maximum(a, b)
            keep = []
            for s in range(0, len(a), 20_000):
                ca, cb = stack[np.searchsorted(involved, a[s : s + 20_000])], stack[np.searchsorted(involved, b[s : s + 20_000])]
                a_in_b, b_in_a = (ca[:, :, :1] == cb).any(axis=2), (cb[:, :, :1] == ca).any(axis=2)
                t, r = (a_in_b | b_in_a).argmax(axis=1), np.arange(len(ca))
                first = np.where(a_in_b[r, t], ca[r, t, 0], cb[r, t, 0])
                keep.append(first.view(np.int64) == cell)
            keep = np.concatenate(keep)
            if keep.any():
                out.append(np.stack([a[keep], b[keep]]))
        if not out:
            return empty
        return links_frame(np.concatenate(out, axis=1), raw_of["copies"])

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.95, tables: int = 8, probes: int = 4, scale: float = 0.4, block: int = 512, per_task: int = 20_000
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    dtype = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    raw = table(spark, vectors.select("vec_id", _raw(dtype)("embedding").alias("raw")), "vectors")
    nodes = raw.where(F.col("raw").isNotNull()).groupBy("raw").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = table(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    places = table(spark, nodes.select("node", "raw").mapInPandas(_places(dtype, tables, probes, scale), "node long, cell long, home boolean"), "places")
    sizes = places.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("any_home")).where("size > 1 AND any_home")
    shared = table(spark, places.join(sizes.select("cell", "size"), "cell"), "shared-cells")
    work = blocked(shared, "cell", "node", "size", block, per_task).join(nodes.drop("least"), "node")
    links = work.groupBy("bundle").applyInPandas(_compare(dtype, tables, probes, scale, least), "node long, links long, root long")
    links = table(spark, links, "links")
    group = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_node = (
        nodes.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(group, "node", "left")
        .select("raw", F.coalesce("links", F.lit(0)).alias("links"), "copies", "least", F.coalesce("component", "node").alias("group"))
    )
    smallest = of_node.groupBy("group").agg(F.min("least").alias("component_id"))
    of_node = of_node.drop("least").join(smallest, "group").drop("group")
    own = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return raw.join(of_node, "raw", "left").select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"),
    )
