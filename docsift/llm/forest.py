"""N-gram Jaccard join with a MinHash LSH forest.

A document is its set of five-word shingles (all words, if it has fewer). Each of `trees` tries holds every set under
its path of `max_depth` MinHash values, as bytes whose beginnings are the prefixes: rows with the same beginning are a
node of the sorted trie. Matched prefixes start at full length and are shortened by one value at a time, in all trees
at once, until two documents of the least similarity share one with the target recall (5 values by default).

What meets is pairs of blocks, not of documents. A document belongs to the smallest document that its shortest prefixes
reach, and the followers of one document are a block, or several if they are many; so near copies mostly share a
block, and only prefixes that hold several blocks are matched, longest first. A pair of blocks found at a longer prefix
is settled and is not looked up again; when no prefix holds two blocks nothing is shortened. Each block and each
pair of blocks is then verified once, by the exact Jaccard similarity of all its sets, in tasks that return sums per
document and no pairs.

Documents with equal sets are one node with a count, linked with one another. Null texts and texts
without words are linked with nothing and form classes of their own. Rows that share a doc_id are one
document; if their texts differ, it is judged by the one whose set has the smallest digest. Rows with a null doc_id are left out. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docsift.llm.blocks import links_frame
from docsift.llm.common import batch_by_bytes, gram_hashes, mixed, table, word_hashes, word_places
from docsift.llm.components import components

WORDS = 5


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    h = word_hashes(*word_places(text))
    return np.unique(gram_hashes(h, min(WORDS, len(h)))) if len(h) else np.zeros(0, np.uint64)


def digest(own: np.ndarray) -> str | None:
    return blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else None


def forest_recall(trees: int, depth: int, similarity: float) -> float:
    """The chance that a pair of the similarity shares a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def forest_depth(trees: int, max_depth: int, similarity: float, recall: float) -> int:
    """The length of prefix down to which a pair of the similarity is met with the wanted chance."""
    depth = max_depth
    while depth > 1 and forest_recall(trees, depth, similarity) < recall:
        depth -= 1
    return depth


def paths(own: np.ndarray, trees: int, max_depth: int, least: int) -> np.ndarray:
    """The path of a set in each tree: 8 bytes for its first `least` values, 4 for each further one."""
    rng = np.random.default_rng(4)
    n = trees * max_depth
    multiply = rng.integers(1, 1 << 63, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64)
    smallest = np.full(n, 2**64 - 1, np.uint64)
    for s in range(0, len(own), 4096):
        smallest = np.minimum(smallest, ((own[None, s : s + 4096] ^ flip) * multiply).min(axis=1))
    values = smallest.reshape(trees, max_depth)
    first = np.arange(1, trees + 1, dtype=np.uint64)
    for value in values.T[:least]:
        first = mixed(first * np.uint64(0x100000001B3) + value)
    rest = mixed(values[:, least:]).astype(np.uint32)
    return np.concatenate([first[:, None].view(np.uint8), rest.view(np.uint8).reshape(trees, -1)], axis=1)


def _signatures(trees: int, max_depth: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = shingles(text)
                rows.append((digest(own), paths(own, trees, max_depth, least).tobytes() if len(own) else None))
            yield batch[["doc_id", "mark"]].assign(digest=[r[0] for r in rows], paths=[r[1] for r in rows])

    return run


def block_pairs(placed: DataFrame, trees: int, max_depth: int, similarity: float, recall: float) -> DataFrame:
    """(lo, hi, depth): pairs of blocks with a common prefix, and the longest at which they meet; placed: path, block.

    Prefixes are shortened until the recall is reached, and only those that hold several blocks.
    """
    spark = placed.sparkSession
    least = forest_depth(trees, max_depth, similarity, recall)
    shortest = F.substring("path", 1, 8)
    several = placed.groupBy(shortest.alias("key")).agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a != b")
    open_ = placed.withColumn("key", shortest).join(several.select("key"), "key", "left_semi").select("path", "block").distinct()
    open_ = table(spark, open_, "open")
    settled = spark.createDataFrame([], "lo long, hi long, depth int")
    if open_.isEmpty():
        return settled
    for depth in range(max_depth, least - 1, -1):
        held = open_.select(F.substring("path", 1, 8 + 4 * (depth - least)).alias("prefix"), "block").distinct()
        met = held.withColumnRenamed("block", "lo").join(held.withColumnRenamed("block", "hi"), "prefix").where("lo < hi")
        new = met.select("lo", "hi").distinct().join(settled, ["lo", "hi"], "left_anti")
        settled = settled.unionByName(table(spark, new.withColumn("depth", F.lit(depth)), "met"))
    return settled


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; only shingles held by several sets are looked at, a few thousand at a time."""
    n = len(sets)
    value = np.concatenate(sets)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    _, column = np.unique(column[several], return_inverse=True)
    of, out = of[several], np.zeros((n, n), np.float32)
    for s in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        inside = slice(*np.searchsorted(column, [s, s + 4096]))
        held = np.zeros((n, min(4096, int(column.max()) + 1 - s)), np.float32)
        held[of[inside], column[inside] - s] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _verify(similarity: float):
    need = Fraction(similarity).limit_denominator(1000)

    def run(bundle: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (lo, hi), g in bundle.groupby(["lo", "hi"], sort=False):
            sets = [shingles(t) for t in g["text"]]
            node, mine = g["node"].to_numpy(), g["mine"].to_numpy()
            both = overlaps(sets)
            size = np.array([len(s) for s in sets])
            union = size[:, None] + size[None, :] - both
            ok = (both * need.denominator >= union * need.numerator) & (node[:, None] < node[None, :])
            ok &= (lo == hi) | (mine[:, None] != mine[None, :])
            a, b = np.nonzero(ok)
            if len(a):
                found.append(np.stack([node[a], node[b]]))
        if not found:
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype(np.int64)
        return links_frame(np.concatenate(found, axis=1), bundle.drop_duplicates("node").set_index("node")["copies"])

    return run


def jaccard_join(
    docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999, trees: int = 24, max_depth: int = 8, block: int = 256, per_task: int = 1000
) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links), n_links (other documents linked directly)."""
    spark = docs.sparkSession
    docs = batch_by_bytes(docs).where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    least = forest_depth(trees, max_depth, similarity, recall)
    signed = docs.mapInPandas(_signatures(trees, max_depth, least), "doc_id long, mark long, digest string, paths binary")
    signed = table(spark, signed, "signatures")
    # one text a document: the same one of its rows gives the signature and, by its mark, the text to verify
    own = signed.groupBy("doc_id").agg(F.min(F.struct(F.col("digest").isNull(), "digest", "mark")).alias("s")).select("doc_id", "s.digest", "s.mark")
    own = table(spark, own, "own")
    known = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.first("paths").alias("paths"))
    first = F.min(F.struct("doc_id", "mark"))
    nodes = own.where(F.col("digest").isNotNull()).groupBy("digest").agg(first.alias("s"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.join(known, "digest").select("digest", F.col("s.doc_id").alias("node"), F.col("s.mark").alias("mark"), "copies", "paths")
    nodes = table(spark, nodes, "nodes")
    # the leaves that share at least the shortest prefix with another
    size = 8 + 4 * (max_depth - least)
    leaves = nodes.select("node", F.explode(F.expr(f"transform(sequence(0, {trees - 1}), i -> substring(paths, i * {size} + 1, {size}))")).alias("path"))
    leaves = leaves.withColumn("key", F.substring("path", 1, 8))
    heads = leaves.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaves = table(spark, leaves.join(heads, "key").select("node", "path", "head"), "leaves")
    # blocks: the followers of the smallest document in reach, dealt to several if they are many
    follower = leaves.groupBy("node").agg(F.min("head").alias("head"))
    many = follower.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    blocks = table(spark, follower.join(many, "head").select("node", F.xxhash64("head", part).alias("block")), "blocks")
    pairs = block_pairs(leaves.join(blocks, "node").select("path", "block"), trees, max_depth, similarity, recall)
    alone = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("block").alias("lo"), F.col("block").alias("hi"))
    work = pairs.select("lo", "hi").unionByName(alone).withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi"))))
    work = table(spark, work.join(blocks, "block").select("lo", "hi", F.col("block").alias("mine"), "node"), "work")
    bundles = max(1, -(-work.count() // per_task))
    work = work.withColumn("bundle", F.pmod(F.xxhash64("lo", "hi", F.lit(1)), F.lit(bundles)).cast("int"))
    members = nodes.join(blocks, "node").select("node", F.col("mark").alias("own"), "copies")
    # an xor and not an equality, which would become a join key: so joined rows stay dealt by node alone
    texts = docs.join(members, F.col("doc_id") == F.col("node")).where(F.col("mark").bitwiseXOR(F.col("own")) == 0)
    work = work.join(texts.select("node", "copies", "text").dropDuplicates(["node"]), "node")
    links = table(spark, work.groupBy("bundle").applyInPandas(_verify(similarity), "node long, links long, root long"), "links")
    classes = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_node = (
        nodes.select("digest", "node", "copies")
        .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(classes, "node", "left")
        .select("digest", F.coalesce("component", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return (
        own.select("doc_id", "digest")
        .join(of_node, "digest", "left")
        .select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    )
