"""Linear support vector machine whose weights never meet on the driver.

Hinge loss with a quadratic penalty on centred features of unit deviation, minimised by OWL-QN as in Spark ML: the same
directions, line search and stopping rules, so also its results. Cells are dealt to blocks of rows. The weights, the
gradient and the ten kept steps are dealt to parts of columns. A part sends each block the weights of the columns that
the block holds, and the block sends back the sums of their gradient; columns of one block alone travel between two
tasks. What centring takes off a margin or a gradient is a number in each of these messages. The driver gets inner products of a few vectors from each part.
"""
from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, functions as F

from docsift.session import checkpoint_dir, written

CELLS = 2_000_000  # of a block, about
COLUMNS = 500_000  # of a part, about
KEPT = 10  # steps
EVERY = 10  # steps between checkpoints
SINGLE = BatchedSerializer(CPickleSerializer(), 1)  # items are large, and partitions of single items meet as they are


@dataclass
class Svm:
    """weights(ix, w) of the columns 0 to n_columns - 1; `trace` holds the objective of each step."""

    weights: DataFrame = field(repr=False)
    intercept: float
    n_columns: int
    trace: list[float]


class NoStep(Exception):
    """A direction or a line search failed."""


def fit(cells: DataFrame, n_columns: int, n_cells: int, total: float, squares: float, reg: float, max_iter=100, tol=1e-4, **sizes) -> Svm:
    """cells(row, ix, v, w1, w0): values of a row, w1 and w0 its weight with label 1 and with label 0.

    Each row has one cell with a null ix, which stands for the intercept. `total` and `squares` are the sums of the
    weights and of their squares over the observations.
    """
    spark = cells.sparkSession
    checkpoint_dir(spark)
    job = _Job(spark, cells, n_columns, n_cells, total, squares, reg, **sizes)
    trial, found = job.evaluate(job.state, np.array([0.0]), 0.0)
    job.accept(trial, first=True)
    value, gram, n_kept = found["value"], found["dots"][-1:, -1:], 0
    start, past, trace, step, failed = value, [np.inf], [value], 0, False
    while True:
        if step >= max_iter or (len(past) > 1 and abs(value - max(past)) <= tol * start):
            break
        if np.sqrt(gram[-1, -1]) <= max(tol * value, 1e-8):
            break
        try:
            coef = direction(gram, n_kept)
            size = 0.5 / np.sqrt(gram[-1, -1]) if step < 1 else 1.0
            trial, found = _search(job, coef, value, size, 0.1 if step < 1 else 0.5)
        except NoStep:
            if failed:
                break
            # forgets the kept steps once
            failed, n_kept, gram = True, 0, gram[-1:, -1:]
            job.forget()
            trace.append(value)
            continue
        gram, n_kept = _grown(gram, n_kept, found["dots"])
        job.accept(trial)
        value, step, failed = found["value"], step + 1, False
        past = (past + [value])[-20:]
        trace.append(value)
    return Svm(*job.result(), n_columns, trace)


def direction(gram: np.ndarray, n: int) -> np.ndarray:
    """Weights of the n kept steps (the last one first), their changes of the gradient and the gradient in the way down.

    The two loops of L-BFGS, on the inner products of these vectors.
    """
    coef = np.zeros(2 * n + 1)
    coef[-1] = 1.0
    diag = gram[0, n] / gram[n, n] if n else 1.0
    if n and (gram[0, n] < 0 or np.isnan(gram[0, n])):
        raise NoStep
    first = np.zeros(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(n):
            first[i] = gram[i] @ coef / gram[i, n + i]
            if np.isnan(first[i]):
                raise NoStep
            coef[n + i] -= first[i]
        coef *= diag
        for i in reversed(range(n)):
            coef[i] += first[i] - gram[n + i] @ coef / gram[i, n + i]
    return -coef


def _grown(gram, n, dots):
    """Inner products with the new step, change and gradient (rows of dots) in place of the oldest ones."""
    keep = min(n, KEPT - 1)
    wide = np.zeros((2 * n + 3,) * 2)  # steps, changes, new step, new change, new gradient
    wide[: 2 * n, : 2 * n] = gram[:-1, :-1]
    wide[2 * n :], wide[:, 2 * n :] = dots, dots.T
    order = [2 * n, *range(keep), 2 * n + 1, *range(n, n + keep), 2 * n + 2]
    return wide[np.ix_(order, order)], keep + 1


def _search(job, coef, value, size, shrink, most=20):
    """Backtracking until the strong Wolfe conditions hold: the trial and what it found.

    Breeze takes the old value for that of the full step, which thus is always cut: it is not evaluated here.
    """
    size *= shrink
    for n in range(1, most + 1):
        trial, found = job.evaluate(job.state, coef, size)
        slope = found["slope"]
        if n == most:
            trial.unpersist()
            return job.evaluate(job.state, coef, last)
        if found["value"] > value + 1e-4 * size * slope:
            more = shrink
        elif found["new_slope"] < 0.9 * slope:
            more = 2.1
        elif found["new_slope"] > -0.9 * slope:
            more = shrink
        else:
            return trial, found
        trial.unpersist()
        last, size = size, size * more
        if not 1e-10 <= size <= 1e10:
            raise NoStep


class _Job:
    """Blocks of rows and parts of columns, one of them in each partition."""

    def __init__(self, spark, cells, n_columns, n_cells, total, squares, reg, block_cells=CELLS, part_columns=COLUMNS):
        n_blocks, n_parts = int(n_cells // block_cells) + 1, int((n_columns + 1) // part_columns) + 1
        self.spark, self.n_blocks, self.n_parts, self.n_columns = spark, n_blocks, n_parts, n_columns
        self.total, self.reg, self.n_steps, self.old = total, reg, 0, []
        dealt = cells.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
        dealt = dealt.withColumn("ix", F.coalesce(F.col("ix").cast("long"), F.lit(n_columns).cast("long")))
        build = lambda rows: _block(rows, n_parts)
        packed = written(dealt.groupBy("block").applyInArrow(build, "block int, data binary"), "svm-blocks")
        empty = _block_of(*[np.zeros(0)] * 5, n_parts)
        self.blocks = _one_each(packed.rdd.map(lambda r: (r.block, pickle.loads(r.data))), n_blocks, lambda it: next((b for _, b in it), empty))
        # a part knows which of its columns each block holds
        sums = self.blocks.mapPartitionsWithIndex(_column_sums)
        self.parts = _one_each(sums, n_parts, lambda it: [m for _, m in it], keep=False).mapPartitionsWithIndex(
            lambda n, it: [_part(n, m, n_columns, n_parts, total, squares) for m in it]
        )
        self.parts = _kept(self.parts)
        # part n holds the columns n, n + n_parts and so on
        sizes = [len(range(p, n_columns + 1, n_parts)) for p in range(n_parts)]
        self.state = spark.sparkContext.parallelize(range(n_parts), n_parts).map(lambda p: (np.zeros(sizes[p]), np.zeros(sizes[p]), [], []))
        self.state = _kept(self.state)

    def evaluate(self, state, coef, size):
        """A step of this size: the trial, and its value, slopes and inner products."""
        n_columns, n_parts, n_blocks, total, reg = self.n_columns, self.n_parts, self.n_blocks, self.total, self.reg

        def send(n, both):
            for (x, g, steps, changes), (scale, mean, held) in both:
                scaled = _stepped(x, g, steps, changes, coef, size)[1] * scale
                off = float(scaled @ mean)
                for block in range(n_blocks):
                    yield block, (n, (scaled[held[block]] if block in held else scaled[:0], off))

        asked = _one_each(state.zip(self.parts).mapPartitionsWithIndex(send), self.n_blocks, dict_of, keep=False)

        def gradient(n, both):
            for block, weights in both:
                loss, pull, sums = _hinge(block, weights)
                for p in range(n_parts):
                    yield p, (n, sums[block["cuts"][p] : block["cuts"][p + 1]], loss, pull)

        got = _one_each(self.blocks.zip(asked).mapPartitionsWithIndex(gradient), n_parts, lambda it: sorted((m for _, m in it), key=lambda m: m[0]), keep=False)

        def judge(n, both):
            for ((x, g, steps, changes), (scale, mean, held)), sums in both:
                way, new = _stepped(x, g, steps, changes, coef, size)
                grad = -mean * sum(m[3] for m in sums)
                for block, part, _, _ in sums:
                    if block in held:
                        grad[held[block]] += part
                grad *= scale / total
                penal = new.copy()
                if n == n_columns % n_parts:
                    penal[n_columns // n_parts] = 0.0  # the intercept
                grad += reg * penal
                fresh = [new - x, grad - g, grad]
                dots = np.array([[a @ b for b in [*steps, *changes, *fresh]] for a in fresh])
                loss = sum(m[2] for m in sums) / total if n == 0 else 0.0  # each part hears of it
                value = loss + 0.5 * reg * (penal @ penal)
                yield new, grad, (value, g @ way, grad @ way, dots)

        trial = _kept(state.zip(self.parts).zip(got).mapPartitionsWithIndex(judge))
        found = trial.map(lambda t: t[2]).collect()
        for rdd in self.old:  # what this evaluation was made from is kept
            rdd.unpersist()
        self.old = []
        value, slope, new_slope, dots = (sum(f[i] for f in found) for i in range(4))
        return trial, {"value": float(value), "slope": float(slope), "new_slope": float(new_slope), "dots": dots}

    def accept(self, trial, first=False):
        def moved(both):
            (x, g, steps, changes), (new, grad, _) = both
            if first:
                return new, grad, [], []
            return new, grad, [new - x, *steps[: KEPT - 1]], [grad - g, *changes[: KEPT - 1]]

        self._stand(self.state.zip(trial).map(moved), [self.state, trial])

    def forget(self):
        self._stand(self.state.map(lambda s: (s[0], s[1], [], [])), [self.state])

    def _stand(self, state, old):
        self.old += old
        self.state = _kept(state)
        self.n_steps += 1
        if self.n_steps % EVERY == 0:
            self.state.checkpoint()

    def result(self):
        """(weights, intercept) on the scale of the values."""
        n_columns, n_parts = self.n_columns, self.n_parts
        off = sum(self.state.zip(self.parts).map(lambda both: float((both[0][0] * both[1][0]) @ both[1][1])).collect())
        final = self.state.zip(self.parts).mapPartitionsWithIndex(lambda n, both: [(n, (s[0] * p[0]).tobytes()) for s, p in both])
        table = written(self.spark.createDataFrame(final, "part int, w binary"), "svm-weights")

        def spell(batches):
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("w")):
                    w = np.frombuffer(data.as_buffer(), float)
                    ix = part + n_parts * np.arange(len(w))
                    for at in range(0, len(w), 100_000):
                        cut = slice(at, at + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(ix[cut], "int64"), pa.array(w[cut])], ["ix", "w"])

        weights = written(table.mapInArrow(spell, "ix long, w double"), "svm-columns")
        intercept = weights.where(F.col("ix") == n_columns).first()["w"]
        for rdd in (self.state, self.parts, self.blocks, *self.old):
            rdd.unpersist()
        return weights.where(F.col("ix") < n_columns), float(intercept) - off


def dict_of(messages):
    return dict(m for _, m in messages)


def _one_each(pairs, n, of, keep=True):
    """Pairs dealt by number: partition i holds one item, made of the pairs (i, ...)."""
    dealt = pairs.partitionBy(n, int).mapPartitions(lambda it: [of(it)], preservesPartitioning=True)
    return _kept(dealt) if keep else dealt._reserialize(SINGLE)


def _kept(rdd):
    return rdd._reserialize(SINGLE).persist(StorageLevel.MEMORY_AND_DISK)


def _block(rows: pa.Table, n_parts: int) -> pa.Table:
    cols = [rows[c].to_numpy() for c in ("row", "ix", "v", "w1", "w0")]
    data = pickle.dumps(_block_of(*cols, n_parts), protocol=5)
    return pa.table({"block": rows["block"].slice(0, 1).combine_chunks().cast("int32"), "data": pa.array([data], "binary")})


def _block_of(row, ix, v, w1, w0, n_parts):
    """Cells in row order; columns numbered as the parts list them, `cuts` where a part's columns begin."""
    order = np.argsort(row, kind="stable")
    row, ix, v = row[order], ix[order].astype("int64"), v[order]
    ids, column = np.unique(ix, return_inverse=True)
    by_part = np.lexsort((ids, ids % n_parts))
    place = np.empty(len(ids), "int32")
    place[by_part] = np.arange(len(ids))
    ids = ids[by_part]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
    small = v.astype("float32")
    return {
        "starts": starts,
        "columns": place[column],
        "values": None if (v == 1.0).all() else small if (small == v).all() else v,
        "w1": w1[order][starts].astype(float),
        "w0": w0[order][starts].astype(float),
        "ids": ids // n_parts,
        "cuts": np.searchsorted(ids % n_parts, np.arange(n_parts + 1)),
    }


def _row_of(block):
    return np.repeat(np.arange(len(block["starts"])), np.diff(np.append(block["starts"], len(block["columns"]))))


def _hinge(block, weights):
    """(loss, sum of the rows' pulls, sums of the gradient by column) of the block's rows."""
    w = np.concatenate([weights[p][0] for p in sorted(weights)])
    if not len(w):
        return 0.0, 0.0, w
    cells = w[block["columns"]]
    if block["values"] is not None:
        cells *= block["values"]
    margin = np.add.reduceat(cells, block["starts"]) - sum(weights[p][1] for p in sorted(weights))
    short1, short0 = np.maximum(1.0 - margin, 0.0), np.maximum(1.0 + margin, 0.0)
    pull = block["w0"] * (short0 > 0) - block["w1"] * (short1 > 0)
    cells = pull[_row_of(block)]
    if block["values"] is not None:
        cells *= block["values"]
    return float(block["w1"] @ short1 + block["w0"] @ short0), float(pull.sum()), np.bincount(block["columns"], cells, len(w))


def _column_sums(n, blocks):
    """For each part (block, places of its columns, sums of values and of squares)."""
    for block in blocks:
        values = np.ones(len(block["columns"])) if block["values"] is None else block["values"].astype(float)
        weight = (block["w1"] + block["w0"])[_row_of(block)] if len(values) else values
        sums = np.bincount(block["columns"], weight * values, len(block["ids"])), np.bincount(block["columns"], weight * values * values, len(block["ids"]))
        for p in np.flatnonzero(np.diff(block["cuts"])):
            cut = slice(block["cuts"][p], block["cuts"][p + 1])
            yield int(p), (n, block["ids"][cut], *[s[cut] for s in sums])


def _part(n, messages, n_columns, n_parts, total, squares):
    """(scales, means, places by block) of a part's columns: a scale is one over the deviation, 0 for a constant column."""
    size = len(range(n, n_columns + 1, n_parts))
    first, second, held = np.zeros(size), np.zeros(size), {}
    for block, at, sums, sums2 in sorted(messages, key=lambda m: m[0]):
        first[at] += sums
        second[at] += sums2
        held[block] = at
    spread = np.maximum(second - first * first / total, 0.0) / (total - squares / total) if total > squares / total else np.zeros(size)
    scale = np.where(spread > 0, 1.0 / np.sqrt(np.where(spread > 0, spread, 1.0)), 0.0)
    if n == n_columns % n_parts:
        scale[n_columns // n_parts], first[n_columns // n_parts] = 1.0, 0.0  # the intercept is not centred
    return scale, first / total, held


def _stepped(x, g, steps, changes, coef, size):
    """(way, new weights): the way goes down in each column, and no weight changes its sign within a step."""
    way = coef[-1] * g
    for c, v in zip(coef, [*steps, *changes]):
        way = way + c * v
    way = np.where(way * g < 0, way, 0.0)
    new = x + size * way
    side = np.where(x != 0, np.sign(x), np.sign(-g))
    return way, np.where(np.sign(new) == side, new, 0.0)
