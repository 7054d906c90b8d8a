"""Sharding by a hierarchical weighted hash tree.

A document descends from the root to a region, a rack and a shard. Every shard draws ln(u) / weight, where u
in (0, 1] is a hash of the document's id and the shard's number; the draw of a rack or region is the largest
of the shards below it, which is distributed as a draw with their summed weight. At each level the largest
draw wins. A change of weights therefore moves documents only into or out of the shards whose weights
change, and one more shard, wherever it is put, takes documents only into itself. Only DataFrame functions
are used; the draws of a document are computed once and serve all levels.

Null texts have no bytes; null ids are drawn as the text "null" and, like repeated rows, land together.
Ties of draws go to the larger child number, ties in the order of slots are equal rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docsift.llm.common import slots, table

Tree = list[tuple[int, int, int, float]]  # region, rack, shard, weight


def even_tree(n: int, per_rack: int = 5, racks: int = 4) -> Tree:
    """Shards 0 .. n - 1 of weight 1; a region is opened when all before it are full."""
    return [(s // (per_rack * racks), s // per_rack, s, 1.0) for s in range(n)]


def _draws(key: Column, tree: Tree) -> Column:
    """The draw of every shard of the tree for a row, with the shard's region and rack."""
    names = ("region", "rack", "shard", "weight")
    fixed = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(names, node))) for node in tree])
    own = F.coalesce(key.cast("string"), F.lit("null"))

    def draw(x: Column) -> Column:
        name = F.concat(own, F.lit(":"), x["shard"].cast("string"))
        unit = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12))
        return F.struct((F.log(unit) / x["weight"]).alias("draw"), *(x[n].alias(n) for n in names[:3]))

    return F.transform(fixed, draw)


def _child(draws: Column, level: str) -> Column:
    """The child of the largest draw; a child's draw is the largest below it."""
    return F.array_max(F.transform(draws, lambda x: F.struct(x["draw"].alias("draw"), x[level].alias("child"))))["child"]


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _below(draws: Column, level: str) -> Column:
    """The draws below the child that wins at a level."""
    return _once(_child(draws, level), lambda won: F.filter(draws, lambda x: x[level] == won))


def shard_of(df: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """df with the shard of each row under the tree, as column `name`."""
    descend = lambda d: _once(_below(d, "region"), lambda r: _once(_below(r, "rack"), lambda k: _child(k, "shard")))
    return df.withColumn(name, _once(_draws(F.col(key), tree), descend))


def shard(docs: DataFrame, tree: Tree, grown: Tree, buckets: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless within the shard), grown_shard under the grown tree."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = shard_of(shard_of(rows, "doc_id", tree, "shard"), "doc_id", grown, "grown_shard")
    placed = table(docs.sparkSession, placed, "placed")  # texts are read once
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return slots(placed, "shard", order, "slot", buckets)
