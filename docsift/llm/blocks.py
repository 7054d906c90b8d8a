"""Comparing the members of groups of any size without pairs as rows."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def blocked(rows: DataFrame, group: str, node: str, size: str, block: int, per_task: int) -> DataFrame:
    """rows with lo, hi, mine and bundle: what one comparison of two blocks of a group needs.

    A group of `size` rows is dealt to blocks of about `block` by a hash of the node. A row goes to every
    pair (lo, hi) of blocks that holds its own block `mine`; pairs of blocks are bundled into tasks of
    about `per_task` rows.
    """
    n_blocks = F.ceil(F.col(size) / block).cast("int")
    dealt = rows.withColumn("_n", n_blocks)
    total = dealt.agg(F.sum("_n")).first()[0] or 0
    bundles = max(1, -(-int(total) // per_task))
    mine = F.pmod(F.xxhash64(node), F.col("_n")).cast("int")
    return (
        dealt.withColumn("mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("lo", F.least("mine", "_other"))
        .withColumn("hi", F.greatest("mine", "_other"))
        .withColumn("bundle", F.pmod(F.xxhash64(group, "lo", "hi", F.lit(1)), F.lit(bundles)).cast("int"))
        .drop("_n", "_other", size)
    )


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n by links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links_frame(pairs: np.ndarray, copies: pd.Series) -> pd.DataFrame:
    """node, links (copies of its partners), root (smallest node reachable over these pairs)."""
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(2, -1)
    weight = copies.loc[nodes].to_numpy(np.int64)
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    return pd.DataFrame({"node": nodes, "links": links, "root": nodes[roots(len(nodes), a, b)]})
