"""Graph queries: suppliers and parts as nodes, an edge where a supplier delivered a part."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.sqltext import digamma, rnd
from docsift.operators import graph as Gr

K = 4
RATES = [0.2, 0.4, 0.6, 0.8]

EDGES = """edges AS (SELECT DISTINCT least(l_suppkey * 2, l_partkey * 2 + 1) AS src, greatest(l_suppkey * 2, l_partkey * 2 + 1) AS dst FROM lineitem),
eh AS (SELECT src, dst, cast('0x' || substr(md5('6:' || src || ':' || dst), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 AS heldout FROM edges),
nodes AS (SELECT s_suppkey * 2 AS id FROM supplier UNION ALL SELECT p_partkey * 2 + 1 FROM part)"""


def graph(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    pairs = lines.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_suppkey") * 2).alias("id"))
    p = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") * 2 + 1).alias("id"))
    return s.unionAll(p), Gr.mark_heldout(Gr.undirected(pairs), 0.1, 6)


@query("node_pairs", f"""WITH {EDGES},
pr AS (SELECT a.id AS i, b.id AS j, eh.src IS NOT NULL AS y, coalesce(heldout, false) AS h FROM nodes a JOIN nodes b ON a.id < b.id LEFT JOIN eh ON eh.src = a.id AND eh.dst = b.id),
en AS (SELECT i AS id, y, h FROM pr UNION ALL SELECT j, y, h FROM pr)
SELECT id, count(*) FILTER (y AND NOT h) AS n_edges, count(*) FILTER (NOT y) AS n_nonedges, count(*) FILTER (h) AS n_heldout FROM en GROUP BY id""")
def node_pairs(spark, sf):
    return Gr.pair_counts(*graph(spark, sf))


@query("edge_scores", f"""WITH {EDGES}, ks AS (SELECT unnest(range(0, {K})) AS k),
al AS (SELECT id, k, cast('0x' || substr(md5('8/' || k || ':' || id), 1, 8) AS BIGINT) / 4294967296.0 * 5 + 0.1 AS a FROM nodes, ks),
lg AS (SELECT id, k, {digamma('a')} - pt AS e FROM al JOIN (SELECT id, {digamma('t')} AS pt FROM (SELECT id, sum(a) AS t FROM al GROUP BY id)) USING (id)),
sc AS (SELECT src, dst, p.k, exp(p.e + q.e) AS bo, exp(p.e + q.e) * (p.k + 1) / 5.0 AS score FROM edges JOIN lg p ON p.id = src JOIN lg q ON q.id = dst AND q.k = p.k)
SELECT src, dst, cast(k AS INTEGER) AS k, {rnd('score / (sum(score) OVER w + (1 - sum(bo) OVER w) * 1e-3)')} AS r FROM sc WINDOW w AS (PARTITION BY src, dst)""")
def edge_scores(spark, sf):
    nodes, edges = graph(spark, sf)
    logs = Gr.member_logs(Gr.start_members(nodes, K, 8))
    rows = Gr.edge_shares(edges, logs, RATES).select("src", "dst", F.posexplode("r").alias("k", "r"))
    return rows.withColumn("r", F.round("r", 6))


@query("graph_communities")
def graph_communities(spark, sf):
    nodes, edges = graph(spark, sf)
    members, _, _ = Gr.communities(nodes, edges, K, 3)
    return Gr.assign(members)
