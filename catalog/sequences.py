"""Hidden Markov queries over the events of each user."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.mixtures import TYPES
from catalog.sqltext import rnd
from docsift.operators import hmm as H
from docsift.session import scratch_path
from docsift.streaming import filtering

HMM = H.Hmm(
    [0.5, 0.3, 0.2],
    [[0.8, 0.1, 0.1], [0.2, 0.6, 0.2], [0.1, 0.3, 0.6]],
    [[0.4, 0.1, 0.1, 0.1, 0.3], [0.1, 0.1, 0.4, 0.3, 0.1], [0.1, 0.6, 0.1, 0.1, 0.1]],
)


def case(values):
    return "CASE o " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values)) + " END"


STEPS = " + ".join
# exponents make the numbers doubles in SQL, not decimals
A, B, P0 = ([[f"{v}e0" for v in r] for r in m] for m in (HMM.trans, HMM.emit, [HMM.init]))
P0 = P0[0]
SEQ = f"""ev AS (SELECT user_id, event_id, list_position({TYPES}, event_type) - 1 AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events),
ee AS (SELECT *, {case(B[0])} AS e0, {case(B[1])} AS e1, {case(B[2])} AS e2 FROM ev),
fw AS (SELECT user_id, t, {P0[0]} * e0 AS u0, {P0[1]} * e1 AS u1, {P0[2]} * e2 AS u2, {P0[0]} * e0 + {P0[1]} * e1 + {P0[2]} * e2 AS s FROM ee WHERE t = 1
  UNION ALL SELECT e.user_id, e.t, {', '.join(f'({STEPS(f"f.u{i} / f.s * {A[i][j]}" for i in range(3))}) * e.e{j}' for j in range(3))},
  {STEPS(f'({STEPS(f"f.u{i} / f.s * {A[i][j]}" for i in range(3))}) * e.e{j}' for j in range(3))}
  FROM fw f JOIN ee e ON e.user_id = f.user_id AND e.t = f.t + 1),
bw AS (SELECT user_id, t, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM ee WHERE t = n
  UNION ALL SELECT b.user_id, b.t - 1, {', '.join(f'({STEPS(f"{A[i][j]} * e.e{j} * b.b{j}" for j in range(3))}) / f.s' for i in range(3))}
  FROM bw b JOIN ee e ON e.user_id = b.user_id AND e.t = b.t JOIN fw f ON f.user_id = b.user_id AND f.t = b.t)"""


def events(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    obs = (F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")), F.lit(0)) - 1).cast("int")
    return e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), obs.alias("obs"))


@query("hmm_loglik", f"WITH RECURSIVE {SEQ} SELECT user_id, {rnd('sum(ln(s))')} AS log_lik FROM fw GROUP BY user_id")
def hmm_loglik(spark, sf):
    packed = H.chunks(events(spark, sf), "user_id", ["ts"], 32)
    return H.log_likelihood(packed, HMM).select(F.col("key").alias("user_id"), F.round("log_lik", 6).alias("log_lik"))


@query("hmm_smooth", f"""WITH RECURSIVE {SEQ} SELECT event_id, {', '.join(rnd(f'u{i} / s * b{i}') + f' AS r{i}' for i in range(3))}
FROM fw JOIN bw USING (user_id, t) JOIN ee USING (user_id, t)""")
def hmm_smooth(spark, sf):
    packed = H.chunks(events(spark, sf), "user_id", ["ts"], 32)
    got = H.smooth(packed, HMM)
    return got.select(F.col("id").alias("event_id"), *[F.round(F.col("resp")[i], 6).alias(f"r{i}") for i in range(3)])


@query("hmm_pairs", f"""WITH RECURSIVE {SEQ}, pr AS (SELECT c.user_id, {', '.join(f'p.u{i} / p.s * {A[i][j]} * e.e{j} * b.b{j} / c.s AS p{i}{j}' for i in range(3) for j in range(3))}
  FROM fw c JOIN fw p ON p.user_id = c.user_id AND p.t = c.t - 1 JOIN bw b ON b.user_id = c.user_id AND b.t = c.t JOIN ee e ON e.user_id = c.user_id AND e.t = c.t)
SELECT user_id, {', '.join(rnd(f'sum(p{i}{j})') + f' AS p{i}{j}' for i in range(3) for j in range(3))} FROM pr GROUP BY user_id""")
def hmm_pairs(spark, sf):
    """Expected transitions per user."""
    packed = H.chunks(events(spark, sf), "user_id", ["ts"], 32)
    rows = H.smooth(packed, HMM).where("pair IS NOT NULL")
    sums = [F.round(F.sum(F.col("pair")[3 * i + j]), 6).alias(f"p{i}{j}") for i in range(3) for j in range(3)]
    return rows.groupBy(F.col("key").alias("user_id")).agg(*sums)


@query("stream_hmm_filter", f"""WITH RECURSIVE {SEQ} SELECT event_id, {', '.join(rnd(f'u{i} / s') + f' AS f{i}' for i in range(3))}
FROM fw JOIN ee USING (user_id, t)""")
def stream_hmm_filter(spark, sf):
    """Every event of the table through the streaming filter."""
    path = scratch_path(spark, "events")
    events(spark, sf).withColumnRenamed("user_id", "key").write.parquet(path)
    stream = spark.readStream.schema("key long, ts timestamp, id long, obs int").parquet(path)
    got = filtering.filter_events(spark, stream, HMM, scratch_path(spark, "filter"), length=32)
    return got.select(F.col("id").alias("event_id"), *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(3)])
