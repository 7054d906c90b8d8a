"""Gaussian mixture queries: 64-dimensional embeddings (diagonal), 2-dimensional event points (full)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import query
from catalog.sqltext import digamma, rnd
from docsift.functions import special as SP
from docsift.operators import stats as ST
from docsift.plans import gauss as G, mixture as X
from docsift.sources.tables import spread

K = 10
TYPES = ["click", "error", "purchase", "signup", "view"]


def vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label"
    )
    return spread(df, "id")


def points(spark, sf):
    """Events as points (value / 100, hour fraction), labelled by type."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    hour = (F.unix_micros(F.col("ts").cast("timestamp")) % 3600000000) / 3.6e9
    label = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1
    df = e.select(F.col("event_id").alias("id"), F.array(F.col("value") / 100.0, hour).alias("x"), label.cast("int").alias("label"))
    return spread(df, "id")


def labelled(vs, alloc, obs, k):
    return X.start_from_labels(vs, X.new_model(vs, alloc, obs, k))


def rounded(df, **cols):
    return df.select(*[F.round(c, cols[c]).alias(c) if c in cols else c for c in df.columns])


def long_array(df, col, out, index="k", keep=("id",)):
    return df.select(*keep, F.posexplode(col).alias(index, out))


EMB = """v AS (SELECT vec_id AS id, label, cast(unnest(embedding) AS DOUBLE) AS x, cast(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM embeddings),
nn AS (SELECT label AS k, count(*) AS n FROM embeddings GROUP BY label),
mo AS (SELECT label AS k, i, sum(x) AS sx, sum(x * x) AS sxx FROM v GROUP BY label, i)"""
EM = EMB + f""",
par AS (SELECT k, i, sx / n AS m, sxx / n - sx / n * (sx / n) + 1e-8 AS s, n / (SELECT sum(n) FROM nn) AS w FROM mo JOIN nn USING (k)),
ll AS (SELECT id, k, ln(any_value(w)) + sum(-0.5 * (ln(2 * pi() * s) + (x - m) * (x - m) / s)) AS l FROM v JOIN par USING (i) GROUP BY id, k),
ex AS (SELECT id, k, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM ll),
resp AS (SELECT id, k, e / sum(e) OVER (PARTITION BY id) AS r FROM ex),
rn AS (SELECT k, sum(r) AS n FROM resp GROUP BY k),
rm AS (SELECT k, i, sum(r * x) AS sx, sum(r * x * x) AS sxx FROM v JOIN resp USING (id) GROUP BY k, i)"""
# Gauss-Gamma posterior of the label statistics, prior m0 = 0, kappa0 = 1e-4, a0 = 1, b0 = 2.
GG = EMB + """,
post AS (SELECT k, i, n, n + 1e-4 AS kappa, sx / (n + 1e-4) AS m, 1 + n / 2.0 AS a,
  2 + 0.5 * (sxx - sx * sx / (n + 1e-4)) AS b FROM mo JOIN nn USING (k))"""
VB = GG + f""",
wt AS (SELECT k, {digamma('(1.0 + n)')} - {digamma("(SELECT sum(n) + 10.0 FROM nn)")} AS lw FROM nn),
ll AS (SELECT id, k, any_value(lw) - 32 * ln(2 * pi()) + 0.5 * sum({digamma('a')} - ln(b) - a / b * (x - m) * (x - m) - 1 / kappa) AS l
  FROM v JOIN post USING (i) JOIN wt USING (k) GROUP BY id, k),
ex AS (SELECT id, k, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM ll),
resp AS (SELECT id, k, e / sum(e) OVER (PARTITION BY id) AS r FROM ex)"""
PTS = f"""p AS (SELECT event_id AS id, value / 100.0 AS x0, (epoch_us(ts) % 3600000000) / 3.6e9 AS x1,
  cast(list_position({TYPES}, event_type) - 1 AS INTEGER) AS label FROM events),
pm AS (SELECT label AS k, count(*) AS n, sum(x0) AS s0, sum(x1) AS s1, sum(x0 * x0) AS s00, sum(x0 * x1) AS s01, sum(x1 * x1) AS s11 FROM p GROUP BY label)"""
ML = PTS + """,
pp AS (SELECT k, s0 / n AS m0, s1 / n AS m1, s00 / n - s0 / n * (s0 / n) + 1e-8 AS c00, s01 / n - s0 / n * (s1 / n) AS c01, s11 / n - s1 / n * (s1 / n) + 1e-8 AS c11 FROM pm)"""
# Gauss-Wishart posterior, prior m0 = 0, kappa0 = 1e-4, nu0 = 4, inverse scale I.
GW = PTS + """,
gw AS (SELECT k, n, n + 1e-4 AS kappa, s0 / (n + 1e-4) AS m0, s1 / (n + 1e-4) AS m1, 4.0 + n AS nu,
  1 + s00 - s0 * s0 / (n + 1e-4) AS w00, s01 - s0 * s1 / (n + 1e-4) AS w01, 1 + s11 - s1 * s1 / (n + 1e-4) AS w11 FROM pm)"""
GGZ = "sum(lgamma(a) - a * ln(b) + 0.5 * ln(2 * pi()) - 0.5 * ln(kappa))"
GWZ = """(nu * ln(2) - 0.5 * nu * ln(w00 * w11 - w01 * w01) + lgamma(nu / 2) + lgamma(nu / 2 - 0.5) + 0.5 * ln(pi()) + ln(2 * pi()) - ln(kappa))"""


@query("init_from_labels", f"WITH {EM} SELECT k, i, {rnd('m')} AS mean, {rnd('s')} AS var FROM par")
def init_from_labels(spark, sf):
    m = labelled(vectors(spark, sf), "em", "diag", K)
    return params(spark, m)


def params(spark, m):
    rows = [(k, i, float(m.comps["m"][k, i]), float(m.comps["var"][k, i])) for k in range(m.k) for i in range(m.dim)]
    return rounded(spark.createDataFrame(rows, "k int, i int, mean double, var double"), mean=6, var=6)


@query("init_mixture", f"""WITH c AS (SELECT cast(row_number() OVER (ORDER BY md5('3:' || vec_id), vec_id) - 1 AS INTEGER) AS k, vec_id AS id, embedding FROM embeddings ORDER BY k LIMIT 10)
SELECT k, cast(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, {rnd('cast(unnest(embedding) AS DOUBLE)')} AS mean, round(1e-8, 6) AS var FROM c""")
def init_mixture(spark, sf):
    vs = vectors(spark, sf)
    return params(spark, X.start(vs, X.new_model(vs, "em", "diag", K), "randexamples", 3))


@query("mix_loglik", f"WITH {EM} SELECT id, k, {rnd('l', 5)} AS log_lik FROM ll")
def mix_loglik(spark, sf):
    vs = vectors(spark, sf)
    scored = X.score_vectors(vs, labelled(vs, "em", "diag", K))
    return rounded(long_array(scored, "log_lik", "log_lik"), log_lik=5)


@query("softmax_rows", f"WITH {EM} SELECT id, k, {rnd('r')} AS r FROM resp")
def softmax_rows(spark, sf):
    vs = vectors(spark, sf)
    scored = X.score_vectors(vs, labelled(vs, "em", "diag", K)).select("id", SP.softmax(F.col("log_lik")).alias("r"))
    return rounded(long_array(scored, "r", "r"), r=6)


@query("score_vectors", f"WITH {VB} SELECT id, k, {rnd('r')} AS r FROM resp")
def score_vectors(spark, sf):
    vs = vectors(spark, sf)
    return rounded(long_array(X.score_vectors(vs, labelled(vs, "vb", "diag", K)), "resp", "r"), r=6)


@query("hard_assign", f"WITH {EM} SELECT id, cast(min(k) AS INTEGER) AS k FROM (SELECT id, k, r, max(r) OVER (PARTITION BY id) AS t FROM resp) WHERE r = t GROUP BY id")
def hard_assign(spark, sf):
    vs = vectors(spark, sf)
    return X.score_vectors(vs, labelled(vs, "em", "diag", K)).select("id", SP.hard_assign(F.col("resp")).alias("k"))


def em_resp(spark, sf):
    vs = vectors(spark, sf)
    return vs.join(X.score_vectors(vs, labelled(vs, "em", "diag", K)), "id")


def em_stats(spark, sf):
    vs = vectors(spark, sf)
    return X.model_stats(vs, labelled(vs, "em", "diag", K), pairs=True)


@query("mix_stats", f"WITH {EM} SELECT k, {rnd('n')} AS n FROM rn")
def mix_stats(spark, sf):
    return em_stats(spark, sf).where("field = 'N'").select("k", F.round("value", 6).alias("n"))


@query("diag_moments", f"WITH {EM} SELECT k, i, {rnd('sx')} AS sx, {rnd('sxx')} AS sxx FROM rm")
def diag_moments(spark, sf):
    s = em_stats(spark, sf)
    x = s.where("field = 'x'").select("k", "i", F.round("value", 6).alias("sx"))
    return x.join(s.where("field = 'xx'").select("k", "i", F.round("value", 6).alias("sxx")), ["k", "i"])


@query("gauss_moments", f"WITH {EMB} SELECT a.label AS k, a.i, b.i AS j, {rnd('sum(a.x * b.x)')} AS sxx FROM v a JOIN v b USING (id) GROUP BY ALL")
def gauss_moments(spark, sf):
    rows = vectors(spark, sf).withColumn("resp", X.one_hot(F.col("label"), K))
    return X.resp_stats(rows, "full").where("field = 'xx'").select("k", "i", "j", F.round("value", 6).alias("sxx"))


@query("zm_moments", f"""WITH {PTS} SELECT k, {rnd('s00', 4)} AS s00, {rnd('s01', 4)} AS s01, {rnd('s11', 4)} AS s11 FROM pm""")
def zm_moments(spark, sf):
    rows = points(spark, sf).withColumn("resp", X.one_hot(F.col("label"), 5))
    xx = X.resp_stats(rows, "zero_mean").where("field = 'xx' AND i <= j")
    pick = lambda i, j: F.round(F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("value"))), 4).alias(f"s{i}{j}")
    return xx.groupBy("k").agg(pick(0, 0), pick(0, 1), pick(1, 1))


@query("resp_entropy", f"WITH {EM} SELECT k, {rnd('sum(CASE WHEN r > 0 THEN r * ln(r) ELSE 0 END)')} AS rlogr FROM resp GROUP BY k")
def resp_entropy(spark, sf):
    return em_stats(spark, sf).where("field = 'rlogr'").select("k", F.round("value", 6).alias("rlogr"))


@query("pair_entropy", f"""WITH {EM} SELECT a.k AS ka, b.k AS kb, {rnd('sum(CASE WHEN a.r + b.r > 0 THEN (a.r + b.r) * ln(a.r + b.r) ELSE 0 END)')} AS rlogr
FROM resp a JOIN resp b ON a.id = b.id AND a.k < b.k GROUP BY ALL""")
def pair_entropy(spark, sf):
    s = em_stats(spark, sf).where("field = 'pair' AND k < i")
    return s.select(F.col("k").alias("ka"), F.col("i").alias("kb"), F.round("value", 6).alias("rlogr"))


@query("em_step", f"""WITH {EM} SELECT k, i, {rnd('sx / n', 5)} AS mean, {rnd('sxx / n - sx / n * (sx / n) + 1e-8', 5)} AS var,
  {rnd('n / (SELECT count(*) FROM embeddings)', 5)} AS weight FROM rm JOIN rn USING (k)""")
def em_step(spark, sf):
    vs = vectors(spark, sf)
    m = labelled(vs, "em", "diag", K)
    m = m.m_step(ST.to_numpy(X.model_stats(vs, m), X.shapes(m)))
    rows = [
        (k, i, float(m.comps["m"][k, i]), float(m.comps["var"][k, i]), float(m.weights["w"][k]))
        for k in range(m.k)
        for i in range(m.dim)
    ]
    return rounded(spark.createDataFrame(rows, "k int, i int, mean double, var double, weight double"), mean=5, var=5, weight=5)


def gamma_rows(spark, m):
    q = m.comps
    rows = [
        (k, i, float(q["kappa"][k]), float(q["m"][k, i]), float(q["a"][k, 0]), float(q["b"][k, i]))
        for k in range(m.k)
        for i in range(m.dim)
    ]
    return rounded(spark.createDataFrame(rows, "k int, i int, kappa double, m double, a double, b double"), kappa=5, m=5, a=5, b=5)


@query("vb_step", f"""WITH {VB}, rn AS (SELECT k, sum(r) AS n FROM resp GROUP BY k),
rm AS (SELECT k, i, sum(r * x) AS sx, sum(r * x * x) AS sxx FROM v JOIN resp USING (id) GROUP BY k, i)
SELECT k, i, {rnd('n + 1e-4', 5)} AS kappa, {rnd('sx / (n + 1e-4)', 5)} AS m, {rnd('1 + n / 2', 5)} AS a, {rnd('2 + 0.5 * (sxx - sx * sx / (n + 1e-4))', 5)} AS b FROM rm JOIN rn USING (k)""")
def vb_step(spark, sf):
    vs = vectors(spark, sf)
    m = labelled(vs, "vb", "diag", K)
    return gamma_rows(spark, m.m_step(ST.to_numpy(X.model_stats(vs, m), X.shapes(m))))


@query("posterior_update", f"WITH {GG} SELECT k, i, {rnd('kappa', 5)} AS kappa, {rnd('m', 5)} AS m, {rnd('a', 5)} AS a, {rnd('b', 5)} AS b FROM post")
def posterior_update(spark, sf):
    return gamma_rows(spark, labelled(vectors(spark, sf), "vb", "diag", K))


@query("posterior_update_full", f"""WITH {GW} SELECT k, {rnd('kappa', 4)} AS kappa, {rnd('m0')} AS m0, {rnd('m1')} AS m1, {rnd('nu', 4)} AS nu,
  {rnd('w00', 4)} AS w00, {rnd('w01', 4)} AS w01, {rnd('w11', 4)} AS w11 FROM gw""")
def posterior_update_full(spark, sf):
    q = labelled(points(spark, sf), "vb", "full", 5).comps
    rows = [
        tuple(float(v) for v in (q["kappa"][k], *q["m"][k], q["nu"][k], q["winv"][k, 0, 0], q["winv"][k, 0, 1], q["winv"][k, 1, 1]))
        for k in range(5)
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, kappa double, m0 double, m1 double, nu double, w00 double, w01 double, w11 double")
    return rounded(df, kappa=4, m0=6, m1=6, nu=4, w00=4, w01=4, w11=4)


@query("log_norm_consts", f"""WITH {GG}, {GW.split('WITH')[-1]}
SELECT 'diag' AS obs, k, {rnd(GGZ, 3)} AS log_norm FROM post GROUP BY k
UNION ALL SELECT 'full', k, {rnd(GWZ, 3)} FROM gw""")
def log_norm_consts(spark, sf):
    out = []
    for obs, vs, k in (("diag", vectors(spark, sf), K), ("full", points(spark, sf), 5)):
        z = G.log_norm(obs, labelled(vs, "vb", obs, k).comps)
        out += [(obs, c, round(float(v), 3)) for c, v in enumerate(z)]
    return spark.createDataFrame(out, "obs string, k int, log_norm double")


GGH = f"sum(a - ln(b) + lgamma(a) + (1 - a) * {digamma('a')} + 0.5 * (ln(2 * pi()) + 1 - ln(kappa) - {digamma('a')} + ln(b)))"
GWL = f"({digamma('(nu / 2)')} + {digamma('(nu / 2 - 0.5)')} + 2 * ln(2) - ln(w00 * w11 - w01 * w01))"
WZ = "(nu * ln(2) - 0.5 * nu * ln(w00 * w11 - w01 * w01) + lgamma(nu / 2) + lgamma(nu / 2 - 0.5) + 0.5 * ln(pi()))"
WH = f"({WZ} - 0.5 * (nu - 3) * {GWL} + nu)"


@query("entropies", f"""WITH {GG}, {GW},
zm AS (SELECT k, 4.0 + n AS nu, 1 + s00 AS w00, s01 AS w01, 1 + s11 AS w11 FROM pm)
SELECT 'diag' AS obs, k, {rnd(GGH, 3)} AS entropy FROM post GROUP BY k
UNION ALL SELECT 'full', k, {rnd(f'{WH} + ln(2 * pi()) + 1 - ln(kappa) - 0.5 * {GWL}', 3)} FROM gw
UNION ALL SELECT 'zero_mean', k, {rnd(WH, 3)} FROM zm""")
def entropies(spark, sf):
    from docsift.plans.families import entropy

    out = []
    for obs, vs, k in (("diag", vectors(spark, sf), K), ("full", points(spark, sf), 5), ("zero_mean", points(spark, sf), 5)):
        out += [(obs, c, round(float(v), 3)) for c, v in enumerate(entropy(obs, labelled(vs, "vb", obs, k).comps))]
    return spark.createDataFrame(out, "obs string, k int, entropy double")


@query("beta_update", f"""WITH n AS (SELECT source, count(*) FILTER (toxic = 1) AS ones, count(*) FILTER (toxic = 0) AS zeros
  FROM documents JOIN labels USING (doc_id) GROUP BY source),
p AS (SELECT source, 1.0 + ones AS a, 1.0 + zeros AS b FROM n),
e AS (SELECT *, {digamma('a')} - {digamma('(a + b)')} AS l1, {digamma('b')} - {digamma('(a + b)')} AS l0, lgamma(a) + lgamma(b) - lgamma(a + b) AS z FROM p)
SELECT source, {rnd('a')} AS a, {rnd('b')} AS b, {rnd('l1')} AS e_log_p, {rnd('l0')} AS e_log_1p, {rnd('z', 4)} AS log_norm,
  {rnd('z - (a - 1) * l1 - (b - 1) * l0', 4)} AS entropy FROM e""")
def beta_update(spark, sf):
    from docsift.plans import families as B

    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").join(labels, "doc_id")
    count = lambda v: F.sum(F.when(F.col("toxic") == v, 1).otherwise(0))
    post = B.beta_posterior(rows.groupBy("source").agg(count(1).alias("ones"), count(0).alias("zeros")), "ones", "zeros")
    a, b = F.col("a"), F.col("b")
    one, zero = B.beta_expected_logs(a, b)
    got = post.select("source", "a", "b", one.alias("e_log_p"), zero.alias("e_log_1p"), B.beta_log_norm(a, b).alias("log_norm"), B.beta_entropy(a, b).alias("entropy"))
    return rounded(got, a=6, b=6, e_log_p=6, e_log_1p=6, log_norm=4, entropy=4)


@query("merge_pairs", f"""WITH {GG}, z AS (SELECT k, {GGZ} AS z FROM post GROUP BY k),
ab AS (SELECT a.k AS ka, b.k AS kb, a.i, a.n + b.n + 1e-4 AS kappa, 1 + (a.n + b.n) / 2.0 AS a,
  2 + 0.5 * (x.sxx + y.sxx - (x.sx + y.sx) * (x.sx + y.sx) / (a.n + b.n + 1e-4)) AS b
  FROM post a JOIN post b ON a.i = b.i AND a.k < b.k JOIN mo x ON x.k = a.k AND x.i = a.i JOIN mo y ON y.k = b.k AND y.i = b.i),
zz AS (SELECT ka, kb, {GGZ} AS z FROM ab GROUP BY ka, kb)
SELECT ka, kb, {rnd('zz.z - p.z - q.z', 3)} AS score FROM zz JOIN z p ON p.k = ka JOIN z q ON q.k = kb""")
def merge_pairs(spark, sf):
    from docsift.plans.moves import merge_scores

    vs = vectors(spark, sf)
    model = X.new_model(vs, "vb", "diag", K)
    rows = vs.withColumn("resp", X.one_hot(F.col("label"), K))
    ss = ST.to_numpy(X.resp_stats(rows, "diag"), X.shapes(model))
    return rounded(spark.createDataFrame(merge_scores(model, ss), "ka int, kb int, score double"), score=3)


@query("merge_bipartite", f"""WITH {GG}, z AS (SELECT k, {GGZ} AS z FROM post GROUP BY k),
ab AS (SELECT a.k AS ka, b.k AS kb, a.i, a.n + b.n + 1e-4 AS kappa, 1 + (a.n + b.n) / 2.0 AS a,
  2 + 0.5 * (x.sxx + y.sxx - (x.sx + y.sx) * (x.sx + y.sx) / (a.n + b.n + 1e-4)) AS b
  FROM post a JOIN post b ON a.i = b.i AND a.k < b.k JOIN mo x ON x.k = a.k AND x.i = a.i JOIN mo y ON y.k = b.k AND y.i = b.i),
zz AS (SELECT ka, kb, {GGZ} AS z FROM ab GROUP BY ka, kb),
listed AS (SELECT unnest([7, 8, 9]) AS c),
best AS (SELECT c, ka, kb, row_number() OVER (PARTITION BY c ORDER BY zz.z - p.z - q.z DESC) AS n
  FROM zz JOIN z p ON p.k = ka JOIN z q ON q.k = kb JOIN listed ON c IN (ka, kb) WHERE ka + kb - c NOT IN (SELECT c FROM listed))
SELECT (row_number() OVER (ORDER BY n, c))::INTEGER AS place, ka, kb FROM best WHERE n <= 3""")
def merge_bipartite(spark, sf):
    """Merges to try for components 7 to 9 as if they were fresh: each with its three best partners among the others."""
    from docsift.plans.moves import preselect

    vs = vectors(spark, sf)
    model = X.new_model(vs, "vb", "diag", K)
    rows = vs.withColumn("resp", X.one_hot(F.col("label"), K))
    ss = ST.to_numpy(X.resp_stats(rows, "diag"), X.shapes(model))
    pairs = preselect(model, ss, "marglikfromlistbipartite", listed=[7, 8, 9])
    return spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs, 1)], "place int, ka int, kb int")


@query("gauss_logpdf", f"""WITH {ML} SELECT id, k, {rnd('-ln(2 * pi()) - 0.5 * ln(c00 * c11 - c01 * c01) - 0.5 * (c11 * (x0 - m0) * (x0 - m0) - 2 * c01 * (x0 - m0) * (x1 - m1) + c00 * (x1 - m1) * (x1 - m1)) / (c00 * c11 - c01 * c01)')} AS log_pdf
FROM p, pp""")
def gauss_logpdf(spark, sf):
    vs = points(spark, sf)
    m = labelled(vs, "em", "full", 5)
    m.weights = {"w": np.ones(5)}
    return rounded(long_array(X.score_vectors(vs, m), "log_lik", "log_pdf"), log_pdf=6)


@query("expected_logpdf", f"""WITH {GW} SELECT id, k, {rnd(f'''0.5 * ({digamma("(nu / 2)")} + {digamma("(nu / 2 - 0.5)")} + 2 * ln(2) - ln(w00 * w11 - w01 * w01))
  - 0.5 * nu * (w11 * (x0 - m0) * (x0 - m0) - 2 * w01 * (x0 - m0) * (x1 - m1) + w00 * (x1 - m1) * (x1 - m1)) / (w00 * w11 - w01 * w01) - 1 / kappa - ln(2 * pi())''')} AS e_log_pdf FROM p, gw""")
def expected_logpdf(spark, sf):
    vs = points(spark, sf)
    m = labelled(vs, "vb", "full", 5)

    def weightless(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "e": list(G.expected_log_pdf("full", m.comps, np.stack(pdf["x"])))})

    scored = vs.select("id", "x").mapInPandas(weightless, "id long, e array<double>")
    return rounded(long_array(scored, "e", "e_log_pdf"), e_log_pdf=6)


@query("data_cov", f"""WITH {EMB}, w AS (SELECT a.label, a.i, b.i AS j, covar_pop(a.x, b.x) AS c, count(*) AS n FROM v a JOIN v b USING (id) GROUP BY ALL)
SELECT i, j, {rnd('sum(c * n) / sum(n)')} AS cov FROM w GROUP BY i, j""")
def data_cov(spark, sf):
    return rounded(X.data_covariance(vectors(spark, sf), "label"), cov=6)


@query("sovb_blend", f"""WITH {GG}, half AS (SELECT label AS k, i, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM v WHERE md5('9:' || id) < '8' GROUP BY label, i),
nat AS (SELECT p.k, p.i, 0.7 * (1e-4 + h.n) + 0.3 * p.kappa AS kappa, 0.7 * h.sx + 0.3 * p.kappa * p.m AS km,
  0.7 * (1 + h.n / 2.0) + 0.3 * p.a AS a, 0.7 * (2 + 0.5 * h.sxx) + 0.3 * (p.b + 0.5 * p.kappa * p.m * p.m) AS bn FROM post p JOIN half h USING (k, i))
SELECT k, i, {rnd('kappa', 5)} AS kappa, {rnd('km / kappa', 5)} AS m, {rnd('a', 5)} AS a, {rnd('bn - 0.5 * km * km / kappa', 5)} AS b FROM nat""")
def sovb_blend(spark, sf):
    from docsift.functions.ranking import hash_key

    vs = vectors(spark, sf)
    old = labelled(vs, "vb", "diag", K)
    new = labelled(vs.where(hash_key(9, "id") < "8"), "vb", "diag", K)
    old.comps = G.blend("diag", old.comps, new.comps, 0.7)
    return gamma_rows(spark, old)


@query("elbo_terms", f"""WITH {VB}, rn AS (SELECT k, sum(r) AS n FROM resp GROUP BY k),
rm AS (SELECT k, i, sum(r * x) AS sx, sum(r * x * x) AS sxx FROM v JOIN resp USING (id) GROUP BY k, i),
po AS (SELECT k, i, n + 1e-4 AS kappa, 1 + n / 2 AS a, 2 + 0.5 * (sxx - sx * sx / (n + 1e-4)) AS b FROM rm JOIN rn USING (k)),
data AS (SELECT sum(lgamma(a) - a * ln(b) - 0.5 * ln(kappa) + ln(2) + 0.5 * ln(1e-4)) AS v FROM po),
norm AS (SELECT -32 * ln(2 * pi()) * sum(n) AS v FROM rn),
alloc AS (SELECT sum(lgamma(1 + n)) - lgamma(sum(1 + n)) + lgamma(10) AS v FROM rn),
ent AS (SELECT -sum(CASE WHEN r > 0 THEN r * ln(r) ELSE 0 END) AS v FROM resp)
SELECT 'alloc' AS term, {rnd('v', 2)} AS value FROM alloc UNION ALL SELECT 'entropy', {rnd('v', 2)} FROM ent
UNION ALL SELECT 'data', {rnd('data.v + norm.v', 2)} FROM data, norm
UNION ALL SELECT 'elbo', {rnd('data.v + norm.v + alloc.v + ent.v', 2)} FROM data, norm, alloc, ent""")
def elbo_terms(spark, sf):
    vs = vectors(spark, sf)
    m = labelled(vs, "vb", "diag", K)
    ss = ST.to_numpy(X.model_stats(vs, m), X.shapes(m))
    alloc, entropy, total = m.weight_bound(ss["N"]), -ss["rlogr"].sum(), m.elbo(ss)
    rows = [("alloc", alloc), ("entropy", entropy), ("data", total - alloc - entropy), ("elbo", total)]
    return rounded(spark.createDataFrame([(t, float(v)) for t, v in rows], "term string, value double"), value=2)


SPLIT = """s0 AS (SELECT label AS k, i, sum(x) AS value FROM v WHERE md5('9:' || id) < '8' GROUP BY label, i),
s1 AS (SELECT label AS k, i, sum(x) AS value FROM v WHERE md5('9:' || id) >= '8' GROUP BY label, i)"""


def halves(spark, sf):
    from docsift.functions.ranking import hash_key

    rows = vectors(spark, sf).withColumn("resp", X.one_hot(F.col("label"), K))
    first = hash_key(9, "id") < "8"
    return X.resp_stats(rows.where(first), "diag"), X.resp_stats(rows.where(~first), "diag")


def only_x(stats):
    return stats.where("field = 'x'").select("k", "i", F.round(F.col("value") + 0.0, 6).alias("value"))


@query("stats_add", f"WITH {EMB} SELECT k, i, {rnd('sx')} AS value FROM mo")
def stats_add(spark, sf):
    return only_x(ST.add(*halves(spark, sf)))


@query("stats_sub", f"WITH {EMB}, {SPLIT} SELECT k, i, {rnd('s0.value - s1.value')} AS value FROM s0 JOIN s1 USING (k, i)")
def stats_sub(spark, sf):
    return only_x(ST.subtract(*halves(spark, sf)))


@query("stats_merge", f"""WITH {EMB}, m AS (SELECT CASE WHEN k = 5 THEN 2 WHEN k > 5 THEN k - 1 ELSE k END AS k, i, sx FROM mo)
SELECT cast(k AS INTEGER) AS k, i, {rnd('sum(sx)')} AS value FROM m GROUP BY k, i""")
def stats_merge(spark, sf):
    return only_x(ST.merge(ST.add(*halves(spark, sf)), 2, 5))


@query("dp_sticks", f"""WITH {EM}, s AS (SELECT k, 1 + n AS a, 1 + coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS b FROM rn),
e AS (SELECT k, a, b, {digamma('a')} - {digamma('(a + b)')} AS lv, {digamma('b')} - {digamma('(a + b)')} AS l1 FROM s)
SELECT k, {rnd('a')} AS a, {rnd('b')} AS b, {rnd('lv + coalesce(sum(l1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS e_log_w FROM e""")
def dp_sticks(spark, sf):
    from docsift.operators.sticks import dp_sticks as sticks

    n = em_stats(spark, sf).where("field = 'N'").select("k", F.col("value").alias("n"))
    return rounded(sticks(n, 1.0), a=6, b=6, e_log_w=6)


@query("stick_breaking", f"""WITH {EM}, t AS (SELECT k, n / (sum(n) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1) AS v FROM rn),
b AS (SELECT k, v, v * exp(coalesce(sum(ln(1 - v)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS beta FROM t)
SELECT k, {rnd('beta')} AS beta FROM b UNION ALL SELECT 10, {rnd('1 - sum(beta)')} FROM b""")
def stick_breaking(spark, sf):
    from docsift.operators.sticks import break_sticks
    from pyspark.sql import Window as W

    n = em_stats(spark, sf).where("field = 'N'").select("k", F.col("value").alias("n"))
    rest = F.sum("n").over(W.orderBy("k").rowsBetween(0, W.unboundedFollowing)) + 1.0
    return rounded(break_sticks(n.select("k", (F.col("n") / rest).alias("v"))), beta=6)


@query("special_functions", f"""SELECT DISTINCT n_chars AS n, {rnd(digamma('(n_chars / 7.0 + 0.01)'), 8)} AS psi, {rnd('lgamma(n_chars / 7.0 + 0.01)', 4)} AS lgam,
  {rnd('lgamma(n_chars / 7.0 + 2) + lgamma(n_chars / 7.0 + 1.5) + lgamma(n_chars / 7.0 + 1) + 1.5 * ln(pi())', 4)} AS mv_lgam,
  {rnd(' + '.join(digamma(f'(n_chars / 7.0 + {c})') for c in ('2.0', '1.5', '1.0')), 8)} AS mv_psi FROM documents""")
def special_functions(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("n_chars").alias("n")).distinct()
    x = F.col("n") / 7.0
    return n.select(
        "n",
        F.round(SP.digamma(x + 0.01), 8).alias("psi"),
        F.round(SP.lgamma(x + 0.01), 4).alias("lgam"),
        F.round(SP.multivariate_lgamma(x + 2.0, 3), 4).alias("mv_lgam"),
        F.round(SP.multivariate_digamma(x + 2.0, 3), 8).alias("mv_psi"),
    )


LAPS = 100  # at most; the learners stop when the bound keeps its first six figures


def fitted(spark, sf, alloc, obs="diag", n_lap=LAPS, seed=0, k=K, data=vectors):
    vs = data(spark, sf)
    return X.fit(vs, X.start(vs, X.new_model(vs, alloc, obs, k), "randexamplesbydist", seed), n_lap)


@query("em_mixture")
def em_mixture(spark, sf):
    vs = vectors(spark, sf)
    start = X.start(vs, X.new_model(vs, "em", "diag", K), "randsoftpartition")
    return X.comp_table(spark, X.fit(vs, start, LAPS)[0])


@query("vb_mixture")
def vb_mixture(spark, sf):
    return X.comp_table(spark, fitted(spark, sf, "vb", "full", k=3, data=points)[0])


@query("dp_mixture")
def dp_mixture(spark, sf):
    return X.comp_table(spark, fitted(spark, sf, "dp")[0])


@query("hard_dp_mixture")
def hard_dp_mixture(spark, sf):
    return X.comp_table(spark, fitted(spark, sf, "dp_hard", "zero_mean", k=3, data=points)[0])


@query("fit_trace")
def fit_trace(spark, sf):
    return X.trace_table(spark, fitted(spark, sf, "vb")[1])


@query("best_of_runs")
def best_of_runs(spark, sf):
    vs = vectors(spark, sf)
    (seed, model, _), runs = X.best_of(vs, X.new_model(vs, "dp", "diag", K), [0, 1], LAPS)
    rows = [(int(s), float(t[-1][1]), bool(s == seed)) for s, _, t in runs]
    return spark.createDataFrame(rows, "seed int, elbo double, best boolean")
