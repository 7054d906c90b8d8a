"""URL filters: given host and path rules, and association rules learned from labelled urls.

Tokens of a url are labels of the host, parts of the path and names in the query. Tokens that stand in the
very same labelled urls are one class: any of them says as much as all of them, so one item stands for the
class while FP-growth mines combinations of items together with the label. Rules item set -> label are kept
from a minimum support and confidence on, and dropped if a subset of their items gives the label with at
least the same confidence. A url fits a rule if it has a token of each of its classes. An inverted index
holds each rule under the tokens of its rarest class: a url is compared only with rules under its tokens, and
the matching rule of highest confidence decides (then support, then the smaller rule, then its text). Mining
takes time with the combinations of classes, not of tokens; many classes that nearly always meet stay costly.

Null urls and urls without `://` have an empty host and path, no tokens, and get `allow`. Repeated rows
get equal results. Without labelled urls no rule is learned. Extra columns pass through `judge_given`.
"""
from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from docsift.llm.common import table

LABEL = "label="
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """pages with host (A-Z lower-cased) and path of the url."""
    url = F.coalesce(F.col("url"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumn("host", F.translate(F.regexp_extract(url, pattern, 1), *_AZ)).withColumn(
        "path", F.regexp_extract(url, pattern, 2)
    )


def judge_given(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages (with host and path) with the longest fitting given rule and its verdict, else nulls.

    rules: (rule, verdict); a rule `example.net/en/` fits the host, its subdomains, and paths that start
    with /en/. All given rules are held in the plan, looked up by the host's suffixes.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, _, path = rule.partition("/")
        by_host.setdefault(host, []).append(("/" + path, rule, verdict))
    held = F.create_map(
        *[
            x
            for host, of in by_host.items()
            for x in (F.lit(host), F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r"), F.lit(v).alias("v")) for p, r, v in of]))
        ]
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = F.flatten(F.transform(F.filter(suffixes, lambda s: F.map_contains_key(held, s)), lambda s: F.element_at(held, s)))
    fits = F.filter(near, lambda x: F.col("path").startswith(x["p"]))
    best = F.array_max(F.transform(fits, lambda x: F.struct(F.length(x["r"]).alias("n"), x["r"].alias("r"), x["v"].alias("v"))))
    return pages.withColumn("_best", best).withColumn("rule", F.col("_best.r")).withColumn("verdict", F.col("_best.v")).drop("_best")


def url_tokens() -> Column:
    """Distinct tokens of a row with url, host and path; a token says which part it comes from."""
    part = lambda text, by, mark: F.transform(F.split(text, by), lambda t: F.concat(F.lit(mark), t))
    query_names = F.transform(
        F.regexp_extract_all(F.coalesce("url", F.lit("")), F.lit(r"[?&]([^=&#?]+)"), F.lit(1)), lambda t: F.concat(F.lit("q:"), t)
    )
    found = F.concat(part("host", r"\.", "h:"), part("path", r"[/.]", "p:"), query_names)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 2))


def _classes(held: DataFrame, least: int) -> DataFrame:
    """(item, members) from (id, token): tokens of the same ids together; item is the smallest of them.

    The same ids means the same number, sum and xor of two 64-bit hashes of the ids. Tokens in fewer than
    `least` rows are left out, so there are at most (tokens of a url) / (minimum support) of them, and a class
    is no larger than a url of each of its rows.
    """
    mark = [F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("mixed")]
    each = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *mark).where(F.col("n") >= least)
    members = F.sort_array(F.collect_list("token"))
    return each.groupBy("n", "total", "mixed").agg(members.alias("members")).select(F.col("members")[0].alias("item"), "members")


def learn(labelled: DataFrame, min_count: int = 5, min_support: float = 0.001, min_confidence: float = 0.8) -> DataFrame:
    """(tokens, classes, index, verdict, confidence, support) from rows (tokens array, label string).

    tokens holds an item for each class of the rule, classes the tokens that may stand for it, index the
    tokens of the rarest class.
    """
    spark = labelled.sparkSession
    schema = "tokens array<string>, classes array<array<string>>, index array<string>, verdict string, confidence double, support double"
    rows = labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("id"), "tokens", "label")
    rows = table(spark, rows, "labelled")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    support = min(1.0, max(min_support, min_count / n))
    held = rows.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    classes = table(spark, _classes(held, math.floor(support * n)), "token-classes")
    items = held.join(classes, F.col("token") == F.col("item")).groupBy("id").agg(F.collect_list("item").alias("items"))
    marked = F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.concat(F.lit(LABEL), "label"))
    rows = table(spark, rows.join(items, "id", "left").select(marked.alias("items")), "item-sets")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(rows)
    mined = (
        model.associationRules.where(F.col("consequent")[0].startswith(LABEL))
        .where(~F.exists("antecedent", lambda t: t.startswith(LABEL)))
        .select(
            F.monotonically_increasing_id().alias("id"),
            F.array_sort("antecedent").alias("tokens"),
            F.substring(F.col("consequent")[0], len(LABEL) + 1, 1 << 20).alias("verdict"),
            "confidence",
            "support",
        )
    )
    singles = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("t"), "freq")
    mined = table(spark, mined, "mined")
    by_class = (
        mined.select("id", F.explode("tokens").alias("t"))
        .join(singles, "t")
        .join(classes.withColumnRenamed("item", "t"), "t")
        .groupBy("id")
        .agg(F.min(F.struct("freq", "t", "members")).alias("rarest"), F.collect_list("members").alias("classes"))
        .select("id", "classes", F.col("rarest.t").alias("index"), F.col("rarest.members").alias("index_members"))
    )
    rules = table(spark, mined.join(by_class, "id"), "rules")
    # a more general rule of the same label with at least the same confidence makes a rule redundant
    general = rules.select("index", F.col("id").alias("g"), F.col("tokens").alias("g_tokens"), F.col("verdict").alias("g_verdict"), F.col("confidence").alias("g_conf"))
    redundant = (
        rules.select("id", "tokens", "verdict", "confidence", F.explode("tokens").alias("index"))
        .join(general, "index")
        .where((F.size("g_tokens") < F.size("tokens")) & (F.col("g_verdict") == F.col("verdict")) & (F.col("g_conf") >= F.col("confidence")))
        .where(F.size(F.array_except("g_tokens", "tokens")) == 0)
        .select("id")
    )
    kept = rules.join(redundant, "id", "left_anti")
    return kept.select("tokens", "classes", F.col("index_members").alias("index"), "verdict", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, learned, because, confidence) of the distinct urls (url, tokens) that a learned rule fits.

    because names the largest token of the url in each class of the rule.
    """
    shown = F.array_join(F.array_sort(F.transform("classes", lambda c: F.array_max(F.array_intersect(c, "tokens")))), " ")
    best = F.max(F.struct("confidence", "support", (-F.size("classes")).alias("n"), "because", "verdict"))
    return (
        urls.select("url", "tokens", F.explode("tokens").alias("index"))
        .join(rules.drop("tokens").withColumn("index", F.explode("index")), "index")
        .where(F.forall("classes", lambda c: F.arrays_overlap(c, "tokens")))
        .withColumn("because", shown)
        .groupBy("url")
        .agg(best.alias("b"))
        .select("url", F.col("b.verdict").alias("learned"), "b.because", "b.confidence")
    )


def judge(pages: DataFrame, given: list[tuple[str, str]], labels: DataFrame | None = None, **limits) -> DataFrame:
    """page_id, url, host, path, rule, verdict, because: given rules first, learned rules for the rest.

    The labelled urls are those a given rule judges, and `labels` (url, label) if there are any.
    """
    spark = pages.sparkSession
    parts = judge_given(with_parts(pages.select("page_id", "url")), given).withColumn("tokens", url_tokens())
    parts = table(spark, parts, "urls")
    labelled = parts.where(F.col("verdict").isNotNull()).select("tokens", F.col("verdict").alias("label"))
    if labels is not None:
        own = with_parts(labels.select("url", "label")).select(url_tokens().alias("tokens"), "label")
        labelled = labelled.unionByName(own)
    rules = table(spark, learn(labelled, **limits), "url-rules")
    open_urls = parts.where(F.col("verdict").isNull() & (F.size("tokens") > 0)).select("url", "tokens").distinct()
    learned = match(open_urls, rules)
    return parts.join(learned, "url", "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("verdict", "learned", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("because")).alias("because"),
    )
