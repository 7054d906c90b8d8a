"""Sentence boundary classifiers: corpus statistics, features, Naive Bayes, linear SVM."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docsift.functions import text as T
from docsift.functions.ranking import hash_uniform
from docsift.operators import sentences as S
from docsift.operators.vectors import index_of
from docsift.plans import svm
from docsift.session import checkpointed, written

ALPHA = "^[A-Za-z]+$"
#: Features of few values: lengths up to 10, whole logarithms of counts, yes or no. Those of the first word alone.
FEW = "^(w1length|w1abbr|w2cap|w2lower)_"
FIRST = "^(w1|w1length|w1abbr)_"


def word_stats(frags: DataFrame) -> DataFrame:
    """(word, n_lower, n_plain): lower-case uses (periods removed) and uses without a final period."""
    # counted first: what follows meets each word once, not each of its uses
    words = frags.select(F.explode(F.split("tokenized", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = words.select("w", "n", F.replace("w", F.lit("."), F.lit("")).alias("bare"))
    lower = F.col("w") == F.lower("w")
    plain = ~F.col("w").endswith(".")
    uses = F.filter(
        F.array(
            F.struct(F.col("bare").alias("word"), F.when(lower, F.col("n")).otherwise(0).alias("lo"), F.lit(0).cast("long").alias("pl")),
            F.struct(F.col("w").alias("word"), F.lit(0).cast("long").alias("lo"), F.when(plain, F.col("n")).otherwise(0).alias("pl")),
        ),
        lambda u: (u["lo"] + u["pl"]) > 0,
    )
    rows = words.where(F.col("bare").rlike(ALPHA)).select(F.explode(uses).alias("u"))
    return rows.groupBy(F.col("u.word").alias("word")).agg(
        F.sum("u.lo").alias("n_lower"), F.sum("u.pl").alias("n_plain")
    )


def _log_count(n: Column) -> Column:
    return F.floor(F.log(F.coalesce(n, F.lit(0)) + F.lit(1))).cast("string")


def features(frags: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, pos, label, features): the named features of the boundary after each fragment.

    Takes fragments with `last_word` and `next_word` (see sentences.fragments).
    Both lookups join many fragments to one row per word, which adaptive execution may
    broadcast or split; the fragments keep their text columns out of the shuffle.
    """
    pairs = frags.select(
        "doc_id",
        "pos",
        "label",
        F.regexp_replace("last_word", "^.+?-", "").alias("c1"),
        F.regexp_replace("next_word", "-.+?$", "").alias("c2"),
    ).select(
        "*",
        F.replace("c1", F.lit("."), F.lit("")).rlike(ALPHA).alias("alpha1"),
        F.replace("c2", F.lit("."), F.lit("")).rlike(ALPHA).alias("alpha2"),
        F.expr("substring(c1, 1, length(c1) - 1)").alias("stem"),
        F.lower("c2").alias("low"),
    )
    plain = stats.where(F.col("n_plain") > 0).select(F.col("word").alias("stem"), "n_plain")
    lower = stats.where(F.col("n_lower") > 0).select(F.col("word").alias("low"), "n_lower")
    known = pairs.join(plain, "stem", "left").join(lower, "low", "left").select(
        "*",
        F.when(F.col("c2").rlike("^[A-Z]"), "True").otherwise("False").alias("cap"),
        F.least(F.lit(10), F.length(F.regexp_replace("c1", r"\W", ""))).alias("size"),
    )
    cap, size = F.col("cap"), F.col("size")
    # Feature names.
    listed = F.array(
        F.concat(F.lit("w1_"), "c1"),
        F.concat(F.lit("w2_"), "c2"),
        F.concat(F.lit("both_"), "c1", F.lit("_"), "c2"),
        F.when(F.col("alpha1"), F.concat(F.lit("w1length_"), size.cast("string"))),
        F.when(F.col("alpha1"), F.concat(F.lit("w1abbr_"), _log_count(F.col("n_plain")))),
        F.when(F.col("alpha2"), F.concat(F.lit("w2cap_"), cap)),
        F.when(F.col("alpha2"), F.concat(F.lit("w2lower_"), _log_count(F.col("n_lower")))),
        F.when(F.col("alpha2"), F.concat(F.lit("w1w2upper_"), "c1", F.lit("_"), cap)),
    )
    return known.select("doc_id", "pos", "label", F.array_compact(listed).alias("features"))


def weak_labels(frags: DataFrame) -> DataFrame:
    """Stand-in labels for unmarked text: a segment end, or a capital letter next."""
    capital = F.coalesce(F.col("next_tokenized").rlike("^[\"'(\\[]*[A-Z]"), F.lit(False))
    return frags.withColumn("label", (F.col("ends_seg") | capital).cast("int"))


def train_naive_bayes(feats: DataFrame, smooth: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Model tables: (feature, p0, p1) and one row (prior0, prior1).

    Each label has one pooled denominator over all features seen under it. The counts are written once, as both
    tables and their readers start from them.
    """
    rows = feats.select("label", F.explode("features").alias("feature"))
    one = (F.col("label") == 1).cast("long")
    counts = written(rows.groupBy("feature").agg(F.sum(1 - one).alias("n0"), F.sum(one).alias("n1")), "features")
    totals = counts.agg(
        (F.sum("n0") + smooth * F.count(F.lit(1))).alias("t0"),
        (F.sum("n1") + smooth * F.count(F.lit(1))).alias("t1"),
    )
    t = totals.select(F.struct("t0", "t1")).scalar()
    model = counts.withColumn("t", t).select(
        "feature",
        ((F.col("n0") + smooth) / F.col("t.t0")).alias("p0"),
        ((F.col("n1") + smooth) / F.col("t.t1")).alias("p1"),
    )
    prior = totals.select(
        (F.col("t0") / (F.col("t0") + F.col("t1"))).alias("prior0"),
        (F.col("t1") / (F.col("t0") + F.col("t1"))).alias("prior1"),
    )
    return model, prior


def classify_naive_bayes(feats: DataFrame, model: DataFrame, prior: DataFrame, labels: bool = False) -> DataFrame:
    """(doc_id, pos, pred): probability of a boundary; features the model lacks are skipped.

    The features of few values are in nearly every row: their weights (about a hundred) are shipped and added up
    where the rows are. Only the others are joined. With `labels` one row (doc_id, pos, label, pred) for each
    fragment with a doc_id: labels travel beside the features, so that fragments need not meet their predictions.
    """
    ratio = model.select("feature", (F.log("p1") - F.log("p0")).alias("w"))
    few = ratio.where(F.col("feature").rlike(FEW)).toArrow()
    rows = _others(feats, few["feature"].combine_chunks(), few["w"].to_numpy()).join(ratio, "feature", "left")
    start = prior.select(4.0 * (F.log("prior1") - F.log("prior0"))).scalar()
    summed = rows.groupBy("doc_id", "pos").agg(
        (F.sum(F.coalesce("w", F.lit(0.0))) + F.first("base", ignorenulls=True)).alias("s"),
        F.count("label").cast("int").alias("n"),
        F.coalesce(F.sum("label"), F.lit(0)).cast("int").alias("n1"),
    )
    preds = summed.select("doc_id", "pos", squash(F.col("s") + start).alias("pred"), "n", "n1")
    if not labels:
        return preds.drop("n", "n1")
    each = F.concat(F.array_repeat(F.lit(1), F.col("n1")), F.array_repeat(F.lit(0), F.col("n") - F.col("n1")))
    return preds.where(F.col("doc_id").isNotNull()).select("doc_id", "pos", F.explode(each).alias("label"), "pred")


def _others(feats: DataFrame, names: pa.Array, weights: np.ndarray) -> DataFrame:
    """(doc_id, pos, base, label, feature): a row for each feature of many values, or one without a feature.

    The first row of a fragment has its label and `base`, the sum of the weights of its features of few values.
    """
    kinds = {f.name: f.dataType.simpleString() for f in feats.schema}
    schema = f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, base double, label {kinds['label']}, feature string"
    weights = np.append(weights, 0.0)

    def run(batches):
        for batch in batches:
            lists = batch.column("features")
            flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
            few = pc.match_substring_regex(flat, FEW).to_numpy(zero_copy_only=False).astype(bool)
            at = pc.index_in(flat, value_set=names).fill_null(len(names)).to_numpy(zero_copy_only=False)
            base = np.bincount(row[few], weights[at[few]], n).astype(float)
            # the others in row order, with one empty place for a row that has none
            kept = np.flatnonzero(~few)
            alone = np.setdiff1d(np.arange(n), row[kept])
            of, place = np.append(row[kept], alone), np.append(kept, np.full(len(alone), -1))
            order = np.argsort(of, kind="stable")
            of, place = of[order], place[order]
            rest = np.append(False, of[1:] == of[:-1]) if len(of) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(of)),
                    batch.column("pos").take(pa.array(of)),
                    pa.array(base[of], mask=rest),
                    batch.column("label").take(pa.array(of, mask=rest)),
                    flat.take(pa.array(place, mask=place < 0)),
                ],
                ["doc_id", "pos", "base", "label", "feature"],
            )

    return feats.select("doc_id", "pos", "label", "features").mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", share: float = 0.2) -> Column:
    """Whether a document is kept from training: whole documents, by the hash of their id."""
    return hash_uniform("heldout", doc_id) < share


def of_first_word(feats: DataFrame) -> DataFrame:
    """Rows with the features of the first word alone: weak labels look at the second, so no feature is the label."""
    return feats.withColumn("features", F.filter("features", lambda f: f.rlike(FIRST)))


def errors(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n, n_wrong) from rows of doc_id, label, pred."""
    wrong = ((F.col("pred") > threshold) != (F.col("label") == 1)).cast("int")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("n_wrong"))


def accuracy(errors: DataFrame) -> float:
    """The share of right predictions; nan without any."""
    n, wrong = errors.agg(F.sum("n"), F.sum("n_wrong")).first()
    return 1.0 - wrong / n if n else float("nan")


def squash(x: Column) -> Column:
    """Logistic function."""
    return 1.0 / (1.0 + F.exp(-x))


def train_svm(feats: DataFrame, c: float = 1.0, max_iter: int = 100, tol: float = 1e-4):
    """(model, index): linear SVM on the features a fragment has; the regulariser follows from C and the rows.

    Every feature has its own column, named by the table `index`. Fragments of the same features are one row, which
    holds how many of either label they are: a feature of a pair of words then is mostly met by a single row.
    """
    index = checkpointed(index_of(feats.select(F.explode("features").alias("feature")), "feature"))
    each = feats.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "pos").agg(
        F.sort_array(F.flatten(F.collect_list(F.array_distinct("features")))).alias("features"), *_by_label()
    )
    groups = each.groupBy("features").agg(*[F.sum(n).alias(n) for n in ("w1", "w0", "other")])
    groups = written(groups.withColumn("row", F.monotonically_increasing_id()), "svm-rows")
    n1, n0 = _both_labels(groups)
    size = groups.agg(F.sum(F.size("features") + 1)).first()[0]
    kept = ["row", "w1", "w0"]
    cells = groups.select(*kept, F.explode("features").alias("feature")).join(index, "feature").select("ix", F.lit(1.0).alias("v"), *kept)
    cells = cells.unionByName(groups.select(F.lit(None).cast("long").alias("ix"), F.lit(1.0).alias("v"), *kept))
    n = n1 + n0
    return svm.fit(cells, index.count(), size, n, n, 1.0 / (c * n), max_iter, tol), index


def _by_label(label: str = "label") -> list[Column]:
    """How many rows have label 1, label 0 and neither."""
    is1, is0 = (F.coalesce(F.col(label) == v, F.lit(False)) for v in (1, 0))
    return [F.count_if(is1).alias("w1"), F.count_if(is0).alias("w0"), F.count_if(~is1 & ~is0).alias("other")]


def _both_labels(counts: DataFrame) -> tuple[int, int]:
    """The sums of w1 and w0; a classifier of two classes is not learnt from other labels, or from label 0 alone."""
    n1, n0, other = (n or 0 for n in counts.agg(F.sum("w1"), F.sum("w0"), F.sum("other")).first())
    if other or not n1:
        raise ValueError(f"labels must be 0 and 1: {n1} rows have label 1, {n0} label 0, {other} another or none")
    return n1, n0


def classify_svm(feats: DataFrame, model: svm.Svm, index: DataFrame) -> DataFrame:
    """(doc_id, pos, pred): margin through the logistic function; features the model lacks are skipped."""
    rows = feats.select("doc_id", "pos", F.explode(F.array_distinct("features")).alias("feature"))
    margin = _margins(rows, index.join(model.weights, "ix"), "feature", feats.select("doc_id", "pos"), model)
    return margin.select("doc_id", "pos", squash(F.col("margin")).alias("pred"))


def _margins(cells: DataFrame, weights: DataFrame, term: str, rows: DataFrame, model: svm.Svm) -> DataFrame:
    """(keys of rows, margin) from cells(keys, term, v or none) and weights(term, w), also for rows without cells."""
    value = F.col("w") * F.col("v") if "v" in cells.columns else F.col("w")
    met = cells.join(weights.select(term, "w"), term).select(*rows.columns, value.alias("s"))
    both = met.unionByName(rows.select("*", F.lit(0.0).alias("s")))
    return both.groupBy(*rows.columns).agg((F.sum("s") + model.intercept).alias("margin"))


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, predicted, n)."""
    return rows.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def model_sentences(frags: DataFrame, preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Sentences cut where the prediction passes the threshold or a segment ends.

    Fragments and predictions are dealt by document, and a document's stay together from here on: texts travel once.
    """
    none = F.lit(None)
    texts = frags.select("doc_id", "pos", "orig", "ends_seg", none.cast("double").alias("pred"))
    cuts = preds.where(F.col("doc_id").isNotNull()).select("doc_id", "pos", none.cast("string").alias("orig"), none.cast("boolean").alias("ends_seg"), "pred")
    both = texts.unionByName(cuts).repartition("doc_id")
    joined = both.withColumn("pred", F.max("pred").over(W.partitionBy("doc_id", "pos"))).where(F.col("orig").isNotNull())
    return S.segment(joined, F.col("pred") > threshold)


def train_fact_classifier(rows: DataFrame, weight: float = 10.0, share: float = 0.8, max_iter: int = 100, tol: float = 1e-4):
    """Linear SVM on bags of words with a heavier positive class; every word has its own column.

    Columns: id, words (array), label 0/1. The first `share` of rows in id order train, the rest
    are scored: returns (model, scored test rows with label and predicted).
    """
    from docsift.functions.ranking import order_rank

    rows = checkpointed(rows.select("id", "words", F.col("label").cast("double").alias("label")))
    cut = int(rows.count() * share)
    ranks = checkpointed(order_rank(rows.select("id", "label"), ["id"]).where(F.col("id").isNotNull()))
    counts = rows.select("id", F.explode("words").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("v"))
    counts = written(counts.where(F.col("id").isNotNull()), "fact-counts")
    index = checkpointed(index_of(counts, "word"))
    train = ranks.where(F.col("rank") < cut)
    n1, n0 = _both_labels(train.groupBy().agg(*_by_label()))
    kept = ["row", "w1", "w0"]
    given = train.select(
        "id", F.col("rank").alias("row"), F.when(F.col("label") == 1, weight).otherwise(0.0).alias("w1"), F.when(F.col("label") == 1, 0.0).otherwise(1.0).alias("w0")
    )
    cells = counts.join(index, "word").join(given, "id").select("ix", F.col("v").cast("double").alias("v"), *kept)
    cells = cells.unionByName(given.select(F.lit(None).cast("long").alias("ix"), F.lit(1.0).alias("v"), *kept))
    total, squares = weight * n1 + n0, weight * weight * n1 + n0
    model = svm.fit(cells, index.count(), counts.count() + n1 + n0, total, squares, 1.0 / max(cut, 1), max_iter, tol)
    test = ranks.where(F.col("rank") >= cut)
    keys = ["id", "rank", "label"]
    margin = _margins(counts.join(test, "id"), index.join(model.weights, "ix"), "word", test.select(*keys), model)
    return model, margin.select("id", "label", (F.col("margin") > 0).cast("double").alias("predicted"))
