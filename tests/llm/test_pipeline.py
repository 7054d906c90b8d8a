"""The pipeline's stages against the operators' brute force; url rules; entry without the package."""
import itertools
import random
import subprocess
import sys

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from docsift.llm.q_urlrules import RULES, op2_urlrules
from docsift.llm.urlrules import judge, judge_given, learn, match, url_tokens, with_parts
from test_decontaminate import plain
from test_groups import plain_jaccard

SF = "/root/testdata/sf0.01"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "near_duplicates", "decontamination", "secrets", "packing"]

    kept = steps["language"](spark, docs, SF)
    assert kept.columns == docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    rows = kept.collect()
    assert {r.doc_id for r in rows} >= {k for k, r in before.items() if r.text and len(r.text.split()) > 3}

    near = steps["near_duplicates"](spark, kept, SF)
    classes = plain_jaccard([(r.doc_id, r.text) for r in rows])
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {k for k, c, _ in classes if k == c}

    clean = steps["decontamination"](spark, near, SF)
    hits = plain([(r.doc_id, r.text) for r in near.collect()], items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {k for k, n, h, _ in hits if not (h and 20 * h >= n)}

    blanked = steps["secrets"](spark, clean, SF)
    assert blanked.columns == docs.columns and blanked.count() == clean.count()
    assert blanked.where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
    assert blanked.where("n_chars != length(text)").count() == 0

    packed = steps["packing"](spark, blanked, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in blanked.collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_with_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the same words in a row here", "en", "a", 9), (None, "the text of nobody", "en", None, 1)]
    rows += [(3, "the same words in a row here", "en", "a", 9), (4, "the same words in a row here", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
        stage(spark, docs.where(F.lit(False)), SF).count()
    assert sorted((str(r.doc_id), r.text) for r in now.collect()) == [("3", rows[2][1]), ("None", "the text of nobody")]
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == 2
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_clashing_names_and_null_ids(spark):
    """Columns named as the operators' own keep their values; texts without an id are judged like others."""
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).collect()]
    texts = [f"this is text number {i} with some words of its own {i * i}" for i in range(6)] + [items[0]]
    names = ["score", "lang_pred", "findings", "blanked", "path", "_scan", "class_id", "n_hit"]
    rows = [(None if i % 2 else i, t, "en", "src", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts + texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    got = now.collect()
    assert sorted(r.text for r in got) == sorted(texts[:6])
    given = {(r[0], r[1], *r[5:]) for r in rows}
    assert all((r.doc_id, r.text, *(r[n] for n in names)) in given for r in got)


def test_given_rules(spark):
    cases = [
        ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("x://example.net/de/?q#f", "example.net", "/de/", "net/", "block"),
        ("https://EXAMPLE.com/de/x://y/", "example.com", "/de/x://y/", "example.com/de/", "block"),
        ("https://notexample.com/de/", "notexample.com", "/de/", None, None),
        ("https://b.org/fr/9#x", "b.org", "/fr/9", "org/fr/", "allow"),
        ("https://b.net", "b.net", "", None, None),
        ("b.net/en/", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("http://net/" + "a/" * 20_000, "net", "/" + "a/" * 20_000, "net/", "block"),
    ]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, rule string").drop("rule")
    got = {r.page_id: r for r in judge_given(with_parts(df), RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(cases))] == [c[1:] for c in cases]


def test_mined_rules_against_counting(spark):
    rows = [(["h:bad", "h:com", f"p:{i}"], "block") for i in range(20)] + [(["h:good", "h:com", f"p:{i}"], "allow") for i in range(30)]
    rows += [(["h:bad", "h:com", "p:fine"], "allow")] * 3
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in learn(df).collect()}
    for (tokens, verdict), (confidence, support) in got.items():
        having = [label for own, label in rows if set(tokens) <= set(own)]
        n = having.count(verdict)
        assert abs(confidence - n / len(having)) < 1e-9 and abs(support - n / len(rows)) < 1e-9
        assert confidence >= 0.8 and n >= 5
    assert (("h:bad",), "block") in got and (("h:good",), "allow") in got
    assert (("h:bad", "h:com"), "block") not in got  # no better than the more general rule
    assert learn(df.where(F.lit(False))).count() == 0


def test_learned_rules_judge_the_rest(spark):
    urls = [(i, f"http://casino.a{i}.com/x/{i}") for i in range(40)] + [(100 + i, f"http://news.b{i}.com/y/{i}") for i in range(40)]
    pages = spark.createDataFrame(urls + [(500, None), (501, "nothing"), (0, urls[0][1])], "page_id long, url string")
    labels = spark.createDataFrame([(u, "block" if i < 100 else "allow") for i, u in urls if i % 2], "url string, label string")
    got = [(r.page_id, r.verdict) for r in judge(pages, RULES, labels).collect()]
    assert len(got) == len(urls) + 3
    assert all(v == ("block" if i < 100 else "allow") for i, v in got)
    assert judge(pages.where(F.lit(False)), RULES).count() == 0


def test_many_tokens_that_always_meet_are_one_class(spark):
    deep = "/".join(f"deep{i:02d}" for i in range(40))
    bad = [(f"http://a{i}.com/{deep}/{i}", "block") for i in range(8)]
    good = [(f"http://b{i}.com/x/y/{i}", "allow") for i in range(8)]
    labels = spark.createDataFrame(bad + good, "url string, label string")
    pages = [(1, "http://new.com/deep17/other"), (2, "http://new.com/x/deep"), (3, f"http://c.com/{deep}"), (4, "http://c.com/")]
    got = {r.page_id: (r.verdict, r.because) for r in judge(spark.createDataFrame(pages, "page_id long, url string"), RULES, labels).collect()}
    assert got == {1: ("block", "p:deep17"), 2: ("allow", "p:x"), 3: ("block", "p:deep39"), 4: ("allow", None)}
    rules = learn(with_parts(labels).select(url_tokens().alias("tokens"), "label")).collect()
    assert sorted((r.verdict, len(r.classes), len(r["index"])) for r in rules) == [("allow", 1, 2), ("block", 1, 40)]


def test_classes_lose_no_rule(spark):
    """Verdicts equal those of all rules over single tokens and sets, counted by brute force."""
    rng = random.Random(8)
    names = [["p:ab1", "p:ab2", "p:ab3"], ["p:cd1", "p:cd2"], ["p:ef1"], ["p:gh1"]]  # tokens of a list always meet
    rows = []
    for i in range(120):
        own = [c for c in names if rng.random() < 0.5]
        label = "block" if names[0] in own and names[2] in own or rng.random() < 0.15 else "allow"
        rows.append((sorted(t for c in own for t in c), label))
    rows = [r for r in rows if r[0]]
    least = max(5, 0.001 * len(rows))
    counted = {}
    tokens = sorted({t for own, _ in rows for t in own})
    for k in range(1, len(tokens) + 1):
        for some in itertools.combinations(tokens, k):
            labels = [label for own, label in rows if set(some) <= set(own)]
            for verdict in ("allow", "block"):
                n = labels.count(verdict)
                if n >= least and n / len(labels) >= 0.8:
                    counted[some, verdict] = (n / len(labels), n)
    urls = [tuple(sorted(rng.sample(tokens, rng.randrange(1, 6)))) for _ in range(60)]
    want = {}
    for own in set(urls):
        fits = [(v[0], v[1], key[1]) for key, v in counted.items() if set(key[0]) <= set(own)]
        if fits:
            top = max(f[0] for f in fits)
            want[" ".join(own)] = {f[2] for f in fits if f[0] == top}
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    asked = spark.createDataFrame([(" ".join(u), list(u)) for u in set(urls)], "url string, tokens array<string>")
    got = {r.url: r.learned for r in match(asked, learn(df)).collect()}
    assert got.keys() == want.keys() and all(got[u] in want[u] for u in got)


def test_url_query(spark):
    rows = op2_urlrules(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    given = dict(RULES)
    assert all(r.verdict == given[r.rule] for r in rows if r.rule) and {r.verdict for r in rows} == {"allow", "block"}


def test_entry_works_without_the_package():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('docsift.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 100 and not any(k.startswith('op1') or k == 'pipeline' for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
