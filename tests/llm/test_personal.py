"""Personal data: base spans against the plain patterns, learned spans, odd rows."""
import hashlib
import re

from hypothesis import given, settings, strategies as st

from docsift.llm.personal import KINDS, base_spans, candidate_tokens, emails, find_personal
from docsift.llm.q_personal import op5_personal

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, *m.span()) for k, name in enumerate(KINDS) for m in re.finditer(PLAIN[name], text) if valid(name, m.group())]


@given(st.text(alphabet="a.@-+() 0129%\né", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_are_the_plain_ones(text):
    assert base_spans(text) == plain_spans(text)


def test_query_against_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_personal(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in range(4))
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_contexts_discover_and_spare(spark):
    rows = [(i, f"please call me at +1 555 010 {1000 + i} today") for i in range(30)]
    rows += [(i, f"mail goes to user{i}@mail.example.com now") for i in range(100, 130)]
    rows += [(500, "please call me at 555-0199 today"), (501, "room 4711 is closed"), (502, "built in 1999 by hand")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in find_personal(docs).collect()}
    assert [(s.kind, rows[60][1][s.start : s.end]) for s in got[500].spans] == [(3, "555-0199")]
    assert not got[500].base and not got[501].spans and not got[502].spans
    assert all(got[i].spans == got[i].base and len(got[i].base) == 1 for i in range(30))


def test_odd_rows_and_long_texts(spark):
    long = "9" * 50_000 + " " + "a@" * 20_000 + " 1.2.3.4"
    assert emails("x@y.zz@w.vv") == [(0, 6)]
    assert candidate_tokens("a1 (b2), c", [(0, 2)]) == [(4, 6)]
    rows = [(1, None, 5), (2, "", 6), (3, long, 7), (3, long, 7), (None, "me@x.org", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = find_personal(docs).collect()
    assert sorted(len(r.base) for r in got) == [0, 0, 1, 1, 1]
    assert find_personal(docs.where("false")).count() == 0


def test_later_generations_and_few_seeds(spark):
    rows = [(i, f"please call me at +1 555 010 {1000 + i} today") for i in range(30)]
    rows += [(100 + i, f"please call me at 555-010{i} today") for i in range(6)]
    rows += [(200 + i, f"our fax line is 555-010{i} always") for i in range(6)] + [(300, "our fax line is 555-0777 always")]
    rows += [(400 + i, f"then ring us on +1 555 020 {1000 + i} please") for i in range(5)] + [(410, "then ring us on 555-0888 please")]
    rows += [(500 + i, f"the train number {70 + i} departs") for i in range(9)] + [(510, "the train number 555-0100 departs")]
    got = {r.doc_id: r for r in find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    learned = {k: [(s.kind, texts[k][s.start : s.end]) for s in got[k].spans if s not in got[k].base] for k in texts}
    assert learned[300] == [(3, "555-0777")] and learned[410] == [(3, "555-0888")]
    assert all(learned[k + i] == [(3, f"555-010{i}")] for k in (100, 200) for i in range(6))
    assert not any(learned[500 + i] for i in range(11) if 500 + i in learned)
