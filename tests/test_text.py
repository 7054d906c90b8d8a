import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import bow, sentences as S
from docsift.sources import archive


def one(spark, expr, text):
    return spark.createDataFrame([(0, text)], "doc_id long, text string").select(expr(F.col("text")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("He said, \"Go.\"", 'He said , " Go. "'),
        ("It cost $5 or 50%.", "It cost $ 5 or 50 %."),
        ("I cannot (really) don't", "I can not ( really ) do n't"),
        ("wait...what", "wait ... what"),
        ("No.6 is AT&T's", "No. 6 is AT&T 's"),
        ("a--b", "a -- b"),
    ],
)
def test_treebank(spark, text, want):
    assert one(spark, T.treebank, text).split() == want.split()


def test_tokens_keep_case_and_apostrophes(spark):
    assert one(spark, T.tokens, "Don't stop, O'Neil 42 café") == ["Don't", "stop", "O'Neil", "caf"]
    assert one(spark, T.tokens, None) == []


def frags(spark, text):
    return [(f["orig"], f["ends_seg"]) for f in one(spark, T.fragments, text)]


def test_fragments_cut_at_candidates_and_blank_lines(spark):
    assert frags(spark, "Mr. A went. Then\n\nnew part") == [("Mr.", False), ("A went.", False), ("Then", True), ("new part", True)]
    # a blank line right after a boundary ends the segment there
    assert frags(spark, 'One.")\n \nTwo') == [('One.")', True), ("Two", True)]
    # before the first candidate a blank line does not cut
    assert frags(spark, "head\n\nline one. two") == [("head line one.", False), ("two", True)]
    assert frags(spark, "") == []
    assert frags(spark, "end.<S> next") == [("end.<S>", False), ("next", True)]


def test_labels_and_next(spark):
    df = spark.createDataFrame([(7, "a b.<S> C d. e")], "doc_id long, text string")
    rows = S.fragments(df).orderBy("pos").collect()
    assert [(r.tokenized, r.label, r.next_tokenized) for r in rows] == [("a b.", 1, "C d."), ("C d.", 0, "e"), ("e", 0, None)]


def test_sentences_follow_predictions(spark):
    df = spark.createDataFrame([(7, "a b. C d. e")], "doc_id long, text string")
    f = S.fragments(df)
    got = S.segment(f, F.col("pos") == 1).orderBy("sent_no").collect()
    assert [r.sentence for r in got] == ["a b. C d.", "e"]


def test_highlight_absent_and_present(spark):
    df = spark.createDataFrame([("abc def", "def"), ("abc", "zz")], "t string, s string")
    got = df.select(S.highlight(F.col("t"), F.col("s")).alias("h")).collect()
    assert (got[0].h.position, got[0].h.prefix, got[0].h.hit, got[0].h.suffix) == (5, "abc ", "def", "")
    assert (got[1].h.position, got[1].h.prefix) == (0, "abc")


def test_triples_of_a_hot_document(spark):
    """One document holding most tokens gives the right counts."""
    rows = [(0, "apple pear " * 5000)] + [(i, "apple plum") for i in range(1, 20)]
    vocab, triples = bow.corpus(spark.createDataFrame(rows, "doc_id long, text string"), max_share=1.0)
    words = {r.word: r.word_id for r in vocab.collect()}
    assert set(words) == {"apple", "plum"}
    got = {(r.doc_id, r.word_id): r.cnt for r in triples.collect()}
    assert got[(0, words["apple"])] == 5000 and got[(3, words["plum"])] == 1


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "first")
        z.writestr("y/one.txt", "second")
        z.writestr("z.doc", "no")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("d/two.pdf")
        info.size = 4
        t.addfile(info, io.BytesIO(b"%PDF"))
    (tmp_path / "c.txt").write_text("plain")
    got = archive.read_archives(spark, str(tmp_path))
    assert sorted((r.member, bytes(r.content)) for r in got.collect()) == [
        ("c.txt", b"plain"), ("d/two.pdf", b"%PDF"), ("x/one.txt", b"first"), ("y/one.txt", b"second"),
    ]
    docs = archive.documents(got).orderBy("doc_id").collect()
    assert [d.doc_id for d in docs] == [0, 1, 2] and {d.text for d in docs} == {"first", "second", "plain"}


def test_sentence_index_joins_lines(spark):
    """A sentence wrapped over a line, or over a blank line, stays whole in the index."""
    from docsift.operators import bow, sentences as S

    docs = spark.createDataFrame([(1, "Red apples\ngrow here. Blue\n\nplums fall. "), (2, "Red plums\n \nfall")], "doc_id long, text string")
    vocab = bow.corpus(docs, min_doc=1, max_share=1.0)[0]
    sents, terms = S.sentence_index(S.rule_sentences(S.unwrapped(docs)), vocab)
    got = sorted((r.doc_id, r.sent_ix, r.sentence) for r in sents.collect())
    assert got == [(1, 0, "Red apples grow here."), (1, 1, "Blue plums fall."), (2, 0, "Red plums fall")]
    assert terms.where("doc_id = 2").count() == 3
