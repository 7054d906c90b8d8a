"""Plan shapes that must hold at any size."""
import pytest

import catalog

SF = "/root/testdata/sf0.001"
QUERIES, _ = catalog.load()
LAZY = [
    "tokens", "word_counts", "vocab", "doc_term", "doc_length", "unigram", "ldac_lines", "minibatches", "sample_docs",
    "weighted_draw", "fragments", "sentences_rule", "sbd_word_stats", "search_docs", "similar_sents", "variety_sents",
    "nb_classify", "node_pairs", "edge_scores", "concat_bow",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["word_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_counts_per_document_need_no_second_shuffle(spark):
    """Rows already spread by document are grouped by (document, word) where they are."""
    plan = QUERIES["word_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """A table with more files than cores, which needs no repartition."""
    path = str(tmp_path_factory.mktemp("many") / "documents.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(12).write.parquet(path)
    return path


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_corpus_reads_texts_once(spark, many_files):
    """The counts are written once; vocabulary and triples read them, not the texts."""
    from docsift.operators import bow
    from docsift.sources.tables import parquet_docs

    for df in (bow.corpus(parquet_docs(spark, many_files))[1], bow.ldac_lines(bow.corpus(parquet_docs(spark, many_files))[1])):
        plan = final_plan(df)
        assert "regexp_extract_all" not in plan and "text:string" not in plan


def test_sample_ranks_keys_only(spark, many_files):
    from docsift.operators import sampling

    plan = final_plan(sampling.sample(spark.read.parquet(many_files).select("doc_id", "text"), "doc_id", 10, 1))
    assert plan.split("== Initial Plan ==")[0].count("struct<doc_id:bigint,text:string>") == 1
