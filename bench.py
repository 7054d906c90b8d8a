"""Times the headline queries; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

import catalog
from docsift.session import local_session

HEADLINE = [
    "doc_term", "ldac_lines", "sentences_rule", "sent_bow", "similar_sents", "variety_sents", "nb_classify",
    "search_docs", "lda_estep1", "topic_word_counts", "fit_topics", "em_step", "vb_mixture", "gauss_moments",
    "merge_moves", "hmm_smooth", "node_pairs", "graph_communities", "stream_word_counts",
]


def main(names):
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = local_session("bench", cpus=cpus, shuffle=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of the first query
    times = {}
    for name in names or HEADLINE:
        t = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main(sys.argv[1:])
