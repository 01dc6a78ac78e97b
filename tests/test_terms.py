"""Term scores and shared words lose no term."""

import math

import pytest

from fusewright import catalogue


def test_idf_of_rare_terms_decays(spark, tmp_path):
    texts = ["Éclair of x", None, "of x", "of " + " ".join(f"t{i}" for i in range(150))]
    spark.createDataFrame([(k * 1500, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.term: r.idf for r in catalogue.queries()["idf_streaming"](spark, str(tmp_path)).collect()}
    freq: dict = {}
    for t in texts:  # as the reference observes: all decay, then the document's terms count one
        freq = {k: v * 0.9999 for k, v in freq.items()}
        for w in {*(t or "").lower().split()}:
            freq[w] = freq.get(w, 0) + 1
    assert got == pytest.approx({k: math.log(max(sum(freq.values()), 100) / (1 + v)) for k, v in freq.items()}, abs=1e-6)


def test_pairs_of_one_short_word(spark, tmp_path):
    spark.createDataFrame([(1, "Été a"), (2, "été b"), (3, "c, A!"), (4, None), (5, "t")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.a_id, r.b_id, r.shared) for r in catalogue.queries()["token_pairs"](spark, str(tmp_path)).collect())
    assert got == [(1, 2, 1), (1, 3, 1)]
