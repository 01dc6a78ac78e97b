"""The vector index against brute force."""

from pyspark.sql import functions as F

from fusewright.situations import tracking


def test_index_recall(spark):
    """Every vector whose id is divisible by 20 as a query: the ten nearest by the index against those by all vectors."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.cache()
    index = tracking.ivf_index(rows)
    assert index[1].count() == rows.count()
    # All queries at once: cells of each, then the nearest within them, beside the nearest of all.
    import numpy as np

    data = {r.id: (r.cell, np.array(r.vector)) for r in index[1].collect()}
    ids = np.array(sorted(data))
    x = np.stack([data[i][1] / max(np.linalg.norm(data[i][1]), 1e-12) for i in ids])
    cells = np.array([data[i][0] for i in ids])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        like = x @ x[q]
        best = {*ids[np.lexsort((ids, -like.round(9)))[:10]].tolist()}
        probed = np.isin(cells, np.argsort(-(index[0] @ x[q]))[:11])
        found = {*ids[probed][np.lexsort((ids[probed], -like[probed].round(9)))[:10]].tolist()}
        hit, total = hit + len(best & found), total + len(best)
    assert hit >= 0.9 * total
    one = data[20][1].tolist()
    got = [r.id for r in tracking.ivf_search(index, one, 5).collect()]
    assert got[0] == 20 or abs(float(x[np.flatnonzero(ids == got[0])[0]] @ x[np.flatnonzero(ids == 20)[0]]) - 1) < 1e-9
    assert len(got) == 5
