"""Entity resolution and text clues on hand-made rows."""

from pyspark.sql import functions as F

from fusewright.operators import clues


def test_resolution_layers(spark):
    known = spark.createDataFrame([(1, "Hezbollah", "Q1"), (2, "Wagner Group", None), (3, "Islamic Revolutionary Guard", "Q3")], "entity long, name string, qid string")
    rows = [(1, " hezbollah ", None), (2, "Hezbollahs", None), (3, "Islamic Revolutionary Guards", None), (4, "Pasdaran", "Q3"), (5, "Unheard", None), (6, None, None), (7, "Wagner", None), (7, "Wagner", None)]
    got = clues.resolve(spark.createDataFrame(rows, "n long, name string, qid string"), known)
    assert sorted((r.n, r.entity or 0, r.layer) for r in got.collect()) == [(1, 1, "exact"), (2, 1, "fuzzy"), (3, 3, "fuzzy"), (4, 3, "qid"), (5, 0, "new"), (6, 0, "new"), (7, 2, "exact"), (7, 2, "exact")]
    assert clues.resolve(spark.createDataFrame([], "n long, name string, qid string"), known).collect() == []


def test_text_clues(spark):
    df = spark.createDataFrame([("<t x='1'>\n<![CDATA[a &amp; b]]></t><t>c</t>", "The Old Bridge guard was KILLED"), ("<t></t>", "killed"), (None, None)], "x string, s string")
    got = df.select(clues.xml_tag(F.col("x"), "t").alias("t"), clues.words_before(F.col("s"), "killed").alias("w"), clues.percent_encoded(F.lit("a b/é~*")).alias("p")).collect()
    assert [(r.t, r.w, r.p) for r in got] == [("a & b", "Bridge guard was", "a%20b%2F%C3%A9~%2A"), (None, None, "a%20b%2F%C3%A9~%2A"), (None, None, "a%20b%2F%C3%A9~%2A")]
