"""Operators on tokens and vectors whose array functions differ by engine: DataFrame form and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    return df.select(key, words.alias("words"))


def _all_words(text: str):
    """Different words of any length and script, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted-index join: pairs of benchmark items that share at least three tokens of five letters or more."""
    t = _tokens(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text").select("item_id", F.explode("words").alias("w")).where(F.length("w") >= 5)
    b = t.select(F.col("item_id").alias("b_id"), "w")
    return t.select(F.col("item_id").alias("a_id"), "w").join(b, "w").where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count("*").alias("shared")).where("shared >= 3")


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted-index join: every pair of benchmark items that share a word, of any length and script, and how many. Hot words are salted."""
    t = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.explode(_all_words("text")).alias("w"))
    a = t.select(F.col("item_id").alias("a_id"), "w", F.pmod(F.xxhash64("item_id"), F.lit(8)).alias("salt"))
    b = t.select(F.col("item_id").alias("b_id"), "w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("salt"))
    return a.join(b, ["w", "salt"]).where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count("*").alias("shared"))


def title_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-set Jaccard of benchmark items that share a token, from counts of shared tokens."""
    t = _tokens(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text").withColumn("n", F.size("words"))
    e = t.select("item_id", "n", F.explode("words").alias("w"))
    a, b = e.select(F.col("item_id").alias("a_id"), F.col("n").alias("na"), "w"), e.select(F.col("item_id").alias("b_id"), F.col("n").alias("nb"), "w")
    both = a.join(b, "w").where("a_id < b_id").groupBy("a_id", "b_id", "na", "nb").agg(F.count("*").alias("c"))
    return both.select("a_id", "b_id", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("jaccard")).where("jaccard >= 0.1")


def idf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").select(F.explode("words").alias("term"))
    c = t.groupBy("term").agg(F.count("*").alias("freq")).where("freq >= 20")
    total = c.agg(F.sum("freq").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("term", F.round(F.log(F.greatest("total", F.lit(100)) / (1 + F.col("freq"))), 6).alias("idf"))


def idf_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term's score after all documents in order of doc_id: ln(max(total, 100) / (1 + freq)).

    A document counts .9999^steps, steps being the documents after it; total sums all terms. The periodic
    removal of negligible terms is left out. Ranks are taken in blocks of ids, and the blocks' sums added.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(_all_words("text").alias("words"), "doc_id", F.floor(F.col("doc_id") / 1024).alias("block"))
    after = d.groupBy("block").agg(F.count("*").alias("n")).select("block", (F.sum("n").over(W.orderBy(F.desc("block"))) - F.col("n")).alias("later"))
    age = F.col("later") + F.row_number().over(W.partitionBy("block").orderBy(F.desc("doc_id"))) - 1
    weight = F.pow(F.lit(0.9999), age)
    c = d.join(F.broadcast(after), "block").select("words", weight.alias("weight")).select(F.explode("words").alias("term"), "weight").groupBy("term").agg(F.sum("weight").alias("freq"))
    total = c.agg(F.sum("freq").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("term", F.round(F.log(F.greatest("total", F.lit(100.0)) / (1 + F.col("freq"))), 6).alias("idf"))


def search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all query words, by how often they have them; the 20 best."""
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", words.alias("w"))
    tf = F.size(F.filter("w", lambda x: x.isin("the", "and")))
    return d.where(F.array_contains("w", "the") & F.array_contains("w", "and")).select("doc_id", tf.cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similar_events_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors to one, by cosine; the target is one row."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    target = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))
    cos = _dot("embedding", "q") / (F.sqrt(_dot("embedding", "embedding")) * F.sqrt(_dot("q", "q")))
    return e.where("vec_id <> 0").crossJoin(target).select("vec_id", F.round(cos, 5).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(20)


def pairwise_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine over a label's pairs in closed form: (|sum of unit vectors|^2 - n) / (n (n - 1)); no pair is formed."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    unit = e.select("label", "vec_id", F.sqrt(_dot("embedding", "embedding")).alias("norm"), F.posexplode("embedding").alias("i", "x"))
    dims = unit.groupBy("label", "i").agg(F.sum(F.col("x").cast("double") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    return dims.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n")).where("n >= 4").select("label", F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 5).alias("coherence"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("x")).select("label", F.col("i").cast("long").alias("i"), "x")


def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of a part's name's 3-grams and its type's; 0 below three characters."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    p = _part(spark, sf_dir).select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    p = p.select("p_partkey", "a", "b", grams(F.col("a")).alias("x"), grams(F.col("b")).alias("y"))
    like = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return p.select("p_partkey", F.round(F.when((F.length("a") < 3) | (F.length("b") < 3), 0.0).otherwise(like), 6).alias("similarity"))


def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of 24 buckets of 15 minutes, empty ones as zero."""
    from fusewright.plans.dialect import run

    n = run(spark, sf_dir, "WITH EV SELECT CAST(floor((t - (AS_OF - 21600)) / 900) AS BIGINT) AS slot, count(*) AS n FROM ev WHERE t >= AS_OF - 21600 AND t < AS_OF GROUP BY CAST(floor((t - (AS_OF - 21600)) / 900) AS BIGINT)")
    return spark.range(24).withColumnRenamed("id", "slot").join(n, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of a conversation: its first turn's first six words; and how many turns follow."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    by = W.partitionBy("conv_id")
    r = c.select("conv_id", "turn", "text", F.row_number().over(by.orderBy("turn")).alias("k"), F.count("*").over(by).alias("n"))
    return r.where("k = 1").select("conv_id", F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("title"), F.col("n").alias("turns"))


_ALL = r"list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))"
_T = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 2))"
SQL = {
    "token_candidates": f"WITH t AS (SELECT item_id, unnest({_T}) AS w FROM benchmark), u AS (SELECT * FROM t WHERE length(w) >= 5) SELECT a.item_id AS a_id, b.item_id AS b_id, count(*) AS shared FROM u a JOIN u b ON a.w = b.w AND a.item_id < b.item_id GROUP BY ALL HAVING count(*) >= 3",
    "token_pairs": f"WITH t AS (SELECT item_id, unnest({_ALL}) AS w FROM benchmark) SELECT a.item_id AS a_id, b.item_id AS b_id, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.item_id < b.item_id GROUP BY ALL",
    "title_jaccard_pairs": f"WITH t AS (SELECT item_id, {_T} AS ws FROM benchmark) SELECT a.item_id AS a_id, b.item_id AS b_id, round(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE round(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))), 6) >= 0.1",
    "idf_scores": f"WITH t AS (SELECT unnest({_T}) AS term FROM documents), c AS (SELECT term, count(*) AS freq FROM t GROUP BY term HAVING count(*) >= 20) SELECT term, round(ln(greatest((SELECT sum(freq) FROM c), 100) / (1 + freq)), 6) AS idf FROM c",
    "idf_streaming": f"WITH p AS (SELECT text, count(*) OVER () - row_number() OVER (ORDER BY doc_id) AS age FROM documents), t AS (SELECT unnest({_ALL}) AS term, power(CAST(0.9999 AS DOUBLE), age) AS weight FROM p), c AS (SELECT term, sum(weight) AS freq FROM t GROUP BY term) SELECT term, round(ln(greatest((SELECT sum(freq) FROM c), 100) / (1 + freq)), 6) AS idf FROM c",
    "search_lexical": "WITH d AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM documents) SELECT doc_id, CAST(len(list_filter(w, lambda x: x IN ('the', 'and'))) AS BIGINT) AS score FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'and') ORDER BY score DESC, doc_id LIMIT 20",
    "similar_events_topk": "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 20",
    "pairwise_coherence": "SELECT a.label, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 5) AS coherence FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label HAVING count(DISTINCT a.vec_id) >= 4",
    "label_centroids": "WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) SELECT label, CAST(i AS BIGINT) AS i, round(avg(CAST(x AS DOUBLE)), 5) AS x FROM e GROUP BY label, i",
    "trigram_similarity": "WITH p AS (SELECT p_partkey, list_distinct(list_transform(range(1, greatest(length(p_name) - 2, 1) + 1), lambda i: substr(lower(p_name), i, 3))) AS x, list_distinct(list_transform(range(1, greatest(length(p_type) - 2, 1) + 1), lambda i: substr(lower(p_type), i, 3))) AS y, length(p_name) < 3 OR length(p_type) < 3 AS short FROM part) SELECT p_partkey, CASE WHEN short THEN 0e0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) END AS similarity FROM p",
    "conversation_turns": "WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS title, n AS turns FROM r WHERE k = 1",
}
_SPARK_LINE = "WITH EV, n AS (SELECT CAST(floor((t - (AS_OF - 21600)) / 900) AS BIGINT) AS slot, count(*) AS n FROM ev WHERE t >= AS_OF - 21600 AND t < AS_OF GROUP BY ALL) SELECT s.range AS slot, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(24) s LEFT JOIN n ON s.range = n.slot"
FRAMES = {f.__name__: f for f in (token_candidates, token_pairs, title_jaccard_pairs, idf_scores, idf_streaming, search_lexical, similar_events_topk, pairwise_coherence, label_centroids, trigram_similarity, sparkline, conversation_turns)}


def oracle() -> dict[str, str]:
    from fusewright.plans.dialect import render

    return SQL | {"sparkline": render(_SPARK_LINE)}
