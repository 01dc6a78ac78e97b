"""The corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; run() applies them to
documents in turn, each stage's rows written as Parquet and read back as the next one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.llm import common as C
from fusewright.llm import decontaminate, jaccard, language, repeats, tokens
from fusewright.llm import rows as K


def _aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that a stage doesn't use under names that no operator has, and the columns that give docs' own back."""
    names = {c: c if c in used else f"own{i}__" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (3): documents that it rejects go, and so does a text without letters. lang becomes the prediction where it was null."""
    apart, own = _aside(docs, "doc_id", "text", "lang")
    kept = language.identify(apart, language.fit(apart)).where("not rejected")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (5): of each group of linked documents (five-word shingles, 0.8) the one with the least doc_id stays.

    Rows without doc_id, and rows that share one but not the text, are documents of their own that yield to those
    with an id of their own; of them the one with the least hash stays. Of repeated rows one stays.
    """
    # Ids of one's own are told by keyed(); other documents get a hash, beyond all of these but in 2 ** -62 of cases.
    hashed = F.xxhash64("key_", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    each = K.keyed(docs, 1).withColumn("id_", F.when(F.col("key_").isNull() | (F.col("tie_") != 0), hashed).otherwise(F.col("key_")))
    first = jaccard.jaccard_components(each.select(F.col("id_").alias("doc_id"), "text"), words=5, percent=80).where("doc_id = component_id").select(F.col("doc_id").alias("id_")).distinct()
    kept = each.drop("text").join(first, "id_", "left_semi").dropDuplicates(["id_"])
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (4): words of 20-word windows that also start earlier go; a document of which nothing stays goes."""
    apart, own = _aside(docs, "doc_id", "text", "n_chars")
    found = repeats.substring_dedup(apart, window=20, layout=True)
    changed = found.where("n_words > 0 and n_removed < n_words").withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long"))
    return changed.select(*own)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (2): documents with a benchmark window go."""
    apart, own = _aside(docs, "doc_id", "text")
    found = decontaminate.phrase_matches(apart, C.table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (10): the pieces of what is kept, with their places in sequences of 4096."""
    return tokens.pack(docs.select("doc_id", "text"), size=4096)


#: Tables that the stage before wrote for itself; its rows are written by the time that the next one is called.
_BEFORE: list[str] = []


def _releasing(stage):
    """The stage, after it has deleted what the stage before it wrote for itself, and nothing else."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.release(spark, _BEFORE)
        C.small_batches(spark)  # stays set: the stage's rows are written by whoever called it
        with C.scope() as own:
            out = stage(spark, docs, sf_dir)
        _BEFORE.extend(own)
        return out

    return run_stage


def _last(stage):
    """As _releasing, but the stage's own tables stay: its rows are the result, which may be read again."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.release(spark, _BEFORE)
        C.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _releasing(identify_language)),
    ("near_duplicates", _releasing(drop_near_duplicates)),
    ("substring_dedup", _releasing(remove_repeated_passages)),
    ("decontamination", _releasing(drop_contaminated)),
    ("packing", _last(pack_sequences)),
]

#: The tokenizer's ids can't be expressed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
