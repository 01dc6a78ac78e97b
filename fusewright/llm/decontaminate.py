"""Operator 2: benchmark passages in documents by a positional inverted index, in DataFrame operations only.

The index holds the postings (term, document, position) of every word of the corpus. It is written once, each
task its own documents' segment, without a shuffle, and serves counts and phrases. The benchmark's
items are cut into windows of consecutive words. A window's terms are ranked by their counts over the whole
corpus; the list of its rarest gives the starts, after subtracting the term's offset, and the lists of the next
rarest must agree on them. What is left is compared word for word, by the hash that names the window. The
proximity form lets words stand up to a few places off and some be others, so it looks up as many rare terms
as leave two that must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a table made of the benchmark up to which it is broadcast; beyond it is shuffled.
BROADCAST_BYTES = 16 << 20


def words_of(text: Column | str) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased; null: none."""
    text = F.col(text) if isinstance(text, str) else text
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """Different windows of the items: window (its words), items (the ids, as strings, that have it)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def bounded(df: DataFrame) -> DataFrame:
    """df, a table that was written, with a broadcast hint where its rows take few bytes."""
    wide = [F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) if t.startswith("array") else F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c, t in df.dtypes]
    size = df.agg(F.sum(sum(wide, F.lit(16 * len(wide))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def index(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term): the corpus's postings, in segments as the documents lie. Rows without doc_id have none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return C.materialize(rows.select("doc_id", F.posexplode(words_of("text")).alias("pos", "term")), "postings")


def ranked_terms(postings: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(window_id, window, items, term, offset, df): each window's words with their counts over the corpus, null where it hasn't the word."""
    windows = C.materialize(windows_of(items, size).withColumn("window_id", F.xxhash64("window")), "windows")
    terms = C.materialize(windows.select(F.explode("window").alias("term")).distinct(), "terms")
    counts = C.materialize(postings.join(bounded(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")), "counts")
    # A common word is in many windows: they stay where they are, and the counts come to them.
    return windows.select("window_id", "window", "items", F.posexplode("window").alias("offset", "term")).join(bounded(counts), "term", "left")


def lookups(postings: DataFrame, items: DataFrame, size: int, rarest: int) -> DataFrame:
    """(window_id, words, items, term, offset, bit, all): for each window that can occur its rarest terms."""
    by = W.partitionBy("window")
    ranked = ranked_terms(postings, items, size).withColumn("absent", F.max(F.col("df").isNull()).over(by)).where("not absent")
    ranked = ranked.withColumn("r", F.row_number().over(by.orderBy("df", "offset"))).where(F.col("r") <= rarest)
    bit = F.expr("shiftleft(1, r)")
    return C.materialize(ranked.select("window_id", F.size("window").alias("words"), "items", "term", "offset", bit.alias("bit"), F.sum(bit).over(by).cast("int").alias("all")), "lookups")


def phrase_candidates(postings: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, start, window_id, words, items): starts on which the lists of a window's rarest terms agree."""
    each = bounded(C.materialize(found.select("term", "offset", "window_id", "words", "bit", "all"), "terms"))
    starts = postings.join(each, "term").select("doc_id", (F.col("pos") - F.col("offset")).alias("start"), "window_id", "words", "bit", "all").where("start >= 0")
    agree = starts.groupBy("doc_id", "start", "window_id", "words", "all").agg(F.bit_or("bit").alias("bits"))
    of = bounded(C.materialize(found.select("window_id", "items").dropDuplicates(["window_id"]), "items"))
    return agree.where(F.col("bits") == F.col("all")).join(of, "window_id").select("doc_id", "start", "window_id", "words", "items")


#: Starts are gathered by stretches of so many words; those near the end of one also count in the next.
STRETCH = 16


def near_lookups(postings: DataFrame, items: DataFrame, size: int, misses: int) -> DataFrame:
    """(window_id, window, items, least, term, offset, agree, r): rarest terms of each window that can be near.

    Of a window's words `least` must be found. A word absent from the corpus is missing for sure; of the
    terms looked up, `agree` must be found whichever others are missing.
    """
    by = W.partitionBy("window")
    may = F.floor(F.lit(misses) * F.size("window") / size).cast("int")
    ranked = ranked_terms(postings, items, size)
    ranked = ranked.withColumn("least", F.size("window") - may).withColumn("spare", may - F.count(F.when(F.col("df").isNull(), 1)).over(by).cast("int")).where("spare >= 0 and df is not null")
    ranked = ranked.withColumn("r", F.row_number().over(by.orderBy("df", "offset"))).where("r <= spare + 2")
    ranked = ranked.withColumn("agree", F.count("*").over(by).cast("int") - F.col("spare"))
    return C.materialize(ranked.select("window_id", "window", "items", "least", "term", "offset", "agree", "r"), "near_lookups")


def near_places(docs: DataFrame, items: DataFrame, slop: int, size: int, misses: int) -> DataFrame:
    """(doc_id, cand_): the stretches of each document in which enough of a window's looked up terms start near each other."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = near_lookups(rows.select("doc_id", F.posexplode(words_of("text")).alias("pos", "term")), items, size, misses)
    # Texts are dealt once by document, so that the many hits are gathered where they arise; from a stored index they would all travel.
    dealt = rows.repartition(4 * C.shuffle_partitions(docs.sparkSession), "doc_id")
    hits = dealt.select("doc_id", F.posexplode(words_of("text")).alias("pos", "term")).join(bounded(found.select("term", "offset", "window_id", "agree", "r")), "term").select("doc_id", (F.col("pos") - F.col("offset")).alias("start"), "window_id", "agree", "r")
    cell = F.floor(F.col("start") / STRETCH).cast("int")
    last = F.floor((F.col("start") + 2 * slop) / STRETCH).cast("int")
    hits = hits.select("doc_id", "window_id", "agree", "start", F.expr("shiftleft(1, r)").alias("bit"), F.explode(F.sequence(cell, last)).alias("cell"))
    places = hits.groupBy("doc_id", "window_id", "agree", "cell").agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.bit_or("bit").alias("bits")).where("bit_count(bits) >= agree")
    texts = C.materialize(found.select("window_id", "window", "items", "least").dropDuplicates(["window"]), "texts")
    each = places.join(bounded(texts), "window_id").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "window", "items", "least")).alias("cand_"))
    return C.materialize(each, "near_candidates")


def nearest(slop: int) -> Column:
    """Of text and cand_: (window, items, least, best: (minus the words found, start)) of each place that has enough of the window's words."""

    def found(words: Column, c: Column, s: Column) -> Column:
        def there(o: Column) -> Column:
            first = F.greatest(s + o - slop, F.lit(0))
            return F.array_contains(F.slice(words, first + 1, F.greatest(s + o + slop + 1 - first, F.lit(0))), F.get(c["window"], o))

        return F.size(F.filter(F.sequence(F.lit(0), F.size(c["window"]) - 1), there))

    def place(words: Column, c: Column) -> Column:
        best = F.array_min(F.transform(F.sequence(c["lo"] - slop, c["hi"] + slop), lambda s: F.struct((-found(words, c, s)).alias("minus"), s.alias("start"))))
        return F.struct(c["window"].alias("window"), c["items"].alias("items"), c["least"].alias("least"), best.alias("best"))

    def may(words: Column, c: Column) -> Column:
        """Whether enough of the words are anywhere in the stretch, which is soon told."""
        first = F.greatest(c["lo"] - 2 * slop, F.lit(0))
        part = F.slice(words, first + 1, F.greatest(c["hi"] + 2 * slop + F.size(c["window"]) - first, F.lit(0)))
        return F.exists(F.array(part), lambda x: F.size(F.filter(c["window"], lambda w: F.array_contains(x, w))) >= c["least"])

    # The words are bound once for a row.
    of_row = F.transform(F.array(words_of("text")), lambda words: F.filter(F.transform(F.filter("cand_", lambda c: may(words, c)), lambda c: place(words, c)), lambda p: -p["best"]["minus"] >= p["least"]))
    return F.when(F.col("cand_").isNotNull(), F.get(of_row, F.lit(0)))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 3, size: int = 10, misses: int = 2) -> DataFrame:
    """(doc_id, start, window, items, n_found): windows that stand nearly in a document, each at its best place, of equals the first.

    A word of the window is found where it occurs at its offset from start, give or take slop words; all but
    `misses` of `size` words must be (of a shorter window proportionally many, rounded down). Null texts have
    no words; rows without doc_id match nothing; repeated rows count once.
    """
    rows = docs.select("doc_id", "text").join(near_places(docs.select("doc_id", "text"), items, slop, size, misses), "doc_id")
    each = rows.select("doc_id", F.explode(nearest(slop)).alias("p")).select("doc_id", "p.window", "p.items", "p.best")
    best = each.groupBy("doc_id", "window", "items").agg(F.min("best").alias("best"))
    return best.select("doc_id", F.col("best.start").alias("start"), "window", "items", (-F.col("best.minus")).alias("n_found"))


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs' columns as c0, c1, ... with key_ and text, and the names they had."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items() if c != "text"), F.col("doc_id").cast("long").alias("key_"), F.col("text")), names


def _back(names: dict[str, str], new: tuple[str, ...]) -> list[Column]:
    return [F.col("text" if c == "text" else n).alias(c) for n, c in names.items() if c not in new]


def near_matches(docs: DataFrame, items: DataFrame, slop: int = 3, size: int = 10, misses: int = 2) -> DataFrame:
    """The rows of docs plus n_near (different windows that proximity_matches finds) and near_items (their items' ids, sorted as strings).

    Null texts, rows without doc_id, repeated rows, empty tables and clashing columns as with phrase_matches.
    """
    places = near_places(docs.select("doc_id", "text"), items, slop, size, misses).withColumnRenamed("doc_id", "key_")
    rows, names = _apart(docs)
    rows = rows.join(places, "key_", "left").withColumn("near_", nearest(slop))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("near_", lambda p: p["items"]))))
    return rows.select(
        *_back(names, ("n_near", "near_items")),
        F.coalesce(F.size(F.array_distinct(F.transform("near_", lambda p: p["window"]))).cast("long"), F.lit(0).cast("long")).alias("n_near"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("near_items"),
    )


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = 10, rarest: int = 2) -> DataFrame:
    """The rows of docs plus n_words, spans (start and end word of each occurring window), n_hit (words inside any) and items (ids, sorted as strings).

    A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null texts have no words; rows without doc_id match nothing; repeated rows get the same result; rows that
    share a doc_id but not the text get their own. Without items, or with null texts only, nothing matches; an
    empty table gives an empty one. Other columns pass unchanged; columns with the names of the new ones are replaced.
    """
    postings = index(docs.select("doc_id", "text"))
    found = lookups(postings, items, size, rarest)
    each = phrase_candidates(postings, found).groupBy("doc_id").agg(F.collect_list(F.struct("start", "words", "window_id", "items")).alias("cand_"))
    rows, names = _apart(docs)
    rows = rows.join(each.withColumnRenamed("doc_id", "key_"), "key_", "left").withColumn("words_", words_of("text"))
    same = F.filter("cand_", lambda c: F.xxhash64(F.slice("words_", c["start"] + 1, c["words"])) == c["window_id"])
    kept = [n if c != "text" else "text" for n, c in names.items()]
    rows = rows.select(*kept, F.size("words_").cast("long").alias("n_words_"), F.when(F.col("cand_").isNotNull(), same).alias("hit_"))
    spans = F.array_sort(F.array_distinct(F.transform("hit_", lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["words"]).alias("end")))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hit_", lambda c: c["items"]))))
    rows = rows.withColumn("spans_", F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")))
    covered = F.aggregate(
        "spans_",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
        lambda a: a["n"].cast("long"),
    )
    new = ("n_words", "spans", "n_hit", "items")
    return rows.select(*_back(names, new), F.col("n_words_").alias("n_words"), F.col("spans_").alias("spans"), F.coalesce(ids, F.array().cast("array<string>")).alias("items"), covered.alias("n_hit"))
