"""Operator 5: exact Jaccard join of word shingles, and the components of its links.

Each set's elements are ordered rarest first (by a fixed-size count of the whole corpus), so that linked
sets share an element of their short prefixes. Set relations save work twice. On the index: a list holds
(size, position) of its sets in order of size, and blocks of sizes and positions that can't reach the
overlap are skipped whole. On the answers: equal sets take one representative's answers; sets found linked
form a group that shares its answers, and from then on only pairs between different groups are computed.
Between groups, a bitmap of each set bounds what two sets can have in common before their texts are read.
Every pair that could link is thus computed, or follows from computed ones; no list or group is capped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.llm import common as C

#: Counters of the corpus count, and the blocks in which they are added up. The order of elements depends on
#: them, the result does not, so their number may be raised for more documents (4 bytes each in a task).
COUNTERS, BLOCKS = 1 << 22, 64
#: Sets of one list and group from which the list is dealt to several tasks in the second look.
LONG = 512
#: Bits of a set's bitmap. Each element flips one bit, so sets differ in at least as many elements as bitmaps in bits.
BITS = 1024


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and each text's first."""
    data = C.lower_ascii(data)
    starts, ends, first = C.word_spans(data, offs)
    n = np.diff(first)
    sums = C.prefix_sums(C.word_hashes(data, starts, ends))
    rolled = C.rolling_hash(sums, words)
    h = np.zeros(len(starts), np.uint64)
    h[: len(rolled)] = rolled
    left = np.repeat(first[1:], n) - np.arange(len(starts))
    short = np.flatnonzero((n > 0) & (n < words))
    valid = left >= words
    h[first[short]] = C.span_hash(sums, first[short], first[short + 1])
    valid[first[short]] = True
    doc = np.repeat(np.arange(len(n)), n)[valid]
    h = h[valid]
    at = np.searchsorted(doc, np.arange(len(n) + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def corpus_counts(docs: DataFrame, words: int) -> np.ndarray:
    """For each counter a rank from 0 to 255 that grows with the number of sets that have an element there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(COUNTERS, np.uint32)
        for _, data, offs in C.chunks(batches, "text"):
            h, _ = shingle_sets(data, offs, words)
            np.add.at(have, (h >> np.uint64(42)).astype(np.int64), np.uint32(1))
        if have.any():
            parts = have.reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("counts"), strict=True):
                own = np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
                total[k] = total[k] + own if k in total else own.astype(np.uint64)
        if total:
            rank = [np.minimum(8 * np.log2(x + 1.0), 255).astype(np.uint8).tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array(rank, pa.binary())], names=["block", "counts"])

    each = docs.select("text").where("text is not null").mapInArrow(count, "block int, counts binary")
    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.uint8)
    for r in each.repartition("block").mapInArrow(add, "block int, counts binary").collect():  # COUNTERS bytes in all
        out[r["block"]] = np.frombuffer(bytes(r["counts"]), np.uint8)
    return out.ravel()


SETS = "doc_id long, size int, s1 long, s2 long, tokens binary, bits binary"


def set_rows(docs: DataFrame, words: int, percent: int, ranks) -> DataFrame:
    """A row for each document: the set's size, two sums that stand for the set, its prefix, rarest first, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ranks.value
        for part, data, offs in C.chunks(batches, "text", rows=2048):
            h, first = shingle_sets(data, offs, words)
            size = np.diff(first)
            flips = np.repeat(np.arange(len(size)), size) * BITS + (h & np.uint64(BITS - 1)).astype(np.int64)
            bits = np.packbits((np.bincount(flips, minlength=len(size) * BITS) & 1).astype(bool).reshape(-1, BITS), axis=1)
            key = order[(h >> np.uint64(42)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h & np.uint64((1 << 56) - 1)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(C.mix(h, s))]) for s in (1, 2)]
            tokens = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = key[a:b]
                own.sort()
                n = b - a
                tokens.append(own[: n - (percent * n + 99) // 100 + 1 if n else 0].tobytes())
            s1, s2 = (C.as_long(s[first[1:]] - s[first[:-1]]) for s in sums)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int32()), s1, s2, pa.array(tokens, pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary())], names=["doc_id", "size", "s1", "s2", "tokens", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def postings(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = C.utf8(b.column("tokens"))
            n = np.diff(offs) // 8
            token = np.frombuffer(data.tobytes(), np.int64)
            pos = np.arange(len(token)) - np.repeat(offs[:-1] // 8, n)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(b.column("size").to_numpy(), n)), pa.array(pos, pa.int32()), pa.array(np.repeat(b.column("doc_id").to_numpy(), n))], names=["token", "size", "pos", "doc"])

    return sets.select("doc_id", "size", "tokens").mapInArrow(run, "token long, size int, pos int, doc long")


def may_link(si, pi, sj, pj, percent: int):
    """Whether sets of these sizes whose first common element has these positions can reach the overlap."""
    need = (percent * (si + sj) + 99 + percent) // (100 + percent)
    return (np.minimum(si - pi, sj - pj) >= need) & (percent * np.maximum(si, sj) <= 100 * np.minimum(si, sj))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of as many whole lists as a batch completes; a list is never cut."""
    held: list[pa.RecordBatch] = []

    def columns(parts):
        t = pa.Table.from_batches(parts)
        return {n: t.column(n).to_numpy() for n in t.column_names}

    for b in batches:
        if not b.num_rows:
            continue
        token = b.column("token").to_numpy()
        if held and held[-1].column("token")[-1].as_py() != token[0]:
            yield columns(held)
            held = []
        if token[0] != token[-1]:
            cut = int(np.flatnonzero(token != token[-1])[-1]) + 1
            yield columns([*held, b.slice(0, cut)])
            held, b = [], b.slice(cut)
        held.append(b)
    if held:
        yield columns(held)


FOUND = "kind int, token long, size int, pos int, doc long, other long"


def leaders(percent: int):
    """First look at the lists: pairs of each set with its list's least doc_id (kind 0), and all rows of lists of three or more (kind 1).

    Similar sets are in many lists together; as the leader is mostly the same one, few pairs come of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _lists(batches):
            token, size, pos, doc = (x[k] for k in ("token", "size", "pos", "doc"))
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            count = np.diff(np.append(begin, len(token)))
            order = np.lexsort((doc, np.repeat(np.arange(len(begin)), count)))
            lead = np.repeat(order[begin], count)
            i = np.flatnonzero((doc != doc[lead]) & may_link(size, pos, size[lead], pos[lead], percent))
            pairs = np.unique(np.stack([doc[lead[i]], doc[i]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            more = np.flatnonzero(np.repeat(count > 2, count))
            n, m = len(pairs), len(more)
            if n + m:
                z = np.zeros(n, np.int64)
                cols = [np.repeat([0, 1], [n, m]), np.append(z, token[more]), np.append(z, size[more]), np.append(z, pos[more]), np.append(pairs[:, 0], doc[more]), np.append(pairs[:, 1], np.zeros(m, np.int64))]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "token", "size", "pos", "doc", "other"])

    return run


def across(percent: int):
    """Second look, with each set's group and bitmap: all pairs of different groups that can link, block by block.

    A block is a run of one size in a list, with its least position; blocks whose sizes or least positions
    rule every pair out are skipped. again: rows that stand in another part of the list, too; two such are left to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _lists(batches):
            token, group = x["token"], x["comp"]
            bits = np.frombuffer(b"".join(x["bits"].tolist()), np.uint64).reshape(len(token), -1)
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            end = np.append(begin[1:], len(token))
            mixed = np.minimum.reduceat(group, begin) != np.maximum.reduceat(group, begin)
            out = []
            for a, b in zip(begin[mixed].tolist(), end[mixed].tolist(), strict=True):
                size, pos, doc, comp, bit, again = x["size"][a:b].astype(np.int64), x["pos"][a:b].astype(np.int64), x["doc"][a:b], group[a:b], bits[a:b], x["again"][a:b].astype(bool)
                start = np.flatnonzero(np.append(True, size[1:] != size[:-1]))
                stop = np.append(start[1:], b - a)
                s, p = size[start], np.minimum.reduceat(pos, start)
                for k in range(len(start)):
                    for m in (k + np.flatnonzero(may_link(s[k], p[k], s[k:], p[k:], percent))).tolist():
                        for i in range(start[k], stop[k]):
                            lo = max(i + 1, start[m])
                            j = lo + np.flatnonzero((comp[lo : stop[m]] != comp[i]) & ~(again[i] & again[lo : stop[m]]) & may_link(size[i], pos[i], size[lo : stop[m]], pos[lo : stop[m]], percent))
                            if len(j):
                                apart = np.bitwise_count(bit[j] ^ bit[i]).sum(1).astype(np.int64)
                                both = size[i] + size[j]
                                j = j[(100 + percent) * (both - apart) >= 2 * percent * both]
                                out.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], 1))
            if out:
                pairs = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def dealt(lists: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows of the lists in which sets of different groups meet, with their bitmaps, for across().

    Of a long list the rows of its largest group are dealt to parts of at most about LONG, and the others stand in
    each part: sets of one group needn't meet, so every pair of different groups still meets once. A group of copies,
    however large, is thus no task's alone.
    """
    mixed = C.materialize(lists.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x <> y").select("token", "n"), "mixed")
    each = lists.join(mixed.where(F.col("n") > LONG).select("token"), "token").groupBy("token", "comp").agg(F.count("*").alias("n"))
    largest = each.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("g")).select("token", F.col("g.comp").alias("major"), F.ceil(F.col("g.n") / LONG).cast("int").alias("parts"))
    of = mixed.select("token").join(largest, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = lists.join(of, "token").join(bits, ["doc", "size"])
    in_major = F.col("comp").eqNullSafe(F.col("major"))
    part = F.when(in_major, F.array(F.pmod(F.xxhash64("doc"), F.col("parts").cast("long")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("token", "size", "pos", "doc", "comp", "bits", in_major.alias("in_major"), F.explode(part).alias("part"))
    return rows.select(F.xxhash64("token", "part").alias("token"), "size", "pos", "doc", "comp", "bits", (~F.col("in_major") & (F.col("part") > 0)).cast("int").alias("again"))


def id_filter(ids: DataFrame, least: int = 1 << 16, most: int = 1 << 28) -> np.ndarray:
    """A Bloom filter of a column of ids: 16 bits an id, four of them set, never more than `most` bits."""
    bits = least
    n = ids.count()
    while bits < most and bits < 16 * n:
        bits *= 2
    pieces = 16

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits, bool)
        for b in batches:
            for place in bloom_places(b.column(0).to_numpy(), bits):
                have[place] = True
        packed = np.packbits(have).reshape(pieces, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], names=["piece", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("piece").to_pylist(), b.column("bits"), strict=True):
                own = np.frombuffer(x.as_py(), np.uint8)
                total[k] = total[k] | own if k in total else own
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "bits"])

    out = np.zeros((pieces, bits // 8 // pieces), np.uint8)
    for r in ids.mapInArrow(part, "piece int, bits binary").repartition("piece").mapInArrow(join, "piece int, bits binary").collect():
        out[r["piece"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def bloom_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(C.mix(ids.astype(np.uint64), s) & np.uint64(bits - 1)).astype(np.int64) for s in range(11, 15)]


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets, from their whole texts, reach the similarity, each with link true or false.

    Texts of documents in no pair are left out by a filter before the shuffle.
    """
    ids = C.materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    have = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = have.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for place in bloom_places(b.column("doc_id").to_numpy(), 8 * len(bits)):
                keep &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
            yield b.filter(pa.array(keep))

    likely = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(maybe, "doc_id long, text string")
    texts = C.materialize(likely.join(ids, "doc_id", "left_semi"), "texts").dropDuplicates(["doc_id"])
    x = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text"))
    y = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in C.chunks(batches, "text"):
            h, first = shingle_sets(data, offs, words)
            g, other = shingle_sets(*C.utf8(part.column("text2")), words)
            link = []
            for i in range(part.num_rows):
                u, v = h[first[i] : first[i + 1]], g[other[i] : other[i + 1]]
                common = len(np.intersect1d(u, v, assume_unique=True))
                link.append(100 * common >= percent * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(link, pa.bool_())], names=["a", "b", "link"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "text", "text2").mapInArrow(run, "a long, b long, link boolean")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links reduced to (member, least member): equal components, one row for each member at most."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent[p]
            v = p
        return v

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
    members = [v for v in parent if root(v) != v]
    if members:
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array([root(v) for v in members], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(u, v): for each member of a component but the least, that least member. links: u, v, any order.

    Alternating large and small stars; each round is a written table, so a lost executor costs one round.
    """
    edges = C.materialize(links.where("u <> v").mapInArrow(forest, "u long, v long").distinct(), "forest")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = C.materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = C.materialize(small, "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs with a doc_id.

    Two documents link when 100 * common >= percent * union of their sets of distinct `words`-word shingles
    (fewer words: the whole sequence; A-Z lower-cased). component_id is the least doc_id reachable by links.
    Null and empty texts have no shingles and are their own component. Rows that share a doc_id are one
    document with several sets, linked through it.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    ranks = spark.sparkContext.broadcast(corpus_counts(docs, words))
    sets = C.materialize(set_rows(docs, words, percent, ranks), "sets")
    some = sets.where("size > 0")
    classes = some.groupBy("s1", "s2", "size").agg(F.min("doc_id").alias("rep"), F.min_by("tokens", "doc_id").alias("tokens"), F.min_by("bits", "doc_id").alias("bits"))
    classes = C.materialize(classes, "classes")
    member = some.select("doc_id", "s1", "s2", "size").join(classes.select("s1", "s2", "size", "rep"), ["s1", "s2", "size"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    lists = postings(classes.select(F.col("rep").alias("doc_id"), "size", "tokens")).repartition("token").sortWithinPartitions("token", "size", "doc")
    found = C.materialize(lists.mapInArrow(leaders(percent), FOUND), "lists")
    pairs = C.materialize(found.where("kind = 0").select(F.col("doc").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    first = C.materialize(verified(pairs, docs, words, percent), "links")
    linked = first.where("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
    groups = components(linked)
    open_lists = found.where("kind = 1").join(groups, found["doc"] == groups["u"], "left").select("token", "size", "pos", "doc", F.coalesce("v", "doc").alias("comp"))
    open_lists = C.materialize(open_lists, "open")
    rest = dealt(open_lists, classes.select(F.col("rep").alias("doc"), "size", "bits"))
    rest = rest.repartition("token").sortWithinPartitions("token", "size", "doc").mapInArrow(across(percent), "a long, b long")
    rest = C.materialize(rest.distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    second = C.materialize(verified(rest, docs, words, percent), "links").where("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
    final = components(groups.union(second).union(member))
    out = sets.join(final, sets["doc_id"] == final["u"], "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("v", "doc_id").alias("component_id"))
    return out
