"""Operator 9: Merkle fingerprints of documents: leaves in paragraphs in sections under a root.

A leaf is a run of words of one paragraph (line), ended by a word whose hash is 0 modulo 8, so an edit
moves no other leaf's boundary; a longer one is cut by its bytes, so that its length fits. A section is a run of paragraphs, ended likewise by a paragraph's hash.
A node is the 128-bit BLAKE2b hash of its bytes (a leaf) or of its children's hashes, each level with its
own personalisation. A fingerprint is the root in hex, a colon, and one record of 8 bytes a leaf in base64: 48
bits of the leaf's hash, 14 of its length in bytes, one each that say a paragraph or a section ends there.
Equal roots stand for equal texts; where they differ, the records tell sections, paragraphs and leaves apart,
so two fingerprints can be compared branch by branch.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.llm import common as C

LEAF_WORDS, SECTION_PARAGRAPHS = np.uint64(8), np.uint64(4)
_LENGTH = np.uint64((1 << 14) - 1)


#: A leaf too long for its record is cut where the hash of so many bytes is 0 modulo CUT, at the latest where it must be.
CUT_BYTES, CUT = 16, np.uint64(2048)


def cuts(sums: np.ndarray, begin: int, stop: int) -> list[int]:
    """Ends of the pieces of a leaf that is too long, all but the last."""
    ends = np.arange(begin + CUT_BYTES, stop)
    ends = ends[C.mix(C.span_hash(sums, ends - CUT_BYTES, ends)) % CUT == 0]
    out, at, most = [], begin, int(_LENGTH)
    for end in [*ends.tolist(), stop]:
        while end - at > most:
            at += most
            out.append(at)
        # No piece is shorter than the bytes that decide, so that runs of one letter aren't cut at each.
        if end < stop and end - at >= CUT_BYTES:
            out.append(end)
            at = end
    return out


def nodes(parts: list[bytes], level: bytes) -> list[bytes]:
    return [blake2b(x, digest_size=16, person=level).digest() for x in parts]


def grouped(digests: list[bytes], ends: list[int]) -> list[bytes]:
    """The digests joined, up to each of the ends."""
    out, at = [], 0
    for e in ends:
        out.append(b"".join(digests[at:e]))
        at = e
    return out


def first_bits(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8")[::2].astype(np.uint64)


def leaves(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Records of all leaves, each document's first, and the documents' roots. A leaf reaches to where the next one starts.

    A text without words has no leaves; its root is that of its white space.
    """
    starts, ends, first_word = C.word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), nodes([data[i:j].tobytes() for i, j in zip(offs[:-1], offs[1:], strict=True)], b"blank")
    sums = C.prefix_sums(data.astype(np.uint64) + np.uint64(1))
    words = C.span_hash(sums, starts, ends)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    n = len(starts)
    doc_end = np.zeros(n, bool)
    doc_end[first_word[1:][np.diff(first_word) > 0] - 1] = True
    next_start = np.append(starts[1:], len(data))
    paragraph_end = doc_end | (lines[ends] != lines[np.minimum(next_start, len(data))])
    leaf_end = paragraph_end | (words % LEAF_WORDS == 0)
    last = np.flatnonzero(leaf_end)
    # White space belongs to the leaf before it; what precedes a document's first word, to the first leaf.
    doc_of = np.searchsorted(first_word, last, "right") - 1
    stop = np.where(doc_end[last], offs[doc_of + 1], next_start[last])
    begin = np.append(0, stop[:-1])
    begin = np.maximum(begin, offs[doc_of])
    first_leaf = np.searchsorted(last, first_word)
    of_paragraph, ends_doc = paragraph_end[last], doc_end[last]
    long = np.flatnonzero(stop - begin > int(_LENGTH))
    if len(long):
        more = [cuts(sums, int(begin[i]), int(stop[i])) for i in long]
        sizes = [len(x) for x in more]
        at, ends = np.repeat(long, sizes), np.concatenate([np.array(x, np.int64) for x in more])
        first_leaf = first_leaf + np.searchsorted(at, first_leaf)
        stop, of_paragraph, ends_doc = np.insert(stop, at, ends), np.insert(of_paragraph, at, False), np.insert(ends_doc, at, False)
        begin = np.insert(begin, at + 1, ends)
    raw = data.tobytes()
    digests = nodes([raw[i:j] for i, j in zip(begin.tolist(), stop.tolist(), strict=True)], b"leaf")
    p_last = np.flatnonzero(of_paragraph)
    paragraphs = nodes(grouped(digests, (p_last + 1).tolist()), b"paragraph")
    over = (first_bits(paragraphs) % SECTION_PARAGRAPHS == 0) | ends_doc[p_last]
    sections = nodes(grouped(paragraphs, (np.flatnonzero(over) + 1).tolist()), b"section")
    section = np.zeros(len(digests), bool)
    section[p_last] = over
    tops = grouped(sections, np.searchsorted(np.flatnonzero(section), first_leaf[1:]).tolist())
    blank = [x or raw[i:j] for x, i, j in zip(tops, offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    root = [blake2b(x, digest_size=16, person=b"root" if t else b"blank").digest() for x, t in zip(blank, tops, strict=True)]
    record = (first_bits(digests) & ~np.uint64(0xFFFF)) | ((stop - begin).astype(np.uint64) << np.uint64(2))
    record |= of_paragraph.astype(np.uint64) << np.uint64(1) | section.astype(np.uint64)
    return record, first_leaf, root


def compose(record: np.ndarray, first: np.ndarray, root: list[bytes]) -> list[str]:
    """Fingerprints."""
    raw = record.astype(">u8").tobytes()
    return [f"{r.hex()}:{base64.b64encode(raw[8 * a : 8 * b]).decode()}" for r, a, b in zip(root, first[:-1].tolist(), first[1:].tolist(), strict=True)]


def taken(record: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records of the documents at the given places, and each one's first."""
    n = (first[1:] - first[:-1])[at]
    ends = np.cumsum(n)
    return record[np.repeat(first[at] - (ends - n), n) + np.arange(n.sum())], np.append(0, ends)


def likeness(ra: np.ndarray, fa: np.ndarray, rb: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Share of the leaves' bytes that two documents' fingerprints have in common (twice the common over both)."""
    n = len(fa) - 1
    out_w = np.zeros(n)

    def counted(r, f):
        pair = np.repeat(np.arange(n), np.diff(f))
        key = C.mix((r >> np.uint64(16)) ^ C.mix(pair.astype(np.uint64)))
        size = ((r >> np.uint64(2)) & _LENGTH).astype(float)
        total = np.bincount(pair, size, minlength=n)
        u, at, c = np.unique(key, return_index=True, return_counts=True)
        return total, u, c, pair[at], size[at]

    ta, ua, ca, pa_, sa = counted(ra, fa)
    tb, ub, cb, _, _ = counted(rb, fb)
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    out_w += np.bincount(pa_[x], np.minimum(ca[x], cb[y]) * sa[x], minlength=n)
    both = ta + tb
    return np.where(both > 0, np.minimum(1.0, 2 * out_w / np.maximum(both, 1)), 1.0)


def changed(xs: list, ys: list, i: int, j: int, k: int, m: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges in which xs[i:j] and ys[k:m] differ: between equal ends, and between elements that both have once, in the longest order they share."""
    while i < j and k < m and xs[i] == ys[k]:
        i, k = i + 1, k + 1
    while i < j and k < m and xs[j - 1] == ys[m - 1]:
        j, m = j - 1, m - 1
    if i == j or k == m:
        if i < j or k < m:
            yield i, j, k, m
        return
    cx, cy = Counter(xs[i:j]), Counter(ys[k:m])
    where = {y: t for t, y in enumerate(ys[k:m], k) if cy[y] == 1}
    once = [(s, where[x]) for s, x in enumerate(xs[i:j], i) if cx[x] == 1 and x in where]
    # The longest increasing run of places in ys.
    tails, best, before = [], [], [-1] * len(once)
    for n, (_, t) in enumerate(once):
        at = bisect_left(tails, t)
        before[n] = best[at - 1] if at else -1
        tails[at:at + 1], best[at:at + 1] = [t], [n]
    kept, n = [], best[-1] if best else -1
    while n >= 0:
        kept.append(once[n])
        n = before[n]
    if not kept:
        yield i, j, k, m
        return
    for s, t in [*kept[::-1], (j, m)]:
        yield from changed(xs, ys, i, s, k, t)
        i, k = s + 1, t + 1


def differing(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where fingerprint b differs from a: (first byte, byte after) in a's text, then in b's. Equal roots: nowhere.

    Equal sections are skipped, then equal paragraphs of the others, then equal leaves of those.
    """
    if a.split(":")[0] == b.split(":")[0]:
        return []

    def tree(x):
        """(hashes, first leaves) of sections, paragraphs and leaves, and the leaves' byte offsets."""
        r = np.frombuffer(base64.b64decode(x.split(":")[1]), ">u8").astype(np.uint64)
        hashes, levels = r >> np.uint64(16), []
        for flag in (1, 2):
            ends = np.flatnonzero(r & np.uint64(flag)) + 1
            firsts = np.append(0, ends)[:-1]
            levels.append((C.span_hash(C.prefix_sums(hashes), firsts, ends).tolist(), np.append(firsts, len(r))))
        levels.append((hashes.tolist(), np.arange(len(r) + 1)))
        return levels, np.concatenate([[0], np.cumsum(((r >> np.uint64(2)) & _LENGTH).astype(int))])

    (la, oa), (lb, ob) = tree(a), tree(b)
    out = []

    def descend(level, i, j, k, m):
        """What differs between a's leaves i to j and b's leaves k to m, both whole nodes of the level."""
        (ha, fa), (hb, fb) = la[level], lb[level]
        (i, j), (k, m) = np.searchsorted(fa, (i, j)).tolist(), np.searchsorted(fb, (k, m)).tolist()
        for p, q, s, t in changed(ha, hb, i, j, k, m):
            at = int(fa[p]), int(fa[q]), int(fb[s]), int(fb[t])
            if p < q and s < t and level < 2:
                descend(level + 1, *at)
            else:
                out.append((int(oa[at[0]]), int(oa[at[1]]), int(ob[at[2]]), int(ob[at[3]])))

    descend(0, 0, len(oa) - 1, 0, len(ob) - 1)
    return out or [(0, int(oa[-1]), 0, int(ob[-1]))]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of each whole text (null: empty), a row for each row; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in C.chunks(batches, "text"):
            record, first, root = leaves(data, offs)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(points[offs[1:]] - points[offs[:-1]]), pa.array(compose(record, first, root))], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


OUT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, fold: int = 4) -> DataFrame:
    """Rows (part, doc_id, text, ahead), so that in each part, in order (ahead, doc_id downwards, text), each
    document stands before the next one; a part ends with a copy of the next part's first (ahead = 1).

    Parts are ranges of doc_id; their bounds are quantiles, `fold` a shuffle partition, so bounded in number.
    Only the heads of the parts travel twice. Rows without doc_id come after all others.
    """
    n = fold * C.shuffle_partitions(docs.sparkSession)
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or []
    bounds = np.unique(np.array(found, np.int64))

    @F.pandas_udf("long")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy(), "left"))

    # Part 0 has the largest ids. The first document of each part is the one with its largest id, then least text.
    heads = rows.select("key", part_of("key").alias("part")).groupBy("part").agg(F.max("key").alias("key")).collect()
    if not heads:
        return rows.select(F.lit(0).cast("long").alias("part"), "doc_id", "key", "text", F.lit(0).alias("ahead"))
    order = sorted((h["part"], h["key"]) for h in heads)
    before = [(order[i - 1][0], key) for i, (_, key) in enumerate(order)]
    ahead = docs.sparkSession.createDataFrame(before, "part long, key long")
    first = rows.join(F.broadcast(ahead), "key").groupBy("part", "key").agg(F.min("text").alias("text"))
    return rows.select(part_of("key").alias("part"), "doc_id", "key", "text", F.lit(0).alias("ahead")).unionByName(first.select("part", F.lit(None).cast("long").alias("doc_id"), "key", "text", F.lit(1).alias("ahead")))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    Edited: the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document, in descending doc_id; after the last comes the first. Null text is empty. Rows that share a
    doc_id follow one another in the order of their texts, repeated rows too; rows without doc_id come last. A
    single document is its own next one. An empty table gives an empty one. Other columns are left out.
    """
    rows = with_next(docs).repartition("part").sortWithinPartitions("part", "ahead", F.col("key").desc(), "text")
    rows = rows.select("part", "doc_id", "text", "ahead")

    def out(ids, texts, following):
        sizes = [len(t) for t in texts]
        edited = [t[: n - n // 3] + f[: n // 3] for t, n, f in zip(texts, sizes, following, strict=True)]
        # A document's next one is mostly the one that comes next here.
        after = [i + 1 < len(texts) and following[i] is texts[i + 1] for i in range(len(texts))]
        others = [f for f, x in zip(following, after, strict=True) if not x]
        record, first, root = leaves(*C.utf8(pa.array([*texts, *others], pa.large_string())))
        more, own = iter(range(len(texts), len(texts) + len(others))), np.arange(len(texts))
        nxt = np.array([i + 1 if x else next(more) for i, x in enumerate(after)], np.int64)
        new = leaves(*C.utf8(pa.array(edited, pa.large_string())))
        every, b = compose(record, first, root), compose(*new)
        a, c = every[: len(texts)], [every[i] for i in nxt]
        mine = taken(record, first, own)
        near_edited, near_next = likeness(*mine, *new[:2]), likeness(*mine, *taken(record, first, nxt))
        near_edited = [1.0 if x == y else float(v) for x, y, v in zip(a, b, near_edited, strict=True)]
        near_next = [1.0 if x == y else float(v) for x, y, v in zip(a, c, near_next, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(edited, pa.string()), pa.array(a), pa.array(b), pa.array(near_edited), pa.array(near_next)], names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, texts, following, size = None, [], [], [], 0
        for part, _, _ in C.chunks(batches, "text"):
            for row in zip(*(part.column(c).to_pylist() for c in ("part", "doc_id", "text", "ahead")), strict=True):
                if last is not None and not last[3] and last[0] == row[0]:
                    ids.append(last[1])
                    texts.append(last[2])
                    following.append(row[2])
                    size += len(last[2]) + len(row[2])
                    if size > C.CHUNK_BYTES:
                        yield out(ids, texts, following)
                        ids, texts, following, size = [], [], [], 0
                last = row
        if ids:
            yield out(ids, texts, following)

    return rows.mapInArrow(run, OUT)
