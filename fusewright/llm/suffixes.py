"""Operator 6: bytes covered by a string of 100 bytes that also starts earlier, by prefix-free parsing.

Parse. A rolling hash over `trigger` bytes sets the triggers: its value is 0 modulo MODULUS, and where no such
string starts within reach of a window, the window's least value. A phrase runs from one trigger to the end of
the next, so no phrase's suffix that holds a trigger is a prefix of another. The parse is each document's row
of triggers. A trigger string that the corpus has once can't be in a repeated window, so phrases that end in one go.

Dictionary. What stays are phrases that end in a repeated trigger, each with what the parse has after it,
as far as a window reaches. Equal ones within a step are settled there, so repetitive text travels once.

Corpus order. Phrases with one trigger meet in a bucket. The suffix array of the dictionary sorts them from
their ends: neighbours' common lengths give, for each length d, the class of the suffix of d bytes. The parse,
sorted by what follows the trigger, gives the class of the next 100 - d bytes. Windows are equal where both
classes are, and the first of them in corpus order is the earliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.llm import common as C
from fusewright.llm import repeats as R
from fusewright.llm import rows as K

#: Triggers by residue: one in so many bytes (a power of two).
MODULUS = np.uint64(32)
#: Windows without a trigger by residue that are looked at at a time.
BLOCK = 1 << 14
#: Triggers that a step of the parse gathers, and phrases that a step of the dictionary does.
TRIGGERS, PHRASES = 1 << 19, 1 << 16
#: Phrases of one bucket that are sorted at a time; the windows of a bucket with more are told apart one by one, by Spark's sort.
BUCKET = 1 << 19


def first_triggers(sums: np.ndarray, offs: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run of whole windows that have the same first trigger, and where that one starts."""
    n, reach = len(sums) - 1, length - trigger + 1
    at = np.flatnonzero(R.whole_windows(offs, n, length))
    if not len(at):
        return at, at, at
    h = C.rolling_hash(sums, trigger)
    zero = np.flatnonzero(h & (MODULUS - np.uint64(1)) == 0)
    found = np.append(zero, n + length)[np.searchsorted(zero, at)]
    bare = np.flatnonzero(found - at >= reach)
    ahead = np.lib.stride_tricks.sliding_window_view(h, reach)
    for i in range(0, len(bare), BLOCK):
        p = at[bare[i : i + BLOCK]]
        found[bare[i : i + BLOCK]] = p + ahead[p].argmin(1)
    new = np.append(True, found[1:] != found[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return at[begin], at[end], found[begin]


def parse(length: int, trigger: int, parts: int):
    """The parse: triggers to the buckets of their strings (TEXT); places of those that a step has twice are notes already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def step():
            c, key, tie, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(c, kind="stable")
            head = np.append(True, c[order[1:]] != c[order[:-1]])
            begin = np.flatnonzero(head)
            count = np.diff(np.append(begin, len(c)))
            again = order[np.repeat(count > 1, count)]
            yield from K.notes(parts, key[again], tie[again], place[again])
            one = order[begin]
            bucket = ((c[one] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            got = [*K.packed(bucket, c[one], key[one], tie[one], place[one], np.minimum(count, 2).astype(np.uint8))]
            yield C.batch(K.STEP, np.full(len(got), K.TEXT, np.int32), [b for b, _ in got], [x for _, x in got])

        for part, data, offs in C.chunks(batches, "text"):
            if len(data) < length:
                continue
            sums = C.prefix_sums(data.astype(np.uint64) + np.uint64(1))
            _, _, at = first_triggers(sums, offs, length, trigger)
            if not len(at):
                continue
            row = np.searchsorted(offs, at, "right") - 1
            key, tie = (part.column(c).to_numpy() for c in ("key_", "tie_"))
            held.append((C.span_hash(sums, at, at + trigger), key[row], tie[row], (at - offs[row]).astype(np.int32)))
            size += len(at)
            del sums
            if size >= TRIGGERS:
                yield from step()
                held, size = [], 0
        if held:
            yield from step()
        held = []
        C.trim()

    return run


def recurring(parts: int):
    """Places of triggers whose string the corpus has more than once, as notes, with what are notes already."""
    kinds = [np.uint64, np.int64, np.int64, np.int32, np.uint8]

    def settled(held):
        c, key, tie, place, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(c, kind="stable")
        begin = np.flatnonzero(np.append(True, c[order[1:]] != c[order[:-1]]))
        rows = np.diff(np.append(begin, len(c)))
        total = np.add.reduceat(n[order].astype(np.int64), begin)
        again = order[np.repeat(total > 1, rows)]
        again = again[n[again] == 1]
        return key[again], tie[again], place[again]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []

        def step(most: int):
            if sum(len(x[0]) for x in found) > most:
                yield from K.notes(parts, *(np.concatenate(x) for x in zip(*found, strict=True)))
                found.clear()

        for kind, bucket, blobs in K.by_bucket(batches):
            if bucket != now:
                if held:
                    found.append(settled(held))
                now, held = bucket, []
            if kind == K.NOTE:
                found += [C.unblob(x, K.PLACES) for x in blobs]
            else:
                held += [C.unblob(x, kinds) for x in blobs]
            yield from step(TRIGGERS)
        if held:
            found.append(settled(held))
        held = []
        yield from step(0)
        C.trim()

    return run


def phrase_kinds(side: int) -> list:
    return [np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint16, np.uint16, np.dtype(f"V{side}"), np.dtype(f"V{side}")]


def phrases(length: int, trigger: int, parts: int):
    """handler for K.meet, with the sorted keys of the noted places: phrases that end in a recurring trigger, to the buckets of what all their windows have.

    A phrase's windows that start at most half of the reach before the trigger, and those that start earlier,
    go to buckets of their own: all of the former have the bytes that follow the trigger, all of the latter
    those before it, so a bucket's strings are longer than a trigger alone.
    """
    side = length - trigger
    half = side // 2

    def handler():
        held: list[tuple] = []

        def step():
            k1, k2, key, tie, place, lo, hi, left, right, whole = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # Equal phrases of a step: all but the first are settled.
            order = np.lexsort((place, tie, key, whole))
            head = np.append(True, whole[order[1:]] != whole[order[:-1]])
            lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            later = order[(key[order] != key[lead]) | (tie[order] != tie[lead]) | (place[order] != place[lead])]
            s = place[later].astype(np.int64)
            yield from K.notes(parts, *K.coalesced(key[later], tie[later], s - hi[later], s - lo[later] + length))
            one = order[head]
            bucket = ((k1[one] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            got = [*K.packed(bucket, k1[one], k2[one], key[one], tie[one], place[one], lo[one], hi[one], left[one], right[one])]
            yield C.batch(K.STEP, np.full(len(got), K.TEXT, np.int32), [b for b, _ in got], [x for _, x in got])

        def handle(known: np.ndarray, docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if not len(known):
                return
            for part, data, offs in C.chunks(iter([docs]), "text", back=False):
                if len(data) < length:
                    continue
                raw = data.astype(np.uint64) + np.uint64(1)
                sums = C.prefix_sums(raw)
                first, last, at = first_triggers(sums, offs, length, trigger)
                if not len(at):
                    continue
                row = np.searchsorted(offs, at, "right") - 1
                key, tie = (part.column(c).to_numpy() for c in ("key_", "tie_"))
                mine = K.place_key(key[row], tie[row], at - offs[row])
                there = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
                first, last, at, row = (x[there] for x in (first, last, at, row))
                if not len(at):
                    continue
                sums2 = C.prefix_sums(raw, C._ODD2)
                near, far = at - last <= half, at - first > half
                pick = np.concatenate([np.flatnonzero(near), np.flatnonzero(far)])
                a, r = at[pick], row[pick]
                is_near = np.arange(len(pick)) < near.sum()
                lo = np.where(is_near, a - last[pick], np.maximum(a - last[pick], half + 1))
                hi = np.where(is_near, np.minimum(a - first[pick], half), a - first[pick])
                for i in range(0, len(pick), PHRASES):
                    x = slice(i, i + PHRASES)
                    held.append(columns(data, sums, sums2, a[x], lo[x], hi[x], is_near[x], key[r[x]], tie[r[x]], (a - offs[r])[x]))
                    if sum(len(x[0]) for x in held) >= PHRASES:
                        yield from step()
                del raw, sums, sums2

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                yield from step()

        return handle, finish

    def columns(data, sums, sums2, a, lo, hi, is_near, key, tie, place) -> tuple:
        """The phrases' rows: what all their windows have (two hashes), where they are, and the bytes around the trigger."""
        s, e = np.where(is_near, a, a - half - 1), np.where(is_near, a + length - half, a + trigger)
        k1, k2 = C.span_hash(sums, s, e), C.span_hash(sums2, s, e, C._ODD2)
        whole = C.mix(C.span_hash(sums, a - hi, a - lo + length) ^ C.mix(k2)) + lo.astype(np.uint64)
        reach = np.arange(side, dtype=np.int32)
        at = a.astype(np.int32)[:, None]
        left = np.where(reach < hi[:, None], data[np.maximum(at - 1 - reach, 0)], 0).astype(np.uint8)
        right = np.where(reach < (side - lo)[:, None], data[np.minimum(at + trigger + reach, len(data) - 1)], 0).astype(np.uint8)
        void = np.dtype(f"V{side}")
        return k1, k2, key, tie, place.astype(np.int32), lo.astype(np.uint16), hi.astype(np.uint16), left.view(void).ravel(), right.view(void).ravel(), whole

    return handler


def classes(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings within groups: their order, and how many bytes each has in common with the one before (-1 in another group)."""
    n, side = strings.shape
    wide = np.zeros((n, -(-side // 8) * 8), np.uint8)
    wide[:, :side] = strings
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    common = np.full(n, -1)
    differ = strings[order[1:]] != strings[order[:-1]]
    common[1:] = np.where(differ.any(1), differ.argmax(1), side)
    common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def class_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Each string's class by its group and first `depth` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum.accumulate(np.where(common < depth, np.arange(len(order)), 0))
    return out


def earlier(k1, k2, key, tie, place, lo, hi, left, right, side: int) -> tuple[np.ndarray, ...]:
    """Spans (key, tie, start, end) of the windows of a bucket's phrases that also start earlier."""
    order = np.lexsort((place, tie, key))  # corpus order
    k1, k2, key, tie, place, lo, hi, left, right = (x[order] for x in (k1, k2, key, tie, place, lo, hi, left, right))
    left, right = (np.ascontiguousarray(x).view(np.uint8).reshape(len(k1), side) for x in (left, right))
    by = np.lexsort((k2, k1))
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(np.append(False, (k1[by[1:]] != k1[by[:-1]]) | (k2[by[1:]] != k2[by[:-1]])))
    # Phrases alone in their group have nothing to meet.
    pick = np.flatnonzero(np.bincount(group)[group] > 1)
    key, tie, place, lo, hi, left, right, group = (x[pick] for x in (key, tie, place, lo, hi, left, right, group))
    flag = np.zeros((len(pick), side + 2), bool)
    if len(pick):
        suffixes, follow = classes(group, left), classes(group, right)
        for d in range(side + 1):
            sel = np.flatnonzero((lo <= d) & (d <= hi))
            if not len(sel):
                continue
            name = class_at(*suffixes, d)[sel] << 32 | class_at(*follow, side - d)[sel]
            o = np.argsort(name, kind="stable")
            head = np.append(True, name[o[1:]] != name[o[:-1]])
            lead = sel[o[np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))]]
            x = sel[o]
            flag[x, d] = (key[x] != key[lead]) | (tie[x] != tie[lead]) | (place[x] != place[lead])
    on = flag[:, :-1] & ~np.concatenate([np.zeros((len(pick), 1), bool), flag[:, :-2]], 1)
    off = flag[:, :-1] & ~flag[:, 1:]
    (row, d0), (_, d1) = np.nonzero(on), np.nonzero(off)
    return key[row], tie[row], place[row].astype(np.int64) - d1, place[row].astype(np.int64) - d0


def corpus_order(length: int, trigger: int, parts: int, most: int):
    """Windows that also start earlier, as notes of spans; windows of buckets with more than `most` phrases one by one (ALONE)."""
    side = length - trigger
    kinds = phrase_kinds(side)

    def settle(held, found: K.Gathered):
        if held:
            key, tie, s, e = earlier(*(np.concatenate(x) for x in zip(*held, strict=True)), side)
            yield from found.add(key, tie, s, e + length)

    def alone(bucket, columns):
        """Each window as its own row: a hash of both classes' bytes, and where it is."""
        k1, k2, key, tie, place, lo, hi, left, right = columns
        left, right = (np.ascontiguousarray(x).view(np.uint8).reshape(len(k1), side) for x in (left, right))
        for d in range(side + 1):
            sel = np.flatnonzero((lo <= d) & (d <= hi))
            if len(sel):
                both = np.concatenate([left[sel, :d], right[sel, : side - d]], 1).ravel()
                at = np.arange(len(sel)) * side
                h = [C.span_hash(C.prefix_sums(both.astype(np.uint64) + np.uint64(1), odd), at, at + side, odd) for odd in (C._ODD, C._ODD2)]
                h = [C.mix(x ^ C.mix(k[sel])) + np.uint64(d) for x, k in zip(h, (k1, k2), strict=True)]
                yield C.batch(K.STEP, [K.ALONE], [bucket], [C.blob(*h, key[sel], tie[sel], (place[sel] - d).astype(np.int32))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, found = None, [], 0, K.Gathered(parts)
        for kind, bucket, blobs in K.by_bucket(batches):
            if bucket != now:
                yield from settle(held, found)
                now, held, size = bucket, [], 0
            if kind != K.TEXT:
                for x in blobs:
                    yield from found.add(*C.unblob(x, K.SPANS))
                continue
            for x in blobs:
                held.append(C.unblob(x, kinds))
                size += len(held[-1][0])
                if size > most:  # from here on the bucket is passed on
                    for h in held:
                        yield from alone(bucket, h)
                    held = []
        yield from settle(held, found)
        yield from found.flush()
        held = []
        C.trim()

    return run


def repeated_spans(rows: DataFrame, length: int, trigger: int, parts: int, most: int) -> DataFrame:
    """Notes (key, tie, s, e) on rows (key_, tie_, bucket_, text): bytes covered by windows that also start earlier."""
    texts = rows.where("key_ is not null and text is not null").select("key_", "tie_", "bucket_", "text")
    dealt = texts.select("key_", "tie_", "text").mapInArrow(parse(length, trigger, parts), K.STEPS).repartition("bucket").sortWithinPartitions("bucket", "kind")
    places = C.materialize(dealt.mapInArrow(recurring(parts), K.STEPS).select("bucket", "blob"), "triggers")
    found = K.meet(texts, places, K.PLACES, lambda own: np.sort(K.place_key(*own)), phrases(length, trigger, parts), K.STEPS, ["text"])
    dealt = found.repartition("bucket").sortWithinPartitions("bucket", "kind")
    steps = C.materialize(dealt.mapInArrow(corpus_order(length, trigger, parts, most), K.STEPS), "phrases")
    alone = K.windows_alone(steps, length, parts)
    spans = steps.where(F.col("kind") == K.NOTE)
    if not steps.where(F.col("kind") == K.ALONE).isEmpty():
        spans = C.materialize(spans.unionByName(alone), "spans")
    return spans.select("bucket", "blob")


def suffix_dedup(docs: DataFrame, length: int = 100, trigger: int = 64, bucket_phrases: int = BUCKET) -> DataFrame:
    """The rows of docs plus n_bytes, n_removed, n_spans and kept (binary: the UTF-8 bytes that stay).

    Each byte covered by a `length`-byte string that also starts earlier (smaller doc_id, or the same
    document, earlier start) is removed; n_spans counts the maximal runs removed. Null text counts as
    empty. Rows without doc_id lose nothing. Rows that share a doc_id but not the text are documents of
    their own, ordered by a hash of the text; a repeated row is no earlier start. An empty table gives an
    empty one. Other columns pass unchanged; columns with the names of the new ones are replaced.
    """
    parts = K.buckets(docs)
    rows = K.keyed(docs, parts)
    spans = repeated_spans(rows, length, trigger, parts, bucket_phrases)

    def make(raw: bytes | None, cut: list[tuple[int, int]]) -> tuple:
        raw = raw or b""
        left, at = [], 0
        for a, b in cut:
            left.append(raw[at:a])
            at = b
        kept = b"".join([*left, raw[at:]])
        return len(raw), len(raw) - len(kept), len(cut), kept

    return R.rebuilt(docs, rows, spans, [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")], make)
