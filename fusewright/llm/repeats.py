"""Repeated passages: windows of k units that also start earlier, found by super-k-mers.

Consecutive windows that share a minimiser (the least hash of an m-gram in the window) travel as
one packed string to the bucket of that minimiser; equal windows share the minimiser, so they meet
in one bucket, where sorting finds each window's earliest start. Only windows of documents move,
never pairs, and copies within a map chunk are settled before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.llm import common as C
from fusewright.llm import rows as K

SEGMENTS = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), ("key", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
SEGMENTS_DDL = "bucket int, packed binary, key long, tie long, start int, n int"
#: Different windows of one bucket that are kept at a time; from there on they are told apart one by one, by Spark's sort.
BUCKET = 1 << 21


class Packer:
    """Packs strings one by one with zstd and a dictionary of common strings, so that short ones shrink too."""

    def __init__(self, common: bytes):
        self.common = common
        self.both = None

    def __getstate__(self):
        return {"common": self.common, "both": None}

    def codecs(self):
        if self.both is None:
            import zstandard as Z

            d = Z.ZstdCompressionDict(self.common) if self.common else None
            p = Z.ZstdCompressionParameters.from_level(3, format=Z.FORMAT_ZSTD1_MAGICLESS, write_content_size=1, write_checksum=0, write_dict_id=0)
            if d:
                d.precompute_compress(compression_params=p)
            self.both = Z.ZstdCompressor(compression_params=p, dict_data=d), Z.ZstdDecompressor(dict_data=d, format=Z.FORMAT_ZSTD1_MAGICLESS)
        return self.both

    def pack(self, strings: list[bytes]) -> list[bytes]:
        return [*map(self.codecs()[0].compress, strings)]

    def unpack(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        strings = [*map(self.codecs()[1].decompress, column.to_pylist())]
        offs = np.zeros(len(strings) + 1, np.int64)
        np.cumsum([*map(len, strings)], out=offs[1:])
        return np.frombuffer(b"".join(strings), np.uint8), offs


def packer(docs: DataFrame, texts: int = 300) -> Packer:
    """The dictionary comes from the beginnings of a few texts: it decides how small strings get, nothing else."""
    import zstandard as Z

    some = [r[0].encode() for r in docs.where("text is not null").select(F.substring("text", 1, 3000)).limit(texts).collect()]
    strings = [x[i : i + 150] for x in some for i in range(0, len(x), 150)]
    try:
        return Packer(Z.train_dictionary(1 << 16, strings).as_bytes())
    except Z.ZstdError:  # too few
        return Packer(b"")


def whole_windows(firsts: np.ndarray, n: int, k: int) -> np.ndarray:
    """True where k units from there on lie in one document; firsts: each document's first unit, and the end."""
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(n)
    return left >= k


def super_kmers(grams: np.ndarray, valid: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run of whole windows with one minimiser, and that minimiser."""
    n = len(valid)
    if not valid.any():
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    full = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(grams)] = grams
    least = C.sliding_min(full, k - m + 1)
    same = np.zeros(n, bool)
    same[1:] = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    first = valid & ~same
    last = valid.copy()
    last[:-1] &= ~same[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return first, last, least[first]


def short(keys: np.ndarray) -> np.ndarray:
    """A bucket's number: 32 bits of the key. Keys that share it share a bucket, where windows are told apart anyway."""
    return (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)


def cut(k: int, m: int, packs: Packer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map side: documents to super-k-mers. A row without packed string is a run that is known to start earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in C.chunks(batches, "text"):
            if not len(data):
                continue
            starts, ends, firsts = C.word_spans(data, offs)
            values = C.word_hashes(data, starts, ends)
            n = len(values)
            if n < k:
                continue
            sums = C.prefix_sums(values)
            valid = whole_windows(firsts, n, k)
            first, last, least = super_kmers(C.rolling_hash(sums, m), valid, k, m)
            if not len(first):
                continue
            row = np.searchsorted(firsts, first, "right") - 1
            key, tie = (part.column(c).to_numpy()[row] for c in ("key_", "tie_"))
            begin, count = first - firsts[row], last - first + 1
            content = C.span_hash(sums, first, last + k)
            order = np.lexsort((begin, tie, key, content))
            head = np.ones(len(order), bool)
            head[1:] = content[order[1:]] != content[order[:-1]]
            lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            later = (key[order] != key[lead]) | (tie[order] != tie[lead]) | (begin[order] != begin[lead])
            keep, known = order[head], order[later]
            keep.sort()
            raw = data.tobytes()
            packed = pa.array(packs.pack([raw[x:y] for x, y in zip(starts[first[keep]].tolist(), ends[last[keep] + k - 1].tolist(), strict=True)]), pa.binary())
            yield C.batch(SEGMENTS, short(least[keep]), packed, C.as_long(key[keep]), C.as_long(tie[keep]), begin[keep], np.zeros(len(keep), np.int32))
            if len(known):
                key, tie, s, e = K.coalesced(key[known], tie[known], begin[known], begin[known] + count[known] - 1 + k)
                spread = C.mix(key.astype(np.uint64))
                yield C.batch(SEGMENTS, short(spread), pa.nulls(len(s), pa.binary()), C.as_long(key), C.as_long(tie), s, e - s)

    return run


def spans_of(flag: np.ndarray, row: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows of one row as spans of units: their first windows' places, starts and ends."""
    on = flag.copy()
    on[1:] &= ~(flag[:-1] & (row[1:] == row[:-1]))
    off = flag.copy()
    off[:-1] &= ~(flag[1:] & (row[1:] == row[:-1]))
    a, b = np.flatnonzero(on), np.flatnonzero(off)
    return a, start[a], start[b] + k


def settle(k: int, parts: int, packs: Packer, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bucket side. Rows come ordered by bucket, document and start, so the first of equal windows is the earliest.

    What is carried from batch to batch are the different windows of the bucket that is still open, up to
    `most`; with more, the bucket's windows from there on are passed on one by one (ALONE).
    """
    identify = identify_words(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bucket, over, found = None, False, K.Gathered(parts)
        none = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]
        carry = none
        for b in batches:
            if not b.num_rows:
                continue
            is_known = b.column("packed").is_null().to_numpy(zero_copy_only=False)
            if is_known.any():
                t = b.filter(pa.array(is_known))
                s = t.column("start").to_numpy().astype(np.int64)
                yield from found.add(t.column("key").to_numpy(), t.column("tie").to_numpy(), s, s + t.column("n").to_numpy())
                b = b.filter(pa.array(~is_known))
                if not b.num_rows:
                    continue
            bucket = b.column("bucket").to_numpy()
            data, offs = packs.unpack(b.column("packed"))
            h1, h2, lead = identify(data, offs)
            row = np.repeat(np.arange(b.num_rows), np.diff(lead))
            key, tie = (b.column(c).to_numpy()[row] for c in ("key", "tie"))
            start = b.column("start").to_numpy().astype(np.int64)[row] + (np.arange(len(row)) - lead[row])
            if open_bucket != bucket[0]:
                carry, over = none, False
            if over:
                of = bucket[row] == open_bucket
                yield C.batch(K.STEP, [K.ALONE], [0], [C.blob(h1[of], h2[of], key[of], tie[of], start[of].astype(np.int32))])
                if bucket[-1] == open_bucket:
                    continue
                h1, h2, key, tie, start, row = (x[~of] for x in (h1, h2, key, tie, start, row))
                over = False
            old = len(carry[0])
            h1, h2, key, tie, start = (np.concatenate(p) for p in zip(carry, (h1, h2, key, tie, start), strict=True))
            order = np.argsort(h1, kind="stable")
            a, c = h1[order], h2[order]
            if ((a[1:] == a[:-1]) & (c[1:] != c[:-1])).any():
                order = np.lexsort((np.arange(len(h1)), h2, h1))
                a, c = h1[order], h2[order]
            head = np.ones(len(order), bool)
            head[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            flag = np.zeros(len(order), bool)
            flag[order] = (key[order] != key[first]) | (tie[order] != tie[first]) | (start[order] != start[first])
            at, s, e = spans_of(flag[old:], row, start[old:], k)
            yield from found.add(key[old:][at], tie[old:][at], s, e)
            stays = np.concatenate([np.full(old, bucket[-1] == open_bucket), (bucket == bucket[-1])[row]])
            open_bucket = bucket[-1]
            kept = np.sort(order[head])
            kept = kept[stays[kept]]
            carry = [h1[kept], h2[kept], key[kept], tie[kept], start[kept]]
            if len(kept) > most:
                yield C.batch(K.STEP, [K.ALONE], [0], [C.blob(*carry[:4], carry[4].astype(np.int32))])
                carry, over = none, True
        yield from found.flush()
        C.trim()

    return run


def identify_words(k: int):
    def run(data: np.ndarray, offs: np.ndarray):
        starts, ends, firsts = C.word_spans(data, offs)
        values = C.word_hashes(data, starts, ends)
        valid = whole_windows(firsts, len(values), k)
        at = np.flatnonzero(valid)
        h1 = C.rolling_hash(C.prefix_sums(values), k)[at]
        h2 = C.rolling_hash(C.prefix_sums(C.mix(values, 7)), k, salt=3)[at]
        return h1, h2, np.searchsorted(at, firsts)

    return run


def repeated_spans(rows: DataFrame, k: int, m: int, parts: int, most: int) -> DataFrame:
    """Notes (key, tie, s, e) on rows (key_, tie_, text): spans of words covered by windows that also start earlier, written in the shared folder."""
    rows = rows.where("key_ is not null and text is not null").select("key_", "tie_", "text")
    packs = packer(rows)
    cut_rows = rows.mapInArrow(cut(k, m, packs), SEGMENTS_DDL)
    dealt = cut_rows.repartition("bucket").sortWithinPartitions("bucket", "key", "tie", "start")
    steps = C.materialize(dealt.mapInArrow(settle(k, parts, packs, most), K.STEPS), "spans")
    spans = steps.where(F.col("kind") == K.NOTE)
    if not steps.where(F.col("kind") == K.ALONE).isEmpty():
        spans = C.materialize(spans.unionByName(K.windows_alone(steps, k, parts)), "spans")
    return spans.select("bucket", "blob")


def merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Spans in order of their starts, overlapping or touching ones joined."""
    if len(s) < 2:
        return [*zip(s.tolist(), e.tolist(), strict=True)]
    far = np.maximum.accumulate(e)
    begin = np.flatnonzero(np.append(True, s[1:] > far[:-1]))
    return [*zip(s[begin].tolist(), far[np.append(begin[1:], len(s)) - 1].tolist(), strict=True)]


def rebuilt(docs: DataFrame, rows: DataFrame, spans: DataFrame, fields: list[tuple[str, str]], make: Callable) -> DataFrame:
    """The columns of docs but those of the fields, and the fields that make(text as bytes or None, merged spans) gives for each row."""
    made = [n for n, _ in fields]
    names = [c for c in docs.columns if c not in made]
    empty = docs.select(*(F.col(f"`{n}`") for n in names), *(F.lit(None).cast(t).alias(n) for n, t in fields)).schema
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    taken = [f"c{i}" for i, c in enumerate(docs.columns) if c in names and c != "text"]
    text, docs_at = "text", {c: i for i, c in enumerate(docs.columns)}

    def prepare(own):
        key, tie, s, e = own
        h = K.place_key(key, tie)
        order = np.lexsort((s, h))
        return h[order], s[order].astype(np.int64), e[order].astype(np.int64)

    def handle(own, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h, s, e = own
        for piece, data, offs in C.chunks(iter([part]), text, back=False):
            no_key = piece.column("key_").is_null().to_numpy(zero_copy_only=False)
            mine = K.place_key(piece.column("key_").fill_null(0).to_numpy(), piece.column("tie_").to_numpy())
            lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            hi[no_key] = lo[no_key]
            raw, null = data.tobytes(), piece.column(text).is_null().to_pylist()
            out = [make(None if null[i] else raw[offs[i] : offs[i + 1]], merged(s[lo[i] : hi[i]], e[lo[i] : hi[i]])) for i in range(piece.num_rows)]
            cols = [piece.column(text if c == text else f"c{docs_at[c]}") for c in names] + [pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *made])

    return K.meet(rows, spans, K.SPANS, prepare, lambda: (handle, lambda: iter(())), empty, [*taken, text])


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 4, layout: bool = False, bucket_windows: int = BUCKET) -> DataFrame:
    """The rows of docs plus n_words, n_removed and kept (the text of the words that stay).

    Each word covered by a window of `window` words whose word sequence also starts earlier is removed;
    kept words are joined by one space. With layout a text that loses nothing stays as it is. Null text:
    no words, kept is null. Rows without doc_id lose nothing. Rows that share a doc_id but not the text are
    documents of their own, ordered by a hash of the text; a repeated row is no earlier start. An empty
    table gives an empty one. Other columns pass unchanged; columns with the names of the new ones are replaced.
    """
    parts = K.buckets(docs)
    rows = K.keyed(docs, parts)
    spans = repeated_spans(rows, window, gram, parts, bucket_windows)

    def make(raw, cut_):
        words = raw.split() if raw is not None else []
        if raw is None or layout and not cut_:
            return len(words), 0, raw if raw is None else raw.decode()
        left, at = [], 0
        for a, b in cut_:
            left += words[at:a]
            at = b
        left += words[at:]
        return len(words), len(words) - len(left), b" ".join(left).decode()

    return rebuilt(docs, rows, spans, [("n_words", "long"), ("n_removed", "long"), ("kept", "string")], make)
