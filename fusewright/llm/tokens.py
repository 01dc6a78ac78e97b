"""Tokens of whole documents: encoder, offset-mapped attribution (operator 8), best-fit packing (operator 10).

A vocabulary whose pre-tokenizer never crosses white space gives a document the ids of its white-space-free
words in turn. Each different word then goes through the tokenizers library once per worker (a bounded table),
which gives the very ids and offsets of encoding the document whole. Whether a vocabulary is of that kind is
probed when it is loaded; documents of any other are encoded whole, one by one.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.llm import common as C

#: Words that a worker remembers before it starts afresh: bounds its memory, not what is encoded.
WORDS_KEPT = 700_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Grown:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values) -> None:
        values = np.asarray(values, self.room.dtype)
        if self.n + len(values) > len(self.room):
            room = np.zeros(2 * max(len(self.room), self.n + len(values)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


#: Texts on which a vocabulary must show that it encodes words apart, and marks at their ends, and A-Z as a-z.
PROBES = ["one two", "one  two \t three", " lead and trail ", "a\nb\r\nc\x0bd", "The End, said Ann. Then... (no) 1,000.50 e.g. x.", "don't re-do it's_all", "é è ñ ß.", "ab12. a1b2, 77.", "\u00a0x\u2003y", "AbC DEF", ".", ",", "$a. b$, %.", "x." * 40, "long" * 60]


def stitches(encoder, text: str) -> bool:
    """Whether the text's ids and spans, encoded whole, are those of its lower-cased words, a full stop or comma after a letter or digit apart."""
    whole = encoder.encode(text, add_special_tokens=False)
    ids, spans = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        own = re.fullmatch(r"(.*[A-Za-z0-9])([.,])", m.group(), re.S)
        for at, part in ([(m.start(), own[1]), (m.start() + len(own[1]), own[2])] if own else [(m.start(), m.group())]):
            e = encoder.encode("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in part), add_special_tokens=False)
            ids += e.ids
            spans += [(a + at, b + at) for a, b in e.offsets]
    return whole.ids == ids and whole.offsets == spans


class WordTable:
    """Ids, and if asked character spans, of the words met so far, by a 64-bit hash of their bytes."""

    def __init__(self, path: str, spans: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = self.encoder = Tokenizer.from_file(path)
        self.by_words = all(stitches(encoder, x) for x in PROBES)
        self.encode = encoder.encode_batch if spans else encoder.encode_batch_fast
        self.with_spans = spans
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.count, self.ids, self.spans = Grown(np.int32), Grown(np.int32), Grown(np.uint32), Grown(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those not met."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.places[at], -1)

    def take(self, hashes: list[int], words: list[bytes]) -> None:
        """Encodes words and keeps what comes of them under their hashes."""
        done = self.encode([w.decode() for w in words], add_special_tokens=False)
        ids = [e.ids for e in done]
        self.keep(hashes, ids, [e.offsets for e in done] if self.with_spans else [])

    def keep(self, hashes: list[int], ids: list[list[int]], spans: list) -> None:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.array(hashes, np.uint64)
        order = np.argsort(new)
        at = np.searchsorted(self.keys, new[order])
        self.keys = np.insert(self.keys, at, new[order])
        self.places = np.insert(self.places, at, (self.first.n + order).astype(np.int32))
        self.first.add(self.ids.n + np.cumsum(n) - n)
        self.count.add(n)
        self.ids.add(np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())))
        if self.with_spans:
            self.spans.add(np.fromiter(chain.from_iterable(chain.from_iterable(spans)), np.int32, 2 * int(n.sum())))

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word. Words not met before are encoded, but for a full stop or comma after a
        letter or digit at a word's end, which is a token of its own, so that the rest's ids serve both."""
        sums = C.prefix_sums(data.astype(np.uint64) + np.uint64(1))
        unique, at, back = np.unique(C.span_hash(sums, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) and len(self.keys) + len(unique) > WORDS_KEPT:
            self.clear()
        miss = np.flatnonzero(self.find(unique) < 0)
        if len(miss):
            raw = data.tobytes()
            s, e = starts[at[miss]], ends[at[miss]]
            cut = (e - s > 1) & np.isin(data[e - 1], (0x2E, 0x2C)) & _ALNUM[data[np.maximum(e - 2, 0)]]
            own = np.where(cut, e - 1, e)
            base = C.span_hash(sums, s, own)
            absent = np.flatnonzero(self.find(base) < 0)
            fresh = {h: raw[a:b] for h, a, b in zip(base[absent].tolist(), s[absent].tolist(), own[absent].tolist(), strict=True)}
            marks = np.array([0, 0], np.uint64)
            for i, mark in enumerate((b".", b",")):
                d = np.frombuffer(mark, np.uint8)
                marks[i] = C.span_hash(C.prefix_sums(d.astype(np.uint64) + np.uint64(1)), np.array([0]), np.array([1]))[0]
            fresh |= {int(h): m for h, m, p in zip(marks, (b".", b","), self.find(marks), strict=True) if p < 0}
            self.take([*fresh], [*fresh.values()])
            end = self.first.room[self.find(marks)].tolist()
            ids, spans, hashes = [], [], unique[miss[cut]].tolist()
            for j, p in zip(np.flatnonzero(cut).tolist(), self.find(base[cut]).tolist(), strict=True):
                a, n = int(self.first.room[p]), int(self.count.room[p])
                ids.append([*self.ids.room[a : a + n].tolist(), int(self.ids.room[end[int(data[e[j] - 1] == 0x2C)]])])
                if self.with_spans:
                    size = len(raw[s[j] : own[j]].decode())
                    spans.append([*self.spans.room[2 * a : 2 * (a + n)].reshape(-1, 2).tolist(), [size, size + 1]])
            self.keep(hashes, ids, spans)
        return self.find(unique)[back]


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_TABLES: dict[tuple[str, bool], WordTable] = {}


def encode(data: np.ndarray, offs: np.ndarray, path: str, spans: bool = False):
    """Ids of the documents of a chunk, each document's first token, and if asked each token's span in code points of its document.

    The vocabulary is lower-case, so A-Z are lowered first, but not where a special token's text could come of it.
    """
    if (path, spans) not in _TABLES:
        _TABLES[path, spans] = WordTable(path, spans)
    table = _TABLES[path, spans]
    if not table.by_words:
        return encode_whole(data, offs, table.encoder, spans)
    low = data if b"<|" in data.tobytes() else C.lower_ascii(data)
    starts, ends, first_word = C.word_spans(low, offs)
    word = table.lookup(low, starts, ends)
    first, count = table.first.room[word].astype(np.int64), table.count.room[word].astype(np.int64)
    token_of = np.concatenate([[0], np.cumsum(count)])
    where = np.repeat(first - token_of[:-1], count) + np.arange(token_of[-1])
    out = table.ids.room[where], token_of[first_word]
    if not spans:
        return out
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first_word))
    base = np.repeat(points[starts] - points[offs[doc]], count)
    both = table.spans.room.reshape(-1, 2)
    return *out, base + both[where, 0], base + both[where, 1]


def encode_whole(data: np.ndarray, offs: np.ndarray, encoder, spans: bool):
    """As encode(), each document by the library."""
    raw = data.tobytes()
    done = encoder.encode_batch([raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], add_special_tokens=False)
    first = np.append(0, np.cumsum([len(e.ids) for e in done]))
    out = np.fromiter(chain.from_iterable(e.ids for e in done), np.uint32, int(first[-1])), first
    if not spans:
        return out
    both = np.array([*chain.from_iterable(e.offsets for e in done)], np.int64).reshape(-1, 2)
    return *out, both[:, 0], both[:, 1]


def lines_of(data: np.ndarray, offs: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's lines, a line feed with the line that it ends: document, start and end in code points of the chunk. An empty text is one line."""
    feeds = np.flatnonzero(data == 0x0A) + 1
    starts = np.union1d(feeds, offs[:-1][np.diff(offs) > 0])
    starts = starts[~np.isin(starts, offs[1:]) | np.isin(starts, offs[:-1][np.diff(offs) > 0])]
    doc = np.searchsorted(offs, starts, "right") - 1
    ends = np.append(starts[1:], len(data))
    empty = np.flatnonzero(np.diff(offs) == 0)
    doc, starts, ends = np.append(doc, empty), np.append(starts, offs[empty]), np.append(ends, offs[empty])
    order = np.argsort(doc, kind="stable")
    return doc[order], points[starts[order]], points[ends[order]]


def attribute_tokens(docs: DataFrame, sections: str | None = None, path: str | None = None) -> DataFrame:
    """Tokens of each section of each document: (doc_id, section, start, end, n_tokens, n_crossing, doc_tokens).

    sections: a column array<struct<section: string, start: int, end: int>> of code points, in order and
    without overlaps; none: the document's lines, named "0", "1", ... The document is encoded once, whole;
    each token's character span is joined to the sections' intervals. A token that crosses a boundary belongs
    to the section with most of its characters, on a tie to the earlier one; n_crossing counts those a section
    got. A token outside of all sections counts in doc_tokens only. Sections are cut at the text's end. A
    null or empty text is one line without tokens; a null array has no sections. Repeated rows are counted
    each on its own; an empty table gives an empty one; other columns are left out.
    """
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())])

    def given(part: pa.RecordBatch, base: np.ndarray, size: np.ndarray):
        rows = [(i, x["section"], x["start"], x["end"]) for i, own in enumerate(part.column("sections_").to_pylist()) for x in own or ()]
        doc = np.array([r[0] for r in rows], np.int64)
        start, end = (np.clip(np.array([r[k] for r in rows], np.int64), 0, size[doc]) for k in (2, 3))
        return doc, base[doc] + start, base[doc] + np.maximum(start, end), [r[1] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in C.chunks(batches, "text"):
            _, first, a, b = encode(data, offs, path, spans=True)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = points[offs[:-1]]
            if sections:
                doc, s, e, names = given(part, base, points[offs[1:]] - base)
            else:
                doc, s, e = lines_of(data, offs, points)
                names = (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(str).tolist()
            at = base[np.repeat(np.arange(len(base)), np.diff(first))]
            a, b = at + a, at + np.maximum(b, a + 1)
            # The first section that ends after a token's start, and the last that starts before its end.
            pick, last = np.searchsorted(e, a, "right"), np.searchsorted(s, b, "left") - 1
            inside, cross = last >= pick, np.flatnonzero(last > pick)
            for t in cross.tolist():
                over = np.minimum(e[pick[t] : last[t] + 1], b[t]) - np.maximum(s[pick[t] : last[t] + 1], a[t])
                pick[t] += int(np.argmax(over))
            tokens, crossing = np.bincount(pick[inside], minlength=len(s)), np.bincount(pick[cross], minlength=len(s))
            yield C.batch(schema, part.column("doc_id").take(pa.array(doc)), pa.array(names, pa.string()), s - base[doc], e - base[doc], tokens, crossing, np.diff(first)[doc])

    own = [F.col(f"`{sections}`").alias("sections_")] if sections else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own).mapInArrow(run, "doc_id long, section string, start long, end long, n_tokens long, n_crossing long, doc_tokens long")


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int32()), ("ids", pa.binary())])


def pieces_of(docs: DataFrame, size: int, path: str, end_id: int, with_ids: bool, salts: int) -> DataFrame:
    """Documents as ids, end_id after the last, cut into pieces of `size` only where longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32).tobytes()
        for part, data, offs in C.chunks(batches, "text"):
            ids, first = encode(data, offs, path)
            raw, rows = ids.tobytes(), []
            for doc, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = raw[4 * a : 4 * b] + end
                total = b - a + 1
                for piece, s in enumerate(range(0, total, size)):
                    n = min(size, total - s)
                    x = own[4 * s : 4 * (s + n)]
                    crc = zlib.crc32(x)
                    rows.append((doc, piece, s, n, crc, (crc ^ (doc or 0) * 2654435761) % salts, x if with_ids else None))
            yield C.batch(PIECES, *zip(*rows, strict=True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt int, ids binary")


def plan_slots(histogram: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Best fit over counts, longest first: runs (length, first rank, last rank + 1, first sequence, items each, offset), and the sequences used.

    Sequences with equal room form groups; a length fills the tightest group that has room for it, as
    many to a sequence as fit, which is what best fit would do one by one. The histogram has at most
    `size` lengths, so the plan is small however many documents there are.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    runs, used = [], 0

    def put(left: int, base: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(sizes, left)
            room[left].append((base, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                space = sizes[at]
                base, n = room[space].pop()
                if not room[space]:
                    del room[space], sizes[at]
            else:
                space, base = size, used
                n = -(-left // (size // length))
                used += n
            each = space // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, rank + full * each, base, each, size - space))
                put(space - each * length, base, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left and left < each:
                    runs.append((length, rank, rank + left, base + full, left, size - space))
                    put(space - left * length, base + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(space, base + full, n - full)
    return np.array(runs, np.int64).reshape(-1, 6), used


def pack(docs: DataFrame, size: int = 4096, path: str | None = None, end_id: int = 1, with_ids: bool = False, salts: int = 64) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked).

    The histogram of piece lengths is planned on the driver (at most `size` counts); each piece then takes
    the slot of its rank within its length. The ranks come from counts by (length, salt), so a length that
    very many pieces have is no single task's. Null text is an empty document: its end id alone. Repeated
    rows are packed each on its own. An empty table gives an empty one; other columns are left out. What is
    broadcast are the counts before each salt: at most size * salts rows of three numbers, under 50 MB as it is set.
    """
    path = path or vocabulary_path()
    pieces = C.materialize(pieces_of(docs, size, path, end_id, with_ids, salts), "pieces")
    counts = C.materialize(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_slots(histogram, size)
    before = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    # At most size * salts rows, two numbers each: bounded, whatever the corpus.
    ranked = pieces.withColumn("local", rank).join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("local") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "rank")
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    keys = runs[:, 0] * (1 << 48) + runs[:, 1]
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank_ = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = runs[np.searchsorted(keys, length * (1 << 48) + rank_, "right") - 1]
            inside = rank_ - run[:, 1]
            seq, off = run[:, 3] + inside // run[:, 4], run[:, 5] + inside % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"
    return ranked.mapInArrow(place, ddl)
