"""Rows told apart by doc_id and text, and notes on them that meet their texts again without a join by key.

A note is what an operator found out about places of a document. Notes and documents are dealt to
buckets by the document's key; in each bucket the notes come first, packed, and the texts then stream by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.llm import common as C

#: Buckets for each shuffle partition, so that partitions are even.
FOLD = 2
#: doc_ids with different texts up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 100_000
#: Rows of a step: text for a bucket, a note for documents of a bucket, or a window told apart on its own.
STEPS = "kind int, bucket int, blob binary"
STEP = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
TEXT, NOTE, ALONE = 0, 1, 2
#: Columns of notes on places, and on spans: key, tie, place; key, tie, start, end.
PLACES = [np.int64, np.int64, np.int32]
SPANS = [np.int64, np.int64, np.int32, np.int32]


def buckets(docs: DataFrame) -> int:
    return C.prime_from(FOLD * C.shuffle_partitions(docs.sparkSession))


def keyed(docs: DataFrame, parts: int) -> DataFrame:
    """The columns of docs as c0, c1, ... in order, and key_, tie_, bucket_ and text.

    key_ is doc_id. tie_ is 0, but for rows that share a doc_id with another text the hash of the text: rows
    with one doc_id and different texts are different documents, in the order of that hash, and rows with
    equal doc_id and text are one. bucket_ follows from both; rows without a doc_id, on which there are no notes, go
    round the buckets.
    """
    key, h = F.col("doc_id").cast("long"), F.xxhash64("text")
    each = docs.select(key.alias("key_"), h.alias("h")).where("key_ is not null").groupBy("key_").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    shared = C.materialize(each.where("lo <> hi").select("key_"), "shared_ids")
    n = shared.count()
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), key.alias("key_"), h.alias("h_"), F.col("text"))
    if n:
        shared = shared.withColumn("tie_", F.lit(True))
        out = out.join(F.broadcast(shared) if n <= BROADCAST_IDS else shared, "key_", "left").withColumn("tie_", F.when(F.col("tie_"), F.col("h_")).otherwise(F.lit(0).cast("long")))
    else:
        out = out.withColumn("tie_", F.lit(0).cast("long"))
    spread = F.pmod(F.pmod("key_", F.lit(parts)) + F.pmod("tie_", F.lit(parts)), F.lit(parts))
    return out.withColumn("bucket_", F.coalesce(spread, F.pmod(F.monotonically_increasing_id(), F.lit(parts))).cast("int")).drop("h_")


def bucket_of(key: np.ndarray, tie: np.ndarray, parts: int) -> np.ndarray:
    """As keyed() has it."""
    return ((key % parts + tie % parts) % parts).astype(np.int32)


def place_key(key: np.ndarray, tie: np.ndarray, place: np.ndarray | int = 0) -> np.ndarray:
    """A hash of a document and a place in it."""
    return C.mix(C.mix(key.astype(np.uint64)) + C.mix(tie.astype(np.uint64), 5)) + np.asarray(place).astype(np.uint64)


def packed(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The columns' rows by bucket, packed."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    columns = [c[order] for c in columns]
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)], strict=False):
        yield int(b[s]), C.blob(*(c[s:e] for c in columns))


def notes(parts: int, key, tie, *columns, kind: int = NOTE) -> Iterator[pa.RecordBatch]:
    """Notes on documents, packed for their buckets."""
    got = [*packed(bucket_of(key, tie, parts), key, tie, *columns)]
    if got:
        yield C.batch(STEP, np.full(len(got), kind, np.int32), [b for b, _ in got], [x for _, x in got])


def coalesced(key, tie, s, e) -> tuple[np.ndarray, ...]:
    """Spans in order, those that overlap or touch joined."""
    order = np.lexsort((s, tie, key))
    key, tie, s, e = (x[order] for x in (key, tie, s, e))
    if not len(s):
        return key, tie, s.astype(np.int32), e.astype(np.int32)
    same = np.append(False, (key[1:] == key[:-1]) & (tie[1:] == tie[:-1]))
    # The largest end so far in the document, by lifting each document above the one before.
    lift = np.cumsum(~same) * (1 << 33)
    far = np.maximum.accumulate(e + lift) - lift
    begin = np.flatnonzero(~(same & np.append(False, s[1:] <= far[:-1])))
    return key[begin], tie[begin], s[begin].astype(np.int32), np.maximum.reduceat(e, begin).astype(np.int32)


class Gathered:
    """Spans that a task gathers, so that a note holds many: rows are few however many buckets there are."""

    def __init__(self, parts: int, most: int = 1 << 18):
        self.parts, self.most, self.held, self.size = parts, most, [], 0

    def add(self, key, tie, s, e) -> Iterator[pa.RecordBatch]:
        if len(s):
            self.held.append((key, tie, s.astype(np.int64), e.astype(np.int64)))
            self.size += len(s)
            if self.size >= self.most:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from notes(self.parts, *coalesced(*(np.concatenate(x) for x in zip(*self.held, strict=True))))
            self.held, self.size = [], 0


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(kind, bucket, blobs) of rows that come in order of bucket and kind, as many as a batch has at a time."""
    for b in batches:
        if not b.num_rows:
            continue
        bucket, kind = b.column("bucket").to_numpy(), b.column("kind").to_numpy()
        cuts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], strict=True):
            yield int(kind[s]), int(bucket[s]), b.column("blob").slice(s, e - s).to_pylist()


def windows_alone(steps: DataFrame, length: int, parts: int) -> DataFrame:
    """Notes of spans for the windows that were passed on one by one."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("blob").to_pylist():
                h1, h2, key, tie, s = C.unblob(x, [np.uint64, np.uint64, *PLACES])
                yield pa.RecordBatch.from_arrays([C.as_long(h1), C.as_long(h2), C.as_long(key), C.as_long(tie), pa.array(s)], names=["h1", "h2", "key", "tie", "s"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, tie, s = (b.column(c).to_numpy().astype(np.int64) for c in ("key", "tie", "s"))
            yield from notes(parts, *coalesced(key, tie, s, s + length))

    each = steps.where(F.col("kind") == ALONE).select("blob").mapInArrow(unpack, "h1 long, h2 long, key long, tie long, s int").distinct()
    by = W.partitionBy("h1", "h2").orderBy("key", "tie", "s")
    later = each.withColumn("n", F.row_number().over(by)).where("n > 1").select("key", "tie", "s")
    return later.mapInArrow(pack, STEPS)


def meet(rows: DataFrame, found: DataFrame, kinds: list, prepare: Callable, handler: Callable, ddl, columns: list[str]) -> DataFrame:
    """The documents (rows of keyed(), with the given columns) of each bucket, with the notes on them.

    handler() gives each task a function handle(prepare(notes), documents), which gets a bucket's notes as
    prepare made them of arrays and a record batch with key_, tie_ and the columns, and one for the task's
    end; what these yield are the batches of the result.
    """
    names = list(columns)
    texts = rows.select("bucket_", F.lit(1).alias("kind_"), F.lit(None).cast("binary").alias("blob_"), "key_", "tie_", *names)
    kind_of = {c: rows.schema[c].dataType for c in names}
    first = found.select(F.col("bucket").alias("bucket_"), F.lit(0).alias("kind_"), F.col("blob").alias("blob_"), F.lit(None).cast("long").alias("key_"), F.lit(None).cast("long").alias("tie_"), *(F.lit(None).cast(t).alias(n) for n, t in kind_of.items()))
    both = first.unionByName(texts).repartition("bucket_").sortWithinPartitions("bucket_", "kind_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, (handle, finish) = [np.zeros(0, k) for k in kinds], handler()
        now, held, own = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            bucket, kind = b.column("bucket_").to_numpy(), b.column("kind_").to_numpy()
            cuts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])))
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], strict=True):
                if bucket[s] != now:
                    now, held, own = bucket[s], [], None
                if kind[s] == 0:
                    held += [C.unblob(x, kinds) for x in b.column("blob_").slice(s, e - s).to_pylist()]
                    continue
                if own is None:
                    own = prepare([np.concatenate(x) for x in zip(*held, strict=True)] if held else none)
                    held = []
                yield from handle(own, b.slice(s, e - s).select(["key_", "tie_", *names]))
        yield from finish()
        C.trim()

    return both.mapInArrow(run, ddl)
