"""Shared pieces: the shared work folder, Arrow text buffers and vectorised hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at a time (a longer document is a step of its own).
CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xD1342543DE82EF95)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set and all runs in one process."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="fusewright-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """Notes the paths of the tables that materialize() writes meanwhile, those of inner scopes apart, for release()."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield own
    finally:
        _SCOPES.remove(own)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that materialize() wrote, and only these: for when what was made of them is itself written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


#: Bytes of an Arrow batch between Spark and Python: texts are long, and both sides hold several batches.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; then as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES for the rest of the session: for frames that are written later, by others."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write are released as soon as it is done. keep: not noted in the open scope.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not keep and _SCOPES:
        _SCOPES[-1].append(path)
    with settings(spark, {_CLEANUP: "true", _BATCH: str(BATCH_BYTES)}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(col, n: int):
    """crc32 of the value's text, modulo n: the documented split of labelled rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(o) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]], o - o[0]


def trim() -> None:
    """Gives memory that a task has freed back to the system; a reused worker would hold it while others run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES, rows: int = 1 << 62, back: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose texts take about `limit` bytes, of `rows` rows at most, with their bytes and offsets. back: freed memory is given back at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1), at + rows)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
        del data, offs
    if back:
        trim()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, odd: np.uint64 = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, n + 1 of each."""
    have = _POWERS.get(int(odd))
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(odd), -1, 1 << 64))
        out = []
        for x in (odd, inverse):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _POWERS[int(odd)] = (out[0], out[1])
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray, odd: np.uint64 = _ODD) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[k] * odd**k for i <= k < j."""
    up, _ = powers(len(values), odd)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.uint64 = _ODD) -> np.ndarray:
    """Polynomial hash of each span of the values behind the prefix sums s."""
    _, down = powers(len(s), odd)
    return mix((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64) * _ODD2)


def rolling_hash(s: np.ndarray, k: int, odd: np.uint64 = _ODD, salt: int = 0) -> np.ndarray:
    """Hash of the k values from each position on (as many as there are whole windows)."""
    n = max(0, len(s) - k)
    _, down = powers(len(s), odd)
    return mix((s[k : k + n] - s[:n]) * down[:n], salt)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and each document's first word (one more for the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    token = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start, end = token.copy(), token.copy()
    start[1:] &= ~token[:-1] | edge[1:n]
    end[:-1] &= ~token[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(data.astype(np.uint64) + np.uint64(1)), starts, ends)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each position on (fewer at the end)."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        out[:-step] = np.minimum(out[:-step], out[step:]) if step < len(out) else out[:-step]
        have += step
    return out


_CODECS: list = []


def codecs():
    """A compressor and a decompressor, one of each for a process."""
    if not _CODECS:
        import zstandard

        _CODECS.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _CODECS


def blob(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed bytes: the n-th bytes of all values stand together."""
    raw = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return codecs()[0].compress(b"".join(raw))


def unblob(x: bytes, kinds: list[np.dtype]) -> list[np.ndarray]:
    """The columns of a blob, given their types."""
    raw = np.frombuffer(codecs()[1].decompress(x), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


def prime_from(n: int) -> int:
    """The least prime that is n or more."""
    while n < 2 or any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
