"""Operator 3: language of a text by the nearest of several centroids per language.

A text is its vector of hashed byte trigrams (lower-cased, all ASCII but letters as one blank), term
frequencies damped by a logarithm, weighted by inverse document frequency, of length one. Each language
has several centroids, from spherical k-means over its training vectors. The prediction is the language
of the centroid with the largest cosine; a text is rejected where that cosine is not clear of what noise
reaches, at its size, towards what the language's texts reach. Size is the number of different buckets,
so a text of repeated lines counts as the short text that it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.llm import common as C

UNKNOWN = "und"
DIMS = 4096
_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[128:] = np.arange(128, 256)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[97:123] = np.arange(97, 123)


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least cosine that is not rejected, of each centroid by size class


def trigram_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of DIMS counts for each text. Trigrams of blanks only don't count; ends of texts are blanks."""
    n = len(offs) - 1
    # A blank before and after each text, so that short texts have trigrams and none crosses texts.
    place = np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offs)) + 1
    x = np.full(len(data) + 2 * n, 0x20, np.uint8)
    x[place] = _CLASS[data]
    row = np.repeat(np.arange(n), np.diff(offs) + 2)
    if len(x) < 3:
        return np.zeros((n, DIMS), np.float32)
    g = x[:-2].astype(np.uint32) << 16 | x[1:-1].astype(np.uint32) << 8 | x[2:]
    bucket = (g * np.uint32(2654435761)) >> np.uint32(20)
    keep = (row[:-2] == row[2:]) & (g != 0x202020) & ~((x[:-2] == 0x20) & (x[1:-1] == 0x20))
    key = row[:-2][keep] * DIMS + bucket[keep]
    return np.bincount(key, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


SIZES = 2 * DIMS.bit_length()


def size_class(counts: np.ndarray) -> np.ndarray:
    """Half octaves of the number of different buckets."""
    return (2 * np.log2(np.maximum((counts > 0).sum(1), 1))).astype(int)


def drawn(counts: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of texts as long as 4 to 4 million trigrams, each drawn from the trigrams of one to four of the given texts."""
    out = []
    for size in 2.0 ** np.arange(2, 23):
        for _ in range(draws):
            p = counts[rng.integers(len(counts), size=rng.integers(1, 5))].sum(0)
            out.append(rng.poisson(p * (size / max(p.sum(), 1))))
    return np.stack(out).astype(np.float32)


def least_cosines(near: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 1% quantile of cosines by size class; classes that none reaches have the nearest one's."""
    have = [k for k in range(SIZES) if (abs(size - k) <= 1).any()]
    low = {k: np.quantile(near[abs(size - k) <= 1], 0.01) for k in have}
    return np.array([low[min(have, key=lambda h: abs(h - k))] for k in range(SIZES)])


def noise_cosines(c: np.ndarray, idf: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """What texts of buckets by chance reach by size class (99% quantile), at one count a bucket and at many."""
    out = np.zeros(SIZES)
    for k in range(SIZES):
        n = min(int(2 ** ((k + 0.5) / 2)) or 1, DIMS)
        rows = np.zeros((128, DIMS), np.float32)
        for i, row in enumerate(rows):
            row[rng.choice(DIMS, n, replace=False)] = 1 if i % 2 else 1 + rng.poisson(2.0 ** rng.integers(0, 8), n)
        out[k] = np.quantile((vectors(rows, idf) @ c.T).max(1), 0.99)
    return out


def fit(labelled: DataFrame, clusters: int = 4, per_language: int = 400, block: int = 64, seed: int = 7) -> LanguageModel:
    """Model from the columns doc_id, text and lang; rows with null text or lang don't count.

    Every language is learned. Bounded sample: about per_language texts of each, by the hash of doc_id;
    what comes to the driver at once is the trigram counts of a block of languages. More than one block
    is gone through twice, for document frequencies and then for centroids.
    """
    rows = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros((0, SIZES)))
    order = sorted(sizes)
    blocks = [order[i : i + block] for i in range(0, len(order), block)]
    share = [(k, i // block, min(1_000_000, 1_000_000 * per_language // sizes[k] + 1)) for i, k in enumerate(order)]
    of = F.broadcast(labelled.sparkSession.createDataFrame(share, "lang string, block int, most long"))
    dice = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000))
    picked = rows.withColumn("dice", dice).join(of, "lang").where("dice < most").select("lang", "block", "dice", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in C.chunks(batches, "text", rows=512):
            counts = trigram_counts(data, offs).astype("<u4")
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("block"), part.column("dice"), pa.array([c.tobytes() for c in counts], pa.binary())], names=["lang", "block", "dice", "counts"])

    sample = picked.mapInArrow(counted, "lang string, block int, dice long, counts binary")
    if len(blocks) > 1:
        sample = C.materialize(sample, "languages")

    def training(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Languages and counts of the block's texts, at most per_language of each."""
        got = sorted(sample.where(F.col("block") == i).collect(), key=lambda r: (r["lang"], r["dice"], r["counts"]))
        langs = np.array([r["lang"] for r in got], object)
        keep = [j for x in blocks[i] for j in np.flatnonzero(langs == x)[:per_language]]
        counts = np.stack([np.frombuffer(bytes(got[j]["counts"]), "<u4") for j in keep]) if keep else np.zeros((0, DIMS), "<u4")
        return langs[keep], counts

    n, df, held = 0, np.zeros(DIMS), None
    for i in range(len(blocks)):
        held = training(i)
        n += len(held[1])
        df += (held[1] > 0).sum(0)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    names, centroids, lows = [], [], []
    rng, dealt = np.random.default_rng(seed), np.random.default_rng(seed)
    for i in range(len(blocks)):
        langs, all_counts = training(i) if len(blocks) > 1 else held
        for lang in blocks[i]:
            counts = all_counts[langs == lang].astype(np.float32)
            if not len(counts):
                continue
            own = vectors(counts, idf)
            c = own[rng.choice(len(own), min(clusters, len(own)), replace=False)]
            for _ in range(15):
                near = (own @ c.T).argmax(1)
                c = np.stack([own[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))])
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
            centroids.append(c)
            names += [lang] * len(c)
            made = np.concatenate([counts, drawn(counts, max(1, min(16, 256 // len(order))), dealt)])
            low = least_cosines((vectors(made, idf) @ c.T).max(1), size_class(made))
            # Few texts say little about others: the floor then keeps nearer to the noise.
            lows += [(low, len(counts) / (len(counts) + 20))] * len(c)
    c = np.concatenate(centroids)
    noise = noise_cosines(c, idf, dealt)
    floor = np.stack([noise + 0.35 * trust * np.maximum(low - noise, 0) for low, trust in lows])
    return LanguageModel(names, c, idf, floor)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs plus lang_pred, score (the cosine, 0 to 1) and rejected.

    lang_pred is `und`, score 0 and rejected true where the text is null or has no letter, or no model
    was learned. Only the text is looked at, so repeated rows get the same; an empty table gives an empty
    one. Other columns pass unchanged; columns with the new names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model.languages, UNKNOWN], dtype=object)
        for part, data, offs in C.chunks(batches, "text", rows=512):
            counts = trigram_counts(data, offs)
            n = len(counts)
            best, score = np.full(n, len(langs) - 1), np.zeros(n)
            if len(model.languages):
                like = vectors(counts, model.idf) @ model.centroids.T
                best = like.argmax(1)
                score = np.clip(like.max(1).astype(float), 0, 1)
            letter = np.array([any(map(str.isalpha, t or "")) for t in part.column("text").to_pylist()], bool)
            best[~letter] = len(langs) - 1
            score[best == len(langs) - 1] = 0
            rejected = best == len(langs) - 1
            if len(model.languages):
                rejected |= score < model.floor[np.minimum(best, len(model.floor) - 1), size_class(counts)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(langs[best], pa.string()), pa.array(score), pa.array(rejected)], names=[*names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, schema)
