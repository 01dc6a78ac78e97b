"""Operator 7: toxicity by a logistic classifier with counterfactual regularisation.

Features are the presence of a bounded vocabulary's words and word beginnings, so that an inflected or
compounded term counts by its stem. Beside the usual loss, each labelled text that names a group is scored
again with its identity terms swapped for another group's, and the square of the change of its score is
penalised: a neutral mention of a group can't carry weight of its own. A labelled text that names none gets a
term put in, by a hash of its id, and is swapped likewise, so the penalty acts on any corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.llm import common as C

_WORDS = re.compile(r"[^\W\d_]+")
#: Groups of terms that may stand in for one another.
IDENTITY_GROUPS = [
    "man woman men women male female boy girl".split(),
    "christian muslim jewish hindu buddhist atheist catholic".split(),
    "christians muslims jews hindus buddhists atheists catholics".split(),
    "black white asian latino hispanic african european arab".split(),
    "gay straight lesbian bisexual transgender queer heterosexual".split(),
    "immigrant immigrants refugee refugees foreigner foreigners native natives".split(),
    "american mexican chinese indian russian german french turkish".split(),
    "old young elderly disabled blind deaf".split(),
    "männer frauen jungen mädchen".split(),
    "christen muslime juden hindus buddhisten atheisten katholiken".split(),
    "einwanderer flüchtlinge ausländer einheimische".split(),
    "hommes femmes garçons filles".split(),
    "chrétiens musulmans juifs hindous bouddhistes athées catholiques".split(),
    "immigrés réfugiés étrangers autochtones".split(),
    "hombres mujeres chicos chicas".split(),
    "cristianos musulmanes judíos hindúes budistas ateos católicos".split(),
    "inmigrantes refugiados extranjeros nativos".split(),
]

TERMS = frozenset().union(*IDENTITY_GROUPS)


@dataclass
class ToxicityModel:
    words: dict[str, int]
    weights: np.ndarray
    bias: float
    pairs: int = 0  # counterfactuals that it was trained with
    change: float = 0.0  # mean change of the score, from 0 to 1, when the terms of a pair are swapped


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings of 4, 5 and 6 letters, marked by a star."""
    out = words.copy()
    for n in (4, 5, 6):
        out.update([f"{w}*" for w in {w[:n] for w in words if len(w) >= n}])
    return out


def swapped(words: set[str]) -> list[set[str]]:
    """The words with all identity terms of a group moved on by one, and by two, in their group."""
    out = []
    for group in IDENTITY_GROUPS:
        own = words.intersection(group)
        if own:
            out += [(words - own) | {group[(group.index(w) + step) % len(group)] for w in own} for step in (1, 2)]
    return out


def counterfactuals(words: set[str], dice: int) -> tuple[bool, set[str], list[set[str]]]:
    """Whether a term was put in, by dice, as there was none; the text's words with it; and those with the terms swapped."""
    planted = not words & TERMS
    if planted:
        group = IDENTITY_GROUPS[dice % len(IDENTITY_GROUPS)]
        words = words | {group[dice // len(IDENTITY_GROUPS) % len(group)]}
    return planted, words, swapped(words)


def _places(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each feature present."""
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)


def _score(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(words: dict[str, int], present: list[list[int]], toxic: np.ndarray, pairs: list[tuple[int, bool, list[int], list[int]]], ridge: float = 1.0, counterfactual: float = 1.0, steps: int = 300) -> ToxicityModel:
    """present: each text's features. pairs: a text's place, whether its term was put in, and the features that only it and only its counterfactual have."""
    n, k = len(present), len(words)
    if not n or toxic.min() == toxic.max():
        return ToxicityModel({}, np.zeros(0), 4.0 if n and toxic.max() else -4.0)
    r, c = _places(present)
    r1, c1 = _places([x[2] for x in pairs])
    r2, c2 = _places([x[3] for x in pairs])
    pos = int(toxic.sum())
    w, b = np.zeros(k), float(np.log(pos / (n - pos)))
    mw, vw, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    balance = np.where(toxic == 1, 0.5 * n / pos, 0.5 * n / (n - pos)) ** 0.5
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = b + np.bincount(r, w[c], minlength=n)
        err = balance * (_score(z) - toxic)
        gw, gb = np.bincount(c, err[r], minlength=k) + ridge * w, err.sum()
        if pairs:
            change = np.bincount(r1, w[c1], minlength=len(pairs)) - np.bincount(r2, w[c2], minlength=len(pairs))
            gw += counterfactual * (np.bincount(c1, change[r1], minlength=k) - np.bincount(c2, change[r2], minlength=k))
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        one, two = 1 - 0.9**t, 1 - 0.999**t
        w = w - 0.05 * (mw / one) / (np.sqrt(vw / two) + 1e-8)
        b -= 0.05 * (mb / one) / (np.sqrt(vb / two) + 1e-8)
    of, planted = np.array([x[0] for x in pairs], np.int64), np.array([x[1] for x in pairs], bool)
    z = (b + np.bincount(r, w[c], minlength=n))[of]
    one, two = (np.bincount(x, w[y], minlength=len(pairs)) for x, y in ((r1, c1), (r2, c2)))
    rest = np.where(planted, z, z - one)  # without what the pair differs in
    change = float(np.abs(_score(rest + one) - _score(rest + two)).mean()) if pairs else 0.0
    return ToxicityModel(words, w, b, len(pairs), change)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_toxic: int = 4_000, vocabulary: int = 1000, least_docs: int = 5, **parameters) -> ToxicityModel:
    """Model from docs (doc_id, text) and labels (doc_id, toxic 0 or 1), null labels left out.

    Bounded sample: about max_toxic labelled toxic texts and max_rows in all, by the hash of doc_id; equal
    texts count once. The vocabulary is `vocabulary` features in at least least_docs texts, by chi-square
    against the label, and the identity terms. What comes to the driver is each sampled text's list of
    these features, and those of its counterfactuals. Without texts of both labels the model is a constant.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bound = {1: max_toxic, 0: max_rows - max_toxic}
    dice = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    share = {y: min(1_000_000, 1_000_000 * bound[y] // sizes.get(y, 1) + 1) for y in (0, 1)}
    picked = rows.where(dice < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # The sample of labels is bounded by max_rows, so it may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    texts = C.materialize(texts.groupBy("text").agg(F.min_by("toxic", "doc_id").alias("toxic"), F.min("doc_id").alias("doc_id")), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in C.chunks(batches, "text"):
            have: dict[str, list[int]] = {}
            for t, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                for w in features(words_of(t)):
                    have.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([*have], pa.string()), pa.array([x[0] for x in have.values()], pa.int64()), pa.array([x[1] for x in have.values()], pa.int64())], names=["word", "clean", "toxic"])

    total = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, pos = sum(total.values()), total.get(1, 0)
    if not 0 < pos < n:
        return train({}, [[]] * n, np.full(n, int(pos > 0)), [])
    counts = texts.mapInArrow(counted, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = C.materialize(counts, "words")
    both = F.col("clean") + F.col("toxic")
    expected = both * pos / n
    square = F.pow(F.col("toxic") - expected, 2) / F.greatest(expected * (1 - both / (n + 1)), F.lit(1e-9))
    chosen = [r["word"] for r in counts.where(both >= least_docs).orderBy(square.desc(), "word").limit(vocabulary).select("word").collect()]
    chosen += sorted(TERMS.difference(chosen))
    index = {w: i for i, w in enumerate(chosen)}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own(words):
            return sorted(index[w] for w in index.keys() & features(words))

        for part, _, _ in C.chunks(batches, "text"):
            out = []
            for t, y, i in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), part.column("doc_id").to_pylist(), strict=True):
                words = words_of(t)
                planted, full, others = counterfactuals(words, zlib.crc32(str(i).encode()))
                a = {*own(full)}
                apart = [[sorted(a - b), sorted(b - a)] for b in ({*own(x)} for x in others)]
                out.append((i, y, own(words), planted, apart))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "toxic", "own", "planted", "swapped"])

    rows = texts.mapInArrow(listed, "doc_id long, toxic int, own array<int>, planted boolean, swapped array<array<array<int>>>")
    got = sorted(rows.collect(), key=lambda r: r["doc_id"])
    pairs = [(n, r["planted"], a, b) for n, r in enumerate(got) for a, b in r["swapped"]]
    return train(index, [r["own"] for r in got], np.array([r["toxic"] for r in got], np.int64), pairs, **parameters)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs plus score (0 to 1) and predicted (1 from 0.5 on). Null and empty texts get the model's base score.

    Repeated rows get the same score; an empty table gives an empty one. Other columns pass unchanged; columns with the new names are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = {w: float(model.weights[i]) for w, i in model.words.items()}
        for part, _, _ in C.chunks(batches, "text"):
            z = np.array([model.bias + sum(sorted(weight[w] for w in weight.keys() & features(words_of(t)))) for t in part.column("text").to_pylist()])
            s = _score(z)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return kept.mapInArrow(run, schema)
