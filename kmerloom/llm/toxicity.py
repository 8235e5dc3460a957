"""Toxicity by weak supervision.

Many weak voters vote on a bounded sample of documents: fixed lexicons of several languages, lexicons of words and word
beginnings learned from labelled rows, patterns of whole texts, and the labels themselves where they may be used. What a learned voter knows
comes from other parts of the sample than the row that it votes on, so that its accuracy can be estimated at all. A
generative label model estimates each voter's accuracy by expectation-maximisation, and correlations between voters from
what the latent class leaves unexplained; correlated voters are weighed down. A linear classifier is then
trained on the posterior labels, and it alone scores all documents in one pass over whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, first_by_hash, kept, lean_memory
from .words import parts_of

# Plain insults of some languages, each lexicon a voter by itself.
LEXICONS = (
    "arsehole bastard bitch clown coward creep cretin degenerate dimwit disgusting dumb dumbass fool garbage idiot "
    "imbecile jerk liar loser lunatic maggot moron parasite pathetic pig scum scumbag shit slut stupid trash vermin "
    "whore worthless",
    "abschaum arschloch depp dreckskerl drecksau dummkopf hurensohn miststück missgeburt schlampe schwachkopf trottel vollidiot wichser",
    "abruti connard connasse crétin débile enculé imbécile ordure pétasse pourriture salaud salope",
    "cabrón capullo estúpido gilipollas hijoputa imbécil payaso pendejo subnormal zorra",
)
LEXICON = frozenset(" ".join(LEXICONS).split())
#: Lengths of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6, 7)
_NOT_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MASKED = re.compile(r"(?<![\w*])[A-Za-z][*@#$]{2,}[A-Za-z]*(?![\w*])")
_DRAWN = re.compile(r"([A-Za-z])\1{3,}")
_ADDRESS = re.compile(r"(?i)\b(?:you|your|you're|u|ya)\s+(?:are\s+)?(?:an?\s+)?\w+|\b(?:du|ihr)\s+\w+|\btu es\b|\beres\s+un")
#: Parts of the sample: what votes on one is learned from the others.
_PARTS = 4


def distinct_words(text: str) -> set[bytes]:
    """The lower-cased words of a text: runs of ASCII letters and of anything beyond ASCII."""
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_NOT_LETTERS).split())


def word_features(word: bytes) -> list[str]:
    """A word's features: itself, and its beginnings where it is longer than those."""
    w = "".join(filter(str.isalpha, word.decode("utf-8", "replace")))
    return [w, *(f"{w[:k]}*" for k in BEGINNINGS if len(w) > k)] if w else []


def patterns(text: str) -> tuple[int, ...]:
    """Votes of the patterns on a whole text: exclamation marks, capitals, masked letters, drawn-out letters, an address."""
    marks, letters, high = text.count("!"), sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    return (
        1 if marks * 20 > len(text) else -1 if not marks else 0,
        1 if letters >= 20 and 2 * high > letters else -1 if 10 * high < letters else 0,
        int(_MASKED.search(text) is not None), int(_DRAWN.search(text) is not None), int(_ADDRESS.search(text) is not None),
    )


class Example(NamedTuple):
    """A row to learn from: its label, its distinct words joined by spaces, the patterns' votes on its text, and a bounded hash of each
    feature of each word, so many a word."""

    label: int
    words: bytes
    votes: tuple[int, ...]
    places: np.ndarray


_PER_WORD = 1 + len(BEGINNINGS)
_BUCKETS = 1 << 22
_places: dict[bytes, list[int]] = kept("places")


def _places_of(word: bytes) -> list[int]:
    """Hashes of a word's features; a word with fewer features repeats one."""
    if (got := _places.get(word)) is None:
        if len(_places) > 100_000:
            _places.clear()
        got = [zlib.crc32(f.encode()) % _BUCKETS for f in word_features(word)] or [zlib.crc32(word) % _BUCKETS]
        _places[word] = got = got + got[:1] * (_PER_WORD - len(got))
    return got


def example(label: int, text: str) -> Example:
    words = sorted(distinct_words(text))
    return Example(label, b" ".join(words), patterns(text), np.array([x for w in words for x in _places_of(w)], np.int32))


def label_model(votes: np.ndarray, prior: float = 0.1, rounds: int = 60, sure: int | None = None, accuracy: float = 0.9995, belief: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of class 1 for vote rows (-1, 0, 1), the voters' tables p[class, voter, vote + 1], and their weights.

    EM; after each half the weights are set to 1 / (1 + the sum of positive correlations that a voter has with
    the others within the classes), so that several voters that repeat each other count about once. The voter
    sure (the labels) has full weight, which ties the latent class to what it marks, and begins at the given accuracy, in which there is
    as much belief as that share of the rows would give.
    """
    n, k = votes.shape
    hot = np.eye(3)[votes + 1]
    p = np.tile(np.array([[[0.5, 0.45, 0.05]], [[0.15, 0.45, 0.4]]]), (1, k, 1))
    weight, share = np.ones(k), prior
    known = np.array([[accuracy, 1e-3, 1 - accuracy], [1 - accuracy, 1e-3, accuracy]])
    if sure is not None:
        p[:, sure] = known
    q = np.full(n, prior)
    for half in range(2):
        for _ in range(rounds):
            gap = np.einsum("ikv,kv->ik", hot, np.log(p[1]) - np.log(p[0])) @ weight + math.log(share / (1 - share))
            q = 1 / (1 + np.exp(-np.clip(gap, -50, 50)))
            for c, r in ((1, q), (0, 1 - q)):
                p[c] = np.einsum("i,ikv->kv", r, hot) + np.array([0.5, 0.5, 0.5])
                if sure is not None:
                    p[c, sure] = np.einsum("i,iv->v", r, hot[:, sure]) + belief * r.sum() * known[c] + 1e-3
                p[c] /= p[c].sum(1, keepdims=True)
            share = float(np.clip(q.mean(), 0.005, 0.6))
        if half == 0:
            mean = np.stack([p[c][:, 2] - p[c][:, 0] for c in (0, 1)])
            rest = votes - ((1 - q)[:, None] * mean[0] + q[:, None] * mean[1])
            spread = np.sqrt((rest**2).mean(0)) + 1e-9
            corr = (rest.T @ rest) / n / np.outer(spread, spread)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.clip(corr, 0, None).sum(1))
            if sure is not None:
                weight[sure] = 1
    return q, p, weight


def _linear(rows: list[np.ndarray], target: np.ndarray, n_features: int, weight: np.ndarray, steps: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets: rows are feature indices (repeats count), full-batch Adam."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    theta = np.zeros(n_features + 1)
    theta[-1] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(row, theta[col], len(rows))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        g = np.append(np.bincount(col, err[row], n_features), err.sum()) / weight.sum() + penalty * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


class Model:
    """weights: feature -> weight; bias; both plain values, so that a task carries them in its closure."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self) -> Callable[[str], float]:
        """text -> probability; a worker looks up a word's weight only once (beyond a million words it begins anew)."""
        known: dict[bytes, float] = {}
        weights = self.weights

        def of(word: bytes) -> float:
            if len(known) > 1_000_000:
                known.clear()
            known[word] = w = sum(weights.get(f, 0.0) for f in word_features(word))
            return w

        def score(text: str) -> float:
            words = distinct_words(text)
            got = list(map(known.get, words))
            if None in got:
                got = [of(w) if x is None else x for x, w in zip(got, words, strict=True)]
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + math.fsum(got)))))

        return score


def _evidence(a0: int, a1: int, n0: int, n1: int) -> float:
    """Signed root of the likelihood-ratio statistic of a feature in a0 and a1 rows of two classes of n0 and n1."""
    e1 = (a0 + a1) * n1 / (n0 + n1)
    g = 2 * sum(a * math.log(a / e) for a, e in ((a1, e1), (a0, a0 + a1 - e1)) if a)
    return math.copysign(math.sqrt(max(g, 0.0)), a1 - e1)


def _together(parts: Iterable[dict[str, list[int]]]) -> dict[str, list[int]]:
    """Rows by class of each feature, in all parts."""
    out: dict[str, list[int]] = {}
    for part in parts:
        for f, (a0, a1) in part.items():
            have = out.setdefault(f, [0, 0])
            have[0] += a0
            have[1] += a1
    return out


def _precise(seen: dict[str, list[int]], n: np.ndarray, least: int) -> dict[str, float]:
    """Features that speak for class 1 by themselves, with their evidence; seen: rows by class of each feature, n: of all."""
    n0, n1 = int(n[0]), int(n[1])
    if not n0 or not n1:
        return {}
    top: dict[str, int] = {}  # of a beginning: the rows of class 1 that its commonest word accounts for
    for f, (_, a1) in seen.items():
        if not f.endswith("*") and a1:
            for k in BEGINNINGS:
                if len(f) > k:
                    top[f"{f[:k]}*"] = max(top.get(f"{f[:k]}*", 0), int(a1))
    out = {}
    for f, (a0, a1) in seen.items():
        if a0 + a1 >= least and 10 * top.get(f, 0) <= 7 * a1 and a1 * n0 > 9 * (a0 + 0.5) * n1:  # a beginning that is one word says nothing about others
            z = _evidence(int(a0), int(a1), n0, n1)
            if z >= 5.5:
                out[f] = z
    return out


def votes_of(found: list[dict[str, int]], part: np.ndarray, y: np.ndarray, surface: np.ndarray, seen: list[dict[str, list[int]]], least: int) -> np.ndarray:
    """The votes of all voters but the labels on each row.

    Learned voters hold the precise features of one kind (words, or beginnings of one length) and half, and vote or abstain; on a row they
    use what the other parts of the sample taught them.
    """
    learned = np.zeros((len(y), 2 * (1 + len(BEGINNINGS))), np.int8)
    kind = {0: 0} | {k: j for j, k in enumerate(BEGINNINGS, 1)}
    for p in range(_PARTS):
        use = _precise(_together([x for q, x in enumerate(seen) if q != p]), np.bincount(y[part != p], minlength=2), least)
        voter = {f: 2 * kind[len(f) - 1 if f.endswith("*") else 0] + zlib.crc32(f.encode()) % 2 for f in use}
        for k in np.flatnonzero(part == p).tolist():
            hit = {voter[f] for f in found[k] if f in voter}
            learned[k, list(hit)] = 1
    fixed = np.array([[any(f in lexicon for f in of) for lexicon in map(frozenset, map(str.split, LEXICONS))] for of in found], np.int8).reshape(len(y), len(LEXICONS))
    return np.hstack([fixed, learned, surface])


def train(sample: Iterable[Example], max_features: int = 20_000, least: int = 4, with_model: bool = True) -> Model:
    """A model from examples, read twice; with none, or none of a class, the fixed lexicons alone make it up.

    Memory is bounded by the number of examples and not by the length of their texts. with_model: train on the label model's
    posteriors; without, on the labels as they are (for comparison).
    """
    buckets = np.zeros((2, _BUCKETS), np.int32)  # rows by class of the features with each hash: a first, bounded count
    kept: list[bool] = []
    classes: list[int] = []
    copies: set[tuple] = set()
    for x in sample:
        classes.append(x.label)
        least_hashes = (x.label, *np.sort(x.places)[: 4 * _PER_WORD].tolist())
        kept.append(not len(x.places) or least_hashes not in copies)  # copies and near copies would pass off their chance words as evidence
        copies.add(least_hashes)
        if kept[-1]:
            buckets[x.label][np.unique(x.places)] += 1
    del copies
    # what no part of the sample could teach a voter is not looked at again
    strong = (buckets.sum(0) >= least) & (buckets[1] > 0)
    n0, n1 = (int(sum(k for k, c in zip(kept, classes, strict=True) if c == of)) for of in (0, 1))
    if n0 and n1:
        for k in np.flatnonzero(strong).tolist():
            strong[k] = _evidence(int(buckets[0][k]), int(buckets[1][k]), n0, n1) >= 4
    del buckets
    labels, surface, found_in, parts = [], [], [], []
    seen: list[dict[str, list[int]]] = [{} for _ in range(_PARTS)]
    features: dict[bytes, list[str]] = {}
    for x, keep in zip(sample, kept, strict=True):
        if not keep:
            continue
        words = x.words.split()
        found: dict[str, int] = {}
        for k in np.flatnonzero(strong[x.places.reshape(-1, _PER_WORD)].any(1)).tolist():
            if words[k] not in features:
                features[words[k]] = word_features(words[k])
            for f in features[words[k]]:
                found[f] = found.get(f, 0) + 1
        for f in [f for f in found if not strong[zlib.crc32(f.encode()) % _BUCKETS]]:
            del found[f]
        parts.append(len(labels) % _PARTS)
        for f in found:
            seen[parts[-1]].setdefault(f, [0, 0])[x.label] += 1
        labels.append(x.label)
        surface.append(x.votes)
        found_in.append(found)
    y = np.array(labels, np.int64)
    n = np.bincount(y, minlength=2)
    if not n.all():
        return Model(dict.fromkeys(LEXICON, 6.0), -3.0)
    strength = _precise(_together(seen), n, least)
    chosen = sorted(strength, key=lambda f: (-strength[f], f))[:max_features]
    place = {f: k for k, f in enumerate(chosen)}
    rows = [np.array([place[f] for f, c in found.items() for _ in range(min(c, 3)) if f in place], np.int64) for found in found_in]
    q = y.astype(float)
    if with_model:
        votes = np.hstack([votes_of(found_in, np.array(parts), y, np.array(surface, np.int8), seen, least), (2 * y - 1)[:, None].astype(np.int8)])
        used = [v for v in range(votes.shape[1]) if len(np.unique(votes[:, v])) > 1]
        q, _, _ = label_model(votes[:, used], prior=n[1] / len(y), sure=len(used) - 1)
    weight = np.where(y == 1, 0.5 * len(y) / n[1], 0.5 * len(y) / n[0]) ** 0.5
    theta, bias = _linear(rows, q, len(chosen), weight)
    weights = {f: float(t) for f, t in zip(chosen, theta, strict=True) if t > 0.05}
    return Model({f: weights.get(f, 0.0) + (4.0 if f in LEXICON and f not in place else 0.0) for f in {*weights, *LEXICON}}, bias)


class Sample:
    """Examples in a saved table, streamed a partition at a time whenever they are read."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def __iter__(self) -> Iterator[Example]:
        for r in self.rows.toLocalIterator():
            yield Example(r["_y"], bytes(r["_words"]), tuple(r["_votes"]), np.frombuffer(r["_places"], np.int32))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, most: tuple[int, int]) -> Sample:
    """At most most[c] rows of each class c, the first by a hash of the id, never of fold 0, with what their whole texts say."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_bucket(id_col, folds) != 0)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    drawn = None
    for c in (0, 1):
        part = first_by_hash(usable.where(F.col("_y") == c).withColumn("_hash", F.xxhash64("_id", F.lit(11))), "_hash", most[c], "_id").drop("_hash")
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(drawn), "_id")  # at most sum(most) rows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory("places")
        for batch in batches:
            for some in parts_of(batch, 2):
                all_ = [example(y, t) for y, t in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
                columns = [some.column(0), some.column(1), pa.array([x.words for x in all_], pa.binary()), pa.array([x.votes for x in all_], pa.list_(pa.int32())), pa.array([x.places.tobytes() for x in all_], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_y", "_words", "_votes", "_places"])

    kind = docs.schema[id_col].dataType.simpleString()
    read_ = rows.select("_id", "_y", "_text").mapInArrow(read, f"_id {kind}, _y int, _words binary, _votes array<int>, _places binary")
    return Sample(Scratch(docs.sparkSession, "toxicity").save(read_.orderBy("_y", "_id", "_words"), "sample"))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 5, most_labelled: tuple[int, int] = (6_000, 4_000), threshold: float = 0.5,
) -> DataFrame:
    """A row per row of docs: id, held_out, score, predicted.

    Training reads labels of rows whose crc32(id as text) mod folds is not 0, at most most_labelled of class 0 and
    of class 1; scores are made from the text alone. A null text is the empty text and scores by the bias; null
    labels are not used; a null id counts as the empty text in the fold; repeated rows are scored each; empty
    tables give empty results or, for labels, the fixed lexicon's scores. Whole texts, one pass, no shuffle.
    """
    model = train(labelled_sample(docs, labels, id_col, text_col, label_col, folds, most_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory("places")
        score = model.scorer()
        for batch in batches:
            scores = np.array([score(text.as_py() or "") for text in batch.column(1)], np.float64)
            predicted = pa.array((scores >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), predicted], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, (crc_bucket(id_col, folds) == 0).alias("_held")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, most_labelled: tuple[int, int] = (6_000, 4_000), threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose toxicity score is under the threshold.

    A null or empty text scores by the bias and stays; null ids and repeated rows are judged by their texts alone; an empty table gives an
    empty result; without labels of both classes the fixed lexicons judge.
    """
    model = train(labelled_sample(docs, labels, id_col, text_col, label_col, folds, most_labelled))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory("places")
        score = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(text.as_py() or "") < threshold for text in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
