"""Language of documents by a linear-chain conditional random field over words.

Each word gets a score for each language from its letter n-grams (with word
ends), its prefix and suffix, and a lexicon of frequent training words; learned
transitions tie neighbours. Forward-backward gives each word its language
probabilities, so code-switched text is labelled word by word; a document's
language is the one with the largest mean probability, which is its score.

The field is trained on the driver by gradient ascent on a sample bounded by
TRAIN_ROWS, on chains that join stretches of several documents so that
transitions are learned too. Prediction reads every text whole: texts are cut in
segments; where a text has several, each becomes a matrix from its first state
to its last, the matrices are chained, and vectors then run inside all segments.
A word takes room for its labels, a segment of a long text for their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.llm.arrow import portions
from dosewise.llm.words import Words, _class, words

#: Labelled documents trained on, and bytes of the largest.
TRAIN_ROWS, TRAIN_BYTES = 2000, 1 << 16
#: Slots of the hashed n-gram and affix weights, and of the lexicon.
GRAM_SLOTS, AFFIX_SLOTS, LEXICON_SLOTS = 1 << 15, 1 << 14, 1 << 14
#: Words of a training chain, chains of a step, passes over the sample, step size.
CHAIN, STEP_CHAINS, PASSES, RATE = 64, 128, 3, 0.2
#: A word is in the lexicon from so many occurrences in the sample on.
FREQUENT = 8
#: Words of a segment.
SEGMENT = 256
UNDETERMINED = "und"
SEED = 5

#: Letters after lower-casing, and everything beyond ASCII.
LETTERS = _class([(0x00, 0x60), (0x7B, 0x7F)])


class Features(NamedTuple):
    """gram: slot at each byte; start: of each word's n-grams; prefix, suffix, lexicon: slots of each word."""

    gram: np.ndarray
    start: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray


class Model(NamedTuple):
    labels: list[str]
    gram: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray
    tags: np.ndarray
    transitions: np.ndarray


def _joined(texts: list[str | None]) -> Words:
    """Words of lower-case texts, at least one other byte between and around texts."""
    return words(pa.array([f" {t} " if t else " " for t in texts], pa.large_string()), LETTERS, lower=False)


def features(w: Words) -> Features:
    data = np.where(LETTERS[w.data], w.data, 0).astype(np.uint32)
    data = np.concatenate([data, np.zeros(4, np.uint32)])
    a, b, c, d = (data[i : len(data) - 4 + i] for i in range(4))
    gram = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)) >> np.uint32(17)) % GRAM_SLOTS
    gram = np.where(b > 0, gram, GRAM_SLOTS).astype(np.int32)  # the middle byte belongs to the word
    four = (a * np.uint32(0x27D4EB2F) ^ b * np.uint32(0x165667B1) ^ c * np.uint32(0x9E3779B1) ^ d * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    at = np.maximum(w.begin - 1, 0)
    return Features(
        gram, at, four[at] % AFFIX_SLOTS, four[np.maximum(w.end - 3, 0)] % AFFIX_SLOTS, (w.hash >> np.uint64(40)) % np.uint64(LEXICON_SLOTS)
    )


def _known(model: Model, w: Words, f: Features) -> np.ndarray:
    """Lexicon slots of words that are in it, the empty slot for others."""
    return np.where(model.tags[f.lexicon] == w.hash, f.lexicon, LEXICON_SLOTS).astype(np.int64)


def scores(model: Model, w: Words) -> np.ndarray:
    if not len(w.hash):
        return np.zeros((0, len(model.labels)), np.float32)
    f = features(w)
    own = np.add.reduceat(model.gram[f.gram], f.start, axis=0)
    return own + model.prefix[f.prefix] + model.suffix[f.suffix] + model.lexicon[_known(model, w, f)]


def marginals(score: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of chains first[i] to first[i + 1]."""
    if not len(score):
        return np.zeros(score.shape, np.float32)
    forward, backward = messages(score, first, transitions)
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True)


def _weights(score: np.ndarray) -> np.ndarray:
    return np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float32)


def messages(score: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of each word, up to a factor.

    All segments run side by side, as vectors. Only those of chains longer than
    a segment become matrices first, one for each segment, to be chained.
    """
    k = score.shape[1]
    weight = _weights(score)
    move = np.exp(transitions - transitions.max()).astype(np.float32)
    counts = np.diff(first)
    pieces = -(-counts // SEGMENT)
    owner = np.repeat(np.arange(len(counts)), pieces)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[owner] + place * SEGMENT
    length = np.minimum(SEGMENT, counts[owner] - place * SEGMENT)
    arrive, leave = _ends(weight, move, begin, length, place, pieces[owner])
    order = np.argsort(-length, kind="stable")
    begin, length, arrive, leave = begin[order], length[order], arrive[order], leave[order]
    forward, backward = np.empty_like(weight), np.empty_like(weight)
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    now = arrive
    for t, n in enumerate(active):
        now = now[:n] * weight[begin[:n] + t]
        if t % 8 == 7:
            now /= now.max(axis=1, keepdims=True)
        forward[begin[:n] + t] = now
        now = now @ move
    now = leave[:0]
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        now = np.concatenate([now, leave[len(now) : n]])  # segments that end here
        if t % 8 == 7:
            now /= now.max(axis=1, keepdims=True)
        backward[begin[:n] + t] = now
        now = (now * weight[begin[:n] + t]) @ move.T
    return forward, backward


def _ends(
    weight: np.ndarray, move: np.ndarray, begin: np.ndarray, length: np.ndarray, place: np.ndarray, pieces: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The forward vector moved into the first word of each segment, the backward vector at its last word.

    Segments come in the order of their chains, place counts those of a chain
    and pieces tells how many it has.
    """
    k = len(move)
    arrive, leave = np.ones((len(begin), k), np.float32), np.ones((len(begin), k), np.float32)
    many = np.flatnonzero(pieces > 1)
    if not len(many):
        return arrive, leave
    many = many[np.argsort(-length[many], kind="stable")]
    matrix = weight[begin[many]][:, :, None] * np.eye(k, dtype=np.float32)
    for t in range(1, int(length[many[0]])):
        n = int(np.searchsorted(-length[many], -t, side="left"))
        matrix[:n] = (matrix[:n].reshape(-1, k) @ move).reshape(n, k, k) * weight[begin[many[:n]] + t][:, None, :]
        if t % 8 == 7:
            matrix[:n] /= matrix[:n].max(axis=(1, 2), keepdims=True)
    row = np.full(len(begin), -1)
    row[many] = np.arange(len(many))
    many = many[np.argsort(place[many], kind="stable")]
    cuts = np.searchsorted(place[many], np.arange(int(place[many[-1]]) + 2))
    steps = [many[cuts[p] : cuts[p + 1]] for p in range(1, len(cuts) - 1)]  # segments that follow another
    for here in steps:
        x = np.einsum("ni,nij->nj", arrive[here - 1], matrix[row[here - 1]])
        arrive[here] = x / x.sum(axis=1, keepdims=True) @ move
    for here in reversed(steps):
        x = np.einsum("nij,nj->ni", matrix[row[here]], leave[here])
        leave[here - 1] = x / x.sum(axis=1, keepdims=True) @ move.T
    return arrive, leave


def train(texts: list[str], langs: list[str]) -> Model:
    """Fit a field to lower-case texts and their languages."""
    labels = sorted(set(langs))
    k, rng = len(labels), np.random.default_rng(SEED)
    w = _joined(texts)
    label = np.repeat([labels.index(x) for x in langs], np.diff(w.first))
    f = features(w)
    hashes, n = np.unique(w.hash, return_counts=True)
    tags = np.zeros(LEXICON_SLOTS, np.uint64)
    common = hashes[n >= FREQUENT][np.argsort(n[n >= FREQUENT], kind="stable")]
    tags[(common >> np.uint64(40)) % np.uint64(LEXICON_SLOTS)] = common
    shapes = (GRAM_SLOTS + 1, AFFIX_SLOTS, AFFIX_SLOTS, LEXICON_SLOTS + 1)
    model = Model(labels, *(np.zeros((s, k), np.float32) for s in shapes), tags, np.zeros((k, k), np.float32))
    tables = (model.gram, model.prefix, model.suffix, model.lexicon)
    squares = [np.full(t.shape, 1e-2, np.float32) for t in (*tables, model.transitions)]
    known = _known(model, w, f)
    sizes = np.diff(np.append(f.start, len(f.gram)))
    cuts = np.arange(0, len(label), 16)  # stretches of up to 16 words, never across texts of a different language
    for _ in range(PASSES):
        shuffled = rng.permutation(len(cuts))
        per_step = STEP_CHAINS * CHAIN // 16
        for a in range(0, len(shuffled), per_step):
            own = np.concatenate([np.arange(c, min(c + 16, len(label))) for c in cuts[shuffled[a : a + per_step]]])
            y, firsts = label[own], np.append(np.arange(0, len(own), CHAIN), len(own))
            grams = np.repeat(f.start[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own]) + np.arange(sizes[own].sum())
            word_of = np.repeat(np.arange(len(own)), sizes[own])
            slots = (f.gram[grams], f.prefix[own], f.suffix[own], known[own])
            begins = np.cumsum(sizes[own]) - sizes[own]
            s = np.add.reduceat(model.gram[slots[0]], begins, axis=0) + sum(t[x] for t, x in zip(tables[1:], slots[1:], strict=True))
            forward, backward = messages(s, firsts, model.transitions)
            p = forward * backward
            p /= p.sum(axis=1, keepdims=True)
            error = np.eye(k, dtype=np.float32)[y] - p
            errors = (error[word_of], error, error, error)
            inner = np.setdiff1d(np.arange(1, len(own)), firsts)
            pair = forward[inner - 1][:, :, None] * np.exp(model.transitions) * (_weights(s) * backward)[inner][:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[inner - 1], y[inner]), 1)
            gradients = [
                np.stack([np.bincount(x, weights=e[:, i], minlength=len(t)) for i in range(k)], axis=1)
                for t, x, e in zip(tables, slots, errors, strict=True)
            ]
            gradients.append((seen - pair.sum(axis=0)) / 16)
            for t, g, q in zip((*tables, model.transitions), gradients, squares, strict=True):
                q += (g * g).astype(np.float32)
                t += (RATE * g / np.sqrt(q)).astype(np.float32)
            model.gram[GRAM_SLOTS] = model.lexicon[LEXICON_SLOTS] = 0
    return model


def is_held_out(doc_id: str = "doc_id") -> Column:
    """A third of the documents by the checksum of their id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A field from at most rows labelled documents outside the held-out third,
    of up to TRAIN_BYTES, the first by a hash of their id; None if there are none."""
    usable = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES) & ~is_held_out())
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows)
    ids = [r[0] for r in chosen.collect()]
    sample = usable.where(F.col("doc_id").isin(ids)).select(F.lower("text"), "lang").orderBy("doc_id", "lang").limit(2 * rows).collect()
    return train([r[0] for r in sample], [r[1] for r in sample]) if sample else None


def _predicted(model: Model | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "lowered", 2 << 20):
            texts = part.column("lowered").to_pylist()
            n = len(texts)
            best, share = np.full(n, -1), np.zeros(n)
            if model:
                w = _joined(texts)
                p = marginals(scores(model, w), w.first, model.transitions)
                full = np.flatnonzero(np.diff(w.first) > 0)
                if len(full):
                    mean = np.add.reduceat(p.astype(np.float64), w.first[full], axis=0) / np.diff(w.first)[full][:, None]
                    best[full], share[full] = mean.argmax(axis=1), mean.max(axis=1)
                for i in full:  # beyond ASCII there are signs, too
                    if not texts[i].isascii() and not any(map(str.isalpha, texts[i])):
                        best[i], share[i] = -1, 0
            langs = [model.labels[b] if model and b >= 0 else UNDETERMINED for b in best]
            rest = [c for c in part.schema.names if c != "lowered"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in rest), pa.array(langs, pa.string()), pa.array(np.clip(share, 0, 1))],
                [*rest, "lang_pred", "score"],
            )

    return predicted


def predict(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns of docs, lang_pred and score for every row.

    Reads the text column alone. Null texts and those without a letter are
    undetermined with score 0, as is everything without a model. Repeated rows
    give repeated results; an empty table gives an empty result.
    """
    rows = docs.select(*columns, F.lower(F.col("text").cast("string")).alias("lowered"))
    kept = ", ".join(f"`{x}` {t}" for x, t in rows.drop("lowered").dtypes)
    return rows.mapInArrow(_predicted(model), f"{kept}, lang_pred string, score double")
