"""Document scores by masked pseudo-likelihood.

A small network predicts every word from the WIDTH words on both sides, never
seeing the word itself; the conditional log-probabilities of all words, summed,
score a document. The distinct words of the whole corpus are counted. The most
frequent have an id each, the rest share classes by hash, and the number of ids
grows with the words counted. Ids are grouped by rank, and the output is the
probability of the group times that within it; for a word of a class also times
its count over that of the class, so the probabilities of all words sum to one.

Counting, training and scoring read all documents. Words are told apart by a
hash of 64 bits. Each task trains its own copy from the same start on all its
documents, in numpy; copies are averaged by the words they saw. Counts of the
KNOWN most frequent words go to the tasks, those of others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.arrow import portions
from dosewise.llm.words import SPACED, Words, signed, words
from dosewise.session import stage

#: Hash slots that deal words to classes; one of so many ids is a class.
SLOTS, CLASSES = 1 << 16, 8
#: Least groups, and ids in each; words on each side; sizes of an embedding and of the hidden layer.
SIDE, WIDTH, EMBEDDING, HIDDEN = 32, 2, 8, 16
#: Most frequent words whose counts go to every task.
KNOWN = 1 << 18
#: Weights sent in one value.
BLOCK = 1 << 12
#: Words of a training step and its size.
STEP, RATE = 8192, 0.05
#: Words whose output is worked off at once.
ROWS = 1024
#: Values whose exponentials, and sums of them, are floats of full precision.
SAFE = 70.0
SEED = 3

#: Ids of the smallest net; the id beside the ends of a text comes after them.
IDS = SIDE * SIDE
EDGE = IDS
Weights = dict[str, np.ndarray]


def side_of(tokens: int) -> int:
    """Groups of ids, and ids in a group: ids grow with the root of the words counted."""
    return max(SIDE, math.ceil(tokens**0.25))


def initial(side: int = SIDE) -> Weights:
    ids = side * side
    rng = np.random.default_rng(SEED)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    return {
        "embedding": rng.standard_normal((ids + 1, EMBEDDING)).astype(np.float32) * np.float32(0.1),
        "hidden": normal(2 * WIDTH * EMBEDDING, HIDDEN),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "group": normal(HIDDEN, side),
        "group_bias": np.zeros(side, np.float32),
        "within": normal(side, HIDDEN, side),
        "within_bias": np.zeros((side, side), np.float32),
    }


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in weights.values()])


def shaped(values: np.ndarray, side: int = SIDE) -> Weights:
    out, at = {}, 0
    for name, x in initial(side).items():
        out[name] = values[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


def contexts(ids: np.ndarray, first: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """The ids around each word, edge beyond the ends of its text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    padded = np.concatenate([np.full(WIDTH, edge), ids, np.full(WIDTH, edge)])
    owners = np.concatenate([np.full(WIDTH, -1), owner, np.full(WIDTH, -1)])
    columns = []
    for shift in [*range(-WIDTH, 0), *range(1, WIDTH + 1)]:
        at = np.arange(len(ids)) + WIDTH + shift
        columns.append(np.where(owners[at] == owner, padded[at], edge))
    return np.stack(columns, axis=1) if len(ids) else np.zeros((0, 2 * WIDTH), np.int64)


def _exponentials(x: np.ndarray, safe: bool) -> tuple[np.ndarray | float, np.ndarray]:
    """A number for each column, and the sum of the exponentials of what its values are
    less; x holds these afterwards. The number is the largest value, or 0 if that is safe."""
    most = 0.0 if safe else x.max(axis=0)
    if not safe:
        x -= most
    np.exp(x, out=x)
    return most, x.sum(axis=0)


def _hidden(weights: Weights, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs, a row a word, and the hidden layer, a column a word, with a last row of ones,
    which the biases go with."""
    inputs = weights["embedding"].take(around, axis=0).reshape(len(around), -1)
    h = np.ones((HIDDEN + 1, len(around)), inputs.dtype)
    np.tanh(weights["hidden"].T @ inputs.T + weights["hidden_bias"][:, None], out=h[:HIDDEN])
    return inputs, h


def _with_bias(weights: Weights) -> dict[str, tuple[np.ndarray, np.ndarray | bool]]:
    """Weights and biases of both outputs in one, and whether no value of the output, whose
    inputs lie between -1 and 1, has an exponential beyond what a float holds."""
    out = {}
    for name in ("group", "within"):
        w = np.concatenate([weights[name], weights[f"{name}_bias"][..., None, :]], axis=-2)
        out[name] = w, np.abs(w).sum(axis=-2).max(axis=-1) < SAFE
    return out


def _grouped(ids: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by the group of their ids, and where each group starts in it."""
    group = (ids // side).astype(np.uint16)
    return np.argsort(group, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group, minlength=side))])


def _outputs(weights: Weights, edges: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    """The two outputs of words ordered by group in pieces: name and part of the output, its
    weights, whether it is safe, the words, and the place of each in that output. Pieces
    are small enough to stay in a cache."""
    side, both = len(edges) - 1, _with_bias(weights)
    w, safe = both["group"]
    group = ids // side
    for a in range(0, len(ids), ROWS):
        yield "group", ..., w, safe, a, min(a + ROWS, len(ids)), group[a : a + ROWS]
    w, safe = both["within"]
    place = ids - group * side
    for g in np.flatnonzero(np.diff(edges)).tolist():
        for a in range(edges[g], edges[g + 1], ROWS):
            b = min(a + ROWS, edges[g + 1])
            yield "within", g, w[g], safe[g], a, b, place[a:b]


def log_probabilities(weights: Weights, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log P(id | ids around it) of each word."""
    out, side, every = np.zeros(len(ids)), len(weights["group_bias"]), np.arange(ROWS)
    for a in range(0, len(ids), 1 << 16):
        order, edges = _grouped(ids[a : a + (1 << 16)], side)
        order += a
        own, p = ids[order], np.zeros(len(order))
        _, h = _hidden(weights, around[order])
        for _, _, w, safe, b, e, at in _outputs(weights, edges, own):
            x = w.T @ h[:, b:e]
            p[b:e] += x[at, every[: e - b]]
            most, total = _exponentials(x, safe)
            p[b:e] -= most + np.log(total)
        out[order] = p
    return out


def gradients(weights: Weights, ids: np.ndarray, around: np.ndarray) -> Weights:
    """Gradient of the mean log-probability."""
    n, side, every = np.float32(len(ids)), len(weights["group_bias"]), np.arange(ROWS)
    order, edges = _grouped(ids, side)
    ids, around = ids[order], around[order]
    inputs, h = _hidden(weights, around)
    out = {"embedding": np.zeros_like(weights["embedding"])}
    to_hidden = np.zeros_like(h)
    sums = {"group": np.zeros((HIDDEN + 1, side), h.dtype), "within": np.zeros((side, HIDDEN + 1, side), h.dtype)}
    for name, part, w, safe, b, e, at in _outputs(weights, edges, ids):
        error = w.T @ h[:, b:e]
        _, total = _exponentials(error, safe)
        error *= -1 / total
        error[at, every[: e - b]] += 1
        sums[name][part] += h[:, b:e] @ error.T
        to_hidden[:, b:e] += w @ error
    for name, total in sums.items():
        total /= n
        out[name], out[f"{name}_bias"] = total[..., :HIDDEN, :], total[..., HIDDEN, :]
    h, to_hidden = h[:HIDDEN], to_hidden[:HIDDEN] / n
    to_hidden *= 1 - h * h
    out["hidden"], out["hidden_bias"] = (to_hidden @ inputs).T, to_hidden.sum(axis=1)
    to_inputs, spots = weights["hidden"] @ to_hidden, around.T.ravel()
    for i in range(EMBEDDING):
        out["embedding"][:, i] = np.bincount(spots, weights=to_inputs[i::EMBEDDING].ravel(), minlength=side * side + 1)
    return out


class Trainer:
    """Gradient ascent with a step for each weight by its past gradients."""

    def __init__(self, side: int = SIDE) -> None:
        self.weights = initial(side)
        self.squares = {k: np.full_like(v, 1e-6) for k, v in self.weights.items()}
        self.seen = 0

    def learn(self, ids: np.ndarray, around: np.ndarray) -> None:
        for a in range(0, len(ids), STEP):
            for k, g in gradients(self.weights, ids[a : a + STEP], around[a : a + STEP]).items():
                self.squares[k] += g * g
                step = np.sqrt(self.squares[k])
                np.divide(g, step, out=step)
                step *= np.float32(RATE)
                self.weights[k] += step
        self.seen += len(ids)


class Vocabulary(NamedTuple):
    """Ids of words. hashes are those of the known words in order, ids their ids,
    share the log of their part of their class, 0 for a word with an id alone.
    shared is the id of each slot for all other words, of_class the log of the
    count of a class, by id."""

    side: int
    shared: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    share: np.ndarray
    of_class: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The position of each word among the known and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def bare(shared: np.ndarray, side: int) -> Vocabulary:
    """Classes alone: no word is known and none has a share."""
    none = np.zeros(0)
    return Vocabulary(side, shared, none.astype(np.uint64), none.astype(np.int64), none, np.zeros(side * side))


def _words(part: pa.RecordBatch) -> Words:
    return words(part.column("text"), SPACED, lower=True)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SLOTS)).astype(np.int64)


def _slots(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    w = _words(part)
    return _slot(w.hash), w.first


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in portions(batches):
        seen, n = np.unique(_words(part).hash, return_counts=True)
        yield pa.RecordBatch.from_arrays([signed(seen), pa.array(n)], ["hash", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, n of every distinct word, written once."""
    return stage(docs.select("text").mapInArrow(_counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Ids by the counts of the whole corpus: the most frequent words alone, the rest in classes."""
    levels = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    side = side_of(sum(n * m for n, m in levels))
    classes = side * side // CLASSES
    alone, most = side * side - classes, max(KNOWN, side * side - classes)
    known, least, part = 0, 0, 0.0
    for n, m in levels:
        if known + m > most:  # of the last level as many as there is room for, by hash
            least, part = n, (most - known) / m
            break
        known += m
    some = (F.col("n") == least) & (F.pmod(F.shiftright("hash", 20), F.lit(1 << 20)) < int(part * (1 << 20)))
    top = counts.where((F.col("n") > least) | some).toArrow()
    hashes, n = top["hash"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((hashes, -n))] = np.arange(len(n))
    shared = alone + np.arange(SLOTS) % classes
    ids = np.where(rank < alone, rank, shared[_slot(hashes)])
    total = np.zeros(SLOTS, np.int64)
    for r in counts.groupBy(F.col("hash").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.sum("n").alias("n")).collect():
        total[r["slot"]] = r["n"]
    own = rank < alone
    np.subtract.at(total, _slot(hashes[own]), n[own])
    in_class = np.log(np.maximum(np.bincount(shared, weights=total, minlength=side * side), 1))
    share = np.where(own, 0.0, np.log(n) - in_class[ids])
    order = np.argsort(hashes)
    return Vocabulary(side, shared, hashes[order], ids[order], share[order], in_class)


def _trained(names: Vocabulary) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(names.side)
        for part in portions(batches):
            w = _words(part)
            at, known = names.find(w.hash)
            ids = names.shared[_slot(w.hash)]
            ids[known] = names.ids[at[known]]
            trainer.learn(ids, contexts(ids, w.first, names.side**2))
        if trainer.seen:
            values = flat(trainer.weights)
            cuts = range(0, len(values), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(cuts))),
                    pa.array([values[a : a + BLOCK].tobytes() for a in cuts], pa.binary()),
                    pa.array(np.full(len(cuts), trainer.seen)),
                ],
                ["block", "weights", "seen"],
            )

    return trained


def _mean(copies: pa.Table) -> pa.Table:
    """One block of weights, averaged by the words seen."""
    seen = copies["seen"].to_numpy().astype(np.float64)
    total = 0.0
    for raw, n in zip(copies["weights"], seen, strict=True):
        total = total + np.frombuffer(raw.as_py(), np.float32) * n
    mean = (total / seen.sum()).astype(np.float32).tobytes()
    return pa.table({"block": copies["block"][:1], "weights": pa.array([mean], pa.binary())})


def train(docs: DataFrame, names: Vocabulary) -> Weights:
    """Weights averaged over the copies that the tasks trained; the start for an empty table."""
    copies = docs.select("text").mapInArrow(_trained(names), "block long, weights binary, seen long")
    values = flat(initial(names.side))
    for r in copies.groupBy("block").applyInArrow(_mean, "block long, weights binary").collect():
        mean = np.frombuffer(r["weights"], np.float32)
        values[r["block"] * BLOCK :][: len(mean)] = mean
    return shaped(values, names.side)


def _scored(names: Vocabulary | np.ndarray, weights: Weights) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sum over the words of each text; for words in rest it lacks the log of
    their count. An array instead of a vocabulary is the classes alone."""
    names = names if isinstance(names, Vocabulary) else bare(names, len(weights["group_bias"]))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            w = _words(part)
            at, known = names.find(w.hash)
            ids = names.shared[_slot(w.hash)]
            ids[known] = names.ids[at[known]]
            p = log_probabilities(weights, ids, contexts(ids, w.first, names.side**2))
            p += np.where(known, names.share[at] if len(names.share) else 0.0, -names.of_class[ids])
            upto = np.concatenate([[0], np.cumsum(p)])
            before = np.concatenate([[0], np.cumsum(~known)])[w.first]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(w.first)),
                    pa.array(upto[w.first[1:]] - upto[w.first[:-1]]),
                    pa.ListArray.from_arrays(pa.array(before, pa.int32()), signed(w.hash[~known])),
                ],
                ["doc_id", "n_tokens", "log_likelihood", "rest"],
            )

    return scored


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood for every row of docs (doc_id, text, ...).

    Null and wordless texts have no tokens, sum 0 and no mean. Repeated rows are
    counted, trained on and scored each. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = word_counts(rows)
    names = vocabulary(counts)
    scored = rows.mapInArrow(_scored(names, train(rows, names)), "doc_id long, n_tokens long, log_likelihood double, rest array<long>")
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()))
    # a word seen once adds log 1
    logs = counts.where("n > 1").select("hash", F.log("n").alias("log_n"))
    rest = scored.select("row", F.explode("rest").alias("hash")).join(logs.hint("merge"), "hash")
    added = rest.groupBy("row").agg(F.sum("log_n").alias("added"))
    whole = scored.drop("rest").join(added.hint("merge"), "row", "left").drop("row")
    whole = whole.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("added", F.lit(0.0))).drop("added")
    return whole.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", F.col("n_tokens").cast("double")))
