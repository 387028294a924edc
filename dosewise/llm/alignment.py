"""Alignment of two tokenizers by their tokens' bytes, with an identity-map fast path.

Tokenizer A is byte-level BPE (a JSON file of the tokenizers library), B a
sentencepiece model. Both cut the same bytes, a blank and the text. Offsets
where tokens of both end cut the tokens into groups; tokens link where their
byte ranges overlap. For every id of A the id of B with the same bytes is known
beforehand. A group of one token each, tied by that map, is only counted, in a
vector as long as the vocabulary; the pairs of the other, irregular groups are
added up in each portion and then shuffled.

Neither tokenizer joins across a blank that follows something other than white
space (for B this is looked up in its pieces), so a text is cut there and each
distinct piece of it is tokenised and aligned once while a worker keeps it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.arrow import portions
from dosewise.llm.token_counts import WHITE
from dosewise.llm.words import ranges, text_buffer
from dosewise.session import stage

#: Distinct pieces that a Python worker keeps, and characters of a text aligned at once.
KEPT_PIECES, SLICE = 150_000, 1 << 20
#: Pieces that are encoded in one text.
JOINED = 20_000
#: A pair with at least one in so many of all links is looked up in a table in
#: memory: there are at most so many. The others are joined.
HEAVY = 1 << 20

_BREAK = re.compile(f"(?<=[^{WHITE}])(?= )")
_WHITE_BLANK = re.compile(r"\s ")


def byte_symbols() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable
    Latin-1 characters stand for themselves, the others for 256 and up, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def cut(text: str) -> list[str]:
    """The pieces of a blank and the text, each without the blank it starts with."""
    text = " " + text
    if _WHITE_BLANK.search(text):
        return [p[1:] for p in _BREAK.split(text)]
    return text.split(" ")[1:]


def slices(text: str) -> Iterator[str]:
    """text in runs of at least SLICE characters that are cut like pieces; the blank at a cut is left out."""
    a = 0
    while len(text) - a > SLICE:
        b = text.find(" ", a + SLICE)
        while b > 0 and (text[b - 1] in WHITE or text[b - 1].isspace()):
            b = text.find(" ", b + 1)
        if b < 0:
            break
        yield text[a:b]
        a = b + 1
    yield text[a:]


class Profile(NamedTuple):
    """What a text's tokens are: counts, the groups as text, the ids of one-to-one
    groups and the pairs of the others, both with how often they occur."""

    sizes: np.ndarray  # tokens of A, of B, groups, links
    groups: list[str]
    ids: np.ndarray
    ids_n: np.ndarray
    pairs: np.ndarray
    pairs_n: np.ndarray


class Aligner:
    """Aligned pieces of texts for one pair of tokenizer files."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols = byte_symbols()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(symbols[c] for c in token)
        size = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [
            bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
            else n.replace("▁", " ").encode()
            for i, n in enumerate(names)
        ]
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError(f"{path_b} has pieces that go on after a blank")
        self.blank = self.b.piece_to_id("▁")
        self.width = size
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # where two pieces have the same bytes, the one that is no byte piece
        same = {x: i for by_byte in (True, False) for i, x in enumerate(self.bytes_b) if x and self.b.is_byte(i) == by_byte}
        self.identity = np.array([same.get(x, -1) for x in self.bytes_a], np.int64)
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(x), np.uint8) for x in (self.bytes_a, self.bytes_b))
        # each id of A followed by , or |, each of B by , or ;
        self.names = [f"{i}{c}" for ids, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for i in range(len(ids)) for c in ends]
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.good = np.zeros(0, bool)
        self.sizes = np.zeros((0, 4), np.int64)
        self.ids, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids_end, self.pairs_end = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _add(self, new: list[str]) -> None:
        """Tokenise and align pieces that are not kept."""
        data, starts = text_buffer(pc.binary_join_element_wise("", pa.array(new, pa.string()), " "))
        a, n_a = self._tokens_a(new, starts)
        b, n_b = self._tokens_b(new)
        good = _same_bytes(a, n_a, self.flat_a, self.length_a, data, starts)
        good &= _same_bytes(b, n_b, self.flat_b, self.length_b, data, starts)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.union1d(end_a, end_b)  # a link ends at each, and there is no other
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        last = (end_a[at_a] == ends) & (end_b[at_b] == ends) if len(ends) else np.zeros(0, bool)
        piece = np.repeat(np.arange(len(new)), n_a)[at_a]
        single = last & np.concatenate([[True], last[:-1]]) if len(ends) else last
        exact = single & (self.identity[a[at_a]] == b[at_b])
        count = lambda of: np.bincount(of, minlength=len(new))
        sizes = np.stack([n_a, n_b, count(piece[last]), count(piece)], axis=1)
        # the groups as text: an id and what stands after it, ids of A before those of B
        to_a, to_b = at_a[last] + 1, at_b[last] + 1
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[to_a - 1], after_b[to_b - 1] = 1, 1
        group_a, group_b = np.cumsum(after_a) - after_a, np.cumsum(after_b) - after_b
        place = np.empty(len(a) + len(b), np.int64)
        token = np.concatenate([a * 2 + after_a, (len(self.bytes_a) + b) * 2 + after_b])
        place[np.arange(len(a)) + np.concatenate([[0], to_b])[group_a]] = token[: len(a)]
        place[np.arange(len(b)) + to_a[group_b]] = token[len(a) :]
        texts = list(map(self.names.__getitem__, place.tolist()))
        many = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        self.groups += ["".join(texts[x:y])[:-1] for x, y in zip(many, many[1:], strict=False)]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.good = np.concatenate([self.good, good])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids_end = np.concatenate([self.ids_end, len(self.ids) + np.cumsum(count(piece[exact]))])
        self.ids = np.concatenate([self.ids, a[at_a[exact]]])
        self.pairs_end = np.concatenate([self.pairs_end, len(self.pairs) + np.cumsum(count(piece[~exact]))])
        self.pairs = np.concatenate([self.pairs, a[at_a[~exact]] * self.width + b[at_b[~exact]]])

    def _tokens_a(self, new: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A of all pieces, and how many each has. Pieces that a blank and then no
        white space starts and ends are encoded many in a text, told apart by the tokens' bytes."""
        among = np.array([p != "" and not (p[0].isspace() or p[-1].isspace()) for p in new], bool)
        inner = [f" {p}" for p in compress(new, among)]
        joined, _ = self._of_a(["".join(inner[i : i + JOINED]) for i in range(0, len(inner), JOINED)])
        ends, upto = np.cumsum(np.diff(starts)[among]), np.cumsum(self.length_a[joined])
        at = np.searchsorted(upto, ends)
        if inner and (at[-1] != len(upto) - 1 or (upto[at] != ends).any()):
            return self._of_a([f" {p}" for p in new])
        rest, many = self._of_a([f" {p}" for p in compress(new, ~among)])
        sizes = np.zeros(len(new), np.int64)
        sizes[among], sizes[~among] = np.diff(at, prepend=-1), many
        ids = np.empty(int(sizes.sum()), np.int64)
        own = np.repeat(among, sizes)
        ids[own], ids[~own] = joined, rest
        return ids, sizes

    def _of_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int64), *coded]), np.array([len(x) for x in coded], np.int64)

    def _tokens_b(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of B of all pieces, and how many each has."""
        coded = [x if p else [self.blank] for p, x in zip(new, self.b.encode(new, num_threads=1), strict=True)]
        sizes = np.array(list(map(len, coded)), np.int64)
        return np.array(list(chain.from_iterable(coded)), np.int64), sizes

    def profiles(self, texts: list[str]) -> list[Profile | None]:
        """The profile of each text, None where the bytes of the tokens are not those of the text."""
        pieces = [cut(t) for t in texts]
        new = set(chain.from_iterable(pieces)).difference(self.index)
        if len(self.index) + len(new) > KEPT_PIECES:
            self._clear()
            new = set(chain.from_iterable(pieces))
        if new:
            self._add(list(new))
        count = np.array([len(x) for x in pieces], np.int64)
        flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(pieces)), np.int64, int(count.sum()))
        owner = np.repeat(np.arange(len(texts)), count)
        at = np.concatenate([[0], np.cumsum(count)])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sizes[flat], axis=0)])
        bad = np.bincount(owner[~self.good[flat]], minlength=len(texts)) > 0
        held, n = np.unique(owner * len(self.index) + flat, return_counts=True)
        own, piece = held // len(self.index), held % len(self.index)
        ids = _totals(own, piece, n, self.ids, self.ids_end, len(self.bytes_a), len(texts))
        pairs = _totals(own, piece, n, self.pairs, self.pairs_end, len(self.bytes_a) * self.width, len(texts))
        flat = flat.tolist()
        return [
            None if bad[i] else Profile(
                sums[at[i + 1]] - sums[at[i]], list(map(self.groups.__getitem__, flat[at[i] : at[i + 1]])), *ids[i], *pairs[i]
            )
            for i in range(len(texts))
        ]


def _same_bytes(ids: np.ndarray, n: np.ndarray, flat: np.ndarray, length: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the bytes of the tokens of each piece, n of all ids, are those of the piece."""
    upto = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], np.cumsum(n)])]
    good = np.diff(upto) == np.diff(starts)
    own = np.repeat(good, n)
    joined = flat[ranges((np.cumsum(length) - length)[ids[own]], length[ids[own]])]
    whole = np.repeat(good, np.diff(starts))
    wrong = joined != data[whole]
    good[np.repeat(np.arange(len(n)), np.diff(starts))[whole][wrong]] = False
    return good


def _totals(
    own: np.ndarray, piece: np.ndarray, n: np.ndarray, values: np.ndarray, end: np.ndarray, limit: int, texts: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the distinct values of its pieces and how often they occur."""
    many = (end[1:] - end[:-1])[piece]
    key = np.repeat(own, many) * limit + values[ranges(end[piece], many)]
    key, total = _summed(key, np.repeat(n, many))
    at = np.searchsorted(key // limit, np.arange(texts + 1))
    return [(key[x:y] % limit, total[x:y]) for x, y in zip(at, at[1:], strict=False)]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One aligner for two files in each Python worker, kept from task to task."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def text_profiles(aligner: Aligner, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str | None, bytes, Profile | None]]:
    """For each text its sizes, the sha256 of its groups (None without tokens), the
    groups as UTF-8 and the ids and pairs; a long text is aligned a slice at a time."""
    runs: list[list[tuple[int, str]]] = [[]]
    room = SLICE
    for i, text in enumerate(texts):
        for part in slices(text or ""):
            if room < len(part):
                runs.append([])
                room = SLICE
            runs[-1].append((i, part))
            room -= len(part)
    done = ((i, p) for run in runs for i, p in zip([i for i, _ in run], aligner.profiles([t for _, t in run]), strict=True))
    none = np.zeros(4, np.int64)
    nothing = np.zeros(0, np.int64)
    waiting: list[Profile | None] = []

    def closed(i: int) -> tuple[np.ndarray, str | None, bytes, Profile | None]:
        if not texts[i] or None in waiting:
            return none, None, b"", Profile(none, [], nothing, nothing, nothing, nothing)
        text = ";".join(chain.from_iterable(p.groups for p in waiting)).encode()
        p = waiting[0]
        if len(waiting) > 1:
            ids = _summed(*(np.concatenate([getattr(x, f) for x in waiting]) for f in ("ids", "ids_n")))
            pairs = _summed(*(np.concatenate([getattr(x, f) for x in waiting]) for f in ("pairs", "pairs_n")))
            p = Profile(np.sum([x.sizes for x in waiting], axis=0), [], *ids, *pairs)
        return p.sizes, hashlib.sha256(text).hexdigest(), text, p

    last = 0
    for i, profile in done:
        if i != last:
            yield closed(last)
            waiting, last = [], i
        waiting.append(profile)
    if texts:
        yield closed(last)


_PROFILES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, ids binary, ids_n binary, pairs binary, pairs_n binary"


def _profiled(path_a: str, path_b: str, keep: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def profiled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for part in portions(batches):
            rows = list(text_profiles(aligner, part.column("text").to_pylist()))
            sizes = np.array([r[0] for r in rows]).T
            packed = lambda name, kind: pa.array([getattr(r[3], name).astype(kind).tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), *map(pa.array, sizes), pa.array([r[1] or "" for r in rows]),
                    pa.array([r[2].decode() if keep else None for r in rows], pa.string()),
                    packed("ids", "<u4"), packed("ids_n", "<u4"), packed("pairs", "<i8"), packed("pairs_n", "<u4"),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "ids", "ids_n", "pairs", "pairs_n"],
            )

    return profiled


def _column(part: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(part.column(name).to_pylist()), kind).astype(np.int64)


def _counted_ids(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One vector of the vocabulary's length for a task; what is not zero leaves it."""
        total = np.zeros(size, np.int64)
        for part in portions(batches, "ids"):
            np.add.at(total, _column(part, "ids", "<u4"), _column(part, "ids_n", "<u4"))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["a", "n"])

    return counted


def _counted_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in portions(batches, "pairs", 8 << 20):
        pairs, n = _summed(_column(part, "pairs", "<i8"), _column(part, "pairs_n", "<u4"))
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])


class Known(NamedTuple):
    """Counts that every task has: of heavy pairs, by pair; of the identity's pairs,
    by A id; the highest of each B id."""

    pairs: np.ndarray
    counts: np.ndarray
    of_id: np.ndarray
    identity: np.ndarray
    best: np.ndarray
    width: int


def _owners(part: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    sizes = np.array([len(x) // width for x in part.column(name).to_pylist()], np.int64)
    return np.repeat(np.arange(part.num_rows), sizes)


def _heavy_counts(known: Known, pairs: np.ndarray) -> np.ndarray:
    """The count of each pair, 0 for those that are not heavy."""
    if not len(known.pairs):
        return np.zeros(len(pairs), np.int64)
    at = np.minimum(np.searchsorted(known.pairs, pairs), len(known.pairs) - 1)
    return np.where(known.pairs[at] == pairs, known.counts[at], 0)


def _looked_up(known: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the links of ids and heavy pairs."""
        k: Known = known.value
        for part in portions(batches, "pairs", 8 << 20):
            sums = np.zeros((2, part.num_rows), np.int64)
            ids, pairs = _column(part, "ids", "<u4"), _column(part, "pairs", "<i8")
            for owner, n, count, b in (
                (_owners(part, "ids", 4), _column(part, "ids_n", "<u4"), k.of_id[ids], k.identity[ids]),
                (_owners(part, "pairs", 8), _column(part, "pairs_n", "<u4"), _heavy_counts(k, pairs), pairs % k.width),
            ):
                np.add.at(sums[0], owner, np.where((count > 0) & (count == k.best[b]), n, 0))
                np.add.at(sums[1], owner, n * count)
            rest = [x for x in part.schema.names if x not in ("ids", "ids_n", "pairs", "pairs_n")]
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in rest), *map(pa.array, sums)], [*rest, "n_best", "count_sum"])

    return looked_up


def _rare(known: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of each document that are not heavy."""
        k: Known = known.value
        for part in portions(batches, "pairs", 8 << 20):
            pairs = _column(part, "pairs", "<i8")
            rest = np.flatnonzero(_heavy_counts(k, pairs) == 0)
            row = part.column("row").to_numpy()[_owners(part, "pairs", 8)[rest]]
            n, best = _column(part, "pairs_n", "<u4")[rest], k.best[pairs[rest] % k.width]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, pairs[rest], n, best)], ["row", "pair", "times", "best"])

    return rare


class Alignment(NamedTuple):
    """documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 and groups. pairs: a, b and n, the links of each pair of ids."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, heavy: int = HEAVY) -> Alignment:
    """Align the tokens of each text of docs (doc_id, text, ...) and count linked pairs of ids.

    A text that is null or empty, or whose tokens' bytes are not a blank and the
    text, has no tokens: zeros, and '' for groups_sha256. Every row, repeated or
    without doc_id, has a result of its own and counts. n_best are the links whose
    pair is as frequent as the most frequent pair of its B id, so ties count.
    An empty table has no rows. Other columns are ignored. A very long text is
    aligned a slice at a time, its row carries its distinct ids and pairs.
    keep_groups also returns the groups as text (`a1,a2|b1;a3|b2,b3`), else null.
    heavy bounds the pairs that are looked up in memory; the rest is joined, so
    the result doesn't depend on it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = stage(
        rows.mapInArrow(_profiled(path_a, path_b, keep_groups), _PROFILES).withColumn("row", F.monotonically_increasing_id())
    )
    aligner = aligner_of(path_a, path_b)
    width, size = aligner.width, len(aligner.bytes_a)
    by_id = profiles.select("ids", "ids_n").mapInArrow(_counted_ids(size), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    tied = spark.createDataFrame([(a, b) for a, b in enumerate(aligner.identity.tolist()) if b >= 0], "a long, b long")
    exact = by_id.join(tied.hint("merge"), "a").select((F.col("a") * width + F.col("b")).alias("pair"), "n")
    irregular = profiles.select("pairs", "pairs_n").mapInArrow(_counted_pairs, "pair long, n long")
    irregular = irregular.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stage(irregular.unionByName(exact).groupBy("pair").agg(F.sum("n").alias("n")))
    a, b = F.floor(F.col("pair") / width).cast("long"), (F.col("pair") % width).alias("b")
    links = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where(F.col("n") * heavy >= links).orderBy("pair").toPandas()  # heavy rows at most
    own = counts.join(tied.select((F.col("a") * width + F.col("b")).alias("pair"), "a").hint("merge"), "pair").select("a", "n").toPandas()
    highest = counts.groupBy(b).agg(F.max("n").alias("n")).toPandas()  # a row for each id of B
    of_id, best = np.zeros(size, np.int64), np.zeros(width, np.int64)
    of_id[own["a"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
    best[highest["b"].to_numpy(np.int64)] = highest["n"].to_numpy(np.int64)
    table = Known(often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64), of_id, aligner.identity, best, width)
    known = spark.sparkContext.broadcast(table)
    kept = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
    names = [x.split()[0] for x in kept.split(", ")]
    sums = profiles.select(*names, "ids", "ids_n", "pairs", "pairs_n").mapInArrow(
        _looked_up(known), f"{kept}, n_best long, count_sum long"
    )
    rest = profiles.select("row", "pairs", "pairs_n").mapInArrow(_rare(known), "row long, pair long, times long, best long")
    more = (
        rest.join(counts.hint("merge"), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("n") * F.col("times")).alias("more_sum"),
        )
    )
    documents = sums.join(more.hint("merge"), "row", "left").select(
        *names[1:6],
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        *names[6:],
    )
    return Alignment(documents, counts.select(a.alias("a"), b, "n"))
