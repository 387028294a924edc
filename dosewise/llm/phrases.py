"""Phrase collocations by set-oriented mining of occurrence relations.

R1 holds the occurrences of words, sorted by piece and position: a portion of
texts a row, the words as numbers of a dictionary of its own, breaks between
pieces. From each length to the next

1. occurrences are counted in their portion, then over all after a shuffle by
   phrase, which gives every frequent phrase an id;
2. the ids go back to the portions that have the phrase (the semi-join), and
   occurrences of other phrases leave the relation;
3. occurrences at adjacent positions of a piece merge to one of a longer phrase,
   named by the ids of its first and last words but one: no text is compared.

What travels are the distinct phrases of a portion, not occurrences, and from
two words on packed: the pairs of ids of one hash bucket, sorted, in one row.
There are as many buckets as the occurrences need, so a bucket fits into a task.
Ids stand for exact words; only inside a portion are words told apart by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.llm.arrow import portions
from dosewise.llm.words import SECOND_BASE, Words, _class, mix, words
from dosewise.session import stage

#: Language of documents without one.
NO_LANGUAGE = "und"
#: Longest phrase, occurrences that make a phrase frequent, phrases reported for a language.
LONGEST, LEAST, BEST = 5, 100, 2000
#: A phrase goes if one that contains it has at least this percentage of its occurrences.
SHARE = 100
#: Bytes of text and words in a portion; a portion ends between pieces.
TEXT, WORDS = 8 << 20, 1 << 20
#: Occurrences for which a bucket of phrases is added; it holds no more distinct phrases of portions.
PER_BUCKET = 2 << 20

#: Ends of pieces: . , ; : ! ? and line feed to carriage return. Words also end at blank and tab.
_PIECE_ENDS = [*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D)]
_WORD = _class([(0x20, 0x20), (0x09, 0x09), *_PIECE_ENDS])
_INSIDE = _class(_PIECE_ENDS)
#: Stands between runs of adjacent occurrences.
BREAK = np.uint32(0xFFFFFFFF)

_FIRST = "portion long, relation binary, lang string, word string, local int, n long"


def _runs(values: np.ndarray, last: np.ndarray) -> np.ndarray:
    """values with a break after each that is the last of its run."""
    out = np.full(len(values) + int(last.sum()), BREAK, np.uint32)
    out[np.arange(len(values)) + np.cumsum(last) - last] = values
    return out


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """R1 of each portion and the portion's dictionary of (language, word)."""
    portion = TaskContext.get().partitionId() << 32
    for part in portions(batches, size=TEXT):
        w = words(part.column("text"), _WORD, lower=True)
        if not len(w.hash):
            continue
        langs = part.column("lang").dictionary_encode()
        lang_of = langs.indices.to_numpy()
        last = _lasts(w)
        lang = np.repeat(lang_of, np.diff(w.first))
        key = mix(w.hash + (lang.astype(np.uint64) + np.uint64(1)) * np.uint64(SECOND_BASE))
        stops = np.flatnonzero(last) + 1
        cuts = [0, *stops[np.flatnonzero(np.diff(stops // WORDS)) + 1].tolist(), len(key)]
        data = memoryview(w.data)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            _, at, local, n = np.unique(key[a:b], return_index=True, return_inverse=True, return_counts=True)
            at += a
            text = [str(data[x:y], "utf-8") for x, y in zip(w.begin[at].tolist(), w.end[at].tolist(), strict=True)]
            relation = _runs(local.astype(np.uint32), last[a:b])
            yield _batch(portion, squeeze(relation), langs.dictionary.take(pa.array(lang[at])), pc.ascii_lower(pa.array(text, pa.string())), n)
            portion += 1


def _lasts(w: Words) -> np.ndarray:
    """Whether a word is the last of its piece: an end of pieces or of the text comes before the next word."""
    ends = np.concatenate([np.flatnonzero(~_INSIDE[w.data]), [len(w.data)]])
    last = np.ones(len(w.hash), bool)
    last[:-1] = ends[np.searchsorted(ends, w.end[:-1])] < w.begin[1:]
    last[w.first[1:][w.first[1:] > 0] - 1] = True
    return last


def _batch(portion: int, relation: bytes, lang: pa.Array, word: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """A row with the relation, and one for each word of the dictionary."""
    after = lambda x: pa.concat_arrays([pa.nulls(1, x.type), x])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(n) + 1, portion)), pa.concat_arrays([pa.array([relation], pa.binary()), pa.nulls(len(n), pa.binary())]),
            after(lang), after(word), after(pa.array(np.arange(len(n), dtype=np.int32))), after(pa.array(n, pa.int64())),
        ],
        ["portion", "relation", "lang", "word", "local", "n"],
    )


_NEXT = "portion long, relation binary, bucket int, start int, head binary, tail binary, n binary"
_WORDS = "id long, lang string, word string, f long, portion long, local binary, ids binary"
_COUNTED = "id long, head long, tail long, f long, portion long, local binary, ids binary"


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of an array, those of equal weight together, compressed."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def expand(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T.copy().view(kind).reshape(-1)


def extend(relation: np.ndarray, local: np.ndarray, ids: np.ndarray, further: bool = True, buckets: int = 1) -> tuple[np.ndarray, ...]:
    """Semi-join and merge-join of a portion's relation.

    relation: numbers of phrases in order, with breaks. local: the frequent of
    them, ids: their ids. Returns the relation of phrases a word longer (empty
    if it is not needed further) and, for each of its numbers, the ids of the
    first and last words but one, the occurrences, and the bucket, in the order
    of which they are numbered.
    """
    kept = np.zeros(max(int(relation[relation != BREAK].max(initial=0)), int(local.max(initial=0))) + 2, bool)
    kept[local] = True
    here = kept[np.where(relation == BREAK, len(kept) - 1, relation)]
    at = np.flatnonzero(here[:-1] & here[1:])
    key = relation[at].astype(np.uint64) << np.uint64(32) | relation[at + 1].astype(np.uint64)
    new, number, n = np.unique(key, return_inverse=True, return_counts=True)
    id_of = np.zeros(len(kept), np.int64)
    id_of[local] = ids
    head, tail = id_of[(new >> np.uint64(32)).astype(np.int64)], id_of[(new & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    bucket = (mix(head.view(np.uint64) * np.uint64(SECOND_BASE) + tail.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((tail, head, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    last = np.concatenate([np.diff(at) > 1, [True]]) if len(at) else np.zeros(0, bool)
    longer = _runs(place[number].astype(np.uint32), last) if further else np.zeros(0, np.uint32)
    return longer, head[order], tail[order], n[order], bucket[order]


def _extended(occurrences: DataFrame, found: DataFrame, further: bool, buckets: int) -> DataFrame:
    """Relations (place, relation) and their frequent phrases -> the next: a row with
    the relation, and one with the phrases of each bucket."""

    def extended(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows:
            portion = left.column("place")[0].as_py()
            whole = lambda name, kind: np.concatenate([np.zeros(0, kind), *(expand(x, kind) for x in right.column(name).to_pylist())])
            relation = expand(left.column("relation")[0].as_py(), np.uint32)
            longer, head, tail, n, bucket = extend(relation, whole("local", np.uint32).astype(np.int64), whole("ids", np.int64), further, buckets)
            rows.append((portion, squeeze(longer), None, None, None, None, None))
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                parts = (squeeze(np.diff(head[a:b], prepend=0)), squeeze(tail[a:b]), squeeze(n[a:b].astype(np.uint32)))
                rows.append((portion, None, int(bucket[a]), a, *parts))
        return _table(rows, _NEXT)

    return occurrences.groupBy("place").cogroup(found.groupBy("portion")).applyInArrow(extended, _NEXT)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _counted_words(known: DataFrame, least: int, buckets: int) -> DataFrame:
    """Group-count of the portions' words by hash bucket: a row (id, lang, word, f) for
    each frequent one, and for each portion (portion, local, ids) which of its words these are."""

    def counted(rows: pa.Table) -> pa.Table:
        lang, word = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "word"))
        key = lang.indices.to_numpy().astype(np.int64) * len(word.dictionary) + word.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        first = np.flatnonzero(new)
        f = np.add.reduceat(rows.column("n").to_numpy()[order], first)
        often = f >= least
        ids = (rows.column("bucket")[0].as_py() << 32) + np.cumsum(often) - 1
        own = pa.array(order[first[often]])
        texts = (rows.column(c).take(own).to_pylist() for c in ("lang", "word"))
        out = [(*x, None, None, None) for x in zip(ids[often].tolist(), *texts, f[often].tolist(), strict=True)]
        number = np.cumsum(new) - 1
        hits = np.flatnonzero(often[number])
        at, id_of = order[hits], ids[number[hits]]
        portion, local = rows.column("portion").to_numpy()[at], rows.column("local").to_numpy()[at]
        place = np.argsort(portion, kind="stable")
        cuts = np.flatnonzero(np.diff(portion[place], prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            mine = place[a:b]
            out.append((None, None, None, None, int(portion[mine[0]]), squeeze(local[mine].astype(np.uint32)), squeeze(id_of[mine])))
        return _table(out, _WORDS)

    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)).cast("int").alias("bucket")
    return known.select(bucket, "portion", "lang", "word", "local", "n").groupBy("bucket").applyInArrow(counted, _WORDS)


def _counted(phrases: DataFrame, least: int) -> DataFrame:
    """Group-count of packed phrases: a row (id, head, tail, f) for each frequent
    one, and for each portion's row (portion, local, ids) which of its phrases these are."""

    def counted(rows: pa.Table) -> pa.Table:
        heads = [np.cumsum(expand(x, np.int64)) for x in rows.column("head").to_pylist()]
        size = np.array([len(x) for x in heads])
        head = np.concatenate(heads)
        tail = np.concatenate([expand(x, np.int64) for x in rows.column("tail").to_pylist()])
        n = np.concatenate([expand(x, np.uint32) for x in rows.column("n").to_pylist()]).astype(np.int64)
        order = np.lexsort((tail, head))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(head[order]) != 0) | (np.diff(tail[order]) != 0)
        first = np.flatnonzero(new)
        f = np.add.reduceat(n[order], first)
        often = f >= least
        ids = (rows.column("bucket")[0].as_py() << 32) + np.cumsum(often) - 1
        own = order[first[often]]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        out = [(*x, None, None, None) for x in zip(ids[often].tolist(), head[own].tolist(), tail[own].tolist(), f[often].tolist(), strict=True)]
        ends = np.cumsum(size)
        for portion, start, a, b in zip(rows.column("portion").to_pylist(), rows.column("start").to_pylist(), ends - size, ends, strict=True):
            mine = number[a:b]
            hits = np.flatnonzero(often[mine])
            if len(hits):
                out.append((None, None, None, None, portion, squeeze((hits + start).astype(np.uint32)), squeeze(ids[mine[hits]])))
        return _table(out, _COUNTED)

    return phrases.groupBy("bucket").applyInArrow(counted, _COUNTED)


def _described(counted: DataFrame, shorter: DataFrame) -> DataFrame:
    """counted (id, head, tail, f) with language, text, last word, and the counts of
    its first 1, 2, ... words (heads) and last 1, 2, ... words (tails)."""
    first = shorter.select(
        F.col("id").alias("head"), "lang", F.col("phrase").alias("start"), F.array_append("heads", F.col("f")).alias("heads")
    )
    second = shorter.select(F.col("id").alias("tail"), "last", F.array_append("tails", F.col("f")).alias("tails"))
    rows = counted.join(first, "head").join(second, "tail")
    phrase = F.concat_ws(" ", "start", "last").alias("phrase")
    return rows.select("id", "head", "tail", "lang", phrase, "last", "f", "heads", "tails")


def _score() -> Column:
    """Of all cuts that with the lowest score, then the earliest: score, k, l, r.
    Decimals of 38 digits hold the products; `div` is exact."""
    wide = "cast({} as decimal(19, 0))".format
    product = f"cast(1000 as decimal(4, 0)) * {wide('f')} * {wide('total')}"
    parts = f"{wide('heads[k - 1]')} * {wide('tails[size(heads) - k]')}"
    return F.expr(
        f"array_min(transform(sequence(1, size(heads)), k -> named_struct('score', ({product}) div ({parts}), 'k', k,"
        " 'l', heads[k - 1], 'r', tails[size(heads) - k])))"
    )


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """The words of each language (lang, total), and for every length from 1 to
    longest the phrases with at least `least` occurrences."""
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), text)
    now = stage(rows.mapInArrow(_occurrences, _FIRST))
    known = now.where("local is not null")
    totals = stage(known.groupBy("lang").agg(F.sum("n").alias("total")))
    most = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    counted = stage(_counted_words(known, least, most // PER_BUCKET + 1))
    none = F.array().cast("array<long>")
    word = F.col("word")
    first = counted.where("id is not null").select(
        "id", "lang", word.alias("phrase"), word.alias("last"), "f", none.alias("heads"), none.alias("tails")
    )
    levels = [first]
    found = counted.where("portion is not null").select("portion", "local", "ids")
    for length in range(2, longest + 1):
        most = levels[-1].agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
        relations = now.where("relation is not null").select(F.col("portion").alias("place"), "relation")
        now = stage(_extended(relations, found, length < longest, most // PER_BUCKET + 1))
        counted = stage(_counted(now.where("bucket is not null"), least))
        levels.append(stage(_described(counted.where("id is not null").select("id", "head", "tail", "f"), levels[-1])))
        found = counted.where("portion is not null").select("portion", "local", "ids")
    return totals, levels


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, share: int = SHARE) -> DataFrame:
    """The best phrases of each language of docs (text, lang, ...).

    Pieces end at . , ; : ! ? and at line feed to carriage return, words at blank
    and tab; A-Z are lower case. Phrases are 2 to longest consecutive words of a
    piece with a >= least occurrences, overlaps included. Cut after k words the
    score is floor(1000 * a * n / (l * r)), l and r being the occurrences of the
    parts and n the words of the language; the lowest cut counts, of equal ones
    the first. A phrase inside a longer one that has share per cent of its
    occurrences goes. Returned are lang, rank (from 1: by score, then a, both
    descending, then text in byte order), phrase, a, l, r, n and score.

    A null lang is NO_LANGUAGE, a null text is empty. Every row counts, repeated
    ones too; other columns and doc_id are ignored. An empty table, and a
    language without frequent phrases, have no rows. A text longer than a portion
    is cut between pieces; only a single piece has to fit into memory.
    """
    totals, levels = frequent_phrases(docs, least, longest)
    kept = []
    for i, phrases in enumerate(levels[1:], 1):
        if i + 1 < len(levels):
            longer = levels[i + 1]
            inside = longer.select(F.col("head").alias("id"), F.col("f").alias("most")).union(longer.select("tail", "f"))
            inside = inside.groupBy("id").agg(F.max("most").alias("most"))
            phrases = phrases.join(inside, "id", "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * share))
        kept.append(phrases.select("lang", "phrase", "f", "heads", "tails"))
    if not kept:
        raise ValueError("longest must be 2 or more")
    scored = reduce(DataFrame.union, kept).join(totals, "lang").withColumn("cut", _score())
    rows = scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
