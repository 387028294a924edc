"""Benchmark decontamination by winnowed fingerprints.

Of every NEED consecutive k-grams of words the one with the smallest hash is
kept, in documents and in items alike. Two equal spans of WINDOW words keep the
same k-gram, so fingerprints joined on their hash meet every shared window.
Each meeting is then extended word by word in both directions; extents of
WINDOW words or more are hits. Items with fewer words than a window are
fingerprinted by their whole sequence instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.arrow import portions
from dosewise.llm.words import ALNUM, signed, sliding_min_positions, windows, words
from dosewise.session import stage

#: Words that have to agree.
WINDOW = 10
#: Words of a fingerprint.
GRAM = 5
#: k-grams of a window; one of them is kept.
NEED = WINDOW - GRAM + 1


def _prints(h: np.ndarray, first: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word position of the winnowed k-grams of each text, and of all
    its sequences of the given shorter lengths."""
    grams = windows(h, GRAM)
    spans = np.diff(first)
    full = np.maximum(spans - WINDOW + 1, 0)
    starts = np.arange(full.sum()) + np.repeat(first[:-1] - (np.cumsum(full) - full), full)
    at = np.unique(sliding_min_positions(grams, NEED)[starts])
    hashes, places = [grams[at]], [at]
    for n in lengths:
        count = np.maximum(spans - n + 1, 0)
        own = np.arange(count.sum()) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
        hashes.append(windows(h, n)[own])
        places.append(own)
    return np.concatenate(hashes), np.concatenate(places)


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in portions(batches):
        w = words(part.column("text"), ALNUM, lower=True)
        lists = pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), signed(w.hash))
        yield pa.RecordBatch.from_arrays([part.column("item_id"), lists], ["item_id", "item_words"])


def _item_prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, key, own in zip(*(batch.column(x) for x in ("item_id", "item_key", "item_words")), strict=True):
            h = own.values.to_numpy().view(np.uint64)
            n = len(h)
            if n >= WINDOW:
                hashes, places = _prints(h, np.array([0, n]), [])
            else:
                hashes, places = windows(h, n), np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([item.as_py()] * len(hashes), pa.int64()),
                    pa.array([key.as_py()] * len(hashes), pa.int64()),
                    signed(hashes),
                    pa.array(places.astype(np.int32)),
                ],
                ["item_id", "item_key", "print", "item_pos"],
            )


def _doc_prints(lengths: list[int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            keys = part.column("doc_key").to_numpy(zero_copy_only=False)
            w = words(part.column("text"), ALNUM, lower=True)
            hashes, places = _prints(w.hash, w.first, lengths)
            owner = np.searchsorted(w.first, places, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[owner].astype(np.int64)), signed(hashes), pa.array((places - w.first[owner]).astype(np.int32))],
                ["doc_key", "print", "pos"],
            )

    return prints


def _extend(doc: np.ndarray, item: np.ndarray, pos: int, item_pos: int) -> tuple[int, int]:
    """The longest equal span around word pos of doc and item_pos of item."""
    back = min(pos, item_pos)
    differ = np.flatnonzero(doc[pos - back : pos] != item[item_pos - back : item_pos])
    left = pos - back + (int(differ[-1]) + 1 if len(differ) else 0)
    ahead = min(len(doc) - pos, len(item) - item_pos)
    differ = np.flatnonzero(doc[pos : pos + ahead] != item[item_pos : item_pos + ahead])
    return left, pos + (int(differ[0]) if len(differ) else ahead)


def _extents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in portions(batches):
        w = words(part.column("text"), ALNUM, lower=True)
        n_words, n_hit, items, spans = np.diff(w.first), [], [], []
        for i, meets in enumerate(part.column("meets").to_pylist()):
            doc, found, got = w.hash[w.first[i] : w.first[i + 1]], [], set()
            for meet in meets or ():
                item = np.array(meet["item_words"], np.int64).view(np.uint64)
                done: dict[int, int] = {}
                for pos, item_pos in sorted(zip(meet["pos"], meet["item_pos"], strict=True)):
                    if pos >= len(doc) or pos < done.get(pos - item_pos, 0):
                        continue  # of another text, or within the last extent of this diagonal
                    a, b = _extend(doc, item, pos, item_pos)
                    done[pos - item_pos] = b
                    if b - a >= min(WINDOW, len(item)):
                        found.append((a, b))
                        got.add(meet["item_id"])
            cover = np.zeros(len(doc) + 1, np.int32)
            for a, b in found:
                cover[a] += 1
                cover[b] -= 1
            n_hit.append(int(np.count_nonzero(np.cumsum(cover[:-1]))))
            items.append(sorted(str(x) for x in got))
            spans.append([{"start": a, "end": b} for a, b in sorted(set(found))])
        carried = [x for x in part.schema.names if x == "rest"]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("text"),
                *(part.column(x) for x in carried),
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ],
            ["doc_id", "text", *carried, "n_words", "n_hit", "items", "spans"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, text, n_words, n_hit, items, spans for every row of docs.

    With carry, rest holds the row's columns but the text.

    items are the ids of the benchmark rows that have a window in the document,
    sorted as strings; spans the hit word ranges. Null and wordless texts have
    no words and no hits; benchmark rows without id or words are left out, and
    rows that share an id count once. Rows without doc_id are compared like the
    others. Other columns are ignored; an empty table on either side gives no hits.
    """
    rest = [F.struct(*(x for x in docs.columns if x != "text")).alias("rest")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    items = stage(
        benchmark.where("item_id is not null")
        .select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_item_words, "item_id long, item_words array<long>")
        .where(F.size("item_words") > 0).distinct().withColumn("item_key", F.xxhash64("item_words"))
    )
    prints = stage(items.mapInArrow(_item_prints, "item_id long, item_key long, print long, item_pos int"))
    short = items.where(F.size("item_words") < WINDOW).select(F.size("item_words").alias("n")).distinct()
    lengths = sorted(r["n"] for r in short.collect())  # at most WINDOW - 1 numbers
    # rows meet by id and text; each checks its meetings word by word
    keyed = docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))
    meets = (
        keyed.select("doc_key", "text").mapInArrow(_doc_prints(lengths), "doc_key long, print long, pos int")
        .join(prints, "print")
        .groupBy("doc_key", "item_id", "item_key")
        .agg(F.collect_set(F.struct("pos", "item_pos")).alias("at"))
        .join(items.hint("merge"), ["item_id", "item_key"])  # the words of an item once for each document it meets
        .groupBy("doc_key")
        .agg(
            F.collect_list(
                F.struct("item_id", "item_words", F.col("at.pos").alias("pos"), F.col("at.item_pos").alias("item_pos"))
            ).alias("meets")
        )
    )
    carried = f"rest {keyed.schema['rest'].dataType.simpleString()}, " if carry else ""
    return (
        keyed.join(stage(meets).hint("merge"), "doc_key", "left")  # of any size: the plan is the same for all
        .select("doc_id", "text", *(["rest"] if carry else []), "meets")
        .mapInArrow(
            _extents,
            f"doc_id long, text string, {carried}n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>",
        )
    )
