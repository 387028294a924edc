"""Removal of long word sequences that an earlier document has, by de Bruijn compaction.

Edges of the graph are WINDOW consecutive words. Only edges that may repeat are
made: each window has an anchor, its smallest hashed k-gram, and equal windows
have equal anchors, so windows whose anchor occurs in one document alone are
unique. Each repeated edge gets a source coordinate: the smallest document that
has it, and the place there. A path goes on from one edge to the next while the
source goes on too, in the same document one word later; where it does not, the
graph branches. Compacted paths (start, edges, source document, source start)
carry both coordinates, which tell matches of long spans from chance: neighbours
on a path confirm one another.

The rows for an edge that very many documents share are reduced before any
shuffle: a portion of documents sends its smallest one and settles the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewise.llm.arrow import portions
from dosewise.llm.words import SPACED, Words, mix, ranges, sliding_min_positions, window_counts, windows, words

#: Words of an edge.
WINDOW = 13
#: Words of an anchor.
GRAM = 5


def _anchored(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and anchor (position) of each window."""
    counts = window_counts(w.first, WINDOW)
    starts = ranges(w.first[:-1], counts)
    at = sliding_min_positions(windows(w.hash, GRAM), WINDOW - GRAM + 1)
    return starts, np.repeat(np.arange(len(counts)), counts), at[starts]


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, doc_id) of anchors to compare with other portions, doc_id null for
    one that several documents here have; those documents get (found, doc_id)."""
    for part in portions(batches):
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        w = words(part.column("text"), SPACED, lower=False)
        _, owner, at = _anchored(w)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        token, doc = windows(w.hash, GRAM)[at[new]], ids[owner[new]].astype(np.int64)
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
        run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(token))))
        if len(token):
            several = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins)
        else:
            several = np.zeros(0, bool)
        local = several[run]
        first = np.zeros(len(token), bool)
        first[begins] = True
        alone, witness = first & ~local, first & local
        out_token = np.concatenate([token[alone], token[witness], np.zeros(local.sum(), np.uint64)]).view(np.int64)
        out_doc = np.concatenate([doc[alone], np.zeros(witness.sum(), np.int64), doc[local]])
        out_found = np.concatenate([np.zeros(first.sum(), np.uint64), token[local]]).view(np.int64)
        settled = np.arange(len(out_token)) >= first.sum()
        nobody = np.zeros(len(out_token), bool)
        nobody[alone.sum() : first.sum()] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_token, mask=settled), pa.array(out_doc, mask=nobody), pa.array(out_found, mask=~settled)],
            ["token", "doc_id", "found"],
        )


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token (nulls first) -> (doc_id, found): anchors that
    another row has too. The last row waits for the next batch."""
    kept, kept_hit = None, False
    for batch in batches:
        settled = batch.column("token").null_count
        if settled:
            yield batch.slice(0, settled).select(["doc_id", "found"])
        rest = batch.slice(settled)
        if not rest.num_rows:
            continue
        table = pa.Table.from_batches([x for x in (kept, rest) if x is not None])
        token = table.column("token").to_numpy()
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = token[1:] == token[:-1]
        hit = same[:-1] | same[1:]
        hit[0] |= kept is not None and kept_hit
        kept, kept_hit = rest.slice(rest.num_rows - 1), bool(hit[-1])
        hit[-1] = False
        yield from _named(table, hit)
    if kept is not None and kept_hit:
        yield from _named(pa.Table.from_batches([kept]), np.array([True]))


def _named(table: pa.Table, hit: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = table.select(["doc_id", "token"]).rename_columns(["doc_id", "found"]).filter(pa.array(hit))
    yield from rows.filter(rows.column("doc_id").is_valid()).to_batches()


def _runs(*same: np.ndarray) -> np.ndarray:
    """Where runs begin: the first row, and rows where a step is not as given."""
    n = len(same[0]) + 1
    new = np.ones(n, bool)
    new[1:] = ~np.logical_and.reduce(same)
    return np.flatnonzero(new)


def _span_rows(doc: np.ndarray, pos: np.ndarray, source_doc: np.ndarray, source_pos: np.ndarray) -> list[np.ndarray]:
    """Windows in order of place -> doc, start, number, source doc and start of the runs that move on with their source."""
    if not len(doc):
        return [x[:0] for x in (doc, pos, pos, source_doc, source_pos)]
    at = _runs(*(np.diff(x) == step for x, step in ((doc, 0), (pos, 1), (source_doc, 0), (source_pos, 1))))
    return [doc[at], pos[at], np.diff(np.append(at, len(doc))), source_doc[at], source_pos[at]]


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges at shared anchors, those of consecutive windows at one anchor in one
    row. Edges of a portion's smallest document go on to be compared; the others
    of the portion already have a source and become spans."""
    for part in portions(batches):
        ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        w = words(part.column("text"), SPACED, lower=False)
        starts, owner, at = _anchored(w)
        grams = windows(w.hash, GRAM)
        found = part.column("found")
        marks = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        sizes = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row = lambda t, i: mix(t + i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        wanted = np.isin(row(grams[at], owner), row(marks, np.repeat(np.arange(len(sizes)), sizes)))
        starts, owner, at = starts[wanted], owner[wanted], at[wanted]
        edge, doc, pos = windows(w.hash, WINDOW)[starts], ids[owner], starts - w.first[owner]
        order = np.lexsort((pos, doc, edge))
        first = np.ones(len(edge), bool)
        first[1:] = edge[order][1:] != edge[order][:-1]
        source = np.empty(len(edge), np.int64)
        source[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(edge)), 0))] if len(edge) else order
        settled = doc > doc[source]
        spans = _span_rows(*(x[settled] for x in (doc, pos, doc[source], pos[source])))
        edge, doc, pos, at, owner = (x[~settled] for x in (edge, doc, pos, at, owner))
        cut = _runs(np.diff(at) == 0, np.diff(owner) == 0, np.diff(pos) == 1) if len(edge) else np.zeros(0, np.int64)
        n1, n2 = len(cut), len(spans[0])
        compared = np.arange(n1 + n2) < n1
        filled = lambda a, b: np.concatenate([a, b])
        none1, none2 = np.zeros(n1, np.int64), np.zeros(n2, np.int64)
        offsets = filled(np.append(cut, len(edge))[: n1 + 1] if n1 else np.zeros(1, np.int64), np.full(n2, len(edge)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(filled(grams[at[cut]].view(np.int64), none2), mask=~compared),
                pa.array(filled(doc[cut], spans[0])),
                pa.array(filled(pos[cut], spans[1]).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(edge.view(np.int64))),
                pa.array(filled(none1, spans[2]), mask=compared),
                pa.array(filled(none1, spans[3]), mask=compared),
                pa.array(filled(none1, spans[4]).astype(np.int32), mask=compared),
            ],
            ["anchor", "doc_id", "start", "edges", "n", "source_doc", "source_start"],
        )


def _repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, doc_id, start), spans first -> spans with a source
    in a smaller document. Equal edges have equal anchors, so the first of equal
    edges is their source; those of the last anchor are kept for the next batch."""
    names = ["doc_id", "start", "n", "source_doc", "source_start"]
    last, kept = None, [np.zeros(0, np.int64)] * 3  # anchor; its edges, source documents and places
    for batch in batches:
        done = batch.column("anchor").null_count
        if done:
            yield batch.slice(0, done).select(names)
        rest = batch.slice(done)
        if not rest.num_rows:
            continue
        anchor = rest.column("anchor").to_numpy()
        sizes = rest.column("edges").value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = rest.column("start").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = [rest.column("edges").flatten().to_numpy(), rest.column("doc_id").to_numpy()[row], pos.astype(np.int64)]
        before = kept if last == anchor[0] else [x[:0] for x in kept]
        edge, doc, pos = (np.concatenate(x) for x in zip(before, own, strict=True))
        order = np.argsort(edge, kind="stable")
        first = np.ones(len(edge), bool)
        first[1:] = edge[order][1:] != edge[order][:-1]
        source = np.empty(len(edge), np.int64)
        source[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(edge)), 0))]
        of_last = np.concatenate([np.full(len(before[0]), anchor[0] == anchor[-1]), (anchor == anchor[-1])[row]])
        keep = of_last & (source == np.arange(len(edge)))
        last, kept = anchor[-1], [x[keep] for x in (edge, doc, pos)]
        hit = doc > doc[source]
        spans = _span_rows(*(x[hit] for x in (doc, pos, doc[source], pos[source])))
        types = (np.int64, np.int32, np.int64, np.int64, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(spans, types, strict=True)], names)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in portions(batches):
        kept, n_words, n_removed = [], [], []
        for text, paths in zip(part.column("text"), part.column("paths").to_pylist(), strict=True):
            own = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n_words.append(len(own))
            if paths:
                cover = np.zeros(len(own) + 1, np.int32)
                for p in paths:
                    cover[min(p["start"], len(own))] += 1
                    cover[min(p["start"] + p["edges"] + WINDOW - 1, len(own))] -= 1
                left = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                n_removed.append(len(own) - len(left))
                own = [own[i] for i in left]
            else:
                n_removed.append(0)
            kept.append(b" ".join(own) if text.is_valid else None)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                part.column("paths"),
            ],
            ["doc_id", "kept_text", "n_words", "n_removed", "paths"],
        )


PATHS = "array<struct<start:int,edges:long,source_doc:long,source_start:int>>"


def repeated_paths(docs: DataFrame) -> DataFrame:
    """doc_id, paths: the compacted repeated paths of documents (doc_id not null) that have any."""
    found = (
        docs.mapInArrow(_anchors, "token long, doc_id long, found long")
        .repartition(F.coalesce("token", "doc_id"))
        .sortWithinPartitions("token")
        .mapInArrow(_shared, "doc_id long, found long")
        .groupBy("doc_id").agg(F.collect_list("found").alias("found"))
    )
    spans = (
        docs.join(found.hint("merge"), "doc_id").select("doc_id", "text", "found")
        .mapInArrow(
            _edges, "anchor long, doc_id long, start int, edges array<long>, n long, source_doc long, source_start int"
        )
        .repartition(F.coalesce("anchor", "doc_id"))
        .sortWithinPartitions("anchor", "doc_id", "start")
        .mapInArrow(_repeats, "doc_id long, start int, n long, source_doc long, source_start int")
    )
    along = Window.partitionBy("doc_id", "source_doc", "shift").orderBy("start")
    goes_on = F.col("start") == F.lag(F.col("start") + F.col("n")).over(along)
    return (
        spans.repartition("doc_id").withColumn("shift", F.col("start") - F.col("source_start"))
        .withColumn("new", F.when(goes_on, 0).otherwise(1))
        .withColumn("path", F.sum("new").over(along))
        .groupBy("doc_id", "source_doc", "shift", "path").agg(F.min("start").alias("start"), F.sum("n").alias("edges"))
        .groupBy("doc_id").agg(
            F.collect_list(
                F.struct("start", "edges", "source_doc", (F.col("start") - F.col("shift")).alias("source_start"))
            ).alias("paths")
        )
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept_text (kept words joined by a blank), n_words, n_removed, paths for every row.

    A word goes if a window of WINDOW words over it also starts in a document
    with a smaller doc_id. Null texts stay null, texts without words become
    empty, shorter texts keep all words. Rows without doc_id lose nothing and
    are no source; rows that share a doc_id are no sources for one another, and
    lose what any row of that doc_id at the same place loses. Other columns are
    ignored; an empty table gives an empty result.
    """
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", "text")  # no alias, and the same filter on both sides of
    known = docs.where("doc_id is not null")  # the join: the exchange of the texts is made once
    marked = known.join(repeated_paths(known).hint("merge"), "doc_id", "left").select("doc_id", "text", "paths")
    nameless = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(PATHS).alias("paths"))
    return marked.unionByName(nameless).mapInArrow(
        _cut, f"doc_id long, kept_text string, n_words long, n_removed long, paths {PATHS}"
    )
