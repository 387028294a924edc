"""N-gram Jaccard join by token-combination prefixes.

Two documents link when their sets of word shingles have a Jaccard similarity
of at least THRESHOLD. Equal sets are one class. The classes then go through:

1. A prefix filter. In hash order, the first LEAD shingles of two linking sets
   share at least 3/32 of a set's size, so a class with fewer shingles in its
   lead that occur elsewhere has no partner. Only the rest is looked at again.
2. Token-combination prefixes. Shingles are ordered from rare to frequent and
   prefixes extended by g: linking sets share g + 1 of their prefixes. A shared
   rare shingle is an index entry by itself. If all are frequent, two of them
   fall in the same of g hash groups, so pairs of frequent shingles of a group
   are the entries. g grows with the size class, so the pairs of a set stay
   within a few times its size.
3. Verification, sparing what is known: each class first meets, HUB_TURNS times,
   the nearest hub of its entries, then only members of different components
   meet, all of them. A pair whose sets must differ too much by the parity
   bitmaps of their shingles is settled without comparing the sets.

No candidate is dropped and no group gathered: an entry with very many members
ties them to one hub, and its other pairs are only made across components. Entries
with the same members are one, so a pair does not come once a shared shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.llm.arrow import portions
from dosewise.llm.components import connected_components
from dosewise.llm.words import SECOND_BASE, SPACED, mix, signed, windows, words
from dosewise.session import stage

SHINGLE = 5
#: Similarity as a fraction; a pair links from NUMERATOR / DENOMINATOR on.
NUMERATOR, DENOMINATOR = 3, 4
#: A shingle in more classes than this counts as frequent.
RARE = 64
#: Longs of a parity bitmap, rounds with hubs, entries of a class that settle where a pair meets.
LONGS, HUB_TURNS, LEAST = 8, 3, 8
BITMAP = [f"bits{i}" for i in range(LONGS)]


def shingle_sets(batch: pa.RecordBatch, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a portion."""
    w = words(batch.column("text"), SPACED, lower=True)
    shingles = windows(w.hash, k)
    for a, b in zip(w.first, w.first[1:], strict=False):
        if b - a >= k:
            yield np.unique(shingles[a : b - k + 1])
        else:  # fewer words than a shingle: the whole sequence, if any
            yield windows(w.hash[a:b], b - a) if b > a else shingles[:0]


def _set_hash(s: np.ndarray) -> int:
    return int(np.sum(mix(s ^ np.uint64(SECOND_BASE)), dtype=np.uint64).view(np.int64))


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in portions(batches):
        sets = [(len(s), _set_hash(s)) for s in shingle_sets(part)]
        n, h = zip(*sets, strict=True)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(h, pa.int64())],
            ["doc_id", "text_key", "n_shingles", "cid"],
        )


def _lead(n: int) -> int:
    return max(-(-3 * n // 8), n - -(-NUMERATOR * n // DENOMINATOR) + 1)


def _leads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lead shingles to compare, one row for each shingle and portion: those of
    one document name it, of several don't; their hits are counted here."""
    for part in portions(batches):
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        leads = [s[: _lead(len(s))] for s in shingle_sets(part)]
        sizes = np.array([len(s) for s in leads])
        tokens, owner = np.concatenate(leads), np.repeat(np.arange(len(leads)), sizes)
        order = np.argsort(tokens, kind="stable")
        same = np.zeros(len(tokens) + 1, dtype=bool)
        same[1:-1] = tokens[order][1:] == tokens[order][:-1]
        several, witness = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
        several[order] = same[:-1] | same[1:]
        witness[order] = ~same[:-1] & same[1:]
        hits = np.bincount(owner[several], minlength=len(leads))
        alone, with_hits = ~several, np.flatnonzero(hits)
        token = np.concatenate([tokens[alone], tokens[witness], np.zeros(len(with_hits), np.uint64)])
        doc = np.concatenate([ids[owner[alone]], np.zeros(witness.sum(), np.int64), ids[with_hits]])
        n1, n2, n3 = alone.sum(), witness.sum(), len(with_hits)
        no = np.zeros(len(token), bool)
        no[n1 + n2 :] = True
        nobody = np.zeros(len(token), bool)
        nobody[n1 : n1 + n2] = True
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(token.view(np.int64), mask=no),
                pa.array(doc.astype(np.int64), mask=nobody),
                pa.array(np.concatenate([np.zeros(n1 + n2, np.int64), hits[with_hits]]), mask=~no),
            ],
            ["token", "doc_id", "hits"],
        )


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token (nulls first) -> hits of each named document: rows
    whose token another row has too. Only the last row waits for the next batch."""
    kept, kept_hit = None, False
    for batch in batches:
        counted = batch.column("token").null_count
        if counted:
            yield batch.slice(0, counted).select(["doc_id", "hits"])
        rest = batch.slice(counted)
        if not rest.num_rows:
            continue
        table = pa.Table.from_batches([x for x in (kept, rest) if x is not None])
        token = table.column("token").to_numpy()
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = token[1:] == token[:-1]
        hit = same[:-1] | same[1:]
        hit[0] |= kept_hit and kept is not None
        kept, kept_hit = rest.slice(rest.num_rows - 1), bool(hit[-1])
        hit[-1] = False
        yield _hits(table.column("doc_id").combine_chunks(), hit)
    if kept is not None:
        yield _hits(kept.column("doc_id"), np.array([kept_hit]))


def _hits(doc: pa.Array, hit: np.ndarray) -> pa.RecordBatch:
    ids, n = np.unique(doc.filter(pa.array(hit)).drop_null().to_numpy(), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "hits"])


def _bitmap(s: np.ndarray) -> np.ndarray:
    """For each of 64 * LONGS hash values, whether an odd number of shingles has it.
    Two bitmaps differ in no more bits than their sets do in shingles."""
    odd = np.bincount((mix(s) % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wanted_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in portions(batches):
        cid = part.column("cid").to_pylist()
        rows = [(c, s) for c, s in zip(cid, shingle_sets(part), strict=True) if _set_hash(s) == c]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in rows], pa.int64()),
                pa.array([len(s) for _, s in rows], pa.int64()),
                pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64())),
                *(pa.array(x, pa.int64()) for x in np.array([_bitmap(s) for _, s in rows], np.int64).reshape(-1, LONGS).T),
            ],
            ["cid", "n", "tokens", *BITMAP],
        )


def _size_classes(n: int) -> list[int]:
    """Of this size and of the larger partner it may have."""
    return sorted({n.bit_length(), (n * DENOMINATOR // NUMERATOR).bit_length()})


def _groups(size_class: int) -> int:
    return max(1, (1 << size_class) >> 5)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of each class from its repeated shingles, rarest first."""
    for batch in batches:
        sigs, owners = [], []
        for cid, n, dfs, tokens in zip(*(batch.column(x).to_pylist() for x in ("cid", "n", "dfs", "tokens")), strict=True):
            prefix = n - -(-NUMERATOR * n // DENOMINATOR) + 1
            unique = n - len(tokens)
            df, token = np.array(dfs), np.array(tokens, np.int64).view(np.uint64)
            found = []
            for c in _size_classes(n):
                g = _groups(c)
                take = min(prefix + g, n) - unique
                if take <= 0:
                    continue
                frequent = df[:take] > RARE
                found.append(mix(token[:take][~frequent]))
                often = np.sort(token[:take][frequent])
                group = mix(often + np.uint64(g)) % np.uint64(g)
                for x in np.unique(group):
                    own = often[group == x]
                    i, j = np.triu_indices(len(own), 1)
                    found.append(mix(mix(own[i] + np.uint64(c)) * np.uint64(SECOND_BASE) + own[j]))
            if found:
                s = np.unique(np.concatenate(found))
                sigs.append(s)
                owners.append(np.full(len(s), cid, np.int64))
        if sigs:
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(sigs)), pa.array(np.concatenate(owners))], ["entry", "cid"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the (a, b, ...) pairs that link, their shingles compared in full."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    linked = both * DENOMINATOR >= (F.col("na") + F.col("nb") - both) * NUMERATOR
    return pairs.join(left, "a").join(right, "b").where(linked).select(*pairs.columns)


def _live(rows: DataFrame) -> DataFrame:
    """The rows (entry, cid, label, ...) of entries whose members are not yet of one
    component. Of entries with the same members, told by their number and two
    64-bit sums of hashes, one is enough: the shingles of a passage give many."""
    xor = lambda seed: F.bit_xor(F.xxhash64("cid", F.lit(seed)))
    entries = rows.groupBy("entry").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), xor(1).alias("x"), xor(2).alias("y")
    )
    kept = entries.where("lo <> hi").groupBy("size", "x", "y").agg(F.min("entry").alias("entry"))
    return stage(rows.join(kept.select("entry"), "entry"))


def _relabelled(rows: DataFrame, good: DataFrame) -> DataFrame:
    """rows with the components that the new links, from label la to label lb, make of theirs."""
    merged = connected_components(good.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    merged = merged.select(F.col("node").alias("label"), F.col("component").alias("to"))
    rest = [c for c in rows.columns if c != "label"]
    return rows.join(merged, "label", "left").select(*rest, F.coalesce("to", "label").alias("label"))


def _apart(other: Callable[[str], Column]) -> Column:
    """Bits in which the bitmaps of a row and the other differ."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(other(x))) for x in BITMAP[1:]), F.bit_count(F.col("bits0").bitwiseXOR(other("bits0"))))


def _may_link(n: Column, apart: Column) -> Column:
    """Sets that link differ in (1 - t) / (1 + t) of their sizes' sum at most."""
    own, few, many = F.col("n"), DENOMINATOR - NUMERATOR, DENOMINATOR + NUMERATOR
    return (own * DENOMINATOR >= n * NUMERATOR) & (n * DENOMINATOR >= own * NUMERATOR) & (apart * many <= (own + n) * few)


def _all_pairs(rows: DataFrame) -> DataFrame:
    """(cid, label, other, its) of members of an entry that differ in label and may link.

    A pair has as many entries in common as its passages have shingles. Each row
    carries the LEAST smallest entries of its class; where two classes have one
    of them in common, they meet there and not in a larger entry.
    """
    least = rows.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list("entry")), 1, LEAST).alias("least"))
    rows = rows.join(least, "cid")
    names = {"entry": "meet", "cid": "other", "label": "its", "n": "m", "least": "other_least"} | {x: f"other_{x}" for x in BITMAP}
    others = rows.select(*(F.col(a).alias(b) for a, b in names.items()))
    rows = rows.withColumn("before", F.filter("least", lambda v: v < F.col("entry"))).drop("least")
    may = _may_link(F.col("m"), _apart(lambda x: F.col(f"other_{x}")))
    met = F.arrays_overlap("before", "other_least")
    key = (F.col("entry") == F.col("meet")) & (F.col("label") < F.col("its")) & may & ~met
    return rows.join(others, key).select("cid", "label", "other", "its")


def _links(entries: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links that connect all classes which linked pairs connect."""
    links, rows = None, _live(entries.withColumn("label", F.col("cid")))
    for turn in range(HUB_TURNS + 1):
        if rows.isEmpty():
            break
        if turn < HUB_TURNS:  # each class with the nearest of the hubs of its entries
            hub = F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), "cid", "label", "n", *BITMAP)
            meets = rows.join(rows.groupBy("entry").agg(F.min(hub).alias("hub")), "entry").where("label <> hub.label")
            apart = _apart(lambda x: F.col(f"hub.{x}"))
            nearest = F.struct(apart.alias("apart"), "hub.cid", "hub.label").alias("hub")
            near = meets.where(_may_link(F.col("hub.n"), apart)).select("cid", "label", nearest)
            pairs = near.groupBy("cid", "label").agg(F.min("hub").alias("hub")).select("cid", "label", F.col("hub.cid").alias("other"), F.col("hub.label").alias("its"))
        else:  # all pairs of different components
            pairs = _all_pairs(rows)
        pairs = pairs.select(F.col("cid").alias("a"), F.col("other").alias("b"), F.col("label").alias("la"), F.col("its").alias("lb")).distinct()
        good = stage(_verified(pairs, sets))
        links = good if links is None else links.union(good)
        if turn < HUB_TURNS:
            rows = _live(_relabelled(rows, good))
    return links


def jaccard_components(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id reachable over links, the own one
    included. Null, empty and blank texts have an empty set and link with
    nothing. Repeated rows give repeated results; rows that repeat a doc_id with
    another text are compared each on its own. Rows without doc_id are never
    linked and have no component. Other columns are ignored. keyed adds text_key,
    the xxhash64 of the text, which tells such rows apart.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stage(
        docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_describe, "doc_id long, text_key long, n_shingles long, cid long")
    )
    classes = stage(
        described.where("n_shingles > 0 and doc_id is not null").groupBy("cid").agg(
            F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")
        )
    )
    known = docs.where("doc_id is not null")
    hits = (
        known.mapInArrow(_leads, "token long, doc_id long, hits long")
        .repartition(F.coalesce("token", "doc_id"))
        .sortWithinPartitions("token")
        .mapInArrow(_shared, "doc_id long, hits long")
        .groupBy("doc_id").agg(F.sum("hits").alias("hits"))
    )
    wanted = stage(
        classes.join(hits.withColumnRenamed("doc_id", "rep"), "rep").where(F.col("hits") * 32 >= F.col("n") * 3)
        .select(F.col("rep").alias("doc_id"), "cid")
    )
    sets = known.join(wanted.hint("merge"), "doc_id").select("cid", "text").mapInArrow(
        _wanted_sets, f"cid long, n long, tokens array<long>, {', '.join(f'{x} long' for x in BITMAP)}"
    )
    repeats = described.groupBy("doc_id").count().where("count > 1").limit(1).count()
    sets = stage(sets.dropDuplicates(["cid"]) if repeats else sets)
    singles = sets.select("cid", "n", F.explode("tokens").alias("token"))
    df = stage(singles.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    ranked = (
        singles.join(df, "token").groupBy("cid").agg(
            F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x")
        ).select("cid", "n", F.col("x.df").alias("dfs"), F.col("x.token").alias("tokens"))
    )
    entries = ranked.mapInArrow(_entries, "entry long, cid long").join(sets.select("cid", "n", *BITMAP), "cid")
    links = _links(entries, sets)
    named = classes.select("cid", F.col("rep").alias("component_id"))
    if links is not None:
        parts = stage(connected_components(links)).select(F.col("node").alias("cid"), "component")
        tied = classes.join(parts, "cid").select("cid", "component", "rep")
        least = tied.groupBy("component").agg(F.min("rep").alias("least"))
        tied = tied.join(least, "component").select("cid", "least")
        named = named.join(tied, "cid", "left").select("cid", F.coalesce("least", "component_id").alias("component_id"))
    known_rows = described.where("doc_id is not null and n_shingles > 0")
    key = ["text_key"] if keyed else []
    rest = described.where("doc_id is null or n_shingles = 0").select(
        "doc_id", *key, "n_shingles", F.col("doc_id").alias("component_id")
    )
    return known_rows.join(stage(named), "cid").select("doc_id", *key, "n_shingles", "component_id").unionByName(rest)
