"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors are normalised and turned by random rotations. The signs of a turned
vector are its code, stored with a correction factor, the inner product of the
vector and its code. From code and factor alone the cosine to any other vector
is estimated without bias, and a confidence bound follows from the factor; pairs
whose estimate is below the threshold by more than the bound are settled, all
others are computed exactly in double precision.

Which pairs are looked at: the code bits also give TABLES bucket keys, as many
bits each as keep buckets small and as many tables as a pair at the threshold
needs to meet in one of them but for MISS. Equal vectors are one class. Buckets
are cut in chunks and chunks paired, so a hot bucket is spread over tasks; a
task returns numbers of links and the roots of what it tied, never pairs. A pair
counts in the first table where it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.components import connected_components
from dosewise.session import stage

THRESHOLD = 0.95
#: Vectors of a bucket aimed at, and the share of pairs at the threshold that meet in no table.
BUCKET, MISS = 64, 1e-4
#: Width of the confidence bound in standard errors of the estimate.
SIGMAS = 5.0
#: Vectors of a chunk, and pairs computed exactly at once.
CHUNK, PAIRS = 1024, 1 << 16
SEED = 11


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(4, math.ceil(math.log2(max(n, 1) / BUCKET))) if n > BUCKET else 4
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


def rotations(dim: int, n_bits: int) -> np.ndarray:
    """Enough random rotations side by side for n_bits signs."""
    rng = np.random.default_rng([SEED, dim])
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(max(1, -(-n_bits // dim)))])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _keys(x: np.ndarray, turn: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (x @ turn[:, : bits * tables] > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1)[:, None]


def _bucketed(bits: int, tables: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def bucketed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = _unit(_matrix(batch.column("v").take(pa.array(rows))))
                keys = _keys(x, rotations(int(dim), bits * tables), bits, tables)
                name = (keys * tables + np.arange(tables)) * (1 << 16) + int(dim)
                cid = np.repeat(batch.column("cid").to_numpy()[rows], tables)
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(name.reshape(-1))], ["cid", "bucket"])

    return bucketed


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys; input sorted by them."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        if not table.num_rows:
            continue
        values = [table.column(k).to_numpy() for k in keys]
        new = np.any([x[1:] != x[:-1] for x in values], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        kept = table.slice(cuts[-1]).combine_chunks()
    if kept is not None and kept.num_rows:
        yield kept


def close_pairs(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of x, j of y; i < j if same) with cosine >= threshold, in blocks.

    The code of x estimates all cosines; only those within the bound of the
    threshold, or above, are computed.
    """
    ux, uy, dim = _unit(x), _unit(y), x.shape[1]
    turn = rotations(dim, 1)
    turned = ux @ turn
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    code = (np.where(turned > 0, 1.0, -1.0) / (factor * math.sqrt(dim))[:, None]).astype(np.float32)
    bound = SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1)) + 1e-5
    estimate = code @ (uy @ turn).astype(np.float32).T
    i, j = np.nonzero(estimate >= (threshold - bound)[:, None])
    if same:
        i, j = i[i < j], j[i < j]
    for a in range(0, len(i), PAIRS):
        p, q = i[a : a + PAIRS], j[a : a + PAIRS]
        good = np.einsum("ij,ij->i", ux[p], uy[q]) >= threshold
        yield p[good], q[good]


def _linked(bits: int, tables: int, threshold: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket", "low", "high"]):
            bucket, low, high = (group.column(k)[0].as_py() for k in ("bucket", "low", "high"))
            if group.num_rows < 2:
                continue
            table = (bucket >> 16) % tables
            chunk, cid, m = (group.column(k).to_numpy() for k in ("chunk", "cid", "m"))
            v = _matrix(group.column("v"))
            left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
            links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
            turn = rotations(v.shape[1], bits * tables)
            for p, q in close_pairs(v[left], v[right], low == high, threshold):
                i, j = left[p], right[q]
                involved, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                keys = _keys(_unit(v[involved]), turn, bits, tables)
                for a in range(0, len(i), 4096):
                    pi, pj = at[: len(i)][a : a + 4096], at[len(i) :][a : a + 4096]
                    first = np.argmax(keys[pi] == keys[pj], axis=1) == table
                    np.add.at(links, i[a : a + 4096][first], m[j[a : a + 4096][first]])
                    np.add.at(links, j[a : a + 4096][first], m[i[a : a + 4096][first]])
                while True:
                    least = np.minimum(root[i], root[j])
                    if (root[i] == least).all() and (root[j] == least).all():
                        break
                    np.minimum.at(root, i, least)
                    np.minimum.at(root, j, least)
            told = np.flatnonzero((links > 0) | (root != np.arange(len(cid))))
            if len(told):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[told]), pa.array(links[told]), pa.array(cid[root[told]])], ["cid", "links", "root"]
                )

    return linked


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, ...).

    Null, empty and zero vectors and those with null or non-finite parts link
    with nothing, as do vectors of different lengths. Equal vectors link with
    one another. Rows without vec_id are linked with nothing and have neither
    component nor kept. Repeated rows count as vectors of their own. Other
    columns are ignored; an empty table gives an empty result.
    """
    part = dict(vectors.dtypes)["embedding"]
    part = part if part in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(part).alias("v"))
    sound = "vec_id is not null and size(v) > 0 and exists(v, x -> x <> 0) and forall(v, x -> x is not null and abs(x) < double('infinity'))"
    is_sound = F.coalesce(F.expr(sound), F.lit(False))
    named = rows.select("vec_id", F.when(is_sound, F.xxhash64(F.transform("v", lambda x: x + 0))).alias("cid"))
    classes = stage(
        rows.where(is_sound).withColumn("v", F.transform("v", lambda x: x + 0))
        .groupBy(F.xxhash64("v").alias("cid")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"))
    )
    bits, tables = plan(classes.count(), threshold)
    entries = stage(classes.select("cid", "v").mapInArrow(_bucketed(bits, tables), "cid long, bucket long"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    chunks = sizes.select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = (
        entries.join(stage(chunks), "bucket")
        .withColumn("chunk", F.pmod(F.xxhash64("cid", "bucket"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("cid", "bucket", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    )
    found = stage(
        dealt.join(classes.select("cid", "m", "v"), "cid")
        .repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
        .mapInArrow(_linked(bits, tables, threshold), "cid long, links long, root long")
    )
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    tied = stage(classes.select("cid", "rep", "m").join(links, "cid", "left").join(parts, "cid", "left"))
    tied = tied.withColumn("component", F.coalesce("component", "cid"))
    least = tied.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = tied.join(least, "component").select(
        "cid", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"
    )
    return named.join(stage(known), "cid", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
