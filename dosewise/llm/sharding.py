"""Random shards by a two-pass external shuffle.

Pass one scatters the records evenly into buckets by a seeded hash; there are as
many as it takes for a bucket to fit in memory. Pass two shuffles each bucket by
itself (Fisher-Yates, Spark's shuffle function with a seed) and writes it. The
buckets one after the other are a random order of all records, and shard s of S
gets the s-th S-th of it, so counts differ by one at most.

The order depends on the rows and the seed alone: buckets are dealt in turn to a
number of partitions that follows from the data, and a partition draws for its
buckets in their order, so other partitions of the input, other settings and repeated
tasks give the same shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.session import stage

#: Bytes of a bucket, and the most partitions that buckets are dealt to.
BUCKET_BYTES = 8 << 20
PARTITIONS = 1 << 17
#: Buckets whose rows are cumulated together; copies of a repeated row made together.
STRIDE = 4096
SHARDS = 24
SEED = 20240229


def record_size() -> Column:
    """UTF-8 bytes of the text and 8 for the id."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with copy, which counts rows of equal doc_id and text from 0.

    Only rows whose hash comes more than once are grouped; a group leaves as one
    row for each STRIDE copies, which are made after these are spread.
    """
    marked = rows.withColumn("mark", F.xxhash64("doc_id", "text"))
    repeated = stage(marked.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    once = marked.join(repeated, "mark", "left_anti").select("doc_id", "text", F.lit(0).cast("long").alias("copy"))
    groups = marked.join(repeated, "mark", "left_semi").groupBy("mark", "doc_id", "text").agg(F.count("*").alias("n"))
    parts = groups.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {STRIDE})"))).repartition("mark", "part")
    last = f"least(n, (part + 1) * {STRIDE}) - 1"
    copies = parts.select("doc_id", "text", F.explode(F.expr(f"sequence(part * {STRIDE}, {last})")).alias("copy"))
    return once.unionByName(copies)


def _bases(scattered: DataFrame) -> DataFrame:
    """bucket and base, the rows of all buckets before it, cumulated in two levels."""
    counts = stage(scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.expr(f"bucket div {STRIDE}")))
    runs = counts.groupBy("run").agg(F.sum("n").alias("n"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = counts.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return stage(inside.join(starts, "run").select("bucket", (F.col("start") + F.col("own")).alias("base")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write docs (doc_id, text, ...) to path, a folder for each shard, with the slot in the shard.

    Every row is written once, null texts, null ids and repeated rows included;
    rows with the same doc_id and text are spread like others. Other columns are
    left out. An empty table writes no shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_of = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(record_size()), F.lit(0)).alias("bytes")).first()
    total, buckets = all_of["n"], -(-all_of["bytes"] // bucket_bytes) or 1
    homes = min(buckets, PARTITIONS)
    bucket = F.pmod(F.xxhash64("doc_id", "text", "copy", F.lit(seed)), F.lit(buckets))
    scattered = _numbered(rows).select("doc_id", "text", bucket.alias("bucket"))
    # the base of a bucket travels with its rows, so no second join or shuffle moves them
    bases = _bases(scattered).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "bucket", "base")
    shuffled = (
        scattered.withColumn("base", F.lit(None).cast("long"))
        .unionByName(bases)
        .withColumn("home", F.expr(f"cast(bucket % {homes} as int)"))
        .repartitionById(homes, "home")
        .groupBy("home", "bucket")
        .agg(
            F.max("base").alias("base"),
            F.sort_array(F.collect_list(F.when(F.col("base").isNull(), F.struct("doc_id", "text")))).alias("rows"),
        )
        .sortWithinPartitions("bucket")
        .select("base", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "row"))
        .select("row.doc_id", "row.text", (F.col("base") + F.col("at")).alias("place"))
    )
    placed = shuffled.withColumn("shard", F.expr(f"cast(place * {shards} div {max(total, 1)} as int)"))
    first = f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}"
    placed.select("doc_id", "text", F.expr(f"place - {first}").alias("slot"), "shard").write.partitionBy("shard").parquet(path)
