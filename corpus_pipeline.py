"""From raw documents to token-id files, a stage at a time.

Each stage takes (spark, docs, sf_dir), calls one operator of dosewise.llm and
acts on what it finds. All but the last return the columns of documents, whatever
the names of those that no operator reads; run writes the result of each as
Parquet and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm.decontaminate import contamination
from dosewise.llm.id_files import read_ids, write_ids
from dosewise.llm.language_id import UNDETERMINED, fit, predict
from dosewise.llm.mixing import NO_SOURCE, mixture
from dosewise.llm.queries import TOKENIZER
from dosewise.llm.shingle_join import jaccard_components
from dosewise.session import release_stages, scratch_dir, stage, staged_so_far, tune

#: A document whose most likely language has a smaller mean probability is rejected.
LEAST_SCORE = 0.3


#: Columns that operators know by name.
KNOWN = ("doc_id", "text", "lang", "source")


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def plain_names(step: Callable) -> Callable:
    """The stage with every other column under a name of our own, given back at the end:
    no name of the input, blank or clashing, reaches an operator."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in KNOWN else f"c{i}" for i, c in enumerate(docs.columns)}
        kept = step(spark, docs.select(*(F.col(_quoted(c)).alias(n) for c, n in names.items())), sf_dir)
        return kept.select(*(F.col(n).alias(c) for c, n in names.items()))

    return run_step


@plain_names
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, or no language likely. Where no
    document tells its language, there is no model and all with a letter stay."""
    tune(spark)
    model = fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct("*").alias("row"), "text")
    judged = predict(rows, model, ("row",))
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


@plain_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; of repeated rows one.
    Documents without id are compared with none and stay."""
    tune(spark)
    parts = jaccard_components(docs, keyed=True)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    docs = docs.dropDuplicates() if repeated else docs
    gone = stage(parts.where("component_id <> doc_id").select("doc_id", "text_key").distinct())
    key = (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["text_key"])
    return docs.join(gone.hint("merge"), key, "left_anti").select(*docs.columns)


@plain_names
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    benchmark = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark, carry=True).where("n_hit = 0")
    return found.select(*(F.col("text") if x == "text" else F.col(f"rest.`{x}`") for x in docs.columns))


@plain_names
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture reads it, those it leaves out not at all."""
    tune(spark)
    copies = mixture(docs).select("doc_id", "text_key", F.col("source").alias("from"), "copies").distinct()
    key = (
        docs["doc_id"].cast("long").eqNullSafe(copies["doc_id"])
        & F.xxhash64(docs["text"].cast("string")).eqNullSafe(copies["text_key"])
        & (F.coalesce(docs["source"].cast("string"), F.lit(NO_SOURCE)) == copies["from"])
    )
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("time")
    return docs.join(copies.where("copies > 0").hint("merge"), key).select(*(docs[x] for x in docs.columns), times).drop("time")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id files of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch_dir(tune(spark))
    write_ids(docs, public_tokenizers.path(TOKENIZER), path)
    return read_ids(spark, path).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("id_files", token_ids),
]

#: SQL has neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = staged_so_far()
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        release_stages(spark, since=before, keep=1)  # only this result is read on
    return STAGES[-1][1](spark, docs, sf_dir)
