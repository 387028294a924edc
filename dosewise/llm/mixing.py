"""Mixing sources to target weights by temperature, all in DataFrame operations.

Source token shares p become weights p ** a / sum(p ** a). The exponent a comes
from a section search over aggregates of the source table: the largest up to 1
whose entropy is at least a fraction of that of equal weights, or the smallest
at which no source is repeated beyond a limit. The weights times the token
budget are realised as block permutations: a source is read in whole passes,
then in a pass over its blocks in random order that ends when the budget does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.session import stage

#: Tokens of a block.
BLOCK_TOKENS = 1 << 20
#: Entropy of the weights, as a fraction of that of equal weights.
TARGET_ENTROPY = 0.95
SEED = 7
#: Name of the source of rows without one.
NO_SOURCE = "(none)"
#: Sections of one round of the search, and rounds; the exponent is then rounded.
SECTIONS, ROUNDS, DIGITS = 64, 5, 6
#: Words are what white space leaves.
WORD = r"[^ \t\n\x0B\f\r]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _random(*parts: Column | str) -> Column:
    """32 hex digits that look random, the same in every engine with md5."""
    return F.md5(F.concat_ws("-", F.lit(str(SEED)), *parts))


def exponent(sources: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: int, total: int) -> float:
    """The exponent in 0 to 1 that meets the target; sources: (source, tokens).

    Entropy falls with the exponent: the largest that meets it, 0 if none does.
    Repetition of small sources falls too: the smallest within the limit, 1 if none is.
    """
    lo, hi = 0.0, 1.0
    rows = sources.where("tokens > 0")
    for _ in range(ROUNDS):
        step = (hi - lo) / SECTIONS
        grid = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS))))
        share = F.col("tokens") / F.lit(total)
        a = F.lit(lo) + F.col("k") * F.lit(step)
        sums = grid.groupBy("k").agg(
            F.sum(F.pow(share, a)).alias("z"),
            F.sum(a * F.pow(share, a) * F.log(share)).alias("zl"),
            F.max(F.pow(share, a) / F.col("tokens")).alias("most"),
            F.count("*").alias("n"),
        )
        if target_entropy is not None:
            met = F.log("z") - F.col("zl") / F.col("z") >= F.lit(target_entropy) * F.log("n") - F.lit(1e-12)
            best = sums.where(met).agg(F.max("k")).first()[0]
            best = 0 if best is None else best
            lo, hi = lo + best * step, min(lo + (best + 1) * step, 1.0)
        else:
            met = F.col("most") / F.col("z") * F.lit(budget) <= F.lit(max_repetition) + F.lit(1e-12)
            best = sums.where(met).agg(F.min("k")).first()[0]
            best = SECTIONS if best is None else best
            lo, hi = max(lo + (best - 1) * step, 0.0), lo + best * step
        if hi <= lo:
            break
    return round(lo if target_entropy is not None else hi, DIGITS)


def mixture(
    docs: DataFrame,
    target_entropy: float | None = TARGET_ENTROPY,
    max_repetition: float | None = None,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """doc_id, text_key, source, n_tokens, weight, block, copies for every row of docs (doc_id, text, source, ...).

    copies is how often the row is read; budget, the tokens to read, is by
    default those there are. Rows without source are a source of their own.
    Null and wordless texts have no tokens and are read in the whole passes, and
    in the last one if their block is. Rows that share doc_id, source and text
    get the same copies. text_key tells texts of a repeated doc_id apart. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(F.col("text").cast("string")).alias("text_key"),
            F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"),
            n_words("text").alias("n_tokens"),
        )
    )
    sources = stage(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = total if budget is None else budget
    a = exponent(sources, target_entropy, max_repetition, budget, total) if total else 1.0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(a))).otherwise(F.lit(0.0))
    powers = sources.withColumn("power", power)
    z = powers.agg(F.sum("power")).first()[0] or 1.0
    weighted = (
        powers.withColumn("weight", F.round(F.col("power") / F.lit(z), 9))
        .withColumn("wanted", F.floor(F.col("weight") * F.lit(budget)))
        .withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens"))).otherwise(F.lit(0)))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("wanted") - F.col("passes") * F.col("tokens")).otherwise(F.lit(0)))
        .withColumn("blocks", F.greatest(F.ceil(F.col("tokens") / F.lit(block_tokens)), F.lit(1)))
        .select("source", "weight", "passes", "rest", "blocks")
    )
    mark = _random(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("source"))
    number = F.conv(F.substring(mark, 1, 8), 16, 10).cast("long")
    dealt = rows.join(stage(weighted), "source").withColumn("mark", mark).withColumn("block", F.pmod(number, F.col("blocks")))
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.max("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(_random(F.col("source"), F.col("block").cast("string")), "block")
    room = F.col("rest") - F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("tokens")
    opened = blocks.withColumn("room", room).select(
        "source", "block", "room", ((F.col("room") >= F.col("tokens")) & (F.col("room") > 0)).alias("whole")
    )
    placed = dealt.join(stage(opened), ["source", "block"])
    part = Window.partitionBy("source", "block").orderBy("mark", "text_key")
    ends = placed.where("not whole and room > 0").withColumn("read", F.sum("n_tokens").over(part) <= F.col("room"))
    others = placed.where("whole or room <= 0").withColumn("read", F.col("whole"))
    return ends.unionByName(others).select(
        "doc_id", "text_key", "source", "n_tokens", "weight", "block",
        (F.col("passes") + F.col("read").cast("long")).cast("long").alias("copies"),
    )
