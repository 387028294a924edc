"""Binding of the claims model to the star-schema tables.

``claims`` is the dispensing table; the other functions are the lookup tables
that belong to it. Every function returns a lazy DataFrame.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.functions import date_to_int

# Fixed values of the binding: product class to ATC code, region to specialty.
CLASS_ATC = {
    "ECONOMY": "C10A1",
    "LARGE": "C09A1",
    "MEDIUM": "C07A1",
    "PROMO": "A10C1",
    "SMALL": "A10J1",
    "STANDARD": "A02B1",
}
REGION_SPECIALTY = {0: "11", 1: "34", 2: "60", 3: "21"}


def _recode(c, mapping):
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def _line_columns() -> list[Column]:
    """What a claim has from its line and its order."""
    return [
        F.col("o_custkey").alias("p_id"),
        F.col("o_orderdate").cast("date").alias("trans_date"),
        F.col("l_partkey").alias("fcc"),
        F.col("l_returnflag").alias("otc"),
        (F.col("l_quantity") / 25).alias("units"),
        F.try_divide("l_extendedprice", "l_quantity").alias("rsp"),
        F.col("l_suppkey").alias("shortcode"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("transactiontype"),
        F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("dci_vos"),
        F.col("l_linenumber").alias("rx_id"),
    ]


def _pack_columns() -> list[Column]:
    return [
        F.concat("p_type", F.lit("-"), (F.col("p_partkey") % 5).cast("string")).alias("prod"),
        _recode(F.col("p_type"), CLASS_ATC).alias("atc"),
        F.upper("p_name").alias("mol1"),
        (F.col("p_size") * 4).alias("pack_size"),
        F.when(F.col("p_type") == "ECONOMY", 1).otherwise(0).alias("market"),
    ]


def _physician_columns() -> list[Column]:
    return [
        _recode(F.col("n_regionkey"), REGION_SPECIALTY).alias("doc_speciality"),
        (F.col("s_suppkey") % 3).cast("int").alias("doc_gender"),
        F.when(F.col("s_nationkey") % 8 != 0, F.col("s_nationkey")).alias("region_doc"),
        (F.col("s_suppkey") % 17).cast("int").alias("ddms_pha"),
    ]


def _claim_columns() -> list[Column | str]:
    """All columns of the claims, those that follow from the date or the patient included."""
    p_id = F.col("p_id")
    return [
        "p_id", "trans_date", date_to_int(F.col("trans_date")).alias("transactiondate"), "fcc", "prod", "atc", "mol1", "otc",
        "units", "rsp", "pack_size", "market", "shortcode", "doc_speciality", "doc_gender", "region_doc", "ddms_pha",
        "transactiontype", "dci_vos", F.when(p_id % 11 != 0, (p_id % 2).cast("int")).alias("p_gender"), "rx_id",
        (p_id * 37 % 361).cast("int").alias("capped_days_treatment"),
    ]


class Tables:
    """The given tables by name, and the claims tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def rx(self) -> DataFrame:
        """Claims: one row per dispensed line."""
        part, supplier = self.read("part"), self._suppliers()
        return (
            self._lines()
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(*_line_columns(), *_pack_columns(), *_physician_columns())
            .select(*_claim_columns())
        )

    @cached_property
    def distinct_rx(self) -> DataFrame:
        """``rx.distinct()``: a claim is its line and the rows of its pack and its
        physician, which have their keys, so distinct lines join distinct packs and
        physicians. What is compared and shuffled is the line alone."""
        lines = self._lines().select(*_line_columns()).distinct()
        packs = self.read("part").select("p_partkey", *_pack_columns()).distinct()
        physicians = self._suppliers().select("s_suppkey", *_physician_columns()).distinct()
        return (
            lines.join(packs, F.col("fcc") == F.col("p_partkey"))
            .join(physicians, F.col("shortcode") == F.col("s_suppkey"))
            .select(*_claim_columns())
        )

    def _lines(self) -> DataFrame:
        return self.read("lineitem").join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    def _suppliers(self) -> DataFrame:
        return self.read("supplier").join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))

    @cached_property
    def product_dict(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("fcc"),
            (F.col("p_size") * 4).alias("pack_size"),
            F.col("p_brand").alias("str_unit"),
        )

    @cached_property
    def pat_persistence(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("p_id"),
            (F.col("c_custkey") * 37 % 361).cast("int").alias("capped_days_treatment"),
        )

    @cached_property
    def exclusions(self) -> DataFrame:
        """Patients to leave out; the list carries missing ids on purpose."""
        return (
            self.read("customer")
            .where(F.col("c_acctbal") < 0)
            .select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("p_id"))
        )

    @cached_property
    def doc_details(self) -> DataFrame:
        supplier = self.read("supplier").join(
            self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        return supplier.select(
            F.col("s_suppkey").alias("shortcode"),
            _recode(F.col("n_regionkey"), REGION_SPECIALTY).alias("doc_speciality"),
            (F.col("s_suppkey") % 3).cast("int").alias("doc_gender"),
            F.when(F.col("s_nationkey") % 8 != 0, F.col("s_nationkey")).alias("region_doc"),
        )

    @cached_property
    def doc_graduation(self) -> DataFrame:
        return self.read("supplier").select(
            F.col("s_suppkey").alias("short_id"),
            F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") % 45 + 1960).cast("int")).alias(
                "graduation_year"
            ),
        )

    @cached_property
    def doc_sales(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.read("supplier").select(
            key.alias("shortcode"),
            F.when(key % 7 == 0, " ").when(key % 7 == 1, "N").otherwise("Y").alias("active"),
            F.col("s_acctbal").alias("sales"),
        )

    @cached_property
    def doc_survey(self) -> DataFrame:
        """Two thirds of the physicians answered; answers are often missing."""
        key = F.col("s_suppkey")
        return (
            self.read("supplier")
            .where(key % 3 != 1)
            .select(
                key.alias("short_id"),
                F.when(key % 2 == 0, (key % 5).cast("int")).alias("c001"),
                F.when(key % 4 == 0, (key % 9).cast("int")).alias("c003"),
                F.when(key % 5 != 0, (key % 6).cast("int")).alias("c004"),
                F.when(key % 6 != 3, F.round(F.col("s_acctbal") / 100).cast("int")).alias("c061"),
                F.when(key % 8 != 5, (key % 13).cast("int")).alias("c062"),
                F.when(key % 9 != 2, (key * 7 % 11).cast("int")).alias("c070"),
            )
        )

    @cached_property
    def sociodemo(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.read("nation").select(
            key.alias("brick"),
            F.format_number(1000 + key * 137, 0).alias("meyon"),
            F.when(key % 5 != 4, (key % 5 * 16 + 10).cast("int")).alias("urb"),
            (key * 2.5 + 10).alias("surface"),
        )

    @cached_property
    def age_group(self) -> DataFrame:
        """Patients per segment and age; -1 stands for an unknown age."""
        return (
            self.read("customer")
            .groupBy(
                F.col("c_mktsegment").alias("group"),
                (F.col("c_custkey") % 92 - 1).cast("double").alias("age"),
            )
            .agg(F.count(F.lit(1)).alias("n"))
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Scored rows: a response and a score in (0, 1) per event."""
        return self.read("events").select(
            F.col("event_id").alias("id"),
            (F.col("user_id") % 3).cast("int").alias("sim_id"),
            F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("response"),
            F.try_divide(F.col("value"), F.col("value") + 20).alias("score"),
        )

    @cached_property
    def width(self) -> int:
        """Entries of the longest embedding."""
        return self.read("embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0

    @property
    def covariates(self) -> list[str]:
        return [f"x{i}" for i in range(self.width)]

    def features(self) -> DataFrame:
        """All numeric covariates x0.. and a binary response per embedding row."""
        return self.read("embeddings").select(
            F.col("vec_id").alias("id"),
            (F.col("label") % 2).cast("int").alias("response"),
            *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(self.width)],
        )
