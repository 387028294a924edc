"""From raw claims to an indexed new-user cohort."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.operators import aggregate as agg
from dosewise.operators.derive import atc_levels, drop_early_market, pre_index_window, recode_molecule
from dosewise.operators.joins import anti_join, cohort_inner
from dosewise.operators.reshape import union_distinct
from dosewise.sources import persist_stage
from dosewise.sources.claims import Tables

INDEX_START = "1996-07-01"
INDEX_END = "1997-06-30"
FIRST_DAY = 19960701
LAST_DAY = 19970630


class Cohort:
    """Claims without early market rows, their index dates and the history
    before them; every attribute is a lazy DataFrame."""

    def __init__(self, tables: Tables, start: str = INDEX_START, end: str = INDEX_END):
        self.tables, self.start, self.end = tables, start, end
        self.rx = tables.rx

    def staged(self, *columns: str) -> Cohort:
        """The cohort on claims of these columns, joined and written once: rows
        and index dates both read them."""
        needed = dict.fromkeys(("p_id", "trans_date", "market", *columns))
        out = Cohort(self.tables, self.start, self.end)
        out.rx = persist_stage(self.rx.select(*needed))
        return out

    @cached_property
    def base(self) -> DataFrame:
        return drop_early_market(self.rx, self.start)

    @cached_property
    def index(self) -> DataFrame:
        return agg.index_date(self.rx, self.start, self.end, "window")

    @cached_property
    def indexed(self) -> DataFrame:
        """All rows, with the index date of the patient where there is one."""
        return self.base.join(self.index, "p_id", "left")

    @cached_property
    def cohort_rows(self) -> DataFrame:
        """Rows of indexed patients only."""
        return self.base.join(self.index, "p_id")

    @cached_property
    def pre(self) -> DataFrame:
        """Non-market rows before the index date, whole history.

        The filters on market and on the last possible day come before the
        join, so they reach the scan side of it.
        """
        rows = self.base.where((F.col("market") == 0) & (F.col("trans_date") < F.lit(self.end).cast("date")))
        return pre_index_window(rows.join(self.index, "p_id"), None)

    @cached_property
    def pre360(self) -> DataFrame:
        return pre_index_window(self.pre, 360)


def history_utilisation(tables: Tables) -> DataFrame:
    """Utilisation per patient in the 360 days before the index date."""
    return agg.patient_utilisation(Cohort(tables).pre360)


def build_cohort(
    tables: Tables,
    claims: DataFrame | None = None,
    first_day: int = 19950101,
    last_day: int = 20010801,
    limit: float = 12,
    start: str = INDEX_START,
    end: str = INDEX_END,
) -> DataFrame:
    """Cohort rows in the study period: excluded and outlier patients removed,
    market rows before the window deleted, index date, class levels and the
    recoded molecule attached. ``claims`` are those of the tables unless given.

    Outliers, index dates and result read the joined claims, which are written once.
    """
    claims = (tables.rx if claims is None else claims).select(
        "p_id", "trans_date", "transactiondate", "fcc", "prod", "atc", "mol1", "units", "market", "rx_id"
    )
    rows = persist_stage(cohort_inner(claims, tables.pat_persistence, tables.exclusions, first_day, last_day))
    outliers = union_distinct(agg.outlier_patients(rows, limit))
    index = anti_join(agg.index_date(rows, start, end, "window"), outliers, "p_id")
    # an indexed patient is never an outlier, so the inner join removes those too
    kept = drop_early_market(rows, start).join(index, "p_id")
    return recode_molecule(
        atc_levels(kept),
        {"ECONOMY-1": "COMBI ONE"},
        fill_by_product={"ECONOMY-2": "RING"},
    )
