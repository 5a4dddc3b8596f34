"""The chained index and the rolling GEKS kept up to date: late days are worked in without a full rebuild.

What is stored lies by collection day: items' prices, the strata seen, imputed relatives, stratum levels with
the level held, and ln GEKS levels. When quotes of some days arrive or change, the days' items are made
anew; relatives and levels follow from the first changed day on, from the day before's held levels, and
GEKS windows from the first that ends there, spliced onto the levels before. Items older than a
window before the first changed day aren't read. A stratum that is new gets its earlier levels from the stored relatives
of others, which are its donors. A change of the base day, or of days before the first whole window, rebuilds what it touches.

Days are replaced whole and results depend on the quotes alone, so an update that was cut off is
simply run again.
"""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.functions import constants as C
from indexloom.operators import chain, elementary, imputation, multilateral
from indexloom.sources import store

DAY = "collection_date"
_RELATIVE = [*C.STRATUM_KEY, DAY, "relative", "matched_items", "items_this_period", "items_prev_period"]

_STRATUM = "origin string, destination string, lead_time_days int"
SCHEMAS = {
    "items": f"source string, {_STRATUM}, carrier string, total_fare double, {DAY} date",
    "seen": f"{_STRATUM}, {DAY} date",
    "imputed": f"{_STRATUM}, relative double, matched_items long, items_this_period long, items_prev_period long, relative_used double, imputation_tier string, {DAY} date",
    "levels": f"{_STRATUM}, stratum_index double, imputation_tier string, matched_items long, held double, {DAY} date",
    "geks": f"lv double, {DAY} date",
}


class IncrementalIndex:
    """An index stored in a folder."""

    def __init__(self, spark: SparkSession, folder: str, window: int = 25):
        self.spark, self.folder, self.window = spark, folder, window

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _replace(self, name: str, rows: DataFrame, files_a_day: int = 1) -> None:
        """Days that rows have are replaced, others stay."""
        share = [F.pmod(F.xxhash64(*C.ITEM_KEY), F.lit(files_a_day))] if files_a_day > 1 else []
        fields = T.StructType.fromDDL(SCHEMAS[name])
        rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]).repartition(F.col(DAY), *share).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{self.folder}/{name}")

    def items(self, since: datetime.date | None = None) -> DataFrame:
        """Stored item prices, from a day on: other days' files aren't opened."""
        rows = self._read("items")
        return rows.where(F.col(DAY) >= F.lit(since)) if since else rows

    def levels(self) -> DataFrame:
        return self._read("levels").select(*C.STRATUM_KEY, DAY, "stratum_index", "imputation_tier", "matched_items")

    def geks(self) -> DataFrame:
        return self._days().join(self._read("geks"), DAY, "left").select(DAY, (C.BASE_VALUE * F.exp("lv")).alias("geks_index"))

    def _days(self) -> DataFrame:
        return elementary.calendar(self._read("seen"))

    def update(self, quotes: DataFrame, changed: list[datetime.date] | None = None) -> None:
        """Works in the days that changed (all, if none are named); of `quotes` only theirs are read."""
        fresh = quotes.where(F.col(DAY).isin(changed)) if changed else quotes.where(F.col(DAY).isNotNull())
        old = [r[DAY] for r in self._days().collect()] if self._read("seen") is not None else []  # one row a day
        for name in ("items", "seen"):  # a day may have lost its last row
            for day in changed or old:
                store.drop(self.spark, f"{self.folder}/{name}/{DAY}={day}")
        self._replace("seen", fresh.select(DAY, *C.STRATUM_KEY).distinct())
        self._replace("items", elementary.item_prices(fresh), 8)
        days = [r[DAY] for r in self._days().orderBy("day_no").collect()]
        first = min(changed) if changed and old else days[0]
        for name in ("imputed", "levels", "geks"):
            for day in sorted(set(old) - set(days)):
                store.drop(self.spark, f"{self.folder}/{name}/{DAY}={day}")
        before = [d for d in days if d < first]
        if before and old and old[0] == days[0]:
            self._go_on(before[-1], first)
        else:
            self._from_the_base()
        self._geks(days, first, len(old))

    def _universe(self) -> DataFrame:
        return elementary.strata(self._read("seen"))

    def _from_the_base(self) -> None:
        self._replace("imputed", imputation.impute(elementary.jevons_relatives(self.items(), self._days(), self._universe())).drop("day_no"))
        self._chain_all()

    def _chain_all(self) -> None:
        self._replace("levels", _held(chain.chain(self._read("imputed"), self._days(), self._universe())))

    def _go_on(self, last: datetime.date, first: datetime.date) -> None:
        """Relatives and levels from `first` on; `last` is the day before it."""
        universe = self._universe()
        days = elementary.calendar(self._read("seen").where(F.col(DAY) >= F.lit(last)))
        relatives = elementary.jevons_relatives(self.items(last), days, universe)
        imputed = imputation.impute(relatives).drop("day_no")
        self._replace("imputed", imputed)
        held = self._read("levels").where(F.col(DAY) == F.lit(last)).select(*C.STRATUM_KEY, F.col("held").alias("_from"))
        new = universe.join(held, C.STRATUM_KEY, "left_anti")
        if new.limit(1).count():
            self._add_strata(new, first)
            self._chain_all()
            return
        levels = _held(chain.chain(self._read("imputed").where(F.col(DAY) >= F.lit(first)), days, universe)).where(F.col(DAY) > F.lit(last)).join(held, C.STRATUM_KEY)
        share = F.col("_from") / C.BASE_VALUE
        self._replace("levels", levels.withColumns({"stratum_index": F.col("stratum_index") * share, "held": F.col("held") * share}).drop("_from"))

    def _add_strata(self, new: DataFrame, first: datetime.date) -> None:
        """Relatives of new strata on earlier days: none of their own, so their donors'."""
        earlier = self._read("imputed").where(F.col(DAY) < F.lit(first)).select(*_RELATIVE)
        days = self._days().where((F.col("day_no") > 1) & (F.col(DAY) < F.lit(first))).select(DAY)
        none = new.crossJoin(F.broadcast(days)).select(*C.STRATUM_KEY, DAY, F.lit(None).cast("double").alias("relative"), *[F.lit(0).cast("long").alias(c) for c in _RELATIVE[-3:]])  # one row a day
        self._replace("imputed", imputation.impute(earlier.unionByName(none)))

    def _geks(self, days: list[datetime.date], first: datetime.date, n_old: int) -> None:
        n = len(days)
        if n < 2:
            return
        window = multilateral.geks_window(n, self.window)
        place = days.index(first) + 1 if first in days else sum(d < first for d in days) + 1
        if place > n:
            return
        numbered = self._days()
        if place <= window or multilateral.geks_window(n_old, self.window) != window:
            levels = multilateral.splice(multilateral.window_levels(multilateral.bilateral_matrix(self.items(), numbered, window), n, window), window)
        else:
            since = days[place - window]  # the first day of the window that ends at `first`
            recent = numbered.where(F.col(DAY) >= F.lit(since))
            matrix = multilateral.bilateral_matrix(self.items(since), recent, window)
            stored = {r[DAY]: r.lv for r in self._read("geks").where((F.col(DAY) >= F.lit(since)) & (F.col(DAY) < F.lit(first))).collect()}  # a window's days
            known = [(k + 1, stored.get(days[k])) for k in range(place - window, place - 1)]
            levels = multilateral.splice(multilateral.window_levels(matrix, n, window, place), window, known)
        self._replace("geks", numbered.join(levels, "day_no").select(DAY, "lv"))


def _held(levels: DataFrame) -> DataFrame:
    """Adds the level held: a day's own, or the last one before it."""
    return levels.withColumn("held", F.last("stratum_index", ignorenulls=True).over(Window.partitionBy(*C.STRATUM_KEY).orderBy(DAY)))
