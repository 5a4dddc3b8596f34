"""The index from quotes to publication, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.functions import dimensions
from indexloom.operators import aggregate, chain, contracts, elementary, imputation, multilateral
from indexloom.sources import store
from indexloom.sources.quotes import SIMULATED, simulated

TWO_DATES = "an index needs at least two collection dates"


@dataclass(frozen=True)
class IndexBuild:
    quotes: DataFrame
    days: DataFrame
    universe: DataFrame
    items: DataFrame
    relatives: DataFrame
    imputed: DataFrame
    levels: DataFrame
    weights: DataFrame
    availability: DataFrame
    points: DataFrame

    def headline(self, name: str = C.HEADLINE) -> DataFrame:
        return self.points.where(F.col("scenario") == name)

    def direct(self) -> DataFrame:
        return multilateral.direct_index(self.items, self.days)

    def geks(self, window: int = 25) -> DataFrame:
        return multilateral.geks_index(self.items, self.days, window)

    def band(self) -> DataFrame:
        return aggregate.scenario_band(aggregate.published(self.points))

    def drift(self) -> DataFrame:
        return multilateral.drift(aggregate.published(self.headline()), self.geks(), self.direct())


def build(quotes: DataFrame, route_weights: DataFrame | None = None, checked: bool = False, folder: str | None = None) -> IndexBuild:
    """Plans every series; nothing runs before a result is asked for, but for the checks.

    With `checked`, as for publication, simulated quotes, rows that break the contract, strata without
    a weight and tables of fewer than two dates are errors. The quotes are then read once, to a table in
    `folder` (or the shared folder) that everything else reads.
    """
    spark = quotes.sparkSession
    route_weights = route_weights if route_weights is not None else dimensions.routes(spark)
    if checked:
        quotes = checked_quotes(quotes, folder or store.shared(spark, "checked-quotes"))
    days, universe = elementary.calendar(quotes), elementary.strata(quotes)
    items = elementary.item_prices(quotes)
    relatives = elementary.jevons_relatives(items, days, universe)
    imputed = imputation.impute(relatives)
    levels = chain.chain(imputed, days, universe)
    weights = dimensions.basket_weights(route_weights, dimensions.scenarios(spark))
    if checked:
        aggregate.check_orphans(universe, weights)
    availability = aggregate.cell_availability(quotes, len(C.ROUTES) * len(C.LEAD_TIMES))
    return IndexBuild(quotes, days, universe, items, relatives, imputed, levels, weights, availability, aggregate.index_points(levels, weights, availability))


def checked_quotes(quotes: DataFrame, path: str) -> DataFrame:
    """The quotes as a table at `path`, measured while they are written: none simulated, the contract kept, two collection dates at least."""

    def judge(found: dict) -> None:
        if found["simulated"]:
            raise ValueError(SIMULATED)
        if found["first_day"] == found["last_day"]:
            raise ValueError(TWO_DATES)

    more = {"simulated": F.count_if(simulated(quotes.columns)), "first_day": F.min("collection_date"), "last_day": F.max("collection_date")}
    return contracts.write_checked(quotes, path, contracts.quote_rules(quotes.columns), more, judge)


def check_buildable(quotes: DataFrame) -> None:
    """At least two collection dates are needed."""
    if quotes.select("collection_date").distinct().limit(2).count() < 2:
        raise ValueError(TWO_DATES)
