"""Queries of the index engine over quotes made of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.functions import dimensions
from indexloom.operators import aggregate, imputation, multilateral
from indexloom.plans.index_build import IndexBuild, build
from indexloom.plans.index_sql import statement
from indexloom.sources.quotes import quotes_from_events

QUERIES: dict[str, tuple] = {}
QUERY_SQL: dict[str, str] = {}  # each query's own statement, without its building blocks


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def put(f):
        QUERIES[name] = (f, statement(sql, extra) if sql else None)
        QUERY_SQL[name] = sql
        return f

    return put


def _built(spark: SparkSession, sf: str) -> IndexBuild:
    return build(quotes_from_events(spark, sf))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


@query("quotes_view", "SELECT quote_id, collection_date, source, origin, destination, lead_time_days, carrier, total_fare, is_available, unavailable_reason FROM quotes")
def quotes_view(spark, sf):
    return quotes_from_events(spark, sf).drop("collection_ts_utc")


@query("item_prices", "SELECT * FROM items")
def item_prices(spark, sf):
    return _built(spark, sf).items


@query("strata_universe", "SELECT * FROM strata")
def strata_universe(spark, sf):
    return _built(spark, sf).universe


@query("collection_calendar", "SELECT collection_date, day_no FROM days")
def collection_calendar(spark, sf):
    return _built(spark, sf).days.withColumn("day_no", F.col("day_no").cast("long"))


@query("jevons_relatives", "SELECT origin, destination, lead_time_days, collection_date, round(relative, 6) AS relative, matched_items, items_this_period, items_prev_period FROM relatives")
def jevons_relatives(spark, sf):
    return rounded(_built(spark, sf).relatives.drop("day_no"), "relative")


@query("imputed_relatives", "SELECT origin, destination, lead_time_days, collection_date, round(relative_used, 6) AS relative_used, imputation_tier FROM imputed")
def imputed_relatives(spark, sf):
    return rounded(_built(spark, sf).imputed.select(*C.STRATUM_KEY, "collection_date", "relative_used", "imputation_tier"), "relative_used")


@query(
    "imputation_summary",
    "SELECT collection_date, " + ", ".join(f"count(*) FILTER (WHERE imputation_tier = '{t}') AS {t}" for t in imputation.TIERS) + ", count(*) AS n_strata, round(count(*) FILTER (WHERE imputation_tier = 'observed') / count(*)::DOUBLE, 6) AS observed_share FROM imputed GROUP BY collection_date",
)
def imputation_summary(spark, sf):
    return rounded(imputation.summary(_built(spark, sf).imputed), "observed_share")


@query("stratum_levels", "SELECT origin, destination, lead_time_days, collection_date, round(stratum_index, 2) AS stratum_index, imputation_tier, matched_items FROM levels")
def stratum_levels(spark, sf):
    return rounded(_built(spark, sf).levels, "stratum_index", places=2)


@query("cell_availability", "SELECT collection_date, cells_priced, cells_in_basket, round(availability_rate, 6) AS availability_rate, cells_blocked, cells_sold_out FROM availability")
def cell_availability(spark, sf):
    return rounded(_built(spark, sf).availability, "availability_rate")


_POINT = "collection_date, scenario, round(index_value, 6) AS index_value, round(availability_rate, 6) AS availability_rate, round(observed_weight_share, 6) AS observed_weight_share, strata_contributing, strata_in_basket"


@query("index_points", f"SELECT {_POINT} FROM points")
def index_points(spark, sf):
    return rounded(_built(spark, sf).points, "index_value", "availability_rate", "observed_weight_share")


@query("index_headline", f"SELECT {_POINT} FROM points WHERE scenario = 'uniform'")
def index_headline(spark, sf):
    return rounded(_built(spark, sf).headline(), "index_value", "availability_rate", "observed_weight_share")


@query(
    "index_without_census",
    "SELECT l.collection_date, w.scenario, round(sum(l.stratum_index * w.weight) / sum(w.weight), 6) AS index_value, round(sum(w.weight), 6) AS availability_rate FROM levels l JOIN weights w ON w.origin = l.origin AND w.destination = l.destination AND w.lead_time_days = l.lead_time_days WHERE l.stratum_index IS NOT NULL GROUP BY ALL",
)
def index_without_census(spark, sf):
    b = _built(spark, sf)
    return rounded(aggregate.index_points(b.levels, b.weights).select("collection_date", "scenario", "index_value", "availability_rate"), "index_value", "availability_rate")


@query(
    "scenario_band",
    """SELECT *, least(advance_heavy, near_term_heavy, uniform) AS band_low, greatest(advance_heavy, near_term_heavy, uniform) AS band_high, round(greatest(advance_heavy, near_term_heavy, uniform) - least(advance_heavy, near_term_heavy, uniform), 4) AS band_width FROM (
    SELECT collection_date, avg(index_value) FILTER (WHERE scenario = 'advance_heavy') AS advance_heavy, avg(index_value) FILTER (WHERE scenario = 'near_term_heavy') AS near_term_heavy, avg(index_value) FILTER (WHERE scenario = 'uniform') AS uniform FROM published GROUP BY collection_date)""",
)
def scenario_band(spark, sf):
    return _built(spark, sf).band()


def _resample_sql(period: str, step: str) -> str:
    return f"""SELECT g.scenario, CAST(g.period AS DATE) AS collection_date, round(r.index_value, 6) AS index_value, round(r.availability_rate, 6) AS availability_rate, round(r.observed_weight_share, 6) AS observed_weight_share, coalesce(r.n, 0) AS days_in_period
    FROM (SELECT scenario, unnest(generate_series(CAST(min({period}) AS TIMESTAMP), CAST(max({period}) AS TIMESTAMP), {step})) AS period FROM published GROUP BY scenario) g
    LEFT JOIN (SELECT scenario, {period} AS period, exp(avg(ln(index_value))) AS index_value, avg(availability_rate) AS availability_rate, avg(observed_weight_share) AS observed_weight_share, count(*) AS n FROM published GROUP BY ALL) r
    ON r.scenario = g.scenario AND r.period = CAST(g.period AS DATE)"""


@query("index_weekly", _resample_sql("CAST(date_trunc('week', collection_date) AS DATE) + 6", "INTERVAL 7 DAY"))
def index_weekly(spark, sf):
    return rounded(aggregate.resample(aggregate.published(_built(spark, sf).points), "W"), "index_value", "availability_rate", "observed_weight_share")


@query("index_monthly", _resample_sql("CAST(date_trunc('month', collection_date) AS DATE)", "INTERVAL 1 MONTH"))
def index_monthly(spark, sf):
    return rounded(aggregate.resample(aggregate.published(_built(spark, sf).points), "MS"), "index_value", "availability_rate", "observed_weight_share")


@query("direct_index", "SELECT collection_date, round(direct_index, 6) AS direct_index, matched_vs_base FROM direct")
def direct_index(spark, sf):
    return rounded(_built(spark, sf).direct(), "direct_index")


@query("bilateral_matrix", "SELECT a AS day_a, b AS day_b, round(exp(ln_p), 6) AS jevons, matched FROM matrix")
def bilateral_matrix(spark, sf):
    b = _built(spark, sf)
    return multilateral.bilateral_matrix(b.items, b.days, 25).select(F.col("a").cast("long").alias("day_a"), F.col("b").cast("long").alias("day_b"), F.round(F.exp("ln_p"), 6).alias("jevons"), "matched")


@query("geks_windows", "SELECT e AS window_end, t AS day_no, round(100 * exp(ln_g), 6) AS geks_level FROM window_levels")
def geks_windows(spark, sf):
    b = _built(spark, sf)
    m = multilateral.window_levels(multilateral.bilateral_matrix(b.items, b.days, 25), b.days.count(), 25)
    return m.select(F.col("e").cast("long").alias("window_end"), F.col("t").cast("long").alias("day_no"), F.round(100 * F.exp("ln_g"), 6).alias("geks_level"))


@query("geks_index", "SELECT collection_date, round(geks_index, 6) AS geks_index FROM geks")
def geks_index(spark, sf):
    return rounded(_built(spark, sf).geks(), "geks_index")


@query(
    "drift_diagnostic",
    """SELECT count(*) AS n, arg_max(index_value, collection_date) AS final_chained, round(arg_max(geks_index, collection_date), 6) AS final_geks, round(arg_max(direct_index, collection_date), 6) AS final_direct,
    round(avg(abs(gap)), 4) AS mean_abs_gap_pts, round(arg_max(gap, collection_date), 6) AS final_gap_pts, round(regr_slope(gap, k), 4) AS gap_trend_pts_per_day,
    CASE WHEN abs(regr_slope(gap, k)) > 0.05 THEN 'gap grows with the series: chain drift' ELSE 'no systematic trend in the gap' END AS reading FROM drift_days""",
)
def drift_diagnostic(spark, sf):
    return rounded(rounded(_built(spark, sf).drift(), "final_geks", "final_direct", "final_gap_pts"), "mean_abs_gap_pts", "gap_trend_pts_per_day", places=4)


@query("lead_curve", "SELECT collection_date, lead_time_days, round(avg(stratum_index), 2) AS stratum_index FROM levels GROUP BY ALL")
def lead_curve(spark, sf):
    return rounded(aggregate.lead_curve(_built(spark, sf).levels), "stratum_index", places=2)


_DATES = ["2024-01-05", "2024-01-15", "2024-01-30"]


@query("route_table", "SELECT origin || '-' || destination AS route, " + ", ".join(f"round(avg(stratum_index) FILTER (WHERE collection_date = DATE '{d}'), 2) AS d_{d.replace('-', '_')}" for d in _DATES) + " FROM levels GROUP BY ALL")
def route_table(spark, sf):
    t = aggregate.route_table(_built(spark, sf).levels, _DATES)
    return rounded(t, *t.columns[1:], places=2)


@query("latest_points", "SELECT collection_date, scenario, index_value FROM published QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY collection_date DESC) <= 10")
def latest_points(spark, sf):
    """The last ten points of each scenario, from a table of one row a day."""
    from pyspark.sql import Window

    p = aggregate.published(_built(spark, sf).points)
    return p.withColumn("k", F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("collection_date")))).where("k <= 10").select("collection_date", "scenario", "index_value")


@query("daily_change", "SELECT collection_date, scenario, round(ln(index_value) - ln(lag(index_value) OVER (PARTITION BY scenario ORDER BY collection_date)), 6) AS log_change, round(index_value - lag(index_value) OVER (PARTITION BY scenario ORDER BY collection_date), 4) AS change FROM published")
def daily_change(spark, sf):
    from indexloom.operators.diagnostics import changes

    return rounded(rounded(changes(aggregate.published(_built(spark, sf).points), "index_value", ["scenario"]).select("collection_date", "scenario", "log_change", "change"), "log_change"), "change", places=4)


@query("points_in_range", "SELECT collection_date, index_value FROM published WHERE scenario = 'uniform' AND collection_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def points_in_range(spark, sf):
    return aggregate.published(_built(spark, sf).headline()).where("collection_date between date '2024-01-10' and date '2024-01-20'").select("collection_date", "index_value")
