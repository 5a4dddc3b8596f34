"""Hedonic time-dummy regression: sums of the normal equations in Spark, one small solve on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.sources.quotes import priced

TERMS = ["route", "carrier", "lead_time_days", "dep_dow", "dep_hour_band", "is_holiday"]
MIN_OBSERVATIONS = 60


@dataclass(frozen=True)
class HedonicResult:
    series: DataFrame
    r_squared: float
    n_observations: int
    n_parameters: int
    terms_used: list[str]
    terms_dropped: list[str]


def hour_band(hour):
    """Right-closed bands of the hour of departure."""
    return F.when(hour <= 5, "red_eye").when(hour <= 9, "early_morning").when(hour <= 12, "morning").when(hour <= 17, "afternoon").when(hour <= 21, "evening").when(hour <= 24, "night")


def _priced(quotes: DataFrame, holidays: DataFrame | None) -> DataFrame:
    """Priced quotes with log fare, route, weekday and hour band of a departure time in Indian time, weekday of the departure date, and a holiday flag."""
    df = priced(quotes).withColumn("total_fare", F.col("total_fare").cast("double")).where("total_fare > 0")
    df = df.withColumn("log_fare", F.log("total_fare")).withColumn("route", F.concat_ws("-", "origin", "destination"))
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col("dep_ts").cast("timestamp_ntz"))
    df = df.withColumns({"_ts_dow": F.weekday(local), "_ts_band": hour_band(F.hour(local)), "_date_dow": F.weekday("dep_date") if "dep_date" in df.columns else F.lit(None).cast("int")})
    if holidays is None:
        return df.withColumn("is_holiday", F.lit(None).cast("int"))
    flag = holidays.select(F.col("day").alias("_day")).distinct().withColumn("_h", F.lit(1))
    return df.join(flag, F.col("dep_date") == F.col("_day"), "left").withColumn("is_holiday", F.coalesce("_h", F.lit(0))).drop("_day", "_h")


def _departures(df: DataFrame, timed: bool) -> DataFrame:
    """Weekday and hour band by departure times; if no quote has one, weekday by departure dates and the band 'unknown'."""
    dow, band = (F.col("_ts_dow"), F.col("_ts_band")) if timed else (F.col("_date_dow"), F.lit("unknown"))
    return df.withColumns({"dep_dow": dow, "dep_hour_band": band}).drop("_ts_dow", "_ts_band", "_date_dow")


def prepare(quotes: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Priced quotes with log fare, route, weekday (Monday 0) and hour band in Indian time, and a holiday flag if a calendar (day) is given.

    If no quote has a departure time, weekday comes from the departure date and the band is 'unknown'.
    """
    df = _priced(quotes, holidays)
    return _departures(df, bool(df.where("dep_ts is not null").limit(1).count()))


def _lead(lead_weights: dict[int, float] | None):
    lead = F.lit(1.0)
    for k, v in (lead_weights or {}).items():
        lead = F.when(F.col("lead_time_days") == k, F.lit(v)).otherwise(lead)
    return lead


def with_weights(df: DataFrame, route_weights: DataFrame | None, lead_weights: dict[int, float] | None) -> DataFrame:
    """Adds _w: route weight x lead weight over the quotes of the cell and day, with mean 1; 1 if nothing weighs."""
    if route_weights is None:
        return df.withColumn("_w", F.lit(1.0))
    rw = route_weights.select("origin", "destination", F.col("weight").alias("_rw"))
    cell = Window.partitionBy("collection_date", *C.STRATUM_KEY)
    raw = df.join(F.broadcast(rw), ["origin", "destination"], "left").withColumn("_w", F.coalesce("_rw", F.lit(0.0)) * _lead(lead_weights) / F.count("*").over(cell)).drop("_rw")
    mean = raw.agg(F.avg("_w").alias("m")).first().m
    return raw.withColumn("_w", F.col("_w") / F.lit(mean) if mean and mean > 0 else F.lit(1.0))


@dataclass(frozen=True)
class Design:
    """The regression's distinct rows (`cells`: terms, day, n quotes with sums sy and syy of their log fares, weight w), its terms and sizes."""

    cells: DataFrame
    terms: list[str]
    n_quotes: int
    n_days: int


def _observed(quotes: DataFrame, route_weights: DataFrame | None, lead_weights: dict[int, float] | None, holidays: DataFrame | None) -> DataFrame:
    """Priced quotes by distinct row of the design and their cell's weight: the only pass over the quotes."""
    keys = ["origin", "destination", "lead_time_days", "collection_date", "route", "carrier", "is_holiday", "_ts_dow", "_ts_band", "_date_dow"]
    y = F.col("log_fare")
    cells = _priced(quotes, holidays).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.count("dep_ts").alias("timed"))
    if route_weights is None:
        return cells.withColumn("w", F.lit(1.0))
    rw = route_weights.select("origin", "destination", F.col("weight").alias("_rw"))
    of_cell = F.sum("n").over(Window.partitionBy("collection_date", *C.STRATUM_KEY))
    return cells.join(F.broadcast(rw), ["origin", "destination"], "left").withColumn("w", F.coalesce("_rw", F.lit(0.0)) * _lead(lead_weights) / of_cell).drop("_rw")


def design(observed: DataFrame) -> Design:
    """One job over `_observed` says which terms have two levels, how much the weights are in the mean, and how many quotes and days there are."""
    terms = {"route": "route", "carrier": "carrier", "lead_time_days": "lead_time_days", "is_holiday": "is_holiday", "dep_dow": "_ts_dow", "dep_hour_band": "_ts_band", "_date_dow": "_date_dow"}
    a = observed.agg(
        F.sum("n").alias("n"), F.sum("timed").alias("timed"), F.sum(F.col("n") * F.col("w")).alias("wn"), F.size(F.collect_set("collection_date")).alias("d"), *[F.size(F.collect_set(c)).alias(f"levels_{t}") for t, c in terms.items()]
    ).first()
    timed = bool(a.timed)
    several = {t: a[f"levels_{t}"] >= 2 for t in TERMS} | ({} if timed else {"dep_dow": a.levels__date_dow >= 2, "dep_hour_band": False})
    kept = [t for t in TERMS if several[t]]
    w = F.col("w") * (a.n / a.wn) if a.wn and a.wn > 0 else F.lit(1.0)
    cells = _departures(observed, timed).withColumn("w", w).dropna(subset=kept)
    return Design(cells, kept, int(a.n or 0), int(a.d or 0))


@dataclass(frozen=True)
class Fit:
    """Coefficients by term and level (the first level of each term has none), their errors and the fit's figures."""

    levels: dict[str, list]
    beta: np.ndarray
    se: np.ndarray
    place: dict[tuple[str, object], int]
    r_squared: float
    n_observations: int

    def predicted(self):
        """The fitted log fare as a column."""
        return reduce(add, [F.create_map(*(x for level in values for x in (F.lit(level), F.lit(float(self.beta[self.place[t, level]]) if (t, level) in self.place else 0.0))))[F.col(t)] for t, values in self.levels.items()], F.lit(float(self.beta[0])))


def gram(cells: DataFrame, terms: list[str], **sums) -> DataFrame:
    """Sums over all cells, over those of each level of each term, and over those of each pair of levels of two terms.

    Every partition adds up its own cells first, so what is shuffled is a matrix of parameters for each
    partition, whatever the number of quotes. Columns of the terms that a row isn't about are null.
    """
    sets = [[], *([t] for t in terms), *(list(p) for p in combinations(terms, 2))]
    return cells.groupingSets([[F.col(t) for t in s] for s in sets], *[F.col(t) for t in terms]).agg(*[F.sum(v).alias(k) for k, v in sums.items()])


def _keys(row, terms: list[str]) -> list[tuple[str, object]]:
    return [(t, row[t]) for t in terms if row[t] is not None]


def _matrix(rows, every: list[str], place: dict, value: str) -> np.ndarray:
    out = np.zeros((len(place) + 1, len(place) + 1))
    for r in rows:
        keys = _keys(r, every)
        at = [place.get(k) for k in keys]
        if None not in at:  # a first level has no parameter
            i, j = (at + [0] * (2 - len(at)))[:2]
            out[i, j] = out[j, i] = r[value]
            if len(at) == 1:
                out[i, i] = r[value]
    return out


def solve(d: Design) -> Fit:
    """Weighted least squares of log_fare on categorical terms, weights in w, with HC1 errors.

    The weight is constant within a cell and day, so counts and sums over the design's distinct rows
    carry everything. Two aggregations over them give X'WX with the right side, and the errors' middle
    matrix: numbers of parameters squared reach the driver.
    """
    every = [*d.terms, "collection_date"]
    w, n, sy, syy = (F.col(c) for c in ("w", "n", "sy", "syy"))
    first = gram(d.cells, every, wn=w * n, wsy=w * sy, wsyy=w * syy, n=n).collect()
    single = [(k, r) for r in first if len(k := _keys(r, every)) == 1]
    levels = {t: sorted(k[0][1] for k, _ in single if k[0][0] == t) for t in every}
    place = {key: k + 1 for k, key in enumerate((t, level) for t in every for level in levels[t][1:])}
    total = next(r for r in first if not _keys(r, every))
    right = np.zeros(len(place) + 1)
    right[0] = total.wsy
    for k, r in single:
        if k[0] in place:
            right[place[k[0]]] = r.wsy
    xtx = _matrix(first, every, place, "wn")
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ right
    mu = Fit(levels, beta, np.zeros(len(beta)), place, 0.0, 0).predicted()
    squares = syy - 2 * mu * sy + n * mu * mu
    second = gram(d.cells, every, middle=w * w * squares, rest=w * squares).collect()
    middle = _matrix(second, every, place, "middle")
    rest = next(r.rest for r in second if not _keys(r, every))
    se = np.sqrt(np.maximum(np.diag(inverse @ middle @ inverse) * total.n / (total.n - np.linalg.matrix_rank(xtx)), 0))
    return Fit(levels, beta, se, place, 1 - rest / (total.wsyy - total.wsy**2 / total.wn), int(total.n))


def fit(quotes: DataFrame, route_weights: DataFrame | None = None, lead_weights: dict[int, float] | None = None, holidays: DataFrame | None = None, min_observations: int = MIN_OBSERVATIONS) -> HedonicResult | None:
    """The regression's index by day with its errors; None if there are too few quotes or days. The quotes are read once."""
    observed = _observed(quotes, route_weights, lead_weights, holidays).persist()
    try:
        d = design(observed)
        if d.n_quotes < min_observations or d.n_days < 2:
            return None
        f = solve(d)
    finally:
        observed.unpersist()
    days = [(day, f.place.get(("collection_date", day))) for day in f.levels["collection_date"]]
    out = [(day, float(f.beta[k]) if k else 0.0, float(f.se[k]) if k else 0.0) for day, k in days]
    series = quotes.sparkSession.createDataFrame(out, "collection_date date, log_coef double, se double")
    b = C.BASE_VALUE
    series = series.select("collection_date", (b * F.exp("log_coef")).alias("hedonic_index"), "se", (b * F.exp(F.col("log_coef") - 1.96 * F.col("se"))).alias("ci_low"), (b * F.exp(F.col("log_coef") + 1.96 * F.col("se"))).alias("ci_high"))
    return HedonicResult(series, float(f.r_squared), f.n_observations, len(f.beta), d.terms, [t for t in TERMS if t not in d.terms])


def _named(terms: list[str]):
    """The terms and levels that a row of `gram` is about."""
    return F.filter(F.array(*[F.when(F.col(t).isNotNull(), F.struct(F.lit(t).alias("term"), F.col(t).cast("string").alias("level"))) for t in terms]), lambda x: x.isNotNull())


def normal_equations(quotes: DataFrame, route_weights: DataFrame | None = None, lead_weights: dict[int, float] | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """(term, level, weighted_residuals): the sums over the quotes of each level, which a least-squares fit makes zero."""
    observed = _observed(quotes, route_weights, lead_weights, holidays).persist()
    d = design(observed)
    every = [*d.terms, "collection_date"]
    residual = F.col("w") * (F.col("sy") - F.col("n") * solve(d).predicted())
    rows = gram(d.cells, every, weighted_residuals=residual).withColumn("_k", _named(every)).where(F.size("_k") == 1)
    out = rows.select(F.col("_k")[0].term.alias("term"), F.col("_k")[0].level.alias("level"), "weighted_residuals")
    observed.unpersist()
    return out


def level_pairs(quotes: DataFrame, route_weights: DataFrame | None = None, lead_weights: dict[int, float] | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """The entries of X'WX and of its right side: (term_a, level_a, term_b, level_b, n, weight, weighted_log_fare), b null for a single level, both for all."""
    observed = _observed(quotes, route_weights, lead_weights, holidays).persist()
    d = design(observed)
    every = [*d.terms, "collection_date"]
    rows = gram(d.cells, every, n=F.col("n"), weight=F.col("w") * F.col("n"), weighted_log_fare=F.col("w") * F.col("sy"))
    rows = rows.withColumn("_k", _named(every))
    at = lambda i, f: F.get(F.col("_k"), F.lit(i))[f]
    out = rows.select(at(0, "term").alias("term_a"), at(0, "level").alias("level_a"), at(1, "term").alias("term_b"), at(1, "level").alias("level_b"), "n", "weight", "weighted_log_fare")
    observed.unpersist()
    return out
