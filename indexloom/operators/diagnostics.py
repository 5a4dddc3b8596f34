"""Agreement between series, and comparisons with outside benchmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.sources.quotes import priced


def changes(series: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds the change and the log change since the row before, in order of date within each of `by`."""
    w = Window.partitionBy(*by).orderBy("collection_date")
    return series.withColumn("change", F.col(value) - F.lag(value).over(w)).withColumn("log_change", F.log(value) - F.lag(F.log(value)).over(w))


def merge_series(frames: dict[str, DataFrame]) -> DataFrame:
    """Dates that all series have, one column each; rows with a null go."""
    named = [df.select("collection_date", F.col(df.columns[1]).alias(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, "collection_date"), named).dropna()


def agreement(frames: dict[str, DataFrame], least_days: int = 5) -> DataFrame:
    """For each pair of series: correlation of log changes, mean and final level gap; nulls below `least_days` days."""
    merged = merge_series(frames)
    names = list(frames)
    w = Window.orderBy("collection_date")  # one row a day
    for n in names:
        merged = merged.withColumn("d_" + n, F.log(n) - F.lag(F.log(n)).over(w))
    rows = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            enough = F.count("*") >= least_days
            rows.append(
                merged.agg(
                    F.count("*").alias("n_days"),
                    F.when(enough, F.corr("d_" + a, "d_" + b)).alias("corr_of_log_changes"),
                    F.when(enough, F.avg(F.abs(F.col(a) - F.col(b)))).alias("mean_abs_level_gap"),
                    F.when(enough, F.max_by(F.col(a) - F.col(b), "collection_date")).alias("final_level_gap"),
                ).select(F.lit(f"{a}_vs_{b}").alias("pair"), "*")
            )
    return reduce(DataFrame.unionByName, rows)


def weakest_pair(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.col("corr_of_log_changes").asc_nulls_last(), "pair").limit(1)


def compare_levels(a: DataFrame, b: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """One row: days in common, Pearson r, mean and greatest divergence (null below `least` days)."""
    m = a.select("collection_date", x).join(b.select("collection_date", y), "collection_date").where(F.col(x).isNotNull() & F.col(y).isNotNull())
    gap, enough = F.abs(F.col(x) - F.col(y)), F.count("*") >= least
    return m.agg(F.count("*").alias("n"), F.when(enough, F.corr(x, y)).alias("pearson_r"), F.when(enough, F.avg(gap)).alias("mean_abs_divergence_pts"), F.when(enough, F.max(gap)).alias("max_abs_divergence_pts"))


def compare_to_monthly(daily: DataFrame, benchmark: DataFrame, least_months: int = 3) -> DataFrame:
    """Monthly means of a daily index against a monthly benchmark (month, cpi_index): correlation and sign agreement of log changes, with a reading."""
    monthly = daily.groupBy(F.trunc("collection_date", "MM").alias("month")).agg(F.avg("index_value").alias("x"))
    j = monthly.join(benchmark.select(F.trunc("month", "MM").alias("month"), F.col("cpi_index").alias("y")), "month")
    w = Window.orderBy("month")  # one row a month
    d = j.withColumn("dx", F.log("x") - F.lag(F.log("x")).over(w)).withColumn("dy", F.log("y") - F.lag(F.log("y")).over(w))
    enough = F.count("*") >= least_months
    out = d.agg(F.count("*").alias("overlapping_months"), F.count("dx").alias("n_changes"), F.when(enough, F.corr("dx", "dy")).alias("r"), F.when(enough, F.avg(F.when(F.col("dx").isNotNull(), (F.signum("dx") == F.signum("dy")).cast("double")))).alias("direction_agreement"))
    reading = F.when(F.col("r") > 0.6, "strong").when(F.col("r") > 0.2, "moderate").when(F.col("r").isNotNull(), "weak").otherwise("too few months")
    return out.withColumn("reading", reading)


def median_by_route(quotes: DataFrame) -> DataFrame:
    """Exact median of available fares of each route."""
    return priced(quotes).groupBy("origin", "destination").agg(F.expr("percentile(total_fare, 0.5)").alias("median_fare"), F.count("*").alias("n"))


def compare_fare_levels(quotes: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each route's median over a benchmark's average fare (origin, destination, average_fare), with the median of the ratios."""
    j = median_by_route(quotes).join(benchmark, ["origin", "destination"]).withColumn("ratio", F.col("median_fare") / F.col("average_fare"))
    return j.withColumn("median_ratio", F.expr("percentile(ratio, 0.5) over ()"))  # one row a route
