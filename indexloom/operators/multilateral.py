"""Direct, bilateral and rolling GEKS indices, and the drift between them and the chained index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions import constants as C


def direct_index(items: DataFrame, days: DataFrame) -> DataFrame:
    """Each day against the first: 100 times the Jevons index of the items that both have."""
    base = items.join(F.broadcast(days.where("day_no = 1").select("collection_date")), "collection_date").select(*C.ITEM_KEY, F.col("total_fare").alias("base_fare"))
    got = items.join(base, C.ITEM_KEY).groupBy("collection_date").agg(F.avg(F.log(F.col("total_fare") / F.col("base_fare"))).alias("g"), F.count("*").alias("m"))
    out = days.join(got, "collection_date", "left")
    later = F.col("day_no") > 1
    return out.select("collection_date", F.when(later, C.BASE_VALUE * F.exp("g")).otherwise(F.lit(C.BASE_VALUE)).alias("direct_index"), F.when(later, F.coalesce("m", F.lit(0))).cast("long").alias("matched_vs_base"))


def bilateral_matrix(items: DataFrame, days: DataFrame, window: int) -> DataFrame:
    """ln of the Jevons index of day b against day a for all pairs less than `window` days apart, and their matched items.

    Each item's prices are gathered over the days of the window only: a range join on the day number
    within the item key, whose groups are bounded by the calendar. ln P(b, a) is -ln P(a, b), so
    half the pairs are worked out.
    """
    n = items.join(F.broadcast(days), "collection_date").select(*C.ITEM_KEY, "day_no", F.log("total_fare").alias("ln"))
    w = Window.partitionBy(*C.ITEM_KEY).orderBy("day_no").rangeBetween(0, window - 1)
    later = n.withColumn("next", F.collect_list(F.struct(F.col("day_no").alias("b"), F.col("ln").alias("ln_b"))).over(w))  # at most `window` days
    pairs = later.select(F.col("day_no").alias("a"), "ln", F.explode("next").alias("n")).select("a", F.col("n.b").alias("b"), (F.col("n.ln_b") - F.col("ln")).alias("d"))
    half = pairs.where("b > a").groupBy("a", "b").agg(F.avg("d").alias("ln_p"), F.count("*").alias("matched"))
    back = half.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("ln_p")).alias("ln_p"), "matched")
    same = days.select(F.col("day_no").alias("a"), F.col("day_no").alias("b"), F.lit(0.0).alias("ln_p"), F.lit(None).cast("long").alias("matched"))
    return half.unionByName(back).unionByName(same)


def window_levels(matrix: DataFrame, n_days: int, window: int, first_end: int | None = None) -> DataFrame:
    """ln GEKS level of day t in the window that ends on day e, against the window's first day: the mean over link days k of ln P(k, t) - ln P(k, first)."""
    ends = matrix.sparkSession.range(first_end or window, n_days + 1).select(F.col("id").cast("int").alias("e"))
    start = F.col("e") - (window - 1)
    inside = matrix.join(F.broadcast(ends), (F.col("a") <= F.col("e")) & (F.col("a") >= start) & (F.col("b") <= F.col("e")) & (F.col("b") >= start))
    first = inside.where(F.col("b") == start).select("e", F.col("a"), F.col("ln_p").alias("ln_first"))
    return inside.join(first, ["e", "a"]).groupBy("e", F.col("b").alias("t")).agg(F.avg(F.col("ln_p") - F.col("ln_first")).alias("ln_g"))


def splice(levels: DataFrame, window: int, known: list[tuple[int, float | None]] | None = None) -> DataFrame:
    """(day_no, lv): ln levels of all days, or of those behind the `known` ones, the last days before the first window's end."""
    per_window = levels.groupBy("e").agg(F.map_from_entries(F.collect_list(F.struct("t", "ln_g"))).alias("m"))
    rows = per_window.groupBy().agg(F.collect_list(F.struct("e", "m")).alias("w"))  # days x window numbers
    ordered = rows.select(F.expr("array_sort(w, (x, y) -> x.e - y.e)").alias("w"))
    if known is None:
        start, todo = f"transform(sequence(1, {window}), t -> named_struct('t', cast(t as int), 'lv', element_at(w[0].m, cast(t as int))))", "slice(w, 2, greatest(size(w) - 1, 0))"
    else:
        start, todo = "array(" + ", ".join(f"named_struct('t', {t:d}, 'lv', cast({'null' if lv is None else repr(lv)} as double))" for t, lv in [(-window, None), *known]) + ")", "w"  # the first, in no window, makes levels nullable
    mean = "aggregate(filter(acc, p -> p.t > x.e - {w} and p.t < x.e and p.lv is not null and element_at(x.m, p.t) is not null), named_struct('s', cast(0 as double), 'n', 0), (q, p) -> named_struct('s', q.s + p.lv - element_at(x.m, p.t), 'n', q.n + 1), q -> case when q.n > 0 then q.s / q.n end)".format(w=window)
    fold = f"aggregate({todo}, {start}, (acc, x) -> concat(acc, array(named_struct('t', cast(x.e as int), 'lv', element_at(x.m, cast(x.e as int)) + {mean}))))"
    out = ordered.select(F.explode(F.expr(fold)).alias("p")).select(F.col("p.t").alias("day_no"), F.col("p.lv").alias("lv"))
    return out.where(F.col("day_no") > max(t for t, _ in known)) if known else out


def geks_window(n_days: int, window: int) -> int:
    return min(max(3, window), n_days)


def geks_index(items: DataFrame, days: DataFrame, window: int = 25) -> DataFrame:
    """Rolling-window GEKS with a mean splice.

    The matrix and the windows are distributed; what is folded in order is one number for each day
    and window, in one array. Days without a level stay out of a splice's overlap (a missing level
    doesn't spread to later days).
    """
    n_days = days.count()
    if n_days < 2:
        return days.limit(0).select("collection_date", F.lit(None).cast("double").alias("geks_index"))
    window = geks_window(n_days, window)
    out = splice(window_levels(bilateral_matrix(items, days, window), n_days, window), window)
    return days.join(out, "day_no", "left").select("collection_date", (C.BASE_VALUE * F.exp("lv")).alias("geks_index"))


def drift(chained: DataFrame, geks: DataFrame, direct: DataFrame) -> DataFrame:
    """One row: final values, gap and its trend a day (slope over the position), or a note below three days."""
    m = chained.select("collection_date", "index_value").join(geks, "collection_date").join(direct.select("collection_date", "direct_index"), "collection_date")
    m = m.where("index_value is not null and geks_index is not null").withColumn("gap", F.col("index_value") - F.col("geks_index"))
    m = m.withColumn("k", F.row_number().over(Window.orderBy("collection_date")) - 1)  # one row a day
    last = lambda c: F.max_by(c, "collection_date")
    out = m.agg(
        F.count("*").alias("n"), last("index_value").alias("final_chained"), last("geks_index").alias("final_geks"), last("direct_index").alias("final_direct"),
        F.avg(F.abs("gap")).alias("mean_abs_gap_pts"), last("gap").alias("final_gap_pts"), F.regr_slope("gap", "k").alias("gap_trend_pts_per_day"),
    )
    enough = F.col("n") >= 3
    out = out.select("n", *[F.when(enough, F.col(c)).alias(c) for c in out.columns[1:]])
    reading = F.when(~enough, "too few overlapping days to assess drift").when(F.abs("gap_trend_pts_per_day") > 0.05, "gap grows with the series: chain drift").otherwise("no systematic trend in the gap")
    return out.withColumn("reading", reading)
