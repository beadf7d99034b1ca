"""Latency summaries, access statistics and windowed alarms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskloom.fixed import QUANTILES, Alarm
from riskloom.operators.keys import join_groups
from riskloom.operators.ranking import range_cuts, running_totals


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, quantiles: dict[str, float], cuts: Sequence[float] | None = None
) -> DataFrame:
    """Quantiles with linear interpolation at place (n - 1) q, exact for any group size.

    Values are counted first and ordered in ranges, so no task ever holds the
    values of a whole group.
    """
    filled = df.filter(F.col(value).isNotNull())
    cuts = range_cuts(filled, value) if cuts is None else cuts
    ties = filled.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    ordered = running_totals(ties, groups, value, ["_n"], cuts)
    first, last = F.col("before__n"), F.col("before__n") + F.col("_n")

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place < last), F.col(value)))

    parts = []
    for name, q in quantiles.items():
        place = (F.col("total__n") - 1) * F.lit(q)
        parts += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]
    found = ordered.groupBy(*groups).agg(F.max("total__n").alias("_total"), *parts)
    out = []
    for name, q in quantiles.items():
        place = (F.col("_total") - 1) * F.lit(q)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*groups, *out)


def measured(samples: DataFrame) -> DataFrame:
    """Samples without the warm-up phase."""
    return samples.filter(F.col("phase") == "measured")


def latency_summary(
    samples: DataFrame,
    route: str = "route_name",
    elapsed: str = "elapsed_ms",
    success: Column | None = None,
    digits: int = 2,
) -> DataFrame:
    """Counts of all samples and latency statistics of the successful ones, per route."""
    success = (F.col("ok") & (F.col("status_code") == 200)) if success is None else success
    good = F.coalesce(success, F.lit(False))
    base = samples.select(F.col(route).alias("route"), F.col(elapsed).alias("_ms"), good.alias("_good"))
    ms = F.when(F.col("_good"), F.col("_ms"))
    counts = base.groupBy("route").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("_good").alias("n_success"),
        F.count_if(~F.col("_good")).alias("n_failure"),
        F.round(F.avg(ms), digits).alias("mean_ms"),
        F.round(F.min(ms), digits).alias("min_ms"),
        F.round(F.max(ms), digits).alias("max_ms"),
    )
    names = {f"p{round(q * 100)}_ms": q for q in QUANTILES}
    places = exact_quantiles(base.filter("_good"), ["route"], "_ms", names)
    joined = join_groups(counts, places, ["route"], "left")
    return joined.select(
        "route",
        "n_total",
        "n_success",
        "n_failure",
        "mean_ms",
        F.round("p50_ms", digits).alias("median_ms"),
        *[F.round(n, digits).alias(n) for n in names],
        "min_ms",
        "max_ms",
    )


def access_statistics(log: DataFrame, route: str, status: str, latency: str) -> DataFrame:
    """Requests, mean and highest latency by route and status, busiest first."""
    return (
        log.groupBy(F.col(route).alias("route"), F.col(status).alias("status"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.avg(latency).alias("avg_latency_ms"),
            F.max(latency).alias("max_latency_ms"),
        )
        .orderBy(F.desc("requests"), "route", "status")
    )


def latest(df: DataFrame, ordering: Sequence[Column], k: int) -> DataFrame:
    """The first k rows under an ordering; each task keeps only k rows."""
    return df.orderBy(*ordering).limit(k)


def latest_per_key(df: DataFrame, keys: Sequence[str], ordering: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; the rank limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering))
    return df.withColumn("place", rank).filter(F.col("place") <= k)


def window_metrics(
    log: DataFrame,
    time: str,
    latency: str,
    error: Column,
    seconds: int = 60,
    groups: Sequence[str] = (),
    server_error: Column | None = None,
) -> DataFrame:
    """Errors and latency statistics per period (and group); periods start at multiples of their length."""
    start = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds) * seconds
    base = log.select(
        *groups,
        start.cast("long").alias("period"),
        F.col(latency).alias("_ms"),
        error.cast("int").alias("_error"),
        (F.lit(0) if server_error is None else server_error.cast("int")).alias("_server_error"),
    )
    keys = [*groups, "period"]
    sums = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("_error").alias("errors"),
        F.sum("_server_error").alias("server_errors"),
        F.max("_ms").alias("max_ms"),
    )
    places = exact_quantiles(base, keys, "_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return join_groups(sums, places, keys, "left")


COMPARE = {
    ">": lambda x, t: x > t,
    ">=": lambda x, t: x >= t,
    "<": lambda x, t: x < t,
    "<=": lambda x, t: x <= t,
}


#: Periods that one piece of a series holds.
PIECE = 4096


def calendar(metrics: DataFrame, seconds: int, groups: Sequence[str] = ()) -> DataFrame:
    """Every period between the first and the last one of each group; long series are dealt out in pieces."""
    span = metrics.groupBy(*groups).agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
    step = F.lit(seconds).cast("long")
    pieces = span.select(*groups, "_b", F.explode(F.sequence("_a", "_b", PIECE * step)).alias("_from"))
    spread = pieces.repartition(*groups, "_from")
    return spread.select(*groups, F.explode(F.sequence("_from", F.least("_b", F.col("_from") + (PIECE - 1) * step), step)).alias("period"))


def alarm_states(
    metrics: DataFrame,
    value: str,
    alarm: Alarm,
    groups: Sequence[str] = (),
    seconds: int | None = None,
) -> DataFrame:
    """State of an alarm in every period: at least M of the last N periods breach.

    A period without data does not breach. Periods are cut into blocks whose
    first rows see the N - 1 periods before the block, so a long series of one
    group is many small windows.
    """
    seconds = seconds or alarm.period_seconds
    n = alarm.periods
    breach = F.coalesce(COMPARE[alarm.comparison](F.col(value), alarm.threshold), F.lit(False))
    seen = metrics.select(*groups, "period", value)
    dense = join_groups(calendar(metrics, seconds, groups), seen, [*groups, "period"], "left")
    dense = dense.withColumn("breaching", breach.cast("int"))
    block = PIECE * seconds
    own = F.floor(F.col("period") / block).cast("long")
    later = F.floor((F.col("period") + (n - 1) * seconds) / block).cast("long")
    spread = dense.withColumn("_block", F.explode(F.array_distinct(F.array(own, later))))
    recent = Window.partitionBy(*groups, "_block").orderBy("period").rowsBetween(-(n - 1), 0)
    return (
        spread.withColumn("breaches", F.sum("breaching").over(recent))
        .filter(F.col("_block") == own)
        .select(
            *groups,
            F.lit(alarm.name).alias("alarm"),
            "period",
            value,
            "breaching",
            "breaches",
            (F.col("breaches") >= alarm.datapoints).alias("in_alarm"),
        )
    )
