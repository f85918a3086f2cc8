"""Censoring-aware survival of postings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import days_between
from larkspur.operators.running import running
from larkspur.session import written


def durations(intervals: DataFrame) -> DataFrame:
    """low and high bounds of each lifetime in days (high is null if right-censored), and why a row is dropped, if it is."""
    low, high = days_between("last_seen_open", "first_observed"), days_between("closure_absent_at", "first_observed")
    drop = F.when(F.col("first_observed").isNull(), "no_first").when(low < 0, "negative").when((high.isNull()) & (low <= 0), "zero_follow_up")
    return intervals.select("company_id", "job_id", low.alias("low"), high.alias("high"), high.isNotNull().alias("event"), drop.alias("dropped"))


def kaplan_meier(sample: DataFrame, group: list[str] | None = None) -> DataFrame:
    """time, at_risk, events, survival and the bounds of its exponential Greenwood interval; events count at their upper bound.

    The curve has a row for each distinct time, made by one aggregate; its running sums run by day, with what other days hold from a row a day. Survival is 0 from the time on at which all at risk fail.
    """
    key = group or []
    t = F.coalesce("high", "low")
    rows = sample.filter("dropped is null").groupBy(*key, t.alias("time")).agg(F.count_if(F.col("event")).alias("events"), F.count("*").alias("left"))
    rows = written(rows)
    days = F.floor("time")
    rows = running(rows, key, [F.desc("time")], days, {"at_risk": ("sum", "left")}, falling=True)
    d, n = F.col("events").cast("double"), F.col("at_risk").cast("double")
    rows = rows.withColumn("ends", (F.col("events") == F.col("at_risk")).cast("int")).withColumn("log", F.when(d < n, F.log1p(-d / n)).otherwise(0.0)).withColumn("var", F.when(d < n, d / (n * (n - d))).otherwise(0.0))
    rows = running(rows, key, [F.col("time")], days, {"over": ("max", "ends"), "logs": ("sum", "log"), "v": ("sum", "var")})
    rows = rows.withColumn("survival", F.when(F.col("over") == 1, 0.0).otherwise(F.exp("logs")))
    inner = (F.col("survival") > 0) & (F.col("survival") < 1)
    theta = 1.959963984540054 * F.sqrt("v") / F.log("survival")
    low, high = (F.when(inner, F.exp(-F.exp(F.log(-F.log("survival")) + s * theta))) for s in (-1, 1))
    return rows.select(*key, "time", "at_risk", "events", "survival", low.alias("ci_low"), high.alias("ci_high"))


def survival_at(curve: DataFrame, horizons: list[float], group: list[str] | None = None) -> DataFrame:
    """S(h) for each horizon within the curve's support, else null."""
    key = group or []
    at = [F.when(F.max("time") >= h, F.coalesce(F.max_by("survival", F.when(F.col("time") <= h, F.col("time"))), F.lit(1.0))).alias(f"s{h:g}") for h in horizons]
    median = F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_days")
    return curve.groupBy(*key).agg(median, *at) if key else curve.agg(median, *at)


def interval_counts(sample: DataFrame) -> DataFrame:
    """l, r, n: the distinct intervals of a sample, right-censored ones up to infinity."""
    r = F.when(F.col("high").isNull(), float("inf")).otherwise(F.greatest("high", "low")).cast("double")
    return sample.filter("dropped is null").groupBy(F.col("low").cast("double").alias("l"), r.alias("r")).agg(F.count(F.lit(1)).alias("n"))


def innermost(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The innermost intervals: from a lower bound to the next upper one, where no other lower bound lies between."""
    lefts, rights = np.unique(low), np.unique(high)
    if not len(lefts):
        return lefts, rights
    right = rights[np.searchsorted(rights, lefts)]
    keep = np.r_[lefts[1:] > right[:-1], True]
    return lefts[keep], right[keep]


def turnbull(sample: DataFrame, rounds: int = 2000, tolerance: float = 1e-9, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonparametric maximum likelihood for interval-censored lifetimes: (left, right, mass) of its support, from distinct intervals on the driver.

    An interval covers a run of the support, so a round takes sums of runs from running sums: time and memory grow with the number of distinct intervals, not with its
    square. More than `most` are refused; turnbull_rounds fits them on executors.
    """
    rows = interval_counts(sample).limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError("too many distinct intervals for the driver: use turnbull_rounds")
    low, high, n = (rows[c].to_numpy().astype(float) for c in ("l", "r", "n"))
    left, right = innermost(low, high)
    first, last = np.searchsorted(left, low, "left"), np.searchsorted(right, high, "right")
    mass = np.full(len(left), 1 / max(1, len(left)))
    for _ in range(rounds if len(left) else 0):
        upto = np.r_[0.0, np.cumsum(mass)]
        weight = n / np.maximum(upto[last] - upto[first], 1e-300)
        change = np.bincount(first, weight, len(left) + 1) - np.bincount(last, weight, len(left) + 1)
        new = mass * np.cumsum(change)[:-1] / n.sum()
        done = np.abs(new - mass).max() < tolerance
        mass = mass if done else new
        if done:
            break
    return left, right, mass


def turnbull_rounds(sample: DataFrame, rounds: int = 200, tolerance: float = 1e-6, width: int = 65_536) -> DataFrame:
    """The same fit for any number of intervals: left, right (infinity where it is open) and mass of the support, in an order j from 1.

    The support comes from one sweep over the sorted bounds, and each interval's run of it from counts of bounds. A round is three shuffles: running sums of mass, their
    difference over each interval's run, and running sums of what the runs add where they begin and take away behind their end. Sums run in stretches of `width`
    places, so no task sees the whole support; what a round makes is written, so lost executors cost one round at most.
    """
    counts = written(interval_counts(sample))
    total = counts.agg(F.sum("n")).first()[0]
    day = lambda c: F.floor(F.least(c, F.lit(1e12)))
    lefts, rights = counts.select(F.col("l").alias("x")).distinct(), counts.select(F.col("r").alias("x")).distinct()
    points = lefts.select("x", F.lit(0).alias("kind"), F.col("x").alias("a"), F.lit(None).cast("double").alias("b")).unionByName(rights.select("x", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("a"), F.col("x").alias("b")))
    swept = running(points, [], [F.col("x").desc(), F.col("kind").desc()], day(F.col("x")), {"next_left": ("min", "a"), "next_right": ("min", "b")}, inclusive=False, falling=True)
    support = swept.filter((F.col("kind") == 0) & F.col("next_right").isNotNull() & (F.col("next_left").isNull() | (F.col("next_left") > F.col("next_right"))))
    support = support.select(F.col("x").alias("left"), F.col("next_right").alias("right"), F.lit(1).alias("one"))
    support = written(running(support, [], [F.col("left")], day(F.col("left")), {"j": ("sum", "one")}).drop("one"))

    def places(values: DataFrame, bound: str, inclusive: bool, name: str) -> DataFrame:
        """Each value with the number of support intervals whose bound lies before it (or at it)."""
        own = support.select(F.col(bound).alias("x"), F.lit(1).alias("one"), F.lit(not inclusive).alias("late"))
        both = values.select("x", F.lit(0).alias("one"), F.lit(inclusive).alias("late")).unionByName(own)
        return running(both, [], [F.col("x"), F.col("late")], day(F.col("x")), {name: ("sum", "one")}).filter("one = 0").select("x", name)

    # an interval's run begins behind the support that starts before it and ends with the last that ends within it
    begin, end = places(lefts, "left", False, "u").withColumnRenamed("x", "l"), places(rights, "right", True, "v").withColumnRenamed("x", "r")
    runs = written(counts.join(begin, "l").join(end, "r").groupBy("u", "v").agg(F.sum("n").cast("double").alias("n")))
    m = support.count()
    mass = support.withColumn("mass", F.lit(1.0 / max(1, m)))
    stretch = F.floor(F.col("j") / F.lit(width))
    for _ in range(rounds if m else 0):
        upto = running(mass.select("j", "mass"), [], [F.col("j")], stretch, {"p": ("sum", "mass")}).select("j", "p")
        zero = mass.sparkSession.createDataFrame([(0, 0.0)], "j long, p double")
        upto = written(upto.unionByName(zero))
        held = runs.join(upto.select(F.col("j").alias("u"), F.col("p").alias("pu")), "u").join(upto.select(F.col("j").alias("v"), F.col("p").alias("pv")), "v")
        weight = F.col("n") / F.greatest(F.col("pv") - F.col("pu"), F.lit(1e-300))
        steps = held.select(F.inline(F.array(F.struct((F.col("u") + 1).alias("j"), weight.alias("w")), F.struct((F.col("v") + 1).alias("j"), (-weight).alias("w"))))).groupBy("j").agg(F.sum("w").alias("w"))
        rows = mass.join(steps, "j", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        new = running(rows, [], [F.col("j")], stretch, {"c": ("sum", "w")}).select("left", "right", "j", (F.col("mass") * F.col("c") / total).alias("mass"), F.col("mass").alias("old"))
        new = written(new)
        done = new.agg(F.max(F.abs(F.col("mass") - F.col("old")))).first()[0] < tolerance
        mass = new.drop("old")
        if done:
            break
    return mass


def behaviour(sample: DataFrame, horizons: list[float]) -> DataFrame:
    return survival_at(kaplan_meier(sample), horizons)


def era_split(rows: DataFrame, moment: str, boundary: Column) -> DataFrame:
    from larkspur.operators.metrics import era

    return rows.withColumn("era", era(moment, boundary))


def interval_survival(left: np.ndarray, right: np.ndarray, mass: np.ndarray, horizon: float) -> float | None:
    """S(horizon) of a fitted support: 1 before it, the mean of its bounds inside an interval, null beyond the last finite bound."""
    if not len(mass) or horizon < left[0]:
        return 1.0 if len(mass) else None
    finite = right[np.isfinite(right)]
    if not len(finite) or horizon > finite.max():
        return None
    upper, lower = 1 - mass[right <= horizon].sum(), 1 - mass[left < horizon].sum()
    return float(np.clip((upper + lower) / 2, 0.0, 1.0))


def median_interval(curve: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The median of a curve with its confidence interval: the first times at which survival, its lower and its upper bound reach a half; null where they don't."""
    key = group or []
    at = [F.min(F.when(F.col(c) <= 0.5, F.col("time"))).alias(n) for n, c in (("median_days", "survival"), ("median_low", "ci_low"), ("median_high", "ci_high"))]
    return curve.groupBy(*key).agg(*at) if key else curve.agg(*at)
