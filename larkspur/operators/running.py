"""Running aggregates over an order without one task a key.

Rows of a key are cut into stretches of its order. Windows run within a stretch; what earlier stretches hold comes from one row a
stretch, of which a key has as many as its span has stretches. So a key with a third of all rows is spread over its stretches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a kind of aggregate takes up values, and how it joins two results.
KINDS: dict[str, tuple[Callable[[str], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(rows: DataFrame, key: list[str], order: list[Column], stretch: Column, values: dict[str, tuple[str, str]], inclusive: bool = True, falling: bool = False) -> DataFrame:
    """rows with a column for each of values (name: (kind, column)): the aggregate over the key's rows up to this one.

    order is total within a stretch, and stretch (not null) rises with it. falling: order and stretch are those of falling order.
    """
    rows = rows.withColumn("__stretch", F.negate(stretch) if falling else stretch)
    parts = rows.groupBy(*key, "__stretch").agg(*[KINDS[kind][0](c).alias(f"__{n}") for n, (kind, c) in values.items()])
    past = Window.partitionBy(*key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(key)], F.col("__stretch").alias("__s"), *[KINDS[kind][0](f"__{n}").over(past).alias(f"__before_{n}") for n, (kind, _) in values.items()])
    own = Window.partitionBy(*key, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.select("*", *[KINDS[kind][0](c).over(own).alias(f"__own_{n}") for n, (kind, c) in values.items()])
    same = F.col("__stretch") == F.col("__s")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    out = out.join(before, same)
    return out.select(*[c for c in rows.columns if c != "__stretch"], *[KINDS[kind][1](F.col(f"__own_{n}"), F.col(f"__before_{n}")).alias(n) for n, (kind, _) in values.items()])


def at_moments(cases: DataFrame, rows: DataFrame, key: list[str], stamp: str, values: dict[str, tuple[str, Column]], moment: str = "replay_at", days: float = 30.0) -> DataFrame:
    """cases with an aggregate for each of values over the rows of their key with stamp at or before their moment. Cases without a moment or a key get nulls (sums: 0)."""
    known = F.col(moment).isNotNull()
    for k in key:
        known = known & F.col(k).isNotNull()
    left = cases.filter(known).withColumn("__at", F.col(moment).cast("timestamp")).withColumn("__case", F.lit(1))
    right = rows.filter(F.col(stamp).isNotNull()).select(*key, F.col(stamp).cast("timestamp").alias("__at"), F.lit(0).alias("__case"), *[v.alias(f"__v_{n}") for n, (_, v) in values.items()])
    both = left.unionByName(right, allowMissingColumns=True)
    stretch = F.floor(F.unix_micros("__at") / F.lit(int(days * 86_400_000_000)))
    found = running(both, key, [F.col("__at"), F.col("__case")], stretch, {n: (kind, f"__v_{n}") for n, (kind, _) in values.items()}).filter("__case = 1")
    found = found.select(*cases.columns, *values)
    rest = cases.filter(~known)
    for n, (kind, _) in values.items():
        rest = rest.withColumn(n, F.lit(0 if kind == "sum" else None).cast(found.schema[n].dataType))
    return found.unionByName(rest)


def newest(rows: DataFrame, key: list[str], order: str, stretch: Column, value: Column, k: int, name: str = "newest") -> DataFrame:
    """rows with an array of the last k values of their key up to each, the latest first. order is a column that tells rows of a key apart; stretch rises with it.

    Arrays of k merge like other aggregates: a stretch hands on its last k, and k stretches before are enough to fill an array.
    """
    rows = rows.withColumn("__stretch", stretch).withColumn("__value", value)
    own = Window.partitionBy(*key, "__stretch").orderBy(order).rowsBetween(-(k - 1), 0)
    rows = rows.withColumn("__own", F.collect_list("__value").over(own))
    tails = rows.groupBy(*key, "__stretch").agg(F.max_by("__own", order).alias("__tail"))
    past = Window.partitionBy(*key).orderBy("__stretch").rowsBetween(-k, -1)
    before = tails.select(*[F.col(c).alias(f"__k_{i}") for i, c in enumerate(key)], F.col("__stretch").alias("__s"), F.flatten(F.collect_list("__tail").over(past)).alias("__before"))
    same = F.col("__stretch") == F.col("__s")
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{i}"))
    out = rows.join(before, same)
    both = F.slice(F.reverse(F.concat("__before", "__own")), 1, k)
    return out.select(*[c for c in rows.columns if c not in ("__stretch", "__value", "__own")], both.alias(name))


def quantile(rows: DataFrame, value: str, share: float, stretch: Column) -> float | None:
    """The exact quantile of a numeric column, interpolated between neighbours; null values don't count, and without values there is none.

    Values are counted first, and ranks run in stretches of them (stretch rises with value), so no task and no buffer holds all values: the driver gets two.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts.withColumn("at", stretch), [], [F.col("value")], F.col("at"), {"upto": ("sum", "n")})
    total = rows.agg(F.count(value)).first()[0]
    if not total:
        return None
    at = share * (total - 1)
    low = int(at)
    near = placed.filter((F.col("upto") > low) & (F.col("upto") - F.col("n") <= min(low + 1, total - 1))).select("value", "upto", "n").collect()
    of = lambda k: next(r["value"] for r in near if r["upto"] - r["n"] <= k < r["upto"])
    a, b = of(low), of(min(low + 1, total - 1))
    return a + (b - a) * (at - low)
