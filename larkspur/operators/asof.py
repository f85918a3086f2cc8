"""Point-in-time views, evaluation grids, case planning and splits. As-of is a function of a DataFrame, not a state of the session."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import grid, hash_fraction, stable_key
from larkspur.operators.running import running


def as_of(rows: DataFrame, stamp: str, moment: Column) -> DataFrame:
    """Rows that were available at the moment, inclusive."""
    return rows.filter(F.col(stamp) <= moment)


def at_each(cases: DataFrame, rows: DataFrame, key: list[str], stamp: str, moment: str = "replay_at") -> DataFrame:
    """Every case with the rows of its key available at its moment: all moments in one pass."""
    return cases.join(rows, key).filter(F.col(stamp) <= F.col(moment))


def latest_at_each(cases: DataFrame, rows: DataFrame, key: list[str], stamp: str, values: list[str], moment: str = "replay_at") -> DataFrame:
    """As-of join: every case with the latest row of its key at its moment, or nulls.

    Cases and rows are merged in one sorted window, so that a key with many rows isn't multiplied by its cases.
    """
    order = [F.col("__at"), F.col("__case")]
    left = cases.withColumn("__at", F.col(moment)).withColumn("__case", F.lit(1))
    right = rows.select(*key, F.col(stamp).alias("__at"), F.struct(F.col(stamp), *values).alias("__row")).withColumn("__case", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__row", ignorenulls=True).over(w)).filter("__case = 1")
    return found.select(*cases.columns, F.col(f"__last.{stamp}").alias(f"{stamp}_at"), *[F.col(f"__last.{v}").alias(v) for v in values])


def cases(postings: DataFrame, end: Column, step_days: int = 30) -> DataFrame:
    """The grid of cases: each posting from its first sighting to its end, every step_days days."""
    return postings.withColumn("replay_at", F.explode(grid("first_observed", F.least(end, F.coalesce("first_seen_absent", end)), step_days)))


def round_robin(postings: DataFrame, company: str, key: str, seed: int) -> DataFrame:
    """The order in which companies take turns: each one's postings in hash order, larger companies first within a turn."""
    own = Window.partitionBy(company)
    rows = postings.withColumn("h", hash_fraction(seed, key)).withColumn("company_size", F.count("*").over(own))
    return rows.withColumn("turn", F.row_number().over(own.orderBy("h", key))).drop("h")


def temporal_split(moment: Column | str, cutoff: Column, validation_cutoff: Column | None = None) -> Column:
    """test from the cutoff on, validation from the validation cutoff on, dev before."""
    m = F.col(moment) if isinstance(moment, str) else moment
    out = F.when(m >= cutoff, "test")
    return (out if validation_cutoff is None else out.when(m >= validation_cutoff, "validation")).otherwise("dev")


def stable_split(seed: int, key: Column | str, fractions: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> Column:
    """dev, validation or test by a hash of the key: adding keys moves none."""
    x = hash_fraction(seed, key)
    return F.when(x < fractions[0], "dev").when(x < fractions[0] + fractions[1], "validation").otherwise("test")


def dealt(deficits: dict[str, Fraction], size: int, count: int) -> list[tuple[int, list[str]]]:
    """Where count equal items of a size go, each to the split furthest below its target (of equal ones the first): blocks of (items dealt before, splits that take turns). deficits are updated.

    A split's deficits before its own items fall by size, so the items go to the merge of a few arithmetic progressions of one step: level by level, and
    within a level to the splits that reach it, in order of what is left over.
    """
    if not size:
        return [(0, [max(deficits, key=lambda s: deficits[s])])]
    level = {s: d // size for s, d in deficits.items()}
    order = sorted(deficits, key=lambda s: -(deficits[s] - level[s] * size))
    blocks, taken, steps = [], 0, sorted(set(level.values()), reverse=True)
    for top, below in zip(steps, [*steps[1:], None], strict=True):
        turn = [s for s in order if level[s] >= top]
        n = count - taken if below is None else min(count - taken, len(turn) * (top - below))
        if n:
            blocks.append((taken, turn))
        for i, s in enumerate(turn):
            deficits[s] -= size * (n // len(turn) + (i < n % len(turn)))
        taken += n
    return blocks


def greedy_split(sizes: DataFrame, key: str, size: str, fractions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Keys by falling size, ties in the seed's stable order, each to the split furthest below its target: key, split.

    sizes has a row per key. Every choice depends on all before it, but keys of one size differ in their rank alone. So the driver walks over the distinct sizes
    with their counts (fewer than the root of twice the summed sizes) and finds by arithmetic how each run of equal sizes is dealt; keys
    look their split up by size and rank. Ranks are counted in stretches of the stable order, so a size that most keys share is no hot key.
    """
    fractions = fractions or {"dev": 0.6, "validation": 0.2, "test": 0.2}
    spark = sizes.sparkSession
    runs = sorted(((int(r[0]), r[1]) for r in sizes.groupBy(size).count().collect()), reverse=True)
    total = sum(s * n for s, n in runs)
    deficits = {name: Fraction(f * total) for name, f in fractions.items()}
    blocks = []
    for s, n in runs:
        found = dealt(deficits, s, n)
        blocks += [(s, start, end, turn) for (start, turn), end in zip(found, [*(f[0] for f in found[1:]), n], strict=True)]
    table = spark.createDataFrame(blocks, "__size long, __start long, __end long, __turn array<string>")
    rows = sizes.select(key, F.col(size).alias("__n"), stable_key(seed, key).alias("__order"), F.lit(1).alias("__one"))
    rows = running(rows, ["__n"], [F.col("__order"), F.col(key)], F.conv(F.substring("__order", 1, 3), 16, 10).cast("int"), {"__place": ("sum", "__one")})
    # a few rows for each distinct size
    rows = rows.join(F.broadcast(table), F.col("__n") == F.col("__size")).filter((F.col("__place") > F.col("__start")) & (F.col("__place") <= F.col("__end")))
    return rows.select(key, F.get("__turn", ((F.col("__place") - F.col("__start") - 1) % F.size("__turn")).cast("int")).alias("split"))


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def holdout_breach(dataset_cases: DataFrame, test_companies: DataFrame) -> DataFrame:
    """Cases per held-out company that a dataset uses all the same."""
    return dataset_cases.join(test_companies.select("company_id").distinct(), "company_id", "left_semi").groupBy("company_id").agg(F.count("*").alias("cases"))


def remaining(cases_: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Resume: the cases without a completed run."""
    return cases_.join(done.select(*key).distinct(), key, "left_anti")
