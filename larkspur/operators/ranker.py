"""A learned order of probes: its training rows from finished runs, the split by time, and whether it beats the order by cost.

runs: run_id, case_id, replay_at, system, action (null if undecided), one per case and system. steps: run_id, step_index, probe_name of executed probes.
evidence: run_id, probe, claim_type, source_quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.running import running
from larkspur.session import written

# Qualities that are counted, and claims that state a publication.
QUALITIES = ("ats_native", "page_structured", "archive", "news", "enrichment")
PUBLISHES = ("first_published", "updated_at", "last_published")
#: What a probe of each tier costs.
TIERS = {"low": 1, "medium": 3, "high": 10}


def probe_order(steps: DataFrame) -> DataFrame:
    """run_id, probe, place: where each probe first stands among the probes that its run executed, from 0."""
    w = Window.partitionBy("run_id").orderBy("step_index")
    return steps.withColumn("place", F.row_number().over(w) - 1).groupBy("run_id", F.col("probe_name").alias("probe")).agg(F.min("place").alias("place"))


def features(order: DataFrame, evidence: DataFrame, costs: dict[str, int]) -> DataFrame:
    """run_id, probe and features of the probes in costs: what their run had as evidence from the probes before them.

    Evidence is counted by probe first; a running sum over a run's few probes gives every prefix, so that no evidence is joined with each candidate.
    """
    has = lambda c: F.max(c.cast("int"))
    said = evidence.groupBy("run_id", "probe").agg(
        F.count(F.lit(1)).alias("n_evidence"), *[F.count_if(F.col("source_quality") == q).alias(f"n_evidence_{q}") for q in QUALITIES],
        has(F.col("claim_type").isin(*PUBLISHES)).alias("has_publish_evidence"), has(F.col("claim_type") == "board_present").alias("has_board_present"), has(F.col("claim_type") == "board_absent").alias("has_board_absent"),
    )
    before = Window.partitionBy("run_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    counts, flags = ["n_evidence", *(f"n_evidence_{q}" for q in QUALITIES)], ["has_publish_evidence", "has_board_present", "has_board_absent"]
    rows = order.join(said, ["run_id", "probe"], "left")
    over = lambda f, c: F.coalesce(f(c).over(before), F.lit(0)).cast("double").alias(c)
    rows = rows.select("run_id", "probe", *[over(F.sum, c) for c in counts], *[over(F.max, c) for c in flags], F.col("place").cast("double").alias("n_probes_before"))
    cost = F.coalesce(*[F.when(F.col("probe") == p, float(c)) for p, c in costs.items()]).alias("probe_cost_points")
    return rows.filter(F.col("probe").isin(*costs)).select("*", cost, *[(F.col("probe") == p).cast("double").alias(f"probe_is_{p}") for p in sorted(costs)])


def labels(runs: DataFrame, order: DataFrame, reference: str = "A") -> DataFrame:
    """run_id (the reference's), probe, label for each probe that the reference ran: 1 if some other system without the probe decided otherwise, and none that ran it did."""
    own = runs.filter(F.col("system") == reference).select("case_id", F.col("run_id").alias("__ref"), F.col("action").alias("__action"))
    asked = own.join(order.select(F.col("run_id").alias("__ref"), F.col("probe")), "__ref")
    others = asked.join(runs.select("case_id", "run_id", "system", "action"), "case_id")
    ran = order.select("run_id", "probe", F.lit(True).alias("__ran"))
    rows = others.join(ran, ["run_id", "probe"], "left").withColumn("__ran", F.coalesce("__ran", F.lit(False)))
    differs = F.coalesce(F.col("action") != F.col("__action"), F.lit(False))
    out = rows.groupBy(F.col("__ref").alias("run_id"), "probe").agg(F.bool_or(differs & ~F.col("__ran") & (F.col("system") != reference)).alias("a"), F.bool_or(differs & F.col("__ran")).alias("b"))
    return out.select("run_id", "probe", (F.col("a") & ~F.col("b")).cast("int").alias("label"))


def training_rows(runs: DataFrame, steps: DataFrame, evidence: DataFrame, costs: dict[str, int], reference: str = "A") -> DataFrame:
    """case_id, replay_at, probe, label and features: a row for each probe of costs that the reference executed."""
    own = runs.filter(F.col("system") == reference).select("run_id", "case_id", "replay_at")
    order = probe_order(steps.join(runs.select("run_id"), "run_id", "left_semi"))
    mine = features(order.join(own.select("run_id"), "run_id", "left_semi"), evidence.join(own.select("run_id"), "run_id", "left_semi"), costs)
    return own.join(mine, "run_id").join(labels(runs, order, reference), ["run_id", "probe"]).drop("run_id")


def temporal_holdout(rows: DataFrame, fraction: float = 0.25, days: float = 30.0) -> DataFrame:
    """rows with holdout: the latest share by replay_at, then case and probe; at least one row, never all. Places are counted in stretches of time: no task sorts all rows."""
    rows = written(rows)
    n = rows.count()
    held = min(max(1, round(n * fraction)), n - 1) if n > 1 else 0
    stretch = F.floor(F.unix_micros("replay_at") / F.lit(int(days * 86_400_000_000)))
    placed = running(rows.withColumn("__one", F.lit(1)), [], [F.col("replay_at"), F.col("case_id"), F.col("probe")], stretch, {"__place": ("sum", "__one")})
    return placed.withColumn("holdout", F.col("__place") > n - held).drop("__one", "__place")


def auc(rows: DataFrame, score: str, label: str = "label", stretch: Column | None = None) -> float | None:
    """The share of pairs of a positive and a negative that the score orders rightly, ties counting half; None if a class is missing. Scores are counted by value, and sums run in stretches of them."""
    counts = rows.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    below = running(counts, [], [F.col(score)], F.floor(F.col(score) * 1000) if stretch is None else stretch, {"__b": ("sum", "n")})
    right, p, n = below.agg(F.sum(F.col("p") * (F.col("__b") - F.col("n") / 2)), F.sum("p"), F.sum("n")).first()
    return None if not p or not n else right / p / n


def by_cost(holdout: DataFrame) -> tuple[float | None, float]:
    """AUC and accuracy of the deterministic order: cheaper probes first, those at least as cheap as the median taken to matter."""
    rows = holdout.withColumn("cheapness", -F.col("probe_cost_points"))
    # as many values as there are costs
    counts = sorted(((r[0], r[1], r[2]) for r in rows.groupBy("cheapness").agg(F.sum("label"), F.count(F.lit(1))).collect()), key=lambda r: r[0])
    n = sum(r[2] for r in counts)

    def at(k: int) -> float:
        for s, _, m in counts:
            if k < m:
                return s
            k -= m
        raise IndexError

    median = (at((n - 1) // 2) + at(n // 2)) / 2
    right = sum(p if s >= median else m - p for s, p, m in counts)
    return auc(rows, "cheapness", stretch=F.floor("cheapness")), right / n


def keep(learned: tuple[float | None, float], deterministic: tuple[float | None, float], least_auc_gain: float = 0.05, least_accuracy_gain: float = 0.0) -> bool:
    """Whether a learned order stays: it must gain enough in AUC and in accuracy."""
    if learned[0] is None or deterministic[0] is None:
        return False
    return learned[0] - deterministic[0] >= least_auc_gain and learned[1] - deterministic[1] >= least_accuracy_gain


def evaluated(rows: DataFrame, fraction: float = 0.25, least_rows: int = 200, c: float = 1.0, iterations: int = 1000) -> DataFrame:
    """One row: status (insufficient_data, degenerate or trained), sizes, shares of label 1, AUC and accuracy of both orders, and keep.

    The learned order is a logistic regression with a penalty of |w|^2 / 2 for c times the summed loss.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = rows.sparkSession
    kind = "status string, rows long, train_rows long, holdout_rows long, positive_rate double, holdout_positive_rate double, learned_auc double, learned_accuracy double, deterministic_auc double, deterministic_accuracy double, keep boolean"
    split = written(temporal_holdout(rows, fraction))
    sums = {r[0]: (r[1], r[2]) for r in split.groupBy("holdout").agg(F.count(F.lit(1)), F.sum("label")).collect()}
    (train, p), (held, q) = sums.get(False, (0, 0)), sums.get(True, (0, 0))
    n = train + held
    share = lambda a, b: a / b if b else None
    if n < least_rows:
        return spark.createDataFrame([("insufficient_data", n, 0, 0, share(p + q, n), None, None, None, None, None, False)], kind)
    base = (n, train, held, share(p + q, n), share(q, held))
    if p in (0, train) or q in (0, held):
        return spark.createDataFrame([("degenerate", *base, None, None, None, None, False)], kind)
    names = [c for c in split.columns if c not in ("case_id", "replay_at", "probe", "label", "holdout")]
    vectors = VectorAssembler(inputCols=names, outputCol="__x").transform(split)
    model = LogisticRegression(featuresCol="__x", labelCol="label", maxIter=iterations, regParam=1 / (c * train), standardization=False, tol=1e-9).fit(vectors.filter("not holdout"))
    scored = written(model.transform(vectors.filter("holdout")).select("label", "probe_cost_points", vector_to_array("probability")[1].alias("score"), "prediction"))
    learned = auc(scored, "score"), scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    deterministic = by_cost(scored)
    return spark.createDataFrame([("trained", *base, *learned, *deterministic, keep(learned, deterministic))], kind)
