"""Additive battery scores: risk, health index, ageing-factor life, exact attribution.

One term table feeds the scores, their attribution and the reachability audit,
so an explanation cannot drift from the score it explains.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """Points as a step function of one summary column."""

    name: str
    feature: str
    label: str
    steps: tuple[tuple[float, float], ...] = ()   # (cut, points), highest cut first
    floor: float = 0.0
    inclusive: bool = False
    outside: tuple[float, float, float] | None = None   # (low, high, points)

    def points(self, x: Column) -> Column:
        if self.outside:
            low, high, points = self.outside
            return F.when((x > high) | (x < low), F.lit(points)).otherwise(F.lit(0.0))
        out = None
        for cut, points in self.steps:
            hit = (x >= cut) if self.inclusive else (x > cut)
            out = F.when(hit, F.lit(points)) if out is None else out.when(hit, F.lit(points))
        return out.otherwise(F.lit(self.floor))

    @property
    def column(self) -> Column:
        return self.points(F.col(self.feature))

    @property
    def levels(self) -> tuple[float, ...]:
        if self.outside:
            return (0.0, self.outside[2])
        return tuple(sorted({self.floor, *(p for _, p in self.steps)}))


# Cut points and points of both scores. The risk score counts a
# value on a cut point, the health score does not.
_BANDS = (
    ("stress", "avg_stress", "sustained high stress", ((70, 30.0), (50, 20.0)), 10.0),
    ("temperature", "avg_temp", "high temperature exposure", ((40, 25.0), (30, 15.0)), 5.0),
    ("deep_discharge", "deep_discharge_duration", "deep discharge events",
     ((100, 20.0), (20, 10.0)), 5.0),
    ("fast_charge", "fast_charge_duration", "frequent fast charging", ((100, 15.0), (20, 8.0)), 2.0),
    ("aggressive_discharge", "aggressive_discharge_count", "aggressive discharge",
     ((500, 15.0), (100, 8.0)), 2.0),
)


def _terms(inclusive: bool) -> tuple[Term, ...]:
    banded = tuple(Term(n, f, lab, steps, floor, inclusive) for n, f, lab, steps, floor in _BANDS)
    return banded + (Term("soc_extremes", "avg_soc", "SOC held at extremes",
                          outside=(20.0, 80.0, 10.0)),)


RISK_TERMS = _terms(inclusive=True)
HEALTH_TERMS = _terms(inclusive=False)
FEATURES = tuple(t.feature for t in RISK_TERMS)

# The battery that raises no penalty.
IDEAL = {"avg_stress": 0.0, "avg_temp": 25.0, "deep_discharge_duration": 0.0,
         "fast_charge_duration": 0.0, "aggressive_discharge_count": 0.0, "avg_soc": 50.0}


def total_points(terms: Sequence[Term]) -> Column:
    return sum((t.column for t in terms), F.lit(0.0))


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def guarded(df: DataFrame, needed: Sequence[str], on_null: str = "raise") -> tuple[DataFrame, Column]:
    """The frame and the condition under which a row may be scored.

    A comparison with a missing value would quietly give the lowest score.
    ``raise`` stops the job at the first such row; ``refuse`` keeps the job and
    leaves that battery without a score, with the reason in ``refusal``.
    """
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns {absent}")
    empty = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in needed])
    text = F.concat(F.lit("missing values in "), empty)
    complete = empty == ""
    if on_null == "raise":
        ok = F.when(complete, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
        return df, ok
    if on_null != "refuse":
        raise ValueError("on_null is 'raise' or 'refuse'")
    kept = F.coalesce(F.col("refusal"), F.lit("")) if "refusal" in df.columns else F.lit("")
    return df.withColumn("refusal", F.when(complete, kept).otherwise(text)), complete


def risk_level(score: Column) -> Column:
    return (F.when(score > 79, "CRITICAL").when(score > 59, "HIGH")
            .when(score > 39, "MEDIUM").when(score.isNotNull(), "LOW"))


# Reason texts with their conditions, and the action per level.
def _risk_reasons() -> list[tuple[Column, str]]:
    c = F.col
    return [
        (c("avg_stress") > 50, "high stress"),
        (c("avg_temp") > 30, "high temperature"),
        (c("deep_discharge_duration") > 20, "deep discharge"),
        (c("fast_charge_duration") > 20, "frequent fast charging"),
        (c("aggressive_discharge_count") > 100, "aggressive discharge"),
        (c("avg_soc") > 80, "high SOC exposure"),
        (c("avg_soc") < 20, "low SOC exposure"),
    ]


RISK_ACTIONS = {
    "CRITICAL": "Immediate inspection recommended. Avoid fast charging and maintain 20-80 SOC.",
    "HIGH": "Reduce fast charging frequency and follow 20-80 charging rule.",
    "MEDIUM": "Avoid deep discharge and prolonged high SOC exposure.",
    "LOW": "Battery behavior is healthy.",
}


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A fixed text table as an expression (no join)."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def risk_assessment(summary: DataFrame, on_null: str = "raise") -> DataFrame:
    df, ok = guarded(summary, FEATURES, on_null)
    score = F.when(ok, _clip(total_points(RISK_TERMS), 0.0, 100.0))
    reasons = F.concat_ws(", ", *[F.when(cond, F.lit(text)) for cond, text in _risk_reasons()])
    out = df.withColumn("risk_score", score)
    level = risk_level(F.col("risk_score"))
    return out.withColumns({
        "risk_level": level,
        "risk_reason": F.when(F.col("risk_score").isNotNull(),
                              F.when(reasons == "", "healthy usage").otherwise(reasons)),
    }).withColumn("recommended_action", lookup(F.col("risk_level"), RISK_ACTIONS))


def health_state(index: Column) -> Column:
    return (F.when(index >= 80, "CRITICAL").when(index >= 60, "DEGRADED")
            .when(index >= 30, "WARNING").when(index.isNotNull(), "HEALTHY"))


def health_index(summary: DataFrame, on_null: str = "raise") -> DataFrame:
    """Ageing budget 0-100 left, and its complement: a high index is worse."""
    df, ok = guarded(summary, FEATURES, on_null)
    budget = F.when(ok, _clip(100.0 - total_points(HEALTH_TERMS), 0.0, 100.0))
    return df.withColumn("aging_budget", budget).withColumns({
        "health_index": 100.0 - F.col("aging_budget"),
        "remaining_health": F.col("aging_budget"),
        "consumed_life": 100.0 - F.col("aging_budget"),
    }).withColumn("battery_state", health_state(F.col("health_index")))


def replacement_policy(cycles: Column) -> Column:
    return (F.when(cycles < 100, "REPLACE").when(cycles < 300, "PLAN_SERVICE")
            .when(cycles < 600, "MONITOR").when(cycles.isNotNull(), "NORMAL"))


def ageing_factor_life(batteries: DataFrame, scope: str = "fleet", base_cycles: float = 1000.0,
                       weights: tuple[float, float, float, float] = (0.40, 0.25, 0.20, 0.15),
                       ) -> DataFrame:
    """Remaining cycles from a weighted ageing factor.

    The two event counts are relative to the largest in the ``fleet`` (one
    small aggregate used as a scalar), or to the battery's own count.
    """
    dd, fc = F.col("deep_discharge_duration"), F.col("fast_charge_duration")
    if scope == "fleet":
        top = batteries.agg(F.max(dd).alias("dd"), F.max(fc).alias("fc"))
        dd_max = top.select("dd").scalar()
        fc_max = top.select("fc").scalar()
    else:
        dd_max, fc_max = dd, fc
    dd_max = F.when(F.coalesce(dd_max, F.lit(0)) == 0, F.lit(1)).otherwise(dd_max)
    fc_max = F.when(F.coalesce(fc_max, F.lit(0)) == 0, F.lit(1)).otherwise(fc_max)
    wh, wt, wd, wf = weights
    factor = (wh * (F.col("health_index") / 100) + wt * (F.col("avg_temp") / 50)
              + wd * (dd / dd_max) + wf * (fc / fc_max))
    out = batteries.withColumn(
        "equivalent_aging_factor", F.when(factor.isNotNull(), _clip(factor, 0.05, 1.0)))
    out = out.withColumn("estimated_total_cycles", base_cycles / F.col("equivalent_aging_factor"))
    cycles = F.bround(F.col("estimated_total_cycles") * F.col("remaining_health") / 100, 0)
    out = out.withColumn("rul_cycles", cycles.cast("bigint"))
    return out.withColumns({
        "replacement_policy": replacement_policy(F.col("rul_cycles")),
        "rul_method": F.lit("eaf_heuristic_unvalidated"),
        "rul_validated": F.lit(False),
    })


def shapley(df: DataFrame, terms: Sequence[Term], prefix: str = "",
            reference: str = "fleet") -> DataFrame:
    """Exact Shapley value of every term: points minus the reference's points.

    A fleet of one battery has no mean to compare with and falls back to the
    ideal battery; ``<prefix>attribution_reference`` says which was used.
    """
    ideal = {t.name: t.points(F.lit(IDEAL[t.feature])) for t in terms}
    if reference == "ideal":
        ref, used = ideal, F.lit("ideal")
    elif reference == "fleet":
        means = df.agg(F.struct(
            F.count(F.lit(1)).alias("n"), *[F.avg(t.column).alias(t.name) for t in terms]
        ).alias("m"))
        fleet = means.scalar()
        several = fleet["n"] >= 2
        ref = {t.name: F.when(several, fleet[t.name]).otherwise(ideal[t.name]) for t in terms}
        used = F.when(several, F.lit("fleet")).otherwise(F.lit("ideal"))
    else:
        raise ValueError("reference is 'fleet' or 'ideal'")
    return df.withColumns({
        **{f"{prefix}shap_{t.name}": t.column - ref[t.name] for t in terms},
        f"{prefix}attribution_reference": used,
    })


def efficiency_gap(df: DataFrame, terms: Sequence[Term], prefix: str = "",
                   reference: str = "fleet") -> DataFrame:
    """One row: the largest |sum(phi) - (score - E[score])|, which must be ~0."""
    explained = shapley(df, terms, prefix, reference)
    raw = total_points(terms)
    if reference == "fleet":
        base = df.agg(F.avg(raw).alias("m")).scalar()
    else:
        base = sum((t.points(F.lit(IDEAL[t.feature])) for t in terms), F.lit(0.0))
    total = sum((F.col(f"{prefix}shap_{t.name}") for t in terms), F.lit(0.0))
    return explained.agg(F.max(F.abs(total - (raw - base))).alias("worst_gap"),
                         F.count(F.lit(1)).alias("n"))


def rank_causes(df: DataFrame, terms: Sequence[Term], prefix: str = "", top: int = 3,
                floor: float = 0.5) -> DataFrame:
    """Named causes from Shapley columns: drivers above, protectors below the floor."""
    entries = F.array(*[
        F.struct((-F.col(f"{prefix}shap_{t.name}")).alias("minus"), F.lit(i).alias("i"),
                 F.lit(t.label).alias("label"), F.col(f"{prefix}shap_{t.name}").alias("phi"))
        for i, t in enumerate(terms)])
    drivers = F.array_sort(F.filter(entries, lambda e: e["phi"] > floor))
    guards = F.array_sort(F.transform(
        F.filter(entries, lambda e: e["phi"] < -floor),
        lambda e: F.struct(e["phi"].alias("phi"), e["i"].alias("i"), e["label"].alias("label"))))
    out = df.withColumns({"_drivers": drivers, "_guards": guards})
    best = F.slice("_drivers", 1, top)
    some = F.size("_drivers") > 0
    amounts = F.transform(best, lambda e: F.format_string("%s +%.1f", e["label"], F.bround(e["phi"], 1)))
    return out.withColumns({
        f"{prefix}top_causes": F.when(some, F.array_join(F.transform(best, lambda e: e["label"]), ", "))
        .otherwise("normal usage"),
        f"{prefix}top_cause_contributions": F.when(some, F.array_join(amounts, ", "))
        .otherwise("no term above attribution floor"),
        f"{prefix}dominant_cause": F.when(some, F.get("_drivers", F.lit(0))["label"])
        .otherwise("normal usage"),
        f"{prefix}dominant_contribution": F.when(some, F.get("_drivers", F.lit(0))["phi"])
        .otherwise(F.lit(0.0)),
        f"{prefix}strongest_protective_factor": F.when(
            F.size("_guards") > 0, F.get("_guards", F.lit(0))["label"]).otherwise("none"),
        f"{prefix}n_significant_drivers": F.size("_drivers"),
    }).drop("_drivers", "_guards")


def threshold_reachability(df: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """Per term: which of its levels the data ever reaches.

    ACTIVE when all levels occur, PARTIAL when some do, DEGENERATE when one does.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(t.name).alias("term"), F.lit(t.feature).alias("feature"),
                 F.array(*[F.lit(v) for v in t.levels]).alias("possible"),
                 t.column.alias("points")) for t in terms])))
    by_level = long.groupBy("term", "feature", "possible", "points").agg(
        F.count(F.lit(1)).alias("n"))
    stats = by_level.groupBy("term", "feature", "possible").agg(
        F.sum("n").alias("n_rows"), F.array_sort(F.collect_set("points")).alias("observed"),
        F.max(F.struct(F.col("n"), (-F.col("points")).alias("m"))).alias("top"),
        F.sum(F.col("n") * F.col("points")).alias("s1"),
        F.sum(F.col("n") * F.col("points") ** 2).alias("s2"))
    n = F.col("n_rows")
    spread = F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / n)
    var = F.when(n > 1, F.try_divide(spread, n - 1))
    seen, possible = F.size("observed"), F.size("possible")
    return stats.select(
        "term", "feature", possible.alias("n_possible"), seen.alias("n_observed"),
        F.array_join(F.transform(F.array_except("possible", "observed"),
                                 lambda v: F.format_string("%.0f", v)), ", ").alias("never_reached"),
        (-F.col("top.m")).alias("modal_points"), (F.col("top.n") / n).alias("modal_share"),
        F.sqrt(var).alias("points_std"),
        F.when(seen == 1, "DEGENERATE").when(seen < possible, "PARTIAL")
        .otherwise("ACTIVE").alias("status"))
