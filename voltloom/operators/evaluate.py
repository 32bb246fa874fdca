"""Leave-group-out evaluation of linear models in one pass over the data.

Per group only sums are kept. The training sums of a fold are the sums of all
groups minus its own, so every fold of every linear model is fitted from one
aggregate, and the rows are read once more to score them. The fold axis is a
column, never a driver loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.numbers import draw, solve_normal, text_number
from voltloom.operators.ordered import exact_quantiles, spearman, with_ordinal
from voltloom.session import staged

MIN_TEST_ROWS = 10
MIN_TRAIN_COHORTS = 2
MIN_FOLDS_FOR_CI = 4
RESAMPLES = 2000
DRAW_PARTITIONS, DRAW_BLOCK = 64, 65_536
#: Borders of a median of draws, in square roots of the number of folds.
DRAW_REACH = 6.0


@dataclass(frozen=True)
class Linear:
    """A linear model: named feature expressions (SQL text over the frame's columns)."""

    name: str
    expressions: Mapping[str, str] = field(default_factory=dict)

    @property
    def features(self) -> dict[str, Column]:
        return {n: F.expr(e).cast("double") for n, e in self.expressions.items()}


TRAIN_MEAN = Linear("train_mean")
AGE_LINEAR = Linear("age_linear", {"cycle": "cycle"})
AGE_QUADRATIC = Linear("age_quadratic", {"cycle": "cycle", "cycle2": "CAST(cycle AS DOUBLE) * cycle"})


def ols(name: str, columns: Sequence[str]) -> Linear:
    return Linear(name, {c: c for c in columns})


def moment_columns(model: Linear, y: Column) -> list[Column]:
    """Sums that a least-squares fit needs, as aggregates."""
    x = [F.lit(1.0), *model.features.values()]
    k = len(x)
    out = [F.sum(x[i] * x[j]).alias(f"_xx{i}_{j}") for i in range(k) for j in range(i, k)]
    return out + [F.sum(x[i] * y).alias(f"_xy{i}") for i in range(k)]


def moment_names(model: Linear) -> list[str]:
    k = len(model.features) + 1
    return [f"_xx{i}_{j}" for i in range(k) for j in range(i, k)] + [f"_xy{i}" for i in range(k)]


def coefficients(model: Linear, pick=F.col) -> Column:
    """Coefficients (intercept first) from moment columns.

    One feature is solved in place; more go through a small solver, one row per fit.
    """
    k = len(model.features) + 1
    at = lambda i, j: pick(f"_xx{min(i, j)}_{max(i, j)}")
    if k == 1:
        return F.when(at(0, 0) > 0, F.array(pick("_xy0") / at(0, 0)))
    if k == 2:
        n, sx, sxx, sy, sxy = at(0, 0), at(0, 1), at(1, 1), pick("_xy0"), pick("_xy1")
        slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
        return F.when(slope.isNotNull(), F.array((sy - slope * sx) / n, slope))
    matrix = F.array(*[at(i, j) for i in range(k) for j in range(k)])
    return solve_normal(matrix, F.array(*[pick(f"_xy{i}") for i in range(k)]))


def predicted(model: Linear, coef: str = "_coef") -> Column:
    out = F.get(F.col(coef), F.lit(0))
    for i, x in enumerate(model.features.values(), start=1):
        out = out + F.get(F.col(coef), F.lit(i)) * x
    return out


def complete(frame: DataFrame, model: Linear, target: str) -> DataFrame:
    """Rows where the target and every feature are present."""
    ok = F.col(target).isNotNull()
    for x in model.features.values():
        ok = ok & x.isNotNull()
    return frame.where(ok)


def fold_models(frame: DataFrame, model: Linear, target: str, group: str,
                cohort: str = "cohort") -> DataFrame:
    """One row per group: the model fitted on all other groups, and the fold's admission."""
    y = F.col(target).cast("double")
    per_group = frame.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(y).alias("_ty"), *moment_columns(model, y))
    # A cohort found in one group only is missing from that group's training rows.
    spread = (frame.groupBy(F.col(cohort).alias("_cohort"), F.col(group).alias("_g"))
              .agg(F.count(F.lit(1)).alias("_c"))
              .groupBy("_cohort").agg(F.count(F.lit(1)).alias("_groups"), F.min("_g").alias("_g")))
    lost = spread.where("_groups = 1").groupBy(F.col("_g").alias(group)).agg(
        F.count(F.lit(1)).alias("_lost"))
    names = ["n_test", "_ty", *moment_names(model)]
    whole = per_group.agg(F.struct(*[F.sum(c).alias(c) for c in names]).alias("w")).scalar()
    n_cohorts = spread.agg(F.count(F.lit(1))).scalar()
    joined = per_group.join(lost, group, "left")
    trained = joined.withColumns({f"_tr{c}": whole[c] - F.col(c) for c in names}).withColumn(
        "_cohorts", n_cohorts - F.coalesce("_lost", F.lit(0)))
    coef = coefficients(model, lambda c: F.col(f"_tr{c}"))
    out = trained.withColumn("_coef", coef)
    error = (F.when(F.col("n_test") < MIN_TEST_ROWS, F.concat(
        F.lit("test fold has "), F.col("n_test").cast("string"), F.lit(" rows, below minimum 10")))
        .when(F.col("_cohorts") < MIN_TRAIN_COHORTS, F.concat(
            F.lit("training fold spans "), F.col("_cohorts").cast("string"),
            F.lit(" cohort(s), below minimum 2")))
        .when(F.col("_coef").isNull(), "fit is not determined"))
    return out.select(group, "n_test", F.col("_trn_test").alias("n_train"),
                      F.try_divide(F.col("_tr_ty"), F.col("_trn_test")).alias("_train_mean"),
                      "_coef", error.alias("error"))


def cross_validate(frame: DataFrame, model: Linear, target: str, group: str, split: str,
                   confound: Linear | None = None, cohort: str = "cohort") -> DataFrame:
    """Fold results, one row per held-out group (refused folds keep their reason)."""
    rows = complete(frame, model, target)
    folds = fold_models(rows, model, target, group, cohort)
    if confound is not None:
        base = fold_models(rows, confound, target, group, cohort).select(
            group, F.col("_coef").alias("_base"))
        folds = folds.join(base, group)
    against = predicted(confound, "_base") if confound is not None else F.lit(None).cast("double")
    return score_folds(rows, folds, predicted(model), model.name, target, group, split, against)


def score_folds(rows: DataFrame, folds: DataFrame, prediction: Column, name: str, target: str, group: str, split: str,
                against: Column) -> DataFrame:
    """Fold results from the rows and one row of ``folds`` per group; ``prediction`` uses columns of both."""
    y = F.col(target).cast("double")
    scored = rows.join(folds.where("error IS NULL"), group).withColumn("_pred", prediction)
    err = y - F.col("_pred")
    stats = scored.groupBy(group).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("_res"), F.sum(F.pow(y - F.col("_train_mean"), F.lit(2.0))).alias("_tot"),
        (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)).alias("_own"),
        F.sum(F.pow(y - against, F.lit(2.0))).alias("_age"))
    # Values equal to eight decimals are ties: the last bit of a sum must not rank them.
    near = scored.select(group, F.round("_pred", 8).alias("_p"), F.round(y, 8).alias("_y"))
    rho = spearman(near, [group], "_p", "_y").select(group, F.col("rho").alias("spearman_rho"))

    def r2(base: str) -> Column:
        return F.when(F.col(base) > 0, 1.0 - F.col("_res") / F.col(base))

    return (folds.join(stats, group, "left").join(rho, group, "left").select(
        F.lit(name).alias("model"), F.lit(split).alias("split"),
        F.col(group).cast("string").alias("held_out"), "n_train", "n_test", "mae", "rmse",
        r2("_tot").alias("r2_vs_global_mean"), r2("_own").alias("r2_vs_own_mean_oracle"),
        "spearman_rho", r2("_age").alias("r2_vs_confound_baseline"), "error"))


METRICS = ("r2_vs_global_mean", "r2_vs_own_mean_oracle", "spearman_rho", "mae", "r2_vs_confound_baseline")


def cv_summary(folds: DataFrame) -> DataFrame:
    """Per (model, split): medians over completed folds, share beating the mean."""
    done = folds.where("error IS NULL")
    keys = ["model", "split"]
    out = folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.count_if(F.col("error").isNull()).alias("n_completed"),
        F.avg(F.when(F.col("error").isNull(), (F.coalesce(
            F.col("r2_vs_global_mean") > 0, F.lit(False))).cast("double")))
        .alias("fraction_beating_baseline"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    mid = exact_quantiles(done.select(*keys, F.inline(cells)), [*keys, "metric"], "value", {"mid": 0.5})
    medians = mid.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == m, F.col("mid"))).alias(f"median_{m}") for m in METRICS])
    return out.join(medians, keys, "left")


def promotion_gate(summary: DataFrame, lobo: str = "LOBO", loco: str = "LOCO") -> DataFrame:
    """One row per model: promote or reject, with every reason kept."""
    def side(split: str, p: str) -> DataFrame:
        return summary.where(F.col("split") == split).select("model", *[
            F.col(c).alias(f"{p}_{c}") for c in summary.columns if c not in ("model", "split")])

    both = summary.select("model").distinct().join(side(lobo, "a"), "model", "left").join(
        side(loco, "b"), "model", "left")
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    r2, age = "median_r2_vs_global_mean", "median_r2_vs_confound_baseline"
    no_lobo = F.coalesce(a("n_completed"), F.lit(0)) == 0
    no_loco = F.coalesce(b("n_folds"), F.lit(0)) == 0
    idle_loco = F.coalesce(b("n_completed"), F.lit(0)) == 0
    low_a = ~F.coalesce(a(r2) > 0, F.lit(False))
    low_b = ~F.coalesce(b(r2) > 0, F.lit(False))
    few_b = ~F.coalesce(b("fraction_beating_baseline") >= 0.5, F.lit(False))
    age_a, age_b = F.coalesce(a(age) <= 0, F.lit(False)), F.coalesce(b(age) <= 0, F.lit(False))
    gap = a(r2) - b(r2)
    late = ~no_loco & ~idle_loco
    reject = no_lobo | no_loco | idle_loco | low_a | low_b | few_b | age_a | age_b
    reasons = F.array_compact(F.array(
        F.when(no_lobo, "LOBO produced no completed folds"),
        F.when(~no_lobo & low_a, "LOBO median R2 vs training mean is not above 0"),
        F.when(~no_lobo & no_loco, "No leave-one-cohort-out result supplied"),
        F.when(~no_lobo & ~no_loco & idle_loco, "LOCO produced no completed folds"),
        F.when(~no_lobo & late & low_b, "LOCO median R2 vs training mean is not above 0"),
        F.when(~no_lobo & late & few_b, "fewer than half of the held-out protocols beat the baseline"),
        F.when(~no_lobo & late & age_a, "LOBO does not improve on the age line"),
        F.when(~no_lobo & late & age_b, "LOCO does not improve on the age line"),
        F.when(~no_lobo & late & (gap > 0.1), "NOTE: LOBO exceeds LOCO; skill is concentrated within "
                                              "known protocols"),
        F.when(~reject, "Beats the training-mean baseline out-of-sample on both splits")))
    return both.select(
        "model", (~reject).alias("promote"), F.when(reject, "REJECT").otherwise("PROMOTE").alias("status"),
        reasons.alias("reasons"), a(r2).alias("lobo_median_r2"), b(r2).alias("loco_median_r2"),
        b("fraction_beating_baseline").alias("loco_fraction_beating"), gap.alias("lobo_minus_loco_r2"))


def bootstrap_median_ci(values: DataFrame, keys: Sequence[str], value: str, order: str,
                        confidence: float = 0.95, resamples: int = RESAMPLES, seed: int = 7) -> DataFrame:
    """Percentile interval of the median, resampling whole folds; null under four folds.

    Draws are a fixed function of (seed, replicate, position), so a rerun
    gives the same interval. ``order`` names a unique column that numbers the folds.
    """
    keys = list(keys)
    ok = values.where(F.col(value).isNotNull())
    code = text_number(F.col(order).cast("string"))
    numbered = staged(with_ordinal(ok.select(*keys, order, value).withColumn("_h", code), keys, ["_h", order],
                                   F.floor(F.col("_h") / 4_194_304), "_i").select(
        *keys, "_i", F.col(value).cast("double").alias("_v")))
    sizes = staged(numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds")))
    plan = sizes.where(F.col("n_folds") >= MIN_FOLDS_FOR_CI).withColumn(
        "_rep", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    medians = _drawn_medians(plan, numbered, keys, seed)
    tail = (1.0 - confidence) / 2.0
    ci = exact_quantiles(medians, keys, "_m", {"ci_low": tail, "ci_high": 1.0 - tail})
    return sizes.join(ci, keys, "left")


def _drawn(plan: DataFrame, folds: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """The folds that the replicates of ``plan`` draw, a row per draw.

    The draws stream past the folds, a row per fold, which are the side held
    by a task. The plan is a few thousand rows that become millions, so it is
    laid out over a number of partitions of its own.
    """
    rows = F.lit(DRAW_BLOCK).cast("bigint")
    blocks = plan.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_folds") - 1) / rows))))
    laid = blocks.repartition(DRAW_PARTITIONS, *keys, "_rep", "_block").withColumn("_pos", F.explode(F.sequence(
        F.col("_block") * rows + 1, F.least("n_folds", (F.col("_block") + 1) * rows))))
    pick = 1 + F.pmod(draw(seed, F.col("_rep"), F.col("_pos")), F.col("n_folds"))
    return laid.select(*keys, "_rep", pick.alias("_i")).join(folds.hint("shuffle_hash"), [*keys, "_i"])


def _drawn_medians(plan: DataFrame, numbered: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """(keys, _rep, _m): the exact median of each replicate's draws.

    A median of draws lies near that of the folds, within some sqrt(n) ranks.
    Between two borders around it draws are counted by value, beyond them only
    together; a replicate whose median lies beyond is counted whole.
    """
    one = [*keys, "_rep"]
    buckets = 256
    middle = numbered.groupBy(*keys).agg(
        F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("_b"),
        (F.ceil(DRAW_REACH * buckets / F.sqrt(F.count(F.lit(1)))) + 1).cast("int").alias("_reach"))
    at = lambda i: F.when(i.between(1, buckets - 1), F.get("_b", i - 1))
    borders = middle.select(*keys, at(buckets // 2 - F.col("_reach")).alias("_lo"), at(buckets // 2 + F.col("_reach")).alias("_hi"))
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    placed = staged(numbered.join(borders, keys).withColumn("_side", side).select(
        *keys, "_i", "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_v")))
    counts = _drawn(plan, placed, keys, seed).groupBy(*one, "_side", "_v").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*one)
    ranked = counts.withColumns({
        "_last": F.sum("_n").over(own.orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0)),
        "_at": (F.sum("_n").over(own) - 1) * F.lit(0.5)})
    found = lambda k: F.max(F.when(
        (F.col("_side") == 0) & (F.col("_last") - F.col("_n") < k) & (k <= F.col("_last")), F.col("_v")))
    picked = ranked.groupBy(*one).agg(
        found(F.floor("_at") + 1).alias("_a"), found(F.ceil("_at") + 1).alias("_c"), F.max(F.col("_at") - F.floor("_at")).alias("_f"))
    medians = staged(picked.select(*one, (F.col("_a") + (F.col("_c") - F.col("_a")) * F.col("_f")).alias("_m")))
    beyond = medians.where("_m IS NULL").select(*one)
    if beyond.isEmpty():
        return medians
    whole = exact_quantiles(_drawn(plan.join(beyond, one), numbered, keys, seed), one, "_v", {"_m": 0.5})
    return medians.where("_m IS NOT NULL").unionByName(whole)


def ranked_results(gate: DataFrame, ceiling: DataFrame | None = None) -> DataFrame:
    """Results numbered by status, then by falling LOCO R², empty ones last; one row per model.

    ``ceiling`` is the one-row signal fraction of the target, which no R² can pass.
    """
    order = Window.orderBy("status", F.desc_nulls_last(F.round("loco_median_r2", 9)), "model")  # a row per model
    out = gate.withColumn("place", F.row_number().over(order))
    return out if ceiling is None else out.withColumn("r2_ceiling", ceiling.select("signal_fraction").scalar())


def study_gate(rows: DataFrame, models: Sequence[Linear], target: str) -> DataFrame:
    """The promotion gate of each model from leave-one-battery-out and leave-one-cohort-out folds."""
    folds = None
    for model in models:
        for group, split in (("cell_id", "LOBO"), ("cohort", "LOCO")):
            more = staged(cross_validate(rows, model, target, group, split, AGE_LINEAR))  # a row per fold
            folds = more if folds is None else folds.unionByName(more)
    return promotion_gate(staged(cv_summary(folds)))
