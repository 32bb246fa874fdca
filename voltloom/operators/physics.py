"""Physics models under leave-group-out evaluation.

Fade follows ``A exp(-Ea / (R T)) N^z``: a line in 1/T and ln N for the
logarithm of fade. Per group only sums are kept; the training sums of a fold
are those of all groups minus its own, and the two slopes are solved from
them in expressions, so all folds are fitted in one pass without a Python
worker.

Defined results: rows without fade, temperature or cycle take no part. Rows
whose fade, cycle or absolute temperature is not positive cannot be fitted
(no logarithm) but are scored; where the model says nothing, or a training
fold has under four rows to fit, the prediction is the training mean, as the
model would not be better. A fold whose slopes cannot be told apart
(one temperature, or temperature tied to age) is refused with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.operators.evaluate import TRAIN_MEAN, Linear, complete, fold_models, predicted, score_folds
from voltloom.operators.stats import GAS, KELVIN

LEAST_FITTED = 4
#: 1/T is taken against this temperature, in 1/kK, so that its sums keep their digits.
AROUND_K = 298.15
#: Share of the slopes' determinant under which they are tied.
TIED = 1e-9


def _axes(temperature: str, target: str) -> tuple[Column, Column, Column, Column]:
    """Inverse temperature, log age, log fade; and whether the first two exist."""
    kelvin = F.col(temperature).cast("double") + KELVIN
    cycle, fade = F.col("cycle").cast("double"), F.col(target).cast("double")
    defined = (kelvin > 0) & (cycle > 0)
    a = F.when(defined, 1000.0 / kelvin - 1000.0 / AROUND_K)
    b = F.when(defined, F.ln(cycle))
    y = F.when(defined & (fade > 0), F.ln(fade))
    return a, b, y, defined


def fade_law_folds(rows: DataFrame, target: str, group: str, temperature: str) -> DataFrame:
    """(group, n_used, ln_a, slope_a, exponent_z, activation_kj_per_mol) of the fit on all other groups."""
    a, b, y, _ = _axes(temperature, target)
    used = rows.select(group, a.alias("a"), b.alias("b"), y.alias("y")).where("y IS NOT NULL")
    names = {"n": F.lit(1.0), "a": F.col("a"), "b": F.col("b"), "y": F.col("y"),
             "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b"),
             "ay": F.col("a") * F.col("y"), "by": F.col("b") * F.col("y")}
    own = used.groupBy(group).agg(*[F.sum(c).alias(k) for k, c in names.items()])
    whole = own.agg(F.struct(*[F.sum(k).alias(k) for k in names]).alias("w")).scalar()
    # A group without a row to fit is held out too: its training sums are those of all.
    every = rows.select(group).distinct().join(own, group, "left")
    s = {k: F.coalesce(whole[k], F.lit(0.0)) - F.coalesce(F.col(k), F.lit(0.0)) for k in names}
    sums = every.select(group, *[v.alias(f"s_{k}") for k, v in s.items()])
    n = F.col("s_n")

    def co(i: str, j: str) -> Column:
        return F.col(f"s_{min(i, j)}{max(i, j)}") - F.try_divide(F.col(f"s_{i}") * F.col(f"s_{j}"), n)

    moved = sums.select("*", *[co(i, j).alias(f"c_{i}{j}") for i, j in (("a", "a"), ("b", "b"), ("a", "b"), ("a", "y"), ("b", "y"))])
    det = F.col("c_aa") * F.col("c_bb") - F.col("c_ab") * F.col("c_ab")
    fits = moved.withColumn("_det", F.when(
        (n >= LEAST_FITTED) & (det > TIED * F.col("c_aa") * F.col("c_bb")) & (F.col("c_aa") > 1e-12 * n), det))
    slope = (F.col("c_ay") * F.col("c_bb") - F.col("c_by") * F.col("c_ab")) / F.col("_det")
    z = (F.col("c_by") * F.col("c_aa") - F.col("c_ay") * F.col("c_ab")) / F.col("_det")
    return fits.select(
        group, n.alias("n_used"), slope.alias("slope_a"), z.alias("exponent_z"),
        F.try_divide(F.col("s_y") - slope * F.col("s_a") - z * F.col("s_b"), n).alias("ln_a"),
        (-slope * GAS).alias("activation_kj_per_mol"))


def cross_validate_fade_law(frame: DataFrame, target: str, group: str, split: str, temperature: str = "avg_temp",
                            confound: Linear | None = None, cohort: str = "cohort") -> DataFrame:
    """Fold results of the fade law on one temperature column, with n_used and the fold's activation energy."""
    name = f"arrhenius_{temperature}"
    rows = complete(frame, Linear(name, {"temperature": temperature, "cycle": "cycle"}), target)
    law = fade_law_folds(rows, target, group, temperature)
    folds = fold_models(rows, TRAIN_MEAN, target, group, cohort).join(law, group)
    # Under four rows there is no fit to refuse: the mean stands in.
    tied = F.col("ln_a").isNull() & (F.col("n_used") >= LEAST_FITTED)
    folds = folds.withColumn("error", F.coalesce("error", F.when(tied, "fit is not determined")))
    against = F.lit(None).cast("double")
    if confound is not None:
        folds = folds.join(fold_models(rows, confound, target, group, cohort).select(group, F.col("_coef").alias("_base")), group)
        against = predicted(confound, "_base")
    a, b, _, _ = _axes(temperature, target)
    said = F.exp(F.col("ln_a") + F.col("slope_a") * a + F.col("exponent_z") * b)
    prediction = F.when(said.isNotNull() & ~F.isnan(said) & (said < float("inf")), said).otherwise(F.col("_train_mean"))
    out = score_folds(rows, folds, prediction, name, target, group, split, against)
    extra = law.select(F.col(group).cast("string").alias("held_out"), "n_used", "activation_kj_per_mol")
    return out.join(extra, "held_out")
