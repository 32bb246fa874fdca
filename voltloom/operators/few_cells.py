"""What a few measured cells of a new cohort are worth to a model of the other cohorts.

Every cohort is held out in turn. Of its cells, ``k`` are drawn as reference
cells, many times; each way to use them is scored on the cohort's other cells:

raw          the model of the other cohorts as it is
affine       its predictions with a gain and an offset fitted on the k cells
offset_only  the same with the gain left at one
local_fit    the same kind of model fitted on the k cells alone
pooled       fitted on the other cohorts and the k cells
cell_mean    the mean of the k cells
shuffled     as affine, but fitted on k cells of other cohorts: the control

The rows are read once, into sums per cell. Every way predicts by a linear
model, so its fit and its squared error follow from sums of sums: no model is
refitted from rows, and no table of draws times rows is made. Draws pick cells
by number, so their size depends on cohorts, ``k`` and draws only.

Defined results: rows without a cohort, a cell, the target or a feature take
no part. A cohort with ``k`` cells or fewer has no fold for that ``k``. A way
that cannot be fitted has a null score in that draw and counts in no mean; the
control is null where the other cohorts hold fewer than ``k`` cells. With one
cohort only there is nothing to transfer, and what needs the model is null. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.numbers import computed, draw, text_number
from voltloom.operators.coverage import squared_error
from voltloom.operators.evaluate import Linear, bootstrap_median_ci, coefficients, complete, moment_columns, moment_names
from voltloom.operators.ordered import exact_quantiles, with_ordinal
from voltloom.session import staged

ARMS = ("raw", "affine", "offset_only", "local_fit", "pooled", "cell_mean", "shuffled")
FEW, DRAWS, SEED = (1, 2), 20, 29
#: Predictions whose spread is below this share of their mean square count as constant.
CONSTANT = 1e-12
KEYS = ["cohort", "k", "draw"]
Pick = Callable[[str], Column]


def numbered_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cells`` with their number ``_g`` from 0, cohort after cohort; and (cohort, n_cells, _first, _all) per cohort."""
    sizes = staged(cells.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_cells")))
    before = Window.orderBy("cohort").rowsBetween(Window.unboundedPreceding, -1)  # a row per cohort
    cohorts = staged(sizes.select("cohort", "n_cells", F.coalesce(F.sum("n_cells").over(before), F.lit(0)).alias("_first"),
                                  sizes.agg(F.sum("n_cells")).scalar().alias("_all")))
    code = text_number(F.col("cell_id").cast("string"))
    inside = with_ordinal(cells.withColumn("_h", code), ["cohort"], ["_h", "cell_id"], F.floor(F.col("_h") / 4_194_304), "_i")
    return inside.join(cohorts.select("cohort", "_first"), "cohort").withColumn(
        "_g", F.col("_first") + F.col("_i") - 1).drop("_h", "_i", "_first"), cohorts


def without_repeats(count: Column, of: Column, seed: int, *parts: Column) -> Column:
    """``count`` different numbers from 0 to below ``of``, every set as likely as any other (Floyd's method)."""
    def add(got: Column, last: Column) -> Column:
        at = F.pmod(draw(seed, *parts, last), last + 1)
        return F.concat(got, F.array(F.when(F.array_contains(got, at), last).otherwise(at)))

    return F.when(of >= count, F.aggregate(F.sequence(of - count, of - 1), F.array().cast("array<bigint>"), add))


def drawn_cells(cohorts: DataFrame, few: Sequence[int] = FEW, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(cohort, k, draw, own, _g): k cells of the cohort itself, and k of the other cohorts."""
    plan = cohorts.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in few]))).where("n_cells > k").withColumn(
        "draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))))
    key = (F.col("k"), F.col("draw"), text_number(F.col("cohort").cast("string")))
    first, size, k = F.col("_first"), F.col("n_cells"), F.col("k")
    own = F.transform(without_repeats(k, size, seed, *key), lambda t: t + first)
    other = F.transform(without_repeats(k, F.col("_all") - size, seed + 1, *key), lambda t: F.when(t < first, t).otherwise(t + size))
    both = F.array(F.struct(F.lit(True).alias("own"), own.alias("_cells")), F.struct(F.lit(False).alias("own"), other.alias("_cells")))
    return plan.select(*KEYS, F.inline(both)).select(*KEYS, "own", F.explode("_cells").alias("_g"))


def _recalibration(model: Linear, coef: Column, pick: Pick) -> tuple[Column, Column]:
    """Gain and offset that fit the target best on the predictions of ``coef``, from sums; (1, mean error) for constant ones."""
    width = len(model.features) + 1
    b = [F.get(coef, F.lit(i)) for i in range(width)]
    n, y = pick("_xx0_0"), pick("_xy0")
    p = sum((b[i] * pick(f"_xx0_{i}") for i in range(1, width)), b[0] * n)
    py = sum((b[i] * pick(f"_xy{i}") for i in range(1, width)), b[0] * y)
    pp = F.lit(0.0)
    for i in range(width):
        for j in range(width):
            pp = pp + b[i] * b[j] * pick(f"_xx{min(i, j)}_{max(i, j)}")
    spread = n * pp - p * p
    gain = F.when(spread > CONSTANT * n * pp, (n * py - p * y) / spread).otherwise(1.0)
    return gain, (y - gain * p) / n


def _moved(coef: Column, gain: Column, offset: Column) -> Column:
    return F.transform(coef, lambda b, i: gain * b + F.when(i == 0, offset).otherwise(0.0))


def few_cell_draws(frame: DataFrame, model: Linear, target: str, few: Sequence[int] = FEW, draws: int = DRAWS,
                   seed: int = SEED) -> DataFrame:
    """(cohort, k, draw, n_cells, and R2 against the other cohorts' mean for each of ``ARMS``)."""
    y = F.col(target).cast("double")
    names = ["_yy", *moment_names(model)]
    rows = complete(frame, model, target).where("cohort IS NOT NULL AND cell_id IS NOT NULL")
    cells = staged(rows.groupBy("cohort", "cell_id").agg(F.sum(y * y).alias("_yy"), *moment_columns(model, y)))
    numbered, cohorts = numbered_cells(cells)
    plan = staged(drawn_cells(cohorts, few, draws, seed))
    picked = plan.join(numbered.select("_g", *names), "_g").groupBy(*KEYS, "own").agg(*[F.sum(c).alias(c) for c in names])
    sums = staged(picked)

    def side(own: bool, p: str) -> DataFrame:
        return sums.where(F.col("own") == own).select(*KEYS, *[F.col(c).alias(p + c) for c in names])

    whole = cells.agg(F.struct(*[F.sum(c).alias(c) for c in names]).alias("w")).scalar()
    per_cohort = cells.groupBy("cohort").agg(*[F.sum(c).alias(f"_h{c}") for c in names])
    joined = side(True, "_c").join(side(False, "_f"), KEYS, "left").join(per_cohort, "cohort").join(
        cohorts.select("cohort", "n_cells"), "cohort").withColumns({f"_t{c}": whole[c] - F.col(f"_h{c}") for c in names})
    mine: Pick = lambda c: F.col(f"_c{c}")
    other: Pick = lambda c: F.col(f"_f{c}")
    rest: Pick = lambda c: F.col(f"_t{c}")
    fitted = staged(joined.withColumns({
        "_raw": coefficients(model, rest), "_local": coefficients(model, mine),
        "_pooled": coefficients(model, lambda c: rest(c) + mine(c))}))
    raw = F.col("_raw")
    gains = {}
    for p, pick in (("_c", mine), ("_f", other)):
        gains[f"{p}_gain"], gains[f"{p}_shift"] = _recalibration(model, raw, pick)
    mean = F.try_divide(rest("_xy0"), rest("_xx0_0"))
    level = mine("_xy0") / mine("_xx0_0")
    ahead = sum((F.get(raw, F.lit(i)) * mine(f"_xx0_{i}") for i in range(len(model.features) + 1)), F.lit(0.0))
    # Each step is a table of its own to the optimizer: gains stand in many terms of the errors below.
    told = computed(fitted, gains | {"_plain": level - ahead / mine("_xx0_0"), "_mean": mean, **{
        f"_d{c}": F.col(f"_h{c}") - F.col(f"_c{c}") for c in names}})
    held: Pick = lambda c: F.col(f"_d{c}")
    ways = {"raw": raw, "affine": _moved(raw, F.col("_c_gain"), F.col("_c_shift")),
            "offset_only": _moved(raw, F.lit(1.0), F.col("_plain")), "local_fit": F.col("_local"), "pooled": F.col("_pooled"),
            "cell_mean": F.array(level, *[F.lit(0.0)] * len(model.features)),
            "shuffled": _moved(raw, F.col("_f_gain"), F.col("_f_shift"))}
    m = F.col("_mean")
    ready = computed(told, {f"_b_{arm}": coef for arm, coef in ways.items()} | {
        "_base": held("_yy") - 2.0 * m * held("_xy0") + m * m * held("_xx0_0")})
    return ready.select(*KEYS, "n_cells", *[
        F.when(F.col("_base") > 0, 1.0 - squared_error(model, F.col(f"_b_{arm}"), held) / F.col("_base")).alias(arm) for arm in ways])


def few_cell_calibration(frame: DataFrame, models: Sequence[Linear], target: str, few: Sequence[int] = FEW, draws: int = DRAWS,
                         seed: int = SEED) -> DataFrame:
    """(model, cohort, k, n_cells, mean R2 of each of ``ARMS`` over the draws)."""
    out = None
    for model in models:
        scores = few_cell_draws(frame, model, target, few, draws, seed).groupBy("cohort", "k").agg(
            F.max("n_cells").alias("n_cells"), *[F.avg(a).alias(a) for a in ARMS]).select(F.lit(model.name).alias("model"), "*")
        out = scores if out is None else out.unionByName(scores)
    return out


def few_cell_risk(folds: DataFrame) -> DataFrame:
    """Per arm over all folds: median, tenth percentile, worst, and the shares below 0 and below -1."""
    tall = staged(folds.select(F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("r2")) for a in ARMS]))).where(
        "r2 IS NOT NULL"))
    share = lambda c: F.avg(c.cast("double"))
    return tall.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_folds"), F.min("r2").alias("worst"), share(F.col("r2") < 0).alias("below_zero"),
        share(F.col("r2") < -1).alias("below_minus_one")).join(
        exact_quantiles(tall, ["arm"], "r2", {"median": 0.5, "q10": 0.1}), "arm")


def few_cell_paired(folds: DataFrame, against: Sequence[str] = ("raw", "local_fit", "pooled", "shuffled")) -> DataFrame:
    """Per rival: how often the affine correction is better in the same fold, the median difference with its interval.

    Scores equal to eight decimals are ties: with one feature, the corrected line and the local one are the same line.
    ``verdict`` says whether the interval lies above 0; without an interval (under four folds) it is not told apart.
    """
    name = F.concat_ws("/", "model", "cohort", F.col("k").cast("string"))
    pairs = staged(folds.select(name.alias("fold"), F.inline(F.array(*[
        F.struct(F.lit(a).alias("rival"), F.round(F.col("affine") - F.col(a), 8).alias("gain")) for a in against]))).where("gain IS NOT NULL"))
    counts = pairs.groupBy("rival").agg(F.count_if(F.col("gain") > 0).alias("wins"))
    ci = bootstrap_median_ci(pairs, ["rival"], "gain", "fold")
    return counts.join(exact_quantiles(pairs, ["rival"], "gain", {"median_gain": 0.5}), "rival").join(ci, "rival").withColumn(
        "verdict", F.when(F.col("ci_low") > 0, "better").when(F.col("ci_high") < 0, "worse").otherwise("not told apart"))
