"""Rank tests, resampling, physics fits and thermal checks over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.functions.numbers import DRAW_RANGE, draw, draw_turn, solve_normal, text_number
from voltloom.operators.life import in_cycle_order
from voltloom.operators.ordered import (
    average_ranks, BLOCK_ROWS, exact_quantiles, near_window, spearman, with_ordinal,
)
from voltloom.session import staged

KELVIN, GAS = 273.15, 8.314462618   # fixed values: offset of Celsius, J/(mol K)
EARLY_CYCLES = 20
PRODUCT_BLOCK, PRODUCT_PARTITIONS = 2048, 64


def rank_correlations(frame: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """(keys, feature, n, rho) for several features at once."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_value")) for f in features])
    long = frame.select(*keys, F.col(target).alias("_target"), F.inline(cells))
    return spearman(long, [*keys, "feature"], "_value", "_target")


def cohort_association(frame: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Per (cohort, feature): pooled rho, and how many cells share a positive sign."""
    pooled = rank_correlations(frame, ["cohort"], features, target).withColumnRenamed("rho", "pooled_rho")
    per = rank_correlations(frame, ["cohort", "cell_id"], features, target).where("n >= 3 AND rho IS NOT NULL")
    signs = per.groupBy("cohort", "feature").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("rho") > 0).alias("n_positive"))
    return pooled.join(signs, ["cohort", "feature"], "left")


def mann_whitney(frame: DataFrame, flag: str, value: str = "capacity_loss") -> DataFrame:
    """One-sided rank test of within-cell centred fade, flagged against not.

    Only cells with both kinds of rows count. U comes from summed average
    ranks of counted values, p from the tie-corrected normal limit.
    """
    rows = frame.where(F.col(value).isNotNull()).select("cell_id", F.col(value).alias("_v"), F.col(flag).alias("_f"))
    both = rows.groupBy("cell_id").agg(F.count_if("_f").alias("_a"), F.count_if(~F.col("_f")).alias("_b")).where(
        "_a > 0 AND _b > 0")
    centre = exact_quantiles(rows, ["cell_id"], "_v", {"_mid": 0.5})
    centred = rows.join(both.select("cell_id"), "cell_id").join(centre, "cell_id").select(
        "cell_id", "_f", (F.col("_v") - F.col("_mid")).alias("v"))
    per_value = centred.groupBy("v").agg(F.count_if("_f").alias("_nf"), F.count(F.lit(1)).alias("_w"))
    ranks = average_ranks(per_value, [], "v", "_w").select("v", "n", "avg_rank")
    sums = per_value.join(ranks, "v").agg(
        F.sum(F.col("_nf") * F.col("avg_rank")).alias("_r"), F.sum("_nf").alias("n1"),
        F.sum("n").alias("nn"), F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("_ties"))
    cells = both.agg(F.count(F.lit(1))).scalar()
    n1, nn = F.col("n1").cast("double"), F.col("nn").cast("double")
    n2 = nn - n1
    u = F.col("_r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((nn + 1) - F.col("_ties") / (nn * (nn - 1))))
    out = sums.withColumns({"n_cells": cells, "n_flagged": F.col("n1"), "n_unflagged": n2.cast("bigint"),
                            "u_statistic": u, "z": (u - n1 * n2 / 2 - 0.5) / sd})
    return out.select("n_cells", "n_flagged", "n_unflagged",
                      *[F.when(F.col("n_cells") >= 5, F.col(c)).alias(c) for c in ("u_statistic", "z")],
                      F.when(F.col("n_cells") < 5, "UNDETERMINED").when(F.col("z") > 1.6448536269514722, "ASSOCIATED")
                      .otherwise("NOT_ASSOCIATED").alias("verdict"))


def permutation_test(frame: DataFrame, key: str, x: str, y: str, permutations: int = 5000, seed: int = 11) -> DataFrame:
    """(rho, p, n): share of permutations whose |rho| reaches the observed one.

    The table has one row per battery. A permutation orders the rows by a
    repeatable number and pairs the k-th x with the k-th y; ranks are taken
    once, since a permutation does not change them. The repeatable numbers of
    all permutations have one circular order (``draw_turn``), so rows are
    sorted once and a permutation is the place where its order begins.
    """
    rows = frame.select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(
        "_x IS NOT NULL AND _y IS NOT NULL")
    rx = average_ranks(rows, [], "_x").select(F.col("v").alias("_x"), F.col("avg_rank").alias("_rx"))
    ry = average_ranks(rows, [], "_y").select(F.col("v").alias("_y"), F.col("avg_rank").alias("_ry"))
    coded = rows.join(rx, "_x").join(ry, "_y").withColumns({
        "_all": F.lit(0), "_h": text_number(F.col(key).cast("string"))})
    n = rows.agg(F.count(F.lit(1))).scalar()
    # From the mean rank, so that sums of products stay exact.
    off = lambda c: F.col(c) - (n + 1) / F.lit(2.0)
    ranked = staged(with_ordinal(coded, ["_all"], ["_h", key], F.floor(F.col("_h") / 4_194_304), "_i").select(
        "_all", "_i", off("_rx").alias("_rx"), off("_ry").alias("_ry"), draw_turn(F.col("_i")).alias("_e")))
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    whole = staged(ranked.agg(F.count(F.lit(1)).alias("n"), product("_rx", "_ry").alias("_xy"), F.sqrt(
        product("_rx", "_rx") * product("_ry", "_ry")).alias("_den")).withColumn("rho", F.try_divide("_xy", "_den")))
    sums = _permuted_products(ranked, whole, permutations, seed)
    known = whole.select(F.struct("n", "_den", "rho")).scalar()
    rho = F.try_divide("_xy", known["_den"])
    return sums.agg(
        ((F.count_if(F.abs(rho) >= F.abs(known["rho"]) - 1e-12) + 1) / F.lit(permutations + 1.0)).alias("p_value")).select(
        known["rho"].alias("rho"), "p_value", known["n"].alias("n"))


def _permuted_products(ranked: DataFrame, whole: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(_rep, _xy): the sum of products of each permutation, from blocks of both series.

    Row _p of the circular order meets row (_p - 1 - _w) mod n + 1 of the other series, where _w rows come after
    the place at which a permutation begins. A block of one series and a block of the other meet in many
    permutations; each such pair of blocks is laid out once, with the stretches that the permutations need of it.
    """
    chunk = F.floor(F.col("_e") / 1_048_576)
    base = with_ordinal(ranked.select("_all", "_e", "_rx"), ["_all"], ["_e"], chunk, "_p")
    reps = ranked.sparkSession.range(1, permutations + 1).select(
        F.lit(0).alias("_all"), F.col("id").alias("_rep"), (DRAW_RANGE - draw(seed, F.col("id"), 0)).alias("_e"))
    # How many rows lie below a permutation's border: its place among rows and borders, less that among borders.
    both = reps.unionByName(ranked.select("_all", F.lit(None).cast("bigint").alias("_rep"), "_e"))
    order = ["_e", F.asc_nulls_last("_rep")]
    place = with_ordinal(both, ["_all"], order, chunk, "_at").where("_rep IS NOT NULL").select("_rep", "_at")
    begins = place.join(with_ordinal(reps, ["_all"], order, chunk, "_own").select("_rep", "_own"), "_rep").select(
        "_rep", (F.col("_at") - F.col("_own")).alias("_w"))
    size = F.lit(PRODUCT_BLOCK).cast("bigint")

    def blocks(df: DataFrame, at: str, value: str, block: str, out: str) -> DataFrame:
        # The order of the structs is that of the rows; a block has PRODUCT_BLOCK rows at most.
        series = F.array_sort(F.collect_list(F.struct(at, value)))
        return df.groupBy(F.floor((F.col(at) - 1) / size).alias(block)).agg(series[value].alias(out))

    laid = begins.withColumn("n", whole.select("n").scalar()).where("n > 0").repartition(PRODUCT_PARTITIONS, "_rep")
    laid = laid.withColumn("_xb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / size))))
    start = F.col("_xb") * size
    rows = F.least(size, F.col("n") - start)
    laid = laid.withColumns({"_k": F.pmod(start - F.col("_w"), F.col("n")), "_m": rows}).withColumn(
        "_head", F.least("_m", F.col("n") - F.col("_k")))
    runs = F.array(F.struct(F.lit(0).cast("bigint").alias("o"), F.col("_k").alias("k"), F.col("_head").alias("m")),
                   F.struct(F.col("_head").alias("o"), F.lit(0).cast("bigint").alias("k"), (F.col("_m") - F.col("_head")).alias("m")))
    cut = laid.select("_rep", "_xb", F.inline(runs)).where("m > 0").withColumn(
        "_yb", F.explode(F.sequence(F.floor(F.col("k") / size), F.floor((F.col("k") + F.col("m") - 1) / size))))
    first = F.greatest("k", F.col("_yb") * size)
    until = F.least(F.col("k") + F.col("m"), (F.col("_yb") + 1) * size)
    stretch = F.struct("_rep", (F.col("o") + first - F.col("k")).cast("int").alias("x"),
                       (first - F.col("_yb") * size).cast("int").alias("y"), (until - first).cast("int").alias("m"))
    pairs = cut.groupBy("_xb", "_yb").agg(F.collect_list(stretch).alias("_cuts"))
    met = pairs.join(blocks(base, "_p", "_rx", "_xb", "_xs"), "_xb").join(
        blocks(ranked, "_i", "_ry", "_yb", "_ys"), "_yb").repartition(PRODUCT_PARTITIONS, "_xb", "_yb")
    part = F.transform("_cuts", lambda c: F.struct(c["_rep"].alias("_rep"), F.aggregate(
        F.sequence(F.lit(0), c["m"] - 1), F.lit(0.0),
        lambda total, j: total + F.get(F.col("_xs"), c["x"] + j) * F.get(F.col("_ys"), c["y"] + j)).alias("_part")))
    return met.select(F.inline(part)).groupBy("_rep").agg(F.sum("_part").alias("_xy"))


def arrhenius_fit(frame: DataFrame, keys: Sequence[str] = (), target: str = "cumulative_fade",
                  temperature: str = "avg_temp", smearing: bool = False) -> DataFrame:
    """ln fade = ln A - (Ea/R)/T + z ln N per group, on rows where all three are defined."""
    keys = list(keys)
    t, n, f = F.col(temperature).cast("double"), F.col("cycle").cast("double"), F.col(target).cast("double")
    whole = frame.where(t.isNotNull() & n.isNotNull() & f.isNotNull())
    ok = (f > 0) & (n > 0) & (t + KELVIN > 0)
    logs = whole.where(ok).select(*keys, (1.0 / (t + KELVIN)).alias("a"), F.ln(n).alias("b"), F.ln(f).alias("y"))
    one = F.lit(1.0)
    x = [one, F.col("a"), F.col("b")]
    sums = logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_used"), F.var_pop("y").alias("_vy"), F.sum(F.col("y") * F.col("y")).alias("_yy"),
        *[F.sum(x[i] * x[j]).alias(f"_m{i}{j}") for i in range(3) for j in range(i, 3)],
        *[F.sum(x[i] * F.col("y")).alias(f"_v{i}") for i in range(3)])
    at = lambda i, j: F.col(f"_m{min(i, j)}{max(i, j)}")
    coef = solve_normal(F.array(*[at(i, j) for i in range(3) for j in range(3)]), F.array(*[F.col(f"_v{i}") for i in range(3)]))
    fits = sums.withColumn("_c", F.when(F.col("n_used") >= 4, coef))
    c = [F.get("_c", F.lit(i)) for i in range(3)]
    dropped = whole.groupBy(*keys).agg(F.count_if(~ok).alias("n_dropped"))
    joined = fits.join(dropped, keys) if keys else fits.withColumn("n_dropped", dropped.scalar())
    scored = (logs.join(fits.select(*keys, "_c"), keys) if keys else logs.withColumn("_c", fits.select("_c").scalar()))
    resid = F.col("y") - (c[0] + c[1] * F.col("a") + c[2] * F.col("b"))
    rest = scored.groupBy(*keys).agg(F.sum(resid * resid).alias("_res"), F.avg(F.exp(resid)).alias("_smear"))
    if keys:
        joined = joined.join(rest, keys)
    else:
        pair = rest.select(F.struct("_res", "_smear")).scalar()
        joined = joined.withColumn("_p", pair).withColumns({"_res": F.col("_p._res"), "_smear": F.col("_p._smear")})
    kj = -c[1] * GAS / 1000.0
    total = F.col("_vy") * F.col("n_used")
    return joined.select(
        *keys, "n_used", "n_dropped", c[0].alias("ln_a"), kj.alias("activation_kj_per_mol"), c[2].alias("exponent_z"),
        F.when(total > 0, 1 - F.col("_res") / total).alias("r2_log_space"),
        (F.col("_smear") if smearing else F.when(F.col("_c").isNotNull(), F.lit(1.0))).alias("smearing_factor"),
        F.coalesce(kj.between(20.0, 80.0), F.lit(False)).alias("plausible"))


def thermal_baseline(frame: DataFrame, ambient: str = "ambient_temperature_c", early: int = EARLY_CYCLES) -> DataFrame:
    rows = frame.where((F.col("cycle") <= early) & F.col("soh").isNotNull())
    return rows.groupBy(ambient).agg(
        F.avg("soh").alias("baseline_soh"), F.count_distinct("cell_id").alias("n_cells"),
        F.count(F.lit(1)).alias("n_rows")).withColumns({
            "well_estimated": F.col("n_cells") >= 3,
            "implied_offset_percent": (1.0 - F.col("baseline_soh")) * 100.0})


def thermal_correction(frame: DataFrame, ambient: str = "ambient_temperature_c", early: int = EARLY_CYCLES,
                       horizons: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """soh over its ambient level's early mean; a level without one stays empty."""
    base = thermal_baseline(frame, ambient, early).select(ambient, F.when(
        F.col("baseline_soh") > 0, F.col("baseline_soh")).alias("thermal_offset"))
    out = frame.join(base, ambient, "left").withColumn(
        "soh_corrected", F.col("soh") / F.col("thermal_offset")).withColumn(
        "cumulative_fade_corrected", 1.0 - F.col("soh_corrected"))
    size = BLOCK_ROWS
    ahead = near_window(in_cycle_order(out, size), ["cell_id"], "pos", {
        f"_f{h}": (F.lead("cumulative_fade_corrected", h), None, None) for h in horizons},
        after=max(horizons), size=size)
    return ahead.withColumns({f"horizon_fade_corrected_{h}": F.col(f"_f{h}") - F.col("cumulative_fade_corrected")
                              for h in horizons}).drop("pos", *[f"_f{h}" for h in horizons])


def thermal_confound(frame: DataFrame, ambient: str = "ambient_temperature_c", early: int = EARLY_CYCLES) -> DataFrame:
    """Rank correlation of ambient and SOH, early and overall, and the early spread."""
    rows = frame.where("soh IS NOT NULL")
    first = rows.where(F.col("cycle") <= early)
    rho = lambda d: spearman(d, [], ambient, "soh").select("rho").scalar()
    means = first.groupBy(ambient).agg(F.avg("soh").alias("m"))
    return means.agg(F.count(F.lit(1)).alias("n_levels"), F.when(F.count(F.lit(1)) > 1, F.max("m") - F.min("m"))
                     .alias("early_spread")).withColumns({"early_spearman": rho(first), "overall_spearman": rho(rows)})


def identifiability(frame: DataFrame, ambient: str = "ambient_temperature_c", temperature: str = "avg_temp",
                    early: int = EARLY_CYCLES) -> DataFrame:
    """Can an activation energy be estimated: levels, spread within and between, early SOH spread."""
    levels = frame.agg(F.count_distinct(ambient)).scalar()
    cohorts = frame.groupBy("cohort").agg(F.stddev_pop(temperature).alias("s"), F.avg(temperature).alias("m"))
    means = frame.where((F.col("cycle") <= early) & F.col("soh").isNotNull()).groupBy(ambient).agg(F.avg("soh").alias("m"))
    spread = means.agg(F.max("m") - F.min("m")).scalar()
    out = cohorts.agg(F.avg("s").alias("within_spread"), F.stddev_pop("m").alias("between_spread")).withColumns(
        {"n_levels": levels, "early_soh_spread": spread})
    ratio = F.try_divide(F.col("within_spread"), F.col("between_spread"))
    few, tied = F.col("n_levels") < 3, ~F.coalesce(ratio >= 0.25, F.lit(False))
    offset = F.coalesce(F.col("early_soh_spread") > 0.05, F.lit(False))
    reasons = F.concat_ws("; ", F.when(few, "too few ambient levels"), F.when(tied, "temperature is a label of the protocol"),
                          F.when(offset, "early SOH differs between ambient levels"))
    return out.withColumns({"reasons": reasons, "identifiable": reasons == ""})


def agreement_with_rules(frame: DataFrame, outlier: str, flags: Sequence[str]) -> DataFrame:
    """Precision, recall and rates of an outlier flag against each rule flag."""
    cells = F.array(*[F.struct(F.lit(f).alias("flag"), (F.col(f) > 0).alias("hit")) for f in flags])
    long = frame.select(F.col(outlier).alias("o"), F.inline(cells))
    agg = long.groupBy("flag").agg(
        F.count_if(F.col("o") & F.col("hit")).alias("n_both"), F.count_if("o").alias("n_outlier"),
        F.count_if("hit").alias("n_flag"), F.count(F.lit(1)).alias("n"))
    return agg.withColumns({"precision": F.try_divide(F.col("n_both"), F.col("n_outlier")),
                            "recall": F.try_divide(F.col("n_both"), F.col("n_flag")),
                            "flag_rate": F.col("n_flag") / F.col("n")})


def cluster_flag_profile(frame: DataFrame, label: str, flags: Sequence[str]) -> DataFrame:
    total = frame.agg(F.count(F.lit(1))).scalar()
    agg = frame.groupBy(F.col(label).alias("cluster")).agg(
        *[F.avg(F.col(f).cast("double")).alias(f) for f in flags], F.count(F.lit(1)).alias("n_rows"))
    return agg.withColumn("share", F.col("n_rows") / total)


def kmeans_segments(frame: DataFrame, features: Sequence[str], k: int, seed: int = 7) -> DataFrame:
    """Median-imputed, standardised K-Means; under two clusters every row is -1.

    Spark's scaler divides by the n-1 deviation; scaled distances keep their order.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    if k < 2:
        return frame.withColumn("cluster", F.lit(-1))
    doubles = frame.withColumns({f"_d_{f}": F.col(f).cast("double") for f in features})
    filled = [f"_i_{f}" for f in features]
    pipe = Pipeline(stages=[
        Imputer(strategy="median", inputCols=[f"_d_{f}" for f in features], outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(withMean=True, inputCol="_raw", outputCol="_scaled"),
        KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster")])
    out = pipe.fit(doubles).transform(doubles)
    return out.drop("_raw", "_scaled", *filled, *[f"_d_{f}" for f in features])


def partial_rank_correlation(frame: DataFrame, x: str, y: str, control: str, least: int = 6) -> DataFrame:
    """(n, rho, rho_y_vs_control): rank correlation of x and y without what their ranks owe to the control's.

    Under six rows, or with one value of the control, there is no answer. The
    frame has one row per study or battery.
    """
    rows = frame.select(*(F.col(c).cast("double").alias(a) for c, a in ((x, "_x"), (y, "_y"), (control, "_z")))).where(
        "_x IS NOT NULL AND _y IS NOT NULL AND _z IS NOT NULL")
    ranked = rows
    for c in ("_x", "_y", "_z"):
        ranks = average_ranks(rows, [], c).select(F.col("v").alias(c), F.col("avg_rank").alias(f"_r{c}"))
        ranked = ranked.join(ranks, c)
    ranked = staged(ranked)
    a, b, z = F.col("_r_x"), F.col("_r_y"), F.col("_r_z")
    line = ranked.agg(F.struct(*(f(v, z).alias(n) for v, n, f in (
        (a, "ma", F.regr_slope), (a, "ca", F.regr_intercept), (b, "mb", F.regr_slope), (b, "cb", F.regr_intercept)))).alias("l"))
    # Rounded, so that equal pairs of ranks stay equal.
    left = ranked.withColumn("_l", line.scalar()).select(
        F.round(a - F.col("_l.ca") - F.col("_l.ma") * z, 8).alias("_a"),
        F.round(b - F.col("_l.cb") - F.col("_l.mb") * z, 8).alias("_b"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_z").alias("_levels"))
    enough = (F.col("n") >= least) & (F.col("_levels") >= 2)
    return whole.select(
        "n", F.when(enough, spearman(left, [], "_a", "_b").select("rho").scalar()).alias("rho"),
        F.when(enough, spearman(rows, [], "_z", "_y").select("rho").scalar()).alias("rho_y_vs_control"))
