"""What one battery's owner is told: what is known, how surely, and why not more.

All tables here have one row per battery (or a few), built from the phase,
state-of-health, life and score tables. Only ``log_facts`` reads samples, as
one partial aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.curves import first_rows
from voltloom.operators.ordered import exact_quantiles
from voltloom.operators.phases import CELL
from voltloom.operators.soh import state_from_soh

# Channels, the stages that need them, conditions, confidence limits.
CHANNELS = ("voltage_v", "current_a", "temperature_c", "soc")
STAGE_NEEDS = {
    "behavior_flags": ("current_a", "temperature_c", "soc"),
    "risk_assessment": ("current_a", "temperature_c", "soc"),
    "health_index": ("current_a", "temperature_c", "soc"),
    "guardian": ("current_a", "temperature_c", "soc"),
}
COLD_BELOW_C, MISMATCH_C = 15.0, 5.0
ENOUGH_DISCHARGES = 30
LIFE_HIGH, LIFE_MEDIUM = 25, 100
HOT_C = 40.0
FACTS_OF_LIFE = ("rul_cycles",)


def log_facts(log: DataFrame) -> DataFrame:
    """Per cell: samples, duration, which channels hold a value, temperatures."""
    have = [c for c in CHANNELS if c in log.columns]
    has = {c: (F.count(c) > 0 if c in have else F.lit(False)) for c in CHANNELS}
    t = F.col("temperature_c") if "temperature_c" in have else F.lit(None).cast("double")
    return log.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.max("test_time_s") - F.min("test_time_s"), F.lit(0.0)).alias("duration_s"),
        *[c.alias(f"has_{n}") for n, c in has.items()],
        F.avg(t).alias("temp_mean"), F.max(t).alias("temp_max"),
        F.avg(F.when(t.isNotNull(), (t > HOT_C).cast("double"))).alias("hot_share"))


def stage_availability(facts: DataFrame, needs: Mapping[str, Sequence[str]] = STAGE_NEEDS) -> DataFrame:
    """(cell, stages, available, missing): stages that lack the same channels share a row."""
    rows = F.array(*[F.struct(
        F.lit(i).alias("place"), F.lit(stage).alias("stage"), F.array_compact(F.array(*[
            F.when(~F.col(f"has_{c}"), F.lit(c)) for c in channels])).alias("lack"))
        for i, (stage, channels) in enumerate(needs.items())])
    return (facts.select("cell_id", F.inline(rows))
            .groupBy("cell_id", F.array_join("lack", ", ").alias("missing"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "stage"))),
                                          lambda s: s["stage"]), ", ").alias("stages"))
            .withColumn("available", F.col("missing") == ""))


def conditions(discharges: DataFrame, report: DataFrame, k: int = 5) -> DataFrame:
    """Median temperature of the first k discharges and of the last k up to the reading; what is odd about them."""
    first = first_rows(discharges, CELL, ["cycle"], k).groupBy("cell_id").agg(
        F.percentile("avg_temp", 0.5).alias("reference_temp_c"))
    read = report.where("soh IS NOT NULL").select("cell_id", "at_cycle")
    upto = discharges.join(read, "cell_id").where("cycle <= at_cycle")
    last = first_rows(upto, CELL, [F.desc("cycle")], k).groupBy("cell_id").agg(
        F.percentile("avg_temp", 0.5).alias("recent_temp_c"))
    now, ref = F.col("recent_temp_c"), F.col("reference_temp_c")
    return last.join(first, "cell_id", "left").withColumn("condition", F.concat_ws(
        "; ", F.when(now < COLD_BELOW_C, "cold"), F.when(F.abs(now - ref) > MISMATCH_C, "other temperature than reference")))


def battery_answers(facts: DataFrame, measured: DataFrame, report: DataFrame,
                    life: DataFrame | None = None, scored: DataFrame | None = None,
                    beginning_of_life: Column | None = None) -> DataFrame:
    """One wide row per cell of the log; later tables read only this.

    ``measured`` are the discharges with ``is_complete`` and ``avg_temp``,
    ``report`` the current state of health, ``life`` (cell, rul_cycles) and
    ``scored`` (cell) are optional.
    """
    counts = measured.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_seen"), F.count_if("is_complete").alias("n_complete"))
    wide = (facts.join(counts, "cell_id", "left").join(report, "cell_id", "left")
            .join(conditions(measured, report), "cell_id", "left"))
    wide = wide.join(life.select("cell_id", *FACTS_OF_LIFE), "cell_id", "left") if life is not None else (
        wide.withColumn("rul_cycles", F.lit(None).cast("double")))
    wide = wide.join(scored.select("cell_id", F.lit(True).alias("is_scored")), "cell_id", "left") if scored is not None else (
        wide.withColumn("is_scored", F.lit(False)))
    zero = F.lit(0)
    return wide.withColumns({
        **{n: F.coalesce(n, zero) for n in ("n_seen", "n_complete", "n_accepted")},
        "condition": F.coalesce("condition", F.lit("")),
        "is_scored": F.coalesce("is_scored", F.lit(False)),
        "consistent": F.coalesce("consistent", F.lit(False)),
        "refusal": F.coalesce("refusal", F.lit("no discharge was seen")),
        "beginning_of_life": F.lit(True) if beginning_of_life is None else beginning_of_life})


def _capacity() -> tuple[Column, Column]:
    odd = F.col("condition") != ""
    learned, late = F.col("window_mode") != "fixed", ~F.col("beginning_of_life")
    known = F.col("soh").isNotNull()
    level = F.when(known, F.when(odd | ~F.col("consistent"), "LOW").when(learned | late, "MEDIUM").otherwise("HIGH"))
    reason = (F.when(~known, F.col("refusal"))
              .when(odd, F.concat(F.lit("not validated under these conditions: "), "condition"))
              .when(~F.col("consistent") & F.col("uncertainty").isNull(), "too few recent readings to judge their scatter")
              .when(~F.col("consistent"), "recent readings disagree with each other")
              .otherwise(F.concat_ws("; ", F.when(learned, "window learned from this battery's use"),
                                     F.when(late, "reference may not be the battery as new"))))
    return level, reason


def _resistance() -> tuple[Column, Column]:
    known, n = F.col("resistance_growth").isNotNull(), F.col("n_accepted")
    level = F.when(known, F.when(n >= ENOUGH_DISCHARGES, "HIGH").otherwise("MEDIUM"))
    return level, F.when(~known, "no clean step from rest to load").when(
        n < ENOUGH_DISCHARGES, F.concat(n.cast("string"), F.lit(" discharges with a load step"))).otherwise("")


def _life() -> tuple[Column, Column]:
    r = F.col("rul_cycles")
    level = F.when(r < LIFE_HIGH, "HIGH").when(r < LIFE_MEDIUM, "MEDIUM").when(r.isNotNull(), "LOW")
    return level, F.when(r.isNull(), "no trend to extrapolate").when(
        r >= LIFE_MEDIUM, "far from end of life; the band is wide").otherwise("")


def evidence_block(answers: DataFrame) -> DataFrame:
    """Five rows per cell: (output, available, confidence, reason) beside the facts they rest on."""
    heat, scored = F.col("has_temperature_c"), F.col("is_scored")
    rows = [
        ("capacity health", *_capacity()), ("resistance health", *_resistance()), ("remaining life", *_life()),
        ("heat exposure", F.when(heat, "MEASURED"), F.when(~heat, "no temperature channel").otherwise("")),
        ("behaviour risk score", F.when(scored, "HEURISTIC"), F.when(
            scored, "rules set by hand, not validated against measured fade").otherwise(
            "needs temperature, charge level and rated capacity"))]
    made = F.array(*[F.struct(F.lit(n).alias("output"), level.isNotNull().alias("available"),
                              F.coalesce(level, F.lit("")).alias("confidence"), reason.alias("reason"))
                     for n, level, reason in rows])
    return answers.select(
        "cell_id", "samples", "duration_s", *[f"has_{c}" for c in CHANNELS], F.col("n_seen").alias("discharges"),
        F.col("n_complete").alias("complete_discharges"), F.col("n_accepted").alias("window_discharges"),
        F.col("beginning_of_life"), F.inline(made))


def health_card(answers: DataFrame) -> DataFrame:
    """(cell, section, item, value, text, label): the report card, section by section.

    Sections: 1 state of health, 2 remaining life, 3 use, 4 what to do, 5 what
    cannot be told. Section 0 is the evidence block.
    """
    known, new = F.col("soh").isNotNull(), F.col("beginning_of_life")
    level = _capacity()[0]
    none = F.lit(None).cast("double")

    def line(section: int, item: str, when: Column, value: Column = none, label: Column | str = "",
             text: Column | str = "") -> Column:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(when, F.struct(
            F.lit(section).alias("section"), F.lit(item).alias("item"), value.cast("double").alias("value"),
            as_col(text).alias("text"), as_col(label).alias("label")))

    r, t = F.col("rul_cycles"), F.col("temp_mean")
    growth = F.col("resistance_growth")
    lines = [
        line(1, "capacity health", known & new, F.col("soh"), level),
        line(1, "capacity relative to the start of the log", known & ~new, F.col("soh"), level),
        line(1, "resistance health", known & (growth > 0), 1.0 / growth, _resistance()[0]),
        line(1, "state", known & new, none, "MEASURED", state_from_soh(F.col("soh"))),
        line(1, "not available", ~known, none, "", F.col("refusal")),
        line(2, "cycles left", r > 0, r, "ESTIMATE"),
        line(2, "already below the end-of-life limit", r <= 0, F.lit(0.0), "MEASURED"),
        line(2, "not available", r.isNull(), none, "", "no trend to extrapolate"),
        line(3, "mean temperature", t.isNotNull(), t, "MEASURED"),
        line(3, "highest temperature", t.isNotNull(), F.col("temp_max"), "MEASURED"),
        line(3, "share of hot samples", t.isNotNull(), F.col("hot_share"), "MEASURED"),
        line(3, "not available", t.isNull(), none, "", "no temperature channel"),
        line(4, "advice by measured state", known & new, none, "MEASURED", state_from_soh(F.col("soh"))),
        line(4, "no advice", ~(known & new), none, "", "no measured state"),
        line(5, "refused", ~known, none, "", F.col("refusal")),
        line(5, "nothing refused", known),
        line(5, "scope", F.lit(True), none, "", "validated on single cells of one chemistry"),
    ]
    return answers.select("cell_id", F.inline(F.array_compact(F.array(*lines))))


def profile_listing(answers: DataFrame, table: DataFrame) -> DataFrame:
    """One row per battery with a memory: reading, confidence, and why later discharges gave none.

    The reason given is the most frequent one among the discharges after the
    reading (the first in alphabetical order on a tie).
    """
    at = answers.where("soh IS NOT NULL").select("cell_id", "at_cycle")
    later = (table.join(at, "cell_id").where((F.col("cycle") > F.col("at_cycle")) & (F.col("refusal") != ""))
             .groupBy("cell_id", "refusal").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("cell_id").agg(F.sum("n").alias("later_refused"),
                                     F.min_by("refusal", F.struct(-F.col("n"), F.col("refusal"))).alias("_why")))
    since = F.col("n_discharges") - F.col("at_cycle")
    return answers.where("n_discharges > 0").join(later, "cell_id", "left").select(
        "cell_id", F.col("n_discharges").alias("discharges_remembered"), "soh", "at_cycle",
        since.alias("discharges_since_reading"), F.coalesce("later_refused", F.lit(0)).alias("later_refused"),
        F.when(since > 0, F.coalesce("_why", F.lit("later discharges did not cross the measurement window")))
        .otherwise("").alias("later_refusal"),
        F.coalesce(_capacity()[0], F.lit("NONE")).alias("confidence"),
        F.coalesce(_resistance()[0], F.lit("NONE")).alias("resistance_confidence"),
        "resistance_growth", "refusal")


def score_bands(frame: DataFrame, bands: Mapping[str, str]) -> DataFrame:
    """(score, band, n, share, median, p90) for each {score column: band column}."""
    cells = F.array(*[F.struct(F.lit(s).alias("score"), F.col(b).cast("string").alias("band"),
                               F.col(s).cast("double").alias("value")) for s, b in bands.items()])
    long = frame.select(F.inline(cells))
    counts = long.groupBy("score", "band").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("score")  # one row per band
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(total))
    return shares.join(exact_quantiles(long, ["score", "band"], "value", {"median": 0.5, "p90": 0.9}), ["score", "band"])


def fleet_cards(batteries: DataFrame, contributions: Mapping[str, str], series: DataFrame) -> DataFrame:
    """One nested row per battery: tone, contributions by falling size, a short series.

    ``contributions`` maps a term to its column; ``series`` has at most a
    fixed number of (cell_id, cycle, value) points per battery.
    """
    parts = F.array(*[F.struct(
        (-F.round(F.abs(F.col(c)), 6)).alias("size"), F.lit(i).alias("place"), F.lit(t).alias("term"), F.col(c).alias("value"))
        for i, (t, c) in enumerate(contributions.items())])
    points = series.groupBy(F.col("cell_id").alias("battery_id")).agg(
        F.array_sort(F.collect_list(F.struct("cycle", "value"))).alias("series"))
    tone = (F.when(F.col("battery_state") == "CRITICAL", "bad").when(
        F.col("battery_state").isin("DEGRADED", "WARNING"), "warn").otherwise("good"))
    return batteries.join(points, "battery_id", "left").withColumns({
        "tone": tone,
        "attribution": F.transform(F.array_sort(parts), lambda p: F.struct(p["term"].alias("term"), p["value"].alias("value")))})
