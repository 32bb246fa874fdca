"""Twin snapshots, transitions, bounded history, memory of a battery, model log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.ordered import BLOCK_ROWS, lagged, with_ordinal
from voltloom.operators.scores import lookup

# Twin state by battery state.
TWIN_STATE = {"HEALTHY": "NORMAL", "WARNING": "MODERATE_RISK", "DEGRADED": "HIGH_RISK",
              "CRITICAL": "FAILURE_IMMINENT"}
HISTORY_LIMIT = 500
STALE_AFTER_S = 600.0


def snapshots(reports: DataFrame, evaluated_at: Column) -> DataFrame:
    """One twin row per battery; the likelihood is the index over 100, not a probability."""
    state = lookup(F.col("battery_state"), TWIN_STATE)
    known = F.coalesce(state, F.raise_error(F.concat(
        F.lit("unrecognized battery_state "), F.coalesce("battery_state", F.lit("null")))).cast("string"))
    return reports.select(
        "battery_id", known.alias("twin_state"), "health_index",
        F.round(F.col("health_index") / 100.0, 4).alias("failure_likelihood"),
        F.col("rul_cycles").cast("bigint").alias("rul_cycles"), "replacement_policy",
        evaluated_at.alias("evaluated_at"))


def transitions(history: DataFrame, order: str = "evaluated_at", chunk: Column | None = None,
                size: int | None = 65_536) -> DataFrame:
    """A row where a battery's state differs from its snapshot before; the first has no from."""
    numbered = with_ordinal(history, ["battery_id"], [order], chunk, "_no")
    was = lagged(numbered, ["battery_id"], "_no", {"from_state": "twin_state"}, size=size)
    return was.where(~F.col("from_state").eqNullSafe(F.col("twin_state"))).select(
        "battery_id", "from_state", F.col("twin_state").alias("to_state"), F.col(order).alias("at"))


def bounded_history(history: DataFrame, order: str = "evaluated_at", limit: int = HISTORY_LIMIT) -> DataFrame:
    """The newest rows per battery; the limit also runs before the shuffle."""
    w = Window.partitionBy("battery_id").orderBy(F.desc(order))
    return history.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= limit).drop("_back")


def latest(history: DataFrame, order: str = "evaluated_at") -> DataFrame:
    """Newest snapshot per battery."""
    others = [c for c in history.columns if c != "battery_id"]
    return history.groupBy("battery_id").agg(F.max_by(F.struct(*others), order).alias("s")).select(
        "battery_id", "s.*")


def staleness(history: DataFrame, now: Column, max_age_s: float = STALE_AFTER_S) -> DataFrame:
    last = history.groupBy("battery_id").agg(F.max("evaluated_at").alias("evaluated_at"))
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.col("evaluated_at"))) / 1e6)
    return last.withColumn("age_s", age).withColumn("stale", F.col("age_s") > max_age_s)


def upsert(store: DataFrame, run: DataFrame, key: str = "battery_id", order: str = "run") -> DataFrame:
    """Newest row per battery of the stored and the new rows."""
    both = store.unionByName(run, allowMissingColumns=True)
    others = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("s")).select(key, "s.*")


def live_tail(samples: DataFrame, n: int, dead_band_a: float = 0.5) -> DataFrame:
    """Last n samples per battery with their mode and the channels they lack."""
    from voltloom.schema import mode

    w = Window.partitionBy("cell_id").orderBy(F.desc("test_time_s"), F.desc("seq"))
    tail = samples.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)
    names = ("voltage_v", "current_a", "temperature_c", "soc")
    absent = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in names])
    return tail.withColumns({"mode": mode(F.col("current_a"), dead_band_a), "absent": absent}).drop("_back")


def piece_keys(pieces: DataFrame) -> DataFrame:
    """(battery_id, piece_id, content_key): what a piece holds, whatever its name.

    Sums are of decimals, so that the order of the rows cannot change a digit.
    """
    parts = [F.count(F.lit(1)).cast("string")]
    for c in ("test_time_s", "current_a", "voltage_v"):
        parts += [F.format_string("%.6g", F.min(c)), F.format_string("%.6g", F.max(c)),
                  F.sum(F.col(c).cast("decimal(28,6)")).cast("string")]
    return pieces.groupBy("battery_id", "piece_id").agg(
        F.sha1(F.concat_ws("|", *parts)).alias("content_key"))


def new_pieces(pieces: DataFrame, seen_keys: DataFrame) -> DataFrame:
    """Pieces not absorbed before; of equal pieces in one delivery the first is taken."""
    keys = piece_keys(pieces)
    fresh = (keys.join(seen_keys.select("battery_id", "content_key"), ["battery_id", "content_key"], "left_anti")
             .groupBy("battery_id", "content_key").agg(F.min("piece_id").alias("piece_id")))
    return fresh


# -- model versions ---------------------------------------------------------

def active_versions(decisions: DataFrame) -> DataFrame:
    """(cohort_id, version): target of the newest PROMOTE or ROLLBACK in the log."""
    return decisions.where(F.col("outcome").isin("PROMOTE", "ROLLBACK")).groupBy("cohort_id").agg(
        F.max_by("version", "at").alias("version"))


def parameter_stability(active: DataFrame, candidate: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(cohort_id, name, problem): how a candidate's parameters differ from the active ones.

    Both sides are (cohort_id, name, value). A cohort without an active version
    has nothing to compare with.
    """
    old = active.select("cohort_id", "name", F.col("value").alias("old"), F.lit(True).alias("_o"))
    new = candidate.select("cohort_id", "name", F.col("value").alias("new"), F.lit(True).alias("_n"))
    known = active.select("cohort_id").distinct()
    both = old.join(new, ["cohort_id", "name"], "full").join(known, "cohort_id", "left_semi")
    moved = F.when(F.abs("old") >= 1e-12, F.abs(F.col("new") - F.col("old")) / F.abs("old"))
    problem = (F.when(F.col("_n").isNull(), "disappeared").when(F.col("_o").isNull(), "new")
               .when(F.col("old") * F.col("new") < 0, "flipped sign").when(moved > tolerance, "moved"))
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(
        "cohort_id", "name", "problem", "old", "new")


def propose(decisions: DataFrame, candidates: DataFrame, problems: DataFrame) -> DataFrame:
    """New rows for the decision log from gate verdicts and stability problems.

    ``candidates`` is (cohort_id, promote, reasons, at); a promotion takes the
    next version and remembers its parent.
    """
    current = active_versions(decisions).select("cohort_id", F.col("version").alias("parent_version"))
    found = problems.groupBy("cohort_id").agg(F.concat_ws("; ", F.array_sort(F.collect_set(
        F.concat_ws(" ", "name", "problem")))).alias("_text"))
    joined = candidates.join(current, "cohort_id", "left").join(found, "cohort_id", "left")
    ok = F.col("promote") & F.col("_text").isNull()
    reasons = F.when(F.col("promote") & F.col("_text").isNotNull(), F.concat("reasons", F.array(F.concat(
        F.lit("parameter stability: "), "_text")))).otherwise(F.col("reasons"))
    return joined.select(
        "cohort_id", F.when(ok, "PROMOTE").otherwise("REJECT").alias("outcome"),
        F.when(ok, F.coalesce("parent_version", F.lit(0)) + 1).alias("version"),
        F.when(ok, F.col("parent_version")).alias("parent_version"), reasons.alias("reasons"), "at")


def rollback(decisions: DataFrame, cohorts: DataFrame) -> DataFrame:
    """ROLLBACK rows pointing at the parent of each cohort's active version.

    ``cohorts`` is (cohort_id, at). A first version has no parent and is refused
    by leaving its version empty.
    """
    made = decisions.where("outcome = 'PROMOTE'").select("cohort_id", "version", "parent_version")
    return (cohorts.join(active_versions(decisions), "cohort_id").join(made, ["cohort_id", "version"], "left")
            .select("cohort_id", F.lit("ROLLBACK").alias("outcome"), F.col("parent_version").alias("version"),
                    F.lit(None).cast("bigint").alias("parent_version"), "at"))
