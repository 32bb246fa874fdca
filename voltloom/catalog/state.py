"""Registered queries: twins, histories, fleet views, model log, cohorts, transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import fixtures
from voltloom.catalog.base import query
from voltloom.catalog.fleet import _behaviour, _life
from voltloom.catalog.life import cycle_frame
from voltloom.catalog.views import VIEWS, total_sql, HEALTH_SQL
from voltloom.operators import cohorts, scores, twin, usage
from voltloom.session import staged

T0 = "2024-05-01T00:00:00Z"

# Each battery scored from a third of its cycles at a time: three runs.
VIEWS["t_runs"] = """
SELECT cell_id AS battery_id, cycle % 3 AS run, avg(stress_score) AS avg_stress, avg(temperature_c) AS avg_temp,
  sum(fast_charge_flag) AS fast_charge_duration, sum(deep_discharge_flag) AS deep_discharge_duration,
  sum(aggressive_discharge_event) AS aggressive_discharge_count, avg(soc) AS avg_soc
FROM stressed GROUP BY cell_id, cycle % 3"""
VIEWS["t_snap"] = f"""
SELECT battery_id, run, health_index, round(health_index/100.0, 4) AS failure_likelihood,
  CASE WHEN health_index >= 80 THEN 'FAILURE_IMMINENT' WHEN health_index >= 60 THEN 'HIGH_RISK'
       WHEN health_index >= 30 THEN 'MODERATE_RISK' ELSE 'NORMAL' END AS twin_state
FROM (SELECT *, CAST({total_sql(HEALTH_SQL)} AS DOUBLE) AS health_index FROM t_runs) h"""


def run_of(at: str) -> F.Column:
    """Run number of a snapshot time: whole hours since the first."""
    return F.floor((F.unix_seconds(at) - F.unix_seconds(F.to_timestamp(F.lit(T0)))) / 3600)


def runs(spark, sf_dir):
    """Snapshots of three runs; ``evaluated_at`` is an hour apart."""
    rows = _behaviour(spark, sf_dir).withColumn("run", F.pmod(F.col("cycle"), F.lit(3)))
    summary = rows.groupBy(F.col("cell_id").alias("battery_id"), "run").agg(
        F.avg("stress_score").alias("avg_stress"), F.avg("temperature_c").alias("avg_temp"),
        F.sum("fast_charge_flag").alias("fast_charge_duration"),
        F.sum("deep_discharge_flag").alias("deep_discharge_duration"),
        F.sum("aggressive_discharge_event").alias("aggressive_discharge_count"), F.avg("soc").alias("avg_soc"))
    scored = scores.ageing_factor_life(scores.health_index(summary))
    when = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(T0))) + F.col("run") * 3600)
    base = twin.snapshots(scored.withColumn("_at", when), F.col("_at"))
    return base.withColumn("run", run_of("evaluated_at"))


@query("str_twin_snapshot", "battery_id:s run:i twin_state:s health_index:d6 failure_likelihood:d4",
       "SELECT * FROM t_snap")
def _(spark, sf_dir):
    return runs(spark, sf_dir)


@query("str_twin_transition", "battery_id:s from_state:s to_state:s run:i",
       """SELECT battery_id, was AS from_state, twin_state AS to_state, run FROM (
            SELECT *, lag(twin_state) OVER (PARTITION BY battery_id ORDER BY run) AS was FROM t_snap) s
          WHERE was IS DISTINCT FROM twin_state""")
def _(spark, sf_dir):
    history = staged(runs(spark, sf_dir))
    size = twin.BLOCK_ROWS
    chunk = None if size is None else F.floor(F.unix_seconds("evaluated_at") / 86_400)
    return twin.transitions(history, chunk=chunk, size=size).withColumn("run", run_of("at"))


@query("str_twin_history_bounded", "battery_id:s run:i twin_state:s",
       """SELECT battery_id, run, twin_state FROM (SELECT *, row_number() OVER (PARTITION BY battery_id ORDER BY run DESC) AS k
          FROM t_snap) s WHERE k <= 2""")
def _(spark, sf_dir):
    return twin.bounded_history(runs(spark, sf_dir), limit=2)


@query("str_twin_staleness", "battery_id:s age_s:d3 stale:b",
       """SELECT battery_id, 7500.0 - max(run)*3600.0 AS age_s, 7500.0 - max(run)*3600.0 > 600 AS stale FROM t_snap GROUP BY battery_id""")
def _(spark, sf_dir):
    return twin.staleness(runs(spark, sf_dir), F.to_timestamp(F.lit("2024-05-01T02:05:00Z")))


@query("str_fleet_upsert", "battery_id:s run:i twin_state:s",
       """SELECT battery_id, run, twin_state FROM (SELECT *, row_number() OVER (PARTITION BY battery_id ORDER BY run DESC) AS k
          FROM t_snap) s WHERE k = 1""")
def _(spark, sf_dir):
    r = runs(spark, sf_dir)
    return twin.upsert(r.where("run < 2"), r.where("run = 2"))


@query("str_fleet_queries", "battery_id:s run:i twin_state:s health_index:d6",
       """SELECT battery_id, run, twin_state, health_index FROM (SELECT *, row_number() OVER (PARTITION BY battery_id ORDER BY run DESC) AS k
          FROM t_snap) s WHERE k = 1""")
def _(spark, sf_dir):
    return twin.latest(runs(spark, sf_dir))


@query("str_health_timeline", "cell_id:s cycle:i seq:i stress_score:d6 soc:d6 temperature_c:d6",
       "SELECT * FROM stressed WHERE cell_id = (SELECT min(cell_id) FROM stressed)")
def _(spark, sf_dir):
    rows = _behaviour(spark, sf_dir)
    one = fixtures.table(spark, sf_dir, "events").agg(
        F.min(F.concat(F.lit("CELL_"), F.col("user_id").cast("string")))).scalar()
    return rows.where(F.col("cell_id") == one)


@query("str_live_tail", "cell_id:s seq:i mode:s absent:s",
       """SELECT cell_id, seq, CASE WHEN current_a > 0.5 THEN 'charge' WHEN current_a < -0.5 THEN 'discharge' ELSE 'rest' END AS mode, '' AS absent
          FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY test_time_s DESC) AS k FROM fx_telemetry) t WHERE k <= 20""")
def _(spark, sf_dir):
    return twin.live_tail(fixtures.telemetry(spark, sf_dir), 20)


@query("str_battery_memory_new_pieces", "battery_id:s piece_id:i",
       """SELECT DISTINCT cell_id AS battery_id, cycle % 3 AS piece_id FROM fx_telemetry WHERE cycle % 3 <> 0""")
def _(spark, sf_dir):
    t = fixtures.telemetry(spark, sf_dir).withColumnRenamed("cell_id", "battery_id").withColumn(
        "piece_id", F.pmod(F.col("cycle"), F.lit(3)))
    again = t.unionByName(t.withColumn("piece_id", F.col("piece_id") + 10))
    seen = twin.piece_keys(t.where("piece_id = 0"))
    return twin.new_pieces(again, seen)


VIEWS["p_par"] = """
SELECT cohort AS cohort_id, regr_slope(capacity_ah, cycle) AS slope, avg(capacity_ah) AS level,
  regr_slope(capacity_ah, cycle) FILTER (cycle > 40) AS slope2, avg(capacity_ah) FILTER (cycle > 40) AS level2
FROM fx_cycles GROUP BY cohort"""


def _parameters(spark, sf_dir):
    x = cycle_frame(spark, sf_dir)

    def fit(df):
        c, y = F.col("cycle").cast("double"), F.col("capacity_ah")
        return df.groupBy(F.col("cohort").alias("cohort_id")).agg(
            F.regr_slope(y, c).alias("slope"), F.avg(y).alias("level"))
    old, new = fit(x), fit(x.where("cycle > 40"))
    long = lambda d, names: d.select("cohort_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), e.alias("value")) for n, e in names])))
    return (long(old, [("slope", F.col("slope")), ("level", F.col("level")), ("gone", F.lit(1.0))]),
            long(new, [("slope", -F.col("slope")), ("level", 2 * F.col("level")), ("extra", F.lit(1.0))]))


@query("str_parameter_stability", "cohort_id:s name:s problem:s",
       """SELECT cohort_id, 'gone' AS name, 'disappeared' AS problem FROM p_par UNION ALL SELECT cohort_id, 'extra', 'new' FROM p_par
          UNION ALL SELECT cohort_id, 'slope', 'flipped sign' FROM p_par WHERE slope * -slope2 < 0
          UNION ALL SELECT cohort_id, 'slope', 'moved' FROM p_par WHERE slope * -slope2 >= 0 AND abs(-slope2 - slope)/abs(slope) > 0.5
          UNION ALL SELECT cohort_id, 'level', 'moved' FROM p_par WHERE abs(2*level2 - level)/abs(level) > 0.5""")
def _(spark, sf_dir):
    old, new = _parameters(spark, sf_dir)
    return twin.parameter_stability(old, new)


def _log(spark, sf_dir):
    """A decision log derived from the cycle frame: version = calendar year of the cycles."""
    x = cycle_frame(spark, sf_dir)
    years = x.select(F.col("cohort").alias("cohort_id"), F.floor((F.col("cycle") - 1) / 12).alias("y")).distinct()
    return years.select("cohort_id", F.when(F.col("y") % 3 == 2, "REJECT").otherwise("PROMOTE").alias("outcome"),
                        (F.col("y") + 1).alias("version"),
                        F.when(F.col("y") > 0, F.col("y")).alias("parent_version"), F.col("y").alias("at"))


VIEWS["g_log"] = """
SELECT DISTINCT cohort AS cohort_id, CASE WHEN CAST(floor((cycle-1)/12.0) AS INT) % 3 = 2 THEN 'REJECT' ELSE 'PROMOTE' END AS outcome,
  CAST(floor((cycle-1)/12.0) AS INT) + 1 AS version, CAST(floor((cycle-1)/12.0) AS INT) AS at_c FROM fx_cycles"""


@query("str_model_version_log", "cohort_id:s version:i",
       "SELECT cohort_id, max_by(version, at_c) AS version FROM g_log WHERE outcome = 'PROMOTE' GROUP BY cohort_id")
def _(spark, sf_dir):
    return twin.active_versions(_log(spark, sf_dir))


@query("str_model_rollback", "cohort_id:s version:i",
       "SELECT cohort_id, max_by(version, at_c) - 1 AS version FROM g_log WHERE outcome = 'PROMOTE' GROUP BY cohort_id")
def _(spark, sf_dir):
    log = staged(_log(spark, sf_dir))
    asked = log.select("cohort_id").distinct().withColumn("at", F.lit(1000))
    return twin.active_versions(log.unionByName(twin.rollback(log, asked), allowMissingColumns=True))


# -- cohorts ----------------------------------------------------------------

ENV = ("avg_temp", "max_temp", "avg_soc")


@query("agg_cohort_bounds", "cohort:s feature:s low:d6 high:d6 n_rows:i n_cells:i",
       "\nUNION ALL\n".join(
           f"SELECT cohort, '{f}' AS feature, min({f}) AS low, max({f}) AS high, count(*) AS n_rows, count(DISTINCT cell_id) AS n_cells "
           "FROM fx_cycles GROUP BY cohort" for f in ENV))
def _(spark, sf_dir):
    return cohorts.cohort_bounds(cycle_frame(spark, sf_dir), ENV)


VIEWS["o_obs"] = """
SELECT cell_id, avg(avg_temp) + CASE WHEN min(cohort) = 'COHORT_4' THEN 200 ELSE 0 END AS avg_temp,
  CASE WHEN min(cohort) = 'COHORT_3' THEN NULL ELSE avg(max_temp) END AS max_temp, avg(avg_soc) AS avg_soc
FROM fx_cycles GROUP BY cell_id"""
VIEWS["o_bounds"] = "SELECT cohort, count(*) AS n_rows, " + ", ".join(
    f"min({f}) - CASE WHEN max({f}) > min({f}) THEN 0.15*(max({f})-min({f})) ELSE 0.15*greatest(abs(max({f})),1) END AS lo_{f}, "
    f"max({f}) + CASE WHEN max({f}) > min({f}) THEN 0.15*(max({f})-min({f})) ELSE 0.15*greatest(abs(max({f})),1) END AS hi_{f}"
    for f in ENV) + " FROM fx_cycles GROUP BY cohort"
VIEWS["o_per"] = "SELECT cell_id, cohort, n_rows, " + " + ".join(
    f"CASE WHEN coalesce({f} BETWEEN lo_{f} AND hi_{f}, false) THEN 0 ELSE 1 END" for f in ENV) + """ AS v
FROM o_obs CROSS JOIN o_bounds"""


@query("jn_cohort_envelope_join", "cell_id:s cohort:s nearest:s n_violations:i n_matches:i",
       """SELECT cell_id, CASE WHEN b.v = 0 THEN b.cohort END AS cohort, b.cohort AS nearest, b.v AS n_violations, n_matches FROM (
            SELECT cell_id, max_by(struct_pack(cohort := cohort, v := v), struct_pack(m := CASE WHEN v = 0 THEN 1 ELSE 0 END,
              r := CASE WHEN v = 0 THEN n_rows ELSE -v END, c := cohort)) AS b, count(CASE WHEN v = 0 THEN 1 END) AS n_matches
            FROM o_per GROUP BY cell_id) q""")
def _(spark, sf_dir):
    x = cycle_frame(spark, sf_dir)
    obs = x.groupBy("cell_id").agg(F.avg("avg_temp").alias("avg_temp"), F.avg("max_temp").alias("max_temp"),
                                   F.avg("avg_soc").alias("avg_soc"), F.min("cohort").alias("c"))
    obs = obs.withColumns({"avg_temp": F.when(F.col("c") == "COHORT_4", F.col("avg_temp") + 200).otherwise(F.col("avg_temp")),
                           "max_temp": F.when(F.col("c") != "COHORT_3", F.col("max_temp"))}).drop("c")
    return cohorts.identify_cohorts(obs, cohorts.cohort_bounds(x, ENV), ENV)


@query("agg_dataset_manifest",
       "n_cells:i n_cohorts:i n_rows:i min_cycles:i median_cycles:d3 max_cycles:i capacity_present:b capacity_varies:b n_small_cohorts:i",
       """SELECT count(*) AS n_cells, (SELECT count(DISTINCT cohort) FROM fx_cycles) AS n_cohorts, sum(n) AS n_rows, min(c) AS min_cycles,
          quantile_cont(c, 0.5) AS median_cycles, max(c) AS max_cycles, true AS capacity_present, bool_or(v) AS capacity_varies,
          (SELECT count(*) FROM (SELECT cohort FROM fx_cycles GROUP BY cohort HAVING count(DISTINCT cell_id) < 3) z) AS n_small_cohorts
          FROM (SELECT cell_id, count(*) AS n, count(DISTINCT cycle) AS c, count(DISTINCT capacity_ah) > 1 AS v FROM fx_cycles GROUP BY cell_id) q""")
def _(spark, sf_dir):
    return cohorts.manifest(cycle_frame(spark, sf_dir))


@query("agg_dataset_suitability", "blockers:s warnings:s suitable:b",
       """SELECT '' AS blockers, CASE WHEN (SELECT min(k) FROM (SELECT count(DISTINCT cell_id) AS k FROM fx_cycles GROUP BY cohort) z) < 3
          THEN 'some cohorts have under 3 cells' ELSE '' END AS warnings, true AS suitable""")
def _(spark, sf_dir):
    return cohorts.suitability(cycle_frame(spark, sf_dir))


@query("agg_derive_protocol_cohorts", "cell_id:s cohort:s",
       """SELECT cell_id, 'DERIVED_' || printf('%.1f', quantile_cont(avg_stress, 0.5)/2.0) || 'C_' || printf('%.1f', quantile_cont(avg_soc, 0.5)) || 'V' AS cohort
          FROM fx_cycles GROUP BY cell_id""")
def _(spark, sf_dir):
    return cohorts.protocol_cohorts(cycle_frame(spark, sf_dir), 2.0, "avg_stress", "avg_soc")


FEATS = ("avg_temp", "avg_soc", "avg_stress", "deep_discharge_duration")
VAR_SQL = "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, count({f}) AS n, count(DISTINCT {f}) AS n_distinct, avg({f}) AS mean, stddev_samp({f}) AS std, "
    f"min({f}) AS low, max({f}) AS high, count(DISTINCT {f}) >= 5 AND stddev_samp({f}) > 0 AS can_fit FROM {{s}}" for f in FEATS)
VIEWS["x_src"] = "SELECT * FROM fx_cycles WHERE cohort IN ('COHORT_0','COHORT_1','COHORT_2')"
VIEWS["x_tgt"] = "SELECT * REPLACE (CASE WHEN deep_discharge_duration >= 0 THEN 1 END AS deep_discharge_duration) FROM fx_cycles WHERE cohort IN ('COHORT_3','COHORT_4')"
VIEWS["x_vs"] = VAR_SQL.format(s="x_src")
VIEWS["x_vt"] = VAR_SQL.format(s="x_tgt")


def _pair(spark, sf_dir):
    x = cycle_frame(spark, sf_dir)
    far = F.col("cohort").isin("COHORT_3", "COHORT_4")
    return x.where(~far), x.where(far).withColumn("deep_discharge_duration", F.lit(1))


@query("agg_feature_variation", "feature:s n:i n_distinct:i mean:d6 std:d6 low:d6 high:d6 can_fit:b", "SELECT * FROM x_vs")
def _(spark, sf_dir):
    return cohorts.variation(_pair(spark, sf_dir)[0], FEATS)


@query("val_commensurability", "feature:s spread_ratio:d6 status:s",
       """SELECT s.feature, t.std/s.std AS spread_ratio, CASE WHEN NOT s.can_fit THEN 'constant_in_source' WHEN NOT t.can_fit THEN 'constant_in_target'
          WHEN t.std/s.std < 0.1 THEN 'spread_too_small_in_target' ELSE 'usable' END AS status FROM x_vs s JOIN x_vt t ON s.feature = t.feature""")
def _(spark, sf_dir):
    return cohorts.commensurability(*_pair(spark, sf_dir), FEATS)


@query("val_transfer_feasibility", "n_features:i n_usable:i verdict:s",
       """SELECT count(*) AS n_features, count(CASE WHEN s.can_fit AND t.can_fit AND t.std/s.std >= 0.1 THEN 1 END) AS n_usable, 'REDUCED' AS verdict
          FROM x_vs s JOIN x_vt t ON s.feature = t.feature""")
def _(spark, sf_dir):
    return cohorts.feasibility(cohorts.commensurability(*_pair(spark, sf_dir), FEATS))


@query("val_domain_shift", "feature:s target_median:d6 standardised_shift:d6 extrapolates:b",
       "SELECT s.feature, m.med AS target_median, (m.med - s.mean)/s.std AS standardised_shift, "
       "NOT m.med BETWEEN s.low - 0.15*(s.high-s.low) AND s.high + 0.15*(s.high-s.low) AS extrapolates FROM x_vs s JOIN ("
       + " UNION ALL ".join(f"SELECT '{f}' AS feature, quantile_cont({f}, 0.5) AS med FROM x_tgt" for f in FEATS)
       + ") m ON s.feature = m.feature")
def _(spark, sf_dir):
    return cohorts.domain_shift(*_pair(spark, sf_dir), FEATS)


@query("val_transfer_evaluate", "n:i mae:d6 rmse:d6 r2_vs_source_mean:d5 r2_vs_target_mean:d5",
       """SELECT count(*) AS n, avg(abs(capacity_ah-p)) AS mae, sqrt(avg((capacity_ah-p)*(capacity_ah-p))) AS rmse,
          1 - sum((capacity_ah-p)*(capacity_ah-p))/sum((capacity_ah-src)*(capacity_ah-src)) AS r2_vs_source_mean,
          1 - sum((capacity_ah-p)*(capacity_ah-p))/(var_pop(capacity_ah)*count(*)) AS r2_vs_target_mean
          FROM (SELECT t.capacity_ah, f.b + f.m*t.cycle AS p, f.src FROM x_tgt t, (SELECT regr_slope(capacity_ah, cycle) AS m,
            regr_intercept(capacity_ah, cycle) AS b, avg(capacity_ah) AS src FROM x_src) f) q""")
def _(spark, sf_dir):
    from voltloom.operators import evaluate
    return cohorts.transfer_scores(*_pair(spark, sf_dir), evaluate.AGE_LINEAR, "capacity_ah")


@query("val_governed_scoring", "cell_id:s cohort:s version:d0 score:d6 refused:b",
       """SELECT o.cell_id, CASE WHEN b.v = 0 THEN b.cohort END AS cohort, CASE WHEN b.v = 0 THEN 3 END AS version,
          CASE WHEN b.v = 0 THEN 1.0 + 0.01*o.avg_temp + 0.5*o.avg_soc END AS score, b.v <> 0 AS refused FROM o_obs o JOIN (
            SELECT cell_id, max_by(struct_pack(cohort := cohort, v := v), struct_pack(m := CASE WHEN v = 0 THEN 1 ELSE 0 END,
              r := CASE WHEN v = 0 THEN n_rows ELSE -v END, c := cohort)) AS b FROM o_per GROUP BY cell_id) q ON o.cell_id = q.cell_id""")
def _(spark, sf_dir):
    x = cycle_frame(spark, sf_dir)
    obs = x.groupBy("cell_id").agg(F.avg("avg_temp").alias("avg_temp"), F.avg("max_temp").alias("max_temp"),
                                   F.avg("avg_soc").alias("avg_soc"), F.min("cohort").alias("c"))
    obs = staged(obs.withColumns({
        "avg_temp": F.when(F.col("c") == "COHORT_4", F.col("avg_temp") + 200).otherwise(F.col("avg_temp")),
        "max_temp": F.when(F.col("c") != "COHORT_3", F.col("max_temp"))}).drop("c"))
    matches = cohorts.identify_cohorts(obs, cohorts.cohort_bounds(x, ENV), ENV)
    active = x.select("cohort").distinct().select("cohort", F.lit(3).alias("version"), F.create_map(
        F.lit("intercept"), F.lit(1.0), F.lit("avg_temp"), F.lit(0.01), F.lit("avg_soc"), F.lit(0.5)).alias("params"))
    return cohorts.governed_score(obs, matches, active).withColumn("refused", F.col("refusal") != "")
