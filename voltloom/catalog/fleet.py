"""Registered queries: schema, usage, scores, attribution, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import fixtures, schema
from voltloom.catalog.base import query
from voltloom.catalog.views import HEALTH_SQL, RISK_SQL, shap_sql, total_sql
from voltloom.operators import guardian, scores, usage
from voltloom.plans import fleet
from voltloom.session import staged

FLAGS = ("aggressive_discharge_event:i fast_charge_flag:i high_temp_flag:i "
         "deep_discharge_flag:i high_soc_flag:i")
SUMMARY = ("avg_stress:d6 avg_temp:d6 fast_charge_duration:i deep_discharge_duration:i "
           "high_temp_duration:i aggressive_discharge_count:i avg_soc:d6")


def _behaviour(spark, sf_dir):
    return fleet.behaviour(fixtures.telemetry(spark, sf_dir))


def _summary(spark, sf_dir):
    return usage.summarize_batteries(_behaviour(spark, sf_dir))


def _life(spark, sf_dir):
    """Scored batteries, staged: one row per battery feeds several scalars."""
    return staged(fleet.scored(_summary(spark, sf_dir)))


@query("prj_standardize_columns", "cell_id:s cycle:i current_a:d6 voltage_v:d6 dataset:s",
       "SELECT cell_id, cycle, current_a, voltage_v, 'demo' AS dataset FROM fx_telemetry")
def _(spark, sf_dir):
    raw = fixtures.telemetry(spark, sf_dir).select(
        F.col("cell_id").alias("Battery-ID"), F.col("cycle").alias("Cycle Index"),
        F.col("current_a").alias("Current Measured"), F.col("voltage_v").alias("Terminal Voltage"))
    return schema.standardize(raw, {"dataset": "demo", "cell_id": "unused"})


@query("prj_coerce_types", "cell_id:s seq:i soc:d6 cycle:d0 temperature_c:d6",
       """SELECT cell_id, seq, CASE WHEN seq % 7 = 0 THEN NULL ELSE soc END AS soc,
          CASE WHEN seq % 5 = 0 THEN NULL ELSE cycle END AS cycle,
          CASE WHEN seq % 11 = 0 THEN NULL ELSE temperature_c END AS temperature_c FROM fx_telemetry""")
def _(spark, sf_dir):
    seq = F.col("seq")
    raw = fixtures.telemetry(spark, sf_dir).select(
        "cell_id", "seq",
        F.when(seq % 7 == 0, "n/a").otherwise(F.col("soc").cast("string")).alias("soc"),
        F.when(seq % 5 == 0, "--").otherwise(F.col("cycle").cast("string")).alias("cycle"),
        F.when(seq % 11 == 0, F.lit("NaN").cast("double")).otherwise(F.col("temperature_c"))
        .alias("temperature_c"))
    return schema.coerce(raw)


@query("prj_derive_power_band_mode", "cell_id:s seq:i power_w:d6 soc_band:s mode_guess:s",
       """SELECT cell_id, seq, voltage_v*current_a AS power_w,
          CASE WHEN soc < 20 THEN 'low_0_20' WHEN soc < 80 THEN 'normal_20_80'
               WHEN soc < 90 THEN 'elevated_80_90' ELSE 'high_90_100' END AS soc_band,
          CASE WHEN current_a > 0.02 THEN 'charge' WHEN current_a < -0.02 THEN 'discharge' ELSE 'rest' END AS mode_guess
          FROM fx_telemetry""")
def _(spark, sf_dir):
    return schema.derive(fixtures.telemetry(spark, sf_dir))


@query("prj_validate_schema", "issue:s",
       """SELECT 'Missing required column: dataset' AS issue
          UNION ALL SELECT 'Missing required column: temperature_c'
          UNION ALL SELECT 'Column contains negative values but should be non-negative: voltage_v'
            WHERE (SELECT count(*) FROM fx_telemetry WHERE voltage_v - 3.5 < 0) > 0
          UNION ALL SELECT 'Column contains values outside 0–100% range: soc'
            WHERE (SELECT count(*) FROM fx_telemetry WHERE soc*2 > 100) > 0""")
def _(spark, sf_dir):
    raw = fixtures.telemetry(spark, sf_dir).select(
        "cell_id", "cycle", "current_a", (F.col("voltage_v") - 3.5).alias("voltage_v"),
        (F.col("soc") * 2).alias("soc"))
    return schema.schema_issues(raw)


@query("prj_behavior_flags", f"cell_id:s seq:i {FLAGS}",
       "SELECT * FROM flagged")
def _(spark, sf_dir):
    return usage.with_flags(fixtures.telemetry(spark, sf_dir))


@query("prj_stress_score", "cell_id:s seq:i stress_score:d6", "SELECT * FROM stressed")
def _(spark, sf_dir):
    return _behaviour(spark, sf_dir)


@query("win_rolling_stats",
       "cell_id:s seq:i stress_rolling_mean:d6 stress_rolling_std:d6 temp_rolling_mean:d6 temp_rolling_max:d6",
       """SELECT cell_id, seq, avg(stress_score) OVER w AS stress_rolling_mean,
          coalesce(stddev_samp(stress_score) OVER w, 0) AS stress_rolling_std,
          avg(temperature_c) OVER w AS temp_rolling_mean, max(temperature_c) OVER w AS temp_rolling_max
          FROM stressed WINDOW w AS (PARTITION BY cell_id ORDER BY cycle, seq
            ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def _(spark, sf_dir):
    return usage.with_rolling(_behaviour(spark, sf_dir), ["cycle", "seq"],
                              fixtures.telemetry_chunk())


@query("win_age_features", "cell_id:s seq:i battery_age_factor:d6 cycle_stress_index:d6",
       """SELECT cell_id, seq, CAST(cycle AS DOUBLE)/max(cycle) OVER (PARTITION BY cell_id) AS battery_age_factor,
          stress_score*CAST(cycle AS DOUBLE)/max(cycle) OVER (PARTITION BY cell_id) AS cycle_stress_index
          FROM stressed""")
def _(spark, sf_dir):
    return usage.with_age(_behaviour(spark, sf_dir))


@query("agg_summarize_batteries", f"battery_id:s {SUMMARY}", "SELECT * FROM battery_summary")
def _(spark, sf_dir):
    return _summary(spark, sf_dir)


@query("agg_summarize_by_cycle", f"cell_id:s cycle:i {SUMMARY} max_temp:d6 n_rows:i",
       """SELECT cell_id, cycle, avg(stress_score) AS avg_stress, avg(temperature_c) AS avg_temp,
          max(temperature_c) AS max_temp, sum(fast_charge_flag) AS fast_charge_duration,
          sum(deep_discharge_flag) AS deep_discharge_duration, sum(high_temp_flag) AS high_temp_duration,
          sum(aggressive_discharge_event) AS aggressive_discharge_count, avg(soc) AS avg_soc,
          count(*) AS n_rows FROM stressed GROUP BY cell_id, cycle""")
def _(spark, sf_dir):
    return usage.summarize_by_cycle(_behaviour(spark, sf_dir))


@query("agg_usage_share",
       "cell_id:s aggressive_pct:d1 fast_charge_pct:d1 hot_pct:d1 deep_pct:d1 high_soc_pct:d1 nominal_pct:d1",
       """SELECT *, round_even(greatest(0, 100-aggressive_pct-fast_charge_pct-hot_pct-deep_pct-high_soc_pct),1) AS nominal_pct
          FROM (SELECT cell_id, round_even(avg(aggressive_discharge_event)*100,1) AS aggressive_pct,
            round_even(avg(fast_charge_flag)*100,1) AS fast_charge_pct, round_even(avg(high_temp_flag)*100,1) AS hot_pct,
            round_even(avg(deep_discharge_flag)*100,1) AS deep_pct, round_even(avg(high_soc_flag)*100,1) AS high_soc_pct
            FROM flagged GROUP BY cell_id) u""")
def _(spark, sf_dir):
    return usage.usage_share(usage.with_flags(fixtures.telemetry(spark, sf_dir)))


@query("rsk_risk_assessment",
       f"battery_id:s {SUMMARY} risk_score:d6 risk_level:s risk_reason:s recommended_action:s",
       """SELECT *, CASE risk_level
            WHEN 'CRITICAL' THEN 'Immediate inspection recommended. Avoid fast charging and maintain 20-80 SOC.'
            WHEN 'HIGH' THEN 'Reduce fast charging frequency and follow 20-80 charging rule.'
            WHEN 'MEDIUM' THEN 'Avoid deep discharge and prolonged high SOC exposure.'
            ELSE 'Battery behavior is healthy.' END AS recommended_action FROM risk_rows""")
def _(spark, sf_dir):
    return scores.risk_assessment(_summary(spark, sf_dir))


@query("soh_health_index",
       f"battery_id:s {SUMMARY} aging_budget:d6 health_index:d6 consumed_life:d6 battery_state:s",
       "SELECT * FROM health_rows")
def _(spark, sf_dir):
    return scores.health_index(_summary(spark, sf_dir))


@query("jn_risk_health_join", "battery_id:s risk_score:d6 risk_level:s health_index:d6 battery_state:s",
       "SELECT * FROM scored_rows")
def _(spark, sf_dir):
    summary = _summary(spark, sf_dir)
    shared = [c for c in summary.columns if c != "battery_id"]
    risk = scores.risk_assessment(summary)
    return risk.join(scores.health_index(summary).drop(*shared), "battery_id")


@query("soh_rul_eaf",
       "battery_id:s equivalent_aging_factor:d6 estimated_total_cycles:d4 rul_cycles:i replacement_policy:s",
       "SELECT * FROM life_rows")
def _(spark, sf_dir):
    return _life(spark, sf_dir)


@query("prj_replacement_policy", "replacement_policy:s n:i",
       "SELECT replacement_policy, count(*) AS n FROM life_rows GROUP BY replacement_policy")
def _(spark, sf_dir):
    return _life(spark, sf_dir).groupBy("replacement_policy").agg(F.count(F.lit(1)).alias("n"))


SHAP = " ".join(f"health_shap_{t}:d6" for t in HEALTH_SQL)


@query("rsk_shapley_additive", f"battery_id:s {SHAP}", "SELECT * FROM shap_rows")
def _(spark, sf_dir):
    return scores.shapley(_life(spark, sf_dir), scores.HEALTH_TERMS, "health_")


@query("rsk_shapley_efficiency", "term_set:s n:i within:b",
       f"""SELECT 'health' AS term_set, count(*) AS n, max(abs(
             {' + '.join(f'health_shap_{t}' for t in HEALTH_SQL)} - (raw - base))) <= 1e-9 AS within
           FROM (SELECT *, {total_sql(HEALTH_SQL)} AS raw, avg({total_sql(HEALTH_SQL)}) OVER () AS base FROM shap_rows) s
           UNION ALL SELECT 'risk', count(*), max(abs(
             {' + '.join(f'risk_shap_{t}' for t in RISK_SQL)} - (raw - base))) <= 1e-9
           FROM (SELECT *, {total_sql(RISK_SQL)} AS raw, avg({total_sql(RISK_SQL)}) OVER () AS base
                 FROM ({shap_sql('life_rows', RISK_SQL, 'risk_')}) r0) r""")
def _(spark, sf_dir):
    rows = _life(spark, sf_dir)
    parts = [scores.efficiency_gap(rows, terms).withColumn("term_set", F.lit(name))
             for name, terms in (("health", scores.HEALTH_TERMS), ("risk", scores.RISK_TERMS))]
    return parts[0].unionByName(parts[1]).withColumn("within", F.col("worst_gap") <= 1e-9)


@query("rsk_rank_causes",
       "battery_id:s health_top_causes:s health_top_cause_contributions:s health_dominant_cause:s "
       "health_dominant_contribution:d6 health_strongest_protective_factor:s health_n_significant_drivers:i",
       "SELECT * FROM cause_rows")
def _(spark, sf_dir):
    return scores.rank_causes(
        scores.shapley(_life(spark, sf_dir), scores.HEALTH_TERMS, "health_"),
        scores.HEALTH_TERMS, "health_")


@query("rsk_guardian_report",
       "battery_id:s battery_state:s health_index:d6 risk_score:d6 risk_level:s rul_cycles:i replacement_policy:s "
       "primary_causes:s dominant_cause:s evidence_confidence:s guardian_status:s recommendation:s "
       "heat_advice:s guardian_report:s",
       "SELECT * FROM guardian_rows")
def guardian_table(spark, sf_dir):
    return guardian.guardian_report(_life(spark, sf_dir))


@query("rsk_threshold_reachability",
       "score:s term:s n_possible:i n_observed:i modal_share:d6 points_std:d6 status:s",
       "\nUNION ALL\n".join(
           f"""SELECT '{s}' AS score, '{t}' AS term, {2 if t == 'soc_extremes' else 3} AS n_possible,
              count(DISTINCT p) AS n_observed, max(c)/CAST(max(tot) AS DOUBLE) AS modal_share, max(sd) AS points_std,
              CASE WHEN count(DISTINCT p) = 1 THEN 'DEGENERATE'
                   WHEN count(DISTINCT p) < {2 if t == 'soc_extremes' else 3} THEN 'PARTIAL' ELSE 'ACTIVE' END AS status
              FROM (SELECT p, count(*) OVER (PARTITION BY p) AS c, count(*) OVER () AS tot, stddev_samp(p) OVER () AS sd
                    FROM (SELECT CAST({e} AS DOUBLE) AS p FROM battery_summary) a) b"""
           for s, terms in (("risk_score", RISK_SQL), ("health_index", HEALTH_SQL))
           for t, e in terms.items()))
def _(spark, sf_dir):
    summary = staged(_summary(spark, sf_dir))
    parts = [scores.threshold_reachability(summary, terms).withColumn("score", F.lit(name))
             for name, terms in (("risk_score", scores.RISK_TERMS), ("health_index", scores.HEALTH_TERMS))]
    return parts[0].unionByName(parts[1])


@query("rsk_score_pipeline",
       "battery_id:s battery_state:s risk_level:s rul_cycles:i primary_causes:s",
       "SELECT * FROM guardian_rows")
def flagship(spark, sf_dir):
    return guardian.guardian_report(staged(fleet.scored(
        usage.summarize_batteries(fleet.behaviour(fixtures.telemetry(spark, sf_dir))))))


@query("agg_fleet_rollup",
       "n_batteries:i n_critical:i n_degraded:i n_warning:i n_healthy:i mean_health_index:d6 mean_rul:d4 "
       "worst_battery:s n_needing_action:i n_distinct_health:i",
       """SELECT count(*) AS n_batteries, count(CASE WHEN battery_state='CRITICAL' THEN 1 END) AS n_critical,
          count(CASE WHEN battery_state='DEGRADED' THEN 1 END) AS n_degraded,
          count(CASE WHEN battery_state='WARNING' THEN 1 END) AS n_warning,
          count(CASE WHEN battery_state='HEALTHY' THEN 1 END) AS n_healthy,
          avg(health_index) AS mean_health_index, avg(rul_cycles) AS mean_rul,
          min_by(battery_id, struct_pack(m := -health_index, b := battery_id)) AS worst_battery,
          count(CASE WHEN battery_state IN ('CRITICAL','DEGRADED') THEN 1 END) AS n_needing_action,
          count(DISTINCT round(health_index, 2)) AS n_distinct_health
          FROM life_rows""")
def _(spark, sf_dir):
    from voltloom.plans.views import fleet_rollup
    return fleet_rollup(_life(spark, sf_dir))
