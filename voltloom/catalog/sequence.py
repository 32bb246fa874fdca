"""Registered queries: phases, curves, resistance, window charge, state of health."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import fixtures
from voltloom.catalog import duty_views  # noqa: F401
from voltloom.catalog.base import query
from voltloom.operators import curves, phases, soh
from voltloom.session import staged

CHUNK_S = fixtures.DUTY_CHUNK_S


def noisy(spark, sf_dir):
    """The duty log with single-sample dropouts, gaps and sign flips."""
    rn, i = F.col("rn"), F.col("current_a")
    return fixtures.duty(spark, sf_dir).withColumn(
        "current_a", F.when(rn % 53 == 0, None).when(rn % 37 == 0, F.lit(0.0))
        .when(rn % 61 == 0, -i).otherwise(i))


def duty_log(spark, sf_dir):
    return phases.Log(fixtures.duty(spark, sf_dir), chunk_s=CHUNK_S)


def noisy_log(spark, sf_dir):
    return phases.Log(noisy(spark, sf_dir), chunk_s=CHUNK_S)


def _charges(spark, sf_dir, log=None):
    """Phases and the compensated window charge per discharge (staged)."""
    cut = phases.segment(log or duty_log(spark, sf_dir))
    drops = curves.discharge_steps(cut)
    return cut, staged(curves.charges_by_cycle(curves.discharge_curves(cut), drops))


def gated_table(spark, sf_dir, log=None):
    cut, charges = _charges(spark, sf_dir, log)
    discharges = staged(cut.discharges)
    return discharges, staged(soh.field_gates(soh.soh_table(charges), discharges))


@query("seg_segment_phases",
       "cell_id:s phase_no:i kind:s start_time_s:d3 end_time_s:d3 charge_ah:d6 mean_current_a:d6 n_samples:i",
       "SELECT * FROM n_phases")
def _(spark, sf_dir):
    return phases.segment(noisy_log(spark, sf_dir)).table


@query("seg_measure_cycles",
       "cell_id:s cycle:i capacity_ah:d6 is_complete:b start_time_s:d3 end_time_s:d3 n_samples:i "
       "mean_current_a:d6 avg_temp:d6 max_temp:d6",
       "SELECT * FROM n_measured")
def _(spark, sf_dir):
    return phases.measure_cycles(phases.segment(noisy_log(spark, sf_dir)).discharges)


@query("seg_cycles_to_frame", "cell_id:s cycle:i capacity_ah:d6",
       """SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS cycle, capacity_ah
          FROM n_measured WHERE is_complete""")
def _(spark, sf_dir):
    return phases.cycle_frame(phases.measure_cycles(phases.segment(noisy_log(spark, sf_dir)).discharges))


@query("agg_capacity_yield", "cell_id:s n_discharges:i n_complete:i n_partial:i largest_ah:d6 usable_fraction:d6",
       """SELECT cell_id, count(*) AS n_discharges, count(CASE WHEN is_complete THEN 1 END) AS n_complete,
          count(CASE WHEN NOT is_complete THEN 1 END) AS n_partial, max(capacity_ah) AS largest_ah,
          count(CASE WHEN is_complete THEN 1 END)/CAST(count(*) AS DOUBLE) AS usable_fraction
          FROM n_measured GROUP BY cell_id""")
def _(spark, sf_dir):
    return phases.capacity_yield(
        phases.measure_cycles(phases.segment(noisy_log(spark, sf_dir)).discharges))


@query("seg_curves", "cell_id:s cycle:i test_time_s:d3 voltage_v:d6 capacity_ah_curve:d6",
       "SELECT * FROM d_curve")
def _(spark, sf_dir):
    return curves.discharge_curves(phases.segment(duty_log(spark, sf_dir)))


@query("seg_curves_and_steps", "cell_id:s cycle:i r_step_ohm:d6 v_rest_v:d6 mean_current_a:d6",
       "SELECT * FROM d_step")
def _(spark, sf_dir):
    cut = phases.segment(duty_log(spark, sf_dir))
    return curves.step_resistance(cut.discharges, cut.log.rest_below_a)


@query("win_screen_step_resistance", "cell_id:s cycle:i r_step_ohm:d6 r_ok_ohm:d6",
       "SELECT * FROM w_screened",
       {"w_step": """SELECT cell_id, cycle, CASE WHEN cycle % 7 = 2 THEN r_step_ohm*CAST(0.1 AS DOUBLE)
            WHEN cycle % 11 = 5 THEN NULL ELSE r_step_ohm END AS r_step_ohm FROM d_step""",
        "w_screened": duty_views.screened_sql("w_step")})
def _(spark, sf_dir):
    cut = phases.segment(duty_log(spark, sf_dir))
    steps = curves.step_resistance(cut.discharges, cut.log.rest_below_a)
    c, r = F.col("cycle"), F.col("r_step_ohm")
    spoiled = steps.withColumn(
        "r_step_ohm", F.when(c % 7 == 2, r * 0.1).when(c % 11 == 5, None).otherwise(r))
    return curves.screen_steps(staged(spoiled))


@query("win_trailing_step_resistance", "cell_id:s cycle:i r_trailing_ohm:d6 ir_drop_v:d6",
       "SELECT * FROM d_trail")
def _(spark, sf_dir):
    return curves.discharge_steps(phases.segment(duty_log(spark, sf_dir)))


@query("seg_window_charge", "cell_id:s cycle:i window_charge_ah:d6 cycle_charge_ah:d6",
       "SELECT * FROM d_plain_charge")
def _(spark, sf_dir):
    return curves.charges_by_cycle(curves.discharge_curves(phases.segment(duty_log(spark, sf_dir))))


@query("jn_known_cycle_semi_join", "cell_id:s cycle:i ir_drop_v:d6 window_charge_ah:d6",
       "SELECT * FROM d_charge")
def _(spark, sf_dir):
    return _charges(spark, sf_dir)[1]


@query("soh_soh_table",
       "cell_id:s cycle:i window_charge_ah:d6 soh_window:d6 partial_discharge:b implausible:b",
       "SELECT * FROM s_t1")
def _(spark, sf_dir):
    return soh.soh_table(_charges(spark, sf_dir)[1])


@query("soh_field_gates",
       "cell_id:s cycle:i reference_efc:d6 reference_late:b cell_refused:b soh_window_accepted:d6",
       "SELECT *, late AS reference_late FROM s_gated")
def _(spark, sf_dir):
    return gated_table(spark, sf_dir)[1]


@query("soh_current_field_soh",
       "cell_id:s soh:d6 n_measurable:i n_accepted:i n_discharges:i resistance_growth:d6 refused:b",
       "SELECT *, code <> 'ok' AS refused FROM s_report")
def _(spark, sf_dir):
    discharges, table = gated_table(spark, sf_dir)
    return soh.current_soh(table, discharges).withColumn("refused", F.col("refusal") != "")


@query("soh_consistency_uncertainty", "cell_id:s uncertainty:d6 consistent:b",
       "SELECT cell_id, uncertainty, coalesce(uncertainty <= 0.01, false) AS consistent FROM s_report")
def _(spark, sf_dir):
    discharges, table = gated_table(spark, sf_dir)
    return soh.current_soh(table, discharges)


@query("prj_state_from_soh", "cell_id:s cycle:i state:s",
       """SELECT cell_id, cycle, CASE WHEN soh_window >= 0.95 THEN 'HEALTHY' WHEN soh_window >= 0.9 THEN 'WARNING'
          WHEN soh_window >= 0.8 THEN 'DEGRADED' WHEN soh_window IS NOT NULL THEN 'CRITICAL' END AS state FROM s_t1""")
def _(spark, sf_dir):
    table = soh.soh_table(_charges(spark, sf_dir)[1])
    return table.withColumn("state", soh.state_from_soh(F.col("soh_window")))
