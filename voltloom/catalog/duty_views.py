"""SQL twins of the sequence tables (phases, curves, resistance, state of health)."""

from __future__ import annotations

from voltloom.catalog.views import VIEWS

VIEWS["fx_noisy"] = """
SELECT cell_id, rn, cyc, pos, test_time_s,
  CASE WHEN rn % 53 = 0 THEN NULL WHEN rn % 37 = 0 THEN CAST(0 AS DOUBLE)
       WHEN rn % 61 = 0 THEN -current_a ELSE current_a END AS current_a, voltage_v, temperature_c
FROM fx_duty
"""


def phase_views(prefix: str, source: str) -> dict[str, str]:
    """Phases by gaps and islands over a whole-cell window."""
    p = prefix
    return {
        f"{p}_lab": f"""
SELECT *, CASE WHEN current_a IS NULL OR abs(current_a) < 0.5 THEN 'rest'
    WHEN current_a < 0 THEN 'discharge' ELSE 'charge' END AS lab FROM {source}""",
        f"{p}_raw": f"""
SELECT *, sum(turn) OVER (PARTITION BY cell_id ORDER BY test_time_s) AS raw_no
FROM (SELECT *, CASE WHEN lab IS NOT DISTINCT FROM lag(lab) OVER (PARTITION BY cell_id ORDER BY test_time_s)
        THEN 0 ELSE 1 END AS turn FROM {p}_lab) a""",
        f"{p}_kept": f"""
SELECT *, last_value(CASE WHEN n >= 3 OR raw_no = 1 THEN lab END IGNORE NULLS)
    OVER (PARTITION BY cell_id ORDER BY raw_no ROWS UNBOUNDED PRECEDING) AS kind
FROM (SELECT cell_id, raw_no, count(*) AS n, min(lab) AS lab FROM {p}_raw GROUP BY cell_id, raw_no) r""",
        f"{p}_no": f"""
SELECT cell_id, raw_no, kind, sum(turn) OVER (PARTITION BY cell_id ORDER BY raw_no) AS phase_no
FROM (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER (PARTITION BY cell_id ORDER BY raw_no)
        THEN 0 ELSE 1 END AS turn FROM {p}_kept) k""",
        f"{p}_samples": f"""
SELECT r.*, n.kind, n.phase_no FROM {p}_raw r JOIN {p}_no n ON r.cell_id = n.cell_id AND r.raw_no = n.raw_no""",
        f"{p}_steps_ah": f"""
SELECT *, coalesce((abs(current_a)+abs(lag(current_a) OVER w))/2*(test_time_s-lag(test_time_s) OVER w)/3600.0,0) AS step_ah,
  coalesce(abs((current_a+lag(current_a) OVER w)/2)*(test_time_s-lag(test_time_s) OVER w)/3600.0,0) AS step_q
FROM {p}_samples WHERE current_a IS NOT NULL
WINDOW w AS (PARTITION BY cell_id, phase_no ORDER BY test_time_s)""",
        f"{p}_phases": f"""
SELECT s.cell_id, s.phase_no, min(s.kind) AS kind, min(s.test_time_s) AS start_time_s, max(s.test_time_s) AS end_time_s,
  count(*) AS n_samples, avg(s.current_a) AS mean_current_a, coalesce(sum(a.step_ah),0) AS charge_ah,
  coalesce(sum(a.step_q),0) AS curve_ah, avg(s.temperature_c) AS avg_temp, max(s.temperature_c) AS max_temp
FROM {p}_samples s LEFT JOIN {p}_steps_ah a ON s.cell_id = a.cell_id AND s.test_time_s = a.test_time_s
GROUP BY s.cell_id, s.phase_no""",
        f"{p}_dis": f"""
SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY phase_no) AS cycle,
  max(charge_ah) OVER (PARTITION BY cell_id) AS largest FROM {p}_phases WHERE kind = 'discharge'""",
        f"{p}_measured": f"""
SELECT *, charge_ah AS capacity_ah, charge_ah/largest >= 0.8 AS is_complete FROM {p}_dis""",
    }


VIEWS.update(phase_views("n", "fx_noisy"))
VIEWS.update(phase_views("d", "fx_duty"))

VIEWS["d_step"] = """
SELECT c.cell_id, c.cycle, c.phase_no, c.mean_current_a,
  CASE WHEN quiet THEN v_prev END AS v_rest_v,
  CASE WHEN quiet AND abs(i0-i_prev) >= 0.05 AND v_prev - v0 > 0 THEN (v_prev-v0)/abs(i0-i_prev) END AS r_step_ohm
FROM (SELECT d.*, f.v0, f.i0, f.v_prev, f.i_prev, f.t_prev IS NOT NULL
        AND abs(f.i_prev) <= greatest(CAST(0.5 AS DOUBLE), CAST(0.05 AS DOUBLE)*abs(f.i0)) AND f.t0 - f.t_prev <= 60 AS quiet
      FROM d_dis d JOIN (SELECT cell_id, test_time_s AS t0, voltage_v AS v0, current_a AS i0,
            lag(test_time_s) OVER w AS t_prev, lag(voltage_v) OVER w AS v_prev, lag(current_a) OVER w AS i_prev
          FROM fx_duty WINDOW w AS (PARTITION BY cell_id ORDER BY test_time_s)) f
      ON d.cell_id = f.cell_id AND d.start_time_s = f.t0 WHERE d.n_samples >= 2) c
"""


def screened_sql(source: str) -> str:
    """The screen as a fold over the ordered list of a cell's steps."""
    return f"""
SELECT s.*, CASE WHEN r_step_ohm IS NULL OR list_contains(f.kept, s.cycle) THEN r_step_ohm END AS r_ok_ohm
FROM {source} s LEFT JOIN (
  SELECT cell_id, list_transform(list_reduce(steps, lambda acc, e:
     CASE WHEN e[1].r >= 0.25 * list_median(list_transform(acc[1:5], lambda a: a.r))
          THEN list_concat(acc, e) ELSE acc END), lambda a: a.c) AS kept
  FROM (SELECT cell_id, list([struct_pack(c := cycle, r := r_step_ohm)] ORDER BY cycle) AS steps
        FROM {source} WHERE r_step_ohm IS NOT NULL GROUP BY cell_id) l) f ON s.cell_id = f.cell_id"""


VIEWS["d_screened"] = screened_sql("d_step")
VIEWS["d_trail"] = """
SELECT *, abs(mean_current_a)*r_trailing_ohm AS ir_drop_v FROM (
  SELECT *, last_value(med IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS r_trailing_ohm
  FROM (SELECT *, quantile_cont(r_ok_ohm, 0.5) OVER (PARTITION BY cell_id ORDER BY cycle
      ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS med FROM d_screened) a) b
"""
VIEWS["d_curve"] = """
SELECT s.cell_id, d.cycle, s.test_time_s, s.voltage_v, s.current_a,
  sum(a.step_q) OVER (PARTITION BY s.cell_id, s.phase_no ORDER BY s.test_time_s) AS capacity_ah_curve
FROM d_samples s JOIN d_steps_ah a ON s.cell_id = a.cell_id AND s.test_time_s = a.test_time_s
JOIN d_dis d ON s.cell_id = d.cell_id AND s.phase_no = d.phase_no
"""


def window_sql(curve: str, lo: str, hi: str, keys: str = "cell_id, cycle", extra: str = "") -> str:
    """Bracket form of the window charge; lo/hi are columns or expressions over the curve rows."""
    def br(x: str, n: str) -> str:
        return (f"max_by(struct_pack(v := voltage_v, q := capacity_ah_curve), struct_pack(v := voltage_v, t := test_time_s)) "
                f"FILTER (voltage_v <= {x}) AS {n}a, "
                f"min_by(struct_pack(v := voltage_v, q := capacity_ah_curve), struct_pack(v := voltage_v, t := test_time_s)) "
                f"FILTER (voltage_v >= {x}) AS {n}b")

    def at(x: str, n: str) -> str:
        return (f"CASE WHEN {n}a.v = {n}b.v THEN {n}a.q ELSE {n}a.q + ({n}b.q-{n}a.q)*(({x}-{n}a.v)/nullif({n}b.v-{n}a.v,0)) END")

    return f"""
SELECT *, CASE WHEN n >= 2 AND least(vmax, hi) - greatest(vmin, lo) >= 0.95*(hi-lo)
   THEN abs(({at('lo', 'l')}) - ({at('hi', 'h')})) END AS window_charge_ah
FROM (SELECT {keys}, count(*) AS n, min(voltage_v) AS vmin, max(voltage_v) AS vmax, min(lo) AS lo, min(hi) AS hi,
   max(capacity_ah_curve) AS cycle_charge_ah, {br('lo', 'l')}, {br('hi', 'h')}{extra}
   FROM (SELECT *, {lo} AS lo, {hi} AS hi FROM {curve}) c GROUP BY {keys}) g"""


VIEWS["d_shifted"] = """
SELECT c.*, t.ir_drop_v, t.r_trailing_ohm FROM d_curve c JOIN d_trail t
ON c.cell_id = t.cell_id AND c.cycle = t.cycle WHERE t.ir_drop_v IS NOT NULL
"""
VIEWS["d_plain_charge"] = window_sql("d_curve", "CAST(3.6 AS DOUBLE)", "CAST(3.9 AS DOUBLE)")
VIEWS["d_charge"] = window_sql(
    "d_shifted", "CAST(3.6 AS DOUBLE)-ir_drop_v", "CAST(3.9 AS DOUBLE)-ir_drop_v",
    extra=", min(ir_drop_v) AS ir_drop_v, min(r_trailing_ohm) AS r_trailing_ohm")


def soh_views(prefix: str, charges: str, discharges: str) -> dict[str, str]:
    p = prefix
    return {
        f"{p}_ref": f"""
SELECT cell_id, quantile_cont(window_charge_ah, 0.5) AS wref, quantile_cont(cycle_charge_ah, 0.5) AS tref,
  count(*) AS nref, max(cycle) AS last_ref FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS rk FROM {charges}
  WHERE window_charge_ah IS NOT NULL) a WHERE rk <= 5 GROUP BY cell_id""",
        f"{p}_t1": f"""
SELECT *, coalesce(avg(CASE WHEN soh_window IS NOT NULL THEN CAST(implausible AS DOUBLE) END)
    OVER (PARTITION BY cell_id) > 0.2, false) AS cell_refused0 FROM (
 SELECT *, coalesce(soh_window < 0.5, false) AS implausible FROM (
  SELECT *, CASE WHEN NOT partial_discharge AND wref > 0 THEN window_charge_ah / wref END AS soh_window FROM (
   SELECT c.*, r.wref, r.tref, r.nref, r.last_ref,
     coalesce(r.tref > 0 AND c.cycle_charge_ah < 0.5*r.tref, false) AS partial_discharge
   FROM {charges} c LEFT JOIN {p}_ref r ON c.cell_id = r.cell_id) a) b) c""",
        f"{p}_efc": f"""
SELECT r.cell_id, sum(d.charge_ah)/min(r.tref) AS efc FROM {p}_ref r JOIN {discharges} d
ON d.cell_id = r.cell_id AND d.cycle <= r.last_ref WHERE r.nref >= 5 AND r.tref > 0 GROUP BY r.cell_id""",
        f"{p}_gated": f"""
SELECT *, cell_refused0 OR late AS cell_refused,
  CASE WHEN NOT late AND NOT high AND NOT implausible AND NOT cell_refused0 THEN soh_window END AS soh_window_accepted,
  CASE WHEN late THEN 'late' WHEN high THEN 'high' WHEN cell_refused0 THEN 'cell' WHEN implausible THEN 'implausible'
       WHEN partial_discharge THEN 'partial' ELSE '' END AS why
FROM (SELECT t.*, e.efc AS reference_efc, NOT coalesce(e.efc <= 20, false) AS late, coalesce(t.soh_window > 1.1, false) AS high
      FROM {p}_t1 t LEFT JOIN {p}_efc e ON t.cell_id = e.cell_id) g""",
        f"{p}_acc": f"""
SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS up FROM {p}_gated WHERE soh_window_accepted IS NOT NULL""",
        f"{p}_after": f"""
SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle DESC) AS back FROM {p}_acc WHERE up > 5""",
        f"{p}_head": f"""
SELECT cell_id, quantile_cont(r_trailing_ohm, 0.5) AS r0, list(window_charge_ah ORDER BY cycle) AS heads
FROM {p}_acc WHERE up <= 5 GROUP BY cell_id""",
        f"{p}_fit": f"""
SELECT cell_id, regr_slope(soh_window_accepted, -back) AS m, regr_intercept(soh_window_accepted, -back) AS b, count(*) AS n
FROM {p}_after WHERE back <= 10 GROUP BY cell_id""",
        f"{p}_resid": f"""
SELECT a.cell_id, f.n, quantile_cont(abs(res - mres), 0.5) AS mad FROM (
  SELECT a.cell_id, soh_window_accepted - (b + m*(-back)) AS res,
    quantile_cont(soh_window_accepted - (b + m*(-back)), 0.5) OVER (PARTITION BY a.cell_id) AS mres
  FROM {p}_after a JOIN {p}_fit f0 ON a.cell_id = f0.cell_id WHERE back <= 10) a
 JOIN {p}_fit f ON a.cell_id = f.cell_id GROUP BY a.cell_id, f.n""",
        f"{p}_tail": f"""
SELECT cell_id, quantile_cont(soh_window_accepted, 0.5) FILTER (back <= 5) AS soh,
  quantile_cont(r_trailing_ohm, 0.5) FILTER (back <= 5) AS r1, max(cycle) AS at_cycle
FROM {p}_after GROUP BY cell_id""",
        f"{p}_report": f"""
SELECT *, CASE WHEN code = 'ok' THEN soh0 END AS soh, CASE WHEN code = 'ok' THEN r1/r0 END AS resistance_growth,
  CASE WHEN code = 'ok' AND nfit >= 4 THEN sqrt(
    pow(CAST(1.2533 AS DOUBLE)*list_median(list_transform(heads, lambda x: abs(x - list_median(heads))))/sqrt(5.0)/list_median(heads), 2)
    + pow(CAST(1.2533 AS DOUBLE)*mad/sqrt(5.0), 2)) END AS uncertainty
FROM (SELECT n.cell_id, n.n_discharges, g.n_measurable, g.n_accepted, t.soh AS soh0, t.at_cycle, h.r0, t.r1, h.heads, x.mad, x.n AS nfit,
   CASE WHEN g.cell_id IS NULL THEN 'unread' WHEN g.n_measurable <= 5 THEN 'few' WHEN g.refused THEN 'refused'
        WHEN t.soh IS NULL THEN 'few' ELSE 'ok' END AS code
 FROM (SELECT cell_id, count(*) AS n_discharges FROM {discharges} GROUP BY cell_id) n
 LEFT JOIN (SELECT cell_id, count(window_charge_ah) AS n_measurable, count(soh_window_accepted) AS n_accepted,
     bool_or(cell_refused) AS refused FROM {p}_gated GROUP BY cell_id) g ON n.cell_id = g.cell_id
 LEFT JOIN {p}_head h ON n.cell_id = h.cell_id LEFT JOIN {p}_tail t ON n.cell_id = t.cell_id
 LEFT JOIN {p}_resid x ON n.cell_id = x.cell_id) r""",
    }


VIEWS.update(soh_views("s", "d_charge", "d_dis"))
