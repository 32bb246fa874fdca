"""SQL twins of the fixture views and of the shared intermediate tables."""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["fx_telemetry"] = """
SELECT cell_id, cycle, seq, test_time_s, soc, temperature_c,
  CAST(CASE WHEN event_type IN ('purchase','error') THEN -(value/25.0)
       WHEN event_type IN ('click','signup') THEN value/25.0 ELSE 0.0 END AS DOUBLE) AS current_a,
  3.0 + soc*CAST(0.012 AS DOUBLE) AS voltage_v
FROM (SELECT concat('CELL_', CAST(user_id AS VARCHAR)) AS cell_id, event_type, value,
        ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
        CAST(floor((ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1)/4.0) AS INT)+1 AS cycle,
        ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id)*CAST(30 AS DOUBLE) AS test_time_s,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS soc,
        20.0 + value/8.0 AS temperature_c
      FROM events) e
"""

VIEWS["fx_duty"] = """
SELECT cell_id, rn, cyc, pos, CAST(rn*60 AS DOUBLE) AS test_time_s,
  CAST(CASE WHEN pos BETWEEN 4 AND 19 THEN -1.5 WHEN pos>=22 THEN 3.0 ELSE 0.0 END AS DOUBLE) AS current_a,
  CAST(CASE WHEN pos<4 THEN 4.15
       WHEN pos<=19 THEN CAST(4.06 AS DOUBLE) - CAST(0.045 AS DOUBLE)*(pos-4)*(1+CAST(0.01 AS DOUBLE)*cyc)
            - CAST(0.02 AS DOUBLE)*l_discount
       WHEN pos<22 THEN 3.50 ELSE CAST(3.60 AS DOUBLE)+CAST(0.065 AS DOUBLE)*(pos-22) END AS DOUBLE) AS voltage_v,
  25.0 + 100.0*CAST(l_tax AS DOUBLE) AS temperature_c
FROM (SELECT concat('CELL_', CAST(l_suppkey AS VARCHAR)) AS cell_id, l_discount, l_tax, rn,
        CAST(floor((rn-1)/30.0) AS INT) AS cyc, CAST((rn-1)%30 AS INT) AS pos
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate,l_orderkey,l_linenumber,l_partkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus) AS rn FROM lineitem) a) b
"""

VIEWS["fx_cycles"] = """
SELECT concat('CELL_', CAST(l_suppkey AS VARCHAR)) AS cell_id,
  concat('COHORT_', CAST(l_suppkey%5 AS VARCHAR)) AS cohort,
  CAST((year(l_shipdate)-1995)*12+month(l_shipdate) AS INT) AS cycle,
  CAST(2.0 AS DOUBLE) - CAST(0.0045 AS DOUBLE)*((year(l_shipdate)-1995)*12+month(l_shipdate))
    *(1+CAST(0.1 AS DOUBLE)*(l_suppkey%5)) + (avg(l_quantity)-25.5)/5000.0 AS capacity_ah,
  20.0+ 10.0*(l_suppkey%5) + avg(l_tax)*50 AS avg_temp, 20.0+10.0*(l_suppkey%5)+max(l_tax)*100 AS max_temp,
  avg(l_discount)*500 AS avg_stress, avg(l_quantity) AS avg_soc,
  CAST(count(CASE WHEN l_discount>CAST(0.08 AS DOUBLE) THEN 1 END) AS BIGINT) AS deep_discharge_duration,
  CAST(count(CASE WHEN l_returnflag='R' THEN 1 END) AS BIGINT) AS aggressive_discharge_count
FROM lineitem GROUP BY l_suppkey, (year(l_shipdate)-1995)*12+month(l_shipdate)
"""

VIEWS["flagged"] = """
SELECT *,
  CAST(coalesce(current_a/2.0 < -1, false) AS INT) AS aggressive_discharge_event,
  CAST(coalesce(current_a/2.0 > 1, false) AS INT) AS fast_charge_flag,
  CAST(coalesce(temperature_c > 40, false) AS INT) AS high_temp_flag,
  CAST(coalesce(soc < 20, false) AS INT) AS deep_discharge_flag,
  CAST(coalesce(soc > 90, false) AS INT) AS high_soc_flag
FROM fx_telemetry
"""

VIEWS["stressed"] = """
SELECT *, CAST(greatest(0, least(100, 30*aggressive_discharge_event + 25*high_temp_flag
  + 20*fast_charge_flag + 15*deep_discharge_flag + 10*high_soc_flag)) AS DOUBLE) AS stress_score
FROM flagged
"""

VIEWS["battery_summary"] = """
SELECT cell_id AS battery_id, avg(stress_score) AS avg_stress, avg(temperature_c) AS avg_temp,
  sum(fast_charge_flag) AS fast_charge_duration, sum(deep_discharge_flag) AS deep_discharge_duration,
  sum(high_temp_flag) AS high_temp_duration, sum(aggressive_discharge_event) AS aggressive_discharge_count,
  avg(soc) AS avg_soc
FROM stressed GROUP BY cell_id
"""


def term_sql(op: str) -> dict[str, str]:
    def steps(col: str, a: tuple, b: tuple, floor: float) -> str:
        return (f"CASE WHEN {col} {op} {a[0]} THEN {a[1]} WHEN {col} {op} {b[0]} THEN {b[1]} "
                f"ELSE {floor} END")
    return {
        "stress": steps("avg_stress", (70, 30), (50, 20), 10),
        "temperature": steps("avg_temp", (40, 25), (30, 15), 5),
        "deep_discharge": steps("deep_discharge_duration", (100, 20), (20, 10), 5),
        "fast_charge": steps("fast_charge_duration", (100, 15), (20, 8), 2),
        "aggressive_discharge": steps("aggressive_discharge_count", (500, 15), (100, 8), 2),
        "soc_extremes": "CASE WHEN avg_soc > 80 OR avg_soc < 20 THEN 10 ELSE 0 END",
    }


RISK_SQL, HEALTH_SQL = term_sql(">="), term_sql(">")
TERM_LABELS = {
    "stress": "sustained high stress", "temperature": "high temperature exposure",
    "deep_discharge": "deep discharge events", "fast_charge": "frequent fast charging",
    "aggressive_discharge": "aggressive discharge", "soc_extremes": "SOC held at extremes",
}


def total_sql(terms: dict[str, str]) -> str:
    return " + ".join(f"({t})" for t in terms.values())


VIEWS["risk_rows"] = f"""
SELECT *, CASE WHEN risk_score > 79 THEN 'CRITICAL' WHEN risk_score > 59 THEN 'HIGH'
    WHEN risk_score > 39 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN reason = '' THEN 'healthy usage' ELSE reason END AS risk_reason
FROM (SELECT *, CAST(greatest(0, least(100, {total_sql(RISK_SQL)})) AS DOUBLE) AS risk_score,
  concat_ws(', ', CASE WHEN avg_stress > 50 THEN 'high stress' END,
    CASE WHEN avg_temp > 30 THEN 'high temperature' END,
    CASE WHEN deep_discharge_duration > 20 THEN 'deep discharge' END,
    CASE WHEN fast_charge_duration > 20 THEN 'frequent fast charging' END,
    CASE WHEN aggressive_discharge_count > 100 THEN 'aggressive discharge' END,
    CASE WHEN avg_soc > 80 THEN 'high SOC exposure' END,
    CASE WHEN avg_soc < 20 THEN 'low SOC exposure' END) AS reason
  FROM battery_summary) r
"""

VIEWS["health_rows"] = f"""
SELECT *, CASE WHEN health_index >= 80 THEN 'CRITICAL' WHEN health_index >= 60 THEN 'DEGRADED'
    WHEN health_index >= 30 THEN 'WARNING' ELSE 'HEALTHY' END AS battery_state
FROM (SELECT *, 100 - aging_budget AS health_index, aging_budget AS remaining_health,
        100 - aging_budget AS consumed_life
      FROM (SELECT *, CAST(greatest(0, least(100, 100 - ({total_sql(HEALTH_SQL)}))) AS DOUBLE) AS aging_budget
            FROM battery_summary) h0) h1
"""

VIEWS["scored_rows"] = """
SELECT h.*, r.risk_score, r.risk_level, r.risk_reason
FROM health_rows h JOIN risk_rows r ON h.battery_id = r.battery_id
"""

VIEWS["life_rows"] = """
SELECT *, CASE WHEN rul_cycles < 100 THEN 'REPLACE' WHEN rul_cycles < 300 THEN 'PLAN_SERVICE'
    WHEN rul_cycles < 600 THEN 'MONITOR' ELSE 'NORMAL' END AS replacement_policy
FROM (SELECT *, CAST(round_even(estimated_total_cycles * remaining_health / 100, 0) AS BIGINT) AS rul_cycles
  FROM (SELECT *, CAST(1000 AS DOUBLE) / equivalent_aging_factor AS estimated_total_cycles
    FROM (SELECT s.*, greatest(CAST(0.05 AS DOUBLE), least(CAST(1 AS DOUBLE),
        CAST(0.40 AS DOUBLE)*(health_index/100) + CAST(0.25 AS DOUBLE)*(avg_temp/50)
        + CAST(0.20 AS DOUBLE)*(deep_discharge_duration/dd) + CAST(0.15 AS DOUBLE)*(fast_charge_duration/fc)))
        AS equivalent_aging_factor
      FROM scored_rows s, (SELECT CASE WHEN max(deep_discharge_duration)=0 THEN 1 ELSE max(deep_discharge_duration) END AS dd,
         CASE WHEN max(fast_charge_duration)=0 THEN 1 ELSE max(fast_charge_duration) END AS fc FROM scored_rows) m) l0) l1) l2
"""


def shap_sql(source: str, terms: dict[str, str], prefix: str) -> str:
    inner = ", ".join(f"CAST({t} AS DOUBLE) AS t_{n}" for n, t in terms.items())
    outer = ", ".join(f"t_{n} - avg(t_{n}) OVER () AS {prefix}shap_{n}" for n in terms)
    return f"SELECT *, {outer} FROM (SELECT *, {inner} FROM {source}) s"


def causes_sql(source: str, terms: dict[str, str], prefix: str) -> str:
    entries = ", ".join(
        f"struct_pack(m := -{prefix}shap_{n}, i := {i}, l := '{TERM_LABELS[n]}', p := {prefix}shap_{n})"
        for i, n in enumerate(terms))
    return f"""
SELECT *, CASE WHEN len(drivers) > 0 THEN array_to_string(list_transform(drivers[1:3], lambda e: e.l), ', ')
    ELSE 'normal usage' END AS {prefix}top_causes,
  CASE WHEN len(drivers) > 0 THEN array_to_string(list_transform(drivers[1:3],
    lambda e: e.l || printf(' +%.1f', e.p)), ', ') ELSE 'no term above attribution floor' END AS {prefix}top_cause_contributions,
  CASE WHEN len(drivers) > 0 THEN drivers[1].l ELSE 'normal usage' END AS {prefix}dominant_cause,
  CASE WHEN len(drivers) > 0 THEN drivers[1].p ELSE 0 END AS {prefix}dominant_contribution,
  CASE WHEN len(guards) > 0 THEN guards[1].l ELSE 'none' END AS {prefix}strongest_protective_factor,
  len(drivers) AS {prefix}n_significant_drivers
FROM (SELECT *, list_sort(list_filter([{entries}], lambda e: e.p > 0.5)) AS drivers,
   list_sort(list_transform(list_filter([{entries}], lambda e: e.p < -0.5),
     lambda e: struct_pack(m := e.p, i := e.i, l := e.l, p := e.p))) AS guards
 FROM {source}) c"""


VIEWS["shap_rows"] = shap_sql("life_rows", HEALTH_SQL, "health_")
VIEWS["cause_rows"] = causes_sql("shap_rows", HEALTH_SQL, "health_")
VIEWS["guardian_rows"] = """
SELECT *,
  CASE WHEN len(labels) = 0 THEN 'N/A' WHEN len(labels) = 1 THEN labels[1] ELSE 'MIXED' END AS evidence_confidence,
  'Battery ' || battery_id || ' is in ' || battery_state
  || ' state with an UNVALIDATED remaining-life estimate of ' || CAST(rul_cycles AS VARCHAR)
  || ' cycles. Primary degradation factors include ' || primary_causes
  || '. Recommended action: ' || recommendation AS guardian_report
FROM (SELECT *, health_top_causes AS primary_causes, health_dominant_cause AS dominant_cause,
  list_filter(list_distinct(list_transform(string_split(health_top_causes, ', '), lambda c:
     CASE c WHEN 'high temperature exposure' THEN 'VALIDATED' WHEN 'normal usage' THEN 'N/A' ELSE 'HEURISTIC' END)),
     lambda c: c <> 'N/A') AS labels,
  CASE battery_state WHEN 'CRITICAL' THEN 'High risk of battery failure'
    WHEN 'DEGRADED' THEN 'Battery performance degradation detected'
    WHEN 'WARNING' THEN 'Early degradation indicators detected' ELSE 'Battery operating normally' END AS guardian_status,
  CASE battery_state WHEN 'CRITICAL' THEN 'Immediate inspection and battery replacement'
    WHEN 'DEGRADED' THEN 'Reduce fast charging and monitor temperature'
    WHEN 'WARNING' THEN 'Maintain SOC between 20 and 80 percent' ELSE 'Continue normal operation' END AS recommendation,
  'mean temperature ' || printf('%.1f', avg_temp) || ' °C, ' || CASE WHEN avg_temp > 35 THEN 'above' ELSE 'within' END || ' the cut point of 35' AS heat_advice
 FROM cause_rows) g
"""


M = 2147483647


def draw_sql(seed: int, *parts: str) -> str:
    h = str(seed % M)
    for p in parts:
        h = f"(({h}*48271 + ({p} % {M})*16807 + 12345) % {M})"
    return f"(({h}*48271 + 11) % {M})"
