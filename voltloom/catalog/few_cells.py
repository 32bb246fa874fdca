"""Registered queries: what a few measured cells of an unseen cohort are worth.

The SQL refits every model from rows, fold by fold and draw by draw.
"""

from __future__ import annotations

from voltloom.catalog.base import query
from voltloom.catalog.evaluation import TEMP, _rows
from voltloom.catalog.views import VIEWS, draw_sql
from voltloom.operators import evaluate, few_cells
from voltloom.session import staged

_CODE = "CAST('0x' || substr(md5({c}),1,8) AS BIGINT)"


def _position(seed: int, last: str) -> str:
    return f"{draw_sql(seed, 'k', 'draw', 'code', last)} % ({last} + 1)"


def _two(seed: int, n: str) -> str:
    """One or two different positions below n: the second is n - 1 where it would repeat the first."""
    one, two = _position(seed, f"({n} - 2)"), _position(seed, f"({n} - 1)")
    return f"CASE WHEN k = 1 THEN [{two}] ELSE [{one}, CASE WHEN {two} = {one} THEN {n} - 1 ELSE {two} END] END"


VIEWS["fc_base"] = """
SELECT m.model, t.cohort, t.cell_id, t.cumulative_fade AS y, CASE WHEN m.model = 'temp' THEN t.avg_temp ELSE t.cycle END AS q
FROM v_rows t, (SELECT unnest(['temp', 'age_linear']) AS model) m
WHERE t.cohort IS NOT NULL AND CASE WHEN m.model = 'temp' THEN t.avg_temp ELSE t.cycle END IS NOT NULL"""
VIEWS["fc_cells"] = f"""
SELECT model, cohort, cell_id, count(*) OVER (PARTITION BY model, cohort) AS n, count(*) OVER (PARTITION BY model) AS total,
  rank() OVER (PARTITION BY model ORDER BY cohort) - 1 AS first_g,
  row_number() OVER (PARTITION BY model ORDER BY cohort, {_CODE.format(c='cell_id')}, cell_id) - 1 AS g
FROM (SELECT DISTINCT model, cohort, cell_id FROM fc_base) d"""
VIEWS["fc_plan"] = f"""
SELECT c.*, {_CODE.format(c='cohort')} AS code, CAST(kk.k AS BIGINT) AS k, CAST(dd.draw AS BIGINT) AS draw
FROM (SELECT DISTINCT model, cohort, n, total, first_g FROM fc_cells) c, (SELECT unnest([1, 2]) AS k) kk, (SELECT unnest(range(0, 20)) AS draw) dd
WHERE c.n > kk.k"""
VIEWS["fc_picks"] = f"""
SELECT model, cohort, k, draw, true AS own, first_g + t AS g FROM (SELECT *, unnest({_two(few_cells.SEED, 'n')}) AS t FROM fc_plan) a
UNION ALL
SELECT model, cohort, k, draw, false, CASE WHEN t < first_g THEN t ELSE t + n END FROM (
  SELECT *, unnest({_two(few_cells.SEED + 1, '(total - n)')}) AS t FROM fc_plan WHERE total - n >= k) b"""
VIEWS["fc_train"] = """
SELECT f.model, f.cohort, regr_slope(y, q) AS m, regr_intercept(y, q) AS b, avg(y) AS train_mean
FROM (SELECT DISTINCT model, cohort FROM fc_base) f JOIN fc_base t ON t.model = f.model AND t.cohort <> f.cohort GROUP BY f.model, f.cohort"""
VIEWS["fc_picked_rows"] = """
SELECT p.model, p.cohort, p.k, p.draw, p.own, r.y, r.q, t.b + t.m*r.q AS pred FROM fc_picks p
JOIN fc_cells c ON c.model = p.model AND c.g = p.g JOIN fc_base r ON r.model = c.model AND r.cohort = c.cohort AND r.cell_id = c.cell_id
JOIN fc_train t ON t.model = p.model AND t.cohort = p.cohort"""
VIEWS["fc_gain"] = """
SELECT model, cohort, k, draw, own, gain, my - gain*mp AS shift, my - mp AS plain, my, lm, lb FROM (
  SELECT model, cohort, k, draw, own, avg(y) AS my, avg(pred) AS mp, regr_slope(y, q) AS lm, regr_intercept(y, q) AS lb,
    CASE WHEN max(q) > min(q) THEN regr_slope(y, pred) ELSE 1 END AS gain
  FROM fc_picked_rows GROUP BY model, cohort, k, draw, own) a"""
VIEWS["fc_pooled"] = """
SELECT model, cohort, k, draw, regr_slope(y, q) AS pm, regr_intercept(y, q) AS pb FROM (
  SELECT model, cohort, k, draw, y, q FROM fc_picked_rows WHERE own UNION ALL
  SELECT p.model, p.cohort, p.k, p.draw, r.y, r.q FROM fc_plan p JOIN fc_base r ON r.model = p.model AND r.cohort <> p.cohort) a
GROUP BY model, cohort, k, draw"""
VIEWS["fc_held"] = """
SELECT p.model, p.cohort, p.n, p.k, p.draw, r.y, r.q FROM fc_plan p JOIN fc_cells c ON c.model = p.model AND c.cohort = p.cohort
JOIN fc_base r ON r.model = c.model AND r.cohort = c.cohort AND r.cell_id = c.cell_id
LEFT JOIN fc_picks x ON x.own AND x.model = p.model AND x.cohort = p.cohort AND x.k = p.k AND x.draw = p.draw AND x.g = c.g
WHERE x.g IS NULL"""
_PRED = {"raw": "t.b + t.m*h.q", "affine": "a.gain*(t.b + t.m*h.q) + a.shift", "offset_only": "t.b + t.m*h.q + a.plain",
         "local_fit": "a.lb + a.lm*h.q", "pooled": "u.pb + u.pm*h.q", "cell_mean": "a.my", "shuffled": "f.gain*(t.b + t.m*h.q) + f.shift"}
_ON = "{a}.model = h.model AND {a}.cohort = h.cohort AND {a}.k = h.k AND {a}.draw = h.draw"
VIEWS["fc_scores"] = f"""
SELECT h.model, h.cohort, h.k, h.draw, max(h.n) AS n_cells, {", ".join(
    f"1 - sum(pow(h.y - ({e}), 2))/sum(pow(h.y - t.train_mean, 2)) AS {a}" for a, e in _PRED.items())}
FROM fc_held h JOIN fc_train t ON t.model = h.model AND t.cohort = h.cohort JOIN fc_gain a ON a.own AND {_ON.format(a='a')}
LEFT JOIN fc_gain f ON NOT f.own AND {_ON.format(a='f')} JOIN fc_pooled u ON {_ON.format(a='u')} GROUP BY h.model, h.cohort, h.k, h.draw"""
VIEWS["fc_folds"] = f"""
SELECT model, cohort, k, max(n_cells) AS n_cells, {", ".join(f"avg({a}) AS {a}" for a in few_cells.ARMS)}
FROM fc_scores GROUP BY model, cohort, k"""
VIEWS["fc_tall"] = "\nUNION ALL\n".join(f"SELECT '{a}' AS arm, {a} AS r2 FROM fc_folds WHERE {a} IS NOT NULL" for a in few_cells.ARMS)
VIEWS["fc_pairs"] = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS rival, model || '/' || cohort || '/' || k AS fold, round(affine - {a}, 8) AS gain FROM fc_folds WHERE affine - {a} IS NOT NULL"
    for a in ("raw", "local_fit", "pooled", "shuffled"))
VIEWS["fc_numbered"] = f"""
SELECT *, row_number() OVER (PARTITION BY rival ORDER BY {_CODE.format(c='fold')}, fold) AS i, count(*) OVER (PARTITION BY rival) AS n FROM fc_pairs"""
VIEWS["fc_medians"] = f"""
SELECT d.rival, d.rep, quantile_cont(v.gain, 0.5) AS m FROM (
  SELECT rival, rep, 1 + {draw_sql(7, 'CAST(rep AS BIGINT)', 'CAST(i AS BIGINT)')} % n AS pick FROM fc_numbered, range(1, 2001) r(rep)) d
JOIN fc_numbered v ON v.rival = d.rival AND v.i = d.pick GROUP BY d.rival, d.rep"""


def _folds(spark, sf_dir):
    return few_cells.few_cell_calibration(_rows(spark, sf_dir), [TEMP, evaluate.AGE_LINEAR], "cumulative_fade")


@query("val_few_cell_calibration", "model:s cohort:s k:i n_cells:i " + " ".join(f"{a}:d3" for a in few_cells.ARMS),
       "SELECT * FROM fc_folds")
def _(spark, sf_dir):
    return _folds(spark, sf_dir)


@query("val_few_cell_risk", "arm:s n_folds:i median:d3 q10:d3 worst:d3 below_zero:d6 below_minus_one:d6",
       """SELECT arm, count(*) AS n_folds, quantile_cont(r2, 0.5) AS median, quantile_cont(r2, 0.1) AS q10, min(r2) AS worst,
          avg(CASE WHEN r2 < 0 THEN 1.0 ELSE 0.0 END) AS below_zero, avg(CASE WHEN r2 < -1 THEN 1.0 ELSE 0.0 END) AS below_minus_one
          FROM fc_tall GROUP BY arm""")
def _(spark, sf_dir):
    return few_cells.few_cell_risk(staged(_folds(spark, sf_dir)))


@query("val_few_cell_paired", "rival:s n_folds:i wins:i median_gain:d3 ci_low:d3 ci_high:d3 verdict:s",
       """SELECT p.rival, p.n_folds, p.wins, p.median_gain, c.ci_low, c.ci_high,
          CASE WHEN c.ci_low > 0 THEN 'better' WHEN c.ci_high < 0 THEN 'worse' ELSE 'not told apart' END AS verdict FROM (
            SELECT rival, count(*) AS n_folds, count(CASE WHEN gain > 0 THEN 1 END) AS wins, quantile_cont(gain, 0.5) AS median_gain
            FROM fc_pairs GROUP BY rival) p LEFT JOIN (
            SELECT rival, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM fc_medians GROUP BY rival) c
          ON c.rival = p.rival""")
def _(spark, sf_dir):
    return few_cells.few_cell_paired(staged(_folds(spark, sf_dir)))
