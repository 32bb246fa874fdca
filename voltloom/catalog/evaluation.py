"""Registered queries: leave-group-out evaluation, gate, conformal, transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom.catalog.base import query
from voltloom.catalog.life import cycle_frame, targets
from voltloom.catalog.views import VIEWS, draw_sql
from voltloom.operators import conformal, coverage, evaluate, life, physics
from voltloom.session import staged


def fold_views(p: str, source: str, y: str, x: str | None, group: str) -> dict[str, str]:
    """Folds by refitting on the complement of every group."""
    fit = (f"regr_slope({y}, {x}) AS m, regr_intercept({y}, {x}) AS b" if x
           else f"CAST(0 AS DOUBLE) AS m, avg({y}) AS b")
    xx = x or "0.0"
    return {
        f"{p}_fit": f"""
SELECT g.{group}, count(*) AS n_train, avg({y}) AS train_mean, {fit}, count(DISTINCT t.cohort) AS cohorts,
  regr_slope({y}, cycle) AS age_m, regr_intercept({y}, cycle) AS age_b
FROM (SELECT DISTINCT {group} FROM {source}) g JOIN {source} t ON t.{group} <> g.{group} GROUP BY g.{group}""",
        f"{p}_scored": f"""
SELECT t.*, f.train_mean, f.b + f.m*{xx} AS pred, f.age_b + f.age_m*cycle AS age_pred, f.n_train, f.cohorts
FROM {source} t JOIN {p}_fit f ON t.{group} = f.{group}""",
        f"{p}_ranks": f"""
SELECT *, rank() OVER (PARTITION BY {group} ORDER BY round(pred, 8)) + (count(*) OVER (PARTITION BY {group}, round(pred, 8)) - 1)/2.0 AS rp,
  rank() OVER (PARTITION BY {group} ORDER BY round({y}, 8)) + (count(*) OVER (PARTITION BY {group}, round({y}, 8)) - 1)/2.0 AS ry
FROM {p}_scored""",
        f"{p}_folds": f"""
SELECT {group} AS held_out, min(n_train) AS n_train, count(*) AS n_test, avg(abs({y}-pred)) AS mae,
  sqrt(avg(({y}-pred)*({y}-pred))) AS rmse, 1 - sum(({y}-pred)*({y}-pred))/sum(({y}-train_mean)*({y}-train_mean)) AS r2_vs_global_mean,
  1 - sum(({y}-pred)*({y}-pred))/(var_pop({y})*count(*)) AS r2_vs_own_mean_oracle,
  1 - sum(({y}-pred)*({y}-pred))/sum(({y}-age_pred)*({y}-age_pred)) AS r2_vs_confound_baseline,
  corr(rp, ry) AS spearman_rho
FROM {p}_ranks GROUP BY {group} HAVING count(*) >= 10""",
        f"{p}_report": f"""
SELECT c.{group} AS held_out, t.n_train, c.n AS n_test, f.mae, f.rmse, f.r2_vs_global_mean, f.r2_vs_own_mean_oracle,
  f.r2_vs_confound_baseline, f.spearman_rho, CASE WHEN c.n < 10 THEN 'test fold has ' || c.n || ' rows, below minimum 10'
    WHEN t.cohorts < 2 THEN 'training fold spans ' || t.cohorts || ' cohort(s), below minimum 2' ELSE '' END AS error
FROM (SELECT {group}, count(*) AS n FROM {source} GROUP BY {group}) c JOIN {p}_fit t ON t.{group} = c.{group}
LEFT JOIN {p}_folds f ON f.held_out = c.{group} AND t.cohorts >= 2""",
    }


VIEWS["v_rows"] = "SELECT * FROM c_targets WHERE cumulative_fade IS NOT NULL"
VIEWS.update(fold_views("vt", "v_rows", "cumulative_fade", "avg_temp", "cell_id"))
VIEWS.update(fold_views("vg", "v_rows", "cumulative_fade", "avg_temp", "cohort"))
VIEWS.update(fold_views("va", "v_rows", "cumulative_fade", "cycle", "cohort"))

FOLD = ("held_out:s n_train:i n_test:i mae:d6 rmse:d6 r2_vs_global_mean:d4 r2_vs_own_mean_oracle:d4 "
        "spearman_rho:d5 r2_vs_confound_baseline:d4 error:s")
TEMP = evaluate.ols("temp", ["avg_temp"])


def _rows(spark, sf_dir):
    return staged(targets(spark, sf_dir).where("cumulative_fade IS NOT NULL"))


@query("val_leave_group_out_cells", FOLD, "SELECT * FROM vt_report")
def _(spark, sf_dir):
    return evaluate.cross_validate(_rows(spark, sf_dir), TEMP, "cumulative_fade", "cell_id", "LOBO",
                                   evaluate.AGE_LINEAR).fillna("", ["error"])


@query("val_leave_group_out_cohorts", FOLD, "SELECT * FROM vg_report")
def _(spark, sf_dir):
    return evaluate.cross_validate(_rows(spark, sf_dir), TEMP, "cumulative_fade", "cohort", "LOCO",
                                   evaluate.AGE_LINEAR).fillna("", ["error"])


@query("val_baseline_age_line", "held_out:s n_train:i n_test:i mae:d6 rmse:d6 r2_vs_global_mean:d4 error:s",
       "SELECT * FROM va_report")
def _(spark, sf_dir):
    return evaluate.cross_validate(_rows(spark, sf_dir), evaluate.AGE_LINEAR, "cumulative_fade",
                                   "cohort", "LOCO").fillna("", ["error"])


# -- physics models ----------------------------------------------------------

VIEWS["vp_trail"] = """
SELECT cell_id, cycle, CASE WHEN count(avg_temp) OVER w >= 2 THEN avg(avg_temp) OVER w END AS trailing_avg_temp
FROM c_targets WINDOW w AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""
VIEWS["vp_rows"] = "SELECT * FROM v_rows WHERE avg_temp IS NOT NULL AND cycle IS NOT NULL"
VIEWS["vq_rows"] = """
SELECT v.*, t.trailing_avg_temp FROM v_rows v JOIN vp_trail t ON v.cell_id = t.cell_id AND v.cycle = t.cycle
WHERE t.trailing_avg_temp IS NOT NULL"""


def fade_law_views(p: str, temperature: str, group: str) -> dict[str, str]:
    """The folds of the fade law, refitted on the complement of every group."""
    out = fold_views(p, f"{p}_rows", "cumulative_fade", None, group)
    out[f"{p}_axes"] = f"""
SELECT *, CASE WHEN {temperature} > -273.15 AND cycle > 0 THEN 1000.0/({temperature} + 273.15) - 1000.0/298.15 END AS a,
  CASE WHEN {temperature} > -273.15 AND cycle > 0 THEN ln(CAST(cycle AS DOUBLE)) END AS b,
  CASE WHEN {temperature} > -273.15 AND cycle > 0 AND cumulative_fade > 0 THEN ln(cumulative_fade) END AS y FROM {p}_rows"""
    out[f"{p}_moments"] = f"""
SELECT g.{group}, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb,
  covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_
FROM (SELECT DISTINCT {group} FROM {p}_rows) g JOIN {p}_axes t ON t.{group} <> g.{group} WHERE y IS NOT NULL GROUP BY g.{group}"""
    out[f"{p}_law"] = f"""
SELECT {group}, n, ma, mb, my, (ay*bb - by_*ab)/(aa*bb - ab*ab) AS sa, (by_*aa - ay*ab)/(aa*bb - ab*ab) AS z FROM {p}_moments"""
    out[f"{p}_scored"] = f"""
SELECT t.*, f.train_mean, coalesce(CASE WHEN l.n >= 4 THEN exp(l.my + l.sa*(t.a - l.ma) + l.z*(t.b - l.mb)) END, f.train_mean) AS pred,
  f.age_b + f.age_m*t.cycle AS age_pred, f.n_train, f.cohorts
FROM {p}_axes t JOIN {p}_fit f ON t.{group} = f.{group} JOIN {p}_law l ON t.{group} = l.{group}"""
    out[f"{p}_result"] = f"""
SELECT r.*, l.n AS n_used, -l.sa*8.314462618 AS activation_kj_per_mol FROM {p}_report r JOIN {p}_law l ON l.{group} = r.held_out"""
    return out


VIEWS.update(fade_law_views("vp", "avg_temp", "cohort"))
VIEWS.update(fade_law_views("vq", "trailing_avg_temp", "cell_id"))
LAW = FOLD + " n_used:i activation_kj_per_mol:d3"


@query("val_physics_mean_temperature", LAW, "SELECT * FROM vp_result")
def _(spark, sf_dir):
    return physics.cross_validate_fade_law(_rows(spark, sf_dir), "cumulative_fade", "cohort", "LOCO", "avg_temp",
                                           evaluate.AGE_LINEAR).fillna("", ["error"])


@query("val_physics_trailing_temperature", LAW, "SELECT * FROM vq_result")
def _(spark, sf_dir):
    whole = targets(spark, sf_dir)
    past = life.trailing_features(cycle_frame(spark, sf_dir), ("avg_temp",)).select("cell_id", "cycle", "trailing_avg_temp")
    rows = staged(whole.where("cumulative_fade IS NOT NULL").join(past, ["cell_id", "cycle"]))
    return physics.cross_validate_fade_law(rows, "cumulative_fade", "cell_id", "LOBO", "trailing_avg_temp",
                                           evaluate.AGE_LINEAR).fillna("", ["error"])


SUMMARY_SQL = """
SELECT 'temp' AS model, '{s}' AS split, quantile_cont(r2_vs_global_mean, 0.5) AS median_r2_vs_global_mean,
  quantile_cont(mae, 0.5) AS median_mae, quantile_cont(spearman_rho, 0.5) AS median_spearman_rho,
  quantile_cont(r2_vs_confound_baseline, 0.5) AS median_r2_vs_confound_baseline, count(*) AS n_completed,
  avg(CASE WHEN r2_vs_global_mean > 0 THEN 1.0 ELSE 0.0 END) AS fraction_beating_baseline FROM {v}_folds"""
VIEWS["v_summary"] = SUMMARY_SQL.format(s="LOBO", v="vt") + " UNION ALL " + SUMMARY_SQL.format(s="LOCO", v="vg")


def _summary(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    both = [evaluate.cross_validate(rows, TEMP, "cumulative_fade", g, s, evaluate.AGE_LINEAR)
            for g, s in (("cell_id", "LOBO"), ("cohort", "LOCO"))]
    return evaluate.cv_summary(staged(both[0].unionByName(both[1])))


@query("val_cv_summary",
       "model:s split:s n_completed:i fraction_beating_baseline:d6 median_r2_vs_global_mean:d4 median_mae:d6 "
       "median_spearman_rho:d5 median_r2_vs_confound_baseline:d4", "SELECT * FROM v_summary")
def _(spark, sf_dir):
    return _summary(spark, sf_dir)


@query("val_promotion_gate", "model:s status:s lobo_median_r2:d4 loco_median_r2:d4 lobo_minus_loco_r2:d4 reasons:s",
       """SELECT a.model, CASE WHEN a.median_r2_vs_global_mean > 0 AND b.median_r2_vs_global_mean > 0
            AND b.fraction_beating_baseline >= 0.5 AND a.median_r2_vs_confound_baseline > 0
            AND b.median_r2_vs_confound_baseline > 0 THEN 'PROMOTE' ELSE 'REJECT' END AS status,
          a.median_r2_vs_global_mean AS lobo_median_r2, b.median_r2_vs_global_mean AS loco_median_r2,
          a.median_r2_vs_global_mean - b.median_r2_vs_global_mean AS lobo_minus_loco_r2,
          concat_ws('; ', CASE WHEN NOT coalesce(a.median_r2_vs_global_mean > 0, false) THEN 'LOBO median R2 vs training mean is not above 0' END,
            CASE WHEN NOT coalesce(b.median_r2_vs_global_mean > 0, false) THEN 'LOCO median R2 vs training mean is not above 0' END,
            CASE WHEN NOT coalesce(b.fraction_beating_baseline >= 0.5, false) THEN 'fewer than half of the held-out protocols beat the baseline' END,
            CASE WHEN a.median_r2_vs_confound_baseline <= 0 THEN 'LOBO does not improve on the age line' END,
            CASE WHEN b.median_r2_vs_confound_baseline <= 0 THEN 'LOCO does not improve on the age line' END,
            CASE WHEN a.median_r2_vs_global_mean - b.median_r2_vs_global_mean > CAST(0.1 AS DOUBLE)
              THEN 'NOTE: LOBO exceeds LOCO; skill is concentrated within known protocols' END,
            CASE WHEN a.median_r2_vs_global_mean > 0 AND b.median_r2_vs_global_mean > 0 AND b.fraction_beating_baseline >= 0.5
              AND NOT coalesce(a.median_r2_vs_confound_baseline <= 0, false) AND NOT coalesce(b.median_r2_vs_confound_baseline <= 0, false)
              THEN 'Beats the training-mean baseline out-of-sample on both splits' END) AS reasons
          FROM v_summary a JOIN v_summary b ON a.model = b.model WHERE a.split = 'LOBO' AND b.split = 'LOCO'""")
def _(spark, sf_dir):
    return evaluate.promotion_gate(staged(_summary(spark, sf_dir))).withColumn("reasons", F.array_join("reasons", "; "))


VIEWS["b_folds"] = "SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5(held_out),1,8) AS BIGINT), held_out) AS i, count(*) OVER () AS n FROM vt_folds"
VIEWS["b_medians"] = f"""
SELECT rep, quantile_cont(f.mae, 0.5) AS m FROM (
  SELECT rep, pos, 1 + {draw_sql(7, 'CAST(rep AS BIGINT)', 'CAST(pos AS BIGINT)')} % (SELECT count(*) FROM b_folds) AS pick
  FROM range(1, 2001) r(rep), (SELECT i AS pos FROM b_folds) p) d JOIN b_folds f ON f.i = d.pick GROUP BY rep"""


@query("sta_bootstrap_median_ci", "n_folds:i ci_low:d6 ci_high:d6",
       """SELECT (SELECT count(*) FROM b_folds) AS n_folds, quantile_cont(m, 0.025) AS ci_low,
          quantile_cont(m, 0.975) AS ci_high FROM b_medians""")
def _(spark, sf_dir):
    folds = evaluate.cross_validate(_rows(spark, sf_dir), TEMP, "cumulative_fade", "cell_id", "LOBO")
    done = staged(folds.where("error IS NULL"))
    return evaluate.bootstrap_median_ci(done, ["model"], "mae", "held_out")


VIEWS["k_ranked"] = f"""
SELECT cell_id, row_number() OVER (ORDER BY h, cell_id) AS cell_rank, count(*) OVER () AS n FROM (
  SELECT DISTINCT cell_id, {draw_sql(7, "CAST('0x' || substr(md5(cell_id),1,8) AS BIGINT)")} AS h FROM v_rows) a"""
VIEWS["k_cells"] = """
SELECT cell_id, cell_rank, cell_rank <= greatest(1, round_even(n*0.3, 0)) AS is_calibration FROM k_ranked"""
VIEWS["k_fit"] = """
SELECT regr_slope(cumulative_fade, cycle) AS m, regr_intercept(cumulative_fade, cycle) AS b
FROM v_rows v JOIN k_cells k ON v.cell_id = k.cell_id WHERE NOT is_calibration"""
VIEWS["k_scores"] = """
SELECT v.cohort, abs(cumulative_fade - (b + m*cycle)) AS score FROM v_rows v
JOIN k_cells k ON v.cell_id = k.cell_id, k_fit WHERE is_calibration"""


@query("srt_group_holdout_split", "cell_id:s is_calibration:b", "SELECT * FROM k_cells")
def _(spark, sf_dir):
    return conformal.holdout_cells(_rows(spark, sf_dir))


@query("val_split_conformal", "cell_id:s cycle:i prediction:d6 lower:d6 upper:d6 refusal:s",
       """SELECT cell_id, cycle, b + m*cycle AS prediction, b + m*cycle - q AS lower, b + m*cycle + q AS upper, '' AS refusal
          FROM v_rows, k_fit, (SELECT max(score) FILTER (rk = ceil((n+1)*CAST(0.9 AS DOUBLE))) AS q FROM (
            SELECT score, row_number() OVER (ORDER BY score) AS rk, count(*) OVER () AS n FROM k_scores) s) z""")
def _(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return conformal.split_conformal(rows, rows, evaluate.AGE_LINEAR, "cumulative_fade")


VIEWS["k_mond"] = """
SELECT v.cell_id, v.cycle, v.cohort, v.cumulative_fade, b + m*cycle AS pred, q, n FROM v_rows v CROSS JOIN k_fit LEFT JOIN (
  SELECT cohort, max(n) AS n, max(score) FILTER (rk = ceil((n+1)*CAST(0.9 AS DOUBLE))) AS q FROM (
    SELECT cohort, score, row_number() OVER (PARTITION BY cohort ORDER BY score) AS rk, count(*) OVER (PARTITION BY cohort) AS n
    FROM k_scores) s GROUP BY cohort) z ON v.cohort = z.cohort"""


@query("val_mondrian_conformal", "cell_id:s cycle:i lower:d6 upper:d6 refusal:s",
       """SELECT cell_id, cycle, pred - q AS lower, pred + q AS upper,
          CASE WHEN n IS NULL THEN 'no calibration data for this cohort' WHEN q IS NULL THEN 'no finite interval for this cohort'
          ELSE '' END AS refusal FROM k_mond""")
def _(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return conformal.split_conformal(rows, rows, evaluate.AGE_LINEAR, "cumulative_fade", cohort="cohort")


@query("val_empirical_coverage",
       "cohort:s coverage:d6 mean_width:d6 n_quoted:i n_refused:i refusal_rate:d6",
       """SELECT cohort, avg(CASE WHEN q IS NOT NULL THEN CASE WHEN cumulative_fade BETWEEN pred-q AND pred+q THEN 1.0 ELSE 0.0 END END) AS coverage,
          avg(2*q) AS mean_width, count(q) AS n_quoted, count(*) - count(q) AS n_refused,
          1 - count(q)/CAST(count(*) AS DOUBLE) AS refusal_rate FROM k_mond GROUP BY cohort""")
def _(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    quoted = conformal.split_conformal(rows, rows, evaluate.AGE_LINEAR, "cumulative_fade", cohort="cohort")
    return conformal.empirical_coverage(quoted, "cumulative_fade", ["cohort"])


VIEWS["l_cells"] = """
SELECT f.cohort AS fold, c.cell_id, row_number() OVER (PARTITION BY f.cohort ORDER BY k.cell_rank) AS r,
  count(*) OVER (PARTITION BY f.cohort) AS n
FROM (SELECT DISTINCT cohort FROM v_rows) f, (SELECT DISTINCT cohort, cell_id FROM v_rows) c
JOIN k_cells k ON k.cell_id = c.cell_id WHERE c.cohort <> f.cohort"""
VIEWS["l_fit"] = """
SELECT fold, regr_slope(cumulative_fade, cycle) AS m, regr_intercept(cumulative_fade, cycle) AS b FROM l_cells l
JOIN v_rows v ON v.cell_id = l.cell_id WHERE r > greatest(1, round_even(n*0.3, 0)) GROUP BY fold"""
VIEWS["l_q"] = """
SELECT fold, max(n) AS nc, max(score) FILTER (rk = ceil((n+1)*CAST(0.9 AS DOUBLE))) AS q FROM (
  SELECT l.fold, abs(cumulative_fade - (f.b + f.m*cycle)) AS score,
    row_number() OVER (PARTITION BY l.fold ORDER BY abs(cumulative_fade - (f.b + f.m*cycle))) AS rk, count(*) OVER (PARTITION BY l.fold) AS n
  FROM l_cells l JOIN v_rows v ON v.cell_id = l.cell_id JOIN l_fit f ON f.fold = l.fold
  WHERE r <= greatest(1, round_even(l.n*0.3, 0))) s GROUP BY fold"""
VIEWS["l_cov"] = """
SELECT v.cohort AS held_out, avg(CASE WHEN cumulative_fade BETWEEN f.b+f.m*cycle-q AND f.b+f.m*cycle+q THEN 1.0 ELSE 0.0 END) AS coverage,
  avg(2*q) AS mean_width, count(*) AS n_quoted FROM v_rows v JOIN l_fit f ON f.fold = v.cohort JOIN l_q ON l_q.fold = v.cohort
WHERE nc >= 20 GROUP BY v.cohort"""


@query("val_cohort_coverage", "held_out:s coverage:d6 mean_width:d6 n_quoted:i", "SELECT * FROM l_cov")
def _(spark, sf_dir):
    return conformal.cohort_coverage(_rows(spark, sf_dir), evaluate.AGE_LINEAR, "cumulative_fade")


@query("srt_worst_k",
       "n_groups:i median_coverage:d6 worst_coverage:d6 worst_group:s share_below_nominal:d6",
       """SELECT count(*) AS n_groups, quantile_cont(coverage, 0.5) AS median_coverage, min(coverage) AS worst_coverage,
          min_by(held_out, struct_pack(c := coverage, h := held_out)) AS worst_group,
          avg(CASE WHEN coverage < CAST(0.9 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS share_below_nominal FROM l_cov""")
def _(spark, sf_dir):
    report = conformal.cohort_coverage(_rows(spark, sf_dir), evaluate.AGE_LINEAR, "cumulative_fade")
    return conformal.coverage_summary(staged(report))


VIEWS.update(fold_views("vm", "v_rows", "cumulative_fade", None, "cohort"))


@query("val_baseline_train_mean", "held_out:s n_train:i n_test:i mae:d6 rmse:d6 r2_vs_own_mean_oracle:d4 error:s",
       "SELECT * FROM vm_report")
def _(spark, sf_dir):
    return evaluate.cross_validate(_rows(spark, sf_dir), evaluate.TRAIN_MEAN, "cumulative_fade",
                                   "cohort", "LOCO").fillna("", ["error"])


@query("val_baseline_age_quadratic", "held_out:s n_train:i n_test:i mae:d6 rmse:d6 r2_vs_global_mean:d4 error:s")
def _(spark, sf_dir):
    return evaluate.cross_validate(_rows(spark, sf_dir), evaluate.AGE_QUADRATIC, "cumulative_fade",
                                   "cohort", "LOCO").fillna("", ["error"])


# -- skill by the number of cohorts seen ----------------------------------------
VIEWS["k_sub"] = f"""
SELECT k, rep, cohort FROM (SELECT *, row_number() OVER (PARTITION BY k, rep ORDER BY {draw_sql(coverage.SEED, 'CAST(k AS BIGINT)', 'CAST(rep AS BIGINT)', "CAST('0x' || substr(md5(cohort),1,8) AS BIGINT)")}, cohort) AS r FROM (
  SELECT c.cohort, n, unnest(range(3, n + 1)) AS k FROM (SELECT cohort, count(*) OVER () AS n FROM (SELECT cohort FROM v_rows GROUP BY cohort HAVING count(DISTINCT cell_id) >= 2) a) c) b,
  (SELECT unnest(range(0, 5)) AS rep) p WHERE k < n OR rep = 0) d WHERE r <= k"""
VIEWS["k_rows"] = """
SELECT s.k, s.rep, x.model, t.cohort, t.cell_id, t.cumulative_fade AS y, CASE WHEN x.model = 'temp' THEN t.avg_temp ELSE t.cycle END AS x
FROM k_sub s JOIN v_rows t ON s.cohort = t.cohort, (SELECT unnest(['temp', 'age_linear']) AS model) x"""


def _folds_sql(group: str) -> str:
    """Each fold refitted on the rows of the other groups of its subset."""
    return f"""
SELECT k, rep, model, quantile_cont(r2, 0.5) AS r2 FROM (
  SELECT t.k, t.rep, t.model, t.{group}, 1 - sum(pow(y - f.b - f.m*x, 2))/sum(pow(y - f.mean, 2)) AS r2 FROM k_rows t JOIN (
    SELECT g.k, g.rep, g.model, g.{group}, regr_slope(y, x) AS m, regr_intercept(y, x) AS b, avg(y) AS mean
    FROM (SELECT DISTINCT k, rep, model, {group} FROM k_rows) g JOIN k_rows t ON t.k = g.k AND t.rep = g.rep AND t.model = g.model AND t.{group} <> g.{group}
    GROUP BY g.k, g.rep, g.model, g.{group}) f ON t.k = f.k AND t.rep = f.rep AND t.model = f.model AND t.{group} = f.{group}
  GROUP BY t.k, t.rep, t.model, t.{group} HAVING count(*) >= 10) z GROUP BY k, rep, model"""


VIEWS["k_lobo"], VIEWS["k_loco"] = _folds_sql("cell_id"), _folds_sql("cohort")
VIEWS["k_points"] = """
SELECT n.k AS n_cohorts, n.rep AS repeat, n.model, n.n_cells, n.n_rows, l.r2 AS lobo_r2, c.r2 AS loco_r2, c.r2 - l.r2 AS gap FROM (
  SELECT k, rep, model, count(DISTINCT cell_id) AS n_cells, count(*) AS n_rows FROM k_rows GROUP BY k, rep, model) n
LEFT JOIN k_lobo l ON n.k = l.k AND n.rep = l.rep AND n.model = l.model LEFT JOIN k_loco c ON n.k = c.k AND n.rep = c.rep AND n.model = c.model"""


def _sweep(spark, sf_dir):
    return coverage.coverage_sweep(_rows(spark, sf_dir), [TEMP, evaluate.AGE_LINEAR], "cumulative_fade")


@query("val_coverage_sweep", "n_cohorts:i repeat:i model:s n_cells:i n_rows:i lobo_r2:d4 loco_r2:d4 gap:d4", "SELECT * FROM k_points")
def _(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query("val_coverage_sweep_summary", "model:s n_cohorts:i n_subsets:i mean_cells:d4 lobo_r2:d4 loco_r2:d4 gap:d4 gap_spread:d4",
       """SELECT model, n_cohorts, count(*) AS n_subsets, avg(n_cells) AS mean_cells, quantile_cont(lobo_r2, 0.5) AS lobo_r2, quantile_cont(loco_r2, 0.5) AS loco_r2,
          quantile_cont(gap, 0.5) AS gap, max(gap) - min(gap) AS gap_spread FROM k_points GROUP BY model, n_cohorts""")
def _(spark, sf_dir):
    return coverage.sweep_summary(staged(_sweep(spark, sf_dir)))
