"""Posterior of life and shape against a dense grid in numpy, and what it must do."""

import numpy as np

from voltloom.operators import priors


def dense(x, y, at, prior, coverage=0.8):
    """The same model on the readings themselves, by the definition."""
    shapes = np.array(priors.SHAPES)
    dx, elapsed = x - x[0], at - x[0]
    lm, ls, pm, ps = prior if prior else (priors.FLAT_LOG_LIFE, None, None, None)
    half = 5 * ls if ls else priors.FLAT_HALF

    def errors(logs, ps_):
        return np.array([[np.sum((1 - y - 0.1 * (dx / np.exp(l)) ** p) ** 2) for p in ps_] for l in logs])

    def beliefs(logs, ps_):
        return np.zeros((len(logs), len(ps_))) if not ls else -0.5 * ((logs[:, None] - lm) / ls) ** 2 - 0.5 * ((ps_[None] - pm) / ps) ** 2

    has, sigma = len(x) > 1, 0.01
    logs = np.linspace(lm - half, lm + half, 241)
    sse, belief = errors(logs, shapes), beliefs(logs, shapes)
    if has and len(x) >= 10:
        i, j = np.unravel_index(np.argmin(sse - 2e-4 * belief), sse.shape)
        r = y - 1 + 0.1 * (dx / np.exp(logs[i])) ** shapes[j]
        rho = min(max(np.corrcoef(r[:-1], r[1:])[0, 1], 0), 0.95)
        sigma = max(np.sqrt(np.mean(r * r)), 0.005) * np.sqrt((1 + rho) / (1 - rho))

    def weights(sse, belief):
        lp = belief - (0.5 * sse / sigma ** 2 if has else 0)
        return np.exp(lp - lp.max()) / np.exp(lp - lp.max()).sum()

    def reach(values, margin):
        c = np.cumsum(margin)
        return values[np.argmax(c >= 1e-4 - 1e-12)] - (values[1] - values[0]), values[np.argmax(c >= 1 - 1e-4 - 1e-12)] + values[1] - values[0]

    w = weights(sse, belief)
    l0, l1 = reach(logs, w.sum(1))
    p0, p1 = reach(shapes, w.sum(0))
    logs, shapes = np.linspace(l0, l1, 241), np.linspace(max(p0, 0.05), p1, 55)
    c = np.cumsum(weights(errors(logs, shapes), beliefs(logs, shapes)).sum(1))
    rul = np.maximum(np.exp(logs) - elapsed, 0)
    return [rul[np.argmax(c >= q - 1e-12)] for q in (0.5, 0.5 - coverage / 2, 0.5 + coverage / 2)] + [len(x), sigma]


def front_loaded():
    x = np.arange(0, 500, 5.0)
    return x, 1 - 0.1 * (x / 800) ** 0.6 + np.random.default_rng(1).normal(0, 0.002, len(x)), 495


def wavy():
    x = np.arange(0, 200, 2.0)
    return x, 1 - 0.1 * (x / 600) + 0.01 * np.sin(x / 15), 198


CASES = {"front": front_loaded(), "wavy": wavy(), "one": (np.array([3.0]), np.array([1.0]), 3), "few": (np.array([0.0, 10, 30]), np.array([1.0, .99, .98]), 40)}


def history(spark):
    rows = [(c, float(at), float(a), float(b)) for c, (x, y, at) in CASES.items() for a, b in zip(x, y)]
    rows += [("wavy", 198.0, 50.5, None), ("wavy", 198.0, 60.5, float("nan")), ("wavy", 198.0, 300.0, 0.2), ("none", 5.0, 9.0, 0.9)]
    return spark.createDataFrame(rows, "cell_id string, at_cycle double, cycle double, soh double")


def check(found, prior):
    got = {r["cell_id"]: [r[c] for c in ("median", "lower", "upper", "n_readings", "sigma")] for r in found.collect()}
    assert set(got) == set(CASES)
    for c, (x, y, at) in CASES.items():
        np.testing.assert_allclose(got[c], dense(x, y, at, prior), rtol=1e-6, atol=1e-6)
    return got


def test_posterior_with_a_population(spark):
    prior = (float(np.log(600.0)), 0.3, 1.0, 0.3)
    table = spark.createDataFrame([prior], "log_life_mean double, log_life_sd double, shape_mean double, shape_sd double")
    got = check(priors.posterior_life(history(spark), table), prior)
    assert abs(got["one"][0] / 600 - 1) < 0.05


def test_posterior_without_one_follows_the_cell(spark):
    got = check(priors.posterior_life(history(spark)), None)
    assert got["front"][1] <= 800 - 495 <= got["front"][2]
    assert got["wavy"][4] > 0.01  # wider than the misfit alone: residuals follow each other


def test_a_prior_needs_a_population(spark):
    two = spark.createDataFrame([("a", 500.0, 1.0), ("b", 600.0, 1.0)], "cell_id string, life double, shape double")
    assert priors.life_prior(two).first()["log_life_mean"] is None


def test_the_grid_is_never_laid_out_as_rows(spark):
    """A grid has some 13,000 points an estimate; only the estimates' own rows are shuffled."""
    prior = spark.createDataFrame([(6.5, 0.5, 0.9, 0.3)], "log_life_mean double, log_life_sd double, shape_mean double, shape_sd double")
    plan = priors.posterior_life(history(spark), prior)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
