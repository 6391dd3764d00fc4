"""Regression on Gram matrices: one stable scan, then any number of models on the driver; iterative families aggregate once a step."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import special as S
from quillon.plans.blocks import Values, block_median, blocks, fold, sample_rows
from quillon.plans.stats import clean, finish, frame, gram, ordered, unpack_gram

COEF = "term string, estimate double, std_error double, statistic double, p_value double, ci_lower double, ci_upper double"
FIT = "r_squared double, adj_r_squared double, f_statistic double, f_p_value double, mse double, rmse double, n long, p long"


def solve(s: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    try:
        inv = np.linalg.inv(s)
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(s)
    return inv @ b, inv


def ols_from(n: int, mean: np.ndarray, s: np.ndarray, which: Sequence[int], intercept: bool = True) -> dict:
    """Least squares of the last column on columns `which` from centred cross products."""
    w, k = list(which), len(which)
    if not intercept:
        full = s + n * np.outer(mean, mean)
        beta, inv = solve(full[np.ix_(w, w)], full[w, -1])
        sse = full[-1, -1] - beta @ full[w, -1]
        coef, cov, p = beta, inv, k
    else:
        beta, inv = solve(s[np.ix_(w, w)], s[w, -1])
        sse = s[-1, -1] - beta @ s[w, -1]
        b0 = mean[-1] - beta @ mean[w]
        coef, p = np.r_[b0, beta], k + 1
        cov = np.zeros((p, p))
        cov[1:, 1:] = inv
        cov[0, 1:] = cov[1:, 0] = -inv @ mean[w]
        cov[0, 0] = 1 / n + mean[w] @ inv @ mean[w]
    sse, sst, df = max(float(sse), 0.0), float(s[-1, -1]), n - p
    mse = sse / df if df > 0 else math.nan
    r2 = 1 - sse / sst if sst > 0 else 0.0
    d1 = p - 1 if intercept else p
    f = (sst - sse) / d1 / mse if d1 > 0 and mse > 0 else math.inf
    return dict(coef=coef, cov=cov, sse=sse, sst=sst, df=df, mse=mse, r2=r2, adj=1 - (1 - r2) * (n - 1) / df if df > 0 else math.nan, f=f, fp=S.f_sf(f, d1, df) if d1 > 0 else math.nan, n=n, p=p)


def coef_rows(terms: Sequence[str], coef: np.ndarray, se: np.ndarray, df: float | None, alpha: float = 0.05) -> list[dict]:
    """Wald rows, t with `df` or normal without."""
    crit = S.t_ppf(1 - alpha / 2, df) if df else S.norm_ppf(1 - alpha / 2)
    out = []
    for t, b, e in zip(terms, coef, se, strict=True):
        z = b / e if e > 0 else math.inf
        out.append(dict(term=t, estimate=b, std_error=e, statistic=z, p_value=S.t_two(z, df) if df else 2 * S.norm_sf(abs(z)), ci_lower=b - crit * e, ci_upper=b + crit * e))
    return out


def fit_row(m: dict) -> dict:
    return dict(r_squared=m["r2"], adj_r_squared=m["adj"], f_statistic=m["f"], f_p_value=m["fp"], mse=m["mse"], rmse=math.sqrt(max(m["mse"], 0.0)) if m["mse"] == m["mse"] else math.nan, n=m["n"], p=m["p"])


def ols(df: DataFrame, y: str, features: Sequence[str], alpha: float = 0.05, add_intercept: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """A row per coefficient, each with the fit beside it."""
    p = len(features) + 1

    def close(r):
        m = ols_from(*unpack_gram(r, p), range(p - 1), add_intercept)
        terms = (["(Intercept)"] if add_intercept else []) + list(features)
        return [c | fit_row(m) for c in coef_rows(terms, m["coef"], np.sqrt(np.diag(m["cov"]) * m["mse"]), m["df"], alpha)]

    return finish(gram(df, [*features, y], by), by, close, COEF + ", " + FIT)


def ols_diagnostics(df: DataFrame, y: str, features: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Row-level fitted, residual, leverage and Cook's distance; pos and durbin_watson where an order is given.

    Leverage comes from the broadcast inverse of the small Gram matrix, so nothing of size n by n is formed.
    """
    rows = clean(df, [*features, y], order or [])
    n, mean, s = unpack_gram(gram(rows, [*features, y]).first().asDict(), len(features) + 1)
    m = ols_from(n, mean, s, range(len(features)))
    fitted: Column = F.lit(float(m["coef"][0]))
    for c, b in zip(features, m["coef"][1:], strict=True):
        fitted = fitted + F.col(c) * F.lit(float(b))
    inv = m["cov"][1:, 1:]
    centred = [F.col(c) - F.lit(float(a)) for c, a in zip(features, mean[:-1], strict=True)]
    h: Column = F.lit(1.0 / n)
    for i, a in enumerate(centred):
        for j, b in enumerate(centred):
            h = h + a * b * F.lit(float(inv[i, j]))
    out = rows.withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted")).withColumn("leverage", h)
    student2 = F.pow("residual", F.lit(2.0)) / (F.lit(m["mse"]) * (1 - F.col("leverage")))
    out = out.withColumn("cooks_distance", student2 * F.col("leverage") / (m["p"] * F.pow(1 - F.col("leverage"), F.lit(2.0))))
    out = out.withColumn("cooks_d_std", student2 * F.col("leverage") / (m["p"] * (1 - F.col("leverage"))))
    if order:
        out = ordered(out, order)
    return out


def durbin_watson(diagnosed: DataFrame) -> DataFrame:
    """From rows with pos and residual; neighbours meet by an equi-join on position."""
    nxt = diagnosed.select((F.col("pos") - 1).alias("pos"), F.col("residual").alias("_next"))
    both = diagnosed.select("pos", "residual").join(nxt, "pos", "left")
    return both.agg((F.sum(F.pow(F.col("_next") - F.col("residual"), F.lit(2.0))) / F.sum(F.pow("residual", F.lit(2.0)))).alias("durbin_watson"))


def residual_vs_fitted(diagnosed: DataFrame, points: int = 500) -> dict:
    """Scatter spec over at most `points` rows (a sample, for drawing only)."""
    few = diagnosed.select("fitted", "residual").orderBy(F.xxhash64("fitted", "residual")).limit(points).collect()
    return dict(title="Residuals vs fitted", chart_type="scatter", traces=[dict(x=[r[0] for r in few], y=[r[1] for r in few])], reference_lines=[0.0])


def residual_diagnostics(diagnosed: DataFrame) -> list[dict]:
    from quillon.operators.core import histogram_spec, qq_spec

    ranked = "pos" in diagnosed.columns
    held = diagnosed.select("fitted", "residual", *(["pos"] if ranked else [])).cache()  # ordered once for all charts
    out = [residual_vs_fitted(held), qq_spec(held, "residual"), histogram_spec(held, "residual", "Residuals")]
    if ranked:
        every = max(1, -(-held.count() // 500))  # evenly over the whole order
        few = held.filter(F.col("pos") % every == 0).select("pos", "residual").orderBy("pos").collect()
        out.append(dict(title="Residuals vs order", chart_type="line", traces=[dict(x=[r[0] for r in few], y=[r[1] for r in few])]))
    held.unpersist()
    return out


def polynomial(df: DataFrame, x: str, y: str, degree: int = 2, alpha: float = 0.05) -> DataFrame:
    names = [x if d == 1 else f"{x}^{d}" for d in range(1, degree + 1)]
    rows = clean(df, [x, y]).select(F.col(y).alias("_y"), *(F.pow(F.col(x), F.lit(float(d))).alias(n) for d, n in enumerate(names, 1)))
    safe = rows.toDF("_y", *(f"_p{i}" for i in range(degree)))
    named = {f"_p{i}": n for i, n in enumerate(names)}
    return ols(safe, "_y", list(named), alpha).replace(named, subset=["term"])


def best_subsets(df: DataFrame, y: str, features: Sequence[str], max_predictors: int | None = None) -> DataFrame:
    """Every subset scored from one Gram scan, by ascending AIC."""
    p = len(features)
    n, mean, s = unpack_gram(gram(df, [*features, y]).first().asDict(), p + 1)
    full = ols_from(n, mean, s, range(p))
    out = []
    for k in range(1, min(p, max_predictors or p, 15) + 1):
        for w in combinations(range(p), k):
            m = ols_from(n, mean, s, w)
            base = n * math.log(max(m["sse"], 1e-300) / n)
            out.append(dict(features=[features[i] for i in w], p=k, r_squared=m["r2"], adj_r_squared=m["adj"], aic=base + 2 * (k + 1), bic=base + (k + 1) * math.log(n), mallows_cp=m["sse"] / full["mse"] - n + 2 * (k + 1)))
    return frame(df, sorted(out, key=lambda r: r["aic"]), "features array<string>, p long, r_squared double, adj_r_squared double, aic double, bic double, mallows_cp double")


def stepwise(df: DataFrame, y: str, features: Sequence[str], method: str = "both", alpha_enter: float = 0.05, alpha_remove: float = 0.1, max_steps: int = 100) -> DataFrame:
    """Steps by p-value over one Gram scan: (step, action, feature, p_value, r_squared, selected); the last row, `final`, is the model kept."""
    p = len(features)
    n, mean, s = unpack_gram(gram(df, [*features, y]).first().asDict(), p + 1)

    def p_values(w: list[int]) -> dict[int, float]:
        m = ols_from(n, mean, s, w)
        se = np.sqrt(np.diag(m["cov"]) * m["mse"])
        return {i: S.t_two(m["coef"][j + 1] / se[j + 1], m["df"]) for j, i in enumerate(w)}

    chosen = list(range(p)) if method == "backward" else []
    steps = []

    def log(action: str, i: int, pv: float) -> None:
        steps.append(dict(step=len(steps) + 1, action=action, feature=features[i], p_value=pv, r_squared=ols_from(n, mean, s, chosen)["r2"] if chosen else 0.0, selected=[features[j] for j in chosen]))

    for _ in range(max_steps):
        moved = False
        if method in ("forward", "both"):
            tries = {i: p_values([*chosen, i])[i] for i in range(p) if i not in chosen}
            if tries and min(tries.values()) < alpha_enter:
                i = min(tries, key=tries.get)
                chosen.append(i)
                log("enter", i, tries[i])
                moved = True
        if method in ("backward", "both") and chosen:
            pv = p_values(chosen)
            i = max(pv, key=pv.get)
            if pv[i] > alpha_remove:
                chosen.remove(i)
                log("remove", i, pv[i])
                moved = True
        if not moved:
            break
    kept = ols_from(n, mean, s, chosen)["r2"] if chosen else 0.0
    steps.append(dict(step=len(steps) + 1, action="final", r_squared=kept, selected=[features[j] for j in chosen]))
    return frame(df, steps, "step long, action string, feature string, p_value double, r_squared double, selected array<string>")


def orthogonal_regression(df: DataFrame, x: str, y: str, error_ratio: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Deming regression beside least squares."""

    def close(r):
        _, mean, s = unpack_gram(r, 2)
        a, b = s[1, 1] - error_ratio * s[0, 0], s[0, 1]
        slope = (a + math.sqrt(a * a + 4 * error_ratio * b * b)) / (2 * b) if b else math.nan
        o = b / s[0, 0]
        return dict(slope=slope, intercept=mean[1] - slope * mean[0], slope_ols=o, intercept_ols=mean[1] - o * mean[0], error_ratio=error_ratio)

    return finish(gram(df, [x, y], by), by, close, "slope double, intercept double, slope_ols double, intercept_ols double, error_ratio double")


def weighted_sums(rows: DataFrame, design: Sequence[Column], weight: Column, target: Column, *extra: Column) -> tuple[np.ndarray, np.ndarray, dict]:
    """X'WX, X'Wz and extra sums in one aggregate."""
    p = len(design)
    aggs = [F.sum(weight * design[i] * design[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(weight * design[i] * target).alias(f"b{i}") for i in range(p)]
    r = rows.agg(*aggs, *extra).first().asDict()
    A = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    return A, np.array([r[f"b{i}"] for i in range(p)]), r


LINKS = ("gaussian", "poisson", "binomial", "gamma")


def irls(df: DataFrame, y: str, features: Sequence[str], family: str, max_iter: int = 100, tol: float = 1e-8) -> dict:
    """Iteratively reweighted least squares on standardised features, one aggregate a step over the cached columns."""
    if family not in LINKS:
        raise ValueError(f"unknown family {family}; one of {LINKS}")
    rows = clean(df, [*features, y]).cache()
    st = rows.agg(F.count("*").alias("n"), F.avg(y).alias("my"), *(f(c).alias(f"{t}{i}") for i, c in enumerate(features) for t, f in (("m", F.avg), ("s", F.stddev_pop)))).first().asDict()
    means, sds = (np.array([st[f"{t}{i}"] for i in range(len(features))]) for t in ("m", "s"))
    sds = np.where(sds > 0, sds, 1.0)
    design = [F.lit(1.0)] + [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(features, means, sds, strict=True)]
    n, my, target = st["n"], st["my"], F.col(y)
    start = {"gaussian": my, "poisson": math.log(max(my, 1e-10)), "binomial": math.log(max(my, 1e-10) / max(1 - my, 1e-10)), "gamma": 1 / max(my, 1e-10)}[family]
    beta, converged, A, it = np.r_[start, np.zeros(len(features))], False, None, 0
    for it in range(1, max_iter + 1):
        eta = sum((F.lit(float(b)) * d for b, d in zip(beta, design, strict=True)), F.lit(0.0))
        mu, w, slope = family_parts(family, eta)
        A, b, _ = weighted_sums(rows, design, w, eta + (target - mu) * slope)
        new = solve(A, b)[0]
        converged = bool(np.abs(new - beta).max() < tol)
        beta = new
        if converged:
            break
    eta = sum((F.lit(float(b)) * d for b, d in zip(beta, design, strict=True)), F.lit(0.0))
    mu, w, slope = family_parts(family, eta)
    safe = F.greatest(mu, F.lit(1e-300))
    ylogy = F.when(target > 0, target * F.log(F.greatest(target, F.lit(1e-300)) / safe)).otherwise(0.0)
    one = F.lit(1.0)
    dev, ll = {
        "gaussian": (F.pow(target - mu, F.lit(2.0)), F.lit(0.0)),
        "poisson": (2 * (ylogy - (target - mu)), target * F.log(safe) - mu - F.expr("cast(java_method('org.apache.commons.math3.special.Gamma', 'logGamma', _y1) as double)")),
        "binomial": (-2 * (target * F.log(safe) + (one - target) * F.log(F.greatest(one - mu, F.lit(1e-300)))), target * F.log(safe) + (one - target) * F.log(F.greatest(one - mu, F.lit(1e-300)))),
        "gamma": (2 * (-F.log(F.greatest(target, F.lit(1e-300)) / safe) + (target - mu) / safe), F.lit(0.0)),
    }[family]
    pear = F.pow(target - mu, F.lit(2.0)) * w * slope * slope
    scored = rows.withColumn("_y1", (target + 1).cast("double")).select(dev.alias("d"), ll.alias("l"), pear.alias("x"), F.log(F.greatest(target, F.lit(1e-300))).alias("ly"), (F.log(safe) + target / safe).alias("g"))
    A, _, _ = weighted_sums(rows, design, w, target)
    z = scored.agg(*(F.sum(c).alias(c) for c in ("d", "l", "x", "ly", "g"))).first().asDict()
    rows.unpersist()
    p = len(beta)
    back = np.eye(p)  # to the original scale
    back[0, 1:] = -means / sds
    back[1:, 1:] = np.diag(1 / sds)
    cov = back @ solve(A, np.zeros(p))[1] @ back.T
    phi = 1.0 if family in ("poisson", "binomial") else (z["d"] if family == "gaussian" else z["x"]) / (n - p)
    if family == "gaussian":
        z["l"] = -n / 2 * (math.log(2 * math.pi * z["d"] / n) + 1)
    elif family == "gamma":
        k = n / max(z["d"], 1e-300)
        z["l"] = n * (k * math.log(k) - math.lgamma(k)) + (k - 1) * z["ly"] - k * z["g"]
    return dict(coef=back @ beta, se=np.sqrt(np.diag(cov) * phi), ll=z["l"], deviance=z["d"], pearson=z["x"], n=n, p=p, my=my, converged=converged, iterations=it)


def family_parts(family: str, eta: Column) -> tuple[Column, Column, Column]:
    """(mean, IRLS weight, d eta / d mu) of the canonical links."""
    if family == "gaussian":
        return eta, F.lit(1.0), F.lit(1.0)
    if family == "poisson":
        mu = F.exp(F.least(F.lit(500.0), eta))
        return mu, F.greatest(mu, F.lit(1e-10)), F.lit(1.0) / F.greatest(mu, F.lit(1e-10))
    if family == "binomial":
        mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), eta))))
        w = F.greatest(mu * (F.lit(1.0) - mu), F.lit(1e-10))
        return mu, w, F.lit(1.0) / w
    if family == "gamma":
        mu = F.lit(1.0) / F.greatest(eta, F.lit(1e-10))
        return mu, mu * mu, -F.lit(1.0) / (mu * mu)
    raise ValueError(f"unknown family {family}; one of {LINKS}")


GLM = COEF + ", family string, deviance double, log_likelihood double, aic double, n long, converged boolean"


def glm(df: DataFrame, y: str, features: Sequence[str], family: str = "gaussian") -> DataFrame:
    m = irls(df, y, features, family)
    fit = dict(family=family, deviance=m["deviance"], log_likelihood=m["ll"], aic=-2 * m["ll"] + 2 * m["p"], n=m["n"], converged=m["converged"])
    return frame(df, [c | fit for c in coef_rows(["(Intercept)", *features], m["coef"], m["se"], None)], GLM)


def logistic_regression(df: DataFrame, y: str, features: Sequence[str], max_iter: int = 100, tol: float = 1e-8) -> DataFrame:
    m = irls(df, y, features, "binomial", max_iter, tol)
    null = m["n"] * (m["my"] * math.log(max(m["my"], 1e-300)) + (1 - m["my"]) * math.log(max(1 - m["my"], 1e-300)))
    fit = dict(log_likelihood=m["ll"], null_log_likelihood=null, pseudo_r_squared=1 - m["ll"] / null if null else 0.0, aic=-2 * m["ll"] + 2 * m["p"], n=m["n"], converged=m["converged"])
    rows = coef_rows(["(Intercept)", *features], m["coef"], m["se"], None)
    return frame(df, [c | fit | dict(odds_ratio=math.exp(min(700.0, c["estimate"]))) for c in rows], COEF + ", odds_ratio double, log_likelihood double, null_log_likelihood double, pseudo_r_squared double, aic double, n long, converged boolean")


def poisson_regression(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    m = irls(df, y, features, "poisson")
    fit = dict(deviance=m["deviance"], pearson_chi2=m["pearson"], aic=-2 * m["ll"] + 2 * m["p"], n=m["n"])
    rows = coef_rows(["(Intercept)", *features], m["coef"], m["se"], None)
    return frame(df, [c | fit | dict(irr=math.exp(min(700.0, c["estimate"]))) for c in rows], COEF + ", irr double, deviance double, pearson_chi2 double, aic double, n long")


def ordinal_logistic(df: DataFrame, y: str, features: Sequence[str], max_iter: int = 60) -> DataFrame:
    """Proportional odds by Fisher scoring: P(y <= j) = logistic(threshold_j - x beta); one aggregate a step."""
    rows = clean(df, list(features), [y]).filter(F.col(y).isNotNull()).cache()
    counts = {r[y]: r["count"] for r in rows.groupBy(y).count().collect()}
    cats = sorted(counts)
    n, J, p = sum(counts.values()), len(cats) - 1, len(features)
    st = rows.agg(*(f(c).alias(f"{t}{i}") for i, c in enumerate(features) for t, f in (("m", F.avg), ("s", F.stddev_pop)))).first().asDict()
    means, sds = np.array([st[f"m{i}"] for i in range(p)]), np.array([st[f"s{i}"] or 1.0 for i in range(p)])
    x = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(features, means, sds, strict=True)]
    share = np.cumsum([counts[c] for c in cats])[:-1] / n
    theta = np.r_[np.log(share / (1 - share)), np.zeros(p)]
    level = F.array_position(F.array(*map(F.lit, cats)), F.col(y)).cast("int")  # 1..J+1
    ll, H = -math.inf, None
    for _ in range(max_iter):
        eta = sum((F.lit(float(b)) * c for b, c in zip(theta[J:], x, strict=True)), F.lit(0.0))
        cut = F.array(*(F.lit(float(t)) for t in theta[:J]))
        g = lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v))
        up = F.when(level <= J, g(F.get(cut, level - 1) - eta)).otherwise(1.0)
        lo = F.when(level >= 2, g(F.get(cut, level - 2) - eta)).otherwise(0.0)
        r = rows.select(level.alias("k"), up.alias("u"), lo.alias("l"), *(c.alias(f"x{i}") for i, c in enumerate(x)))
        r = r.withColumn("pr", F.greatest(F.col("u") - F.col("l"), F.lit(1e-300))).withColumn("du", F.col("u") * (1 - F.col("u"))).withColumn("dl", F.col("l") * (1 - F.col("l")))
        parts = [(F.when(F.col("k") == j + 1, F.col("du")).when(F.col("k") == j + 2, -F.col("dl")).otherwise(0.0)) / F.col("pr") for j in range(J)]
        parts += [-(F.col("du") - F.col("dl")) / F.col("pr") * F.col(f"x{i}") for i in range(p)]
        s = r.select("pr", *(c.alias(f"g{i}") for i, c in enumerate(parts)))
        q = J + p
        got = s.agg(F.sum(F.log("pr")).alias("ll"), *(F.sum(f"g{i}").alias(f"g{i}") for i in range(q)), *(F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"h{i}_{j}") for i in range(q) for j in range(i, q))).first().asDict()
        H = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(q)] for i in range(q)])
        grad = np.array([got[f"g{i}"] for i in range(q)])
        if abs(got["ll"] - ll) < 1e-10 * abs(got["ll"]):
            break
        ll = got["ll"]
        theta = theta + solve(H, grad)[0]
    rows.unpersist()
    beta, se = theta[J:] / sds, np.sqrt(np.diag(solve(H, grad)[1]))
    cuts = theta[:J] + (theta[J:] * means / sds).sum()
    out = coef_rows(features, beta, se[J:] / sds, None) + [dict(term=f"{a}|{b}", estimate=t) for a, b, t in zip(cats, cats[1:], cuts, strict=False)]
    return frame(df, [r | dict(log_likelihood=ll, n=n) for r in out], COEF + ", log_likelihood double, n long")


# name -> (column of x and parameters, start from simple statistics)
def curve_models(x: Column, p: list[float]) -> dict:
    a, b, c = (F.lit(float(v)) for v in [*p, 1.0, 1.0, 1.0][:3])
    e = F.exp
    clip = lambda v: F.greatest(F.lit(-700.0), F.least(F.lit(700.0), v))
    return {
        "exponential": a * e(clip(b * x)),
        "power": a * F.pow(x, b),
        "logarithmic": a * F.log(x) + b,
        "logistic": a / (F.lit(1.0) + e(clip(-b * (x - c)))),
        "michaelis_menten": a * x / (b + x),
        "gompertz": a * e(-b * e(clip(-c * x))),
        "hill": a * F.pow(x, c) / (F.pow(b, c) + F.pow(x, c)),
    }


CURVE_PARAMS = {"exponential": ("a", "b"), "power": ("a", "b"), "logarithmic": ("a", "b"), "logistic": ("L", "k", "x0"), "michaelis_menten": ("Vmax", "Km"), "gompertz": ("a", "b", "c"), "hill": ("Vmax", "Kd", "n")}


def curve_fit(df: DataFrame, x: str, y: str, model: str = "exponential", p0: Sequence[float] | None = None, max_iter: int = 60) -> DataFrame:
    """Levenberg-Marquardt with difference columns: every step one aggregate of J'J and J'r."""
    if model in ("polynomial2", "polynomial3"):
        d = int(model[-1])
        rows = {r["term"]: r for r in polynomial(df, x, y, d).collect()}
        names = [x if i == 1 else f"{x}^{i}" for i in range(d, 0, -1)] + ["(Intercept)"]
        fit = rows["(Intercept)"]
        sse = fit["mse"] * (fit["n"] - fit["p"])
        return frame(df, [dict(term=t, estimate=rows[t]["estimate"], std_error=0.0, model=model, r_squared=fit["r_squared"], rmse=math.sqrt(sse / fit["n"]), aic=fit["n"] * math.log(sse / fit["n"]) + 2 * (d + 1), bic=fit["n"] * math.log(sse / fit["n"]) + (d + 1) * math.log(fit["n"]), n=fit["n"], converged=True) for t in names], _CURVE)
    rows = clean(df, [x, y]).cache()
    st = rows.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.min(y).alias("ly"), F.max(y).alias("hy"), F.var_pop(y).alias("vy"), F.stddev_pop(x).alias("sx"), F.regr_slope(F.log(F.when(F.col(y) > 0, F.col(y))), F.col(x)).alias("es"), F.regr_slope(F.log(F.when(F.col(y) > 0, F.col(y))), F.log(F.when(F.col(x) > 0, F.col(x)))).alias("ps"), F.avg(F.log(F.when(F.col(y) > 0, F.col(y)))).alias("mly"), F.avg(F.log(F.when(F.col(x) > 0, F.col(x)))).alias("mlx")).first().asDict()
    es, ps = st["es"] or 0.1, st["ps"] or 1.0
    start = {"exponential": [math.exp((st["mly"] or 0) - es * st["mx"]), es], "power": [math.exp((st["mly"] or 0) - ps * (st["mlx"] or 0)), ps], "logarithmic": [1.0, st["my"]], "logistic": [st["hy"] * 1.05, 1 / (st["sx"] or 1), st["mx"]], "michaelis_menten": [st["hy"] * 1.2, st["mx"] or 1], "gompertz": [st["hy"] * 1.05, 2.0, 1 / (st["mx"] or 1)], "hill": [st["hy"] * 1.1, st["mx"] or 1, 1.0]}
    p = np.array(start[model] if p0 is None else p0, float)
    k, lam = len(p), 1e-3

    def sums(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        col = lambda v: curve_models(F.col(x), list(v))[model]
        base = col(q)
        steps = [max(abs(v), 1e-4) * 1e-6 for v in q]
        jac = [(col(q + np.eye(k)[i] * h) - col(q - np.eye(k)[i] * h)) / F.lit(2 * h) for i, h in enumerate(steps)]
        s = rows.select((F.col(y) - base).alias("r"), *(j.alias(f"j{i}") for i, j in enumerate(jac)))
        g = s.agg(F.sum(F.col("r") * F.col("r")).alias("s"), *(F.sum(F.col(f"j{i}") * F.col("r")).alias(f"b{i}") for i in range(k)), *(F.sum(F.col(f"j{i}") * F.col(f"j{m}")).alias(f"a{i}_{m}") for i in range(k) for m in range(i, k))).first().asDict()
        return g["s"], np.array([[g[f"a{min(i, m)}_{max(i, m)}"] for m in range(k)] for i in range(k)]), np.array([g[f"b{i}"] for i in range(k)])

    sse, A, b = sums(p)
    converged = False
    for _ in range(max_iter):
        step = np.linalg.lstsq(A + lam * np.diag(np.diag(A) + 1e-12), b, rcond=None)[0]
        try:
            new = sums(p + step)
        except (TypeError, ValueError):
            new = (math.inf, A, b)
        if new[0] is not None and new[0] == new[0] and new[0] <= sse:
            done = sse - new[0] <= 1e-13 * sse or np.abs(step).max() <= 1e-10 * np.abs(p).max()
            p, (sse, A, b), lam = p + step, new, lam / 10
            if done:
                converged = True
                break
        else:
            lam *= 10
            if lam > 1e12:
                converged = True
                break
    rows.unpersist()
    n = st["n"]
    se = np.sqrt(np.diag(np.linalg.pinv(A)) * sse / max(n - k, 1))
    base = n * math.log(max(sse, 1e-300) / n)
    fit = dict(model=model, r_squared=1 - sse / (st["vy"] * n) if st["vy"] else 0.0, rmse=math.sqrt(sse / n), aic=base + 2 * k, bic=base + k * math.log(n), n=n, converged=converged)
    return frame(df, [dict(term=t, estimate=v, std_error=e) | fit for t, v, e in zip(CURVE_PARAMS[model], p, se, strict=True)], _CURVE)


_CURVE = "term string, estimate double, std_error double, model string, r_squared double, rmse double, aic double, bic double, n long, converged boolean"


class Standard:
    """Standardised (ddof 0) second moments of features and the centred target."""

    def __init__(self, n: int, mean: np.ndarray, s: np.ndarray):
        self.n, self.mean = n, mean
        self.sd = np.sqrt(np.diag(s)[:-1] / n)
        self.sd = np.where(self.sd > 0, self.sd, 1.0)
        self.G = s[:-1, :-1] / np.outer(self.sd, self.sd)
        self.g = s[:-1, -1] / self.sd
        self.yy = s[-1, -1]

    def sse(self, b: np.ndarray) -> float:
        return float(self.yy - 2 * b @ self.g + b @ self.G @ b)

    def ridge(self, alpha: float) -> np.ndarray:
        return solve(self.G + alpha * np.eye(len(self.g)), self.g)[0]

    def descend(self, alpha: float, l1_ratio: float, max_iter: int = 1000, tol: float = 1e-6, start: np.ndarray | None = None) -> np.ndarray:
        """Coordinate descent on covariance updates for SSE/(2n) + alpha (l1 |b| + (1 - l1)/2 b^2)."""
        G, g = self.G / self.n, self.g / self.n
        b = np.zeros(len(g)) if start is None else start.copy()
        for _ in range(max_iter):
            most = 0.0
            for j in range(len(b)):
                rho = g[j] - G[j] @ b + G[j, j] * b[j]
                new = math.copysign(max(abs(rho) - alpha * l1_ratio, 0.0), rho) / (G[j, j] + alpha * (1 - l1_ratio))
                most, b[j] = max(most, abs(new - b[j])), new
            if most < tol:
                break
        return b


REG = "term string, coefficient double, standardized double, intercept double, method string, alpha double, l1_ratio double, r_squared double, r_squared_adj double, mse double, n_features_selected long, cv_score double"


def _folds(df: DataFrame, y: str, features: Sequence[str], folds: int = 5) -> list[Standard]:
    """Per fold (training, held out) second moments from one grouped Gram scan; folds by a hash of the row's values."""
    rows = clean(df, [*features, y])
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64(*features, y), F.lit(folds)))
    return [unpack_gram(r.asDict(), len(features) + 1) for r in gram(rows, [*features, y], ["_fold"]).collect()]


def _pool(parts: list[tuple]) -> tuple:
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def cv_mse(parts: list[tuple], fit) -> float:
    """Mean squared error over held-out folds, from their moments alone."""
    total = count = 0.0
    for i, (n, mean, s) in enumerate(parts):
        st = Standard(*_pool([p for j, p in enumerate(parts) if j != i]))
        b = fit(st) / st.sd
        bias = mean[-1] - st.mean[-1] - b @ (mean[:-1] - st.mean[:-1])
        total += s[-1, -1] - 2 * b @ s[:-1, -1] + b @ s[:-1, :-1] @ b + n * bias**2
        count += n
    return float(total / count)


def _reg_rows(df: DataFrame, st: Standard, b: np.ndarray, features: Sequence[str], method: str, alpha: float, l1: float | None, cv: float) -> DataFrame:
    coef = b / st.sd
    sse, k = st.sse(b), int((np.abs(b) > 1e-10).sum())
    r2 = 1 - sse / st.yy if st.yy > 0 else 0.0
    fit = dict(intercept=float(st.mean[-1] - coef @ st.mean[:-1]), method=method, alpha=alpha, l1_ratio=l1, r_squared=r2, r_squared_adj=1 - (1 - r2) * (st.n - 1) / max(st.n - len(b) - 1, 1), mse=sse / st.n, n_features_selected=k, cv_score=cv)
    return frame(df, [dict(term=t, coefficient=c, standardized=s) | fit for t, c, s in zip(features, coef, b, strict=True)], REG)


def ridge(df: DataFrame, y: str, features: Sequence[str], alpha: float | None = 1.0, alphas: Sequence[float] | None = None) -> DataFrame:
    """alpha None: generalised cross-validation over 50 values from 1e-4 to 1e4."""
    parts = _folds(df, y, features)
    st = Standard(*_pool(parts))
    if alpha is None:
        ev = np.linalg.eigvalsh(st.G)

        def gcv(a: float) -> float:
            dof = (ev / (ev + a)).sum()
            return st.sse(st.ridge(a)) / (st.n * (1 - dof / st.n) ** 2)

        alpha = float(min(np.logspace(-4, 4, 50) if alphas is None else alphas, key=gcv))
    return _reg_rows(df, st, st.ridge(alpha), features, "ridge", alpha, None, cv_mse(parts, lambda s: s.ridge(alpha)))


def lasso(df: DataFrame, y: str, features: Sequence[str], alpha: float = 1.0, alphas: Sequence[float] | None = None, max_iter: int = 1000) -> DataFrame:
    return elastic_net(df, y, features, alpha, 1.0, alphas, max_iter, "lasso")


def elastic_net(df: DataFrame, y: str, features: Sequence[str], alpha: float = 1.0, l1_ratio: float = 0.5, alphas: Sequence[float] | None = None, max_iter: int = 1000, method: str = "elastic_net") -> DataFrame:
    parts = _folds(df, y, features)
    if alphas is not None:
        alpha = float(min(alphas, key=lambda a: cv_mse(parts, lambda s: s.descend(a, l1_ratio, max_iter))))
    st = Standard(*_pool(parts))
    return _reg_rows(df, st, st.descend(alpha, l1_ratio, max_iter), features, method, alpha, l1_ratio, cv_mse(parts, lambda s: s.descend(alpha, l1_ratio, max_iter)))


def regularization_path(df: DataFrame, y: str, features: Sequence[str], method: str = "lasso", n_alphas: int = 50) -> DataFrame:
    """Coefficients along alpha; best is the one of least training error."""
    st = Standard(*unpack_gram(gram(df, [*features, y]).first().asDict(), len(features) + 1))
    top = float(np.abs(st.g).max() / st.n) or 1.0
    rows, b = [], np.zeros(len(features))
    for a in np.logspace(math.log10(top), math.log10(top * 1e-4), n_alphas):
        b = st.ridge(a * st.n) if method == "ridge" else st.descend(a, 1.0 if method == "lasso" else 0.5, start=b)
        rows.append(dict(alpha=float(a), coefficients=[float(c) for c in b / st.sd], mse=st.sse(b) / st.n))
    best = min(rows, key=lambda r: r["mse"])
    return frame(df, [r | dict(best=r is best, method=method) for r in rows], "alpha double, coefficients array<double>, mse double, best boolean, method string")


def robust_regression(df: DataFrame, y: str, features: Sequence[str], method: str = "huber", max_iter: int = 50, tol: float = 1e-6, huber_c: float = 1.345) -> DataFrame:
    """Huber or bisquare weights over cached blocks; every step two exact medians (see block_median) and one weighted Gram pass."""
    rows, p = clean(df, [*features, y]), len(features)
    n, mean, s = unpack_gram(gram(rows, [*features, y]).first().asDict(), p + 1)
    first = ols_from(n, mean, s, range(p))["coef"]
    held = blocks(rows.select(*features, y))
    few = sample_rows(held, p + 1, n)
    beta, k = first, 0

    def rest(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return x[-1] - sum(float(b) * c for b, c in zip(beta, [1.0, *x[:-1]], strict=True))

    def median(values: Values) -> float:
        return block_median(held, p + 1, n, values, values(few))

    for _ in range(max_iter):
        old = beta
        m = median(lambda x: rest(x, old))
        mad = median(lambda x: np.abs(rest(x, old) - m))
        scale = mad / 0.6745 if mad > 0 else 1.0

        def sums(each: Iterator[np.ndarray]) -> np.ndarray:
            """X'WX, X'Wy and the number of small weights."""
            total = np.zeros((p + 3, p + 1))
            for x in each:
                u = np.abs(rest(x, old) / scale)
                if method == "bisquare":
                    w = np.where(u < 4.685, (1 - (u / 4.685) ** 2) ** 2, 0.0)
                else:
                    w = np.minimum(1.0, huber_c / np.maximum(u, 1e-300))
                w = np.maximum(w, 1e-10)
                design = np.vstack([np.ones(x.shape[1]), x[:-1]])
                total[: p + 1] += (design * w) @ design.T
                total[p + 1] += design @ (w * x[-1])
                total[p + 2, 0] += (w < 0.99).sum()
            return total

        found = sum(fold(held, p + 1, sums))
        k = int(found[p + 2, 0])
        beta = solve(found[: p + 1], found[p + 1])[0]
        if float(np.abs(beta - old).max()) < tol:
            break
    sse = float(sum(fold(held, p + 1, lambda each: sum(float((rest(x, beta) ** 2).sum()) for x in each))))
    held.unpersist()
    more = dict(method=method, r_squared=1 - sse / s[-1, -1] if s[-1, -1] > 0 else 0.0, n_downweighted=k, n=n)
    return frame(df, [dict(term=t, estimate=b, ols_estimate=o, change_pct=100 * (b - o) / o if o else 0.0) | more for t, b, o in zip(["(Intercept)", *features], beta, first, strict=True)], "term string, estimate double, ols_estimate double, change_pct double, method string, r_squared double, n_downweighted long, n long")
