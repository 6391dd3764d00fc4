"""t-tests, analyses of variance, designs, counts, proportions, correlation, equivalence, mixed models."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import effects as E
from quillon.functions import special as S
from quillon.plans.pairs import pair_order
from quillon.plans.stats import clean, dicts, finish, frame, gram, group_stats, mid_rank, moments, num, unpack_gram, value_table, var0

TEST = "test_name string, statistic double, p_value double, df double, ci_lower double, ci_upper double, effect_size double, effect_size_type string, effect_label string, significant boolean"
T_TEST = TEST + ", mean1 double, mean2 double, mean_diff double, se double, n1 long, n2 long, method string"


def result(name: str, stat: float, p: float, alpha: float, df=None, ci=(None, None), effect=None, kind="cohens_d", **more) -> dict:
    return dict(test_name=name, statistic=stat, p_value=p, df=df, ci_lower=ci[0], ci_upper=ci[1], effect_size=effect, effect_size_type=kind, effect_label=None if effect is None else E.classify_effect(effect, kind), significant=bool(p < alpha)) | more


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def t_from_moments(name: str, n: int, mean: float, var: float, mu: float, alpha: float, conf: float, **more) -> dict:
    need(n >= 2, "at least 2 observations are needed")
    se = math.sqrt(var / n)
    t = (mean - mu) / se if se > 0 else (0.0 if mean == mu else math.copysign(math.inf, mean - mu))
    half = S.t_ppf(0.5 + conf / 2, n - 1) * se
    return result(name, t, S.t_two(t, n - 1), alpha, n - 1, (mean - half, mean + half), E.d_from(mean - mu, math.sqrt(var)), se=se, **more)


def one_sample(df: DataFrame, value: str, mu: float = 0.0, alpha: float = 0.05, conf: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    return finish(moments(df, value, by), by, lambda r: t_from_moments("One-sample t-test", r["n"], r["mean"], r["var"], mu, alpha, conf, mean1=r["mean"], mean_diff=r["mean"] - mu, n1=r["n"], method="t"), T_TEST)


def two(groups: list[dict], labels: Sequence[str] | None = None) -> tuple[dict, dict]:
    if labels is not None:
        groups = [next(g for g in groups if g["label"] == str(x)) for x in labels]
    need(len(groups) == 2 and min(g["n"] for g in groups) >= 2, "two groups of at least 2 observations are needed")
    return groups[0], groups[1]


def two_sample(df: DataFrame, value: str, group: str, equal_var: bool = False, alpha: float = 0.05, conf: float = 0.95, labels: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        a, b = two(dicts(r["g"]), labels)
        return two_sample_from(a, b, equal_var, alpha, conf)

    return finish(group_stats(_only(df, group, labels), value, group, by), by, close, T_TEST)


def two_sample_from(a: dict, b: dict, equal_var: bool, alpha: float, conf: float) -> dict:
    n1, n2, v1, v2 = a["n"], b["n"], var0(a), var0(b)
    diff, pooled = a["mean"] - b["mean"], E.pooled_sd(n1, v1, n2, v2)
    if equal_var:
        se, df_ = pooled * math.sqrt(1 / n1 + 1 / n2), n1 + n2 - 2
    else:
        se = math.sqrt(v1 / n1 + v2 / n2)
        df_ = (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) if se > 0 else n1 + n2 - 2
    t = diff / se if se > 0 else (0.0 if diff == 0 else math.copysign(math.inf, diff))
    half = S.t_ppf(0.5 + conf / 2, df_) * se
    d = E.d_from(diff, pooled if equal_var else math.sqrt((v1 + v2) / 2)) or 0.0
    return result("Two-sample t-test", t, S.t_two(t, df_), alpha, df_, (diff - half, diff + half), d, mean1=a["mean"], mean2=b["mean"], mean_diff=diff, se=se, n1=n1, n2=n2, method="Student" if equal_var else "Welch")


def _only(df: DataFrame, group: str, labels: Sequence[str] | None) -> DataFrame:
    return df if labels is None else df.filter(F.col(group).cast("string").isin([str(x) for x in labels]))


def paired(df: DataFrame, x1: str, x2: str, alpha: float = 0.05, conf: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    rows = clean(df, [x1, x2], by=by).withColumn("_d", F.col(x1) - F.col(x2))
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_d").alias("mean"), F.var_samp("_d").alias("var"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"))
    return finish(stats, by, lambda r: t_from_moments("Paired t-test", r["n"], r["mean"], r["var"], 0.0, alpha, conf, mean1=r["m1"], mean2=r["m2"], mean_diff=r["mean"], n1=r["n"], n2=r["n"], method="paired"), T_TEST)


def tost(df: DataFrame, value: str, group: str, margin: float, alpha: float = 0.05, labels: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        a, b = two(dicts(r["g"]), labels)
        w = two_sample_from(a, b, False, alpha, 1 - 2 * alpha)
        se, df_, diff = w["se"], w["df"], w["mean_diff"]
        lo, hi = (diff + margin) / se, (diff - margin) / se
        p1, p2 = S.t_sf(lo, df_), S.t_sf(-hi, df_)
        return dict(mean_diff=diff, margin=margin, t_lower=lo, t_upper=hi, p_lower=p1, p_upper=p2, p_tost=max(p1, p2), equivalent=max(p1, p2) < alpha, ci_lower=w["ci_lower"], ci_upper=w["ci_upper"], ci_level=1 - 2 * alpha, df=df_, effect_size=E.d_from(diff, E.pooled_sd(a["n"], var0(a), b["n"], var0(b))) or 0.0)

    return finish(group_stats(_only(df, group, labels), value, group, by), by, close, "mean_diff double, margin double, t_lower double, t_upper double, p_lower double, p_upper double, p_tost double, equivalent boolean, ci_lower double, ci_upper double, ci_level double, df double, effect_size double")


def f_test(df: DataFrame, value: str, group: str, alpha: float = 0.05, labels: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        a, b = two(dicts(r["g"]), labels)
        f = var0(a) / var0(b) if var0(b) > 0 else math.inf
        upper = S.f_sf(f, a["n"] - 1, b["n"] - 1)
        return result("F-test for variances", f, min(1.0, 2 * min(upper, 1 - upper)), alpha, a["n"] - 1, effect=None, df2=b["n"] - 1, variance_ratio=f)

    return finish(group_stats(_only(df, group, labels), value, group, by), by, close, TEST + ", df2 double, variance_ratio double")


def anova_parts(groups: list[dict]) -> dict:
    n, k = sum(g["n"] for g in groups), len(groups)
    grand = sum(g["n"] * g["mean"] for g in groups) / n
    ssb = sum(g["n"] * (g["mean"] - grand) ** 2 for g in groups)
    ssw = sum((g["n"] - 1) * var0(g) for g in groups)
    dfb, dfw = k - 1, n - k
    msb, msw = ssb / dfb, ssw / dfw if dfw > 0 else math.nan
    f = msb / msw if msw > 0 else math.inf
    return dict(n=n, k=k, grand=grand, ss_between=ssb, ss_within=ssw, ss_total=ssb + ssw, df_between=dfb, df_within=dfw, ms_between=msb, ms_within=msw, f=f, p=S.f_sf(f, dfb, dfw))


ANOVA = TEST + ", df_between long, df_within long, ss_between double, ss_within double, ss_total double, ms_between double, ms_within double, omega_squared double, group_means array<double>, group_labels array<string>"


def one_way(df: DataFrame, value: str, group: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        groups = dicts(r["g"])
        need(len(groups) >= 2, "at least 2 groups are needed")
        a = anova_parts(groups)
        return result("One-way ANOVA", a["f"], a["p"], alpha, a["df_between"], effect=E.eta_squared(a["ss_between"], a["ss_total"]), kind="eta_squared", omega_squared=E.omega_squared(a["ss_between"], a["ss_total"], a["df_between"], a["ms_within"]), group_means=[g["mean"] for g in groups], group_labels=[g["label"] for g in groups], **{c: a[c] for c in ("df_between", "df_within", "ss_between", "ss_within", "ss_total", "ms_between", "ms_within")})

    return finish(group_stats(df, value, group, by), by, close, ANOVA)


one_way_from_dict = one_way  # long form is the native shape here


def cell_stats(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Count, mean and sum of squares of every cell, margin and the whole, in one scan (cube)."""
    rows = clean(df, [value], [a, b]).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col(value).alias("v"))
    return rows.cube("a", "b").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def cells_in_one(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    return cell_stats(df, value, a, b).groupBy().agg(F.collect_list(F.struct("a", "b", "gid", "n", "mean", "var")).alias("cells"))


def split_cells(cells: list[dict]) -> tuple[dict, dict, dict, dict]:
    """(whole, a margins, b margins, cells)."""
    whole = next(c for c in cells if c["gid"] == 3)
    return whole, {c["a"]: c for c in cells if c["gid"] == 1}, {c["b"]: c for c in cells if c["gid"] == 2}, {(c["a"], c["b"]): c for c in cells if c["gid"] == 0}


SOURCES = "source string, ss double, df double, ms double, f_statistic double, p_value double, partial_eta_sq double"


def two_way_ss(cells: list[dict]) -> dict:
    whole, A, B, AB = split_cells(cells)
    m, n = whole["mean"], whole["n"]
    total = whole["var"] * n
    ssa = sum(c["n"] * (c["mean"] - m) ** 2 for c in A.values())
    ssb = sum(c["n"] * (c["mean"] - m) ** 2 for c in B.values())
    inter = sum(c["n"] * (c["mean"] - A[a]["mean"] - B[b]["mean"] + m) ** 2 for (a, b), c in AB.items())
    return dict(a=len(A), b=len(B), n=n, total=total, ssa=ssa, ssb=ssb, inter=inter, resid=total - ssa - ssb - inter, cells=AB)


def two_way(df: DataFrame, value: str, factor_a: str, factor_b: str, alpha: float = 0.05) -> DataFrame:
    """Marginal-mean sums of squares, so not orthogonal when unbalanced; the residual is what is left."""

    def close(r):
        s = two_way_ss(dicts(r["cells"]))
        dfs = [s["a"] - 1, s["b"] - 1, (s["a"] - 1) * (s["b"] - 1)]
        rest = s["n"] - s["a"] * s["b"]
        mse = s["resid"] / rest if rest > 0 else math.nan
        out = []
        for name, ss, d in zip((factor_a, factor_b, f"{factor_a}:{factor_b}"), (s["ssa"], s["ssb"], s["inter"]), dfs, strict=True):
            f = ss / d / mse if d > 0 and mse > 0 else math.nan
            out.append(dict(source=name, ss=ss, df=d, ms=ss / d if d else math.nan, f_statistic=f, p_value=S.f_sf(f, d, rest), partial_eta_sq=E.partial_eta_squared(ss, s["resid"])))
        return [*out, dict(source="Residual", ss=s["resid"], df=rest, ms=mse)]

    return finish(cells_in_one(df, value, factor_a, factor_b), (), close, SOURCES)


def split_plot_anova(df: DataFrame, value: str, whole_plot: str, sub_plot: str) -> DataFrame:
    """The whole-plot factor is tested on the interaction mean square, the others on the residual."""

    def close(r):
        s = two_way_ss(dicts(r["cells"]))
        a, b = s["a"], s["b"]
        per_cell = s["n"] // (a * b)
        dfs = (a - 1, b - 1, (a - 1) * (b - 1), a * b * max(per_cell - 1, 0))
        ms = [x / d if d > 0 else math.nan for x, d in zip((s["ssa"], s["ssb"], s["inter"], s["resid"]), dfs, strict=True)]
        out = []
        for i, (name, err) in enumerate(((whole_plot, 2), (sub_plot, 3), (f"{whole_plot}:{sub_plot}", 3))):
            f = ms[i] / ms[err] if ms[err] > 0 else math.nan
            out.append(dict(source=name, ss=(s["ssa"], s["ssb"], s["inter"])[i], df=dfs[i], ms=ms[i], f_statistic=f, p_value=S.f_sf(f, dfs[i], dfs[err]), error_term="whole-plot" if err == 2 else "sub-plot"))
        return [*out, dict(source="Residual", ss=s["resid"], df=dfs[3], ms=ms[3])]

    return finish(cells_in_one(df, value, whole_plot, sub_plot), (), close, SOURCES.replace("partial_eta_sq double", "error_term string"))


def variance_test(df: DataFrame, value: str, group: str, alpha: float = 0.05, method: str = "levene", by: Sequence[str] = ()) -> DataFrame:
    """Brown-Forsythe (Levene about medians) or Bartlett."""
    if method == "bartlett":

        def close(r):
            g = dicts(r["g"])
            n, k = sum(x["n"] for x in g), len(g)
            pooled = sum((x["n"] - 1) * var0(x) for x in g) / (n - k)
            t = (n - k) * math.log(pooled) - sum((x["n"] - 1) * math.log(var0(x)) for x in g)
            t /= 1 + (sum(1 / (x["n"] - 1) for x in g) - 1 / (n - k)) / (3 * (k - 1))
            return result("Bartlett's test", t, S.chi2_sf(t, k - 1), alpha, k - 1)

        return finish(group_stats(df, value, group, by), by, close, TEST)
    rows = clean(df, [value], [group], by)
    med = rows.groupBy(*by, group).agg(F.median(value).alias("_med"))
    spread = rows.join(F.broadcast(med) if not by else med, [*by, group]).withColumn("_z", F.abs(F.col(value) - F.col("_med")))

    def close(r):
        a = anova_parts(dicts(r["g"]))
        return result("Levene's test", a["f"], a["p"], alpha, a["df_between"], df2=a["df_within"])

    return finish(group_stats(spread, "_z", group, by), by, close, TEST + ", df2 double")


def contingency(df: DataFrame, row: str, col: str, count: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    n = F.count("*") if count is None else F.sum(count)
    per = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(*by, F.col(row).cast("string").alias("r"), F.col(col).cast("string").alias("c")).agg(n.cast("double").alias("o"))
    return per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("r", "c", "o"))).alias("t"))


def table_of(cells: list[dict]) -> tuple[np.ndarray, list[str], list[str]]:
    rows, cols = sorted({c["r"] for c in cells}), sorted({c["c"] for c in cells})
    o = np.zeros((len(rows), len(cols)))
    for c in cells:
        o[rows.index(c["r"]), cols.index(c["c"])] = c["o"]
    return o, rows, cols


def chi2_of(o: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Statistic (with continuity correction on 2x2), degrees of freedom, expected counts."""
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    diff = np.abs(o - e)
    if o.shape == (2, 2):
        diff = diff - np.minimum(0.5, diff)
    return float((diff**2 / e).sum()), (o.shape[0] - 1) * (o.shape[1] - 1), e


def chi_square_independence(df: DataFrame, row: str, col: str, count: str | None = None, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        o, _, _ = table_of(dicts(r["t"]))
        x, d, e = chi2_of(o)
        v = E.cramers_v(x, o.sum(), min(o.shape))
        return result("Chi-square test of independence", x, S.chi2_sf(x, d), alpha, d, effect=v, kind="cramers_v", cramers_v=v, n=o.sum(), min_expected=e.min())

    return finish(contingency(df, row, col, count, by), by, close, TEST + ", cramers_v double, n long, min_expected double")


def chi_square_goodness_of_fit(df: DataFrame, category: str, expected: dict[str, float] | None = None, count: str | None = None, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """expected: shares or counts by category, scaled to the total; uniform by default."""

    def close(r):
        cells = dicts(r["t"])
        o = np.array([c["o"] for c in cells])
        w = np.array([1.0 if expected is None else expected[c["r"]] for c in cells])
        e = w / w.sum() * o.sum()
        x, d = float(((o - e) ** 2 / e).sum()), len(o) - 1
        v = E.cramers_v(x, o.sum(), len(o))
        return result("Chi-square goodness of fit", x, S.chi2_sf(x, d), alpha, d, effect=v, kind="cramers_v", cramers_v=v, n=o.sum())

    return finish(contingency(df.withColumn("_one", F.lit("n")), category, "_one", count, by), by, close, TEST + ", cramers_v double, n long")


def fisher_exact(df: DataFrame, row: str, col: str, count: str | None = None, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        o, _, _ = table_of(dicts(r["t"]))
        need(o.shape == (2, 2), "Fisher's test needs a 2x2 table")
        (a, b), (c, d) = o.astype(int)
        total, good, draws = a + b + c + d, a + b, a + c
        seen = S.hypergeom_pmf(a, total, good, draws) * (1 + 1e-7)
        p = min(1.0, sum(q for k in range(max(0, draws - (total - good)), min(good, draws) + 1) if (q := S.hypergeom_pmf(k, total, good, draws)) <= seen))
        odds = a * d / (b * c) if b * c else math.inf
        return result("Fisher's exact test", odds, p, alpha, effect=None, odds_ratio=odds)

    return finish(contingency(df, row, col, count, by), by, close, TEST + ", odds_ratio double")


def wilson(k: float, n: float, conf: float) -> tuple[float, float]:
    z, p = S.norm_ppf(0.5 + conf / 2), k / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return max(0.0, mid - half), min(1.0, mid + half)


PROPORTION = TEST + ", p_hat double, p_hat2 double, p_diff double, n1 long, n2 long"


def proportion_from(k: int, n: int, p0: float, alpha: float, conf: float) -> dict:
    p = k / n
    z = (p - p0) / math.sqrt(p0 * (1 - p0) / n)
    h = abs(2 * math.asin(math.sqrt(p)) - 2 * math.asin(math.sqrt(p0)))
    return result("One-proportion z-test", z, 2 * S.norm_sf(abs(z)), alpha, ci=wilson(k, n, conf), effect=h, p_hat=p, p_diff=p - p0, n1=n)


def one_proportion(df: DataFrame, success: str, p0: float = 0.5, alpha: float = 0.05, conf: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    stats = df.filter(F.col(success).isNotNull()).groupBy(*by).agg(F.sum(F.col(success).cast("int")).alias("k"), F.count("*").alias("n"))
    return finish(stats, by, lambda r: proportion_from(int(r["k"]), int(r["n"]), p0, alpha, conf), PROPORTION)


def two_proportions(df: DataFrame, success: str, group: str, alpha: float = 0.05, conf: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        a, b = two(dicts(r["g"]))
        n1, n2, p1, p2 = a["n"], b["n"], a["mean"], b["mean"]
        pool = (n1 * p1 + n2 * p2) / (n1 + n2)
        se = math.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
        z = (p1 - p2) / se if se > 0 else 0.0
        half = S.norm_ppf(0.5 + conf / 2) * math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
        h = abs(2 * math.asin(math.sqrt(p1)) - 2 * math.asin(math.sqrt(p2)))
        return result("Two-proportion z-test", z, 2 * S.norm_sf(abs(z)), alpha, ci=(p1 - p2 - half, p1 - p2 + half), effect=h, p_hat=p1, p_hat2=p2, p_diff=p1 - p2, n1=n1, n2=n2)

    return finish(group_stats(df.withColumn("_s", F.col(success).cast("int")), "_s", group, by), by, close, PROPORTION)


def fisher_z(r: float, n: int, conf: float) -> tuple[float, float]:
    if n <= 3 or abs(r) >= 1:
        return r, r
    z, half = math.atanh(r), S.norm_ppf(0.5 + conf / 2) / math.sqrt(n - 3)
    return math.tanh(z - half), math.tanh(z + half)


def r_p(r: float, n: int) -> float:
    return math.nan if n < 3 else 0.0 if abs(r) >= 1 else S.t_two(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


PAIR = "var1 string, var2 string, r double, p_value double, n long, ci_lower double, ci_upper double, r_squared double, significant boolean"


def correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson", alpha: float = 0.05) -> DataFrame:
    """All pairs, each over its complete rows, strongest first."""
    pairs = list(combinations(columns, 2))
    need(len(pairs) > 0, "at least 2 columns are needed")
    if method == "kendall":
        rows = [kendall_pair(df, a, b, alpha) for a, b in pairs]
        return frame(df, sorted(rows, key=lambda r: -abs(r["r"])), PAIR)
    aggs = []
    source = df
    for i, (a, b) in enumerate(pairs):
        if method == "spearman":
            one = rank_pair(df, a, b).agg(F.corr("_ra", "_rb").alias("r"), F.count("*").alias("n")).withColumn("i", F.lit(i))
            aggs.append(one)
        else:
            ok = num(a).isNotNull() & num(b).isNotNull() & ~F.isnan(num(a)) & ~F.isnan(num(b))
            aggs += [F.corr(F.when(ok, num(a)), F.when(ok, num(b))).alias(f"r{i}"), F.count(F.when(ok, 1)).alias(f"n{i}")]

    def row(i: int, r: float | None, n: int) -> dict:
        r = math.nan if r is None or n < 3 else float(r)
        p = r_p(r, n)
        lo, hi = fisher_z(r, n, 1 - alpha) if r == r else (math.nan, math.nan)
        return dict(var1=pairs[i][0], var2=pairs[i][1], r=r, p_value=p, n=n, ci_lower=lo, ci_upper=hi, r_squared=r * r, significant=p < alpha)

    if method == "spearman":
        stats = aggs[0]
        for one in aggs[1:]:
            stats = stats.union(one)
        return finish(stats, (), lambda r: row(r["i"], r["r"], r["n"]), PAIR).orderBy(F.desc(F.abs("r")), "var1", "var2")
    return finish(source.agg(*aggs), (), lambda s: sorted((row(i, s[f"r{i}"], s[f"n{i}"]) for i in range(len(pairs))), key=lambda r: -abs(r["r"])), PAIR)


def rank_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = clean(df, [a, b])
    for c, name in ((a, "_ra"), (b, "_rb")):
        ranks = value_table(rows, c).select(F.col(c).alias("_v"), mid_rank().alias(name))
        rows = rows.join(ranks, rows[c] == ranks["_v"]).drop("_v")
    return rows


def kendall_pair(df: DataFrame, a: str, b: str, alpha: float) -> dict:
    """Tau-b: concordant and discordant pairs are counted in blocks (plans/pairs.py), ties from the counts of each value."""
    rows = clean(df, [a, b])
    order = pair_order(rows, a, b, F.lit(1), F.lit(1))
    con, dis = order["less"], order["more"]

    def ties(c: str) -> list[float]:
        t = F.col("count").cast("double")
        return [float(v or 0) for v in rows.groupBy(c).count().agg(F.sum(t), F.sum(t * (t - 1)), F.sum(t * (t - 1) * (t - 2)), F.sum(t * (t - 1) * (2 * t + 5))).first()]

    (n, x2, x3, xv), (_, y2, y3, yv) = ties(a), ties(b)
    tx, ty, pairs = x2 / 2, y2 / 2, n * (n - 1) / 2
    tau = (con - dis) / math.sqrt((pairs - tx) * (pairs - ty)) if pairs > tx and pairs > ty else math.nan
    if tx == ty == 0 and (n <= 33 or min(dis, pairs - dis) <= 1):
        p = S.kendall_exact(int(dis), int(n))
    else:
        var = (n * (n - 1) * (2 * n + 5) - xv - yv) / 18 + x2 * y2 / (2 * n * (n - 1)) + x3 * y3 / (9 * n * (n - 1) * (n - 2))
        p = 2 * S.norm_sf(abs(con - dis) / math.sqrt(var))
    lo, hi = fisher_z(tau, int(n), 1 - alpha)
    return dict(var1=a, var2=b, r=tau, p_value=p, n=int(n), ci_lower=lo, ci_upper=hi, r_squared=tau * tau, significant=p < alpha)


def repeated_measures_anova(df: DataFrame, value: str, subject: str, condition: str, compat: bool = False) -> DataFrame:
    """Within-subject F with Greenhouse-Geisser correction and Mauchly's test; subjects need every condition once (means are taken)."""
    rows = clean(df, [value], [subject, condition]).groupBy(subject, F.col(condition).cast("string").alias("c")).agg(F.avg(value).alias("y"))
    levels = sorted(r["c"] for r in rows.select("c").distinct().collect())
    wide = rows.groupBy(subject).pivot("c", levels).agg(F.first("y")).dropna()
    names = [f"_y{i}" for i in range(len(levels))]
    g = gram(wide.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(levels, names, strict=True))), names)
    k = len(levels)

    def close(r):
        n, mean, s = unpack_gram(r, k)
        cov = s / (n - 1)
        ss_cond = n * ((mean - mean.mean()) ** 2).sum()
        ss_subj = s.sum() / k
        ss_err = np.trace(s) - ss_subj
        d1, d2 = k - 1, (k - 1) * (n - 1)
        ms1, ms2 = ss_cond / d1, ss_err / d2
        f = ms1 / ms2 if ms2 > 1e-12 else 1e6
        center = np.eye(k) - 1 / k
        e = cov if compat else center @ cov @ center
        eps = float(np.clip(np.trace(e) ** 2 / (d1 * (e * e).sum()), 1 / d1, 1)) if (e * e).sum() > 0 else 1.0
        basis = np.linalg.svd(center)[0][:, : k - 1]
        t = basis.T @ cov @ basis
        w = np.linalg.det(t) / (np.trace(t) / d1) ** d1 if np.trace(t) > 0 else 1.0
        fdf = d1 * (d1 + 1) / 2 - 1
        x = -(n - 1 - (2 * d1 * d1 + d1 + 2) / (6 * d1)) * math.log(max(w, 1e-300))
        mp = S.chi2_sf(x, fdf) if fdf > 0 else 1.0
        return dict(f_statistic=f, p_value=S.f_sf(f, d1, d2), p_value_gg=S.f_sf(f, d1 * eps, d2 * eps), df_condition=d1, df_error=d2, ss_condition=ss_cond, ss_subject=ss_subj, ss_error=ss_err, ms_condition=ms1, ms_error=ms2, partial_eta_sq=E.partial_eta_squared(ss_cond, ss_err), epsilon_gg=eps, sphericity_met=mp > 0.05, mauchly_p=mp, condition_means=mean.tolist(), n_subjects=n, n_conditions=k)

    return finish(g, (), close, "f_statistic double, p_value double, p_value_gg double, df_condition double, df_error double, ss_condition double, ss_subject double, ss_error double, ms_condition double, ms_error double, partial_eta_sq double, epsilon_gg double, sphericity_met boolean, mauchly_p double, condition_means array<double>, n_subjects long, n_conditions long")


def random_variance(df: DataFrame, value: str, factor: str) -> tuple[float, float]:
    """Method of moments: (variance of the factor, residual variance)."""
    g = dicts(group_stats(df, value, factor).first()["g"])
    a = anova_parts(g)
    n0 = (a["n"] - sum(x["n"] ** 2 for x in g) / a["n"]) / (a["k"] - 1)
    return max(0.0, (a["ms_between"] - a["ms_within"]) / n0), a["ms_within"]


def mixed_model(df: DataFrame, response: str, fixed: Sequence[str], random: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Random-intercept model: moment estimates per factor, generalised least squares for the fixed part.

    V = sum of s_f Z_f Z_f' + s_e I is never formed: by Woodbury only per-level sums of the design and the
    levels' cross counts are needed, whose size is the number of levels. Rows: term, estimate, std_error, statistic,
    p_value, then the fit (term '(fit)').
    """
    numeric = [c for c in fixed if df.schema[c].dataType.typeName() not in ("string", "boolean")]
    factors = [c for c in fixed if c not in numeric]
    rows = clean(df, [response, *numeric], [*random, *factors])
    terms = ["(Intercept)", *numeric]
    design = [F.lit(1.0), *(F.col(c) for c in numeric)]
    for c in factors:
        for level in sorted(str(r[0]) for r in rows.select(F.col(c).cast("string")).distinct().collect())[1:]:
            terms.append(f"{c}[{level}]")
            design.append((F.col(c).cast("string") == level).cast("double"))
    rows = rows.select(*random, *(d.alias(f"_x{i}") for i, d in enumerate(design)), F.col(response).alias("_y"))
    p = len(terms)
    xs = [f"_x{i}" for i in range(p)]
    variances, residual = [], 0.0
    for f in random:
        v, residual = random_variance(rows, "_y", f)
        variances.append(v)
    cross = [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate([*xs, "_y"]) for b in [*xs, "_y"][i:]]
    total = rows.agg(F.count("*").alias("n"), F.avg("_y").alias("my"), *cross).first().asDict()
    names = [*xs, "_y"]
    G = np.array([[total[f"{a}{b}"] if f"{a}{b}" in total else total[f"{b}{a}"] for b in names] for a in names])
    n = total["n"]
    levels, Z = [], []
    for f in random:
        per = rows.groupBy(f).agg(F.count("*").alias("_n"), *(F.sum(c).alias(c) for c in names)).orderBy(f).collect()
        levels.append({r[f]: i for i, r in enumerate(per)})
        Z.append((np.array([r["_n"] for r in per], float), np.array([[r[c] for c in names] for r in per], float)))
    q = sum(len(z[0]) for z in Z)
    ztz, zt, inv_d, at = np.zeros((q, q)), np.zeros((q, p + 1)), np.zeros(q), 0
    starts = []
    for (count, sums), v in zip(Z, variances, strict=True):
        s = slice(at, at + len(count))
        starts.append(at)
        ztz[s, s], zt[s], inv_d[s] = np.diag(count), sums, 1 / max(v, 1e-12)
        at += len(count)
    for i, j in combinations(range(len(random)), 2):
        for r in rows.groupBy(random[i], random[j]).count().collect():
            a, b = starts[i] + levels[i][r[random[i]]], starts[j] + levels[j][r[random[j]]]
            ztz[a, b] = ztz[b, a] = r["count"]
    residual = max(residual, 1e-12)
    inner = np.diag(inv_d) + ztz / residual
    vinv = G / residual - zt.T @ np.linalg.solve(inner, zt) / residual**2
    A, c = vinv[:p, :p], vinv[:p, p]
    beta = np.linalg.solve(A, c)
    se = np.sqrt(np.diag(np.linalg.inv(A)))
    logdet = n * math.log(residual) + np.linalg.slogdet(inner)[1] - np.log(inv_d).sum()
    quad = vinv[p, p] - 2 * beta @ c + beta @ A @ beta
    ll = -0.5 * (n * math.log(2 * math.pi) + logdet + quad)
    k = p + len(random) + 1
    mean_x = G[0, :p] / n
    var_fixed = float(beta @ (G[:p, :p] / n - np.outer(mean_x, mean_x)) @ beta)
    var_random = sum(variances)
    every = var_fixed + var_random + residual
    out = [dict(term=t, estimate=b, std_error=s, statistic=b / s, p_value=2 * S.norm_sf(abs(b / s))) for t, b, s in zip(terms, beta, se, strict=True)]
    out += [dict(term=f"var({f})", estimate=v) for f, v in zip(random, variances, strict=True)]
    out += [dict(term="var(residual)", estimate=residual), dict(term="(fit)", estimate=ll, log_likelihood=ll, aic=-2 * ll + 2 * k, bic=-2 * ll + k * math.log(n), r_squared_marginal=var_fixed / every, r_squared_conditional=(var_fixed + var_random) / every, icc=var_random / (var_random + residual), n_obs=n, n_groups=len(Z[0][0]))]
    return frame(df, out, "term string, estimate double, std_error double, statistic double, p_value double, log_likelihood double, aic double, bic double, r_squared_marginal double, r_squared_conditional double, icc double, n_obs long, n_groups long")


def nested_anova(df: DataFrame, response: str, factors: Sequence[str], alpha: float = 0.05) -> DataFrame:
    return mixed_model(df, response, [], factors, alpha)


def variance_decomposition(df: DataFrame, response: str, factors: Sequence[str]) -> DataFrame:
    """Factors one after another take their level means out of the residual; percent of the components' sum."""
    rows = clean(df, [response], factors).withColumn("_r", F.col(response))
    parts = {}
    total = rows.agg(F.var_samp("_r")).first()[0]
    for f in factors:
        mean = F.avg("_r").over(Window.partitionBy(f))
        s = rows.agg(F.var_pop("_r").alias("a")).first()["a"]
        rows = rows.withColumn("_r", F.col("_r") - mean)
        parts[f] = s - rows.agg(F.var_pop("_r").alias("a")).first()["a"]
    parts["Residual"] = rows.agg(F.var_samp("_r")).first()[0]
    whole = sum(parts.values())
    return frame(df, [dict(component=c, variance=v, pct=100 * v / whole if whole else 0.0, total=total, icc=v / whole if whole else 0.0) for c, v in parts.items()], "component string, variance double, pct double, total double, icc double")
