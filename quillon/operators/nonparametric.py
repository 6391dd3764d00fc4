"""Rank tests and post-hoc comparisons."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import effects as E
from quillon.functions import special as S
from quillon.operators.parametric import TEST, _only, anova_parts, need, result, two, two_sample_from
from quillon.plans.blocks import percentiles
from quillon.plans.differences import BINS, Differences
from quillon.plans.stats import clean, dicts, finish, group_stats, mid_rank, ordered, value_table, var0

RANK = TEST + ", median1 double, median2 double, median_diff double, n1 long, n2 long, method string"


def rank_groups(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Per by: g (label, n, rank_sum, median), n and ties (sum of t^3 - t)."""
    t = value_table(df, value, group, by)
    per = t.groupBy(*by, group).agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * mid_rank()).alias("rank_sum"))
    med = clean(df, [value], [group], by).groupBy(*by, group).agg(F.median(value).alias("median"))
    per = per.join(med, [*by, group])
    g = per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(group).cast("string").alias("label"), "n", "rank_sum", "median"))).alias("g"))
    # each value's tie is spread over the groups that have it: weigh by cnt / tie
    ties = t.groupBy(*by).agg(F.sum(F.col("cnt") * (F.pow("tie", F.lit(2.0)) - 1)).alias("ties"))
    return g.join(ties, list(by)) if by else g.crossJoin(F.broadcast(ties))


def middle(rows: DataFrame, value: str) -> Column:
    """The exact median of all rows as a literal."""
    found = percentiles(rows.select(value), [0.5])[1]
    return F.lit(found[0] if found else None).cast("double")


def hodges_lehmann(df: DataFrame, value: str, group: str, labels: tuple[str, str], most_pairs: int = 4_000_000, tolerance: float = 0.0) -> float:
    """Median of all differences x - y: the mean of the two middle ones, at every size.

    With few distinct values the differences of these are weighed on the driver; else the two middle ones are
    selected by counts over ranges of both samples (see Differences), of which the driver takes at most `most_pairs` differences. They
    are exact unless a `tolerance`, in parts of the values' range, lets the search stop before.
    """
    rows = clean(df, [value], [group]).filter(F.col(group).cast("string").isin(list(labels)))
    a, b = (rows.filter(F.col(group).cast("string") == x).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("w")).cache() for x in labels)
    n = a.agg(F.sum("w")).first()[0] * b.agg(F.sum("w")).first()[0]
    k1, k2 = (n + 1) // 2, n // 2 + 1

    if a.count() * b.count() <= most_pairs:
        xa, xb = a.toPandas(), b.toPandas()
        diff = np.subtract.outer(xa["v"].to_numpy(), xb["v"].to_numpy()).ravel()
        weight = np.multiply.outer(xa["w"].to_numpy(), xb["w"].to_numpy()).ravel()
        order = np.argsort(diff)
        run = np.cumsum(weight[order])
        found = [float(diff[order][np.searchsorted(run, k)]) for k in (k1, k2)]
    else:
        steps = [i / (BINS + 1) for i in range(1, BINS + 1)]
        label = F.col(group).cast("string")
        lo, hi, *edges = rows.agg(F.min(value), F.max(value), *(F.percentile_approx(F.when(label == x, F.col(value)), steps, 4000) for x in labels)).first()
        pairs = Differences(a, b, edges, k1, k2)
        found = pairs.select(k1, k2, most_pairs, tolerance * (hi - lo))
        pairs.close()
    a.unpersist()
    b.unpersist()
    return (found[0] + found[1]) / 2


def mann_whitney_from(a: dict, b: dict, ties: float, alpha: float, alternative: str = "two-sided") -> dict:
    n1, n2 = int(a["n"]), int(b["n"])
    n = n1 + n2
    u = a["rank_sum"] - n1 * (n1 + 1) / 2
    if min(n1, n2) <= 8 and ties == 0:
        p, how = S.mann_whitney_exact(u, n1, n2, alternative), "exact"
    else:
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        how = "asymptotic"
        if sd == 0:
            p = 1.0
        elif alternative == "two-sided":
            p = min(1.0, 2 * S.norm_sf((abs(u - n1 * n2 / 2) - 0.5) / sd))
        else:
            z = (u - n1 * n2 / 2) / sd
            p = S.norm_sf(z - 0.5 / sd) if alternative == "greater" else S.norm_cdf(z + 0.5 / sd)
    return result("Mann-Whitney U", u, p, alpha, effect=E.rank_biserial(u, n1, n2), kind="rank_biserial", median1=a["median"], median2=b["median"], median_diff=a["median"] - b["median"], n1=n1, n2=n2, method=how)


def mann_whitney(df: DataFrame, value: str, group: str, alpha: float = 0.05, alternative: str = "two-sided", labels: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """median_diff is the difference of medians; hodges_lehmann() gives the shift estimate."""

    def close(r):
        g = dicts(r["g"])
        if labels is not None:
            g = [next(x for x in g if x["label"] == str(y)) for y in labels]
        need(len(g) == 2, "two groups are needed")
        return mann_whitney_from(g[0], g[1], r["ties"], alpha, alternative)

    return finish(rank_groups(_only(df, group, labels), value, group, by), by, close, RANK)


def kruskal_from(g: list[dict], ties: float) -> tuple[float, int, int]:
    n = sum(x["n"] for x in g)
    h = 12 / (n * (n + 1)) * sum(x["rank_sum"] ** 2 / x["n"] for x in g) - 3 * (n + 1)
    fix = 1 - ties / (n**3 - n)
    return (h / fix if fix > 0 else 0.0), len(g) - 1, n


def kruskal_wallis(df: DataFrame, value: str, group: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        g = dicts(r["g"])
        need(len(g) >= 2, "at least 2 groups are needed")
        h, d, n = kruskal_from(g, r["ties"])
        return result("Kruskal-Wallis H", h, S.chi2_sf(h, d), alpha, d, effect=E.epsilon_squared(h, n), kind="epsilon_squared", median1=g[0]["median"], median2=g[1]["median"], n1=n, method="tie-corrected")

    return finish(rank_groups(df, value, group, by), by, close, RANK)


def wilcoxon_signed_rank(df: DataFrame, x1: str, x2: str | None = None, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    rows = clean(df, [x1, x2] if x2 else [x1], by=by)
    rows = rows.withColumn("_d", F.col(x1) - F.col(x2) if x2 else F.col(x1)).withColumn("_s", F.signum("_d")).withColumn("_a", F.abs("_d"))
    base = rows.groupBy(*by).agg(F.count("*").alias("all"), F.median(x1).alias("m1"), *([F.median(x2).alias("m2")] if x2 else []), F.median("_d").alias("md"))
    t = value_table(rows.filter("_d <> 0"), "_a", "_s", by)
    sums = t.groupBy(*by).agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("_s") > 0, F.col("cnt") * mid_rank()).otherwise(0.0)).alias("plus"), F.sum(F.col("cnt") * mid_rank()).alias("total"), F.sum(F.col("cnt") * (F.pow("tie", F.lit(2.0)) - 1)).alias("ties"))
    stats = base.join(sums, list(by), "left") if by else base.crossJoin(F.broadcast(sums))

    def close(r):
        need(r["all"] >= 6, "at least 6 pairs are needed")
        n = 0 if r["n"] is None or r["n"] != r["n"] else int(r["n"])
        more = dict(median1=r["m1"], median2=r.get("m2"), median_diff=r["md"], n1=n)
        if n == 0:
            return result("Wilcoxon signed-rank", 0.0, 1.0, alpha, effect=0.0, kind="r", method="no differences", **more)
        w = min(r["plus"], r["total"] - r["plus"])
        if n <= 50 and r["ties"] == 0 and n == r["all"]:
            p, how = S.wilcoxon_exact(w, n), "exact"
        else:
            sd = math.sqrt((n * (n + 1) * (2 * n + 1) - r["ties"] / 2) / 24)
            p, how = 2 * S.norm_sf(abs(w - n * (n + 1) / 4) / sd), "asymptotic"
        z = abs(S.norm_ppf(p / 2)) if 0 < p < 1 else 0.0
        return result("Wilcoxon signed-rank", w, p, alpha, effect=z / math.sqrt(n), kind="r", method=how, **more)

    return finish(stats, by, close, RANK)


def friedman(df: DataFrame, value: str, subject: str, condition: str, alpha: float = 0.05) -> DataFrame:
    """Subjects missing a condition are left out; a subject's repeated values are averaged."""
    rows = clean(df, [value], [subject, condition]).groupBy(subject, condition).agg(F.avg(value).alias("y"))
    w = Window.partitionBy(subject)
    k = rows.select(condition).distinct().count()
    tie = F.count("*").over(Window.partitionBy(subject, "y"))
    ranked = rows.withColumn("k", F.count("*").over(w)).filter(F.col("k") == k).withColumn("r", F.rank().over(w.orderBy("y")) + (tie - 1) / F.lit(2.0)).withColumn("t", (tie * tie - 1).cast("double"))
    per = ranked.groupBy(condition).agg(F.count("*").alias("n"), F.sum("r").alias("rs"), F.sum("t").alias("t"))
    stats = per.groupBy().agg(F.collect_list(F.struct("n", "rs", "t")).alias("g"))

    def close(r):
        g = dicts(r["g"])
        n, k = g[0]["n"], len(g)
        need(k >= 3, "at least 3 conditions are needed")
        x = 12 / (n * k * (k + 1)) * sum(c["rs"] ** 2 for c in g) - 3 * n * (k + 1)
        fix = 1 - sum(c["t"] for c in g) / (n * k * (k * k - 1))
        x = x / fix if fix > 0 else 0.0
        kw = x / (n * (k - 1))
        return result("Friedman test", x, S.chi2_sf(x, k - 1), alpha, k - 1, effect=kw, kind="r", kendall_w=kw, n_subjects=n)

    return finish(stats, (), close, TEST + ", kendall_w double, n_subjects long")


def mood_median(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    from quillon.operators.parametric import chi2_of

    rows = clean(df, [value], [group])
    med = middle(rows, value)
    per = rows.withColumn("_m", med).groupBy(group).agg(F.sum((F.col(value) > F.col("_m")).cast("long")).alias("above"), F.count("*").alias("n"), F.first("_m").alias("m"))
    stats = per.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col(group).cast("string").alias("label"), "above", "n", "m"))).alias("g"))

    def close(r):
        g = dicts(r["g"])
        o = np.array([[x["above"] for x in g], [x["n"] - x["above"] for x in g]], float)
        x, d, _ = chi2_of(o)
        v = E.cramers_v(x, o.sum(), 2)
        return result("Mood's median test", x, S.chi2_sf(x, d), alpha, d, effect=v, kind="cramers_v", grand_median=g[0]["m"])

    return finish(stats, (), close, TEST + ", grand_median double")


def sign_test(df: DataFrame, value: str, median0: float = 0.0, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    rows = clean(df, [value], by=by)
    stats = rows.groupBy(*by).agg(F.sum((F.col(value) > median0).cast("long")).alias("up"), F.sum((F.col(value) < median0).cast("long")).alias("down"))

    def close(r):
        up, down = int(r["up"] or 0), int(r["down"] or 0)
        n = up + down
        p = S.binom_two(up, n) if n else 1.0
        return result("Sign test", up, p, alpha, effect=abs(up / n - 0.5) * 2 if n else 0.0, kind="r", n_above=up, n_below=down)

    return finish(stats, by, close, TEST + ", n_above long, n_below long")


def runs_test(df: DataFrame, value: str, order: Sequence[str], cutoff: float | None = None, alpha: float = 0.05) -> DataFrame:
    rows = clean(df, [value], order)
    pos = ordered(rows, order)
    cut = F.lit(float(cutoff)) if cutoff is not None else F.col("_m")
    med = middle(rows, value)
    signs = pos.withColumn("_m", med).withColumn("s", F.col(value) > cut).select("pos", "s", "_m")
    # neighbours meet by an equi-join on position, so nothing needs one global window
    after = signs.select((F.col("pos") - 1).alias("pos"), F.col("s").alias("s2"))
    stats = signs.join(after, "pos", "left").agg(F.count("*").alias("n"), F.sum(F.col("s").cast("long")).alias("n1"), F.sum((F.col("s") != F.col("s2")).cast("long")).alias("changes"))

    def close(r):
        n, n1 = int(r["n"]), int(r["n1"] or 0)
        need(n >= 10, "at least 10 observations are needed")
        n2, runs = n - n1, int(r["changes"] or 0) + 1
        if n1 == 0 or n2 == 0:
            return result("Runs test", 0.0, 1.0, alpha, effect=None, n_runs=runs, expected_runs=1.0, n1=n1, n2=n2)
        mean = 2 * n1 * n2 / n + 1
        sd = math.sqrt(2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)))
        z = (runs - mean) / sd if sd > 0 else 0.0
        return result("Runs test", z, 2 * S.norm_sf(abs(z)), alpha, effect=None, n_runs=runs, expected_runs=mean, n1=n1, n2=n2)

    return finish(stats, (), close, TEST + ", n_runs long, expected_runs double, n1 long, n2 long")


COMPARISON = "group1 string, group2 string, mean_diff double, se double, t_or_q double, p_value double, ci_lower double, ci_upper double, significant boolean"


def _pairs(g: list[dict], make: Callable[[dict, dict], dict]) -> list[dict]:
    need(len(g) >= 2, "at least 2 groups are needed")
    return [dict(group1=a["label"], group2=b["label"], mean_diff=a.get("mean", 0.0) - b.get("mean", 0.0)) | make(a, b) for a, b in combinations(g, 2)]


def tukey_hsd(df: DataFrame, value: str, group: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        g = dicts(r["g"])
        a = anova_parts(g)
        crit = S.studentized_range_ppf(1 - alpha, a["k"], a["df_within"])

        def one(x, y):
            diff, se = x["mean"] - y["mean"], math.sqrt(a["ms_within"] / 2 * (1 / x["n"] + 1 / y["n"]))
            q = abs(diff) / se if se > 0 else 0.0
            p = S.studentized_range_sf(q, a["k"], a["df_within"])
            return dict(se=se, t_or_q=q, p_value=p, ci_lower=diff - crit * se, ci_upper=diff + crit * se, significant=p < alpha)

        return _pairs(g, one)

    return finish(group_stats(df, value, group, by), by, close, COMPARISON)


def games_howell(df: DataFrame, value: str, group: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """t_or_q leaves out the factor sqrt(2) of the textbook statistic, which q_std carries."""

    def close(r):
        g = dicts(r["g"])

        def one(x, y):
            w = two_sample_from(x, y, False, alpha, 1 - alpha)
            q = abs(w["mean_diff"]) / w["se"] if w["se"] > 0 else 0.0
            p = S.studentized_range_sf(q, len(g), w["df"])
            half = S.studentized_range_ppf(1 - alpha, len(g), w["df"]) * w["se"]
            return dict(se=w["se"], t_or_q=q, p_value=p, ci_lower=w["mean_diff"] - half, ci_upper=w["mean_diff"] + half, significant=p < alpha, q_std=q * math.sqrt(2))

        return _pairs(g, one)

    return finish(group_stats(df, value, group, by), by, close, COMPARISON + ", q_std double")


def dunnett(df: DataFrame, value: str, group: str, control: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        g = dicts(r["g"])
        a = anova_parts(g)
        c = next(x for x in g if x["label"] == str(control))
        others = [x for x in g if x is not c]
        load = [math.sqrt(x["n"] / (x["n"] + c["n"])) for x in others]
        out = []
        for x in others:
            se = math.sqrt(a["ms_within"] * (1 / x["n"] + 1 / c["n"]))
            t = (x["mean"] - c["mean"]) / se
            p = S.dunnett_sf(abs(t), load, a["df_within"])
            out.append(dict(group1=x["label"], group2=c["label"], mean_diff=x["mean"] - c["mean"], se=se, t_or_q=t, p_value=p, significant=p < alpha))
        return out

    return finish(group_stats(df, value, group, by), by, close, COMPARISON)


def dunn(df: DataFrame, value: str, group: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Mean-rank differences, Bonferroni-adjusted; mean_diff is in ranks."""

    def close(r):
        g = dicts(r["g"])
        n = sum(x["n"] for x in g)
        base = n * (n + 1) / 12 - r["ties"] / (12 * (n - 1))
        m = len(g) * (len(g) - 1) // 2
        for x in g:
            x["mean"] = x["rank_sum"] / x["n"]

        def one(x, y):
            se = math.sqrt(base * (1 / x["n"] + 1 / y["n"]))
            z = (x["mean"] - y["mean"]) / se
            p = min(1.0, 2 * S.norm_sf(abs(z)) * m)
            return dict(se=se, t_or_q=z, p_value=p, significant=p < alpha)

        return _pairs(g, one)

    return finish(rank_groups(df, value, group, by), by, close, COMPARISON)


def bonferroni(df: DataFrame, value: str, group: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        g = dicts(r["g"])
        m = len(g) * (len(g) - 1) // 2

        def one(x, y):
            w = two_sample_from(x, y, False, alpha / m, 1 - alpha / m)
            p = min(1.0, w["p_value"] * m)
            return dict(se=w["se"], t_or_q=w["statistic"], p_value=p, ci_lower=w["ci_lower"], ci_upper=w["ci_upper"], significant=p < alpha)

        return _pairs(g, one)

    return finish(group_stats(df, value, group, by), by, close, COMPARISON)


def scheffe(df: DataFrame, value: str, group: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    def close(r):
        g = dicts(r["g"])
        a = anova_parts(g)
        d = a["k"] - 1
        crit = math.sqrt(d * S.f_ppf(1 - alpha, d, a["df_within"]))

        def one(x, y):
            diff, se = x["mean"] - y["mean"], math.sqrt(a["ms_within"] * (1 / x["n"] + 1 / y["n"]))
            f = (diff / se) ** 2 / d if se > 0 else 0.0
            p = S.f_sf(f, d, a["df_within"])
            return dict(se=se, t_or_q=f, p_value=p, ci_lower=diff - crit * se, ci_upper=diff + crit * se, significant=p < alpha)

        return _pairs(g, one)

    return finish(group_stats(df, value, group, by), by, close, COMPARISON)
