"""Measurement-system analysis: agreement, bias, gage studies, kappa and alpha."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import special as S
from quillon.operators.parametric import cells_in_one, need, split_cells
from quillon.plans.stats import clean, dicts, finish, gram, unpack_gram


def icc(df: DataFrame, value: str, subject: str, rater: str, icc_type: str = "ICC(3,1)", ci_level: float = 0.95) -> DataFrame:
    """Estimates clipped to [0, 1]; F and limits always in the ICC(3,1) form. Subjects need every rater once.

    The subject margin is as long as the subjects, so its sum of squares is taken in Spark, not from collected cells.
    """
    rows = clean(df, [value], [subject, rater])
    whole = rows.agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count("*").alias("total"), F.countDistinct(rater).alias("k"))
    per = rows.groupBy(subject).agg(F.avg(value).alias("ms"), F.count("*").alias("c")).crossJoin(F.broadcast(whole.select("m")))
    subj = per.agg(F.count("*").alias("n"), F.sum(F.col("c") * F.pow(F.col("ms") - F.col("m"), F.lit(2.0))).alias("ssr"))
    col = rows.groupBy(rater).agg(F.avg(value).alias("mc"), F.count("*").alias("c")).crossJoin(F.broadcast(whole.select("m"))).agg(F.sum(F.col("c") * F.pow(F.col("mc") - F.col("m"), F.lit(2.0))).alias("ssc"))

    def close(r):
        n, k = int(r["n"]), int(r["k"])
        need(n > 1 and k > 1, "at least 2 subjects and 2 raters are needed")
        sst, ssr, ssc = r["v"] * r["total"], r["ssr"], r["ssc"]
        sse = sst - ssr - ssc
        msr, msc, mse = ssr / (n - 1), ssc / (k - 1), sse / ((n - 1) * (k - 1))
        if icc_type == "ICC(1,1)":
            msw = (sst - ssr) / (n * (k - 1))
            top, den = msr - msw, msr + (k - 1) * msw
        elif icc_type == "ICC(2,1)":
            top, den = msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n
        else:
            top, den = msr - mse, msr + (k - 1) * mse
        f = msr / mse if mse > 0 else 0.0
        d1, d2 = n - 1, (n - 1) * (k - 1)
        bound = lambda q: (f / q - 1) / (f / q + k - 1)
        a = 1 - ci_level
        return dict(icc=min(1.0, max(0.0, top / den if den > 0 else 0.0)), icc_type=icc_type, ci_lower=max(0.0, bound(S.f_ppf(1 - a / 2, d1, d2))), ci_upper=min(1.0, bound(S.f_ppf(a / 2, d1, d2))), f_statistic=f, p_value=S.f_sf(f, d1, d2), n_subjects=n, n_raters=k)

    return finish(whole.crossJoin(F.broadcast(subj)).crossJoin(F.broadcast(col)), (), close, "icc double, icc_type string, ci_lower double, ci_upper double, f_statistic double, p_value double, n_subjects long, n_raters long")


def slope_test(n: int, s: np.ndarray, mean: np.ndarray) -> tuple[float, float, float, float]:
    """(slope, intercept, r squared, p) of column 1 on column 0."""
    slope = s[0, 1] / s[0, 0] if s[0, 0] > 0 else 0.0
    r2 = s[0, 1] ** 2 / (s[0, 0] * s[1, 1]) if s[0, 0] > 0 and s[1, 1] > 0 else 0.0
    t = math.sqrt(r2 * (n - 2) / (1 - r2)) if r2 < 1 and n > 2 else math.inf
    return slope, mean[1] - slope * mean[0], r2, S.t_two(t, n - 2)


def bland_altman(df: DataFrame, method1: str, method2: str, ci_level: float = 0.95, by=()) -> DataFrame:
    rows = clean(df, [method1, method2], by=by).select(*by, ((F.col(method1) + F.col(method2)) / 2).alias("_m"), (F.col(method1) - F.col(method2)).alias("_d"))

    def close(r):
        n, mean, s = unpack_gram(r, 2)
        sd = math.sqrt(s[1, 1] / (n - 1))
        half = S.t_ppf((1 + ci_level) / 2, n - 1) * sd / math.sqrt(n)
        return dict(mean_diff=mean[1], std_diff=sd, loa_lower=mean[1] - 1.96 * sd, loa_upper=mean[1] + 1.96 * sd, ci_mean_lower=mean[1] - half, ci_mean_upper=mean[1] + half, n=n, proportional_bias=slope_test(n, s, mean)[3] < 0.05)

    return finish(gram(rows, ["_m", "_d"], by), by, close, "mean_diff double, std_diff double, loa_lower double, loa_upper double, ci_mean_lower double, ci_mean_upper double, n long, proportional_bias boolean")


def linearity_bias(df: DataFrame, reference: str, measured: str) -> DataFrame:
    rows = clean(df, [reference, measured]).select(F.col(reference).alias("_r"), (F.col(measured) - F.col(reference)).alias("_b"))
    levels = rows.groupBy("_r").agg(F.avg("_b").alias("b")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_r", "b")))).alias("levels"))

    def close(r):
        n, mean, s = unpack_gram(r, 2)
        slope, cut, r2, p = slope_test(n, s, mean)
        return dict(overall_bias=mean[1], linearity_slope=slope, linearity_intercept=cut, linearity_r_squared=r2, linearity_p_value=p, bias_significant=p < 0.05)

    head = finish(gram(rows, ["_r", "_b"]), (), close, "overall_bias double, linearity_slope double, linearity_intercept double, linearity_r_squared double, linearity_p_value double, bias_significant boolean")
    return head.crossJoin(F.broadcast(levels.withColumnRenamed("levels", "bias_per_level")))


def crossed_gage_rr(df: DataFrame, value: str, part: str, operator: str) -> DataFrame:
    """Crossed study by expected mean squares; percentages of variance.

    Cells of unlike sizes enter by their means, weighted alike, with the harmonic mean of the sizes as replicates
    (unweighted-means analysis); repeatability pools the variances of all rows. Balanced studies give the usual form.
    """

    def close(r):
        whole, P, O, PO = split_cells(dicts(r["cells"]))
        p, o, n = len(P), len(O), whole["n"]
        need(len(PO) == p * o, "every operator has to measure every part")
        need(n > p * o, "replicates are needed")
        reps = p * o / sum(1 / c["n"] for c in PO.values())
        mp, mo = ({k: np.mean([c["mean"] for key, c in PO.items() if key[i] == k]) for k in keys} for i, keys in enumerate((P, O)))
        m = np.mean([c["mean"] for c in PO.values()])
        ssp, sso = reps * o * sum((v - m) ** 2 for v in mp.values()), reps * p * sum((v - m) ** 2 for v in mo.values())
        ssi = reps * sum((c["mean"] - mp[i] - mo[j] + m) ** 2 for (i, j), c in PO.items())
        sse = sum(c["var"] * c["n"] for c in PO.values())
        msp, mso, msi, mse = ssp / max(p - 1, 1), sso / max(o - 1, 1), ssi / max((p - 1) * (o - 1), 1), sse / (n - p * o)
        vi, vo, vp = max(0.0, (msi - mse) / reps), max(0.0, (mso - msi) / (p * reps)), max(0.0, (msp - msi) / (o * reps))
        repro, grr = vo + vi, vo + vi + mse
        total = grr + vp
        pct = lambda v: 100 * v / total if total > 0 else 0.0
        return dict(design="crossed", var_repeatability=mse, var_reproducibility=repro, var_operator=vo, var_interaction=vi, var_part=vp, var_gage_rr=grr, var_total=total, pct_repeatability=pct(mse), pct_reproducibility=pct(repro), pct_gage_rr=pct(grr), pct_part=pct(vp), ndc=int(1.41 * math.sqrt(vp / grr)) if grr > 0 else 0, n_operators=o, n_parts=p, n_replicates=n // (p * o), ms_part=msp, ms_operator=mso, ms_interaction=msi, ms_repeatability=mse)

    return finish(cells_in_one(df, value, part, operator), (), close, "design string, var_repeatability double, var_reproducibility double, var_operator double, var_interaction double, var_part double, var_gage_rr double, var_total double, pct_repeatability double, pct_reproducibility double, pct_gage_rr double, pct_part double, ndc long, n_operators long, n_parts long, n_replicates long, ms_part double, ms_operator double, ms_interaction double, ms_repeatability double")


def interpret_agreement(k: float) -> str:
    for bound, word in ((0.0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial")):
        if k < bound:
            return word
    return "almost_perfect"


AGREE = "method string, value double, n_subjects long, n_raters long, interpretation string"


def krippendorff_alpha(df: DataFrame, value: str, unit: str, level: str = "nominal", canonical: bool = False) -> DataFrame:
    """Observed disagreement pools all within-unit pairs (canonical: each unit weighted 1 / (m - 1)), expected over all pairs.

    Both come from value counts: with metric d and counts c the sum over pairs of d needs no pair.
    """
    rows = df.filter(F.col(value).isNotNull())
    v = F.col(value).cast("double") if level != "nominal" else F.col(value).cast("string")
    per = rows.groupBy(unit, v.alias("v")).agg(F.count("*").cast("double").alias("c"))
    sizes = per.groupBy(unit).agg(F.sum("c").alias("m"))
    many = per.join(sizes.filter("m > 1"), unit)
    w = F.lit(1.0) / (F.col("m") - 1) if canonical else F.lit(1.0)
    metric = {"nominal": None, "ordinal": 1, "interval": 2, "ratio": 2}[level]

    def disagreement(t: DataFrame, key: list[str], weight) -> DataFrame:
        """Ordered-pair sums of d and numbers of pairs per key."""
        if metric is None:
            one = t.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc"))
            return one.select(*key, (F.col("n") * F.col("n") - F.col("cc")).alias("d"), (F.col("n") * (F.col("n") - 1)).alias("pairs"))
        if metric == 2:
            one = t.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("s"), F.sum(F.col("c") * F.col("v") * F.col("v")).alias("ss"))
            return one.select(*key, (2 * (F.col("n") * F.col("ss") - F.col("s") * F.col("s"))).alias("d"), (F.col("n") * (F.col("n") - 1)).alias("pairs"))
        from pyspark.sql import Window

        win = Window.partitionBy(*key, F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        less = t.withColumn("n0", F.coalesce(F.sum("c").over(win), F.lit(0.0))).withColumn("s0", F.coalesce(F.sum(F.col("c") * F.col("v")).over(win), F.lit(0.0)))
        one = less.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("v") * F.col("n0") - F.col("s0"))).alias("h"))
        return one.select(*key, (2 * F.col("h")).alias("d"), (F.col("n") * (F.col("n") - 1)).alias("pairs"))

    inside = disagreement(many, [unit], w).join(sizes, unit)
    do = inside.agg(F.sum(F.col("d") * w).alias("d"), F.sum(F.col("pairs") * w).alias("p"), F.count("*").alias("units"), F.max("m").alias("raters"))
    pool = many.groupBy("v").agg(F.sum("c").alias("c"))
    de = disagreement(pool, [], None).select(F.col("d").alias("de"), F.col("pairs").alias("pe"))

    def close(r):
        o, e = (r["d"] / r["p"] if r["p"] else 0.0), (r["de"] / r["pe"] if r["pe"] else 0.0)
        a = 1 - o / e if e > 0 else 1.0
        return dict(method=f"Krippendorff's alpha ({level})", value=a, n_subjects=r["units"], n_raters=r["raters"], interpretation=interpret_agreement(a))

    return finish(do.crossJoin(F.broadcast(de)), (), close, AGREE)


def fleiss_kappa(df: DataFrame, category: str, subject: str) -> DataFrame:
    """Agreement is taken per subject over its own number of ratings and averaged, chance from all ratings pooled.

    With equal numbers this is the usual kappa. A subject with one rating has no pair: it counts in the pool alone.
    """
    per = df.filter(F.col(category).isNotNull()).groupBy(subject, category).agg(F.count("*").cast("double").alias("_c"))
    subj = per.groupBy(subject).agg(F.sum("_c").alias("m"), F.sum(F.col("_c") * F.col("_c")).alias("cc"))
    s = subj.agg(F.count("*").alias("N"), F.max("m").alias("m"), F.avg(F.when(F.col("m") > 1, (F.col("cc") - F.col("m")) / (F.col("m") * (F.col("m") - 1)))).alias("po"))
    cats = per.groupBy(category).agg(F.sum("_c").alias("_c")).agg(F.sum("_c").alias("t"), F.sum(F.col("_c") * F.col("_c")).alias("tt"))

    def close(r):
        need(r["m"] is not None and r["m"] > 1, "a subject with at least 2 ratings is needed")
        pe = r["tt"] / r["t"] ** 2
        k = (r["po"] - pe) / (1 - pe) if pe < 1 else 1.0
        return dict(method="Fleiss' kappa", value=k, n_subjects=r["N"], n_raters=r["m"], interpretation=interpret_agreement(k))

    return finish(s.crossJoin(F.broadcast(cats)), (), close, AGREE)
