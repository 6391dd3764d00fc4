"""False-discovery control, data profiles, the automatic router and its explanations.

The router profiles the groups with one set of aggregates, decides on the driver, and runs the chosen test as
the ordinary operator; it returns one row, with post-hoc rows under `posthoc`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.effects import classify_effect
from quillon.operators import core, nonparametric, parametric, power, regression
from quillon.operators.parametric import need
from quillon.plans.stats import clean, frame, value_table


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """df with rank, adjusted_p, significant. Ranks come from the value table of p; the running minimum is two-level.

    Equal p-values share their largest rank, which gives the same adjusted values as any order of them.
    """
    t = value_table(df, p)
    m = clean(df, [p]).agg(F.count("*").alias("_m"))
    r = t.crossJoin(F.broadcast(m)).withColumn("_raw", F.col(p) * F.col("_m") / (F.col("before") + F.col("cnt"))).withColumn("_b", F.floor(F.col(p) * 128))
    low = r.groupBy("_b").agg(F.min("_raw").alias("_low"))
    after = low.select("_b", F.min("_low").over(Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_after"))  # at most 129 rows
    w = Window.partitionBy("_b").orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    adj = r.join(F.broadcast(after), "_b").select(F.col(p).alias("_p"), (F.col("before") + F.col("cnt")).alias("rank"), F.least(F.lit(1.0), F.min("_raw").over(w), F.coalesce("_after", F.lit(1.0))).alias("adjusted_p"))
    out = df.join(adj, df[p].cast("double") == adj["_p"]).drop("_p")
    return out.withColumn("significant", F.col("adjusted_p") <= alpha)


def holm_bonferroni(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """df with adjusted_p (step-down running maximum of (m - rank + 1) p) and significant."""
    t = value_table(df, p)
    m = clean(df, [p]).agg(F.count("*").alias("_m"))
    r = t.crossJoin(F.broadcast(m)).withColumn("_raw", F.col(p) * (F.col("_m") - F.col("before"))).withColumn("_b", F.floor(F.col(p) * 128))
    top = r.groupBy("_b").agg(F.max("_raw").alias("_top"))
    ahead = top.select("_b", F.max("_top").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"))
    w = Window.partitionBy("_b").orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adj = r.join(F.broadcast(ahead), "_b").select(F.col(p).alias("_p"), F.least(F.lit(1.0), F.greatest(F.max("_raw").over(w), F.coalesce("_ahead", F.lit(0.0)))).alias("adjusted_p"))
    return df.join(adj, df[p].cast("double") == adj["_p"]).drop("_p").withColumn("significant", F.col("adjusted_p") <= alpha)


def fdr_summary(df: DataFrame, name: str, p: str, alpha: float = 0.05, top: int = 50) -> str:
    """A text table of the `top` strongest adjusted tests, and counts over all of them."""
    tests = benjamini_hochberg(df, p, alpha)
    n, hits = tests.agg(F.count("*"), F.coalesce(F.sum(F.col("significant").cast("long")), F.lit(0))).first()
    lines = [f"{'test':<30} {'p':>10} {'adjusted':>10}  discovery"]
    lines += [f"{str(r[name]):<30} {r[p]:>10.4g} {r['adjusted_p']:>10.4g}  {'yes' if r['significant'] else 'no'}" for r in tests.orderBy(p, name).limit(top).collect()]
    return "\n".join([*lines, *([f"and {n - top} weaker ones"] if n > top else []), f"{hits} of {n} at FDR {alpha}"])


PROFILE = "group string, n long, normal boolean, normality_p double, n_outliers long, n_distinct long, min double, all_integer boolean"


def profile_data(df: DataFrame, value: str, group: str | None = None, alpha: float = 0.05) -> DataFrame:
    """A row per group: size, normality, outliers, distinct values, and the data type they suggest."""
    rows = df if group else df.withColumn("_all", F.lit("all"))
    g = group or "_all"
    base = clean(rows, [value], [g]).groupBy(F.col(g).cast("string").alias("group")).agg(F.count("*").alias("n"), F.countDistinct(value).alias("n_distinct"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.median(value).alias("median"), F.min(value).alias("min"), F.bool_and(F.col(value) == F.floor(value)).alias("all_integer"))
    norm = core.check_normality(rows, value, alpha=alpha, by=[g]).select(F.col(g).cast("string").alias("group"), F.col("passed").alias("normal"), F.col("p_value").alias("normality_p"))
    outl = core.check_outliers(rows, value, by=[g]).select(F.col(g).cast("string").alias("group"), F.coalesce("statistic", F.lit(0.0)).cast("long").alias("n_outliers"))
    kind = F.when(F.col("n_distinct") == 2, "binary").when(F.col("all_integer") & (F.col("min") >= 0) & (F.col("n_distinct") <= 20), "counts").when(F.col("all_integer") & (F.col("n_distinct") <= 10), "ordinal").otherwise("continuous")
    return base.join(norm, "group").join(outl, "group").withColumn("data_type", kind).withColumn("has_ties", F.col("n_distinct") < F.col("n"))


ANALYSIS = "test_name string, statistic double, p_value double, effect_size double, effect_type string, effect_label string, power double, confidence string, significant boolean, interpretation string, recommendations array<string>, decision_path array<string>, posthoc array<string>"


def rate_confidence(sizes: Sequence[int], got_power: float | None, violations: int) -> str:
    """Issue points: a group under 5 counts 2, under 20 counts 1, power under .5 counts 2, under .8 counts 1, each violated check 1."""
    points = (2 if min(sizes) < 5 else 1 if min(sizes) < 20 else 0) + violations
    if got_power is not None:
        points += 2 if got_power < 0.5 else 1 if got_power < 0.8 else 0
    return "high" if points == 0 else "moderate" if points <= 2 else "low"


def _sentence(name: str, r: dict, alpha: float) -> str:
    verdict = "a significant difference" if r["p_value"] < alpha else "no significant difference"
    tail = f", effect {r['effect_size']:.3g} ({r['effect_label']})" if r.get("effect_size") is not None else ""
    return f"{name} found {verdict} (statistic {r['statistic']:.4g}, p {r['p_value']:.4g}){tail}."


def auto_analyze(df: DataFrame, goal: str = "compare", value: str | None = None, group: str | None = None, columns: Sequence[str] | None = None, subject: str | None = None, alpha: float = 0.05, mu: float | None = None, margin: float | None = None, response: str | None = None) -> DataFrame:
    """Pick, run and explain a test. Goals: compare (value by group, paired through `subject`), correlate (columns), predict (response on columns), distribute (value), equivalence (value by group, margin)."""
    if goal == "compare":
        return _compare(df, value, group, subject, alpha, mu or 0.0)
    path: list[str] = [f"goal={goal}"]
    if goal == "correlate":
        need(bool(columns) and len(columns) >= 2, "at least 2 columns are needed")
        normal = all(core.check_normality(df, c, alpha=alpha).first()["passed"] for c in columns)
        method = "pearson" if normal else "spearman"
        path.append(f"all normal={normal} -> {method}")
        r = parametric.correlation(df, columns, method, alpha).first().asDict()
        row = dict(test_name=f"{method.title()} correlation", statistic=r["r"], p_value=r["p_value"], effect_size=r["r"], effect_type="r", effect_label=classify_effect(r["r"], "r"), confidence="high" if r["n"] >= 30 else "moderate", interpretation=f"Strongest pair {r['var1']} and {r['var2']}: r = {r['r']:.3f}.", recommendations=["Model the relation by regression"] if r["p_value"] < alpha else [])
    elif goal == "predict":
        target = response or columns[-1]
        features = [c for c in columns if c != target]
        r = regression.ols(df, target, features, alpha).first().asDict()
        row = dict(test_name="OLS regression", statistic=r["f_statistic"], p_value=r["f_p_value"], effect_size=r["r_squared"], effect_type="r_squared", effect_label=classify_effect(r["r_squared"], "r_squared"), confidence="high" if r["n"] >= 30 else "moderate", interpretation=f"The model explains {100 * r['r_squared']:.1f} % of the variance of {target}.", recommendations=["Look at the residual diagnostics"])
    elif goal == "distribute":
        best = core.fit_best(df, value).first().asDict()
        n = clean(df, [value]).count()
        row = dict(test_name="Distribution fit", statistic=best["ks_statistic"], p_value=best["ks_p_value"], confidence="high" if n >= 30 else "moderate", interpretation=f"The {best['name']} family fits best (AIC {best['aic']:.1f}).", recommendations=[])
    elif goal == "equivalence":
        need(margin is not None, "a margin is needed")
        r = parametric.tost(df, value, group, margin, alpha).first().asDict()
        n = clean(df, [value], [group]).count()
        row = dict(test_name="TOST equivalence", statistic=min(r["t_lower"], -r["t_upper"]), p_value=r["p_tost"], effect_size=r["effect_size"], effect_type="cohens_d", effect_label=classify_effect(r["effect_size"], "cohens_d"), confidence="high" if n >= 60 else "moderate", interpretation=f"The groups are {'' if r['equivalent'] else 'not shown to be '}equivalent within {margin} ({100 * r['ci_level']:.0f}% CI {r['ci_lower']:.4g} to {r['ci_upper']:.4g}).", recommendations=[])
    else:
        raise ValueError(f"unknown goal {goal}")
    return frame(df, row | dict(decision_path=path, significant=row["p_value"] < alpha, posthoc=[]), ANALYSIS)


def _compare(df: DataFrame, value: str, group: str | None, subject: str | None, alpha: float, mu: float) -> DataFrame:
    prof = [r.asDict() for r in profile_data(df, value, group, alpha).orderBy("group").collect()]  # one row per group
    k, sizes = len(prof), [r["n"] for r in prof]
    need(k >= 1, "no data")
    normal = all(r["normal"] for r in prof)
    path = [f"groups={k}", f"normal={normal}", f"min n={min(sizes)}"]
    posthoc: list[str] = []
    equal = True
    g = group or "_all"
    if k == 1:
        if not normal and 6 <= min(sizes) < 30:
            path.append("non-normal and small -> Wilcoxon")
            test = nonparametric.wilcoxon_signed_rank(df.withColumn("_v", F.col(value) - F.lit(mu)), "_v", alpha=alpha)
        else:
            path.append("one-sample t")
            test = parametric.one_sample(df, value, mu, alpha)
    elif subject is not None:
        if k >= 3:
            path.append("repeated -> Friedman")
            test = nonparametric.friedman(df, value, subject, group, alpha)
        else:
            a, b = prof[0]["group"], prof[1]["group"]
            wide = clean(df, [value], [subject, group]).groupBy(subject).pivot(group, [a, b]).agg(F.avg(value)).toDF("_s", "_a", "_b")
            passed = core.check_normality(wide.withColumn("_d", F.col("_a") - F.col("_b")), "_d", alpha=alpha).first()["passed"]
            if not passed and 6 <= min(sizes) < 30:
                path.append("paired, non-normal and small -> Wilcoxon")
                test = nonparametric.wilcoxon_signed_rank(wide, "_a", "_b", alpha)
            else:
                path.append("paired t")
                test = parametric.paired(wide, "_a", "_b", alpha)
    else:
        equal = bool(core.check_equal_variance(df, value, g, alpha).first()["passed"])
        path.append(f"equal variance={equal}")
        large = normal or min(sizes) >= 30
        if k == 2:
            path.append(("Student t" if equal else "Welch t") if large else "Mann-Whitney")
            test = parametric.two_sample(df, value, g, equal, alpha) if large else nonparametric.mann_whitney(df, value, g, alpha)
        else:
            path.append("ANOVA" if large else "Kruskal-Wallis")
            test = parametric.one_way(df, value, g, alpha) if large else nonparametric.kruskal_wallis(df, value, g, alpha)
    r = test.first().asDict()
    if k >= 3 and subject is None and r["p_value"] < alpha:
        name, op = ("Tukey HSD", nonparametric.tukey_hsd) if r["test_name"] == "One-way ANOVA" and equal else ("Games-Howell", nonparametric.games_howell) if r["test_name"] == "One-way ANOVA" else ("Dunn", nonparametric.dunn)
        path.append(f"post-hoc {name}")
        posthoc = [f"{x['group1']} vs {x['group2']}: p {x['p_value']:.4g}" for x in op(df, value, g, alpha).collect()]
    got = observed_power(r, sizes, k, alpha)
    violations = (0 if normal else 1) + (0 if equal else 1) + (1 if any(x["n_outliers"] / x["n"] >= 0.1 for x in prof) else 0)
    advice = (["Look at the pairwise comparisons"] if posthoc else []) + (["Collect more data: power is below 80 %"] if got is not None and got < 0.8 else []) + ([] if normal else ["Check the result with a rank test"])
    return frame(df, dict(test_name=r["test_name"], statistic=r["statistic"], p_value=r["p_value"], effect_size=r.get("effect_size"), effect_type=r.get("effect_size_type"), effect_label=r.get("effect_label"), power=got, confidence=rate_confidence(sizes, got, violations), significant=r["p_value"] < alpha, interpretation=_sentence(r["test_name"], r, alpha), recommendations=advice, decision_path=path, posthoc=posthoc), ANALYSIS)


def observed_power(r: dict, sizes: Sequence[int], k: int, alpha: float) -> float | None:
    d = r.get("effect_size")
    if d is None or d != d:
        return None
    if r.get("effect_size_type") == "eta_squared":
        return power.anova_power(math.sqrt(d / (1 - d)), k, max(2, round(sum(sizes) / k)), alpha) if 0 < d < 1 else None
    if r.get("effect_size_type") == "cohens_d":
        return power.t_power(abs(d), max(2, min(sizes)), alpha, test_type="two_sample" if k == 2 and r.get("method") in ("Welch", "Student") else "one_sample")
    return None


def estimate_power(effect: float | None, n: int | None) -> float | None:
    """Rough power of a two-sided 5 % test: abs(effect) sqrt(n) against 1.96, whatever kind of effect it is."""
    from quillon.functions.special import norm_cdf

    return None if effect is None or n is None else norm_cdf(abs(effect) * math.sqrt(n) - 1.96)


def _size(result: dict) -> int | None:
    if result.get("n") is not None:
        return int(result["n"])
    parts = [int(result[c]) for c in ("n1", "n2") if result.get(c) is not None]
    return sum(parts) if parts else None


def result_family(result: dict) -> str:
    """What a result row is about, told by the columns it has and then by the name of its test."""
    has = lambda *names: all(result.get(c) is not None for c in names)
    name = (result.get("test_name") or "").lower()
    for family, fits in (
        ("evidence", has("bf10")),
        ("equivalence", has("p_tost")),
        ("correlation", has("r", "var1", "var2")),
        ("model", has("r_squared", "f_statistic")),
        ("association", any(w in name for w in ("chi-square", "fisher"))),
        ("groups", "anova" in name),
        ("ranks", any(w in name for w in ("mann", "wilcoxon", "kruskal", "friedman", "mood", "sign"))),
        ("means", has("mean1")),
    ):
        if fits:
            return family
    return "test"


def _p(result: dict) -> float | None:
    return next((result[c] for c in ("p_value", "p_tost", "f_p_value") if result.get(c) is not None), None)


#: family -> (said of a significant result, said of another, what the result is conditional on)
CLAIMS = {
    "means": ("the means differ", "no difference of means is shown", "values near normal or groups of 30 and more"),
    "groups": ("at least one group mean differs from the rest", "no difference among the group means is shown", "normal residuals of equal variance in all groups"),
    "ranks": ("the distributions differ in location", "no shift between the distributions is shown", "independent rows and distributions of like shape"),
    "association": ("the variables are associated", "no association is shown", "independent rows and expected counts of 5 and more, but for the exact test"),
    "correlation": ("the two variables move together", "no correlation is shown", "pairs drawn independently; a linear relation for Pearson, a monotone one for ranks"),
    "equivalence": ("the groups are equivalent within the margin", "equivalence within the margin is not shown", "a margin fixed before the data were seen"),
    "model": ("the model explains part of the variance", "the model explains no more than chance would", "independent residuals of equal variance"),
    "test": ("significant at the level asked for", "not significant at the level asked for", "the conditions of the test"),
}


def _figures(result: dict, family: str) -> list[str]:
    """The numbers that a reader of this family looks for, in sentences."""
    g, said = result.get, []
    if family == "means":
        said.append(f"Means {g('mean1'):.4g} and {g('mean2'):.4g}." if g("mean2") is not None else f"Mean {g('mean1'):.4g}.")
    if family == "correlation":
        r = result["r"]
        said.append(f"{g('var1')} and {g('var2')} {'rise together' if r > 0 else 'move in opposite directions'}: r = {r:.4g}, sharing {100 * r * r:.1f} % of variance.")
    if family == "model":
        said.append(f"{100 * result['r_squared']:.1f} % of variance explained" + (f", {100 * g('adj_r_squared'):.1f} % adjusted." if g("adj_r_squared") is not None else "."))
    if family == "evidence":
        bf = result["bf10"]
        said.append(f"The data are {bf:.4g} times as likely under a difference as without one." if bf >= 1 else f"The data are {1 / bf if bf > 0 else math.inf:.4g} times as likely without a difference as under one.")
    stat = g("statistic") if g("statistic") is not None else g("f_statistic")
    tail = [f"{label} {v:.4g}" for label, v in (("statistic", stat), ("df", g("df")), ("p", _p(result)), ("difference", g("mean_diff"))) if isinstance(v, (int, float))]
    if tail:
        said.append(", ".join(tail).capitalize() + ".")
    if g("ci_lower") is not None and g("ci_upper") is not None:
        said.append(f"Interval {g('ci_lower'):.4g} to {g('ci_upper'):.4g}.")
    return said


def _magnitude(result: dict, family: str) -> tuple[float | None, str | None]:
    """The effect and its label; a correlation and a model are their own effect sizes."""
    own = {"correlation": ("r", "r"), "model": ("r_squared", "r_squared")}.get(family)
    value, kind = (result[own[0]], own[1]) if own else (result.get("effect_size"), result.get("effect_size_type") or "cohens_d")
    if value is None or value != value:
        return None, None
    return value, (None if own else result.get("effect_label")) or classify_effect(value, kind)


def explain(result: dict, context: str | None = None, checks: Sequence[dict] = (), alpha: float = 0.05) -> dict:
    """summary, detail, assumptions, effect, practical, caveats and confidence of a result row.

    `checks` are rows of the assumption checks (`test_name`, `passed`); a failed one is a caveat. What is said depends
    on the family of the result (`result_family`). Confidence: low below 10 rows or with three caveats, high without any.
    """
    family, p, n = result_family(result), _p(result), _size(result)
    yes, no, conditions = CLAIMS.get(family, CLAIMS["test"])
    significant = None if p is None else p < alpha
    if family == "evidence":
        verdict = f"{result.get('bf_label') or 'unlabelled'} evidence"
        conditions = "the prior on the effect"
    else:
        verdict = "no p-value is given" if significant is None else yes if significant else no
    effect, label = _magnitude(result, family)
    weak = label in ("negligible", "small")
    if significant is None or label is None or family == "equivalence":
        practical = ""
    elif significant:
        practical = "Real but slight: ask whether an effect of this size matters." if weak else "Large enough to matter as well as to be detected."
    else:
        practical = "Either there is nothing to find or little of it." if weak else "The effect looks sizeable, but these data cannot tell it from chance: collect more."
    caveats = [f"{c.get('test_name') or c.get('name')} is not met" for c in checks if not c["passed"]]
    if significant and weak and family != "equivalence":
        caveats.append("significant, though the effect is slight")
    if p is not None and 0.04 < p < 0.06:
        caveats.append(f"the p-value is borderline ({p:.4f})")
    if n is not None and n < 20:
        caveats.append(f"the sample is small (n = {n})")
    if family == "groups" and significant:
        caveats.append("the overall test does not say which groups differ")
    if family == "correlation" and significant:
        caveats.append("correlation does not show a cause")
    hard = [c for c in caveats if not c.startswith(("the overall", "correlation"))]
    return dict(
        summary=f"{result.get('test_name') or family.capitalize()}: {verdict}." + (f" {context}" if context else ""),
        detail=" ".join(_figures(result, family)),
        assumptions="; ".join(f"{c.get('test_name') or c.get('name')}: {'met' if c['passed'] else 'not met'}" for c in checks) or f"Rests on {conditions}.",
        effect="not given" if effect is None else f"{effect:.3g} ({label})",
        practical=practical,
        caveats=caveats,
        confidence="low" if len(hard) > 2 or (n is not None and n < 10) else "moderate" if hard else "high",
    )


def recommend_next(result: dict) -> list[dict]:
    """Next steps in order of urgency."""
    out, p = [], result.get("p_value")
    name = (result.get("test_name") or "").lower()
    if "anova" in name and p is not None and p < 0.05:
        out.append(dict(action="Compare the groups pairwise", reason="the overall test does not say which differ", function="nonparametric.tukey_hsd", priority="required"))
        out.append(dict(action="Control the false discovery rate", reason="several comparisons follow", function="intelligence.benjamini_hochberg", priority="optional"))
    got = estimate_power(result.get("effect_size"), _size(result))
    if got is not None and got < 0.8:
        out.append(dict(action="Plan the sample size for 80 % power", reason=f"power is about {got:.2f}", function="power.power_t_test", priority="suggested"))
    if "chi-square" in name and p is not None and p < 0.05:
        out.append(dict(action="Look at the standardised residuals", reason="they show which cells depart", function="parametric.chi_square_independence", priority="suggested"))
    if result.get("var1") is not None and p is not None and p < 0.05:
        out.append(dict(action="Fit a regression", reason=f"{result['var1']} and {result['var2']} move together", function="regression.ols", priority="optional"))
    return sorted(out, key=lambda r: ("required", "suggested", "optional").index(r["priority"]))


def validate_conclusion(result: dict, alpha: float = 0.05) -> dict:
    """Issues and strengths; none: high, one: moderate, up to three: low, more: unreliable."""
    issues, strengths, n = [], [], _size(result)
    if n is not None:
        (issues if n < 20 else strengths).append(f"{'very small sample' if n < 10 else 'small sample' if n < 20 else 'good sample size' if n >= 100 else 'adequate sample size'} (n={n})")
    got = estimate_power(result.get("effect_size"), n)
    if got is not None:
        (strengths if got >= 0.8 else issues).append(f"power about {got:.2f}")
    p = result.get("p_value") if result.get("p_value") is not None else result.get("p_tost")
    if p is not None:
        if 0.04 < p < 0.06:
            issues.append(f"borderline p-value ({p:.4f})")
        if result.get("effect_size") is not None:
            size = classify_effect(result["effect_size"], result.get("effect_size_type") or "cohens_d")
            if p < alpha and size == "negligible":
                issues.append("significant, but the effect is negligible")
            elif p >= alpha and size in ("medium", "large"):
                issues.append(f"not significant, but the effect is {size}")
    level = "high" if not issues else "moderate" if len(issues) == 1 else "low" if len(issues) <= 3 else "unreliable"
    return dict(is_trustworthy=len(issues) <= 1, confidence_level=level, issues=issues, strengths=strengths, overall=f"{len(issues)} concerns, {len(strengths)} strengths")


def compare_methods(df: DataFrame, value: str, group: str, alpha: float = 0.05, paired_with: str | None = None) -> DataFrame:
    """The parametric and the rank test side by side, and whether they agree; with `paired_with` the two columns of a pair, without groups."""
    if paired_with is not None:
        return _side_by_side(parametric.paired(df, value, paired_with, alpha=alpha), nonparametric.wilcoxon_signed_rank(df, value, paired_with, alpha))
    k = df.select(group).distinct().count()
    para = parametric.two_sample(df, value, group, alpha=alpha) if k == 2 else parametric.one_way(df, value, group, alpha)
    rank = nonparametric.mann_whitney(df, value, group, alpha) if k == 2 else nonparametric.kruskal_wallis(df, value, group, alpha)
    return _side_by_side(para, rank)


def _side_by_side(para: DataFrame, rank: DataFrame) -> DataFrame:
    cols = ["test_name", "statistic", "p_value", "effect_size", "effect_label", "significant"]
    both = para.select(F.lit("parametric").alias("kind"), *cols).union(rank.select(F.lit("rank").alias("kind"), *cols))
    agree = both.agg((F.countDistinct("significant") == 1).alias("agreement"))
    return both.crossJoin(F.broadcast(agree))
