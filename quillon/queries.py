"""Registered queries of the statistics operators over the driver's tables, with DuckDB oracles where SQL can say the same.

Doubles are rounded on both sides (engines differ in the last digits). Oracle p-values integrate the density by
Simpson's rule over generate_series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import bayesian, core, exploratory, intelligence, monitoring, msa, nonparametric, parametric, power, quality, regression, reliability, sequential, timeseries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles (and arrays of them) rounded; -0.0 made 0.0."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind == "double":
            c = (F.round(c, digits) + F.lit(0.0)).alias(f.name)
        elif kind == "array<double>":
            c = F.transform(c, lambda x: F.round(x, digits) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, oracle: str | None = None, digits: int = 6):
    def add(fn):
        QUERIES[name] = lambda spark, d: rounded(fn(spark, d), digits)
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def R(expr: str, digits: int = 6) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def simpson(source: str, keys: str, upper: str, density: str, out: str) -> str:
    """A CTE body: keys and `area`, the integral of density (in x) from 0 to upper."""
    return f"""SELECT {keys}, sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density})) * max({upper}) / 4000.0 / 3 AS {out}
FROM (SELECT *, ({upper}) * i / 4000.0 AS x FROM {source}, generate_series(0, 4000) g(i)) GROUP BY {keys}"""


T_DENS = "exp(lgamma((df+1)/2.0)-lgamma(df/2.0))/sqrt(df*pi())*pow(1+x*x/df,-(df+1)/2.0)"
F_DENS = "exp(lgamma((d1+d2)/2.0)-lgamma(d1/2.0)-lgamma(d2/2.0))*pow(d1/d2,d1/2.0)*(CASE WHEN x=0 THEN (CASE WHEN d1=2 THEN 1 ELSE 0 END) ELSE pow(x,d1/2.0-1) END)*pow(1+d1*x/d2,-(d1+d2)/2.0)"
C_DENS = "(CASE WHEN x=0 THEN (CASE WHEN df=2 THEN 1 ELSE 0 END) ELSE pow(x,df/2.0-1) END)*exp(-x/2)/(pow(2,df/2.0)*exp(lgamma(df/2.0)))"
N_DENS = "exp(-x*x/2)/sqrt(2*pi())"


def t_test_sql(source: str, cols: str, keys: str = "t, df, diff, se") -> str:
    """source gives t, df, diff, se; returns statistic, p_value, df, mean_diff, se."""
    return f"WITH s AS ({source}), a AS ({simpson('s', keys, 'abs(t)', T_DENS, 'area')}) SELECT {cols} FROM a"


T_COLS = f"{R('t')} AS statistic, {R('1 - 2*area')} AS p_value, {R('df')} AS df, {R('diff')} AS mean_diff, {R('se')} AS se"
T_OUT = ["statistic", "p_value", "df", "mean_diff", "se"]


# --- description and moments -------------------------------------------------------------------------------

@query("describe_by_type", f"""
WITH m AS (SELECT event_type, count(*) n, avg(value) mean, stddev_samp(value) std, var_samp(value) v, quantile_cont(value, 0.5) med,
  quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, min(value) mi, max(value) ma, kurtosis_pop(value) ku, stddev_pop(value) sp FROM events GROUP BY 1),
k AS (SELECT e.event_type, avg(pow((e.value - mean) / sp, 3)) sk, sum(CASE WHEN e.value < q1 - 1.5*(q3-q1) OR e.value > q3 + 1.5*(q3-q1) THEN 1 ELSE 0 END) o FROM events e JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, CAST(n AS BIGINT) n, {R('mean')} AS mean, {R('std')} AS std, {R('v', 5)} AS variance, {R('med')} AS median, {R('q1')} AS q1, {R('q3')} AS q3,
  {R('mi')} AS min, {R('ma')} AS max, {R('sk')} AS skewness, {R('ku')} AS kurtosis, CAST(o AS BIGINT) AS n_outliers FROM m JOIN k USING (event_type)""")
def _(spark, d):
    r = exploratory.describe(t(spark, d, "events"), "value", ["event_type"])
    return r.select("event_type", "n", "mean", "std", F.round("variance", 5).alias("variance"), "median", "q1", "q3", "min", "max", "skewness", "kurtosis", "n_outliers")


WELCH = "SELECT (m1-m2)/sqrt(a+b) t, pow(a+b,2)/(a*a/(n1-1)+b*b/(n2-1)) df, m1-m2 diff, sqrt(a+b) se FROM (SELECT max(CASE WHEN g='click' THEN m END) m1, max(CASE WHEN g='view' THEN m END) m2, max(CASE WHEN g='click' THEN v/n END) a, max(CASE WHEN g='view' THEN v/n END) b, max(CASE WHEN g='click' THEN n END) n1, max(CASE WHEN g='view' THEN n END) n2 FROM (SELECT event_type g, count(*) n, avg(value) m, var_samp(value) v FROM events WHERE event_type IN ('click','view') GROUP BY 1))"


@query("ttest_welch", t_test_sql(WELCH, T_COLS))
def _(spark, d):
    return parametric.two_sample(t(spark, d, "events"), "value", "event_type", labels=["click", "view"]).select(*T_OUT)


POOLED = "SELECT (m1-m2)/sp/sqrt(1.0/n1+1.0/n2) t, CAST(n1+n2-2 AS DOUBLE) df, m1-m2 diff, sp*sqrt(1.0/n1+1.0/n2) se FROM (SELECT *, sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)) sp FROM (SELECT avg(value) FILTER (event_type='click') m1, avg(value) FILTER (event_type='view') m2, var_samp(value) FILTER (event_type='click') v1, var_samp(value) FILTER (event_type='view') v2, count(*) FILTER (event_type='click') n1, count(*) FILTER (event_type='view') n2 FROM events))"


@query("ttest_pooled", t_test_sql(POOLED, T_COLS))
def _(spark, d):
    return parametric.two_sample(t(spark, d, "events"), "value", "event_type", equal_var=True, labels=["click", "view"]).select(*T_OUT)


@query("ttest_one", t_test_sql("SELECT (avg(l_quantity)-25)/(stddev_samp(l_quantity)/sqrt(count(*))) t, CAST(count(*)-1 AS DOUBLE) df, avg(l_quantity)-25 diff, stddev_samp(l_quantity)/sqrt(count(*)) se FROM lineitem", T_COLS))
def _(spark, d):
    return parametric.one_sample(t(spark, d, "lineitem"), "l_quantity", 25.0).select(*T_OUT)


USERS = "SELECT user_id, avg(value) FILTER (event_type='click') a, avg(value) FILTER (event_type='view') b, avg(value) FILTER (event_type='purchase') c FROM events GROUP BY 1"


def users(spark, d):
    return t(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.avg("value")).toDF("user_id", "a", "b", "c")


@query("ttest_paired", t_test_sql(f"SELECT avg(a-b)/(stddev_samp(a-b)/sqrt(count(*))) t, CAST(count(*)-1 AS DOUBLE) df, avg(a-b) diff, stddev_samp(a-b)/sqrt(count(*)) se FROM ({USERS}) WHERE a IS NOT NULL AND b IS NOT NULL", T_COLS))
def _(spark, d):
    return parametric.paired(users(spark, d), "a", "b").select(*T_OUT)


@query("ttest_by_nation", f"SELECT c_nationkey, {R('(avg(c_acctbal)-4500)/(stddev_samp(c_acctbal)/sqrt(count(*)))')} AS statistic, {R('avg(c_acctbal)', 4)} AS mean1, CAST(count(*) AS BIGINT) AS n1 FROM customer GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    c = t(spark, d, "customer")
    big = c.groupBy("c_nationkey").count().filter("count > 1").select("c_nationkey")
    return parametric.one_sample(c.join(F.broadcast(big), "c_nationkey"), "c_acctbal", 4500.0, by=["c_nationkey"]).select("c_nationkey", "statistic", F.round("mean1", 4).alias("mean1"), "n1")


@query("tost_equiv", f"WITH s AS ({WELCH}), u AS (SELECT (diff+5)/se t, df, diff, se, 1 k FROM s UNION ALL SELECT (diff-5)/se, df, diff, se, 2 FROM s), a AS ({simpson('u', 't, df, diff, se, k', 'abs(t)', T_DENS, 'area')}), p AS (SELECT *, CASE WHEN (k=1) = (t > 0) THEN 0.5-area ELSE 0.5+area END p FROM a) SELECT {R('max(diff)')} AS mean_diff, {R('max(t) FILTER (k=1)')} AS t_lower, {R('max(t) FILTER (k=2)')} AS t_upper, {R('max(p)')} AS p_tost, max(p) < 0.05 AS equivalent FROM p")
def _(spark, d):
    return parametric.tost(t(spark, d, "events"), "value", "event_type", 5.0, labels=["click", "view"]).select("mean_diff", "t_lower", "t_upper", "p_tost", "equivalent")


@query("f_test", f"SELECT {R("var_samp(value) FILTER (event_type='click') / var_samp(value) FILTER (event_type='view')")} AS statistic FROM events")
def _(spark, d):
    return parametric.f_test(t(spark, d, "events"), "value", "event_type", labels=["click", "view"]).select("statistic")


ANOVA_S = "WITH g AS (SELECT {g} g, count(*) n, avg({v}) m, var_samp({v}) v FROM {f} GROUP BY 1), w AS (SELECT sum(n) N, count(*) k, sum(n*m)/sum(n) gm, sum((n-1)*v) ssw FROM g), s AS (SELECT k-1.0 d1, N-k+0.0 d2, ssw, (SELECT sum(n*pow(m-(SELECT gm FROM w),2)) FROM g) ssb FROM w), f AS (SELECT *, (ssb/d1)/(ssw/d2) f FROM s)"


def anova_sql(g: str, v: str, f: str) -> str:
    return ANOVA_S.format(g=g, v=v, f=f) + f", a AS ({simpson('f', 'd1, d2, ssw, ssb, f', 'f', F_DENS, 'area')})"


ORACLES["anova_one"] = anova_sql("event_type", "value", "events") + f" SELECT {R('f')} AS statistic, {R('1-area')} AS p_value, {R('ssb', 3)} AS ss_between, {R('ssw', 2)} AS ss_within, {R('ssb/(ssb+ssw)', 8)} AS eta_squared FROM a"
QUERIES["anova_one"] = lambda spark, d: parametric.one_way(t(spark, d, "events"), "value", "event_type").select(F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"), F.round("ss_between", 3).alias("ss_between"), F.round("ss_within", 2).alias("ss_within"), F.round("effect_size", 8).alias("eta_squared"))


@query("levene", "WITH md AS (SELECT event_type, median(value) md FROM events GROUP BY 1), z AS (SELECT e.event_type, abs(value-md) z FROM events e JOIN md USING (event_type)), " + anova_sql("event_type", "z", "z")[5:] + f" SELECT {R('f')} AS statistic, {R('1-area')} AS p_value FROM a")
def _(spark, d):
    return parametric.variance_test(t(spark, d, "events"), "value", "event_type").select("statistic", "p_value")


@query("bartlett", f"WITH g AS (SELECT event_type, count(*) n, var_samp(value) v FROM events GROUP BY 1), w AS (SELECT sum(n) N, count(*) k, sum((n-1)*v)/(sum(n)-count(*)) p, sum((n-1)*ln(v)) l, sum(1.0/(n-1)) r FROM g) SELECT {R('((N-k)*ln(p)-l)/(1+(r-1.0/(N-k))/(3*(k-1)))')} AS statistic FROM w")
def _(spark, d):
    return parametric.variance_test(t(spark, d, "events"), "value", "event_type", method="bartlett").select("statistic")


TWO_WAY = "WITH b AS (SELECT {a} a, {b} b, {v} v FROM {f}), m AS (SELECT avg(v) gm, count(*) n, var_pop(v)*count(*) sst FROM b), ma AS (SELECT a, count(*) n, avg(v) m FROM b GROUP BY 1), mb AS (SELECT b, count(*) n, avg(v) m FROM b GROUP BY 1), mc AS (SELECT a, b, count(*) n, avg(v) m FROM b GROUP BY 1,2), s AS (SELECT (SELECT sum(n*pow(m-gm,2)) FROM ma) ssa, (SELECT sum(n*pow(m-gm,2)) FROM mb) ssb, (SELECT sum(mc.n*pow(mc.m-ma.m-mb.m+gm,2)) FROM mc JOIN ma USING (a) JOIN mb USING (b)) ssi, sst, n, (SELECT count(*) FROM ma) ka, (SELECT count(*) FROM mb) kb, gm FROM m)"


@query("anova_two", TWO_WAY.format(a="l_returnflag", b="l_linestatus", v="l_quantity", f="lineitem") + f" SELECT source, {R('ss', 4)} AS ss, {R('d')} AS df FROM (SELECT 'l_returnflag' source, ssa ss, ka-1 d FROM s UNION ALL SELECT 'l_linestatus', ssb, kb-1 FROM s UNION ALL SELECT 'l_returnflag:l_linestatus', ssi, (ka-1)*(kb-1) FROM s UNION ALL SELECT 'Residual', sst-ssa-ssb-ssi, n-ka*kb FROM s)")
def _(spark, d):
    return parametric.two_way(t(spark, d, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus").select("source", F.round("ss", 4).alias("ss"), "df")


@query("split_plot")
def _(spark, d):
    return parametric.split_plot_anova(t(spark, d, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus")


@query("rm_anova")
def _(spark, d):
    return parametric.repeated_measures_anova(t(spark, d, "events"), "value", "user_id", "event_type")


@query("mixed_model")
def _(spark, d):
    return parametric.mixed_model(t(spark, d, "lineitem"), "l_quantity", ["l_discount"], ["l_returnflag", "l_linestatus"])


@query("nested_anova")
def _(spark, d):
    return parametric.nested_anova(t(spark, d, "part"), "p_retailprice", ["p_brand", "p_type"])


@query("variance_decomposition")
def _(spark, d):
    return parametric.variance_decomposition(t(spark, d, "part"), "p_retailprice", ["p_brand", "p_type"])


# --- counts ------------------------------------------------------------------------------------------------

@query("chi2_indep", f"WITH o AS (SELECT o_orderstatus r, o_orderpriority c, count(*)+0.0 o FROM orders GROUP BY 1,2), e AS (SELECT o.*, (SELECT sum(o) FROM o x WHERE x.r=o.r)*(SELECT sum(o) FROM o y WHERE y.c=o.c)/(SELECT sum(o) FROM o) e FROM o), s AS (SELECT sum(pow(o-e,2)/e) chi, (count(DISTINCT r)-1)*(count(DISTINCT c)-1)+0.0 df, sum(o) n, least(count(DISTINCT r),count(DISTINCT c)) k FROM e), a AS ({simpson('s', 'chi, df, n, k', 'chi', C_DENS, 'area')}) SELECT {R('chi')} AS statistic, {R('df')} AS df, {R('1-area')} AS p_value, {R('sqrt(chi/(n*(k-1)))')} AS cramers_v FROM a")
def _(spark, d):
    return parametric.chi_square_independence(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select("statistic", "df", "p_value", "cramers_v")


@query("chi2_gof", f"WITH o AS (SELECT event_type, count(*)+0.0 o FROM events GROUP BY 1), s AS (SELECT sum(pow(o-(SELECT sum(o)/count(*) FROM o),2)/(SELECT sum(o)/count(*) FROM o)) chi, count(*)-1.0 df FROM o), a AS ({simpson('s', 'chi, df', 'chi', C_DENS, 'area')}) SELECT {R('chi')} AS statistic, {R('df')} AS df, {R('1-area')} AS p_value FROM a")
def _(spark, d):
    return parametric.chi_square_goodness_of_fit(t(spark, d, "events"), "event_type").select("statistic", "df", "p_value")


@query("fisher_2x2", f"WITH c AS (SELECT count(*) FILTER (quality=0 AND toxic=0) a, count(*) FILTER (quality=0 AND toxic=1) b, count(*) FILTER (quality=1 AND toxic=0) c, count(*) FILTER (quality=1 AND toxic=1) d FROM labels), p AS (SELECT a, k, exp(lgamma(a+b+1)-lgamma(k+1)-lgamma(a+b-k+1)+lgamma(c+d+1)-lgamma(a+c-k+1)-lgamma(c+d-a-c+k+1)-lgamma(a+b+c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)) p FROM c, generate_series(0, 100000) g(k) WHERE k <= a+b AND k <= a+c AND k >= a-d), o AS (SELECT p p0 FROM p WHERE k = a) SELECT {R('(SELECT sum(p) FROM p, o WHERE p <= p0*(1+1e-7))')} AS p_value, {R('a*d*1.0/(b*c)')} AS odds_ratio FROM c")
def _(spark, d):
    return parametric.fisher_exact(t(spark, d, "labels"), "quality", "toxic").select("p_value", "odds_ratio")


@query("prop_one", f"WITH c AS (SELECT count(*) n, avg(CASE WHEN event_type='purchase' THEN 1.0 ELSE 0.0 END) p FROM events), s AS (SELECT (p-0.2)/sqrt(0.2*0.8/n) z, p, n FROM c), a AS ({simpson('s', 'z, p, n', 'abs(z)', N_DENS, 'area')}) SELECT {R('z')} AS statistic, {R('1-2*area')} AS p_value, {R('p')} AS p_hat, CAST(n AS BIGINT) AS n1 FROM a")
def _(spark, d):
    e = t(spark, d, "events").select((F.col("event_type") == "purchase").alias("s"))
    return parametric.one_proportion(e, "s", 0.2).select("statistic", "p_value", "p_hat", "n1")


@query("prop_two", f"WITH c AS (SELECT user_id % 2 g, count(*) n, avg(CASE WHEN event_type='purchase' THEN 1.0 ELSE 0.0 END) p FROM events GROUP BY 1), w AS (SELECT max(p) FILTER (g=0) p1, max(p) FILTER (g=1) p2, max(n) FILTER (g=0) n1, max(n) FILTER (g=1) n2 FROM c), s AS (SELECT p1, p2, (p1-p2)/sqrt(((n1*p1+n2*p2)/(n1+n2))*(1-(n1*p1+n2*p2)/(n1+n2))*(1.0/n1+1.0/n2)) z FROM w), a AS ({simpson('s', 'z, p1, p2', 'abs(z)', N_DENS, 'area')}) SELECT {R('z')} AS statistic, {R('1-2*area')} AS p_value, {R('p1')} AS p_hat, {R('p2')} AS p_hat2 FROM a")
def _(spark, d):
    e = t(spark, d, "events").select((F.col("user_id") % 2).alias("g"), (F.col("event_type") == "purchase").alias("s"))
    return parametric.two_proportions(e, "s", "g").select("statistic", "p_value", "p_hat", "p_hat2")


# --- correlation and ranks ---------------------------------------------------------------------------------

LI = ["l_quantity", "l_extendedprice", "l_discount"]


@query("corr_pearson", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' var1, '{b}' var2, {R(f'corr({a},{b})')} AS r, CAST(count(*) AS BIGINT) AS n FROM lineitem" for i, a in enumerate(LI) for b in LI[i + 1 :]) + ")")
def _(spark, d):
    return parametric.correlation(t(spark, d, "lineitem"), LI).select("var1", "var2", "r", "n")


MID = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query("corr_spearman", f"WITH r AS (SELECT {MID.format(c='l_quantity')} a, {MID.format(c='l_extendedprice')} b FROM lineitem) SELECT 'l_quantity' var1, 'l_extendedprice' var2, {R('corr(a,b)')} AS r, CAST(count(*) AS BIGINT) AS n FROM r")
def _(spark, d):
    return parametric.correlation(t(spark, d, "lineitem"), LI[:2], "spearman").select("var1", "var2", "r", "n")


@query("corr_kendall")
def _(spark, d):
    return parametric.correlation(users(spark, d), ["a", "b"], "kendall")


RANKS = "WITH r AS (SELECT event_type g, " + MID.format(c="value") + " r, count(*) OVER (PARTITION BY value) t FROM events {w})"


@query("mann_whitney", RANKS.format(w="WHERE event_type IN ('click','view')") + f", w AS (SELECT count(*)+0.0 n, count(*) FILTER (g='click')+0.0 n1, count(*) FILTER (g='view')+0.0 n2, sum(r) FILTER (g='click') rs, sum(t*t-1.0) ties FROM r), u AS (SELECT *, rs-n1*(n1+1)/2 u FROM w), s AS (SELECT u, n1, n2, (abs(u-n1*n2/2)-0.5)/sqrt(n1*n2/12*((n+1)-ties/(n*(n-1)))) z FROM u), a AS ({simpson('s', 'u, n1, n2, z', 'z', N_DENS, 'area')}) SELECT {R('u', 2)} AS statistic, {R('1-2*area')} AS p_value, {R('1-2*u/(n1*n2)')} AS effect_size FROM a")
def _(spark, d):
    return nonparametric.mann_whitney(t(spark, d, "events"), "value", "event_type", labels=["click", "view"]).select("statistic", "p_value", "effect_size")


@query("hodges_lehmann")
def _(spark, d):
    v = nonparametric.hodges_lehmann(t(spark, d, "events"), "value", "event_type", ("click", "view"))
    return spark.createDataFrame([(v,)], "shift double")


@query("kruskal", RANKS.format(w="") + f", g AS (SELECT g, count(*)+0.0 n, sum(r) rs FROM r GROUP BY 1), w AS (SELECT sum(n) n, count(*)-1.0 df, sum(rs*rs/n) q, (SELECT sum(t*t-1.0) FROM r) ties FROM g), s AS (SELECT (12/(n*(n+1))*q-3*(n+1))/(1-ties/(n*n*n-n)) h, df FROM w), a AS ({simpson('s', 'h, df', 'h', C_DENS, 'area')}) SELECT {R('h', 5)} AS statistic, {R('df')} AS df, {R('1-area', 5)} AS p_value FROM a", 5)
def _(spark, d):
    return nonparametric.kruskal_wallis(t(spark, d, "events"), "value", "event_type").select("statistic", "df", "p_value")


@query("friedman", f"WITH y AS (SELECT user_id, event_type, avg(value) y FROM events GROUP BY 1,2), r AS (SELECT event_type, rank() OVER (PARTITION BY user_id ORDER BY y) + (count(*) OVER (PARTITION BY user_id, y)-1)/2.0 r FROM y), g AS (SELECT event_type, count(*)+0.0 n, sum(r) rs FROM r GROUP BY 1), w AS (SELECT max(n) n, count(*)+0.0 k, sum(rs*rs) q FROM g) SELECT {R('12/(n*k*(k+1))*q-3*n*(k+1)')} AS statistic, CAST(n AS BIGINT) AS n_subjects FROM w")
def _(spark, d):
    return nonparametric.friedman(t(spark, d, "events"), "value", "user_id", "event_type").select("statistic", "n_subjects")


@query("wilcoxon", f"WITH d AS (SELECT a-b d FROM ({USERS}) WHERE a-b <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d))-1)/2.0 r FROM d) SELECT {R('least(sum(r) FILTER (d>0), sum(r) FILTER (d<0))')} AS statistic, CAST(count(*) AS BIGINT) AS n1 FROM r")
def _(spark, d):
    return nonparametric.wilcoxon_signed_rank(users(spark, d), "a", "b").select("statistic", "n1")


@query("mood_median", f"WITH m AS (SELECT median(value) m FROM events), o AS (SELECT event_type, sum(CASE WHEN value > m THEN 1.0 ELSE 0.0 END) a, count(*)+0.0 n FROM events, m GROUP BY 1), w AS (SELECT sum(a)/sum(n) p FROM o) SELECT {R('sum(pow(a-n*p,2)/(n*p)+pow((n-a)-n*(1-p),2)/(n*(1-p)))')} AS statistic, {R('(SELECT m FROM m)')} AS grand_median FROM o, w")
def _(spark, d):
    return nonparametric.mood_median(t(spark, d, "events"), "value", "event_type").select("statistic", "grand_median")


@query("sign_test", "SELECT CAST(count(*) FILTER (value > 35) AS BIGINT) AS n_above, CAST(count(*) FILTER (value < 35) AS BIGINT) AS n_below FROM events")
def _(spark, d):
    return nonparametric.sign_test(t(spark, d, "events"), "value", 35.0).select("n_above", "n_below")


@query("runs_test", "WITH s AS (SELECT ts, event_id, value > (SELECT median(value) FROM events) s FROM events), l AS (SELECT s, lag(s) OVER (ORDER BY ts, event_id) p FROM s) SELECT CAST(1 + count(*) FILTER (s <> p) AS BIGINT) AS n_runs, CAST(count(*) FILTER (s) AS BIGINT) AS n1, CAST(count(*) FILTER (NOT s) AS BIGINT) AS n2 FROM l")
def _(spark, d):
    return nonparametric.runs_test(t(spark, d, "events"), "value", ["ts", "event_id"]).select("n_runs", "n1", "n2")


# --- post-hoc ----------------------------------------------------------------------------------------------

PAIRS = "WITH g AS (SELECT event_type g, count(*)+0.0 n, avg(value) m, var_samp(value) v FROM events GROUP BY 1), w AS (SELECT sum((n-1)*v)/(sum(n)-count(*)) mse, sum(n)-count(*)+0.0 dfw, count(*)+0.0 k FROM g), p AS (SELECT a.g group1, b.g group2, a.m-b.m diff, a.n n1, b.n n2, a.v v1, b.v v2 FROM g a JOIN g b ON a.g < b.g)"


@query("tukey", PAIRS + f" SELECT group1, group2, {R('diff')} AS mean_diff, {R('sqrt(mse/2*(1/n1+1/n2))')} AS se, {R('abs(diff)/sqrt(mse/2*(1/n1+1/n2))')} AS t_or_q FROM p, w")
def _(spark, d):
    return nonparametric.tukey_hsd(t(spark, d, "events"), "value", "event_type").select("group1", "group2", "mean_diff", "se", "t_or_q")


@query("games_howell", PAIRS + f" SELECT group1, group2, {R('diff')} AS mean_diff, {R('abs(diff)/sqrt(v1/n1+v2/n2)')} AS t_or_q FROM p")
def _(spark, d):
    return nonparametric.games_howell(t(spark, d, "events"), "value", "event_type").select("group1", "group2", "mean_diff", "t_or_q")


@query("scheffe", PAIRS + f", s AS (SELECT group1, group2, pow(diff,2)/(mse*(1/n1+1/n2))/(k-1) f, k-1 d1, dfw d2 FROM p, w), a AS ({simpson('s', 'group1, group2, f, d1, d2', 'f', F_DENS, 'area')}) SELECT group1, group2, {R('f')} AS t_or_q, {R('1-area')} AS p_value FROM a")
def _(spark, d):
    return nonparametric.scheffe(t(spark, d, "events"), "value", "event_type").select("group1", "group2", "t_or_q", "p_value")


@query("bonferroni", PAIRS + f", s AS (SELECT group1, group2, diff/sqrt(v1/n1+v2/n2) t, pow(v1/n1+v2/n2,2)/(pow(v1/n1,2)/(n1-1)+pow(v2/n2,2)/(n2-1)) df, k FROM p, w), a AS ({simpson('s', 'group1, group2, t, df, k', 'abs(t)', T_DENS, 'area')}) SELECT group1, group2, {R('t')} AS t_or_q, {R('least(1.0, (1-2*area)*k*(k-1)/2)', 5)} AS p_value FROM a")
def _(spark, d):
    return nonparametric.bonferroni(t(spark, d, "events"), "value", "event_type").select("group1", "group2", "t_or_q", F.round("p_value", 5).alias("p_value"))


@query("dunn")
def _(spark, d):
    return nonparametric.dunn(t(spark, d, "events"), "value", "event_type")


@query("dunnett")
def _(spark, d):
    return nonparametric.dunnett(t(spark, d, "events"), "value", "event_type", "click")


# --- regression --------------------------------------------------------------------------------------------

@query("ols_simple", f"SELECT term, {R('b', 4)} AS estimate, {R('r2')} AS r_squared FROM (SELECT '(Intercept)' term, regr_intercept(l_extendedprice, l_quantity) b, regr_r2(l_extendedprice, l_quantity) r2 FROM lineitem UNION ALL SELECT 'l_quantity', regr_slope(l_extendedprice, l_quantity), regr_r2(l_extendedprice, l_quantity) FROM lineitem)")
def _(spark, d):
    return regression.ols(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", F.round("estimate", 4).alias("estimate"), "r_squared")


COV2 = "WITH c AS (SELECT covar_pop(l_quantity,l_quantity) s11, covar_pop(l_quantity,l_discount) s12, covar_pop(l_discount,l_discount) s22, covar_pop(l_quantity,l_extendedprice) s1y, covar_pop(l_discount,l_extendedprice) s2y, avg(l_quantity) m1, avg(l_discount) m2, avg(l_extendedprice) my, count(*)+0.0 n FROM lineitem)"


@query("ols_price", COV2 + f", b AS (SELECT *, (s22*s1y-s12*s2y)/(s11*s22-s12*s12) b1, (s11*s2y-s12*s1y)/(s11*s22-s12*s12) b2 FROM c) SELECT term, {R('b', 3)} AS estimate FROM (SELECT '(Intercept)' term, my-b1*m1-b2*m2 b FROM b UNION ALL SELECT 'l_quantity', b1 FROM b UNION ALL SELECT 'l_discount', b2 FROM b)")
def _(spark, d):
    return regression.ols(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).select("term", F.round("estimate", 3).alias("estimate"))


@query("ridge_price", COV2 + f", z AS (SELECT n, s12/sqrt(s11*s22)*n r, s1y/sqrt(s11)*n g1, s2y/sqrt(s22)*n g2, s11, s22 FROM c), b AS (SELECT ((n+1)*g1-r*g2)/((n+1)*(n+1)-r*r) b1, ((n+1)*g2-r*g1)/((n+1)*(n+1)-r*r) b2, s11, s22 FROM z) SELECT term, {R('b', 3)} AS coefficient FROM (SELECT 'l_quantity' term, b1/sqrt(s11) b FROM b UNION ALL SELECT 'l_discount', b2/sqrt(s22) FROM b)")
def _(spark, d):
    return regression.ridge(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], 1.0).select("term", F.round("coefficient", 3).alias("coefficient"))


@query("deming", f"WITH s AS (SELECT regr_sxx(b,a) sxx, regr_syy(b,a) syy, regr_sxy(b,a) sxy, avg(a) ma, avg(b) mb FROM ({USERS}) WHERE a IS NOT NULL AND b IS NOT NULL), k AS (SELECT *, ((syy-sxx)+sqrt(pow(syy-sxx,2)+4*sxy*sxy))/(2*sxy) m FROM s) SELECT {R('m', 5)} AS slope, {R('mb-m*ma', 3)} AS intercept, {R('sxy/sxx')} AS slope_ols FROM k")
def _(spark, d):
    return regression.orthogonal_regression(users(spark, d), "a", "b").select(F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), "slope_ols")


@query("ols_diagnostics")
def _(spark, d):
    r = regression.ols_diagnostics(t(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"])
    return regression.durbin_watson(r).crossJoin(r.agg(F.max("leverage").alias("max_leverage"), F.max("cooks_distance").alias("max_cook"), F.sum("leverage").alias("sum_leverage")))


def _reg(name, fn, digits=6):
    QUERIES[name] = lambda spark, d: rounded(fn(spark, d), digits)


_reg("poly_price", lambda s, d: regression.polynomial(t(s, d, "lineitem"), "l_quantity", "l_extendedprice", 2), 4)
_reg("best_subsets", lambda s, d: regression.best_subsets(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 4)
_reg("stepwise", lambda s, d: regression.stepwise(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))
_reg("lasso_price", lambda s, d: regression.lasso(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 10.0), 3)
_reg("elastic_net", lambda s, d: regression.elastic_net(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 1.0), 3)
_reg("regularization_path", lambda s, d: regression.regularization_path(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], n_alphas=20), 3)
_reg("robust", lambda s, d: regression.robust_regression(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity"]), 3)
_reg("logistic_quality", lambda s, d: regression.logistic_regression(t(s, d, "labels").join(t(s, d, "documents").select("doc_id", F.log(F.greatest("n_chars", F.lit(1))).alias("log_chars")), "doc_id"), "quality", ["log_chars"]), 5)
_reg("poisson_qty", lambda s, d: regression.poisson_regression(t(s, d, "lineitem"), "l_linenumber", ["l_quantity"]), 5)
_reg("glm_gamma", lambda s, d: regression.glm(t(s, d, "events").filter("value > 0"), "value", ["user_id"], "gamma"), 5)
_reg("ordinal", lambda s, d: regression.ordinal_logistic(t(s, d, "orders").withColumn("k", F.substring("o_orderpriority", 1, 1).cast("int")), "k", ["o_totalprice"]), 5)
_reg("curve_power", lambda s, d: regression.curve_fit(t(s, d, "lineitem"), "l_quantity", "l_extendedprice", "power"), 3)

# --- Bayesian ----------------------------------------------------------------------------------------------

_reg("bayes_ttest_one", lambda s, d: bayesian.bayesian_ttest_one_sample(t(s, d, "customer"), "c_acctbal", 4500.0))
_reg("bayes_ttest_two", lambda s, d: bayesian.bayesian_ttest_two_sample(t(s, d, "events"), "value", "event_type", labels=["click", "view"]))
_reg("bayes_corr", lambda s, d: bayesian.bayesian_correlation(users(s, d), "a", "b"))
_reg("bayes_anova", lambda s, d: bayesian.bayesian_anova(t(s, d, "events"), "value", "event_type"), 8)
_reg("bayes_reg", lambda s, d: bayesian.bayesian_regression(t(s, d, "events"), "value", ["user_id"]), 8)
_reg("bayes_ab", lambda s, d: bayesian.bayesian_ab(t(s, d, "events"), "value", "event_type", labels=["click", "view"]))


@query("bayes_proportion", f"WITH c AS (SELECT count(*) FILTER (event_type='purchase')+1.0 a, count(*) FILTER (event_type<>'purchase')+1.0 b FROM events) SELECT {R('a/(a+b)')} AS posterior_mean, {R('sqrt(a*b/(pow(a+b,2)*(a+b+1)))')} AS posterior_std FROM c")
def _(spark, d):
    e = t(spark, d, "events").select((F.col("event_type") == "purchase").alias("s"))
    return bayesian.bayesian_proportion(e, "s").select("posterior_mean", "posterior_std")


# --- exploratory, quality, measurement ---------------------------------------------------------------------

_reg("bootstrap_mean", lambda s, d: exploratory.bootstrap_ci(t(s, d, "customer"), "c_acctbal"), 3)
_reg("multi_vari", lambda s, d: exploratory.multi_vari(t(s, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]))
_reg("pca_lineitem", lambda s, d: exploratory.pca(t(s, d, "lineitem"), LI), 5)
_reg("hotelling", lambda s, d: exploratory.hotelling_t2_one_sample(t(s, d, "lineitem"), ["l_quantity", "l_discount"], [25.0, 0.05]), 5)
_reg("manova", lambda s, d: exploratory.one_way_manova(t(s, d, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag"))


@query("tolerance_pct", f"SELECT {R('quantile_cont(value, 0.025)')} AS lower, {R('quantile_cont(value, 0.975)')} AS upper FROM events")
def _(spark, d):
    return exploratory.tolerance_interval(t(spark, d, "events"), "value", method="percentile").select("lower", "upper")


META = "WITH g AS (SELECT c_nationkey study, avg(c_acctbal) y, stddev_samp(c_acctbal)/sqrt(count(*)) se FROM customer GROUP BY 1 HAVING count(*) > 1), w AS (SELECT sum(1/(se*se)) w, sum(y/(se*se)) wy, sum(y*y/(se*se)) wyy, sum(1/pow(se,4)) w2, count(*)+0.0 k FROM g), q AS (SELECT k, greatest(0.0, wyy-wy*wy/w) q, w-w2/w c FROM w), u AS (SELECT k, q, greatest(0.0,(q-(k-1))/c) tau FROM q)"


@query("meta_random", META + f" SELECT {R('sum(y/(se*se+tau))/sum(1/(se*se+tau))', 4)} AS effect, {R('sqrt(1/sum(1/(se*se+tau)))', 4)} AS se, {R('max(q)', 4)} AS q_statistic, {R('max(tau)', 2)} AS tau_squared FROM g, u")
def _(spark, d):
    g = t(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("y"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("se")).filter("se IS NOT NULL")
    r = exploratory.meta_analysis(g, "y", "se", "c_nationkey").filter("study IS NULL")
    return r.select(F.round("effect", 4).alias("effect"), F.round("se", 4).alias("se"), F.round("q_statistic", 4).alias("q_statistic"), F.round("tau_squared", 2).alias("tau_squared"))


@query("variance_components", "WITH g AS (SELECT event_type, count(*)+0.0 n, avg(value) m, var_samp(value) v FROM events GROUP BY 1), w AS (SELECT sum(n) N, count(*) k, sum(n*m)/sum(n) gm, sum((n-1)*v)/(sum(n)-count(*)) msw, (sum(n)-sum(n*n)/sum(n))/(count(*)-1) n0 FROM g), s AS (SELECT msw, greatest(0.0, ((SELECT sum(n*pow(m-(SELECT gm FROM w),2)) FROM g)/(k-1)-msw)/n0) b FROM w) " + f"SELECT source, {R('v', 4)} AS variance FROM (SELECT 'event_type' source, b v FROM s UNION ALL SELECT 'Within', msw FROM s)")
def _(spark, d):
    return quality.one_way_random(t(spark, d, "events"), "value", "event_type", "event_type").select("source", F.round("variance", 4).alias("variance"))


@query("attr_capability", f"SELECT {R('avg(toxic)')} AS dpu, {R('avg(toxic)*1e6', 3)} AS dpmo, {R('100*(1-avg(toxic))')} AS yield_pct FROM labels")
def _(spark, d):
    return quality.attribute_capability(t(spark, d, "labels"), "toxic").select("dpu", F.round("dpmo", 3).alias("dpmo"), "yield_pct")


@query("anom_groups", f"SELECT event_type AS name, {R('avg(value)')} AS mean, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, d):
    return quality.anom(t(spark, d, "events"), "value", "event_type").select("name", "mean", "n")


@query("taguchi", f"SELECT event_type, {R('100.0/100*(var_samp(value)+pow(avg(value)-50,2))', 4)} AS expected_loss FROM events GROUP BY 1")
def _(spark, d):
    return quality.TaguchiLoss("nib", 50.0, 10.0, 100.0).expected_loss(t(spark, d, "events"), "value", ["event_type"]).select("event_type", F.round("expected_loss", 4).alias("expected_loss"))


@query("desirability", f"SELECT p_partkey, {R('sqrt(d1*d2)')} AS composite_d FROM (SELECT p_partkey, CASE WHEN p_size <= 1 THEN 0.0 WHEN p_size >= 50 THEN 1.0 ELSE (p_size-1)/49.0 END d1, CASE WHEN p_retailprice >= 2500 THEN 0.0 WHEN p_retailprice <= 800 THEN 1.0 ELSE (2500-p_retailprice)/1700.0 END d2 FROM part)")
def _(spark, d):
    r = quality.derringer_suich(t(spark, d, "part"), [dict(name="p_size", goal="maximize", lower=1.0, target=50.0), dict(name="p_retailprice", goal="minimize", target=800.0, upper=2500.0)])
    return r.select("p_partkey", "composite_d")


_reg("nonnormal_capability", lambda s, d: quality.nonnormal_capability(t(s, d, "events"), "value", 0.0, 200.0), 5)
_reg("acceptance_attribute", lambda s, d: quality.attribute_plan(s).drop("oc"))
_reg("acceptance_variable", lambda s, d: quality.variable_plan(s).drop("oc"))
_reg("process_decision", lambda s, d: quality.ProcessDecision().sweep(s))
_reg("acceptance_decision", lambda s, d: quality.AcceptanceDecision().sweep(s))
_reg("cost_of_quality", lambda s, d: quality.CostOfQuality(10.0, 5.0, 20.0, 30.0, 1000.0).optimal_prevention_model(s))

CELLS = "first3 AS (SELECT * FROM (SELECT l_linenumber p, l_returnflag o, l_quantity y, row_number() OVER (PARTITION BY l_linenumber, l_returnflag ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) rn FROM lineitem) WHERE rn <= 3)"


def cells(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_linenumber").alias("p"), F.col("l_returnflag").alias("o"), F.col("l_quantity").alias("y"))


@query("gage_rr", "WITH " + CELLS + f", m AS (SELECT avg(y) gm FROM first3), c AS (SELECT p, o, avg(y) m, var_pop(y)*count(*) ss FROM first3 GROUP BY 1,2) SELECT {R('sum(ss)/(count(*)*2)')} AS ms_repeatability, CAST(count(DISTINCT p) AS BIGINT) AS n_parts, CAST(count(DISTINCT o) AS BIGINT) AS n_operators FROM c")
def _(spark, d):
    return msa.crossed_gage_rr(cells(spark, d), "y", "p", "o").select("ms_repeatability", "n_parts", "n_operators")


@query("bland_altman", f"WITH u AS ({USERS}) SELECT {R('avg(a-b)')} AS mean_diff, {R('stddev_samp(a-b)')} AS std_diff, {R('avg(a-b)-1.96*stddev_samp(a-b)')} AS loa_lower, {R('avg(a-b)+1.96*stddev_samp(a-b)')} AS loa_upper, CAST(count(*) AS BIGINT) AS n FROM u WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    return msa.bland_altman(users(spark, d), "a", "b").select("mean_diff", "std_diff", "loa_lower", "loa_upper", "n")


_reg("icc", lambda s, d: msa.icc(cells(s, d).groupBy("p", "o").agg(F.avg("y").alias("y")), "y", "p", "o"))
_reg("linearity_bias", lambda s, d: msa.linearity_bias(t(s, d, "lineitem").select("l_quantity", (F.col("l_quantity") * 1.01 + F.col("l_tax")).alias("m")), "l_quantity", "m").drop("bias_per_level"))


@query("fleiss", "WITH f AS (SELECT user_id u, (event_id % 3) c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) rn FROM events), p AS (SELECT u, c, count(*)+0.0 n FROM f WHERE rn <= 10 GROUP BY 1,2), s AS (SELECT u, (sum(n*n)-10)/90 pi FROM p GROUP BY 1), q AS (SELECT sum(pow(t,2))/pow(sum(t),2) pe FROM (SELECT c, sum(n) t FROM p GROUP BY 1)) " + f"SELECT {R('(avg(pi)-max(pe))/(1-max(pe))')} AS value, CAST(count(*) AS BIGINT) AS n_subjects FROM s, q")
def _(spark, d):
    return msa.fleiss_kappa(t(spark, d, "events").select("user_id", (F.col("event_id") % 3).alias("c")), "c", "user_id").select("value", "n_subjects")


@query("krippendorff", "WITH c AS (SELECT user_id u, (event_id % 3) v, count(*)+0.0 n FROM events GROUP BY 1,2), s AS (SELECT u, sum(n) m, pow(sum(n),2)-sum(n*n) d FROM c GROUP BY 1 HAVING sum(n) > 1), p AS (SELECT v, sum(n) n FROM c WHERE u IN (SELECT u FROM s) GROUP BY 1) " + f"SELECT {R('1-(SELECT sum(d)/sum(m*(m-1)) FROM s)/((pow(sum(n),2)-sum(n*n))/(sum(n)*(sum(n)-1)))')} AS value FROM p")
def _(spark, d):
    return msa.krippendorff_alpha(t(spark, d, "events").select("user_id", (F.col("event_id") % 3).alias("c")), "c", "user_id").select("value")


# --- reliability -------------------------------------------------------------------------------------------

def lifetimes(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_quantity").alias("time"), (F.col("l_linestatus") == "F").alias("event"), F.col("l_returnflag").alias("g"), "l_discount")


@query("km_qty", f"WITH e AS (SELECT l_quantity tm, count(*) FILTER (l_linestatus='F') d, count(*) n FROM lineitem GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY tm DESC) ar FROM e), s AS (SELECT tm, ar, d, exp(sum(ln(1-d*1.0/ar)) OVER (ORDER BY tm)) s FROM r WHERE d < ar) SELECT {R('tm')} AS time, CAST(ar AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, {R('s')} AS survival FROM s WHERE d > 0")
def _(spark, d):
    return reliability.kaplan_meier(lifetimes(spark, d), "time", "event").filter("events > 0 AND events < at_risk").select("time", "at_risk", "events", "survival")


@query("logrank_qty", f"WITH e AS (SELECT l_quantity tm, count(*) FILTER (l_linestatus='F') d, count(*) FILTER (l_linestatus='F' AND l_returnflag='A') d1, count(*) x, count(*) FILTER (l_returnflag='A') x1 FROM lineitem WHERE l_returnflag IN ('A','R') GROUP BY 1), r AS (SELECT d+0.0 d, d1+0.0 d1, sum(x) OVER (ORDER BY tm DESC)+0.0 n, sum(x1) OVER (ORDER BY tm DESC)+0.0 n1 FROM e) SELECT {R('pow(sum(d1)-sum(d*n1/n),2)/sum(n1*(n-n1)*d*(n-d)/(n*n*(n-1)))')} AS chi_square FROM r WHERE d > 0 AND n > 1")
def _(spark, d):
    return reliability.log_rank_test(lifetimes(spark, d).filter("g IN ('A','R')"), "time", "event", "g").select("chi_square")


@query("expfit_value", f"SELECT {R('avg(value)')} AS mttf, {R('-ln(0.9)*avg(value)')} AS b10, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 0")
def _(spark, d):
    return reliability.exponential_fit(t(spark, d, "events"), "value").select("mttf", "b10", "n")


@query("lognfit_value", f"SELECT {R('exp(avg(ln(value))+var_pop(ln(value))/2)')} AS mttf, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 0")
def _(spark, d):
    return reliability.lognormal_fit(t(spark, d, "events"), "value").select("mttf", "n")


_reg("weibull_value", lambda s, d: reliability.weibull_fit(t(s, d, "events"), "value"), 5)
_reg("cox_qty", lambda s, d: reliability.cox_ph(lifetimes(s, d), "time", "event", ["l_discount"]), 5)
_reg("survival_summary", lambda s, d: reliability.survival_summary(lifetimes(s, d), "time", "event"))


@query("reliability_weibull", f"SELECT p_partkey, {R('exp(-pow(p_size/20.0, 1.5))')} AS reliability, {R('1.5/20*pow(p_size/20.0, 0.5)')} AS hazard FROM part")
def _(spark, d):
    p = t(spark, d, "part")
    return reliability.hazard_function(reliability.reliability_function(p, "p_size", 1.5, 20.0), "p_size", 1.5, 20.0).select("p_partkey", "reliability", "hazard")


# --- series ------------------------------------------------------------------------------------------------

HOURLY = "h AS (SELECT epoch(date_trunc('hour', ts))/3600 k, sum(value) v FROM events GROUP BY 1), s AS (SELECT v, row_number() OVER (ORDER BY k)-1 pos, count(*) OVER () n, avg(v) OVER () m FROM h)"


def hourly(spark, d):
    e = t(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("v"), F.count("*").cast("double").alias("c"))


@query("acf_hourly", "WITH " + HOURLY + f", z AS (SELECT sum(pow(v-m,2)) s0 FROM s), l AS (SELECT k, sum((a.v-a.m)*(b.v-b.m)) s FROM generate_series(1, 10) g(k), s a, s b WHERE b.pos = a.pos - k GROUP BY 1) SELECT CAST(k AS BIGINT) AS lag, {R('s/s0')} AS acf FROM l, z")
def _(spark, d):
    return timeseries.acf_pacf(hourly(spark, d), "v", ["ts"], 10).filter("lag > 0").select("lag", "acf")


@query("anomaly_hourly", "WITH " + HOURLY + f", a AS (SELECT pos, v, avg(v) OVER w mu, stddev_samp(v) OVER w sd FROM s WINDOW w AS (ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT CAST(pos AS BIGINT) AS pos, {R('CASE WHEN pos < 3 THEN 0.0 ELSE abs(v-mu)/sd END', 5)} AS score FROM a", 5)
def _(spark, d):
    return timeseries.anomaly_scores(hourly(spark, d), "v", ["ts"]).select("pos", "score")


@query("decompose_hourly", "WITH " + HOURLY + f", a AS (SELECT pos, v, avg(v) OVER (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) tr, count(*) OVER (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) c FROM s) SELECT CAST(pos AS BIGINT) AS pos, {R('tr', 5)} AS trend FROM a WHERE c = 7", 5)
def _(spark, d):
    return timeseries.classical_decompose(hourly(spark, d), "v", ["ts"], 7).filter("trend IS NOT NULL").select("pos", "trend")


_reg("ccf_hourly", lambda s, d: timeseries.cross_correlation(hourly(s, d), "v", "c", ["ts"], 10))
_reg("adf_hourly", lambda s, d: timeseries.adf_test(hourly(s, d), "v", ["ts"]), 5)
_reg("kpss_hourly", lambda s, d: timeseries.kpss_test(hourly(s, d), "v", ["ts"]), 5)
_reg("auto_diff", lambda s, d: timeseries.auto_diff_order(hourly(s, d), "v", ["ts"]), 5)
_reg("granger_hourly", lambda s, d: timeseries.granger_causality(hourly(s, d), "v", "c", ["ts"], 3), 5)
_reg("changepoints", lambda s, d: timeseries.pelt(hourly(s, d), "v", ["ts"]))
_reg("regimes", lambda s, d: timeseries.detect_regimes(hourly(s, d), "v", ["ts"]))
_reg("bocpd_hourly", lambda s, d: timeseries.bocpd(hourly(s, d), "v", ["ts"]))
_reg("arima_daily", lambda s, d: timeseries.arima(t(s, d, "events").groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("v")), "v", ["ts"], (1, 0, 1), 5), 2)
_reg("sarima_hourly", lambda s, d: timeseries.sarima(t(s, d, "events").groupBy(F.window("ts", "6 hours")["start"].alias("ts")).agg(F.sum("value").alias("v")), "v", ["ts"], (1, 0, 0), (1, 0, 0, 4), 8), 2)

# --- drift, conformal, sequential, corrections, router -----------------------------------------------------

@query("psi_halves", "WITH q AS (SELECT quantile_cont(value, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) e FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id % 2 h, least(10, len(list_filter((SELECT e FROM q), lambda x: x <= value))) b FROM events, q WHERE value >= e[1] AND value <= e[11]), n AS (SELECT b, count(*) FILTER (h=0)+0.0 r, count(*) FILTER (h=1)+0.0 c FROM b GROUP BY 1), p AS (SELECT b, r/(SELECT count(*) FROM events WHERE event_id%2=0)+1e-4 r, c/(SELECT count(*) FROM events WHERE event_id%2=1)+1e-4 c FROM n), z AS (SELECT r/(SELECT sum(r) FROM p) r, c/(SELECT sum(c) FROM p) c FROM p) " + f"SELECT {R('sum((c-r)*ln(c/r))')} AS psi FROM z")
def _(spark, d):
    e = t(spark, d, "events")
    return monitoring.compute_psi(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "value").select("psi").distinct()


_reg("adwin", lambda s, d: monitoring.adwin_detect(t(s, d, "events"), "value", ["ts", "event_id"]))
_reg("page_hinkley", lambda s, d: monitoring.page_hinkley_detect(t(s, d, "events"), "value", ["ts", "event_id"]), 4)


@query("eprocess_gauss", f"WITH r AS (SELECT row_number() OVER w t, sum(value-50) OVER w s FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT CAST(t AS BIGINT) AS t, {R('-0.5*ln(1+t/2500.0)+s*s/(2*2500.0*(2500+t))', 5)} AS log_e FROM r", 5)
def _(spark, d):
    return sequential.GaussianMeanEProcess(50.0, 50.0, 1.0).history(t(spark, d, "events"), "value", ["ts", "event_id"]).select("t", "log_e")


@query("eprocess_self", f"WITH s AS (SELECT event_type, count(*)+0.0 t, sum(value-50) s, sum(value) x, sum(value*value) q FROM events GROUP BY 1), v AS (SELECT *, q-x*x/t v FROM s) SELECT event_type, {R('-0.5*ln(1+t/v)+s*s/(2*v*(v/t+1))')} AS log_e FROM v")
def _(spark, d):
    return sequential.SelfNormalizedMeanEProcess(50.0).summary(t(spark, d, "events"), "value", by=["event_type"]).select("event_type", "log_e")


@query("eprocess_ab", "WITH r AS (SELECT event_type g, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) k FROM events WHERE event_type IN ('click','view')), d AS (SELECT a.value-b.value d FROM r a JOIN r b ON a.k=b.k AND a.g='click' AND b.g='view'), s AS (SELECT count(*)+0.0 t, sum(d) s, sum(d*d)-sum(d)*sum(d)/count(*) v FROM d) " + f"SELECT CAST(t AS BIGINT) AS t, {R('-0.5*ln(1+t*0.25/v)+0.25*s*s/(2*v*(v/t+0.25))')} AS log_e FROM s")
def _(spark, d):
    return sequential.TwoSampleEProcess().summary(t(spark, d, "events"), "value", "event_type", ["ts", "event_id"], ("click", "view")).select("t", "log_e")


@query("conformal", "WITH s AS (SELECT abs(value - 50) s FROM events WHERE event_id % 2 = 0), o AS (SELECT s, row_number() OVER (ORDER BY s) r, count(*) OVER () n FROM s) " + f"SELECT {R('s')} AS qhat FROM o WHERE r = least(n, ceil((n+1)*0.9))")
def _(spark, d):
    e = t(spark, d, "events").select("value", F.lit(50.0).alias("prediction"))
    c = monitoring.ConformalRegressor().calibrate(e, "value", "prediction", (0.1,))
    return spark.createDataFrame([(c.qhats["0.1"],)], "qhat double")


PV = "p AS (SELECT p_partkey k, (p_retailprice - floor(p_retailprice/100)*100)/100 * 0.2 + 0.0001 p FROM part)"


def pvalues(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_retailprice") - F.floor(F.col("p_retailprice") / 100) * 100) / 100 * 0.2 + 0.0001).alias("p"))


@query("bh", "WITH " + PV + ", r AS (SELECT k, p, p*count(*) OVER ()/(rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) a FROM p) " + f"SELECT k, {R('least(1.0, min(a) OVER (ORDER BY p DESC))')} AS adjusted_p FROM r")
def _(spark, d):
    return intelligence.benjamini_hochberg(pvalues(spark, d), "p").select("k", "adjusted_p")


@query("holm", "WITH " + PV + ", r AS (SELECT k, p, p*(count(*) OVER () - rank() OVER (ORDER BY p) + 1) a FROM p) " + f"SELECT k, {R('least(1.0, max(a) OVER (ORDER BY p))')} AS adjusted_p FROM r")
def _(spark, d):
    return intelligence.holm_bonferroni(pvalues(spark, d), "p").select("k", "adjusted_p")


_reg("auto_compare", lambda s, d: intelligence.auto_analyze(t(s, d, "events"), "compare", "value", "event_type"))
_reg("auto_correlate", lambda s, d: intelligence.auto_analyze(users(s, d), "correlate", columns=["a", "b"]))
_reg("auto_predict", lambda s, d: intelligence.auto_analyze(t(s, d, "lineitem"), "predict", columns=["l_quantity", "l_extendedprice"]))
_reg("auto_equivalence", lambda s, d: intelligence.auto_analyze(t(s, d, "events").filter("event_type IN ('click','view')"), "equivalence", "value", "event_type", margin=10.0))
_reg("profile", lambda s, d: intelligence.profile_data(t(s, d, "events"), "value", "event_type"), 5)
_reg("compare_methods", lambda s, d: intelligence.compare_methods(t(s, d, "events"), "value", "event_type"))
_reg("normality_by_type", lambda s, d: core.check_normality(t(s, d, "events"), "value", by=["event_type"]), 5)
_reg("equal_variance", lambda s, d: core.check_equal_variance(t(s, d, "events"), "value", "event_type"))
_reg("outliers", lambda s, d: core.check_outliers(t(s, d, "events"), "value", by=["event_type"]))
_reg("fit_normal", lambda s, d: core.fit_distribution(t(s, d, "customer"), "c_acctbal", "normal"), 4)
_reg("fit_best", lambda s, d: core.fit_best(t(s, d, "customer"), "c_acctbal"), 2)
_reg("box_cox", lambda s, d: core.box_cox(t(s, d, "events").filter("value > 0"), "value").agg(F.avg("transformed").alias("mean"), F.first("lambda").alias("lambda")), 4)
_reg("johnson", lambda s, d: core.johnson_transform(t(s, d, "customer"), "c_acctbal").agg(F.avg("transformed").alias("mean"), F.first("family").alias("family")), 4)
_reg("sample_normal", lambda s, d: core.sample_normal(s, 0, 1, 100, 42))
_reg("power_t", lambda s, d: power.power_t_test(s, 0.5, power=0.8))
_reg("power_anova", lambda s, d: power.power_anova(s, 0.25, 3, power=0.8))
_reg("power_proportion", lambda s, d: power.power_proportion(s, 0.6, p0=0.5, power=0.8))
_reg("power_chi2", lambda s, d: power.power_chi_square(s, 0.3, 4, power=0.8))
_reg("power_equivalence", lambda s, d: power.power_equivalence(s, 0.0, 0.5, power=0.8))

from quillon import more_queries  # noqa: E402, F401  adds to QUERIES and ORACLES
