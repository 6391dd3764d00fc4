"""Further registered queries: operators over the driver's tables with independent SQL for the columns they return.

Iterative fits are unrolled in SQL as Newton steps of their own; constants that SQL has no function for
(quantiles of the normal, t and chi-square laws) are written out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.calibration import calibrate
from quillon.functions import effects
from quillon.operators import bayesian, core, exploratory, intelligence, monitoring, msa, nonparametric, parametric, power, quality, regression, reliability, timeseries
from quillon.queries import ANOVA_S, HOURLY, N_DENS, ORACLES, PAIRS, QUERIES, RANKS, TWO_WAY, USERS, R, anova_sql, cells, hourly, lifetimes, pvalues, query, rounded, simpson, t, users

Z90, Z95, Z975, Z80, Z99 = "1.2815515655446004", "1.6448536269514722", "1.959963984540054", "0.8416212335729143", "2.3263478740408408"  # fixed values: normal quantiles
CELL = "(SELECT l_linenumber p, l_returnflag o, avg(l_quantity) m, var_pop(l_quantity)*count(*) ss, count(*)+0.0 n FROM lineitem GROUP BY 1,2)"


def newton(start: str, step: str, names: str, rounds: int) -> str:
    """CTEs it0..it<rounds>, each row `names` made by `step` from the row {prev} before."""
    out = [f"it0({names}) AS MATERIALIZED ({start})"]
    out += [f"it{i}({names}) AS MATERIALIZED ({step.format(prev=f'it{i - 1}')})" for i in range(1, rounds + 1)]
    return ", ".join(out)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- studies over every row -------------------------------------------------------------------------------

ORACLES["gage_rr"] = f"SELECT {R('sum(ss)/(sum(n)-count(*))')} AS ms_repeatability, CAST(count(DISTINCT p) AS BIGINT) AS n_parts, CAST(count(DISTINCT o) AS BIGINT) AS n_operators FROM {CELL}"
ORACLES["fleiss"] = "WITH p AS (SELECT user_id u, event_id % 3 c, count(*)+0.0 n FROM events GROUP BY 1,2), s AS (SELECT u, sum(n) m, sum(n*n) cc FROM p GROUP BY 1), q AS (SELECT sum(t*t)/pow(sum(t),2) pe FROM (SELECT c, sum(n) t FROM p GROUP BY 1)) " + f"SELECT {R('(avg((cc-m)/(m*(m-1)))-max(pe))/(1-max(pe))')} AS value, CAST(count(*) AS BIGINT) AS n_subjects FROM s, q"
ORACLES["conformal"] = "WITH s AS (SELECT abs(value - 50) s FROM events), o AS (SELECT s, row_number() OVER (ORDER BY s) r, count(*) OVER () n FROM s) " + f"SELECT {R('s')} AS qhat FROM o WHERE r = least(n, ceil((n+1)*0.9))"


@query("icc_cells", f"WITH c AS {CELL}, g AS (SELECT avg(m) gm FROM c), s AS (SELECT (SELECT sum(3*pow(x-(SELECT gm FROM g),2)) FROM (SELECT p, avg(m) x FROM c GROUP BY 1)) ssr, (SELECT sum(7*pow(x-(SELECT gm FROM g),2)) FROM (SELECT o, avg(m) x FROM c GROUP BY 1)) ssc, (SELECT sum(pow(m-(SELECT gm FROM g),2)) FROM c) sst), q AS (SELECT ssr/6 msr, (sst-ssr-ssc)/12 mse FROM s) SELECT {R('least(1,greatest(0,(msr-mse)/(msr+2*mse)))')} AS icc, {R('msr/mse')} AS f_statistic FROM q")
def _(spark, d):
    return msa.icc(cells(spark, d).groupBy("p", "o").agg(F.avg("y").alias("y")), "y", "p", "o").select("icc", "f_statistic")


@query("linearity_regr", "WITH b AS (SELECT l_quantity r, l_quantity*1.01+l_tax-l_quantity b FROM lineitem) " + f"SELECT {R('avg(b)')} AS overall_bias, {R('regr_slope(b,r)')} AS linearity_slope, {R('regr_intercept(b,r)')} AS linearity_intercept, {R('regr_r2(b,r)')} AS linearity_r_squared FROM b")
def _(spark, d):
    rows = t(spark, d, "lineitem").select("l_quantity", (F.col("l_quantity") * 1.01 + F.col("l_tax")).alias("m"))
    return msa.linearity_bias(rows, "l_quantity", "m").select("overall_bias", "linearity_slope", "linearity_intercept", "linearity_r_squared")


# --- assumptions, fits, effects ---------------------------------------------------------------------------

@query("equal_variance_test", "WITH md AS (SELECT event_type, median(value) md FROM events GROUP BY 1), z AS (SELECT e.event_type, abs(value-md) z FROM events e JOIN md USING (event_type)), " + anova_sql("event_type", "z", "z")[5:] + f" SELECT {R('f')} AS statistic, {R('1-area')} AS p_value, 1-area > 0.05 AS passed FROM a")
def _(spark, d):
    return core.check_equal_variance(t(spark, d, "events"), "value", "event_type").select("statistic", "p_value", "passed")


@query("outlier_counts", f"WITH q AS (SELECT event_type, quantile_cont(value,0.25) a, quantile_cont(value,0.75) b FROM events GROUP BY 1) SELECT event_type, {R('sum(CASE WHEN value < a-1.5*(b-a) OR value > b+1.5*(b-a) THEN 1 ELSE 0 END)')} AS statistic, avg(CASE WHEN value < a-1.5*(b-a) OR value > b+1.5*(b-a) THEN 1.0 ELSE 0.0 END) < 0.1 AS passed FROM events JOIN q USING (event_type) GROUP BY 1")
def _(spark, d):
    return core.check_outliers(t(spark, d, "events"), "value", by=["event_type"]).select("event_type", "statistic", "passed")


KS = f"WITH m AS (SELECT avg(c_acctbal) m, stddev_samp(c_acctbal) s FROM customer), v AS (SELECT c_acctbal x, count(*) c FROM customer GROUP BY 1), r AS (SELECT (x-m)/s z, sum(c) OVER (ORDER BY x) up, sum(c) OVER (ORDER BY x)-c lo, sum(c) OVER () n FROM v, m), a AS ({simpson('r', 'z, up, lo, n', 'abs(z)', N_DENS, 'area')}), f AS (SELECT up/n u, lo/n l, 0.5+sign(z)*area f FROM a) "


@query("normality_ks", KS + f"SELECT {R('max(greatest(u-f, f-l))', 5)} AS statistic FROM f", 5)
def _(spark, d):
    return core.check_normality(t(spark, d, "customer"), "c_acctbal", method="ks").select("statistic")


@query("fit_normal_likelihood", f"WITH s AS (SELECT count(*)+0.0 n, var_pop(c_acctbal) v FROM customer), l AS (SELECT n, -n/2*(ln(2*pi()*v)+1) ll FROM s) SELECT {R('ll', 3)} AS log_likelihood, {R('4-2*ll', 3)} AS aic, {R('2*ln(n)-2*ll', 3)} AS bic FROM l", 3)
def _(spark, d):
    return core.fit_distribution(t(spark, d, "customer"), "c_acctbal", "normal").select("log_likelihood", "aic", "bic")


@query("cohens_d_one", f"SELECT {R('(avg(value)-45)/stddev_samp(value)')} AS cohens_d FROM events")
def _(spark, d):
    return core.cohens_d_one_sample(t(spark, d, "events"), "value", 45.0)


@query("cohens_d_two", f"WITH g AS (SELECT count(*) FILTER (event_type='click') n1, count(*) FILTER (event_type='view') n2, avg(value) FILTER (event_type='click')-avg(value) FILTER (event_type='view') d, var_samp(value) FILTER (event_type='click') v1, var_samp(value) FILTER (event_type='view') v2 FROM events) SELECT {R('d/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2))')} AS cohens_d FROM g")
def _(spark, d):
    return core.cohens_d_two_sample(t(spark, d, "events").filter("event_type IN ('click','view')"), "value", "event_type")


@query("cohens_d_pairs", f"SELECT {R('avg(a-b)/stddev_samp(a-b)')} AS cohens_d FROM ({USERS}) WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    return core.cohens_d_paired(users(spark, d), "a", "b")


@query("effect_sizes", ANOVA_S.format(g="event_type", v="value", f="events") + f", h AS (SELECT *, ssb+ssw sst, ssw/d2 msw FROM s) SELECT {R('ssb/sst', 8)} AS eta_squared, {R('greatest(0.0,(ssb-d1*msw)/(sst+msw))', 8)} AS omega_squared, {R('ssb/(ssb+ssw)', 8)} AS partial_eta_squared FROM h", 8)
def _(spark, d):
    r = parametric.one_way(t(spark, d, "events"), "value", "event_type").first()
    b, w = r["ss_between"], r["ss_within"]
    k, n = t(spark, d, "events").agg(F.countDistinct("event_type"), F.count("*")).first()
    return table(spark, [(effects.eta_squared(b, b + w), effects.omega_squared(b, b + w, k - 1, w / (n - k)), effects.partial_eta_squared(b, w))], "eta_squared double, omega_squared double, partial_eta_squared double")


CONTINGENCY = "WITH o AS (SELECT o_orderstatus r, o_orderpriority c, count(*)+0.0 o FROM orders GROUP BY 1,2), e AS (SELECT o.*, (SELECT sum(o) FROM o x WHERE x.r=o.r)*(SELECT sum(o) FROM o y WHERE y.c=o.c)/(SELECT sum(o) FROM o) e FROM o), s AS (SELECT sum(pow(o-e,2)/e) chi, sum(o) n FROM e)"


@query("count_effects", CONTINGENCY + ", " + RANKS.format(w="WHERE event_type IN ('click','view')")[5:] + f", w AS (SELECT count(*) FILTER (g='click')+0.0 n1, count(*) FILTER (g='view')+0.0 n2, sum(r) FILTER (g='click') rs FROM r) SELECT {R('sqrt(chi/(n*2))')} AS cramers_v, {R('1-2*(rs-n1*(n1+1)/2)/(n1*n2)')} AS rank_biserial, {R('chi/(n-1)', 8)} AS epsilon_squared FROM s, w", 8)
def _(spark, d):
    chi = parametric.chi_square_independence(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority").first()["statistic"]
    u = nonparametric.mann_whitney(t(spark, d, "events"), "value", "event_type", labels=["click", "view"]).first()
    n = t(spark, d, "orders").count()
    row = (round(effects.cramers_v(chi, n, 3), 6), round(effects.rank_biserial(u["statistic"], u["n1"], u["n2"]), 6), effects.epsilon_squared(chi, n))
    return table(spark, [row], "cramers_v double, rank_biserial double, epsilon_squared double")


@query("effect_words", "SELECT CAST(i AS BIGINT) AS i, CASE WHEN i < 20 THEN 'negligible' WHEN i < 50 THEN 'small' WHEN i < 80 THEN 'medium' ELSE 'large' END AS word FROM generate_series(0, 100) g(i)")
def _(spark, d):
    return table(spark, [(i, effects.classify_effect(i / 100, "cohens_d")) for i in range(101)], "i long, word string")


@query("psi_words", "SELECT CAST(i AS BIGINT) AS i, CASE WHEN i < 10 THEN 'none' WHEN i < 20 THEN 'minor' WHEN i < 25 THEN 'moderate' ELSE 'major' END AS word FROM generate_series(0, 40) g(i)")
def _(spark, d):
    return table(spark, [(i, monitoring.psi_severity(i / 100)) for i in range(41)], "i long, word string")


@query("box_quartiles", f"SELECT event_type AS name, {R('quantile_cont(value,0.25)')} AS q1, {R('median(value)')} AS median, {R('quantile_cont(value,0.75)')} AS q3, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, d):
    box = core.box_views(t(spark, d, "events"), "value", "event_type")[0]
    return table(spark, [(x["name"], x["q1"], x["median"], x["q3"], x["n"]) for x in box["traces"]], "name string, q1 double, median double, q3 double, n long")


@query("histogram_counts", "WITH m AS (SELECT min(value) lo, (max(value)-min(value))/20 w FROM events), b AS (SELECT least(19, floor((value-lo)/w)) b FROM events, m) " + f"SELECT {R('lo+(i+0.5)*w')} AS x, CAST((SELECT count(*) FROM b WHERE b.b=i) AS BIGINT) AS y FROM m, generate_series(0, 19) g(i)")
def _(spark, d):
    bars = core.histogram_views(t(spark, d, "events"), "value")[0]["traces"][0]
    return table(spark, list(zip(map(float, bars["x"]), map(int, bars["y"]), strict=True)), "x double, y long")


@query("sample_view_quartiles", ORACLES["box_quartiles"])
def _(spark, d):
    box = core.sample_views(t(spark, d, "events"), "value", "event_type")[0]
    return table(spark, [(x["name"], x["q1"], x["median"], x["q3"], x["n"]) for x in box["traces"]], "name string, q1 double, median double, q3 double, n long")


# --- designs ----------------------------------------------------------------------------------------------

@query("rm_anova_table", "WITH y AS (SELECT user_id s, event_type c, avg(value) y FROM events GROUP BY 1,2), g AS (SELECT avg(y) gm, count(DISTINCT s)+0.0 n, count(DISTINCT c)+0.0 k, var_pop(y)*count(*) sst FROM y), q AS (SELECT n, k, (SELECT sum(pow(m-(SELECT gm FROM g),2)) FROM (SELECT c, avg(y) m FROM y GROUP BY 1))*n ssc, (SELECT sum(pow(m-(SELECT gm FROM g),2)) FROM (SELECT s, avg(y) m FROM y GROUP BY 1))*k sss, sst FROM g), e AS (SELECT *, sst-ssc-sss sse FROM q) " + f"SELECT {R('ssc/(k-1)/(sse/((k-1)*(n-1)))', 5)} AS f_statistic, {R('ssc', 3)} AS ss_condition, {R('sss', 3)} AS ss_subject, {R('sse', 2)} AS ss_error, CAST(n AS BIGINT) AS n_subjects FROM e")
def _(spark, d):
    r = parametric.repeated_measures_anova(t(spark, d, "events"), "value", "user_id", "event_type")
    return r.select(F.round("f_statistic", 5).alias("f_statistic"), F.round("ss_condition", 3).alias("ss_condition"), F.round("ss_subject", 3).alias("ss_subject"), F.round("ss_error", 2).alias("ss_error"), "n_subjects")


@query("split_plot_table", TWO_WAY.format(a="l_returnflag", b="l_linestatus", v="l_quantity", f="lineitem") + f", ms AS (SELECT *, ssi/((ka-1)*(kb-1)) msi, (sst-ssa-ssb-ssi)/(ka*kb*(floor(n/(ka*kb))-1)) mse FROM s) SELECT source, {R('ss', 4)} AS ss, {R('f', 5)} AS f_statistic FROM (SELECT 'l_returnflag' source, ssa ss, ssa/(ka-1)/msi f FROM ms UNION ALL SELECT 'l_linestatus', ssb, ssb/(kb-1)/mse FROM ms UNION ALL SELECT 'l_returnflag:l_linestatus', ssi, msi/mse FROM ms)")
def _(spark, d):
    r = parametric.split_plot_anova(t(spark, d, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus").filter("source <> 'Residual'")
    return r.select("source", F.round("ss", 4).alias("ss"), F.round("f_statistic", 5).alias("f_statistic"))


def moment_sql(f: str) -> str:
    g = f"(SELECT {f}, count(*)+0.0 n, avg(p_retailprice) m, var_samp(p_retailprice) v FROM part GROUP BY 1)"
    return f"(SELECT greatest(0.0, ((SELECT sum(n*pow(m-(SELECT avg(p_retailprice) FROM part),2)) FROM {g})/(count(*)-1)-sum((n-1)*v)/(sum(n)-count(*)))/((sum(n)-sum(n*n)/sum(n))/(count(*)-1))) b, sum((n-1)*v)/(sum(n)-count(*)) w FROM {g})"


VARIANCES = f"SELECT term, {R('v', 3)} AS estimate FROM (SELECT 'var(p_brand)' term, b v FROM {moment_sql('p_brand')} UNION ALL SELECT 'var(p_type)', b FROM {moment_sql('p_type')} UNION ALL SELECT 'var(residual)', w FROM {moment_sql('p_type')})"


@query("nested_variances", VARIANCES, 3)
def _(spark, d):
    return parametric.nested_anova(t(spark, d, "part"), "p_retailprice", ["p_brand", "p_type"]).filter("term LIKE 'var(%'").select("term", "estimate")


@query("mixed_variances", VARIANCES, 3)
def _(spark, d):
    return parametric.mixed_model(t(spark, d, "part"), "p_retailprice", ["p_size"], ["p_brand", "p_type"]).filter("term LIKE 'var(%'").select("term", "estimate")


ORACLES["variance_decomposition"] = "WITH a AS (SELECT p_brand, p_type, p_retailprice r0, p_retailprice-avg(p_retailprice) OVER (PARTITION BY p_brand) r1 FROM part), b AS (SELECT *, r1-avg(r1) OVER (PARTITION BY p_type) r2 FROM a), s AS (SELECT var_pop(r0)-var_pop(r1) v1, var_pop(r1)-var_pop(r2) v2, var_samp(r2) v3, var_samp(r0) total FROM b) " + f"SELECT component, {R('v')} AS variance, {R('100*v/(v1+v2+v3)')} AS pct, {R('total')} AS total, {R('v/(v1+v2+v3)')} AS icc FROM (SELECT 'p_brand' component, v1 v, * FROM s UNION ALL SELECT 'p_type', v2, * FROM s UNION ALL SELECT 'Residual', v3, * FROM s)"


# --- ranks and post-hoc -----------------------------------------------------------------------------------

ORACLES["hodges_lehmann"] = f"SELECT {R('median(a.value-b.value)')} AS shift FROM events a, events b WHERE a.event_type='click' AND b.event_type='view'"


@query("dunn_z", RANKS.format(w="") + f", g AS (SELECT g, count(*)+0.0 n, avg(r) m FROM r GROUP BY 1), c AS (SELECT sum(n) n, count(*) k, (SELECT sum(t*t-1.0) FROM r) ties FROM g), p AS (SELECT a.g group1, b.g group2, a.m-b.m diff, sqrt((c.n*(c.n+1)/12-ties/(12*(c.n-1)))*(1/a.n+1/b.n)) se, k FROM g a JOIN g b ON a.g < b.g, c), s AS (SELECT *, diff/se z FROM p), a AS ({simpson('s', 'group1, group2, diff, se, z, k', 'abs(z)', N_DENS, 'area')}) SELECT group1, group2, {R('diff', 4)} AS mean_diff, {R('se', 5)} AS se, {R('z')} AS t_or_q, {R('least(1.0,(1-2*area)*k*(k-1)/2)', 5)} AS p_value FROM a")
def _(spark, d):
    r = nonparametric.dunn(t(spark, d, "events"), "value", "event_type")
    return r.select("group1", "group2", F.round("mean_diff", 4).alias("mean_diff"), F.round("se", 5).alias("se"), "t_or_q", F.round("p_value", 5).alias("p_value"))


@query("dunnett_t", PAIRS.replace("ON a.g < b.g", "ON b.g = 'click' AND a.g <> 'click'") + f" SELECT group1, group2, {R('diff')} AS mean_diff, {R('sqrt(mse*(1/n1+1/n2))')} AS se, {R('diff/sqrt(mse*(1/n1+1/n2))')} AS t_or_q FROM p, w")
def _(spark, d):
    return nonparametric.dunnett(t(spark, d, "events"), "value", "event_type", "click").select("group1", "group2", "mean_diff", "se", "t_or_q")


@query("kendall_tau", f"WITH u AS (SELECT user_id i, a x, b y FROM ({USERS}) WHERE a IS NOT NULL AND b IS NOT NULL), p AS (SELECT sign(p.x-q.x) sx, sign(p.y-q.y) sy FROM u p JOIN u q ON p.i < q.i) SELECT {R('sum(sx*sy)/sqrt(sum(sx*sx)*sum(sy*sy))')} AS r, (SELECT CAST(count(*) AS BIGINT) FROM u) AS n FROM p")
def _(spark, d):
    return parametric.correlation(users(spark, d), ["a", "b"], "kendall").select("r", "n")


# --- regression -------------------------------------------------------------------------------------------

QUALITY = "d AS MATERIALIZED (SELECT quality y, ln(greatest(n_chars, 1)) x FROM labels JOIN documents USING (doc_id))"
LOGIT = "SELECT b0+(h11*g0-h01*g1)/(h00*h11-h01*h01), b1+(h00*g1-h01*g0)/(h00*h11-h01*h01) FROM (SELECT max(b0) b0, max(b1) b1, sum(y-p) g0, sum((y-p)*x) g1, sum(p*(1-p)) h00, sum(p*(1-p)*x) h01, sum(p*(1-p)*x*x) h11 FROM (SELECT *, 1/(1+exp(-(b0+b1*x))) p FROM d, {prev}))"


@query("logistic_coefficients", f"WITH {QUALITY}, {newton('SELECT ln(avg(y)/(1-avg(y))), 0.0 FROM d', LOGIT, 'b0, b1', 14)}, f AS (SELECT *, 1/(1+exp(-(b0+b1*x))) p FROM d, it14), h AS (SELECT max(b0) b0, max(b1) b1, sum(p*(1-p)) a, sum(p*(1-p)*x) b, sum(p*(1-p)*x*x) c, sum(y*ln(p)+(1-y)*ln(1-p)) ll FROM f) SELECT term, {R('e', 4)} AS estimate, {R('s', 4)} AS std_error, {R('ll', 4)} AS log_likelihood FROM (SELECT '(Intercept)' term, b0 e, sqrt(c/(a*c-b*b)) s, ll FROM h UNION ALL SELECT 'log_chars', b1, sqrt(a/(a*c-b*b)), ll FROM h)", 4)
def _(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.log(F.greatest("n_chars", F.lit(1))).alias("log_chars"))
    return regression.logistic_regression(t(spark, d, "labels").join(docs, "doc_id"), "quality", ["log_chars"]).select("term", "estimate", "std_error", "log_likelihood")


POIS = "SELECT b0+(h11*g0-h01*g1)/(h00*h11-h01*h01), b1+(h00*g1-h01*g0)/(h00*h11-h01*h01) FROM (SELECT max(b0) b0, max(b1) b1, sum(s-n*m) g0, sum((s-n*m)*x) g1, sum(n*m) h00, sum(n*m*x) h01, sum(n*m*x*x) h11 FROM (SELECT *, exp(b0+b1*x) m FROM d, {prev}))"


@query("poisson_coefficients", f"WITH d AS MATERIALIZED (SELECT l_quantity x, count(*)+0.0 n, sum(l_linenumber)+0.0 s FROM lineitem GROUP BY 1), {newton('SELECT ln(sum(s)/sum(n)), 0.0 FROM d', POIS, 'b0, b1', 8)} SELECT term, {R('e', 7)} AS estimate FROM (SELECT '(Intercept)' term, b0 e FROM it8 UNION ALL SELECT 'l_quantity', b1 FROM it8)", 7)
def _(spark, d):
    return regression.poisson_regression(t(spark, d, "lineitem"), "l_linenumber", ["l_quantity"]).select("term", "estimate")


GAMMA = "SELECT (a11*c0-a01*c1)/(a00*a11-a01*a01), (a00*c1-a01*c0)/(a00*a11-a01*a01) FROM (SELECT sum(n*m*m) a00, sum(n*m*m*x) a01, sum(n*m*m*x*x) a11, sum(m*m*n/m-(s-n*m)) c0, sum((m*m*n/m-(s-n*m))*x) c1 FROM (SELECT *, 1/(b0+b1*x) m FROM d, {prev}))"


@query("gamma_coefficients", f"WITH d AS MATERIALIZED (SELECT user_id+0.0 x, count(*)+0.0 n, sum(value) s FROM events WHERE value > 0 GROUP BY 1), {newton('SELECT sum(n)/sum(s), 0.0 FROM d', GAMMA, 'b0, b1', 8)} SELECT term, {R('e', 7)} AS estimate FROM (SELECT '(Intercept)' term, b0 e FROM it8 UNION ALL SELECT 'user_id', b1 FROM it8)", 7)
def _(spark, d):
    return regression.glm(t(spark, d, "events").filter("value > 0"), "value", ["user_id"], "gamma").select("term", "estimate")


SQUARE = "WITH c AS (SELECT covar_pop(q,q) s11, covar_pop(q,q*q) s12, covar_pop(q*q,q*q) s22, covar_pop(q,y) s1y, covar_pop(q*q,y) s2y, avg(q) m1, avg(q*q) m2, avg(y) my FROM (SELECT l_quantity q, l_extendedprice y FROM lineitem)), b AS (SELECT *, (s22*s1y-s12*s2y)/(s11*s22-s12*s12) b1, (s11*s2y-s12*s1y)/(s11*s22-s12*s12) b2 FROM c)"


@query("polynomial_coefficients", SQUARE + f" SELECT term, {R('e', 3)} AS estimate FROM (SELECT '(Intercept)' term, my-b1*m1-b2*m2 e FROM b UNION ALL SELECT 'l_quantity', b1 FROM b UNION ALL SELECT 'l_quantity^2', b2 FROM b)", 3)
def _(spark, d):
    return regression.polynomial(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 2).select("term", "estimate")


SUBSETS = "WITH c AS (SELECT count(*)+0.0 n, covar_pop(l_quantity,l_quantity) s11, covar_pop(l_quantity,l_discount) s12, covar_pop(l_discount,l_discount) s22, covar_pop(l_quantity,l_extendedprice) s1y, covar_pop(l_discount,l_extendedprice) s2y, var_pop(l_extendedprice) syy FROM lineitem), e AS (SELECT n, syy*n sst, n*(syy-(s22*s1y*s1y-2*s12*s1y*s2y+s11*s2y*s2y)/(s11*s22-s12*s12)) full_, n*(syy-s1y*s1y/s11) one, n*(syy-s2y*s2y/s22) two FROM c)"


@query("subset_scores", SUBSETS + f" SELECT features, CAST(k AS BIGINT) AS p, {R('1-sse/sst', 8)} AS r_squared, {R('n*ln(sse/n)+2*(k+1)', 3)} AS aic, {R('n*ln(sse/n)+(k+1)*ln(n)', 3)} AS bic, {R('sse/(full_/(n-3))-n+2*(k+1)', 4)} AS mallows_cp FROM (SELECT 'l_quantity' features, 1 k, one sse, * FROM e UNION ALL SELECT 'l_discount', 1, two, * FROM e UNION ALL SELECT 'l_quantity,l_discount', 2, full_, * FROM e)", 8)
def _(spark, d):
    r = regression.best_subsets(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return r.select(F.array_join("features", ",").alias("features"), "p", "r_squared", F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"), F.round("mallows_cp", 4).alias("mallows_cp"))


@query("stepwise_model", f"SELECT 'q' AS selected, {R('regr_r2(3*l_quantity+100*l_tax, l_quantity)', 8)} AS r_squared FROM lineitem", 8)
def _(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), (3 * F.col("l_quantity") + 100 * F.col("l_tax")).alias("y"))
    return regression.stepwise(rows, "y", ["q"]).filter("action = 'final'").select(F.array_join("selected", ",").alias("selected"), "r_squared")


@query("ols_leverage", f"WITH s AS (SELECT regr_slope(value,user_id) b, regr_intercept(value,user_id) a, avg(user_id) m, regr_sxx(value,user_id) sxx, count(*)+0.0 n FROM events), r AS (SELECT value-a-b*user_id e, 1/n+pow(user_id-m,2)/sxx h, row_number() OVER (ORDER BY ts, event_id) k FROM events, s), l AS (SELECT e, h, lead(e) OVER (ORDER BY k) f FROM r) SELECT {R('max(h)', 8)} AS max_leverage, {R('sum(pow(f-e,2))/sum(e*e)')} AS durbin_watson FROM l", 8)
def _(spark, d):
    r = regression.ols_diagnostics(t(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"])
    return regression.durbin_watson(r).select(F.round("durbin_watson", 6).alias("durbin_watson")).crossJoin(r.agg(F.max("leverage").alias("max_leverage")))


@query("residual_charts")
def _(spark, d):
    r = regression.ols_diagnostics(t(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"])
    charts = [regression.residual_vs_fitted(r), *regression.residual_diagnostics(r)]
    return table(spark, [(i, c["title"], c["chart_type"], len(c["traces"][0]["x"])) for i, c in enumerate(charts)], "i long, title string, chart_type string, points long")


# --- Bayesian ---------------------------------------------------------------------------------------------

CLIP = "least(1e200, greatest(1e-10, exp(least(e, 460.0))))"


@query("bayes_one_posterior", f"SELECT {R('avg(c_acctbal)', 4)} AS posterior_mean, {R('stddev_samp(c_acctbal)/sqrt(count(*))', 4)} AS posterior_std FROM customer", 4)
def _(spark, d):
    return bayesian.bayesian_ttest_one_sample(t(spark, d, "customer"), "c_acctbal", 4500.0).select("posterior_mean", "posterior_std")


TWO = "(SELECT avg(value) FILTER (event_type='click') m1, avg(value) FILTER (event_type='view') m2, sqrt(var_samp(value) FILTER (event_type='click')/count(*) FILTER (event_type='click')+var_samp(value) FILTER (event_type='view')/count(*) FILTER (event_type='view')) se FROM events)"


@query("bayes_two_posterior", f"SELECT {R('m1-m2')} AS posterior_mean, {R('se')} AS posterior_std FROM {TWO}")
def _(spark, d):
    return bayesian.bayesian_ttest_two_sample(t(spark, d, "events"), "value", "event_type", labels=["click", "view"]).select("posterior_mean", "posterior_std")


@query("bayes_ab_posterior", f"WITH s AS (SELECT *, (m2-m1)/se z FROM {TWO}), a AS ({simpson('s', 'm1, m2, se, z', 'abs(z)', N_DENS, 'area')}) SELECT {R('m2-m1')} AS posterior_mean, {R(f'm2-m1-{Z975}*se')} AS ci_lower, {R(f'm2-m1+{Z975}*se')} AS ci_upper, {R('0.5+sign(z)*area')} AS p_b_better, {R('(m2-m1)/m1')} AS uplift FROM a")
def _(spark, d):
    return bayesian.bayesian_ab(t(spark, d, "events"), "value", "event_type", labels=["click", "view"]).select("posterior_mean", "ci_lower", "ci_upper", "p_b_better", "uplift")


@query("bayes_corr_posterior", f"WITH s AS (SELECT corr(a,b) r, count(*)+0.0 n FROM ({USERS}) WHERE a IS NOT NULL AND b IS NOT NULL), z AS (SELECT *, 0.5*ln((1+r)/(1-r)) z, {Z975}/sqrt(n-3) h FROM s) SELECT {R('r')} AS posterior_mean, {R('(1-r*r)/sqrt(n-1)')} AS posterior_std, {R('(exp(2*(z-h))-1)/(exp(2*(z-h))+1)')} AS ci_lower, {R('(exp(2*(z+h))-1)/(exp(2*(z+h))+1)')} AS ci_upper FROM z")
def _(spark, d):
    return bayesian.bayesian_correlation(users(spark, d), "a", "b").select("posterior_mean", "posterior_std", "ci_lower", "ci_upper")


@query("bayes_anova_factor", ANOVA_S.format(g="event_type", v="value", f="events") + f", b AS (SELECT ssb/(ssb+ssw) eta, -0.5*((d1+d2+1)*ln(ssw/(ssb+ssw))+d1*ln(d1+d2+1)) e FROM s) SELECT {R('eta', 8)} AS posterior_mean, {R(CLIP, 10)} AS bf10 FROM b", 10)
def _(spark, d):
    return bayesian.bayesian_anova(t(spark, d, "events"), "value", "event_type").select(F.round("posterior_mean", 8).alias("posterior_mean"), "bf10")


@query("bayes_regression_factor", f"WITH b AS (SELECT regr_r2(value,user_id) r2, -0.5*(count(*)*ln(1-regr_r2(value,user_id))+ln(count(*))) e FROM events) SELECT {R('r2', 8)} AS posterior_mean, {R(CLIP, 8)} AS bf10 FROM b", 8)
def _(spark, d):
    return bayesian.bayesian_regression(t(spark, d, "events"), "value", ["user_id"]).select("posterior_mean", "bf10")


@query("bayes_shadow")
def _(spark, d):
    r = bayesian.bayes_factor_shadow(2.5, 40)
    return table(spark, [(r["bf10"], r["bf01"], r["bf_label"])], "bf10 double, bf01 double, bf_label string")


# --- exploratory ------------------------------------------------------------------------------------------

def between(f: str) -> str:
    return f"SELECT '{f}' factor, sum(n*pow(m-(SELECT avg(l_quantity) FROM lineitem),2))/(count(*)-1) v, count(*) k FROM (SELECT {f}, count(*)+0.0 n, avg(l_quantity) m FROM lineitem GROUP BY 1)"


@query("multi_vari_shares", f"WITH f AS ({between('l_returnflag')} UNION ALL {between('l_linestatus')}), w AS (SELECT var_samp(l_quantity) t FROM lineitem) SELECT factor, {R('v')} AS variance, {R('100*v/t')} AS pct_contribution FROM (SELECT factor, v FROM f UNION ALL SELECT 'Within', greatest(0.0, (SELECT t FROM w)-(SELECT sum(v) FROM f))), w")
def _(spark, d):
    return exploratory.multi_vari(t(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]).select("factor", "variance", "pct_contribution")


@query("pca_two", f"WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) r FROM lineitem) SELECT CAST(k AS BIGINT) AS component, {R('e')} AS eigenvalue, {R('e/2')} AS variance_explained FROM (SELECT 1 k, 1+r e FROM r UNION ALL SELECT 2, 1-r FROM r)")
def _(spark, d):
    return exploratory.pca(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("component", "eigenvalue", "variance_explained")


@query("hotelling_t2", f"WITH s AS (SELECT count(*)+0.0 n, var_samp(l_quantity) a, covar_samp(l_quantity,l_discount) b, var_samp(l_discount) c, avg(l_quantity)-25 x, avg(l_discount)-0.05 y FROM lineitem), h AS (SELECT n, n*(c*x*x-2*b*x*y+a*y*y)/(a*c-b*b) t2 FROM s) SELECT {R('t2', 4)} AS t2_statistic, {R('(n-2)/(2*(n-1))*t2', 4)} AS f_statistic FROM h", 4)
def _(spark, d):
    return exploratory.hotelling_t2_one_sample(t(spark, d, "lineitem"), ["l_quantity", "l_discount"], [25.0, 0.05]).select("t2_statistic", "f_statistic")


@query("manova_wilks", f"WITH g AS (SELECT count(*)*var_pop(l_quantity) a, count(*)*covar_pop(l_quantity,l_discount) b, count(*)*var_pop(l_discount) c FROM lineitem GROUP BY l_returnflag), w AS (SELECT sum(a) a, sum(b) b, sum(c) c FROM g), s AS (SELECT count(*)+0.0 n, count(*)*var_pop(l_quantity) a, count(*)*covar_pop(l_quantity,l_discount) b, count(*)*var_pop(l_discount) c FROM lineitem), l AS (SELECT n, (w.a*w.c-w.b*w.b)/(s.a*s.c-s.b*s.b) l FROM w, s) SELECT {R('l', 8)} AS wilks_lambda, {R('(1-sqrt(l))/sqrt(l)*(n-4)/2')} AS f_statistic, {R('2*(n-4)')} AS df2 FROM l", 8)
def _(spark, d):
    r = exploratory.one_way_manova(t(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag")
    return r.select("wilks_lambda", F.round("f_statistic", 6).alias("f_statistic"), "df2")


# --- power and plans --------------------------------------------------------------------------------------

PROP_N = f"WITH h AS (SELECT 2*abs(asin(sqrt(0.6))-asin(sqrt(0.5))) h), n AS (SELECT h, ceil(pow(({Z975}+{Z80})/h,2)) n FROM h), z AS (SELECT n, h, h*sqrt(n)-{Z975} z FROM n), a AS ({simpson('z', 'n, h, z', 'abs(z)', N_DENS, 'area')})"


@query("power_proportion_n", PROP_N + f" SELECT CAST(n AS BIGINT) AS sample_size, {R('0.5+area', 5)} AS power, {R('h')} AS effect_size FROM a")
def _(spark, d):
    return power.power_proportion(spark, 0.6, p0=0.5, power=0.8).select("sample_size", F.round("power", 5).alias("power"), "effect_size")


@query("power_equivalence_n", f"WITH n AS (SELECT ceil(2*pow(({Z80}+{Z95})/0.5,2)) n), z AS (SELECT n, 0.5*sqrt(n/2)-{Z95} z FROM n), a AS ({simpson('z', 'n, z', 'abs(z)', N_DENS, 'area')}) SELECT CAST(n AS BIGINT) AS sample_size, {R('0.5+sign(z)*area')} AS power FROM a")
def _(spark, d):
    return power.power_equivalence(spark, 0.0, 0.5, power=0.8).select("sample_size", "power")


# chi-square with 4 degrees of freedom, critical value 9.487729036781154: a Poisson mixture of central laws of even degrees
CHI = "WITH n AS (SELECT i n, 0.09*i/2 l FROM generate_series(10, 400, 5) g(i)), c AS (SELECT j, sum(exp(-4.743864518390577+i*ln(4.743864518390577)-lgamma(i+1))) FILTER (i <= j+1) sf FROM generate_series(0, 120) a(j), generate_series(0, 121) b(i) GROUP BY 1), p AS (SELECT n, sum(exp(-l+j*ln(l)-lgamma(j+1))*sf) p FROM n, c GROUP BY 1)"


@query("power_chi2_n", CHI + f" SELECT CAST(n AS BIGINT) AS sample_size, {R('p')} AS power FROM p WHERE p >= 0.8 ORDER BY n LIMIT 1")
def _(spark, d):
    return power.power_chi_square(spark, 0.3, 4, power=0.8).select("sample_size", "power")


# F with 2 degrees of freedom above has a closed quantile; the noncentral law is a Poisson mixture of betas with a whole parameter
FPOW = "WITH n AS (SELECT 3*i n, i k, (3*i-3)/2.0 b, 0.0625*3*i/2 l, 1-pow(0.05, 2.0/(3*i-3)) x FROM generate_series(2, 120) g(i)), c AS (SELECT k, l, j, pow(1-x,b)*sum(exp(lgamma(b+i)-lgamma(b)-lgamma(i+1)+i*ln(x))) FILTER (i <= j) sf FROM n, generate_series(0, 60) a(j), generate_series(0, 60) d(i) GROUP BY k, l, j, x, b), p AS (SELECT k, sum(exp(-l+j*ln(l)-lgamma(j+1))*sf) p FROM c GROUP BY 1)"


@query("power_anova_n", FPOW + f" SELECT CAST(k AS BIGINT) AS sample_size, {R('p', 5)} AS power FROM p WHERE p >= 0.8 ORDER BY k LIMIT 1", 5)
def _(spark, d):
    return power.power_anova(spark, 0.25, 3, power=0.8).select("sample_size", "power")


# t with 30 degrees of freedom, 97.5 % quantile 2.0422724563012373: its square is F(1, 30); betas with a whole second parameter
TPOW = "WITH q AS (SELECT pow(2.0422724563012373,2)/(pow(2.0422724563012373,2)+30) x, 0.25*31/2 l), c AS (SELECT l, j, 1-pow(x,0.5+j)*sum(exp(lgamma(0.5+j+i)-lgamma(0.5+j)-lgamma(i+1)+i*ln(1-x))) sf FROM q, generate_series(0, 60) a(j), generate_series(0, 14) b(i) GROUP BY l, j, x)"


@query("power_t_at_31", TPOW + f" SELECT {R('sum(exp(-l+j*ln(l)-lgamma(j+1))*sf)', 5)} AS power FROM c", 5)
def _(spark, d):
    return power.power_t_test(spark, 0.5, n=31).select("power")


@query("power_z_at_31", ORACLES["power_t_at_31"], 5)
def _(spark, d):
    return power.power_z_test(spark, 0.5, n=31).select("power")


@query("sample_size_ci", f"SELECT CAST(ceil(pow({Z975},2)*4/0.09) AS BIGINT) AS n_mean, CAST(ceil(pow({Z975},2)*0.21/0.0025) AS BIGINT) AS n_share")
def _(spark, d):
    return table(spark, [(power.sample_size_for_ci(0.3, std=2.0), power.sample_size_for_ci(0.05, proportion=0.3))], "n_mean long, n_share long")


@query("sample_size_tolerance")
def _(spark, d):
    return table(spark, [(power.sample_size_tolerance(),)], "n long")


BINOM = "sum(exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln({p})+(n-i)*ln(1-{p}))) FILTER (i <= k)"


@query("attribute_plan_n", f"WITH c AS (SELECT k, n, {BINOM.format(p='0.05')} b, {BINOM.format(p='0.01')} a FROM generate_series(0, 12) u(k), generate_series(1, 400) v(n), generate_series(0, 12) w(i) WHERE n > k AND i <= n GROUP BY 1,2), f AS (SELECT k, min(n) n FROM c WHERE b <= 0.1 GROUP BY 1) SELECT CAST(n AS BIGINT) AS sample_size, CAST(k AS BIGINT) AS acceptance_number, {R('1-a')} AS producer_risk, {R('b')} AS consumer_risk FROM f JOIN c USING (k, n) WHERE a >= 0.95 ORDER BY n LIMIT 1")
def _(spark, d):
    return quality.attribute_plan(spark).select("sample_size", "acceptance_number", "producer_risk", "consumer_risk")


@query("variable_plan_n", f"WITH n AS (SELECT ceil(pow(({Z95}+{Z90})/({Z99}-{Z95}),2)) n) SELECT CAST(n AS BIGINT) AS sample_size, {R(f'{Z99}-{Z95}/sqrt(n)')} AS k_value FROM n")
def _(spark, d):
    return quality.variable_plan(spark).select("sample_size", "k_value")


@query("nonnormal_quantiles", f"WITH q AS (SELECT quantile_cont(value,0.00135) lo, median(value) m, quantile_cont(value,0.99865) hi, avg(CASE WHEN value < 0 OR value > 200 THEN 1.0 ELSE 0.0 END) o FROM events) SELECT {R('200/(hi-lo)', 5)} AS cnp, {R('least((200-m)/(hi-m), m/(m-lo))', 5)} AS cnpk, {R('m', 5)} AS median, {R('lo', 5)} AS p_low, {R('hi', 5)} AS p_high, {R('o*1e6', 3)} AS ppm_out FROM q", 5)
def _(spark, d):
    return quality.nonnormal_capability(t(spark, d, "events"), "value", 0.0, 200.0).select("cnp", "cnpk", "median", "p_low", "p_high", F.round("ppm_out", 3).alias("ppm_out"))


ORACLES["process_decision"] = f"WITH p AS (SELECT i/199.0 p FROM generate_series(0, 199) g(i)), c AS (SELECT p, p*500 a, (1-p)*100+p*80 b, (1-p)*120+p*150 c FROM p) SELECT {R('p')} AS p_shift, {R('a')} AS cost_continue, {R('b')} AS cost_investigate, {R('c')} AS cost_adjust, CASE WHEN a <= b AND a <= c THEN 'Continue' WHEN b <= c THEN 'Investigate' ELSE 'Adjust' END AS action FROM c"
ORACLES["acceptance_decision"] = f"WITH p AS (SELECT i*0.002 p FROM generate_series(0, 100) g(i)), c AS (SELECT p, p*50000 a, 200.0 b, 500+p*5000 c FROM p) SELECT {R('p')} AS defect_rate, {R('a')} AS cost_accept, {R('b')} AS cost_reject, {R('c')} AS cost_screen, CASE WHEN a <= b + 1e-9 AND a <= c THEN 'accept' WHEN b <= c THEN 'reject' ELSE 'screen' END AS action FROM c"
ORACLES["cost_of_quality"] = f"WITH x AS (SELECT 0.1+i*4.9/49 x FROM generate_series(0, 49) g(i)) SELECT {R('10*x')} AS prevention, {R('50*pow(0.5, x-1)')} AS failure, {R('10*x+50*pow(0.5, x-1)+5')} AS total FROM x"


# --- reliability ------------------------------------------------------------------------------------------

KM = "WITH e AS (SELECT l_quantity tm, count(*) FILTER (l_linestatus='F') d, count(*) n FROM lineitem GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY tm DESC) ar FROM e), f AS (SELECT tm, CASE WHEN d=ar THEN 0.0 ELSE exp(sum(ln(CASE WHEN d=ar THEN 1.0 ELSE 1-d*1.0/ar END)) OVER (ORDER BY tm)) END s FROM r WHERE d > 0), c AS (SELECT 0.0 tm, 1.0 s UNION ALL SELECT tm, s FROM f), l AS (SELECT *, lead(tm) OVER (ORDER BY tm)-tm w FROM c)"
ORACLES["survival_summary"] = KM + f" SELECT {R('min(tm) FILTER (s <= 0.5)')} AS median_survival, {R('sum(w*s)')} AS mean_survival, (SELECT CAST(sum(d) AS BIGINT) FROM e) AS n_events, (SELECT CAST(sum(n-d) AS BIGINT) FROM e) AS n_censored, (SELECT CAST(sum(n) AS BIGINT) FROM e) AS n_total FROM l"

LOGRANK = "WITH e AS (SELECT l_quantity tm, count(*) FILTER (l_linestatus='F') d, count(*) FILTER (l_linestatus='F' AND l_returnflag='A') d1, count(*) x, count(*) FILTER (l_returnflag='A') x1 FROM lineitem WHERE l_returnflag IN ('A','R') GROUP BY 1), r AS (SELECT d+0.0 d, d1+0.0 d1, sum(x) OVER (ORDER BY tm DESC)+0.0 n, sum(x1) OVER (ORDER BY tm DESC)+0.0 n1 FROM e), s AS (SELECT sum(d1) o1, sum(d*n1/n) e1, sum(d) o, pow(sum(d1)-sum(d*n1/n),2)/sum(CASE WHEN n > 1 THEN n1/n*(1-n1/n)*d*(n-d)/(n-1) ELSE 0 END) chi FROM r WHERE d > 0)"


@query("logrank_all", LOGRANK + f", z AS (SELECT *, sqrt(chi) z FROM s), a AS ({simpson('z', 'o1, e1, o, chi, z', 'z', N_DENS, 'area')}) SELECT {R('chi')} AS chi_square, {R('1-2*area')} AS p_value, {R('o1')} AS observed1, {R('e1', 4)} AS expected1, {R('o-o1')} AS observed2, {R('o-e1', 4)} AS expected2 FROM a")
def _(spark, d):
    r = reliability.log_rank_test(lifetimes(spark, d).filter("g IN ('A','R')"), "time", "event", "g")
    at = lambda c, i: F.col(c)[i]
    return r.select("chi_square", "p_value", at("observed", 0).alias("observed1"), F.round(at("expected", 0), 4).alias("expected1"), at("observed", 1).alias("observed2"), F.round(at("expected", 1), 4).alias("expected2"))


WEIB = "SELECT k-(s1/s0-1/k-(SELECT avg(lx) FROM d))/(s2/s0-pow(s1/s0,2)+1/(k*k)) FROM (SELECT max(k) k, sum(exp(k*lx)) s0, sum(exp(k*lx)*lx) s1, sum(exp(k*lx)*lx*lx) s2 FROM d, {prev})"


@query("weibull_mle", f"WITH d AS MATERIALIZED (SELECT ln(value) lx FROM events WHERE value > 0), {newton('SELECT 1.0', WEIB, 'k', 12)} SELECT {R('max(k)', 5)} AS shape, {R('pow(avg(exp(k*lx)), 1/max(k))', 4)} AS scale FROM d, it12", 5)
def _(spark, d):
    return reliability.weibull_fit(t(spark, d, "events"), "value").select("shape", F.round("scale", 4).alias("scale"))


COX = "SELECT max(b)+sum(dx-d*s1/s0)/sum(d*(s2/s0-pow(s1/s0,2))) FROM (SELECT b, d, dx, sum(r0) OVER w s0, sum(r1) OVER w s1, sum(r2) OVER w s2 FROM (SELECT tm, max(b) b, sum(d) d, sum(d*x) dx, sum(n*exp(b*x)) r0, sum(n*x*exp(b*x)) r1, sum(n*x*x*exp(b*x)) r2 FROM g, {prev} GROUP BY tm) WINDOW w AS (ORDER BY tm DESC)) WHERE d > 0"


@query("cox_coefficient", f"WITH g AS MATERIALIZED (SELECT l_quantity tm, l_discount x, count(*)+0.0 n, count(*) FILTER (l_linestatus='F')+0.0 d FROM lineitem GROUP BY 1,2), {newton('SELECT 0.0', COX, 'b', 7)} SELECT {R('b', 5)} AS coefficient, {R('exp(b)', 5)} AS hazard_ratio FROM it7", 5)
def _(spark, d):
    return reliability.cox_ph(lifetimes(spark, d), "time", "event", ["l_discount"]).select("coefficient", "hazard_ratio")


@query("cox_concordance", f"WITH g AS MATERIALIZED (SELECT l_quantity tm, l_discount x, count(*)+0.0 n, count(*) FILTER (l_linestatus='F')+0.0 d FROM lineitem GROUP BY 1,2), {newton('SELECT 0.0', COX, 'b', 7)} SELECT {R('sum(p.d*q.n*CASE WHEN b*p.x > b*q.x THEN 1.0 WHEN p.x = q.x THEN 0.5 ELSE 0.0 END)/sum(p.d*q.n)')} AS concordance FROM g p JOIN g q ON p.tm < q.tm, it7")
def _(spark, d):
    return reliability.cox_ph(lifetimes(spark, d), "time", "event", ["l_discount"]).select("concordance")


@query("hazard_exponential", f"SELECT p_partkey, {R('1/20.0')} AS hazard FROM part")
def _(spark, d):
    return reliability.hazard_function(t(spark, d, "part"), "p_size", 1.0, 20.0, "exponential").select("p_partkey", "hazard")


# --- series -----------------------------------------------------------------------------------------------

TWO_HOURLY = "h AS (SELECT date_trunc('hour', ts) k, sum(value) v, count(*)+0.0 c FROM events GROUP BY 1), s AS MATERIALIZED (SELECT v, c, row_number() OVER (ORDER BY k)-1 pos, count(*) OVER () n FROM h)"


@query("ccf_lags", "WITH " + TWO_HOURLY + f", z AS MATERIALIZED (SELECT pos, (v-avg(v) OVER ())/stddev_pop(v) OVER () x, (c-avg(c) OVER ())/stddev_pop(c) OVER () y FROM s) SELECT CAST(k AS BIGINT) AS lag, {R('avg(a.x*b.y)')} AS ccf FROM generate_series(-10, 10) g(k), z a, z b WHERE b.pos = a.pos + k GROUP BY 1")
def _(spark, d):
    return timeseries.cross_correlation(hourly(spark, d), "v", "c", ["ts"], 10).select("lag", "ccf")


@query("granger_one", "WITH " + TWO_HOURLY + f", l AS (SELECT c y, lag(c) OVER (ORDER BY pos) a, lag(v) OVER (ORDER BY pos) b FROM s), m AS (SELECT count(*)+0.0 n, var_pop(y) yy, var_pop(a) aa, var_pop(b) bb, covar_pop(a,b) ab, covar_pop(a,y) ay, covar_pop(b,y) by_ FROM l WHERE a IS NOT NULL), e AS (SELECT n, n*(yy-ay*ay/aa) r, n*(yy-(bb*ay*ay-2*ab*ay*by_+aa*by_*by_)/(aa*bb-ab*ab)) u FROM m) SELECT {R('(r-u)/(u/(n-3))', 4)} AS f_statistic, CAST(n-3 AS BIGINT) AS df2 FROM e", 4)
def _(spark, d):
    return timeseries.granger_causality(hourly(spark, d), "v", "c", ["ts"], 1).select("f_statistic", "df2")


KPSS = "WITH " + HOURLY + ", e AS MATERIALIZED (SELECT pos, v-m e, n+0.0 n FROM s), g AS MATERIALIZED (SELECT a.pos-b.pos k, sum(a.e*b.e) g, max(a.n) n FROM e a JOIN e b ON a.pos >= b.pos AND a.pos-b.pos <= 200 GROUP BY 1), c AS (SELECT max(g) FILTER (k=0)/max(n)+sum(g/(n/2)) FILTER (k BETWEEN 1 AND floor(pow(n,2.0/9))) s0, sum(k*g/(n/2)) FILTER (k BETWEEN 1 AND floor(pow(n,2.0/9))) s1, max(n) n FROM g), b AS (SELECT floor(1.1447*pow(pow(s1/s0,2),1.0/3)*pow(n,1.0/3)) b FROM c), l AS (SELECT sum(CASE WHEN k=0 THEN g WHEN k <= b THEN 2*(1-k/(b+1))*g ELSE 0 END) l, max(n) n, max(b) b FROM g, b), r AS (SELECT sum(c*c) q FROM (SELECT sum(e) OVER (ORDER BY pos) c FROM e))"


@query("kpss_statistic", KPSS + f" SELECT {R('q/(n*n)/(l/n)', 5)} AS statistic, CAST(b AS BIGINT) AS lags FROM l, r", 5)
def _(spark, d):
    return timeseries.kpss_test(hourly(spark, d), "v", ["ts"]).select("statistic", "lags")


SHIFT = "SELECT value + CASE WHEN event_id*2 > (SELECT max(event_id) FROM events) THEN 30.0 ELSE 0.0 END v, row_number() OVER (ORDER BY ts, event_id) t, count(*) OVER ()+0.0 n FROM events"


def shifted(spark, d):
    e = t(spark, d, "events")
    top = e.agg(F.max("event_id").alias("_top"))
    return e.crossJoin(F.broadcast(top)).withColumn("value", F.col("value") + F.when(F.col("event_id") * 2 > F.col("_top"), 30.0).otherwise(0.0)).drop("_top")


@query("adwin_shift", f"WITH s AS ({SHIFT}), b AS (SELECT min(v) lo, max(v)-min(v) span, sum(v) sv FROM s), c AS (SELECT t, n, sum((v-lo)/span) OVER (ORDER BY t) c, (sv-n*lo)/span total FROM s, b), x AS (SELECT *, sqrt(0.5*ln(4*n/0.002)/least(t,n-t)) eps FROM c WHERE t >= greatest(10,floor(n/20)) AND t < n-greatest(10,floor(n/20))), y AS (SELECT *, abs(c/t-(total-c)/(n-t))-eps e FROM x ORDER BY e DESC, t LIMIT 1) SELECT e > 0 AS detected, CAST(t AS BIGINT) AS change_idx, {R('c/t*span+lo', 4)} AS mean_before, {R('(total-c)/(n-t)*span+lo', 4)} AS mean_after, CAST(n AS BIGINT) AS window_length FROM y, b")
def _(spark, d):
    r = monitoring.adwin_detect(shifted(spark, d), "value", ["ts", "event_id"])
    return r.select("detected", "change_idx", F.round("mean_before", 4).alias("mean_before"), F.round("mean_after", 4).alias("mean_after"), "window_length")


@query("page_hinkley_shift", f"WITH s AS ({SHIFT}), z AS (SELECT t, (v-avg(v) OVER ())/(stddev_pop(v) OVER ()+1e-12) z FROM s), r AS (SELECT t, z-avg(z) OVER (ORDER BY t)-0.005 d FROM z), c AS (SELECT t, sum(d) OVER (ORDER BY t) c FROM r), m AS (SELECT t, c, least(0.0, min(c) OVER (ORDER BY t)) mn FROM c), h AS (SELECT *, c-mn > 50 hit FROM m), p AS (SELECT * FROM h ORDER BY hit DESC, CASE WHEN hit THEN t ELSE -t END LIMIT 1) SELECT hit AS detected, CASE WHEN hit THEN CAST(t-1 AS BIGINT) END AS change_idx, {R('c', 3)} AS cumulative_value, {R('mn', 3)} AS min_cumulative FROM p", 3)
def _(spark, d):
    return monitoring.page_hinkley_detect(shifted(spark, d), "value", ["ts", "event_id"]).select("detected", "change_idx", "cumulative_value", "min_cumulative")


QUERIES["changepoints_shift"] = lambda spark, d: rounded(timeseries.pelt(shifted(spark, d).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("v")), "v", ["ts"]))


# --- conformal, corrections, router -----------------------------------------------------------------------

@query("conformal_sets", "WITH n AS (SELECT count(*) n, count(*) FILTER (quality=1) n1 FROM labels), q AS (SELECT CASE WHEN n1 >= least(n, ceil((n+1)*0.9)) THEN 0.25 ELSE 0.75 END q FROM n) SELECT CAST(CASE WHEN q < 0.5 THEN 1 ELSE 2 END AS BIGINT) AS size, CAST((SELECT n FROM n) AS BIGINT) AS n FROM q")
def _(spark, d):
    rows = t(spark, d, "labels").withColumn("probability", F.array(F.lit(0.25), F.lit(0.75)))
    c = monitoring.ConformalClassifier().calibrate(rows, "quality", "probability", (0.1,))
    return c.predict_sets(rows, "probability", 0.1).groupBy(F.size("prediction_set").cast("long").alias("size")).agg(F.count("*").alias("n"))


class _Constant:
    """Stands for a fitted model: predicts 50."""

    def transform(self, df):
        return df.withColumn("prediction", F.lit(50.0))


@query("conformal_model", ORACLES["conformal"])
def _(spark, d):
    c = monitoring.compute_conformal(_Constant(), t(spark, d, "events"), "value", "regression", (0.1,))
    return table(spark, [(c.qhats["0.1"],)], "qhat double")


@query("fdr_count", "WITH p AS (SELECT (p_retailprice-floor(p_retailprice/100)*100)/100*0.2+0.0001 p FROM part), r AS (SELECT p, rank() OVER (ORDER BY p)+count(*) OVER (PARTITION BY p)-1 k, count(*) OVER () m FROM p), c AS (SELECT coalesce(max(p) FILTER (p <= 0.05*k/m), -1) c FROM r) SELECT CAST(count(*) FILTER (p <= c) AS BIGINT) AS discoveries, CAST(count(*) AS BIGINT) AS tests FROM r, c")
def _(spark, d):
    last = intelligence.fdr_summary(pvalues(spark, d), "k", "p").splitlines()[-1].split()
    return table(spark, [(int(last[0]), int(last[2]))], "discoveries long, tests long")


@query("profile_counts", "WITH q AS (SELECT event_type, quantile_cont(value,0.25) a, quantile_cont(value,0.75) b FROM events GROUP BY 1) " + f"SELECT event_type AS \"group\", CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT value) AS BIGINT) AS n_distinct, {R('min(value)')} AS min, CAST(sum(CASE WHEN value < a-1.5*(b-a) OR value > b+1.5*(b-a) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers FROM events JOIN q USING (event_type) GROUP BY 1")
def _(spark, d):
    return intelligence.profile_data(t(spark, d, "events"), "value", "event_type").select("group", "n", "n_distinct", "min", "n_outliers")


KRUSKAL = RANKS.format(w="")[5:] + ", kg AS (SELECT g, count(*)+0.0 n, sum(r) rs FROM r GROUP BY 1), kh AS (SELECT (12/(sum(n)*(sum(n)+1))*sum(rs*rs/n)-3*(sum(n)+1))/(1-(SELECT sum(t*t-1.0) FROM r)/(pow(sum(n),3)-sum(n))) h FROM kg)"


@query("methods_side_by_side", ANOVA_S.format(g="event_type", v="value", f="events") + ", " + KRUSKAL + f" SELECT kind, {R('x', 5)} AS statistic FROM (SELECT 'parametric' kind, f x FROM f UNION ALL SELECT 'rank', h FROM kh)", 5)
def _(spark, d):
    return intelligence.compare_methods(t(spark, d, "events"), "value", "event_type").select("kind", "statistic")


@query("methods_paired", f"WITH d AS (SELECT a-b d FROM ({USERS}) WHERE a IS NOT NULL AND b IS NOT NULL), r AS (SELECT d, rank() OVER (ORDER BY abs(d))+(count(*) OVER (PARTITION BY abs(d))-1)/2.0 r FROM d WHERE d <> 0) SELECT kind, {R('x')} AS statistic FROM (SELECT 'parametric' kind, avg(d)/(stddev_samp(d)/sqrt(count(*))) x FROM d UNION ALL SELECT 'rank', least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) FROM r)")
def _(spark, d):
    return intelligence.compare_methods(users(spark, d), "a", "", paired_with="b").select("kind", "statistic")


@query("explanations")
def _(spark, d):
    r = parametric.one_way(t(spark, d, "events"), "value", "event_type").first().asDict()
    said, found = intelligence.explain(r), intelligence.validate_conclusion(r)
    rows = [("explain", said["summary"]), ("validate", found["overall"]), *(("next", x["action"]) for x in intelligence.recommend_next(r))]
    return table(spark, rows, "kind string, says string")


@query("calibration")
def _(spark, d):
    return calibrate(spark)


@query("samples")
def _(spark, d):
    made = {"exponential": core.sample_exponential(spark, 2.0, 100, 1), "weibull": core.sample_weibull(spark, 2.0, 1.0, 100, 1), "uniform": core.sample_uniform(spark, 0.0, 1.0, 100, 1), "poisson": core.sample_poisson(spark, 5.0, 100, 1)}
    out = None
    for name, df in made.items():
        one = df.agg(F.lit(name).alias("family"), F.count("*").alias("n"), F.min("value").alias("min"))
        out = one if out is None else out.union(one)
    return out.union(table(spark, [("seeded", 1, float(core.seeded_rng(3).random()))], "family string, n long, min double"))
