"""Registered metocean queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import corrections, physics, quadrature
from tidemark.operators import conditional, currents, describe, exceedance, extremes, hierarchical, joins, joint, profile, spectra, trend, verify, water, windows
from tidemark.plans.base import ALL, DAILY, HOURLY, QUERIES, SEA, SECTOR, SQL, _daily, _events, _hourly, _line, _orders, _sea, _stats_sql, _t, query
from tidemark.sources.text import table_to_csv
from tidemark.streaming.peaks import streaming_peaks

@query("""WITH b AS (SELECT min(l_quantity) qa, max(l_quantity) qb, min(l_extendedprice) pa, max(l_extendedprice) pb, count(*) t FROM lineitem),
o AS (SELECT floor(qa / 5) * 5 qo, floor(pa / 10000) * 10000 po, b.* FROM b),
n AS (SELECT *, greatest(ceil((qb + 5 - qo) / 5) - 1, 1) qn, greatest(ceil((pb + 10000 - po) / 10000) - 1, 1) pn FROM o),
c AS (SELECT (qo + least(floor((l_quantity - qo) / 5), qn - 1) * 5)::DOUBLE x_from, (po + least(floor((l_extendedprice - po) / 10000), pn - 1) * 10000)::DOUBLE y_from, t FROM lineitem, n)
SELECT x_from, y_from, count(*) AS n, round(100.0 * count(*) / any_value(t), 6) AS pct FROM c GROUP BY CUBE (x_from, y_from)""")
def scatter_diagram(spark, d):
    return describe.scatter_diagram(_line(spark, d), "l_quantity", 5, "l_extendedprice", 10000)


@query(_stats_sql("month(l_shipdate)::INT AS month", "(1), ()", "lineitem", "l_quantity", ALL).replace("GROUPING SETS ((1), ())", "GROUPING SETS ((month), ())"))
def monthly_percentiles(spark, d):
    return describe.by_calendar(_line(spark, d), "l_shipdate", "l_quantity")


@query(_stats_sql("year(l_shipdate)::INT AS year", "(year), ()", "lineitem", "l_extendedprice", ALL))
def yearly_statistics(spark, d):
    return describe.by_calendar(_line(spark, d), "l_shipdate", "l_extendedprice", "year")


@query(_stats_sql("dayofyear(l_shipdate)::INT AS dayofyear", "(dayofyear)", "lineitem", "l_extendedprice", "p5 mean p99 max"))
def daily_percentiles(spark, d):
    return describe.by_calendar(_line(spark, d), "l_shipdate", "l_extendedprice", "dayofyear", ("5%", "mean", "99%", "max"), total=False)


@query(_stats_sql("hour(ts)::INT AS hour", "(hour), ()", "events", "value", ALL))
def hourly_percentiles(spark, d):
    return describe.by_calendar(_events(spark, d), "ts", "value", "hour")


def _maxima_sql(key: str, name: str, table: str, ts: str, x: str) -> str:
    stats = "round(min(x), 6) AS min, round(avg(x), 6) AS mean, round(max(x), 6) AS max"
    return f"""WITH c AS (SELECT {key} AS {name}, max({x}) AS x FROM {table} GROUP BY year({ts}), {key}), y AS (SELECT max({x}) AS x FROM {table} GROUP BY year({ts}))
SELECT {name}, {stats} FROM c GROUP BY 1 UNION ALL SELECT NULL, {stats} FROM y"""


@query(_maxima_sql("month(l_shipdate)::INT", "month", "lineitem", "l_shipdate", "l_extendedprice"))
def monthly_min_mean_max(spark, d):
    return describe.period_maxima(_line(spark, d), "l_shipdate", "l_extendedprice")


@query(_maxima_sql(SECTOR.format(d="o_orderkey * 137.5"), "sector", "orders", "o_orderdate", "o_totalprice"))
def directional_min_mean_max(spark, d):
    return describe.period_maxima(_orders(spark, d), "o_orderdate", "o_totalprice", "dir")


@query(_stats_sql("month, sector", "(month, sector), (month), (sector), ()", f"(SELECT month(o_orderdate)::INT AS month, {SECTOR.format(d='o_orderkey * 137.5')} AS sector, o_totalprice FROM orders)", "o_totalprice", "count mean p50 p95 max"))
def monthly_directional_percentiles(spark, d):
    return describe.by_month_and_sector(_orders(spark, d), "o_orderdate", "o_totalprice", "dir", ("count", "mean", "50%", "95%", "max"))


@query(f"""WITH q AS (SELECT [quantile_cont(value, 0.4), quantile_cont(value, 0.6), quantile_cont(value, 0.8), quantile_cont(value, 0.99)] e, count(*) t FROM events)
SELECT {SECTOR.format(d='event_id * 137.5')} AS sector, len(list_filter(e, lambda x: x <= value))::INT AS level, count(*) AS n, round(100.0 * count(*) / any_value(t), 6) AS pct FROM events, q GROUP BY 1, 2""")
def rose(spark, d):
    return describe.rose(_events(spark, d), "value", "dir")


@query(_stats_sql("class", "(class), ()", "(SELECT floor(l_quantity)::INT AS class, l_extendedprice FROM lineitem)", "l_extendedprice", "count min p5 mean p95 max"))
def variable_sorted_by_bins(spark, d):
    return describe.sorted_by_bins(_line(spark, d), "l_extendedprice", "l_quantity")


@query("""WITH o AS (SELECT floor(min(l_quantity)) o FROM lineitem),
c AS (SELECT month(l_shipdate)::INT AS month, greatest(ceil((l_quantity - o) / 5.0) - 1, 0)::INT AS bin, count(*) n FROM lineitem, o GROUP BY 1, 2),
s AS (SELECT unnest(range(min(bin), max(bin) + 1))::INT AS bin FROM c), m AS (SELECT DISTINCT month FROM c),
f AS (SELECT m.month, s.bin, coalesce(n, 0) n FROM m CROSS JOIN s LEFT JOIN c ON c.month = m.month AND c.bin = s.bin),
p AS (SELECT month, bin, 100 * sum(n) OVER (PARTITION BY month ORDER BY bin) / sum(n) OVER (PARTITION BY month) AS pct FROM f)
SELECT month, (o + (bin + 1) * 5)::DOUBLE AS level, round(avg(pct), 6) AS pct FROM p, o GROUP BY GROUPING SETS ((month, level), (level))""")
def monthly_non_exceedance(spark, d):
    return exceedance.monthly_non_exceedance(_line(spark, d), "l_shipdate", "l_quantity", 5)


@query(f"""WITH c AS (SELECT {SECTOR.format(d='event_id * 137.5')} AS sector, greatest(ceil(value / 50.0) - 1, 0)::INT AS bin, count(*) n FROM events GROUP BY 1, 2),
s AS (SELECT unnest(range(min(bin), max(bin) + 1))::INT AS bin FROM c), m AS (SELECT DISTINCT sector FROM c),
f AS (SELECT m.sector, s.bin, coalesce(n, 0) n FROM m CROSS JOIN s LEFT JOIN c ON c.sector = m.sector AND c.bin = s.bin),
p AS (SELECT sector, ((bin + 1) * 50)::DOUBLE AS level, 100 * sum(n) OVER (PARTITION BY sector ORDER BY bin) / (SELECT count(*) FROM events) AS pct FROM f)
SELECT sector, level, round(sum(pct), 6) AS pct FROM p GROUP BY GROUPING SETS ((sector, level), (level))""")
def directional_non_exceedance(spark, d):
    return exceedance.directional_non_exceedance(_events(spark, d), "value", "dir", 50)


@query(f"""WITH x AS (SELECT * FROM {DAILY}), h AS (SELECT (epoch(max(ts)) - epoch(min(ts))) / (count(*) - 1) / 3600 AS step FROM x),
t AS (SELECT unnest([1000.0, 100000.0, 200000.0, 300000.0, 400000.0])::DOUBLE AS threshold)
SELECT year(ts)::INT AS year, threshold, round(count(*) FILTER (x < threshold) * any_value(step), 6) AS hours FROM x, h, t GROUP BY 1, 2""")
def hours_below(spark, d):
    return exceedance.hours_below(_daily(spark, d), "ts", "x", (1000, 100000, 200000, 300000, 400000))


@query("SELECT max(o_totalprice) AS hat, round(avg(o_totalprice), 6) AS msl, min(o_totalprice) AS lat FROM orders")
def tidal_levels(spark, d):
    return exceedance.tidal_levels(_orders(spark, d), "o_totalprice")


METRICS = "count(x) AS n, round(avg(y - x), 6) AS bias, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) ** 2)), 6) AS rmse, round(sqrt(avg((y - x) ** 2)) / avg(x), 6) AS si, round(corr(x, y), 6) AS corr"
PAIR = "(SELECT l_extendedprice AS x, l_quantity * 1500.0 AS y, l_returnflag, l_shipdate FROM lineitem)"


def _pair(spark, d):
    return _line(spark, d).select(F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 1500.0).alias("y"), "l_returnflag")


@query(f"SELECT {METRICS} FROM {PAIR}")
def error_metrics(spark, d):
    return verify.error_metrics(_pair(spark, d), "x", "y")


@query(f"SELECT l_returnflag, {METRICS} FROM {PAIR} GROUP BY 1")
def error_metrics_multiple(spark, d):
    return verify.error_metrics(_pair(spark, d), "x", "y", ["l_returnflag"])


@query(f"SELECT ((ceil(x / 10000) - 1 + 0.5) * 10000)::DOUBLE AS centre, {METRICS.replace('corr(x, y)', 'CASE WHEN isfinite(corr(x, y)) THEN corr(x, y) END')} FROM {PAIR} GROUP BY 1")
def error_metrics_binned(spark, d):
    return verify.binned_error_metrics(_pair(spark, d), "x", "y", 10000)


@query(f"SELECT round(stddev_pop(x), 6) AS std_obs, round(stddev_pop(y), 6) AS std_mod, round(corr(x, y), 6) AS corr, round(sqrt(var_pop(x) + var_pop(y) - 2 * covar_pop(x, y)), 6) AS crms FROM {PAIR}")
def taylor(spark, d):
    return verify.taylor(_pair(spark, d), "x", "y")


@query(f"SELECT p::INT AS percentile, round(qx[p], 6) AS observed, round(qy[p], 6) AS modelled FROM (SELECT quantile_cont(x, list_transform(range(1, 100), lambda i: i / 100)) qx, quantile_cont(y, list_transform(range(1, 100), lambda i: i / 100)) qy FROM {PAIR}), (SELECT unnest(range(1, 100)) p)".replace("list_transform(range(1, 100), lambda i: i / 100)", "[" + ", ".join(str(i / 100) for i in range(1, 100)) + "]"))
def quantile_pairs(spark, d):
    return verify.quantile_pairs(_pair(spark, d), "x", "y")


@query(f"""SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, round(avg(y) / avg(x), 6) AS mean_slope,
round((var_pop(y) - var_pop(x) + sqrt(var_pop(x) ** 2 - 2 * var_pop(x) * var_pop(y) + var_pop(y) ** 2 + 4 * covar_pop(x, y) ** 2)) / (2 * covar_pop(x, y)), 6) AS ev_slope, round(avg(y) - avg(x) * (var_pop(y) - var_pop(x) + sqrt(var_pop(x) ** 2 - 2 * var_pop(x) * var_pop(y) + var_pop(y) ** 2 + 4 * covar_pop(x, y) ** 2)) / (2 * covar_pop(x, y)), 6) AS ev_intercept FROM {PAIR}""")
def regression_lines(spark, d):
    return verify.regression_lines(_pair(spark, d), "x", "y")


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY ts) k, sum(CASE WHEN x < 200 THEN 1 ELSE 0 END) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS start FROM {HOURLY}),
w AS (SELECT ts, (min(CASE WHEN start THEN k END) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - k + 3) / 24.0 AS d FROM s)
SELECT month(ts)::INT AS month, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max FROM w WHERE d IS NOT NULL GROUP BY GROUPING SETS ((month), ())""")
def weather_window(spark, d):
    return windows.window_table(windows.waiting(_hourly(spark, d), "ts", F.col("x") < 200, 3, 1.0), "ts")


LIMITS = f"(SELECT ts, x, coalesce(sum((x <= 200)::INT) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 0) = 2 AND coalesce(sum((x <= 300)::INT) OVER (ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING), 0) = 3 AS feasible FROM {HOURLY})"


@query(f"SELECT ts::VARCHAR AS ts, feasible FROM {LIMITS}")
def limit_sequence(spark, d):
    return windows.limit_sequence(_hourly(spark, d), "ts", "x", [200] * 2 + [300] * 3).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "feasible")


@query(f"SELECT 'hour' AS part, hour(ts)::INT AS k, round(avg(feasible::INT), 6) AS p FROM {LIMITS} GROUP BY 2 UNION ALL SELECT 'month', k, round(avg(m), 6) FROM (SELECT year(ts) y, month(ts)::INT k, max(feasible::INT) m FROM {LIMITS} GROUP BY 1, 2) GROUP BY k")
def start_probability(spark, d):
    return windows.start_probability(windows.limit_sequence(_hourly(spark, d), "ts", "x", [200] * 2 + [300] * 3), "ts", "feasible")


AT = "strftime(peak_at, '%Y-%m-%d') AS peak_at"
MAXIMA = f"(SELECT year(ts)::INT AS year, arg_max(ts, (x, -epoch(ts))) AS peak_at, max(x) AS value FROM {DAILY} GROUP BY 1)"


def _day(df):
    return df.withColumn("peak_at", F.date_format("peak_at", "yyyy-MM-dd"))


@query(f"SELECT year, {AT}, value FROM {MAXIMA}")
def annual_maxima(spark, d):
    return _day(extremes.annual_maxima(_daily(spark, d), "ts", "x"))


@query(f"WITH x AS (SELECT * FROM {DAILY}), f AS (SELECT floor((epoch(ts) - (SELECT min(epoch(ts)) FROM x)) / (365.2425 * 86400))::BIGINT AS block, ts, x FROM x) SELECT block, strftime(arg_max(ts, (x, -epoch(ts))), '%Y-%m-%d') AS peak_at, max(x) AS value FROM f GROUP BY 1")
def block_maxima(spark, d):
    return _day(extremes.block_maxima(_daily(spark, d), "ts", "x"))


@query(f"SELECT min(value) AS threshold FROM {MAXIMA}")
def default_threshold(spark, d):
    return extremes.threshold(_daily(spark, d), "ts", "x")


POT = f"""(WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) > 172800 THEN 1 ELSE 0 END AS gap FROM {DAILY} WHERE x > 300000),
c AS (SELECT *, sum(gap) OVER (ORDER BY ts)::BIGINT AS cluster FROM g) SELECT cluster, count(*) AS n, arg_max(ts, (x, -epoch(ts))) AS peak_at, max(x) AS value FROM c GROUP BY 1)"""


@query(f"SELECT cluster, n, {AT}, value FROM {POT}")
def peaks_over_threshold(spark, d):
    return _day(extremes.peaks_over_threshold(_daily(spark, d), "ts", "x", 300000))


@query(f"SELECT year, value, round(row_number() OVER (ORDER BY value DESC) / (count(*) OVER () + 1), 9) AS probability, round((count(*) OVER () + 1) / (row_number() OVER (ORDER BY value DESC)), 6) AS period FROM {MAXIMA}")
def plotting_positions(spark, d):
    return extremes.plotting_positions(extremes.annual_maxima(_daily(spark, d), "ts", "x").drop("peak_at"), "value")


@query(f"WITH f AS (SELECT month(ts)::INT AS month, min(x) a, avg(x) - min(x) b FROM {DAILY} GROUP BY 1) SELECT month, p::DOUBLE AS p, round(a - b * ln(p::DOUBLE), 6) AS value FROM f, (SELECT unnest([0.1, 0.01, 0.001]) AS p)")
def exponential_return_values(spark, d):
    return extremes.exponential_return_values(_daily(spark, d).withColumn("month", F.month("ts")), "x", (0.1, 0.01, 0.001), ["month"])


@query(f"WITH f AS (SELECT stddev_samp(value) * sqrt(6) / pi() AS b, avg(value) AS m FROM {MAXIMA}) SELECT t::DOUBLE AS period, round(m - 0.5772156649015329 * b - b * ln(-ln(1 - 1 / t::DOUBLE)), 6) AS value FROM f, (SELECT unnest([5, 10, 50, 100]) AS t)")
def gumbel_moment_return_values(spark, d):
    return extremes.gumbel_moment_return_values(extremes.annual_maxima(_daily(spark, d), "ts", "x"), "value", (5, 10, 50, 100))


@query("SELECT month(l_shipdate)::INT AS month, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS var, round((avg(l_quantity ** 3) - 3 * avg(l_quantity) * avg(l_quantity ** 2) + 2 * avg(l_quantity) ** 3) / var_pop(l_quantity) ** 1.5, 6) AS skew FROM lineitem GROUP BY 1")
def weibull_moments(spark, d):
    return extremes.weibull_moments(_line(spark, d).withColumn("month", F.month("l_shipdate")), "l_quantity", ["month"])


def _fit(name):
    def run(spark, d):
        return extremes.return_values(extremes.annual_maxima(_daily(spark, d), "ts", "x").withColumn("value", F.col("value") / 1e5), "value", name, (2, 10, 50, 100))

    QUERIES[f"return_values_{name.lower()}"] = run


for _name in ("GUM", "GUM_L", "GEV", "Weibull_2P", "Weibull_3P", "LoNo", "EXP"):
    _fit(_name)


@query()
def return_values_pareto(spark, d):
    peaks = extremes.peaks_over_threshold(_daily(spark, d), "ts", "x", 300000).withColumn("over", F.col("value") / 1e5 - 3)
    return extremes.return_values(peaks, "over", "GP", (2, 10, 50, 100), 20.0)


@query()
def monthly_return_values(spark, d):
    keyed = _daily(spark, d).select((F.col("x") / 1e5).alias("x"), F.month("ts").alias("month"))
    return extremes.return_values(keyed, "x", "Weibull_3P", (1, 10, 100), 365.2422, ["month"])


@query()
def return_values_bootstrap(spark, d):
    return extremes.return_values(extremes.annual_maxima(_daily(spark, d), "ts", "x").withColumn("value", F.col("value") / 1e5), "value", "GUM", (10, 100), bootstrap=1000)


YEARLY = "(SELECT year(l_shipdate)::INT AS year, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1)"


@query(f"SELECT round(regr_slope(mean, year), 6) AS slope, round(regr_intercept(mean, year), 6) AS intercept, round(regr_r2(mean, year), 6) AS r2 FROM {YEARLY}")
def linear_trend(spark, d):
    return trend.linear_trend(_line(spark, d), "l_shipdate", "l_extendedprice")


@query(f"SELECT round(quantile_cont((b.mean - a.mean) / (b.year - a.year), 0.5), 6) AS theil_sen, round(avg(sign(b.mean - a.mean)), 6) AS kendall_tau FROM {YEARLY} a JOIN {YEARLY} b ON a.year < b.year")
def pair_trend(spark, d):
    return trend.pair_trend(_line(spark, d), "l_shipdate", "l_extendedprice")


LEVELS = {0.0: "l_quantity", 10.0: "l_discount", 20.0: "l_tax"}
LONG = "(SELECT month(l_shipdate)::INT AS month, unnest([0.0, 10.0, 20.0])::DOUBLE AS level, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem)"


@query(_stats_sql("level", "(level)", LONG, "value", "count mean std min p5 p50 p95 max"))
def profile_statistics(spark, d):
    return profile.profile_statistics(_line(spark, d), LEVELS, ("count", "mean", "std", "min", "5%", "50%", "95%", "max"))


@query(f"SELECT level, month, round(avg(value), 9) AS mean FROM {LONG} GROUP BY GROUPING SETS ((level, month), (level))")
def monthly_profile(spark, d):
    return profile.monthly_profile(_line(spark, d), "l_shipdate", LEVELS)


@query("""WITH s AS (SELECT [avg(l_quantity), avg(l_discount), avg(l_tax)] m, [stddev_pop(l_quantity), stddev_pop(l_discount), stddev_pop(l_tax)] s,
[[1, corr(l_quantity, l_discount), corr(l_quantity, l_tax)], [corr(l_quantity, l_discount), 1, corr(l_discount, l_tax)], [corr(l_quantity, l_tax), corr(l_discount, l_tax), 1]] r, [60.0, 0.2, 0.1] w FROM lineitem)
SELECT ((a - 1) * 10)::DOUBLE AS worst_level, ((b - 1) * 10)::DOUBLE AS level, round(CASE WHEN a = b THEN w[a] ELSE least(m[b] + r[a][b] * s[b] * (w[a] - m[a]) / s[a], w[b]) END::DOUBLE, 6) AS value
FROM s, (SELECT unnest([1, 2, 3]) a), (SELECT unnest([1, 2, 3]) b)""")
def conditional_profiles(spark, d):
    return profile.conditional_profiles(_line(spark, d), LEVELS, {0.0: 60.0, 10.0: 0.2, 20.0: 0.1})


CELLS = "(SELECT vec_id, label, (k // 8)::INT AS f, (k % 8)::INT AS d, greatest(e::DOUBLE, 0) AS e FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(len(embedding))) AS k FROM embeddings))"
DEGREES = [45.0 * d for d in range(8)]
RADIANS = [math.radians(d) for d in DEGREES]
FREQUENCIES = [round(0.05 * 1.1**f, 9) for f in range(8)]


def _cells(spark, d):
    return spectra.cells(_t(spark, d, "embeddings"), ["vec_id", "label"], "embedding", 8)


def _list(values, k: str) -> str:
    return f"([{', '.join(f'{v!r}::DOUBLE' for v in values)}])[{k} + 1]"


TRAPEZOID = _list(quadrature.trapezoid(RADIANS), "d")


@query(f"SELECT vec_id, f, round(sum(e * {TRAPEZOID}), 6) AS e FROM {CELLS} GROUP BY 1, 2")
def spectrum_1d(spark, d):
    return spectra.one_dimensional(_cells(spark, d), ["vec_id"], RADIANS)


@query(f"SELECT label, f, round(sum(e * {TRAPEZOID}) / count(*) FILTER (d = 0), 6) AS e FROM {CELLS} GROUP BY GROUPING SETS ((label, f), (f))")
def spectrum_mean(spark, d):
    return spectra.mean_spectrum(_cells(spark, d), ["label"], RADIANS)


AREA = f"{_list(quadrature.simpson(FREQUENCIES), 'f')} * {_list(quadrature.simpson(RADIANS), 'd')}"
CELL = f"e * {_list(quadrature.widths(FREQUENCIES), 'f')} * {_list(quadrature.widths(RADIANS), 'd')}"
PARAMETERS = f"""(SELECT vec_id, label, round(4 * sqrt(greatest(sum(e * {AREA}), 0)), 5) AS hm0, round(sum(e * {AREA}) / nullif(sum(e * {AREA} * {_list(FREQUENCIES, 'f')}), 0), 5) AS tm01,
round((degrees(atan2(sum({CELL} * sin(radians(d * 45.0))), sum({CELL} * cos(radians(d * 45.0))))) + 360) % 360, 5) AS dir,
round({_list(FREQUENCIES, 'arg_max(f, (e, -f, -d))')}, 6) AS fp, round({_list(DEGREES, 'arg_max(d, (e, -f, -d))')}, 6) AS pdir FROM {CELLS} GROUP BY 1, 2)"""


def _parameters(spark, d):
    return spectra.parameters(_cells(spark, d), ["vec_id", "label"], FREQUENCIES, DEGREES)


@query(f"SELECT * FROM {PARAMETERS}")
def spectrum_parameters(spark, d):
    return _parameters(spark, d)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hm0 DESC, vec_id)::INT AS rank FROM {PARAMETERS}) WHERE rank <= 3")
def spectrum_highest(spark, d):
    return spectra.highest(_parameters(spark, d), "vec_id", ["label"])


@query("""SELECT l_orderkey, l_linenumber, round(2 * pi() * hs / (9.81 * tz * tz), 6) AS steepness, round(tz, 6) AS tz, round(hs * (sqrt(ln(10800 / tz) / 2) + 0.2886 / sqrt(2 * ln(10800 / tz))), 6) AS hmax,
round(hs * (1 - 0.41 * 0.06 * (1 + 0.43 * hs / 10) * ln(10.0 / 60)), 6) AS gust
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 5 AS hs, (4 + 2 * sqrt(l_quantity / 5)) * (0.6673 + 0.05037 * 2.5 - 0.00623 * 2.5 ** 2 + 0.0003341 * 2.5 ** 3) AS tz FROM lineitem)""")
def wave_formulas(spark, d):
    hs = F.col("l_quantity") / 5
    tp = 4 + 2 * F.sqrt(hs)
    tz = physics.zero_crossing_period(tp)
    found = {"steepness": physics.steepness(hs, tz), "tz": tz, "hmax": physics.highest_wave(hs, tp), "gust": physics.gust(hs)}
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(n) for n, c in found.items()))


@query()
def jonswap_spectra(spark, d):
    sea = _line(spark, d).select((F.col("l_quantity") / 5).alias("hs")).distinct().withColumn("tp", 4 + 2 * F.sqrt("hs"))
    cells = sea.withColumn("f", F.explode(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i * 0.01)))
    return cells.withColumn("s", physics.jonswap(F.col("f"), F.col("hs"), F.col("tp"))).withColumn("crest", physics.crest(F.col("hs"), physics.mean_period(F.col("tp")), 100.0))


@query("""WITH a AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, max(o_totalprice) AS x FROM orders GROUP BY 1), b AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY 1)
SELECT strftime(a.ts, '%Y-%m-%d') AS ts, x, q AS q_1 FROM a LEFT JOIN b USING (ts)""")
def time_join(spark, d):
    other = _t(spark, d, "lineitem").groupBy(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.round(F.avg("l_quantity"), 6).alias("q"))
    return joins.time_join(_daily(spark, d), other, on="ts").withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


@query("SELECT s_suppkey, c_custkey FROM supplier, customer WHERE abs(s_acctbal - c_acctbal) < 5")
def band_join(spark, d):
    return joins.band_join(_t(spark, d, "supplier"), "s_acctbal", _t(spark, d, "customer"), "c_acctbal", 5.0).select("s_suppkey", "c_custkey")


@query("""WITH e AS (SELECT user_id, ts, event_type, max(value) AS value FROM events GROUP BY 1, 2, 3), a AS (SELECT DISTINCT user_id, ts FROM e WHERE event_type <> 'purchase'), b AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT a.user_id, epoch_us(a.ts) AS row_at, epoch_us(b.ts) AS next_at, b.value AS next_value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts <= b.ts""")
def next_at_or_after(spark, d):
    e = _t(spark, d, "events").groupBy("user_id", "ts", "event_type").agg(F.max("value").alias("value"))
    found = joins.next_at_or_after(e.where("event_type <> 'purchase'").select("user_id", "ts").distinct(), e.where("event_type = 'purchase'"), "ts", "value", "user_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.select("user_id", micros("ts").alias("row_at"), micros("next_at").alias("next_at"), "next_value")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY abs(o_totalprice - 100000), o_orderkey LIMIT 1")
def nearest_row(spark, d):
    return joins.nearest(_t(spark, d, "orders"), "o_totalprice", 100000.0, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\\\', '', 'g'), '\\(hline|toprule|midrule|bottomrule)', '', 'g'), '\s*&\s*', ',', 'g'), '\\%', '%', 'g'), ' ') AS line FROM documents""")
def table_rows_to_csv(spark, d):
    return _t(spark, d, "documents").select("doc_id", table_to_csv(F.col("text")).alias("line"))


@query(f"""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) > 172800 THEN 1 ELSE 0 END AS gap FROM {DAILY} WHERE x > 300000),
c AS (SELECT *, sum(gap) OVER (ORDER BY ts) AS cluster FROM g) SELECT strftime(min(ts), '%Y-%m-%d') AS started, max(x) AS peak, count(*) AS n FROM c GROUP BY cluster""")
def session_peaks(spark, d):
    found = streaming_peaks(_daily(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "x", 300000)
    return found.withColumn("started", F.date_format("started", "yyyy-MM-dd"))


@query(f"SELECT floor(hs / 0.5)::INT AS k, count(*) AS n, round(avg(hs), 6) AS hs, round(avg(ln(tp)), 6) AS mu, round(stddev_pop(ln(tp)), 6) AS sigma FROM {SEA} WHERE hs > 0 AND tp > 0 GROUP BY 1 HAVING count(*) >= 10")
def joint_intervals(spark, d):
    return joint.intervals(_sea(spark, d), "hs", "tp", 0.5)


@query()
def joint_contour(spark, d):
    return joint.contour(spark, _sea(spark, d), "hs", "tp", 0.5, 100, 3.0)




# values given classes of another variable


def _classes_sql(table: str, value: str, by: str, width: float, top: float) -> str:
    count = -int(-top // width)
    parts = ", ".join(f"CASE WHEN n > 10 THEN round({c}, 6) END AS {c}" for c in ("p5", "mean", "std", "p95"))
    return f"""WITH g AS (SELECT floor({by} / {width})::INT AS k, count(*) n, quantile_cont({value}, 0.05) p5, avg({value}) mean, stddev_samp({value}) std, quantile_cont({value}, 0.95) p95
FROM {table} WHERE {by} BETWEEN 0 AND {count * width} GROUP BY 1)
SELECT s.k::INT AS k, (s.k + 0.5) * {width}::DOUBLE AS centre, coalesce(n, 0) AS n, {parts} FROM (SELECT unnest(range({count})) AS k) s LEFT JOIN g USING (k)"""


@query(_classes_sql("lineitem", "l_extendedprice", "l_quantity", 5.0, 60.0))
def given_classes(spark, d):
    return conditional.given_classes(_line(spark, d), "l_extendedprice", "l_quantity", 5.0, 60.0)


@query()
def given_classes_curve(spark, d):
    return conditional.with_curve(conditional.given_classes(_sea(spark, d), "tp", "hs", 0.5, 12.0), "current_on_height")


# tide

_STEPS = f"(SELECT x - avg(x) OVER () AS x, ((epoch(ts) - min(epoch(ts)) OVER ()) / 3600)::BIGINT AS k, ((max(epoch(ts)) OVER () - min(epoch(ts)) OVER ()) / 3600)::BIGINT AS last FROM {HOURLY})"


def _tide_sql() -> str:
    parts = []
    for name, period, whole in (("m2", 12.42, 621), ("s2", 12.0, 12), ("k1", 23.934, 11967), ("o1", 25.82, 1291)):
        upto, angle = f"(last // {whole}) * {whole}", f"(2 * pi() / {period}) * k"
        sums = [f"sum(x * {f}({angle})) FILTER (k <= {upto})" for f in ("cos", "sin")]
        parts.append(f"CASE WHEN max({upto}) > 0 THEN 2 / max({upto}) * sqrt(pow({sums[0]}, 2) + pow({sums[1]}, 2)) ELSE 0 END AS {name}")
    return f"""WITH a AS (SELECT {', '.join(parts)} FROM {_STEPS}), f AS (SELECT *, (k1 + o1) / (m2 + s2) AS f FROM a)
SELECT round(m2, 6) AS m2, round(s2, 6) AS s2, round(k1, 6) AS k1, round(o1, 6) AS o1, round(f, 6) AS form_factor,
CASE WHEN f < 0.25 THEN 'semi-diurnal' WHEN f < 1.5 THEN 'mixed, mainly semi-diurnal' WHEN f < 3 THEN 'mixed, mainly diurnal' ELSE 'diurnal' END AS type FROM f"""


@query(_tide_sql())
def tide_type(spark, d):
    return water.tide_type(_hourly(spark, d), "ts", "x")


@query(f"""WITH s AS (SELECT ts, x, ((epoch(ts) - min(epoch(ts)) OVER ()) / 3600)::BIGINT AS k FROM {HOURLY}), l AS (SELECT regr_slope(x, k) b, regr_intercept(x, k) a FROM s)
SELECT ts::VARCHAR AS ts, x, round(x - a - b * k, 6) AS detrended FROM s, l""")
def without_trend(spark, d):
    return water.without_trend(_hourly(spark, d), "ts", "x").withColumn("ts", F.col("ts").cast("string"))


# hierarchical joint models


@query()
def joint_model_parameters(spark, d):
    return hierarchical.parameters(spark, hierarchical.fit(_sea(spark, d), ["hs", "tp"]))


@query()
def joint_model_contour(spark, d):
    return hierarchical.contour(spark, hierarchical.fit(_sea(spark, d), ["hs", "tp"]), 100.0, 3.0, method="ISORM")


# corrections and conversions


@query("""SELECT o_orderkey, round(CASE WHEN w > 15 THEN w + 0.1 * (w - 15) ELSE w END, 6) AS wind, round(CASE WHEN w - 10 < 0 THEN 1.07 * (w - 10) WHEN w - 10 > 15 THEN w - 10 + 0.3 * (w - 25) ELSE w - 10 END, 6) AS air,
round(CASE WHEN w / 2 >= 3.2 THEN round(3.244 * exp(0.09525 * (ln(w / 2 / 3.244) / 0.09525 - ((o_orderkey * 7919) % 1000 / 1000 - 0.5))), 1) ELSE w / 2 END, 6) AS tp,
round(CASE WHEN w <= 10 THEN w - 10 - (0.25 + 0.01) ELSE w - 10 + 0.25 + 0.01 END, 6) AS degrees, round(w * 1.220 / 1.225, 6) AS wind_50m FROM (SELECT o_orderkey, o_totalprice / 15000 AS w FROM orders)""")
def corrected_series(spark, d):
    w = F.col("w")
    noise = F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 1000 - 0.5
    found = {
        "wind": corrections.strong_wind(w), "air": corrections.air_temperature(w - 10), "tp": corrections.spread_period(w / 2, noise),
        "degrees": corrections.decimal_degrees(w - 10, F.lit(15.0), F.lit(36.0)), "wind_50m": corrections.wind_at(w, 10, 5, 50, 600),
    }
    rows = _t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 15000).alias("w"))
    return rows.select("o_orderkey", *(F.round(c, 6).alias(n) for n, c in found.items()))


@query("""SELECT event_id, round(sqrt(u * u + v * v), 6) AS speed, CASE WHEN u = 0 AND v = 0 THEN 0 ELSE round((degrees(atan2(u, v)) + 360) % 360, 2) END AS towards
FROM (SELECT event_id, value - 100 AS u, (event_id % 200)::DOUBLE - 100 AS v FROM events)""")
def current_vectors(spark, d):
    rows = _t(spark, d, "events").select("event_id", (F.col("value") - 100).alias("u"), (F.col("event_id") % 200).cast("double").alias("v")).withColumn("v", F.col("v") - 100)
    return rows.select("event_id", F.round(corrections.magnitude(F.col("u"), F.col("v")), 6).alias("speed"), corrections.towards(F.col("u"), F.col("v")).alias("towards"))


def _steep_sql(t: str, low: str, t1: int, high: str, t2: int) -> str:
    h1, h2 = f"{low} * 9.81 / (2 * pi()) * {t1} ** 2", f"{high} * 9.81 / (2 * pi()) * {t2} ** 2"
    return f"round(CASE WHEN {t} <= {t1} THEN {low} * 9.81 / (2 * pi()) * {t} ** 2 WHEN {t} >= {t2} THEN {high} * 9.81 / (2 * pi()) * {t} ** 2 ELSE {h1} + ({t} - {t1}) * ({h2} - {h1}) / ({t2} - {t1}) END, 6)"


@query(f"SELECT DISTINCT l_quantity AS q, {_steep_sql('(l_quantity / 2)', '(1 / 15)', 8, '(1 / 25)', 15)} AS by_tp, {_steep_sql('(l_quantity / 2)', '(1 / 10)', 6, '(1 / 15)', 12)} AS by_tz FROM lineitem")
def steepness_limits(spark, d):
    t = F.col("q") / 2
    rows = _t(spark, d, "lineitem").select(F.col("l_quantity").alias("q")).distinct()
    return rows.select("q", F.round(corrections.steepness_limit(t), 6).alias("by_tp"), F.round(corrections.steepness_limit(t, "tz"), 6).alias("by_tz"))


# waves below the surface


@query()
def wave_current(spark, d):
    sea = _line(spark, d).select((F.col("l_quantity") / 5).alias("hs")).distinct().withColumn("tp", 4 + 2 * F.sqrt("hs")).withColumn("z", F.explode(F.array(*map(F.lit, (0.0, 10.0, 50.0)))))
    return currents.with_wave_current(sea, "hs", "tp", 100.0, "z").withColumns({c: F.round(c, 6) for c in ("us", "tu")})


@query()
def wave_influence_depth(spark, d):
    sea = _line(spark, d).select((F.col("l_quantity") / 5).alias("hs")).distinct().withColumn("tp", 4 + 2 * F.sqrt("hs"))
    return currents.depth_of_influence(sea, ["hs", "tp"], "hs", "tp", 100.0)


# windows for several thresholds, months of every year, shear, water levels, thresholds


@query(f"""WITH t AS (SELECT unnest([150.0, 200.0, 300.0])::DOUBLE AS threshold), c AS (SELECT threshold, ts, (x < threshold)::INT AS ok, row_number() OVER (PARTITION BY threshold ORDER BY ts) k FROM {HOURLY}, t),
s AS (SELECT *, {', '.join(f"sum(ok) OVER (PARTITION BY threshold ORDER BY ts ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) = {n} AS s{n}" for n in (2, 3, 6))} FROM c),
w AS ({' UNION ALL '.join(f"SELECT threshold, {n} AS d, (min(CASE WHEN s{n} THEN k END) OVER (PARTITION BY threshold ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - k + {n}) / 24.0 AS v FROM s" for n in (2, 3, 6))})
SELECT threshold, d::INT AS duration_h, round(avg(v), 6) AS days FROM w GROUP BY 1, 2""")
def weather_window_thresholds(spark, d):
    return windows.threshold_table(_hourly(spark, d), "ts", "x", (150, 200, 300), (2, 3, 6), 1.0)


@query("""WITH y AS (SELECT min(year(o_orderdate)) a, max(year(o_orderdate)) b FROM orders), s AS (SELECT unnest(range(a, b + 1))::INT AS year FROM y),
m AS (SELECT unnest(range(1, 13))::INT AS month), g AS (SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, round(quantile_cont(o_totalprice, 0.25), 6) p25, round(avg(o_totalprice), 6) mean,
round(quantile_cont(o_totalprice, 0.75), 6) p75, round(quantile_cont(o_totalprice, 0.99), 6) p99, round(max(o_totalprice), 6) AS max FROM orders GROUP BY 1, 2)
SELECT s.year, m.month, p25, mean, p75, p99, g.max FROM s CROSS JOIN m LEFT JOIN g ON g.year = s.year AND g.month = m.month""")
def monthly_every_year(spark, d):
    return describe.monthly_every_year(_orders(spark, d), "o_orderdate", "o_totalprice")


@query("""SELECT count(a) AS n, round(quantile_cont(a, 0.5), 6) AS median, round(quantile_cont(a, 0.25), 6) AS p25, round(quantile_cont(a, 0.75), 6) AS p75
FROM (SELECT CASE WHEN l_quantity > 0 AND l_tax > 0 THEN ln(l_tax / l_quantity) / ln(10.0::DOUBLE) END AS a FROM lineitem)""")
def wind_shear(spark, d):
    return profile.shear(_line(spark, d), (10.0, "l_quantity"), (100.0, "l_tax"))


@query("""WITH a AS (SELECT min(l_discount) d0, max(l_discount) d1, min(l_tax) t0, max(l_tax) t1, min(l_quantity) p0, avg(l_quantity) pm, max(l_quantity) p1 FROM lineitem)
SELECT unnest(['total', 'tide', 'pressure surge']) AS component, unnest([round(d0, 6), round(t0, 6), round(-0.01 * (p1 - pm), 6)]) AS least, unnest([round(d1, 6), round(t1, 6), round(-0.01 * (p0 - pm), 6)]) AS greatest FROM a""")
def water_level_extremes(spark, d):
    return water.water_levels(_line(spark, d), {"total": "l_discount", "tide": "l_tax"}, "l_quantity")


@query(f"""WITH u AS (SELECT unnest([200000.0, 250000.0, 300000.0])::DOUBLE AS threshold), x AS (SELECT * FROM {DAILY}), y AS (SELECT max(year(ts)) - min(year(ts)) + 1 AS years FROM x),
g AS (SELECT threshold, x, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY threshold ORDER BY ts)) > 172800 THEN 1 ELSE 0 END AS gap FROM x, u WHERE x > threshold),
c AS (SELECT *, sum(gap) OVER (PARTITION BY threshold ORDER BY ts) AS cluster FROM g), p AS (SELECT threshold, max(x) AS v FROM c GROUP BY threshold, cluster)
SELECT threshold, 'EXP' AS distribution, count(*) AS n, CASE WHEN count(*) > 2 THEN round(min(v) - (avg(v) - min(v)) * ln(least(any_value(years) / (100.0 * count(*)), 1 - 1e-9)), 6) END AS value FROM p, y GROUP BY 1""")
def threshold_sensitivity(spark, d):
    return extremes.threshold_sensitivity(_daily(spark, d), "ts", "x", (200000, 250000, 300000), 100.0).withColumn("value", F.round("value", 6))


@query()
def threshold_sensitivity_fitted(spark, d):
    return extremes.threshold_sensitivity(_daily(spark, d).withColumn("x", F.col("x") / 1e5), "ts", "x", (2, 2.5, 3), 100.0, ("EXP", "GP", "Weibull_2P"))


from tidemark.plans import marine  # noqa: E402, F401  registers the queries that build on these
