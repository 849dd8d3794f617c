"""Pair similarity, correlation matrices and sweep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeframe.functions import alignment, arrays
from wakeframe.operators import filters, similarity as ops
from wakeframe.operators.series import solver_seconds
from wakeframe.plans.filters import BAND, CHUNK, LISTS, both_ways_sql
from wakeframe.plans.registry import query
from wakeframe.plans.views import frames, signal, sql, table

PAIRS = "prs AS (SELECT a.run, a.frame, a.v AS a, b.v AS b FROM fr a JOIN fr b ON a.run = b.run AND b.frame = a.frame + 1)"
K = "run, frame"


def pairs(spark, sf):
    f = frames(spark, sf)
    nxt = f.select("run", (F.col("frame") - 1).alias("frame"), F.col("v").alias("b"))
    return f.select("run", "frame", F.col("v").alias("a")).join(nxt, ["run", "frame"])


def dp_sql(name: str, src: str, k: str, cost: str, step: str) -> str:
    """Anti-diagonal dynamic programme as a recursive CTE over lists."""
    inf = "1e300::DOUBLE"
    new = f"""list_transform(range(0, len(a)), lambda i: CASE WHEN s - i BETWEEN 0 AND len(b) - 1 THEN {step} ELSE {inf} END)"""
    for tag, text in {
        "$c": cost, "$up": f"coalesce(p1[i + 1], {inf})", "$left": f"coalesce(p1[i], {inf})", "$diag": f"coalesce(p2[i], {inf})",
    }.items():
        new = new.replace(tag, text)
    start = cost.replace("i + 1", "1").replace("s - 1", "1").replace("s - i", "0").replace("(i)", "(0)")
    return f"""{name} AS (SELECT {k}, a, b, 1 AS s, list_transform(range(0, len(a)), lambda i: CASE WHEN i = 0 THEN {start} ELSE {inf} END) AS p1,
      list_transform(range(0, len(a)), lambda i: {inf}) AS p2 FROM {src}
      UNION ALL SELECT {k}, a, b, s + 1, {new}, p1 FROM {name} WHERE s < len(a) + len(b) - 1)"""


DTW_COST = "abs(a[i + 1] - b[s - i + 1])"
DTW_STEP = "least(least($up, $left) + $c, $diag + 2 * $c)"
FRE_STEP = "greatest(least($up, $left, $diag), $c)"


def fre_cost(i="i", j="(s - i)"):
    return f"sqrt(pow((-1 + 2.0::DOUBLE * {i} / (len(a) - 1)) - (-1 + 2.0::DOUBLE * {j} / (len(b) - 1)), 2) + pow(a[{i} + 1] - b[{j} + 1], 2))"


def dtw_sql(src, k):
    return dp_sql("dtw", src, k, DTW_COST, DTW_STEP).replace("abs(a[1] - b[s - i + 1])", "abs(a[1] - b[1])").replace("abs(a[1] - b[0 + 1])", "abs(a[1] - b[1])")


def frechet_sql(src, k):
    start = fre_cost("0", "0")
    text = dp_sql("fre", src, k, "@@", FRE_STEP)
    head, tail = text.split("UNION ALL", 1)
    return head.replace("@@", start) + "UNION ALL" + tail.replace("@@", fre_cost())


def corr_sql(src, k):
    return f"""lags AS (SELECT {k}, lag, list_sum(list_transform(range(greatest(0, -lag), least(len(b), len(a) - lag)), lambda j: (a[j + lag + 1] - ma) * (b[j + 1] - mb)))
      / sqrt(list_sum(list_transform(a, lambda v: pow(v - ma, 2))) * list_sum(list_transform(b, lambda v: pow(v - mb, 2)))) AS c
      FROM (SELECT *, list_avg(a) AS ma, list_avg(b) AS mb, unnest(range(1 - len(b), len(a))) AS lag FROM {src})),
      cor AS (SELECT {k}, max(c) AS best, min(lag) FILTER (c >= top - 1e-12) AS lag FROM (SELECT *, max(c) OVER (PARTITION BY {k}) AS top FROM lags) GROUP BY {k})"""


@query("Q18_cross_correlation", "run:i frame:i best:6 lag:i", sql("fr", "SELECT * FROM cor", PAIRS, corr_sql("prs", K)))
def q18(spark, sf):
    return pairs(spark, sf).select("run", "frame", ops.cross_correlation(F.col("a"), F.col("b")).alias("c")).select("run", "frame", "c.*")


@query("Q20_dtw_distance", "run:i frame:i dtw:6", sql("fr", f"SELECT {K}, p1[len(a)] AS dtw FROM dtw WHERE s = len(a) + len(b) - 1", PAIRS, dtw_sql("prs", K)))
def q20(spark, sf):
    return pairs(spark, sf).select("run", "frame", ops.dtw_distance(F.col("a"), F.col("b")).alias("dtw"))


@query("Q21_frechet_distance", "run:i frame:i frechet:6", sql("fr", f"SELECT {K}, p1[len(a)] AS frechet FROM fre WHERE s = len(a) + len(b) - 1", PAIRS, frechet_sql("prs", K)))
def q21(spark, sf):
    return pairs(spark, sf).select("run", "frame", ops.frechet_distance(F.col("a"), F.col("b")).alias("frechet"))


# --- Q22: passages ----------------------------------------------------------------------

CHANNELS = ["view", "signup", "purchase", "click", "error"]
PASSAGE = """psg AS (SELECT run, frame, label, v, ['view', 'signup', 'purchase', 'click', 'error'][label % 5 + 1] AS channel, run * 120 + frame * 2 + 25 AS n0 FROM fr),
  wdw AS (SELECT p.run, p.frame, list(f.p ORDER BY f.n) AS x FROM psg p JOIN flt f ON f.channel = p.channel AND f.n BETWEEN n0 - 20 AND n0 + 20 GROUP BY 1, 2),
  prs AS (SELECT p.run, p.frame, label, channel, n0, list_transform(x, lambda q: q / list_max(list_transform(x, lambda r: abs(r)))) AS a,
  list_transform(v, lambda q: q / list_max(list_transform(v, lambda r: abs(r)))) AS b FROM psg p JOIN wdw w ON p.run = w.run AND p.frame = w.frame WHERE label <> 9)"""
SIM_SQL = f"""sim AS (SELECT p.run, p.frame, p.label, p.channel, p.n0, CASE WHEN p.label <> 9 THEN d.p1[len(d.a)] END AS dtw, CASE WHEN p.label <> 9 THEN e.p1[len(e.a)] END AS frechet,
  c.best AS correlation, len(x) AS samples FROM psg p JOIN wdw w ON p.run = w.run AND p.frame = w.frame
  LEFT JOIN dtw d ON d.run = p.run AND d.frame = p.frame AND d.s = len(d.a) + len(d.b) - 1 LEFT JOIN fre e ON e.run = p.run AND e.frame = p.frame AND e.s = len(e.a) + len(e.b) - 1
  LEFT JOIN cor c ON c.run = p.run AND c.frame = p.frame)"""
SIM = [LISTS, *both_ways_sql("lst", "channel", *BAND), PASSAGE, dtw_sql("prs", K), frechet_sql("prs", K), corr_sql("prs", K), SIM_SQL]


def similarity(spark, sf):
    """Sensor window around each passage against the simulated series; NULL scores when invalid."""
    f = frames(spark, sf)
    n0 = F.col("run") * 120 + F.col("frame") * 2 + 25
    psg = f.withColumns(
        {
            "channel": F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("label") % 5 + 1).cast("int")),
            "n0": n0.cast("bigint"),
            "first_sample": (n0 - 20).cast("bigint"),
            "last_sample": (n0 + 20).cast("bigint"),
        }
    )
    filtered = filters.zero_phase(signal(spark, sf), ["channel"], *BAND, size=CHUNK)
    keys = ["run", "frame"]
    win = ops.windows_from_channels(psg.select(*keys, "channel", "first_sample", "last_sample"), filtered, keys)
    d = psg.join(win, keys)
    valid = F.col("label") != 9
    a = F.when(valid, arrays.normalise(F.col("x")))
    b = arrays.normalise(F.col("v"))
    d = d.withColumns({"a": F.coalesce(a, F.array().cast("array<double>")), "b": b})
    return d.select(
        *keys, "label", "channel", "n0", F.size("x").alias("samples"),
        ops.dtw_distance(F.col("a"), F.col("b")).alias("dtw"),
        ops.frechet_distance(F.col("a"), F.col("b")).alias("frechet"),
        ops.cross_correlation(F.col("a"), F.col("b"))["best"].alias("correlation"),
    )


@query("Q22_similarity_table", "run:i frame:i label:i channel:s n0:i samples:i dtw:4 frechet:5 correlation:5", sql("fr sig", "SELECT * FROM sim", *SIM))
def q22(spark, sf):
    return similarity(spark, sf)


@query(
    "A21_similarity_means",
    "channel:s dtw:4 frechet:5 correlation:5 n:i",
    sql("fr sig", "SELECT channel, avg(dtw) AS dtw, avg(frechet) AS frechet, avg(correlation) AS correlation, count(dtw) AS n FROM sim GROUP BY channel", *SIM),
)
def a21(spark, sf):
    return similarity(spark, sf).groupBy("channel").agg(
        F.avg("dtw").alias("dtw"), F.avg("frechet").alias("frechet"), F.avg("correlation").alias("correlation"), F.count("dtw").alias("n")
    )


# --- matrices ---------------------------------------------------------------------------

ALL = "prs AS (SELECT a.run, a.frame AS fa, b.frame AS fb, a.v AS a, b.v AS b FROM fr a JOIN fr b ON a.run = b.run AND a.frame <= b.frame)"
MAT = corr_sql("prs", "run, fa, fb")


@query(
    "J16_all_pairs",
    "run:i a:i b:i value:6",
    sql("fr", "SELECT run, fa AS a, fb AS b, list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) AS value FROM prs", ALL),
)
def j16(spark, sf):
    return ops.pair_matrix(frames(spark, sf), ["run"], "frame", "v", metric=lambda x, y: x @ y.T, block=16)


def matrix(spark, sf):
    return ops.pair_matrix(frames(spark, sf), ["run"], "frame", "v", alignment.best_correlations, block=16)


@query("Q19_correlation_matrix", "run:i a:i b:i value:6", sql("fr", "SELECT run, fa AS a, fb AS b, best AS value FROM cor", ALL, MAT))
def q19(spark, sf):
    return matrix(spark, sf)


SYM = "sym AS (SELECT run, fa AS a, fb AS b, best AS value FROM cor UNION ALL SELECT run, fb, fa, best FROM cor WHERE fa < fb)"


@query("J17_symmetrise", "run:i a:i b:i value:6", sql("fr", "SELECT * FROM sym", ALL, MAT, SYM))
def j17(spark, sf):
    return ops.symmetrise(matrix(spark, sf))


@query(
    "A22_matrix_summary",
    "run:i mean:6 spread:6 entries:i first_row:6",
    sql(
        "fr",
        "SELECT run, avg(value) AS mean, stddev_pop(value) AS spread, count(*) AS entries, avg(value) FILTER (a = 0) AS first_row FROM sym GROUP BY run",
        ALL, MAT, SYM,
    ),
)
def a22(spark, sf):
    m = ops.symmetrise(matrix(spark, sf))
    rows = m.groupBy("run", "a").agg(F.avg("value").alias("first_row")).filter("a = 0").drop("a")
    return ops.matrix_summary(m, ["run"]).join(rows, "run")


@query(
    "J18_remaining_work",
    "run:i frame:i sensor:s model:s",
    sql(
        "fr",
        """SELECT run, frame, sensor, model FROM fr, (VALUES ('S1'), ('S2'), ('S4')) s(sensor), (VALUES ('fish'), ('cylinder')) m(model)
        WHERE NOT (label % 2 = CASE WHEN model = 'fish' THEN 0 ELSE 1 END AND label % 3 = CASE sensor WHEN 'S1' THEN 0 WHEN 'S2' THEN 1 ELSE 2 END)""",
    ),
)
def j18(spark, sf):
    f = frames(spark, sf)
    sensor = F.element_at(F.array(F.lit("S1"), F.lit("S2"), F.lit("S4")), (F.col("label") % 3 + 1).cast("int"))
    done = f.select("run", "frame", sensor.alias("sensor"), F.when(F.col("label") % 2 == 0, "fish").otherwise("cylinder").alias("model"))
    return ops.remaining_work(f.select("run", "frame"), done, ["S1", "S2", "S4"], ["fish", "cylinder"])


# --- sweeps -----------------------------------------------------------------------------

SWEEP = """swp AS (SELECT l_linenumber AS re, p_size AS h, l_suppkey % 10 AS sensor, l_extendedprice / 1000 AS p, l_quantity AS t, l_returnflag AS flag
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def sweep(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_linenumber").alias("re"), F.col("p_size").alias("h"), (F.col("l_suppkey") % 10).alias("sensor"),
        (F.col("l_extendedprice") / 1000).alias("p"), F.col("l_quantity").alias("t"), F.col("l_returnflag").alias("flag"),
    )


@query("A20_sweep_margins", "re:i h:i mean:6 cells:i", sql("", "SELECT re, h, avg(v) AS mean, count(*) AS cells FROM (SELECT re, h, avg(p) AS v FROM swp GROUP BY 1, 2) GROUP BY CUBE (re, h)", SWEEP))
def a20(spark, sf):
    return ops.sweep_margins(sweep(spark, sf), "re", "h", "p")


P2P = "p2p AS (SELECT re, h, avg(amp) AS amplitude, avg(log10(pow(nullif(abs(amp), 0), -4))) AS f_h FROM (SELECT re, h, sensor, max(p) - min(p) AS amp FROM swp GROUP BY ALL) GROUP BY re, h)"
TMIN = "tmn AS (SELECT re, h, greatest(avg(log10(t)), -1) AS f_re FROM (SELECT re, h, sensor, arg_min(t, (p, t)) AS t FROM swp GROUP BY ALL) GROUP BY re, h)"


@query("A23_peak_to_peak", "re:i h:i amplitude:6 f_h:6", sql("", "SELECT * FROM p2p", SWEEP, P2P))
def a23(spark, sf):
    return ops.peak_to_peak(sweep(spark, sf), ["re", "h"], "sensor", "p")


@query("A24_time_of_minimum", "re:i h:i f_re:6", sql("", "SELECT * FROM tmn", SWEEP, TMIN))
def a24(spark, sf):
    return ops.time_of_minimum(sweep(spark, sf), ["re", "h"], "sensor", "t", "p", floor=-1.0)


@query("A25_sweep_metrics", "re:i h:i f_re:6 f_h:6", sql("", "SELECT * FROM p2p JOIN tmn USING (re, h)", SWEEP, P2P, TMIN))
def a25(spark, sf):
    return a24(spark, sf).join(a23(spark, sf), ["re", "h"])


POSITION = "pos AS (SELECT re, log10(h) AS x, log10(pow(nullif(max(p) - min(p), 0), -4)) AS y FROM swp GROUP BY re, h)"
FIT = f"""fit AS (SELECT re, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_count(y, x) AS n,
  sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x)) AS std_err FROM pos GROUP BY re)"""
# Student quantiles by degrees of freedom, as many as a sweep has heights.
QUANTILES = "tq AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {float(alignment.t_quantile(0.995, k))!r}::DOUBLE)" for k in range(1, 49)) + ") t(df, q))"


def slopes(spark, sf):
    g = sweep(spark, sf).groupBy("re", "h").agg((F.max("p") - F.min("p")).alias("amp"))
    d = g.select("re", F.log10("h").alias("x"), F.log10(F.pow(F.nullif("amp", F.lit(0.0)), F.lit(-4.0))).alias("y"))
    return ops.log_regression(d, "re", "x", "y")


@query(
    "A26_log_regression",
    "re:i slope:6 intercept:6 r2:6 std_err:6 n:i low:6 high:6",
    sql("", "SELECT *, slope - q * std_err AS low, slope + q * std_err AS high FROM fit JOIN tq ON df = n - 2", SWEEP, POSITION, FIT, QUANTILES),
)
def a26(spark, sf):
    return slopes(spark, sf)


@query(
    "A26_mean_slope",
    "mean_slope:6 mean_intercept:6 n:i low:6 high:6",
    sql(
        "",
        f"""SELECT *, mean_slope - {alignment.t_quantile(0.995, 6)!r} * se AS low, mean_slope + {alignment.t_quantile(0.995, 6)!r} * se AS high FROM
        (SELECT avg(slope) AS mean_slope, avg(intercept) AS mean_intercept, count(*) AS n, stddev_pop(slope) / sqrt(count(*)) AS se FROM fit)""",
        SWEEP, POSITION, FIT,
    ),
)
def a26m(spark, sf):
    return ops.mean_slope(slopes(spark, sf))


@query(
    "Q23_distance_table",
    "run:i frame:i pressure:8 vertical:6 horizontal:6 euclidean:6 seconds:6",
    sql(
        "fr",
        """SELECT *, sqrt(horizontal * horizontal + vertical * vertical) AS euclidean FROM (SELECT *, v[57] * 1000 * pow(re * 1e-6 / 0.05, 2) AS pressure,
        (h - 8 / 8 / 2) / 8 AS vertical, -(0.5 - seconds * (re * 1e-6 / 0.05)) AS horizontal FROM
        (SELECT *, 1000 * (run % 10 + 1) AS re, 1 + run % 7 AS h, frame * (1.0 / 64) * (8 / 20 / (1000 * (run % 10 + 1))) / 1e-6 AS seconds FROM fr))""",
    ),
)
def q23(spark, sf):
    f = frames(spark, sf).withColumns({"re": 1000 * (F.col("run") % 10 + 1), "h": 1 + F.col("run") % 7, "p": F.get("v", F.lit(56))})
    return ops.distance_table(f.withColumn("seconds", solver_seconds(F.col("frame"), F.col("re"), n=8)), "p", 8)


LEVEL = "lvl AS (SELECT run, frame, 10 * list_avg(list_transform(v, lambda q: abs(q))) AS v FROM fr)"


def levels(spark, sf):
    return frames(spark, sf).select("run", "frame", (10 * arrays.mean(F.transform("v", lambda q: F.abs(q)))).alias("v"))


@query(
    "A40_histogram",
    "bin:i n:i density:6",
    sql("fr", "SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) AS n, count(*) / (any_value(cnt) * (any_value(hi) - any_value(lo)) / 50) AS density FROM lvl, (SELECT min(v) AS lo, max(v) AS hi, count(*) AS cnt FROM lvl) GROUP BY 1", LEVEL),
)
def a40h(spark, sf):
    return ops.histogram(levels(spark, sf), "v")


KDE = """kde AS (SELECT k, lo - 1 + k * (hi - lo + 2) / 999 AS x, sum(exp(-0.5 * pow((lo - 1 + k * (hi - lo + 2) / 999 - v) / w, 2))) / (any_value(n) * any_value(w) * sqrt(2 * pi())) AS density
  FROM lvl, (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS w FROM lvl), range(1000) r(k) GROUP BY k, lo, hi)"""


@query("A40_density_curve", "k:i x:6 density:6", sql("fr", "SELECT * FROM kde", LEVEL, KDE))
def a40k(spark, sf):
    return ops.density_curve(levels(spark, sf), "v")


@query(
    "A40_density_modes",
    "k:i x:6 density:6",
    sql("fr", "SELECT * FROM (SELECT *, lag(density) OVER (ORDER BY k) AS p, lead(density) OVER (ORDER BY k) AS n FROM kde) WHERE density > p AND density > n", LEVEL, KDE),
)
def a40m(spark, sf):
    return ops.curve_modes(ops.density_curve(levels(spark, sf), "v"))


@query(
    "O01_natural_order",
    "name:s num:i parts:i",
    sql("", "SELECT p_brand || ' ' || p_type AS name, try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS num, count(*) AS parts FROM part GROUP BY 1, 2 ORDER BY num, name"),
)
def o01(spark, sf):
    name = F.concat_ws(" ", "p_brand", "p_type")
    d = table(spark, sf, "part").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("parts"))
    return d.withColumn("num", ops.natural_key(F.col("name"))).orderBy(F.col("num").asc_nulls_last(), "name")


@query(
    "O04_best_unused",
    "l_orderkey:i l_linenumber:i l_extendedprice:2",
    sql(
        "",
        """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1""",
    ),
)
def o04(spark, sf):
    used = table(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("l_orderkey"))
    return ops.best_unused(table(spark, sf, "lineitem"), used, ["l_orderkey"], "l_extendedprice")


@query(
    "F07_sweep_parameters",
    "re:i h:2 n:i",
    sql("", "SELECT l_linenumber * 1000 AS re, p_size + 0.5 * (l_linenumber % 2) AS h, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"),
)
def f07(spark, sf):
    d = sweep(spark, sf)
    h = F.col("h") + 0.5 * (F.col("re") % 2)
    path = F.concat(F.lit("runs/Re"), (F.col("re") * 1000).cast("string"), F.lit("_h"), h.cast("string"), F.lit("/FullMap.csv"))
    return d.select(ops.sweep_parameters(path).alias("s")).groupBy(F.col("s.re").alias("re"), F.col("s.h").alias("h")).agg(F.count(F.lit(1)).alias("n"))
