"""Filter and spectrum queries; the oracle runs the recursion sample by sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeframe.functions.filters import butterworth, steady_state
from wakeframe.operators import filters as ops
from wakeframe.operators.filters import CHUNK
from wakeframe.operators.ordering import index_rows
from wakeframe.plans.registry import query
from wakeframe.plans.views import frames, signal, sql, table


def recursion(name: str, src: str, key: str, b, a, start: str) -> str:
    """Recursive CTE over lists ``e`` of ``src``: transposed direct form, one sample a step."""
    m = len(b) - 1
    zi = [float(v) for v in steady_state(b, a)]
    z = [f"z{i}" for i in range(m)]
    init = [f"({zi[i]!r} * ({start}))" for i in range(m)]

    def nxt(prev):
        return ", ".join(f"{b[i + 1]!r} * x - {a[i + 1]!r} * y + {prev[i + 1] if i + 1 < m else '0'} AS z{i}" for i in range(m))

    z0 = ", ".join(f"{init[i]} AS z{i}" for i in range(m))
    return f"""{name} AS (SELECT {key}, e, 1::BIGINT AS m, y, {nxt(z)} FROM (SELECT {key}, e, e[1] AS x, {b[0]!r} * e[1] + z0 AS y, {', '.join(z)} FROM
      (SELECT {key}, e, {z0} FROM {src})) UNION ALL
      SELECT {key}, e, m, y, {nxt(z)} FROM (SELECT {key}, e, m + 1 AS m, e[m + 1] AS x, {b[0]!r} * e[m + 1] + z0 AS y, {', '.join(z)} FROM {name} WHERE m < len(e)))"""


def both_ways_sql(src: str, key: str, b, a) -> list[str]:
    """CTEs from (key, p LIST) of ``src`` to ``flt(key, n, p)``."""
    b, a = [float(v) for v in b], [float(v) for v in a]
    pad = 3 * len(b)
    return [
        f"""ext AS (SELECT {key}, list_concat(list_concat(list_transform(range({pad}, 0, -1), lambda i: 2 * p[1] - p[i + 1]), p),
          list_transform(range(1, {pad + 1}), lambda i: 2 * p[-1] - p[len(p) - i])) AS e FROM {src})""",
        recursion("fwd", "ext", key, b, a, "e[1]"),
        f"turned AS (SELECT {key}, list(y ORDER BY m DESC) AS e FROM fwd GROUP BY {key})",
        recursion("bwd", "turned", key, b, a, "e[1]"),
        f"flt AS (SELECT {key}, len(e) - m - {pad} AS n, y AS p FROM bwd WHERE len(e) - m - {pad} BETWEEN 0 AND len(e) - {2 * pad} - 1)",
    ]


LISTS = "lst AS (SELECT channel, list(p ORDER BY n) AS p FROM sig GROUP BY channel)"


@query(
    "Q01_butterworth_design",
    "channel:s rate:3 tap:i b:8 a:8",
    sql(
        "",
        """SELECT channel, rate, tap, [k * k / d, 2 * k * k / d, k * k / d][tap + 1] AS b, [1, 2 * (k * k - 1) / d, (1 - sqrt(2) * k + k * k) / d][tap + 1] AS a FROM
        (SELECT event_type AS channel, count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9) AS rate FROM events GROUP BY 1), range(3) r(tap),
        (SELECT tan(pi() * 0.1) AS k, 1 + sqrt(2) * tan(pi() * 0.1) + pow(tan(pi() * 0.1), 2) AS d)""",
    ),
)
def q01(spark, sf):
    """Low-pass taps for each channel's own sampling rate (samples per hour), cutoff a tenth of it."""
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 3.6e9
    rate = table(spark, sf, "events").groupBy(F.col("event_type").alias("channel")).agg((F.count(F.lit(1)) / span).alias("rate"))
    return ops.design(rate, "rate", 2, 0.1, "low").select("channel", "rate", F.inline("taps"))


BAND = butterworth(2, (0.3, 9.0), "band", 100.0)
LOW = butterworth(2, 5.0, "low", 100.0)


@query("Q02_zero_phase_bandpass", "channel:s n:i p:5", sql("sig", "SELECT * FROM flt", LISTS, *both_ways_sql("lst", "channel", *BAND)))
def q02(spark, sf):
    return ops.zero_phase(signal(spark, sf), ["channel"], *BAND, size=CHUNK)


@query("Q03_zero_phase_lowpass", "channel:s n:i p:5", sql("sig", "SELECT * FROM flt", LISTS, *both_ways_sql("lst", "channel", *LOW)))
def q03(spark, sf):
    return ops.zero_phase(signal(spark, sf), ["channel"], *LOW, size=CHUNK)


HIGH = butterworth(4, 0.004 * 250000.0 / 1000, "high", 100.0)


@query("Q04_zero_phase_highpass", "channel:s n:i p:3", sql("sig", "SELECT * FROM flt", LISTS, *both_ways_sql("lst", "channel", *HIGH)))
def q04(spark, sf):
    return ops.high_pass_by_speed(signal(spark, sf), ["channel"], 250000.0, 100.0, size=CHUNK)


CAUSAL = butterworth(3, 8.0, "low", 100.0)


@query(
    "Q05_causal_lowpass",
    "channel:s n:i p:5",
    sql("sig", "SELECT channel, m - 1 AS n, y AS p FROM fwd", "lst AS (SELECT channel, list(p ORDER BY n) AS e FROM sig GROUP BY channel)",
        recursion("fwd", "lst", "channel", [float(v) for v in CAUSAL[0]], [float(v) for v in CAUSAL[1]], "0")),
)
def q05(spark, sf):
    return ops.causal(signal(spark, sf), ["channel"], *CAUSAL, size=CHUNK)


WIDE_SQL = """wide AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS n, event_id, value AS ESP1, user_id::DOUBLE AS ESP2 FROM events),
  lst AS (SELECT 'ESP1' AS channel, list(ESP1 ORDER BY n) AS p FROM wide UNION ALL SELECT 'ESP2', list(ESP2 ORDER BY n) FROM wide)"""


@query(
    "Q06_filter_prefixed_columns",
    "n:i event_id:i ESP1:5 ESP2:5 b0:8 a1:8",
    sql(
        "",
        f"""SELECT w.n, event_id, x.p AS ESP1, y.p AS ESP2, {float(LOW[0][0])!r} AS b0, {float(LOW[1][1])!r} AS a1 FROM wide w
        JOIN flt x ON x.n = w.n AND x.channel = 'ESP1' JOIN flt y ON y.n = w.n AND y.channel = 'ESP2'""",
        WIDE_SQL,
        *both_ways_sql("lst", "channel", *LOW),
    ),
)
def q06(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "ts", F.lit(1).alias("one"), F.col("value").alias("ESP1"), F.col("user_id").cast("double").alias("ESP2")
    )
    wide = index_rows(e, ["one"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts"))).drop("one", "ts")
    return ops.filter_prefixed(wide, "ESP", "n", *LOW, size=CHUNK)


SPEC_SQL = """spc AS (SELECT run, frame, k, k * 100.0 / 64 AS freq, 2.0 / 64 * sqrt(pow(sum((v - mu) * cos(2 * pi() * k * i / 64)), 2) + pow(sum((v - mu) * sin(2 * pi() * k * i / 64)), 2)) AS amp
  FROM (SELECT run, frame, cell AS i, v, avg(v) OVER (PARTITION BY run, frame) AS mu FROM cells), range(32) r(k) GROUP BY run, frame, k)"""


def spectra(spark, sf):
    return frames(spark, sf).select("run", "frame", "v", ops.amplitude_spectrum(F.col("v"), 100.0).alias("spec"))


@query("Q07_amplitude_spectrum", "run:i frame:i freq:4 amp:6", sql("cells", "SELECT * FROM spc", SPEC_SQL))
def q07(spark, sf):
    return spectra(spark, sf).select("run", "frame", F.inline("spec"))


DOM_SQL = "dom AS (SELECT run, frame, arg_max(freq, (amp, -k)) AS freq, max(amp) AS amp, max(freq) FILTER (amp > top / 10) AS cutoff FROM (SELECT *, max(amp) OVER (PARTITION BY run, frame) AS top FROM spc) GROUP BY run, frame)"


@query("Q08_dominant_frequency", "run:i frame:i freq:4 amp:6 cutoff:4", sql("cells", "SELECT * FROM dom", SPEC_SQL, DOM_SQL))
def q08(spark, sf):
    return spectra(spark, sf).select("run", "frame", ops.dominant(F.col("spec")).alias("d")).select("run", "frame", "d.*")


def smooth_pass(name: str, src: str) -> str:
    """One pass of a second-order low-pass whose taps are columns of the row, from its steady state."""
    return f"""{name} AS (SELECT run, frame, e, b0, b1, a1, a2, 1::BIGINT AS m, y, b1 * x - a1 * y + z1 AS z0, b0 * x - a2 * y AS z1 FROM
      (SELECT *, e[1] AS x, e[1] AS y, (b0 - a2) * e[1] AS z1 FROM {src}) UNION ALL
      SELECT run, frame, e, b0, b1, a1, a2, m, y, b1 * x - a1 * y + z1, b0 * x - a2 * y FROM (SELECT *, b0 * x + z0 AS y FROM
      (SELECT run, frame, e, b0, b1, a1, a2, m + 1 AS m, e[m + 1] AS x, z0, z1 FROM {name} WHERE m < len(e))))"""


DETREND = [
    """tap AS (SELECT run, frame, k * k / d AS b0, 2 * k * k / d AS b1, 2 * (k * k - 1) / d AS a1, (1 - sqrt(2) * k + k * k) / d AS a2 FROM
      (SELECT run, frame, k, 1 + sqrt(2) * k + k * k AS d FROM (SELECT run, frame, tan(pi() * freq / 100) AS k FROM dom WHERE freq > 0 AND freq < 50)))""",
    """ext AS (SELECT t.*, list_concat(list_concat(list_transform(range(9, 0, -1), lambda i: 2 * v[1] - v[i + 1]), v),
      list_transform(range(1, 10), lambda i: 2 * v[64] - v[64 - i])) AS e FROM tap t JOIN fr USING (run, frame))""",
    smooth_pass("fwd", "ext"),
    "turned AS (SELECT run, frame, b0, b1, a1, a2, list(y ORDER BY m DESC) AS e FROM fwd GROUP BY ALL)",
    smooth_pass("bwd", "turned"),
]


@query(
    "Q09_detrend_adaptive",
    "run:i frame:i pos:i p:6",
    sql("cells", "SELECT b.run, b.frame, 82 - m - 9 AS pos, f.v[82 - m - 9 + 1] - y AS p FROM bwd b JOIN fr f USING (run, frame) WHERE 82 - m - 9 BETWEEN 0 AND 63", SPEC_SQL, DOM_SQL, *DETREND),
)
def q09(spark, sf):
    d = spectra(spark, sf).withColumn("cutoff", ops.dominant(F.col("spec"))["freq"])
    return d.select("run", "frame", F.posexplode(ops.detrend_adaptive(F.col("v"), F.col("cutoff"), 100.0)).alias("pos", "p"))
