"""Named queries of the engine and their SQL twins; each query is a thin call of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import scalars as fn
from weirflow.operators import corpus as C
from weirflow.operators import dimensions as D
from weirflow.operators import evaluation as E
from weirflow.operators import registry as G
from weirflow.operators import report as R
from weirflow.operators import retrieval as V
from weirflow.operators import samples as S
from weirflow.operators import sensor_query as Q
from weirflow.plans import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_S = """S AS (SELECT user_id AS device, event_type AS metric, ts AS tm, (epoch_us(ts) // 1000) AS ms, event_id AS ord, value,
    coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT) < 90, true) AS valid FROM events)"""
_W = _S + """, A AS (SELECT device, max(tm) AS anchor FROM S GROUP BY device),
W AS (SELECT S.* FROM S JOIN A USING (device) WHERE tm >= anchor - INTERVAL 7 DAY AND tm <= anchor)"""
def _turns_of(values: tuple[str, ...], key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({key} % {len(values)} + 1)::INT]"


_MS = _S + f""", SM AS (SELECT device, CASE WHEN metric = 'signup' AND device % 2 = 1 THEN 'temperature' ELSE CASE metric {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in B.METRIC_OF.items())} END END AS metric, tm, ms, ord, value, valid FROM S)"""
_SITE = _MS + f""", BL(water, metric, lo, hi) AS (VALUES {', '.join(f"('{w}', '{m}', {float(by[t][0])}::DOUBLE, {float(by[t][1])}::DOUBLE)" for w, t in D.TIERS.items() for m, by in D.BASELINES.items())}),
P AS (SELECT device AS site, SM.metric, tm, ms, ord, CASE WHEN hi IS NULL THEN value ELSE value * hi / 60 END AS value, lo, hi, {_turns_of(B.PATTERN_OF, 'device')} AS pattern
    FROM SM LEFT JOIN BL ON BL.water = {_turns_of(B.WATERS, 'device')} AND BL.metric = SM.metric WHERE valid)"""
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
_N = "count(*) FILTER (WHERE valid) AS n_samples, count(*) FILTER (WHERE NOT valid) AS excluded_faulted"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _ms(c: str):
    return fn.epoch_ms(F.col(c))


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# Sensor statistics


@query(f"WITH {_W} SELECT device, metric, round(avg(value) FILTER (WHERE valid), 6) AS value, {_N} FROM W GROUP BY ALL")
def sensor_mean_7d(spark, sf_dir):
    return S.aggregate(S.in_window(B.samples(spark, sf_dir), "last 7 days"), "mean").select("device", "metric", *_six("value"), "n_samples", "excluded_faulted")


@query(f"WITH {_W} SELECT device, metric, min(value) FILTER (WHERE valid) AS low, max(value) FILTER (WHERE valid) AS high, {_N} FROM W GROUP BY ALL")
def sensor_minmax(spark, sf_dir):
    s = S.in_window(B.samples(spark, sf_dir), "last 7 days")
    return s.groupBy("device", "metric").agg(S.statistic("min").alias("low"), S.statistic("max").alias("high"), *S.counts())


@query(f"WITH {_S} SELECT device, metric, round(quantile_cont(value, 0.5) FILTER (WHERE valid), 6) AS value, {_N} FROM S GROUP BY ALL")
def sensor_median(spark, sf_dir):
    return S.aggregate(B.samples(spark, sf_dir), "median").select("device", "metric", *_six("value"), "n_samples", "excluded_faulted")


def _edge(name: str):
    def run(spark, sf_dir):
        return S.aggregate(B.samples(spark, sf_dir), name).select("device", "metric", "value", "n_samples", "excluded_faulted", _ms("observed_at").alias("observed_ms"))

    run.__name__ = f"sensor_{name}"
    return run


for _name, _arg, _fn in (("latest", "arg_max", "max"), ("earliest", "arg_min", "min")):
    query(f"WITH {_S} SELECT device, metric, {_arg}(value, {{'a': tm, 'o': ord}}) FILTER (WHERE valid) AS value, {_N}, {_fn}(ms) FILTER (WHERE valid) AS observed_ms FROM S GROUP BY ALL")(_edge(_name))


@query(f"""WITH {_S}, R AS (SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY tm DESC, ord DESC) AS rn, count(*) OVER (PARTITION BY device, metric) AS n FROM S WHERE valid)
SELECT device, metric, ms, ord, value, n AS n_samples, n > 5 AS truncated, least(n, 5) AS kept FROM R WHERE rn <= 5""")
def sensor_raw_cap(spark, sf_dir):
    return S.raw(B.samples(spark, sf_dir), 5).select("device", "metric", _ms("at").alias("ms"), "ord", "value", "n_samples", "truncated", "kept")


@query(f"""WITH {_S}, M AS (SELECT device, metric, arg_max(value, {{'a': tm, 'o': ord}}) FILTER (WHERE valid) AS value, {_N}, max(ms) FILTER (WHERE valid) AS seen FROM S GROUP BY ALL),
G AS (SELECT device, max(n_samples) AS n_most, CASE WHEN count(DISTINCT seen) = 1 THEN max(seen) END AS observed_ms FROM M GROUP BY device)
SELECT device, metric, value, n_samples, excluded_faulted, n_most, observed_ms FROM M JOIN G USING (device)""")
def sensor_all_metrics(spark, sf_dir):
    a = S.all_metrics(B.samples(spark, sf_dir), "latest").select("device", "n_most", _ms("observed_at").alias("observed_ms"), F.explode("metrics").alias("metric", "m"))
    return a.select("device", "metric", "m.value", "m.n_samples", "m.excluded_faulted", "n_most", "observed_ms")


@query(f"""WITH {_S}, M AS (SELECT device, metric, avg(value) FILTER (WHERE valid) AS value, {_N} FROM S GROUP BY ALL)
SELECT device, metric, round(value, 6) AS value, n_samples, excluded_faulted FROM M""")
def sensor_all_means(spark, sf_dir):
    a = S.all_metrics(B.samples(spark, sf_dir), "mean").select("device", F.explode("metrics").alias("metric", "m"))
    return a.select("device", "metric", F.round("m.value", 6).alias("value"), "m.n_samples", "m.excluded_faulted")


@query(f"""WITH {_S}, A AS (SELECT device, max(tm) AS anchor FROM S GROUP BY device), D AS (SELECT DISTINCT device FROM S), M AS (SELECT DISTINCT metric FROM S),
W AS (SELECT S.* FROM S JOIN A USING (device) WHERE tm >= date_trunc('day', anchor) AND tm < date_trunc('day', anchor) + INTERVAL 1 DAY),
G AS (SELECT device, metric, round(avg(value) FILTER (WHERE valid), 6) AS value, {_N} FROM W GROUP BY ALL)
SELECT device, metric, value, coalesce(n_samples, 0) AS n_samples, coalesce(excluded_faulted, 0) AS excluded_faulted FROM D CROSS JOIN M LEFT JOIN G USING (device, metric)""")
def sensor_empty_spine(spark, sf_dir):
    s = B.samples(spark, sf_dir)
    names = [r.metric for r in s.select("metric").distinct().orderBy("metric").collect()]  # a handful of metrics
    spine = s.select("device").distinct().withColumn("metric", F.explode(F.array(*[F.lit(n) for n in names])))
    made = S.aggregate(S.in_window(s, "today"), "mean").select("device", "metric", *_six("value"), "n_samples", "excluded_faulted")
    return S.on_spine(made, spine).select("device", "metric", "value", "n_samples", "excluded_faulted")


@query(f"""WITH {_S}, A AS (SELECT device, max(tm) AS anchor FROM S GROUP BY device),
W AS (SELECT S.* FROM S JOIN A USING (device) WHERE tm >= date_trunc('day', anchor) - INTERVAL 1 DAY AND tm < date_trunc('day', anchor))
SELECT device, metric, max(value) FILTER (WHERE valid) AS value, {_N} FROM W GROUP BY ALL""")
def sensor_calendar_day(spark, sf_dir):
    return S.aggregate(S.in_window(B.samples(spark, sf_dir), "yesterday"), "max")


@query(f"""WITH {_S} SELECT device, metric, min(value) FILTER (WHERE valid) AS value, {_N} FROM S WHERE tm >= TIMESTAMP '2024-01-05' AND tm < TIMESTAMP '2024-01-13' GROUP BY ALL""")
def sensor_absolute_range(spark, sf_dir):
    return S.aggregate(S.in_window(B.samples(spark, sf_dir), "2024-01-05 to 2024-01-12"), "min")


@query(f"""WITH {_S}, A AS (SELECT device, max(tm) AS anchor FROM S GROUP BY device)
SELECT device, metric, arg_max(value, {{'a': tm, 'o': ord}}) FILTER (WHERE valid) AS value, {_N} FROM S JOIN A USING (device) WHERE tm = anchor GROUP BY ALL""")
def sensor_at_anchor(spark, sf_dir):
    return S.aggregate(S.in_window(B.samples(spark, sf_dir), "latest"), "latest").drop("observed_at")


@query(f"""WITH {_S}, A AS (SELECT device, max(tm) AS anchor FROM S GROUP BY device)
SELECT device, metric, count(*) AS n FROM S JOIN A USING (device) WHERE tm >= date_trunc('week', anchor) AND tm < date_trunc('week', anchor) + INTERVAL 7 DAY GROUP BY ALL""")
def sensor_this_week(spark, sf_dir):
    return S.in_window(B.samples(spark, sf_dir), "this week").groupBy("device", "metric").agg(F.count("*").alias("n"))


# Series


def _series_sql(width: int, cap: int = S.MAX_BUCKETS) -> str:
    return f"""WITH {_S}, G AS (SELECT device, metric, (floor(ms / {width}) * {width})::BIGINT AS start_ms, avg(value) AS mean, min(value) AS min, max(value) AS max, count(*) AS n FROM S WHERE valid GROUP BY ALL),
    R AS (SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY start_ms DESC) AS rn FROM G)
    SELECT device, metric, start_ms, start_ms + {width} AS end_ms, round(mean, 6) AS mean, min, max, n FROM R WHERE rn <= {cap}"""


def _series(name: str, width: str):
    def run(spark, sf_dir):
        return S.series(B.samples(spark, sf_dir), width).select("device", "metric", "start_ms", "end_ms", *_six("mean"), "min", "max", "n")

    run.__name__ = name
    return run


for _name, _width in (("series_hour", "hour"), ("series_day", "day"), ("series_week_epoch", "week")):
    query(_series_sql(S.WIDTHS[_width]))(_series(_name, _width))

_LADDER = [int(h * S.HOUR_MS) for h in S.LADDER_HOURS]
_AUTO = f"CASE WHEN span <= 0 THEN {S.HOUR_MS} " + " ".join(f"WHEN span <= {w * S.MAX_BUCKETS} THEN {w}" for w in _LADDER[:-1]) + f" ELSE {_LADDER[-1]} END"


@query(f"""WITH {_S}, X AS (SELECT device, metric, max(ms) - min(ms) AS span FROM S WHERE valid GROUP BY ALL), Y AS (SELECT device, metric, {_AUTO} AS w FROM X),
G AS (SELECT device, metric, w AS width_ms, (floor(ms / w) * w)::BIGINT AS start_ms, avg(value) AS mean, count(*) AS n FROM S JOIN Y USING (device, metric) WHERE valid GROUP BY ALL),
R AS (SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY start_ms DESC) AS rn FROM G)
SELECT device, metric, start_ms, width_ms, round(mean, 6) AS mean, n FROM R WHERE rn <= {S.MAX_BUCKETS}""")
def series_auto_width(spark, sf_dir):
    return S.series(B.samples(spark, sf_dir)).select("device", "metric", "start_ms", "width_ms", *_six("mean"), "n")


@query(f"""WITH {_S}, G AS (SELECT device, metric, (floor(ms / 86400000) * 86400000)::BIGINT AS start_ms FROM S WHERE valid GROUP BY ALL),
R AS (SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY start_ms DESC) AS rn FROM G),
L AS (SELECT *, coalesce((start_ms > lag(start_ms + 86400000) OVER w)::INT, 0) AS gap FROM R WHERE rn <= {S.MAX_BUCKETS} WINDOW w AS (PARTITION BY device, metric ORDER BY start_ms))
SELECT device, metric, start_ms, sum(gap) OVER (PARTITION BY device, metric ORDER BY start_ms)::BIGINT AS segment FROM L""")
def series_gap_segments(spark, sf_dir):
    return S.segments(S.series(B.samples(spark, sf_dir), "day")).select("device", "metric", "start_ms", "segment")


@query(f"WITH {_S} SELECT device, metric, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(*) AS n FROM S WHERE valid GROUP BY ALL")
def weighted_mean_merge(spark, sf_dir):
    return S.weighted_merge(S.series(B.samples(spark, sf_dir), "day")).select("device", "metric", *_six("mean"), "min", "max", "n")


# Reports

_RUNS = _SITE + """, O AS (SELECT *, value < lo OR value > hi AS out FROM P WHERE lo IS NOT NULL AND pattern NOT IN ('diel', 'tidal')),
T AS (SELECT *, (out AND NOT coalesce(lag(out) OVER w, false))::INT AS starts FROM O WINDOW w AS (PARTITION BY site, metric ORDER BY tm, ord)),
U AS (SELECT *, sum(starts) OVER (PARTITION BY site, metric ORDER BY tm, ord) AS run FROM T),
X AS (SELECT site, metric, min(tm) AS s, max(tm) AS e FROM U WHERE out GROUP BY site, metric, run HAVING max(tm) - min(tm) >= INTERVAL 1 HOUR)"""
_MERGED = _RUNS + """, Y AS (SELECT *, coalesce((s > max(e) OVER (PARTITION BY site ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS fresh FROM X),
Z AS (SELECT *, sum(fresh) OVER (PARTITION BY site ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS event FROM Y),
EV AS (SELECT site, min(s) AS s, max(e) AS e FROM Z GROUP BY site, event)"""
_MOVES = _MERGED + """, MV AS (SELECT site, s, e, metric, avg(value) AS mean, min(value) AS mn, max(value) AS mx, min(lo) AS lo, min(hi) AS hi FROM P JOIN EV USING (site) WHERE lo IS NOT NULL AND tm >= s AND tm <= e GROUP BY site, s, e, metric),
MM AS (SELECT *, CASE WHEN mean > hi THEN 'up' WHEN mean < lo THEN 'down' END AS moved FROM MV)"""
_EVENTS = _MOVES + """, K AS (SELECT site, s, e, count(*) AS n_moved, max(moved) FILTER (WHERE metric = 'dissolved_oxygen') AS d, max(moved) FILTER (WHERE metric = 'orp') AS o, max(moved) FILTER (WHERE metric = 'ph') AS p,
    max(moved) FILTER (WHERE metric = 'conductivity') AS c, max(moved) FILTER (WHERE metric = 'turbidity') AS t FROM MM WHERE moved IS NOT NULL GROUP BY site, s, e),
KC AS (SELECT *, CASE WHEN d = 'down' AND o = 'down' AND t = 'up' AND c = 'up' THEN 70 WHEN d = 'down' AND o = 'down' AND t = 'up' THEN 51
    WHEN d = 'down' AND o = 'down' THEN CASE WHEN coalesce(c, '') <> 'up' THEN 60 ELSE CASE WHEN p = 'down' THEN 55 ELSE 30 END END
    WHEN p = 'down' AND c = 'up' THEN 55 WHEN c = 'up' AND d IS NULL AND o IS NULL AND p IS NULL AND t IS NULL THEN 45 WHEN t = 'up' AND c IS NOT NULL THEN 50 WHEN t = 'up' THEN 40
    WHEN c = 'up' OR p IS NOT NULL OR o IS NOT NULL THEN 30 ELSE 20 END AS code FROM K),
EE AS (SELECT site, (epoch_us(s) // 1000) AS start_ms, (epoch_us(e) // 1000) AS end_ms, CASE code WHEN 70 THEN 'Sewage' WHEN 51 THEN 'Sewage' WHEN 60 THEN 'Hypoxia' WHEN 55 THEN 'Acidic input' WHEN 50 THEN 'Stormwater' ELSE 'Inconclusive' END AS type,
    CASE WHEN code = 51 THEN 0.5 ELSE code / 100.0 END::DOUBLE AS confidence, CASE WHEN (epoch_us(e) // 1000) - (epoch_us(s) // 1000) > 43200000 THEN 'High' WHEN (epoch_us(e) // 1000) - (epoch_us(s) // 1000) > 10800000 THEN 'Moderate' ELSE 'Low' END AS severity,
    CASE WHEN code < 60 THEN 'Grab sample' ELSE 'Notify stakeholder' END AS follow_up, n_moved, 0 AS part FROM KC),
DD AS (SELECT site, CAST(tm AS DATE) AS day, min(ms) AS a, max(ms) AS b, min(value) AS mn, max(value) AS mx, min(lo) AS lo, min(hi) AS hi FROM P WHERE metric = 'dissolved_oxygen' AND lo IS NOT NULL AND pattern = 'diel' GROUP BY ALL),
DB AS (SELECT site, min(day) AS day FROM DD WHERE mx > hi AND mn < lo GROUP BY site), PC AS (SELECT site FROM P WHERE metric = 'ph' AND pattern = 'diel' AND lo IS NOT NULL GROUP BY site, hi HAVING max(value) > hi),
BM AS (SELECT site, a AS start_ms, b AS end_ms, 'Algal bloom' AS type, CASE WHEN site IN (SELECT site FROM PC) THEN 0.6 ELSE 0.45 END::DOUBLE AS confidence, 'Moderate' AS severity, 'Grab sample' AS follow_up, 1 AS n_moved, 1 AS part FROM DD JOIN DB USING (site, day)),
EA AS (SELECT * FROM EE UNION ALL SELECT * FROM BM)"""


@query(f"WITH {_RUNS} SELECT site, metric, (epoch_us(s) // 1000) AS start_ms, (epoch_us(e) // 1000) AS end_ms FROM X")
def excursion_windows(spark, sf_dir):
    return R.excursions(B.site_series(spark, sf_dir)).select("site", "metric", _ms("window_start").alias("start_ms"), _ms("window_end").alias("end_ms"))


@query(f"WITH {_MERGED} SELECT site, (epoch_us(s) // 1000) AS start_ms, (epoch_us(e) // 1000) AS end_ms FROM EV")
def interval_merge(spark, sf_dir):
    return R.merged(R.excursions(B.site_series(spark, sf_dir))).select("site", _ms("event_start").alias("start_ms"), _ms("event_end").alias("end_ms"))


@query(f"WITH {_MOVES} SELECT site, (epoch_us(s) // 1000) AS start_ms, metric, round(mean, 6) AS mean, mn AS min, mx AS max, moved FROM MM")
def event_movements(spark, sf_dir):
    p = B.site_series(spark, sf_dir)
    return R.movements(p, R.merged(R.excursions(p)), digits=6).select("site", _ms("event_start").alias("start_ms"), "metric", (F.round(F.col("mean") * 1e6) / 1e6).alias("mean"), "min", "max", "moved")  # rounded as SQL does


@query(f"WITH {_EVENTS} SELECT * FROM EA")
def event_classify(spark, sf_dir):
    e = R.events(B.site_series(spark, sf_dir))
    return e.select("site", _ms("event_start").alias("start_ms"), _ms("event_end").alias("end_ms"), "type", "confidence", "severity", "follow_up", "n_moved", "part")


_ACC = "CASE metric WHEN 'dissolved_oxygen' THEN 0.05 WHEN 'orp' THEN 1.0 WHEN 'ph' THEN 0.002 WHEN 'conductivity' THEN 0.02 * abs({0}) ELSE 0.0 END"
_FLAGS = _SITE + f""", PA AS (SELECT site, metric, min(value) AS mn, max(value) AS mx, avg(value) AS mean, quantile_cont(value, 0.5) AS med, min(lo) AS lo, min(hi) AS hi, min(pattern) AS pattern, min(ms) FILTER (WHERE value < lo OR value > hi) AS first_ms, count(*) AS n FROM P GROUP BY site, metric),
FL AS (SELECT *, CASE WHEN lo IS NULL THEN 'N/A' WHEN mx > hi + greatest((hi - lo) * 0.15, {_ACC.format('mx')}) OR mn < lo - greatest((hi - lo) * 0.15, {_ACC.format('mn')}) THEN 'Exceedance'
    WHEN mx > hi + {_ACC.format('mx')} THEN 'Elevated' WHEN mn < lo - {_ACC.format('mn')} THEN 'Low' ELSE 'Normal' END AS flag FROM PA)"""


@query(f"WITH {_FLAGS} SELECT site, metric, mn AS min, mx AS max, round(mean, 6) AS mean, round(med, 6) AS median, first_ms, n, flag FROM FL")
def param_flags(spark, sf_dir):
    p = R.parameters(B.site_series(spark, sf_dir))
    return p.select("site", "metric", "min", "max", *_six("mean", "median"), _ms("first_excursion").alias("first_ms"), "n", "flag")


@query(f"""WITH {_FLAGS.replace('WITH', '')}, {_EVENTS[len(_SITE) + 2:]}, GR AS (SELECT site, CASE flag WHEN 'Exceedance' THEN 2 WHEN 'Elevated' THEN 1 WHEN 'Low' THEN 1 ELSE 0 END AS g FROM FL UNION ALL SELECT site, CASE severity WHEN 'High' THEN 2 ELSE 1 END FROM EA)
SELECT site, CASE max(g) WHEN 2 THEN 'Action Required' WHEN 1 THEN 'Watch' ELSE 'Normal' END AS status FROM GR GROUP BY site""")
def overall_status(spark, sf_dir):
    p = B.site_series(spark, sf_dir)
    return R.status(R.parameters(p), R.events(p))


@query(f"""WITH {_SITE}, D AS (SELECT site, metric, CAST(tm AS DATE) AS day, min(value) AS mn, max(value) AS mx, min(lo) AS lo, min(hi) AS hi FROM P WHERE lo IS NOT NULL GROUP BY site, metric, day)
SELECT site, metric, min(day)::VARCHAR AS day, arg_min(mn, day) AS min, arg_min(mx, day) AS max FROM D WHERE mx > hi AND mn < lo GROUP BY site, metric""")
def daily_swing(spark, sf_dir):
    return R.daily_swings(B.site_series(spark, sf_dir)).select("site", "metric", F.col("day").cast("string").alias("day"), "min", "max")


# Retrieval and corpus

_QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
_VEC = "[" + ", ".join(map(repr, _QUERY_VECTOR)) + "]"


def _vector(spark, sf_dir, k):
    return V.cosine_top_k(B.table(spark, sf_dir, "embeddings"), _QUERY_VECTOR, k)


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VEC}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_VEC}::DOUBLE[]) DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return _vector(spark, sf_dir, V.MOST_K).select("vec_id", *_six("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VEC}::DOUBLE[]), 6) AS score FROM embeddings WHERE embedding IS NOT NULL ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_VEC}::DOUBLE[]) DESC, vec_id LIMIT 20")
def vector_topk_nonnull(spark, sf_dir):
    return _vector(spark, sf_dir, V.PER_BRANCH).select("vec_id", *_six("score"))


_QUESTION = "What is the ontion of thered?"
_LEX = """T AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w IN ('ontion', 'thered')) AS f FROM documents),
L AS (SELECT doc_id, len(list_distinct(f)) AS matched, len(f) AS hits FROM T WHERE len(f) > 0 ORDER BY matched DESC, hits DESC, doc_id LIMIT 20)"""


@query(f"WITH {_LEX} SELECT doc_id, matched::INT AS matched, hits::INT AS hits FROM L")
def lexical_topk(spark, sf_dir):
    return V.lexical_top_k(B.table(spark, sf_dir, "documents"), _QUESTION)


@query(f"""WITH {_LEX}, B1 AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_VEC}::DOUBLE[]) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20)),
B2 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY matched DESC, hits DESC, doc_id) AS r FROM L), U AS (SELECT id, r, 0 AS b FROM B1 UNION ALL SELECT id, r, 1 FROM B2),
F AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score, min({{'b': b, 'r': r}}) AS f FROM U GROUP BY id) SELECT id, round(score, 6) AS score FROM F ORDER BY F.score DESC, f LIMIT 10""")
def rrf_fuse(spark, sf_dir):
    dense = V.ranked(_vector(spark, sf_dir, V.PER_BRANCH), F.col("score").desc(), "vec_id").withColumnRenamed("vec_id", "id")
    lexical = V.ranked(V.lexical_top_k(B.table(spark, sf_dir, "documents"), _QUESTION), F.col("matched").desc(), F.col("hits").desc(), "doc_id").withColumnRenamed("doc_id", "id")
    return V.fuse([dense, lexical], "id", 10).select("id", *_six("score"))


def _corpus(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return d.select("doc_id", name.alias("filename"), F.col("source").alias("title"), "text", F.length("text").cast("long").alias("chars"), F.col("source").isin(*B.SLICE).alias("in_slice"))


_IN_SLICE = f"source IN ({', '.join(repr(s) for s in B.SLICE)})"


@query(f"SELECT 'doc-' || lpad(doc_id::VARCHAR, 12, '0') AS filename, source AS title, text FROM documents WHERE {_IN_SLICE}")
def slice_feed(spark, sf_dir):
    return V.slice_feed(_corpus(spark, sf_dir), _QUESTION)


@query("""SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / length(text) END, 6) AS ratio,
length(text) >= 100 AND length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / length(text) >= 0.5 AND NOT contains(lower(text), 'adobe acrobat') AND NOT contains(lower(text), 'acrobat reader') AND NOT contains(lower(text), 'click here to download') AS good FROM documents""")
def chunk_quality(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", F.round(fn.alpha_ratio(F.col("text")), 6).alias("ratio"), fn.good_chunk(F.col("text")).alias("good"))


@query()
def chunk_text(spark, sf_dir):
    return C.chunked(B.table(spark, sf_dir, "documents"))


@query(f"SELECT count(*) AS documents, sum(length(text))::BIGINT AS chars, coalesce(sum(length(text)) FILTER (WHERE {_IN_SLICE}), 0)::BIGINT AS slice_chars, floor(coalesce(sum(length(text)) FILTER (WHERE {_IN_SLICE}), 0) / 4 + 0.5)::BIGINT AS slice_tokens FROM documents")
def corpus_summary(spark, sf_dir):
    return C.summary(_corpus(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def load_once_anti(spark, sf_dir):
    return C.new_only(B.table(spark, sf_dir, "documents").select("doc_id"), B.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 100)")
def insert_new_rows(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return C.insert_new(e, e.filter("value > 100"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("""WITH F AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL) SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY f, role)::INT AS place FROM F""")
def citations_distinct(spark, sf_dir):
    return E.distinct_citations(B.table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


# Evaluation

_TURNS = """U AS (SELECT conv_id, turn, role, text, length(text) AS n, CASE WHEN role = 'assistant' THEN length(text) // 2 END AS cached, length(text) // 4 AS comp, CASE WHEN length(text) % 17 = 0 THEN 'failed' END AS error FROM conversations)"""
_TOTALS = _TURNS + ", T AS (SELECT conv_id, count(*) AS turns, sum(n)::BIGINT AS prompt_tokens, sum(cached)::BIGINT AS cached_tokens, sum(comp)::BIGINT AS completion_tokens, count(error) AS failed FROM U GROUP BY conv_id)"


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def history_trim(spark, sf_dir):
    return E.trimmed(B.table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("""WITH C AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')), H AS (SELECT *, count(*) OVER w AS n_before, string_agg(role, ',') OVER w AS roles FROM C WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, n_before::INT AS n_before, coalesce(roles, '') AS roles FROM H WHERE role = 'user'""")
def turn_history(spark, sf_dir):
    h = E.with_history(B.table(spark, sf_dir, "conversations"))
    return h.select("conv_id", "turn", F.size("history").alias("n_before"), F.array_join("history.role", ",").alias("roles"))


@query(f"""WITH {_TURNS}, E AS (SELECT *, coalesce(max(CASE WHEN error IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM U) SELECT conv_id, turn FROM E WHERE earlier = 0""")
def turns_until_failure(spark, sf_dir):
    return E.until_failure(B.turns(spark, sf_dir)).select("conv_id", "turn")


@query(f"WITH {_TOTALS} SELECT * FROM T")
def transcript_totals(spark, sf_dir):
    return E.transcript_totals(B.turns(spark, sf_dir))


@query(f"""WITH {_TOTALS}, Q AS (SELECT count(*) AS transcripts, sum(turns)::BIGINT AS turns, sum(failed)::BIGINT AS failed, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(cached_tokens)::BIGINT AS cached_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM T)
SELECT *, round(cached_tokens / prompt_tokens, 6) AS cache_hit_rate, concat_ws('; ', CASE WHEN cached_tokens IS NULL THEN 'cache figures unreported' END, CASE WHEN failed > 0 THEN failed || ' turns failed' END) AS warnings FROM Q""")
def sweep_summary(spark, sf_dir):
    s = E.sweep_summary(E.transcript_totals(B.turns(spark, sf_dir)))
    return s.withColumn("cache_hit_rate", F.round("cache_hit_rate", 6))


_ARMS = "AR(ord, arm, p, c, o, e, ip, cp, op, ep, ds, fx) AS (VALUES " + ", ".join(f"({a[0]}, '{a[1]}', {', '.join(map(str, a[2:6]))}, {', '.join(f'{x!r}::DOUBLE' for x in a[6:])})" for a in E.ARMS) + ")"
_COST = _ARMS + ", CO AS (SELECT ord, arm, fx, (p - c) * ip / 1e6 AS input_usd, c * cp / 1e6 AS cached_usd, o * op / 1e6 AS output_usd, e * ep / 1e6 AS embedding_usd, ds AS datastore_usd FROM AR), CT AS (SELECT *, input_usd + cached_usd + output_usd + embedding_usd + datastore_usd AS total_usd FROM CO)"


@query(f"WITH {_COST} SELECT arm, round(input_usd, 9) AS input_usd, round(cached_usd, 9) AS cached_usd, round(output_usd, 9) AS output_usd, round(embedding_usd, 9) AS embedding_usd, round(total_usd, 9) AS total_usd FROM CT")
def cost_per_request(spark, sf_dir):
    return E.request_costs(E.arms(spark)).select("arm", *[F.round(c, 9).alias(c) for c in ("input_usd", "cached_usd", "output_usd", "embedding_usd", "total_usd")])


@query(f"WITH {_COST} SELECT arm, v AS requests, round(total_usd * v + fx, 6) AS usd FROM CT CROSS JOIN (SELECT unnest({list(E.VOLUMES)}) AS v)")
def cost_curve(spark, sf_dir):
    return E.cost_curve(E.request_costs(E.arms(spark))).select("arm", "requests", *_six("usd"))


@query(f"""WITH {_COST}, PR AS (SELECT a.arm AS a, b.arm AS b, a.total_usd - b.total_usd AS g, b.fx - a.fx AS f FROM CT a JOIN CT b ON a.ord < b.ord),
KD AS (SELECT *, CASE WHEN g = 0 AND f = 0 THEN 'identical' WHEN g = 0 OR f / g <= 0 THEN 'dominated' ELSE 'crossover' END AS kind FROM PR)
SELECT a, b, kind, CASE WHEN kind = 'crossover' THEN round(f / g, 3) END AS requests, CASE WHEN kind = 'crossover' THEN CASE WHEN g > 0 THEN a ELSE b END END AS cheaper_below, CASE WHEN kind = 'crossover' THEN CASE WHEN g > 0 THEN b ELSE a END END AS cheaper_above,
CASE WHEN kind = 'dominated' THEN CASE WHEN (g = 0 AND f < 0) OR g > 0 THEN b ELSE a END END AS cheaper FROM KD""")
def break_even(spark, sf_dir):
    return E.break_even(E.request_costs(E.arms(spark))).withColumn("requests", F.round("requests", 3))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id)::INT AS round FROM documents")
def stratified_sample(spark, sf_dir):
    return E.round_robin(B.table(spark, sf_dir, "documents"), "source", F.length("text"), "doc_id").select("doc_id", "source", "round")


# Devices

_DEV = "DV AS (SELECT c_custkey AS key, c_mktsegment || ' Pod ' || c_nationkey AS name, 'dev:' || (c_custkey % 1000) AS label, {env} AS environment, c_custkey * 2 + copy AS ord FROM customer CROSS JOIN (SELECT unnest([0, 1]) AS copy))".replace("{env}", _turns_of(B.ENVIRONMENTS, "c_custkey"))


@query(f"WITH {_DEV} SELECT label, arg_min(key, ord) AS key, min(ord) AS ord FROM DV GROUP BY label")
def registry_dedupe(spark, sf_dir):
    return G.first_by_label(B.devices(spark, sf_dir)).select("label", "key", "ord")


_ASKED = (" DEV:17 ", "machinery pod 4", "hp", "old pod 1", "building p", "m", "f", "zz", "fu", "h")


def _match_sql(q: str) -> str:
    n, i = "lower(trim(name))", "lower(name[1] || 'p')"  # names have two words that start with a letter
    tiers = [f"lower(trim(label)) = '{q}'", f"{n} = '{q}'", f"{i} = '{q}'", f"length('{q}') >= 3 AND contains({n}, '{q}')", f"length('{q}') >= 2 AND starts_with({i}, '{q}')"]
    case = "CASE " + " ".join(f"WHEN {t} THEN {k}" for k, t in enumerate(tiers, 1)) + " END"
    return f"SELECT '{q}' AS asked, key, tier FROM (SELECT DISTINCT key, {case} AS tier, min({case}) OVER () AS best FROM DV) WHERE tier = best"


@query(f"WITH {_DEV} " + " UNION ALL ".join(_match_sql(q.strip().lower()) for q in _ASKED))
def device_match(spark, sf_dir):
    """Each tier of matching, and questions that reach none."""
    d, out = B.devices(spark, sf_dir), None
    for q in _ASKED:
        found = G.matches(d, q).select(F.lit(q.strip().lower()).alias("asked"), "key", "tier").distinct()
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""WITH {_S}, N AS (SELECT max(ms) AS now FROM S), L AS (SELECT device, max(ms) AS last FROM S GROUP BY device), A AS (SELECT c_custkey AS device, CASE WHEN c_custkey % 11 = 0 THEN 'soon' ELSE {_ISO.format('make_timestamp(last * 1000)')} END AS iso, last, now - last AS age FROM customer CROSS JOIN N LEFT JOIN L ON device = c_custkey)
SELECT device, CASE WHEN iso IS NULL THEN 'No readings on record' WHEN iso = 'soon' THEN 'Last reading time unavailable' WHEN age < 60000 THEN 'Reporting · just now' WHEN age < 86400000 THEN 'Reporting · ' || CASE WHEN floor(age / 60000 + 0.5) < 60 THEN floor(age / 60000 + 0.5)::BIGINT || ' min ago' ELSE floor(age / 3600000 + 0.5)::BIGINT || ' h ago' END
ELSE 'Silent since ' || strftime(make_timestamp(last * 1000), '%b %-d') END AS class,
CASE WHEN iso IS NULL OR iso = 'soon' THEN NULL WHEN age < 60000 THEN 'just now' WHEN floor(age / 60000 + 0.5) < 60 THEN floor(age / 60000 + 0.5)::BIGINT || ' min ago' WHEN floor(age / 3600000 + 0.5) < 48 THEN floor(age / 3600000 + 0.5)::BIGINT || ' h ago' ELSE floor(age / 86400000 + 0.5)::BIGINT || ' days ago' END AS age FROM A""")
def freshness_class(spark, sf_dir):
    s = B.samples(spark, sf_dir)
    now = s.agg(F.max("at").alias("now"))
    d = G.with_last_reading(B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device")), s).join(F.broadcast(now))  # one row is broadcast
    iso = F.when(F.col("device") % 11 == 0, "soon").otherwise(fn.iso_instant(F.col("last_at")))
    age = F.when(iso.try_cast("timestamp").isNotNull(), fn.age_label(fn.epoch_ms(F.col("now")) - fn.epoch_ms(F.col("last_at"))))
    return d.select("device", fn.freshness(iso, F.col("now")).alias("class"), age.alias("age"))


@query(f"WITH {_S} SELECT device, arg_max(metric, {{'a': tm, 'o': ord}}) AS metric, max(ms) AS ms, arg_max(value, {{'a': tm, 'o': ord}}) AS value, arg_max(valid, {{'a': tm, 'o': ord}}) AS valid FROM S GROUP BY device")
def last_reading(spark, sf_dir):
    return G.latest(B.samples(spark, sf_dir)).select("device", "metric", _ms("at").alias("ms"), "value", "valid")


@query("""WITH D AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-02-' || lpad((doc_id % 32)::VARCHAR, 2, '0') WHEN 1 THEN '2024-2-' || (doc_id % 28) WHEN 2 THEN '2023-02-29' ELSE 'n/a' END AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(t AS DATE)::VARCHAR END AS day FROM D""")
def strict_iso_date(spark, sf_dir):
    i = F.col("doc_id")
    t = F.when(i % 4 == 0, F.concat(F.lit("2024-02-"), F.lpad((i % 32).cast("string"), 2, "0"))).when(i % 4 == 1, F.concat(F.lit("2024-2-"), (i % 28).cast("string"))).when(i % 4 == 2, "2023-02-29").otherwise("n/a")
    return B.table(spark, sf_dir, "documents").select("doc_id", fn.strict_date(t).cast("string").alias("day"))


@query("SELECT s_suppkey, greatest(least(round(sqrt(s_suppkey)), 100), 10)::INT AS lists FROM supplier")
def index_lists(spark, sf_dir):
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", C.index_lists(F.col("s_suppkey")).alias("lists"))


@query("SELECT vec_id, embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings")
def embedding_guard(spark, sf_dir):
    return B.table(spark, sf_dir, "embeddings").select("vec_id", fn.array_cosine_guard(F.col("embedding"), 64).alias("usable"))


@query("SELECT doc_id, regexp_replace(source || '/' || lang || '.md', '[^A-Za-z0-9_-]', '_', 'g') || '__' || CASE WHEN doc_id < 10000 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE doc_id::VARCHAR END AS chunk_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def chunk_ids(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    return d.select("doc_id", fn.chunk_id(F.concat("source", F.lit("/"), "lang", F.lit(".md")), F.col("doc_id")).alias("chunk_id"))


# One call from question to answer


_NOW = "TIMESTAMP '2024-02-15 00:00:00'"


def _answers(spark, sf_dir, question):
    """Some customers as the fleet, devices without readings among them."""
    from datetime import datetime, timedelta, timezone

    fleet = B.devices(spark, sf_dir).filter("copy = 0").select(F.col("key").alias("device"), "label", "environment")
    now = datetime(2024, 2, 15, tzinfo=timezone.utc)
    a = Q.answers(B.metric_samples(spark, sf_dir), fleet, question, now=now, longest=timedelta(days=20))
    a = Q.notices(a, F.lit(now).cast("timestamp"))
    return a.select("device", "label", "metric", "unit", *_six("value"), "n_samples", "excluded_faulted", *[_ms(c).alias(f"{c[:-3] if c.endswith('_at') else c}_ms") for c in ("observed_at", "range_start", "range_end", "covered_from", "last_reported")], "range_label", "complete", "note", F.array_join("notices", "|").alias("notices"))


def _answers_sql(metrics: list[str], value: str, observed: str, start: str, end: str, inclusive: bool, label: str) -> str:
    units = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{u or Q.UNITLESS}'" for m, _, _, u, _ in D.METRICS) + " END"
    env = _turns_of(B.ENVIRONMENTS, "c_custkey")
    age = "CASE WHEN age < 60000 THEN 'just now' WHEN floor(age / 60000 + 0.5) < 60 THEN floor(age / 60000 + 0.5)::BIGINT || ' min ago' WHEN floor(age / 3600000 + 0.5) < 48 THEN floor(age / 3600000 + 0.5)::BIGINT || ' h ago' ELSE floor(age / 86400000 + 0.5)::BIGINT || ' days ago' END"
    return f"""WITH {_MS}, A AS (SELECT device, max(tm) AS anchor FROM S GROUP BY device), RG AS (SELECT device, anchor, {start} AS st, {end} AS en FROM A),
    W AS (SELECT SM.* FROM SM JOIN RG USING (device) WHERE tm >= st AND tm {'<=' if inclusive else '<'} en AND metric IN ({', '.join(repr(m) for m in metrics)})),
    G AS (SELECT device, metric, {value} AS value, {observed} AS observed_ms, {_N} FROM W GROUP BY device, metric),
    F AS (SELECT c_custkey AS device, 'dev:' || (c_custkey % 1000) AS label, {env} AS environment, unnest([{', '.join(repr(m) for m in metrics)}]) AS metric FROM customer),
    R AS (SELECT device, label, environment, metric, value, coalesce(n_samples, 0) AS n_samples, coalesce(excluded_faulted, 0) AS excluded_faulted, observed_ms, anchor, st, en, greatest(st, {_NOW} - INTERVAL 20 DAY) AS cf, epoch_ms({_NOW}) - epoch_us(anchor) // 1000 AS age FROM F LEFT JOIN G USING (device, metric) LEFT JOIN RG USING (device)),
    T AS (SELECT *, sum(n_samples) OVER (PARTITION BY device) AS total FROM R),
    N AS (SELECT *, CASE WHEN anchor IS NULL THEN 'No readings found, and the device API has no last reading for this device either.' ELSE nullif(concat_ws(' ', CASE WHEN total = 0 THEN 'No readings fall inside ' || {_ISO.format('st')} || ' to the end of the requested range. This device''s most recent reading is ' || {_ISO.format('anchor')} || '.' END,
        {"'" + Q.PROVISIONAL + "'" if 'turbidity' in metrics else 'NULL'}, CASE WHEN environment <> '' AND contains(environment, 'salt') THEN 'This device operates in ' || environment || ', but the deployment''s configured water type is freshwater. The normal ranges in your instructions are for freshwater; say so if you compare this reading against them.' END), '') END AS note FROM T)
    SELECT device, label, metric, {units} AS unit, round(value, 6) AS value, n_samples, excluded_faulted, observed_ms, epoch_us(st) // 1000 AS range_start_ms, epoch_us(en) // 1000 AS range_end_ms, epoch_us(cf) // 1000 AS covered_from_ms, epoch_us(anchor) // 1000 AS last_reported_ms,
    CASE WHEN anchor IS NOT NULL THEN '{label}' END AS range_label, cf = st AS complete, note, concat_ws('|', CASE WHEN n_samples = 0 THEN CASE WHEN anchor IS NULL THEN 'No readings in this window · no last reading on record for this pod' WHEN age > 86400000 THEN 'No readings in this window · pod silent since ' || strftime(anchor, '%Y-%m-%d')
        ELSE 'No readings in this window · pod last reported ' || {age} END WHEN age > 86400000 THEN 'Window anchored to the pod''s last reading, ' || strftime(anchor, '%Y-%m-%d') || ' — not to today' END,
        CASE WHEN cf <> st THEN 'Search did not reach that far back — covered ' || strftime(cf, '%Y-%m-%d') || ' onward, not ' || strftime(st, '%Y-%m-%d') END, CASE WHEN metric = 'turbidity' AND contains(note, 'provisional, uncalibrated') THEN 'Turbidity provisional — a relative index, not a calibrated measurement' END) AS notices FROM N"""


_ALL = [m for m, *_ in D.METRICS]


@query(_answers_sql(_ALL, "avg(value) FILTER (WHERE valid)", "NULL::BIGINT", "anchor - INTERVAL 7 DAY", "anchor", True, "last 7 days"))
def ask_all_week(spark, sf_dir):
    return _answers(spark, sf_dir, Q.SensorQuestion("all", "last 7 days", "mean"))


@query(_answers_sql(["dissolved_oxygen"], "arg_max(value, {'a': tm, 'o': ord}) FILTER (WHERE valid)", "max(ms) FILTER (WHERE valid)", "anchor", "anchor", True, "latest"))
def ask_latest(spark, sf_dir):
    return _answers(spark, sf_dir, Q.SensorQuestion(" DO", "latest", "latest"))


@query(_answers_sql(["turbidity"], "max(value) FILTER (WHERE valid)", "NULL::BIGINT", "date_trunc('day', anchor)", "date_trunc('day', anchor) + INTERVAL 1 DAY", False, "today"))
def ask_today(spark, sf_dir):
    return _answers(spark, sf_dir, Q.SensorQuestion("turbidity", "today", "max"))


@query(_answers_sql(["ph"], "quantile_cont(value, 0.5) FILTER (WHERE valid)", "NULL::BIGINT", "TIMESTAMP '2024-01-10'", "TIMESTAMP '2024-01-13'", False, "2024-01-10 to 2024-01-12"))
def ask_absolute(spark, sf_dir):
    return _answers(spark, sf_dir, Q.SensorQuestion("ph", "2024-01-10 to 2024-01-12", "median"))


@query(f"""WITH {_MS}, V AS (SELECT * FROM SM WHERE valid AND metric = 'orp' AND tm >= TIMESTAMP '2024-01-10' AND tm < TIMESTAMP '2024-01-13'), G AS (SELECT device, (floor(ms / 86400000) * 86400000)::BIGINT AS start_ms, avg(value) AS mean, count(*) AS n FROM V GROUP BY ALL) SELECT device, start_ms, round(mean, 6) AS mean, n, 86400000 AS bucket_ms FROM G JOIN customer ON c_custkey = device""")
def ask_series(spark, sf_dir):
    fleet = B.devices(spark, sf_dir).filter("copy = 0").select(F.col("key").alias("device"), "label", "environment")
    a = Q.answers(B.metric_samples(spark, sf_dir), fleet, Q.SensorQuestion("orp", "2024-01-10 to 2024-01-12", "series", bucket="day"))
    return a.select("device", "bucket_ms", F.inline("series")).select("device", "start_ms", *_six("mean"), "n", F.col("bucket_ms").cast("int"))


# Joins, orders and rules that complete the inventory


@query(f"""WITH {_MS}, G AS (SELECT device, metric, max(value) AS hi, avg(value) AS mean FROM SM WHERE valid AND metric IN ('dissolved_oxygen', 'temperature') GROUP BY ALL),
H AS (SELECT device, metric, CASE WHEN metric = 'temperature' THEN CASE WHEN hi <= 40 THEN 'looks like °C, not °F' END WHEN mean > 20 THEN 'looks like % saturation, not mg/L' WHEN mean < 5 OR mean > 14 THEN 'outside the operator range' END AS hint FROM G) SELECT * FROM H WHERE hint IS NOT NULL""")
def unit_hints(spark, sf_dir):
    return S.unit_hints(B.metric_samples(spark, sf_dir))


@query("""WITH H AS (SELECT conv_id, list({'r': role, 'c': text} ORDER BY turn) AS h FROM conversations GROUP BY conv_id), Q AS (SELECT conv_id, h, CASE WHEN conv_id % 5 = 0 THEN ' ' ELSE 'how is it?' END AS q, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN repeat('x', 121) ELSE 'pod' END AS d FROM H)
SELECT conv_id, coalesce(array_to_string(list_concat([CASE WHEN trim(q) = '' THEN '"query" is required and must be a non-empty string.' END, CASE WHEN trim(d) = '' THEN '"device" must be a non-empty string when provided.' END, CASE WHEN length(trim(d)) > 120 THEN '"device" must be at most 120 characters.' END],
list_concat(list_transform(h, lambda x, i: CASE WHEN x.r NOT IN ('user', 'assistant') THEN '"history[' || (i - 1) || ']".role must be one of [user, assistant].' END), list_transform(h, lambda x, i: CASE WHEN trim(x.c) = '' THEN '"history[' || (i - 1) || ']".content must be a non-empty string.' END))), '|'), '') AS errors FROM Q""")
def request_checks(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    i = F.col("conv_id")
    device = F.when(i % 4 == 1, " ").when(i % 4 == 2, F.repeat(F.lit("x"), 121)).when(i % 4 == 3, "pod")
    r = c.select("conv_id", F.when(i % 5 == 0, " ").otherwise("how is it?").alias("query"), device.alias("device"), F.transform("h", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("history"))
    return E.request_errors(r).select("conv_id", F.array_join("errors", "|").alias("errors"))


@query(f"""WITH {_S}, G AS (SELECT device, metric, (floor(ms / 86400000) * 86400000)::BIGINT AS b FROM S WHERE valid GROUP BY ALL),
D AS (SELECT device, metric, b - lag(b) OVER (PARTITION BY device, metric ORDER BY b) AS d FROM G), L AS (SELECT device, metric, list_sort(list(d)) AS ds FROM D WHERE d IS NOT NULL GROUP BY ALL)
SELECT device, metric, ds[(len(ds) // 2 + 1)::INT] AS spacing_ms FROM L""")
def series_upper_median_spacing(spark, sf_dir):
    return S.spacing(S.series(B.samples(spark, sf_dir), "day", 1 << 30))


@query(f"""WITH {_S}, G AS (SELECT device, metric, floor(ms / 86400000) AS b, avg(value) AS mean, min(value) AS mn, max(value) AS mx FROM S WHERE valid GROUP BY ALL),
T AS (SELECT device, metric, arg_min(mean, b) AS f, arg_max(mean, b) AS l, max(mx) - min(mn) AS spread FROM G GROUP BY ALL)
SELECT device, metric, CASE WHEN spread > 0 AND abs(l - f) >= 0.1 * spread THEN CASE WHEN l > f THEN 'rises' ELSE 'falls' END ELSE 'stays' END AS trend FROM T""")
def series_trend(spark, sf_dir):
    return S.trend(S.series(B.samples(spark, sf_dir), "day", 1 << 30)).select("device", "metric", "trend")


@query(f"""WITH {_S}, G AS (SELECT device, metric, (floor(ms / 86400000) * 86400000)::BIGINT AS start_ms, avg(value) AS mean, min(value) AS mn, max(value) AS mx, count(*) AS n FROM S WHERE valid GROUP BY ALL),
R AS (SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY start_ms DESC) AS rn FROM G), K AS (SELECT *, CASE WHEN n = 1 THEN start_ms ELSE start_ms + 86400000 END AS end_ms FROM R WHERE rn <= {S.MAX_BUCKETS})
SELECT device, metric, start_ms, CASE WHEN end_ms > start_ms THEN (start_ms + end_ms) / 2 ELSE start_ms END::DOUBLE AS mid_ms, round(mean, 6) AS mean, mn AS min, mx AS max, buckets FROM (SELECT *, count(*) OVER (PARTITION BY device, metric) AS buckets FROM K) WHERE buckets >= 3""")
def chart_buckets(spark, sf_dir):
    b = S.series(B.samples(spark, sf_dir), "day").withColumn("end_ms", F.when(F.col("n") == 1, F.col("start_ms")).otherwise(F.col("end_ms")))
    return S.plottable(b).select("device", "metric", "start_ms", "mid_ms", *_six("mean"), "min", "max", "buckets")


@query(f"""WITH {_S}, G AS (SELECT device, metric, (floor(ms / 86400000) * 86400000)::BIGINT AS start_ms FROM S WHERE valid GROUP BY ALL),
R AS (SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY start_ms DESC) AS rn FROM G),
L AS (SELECT *, coalesce((start_ms - lag(start_ms) OVER w > 1.5 * 86400000)::INT, 0) AS gap FROM R WHERE rn <= {S.MAX_BUCKETS} WINDOW w AS (PARTITION BY device, metric ORDER BY start_ms))
SELECT device, metric, start_ms, sum(gap) OVER (PARTITION BY device, metric ORDER BY start_ms)::BIGINT AS segment FROM L""")
def series_segments_by_step(spark, sf_dir):
    """Buckets without an end part where they are more than one and a half steps apart."""
    b = S.series(B.samples(spark, sf_dir), "day").withColumn("end_ms", F.col("start_ms"))
    return S.segments(b, step_ms=F.lit(S.WIDTHS["day"])).select("device", "metric", "start_ms", "segment")


@query(f"""WITH {_W}, H AS (SELECT *, bool_and(valid) OVER (PARTITION BY device, tm) AS healthy FROM W) SELECT device, metric, round(avg(value), 6) AS mean, count(*) AS n FROM H WHERE healthy GROUP BY ALL""")
def healthy_averages(spark, sf_dir):
    return S.healthy_averages(S.in_window(B.samples(spark, sf_dir), "last 7 days")).select("device", "metric", *_six("mean"), "n")


@query(f"""WITH {_W}, C AS (SELECT *, date_trunc('day', tm) AS t FROM W WHERE device < 20), H AS (SELECT *, bool_and(valid) OVER (PARTITION BY device, t) AS healthy FROM C) SELECT device, metric, round(avg(value), 6) AS mean, count(*) AS n FROM H WHERE healthy GROUP BY ALL""")
def healthy_averages_of_devices(spark, sf_dir):
    """Readings of a day as one row, of some devices."""
    s = S.in_window(B.samples(spark, sf_dir), "last 7 days", list(range(20))).withColumn("at", F.date_trunc("day", "at"))
    return S.healthy_averages(s, list(range(20))).select("device", "metric", *_six("mean"), "n")


@query(f"""WITH {_S} SELECT DISTINCT device, epoch_us(date_trunc('hour', tm)) // 1000 AS ms FROM S WHERE NOT valid""")
def faulted_rows(spark, sf_dir):
    return S.faulted_rows(B.samples(spark, sf_dir).withColumn("at", F.date_trunc("hour", "at"))).select("device", _ms("at").alias("ms"))


@query("SELECT DISTINCT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(spark, sf_dir):
    s, n, r = (B.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("SELECT conv_id FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id HAVING count(DISTINCT role) = 3")
def complete_groups(spark, sf_dir):
    t = B.table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant', 'system')")
    return E.complete_only(t.select(F.col("conv_id").alias("fixture_id"), F.col("role").alias("arm")), 3).withColumnRenamed("fixture_id", "conv_id")


@query("""WITH N AS (SELECT max(turn) + 2 AS n FROM conversations), SP AS (SELECT DISTINCT conv_id, unnest(range(0, n)) AS turn FROM conversations CROSS JOIN N) SELECT conv_id, turn, coalesce(role, 'missing') AS role FROM SP LEFT JOIN conversations USING (conv_id, turn)""")
def captured_or_placeholder(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    last = c.agg((F.max("turn") + 1).alias("last"))
    spec = c.select("conv_id").distinct().join(F.broadcast(last)).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("turn"))  # one row is broadcast
    return E.captured(spec, c, ["conv_id", "turn"], "role")


@query("SELECT conv_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars, count(DISTINCT role) AS sources FROM conversations GROUP BY conv_id")
def context_size(spark, sf_dir):
    return E.context_size(B.contexts(spark, sf_dir), ["conv_id"], "text", "source")


@query("""SELECT 'query' AS name, '{"device":"' || user_id || '","metric":"' || event_type || '"}' AS arguments, count(*) AS calls, count(*) - 1 AS repeats FROM events GROUP BY user_id, event_type""")
def repeated_calls(spark, sf_dir):
    return E.repeated_calls(B.calls(spark, sf_dir), "name", F.col("arguments"))


@query("""SELECT conv_id, 'CONTEXT — excerpts from the water-quality corpus:' || chr(10) || chr(10) || string_agg('[' || rn || '] (source: ' || role || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id""")
def rendered_context(spark, sf_dir):
    return V.rendered(B.contexts(spark, sf_dir), ["conv_id"])


@query(f"""SELECT doc_id, source AS title, 'doc-' || lpad(doc_id::VARCHAR, 12, '0') AS cited FROM documents JOIN labels USING (doc_id)""")
def chunks_with_documents(spark, sf_dir):
    d = _corpus(spark, sf_dir).withColumn("source_url", F.lit(None).cast("string"))
    chunks = d.join(B.table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", "filename")
    return V.with_documents(chunks, d.select("filename", "title", "source_url")).select("doc_id", "title", F.col("source").alias("cited"))


@query("""SELECT c_custkey::VARCHAR AS id, c_name AS name, 'dev:' || c_custkey AS label FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def registry_of_organization(spark, sf_dir):
    return G.registered(B.registry_rows(spark, sf_dir), "MACHINERY").select("id", "name", "label")


@query("""SELECT DISTINCT c_custkey AS key FROM customer WHERE contains(lower(c_mktsegment || ' Pod ' || c_nationkey || ' dev:' || (c_custkey % 1000)), 'pod 7') OR contains(lower(c_mktsegment || ' Pod ' || c_nationkey || ' dev:' || (c_custkey % 1000)), 'dev:11')""")
def devices_matching_any(spark, sf_dir):
    return G.matching_any(B.devices(spark, sf_dir), ["Pod 7", "DEV:11"]).select("key").distinct()


@query(f"""WITH {_DEV} SELECT DISTINCT key, CASE environment WHEN '' THEN NULL ELSE CASE WHEN contains(lower(environment), 'salt') THEN 'saltwater' ELSE 'freshwater' END END AS water,
CASE WHEN contains(lower(environment), 'salt') THEN upper(environment[1]) || environment[2:] || ' pod · thresholds are freshwater' END AS badge FROM DV""")
def water_badges(spark, sf_dir):
    d = Q.device_kinds(B.devices(spark, sf_dir))
    return d.select("key", "water", fn.mismatch(F.col("environment"), F.lit("freshwater")).alias("badge")).distinct()


@query("SELECT doc_id, CASE WHEN contains(lower(source), '1') THEN 'Marine' WHEN contains(lower(source), 'src') THEN 'Freshwater' ELSE 'Brackish' END AS water FROM documents")
def water_types(spark, sf_dir):
    environment = F.regexp_replace(F.regexp_replace("source", "1", "salt"), "src", "fresh ")
    return B.table(spark, sf_dir, "documents").select("doc_id", G.water_type(environment, "Brackish").alias("water"))


@query(f"""WITH {_FLAGS}, M AS (SELECT *, flag IN ('Elevated', 'Exceedance') AND mx > hi AS above FROM FL WHERE flag NOT IN ('Normal', 'N/A')),
X AS (SELECT *, abs(CASE WHEN above THEN mx - hi ELSE mn - lo END) / (hi - lo) AS over FROM M)
SELECT site, metric, CASE WHEN over < 0.05 THEN 'marginally' WHEN over < 0.2 THEN 'slightly' WHEN over < 0.5 THEN 'notably' ELSE 'sharply' END || CASE WHEN above THEN ' above' ELSE ' below' END AS moved FROM X""")
def magnitude_words(spark, sf_dir):
    lines = R.analysis_lines(R.parameters(B.site_series(spark, sf_dir)))
    return lines.select("site", "metric", F.regexp_extract("line", "; moved ([a-z]+ (?:above|below)) baseline", 1).alias("moved")).filter("moved <> ''")


_REPORT = f"""{_FLAGS}, {_EVENTS[len(_SITE) + 2:]}, A AS (SELECT site, count(*) FILTER (WHERE flag <> 'Normal') AS f FROM FL GROUP BY site), QE AS (SELECT site, count(*) AS n, count(*) FILTER (WHERE severity = 'High') AS g FROM EA GROUP BY site)"""


@query(f"""WITH {_REPORT} SELECT site, CASE WHEN f > 0 OR coalesce(n, 0) > 0 THEN 'Recalibrate and inspect sensors on flagged parameters at next service window.' ELSE 'No action needed; maintain routine calibration schedule.' END AS operational,
CASE WHEN f = 0 AND coalesce(n, 0) = 0 THEN 'None required this period.' WHEN coalesce(n, 0) > 0 THEN 'Collect grab samples to confirm flagged readings and corroborate event classification.' ELSE 'Collect grab samples to confirm flagged readings.' END AS investigative,
CASE WHEN f > 0 OR coalesce(n, 0) > 0 THEN CASE WHEN coalesce(g, 0) > 0 THEN 'Notify client and relevant authority given event severity.' ELSE 'Notify client.' END ELSE 'Routine report distribution to client only.' END AS stakeholder FROM A LEFT JOIN QE USING (site)""")
def report_recommendations(spark, sf_dir):
    p = B.site_series(spark, sf_dir)
    return R.recommendations(R.parameters(p), R.events(p))


_UNIT = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{u or ''}'" for m, _, _, u, _ in D.METRICS) + " END"
_PLAIN = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END"
_PHRASE = "CASE pattern " + " ".join(f"WHEN '{k}' THEN '{v[0].upper() + v[1:]}'" for k, v in R.PATTERNS.items()) + " END"


@query(f"""WITH {_FLAGS}, AN AS (SELECT *, {_PHRASE} AS ph, {_UNIT} AS u, flag IN ('Elevated', 'Exceedance') AND mx > hi AS above FROM FL WHERE NOT (flag = 'Normal' AND pattern IN ('flat', 'unknown'))),
AO AS (SELECT *, {_PLAIN.format('lo')} || '-' || {_PLAIN.format('hi')} || ' ' || u AS span, abs(CASE WHEN above THEN mx - hi ELSE mn - lo END) / (hi - lo) AS over FROM AN)
SELECT site, metric, CASE flag WHEN 'N/A' THEN ph || '. No fixed baseline exists for this parameter (climate/season-dependent per the source-of-truth doc) -- reported for reference only, not flagged against a range.'
WHEN 'Normal' THEN ph || ', remaining within the ' || span || ' site baseline.'
ELSE ph || '; moved ' || CASE WHEN over < 0.05 THEN 'marginally' WHEN over < 0.2 THEN 'slightly' WHEN over < 0.5 THEN 'notably' ELSE 'sharply' END || CASE WHEN above THEN ' above' ELSE ' below' END || ' baseline, recording ' || CASE WHEN flag IN ('Elevated', 'Exceedance') THEN 'an ' ELSE 'a ' END
    || lower(flag) || ' reading of # ' || u || ' against the ' || span || ' baseline.' || CASE WHEN first_ms IS NULL THEN '' ELSE ' First left baseline at ' || strftime(make_timestamp(first_ms * 1000), '%Y-%m-%d %H:%M') || '.' END END AS line,
CASE WHEN flag NOT IN ('Normal', 'N/A') THEN round(CASE WHEN above THEN mx ELSE mn END, 6) END AS extreme FROM AO""")
def analysis_sentences(spark, sf_dir):
    """Numbers are compared as numbers: that they are written to two decimals is checked here."""
    lines = R.analysis_lines(R.parameters(B.site_series(spark, sf_dir)))
    p = R.parameters(B.site_series(spark, sf_dir)).select("site", "metric", F.when(F.col("flag").isin("Elevated", "Exceedance") & (F.col("max") > F.col("baseline_max")), F.col("max")).otherwise(F.col("min")).alias("e"), "flag")
    written = F.regexp_extract("line", "reading of (-?[0-9.]+) ", 1).try_cast("double")
    d = lines.join(p, ["site", "metric"]).withColumn("same", F.abs(written - F.col("e")) <= 0.0051)
    masked = F.regexp_replace("line", "reading of -?[0-9.]+ ", "reading of # ")
    return d.select("site", "metric", masked.alias("line"), F.when(F.col("same") & ~F.col("flag").isin("Normal", "N/A"), F.round("e", 6)).alias("extreme"))


@query(f"""WITH {_REPORT}, GR AS (SELECT site, CASE flag WHEN 'Exceedance' THEN 2 WHEN 'Elevated' THEN 1 WHEN 'Low' THEN 1 ELSE 0 END AS g FROM FL UNION ALL SELECT site, CASE severity WHEN 'High' THEN 2 ELSE 1 END FROM EA),
ST AS (SELECT site, CASE max(g) WHEN 2 THEN 'Action Required' WHEN 1 THEN 'Watch' ELSE 'Normal' END AS status FROM GR GROUP BY site),
LF AS (SELECT site, string_agg(CASE metric {' '.join(f"WHEN '{m}' THEN '{label}'" for m, _, label, *_ in D.METRICS)} END, ', ' ORDER BY list_position([{', '.join(repr(m) for m, *_ in D.METRICS)}], metric)) FILTER (WHERE flag <> 'Normal') AS names FROM FL GROUP BY site)
SELECT site, status, CASE WHEN coalesce(n, 0) = 0 AND status = 'Normal' THEN 'Overall status: Normal — no action required at this time.|All parameters held within the site baseline for the 2024-01-01 to 2024-01-31 reporting period.|No pollution event signatures were identified; diel and tidal rhythms tracked the site baseline throughout.|Recommendation: continue routine monitoring.'
ELSE 'Overall status: ' || status || '.|' || coalesce(upper(names[1]) || names[2:], 'No parameters') || ' moved outside the site baseline for the 2024-01-01 to 2024-01-31 reporting period.|'
    || CASE WHEN coalesce(n, 0) > 0 THEN n || ' candidate event(s) were identified.' ELSE 'No discrete pollution events were identified, though readings moved outside baseline.' END || '|Recommendation: see Recommendations below for the operational, investigative, and stakeholder follow-up.' END AS bullets
FROM ST JOIN LF USING (site) LEFT JOIN QE USING (site)""")
def report_summaries(spark, sf_dir):
    p = B.site_series(spark, sf_dir)
    return R.summaries(R.parameters(p), R.events(p), "2024-01-01 to 2024-01-31").withColumn("bullets", F.array_join("bullets", "|"))


@query(f"""WITH {_SITE}, G AS (SELECT site, metric, floor(ms / 86400000) AS b, avg(value) AS mean, min(value) AS mn, max(value) AS mx, count(*) AS n FROM P GROUP BY ALL), MD AS (SELECT site, metric, quantile_cont(value, 0.5) AS med FROM P WHERE site % 3 <> 0 GROUP BY ALL)
SELECT site, metric, min(mn) AS min, max(mx) AS max, round(sum(mean * n) / sum(n), 6) AS mean, round(coalesce(any_value(med), sum(mean * n) / sum(n)), 6) AS median, sum(n)::BIGINT AS n FROM G LEFT JOIN MD USING (site, metric) GROUP BY site, metric""")
def report_from_buckets(spark, sf_dir):
    p = B.site_series(spark, sf_dir).withColumn("valid", F.lit(True))
    medians = S.aggregate(p.filter("site % 3 <> 0"), "median", ("site", "metric"))
    return R.from_buckets(S.series(p, "day", 1 << 30, ("site", "metric")), medians).select("site", "metric", "min", "max", *_six("mean", "median"), "n")


@query(f"""WITH {_SITE} SELECT DISTINCT site, metric, lo AS baseline_min, hi AS baseline_max, lo IS NOT NULL AS fixed FROM P""")
def baseline_lookup(spark, sf_dir):
    return B.site_series(spark, sf_dir).select("site", "metric", "baseline_min", "baseline_max", F.col("baseline_min").isNotNull().alias("fixed")).distinct()


@query("""SELECT name, label FROM (SELECT c_mktsegment || ' Pod ' || c_nationkey AS name, 'dev:' || (c_custkey % 1000) AS label, row_number() OVER (PARTITION BY c_custkey % 1000 ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1""")
def devices_by_name(spark, sf_dir):
    return G.by_display_name(G.first_by_label(B.devices(spark, sf_dir))).select("name", "label")


_M = "4294967296"
_DRAW = "xor((t + (xor(t, t // 128) * (t - t % 64 + CASE WHEN t % 64 // 2 % 2 = 1 THEN 63 ELSE 61 END)) % {m}) % {m}, t)".replace("{m}", _M)  # 61 | t sets all of the last six bits but the second


def _next(of: str, name: str, source: str) -> str:
    """A step of the generator as two rows of a query: the state goes on, and a draw from 0 to 1 is made of it."""
    state = f"({of} + 1831565813) % {_M}"
    return f"""{name}a AS (SELECT *, ({state})::HUGEINT AS {name}s FROM {source}), {name}b AS (SELECT *, (xor({name}s, {name}s // 32768) * ({name}s - {name}s % 2 + 1)) % {_M} AS t FROM {name}a),
    {name}c AS (SELECT * EXCLUDE (t), {_DRAW} AS u FROM {name}b), {name} AS (SELECT * EXCLUDE (u), xor(u, u // 16384)::DOUBLE / {_M} AS {name}d FROM {name}c)"""


@query(f"""WITH I AS (SELECT 'case-' || item_id AS fixture_id FROM benchmark),
H AS (SELECT fixture_id, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(fixture_id, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (xor(a, b) * 16777619) % {_M}) AS h FROM I),
{_next('h', 'X', 'H')}, {_next('Xs', 'Y', 'X')},
J AS (SELECT fixture_id, floor(Xd * 3)::INT AS j2, floor(Yd * 2)::INT AS j1 FROM Y),
P AS (SELECT fixture_id, j1, CASE j2 WHEN 0 THEN ['vector', 'hybrid', 'direct'] WHEN 1 THEN ['direct', 'vector', 'hybrid'] ELSE ['direct', 'hybrid', 'vector'] END AS o FROM J)
SELECT fixture_id, chr(64 + k::INT) AS label, CASE WHEN j1 = 0 THEN [o[2], o[1], o[3]] ELSE o END[k] AS arm FROM P CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)""")
def blinded_labels(spark, sf_dir):
    return E.blinded(B.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("case-"), F.col("item_id").cast("string")).alias("fixture_id")), ["direct", "hybrid", "vector"])


@query("SELECT conv_id, turn, trim(coalesce(text, '') || ' and on', chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM conversations")
def text_without_commentary(spark, sf_dir):
    """Texts into which commentary with a bracket inside was put."""
    from weirflow.functions.text import without_commentary

    c = B.table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" 【Commentary on 【1】 this】 and on")))
    return c.select("conv_id", "turn", without_commentary("text").alias("text"))


def queries() -> dict[str, Query]:
    from weirflow.plans import bulk  # noqa: F401 - registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from weirflow.plans import bulk  # noqa: F401 - registers its twins

    return dict(_SQL)
