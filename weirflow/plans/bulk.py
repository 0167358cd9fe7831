"""Queries over tables of questions, names, windows and vectors, with their SQL twins; registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirflow.operators import corpus as C
from weirflow.operators import lexical as L
from weirflow.operators import questions as M
from weirflow.operators import registry as G
from weirflow.operators import report as R
from weirflow.operators import retrieval as T
from weirflow.operators import vectors as V
from weirflow.plans import bindings as B
from weirflow.plans.catalogue import _DEV, _MOVES, _MS, _N, _ms, _six, query

# A question of every customer: its device by one of its names, and metrics, aggregations and phrases in turns. Some cannot be answered.

_METRICS = ("ph", " DO", "all", "turbidity", "salinity")
_NAMES = ("mean", "min", "max", "median", "latest", "earliest", "mode")
_DAY = "date_trunc('day', anchor)"
#: Each phrase with its window in SQL: start, end, whether the end is included, label.
_PHRASES = (
    ("last 7 days", "anchor - INTERVAL 7 DAY", "anchor", True, "last 7 days"), ("Latest", "anchor", "anchor", True, "latest"), ("today", _DAY, f"{_DAY} + INTERVAL 1 DAY", False, "today"),
    ("yesterday", f"{_DAY} - INTERVAL 1 DAY", _DAY, False, "yesterday"), ("this  week", "date_trunc('week', anchor)", "date_trunc('week', anchor) + INTERVAL 7 DAY", False, "this week"),
    ("past 36 hours", "anchor - INTERVAL 36 HOUR", "anchor", True, "last 36 hours"), ("2024-01-05 to 2024-01-12", "TIMESTAMP '2024-01-05'", "TIMESTAMP '2024-01-13'", False, "2024-01-05 to 2024-01-12"),
    ("2024-01-10", "TIMESTAMP '2024-01-10'", "TIMESTAMP '2024-01-11'", False, "2024-01-10"), ("previous month", "anchor - INTERVAL 30 DAY", "anchor", True, "last 1 month"), ("soon", "NULL", "NULL", False, ""),
    ("last 2 weeks", "anchor - INTERVAL 14 DAY", "anchor", True, "last 2 weeks"),
)


def _turn(values: tuple[str, ...], key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_AGGREGATED = {
    "mean": "avg(value) FILTER (WHERE valid)", "min": "min(value) FILTER (WHERE valid)", "max": "max(value) FILTER (WHERE valid)", "median": "quantile_cont(value, 0.5) FILTER (WHERE valid)",
    "latest": "arg_max(value, {'a': tm, 'o': ord}) FILTER (WHERE valid)", "earliest": "arg_min(value, {'a': tm, 'o': ord}) FILTER (WHERE valid)",
}
_EVERY = ["dissolved_oxygen", "orp", "ph", "conductivity", "temperature", "turbidity"]


@query(f"""WITH {_MS}, A AS (SELECT device, max(tm) AS anchor FROM S GROUP BY device),
Q AS (SELECT c_custkey AS q, {_case('c_custkey', [repr(n) for n in _NAMES])} AS name, {_case('c_custkey', [f"['{m}']" if m != 'all' else str(_EVERY) for m in ('ph', 'dissolved_oxygen', 'all', 'turbidity', 'salinity')])} AS metrics,
    {_case('c_custkey', [repr(p[4]) for p in _PHRASES])} AS range_label,
    CASE WHEN c_custkey % 5 = 4 THEN 'Unknown metric "salinity". Valid metrics: dissolved_oxygen, orp, ph, conductivity, temperature, turbidity, all.'
    WHEN c_custkey % 11 = 9 THEN 'cannot read ''soon'': use latest, today, yesterday, this week, last N hours/days/weeks/months/years, a date, or one date to another'
    WHEN c_custkey % 7 = 6 THEN 'Unknown aggregation "mode". Valid aggregations: min, max, mean, median, latest, earliest, raw, series.'
    WHEN c_custkey % 17 = 0 THEN 'no device for ''nobody ' || c_custkey || ''': ' END AS error FROM customer),
G AS (SELECT q, name, range_label, unnest(metrics) AS metric FROM Q WHERE error IS NULL),
W AS (SELECT G.*, anchor, {_case('q', [p[1] for p in _PHRASES])} AS st, {_case('q', [p[2] for p in _PHRASES])} AS en, {_case('q', [str(p[3]).lower() for p in _PHRASES])} AS incl FROM G LEFT JOIN A ON device = q),
V AS (SELECT q, W.metric AS metric, name, value, valid, tm, ms, ord FROM W JOIN SM ON device = q AND SM.metric = W.metric AND tm >= st AND (tm < en OR (incl AND tm = en)) WHERE value IS NOT NULL),
X AS (SELECT q, metric, CASE name {' '.join(f"WHEN '{n}' THEN {e}" for n, e in _AGGREGATED.items())} END AS value, {_N}, CASE name WHEN 'latest' THEN max(ms) FILTER (WHERE valid) WHEN 'earliest' THEN min(ms) FILTER (WHERE valid) END AS observed_ms FROM V GROUP BY q, metric, name)
SELECT q AS question, 'dev:' || q AS label, metric, name AS aggregation, round(value, 6) AS value, coalesce(n_samples, 0) AS n_samples, coalesce(excluded_faulted, 0) AS excluded_faulted, observed_ms,
    CASE WHEN anchor IS NOT NULL THEN epoch_us(st) // 1000 END AS start_ms, CASE WHEN anchor IS NOT NULL THEN epoch_us(en) // 1000 END AS end_ms, CASE WHEN anchor IS NOT NULL THEN range_label END AS range_label, NULL AS error FROM W LEFT JOIN X USING (q, metric)
UNION ALL SELECT q, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM Q WHERE error IS NOT NULL""")
def questions_answered(spark, sf_dir):
    """A table of questions against all samples in one plan."""
    c, key = B.table(spark, sf_dir, "customer"), F.col("c_custkey")
    label = F.concat(F.lit("dev:"), key.cast("string"))
    name = F.concat_ws(" ", "c_name", key.cast("string"))  # a name of its own for each device, as in SQL, also where customers share one
    fleet = c.select(key.alias("device"), label.alias("label"), name.alias("name"))
    named = F.when(key % 17 == 0, F.concat(F.lit("nobody "), key.cast("string"))).when(key % 3 == 0, F.concat(F.lit(" "), F.upper(label), F.lit(" "))).when(key % 3 == 1, F.lower(name)).otherwise(label)
    asked = c.select(key.alias("question"), named.alias("device"), _turn(_METRICS, key).alias("metric"), _turn(_NAMES, key).alias("aggregation"), _turn(tuple(p[0] for p in _PHRASES), key).alias("time_range"))
    a = M.answers(asked, B.metric_samples(spark, sf_dir), fleet)
    return a.select("question", "label", "metric", "aggregation", *_six("value"), "n_samples", "excluded_faulted", _ms("observed_at").alias("observed_ms"), _ms("range_start").alias("start_ms"), _ms("range_end").alias("end_ms"), "range_label", "error")


@query(f"""WITH {_DEV}, AN AS (SELECT DISTINCT unnest([' ' || upper(label), name, lower(split_part(name, ' ', 1)), substr(name, 2, 5), lower(name[1]) || 'P', substr(name, 1, 2)]) AS said FROM DV), AK AS (SELECT DISTINCT lower(trim(said)) AS asked FROM AN),
D2 AS (SELECT *, lower(trim(name)) AS n, lower(name[1] || 'p') AS i, lower(trim(label)) AS l FROM DV),
T AS (SELECT asked, key, ord, CASE WHEN l = asked THEN 1 WHEN n = asked THEN 2 WHEN i = asked THEN 3 WHEN length(asked) >= 3 AND contains(n, asked) THEN 4 WHEN length(asked) >= 2 AND starts_with(i, asked) THEN 5 END AS tier FROM AK, D2),
B AS (SELECT asked, min(tier) AS tier FROM T GROUP BY asked) SELECT asked, tier, count(*) AS devices, sum(ord)::BIGINT AS ords, min(key) AS first FROM T JOIN B USING (asked, tier) GROUP BY asked, tier""")
def names_matched(spark, sf_dir):
    """Every name that a customer's device may go by, resolved in one plan: how many devices it reaches and in which tier."""
    d = B.devices(spark, sf_dir)
    said = F.array(F.concat(F.lit(" "), F.upper("label")), F.col("name"), F.lower(F.element_at(F.split("name", " "), 1)), F.substring("name", 2, 5), F.concat(F.lower(F.substring("name", 1, 1)), F.lit("P")), F.substring("name", 1, 2))
    found = G.matches_of(d.select(F.explode(said).alias("asked")), d)
    return found.groupBy("asked", "tier").agg(F.count("*").alias("devices"), F.sum("ord").alias("ords"), F.min("key").alias("first"))


@query(f"WITH {_MOVES} SELECT site, (epoch_us(s) // 1000) AS start_ms, metric, round(mean, 9) AS mean, mn AS min, mx AS max, moved FROM MM")
def event_movements_by_day(spark, sf_dir):
    """Samples meet events by site and day."""
    p = B.site_series(spark, sf_dir)
    return R.movements(p, R.merged(R.excursions(p))).select("site", _ms("event_start").alias("start_ms"), "metric", F.round("mean", 9).alias("mean"), "min", "max", "moved")


# Retrieval for tables of queries


@query("""WITH E AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), P AS (SELECT q.vec_id AS query, b.vec_id AS key, round(list_cosine_similarity(q.e, b.e), 12) AS score FROM E q, E b WHERE q.vec_id % 50 = 0),
R AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM P) SELECT query, key, round(score, 6) AS score, rank FROM R WHERE rank <= 10""")
def vectors_nearest(spark, sf_dir):
    """Exact neighbours of the vectors whose id is divisible by 50 among all vectors."""
    v = B.table(spark, sf_dir, "embeddings")
    return V.nearest(v.filter("vec_id % 50 = 0"), v, 10).select("query", "key", *_six("score"), "rank")


@query()
def vector_lists_recall(spark, sf_dir):
    """What a search of inverted lists finds of the exact neighbours, for the vectors whose id is divisible by 50 among all vectors."""
    v = B.table(spark, sf_dir, "embeddings")
    queries, n = v.filter("vec_id % 50 = 0"), v.count()
    lists = V.Lists.fit(v, spark.range(1).select(C.index_lists(F.lit(n)).alias("n")).first().n)
    assigned, others = lists.assign(v), v.filter("vec_id % 50 = 1")
    probes = lists.probes_for(others, assigned, V.nearest(others, v, 10))
    told = V.recall(lists.search(queries, assigned, 10, probes=probes), V.nearest(queries, v, 10))
    return told.select("queries", "pairs", "found", "recall", F.lit(len(lists.centres)).alias("lists"), F.lit(probes).alias("probes"))


#: Questions in the words of the corpus.
_QUESTIONS = (("a", "What is the ontion of thered?"), ("b", "stupid ountings and erening edly"), ("c", "the of and"), ("d", "Cióntamente queos, leau"), ("e", "nothing that is there: qqqq"))


def _lexical(spark, sf_dir, every: bool):
    q = spark.createDataFrame(_QUESTIONS, "query string, text string")
    return L.lexical_rank(q, B.table(spark, sf_dir, "documents"), every=every).select("query", "doc_id", *_six("score"), "rank")


@query()
def lexical_rank_any(spark, sf_dir):
    """Stemmed questions against all documents: any term."""
    return _lexical(spark, sf_dir, False)


@query()
def lexical_rank_all(spark, sf_dir):
    """Stemmed questions against all documents: all terms, by cover density."""
    return _lexical(spark, sf_dir, True)


@query("""WITH I AS (SELECT vec_id, vec_id // 32 AS batch, row_number() OVER (PARTITION BY vec_id // 32 ORDER BY vec_id) - 1 AS place, embedding FROM embeddings),
C AS (SELECT batch, count(*) AS n_in, count(*) FILTER (WHERE vec_id % 97 <> 5) AS n_out FROM I GROUP BY batch)
SELECT vec_id, batch, place, CASE WHEN n_in = n_out THEN round(embedding[1]::DOUBLE, 6) END AS first_entry,
    CASE WHEN n_in <> n_out THEN 'Embedding API returned ' || n_out || ' vectors for ' || n_in || ' inputs.' END AS error FROM I JOIN C USING (batch)""")
def vectors_of_batches(spark, sf_dir):
    """Embeddings as they come back in batches of 32, of which some have lost a vector."""
    e = B.table(spark, sf_dir, "embeddings").withColumn("batch", F.expr("vec_id div 32"))
    batched = e.select("vec_id", "batch", (F.row_number().over(Window.partitionBy("batch").orderBy("vec_id")) - 1).alias("place"))
    items = e.filter("vec_id % 97 <> 5").select("batch", F.col("vec_id").alias("index"), "embedding")
    return T.with_vectors(batched, items, 64).select("vec_id", "batch", "place", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_entry"), "error")
