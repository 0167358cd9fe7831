"""How the driver tables stand in for the domain: events are samples, customers devices, documents the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators import samples as S
from weirflow.operators.dimensions import with_baselines

#: Metrics for the event types; signups of odd devices are temperatures. Sites take turns in the kinds of water and in some patterns.
METRIC_OF = {"signup": "dissolved_oxygen", "view": "orp", "click": "ph", "purchase": "conductivity", "error": "turbidity"}
WATERS = ("Freshwater", "Brackish", "Estuarine", "Marine", "Unknown")
PATTERN_OF = ("diel", "tidal", "flat", "irregular", "unknown", "event-driven")
ENVIRONMENTS = ("salt marsh", "freshwater creek", "Salt pond", "", "lake")
SLICE = ("src0", "src3", "src5")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_events(table(spark, sf_dir, "events"))


def _named(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with the names of the domain's metrics."""
    named = F.create_map(*[F.lit(x) for kv in METRIC_OF.items() for x in kv])
    metric = F.when((F.col("metric") == "signup") & (F.col("device") % 2 == 1), "temperature").otherwise(F.element_at(named, F.col("metric")))
    return samples(spark, sf_dir).withColumn("metric", metric)


def site_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid samples as series of sites, with the baselines of their water and a pattern. Values are scaled so that a reading of 60 is the upper edge of its baseline."""
    s = metric_samples(spark, sf_dir).filter("valid").withColumnRenamed("device", "site").withColumn("water_type", _named(WATERS, F.col("site")))
    d = with_baselines(s)
    value = F.when(F.col("baseline_max").isNull(), F.col("value")).otherwise(F.col("value") * F.col("baseline_max") / 60)
    return d.select("site", "metric", "at", "ord", value.alias("value"), "baseline_min", "baseline_max", _named(PATTERN_OF, F.col("site")).alias("pattern"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registry rows, each label twice: the second row of a label is a repeat."""
    c = table(spark, sf_dir, "customer")
    row = c.select(F.col("c_custkey").alias("key"), F.concat_ws(" ", "c_mktsegment", F.lit("Pod"), F.col("c_nationkey").cast("string")).alias("name"), F.concat(F.lit("dev:"), (F.col("c_custkey") % 1000).cast("string")).alias("label"), _named(ENVIRONMENTS, F.col("c_custkey")).alias("environment"))
    return row.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).withColumn("ord", F.col("key") * 2 + F.col("copy"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with token counts taken from their texts; assistants report cached tokens, failed turns have an error."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text").cast("long")
    return c.select(
        "conv_id", "turn", "role", "text", n.alias("prompt_tokens"), F.when(F.col("role") == "assistant", F.floor(n / 2)).cast("long").alias("cached_tokens"),
        F.floor(n / 4).cast("long").alias("completion_tokens"), F.when(n % 17 == 0, F.lit("failed")).alias("error"),
    )


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier turns of a conversation as the context of an answer, in their order, their speaker as the source."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), F.col("role").alias("source"), "text")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a tool with two arguments, in either order."""
    e = table(spark, sf_dir, "events")
    d, m = F.lit("device"), F.lit("metric")
    user = F.col("user_id").cast("string")
    arguments = F.when(F.col("event_id") % 2 == 0, F.create_map(d, user, m, "event_type")).otherwise(F.create_map(m, "event_type", d, user))
    return e.select(F.lit("query").alias("name"), arguments.alias("arguments"))


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registry rows of organisations: the market segment is the organisation."""
    c = table(spark, sf_dir, "customer")
    data = F.struct(F.col("c_name").alias("name"), F.concat(F.lit("dev:"), F.col("c_custkey").cast("string")).alias("label"), F.col("c_mktsegment").alias("organization"), _named(ENVIRONMENTS, F.col("c_custkey")).alias("environment"))
    return c.select(F.col("c_custkey").cast("string").alias("id"), data.alias("data"))
