"""Analytics of evaluation runs: token totals, sweep summaries, costs and break-even, sampling, replay order, validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions.scalars import canonical_json
from weirflow.functions.text import seeded_order

# Measured tokens per answer and prices in dollars (per million tokens, per month) of three arms.
ARMS = [
    # ord, arm, prompt, cached, completion, embedding tokens, input, cached input, output, embedding price, datastore per request, fixed per month
    (0, "direct", 11023, 10979, 760, 0, 0.07, 0.035, 0.30, 0.0, 0.0, 0.0),
    (1, "hybrid", 3976, 1694, 760, 20, 0.07, 0.035, 0.30, 0.008, 0.0, 7.67),
    (2, "vector", 3498, 1207, 760, 20, 0.07, 0.035, 0.30, 0.008, 0.0000027, 0.0),
]
VOLUMES = (1_000, 5_000, 10_000, 25_000, 50_000, 100_000)
_ARM_SCHEMA = "ord int, arm string, prompt_tokens long, cached_tokens long, completion_tokens long, embedding_tokens long, input_price double, cached_price double, output_price double, embedding_price double, datastore_usd double, fixed_usd double"


def arms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARMS, _ARM_SCHEMA)


def request_costs(inputs: DataFrame) -> DataFrame:
    """The five parts of a request's cost and their sum. More cached than prompt tokens is an error, not a discount."""
    bad = F.col("cached_tokens") > F.col("prompt_tokens")
    fresh = F.when(bad, F.raise_error(F.concat("arm", F.lit(": more cached than prompt tokens"))).cast("double")).otherwise(F.col("prompt_tokens") - F.col("cached_tokens"))
    parts = {
        "input_usd": fresh * F.col("input_price") / 1e6, "cached_usd": F.col("cached_tokens") * F.col("cached_price") / 1e6, "output_usd": F.col("completion_tokens") * F.col("output_price") / 1e6,
        "embedding_usd": F.col("embedding_tokens") * F.col("embedding_price") / 1e6,
    }
    d = inputs.select("ord", "arm", "fixed_usd", "datastore_usd", *[c.alias(k) for k, c in parts.items()])
    return d.withColumn("total_usd", F.col("input_usd") + F.col("cached_usd") + F.col("output_usd") + F.col("embedding_usd") + F.col("datastore_usd"))


def cost_curve(costs: DataFrame, volumes: tuple[int, ...] = VOLUMES) -> DataFrame:
    """(arm, requests, usd): what a month costs at each volume; volumes are a literal array, so there is no join."""
    return costs.select("arm", "total_usd", "fixed_usd", F.explode(F.array(*[F.lit(v) for v in volumes])).alias("requests")).select("arm", "requests", (F.col("total_usd") * F.col("requests") + F.col("fixed_usd")).alias("usd"))


def break_even(costs: DataFrame) -> DataFrame:
    """For each pair of arms: kind (crossover, dominated or identical), the volume where they meet, and who is cheaper."""
    a = costs.select(F.col("ord").alias("i"), F.col("arm").alias("a"), F.col("total_usd").alias("ma"), F.col("fixed_usd").alias("fa"))
    b = costs.select(F.col("ord").alias("j"), F.col("arm").alias("b"), F.col("total_usd").alias("mb"), F.col("fixed_usd").alias("fb"))
    p = a.join(F.broadcast(b), F.col("i") < F.col("j"))  # a handful of arms
    gap, fixed = F.col("ma") - F.col("mb"), F.col("fb") - F.col("fa")
    meets = F.when(gap != 0, fixed / gap)
    kind = F.when((gap == 0) & (fixed == 0), "identical").when((gap == 0) | (meets <= 0), "dominated").otherwise("crossover")
    b_cheaper = F.when(gap == 0, fixed < 0).otherwise(gap > 0)
    d = p.select("a", "b", kind.alias("kind"), meets.alias("meets"), b_cheaper.alias("b_cheaper"), (gap > 0).alias("a_dearer"))
    is_cross, is_dom = F.col("kind") == "crossover", F.col("kind") == "dominated"
    return d.select(
        "a", "b", "kind", F.when(is_cross, F.col("meets")).alias("requests"), F.when(is_cross, F.when(F.col("a_dearer"), F.col("a")).otherwise(F.col("b"))).alias("cheaper_below"),
        F.when(is_cross, F.when(F.col("a_dearer"), F.col("b")).otherwise(F.col("a"))).alias("cheaper_above"), F.when(is_dom, F.when(F.col("b_cheaper"), F.col("b")).otherwise(F.col("a"))).alias("cheaper"),
    )


def transcript_totals(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """Per transcript: turns, sums where unreported counts as zero, but cached tokens null unless a turn reports them."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return turns.groupBy(by).agg(
        F.count("*").alias("turns"), zero("prompt_tokens").alias("prompt_tokens"), F.sum("cached_tokens").alias("cached_tokens"), zero("completion_tokens").alias("completion_tokens"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )


def sweep_summary(totals: DataFrame, cold: bool = False) -> DataFrame:
    """One row over all transcripts, with the cache-hit rate (null if unreported or without prompt tokens) and warnings.

    Warnings: cached tokens unreported, tokens from the cache in a cold pass, failed turns, and answers without context
    (if the totals have their number, ``empty_context``).
    """
    empty = F.sum("empty_context") if "empty_context" in totals.columns else F.lit(0).cast("long")
    s = totals.agg(
        F.count("*").alias("transcripts"), F.sum("turns").alias("turns"), F.sum("failed").alias("failed"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("completion_tokens").alias("completion_tokens"), empty.alias("empty_context")
    )
    rate = F.when(F.col("prompt_tokens") > 0, F.col("cached_tokens") / F.col("prompt_tokens"))
    checks = [
        F.when(F.col("cached_tokens").isNull(), "cache figures unreported"), F.when(F.lit(cold) & (F.col("cached_tokens") > 0), F.concat(F.col("cached_tokens").cast("string"), F.lit(" prompt tokens of a cold pass came from the cache"))),
        F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" turns failed"))), F.when(F.col("empty_context") > 0, "a turn was answered with empty context"),
    ]
    return s.withColumn("cache_hit_rate", rate).withColumn("warnings", F.concat_ws("; ", *checks)).drop("empty_context")


def round_robin(rows: DataFrame, group: str, size: Column, key: str) -> DataFrame:
    """Rows ranked by size then key within their group, to be taken one from each group in turn; groups take turns in their order of name."""
    ranked = rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(size, key)))
    groups = rows.select(group).distinct()
    place = groups.withColumn("turn", F.row_number().over(Window.orderBy(group)) - 1)  # a row for each group
    return ranked.join(F.broadcast(place), group)


def rotated(families: dict[str, list[str]]) -> list[str]:
    """Classes in the order of turns: the first of each family, then the second of each, and so on; what long families have left comes last."""
    longest = max(map(len, families.values()), default=0)
    return [own[i] for i in range(longest) for own in families.values() if i < len(own)]


def stable_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by key: the same ones every time."""
    return rows.orderBy(key).limit(n)


def repeated_calls(calls: DataFrame, name: str, arguments: Column) -> DataFrame:
    """(name, arguments, calls, repeats): how often each call was made, calls alike by name and arguments sorted by their names."""
    keyed = calls.select(F.col(name).alias("name"), canonical_json(arguments).alias("arguments"))
    return keyed.groupBy("name", "arguments").agg(F.count("*").alias("calls"), (F.count("*") - 1).alias("repeats"))


def context_size(context: DataFrame, by: list[str], text: str, source: str) -> DataFrame:
    """Per answer the number of its chunks, their characters, and the number of distinct sources."""
    return context.groupBy(*by).agg(F.count("*").alias("chunks"), F.sum(F.length(text)).alias("chars"), F.count_distinct(source).alias("sources"))


def captured(spec: DataFrame, turns: DataFrame, by: list[str], answer: str, placeholder: str = "missing") -> DataFrame:
    """Every turn asked for with what was captured of it, else a placeholder."""
    return spec.join(turns.select(*by, answer), by, "left").withColumn(answer, F.coalesce(answer, F.lit(placeholder)))


def total_turns(fixtures: DataFrame) -> DataFrame:
    return fixtures.agg(F.count("*").alias("fixtures"), F.coalesce(F.sum(F.size("turns")), F.lit(0)).alias("turns"))


def first_token(events: DataFrame, by: str, event: str = "event", at_ms: str = "at_ms", begun_ms: str = "begun_ms") -> DataFrame:
    """Milliseconds from the start of an answer to its first token; null if none came."""
    return events.groupBy(by).agg((F.min(F.when(F.col(event) == "token", F.col(at_ms))) - F.min(begun_ms)).alias("ttft_ms"))


def vector_reads(chunks: Column, k: Column) -> Column:
    """Reads billed for a nearest-neighbour query: one for each hundred entries of the index, begun ones too, and one for each result."""
    return (F.ceil(chunks / 100) + k).cast("long")


def reads_usd(reads: Column, usd_per_100k: float) -> Column:
    return reads * usd_per_100k / 100_000


def foreign_arms(turns: DataFrame, arm: str) -> None:
    """Raises ValueError if a turn was answered by another arm than the one that was asked for."""
    wrong = turns.filter(~F.col("mode").eqNullSafe(arm)).select("mode").distinct().limit(11).collect()
    if wrong:
        raise ValueError(f"asked for arm {arm!r}, answered by {', '.join(sorted(str(r.mode) for r in wrong))}")


def trimmed(history: DataFrame, keep: int = 20) -> DataFrame:
    """The newest ``keep`` turns of each conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return history.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= keep).drop("rn")


def with_history(turns: DataFrame) -> DataFrame:
    """Each turn of a user with the earlier turns of user and assistant in order."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = turns.filter("role IN ('user', 'assistant')")
    return said.withColumn("history", F.collect_list(F.struct("role", "text")).over(before)).filter("role = 'user'")


def until_failure(turns: DataFrame) -> DataFrame:
    """The turns of each conversation up to its first failed one, that one included."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max(F.col("error").isNotNull().cast("int")).over(before)
    return turns.withColumn("earlier", F.coalesce(failed, F.lit(0))).filter("earlier = 0").drop("earlier")


def distinct_citations(context: DataFrame, by: list[str], source: str, order: str) -> DataFrame:
    """The sources of each group once, in the order they were first seen."""
    first = context.groupBy(*by, source).agg(F.min(order).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("first", source))).drop("first")


def complete_only(transcripts: DataFrame, n_arms: int) -> DataFrame:
    """Fixtures for which every arm has a transcript."""
    return transcripts.groupBy("fixture_id").agg(F.count_distinct("arm").alias("n")).filter(F.col("n") == n_arms).select("fixture_id")


def slice_coverage(sources: Column, in_slice: Column) -> Column:
    """full, partial or none: how many of the sources are in the slice."""
    n = F.size(F.array_intersect(sources, in_slice))
    return F.when(n == 0, "none").when(n == F.size(F.array_distinct(sources)), "full").otherwise("partial")


def runnable(requires: Column, capabilities: Column) -> Column:
    return F.forall(requires, lambda r: F.array_contains(capabilities, r))


def blinded(fixtures: DataFrame, arms: list[str]) -> DataFrame:
    """(fixture_id, label, arm): arms under the letters A, B, ... in an order that each fixture's id fixes."""
    @F.pandas_udf("array<string>")
    def order(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: seeded_order(i, arms))

    d = fixtures.select("fixture_id", F.posexplode(order("fixture_id")).alias("place", "arm"))
    return d.select("fixture_id", F.chr(F.col("place") + 65).alias("label"), "arm")


# What a fixture may say.
FAVORS, REQUIREMENTS = ("direct-feed", "rag", "tie"), ("sensor-tool", "turbidity-scope")


def fixture_errors(fixtures: DataFrame, known: list[str], in_slice: list[str], classes: list[str]) -> DataFrame:
    """(id, error): everything wrong with each fixture, all at once."""
    text = lambda c: c.isNotNull() & (F.trim(c) != "")
    names, own = F.array(*[F.lit(x) for x in known]), F.array(*[F.lit(x) for x in in_slice])
    turns, docs = F.col("turns"), F.coalesce("answerable_from", F.array().cast("array<string>"))
    cover = slice_coverage(docs, own)
    bad_turn = lambda test: F.exists(turns, test)
    checks = [
        (F.concat("id", F.lit(".json")) != F.col("filename"), "id must match the filename"), (~F.col("class").isin(*classes), "class is unknown"),
        (~F.col("expected_to_favor").isin(*FAVORS), "expected_to_favor is invalid"), (~text(F.col("notes")), "notes must explain the fixture"),
        (F.col("answerable_from").isNull(), "answerable_from must be an array"), (F.size(F.array_except(docs, names)) > 0, "answerable_from names an unknown document"),
        (~F.forall(F.col("requires"), lambda r: r.isin(*REQUIREMENTS)), "requires names an unknown capability"), (F.coalesce(F.size(turns), F.lit(0)) < 2, "there must be two turns or more"),
        (bad_turn(lambda t: t.isNull()), "a turn is missing"), (bad_turn(lambda t: t["role"] != "user"), "a turn is not the user's"), (bad_turn(lambda t: ~text(t["content"])), "a turn is empty"),
        (bad_turn(lambda t: t["rubric"].isNull()), "a turn has no rubric"), (bad_turn(lambda t: F.coalesce(F.size(t["rubric"]["must_contain"]), F.lit(0)) < 1), "must_contain is empty"),
        (bad_turn(lambda t: t["rubric"].isNotNull() & t["rubric"]["must_not"].isNull()), "must_not is missing"), (bad_turn(lambda t: F.size(F.array_except(F.coalesce(t["rubric"]["cite"], names), names)) > 0), "a citation is unknown"),
        (bad_turn(lambda t: F.size(F.array_except(F.coalesce(t["rubric"]["cite"], docs), docs)) > 0), "a citation is not in answerable_from"), (bad_turn(lambda t: F.coalesce(F.size(t["rubric"]["cite"]) == 0, F.lit(False))), "cite is empty"),
        (bad_turn(lambda t: F.coalesce(F.trim(t["rubric"]["notes"]) == "", F.lit(False))), "notes of a rubric are blank"),
        ((F.col("expected_to_favor") == "rag") & (cover == "full"), "favours rag but is wholly inside the slice"), ((F.col("expected_to_favor") == "direct-feed") & (F.size(docs) > 0) & (cover == "none"), "favours direct-feed but is outside the slice"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in checks]))
    return fixtures.select("id", F.explode(found).alias("error"))


# Who may speak in the history of a request, and how long the name of a device may be.
SPEAKERS, MAX_DEVICE = ("user", "assistant"), 120


def request_errors(requests: DataFrame) -> DataFrame:
    """Chat requests (query, device, history: array of role and content) with ``errors``: all that is wrong with each, none where it may go on."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    turns = F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>"))
    checks = [
        F.when(blank(F.col("query")), '"query" is required and must be a non-empty string.'),
        F.when(F.col("device").isNotNull() & (F.trim("device") == ""), '"device" must be a non-empty string when provided.'),
        F.when(F.length(F.trim("device")) > MAX_DEVICE, f'"device" must be at most {MAX_DEVICE} characters.'),
    ]
    role = F.transform(turns, lambda t, i: F.when(t.isNull() | ~F.coalesce(t["role"].isin(*SPEAKERS), F.lit(False)), F.concat(F.lit('"history['), i.cast("string"), F.lit(f']".role must be one of [{", ".join(SPEAKERS)}].'))))
    text = F.transform(turns, lambda t, i: F.when(t.isNotNull() & blank(t["content"]), F.concat(F.lit('"history['), i.cast("string"), F.lit(']".content must be a non-empty string.'))))
    return requests.withColumn("errors", F.array_compact(F.concat(F.array(*checks), role, text)))
