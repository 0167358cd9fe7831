"""Secrets told by corpus-wide ownership frequency, with DataFrame functions only.

Three base patterns and some wider ones give candidates: a span, the value in it and its hash. Over the whole
corpus the hashes are counted by distinct repositories and distinct owners. A value that many owners have is an
example that was copied around, one that names itself as an example or stands behind such a word is a
placeholder, and one that few owners have and that looks random enough is taken for a live credential of theirs;
the rest is weak. Base matches always are spans; a wider one is added if its value is live.

Texts are read once, where they lie. What is moved are candidates: their hashes are aggregated by (hash, owner,
repository), then by (hash, owner), then by hash, so that a value which a third of all rows have is spread over its
repositories, and its verdict comes back by a join whose counted side is broadcast if it is small.

Defined results: null text counts as empty; a text without candidates has the empty string for spans and verdicts;
rows that repeat are searched each and are one repository; null owners are one owner, null repositories one
repository; an empty table gives no rows; further columns of the input are ignored, whatever their names.
Positions are code points, ends exclusive. Time is linear in a text and its matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import keyed_join, materialise, text_of

#: A value of so many owners is a copied example.
WIDELY = 5
#: Code points before a candidate in which words of examples count.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int  # of the value
    length: int  # of the value, at least
    guard: str  # SQL that is false only for texts without a match
    base: bool = False


# Patterns of secrets (\x22 and \x27 are quotes) and words of examples. Patterns are possessive and start at
# the borders of runs where that changes no match, so that time is linear in texts without separators.
_IS = r"[\x22\x27]?+\x20*+[:=]\x20*+[\x22\x27]?+([A-Za-z0-9+/_.=-]++)"
_SIGNS = "(contains(text, ':') or contains(text, '='))"
KINDS = (
    Kind("assign", r"(?i:(password|passwd|secret|token|api_?key))" + _IS, 2, 6, _SIGNS, True),
    Kind("access", r"AKIA[A-Z0-9]{16,}+", 0, 20, "contains(text, 'AKIA')", True),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24, "text rlike r'[0-9a-f]{24}'", True),
    Kind("named", r"(?i:pwd|passphrase|credentials?|private_?key|access_?key)" + _IS, 1, 6, _SIGNS),
    Kind("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", 0, 40, "contains(text, 'gh')"),
    Kind("slack", r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}+", 0, 15, "contains(text, 'xox')"),
    Kind("google", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}", 0, 39, "contains(text, 'AIza')"),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{7,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 32, "contains(text, 'eyJ')"),
    Kind("url", r"://[^\x20\x22\x27/:@\x09-\x0D]++:([^\x20\x22\x27/:@\x09-\x0D]++)@", 1, 6, "contains(text, '://')"),
    Kind("bearer", r"(?i:bearer)\x20++([A-Za-z0-9._~+/=-]{16,}+)", 1, 16, "contains(lower(text), 'bearer')"),
)
BASE = tuple(k for k in KINDS if k.base)
EXAMPLES = r"example|sample|dummy|change_?me|placeholder|redacted|your_|x{4}|0{8}|12345678|abcdefgh"
BEFORE = r"example|sample|dummy|placeholder|e\.g\."
STATUSES = ("live", "copied", "placeholder", "weak")

_SPANS = "array<struct<kind:int,start:int,end:int,value:string,ahead:string>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _found(i: int, kind: Kind) -> str:
    """SQL for all leftmost non-overlapping matches of a kind in ``text``.

    Places are running sums over the pieces between matches. An array that grows is copied at every step, so sums are made
    within blocks of about the root of the number of matches, and then over the blocks.
    """
    p = f"r'{kind.pattern}'"
    value = f"regexp_extract(e.x, {p}, {kind.group})" if kind.group else "e.x"
    pieces = f"zip_with(regexp_extract_all(text, {p}, 0), split(text, {p}, -1), (x, y) -> named_struct('x', x, 'n', length(y), 'ahead', lower(right(y, {CONTEXT}))))"
    step = "a.at + e.n + coalesce(length(e.x), 0)"
    item = f"named_struct('kind', {i}, 'start', a.at + e.n, 'end', a.at + e.n + length(e.x), 'value', {value}, 'ahead', e.ahead)"
    block = f"aggregate(k, named_struct('at', 0, 'out', cast(array() as {_SPANS})), (a, e) -> named_struct('at', {step}, 'out', if(e.x is null, a.out, concat(a.out, array({item})))))"
    size = "cast(ceil(sqrt(size(m))) as int)"
    blocks = f"transform(sequence(0, size(m) - 1, {size}), i -> element_at(transform(array(slice(m, i + 1, {size})), k -> {block}), 1))"
    begins = "aggregate(b, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, e) -> named_struct('at', a.at + e.at, 'out', concat(a.out, array(a.at))), a -> a.out)"
    moved = "transform(e.out, s -> named_struct('kind', s.kind, 'start', s.start + o, 'end', s.end + o, 'value', s.value, 'ahead', s.ahead))"
    whole = _let(pieces, "m", _let(blocks, "b", f"flatten(zip_with(b, {begins}, (e, o) -> {moved}))"))
    return f"if({kind.guard}, filter({whole}, s -> length(s.value) >= {kind.length}), cast(array() as {_SPANS}))"


#: Whether the value of span s names itself as an example or stands behind such a word, and whether it looks random.
_PLACEHOLDER = f"(lower(s.value) rlike r'{EXAMPLES}' or s.ahead rlike r'{BEFORE}')"
_RANDOM = "(length(s.value) >= 16 and s.value rlike '[0-9]' and s.value rlike '[A-Za-z]' and size(array_distinct(split(s.value, ''))) >= 8)"


def _joined(spans: str, more: str = "") -> str:
    names = "array(" + ", ".join(f"'{k.name}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.end{more})), ',')"


def candidates(docs: DataFrame, repository: str | Column = "doc_id", owner: str | Column = "source") -> DataFrame:
    """One row per document, without its text: _row, doc_id, repository, owner, the number of base matches of each kind, base_sha256, and all candidates in order of start and kind with a hash of their values."""
    col = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), col(repository).alias("repository"), col(owner).alias("owner"), text_of(docs).alias("text"))
    d = d.withColumn("found", F.expr(f"concat({', '.join(_found(i, k) for i, k in enumerate(KINDS))})"))
    told = f"named_struct('start', s.start, 'kind', s.kind, 'end', s.end, 'hash', sha2(s.value, 256), 'placeholder', {_PLACEHOLDER}, 'random', {_RANDOM})"
    d = d.select("doc_id", "repository", "owner", F.expr(f"if(size(found) > 0, array_sort(transform(found, s -> {told})), cast(array() as array<struct<start:int,kind:int,end:int,hash:string,placeholder:boolean,random:boolean>>))").alias("spans"))
    base = F.expr(f"filter(spans, s -> s.kind < {len(BASE)})")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    d = d.withColumn("base", base)
    return d.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "repository", "owner", *counts, F.expr(f"sha2({_joined('base')}, 256)").alias("base_sha256"), "spans")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners): how many distinct ones have a value, over the whole corpus."""
    each = found.filter("size(spans) > 0").select("repository", "owner", F.explode(F.expr("array_distinct(transform(spans, s -> s.hash))")).alias("hash"))
    by_owner = each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("x")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def judged(found: DataFrame, owners: DataFrame, widely: int = WIDELY) -> DataFrame:
    """One row per candidate of materialised ``candidates``: its columns, repositories, owners, status, and whether it is among the spans."""
    each = found.filter("size(spans) > 0").select(*[c for c in found.columns if c != "spans"], F.explode("spans").alias("s")).select("*", "s.*").drop("s")
    with_counts = keyed_join(each, owners, ["hash"], "inner")
    status = F.expr(f"case when placeholder then 'placeholder' when owners >= {widely} then 'copied' when random then 'live' else 'weak' end")
    # Both look back, one of them in reverse: a frame that ends at the partition's end would be summed anew for every row.
    before, after = (Window.partitionBy("_row").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (("start", "kind"), (F.desc("start"), F.desc("kind"))))
    base = F.col("kind") < len(BASE)
    free = (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.col("end")) >= F.col("end"))
    return with_counts.withColumn("status", status).withColumn("is_span", base | (free & (F.col("status") == "live")))


def secret_spans(docs: DataFrame, repository: str | Column = "doc_id", owner: str | Column = "source", widely: int = WIDELY) -> DataFrame:
    """One row per document: doc_id, the number of base matches of each kind, base_sha256 of them, all spans, the number of candidates of each status, and verdicts.

    Spans are base matches and live wider ones that overlap no base match and no candidate before them. Verdicts has every candidate as kind:start:end:status:owners:repositories.
    """
    found = materialise(candidates(docs, repository, owner), "candidates")
    each = judged(found, materialise(ownership(found), "ownership"), widely)
    told = ["doc_id", *(f"n_{k.name}" for k in BASE), "base_sha256"]
    spans = each.groupBy("_row").agg(*[F.first(c).alias(c) for c in told], F.expr("array_sort(collect_list(named_struct('start', start, 'kind', kind, 'end', end, 'status', status, 'owners', owners, 'repositories', repositories, 'is_span', is_span)))").alias("c"))
    more = ", ':', s.status, ':', s.owners, ':', s.repositories"
    counts = [F.expr(f"cast(size(filter(c, s -> s.status = '{x}')) as bigint)").alias(f"n_{x}") for x in STATUSES]
    some = spans.select(*told, F.expr(_joined("filter(c, s -> s.is_span)")).alias("spans"), *counts, F.expr(_joined("c", more)).alias("verdicts"))
    none = found.filter("size(spans) = 0").select(*told, F.lit("").alias("spans"), *[F.lit(0).cast("long").alias(f"n_{x}") for x in STATUSES], F.lit("").alias("verdicts"))
    return none.unionByName(some)
