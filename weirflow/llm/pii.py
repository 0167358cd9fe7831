"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of four strict patterns (valid or not) and of wider ones: telephone numbers
without a country code, spelt-out e-mail and IP addresses. Labelers vote for or against each: the strict
pattern's own check, a gazetteer or checksum, the words before it, its borders, and its grouping. There
are few different ballots, so their counts are all that leaves the executors; on them expectation-
maximisation estimates how reliable each labeler is and how likely each kind, and a logistic span
classifier is trained on the estimated labels. Its weights go back into the plan as an expression. Valid
strict matches always are spans; the classifier adds wider ones that are valid and do not overlap them.

Patterns are possessive and start at the borders of runs, which changes no match but keeps the time
linear in the length of a text without separators.

Defined results: null text counts as empty and has no spans; a text without candidates has the empty
string for spans; rows that repeat are searched each; without candidates in the corpus nothing is added;
an empty table gives no rows; further columns of the input are ignored, whatever their names. Positions
are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")

# The strict patterns, and words that stand before or in personal data.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?![0-9.\[])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
GUARDS = {"email": "contains(text, '@')", "ip": r"text rlike r'[0-9]\.[0-9]'", "card": r"text rlike r'[0-9](?:[\x20-]?[0-9]){11}'", "phone": "contains(text, '+')"}
WIDE_GUARDS = {"email": r"text rlike r'(?i)[(\[]dot[)\]]|\x20dot\x20'", "ip": "contains(text, '[.]')", "phone": r"text rlike r'[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}'"}
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ca", "ch", "at", "it", "nl", "jp", "cn", "br", "au", "in")
BEFORE = {
    "email": "mail|e-mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|client|login|adresse",
    "card": "card|visa|master|amex|credit|debit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|cell|fax|ring|telefon|tél|llame|contact",
}
AGAINST = r"version|\bv\.?$|order|isbn|token|serial|build|article|section|\bid\b|ref"
#: Code points before a candidate in which context words count; rounds of estimation and of training.
CONTEXT, ROUNDS, STEPS = 32, 40, 400
LABELERS = ("pattern", "gazetteer", "context", "borders", "grouping")

_SPAN = "array<struct<kind:int,start:int,end:int,x:string,strict:boolean,ahead:string,after:string>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _found(kind: str, pattern: str, guard: str, strict: bool) -> str:
    """SQL for all leftmost non-overlapping matches in ``text`` with their positions and what stands beside them.

    All is told from the matches and the pieces between them, never from the text again, which would be walked from its
    start for each match. What stands ahead is the end of the piece before; where that is shorter than CONTEXT, the
    matches and pieces before it, of which CONTEXT / 2 are always enough, since a match has two code points or more.
    Positions are running sums of lengths. An array that grows is copied at every step, so sums are made within blocks of
    about the root of the number of matches and then over blocks: many matches cost little more than few.
    """
    p, most = f"r'{pattern}'", CONTEXT // 2
    piece = f"named_struct('x', x, 'n', length(y), 'tail', right(y, {CONTEXT}), 'head', left(if(y = '', coalesce(x, ''), y), 1))"
    pieces = f"zip_with(regexp_extract_all(text, {p}, 0), split(text, {p}, -1), (x, y) -> {piece})"
    before = f"array_join(transform(slice(w, greatest(i - {most - 1}, 1), least(i, {most})), q -> concat(q.tail, right(q.x, {CONTEXT}))), '')"
    ahead = f"if(i = 0 or length(e.tail) = {CONTEXT}, e.tail, right(concat({before}, e.tail), {CONTEXT}))"
    beside = f"transform(w, (e, i) -> named_struct('x', e.x, 'n', e.n, 'ahead', {ahead}, 'after', coalesce(get(w, i + 1).head, '')))"
    size = "cast(ceil(sqrt(size(m))) as int)"
    sums = "named_struct('at', 0, 'out', cast(array() as array<int>))"
    block = f"aggregate(slice(m, i + 1, {size}), {sums}, (a, e) -> named_struct('at', a.at + e.n + coalesce(length(e.x), 0), 'out', concat(a.out, array(a.at))))"
    starts = f"aggregate(b, {sums}, (a, e) -> named_struct('at', a.at + e.at, 'out', concat(a.out, array(a.at))), a -> a.out)"
    places = _let(f"transform(sequence(0, size(m) - 1, {size}), i -> {block})", "b", f"flatten(zip_with(b, {starts}, (e, o) -> transform(e.out, s -> s + o)))")
    item = f"named_struct('kind', {KINDS.index(kind)}, 'start', at + e.n, 'end', at + e.n + length(e.x), 'x', e.x, 'strict', {str(strict).lower()}, 'ahead', e.ahead, 'after', e.after)"
    whole = _let(pieces, "w", _let(beside, "m", f"cast(slice(zip_with(m, {places}, (e, at) -> {item}), 1, size(m) - 1) as {_SPAN})"))
    return f"if({guard}, {whole}, cast(array() as {_SPAN}))"


_DIGITS = "regexp_replace(s.x, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length({d})), 0, (t, i) -> t + cast(substring({d}, length({d}) + 1 - i, 1) as int) * if(i % 2 = 0, 2, 1)
    - if(i % 2 = 0 and cast(substring({d}, length({d}) + 1 - i, 1) as int) > 4, 9, 0)) % 10 = 0"""
#: Whether a candidate s is valid as its kind: octets up to 255, the checksum of card numbers, numbers of digits.
_VALID = f"""case s.kind when 0 then true
    when 1 then forall(split(s.x, '[^0-9]+'), o -> length(ltrim('0', o)) <= 3 and coalesce(try_cast(ltrim('0', o) as int), 0) <= 255)
    when 2 then length({_DIGITS}) between 12 and 19 and {_LUHN.format(d=_DIGITS)}
    else length({_DIGITS}) between 9 and 15 end"""


def _candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all candidates: strict matches in the order of KINDS, then wider ones; each with its validity."""
    d = docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text"))
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    parts = [_found(k, patterns[k], GUARDS[k], True) for k in KINDS] + [_found(k, p, WIDE_GUARDS[k], False) for k, p in WIDE.items()]
    d = d.withColumn("all", F.expr(f"concat({', '.join(parts)})"))
    return d.withColumn("checked", F.expr(f"transform(all, s -> named_struct('s', s, 'valid', {_VALID}))")).drop("all")


def _votes() -> str:
    """SQL for the ballot of candidate c: one vote of 1, 0 or -1 by each labeler."""
    def by_kind(values: dict[str, str]) -> str:
        return "case c.s.kind " + " ".join(f"when {i} then {values[k]}" for i, k in enumerate(KINDS)) + " end"

    ahead = "lower(c.s.ahead)"
    domains = "|".join(DOMAINS)
    pattern = "if(not c.valid, -1, if(c.s.strict, 1, 0))"
    gazetteer = by_kind({
        "email": rf"if(lower(c.s.x) rlike r'(?:\.|dot[)\]]?\x20?)(?:{domains})$', 1, -1)", "ip": "if(c.valid and not c.s.x rlike r'^0', 1, -1)",
        "card": "if(c.valid, 1, -1)", "phone": r"if(c.valid and not c.s.x rlike r'\b000\b', 1, 0)",
    })
    context = f"if({ahead} rlike r'{AGAINST}', -1, if({by_kind({k: f'{ahead} rlike ' + chr(114) + chr(39) + v + chr(39) for k, v in BEFORE.items()})}, 1, 0))"
    borders = r"if(concat(right(c.s.ahead, 1), '|', c.s.after) rlike r'^[\p{L}\p{N}_]|[\p{L}\p{N}_]$', -1, 1)"
    grouping = by_kind({
        "email": "if(length(c.s.x) <= 80, 1, -1)", "ip": "if(length(c.s.x) between 7 and 21, 1, -1)",
        "card": "if(c.s.x rlike r'^(?:[0-9]{12,19}|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\\2[0-9]{5})$', 1, -1)",
        "phone": r"if(c.s.x rlike r'^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}$|^\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}$', 1, 0)",
    })
    return f"array({', '.join((pattern, gazetteer, context, borders, grouping))})"


@dataclass(frozen=True)
class Model:
    reliability: dict[str, float]
    prior: dict[str, float]
    weights: list[float]  # the intercept, the kinds, then for each labeler its vote for and its vote against


def _encode(kind: int, votes: list[int]) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == w) for v in votes for w in (1, -1))]


def estimate(ballots: list[tuple[int, list[int], int]]) -> Model:
    """From (kind, votes, how many): reliabilities and priors by expectation-maximisation, then the classifier's weights."""
    right, prior = [0.8] * len(LABELERS), [0.5] * len(KINDS)
    odds = lambda p: math.log(p / (1 - p))
    hold = lambda p, low, high: min(max(p, low), high)
    posterior: list[float] = []
    for _ in range(ROUNDS):
        posterior = [1 / (1 + math.exp(-(odds(prior[k]) + sum(v * odds(right[j]) for j, v in enumerate(votes))))) for k, votes, _ in ballots]
        for j in range(len(LABELERS)):
            cast = sum(n for _, votes, n in ballots if votes[j])
            agreed = sum(n * (p if votes[j] > 0 else 1 - p) for (_, votes, n), p in zip(ballots, posterior, strict=True) if votes[j])
            right[j] = hold((agreed + 4) / (cast + 5), 0.55, 0.98)
        for k in range(len(KINDS)):
            own = [(n, p) for (kind, _, n), p in zip(ballots, posterior, strict=True) if kind == k]
            prior[k] = hold((sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2), 0.05, 0.95)
    rows, total = [_encode(k, votes) for k, votes, _ in ballots], sum(n for *_, n in ballots) or 1
    w = [0.0] * (1 + len(KINDS) + 2 * len(LABELERS))
    for _ in range(STEPS if ballots else 0):
        grad = [1e-3 * x for x in w]
        for x, p, (*_, n) in zip(rows, posterior, ballots, strict=True):
            miss = n / total * (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - p)
            grad = [g + miss * b for g, b in zip(grad, x, strict=True)]
        w = [a - 1.0 * g for a, g in zip(w, grad, strict=True)]
    if not ballots:
        w[0] = -1.0
    return Model(dict(zip(LABELERS, right, strict=True)), dict(zip(KINDS, prior, strict=True)), w)


def train(docs: DataFrame) -> Model:
    """Reliabilities and weights from the ballots of all candidates of all documents."""
    votes = f"transform(checked, c -> named_struct('kind', c.s.kind, 'votes', {_votes()}))"
    each = _candidates(docs).selectExpr(f"explode_outer({votes}) as b").filter("b IS NOT NULL")  # a filter on the array would search each text twice
    counts = each.groupBy("b.kind", "b.votes").agg(F.count("*").alias("n")).collect()  # at most 4 * 3 ** 5 rows
    return estimate(sorted((r.kind, list(r.votes), r.n) for r in counts))


def _accepted(model: Model) -> str:
    terms = [f"{model.weights[0]!r}D", *(f"if(c.s.kind = {k}, {model.weights[1 + k]!r}D, 0D)" for k in range(len(KINDS)))]
    for j in range(len(LABELERS)):
        a, b = model.weights[1 + len(KINDS) + 2 * j :][:2]
        terms.append(f"case votes[{j}] when 1 then {a!r}D when -1 then {b!r}D else 0D end")
    return f"element_at(transform(array({_votes()}), votes -> {' + '.join(terms)} >= 0), 1)"


def _joined(spans: str) -> Column:
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s.kind + 1)"
    return F.expr(f"array_join(transform(array_sort(transform({spans}, s -> struct(s.start, s.kind, s.end))), s -> concat({names}, ':', s.start, ':', s.end)), ',')")


def personal_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, the number of strict matches of each kind, base_sha256 of them, and all spans."""
    model = model or train(docs)
    d = _candidates(docs).withColumn("base", F.expr("transform(filter(checked, c -> c.s.strict and c.valid), c -> c.s)"))
    # Base spans by start in blocks of about the root of their number, each with its bounds, so that a wider match looks into few of them.
    size = "greatest(cast(ceil(sqrt(size(o))) as int), 1)"
    part = "named_struct('low', get(p, 0).start, 'high', array_max(transform(p, x -> x.end)), 'own', p)"
    cut = f"transform(sequence(1, greatest(size(o), 1), {size}), i -> {_let(f'slice(o, i, {size})', 'p', part)})"
    blocks = _let("array_sort(transform(base, s -> named_struct('start', s.start, 'end', s.end)))", "o", cut)
    free = "not exists(blocks, p -> p.low < c.s.end and c.s.start < p.high and exists(p.own, o -> o.start < c.s.end and c.s.start < o.end))"
    wider = f"filter(checked, c -> c.valid and not c.s.strict and {_accepted(model)})"
    added = _let(blocks, "blocks", f"transform(filter({wider}, c -> {free}), c -> c.s)")
    d = d.withColumn("added", F.expr(f"if(size(checked) > size(base), {added}, cast(array() as {_SPAN}))"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return d.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("concat(base, added)").alias("spans"))
