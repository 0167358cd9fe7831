"""Lexical retrieval with stems: postings with positions, and ranking by cover density.

Words are runs of letters and digits in lower case; their positions count from one and stop words keep theirs. Terms are
English stems of words that are no stop words. Stems are taken of distinct words only, never of every occurrence, and
only occurrences of words that a query can match are moved. A query finds documents with any of its terms, or with all;
the rank adds up covers: least stretches that satisfy the query. A cover counts a tenth, over one more than the words in
it that are no terms of the query, so with any term every occurrence is a cover of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.retrieval import PER_BRANCH

#: What a cover without other words counts.
WEIGHT = 0.1

# The stop words of English, and the tables of its stemmer: endings by step with what they become (a region of
# "2" asks for the second region, "1" for the first), and words with stems of their own.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into through during before after above below to
    from up down in out on off over under again further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now""".split()
)
_STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_OWN |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_OWN_AFTER_PLURAL = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_REGION = re.compile("^(?:gener|commun|arsen)")


def stem(word: str) -> str:
    """The English stem of a word in lower case, by the rules of the second Porter stemmer. Words with other characters than a to z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word in _OWN:
        return _OWN[word]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word)
    after = lambda at: at + m.end() if (m := re.search("[aeiouy][^aeiouy]", w[at:])) else len(w)
    r1 = m.end() if (m := _REGION.match(w)) else after(0)
    r2 = after(r1)
    ends = lambda *endings: next((e for e in sorted(endings, key=len, reverse=True) if w.endswith(e)), "")
    cut = lambda e: w[: len(w) - len(e)]
    # plurals and the endings of verbs
    match ends("sses", "ied", "ies", "us", "ss", "s"):
        case "sses":
            w = w[:-2]
        case "ied" | "ies":
            w = w[:-2] if len(w) > 4 else w[:-1]
        case "s":
            w = w[:-1] if re.search("[aeiouy].", w[:-1]) else w
    if w in _OWN_AFTER_PLURAL:
        return w
    e = ends("eedly", "eed", "ingly", "edly", "ing", "ed")
    match e:
        case "eedly" | "eed":
            w = cut(e) + "ee" if len(cut(e)) >= r1 else w
        case "":
            pass
        case _ if re.search("[aeiouy]", cut(e)):
            w = cut(e)
            if re.search("(?:at|bl|iz)$", w):
                w += "e"
            elif re.search("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif len(w) <= r1 and _short(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # longer endings become shorter ones
    if (e := ends(*_STEP_2, "ogi", "li")) and len(cut(e)) >= r1:
        if e in _STEP_2:
            w = cut(e) + _STEP_2[e]
        elif e == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif cut(e)[-1:] in tuple("cdeghkmnrt"):
            w = cut(e)
    if (e := ends(*_STEP_3, "ative")) and len(cut(e)) >= r1:
        if e != "ative":
            w = cut(e) + _STEP_3[e]
        elif len(cut(e)) >= r2:
            w = cut(e)
    if (e := ends(*_STEP_4, "ion")) and len(cut(e)) >= r2 and (e != "ion" or cut(e)[-1:] in ("s", "t")):
        w = cut(e)
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _short(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(w, stem(w)) for w in batch["word"].to_pylist() if w not in STOP_WORDS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], ["word", "term"])


def stemmed(distinct: DataFrame) -> DataFrame:
    """(word, term) of distinct words (word) that are no stop words."""
    return distinct.mapInArrow(_stems, "word string, term string")


def query_terms(queries: DataFrame, key: str = "query", text: str = "text") -> DataFrame:
    """(key, term, terms): the distinct terms of every query and how many it has."""
    each = queries.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    terms = each.join(stemmed(each.select("word").distinct()), "word").select(key, "term").distinct()
    return terms.withColumn("terms", F.count("*").over(Window.partitionBy(key)))


def postings(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, positions) of the wanted terms (term, distinct) in all documents, positions ascending.

    Documents are read twice: for their distinct words, of which those with a wanted stem are kept, and for the places of
    these. What is not wanted never leaves its task; a document's positions of a term are one row.
    """
    vocabulary = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word")).distinct()
    known = stemmed(vocabulary).join(wanted.select("term"), "term", "left_semi")
    places = docs.select(key, F.posexplode(words(F.col(text))).alias("at", "word")).join(known, "word")
    return places.groupBy(key, "term").agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("positions"))  # as many as the document has


def cover_density(entries: Column, terms: Column, every: bool) -> Column:
    """The rank of a document from its ``entries``, structs of position and term in order, for a query of so many ``terms``.

    With any term each entry is a cover. With all of them a cover ends where the last of the terms has been seen since the one
    before it began, begins as late as that allows, and the next one is looked for behind its beginning.
    """
    if not every:
        return F.size(entries) * WEIGHT
    # For the entry at i as the end of a cover, its beginning is the least of the latest places of all terms up to i; covers
    # that begin where the one before begins are no least ones.
    state = "named_struct('last', cast(map() as map<string,int>), 'from', -1, 'sum', 0D)"
    seen = "map_concat(map_filter(s.last, (k, v) -> k <> e.term), map(e.term, i))"
    begin = "array_min(map_values(m))"
    noise = f"(e.position - element_at(entries, {begin} + 1).position) - (i - {begin})"
    step = f"element_at(transform(array({seen}), m -> if(size(m) < terms or {begin} = s.from, named_struct('last', m, 'from', s.from, 'sum', s.sum), named_struct('last', m, 'from', {begin}, 'sum', s.sum + {WEIGHT}D / (1 + {noise})))), 1)"
    return F.expr(f"aggregate(transform(entries, (e, i) -> named_struct('position', e.position, 'term', e.term, 'i', i)), {state}, (s, e) -> {step.replace('(i - ', '(e.i - ').replace(', i))', ', e.i))')}, s -> s.sum)")


def lexical_rank(queries: DataFrame, docs: DataFrame, k: int = PER_BRANCH, every: bool = False, query: str = "query", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, key, score, rank): for each query of a table the ``k`` documents of the highest rank, ties by key. A query without terms finds nothing."""
    asked = query_terms(queries.select(F.col(query).alias("query"), F.col(text).alias("text")))
    found = postings(docs, asked.select("term").distinct(), key, text).join(asked, "term")
    entry = F.transform("positions", lambda p: F.struct(p.alias("position"), F.col("term").alias("term")))
    per = found.groupBy("query", key, "terms").agg(F.array_sort(F.flatten(F.collect_list(entry))).alias("entries"), F.count("*").alias("matched"))
    per = per.filter("matched = terms") if every else per
    scored = per.select(F.col("query").alias(query), key, cover_density(F.col("entries"), F.col("terms"), every).cast("double").alias("score")).filter("score > 0")
    best = Window.partitionBy(query).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
