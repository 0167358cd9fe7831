"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.revisits import captures, resolve

    return resolve(captures(table(spark, sf_dir, "pages")))


def op2_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.chunk_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.parity_join import Similarity, similar_groups

    return similar_groups(table(spark, sf_dir, "documents"), Similarity(width=3, percent=90))


def op6_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.syncmers import with_neighbours

    return with_neighbours(table(spark, sf_dir, "documents"))


def op8_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.pii import personal_spans

    return personal_spans(table(spark, sf_dir, "documents"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.mixing import document_rates

    return document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weirflow.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op11_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_owner_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.secret_scan import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_revisit_resolution, op2_ppm_langid, op3_crf_extraction, op4_chunk_dedup, op5_parity_join, op6_nb_toxicity, op7_closed_syncmers, op8_weak_pii, op9_soft_mixing, op10_best_fit_packing, op11_suffix_collocations, op12_owner_secrets, op13_whitening, pipeline)}


_OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""


_OP1_SQL = r"""
WITH p AS (SELECT page_id AS id, url, md5(coalesce(html, '')) AS m, length(coalesce(html, '')) AS n, 1700000000 + 60 * page_id AS t,
        '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day-' || (page_id // 100) AS modified FROM pages),
r AS (
    SELECT 'urn:page:' || id || ':0' AS record_id, true AS is_full, url AS uri, t AS captured, tag AS etag, modified, 'md5:' || m AS digest,
        [{'k': 'cache-control', 'v': 'max-age=60'}, {'k': 'content-length', 'v': n::VARCHAR}, {'k': 'content-type', 'v': 'text/html'}, {'k': 'date', 'v': t::VARCHAR}, {'k': 'etag', 'v': tag}, {'k': 'last-modified', 'v': modified}] AS headers FROM p
    UNION ALL SELECT 'urn:page:' || id || ':1', false, CASE WHEN url LIKE 'https:%' THEN 'http:' || substr(url, 7) WHEN url LIKE 'http:%' THEN 'https:' || substr(url, 6) ELSE url END, t + 86400, tag, modified, NULL,
        [{'k': 'cache-control', 'v': 'max-age=120'}, {'k': 'date', 'v': (t + 86400)::VARCHAR}, {'k': 'etag', 'v': 'W/' || tag}] FROM p
    UNION ALL SELECT 'urn:page:' || id || ':2', false, url, t - 3600, NULL, modified, NULL, [{'k': 'date', 'v': (t - 3600)::VARCHAR}, {'k': 'expires', 'v': t::VARCHAR}] FROM p),
c AS (SELECT *, regexp_replace(trim(uri), '#.*$', '') AS u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)(.*)$' AS shape FROM r),
d AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)(.*)$', 1)), '^.*@', ''), '^www[0-9]*[.]', ''), ':(80|443)?$', '') AS host,
        regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)(.*)$', 2), '/+$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(substr(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)(.*)$', 3), 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|gclid|fbclid|ref|sessionid)(=|$)'))), '&') AS query FROM c),
e AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical_url FROM d),
f AS (SELECT *, max(CASE WHEN is_full THEN {'captured': captured, 'record_id': record_id} END) OVER (PARTITION BY canonical_url ORDER BY captured RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM e),
g AS (SELECT f.*, b.record_id AS base_record_id, b.etag AS b_etag, b.modified AS b_modified, b.digest AS b_digest, b.headers AS b_headers FROM f LEFT JOIN r b ON b.record_id = f.base.record_id WHERE NOT f.is_full),
h AS (SELECT *, CASE WHEN base_record_id IS NULL THEN 'no_base' WHEN etag IS NOT NULL THEN CASE WHEN etag = b_etag THEN 'resolved' ELSE 'mismatch' END WHEN modified = b_modified THEN 'resolved' ELSE 'mismatch' END AS status,
        CASE WHEN base_record_id IS NULL THEN NULL WHEN etag IS NOT NULL THEN 'etag' ELSE 'last-modified' END AS validator FROM g)
SELECT record_id, canonical_url, captured, status, base_record_id, validator, CASE WHEN status = 'resolved' THEN b_digest END AS payload_digest,
    CASE WHEN status = 'resolved' THEN array_to_string(list_transform(list_sort(list_concat(list_filter(b_headers, lambda x: NOT list_contains(list_transform(headers, lambda y: y.k), x.k)), headers)), lambda x: x.k || ': ' || x.v), chr(10)) END AS headers
FROM h
"""


_OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
x AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS cut FROM c WHERE k > 1),
y AS (SELECT x.lang, x.phrase, x.f AS a, cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * x.f * n.n) // (l.f::HUGEINT * r.f) AS score
    FROM x JOIN n USING (lang) JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(list_slice(x.w, 1, cut), ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(list_slice(x.w, cut + 1, x.k), ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = z.lang AND c.f >= z.a AND len(c.phrase) > len(z.phrase) AND contains(' ' || c.phrase || ' ', ' ' || z.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_revisit_resolution": _OP1_SQL, "op4_chunk_dedup": _OP4_SQL, "op11_suffix_collocations": _OP11_SQL}
