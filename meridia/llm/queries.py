"""The opN_<name> queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality, train

    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, _table(spark, sf_dir, "labels")))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import captures_of_pages, resolve_revisits

    found = resolve_revisits(captures_of_pages(_table(spark, sf_dir, "pages")))
    names = ("cache-control", "content-type", "date", "etag", "set-cookie")
    headers = F.concat_ws("|", *(F.concat(F.lit(n + "="), F.col("headers")[n]) for n in names))
    return found.select("record_id", "url_key", "ts", "kind", "source_id", "status", "digest", headers.alias("headers"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import mark_duplicates

    return mark_duplicates(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    back = read_token_files(write_token_files(_table(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    table = _table(spark, sf_dir, "embeddings")
    return top_k(table, table["vec_id"] % 50 == 0)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import mark_near_duplicates

    # of rows that share the smallest id the operator keeps one; the contract's column asks for the id
    marks = mark_near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)
    return marks.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, tokenized_pieces
    from .scratch import materialize

    pieces = tokenized_pieces(_table(spark, sf_dir, "documents"))
    table = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(table).drop("_row")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_counts

    return mix_counts(_table(spark, sf_dir, "documents"))


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    found = whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import new_path
    from .sharding import LAW, read_shards, record_size, write_shards

    path = write_shards(_table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    back = read_shards(spark, path)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return back.select(
        "doc_id", record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_warc_revisits, op3_exact_dedup, op4_token_files, op5_exact_topk,
        op6_minhash_near_dedup, op7_token_counts, op8_html_text, op9_best_fit_packing, op10_mixing,
        op11_tiled_whitening, op12_external_shuffle, op13_phrase_collocations,
    )
}

#: For DuckDB. The other operators are tested against brute force, round trips or held-out
#: rows instead: SQL can't tokenize, train, traverse a DOM or follow links to a fixpoint.
ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d
    """,
    "op5_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op13_phrase_collocations": r"""
        WITH d AS (
          SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), p AS (
          SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
        ), w AS (
          SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
        ), places AS (
          SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0
        ), s AS (
          SELECT lang, w, i, unnest(generate_series(1, least(5, len(w) - i + 1))) AS k FROM places
        ), f AS (
          SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM s GROUP BY ALL
        ), n AS (
          SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
        ), c AS (
          SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= 100
        ), cuts AS (
          SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS cut FROM c
        ), scored AS (
          SELECT x.lang, x.phrase, x.k, a, cut, l.f AS l, r.f AS r, CAST(n AS HUGEINT) AS n, 1000 * a * CAST(n AS HUGEINT) // (l.f * r.f) AS score
          FROM cuts x JOIN n USING (lang)
          JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : cut], ' ')
          JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[cut + 1 : x.k], ' ')
        ), lowest AS (
          SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS m FROM scored
        ), ranked AS (
          SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
          FROM lowest x
          WHERE m = 1 AND NOT EXISTS (
            SELECT 1 FROM c WHERE c.lang = x.lang AND c.k > x.k AND 100 * c.a >= 100 * x.a AND contains(' ' || c.phrase || ' ', ' ' || x.phrase || ' ')
          )
        )
        SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked WHERE rank <= 2000
    """,
    "op2_warc_revisits": r"""
        WITH u AS (
          SELECT page_id, html, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages
        ), k AS (
          SELECT page_id, sha256(coalesce(html, '')) AS digest, url,
            regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
            || regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS place,
            list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
              lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid)(=|$)'))) AS query
          FROM u
        ), p AS (
          SELECT page_id, page_id % 12 AS kind, digest, '"' || substr(digest, 1, 16) || '"' AS tag, page_id * 600 AS day,
                 CASE WHEN url IS NULL THEN NULL ELSE place || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS url_key
          FROM k
        ), responses AS (
          SELECT page_id * 2 AS record_id, url_key, day AS ts, digest, tag, CASE WHEN kind <> 3 THEN tag END AS etag,
                 CASE WHEN kind IN (3, 4) THEN 'day ' || day END AS modified FROM p
        ), revisits AS (
          SELECT page_id * 2 + 1 AS record_id, CASE WHEN kind <> 7 THEN url_key END AS url_key, day, tag,
                 CASE kind WHEN 5 THEN -1 WHEN 6 THEN NULL ELSE day + 86400 END AS ts,
                 CASE WHEN kind IN (1, 3) THEN NULL WHEN kind = 2 THEN '"other"' ELSE tag END AS etag,
                 CASE WHEN kind = 3 THEN 'day ' || day END AS modified FROM p
        ), met AS (
          SELECT v.*, r.record_id AS source_id, r.digest, r.tag AS source_tag, r.etag AS r_etag, r.modified AS r_modified,
                 row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.record_id DESC) AS n
          FROM revisits v LEFT JOIN responses r ON r.url_key = v.url_key AND r.ts <= v.ts
        ), told AS (
          SELECT *, CASE WHEN url_key IS NULL OR ts IS NULL THEN 'invalid' WHEN source_id IS NULL THEN 'missing'
                         WHEN coalesce(etag <> r_etag, false) OR coalesce(modified <> r_modified, false) THEN 'stale'
                         WHEN (etag IS NULL OR r_etag IS NULL) AND (modified IS NULL OR r_modified IS NULL) THEN 'unchecked'
                         ELSE 'resolved' END AS status
          FROM met WHERE n = 1
        )
        SELECT record_id, url_key, ts, 'response' AS kind, record_id AS source_id, CASE WHEN url_key IS NULL THEN 'invalid' ELSE 'full' END AS status, digest,
               'content-type=text/html|date=' || ts || '|etag=' || tag AS headers
        FROM responses
        UNION ALL
        SELECT record_id, url_key, ts, 'revisit', CASE WHEN status = 'resolved' THEN source_id END, status,
               CASE WHEN status = 'resolved' THEN digest END,
               CASE WHEN status = 'resolved' THEN 'content-type=text/html|' ELSE '' END || 'date=' || (day + 86400) || '|etag=' || tag
                 || CASE WHEN status = 'resolved' THEN '' ELSE '|set-cookie=x=1' END
        FROM told
    """,
}
