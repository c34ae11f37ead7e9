"""The operators applied to the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunked_bpe, collocations, decontaminate, line_dedup, merkle, ngram_join, packing, quality, shards, topk, training_order, url_rules
from .shared import new_path

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_read(spark, sf_dir, "conversations"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.stratified_shards(_read(spark, sf_dir, "documents"), 24).drop("source")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.apply_url_rules(_read(spark, sf_dir, "pages"), rules).drop("url")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return chunked_bpe.digests(chunked_bpe.encode_texts(_read(spark, sf_dir, "documents"), path), path)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality.quality_verdicts(docs, _read(spark, sf_dir, "labels"), "lang")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64)


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "training_order")
    index = training_order.write_training_order(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    records = training_order.read_shards(spark, out).select("slot", F.crc32("ids").alias("record_crc32"))
    return index.join(records, "slot")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"), 4, 85)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(_read(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("items")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_perspectives, op2_packing, op3_sharding, op4_url_filter, op5_line_dedup, op6_bpe, op7_quality, op8_top_k, op9_training_order,
        op10_ngram_join, op11_merkle, op12_decontamination, op13_collocations,
    )
}

ORACLES = {
    "op1_perspectives": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS said_by, coalesce(text, '') AS text FROM conversations),
        s AS (SELECT DISTINCT conv_id, said_by AS speaker FROM t WHERE said_by <> 'system'),
        r AS (SELECT t.conv_id, s.speaker, t.turn, t.said_by, t.text,
                CASE WHEN said_by = 'system' THEN 'system' WHEN said_by = speaker THEN 'assistant' ELSE 'user' END AS role
              FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
        n AS (SELECT *, CASE WHEN role = 'user' THEN regexp_replace(said_by, '[\x00-\x20<>|]', '_', 'g') END AS name FROM r),
        h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM n),
        g AS (SELECT *, head || regexp_replace(text, '<\|(\\*)im_', '<|\\\1im_', 'g') || '<|im_end|>' || chr(10) AS segment FROM h),
        p AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, md5(text), said_by ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "at" FROM g)
        SELECT conv_id, speaker, turn::BIGINT AS turn, role, name, segment, "at",
          CASE WHEN role = 'assistant' THEN "at" + length(head) ELSE "at" END::BIGINT AS mask_start,
          CASE WHEN role = 'assistant' THEN "at" + length(segment) - 1 ELSE "at" END::BIGINT AS mask_end,
          role = 'assistant' AS trained
        FROM p""",
    "op4_url_filter": r"""
        WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        f AS (SELECT url, host, path, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY url ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
              FROM (SELECT DISTINCT url, host, path FROM p) JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        SELECT page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, rule, coalesce(r_verdict, 'allow') AS verdict
        FROM p LEFT JOIN (SELECT url, rule, r_verdict FROM f WHERE k = 1) g ON p.url = g.url""",
    "op5_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
        w AS (SELECT doc_id, pos, line, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, pos) AS nth
              FROM w WHERE l2 IS NOT NULL AND regexp_matches(line || l1 || l2, '[^ \t\n\x0b\x0c\r]')),
        c AS (SELECT DISTINCT doc_id, pos + i AS pos FROM k, (VALUES (0), (1), (2)) AS t(i) WHERE nth > 1),
        t AS (SELECT l.doc_id, count(c.pos) AS removed_lines, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
              FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(removed_lines, 0)::BIGINT AS removed_lines, length(t.text)::BIGINT AS n_chars, md5(t.text) AS text_md5
        FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op8_top_k": r"""
        WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op12_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        s AS (SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
        x AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM s)),
        o AS (SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
              FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM x) WHERE len(w) >= size)),
        h AS (SELECT o.row, o.i, o.size, x.item_id FROM o JOIN x ON o.win = x.win AND o.size = x.size),
        c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT row, i, size FROM h)) GROUP BY row),
        t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY row)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)""",
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS k(size) WHERE len(w) >= size)),
        f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        k AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
        c AS (SELECT lang, phrase, size, f AS a, cut, array_to_string(w[:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS cut FROM k)),
        s AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, n, 1000 * a * n // (l.f * r.f) AS score
              FROM c JOIN f l ON c.lang = l.lang AND c.head = l.phrase JOIN f r ON c.lang = r.lang AND c.rest = r.phrase JOIN t ON c.lang = t.lang),
        m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
        h AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f FROM (SELECT lang, f, w, m, unnest(range(1, size - m + 2)) AS i FROM k, (VALUES (2), (3), (4)) AS t(m) WHERE m < size) GROUP BY 1, 2),
        q AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN h ON m.lang = h.lang AND m.phrase = h.phrase WHERE nth = 1 AND (h.f IS NULL OR 100 * h.f < 100 * a))
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM q WHERE rank <= 2000""",
}
