"""The thin queries of these operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, html_text, line_dedup, media, mixing, pieces, quality, simhash, urls
from .common import read

#: Conversation -1, whose texts hold control strings of chat templates.
PROBE = "</s>[INST] ok [/INST]"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; the labels of a third of all documents are not learned from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_model(docs, read(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector among all others."""
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of runs of 50 words or more that occur earlier."""
    return line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH split AS (
    SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), numbered AS (
    SELECT doc_id, unnest(parts) AS string, unnest(range(len(parts))) AS line FROM split
), lines AS (
    SELECT *, len(regexp_extract_all(string, '[^\x20\x09-\x0D]+')) AS words FROM numbered
), counted AS (
    SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM lines WHERE words > 0
), wins AS (
    SELECT doc_id, min(line) OVER f AS a, max(line) OVER f AS z, list(string) OVER f AS content, sum(words) OVER f AS total
    FROM counted WINDOW f AS (PARTITION BY doc_id ORDER BY upto - words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
    UNION ALL
    SELECT doc_id, min(line) OVER f, max(line) OVER f, list(string) OVER f, sum(words) OVER f
    FROM counted WINDOW f AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), ranked AS (
    SELECT *, rank() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST, a) AS place FROM wins WHERE total >= 50
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS line FROM ranked WHERE place > 1
), kept AS (
    SELECT n.doc_id, coalesce(string_agg(n.string, chr(10) ORDER BY n.line) FILTER (g.line IS NULL), '') AS text
    FROM numbered n LEFT JOIN gone g ON n.doc_id IS NOT DISTINCT FROM g.doc_id AND n.line = g.line GROUP BY n.doc_id
)
SELECT d.doc_id, k.text, d.lang, d.source, length(k.text)::BIGINT AS n_chars
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id
"""


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id of its group of near copies."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def piece_model() -> str:
    """Where the vocabulary lies; the file is on every machine and never in this repository."""
    return os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, the ids decoded again, and digests of both."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_texts(docs, piece_model(), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.xxhash64("token_ids").alias("ids_hash"),
        F.length("decoded").cast("long").alias("decoded_chars"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("exact"),
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted by turn, and its digests read back from the output."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    formatted = chat.format_reply_trees(chat.turns_to_chain(rows.unionByName(probe)), best=1)
    turns = F.transform(chat.parse_formatted(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        formatted.withColumn("_turns", turns)
        .withColumn("_loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
        .select(
            F.col("tree_id").cast("long").alias("conv_id"),
            F.size("_turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join("_turns", ""), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


OP6_SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(8 + length(regexp_replace(role || text, '([<\[\\|])', '\1\\', 'g'))))::BIGINT AS formatted_chars
FROM numbered GROUP BY conv_id
"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = html_text.extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP8_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source
), levels AS (
    SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
        row_number() OVER (ORDER BY source_size * (6 // weight), source NULLS LAST) AS pos
    FROM sources
), level AS (
    SELECT rest AS level_rest, weights AS level_weights, pos AS level_pos FROM levels WHERE rest * weight <= 3 * source_size * weights ORDER BY pos LIMIT 1
), targets AS (
    SELECT source, source_size, CASE WHEN pos >= level_pos THEN CAST(level_rest * weight AS DOUBLE) / CAST(level_weights AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target
    FROM levels CROSS JOIN level
), rates AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / CAST(source_size AS DOUBLE), 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
        CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS draw
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rates
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the host rules, or else by the advert patterns."""
    return urls.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH parts AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
    FROM split
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/de/', 'example.com/en/7') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches('.' || host, '\.(ads-track|adserver)\.') OR regexp_matches(path, '/(ads|banners)/') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as JPEG, the stored bytes read back, and their features."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    stored = media.store_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).drop("text")
    return media.media_features(stored).select(
        "doc_id",
        "n_bytes",
        F.col("samples_bytes").alias("payload_bytes"),
        F.col("samples_sha256").alias("payload_sha256"),
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash").alias("feature"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_nearest_neighbours, op3_line_dedup, op4_simhash_near_dedup, op5_sentencepiece, op6_chat_formatting, op7_html_extraction, op8_source_mixing, op9_url_filter, op10_media_columns)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op6_chat_formatting": OP6_SQL, "op8_source_mixing": OP8_SQL, "op9_url_filter": OP9_SQL}
