"""Registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import langid, linededup, media, minhash, mixing, packing, quality, rules, tokencount, urls

#: The URL rules of the contract.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Weights of sources, in code point order, repeating.
MIX_WEIGHTS = (5, 2, 1)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    gone = linededup.removals(docs).select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "removed")
    joined = lines.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.col("removed.pos").alias("removed_at"), F.col("removed.kept_doc").alias("kept_doc"), F.col("removed.kept_pos").alias("kept_pos"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.digest(media.read_media(stored)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_codes")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = _table(spark, sf_dir, "labels").where(_remainder(4) != 2).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, labelled))
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048, 0)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, 3)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, docs.where(_remainder(3) != 1))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "gone_words")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_words", "n_tokens")


QUERIES = {f.__name__: f for f in (op1_minhash, op2_url_filter, op3_line_dedup, op4_media, op5_quality, op6_pack, op7_mix, op8_language, op9_rules, op10_tokens)}

#: The SQL of rule 9: words and windows by position, line frequencies by host and distinct text.
_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, text, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
tri AS (SELECT doc_id, i, [word, lead(word, 1) OVER p, lead(word, 2) OVER p] AS t, lead(word, 2) OVER p IS NOT NULL AS whole
        FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri WHERE whole) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
rawl AS (SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS raw FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM rawl WHERE regexp_matches(raw, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT doc_id, text, source, lower(regexp_replace(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g')) AS line FROM rawl),
lines AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM norm WHERE line <> ''),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
often AS (SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT text) AS n FROM lines GROUP BY source, line) l
          JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source WHERE l.n > 5 AND l.n > 0.02 * h.docs),
gone AS (SELECT l.doc_id, sum(l.words) AS words FROM lines l JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.line = l.line GROUP BY l.doc_id),
base AS (SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
                CAST(length(array_to_string(w.words, '')) AS BIGINT) AS word_chars,
                CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                CAST(coalesce(gone.words, 0) AS BIGINT) AS gone_words
         FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (gone_words > 0 AND n_words - gone_words < 0.5 * n_words) AS kept, gone_words
FROM judged
"""

#: Where SQL cannot express a query (trained models, signatures, rounding, tokenizers) it has none.
ORACLE_SQL = {"op9_rules": _RULES_SQL}
