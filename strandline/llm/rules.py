"""Quality rules with cross-document line frequency, in DataFrame functions only.

A line (lower-cased, white space collapsed) that more distinct documents of one
host hold than the limit allows is removed from all of them; a document left
with too few of its words is rejected. The limit is ``least`` documents or
``share`` of the host's documents, whichever is more. Documents with the same
text count once, so copies do not condemn each other. Lines count whatever their
length.

Null text counts as empty (no words, hence ``base_failed``); null hosts are one
host. Rows that repeat id and text get the same verdict. The text may hold any
number of lines; nothing is collected beyond one document's own lines. Other
columns, whatever their names, are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.linededup import without
from strandline.llm.scratch import Scratch
from strandline.llm.skew import spread_join

#: Words and the white space between them.
WORDS = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words found twice or more."""

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-width).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width).cast("long"), p - a["last"])).alias("n"))
        return F.aggregate(starts, first, step, lambda a: a["n"])

    def starts(windows: Column) -> Column:
        # equal windows are neighbours once sorted; keep those with an equal neighbour
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        same = lambda s, x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        twins = let(ordered, lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)))
        return F.array_sort(F.transform(twins, lambda x: x["i"]))

    windows = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(starts(h))))
    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(found)


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select("doc_id", F.xxhash64("text").alias("t"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    out = one.select(
        "doc_id", "t",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normal_line(line: Column) -> Column:
    """``line`` (lower-cased, with spaces as its only white space) trimmed, runs of spaces collapsed."""
    return F.trim(F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " +", " ")).otherwise(line))


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, t, host, pos, line (hash of its normal form) and words, of lines with any word."""
    plain = F.translate(F.lower("text"), "\t\x0b\x0c\r", "    ")
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("host"), F.posexplode(F.split(plain, "\n")).alias("pos", "raw"))
    rows = rows.withColumn("normal", normal_line(F.col("raw"))).where("normal <> ''")
    words = F.length("normal") - F.length(F.replace("normal", F.lit(" "), F.lit(""))) + 1
    return rows.select("doc_id", "t", "host", "pos", F.xxhash64("normal").alias("line"), words.cast("long").alias("words"))


def frequent_lines(docs: DataFrame, lines: DataFrame, least: int, share: float) -> DataFrame:
    """host, line, rows: the ``lines`` in more of the host's distinct texts than the limit, and how often they come."""
    hosts = docs.select(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("host"), F.xxhash64("text").alias("t")).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    counted = lines.groupBy("host", "line", "t").agg(F.count("*").alias("rows")).groupBy("host", "line").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).where(F.col("n") > least)
    return counted.join(hosts, "host").where(F.col("n") > F.greatest(F.lit(float(least)), share * F.col("docs"))).select("host", "line", "rows")


def line_verdicts(docs: DataFrame, least: int, share: float) -> DataFrame:
    """doc_id, t, gone (sorted positions of removed lines) and gone_words, of documents that lose lines."""
    scratch = Scratch(docs.sparkSession, "rules")
    lines = scratch.put(document_lines(docs))
    often = scratch.put(frequent_lines(docs, lines, least, share))
    hit = spread_join(lines, often, ["host", "line"], "rows", lines.count())
    gone = hit.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("pos", "words"))).alias("g"))
    return gone.select("doc_id", "t", F.col("g.pos").alias("gone"), F.aggregate(F.col("g.words"), F.lit(0).cast("long"), lambda a, x: a + x).alias("gone_words"))


def judge(docs: DataFrame, least: int = 5, share: float = 0.02, left: float = 0.5) -> DataFrame:
    """``base_rules`` with gone, gone_words, depleted and kept. A document is depleted
    if less than ``left`` of its words remain."""
    gone = line_verdicts(docs, least, share).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "gone", "gone_words")
    base = base_rules(docs)
    joined = base.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left").drop("_d", "_t")
    joined = joined.withColumn("gone_words", F.coalesce("gone_words", F.lit(0).cast("long")))
    joined = joined.withColumn("depleted", (F.col("gone_words") > 0) & (F.col("n_words") - F.col("gone_words") < left * F.col("n_words")))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def clean(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without rejected rows and, in ``text``, without the removed lines."""
    verdict = judge(docs, **how).where("kept").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), F.col("gone").alias("_gone")).dropDuplicates(["_d", "_t"])
    joined = docs.join(verdict, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_t")))
    text = F.when(F.col("_gone").isNull(), docs["text"]).otherwise(F.array_join(without(F.split(docs["text"], "\n"), F.col("_gone")), "\n"))
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
