"""Operator 6: quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one whole text. The cross-document rule hashes normalised lines (trimmed, in
lower case, digits made 0, gaps made one space), counts the documents of each host that hold a
line, and removes lines that more than ``MIN_DOCS`` documents and more than ``MAX_SHARE`` of the
host's documents hold. A document of which fewer than ``MIN_WORDS`` words or less than
``MIN_LEFT`` of its words are left is rejected as depleted.

Shuffles: (host, line hash) pairs, counted before they are shuffled, so a line that a third of
all documents hold is one row per task; and the lines above the limits, joined back on (host,
hash), of which a document sends each once. Texts are never shuffled.

Defined results: null and empty texts have no words and fail the base rules; a null host is a
host; empty lines are no lines; a line counts once per document; repeated rows count as documents
of their own and get the same verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, Scratch, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
MIN_DOCS, MAX_SHARE, MIN_LEFT = 10, 0.05, 0.3


def tokens(text: Column) -> Column:
    """The words of a text; only its ends could give empty ones, so they are trimmed first."""
    whole = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, GAP))


def paired(hashes: Column, step: int) -> Column:
    """Hashes of each hash with the one ``step`` after it."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def count_covered(windows: Column, size: int = WINDOW) -> Column:
    """Words under windows whose hash is found twice, from the sorted windows."""
    same = lambda w, i, j: F.coalesce(F.get(windows, j)["h"] == w["h"], F.lit(False))
    marked = F.filter(windows, lambda w, i: same(w, i, i - 1) | same(w, i, i + 1))
    return F.array_sort(F.transform(marked, lambda w: w["i"]))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns with n_words, the base counts and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    out = docs.withColumns({"n_symbols": F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("long"), "__lines": lines, "__tokens": tokens(F.col(text))})
    out = out.withColumns({"n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "n_words": F.size("__tokens").cast("long"), "word_chars": F.char_length(F.array_join("__tokens", "")).cast("long")})
    # a word is hashed once: a window of eight is a pair of fours, which are pairs of twos
    out = out.withColumn("__1", F.transform("__tokens", lambda w: F.xxhash64(w)))
    for size in (1, 2, 4):
        out = out.withColumn(f"__{2 * size}", paired(F.col(f"__{size}"), size))
    # most texts repeat no window: only the others are sorted, for equal ones to be neighbours
    plain = F.size(F.array_distinct(f"__{WINDOW}")) == F.size(f"__{WINDOW}")
    windows = F.transform(f"__{WINDOW}", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("__sorted", F.when(plain, F.slice(windows, 1, 0)).otherwise(F.sort_array(windows)))
    out = out.withColumn("__marked", count_covered(F.col("__sorted")))
    covered = F.aggregate(F.transform("__marked", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__marked"), i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x)
    out = out.withColumn("n_repeat_words", covered)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__lines", "__tokens", "__1", "__2", "__4", "__8", "__sorted", "__marked")


def normal_lines(docs: DataFrame, ident: str, host: str, text: str) -> DataFrame:
    """(id, mark, host, hash, words): each different normalised line of each text once, with the words of all its copies."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(ident).alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("n")).alias("host"), F.explode(F.split(whole, "\n")).alias("line"))
    # most lines have neither figures nor wide gaps: to look is cheaper than to replace
    line = F.lower("line")
    line = F.when(line.rlike("[1-9]"), F.regexp_replace(line, "[1-9]", "0")).otherwise(line)
    rows = rows.select("id", "mark", "host", F.trim(line, F.lit(SPACES)).alias("line")).where("line <> ''")
    rows = rows.withColumn("line", F.when(F.col("line").rlike(r"[\x09-\x0D]|  "), F.regexp_replace("line", GAP, " ")).otherwise(F.col("line")))
    words = F.char_length("line") - F.char_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return rows.select("id", "mark", "host", F.xxhash64("line").alias("hash"), words.alias("words"))


def quality_rules(docs: DataFrame, ident: str = "doc_id", host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """(id, the base columns, n_common_words, kept) for each row."""
    scratch = Scratch(docs.sparkSession, "quality")
    own = docs.select(F.col(ident).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    lines = normal_lines(own, "id", "host", "text")
    of = F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("n"))
    hosts = own.groupBy(of.alias("host")).agg(F.count("*").alias("docs"))
    # a line counts once per document: the partial count sees a document's copies of it together
    once = lines.groupBy("host", "hash", "id", "mark").agg(F.sum("words").alias("words"))
    # a row that is there several times is as many documents, each with its own words alone
    several = scratch.write(own.groupBy(F.col("id").alias("rid"), F.xxhash64("text").alias("rmark"), of.alias("rhost")).agg(F.count("*").alias("rows")).where("rows > 1"), "several")
    same = lambda df: df["id"].eqNullSafe(F.col("rid")) & (df["mark"] == F.col("rmark")) & (df["host"] == F.col("rhost"))
    once = once.join(several, same(once), "left").select("host", "hash", "id", "mark", F.expr("words div coalesce(rows, 1)").alias("words"), F.coalesce("rows", F.lit(1)).alias("rows"))
    seen = scratch.write(once, "lines")
    counts = seen.groupBy("host", "hash").agg(F.sum("rows").alias("n")).where(F.col("n") > min_docs)
    common = scratch.write(counts.join(hosts, "host").where(F.col("n") > max_share * F.col("docs")).select("host", "hash"), "common")
    removed = scratch.write(seen.join(common, ["host", "hash"], "left_semi").groupBy("id", "mark", "host").agg(F.sum("words").alias("n_common_words")), "removed")
    scratch.drop("lines")
    base = base_rules(own.select("id", "text", F.xxhash64("text").alias("mark"), of.alias("host"))).drop("text")
    both = base.join(removed.withColumnsRenamed({"id": "rid", "mark": "rmark", "host": "rhost"}), same(base), "left")
    common_words = F.coalesce("n_common_words", F.lit(0)).cast("long")
    left = F.col("n_words") - common_words
    kept = ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words"))
    return both.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), common_words.alias("n_common_words"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: base counts and verdict for every document; hosts are sources."""
    return quality_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('h' || source, 'n') AS host,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), rep AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY ALL
), line AS (
  SELECT rid, host, trim(regexp_replace(translate(lower(l), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS l
  FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS l FROM d)
), once AS (
  SELECT rid, host, l, sum(length(l) - length(replace(l, ' ', '')) + 1) AS words FROM line WHERE l <> '' GROUP BY ALL
), hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host), common AS (
  SELECT host, l FROM (SELECT host, l, count(*) AS n FROM once GROUP BY ALL) JOIN hosts USING (host) WHERE n > 10 AND n > 0.05::DOUBLE * docs
), gone AS (SELECT rid, sum(words) AS c FROM once JOIN common USING (host, l) GROUP BY ALL), base AS (
  SELECT rid, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0)
      - coalesce(len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))), 0) AS n_dup_lines
  FROM d
), al AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(c, 0) AS c
  FROM base LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - c >= 20 AND n_words - c >= 0.3::DOUBLE * n_words AS kept,
  CAST(c AS BIGINT) AS n_common_words
FROM al
"""
