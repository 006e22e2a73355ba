"""Operator 4: URL filters by a temporal list join, in DataFrame functions only.

List entries are dated: a key is listed, or taken off the list, from a date on. Per key they
become validity intervals, each from a listing to the next entry. A capture has the keys of its
host's domains, of its host, of the leading parts of its path and of its terms; it is blocked if
a key of it is listed when it was fetched: the as-of join is an equality join on the key, with
the key's intervals in one row, so a capture meets a key once however often the key was changed.

The join leaves the side of it to Spark: a list below the broadcast threshold is sent to all
tasks, any larger one is joined by sorting, where a hot host's part is split by the adaptive
skew join. Only ids and keys are shuffled, pages are not read.

Defined results: a null or unreadable URL has no keys and is kept; a null fetch date meets no
entry; of entries of a key on one date the listing wins, repeated ones are one; an interval holds
its first date and not its last; repeated captures stay rows of their own; an empty list keeps
all, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
# The production list. Each of these domains under each ending is listed from the
# first date; then come single later entries.
BAD, ENDINGS, FIRST = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("com", "net", "org"), "2023-06-01"
LATER = (
    ("domain:spam-farm.example.org", False, "2024-03-10"),
    ("domain:spam-farm.example.org", True, "2024-03-20"),
    ("domain:ads-track.example.com", False, "2023-09-01"),
    ("domain:ads-track.example.com", True, "2023-11-15"),
    ("term:warez", True, "2024-02-01"),
    ("prefix:download.example.com/free", True, "2023-12-24"),
    ("host:m.adult-x.example.net", True, "2023-07-01"),
)
#: Captures of the query are dated over this many days from this date.
DAYS, SINCE = 180, "2024-01-01"


def entries() -> list[tuple[str, bool, str]]:
    return [(f"domain:{b}.example.{e}", True, FIRST) for b in BAD for e in ENDINGS] + list(LATER)


def intervals(dated: DataFrame) -> DataFrame:
    """(key, spans) from (key, listed, since): spans are the intervals (since, until) in order, until null for open ones."""
    last = dated.where("key IS NOT NULL AND since IS NOT NULL").groupBy("key", "since").agg(F.max("listed").alias("listed"))
    order = Window.partitionBy("key").orderBy("since")
    ended = last.withColumn("until", F.lead("since").over(order)).where("listed")
    return ended.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("since", "until"))).alias("spans"))


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))


def keys_of(url: Column, host: Column) -> Column:
    """All keys under which a capture can be listed, each once."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    path = F.regexp_extract(F.coalesce(url, F.lit("")), SCHEME + r"[^/?#]*(/[^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    upto = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    domains = F.transform(upto(labels), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(upto(parts), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    terms = F.transform(F.filter(F.split(F.lower(F.concat(host, path)), "[^a-z0-9]+"), lambda x: x != ""), lambda t: F.concat(F.lit("term:"), t))
    return F.when(host != "", F.array_distinct(F.concat(domains, F.array(F.concat(F.lit("host:"), host)), prefixes, terms))).otherwise(F.array().cast("array<string>"))


def filter_urls(captures: DataFrame, dated: DataFrame, ident: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(id, url, fetched, host, n_active, reason, kept) for each capture; reason is the first key that is listed."""
    scratch = Scratch(captures.sparkSession, "urls")
    listed = scratch.write(intervals(dated), "intervals")
    rows = captures.select(F.col(ident).alias("id"), F.col(url).alias("url"), F.col(fetched).alias("fetched"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "mark": F.xxhash64("id", "url", "fetched")})
    asked = rows.where("fetched IS NOT NULL").select("id", "mark", "fetched", F.explode(keys_of(F.col("url"), F.col("host"))).alias("key"))
    active = F.exists("spans", lambda s: (s["since"] <= F.col("fetched")) & (s["until"].isNull() | (F.col("fetched") < s["until"])))
    hits = asked.join(listed, "key").where(active).groupBy("id", "mark").agg(F.countDistinct("key").alias("n_active"), F.min("key").alias("reason"))
    both = rows.join(hits.withColumnsRenamed({"id": "hid", "mark": "hmark"}), F.col("id").eqNullSafe(F.col("hid")) & (F.col("mark") == F.col("hmark")), "left")
    n = F.coalesce("n_active", F.lit(0)).cast("long")
    return both.select("id", "url", "fetched", "host", n.alias("n_active"), "reason", (n == 0).alias("kept"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all pages against the production list; a page's fetch date is a function of its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit(SINCE).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(DAYS)).cast("int")))
    rows = ", ".join(f"('{k}', {str(x).lower()}, DATE '{d}')" for k, x, d in entries())
    got = filter_urls(captures, spark.sql(f"SELECT * FROM VALUES {rows} AS t(key, listed, since)"))
    return got.select(F.col("id").alias("page_id"), "host", F.col("fetched").cast("string").alias("fetched"), "n_active", "reason", "kept")


OP4_SQL = r"""
WITH entry(key, listed, since) AS (VALUES %s), span AS (
  SELECT key, listed, since, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM entry
), page AS (
  SELECT page_id, url, DATE '%s' + CAST((page_id * 37) %% %d AS INTEGER) AS fetched,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages
), asked AS (
  SELECT page_id, url, fetched, 'host:' || host AS key FROM page
  UNION SELECT page_id, url, fetched, 'domain:' || array_to_string(string_split(host, '.')[i:], '.')
    FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM page)
  UNION SELECT page_id, url, fetched, 'prefix:' || host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[:i], '/')
    FROM (SELECT *, unnest(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1)) AS i FROM page)
  UNION SELECT page_id, url, fetched, 'term:' || t FROM (SELECT *, unnest(regexp_split_to_array(lower(host || path), '[^a-z0-9]+')) AS t FROM page) WHERE t <> ''
), hit AS (
  SELECT page_id, url, count(DISTINCT key) AS n, min(key) AS reason FROM asked JOIN span USING (key)
  WHERE listed AND since <= fetched AND (until IS NULL OR fetched < until) GROUP BY ALL
)
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched, CAST(coalesce(n, 0) AS BIGINT) AS n_active, reason, n IS NULL AS kept
FROM page LEFT JOIN hit USING (page_id, url)
""" % (", ".join(f"('{k}', {str(x).lower()}, DATE '{d}')" for k, x, d in entries()), SINCE, DAYS)
