"""Measurement dataflows: sample statistics, benchmark rows, size and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(x: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.when(F.count(x) > 1, F.stddev_samp(x)), F.lit(0.0))


def sample_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with n, median (mean of the middle two), mean, stdev and least."""
    x = F.col(value)
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), spread(x).alias("stdev"), F.min(x).alias("least"))


def benchmark_rows(samples: DataFrame, keys: list[str], frames: int, fps: float) -> DataFrame:
    """Result rows from (keys, seconds, out_bytes): one run each; rounded as the reports are.

    frames, fps: of the clip, whose length is frames / fps seconds.
    """
    got = samples.groupBy(*keys).agg(
        F.count("seconds").alias("runs"), F.percentile("seconds", F.lit(0.5)).alias("m"), F.min("seconds").alias("b"), spread(F.col("seconds")).alias("s"), F.max("out_bytes").alias("bytes")
    )
    rate = frames / F.col("m")
    return got.select(
        *keys, F.lit(frames).alias("frames"), "runs", F.round(rate, 2).alias("fps"), F.round(frames / F.col("b"), 2).alias("fps_best"), F.round(rate / fps, 2).alias("realtime_x"),
        F.round("m", 4).alias("sec_median"), F.round("b", 4).alias("sec_best"), F.round("s", 4).alias("sec_stdev"),
        F.round(F.col("bytes") / 1e6, 1).alias("out_mb"), F.round(F.col("bytes") * 8 / 1e6 / (frames / fps), 0).alias("mbps"),
    )


def quality_means(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Mean PSNR and SSIM of frames measured elsewhere; infinite PSNR (no difference) stays infinite."""
    return frames.groupBy(*keys).agg(F.avg("psnr").alias("psnr_avg"), F.avg("ssim").alias("ssim_avg"))


def size_ratio(sizes: DataFrame, base: str, other: str) -> DataFrame:
    """(sequence, profile, base, other, ratio) from (sequence, encoder, profile, size_bytes): other over base."""
    by = sizes.groupBy("sequence", "profile").agg(*(F.max(F.when(F.col("encoder") == e, F.col("size_bytes"))).alias(n) for e, n in ((base, "base"), (other, "other"))))
    return by.withColumn("ratio", F.when(F.col("base") > 0, F.col("other") / F.col("base")))


def overview(sizes: DataFrame, first: str = "hq", second: str = "4444") -> DataFrame:
    """(sequence, encoder, size_bytes): a profile's, or another's where that is missing."""
    pick = lambda p: F.max(F.when(F.col("profile") == p, F.col("size_bytes")))
    return sizes.groupBy("sequence", "encoder").agg(F.coalesce(pick(first), pick(second)).alias("size_bytes"))


def pass_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("ok")).alias("passed"), F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("failed"))


def in_order(rows: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the order of a small table (keys, place); what the table has and the rows lack is dropped."""
    return order.join(rows, keys).orderBy("place")


def both_runs(node: DataFrame, browser: DataFrame) -> DataFrame:
    """Two result tables as one; columns that one lacks are null."""
    return node.unionByName(browser, allowMissingColumns=True)


def archive_index(files: DataFrame, range_rows: int = 65_536) -> DataFrame:
    """(n, name, size, crc, offset) of a stored archive from (n, name, data): where each entry's header starts.

    The running sum is made from sums of ranges of n and running sums within them.
    """
    from .container import sample_index

    rows = files.select("n", "name", F.octet_length("data").cast("long").alias("size"), F.crc32("data").alias("crc"))
    index = sample_index(rows.select(F.col("n").alias("frame_idx"), (30 + F.octet_length("name") + F.col("size")).alias("size")), range_rows)
    return rows.join(index.select(F.col("frame_idx").alias("n"), "offset"), "n")


def thread_words(threads: Column) -> Column:
    """'1t' as '1 thread', '8t' as '8 threads'."""
    return F.when(threads == "1t", "1 thread").otherwise(F.concat(F.regexp_replace(threads, "t", ""), F.lit(" threads")))
