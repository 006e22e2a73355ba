"""Readers and writers of the small files around the codec: configurations, measurements, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCES = "name string, dir string, width int, height int, fps_num int, fps_den int, num_frames int, has_alpha int, png_pattern string"
RESULTS = (
    "contender string, environment string, threads string, profile string, profileLabel string, frames int, runs int, fps double, fpsBest double, "
    "realtimeX double, encodeSecMedian double, encodeSecBest double, encodeSecStdev double, outMB double, mbps double, note string"
)
METRICS = (
    "sequence string, width int, height int, fps double, num_frames int, has_alpha boolean, "
    "results map<string, map<string, struct<size_bytes: long, psnr_avg: double, ssim_avg: double>>>"
)


def read_sequences(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Sequence configurations: fields between bars, # begins a comment; optionally one name's."""
    rows = spark.read.csv(path, sep="|", comment="#", schema=SEQUENCES, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows if name is None else rows.where(F.col("name") == name)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows by their header, quoted cells allowed; columns that a file lacks are null."""
    have = spark.read.csv(path, header=True, quote='"', escape='"')
    fields = [f.strip().split(" ") for f in RESULTS.split(",")]
    return have.select(*(F.col(n).cast(t).alias(n) if n in have.columns else F.lit(None).cast(t).alias(n) for n, t in fields))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document, over any number of lines."""
    return spark.read.json(path, multiLine=True, schema=schema)


def flatten_metrics(metrics: DataFrame) -> DataFrame:
    """(sequence, encoder, profile, size_bytes, psnr_avg, ssim_avg) from nested quality metrics."""
    by = metrics.select("sequence", F.explode("results").alias("encoder", "profiles"))
    return by.select("sequence", "encoder", F.explode("profiles").alias("profile", "m")).select("sequence", "encoder", "profile", "m.*")


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """Results as json, csv or parquet."""
    writer = rows.write.mode("overwrite")
    {"json": writer.json, "parquet": writer.parquet, "csv": lambda p: writer.csv(p, header=True, quote='"', escape='"')}[kind](path)


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a Markdown table's body, a line per row, in the rows' order."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    return rows.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
