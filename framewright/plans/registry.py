"""The queries of the frame engine. Fixtures have a frame per thousand rows of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.shared import shared_folder
from ..functions.tables import CHROMA, DC_BOOKS, FIRST_DC_BOOK, LEVEL_BOOKS, LUMA, RUN_BOOKS, Config
from ..operators import blocks, color, container, encode, stats, symbols
from ..sources import frames as sources
from ..sources import records
from . import coded, oracles

#: The plain fixture, and one with odd sizes and two slices in a row.
SMALL = (128, 80)
ODD = Config(131, 37, profile=3)
ODD_444 = Config(131, 37, profile=4)
#: The quantizer of the queries on symbols.
Q = 4

QUERIES: dict = {}
ORACLES = oracles.ORACLES | coded.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.frame_ids(spark.read.parquet(f"{sf_dir}/events.parquet"))


def pixels(spark: SparkSession, sf_dir: str, size: tuple[int, int]) -> DataFrame:
    return sources.synthetic_pixels(ids(spark, sf_dir), *size)


def rgba(spark: SparkSession, sf_dir: str, config: Config) -> DataFrame:
    return sources.synthetic_frames(ids(spark, sf_dir), config.width, config.height)


def summary(samples: DataFrame) -> DataFrame:
    v = F.col("v").cast("long")
    return samples.groupBy("frame_idx", "plane").agg(F.count("*").alias("n"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.sum(v).alias("sum_v"), F.sum(v * (F.col("x") + 1 + 3 * (F.col("y") + 1))).alias("weighted"))


def padded(spark, sf_dir, config: Config) -> DataFrame:
    px = pixels(spark, sf_dir, (config.width, config.height))
    return color.pad(color.yuv444(px, alpha=True) if config.is_444 else color.yuv422(px), config)


def coefficients(spark, sf_dir, config: Config = ODD) -> DataFrame:
    return blocks.dct_blocks(blocks.dct_rows(color.tiles(padded(spark, sf_dir, config), config)))


def dc(spark, sf_dir) -> DataFrame:
    return symbols.dc_symbols(blocks.dc_levels(coefficients(spark, sf_dir), ODD, Q))


def ac(spark, sf_dir) -> DataFrame:
    return blocks.ac_levels(blocks.ac_entries(coefficients(spark, sf_dir), ODD), Q)


def sizes(spark, sf_dir) -> DataFrame:
    """Packets whose sizes are those of the events' properties."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("frame_idx"), F.octet_length("props").cast("long").alias("size"))


# ---- sources ----


@query
def src13_fixture(spark, sf_dir):
    total = lambda c: F.sum(c).cast("long").alias(f"sum_{c}")
    return pixels(spark, sf_dir, SMALL).groupBy("frame_idx").agg(F.count("*").alias("n"), *map(total, "rgba"))


@query
def src1_frames(spark, sf_dir):
    config = Config(*SMALL)
    return sources.check_frames(rgba(spark, sf_dir, config), config).select("frame_idx", F.octet_length("rgba").cast("long").alias("n_bytes"), F.sha2("rgba", 256).alias("sha256"))


@query
def src2_dimensions(spark, sf_dir):
    """Frames that are refused, and why."""
    k = F.col("frame_idx") % 4
    frames = rgba(spark, sf_dir, Config(*SMALL)).withColumns({"width": F.col("width") + F.when(k == 1, 1).otherwise(0), "rgba": F.when(k == 2, F.substring("rgba", 1, 100)).when(k != 3, F.col("rgba"))})
    return frames.select("frame_idx", sources.frame_fault(Config(*SMALL)).alias("fault"))


@query
def src13_gradient(spark, sf_dir):
    total = lambda c: F.sum(c).cast("long").alias(f"sum_{c}")
    return sources.gradient(ids(spark, sf_dir), 320, 240).groupBy("frame_idx", "y").agg(F.count("*").alias("n"), *map(total, "rgba"))


@query
def src13_alpha_pattern(spark, sf_dir):
    return sources.alpha_pattern(ids(spark, sf_dir), *SMALL).groupBy("frame_idx", "r", "g", "b", "a").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"))


@query
def src6_png_sequence(spark, sf_dir):
    """Frames through a folder of PNG files."""
    config, folder = Config(*SMALL), shared_folder(spark, "files")
    sources.write_png(rgba(spark, sf_dir, config), folder, "shot_%d.png")
    got = sources.decode_png(sources.image_sequence(spark, folder), config)
    return got.select("frame_idx", F.octet_length("rgba").cast("long").alias("n_bytes"), F.sha2("rgba", 256).alias("sha256"))


@query
def src7_natural_order(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("shot_"), F.col("p_partkey").cast("string"), F.lit(".PNG")).alias("name"))
    return sources.number_names(names.where(F.lower("name").endswith(".png"))).select("frame_idx", "name")


@query
def src9_first_frames(spark, sf_dir):
    return sizes(spark, sf_dir).where(F.col("frame_idx") < 150).select("frame_idx", "size")


@query
def src4_converted(spark, sf_dir):
    """Packets of frames that come in converted: the same as of their pixels."""
    config = Config(*SMALL)
    got = encode.encode_converted(encode.convert_frames(rgba(spark, sf_dir, config), config), config)
    return got.select("frame_idx", "size", F.md5("data").alias("md5"))


@query
def src8_raw_file(spark, sf_dir):
    """Frames through one flat file of fixed-size records."""
    config, path = Config(*SMALL), f"{shared_folder(spark, "files")}/clip.raw"
    sources.write_raw(rgba(spark, sf_dir, config), path)
    return sources.raw_frames(spark, path, config).select("frame_idx", F.octet_length("rgba").cast("long").alias("n_bytes"), F.sha2("rgba", 256).alias("sha256"))


@query
def src10_bars(spark, sf_dir):
    """Sequence configurations between bars, with comments."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.concat_ws("|", F.concat(F.lit("seq_"), F.col("p_partkey")), F.lit("in"), 16 * F.col("p_size"), F.lit(480), F.lit(30), F.lit(1), F.col("p_partkey") % 90, F.col("p_partkey") % 2, F.lit("f_%04d.png"))
    text = parts.select(F.explode(F.array(F.lit("# a comment"), line)).alias("value"))
    text.write.mode("overwrite").text(path := f"{shared_folder(spark, "files")}/sequences")
    return records.read_sequences(spark, path).select("name", F.col("width").cast("long").alias("width"), F.col("num_frames").cast("long").alias("num_frames"), F.col("has_alpha").cast("long").alias("has_alpha"))


@query
def src11_json(spark, sf_dir):
    """Nested quality metrics, a document each, flattened."""
    rows = _sizes_by_encoder(spark, sf_dir).withColumn("m", F.struct("size_bytes", F.lit(50.0).alias("psnr_avg"), F.lit(0.9).alias("ssim_avg")))
    by = rows.groupBy("sequence", "encoder").agg(F.map_from_entries(F.collect_list(F.struct("profile", "m"))).alias("p"))
    docs = by.groupBy("sequence").agg(F.map_from_entries(F.collect_list(F.struct("encoder", "p"))).alias("results"))
    docs.write.mode("overwrite").json(path := f"{shared_folder(spark, "files")}/metrics")
    return records.flatten_metrics(spark.read.schema(records.METRICS).json(path)).select("sequence", "encoder", "profile", "size_bytes")


@query
def src12_csv(spark, sf_dir):
    """Result rows with quoted cells, read by their header."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = parts.select(F.concat(F.lit('a "quoted", '), "p_name").alias("contender"), F.concat(F.col("p_size"), F.lit("t")).alias("threads"), F.col("p_retailprice").alias("fps"), F.col("p_partkey").alias("runs"))
    records.write_report(rows, path := f"{shared_folder(spark, "files")}/results", "csv")
    got = records.read_results(spark, path)
    return got.select("contender", stats.thread_words(F.col("threads")).alias("threads"), "fps", F.col("runs").cast("long").alias("runs"), F.col("mbps").isNull().alias("no_mbps"))


@query
def src14_matte(spark, sf_dir):
    a = sources.matte(F.col("x"), F.col("y"), F.col("frame_idx"), *SMALL, 30.0)
    return pixels(spark, sf_dir, SMALL).select("frame_idx", a.alias("a")).groupBy("frame_idx").agg(F.count("*").alias("n"), F.min("a").alias("least"), F.max("a").alias("most"), F.sum("a").alias("sum_a"))


# ---- projections ----


@query
def prj1_yuv422(spark, sf_dir):
    return summary(color.yuv422(pixels(spark, sf_dir, SMALL)))


@query
def prj1_yuv422_odd(spark, sf_dir):
    return summary(color.yuv422(pixels(spark, sf_dir, (ODD.width, ODD.height))))


@query
def prj2_yuv444(spark, sf_dir):
    return summary(color.yuv444(pixels(spark, sf_dir, SMALL)))


@query
def prj3_yuva444(spark, sf_dir):
    return summary(color.yuv444(pixels(spark, sf_dir, SMALL), "full", alpha=True))


@query
def prj4_clamp(spark, sf_dir):
    px = pixels(spark, sf_dir, SMALL)
    raw = {(n, k): color.raw_sample(n, F.col("r"), F.col("g"), F.col("b"), k) for k in ("limited", "full") for n in ("y", "cb", "cr")}
    rows = px.select(F.explode(F.array(*(F.struct(F.lit(k).alias("color_range"), F.lit(n).alias("plane"), v.alias("raw"), F.lit(color.COLOR[k][n][4]).alias("low"), F.lit(color.COLOR[k][n][5]).alias("high")) for (n, k), v in raw.items()))).alias("s")).select("s.*")
    v = C.clamp(F.col("raw"), F.col("low"), F.col("high"))
    return rows.groupBy("color_range", "plane").agg(F.count_if(F.col("raw") < F.col("low")).alias("below"), F.count_if(F.col("raw") > F.col("high")).alias("above"), F.min(v).cast("long").alias("min_v"), F.max(v).cast("long").alias("max_v"))


@query
def prj5_pad(spark, sf_dir):
    return summary(padded(spark, sf_dir, ODD))


@query
def prj6_alpha16(spark, sf_dir):
    v = F.col("v")
    return color.alpha16(padded(spark, sf_dir, ODD_444), ODD_444).groupBy("frame_idx", "mb_row", "slice").agg(F.count("*").alias("n"), F.sum(v).cast("long").alias("sum_v"), F.sum(v * (F.col("i") % 97 + 1)).cast("long").alias("weighted"))


def _tiles(spark, sf_dir, config):
    tiled = color.tiles(padded(spark, sf_dir, config).where("plane <> 'a'"), config)
    return tiled.groupBy("frame_idx", "mb_row", "slice", "plane", "block_no").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("sum_v"), F.sum(F.col("v") * (8 * F.col("r") + F.col("c") + 1)).cast("long").alias("weighted"))


@query
def prj7_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir, ODD)


@query
def prj7_tiles_444(spark, sf_dir):
    return _tiles(spark, sf_dir, ODD_444)


@query
def prj8_quant_ac(spark, sf_dir):
    got = ac(spark, sf_dir)
    return got.groupBy("frame_idx", "mb_row", "slice", "plane").agg(F.count("*").alias("n"), F.count_if(F.col("level") > 0).alias("coded"), F.sum("level").cast("long").alias("sum_level"), F.sum("rest").cast("long").alias("sum_rest"))


@query
def prj9_quant_dc(spark, sf_dir):
    got = blocks.dc_levels(coefficients(spark, sf_dir), ODD, Q)
    return got.select("frame_idx", "mb_row", "slice", "plane", "block_no", F.col("dc").cast("long").alias("dc"), F.col("level").cast("long").alias("level"))


@query
def prj10_matrix(spark, sf_dir):
    entries = lambda plane, m: spark.range(64).select(F.lit(plane).alias("plane"), F.col("id").alias("raster"), C.lookup(m, F.col("id")).cast("long").alias("m"))
    matrix = entries("y", LUMA[1]).unionByName(entries("cb", CHROMA[1]))
    return blocks.scaled_matrix(matrix, spark.range(1, 10).select(F.col("id").alias("q")))


# ---- transform ----


@query
def trf1_dct_rows(spark, sf_dir):
    rows = blocks.dct_rows(color.tiles(padded(spark, sf_dir, ODD), ODD))
    return rows.select("frame_idx", "mb_row", "slice", "plane", "block_no", "r", *(F.col(f"p{u}").cast("long").alias(f"p{u}") for u in range(8)))


@query
def trf1_dct_block(spark, sf_dir):
    got = coefficients(spark, sf_dir)
    weighted = F.aggregate(F.transform("coef", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return got.select("frame_idx", "mb_row", "slice", "plane", "block_no", F.get("coef", F.lit(0)).cast("long").alias("dc"), F.get("coef", F.lit(63)).cast("long").alias("last"), weighted.alias("weighted"), F.size(F.filter("coef", lambda v: v != 0)).cast("long").alias("nonzero"))


# ---- symbols and costs ----


@query
def win1_dc_delta(spark, sf_dir):
    return dc(spark, sf_dir).select("frame_idx", "mb_row", "slice", "plane", "block_no", F.col("delta").cast("long").alias("delta"))


@query
def win2_dc_codebook(spark, sf_dir):
    return dc(spark, sf_dir).select("frame_idx", "mb_row", "slice", "plane", "block_no", F.col("code").cast("long").alias("code"), F.col("book").cast("long").alias("book"))


@query
def win3_scan_pos(spark, sf_dir):
    got = blocks.ac_entries(coefficients(spark, sf_dir), ODD)
    return got.groupBy("frame_idx", "mb_row", "slice", "plane").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("last_pos"), F.sum(F.col("pos") * F.col("coeff")).cast("long").alias("weighted"), F.sum("raster").cast("long").alias("sum_raster"))


@query
def win4_runs(spark, sf_dir):
    got = symbols.ac_symbols(ac(spark, sf_dir))
    return got.groupBy("frame_idx", "mb_row", "slice", "plane").agg(F.count("*").alias("n"), F.sum("run").cast("long").alias("sum_run"), F.max("run").cast("long").alias("max_run"), F.sum(F.col("run") * F.col("level")).cast("long").alias("weighted"))


@query
def win5_ac_context(spark, sf_dir):
    got = symbols.ac_symbols(ac(spark, sf_dir))
    return got.groupBy("frame_idx", "mb_row", "slice", "plane", "run_context", "level_context").agg(F.count("*").alias("n"))


@query
def win6_alpha_rle(spark, sf_dir):
    runs = symbols.alpha_runs(color.alpha16(padded(spark, sf_dir, ODD_444), ODD_444))
    bits = symbols.alpha_bits(runs)
    sums = runs.groupBy("frame_idx", "mb_row", "slice").agg(F.count("*").alias("islands"), F.sum("run").cast("long").alias("sum_run"), F.sum("diff").cast("long").alias("sum_diff"))
    return sums.join(bits, ["frame_idx", "mb_row", "slice"]).withColumn("bits", F.col("bits").cast("long"))


def _codewords(spark):
    books = sorted({FIRST_DC_BOOK, *RUN_BOOKS, *LEVEL_BOOKS, *DC_BOOKS})
    return spark.range(300).select(F.col("id").alias("value"), F.explode(F.array(*map(F.lit, books))).alias("book"))


@query
def agg1_code_bits(spark, sf_dir):
    return _codewords(spark).select(F.col("book").cast("long").alias("book"), "value", C.code_bits(F.col("book"), F.col("value")).alias("bits"))


@query
def bit2_codewords(spark, sf_dir):
    word = F.lpad(F.bin(C.code_word(F.col("book"), F.col("value"))), C.code_bits(F.col("book"), F.col("value")).cast("int"), "0")
    return _codewords(spark).select(F.col("book").cast("long").alias("book"), "value", word.alias("word"))


@query
def bit3_zigzag(spark, sf_dir):
    return spark.range(-500, 500).select(F.col("id").alias("value"), C.zigzag(F.col("id")).alias("code"))


@query
def bit4_run_level(spark, sf_dir):
    rows = spark.range(16).select(F.col("id").alias("context"))
    return rows.select("context", C.lookup(RUN_BOOKS, F.col("context")).cast("long").alias("run_book"), C.lookup(LEVEL_BOOKS, F.least(F.col("context"), F.lit(9))).cast("long").alias("level_book"))


@query
def agg2_dc_cost(spark, sf_dir):
    return symbols.dc_cost(dc(spark, sf_dir)).select("frame_idx", "mb_row", "slice", "plane", F.col("dc_bits").cast("long").alias("dc_bits"), F.col("dc_error").cast("long").alias("dc_error"))


@query
def agg3_ac_cost(spark, sf_dir):
    return symbols.ac_cost(ac(spark, sf_dir)).select("frame_idx", "mb_row", "slice", "plane", F.col("ac_bits").cast("long").alias("ac_bits"), F.col("ac_error").cast("long").alias("ac_error"))


@query
def agg4_plane_cost(spark, sf_dir):
    return symbols.plane_cost(symbols.dc_cost(dc(spark, sf_dir)), symbols.ac_cost(ac(spark, sf_dir))).drop("slice_width")


@query
def bit1_plane_bits(spark, sf_dir):
    got = symbols.plane_bits(dc(spark, sf_dir), symbols.ac_symbols(ac(spark, sf_dir)))
    return got.select("frame_idx", "mb_row", "slice", "plane", F.length("text").cast("long").alias("bits"), F.md5("text").alias("md5"))


# ---- frames ----


@query
def win8_trellis(spark, sf_dir):
    return encode.slice_quantizers(rgba(spark, sf_dir, ODD), ODD)


@query
def bit5_slices(spark, sf_dir):
    return encode.frame_slices(rgba(spark, sf_dir, ODD), ODD).select("frame_idx", "mb_row", "slice", "q", "size", F.md5("data").alias("md5"))


@query
def bit6_assembled(spark, sf_dir):
    return encode.assemble_frames(encode.frame_slices(rgba(spark, sf_dir, ODD), ODD), ODD).select("frame_idx", "size", F.md5("data").alias("md5"))


@query
def bit7_frame_header(spark, sf_dir):
    return encode.encode_frames(rgba(spark, sf_dir, ODD), ODD).select("frame_idx", F.lower(F.hex(F.substring("data", 5, 152))).alias("header"))


@query
def bit8_frame_md5(spark, sf_dir):
    config = Config(*SMALL)
    return encode.encode_frames(rgba(spark, sf_dir, config), config).select("frame_idx", "size", F.md5("data").alias("md5"))


@query
def bit8_frame_4444_md5(spark, sf_dir):
    return encode.encode_frames(rgba(spark, sf_dir, ODD_444), ODD_444).select("frame_idx", "size", F.md5("data").alias("md5"))


# ---- container ----


@query
def win7_offsets(spark, sf_dir):
    return container.sample_index(sizes(spark, sf_dir), 1000)


@query
def agg5_totals(spark, sf_dir):
    return container.totals(sizes(spark, sf_dir), Config(*SMALL, fps_num=30000, fps_den=1001))


@query
def mux_file_index(spark, sf_dir):
    return container.file_index(sizes(spark, sf_dir), Config(*SMALL, fps_num=30000, fps_den=1001), 1000)


def _packets(spark, sf_dir, config: Config) -> DataFrame:
    """Encoded once and written: a movie's parts read them twice."""
    path = shared_folder(spark, "packets")
    encode.encode_frames(rgba(spark, sf_dir, config), config).write.parquet(path)
    return spark.read.schema(encode.PACKETS).parquet(path)


def _parts(packets: DataFrame, config: Config) -> DataFrame:
    got = container.movie_parts(packets, container.Movie(config))
    return got.select("place", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("md5"))


@query
def mux_movie(spark, sf_dir):
    """What stands where in a movie's file: its start, each encoded frame, its end."""
    config = Config(*SMALL)
    return _parts(_packets(spark, sf_dir, config), config)


@query
def mux_boxes(spark, sf_dir):
    """The boxes before and after the packets, a row each."""
    config = Config(*SMALL)
    ends = container.movie_parts(_packets(spark, sf_dir, config), container.Movie(config)).where(~F.substring("data", 5, 4).eqNullSafe(F.lit(b"icpf")))

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                whole = data[: -8] if data[4:8] == b"ftyp" else data  # without the header of the packets' own box
                found = [(path, size, hashlib.md5(whole[at : at + size]).hexdigest()) for path, at, size, _ in container.list_boxes(whole)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["path", "n_bytes", "md5"])

    return ends.select("data").mapInArrow(run, "path string, n_bytes long, md5 string")


@query
def stream_movie(spark, sf_dir):
    """The movie of packets that came through the stream: made when the stream has ended."""
    from ..streaming.packets import stream_to_packets

    config = Config(*SMALL)
    return _parts(stream_to_packets(rgba(spark, sf_dir, config), config), config)


@query
def win9_reorder(spark, sf_dir):
    late = sizes(spark, sf_dir).repartition(16, F.xxhash64("frame_idx"))
    return container.reorder(late)


@query
def win10_times(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    times = events.select(F.col("event_id").alias("frame_idx"), (F.col("event_id") * 1001).alias("timestamp"), F.lit(1001).cast("long").alias("duration"))
    return container.with_times(sizes(spark, sf_dir), times)


# ---- measurements ----


@query
def agg6_stats(spark, sf_dir):
    got = stats.sample_stats(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "value")
    return got.select("event_type", "n", "median", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "least")


@query
def agg7_benchmark_rows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = events.select("event_type", (F.abs("value") + 0.5).alias("seconds"), (F.octet_length("props") * 100000).cast("double").alias("out_bytes"))
    return stats.benchmark_rows(samples, ["event_type"], 150, 30.0)


@query
def agg8_quality_means(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = stats.quality_means(events.select("event_type", F.col("value").alias("psnr"), (F.col("value") / 100).alias("ssim")), ["event_type"])
    return got.select("event_type", F.round("psnr_avg", 6).alias("psnr_avg"), F.round("ssim_avg", 8).alias("ssim_avg"))


@query
def agg9_has_alpha(spark, sf_dir):
    some = F.when(F.col("frame_idx") % 2 == 0, F.col("a")).otherwise(255)  # every other frame is opaque
    return sources.has_alpha(pixels(spark, sf_dir, SMALL).withColumn("a", some))


def _sizes_by_encoder(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    profile = C.lookup(("proxy", "lt", "hq", "4444"), F.col("o_orderkey") % 4)
    return orders.groupBy(F.col("o_orderpriority").alias("sequence"), F.when(F.col("o_custkey") % 2 == 0, "native").otherwise("other").alias("encoder"), profile.alias("profile")).agg(F.count("*").alias("size_bytes"))


@query
def agg10_ratio(spark, sf_dir):
    return stats.size_ratio(_sizes_by_encoder(spark, sf_dir), "native", "other").withColumn("ratio", F.round("ratio", 9))


@query
def agg10_overview(spark, sf_dir):
    sizes_ = _sizes_by_encoder(spark, sf_dir)
    # one encoder has no result of the first profile
    return stats.overview(sizes_.withColumn("profile", F.when(F.col("encoder") == "other", F.replace("profile", F.lit("hq"), F.lit("lt"))).otherwise(F.col("profile"))))


@query
def agg11_pass_counts(spark, sf_dir):
    return stats.pass_counts(spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("value") > 50).alias("ok")))


@query
def agg12_archive(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = events.select(F.col("event_id").alias("n"), F.format_string("take_%05d.json", F.col("event_id")).alias("name"), F.col("props").cast("binary").alias("data"))
    return stats.archive_index(files, 1000)


@query
def framerate_fraction(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.round(F.col("p_partkey") / 64 + 10, 3).alias("fps")).distinct()
    rates = parts.union(spark.sql("SELECT * FROM VALUES (23.976D), (29.97D), (59.94D), (24D), (25D), (12.5D), (14.985D) AS t(fps)")).distinct()
    return rates.select("fps", C.rate_fraction(F.col("fps")).alias("f")).select("fps", "f.num", "f.den")


@query
def framerate_precedence(spark, sf_dir):
    """A fraction that is given whole, else a rate, else 30/1."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_partkey").alias("k"))
    num, den = F.when(F.col("k") % 2 == 0, F.col("k")), F.when(F.col("k") % 3 == 0, F.lit(7))
    fps = F.when(F.col("k") % 5 < 3, C.lookup((23.976, 25.0, 59.94), F.col("k") % 5))
    return parts.select("p_partkey", C.resolve_rate(num, den, fps).alias("f")).select("p_partkey", "f.num", "f.den")


@query
def scalar_text(spark, sf_dir):
    """Big-endian words, sizes in words, codes of profiles, numbered names, and seconds since 1904."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, hexed = F.col("o_orderkey"), lambda v, n: F.hex(C.big_endian(v, n))
    code = C.fourcc(key % 7)
    return orders.select(
        "o_orderkey", hexed(key % 65536, 2).alias("be16"), hexed(key, 4).alias("be32"), hexed(key * 1_000_000_007, 8).alias("be64"), C.human_size(key * key).alias("words"),
        code.alias("fourcc"), C.profile_of(code).cast("long").alias("profile"), F.format_string("frame_%04d.png", key + 1).alias("name"), C.movie_time(F.col("o_orderdate")).alias("seconds"),
    )


@query
def union_results(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    node = orders.groupBy(F.col("o_orderstatus").alias("contender")).agg(F.count("*").alias("runs"), F.max("o_totalprice").alias("fps"))
    browser = orders.groupBy(F.col("o_orderpriority").alias("contender")).agg(F.count("*").alias("runs"))
    return stats.both_runs(node, browser)


@query
def join_report_order(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    order = spark.sql("SELECT * FROM VALUES (4L, 'NATION_4'), (1L, 'NATION_12'), (3L, 'ATLANTIS'), (2L, 'NATION_2') AS t(place, n_name)")
    return stats.in_order(nation.select("n_name", "n_nationkey"), order, ["n_name"])


@query
def stream_packets(spark, sf_dir):
    from ..streaming.packets import stream_to_packets

    config = Config(*SMALL)
    return stream_to_packets(rgba(spark, sf_dir, config), config).select("frame_idx", "size", F.md5("data").alias("md5"))
