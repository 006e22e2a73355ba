"""Frames as a stream: packets are written as frames arrive, the container index is made at the end.

Frames are independent and there is no state: what is sent twice after a failure is encoded to
the same bytes, and the sink replaces a batch by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.shared import shared_folder
from ..functions.tables import Config
from ..operators.encode import encode_frames
from ..sources.frames import FRAMES, check_frames


def start(frames: DataFrame, config: Config, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Encodes a stream of frames to Parquet packets under ``out``; ``once`` ends when the input is used up.

    How many frames are in flight is the source's limit (maxFilesPerTrigger and the like).
    """
    packets = encode_frames(check_frames(frames, config), config)
    writer = packets.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_to_packets(frames: DataFrame, config: Config, files_per_trigger: int = 4) -> DataFrame:
    """Runs a table of frames through the stream, file by file, and returns its packets."""
    spark = frames.sparkSession
    root = shared_folder(spark, "stream")
    frames.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}/in")
    start(stream, config, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.schema("frame_idx long, size long, data binary").parquet(f"{root}/out")
