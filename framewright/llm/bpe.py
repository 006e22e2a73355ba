"""Operator 5: byte-level BPE encoding and decoding.

Every text is encoded with the tiktoken library from a local rank file, without special tokens,
and the ids are decoded again to raw bytes. Long texts are cut first, at boundaries where the
split pattern always ends a match, so no cut changes an id:

* between a character that isn't white space and one that is: no match spans that place, as only
  a match's first character can be white space before other text;
* where even that is missing, between the pattern's own matches.

A single match of more than ``LONG_MATCH`` bytes is merged with a heap, in n log n steps.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows and ids
stay separate rows; an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of more characters than this are cut, into parts of about as many.
PART_CHARS = 16_384
#: A match of more bytes than this is merged with a heap.
LONG_MATCH = 2_048
# What the tiktoken library takes as white space (Unicode's White_Space property).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the content of a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the pair of lowest rank, leftmost first, is merged until none is left."""
    n = len(piece)
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone], end[i] = False, stop
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := back[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encodes and decodes with one rank file and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.ranks = ranks
        self.split = regex.compile(re.sub(r"\[[^]]*\]|\\[sS]", lambda m: m[0].replace(r"\s", SPACE) if m[0][0] == "[" else f"[{'^' * (m[0] == r'\S')}{SPACE}]", pattern))
        self.gap = regex.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
        self.long = regex.compile(f"[^{SPACE}]{{{LONG_MATCH // 4}}}|[{SPACE}]{{{LONG_MATCH // 4}}}")
        self.own = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in parts; True if the part is one match of the pattern."""
        at = 0
        while len(text) - at > PART_CHARS:
            if found := self.gap.search(text, at + 1 + PART_CHARS // 2, at + PART_CHARS):
                yield text[at : found.start()], False
                at = found.start()
                continue
            for m in self.split.finditer(text, at):  # no safe place near: match by match
                yield m[0], True
                at = m.end()
                if self.gap.match(text, at):
                    break
            else:
                return
        if at < len(text):
            yield text[at:], False

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_MATCH:
            return self.own.encode_ordinary(text)
        ids: list[int] = []
        for part, single in self.parts(text):
            if single:
                data = part.encode()
                ids += merge(data, self.ranks) if len(data) > LONG_MATCH else self.own._encode_single_piece(data)
            elif self.long.search(part):
                for m in self.split.finditer(part):
                    data = m[0].encode()
                    ids += merge(data, self.ranks) if len(data) > LONG_MATCH else self.own._encode_single_piece(data)
            else:
                ids += self.own.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.own.decode_bytes(ids)


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """The columns in ``keep`` (all) with ``ids`` (optional), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    rank_file: the file's content, about a megabyte; it goes to the executors as a broadcast
    variable, so they need no such file. The text of each row is read whole; rows stay where
    they are, nothing is shuffled.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(rank_file)
    own = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] * ids + [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)])
    codecs: dict[str, Codec] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codecs.get(pattern) or codecs.setdefault(pattern, Codec(read_ranks(sent.value), pattern))
        for batch in batches:
            rows, n, digests, back = [], [], [], []
            for value in batch.column(len(own)):
                got = codec.encode(value.as_py() or "")
                array = np.array(got, dtype="<u4")
                n.append(len(got))
                digests.append(hashlib.sha256(array.tobytes()).hexdigest())
                back.append(hashlib.sha256(codec.decode(got)).hexdigest())
                if ids:
                    rows.append(array.astype(np.int32))
            columns = [batch.column(i) for i in range(len(own))]
            if ids:
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(flat)))
            columns += [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*own, F.col(text).alias("__text")).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every text of ``documents`` encoded and decoded."""
    import public_tokenizers

    from .common import table

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"], ids=False)
