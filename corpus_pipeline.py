"""A corpus pipeline: five stages, each on all that the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.bpe import encode_documents
from framewright.llm.common import Scratch, table
from framewright.llm.language import UNKNOWN, identify
from framewright.llm.mixing import mix
from framewright.llm.simhash import simhash_groups
from framewright.llm.suffix import remove_repeats

#: A document goes if no language is likelier than this.
MIN_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; all labelled rows may be learnt from."""
    told = identify(docs, F.lit(True))
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def with_key(docs: DataFrame) -> DataFrame:
    """A 64-bit hash of the whole row as ``__key``, never null: only rows equal in all columns share one."""
    return docs.withColumn("__key", F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)))


def once(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is in ``keys`` (__key, n, any others), equal ones once; n says how many there are.

    There are about as many keys as documents, so both sides are sorted and merged at every size.
    """
    both = lambda some: keyed.join(keys.where(some).hint("merge"), "__key").drop("n")
    out = both("n = 1")
    if keys.where("n > 1").limit(1).count():  # else no text is shuffled for it
        out = out.union(both("n > 1").distinct())
    return out


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, of the smallest id; null only if no row has an id."""
    keyed = with_key(docs)
    groups = simhash_groups(keyed.select("doc_id", "text", "__key"), keep=("__key",))
    first = groups.where(F.col("id").eqNullSafe(F.col("component"))).groupBy("part", "__key").agg(F.count("*").alias("n"))
    first = first.groupBy("part").agg(F.min(F.struct("__key", "n")).alias("x")).select("x.*")
    return once(keyed, Scratch(spark, "kept").write(first, "keys")).select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated byte strings; a text of which nothing is left goes.

    A cut inside a character's bytes drops what is left of that character.
    """
    left = remove_repeats(docs, whole=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    kept = left.where((F.octet_length("kept") > 0) | (F.col("n_removed") == 0)).withColumn("text", text)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    keyed = with_key(docs)
    copies = mix(keyed, "__key").groupBy(F.col("id").alias("__key")).agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    taken = once(keyed, Scratch(spark, "copies").write(copies.where("copies > 0"), "keys"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of their decoding."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "source"])


STAGES = [
    ("language", language_stage),
    ("simhash", simhash_stage),
    ("suffix", suffix_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]
#: A trained network, a sorted index and a random mix: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
