"""The pipeline's stages, each against what it promises of its own input."""

import collections
import random

import pytest

import corpus_pipeline as pipeline
from framewright.llm import simhash


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_stages(spark, sf_dir, kept):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r.asDict() for r in source.collect()}
    told, alone, cut, mixed, coded = kept
    assert all(set(r) == set(source.columns) for stage in kept[:-1] for r in stage)
    assert len(told) >= 0.97 * len(before) and all(r == before[r["doc_id"]] for r in told)
    left = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in alone}
    assert not any((a ^ b).bit_count() <= 2 for i, a in left.items() for j, b in left.items() if i < j)
    gone = [r for r in told if r["doc_id"] not in left]
    assert all(any((simhash.fingerprint(r["text"]) ^ simhash.fingerprint(o["text"])).bit_count() <= 2 for o in told if o["doc_id"] != r["doc_id"]) for r in gone)
    assert {r["doc_id"] for r in cut} <= set(left) and all(r["n_chars"] == len(r["text"]) for r in cut)
    windows = collections.Counter(r["text"].encode()[i : i + 200] for r in alone for i in range(len(r["text"].encode()) - 199))
    for r in cut:
        if r["text"] == before[r["doc_id"]]["text"]:
            b = r["text"].encode()
            assert all(windows[b[i : i + 200]] == 1 for i in range(len(b) - 199))
    copies = collections.Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in cut} and max(copies.values()) <= 3
    assert len(coded) == len(mixed) and all(r["n_tokens"] == len(r["ids"]) for r in coded)


def test_run(spark, sf_dir, kept):
    rows = pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert sorted(map(key, rows)) == sorted(map(key, kept[-1]))


def prose(seed: int, words: int = 120) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(words))


def test_null_and_repeated_ids_go_through(spark, sf_dir):
    rows = [(None, 1), (None, 2), (None, 2), (5, 3), (5, 4), (6, 5), (6, 5), (7, 5), (None, 3), (8, 6)]
    docs = spark.createDataFrame([(i, prose(t), "en", "web", len(prose(t))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    want = sorted((str(i), prose(t)) for i, t in [(None, 1), (None, 2), (5, 3), (5, 4), (6, 5), (8, 6)])
    alone = pipeline.simhash_stage(spark, docs, sf_dir)
    assert key(alone) == want
    cut = pipeline.suffix_stage(spark, alone, sf_dir)
    assert key(cut) == want
    # one source is taken as it is: each row once, equal rows as often as they are there
    assert key(pipeline.mixing_stage(spark, cut, sf_dir)) == want
    assert key(pipeline.mixing_stage(spark, docs, sf_dir)) == sorted((str(i), prose(t)) for i, t in rows)
    assert pipeline.bpe_stage(spark, cut, sf_dir).count() == len(want)


def test_cuts_drop_no_replacement_character(spark, sf_dir):
    passage = "".join(chr(0x4E00 + i) for i in range(100))
    # of one character before the passage and one after it the texts share some bytes
    rows = [(1, "own � mark 日" + passage + "é end �"), (2, "x 嗥" + passage + "è y"), (3, "� alone")]
    docs = spark.createDataFrame([(i, t, "zh", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.suffix_stage(spark, docs, sf_dir).collect()}
    assert got == {i: (t, len(t)) for i, t in [(1, "own � mark  end �"), (2, "x  y"), (3, "� alone")]}
