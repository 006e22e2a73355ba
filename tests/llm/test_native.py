"""Chat formatting, URL filters, quality rules and mixing."""

import collections
import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from framewright.llm import chat, mixing, quality_rules, url_filter
from framewright.llm.registry import ORACLES, QUERIES

from ..conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    assert same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


# ---- chat formatting ----

ODD = ["", "</s>[INST] ok [/INST]", "<\\", "[\\[\\", "\\", "<|turn|><|says|><|done|>\n", "<<", "é😀<|image|>", "a\n\nb", "<|done|>\n<|turn|>user<|says|>x"]


def test_escaping_is_reversible_and_hides_control_strings(spark):
    df = spark.createDataFrame([(a + b,) for a in ODD for b in ODD], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in rows)
    marks = [chat.START, chat.SEP, chat.END, *chat.PLACEHOLDERS.values(), "</s>", "<s>", "[INST]", "[/INST]"]
    assert not any(m in r["e"] for r in rows for m in marks)


def test_turns_come_back(spark):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(zip(["user", "assistant"] * 5, ODD, strict=True))]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (None, 0, "assistant", "x"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a"), (4, None, "[x]<", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash")).repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df.select("*", chat.text_parts(F.col("text")).alias("parts")))).collect()}
    assert [t["text"] for t in got[1]["turns"]] == ODD and got[1]["learnt"] == "".join(ODD[1::2])
    assert [tuple(t) for t in got[2]["turns"]] == [("", ""), ("assistant", "")] and got[2]["learnt"] == ""
    assert got[None]["learnt"] == "x" and [t["text"] for t in got[3]["turns"]] == ["a", "a", "b"] and got[4]["turns"][0]["role"] == "[x]<"
    for r in got.values():
        for s in r["loss_spans"]:
            text = r["formatted"][s["start"] : s["start"] + s["length"]]
            assert r["formatted"].encode()[s["byte"] : s["byte"] + s["bytes"]].decode() == text


def test_parts_become_placeholders(spark):
    parts = [("text", "see <", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3), ("odd", "z", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", [("image", None, None, None, None, None, None)])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_chat(df).first()
    assert "see <\\<|image|><|audio|><|document|>z<|done|>" in row["formatted"]
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(1, 1, "image", "a.png", 4), (1, 2, "audio", "b.wav", 63), (1, 3, "document", "c.pdf", 3072), (3, 0, "image", None, 1)]
    assert (row["n_attachments"], row["expanded_tokens"]) == (4, 3140)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(empty.select("*", chat.text_parts(F.col("text")).alias("parts"))).count() == 0


# ---- URL filters ----


def test_as_of(spark):
    day = lambda d: datetime.date(2024, 1, d)
    entries = spark.createDataFrame(
        [("domain:bad.com", True, day(5)), ("domain:bad.com", False, day(10)), ("domain:bad.com", True, day(20)), ("prefix:ok.org/x/y", True, day(1)), ("term:casino", True, day(1)), ("host:a.b.net", True, day(3)), ("host:a.b.net", False, day(3)), (None, True, day(1)), ("domain:bad.com", True, day(5))],
        "key string, listed boolean, since date",
    )
    cases = [
        ("http://www.bad.com/1", 4, 0), ("http://www.bad.com/1", 5, 1), ("http://bad.com:80", 9, 1), ("http://bad.com", 10, 0), ("HTTPS://U:P@WWW.BAD.COM./?q", 25, 1), ("http://notbad.com", 25, 0), ("http://ok.org/x/y/z", 2, 1),
        ("http://ok.org/x/yy", 2, 0), ("http://q.com/Casino-royal", 2, 1), ("http://a.b.net", 3, 1), ("http://z.a.b.net", 3, 0), (None, 5, 0), ("nonsense bad.com", 25, 0), ("", 5, 0), ("http://bad.com/casino", 6, 2), ("http://bad.com", None, 0),
    ]
    rows = [(i, u, day(d) if d else None, "clash") for i, (u, d, _) in enumerate(cases)] + [(1, cases[1][0], day(5), "clash"), (None, cases[1][0], day(5), "clash")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched date, key string"), entries).collect()
    assert len(got) == len(rows) and all(r["n_active"] == (cases[r["id"]][2] if r["id"] is not None else 1) and r["kept"] == (r["n_active"] == 0) for r in got)
    empty = spark.createDataFrame([], "page_id long, url string, fetched date")
    assert url_filter.filter_urls(empty, entries).count() == 0
    assert all(r["kept"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched date, key string"), entries.limit(0)).collect())


# ---- quality rules ----


def test_rules_on_small_texts(spark):
    clean = " ".join(a + b for a in "abcde" for b in "fghijklm")  # figures would be made alike
    own = lambda i: "unique " + "xyz"[i % 3] * (1 + i // 3) + " "
    common = "this very line is on nearly every page of the host " * 1
    rows = [(i, "h", f"{common}\n{own(i)}{clean}", 0) for i in range(30)] + [(100 + i, "h", f"{common}\n{' '.join('abcdefghijklmnopqrs')}", 0) for i in range(3)]
    rows += [(200, None, None, 0), (201, "h", "", 0), (202, "k", "x " * 5000, 0), (203, "h", "a b\n a b\na b\n\n\n", 0), (204, "k", " ".join(f"w{i % 8}" for i in range(24)), 0), (None, "k", clean, 0), (205, "k", clean, 0), (205, "k", clean, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, hash int")
    got = collections.defaultdict(list)
    for r in quality_rules.quality_rules(df).collect():
        got[r["id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0]["kept"] and got[i][0]["n_common_words"] == 11 for i in range(30))
    assert all(not got[100 + i][0]["kept"] and not got[100 + i][0]["base_failed"] for i in range(3))
    assert got[200][0]["n_words"] == got[201][0]["n_words"] == 0 and got[200][0]["base_failed"]
    assert got[202][0]["n_repeat_words"] == 5000 and got[202][0]["base_failed"]
    assert got[203][0]["n_dup_lines"] == 1 and got[204][0]["n_repeat_words"] == 24
    assert got[None][0]["kept"] and len(got[205]) == 2 and all(r["kept"] for r in got[205])
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_repeated_rows_are_documents_of_their_own(spark):
    common = " ".join(f"c{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    own = lambda k: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for i in range(60))
    rows = [(k, common + "\n" + own(k), "a") for k in range(9)] + [(9, common + "\n" + own(9), "a")] * 2 + [(9, common + "\n" + own(9), "b")]
    got = [r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    # 11 documents of host a hold the line, one of host b
    assert sorted((r["id"], r["n_common_words"], r["kept"]) for r in got) == sorted([*((k, 40, True) for k in range(9)), (9, 40, True), (9, 40, True), (9, 0, True)])


def test_repeated_windows_by_brute_force(spark):
    import random

    draw = random.Random(6)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randrange(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.base_rules(df).collect():
        w = r["text"].split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = collections.Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(8)}
        assert r["n_repeat_words"] == len(covered)


# ---- mixing ----


def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, active, out = float(sum(sizes.values())), set(order), {}
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in active}
        for s in over:
            out[s] = 3.0 * sizes[s]
            active.discard(s)
        left -= sum(out[s] for s in over)
    return out


def test_mix(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, f"s{i % 5}" if i % 9 else None, words(1 + i * 37 % 90)) for i in range(700)] + [(1000 + i, "big", words(50)) for i in range(700)] + [(2000, "tiny", words(2)), (2001, "none", None), (2002, "none", ""), (None, "s1", "a b"), (5, "s0", words(4))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r["id"] is None, r["id"] or 0, r["size"])
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(again, key=key)]
    assert sorted((r["id"] is None, r["id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len((t or "").split())) for i, _, t in rows)
    of = {(i, len((t or "").split())): s for i, s, t in rows}
    sums = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        s = sums[of[r["id"], r["size"]]]
        s[0], s[1], s[2] = s[0] + r["size"], s[1] + r["taken"], r["target"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    expected = targets({k: v[0] for k, v in sums.items()})
    for k, (size, taken, target) in sums.items():
        assert target == pytest.approx(expected[k]) and abs(taken - target) <= max(2, 0.002 * size), k
    assert mixing.mix(df.limit(0)).count() == 0


def test_fold_by_plain_loops(spark):
    """One block of each source: documents meet in the order of their draws, the last one and two more close."""
    draw = __import__("random").Random(4)
    rows = [(i, "ab"[i % 2], " ".join(["w"] * draw.randrange(1, 30))) for i in range(50)] + [(0, "a", "w w")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    own = df.select(F.col("doc_id").alias("id"), "source", F.concat(F.lit("s"), "source").alias("key"), F.size(F.split("text", " ")).cast("long").alias("size"), F.xxhash64("text").alias("th"))
    drawn = [r.asDict() for r in mixing.numbered(own).select("*", mixing.draw(F.col("row"), 0).alias("u")).collect()]
    assert len({r["row"] for r in drawn}) == len(rows)
    expected = targets({s: sum(r["size"] for r in drawn if r["source"] == s) for s in "ab"})
    want = []
    for s in "ab":
        block = sorted((r for r in drawn if r["source"] == s), key=lambda r: (r["u"], r["id"]))
        share = expected[s] / sum(r["size"] for r in block)
        whole, p = int(share + 1e-9), [max(0.0, share - int(share + 1e-9))] * len(block)
        at = 0
        for k in range(1, len(block)):
            if p[at] in (0.0, 1.0):
                at = k
                continue
            wa, wx = block[at]["size"], block[k]["size"]
            up, down = min((1 - p[at]) * wa, p[k] * wx), min(p[at] * wa, (1 - p[k]) * wx)
            move = up if block[k]["u"] * (up + down) < down else -down
            p[at], p[k] = p[at] + move / wa, p[k] - move / wx
            p = [0.0 if abs(v) < 1e-9 else 1.0 if abs(v - 1) < 1e-9 else v for v in p]
            at = k if p[at] in (0.0, 1.0) else at
        ends = [float(round(v)) for v in p]
        over = sum((e - v) * r["size"] for e, v, r in zip(ends, p, block, strict=True))
        gain = [(1 - 2 * e) * r["size"] for e, r in zip(ends, block, strict=True)]
        best = min([abs(over), *(abs(over + g) for g in gain), *(abs(over + gain[i] + gain[j]) for i in range(len(gain)) for j in range(i))])
        want.append((s, whole, best))
    got = mixing.mix(df).join(df.select(F.col("doc_id").alias("id"), "source").distinct(), "id").collect()
    for s, whole, best in want:
        own_rows = [r for r in got if r["source"] == s]
        assert {r["copies"] - whole for r in own_rows} <= {0, 1} and len(own_rows) == sum(r[1] == s for r in rows)
        assert abs(sum(r["taken"] for r in own_rows) - expected[s]) == pytest.approx(best, abs=1e-6)


def test_hot_ids_fill_no_block(spark):
    rows = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("w "), F.col("id") % 1000).alias("text"))
    own = rows.select(F.col("doc_id").alias("id"), "source", F.lit("sa").alias("key"), F.lit(2).cast("long").alias("size"), F.xxhash64("text").alias("th"))
    got = mixing.numbered(own)
    assert got.count() == got.select("row").distinct().count() == 3_000


def test_every_document_has_its_chance(spark):
    """Over seeds, documents of one source are taken about as often as their share."""
    rows = [(i, s, " ".join(["w"] * 10)) for i, s in enumerate(["a"] * 100 + ["b"] * 100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = collections.Counter()
    for seed in range(6):
        mixing.SEED = 100 + seed
        taken.update({r["id"]: r["copies"] for r in mixing.mix(df).collect()})
    mixing.SEED = 8
    share = [taken[i] / 6 for i in range(100)]
    assert sum(share) / 100 == pytest.approx(2 / 3, abs=0.03) and max(share) <= 1 and sum(s in (0, 1) for s in share) < 45


def test_digests_are_of_the_plain_texts(spark, sf_dir):
    row = QUERIES["op1_chat"](spark, sf_dir).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
