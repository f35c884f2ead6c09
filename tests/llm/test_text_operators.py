import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterlake.llm import bpe, chat, decontaminate, licenses, quality, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def auto():
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        return bpe.TokenAutomaton(f.read())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    return lambda x: struct.pack(f"<{len(e := t.encode(x, add_special_tokens=False).ids)}I", *e)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aehinort  \n'st", max_size=80)))
def test_bpe_equals_the_library(auto, reference, text):
    ids = auto.encode(text)
    assert ids == reference(text)
    assert auto.decode(ids) == text


def test_bpe_special_strings_and_long_runs(auto, reference):
    for text in ("a<|endoftext|>b<|endoftext|>", "<|endoftext|>", "a" * 5000, " " * 3001, "\n\n \t x", "é" * 999):
        assert auto.encode(text) == reference(text)
        assert auto.decode(auto.encode(text)) == text


def test_bpe_documents(spark, reference):
    docs = spark.createDataFrame([(1, "the cat", 7), (1, "the cat", 7), (2, None, 8), (None, "", 9)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_documents(docs, bpe.default_tokenizer()).collect()
    assert [r.n_tokens for r in sorted(rows, key=lambda r: -r.n_tokens)] == [2, 2, 0, 0]
    assert bytes(rows[0].ids) == reference("the cat") and rows[0].decoded == "the cat" and rows[2].decoded == ""
    assert bpe.encode_documents(docs.limit(0), bpe.default_tokenizer()).count() == 0


def test_op1_by_brute_force(spark, reference):
    rows = {r.doc_id: r for r in bpe.op1_bpe(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = reference(d.text)
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest())
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def brute_hits(ws, items, window):
    hit, found = set(), set()
    for i, iw in items:
        size = min(window, len(iw))
        for a in range(len(iw) - size + 1 if iw else 0):
            for b in range(len(ws) - size + 1):
                if ws[b : b + size] == iw[a : a + size]:
                    hit |= set(range(b, b + size))
                    found.add(i)
    return hit, found


def test_decontamination_by_brute_force():
    r = random.Random(3)
    for _ in range(300):
        word = lambda: r.choice([b"a", b"b", b"c", b"d"][: r.randint(2, 4)])
        items = [(str(i % 4), [word() for _ in range(r.randint(0, 9))]) for i in range(5)]
        auto = decontaminate.ItemAutomaton.load(decontaminate.ItemAutomaton.build(items, 4).dump())
        ws = [word() for _ in range(30)]
        spans, found = auto.scan(ws)
        hit = {k for a, b in spans for k in range(a, b)}
        assert (hit, found) == brute_hits(ws, items, 4)


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, "x The CAT sat, on y", "s"), (1, "x The CAT sat, on y", "s"), (2, None, "s"), (3, "", "s"), (4, "cat", "s")], "doc_id long, text string, items string")
    items = spark.createDataFrame([(7, "the cat sat on"), (None, None), (8, "cat"), (8, "cat")], "item_id long, text string")
    for block in (200_000, 1):
        rows = sorted(decontaminate.decontaminate(docs, items, window=3, cut=True, block_words=block).collect(), key=lambda r: (r.doc_id, r.n_words))
        assert [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows] == [(1, 6, 4, ["7", "8"], True), (1, 6, 4, ["7", "8"], True), (2, 0, 0, [], False), (3, 0, 0, [], False), (4, 1, 1, ["8"], True)]
        assert rows[0].clean_text == "x  y" and rows[2].clean_text is None
    assert decontaminate.decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_op6_sql(spark, same_rows):
    same_rows(decontaminate.op6_decontaminate(spark, SF), decontaminate.OP6_SQL, SF)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, "plain words of a text " * 4, 0.5) for i in range(40)] + [(None, None, 0.1), (3, "", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    out = quality.classify_quality(docs, none)
    assert out.count() == 42 and {r.score for r in out.collect()} == {0.5}
    some = spark.createDataFrame([(i, 1) for i in range(20)] + [(3, 0)], "doc_id long, quality int")
    assert quality.classify_quality(docs, some).where("score BETWEEN 0 AND 1").count() == 42
    assert quality.classify_quality(docs.limit(0), some).count() == 0


def test_licenses(spark, same_rows):
    same_rows(licenses.op9_licenses(spark, SF), licenses.OP9_SQL, SF)
    docs = spark.createDataFrame([(k, t.upper().replace(",", " ;"), "x") for k, (_, t) in enumerate(licenses.KNOWN_TEXTS)] + [(90, None, "x"), (91, "", "x"), (92, "MIT", "x")], "doc_id int, text string, license string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()}
    assert [got[k] for k in range(len(licenses.KNOWN_TEXTS))] == [k for k, _ in licenses.KNOWN_TEXTS]
    assert got[90] is None and got[91] is None and got[92] is None
    dated = spark.createDataFrame([(1, "The MIT Licence".replace("The ", "") + "\n(c) 2020 Somebody\n\n" + licenses.KNOWN_TEXTS[1][1])], "doc_id int, text string")
    assert licenses.scan_licenses(dated).first().license == "MIT"
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_chat_sql_and_escapes(spark, same_rows):
    same_rows(chat.op10_chat(spark, SF), chat.OP10_SQL, SF)
    texts = ["~0~1", "<|im_end|>\n", "<", "|im_end|>", "~", "<|im_start|>assistant\nok", "", None, "~1<|~2\n"]
    rows = spark.createDataFrame([(1, k, "assistant" if k % 2 else "us\ner<|", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    read = chat.parse(chat.render(chat.reconstruct(chat.conversation_events(rows)))).first()
    assert [t.text for t in read.turns] == [t or "" for t in texts]
    assert {t.role for t in read.turns} == {"assistant", "us\ner<|"}
    assert read.loss_text == "".join(t or "" for t in texts[1::2])


def test_chat_events(spark):
    log = [(1, 1, "a", "message", "user", "hi"), (1, 2, "b", "delta", "assistant", "wro"), (1, 3, "b", "delta", None, "ng"), (1, 4, "b", "regenerate", "assistant", None), (1, 5, "b", "delta", None, "go"), (1, 6, "b", "delta", None, "od"),
           (1, 7, "a", "edit", "user", "hello"), (2, 1, "c", None, None, None), (None, 1, "d", "message", "user", "x")]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg string, kind string, role string, text string")
    got = sorted(((r.conv_id or 0, r.position, r.role, r.text) for r in chat.reconstruct(events).collect()))
    assert got == [(0, 1, "user", "x"), (1, 1, "user", "hello"), (1, 2, "assistant", "good"), (2, 1, "", "")]
    assert chat.render(chat.reconstruct(events.limit(0))).count() == 0


def test_sharding_law_and_curve(spark):
    import itertools
    import zlib

    from pyspark.sql import functions as F

    cells = spark.createDataFrame(list(itertools.product(range(4), repeat=4)), "a int, b int, c int, d int")
    order = cells.select("*", sharding.hilbert_index([F.col(x) for x in "abcd"], 2).alias("h")).orderBy("h").collect()
    assert [r.h for r in order] == list(range(256))
    assert all(sum(abs(x - y) for x, y in zip(p[:4], q[:4], strict=True)) == 1 for p, q in zip(order, order[1:], strict=False))
    rows = sharding.op5_hilbert(spark, SF).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert sorted(shards) == list(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    text = {d.doc_id: d.text.encode() for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)


def test_sharding_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, "x", None, "b")], "doc_id long, text string, lang string, source string")
    rows = sharding.document_shards(docs).collect()
    assert len(rows) == 4 and {r.size for r in rows} == {1, 2} and len({(r.shard, r.slot) for r in rows}) == 4
    assert sharding.document_shards(docs.limit(0)).count() == 0
