import io
import zipfile

import numpy as np
import pytest

import corpus_pipeline
from rasterlake.llm import embeddings, html_extract, jaccard, warc
from rasterlake.llm.common import connected_components
from rasterlake.llm.html_dom import parse

SF = "/root/testdata/sf0.001"


def components(nodes, links):
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_connected_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    want = components({x for e in edges for x in e}, edges)
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert connected_components(df.limit(0)).count() == 0


def brute_jaccard(rows):
    sets = []
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append((i, {tuple(ws[k : k + 5]) for k in range(max(len(ws) - 4, 1))} if ws else set()))
    links = [(x, y) for x in range(len(sets)) for y in range(x) if sets[x][1] and sets[y][1] and 100 * len(sets[x][1] & sets[y][1]) >= 80 * len(sets[x][1] | sets[y][1])]
    label = components(range(len(sets)), links)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    return [(i, len(s), least.get(label[k])) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_jaccard_by_brute_force(spark, block):
    rng = np.random.default_rng(block)
    base = [[f"w{x}" for x in rng.integers(0, 50, 40)] for _ in range(4)]
    rows = []
    for k in range(120):
        words = list(base[k % 4])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, 40))] = f"e{rng.integers(0, 9)}"
        rows.append((int(k), " ".join(words[: int(rng.integers(30, 41))])))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "A b"), (504, "a  B"), (None, rows[0][1]), (7, rows[7][1]), (None, "only here for no key")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sid int")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = jaccard.near_duplicates(df, block=block, frequent=3).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_jaccard(rows)))
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in rng.integers(1, 60, 500)]
    for k in range(0, 400, 2):
        sets[k + 1] = np.unique(np.concatenate([sets[k][: max(1, int(len(sets[k]) * 0.9))], sets[k + 1][:1]]))
    n = np.array([len(s) for s in sets])
    tree = jaccard.CountTree(sets, n, 80, 100)
    for q in range(len(sets)):
        near = set(tree.near(q)[0].tolist())
        for j in range(len(sets)):
            a, b = set(sets[tree.order[q]].tolist()), set(sets[tree.order[j]].tolist())
            if 100 * len(a & b) >= 80 * len(a | b):
                assert j in near


def test_grouping_of_near_copies_by_brute_force():
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        for _ in range(60):
            now = base.copy()
            change = int(rng.integers(0, 14))
            now[rng.choice(60, change, replace=False)] = rng.integers(0, 1 << 62, change).astype(np.uint64)
            sets.append(np.unique(now))
    n = np.array([len(s) for s in sets])
    root = list(range(len(sets)))
    whole = [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(whole[i] & whole[j]) >= 80 * len(whole[i] | whole[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert len(set(root)) > 6
    assert jaccard.link_group(sets, n, 80, 100).tolist() == root


def test_op4_sql(spark, same_rows):
    same_rows(jaccard.op4_jaccard(spark, SF), jaccard.OP4_SQL, SF)


def test_embeddings(spark, same_rows):
    same_rows(embeddings.op8_embeddings(spark, SF), embeddings.OP8_SQL, SF)


def test_embedding_edges_by_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 24))
    rows = [(k, (base[k % 20] + rng.normal(size=24) * 0.17).tolist()) for k in range(150)]
    rows += [(200, None), (201, []), (202, [0.0] * 24), (203, [None] + [1.0] * 23), (204, [float("nan")] * 24), (205, [float("inf")] + [0.0] * 23), (206, rows[3][1]), (206, rows[3][1]), (207, [1e300] * 24), (208, [1e-300] * 24), (209, [1.0] * 8), (None, rows[5][1])]
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: embeddings.unit(np.array([rows[k][1]]))[0] for k in good}
    links = [(a, b) for a in good for b in good if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    label = components(range(len(rows)), links)
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        low = min(ids) if ids else None
        want.append((i, sum(a == k for a, _ in links), low, i is not None and i == low))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for tile in (4096, 16):
        assert sorted(map(key, embeddings.near_vectors(df, tile=tile).collect())) == sorted(map(key, want))
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    assert embeddings.near_vectors(df.where("vec_id BETWEEN 200 AND 205")).count() == 6


def test_html_on_held_out_pages_and_table(spark):
    import html
    import re

    model = html_extract.trained()
    made = [html_extract.page_maker(88_000_000 + k) for k in range(150)]
    got = html_extract.extract([h for h, _ in made], model)
    assert sum(g == "\n\n".join(" ".join(m.split()) for m in main) for g, (_, main) in zip(got, made, strict=True)) / len(made) > 0.93

    def by_tags(h):
        body = h.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body))
        return "\n\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_extract.op2_html(spark, SF).collect():
        assert r.text == by_tags(pages[r.page_id]) and r.n_chars == len(r.text)


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, "u", "x"), (2, "", "u", "x"), (3, "<<>&&<p", None, "x"), (4, "<div" * 500, "u", "x"), (5, "<div>" * 3000 + "deep", "u", "x")], "page_id long, html string, url string, text string")
    rows = html_extract.extract_pages(df).collect()
    assert len(rows) == 5 and [r.text for r in sorted(rows, key=lambda r: r.page_id)][:2] == ["", ""]
    assert html_extract.extract_pages(df.limit(0)).count() == 0
    p, li = parse("<p>a&amp;b<br>c\n d<script>x</p></script><li>e").children
    assert (p.tag, p.children[0].text, li.tag, li.children[0].text) == ("p", "a&b c d", "li", "e")
    a, b = parse("<div title=it's>x</div><p class=\"a>b\">y</span></p>").children
    assert (a.children[0].text, b.children[0].text) == ("x", "y")
    for damaged in ("<a" * 100_000, "<div>" * 50_000 + "</b></p>" * 50_000, '<a b="' * 50_000, "<p" + "='" * 100_000 + ">"):
        parse(damaged)


def test_decoding_never_contradicts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        parent = np.array([-1, *(rng.integers(0, k) for k in range(1, 12))])
        logit = rng.normal(size=12) * 2
        got = html_extract.decode(logit, parent)
        assert all(got[p] or not k for k, p in zip(got, parent, strict=True) if p >= 0)
        score = lambda keep: sum(-np.logaddexp(0, -z if k else z) for z, k in zip(logit, keep, strict=True))
        best = max((score(keep) for m in range(1 << 12) if all((keep := [(m >> i) & 1 for i in range(12)])[p] or not keep[i] for i, p in enumerate(parent) if p >= 0)))
        assert score(got) == pytest.approx(best)


def test_warc_sql(spark, same_rows):
    same_rows(warc.op3_warc(spark, SF), warc.OP3_SQL, SF)


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_packages(zip64):
    records = [("u", warc.write_record("response", f"urn:page:{k}", "u", b"x" * k, b"d" * 20, None)) for k in range(5)]
    raw = warc.write_package(records, zip64)
    assert [len(r["payload"]) for r in warc.read_package(warc.Ranges(raw))] == list(range(5))
    assert [len(r["payload"]) for r in warc.read_package(warc.Ranges(io.BytesIO(raw)))] == list(range(5))
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    with pytest.raises(ValueError):
        warc.ZipDirectory(warc.Ranges(b"no archive at all, only some bytes"))


def test_zip64_end_record():
    plain = warc.write_package([("u", warc.write_record("response", "urn:page:1", "u", b"body", b"d" * 20, None))])
    end = plain.rindex(b"PK\x05\x06")
    import struct

    count, size, offset = struct.unpack_from("<HII", plain, end + 10)
    record = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, offset)
    locator = struct.pack("<IIQI", 0x07064B50, 0, end, 1)
    tail = struct.pack("<IHHHHIIH", 0x06054B50, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    got = list(warc.read_package(warc.Ranges(plain[:end] + record + locator + tail)))
    assert got[0]["payload"] == b"body"


def test_warc_edges(spark):
    big = "é" * 800
    pages = spark.createDataFrame([(1, "u", big, 5), (2, None, big, 5), (2, "u\nv", big, 5), (None, "", big, 5), (3, "u", None, 5), (4, "u", "", 5), (5, "u", "small", 5), (6, "u", "small", 5)], "page_id long, url string, html string, bytes int")
    rows = warc.read_archives(warc.write_archives(pages)).collect()
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in rows)
    assert got == [(0, "revisit", 2, 1600), (1, "revisit", 2, 1600), (2, "response", None, 1600), (2, "response", None, 1600), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 5), (6, "response", None, 5)]
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_pipeline_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, SF).collect()
    assert good and corpus_pipeline.quality(spark, docs, SF).columns == docs.columns
    kept = spark.createDataFrame(good, docs.schema)
    rows = [(r.doc_id, r.text) for r in good]
    want = sorted({c for _, n, c in brute_jaccard(rows) if n} | {i for i, n, _ in brute_jaccard(rows) if not n})
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard(spark, kept, SF).collect()) == want
    from rasterlake.llm.decontaminate import words

    items = [(str(i.item_id), words(i.text)) for i in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {(tuple(w[a : a + min(13, len(w))])) for _, w in items for a in range(max(len(w) - 12, 1)) if w}

    def dirty(text):
        ws, hit = words(text), set()
        for size in {len(w) for w in windows}:
            for b in range(len(ws) - size + 1):
                if tuple(ws[b : b + size]) in windows:
                    hit |= set(range(b, b + size))
        return bool(hit) and 20 * len(hit) >= len(ws)

    clean = corpus_pipeline.contamination(spark, kept, SF)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in rows if not dirty(t))
    assert clean.columns == docs.columns


def test_pipeline_edges(spark):
    rows = [(1, "a b c d e f", None, None, None, 1), (1, "a b c d e f", "en", "s", 3, 2), (None, "a b c d e f", "en", "s", 3, 3), (2, None, None, None, None, 4), (3, "", None, None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    path = spark.conf.get("spark.checkpoint.dir") + "/edge-docs"
    docs.write.mode("overwrite").parquet(path)
    docs = spark.read.parquet(path)
    out = corpus_pipeline.jaccard(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a b c d e f"), (2, None), (3, "")] and out.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() <= 5
    assert corpus_pipeline.run(spark, SF).count() > 0
