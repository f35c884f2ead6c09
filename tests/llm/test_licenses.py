import textwrap

import pytest

from rasterlake.llm import licenses


@pytest.fixture(scope="module")
def names(spark):
    def scan(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        got = {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()}
        return [got[k] for k in range(len(texts))]

    return scan


def _wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in text.split("\n\n"))


def test_hard_wrapped_texts(names):
    made = [(k, _wrapped(t, w)) for k, t in licenses.KNOWN_TEXTS for w in range(30, 100)]
    made += [(k, "Copyright (c) 2020 Somebody\n\n" + _wrapped(t, w)) for k, t in licenses.KNOWN_TEXTS for w in (60, 72, 79)]
    got = names([t for _, t in made])
    assert [(k, t) for (k, t), g in zip(made, got, strict=True) if g != k] == []
    isc = next(t for k, t in licenses.KNOWN_TEXTS if k == "ISC").replace("that the above copyright", "that the above\ncopyright")
    assert names([isc]) == ["ISC"]


@pytest.mark.parametrize(
    "notice",
    ["Copyright (c) 2020 X.", "Copyright (c) 2020 X", "Copyright 2019-2020 Foo Bar, Inc.", "(c) 2020 Foo. All rights reserved.", "© 2020 Foo <a@b.org>", "Copyright (c) 2001, 2002 Foo Inc. All Rights Reserved.", "Copyright (c) <year> <copyright holders>", "Copyright (C) 2020 A. B. Foo, http://foo.org/"],
)
def test_notice_on_the_line_of_the_terms(names, notice):
    flat = [(k, f"{notice} {' '.join(t.split())}") for k, t in licenses.KNOWN_TEXTS if t.startswith(("Permission", "Redistribution", "This software", "Licensed"))]
    titled = [("MIT", f"MIT License {notice} " + " ".join(licenses.KNOWN_TEXTS[1][1].split()))]
    lines = [(k, f"{notice}\n{t}") for k, t in licenses.KNOWN_TEXTS]
    made = flat + titled + lines
    assert names([t for _, t in made]) == [k for k, _ in made]


def test_only_notices_are_left_out(names, spark):
    mit = licenses.KNOWN_TEXTS[1][1]
    whole = ["Copyright The Foo Authors", "Copyright by Foo Bar", "// Copyright: 2020 Foo", "© Foo", "(c) Acme Corp", "Copyright 2010 Foo (a@b.net); Modified work Copyright 2014 Bar (c@d.com)", "All rights reserved.", " * Copyright (c) 2020 Will May, Inc. All rights reserved.", "Copyright © 2020 Öner Ü"]
    assert names([f"{n}\n\n{mit}" for n in whole]) == ["MIT"] * len(whole)
    terms = ["Copyright (c) 2020 X. You may not sell this.", "Copyright holders must be paid.", "(c) Licensee shall pay a fee", "All rights reserved. No commercial use.", "Copyright 2020 Foo Inc. For personal use only", "Copyright (c) 2020 X, released under the GPL"]
    assert names([f"{n}\n\n{mit}" for n in terms]) == [None] * len(terms)
    long = spark.createDataFrame([(1, "Copyright (c) 2020 " + "word, " * 300_000), (2, "-" * 300_000 + "\n" + "(c) " * 100_000)], "doc_id int, text string")
    assert licenses.scan_licenses(long).count() == len([r for r in licenses.scan_licenses(long).collect() if r.license is None]) == 2


def test_whole_texts(names, spark):
    made = [(p.stem, p.read_text()) for p in licenses.TEXTS.glob("*.txt")]
    assert len(made) == 14
    made += [("GPL-3.0", t[: t.index("END OF TERMS")]) for k, t in made if k == "GPL-3.0"]
    made += [("Apache-2.0", t.replace("[yyyy] [name of copyright owner]", "2020 Foo, Inc.")) for k, t in made if k == "Apache-2.0"]
    made += [(k, " ".join(t.split())) for k, t in made]
    assert names([t for _, t in made]) == [k for k, _ in made]
    gpl = (licenses.TEXTS / "GPL-2.0.txt").read_text()
    assert names([gpl.replace("b) You must cause", "b) You need not cause")]) == [None]
    rows = sorted((r.digest, r.license) for r in licenses.form_digests(spark).collect())
    assert rows == sorted(tuple(x.split("\t")) for x in (licenses.TEXTS / "DIGESTS.tsv").read_text().splitlines())
    assert len({d for d, _ in rows}) == len(rows)  # no text has two licences


def test_titles_bullets_and_letters(names):
    bsd = next(t for k, t in licenses.KNOWN_TEXTS if k == "BSD-3-Clause")
    two, zlib, zero = (next(t for k, t in licenses.KNOWN_TEXTS if k == n) for n in ("BSD-2-Clause", "Zlib", "0BSD"))
    stars = lambda t: t.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    letters = lambda t: t.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) ")
    made = [("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) 2020, Foo\nAll rights reserved.\n\n{f(bsd)}") for f in (str, stars, letters, lambda t: _wrapped(letters(t), 70))]
    made += [("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) 2020, Foo\n\n{f(two)}") for f in (str, stars)]
    made += [("Zlib", f"zlib License\n\n(C) 2020 Foo\n\n{zlib}"), ("0BSD", f"BSD Zero Clause License\n\nCopyright (C) 2020 by Foo <a@b.org>\n\n{zero}")]
    assert names([t for _, t in made]) == [k for k, _ in made]


def test_neighbouring_spellings_ties_and_very_long_texts(spark):
    from pyspark.sql import functions as F

    rows = [(1, "licence licence whilst wilful sub license sub license licence", "a"), (2, "license, license while willful sublicense sublicense license", "a"), (3, "word " * 400_000, "b"), (3, "word " * 400_000, "b"), (4, licenses.KNOWN_TEXTS[1][1], "c"), (4, licenses.KNOWN_TEXTS[1][1], "c")]
    df = spark.createDataFrame(rows, "doc_id int, text string, digest string").withColumn("canon_chars", F.lit("x"))
    got = licenses.scan_licenses(df).collect()
    by = {k: [r for r in got if r.doc_id == k] for k in (1, 2, 3, 4)}
    assert by[1][0].digest == by[2][0].digest and by[1][0].canon_chars == len("license license while willful sublicense sublicense license")
    assert len(by[3]) == 2 and {r.canon_chars for r in by[3]} == {1_999_999} and {r.license for r in by[4]} == {"MIT"} and len(by[4]) == 2
    known = spark.createDataFrame([(by[1][0].digest, "Z"), (by[1][0].digest, "A"), (None, "N")], "digest string, license string")
    assert [r.license for r in licenses.scan_licenses(df, known).orderBy("doc_id").collect()] == ["A", "A", None, None, None, None]


def test_clauses_that_begin_like_notices_stay(spark):
    mit = licenses.KNOWN_TEXTS[1][1]
    rows = [(1, mit + "\n\n(c) Licensee must pay a fee."), (2, mit + "\n\nCopyrighted uses require payment."), (3, "(c) 2020 A Holder\n\n" + mit), (4, mit.replace("subject to", "(c) subject to"))]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] is None and got[2] is None and got[3] == "MIT"
