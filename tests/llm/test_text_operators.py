"""HTML, licences, near-dedup, language, WARC, BPE, quality: plain versions, round trips, held-out accuracy."""

import base64
import hashlib
import io
import math
import os
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, empty, near_components, shingles

from runlens.llm import bpe, components, html_extract, language_id, licenses, near_dedup, quality, warc

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">Cookies</div><main><article><h1>Big &amp; title</h1><p>One  two<br>three</p><div class="ad">BUY</div><p>Ok.</p><form><label>Mail</label></form>
</article><section id="comments"><article class="comment"><p>Nice!</p></article></section></main><aside>Side</aside><footer>(c)</footer><script>x("</p>")</script></body></html>"""


def test_html_article():
    assert html_extract.main_text(PAGE) == "Big & title\nOne two three\nOk."


def test_html_without_marks():
    page = "<body><div id=menu><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></div><div><h1>Title</h1><p>" + "word " * 60 + "</p><p>Short.</p><p>" + "more " * 50
    text = html_extract.main_text(page + "</p></div><div class=sidebar>Side</div><div id=comments><p>great</p></div>")
    assert text.startswith("Title\nword word") and "Short." in text and "Home" not in text and "great" not in text and "Side" not in text


_ROWS = {"table": "<tr><td>k<td>v", "dl": "<dt>k<dd>v", "ul": "<li>k<p>v"}


@pytest.mark.parametrize("kind", sorted(_ROWS))
@pytest.mark.parametrize("rows", [1, 100, 3000])
def test_html_end_tags_left_out(kind, rows):
    """Rows and items without end tags end at the next one, and their list, table or aside at its own."""
    listed = f"<{kind}>{_ROWS[kind] * rows}</{kind}>"
    assert html_extract.main_text(f"<body><aside>{listed}</aside><article><p>The text.</p></article>") == "The text."
    assert html_extract.main_text(f"<body><article><p>The text.</p>{listed}</article><p>After it.").startswith("The text.\n")
    assert "After" not in html_extract.main_text(f"<body><article><p>The text.</p>{listed}</article><p>After it.")
    deep = "<div>" * rows
    assert html_extract.main_text(f"<body><aside>{deep}x</aside><article><p>The text.</p></article>") == "The text."


def test_html_nested_lists_and_tables():
    page = "<article><ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><table><tr><td>f<table><tr><td>g</table>h<td>i</table><p>j<div>k</p>l</div></article>m"
    assert html_extract.main_text(page).split() == list("abcdefghijkl")


def test_html_keeps_closing_parts_and_linked_headlines():
    page = "<body><div id=menu><a href=1>Home</a></div><h1><a href=/x>A headline</a></h1><p>" + "body " * 400 + "</p><div class=ad><p>Buy<p>this<p>now</div><p>" + "closing " * 56 + "</p>"
    text = html_extract.main_text(page)
    assert text.startswith("A headline\nbody") and text.endswith("closing") and "Buy" not in text and "Home" not in text


@pytest.mark.parametrize("part", ['<section id="discussion"><h2>D</h2><p>kept</p></section>', '<h2 id="search">kept</h2>', '<h2 id="related-work">kept</h2>', '<div class="entry-header"><h1>kept</h1></div>'])
def test_html_sections_named_like_notices(part):
    assert "kept" in html_extract.main_text(f"<article><p>First.</p>{part}<p>Last.</p></article>")


@pytest.mark.parametrize("part", ['<section id="related"><h2>See</h2><a href=1>dropped one</a> <a href=2>two</a></section>', '<div class="newsletter"><p>dropped</p><input name=mail></div>', '<div id="comments"><p>dropped</p></div>'])
def test_html_notices_in_articles(part):
    assert html_extract.main_text(f"<article><p>First.</p>{part}<p>Last.</p></article>") == "First.\nLast."


def test_html_math_and_unclosed_elements():
    assert html_extract.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>") == "So x=2 holds."
    for name in ("button", "select", "object", "video", "svg", "textarea"):
        assert html_extract.main_text(f"<article><p>One <{name}>gone</p><p>Two.</p></article>") == "One\nTwo."
        assert html_extract.main_text(f"<article><div>One <{name}>gone</div><p>Two.</p><p>a<{name}>gone</{name}>b</p></article>") == "One\nTwo.\nab"
        assert isinstance(html_extract.main_text(f"<{name}>" * 30000), str)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "<p>" * 3000, "<div>" * 30000 + "x", "&#0;&bogus;", "<a b='", "<![CDATA[x"])
def test_html_never_fails(page):
    assert isinstance(html_extract.main_text(page), str)


WRAPPED = "<article><h1>Title</h1><p>" + "Body text of the page. " * 9 + "</p></article>"


@pytest.mark.parametrize("mark", ["has-sidebar", "page nav-open", "widget", "content related", "social-ready"])
def test_html_wrappers_named_like_notices(mark):
    want = html_extract.main_text(WRAPPED)
    assert want.startswith("Title\nBody")
    related = '<div class="related"><article><h2>Other</h2><p>A teaser.</p></article></div>'
    for page in (f'<div class="{mark}">{WRAPPED}</div>', f'<div class="{mark}"><div class="widget">{WRAPPED}</div>{related}</div>', f'<div class="{mark}">{WRAPPED}</div>{related}'):
        assert html_extract.main_text(f"<body>{page}<footer>(c)</footer></body>") == want


def test_html_notices_larger_than_the_article():
    long = "<p>" + "Said much about it. " * 40 + "</p>"
    for mark in ("sidebar", "comments", "related"):
        assert html_extract.main_text(f'<article><p>Short.</p></article><div class="{mark}"><article>{long}</article></div>') == "Short."
        assert html_extract.main_text(f'<div class="page widget"><article><p>Short.</p></article><div class="{mark}">{long}</div></div>') == "Short."
    assert html_extract.main_text(f'<body><div class="comments">{long}</div></body>') == ""
    assert html_extract.main_text(f"<body><article><p>A teaser.</p></article><div>{long}</div></body>").endswith("about it.")


_LONG = "<p>" + "Said at length about the matter. " * 9 + "</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<h1>Head</h1><article><p>Body.</p></article>", ["Head", "Body."]),
        ("<main><h1>Head</h1><p>Lede.</p><article><p>Body of it.</p></article></main><p>After.</p>", ["Head", "Lede.", "Body of it."]),
        ("<main><p>Own words.</p>" + _LONG + "<article><p>Card.</p></article></main>", ["Own words.", "Said", "Card."]),
        ("<article><p>Body.</p><aside class=pullquote>Well said.</aside><aside><blockquote>Quoted.</blockquote></aside><footer><blockquote>Last words.</blockquote></footer></article>", ["Body.", "Well said.", "Quoted.", "Last words."]),
        ("<article><p>Body.</p><aside><p>Elsewhere</p></aside><footer>(c)</footer></article>", ["Body."]),
        ("<div>" + _LONG + "</div><ol class=thread><li><p>" + "I think so too. " * 9 + "</ol><section class=reviews>" + _LONG + "</section>", ["Said"]),
        ("<article><p>Body.</p><p style='color:red; display: none'>unseen</p></article>", ["Body."]),
        ("<div>Short notice</div>" + _LONG + "<p>The end.</p><div>(c) somebody</div>", ["Said", "The end."]),
    ],
)
def test_html_what_touches_the_article(page, want):
    got = html_extract.main_text(f"<body><nav><a href=/>Home</a></nav>{page}<footer>(c)</footer></body>").split("\n")
    assert len(got) == len(want) and all(g.startswith(w) for g, w in zip(got, want, strict=True))


def _unnamed(page):
    """A page without classes, ids and roles, and with plain divs for the elements that name parts of a page."""
    page = re.sub(r"(<[a-z][^>]*?)\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", r"\1", page)
    return re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b", r"<\1div", page)


def test_html_by_line_blocks_alone(spark, monkeypatch):
    """Without any name of a part of the page the distribution of text finds at least 95 % of the characters, and no more than 5 % others."""
    from collections import Counter as C

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] if os.path.isdir("/root/testdata/sf0.001") else [PAGE]
    want, got = (C(line for page in pages for line in html_extract.main_text(how(page)).split("\n")) for how in (str, _unnamed))
    chars = lambda c: sum(len(x) * n for x, n in c.items())
    assert chars(want & got) >= 0.95 * chars(want) and chars(got - want) <= 0.05 * chars(want)
    links = "<ul>" + "<li><a href=/x>Somewhere else</a></li>" * 6 + "</ul>"
    page = f"<body><div><p>Welcome to the site</p>{links}</div><div><h1>Head</h1>{_LONG}<p>The end.</p></div>{links}<p>All rights reserved</p></body>"
    text = html_extract.main_text(page)
    assert text.startswith("Head\nSaid") and text.endswith("The end.")
    monkeypatch.setattr(html_extract, "surges_and_dives", lambda w, *_, **__: [(0, len(w))])  # no scan: every line with weight
    assert html_extract.main_text(page) != text


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (3, "v", "", "x")], "page_id bigint, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in html_extract.extract(rows).collect())
    assert got == [("1", 29), ("1", 29), ("3", 0), ("None", 0)]
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_surges_and_dives():
    assert html_extract.surges_and_dives([0, 0, 5, 0, 5, 0, 0, 0, 0, 9], window=2) == [(1, 5), (8, 10)]


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing here"), (3, "a/b/c/y.txt", "Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (5, "z.txt", None), (6, None, "Licensed under CC BY-NC 4.0."), (7, "a/b/d/e/w", ""),
        (8, "q/r.txt", "long text " * 5000 + "\nLicensed under CC BY-NC 4.0.\n"), (2, "a/b/x.txt", "nothing here"), (9, "abc/t", "license"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, path string, text string, license string")
    got = sorted({(r["doc_id"], r["license"], r["inherited_from"]) for r in licenses.scan(df).collect()})
    want = [(1, "MIT", None), (2, "GPL-3.0", "a/b"), (3, "Apache-2.0", None), (4, "GPL-3.0", None), (5, None, None), (6, "CC-BY-NC-4.0", None), (7, "GPL-3.0", "a/b"), (8, "CC-BY-NC-4.0", None), (9, None, None)]
    assert got == want and licenses.scan(df).count() == len(rows) and licenses.scan(df.limit(0)).count() == 0


def test_licence_cosine_by_hand():
    idf, _, vectors = licenses.template_vectors()
    assert all(sum(x * x for x in v.values()) == pytest.approx(1) for _, _, v in vectors) and idf["under"] < idf["eclipse"]


_GPL = """/* pad.c - left pad
 * Copyright (C) 2020 Some Body <a@b.c>
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 */
int main(void) { return 0; }"""
_ISC = """Copyright (c) 2021, Some Body
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (_GPL, "GPL-3.0"), (_GPL.replace("version 3", "version 2"), "GPL-2.0"), (_GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0"), (_ISC, "ISC"),
        ("# SPDX-License-Identifier: MIT\ncode = 1", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("x\n# SPDX-License-Identifier: GPL-3.0-or-later\ny", "GPL-3.0"),
        ("# SPDX-License-Identifier: MIT-0", "MIT-0"),
        ("Licensed under the MIT License. See LICENSE file in the project root for license information", "MIT"),
        ("word " * 3000 + "\n// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except\n" + "more " * 3000, "Apache-2.0"),
        ("Released under the Foo License.", None), ("All the words of a license that nobody knows, and more of the same kind.", None), ("copyright", None),
    ],
)
def test_licence_headers(text, want):
    assert licenses.licence_of(text, licenses.known_templates())[0] == want


_BSD4 = "\n".join(t for n, t, _ in licenses._templates() if n == "BSD-4-Clause" and "Redistribution" in t)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        *((f"This work is licensed under CC {x} {v}.", f"CC-{x}-{v}") for x in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")),
        ("Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
        ("Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("Creative Commons Attribution-Non-Commercial-No Derivative Works 3.0 License", "CC-BY-NC-ND-3.0"),
        ("Licensed under a Creative Commons Attribution-Share Alike 3.0 Unported License", "CC-BY-SA-3.0"),
        ("# SPDX-License-Identifier: CC-BY-NC-ND-3.0", "CC-BY-NC-ND-3.0"), ("// SPDX-License-Identifier: BSD-4-Clause-UC", None), ("# SPDX-License-Identifier: MIT-Foo", None),
        ("/* SPDX-License-Identifier: (GPL-2.0+ OR MIT) */", "GPL-2.0"), ("GPLv3", "GPL-3.0"), ("License: GPLv3+", "GPL-3.0"), ("Licensed under GPL v2", "GPL-2.0"), ("License: LGPL v2.1", "LGPL-2.1"), ("AGPLv3", "AGPL-3.0"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", "Apache-2.0"),
        ("Released under the Modified BSD License", "BSD-3-Clause"), ("Released under the BSD license", None), (_BSD4, "BSD-4-Clause"),
        ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version", "GFDL-1.3"),
        ("the program committed 3 errors and permits more", None),
    ],
)
def test_licences_grant_no_more_than_the_text(text, want):
    assert licenses.licence_of(text, licenses.known_templates())[0] == want


def test_spans_equal_plain_cosines():
    """The best span by sliding sums is the best of all spans, each with its own counts, norm and words."""
    idf, other, templates = licenses.known_templates()
    rng = random.Random(3)
    for name, length, keys, without, vector in rng.sample(templates, 40):
        text = [rng.choice([*vector, *keys, "other", "words", *without]) for _ in range(rng.randint(1, 60))]
        best = 0.0
        for n in {min(len(text), max(len(keys), math.ceil(share * length))) for share in licenses.SPANS}:
            for i in range(len(text) - n + 1):
                span = Counter(text[i : i + n])
                if all(k in span for k in keys) and not any(w in span for w in without):
                    norm = math.sqrt(sum((c * idf.get(w, other)) ** 2 for w, c in span.items()))
                    best = max(best, sum(c * idf.get(w, other) * vector.get(w, 0.0) for w, c in span.items()) / norm)
        assert licenses._Spans(text, idf, other).best(length, keys, without, vector) == pytest.approx(best, abs=1e-9), name


def test_the_filter_before_scoring_drops_nothing():
    pattern = re.compile(licenses.anchors())
    assert all(pattern.search(text) for _, text, _ in licenses._templates())


def test_inheritance_by_hand(spark):
    """Each file against all licence files above it, the nearest directory first; ties within one go to the first path."""
    rng = random.Random(6)
    notices = ["Released under the MIT License.", "Released under the ISC License.", "Licensed under CC BY-ND 4.0.", "nothing"]
    paths = sorted({"/".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) + rng.choice(["/LICENSE", "/LICENSE.md", "/COPYING", "/x.txt", "/y.txt"]) for _ in range(120)})
    rows = [(i, p.lstrip("/"), rng.choice(notices) if "x.txt" not in p else "") for i, p in enumerate(paths)]
    own = {p: licenses.licence_of(t, licenses.known_templates())[0] for _, p, t in rows}
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    want = []
    for i, p, _ in rows:
        above = [d for d in {"/".join(folder(p).split("/")[:k]) for k in range(len(folder(p).split("/")) + 1)}]
        given = sorted((-len(folder(q)), q) for q in own if own[q] and re.search(licenses.LICENCE_FILE, q) and folder(q) in above)
        want.append((i, own[p] or (own[given[0][1]] if given else None), folder(given[0][1]) if given and not own[p] else None))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()
    assert sorted((r["doc_id"], r["license"], r["inherited_from"]) for r in got) == want


def test_whole_licence_texts():
    known = licenses.known_templates()
    for name, text, _ in licenses._templates():
        assert licenses.licence_of("Copyright 2020 Some Body\n\n" + text + "\n\nThe end of the file.", known)[0] == name


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, words, percent):
    docs = awkward(spark)
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    want = near_components(list(rows.items()), words, percent)
    got = near_dedup.near_dedup(docs, words, percent).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_dedup(empty(spark), words, percent).count() == 0


def test_near_dedup_of_a_hot_group(spark):
    """Chains of near copies, many of which meet in buckets without being linked to the pivot."""
    rng = random.Random(9)
    text, rows = [f"w{rng.randint(0, 400)}" for _ in range(90)], []
    for i in range(120):
        if i % 3 == 0:
            text = list(text)
            text[rng.randrange(90)] = f"n{i}"
        variant = list(text)
        for _ in range(i % 4):
            variant[rng.randrange(90)] = f"v{i}"
        rows.append((i, " ".join(variant), "en", "s"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(awkward(spark, rows), 3, 85).collect()}
    assert got == near_components([r[:2] for r in rows], 3, 85)


def test_near_dedup_of_repeated_rows(spark):
    """Many rows of two near copies are two classes and one pair; a doc_id with two texts is two documents."""
    base = [f"w{i}" for i in range(90)]
    near = [*base[:40], "other", *base[41:]]
    rows = [(7, " ".join(base), "en", "s")] * 400 + [(8, " ".join(near), "en", "s")] * 400 + [(9, "a b c d", "en", "s"), (9, " ".join(near), "en", "s"), (None, " ".join(base), "en", "s")]
    got = near_dedup.near_dedup(awkward(spark, rows), 3, 85).collect()
    assert sorted({(str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got}) == [
        ("7", 88, "7", True), ("8", 88, "7", False), ("9", 2, "9", True), ("9", 88, "7", False), ("None", 88, "None", True)
    ] and len(got) == len(rows)


def test_near_copies_join_without_all_their_pairs(spark, monkeypatch):
    """A group of which every second pair is linked takes some pairs a text, not half of all, and loses no link."""
    rng, tried = random.Random(3), []
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(240):
        text = list(base)
        for _ in range(rng.randint(3, 6)):
            text[rng.randrange(300)] = f"v{i}_{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), "en", "s"))
    confirmed = near_dedup.confirmed

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs, 3, 85).collect()}
    assert got == near_components([r[:2] for r in rows], 3, 85)
    assert sum(tried[1:]) < 12 * len(rows), tried


@pytest.mark.parametrize(("words", "percent", "counters"), [(3, 85, 1 << 16), (5, 80, 8)])
def test_prefixes_meet(spark, monkeypatch, words, percent, counters):
    """Every linked pair meets in its first shingles, whatever the order, and unlinked texts with a common passage do not."""
    monkeypatch.setattr(near_dedup, "COUNTERS", counters)
    rng = random.Random(words)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(150):
        own = [f"x{i}_{k}" for k in range(rng.randint(20, 60))]
        texts.append(passage + own)
        if i % 5 == 0:
            texts += [[w if rng.random() > 0.02 else f"y{i}" for w in texts[-1]] for _ in range(3)]
    rows = [(i, i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "_class bigint, component bigint, _text string")
    got = {(r["a"], r["b"]) for r in near_dedup._across(df, words, percent).collect()}
    sets = [shingles(" ".join(t), words) for t in texts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert want <= got and len(want) > 40 and (len(got) < 8 * len(want) or counters < 100)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60, dtype=np.uint64)])
    s = near_dedup.super_minhash(np.concatenate([a, b]), np.array([0, 300, 600]))
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.15
    one = near_dedup.super_minhash(a[:3], np.array([0, 3]))
    assert (one < np.iinfo(np.uint64).max).all() and len(set((one[0] >> np.uint64(32)).tolist())) > 10


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 80), (80, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 80: 80, 90: 80, 100: 80}


def _tongues(n=300):
    rng, rows = random.Random(4), []
    parts = {"en": ["the", "ing", "tion", "and"], "de": ["sch", "ung", "ß", "der"], "fr": ["eau", "ê", "les", "que"]}
    for i in range(n):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), lang, "s"))
    return rows


def test_language_features_and_ftrl_by_hand():
    """Sparse counts against a count of grams; FTRL step by step; its L1 penalty empties weights."""
    texts = ["", "Ab, ab!", "12 34", "é" * 3, "the end of the\n end"]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    rows, buckets, counts, has = language_id.gram_counts(raw, offsets)
    for i, t in enumerate(texts):
        words = [w for w in "".join(c.lower() if c.isalpha() else " " for c in t).split() if w]
        assert counts[rows == i].sum() == sum(3 * len(w) for w in words)  # of each letter: itself, the pair that it ends, the triple around it
        assert has[i] == bool(words) and len(set(buckets[rows == i].tolist())) == (rows == i).sum()
    rng = np.random.default_rng(0)
    samples = [(np.append(rng.choice(40, 6, replace=False), language_id.BUCKETS), np.append(rng.random(6), 1.0), int(k % 3)) for k in range(60)]
    for l1 in (0.0, 0.5):
        z, n = np.zeros((language_id.BUCKETS + 1, 3)), np.zeros((language_id.BUCKETS + 1, 3))
        weight = lambda i, c: 0.0 if abs(z[i, c]) <= l1 else -(z[i, c] - np.sign(z[i, c]) * l1) / ((1 + n[i, c] ** 0.5) / 0.5 + 0.1)  # noqa: B023, E731
        for at, x, y in samples:
            w = np.array([[weight(i, c) for c in range(3)] for i in at])
            p = np.exp(x @ w) / np.exp(x @ w).sum()
            for k, i in enumerate(at):
                for c in range(3):
                    g = x[k] * (p[c] - (c == y))
                    z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / 0.5 * w[k, c]
                    n[i, c] += g * g
        want = np.array([[weight(i, c) for c in range(3)] for i in range(40)])
        got = language_id.ftrl(samples, 3, epochs=1, alpha=0.5, beta=1.0, l1=l1, l2=0.1)
        assert np.allclose(got[:40], want) and (l1 == 0 or (got[:40] == 0).mean() > 0.1)


def test_language_id(spark):
    rows = _tongues()
    got = {r["doc_id"]: r for r in language_id.language_table(awkward(spark, [*rows, (900, None, "en", "s"), (901, "12 !?", "en", "s"), (902, "", None, "s")])).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 50 and sum(got[i]["lang_pred"] == lang for i, _, lang, _ in held) >= 0.97 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_learns_every_language(spark):
    """A language with few rows beside a hot one is learnt, and its documents are kept."""
    rng = random.Random(7)
    rare = [(5000 + i, "".join(rng.choices("αβγδεζηθικλμνξοπ ", k=60)), "el", "s") for i in range(6)]
    lone = [(i, "".join(rng.choices("абвгдежзиклмнопр ", k=60)), "ru", "s") for i in range(6000, 6010) if zlib.crc32(str(i).encode()) % 3 != 1][:1]
    bare = [(7000 + i, "12 !?", "xx", "s") for i in range(300)]
    docs = awkward(spark, [*_tongues(1500), *rare, *lone, *bare])
    model = language_id.fit(docs, sample=40)
    assert model.langs == ["de", "el", "en", "fr", "ru"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.language_table(docs, sample=40).collect()}
    assert all(got[i] == lang for i, _, lang, _ in rare + lone)
    learnt = next(i for i in range(8000, 8100) if zlib.crc32(str(i).encode()) % 3 != 1)
    copies = awkward(spark, [*_tongues(300), *[(learnt, "ωψχφυ τσρ", "el", "s")] * 900])
    assert "el" in language_id.fit(copies, sample=40).langs


def test_language_id_of_awkward_tables(spark):
    assert language_id.language_table(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in language_id.language_table(awkward(spark, [(3, "abc", None, "s")])).collect()} == {"und"}
    kept = language_id.known_language(docs := awkward(spark))
    assert kept.columns == docs.columns and {4, 5, 6}.isdisjoint({r["doc_id"] for r in kept.collect()})


class _Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("force64", [False, True])
def test_zip_ranges(force64):
    out = io.BytesIO()
    z = warc.ZipWriter(out, force64)
    z.add("archive/ä", [b"xy", b"z"])
    z.add("b", [b""])
    z.close()
    plain = zipfile.ZipFile(out)
    assert plain.namelist() == ["archive/ä", "b"] and plain.read("archive/ä") == b"xyz" and plain.testzip() is None
    ranges = warc.ZipRanges(_Bytes(out.getvalue()))
    assert ranges.read("archive/ä", 1, 2) == b"yz" and ranges.read("b") == b""
    with pytest.raises(ValueError, match="range"):
        ranges.read("archive/ä", 2, 5)
    with pytest.raises(ValueError, match="central"):
        warc.ZipRanges(_Bytes(b"no archive"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("d", b"x" * 100)
    with pytest.raises(ValueError, match="not stored"):
        warc.ZipRanges(_Bytes(packed.getvalue())).read("d")


def test_warc_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/ b%\r\n", big, "x"), (5, None, big, "x"), (3, "u", big, "x"), (5, None, big, "x"), (7, "u", "small", "x"), (8, "u", "small", "x"), (9, "u", None, "x"), (None, "u", "n" * 2000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload_bytes string")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, _, t, _ in rows:
        revisit = t == big and i != 5
        want.append((str(i), len((t or "").encode()), sha(t), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want)
    back = warc.read_archives(warc.write_archives(pages, archive_bytes=200), with_payload=True).collect()
    assert {(r["page_id"], r["url"]) for r in back} == {(i, u) for i, u, _, _ in rows}
    assert all(bytes(r["payload"]).decode() == big for r in back if r["page_id"] == 5)
    assert warc.round_trip(pages.limit(0)).count() == 0


def _tiktoken():
    import public_tokenizers as p
    import tiktoken

    with open(bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark):
    rng, ref = random.Random(6), _tiktoken()
    parts = ["'", "'s", "'ll", "'re", "t", "ve", " ", "  ", "\n", "\t", "é", "1", "²", "漢字", "!", "😀", "a", "Z", "the", "$$", "​", "\x85", "　", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(3000)] + ["a" * 4000, "!" * 1500, "'s" * 500, "\n" * 300, "x" * 49, None]
    docs = awkward(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for r in bpe.token_digests(docs).collect():
        t = texts[r["doc_id"]] or ""
        ids = ref.encode_ordinary(t)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), repr(t)
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_offsets_and_decoding(spark):
    docs = awkward(spark)
    encoded = bpe.encode(docs)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in bpe.decode(encoded).collect())
    vocab = bpe.vocabulary(bpe.default_path())
    for r in encoded.filter("doc_id IN (1, 7, 13)").collect():
        raw = texts[r["doc_id"]].encode()
        assert all(raw[o : o + len(vocab.by_id[i])] == vocab.by_id[i] for i, o in zip(r["ids"], r["offsets"], strict=True))
    assert bpe.token_digests(empty(spark)).count() == 0


def test_bpe_cache_that_is_too_small(monkeypatch):
    import pyarrow as pa

    from runlens.llm.common import text_bytes

    monkeypatch.setattr(bpe, "CACHE", 5)
    vocab, ref = bpe.Vocabulary(bpe.default_path()), _tiktoken()
    for t in ["some words that do not repeat at all", "a b", "other wordings altogether zzq", "a b c d e f"]:
        assert vocab.encode(*text_bytes(pa.array([t])))[0].tolist() == ref.encode_ordinary(t)


def test_quality(spark):
    rng, rows, labels = random.Random(8), [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 200))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + "&&&" for w in words) if i % 2 else " ".join([words[0]] * 60), "en", "s"))
        labels.append((i, int(good), 0, "x"))
    table = spark.createDataFrame([*labels, (3, None, 0, "x"), (None, 1, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    docs = awkward(spark, [*rows, (900, None, "en", "s"), (901, "", "en", "s")])
    got = {r["doc_id"]: r for r in quality.quality_table(docs, table).collect()}
    held = [x for x in labels if got[x[0]]["held_out"]]
    assert len(held) > 50 and sum(got[i]["predicted"] == q for i, q, _, _ in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values()) and 900 in got
    assert quality.quality_table(empty(spark), table).count() == 0
    assert {r["score"] for r in quality.quality_table(docs, table.limit(0)).collect()} == {0.5}


def test_quality_by_definition(spark):
    """Scores against Gaussian log densities with numpy's determinants and inverses, over the moments of all rows."""
    rng = np.random.default_rng(6)
    d, mix = len(quality.NAMES), rng.normal(size=(len(quality.NAMES), len(quality.NAMES)))
    x = [rng.normal(size=(40, d)) @ mix, rng.normal(size=(90, d)) @ mix.T + 0.5]
    rows = spark.createDataFrame([(k, v.tolist()) for k in (0, 1) for v in x[k]], "quality int, stats array<double>").repartition(3)
    model = quality.Discriminant(quality.moments(rows))
    cov = [np.cov(v.T, bias=True) for v in x]
    both = (40 * cov[0] + 90 * cov[1]) / 130
    scale = np.diag(1 / np.sqrt(np.diag(both)))
    tests, log = rng.normal(size=(25, d)) @ mix, []
    for k in (0, 1):
        own = scale @ ((1 - quality.POOLED) * cov[k] + quality.POOLED * both) @ scale
        own = (1 - quality.RIDGE) * own + quality.RIDGE * np.trace(own) / d * np.eye(d)
        off = (tests - x[k].mean(axis=0)) @ scale
        log.append(np.log(len(x[k]) / 130) - 0.5 * np.log(np.linalg.det(own)) - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(own), off))
    assert np.allclose(model.scores(tests), 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))), atol=1e-6)


def test_quality_of_awkward_tables(spark):
    """Every row has a score: nulls in any column, a very long text, and repeated rows, which have equal ones."""
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2, 0, None) for i in range(20, 80)] + [(20, 0, 0, None), (None, None, None, None)], "doc_id bigint, quality int, toxic int, text string")
    got = quality.quality_table(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1
