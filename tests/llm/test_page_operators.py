"""Operators on pages, and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import capture_index, html_extract

FRAME = (
    '<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="nav-open"><header><h1>Site</h1></header>'
    '<nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies {i}</div><div id="main"><h2>Head &amp; {i}</h2>'
    "<p>First <b>bo</b>ld{i}<br>line<p>Second&nbsp;&lt;x&gt; {i}<div>Share this story</div><ul><li>one {i}</li><li>two</li></ul></div>"
    '<div class="comments"><p>reader {i}</p></div><aside>side</aside><form><label>Mail</label></form><footer>&copy; {i}</footer></body></html>'
)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://www.a.org/p{i}?q=1", FRAME.format(i=i)) for i in range(12)]
    rows += [
        (20, "https://b.org/x", "<article><header><h1>Own</h1></header>text <i>in</i>line<footer>by</footer></article><article class='comment'>reply</article><p>after"),
        (21, None, None), (22, "b.org", ""), (23, "http://b.org", "no tags &am &amp &#233;"), (24, "http://b.org/cut", "<article><p>begun <b>and cut"),
        (25, "http://b.org/cut2", "<p>kept</p><div cla"), (26, "http://b.org/deep", "<div>" * 3000 + "deep" + "</div>" * 3000), (None, "http://b.org", "<p>none"),
        (27, "http://b.org/z", "<p>" + "long " * 30_000), (20, "https://b.org/x", "<p>again"), (28, "http://b.org", "<script>never closed <p>x"),
    ]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")


def test_text_of_pages(pages):
    got = {}
    for r in html_extract.extract(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, got.values())) == pages.count()
    for i in range(12):
        # "Share this story", "Second" and so on stand on every page; only the first is the same on all
        assert got[i] == [f"Head & {i} First bold{i} line Second <x> {i} one {i}"]
    assert sorted(got[20]) == ["Own text inline", "again"]
    assert got[21] == got[22] == got[28] == [""]
    assert got[23] == ["no tags &am & é"] and got[24] == ["begun and cut"] and got[25] == ["kept"] and got[26] == ["deep"] and got[None] == ["none"]
    assert len(got[27][0]) == 5 * 30_000 - 1


def test_copies_are_one_page_of_a_host(spark):
    page = lambda i: f"<div>Menu of all</div><p>text {i}</p><p>more {i}</p>"
    rows = [(i, "http://c.org/a", page("copied")) for i in range(30)] + [(100 + i, "http://c.org/b", page(i)) for i in range(7)]
    rows += [(200 + i, None, page("same")) for i in range(9)] + [(300 + i, "http://d.org", page(i % 4)) for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {got[i] for i in range(30)} == {"text copied more copied"} and got[103] == "text 3 more 3"
    # one and four different pages aren't enough for a template
    assert {got[200 + i] for i in range(9)} == {"Menu of all text same more same"} and got[302] == "Menu of all text 2 more 2"


def test_no_pages(pages):
    assert html_extract.extract(pages.where("page_id < 0")).count() == 0
    assert capture_index.archive_and_read(pages.where("page_id < 0")).count() == 0


def test_matching_keeps_order_and_parents():
    tree = html_extract.template_of(html_extract.parse("<div><h1>a</h1><p>b</p><ul><li>c</ul></div>"))
    assert html_extract.match(tree, [html_extract.parse("<div><p>x</p><p>y</p><ul><li>1<li>2</ul></div>")], {}) == 5
    assert html_extract.match(tree, [html_extract.parse("<div><ul><li>1</ul><h1>z</h1></div>")], {}) == 4
    assert html_extract.match(tree, [html_extract.parse("<section><p>x</section>")], {}) == 1


def brute_match(template, nodes) -> int:
    """The largest pairing by trying, for every pair of child lists, all ways to skip one or pair both."""
    a, b = template.kids, html_extract._runs_of(nodes)

    def best(i: int, j: int) -> int:
        if i == len(a) or j == len(b):
            return 0
        pair = best(i + 1, j + 1) + brute_match(a[i][1], b[j][1]) if a[i][0] == b[j][0] else 0
        return max(best(i + 1, j), best(i, j + 1), pair)

    return 1 + best(0, 0)


def test_matching_is_that_of_brute_force():
    rng = random.Random(5)

    def tree(depth: int) -> str:
        kids = "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) if depth else "x"
        tag = rng.choice(["div", "section", "b", "ul"])
        return f"<{tag}>{kids}</{tag}>"

    for _ in range(300):
        one, other = (html_extract.parse(tree(3) + tree(3)) for _ in range(2))
        pivot = html_extract.template_of(one)
        numbers: dict[int, int] = {}
        assert html_extract.match(pivot, [other], numbers) == brute_match(pivot, [other])
        assert len(set(numbers.values())) <= brute_match(pivot, [other])


def test_deep_pages_of_one_host(spark):
    deep = lambda i: "<div>" * 5000 + f"<p>deep {i}</p>" + ("<p>same</p>" if i % 2 else "<b>same</b>") + "</div>" * 5000
    rows = [(i, "http://deep.org/", deep(i)) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i].startswith(f"deep {i}") for i in range(8))


@pytest.mark.parametrize("name", ["content has-sidebar", "post no-comments", "side-effects", "article-search", "social-science-article", "layout-with-nav"])
def test_names_that_only_mention_a_part_keep_their_text(name):
    assert html_extract.text_of(f'<body><div class="{name}"><p>Own text.</p></div></body>', None, set()) == "Own text."


@pytest.mark.parametrize("name", ["sidebar", "site-header", "cookie-banner", "ad-slot-2", "post-comments", "x newsletter-signup", "main-nav", "share_buttons"])
def test_names_of_parts_are_outside(name):
    assert html_extract.text_of(f'<body><div id="{name}"><p>Other.</p></div><p>Own text.</p></body>', None, set()) == "Own text."


def test_main_parts_and_teasers():
    text = lambda page: html_extract.text_of(page, None, set())
    assert text("<div><p>A long story about many things.</p></div><article>Other.</article>").startswith("A long story")
    assert text("<div>Menu words</div><article><p>A long story about many things.</p></article>") == "A long story about many things."
    assert text('<div class="sidebar"><main><p>Story</p></main></div><p>x</p>') == "Story"
    assert text("<p>See <label>x</label> and y</p>") == "See x and y"


@pytest.mark.parametrize("slice_blocks", [capture_index.SLICE, 1])
def test_archives_round_trip(spark, pages, slice_blocks, monkeypatch):
    monkeypatch.setattr(capture_index, "BLOCK_ROWS", 3)
    same = [(100 + i, f"http://c.org/{i % 3}", "<p>é" + "same " * 300) for i in range(40)] + [(200 + i, "http://c.org/short", "tiny") for i in range(5)]
    rows = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(same, "page_id bigint, url string, html string"))
    folder = capture_index.scratch_path(spark, "warc")
    captures = capture_index.cut(capture_index.write_archives(rows, folder))
    directory = capture_index.cut(capture_index.build_index(captures, folder))
    assert directory.count() >= captures.count() / 3
    read = capture_index.lookup(directory, captures.select("key", "id").distinct(), slice_blocks).collect()
    payload = [(r.page_id, (r.html or "").encode()) for r in rows.collect()]
    largest = {}
    for i, p in payload:
        if len(p) >= 1000:
            largest[p] = max(largest.get(p, -1), -1 if i is None else i)
    expected = [
        (i, len(p), hashlib.sha1(p).hexdigest(), *(("revisit", largest[p]) if len(p) >= 1000 and largest[p] != i else ("response", None))) for i, p in payload
    ]
    order = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted(((r.id, r.bytes, r.digest, r.type, r.refers_to) for r in read), key=order) == sorted(expected, key=order)
    missing = spark.createDataFrame([("org,none)/", 1), ("org,c)/0", 7)], "key string, id bigint")
    assert capture_index.lookup(directory, missing).count() == 0


def test_archives_are_gzip_members(spark):
    rows = spark.createDataFrame([(i, f"http://c.org/{i}", f"<p>{i}" + "some words " * 500) for i in range(20)], "page_id bigint, url string, html string")
    captures = capture_index.write_archives(rows, capture_index.scratch_path(spark, "warc"))
    found = capture_index.cut(captures).collect()
    assert sum(r.length for r in found) * 5 < 20 * 5500
    for r in found:
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")


def test_url_keys_and_damage():
    assert capture_index.url_key("HTTPS://u@WWW.A.org:443/x?y=1#z") == "org,a,www)/x?y=1"
    assert capture_index.url_key("http://a.org:8080") == "org,a:8080)/" and capture_index.url_key("") == ""
    raw = capture_index.record(1, "http://a.org/é", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    assert capture_index.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        capture_index.parse(raw.replace(b"payload", b"daylight"[:7]))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from plumbline.functions.session import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, []
    names = [n for n, _ in corpus_pipeline.STAGES]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        if k < len(names) - 1:
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        counts.append(docs.count())
    assert names == ["quality rules", "near duplicates", "decontamination", "personal data", "packing"]
    assert 0 < counts[3] == counts[2] <= counts[1] <= counts[0]
    assert docs.select("doc_id").distinct().count() == counts[3]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
