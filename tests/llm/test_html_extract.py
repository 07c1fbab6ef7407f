import html
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import html_extract
from lodestone.llm.queries import op4_html_extract
from tests.oracle import SMALL

PAGES = "page_id bigint, url string, html string"


def text(page):
    return html_extract.article(html_extract.lines(page))


def test_query_equals_brute_force(spark):
    got = {r["page_id"]: r for r in op4_html_extract(spark, SMALL).collect()}
    for page in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", page["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[page["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[page["page_id"]]["n_chars"] == len(got[page["page_id"]]["text"])


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<p>one<p>two<br>three", "one\n\ntwo three"),
        ("<nav>menu</nav><p>a</p><footer>f</footer>", "a"),
        ("<div class='cookie-notice'>ok?</div><p>a</p><div id=sidebar>s</div>", "a"),
        ("<header><h1>site</h1></header><article><header><h1>T</h1><span>by me</span></header><p>a</p></article>", "T\n\na"),
        ("<article><p>a</p><section class='comments'><p>nice</p></section></article>", "a"),
        ("<article><p>a</p></article><article class='comment'><p>nice</p></article>", "a"),
        ("<main><p>a</p><form>f<input><button>go</button></form></main><p>outside</p>", "a"),
        ("<script>if (a < b) '<p>x</p>'</script><style>p{}</style><p>a</p><!-- <p>c</p> -->", "a"),
        ("<p hidden>x</p><p style='display: none'>y</p><p aria-hidden='true'>z</p><p>a</p>", "a"),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", "x\n\ny\n\n1 2\n\n3"),
        ("<P CLASS=AD>x</P><P>&eacute;&#x20;&#233;&nbsp;&lt;b&gt;</P>", "é é <b>"),
        ("<p>a <b>b<i>c</b></i>d</p></div></nav>e", "a bcd\n\ne"),
        ("<p>a<", "a<"),
        ("<script>never closed", ""),
        ("<p title='a > b'>x</p>", "x"),
    ],
)
def test_structure(page, expected):
    assert text(page) == expected


def page(*lines):
    return "".join(f"<div><p>{x}</p></div>" for x in lines)


def site(host, n, own=4):
    return [(f"http://{host}/a/{i:03d}", page("Site name", "Slogan of the site", *(f"Own line {host} {i} {j}" for j in range(own)), "Imprint")) for i in range(n)]


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_shared_lines_go_however_rows_are_dealt(spark, parts):
    rows = [(i, u, h) for i, (u, h) in enumerate(site("one.org", 30) + site("two.org", 2) + site("alone.org", 1))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, url, raw in rows:
        own = [t for t, _ in html_extract.lines(raw) if t.startswith("Own") or "alone" in url]
        assert got[i] == "\n\n".join(own), url


def test_articles_are_protected_and_copies_kept(spark):
    marked = [(i, f"http://m.org/{i}", f"<p>Menu</p><article><p>Both say so.</p><p>Only {i}</p></article>") for i in range(3)]
    copies = [(10 + i, f"http://c.org/{i}", page("same", "lines", "everywhere")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(marked + copies, PAGES)).collect()}
    assert got == {i: f"Both say so.\n\nOnly {i}" for i in range(3)} | {10 + i: "same\n\nlines\n\neverywhere" for i in range(3)}


@pytest.mark.parametrize("seed", range(8))
def test_longest_common_subsequence(seed):
    import random

    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in range(2))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = html_extract.common_lines(a, b)
    assert len(found) == best[-1][-1]
    places = iter(b)
    assert all(a[i] in places for i in found)


def test_odd_rows(spark):
    long = page(*map(str, range(3000)))
    rows = [(1, None, None), (2, "http://a.org/1", None), (2, "http://a.org/1", None), (None, "x", "<p>t"), (3, None, page("a", "b")), (4, "http://a.org/2", long), (4, "http://a.org/2", ""), (None, None, "")]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "'c' AS host", "'c' AS path", "'c' AS text", "1 AS gone", "2 AS part", "3 AS key", "4 AS id", "5 AS k1")
    got = sorted(tuple(r) for r in html_extract.extract(frame).na.fill(-1, ["page_id"]).na.fill("", ["url"]).collect())
    expected = [(-1 if i is None else i, u or "", text(h or "")) for i, u, h in rows]
    assert got == sorted((*r, len(r[2])) for r in expected)
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<div class='content has-sidebar'><article><p>a</p></article></div>", "a"),
        ("<form id='aspnetForm'><nav>n</nav><article><p>a</p></article></form>", "a"),
        ("<div class='no-sidebar'><main><p>a</p></main></div>", "a"),
        ("<body><div class='page-with-banner'><h1>T</h1><p>a</p><div class='banner'>b</div></div></body>", "T\n\na"),
        ("<div class='social-science'><article><h1>T</h1><p>a</p></article></div>", "T\n\na"),
        ("<main><div id='search-result'><article><p>a</p></article></div></main>", "a"),
        ("<article class='post no-comments'><p>a</p></article>", "a"),
        ("<article><p>a</p><form><p>mail</p></form></article><form><h1>Log in</h1></form>", "a"),
        ("<article><p>a</p></article><div class='sidebar'><article>teaser</article></div><div class='related'><article>other</article></div>", "a"),
        ("<main><h1>T</h1><p>a</p><div class='related'><article>other</article></div></main>", "T\n\na"),
        ("<div style='display:none'><article>x</article></div><aside><article>y</article></aside><p>a</p>", "a"),
    ],
)
def test_wrappers_keep_the_article(page, expected):
    assert text(page) == expected


def test_marked_pages_are_differenced(spark):
    """Site lines in <main> and in blocks of an article that aren't its text go; paragraphs and headings of articles stay."""
    block = "<div class='xyz'>Follow our channel.</div>"
    main = [(i, f"http://m.org/{i}", f"<main><div><p>Best site of all.</p></div><p>Own {i}</p><p>More {i}</p></main>") for i in range(3)]
    article = [(10 + i, f"http://a.org/{i}", f"<main><article><h1>T</h1>{block}<div><p>Both say so.</p></div><ul><li>salt</li></ul><p>Only {i}</p><p>More {i}</p>Bare</article></main>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(main + article, PAGES)).collect()}
    assert got == {i: f"Own {i}\n\nMore {i}" for i in range(3)} | {10 + i: f"T\n\nBoth say so.\n\nsalt\n\nOnly {i}\n\nMore {i}\n\nBare" for i in range(3)}


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<article><section id='search-algorithms'><p>a</p></section><p class='login-form'>How to log in</p></article>", "a\n\nHow to log in"),
        ("<article><header><p>Standfirst</p><h1>T</h1></header><p>a</p></article>", "Standfirst\n\nT\n\na"),
        ("<p data-x=it's>Hello</p><p>don't go</p><p>end</p>", "Hello\n\ndon't go\n\nend"),
        ('<a href="x>one</a>', "one"),
        ('<p>a</p><b title="q><p>c</p>', "a\n\nc"),
        ("<p>a<b", "a"),
        ("<p>1 < 2 <3</p>", "1 < 2 <3"),
        ("<!-->a<!--->b<!-- c > d -->e<!-- f", "abe"),
        ("<?php x ?>a</ b><!DOCTYPE html>c", "ac"),
        ("<p a = 'x>y' b=\"z>\" c=d'>t</p>", "t"),
        ("<article><p>tease</p></article><div>" + "word " * 200 + "</div>", "tease\n\n" + "word " * 199 + "word"),
        ("<article><div class='comments-area'><p>nice</p></div><div class='ad-slot'>buy</div><p>a</p></article>", "a"),
    ],
)
def test_no_text_is_lost(page, expected):
    assert text(page) == expected


@pytest.mark.parametrize(
    "page",
    ['<a href="' * 116_000, "<a href='x>" * 50_000 + '<b t="' * 50_000, "<div>t" * 20_000, "<div class=ad>t" * 20_000, "<article><header>" * 20_000, "<" * 300_000, "<a " * 300_000, "<!--" * 200_000, "<p><b>x" * 30_000],
    ids=str.__len__,
)
def test_time_is_linear(page):
    import time

    began = time.process_time()
    html_extract.lines(page)
    assert time.process_time() - began < 3


def test_alignment_of_equal_lines_is_fast():
    import time

    began = time.process_time()
    assert len(html_extract.common_lines([1, 2] * 10_000, [2, 1, 1] * 7_000)) > 10_000
    assert len(html_extract.common_lines([1] * 20_000, [1] * 15_000)) == 15_000
    assert time.process_time() - began < 3


def test_differencing_decides(spark, monkeypatch):
    """Without the alignment, the site's lines stay, in articles and in plain pages."""
    box = "<div class='about-the-site notice-7x'>Follow our channel.</div>"
    rows = [(i, f"http://a.org/{i}", f"<article><h1>T {i}</h1>{box}<p>Text {i}</p></article>") for i in range(4)] + [(10 + i, u, h) for i, (u, h) in enumerate(site("b.org", 4))]
    frame = spark.createDataFrame(rows, PAGES)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(frame).collect()}
    assert not any("Follow" in t or "Imprint" in t for t in got.values())
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(frame).collect()} == got
    plain = {i: text(h) for i, _, h in rows}
    assert all(t != got[i] for i, t in plain.items())


@pytest.mark.parametrize("parts", ["1", "4", "50"])
def test_neighbours_are_the_nearest_different_pages(spark, parts):
    """Pages by brute force: sorted, equal ones skipped, aligned with the nearest on either side."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(120):
        own = [f"own {rng.randrange(12)}" for _ in range(rng.randrange(1, 4))]
        rows.append((rng.randrange(60), f"http://{rng.choice('ab')}.org/{rng.randrange(9)}", page("Name", *(own if rng.random() < 0.5 else ["copy"]), *(["Foot"] if rng.random() < 0.8 else []))))
    rows += [rows[3], rows[50]]
    frame = spark.createDataFrame(rows, PAGES).withColumns(dict(zip(("k1", "k2"), html_extract.row_key(F.col("page_id"), F.col("url"), F.col("html")), strict=True)))
    keyed = sorted((r["url"].split("/")[2], r["url"].split("org")[1], r["page_id"], r["k1"], r["k2"], r["html"]) for r in frame.collect())
    cuts = [html_extract.lines(r[-1]) for r in keyed]
    expected = []
    for at, (host, *_, page_id, _, _, _) in enumerate(keyed):
        spans = (range(at - 1, -1, -1), range(at + 1, len(keyed)))
        other = [next((j for j in span if keyed[j][0] != host or cuts[j] != cuts[at]), None) for span in spans]
        near = [html_extract.outline(cuts[j]) if j is not None and keyed[j][0] == host else None for j in other]
        expected.append((page_id, html_extract.article(cuts[at], html_extract.deletions(html_extract.outline(cuts[at]), *near))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [(r["page_id"], r["text"]) for r in html_extract.extract(frame.repartition(7)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == sorted(expected)


def test_long_runs_of_equal_pages_are_put_away():
    """What a part yields comes in pieces, however long a run of equal pages is; deletions of its ends wait for the edges."""
    import pyarrow as pa

    def batch(first, hashes):
        rows = [{"k1": i, "k2": 0, "host": "h", "hashes": hashes, "words": [1] * len(hashes), "zones": [1] * len(hashes)} for i in range(first, first + 1000)]
        return pa.RecordBatch.from_pylist(rows)

    html_extract.TaskContext, kept = type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}), html_extract.TaskContext
    try:
        made = list(html_extract._local(iter([batch(0, [1, 2]), *(batch(1000 * i, [2, 3]) for i in range(1, 8)), batch(8000, [3, 4])])))
    finally:
        html_extract.TaskContext = kept
    assert max(b.num_rows for b in made) <= 2100
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["run"] for r in rows if r["kind"] == html_extract._PAGE] == [0] * 1000 + [1] * 7000 + [2] * 1000
    assert [(r["run"], r["gone"]) for r in rows if r["kind"] == html_extract._GONE] == [(1, [0, 1])]
    assert [(r["run"], r["judged"]) for r in rows if r["kind"] == html_extract._EDGE] == [(0, True), (1, False), (2, True)]
