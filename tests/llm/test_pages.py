import base64
import hashlib
import itertools
import math
import random
import struct
import time
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from radiolith.llm import html_main, warc

PAGES = "page_id long, url string, html string, low string, host string, frame string, node long, text string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<p>a", "a"),
        ("<nav>menu</nav><article><h1>T</h1><p>x&nbsp; y<br>z<p>b</article>tail", "T\nx y z\nb"),
        ('<div class="sidebar"><p>s</div><p>main <a href=x>l</a> text', "main l text"),
        ("<ul><li><a>x</a><li><a>y</a></ul><p>hello world</p>", "hello world"),
        ('<article><section class="comments"><p>c</p></section><p>k</article>', "k"),
        ("<article><p>k<form>name <input></form><aside>x</aside><footer>f</footer></article>", "k"),
        ('x <script>var a="</p>"', "x"),
        ('<article>a<script>if (a < b) "</p>"</script>b<style>p{}</style><!-- c -->d</article>', "abd"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ('<p title="a>b">q</p>', "q"),
        ("<p title=it's>q</p> it's", "q\nit's"),
        ("&lt;p&gt; &#233; &amp;amp;", "<p> é &amp;"),
        ("<header>site</header><article><header><h1>T</h1></header><p>1 < 2 and 3 > 2</p></article>", "T\n1 < 2 and 3 > 2"),
        ('<div role="navigation">n</div><main><p>m</main><div id="cookie-banner">c</div>', "m"),
        ("<article><p><b>one<br><p>two</p></article><footer>&copy;</footer>", "one\ntwo"),
        ("<article><p>cut off here <a hr", "cut off here"),
        ("<div>a</span></b>b</div><p hidden>no</p>c", "ab\nc"),
        ('<body class="has-sidebar"><article class="post"><p>kept</article>', "kept"),
        # Controls and marked inline elements go, the text around them stays.
        ("<article>intro <button>Share</button><p>para</p>outro</article>", "intro\npara\noutro"),
        ("<p>Press <button>Go</button> now</p>", "Press now"),
        ('Text <span class="ad">Buy now</span> more', "Text more"),
        ("a<span hidden>b</span>c", "ac"),
        ("Pick <select><option>One</select> here", "Pick here"),
        ('<p>x <a class="share-link">Share</a> y <label>L</label></p>', "x y"),
        # Words inside other attributes' names and values say nothing, nor do names that merely hold such a word.
        ('<p title="a hidden gem">Kept text</p>', "Kept text"),
        ('<p data-id="menu">kept</p>', "kept"),
        ('<article><section id="discussion"><p>d</p></section><div class="form-of-government"><p>e</p></div><table class="social-statistics"><tr><td>f</table><p>g</article>', "d\ne\nf\ng"),
        # An article's mark doesn't silence a longer text beside it; a form around everything isn't one.
        ("<div><p>Main text outside</p></div><article><p>teaser</p></article>", "Main text outside\nteaser"),
        ("<form><main><p>all of it in a form</p></main></form>", "all of it in a form"),
        ("<p " + "a=1 " * 3000 + ">with attributes</p>", "with attributes"),
        ("<svg><title>t</title><p>x</p></svg>after", "after"),
        ("<!-->a<!--->b<!-- x --!> y -->c", "abc"),
    ],
)
def test_main_text(html, text):
    assert html_main.main_text(html) == text


@pytest.mark.parametrize("piece", ["<p ", "<", '<a="', "<!--", "<script>", "<div>", "<b>", "</p>", "<a '", "<!", "&", "<p>", "<table><tr><td>", "<b><i></i>", "<?", "<title>"])
@pytest.mark.parametrize("end", ["", "x>"])
def test_long_and_broken_pages(piece, end):
    began = time.time()
    html_main.main_text(piece * 20_000 + end)
    assert time.time() - began < 20


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def site(n, seed, host="site"):
    """Pages of neutral names: menu, notice and advert have new words on every page, but one place and style."""
    rng = random.Random(seed)
    rows, want = [], {}
    for i in range(n):
        paragraphs = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 7))]
        title = words(rng, 4)
        menu = "".join(f"<li><a href=/{k}>{words(rng, 1)}</a></li>" for k in range(5))
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<p>The same line closes every story of this house</p>"
        rows.append((i, f"http://{host}.example/{i}", f'<div class="x1"><ul>{menu}</ul></div><div class="x2">{words(rng, 5)}</div><div class="x3">{body}</div><div class="x4"><p>{words(rng, 6)}</p></div>'))
        want[i] = "\n".join([title, *paragraphs])
    return rows, want


def test_tree_alone_finds_the_article(spark):
    rows, want = site(40, 3)
    got = {r["page_id"]: r["text"] for r in html_main.extract_pages(pages_of(spark, rows), priors=False).collect()}
    assert got == want
    # Without the tree nothing goes, and a page by itself says too little.
    assert all(html_main.main_text(html, low=0.0) != want[i] != html_main.main_text(html) for i, _, html in rows)


def test_salted_lists_give_the_same(spark):
    rows, want = site(40, 4)
    more, _ = site(12, 5, "other")
    pages = pages_of(spark, rows + [(1000 + i, u, h) for i, u, h in more]).cache()
    expect = sorted(map(tuple, html_main.extract_pages(pages).collect()))
    assert sorted(map(tuple, html_main.extract_pages(pages, broadcast_bytes=0, salt_pages=7).collect())) == expect
    assert {r[0]: r[2] for r in expect if r[0] < 1000} == want


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "salt_pages": 7}])
def test_nodes_of_few_pages_are_judged_by_the_tree(spark, options):
    rows, _ = site(160, 7)
    few, more = site(12, 8)  # a section of 12 of 172 pages, with a frame of its own
    rows += [(1000 + i, u, f'<div class="y0">{h}</div>') for i, u, h in few] + [(1012, few[0][1], f'<div class="y0">{few[0][2]}</div>')]
    want = {1000 + i: t for i, t in more.items()} | {1012: more[0]}
    rows += [(2000, "http://alone.example/", "<div class=z1><p>said twice</p><p>said twice</p></div><div class=z2><p>" + words(random.Random(9), 40) + "</p></div>")]
    pages = pages_of(spark, rows)
    nodes, texts = (x.where(F.col("host") == F.xxhash64(F.lit("site.example"))).collect() for x in html_main.style_tree(pages))
    whole = html_main.SiteTree({r["node"]: (r["pages"], r["novel"], r["style_entropy"]) for r in nodes}, frozenset(r["text"] for r in texts if r["novelty"] < html_main.LOW))
    got = {r["page_id"]: r["text"] for r in html_main.extract_pages(pages, priors=False, **options).collect()}
    assert got.pop(2000).startswith("said twice\nsaid twice\n")
    assert {i: got[i] for i in want} == want
    assert got == {i: html_main.main_text(h, whole, priors=False) for i, _, h in rows if i < 2000}
    # A node on one page has in the tree what the page says by itself.
    for r in nodes:
        if r["pages"] == 1:
            assert r["style_entropy"] == 0 and r["novel"] in {float(t[r["node"]].fresh) for t in (html_main.parse(h)[0] for _, _, h in rows) if r["node"] in t}


def test_tree_against_plain_counts(spark):
    rows, _ = site(30, 6)
    rows += [(500 + i, f"http://site.example/m{i}", "<div class=x3><h1>mirror</h1><p>" + "one and the same article on several pages of the site, " * 3 + "</p></div>") for i in range(6)]
    nodes, texts = html_main.style_tree(pages_of(spark, rows))
    styles, seen, of_node = {}, {}, {}
    for _, _, html in rows:
        tree, blocks = html_main.parse(html)
        own = html_main.page_print(blocks)
        for k, x in tree.items():
            styles.setdefault(k, []).append(tuple(run for run, _ in itertools.groupby(tuple(e.kids) for e in x.styles)))
        for node, text in {(b.node, b.text) for b in blocks}:
            seen.setdefault((node, text), []).append(own)
    for (node, text), prints in seen.items():
        c = len(prints) if len(set(prints)) > 1 else 1
        novelty = 1 - math.log(c) / math.log(len(styles[node]) + html_main.UNSEEN)
        of_node[node] = of_node.get(node, 0.0) + novelty * len(prints) * len(text.split())
        seen[node, text] = (c, novelty)
    got = {r["node"]: r for r in nodes.collect()}
    assert set(got) == set(styles)
    for k, runs in styles.items():
        n = len(runs)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(runs).values())
        assert got[k]["pages"] == n and got[k]["style_entropy"] == pytest.approx(entropy, abs=1e-9) and got[k]["novel"] == pytest.approx(of_node.get(k, 0.0) / n, abs=1e-9)
    low = {(r["text"], round(r["novelty"], 9)) for r in texts.collect()}
    assert low == {(html_main.text_key(*k), round(v, 9)) for k, (c, v) in seen.items() if c > 1}
    assert all(v == 1.0 for (_, t), (_, v) in seen.items() if t.startswith("one and the same"))


def test_composite_importance():
    nodes, _ = html_main.parse("<div class=a><p>one two</p></div><div class=b><p>" + "word " * 8 + "</p></div>")
    a, b = list(nodes)[1], list(nodes)[3]
    alone = html_main.importances(nodes)
    seen = html_main.UNSEEN / (1 + html_main.UNSEEN)
    assert alone == pytest.approx({a: 0.25 + 0.75 * seen, b: 1.0})
    known = html_main.SiteTree({0: (98.0, 0.0, 0.0), a: (98.0, 0.0, 0.0), list(nodes)[2]: (98.0, 2.0, 0.0)})
    assert html_main.importances(nodes, known)[a] == pytest.approx(0.25 + 0.75 * 0.02)
    assert html_main.presentation(0.0, 50.0, 100.0) == pytest.approx(1.0) and html_main.presentation(0.5, 98.0, 98.0) == pytest.approx(0.51)


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://site.example/{i}", f'<div><p>story number {i} tells {i * 7}</p></div><div class="x9"><p>subscribe now to all of it</p></div>') for i in range(20)]
    rows += [(100 + i, f"http://mirror.example/{i}", "<article><p>the same article everywhere</p></article>") for i in range(12)]
    rows += [(200, "http://small.example/", '<div class="x9"><p>subscribe now to all of it</p></div>'), (201, None, None), (202, "no url", "<p>plain"), (202, "no url", "<p>plain")]
    got = {}
    for r in html_main.extract_pages(pages_of(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[7] == ["story number 7 tells 49"]
    assert got[103] == ["the same article everywhere"] and got[200] == ["subscribe now to all of it"]
    assert got[201] == [""] and got[202] == ["plain", "plain"]
    assert html_main.extract_pages(pages_of(spark, [])).count() == 0


def test_host(spark):
    urls = ["http://A.example:80/x", "https://u@b.example", "nope", None, "ftp://c.example?q"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(html_main.host_of(F.col("u"))).collect()]
    assert got == ["a.example", "b.example", "", "", "c.example"]


ROWS = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (4, "http://b\r\nX: y", ""), (5, "u", "z" * 300_000), (5, "u", "z" * 300_000), (None, "q", "solo"), (6, "h", "\r\n\r\nWARC/1.1\r\n")]


def test_archives_hold_everything(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages_of(spark, ROWS + [(100 + i, f"http://c/{i}", f"<p>page {i} of many</p>" * 40) for i in range(300)]), path)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(got) == len(ROWS) + 300
    by_id = {r["page_id"]: r for r in got}
    for page, _, html in ROWS:
        payload = (html or "").encode()
        r = by_id[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert bytes(r["payload"]) == (payload if r["record_type"] == "response" else b"")
    assert (by_id[1]["record_type"], by_id[1]["refers_to"], by_id[2]["record_type"], by_id[2]["refers_to"]) == ("revisit", 2, "response", None)
    assert (by_id[3]["record_type"], by_id[3]["refers_to"], by_id[4]["record_type"]) == ("revisit", 4, "response")
    assert [r["record_type"] for r in got if r["page_id"] == 5] == ["response"] * 2 and by_id[None]["record_type"] == "response"


def test_archive_format(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archives(pages_of(spark, [(i, f"http://c/{i}", f"<p>page {i}</p>" * 50) for i in range(200)]), str(path))
    for file in path.glob("part-*"):
        data = file.read_bytes()
        mark, size = struct.unpack_from("<II", data)
        assert mark == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        # A plain streaming reader takes the file too: skippable frames are passed over.
        whole = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data[8 + size :], read_across_frames=True).read()
        records = list(warc.records_of(data))
        assert whole == b"".join(records) and all(r.startswith(b"WARC/1.1\r\nWARC-Type: ") for r in records)


def test_archives_of_nothing(spark):
    assert warc.archive_round_trip(pages_of(spark, [])).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    good = warc.record(1, "u", b"payload", None)
    fields, http, payload = warc.parse_record(good)
    assert (fields["WARC-Type"], http["Content-Length"], payload) == ("response", "7", b"payload")
    with pytest.raises(ValueError):
        list(warc.records_of(b"garbage!" * 4))
