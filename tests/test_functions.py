import math
import re
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import functions as F

from gleaner.functions import html, probability, text, urls


def test_strip_equals_python(column):
    values = ["", " a ", "\t\r\n a b  　", " x\x1f", "nothing", "\x85", "a​b "]
    assert column(values, text.strip) == [v.strip() for v in values]


def test_invalid_utf8_is_dropped_and_the_rest_kept(spark):
    samples = [b"ok", b"a\xffb", "gen�uine".encode(), "gen�uine".encode() + b"\xff", b"\xe2\x82", b"\xf0\x9f\x98\x80\xc3("]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(samples)], "i INT, b BINARY")
    got = rows.select("i", text.drop_invalid_utf8(F.col("b").cast("string")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [b.decode("utf-8", "ignore") for b in samples]


def test_words(column):
    assert column(["Élan, the 3 cats' naïve-idea", "123", ""], text.words) == [["élan", "the", "cats", "naïve", "idea"], [], []]


def test_authority_equals_urlparse(column):
    values = [
        "http://a.example.com/x?y#z", "https://Me:pw@A.Example.com:8080/p", "//host/path", "no-scheme.example/x",
        "http://h?q=//x", "http://h#f", "mailto:x@y", "", "ftp://u@h", "http:///path",
    ]
    assert column(values, urls.authority) == [urlparse(v).netloc for v in values]


def test_percent_decode_equals_unquote(column):
    values = ["a%20b", "100%_x", "a+b", "%zz", "%E9t%C3%A9"[3:], "x%2", "%", "%2Fa%2fb", "plain", "%E9x", "%ff%FE", "a%C3", "%E2%82x"]
    assert column(values, urls.percent_decode) == [unquote(v) for v in values]


def test_titles_and_names(column):
    assert column(["/wiki/A_b%28c%29", "https://x/wiki/Caf%C3%A9_au_lait", "x"], urls.title_from_url) == [
        "A b(c)", "Café au lait", "x",
    ]
    assert column(["A b"], lambda c: urls.url_from_title(c, "https://e/wiki/")) == ["https://e/wiki/A_b"]
    long = "https://é.example/ü?a=1&b=" + "x" * 200
    assert column([long], urls.safe_file_name) == ["https___é.example_ü_a_1_b_" + "x" * 124 + ".txt"]
    path = "crawl-data/CC-MAIN-2024/segments/1/warc/CC-MAIN-0262.warc.gz"
    assert column([path], urls.file_stem) == ["CC-MAIN-0262"]
    assert column([path], urls.tail) == [path[-12:]]


def test_parent_domains(column):
    assert column(["u:p@A.b.c:80"], urls.parent_domains) == [["a.b.c", "b.c", "c"]]


def test_html_traps(column):
    cases = {
        '<script>var t="</p><nav>";</script><p>kept</p>': "kept",
        "<style>p{}</style>a<br/>b<BR>c": "a\nb\nc",
        "<header>top</header><head><title>t</title></head><p>x": "x",
        "<nav><a>n</a></nav>one<footer>f</footer> two": "one two",
        "<!-- <p>no</p> -->yes": "yes",
        "a<script>never closed <p>gone</p>": "a",
        "a <b>bold</b> 1 < 2 and 3 > 2": "a bold 1 < 2 and 3 > 2",
        "<p>a</p>\n\n  <b>b</b> \t c": "a\nb c",
        "<navigation>kept</navigation>": "kept",
        '<div class="ad">buy</div><div class="main">read</div>': "read",
        "": "",
        # optional or missing end tags lose nothing but the tag
        "<html><head><title>t</title><body><p>Main text": "Main text",
        "<html><head><title>t</title><p>Main text": "Main text",
        "<nav><a>menu</a><p>Main text": "menu\nMain text",
        "<aside><p>Main <footer>text": "Main text",
        "<form action='x'><p>Main text<input><button>Go</button></form>": "Main text",
        "<header>site</header><article><header><h1>Headline</h1></header>body</article><header>x</header>": "Headline\nbody",
        "<article><header>Open": "Open",
        # advertising, whatever the quotes, other classes and what is nested
        "<div class='ad'>buy</div><p>read": "read",
        '<div id=x class="ad top">buy</div>read': "read",
        '<div class="top ad"><div>a<div>b</div></div>buy</div><div>read</div>': "read",
        '<div class="ad">never closed <div>x</div>read': "never closed\nx\nread",
        '<div class="add">read</div><div class=ad>buy</div>': "read",
    }
    assert column(list(cases), html.html_to_text) == list(cases.values())


def test_entities_are_decoded_once(column):
    cases = {
        "&lt;b&gt; &quot;x&quot; &amp; &copy;&middot;&nbsp;y": '<b> "x" & ©· y',
        "&amp;lt;": "&lt;", "&amp;amp;": "&amp;", "&#38;lt;": "&lt;", "&#x26;amp;": "&amp;",
        "&#233;&#xE9;&#128512;": "éé😀", "&#0;&#xD800;&#1114112;x": "x", "&unknown; &": "&unknown; &",
        "caf&eacute; &rsquo;&euro;&uuml; &amp;eacute; &AMP;euro;": "café ’€ü &eacute; &euro;",
    }
    assert column(list(cases), html.decode_entities) == list(cases.values())


def test_article_text_prefers_the_article(column):
    page = "<p>side</p><article><p>main</p></article><p>after</p>"
    assert column([page, "<p>only</p>"], html.article_text) == ["main", "only"]


def test_unclosed_markup_is_linear(column):
    page = "<nav><a " * 20_000 + "<p" * 20_000
    assert column([page], html.html_to_text) == [""]
    page = "<nav>x" * 50_000 + "<div class='ad'>" * 500 + "y"
    assert column([page], html.html_to_text) == [" ".join("x" * 50_000) + " y"]


def test_anchors_inside_a_class(column):
    page = (
        '<a href="/out">out</a><div class="x mw-collapsible-content y"><a class="k" href="/wiki/A_b">A <i>b</i></a>'
        '<a href="/c">c &amp; d</a></div>'
    )
    pattern = html.container_pattern("div", "mw-collapsible-content")
    loose = "<div class='mw-collapsible-content'><a id=x href='/s'>s<a href=/t >t</a><a name=n>no</a><abbr>b</abbr>"
    got = column([page, "none", loose], lambda c: html.anchors(c, pattern))
    assert [tuple(a) for a in got[0]] == [("/wiki/A_b", "A b"), ("/c", "c & d")] and got[1] == []
    assert [tuple(a) for a in got[2]] == [("/s", "s"), ("/t", "t")]


def test_probabilities_equal_numpy(column):
    rows = [[0.1, 2.0, -1.0, 0.3], [5.0, 5.0, 5.0, 5.0], [1000.0, 0.0, -1000.0, 999.0]]
    soft = [np.exp(np.array(r) - max(r)) / np.exp(np.array(r) - max(r)).sum() for r in rows]
    kind = "ARRAY<DOUBLE>"
    for got, want in zip(column(rows, probability.softmax, kind), soft):
        np.testing.assert_allclose(got, want, atol=1e-15)
    assert column(rows, probability.argmax, kind) == [1, 0, 0]
    np.testing.assert_allclose(
        column(rows, lambda c: probability.topk_mean(c, 3), kind), [np.sort(r)[-3:].mean() for r in rows]
    )
    p = [list(map(float, s)) for s in soft]
    h = [-(np.array(x) * np.log(np.array(x) + 1e-12)).sum() for x in p]
    np.testing.assert_allclose(
        column(p, probability.entropy_confidence, kind), [(1 - e / math.log(4)) * max(x) for e, x in zip(h, p)], atol=1e-12
    )
    assert column([[0.5, 0.5], [0.6, 0.4]], probability.max_or_default, kind) == [0.2, 0.6]
    assert column([[0.1]], probability.entropy_confidence, kind) == [0.1]
    assert column([1, 7], lambda c: probability.label_of(c, {1: "a"}), "INT") == ["a", None]


def test_sigmoid_does_not_overflow(column):
    assert column([-1000.0, 0.0, 1000.0], probability.sigmoid, "DOUBLE") == [0.0, 0.5, 1.0]


def test_main_block(column):
    story = "The main story goes on for a good while, and then some more text follows here."
    page = (
        "<html><head><title>t</title></head><body><nav><a href='/'>Home</a><a href='/x'>News and many other things to read</a></nav>"
        f"<div class='teaser'><a href='/y'>A long teaser that is nothing but a link to something else</a></div>"
        f"<div class=\"content\"><h1>Head &amp; line</h1><p>{story}<p>Read <a href='/z'>this</a> too, as it is well worth the time it takes.</div>"
        "<footer>Copyright, imprint and other legal text that nobody reads</footer></body></html>"
    )
    want = f"Head & line\n{story}\nRead this too, as it is well worth the time it takes."
    nothing = "<nav><a href='/'>only links</a></nav><p>short"
    tie = "<p>" + "a" * 30 + "<p><a href=x>" + "l" * 60 + "</a><p>" + "b" * 30
    plain = "no tags at all, but a text that is long enough to count"
    got = column([page, nothing, tie, plain, "", None], html.main_block)
    assert got == [want, "", "a" * 30, plain, "", None]
    scores = column(["<nav><p>" + "x" * 40 + "</p></nav>"], html.main_block)
    assert scores == ["x" * 40]  # a hint is about its own block
    assert column(["<nav>" + "x" * 90 + "<p>yy"], html.main_block) == [""]


def test_best_run_is_the_first_of_equal_ones(column):
    from pyspark.sql import functions as F

    def run(scores):
        blocks = F.transform(F.split(scores, " "), lambda s: F.struct(F.lit("").alias("text"), s.cast("int").alias("score")))
        return F.to_json(F.struct(html._best_run(blocks)["begin"], html._best_run(blocks)["end"]))

    cases = {"1 -2 1": (0, 1), "-1 -2": (0, 0), "0 3 0": (0, 2), "-1 2 -1 3 -9 4": (1, 4), "2 -2 2": (0, 1), "-3 1 -1 1": (1, 2)}
    for scores, (begin, end) in cases.items():
        best = max(((sum(map(int, scores.split()[a:b])), -b, -a) for a in range(7) for b in range(a + 1, 7) if b <= len(scores.split())), default=None)
        assert best[0] <= 0 or (-best[2], -best[1]) == (begin, end)
        assert list(__import__("json").loads(column([scores], run)[0]).values()) == [begin, end]
