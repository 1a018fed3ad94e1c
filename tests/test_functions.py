import pytest
from pyspark.sql import functions as F

from skeinwork.functions import html, urls
from skeinwork.functions.text import STOP_WORDS, stem, token_count, tokens
from skeinwork.functions.urls import robots_delay

# word -> stem, from the examples of the paper's rules
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensitiviti sensit
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
at at be be apologi apolog possibli possibl""".split()


@pytest.mark.parametrize(("word", "expected"), list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stem(word, expected):
    assert stem(word) == expected


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr.alias("x")).first().x


def test_tokens(spark):
    assert len(STOP_WORDS) == len(set(STOP_WORDS))
    assert one(spark, tokens(F.col("c0")), "The Cat's 2 hats, über naïve_x WWW and HTML cat") == ["cat", "hats", "ber", "cat"]
    assert one(spark, token_count(F.col("c0")), None) == 0


PAGE = """<html><head><TITLE>A &amp; B
 c</title><meta content='two' name=description><meta name="description" content="one"><script>var a = "<p>hid</p><a href='/no'>";</script></head>
<body><!-- x --><p>foo<b>bar</b>baz &lt;q&gt; &eacute;<p>open <a href="#f">f</a><a class="k" href="/rel?x=1&amp;y=2">r</a><a href='b.html'>b</a><a href=http://o.test/x.PNG>p</a>
<a href="mailto:a@b">m</a><a href="//c.test">c</a><a href="../up">u</a></body></html>"""


def test_html(spark):
    p = F.col("c0")
    assert one(spark, html.title(p), PAGE) == "A & B c"
    assert one(spark, html.title(p), "<title> </title>") is None
    assert one(spark, html.description(p), PAGE) == "two one"
    assert one(spark, html.description(p), "<meta name='x' content='y'>") is None
    assert one(spark, html.body_text(p), PAGE) == "foo bar baz <q> open f r b p m c u"
    assert "hid" not in one(spark, html.without_scripts(p), PAGE)
    assert one(spark, html.hrefs(p), PAGE) == ["/rel?x=1&y=2", "b.html", "http://o.test/x.PNG", "mailto:a@b", "//c.test", "../up"]
    for f in (html.title, html.description, html.body_text, html.without_scripts, html.hrefs):
        assert one(spark, f(p), None) is None


@pytest.mark.parametrize(
    ("url", "normal"),
    [
        ("http://a.test", "http://a.test:80/"), ("https://a.test/x?q=1#f", "https://a.test:443/x?q=1"), ("HTTP://a.test:8080/", "HTTP://a.test:8080/"), ("http://u:p@a.test/x", "http://u:p@a.test:80/x"),
        ("http://a.test/pic.JPG", None), ("http://a.test/pic.jpg?x", None), ("ftp://a.test/", None), ("mailto:x@y", None), ("http://[::1]/x", "http://[::1]:80/x"), ("http:///x", None), (None, None), ("", None),
    ],
)
def test_normal_url(spark, url, normal):
    assert one(spark, urls.normal_url(F.col("c0")), url) == normal


@pytest.mark.parametrize(
    ("base", "href", "full"),
    [
        ("http://a.test/d/e.html?x#y", "f.html", "http://a.test/d/f.html"), ("http://a.test", "f", "http://a.test/f"), ("http://a.test/d/e", "/g", "http://a.test/g"), ("https://a.test/d/", "//b.test/x", "https://b.test/x"),
        ("http://a.test/d/e/f", "../../g", "http://a.test/g"), ("http://a.test/d/e/f", "./g/./h", "http://a.test/d/e/g/h"), ("http://a.test/d", "../../g", "http://a.test/g"), ("http://a.test/d?x", "?y=1", "http://a.test/d?y=1"),
        ("http://a.test/", "https://b.test/", "https://b.test/"), ("http://a.test/", "javascript:x()", None),
    ],
)
def test_resolve(spark, base, href, full):
    assert one(spark, urls.resolve(F.col("c0"), F.col("c1")), base, href) == full


def test_split_url(spark):
    part = lambda u: tuple(one(spark, urls.split_url(F.col("c0")), u))
    assert part("http://a.test:80/x/y?z") == ("http", "a.test", "80", "/x/y?z")
    assert part("https://a.test") == ("https", "a.test", None, "/")
    assert part("/x/y") == (None, None, None, "/x/y")


def test_hashes(spark):
    assert one(spark, urls.url_key(F.col("c0")), "abc") == "a9993e364706816aba3e25717850c26c9cd0d89d"
    letters = one(spark, urls.letter_hash(F.sha1("c0")), "abc")
    assert len(letters) == 40 and letters.isalpha() and one(spark, urls.letter_hash(F.sha1("c0")), None) is None


def test_prefix_and_overlap(spark):
    assert one(spark, urls.common_prefix(F.col("c0"), F.col("c1")), "abcd", "abxy") == 2
    assert one(spark, urls.common_prefix(F.col("c0"), F.col("c1")), "", "abxy") == 0
    assert one(spark, urls.common_prefix(F.col("c0"), F.col("c1")), None, "a") == 0
    o = urls.overlap(F.col("c0"), F.col("c1"), F.col("c2"), F.col("c3"))
    assert tuple(one(spark, o, "b", "f", None, "d")) == ("b", "d")
    assert one(spark, o, "b", "c", "c", None) is None


@pytest.mark.parametrize(
    ("text", "path", "delay"),
    [
        (None, "/x", 400), ("", "/x", 400), ("User-agent: *\nDisallow: /a\nCrawl-delay: 1.5", "/b", 1500), ("User-agent: *\nDisallow: /a", "/ab", None), ("User-agent: *\nDisallow: /a\nAllow: /ab", "/abc", 400),
        ("User-agent: *\nAllow: /a\nDisallow: /ab", "/abc", None), ("User-agent: other\nDisallow: /", "/x", 400), ("User-agent: *\nDisallow:", "/x", 400), ("USER-AGENT: *\r\nDISALLOW: /\r\nallow: /", "/x", 400),
        ("Disallow: /\nUser-agent: *\nCrawl-delay: soon", "/x", 400),
    ],
)
def test_robots(text, path, delay):
    assert robots_delay(text, path) == delay


def test_robots_strict():
    assert robots_delay("User-agent: *\nDisallow:", "/x", strict=True) is None


def test_ids_and_bodies(spark):
    import gzip

    rows = [(gzip.compress("grün".encode()),), ("grün".encode(),), (b"\x1f\x8bbroken",), (b"\xff",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "b binary").select(urls.body_of("b").alias("t")).collect()]
    assert got[0] == got[1] == "grün" and got[3] == "�" and got[4] is None
    assert one(spark, urls.decoded(F.col("c0")), "a%20b+c") == "a b c" and one(spark, urls.decoded(F.col("c0")), "%zz") is None and one(spark, urls.decoded(F.col("c0")), None) is None
    ids = [r.x for r in spark.range(5).select(urls.random_id().alias("x")).collect()]
    assert len(set(ids)) == 5 and all(i[0].isalpha() for i in ids)
