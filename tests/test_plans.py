import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skeinwork.plans import corpus, crawl, index, pagerank, search

PAGES = [
    ("http://a.test/one", "<title>Red gardens</title><meta name='description' content='A garden of red stones'><body>garden garden stone stone stone once <a href='/two'>x</a><a href='http://b.test/'>y</a></body>"),
    ("http://a.test/two", "<title>Stones</title><body>stone stone garden <a href='/one'>x</a><a href='/one'>again</a></body>"),
    ("http://b.test/", "<title>Nothing</title><body>the of and <a href='/gone'>z</a></body>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "url string, page string")


def test_latest_pages(spark):
    rows = [("u", "old", 1), ("u", "new", 2), ("u", None, 3), (None, "x", 1), ("v", None, 1)]
    got = corpus.latest_pages(spark.createDataFrame(rows, "url string, page string, crawled_at int")).collect()
    assert [(r.url, r.page) for r in got] == [("u", "new")]


def test_links_and_stats(pages):
    graph = {r.url: r.links for r in corpus.link_graph(pages).collect()}
    assert graph == {"http://a.test/one": ["http://a.test:80/two", "http://b.test:80/"], "http://a.test/two": ["http://a.test:80/one"], "http://b.test/": ["http://b.test:80/gone"]}
    stats = {r.url: (r.title, r.description, r.desc_words, r.body_words) for r in corpus.document_stats(pages).collect()}
    assert stats["http://a.test/one"] == ("Red gardens", "A garden of red stones", 3, 6)
    assert stats["http://b.test/"] == ("Nothing", None, 0, 0)


def test_canonical(spark):
    df = spark.createDataFrame([("b", "same"), ("a", "same"), ("c", "other")], "url string, page string")
    assert {r.url: r.canonical_url for r in corpus.canonical_urls(df).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_index(pages):
    rows = {(r.word, r.field, r.url): r.cnt for r in index.postings(pages).collect()}
    one, two = "http://a.test/one", "http://a.test/two"
    assert rows["garden", 1, one] == 1 and rows["garden", 2, one] == 1 and rows["garden", 3, one] == 2 and rows["stone", 3, two] == 2
    # single occurrences in the body are not indexed
    assert ("onc", 3, one) not in rows and ("garden", 3, two) not in rows
    lists = {(r.word, r.field): (r.n, r.list) for r in index.packed_index(index.postings(pages)).collect()}
    assert lists["stone", 3] == (2, f"{one}@!#3@@!!##{two}@!#2")
    assert all(r.n for r in index.packed_index(index.postings(pages), min_postings=3).collect())
    parts = {(r.part, r.list) for r in index.packed_index(index.postings(pages), fragment=1).where("word = 'stone' AND field = 3").collect()}
    assert parts == {(0, f"{one}@!#3"), (1, f"{two}@!#2")}


def test_saved_postings(pages, spark, tmp_path):
    index.save_postings(index.postings(pages), str(tmp_path / "index"))
    saved = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(map(tuple, saved.select("word", "field", "url", "cnt").collect())) == sorted(map(tuple, index.postings(pages).collect()))
    plan = saved.where("word = 'stone'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,stone)" in plan


def test_stored_postings(spark):
    rows = [(1, " Stone ", "http://a@!#2", None, "http://a@!#3@@!!##http://b,1"), (2, "stone", "http://a@!#2", None, None), (3, "red", None, "http://c@!#1", None), (4, None, "http://d@!#1", None, None)]
    df = spark.createDataFrame(rows, "frag_id long, word string, priority1 string, priority2 string, priority3 string")
    got = lambda w: sorted(map(tuple, index.stored_postings(df, w).collect()))
    assert got(["stone"]) == [("stone", 1, "http://a", 2), ("stone", 3, "http://a", 3), ("stone", 3, "http://b", 1)]
    assert len(got(None)) == 4 and got([]) == []


def test_top_terms(spark):
    body = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)} " * (2 + (i < 3)) for i in range(60))
    rows = index.postings(spark.createDataFrame([("u", f"<body>{body}</body>")], "url string, page string"), stemmed=False).where("field = 3").collect()
    assert len(rows) == 50 and sum(r.cnt == 3 for r in rows) == 3 and max(r.word for r in rows) == "wordbx"


def test_positions(spark):
    df = spark.createDataFrame([("u", "<body>cats run, cats</body>"), ("v", "<body>cat</body>")], "url string, page string")
    got = {r.word: r.list for r in index.positional_lists(index.positions(df)).collect()}
    assert got == {"cats": "u:1 3", "cat": "u:1 3,v:1", "run": "u:2"}


def brute_ranks(graph, rounds=10):
    ranks = dict.fromkeys(graph, 1.0)
    for _ in range(rounds):
        got = dict.fromkeys(graph, 0.0)
        for u, links in graph.items():
            for v in links:
                if v in got:
                    got[v] += ranks[u] / len(links)
        ranks = {u: 0.85 * g + 0.15 for u, g in got.items()}
    return ranks


def test_pagerank(spark):
    graph = {"a": ["b", "c", "gone"], "b": ["a"], "c": [], "d": ["a", "a"]}
    df = spark.createDataFrame(list(graph.items()), "url string, links array<string>")
    got = {r.url: r.rank for r in pagerank.pagerank(df).collect()}
    assert got == pytest.approx(brute_ranks(graph))
    shuffled = pagerank.pagerank(df.orderBy(F.desc("url")).repartition(3)).collect()
    assert {r.url: r.rank for r in shuffled} == pytest.approx(got)


POSTINGS = [("red", 1, "u", 2), ("red", 3, "u", 5), ("red", 3, "v", 1), ("blue", 2, "v", 3), ("blue", 3, "w", 4), ("blue", 3, "lost", 9)]
STATS = [("u", "U", "du", 0, 24), ("v", "V", None, 8, 3), ("w", None, None, 1, 0)]


def search_inputs(spark):
    return spark.createDataFrame(POSTINGS, "word string, field int, url string, cnt long"), spark.createDataFrame(STATS, "url string, title string, description string, desc_words long, body_words long")


def brute_search(words):
    stats = {u: {1: 0, 2: d, 3: b} for u, _, _, d, b in STATS}
    scores = {}
    for w in words:
        n = sum(p[0] == w for p in POSTINGS) * words.count(w)
        weights = {}
        for word, f, u, c in POSTINGS:
            if word == w and u in stats:
                weights[u] = weights.get(u, 16) + c / math.sqrt(1 + stats[u][f])
        for u, x in weights.items():
            scores[u] = scores.get(u, 1) * x ** (8 / (1 + math.log(n)))
    return scores


@pytest.mark.parametrize("words", [["red"], ["red", "blue"], ["red", "red", "blue"], ["none"]])
def test_ranked(spark, words):
    got = search.ranked(*search_inputs(spark), words).collect()
    expected = brute_search(words)
    assert [r.url for r in got] == sorted(expected, key=lambda u: -expected[u])
    assert {r.url: r.score for r in got} == pytest.approx(expected)


def test_paging_and_json(spark):
    postings, stats = search_inputs(spark)
    first = search.ranked(postings, stats, ["red", "blue"], limit=1).collect()
    rest = search.ranked(postings, stats, ["red", "blue"], bound=first[0].score).collect()
    assert len(rest) == 2 and first[0].url not in [r.url for r in rest]
    results = json.loads(search.to_json(search.ranked(postings, stats, ["red", "blue"])).first().json)
    assert [r["url"] for r in results] == [first[0].url, *(r.url for r in rest)]
    assert "title" not in next(r for r in results if r["url"] == "w")


def test_blended(spark):
    postings, stats = search_inputs(spark)
    ranks = spark.createDataFrame([("u", 2.0)], "url string, rank double")
    got = {r.url: (r.title, r.score) for r in search.blended(postings, stats, ranks, "red blue red").collect()}
    idf = math.log(3 / 2)
    assert got["u"] == ("U", pytest.approx((0.8 * 7 / 24 * idf + 0.2 * 2.0) * 2 / 3))
    # three pages have blue, one of them without statistics
    assert got["w"] == ("w", pytest.approx((0.8 * 4 / 1 * math.log(3 / 3) + 0.2 * 0.15) / 3))


def test_query_terms():
    assert search.query_terms("The Gardens, of RED-stones 42!") == ["garden", "red", "stone"]
    assert search.query_terms("The Gardens", strict=True) == ["The", "Garden"]


def test_frontier_and_robots(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "bad.x"), ("b", "d" * 301), ("z", "y"), (None, "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "url string")
    assert {r.url: r.depth for r in crawl.frontier(seeds, links, blocked=["bad"]).collect()} == {"a": 0, "b": 1, "c": 1}
    assert {r.url: r.depth for r in crawl.frontier(seeds, links, max_depth=1).collect()} == {"a": 0, "b": 1, "c": 1}
    hosts = spark.createDataFrame([("h", "User-agent: *\nDisallow: /no\nCrawl-delay: 2"), ("k", None)], "host string, robots string")
    known = spark.createDataFrame([("http://h/no/x", "h"), ("http://h/yes", "h"), ("http://k", "k"), ("http://q/no", "q")], "url string, host string")
    assert {r.url: r.delay_ms for r in crawl.allowed(known, hosts).collect()} == {"http://h/yes": 2000, "http://k": 400, "http://q/no": 400}


def reached(links, seeds, depth):
    """Plain breadth-first search: url -> least depth."""
    found = dict.fromkeys(seeds, 0)
    newest = list(seeds)
    for d in range(1, depth + 1):
        newest = sorted({t for s in newest for t in links.get(s, []) if t not in found and len(t) <= 300})
        found |= dict.fromkeys(newest, d)
    return found


def test_whole_frontier(spark, tmp_path):
    links = {f"http://h.test/view?id={i:02}": [f"http://h.test/view?id={i + 1:02}", "http://h.test/view?id=00"] for i in range(40)}
    links |= {"http://k.test/b": ["http://h.test/view?id=09", "http://k.test/c"], "http://k.test/a": ["http://k.test/b", "http://k.test/" + "d" * 300], "http://z.test/": []}
    spark.createDataFrame([(u, " ".join(to) or None) for u, to in links.items()] + [(None, "http://q.test/")], "url string, link string").write.parquet(f"{tmp_path}/graph.parquet")
    seeds = ["http://h.test/view?id=00", "http://k.test/a", "http://z.test/"]
    expected = reached(links, seeds, crawl.MAX_DEPTH)
    assert max(expected.values()) == crawl.MAX_DEPTH == 15 and "http://h.test/view?id=23" not in expected
    got = entry.queries()["crawl_frontier_whole"](spark, str(tmp_path)).collect()
    assert len(got) == len(expected) and {r.url: r.depth for r in got} == expected


def test_replay(spark):
    body = lambda *to: "<body>" + "".join(f"<a href='{t}'>x</a>" for t in to) + "</body>"
    rows = [
        ("http://h/a", "h", "200", "en", body("/b", "http://h:80/c", "/no/x", "/far")), ("http://h/b", "h", "200", None, body("/d")), ("http://h:80/c", "h", "200", None, body("/d")), ("http://h/d", "h", "404", None, None),
        ("http://h/no/x", "h", "200", None, body("/e")), ("http://h/e", "h", "200", None, body()), ("http://k/a", "k", "200", "de", body("http://h/e")), ("http://h/a", "h", "200", "en", body("/b", "http://h:80/c", "/no/x", "/far")),
    ]
    pages = spark.createDataFrame(rows, "url string, host string, response_code string, lang string, page string")
    hosts = spark.createDataFrame([("h", "User-agent: *\nDisallow: /no")], "host string, robots string")
    seeds = spark.createDataFrame([("http://h/a",), ("http://k/a",), ("http://gone/",)], "url string")
    got = {r.url: (r.depth, r.canonical_url) for r in crawl.replay(seeds, pages, hosts).collect()}
    # c is a copy of b, so its links are not followed; d comes by b
    assert got == {"http://h/a": (0, None), "http://k/a": (0, None), "http://h/b": (1, None), "http://h:80/c": (1, "http://h/b"), "http://h/d": (2, None)}
    assert crawl.replay(seeds.limit(0), pages, hosts).count() == 0
    assert {r.url for r in crawl.replay(seeds, pages, hosts, blocked=["/b"]).collect()} == {"http://h/a", "http://k/a", "http://h:80/c", "http://h/d"}


def test_schedule(spark):
    rows = [("u2", "h", 1, 500), ("u1", "h", 1, 500), ("u3", "h", 0, 500), ("v", "k", 0, 400)]
    got = crawl.polite_schedule(spark.createDataFrame(rows, "url string, host string, depth int, delay_ms long")).collect()
    assert {r.url: r.start_ms for r in got} == {"u3": 0, "u1": 500, "u2": 1000, "v": 0}
