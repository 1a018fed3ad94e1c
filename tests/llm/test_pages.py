import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from skeinwork.llm import bodies, coherence
from skeinwork.llm.pagetree import Page, article_segments, dated, line_contexts, line_shape

ROOT = "/root/testdata/sf0.01"
SENTENCES = [
    "The old harbor has a long wall, a quiet market and a school that few visitors know.",
    "Most people who walk along the river will also see the mill, although it is closed in winter.",
    "When the weather is good, you can hear the bells of both towns from the top of the hill.",
    "Nobody in the village remembers who planted the trees, but everyone is glad of their shade.",
]
ARTICLE = f"<h1>A walk</h1>\n<p>By the Harbor desk, 3 May 2023</p>\n<p>{SENTENCES[0]} {SENTENCES[1]}</p>\n<p>Then it rained.</p>\n<ul>\n<li>a mill</li>\n<li>{SENTENCES[2]}</li>\n</ul>\n<div class=\"x\">Sign up for our newsletter and get stories every day.</div>\n<table>\n<tr><td>Rain</td><td>8</td></tr>\n</table>\n<p>{SENTENCES[3]}"


PROMOTED = "Sign up for our newsletter and get stories every day."


def body_lines(text, recurring=frozenset([line_shape(PROMOTED)])):
    page = Page(text, True)
    return sorted({page.segments[i].line for i in article_segments(page, recurring)})


@pytest.mark.parametrize(
    "shell",
    [
        "<body>\n<header><nav><ul><li><a href='/a'>A page of news</a></li></ul></nav></header>\n<main>\n<article>\n{}\n</article>\n<p>3 comments</p>\n<p>joe: What a nice long walk that was, and so well told.</p>\n</main>\n<aside><p>A story of a very different kind, told by somebody else altogether.</p></aside>\n<footer>All rights reserved.</footer></body>",
        "<body>\n<div id='content-main-article'><a href='/a'>News</a> | <a href='/b'>Shop</a></div>\n<div class='sidebar'>\n{}\n</div>\n<div>\n<p>A story of a different kind, told by somebody else.</p>\n<p>And one more of them, to be read tomorrow.</p>\n</div>\n<p>Copyright 2023 X</p></body>",
        "<body><table>\n<tr><td>\n<p>A story of a different kind, told by somebody else.</p>\n<a href='/x'>More of the same kind</a>\n</td><td>\n{}\n</td></tr></table></body>",
    ],
)
def test_layouts(shell):
    text = shell.format(ARTICLE)
    lines = text.split("\n")
    got = [re.sub(r"<[^>]*>", " ", lines[i]).split() for i in body_lines(text)]
    assert [" ".join(x) for x in got] == ["A walk", f"{SENTENCES[0]} {SENTENCES[1]}", "Then it rained.", "a mill", SENTENCES[2], "Rain 8", SENTENCES[3]]


FURNITURE = [
    "Share this: Email Print Copy link", "17 comments - join the discussion", "Advertisement. The article continues below.", "Download the Harbor app: faster pages and alerts.",
    "We use cookies on this site to count visits.", "© 2021 Harbor. All rights reserved.", "Print this page or send it to a friend", "Abonnieren Sie jetzt den Brief aus dem Hafen",
]


@pytest.mark.parametrize("text", ["By the Harbor desk, 3 May 2023", "12 June 2023 - Staff writer, Old Town", "Last updated: 4 July 2023 | Reading time 4 min", "Posted on 3 May 2023 in boats", "2023-05-03"])
def test_bylines(text):
    assert dated(text)


def test_lines_that_recur_are_furniture(spark):
    """In any language, whatever names and numbers they have; what is mirrored recurs in one context only."""
    rows, want = [], {}
    for i in range(60):
        body = [sentence(i * 7 + k) + f" It was day {i * k} of it, as {chr(97 + i % 26) * 3} said." for k in range(5)]
        extra = [t.replace("Harbor", f"Town{i % 3}").replace("17", str(i)) for t in FURNITURE]
        lines = ["<body><main>", f"<h1>A walk no. {i}</h1>", f"<p>{body[0]}</p>", f"<p>{extra[i % 8]}</p>", f"<p>{body[1]}</p>", f"<div>{extra[(i + 3) % 8]}</div>", f"<p>{body[2]}</p>", "<h2>Sources</h2>", "<ul><li>a mill</li></ul>", "<p>Then it rained.</p>", "</main></body>"]
        rows.append((f"u{i}", "\n".join(lines)))
        want[f"u{i}"] = [1, 2, 4, 6, 7, 8, 9]
    mirrored = "\n".join(["<body><main>", "<h1>The mill</h1>", *[f"<p>{x} Once more, and never again, said Ann.</p>" for x in SENTENCES], "</main></body>"])
    rows += [(f"m{i}", mirrored) for i in range(30)]
    df = spark.createDataFrame(rows + [("none", None), ("empty", "")], "id string, page string")
    recurring = bodies.recurring_lines(df, "page", True)
    got = {}
    for r in bodies.body_lines(df, "id", "page", recurring).collect():
        got.setdefault(r.id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == want | {f"m{i}": [1, 2, 3, 4, 5] for i in range(30)}
    assert bodies.recurring_lines(df.limit(0), "page", True).count() == 0


@pytest.mark.parametrize("text", [*SENTENCES, "Then it rained.", "Not yet.", "The post was late by 3 days in May 2023 and nobody was at the desk to take it, so it went back.", "4 small boats", "Rain 8", "Harbor market review, no. 7"])
def test_no_bylines(text):
    assert not dated(text)


PROSE = [
    "After the vote the ministers were asked to join the debate, which had by then gone on for most of the week.", "No comments were made by the council before the vote.", "The new privacy policy of the bank was read by nobody, as a judge found in May.",
    "The firm moved its registered office to the harbor, where rents are low.", "She baked cookies for the school, small ones with nuts.", "A newsletter that the monks printed every week told the valley what the abbey had decided.",
    "Readers who want to support independent journalism have few papers left in the county.", "The terms of use of the well were set by the village in 1840.",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose_with_words_of_furniture(text):
    assert not dated(text)
    page = f"<body><article>\n<h1>A walk</h1>\n<p>{SENTENCES[0]}</p>\n<p>{text}</p>\n<p>{SENTENCES[3]}</p>\n</article></body>"
    assert body_lines(page) == [1, 2, 3, 4]


def test_hidden_text_and_broken_html():
    text = f"<body><div><p>{SENTENCES[0]}<p>{SENTENCES[1]}</i></b>\n<span style='display: none'>secret words of some length here</span>\n<p hidden>also hidden</p>\n<!-- no --><script>var x = '<p>no</p>'"
    page = Page(text, True)
    seen = [page.segments[i].text for i in article_segments(page)]
    assert seen == SENTENCES[:2]
    assert any("secret" in page.segments[i].text for i in article_segments(page, heard=True))


def test_body_frames(spark):
    text = f"<body>\n<div>\n{ARTICLE}\n</div></body>"
    deep = "<div>" * 3000 + SENTENCES[0]
    rows = [("a", text), ("a", text), ("n", None), ("e", ""), ("t", "no tags, only text of a certain length"), (None, text), ("d", deep), ("l", "<p>" + "word, " * 400_000)]
    df = spark.createDataFrame(rows, "id string, page string").selectExpr("id", "page", "5 AS line_no", "'q' AS body")
    none = spark.createDataFrame([], "shape bigint")
    lines = {}
    for r in bodies.body_lines(df, "id", "page", none).collect():
        lines.setdefault(r.id, []).append(r.line_no)
    assert set(lines) == {"a", "t", None, "d", "l"} and len(lines["a"]) == 2 * len(lines[None])
    got = {r.id: r.body for r in bodies.body_text(df, "id", "page", none).collect()}
    assert got["n"] == got["e"] == "" and got["d"] == SENTENCES[0] and got["a"].startswith("A walk\n")
    assert bodies.body_lines(df.limit(0), "id", "page", none).count() == 0


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_bodies_of_semantic_pages():
    """Pages with an article element say themselves what their body is; byline and promotions are inside of it."""
    pages = duckdb.sql(f"SELECT page FROM '{ROOT}/page_cache.parquet' WHERE page LIKE '%<article>%' AND page NOT LIKE '%display:none%' AND page NOT LIKE '%<font%' LIMIT 60").fetchall()
    assert len(pages) > 30
    contexts = [line_contexts(Page(t, True)) for (t,) in duckdb.sql(f"SELECT page FROM '{ROOT}/page_cache.parquet' WHERE page IS NOT NULL").fetchall()]
    times = Counter(shape for shape, _ in set().union(*contexts))
    recurring = {shape for shape, n in times.items() if n >= bodies.LEAST_PAGES}
    for (text,) in pages:
        lines = text.split("\n")
        a, b = lines.index("<article>"), lines.index("</article>")
        seen = [i for i in range(a + 1, b) if re.sub(r"<[^>]*>", "", lines[i]).strip()]
        got = body_lines(text, recurring)
        assert set(got) <= set(seen) and len(seen) - len(got) <= 3


def keywords(n):
    names = ["red lamp", "lamp shop", "cheap lamp", "lamp", "table lamp deals", "lamp near me"]
    return ", ".join(names[(i * 7 + i // 3) % 6] for i in range(n))


def sentence(i):
    nouns = ["harbor", "market", "river", "school", "garden", "window", "letter", "bridge", "castle", "forest"]
    a, b, c = (nouns[(i * k + k) % 10] for k in (1, 3, 7))
    return [f"The {a} of the town has a {b}, and the {c} is near it.", f"When the {a} is open, you can see the {b} from the {c}.", f"Most people who like the {b} will also visit the {a} and the {c}."][i % 3]


def spam_rows():
    prose = [(f"p{i}", "<body><div><h1>Title here</h1>" + "".join(f"<p>{sentence(i * 5 + k)} {sentence(i + 3 * k)}</p>" for k in range(4)) + "</div></body>") for i in range(60)]
    spam = [
        ("s0", f"<body><div><h1>Lamps</h1><p>{keywords(60)}</p></div></body>"),
        ("s1", f"<body><div><h1>Lamps</h1><p>{sentence(1)}</p><div style='display:none'>{keywords(60).replace(',', '')}</div></div></body>"),
        ("s2", "<body><div><h1>Links</h1><ul>" + "".join(f"<li><a href='http://x{i}.test/'>name{i} thing{i * 7}</a></li>" for i in range(40)) + "</ul></div></body>"),
        ("s3", f"<body><div><h1>Lamps</h1><p>{keywords(60).replace(',', '.')}</p></div></body>"),
    ]
    mixed = [("m0", "<body><div>" + "".join(f"<p>{sentence(k)} {sentence(k + 1)}</p>" for k in range(8)) + f"<p>{keywords(8)}</p></div></body>"), ("m1", "<body><div>" + "".join(f"<p><a href='http://o.test/{k}'>{sentence(k)}</a> {sentence(k + 4)}</p>" for k in range(5)) + "</div></body>")]
    return prose + spam + mixed


def test_spam(spark):
    rows = spam_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + rows[60:61]] + [("none", None, 1, "x"), (None, rows[0][1], 1, "x"), ("empty", "", 1, "x")], "id string, page string, r int, words string")
    got = {r.id: r for r in coherence.incoherence(df, "id", "page").collect()}
    assert {k for k, r in got.items() if r.loose_share > coherence.SPAM_SHARE} == {"s0", "s1", "s2", "s3"}
    assert got["empty"].n_words == 0 and got["empty"].loose_share == 0.0 and "none" not in got and len(got) == len(rows) + 1
    assert got["s0"].mean_pmi < -0.7 < 0 < got["p0"].mean_pmi + 0.4


def mirrored(i, near):
    """A list of tags of its own words; near copies differ in one of them."""
    names = [f"tag{k} item{k * k}" for k in range(80)]
    if near:
        names[i * 7 % 80] = f"city{i} place{i}"
    return ("c" + str(i), f"<body><div><h1>Tags</h1><p>{', '.join(names)}</p></div></body>")


@pytest.mark.parametrize("near", [False, True])
def test_mirrored_spam(spark, near):
    rows = spam_rows()
    copies = [mirrored(i, near) for i in range(len(rows) // 2)]
    got = coherence.incoherence(spark.createDataFrame(rows + copies, "id string, page string"), "id", "page").collect()
    assert len(got) == len(rows) + len(copies)
    assert {r.id for r in got if r.loose_share > coherence.SPAM_SHARE} == {"s0", "s1", "s2", "s3"} | {c for c, _ in copies}


def test_spam_edges(spark):
    empty = spark.createDataFrame([], "id string, page string")
    assert coherence.incoherence(empty, "id", "page").count() == 0
    one = spark.createDataFrame([("a", "<p>" + "word " * 300_000)], "id string, page string")
    assert coherence.incoherence(one, "id", "page").first().n_words == 300_000


def nothing(spark):
    return spark.sparkContext.broadcast(np.empty(0, np.int64))


def test_counts_do_not_depend_on_the_partitions(spark):
    df = spark.createDataFrame(spam_rows(), "id string, page string")
    contents = coherence._contents(df, "id", "page")
    a, b = ({tuple(r) for r in coherence.corpus_counts(x, nothing(spark)).collect()} for x in (contents.repartition(7), contents.coalesce(1)))
    assert a == b and len(a) > 100
    words = [w for _, p in spam_rows() for ws, *_ in coherence.content_lines(p) for w in ws]
    assert sum(n for _, w, n, _ in a if w is not None) == len(words) and len([w for _, w, _, _ in a if w is not None]) == len(set(words)) and (None, None, len(spam_rows()), len(spam_rows())) in a


def test_pages_joined_with_their_own_pairs(spark, monkeypatch):
    df = spark.createDataFrame(spam_rows(), "id string, page string")
    sent = {tuple(r) for r in coherence.incoherence(df, "id", "page").collect()}
    monkeypatch.setattr(coherence, "SENT_PAIRS", 10)
    assert {tuple(r) for r in coherence.incoherence(df, "id", "page").collect()} == sent


def test_many_distinct_pairs_hide_no_spam(spark):
    """Every page has hundreds of words of its own, so that distinct pairs grow with the pages; the cases stay the same."""
    import random

    rng = random.Random(9)
    own = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    rows = [(f"own{i}", "<body><div><h1>T</h1>" + "".join(f"<p>{sentence(i + k)} {' '.join(own() for _ in range(8))}.</p>" for k in range(60)) + "</div></body>") for i in range(300)]
    spam = [(f"spam{i}", f"<body><div><h1>T</h1><p>{', '.join(own() + ' ' + own() for _ in range(40))}</p></div></body>") for i in range(60)]
    df = spark.createDataFrame(spam_rows() + rows + spam, "id string, page string")
    contents = coherence._contents(df, "id", "page")
    assert coherence.corpus_counts(contents, nothing(spark)).where("pair IS NOT NULL").count() > 140_000
    got = {r.id for r in coherence.incoherence(df, "id", "page").where(f"loose_share > {coherence.SPAM_SHARE}").collect()}
    assert got >= {"s0", "s1", "s2", "s3"} | {s for s, _ in spam}
