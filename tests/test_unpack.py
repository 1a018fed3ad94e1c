import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.operators.unpack import LINK, POSTING, buffers, split_values, take_ranges, unpack_values


def values(rows, kind=LINK):
    data, offs = buffers(pa.array(rows, pa.string()))
    v = split_values(data, offs, kind)
    return list(zip(v["row"].tolist(), v["pos"].tolist(), take_ranges(data, v["start"], v["end"]).to_pylist(), take_ranges(data, v["digits"], v["digits_end"]).to_pylist(), strict=True))


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("http://a/1@!#https://b/2", ["http://a/1", "https://b/2"]),
        ('"http://a/1", "http://b/2"', ["http://a/1", "http://b/2"]),
        ("'http://a/1'@!#http://b/2@!#'http://c'", ["http://a/1", "http://b/2", "http://c"]),
        ("@!#http://a@!#@!#http://b@!#", ["http://a", "http://b"]),
        ("http://a ,http://b|http://c | http://d; http://e\r\nhttp://f\thttp://g@@!!##http://h", [f"http://{c}" for c in "abcdefgh"]),
        ("https://d/go?u=https://e/5@!#http://x", ["https://d/go?u=https://e/5", "http://x"]),
        ("http://a/p;v=1,2@!#http://b", ["http://a/p;v=1,2", "http://b"]),
        ('"http://a/x, http://y","http://b"', ["http://a/x, http://y", "http://b"]),
        ("no url here", []),
        ("", []),
    ],
)
def test_links(text, items):
    assert [v[2] for v in values([text])] == items
    assert [v[1] for v in values([text])] == list(range(len(items)))


@pytest.mark.parametrize(
    ("text", "pairs"),
    [
        ("http://a@!#1@@!!##http://b@!#22", [("http://a", "1"), ("http://b", "22")]),
        ('"http://a:443/1",1;"http://b/2,5",22', [("http://a:443/1", "1"), ("http://b/2,5", "22")]),
        (" http://a/394 @!# 1", [("http://a/394", "1")]),
        ("'http://r/v?id=5&t=f'=2 | 'http://q/8'=3", [("http://r/v?id=5&t=f", "2"), ("http://q/8", "3")]),
        ("http://h/15 5\thttp://h/9 1", [("http://h/15", "5"), ("http://h/9", "1")]),
        ('"http://o@!#7"@@!!##http://x/1:1, http://y/p;v=8|2', [("http://o", "7"), ("http://x/1", "1"), ("http://y/p;v=8", "2")]),
        ("http://nocount/x@@!!##@@!!##", [("http://nocount/x", "")]),
    ],
)
def test_postings(text, pairs):
    assert [(v[2], v[3]) for v in values([text], POSTING)] == pairs


URL = st.builds(lambda h, p, q: f"http{h}.test/{p}{q}", st.sampled_from(["://a", "s://b", "s://www.c:443", "://d:80"]), st.from_regex(r"[a-z0-9/.-]{0,12}", fullmatch=True), st.sampled_from(["", "?u=https://e/1", ";v=1", ",2", "?id=5&t=x"]))
SEPARATOR = st.sampled_from(["@!#", "@@!!##", "|", " | ", ", ", " ,", "; ", "\n", "\r\n", "\t", "@!#@!#", "@!# "])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(URL, st.sampled_from(["", '"', "'"])), max_size=5), SEPARATOR), max_size=6))
def test_round_trip(rows):
    texts = [sep.join(f"{q}{u}{q}" for u, q in urls) for urls, sep in rows]
    expected = [(i, k, u) for i, (urls, _) in enumerate(rows) for k, (u, _) in enumerate(urls)]
    assert [v[:3] for v in values(texts)] == [(i, k, re.sub(r"[\s|;,]+$", "", u)) for i, k, u in expected]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(URL, st.integers(0, 99999)), max_size=5), st.sampled_from(["@!#", " @!# "]), st.sampled_from(["@@!!##", "\n@@!!##", "@@!!##@@!!##"])), max_size=6))
def test_posting_round_trip(rows):
    texts = [sep.join(f"{u}{inner}{n}" for u, n in items) for items, inner, sep in rows]
    assert [(v[0], v[2], v[3]) for v in values(texts, POSTING)] == [(i, u, str(n)) for i, (items, _, _) in enumerate(rows) for u, n in items]


def test_frame_edge_cases(spark):
    rows = [(1, "http://a@!#1", "x", 5), (1, "http://a@!#1", "x", 5), (2, None, None, None), (None, '"http://b",' + "9" * 25, "y", 6), (3, "", "z", 7), (4, "http://" + "c" * 3_000_000 + "|3", "w", 8)]
    df = spark.createDataFrame(rows, "id long, packed string, item string, __packed int")
    got = unpack_values(df, "packed", ["id", "item"], POSTING).collect()
    assert sorted((r.id or -1, r.item_kept, r.pos, len(r.item), r["count"]) for r in got) == [(-1, "y", 0, 36, None), (1, "x", 0, 12, 1), (1, "x", 0, 12, 1), (4, "w", 0, 3_000_011, 3)]
    assert unpack_values(df.limit(0), "packed", ["id"]).count() == 0
    assert [r.item for r in unpack_values(df.where("id = 1").limit(1), "packed", []).collect()] == ["http://a@!#1"]
