import time

import pyarrow as pa

from skeinwork.llm.pagetree import Page
from skeinwork.llm.words import closed, page_words, pieces, plain


def test_pieces():
    texts = ["a" * 10, None, "b" * 100, "", "c", "d" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["i", "t"])
    for rows, size in ((1, 10**6), (2, 12), (6, 1), (100, 100), (100, 10**6)):
        got = list(pieces(batch, 1, rows, size))
        assert [i for b in got for i in b.column(0).to_pylist()] == list(range(6)) and all(0 < b.num_rows <= rows for b in got)
    assert len(list(pieces(batch, 1))) == 1 and list(pieces(batch.slice(0, 0), 1)) == []


def test_unclosed_tags_take_linear_time():
    text = "<p>word</p>" + "<a <b <!x <script " * 60_000
    began = time.perf_counter()
    assert page_words(text)[0] == "word" and plain(text).split()[0] == "word" and Page(text, True).segments[0].text == "word"
    assert time.perf_counter() - began < 5
    assert closed("a < b > c < d") == "a < b > c   d" and closed("a > b") == "a > b"


def test_page_words():
    page = "<!-- no --><title>A&amp;B</title><script>x = '<p>no</p>'</script><STYLE>p { }</style><p class='k'>caf&eacute; 42x</p>&lt;tail <!-- open"
    assert page_words(page) == ["a", "b", "caf", "42x", "tail", "open"]
