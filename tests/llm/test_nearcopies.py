import random

import numpy as np
import pytest

from skeinwork.llm import nearcopies as nc
from skeinwork.llm.words import page_words

WORDS = [f"w{i}" for i in range(3000)]


def shingles(page):
    w = page_words(page)
    return frozenset(zip(w, w[1:], w[2:], strict=False))


def alike(pages):
    sets = {u: shingles(p) for u, p in pages}
    ids = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b]}


def versions(seed, texts=60, copies=5):
    rng = random.Random(seed)
    pages = []
    for t in range(texts):
        base = rng.choices(WORDS, k=rng.randint(80, 300))
        for v in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(int(len(words) * 0.03 * v)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            pages.append((f"u{t:03}{v}", f"<p>{' '.join(words)}</p>"))
    return pages


def frame(spark, rows):
    return spark.createDataFrame(rows, "url_hash string, page string")


def linked(links):
    return {(r.a, r.b): r.similarity for r in links.collect()}


def test_against_all_pairs(spark):
    pages = versions(1)
    links, members = nc.near_copies(frame(spark, pages), "url_hash", "page")
    got = linked(links)
    true = {k: j for k, j in alike(pages).items() if nc.ALIKE <= j < 1}
    assert set(got) <= set(true) and all(abs(got[k] - true[k]) < 1e-9 for k in got)
    assert len(got) >= 0.99 * len(true) and len(true) > 100


def test_trie_join_finds_all_within_budget():
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 2**64, (30, 4), dtype=np.uint64)
    code = centers[rng.integers(0, 30, 400)]
    for _ in range(60):
        code[np.arange(400), rng.integers(0, 4, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    group = np.sort(rng.integers(0, 3, 400))
    differ = np.bitwise_count(code[:, None] ^ code[None]).sum(axis=2)
    for most in (0, 20, 45, 256):
        x, y = nc.trie_join(group, np.zeros(400, np.int64), code, most)
        got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        i, j = np.nonzero(np.triu((differ <= most) & (group[:, None] == group[None]), 1))
        assert got == set(zip(i.tolist(), j.tolist(), strict=True)) and len(x) == len(got)
    side = rng.integers(1, 3, 400)
    x, y = nc.trie_join(group, side, code, 45)
    i, j = np.nonzero((differ <= 45) & (group[:, None] == group[None]) & (side[:, None] == 1) & (side[None] == 2))
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == set(zip(i.tolist(), j.tolist(), strict=True))


def test_large_shards_are_tiled(spark, monkeypatch):
    pages = versions(2, texts=12, copies=5)
    whole = linked(nc.near_copies(frame(spark, pages), "url_hash", "page")[0])
    monkeypatch.setattr(nc, "TILE", 3)
    assert linked(nc.near_copies(frame(spark, pages), "url_hash", "page")[0]) == whole


def test_copies_and_edges(spark):
    body = " ".join(WORDS[:60])
    near = " ".join(WORDS[:50])
    rows = [("b", body), ("a", f"<p>{body}</p>"), ("c", body.upper()), ("c", body.upper()), ("d", near), ("e", near), ("short", "one two"), ("empty", ""), ("none", None), (None, body), ("far", " ".join(WORDS[1000:1060]))]
    df = frame(spark, rows).selectExpr("url_hash", "page", "1 AS k1", "'x' AS id", "2 AS keys")
    links, members = nc.near_copies(df, "url_hash", "page")
    assert set(linked(links)) == {("a", "d")}
    assert {(r.id, r.representative) for r in members.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("far", "far")}
    pairs = {(r.a, r.b) for r in nc.link_rows(links, members).collect()}
    assert pairs == {("a", "b"), ("a", "c"), ("a", "d"), ("d", "e"), ("a", "e"), ("b", "d"), ("c", "d")}
    got = {r.id: (r.representative, r.group_id, r.n_links) for r in nc.groups(links, members).collect()}
    assert got["e"] == ("d", "a", 1) and got["c"] == ("a", "a", 1) and got["far"] == ("far", "far", 0)


def test_empty_and_long(spark):
    links, members = nc.near_copies(frame(spark, []), "url_hash", "page")
    assert links.count() == 0 and members.count() == 0 and nc.groups(links, members).count() == 0
    rng = random.Random(4)
    long = [f"{rng.randrange(10**9)}" for _ in range(120_000)]
    links, _ = nc.near_copies(frame(spark, [("x", " ".join(long)), ("y", " ".join(long[:-500]))]), "url_hash", "page")
    assert linked(links)["x", "y"] == pytest.approx((120_000 - 502) / (120_000 - 2), abs=1e-3)


def test_crowded_shards_are_split_and_keep_their_pairs(monkeypatch):
    """Texts that share a shard's hashes by common boilerplate: work grows with the texts, and near copies still meet."""
    monkeypatch.setattr(nc, "TILE", 50)
    rng = np.random.default_rng(11)
    n = 4000
    marks = rng.integers(0, 2**16, (n, nc.HASHES), dtype=np.uint16)
    for i in range(0, n, 2):  # pairs at a similarity of 0.45
        same = rng.random(nc.HASHES) < 0.45
        marks[i + 1, same] = marks[i, same]
    met = np.zeros(n // 2, bool)
    for shard in rng.integers(0, 2**63, 2).astype(np.uint64):
        keys = nc.finer_keys(np.full(n, shard), marks)
        met |= (keys[0::2] == keys[1::2]).any(axis=1)
        _, sizes = np.unique(keys, return_counts=True)
        assert keys.shape == (n, nc.FINER) and sizes.max() <= 4
    assert met.mean() > 0.99


def test_crowded_shards_end_to_end(spark, monkeypatch):
    pages = versions(5, texts=40, copies=4)
    whole = linked(nc.near_copies(frame(spark, pages), "url_hash", "page")[0])
    monkeypatch.setattr(nc, "TILE", 2)
    got = linked(nc.near_copies(frame(spark, pages), "url_hash", "page")[0])
    assert set(got) <= set(whole) and len(got) >= 0.99 * len(whole)
