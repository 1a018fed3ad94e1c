import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.llm import distinctive, fusion, leakage, packing, registry, repetition
from skeinwork.llm.words import hashed, plain, words_of
from skeinwork.operators.unpack import buffers

# -- repetition


def covered(words, n):
    """Words inside an n-gram that began at an earlier word."""
    seen, marked = set(), set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            marked.update(range(i, i + n))
        seen.add(g)
    return len(marked)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40), max_size=5))
def test_coverage(docs):
    flat = [w for d in docs for w in d]
    got = repetition.coverage(hashed(flat), np.array([len(d) for d in docs], np.int64), (2, 3, 6))
    ends = np.cumsum([0, *(len(d) for d in docs)])
    for n in (2, 3, 6):
        assert [int(got[n][a:b].sum()) for a, b in zip(ends, ends[1:], strict=False)] == [covered(d, n) for d in docs]


def test_repetition_frame(spark):
    rows = [(1, "one two three four five six. One two three four five six!"), (2, None), (3, ""), (4, "... --"), (5, "Same line here\nother line\nsame line here\n"), (1, "one two three four five six. One two three four five six!"), (None, "x"), (6, "lorem ipsum dolor " * 200_000)]
    df = spark.createDataFrame([(*r, 3, "q") for r in rows], "doc_id long, text string, n_words int, line_share string")
    got = {}
    for r in repetition.repetition(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[1]) == 2 and got[1][0].n_words == 12 and got[1][0].repeated_words_6 == 6 and got[1][0].word_share_6 == 0.5 and got[1][0].char_share_6 == 0.5
    assert all(got[k][0].n_words == 0 and got[k][0].word_share_6 == 0.0 and got[k][0].line_share == 0.0 for k in (2, 3, 4))
    assert got[5][0].line_share == pytest.approx(14 / 38) and got[6][0].word_share_10 > 0.999
    assert repetition.repetition(df.limit(0), "doc_id", "text").count() == 0


# -- leakage


def brute_leaks(docs, items, run):
    out = {}
    for d, text in docs:
        w = words_of(plain(text))
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for k, t in items:
            x = words_of(t)
            marked = set()
            for i in range(len(x) - run + 1):
                if tuple(x[i : i + run]) in grams:
                    marked.update(range(i, i + run))
            if marked:
                out[d, k] = len(marked)
    return out


def longest(a, b):
    best = 0
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = last[j] + 1
                best = max(best, now[j + 1])
        last = now
    return best


@pytest.mark.parametrize("run", [1, 3, 4, 10])
def test_leaks_against_brute_force(spark, run):
    rng = random.Random(run)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "naïve"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(12)]
    docs = []
    for d in range(40):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            x = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(x))
            words[rng.randint(0, len(words)) : 0] = x[a : a + rng.randint(1, 30)]
        docs.append((d, " <b>".join(words) if d % 5 else "&nbsp;\n".join(words)))
    frame = lambda r: spark.createDataFrame(r, "id long, text string")
    got = leakage.leaks(frame(docs), frame(items), "id", "text", "id", "text", run).collect()
    assert {(r.doc_id, r.item_id): r.covered_words for r in got} == brute_leaks(docs, items, run)
    texts, questions = dict(docs), dict(items)
    for r in got:
        a, b = words_of(plain(texts[r.doc_id])), words_of(questions[r.item_id])
        assert r.match_words == longest(a, b)
        assert a[r.match_in_doc : r.match_in_doc + r.match_words] == b[r.match_in_item : r.match_in_item + r.match_words]


def test_leak_edges(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, text), (4, (text + " ") * 5000)], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS item_id", "'z' AS share")
    items = spark.createDataFrame([(7, text), (8, text), (9, "w1 w2"), (10, None)], "item_id long, text string")
    args = ("doc_id", "text", "item_id", "text")
    got = sorted((r.doc_id or 0, r.item_id, r.match_words) for r in leakage.leaks(docs, items, *args).collect())
    assert got == [(0, 7, 30), (0, 8, 30), (1, 7, 30), (1, 7, 30), (1, 8, 30), (1, 8, 30), (4, 7, 30), (4, 8, 30)]
    monkeypatch.setattr(leakage, "SENT_CHARS", 10)
    monkeypatch.setattr(leakage, "HELD", 50)
    assert sorted((r.doc_id or 0, r.item_id, r.match_words) for r in leakage.leaks(docs, items, *args).collect()) == got
    assert leakage.leaks(docs.limit(0), items, *args).count() == 0 and leakage.leaks(docs, items.limit(0), *args).count() == 0
    assert sorted(r.doc_id or 0 for r in leakage.without_leaks(docs, leakage.leaks(docs, items, *args), "doc_id").collect()) == [0, 2, 3]


# -- packing

TOKEN = re.compile(r"[A-Za-z]+|[0-9]{1,3}|[^A-Za-z0-9 \t\r\n]")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ09 \n\t.,-_é漢 😀\x0b"), max_size=30), max_size=6))
def test_token_counts(texts):
    import pyarrow as pa

    assert packing.count_tokens(*buffers(pa.array(texts, pa.string()))).tolist() == [len(TOKEN.findall(t)) for t in texts]


def test_fit():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (20, 60)).astype(float)
    x = np.maximum(rng.normal(size=60), 0)
    got = packing.fit(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6
    b = rng.normal(size=20)
    got = packing.fit(a, b)
    slope = a.T @ (b - a @ got)
    # optimal: no slope along what is used, none upwards along what is not
    assert (got >= 0).all() and slope.max() < 1e-6 and np.abs(slope[got > 0]).max() < 1e-6


def check_packing(rows, lengths, capacities):
    boxes, parts = {}, {}
    for r in rows:
        boxes.setdefault((r.spec_id, r.container), []).append(r)
        parts.setdefault((r.spec_id, r.doc_id), []).append(r)
    for (spec, _), inside in boxes.items():
        assert sum(r.n_tokens for r in inside) <= capacities[spec]
    for spec, c in capacities.items():
        for d, n in lengths.items():
            own = sorted(parts.get((spec, d), []), key=lambda r: r.part)
            assert sum(r.n_tokens for r in own) == max(n or 0, 0)
            assert [r.first_token for r in own] == [i * c for i in range(len(own))] and all(r.n_parts == len(own) for r in own)
            if n and n <= c:
                assert len(own) == 1
    return boxes


@pytest.mark.parametrize("kind", ["long tail", "equal", "short"])
def test_packing(spark, kind):
    rng = np.random.default_rng(2)
    n = 3000
    sizes = {"long tail": np.minimum(rng.lognormal(5.3, 0.8, n), 9000), "equal": np.full(n, 300), "short": rng.integers(1, 40, n)}[kind].astype(int)
    lengths = dict(enumerate(sizes.tolist()))
    capacities = {1: 512, 2: 1000, 3: 4096}
    rows = packing.pack(spark.createDataFrame(list(lengths.items()), "id long, n_tokens long"), capacities).collect()
    boxes = check_packing(rows, lengths, capacities)
    if kind != "equal":
        for spec, c in capacities.items():
            used = sum(1 for s, _ in boxes if s == spec)
            assert sum(sizes) / (used * c) > 0.93


def test_packing_edges(spark):
    lengths = [(1, 0), (2, None), (3, 512), (4, 513), (5, 1024), (6, 1), (6, 1), (None, 2), (7, 1_000_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in lengths], "id long, n_tokens long, copy int, full int")
    rows = packing.pack(df, {1: 512, 2: 1}).collect()
    assert sum(r.n_tokens for r in rows if r.spec_id == 1) == sum(r.n_tokens for r in rows if r.spec_id == 2) == sum(n or 0 for _, n in lengths)
    sums = {}
    for r in rows:
        sums[r.spec_id, r.container] = sums.get((r.spec_id, r.container), 0) + r.n_tokens
    assert all(v <= {1: 512, 2: 1}[s] for (s, _), v in sums.items())
    assert sum(r.doc_id == 6 for r in rows if r.spec_id == 1) == 2 and sum(r.doc_id is None for r in rows if r.spec_id == 1) == 1
    assert {r.n_parts for r in rows if r.spec_id == 1 and r.doc_id == 4} == {2}
    assert packing.pack(df.limit(0), {1: 5}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, {1: 0})


# -- distinctiveness


def brute_scores(rows):
    docs, totals = {}, {}
    for d, t, f in rows:
        docs[d] = docs.get(d, 0) + f
        totals[t] = totals.get(t, 0) + f
    mean, n = sum(docs.values()) / len(docs), len(docs)
    out = {}
    for d, t, f in rows:
        tfn, lam = f * math.log2(1 + mean / docs[d]), totals[t] / n
        out[d, t] = (-math.log2(1 / (1 + lam)) - tfn * math.log2(lam / (1 + lam))) / (tfn + 1)
    return out


def test_divergence(spark):
    rng = random.Random(3)
    rows = [(f"d{d}", f"t{t}", rng.randint(1, 9)) for d in range(30) for t in range(20) if t == 0 or rng.random() < 3 / (t + 3)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "url string, word string, tf long, score int, extra string")
    got = {(r.url, r.word): r.score for r in distinctive.divergence_scores(df, "url", "word", "tf").collect()}
    assert got == pytest.approx(brute_scores(rows))
    top = distinctive.leading_terms(distinctive.divergence_scores(df, "url", "word", "tf"), "url", "word", 2).collect()
    assert all(r.place <= 2 for r in top) and {r.url for r in top} == {r[0] for r in rows}


def test_scores_of_all_terms(spark, tmp_path):
    rows = [(f"http://a.test/{d}", f"w{t:02}", 1 + (d * 7 + t * t) % 9) for d in range(4) for t in range(25) if d == 0 or t % (d + 1)]
    spark.createDataFrame([(w, None, f"{u}@!#{n}") for u, w, n in rows], "word string, priority1 string, priority3 string").write.parquet(f"{tmp_path}/inv_index.parquet")
    spark.createDataFrame([], "url string, title string").write.parquet(f"{tmp_path}/doc_word_count.parquet")
    got = registry.QUERIES["p7_scores"](spark, str(tmp_path)).collect()
    assert {(r.url, r.word): r.score for r in got} == pytest.approx(brute_scores(rows), abs=1e-6) and len(got) == len(rows)
    for url in {r.url for r in got}:
        own = sorted((r for r in got if r.url == url), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and [r.score for r in own] == sorted((r.score for r in own), reverse=True)
    assert {(r.url, r.word) for r in registry.QUERIES["p7_leading"](spark, str(tmp_path)).collect()} == {(r.url, r.word) for r in got if r.place <= registry.TOP_TERMS}


def test_divergence_edges(spark):
    rows = [("a", "x", 2), ("a", None, 1), (None, "x", 1), ("a", "y", None), ("a", "z", 0)]
    df = spark.createDataFrame(rows, "url string, word string, tf long")
    got = distinctive.divergence_scores(df, "url", "word", "tf").collect()
    assert [(r.url, r.word) for r in got] == [("a", "x")] and math.isfinite(got[0].score)
    assert distinctive.divergence_scores(df.limit(0), "url", "word", "tf").count() == 0
    with pytest.raises(ValueError):
        distinctive.divergence_scores(df.withColumnRenamed("tf", "score"), "url", "word", "score")


# -- ranks


def brute_ranking(rows, weights):
    best = {}
    for g, i, *s in rows:
        if g is not None and i is not None and not any(x is None or x != x for x in s):
            old = best.get((g, i))
            best[g, i] = s if old is None else [max(a, b) for a, b in zip(old, s, strict=True)]
    out = {}
    for g in {k[0] for k in best}:
        own = {i: s for (h, i), s in best.items() if h == g}
        ranks = {i: [1 + sum(o[k] > s[k] for o in own.values()) for k in range(len(weights))] for i, s in own.items()}

        def key(i, ranks=ranks):
            pairs, upto = sorted(zip(ranks[i], weights, strict=True)), 0.0
            for r, w in pairs:
                upto += w
                if upto >= sum(weights) / 2:
                    break
            return r, sum(a * w for a, w in zip(ranks[i], weights, strict=True)) / sum(weights), i

        for place, i in enumerate(sorted(own, key=key), 1):
            out[g, i] = (place, *key(i)[:2])
    return out


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 1.0}, {"a": 1.0, "b": 2.5, "c": 0.5}])
def test_aggregate_ranks(spark, weights):
    rng = random.Random(7)
    names = list(weights)
    rows = [("hot" if i % 10 else f"g{i % 70}", f"i{i}", *(float(rng.choice([rng.randint(0, 5), rng.random() * 10**k])) for k, _ in enumerate(names))) for i in range(600)]
    rows += [rows[0], rows[1], ("g0", "i9", *(None for _ in names)), (None, "x", *(1.0 for _ in names)), ("g0", None, *(1.0 for _ in names)), ("g0", "nan", float("nan"), *(1.0 for _ in names[1:]))]
    df = spark.createDataFrame([(*r, 4, "q") for r in rows], "g string, i string, " + ", ".join(f"{n} double" for n in names) + ", position int, __n string")
    got = {(r.g, r.i): (r.position, r.median_rank, pytest.approx(r.mean_rank)) for r in fusion.aggregate_ranks(df, "g", "i", weights).collect()}
    assert got == brute_ranking(rows, list(weights.values()))
    assert fusion.aggregate_ranks(df.limit(0), "g", "i", weights).count() == 0
    with pytest.raises(ValueError):
        fusion.rank_items(df, "g", "i", {})
