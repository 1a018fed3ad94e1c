"""Passages of evaluation items inside a training corpus, by suffix arrays over the shards of the corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.words import MIX, distinct, pieces, plain, scramble, words_of
from skeinwork.operators.joins import HOT_PARTS, small
from skeinwork.session import extent, spread, stage

RUN, SHARE_PERCENT = 10, 30
#: Characters of evaluation text that are sent to every task, at most. More of it is joined with the corpus by its runs of words.
SENT_CHARS = 8_000_000
#: Matches that are held at a time within a task.
HELD = 4_000_000


class TestSet:
    """Words of the evaluation items as numbers from 1; 0 stands for any word that no item has."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        texts = [words_of(t) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        for w in texts:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.sizes = np.array([len(w) for w in texts], np.int64)
        self.words = np.array([self.vocabulary[x] for w in texts for x in w], np.int64)
        self.item = np.repeat(np.arange(len(items)), self.sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes


def _prefix_ranks(words: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions with ``depth`` known words ahead, the ranks of those prefixes, and the key tables of each doubling."""
    rank, have, tables = words.astype(np.int64), 1, []
    while have < depth:
        step = min(have, depth - have)
        at = np.flatnonzero(room >= have + step)
        keys, inverse = np.unique((rank[at] << np.int64(32)) | rank[at + step], return_inverse=True)
        tables.append((step, keys))
        rank = np.zeros(len(words), np.int64)
        rank[at] = inverse + 1
        have += step
    at = np.flatnonzero(room >= depth)
    return at, rank[at], tables


def known_ahead(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, how many words from it on are non-zero and of the same text. ``ends``: the end of its text."""
    n = len(words)
    stop = np.where(words == 0, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1] if n else stop
    return np.minimum(stop, ends) - np.arange(n)


def search_shard(words: np.ndarray, lens: np.ndarray, tests: TestSet, run: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Matches of test suffixes in a shard: arrays of text, item, position in the item and position in the text.

    The shard's suffixes are sorted by their first ``run`` words (suffix array, by prefix doubling); every test suffix is
    then found by binary search, level by level of the doubling, which gives the range of its occurrences.
    """
    ends = np.repeat(np.cumsum(lens), lens)
    at, rank, tables = _prefix_ranks(words, known_ahead(words, ends), run)
    if not len(at):
        return
    order = np.argsort(rank, kind="stable")
    suffixes, rank = at[order], rank[order]

    # the same doubling for the test suffixes, by binary search in the shard's tables; 0 = does not occur
    ask = tests.words.copy()
    item_ends = np.repeat(tests.begin + tests.sizes, tests.sizes)
    room = item_ends - np.arange(len(ask))
    have = 1
    for step, keys in tables:
        q = np.flatnonzero(room >= have + step)
        q = q[(ask[q] > 0) & (ask[q + step] > 0)]
        pair = (ask[q] << np.int64(32)) | ask[q + step]
        k = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        ask_next = np.zeros_like(ask)
        hit = keys[k] == pair
        ask_next[q[hit]] = k[hit] + 1
        ask, have = ask_next, have + step
    q = np.flatnonzero(ask > 0)
    low, high = np.searchsorted(rank, ask[q], "left"), np.searchsorted(rank, ask[q], "right")
    q, low, high = q[high > low], low[high > low], high[high > low]
    # occurrences of one text must stay together: the caller aggregates by text and item
    text_of = np.repeat(np.arange(len(lens)), lens)
    first = np.cumsum(lens) - lens
    count = high - low
    if not len(q):
        return
    total = int(count.sum())
    pieces = max(1, -(-total // HELD))
    bounds = np.unique(np.linspace(0, len(lens), pieces + 1).astype(np.int64))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if pieces == 1:
            o = np.repeat(low - np.cumsum(count) + count, count) + np.arange(total)
            where, test = suffixes[o], np.repeat(q, count)
        else:
            mine = (text_of[suffixes] >= a) & (text_of[suffixes] < b)
            upto = np.append(0, np.cumsum(mine))
            lo, c = upto[low], upto[high] - upto[low]
            o = np.repeat(lo - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
            where, test = suffixes[mine][o], np.repeat(q, c)
        text = text_of[where]
        yield text, tests.item[test], test - tests.begin[tests.item[test]], where - first[text]


def summarize(text: np.ndarray, item: np.ndarray, p: np.ndarray, t: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """Per text and item: words of the item in matched runs, the longest verbatim match in words and where it is in both."""
    # covered words: from each matched start to the next one, `run` words at most
    o = np.lexsort((p, item, text))
    x, y, z = text[o], item[o], p[o]
    new = np.ones(len(o), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    gain = np.full(len(o), run, np.int64)
    gain[:-1] = np.where(new[1:], run, np.minimum(run, z[1:] - z[:-1]))
    head = np.flatnonzero(new)
    covered = np.add.reduceat(gain, head)
    # longest match: consecutive starts along a diagonal
    o2 = np.lexsort((p, t - p, item, text))
    x2, y2, z2, w2 = text[o2], item[o2], p[o2], t[o2]
    brk = np.ones(len(o2), bool)
    brk[1:] = (x2[1:] != x2[:-1]) | (y2[1:] != y2[:-1]) | (z2[1:] != z2[:-1] + 1) | (w2[1:] != w2[:-1] + 1)
    chain = np.flatnonzero(brk)
    size = np.diff(np.append(chain, len(o2))) + run - 1
    o3 = np.lexsort((w2[chain], -size, y2[chain], x2[chain]))
    cx, cy = x2[chain][o3], y2[chain][o3]
    best = np.ones(len(o3), bool)
    best[1:] = (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])
    pick = chain[o3][best]
    return x[head], y[head], covered, size[o3][best], z2[pick], w2[pick]


def leaks(documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, run: int = RUN) -> DataFrame:
    """Documents and the evaluation items of which they contain ``run`` or more consecutive words: one row per pair.

    ``doc_id``, ``item_id``, ``covered_words`` (words of the item that lie in runs of at least ``run`` consecutive words which
    the document has too), ``item_words``, ``share``, and the longest verbatim match: ``match_words``, ``match_in_item`` and
    ``match_in_doc`` (ordinals of its first word). Tags and entities of documents are taken out first.

    Items of up to ``SENT_CHARS`` characters, which are counted first, are sent to all tasks: shards are Arrow batches, or parts of large
    ones, and no shuffle takes place. With more items, both sides are cut to runs of ``run`` words, which meet by a shuffle of
    their hashes, rows of frequent runs apart; whole texts travel only for pairs that share a run. Neither the driver nor any task holds
    all items then. Either way the corpus is read once for all items, and the rows are the same.

    Defined results: null and empty texts match nothing; items with less than ``run`` words match nothing; repeated
    documents and repeated items each give their own rows; an empty table on either side gives no rows.
    """
    fields = [
        T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("item_id", T.LongType()),
        *[T.StructField(n, T.LongType()) for n in ("covered_words", "item_words")], T.StructField("share", T.DoubleType()),
        *[T.StructField(n, T.LongType()) for n in ("match_words", "match_in_item", "match_in_doc")],
    ]
    schema = T.StructType(fields)
    docs = documents.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t")).where("t IS NOT NULL")
    asked = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where(F.length("t") >= 2 * run - 1)
    chars = asked.agg(F.sum(F.length("t"))).first()[0] or 0
    if chars > SENT_CHARS:
        return _by_runs(docs, asked, run, schema)
    tests = TestSet([(r.i, r.t) for r in asked.collect()])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (part for b in batches for part in pieces(b, 1, 10_000)):
            yield from _matches(batch.column(0), batch.column(1).to_pylist(), tests, run, schema)

    return spread(docs).mapInArrow(shard, schema)


def _matches(ids: pa.Array, texts: list[str], tests: TestSet, run: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    number = tests.vocabulary.get
    lens, words = np.zeros(len(texts), np.int64), []
    for k, t in enumerate(texts):
        w = words_of(plain(t))
        lens[k] = len(w)
        words += [number(x, 0) for x in w]
    for found in search_shard(np.array(words, np.int64), lens, tests, run):
        text, item, covered, size, in_item, in_doc = summarize(*found, run)
        total = tests.sizes[item]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), *map(pa.array, (tests.ids[item], covered, total, covered / total, size, in_item, in_doc))], names=schema.names)


def _runs(df: DataFrame, run: int, tags: bool) -> DataFrame:
    """``n``, ``h``: the distinct hashes of all runs of ``run`` words of each row ``n`` (with its text ``t``)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in (part for whole in batches for part in pieces(whole, 1, 2000)):
            rows, out = [], []
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(plain(t) if tags else t)
                if len(w) >= run:
                    for x in set(w):
                        if x not in known:
                            known[x] = xxhash.xxh3_64_intdigest(x)
                    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
                    roll = np.zeros(len(h) - run + 1, np.uint64)
                    for k in range(run):
                        roll = roll * MIX + h[k : k + len(roll)]
                    roll = distinct(scramble(roll))
                    rows.append(np.full(len(roll), n, np.int64))
                    out.append(roll.view(np.int64))
                if len(known) > 2_000_000:
                    known.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(out))], names=["n", "h"])

    return df.mapInArrow(hashes, "n bigint, h bigint")


def _by_runs(docs: DataFrame, items: DataFrame, run: int, schema: T.StructType) -> DataFrame:
    """``leaks`` for items of any number: pairs that share a run, by a shuffle of hashes, then the search within each document."""
    docs = stage(spread(docs).withColumn("n", F.monotonically_increasing_id()), "documents")
    items = stage(items.withColumn("n", F.monotonically_increasing_id()), "items")
    asked = stage(_runs(items.select("n", "t"), run, False), "item-runs")
    # only runs that some item has go on; frequent ones are met apart from the others
    had = stage(_runs(docs.select("n", "t"), run, True).join(small(asked.select("h").distinct(), asked), "h", "left_semi").select("h", F.col("n").alias("d")), "document-runs")
    counts = stage(had.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "runs")
    hot = F.broadcast(counts.where(F.col("c") * HOT_PARTS >= F.lit(extent(had)[0])).select("h"))
    pairs = had.join(hot, "h").join(small(asked.join(hot, "h"), asked), "h").unionByName(had.join(hot, "h", "left_anti").join(asked, "h"))
    pairs = stage(pairs.select("d", "n").distinct(), "pairs")
    both = pairs.join(items.select("n", "i", F.col("t").alias("item")), "n").join(docs.select(F.col("n").alias("d"), F.col("d").alias("doc"), "t"), "d")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, 3, 200)):
            for k, (i, item, t) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                yield from _matches(b.column(0).slice(k, 1), [t], TestSet([(i, item)]), run, schema)

    return both.select("doc", "i", "item", "t").mapInArrow(search, schema)


def without_leaks(documents: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """The documents of which ``found`` names none."""
    gone = found.select(F.col("doc_id").alias(doc_id)).distinct()
    return documents.join(gone, doc_id, "left_anti")
