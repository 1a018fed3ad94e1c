"""Pages of keyword strings and link lists, by the mutual information of neighbouring words.

Over the whole corpus it is counted how often words stand next to one another in the own content of pages. In sentences most
neighbours are pairs that many pages have, more often than chance; in strings of keywords, tag lists and rows of bare links
hardly any are, however often a page repeats its own collocations.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm import bodies
from skeinwork.llm.pagetree import FIGURES, HEADINGS, SHORT_FORMS, Page, article_segments, line_shape
from skeinwork.llm.words import MIX, WORD, distinct, pieces, scramble
from skeinwork.operators.joins import join_key_stats, small
from skeinwork.session import extent, spread, stage

#: Share of pages (and least number of them) that make a pair of words a common one.
SUPPORT, LEAST_PAGES = 0.002, 3
#: Common pairs that are sent to every task, at most. With more of them each page is joined with its own.
SENT_PAIRS = 2_000_000
#: Repeats of a pair within a page, and times its usual rate, beyond which it is an excessive collocation.
REPEATS, EXCESS = 4, 8.0
#: Contents that share one of MARKS keys, each of MARK_HASHES minimum hashes of their word pairs, are near copies.
MARKS, MARK_HASHES = 8, 3
#: Segments with fewer words are judged together with the like ones next to them.
SHORT = 8
#: Mean score of neighbours below which words are no sentences.
COHERENT = -0.55
#: Share of such words that makes a page a case.
SPAM_SHARE = 0.5
PLAIN, HEADING, ITEM, CELL = 0, 1, 2, 3
DIGITS = re.compile(r"[0-9]+")


def content_lines(source: str) -> list[tuple[list[str], int, int, int]]:
    """Words, kind, shape (0: none) and a hash of the line before of every segment of a page's own content, hidden text included."""
    page = Page(source, False)
    out = []
    for i in article_segments(page, heard=True):
        s = page.segments[i]
        tag = page.tags[s.node]
        text = s.text.lower()
        words = WORD.findall(text if FIGURES.isdisjoint(text) else DIGITS.sub("0", text))
        if words:
            shape = None if tag in SHORT_FORMS else line_shape(s.text)
            before = xxhash.xxh3_64_intdigest(page.segments[i - 1].text) - 2**63 if i else 0
            out.append((words, HEADING if tag in HEADINGS else ITEM if tag in ("li", "dd", "dt") else CELL if tag in ("td", "th") else PLAIN, shape or 0, before))
    return out


_MUL = scramble(np.arange(1, MARKS * MARK_HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def content_marks(words: np.ndarray, key: int) -> np.ndarray:
    """``MARKS`` keys of a content: two contents of which a share s of the word pairs is common have each of them in common with a
    chance of s ** MARK_HASHES. A content without pairs has its own ``key`` in all of them."""
    pairs = distinct((words[:-1].astype(np.uint64) << np.uint64(32)) | words[1:].astype(np.uint64))
    if not len(pairs):
        return np.full(MARKS, key, np.int64)
    x = scramble(pairs)
    low = np.full(len(_MUL), 2**64 - 1, np.uint64)
    for i in range(0, len(x), 4096):
        low = np.minimum(low, scramble(x[i : i + 4096, None] * _MUL).min(axis=0))
    out = np.zeros(MARKS, np.uint64)
    for heads in low.reshape(MARKS, MARK_HASHES).T:
        out = scramble(out * MIX + heads)
    return out.view(np.int64)


_MARKS = [f"m{i}" for i in range(MARKS)]
_CONTENT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("k", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("kinds", T.BinaryType()),
    T.StructField("shapes", T.BinaryType()), T.StructField("befores", T.BinaryType()), *(T.StructField(m, T.LongType()) for m in _MARKS),
])


def _contents(df: DataFrame, id_column: str, page_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for batch in pieces(whole, 1, 1000):
                words, sizes, kinds, shapes, befores, keys, marks = [], [], [], [], [], [], []
                for p in batch.column(1).to_pylist():
                    parts = content_lines(p)
                    flat = [w for ws, *_ in parts for w in ws]
                    for w in set(flat):
                        if w not in known:
                            known[w] = xxhash.xxh32_intdigest(w)
                    hashes = np.fromiter(map(known.__getitem__, flat), np.uint32, len(flat))
                    words.append(hashes.tobytes())
                    sizes.append(np.array([len(ws) for ws, *_ in parts], np.uint32).tobytes())
                    kinds.append(bytes(k for _, k, _, _ in parts))
                    shapes.append(np.array([x for _, _, x, _ in parts], np.int64).tobytes())
                    befores.append(np.array([x for *_, x in parts], np.int64).tobytes())
                    keys.append(xxhash.xxh3_64_intdigest(words[-1]) - 2**63)
                    marks.append(content_marks(hashes, keys[-1]))
                    if len(known) > 2_000_000:
                        known.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), *(pa.array(x, pa.binary()) for x in (words, sizes, kinds, shapes, befores)), *map(pa.array, np.array(marks).T.copy())], names=_CONTENT.names)

    rows = df.where(df[page_column].isNotNull() & df[id_column].isNotNull()).select(df[id_column].cast("string"), df[page_column])
    return spread(rows).mapInArrow(run, _CONTENT)


@dataclass
class Content:
    """Pages of a batch, one after the other: word hashes, the page and the run of each word. A run is a segment, or short
    segments of one kind next to each other."""

    words: np.ndarray
    page: np.ndarray
    run: np.ndarray
    kind: np.ndarray
    pages: int


_PARTS = ["words", "sizes", "kinds", "shapes"]


def unpack(parts: pa.RecordBatch, recurring: np.ndarray) -> Content:
    """The pages of a batch of ``_PARTS``, without the segments whose shape is one of ``recurring``."""
    words, sizes, kinds, shapes = (c.to_pylist() for c in parts.columns)
    w = np.frombuffer(b"".join(words), np.uint32)
    n = np.frombuffer(b"".join(sizes), np.uint32).astype(np.int64)
    k = np.frombuffer(b"".join(kinds), np.uint8)
    page = np.repeat(np.arange(len(kinds)), [len(x) for x in kinds])
    keep = ~np.isin(np.frombuffer(b"".join(shapes), np.int64), recurring)
    w, n, k, page = w[np.repeat(keep, n)], n[keep], k[keep], page[keep]
    new = np.ones(len(n), bool)
    new[1:] = (page[1:] != page[:-1]) | (k[1:] != k[:-1]) | (n[1:] >= SHORT) | (n[:-1] >= SHORT) | (k[1:] == HEADING)
    return Content(w, np.repeat(page, n), np.repeat(np.cumsum(new) - 1, n), np.repeat(k, n), len(kinds))


def _contexts(contents: DataFrame) -> DataFrame:
    """Contexts of the lines of contents, as ``bodies.often`` takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            both = np.stack([np.frombuffer(b"".join(c.to_pylist()), np.int64) for c in b.columns], axis=1)
            both = np.unique(both[both[:, 0] != 0], axis=0)
            none = np.arange(len(both) + 1) == len(both)
            shape, before = (pa.array(np.append(x, 0), mask=none) for x in both.T)
            yield pa.RecordBatch.from_arrays([shape, before, pa.array(np.where(none, b.num_rows, 0))], names=["shape", "before", "pages"])

    return contents.select("shapes", "befores").mapInArrow(run, "shape bigint, before bigint, pages bigint")


def pairs_of(c: Content) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words with a right neighbour in the same run, and those pairs: the left word's hash above the right one's."""
    at = np.flatnonzero(c.run[1:] == c.run[:-1])
    return at, (c.words[at].astype(np.uint64) << np.uint64(32)) | c.words[at + 1].astype(np.uint64)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    x = np.sort(x)
    head = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[head], np.diff(np.append(head, len(x)))


def _once_a_page(page: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Positions of the first of equal pairs of a page, in the order of pages and pairs."""
    order = np.lexsort((pair, page))
    p, x = page[order], pair[order]
    return order[np.append(True, (p[1:] != p[:-1]) | (x[1:] != x[:-1]))] if len(order) else order


def one_of_each(rows: DataFrame) -> DataFrame:
    """``rows`` with one content of each group of copies and near copies.

    Mark by mark, of those left that share it one stays, the one with the least ``k`` (the same contents share all marks). Only keys move.
    """
    left = rows.select("k", "r", *_MARKS)
    for key in _MARKS:
        left = left.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct("k", "r", *_MARKS)).alias("m")).select("m.*")
    copies = stage(rows.select("r").join(left.select("r"), "r", "left_anti"), "copies")
    return rows.join(small(copies), "r", "left_anti")


def corpus_counts(contents: DataFrame, recurring: Broadcast) -> DataFrame:
    """``pair`` (null for words), ``word`` (null for pairs), ``n`` occurrences and ``pages`` that have the pair, of every word and every
    pair of neighbours: exact counts, combined within batches and tasks before they are shuffled. A row without either has the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, 0, 10_000, 32_000_000):
                c = unpack(b, recurring.value)
                words, times = _counted(c.words)
                at, pair = pairs_of(c)
                pairs, n = _counted(pair)
                _, pages = _counted(pair[_once_a_page(c.page[at], pair)])
                is_word = np.arange(len(words) + len(pairs) + 1) < len(words)
                last = np.arange(len(is_word)) == len(is_word) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([words.astype(np.int64), pairs.view(np.int64), [0]]), mask=is_word | last),
                        pa.array(np.concatenate([words.astype(np.int64), pairs.view(np.int64), [0]]), mask=~is_word),
                        pa.array(np.concatenate([times, n, [c.pages]])), pa.array(np.concatenate([np.zeros(len(words), np.int64), pages, [c.pages]])),
                    ],
                    names=["pair", "word", "n", "pages"],
                )

    rows = contents.select(*_PARTS).mapInArrow(run, "pair bigint, word bigint, n bigint, pages bigint")
    return rows.groupBy("pair", "word").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))


def common_pairs(contents: DataFrame, recurring: Broadcast) -> DataFrame:
    """``pair``, ``score`` (normalised mutual information, from -1 to 1) and ``p`` (share of all pairs) of the pairs that at least
    ``SUPPORT`` of the pages have, and ``LEAST_PAGES`` of them.

    However large the corpus and its vocabulary, there are at most (mean number of distinct pairs of a page) / ``SUPPORT`` of them.
    """
    counts = stage(corpus_counts(contents, recurring), "counts")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    pairs, words, n = counts.agg(of(F.col("pair").isNotNull()), of(F.col("word").isNotNull()), of(F.coalesce("pair", "word").isNull())).first()
    found = stage(counts.where(F.col("pair").isNotNull() & (F.col("pages") >= max(LEAST_PAGES, SUPPORT * n))).select("pair", "n"), "common")
    sides = found.select("pair", "n", F.posexplode(F.array(F.shiftrightunsigned("pair", 32), F.col("pair").bitwiseAND(F.lit(2**32 - 1)))).alias("side", "word"))
    shared = counts.where("word IS NOT NULL").select("word", (F.col("n") / F.lit(float(words or 1))).alias("q")).join(small(sides, found), "word")
    q = F.max(F.when(F.col("side") == 0, F.col("q"))) * F.max(F.when(F.col("side") == 1, F.col("q")))
    out = shared.groupBy("pair").agg((F.first("n") / F.lit(float(pairs or 1))).alias("p"), q.alias("q"))
    # where all pairs of the corpus are the same one, p is 1
    score = F.when(F.col("p") >= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log(F.col("p") / F.col("q")) / -F.log("p"))))
    return stage(out.select("pair", score.alias("score"), "p"), "common-pairs")


@dataclass
class Common:
    """Common pairs, ascending, with their score and share."""

    pairs: np.ndarray
    score: np.ndarray
    p: np.ndarray


def as_common(pairs: np.ndarray, score: np.ndarray, p: np.ndarray) -> Common:
    pairs, first = np.unique(pairs.astype(np.int64).view(np.uint64), return_index=True)
    return Common(pairs, score[first], p[first])


def pair_scores(c: Content, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words with a right neighbour, and the normalised mutual information of each such pair: from -1 to 1; -1
    for pairs that few pages have, and for those that their page repeats excessively."""
    at, pair = pairs_of(c)
    score, p = np.full(len(pair), -1.0), np.zeros(len(pair))
    if len(common.pairs):
        k = np.minimum(np.searchsorted(common.pairs, pair), len(common.pairs) - 1)
        hit = common.pairs[k] == pair
        score[hit], p[hit] = common.score[k[hit]], common.p[k[hit]]
    # repeats within the page
    page = c.page[at]
    order = np.lexsort((pair, page))
    head = np.append(True, (page[order][1:] != page[order][:-1]) | (pair[order][1:] != pair[order][:-1])) if len(at) else np.empty(0, bool)
    group = np.cumsum(head) - 1
    times = np.empty(len(at), np.int64)
    times[order] = np.bincount(group)[group] if len(at) else 0
    per_page = np.bincount(page, minlength=c.pages)[page]
    score[(times >= REPEATS) & (times > EXCESS * p * per_page)] = -1
    return at, score


def page_scores(c: Content, common: Common) -> dict[str, np.ndarray]:
    """Per page: words, words outside of sentences, mean score of neighbours, share of excessive or rare pairs."""
    at, score = pair_scores(c, common)
    runs = int(c.run[-1]) + 1 if len(c.run) else 0
    n_pairs, sums = np.bincount(c.run[at], minlength=runs), np.bincount(c.run[at], score, minlength=runs)
    n_words = np.bincount(c.run, minlength=runs)
    kind, page = np.zeros(runs, np.uint8), np.zeros(runs, np.int64)
    kind[c.run], page[c.run] = c.kind, c.page
    mean = sums / np.maximum(n_pairs, 1)
    loose = (kind != HEADING) & (n_pairs > 0) & (mean < COHERENT)
    per_page = lambda x: np.bincount(page, x, minlength=c.pages)
    pairs = per_page(n_pairs)
    return {"n_words": per_page(n_words).astype(np.int64), "loose_words": per_page(n_words * loose).astype(np.int64), "mean_pmi": per_page(sums) / np.maximum(pairs, 1)}


_SCORES = "id string, n_words bigint, loose_words bigint, mean_pmi double"


def _scored(rows: DataFrame, common: DataFrame, recurring: Broadcast) -> DataFrame:
    """The scores of all contents ``rows``. The common pairs are sent to all tasks if they were counted to be ``SENT_PAIRS`` at most;
    else each content is joined with its own."""

    def scored(b: pa.RecordBatch, known: Common) -> pa.RecordBatch:
        got = page_scores(unpack(b.select(_PARTS), recurring.value), known)
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in got.values())], names=["id", *got])

    if extent(common)[0] <= SENT_PAIRS:
        t = common.toArrow()
        sent = rows.sparkSession.sparkContext.broadcast(as_common(*(t.column(i).to_numpy() for i in range(3))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for whole in batches:
                for b in pieces(whole, 1, 10_000, 32_000_000):
                    yield scored(b, sent.value)

        return rows.select("id", *_PARTS).mapInArrow(run, _SCORES)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, 1, 10_000, 32_000_000):
                c = unpack(b.select(_PARTS), recurring.value)
                at, pair = pairs_of(c)
                once = _once_a_page(c.page[at], pair)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c.page[at][once])), pa.array(pair[once].view(np.int64))], names=["r", "pair"])

    own = stage(rows.select("r", *_PARTS).mapInArrow(pairs, "r bigint, pair bigint").join(common.select("pair"), "pair", "left_semi"), "own-pairs")
    stats = stage(own.groupBy("pair").agg(F.count(F.lit(1)).alias("__n")).join(common, "pair"), "pair-rows")
    total = stats.agg(F.sum("__n")).first()[0] or 0
    lists = join_key_stats(own, stats, ["pair"], "__n", total).groupBy("r").agg(*[F.collect_list(c).alias(f"__{c}") for c in ("pair", "score", "p")])
    joined = rows.select("r", "id", *_PARTS).join(lists, "r", "left").drop("r")

    def with_own(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, 1, 1000, 8_000_000):
                yield scored(b, as_common(*(b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (5, 6, 7))))

    return joined.mapInArrow(with_own, _SCORES)


def incoherence(df: DataFrame, id_column: str, page_column: str) -> DataFrame:
    """One row per page: ``id``, ``n_words`` of its own content, ``loose_words`` (words in runs whose neighbours are, on the mean,
    below ``COHERENT``: keyword strings, tag lists, bare links), ``loose_share`` and ``mean_pmi``.

    Own content is the main body of the page, hidden text included, without menus, notices and the like (lines that recur behind many
    different lines, ``bodies.recurring_lines``); headings count
    as words, never as loose ones. Pages are parsed once and all get a row; the counts are exact, and take one content of each group of
    copies and near copies, so that however often a page is mirrored its pairs don't support themselves.

    Defined results: rows with a null id or page are left out; repeated records are one; an id with several pages gets the
    row with the largest share; pages without content have 0 words and a share of 0.0; an empty table gives no rows.
    """
    rows = stage(_contents(df, id_column, page_column).withColumn("r", F.monotonically_increasing_id()), "contents")
    recurring = df.sparkSession.sparkContext.broadcast(np.array(bodies.shapes_of(bodies.often(_contexts(rows))), np.int64))
    out = _scored(rows, common_pairs(one_of_each(rows), recurring), recurring)
    share = F.col("loose_words") / F.greatest("n_words", F.lit(1))
    out = out.withColumn("loose_share", share)
    return out.groupBy("id").agg(F.max(F.struct("loose_share", "n_words", "loose_words", "mean_pmi")).alias("m")).select("id", "m.n_words", "m.loose_words", "m.loose_share", "m.mean_pmi")
