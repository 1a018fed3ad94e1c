"""The inverted index: postings of words in three fields of each page."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.functions import html
from skeinwork.functions.text import STOP_WORDS, raw_tokens, stem, stem_udf
from skeinwork.operators.lists import PART, listed
from skeinwork.operators.unpack import POSTING, unpack_values
from skeinwork.session import stage
from skeinwork.sources.tables import normal_word

TITLE, DESCRIPTION, BODY = 1, 2, 3
TOP_TERMS, MINOR, MAJOR = 50, "@!#", "@@!!##"
#: Postings in one stored list, at most.
FRAGMENT = PART


_WORD = re.compile(r"(?<![0-9A-Za-z_])[a-z]{3,}(?![0-9A-Za-z_])")
_COUNTS = T.StructType([T.StructField("url", T.StringType()), T.StructField("field", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("cnt", T.LongType())])


def term_frequencies(pages: DataFrame, stemmed: bool = True, top: int | None = None) -> DataFrame:
    """``url``, ``field``, ``word``, ``cnt``: words of URL and title (1), description (2) and body (3) of each page; with ``top`` of the body
    only that many words with more than one occurrence, most frequent first, ties by word.

    ``pages`` has one row for each URL, so a page's words are counted where the page is: a narrow pass without a shuffle.
    """
    page = F.col("page")
    texts = pages.select("url", F.lower(F.concat_ws(" ", "url", html.title(page))).alias("t1"), F.lower(html.description(page)).alias("t2"), F.lower(html.body_text(page)).alias("t3"))
    stop = frozenset(STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for batch in batches:
            rows, fields, words, counts = [], [], [], []
            for field in (TITLE, DESCRIPTION, BODY):
                for i, text in enumerate(batch.column(field).to_pylist()):
                    found = Counter(_WORD.findall(text)) if text else Counter()
                    if stemmed:
                        whole: Counter[str] = Counter()
                        for w, n in found.items():
                            if w not in stop:
                                if (x := stems.get(w)) is None:
                                    x = stems[w] = stem(w)
                                whole[x] += n
                    else:
                        whole = Counter({w: n for w, n in found.items() if w not in stop})
                    items = whole.items()
                    if top is not None and field == BODY:
                        items = heapq.nsmallest(top, (x for x in items if x[1] > 1), key=lambda x: (-x[1], x[0]))
                    rows += [i] * len(items)
                    fields += [field] * len(items)
                    words += [w for w, _ in items]
                    counts += [n for _, n in items]
            if len(stems) > 1_000_000:
                stems.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(fields, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=_COUNTS.names)

    return texts.mapInArrow(run, _COUNTS)


def postings(pages: DataFrame, stemmed: bool = True, top: int = TOP_TERMS) -> DataFrame:
    """``word``, ``field``, ``url``, ``cnt``: of the body only the ``top`` words of a page with more than one occurrence."""
    return term_frequencies(pages, stemmed, top).select("word", "field", "url", "cnt")


def packed_index(rows: DataFrame, min_postings: int = 1, fragment: int = FRAGMENT) -> DataFrame:
    """``word``, ``field``, ``part``, ``n``, ``list``: posting lists in their stored form, urls ascending, in parts of ``fragment`` postings.

    For export only: searches work on the rows. Parts are of bounded size however frequent a word is, and only the postings of
    words with more than one part are numbered. ``min_postings`` leaves out words that have fewer postings over all fields.
    """
    if min_postings > 1:
        enough = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_postings).select("word")
        rows = rows.join(enough, "word", "left_semi")
    # without the table, pages would be read and counted twice
    rows = stage(rows.select("word", "field", "url", F.concat("url", F.lit(MINOR), F.col("cnt").cast("string")).alias("e")), "postings")
    return listed(rows, ["word", "field"], ["url"], "e", fragment).withColumn("list", F.array_join("list", MAJOR))


def stored_postings(index: DataFrame, words: Sequence[str] | None = None, fields: tuple[int, ...] = (TITLE, DESCRIPTION, BODY)) -> DataFrame:
    """The postings of a stored index of fragments: ``word``, ``field``, ``url``, ``cnt``; with ``words`` those of these words only, and no
    other fragment is unpacked.

    Words are compared in their normal form; what was flushed twice counts once, at its largest count.
    """
    parts = None
    for f in fields:
        rows = index.select(normal_word("word").alias("word"), f"priority{f}").where("word IS NOT NULL")
        if words is not None:
            rows = rows.where(F.col("word").isin(*sorted(set(words))) if words else F.lit(False))
        part = unpack_values(rows, f"priority{f}", ["word"], POSTING).where("count IS NOT NULL").select("word", F.lit(f).alias("field"), "url", F.col("count").alias("cnt"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("word", "field", "url").agg(F.max("cnt").alias("cnt"))


def save_postings(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes postings in the order of words, so that a search reads only the row groups of its terms.

    Ranges are of word and URL: a frequent word spans several files instead of making one large one.
    """
    rows.repartitionByRange("word", "url").sortWithinPartitions("word", "field", "url").write.mode(mode).parquet(path)


def positions(pages: DataFrame, stemmed: bool = True) -> DataFrame:
    """``word``, ``url``, ``places``: ordinals from 1 of every word in the text of a page, also under its stem if that differs."""
    words = pages.select("url", F.posexplode(raw_tokens(html.body_text(F.col("page")))).alias("i", "word")).select("url", "word", (F.col("i") + 1).alias("place"))
    if stemmed:
        stems = words.withColumn("stem", stem_udf("word"))
        words = words.unionByName(stems.where("stem <> word").select("url", F.col("stem").alias("word"), "place"))
    return words.groupBy("word", "url").agg(F.array_sort(F.collect_list("place")).alias("places"))


def positional_lists(places: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """``word``, ``part``, ``list``: ``url:1 5 9`` entries by number of places, most first, then by url, in parts of ``fragment`` entries."""
    entry = F.concat("url", F.lit(":"), F.array_join(F.transform("places", lambda p: p.cast("string")), " "))
    rows = stage(places.select("word", "url", (-F.size("places")).alias("n"), entry.alias("e")), "places")
    return listed(rows, ["word"], ["n", "url"], "e", fragment).select("word", "part", F.array_join("list", ",").alias("list"))
