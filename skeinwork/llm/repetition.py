"""The share of repeated content within each document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skeinwork.llm.words import MIX, hashed, pieces, scramble, words_of
from skeinwork.session import spread

LENGTHS = (3, 6, 10)


def _repeats(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of positions ``at`` (ascending) with ``keys``: those whose key came earlier, and all whose key occurs again."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    later = np.zeros(len(k), bool)
    later[1:] = same
    twice = later.copy()
    twice[:-1] |= same
    return np.sort(at[order[later]]), np.sort(at[order[twice]])


def coverage(hashes: np.ndarray, lens: np.ndarray, lengths: Sequence[int]) -> dict[int, np.ndarray]:
    """For each n a mask of the words that lie in an n-gram which began at an earlier word of the same document.

    ``hashes``: word hashes of many documents, one after the other; ``lens``: words of each. Rolling hashes are
    extended from length to length, and only positions whose shorter n-gram occurs twice are looked at again.
    """
    total = len(hashes)
    doc = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(total)
    salt = scramble(doc * MIX + np.uint64(1))
    at, roll, have, out = np.arange(total), np.zeros(total, np.uint64), 0, {}
    for n in sorted(lengths):
        fits = left[at] >= n
        at, roll = at[fits], roll[fits]
        for k in range(have, n):
            roll = roll * MIX + scramble(hashes[at + k])
        have = n
        later, twice = _repeats(scramble(roll) ^ salt[at], at)
        steps = np.zeros(total + 1, np.int32)
        np.add.at(steps, later, 1)
        np.add.at(steps, later + n, -1)
        out[n] = np.cumsum(steps[:-1]) > 0
        keep = np.isin(at, twice, assume_unique=True)
        at, roll = at[keep], roll[keep]
    return out


def _line_shares(text: str | None) -> tuple[int, int]:
    """Characters of all non-blank lines, and of lines that stood earlier in the text."""
    seen: set[str] = set()
    total = again = 0
    for line in (text or "").splitlines():
        if line := line.strip().lower():
            total += len(line)
            if line in seen:
                again += len(line)
            seen.add(line)
    return total, again


def repetition(df: DataFrame, id_column: str, text_column: str, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """One row per document: how much of it repeats itself.

    ``n_words``; for each n of ``lengths`` ``repeated_words_n`` (words inside an n-gram that began at an earlier word of the
    document too), ``word_share_n`` and ``char_share_n`` (the same in characters of words); ``line_share``: characters in
    lines that stood earlier, by those in all non-blank lines. Words are runs of letters and digits, lower-cased. Whole
    texts are measured in one narrow pass without a shuffle.

    Defined results: null, empty and wordless texts have 0 words and shares of 0.0; repeated rows give repeated rows; a
    null id stays null; other columns are ignored, whatever their names.
    """
    lengths = sorted(set(lengths))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    fields = [df.schema[id_column], T.StructField("n_words", T.LongType())]
    for n in lengths:
        fields += [T.StructField(f"repeated_words_{n}", T.LongType()), T.StructField(f"word_share_{n}", T.DoubleType()), T.StructField(f"char_share_{n}", T.DoubleType())]
    fields.append(T.StructField("line_share", T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (part for b in batches for part in pieces(b, 1)):
            texts = batch.column(1).to_pylist()
            lens, words = np.zeros(len(texts), np.int64), []
            for i, t in enumerate(texts):
                w = words_of(t)
                lens[i] = len(w)
                words += w
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            masks = coverage(hashed(words), lens, lengths)
            doc = np.repeat(np.arange(len(texts)), lens)
            per_doc = lambda x: np.bincount(doc, x, len(texts))
            chars = np.maximum(per_doc(sizes), 1)
            cols = [batch.column(0), pa.array(lens)]
            for n in lengths:
                covered = per_doc(masks[n])
                cols += [pa.array(covered.astype(np.int64)), pa.array(covered / np.maximum(lens, 1)), pa.array(per_doc(masks[n] * sizes) / chars)]
            lines = np.array([_line_shares(t) for t in texts], np.float64).reshape(-1, 2)
            cols.append(pa.array(lines[:, 1] / np.maximum(lines[:, 0], 1)))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return spread(df.select(df[id_column], df[text_column])).mapInArrow(run, T.StructType(fields))
