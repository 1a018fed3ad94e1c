"""Words of texts, in the forms that the operators of this package share."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs of Unicode letters and digits; the text is lower-cased before.
WORD = re.compile(r"[^\W_]+")
#: Runs of a-z and 0-9 of lower-cased text.
ASCII_WORD = re.compile(r"[a-z0-9]+")
TAG = re.compile(r"<!--.*?-->|</?[A-Za-z!?][^>]*>", re.S)
#: What a page shows no text of, and all tags.
PAGE_NOISE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?[A-Za-z!?][^>]*>", re.S | re.I)


def closed(text: str) -> str:
    """Text with a blank for each ``<`` that no ``>`` follows: none of these begins a tag, and no pattern for tags has to search
    the rest of the text for each of them."""
    k = text.rfind(">") + 1
    return text if text.find("<", k) < 0 else text[:k] + text[k:].replace("<", " ")


def pieces(batch: pa.RecordBatch, column: int, rows: int = 2000, size: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows and about ``size`` bytes of text in ``column`` each (one row at least)."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(lens), 0
    while at < len(lens):
        gone = upto[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, gone + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def plain(text: str | None) -> str:
    """Text with tags replaced by blanks and entities decoded."""
    if not text:
        return ""
    if "<" in text:
        text = TAG.sub(" ", closed(text))
    return html.unescape(text) if "&" in text else text


def page_words(page: str) -> list[str]:
    """Words of a page: without comments, script and style elements and tags, entities decoded, lower-cased."""
    text = PAGE_NOISE.sub(" ", closed(page))
    if "&" in text:
        text = html.unescape(text)
    return ASCII_WORD.findall(text.lower())


def hashed(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, comparable within this process only."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values of an integer array."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


MIX = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
