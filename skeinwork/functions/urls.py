"""URLs: parts, resolution, normal form, hashes; and robots rules."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# scheme, user info with its @, host, port with its colon, path, query with its ?, fragment
PARTS = r"^((?i:https?))://([^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
MEDIA = r"(?i)\.(jpg|jpeg|gif|png|txt)$"
ORIGIN = r"^((?i:https?)://[^/?#]*)"
PATH = r"^(?i:https?)://[^/?#]*([^?#]*)"
HOST = r"(?>\[[^\]]*\]|[^/?#:]*)"
USABLE = r"^(?i:https?)://(?:[^/?#@]*@)?+[^/?#:]"
# a URL whose host has no port behind it, or an empty one; a URL that has no path
NO_PORT = rf"^((?i:{{}})://(?:[^/?#@]*@)?+{HOST}):?+(?![0-9])"
NO_PATH = r"^([^/?]*//[^/?]*)(?=\?|$)"


def normal_url(url: Column) -> Column:
    """The form in which a URL is crawled: with its port, ``/`` for an empty path, without fragment, query kept.

    Null for other schemes than http and https, and for pictures and plain text by the ending of the path. Each step is one match
    over the URL, so that an expression of it stays small wherever it is used.
    """
    bare = F.substring_index(url, "#", 1)
    ported = F.regexp_replace(bare, NO_PORT.format("http"), "$1:80")
    ported = F.regexp_replace(ported, NO_PORT.format("https"), "$1:443")
    return F.when(bare.rlike(USABLE) & ~F.substring_index(bare, "?", 1).rlike(MEDIA), F.regexp_replace(ported, NO_PATH, "$1/"))


def _without_dots(url: Column) -> Column:
    """A URL without ``.`` and ``..`` steps in its path, however many; steps above the root are dropped."""
    origin, path = F.regexp_extract(url, ORIGIN, 1), F.regexp_extract(url, PATH, 1)
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    folded = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.array_append(kept, s)),
    )
    # a dot at the end names a folder
    folded = F.concat(folded, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    return F.concat(origin, F.lit("/"), F.array_join(folded, "/"), F.substring(url, 1 + F.length(origin) + F.length(path), F.length(url)))


def resolve(base: Column, href: Column) -> Column:
    """``href`` as seen from the page ``base``; null for targets such as ``mailto:``."""
    scheme = F.substring_index(base, "//", 1)
    origin = F.regexp_extract(base, ORIGIN, 1)
    folder = F.regexp_extract(base, r"^((?i:https?)://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    bare = F.regexp_replace(base, r"[?#].*$", "")
    href = F.trim(href)
    full = (
        F.when(href.rlike(r"^(?i:https?)://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(folder, href))
    )
    return F.when(F.substring_index(full, "?", 1).contains("/."), _without_dots(full)).otherwise(full)


def split_url(url: Column) -> Column:
    """Struct of protocol, host, port and path; absent parts are null, an absent path of an absolute URL is ``/``."""
    absolute = url.rlike(r"^[^/]+://") | url.rlike(r"^[^/]*//")
    authority = F.regexp_extract(url, r"^[^/]*//([^/]*)", 1)
    rest = F.regexp_extract(url, r"^[^/]*//[^/]*(/.*)$", 1)
    port = F.regexp_extract(authority, r"^[^:]+:(.*)$", 1)
    return F.struct(
        F.when(absolute, F.regexp_extract(url, r"^([^/:]*):?//", 1)).alias("protocol"),
        F.when(absolute, F.regexp_replace(authority, r"^([^:]+):.*$", "$1")).alias("host"),
        F.when(absolute & authority.rlike(r"^[^:]+:"), port).alias("port"),
        F.when(absolute, F.when(rest == "", "/").otherwise(rest)).otherwise(url).alias("path"),
    )


def url_key(url: Column) -> Column:
    """The row key of a URL."""
    return F.sha1(url)


def letter_hash(digest: Column) -> Column:
    """A hexadecimal digest in the two-letter code of stored tables: a byte b as letters of (b - 1) mod 256.

    The bytes 0x7f and 0x80 share one code there; it is only of use for reading existing keys.
    """

    @F.pandas_udf(T.StringType())
    def encode(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            return "".join(chr(97 + n % 26) + chr(97 + 2 * (n // 26)) for n in ((b if b < 128 else b - 1) if b else 255 for b in bytes.fromhex(text)))

        return values.map(one, na_action="ignore")

    return encode(digest)


def decoded(text: Column) -> Column:
    """Percent-decoded text; null for null and for text that is not properly encoded."""
    return F.try_url_decode(text)


def random_id() -> Column:
    """A random key that begins with a letter."""
    return F.concat(F.lit("k"), F.uuid())


@F.pandas_udf(T.StringType())
def body_of(data: pd.Series) -> pd.Series:
    """The text of response bodies (binary), unpacked where they are gzip; bytes that are not UTF-8 are replaced."""

    def one(raw: bytes) -> str:
        if raw[:2] == b"\x1f\x8b":
            try:
                raw = gzip.decompress(raw)
            except (OSError, EOFError, zlib.error):
                pass
        return bytes(raw).decode("utf-8", "replace")

    return data.map(one, na_action="ignore")


DEFAULT_DELAY_MS, BLOCKED = 400, None


def robots_delay(text: str | None, path: str | None, strict: bool = False) -> int | None:
    """Milliseconds to wait between fetches of a path, or None where the rules of agent ``*`` forbid it.

    The longest matching rule holds, Allow before Disallow at equal length. An empty Disallow allows all; with ``strict`` it
    forbids all, as simple prefix matching has it.
    """
    delay, path = DEFAULT_DELAY_MS, path or "/"
    if not text:
        return delay
    mine, allow, deny = False, -1, -1
    for line in text.splitlines():
        name, colon, value = line.partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            mine = value == "*"
        elif mine and name in ("allow", "disallow") and path.startswith(value) and (value or strict):
            if name == "allow":
                allow = max(allow, len(value))
            else:
                deny = max(deny, len(value))
        elif mine and name == "crawl-delay":
            try:
                delay = int(float(value) * 1000)
            except ValueError:
                pass
    return BLOCKED if deny > allow else delay


@F.pandas_udf(T.LongType())
def robots_delay_udf(robots: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([robots_delay(r, p) for r, p in zip(robots, path, strict=True)], dtype="Int64")


def common_prefix(a: Column, b: Column) -> Column:
    """The number of characters at which two texts begin alike; 0 if either is null."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.coalesce(F.when(n > 0, F.size(same)), F.lit(0))


def overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """The intersection of two half-open ranges as a struct; a null bound is open. Null if they do not meet."""
    low, high = F.greatest(a_from, b_from), F.least(a_to, b_to)
    return F.when(low.isNull() | high.isNull() | (low < high), F.struct(low.alias("from"), high.alias("to")))
