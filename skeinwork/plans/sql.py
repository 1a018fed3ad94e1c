"""Pieces of SQL that several queries' SQL forms share."""

from __future__ import annotations

STARTS = r"""(?:^|["'']?(?:@@!!##|@!#|[\s|;,])+)["'']?(https?://)"""
TAIL = r"""["'']?(?:@@!!##|@!#|[\s|;,])*$"""
POSTING = r"""^(https?://.*?)["'']?\s*(?:@!#|[,|:=]|\s)\s*([0-9]+)["'']?$"""
#: White space around a text, as a pattern.
AROUND = r"^\s+|\s+$"


def values(column: str) -> str:
    """The list of values packed in a column."""
    cut = f"string_split(regexp_replace({column}, '{STARTS}', chr(1) || '\\1', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: regexp_replace(x, '{TAIL}', '')), lambda x: starts_with(x, 'http'))"


def normal_word(column: str = "word") -> str:
    return f"nullif(lower(regexp_replace({column}, '{AROUND}', '', 'g')), '')"


def postings(field: int) -> str:
    """SELECT of word, field, url, cnt of one field, a row for each posting; cnt is null where there is none."""
    return f"""SELECT word, {field} AS field, coalesce(nullif(regexp_extract(item, '{POSTING}', 1), ''), item) AS url,
        TRY_CAST(nullif(regexp_extract(item, '{POSTING}', 2), '') AS BIGINT) AS cnt
        FROM (SELECT {normal_word()} AS word, unnest({values(f"priority{field}")}) AS item FROM inv_index WHERE priority{field} IS NOT NULL)"""


def stored_postings(fields: tuple[int, ...] = (1, 2, 3)) -> str:
    """SELECT of word, field, url, cnt: what was flushed twice counts once."""
    parts = " UNION ALL ".join(postings(f) for f in fields)
    return f"SELECT word, field, url, max(cnt) AS cnt FROM ({parts}) WHERE word IS NOT NULL AND cnt IS NOT NULL GROUP BY ALL"


SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
UNSEEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>"


def decode(text: str) -> str:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''")):
        text = f"replace({text}, '{name}', '{char}')"
    # no look-ahead here: ampersands are kept apart first
    text = f"replace({text}, '&amp;', chr(2))"
    return f"replace(regexp_replace({text}, '(?i)&(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);', ' ', 'g'), chr(2), '&')"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def title(page: str = "page") -> str:
    return f"nullif({squeeze(decode(f"regexp_extract({page}, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '')"


def body_text(page: str = "page") -> str:
    return squeeze(decode(f"regexp_replace(regexp_replace({page}, '{UNSEEN}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"))


def tokens(text: str) -> str:
    from skeinwork.functions.text import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(string_split_regex(lower({text}), '\\W+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({stop}))"


PAGES = "SELECT url, max_by(page, struct_pack(a := crawled_at, b := page)) AS page FROM crawl WHERE page IS NOT NULL AND url IS NOT NULL GROUP BY url"
PARTS = r"^((?i:https?))://([^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def normal_url(url: str) -> str:
    part = lambda n: f"regexp_extract({url}, '{PARTS}', {n})"
    port = f"CASE WHEN {part(4)} IN ('', ':') THEN CASE WHEN lower({part(1)}) = 'https' THEN ':443' ELSE ':80' END ELSE {part(4)} END"
    path = f"CASE WHEN {part(5)} = '' THEN '/' ELSE {part(5)} END"
    built = f"{part(1)} || '://' || {part(2)} || {part(3)} || {port} || {path} || {part(6)}"
    return f"CASE WHEN {part(1)} <> '' AND {part(3)} <> '' AND NOT regexp_matches({part(5)}, '(?i)\\.(jpg|jpeg|gif|png|txt)$') THEN {built} END"


def resolve(base: str, href: str) -> str:
    """For hrefs that are absolute or begin at the root of their site, and plain relative ones."""
    folder = f"regexp_extract({base}, '^((?i:https?)://[^/?#]*(?:/(?:[^?#]*/)?)?)', 1)"
    folder = f"CASE WHEN ends_with({folder}, '/') THEN {folder} ELSE {folder} || '/' END"
    return f"""CASE WHEN regexp_matches({href}, '^(?i:https?)://') THEN {href} WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
        WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^([a-zA-Z]+:)', 1) || {href}
        WHEN starts_with({href}, '/') THEN regexp_extract({base}, '^((?i:https?)://[^/?#]*)', 1) || {href}
        WHEN starts_with({href}, '?') THEN regexp_replace({base}, '[?#].*$', '') || {href} ELSE {folder} || {href} END"""


def hrefs(page: str = "page") -> str:
    link = r"""(?is)<a\s[^>]*?\bhref\s*=\s*["'']?([^"''\s>]*)"""
    return f"list_filter(list_transform(regexp_extract_all(regexp_replace({page}, '{SCRIPT}', '', 'g'), '{link}', 1), lambda h: replace(h, '&amp;', '&')), lambda h: h <> '' AND NOT starts_with(h, '#'))"
