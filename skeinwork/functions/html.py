"""Parts of HTML pages as built-in expressions, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
UNSEEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>"
TAG = r"(?s)<[^>]*>"
META = r"(?is)<meta\b[^>]*>"
DESCRIPTION = r"""(?is)\bname\s*=\s*["']?description\b"""
CONTENT = r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
LINK = r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?([^"'\s>]*)"""
ENTITY = r"(?i)&(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);"
# Entities that stand for ASCII characters.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def decode(text: Column) -> Column:
    """Text with the common entities decoded and blanks for all others."""
    *others, amp = ENTITIES
    for name, char in others:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, r"(?i)&(?!amp;)(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);", " ")
    return F.replace(text, F.lit(amp[0]), F.lit(amp[1]))


def squeeze(text: Column) -> Column:
    """Text with runs of white space as one blank and none around."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title(page: Column) -> Column:
    """The text of the title element, or null without one."""
    t = squeeze(decode(F.regexp_extract(page, TITLE, 1)))
    return F.when(t != "", t)


def description(page: Column) -> Column:
    """Contents of all ``meta name=description`` tags, joined by blanks; null without any."""
    tags = F.filter(F.regexp_extract_all(page, F.lit(META), F.lit(0)), lambda t: t.rlike(DESCRIPTION))
    texts = F.transform(tags, lambda t: F.concat(F.regexp_extract(t, CONTENT, 1), F.regexp_extract(t, CONTENT, 2)))
    joined = squeeze(decode(F.array_join(texts, " ")))
    return F.when(joined != "", joined)


def without_scripts(page: Column) -> Column:
    return F.regexp_replace(page, SCRIPT, "")


def body_text(page: Column) -> Column:
    """All text of the body, a blank at each tag."""
    return squeeze(decode(F.regexp_replace(F.regexp_replace(page, UNSEEN, " "), TAG, " ")))


def hrefs(page: Column) -> Column:
    """Targets of links in page order, as written; without empty ones and ones within the page (``#...``)."""
    found = F.regexp_extract_all(F.regexp_replace(page, SCRIPT, ""), F.lit(LINK), F.lit(1))
    return F.filter(F.transform(found, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&"))), lambda h: (h != "") & ~h.startswith("#"))
