"""A short summary of an article page: its standfirst, its description, or its first paragraph."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Lengths of a summary: shorter candidates are passed over, longer ones cut.
LEAST, MOST = 40, 320
_META = ["og:description", "twitter:description", "description"]
_STANDFIRST = re.compile(r"<(\w+)[^>]*class=[\"'][^\"']*(?:standfirst|subtitle|dek|lede|article-intro)[^\"']*[\"'][^>]*>(.*?)</\1>", re.S | re.I)
_SCOPES = [re.compile(p, re.S | re.I) for p in (r"<article[^>]*>(.*?)(?:</article>|\Z)", r"<(?:div|section)[^>]*itemprop=[\"']articleBody[\"'][^>]*>(.*)", r"<main[^>]*>(.*?)(?:</main>|\Z)")]
_BYLINE = re.compile(r"^(?:by|words|photos?|photography|published|updated|posted)\b|cookie|subscribe|newsletter|all rights reserved", re.I)


def _plain(part: str) -> str:
    part = re.sub(r"<(script|style)\b.*?</\1>", " ", part, flags=re.S | re.I)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", part)).split())


def _fold(value: str | None) -> str:
    return re.sub(r"[\W_]+", "", (value or "").lower())


def _repeats(a: str, b: str | None) -> bool:
    x, y = _fold(a), _fold(b)
    return bool(x and y) and (x.startswith(y) or y.startswith(x))


def candidates(page: str) -> Iterator[str]:
    """What may summarise the page, the best kind first."""
    yield from (_plain(m[1]) for m in _STANDFIRST.findall(page))
    for name in _META:
        tag = next((t for t in re.findall(r"<meta[^>]*>", page, re.I) if re.search(rf"(?:name|property)=[\"']{re.escape(name)}[\"']", t, re.I)), "")
        found = re.search(r"content=[\"']([^\"']*)", tag)
        if found:
            yield _plain(found[1])
    for scope in [m[1] for p in _SCOPES if (m := p.search(page))] + [page]:
        yield from (p for p in map(_plain, re.findall(r"<p[^>]*>(.*?)(?:</p>|(?=<p[\s>]))", scope, re.S | re.I)) if not _BYLINE.search(p))


def summary_of(page: str | None, title: str | None, teaser: str | None) -> str | None:
    """The first candidate that is long enough and says something new; its first sentence, or a cut, if it is too long."""
    for text in candidates(page or ""):
        if len(text) < LEAST or _repeats(text, title) or _repeats(text, teaser):
            continue
        if len(text) <= MOST:
            return text
        sentence = re.match(r".{20,}?[.!?](?=\s)", text)
        if sentence and len(sentence[0]) <= MOST:
            return sentence[0]
        cut = text[:MOST]
        return (cut[: cut.rfind(" ")] if cut.rfind(" ") > 80 else cut).strip() + "…"
    return None


def _summaries(page: pd.Series, title: pd.Series, teaser: pd.Series) -> pd.Series:
    return pd.Series([summary_of(*row) for row in zip(page, title, teaser, strict=True)], dtype=object)


def page_summary(page: Column, title: Column, teaser: Column) -> Column:
    return F.pandas_udf(_summaries, StringType())(page, title, teaser)
