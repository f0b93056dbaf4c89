"""Scalar functions on text columns. All are built-in expressions, but for the Unicode forms of the language gate."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

ELLIPSIS = "…"


def once(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c), with c evaluated once however often body names it; a long expression of texts would else be copied for each use."""
    return F.element_at(F.transform(F.array(c), body), 1)


def js_round(c: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(c + 0.5)


def _numeric(c: Column, digits: str, base: int) -> Column:
    """Numeric references of one base decoded. The text is split at them, so that each part can start with one. c stands in the expression once."""
    parts = F.split(F.regexp_replace(c, digits, "\u0001$1\u0002"), "\u0001")
    code = lambda p: F.conv(F.regexp_extract(p, "^([^\u0002]+)\u0002", 1), base, 10).cast("int")
    # an int as four bytes, big-endian, is the character in UTF-32; what is no character becomes U+FFFD
    known = lambda n: F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), n).otherwise(0xFFFD)
    char = lambda p: F.decode(F.unhex(F.lpad(F.hex(known(code(p))), 8, "0")), "UTF-32")
    decoded = F.transform(parts, lambda p: F.when(p.rlike("^[^\u0002]+\u0002"), F.concat(char(p), F.regexp_replace(p, "^[^\u0002]+\u0002", ""))).otherwise(p))
    return F.array_join(decoded, "")


def decode_entities(c: Column) -> Column:
    """Named and numeric character references, of any plane; in this order: named, hexadecimal, decimal, and the ampersand last."""

    def decoded(c: Column) -> Column:
        for pattern, to in [("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'")]:
            c = F.regexp_replace(c, pattern, to)
        c = _numeric(c, "(?i)&#x0*([0-9a-f]{1,6});", 16)
        return F.regexp_replace(_numeric(c, "&#0*([0-9]{1,7});", 10), "(?i)&amp;", "&")

    # most texts hold no reference and are passed on as they are
    return once(c, lambda text: F.when(text.contains("&") | text.contains("\u0001"), decoded(text)).otherwise(text))


def strip_html(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<script.*?</script>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?is)<style.*?</style>", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(decode_entities(c), r"\s+", " "))


def cap_summary(c: Column, most: int = 320) -> Column:
    """Stripped text, cut at the last space within `most` characters if that leaves more than 80."""

    def capped(text: Column) -> Column:
        return F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(once(F.substring(text, 1, most), shortened)), F.lit(ELLIPSIS)))

    def shortened(cut: Column) -> Column:
        space = F.length(cut) - F.instr(F.reverse(cut), " ")  # characters before the last space
        return F.when((F.instr(cut, " ") > 0) & (space > 80), F.substring(cut, F.lit(1), space)).otherwise(cut)

    return once(strip_html(c), capped)


def normalize_title(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "&amp;", "and"), "['’]", "")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def duplicate_key(publication: Column, title: Column) -> Column:
    return F.concat_ws("::", normalize_title(publication), normalize_title(title))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def entity_id(kind: Column, name: Column, make: Column, model: Column) -> Column:
    """make:m, make:m:model:x, make:m:model:x:gen:g and so on."""
    filled = lambda c: F.nullif(c, F.lit(""))
    m = slugify(F.coalesce(filled(make), F.when(kind == "make", filled(name)), F.lit("unknown")))
    x = slugify(F.coalesce(filled(model), F.when(kind == "model", filled(name)), F.lit("")))
    tail = F.when(kind == "generation", "gen").when(kind.isin("variant", "chassis"), kind)
    base = F.concat(F.lit("make:"), m)
    return F.when(kind == "model", F.concat(base, F.lit(":model:"), x)).when(tail.isNotNull(), F.concat(base, F.lit(":model:"), x, F.lit(":"), tail, F.lit(":"), slugify(name))).otherwise(base)


def publisher_score(relevance: Column) -> Column:
    head = F.lower(F.coalesce(relevance, F.lit("")))
    return F.when(head.startswith("excellent"), 20).when(head.startswith("good"), 12).when(head.startswith("medium"), 6).otherwise(4)


def editorial_score(relevance: Column, excerpt: Column) -> Column:
    return publisher_score(relevance) + F.when(F.length(F.coalesce(excerpt, F.lit(""))) >= 180, 8).otherwise(0)


def _fold(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def same_copy(a: Column, b: Column) -> Column:
    """Equal, or one a beginning of the other, by letters and digits alone; never if either is empty."""
    x, y = _fold(a), _fold(b)
    return (x != "") & (y != "") & (x.startswith(y) | y.startswith(x))


def teaser_excerpt(title: Column, summary: Column, extract: Column) -> Column:
    """The summary unless it says what the title says; else the extract unless it repeats either; else null."""
    t, s, e = _fold(title), _fold(summary), _fold(extract)
    return F.when((s != "") & (s != t), F.trim(summary)).when((e != "") & (e != t) & (e != s), F.trim(extract))


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), F.trim), lambda x: x != "")


# -- language gate ----------------------------------------------------------------------------------------------------
#: Function words of some languages. Parameters of is_english; short, but enough for sentences.
ENGLISH_WORDS = ["the", "and", "of", "to", "in", "for", "on", "with", "at", "from", "is", "this", "that", "was", "are", "it", "as", "by"]
FOREIGN_WORDS = {
    "fr": ["le", "la", "les", "des", "et", "une", "dans", "pour", "avec", "est", "sur", "du", "par"],
    "de": ["der", "die", "das", "und", "mit", "ist", "von", "ein", "eine", "auf", "den", "nicht", "sich"],
    "it": ["il", "di", "che", "della", "per", "una", "con", "sono", "nel", "alla"],
    "es": ["el", "los", "las", "que", "del", "por", "para", "una", "con", "como"],
}
_OTHER_SCRIPTS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsCyrillic}\p{IsArabic}\p{IsHebrew}\p{IsThai}\p{IsGreek}\p{IsDevanagari}]"


class _Accented(dict):
    """For str.translate: letters that decompose (or take two UTF-16 units) stay, all other characters go."""

    def __missing__(self, point: int) -> int | None:
        char = chr(point)
        counts = unicodedata.category(char)[0] == "L" and (point > 0xFFFF or len(unicodedata.normalize("NFD", char)) > 1)
        self[point] = point if counts else None
        return self[point]


_ACCENTED = _Accented()


@F.pandas_udf(StructType([StructField("words", StringType()), StructField("accents", IntegerType())]))
def _unicode(texts: pd.Series) -> pd.DataFrame:
    """Lower-cased text in NFKC, and how many of its letters have accents."""
    words = [None if t is None else unicodedata.normalize("NFKC", t.lower()) for t in texts]
    return pd.DataFrame({"words": words, "accents": pd.array([None if t is None else len(t.translate(_ACCENTED)) for t in texts], "Int32")})


def is_english(title: Column, excerpt: Column, english: list[str] | None = None, foreign: dict[str, list[str]] | None = None) -> Column:
    """False for other scripts, many foreign function words or many accents; empty text counts as English.

    Words are counted in compatibility form (NFKC), so full-width letters and ligatures count as the letters they stand for;
    an accent is a letter that decomposes (NFD). ASCII texts need neither and are judged by built-in functions alone; only
    others go through Python, in Arrow batches.
    """
    text = F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(excerpt, F.lit(""))))
    wide = _unicode(F.when(text.rlike(r"[^\x00-\x7F]"), text))
    words = F.regexp_extract_all(F.coalesce(wide["words"], F.lower(text)), F.lit(r"(\p{L}+)"), F.lit(1))
    hits = lambda lexicon: F.size(F.filter(words, lambda w: w.isin(*lexicon)))
    en = hits(ENGLISH_WORDS if english is None else english)
    other = F.greatest(*[hits(x) for x in (FOREIGN_WORDS if foreign is None else foreign).values()])
    accents = F.coalesce(wide["accents"], F.lit(0))
    rejected = text.rlike(_OTHER_SCRIPTS) | (other >= 4) | ((other >= 3) & (other >= en)) | ((other >= 2) & (en == 0)) | (accents >= 8) | ((accents >= 5) & (other >= 2))
    return (text == "") | (F.size(words) == 0) & ~text.rlike(_OTHER_SCRIPTS) | ~rejected
