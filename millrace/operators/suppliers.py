"""Products of supplier pages: category, attributes, fitment and reasons to leave a page out, by rules; choice of pages to read.

Rules are data: every job compiles them to one expression, so a page costs one pass of built-in functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A range of model years within a text, and the millimetres of a part.
YEARS = r"(19\d{2}|8\d|9\d)[\s ]*[-–/][\s ]*(19\d{2}|8\d|9\d)"
MILLIMETRES = r"(\d{3})\s*mm"


@dataclass(frozen=True)
class Gives:
    """Attributes of parts of some categories (of all, if none are named) whose text has a pattern (any text, if empty)."""

    values: dict[str, str]
    categories: tuple[str, ...] = ()
    pattern: str = ""

    def holds(self, category: Column, text: Column) -> Column:
        at = category.isin(*self.categories) if self.categories else F.lit(True)
        return at & text.rlike(self.pattern) if self.pattern else at


@dataclass(frozen=True)
class Reject:
    """A reason to leave a page out: its text has one pattern and lacks the other (each counts only if it is set)."""

    reason: str
    has: str = ""
    lacks: str = ""

    def holds(self, text: Column) -> Column:
        return (text.rlike(self.has) if self.has else F.lit(True)) & (~text.rlike(self.lacks) if self.lacks else F.lit(True))


@dataclass(frozen=True)
class Supplier:
    """Rules of one supplier. Patterns meet lower-case texts.

    categories: (pattern, category, subcategory or None for the page's own), the first that holds counts.
    attributes: groups of rules. Of a group the first rule that holds gives its values; of equal attributes the first stays.
    rejects: the first that holds. fitment: make, model, generation, confidence, source, notes and fixed year_from,
    year_to, where pages have none; needs: patterns without which nothing is fitted; engine: (pattern, its name, unless).
    """

    categories: list[tuple[str, str, str | None]]
    attributes: list[list[Gives]]
    rejects: list[Reject] = field(default_factory=list)
    fitment: dict[str, str | int] = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    engine: tuple[str, str, str] | None = None
    size: str = MILLIMETRES


def _text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def category(rules: Supplier, text: Column, own: Column) -> Column:
    """(category, subcategory) of the first rule whose pattern the text has; else uncategorised and the page's own."""
    found = F.struct(F.lit("uncategorised").alias("category"), own.alias("subcategory"))
    for pattern, name, below in reversed(rules.categories):
        found = F.when(text.rlike(pattern), F.struct(F.lit(name).alias("category"), (own if below is None else F.lit(below)).alias("subcategory"))).otherwise(found)
    return found


def attributes(rules: Supplier, category: Column, text: Column) -> Column:
    """A map of attributes; the size of the part is its spec."""
    names = sorted({k for group in rules.attributes for rule in group for k in rule.values} | {"spec"})

    def of_group(group: list[Gives], name: str) -> Column:
        value = F.lit(None).cast("string")
        for rule in reversed(group):
            value = F.when(rule.holds(category, text), F.lit(rule.values.get(name)).cast("string")).otherwise(value)
        return value

    found = F.filter(F.array(*[F.regexp_extract(text, rules.size, g) for g in range(1, re.compile(rules.size).groups + 1)]), lambda x: x != "")
    size = F.concat(F.try_element_at(found, F.lit(1)), F.lit("mm"))
    values = {n: F.coalesce(*[of_group(g, n) for g in rules.attributes if any(n in r.values for r in g)], *([size] if n == "spec" else [F.lit(None).cast("string")])) for n in names}
    return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), values[n])]), lambda _, v: v.isNotNull())


def year_range(text: Column) -> Column:
    """(year_from, year_to) of the first range such as 89-94, 1989/94 or 1989–1994; two digits are of the 1900s."""
    year = lambda k: F.nullif(F.regexp_extract(text, YEARS, k), F.lit("")).cast("int")
    full = lambda y: F.when(y < 100, y + 1900).otherwise(y)
    return F.struct(full(year(1)).alias("year_from"), full(year(2)).alias("year_to"))


def fitment(rules: Supplier, text: Column) -> Column:
    """The vehicle that the page's part is for, with its years and engine; null where the text lacks what it needs."""
    years = year_range(text)
    engine = F.lit(None).cast("string")
    if rules.engine:
        has, name, unless = rules.engine
        engine = F.when(text.rlike(has) & ~text.rlike(unless), name)
    fixed = lambda n, kind="string": F.lit(rules.fitment.get(n)).cast(kind)
    found = F.struct(
        *[fixed(n).alias(n) for n in ("make", "model", "generation", "confidence", "source", "notes")],
        *[F.coalesce(fixed(n, "int"), years[n]).alias(n) for n in ("year_from", "year_to")], engine.alias("engine"),
    )
    needed = F.lit(bool(rules.fitment))
    for pattern in rules.needs:
        needed &= text.rlike(pattern)
    return F.when(needed, found)


def infer_parts(pages: DataFrame, rules: Supplier) -> DataFrame:
    """pages (name, description, source_category, url; null counts as empty) with category, subcategory, attributes (a map),
    fitment (a struct or null) and rejected (a reason or null). Columns of these names are replaced."""
    c = F.col
    everything = _text(c("name"), c("description"), c("source_category"))
    found = pages.withColumn("_part", category(rules, _text(c("source_category"), c("name"), c("url")), c("source_category")))
    rejected = F.lit(None).cast("string")
    for rule in reversed(rules.rejects):
        rejected = F.when(rule.holds(_text(c("name"), c("description"), c("source_category"), c("url"))), rule.reason).otherwise(rejected)
    found = found.withColumns({"attributes": attributes(rules, c("_part.category"), everything), "fitment": fitment(rules, everything), "rejected": rejected})
    return found.withColumns({"category": c("_part.category"), "subcategory": c("_part.subcategory")}).drop("_part")


@dataclass(frozen=True)
class Selection:
    """What pages of a supplier to read. Patterns meet lower-case addresses.

    buckets: (pattern, bucket), the first that holds; else other. points: (pattern, points), added up, with `keyword`
    points for each of keywords and `bucketed` for a bucket other than other. allow: all of them must be there; deny: none.
    targets: pages of a bucket that come first, `unlisted` for one without a target; most: pages together.
    """

    buckets: list[tuple[str, str]]
    points: list[tuple[str, int]]
    keywords: tuple[str, ...]
    targets: dict[str, int]
    most: int
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    keyword: int = 4
    bucketed: int = 10
    unlisted: int = 1


def score_urls(rows: DataFrame, rules: Selection) -> DataFrame:
    """The allowed addresses, each once, with bucket and score. An address must have one of the keywords, if there are any."""
    low = F.lower("url")
    bucket = F.lit("other")
    for pattern, name in reversed(rules.buckets):
        bucket = F.when(low.rlike(pattern), name).otherwise(bucket)
    score = F.when(bucket != "other", rules.bucketed).otherwise(0)
    for pattern, n in rules.points:
        score += F.when(low.rlike(pattern), n).otherwise(0)
    for word in rules.keywords:
        score += F.when(low.contains(word), rules.keyword).otherwise(0)
    kept = F.col("url").isNotNull()
    for pattern in rules.allow:
        kept &= low.rlike(pattern)
    for pattern in rules.deny:
        kept &= ~low.rlike(pattern)
    if rules.keywords:
        some = F.lit(False)
        for word in rules.keywords:
            some |= low.contains(word)
        kept &= some
    return rows.filter(kept).select("url").distinct().withColumns({"bucket": bucket, "score": score})


def select_urls(rows: DataFrame, rules: Selection) -> DataFrame:
    """url, bucket, score, place: the best of each bucket up to its target, then the best of all others; ties by url.

    No more than `most` of a bucket can be chosen, so each task keeps only so many of it before the shuffle.
    """
    quota = F.lit(rules.unlisted)
    for name, n in rules.targets.items():
        quota = F.when(F.col("bucket") == name, n).otherwise(quota)
    best = score_urls(rows, rules).withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "url"))).filter(F.col("_n") <= rules.most)
    chosen = best.withColumn("in_quota", F.col("_n") <= quota).drop("_n").orderBy(F.desc("in_quota"), F.desc("score"), "url").limit(rules.most)
    place = F.row_number().over(Window.orderBy(F.desc("in_quota"), F.desc("score"), "url"))  # of `most` rows
    return chosen.withColumn("place", place)
