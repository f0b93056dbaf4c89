"""Operator 9: main text of web pages by maximum-scoring subsequence.

Parts that are never main text (menus, forms, scripts, adverts, ...) go by their elements and names. What is left is a
row of blocks and tags: each word scores 1, each tag a negative weight, and a linear scan finds the contiguous region
with the best sum. Where the page has articles, those that the region touches are the main text, whole and alone.
Weights come from labelled pages: those with an <article> or <main>, whose inside is the main text. So do names of
elements that such pages use for other parts only; they go on pages that have neither.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

_TAG, _BLANK, _NAME, _EQUALS, _BARE = (re.compile(p) for p in (r"</?([a-zA-Z][^\s/>]*)", r"[\s/]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))

#: Fixed values of HTML: elements without content, with raw text, that break no block, and known by name.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BLOCKS = set("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("head title nav footer aside script style noscript template svg math button select option textarea iframe object canvas audio video dialog menu".split())
#: Dropped as well, unless a form holds the page or a header an article's headline.
FORM, HEADER = 3, 4
OWN = {"form": FORM, "header": HEADER}
#: Names in class, id or role that mark a part as none of the article. A parameter of extract().
BOILERPLATE = set("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary footer header masthead contentinfo share sharing social related recommended newsletter subscribe signup comment comments disqus replies".split())
#: Parts of a name after which a listed one says what a layout has or lacks, not what the element is.
LAYOUT = {"has", "no", "not", "non", "with", "without"}
#: What may follow a listed part of a name that says what the element is: comments-area and share-buttons, but not share-price.
SHELLS = set("area bar block box button buttons column container content form group icons inner item items left link links list panel posts right row section slot stories text thread top unit widget wrap wrapper".split())
#: Elements that hold others. Only these go for a part of a name.
HOLDERS = set("center dd details div dl fieldset figure li ol section table td ul".split())

#: Learned names: seen on so many labelled pages, such a share of their words outside the main text, at most so many.
NAME_PAGES, NAME_SHARE, MOST_NAMES = 20, 0.99, 1000
#: A page's articles bound its main text if they have at least so many words for each of the best region.
LEAST_LABELLED = 0.25
#: Weight of a tag that no labelled page shows, and the bounds of learned ones.
UNSEEN, LEAST, MOST = -0.5, -1.5, -0.2


Token = tuple[str, str, dict[str, str]]
#: Elements whose inside is the main text of a labelled page.
LABELS = ("article", "main")


def _marked(element: str, attributes: dict[str, str], names: set[str]) -> tuple[int, bool]:
    """(mark, whether by the word header). The mark is 2 if a whole class, id or role is among the names, 1 if a holder's
    class or id ends in one (site-footer), with words for its shell behind it or not (comments-area); else 0."""
    mark, header = 0, False
    for kind, value in attributes.items():
        for word in value.lower().split():
            if word in names:
                return 2, word == "header"
            parts = re.split(r"[-_]+", word)
            if kind == "role" or element not in HOLDERS or len(parts) == 1:
                continue
            last = next((i for i in range(len(parts) - 1, -1, -1) if parts[i] not in SHELLS or parts[i] in names), 0)
            if parts[last] in names and LAYOUT.isdisjoint(parts[:last]):
                mark, header = 1, header or parts[last] == "header"
    return mark, header


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", raw, {}), ("open" or "void" or "close", name, its class, id and role) and ("raw", name, {"text": content}).

    One scan in linear time. A quote opens a value only after =; one that is never closed ends with its tag.
    """
    at, n = 0, len(page)
    quoted = {'"': n, "'": n}

    def closing(quote: str, start: int) -> int:
        """The place of the next such quote, or -1. What was once looked for in vain is not looked for again."""
        if start >= quoted[quote]:
            return -1
        found = page.find(quote, start)
        if found < 0:
            quoted[quote] = start
        return found

    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            yield "text", page[at:end], {}
            at = end
            continue
        if page.startswith("<!--", at):
            end = at + 4 if page.startswith(">", at + 4) else page.find("-->", at + 4)
            at = n if end < 0 else end + (1 if page[end] == ">" else 3)
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        tag = _TAG.match(page, at)
        if not tag:
            yield "text", "<", {}
            at += 1
            continue
        close, name, found, slash = page[at + 1] == "/", tag.group(1).lower(), {}, False
        at = tag.end()
        while True:
            blank = _BLANK.match(page, at)
            slash, at = blank.group().endswith("/"), blank.end()
            if at >= n or page[at] == ">":
                at += 1
                break
            word = _NAME.match(page, at)
            at = word.end()
            equals, value = _EQUALS.match(page, at), ""
            if equals:
                at = equals.end()
                if at < n and page[at] in quoted:
                    end = closing(page[at], at + 1)
                    if end >= 0:
                        value, at = page[at + 1 : end], end + 1
                    else:
                        end = page.find(">", at)
                        end = n if end < 0 else end
                        value, at = page[at + 1 : end], end
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare.group(), bare.end()
            if (kind := word.group().lower()) in ("class", "id", "role"):
                found.setdefault(kind, value)
        if close:
            yield "close", name, {}
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            yield "raw", name, {"text": page[at : end.start() if end else n]}
            at = (page.find(">", end.start()) + 1 or n) if end else n
        else:
            yield "void" if name in VOID or slash and name in ("svg", "path") else "open", name, found


class _Held(NamedTuple):
    """An element's place among the tokens and what it holds: words, those in the main text, in paragraphs; headlines."""

    at: int
    words: int
    main: int
    prose: int
    h1: int
    headlines: int
    labels: int
    nested: bool


def _measure(parsed: list[Token]) -> tuple[int, int, list[_Held]]:
    """(words, those in articles or main, every element with attributes and every form and header); dropped words do not count."""
    stack: list[tuple[str, _Held]] = []
    open_names: Counter[str] = Counter()
    held: list[_Held] = []
    words = main = prose = h1 = headlines = labels = inside = dropped = 0

    def pop() -> str:
        nonlocal inside, dropped
        name, was = stack.pop()
        open_names[name] -= 1
        inside -= name in LABELS
        dropped -= name in DROPPED
        if was.at >= 0:
            held.append(_Held(was.at, words - was.words, main - was.main, prose - was.prose, h1 - was.h1, headlines - was.headlines, labels - was.labels, was.nested))
        return name

    for at, (kind, value, found) in enumerate(parsed):
        if kind == "text" and not dropped:
            n = len(value.split())
            words += n
            main += n if inside else 0
            prose += n if open_names["p"] else 0
        elif kind == "close" and open_names[value]:
            while pop() != value:
                pass
        elif kind in ("open", "void", "raw"):
            if value not in INLINE and stack and stack[-1][0] == "p":
                pop()
            if kind == "open":
                stack.append((value, _Held(at if found or value in OWN else -1, words, main, prose, h1, headlines, labels, inside > 0)))
                h1 += value == "h1" and inside > 0
                headlines += value in ("h1", "h2", "h3") and inside > 0
                labels += value in LABELS
                open_names[value] += 1
                dropped += value in DROPPED
                inside += value in LABELS
    while stack:
        pop()
    return words, main, held


def _gone(parsed: list[Token], measured: tuple[int, int, list[_Held]], names: set[str], foreign: set[str] = frozenset()) -> set[int]:
    """The places of elements that go by their names, or as forms or headers.

    Those that hold most words of the page or of its articles are layout and stay; a form only if it holds an article
    or mostly paragraphs. A header in an article stays if it holds a headline; what is marked by a part of a name, if
    it holds the article's h1. Of articles, only those in another go by a name.
    """
    words, main, held = measured
    gone = set()
    for e in held:
        _, name, found = parsed[e.at]
        mark, header = _marked(name, found, names) if found and name not in ("html", "body", "main") else (0, False)
        if not mark and foreign and found and any(x in foreign for v in found.values() for x in v.lower().split()):
            mark = 1
        if name == "article":
            mark = mark if mark == 2 and e.nested else 0
        mark = OWN.get(name, mark)
        most = 2 * e.words > words or 2 * e.main > main
        if mark == FORM:
            stays = most and (e.labels > 0 or 2 * e.prose > e.words) or e.nested and 2 * e.main > main
        elif mark == HEADER:
            stays = e.nested and e.headlines > 0
        else:
            stays = most or mark == 1 and (e.h1 > 0 or header and e.headlines > 0)
        if mark and not stays:
            gone.add(e.at)
    return gone


def items(page: str, names: set[str] = BOILERPLATE, whole: bool = False, foreign: set[str] = frozenset()) -> Iterator[tuple[str, str, tuple[int, int, bool]]]:
    """("text", raw text, place) and ("block" or "tag", name with / if it closes, place).

    Dropped parts are left out, unless whole is set; a "break" stands where one begins. The place is (the number of the
    outermost article, that of the outermost main, in an h1); numbers count from 1, 0 is outside or in a dropped part.
    """
    parsed = list(tokens(page))
    yield from _items(parsed, _measure(parsed), names, whole, foreign)


def _items(parsed: list[Token], measured: tuple[int, int, list[_Held]], names: set[str], whole: bool = False, foreign: set[str] = frozenset()) -> Iterator[tuple[str, str, tuple[int, int, bool]]]:
    labelled = any(kind == "open" and value in LABELS for kind, value, _ in parsed)
    lost = _gone(parsed, measured, names, frozenset() if labelled else foreign)
    stack: list[tuple[str, bool]] = []
    open_names: Counter[str] = Counter()
    number = {"article": 0, "main": 0}
    dropped = 0
    place = outside = (0, 0, False)

    def pop() -> str:
        nonlocal dropped
        name, gone = stack.pop()
        open_names[name] -= 1
        dropped -= gone
        return name

    def here() -> tuple[int, int, bool]:
        return outside if dropped else (number["article"] * (open_names["article"] > 0), number["main"] * (open_names["main"] > 0), open_names["h1"] > 0)

    for at, (kind, value, found) in enumerate(parsed):
        if kind == "text":
            if not dropped or whole:
                yield "text", value, place
            continue
        if kind == "close":
            was = place
            if open_names[value]:
                while pop() != value:
                    pass
                place = here()
            if whole or not dropped and value not in DROPPED:
                yield "tag" if value in INLINE else "block", "/" + value, was
            continue
        if value not in INLINE and stack and stack[-1][0] == "p":
            pop()
            place = here()
        gone = value in DROPPED or at in lost
        if whole or not dropped and not gone:
            yield "tag" if value in INLINE else "block", value, outside if gone else place
        elif not dropped and value not in INLINE:
            yield "break", value, place
        if kind == "raw" and not gone and not dropped and value == "xmp":
            yield "text", html.escape(found["text"]), place
        if kind == "open":
            stack.append((value, gone))
            number[value] = number.get(value, 0) + (value in LABELS and not open_names[value])
            open_names[value] += 1
            dropped += gone
            place = here()


def _tag(name: str) -> str:
    bare = name.lstrip("/")
    return name if bare in BLOCKS or bare in INLINE else ("/" if name[0] == "/" else "") + "?"


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


Block = tuple[float, str | None, tuple[int, int, bool]]


def main_text(page: str | None, weights: dict[str, float], names: set[str] = BOILERPLATE) -> str:
    """The blocks of the best region, two line breaks apart. Of equal regions, the first and longest.

    Articles that the region touches (the largest, if none) bound it, if they have LEAST_LABELLED of its words: their
    blocks are the text, and headlines above them in the same main. A main bounds it where there are no articles or
    they hold less than half of its words.
    """
    row: list[Block] = []
    block: list[str] = []
    at, begun = (0, 0, False), False

    def end() -> None:
        nonlocal begun
        text, begun = _clean("".join(block)), False
        block.clear()
        if text:
            row.append((float(text.count(" ") + 1), text, at))

    for kind, value, place in items(page or "", names, foreign={k[1:] for k in weights if k[0] == "."}):
        if kind == "text":
            if not begun and not value.isspace():
                at, begun = place, True
            block.append(value)
        elif value == "br":
            block.append(" ")
        elif kind != "tag":
            end()
        if kind in ("tag", "block"):
            row.append((weights.get(_tag(value), UNSEEN), None, place))
    end()
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, (score, _, _) in enumerate(row):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best or total == best and start == best_from:
            best, best_from, best_to = total, start, i + 1
    return "\n\n".join(_bounded(row, row[best_from:best_to]))


def _bounded(row: list[Block], region: list[Block]) -> Iterator[str]:
    words = lambda blocks, which: sum(n for n, text, place in blocks if text and which(place))
    in_main, in_both = words(row, lambda p: p[1] > 0), words(row, lambda p: p[0] > 0 and p[1] > 0)
    by = 0 if 2 * in_both >= in_main and any(text and p[0] for _, text, p in row) else 1
    sizes: Counter[int] = Counter()
    for n, text, p in row:
        sizes[p[by]] += n if text else 0
    del sizes[0]
    touched = {p[by] for _, text, p in region if text and p[by]} or set(sorted(sizes, key=lambda k: (-sizes[k], k))[:1])
    if not sizes or sum(sizes[k] for k in touched) < LEAST_LABELLED * words(region, lambda p: True):
        yield from (text for _, text, _ in region if text)
        return
    mains, above = {p[1] for _, text, p in row if text and p[by] in touched and p[1]}, True
    for _, text, p in row:
        if text and (p[by] in touched or above and p[2] and p[1] in mains and not p[0]):
            yield text
        above &= not (text and p[by] in touched)


_COUNTS = pa.schema([("key", pa.string()), ("inside", pa.int64()), ("outside", pa.int64()), ("pages", pa.int64())])


def tag_weights(pages: DataFrame, html_column: str = "html", names: set[str] = BOILERPLATE) -> dict[str, float]:
    """Learns from all pages with an <article> or <main>: how much denser a tag is, to the words, outside the main text
    than inside; and names (keys with a point before them) of which hardly any word is in the main text.

    There is one weight for each HTML tag name at most and MOST_NAMES names, so its size does not follow the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list[int]] = {}
            for page in batch.column(0):
                parsed = list(tokens(page.as_py() or ""))
                if not any(kind == "open" and value in LABELS for kind, value, _ in parsed):
                    continue
                seen: dict[str, list[int]] = {}
                measured = _measure(parsed)
                for kind, value, place in _items(parsed, measured, names, whole=True):
                    seen.setdefault("words" if kind == "text" else _tag(value), [0, 0])[not (place[0] or place[1])] += len(value.split()) if kind == "text" else 1
                if not any(inside for inside, _ in seen.values()):
                    continue
                for e in measured[2]:
                    for name in {x for v in parsed[e.at][2].values() for x in v.lower().split()} - names:
                        n = seen.setdefault("." + name, [0, 0])
                        n[0], n[1] = n[0] + e.main, n[1] + e.words - e.main
                for key, (inside, outside) in seen.items():
                    n = total.setdefault(key, [0, 0, 0])
                    n[0], n[1], n[2] = n[0] + inside, n[1] + outside, n[2] + 1
            yield pa.RecordBatch.from_pydict({"key": list(total), **{c: [n[i] for n in total.values()] for i, c in enumerate(("inside", "outside", "pages"))}}, schema=_COUNTS)

    counted = pages.select(html_column).mapInArrow(count, "key string, inside long, outside long, pages long").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("inside", "outside", "pages")])
    is_name = F.col("key").startswith(".")
    telling = (F.col("pages") >= NAME_PAGES) & (F.col("outside") >= NAME_SHARE * (F.col("inside") + F.col("outside"))) & (F.col("outside") > 0)
    most = 2 * (len(BLOCKS) + len(INLINE) + 1) + 1 + MOST_NAMES
    found = counted.filter(~is_name | telling).orderBy(is_name, F.desc("outside"), "key").limit(most).collect()
    n = {r.key: (r.inside, r.outside) for r in found}
    in_words, out_words = n.get("words", (0, 0))
    weight = lambda inside, outside: -math.log((outside + 1) / (out_words + 2) / ((inside + 1) / (in_words + 2)))
    return {key: LEAST if key[0] == "." else min(MOST, max(LEAST, weight(*n[key]))) for key in sorted(n) if key != "words"}


def extract(pages: DataFrame, html_column: str = "html", weights: dict[str, float] | None = None, names: set[str] = BOILERPLATE) -> DataFrame:
    """pages and `text`, the main text (empty if none). A column of that name is replaced.

    Null or empty html: empty text. Without labelled pages every tag has the weight of an unseen one. Markup that
    is cut off or never closed is read as far as it goes. Repeated rows give repeated results.
    """
    weights = tag_weights(pages, html_column, names) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights, names) for page in batch.column(batch.schema.names.index("__html"))]
            keep = batch.drop_columns(["__html"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(texts, pa.string())], names=[*keep.schema.names, "text"])

    kept = pages.select(*[c for c in pages.columns if c not in ("text", "__html", html_column)], F.col(html_column).alias("__html"))
    schema = kept.drop("__html").withColumn("text", F.lit("")).schema
    return kept.mapInArrow(run, schema)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_html_extract": op9_html_extract}
ORACLE_SQL: dict[str, str] = {}
