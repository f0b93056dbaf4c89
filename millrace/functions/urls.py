"""Scalar functions and predicates on URL columns. All are built-in expressions; what can't be parsed gives null."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#\s]*)([^?#\s]*)(\?[^#\s]*)?(#\S*)?$"
#: Query parameters that tell nothing of the page, besides those that begin with utm_.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid"]


@dataclass
class Parts:
    """A URL taken apart once; every function here takes it in place of the URL."""

    raw: Column
    ok: Column
    scheme: Column
    host: Column
    path: Column
    segments: Column
    query: Column


def take_apart(c: Column) -> Column:
    """The parts of a URL as one struct, to be stored in a column before many predicates ask for them."""
    return F.struct(c.alias("raw"), parsable(c).alias("ok"), _part(c, 1).alias("scheme"), host(c).alias("host"), path(c).alias("path"), segments(c).alias("segments"), _part(c, 4).alias("query"))


def parts_of(name: str) -> Parts:
    return Parts(*[F.col(f"{name}.{x}") for x in ("raw", "ok", "scheme", "host", "path", "segments", "query")])


def _raw(c: Column | Parts) -> Column:
    return c.raw if isinstance(c, Parts) else c


def _part(c: Column | Parts, n: int) -> Column:
    if isinstance(c, Parts):
        return {1: c.scheme, 4: c.query}[n]
    return F.regexp_extract(F.trim(c), _URL, n)


def parsable(c: Column | Parts) -> Column:
    if isinstance(c, Parts):
        return c.ok
    return F.coalesce(F.trim(c).rlike(_URL) & (_part(c, 2) != ""), F.lit(False))


def host(c: Column) -> Column:
    """Lower-cased, without user, port and a leading www.; null if the URL can't be parsed."""
    if isinstance(c, Parts):
        return c.host
    name = F.regexp_replace(F.regexp_replace(F.lower(_part(c, 2)), r"^.*@", ""), r":\d+$", "")
    return F.when(parsable(c), F.regexp_replace(name, r"^www\.", ""))


def path(c: Column) -> Column:
    """Lower-cased, without slashes at the end; / for the root."""
    if isinstance(c, Parts):
        return c.path
    trimmed = F.regexp_replace(F.lower(_part(c, 3)), r"/+$", "")
    return F.when(parsable(c), F.when(trimmed == "", "/").otherwise(trimmed))


def segments(c: Column | Parts) -> Column:
    if isinstance(c, Parts):
        return c.segments
    return F.coalesce(F.filter(F.split(path(c), "/"), lambda s: s != ""), F.array().cast("array<string>"))


def canonicalize_url(c: Column) -> Column:
    """No fragment, tracking parameters or default port; host in lower case; no slash at the end but for the root."""
    scheme, name = F.lower(_part(c, 1)), F.lower(_part(c, 2))
    name = F.when(scheme == "http", F.regexp_replace(name, ":80$", "")).when(scheme == "https", F.regexp_replace(name, ":443$", "")).otherwise(name)
    where = F.when(_part(c, 3) == "", "/").otherwise(_part(c, 3))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(F.substring(_part(c, 4), 2, 1 << 20), "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(scheme, F.lit("://"), name, where, query)
    return F.when(parsable(c), F.when(whole.endswith("/") & (where != "/"), F.regexp_replace(whole, "/$", "")).otherwise(whole))


def resolve_url(raw: Column, base: Column) -> Column:
    """Absolute https URL of an image: protocol-relative and root-relative ones are completed; other schemes are null."""
    raw = F.trim(raw)
    root = F.concat(F.lit("https://"), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    full = (
        F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.rlike("(?i)^http://"), F.concat(F.lit("https"), F.substring(raw, 5, 1 << 20)))
        .when(raw.rlike("(?i)^https://"), raw).when(raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(raw.startswith("/"), F.concat(root, raw)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), raw))
    )
    return F.when(is_usable_image(raw) | raw.rlike(r"^[^:/]+\.(?:jpe?g|png|webp|gif)"), full)


#: Kinds of files that are no pictures, and words in the path of a picture that shows no story. Parameters of is_usable_image.
NO_PICTURES = ["svg", "ico", "css", "js", "ttf", "otf", "eot", "woff", "woff2"]
CHROME_WORDS = ["logo", "logos", "icon", "favicon", "sprite", "pixel", "spacer", "tracking", "branding", "fonts", "themes", "1x1"]


def is_usable_image(c: Column, no_pictures: list[str] | None = None, chrome: list[str] | None = None) -> Column:
    """Whether a URL may be a story's picture: of the web, not of a wrong kind, not part of a site's own chrome, not one pixel wide."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    where = F.regexp_extract(low, "^[^?#]*", 0)
    words = F.split(F.regexp_replace(where, "^(?:https?:)?//[^/]*", ""), "[^a-z0-9]+")
    wrong = F.regexp_extract(where, r"[.]([a-z0-9]+)$", 1).isin(*(NO_PICTURES if no_pictures is None else no_pictures))
    chromed = F.arrays_overlap(words, F.array(*[F.lit(x) for x in (CHROME_WORDS if chrome is None else chrome)]))
    tiny = low.rlike("[?&](?:w|h|width|height)=(?:1|undefined)(?:&|$)")
    return (low.rlike("^(?:https?:)?//") | low.startswith("/")) & ~wrong & ~chromed & ~tiny


@dataclass
class GateRules:
    """Words of URLs and of copy that tell what a page is: short lists of our own, which a platform replaces by its own.

    copy: (patterns, title only, reason); all patterns must be found.
    """

    about: list[str] = field(default_factory=lambda: ["/about", "/who-we-are"])
    corporate_paths: list[str] = field(default_factory=lambda: ["/imprint", "/contact"])
    corporate: list[str] = field(default_factory=lambda: ["legal", "privacy"])
    sponsored: list[str] = field(default_factory=lambda: ["sponsored"])
    marketplace: list[str] = field(default_factory=lambda: ["dealers"])
    commerce: list[str] = field(default_factory=lambda: ["bookshop"])
    commerce_prefixes: list[str] = field(default_factory=lambda: ["/deals/"])
    competition: list[str] = field(default_factory=lambda: ["raffles"])
    competition_prefixes: list[str] = field(default_factory=lambda: ["/contests/"])
    competition_words: list[str] = field(default_factory=lambda: ["giveaway", "giveaways"])
    merch: list[str] = field(default_factory=lambda: ["shop", "basket"])
    listing: list[str] = field(default_factory=lambda: ["classifieds", "subscribe"])
    subscribe: list[str] = field(default_factory=lambda: ["subscribe"])
    index_paths: list[str] = field(default_factory=lambda: ["/", "/news", "/cars"])
    unusable: list[str] = field(default_factory=lambda: ["undefined", "null"])
    shop_hosts: list[str] = field(default_factory=list)
    shop_sources: list[str] = field(default_factory=list)
    copy: list[tuple[list[str], bool, str]] = field(default_factory=lambda: [([r"\btickets?\b", r"\b\d+% off\b"], False, "ticket_sales"), ([r"\bmembers only\b"], False, "subscription"), ([r"^\s*show us\b"], True, "low_editorial_value")])


RULES = GateRules()


def _has(c: Column, words: list[str]) -> Column:
    return F.exists(segments(c), lambda s: s.isin(*words)) if words else F.lit(False)


def _is(c: Column, paths: list[str]) -> Column:
    return F.coalesce(path(c).isin(*paths), F.lit(False))


def _leaf(c: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(c), F.lit(-1)), F.lit(""))


def _starts(c: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found |= F.coalesce(path(c).startswith(p), F.lit(False))
    return found


def is_unusable_url(c: Column, rules: GateRules = RULES) -> Column:
    raw = F.lower(F.trim(F.coalesce(_raw(c), F.lit(""))))
    index = _is(c, rules.index_paths) & ~((path(c) == "/") & _part(c, 4).rlike(r"[?&]p=[^&]"))
    return raw.isin("", "undefined", "null") | ~parsable(c) | ~F.lower(_part(c, 1)).isin("http", "https") | index | F.coalesce(path(c).endswith(".rss"), F.lit(False)) | _has(c, rules.unusable)


def is_merch_url(c: Column, rules: GateRules = RULES) -> Column:
    return _has(c, rules.merch)


def is_commerce_url(c: Column, rules: GateRules = RULES) -> Column:
    return _starts(c, rules.commerce_prefixes) | _has(c, rules.commerce)


def is_competition_url(c: Column, rules: GateRules = RULES) -> Column:
    words = F.array(*[F.lit(x) for x in rules.competition_words]).cast("array<string>")
    return _starts(c, rules.competition_prefixes) | _has(c, rules.competition) | F.exists(segments(c), lambda s: F.arrays_overlap(F.split(s, "-"), words))


def is_corporate_url(c: Column, rules: GateRules = RULES) -> Column:
    return _is(c, rules.corporate_paths) | _has(c, rules.corporate)


def is_subscribe_url(c: Column, rules: GateRules = RULES) -> Column:
    """A segment is one of the words, or begins with one and a hyphen or underscore."""
    return F.exists(segments(c), lambda s: F.regexp_extract(s, "^[^_-]*", 0).isin(*rules.subscribe)) if rules.subscribe else F.lit(False)


def is_listing_url(c: Column, rules: GateRules = RULES) -> Column:
    return _has(c, rules.listing) | F.exists(segments(c), lambda s: s.endswith("a-to-z")) | is_subscribe_url(c, rules)


def is_shop_host(c: Column) -> Column:
    return F.coalesce(host(c).startswith("shop.") | (host(c) == "shop"), F.lit(False))


def is_shop_marked_host(c: Column, rules: GateRules = RULES) -> Column:
    return F.coalesce(host(c).isin(*rules.shop_hosts), F.lit(False)) if rules.shop_hosts else F.lit(False)


def is_category_index(c: Column) -> Column:
    return F.coalesce((F.try_element_at(segments(c), F.lit(1)) == "category") & (F.size(segments(c)) == 2), F.lit(False))


def is_gallery_index(c: Column) -> Column:
    return _leaf(c) == "galleries"


def is_off_site(c: Column, site: Column) -> Column:
    return F.coalesce(host(c) != host(site), F.lit(True))


def is_non_editorial_url(c: Column, site: Column, rules: GateRules = RULES) -> Column:
    off = F.coalesce(_raw(site) != "", F.lit(False)) & is_off_site(c, site)
    return is_unusable_url(c, rules) | is_listing_url(c, rules) | is_category_index(c) | is_gallery_index(c) | is_shop_host(c) | is_shop_marked_host(c, rules) | off


def looks_like_article(c: Column, site: Column, rules: GateRules = RULES) -> Column:
    asset = F.coalesce(path(c).rlike(r"\.(?:jpe?g|png|gif|webp|svg|pdf|css|js|xml|zip|mp4)$"), F.lit(False))
    login = F.coalesce(path(c).rlike(r"login|log-in|sign-?in|register|account|password"), F.lit(False))
    return ~is_off_site(c, site) & (F.size(segments(c)) >= 1) & ~asset & ~login & ~is_non_editorial_url(c, site, rules) & ~is_merch_url(c, rules) & ~is_corporate_url(c, rules)


def robots_allowed(where: Column, allow: Column, disallow: Column) -> Column:
    """Whether the longest allow prefix is longer than the longest disallow prefix (equal and positive: not allowed)."""
    longest = lambda rules: F.coalesce(F.array_max(F.transform(F.filter(rules, lambda r: (r != "") & F.expr("true") & where.startswith(r)), F.length)), F.lit(0))
    return (longest(disallow) == 0) | (longest(allow) > longest(disallow))


def video_id(c: Column) -> Column:
    """The 11-character id of a video page's URL, in its usual forms; else null."""
    one = "([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)"
    tries = [rf"^https?://youtu\.be/{one}", rf"^https?://(?:[a-z]+\.)?youtube(?:-nocookie)?\.com/watch\?(?:[^#]*&)?v={one}", rf"^https?://(?:[a-z]+\.)?youtube(?:-nocookie)?\.com/(?:shorts|embed|live|v)/{one}"]
    return F.coalesce(*[F.nullif(F.regexp_extract(c, t, 1), F.lit("")) for t in tries])


# -- the eligibility gate ---------------------------------------------------------------------------------------------
def gate_flags(c: Parts, site: Parts, rules: GateRules = RULES) -> Column:
    """What the gate asks of one URL, as a struct of booleans, to be stored in a column before the gate reads it many times."""
    off = F.coalesce(site.raw != "", F.lit(False)) & is_off_site(c, site)
    flags = {
        "present": c.raw != "", "about": _is(c, rules.about), "corporate": is_corporate_url(c, rules), "sponsored": _has(c, rules.sponsored), "market": is_shop_host(c) | _leaf(c).isin(*rules.marketplace),
        "commerce": is_commerce_url(c, rules), "competition": is_competition_url(c, rules), "merch": is_merch_url(c, rules), "subscribe": is_subscribe_url(c, rules) | is_shop_marked_host(c, rules),
        "off": off, "wrong": is_non_editorial_url(c, site, rules),
    }
    return F.struct(*[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in flags.items()], F.size(segments(c)).alias("depth"))


def eligibility_reason(canonical: Column, url: Column, title: Column, excerpt: Column, source_id: Column, desk_pick: Column, rules: GateRules = RULES) -> Column:
    """Null if eligible, else the first reason that holds. canonical and url: gate_flags() of the two URLs.

    The order is the contract: a live pick passes; then the canonical URL's rules, then the URL's; then the copy; then
    merchandise; then what is no article at all.
    """
    title, excerpt = F.coalesce(title, F.lit("")), F.coalesce(excerpt, F.lit(""))
    whole = F.lower(F.concat_ws(" ", title, excerpt))
    of_url = [("about", "about_page"), ("corporate", "corporate"), ("sponsored", "corporate"), ("market", "commerce"), ("commerce", "commerce"), ("competition", "competition")]
    steps = [(c["present"] & c[flag], F.lit(reason)) for c in (canonical, url) for flag, reason in of_url]
    for patterns, of_title, reason in rules.copy:
        found = F.lit(True)
        for pattern in patterns:
            found &= (F.lower(title) if of_title else whole).rlike(pattern)
        steps.append((found, F.lit(reason)))
    depth = F.when(canonical["present"], canonical["depth"]).otherwise(url["depth"])
    steps.append(((depth == 1) & (F.trim(title) != "") & (F.trim(title) == F.trim(excerpt)), F.lit("category_page")))
    merch = canonical["merch"] | url["merch"]
    steps.append(((merch | source_id.isin(*rules.shop_sources)) if rules.shop_sources else merch, F.lit("commerce")))
    for c in (canonical, url):
        why = (
            F.when(c["merch"] | c["market"], "commerce").when(c["sponsored"], "corporate").when(c["subscribe"], "subscription").when(c["about"], "about_page")
            .when(c["corporate"] | c["off"], "corporate").otherwise("category_page")
        )
        steps.append((c["present"] & c["wrong"], why))
    steps.append((canonical["wrong"] | url["wrong"], F.lit("category_page")))
    found = F.when(F.coalesce(desk_pick, F.lit(False)), F.lit(None).cast("string"))
    for rule, reason in steps:
        found = found.when(F.coalesce(rule, F.lit(False)), reason)
    return found
