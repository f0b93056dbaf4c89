"""Snapshots of sections, common lists and profiles, and filtered feeds, against the rules applied to one list at a time."""

import random

from pyspark.sql import functions as F

from millrace.operators import ranking as rk

from .test_personal_lists import CULTURE, NOW, tables


def mixed(rows, limit, share=0.25):
    """Videos held back while they have their share, and let in one at a time."""
    out, waiting = [], []

    def fits():
        return (sum(r["is_video"] for r in out) + 1) / (len(out) + 1) <= share + 1e-9 and not (out and out[-1]["is_video"])

    for r in rows:
        if r["is_video"] and not fits():
            waiting.append(r)
            continue
        out.append(r)
        while not r["is_video"] and waiting and fits():
            out.append(waiting.pop(0))
    return (out + waiting)[:limit]


def common_list(rows, limit):
    band = {b: i for i, b in enumerate(rk.BANDS)}
    rows = sorted(rows, key=lambda r: (-band[r["quality_band"]], -r["rank_score"], -(r["published_at"] if r["published_at"] is not None else -1e18), r["id"]))
    seen, kept = set(), []
    for r in rows:
        if r["duplicate_group_id"] and r["duplicate_group_id"] in seen:
            continue
        seen.add(r["duplicate_group_id"])
        kept.append(r)
    return [r["id"] for r in mixed(kept, limit)]


def lists_of(found):
    got = {}
    for r in found.orderBy("position").collect():
        got.setdefault(r.list_key, []).append(r.article_id)
        assert r.position == len(got[r.list_key]) - 1
    return got


def test_snapshots_against_the_rules(spark):
    articles, profiles = tables(spark, random.Random(5), 160, 3, 0.4)
    articles = articles.withColumns({"is_video": F.when(F.col("id") % 5 != 4, F.col("id") % 3 == 0), "reason": F.when(F.col("id") % 17 == 0, "commerce"), "title": F.lit("t"), "publication": F.lit("p")}).cache()
    rows = [r.asDict() for r in rk.default_rows(articles.filter("reason is null"), NOW).collect()]
    for r in rows:
        r["is_video"] = bool(r["is_video"])
        assert r["score"] >= r["rank_score"] >= 0 and r["vehicle_tier"] == "none"
    for limit in (7, 80):
        want = {f"for-you:{limit}": common_list(rows, limit)} | {f"{s}:{limit}": ids for s in rk.SECTIONS if (ids := common_list([r for r in rows if r["primary_category"] == s], limit))}
        assert lists_of(rk.section_lists(articles, NOW, limit)) == want
    own = lists_of(rk.personal_lists(articles, profiles, NOW, 7, CULTURE))
    both = lists_of(rk.snapshot_lists(articles, profiles, NOW, 7, CULTURE))
    assert both == lists_of(rk.section_lists(articles, NOW, 7)) | {f"for-you:7:{k}": v for k, v in own.items()}
    # filters come before the list is made
    feed = lists_of(rk.ranked_feed(articles, NOW, section="cars", limit=5, make="LOTUS"))
    assert feed == {"cars:5": common_list([r for r in rows if r["primary_category"] in ("cars", None) and "Lotus" in r["makes"]], 5)}
    strict = lists_of(rk.ranked_feed(articles, NOW, profiles, limit=5, strict=rk.matches_profile(["lotus"], [])))
    by_id = {r["id"]: r for r in rows}
    assert strict and all("Lotus" in by_id[i]["makes"] for ids in strict.values() for i in ids)
    assert rk.section_lists(articles.filter("false"), NOW).count() == 0
