"""Each operator against a brute-force version on a small fixture, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import decontaminate as dc
from millrace.llm import html_extract as hx
from millrace.llm import language_id as li
from millrace.llm import license_scan as ls
from millrace.llm import line_dedup as ld
from millrace.llm import ngram_join as nj
from millrace.llm import packing as pk
from millrace.llm import token_tables as tt
from millrace.llm import topk_search as ts
from millrace.llm import url_filter as uf
from millrace.llm._near import Sets, band_hashes, choose_bands, components, intersections, most_similar, profiles
from millrace.llm._shared import scan_ids, scratch
from millrace.llm._tokens import Encoder
from millrace.llm._words import text_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bend at dusk"
OTHER = "una larga carta de papel blanco que nadie ha leído todavía en esta casa vieja cerca del puerto donde los barcos duermen"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


TEXTS = [
    (0, BASE), (1, BASE), (2, BASE.replace("seven", "eight")), (3, OTHER), (4, None), (5, ""), (6, "  \n "), (7, "one"), (8, "One"), (9, "!!! ???"),
    (None, OTHER + " y más"), (10, (BASE + "\n") * 300), (11, "\n".join([BASE, "short", "short", OTHER])), (11, BASE), (12, "CC-BY and cc by, all rights reserved. GENERAL Public LICENSE"),
    (13, "Licensed under the Apache License, Version 2.0."), (14, "x <|endoftext|> y  z\t　w 😀 don't 12 34"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "fr" if "carta" in (t or "") else "en", k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key long").repartition(3, "key").cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def ids_of(text, end):
    t = Tokenizer.from_file(pk.default_tokenizer())
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


# -- 5 and 6 ------------------------------------------------------------------------------------------------------------
def test_packing_is_a_partition(docs, none):
    out = pk.pack(docs, pk.default_tokenizer(), size=64, open_windows=3).collect()
    want = Counter((i, tuple(ids_of(t, 0))) for i, t in TEXTS)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert sum(r.length for r in out) == sum(len(x) * n for (_, x), n in want.items())
    for r in out:
        ids = tuple(np.frombuffer(r.ids, "<u4"))
        assert len(ids) == r.length and any(i == r.doc_id and x[r.start : r.start + r.length] == ids and len(x) == r.doc_tokens for i, x in want)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert pieces[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(pieces, pieces[1:], strict=False))
        assert sum(p.length for p in pieces) <= 64
    padding = sum(64 - sum(p.length for p in ps) for ps in sequences.values())
    assert padding <= 63 + pk.LEAST_CUT * len(sequences)
    assert pk.pack(none, pk.default_tokenizer()).count() == 0


def test_shards_round_trip(spark, docs, none):
    manifest = tt.write_shards(docs, scratch(spark, "test"), pk.default_tokenizer(), shard_bytes=2000)
    out = tt.read_shards(manifest).collect()
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out)
    assert got == Counter((i, tuple(ids_of(t, 2))) for i, t in TEXTS)
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False)) and out[0].start == 0
    asked = [3, 999, None, 11, 3, 0, 14]
    found = tt.lookup(manifest, spark.createDataFrame([(i,) for i in asked], "doc_id long")).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found) == Counter((i, tuple(ids_of(t, 2))) for i, t in TEXTS if i in asked)
    many = spark.createDataFrame([(i // 40, f"copy {i}") for i in range(200)], "doc_id long, text string")
    manifest = tt.write_shards(many, scratch(spark, "test"), pk.default_tokenizer(), shard_bytes=100)
    found = tt.lookup(manifest, spark.createDataFrame([(2,), (4,)], "doc_id long")).collect()
    assert Counter(r.doc_id for r in found) == {2: 40, 4: 40} and len({bytes(r.ids) for r in found}) == 80
    assert tt.read_shards(tt.write_shards(none, scratch(spark, "test"), pk.default_tokenizer())).count() == 0


def test_shards_name_their_file_system(spark, tmp_path):
    assert tt.qualified(spark, str(tmp_path)) == f"file://{tmp_path}" == tt.qualified(spark, f"file:{tmp_path}")
    with pytest.raises(ValueError):
        tt.open_store(str(tmp_path))
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.shelf.link./kept", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://shelf/")
    try:
        # a plain path is one of the default file system, so no task takes it for a folder of its own machine
        assert tt.qualified(spark, "/kept/x") == "viewfs://shelf/kept/x"
        with pytest.raises(Exception, match="(?i)viewfs|scheme|libhdfs"):
            tt.open_store(tt.qualified(spark, "/kept/x"))
    finally:
        conf.set("fs.defaultFS", before or "file:///")


def test_pieces_are_those_of_the_library():
    rng, coder = np.random.default_rng(2), Encoder(pk.default_tokenizer())
    some = ["'", "'s", "'re", "'ll", "s", "t", "re", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "B", "é", "中", "1", "²", "!", "😀", "\u200b", "\x1c", "\x85", "\u0301", "_", "<|endoftext|>", "v", "l", "\ufeff"]
    texts = ["".join(rng.choice(some, rng.integers(0, 14))) for _ in range(5000)] + ["x <|endoftext|> y", "", None, "long " * 300_000]
    texts += ["".join(chr(c) for c in rng.integers(0, 0x3000, 20)) for _ in range(2000)]
    for text, ids in zip(texts, coder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids, text
    assert [x.tolist() for x in coder.encode(pa.array(["x <|endoftext|> y"]))] == [[87, 220, 50256, 331]]
    assert list(coder.encode(pa.array([], pa.string()))) == []


# -- 1 and 4 ------------------------------------------------------------------------------------------------------------
def test_bands_and_components(spark):
    bands, rows = choose_bands(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and bands * rows <= 96
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 20))) for _ in range(20)]
    assert (intersections(sets[:8], sets[8:]) == [[len(set(a) & set(b)) for b in sets[8:]] for a in sets[:8]]).all()
    edges = [(i, i + 1) for i in range(40) if i % 10] + [(100, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got[40] == got[31] == 31 and got[100] == got[10] == 1 and 0 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join_against_brute_force(docs, none):
    sets = []
    for _, t in TEXTS:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    n = len(TEXTS)
    near = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    classes = list(range(n))
    for _ in range(n):
        for i in range(n):
            classes[i] = min([classes[i], *(classes[j] for j in range(n) if near[i][j])])
    got = Counter((r.doc_id, r.class_size, r.n_links) for r in nj.similar_documents(docs).collect())
    assert got == Counter((TEXTS[i][0], classes.count(classes[i]), sum(near[i])) for i in range(n))
    kept = Counter(r.doc_id for r in nj.keep_first(docs).collect())
    assert sum(kept.values()) == len(set(classes)) and kept[0] == 1 and kept[1] == 0 and kept[4] == kept[5] == 1
    assert nj.similar_documents(none).count() == 0


def test_line_dedup_against_brute_force(docs, none):
    order = sorted(((i is None, i or 0, k, at, line) for k, (i, t) in enumerate(TEXTS) if t is not None for at, line in enumerate(t.split("\n"))), key=lambda x: x[:4])
    runs = lambda s: {s[j : j + 5] for j in range(len(s) - 4)} or {s}
    lines = [(k, at, runs(line.strip().lower())) for _, _, k, at, line in order if line.strip()]
    near = [[len(a[2] & b[2]) >= 0.8 * len(a[2] | b[2]) for b in lines] for a in lines[:1]]
    root = list(range(len(lines)))
    firsts: list[int] = []
    for i, a in enumerate(lines):  # texts here form no chains, so comparing with firsts is enough
        for f in firsts:
            if len(a[2] & lines[f][2]) >= 0.8 * len(a[2] | lines[f][2]):
                root[i] = f
                break
        else:
            firsts.append(i)
    assert near
    kept = Counter(lines[i][0] for i in range(len(lines)) if root[i] == i)
    got = {r.key: r for r in ld.dedup_lines(docs.withColumn("n_lines", F.lit("clash"))).collect()}
    for k, (_, t) in enumerate(TEXTS):
        r = got[k]
        if t is None:
            assert r.text is None and (r.n_lines, r.n_dropped) == (0, 0)
            continue
        some = [x for x in t.split("\n") if x.strip()]
        if TEXTS[k][0] != 11 and some and t != BASE:
            assert len(some) - r.n_dropped == kept[k], (k, r)
        assert len([x for x in r.text.split("\n") if x.strip()]) == len(some) - r.n_dropped
    assert sum(len([x for x in (r.text or "").split("\n") if x.strip()]) for r in got.values()) == len(firsts)
    assert ld.dedup_lines(none).count() == 0


def test_row_ids_do_not_follow_the_splits_of_the_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(4000).selectExpr("id", "concat('text ', id) as text").repartition(3).write.parquet(path)
    found = []
    for size, least in (("128m", "1"), ("4k", "37")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        rows = scan_ids(spark.read.parquet(path).filter("id % 3 != 0"), "row").collect()
        assert len({r.row for r in rows}) == len(rows) == 2666
        found.append({r.id: r.row for r in rows})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.minPartitionNum")
    again = spark.read.parquet(path)
    first = ld.dedup_lines(scan_ids(again, "row"), row_id="row", doc_id="id")
    assert found[0] == found[1] and first.columns == ["id", "text", "row", "n_lines", "n_dropped"] and first.count() == 4000


# -- 2 and 3 ------------------------------------------------------------------------------------------------------------
def test_url_rules_and_graph(spark):
    urls = ["https://www.Example.com/en/1", "http://a.example.com/en/", "https://b.example.net/fr/x?q", "https://b.example.net/de/x", "https://c.example.org#top", "no url", None, "https://d.org/a", "https://e.org/"]
    html = [None, "", "", "", "", "", "", '<a href="https://b.example.net/de/x">', '<a href="//www.example.com/en/1">']
    pages = spark.createDataFrame([(i, u, h, "extra") for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame(uf.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(pages, rules).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("b.example.net", "/fr/x", "net/fr/", "block")
    assert got[3][2:] == (None, "block")  # the host's other page is blocked
    assert got[4] == ("c.example.org", "", None, "allow")
    assert got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7][3] == "block" and got[8][3] == "allow"  # links to a blocked host; to an allowed one
    assert uf.judge(pages.filter("false"), rules).count() == 0


def test_line_dedup_joins_lines_with_one_changed_character(spark):
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 58)) for _ in range(40)]
    lines = ["x" + line + "y" for line in lines]
    texts = ["\n".join(lines), "\n".join(line[:30] + "#" + line[31:] for line in lines)]  # J = (60 - 9) / (60 + 1) on runs of 5
    got = {r.doc_id: r.n_dropped for r in ld.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 40}


def test_pagerank_against_the_solved_equations(spark):
    """Also on a chain that twenty rounds would not walk to its end."""
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("a", "c", 2.0), ("c", "d", 1.0), ("d", "k00", 1.0)] + [(f"k{i:02}", f"k{i + 1:02}", 1.0) for i in range(30)]
    ranks = uf.personalised_pagerank(spark.createDataFrame(edges, "src string, dst string, weight double").coalesce(1), spark.createDataFrame([("a", 2.0), ("k00", 1.0)], "node string, mass double").coalesce(1), tolerance=1e-5)
    got = {r["node"]: r["rank"] for r in ranks.collect()}
    names = sorted({x for s, d, _ in edges for x in (s, d)})
    m, seed = np.zeros((len(names), len(names))), np.zeros(len(names))
    for s, d, w in edges:
        m[names.index(d), names.index(s)] += w
    seed[names.index("a")], seed[names.index("k00")] = 2 / 3, 1 / 3
    m[:, m.sum(0) == 0] = seed[:, None]
    want = np.linalg.solve(np.eye(len(names)) - 0.85 * m / m.sum(0), 0.15 * seed)
    assert all(abs(got[x] - want[i]) < 1e-4 for i, x in enumerate(names)) and got["k30"] > 0.0006  # twenty rounds would not get there
    with pytest.raises(RuntimeError):
        uf.personalised_pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 2.0)], "node string, mass double"), most_rounds=8)


def test_url_rules_against_brute_force(spark):
    rng = np.random.default_rng(4)
    hosts, paths = ["com", "example.com", "www.example.com", "a.b.example.com", "example.net", "net", "x.net", "org", ""], ["", "/", "/en/", "/en/1", "/es/", "/es", "/fr/x/y"]
    rules = [(h, p, v) for h in ("com", "example.com", "b.example.com", "net") for p in ("/", "/en/", "/es/") for v in ("allow", "block") if rng.random() < 0.5]
    urls = [(h, p) for h in hosts for p in paths] * 2
    frame = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate(urls)], "i long, host string, path string")
    got = {r.i: (r.rule, r.rule_verdict) for r in uf.match_rules(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, (h, p) in enumerate(urls):
        fit = sorted((-len(a + b), a + b, v != "block", v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b))
        assert got[i] == ((fit[0][1], fit[0][3]) if fit else (None, None)), (h, p)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 5), 2)], i % 2) for i in range(150)]
    rows += [(200, None, 0), (201, [0.1, None, 0.2, 0.0, 0.0], 0), (202, [float("nan")] * 5, 0), (203, [], 0), (100, rows[7][1], 1), (None, [1.0] * 5, 0), (204, [1.0, 2.0], 0)]
    rows += [(205, [3e6, 0.0, 0.0, 0.0, 0.5], 0), (206, [2.0**53, -1.0, 0.0, 0.0, 0.0], 0), (207, [1e300, 0.0, 0.0, 0.0, 0.0], 0), (250, [-1e308, 1.0, 0.0, 0.0, 0.25], 0), (208, [float("inf")] * 5, 0)]
    rows += [(300, [0.0] * 5, 0)] + [(301 + i, [0.5, 0.0, 0.0, 0.0, 0.0], 0) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = defaultdict(list)
    for r in ts.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    good = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = defaultdict(list)
    for q, v in good:
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:5]
            want[q] += [(k + 1, min(2**63 - 1, max(-(2**63), -s)), i) for k, (s, i) in enumerate(scores)]
    assert len(want[100]) == 10 and [i for _, _, i in want[300]] == [0, 1, 2, 3, 4]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items() if x}
    assert ts.search(df.filter("false"), df.filter("false")).count() == 0


def test_topk_strips_of_any_size_give_the_same(spark, monkeypatch):
    """Small blocks, one or many of them in a strip; columns with the operator's own names; very long vectors."""
    rng = np.random.default_rng(8)
    vectors = [(i, rng.integers(-9, 9, 6) / 16) for i in range(300)] + [(1000 + i, rng.integers(-9, 9, 20_000) / 16) for i in range(12)]
    rows = [(i, v.tolist(), 1, "x", True) for i, v in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block long, strip string, wide boolean").repartition(3)
    want = set()
    for q, v in vectors[::10]:
        scores = sorted((-int(np.floor(256 * v).astype(np.int64) @ np.floor(256 * w).astype(np.int64)), i) for i, w in vectors if i != q and len(w) == len(v))
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])}
    asked = df.filter(F.col("vec_id").isin([q for q, _ in vectors[::10]]))
    monkeypatch.setattr(ts, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ts, "QUERY_ROWS", 4)
    for block, strip in ((600, 1), (1 << 20, 1 << 20)):
        monkeypatch.setattr(ts, "BLOCK_BYTES", block)
        monkeypatch.setattr(ts, "STRIP_BYTES", strip)
        assert {tuple(r) for r in ts.search(df, asked).select("query_id", "rank", "vec_id", "score").collect()} == want


# -- 7 to 10 ------------------------------------------------------------------------------------------------------------
def test_language_id_learns_and_rejects(spark):
    en = "the and with from this river house garden people water morning evening".split()
    fr = "le et avec dans cette rivière maison jardin gens eau matin soirée".split()
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(en if i % 2 else fr, 30)), "en" if i % 2 else "fr", 1) for i in range(240)]
    rows += [(900, None, "en", 1), (901, "", "en", 1), (902, "123 !!", None, 1), (903, "the house and the river", None, 1), (None, "la maison et la rivière", "fr", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = li.train(df.filter(F.col("doc_id").isNotNull() & ~li.held_out()))
    got = [(r.doc_id, r.lang, r.lang_pred, r.score) for r in li.identify(df, model).collect()]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    assert [r.h for r in df.select(li.held_out().alias("h")).collect()] == [h if i is not None else False for h, (i, *_) in zip(held, rows, strict=True)]
    known = [g for g, h in zip(got, held, strict=True) if g[1] and h and g[2] != "und"]
    assert sum(g[1] == g[2] for g in known) >= 0.95 * len(known) and all(0 <= g[3] <= 1 for g in got)
    by = {g[0]: g for g in got}
    assert by[900][2:] == by[901][2:] == by[902][2:] == ("und", 0.0) and by[903][2] == "en" and by[None][2] == "fr"
    empty = li.train(df.filter("false"))
    assert {r.lang_pred for r in li.identify(df, empty).collect()} == {"und"} and li.identify(df.filter("false"), empty).count() == 0


def test_temperature_undoes_overconfidence():
    rng = np.random.default_rng(12)
    logits = rng.normal(0, 2, (20_000, 4))
    chance = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = (chance.cumsum(1) > rng.random((len(chance), 1))).argmax(1)
    loss = lambda z, t: np.mean([np.log(np.exp(row / t - max(row / t)).sum()) + max(row / t) - row[y] / t for row, y in zip(z, labels, strict=True)])
    for scale in (0.25, 1.0, 4.0):
        found = li.temperature_for(logits * scale, labels)
        assert abs(found / scale - 1) < 0.1
        assert loss(logits * scale, found) <= min(loss(logits * scale, found * f) for f in (0.8, 1.25))
    assert li.temperature_for(np.zeros((0, 3)), np.zeros(0, int)) == 1.0
    assert li.temperature_for(np.array([[2.0, 0.0]] * 5), np.zeros(5, int)) == 2.0**-5  # never wrong: as sure as can be
    assert li.temperature_for(np.array([[2.0, 0.0]] * 5), np.ones(5, int)) == 2.0**5  # never right


def greedy(item, text, least):
    """Greedy string tiling, word by word."""
    mi, mt, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and i + n not in mi and t + n not in mt:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        if best[0] < least:
            return total
        n, i, t = best
        mi |= set(range(i, i + n))
        mt |= set(range(t, t + n))
        total += n


def test_tiles_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, n)).astype(np.uint64) for n in (25, 40))
        least = int(rng.integers(2, 6))
        assert sum(n for _, _, n in dc.tiles(a, b, least)) == greedy(a.tolist(), b.tolist(), least)
    words = rng.integers(0, 1 << 60, 4000).astype(np.uint64)
    began = time.time()
    assert sum(n for _, _, n in dc.tiles(words, np.concatenate([words[i : i + 20] for i in range(3980, -1, -20)]))) == 4000
    assert dc.tiles(np.ones(4000, np.uint64), np.ones(3000, np.uint64)) == [(0, 0, 3000)] and time.time() - began < 2


def test_decontamination_against_brute_force(spark):
    items = [(1, BASE), (2, OTHER), (3, "too short"), (6, "zz yy xx"), (7, "zz yy xx ww"), (4, None), (5, "aa bb cc dd ee " * 12 + OTHER)]
    half = BASE.split()
    texts = ["lead in. " + BASE.upper() + " and out", " ".join(half[12:] + ["x"] + half[:12]), " ".join(half[:9]), OTHER, None, "", "nothing here at all of the kind", "aa bb cc dd ee aa bb cc dd ee " * 8, (OTHER + " ") * 50, "before ZZ, yy: xx - after", "zz yy and xx"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for i, x in items:
            a, b = words(x), words(t)
            if len(a) >= 3 and greedy(a, b[:200], min(5, len(a))) >= 0.6 * len(a):
                want.add((d, i))
    for limit in (1 << 20, 0):
        assert {(r.doc_id, r.item_id) for r in dc.matches(docs, bench, broadcast_bytes=limit).collect()} == want
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert dc.matches(docs.filter("false"), bench).count() == 0 and dc.matches(docs, bench.filter("false")).count() == 0


def test_html_extraction(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav><div class="ad">Buy now</div>
    <article><header>By me</header><h1>Head &amp; line</h1><p>First <b>bold</b>ed.<br>Next&nbsp;row</p><aside>side</aside><p>Second</p><ul><li>one</li><li>two</li></ul></article>
    <div id="comments"><p>me too</p></div><script>var a="</p>";</script><footer>&copy; x</footer></body></html>"""
    rows = [(1, page, "z"), (2, None, "z"), (3, "", "z"), (4, "plain words only", "z"), (5, "<p>cut &am", "z"), (1, page, "z"), (6, "<nav>only menu</nav>", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {r.page_id: r.text for r in hx.extract(df).collect()}
    assert got[1] == "Head & line\n\nFirst bolded. Next row\n\nSecond\n\none\n\ntwo"
    assert got[2] == got[3] == got[6] == "" and got[4] == "plain words only" and got[5] == "cut &am"
    assert hx.extract(df.filter("false")).count() == 0


def test_license_scan_against_brute_force(docs, none):
    got = {r.key: r for r in ls.scan(docs.withColumn("n_words", F.lit("clash"))).collect()}
    for k, (_, t) in enumerate(TEXTS):
        w, want = words(t), []
        for phrase, label in ls.BASE_PHRASES.items():
            p = phrase.split()
            want += [(label, i) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        assert got[k].n_words == len(w) and sorted((x.label, x.start) for x in got[k].places) == sorted(want)
    assert [(m.label, m.start, m.score) for m in got[15].matches] == [("apache-2.0", 0, 1.0)] and got[0].matches == []
    assert ls.scan(none).count() == 0


def test_license_scan_finds_each_of_many_notices(spark):
    notices = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "released under the MIT license", "licensed under CC BY NC 4.0", "licensed under the Apache License, Version 2.0", "This work is licensed under the GNU General Public License version 3"]
    every = " ".join(w for t in ls.TEMPLATES for w in t[1].split()[::-1])  # all licence words, but no phrase
    texts = ["; ".join(notices), (every + " x ") * 2000 + "; ".join(notices[1:3]), "permission is hereby granted free of charge", *notices[1:3] * 20, *["nothing of the kind"] * 40]
    got = {r.doc_id: {m.label: m.score for m in r.matches} for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == dict.fromkeys(["apache-2.0", "bsd", "cc-by-nc", "gpl", "mit"], 1.0)
    assert got[1] == {"cc-by-nc": 1.0, "mit": 1.0} and got[2] == {}  # a part of a notice is none


def test_licences_in_prose_changed_notices_ties_and_repeats(spark):
    none = "a quiet story of the river and the sea, told in the old way of the house"
    texts = [
        "we do not like the mit license at all", "permission is hereby granted free of charge to enter the park", "the boost software license was discussed in the pub",  # mentions in prose
        "Released, as ever, under the MIT License.", "Licensed under the Apache License, Version 2.0", "This work was licensed under the great GNU General Public License, version 3",  # words put in or changed
        "released under the mit license " * 2, "x " * 7 + "licensed under the mit license and released under the mit license", None, "",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] + [(100 + i, none) for i in range(300)]
    found = ls.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {r.doc_id: {m.label: m.start for m in r.matches} for r in found}
    assert [got[i] for i in range(10)] == [{}, {}, {}, {"mit": 2}, {"apache-2.0": 0}, {"gpl": 1}, {"mit": 0}, {"mit": 7}, {}, {}]  # where most words stand
    assert len({str(r.matches) for r in found if r.doc_id == 3}) == 1 and sum(r.doc_id == 3 for r in found) == 2


def test_licence_labels_follow_the_idf(spark):
    text, template = "alpha beta gamma delta epsilon", [("x", "alpha beta gamma delta zeta", [])]
    other = lambda words, n: [(i + 1, words) for i in range(n)]
    seen = lambda rows: [m.label for m in next(r for r in ls.scan(spark.createDataFrame([(0, text), *rows], "doc_id long, text string"), {}, template).collect() if r.doc_id == 0).matches]
    assert seen(other("zeta and more", 60)) == ["x"]  # the word that is missing is common
    assert seen(other("alpha beta gamma delta", 60)) == []  # the words that are there are common


FRENCH = "l’été dernier à Étretat — où les élèves de l’école déjà fermée s’étaient réunis près de l’église — on a dîné à côté du château"
CHINESE = "从前有一座山山上有一座庙庙里有一个老和尚在给小和尚讲故事他说今天的天气真好我们应该去河边走一走看看那些新开的花"


def test_words_of_any_script_and_case(spark):
    typewriter = FRENCH.replace("’", "'").replace(" — ", " - ").upper()
    texts = [FRENCH, typewriter, CHINESE, CHINESE[:-1] + "草", CHINESE[:2] + "。" + CHINESE[2:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nj.similar_documents(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2}
    bench = spark.createDataFrame([(1, FRENCH), (2, CHINESE[5:40])], "item_id long, text string")
    for limit in (1 << 20, 0):
        assert {(r.doc_id, r.item_id) for r in dc.matches(docs, bench, broadcast_bytes=limit).collect()} == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 2)}


def test_html_layout_wrappers_stay(spark):
    text = " ".join(f"word{i}" for i in range(60))
    article, plain = f"<article><p>{text}</p></article>", f"<div><p>{text}</p></div>"
    openings = ['class="page has-sidebar"', 'class="content-with-sidebar"', 'class="no-comments"', 'class="related-layout"', 'id="header-and-content"', 'class="social"']
    pages = [f"<body><div {x}>{inner}<div class=ad>buy now</div></div></body>" for x in openings for inner in (article, plain)]
    pages.append(f'<body><div id="post-comments"><p>{"me too " * 20}</p></div>{article}<div class="site-footer">{"links " * 30}</div></body>')
    pages.append(f'<body><article><div class="post-comments"><p>{"me too " * 20}</p></div><p>{text}</p></article></body>')
    pages.append(f'<body>{article}<div class="comments"><p>me too</p></div><div class="comments-area"><p>and me</p></div></body>')
    got = [r.text for r in hx.extract(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), weights={}).orderBy("page_id").collect()]
    assert got == [text] * len(pages)
    page = f'<article><div class="entry-header"><h1>A headline</h1></div><p>{text}</p></article>'
    assert hx.main_text(page, {}) == f"A headline\n\n{text}"


def test_html_articles_bound_the_text():
    text = " ".join(f"word{i}" for i in range(60))
    own = lambda page: hx.main_text(page, {}).split("\n\n")
    assert own(f"<form id=f><article><h1>Head</h1><p>{text}</p></article></form>") == ["Head", text]
    assert own(f"<form><p>{text}</p></form>") == [text] and own("<form><label>Name</label><input></form>") == [""]
    assert own(f"<article><header><h1>Its own</h1></header><p>{text}</p></article>") == ["Its own", text]
    assert own(f"<header><h1>The site</h1></header><article><p>{text}</p></article>") == [text]
    inner = '<div class="story-header"><h2>Head</h2><p>Standfirst</p></div><p class="share-price">up 3</p><div class="share-buttons">Share</div>'
    assert own(f"<article>{inner}<p>{text}</p></article>") == ["Head", "Standfirst", "up 3", text]
    cells = [str(i) for i in range(12)]
    table = "<table>" + "".join(f"<tr><td>{c}</td></tr>" for c in cells) + "</table>"
    after = f'<div>Imprint and terms of use</div><div class="x7ab">{text[:120]}</div><div class="discussion"><p>{text[:100]}</p></div>'
    assert own(f"<article><p>{text}</p>{table}</article>{after}") == [text, *cells]
    assert own(f"<main><h1>Head</h1><article><p>{text}</p></article><div>{text[:120]}</div></main>") == ["Head", text]
    assert own(f"<main><p>{text}</p><article>card</article><p>{text}</p></main><div>{text[:120]}</div>") == [text, "card", text]
    assert own(f'<article><p>{text}</p><article class="comment"><p>{text}</p></article></article>') == [text]
    assert own(f"<div><p>{text}</p></div><div><article>card of two</article></div>")[0] == text  # too small to bound the text


def test_html_names_are_learned_from_labelled_pages(spark):
    text, side = " ".join(f"word{i}" for i in range(60)), " ".join(f"side{i}" for i in range(30))
    rows = [f'<article class="story"><p class="lead">{text}</p></article><div class="zone-q">{side}</div>'] * hx.NAME_PAGES
    rows += [f'<div class="story"><p class="lead">{text}</p><div class="zone-q">{side}</div></div>', f'<div class="zone-q"><p>{text}</p></div>']
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, html string").repartition(5)
    weights = hx.tag_weights(pages)
    assert [k for k in weights if k[0] == "."] == [".zone-q"]
    got = {r.page_id: r.text for r in hx.extract(pages).collect()}
    assert set(got.values()) == {text}  # a part that holds most of a page is its layout
    few = pages.filter(F.col("page_id") > 0)
    assert not [k for k in hx.tag_weights(few) if k[0] == "."] and side in {r.page_id: r.text for r in hx.extract(few).collect()}[hx.NAME_PAGES]


def test_html_pages_built_from_known_parts(spark):
    """Random pages of parts whose main text is known from how they were built; very long ones too."""
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 99, n))
    kept = [
        lambda t: (f"<p>{t}", [t]), lambda t: (f"<h2 id=x>{t}</h2>", [t]), lambda t: (f"<ul><li>{t}<li>{t}</ul>", [t, t]), lambda t: (f"<table><tr><td>{t}<td>a</table>", [t, "a"]),
        lambda t: (f"<blockquote>&ldquo;{t}&rdquo;</blockquote>", ["\u201c" + t + "\u201d"]), lambda t: (f"<div class=body-text><b>{t}</b> <i>x</i><br>y</div>", [t + " x y"]), lambda t: (f"<p>\n  {t}&nbsp;\t1 &lt; 2</p>", [t + " 1 < 2"]),
    ]
    lost = ["<nav><a>{}</a></nav>", "<div class='ad'>{}</div>", "<aside>{}</aside>", "<form>{}</form>", "<div id=comments><p>{}</div>", "<script>{}</script>", "<footer>{}</footer>", "<!-- {} -->", "<div class='cookie-notice'>{}</div>"]
    pages, want = [], []
    for i in range(80):
        inner, texts = f"<h1>{words(4)}</h1>", []
        texts.append(inner[4:-5])
        for _ in range(rng.integers(1, 12) if i else 20_000):
            part, found = kept[rng.integers(len(kept))](words(rng.integers(1, 9)))
            inner, texts = inner + part, texts + found
            if i and rng.random() < 0.3:
                inner += lost[rng.integers(len(lost))].format(words(3))
        around = lambda: "".join(lost[k].format(words(5)) for k in rng.integers(0, len(lost), 3))
        box = "article" if rng.random() < 0.7 else "main"
        pages.append(f"<!doctype html><html><head><title>{words(3)}</title></head><body>{around()}<{box}>{inner}</{box}>{around()}<div>{words(6)}</div></body></html>")
        want.append("\n\n".join(texts))
    rows = [(i, h) for i, h in enumerate(pages)] + [(1, pages[1])]
    found = hx.extract(spark.createDataFrame(rows, "page_id long, html string").repartition(4)).collect()
    assert len(found) == len(rows) and all(r.text == want[r.page_id] for r in found)


def test_html_malformed_pages():
    assert hx.main_text('Hello <a title="x>link</a> and <b>more', {}) == "Hello link and more"
    assert hx.main_text("<p a'b=c\">quotes \"in\" names</p>", {}) == 'quotes "in" names'
    assert hx.main_text("<p>1 < 2 <!-- no --> and <!--> 3</p><!-- open <p>gone", {}) == "1 < 2 and 3"
    assert hx.main_text("<p>same size here</p><script>x</script><p>same size too</p>", {"p": -9.0, "/p": -9.0}) == "same size here"  # of equal regions the first
    for part in ('<a title="', "<a title='x>", '<p class="x" "', "<", "<!--", "<div>", "</div>", "<script>", "<p x="):
        began = time.time()
        hx.main_text(part * (1_000_000 // len(part)), {})
        assert time.time() - began < 10, part


# -- recall, chains, ties, clashes ----------------------------------------------------------------------------------------
def test_bands_keep_the_recall_they_promise():
    """Pairs of sets whose similarity is the threshold exactly, and unlike pairs: how many share a band."""
    rng = np.random.default_rng(8)
    for bands, rows, least in ((*choose_bands(0.8, 0.995, 108), 0.99), (*choose_bands(0.8, 0.995), 0.99)):
        for size in (20, 300):
            sets = []
            for _ in range(1500):
                both = rng.integers(0, 1 << 63, size).astype(np.uint64)
                n = size // 8  # (size - n) / (size + n) with n = size / 9 would be 0.8; size / 8 is a little less alike
                own = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
                sets += [np.concatenate([both, own[:n]]), np.concatenate([both, own[n:]])]
            sizes = [len(s) for s in sets]
            made = band_hashes(np.concatenate(sets), np.cumsum([0, *sizes]), bands, rows)
            like, unlike = (made[0::2] == made[1::2]).any(axis=1).mean(), (made[0::2] == np.roll(made[1::2], 1, axis=0)).any(axis=1).mean()
            true = size / (size + 2 * (size // 8))
            assert like >= 1 - (1 - true**rows) ** bands - 0.01 and unlike < 0.01, (bands, rows, size, like)
    assert 1 - (1 - 0.8**6) ** 18 >= 0.995


def test_profiles_never_rule_out_a_pair():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 4000, rng.integers(1, n)).astype(np.uint64)) for n in (5, 50, 500, 3000) for _ in range(12)]
    packed = Sets(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    rows, sizes = profiles(packed), packed.sizes
    for i in range(len(sets)):
        bound = most_similar(rows, np.repeat(rows[i : i + 1], len(sets), axis=0), sizes, np.full(len(sets), sizes[i]))
        for j in range(len(sets)):
            assert bound[j] >= len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) - 1e-12


def letters(rng, n):
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n)).replace("  ", "xq").strip() + "z"


def test_line_dedup_follows_chains_and_settles_ties(spark):
    """A line and its further and further changed copies are one component, though its ends are unlike; the least (doc_id, row, place) stays."""
    rng = np.random.default_rng(11)
    line, chain = letters(rng, 120), []
    for k in range(6):
        chain.append(line)
        line = line[: 18 * k] + letters(rng, 3)[:4] + line[18 * k + 4 :]
    runs = lambda s: {s[j : j + 5] for j in range(len(s) - 4)}
    like = lambda a, b: len(runs(a) & runs(b)) / len(runs(a) | runs(b))
    assert all(like(a, b) >= 0.8 for a, b in zip(chain, chain[1:], strict=False)) and like(chain[0], chain[-1]) < 0.8
    rows = [(5 + (3 * k) % 6, f"{c}\n  \nown line {k} {letters(rng, 40)}", k, "clash") for k, c in enumerate(chain)] + [(5, chain[0], 9, "clash"), (None, chain[0].upper() + "  ", 10, "clash"), (99, "", 11, "clash"), (98, "\n\n", 12, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long, dropped string").coalesce(1)
    got = {r.k: r for r in ld.dedup_lines(docs).collect()}
    kept = [k for k in got if any(line.strip().lower() in chain for line in (got[k].text or "").split("\n") if line.strip())]
    assert kept == [0] and all(r.dropped == "clash" for r in got.values()) and got[10].text == "" and got[10].n_dropped == 1
    assert (got[11].text, got[11].n_lines, got[12].text, got[12].n_lines) == ("", 1, "\n\n", 3)
    assert all("own line" in got[k].text and got[k].n_lines == 3 for k in range(6))


def test_line_dedup_of_very_long_and_many_like_lines(spark):
    rng = np.random.default_rng(12)
    base = letters(rng, 90)
    swarm = [base[:i] + "#" + base[i + 1 :] for i in range(10, 80)]  # all like one another
    long = letters(rng, 200_000)
    texts = ["\n".join(swarm[i::7]) for i in range(7)] + [long, long[:100_000] + "!!" + long[100_000:], "x"]
    got = {r.doc_id: r.n_dropped for r in ld.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(7)) == len(swarm) - 1 and got[0] == len(swarm[0::7]) - 1 and (got[7], got[8], got[9]) == (0, 1, 0)


def test_ngram_join_follows_long_chains(spark):
    rng = np.random.default_rng(13)
    words_ = [letters(rng, 6).replace(" ", "") for _ in range(90)]
    texts = []
    for k in range(25):
        texts.append(" ".join(words_))
        words_ = [*words_[:3 * k], f"new{k}", *words_[3 * k + 1 :]]
    docs = spark.createDataFrame([(100 - k, t, "x") for k, t in enumerate(texts)] + [(None, texts[3], "x"), (1, "of its own", "x")], "doc_id long, text string, class_id string")
    got = nj.similar_documents(docs).collect()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(86)} for t in texts]
    near = [[i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert {r.doc_id: (r.class_id, r.class_size) for r in got if r.doc_id not in (None, 1)} == {100 - k: (76, 26) for k in range(25)}
    assert {r.doc_id: r.n_links for r in got if r.doc_id not in (None, 1)} == {100 - k: sum(near[k]) + (k == 3) + near[k][3] for k in range(25)}


def test_ftrl_against_a_plain_version():
    rng = np.random.default_rng(14)
    rows = [(np.sort(rng.choice(30, 5, replace=False)), rng.random(5), int(rng.integers(3))) for _ in range(60)]
    leader = li.FollowTheLeader(3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, c):
        if abs(z[f, c]) <= li.L1:
            return 0.0
        return -(z[f, c] - math.copysign(li.L1, z[f, c])) / ((li.BETA + math.sqrt(n[f, c])) / li.ALPHA + li.L2)

    for used, x, label in rows:
        leader.learn(used, x, label)
        cells = [*zip(used.tolist(), x.tolist(), strict=True), (li.BUCKETS, 1.0)]
        scores = [sum(weight(f, c) * v for f, v in cells) for c in range(3)]
        total = sum(math.exp(s) for s in scores)
        old = {(f, c): weight(f, c) for f, _ in cells for c in range(3)}
        for c in range(3):
            error = math.exp(scores[c]) / total - (c == label)
            for f, v in cells:
                g = error * v
                z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / li.ALPHA * old[f, c]
                n[f, c] += g * g
    made = leader.weights()
    assert all(abs(made[f, c] - weight(f, c)) < 1e-9 for f in [*range(30), li.BUCKETS] for c in range(3)) and (made[30 : li.BUCKETS] == 0).all()


def test_language_id_of_long_texts_ties_and_clashes(spark):
    rows = [(i, "aaa bbb" if i % 2 else "ccc ddd", "x" if i % 2 else "y", "old") for i in range(60)] + [(100, "aaa bbb " * 200_000, None, "old"), (100, "ccc ddd", None, "old"), (101, "éé", None, "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in li.identify(df, li.train(df)).collect() if r.doc_id >= 100]
    assert sorted(got[:2]) == [(100, "x"), (100, "y")] and got[2][1] in ("x", "y")
    flat = li.Model(["b", "c"], np.ones(li.BUCKETS), np.zeros((li.BUCKETS + 1, 2)))
    assert flat.predict("any text") == ("b", 0.5)  # of equals the first by name


def test_license_templates_against_brute_force(spark):
    rng = np.random.default_rng(15)
    notices = [t[1].split() for t in ls.TEMPLATES]
    vocabulary = sorted({w for n in notices for w in n}) + ["other", "words"]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.integers(0, 4)):
            n = list(notices[rng.integers(len(notices))])
            if rng.random() < 0.5:
                n[rng.integers(len(n))] = str(rng.choice(vocabulary))
            if rng.random() < 0.3:
                n = n[rng.integers(0, 3) :]
            if rng.random() < 0.4:
                n.insert(rng.integers(len(n) + 1), "other")
            parts += [str(x) for x in rng.choice(vocabulary, rng.integers(0, 8))] + n
        texts.append(" ".join(parts).upper())
    got = {r.doc_id: {m.label: (m.score, m.start) for m in r.matches} for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    words_of = [t.lower().split() for t in texts]
    idf = lambda w: math.log((len(texts) + 1) / (sum(w in x for x in words_of) + 1))
    hashes = {w: int(text_words(w)[0]) for w in vocabulary}
    for d, w in enumerate(words_of):
        want = {}
        for label, notice, keys in ls.TEMPLATES:
            notice, keys = notice.split(), [k.split() for k in keys]
            rare = sorted(set(notice), key=lambda x: (-idf(x), hashes[x]))[: ls.INDEXED_WORDS]
            weight = {x: idf(x) for x in rare if idf(x) >= ls.LEAST_WEIGHT * idf(rare[0])}
            posted = [(p, x) for p, x in enumerate(notice) if x in weight]
            whole = sum(weight[x] for _, x in posted)
            at = defaultdict(list)  # start -> places of the template that stand there
            for i, x in enumerate(w):
                for p, y in posted:
                    if x == y:
                        at[i - p].append(p)
            for begin in at:
                near = [s for s in at if begin <= s <= begin + ls.SLACK]
                share = round(min(1.0, sum(weight[notice[p]] for p in {p for s in near for p in at[s]}) / whole), 9)
                start = max(near, key=lambda s: (round(sum(weight[notice[p]] for p in at[s]), 9), -s))
                place = lambda k: start + next(i for i in range(len(notice)) if notice[i : i + len(k)] == k)  # noqa: B023, E731
                if share >= ls.LEAST_SHARE - 1e-9 and all(any(i >= 0 and w[i : i + len(k)] == k for i in range(place(k) - ls.SLACK, place(k) + ls.SLACK + 1)) for k in keys):
                    want[label] = max(want.get(label, (-1, 0)), (share, -max(start, 0)))
        assert got[d] == {label: (share, -start) for label, (share, start) in want.items()}, texts[d]


def test_html_scan_against_brute_force():
    """The region is the best of all, whatever the weights; of equals, the first, then the longest."""
    rng = np.random.default_rng(16)
    for _ in range(60):
        parts = [f"<{t}>{' '.join(['w'] * rng.integers(0, 4))}" if rng.random() < 0.8 else f"</{t}>" for t in rng.choice(["p", "div", "li", "b"], 12)]
        weights = {x: float(rng.choice([-2.0, -1.0, -0.5])) for t in ("p", "div", "li", "b") for x in (t, "/" + t)}
        row: list[tuple[float, str | None]] = []
        block = ""
        for kind, value, _ in [*hx.items("".join(parts)), ("block", "end", False)]:
            if kind == "text":
                block += value
                continue
            if kind != "tag" and block.strip():
                row.append((float(len(block.split())), " ".join(block.split())))
            block = "" if kind != "tag" else block
            if value != "end":
                row.append((weights[value], None))
        sums = [(sum(s for s, _ in row[i:j]), -i, j) for i in range(len(row)) for j in range(i, len(row) + 1)]
        best = max(sums, default=(0, 0, 0))
        texts = [t for _, t in row[-best[1] : best[2]] if t] if best[0] > 0 else []
        found = hx.main_text("".join(parts), weights)
        assert sum(len(x.split()) for x in found.split("\n\n") if x) == sum(len(x.split()) for x in texts) and (not texts or found.split("\n\n")[0] == texts[0])
