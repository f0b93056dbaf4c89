"""Names in texts: the trie against one pattern for each alias, and entities against the rules applied one by one."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import classify as cl
from millrace.operators import gazetteer as gz

PARTS = ["golf", "gti", "911", "964", "m3", "rs", "é", "tron", "e.tron", "xé", "2.7", "a", "clio", "'s", "(x)", "s", "r5", "+"]
JOINS = [" ", "-", "  ", " - ", "", ".", ",", "\n", "’", " ", "S", "é", "/"]


def some_text(rng, n=30):
    return "".join(rng.choice([rng.choice(PARTS), rng.choice(PARTS).upper(), rng.choice(JOINS)]) + rng.choice(JOINS) for _ in range(rng.randint(0, n)))


def some_aliases(rng, n):
    return {rng.choice([" ", "-", "", " "]).join(rng.choice(PARTS) for _ in range(rng.randint(1, 3))) for _ in range(n)}


def plainly(patterns, text):
    return {a for a, p in patterns.items() if p.search(gz.folded(text))}


def test_trie_finds_what_each_pattern_finds():
    rng = random.Random(1)
    aliases = some_aliases(rng, 6000) | {"Golf GTI", "911", "lone-", "E-Tron", "c’est"} | {f"model {i}" for i in range(3000)}
    assert len(aliases) > 5000
    trie, patterns = gz.AliasTrie(aliases), {a: re.compile(cl.token_pattern(a)) for a in aliases}
    texts = [some_text(rng) for _ in range(150)] + ["", "model 7 model 12s", "911s 9110 x911", "the lone ranger", "GOLF--gti", "c'est un e tron"]
    for text in texts:
        assert {trie.aliases[n] for n in trie.find(gz.folded(text))} == plainly(patterns, text), text


def test_cost_does_not_follow_the_number_of_aliases():
    rng = random.Random(2)
    text = gz.folded(" ".join(rng.choice(["w%d" % rng.randint(0, 5000), "the", "of"]) for _ in range(60_000)))

    def took(n):
        trie = gz.AliasTrie({f"w{i} the w{i}" for i in range(n)})
        times = []
        for _ in range(5):
            began = time.process_time()
            trie.find(text)
            times.append(time.process_time() - began)
        return min(times)

    assert took(20_000) < 4 * took(200) + 0.05


def some_gazetteer(rng, n):
    pick = lambda k: sorted(rng.choice(PARTS) + rng.choice(["", " "]) + rng.choice(PARTS) for _ in range(rng.randint(0, k)))
    rows = []
    for i in range(n):
        models = [{"name": f"{rng.choice(PARTS)}{i if i % 3 else ''}", "aliases": pick(2), "generations": pick(2), "variants": pick(2), "generation_implies_model": rng.random() < 0.5} for _ in range(rng.randint(0, 4))]
        rows.append({"make": f"{rng.choice(PARTS)} {rng.choice(PARTS)}", "make_aliases": pick(2), "models": models})
    special = [{"model": m["name"], "name": "Special", "needles": pick(2) + ["rs"], "confidence": 77} for r in rows for m in r["models"][:1]]
    return rows, special


def entities_plainly(rows, special, title, body):
    """Every rule of every make and model, by patterns."""
    head = gz.folded(title)
    text = f"{head} {gz.folded(body)}"
    has = lambda where, names: any(re.search(cl.token_pattern(n), where) for n in names)
    out = []
    for row in rows:
        own, models = [row["make"], *row["make_aliases"]], []
        for m in row["models"]:
            names, seen = [m["name"], *m["aliases"]], [g for g in m["generations"] if has(text, [g])]
            if has(text, names):
                if not (has(text, own) or m["generation_implies_model"] or seen):
                    continue
                sure = 86
            elif seen and m["generation_implies_model"]:
                sure = 82
            else:
                continue
            models.append(("model", m["name"], row["make"], m["name"], (seen or [None])[0], has(head, [*names, *seen]), sure))
            models += [("generation", g, row["make"], m["name"], g, has(head, [g]), 90) for g in seen]
            models += [("variant", v, row["make"], m["name"], None, has(head, [v]), 80) for v in m["variants"] if has(text, [v])]
            models += [("variant", s["name"], row["make"], m["name"], None, has(head, s["needles"]), s["confidence"]) for s in special if s["model"] == m["name"] and s["name"] not in m["variants"] and has(text, s["needles"])]
        if has(text, own) or models:
            out += [("make", row["make"], row["make"], None, None, has(head, own), 92 if has(text, own) else 80), *models]
    return out


def test_entities_against_the_rules_one_by_one(spark):
    rng = random.Random(3)
    rows, special = some_gazetteer(rng, 40)
    texts = [(i, some_text(rng, 6), some_text(rng, 20)) for i in range(60)] + [(100, None, None), (101, "", "golf"), (102, "911", None)]
    want = sorted((i, *e) for i, t, b in texts for e in entities_plainly(rows, special, t, b))
    frame = spark.createDataFrame(texts, "id long, title string, excerpt string")
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    for limit in (32 << 20, 4000):  # one trie, or one for each few makes
        assert sorted(map(tuple, gz.extract_entities(frame, rows, special, limit).collect()), key=key) == sorted(want, key=key)
    assert len(want) > 100
    assert gz.extract_entities(frame, []).count() == 0 and gz.extract_entities(frame.filter("false"), rows).count() == 0


@pytest.mark.parametrize("limit", [32 << 20, 300])
def test_aliases_of_columns(spark, limit):
    rng = random.Random(4)
    aliases = sorted(some_aliases(rng, 60))
    patterns = {a: re.compile(cl.token_pattern(a)) for a in aliases}
    texts = [(i, some_text(rng, 5), rng.choice([None, some_text(rng, 9)])) for i in range(40)]
    frame = spark.createDataFrame(texts, "id long, a string, b string")
    found = gz.find_aliases(frame, {"in_a": F.col("a"), "in_b": F.col("b")}, aliases, limit)
    assert found.columns == ["id", "a", "b", "in_a", "in_b"]
    assert {(r.id, frozenset(r.in_a), frozenset(r.in_b)) for r in found.collect()} == {(i, frozenset(plainly(patterns, a)), frozenset(plainly(patterns, b))) for i, a, b in texts}
