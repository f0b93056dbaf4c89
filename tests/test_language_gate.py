"""The language gate on composed, decomposed and full-width text, against the rules said plainly."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.plans import content_queries

SCRIPTS = re.compile("[\u1f00-\u1fff一-鿿㐀-䶿぀-ヿ가-힯ᄀ-ᇿЀ-ӿ؀-ۿ֐-׿฀-๿Ͱ-Ͽऀ-ॿ]")


def runs_of_letters(text):
    return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text).split()


def plainly(title, excerpt):
    text = f"{title or ''} {excerpt or ''}".strip(" ")
    words = runs_of_letters(unicodedata.normalize("NFKC", text.lower()))
    if SCRIPTS.search(text):
        return False
    if not words:
        return True
    english = sum(w in tx.ENGLISH_WORDS for w in words)
    foreign = max(sum(w in lexicon for w in words) for lexicon in tx.FOREIGN_WORDS.values())
    accents = sum(unicodedata.category(c)[0] == "L" and len(unicodedata.normalize("NFD", c).encode("utf-16-le")) > 2 for c in text)
    return not (foreign >= 4 or foreign >= 3 and foreign >= english or foreign >= 2 and not english or accents >= 8 or accents >= 5 and foreign >= 2)


def wide(word):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in word)


def test_gate_on_every_form_of_text(spark):
    rng = random.Random(1)
    pool = ["the", "and", "of", "le", "des", "une", "der", "und", "nicht", "que", "über", "façade", "naïve", "ß", "ﬁn", "Å", "ø", "ﬀ", "𝐀bc", "x", "42", "é" * 4, "Ｔｈｅ"]
    forms = [str, str.upper, wide, lambda w: unicodedata.normalize("NFD", w), lambda w: unicodedata.normalize("NFC", w)]
    texts = [(" ".join(rng.choice(forms)(rng.choice(pool)) for _ in range(rng.randint(0, 4))), " ".join(rng.choice(forms)(rng.choice(pool)) for _ in range(rng.randint(0, 8)))) for _ in range(600)]
    texts += [("Ein Bericht", "der und die das mit"), ("A story", "of the road"), ("", ""), (None, None), ("车", ""), ("ｌｅ ｄｅｓ", "ｕｎｅ"), ("Привет", "the"), ("42 — 7", ""), ("é" * 9, "a"), ("é" * 9, "a"), ("ᾳ", ""), ("𝐀𝐁𝐂𝐃𝐄𝐅𝐆𝐇", "")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, t string, e string").select("i", tx.is_english(F.col("t"), F.col("e")).alias("ok")).collect()
    got = {r.i: r.ok for r in rows}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, plainly(*t)) for t in texts]
    assert got[len(texts) - 7] is False and set(got.values()) == {True, False}  # full-width words are words


def test_plain_ascii_is_judged_without_python(spark):
    # rows of ASCII reach the helper as nulls
    seen = tx._unicode.func(__import__("pandas").Series([None, "é"]))
    assert seen.words.tolist() == [None, "é"] and seen.accents.tolist()[1] == 1


def test_batches_of_texts_are_short(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        content_queries.language_gate(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "4000"
        spark.conf.set(key, "77")
        content_queries.language_gate(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, own)
