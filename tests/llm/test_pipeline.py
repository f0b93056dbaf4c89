"""The pipeline on planted documents: what must go goes, and clean documents stay, with every token packed once."""

import random

import corpus_pipeline
import pyarrow as pa
import pytest

from millrace.storage import BATCH_BYTES, short_batches

EN = "the and with from this river house garden people water morning evening bridge window letter winter".split()
FR = "le et avec dans cette rivière maison jardin gens eau matin soirée pont fenêtre lettre hiver".split()


def text(rng, words, lines=3):
    make = lambda: " ".join(rng.choice(words) + "".join(rng.choice("aeioulnrst") for _ in range(rng.choice([0, 2, 4]))) for _ in range(25))
    return "\n".join(make() for _ in range(lines))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = [(i, text(rng, EN if i % 2 else FR), "en" if i % 2 else "fr") for i in range(120)]
    item = text(rng, EN, 1)
    rows += [(200, rows[1][1], "en"), (201, rows[2][1].replace(" ", "  ", 1), "fr"), (202, None, "en"), (203, "123 %%%", "en"), (204, text(rng, EN) + "\n" + item.upper() + "\n" + text(rng, EN), "en")]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_planted_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        now = {r.doc_id for r in docs.collect()}
        gone = left - now
        assert gone == [{202, 203}, {200, 201}, set(), {204}][k], (name, gone)
        left = now
    assert left == set(range(120))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    totals: dict = {}
    for r in packed:
        totals.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert set(totals) == left and all(a == b for a, b in totals.values())


def test_near_copies_leave_by_the_join(spark, folder):
    rng = random.Random(3)
    base = text(rng, EN, 4)
    docs = spark.createDataFrame([(1, base, "en", "s", 1), (2, base.replace(base.split()[40], "changed", 1), "en", "s", 1), (3, text(rng, EN), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, folder).collect()} == {1, 3}


def test_stages_with_empty_tables_odd_rows_and_more_columns(spark, folder, tmp_path):
    """Every stage: an empty table, nulls in every column, empty texts, ties of repeated rows, and columns that the operators use themselves."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = ["score", "lang_pred", "n_lines", "n_dropped", "dropped", "_rid", "rid", "first", "class_id", "coverage", "tiles", "_text", "length", "start"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("doc_id < 0"), folder).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (None, "the river and the house", None, "s", 1)], docs.schema)
    rows = docs.unionByName(odd)
    for c in clash:
        rows = rows.withColumn(c, corpus_pipeline.F.lit("clash"))
    rows.write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        kept = [c for c in docs.columns if c in out.columns]
        assert kept[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {*range(120), None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).filter("doc_id is null").count() == 1


def test_batches_of_texts_are_bounded_by_their_bytes(spark):
    """Few rows of long texts come in several batches, and a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"]) for b in batches)
    texts = spark.range(0, 300, 1, 1).select(corpus_pipeline.F.repeat(corpus_pipeline.F.lit("x"), 100_000).alias("text"))
    try:
        spark.conf.unset(key)
        short_batches(spark)
        found = texts.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in found) == 300 and len(found) > 5 and max(r.bytes for r in found) < BATCH_BYTES + 200_000
        spark.conf.set(key, "1048576b")
        short_batches(spark)
        assert spark.conf.get(key) == "1048576b"
    finally:
        spark.conf.set(key, own)
