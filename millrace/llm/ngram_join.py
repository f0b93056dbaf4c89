"""Operator 4: n-gram Jaccard self-join by MinHash banding, with exact verification.

Exact copies are one node. Band and row counts follow from the threshold and the recall asked for. Candidates are
verified on their full sets of word n-grams; see _near for how large buckets are handled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._near import band_hashes, buckets_of, choose_bands, components, links, paired_blocks, similar
from ._shared import row_ids, scan_ids, sized_broadcast, table, written
from ._words import chunks, shingles, unicode_words

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.995


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(rid, doc_id, key) and the band hashes b0, b1, ... of the rows that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(3)):
                hashes, bounds = shingles(unicode_words(data, offsets), n)
                some = np.flatnonzero(np.diff(bounds))
                if not len(some):
                    continue
                made = band_hashes(hashes, np.append(bounds[some], bounds[-1]), bands, rows).view(np.int64)
                at = pa.array(some + first)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), *(pa.array(made[:, k]) for k in range(bands))], names=["rid", "doc_id", "key", *columns])

    kind, columns = dict(docs.dtypes)["doc_id"], [f"b{k}" for k in range(bands)]
    return docs.select("rid", "doc_id", F.md5(F.col("_text").cast("binary")).alias("key"), "_text").mapInArrow(run, f"rid long, doc_id {kind}, key string, " + ", ".join(f"{c} long" for c in columns))


def _sets(docs: DataFrame, n: int):
    def of(nodes: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, data, offsets in chunks(batch.column(1)):
                    hashes, bounds = shingles(unicode_words(data, offsets), n)
                    sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    ends = np.cumsum([0, *map(len, sets)])
                    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), listed], names=["node", "items"])

        wanted = sized_broadcast(written(nodes.withColumnRenamed("node", "rid"), "wanted"))
        return docs.select("rid", "_text").join(wanted, "rid").select("rid", "_text").mapInArrow(run, "node long, items array<long>")

    return of


def _counted(classes: DataFrame, sets, threshold: float) -> DataFrame:
    """(node, n_links): for nodes of classes (root, node, copies, n) of three or more texts, the documents similar to its text, copies of it left out."""
    large = written(classes.filter("n > 2"), "large")
    items = sets(large.select("node"))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group.i.iloc[0], group.j.iloc[0]
        one, two = group[group.side == i], group[group.side == j]
        hit = similar(list(one["items"]), list(two["items"]), threshold)
        hit &= one.node.to_numpy()[:, None] != two.node.to_numpy()[None, :]
        found = [pd.DataFrame({"node": one.node, "n_links": hit @ two.copies.to_numpy(np.int64)})]
        if i != j:
            found.append(pd.DataFrame({"node": two.node, "n_links": hit.T @ one.copies.to_numpy(np.int64)}))
        return pd.concat(found)

    blocks = paired_blocks(large, ["root"], "node").join(items, "node")
    return blocks.groupBy("root", "i", "j").applyInPandas(count, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def similar_documents(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text", doc_id: str = "doc_id", count_links: bool = True, row_id: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, class_id, class_size, n_links, first.

    Two documents are linked if the Jaccard similarity of their sets of n-word runs (any case; letters and digits
    only; Han, kana and the like character by character) is the threshold or more; a class is what links connect. A
    document with fewer words has one set element, all of them. class_id: the least doc_id of the class; first: whether the row is its least (doc_id, rid).
    n_links: how many other documents are linked to this one (not counted unless count_links). rid: row_id, a column
    of docs as scan_ids() makes it; without it, ids and texts are written once. Null, empty and wordless texts are linked to nothing, not even each other. Repeated rows are copies. Null
    doc_ids come last in a class. An empty table gives an empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    wanted = [F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")]
    docs = docs.select(*wanted, F.col(row_id).alias("rid")) if row_id else row_ids(docs.select(*wanted))
    signed = written(_signatures(docs, n, bands, rows), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    nodes = signed.groupBy("key").agg(F.min("rid").alias("node"), F.count("*").alias("copies"), F.min(order).alias("least"), *[F.first(f"b{k}").alias(f"b{k}") for k in range(bands)])
    nodes = written(nodes, "nodes", "lz4")
    sets = _sets(docs, n)
    hashes = [f"b{k}" for k in range(bands)]
    roots = components(links(buckets_of(nodes, hashes), sets, threshold))
    classes = nodes.drop(*hashes).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = classes.groupBy("root").agg(F.count("*").alias("n"), F.sum("copies").alias("class_size"), F.min("least").alias("least_of_class"))
    classes = written(classes.join(sizes, "root").withColumns({"class_id": F.col("least_of_class.doc_id"), "first_rid": F.col("least_of_class.rid")}), "classes")
    found = classes.withColumn("n_links", F.when(F.col("n") == 2, F.col("class_size") - 1).otherwise(F.col("copies") - 1))
    if count_links:
        counted = _counted(classes.select("root", "node", "copies", "n"), sets, threshold).withColumnRenamed("n_links", "others")
        found = found.join(counted, "node", "left").withColumn("n_links", F.when(F.col("n") > 2, F.col("copies") - 1 + F.coalesce("others", F.lit(0))).otherwise(F.col("n_links")))
    rows = signed.select("rid", "doc_id", "key").join(found.select("key", "class_id", "class_size", "n_links", "first_rid"), "key")
    rows = rows.withColumn("first", F.col("rid") == F.col("first_rid"))
    alone = docs.select("rid", "doc_id").join(signed.select("rid"), "rid", "left_anti")
    alone = alone.select("rid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return rows.select(*alone.columns).unionByName(alone)


def keep_first(docs: DataFrame, row_id: str | None = None, **options) -> DataFrame:
    """docs with one row of each class, the one of the least doc_id. row_id: as for similar_documents(); it is kept."""
    own = row_id or "_rid"
    docs = docs if row_id else row_ids(docs, own)
    copies = written(similar_documents(docs, count_links=False, row_id=own, **options).filter("not first").select(F.col("rid").alias(own)), "copies")
    kept = docs.join(sized_broadcast(copies), own, "left_anti")
    return kept if row_id else kept.drop(own)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    return similar_documents(docs, row_id="row").select("doc_id", "class_id", "class_size", "n_links")


QUERIES = {"op4_ngram_join": op4_ngram_join}
ORACLE_SQL: dict[str, str] = {}
