"""Operator 7: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all documents one may learn from. The regression is trained by follow-the-regularised-
leader with elastic-net penalties, on a bounded sample, in several tasks whose weights are averaged; a temperature
fitted on sample rows that no task trained on calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written

#: n-grams of 1 to ORDERS characters are hashed into so many buckets.
BUCKETS, ORDERS = 1 << 14, 3
#: The bound of the sample: about so many documents of each language, picked by a hash of id and text.
ROWS_PER_LANGUAGE = 1500
#: Tasks that train side by side; one more share of the sample is kept for calibration.
TRAINERS = 4
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 0.02, 0.01
UNKNOWN = "und"

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's n-grams, and how often each occurs. ASCII other than letters counts as a space."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 128, _FOLD[np.minimum(points, 127)], points)
    total = np.zeros(len(points), np.uint32)
    found = []
    for n in range(ORDERS):
        total = total[: len(points) - n] * _FACTORS[n] + points[n:]
        mixed = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
        found.append((mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used]


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, counts = features(text)
    x = np.log1p(counts) * idf[used]
    size = np.sqrt((x * x).sum())
    return used, x / size if size else x


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


class FollowTheLeader:
    """FTRL-proximal for multinomial logistic regression; the last row of the weights is the intercept."""

    def __init__(self, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, used: np.ndarray, x: np.ndarray, label: int) -> None:
        rows, x = np.append(used, BUCKETS), np.append(x, 1.0)
        w = self.weights(rows)
        p = _softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Over all rows with a letter: how many there are, and how many have an n-gram of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for value in batch.column(0):
                if has_letter(body := value.as_py()):
                    total[features(body)[0]] += 1
                    total[BUCKETS] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": used, "n": total[used]}, schema=pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        total[r.bucket] = r.n
    return int(total[BUCKETS]), total[:BUCKETS]


class Model:
    """languages, idf, weights (buckets and an intercept, by language) and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def logits(self, text: str) -> np.ndarray:
        used, x = _vector(text, self.idf)
        return x @ self.weights[used] + self.weights[BUCKETS]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The most probable language (of equals, the first by name) and its probability."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def temperature_for(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature from 1/32 to 32 with the least log loss; 1 without rows."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)).mean()
    return float(min(2.0 ** np.linspace(-5, 5, 161), key=loss))


def train(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from rows with a non-null label and a letter in the text. Without any, the model knows no language."""
    usable = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    n_docs, df = document_frequencies(usable)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    if not n_docs:
        return Model([], idf, np.zeros((BUCKETS + 1, 0)))
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows_per_language / n))])
    sample = usable.filter(F.pmod("h", F.lit(1 << 20)) < F.element_at(rate, F.col("label")) * (1 << 20))
    sample = written(sample.withColumn("share", F.pmod(F.xxhash64(F.lit(7), "h"), F.lit(TRAINERS + 1))), "sample")

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "label"])
        rows = [(_vector(t, idf), languages.index(lab)) for t, lab in zip(group.text, group.label, strict=True) if has_letter(t)]
        leader = FollowTheLeader(len(languages))
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                leader.learn(*rows[i][0], rows[i][1])
        return pd.DataFrame({"n": [len(rows)], "weights": [leader.weights().astype(np.float32).tobytes()]})

    fitted = sample.filter(F.col("share") < TRAINERS).groupBy("share").applyInPandas(fit, "n long, weights binary").collect()
    total = sum(r.n for r in fitted)
    weights = np.zeros((BUCKETS + 1, len(languages)))
    for r in fitted:
        weights += np.frombuffer(r.weights, np.float32).reshape(weights.shape) * (r.n / total if total else 0)
    model = Model(languages, idf, weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(languages.index(lab), model.logits(t).tolist()) for t, lab in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["label", "logits"])

    scored = sample.filter(F.col("share") == TRAINERS).select("text", "label").mapInArrow(score, "label long, logits array<double>").collect()
    model.temperature = temperature_for(np.array([r.logits for r in scored]), np.array([r.label for r in scored], np.int64))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs and lang_pred, score (0 to 1). Such columns are replaced.

    Null text and text without a letter: `und`, 0; so is every text if the model knows no language. Whole texts
    count. Repeated rows give repeated results; an empty table an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.schema.names.index("__text"))]
            keep = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep.schema.names, "lang_pred", "score"])

    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "__text")], F.col(text).alias("__text"))
    schema = kept.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return kept.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that one must not learn from: CRC-32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLE_SQL: dict[str, str] = {}
