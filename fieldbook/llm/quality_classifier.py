"""Quality classifier: two zstandard dictionaries and a calibrated size difference.

One dictionary is trained on good labelled text and one on bad. A text is cut
into windows, each window is compressed under both, and the difference of the
two sizes over their sum says which kind of text it resembles. A small
logistic model, fitted on whole labelled texts that the dictionaries have not
seen, turns these differences and sizes into a probability. Their features are
computed where the texts are; only numbers come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from fieldbook.llm.common import Scratch, small_batches

WINDOW = 512
LEVEL = 3
FEATURES = 7


@dataclass
class Model:
    """Dictionaries for good and bad text, and the calibration's weights."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def compressors(self) -> tuple:
        made = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        return tuple(made)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(text: bytes, good, bad) -> list[float]:
    """Normalised size differences (over all windows, the least, the greatest, and of the whole text), and how small the text gets (its best and worst window, and the whole).

    The sizes tell text that repeats itself, which is as small under either dictionary.
    """
    windows = [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)] or [b""]
    g = np.array([len(good.compress(w)) for w in windows], float)
    b = np.array([len(bad.compress(w)) for w in windows], float)
    d = (b - g) / (b + g)
    if len(windows) > 1:
        whole_g, whole_b = len(good.compress(text)), len(bad.compress(text))
    else:
        whole_g, whole_b = g.sum(), b.sum()
    ratio = np.log((g + 8) / (np.array([len(w) for w in windows]) + 32))  # short windows count as nearly plain
    return [(b.sum() - g.sum()) / (b.sum() + g.sum()), d.min(), d.max(), (whole_b - whole_g) / (whole_b + whole_g), ratio.min(), ratio.max(), float(np.log((whole_g + 8) / (len(text) + 32)))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def chosen(docs: DataFrame, known: DataFrame, max_rows_per_class: int) -> DataFrame:
    """(doc_id, label, place) of at most max_rows_per_class labelled ids of each label with a text: those whose hash is least, numbered in its order."""
    keys = known.join(docs.where("text IS NOT NULL").select("doc_id").distinct(), "doc_id")
    order = (F.xxhash64(F.lit(17), "doc_id"), F.col("doc_id"))
    parts = [keys.where(F.col("label") == y).orderBy(*order).limit(max_rows_per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "label", F.row_number().over(Window.partitionBy("label").orderBy(*order)).alias("place"))


def texts_of(docs: DataFrame, keys: DataFrame, text: Column) -> DataFrame:
    """(label, place, text) of the chosen ids, an expression over text; of several rows of one id, the least."""
    got = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(keys), "doc_id")
    return got.groupBy("label", "place").agg(F.min(text).alias("text"))


def dictionaries(docs: DataFrame, keys: DataFrame, size: int, piece_bytes: int) -> dict[int, bytes]:
    """A dictionary for each label, from one piece of at most piece_bytes of each text whose place is no multiple of 4 (where in the text varies)."""
    length = F.octet_length("text")
    at = F.pmod(F.xxhash64(F.lit(18), "place"), F.greatest(F.lit(1), length - piece_bytes + 1)).cast("int") + 1
    got = texts_of(docs, keys.where("place % 4 <> 0"), F.substring(F.col("text").cast("binary"), at, F.lit(piece_bytes))).collect()
    out = {}
    for y in (0, 1):
        pieces = [bytes(r.text) for r in sorted(got, key=lambda r: r.place) if r.label == y]
        try:
            out[y] = zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: use it as it is
            out[y] = b"".join(pieces)[:size] or b" " * 8
    return out


def fit(docs: DataFrame, known: DataFrame, max_rows_per_class: int, dictionary_bytes: int = 112_640, piece_bytes: int = 2048) -> Model:
    """Fit on documents whose ids are known (doc_id, label): label 1 is good, 0 bad.

    Three quarters of the chosen texts train the dictionaries; the rest, whole,
    fit the calibration, whose bias is then moved from the sample's shares to
    those of all labelled rows. With one label missing, the score is near the
    other label; with both missing, a half.
    """
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    keys = Scratch(docs.sparkSession, "quality").save("keys", chosen(docs, known, max_rows_per_class))
    found = {r[0]: r[1] for r in keys.groupBy("label").count().collect()}
    trained = dictionaries(docs, keys, dictionary_bytes, piece_bytes)
    model = Model(trained[1], trained[0], np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    n0, n1 = found.get(0, 0), found.get(1, 0)
    # Where there are few texts, all of them serve both ends.
    held = texts_of(docs, keys.where("place % 4 = 0") if min(n0, n1) >= 8 else keys, F.col("text"))
    if not n0 or not n1:
        model.bias = 40.0 if n1 else -40.0 if n0 else 0.0
        return model
    rows = sorted(with_features(held, model).drop("text").collect())
    x, y = np.array([r.features for r in rows]), np.array([float(r.label) for r in rows])
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    model.weights, model.bias = logistic((x - model.mean) / model.scale, y)
    model.bias += float(np.log(totals[1] / totals[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def with_features(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the features of each whole text; a null text counts as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = shared.value.compressors()
        for batch in batches:
            x = [features((t or "").encode(), good, bad) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], names=[*batch.schema.names, "features"])

    return docs.mapInArrow(made, StructType([*docs.schema.fields, StructField("features", ArrayType(DoubleType()))]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability that each whole text is good, as a double.

    A null text counts as empty; an empty text gets the probability of no
    evidence. A column that is already named like the result is replaced.
    Repeated rows stay, each with its score.
    """
    docs = docs.drop(out)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        good, bad = m.compressors()
        for batch in batches:
            x = np.array([features((t or "").encode(), good, bad) for t in batch.column(place).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.probability(x))], names=[*batch.schema.names, out])

    return docs.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, max_rows_per_class: int = 4000) -> DataFrame:
    """docs with a score, from a model fitted on labels (doc_id, quality).

    Only rows whose crc32 of the doc_id as text leaves a remainder other than 0
    by 5 are learned from, and of these at most max_rows_per_class ids of each
    label: one text each, of any length. Every text is scored whole. Labels
    without a document, and documents without a label, are fine; a null doc_id
    or label is never learned from, nor an id with both labels.
    """
    own = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most"))
    known = own.where(F.col("label") == F.col("_most")).select("doc_id", "label")
    return score(docs, fit(docs, known, max_rows_per_class))


def held_out(key: str) -> Column:
    """Whether a row is kept from learning."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
