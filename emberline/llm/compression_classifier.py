"""Quality classifier by compression: which of two dictionaries shortens a text more.

Pieces of good and of bad labelled texts make two zstandard dictionaries.  A text is cut
into pieces of ``PIECE`` bytes, so that the dictionaries and not its own repetition decide,
and compressed with each; the difference of the sizes over their sum is its feature, and a
logistic curve fitted on other labelled texts turns that into a probability.

Fitting uses a bounded sample, by the parameters ``per_class`` and ``calibration``: the rows
of each class whose hashed id is smallest, each with its whole text.

Defined results: a null text counts as empty, an empty text has feature 0; rows without a
label, and labels other than 0 and 1, teach nothing; several rows of one id are scored
each; with a class missing every score is the share of label 1 (a half without labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from emberline.llm.common import arrays_to_batch, arrow_schema, small_batches

PER_CLASS = 1_500
CALIBRATION = 2_000
DICTIONARY_BYTES = 112_640
PIECE = 512
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5


@dataclass
class Model:
    """Two dictionaries and the curve ``1 / (1 + exp(-(slope * feature + intercept)))``."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    intercept: float = 0.0
    _tools: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_tools": []}

    def _compressors(self) -> list:
        if not self._tools:
            for content in (self.good, self.bad):
                dictionary = zstandard.ZstdCompressionDict(content)
                dictionary.precompute_compress(level=LEVEL)
                options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
                self._tools.append(zstandard.ZstdCompressor(dict_data=dictionary, **options))
        return self._tools

    def feature(self, text: str | None) -> float:
        """From -1 to 1, positive if the good dictionary shortens the text more."""
        data = (text or "").encode()
        if not data or not self.good or not self.bad:
            return 0.0
        good, bad = self._compressors()
        by_good = by_bad = 0
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            by_good += len(good.compress(piece))
            by_bad += len(bad.compress(piece))
        return (by_bad - by_good) / (by_bad + by_good)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.feature(text) + self.intercept))))


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of samples too few to train on, their plain content."""
    samples = [sample for sample in samples if sample]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def fit_curve(features: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a slight pull of the slope to zero."""
    scale = float(np.abs(features).max()) or 1.0
    x, y = np.column_stack([features / scale, np.ones(len(features))]), labels.astype(float)
    # Targets slightly inside 0 and 1 keep the curve finite if the classes part perfectly.
    ones = y.sum()
    y = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    curve, pull = np.zeros(2), np.diag([1e-3, 1e-9])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ curve)
        curve = curve + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(curve[0] / scale), float(curve[1])


def clean_labels(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """``doc_id, label`` once per id; ids with both labels teach nothing."""
    sound = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    return sound.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")


def sample_labels(clean: DataFrame, rows_per_class: int) -> DataFrame:
    """At most ``rows_per_class`` rows of each class, by hashed id."""
    classes = [clean.where(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for kind in (0, 1)]
    return classes[0].unionByName(classes[1])


def features_of(texts: DataFrame, model: Model) -> DataFrame:
    """``doc_id, label, tie, feature`` of the whole texts of ``doc_id, label, tie, text``."""
    kept = ["doc_id", "label", "tie"]
    schema = StructType([*(texts.schema[name] for name in kept), StructField("feature", DoubleType())])
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [shared.value.feature(value.as_py()) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), pa.array(features, pa.float64())], names=[*kept, "feature"])

    return small_batches(texts.select(*kept, "text")).mapInArrow(run, schema)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    calibration: int = CALIBRATION,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "label",
) -> Model:
    """A model of at most ``per_class`` labelled rows of each class for the dictionaries and
    ``calibration`` more of each for the curve, which is then moved to the share of the
    classes among all labels.  What reaches the driver is bounded by rows: the texts of those
    for the dictionaries, two numbers of each for the curve.
    """
    clean = clean_labels(labels, id_col, label)
    totals = {row["label"]: row["count"] for row in clean.groupBy("label").count().collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    unfitted = Model(b"", b"", intercept=float(np.log((ones + 1) / (zeros + 1))))
    if not ones or not zeros:
        return unfitted
    # At most 2 * (per_class + calibration) rows of two numbers: safe to broadcast.
    chosen = F.broadcast(sample_labels(clean, per_class + calibration).withColumnRenamed("doc_id", "picked_id"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    there = texts.select("doc_id").join(chosen, F.col("doc_id") == F.col("picked_id")).select("doc_id", "label").distinct().collect()
    place = {row["doc_id"]: (zlib.crc32(str(row["doc_id"]).encode()), row["doc_id"]) for row in there}
    found = {kind: sorted((row["doc_id"] for row in there if row["label"] == kind), key=place.get) for kind in (0, 1)}
    if not found[0] or not found[1]:
        return unfitted
    cuts = {kind: max(1, len(found[kind]) * per_class // (per_class + calibration)) for kind in (0, 1)}

    def of_rows(ids: dict[int, list]) -> DataFrame:
        schema = StructType([StructField("picked_id", texts.schema["doc_id"].dataType), StructField("label", IntegerType())])
        picked = docs.sparkSession.createDataFrame([(doc_id, kind) for kind in (0, 1) for doc_id in ids[kind]], schema)
        return texts.join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id"))

    # Of several rows of an id one counts.
    learnt = of_rows({kind: found[kind][: cuts[kind]] for kind in (0, 1)}).groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    taught: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(learnt.collect(), key=lambda row: place[row["doc_id"]]):
        taught[row["label"]].append(row["text"].encode())
    model = Model(build_dictionary(taught[1]), build_dictionary(taught[0]))
    rest = of_rows({kind: found[kind][cuts[kind] :] or found[kind] for kind in (0, 1)}).withColumn("tie", F.xxhash64("text"))
    measured = features_of(rest, model).groupBy("doc_id", "label").agg(F.min(F.struct("tie", "feature")).getField("feature").alias("feature")).collect()
    measured.sort(key=lambda row: place[row["doc_id"]])
    kinds = np.array([row["label"] for row in measured])
    model.slope, model.intercept = fit_curve(np.array([row["feature"] for row in measured]), kinds)
    model.intercept += float(np.log(ones / zeros) - np.log(kinds.sum() / (len(kinds) - kinds.sum())))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``."""
    schema = "doc_id long, score double, predicted int"
    arrow = arrow_schema(docs, schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(value) for value in batch.column(1).to_pylist()]
            yield arrays_to_batch([batch.column(0), scores, [int(value >= threshold) for value in scores]], arrow)

    return small_batches(docs.select(F.col(id_col).cast("long"), F.col(text))).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that no model may learn from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0
