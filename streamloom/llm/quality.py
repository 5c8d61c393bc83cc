"""Quality classifier: text that a dictionary of good text compresses better is likelier good."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Labelled texts of each class that the dictionaries are built from, and as many again for the calibration.
SAMPLE = 1200
#: Longer labelled texts are left out of the sample (never out of the scoring).
SAMPLE_BYTES = 32_768
DICTIONARY_BYTES, LEVEL = 262_144, 3
#: Weight of the penalty that keeps the calibration finite where the classes are apart.
RIDGE = 1.0


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[bytes, bytes]):
    import zstandard

    found = []
    for raw in dictionaries:
        made = zstandard.ZstdCompressionDict(raw)
        made.precompute_compress(level=LEVEL)
        found.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
    return found


def _features(texts: list[bytes], dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """Compressed-size differences, bad less good, normalised by both sizes and by the length, with
    the compression itself, as repetition shrinks both sizes."""
    bad, good = _compressors(dictionaries)
    sizes = np.array([(len(bad.compress(t)), len(good.compress(t)), len(t) + 20) for t in texts], dtype=float).reshape(-1, 3)
    b, g, n = sizes.T
    by_both, by_length, shrunk = (b - g) / (b + g), (b - g) / n, np.log(np.minimum(b, g) / n)
    return np.column_stack([np.ones(len(b)), by_both, by_length, shrunk, by_both * shrunk, by_length * shrunk, shrunk**2, by_both * np.abs(by_both)])


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    raw = b"".join(texts)
    try:
        return zstandard.train_dictionary(max(256, min(DICTIONARY_BYTES, len(raw) // 2)), texts).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it
        return raw[-DICTIONARY_BYTES:] + b" " * max(0, 16 - len(raw))


def _calibrated(features: np.ndarray, labels: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps, halved until they lower the loss; the classes are
    weighted by their share of all labels."""
    mean, spread = features.mean(0), features.std(0)
    mean[0], spread[0] = 0, 1
    spread[spread == 0] = 1
    z, beta = (features - mean) / spread, np.zeros(features.shape[1])
    weight = np.where(labels == 1, share / max(1, labels.sum()), (1 - share) / max(1, (1 - labels).sum())) * len(labels)

    def loss(beta: np.ndarray) -> float:
        x = z @ beta
        return float((weight * (np.logaddexp(0, x) - labels * x)).sum() + RIDGE / 2 * beta @ beta)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(beta))
        step, now = np.linalg.solve(hessian, z.T @ (weight * (labels - p)) - RIDGE * beta), loss(beta)
        while np.abs(step).max() > 1e-8 and loss(beta + step) > now:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() <= 1e-8:
            break
    return mean, spread, beta


class QualityModel:
    """Two dictionaries and a calibration: a megabyte at most, whatever the input's size."""

    def __init__(self, dictionaries: tuple[bytes, bytes] | None, calibration: tuple | None, share: float):
        self.dictionaries, self.calibration, self.share = dictionaries, calibration, share

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(texts), self.share)
        mean, spread, beta = self.calibration
        return 1 / (1 + np.exp(-np.clip((_features(texts, self.dictionaries) - mean) / spread @ beta, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> QualityModel:
    """Fit on a bounded sample: of each class the ``2 * sample`` labelled documents of the smallest
    md5 of their id, without held-out ones and texts of over 32 KB; one half builds the dictionary,
    the other the calibration. A document with several labels counts by the largest. With one class
    alone (or none) every score is the share of label 1 (0.5)."""
    spark = docs.sparkSession
    known = labels.filter(labels["doc_id"].isNotNull() & labels["quality"].isin(0, 1)).select("doc_id", "quality").filter(~held_out)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return QualityModel(None, None, share)
    order = F.md5(F.col("doc_id").cast("string"))
    wanted = [r for q in (0, 1) for r in known.filter(F.col("quality") == q).orderBy(order).limit(4 * sample).collect()]
    chosen = F.broadcast(spark.createDataFrame(wanted, "doc_id long, quality int"))  # 8 * sample rows of two numbers at most
    texts = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, SAMPLE_BYTES)).join(chosen, "doc_id")
    parts: dict[int, list[bytes]] = {}
    for q in (0, 1):
        rows = texts.filter(F.col("quality") == q).orderBy(order, "text").limit(2 * sample).collect()
        parts[q] = [r["text"].encode() for r in rows]
    if not (parts[0] and parts[1]):
        return QualityModel(None, None, share)
    half = {q: max(1, len(x) // 2) for q, x in parts.items()}
    dictionaries = tuple(_dictionary(parts[q][: half[q]]) for q in (0, 1))
    rest = {q: parts[q][half[q] :] or parts[q] for q in (0, 1)}
    y = np.r_[np.zeros(len(rest[0])), np.ones(len(rest[1]))]
    return QualityModel(dictionaries, _calibrated(_features(rest[0] + rest[1], dictionaries), y, share), share)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5, held_out_rest: int = 0, threshold: float = 0.3) -> DataFrame:
    """Score every whole text: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Only the text is an input of a score. Null and empty texts compress to nothing and get the score
    of the empty text. One row per input row; an empty table gives an empty one. Documents stay where
    they are read: the model is broadcast and nothing is shuffled.
    """
    held = crc_mod(F.col("doc_id"), held_out_mod) == held_out_rest
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, held))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            found = model.value.score(texts) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
