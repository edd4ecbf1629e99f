"""Operator 7: quality classifier.

Logistic regression over hashed word n-grams, learned by follow-the-regularised-leader
updates and scored as a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tracewright.llm.common import joined, materialize, scratch, text_of

BITS = 18
#: Bound of the training sample, in labelled rows.
SAMPLE_ROWS = 6000
#: Bound of the vectors that the learner holds, in feature ids of 8 bytes each with its value.
SAMPLE_IDS = 1 << 24
EPOCHS = 4
#: Bound of the words whose hashes a worker remembers.
REMEMBERED = 200_000
WORDS = 1 << 16
#: Training texts whose vectors are handed on together.
ROWS_AT_ONCE = 100

ALPHA, BETA, L1, L2, SCALE = 1.0, 1.0, 0.005, 0.1, 8.0

_shape = str.maketrans({c: k for k, chars in (("0", "0123456789"), ("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in chars})
_other_lower, _other_upper, _again = re.compile(r"[^\W\d_A-Za-z]"), re.compile(r"[A-Z]{2,}"), re.compile(r"(.)\1+")
_known: dict[bytes, int] = {}


def word_hash(word: bytes) -> int:
    """Hash of the lower-cased letters (high half) and of the word's shape (low half)."""
    text = word.decode("utf-8", "replace")
    shape = _again.sub(r"\1", _other_lower.sub(lambda m: "A" if m[0].isupper() else "a", text.translate(_shape)))
    return zlib.crc32(text.lower().strip(".,;:!?\"'()").encode()) << 32 | zlib.crc32(shape.encode(), 99)


def feature_ids(text: str) -> np.ndarray:
    """Hashed ids, one per occurrence, of the words, the words' shapes, and pairs of each, of a whole text."""
    words = text.encode("utf-8", "replace").split()
    found = []
    before = np.zeros(0, np.uint64)
    for start in range(0, len(words), WORDS):
        part = words[start : start + WORDS]
        if len(_known) > REMEMBERED:
            _known.clear()
        for w in set(part).difference(_known):
            _known[w] = word_hash(w)
        now = np.fromiter((_known[w] for w in part), dtype=np.uint64, count=len(part))
        chain = np.concatenate([before, now])
        before = now[-1:]
        high, low = np.uint64(32), np.uint64(0xFFFFFFFF)
        a, b = chain[:-1], chain[1:]
        pairs = (a >> high) * np.uint64(0x9E3779B97F4A7C15) + (b >> high) * np.uint64(0xC2B2AE3D27D4EB4F)
        shapes = (a & low) * np.uint64(0xD6E8FEB86659FD93) + (b & low) * np.uint64(0xA0761D6478BD642F)
        singles = np.concatenate([(now >> high) * np.uint64(0xFF51AFD7ED558CCD), (now & low) * np.uint64(0xC4CEB9FE1A85EC53)])
        found.append((np.concatenate([singles, pairs, shapes]) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def dot(weights: np.ndarray, bias: float, text: str) -> float:
    """Log odds: the bias and the weights' mean over all feature occurrences."""
    ids = feature_ids(text)
    return bias + (SCALE * float(weights[ids].mean()) if len(ids) else 0.0)


def follow_the_leader(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """(weights, bias) after FTRL-proximal updates over ``(feature ids, values, label)``."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(11)

    def weights(ids: np.ndarray | slice) -> np.ndarray:
        free = ids == 1 << BITS if isinstance(ids, np.ndarray) else np.arange(len(z)) == 1 << BITS  # the bias is not penalised
        l1, l2 = np.where(free, 0, L1), np.where(free, 0, L2)
        return np.where(np.abs(z[ids]) <= l1, 0.0, -(z[ids] - np.sign(z[ids]) * l1) / ((BETA + np.sqrt(n[ids])) / ALPHA + l2))

    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            ids, values, label = examples[i]
            w = weights(ids)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA * w
            n[ids] += g * g
    final = weights(slice(None))
    return final[:-1].astype(np.float32), float(final[-1])


def example(text: str) -> tuple[bytes, bytes]:
    """(feature ids, values) of a training text, all of them: at most ``2**BITS`` and the bias."""
    ids, counts = np.unique(feature_ids(text), return_counts=True)
    values = SCALE * counts / max(1, counts.sum())
    return np.append(ids, 1 << BITS).astype(np.int32).tobytes(), np.append(values, 1.0).astype(np.float32).tobytes()


def train(docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> tuple[np.ndarray, float]:
    """(weights, bias) learned from about :data:`SAMPLE_ROWS` labelled ids, fewer where their
    vectors together pass :data:`SAMPLE_IDS`.

    Ids are drawn by hash; one that is labelled both ways doesn't teach, and of several
    rows of one id the text with the smallest hash does.  Texts become vectors where they
    are read; one task learns from these and returns the weights that aren't zero.
    """
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    with scratch(docs.sparkSession):
        known = materialize(known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "label"), "labels")
        count = known.count()
        if not count:
            return np.zeros(1 << BITS, np.float32), 0.0
        drawn = materialize(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40) < SAMPLE_ROWS / count), "drawn")
        texts = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
        sample = joined(texts, drawn, "id", "inner").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

        def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), ROWS_AT_ONCE):
                    part = batch.iloc[at : at + ROWS_AT_ONCE]
                    found = [example(t) for t in part["text"]]
                    yield pd.DataFrame({"label": part["label"], "lot": part["lot"], "ids": [f[0] for f in found], "vals": [f[1] for f in found]})

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            examples = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.vals, np.float32), int(r.label)) for batch in batches for r in batch.itertuples(index=False)]
            w, bias = follow_the_leader(examples)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"id": np.append(at, 1 << BITS).astype(np.int32), "weight": np.append(w[at], bias).astype(np.float32)})

        lot = (F.pmod(F.xxhash64("id", F.lit("lot")), F.lit(1 << 40)) / float(1 << 40)).alias("lot")
        rows = materialize(sample.select("label", "text", lot).mapInPandas(vectors, "label int, lot double, ids binary, vals binary"), "vectors")
        size = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
        found = rows.where(F.col("lot") < SAMPLE_IDS * 4 / max(1, size)).drop("lot").repartition(1).sortWithinPartitions("label", "ids", "vals").mapInPandas(learn, "id int, weight float").toPandas()
    w = np.zeros((1 << BITS) + 1, np.float32)
    w[found["id"]] = found["weight"]
    return w[:-1], float(w[-1])


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``score`` (0 to 1), ``predicted``.

    ``learn_from`` (over ``labels``) tells which labelled rows may teach.  Scores read
    nothing but the whole text.  A null text counts as empty; an empty text scores the
    bias alone; without labels every score is 0.5.  Null or other labels don't teach;
    repeated rows score alike; an empty table gives an empty one; other columns are not
    read.
    """
    weights, bias = train(docs, labels.where(learn_from), label_column, id_column, text_column)
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    out = StructType([base.schema["doc_id"], StructField("score", DoubleType()), StructField("predicted", LongType())])
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats, whatever the input

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            odds = np.array([dot(model.value, bias, t or "") for t in batch.pop("text")], dtype=np.float64)
            chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield batch.assign(score=chance, predicted=(chance >= 0.5).astype(np.int64))

    return base.mapInPandas(score, out)
