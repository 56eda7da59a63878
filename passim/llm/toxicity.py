"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.llm.arrow import byte_slices, filled, hashes, sums_by_row, words
from passim.session import checkpointed

BUCKET_BITS = 19
# Labelled rows that the model is fitted on at most, and the parts they are
# dealt to. Each part is learnt by one task, and the parts are then averaged.
SAMPLE_ROWS = 8000
PARTS = 4
ROUNDS = 4
PASSES = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1.5, 0.1
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - BUCKET_BITS)


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word, word pair and pair around one word."""
    offsets, index, distinct = words(texts)
    own = hashes(distinct)[index]
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    rows, found = [row], [(own * _SEEDS[0]) >> _SHIFT]
    for gap in (1, 2):
        if len(own) > gap:
            same = row[:-gap] == row[gap:]
            pair = ((own[:-gap] * _SEEDS[gap]) ^ (own[gap:] >> np.uint64(3))) * _SEEDS[0]
            rows.append(row[:-gap][same])
            found.append((pair >> _SHIFT)[same])
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


class Ftrl:
    """Per-coordinate state: ``z`` (gradient sums less pulls) and ``n`` (squared gradients).

    The last coordinate is the bias, which has no L1 penalty.
    """

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        size = (1 << BUCKET_BITS) + 1
        self.z = np.zeros(size) if z is None else z.copy()
        self.n = np.zeros(size) if n is None else n.copy()
        self.sparse = np.full(size, L1)
        self.sparse[-1] = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, sparse = self.z[at], self.n[at], self.sparse[at]
        return np.where(np.abs(z) <= sparse, 0.0, -(z - np.sign(z) * sparse) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA * w
        self.n[at] += gradient**2


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> np.ndarray:
    """Weights by bucket, the bias last; most are 0.

    Fitted on at most about ``sample_rows`` labelled ids, picked by the hash of
    the id; rows without an id, a label or a document take no part, and an id
    with several labels is toxic if one says so. The ids are the only thing
    sent to the documents, which stay where they are. Without labels all
    weights are 0.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{toxic}`").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    total = known.count()
    if not total:
        return np.zeros((1 << BUCKET_BITS) + 1)
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit("toxicity")), F.lit(1 << 30))
    known = known.where(drawn < int(min(1.0, sample_rows / total) * (1 << 30)))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(PARTS))
    sample = texts.join(F.broadcast(known), "id").select("id", "text", "label", part.alias("part"))
    spark, state = docs.sparkSession, Ftrl()

    @F.arrow_udf("array<int>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, out = [0], []
            for piece in byte_slices(filled(batch)):
                pairs = np.unique(np.stack(buckets(piece)), axis=1)
                out.append(pairs[1].astype(np.int32))
                counts += (counts[-1] + np.cumsum(np.bincount(pairs[0], minlength=len(piece)))).tolist()
            flat = np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(flat))

    sample = checkpointed(sample.select("id", "label", "part", hashed("text").alias("at")))

    def learner(sent, turn: int):
        def learn(frame: pd.DataFrame) -> pd.DataFrame:
            own = Ftrl(*sent.value)
            frame = frame.sort_values("id", kind="stable")
            rows = [(np.append(at, len(own.z) - 1).astype(np.int64), float(y > 0)) for at, y in zip(frame["at"], frame["label"], strict=True)]
            order = np.random.default_rng(turn)
            for _ in range(PASSES):
                for i in order.permutation(len(rows)):
                    own.learn(*rows[i])
            moved = np.flatnonzero((own.z != sent.value[0]) | (own.n != sent.value[1]))
            return pd.DataFrame({"bucket": moved, "z": (own.z - sent.value[0])[moved], "n": (own.n - sent.value[1])[moved]})

        return learn

    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((state.z, state.n))
        parts = sample.groupBy("part").applyInPandas(learner(sent, turn), "bucket long, z double, n double")
        # The mean over all parts; at most one row for each bucket comes back.
        moved = parts.groupBy("bucket").agg((F.sum("z") / PARTS).alias("z"), (F.sum("n") / PARTS).alias("n")).where(f"abs(z) > {L1 / 50}").toArrow()
        at = np.asarray(moved.column("bucket"))
        state.z[at] += np.asarray(moved.column("z"))
        state.n[at] += np.asarray(moved.column("n"))
        sent.unpersist()
    return state.weights(slice(None))


def score_toxicity(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """The rows with ``score`` (0 to 1) and ``predicted`` (1 from 0.5) of each whole text.

    A null or empty text has the score of the bias. A repeated n-gram counts
    once. Columns of these names are replaced.
    """
    some = np.flatnonzero(weights[:-1])
    sent = docs.sparkSession.sparkContext.broadcast((some.astype(np.int32), weights[some], float(weights[-1])))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, values, bias = sent.value
        dense = np.zeros(1 << BUCKET_BITS)
        dense[at] = values
        for batch in batches:
            out = [np.zeros(0)]
            for part in byte_slices(filled(batch)):
                rows, found = buckets(part)
                some = dense[found] != 0
                pairs = np.unique(np.stack([rows[some], found[some]]), axis=1)
                ends = np.concatenate([[0], np.cumsum(np.bincount(pairs[0], minlength=len(part)))])
                margin = bias + sums_by_row(dense[pairs[1]], ends)
                out.append(1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))))
            yield pa.array(np.concatenate(out))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*kept, score(F.col(f"`{text}`")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
