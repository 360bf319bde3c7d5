"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is cut into runs of letters and digits and runs of other signs; single runs and neighbouring pairs are hashed into
2**BITS features, a text's values being SCALE * count / all counts. A pair of equal runs and a triple of equal runs around
another count once more each as an n-gram without its words: words that training never saw can't tell repetition otherwise
(figures with and without are in the README). Training takes at most about MAX_LABELLED labelled
texts, chosen by hash of their id (the documented bound); they are dealt into shards of about SHARD_ROWS, each shard runs
FTRL-proximal in hash order for EPOCHS passes in a task of its own, and the shards' weights are averaged. The model is one
array of 2**BITS numbers, whatever the data's size; scoring is a sparse dot product per text, over all texts. The bound is
spent only on labels that have a document. What is scored may be fewer documents than those the model learns from.

Ids, labels, language and source never enter a score. Null and empty texts get the score of the bias alone. Repeated rows
get equal scores. Without labels the score is 0.5. Of contradicting labels of one id the lower counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.bytesops import IS_SPACE, U64, chunks, counts_by_text, hashed_pieces, mix, texts_of
from tallyforge.llm.common import fresh, held_out, join_ids, small_batches

BITS = 18
MAX_LABELLED = 20_000
SHARD_ROWS = 2_500
EPOCHS = 3
SCALE = 20.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.0005
MILLION = 1_000_000
BIAS = 1 << BITS  # the bias is one more feature, always 1
#: N-grams without their words: a run beside itself, and a run around another.
TWICE, AROUND = mix(np.array([1, 2], U64))

#: 0 white space, 1 letters, digits and all bytes of other scripts, 2 other signs.
KIND = np.where(IS_SPACE, 0, np.where([chr(i).isalnum() or i >= 128 for i in range(256)], 1, 2)).astype(np.uint8)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For chunks of texts: the feature and the text number of each n-gram, and the number of texts."""
    data, offsets = texts_of(column)
    for i, j in chunks(offsets):
        part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        h, owner = hashed_pieces(part, offs, KIND)
        same = owner[1:] == owner[:-1]
        pairs = mix(h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:])[same]
        twice = same & (h[1:] == h[:-1])
        around = (owner[2:] == owner[:-2]) & (h[2:] == h[:-2])
        found = np.concatenate([h, pairs, np.repeat(TWICE, int(twice.sum())), np.repeat(AROUND, int(around.sum()))]) >> U64(64 - BITS)
        yield found.astype(np.int32), np.concatenate([owner, owner[1:][same], owner[1:][twice], owner[2:][around]]), j - i


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, values = [], []
        for found, owner, n in features(batch.column("tf_text")):
            order = np.argsort(owner, kind="stable")
            found, ends = found[order], np.cumsum(counts_by_text(owner, n))
            for k in range(n):
                cell, count = np.unique(found[ends[k - 1] if k else 0 : ends[k]], return_counts=True)
                ids.append(np.append(cell, np.int32(BIAS)))
                values.append(np.append(SCALE * count / max(1, count.sum()), 1.0).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("tf_shard"), batch.column("tf_order"), batch.column("tf_label"), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["shard", "turn", "label", "ids", "vals"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal passes over (feature ids, values, label) rows in their order."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for ids, x, label in rows:
            w = weights(ids)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA * w
            n[ids] += g * g
    return weights(np.arange(BIAS + 1))


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["turn"], kind="stable")
    w = np.rint(MILLION * ftrl([(np.asarray(i), np.asarray(v, dtype=float), y) for i, v, y in zip(rows["ids"], rows["vals"], rows["label"], strict=True)])).astype(np.int64)
    at = np.flatnonzero(w)
    return pd.DataFrame({"feature": at.astype(np.int32), "weight": w[at]})


def train(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """The model's weights from docs and `labelled`: tf_id (unique), tf_label 0 or 1."""
    small_batches(docs.sparkSession)
    labelled = labelled.join(docs.select(F.col(key).alias("tf_id")).distinct(), "tf_id", "left_semi")
    n = labelled.count()
    chance = min(1.0, MAX_LABELLED / max(1, n))
    chosen = labelled.withColumn("tf_order", F.xxhash64("tf_id", F.lit("train"))).where((F.col("tf_order") / float(2**64) + 0.5) < chance)
    shards = max(1, -(-min(n, MAX_LABELLED) // SHARD_ROWS))
    chosen = chosen.withColumn("tf_shard", F.pmod("tf_order", F.lit(shards)).cast("int"))
    rows = join_ids(docs.select(F.col(key).alias("tf_id"), F.col(text).alias("tf_text")), chosen, "tf_id", "inner", max(2 * MAX_LABELLED, 1000))
    examples = rows.select("tf_text", "tf_shard", "tf_order", "tf_label").mapInArrow(_examples, "shard int, turn long, label int, ids array<int>, vals array<float>")
    parts = examples.groupBy("shard").applyInPandas(_train, "feature int, weight long")
    found = parts.groupBy("feature").agg((F.sum("weight") / (shards * MILLION)).alias("w")).collect()
    out = np.zeros(BIAS + 1)
    for r in found:
        out[r["feature"]] = r["w"]
    return out.astype(np.float32)


def scores(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """The score of each text of a column."""
    out = []
    for found, owner, n in features(column):
        total = np.bincount(owner, weights=model[found], minlength=n)
        out.append(model[BIAS] + SCALE * total / np.maximum(counts_by_text(owner, n), 1))
    logit = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def score(docs: DataFrame, model: np.ndarray, name: str = "score", text: str = "text", least: float | None = None) -> DataFrame:
    """docs with a score column, the last; with `least`, only the rows that reach it. If docs has a column of that name,
    the new one gets an underscore more."""
    small_batches(docs.sparkSession)
    name = fresh(docs, name)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scores(batch.column(at), model)
            batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, name])
            yield batch if least is None else batch.filter(pa.array(got >= least))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_labels(labels: DataFrame) -> DataFrame:
    """tf_id and tf_label of the labels that training may see."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").alias("tf_id")).agg(F.min("quality").cast("int").alias("tf_label"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, known: DataFrame | None = None) -> DataFrame:
    """The documents that the classifier takes for good, with their own columns. The model learns from the labelled
    documents of `known` (docs where it isn't given): what an earlier filter left has hardly any bad ones to learn from."""
    name = fresh(docs, "tf_score")
    return score(docs, train(docs if known is None else known, quality_labels(labels)), name, least=least).drop(name)
