"""A quality classifier on random-indexing word vectors.

Every token has a sparse random index vector; the vector of a token is the sum of the index vectors around it over the
whole corpus, counted by tasks and added up by Spark. A document pools its token vectors, and a two-layer network
trained in numpy on labelled documents scores the pool; a temperature fitted on documents it
did not train on calibrates the probability.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.llm.common import held_out, small_batches, stored, with_small_batches

#: Rows of the table of token vectors (tokens share rows by hash), dimensions, places set in an index vector, and
#: how far around a token its context goes.
ROWS, DIMS, PLACES, REACH = 1 << 14, 32, 2, 2
#: Most labelled rows the network is trained on, chosen by a hash of the key.
TRAINING = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 256, 3e-3, 1e-4
THRESHOLD = 0.7
REMEMBERED = 300_000
TOKENS = re.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+|\n")


def index_vectors(rows: int = ROWS, dims: int = DIMS, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every index vector."""
    random = np.random.default_rng(42)
    at = np.stack([random.permutation(dims)[:places] for _ in range(rows)])
    return at.astype(np.int64), random.choice([-1, 1], (rows, places)).astype(np.int64)


class Tokens:
    """Rows of the vector table for the tokens of texts."""

    def __init__(self) -> None:
        self.numbers, self.rows = defaultdict(count().__next__), np.zeros(0, np.int64)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of all tokens, the number of the text that each is in)."""
        if len(self.numbers) > REMEMBERED:
            self.__init__()
        found, sizes = [], []
        for text in texts:
            tokens = TOKENS.findall((text or "").encode("utf-8").lower())
            found.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens)))
            sizes.append(len(tokens))
        new = list(self.numbers)[len(self.rows):]
        self.rows = np.append(self.rows, np.array([zlib.crc32(t) % ROWS for t in new], np.int64))
        return self.rows[np.concatenate(found)], np.repeat(np.arange(len(texts)), sizes)


def count_contexts(rows: np.ndarray, doc: np.ndarray, at: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of the index vectors around every token, flat by (row, dimension)."""
    total = np.zeros(ROWS * DIMS, np.int64)
    for step in range(1, REACH + 1):
        same = doc[step:] == doc[:-step]
        left, right = rows[:-step][same], rows[step:][same]
        for one, other in ((left, right), (right, left)):
            for k in range(PLACES):
                places = one * DIMS + at[other, k]
                total += np.bincount(places, signs[other, k], ROWS * DIMS).astype(np.int64)
    return total


def tokenised(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id, rows`` of every row: the table rows of its tokens, two little-endian bytes each. Texts are read here alone."""
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in small_batches(batches, "text"):
            rows, doc = tokens.of(batch.column("text").to_pylist())
            flat = rows.astype("<u2").tobytes()
            ends = 2 * np.append(0, np.cumsum(np.bincount(doc, minlength=batch.num_rows)))
            column = pa.array([flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), column], ["id", "rows"])

    return with_small_batches(plain).mapInArrow(run, f"id {dict(plain.dtypes)['id']}, rows binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(rows of all tokens, the number of the document that each is in)."""
    values = batch.column("rows").to_pylist()
    sizes = [len(v) // 2 for v in values]
    return np.frombuffer(b"".join(values), "<u2").astype(np.int64), np.repeat(np.arange(len(values)), sizes)


def token_vectors(tokens: DataFrame) -> np.ndarray:
    """The table of token vectors over all documents: unit rows around their mean. It has ``ROWS`` rows at any size."""
    names = [f"d{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, signs = index_vectors()
        total = np.zeros(ROWS * DIMS, np.int64)
        for batch in small_batches(batches, "rows", 4 << 20):
            rows, doc = _unpacked(batch)
            if len(rows) > 1:
                total += count_contexts(rows, doc, at, signs)
        sums = total.reshape(ROWS, DIMS)
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, i]) for i in range(DIMS))], ["row", *names])

    counted = with_small_batches(tokens.select("rows")).mapInArrow(run, ", ".join(["row bigint", *(f"{n} bigint" for n in names)]))
    summed = counted.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    vectors = np.zeros((ROWS, DIMS))
    vectors[summed["row"].to_numpy()] = summed[names].to_numpy(float)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.maximum(norms, 1e-12)
    used = norms[:, 0] > 0
    if used.any():
        vectors[used] -= vectors[used].mean(axis=0)
    return vectors.astype(np.float32)


WIDTH = 2 * DIMS + 5


def pool(rows: np.ndarray, doc: np.ndarray, texts: int, vectors: np.ndarray) -> np.ndarray:
    """One pooled row per text: mean and spread of its token vectors, how alike neighbours are, and its length."""
    sizes = np.bincount(doc, minlength=texts)
    out = np.zeros((texts, WIDTH), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        each = vectors[rows]
        starts = (np.cumsum(sizes) - sizes)[full]
        n = sizes[full, None]
        mean = np.add.reduceat(each, starts, axis=0) / n
        out[full, :DIMS] = mean
        out[full, DIMS:2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(each * each, starts, axis=0) / n - mean * mean, 0))
        for k in range(1, 5):
            same = doc[k:] == doc[:-k]
            alike = np.zeros(len(rows), np.float32)
            if len(rows) > k:  # of whole stretches: taking pairs out first costs more than their products
                np.einsum("ij,ij->i", each[:-k], each[k:], out=alike[:-k])
                alike[:-k][~same] = 0
            out[full, 2 * DIMS + k - 1] = np.add.reduceat(alike, starts) / n[:, 0]
    out[:, -1] = np.log1p(sizes)
    return out


def pooled(tokens: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``id, pool`` (float32 bytes) of every row."""
    shared = tokens.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "rows", 1 << 19):
            found, doc = _unpacked(batch)
            pools = pool(found, doc, batch.num_rows, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p.tobytes() for p in pools], pa.binary())], ["id", "pool"])

    return with_small_batches(tokens).mapInArrow(run, f"id {dict(tokens.dtypes)['id']}, pool binary")


@dataclass
class Classifier:
    """A two-layer network over standardised pools, with a temperature."""

    center: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    temperature: float = 1.0

    def logits(self, pools: np.ndarray) -> np.ndarray:
        x = np.clip((pools - self.center) / self.scale, -8, 8)
        return np.tanh(x @ self.parts["a"] + self.parts["b"]) @ self.parts["v"] + self.parts["c"]

    def scores(self, pools: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pools) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_classifier(pools: np.ndarray, labels: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Classifier:
    """Adam on four fifths of the rows; the temperature with the least loss on the rest. Without rows scores are 0.5."""
    random = np.random.default_rng(seed)
    width = pools.shape[1]
    parts = {"a": random.standard_normal((width, HIDDEN)) / np.sqrt(width), "b": np.zeros(HIDDEN), "v": np.zeros(HIDDEN), "c": np.zeros(())}
    if len(pools) == 0:
        return Classifier(np.zeros(width), np.ones(width), parts)
    order = random.permutation(len(pools))
    rest, own = (order[: len(order) // 5], order[len(order) // 5:]) if len(order) >= 20 else (order, order)
    model = Classifier(pools[own].mean(axis=0), pools[own].std(axis=0) + 1e-3, parts)
    x, y = np.clip((pools - model.center) / model.scale, -8, 8), labels.astype(float)
    first, second, step = {k: np.zeros_like(v) for k, v in parts.items()}, {k: np.zeros_like(v) for k, v in parts.items()}, 0
    for epoch in range(epochs):
        shuffled = random.permutation(own)
        for at in range(0, len(shuffled), BATCH):
            rows, step = shuffled[at:at + BATCH], step + 1
            hidden = np.tanh(x[rows] @ parts["a"] + parts["b"])
            error = (1 / (1 + np.exp(-np.clip(hidden @ parts["v"] + parts["c"], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, parts["v"]) * (1 - hidden * hidden)
            grads = {"v": hidden.T @ error + DECAY * parts["v"], "c": error.sum(), "a": x[rows].T @ back + DECAY * parts["a"], "b": back.sum(axis=0)}
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                parts[k] = parts[k] - RATE * (1 - 0.9 * epoch / epochs) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    logits = model.logits(pools[rest])
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    model.temperature = float(grid[int(np.argmin([_loss(logits / t, y[rest]) for t in grid]))])
    return model


def training_rows(pools: DataFrame, labels: DataFrame, key: str, label: str, most: int = TRAINING) -> tuple[np.ndarray, np.ndarray]:
    """Pools and labels of about ``most`` labelled rows at most, outside the held-out fold."""
    known = labels.select(F.col(key).alias("id"), F.col(label).alias("label")).filter("id is not null and label is not null")
    usable = known.filter(~held_out(F.col("id")))
    share = min(1.0, most / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1_000_000)) < share * 1_000_000)
    rows = pools.join(chosen, "id").select("id", "label", "pool").collect()
    rows.sort(key=lambda r: (r.id, r.label, bytes(r.pool)))
    x = np.frombuffer(b"".join(bytes(r.pool) for r in rows), np.float32).reshape(-1, WIDTH).astype(np.float64)
    return x, np.array([float(r.label) for r in rows])


def score_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
    threshold: float = THRESHOLD, most: int = TRAINING,
) -> DataFrame:
    """One row per document: ``key, held_out, score, predicted``.

    Token vectors come from all texts, labels only from rows outside the held-out fold; labels of unknown documents, null
    labels and null keys teach nothing, repeated ones teach once each. Null and empty texts pool to zeros and are scored
    like any other. Without usable labels all scores are 0.5. Null and repeated keys are kept as they are, and only
    ``text`` and ``key`` are read. An empty table gives no rows.
    """
    tokens = stored(tokenised(docs, text, key), "tokens")
    pools = stored(pooled(tokens, token_vectors(tokens)), "pools")
    model = fit_classifier(*training_rows(pools, labels, key, label, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("pool").to_pylist()), np.float32).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(x.astype(np.float64)), pa.float64())], ["id", "score"])

    scored = pools.mapInArrow(run, f"id {dict(pools.dtypes)['id']}, score double")
    return scored.select(
        F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
