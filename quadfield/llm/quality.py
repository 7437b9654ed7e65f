"""Quality classifier: random-indexing word vectors, pooled per document, and a small network with calibrated probabilities.

* Tokens: runs of letters, runs of digits, runs of other characters; lower case and upper case are different tokens.  Tokens are
  hashed to ``BUCKETS`` entries of a vocabulary, so its size doesn't depend on the corpus.
* Random indexing: each entry has a sparse ternary index vector drawn from a seed; an entry's word vector is the sum of the index
  vectors of its neighbours (``WINDOW`` to each side) over all texts of the corpus, plus its own index vector as often as it
  occurs, scaled to length one.  Partial sums are made per task and added up by Spark.
* A document is the mean of its word vectors, its spread around the mean, and the logarithm of its number of tokens.
* A network with one hidden layer is trained by Adam on at most about ``SAMPLE`` labelled rows (a bounded sample, by a hash of
  doc_id); a fifth of them sets the temperature of the probabilities.

Null and empty texts have zero vectors and get the network's score for them.  Rows of labels with a null quality don't count; of
repeated labels the largest counts.  Without labels all scores are 0.5; with labels of one kind, close to it.  Repeated rows are
scored alike; other columns are passed through by ``keep_good``.  Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadfield.llm.common import staged

BUCKETS, DIMS, NONZERO, WINDOW, SEED = 1 << 14, 48, 4, 2, 11
SAMPLE, HIDDEN, EPOCHS = 20_000, 32, 40
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_STEP = 1 << 15


class Hashed(dict):
    """Token -> vocabulary entry, for a bounded number of tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        entry = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return entry

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero components of each entry's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice([-1, 1], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMS) unit vectors gathered from all texts; zero for entries that never occur."""
    def run(batches):
        place, sign = index_vectors()
        total, hashed = np.zeros(BUCKETS * DIMS, np.int64), Hashed()
        seen = np.zeros(BUCKETS, np.int64)

        def add(w, c):
            np.add.at(total, (w[:, None].astype(np.int64) * DIMS + place[c]).ravel(), sign[c].ravel())

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = hashed(text)
                seen += np.bincount(ids, minlength=BUCKETS) if len(ids) > 2000 else 0
                if len(ids) <= 2000:
                    np.add.at(seen, ids, 1)
                for at in range(0, len(ids), _STEP):
                    part = ids[at : at + _STEP + WINDOW]
                    for o in range(1, WINDOW + 1):
                        left, right = part[:-o][:_STEP], part[o:][:_STEP]
                        add(left, right)
                        add(right, left)
        grid = total.reshape(BUCKETS, DIMS)
        for j in range(NONZERO):
            np.add.at(grid, (np.arange(BUCKETS), place[:, j]), sign[:, j] * seen)
        some = np.flatnonzero(seen)
        for at in range(0, len(some), 2048):
            e = some[at : at + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(e.astype(np.int32)), *(pa.array(grid[e, d]) for d in range(DIMS))], names=["entry", *(f"v{d}" for d in range(DIMS))])

    dims = [f"v{d}" for d in range(DIMS)]
    parts = docs.select("text").mapInArrow(run, "entry int, " + ", ".join(f"{d} long" for d in dims))
    rows = parts.groupBy("entry").agg(*[F.sum(d).alias(d) for d in dims]).toArrow()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIMS))
    if rows.num_rows:
        out[rows.column("entry").to_numpy()] = np.stack([rows.column(d).to_numpy() for d in dims], axis=1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of one document."""
    if not len(ids):
        return np.zeros(2 * DIMS + 1, np.float32)
    own, times = np.unique(ids, return_counts=True)  # BUCKETS at most
    share, v = (times / len(ids)).astype(np.float32), vectors[own]
    mean = share @ v
    return np.r_[mean, np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0)), np.log1p(len(ids))].astype(np.float32)


# network


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> dict:
    """Two-layer network, standardised inputs, temperature from a held-back fifth."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(2 * DIMS + 1), np.ones(2 * DIMS + 1))
    model = {"mean": mean, "scale": scale, "w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.zeros(1), "t": 1.0}
    if not len(x):
        return model
    order = rng.permutation(len(x))
    back, own = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - mean) / scale
    names, step = ("w1", "b1", "w2", "b2"), 0
    moments = {n: [np.zeros_like(model[n]), np.zeros_like(model[n])] for n in names}
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for at in range(0, len(own), 256):
            k = own[at : at + 256]
            h = np.tanh(z[k] @ model["w1"] + model["b1"])
            p = 1 / (1 + np.exp(-(h @ model["w2"] + model["b2"])))
            e = (p - y[k]) / len(k)
            dh = np.outer(e, model["w2"]) * (1 - h * h)
            grads = {"w1": z[k].T @ dh + 1e-4 * model["w1"], "b1": dh.sum(0), "w2": h.T @ e + 1e-4 * model["w2"], "b2": np.array([e.sum()])}
            step += 1
            for n in names:
                m, v = moments[n]
                m += 0.1 * (grads[n] - m)
                v += 0.001 * (grads[n] ** 2 - v)
                model[n] = model[n] - 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(back):
        raw = _logit(z[back], model)

        def loss(t):
            s = np.clip(raw / t, -30, 30)
            return np.mean(np.log1p(np.exp(-s)) * y[back] + np.log1p(np.exp(s)) * (1 - y[back]))

        model["t"] = float(min(np.geomspace(0.5, 8, 49), key=loss))
    return model


def _logit(z: np.ndarray, model: dict) -> np.ndarray:
    return np.tanh(z @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]


def score(x: np.ndarray, model: dict) -> np.ndarray:
    """Calibrated probability that the label is 1."""
    return 1 / (1 + np.exp(-np.clip(_logit((x - model["mean"]) / model["scale"], model) / model["t"], -60, 60)))


# on tables


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> tuple[np.ndarray, dict]:
    """Word vectors from all of ``docs`` and a network from labelled rows for which ``learnable`` holds (of labels: doc_id)."""
    vectors = word_vectors(docs)

    def run(batches):
        hashed = Hashed()
        for b in batches:
            x = [pooled(hashed(t), vectors).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)], names=["doc_id", "x", "y"])

    known = labels.filter(learnable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    known = staged(known.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))))
    share = min(1.0, sample / max(1, known.count()))
    known = known.filter(F.col("draw") < int(share * (1 << 30))).select("doc_id", "y")
    # the sample is bounded by a parameter, so its ids may go to all tasks and the texts stay where they are
    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    got = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary, y int").toArrow()
    got = got.take(pa.compute.sort_indices(got, [("doc_id", "ascending"), ("x", "ascending")]))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, 2 * DIMS + 1).astype(np.float64)
    return vectors, train(x, got.column("y").to_numpy().astype(np.float64))


def _scorer(vectors, model):
    hashed = Hashed()
    return lambda texts: score(np.stack([pooled(hashed(t), vectors) for t in texts]).astype(np.float64), model) if texts else np.zeros(0)


def scores(docs: DataFrame, fitted: tuple[np.ndarray, dict], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted."""
    def run(batches):
        of = _scorer(*fitted)
        for b in batches:
            s = of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, fitted: tuple[np.ndarray, dict], threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't rejected, all columns, without a shuffle."""
    def run(batches):
        of = _scorer(*fitted)
        for b in batches:
            yield b.filter(pa.array(of(b.column(b.schema.get_field_index("text")).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    fitted = fit(docs, labels, ~held_out(F.col("doc_id")))
    return scores(docs, fitted).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
