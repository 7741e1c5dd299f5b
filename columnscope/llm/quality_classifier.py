"""Quality of documents from random-indexing word vectors and a small network with calibrated probabilities.

Every token (a run of letters and digits, or of other signs) has a sparse random index vector that follows from its hash. A token's
context vector is the sum of the index vectors of its neighbours, over all documents, labelled or not; tokens are
hashed to a fixed number of rows, so the table has a fixed size. A document is the mean of its tokens' context and
index vectors, with its length and how much its tokens repeat. A two-layer network learns from a bounded sample of
labelled documents, and a temperature fitted on others makes its probabilities honest.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.llm.storage import only, written
from columnscope.llm.words import Tables, mixed, table, text_bytes

ROW_BITS, SIZE = 14, 32
ROWS = 1 << ROW_BITS
BLOCK_ROWS = 1 << 10
GROUP = 1 << 18
# The network learns from about so many labelled documents at most, its temperature from as many others.
TRAINING_ROWS, CALIBRATION_ROWS = 20_000, 20_000
HIDDEN, EPOCHS, BATCH, RATE, SHRINKAGE = 32, 30, 256, 3e-3, 1e-4


def _classes() -> np.ndarray:
    """0 white space and control, 1 letters, digits and all beyond ASCII, 2 other signs."""
    found = np.zeros(256, np.uint8)
    found[33:127] = 2
    for first, last in ((48, 57), (65, 90), (97, 122), (128, 255)):
        found[first:last + 1] = 1
    return found


def tokens(data: np.ndarray, offsets: np.ndarray, tables: Tables, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a group of texts, and each text's bounds."""
    n = len(data)
    kind = classes[data]
    change = np.ones(n + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    cuts = np.flatnonzero(change)
    starts = cuts[:-1][kind[cuts[:-1]] > 0] if n else cuts[:0]
    ends = cuts[1:][kind[cuts[:-1]] > 0] if n else cuts[:0]
    tables.up_to(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tables.values[data] * tables.powers[:n], out=sums[1:], dtype=np.uint64)
        hashes = mixed((sums[ends] - sums[starts]) * tables.inverses[starts])
    return hashes, np.searchsorted(starts, offsets)


def _groups(batches):
    tables, classes = Tables(lower=False), _classes()
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, "right")) - 1)
            own = offsets[at:to + 1] - offsets[at]
            yield batch.slice(at, to - at), *tokens(data[offsets[at]:offsets[to]], own, tables, classes)
            at = to


def index_vectors() -> np.ndarray:
    """Index vectors by the 12 bits of a hash that choose two places and their signs."""
    codes = np.arange(1 << 12)
    found = np.zeros((1 << 12, SIZE), np.float32)
    np.add.at(found, (codes, codes & 31), np.where(codes >> 10 & 1, 1, -1))
    np.add.at(found, (codes, codes >> 5 & 31), np.where(codes >> 11 & 1, 1, -1))
    return found


def _rows(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(64 - ROW_BITS)).astype(np.int64), (hashes & np.uint64(0xFFF)).astype(np.int64)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Sum of the neighbours' index vectors for every row of tokens, each row scaled to length 1.

    The neighbour on the right counts at its place, the one on the left at the next place, so that order matters.
    Tasks send their sums in blocks, which are added up where Spark has dealt them; the whole is 2 MB.
    """
    n_blocks, size = ROWS // BLOCK_ROWS, BLOCK_ROWS * SIZE

    def gather(batches):
        sums = np.zeros(ROWS * SIZE, np.int32)
        for _, hashes, bounds in _groups(batches):
            row, code = _rows(hashes)
            follows = np.ones(len(row), bool)
            follows[bounds[:-1][bounds[:-1] < len(row)]] = False
            right = np.flatnonzero(follows)
            for target, neighbour, shift in ((right - 1, right, 0), (right, right - 1, 1)):
                for place, sign in ((0, 10), (5, 11)):
                    at = row[target] * SIZE + ((code[neighbour] >> place) + shift & 31)
                    np.add.at(sums, at, ((code[neighbour] >> sign & 1) * 2 - 1).astype(np.int32))
        for b in range(n_blocks):
            yield table(block=pa.array([b], pa.int32()), sums=pa.array([zlib.compress(sums[b * size:(b + 1) * size].tobytes(), 1)], pa.binary()))

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                total = held.setdefault(block, np.zeros(size, np.int64))
                total += np.frombuffer(zlib.decompress(sums), np.int32)
        for block, total in held.items():
            yield table(block=pa.array([block], pa.int32()), sums=pa.array([total.tobytes()], pa.binary()))

    found = np.zeros((ROWS, SIZE), np.float32)
    for r in docs.select("text").mapInArrow(gather, "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary").toLocalIterator():
        found[r["block"] * BLOCK_ROWS:(r["block"] + 1) * BLOCK_ROWS] = np.frombuffer(r["sums"], np.int64).reshape(BLOCK_ROWS, SIZE)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1)


FEATURES = 2 * SIZE + 4


def document_vectors(docs: DataFrame, contexts: np.ndarray) -> DataFrame:
    """(id, vector) of every row: mean context vector, mean index vector, log length, lengths of the means, distinct share."""
    held = docs.sparkSession.sparkContext.broadcast(contexts)

    def run(batches):
        index = index_vectors()
        for batch, hashes, bounds in _groups(batches):
            own = held.value
            row, code = _rows(hashes)
            sizes = np.diff(bounds)
            out = np.zeros((len(sizes), FEATURES), np.float32)
            full = np.flatnonzero(sizes)
            if len(full):
                at = bounds[:-1][full]
                n = sizes[full][:, None]
                out[full, :SIZE] = np.add.reduceat(own[row], at, axis=0) / n
                out[full, SIZE:2 * SIZE] = np.add.reduceat(index[code], at, axis=0) / n
                text = np.repeat(np.arange(len(sizes)), sizes)
                different = np.unique(text.astype(np.int64) << ROW_BITS | row) >> ROW_BITS
                out[full, -4] = np.log(sizes[full])
                out[full, -3] = np.linalg.norm(out[full, :SIZE], axis=1)
                out[full, -2] = np.linalg.norm(out[full, SIZE:2 * SIZE], axis=1)
                out[full, -1] = np.bincount(different, minlength=len(sizes))[full] / np.sqrt(sizes[full])
            yield table(id=batch.column("id"), vector=pa.array([v.tobytes() for v in out], pa.binary()))

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, vector binary")


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Adam on the log loss in small batches, the same for the same input."""
    rng = np.random.default_rng(seed)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    net = Network(
        x.mean(0) if len(x) else np.zeros(FEATURES), np.maximum(x.std(0), 1e-6) if len(x) else np.ones(FEATURES),
        rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))),
    )
    if not len(x) or y.min() == y.max():
        return net
    z = (x - net.mean) / net.scale
    held = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(v) for v in held], [np.zeros_like(v) for v in held]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            pick = order[at:at + BATCH]
            hidden = np.tanh(z[pick] @ held[0] + held[1])
            error = (_sigmoid(hidden @ held[2] + held[3][0]) - y[pick]) / len(pick)
            back = np.outer(error, held[2]) * (1 - hidden ** 2)
            grads = [z[pick].T @ back + SHRINKAGE * held[0], back.sum(0), hidden.T @ error + SHRINKAGE * held[2], np.array([error.sum()])]
            step += 1
            for v, g, m, s in zip(held, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    net.b2 = float(held[3][0])
    return net


def fitted_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(logits) or y.min() == y.max():
        return 1.0

    def loss(t: float) -> float:
        p = np.clip(_sigmoid(logits / np.exp(t)), 1e-9, 1 - 1e-9)
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def score(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", *, may_learn=None,
          calibrates=None, training_rows: int = TRAINING_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(id, score) of every row of ``df``; score is the probability of label 1.

    ``may_learn`` and ``calibrates`` are predicates on the id column: labels are looked at only where either holds; about
    ``training_rows`` of the first kind (not also of the second) train the network, about ``calibration_rows`` of the second set its
    temperature. A label other than 0 or 1 is none; one given twice counts by its largest value. A null or empty text
    has the zero vector and is scored as such. Null ids and repeated rows are scored like all others. Without usable
    labels every score is the prior; an empty table gives an empty result. Other columns are not looked at.
    """
    docs = only(df, id=id, text=text)
    vectors = written(document_vectors(docs, context_vectors(docs)))
    known = only(labels, id=id, label=label).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    learn = F.lit(True) if may_learn is None else may_learn(F.col("id"))
    adjust = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4)) == 0 if calibrates is None else calibrates(F.col("id"))

    def taken(which, most: int) -> tuple[np.ndarray, np.ndarray]:
        own = known.where(which)
        own = own.sample(min(1.0, most / max(own.count(), 1)), seed=3)
        rows = vectors.join(own, "id").select("id", "vector", "label").toPandas()
        # one order whatever the tasks' order was; only these rows are sorted
        rows["vector"] = rows["vector"].map(bytes)
        rows = rows.sort_values(["id", "vector"])
        x = np.frombuffer(b"".join(rows["vector"]), np.float32).reshape(-1, FEATURES).astype(np.float64)
        return x, rows["label"].to_numpy().astype(np.float64)

    net = fit_network(*taken(learn & ~adjust, training_rows))
    x, y = taken(adjust, calibration_rows)
    net.temperature = fitted_temperature(net.logits(x), y)

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(-1, FEATURES)
            yield table(id=batch.column("id"), score=net.probability(x))

    return vectors.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, score double").withColumnRenamed("id", id)
