"""Toxicity from two Kneser-Ney character models, one of toxic and one of ordinary documents.

Both models give a character's probability after the 6, 4 and 2 characters before it, each order discounted and
interpolated with the next shorter one. The shortest backs off to what both classes share: continuation counts over
all documents, labelled or not, of how many different contexts a character follows. So a rare word is judged by
its parts, and a part that neither class has seen says nothing. A document's score is the difference of its two
log-likelihoods, per character, turned into a probability.

Contexts are hashed to a fixed number of rows, so the model has a fixed size (below) that can be sent to every task; the
counts behind it come from every document and are added up by Spark. In a very large corpus rare contexts share
rows, which only brings them closer to the shared distribution.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.llm.storage import only, per_worker
from columnscope.llm.words import mixed, table, text_bytes

# Characters are folded to 64 classes: A-Z with a-z, digits, other ASCII, and the bytes of other characters.
SYMBOLS = 64
# (characters of context, bits of its row number): 2^16 + 2^15 + 2^12 rows of 64 cells and two classes.
ORDERS = ((6, 16), (4, 15), (2, 12))
DISCOUNT = 0.75
# Rows of a count table that travel together.
BLOCK_ROWS = 1 << 10
# Texts are looked at in groups of about so many bytes, so that arrays of characters stay in a core's cache.
GROUP = 1 << 17

_FIRST = np.cumsum([0] + [1 << bits for _, bits in ORDERS])
ROWS = int(_FIRST[-1])


def folded() -> np.ndarray:
    classes = np.zeros(256, np.uint8)
    classes[97:123] = classes[65:91] = np.arange(1, 27)
    classes[48:58] = 27
    classes[128:] = 28 + np.arange(128) % (SYMBOLS - 28)
    return classes


def cells(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, first: int = 0) -> list[np.ndarray]:
    """Cell of every character in the table of each order from ``first`` on. Contexts stop at the text's start."""
    x = classes[data].astype(np.uint64)
    n, own = len(x), x.astype(np.int64)
    since = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    h = np.zeros(n, np.uint64)
    found: list[np.ndarray] = []
    wanted = {k: (i, bits) for i, (k, bits) in enumerate(ORDERS) if i >= first}
    for j in range(1, max(wanted) + 1):
        # six bits a character, so that different contexts are different numbers
        h[j:] |= np.where(since[j:] < j, np.uint64(0), x[:-j]) << np.uint64(6 * (j - 1))
        if j in wanted:
            i, bits = wanted[j]
            row = mixed(h + np.uint64(j << 48)) >> np.uint64(64 - bits)
            found.append(((row.astype(np.int64) + _FIRST[i]) * SYMBOLS) + own)
    return found[::-1]


def _texts(batches: Iterator[pa.RecordBatch], size: int = GROUP) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
            at = to


def _counts(docs: DataFrame) -> list[np.ndarray]:
    """Counts of every cell by class (0 ordinary, 1 toxic), and which shortest contexts occur anywhere (2).

    Each task adds up its own documents and sends the cells it has met, in blocks; blocks are added up where Spark has
    dealt them, as a stream. What comes to the driver is the model's fixed size.
    """
    n_blocks = -(-ROWS // BLOCK_ROWS)
    size, last = BLOCK_ROWS * SYMBOLS, int(_FIRST[-2]) * SYMBOLS

    def gather(batches):
        classes = folded()
        held = [np.zeros(ROWS * SYMBOLS, np.int32) for _ in range(2)]
        anywhere = np.zeros(ROWS * SYMBOLS, bool)
        for batch, data, offsets in _texts(batches):
            label = np.array([-1 if v is None else int(v) for v in batch.column("label").to_pylist()])
            anywhere[cells(data, offsets, classes, len(ORDERS) - 1)[0]] = True
            for c in (0, 1):
                if (label == c).any():
                    mine = np.repeat(label == c, np.diff(offsets))
                    sizes = np.diff(offsets)[label == c]
                    for row in cells(data[mine], np.concatenate([[0], np.cumsum(sizes)]), classes):
                        np.add.at(held[c], row, 1)
        for kind, counts in enumerate([*held, anywhere]):
            for b in range(n_blocks):
                part = counts[b * size:(b + 1) * size]
                at = np.flatnonzero(part)
                if len(at):
                    packed = at.astype("<u2").tobytes() + (part[at].astype("<u4").tobytes() if kind < 2 else b"")
                    yield table(block=pa.array([kind * n_blocks + b], pa.int32()), cells=pa.array([zlib.compress(packed, 1)], pa.binary()), n=pa.array([len(at)], pa.int32()))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed, n in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), batch.column("n").to_pylist()):
                total = sums.setdefault(block, np.zeros(size, np.int64))
                raw = zlib.decompress(packed)
                total[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<u4", n, 2 * n) if block < 2 * n_blocks else 1
        for block, total in sums.items():
            yield table(block=pa.array([block], pa.int32()), cells=pa.array([zlib.compress(total.astype(np.float32).tobytes(), 1)], pa.binary()))

    partial = docs.mapInArrow(gather, "block int, cells binary, n int")
    out = [np.zeros(n_blocks * size, np.float32) for _ in range(2)] + [np.zeros(n_blocks * size - last, np.float32)]
    for r in partial.repartition("block").mapInArrow(add, "block int, cells binary").toLocalIterator():
        kind, b = divmod(r["block"], n_blocks)
        start = b * size - (last if kind == 2 else 0)
        out[kind][start:start + size] = np.frombuffer(zlib.decompress(r["cells"]), np.float32)
    return [v.reshape(-1, SYMBOLS) for v in out]


def shared_backoff(anywhere: np.ndarray) -> np.ndarray:
    """How many different shortest contexts each character follows in the whole corpus, as a distribution."""
    counts = (anywhere > 0).sum(0) + 1.0
    return counts / counts.sum()


def interpolated(counts: np.ndarray, backoff: np.ndarray, discount: float = DISCOUNT) -> tuple[np.ndarray, np.ndarray]:
    """Kneser-Ney parts of every row: discounted share of each cell, and the weight of the next shorter order.

    The shortest order has the backoff worked in, so its weight is 0.
    """
    total = counts.sum(1, keepdims=True)
    cut = np.minimum(counts, np.float32(discount))
    seen = np.maximum(total, 1)
    share = (counts - cut) / seen
    weight = np.where(total > 0, cut.sum(1, keepdims=True) / seen, np.float32(1))
    last = slice(int(_FIRST[-2]), None)
    share[last] += weight[last] * backoff.astype(np.float32)
    weight[last] = 0
    return share, weight[:, 0]


@dataclass(frozen=True)
class Model:
    """Both classes' tables as (share, weight)."""

    toxic: tuple[np.ndarray, np.ndarray]
    ordinary: tuple[np.ndarray, np.ndarray]

    def ratio(self, found: list[np.ndarray]) -> np.ndarray:
        """Log of toxic over ordinary probability of every character."""
        out = []
        for share, weight in (self.toxic, self.ordinary):
            flat = share.ravel()
            p = flat[found[-1]]
            for i in range(len(ORDERS) - 2, -1, -1):
                p = flat[found[i]] + weight[found[i] // SYMBOLS] * p
            out.append(p)
        return np.log(out[0] / out[1])


def _sent(docs: DataFrame, model: Model):
    """The tables for all tasks, compressed: most cells are empty."""
    packed = [[zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in tables] for tables in (model.toxic, model.ordinary)]
    return docs.sparkSession.sparkContext.broadcast((str(uuid.uuid4()), packed))


def _received(held) -> Model:
    key, packed = held

    def make() -> Model:
        return Model(*[(np.frombuffer(zlib.decompress(share), np.float32).reshape(-1, SYMBOLS), np.frombuffer(zlib.decompress(weight), np.float32)) for share, weight in packed])

    return per_worker("toxicity", key, make)


def _ratios(docs: DataFrame, sent) -> DataFrame:
    """(id, label, ratio): length-normalised log-likelihood ratio of every document; 0 for an empty one."""
    def run(batches):
        classes, own = folded(), _received(sent.value)
        for batch, data, offsets in _texts(batches):
            ratio = own.ratio(cells(data, offsets, classes)) if len(data) else np.zeros(0, np.float32)
            total = np.concatenate([[0], np.cumsum(ratio, dtype=np.float64)])
            sums = total[offsets[1:]] - total[offsets[:-1]]
            yield table(id=batch.column("id"), label=batch.column("label"), ratio=sums / np.maximum(np.diff(offsets), 1))

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, label int, ratio double")


def fitted_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one feature, by Newton's method with a little shrinkage."""
    if not len(x) or y.min() == y.max():
        return 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    scale = max(float(x.std()), 1e-9)
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


# A table of labels with at most so many rows (12 MB) is sent to all tasks; a longer one is joined by a shuffle.
BROADCAST_LABELS = 500_000
# The line is fitted on at most about so many labelled documents that the models have not counted.
CALIBRATION_ROWS = 50_000


def train(docs: DataFrame) -> Model:
    """Both models from (text, label) rows; null labels add to what the classes share only."""
    ordinary, toxic, anywhere = _counts(docs)
    backoff = shared_backoff(anywhere)
    return Model(interpolated(toxic, backoff), interpolated(ordinary, backoff))


def score(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", *, may_learn=None,
          calibrates=None, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(id, score) of every row of ``df``; score is the probability of label 1.

    ``may_learn`` and ``calibrates`` are predicates on the id column: labels are looked at only where either holds; the
    first kind of rows teaches the two models, the second (not also the first) sets the probability. A label other than
    0 or 1 is none. A null or empty text has ratio 0, so the score of a document that says nothing. Ids without a text
    or label, null ids and repeated rows are used as they are; a label given twice counts by its largest value. Without
    any labels, or in an empty table, scores follow the prior 1/2. Other columns are not looked at.
    """
    docs = only(df, id=id, text=text)
    known = only(labels, id=id, label=label).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    learn = F.lit(True) if may_learn is None else may_learn(F.col("id"))
    adjust = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4)) == 0 if calibrates is None else calibrates(F.col("id"))
    known = known.where(learn | adjust)
    joined = docs.join(F.broadcast(known) if known.count() <= BROADCAST_LABELS else known, "id", "left")
    sent = _sent(docs, train(joined.select("text", F.when(learn & ~adjust, F.col("label")).alias("label"))))
    share = min(1.0, calibration_rows / max(known.where(adjust).count(), 1))
    others = joined.where(adjust & F.col("label").isNotNull()).sample(share, seed=5)
    rows = _ratios(others.select("id", "text", "label"), sent).select("label", "ratio").toPandas().sort_values(["ratio", "label"])
    slope, intercept = fitted_line(rows["ratio"].to_numpy(), rows["label"].to_numpy().astype(float))
    x = F.lit(max(slope, 0.0)) * F.col("ratio") + F.lit(intercept)
    scored = _ratios(docs.withColumn("label", F.lit(None).cast("int")), sent)
    return scored.select(F.col("id").alias(id), (1 / (1 + F.exp(-x))).alias("score"))
