"""Best-fit packing of tokenised documents into sequences of fixed length, by linear grouping.

Lengths are at most the capacity, so their counts are a table of bounded size, and all optimisation works on that table:

1. large lengths, in falling order, are cut into groups of equally many pieces, and each group is rounded up to its largest;
2. for these few sizes, configurations (how many pieces of which group one sequence takes) are found by column generation:
   a simplex over the configurations known, and a knapsack that proposes the next one. Their numbers are rounded down, and
   the few pieces that are left are placed by best fit;
3. each actual piece takes a place of its group: its rank among the pieces of its length gives group, place and sequence by arithmetic;
4. what is left free in the sequences is counted again, and small lengths are filled in by best fit, longest first, on
   the table of gaps; pieces and sequences meet by their ranks. What fits nowhere opens new sequences.

Spark encodes, ranks, joins and numbers the pieces; texts are read once and never shuffled.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from columnscope.llm.storage import materialise, only
from columnscope.llm.word_ids import WordEncoder

GROUPS = 64
# Lengths over this part of the capacity are large. The smaller the part, the more a sequence loses to rounding before it is filled.
LARGE_PART = 3
RANK_ROWS = 100_000
_TEXT_BYTES = 4 << 20


def pieces(df: DataFrame, id: str, text: str, tokenizer: str, capacity: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents, ended by id 0, cut into pieces of ``capacity`` where they are longer."""
    docs = only(df, id=id, text=text)
    kind = dict(docs.dtypes)["id"]

    def cut(batches):
        encoder = WordEncoder.of(tokenizer)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows, at = [], 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and held < _TEXT_BYTES:
                    held += len(texts[to] or b"")
                    to += 1
                for i, ids in enumerate(encoder.encode([t or b"" for t in texts[at:to]]), at):
                    ids += bytes(4)
                    for start in range(0, len(ids), 4 * capacity):
                        part = ids[start:start + 4 * capacity]
                        rows.append((i, start // (4 * capacity), start // 4, len(part) // 4, zlib.crc32(part)))
                at = to
            if rows:
                owner, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Which of the rising ``sizes``, each any number of times, are worth most within ``capacity``."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(int(sizes[0]), capacity + 1):
        worth = best[room - sizes[:fits[room]]] + values[:fits[room]]
        k = int(worth.argmax())
        if worth[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = worth[k], k
        else:
            best[room] = best[room - 1]
    taken, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            taken[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), taken


def configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, number of sequences) that hold ``wanted`` pieces of rising ``sizes`` in few sequences.

    Every simplex step leaves a plan that holds all pieces, so its bound on steps costs sequences at most.
    """
    basis = np.diag((capacity // sizes).astype(float))
    amounts = wanted / np.diag(basis)
    for _ in range(40 * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, taken = _configuration(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, taken)
        steps = np.where(change > 1e-9, amounts / np.maximum(change, 1e-9), np.inf)
        out = int(steps.argmin())
        amounts = np.maximum(amounts - steps[out] * change, 0)
        amounts[out], basis[:, out] = steps[out], taken
    found: Counter = Counter()
    left = wanted.copy()
    for k in np.argsort(-amounts, kind="stable"):
        column = basis[:, k].astype(np.int64)
        times = min(int(amounts[k] + 1e-9), int((left[column > 0] // column[column > 0]).min()))
        if times > 0:
            found[tuple(column.tolist())] += times
            left = left - times * column
    open_rooms: list[tuple[int, int]] = []
    opened: list[np.ndarray] = []
    for k in reversed(range(len(sizes))):
        for _ in range(int(left[k])):
            at = bisect.bisect_left(open_rooms, (int(sizes[k]), -1))
            room, number = open_rooms.pop(at) if at < len(open_rooms) else (capacity, len(opened))
            if number == len(opened):
                opened.append(np.zeros(len(sizes), np.int64))
            opened[number][k] += 1
            bisect.insort(open_rooms, (room - int(sizes[k]), number))
    found.update(tuple(o.tolist()) for o in opened)
    return [(np.array(config), times) for config, times in found.items()]


class LargePlan:
    """Sequence of the r-th piece, in falling order of length, of all large ones."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = GROUPS):
        lengths = sorted(counts, reverse=True)
        total = sum(counts.values())
        each = max(1, -(-total // groups))
        ends = np.cumsum([counts[n] for n in lengths])
        self.before = dict(zip(lengths, (ends - [counts[n] for n in lengths]).tolist()))
        firsts = np.arange(0, total, each)
        tops = np.array(lengths)[np.searchsorted(ends, firsts, "right")] if total else np.zeros(0, np.int64)
        # groups that are rounded up to one size are one
        starts = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]]) if total else np.zeros(0, np.int64)
        self.group_starts = firsts[starts]
        sizes, wanted = tops[starts], np.diff(np.r_[self.group_starts, total])
        chosen = configurations(sizes[::-1], wanted[::-1], capacity) if total else []
        rows, self.sequences, used = [], 0, np.zeros(len(sizes), np.int64)
        for config, times in chosen:
            for group, pieces_each in enumerate(config[::-1].tolist()):
                if pieces_each:
                    rows.append((group, int(used[group]), pieces_each, self.sequences))
                    used[group] += pieces_each * times
            self.sequences += times
        assert (used == wanted).all()
        # the places of a group stand together, numbered as its pieces are
        rows.sort()
        self.place = np.array([self.group_starts[g] + first for g, first, _, _ in rows], np.int64)
        self.each = np.array([e for _, _, e, _ in rows], np.int64)
        self.sequence = np.array([s for _, _, _, s in rows], np.int64)

    def __call__(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.place, rank, "right") - 1
        return self.sequence[at] + (rank - self.place[at]) // self.each[at]


def fill(gaps: dict[int, int], small: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Best fit of small lengths, longest first, into gaps given by their counts.

    (length, rank of the first piece, gap, rank of the first sequence, pieces) of runs of pieces that go to a run of the
    sequences that had the gap at first (0: new sequences), and the number of new sequences.
    """
    held: dict[int, list[tuple]] = {g: [(g, 0, n)] for g, n in gaps.items() if n}
    order = sorted(held)
    moves, opened = [], 0

    def put(gap: int, runs: list[tuple]) -> None:
        if gap and runs:
            if gap not in held:
                held[gap] = []
                bisect.insort(order, gap)
            held[gap].extend(runs)

    for length in sorted(small, reverse=True):
        rank, left = 0, small[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                new = -(-left // (capacity // length))
                put(capacity, [(0, opened, new)])
                opened += new
                continue
            gap = order.pop(at)
            runs, moved = held.pop(gap), []
            while runs and left:
                origin, first, n = runs.pop(0)
                taken = min(n, left)
                moves.append((length, rank, origin, first, taken))
                moved.append((origin, first, taken))
                rank, left = rank + taken, left - taken
                if taken < n:
                    runs.insert(0, (origin, first + taken, n - taken))
            put(gap, runs)
            put(gap - length, moved)
    return moves, opened


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``name``: the rank from 0 of a row among those of its key, any number of which may share one, equal rows too.

    The rows of a written table are dealt over buckets by their place in it and numbered there; the buckets before add their counts.
    """
    buckets = max(1, -(-df.count() // RANK_ROWS))
    dealt = df.withColumn("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int"))
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1)
    sizes = dealt.groupBy(key, "bucket").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(before.select(key, "bucket", F.coalesce("before", F.lit(0)).alias("before")), [key, "bucket"]).withColumn(
        name, (F.col(name) + F.col("before")).cast("long")
    ).drop("bucket", "before")


def _counts(df: DataFrame, column: str) -> dict[int, int]:
    """Rows of each value of a column with as many values as the capacity at most."""
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


_PIECE = ["id", "piece", "start", "length", "ids_crc32"]


def pack(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", *, capacity: int = 2048, groups: int = GROUPS) -> DataFrame:
    """One row a piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and id 0; a null or empty text is id 0 alone. Null ids are kept, rows of one id are packed each by itself, an
    empty table gives no rows; other columns are not looked at. Pieces of a sequence lie from offset 0 without gaps, longest first.
    """
    if capacity < 2:
        raise ValueError("capacity must be at least 2")
    cut = materialise(pieces(df, id, text, tokenizer, capacity))
    placed = materialise(ranked(cut, "length", ["id", "piece", "start", "ids_crc32"], "rank"))
    counts = _counts(placed, "length")
    limit = max(1, capacity // LARGE_PART)
    plan = LargePlan({n: c for n, c in counts.items() if n > limit}, capacity, groups)
    kind = dict(placed.dtypes)["id"]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long"

    def substituted(batches):
        before = np.zeros(capacity + 1, np.int64)
        before[list(plan.before)] = list(plan.before.values())
        for batch in batches:
            rank = before[batch.column("length").to_numpy()] + batch.column("rank").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PIECE), pa.array(plan(rank))], names=[*_PIECE, "sequence_id"])

    large = placed.where(F.col("length") > limit).select(*_PIECE, "rank").mapInArrow(substituted, schema)
    small = placed.where(F.col("length") <= limit)
    room = (F.lit(capacity) - F.sum("length")).alias("gap")
    least = min((n for n in counts if n <= limit), default=capacity + 1)
    free = materialise(large.groupBy("sequence_id").agg(room).where(F.col("gap") >= least))
    moves, _ = fill(_counts(free, "gap"), {n: c for n, c in counts.items() if n <= limit}, capacity)
    moves.sort()
    key = np.array([(m[0] << 40) + m[1] for m in moves], np.int64)
    first, origin, target = (np.array([m[k] for m in moves], np.int64) for k in (1, 2, 3))

    def dealt(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 40) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in _PIECE), pa.array(origin[at]), pa.array(target[at] + rank - first[at])], names=[*_PIECE, "gap", "gap_rank"]
            )

    dealt_out = small.select(*_PIECE, "rank").mapInArrow(dealt, schema.replace("sequence_id long", "gap long, gap_rank long"))
    places = ranked(free, "gap", ["sequence_id"], "gap_rank")
    filled = dealt_out.join(places, ["gap", "gap_rank"], "left").select(*_PIECE, F.coalesce("sequence_id", F.col("gap_rank") + plan.sequences).alias("sequence_id"))
    return _with_offsets(large.unionAll(filled)).select(
        F.col("id").alias(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def _with_offsets(packed: DataFrame) -> DataFrame:
    order: list[Column] = [F.desc("length"), F.col("id"), F.col("piece"), F.col("ids_crc32")]
    within = Window.partitionBy("sequence_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
