"""Benchmark passages in documents, found by latent semantic retrieval and confirmed by common subsequences.

Words are hashed to a fixed number of terms; their inverse document frequencies come from every document. Benchmark
items are cut into passages, whose TF-IDF rows are decomposed by a randomised SVD that Spark distributes: tasks add up
A'(A R) for a random R, its orthonormal basis is refined once, and a small matrix gives singular vectors. Documents are
looked at in overlapping windows of two sizes. A window's cosine with a passage is taken in the latent space. The singular
vectors are orthonormal, so it cannot exceed the length of the window's image, nor the window's weight on the benchmark's terms,
times the longest query; windows whose bound is below the threshold are passed over, and no others. Candidates are confirmed on the words themselves: the longest common subsequence with the whole
item and, for weaker ones, the item's answer.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.llm.storage import only
from columnscope.llm.words import Tables, Words, mixed, seeded, table, text_bytes

TERM_BITS = 20
TERMS = 1 << TERM_BITS
RANK = 256
WINDOWS = (16, 32)
# Windows start at multiples of so many words; images are summed up by such steps once and shared by the windows.
STEP = 4
# What is compared around the windows that start in so many words is bounded together.
STRETCH = 64
# Low, as an item whose rarest words are changed keeps little weight but most of its words; what comes of it is confirmed anyhow.
COSINE = 0.1
# A subsequence of this share of the item is a leak by itself; of the lower share, if the answer is found too.
LEAK, LEAK_WITH_ANSWER = 0.7, 0.5
SHORT_ITEM, SHORT_LEAK = 8, 0.9
# The benchmark is taken in blocks of so many items, each with a pass over the documents, so what is sent to tasks is bounded.
BLOCK_ITEMS = 4096
GROUP = 1 << 19
_NOT_WORD = bytes(b for b in range(128) if not chr(b).isalnum())


def _tables() -> Tables:
    """Words here are runs of letters and digits, so that punctuation added to a copy changes nothing.

    Case is folded, also of accented Latin letters, whose last bytes in UTF-8 differ by 32.
    """
    found = Tables(lower=True)
    found.values[0x80:0x9F] = found.values[0xA0:0xBF]
    found.separator[:] = False
    found.separator[list(_NOT_WORD)] = True
    return found


def _groups(batches, name: str = "text"):
    tables = _tables()
    for batch in batches:
        data, offsets = text_bytes(batch.column(name))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, "right")) - 1)
            yield batch.slice(at, to - at), Words(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], tables)
            at = to


def terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + documents with the term)) of every term, over all documents. Tasks send their sums, 4 MB at most."""
    def gather(batches):
        counts, n = np.zeros(TERMS, np.int64), 0
        for _, words in _groups(batches):
            text = np.repeat(np.arange(len(words)), words.counts())
            counts += np.bincount(np.unique(text << TERM_BITS | terms(words.hashes)) & (TERMS - 1), minlength=TERMS)
            n += len(words)
        if n:
            yield table(n=pa.array([n], pa.int64()), counts=pa.array([zlib.compress(counts.astype("<u4").tobytes(), 1)], pa.binary()))

    def add(batches):
        counts, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            for packed in batch.column("counts").to_pylist():
                counts += np.frombuffer(zlib.decompress(packed), "<u4")
        if n:
            yield table(n=pa.array([n], pa.int64()), counts=pa.array([zlib.compress(counts.astype("<u4").tobytes(), 1)], pa.binary()))

    schema = "n long, counts binary"
    total, n = np.zeros(TERMS, np.int64), 0
    # sums of sums: a number of tasks that follows from the shuffle setting, then the driver
    for r in docs.select("text").mapInArrow(gather, schema).repartition(8).mapInArrow(add, schema).collect():
        total += np.frombuffer(zlib.decompress(r["counts"]), "<u4")
        n += r["n"]
    return np.log((1 + n) / (1 + total)).astype(np.float32)


def _row(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and unit-length TF-IDF weights of a passage."""
    at, n = np.unique(found, return_counts=True)
    weight = n * idf[at].astype(np.float64)
    return at, weight / max(float(np.linalg.norm(weight)), 1e-12)


def _pieces(n: int) -> list[tuple[int, int]]:
    """Bounds of the passages of an item with n words."""
    size = WINDOWS[-1]
    if n <= size:
        return [(0, n)] if n else []
    return [(a, min(a + size, n)) for a in range(0, n - size // 2, size // 2)]


def _random_rows(at: np.ndarray, rank: int) -> np.ndarray:
    """Rows of the random matrix R for these terms, the same in every task."""
    bits = mixed(seeded(rank, 77)[None, :] ^ mixed(at.astype(np.uint64) + np.uint64(1))[:, None])
    return np.where(bits >> np.uint64(63), 1.0, -1.0)


def singular_vectors(items: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(terms, V): the terms of the items' passages and their coordinates on the leading right singular vectors.

    Three passes over the items, each a sum over tasks of a table of terms by rank: a range finder, a second one from its
    orthonormal basis (a power iteration), and the small matrix whose eigenvectors turn the basis into singular vectors.
    """
    held = items.sparkSession.sparkContext.broadcast(idf)

    def passages(batches):
        for _, words in _groups(batches):
            found = terms(words.hashes)
            for a, b in zip(words.bounds[:-1], words.bounds[1:]):
                for x, y in _pieces(int(b - a)):
                    yield _row(found[a + x:a + y], held.value)

    def range_of(basis):
        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for at, weight in passages(batches):
                image = weight @ (_random_rows(at, rank) if basis is None else _rows_of(basis, at))
                for t, w in zip(at.tolist(), weight):
                    sums[t] = sums.get(t, 0) + w * image
            if sums:
                yield table(term=pa.array(list(sums), pa.int32()), sums=pa.array([v.tobytes() for v in sums.values()], pa.binary()))

        def add(frames):
            total: dict[int, np.ndarray] = {}
            for batch in frames:
                for t, v in zip(batch.column("term").to_pylist(), batch.column("sums").to_pylist()):
                    total[t] = total.get(t, 0) + np.frombuffer(v)
            if total:
                yield table(term=pa.array(list(total), pa.int32()), sums=pa.array([v.tobytes() for v in total.values()], pa.binary()))

        rows = items.select("text").mapInArrow(run, "term int, sums binary").repartition("term").mapInArrow(add, "term int, sums binary").collect()
        rows.sort(key=lambda r: r["term"])
        at = np.array([r["term"] for r in rows], np.int64)
        image = np.frombuffer(b"".join(bytes(r["sums"]) for r in rows)).reshape(-1, rank) if rows else np.zeros((0, rank))
        return at, np.linalg.qr(image)[0]

    def small(basis):
        def run(batches):
            total, any_ = np.zeros((basis[1].shape[1],) * 2), False
            for at, weight in passages(batches):
                b = weight @ _rows_of(basis, at)
                total += np.outer(b, b)
                any_ = True
            if any_:
                yield table(sums=pa.array([total.tobytes()], pa.binary()))

        k = basis[1].shape[1]
        parts = items.select("text").mapInArrow(run, "sums binary").toLocalIterator()
        return sum((np.frombuffer(r["sums"]).reshape(k, k) for r in parts), np.zeros((k, k)))

    basis = range_of(None)
    if not len(basis[0]):
        return basis
    at, q = basis
    width = q.shape[1]
    if width == rank:
        at, q = range_of(basis)
    values, vectors = np.linalg.eigh(small((at, q)))
    keep = values > 1e-9 * max(values.max(), 1e-12)
    return at, q @ vectors[:, keep]


def _rows_of(basis: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    where = np.searchsorted(basis[0], at)
    where = np.minimum(where, len(basis[0]) - 1)
    return np.where((basis[0][where] == at)[:, None], basis[1][where], 0.0)


@dataclass
class Index:
    """What tasks need to look for a block of items: bounded by the block and the number of terms."""

    idf: np.ndarray
    row_of_term: np.ndarray  # row of ``vectors``; the last row is zero
    vectors: np.ndarray
    queries: np.ndarray  # a passage's latent coordinates, scaled so that the passage itself has product 1 with them
    item_of: np.ndarray
    items: list  # (id, word hashes, answer hashes)

    masks: dict = field(default_factory=dict)  # by item, the places of each word; made where they are needed

    def __post_init__(self):
        """Which items hold a term how often: entries (term, k, item) for its k-th time in the item, so that those up to a count stand together."""
        length = np.array([len(own) for _, own, _ in self.items], np.int64)
        item = np.repeat(np.arange(len(length)), length)
        row = self.row_of_term[terms(np.array([h for _, own, _ in self.items for h in own], np.uint64))].astype(np.int64)
        order = np.lexsort((item, row))
        row, item = row[order], item[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        first = np.flatnonzero(new)
        time = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        order = np.lexsort((time, row))
        row, self.holders = row[order], item[order]
        self.times = int(time.max(initial=0)) + 1
        # sorted, so that the entries of a term up to its c-th time end where (term, c) would be put in
        self.places = row * self.times + time[order]
        self.lengths = length
        self.shares = np.where(length < SHORT_ITEM, SHORT_LEAK, LEAK_WITH_ANSWER)
        # so many words around a window are compared with an item
        self.reach = int((np.where(length < SHORT_ITEM, 2, 1) * length).max(initial=0))

    def common(self, item: int, words: list[int]) -> int:
        """Length of the longest common subsequence with an item, bit-parallel over the item's words; 0 if too short for any leak."""
        own = self.items[item][1]
        if item not in self.masks:
            masks = self.masks[item] = {}
            for i, h in enumerate(own):
                masks[h] = masks.get(h, 0) | 1 << i
        masks = self.masks[item]
        shared = [masks[h] for h in words if h in masks]
        if len(shared) < LEAK_WITH_ANSWER * len(own):
            return 0
        full = (1 << len(own)) - 1
        v = full
        for mask in shared:
            u = v & mask
            v = ((v + u) | (v - u)) & full
        return len(own) - v.bit_count()


def _in_order(wanted: list[int], words: list[int]) -> bool:
    """Whether ``wanted`` stands in ``words`` in one piece."""
    n = len(wanted)
    return any(words[i:i + n] == wanted for i in range(len(words) - n + 1)) if n else False


def build_index(items: DataFrame, idf: np.ndarray, rank: int = RANK) -> Index:
    """``items`` (item, text, answer); without an answer, an item's last quarter stands for it."""
    at, v = singular_vectors(items, idf, rank)
    row_of_term = np.full(TERMS, len(at), np.int32)
    row_of_term[at] = np.arange(len(at))
    tables, held, queries, item_of = _tables(), [], [], []
    for r in items.select("item", "text", "answer").toLocalIterator():
        words = Words(*text_bytes(pa.array([r["text"]], pa.string())), tables)
        answer = Words(*text_bytes(pa.array([r["answer"]], pa.string())), tables).hashes.tolist() if r["answer"] else []
        own = words.hashes.tolist()
        if not own:
            continue
        held.append((r["item"], own, answer or own[-max(1, len(own) // 4):]))
        found = terms(words.hashes)
        for a, b in _pieces(len(own)):
            t, weight = _row(found[a:b], idf)
            q = weight @ _rows_of((at, v), t)
            norm = float(q @ q)
            if norm > 1e-9:
                queries.append(q / norm)
                item_of.append(len(held) - 1)
    width = v.shape[1] if v.ndim == 2 else 0
    return Index(
        idf, row_of_term, np.concatenate([v, np.zeros((1, width))]).astype(np.float32),
        np.array(queries, np.float32).reshape(len(queries), width), np.array(item_of, np.int64), held,
    )


def _windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end word of windows of ``size`` words that overlap by three quarters."""
    n, step = words.counts(), size // 4
    per = np.where(n > 0, np.maximum(-(-(n - size) // step), 0) + 1, 0)
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    first = words.bounds[:-1][text] + k * step
    return text, first, np.minimum(first + size, words.bounds[1:][text])


def _images(words: Words, index: Index, row: np.ndarray, weight: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent sums of every step of STEP words of the wanted texts, and each text's first step; rows of zeros after a text serve windows that pass its end."""
    per = np.where(wanted, -(-words.counts() // STEP) + WINDOWS[-1] // STEP - 1, 0)
    start = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros((start[-1], index.vectors.shape[1]), np.float32)
    # most words are none of the benchmark's
    held = np.flatnonzero(row < len(index.vectors) - 1)
    text = np.searchsorted(words.bounds, held, "right") - 1
    step = start[text] + (held - words.bounds[text]) // STEP
    for at, of, own in zip(*(np.array_split(x, max(1, len(held) // 2048)) for x in (held, step, wanted[text]))):
        at, of = at[own], of[own]
        if len(at):
            rows = index.vectors[row[at]] * weight[at, None]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            size = np.diff(np.append(first, len(at)))
            sums, several = rows[first], np.flatnonzero(size > 1)
            rest = rows[first[several] + 1]
            for k in range(2, STEP):
                more = np.flatnonzero(size[several] > k)
                rest[more] += rows[first[several[more]] + k]
            sums[several] += rest
            out[of[first]] += sums
    return out, start


def _possible(words: Words, index: Index, row: np.ndarray) -> np.ndarray:
    """For each text and item, whether any stretch that a window is confirmed in holds as many of the item's words as a leak needs.

    A common subsequence has no word more often than either side. Stretches hold all that is compared for windows that start in them.
    """
    n, n_items = words.counts(), len(index.items)
    possible = np.zeros((len(n), n_items), bool)
    held = np.flatnonzero(row < len(index.vectors) - 1)
    if not len(held):
        return possible
    text = np.searchsorted(words.bounds, held, "right") - 1
    place = held - words.bounds[text]
    per = -(-n // STRETCH)
    start = np.concatenate([[0], np.cumsum(per)])
    # a word is looked at by every stretch that reaches it
    low = np.maximum(0, (place - index.reach - WINDOWS[-1] - STRETCH) // STRETCH + 1)
    high = np.minimum(per[text] - 1, (place + index.reach) // STRETCH)
    times = high - low + 1
    stretch = np.repeat(start[text] + low - np.cumsum(times) + times, times) + np.arange(times.sum())
    key, count = np.unique(stretch * len(index.vectors) + np.repeat(row[held], times), return_counts=True)
    stretch, term = key // len(index.vectors), key % len(index.vectors)
    first = np.searchsorted(index.places, term * index.times)
    last = np.searchsorted(index.places, term * index.times + np.minimum(count, index.times))
    owner = np.repeat(np.arange(len(n)), per)
    cuts = np.searchsorted(stretch, np.arange(0, start[-1] + 256, 256))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        size = last[a:b] - first[a:b]
        at = np.repeat(first[a:b] - np.cumsum(size) + size, size) + np.arange(size.sum())
        shared = np.bincount(np.repeat(stretch[a:b] - 256 * i, size) * n_items + index.holders[at], minlength=256 * n_items).reshape(-1, n_items)
        s, item = np.nonzero(shared / index.lengths >= index.shares)
        possible[owner[256 * i + s], item] = True
    return possible


def hits(words: Words, index: Index, cosine: float = COSINE):
    """(text, item, cosine, share of the item in common, answer found, first word) of every leak, the best one a text and item."""
    found = terms(words.hashes)
    weight = index.idf[found]
    row = index.row_of_term[found]
    zero = len(index.vectors) - 1
    energy = weight.astype(np.float64) ** 2

    def running(values):
        return np.concatenate([[0.0], np.cumsum(values)])

    total, known = running(energy), running(np.where(row < zero, energy, 0.0))
    best: dict[tuple[int, int], tuple] = {}
    looked: dict[tuple[int, int], list[tuple[int, int]]] = {}
    candidates = []
    if not len(index.queries) or not len(found):
        return []
    # the longest query, and a little for rounding
    most = float(np.linalg.norm(index.queries, axis=1).max()) * 1.0001
    possible = _possible(words, index, row)
    wanted = possible.any(1)
    if not wanted.any():
        return []
    images, steps = _images(words, index, row, weight, wanted)
    for size in WINDOWS:
        text, first, end = _windows(words, size)
        norms = np.sqrt(np.maximum(total[end] - total[first], 1e-12))
        near = np.flatnonzero(wanted[text] & (np.sqrt(np.maximum(known[end] - known[first], 0)) * most >= cosine * norms))
        for part in np.array_split(near, -(-len(near) // 512)) if len(near) else ():
            step = steps[text[part]] + (first[part] - words.bounds[:-1][text[part]]) // STEP
            # parts follow each other in the steps
            image = images[step[0]:step[-1] + 1].copy()
            for j in range(1, size // STEP):
                image += images[step[0] + j:step[-1] + 1 + j]
            image = image[step - step[0]]
            image /= norms[part][:, None].astype(np.float32)
            long = np.einsum("ij,ij->i", image, image) * most ** 2 >= cosine ** 2
            part, image = part[long], image[long]
            a, b = first[part], end[part]
            pairs = possible[text[part]]
            among = np.flatnonzero(pairs.any(0)[index.item_of])
            product = image @ index.queries[among].T
            w, q = np.nonzero((product >= cosine) & pairs[:, index.item_of[among]])
            candidates += zip((-product[w, q]).tolist(), text[part][w].tolist(), index.item_of[among[q]].tolist(), a[w].tolist(), b[w].tolist())
    # best first; a stretch of the text that has been compared with an item is not compared again
    for product, t, item, a, b in sorted(candidates):
        if (t, item) in best:
            continue
        own = index.items[item][1]
        start, stop = int(words.bounds[t]), int(words.bounds[t + 1])
        near_low, near_high = max(start, a - len(own)), min(stop, b + len(own))
        if any(low <= near_low and high >= near_high for low, high in looked.get((t, item), ())):
            continue
        low, high = max(start, a - 2 * len(own)), min(stop, b + 2 * len(own))
        looked.setdefault((t, item), []).append((low, high))
        region = words.hashes[low:high].tolist()
        share = index.common(item, region) / len(own)
        if len(own) < SHORT_ITEM:
            leak = share >= SHORT_LEAK
        else:
            # a long region holds frequent words of any item in some order: only the stretch around the window counts
            near_by = words.hashes[near_low:near_high].tolist()
            share = index.common(item, near_by) / len(own) if share >= LEAK_WITH_ANSWER else 0.0
            leak = share >= LEAK or share >= LEAK_WITH_ANSWER and _in_order(index.items[item][2], near_by)
        if leak:
            best[t, item] = (-product, share, _in_order(index.items[item][2], region), a - start)
    return [(t, item, *values) for (t, item), values in best.items()]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    n = max(1, -(-benchmark.count() // BLOCK_ITEMS))
    return [benchmark] if n == 1 else [benchmark.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _benchmark(benchmark: DataFrame, item: str, text: str, answer: str | None) -> DataFrame:
    held = only(benchmark, item=item, text=text, **({"answer": answer} if answer else {}))
    return held if answer else held.withColumn("answer", F.lit(None).cast("string"))


def leaks(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
          answer: str | None = None, *, rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """(id, item, cosine, common, answer_found, first_word): which documents hold which items; ``common`` is the share
    of the item's words in the longest common subsequence.

    Every text is searched whole. A null or empty document or item leaks nothing. Null ids are kept; repeated rows give
    repeated results; an empty table or benchmark gives none. Items that are equal are found each on its own. Other
    columns are not looked at. The benchmark is the query set: it is sent to the tasks in blocks of bounded size.
    """
    docs = only(df, id=id, text=text)
    idf = inverse_frequencies(docs)
    found = None
    kinds = (dict(docs.dtypes)["id"], dict(benchmark.dtypes)[item])
    for block in _blocks(_benchmark(benchmark, item, item_text, answer)):
        index = build_index(block, idf, rank)

        def run(batches, held=_sent(df, index)):
            own = Index(*held.value)
            for batch, words in _groups(batches):
                rows = hits(words, own, cosine) if len(own.queries) else []
                if rows:
                    t, i, cosines, common, answers, first = zip(*rows)
                    names = pa.array([own.items[x][0] for x in i])
                    yield table(id=batch.column("id").take(pa.array(t)), item=names, cosine=pa.array(cosines), common=pa.array(common),
                                answer_found=pa.array(answers), first_word=pa.array(first, pa.int64()))

        part = docs.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, cosine double, common double, answer_found boolean, first_word long")
        found = part if found is None else found.unionAll(part)
    return found.withColumnsRenamed({"id": id, "item": item})


def _sent(df: DataFrame, index: Index):
    fields = (index.idf, index.row_of_term, index.vectors, index.queries, index.item_of, index.items)
    return df.sparkSession.sparkContext.broadcast(fields)


def clean_rows(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None,
               *, rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """The rows of ``df`` that hold no item of the benchmark, with all their columns."""
    idf = inverse_frequencies(only(df, text=text))
    place = df.columns.index(text)
    for block in _blocks(_benchmark(benchmark, item, item_text, answer)):
        def run(batches, held=_sent(df, build_index(block, idf, rank))):
            own = Index(*held.value)
            for batch in batches:
                named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
                for part, words in _groups(iter([named]), f"c{place}"):
                    good = np.ones(part.num_rows, bool)
                    good[[r[0] for r in hits(words, own, cosine)] if len(own.queries) else []] = False
                    yield part.filter(pa.array(good)).rename_columns(batch.schema.names)

        df = df.mapInArrow(run, df.schema)
    return df
