"""Sets of word shingles joined by Jaccard similarity with PartEnum signatures.

Sizes are cut into bands. Two sets whose similarity reaches the threshold differ in at most k features, k fixed by the
band of the smaller one. The features' domain is cut into n parts by hash, and each part into three; of two sets that
differ in k features, some part holds at most one of them (if 2 n > k), so two of its three pieces agree. Each
set emits, for every part, the three pairs of pieces as signatures; similar sets share one.

Thin signatures (few features) would be shared by chance, empty ones by all. They can be left out without losing a
pair: let m be the largest number such that 2 g > k for the number g of a set's parts whose three signatures all hold
m features or more. The argument above applies to these g parts alone, so a set need emit only signatures with at
least m features: the partner's side of the shared one is the same content, and of two sets the larger m holds for
both. Where no m >= 1 exists the set emits under a second seed too, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.llm.components import components
from columnscope.llm.storage import filter_bit, id_filter, lean, materialise, only, passes, small_batches
from columnscope.llm.words import distinct, groups, mixed, seeded, shingles, sums_by, table

_PIECES = 3
_SEEDS = 8
_SKETCH_BITS = 256
# The pairs of a bucket with at most so many members are listed; a longer one is compared in blocks of so many
# features (16 MB of hashes) or members.
LISTED_MEMBERS = 24
BLOCK_FEATURES = 1 << 21
BLOCK_MEMBERS = 2048
# A list of copies or of rows to drop with at most so many ids (16 MB) is sent to all tasks; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def bands(threshold: Fraction, most: int) -> np.ndarray:
    """First sizes of the bands, up to one that holds ``most``; the sizes in a band differ by the threshold squared."""
    found = [1]
    while found[-1] <= most:
        found.append(int(Fraction(found[-1]) / threshold / threshold) + 1)
    return np.array(found, np.int64)


def most_differences(threshold: Fraction, largest: int) -> int:
    """Features in which two similar sets can differ if the smaller one has at most ``largest``.

    Sizes a <= b share at least t (a + b) / (1 + t) features, and b <= a / t, so they differ in at most
    (1 - t) / (1 + t) (a + b), which is largest at a = largest, b = a / t.
    """
    return int((1 - threshold) / (1 + threshold) * (largest + int(Fraction(largest) / threshold)))


def _emit(features: np.ndarray, k: int, band: int) -> Iterator[np.ndarray]:
    """Signatures of one set for one band, seed by seed, until one seed suffices."""
    need = k // 2 + 1  # so many parts: 2 * need > k
    n = need + need // 8 + (1 if need > 1 else 0)
    for seed in range(_SEEDS):
        salt = seeded(1, 100 + seed)[0]
        h = mixed(features ^ salt)
        part = ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
        cell = part * _PIECES + (h & np.uint64(0xFFFF)).astype(np.int64) % _PIECES
        counts = np.bincount(cell, minlength=n * _PIECES).reshape(n, _PIECES)
        g = mixed(h)
        low = np.bincount(cell, (g & np.uint64(0xFFFFFFFF)).astype(np.float64), n * _PIECES).reshape(n, _PIECES)
        high = np.bincount(cell, (g >> np.uint64(32)).astype(np.float64), n * _PIECES).reshape(n, _PIECES)
        held = counts.sum(1, keepdims=True) - counts  # without one piece
        least = held.min(1)
        m = int(np.partition(least, n - need)[n - need])
        last = m >= 1 or seed == _SEEDS - 1
        keep = held >= (m if last else 1)
        low, high = low.sum(1, keepdims=True) - low, high.sum(1, keepdims=True) - high
        with np.errstate(over="ignore"):
            content = mixed(low.astype(np.uint64)) + high.astype(np.uint64)
            place = np.arange(n * _PIECES, dtype=np.uint64).reshape(n, _PIECES)
            place += np.uint64(seed << 40) + np.uint64(band << 48)
            yield (mixed(content) + mixed(place + np.uint64(1)))[keep]
        if last:
            return


def signatures(features: np.ndarray, threshold: Fraction, firsts: np.ndarray) -> np.ndarray:
    """All signatures of one set of distinct hashes: for its own band, and for the lower one its smaller partners are in."""
    size = len(features)
    own = int(np.searchsorted(firsts, size, "right")) - 1
    smallest = -int(-(threshold * size) // 1)
    found = []
    for band in {own, int(np.searchsorted(firsts, smallest, "right")) - 1}:
        k = most_differences(threshold, min(int(firsts[band + 1]) - 1, size))
        # the bound for the whole band, so that both sides cut alike
        k_band = most_differences(threshold, int(firsts[band + 1]) - 1)
        if k >= 1:
            found.extend(_emit(features, k_band, band))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, d1, d2): size and 128-bit digest of each row's set."""
    def run(batches):
        for batch, words in groups(lean(batches)):
            h, bounds = distinct(*shingles(words, width))
            yield table(id=batch.column("id"), n=np.diff(bounds), d1=sums_by(mixed(h), bounds), d2=sums_by(mixed(h ^ np.uint64(0x5BD1E995)), bounds))

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, d1 long, d2 long")


def _signature_rows(docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """(sig, id); of rows of one task with the same set only the first emits (the others are linked by digest)."""
    def run(batches):
        seen: set = set()
        firsts = bands(threshold, 1)
        for batch, words in groups(lean(batches)):
            h, bounds = distinct(*shingles(words, width))
            sizes = np.diff(bounds)
            if len(sizes) and sizes.max() >= firsts[-1]:
                firsts = bands(threshold, int(2 * sizes.max()))
            digests = sums_by(mixed(h), bounds).tolist()
            valid = ~np.asarray(batch.column("id").is_null())
            found, owners = [], []
            for i in np.flatnonzero(valid & (sizes > 0)):
                if digests[i] in seen:
                    continue
                seen.add(digests[i])
                s = signatures(h[bounds[i]:bounds[i + 1]], threshold, firsts)
                found.append(s)
                owners.append(np.full(len(s), i))
            if found:
                at = pa.array(np.concatenate(owners))
                yield table(sig=np.concatenate(found), id=batch.column("id").take(at))

    return docs.mapInArrow(run, f"sig long, id {dict(docs.dtypes)['id']}")


def sketch(features: np.ndarray) -> np.ndarray:
    """Bits that tell in which cells an odd number of features lies; cells are the low bits of a feature, at least one cell for each.

    A feature that only one of two sets has changes one bit, so sets have at least as many differences as their sketches.
    """
    cells = max(_SKETCH_BITS, 1 << (len(features) - 1).bit_length())
    odd = np.bincount((features & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def may_be_alike(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, threshold: Fraction) -> bool:
    """False only where two sets of these sketches and sizes differ too much to reach the threshold."""
    if min(n_x, n_y) * threshold.denominator < threshold.numerator * max(n_x, n_y):
        return False
    # half as many cells: each has the features of two
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    differ = int(np.bitwise_count(x ^ y).sum())
    return differ * (threshold.denominator + threshold.numerator) <= (threshold.denominator - threshold.numerator) * (n_x + n_y)


def _some_sets(docs: DataFrame, width: int, ids: DataFrame, sketches: bool = False) -> DataFrame:
    """(id, n, features) of the rows whose id may be in ``ids``: sorted 64-bit hashes as bytes, or their sketch."""
    held = id_filter(ids, "id")
    form = sketch if sketches else (lambda features: features)

    def run(batches):
        picked = (batch.filter(pa.array(passes(held, batch.column("bit").to_numpy(zero_copy_only=False)))) for batch in lean(batches))
        for part, words in groups(picked):
            h, bounds = distinct(*shingles(words, width))
            features = pa.array([form(h[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield table(id=part.column("id"), n=np.diff(bounds), features=features)

    kind = dict(docs.dtypes)["id"]
    # dealt by id, so that rows are made distinct and joined on either side without another exchange
    return docs.where("id is not null").withColumn("bit", filter_bit("id")).mapInArrow(run, f"id {kind}, n long, features binary").repartition("id").distinct()


def _alike(x: np.ndarray, y: np.ndarray, threshold: Fraction) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers."""
    if min(len(x), len(y)) * threshold.denominator < threshold.numerator * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * threshold.denominator >= threshold.numerator * (len(both) - common)


def _buckets(rows: DataFrame) -> DataFrame:
    """(sig, id, first): members of the signatures that several ids share, of those with the same members only one signature.

    ``rows`` (sig, id) come dealt by signature. Similar sets share hundreds of signatures, so most buckets go here, before
    their members travel. Members are known by their number, first and last one and two sums of hashes.
    """
    def total(seed: int):
        # 32 bits each, so that no number of members overflows
        return F.sum(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 32))

    shared = rows.groupBy("sig").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("members"), total(1).alias("s1"), total(2).alias("s2"))
    chosen = shared.where("first < last").groupBy("first", "last", "members", "s1", "s2").agg(F.min("sig").alias("sig")).select("sig", "first")
    return rows.join(chosen.hint("shuffle_hash"), "sig").select("sig", "id", "first").distinct()


def _compared(pairs: DataFrame, sets: DataFrame, alike) -> DataFrame:
    """Those of the pairs (a, b) that have rows (id, n, features) which ``alike`` finds so."""
    def run(batches):
        for batch in lean(batches):
            x, y, n_x, n_y = (batch.column(c) for c in ("x", "y", "n_x", "n_y"))
            n_x, n_y = n_x.to_pylist(), n_y.to_pylist()
            good = [alike(x[i].as_buffer(), y[i].as_buffer(), n_x[i], n_y[i]) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("n_x"), F.col("features").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("n").alias("n_y"), F.col("features").alias("y")), "b"
    )
    return joined.select("a", "b", "n_x", "n_y", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """Those of the pairs (a, b) that are similar.

    Most pairs share a signature by chance. Sketches, some fortieth of a set's bytes, tell most of them apart, so that whole sets
    travel for few pairs.
    """
    def near(x, y, n_x, n_y):
        return may_be_alike(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), n_x, n_y, threshold)

    def alike(x, y, n_x, n_y):
        return _alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold)

    left = materialise(_compared(pairs, sketches, near).distinct())
    return _compared(left, _some_sets(docs, width, left.select(F.explode(F.array("a", "b")).alias("id"))), alike)


def _compare_blocks(threshold: Fraction):
    """Links between members of different components of a bucket: one pair of blocks a call, joined links only once."""
    def run(frame):
        import pandas as pd

        frame = frame.drop_duplicates(["id", "features"])
        ids, comps = frame["id"].to_numpy(), frame["comp"].to_numpy()
        sets = [np.frombuffer(f, np.uint64) for f in frame["features"]]
        sizes = np.array([len(s) for s in sets])
        left = frame["block"].to_numpy() == frame["i"].to_numpy()
        right = frame["block"].to_numpy() == frame["j"].to_numpy()
        names = {c: x for x, c in enumerate(dict.fromkeys(comps))}
        label = np.array([names[c] for c in comps])
        owner = np.repeat(np.arange(len(sets)), sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        out = []
        # members of the commonest component meet the others when those have their turn
        for x in np.flatnonzero(label != np.bincount(label).argmax()):
            others = ((right & left[x]) | (left & right[x])) & (label != label[x])
            if not others.any():
                continue
            lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            spans = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            common = np.bincount(owner[spans], minlength=len(sets))
            alike = others & (common * threshold.denominator >= threshold.numerator * (sizes + sizes[x] - common))
            for y in np.flatnonzero(alike):
                if label[y] != label[x]:
                    out.append((ids[x], ids[y]))
                    label[label == label[y]] = label[x]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _rest(buckets: DataFrame, comps: DataFrame, docs: DataFrame, sizes: DataFrame, sketches: DataFrame, width: int, threshold: Fraction) -> DataFrame | None:
    """Links between different components that share a bucket: every such pair is compared.

    Pairs with a bucket's first member have been compared before, and buckets with the same members are looked at
    once. The pairs of a short bucket are listed, each once whatever the number of its buckets. A longer bucket is cut
    into blocks of bounded size by hash, and each pair of blocks is a group of its own, so no task gets a whole
    bucket and only links come out of it.
    """
    labelled = buckets.where("id <> first").join(comps.withColumnRenamed("component", "comp"), "id").select("sig", "id", "comp")
    several = labelled.groupBy("sig").agg(
        F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("members"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("s2"),
    ).where("c1 <> c2").groupBy("members", "s1", "s2").agg(F.min("sig").alias("sig")).select("sig", "members")
    left = materialise(labelled.join(several, "sig"))
    if left.isEmpty():
        return None
    kind = dict(docs.dtypes)["id"]
    short = left.where(F.col("members") <= LISTED_MEMBERS).select("sig", "id", "comp")
    other = short.select("sig", F.col("id").alias("b"), F.col("comp").alias("comp_b"))
    pairs = materialise(short.withColumnRenamed("id", "a").join(other, "sig").where("a < b and comp <> comp_b").select("a", "b").distinct())
    links = _verified(pairs, sketches, docs, width, threshold)
    long = left.where(F.col("members") > LISTED_MEMBERS)
    if not long.isEmpty():
        sized = long.join(sizes.groupBy("id").agg(F.max("n").alias("size")), "id")
        most = sized.groupBy("sig").agg(F.max("size").alias("largest"), F.max("members").alias("members"))
        blocks = F.ceil(F.col("members") / F.least(F.lit(BLOCK_MEMBERS), F.greatest(F.lit(2), F.floor(F.lit(BLOCK_FEATURES) / F.col("largest")))))
        cut = long.select("sig", "id", "comp").join(most.select("sig", blocks.cast("int").alias("blocks")), "sig").withColumn(
            "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        ).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        cut = cut.select("sig", "id", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        found = cut.join(_some_sets(docs, width, long).drop("n"), "id").groupBy("sig", "i", "j").applyInPandas(_compare_blocks(threshold), f"a {kind}, b {kind}")
        links = links.unionAll(found)
    return materialise(links.distinct())


def _sets_and_links(docs: DataFrame, width: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """(id, n, d1, d2) of every row, and links (a, b) whose components are those of all similar rows."""
    sets = materialise(_sets(docs, width))
    reps = sets.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    same = materialise(sets.where("n > 0").join(reps, ["d1", "d2"]).select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a <> b").distinct())
    # copies stand for their representative from here on, so that no set is compared with its like
    mixed_ids = sets.groupBy("id").agg(F.min("d1").alias("least"), F.max("d1").alias("most")).where("least <> most")
    moved = materialise(same.select(F.col("b").alias("id"), F.col("a").alias("rep")).join(mixed_ids, "id", "left_anti"))
    # the condition, which joins add to one side alone, is written out so that one exchange serves both
    rows = _signature_rows(docs, width, threshold).where("sig is not null").repartition("sig")
    if moved.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(moved), "id", "left").select("sig", F.coalesce("rep", "id").alias("id"))
    else:
        # only what is shared is worth another exchange
        twice = rows.groupBy("sig").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sig")
        met = rows.join(twice.hint("shuffle_hash"), "sig").join(moved, "id", "left")
        rows = met.select("sig", F.coalesce("rep", "id").alias("id")).where("sig is not null").repartition("sig").distinct()
    buckets = materialise(_buckets(rows))
    stars = buckets.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    stars = materialise(stars)
    links = same
    if not stars.isEmpty():
        sketches = materialise(_some_sets(docs, width, stars.select(F.explode(F.array("a", "b")).alias("id")), sketches=True))
        links = materialise(same.unionAll(_verified(stars, sketches, docs, width, threshold)))
        alone = buckets.select(F.col("id").alias("a"), F.col("id").alias("b")).distinct()
        more = _rest(buckets, components(links.unionAll(alone)), docs, sets, sketches, width, threshold)
        if more is not None:
            links = links.unionAll(more)
    return sets, links


def similar(df: DataFrame, id: str = "doc_id", text: str = "text", *, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """(id, n_shingles, component_id) for every row: who is linked, directly or through others, at ``threshold``.

    Words are lower-cased (A-Z) and cut at white space; a text's set has its distinct runs of ``width`` words, or its
    whole sequence if it has fewer. A text that is null, empty or without words has an empty set and no links. Rows
    with a null id are returned with a null component and link nothing. Rows that share an id count as one document:
    it is linked if any of its texts is. An empty table gives an empty result; other columns are not looked at.

    Equal sets are linked to their smallest id. In every bucket of a shared signature all members are first compared
    with the smallest; what then still belongs to different components is compared pair by pair, in blocks.
    """
    if not Fraction(1, 2) < threshold <= 1:
        raise ValueError("threshold must be over 1/2 and at most 1")
    docs = only(df, id=id, text=text)
    # every job with Python in it ends in here
    with small_batches(df.sparkSession):
        sets, links = _sets_and_links(docs, width, threshold)
    found = components(links)
    return sets.join(found, "id", "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", *, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``df``, all columns, that stay when of every group of linked documents the one of smallest id stays.

    Rows with a null id, and rows without words, have no links and stay; rows that share an id are one document and
    stay or go together.
    """
    found = similar(df, id, text, width=width, threshold=threshold)
    name = "gone"
    while name in df.columns:
        name += "_"
    gone = materialise(found.where(F.col(f"`{id}`") != F.col("component_id")).select(F.col(f"`{id}`").alias(name)).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return df.join(gone, df[f"`{id}`"] == gone[name], "left_anti")
