"""Exact Jaccard join of word-shingle sets as a metric-space join.

Jaccard distance is a metric. Whole documents are poor pivots, since nearly all sets lie at distance 1 from any of
them; the pivots here are one-shingle sets. The distance of a set x to the pivot {s} is 1 - 1/|x| if s is in x and 1
otherwise, so a set's nearest pivots are its own shingles, and ties are broken by one global order (rare before
frequent, by a count sketch of fixed size, then by hash). Two sets within the join distance differ in so few
shingles that both reach into each other's first pivots; each set is therefore replicated to the regions of its
first pivots, the window that the triangle inequality on set sizes gives, and no link is lost.

Regions join recursively:
1. pivots with one set are dropped, and sets with fewer shared pivots than any link needs; a set's largest PLACES
   regions get its whole text. There sets are ordered by their
   distance to a pivot set, and blocks of them are compared exactly where the triangle inequality leaves a window.
   Regions beyond a fixed size are dealt to chunks.
2. a region with several components is dealt anew to cells of two blocks of its sets. Pairs that met in no chunk, are
   in different components so far, and share enough pivots are compared exactly; a cell with many such pairs joins
   recursively instead, as a region of its own, so that no pairs are formed in it.

Equal sets are joined as one. The result has components, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import blocks, packed_texts, unpacked
from ._shared import materialize, shuffle_partitions
from ._text import LOWER, find_words, gram_hashes, mix, slices, text_bytes
from .components import connected_components

SKETCH_BITS = 18
PLACES = 3
CHUNK_SETS = 500
CHUNK_SHINGLES = 1_500_000
BLOCK = 512
BLOCK_SETS = 512
BLOCK_SHINGLES = 400_000
SMALL = 16  # sets of a cell, up to which cells of one size are gone through together
DENSE = 8  # pairs for each set of a cell, beyond which its texts are sent there instead of pairs

SetsOf = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]  # from bytes and offsets: sorted distinct hashes


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each document; with fewer words, the whole sequence is one."""
    words = find_words(data, offsets)
    h = words.hashes(LOWER)
    grams, first = gram_hashes(h, k), words.first.tolist()
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(gram_hashes(h[a:b], b - a) if b > a else grams[:0])
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each set, as signed numbers."""
    if not sets:
        return np.zeros(0, np.int64)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(np.concatenate(sets)), dtype=np.uint64)])
    ends = np.cumsum(n)
    return mix(sums[ends] - sums[ends - n] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set that links to it."""
    return -(-percent * n // 100)


def needed(n):
    """Pivots that a linked pair must share, for the size of its smaller window."""
    return 1 + n // 32


def first_pivots(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    count = min(len(s), len(s) - least_overlap(len(s), percent) + needed(len(s)))
    rank = levels[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(58) | s >> np.uint64(6)
    return s[np.argsort(rank, kind="stable")[:count]]


def length_partitions(n: np.ndarray, percent: int) -> np.ndarray:
    """Partition of each set length. Bounds grow by 100 / percent, so linked sets lie in one partition or in two that
    are next to each other."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 100 // max(1, percent) + 1)
    return np.searchsorted(np.array(bounds), n, "right")


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def block_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of its component's first set, comparing all pairs that can link."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), size)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    column, owner = (np.cumsum(times > 1) - 1)[place[shared]], owner[shared]
    pivot = int(np.argmax(np.bincount(owner, minlength=m)))
    with_pivot = np.bincount(owner[np.isin(column, column[owner == pivot])], minlength=m)
    distance = 1 - with_pivot / (size + size[pivot] - with_pivot)
    distance[pivot] = 0
    order = np.argsort(distance, kind="stable")
    distance, size = distance[order], size[order]
    owner = np.argsort(order)[owner]
    by_column = np.argsort(column, kind="stable")
    column, owner = column[by_column], owner[by_column]
    window = 1 - percent / 100 + 1e-9
    columns = int(column[-1]) + 1 if len(column) else 0
    starts = range(0, m, BLOCK)
    near = [(i, j) for i in starts for j in starts if j >= i and distance[j] - distance[min(i + BLOCK, m) - 1] <= window]
    common = {pair: 0.0 for pair in near}
    for c in range(0, columns, 4096):
        lo, hi = np.searchsorted(column, [c, c + 4096])
        has = np.zeros((m, min(4096, columns - c)), np.float32)
        has[owner[lo:hi], column[lo:hi] - c] = 1
        for i, j in near:
            common[i, j] = common[i, j] + has[i : i + BLOCK] @ has[j : j + BLOCK].T
    links = []
    for (i, j), shared_count in common.items():
        if columns:
            yes = linked(np.asarray(shared_count).astype(np.int64), size[i : i + BLOCK, None], size[None, j : j + BLOCK], percent)
            yes &= np.abs(distance[i : i + BLOCK, None] - distance[None, j : j + BLOCK]) <= window
            a, b = np.nonzero(yes)
            links.append(np.stack([a + i, b + j]))
    root = np.arange(m)
    if links:
        a, b = np.concatenate(links, axis=1)
        while True:  # smallest label over links, then over labels
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    out = np.empty(m, np.int64)
    out[order] = order[root]
    return out


def _sets_and_sketch(batches: Iterable[pa.RecordBatch], sets_of: SetsOf) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "set_id", "sketch"]
    cells = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        for i, j in slices(offsets):
            sets = sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            flat = np.concatenate(sets)
            cells += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
            yield pa.record_batch([batch["doc_id"][i:j].cast(pa.int64()), pa.array(np.fromiter(map(len, sets), np.int64, j - i)), pa.array(set_ids(sets)), pa.nulls(j - i, pa.binary())], names)
    yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([zstandard.compress(cells.tobytes())], pa.binary())], names)


def _sum_sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for blob in batch["sketch"].to_pylist():
            cells += np.frombuffer(zstandard.decompress(blob), np.int64)
    yield pa.record_batch([pa.array([zstandard.compress(cells.tobytes())], pa.binary())], ["sketch"])


def _pivot_rows(batches: Iterable[pa.RecordBatch], sets_of: SetsOf, percent: int, levels, by_length: bool) -> Iterator[pa.RecordBatch]:
    """A row for each first pivot of each set; by length, one for the set's own partition and one for the next."""
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        for i, j in slices(offsets):
            sets = sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids = set_ids(sets)
            pivots = [first_pivots(s, levels.value, percent) for s in sets]
            counts = np.fromiter(map(len, pivots), np.int64, len(pivots))
            sizes = np.fromiter(map(len, sets), np.int32, len(sets))
            columns = [np.concatenate(pivots), np.repeat(ids, counts), np.repeat(sizes, counts)]
            if by_length:
                part = length_partitions(columns[2], percent).astype(np.uint64)
                columns = [np.concatenate([mix(columns[0] + part), mix(columns[0] + part + np.uint64(1))]), *(np.tile(c, 2) for c in columns[1:])]
            yield pa.record_batch([pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])], ["pivot", "set_id", "n"])


def _shared_pivots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by pivot and set: drops repeated rows, and pivots with one set."""
    held, held_shared = None, False  # the last row so far, whose pivot may go on
    names = ["pivot", "set_id", "n"]

    def row(h: tuple) -> pa.RecordBatch:
        return pa.record_batch([pa.array([h[0]], pa.int64()), pa.array([h[1]], pa.int64()), pa.array([h[2]], pa.int32())], names)

    for batch in batches:
        pivot, ids, n = (batch[c].to_numpy() for c in names)
        if held is not None:
            pivot, ids, n = np.append(held[0], pivot), np.append(held[1], ids), np.append(np.int32(held[2]), n)
        new = np.ones(len(pivot), bool)
        new[1:] = (pivot[1:] != pivot[:-1]) | (ids[1:] != ids[:-1])
        pivot, ids, n = pivot[new], ids[new], n[new]
        same = pivot[1:] == pivot[:-1]
        shared = np.zeros(len(pivot), bool)
        shared[1:] |= same
        shared[:-1] |= same
        if held is not None and held_shared:
            shared[0] = True
        held, held_shared = (int(pivot[-1]), int(ids[-1]), int(n[-1])), bool(shared[-1])
        out = shared[:-1]
        yield pa.record_batch([pa.array(pivot[:-1][out]), pa.array(ids[:-1][out]), pa.array(n[:-1][out].astype(np.int32))], names)
    if held is not None and held_shared:
        yield row(held)


def _read_sets(blobs: list[bytes], sets_of: SetsOf) -> tuple[list[np.ndarray], np.ndarray]:
    sets = sets_of(*unpacked(blobs))
    return sets, set_ids(sets)


REGION_RESULT = "set_id long, root long, pivot long, part int, chunk int"


def _region_components(batches: Iterable[pa.RecordBatch], sets_of: SetsOf, percent: int, chunk_sets: int | None) -> Iterator[pa.RecordBatch]:
    """Rows ordered by pivot, part and set. Without chunk_sets all sets of a part are compared. Large regions come in parts, dealt by a hash of set and pivot, so that each
    region mixes its sets anew and few components are left between parts; a part too large is cut into chunks."""
    region, chunk, held, ids, shingles = None, 0, [], [], 0

    def settle() -> pa.RecordBatch:
        root = block_components(held, percent)
        n = len(ids)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([ids[r] for r in root.tolist()], pa.int64()), pa.array([region[0]] * n, pa.int64()), pa.array([region[1]] * n, pa.int32()), pa.array([chunk] * n, pa.int32())], ["set_id", "root", "pivot", "part", "chunk"])

    for batch in batches:
        for i, j, blobs in blocks(batch["packed"]):
            sets, found = _read_sets(blobs, sets_of)
            places = zip(batch["pivot"][i:j].to_pylist(), batch["part"][i:j].to_pylist(), strict=True)
            for s, is_id, place, set_id in zip(sets, found.tolist(), places, batch["set_id"][i:j].to_pylist(), strict=True):
                if is_id != set_id:
                    continue  # another row of the same doc_id
                if place != region or chunk_sets and (len(ids) >= 2 * chunk_sets or shingles + len(s) > CHUNK_SHINGLES):
                    if ids:
                        yield settle()
                    chunk = chunk + 1 if place == region else 0
                    region, held, ids, shingles = place, [], [], 0
                if ids and ids[-1] == set_id:
                    continue
                held.append(s)
                ids.append(set_id)
                shingles += len(s)
    if ids:
        yield settle()


def _cells(places: DataFrame, block_sets: int) -> DataFrame:
    """The sets of pivots with several components, dealt to cells of two blocks, so that a hot pivot's sets meet in as
    many tasks. The sets of a pivot's largest component have blocks of their own, which meet only the other blocks."""
    counts = places.groupBy("pivot", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    shape = counts.groupBy("pivot").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(F.struct("c", "w", "component")).alias("main"), F.count("*").alias("components")).where("components > 1")
    blocks_of = lambda c, w: F.ceil(F.greatest(c / block_sets, w / BLOCK_SHINGLES)).cast("int")
    others = blocks_of(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w"))
    shape = materialize(shape.select("pivot", F.col("main.component").alias("main"), others.alias("others"), blocks_of(F.col("main.c"), F.col("main.w")).alias("mains")), "shape")
    inside, deal = F.col("component") == F.col("main"), F.xxhash64("set_id", "pivot")
    dealt = places.join(shape, "pivot").withColumn("block", F.when(inside, F.col("others") + F.pmod(deal, F.col("mains"))).otherwise(F.pmod(deal, F.col("others"))).cast("int"))
    meets = F.when(inside, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    dealt = dealt.withColumn("other", F.explode(meets))
    return dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("main", "others", "mains", "other")


PAIR_NAMES = ["a", "b", "needed", "cell"]


def _unmet_pairs(batches: Iterable[pa.RecordBatch], percent: int, small: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by cell, that is pivot and two blocks of its sets. Pairs of different components that can link, met
    in no chunk and, where the blocks differ, lie in both. A cell with many of them gives its sets instead, without b."""
    names = ["pivot", "low", "high", "block", "set_id", "n", "component", "met0", "met1", "met2"]

    def pairs(pivot: np.int64, low: np.int32, high: np.int32, block: np.ndarray, ids: np.ndarray, n: np.ndarray, component: np.ndarray, *met: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(n, kind="stable")  # partners are next to each other
        block, ids, n, component = block[order], ids[order], n[order].astype(np.int64), component[order]
        met = [x[order] for x in met]
        names, number = np.unique(component, return_inverse=True)
        outside = number != np.argmax(np.bincount(number))  # the largest component's sets only as second ones
        firsts, found = np.flatnonzero(outside), []
        first, last = np.searchsorted(n, -(-percent * n // 100), "left"), np.searchsorted(n, 100 * n // percent, "right")
        for i in range(0, len(firsts), BLOCK):
            a = firsts[i : i + BLOCK]
            for j in range(int(first[a[0]]), int(last[a[-1]]), BLOCK):
                b = np.arange(j, min(j + BLOCK, int(last[a[-1]])))
                ok = (component[a, None] != component[None, b]) & (~outside[None, b] | (a[:, None] < b[None, :]))
                ok &= (first[a, None] <= b[None, :]) & (b[None, :] < last[a, None])
                if low != high:
                    ok &= block[a, None] != block[None, b]
                for x in met:
                    for y in met:
                        ok &= x[a, None] != y[None, b]
                x, y = np.nonzero(ok)
                found.append((a[x], b[y]))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (firsts[:0],) * 2
        if len(x) > most * len(ids):
            cell = mix(np.array([pivot]).view(np.uint64) + np.uint64(low) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(high) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
            members = np.union1d(x, y)
            yield pa.record_batch([pa.array(ids[members]), pa.nulls(len(members), pa.int64()), pa.nulls(len(members), pa.int32()), pa.array(np.repeat(cell, len(members)))], PAIR_NAMES)
        elif len(x):
            yield linkable(ids[x], ids[y], np.minimum(n[x], n[y]))

    def linkable(u: np.ndarray, v: np.ndarray, smaller: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(needed(smaller).astype(np.int32)), pa.nulls(len(u), pa.int64())], PAIR_NAMES)

    def small_cells(starts: np.ndarray, size: int, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The same for all cells of one size together."""
        for i in range(size):
            for j in range(i + 1, size):
                a, b = starts + i, starts + j
                low, high = (f(values[5][a], values[5][b]).astype(np.int64) for f in (np.minimum, np.maximum))
                ok = (values[6][a] != values[6][b]) & (100 * low >= percent * high) & ((values[1][a] == values[2][a]) | (values[3][a] != values[3][b]))
                for x in values[7:]:
                    for y in values[7:]:
                        ok &= x[a] != y[b]
                if ok.any():
                    yield linkable(values[4][a[ok]], values[4][b[ok]], low[ok])

    held: list[np.ndarray] = []  # rows of the last cell so far
    for batch in chain(batches, [None]):
        if batch is None:
            values, closed = held, True
        else:
            values, closed = [batch[c].to_numpy(zero_copy_only=False) for c in names], False
            if held:
                values = [np.concatenate(x) for x in zip(held, values, strict=True)]
        if not values or not len(values[0]):
            continue
        cuts = np.flatnonzero((np.diff(values[0]) != 0) | (np.diff(values[1]) != 0) | (np.diff(values[2]) != 0)) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.append(cuts, len(values[0]))
        held = [] if closed else [v[starts[-1] :] for v in values]
        mixed = np.minimum.reduceat(values[6], starts) != np.maximum.reduceat(values[6], starts)
        mixed[-1] &= closed
        sizes = np.where(mixed, ends - starts, 0)
        for size in np.unique(sizes[(sizes > 0) & (sizes <= small)]).tolist():
            yield from small_cells(starts[sizes == size], size, values)
        for k in np.flatnonzero(sizes > small).tolist():
            part = [v[starts[k] : ends[k]] for v in values[3:]]
            yield from pairs(*(v[starts[k]] for v in values[:3]), *part)


def _compare_with_hub(batches: Iterable[pa.RecordBatch], sets_of: SetsOf, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by hub, each hub's own text first."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for i, j, blobs in blocks(batch["packed"]):
            sets, found = _read_sets(blobs, sets_of)
            links: list[tuple[int, int]] = []
            for s, is_id, of, set_id in zip(sets, found.tolist(), batch["hub"][i:j].to_pylist(), batch["set_id"][i:j].to_pylist(), strict=True):
                if is_id != set_id:
                    continue
                if of == set_id:
                    hub, own = of, s
                elif of == hub:
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    if linked(common, len(own), len(s), percent):
                        links.append((of, set_id))
            yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, chunk_sets: int = CHUNK_SETS, sets_of: SetsOf | None = None, block_sets: int = BLOCK_SETS, by_length: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each document.

    Words are lower-cased (A-Z only). Documents link where 100 * shared >= percent * united shingles of `words` words;
    component_id is the smallest doc_id reachable by links. A document without words, or a null text, links with
    nothing, not even its equals. sets_of, which finds other sets of 64-bit hashes in UTF-8 texts, may replace shingles;
    by_length keeps regions apart by set length (see length_partitions). Regions are cut into chunks of chunk_sets, and
    pairs that met in none are sought between blocks of block_sets; neither changes the result. Repeated rows are rows of their own. A row without doc_id gets the component of the
    rows it links with, or none. An empty table gives an empty result. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    sets_of = sets_of or partial(shingle_sets, k=words)
    found = docs.select("doc_id", "text").mapInArrow(partial(_sets_and_sketch, sets_of=sets_of), "doc_id long, n long, set_id long, sketch binary")
    found = materialize(found, "sets")
    sketches = found.where("sketch is not null").select("sketch").repartition(16).mapInArrow(_sum_sketches, "sketch binary").collect()
    cells = sum((np.frombuffer(zstandard.decompress(r[0]), np.int64) for r in sketches), np.zeros(1 << SKETCH_BITS, np.int64))
    levels = spark.sparkContext.broadcast(np.ceil(np.log2(cells + 1)).astype(np.uint8))
    sets = found.where("sketch is null").select("doc_id", "n", "set_id")
    owners = sets.where("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))

    rows = docs.select("text").where(F.length("text") > 0).mapInArrow(partial(_pivot_rows, sets_of=sets_of, percent=percent, levels=levels, by_length=by_length), "pivot long, set_id long, n int")
    rows = rows.repartition(shuffle_partitions(spark), "pivot").sortWithinPartitions("pivot", "set_id")
    regions = materialize(rows.mapInArrow(_shared_pivots, "pivot long, set_id long, n int"), "regions")

    least = f"1 + (({percent} * n + 99) div 100) div 32"  # pivots that any link needs: needed() of the smallest partner
    enough = regions.groupBy("set_id").agg(F.count("*").alias("pivots"), F.max("n").alias("n")).where(f"pivots >= {least}").select("set_id")
    regions = regions.join(enough, "set_id")
    sizes = regions.groupBy("pivot").agg(F.count("*").alias("size")).where("size > 1")
    regions = materialize(regions.join(sizes, "pivot").select("pivot", "set_id", "n", "size"), "regions")
    chosen = regions.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("size"), "pivot"))).alias("pivots"))
    chosen = chosen.select("set_id", F.slice("pivots", 1, PLACES).alias("pivots")).join(owners, "set_id")
    texts = materialize(packed_texts(docs).join(chosen, "doc_id").select("set_id", "pivots", "packed"), "region-texts")

    placed = texts.select("set_id", F.explode("pivots").alias("at"), "packed").select("set_id", F.col("at.pivot").alias("pivot"), F.ceil(-F.col("at.size") / chunk_sets).cast("int").alias("parts"), "packed")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("set_id", "pivot"), F.col("parts")).cast("int")).drop("parts")
    placed = placed.repartition(shuffle_partitions(spark), "pivot", "part").sortWithinPartitions("pivot", "part", "set_id")
    met = materialize(placed.mapInArrow(partial(_region_components, sets_of=sets_of, percent=percent, chunk_sets=chunk_sets), REGION_RESULT), "met")
    stars = connected_components(met.select(F.col("set_id").alias("a"), F.col("root").alias("b")))

    places = met.groupBy("set_id").agg(F.collect_set(F.xxhash64("pivot", "part", "chunk")).alias("met"))
    known = places.join(stars.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("component"), *(F.coalesce(F.try_element_at("met", F.lit(x + 1)), F.xxhash64("set_id", F.lit(x))).alias(f"met{x}") for x in range(PLACES)))
    several = _cells(materialize(regions.drop("size").join(known, "set_id"), "places"), block_sets)
    several = several.repartition(shuffle_partitions(spark), "pivot", "low", "high").sortWithinPartitions("pivot", "low", "high")
    unmet = materialize(several.mapInArrow(partial(_unmet_pairs, percent=percent, small=SMALL, most=DENSE), "a long, b long, needed int, cell long"), "unmet")
    pairs = unmet.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("needed").alias("needed")).where("shared >= needed")
    pairs = materialize(pairs.select("a", "b"), "pairs")
    dense = unmet.where("b is null").select(F.col("a").alias("set_id"), F.col("cell").alias("pivot"), F.lit(0).alias("part")).join(texts.select("set_id", "packed"), "set_id")
    dense = dense.repartition(shuffle_partitions(spark), "pivot").sortWithinPartitions("pivot", "set_id")
    within = dense.mapInArrow(partial(_region_components, sets_of=sets_of, percent=percent, chunk_sets=None), REGION_RESULT).select(F.col("set_id").alias("a"), F.col("root").alias("b"))
    asked = pairs.select(F.col("a").alias("hub"), F.col("b").alias("set_id")).unionByName(pairs.select(F.col("a").alias("hub"), F.col("a").alias("set_id")).distinct())
    beside = asked.join(texts.select("set_id", "packed"), "set_id").withColumn("other", (F.col("hub") != F.col("set_id")).cast("int"))
    beside = beside.repartition(shuffle_partitions(spark), "hub").sortWithinPartitions("hub", "other", "set_id").select("hub", "set_id", "packed")
    more = beside.mapInArrow(partial(_compare_with_hub, sets_of=sets_of, percent=percent), "a long, b long")
    graph = connected_components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more).unionByName(within))

    labelled = owners.join(graph.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    components = labelled.join(least, "root").select("set_id", "component_id")
    return sets.join(components, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of linked documents the row with the smallest doc_id, with all columns.

    Rows of one doc_id count as one document; of several that differ, the one whose columns hash lowest stays. Rows
    without doc_id all stay.
    """
    found = jaccard_components(docs, words, percent).where("doc_id is not null")
    stay = found.groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("stays")).where("stays").select("doc_id")
    own, tie = F.col("row.doc_id"), F.xxhash64(F.to_json("row", {"ignoreNullFields": "false"}))
    rows = docs.select(F.struct("*").alias("row")).where(own.isNotNull()).select("row", own.alias("doc_id"), tie.alias("tie"))
    named = rows.join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", "tie").alias("row")).select("row.*")
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)
