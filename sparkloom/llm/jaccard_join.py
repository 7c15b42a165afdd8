"""Documents linked by the Jaccard similarity of their word shingles: an exact metric-space join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BASE, OTHER_BASE, Rolling, mix, word_bounds, word_symbols
from .common import dropped, likely, numbered, semi, short_batches, small, text_or_empty, tidy, tidy_groups, written

#: Ratio of the sizes at the ends of a band. Linked sets differ less in size, so each set stands in two bands at most.
BAND = 1.2
#: Below this size, cells allow for one element more or less; above, blocks of fewer than LEAST elements are no cells.
FEW, LEAST = 64, 3
#: Ways to cut the universe that are tried before single elements become cells.
CUTS = 4
#: Numbers that are counted at once: some six arrays of them are held.
AT_ONCE = 500_000


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of fewer words, one hash of all of them."""
    data = lower_ascii(np.frombuffer(text, dtype=np.uint8))
    words = word_symbols(data, *word_bounds(data))
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    n = min(width, len(words))
    return np.unique(Rolling(words).of(np.arange(len(words) - n + 1), n))


class Cells:
    """Cells of sets: two sets with similarity of at least ``least`` / 100 share one, and others hardly ever do.

    Let the smaller set have fewer than U elements. Then their union has at most U / s, and they differ in at
    most D = (1 - s) U / s of them. Cut the universe by hash in D + 1 + spare blocks: in more than ``spare`` of them both agree. A
    block that has LEAST elements or more is a cell. If more than ``spare`` blocks of a set are smaller, it may share only
    such with a linked set, which then has as many of them; so both are also given the cells of another cut, and so
    on. Sets of fewer than FEW elements are cut in D // 2 + 1 + spare blocks, of which more than ``spare`` differ in one element at most; their
    cells are the whole block and the block less each element. A set whose blocks are too small in all of CUTS cuts gets as
    cells its first elements in hash order, one more than a linked set may lack."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.first = -(-least // (100 - least))  # smaller sets are linked to equal ones only
        self.bands = [self.first]

    def _band(self, n: int) -> int:
        while self.bands[-1] <= n:
            self.bands.append(max(self.bands[-1] + 1, int(np.ceil(self.bands[-1] * BAND))))
        return int(np.searchsorted(self.bands, n, side="right")) - 1

    def of(self, elements: np.ndarray) -> np.ndarray:
        n = len(elements)
        if n < self.first:
            return np.zeros(0, dtype=np.uint64)
        out = []
        top = self._band(n)
        least_partner = -(-n * self.least // 100)
        for band in range(self._band(max(self.first, least_partner)), top + 1):
            largest = self.bands[band + 1] - 1
            apart = (100 - self.least) * (100 * largest // self.least) // 100
            few = largest < FEW
            spare = int(apart >= 6) if few else 2 + apart // 10
            blocks = (apart // 2 if few else apart) + 1 + spare
            for cut in range(CUTS):
                e = np.sort(mix(elements + np.uint64(cut * BASE & (1 << 64) - 1))) if cut else elements
                block = ((e >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # rises with the hash
                begin = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                size = np.diff(np.append(begin, n))
                key = np.uint64(((band * CUTS + cut + 1) * BASE) & (1 << 64) - 1) + block[begin] * np.uint64(OTHER_BASE)
                of_element = mix(e + np.repeat(key, size))
                total = np.add.reduceat(of_element, begin)
                large = size >= LEAST
                out.append(mix(total[large]))
                if few:  # a block that differs in one element is the other less that element
                    inner = np.repeat(large & (size > LEAST), size)
                    out.append(mix(np.repeat(total, size)[inner] - of_element[inner]))
                    small_blocks = blocks - int((size > LEAST).sum())
                else:
                    small_blocks = blocks - int(large.sum())
                if small_blocks <= spare:
                    break
            else:
                out.append(mix(elements[: n - least_partner + 1] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        return np.unique(np.concatenate(out))


@lru_cache(maxsize=4)
def cells(least: int) -> Cells:
    return Cells(least)


def prefix(elements: np.ndarray, least: int, frequent: np.ndarray, wider: float = 1.0) -> np.ndarray:
    """The first elements of a set in one order of all: ``frequent`` ones (sorted) last, else by hash. One more than a
    linked set may lack, so linked sets have one of them in common, whatever is taken for frequent."""
    n = len(elements)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        often = frequent[at] == elements
        elements = np.concatenate((elements[~often], elements[often]))
    return elements[: int((n - -(-n * least // 100) + 1) * wider) if n else 0]


SETS = "rid long, doc_id long, n long, class long, cells array<long>"


def _buffers(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _sets(width: int, least: int, frequent=None):
    """``frequent``: None for cells of blocks, else a broadcast of sorted hashes, for prefixes."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = cells(least).of if frequent is None else lambda e: prefix(e, least, frequent.value)
        for batch in batches:
            n, name, found = [], [], []
            for text in _buffers(batch.column("data")):
                e = shingles(text, width)
                n.append(len(e))
                name.append(int.from_bytes(hashlib.blake2b(e.tobytes(), digest_size=8).digest(), "little", signed=True))
                found.append(of(e).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["rid", "doc_id", "n", "class", "cells"],
            )

    return rows


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For a few sets of ``left`` at a time: the first one's index, and how many elements each shares with each of ``right``."""
    of_right = np.repeat(np.arange(len(right), dtype=np.int32), [len(x) for x in right])
    flat = np.concatenate(right) if right else np.zeros(0, dtype=np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, of_right = flat[order], of_right[order]
    del order
    at = 0
    while at < len(left):
        to, work, part = at, 0, []
        while to < len(left) and (to == at or work < AT_ONCE):
            lo, hi = np.searchsorted(flat, left[to], side="left"), np.searchsorted(flat, left[to], side="right")
            part.append((lo, hi - lo))
            work += int((hi - lo).sum())
            to += 1
        lo = np.concatenate([x for x, _ in part])
        many = np.concatenate([x for _, x in part])
        row = np.repeat(np.arange(to - at), [len(x) for x, _ in part])
        met = np.cumsum(many)
        counts = np.zeros((to - at) * len(right), dtype=np.int64)
        done = 0
        while done < len(many):  # a set that shares very much is counted piece by piece
            before = int(met[done - 1]) if done else 0
            stop = max(done + 1, int(np.searchsorted(met, before + AT_ONCE, side="right")))
            n = many[done:stop]
            place = np.repeat(lo[done:stop] - (met[done:stop] - before - n), n) + np.arange(int(n.sum()))
            counts += np.bincount(np.repeat(row[done:stop], n) * len(right) + of_right[place], minlength=len(counts))
            done = stop
        yield at, counts.reshape(to - at, len(right))
        at = to


def linked(shared: np.ndarray, n: np.ndarray, m: np.ndarray, least: int) -> np.ndarray:
    return (shared > 0) & (100 * shared >= least * (n + m - shared))


LINKS = "a long, b long"


def _join_regions(width: int, least: int):
    """Links of the regions of a bundle, as one star for each component of a region."""

    @tidy_groups
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, region in pdf.groupby("region", sort=False):
            region = region.drop_duplicates("member").sort_values("member")
            names = region["member"].to_numpy()
            sets = [shingles(x, width) for x in region["data"]]
            size = np.array([len(x) for x in sets])
            root = np.arange(len(sets))
            for at, shared in overlaps(sets, sets):
                hit = linked(shared, size[at : at + len(shared), None], size[None, :], least)
                for i in range(len(shared)):
                    met = np.unique(root[hit[i]])
                    if len(met) > 1:
                        root[np.isin(root, met)] = met[0]
            out += [(int(names[i]), int(names[r])) for i, r in enumerate(root) if i != r]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return join


ASSIGNED = "region long, parent long, member long, star long"


def _assign(width: int, least: int):
    """Voronoi regions of a region's pivots. A set goes to its nearest pivot, and to each other pivot that is not farther
    by more than twice the radius: else the triangle inequality says that no linked set has that pivot as its nearest."""
    radius = 1 - least / 100

    @tidy_groups
    def assign(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(pivots):  # none was drawn: the region stays as it is
            out = [(region, region, member, None) for region, member in zip(members["region"], members["member"], strict=True)]
        elif len(members):
            pivots = pivots.sort_values("pivot").reset_index(drop=True)
            p_sets = [shingles(x, width) for x in pivots["data"]]
            sets = [shingles(x, width) for x in members["data"]]
            p_size, size = np.array([len(x) for x in p_sets]), np.array([len(x) for x in sets])
            p_name, name = pivots["pivot"].to_numpy(), members["member"].to_numpy()
            parent = int(members["region"].iloc[0])
            p_region = mix(p_name.astype(np.int64).view(np.uint64) + mix(np.array([parent], dtype=np.int64).view(np.uint64))).view(np.int64)
            for at, shared in overlaps(sets, p_sets):
                n = size[at : at + len(shared), None]
                far = 1 - shared / (n + p_size - shared)
                close = linked(shared, n, p_size[None, :], least)
                near = far <= far.min(axis=1, keepdims=True) + 2 * radius + 1e-9
                for i, j in zip(*np.nonzero(near), strict=True):
                    out.append((p_region[j], parent, name[at + i], p_name[j] if close[i, j] else None))
        return pd.DataFrame(out, columns=["region", "parent", "member", "star"]).astype({"region": "int64", "parent": "int64", "member": "int64", "star": "Int64"})

    return assign


def region_links(regions: DataFrame, texts: DataFrame, width: int, least: int, limit: int = 512, pivots: int = 24, levels: int = 5, bundle: int = 6_000_000) -> DataFrame:
    """Links (``a, b``) within each region of ``regions`` (``region, member``), enough to connect what is linked. Texts travel (``member, data``), which are
    smaller than sets of hashes; sets are made where they are compared, about ``bundle`` bytes of texts at a time.

    Regions of up to ``limit`` sets are joined whole. Larger ones are divided again by some ``pivots`` of their own, as long as that
    leaves them in smaller parts without many copies. A dense one, whose sets are all near each other, is not: its sets that are linked to one of the pivots are
    connected by that, and only the others are compared, with all, block against block. So no task holds more than
    about ``limit`` sets, and no pair is left out that could connect anything."""
    spark = regions.sparkSession
    links, whole, todo = [], [], regions
    for level in range(levels + 1):
        sizes = todo.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
        sized = written(sizes.where(F.col("size") > limit), "jaccard-large")
        if sized.isEmpty():
            whole.append(todo)
            break
        large = F.broadcast(sized) if small(sized, 50_000) else sized
        whole.append(todo.join(large, "region", "left_anti"))
        rest = todo.join(large, "region")
        if level == levels:
            whole.append(_in_blocks(rest.select("region", "member", F.lit(False).alias("core")), limit))
            break
        share = F.lit(float(pivots)) / F.col("size")
        dice = F.abs(F.xxhash64("region", "member", F.lit(level))) / F.lit(float(1 << 63))
        salts = F.ceil(F.col("size") / F.lit(4 * limit)).cast("int")
        drawn = rest.where(dice < share).join(texts, "member")
        chosen = written(drawn.select("region", F.col("member").alias("pivot"), "data", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")), "jaccard-pivots")
        salted = rest.withColumn("salt", F.pmod(F.xxhash64("member", F.lit(level)), salts).cast("int")).join(texts, "member").select("region", "salt", "member", "data")
        found = salted.groupBy("region", "salt").cogroup(chosen.groupBy("region", "salt")).applyInPandas(_assign(width, least), ASSIGNED)
        found = written(found, "jaccard-assigned")
        links.append(found.where("star is not null AND star <> member").select(F.col("member").alias("a"), F.col("star").alias("b")))
        parts = found.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("part")).groupBy("parent").agg(F.sum("part").alias("copies"), F.max("part").alias("largest"))
        parts = parts.join(large.select(F.col("region").alias("parent"), "size"), "parent")
        dense = written(parts.where((F.col("copies") > 2 * F.col("size")) | (F.col("largest") > F.greatest(F.lit(limit), 0.7 * F.col("size")))).select(F.col("parent").alias("region")), "jaccard-dense")
        dense = F.broadcast(dense) if small(dense, 50_000) else dense
        stars = found.where("star is not null").groupBy("parent", "star").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(F.max(F.struct("n", "star")).alias("best"))
        stars = stars.select("parent", F.col("best.star").alias("star"))
        core = found.join(stars, ["parent", "star"], "left_semi").select(F.col("parent").alias("region"), "member", F.lit(True).alias("core"))
        marked = rest.join(dense, "region", "left_semi").join(core, ["region", "member"], "left").select("region", "member", F.coalesce("core", F.lit(False)).alias("core"))
        whole.append(_in_blocks(written(marked, "jaccard-marked"), limit))
        todo = written(found.join(dense.withColumnRenamed("region", "parent"), "parent", "left_anti").select("region", "member"), "jaccard-regions")
    out = whole[0].select("region", "member")
    for more in whole[1:]:
        out = out.unionByName(more.select("region", "member"))
    out = written(out, "jaccard-exact")
    known = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("total")).first()
    total = int((known["total"] or 0) * (out.count() / max(1, known["n"])))
    bundles = max(1, -(-total // bundle), min(64, 2 * spark.sparkContext.defaultParallelism))
    filled = out.join(texts, "member").withColumn("bundle", F.pmod(F.xxhash64("region"), F.lit(bundles)))
    links.append(filled.groupBy("bundle").applyInPandas(_join_regions(width, least), LINKS))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return written(out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "jaccard-links")


def _in_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Regions ``(region, member)`` in which each pair of a region (``region, member, core``) meets unless both are of its core."""
    half = limit / 2
    counts = rows.groupBy("region").agg(F.ceil(F.count_if("core") / half).cast("int").alias("cores"), F.ceil(F.count_if(~F.col("core")) / half).cast("int").alias("others"))
    blocks = F.when(F.col("core"), F.col("cores")).otherwise(F.col("others"))
    placed = rows.join(counts, "region").where("others > 0").withColumn("block", F.pmod(F.xxhash64("member", F.lit("block")), blocks).cast("int"))
    upto = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    across = placed.withColumn("other", upto(F.when(F.col("core"), F.col("others")).otherwise(F.col("cores"))))
    x, y = F.when(F.col("core"), F.col("block")).otherwise(F.col("other")), F.when(F.col("core"), F.col("other")).otherwise(F.col("block"))
    across = across.select(F.xxhash64("region", F.lit("core"), x, y).alias("region"), "member")
    own = placed.where("NOT core").withColumn("other", upto(F.greatest(F.col("others"), F.lit(2)))).where("block <> other")
    return across.unionByName(own.select(F.xxhash64("region", F.lit("rest"), F.least("block", "other"), F.greatest("block", "other")).alias("region"), "member"))


def components(links: DataFrame) -> DataFrame:
    """``member, root`` for each end of ``links`` (``a > b``, distinct): the smallest name that it is connected to.

    A vertex with several smaller neighbours keeps the smallest, and the others are linked to that one instead, until
    each has one; then the chains to the roots are halved until they are gone. Links of a vertex come together only
    as pre-aggregated minima, and lookups are joins that can be split."""
    edges = links.select("a", "b")
    while True:
        least = written(edges.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")), "components-least")
        many = least.where("least < most").select("a", "least")
        if many.isEmpty():
            break
        moved = edges.join(F.broadcast(many) if small(many, 200_000) else many, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = written(least.select("a", F.col("least").alias("b")).unionByName(moved).distinct(), "components-edges")
    up = least.select("a", F.col("least").alias("b"))
    while True:
        above = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
        step = written(up.join(F.broadcast(above) if small(above, 200_000) else above, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "components-up")
        up = step.select("a", "b")
        if step.where("moved").isEmpty():
            break
    roots = up.select(F.col("b").alias("member")).distinct()
    return written(up.select(F.col("a").alias("member"), F.col("b").alias("root")).unionByName(roots.select("member", F.col("member").alias("root"))), "components")


def _often_here(width: int, least: int, at_once: int = 2_000_000):
    """Elements that stand in two prefixes or more of a task's texts, with their counts."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.uint64)
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            e, n = np.unique(np.concatenate(held), return_counts=True) if held else (none, none)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(e[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["cell", "n"])

        for batch in batches:
            for text in _buffers(batch.column("data")):
                held.append(prefix(shingles(text, width), least, none, 1.25).copy())  # a view would hold the whole set
                size += len(held[-1])
            if size > at_once:
                yield out()
                size = 0
        yield out()

    return rows


BUCKETS, COARSE = 256, 64


def bucket_counts(elements: np.ndarray) -> bytes:
    """Elements of a set in each of BUCKETS parts of the universe, up to 255. Two sets differ in as many elements as these counts do, or more."""
    return np.minimum(np.bincount((elements & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _counts(width: int):
    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, width) for text in _buffers(batch.column("data"))]
            yield pa.RecordBatch.from_arrays([batch.column("member"), pa.array([len(e) for e in sets], pa.int64()), pa.array([bucket_counts(e) for e in sets], pa.binary())], names=["member", "n", "counts"])

    return rows


def near_pairs(n: np.ndarray, counts: np.ndarray, least: int, apart_from: np.ndarray) -> np.ndarray:
    """Which sets (sorted by their sizes ``n``) may be linked, by the bound of their counts, to one with another value of ``apart_from``. Sums of
    counts are looked at first, which bound the distance less tightly."""
    coarse = counts.reshape(len(n), COARSE, -1).sum(axis=2, dtype=np.int32)
    fine = counts.astype(np.int16)
    marked = np.zeros(len(n), dtype=bool)
    to = np.searchsorted(100 * n, 100 * 100 * n // least, side="right")  # larger sets can't be linked

    def may(i: int, some: np.ndarray, rows: np.ndarray) -> np.ndarray:
        apart = np.abs(rows[some] - rows[i]).sum(axis=1, dtype=np.int64)
        both = n[some] + n[i]
        return some[100 * (both - apart) >= least * (both + apart)]

    for i in range(len(n)):
        some = np.arange(i + 1, to[i])
        some = some[apart_from[some] != apart_from[i]]
        if len(some) and len(some := may(i, some, coarse)) and len(some := may(i, some, fine)):
            marked[i] = marked[some] = True
    return marked


def _may_be_linked(least: int):
    """Members of the regions of a bundle that, by their counts, may be linked to another member that they aren't connected with."""

    @tidy_groups
    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, region in pdf.groupby("region", sort=False):
            region = region.sort_values(["n", "member"], kind="stable")
            counts = np.frombuffer(b"".join(region["counts"]), dtype=np.uint8).reshape(len(region), BUCKETS)
            marked = near_pairs(region["n"].to_numpy(), counts, least, region["root"].to_numpy())
            out += list(zip([name] * int(marked.sum()), region["member"].to_numpy()[marked], region["hits"].to_numpy()[marked], strict=True))
        return pd.DataFrame(out, columns=["region", "member", "hits"], dtype="int64")

    return near


def _pruned(regions: DataFrame, counts: DataFrame, least: int, name: str, limit: int = 4096, bundle: int = 50_000) -> DataFrame:
    """``regions`` (``region, member, hits, root``) without the members that can't be linked to a member of the same region with another root: counts
    give a lower bound of the distance. Regions of more than ``limit`` sets stay whole if they have several roots."""
    sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    sizes = written(sizes.select("region", (F.col("size") > limit).alias("large")), f"jaccard-sizes-{name}")
    open_ones = written(regions.join(F.broadcast(sizes) if small(sizes, 200_000) else sizes, "region"), f"jaccard-open-{name}")
    bundles = max(1, -(-open_ones.count() // bundle), min(64, 2 * regions.sparkSession.sparkContext.defaultParallelism))
    rows = open_ones.where("NOT large").select("region", "member", "hits", "root").join(counts, "member").withColumn("bundle", F.pmod(F.xxhash64("region"), F.lit(bundles)))
    kept = rows.groupBy("bundle").applyInPandas(_may_be_linked(least), "region long, member long, hits long")
    kept = written(kept.unionByName(open_ones.where("large").select("region", "member", "hits")), f"jaccard-pruned-{name}")
    dropped(sizes, open_ones)
    return kept


def _star(width: int, least: int):
    """Links of the members of a cell (``member, data``) to its pivot (``p_data``)."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, p_set = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b = [], []
            for region, member, data, p_data in zip(batch.column("region").to_pylist(), batch.column("member").to_pylist(), _buffers(batch.column("data")), _buffers(batch.column("p_data")), strict=True):
                if region != pivot:
                    pivot, p_set = region, shingles(p_data, width)
                e = shingles(data, width)
                shared = len(np.intersect1d(e, p_set, assume_unique=True))
                if shared and 100 * shared >= least * (len(e) + len(p_set) - shared):
                    a.append(max(region, member))
                    b.append(min(region, member))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows


def star_links(regions: DataFrame, texts: DataFrame, width: int, least: int) -> DataFrame:
    """Each member of ``regions`` (``region, member, hits``) goes to one Voronoi cell, that of the pivot with which it shares the most cells (of equals the
    smallest); links between it and that pivot. A region is named by its pivot. A text travels once."""
    best = regions.where("region <> member").groupBy("member").agg(F.max(F.struct("hits", (-F.col("region")).alias("r"))).alias("best"))
    pairs = written(best.select((-F.col("best.r")).alias("region"), "member"), "jaccard-voronoi")
    named = written(semi(texts, pairs.select(F.col("region").alias("member")).distinct(), ["member"]).select(F.col("member").alias("region"), F.col("data").alias("p_data")), "jaccard-pivots")
    rows = pairs.join(texts, "member").join(F.broadcast(named) if fits(named, "p_data") else named, "region")
    return written(rows.select("region", "member", "data", "p_data").mapInArrow(_star(width, least), LINKS), "jaccard-stars")


def fits(df: DataFrame, column: str, most: int = 32 << 20) -> bool:
    """Whether ``column`` (binary) of ``df`` has at most ``most`` bytes in all."""
    return (df.agg(F.sum(F.length(column) + 64)).first()[0] or 0) <= most


def _with_prefixes(base: DataFrame, width: int, least: int, often: int, most: int = 500_000) -> DataFrame:
    """Sets whose cells are prefixes. Elements that stand in more than ``often`` prefixes, as far as tasks meet them twice, and the ``most`` frequent of them,
    come last in the order: which ones these are changes how much is compared, and nothing else."""
    spark = base.sparkSession
    counted = base.mapInArrow(_often_here(width, least), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > often)
    found = counted.orderBy(F.desc("n"), "cell").limit(most).select("cell").toPandas()["cell"].to_numpy(dtype=np.int64)
    frequent = spark.sparkContext.broadcast(np.sort(found.view(np.uint64)))  # at most 8 bytes for each of ``most``
    return written(base.mapInArrow(_sets(width, least, frequent), SETS), "jaccard-sets")


def jaccard_join(docs: DataFrame, width: int = 3, least: int = 90, limit: int = 512, pivots: int = 24, blocks_from: int = 88, often: int = 16, row: str | None = None) -> DataFrame:
    """Components of ``docs`` (``doc_id, text``) under links between texts whose sets of ``width``-word shingles have a
    Jaccard similarity of ``least`` % or more. Exact: every link counts, and each was measured on whole sets.

    1. Equal sets form classes; only classes are compared. 2. The smallest class of each cell is its
    pivot, and a pivot's region holds all classes that share a cell with it; linked classes share a cell, so they
    share a region. Cells are blocks of a set's elements from ``blocks_from`` % on (see ``Cells``); below, where so many blocks would be needed that
    they'd be too small, they are the elements of its prefix. This replaces a global choice of pivots: nearly all texts are at distance 1 from nearly all
    others, where the triangle inequality (windows of twice the radius) would send every text to every region. Counts of elements in parts of
    the universe, a map that makes no distance larger, take out of each region what is too far from all its members.
    3. Each class goes to the Voronoi cell of one pivot, that with which it shares most cells, and is compared with it (``star_links``). What these
    links connect needn't meet again: only members that may be linked to one of their region that they are not yet connected with stay. Of these, regions
    with many are divided by further pivots into Voronoi regions, with texts near the borders in
    all regions that the triangle inequality allows, recursively; then each region is joined exactly.
    4. Links are joined to components by rounds of joins.

    Words are runs of bytes without ASCII white space, A-Z in lower case. A text with fewer words is one shingle; one
    without words, and null, has none and is linked with nothing. Rows with equal doc_id are rows of their own;
    a null doc_id can connect others but names no component (component_id is null if it is alone). An empty table gives
    an empty result; other columns are not read. Shingles, sets and cells are told apart by 64 bits of hash.
    Returns ``doc_id, n_shingles, component_id``.

    With ``row``, the name of a long column of ``docs`` that tells its rows apart in every job, that column and ``kept`` are returned too: of each
    component exactly one row is kept, of those with the smallest doc_id, and where all are null of all, the one with the smallest ``row``.
    """
    short_batches(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data")]
    base = docs.select(F.col(row).alias("rid"), *columns) if row else numbered(docs, "jaccard-base", *columns)
    sets = written(base.mapInArrow(_sets(width, least), SETS), "jaccard-sets") if least >= blocks_from else _with_prefixes(base, width, least, often)
    in_cells = sets.select("class", F.explode("cells").alias("cell"))
    met = written(in_cells.groupBy("cell").agg(F.min("class").alias("region"), F.max("class").alias("last")).where("region < last").select("cell", "region"), "jaccard-cells")
    # copies multiply all hits of a class alike
    regions = written(likely(in_cells, met, "cell").join(met, "cell").groupBy("region", F.col("class").alias("member")).agg(F.count(F.lit(1)).alias("hits")), "jaccard-regions")
    sets, cells_too = written(sets.drop("cells"), "jaccard-classes-of-rows"), sets
    dropped(cells_too, met)

    def texts_of(members: DataFrame) -> DataFrame:
        """A text of each member's class, as ``(member, data)``."""
        named = members.select(F.col("member").alias("class")).distinct()
        sources = written(semi(sets.select("class", "rid"), named, ["class"]).groupBy("class").agg(F.min("rid").alias("rid")), "jaccard-sources")
        return base.select("rid", "data").join(F.broadcast(sources) if small(sources, 200_000) else sources, "rid").select(F.col("class").alias("member"), "data")

    counts = written(texts_of(regions).mapInArrow(_counts(width), "member long, n long, counts binary"), "jaccard-counts")
    regions = _pruned(regions.withColumn("root", F.col("member")), counts, least, "all")
    texts = written(texts_of(regions), "jaccard-texts")
    if not row:
        dropped(base)
    stars = star_links(regions, texts, width, least)
    roots = components(stars.distinct())
    rooted = regions.join(F.broadcast(roots) if small(roots, 200_000) else roots, "member", "left").select("region", "member", "hits", F.coalesce("root", "member").alias("root"))
    rest = _pruned(rooted, counts, least, "rest")
    others = region_links(rest.select("region", "member"), texts, width, least, limit, pivots)
    found = components(stars.unionByName(others).distinct())
    # a null doc_id comes last
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("first")] if row else []
    named = ["first"] if row else []
    classes = written(sets.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), *first), "jaccard-classes")
    of_class = found.select(F.col("member").alias("class"), "root").join(classes.select("class", "first_id", *named), "class")
    least_id = of_class.groupBy("root").agg(F.min("first_id").alias("component_id"), *[F.min(c).alias(c) for c in named])
    by_link = of_class.select("class", "root").join(least_id, "root").select("class", "component_id", *named)
    copied = classes.where("rows > 1").join(found.select(F.col("member").alias("class")), "class", "left_anti").select("class", F.col("first_id").alias("component_id"), *named)
    groups = written(by_link.unionByName(copied), "jaccard-groups")
    slim = sets.select("rid", "doc_id", F.col("n").alias("n_shingles"), "class")
    with_words = slim.where("n_shingles > 0").join(F.broadcast(groups) if small(groups, 200_000) else groups, "class", "left")
    columns = [F.col("rid").alias(row), "doc_id", "n_shingles"] if row else ["doc_id", "n_shingles"]
    kept = [F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("kept")] if row else []
    alone = [F.lit(True).alias("kept")] if row else []
    of_words = with_words.select(*columns, F.coalesce("component_id", "doc_id").alias("component_id"), *kept)
    return of_words.unionByName(slim.where("n_shingles = 0").select(*columns, F.col("doc_id").alias("component_id"), *alone))
