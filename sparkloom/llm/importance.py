"""Importance resampling of a corpus towards a target distribution, by hashed word n-grams."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_worker, text_or_empty, tidy, written

#: Runs of one to three words.
ORDERS = 3
#: Words that are worked on at once; a longer text is cut in pieces that overlap by two words.
AT_ONCE = 1 << 20
#: So many words are numbered by how frequent they are.
FREQUENT = 1024
#: Different words of a group at most, so that three of their numbers fit 63 bits.
MOST_WORDS = 2_000_000

#: Letters in lower case and digits stay, what is no part of a word becomes a space; bytes of longer code points stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes, A-Z in lower case."""
    return data.translate(_WORDS).split()


class Group:
    """Texts that are worked on together. ``ids`` are the numbers of their words, one text after another; a feature may start at each of the first
    ``owns`` words of a piece."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.pieces: list[tuple[int, np.ndarray, int]] = []
        self.size = 0

    def add(self, doc: int, words: list[bytes], owns: int) -> None:
        self.pieces.append((doc, np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), owns))
        self.size += len(words)

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each order, where its features start in ``ids`` and the piece of each."""
        size = np.array([len(x) for _, x, _ in self.pieces])
        begin = np.cumsum(size) - size
        owns = np.array([n for _, _, n in self.pieces])
        for order in range(1, ORDERS + 1):
            count = np.maximum(0, np.minimum(owns, size - order + 1))
            piece = np.repeat(np.arange(len(size)), count)
            yield order, np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + begin[piece], piece

    @property
    def ids(self) -> np.ndarray:
        return np.concatenate([x for _, x, _ in self.pieces])


def groups(texts: Iterable[bytes | memoryview], at_once: int = AT_ONCE) -> Iterator[Group]:
    """Texts in groups of about ``at_once`` words."""
    group = Group()
    for doc, text in enumerate(texts):
        words = words_of(bytes(text))
        for at in range(0, len(words), at_once):
            piece = words[at : at + at_once + ORDERS - 1]
            if group.size and (group.size + len(piece) > at_once or len(group.number) + len(piece) > MOST_WORDS):
                yield group
                group = Group()
            group.add(doc, piece, min(at_once, len(words) - at))
    if group.size:
        yield group


# The dictionary of distinct features


def _planes(x: np.ndarray) -> bytes:
    """Numbers as bytes, all lowest ones first: high bytes are mostly alike."""
    wide = 1 if x.max(initial=0) < 1 << 8 else 2 if x.max(initial=0) < 1 << 16 else 4
    return bytes([wide]) + np.ascontiguousarray(x.astype(f"<u{wide}").view(np.uint8).reshape(len(x), wide).T).tobytes()


def _number(body: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    wide = body[at]
    planes = np.frombuffer(body, dtype=np.uint8, count=wide * n, offset=at + 1).reshape(wide, n)
    return np.ascontiguousarray(planes.T).view(f"<u{wide}").ravel().astype(np.int64), at + 1 + wide * n


def _packed(group: Group, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Distinct features of a group and how often each is there, by part: ``(part, size, zstd bytes)``.

    What is written are runs of three words, in order: how many of two begin with each word, the second word and the number of runs of each of these, the third
    word and the count of each run. A run of two at the end of a text has no third word (number 0), so that runs of two are sums over those of three. The most
    frequent words have the smallest numbers, the others are numbered as they are sorted, and all are spelt once a part. A part has all runs with the same two first words; single words are dealt by themselves."""
    spelt, ids = list(group.number), group.ids
    often = np.bincount(ids, minlength=len(spelt))
    order = np.argsort(-often, kind="stable")
    order = np.concatenate((order[:FREQUENT], np.array(sorted(order[FREQUENT:].tolist(), key=spelt.__getitem__), dtype=np.int64)))
    number = np.empty(len(spelt), dtype=np.int64)
    number[order] = np.arange(1, len(spelt) + 1)
    words, often = [spelt[i] for i in order.tolist()], often[order]
    hashed = np.array([0, *map(zlib.crc32, words)], dtype=np.uint64)
    n = len(words) + 1
    (_, alone, _), (_, start, _), (_, third, _) = group.runs()
    often = np.bincount(number[ids[alone]], minlength=n)[1:]  # without the words that a piece only looks ahead to
    ids = number[ids]
    key = (ids[start] * n + ids[start + 1]) * n
    has = np.zeros(len(ids) + 1, dtype=bool)
    has[third] = True
    key += np.where(has[start], ids[np.minimum(start + 2, len(ids) - 1)], 0)
    key, count = np.unique(key, return_counts=True)
    two, w3 = np.divmod(key, n)
    first = np.flatnonzero(np.concatenate(([True], two[1:] != two[:-1]))) if len(two) else np.zeros(0, dtype=np.int64)
    runs = np.diff(np.append(first, len(two)))
    w1, w2 = np.divmod(two[first], n)
    dealt = [_part(hashed[1:], hashed[1:], parts), _part(hashed[w1], hashed[w2], parts)]
    dealt.append(np.repeat(dealt[1], runs))
    sorted_by = [np.argsort(x, kind="stable") for x in dealt]
    ends = [np.searchsorted(x[by], np.arange(parts + 1)) for x, by in zip(dealt, sorted_by, strict=True)]
    for p in range(parts):
        one, two, three = (by[end[p] : end[p + 1]] for by, end in zip(sorted_by, ends, strict=True))
        one = one[often[one] > 0]
        if not len(one) and not len(two):
            continue
        there = np.zeros(n, dtype=bool)
        there[one + 1] = there[w1[two]] = there[w2[two]] = there[w3[three]] = True
        there[0] = True
        own = np.cumsum(there) - 1  # numbers in this part; 0 is no word
        used = np.flatnonzero(there)[1:] - 1
        text = b" ".join([words[u] for u in used.tolist()])
        alone = np.zeros(len(used), dtype=np.int64)
        alone[own[one + 1] - 1] = often[one]
        head = np.array([len(text), len(used), len(two), len(three)], dtype=np.int64)
        body = b"".join([head.tobytes(), text, *map(_planes, (alone, np.bincount(own[w1[two]], minlength=len(used) + 1), own[w2[two]], runs[two], own[w3[three]], count[three]))])
        yield p, len(body), _CODEC.compress(body, asbytes=True)


_CODEC = pa.Codec("zstd", compression_level=6)


def _part(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # 16 bits are sorted by digits


class Part:
    """Distinct features of a part of the dictionary: ``words`` and, for each order, their numbers in columns and how often each feature is there."""

    def __init__(self, sizes: list[int], packed: list[bytes]) -> None:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ones, keys, counts = [], [], []
        read = []
        for size, data in zip(sizes, packed, strict=True):
            body = _CODEC.decompress(data, decompressed_size=size, asbytes=True)
            n_text, n_words, n_two, n_three = np.frombuffer(body, dtype=np.int64, count=4).tolist()
            spelt = body[32 : 32 + n_text].split(b" ") if n_words else []
            own = np.fromiter(map(number.__getitem__, spelt), np.int64, n_words)
            at, columns = 32 + n_text, []
            for n in (n_words, n_words + 1, n_two, n_two, n_three, n_three):
                column, at = _number(body, at, n)
                columns.append(column)
            read.append((np.concatenate(([-1], own)), columns))
        self.words = list(number)
        n = len(self.words) + 1
        for own, (alone, fan, w2, runs, w3, count) in read:
            ones.append(np.stack((own[1:], alone)))
            keys.append((np.repeat(np.repeat(own, fan) * n + own[w2], runs), own[w3] + 1))
            counts.append(count)
        read.clear()
        none = np.zeros(0, dtype=np.int64)
        one = np.concatenate(ones, axis=1) if ones else np.stack((none, none))
        alone = np.bincount(one[0], weights=one[1], minlength=n - 1).astype(np.int64)
        pair, last = (np.concatenate([k[i] for k in keys] or [none]) for i in (0, 1))
        keys.clear()
        pairs = None
        if n > MOST_WORDS:  # three numbers don't fit 63 bits: pairs are numbered
            pairs, pair = np.unique(pair, return_inverse=True)
        pair *= n
        pair += last
        key, count = _summed(pair, np.concatenate(counts or [none]))
        two, count2 = _summed(key // n, count)
        whole = key % n > 0
        three, count3 = key[whole], count[whole]
        before = three // n
        two, before = (two, before) if pairs is None else (pairs[two], pairs[before])
        seen = np.flatnonzero(alone)
        self.columns = [[seen], list(np.divmod(two, n)), [*np.divmod(before, n), three % n - 1]]
        self.counts = [alone[seen], count2, count3]


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _dictionary(texts: DataFrame, part_bytes: int, at_once: int, merge, schema: str) -> DataFrame:
    """``merge`` of each part of the dictionary.

    A task counts the features of about a million words before they are shuffled, so a frequent one is a row for each such group and not for each place. They
    travel packed, in parts of about ``part_bytes`` of text; a part is merged in one task and its size doesn't grow with the table, the number of parts does."""
    data = texts.select(text_or_empty().cast("binary").alias("data"))
    parts = max(1, -(-int(data.agg(F.sum(F.length("data"))).first()[0] or 0) // part_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups((x.as_buffer() for b in batches for x in b.column(0)), at_once):
            rows = list(zip(*_packed(group, parts), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["part", "size", "packed"])

    def merged(table: pa.Table) -> pa.Table:
        out = merge(Part(table["size"].to_pylist(), table["packed"].to_pylist()))
        free_worker()
        return out

    packed = data.mapInArrow(tidy(pack), "part int, size long, packed binary")
    return packed.groupBy("part").applyInArrow(merged, schema)


def feature_dictionary(texts: DataFrame, part_bytes: int = 16 << 20, at_once: int = 2 * AT_ONCE) -> DataFrame:
    """Each distinct feature of ``texts`` (``text``) once, with the number of its places in all of them: ``feature, n``."""

    def spelt(part: Part) -> pa.Table:
        words = pa.array(part.words, pa.binary())
        found = [[words.take(pa.array(c)) for c in columns] for columns in part.columns]
        joined = [c[0] if len(c) == 1 else pc.binary_join_element_wise(*c, b" ") for c in found]
        return pa.table({"feature": pa.chunked_array(joined, pa.binary()).cast(pa.string()), "n": np.concatenate(part.counts)})

    return _dictionary(texts, part_bytes, at_once, spelt, "feature string, n long")


def bucket_counts(texts: DataFrame, buckets: int, part_bytes: int = 16 << 20, at_once: int = 2 * AT_ONCE) -> DataFrame:
    """``bucket, n``: how many places features of each bucket have. Each distinct feature of the dictionary is hashed once; a part's are summed by bucket."""

    def hashed(part: Part) -> pa.Table:
        bytes_of = Hashes(part.words)
        n = np.zeros(buckets, dtype=np.int64)
        for columns, count in zip(part.columns, part.counts, strict=True):
            np.add.at(n, bytes_of.of(columns) % np.uint32(buckets), count)
        there = np.flatnonzero(n)
        return pa.table({"bucket": there, "n": n[there]})

    return _dictionary(texts, part_bytes, at_once, hashed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain``, a row for each bucket: a thousand times the logarithm of how much likelier a place of ``target`` falls in it than one of ``docs``,
    both smoothed by one, as whole numbers (downwards)."""
    spark = docs.sparkSession
    s = written(bucket_counts(docs, buckets), "importance-source")
    t = written(bucket_counts(target, buckets), "importance-target")
    total = [int(x.agg(F.sum("n")).first()[0] or 0) for x in (s, t)]
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(s.select("bucket", F.col("n").alias("s")), "bucket", "left").join(t.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0, ["s", "t"])
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(total[0] + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(total[1] + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


# Weights of documents


@lru_cache(maxsize=1)
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """What appending zero bytes does to a CRC-32, for each of its four bytes: by 0 to 64 bytes, and by powers of two."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    step = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], dtype=np.uint32)[:, None]).astype(np.uint32)
    few = [step]
    for _ in range(64):
        step = table[step & 255] ^ (step >> 8)
        few.append(step)
    powers = [few[1]]
    for _ in range(40):
        powers.append(_through(powers[-1], powers[-1]))
    return np.stack(few).ravel(), np.stack(powers)


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRC-32 of strings to which strings of ``by`` bytes are to be joined: exclusive-or with theirs gives that of the joined ones."""
    few, powers = _shifts()
    at = np.minimum(by, 64) * 1024
    out = few[at + (crc & 255)] ^ few[at + 256 + ((crc >> 8) & 255)] ^ few[at + 512 + ((crc >> 16) & 255)] ^ few[at + 768 + (crc >> 24)]
    if len(by) and by.max() > 64:
        for i in np.flatnonzero(by > 64).tolist():
            rest, one = int(by[i]), crc[i : i + 1]
            for k in range(rest.bit_length()):
                one = _through(powers[k], one) if rest >> k & 1 else one
            out[i] = one[0]
    return out


class Hashes:
    """CRC-32 of runs of words from those of the words, each of which is hashed once."""

    def __init__(self, words: list[bytes]) -> None:
        self.plain = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.spaced = np.array([zlib.crc32(b" ", c) for c in self.plain.tolist()], dtype=np.uint32)
        self.length = np.array([len(w) for w in words], dtype=np.int64)

    def of(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of the words numbered in ``columns``, joined by a space."""
        *before, last = columns
        if not before:
            return self.plain[last]
        crc = self.spaced[before[0]]
        for w in before[1:]:
            crc = shifted(crc, self.length[w] + 1) ^ self.spaced[w]
        return shifted(crc, self.length[last]) ^ self.plain[last]


def weights(group: Group, gains: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, summed gains of the features of each piece of a group."""
    hashes, ids = Hashes(list(group.number)), group.ids
    for order, start, piece in group.runs():
        crc = hashes.of([ids[start + k] for k in range(order)])
        yield np.bincount(piece, weights=gains[crc % np.uint32(len(gains))].astype(np.float64), minlength=len(group.pieces)).astype(np.int64)


def _weighed(gains, at_once: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows, dtype=np.int64)
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            for group in groups((x.as_buffer() for x in batch.column("data")), at_once):
                doc = np.array([d for d, _, _ in group.pieces])
                for part in weights(group, gains.value):
                    np.add.at(total, doc, part)
                np.add.at(n_words, doc, np.array([n for _, _, n in group.pieces]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(total)], names=["doc_id", "n_words", "weight"])

    return weigh


def gumbel(doc_id: Column, seed: int) -> Column:
    """Seeded noise of a document: a thousandth is its unit."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(first, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``, from 1, in ``order``: sorted in ranges and numbered within each, on from the number of rows in the ranges before."""
    at = written(rows.orderBy(*order).select("*", F.monotonically_increasing_id().alias("_at")), "importance-order")
    of = at.select("*", F.shiftright("_at", 33).alias("_range"))
    sizes = of.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = sizes.select("_range", F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return of.join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_range", "_before")


def importance_resampling(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42, at_once: int = AT_ONCE) -> DataFrame:
    """Documents of ``docs`` (``doc_id, text``) drawn without replacement so that they look like the texts of ``target`` (``text``).

    Features are all runs of one to three words (A-Z in lower case). Each distinct feature of all documents, and of all target texts, is counted in a
    dictionary and hashed there once into its bucket (``feature_dictionary``); a bucket's gain is joined back to the features of each document by
    bucket. ``weight`` sums gains over a document's features, repeats counted; ``score`` adds seeded noise, and of the documents with at least
    ``least_words`` words the ``percent`` percent (downwards) with the highest scores have a ``rank``, from 1, ties to the smaller doc_id.

    A document without words has no features and weight 0. Null text counts as empty, null doc_id as an empty one in the noise, and comes last of equal scores.
    Repeated rows are counted and drawn each. A text of any length is worked on in pieces. An empty table gives an empty result, an empty target gains of
    the documents alone; further columns are not read. Returns ``doc_id, n_features, weight, score, rank``.
    """
    spark = docs.sparkSession
    rows = bucket_gains(docs, target, buckets).orderBy("bucket").collect()  # ``buckets`` numbers
    gains = spark.sparkContext.broadcast(np.array([r.gain for r in rows], dtype=np.int64))
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    weighed = data.mapInArrow(tidy(_weighed(gains, at_once)), "doc_id long, n_words long, weight long")
    n = F.col("n_words")
    features = sum((F.greatest(n - k, F.lit(0)) for k in range(1, ORDERS)), n)
    scored = written(weighed.select("doc_id", "n_words", features.alias("n_features"), "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score")), "importance-scored")
    enough = scored.where(n >= least_words)
    drawn = percent * enough.count() // 100
    placed = ranked(enough, [F.desc("score"), F.asc_nulls_last("doc_id")])
    columns = ["doc_id", "n_features", "weight", "score"]
    first = placed.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return first.unionByName(scored.where(n < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
