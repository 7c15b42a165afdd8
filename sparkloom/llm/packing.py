"""Best-fit packing of token sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_CACHES, give_back, short_batches, text_or_empty, written

#: Parts of words whose ids a Python worker remembers in each of two generations.
REMEMBERED = 200_000
#: The split that the tokenizer file names; it never crosses white space. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands between the ids of two words. No id is as large, so the ids of a word never hold it.
LINE = b"\xff" * 4
#: Below this code point there is no combining mark, and lower case is the same everywhere.
PLAIN = 0x130


def _byte_letters() -> dict[int, str]:
    """Plain characters in byte-level spelling: printable bytes stand for themselves, the others for
    the characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
    letter = {b: rest.get(b, chr(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(PLAIN)}


class Recent:
    """Bytes by key, in two generations: when the younger has ``most`` keys it becomes the older, whose
    keys are forgotten unless they were met meanwhile. So what is frequent stays."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def missing(self, met: set) -> list:
        """Those of ``met`` that aren't known; the others are in ``young`` from then on."""
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        new = met.difference(self.young)
        again = self.old.keys() & new
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        return list(new - again)


class WordIds:
    """Ids of whole texts from the ids of their words, for tokenizers that split at white space: no id
    depends on what stands beyond it. Words of plain characters are lower-cased and split together and
    their parts given to the tokenizer's model; all other words go through the whole tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.split = regex.compile(rf"{SPLIT}|\n")
        self.spelt = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.known = Recent(REMEMBERED)

    def odd(self, w: str) -> bool:
        return "<|" in w or not w.isascii() and ord(max(w)) >= PLAIN

    def part(self, p: str) -> bytes:
        """Ids of a part of a plain word, or of an odd word."""
        if self.odd(p):
            return b"".join([self.spelt[i] for i in self.tokenizer.encode(p, add_special_tokens=False).ids])
        letters = p if p.isascii() and p.isprintable() else p.translate(self.letters)
        return b"".join([self.spelt[t.id] for t in self.tokenize(letters)])

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit numbers. There is no ASCII white space in ``words``."""
        lines, odd = "\n".join(words), set()
        if "<|" in lines or not lines.isascii():
            odd = {w for w in words if self.odd(w)}
            lines = "\n".join([w for w in words if w not in odd]) if odd else lines
        parts = self.split.findall(lines.lower())
        for p in self.known.missing({*parts, *odd, "\n"}):
            self.known.young[p] = LINE if p == "\n" else self.part(p)
        of = self.known.young
        ids = b"".join(map(of.__getitem__, parts)).split(LINE)
        if not odd:
            return ids
        plain = iter(ids)
        return [of[w] if w in odd else next(plain) for w in words]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after the other, and where those of each begin, with their end. Each
        distinct word is looked at once."""
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        if not len(each):
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts) + 1, dtype=np.int64)
        known = self.words(each.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        of = each.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(lengths[of])))
        place = np.repeat((np.cumsum(lengths) - lengths)[of] - ends[:-1], lengths[of])
        place += np.arange(len(place))
        return np.frombuffer(b"".join(known), dtype="<u4")[place], ends[words.offsets.to_numpy()]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


WORKER_CACHES.append(word_ids.cache_clear)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, size: int, end: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        ids_of = word_ids(path)
        last = end.to_bytes(4, "little")
        for batch in batches:
            rows = []
            found, begin = ids_of(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), begin[:-1], begin[1:], strict=True):
                ids = found[a:b].tobytes() + last
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0) -> DataFrame:
    """Each document's ids followed by ``end``, cut into pieces of ``size`` (the last may be shorter)."""
    short_batches(docs.sparkSession, 2048)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_pieces(tokenizer, size, end), PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the bin that it leaves fullest. Bins of indexes."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set if a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = rooms >> n
        if at:
            room = n + (at & -at).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int, tries: int = 200, failures: int = 24) -> list[list[int]]:
    """Empty underfull bins, the least full first. A step moves a document to another underfull bin,
    exchanges it for a shorter one, or exchanges two for one that is shorter than both together; each
    takes from the bin that is being emptied and fills another, so the sum of squared fills grows
    (checked), and no step is undone. A bin that cannot be emptied stays as it then is. The search ends when no bin can be saved any more (the tokens of all
    bins fill as many), after ``tries`` bins, or when ``failures`` in a row couldn't be emptied; two go for one of a bin's twelve longest only."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    total, alive = sum(fill), sum(1 for b in bins if b)
    holds: dict[int, set[int]] = defaultdict(set)  # length -> items in underfull bins
    home: dict[int, int] = {}
    under = {b for b in range(len(bins)) if bins[b] and fill[b] < size}
    for b in under:
        for i in bins[b]:
            home[i] = b
            holds[lengths[i]].add(i)
    room_of: dict[int, set[int]] = defaultdict(set)  # room -> underfull bins
    for b in under:
        room_of[size - fill[b]].add(b)
    most_room = max(room_of, default=0)

    def change(b: int, out: list[int], add: list[int]) -> None:
        room_of[size - fill[b]].discard(b)
        for i in out:
            bins[b].remove(i)
        bins[b].extend(add)
        fill[b] += sum(lengths[i] for i in add) - sum(lengths[i] for i in out)
        for i in add:
            home[i] = b
        room_of[size - fill[b]].add(b)

    def better(b: int, t: int, gain: int) -> bool:
        return 0 < gain <= size - fill[t] and (fill[b] - gain) ** 2 + (fill[t] + gain) ** 2 > fill[b] ** 2 + fill[t] ** 2

    def step(b: int) -> bool:
        items = sorted(bins[b], key=lambda i: -lengths[i])
        for x in items:  # move, into the smallest room that takes it
            for room in range(lengths[x], most_room + 1):
                t = next((t for t in room_of.get(room, ()) if t != b and better(b, t, lengths[x])), None)
                if t is not None:
                    change(b, [x], [])
                    change(t, [], [x])
                    return True
        pairs = [(x,) for x in items] + [(items[i], items[j]) for i in range(min(12, len(items))) for j in range(i)]
        for out in pairs:  # one or two for one
            n = sum(lengths[i] for i in out)
            if n > size:
                continue
            for m in range(max(1, n - most_room), n):
                y = next((y for y in holds.get(m, ()) if home[y] != b and better(b, home[y], n - m)), None)
                if y is not None:
                    t = home[y]
                    change(b, list(out), [y])
                    change(t, [y], list(out))
                    return True
        return False

    failed = tried = 0
    for b in sorted(under, key=lambda b: (fill[b], b)):
        if alive * size - total < size or failed >= failures or tried >= tries:
            break
        tried += 1
        while bins[b] and step(b):
            pass
        if bins[b]:
            failed += 1
        else:
            alive -= 1
            failed = 0
            room_of[size].discard(b)
    return [b for b in bins if b]


def _pack_group(size: int, group_bits: int, round_no: int, open_bins: int):
    """Packs one group of pieces. The ``open_bins`` least full bins are left open for the next round."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = local_search(best_fit(lengths, size), lengths, size)
        bins.sort(key=lambda b: (sum(lengths[i] for i in b), b))
        group = int(pdf["group"].iloc[0])
        seq, offset, left = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], offset[i] = (round_no << 56) | (group << group_bits) | k, at
                left[i] = k < open_bins and sum(lengths[j] for j in b) < size
                at += lengths[i]
        return pdf.drop(columns="group").assign(sequence_id=seq, offset=offset, left=left)

    return pack


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, group_pieces: int = 16_384, open_bins: int = 48) -> DataFrame:
    """Pack ``docs`` (``doc_id, text``) into as few sequences of at most ``size`` tokens as it can.

    Pieces are dealt evenly into groups of about ``group_pieces``, and each group is packed by best fit
    decreasing and local search. A group's ``open_bins`` least full sequences are opened again and
    packed together with those of other groups, in fewer groups each round, until one group is left:
    so what dealing costs is less than one sequence in all but the last rounds, and no task ever holds
    more than a group. The search in a group is bounded (``local_search``): 200 bins are tried, and it ends after 24 failures in a row.

    Null and empty text give one piece, ``end`` alone. A table without rows gives no row. Rows with
    equal or null doc_id are documents of their own; further columns are not read.
    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    schema = f"{PIECES}, sequence_id long, offset long, left boolean"
    pieces = written(token_pieces(docs, tokenizer, size, end), "pack-pieces")
    done: list[DataFrame] = []
    n, round_no = pieces.count(), 0
    groups = max(1, -(-n // group_pieces))
    while n:
        last = groups == 1
        keyed = pieces.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
        packed = keyed.groupBy("group").applyInPandas(_pack_group(size, 28, round_no, 0 if last else open_bins), schema)
        packed = written(packed, f"pack-{round_no}")
        done.append(packed.where("NOT left").drop("left"))
        if last:
            break
        pieces = packed.where("left").drop("left", "sequence_id", "offset")
        n, round_no = pieces.count(), round_no + 1
        groups = min(groups // 2, max(1, -(-n // group_pieces)))
    if not done:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
