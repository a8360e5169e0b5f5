"""Phrases whose words stand together more often than apart, counted through a minimal perfect hash.

Tables of hashed cells, counted over all texts, say which pairs and triples of
words can't be frequent: a phrase is a candidate only if all its pairs and triples
may be. The candidates get a minimal perfect hash, in blocks of keys, which has
each key in its slot; each task counts the phrases that it reads in one array of
slots, looks only at those whose stored key is theirs, and the arrays are added
up. The counts of a phrase's parts are read by slot, too.

A phrase's key is 128 bits of a hash over language and words; everything else is
exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeframe.llm.common import Scratch, checkpoint, table
from gradeframe.llm.shingles import mix

LEAST, LONGEST, SCALE, TOP = 100, 5, 1000, 2000
#: Levels of phrases that cells rule out (pairs and triples).
RULED = (2, 3)
#: Cells of a table by bytes of text, and their bounds as powers of two; cells that are added up together.
BYTES_A_CELL, CELLS, PIECE = 128, (16, 26), 1 << 14
#: Keys of a block, about, and of the blocks that are broadcast together: 17 bytes a key. More keys take more readings of the texts.
BLOCK_KEYS, ROUND_KEYS = 1 << 17, 1 << 21
#: Pieces in which candidates go through the shuffle, as powers of two: about one for 16 MB of text.
PIECES = (3, 12)
#: Bytes of text, about, whose words are handled at a time, and words and candidates that a task remembers.
PART, WORDS, SEEN = 1 << 22, 1 << 19, 1 << 21
#: Phrases of a language that one task ranks.
RANKED = 1 << 20

ODD = (np.uint64(0x9E3779B97F4A7C17), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=1)
def small_letters() -> bytes:
    """Each byte as it counts: A-Z as a-z, and all that ends a piece as a full stop."""
    out = bytearray(range(256))
    out[65:91] = range(97, 123)
    for c in b".,;:!?\n\x0b\x0c\r":
        out[c] = ord(".")
    return bytes(out)


def pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a text of about PART bytes, cut between pieces; a longer piece is a part of its own."""
    text = text.translate(small_letters())
    while len(text) > PART:
        cut = text.rfind(b".", 0, PART)
        cut = cut if cut >= 0 else text.find(b".")
        if cut < 0:
            break
        yield text[:cut]
        text = text[cut + 1 :]
    yield text


class Lanes(dict):
    """Numbers for words, with two 64-bit hashes of each."""

    def __init__(self) -> None:
        self.hashes: list[bytes] = []
        self.known = np.zeros((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(hashlib.blake2b(word, digest_size=16).digest())
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        """words x 2"""
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self.known) < len(self.hashes):
            self.known = np.concatenate([self.known, np.frombuffer(b"".join(self.hashes[len(self.known) :]), np.uint64).reshape(-1, 2)])
        out = self.known[at]
        if len(self.hashes) > WORDS:
            self.__init__()
            self.clear()
        return out


@dataclass
class Part:
    """Words of some texts in a row. A full stop stands between pieces."""

    words: list[bytes]
    lanes: np.ndarray
    language: np.ndarray  # of each word, by its place in languages
    languages: list[str]
    seeds: np.ndarray  # languages x 2

    def __post_init__(self) -> None:
        self.is_word = (self.lanes != np.frombuffer(hashlib.blake2b(b".", digest_size=16).digest(), np.uint64)).any(axis=1)

    def keys(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the k words from each place on."""
        seeds, out = self.seeds[self.language[at]], []
        for lane, odd in enumerate(ODD):
            h = seeds[:, lane] + np.uint64(k)
            for j in range(k):
                h = h * odd + self.lanes[at + j, lane]
            out.append(mix(h))
        return out[0], out[1]

    def text(self, at: int, k: int) -> bytes:
        return b" ".join(self.words[at : at + k])


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """The words of texts (lang, text), some texts at a time."""
    lanes, own = Lanes(), Lanes()
    words: list[bytes] = []
    sizes: list[tuple[str, int]] = []
    held = 0

    def part() -> Part:
        names = list(dict.fromkeys(name for name, _ in sizes))
        place = {name: i for i, name in enumerate(names)}
        language = np.repeat(np.array([place[name] for name, _ in sizes], np.int64), [n for _, n in sizes])
        return Part(words, lanes.of(words), language, names, own.of([name.encode() for name in names]))

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for piece in pieces(text.as_py() or b""):
                got = piece.replace(b".", b" . ").split()  # other white space of ASCII is a full stop by now
                got.append(b".")
                words += got
                sizes.append((name, len(got)))
                held += len(piece)
                if held > PART:
                    yield part()
                    words, sizes, held = [], [], 0
    if words:
        yield part()


@dataclass
class Cells:
    """Which hashed cells of phrases count enough for one of them to be frequent. A phrase has a cell in each half of the table."""

    bits: np.ndarray
    size: int

    def may_be(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        one, other = cells_of(h1, h2, self.size)
        has = lambda at: (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return has(one) & has(other)


def cells_of(h1: np.ndarray, h2: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    half = size // 2
    at = lambda h: (h >> np.uint64(20)).astype(np.int64) & (half - 1)
    return at(h1), at(h2) + half


def grams(part: Part, ruled: dict[int, Cells], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, places, two hashes) of the phrases of 2 to longest words whose shorter parts may all be frequent, and they too where there are cells."""
    good = part.is_word
    for k in range(2, longest + 1):
        good = good[:-1] & good[1:]
        at = np.flatnonzero(good)
        h1, h2 = part.keys(at, k)
        if k in ruled:
            may = ruled[k].may_be(h1, h2)
            at, h1, h2 = at[may], h1[may], h2[may]
            good = np.zeros(len(good), dtype=bool)
            good[at] = True
        yield k, at, h1, h2


def all_grams(part: Part, ruled: dict[int, Cells], longest: int, every_word: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """grams(), and the words of the pairs among them, or all words."""
    for k, at, h1, h2 in grams(part, ruled, longest):
        if k == 2:
            alone = np.flatnonzero(part.is_word) if every_word else np.union1d(at, at + 1)
            yield 1, alone, *part.keys(alone, 1)
        yield k, at, h1, h2


def sums_by_key(batches: Iterator[pa.RecordBatch], width: int, kind: type, packed: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(key, sum) of arrays (key, array as bytes, compressed if they are of width) that come in the order of their keys."""
    last, total = None, np.zeros(0, np.int64)
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            if key != last:
                if last is not None:
                    yield last, total
                last, total = key, np.zeros(width, np.int64)
            own = np.frombuffer(pa.decompress(raw.as_buffer(), width * np.dtype(kind).itemsize, "zstd") if packed else raw.as_buffer(), kind)
            total[: len(own)] += own
    if last is not None:
        yield last, total


def rule_out(docs: DataFrame, level: int, ruled: dict[int, Cells], size: int, least: int) -> Cells:
    """Cells of the phrases of `level` words whose parts may be frequent."""
    most = min(least, 255)  # a byte a cell: from here on it is enough
    shared = docs.sparkSession.sparkContext.broadcast(ruled)  # 8 MB a level at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, np.uint8)
        for part in parts(batches):
            *_, (_, _, h1, h2) = grams(part, shared.value, level)
            for where in cells_of(h1, h2, size):
                at, n = np.unique(where, return_counts=True)
                cells[at] = np.minimum(most, cells[at] + n)
        held = [(i, cells[a : a + PIECE]) for i, a in enumerate(range(0, size, PIECE))]
        held = [(i, pa.compress(own.tobytes(), "zstd", asbytes=True)) for i, own in held if own.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int32()), pa.array([own for _, own in held], pa.binary())], names=["piece", "held"])

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, total in sums_by_key(batches, min(PIECE, size), np.uint8, True):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(total >= most).tobytes()], pa.binary())], names=["piece", "held"])

    schema = "piece int, held binary"
    got = docs.mapInArrow(count, schema).repartition("piece").sortWithinPartitions("piece").mapInArrow(enough, schema).toArrow()  # a bit for each of 2^26 cells at most
    bits = np.zeros(size // 8, np.uint8)
    for piece, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        bits[piece * PIECE // 8 : piece * PIECE // 8 + len(raw)] = np.frombuffer(raw, np.uint8)
    return Cells(bits, size)


# ---- minimal perfect hash ------------------------------------------------------------


@dataclass
class PerfectHash:
    """Slots 0, 1, ... for different keys, without gaps: each level of bits takes the keys that are alone in their place."""

    bits: list[np.ndarray]  # 64 a word
    ranks: list[np.ndarray]  # keys before each word, of all levels
    sizes: list[int]
    key1: np.ndarray  # by slot
    key2: np.ndarray

    @staticmethod
    def place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h2 ^ mix(h1 + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        bits, ranks, sizes, before, left = [], [], [], 0, np.arange(len(h1))
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = cls.place(h1[left], h2[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            bits.append(words)
            ranks.append(before + np.cumsum(counts) - counts)
            sizes.append(size)
            before += int(counts.sum())
            left = left[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("keys aren't different")
        out = cls(bits, ranks, sizes, np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.uint64))
        slot = out.slots(h1, h2)
        out.key1[slot], out.key2[slot] = h1, h2
        return out

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key, any slot or -1 for others."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (bits, ranks, size) in enumerate(zip(self.bits, self.ranks, self.sizes)):
            at = self.place(h1[left], h2[left], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[here]] = (ranks[at >> 6] + under)[here]
            left = left[~here]
        return out

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for others: the stored key decides."""
        slot = self.slots(h1, h2)
        if not len(self.key1):
            return slot
        return np.where((slot >= 0) & (self.key1[slot] == h1) & (self.key2[slot] == h2), slot, -1)

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.key1), *self.sizes], np.int64)
        return b"".join(x.tobytes() for x in (head, *self.bits, *self.ranks, self.key1, self.key2))

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        levels, n = np.frombuffer(raw, np.int64, 2).tolist()
        sizes = np.frombuffer(raw, np.int64, levels, 16).tolist()
        at, arrays = 16 + 8 * levels, []
        for kind, count in [*((np.uint64, s // 64) for s in sizes), *((np.int64, s // 64) for s in sizes), (np.uint64, n), (np.uint64, n)]:
            arrays.append(np.frombuffer(raw, kind, count, at))
            at += 8 * count
        return cls(arrays[:levels], arrays[levels : 2 * levels], sizes, *arrays[2 * levels :])


@dataclass
class Slots:
    """Some blocks of keys, one after another. A key's block follows from its first hash."""

    blocks: dict[int, bytes]
    of: int  # blocks there are in all

    def __post_init__(self) -> None:
        self.loaded = {b: PerfectHash.load(raw) for b, raw in self.blocks.items()}
        self.begins, self.size = {}, 0
        for b, own in self.loaded.items():
            self.begins[b] = self.size
            self.size += len(own.key1)

    def __getstate__(self) -> tuple:
        return self.blocks, self.of

    def __setstate__(self, state: tuple) -> None:
        self.blocks, self.of = state
        self.__post_init__()

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, block = np.full(len(h1), -1, np.int64), (h1 % np.uint64(self.of)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        ends = np.searchsorted(block[order], np.arange(self.of + 1))
        for b, own in self.loaded.items():
            mine = order[ends[b] : ends[b + 1]]
            slot = own.find(h1[mine], h2[mine])
            out[mine] = np.where(slot >= 0, slot + self.begins[b], -1)
        return out


# ---- candidates, counts, cuts -----------------------------------------------------------


KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.binary())])


def once(tables: list[pa.Table]) -> pa.Table:
    """One row for each key of KEYS tables."""
    rows = pa.concat_tables(tables).combine_chunks()
    h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
    return rows.take(pa.array(order[new]))


def boxes(rows: pa.Table, pieces: int) -> pa.RecordBatch:
    """piece, box: the keys of each piece as one value."""
    piece = rows.column("h1").to_numpy().view(np.uint64) % np.uint64(pieces)
    order = np.argsort(piece, kind="stable")
    rows, cuts, held = rows.take(pa.array(order)), np.searchsorted(piece[order], np.arange(pieces + 1)), []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, KEYS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(a, b - a))
            held.append((i, sink.getvalue().to_pybytes()))
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int32()), pa.array([x for _, x in held], pa.binary())], names=["piece", "box"])


def candidates(docs: DataFrame, ruled: dict[int, Cells], longest: int, pieces: int) -> DataFrame:
    """h1, h2, lang, k, phrase: once each, the words and phrases that may be frequent. They go through the shuffle in boxes."""
    shared = docs.sparkSession.sparkContext.broadcast(ruled)  # 8 MB a level at most

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = np.zeros(1, np.uint64), []  # seen is in order; it only spares rows
        for part in parts(batches):
            k, at, h1, h2 = map(np.concatenate, zip(*((np.full(len(at), k, np.int32), at, h1, h2) for k, at, h1, h2 in all_grams(part, shared.value, longest, False))))
            own, first = np.unique(h1, return_index=True)
            new = seen[np.minimum(np.searchsorted(seen, own), len(seen) - 1)] != own
            seen = np.sort(np.concatenate([seen, own[new]]), kind="stable")
            first = first[new]
            k, at, h1, h2 = k[first], at[first], h1[first], h2[first]
            texts = [part.text(*x) for x in zip(at.tolist(), k.tolist())]
            held.append(pa.table([h1.view(np.int64), h2.view(np.int64), [part.languages[i] for i in part.language[at]], k, texts], schema=KEYS))
            if len(seen) > SEEN:
                yield boxes(pa.concat_tables(held), pieces)
                seen, held = np.zeros(1, np.uint64), []
        if held:
            yield boxes(pa.concat_tables(held), pieces)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, count = None, [], 0
        for batch in batches:
            for piece, box in zip(batch.column(0).to_pylist(), batch.column(1)):
                if piece != last and held:
                    yield from once(held).to_batches()
                    held, count = [], 0
                last = piece
                held.append(pa.ipc.open_stream(box.as_buffer()).read_all())
                count += held[-1].num_rows
                if count > SEEN:
                    held = [once(held)]
                    count = 0
        if held:
            yield from once(held).to_batches()

    dealt = docs.mapInArrow(found, "piece int, box binary").repartition("piece").sortWithinPartitions("piece")
    return dealt.mapInArrow(unpacked, "h1 long, h2 long, lang string, k int, phrase binary").withColumn("phrase", F.col("phrase").cast("string"))


def hashed(keys: DataFrame, blocks: int) -> DataFrame:
    """A row per block: block, perfect (its hash, see PerfectHash.load)."""

    def build(rows: pa.Table) -> pa.Table:
        h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        return pa.table({"block": rows.column("block")[:1], "perfect": pa.array([PerfectHash.build(h1, h2).dump()], pa.binary())})

    dealt = keys.select("h1", "h2", block_of("h1", blocks).alias("block"))
    return dealt.groupBy("block").applyInArrow(build, "block int, perfect binary")


def block_of(column: str, blocks: int):
    """The unsigned hash modulo the number of blocks."""
    h = F.col(column)
    return F.pmod(F.pmod(h, F.lit(blocks)) + F.when(h < 0, F.lit((1 << 64) % blocks)).otherwise(0), F.lit(blocks)).cast("int")


def counted(docs: DataFrame, slots: Slots, ruled: dict[int, Cells], longest: int) -> DataFrame:
    """block, counts: how often each of the slots' phrases occurs."""
    shared = docs.sparkSession.sparkContext.broadcast((slots, ruled))  # 17 bytes a key of ROUND_KEYS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cells = shared.value
        total = np.zeros(own.size, np.int64)
        for part in parts(batches):
            for _, _, h1, h2 in all_grams(part, cells, longest, True):
                at = own.find(h1, h2)
                total += np.bincount(at[at >= 0], minlength=own.size)
        held = [(b, total[a : a + len(own.loaded[b].key1)]) for b, a in own.begins.items()]
        held = [(b, n) for b, n in held if n.any()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int32()), pa.array([n.tobytes() for _, n in held], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, total in sums_by_key(batches, max(len(p.key1) for p in shared.value[0].loaded.values()), np.int64):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total[: len(shared.value[0].loaded[block].key1)].tobytes()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    return docs.mapInArrow(count, schema).repartition("block").sortWithinPartitions("block").mapInArrow(add, schema)


def frequent(hashes: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """h1, h2, a of the keys that occur `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, a = PerfectHash.load(raw), np.frombuffer(n, np.int64)
                at = np.flatnonzero(a >= least)
                yield pa.RecordBatch.from_arrays([pa.array(own.key1[at].view(np.int64)), pa.array(own.key2[at].view(np.int64)), pa.array(a[at])], names=["h1", "h2", "a"])

    return hashes.join(counts, "block").select("perfect", "counts").mapInArrow(run, "h1 long, h2 long, a long")


def cut_counts(phrases: DataFrame, slots: Slots, counts: np.ndarray) -> DataFrame:
    """lang, phrase, cut, l, r: of each cut of phrases (lang, phrase) the counts of both parts, null where the slots don't have them."""
    shared = phrases.sparkSession.sparkContext.broadcast((slots, counts))  # 25 bytes a key of ROUND_KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = shared.value

        def read(part: Part, at: np.ndarray, size: np.ndarray) -> np.ndarray:
            out = np.zeros(len(at), np.int64)
            for k in np.unique(size):
                mine = np.flatnonzero(size == k)
                slot = own.find(*part.keys(at[mine], int(k)))
                out[mine] = np.where(slot >= 0, number[slot], 0)
            return out

        for batch in batches:
            for part in parts(iter([batch])):
                ends = np.flatnonzero(~part.is_word)
                begins = np.concatenate([[0], ends[:-1] + 1])
                size = ends - begins
                first = np.repeat(begins, size - 1)
                cut = np.arange(len(first)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1) + 1
                left, right = read(part, first, cut), read(part, first + cut, np.repeat(size, size - 1) - cut)
                names = pa.array([part.languages[i] for i in part.language[first]], pa.string())
                texts = pa.array([part.text(a, n) for a, n in zip(first.tolist(), np.repeat(size, size - 1).tolist())], pa.binary())
                found = lambda n: pa.array(n, mask=n == 0)
                yield pa.RecordBatch.from_arrays([names, texts, pa.array(cut.astype(np.int32)), found(left), found(right)], names=["lang", "phrase", "cut", "l", "r"])

    return phrases.select("lang", F.col("phrase").cast("binary")).mapInArrow(run, "lang string, phrase binary, cut int, l long, r long").withColumn("phrase", F.col("phrase").cast("string"))


def totals(docs: DataFrame) -> DataFrame:
    """lang, n, volume: words and bytes of each language."""
    ends = bytes(32 if c == ord(".") else c for c in small_letters())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            words = pa.array([sum(len(p.translate(ends).split()) for p in pieces(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), words, pa.array([len(t) for t in texts], pa.int64())], names=["lang", "n", "volume"])

    return docs.mapInArrow(run, "lang string, n long, volume long").groupBy("lang").agg(F.sum("n").alias("n"), F.sum("volume").alias("volume"))


def inside(phrase: str, longest: int):
    """The phrases of 2 words and more that stand inside one, itself excepted."""
    words = F.split(phrase, " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(longest - 1)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda i: i + k <= F.size(words) + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    return F.filter(F.array_distinct(spans), lambda s: s != F.col(phrase))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language of docs (lang, text): lang, rank, phrase, a, l, r, n, score.

    Words are runs without space and tab, of pieces that end at .,;:!? and line
    ends, A-Z as a-z. A phrase of 2 to `longest` words that occurs `least` times
    scores floor(1000 a n / (l r)) at its worst cut, a being its occurrences, l and
    r those of its parts and n the language's words; ties go to the first cut.
    One that isn't more frequent than a longer one around it goes. Null texts
    count as empty, null languages as `und`; repeated rows count each. An empty
    table, or one without frequent phrases, gives no rows. Other columns are
    ignored.

    Texts are read five times, and once more for each ROUND_KEYS candidates
    beyond the first.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary"))
    of_all = checkpoint(totals(own))
    volume = of_all.agg(F.sum("volume")).first()[0] or 0
    low, high = CELLS
    size = 1 << min(high, max(low, (volume // BYTES_A_CELL).bit_length()))
    ruled: dict[int, Cells] = {}
    for level in RULED:
        ruled[level] = rule_out(own, level, ruled, size, least)
    with Scratch(spark) as scratch:
        keys = scratch.keep(candidates(own, ruled, longest, 1 << min(PIECES[1], max(PIECES[0], (volume >> 24).bit_length()))))
        n_keys = keys.count()
        blocks = max(1, -(-n_keys // BLOCK_KEYS))
        hashes = scratch.keep(hashed(keys, blocks))
        together = max(1, ROUND_KEYS // BLOCK_KEYS)
        rounds = [range(b, min(b + together, blocks)) for b in range(0, blocks, together)]
        tables: list[DataFrame] = []
        load = lambda some: Slots({r.block: bytes(r.perfect) for r in hashes.filter(F.col("block").between(some[0], some[-1])).orderBy("block").collect()}, blocks)  # noqa: E731  17 bytes for each of ROUND_KEYS keys
        for some in rounds:
            if (slots := load(some)).size:
                tables.append(scratch.keep(counted(own, slots, ruled, longest)))
        if not tables:
            return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
        counts = tables[0]
        for more in tables[1:]:
            counts = counts.unionByName(more)
        often = scratch.keep(frequent(hashes, counts, least).join(keys, ["h1", "h2"]).filter("k > 1").select("lang", "phrase", "k", "a"))
        cuts = None
        for some in rounds:
            slots = load(some)
            by_block = {r.block: np.frombuffer(bytes(r.counts), np.int64) for r in counts.filter(F.col("block").between(some[0], some[-1])).collect()}
            number = [by_block.get(b, np.zeros(len(p.key1), np.int64)) for b, p in slots.loaded.items()]
            got = cut_counts(often, slots, np.concatenate([*number, np.zeros(1, np.int64)]))
            cuts = got if cuts is None else cuts.unionByName(got)
        whole = cuts.groupBy("lang", "phrase", "cut").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        exact = lambda c: F.col(c).cast("decimal(19,0)")
        of_cut = often.join(of_all.select("lang", "n"), "lang").join(whole, ["lang", "phrase"]).withColumn("over", F.lit(SCALE).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("under", exact("l") * exact("r"))
        worst = of_cut.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("worst"))
        longer = often.select("lang", F.explode(inside("phrase", longest)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
        left = worst.join(longer, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (F.col("around") < F.col("a")))
        scored = checkpoint(left.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = max(1, scored.count() // RANKED)
    some = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, phrase, k, count(*) AS a FROM ({" UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS phrase FROM w WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))}) GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.a AS l, y.a AS r, n, ({SCALE} * c.a::HUGEINT * n) // (x.a::HUGEINT * y.a) AS score FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s QUALIFY nth = 1),
longer AS (SELECT b.lang, b.phrase, max(b.a) AS around FROM (SELECT lang, a, k, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' '))))) AS phrase FROM f WHERE k > 2) b GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank FROM worst w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase WHERE around IS NULL OR around < w.a)
WHERE rank <= {TOP}"""
