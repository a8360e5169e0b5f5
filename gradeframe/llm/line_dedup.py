"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are put in one order for all lines, the
rarest first; two sets with a Jaccard similarity of SIMILAR or more share a word
among the first few of each (the prefix). Lines are grouped by prefix words,
candidates are bounded by their lengths, by the places of the shared word and by
the bits of 128-bit word filters that only one of them has, and what is left is
compared word by word. A line goes if an earlier one (by
doc_id, then line) is equal or similar to it.

Pairs are never rows: the first pass over the groups says which sets have
candidates, the second one compares those and returns for each set how many are
like it and where the earliest one is.

Rarity is counted over all lines in a table of a fixed number of hashed cells, a
byte each, which is broadcast. Any order gives the same links; a cell that
several words share only makes some candidates more. A word whose cell counts
one has no other line to meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm.common import Scratch, checkpoint, id_type, join_counted, table
from gradeframe.llm.shingles import ODD, blocks, mix, pack, unpack, words

SIMILAR = 0.8
#: Cells of the rarity table.
CELLS = 1 << 24
#: Cells that are summed together.
PIECE = 1 << 16
#: Bytes of a word's hash in a bag.
UNIT = 5
#: Bytes of the filter, which is broadcast, of lines whose words are wanted. It only saves work: a join follows.
FILTER = 1 << 23
#: Bytes of texts handled at a time: arrays of a word's or byte's 8 bytes stay in the cache.
SPAN = 1 << 18
#: What a line's number is multiplied by before it goes into its text's hash: odd, and no product overflows.
STRIDE = 40503
#: Places from which on a word is a key only together with another one, and sets of a key from which on it is cut into blocks.
OFTEN = 1 << 15
#: Words of the least sets that can be similar without being equal.
LONGER = 4
#: Columns of a set's row under a key, with their types in memory and in tables.
ENTRY = [("key", "i8", "long"), ("uid", "i8", "long"), ("n", "i4", "int"), ("place", "i4", "int"), ("after", "i4", "int"), ("b1", "i8", "long"), ("b2", "i8", "long"), ("side", "i1", "byte")]
#: Entries of a box, about.
BOX = 1 << 14
#: Pairs compared at a time.
PAIRS = 1 << 14


def in_order(line: np.ndarray, code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by line, code and word: one sort of packed integers with their places, unless they leave words undecided."""
    if len(line):
        low, high = max(1, (len(line) - 1).bit_length()), 64 - max(1, int(line[-1]).bit_length())  # below: the place; from `high` on: the line
        if low + 7 < high:
            bits = word >> np.uint64(64 - (high - 7 - low)) << np.uint64(low)
            packed = line.astype(np.uint64) << np.uint64(high) | code.astype(np.uint64) << np.uint64(high - 7) | bits | np.arange(len(line), dtype=np.uint64)
            packed.sort()
            order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
            packed >>= np.uint64(low)
            again = np.flatnonzero(packed[1:] == packed[:-1])
            if np.array_equal(word[order[again + 1]], word[order[again]]):
                return order
    return np.lexsort((word, line << 8 | code))


def line_sets(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, code, text, line, cuts) of the lines that have words: the different words and their codes, a line's rarest first, between cuts; text and line for each line, in order.

    line counts from 0 over the whole block; a text's end is a line's end too.
    """
    ends = np.flatnonzero(data == 10)
    word, line = words(data, np.sort(np.concatenate([offsets, ends + 1])))
    code = codes[(word & np.uint64(CELLS - 1)).astype(np.int64)]
    order = in_order(line, code, word)
    word, line = word[order], line[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(word)), bool), (word[1:] != word[:-1]) | (line[1:] != line[:-1])]))
    word, code, line = word[first], code[order[first]], line[first]
    cuts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1], [True]])) if len(line) else np.zeros(1, np.int64)
    line = line[cuts[:-1]]
    text = np.searchsorted(np.searchsorted(ends, offsets[:-1]) + np.arange(len(offsets) - 1), line, side="right") - 1
    return word, code, text, line, cuts


def rarity(docs: DataFrame) -> np.ndarray:
    """A byte per cell of words, growing with how often they occur; 0 for once or never."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int32)
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0), SPAN):
                np.add.at(cells, (words(data, offsets)[0] & np.uint64(CELLS - 1)).astype(np.int32), np.int32(1))
        used = np.flatnonzero(cells)
        cuts = np.searchsorted(used, np.arange(0, CELLS + 1, PIECE))
        held = [used[x:y].astype(np.int32).tobytes() + cells[used[x:y]].tobytes() for x, y in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), pa.array(held, pa.binary())], names=["piece", "held"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            sums: dict[int, np.ndarray] = {}
            for piece, raw in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                cell, n = np.frombuffer(raw, np.int32).reshape(2, -1)
                own = sums.setdefault(piece, np.zeros(PIECE, np.int64))
                own[cell - piece * PIECE] += n
            coded = [np.where(n > 1, np.minimum(127, np.round(6 * np.log2(np.maximum(n, 1)))), 0).astype(np.uint8).tobytes() for n in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(coded, pa.binary())], names=["piece", "held"])

    schema = "piece int, held binary"
    got = docs.select("text").mapInArrow(count, schema).repartition("piece").sortWithinPartitions("piece").mapInArrow(total, schema).toArrow()  # a byte for each of CELLS cells at most
    out = np.zeros(CELLS, dtype=np.uint8)
    for piece, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(raw, np.uint8)
    return out


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - np.ceil(SIMILAR * n - 1e-9).astype(np.int64) + 1


def binary(units: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The words between cuts, UNIT bytes each, as an array of one value for each piece."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((UNIT * cuts).astype(np.int32)), pa.py_buffer(pack(units))])


def lines(docs: DataFrame, table_of_codes: np.ndarray, often: int = OFTEN) -> DataFrame:
    """A row per line with words: doc_id, mark (a hash of the text), line, d1, d2 (digests of the set), n, b1, b2 (a filter of its words), start, rare, live and n_lines.

    n_lines has the lines of the text, at its first row only. A text without words has one row, of no words.

    live has the words of the prefix, and the next one, that another line may have: those from the place `start`
    on. The first `rare` of them aren't in more than `often` places.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table_of_codes)
    limit = 6 * np.log2(often)
    names = ["doc_id", "mark", "line", "d1", "d2", "n", "b1", "b2", "start", "rare", "live", "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            for first_row, data, offsets in blocks(batch.column(2), SPAN):
                word, code, own, line, cuts = line_sets(data, offsets, codes)
                ends = np.concatenate([[0], np.cumsum(data == 10)])[offsets]
                n_lines = np.where(np.diff(offsets) > 0, np.diff(ends) + 1, 0)
                empty = np.setdiff1d(np.arange(len(n_lines)), own)
                if len(empty):
                    rows, none = pa.array(empty + first_row), pa.array(np.zeros(len(empty), np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[none] * 8, pa.array([b""] * len(empty), pa.binary()), pa.array(n_lines[empty])], names=names)
                if not len(word):
                    continue
                sizes = np.diff(cuts)
                d1, d2 = digests(word, cuts)
                place = np.arange(len(word)) - np.repeat(cuts[:-1], sizes)
                where = np.flatnonzero((place <= np.repeat(prefix_size(sizes), sizes)) & (code > 0))
                live = binary(word[where] >> np.uint64(64 - 8 * UNIT), np.searchsorted(where, cuts))
                start, rare = (np.add.reduceat(x.astype(np.int64), cuts[:-1]) for x in (code == 0, (code > 0) & (code <= limit)))
                rows = pa.array(own + first_row)
                bit = (word >> np.uint64(24)) & np.uint64(127)
                value = np.uint64(1) << (bit & np.uint64(63))
                b1, b2 = (np.bitwise_or.reduceat(np.where(half, value, np.uint64(0)), cuts[:-1]).view(np.int64) for half in (bit < 64, bit >= 64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(line - ends[own] - own), *map(pa.array, (d1, d2, sizes, b1, b2, start, rare)), live, pa.array(n_lines[own], mask=np.diff(own, prepend=-1) == 0)],
                    names=names,
                )

    text = F.coalesce(F.col("text"), F.lit(""))
    schema = f"doc_id {id_type(docs)}, mark long, line long, d1 long, d2 long, n long, b1 long, b2 long, start long, rare long, live binary, n_lines long"
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(run, schema)


def digests(word: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over the words of each line, in whatever order they are."""
    return np.add.reduceat(word, cuts[:-1]).view(np.int64), np.add.reduceat(mix(word ^ ODD), cuts[:-1]).view(np.int64)


def chosen(data: np.ndarray, offsets: np.ndarray, mark: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the lines of texts with these marks whose place() the filter `named` has, each as a text of its own."""
    ends = np.flatnonzero(data == 10)
    before = np.searchsorted(ends, offsets)  # ends of lines before each text
    text = np.repeat(np.arange(len(mark)), np.diff(before) + 1)
    head = np.arange(len(mark)) + before[:-1]  # each text's first line
    start, stop = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    closed = np.arange(len(ends)) + np.repeat(np.arange(len(mark)), np.diff(before))  # the line that each end is of
    start[head], start[closed + 1] = offsets[:-1], ends + 1
    stop[head + np.diff(before)], stop[closed] = offsets[1:], ends
    at = (mark[text] ^ (np.arange(len(text)) - head[text]) * STRIDE) & (8 * FILTER - 1)
    hit = np.flatnonzero(named[at >> 3] >> (at & 7).astype(np.uint8) & 1)
    size = stop[hit] - start[hit]
    cuts = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(cuts[-1]) + np.repeat(start[hit] - cuts[:-1], size)], cuts


def place() -> Column:
    """A hash of a line's text and number (mark, line), as chosen() has it."""
    return F.col("mark").bitwiseXOR(F.col("line") * STRIDE)


def bags(docs: DataFrame, wanted: DataFrame, table_of_codes: np.ndarray) -> DataFrame:
    """The wanted (uid, d1, d2, at and others) without d1, d2 and at, and with a bag: their words, rarest first, UNIT bytes each.

    at is the place() of one line that has the set. Only such lines are split into words.
    """
    cell = F.col("at").bitwiseAND(8 * FILTER - 1)
    bits = wanted.groupBy(F.shiftright(cell, 3).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(at & 7 AS int))")).cast("short").alias("bits"))
    got = bits.toArrow()  # 6 bytes for each of FILTER rows at most
    table_ = np.zeros(FILTER, dtype=np.uint8)
    table_[got.column(0).to_numpy()] = got.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table_)
    order = docs.sparkSession.sparkContext.broadcast(table_of_codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, codes = shared.value, order.value
        for batch in batches:
            mark = batch.column(0).to_numpy()
            for first, data, offsets in blocks(batch.column(1)):
                word, _, _, _, cuts = line_sets(*chosen(data, offsets, mark[first : first + len(offsets) - 1], named), codes)
                if not len(word):
                    continue
                d1, d2 = digests(word, cuts)
                bag = binary(word >> np.uint64(64 - 8 * UNIT), cuts)
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), bag], names=["d1", "d2", "bag"])

    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(run, "d1 long, d2 long, bag binary")
    return found.join(wanted.drop("at"), ["d1", "d2"]).drop("d1", "d2").dropDuplicates(["uid"])


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of sets of n and m words that are similar."""
    return np.ceil(SIMILAR / (1 + SIMILAR) * (n + m) - 1e-9)


def entries(batch: pa.RecordBatch, common: bool) -> list[np.ndarray]:
    """The columns of ENTRY, without a side, for each key of the sets (uid, n, b1, b2, start, rare, live).

    A word of the prefix that isn't in more than OFTEN places is a key by itself
    (after is -1). A common one makes keys with each next word up to one word past
    the prefix: similar sets of four words or more share two words there.
    """
    uid, n, b1, b2, start, rare = (batch.column(i).to_numpy() for i in range(6))
    live = batch.column(6)
    sizes = np.diff(np.frombuffer(live.buffers()[1], np.int32)[live.offset :][: len(uid) + 1]) // UNIT
    word = unpack(b"".join(live.to_pylist()))
    heads = np.minimum(sizes, prefix_size(n) - start)  # words of the prefix itself
    heads = np.clip(heads - rare if common else np.minimum(heads, rare), 0, None)
    skip = np.minimum(rare, sizes) if common else np.zeros(len(uid), np.int64)
    own = np.repeat(np.arange(len(uid)), heads)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(heads) - heads, heads) + skip[own]
    begin = np.cumsum(sizes) - sizes
    key, place, after = word[begin[own] + nth], start[own] + nth, np.full(len(own), -1)
    if common:
        rest = sizes[own] - nth - 1
        own, nth, key, place = (np.repeat(x, rest) for x in (own, nth, key, place))
        second = nth + 1 + np.arange(len(own)) - np.repeat(np.cumsum(rest) - rest, rest)
        key, after = mix(key * ODD + word[begin[own] + second]), start[own] + second
    return [x.astype(kind) for x, (_, kind, _) in zip((key, uid[own], n[own], place, after, b1[own], b2[own]), ENTRY)]


def rows_of(sets: DataFrame, common: bool) -> DataFrame:
    """A row for each key of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = entries(batch, common)
                for at in range(0, len(found[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in found], names=[name for name, _, _ in ENTRY[:-1]])

    return sets.select("uid", "n", "b1", "b2", "start", "rare", "live").mapInArrow(run, ", ".join(f"{name} {kind}" for name, _, kind in ENTRY[:-1]))


def boxed(rows: DataFrame, boxes: int, sets: bool) -> DataFrame:
    """(box, held): entries by the box of their key, whole columns in one value; of sets or of rows of ENTRY.

    So few rows go through the shuffle. A box has all entries of its keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = entries(batch, False) if sets else [batch.column(i).to_numpy() for i in range(len(ENTRY))]
            found = [*found, np.zeros(len(found[0]), np.int8)][: len(ENTRY)]
            box = (mix(found[0].view(np.uint64)) % np.uint64(boxes)).astype(np.int64)
            order = np.argsort(box, kind="stable")
            box, found = box[order], [c[order] for c in found]
            cuts = np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1], [True]])).tolist() if len(box) else [0]
            held = [b"".join(c[x:y].tobytes() for c in found) for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(box[cuts[:-1]]), pa.array(held, pa.binary())], names=["box", "held"])

    rows = rows.select("uid", "n", "b1", "b2", "start", "rare", "live") if sets else rows.select(*[name for name, _, _ in ENTRY])
    return rows.mapInArrow(run, "box long, held binary")


def unboxed(held: list[bytes]) -> list[np.ndarray]:
    """The columns of ENTRY of boxes, by key and n."""
    parts, sizes = [[] for _ in ENTRY], [np.dtype(kind).itemsize for _, kind, _ in ENTRY]
    for raw in held:
        n, at = len(raw) // sum(sizes), 0
        for part, (_, kind, _), size in zip(parts, ENTRY, sizes):
            part.append(np.frombuffer(raw, kind, n, at))
            at += n * size
    found = [np.concatenate(part) for part in parts]
    order = np.lexsort((found[2], found[0]))
    return [c[order] for c in found]


def parted(rows: DataFrame, most: int) -> DataFrame:
    """The rows, with a side: keys of more than `most` rows are cut into blocks, and each two blocks have a key of their own.

    Rows of the sides 1 and 2 are compared with each other, those of side 0 with all of their key.
    """
    counts, total = rows.groupBy("key").agg(F.count("*").alias("count")), rows.count()
    each = join_counted(rows, counts, "key", "count", total)
    parts = F.ceil(F.col("count") / most)
    each = each.withColumn("mine", F.pmod(F.xxhash64("uid"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2)
    return each.select(F.when(parts > 1, F.xxhash64("key", low, high)).otherwise(F.col("key")).alias("key"), *rows.columns[1:], side.cast("byte").alias("side"))


def pairs(key, n, place, after, side, b1, b2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, sorted by key and n, of sets that can be similar if the key has the first words that they share."""
    rest = n - np.where(after < 0, place, after - 1)  # words that may be shared, from the key on
    row, far = np.arange(len(key)), 0
    while len(row):
        far += 1
        row = row[row + far < len(key)]
        row = row[(key[row] == key[row + far]) & (n[row + far] * SIMILAR <= n[row] + 1e-9)]
        i, j = row, row + far
        least = needed(n[i], n[j])
        ok = (np.minimum(rest[i], rest[j]) >= least) & ((side[i] == 0) | (side[i] != side[j]))
        i, j, least = i[ok], j[ok], least[ok]
        alone, alone_there = (np.bitwise_count(b1[x] & ~b1[y]).astype(np.int64) + np.bitwise_count(b2[x] & ~b2[y]) for x, y in ((i, j), (j, i)))
        ok = np.minimum(n[i] - alone, n[j] - alone_there) >= least
        if ok.any():
            yield i[ok], j[ok]


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut between its values only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1].column(0)[-1].as_py() != key[0]):
            whole = [*held, batch.slice(0, last)] if last else held
            yield pa.Table.from_batches(whole).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def columns(rows: list[np.ndarray]) -> list[np.ndarray]:
    """key, n, place, after, side, b1, b2 of the columns of ENTRY; the bits unsigned, as of signed integers those of the absolute value would count."""
    key, _, n, place, after, b1, b2, side = rows
    return [key, n.astype(np.int64), place.astype(np.int64), after.astype(np.int64), side, b1.view(np.uint64), b2.view(np.uint64)]


def meeting(boxes: DataFrame) -> DataFrame:
    """The entries that have a candidate under their key, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_key(batches):
            rows = unboxed(held.column(1).to_pylist())
            met = np.zeros(len(rows[0]), dtype=bool)
            for i, j in pairs(*columns(rows)):
                met[i] = met[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in rows], names=[name for name, _, _ in ENTRY])

    return boxes.repartition("box").sortWithinPartitions("box").mapInArrow(run, ", ".join(f"{name} {kind}" for name, _, kind in ENTRY))


def verified(rows: DataFrame, kind: str) -> DataFrame:
    """A row per key and set with links there: uid, n_links, and last, doc_id, line, the place of the earliest set like it.

    rows have bag, last, doc_id and line besides the columns of meeting(). A link
    counts under the key of the first words that its sets share, so it counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_key(batches):
            key, n, place, after, side, b1, b2 = columns([held.column(c).to_numpy() for c, _, _ in ENTRY])
            rank = np.empty(len(held), np.int64)
            rank[pc.sort_indices(held, [(c, "ascending") for c in ("last", "doc_id", "line")]).to_numpy()] = np.arange(len(held))
            word = unpack(b"".join(held.column("bag").to_pylist()))
            begin = np.cumsum(n) - n
            row = np.repeat(np.arange(len(held), dtype=np.uint64) << np.uint64(8 * UNIT), n)
            order = np.argsort(row | word)
            known = (row | word)[order]

            def shared(i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
                """(pair, place in i, place in j) of the words that are among the first `most` of row i and in row j."""
                own = np.repeat(np.arange(len(i)), most)
                mine = np.arange(len(own)) - np.repeat(np.cumsum(most) - most, most)
                want = j[own].astype(np.uint64) << np.uint64(8 * UNIT) | word[begin[i][own] + mine]
                found = np.minimum(np.searchsorted(known, want), len(known) - 1)
                hit = np.flatnonzero(known[found] == want)
                own = own[hit]
                return own, mine[hit], order[found[hit]] - begin[j][own]

            links, best = np.zeros(len(held), np.int64), np.full(len(held), len(held))
            for many_i, many_j in pairs(key, n, place, after, side, b1, b2):
                for at in range(0, len(many_i), PAIRS):
                    i, j = many_i[at : at + PAIRS], many_j[at : at + PAIRS]
                    # the key has the first words that they share: at these places, and none before
                    to = np.where(after[i] < 0, place[i], after[i]) + 1
                    own, mine, theirs = shared(i, j, to)
                    right = ((mine == place[i][own]) & (theirs == place[j][own])) | ((mine == after[i][own]) & (theirs == after[j][own]))
                    due = 1 + (after[i] >= 0)
                    first = (np.bincount(own, minlength=len(i)) == due) & (np.bincount(own[right], minlength=len(i)) == due)
                    i, j = i[first], j[first]
                    both = np.bincount(shared(i, j, n[i])[0], minlength=len(i))
                    ok = both >= SIMILAR * (n[i] + n[j] - both) - 1e-9
                    i, j = i[ok], j[ok]
                    for x, y in ((i, j), (j, i)):
                        np.add.at(links, x, 1)
                        np.minimum.at(best, x, rank[y])
            some = np.flatnonzero(links)
            other = held.select(["last", "doc_id", "line"]).take(pa.array(np.argsort(rank)[best[some]]))
            out = pa.table({"uid": held.column("uid").take(pa.array(some)), "n_links": links[some], **{c: other.column(c) for c in other.column_names}})
            yield from out.to_batches()

    rows = rows.select(*[name for name, _, _ in ENTRY], "bag", "last", "doc_id", "line")
    return rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(run, f"uid long, n_links long, last boolean, doc_id {kind}, line long")


def judged(docs: DataFrame, scratch: Scratch, often: int = OFTEN, most: int = OFTEN) -> tuple[DataFrame, DataFrame]:
    """The rows of lines(), and of each set that several lines have or that has links: d1, d2, times, earliest (like it), n_links."""
    key, order = ["d1", "d2"], F.struct("last", "doc_id", "line")
    codes = rarity(docs)
    found = scratch.keep(lines(docs, codes, often))
    # of a set's columns, all but the first four are the same in all of its lines
    line = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line", "mark", "n", "b1", "b2", "start", "rare", "live")
    grouped = found.filter("n > 0").groupBy(*key).agg(F.min(line).alias("one"), F.count("*").alias("times"))
    sets = scratch.keep(grouped.select(*key, "times", "one.*", F.monotonically_increasing_id().alias("uid")))
    wide = sets.filter(F.col("n") >= LONGER)
    common = scratch.keep(rows_of(wide.filter(F.length("live") > UNIT * F.col("rare")), True))
    boxes = (wide.agg(F.sum(F.length("live"))).first()[0] or 0) // UNIT // BOX + 1
    met = scratch.keep(meeting(boxed(wide, boxes, True).unionByName(boxed(parted(common, most), boxes, False))))
    wanted = scratch.keep(sets.select("uid", *key, "times", place().alias("at"), "last", "doc_id", "line").join(met.select("uid").distinct(), "uid"))
    bag = scratch.keep(bags(docs, wanted.drop("times"), codes))
    of = scratch.keep(verified(met.join(bag, "uid"), id_type(docs)).groupBy("uid").agg(F.min(order).alias("other"), F.sum("n_links").alias("n_links")))
    linked = wanted.join(of, "uid").select(*key, "times", F.least(order, "other").alias("earliest"), "n_links")
    alone = sets.filter("times > 1").join(of, "uid", "left_anti").select(*key, "times", order.alias("earliest"), F.lit(0).cast("long").alias("n_links"))
    return found, scratch.keep(linked.unionByName(alone))


def placed(found: DataFrame, result: DataFrame, how: str) -> DataFrame:
    """The rows of matches() from what judged() gives: of all lines (how is left), or of those of result's sets (inner)."""
    order, earliest = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line"), F.col("earliest")
    rows = found.filter("n > 0").select("doc_id", "mark", "line", "d1", "d2")
    each = join_counted(rows, result, ["d1", "d2"], "times", max(1, found.count()), how=how)
    first_doc = F.when(earliest.isNull(), F.col("doc_id")).otherwise(earliest["doc_id"])
    return each.select("doc_id", "mark", "line", F.coalesce("n_links", F.lit(0)).alias("n_links"), first_doc.alias("first_doc"), F.coalesce(order > earliest, F.lit(False)).alias("removed"))


def matches(docs: DataFrame, often: int = OFTEN, most: int = OFTEN) -> DataFrame:
    """A row per line with words: doc_id, mark, line, n_links (different lines like it), first_doc, removed.

    Words in more than `often` places are keys only together with another one, and
    keys of more than `most` sets are compared by blocks; neither changes results.
    Null texts have no lines, lines without words have no rows, repeated rows (same id
    and text) give their rows each, and an empty table gives none. Null ids come last.
    """
    with Scratch(docs.sparkSession) as scratch:
        return checkpoint(placed(*judged(docs, scratch, often, most), "left"))


def summary(docs: DataFrame) -> DataFrame:
    """A row per input row: doc_id, n_lines, n_removed, n_links, first_doc (of the earliest line like one of its own; its own id if none is).

    Null and empty texts have no lines. Null ids come after all others. Equal
    rows have equal lines at equal places and don't remove each other's. Other
    columns are ignored; an empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        found, result = judged(docs, scratch)
        texts = found.filter("n_lines IS NOT NULL").groupBy("doc_id", "mark").agg(F.min("n_lines").alias("n_lines"), F.count("*").alias("copies"))
        own = placed(found, result, "inner").groupBy("doc_id", "mark").agg(F.count_if("removed").alias("n_removed"), F.sum("n_links").alias("n_links"), F.min("first_doc").alias("first_doc"))
        own = own.withColumnsRenamed({"doc_id": "own_id", "mark": "own_mark"})
        joined = texts.join(own, texts["doc_id"].eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")), "left")
        # equal rows have all lines as often
        once = [F.coalesce(F.call_function("div", c, "copies"), F.lit(0)).alias(c) for c in ("n_removed", "n_links")]
        each = joined.select("doc_id", "n_lines", *once, F.coalesce(F.least("first_doc", "doc_id"), "doc_id").alias("first_doc"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        return checkpoint(each.drop("copy"))


def clean(docs: DataFrame) -> DataFrame:
    """docs without the lines that repeat earlier ones; rows and other columns stay.

    Null texts stay null, texts whose lines all go become empty, repeated rows are
    cleaned alike, and an empty table gives an empty result.
    """
    gone = matches(docs).filter("removed").groupBy("doc_id", "mark").agg(F.collect_set("line").alias("__gone"))
    gone = gone.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__mark")), "left")
    left = F.filter(F.split(joined["text"], "\n"), lambda x, i: ~F.array_contains("__gone", i.cast("long")))
    text = F.when(F.col("__gone").isNull(), joined["text"]).otherwise(F.array_join(left, "\n"))
    return joined.select(*[text.alias("text") if c == "text" else joined[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))
