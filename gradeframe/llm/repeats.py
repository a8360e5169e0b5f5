"""Removal of long repeated passages with a run-length suffix index.

A passage of LENGTH bytes is found by its anchor: of its strings of GRAM bytes, the
one of least hash. Equal passages have equal anchors, each passage has one, and
neighbouring passages mostly share it, so a text falls into a few contexts: an
anchor with the bytes of all passages that it anchors. Contexts that occur again
as they are have all their passages repeated. Where one anchor has different
contexts, one of each goes to an index of that anchor's contexts:

the index is a Burrows-Wheeler transform kept as runs, with the text position and
the match length at both ends of each run. Inside a run a suffix and its
neighbour both move back by a byte, so the match lengths of a run's positions
follow from those at its ends. Streaming over the text gives each position's
longest match elsewhere; passages of LENGTH or more of it are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm.common import Scratch, checkpoint, id_type, join_counted, table
from gradeframe.llm.shingles import ODD, blocks, mix, powers

LENGTH, GRAM = 400, 128
#: Bytes of contexts in one index.
INDEX_BYTES = 1 << 20
#: Anchors with more different contexts have their passages compared by digest instead.
CONTEXTS = 4096
#: Ends a context in the index; no byte of UTF-8.
END = 0xFF


class RunLengthIndex:
    """Match statistics of a set of byte strings against each other."""

    def __init__(self, strings: list[bytes]):
        text = np.frombuffer(b"".join(s + bytes([END]) for s in strings), dtype=np.uint8)
        sizes = np.fromiter((len(s) + 1 for s in strings), dtype=np.int64, count=len(strings))
        self.starts = np.cumsum(sizes) - sizes
        string = np.repeat(np.arange(len(strings)), sizes)
        self.left = np.repeat(self.starts + sizes - 1, sizes) - np.arange(len(text))  # bytes to the string's end
        order, self.ranks = self._sort(text, string)
        self.text = text
        before = np.where(order > 0, text[order - 1], END)
        cut = (before[1:] != before[:-1]) | (before[1:] == END)  # ends of strings are all different
        heads = np.flatnonzero(cut) + 1
        longest = self._common(order[heads - 1], order[heads])
        # a run's first suffix with the one before it; its last one with the one after
        self.head_at, self.head_len = self._sampled(order[heads], longest, order[0])
        self.tail_at, self.tail_len = self._sampled(order[heads - 1], longest, order[-1])
        self.runs = len(heads) + 1

    @staticmethod
    def _sampled(at: np.ndarray, longest: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
        at, longest = np.append(at, edge), np.append(longest, 0)
        by_place = np.argsort(at)
        return at[by_place], longest[by_place]

    def _sort(self, text: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffixes in order, by doubling from eight bytes, and the ranks by 8, 16, 32, ... bytes."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            key |= np.where(self.left >= k, padded[k : k + n], np.uint64(0)) << np.uint64(56 - 8 * k)
        ends = np.where(self.left < 8, string + 1, 0)
        order = np.lexsort((ends, key))
        changed = (key[order][1:] != key[order][:-1]) | (ends[order][1:] != ends[order][:-1])
        ranks, length = [], 8
        while True:
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(changed)])
            ranks.append(rank.astype(np.int32))
            if rank[order[-1]] == n - 1:
                return order, ranks
            after = np.where(self.left >= length, rank[np.minimum(np.arange(n) + length, n - 1)] + 1, 0)
            pair = rank * (n + 1) + after
            # only suffixes that still share a rank have to be sorted again
            shared = np.zeros(n, dtype=bool)
            same = ~changed
            shared[1:] |= same
            shared[:-1] |= same
            where = np.flatnonzero(shared)
            order[where] = order[where][np.argsort(pair[order[where]], kind="stable")]
            ordered = pair[order]
            changed = ordered[1:] != ordered[:-1]
            length *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefixes of the suffixes at a and b."""
        out = np.zeros(len(a), dtype=np.int64)
        most = np.minimum(self.left[a], self.left[b])
        for level in range(len(self.ranks) - 1, -1, -1):
            length = 8 << level
            fits = out + length <= most
            x, y = np.where(fits, a + out, 0), np.where(fits, b + out, 1)
            out += np.where(fits & (self.ranks[level][x] == self.ranks[level][y]), length, 0)
        for _ in range(8):
            fits = out < most
            x, y = np.where(fits, a + out, 0), np.where(fits, b + out, 0)
            more = fits & (self.text[x] == self.text[y])
            if not more.any():
                break
            # a byte that differs stops its pair: its limit is where it stands
            most = np.where(fits & ~more, out, most)
            out += more
        return out

    def matches(self) -> np.ndarray:
        """Of each position, the longest match that begins anywhere else."""
        places = np.arange(len(self.text))

        def along(at: np.ndarray, length: np.ndarray) -> np.ndarray:
            near = np.searchsorted(at, places, side="right") - 1
            return np.where(near >= 0, length[near] - (places - at[near]), 0)

        return np.maximum(0, np.maximum(along(self.head_at, self.head_len), along(self.tail_at, self.tail_len)))

    def repeated(self, length: int = LENGTH) -> list[np.ndarray]:
        """Of each string, the places where a passage of this length begins that begins elsewhere too."""
        hits = np.flatnonzero(self.matches() >= length)
        cuts = np.searchsorted(hits, np.append(self.starts, len(self.text)))
        return [hits[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], self.starts)]


def ranges(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive integers."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > 1) + 1
    return list(zip(places[np.append(0, cuts)].tolist(), places[np.append(cuts - 1, len(places) - 1)].tolist()))


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first, last, anchor, c1, c2) of the contexts: passages first to last share an anchor; c1, c2 digest their bytes."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    up, down = powers(1 << max(20, n.bit_length()))
    first_sums, second_sums = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=first_sums[1:])
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64) * ODD)[data] * up[:n], out=second_sums[1:])
    gram = mix((first_sums[GRAM:] - first_sums[:-GRAM]) * down[: n - GRAM + 1])
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of passage s, for s up to n - LENGTH
    text = np.searchsorted(offsets, np.arange(len(place)), side="right") - 1
    inside = np.arange(len(place)) + LENGTH <= offsets[text + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    new = (np.diff(place[starts]) != 0) | (np.diff(text[starts]) != 0)
    first = starts[np.concatenate([[True], new])]
    last = starts[np.concatenate([new, [True]])]
    end = last + LENGTH
    size = (end - first).astype(np.uint64) * ODD
    c1 = mix((first_sums[end] - first_sums[first]) * down[first] + size)
    c2 = mix((second_sums[end] - second_sums[first]) * down[first] + size)
    own = text[first]
    return own, first - offsets[own], last - offsets[own], gram[place[first]].view(np.int64), c1.view(np.int64), c2.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.cast("binary").alias("text"))


def contexts(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, lo, hi, h, c1, c2 of every context of docs (as keyed() gives them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(3)):
                text, *found = anchored(data, offsets)
                rows = pa.array(text + first)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), *map(pa.array, found)], names=["doc_id", "t1", "t2", "lo", "hi", "h", "c1", "c2"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, t1 long, t2 long, lo long, hi long, h long, c1 long, c2 long")


def with_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, t1, t2, lo, hi, h, times) with the context's bytes: h, t1, t2, lo, times, body. Equal rows of docs give equal rows."""
    lists = wanted.groupBy("doc_id", "t1", "t2").agg(F.collect_list(F.struct("lo", "hi", "h", "times")).alias("own"))
    w = lists.withColumnsRenamed({"doc_id": "w_id", "t1": "w_1", "t2": "w_2"})
    joined = docs.join(w, docs["doc_id"].eqNullSafe(F.col("w_id")) & (F.col("t1") == F.col("w_1")) & (F.col("t2") == F.col("w_2")))
    each = joined.select("t1", "t2", "text", F.explode("own").alias("c"))
    size = (F.col("c.hi") - F.col("c.lo") + LENGTH).cast("int")
    return each.select("c.h", "t1", "t2", "c.lo", "c.times", F.substring("text", (F.col("c.lo") + 1).cast("int"), size).alias("body"))


def by_index(rows: DataFrame) -> DataFrame:
    """(t1, t2, lo, hi): ranges of repeated passages among the contexts of each anchor; only of contexts that occur once."""

    def solve(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        bodies = t.column("body").to_pylist()
        once = {}
        for i, body in enumerate(bodies):
            once.setdefault(body, i)  # equal rows of the input
        at = list(once.values())
        found: list[tuple[int, int, int, int]] = []
        t1, t2, lo, times = (t.column(c).to_pylist() for c in ("t1", "t2", "lo", "times"))
        for i, places in zip(at, RunLengthIndex([bodies[i] for i in at]).repeated()):
            if times[i] == 1:
                found += [(t1[i], t2[i], lo[i] + a, lo[i] + b) for a, b in ranges(places)]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], names=["t1", "t2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # sorted by h
            h = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else []
            lengths = np.diff(np.frombuffer(batch.column(5).buffers()[1], np.int32)[batch.column(5).offset :][: len(h) + 1]) if len(h) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if size >= INDEX_BYTES and held[-1].column(0)[-1].as_py() != h[a]:
                    yield solve(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(lengths[a:b].sum())
        if held:
            yield solve(held)

    dealt = rows.select("h", "t1", "t2", "lo", "times", "body").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "t1 long, t2 long, lo long, hi long")


def by_digest(rows: DataFrame) -> DataFrame:
    """As by_index(), for anchors with too many contexts: passages are counted by a digest of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                body, n = row["body"], len(row["body"]) - LENGTH + 1
                made = b"".join(hashlib.blake2b(body[i : i + LENGTH], digest_size=16).digest() for i in range(n))
                d = np.frombuffer(made, dtype=np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.full(n, row["t1"])), pa.array(np.full(n, row["t2"])), pa.array(row["lo"] + np.arange(n))],
                    names=["d1", "d2", "t1", "t2", "lo"],
                )

    each = checkpoint(rows.mapInArrow(run, "d1 long, d2 long, t1 long, t2 long, lo long").distinct())
    again = each.groupBy("d1", "d2").agg(F.count("*").alias("occurs")).filter("occurs > 1")
    return join_counted(each, checkpoint(again), ["d1", "d2"], "occurs", max(1, each.count())).select("t1", "t2", "lo", F.col("lo").alias("hi"))


def repeats(docs: DataFrame) -> DataFrame:
    """(t1, t2, marks): of each text with repeated passages, array<struct<lo, hi>> of where they begin."""
    key = ["h", "c1", "c2"]
    with Scratch(docs.sparkSession) as scratch:
        every = scratch.keep(contexts(docs))
        total = max(1, every.count())
        kinds = scratch.keep(every.groupBy(*key).agg(F.count("*").alias("times"), F.min(F.struct("t1", "t2", "doc_id", "lo", "hi")).alias("one")))
        per_anchor = kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1")
        again = kinds.filter("times > 1").select(*key, "times")
        whole = join_counted(every, again, key, "times", total).select("t1", "t2", "lo", "hi")
        differing = join_counted(kinds.select("h", "one", "times"), per_anchor, "h", "kinds", max(1, kinds.count()))
        differing = scratch.keep(differing.select("one.*", "h", "times", "kinds"))
        found = whole.unionByName(by_index(with_bytes(docs, differing.filter(F.col("kinds") <= CONTEXTS))))
        many = differing.filter(F.col("kinds") > CONTEXTS)
        if not many.isEmpty():
            found = found.unionByName(by_digest(with_bytes(docs, many)))
        return checkpoint(found.groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("marks")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """A row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes left).

    Null texts count as empty; texts of fewer than LENGTH bytes have no
    passages. Equal texts, equal rows too, are repeats of each other. Null ids
    pass through; other columns are ignored; an empty table gives an empty result.
    """
    docs = keyed(docs)
    marks = repeats(docs).withColumnsRenamed({"t1": "m1", "t2": "m2"})
    joined = docs.join(marks, (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, removed, spans, done = [], 0, 0, 0
                for m in sorted(own or (), key=lambda m: m["lo"]):
                    lo, end = m["lo"], m["hi"] + LENGTH
                    if lo > done or not spans:
                        parts.append(text[done:lo])
                        spans += 1
                        removed += end - lo
                    else:
                        removed += max(0, end - done)
                    done = max(done, end)
                parts.append(text[done:])
                out.append((len(text), removed, spans, b"".join(parts)))
            n, r, s, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("doc_id", "text", "marks").mapInArrow(run, f"doc_id {id_type(docs)}, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
