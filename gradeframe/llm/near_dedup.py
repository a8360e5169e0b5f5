"""Near-duplicate classes by BagMinHash signatures of word shingles.

A shingle that a text has w times counts with weight w. Weights are discretised
by dyadic intervals (0, 1], (1, 2], (2, 4], ...; each shingle and interval has a
Poisson process whose points carry a register and a weight level, and a text
uses the points whose level its weight reaches. The earliest point of each
register is the signature; two texts agree in a register with the probability of
their weighted Jaccard similarity. Points are drawn in order of time and only
until they are later than all registers, so heavy weights cost little.

Bands of the signature name buckets. Texts that share a bucket and whose
signatures agree enough are candidates; their multisets of shingles are compared
exactly; classes are the connected components of verified links. Texts with equal
multisets are one from the start.

A class needs a spanning tree of its links only, so candidates are tried in this
order, and those that are in one class by then need no trial:

1. pivots: in each bucket, the text nearest to the most common registers of those
   not placed yet takes all that are like it, until all are placed. At most as many
   candidates as members.
2. nearest: every text that isn't of its bucket's largest class tries its nearest
   one of another class, as long as that finds links. At most as many again.
3. all the rest: every untried pair of one bucket and different classes, named in
   the first bucket that it shares. Nothing is left out.

Buckets of more than SIDE texts are dealt to tasks in parts; the parts' classes
meet by their best linked texts, then in blocks of parts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import common
from gradeframe.llm.common import Scratch, checkpoint, id_type, join_counted, join_split, table
from gradeframe.llm.components import components
from gradeframe.llm.shingles import ODD, blocks, mix, multisets, pack, unpack

SIMILAR = 0.8
BANDS, ROWS = 24, 4
#: Registers of a signature; the first BANDS * ROWS make the bands, all estimate similarity.
REGISTERS = 256
#: Texts, about, that a task compares with each other or with as many others at a time; larger buckets are dealt out.
SIDE = 2048
#: Texts compared with all of a block at once, and pairs of them whose whole signatures are compared at once.
RUN, PAIRS = 64, 4096
#: 64-bit words of a text's filter, which has a bit for every different shingle.
FILTER = 16


def least(registers: int) -> float:
    """Part of so many registers in which candidates agree: three standard errors below what SIMILAR texts do.

    Four bits of each register are kept, so one in sixteen agrees by chance.
    """
    agree = SIMILAR + (1 - SIMILAR) / 16
    return agree - 3 * (agree * (1 - agree) / registers) ** 0.5


def bag_min_hash(element: np.ndarray, weight: np.ndarray, text: np.ndarray, n_texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The signatures, n_texts x registers times of points; infinite for texts without elements."""
    out = np.full(n_texts * registers, np.inf)
    levels = [np.flatnonzero(weight > (1 << k >> 1)) for k in range(int(weight.max(initial=1) - 1).bit_length() + 1)]
    who = np.concatenate(levels)
    k = np.repeat(np.arange(len(levels)), [len(x) for x in levels]).astype(np.uint64)
    base = np.where(k == 0, 0, np.uint64(1) << np.maximum(k, np.uint64(1)) - np.uint64(1)).astype(np.int64)  # below the interval
    width = np.maximum(base, 1)
    seed = mix(element[who] + k * ODD)
    doc, most = text[who], weight[who]
    time = np.zeros(len(who))
    step = 0
    while len(who):
        step += 1
        bits = mix(seed + np.uint64(step * int(ODD) & (1 << 64) - 1))
        time = time - np.log(((bits >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / width
        used = width == 1
        if not used.all():
            level = base + 1 + (mix(bits) % width.astype(np.uint64)).astype(np.int64)
            used = level <= most
        at = doc * registers + (bits & np.uint64(0xFFFFFF)).astype(np.int64) % registers
        np.minimum.at(out, at[used], time[used])
        live = np.flatnonzero(time < out.reshape(n_texts, registers).max(axis=1)[doc])
        who, base, width, seed, doc, most, time = (x[live] for x in (who, base, width, seed, doc, most, time))
    return out.reshape(n_texts, registers)


def filters(element: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """A filter for each text, n_texts x FILTER words."""
    out = np.zeros(n_texts * FILTER, dtype=np.uint64)
    place = (element >> np.uint64(40)) % np.uint64(64 * FILTER)
    np.bitwise_or.at(out, text * FILTER + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out.reshape(n_texts, FILTER)


def may_be_similar(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether texts of n and m shingles with filters x and y can be similar.

    A bit that only one of them has stands for a shingle that only it has, so this loses no link.
    """
    most = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    return most * (1 + SIMILAR) >= SIMILAR * (n + m) - 1e-6


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (digests of the text), n (shingles), m1, m2 (digests of the multiset, of the text without shingles), bands array<long>, sig (four bits a register), bits (the filter); bands are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, sigs, sizes, sums, bits_of = [], [], [], [], []
            for _, data, offsets in blocks(batch.column(3)):
                n = len(offsets) - 1
                element, times, text = multisets(data, offsets)
                sig = bag_min_hash(element, times, text, n)
                size = np.bincount(text, weights=times, minlength=n).astype(np.int64)
                bits = mix(sig.view(np.uint64))
                key = np.zeros((n, BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key + bits[:, r : BANDS * ROWS : ROWS])
                whole = size > 0
                bands += [x if ok else None for x, ok in zip(key.view(np.int64), whole.tolist())]
                four = (bits & np.uint64(15)).astype(np.uint8)
                sigs += [x.tobytes() for x in four[:, ::2] | four[:, 1::2] << 4]
                bits_of += [x.tobytes() for x in filters(element, text, n)]
                sizes.append(size)
                sums.append(np.zeros((2, n), dtype=np.uint64))
                for k in range(2):
                    np.add.at(sums[-1][k], text, mix(mix(element + np.uint64(k)) + times.astype(np.uint64) * ODD))
            if len(batch):
                size = np.concatenate(sizes)
                own = (batch.column(1 + k).to_numpy() for k in range(2))
                m1, m2 = (pa.array(np.where(size > 0, m.view(np.int64), t)) for m, t in zip(np.concatenate(sums, axis=1), own))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(size), m1, m2, pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(bits_of, pa.binary())],
                    names=["doc_id", "t1", "t2", "n", "m1", "m2", "bands", "sig", "bits"],
                )

    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    return narrow.mapInArrow(run, f"doc_id {id_type(docs)}, t1 long, t2 long, n long, m1 long, m2 long, bands array<long>, sig binary, bits binary")


def buckets(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, uid, band, members): the texts of each bucket with more than one."""
    by_band = texts.filter("bands IS NOT NULL").select("uid", F.posexplode("bands").alias("band", "hash"))
    rows = by_band.select(F.xxhash64("band", "hash").alias("key"), "uid", "band")
    sizes = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    return scratch.keep(join_counted(rows, sizes, "key", "members", max(1, BANDS * texts.count())))


def named_in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first band, of which one at least is equal, of texts with these bands."""
    return (x == y).argmax(axis=1)


def registers_of(sigs: pa.ChunkedArray) -> np.ndarray:
    sig = np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS // 2)
    return np.stack([sig & 15, sig >> 4], axis=2).reshape(-1, REGISTERS)


def filters_of(bits: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), dtype=np.uint64).reshape(-1, FILTER)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that are sorted by their first column, put together so that none of its values goes on in the next table."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if rest and (last > 0 or rest[-1].column(0)[0].as_py() != key[0]):
            yield pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks()
            rest = [batch.slice(last)]
        elif last > 0:
            yield pa.Table.from_batches([batch.slice(0, last)]).combine_chunks()
            rest = [batch.slice(last)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def ordered(a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    names = ["a", "b", "key"][: 2 + len(more)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), *more)], names=names)


def by_pivots(members: DataFrame) -> DataFrame:
    """(a, b), a < b, of members (key, uid, sig, n, bits): one of them is a pivot of the key, the other is like it and like no earlier one."""

    def of_group(uid: np.ndarray, sig: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = np.arange(len(uid))
        while len(left) > 1:
            own = sig[left]
            if len(left) > 2:
                votes = np.stack([(own == v).sum(axis=0) for v in range(16)])
                at = int((own == votes.argmax(axis=0).astype(np.uint8)).sum(axis=1).argmax())
            else:
                at = 0
            near = (own == own[at]).mean(axis=1) >= least(REGISTERS)
            near &= may_be_similar(n[left], bits[left], n[left[at]], bits[left[at]])
            near[at] = False
            if near.any():
                yield np.full(int(near.sum()), uid[left[at]]), uid[left[near]]
            near[at] = True
            left = left[~near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            key, uid = (t.column(i).to_numpy() for i in range(2))
            sig, n, bits = registers_of(t.column(2)), t.column(3).to_numpy(), filters_of(t.column(4))
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]  # most buckets; all of them at once
            two = two[(sig[two] == sig[two + 1]).mean(axis=1) >= least(REGISTERS)]
            two = two[may_be_similar(n[two], bits[two], n[two + 1], bits[two + 1])]
            found = [(uid[two], uid[two + 1])]
            for a, b in zip(cuts[:-1][sizes > 2].tolist(), cuts[1:][sizes > 2].tolist()):
                found += of_group(uid[a:b], sig[a:b], n[a:b], bits[a:b])
            yield ordered(*(np.concatenate(x) for x in zip(*found)))

    dealt = members.select("key", "uid", "sig", "n", "bits").repartition("key").sortWithinPartitions("key", "uid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def parted(members: DataFrame) -> DataFrame:
    """members (key, uid, members, ...) with a key for each part of a bucket of more than SIDE texts."""
    part = F.pmod(F.xxhash64(F.lit(2), "uid"), F.ceil(F.col("members") / SIDE))
    return members.withColumn("key", F.xxhash64("key", part))


def unsettled(members: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """members (key, uid, band) with class, n (texts of the bucket), most (its largest class) and few (texts not of it), of the buckets with more than one class."""
    labelled = members.select("key", "uid", "band").join(labels, "uid")
    by_class = labelled.groupBy("key", "class").agg(F.count("*").alias("texts"))
    by_key = by_class.groupBy("key").agg(F.max(F.struct("texts", "class")).alias("most"), F.sum("texts").alias("n")).filter(F.col("n") > F.col("most.texts"))
    by_key = by_key.select("key", "n", F.col("most.class").alias("most"), (F.col("n") - F.col("most.texts")).alias("few"))
    return join_counted(labelled, by_key, "key", "n", total)


def across(crowd: DataFrame, nearest: bool) -> DataFrame:
    """(a, b, key), a < b, of unsettled() with sig, bands, size (shingles) and bits: candidates of different classes, named in the first bucket that they share.

    Every text that isn't of its bucket's largest class is compared with all of
    the bucket, in blocks, each pair of blocks by itself. With nearest, a text
    only names its nearest one of each block.
    """
    few = BANDS * ROWS

    def of_block(uid: np.ndarray, cls: np.ndarray, sig: np.ndarray, bands: np.ndarray, size: np.ndarray, bits: np.ndarray, band: int, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ours, theirs = np.flatnonzero(left), np.flatnonzero(~left)
        there = np.ascontiguousarray(sig[theirs, :few])
        for at in range(0, len(ours) if len(theirs) else 0, RUN):
            own = ours[at : at + RUN]
            rough = np.stack([(there == row).sum(axis=1) for row in sig[own, :few]]) >= least(few) * few
            i, j = np.nonzero(rough & (cls[own][:, None] != cls[theirs]))
            found: list[tuple[np.ndarray, ...]] = []
            for k in range(0, len(i), PAIRS):
                x, y = own[i[k : k + PAIRS]], theirs[j[k : k + PAIRS]]
                alike = (sig[x] == sig[y]).mean(axis=1)
                ok = (alike >= least(REGISTERS)) & (named_in(bands[x], bands[y]) == band)
                x, y, alike = x[ok], y[ok], alike[ok]
                ok = may_be_similar(size[x], bits[x], size[y], bits[y])
                found.append((x[ok], y[ok], alike[ok]))
            if not found:
                continue
            x, y, alike = (np.concatenate(c) for c in zip(*found))
            if nearest:
                order = np.lexsort((uid[y], -alike, x))
                x, y = x[order], y[order]
                first = np.searchsorted(x, x) == np.arange(len(x))
                x, y = x[first], y[first]
            if len(x):
                yield uid[x], uid[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            block, key, uid, cls = (t.column(i).to_numpy() for i in range(4))
            band = t.column(4).to_numpy()
            sig = registers_of(t.column(5))
            bands = t.column(6).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            size, bits = t.column(7).to_numpy(), filters_of(t.column(8))
            left = t.column(9).to_numpy().astype(bool)
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for x, y in of_block(uid[a:b], cls[a:b], sig[a:b], bands[a:b], size[a:b], bits[a:b], int(band[a]), left[a:b]):
                    yield ordered(x, y, np.full(len(x), key[a]))

    rows = crowd.withColumn("outer", F.ceil(F.col("few") / SIDE)).withColumn("inner", F.ceil(F.col("n") / SIDE))
    at = lambda sides: F.pmod(F.xxhash64(F.lit(2), "uid"), F.col(sides))
    each = lambda sides: F.explode(F.sequence(F.lit(0).cast("long"), F.col(sides) - 1))
    columns = ["key", "uid", "class", "band", "sig", "bands", "size", "bits", "left"]
    ours = rows.filter(F.col("class") != F.col("most")).withColumn("left", F.lit(True)).select(*columns, at("outer").alias("i"), each("inner").alias("j"))
    theirs = rows.withColumn("left", F.lit(False)).select(*columns, each("outer").alias("i"), at("inner").alias("j"))
    dealt = ours.unionByName(theirs).select(F.xxhash64("key", "i", "j").alias("block"), *columns)
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long, key long")


#: Bytes of a shingle's hash in a bag.
UNIT = 5


def bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, bag) of the wanted (uid, lead: doc_id, t1, t2 of a row with the text): the sorted hashes of all shingles, the j-th of equal ones hashed with j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                n = len(offsets) - 1
                element, times, text = multisets(data, offsets)
                each = np.repeat(np.arange(len(element)), times)
                nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                unit = mix(element[each] + nth.astype(np.uint64) * ODD)
                cuts = np.searchsorted(text[each], np.arange(n + 1))
                out = [pack(np.sort(unit[a:b] >> np.uint64(64 - 8 * UNIT))) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(out, pa.binary())], names=["uid", "bag"])

    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")).alias("lead"), text.alias("text"))
    both = keyed.select("text", F.xxhash64("lead.t1", "lead.doc_id").alias("at"), "lead").join(
        wanted.select("uid", F.xxhash64("lead.t1", "lead.doc_id").alias("at"), F.col("lead").alias("of")), "at"
    )  # by the row's id too: of many copies of a text only one meets
    one_each = both.filter(F.col("lead").eqNullSafe(F.col("of"))).select("uid", "text").dropDuplicates(["uid"])
    return one_each.mapInArrow(run, "uid long, bag binary")


def verify(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """The pairs whose multisets overlap by SIMILAR or more of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):  # one by one: the batch is large already
                a, b = unpack(x.as_buffer()), unpack(y.as_buffer())
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(both >= SIMILAR * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    total = max(1, pairs.count())
    of_a = bag.join(pairs.groupBy("a").agg(F.count("*").alias("pairs")), bag["uid"] == F.col("a")).select("a", F.col("bag").alias("bag_a"), "pairs")
    of_b = bag.join(pairs.groupBy("b").agg(F.count("*").alias("pairs")), bag["uid"] == F.col("b")).select("b", F.col("bag").alias("bag_b"), "pairs")
    joined = join_split(join_split(pairs, of_a, "a", total), of_b, "b", total)
    return joined.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """A row per input row: doc_id, t1, t2, class_id (least doc_id of the class) and class_size (rows).

    Equal texts are one class; null texts count as empty. Texts without words
    have no shingles and are only like each other. A class of null ids only has a
    null class_id. Other columns are ignored; an empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(sign(docs))
        lead = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2")).alias("lead")
        grouped = rows.groupBy("m1", "m2").agg(lead, F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        texts = scratch.keep(grouped.select("m1", "m2", F.struct("lead.doc_id", "lead.t1", "lead.t2").alias("lead"), "copies", "bands", "sig", "n", "bits", F.monotonically_increasing_id().alias("uid")))
        members = buckets(texts, scratch)
        total = max(1, members.count())
        near = scratch.keep(members.select("uid").distinct(), total)
        bag = scratch.keep(bags(docs, texts.select("uid", "lead").join(near, "uid")))
        sigs = texts.select("uid", "sig", "n", "bits")
        labels = near.withColumn("class", F.col("uid"))
        tried: list[DataFrame] = []
        links: list[DataFrame] = []

        def link(found: DataFrame, most: int | None = None) -> bool:
            """Verifies the pairs (at most so many) that weren't tried and merges the classes of those that are similar; whether there are any."""
            nonlocal labels
            if tried:
                found = found.join(functools.reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
            tried.append(scratch.keep(found, most))
            new = scratch.keep(verify(tried[-1], bag))
            if new.isEmpty():
                return False
            links.append(new)
            of = lambda end, name: labels.withColumnsRenamed({"uid": end, "class": name})
            between = new.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
            merged = components(between).withColumnsRenamed({"node": "class"})
            sizes = labels.groupBy("class").agg(F.count("*").alias("texts")).join(merged, "class", "left")
            named = join_counted(labels, sizes.select("class", "texts", F.coalesce("component", "class").alias("into")), "class", "texts", total)
            labels = scratch.keep(named.select("uid", F.col("into").alias("class")), total)
            return True

        link(by_pivots(parted(members).join(sigs, "uid")), total)
        large = members.filter(F.col("members") > SIDE)
        while links and not large.isEmpty():
            ends = functools.reduce(DataFrame.unionByName, [x.select(F.col(end).alias("uid")) for x in links for end in ("a", "b")])
            degree = ends.groupBy("uid").agg(F.count("*").alias("degree"))
            best = F.max_by("uid", F.struct(F.coalesce("degree", F.lit(0)), "uid")).alias("uid")
            leads = scratch.keep(large.select("key", "uid").join(labels, "uid").join(degree, "uid", "left").groupBy("key", "class").agg(best).select("key", "uid"), total)
            counted = leads.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
            if not link(by_pivots(parted(join_counted(leads, counted, "key", "members", max(1, leads.count()))).join(sigs, "uid")), total):
                break
        signed = texts.select("uid", "sig", "bands", F.col("n").alias("size"), "bits")
        alive = members
        while True:
            found = scratch.keep(across(unsettled(alive, labels, total).join(signed, "uid"), nearest=True))
            alive = scratch.keep(alive.join(found.select("key").distinct(), "key", "left_semi"), total)  # a bucket without candidates gets none by merging
            if not link(found.select("a", "b").distinct(), total):
                break
        link(across(unsettled(alive, labels, total).join(signed, "uid"), nearest=False).select("a", "b").distinct())
        n_texts, n_rows = texts.count(), max(1, rows.count())
        known = labels.withColumnRenamed("class", "label")
        labelled = scratch.keep(texts.select("uid", "m1", "m2", F.col("lead.doc_id").alias("least"), "copies").join(known, "uid", "left").withColumn("class", F.coalesce("label", "uid")), n_texts)
        sizes = labelled.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("texts"))
        named = join_counted(labelled.select("class", "m1", "m2", "copies"), sizes, "class", "texts", max(1, n_texts))
        of_text = scratch.keep(named.select("m1", "m2", "class_id", "class_size", "copies"), n_texts)
        named = join_counted(rows.select("doc_id", "t1", "t2", "n", "m1", "m2"), of_text, ["m1", "m2"], "copies", n_rows)
        return checkpoint(named.select("doc_id", "t1", "t2", "n", "class_id", "class_size").coalesce(n_rows // common.ROWS + 1))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least doc_id, with docs' columns; of a class without ids all rows stay.

    Null texts count as empty, and empty texts are one class; of repeated rows (same id
    and text) one stays. An empty table gives an empty result.
    """
    of = classes(docs).filter(F.col("class_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = of.select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct()
    text = F.coalesce(docs["text"], F.lit(""))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__t1")) & (F.xxhash64(F.lit(1), text) == F.col("__t2"))
    left = docs.join(gone, same, "left_anti")
    ids = F.col("doc_id").isNotNull()
    once = left.filter(ids).withColumn("__text", F.sha2(F.coalesce(docs["text"], F.lit("")), 256)).dropDuplicates(["doc_id", "__text"])  # equal rows
    return once.drop("__text").unionByName(left.filter(~ids))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
