"""The document operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import random
import re
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import ODD, SCHEMA, prose  # noqa: I001
from gradeframe.llm import common, decontam, exact_dedup, langid, line_dedup, mixing, near_dedup, quality, repeats, sharding, tokens
from gradeframe.llm.components import components
from gradeframe.llm.registry import ORACLES, QUERIES
from gradeframe.llm.shingles import blocks, multisets, words

SPACES = re.compile("[\x20\x09-\x0d]+")


def split(t):
    return [w for w in SPACES.split(t or "") if w]


def cell(v):
    return "null" if v is None else str(v) if isinstance(v, bool) else repr(float(v)) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, sf, name):
    got, want = QUERIES[name](spark, sf), con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    at = [columns.index(c) for c in got.columns]
    assert sorted(tuple(map(cell, r)) for r in got.collect()) == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if int(q[2:].split("_")[0]) <= 10))
def test_a_row_per_document(spark, sf, name):
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def dedup_index(spark):
    return exact_dedup.DigestIndex(spark, f"test_index_{random.randrange(1 << 40)}", 4)


RUNS = {
    "exact": lambda spark, d: exact_dedup.deduplicate(d, dedup_index(spark)),
    "schedule": lambda spark, d: mixing.schedule(d),
    "shards": lambda spark, d: sharding.assign(d, 4),
    "decontam": lambda spark, d: decontam.decontaminate(d, spark.createDataFrame([(1, prose(1, 20)), (2, "kurz"), (3, None), (4, ""), (None, "text of the")], "item_id long, text string")),
    "repeats": lambda spark, d: repeats.remove_repeats(d),
    "near": lambda spark, d: near_dedup.classes(d),
    "lines": lambda spark, d: line_dedup.summary(d),
    "language": lambda spark, d: langid.identify(d, *langid.learn(d)),
    "quality": lambda spark, d: quality.score(d.withColumn("held_out", F.lit(False)), quality.ByteConvNet.fresh()),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows(spark, odd, name):
    out = RUNS[name](spark, odd)
    ids = lambda rows: sorted(str(r[0]) for r in rows)
    assert ids(out.select("doc_id").collect()) == ids(odd.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, none, name):
    assert RUNS[name](spark, none).count() == 0


@pytest.mark.parametrize("name", sorted(set(RUNS)))
def test_clashing_columns(spark, clashing, name):
    assert RUNS[name](spark, clashing).count() == len(ODD)


@pytest.mark.parametrize("stage", [langid.known_language, near_dedup.keep_one, mixing.mix, line_dedup.clean], ids=lambda f: f.__name__)
def test_stages_keep_columns(spark, odd, clashing, none, stage):
    assert stage(clashing).columns == clashing.columns
    got = stage(clashing).collect()
    assert got and stage(none).count() == 0
    whole = {r[1] for r in ODD}
    if stage is not line_dedup.clean:
        assert all(r["text"] in whole for r in got)
    assert decontam.clean(clashing, spark.createDataFrame([(1, "kurz")], "item_id long, text string")).columns == clashing.columns


# ---- exact dedup --------------------------------------------------------------


def test_exact_dedup(spark, odd):
    by = collections.defaultdict(list)
    for i, t, *_ in ODD:
        by[SPACES.sub(" ", t or "")].append(i)
    got = exact_dedup.deduplicate(odd, dedup_index(spark)).collect()
    for r in got:
        own = next(v for t, v in by.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and r.keep_id == min((i for i in own if i is not None), default=None)
    assert sum(r.kept for r in got) == len(by)


def test_index_persists(spark):
    index = dedup_index(spark)
    first = spark.createDataFrame([(5, "a b"), (6, "a  b"), (7, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a b"), (8, "d"), (9, "d")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.deduplicate(first, index).collect() if r.kept} == {5, 7}
    got = {r.doc_id: r for r in exact_dedup.deduplicate(second, index).collect()}
    assert {i for i, r in got.items() if r.kept} == {8} and got[1].keep_id == 5
    assert index.read().count() == 3
    index.append(spark.createDataFrame([], "digest binary, keep_id long"))
    assert index.read().count() == 3
    index.compact()
    third = spark.createDataFrame([(10, "c"), (11, "e")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.deduplicate(third, index).collect() if r.kept} == {11}
    assert len(index.versions()) == 1 and index.versions() == ["v1"]
    spark.sql(f"DROP TABLE {index.name}")  # as if another session had made it
    again = exact_dedup.DigestIndex(spark, index.name, 4)
    assert {r.doc_id for r in exact_dedup.deduplicate(third, again).collect() if r.kept} == set() and again.read().count() == 4
    again.drop()
    assert not again.exists() and exact_dedup.buckets_for(3) == 64 and exact_dedup.buckets_for(10**10) == 16384


def texts(spark, ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")


def test_index_keeps_its_buckets(spark):
    """An index reopened with another number of buckets knows all it has; compact() changes the number."""
    name = f"test_index_{random.randrange(1 << 40)}"
    first = exact_dedup.DigestIndex(spark, name, 8)
    assert exact_dedup.deduplicate(texts(spark, range(300)), first).filter("kept").count() == 300
    for buckets in (16, 3):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        again = exact_dedup.DigestIndex(spark, name, buckets)
        assert again.buckets == 8 and exact_dedup.deduplicate(texts(spark, range(300)), again).filter("kept").count() == 0
        assert again.read().count() == 300
    again.compact(32)
    assert again.buckets == 32 and again.versions() == ["v1"] and first.buckets == 32
    assert exact_dedup.deduplicate(texts(spark, range(250, 350)), first).filter("kept").count() == 50 and first.read().count() == 350
    first.drop()


def test_an_append_that_died_is_not_read(spark, monkeypatch):
    """Rows without their append's mark don't count: the same batch again is kept whole, as if it came first."""
    index = dedup_index(spark)
    exact_dedup.deduplicate(texts(spark, range(10)), index)
    write = index._write

    def dies(rows, table_name, folder, buckets, append):
        write(rows, table_name, folder, buckets, append)
        fs, at = exact_dedup.pafs.FileSystem.from_uri(f"{index.path}/{folder}")
        fs.delete_file(f"{at}/_append-{append}")
        raise OSError("the executor is gone")

    monkeypatch.setattr(index, "_write", dies)
    with pytest.raises(OSError):
        index.append(exact_dedup.deduplicate(texts(spark, range(10, 20)), dedup_index(spark)).select(F.unhex("text_sha256").alias("digest"), "keep_id"))
    monkeypatch.undo()
    assert index.read().count() == 10
    assert exact_dedup.deduplicate(texts(spark, range(5, 20)), index).filter("kept").count() == 10 and index.read().count() == 20
    index.compact()
    assert index.read().count() == 20 and spark.table(index.name).count() == 20
    index.drop()


# ---- mixing -------------------------------------------------------------------


def filled(sizes):
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        open_ = sum(w for s, w in weights.items() if s not in stopped)
        target = {s: 3.0 * sizes[s] if s in stopped else weights[s] * left / open_ for s in sizes}
        over = {s for s in sizes if target[s] > 3 * sizes[s] and s not in stopped}
        if not over:
            return target
        stopped |= over


def test_targets_and_taken(spark):
    rows = [(i, prose(i, 1 + i * 37 % 200), "en", [None, "a", "b", "c", "é", "z"][0 if i % 50 == 0 else 1 + i % 5 if i % 7 else 5], 1) for i in range(400)]
    rows += [(1000 + i, prose(i, 5), "en", "small", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.schedule(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(split(t))
    want, taken, source = filled(sizes), collections.Counter(), {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(want[s], abs=1e-5) and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size and 0 <= r.position <= 1
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.schedule(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copies = collections.Counter(r.doc_id for r in mixing.mix(docs).collect())
    whole = {r.doc_id: r.taken // max(1, r.size) for r in mixing.schedule(docs, whole=True).collect()}
    assert all(copies[i] == n for i, n in whole.items())


def test_curriculum_order(spark):
    docs = spark.createDataFrame([(i, prose(i, 50), "en", "abc"[i % 3], 1) for i in range(300)], SCHEMA)
    mean = {r.skey: r.m for r in mixing.schedule(docs).groupBy("skey").agg(F.avg("position").alias("m")).collect()}
    assert mean["+a"] > mean["+c"]  # weight 1 grows over time, weight 3 shrinks


def test_each_copy_has_its_own_position(spark, monkeypatch):
    rows = [(i, prose(i, 3 + i % 40), "en", "src" + "abcd"[min(3, i % 7)], i) for i in range(160)]
    rows += [(500, prose(500, 30), "en", "srca", 1)] * 3 + [(None, prose(501, 20), None, None, 2)] * 2  # equal rows, nulls
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.schedule(docs, whole=True).collect()
    want = []
    for r in plan:
        start, slope = r.weight, 4 - 2 * r.weight
        for k in range(r.copies):
            demand = min(1.0, (k * r.source_size + r.offset) / r.target)
            # the area under the line from start to end, scaled to 1, reaches the demand at this time
            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (start * mid + slope * mid * mid / 2) / 2 < demand else (lo, mid)
            want.append((lo, r.doc_id, r.size))
    assert max(r.copies for r in plan) >= 2
    got = mixing.mix(docs).collect()
    assert sorted(map(str, ((r.doc_id, len(split(r.text))) for r in got))) == sorted(str(x[1:]) for x in want)
    at = collections.defaultdict(list)
    for when, i, size in sorted(want, key=lambda x: x[0]):
        at[i, size].append(when)
    seen = collections.Counter()
    times = []
    for r in got:
        k = (r.doc_id, len(split(r.text)))
        times.append(at[k][seen[k]])
        seen[k] += 1
    assert all(a <= b + 1e-6 for a, b in zip(times, times[1:]))
    double = {r.skey for r in plan if r.copies > 1 and r.target >= 2 * r.source_size}
    places = [n for n, r in enumerate(got) if f"+{r.source}" in double]
    assert double and np.mean(places) / len(got) < 0.75  # not all at the end


# ---- sharding -----------------------------------------------------------------


def test_shards(spark, odd):
    docs = spark.range(1003).selectExpr("id AS doc_id", "repeat('x', cast(id % 9 AS int)) AS text").repartition(7)
    got = sharding.assign(docs, 10).collect()
    counts = collections.Counter(r.shard for r in got)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert all(r["size"] == r.doc_id % 9 + 16 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 9)) for r in got)
    assert sorted(map(str, sharding.assign(docs, 10).collect())) == sorted(map(str, got))


def test_communication_matrix():
    counts = np.array([50, 0, 7, 1000])
    m = sharding.communication_matrix(counts, 6, 1)
    assert (m.sum(axis=1) == counts).all() and np.ptp(m.sum(axis=0)) <= 1
    draws = np.mean([sharding.communication_matrix(np.array([30, 30]), 3, s)[0] for s in range(400)], axis=0)
    assert np.allclose(draws, 10, atol=0.5)


def test_communication_matrix_is_hypergeometric():
    """Against shuffling all rows and counting: means and variances of a cell."""
    counts, shards = np.array([6, 10, 4]), 4
    drawn = np.array([sharding.communication_matrix(counts, shards, s) for s in range(3000)])
    rng = np.random.default_rng(5)
    of = np.repeat(np.arange(3), counts)
    cut = []
    for _ in range(3000):
        to = np.repeat(np.arange(shards), 5)[rng.permutation(20)]
        cut.append([[((of == p) & (to == s)).sum() for s in range(shards)] for p in range(3)])
    cut = np.array(cut)
    assert np.allclose(drawn.mean(axis=0), cut.mean(axis=0), atol=0.12)
    assert np.allclose(drawn.var(axis=0), cut.var(axis=0), atol=0.2)


def test_matrix_of_a_hundred_billion_rows():
    counts = np.array([20_000_000_000, 0, 7, 79_999_999_993, 1], dtype=np.int64)
    a = sharding.communication_matrix(counts, 40, 3)
    assert (a.sum(axis=1) == counts).all() and set(a.sum(axis=0)) == {2_500_000_000, 2_500_000_001} and (a >= 0).all()
    big = a[0] / 20_000_000_000  # each near 1/40, by a few standard deviations of some 1e-6
    assert abs(big - 1 / 40).max() < 6e-6 and len(set(a[0].tolist())) > 30


@pytest.mark.parametrize("good, bad, drawn", [(3, 4, 2), (10, 5, 12), (1, 100, 50), (400, 600, 300), (70_000, 30_000, 50_000)])
def test_hypergeometric_draws(good, bad, drawn):
    """Frequencies against the exact probabilities, by chi square over classes of enough draws."""
    from math import comb

    rng, n = np.random.default_rng(9), 20_000
    got = collections.Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    low, high = max(0, drawn - bad), min(good, drawn)
    if good < 1000:
        want = {k: n * comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) for k in range(low, high + 1)}
        many = [k for k, x in want.items() if x >= 20]
        assert set(got) <= set(want)
        assert sum((got[k] - want[k]) ** 2 / want[k] for k in many) < len(many) + 5 * (2 * len(many)) ** 0.5
    total = good + bad
    mean, var = drawn * good / total, drawn * good / total * bad / total * (total - drawn) / (total - 1)
    x = np.array(list(got.elements()))
    assert abs(x.mean() - mean) < 5 * (var / n) ** 0.5 and abs(x.var() / var - 1) < 0.06


def test_log_binomial():
    from math import comb, log

    for n, p in ((5, 0.3), (60, 0.5), (300, 0.01)):
        for x in range(n + 1):
            want = log(comb(n, x)) + (x * log(p)) + (n - x) * log(1 - p)
            assert abs(sharding.log_binomial(x, n, p) - want) < 1e-10 * max(1, abs(want))


def test_shards_keep_large_ids_beside_nulls(spark):
    ids = [(1 << 60) + 7, (1 << 60) + 9, None, -3, None, (1 << 60) + 7]
    docs = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    got = sharding.assign(docs, 2).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in got), key=key) == sorted(ids, key=key)
    assert {zlib.crc32(f"t{n}".encode()): i for n, i in enumerate(ids)} == {r.text_crc32: r.doc_id for r in got}


def test_written_shards(spark, tmp_path):
    docs = spark.range(200).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    where = sharding.write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and back.join(where, ["doc_id", "shard", "slot"]).count() == 200


def test_written_shards_of_odd_rows(spark, clashing, none, tmp_path):
    for n, docs in enumerate((clashing, none)):
        path = str(tmp_path / str(n))
        where = sharding.write_shards(docs, path, 3)
        if not n:
            back = spark.read.parquet(path)
            assert back.count() == where.count() == len(ODD) and {"input_shard", "input_slot"} < set(back.columns)
            pairs = lambda rows: sorted(str((r.doc_id, r.shard, r.slot)) for r in rows.collect())
            assert pairs(back) == pairs(where)
            assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str(x[:2]) for x in ODD)


@pytest.mark.parametrize("name", ["repeats", "shards", "near", "lines"])
def test_ids_may_be_texts(spark, odd, name):
    docs = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = RUNS[name](spark, docs)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted("None" if x[0] is None else f"d{x[0]}" for x in ODD)


# ---- decontamination ----------------------------------------------------------


def brute_decontam(docs, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[s : s + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


def test_decontamination(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choice("abcd") for _ in range(r.choice([1, 3, 13, 14, 30])))) for i in range(12)] + [(50, "Éa ÉA"), (51, None), (52, "..."), (None, "zz")]
    docs = [(i, r.choice([" ", "-", "\n"]).join(r.choice("abcdABCDe") for _ in range(r.choice([0, 5, 40, 200])))) for i in range(40)]
    docs += [(100 + i, f"pre, {items[i][1].upper()}; post") for i in range(12)] + [(200, None), (201, "éa éa"), (202, "x Éa.ÉA y"), (None, "zz top"), (203, "...")]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("mark")
    assert sorted(str(tuple(x)) for x in got.collect()) == brute_decontam(docs, items)


@pytest.mark.parametrize("keys", [0, 100])
def test_large_benchmark_is_not_broadcast(spark, monkeypatch, keys):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", keys)
    r = random.Random(6)
    docs = [(i, " ".join(r.choice("abcdef") for _ in range(r.choice([0, 20, 150])))) for i in range(40)] + [(1, prose(1, 100)), (2, prose(2, 100)), (None, "b " + prose(1, 50)), (7, None), (8, prose(1, 100)), (8, "x")]
    items = [(7, prose(1, 40))] + [(i, " ".join(r.choice("abcdef") for _ in range(r.choice([2, 13, 16])))) for i in range(20, 30)]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("mark")
    assert sorted(str(tuple(x)) for x in got.collect()) == brute_decontam(docs, items)


def test_clean_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "kurz"), (2, None)], "item_id long, text string")
    got = decontam.clean(odd, items)
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in odd.collect() if r.text != "kurz")
    assert decontam.clean(none, items).count() == 0 and decontam.clean(odd, items.filter("false")).count() == len(ODD)


# ---- near duplicates and lines ------------------------------------------------


def bag(t):
    w = split(t)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def test_signatures_are_unbiased():
    texts = ["a b c d e f g h " * 20 + "x y z", "a b c d e f g h " * 14 + "q r", prose(1, 100), prose(1, 90) + " " + prose(2, 10)]
    for _, data, offsets in blocks(pa.array(texts)):
        element, times, text = multisets(data, offsets)
        sig = near_dedup.bag_min_hash(element, times, text, 4, 4096)
        for x, y in ((0, 1), (2, 3)):
            assert (sig[x] == sig[y]).mean() == pytest.approx(similarity(bag(texts[x]), bag(texts[y])), abs=0.03)


def edited(t, rate, seed):
    r = random.Random(seed)
    return " ".join(prose(r.random(), 1) if r.random() < rate else w for w in t.split())


def near_fixture():
    docs = [(i, prose(i, 120)) for i in range(60)]
    docs += [(100 + i, edited(prose(i % 12, 120), 0.004 * (i % 6), i)) for i in range(120)]
    docs += [(300 + i, prose(3, 120)) for i in range(20)] + [(400, "a b"), (401, "a b"), (402, "a  b"), (403, ""), (404, None)]
    return docs


def test_near_duplicates(spark):
    docs = near_fixture()
    bags = {i: bag(t) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, _ in docs:
        for j, _ in docs:
            if i < j and ((bags[i] and similarity(bags[i], bags[j]) >= 0.8) or (dict(docs)[i] or "") == (dict(docs)[j] or "")):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in got}


@pytest.mark.parametrize("side", [2048, 64])
def test_large_group_against_brute_force(spark, monkeypatch, side):
    """A base's copies at all distances from it: some links are between texts that are both far from the middle."""
    monkeypatch.setattr(near_dedup, "SIDE", side)
    monkeypatch.setattr(common, "FEW", 0 if side < 2048 else common.FEW)
    docs = [(i, edited(prose(1, 100), 0.05 * random.Random(i).random(), i)) for i in range(500)]
    bags = [set(bag(t)) for _, t in docs]
    assert max(max(bag(t).values()) for _, t in docs) == 1
    ids = {w: k for k, w in enumerate(sorted(set().union(*bags)))}
    has = np.zeros((500, len(ids)), dtype=np.float32)
    for i, x in enumerate(bags):
        has[i, [ids[w] for w in x]] = 1
    both = has @ has.T
    links = both >= 0.8 * (has.sum(axis=1)[:, None] + has.sum(axis=1)[None] - both)
    label = np.arange(500)
    while True:
        new = np.where(links, label[None], 500).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert 3 < len(set(label.tolist())) < 400
    got = dict(near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "class_id").collect())
    assert [got[i] for i in range(500)] == label.tolist()


def test_filters_bound_similarity():
    texts = [edited(prose(k % 3, 60), 0.02 * (k % 5), k) for k in range(60)] + ["a b " * 30, "a b " * 24 + "c", "a b"]
    for _, data, offsets in blocks(pa.array(texts)):
        element, times, text = multisets(data, offsets)
        n, bits = np.bincount(text, weights=times).astype(np.int64), near_dedup.filters(element, text, len(texts))
        x, y = (v.ravel() for v in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
        may = near_dedup.may_be_similar(n[x], bits[x], n[y], bits[y])
        like = np.array([similarity(bag(texts[i]), bag(texts[j])) >= 0.8 for i, j in zip(x, y)])
        assert like.sum() > len(texts) and not (like & ~may).any() and may.mean() < 0.5


def test_equal_signatures_are_one_class(spark, monkeypatch):
    assert [near_dedup.unpack(near_dedup.pack(np.array(x, np.uint64))).tolist() for x in ([], [1, (1 << 40) - 1])] == [[], [1, (1 << 40) - 1]]
    spaced = [(i, prose(1, 40).replace(" ", " " * (i % 20 + 1), i // 20 + 1)) for i in range(300)]
    got = near_dedup.classes(spark.createDataFrame(spaced, "doc_id long, text string"))
    assert {tuple(r) for r in got.select("class_id", "class_size").collect()} == {(0, len(spaced))}
    monkeypatch.setattr(near_dedup, "SIDE", 16)
    docs = [(i, prose(1, 8000) + f" end{i}") for i in range(60)]
    got = near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in got.select("class_id", "class_size").collect()} == {(0, 60)}


def test_blocks_of_a_large_bucket_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SIDE", 4)
    r = np.random.default_rng(3)
    base = r.integers(0, 256, near_dedup.REGISTERS // 2).astype(np.uint8)
    rows = []
    for u in range(40):
        sig = base.copy()
        at = r.choice(len(sig), int(r.integers(0, 30)), replace=False)
        sig[at] = r.integers(0, 256, len(at))
        rows.append((7, u, int(r.integers(0, 4)) if u % 3 else 0, 5, sig.tobytes(), [3 if b == 5 or b == 2 and u % 4 == 0 else u * 100 + b for b in range(near_dedup.BANDS)]))
    registers = near_dedup.registers_of(pa.chunked_array([[x[4] for x in rows]]))
    few = near_dedup.BANDS * near_dedup.ROWS
    alike = lambda a, b, n: (registers[a, :n] == registers[b, :n]).sum() >= near_dedup.least(n) * n
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if rows[a][2] != rows[b][2] and (a % 4 or b % 4) and alike(a, b, few) and alike(a, b, near_dedup.REGISTERS)}
    n_most = collections.Counter(x[2] for x in rows).most_common(1)[0]
    crowd = spark.createDataFrame(rows, "key long, uid long, class long, band int, sig binary, bands array<long>")
    crowd = crowd.withColumns({"size": F.lit(9).cast("long"), "bits": F.lit(bytes(8 * near_dedup.FILTER))})
    crowd = crowd.withColumn("n", F.lit(40).cast("long")).withColumn("most", F.lit(n_most[0]).cast("long")).withColumn("few", F.lit(40 - n_most[1]).cast("long"))
    assert want and {tuple(x)[:2] for x in near_dedup.across(crowd, nearest=False).collect()} == want  # pairs of which both are multiples of 4 share band 2, too
    assert {tuple(x)[:2] for x in near_dedup.across(crowd, nearest=True).collect()} <= want
    pairs = near_dedup.by_pivots(crowd.drop("n").withColumnRenamed("size", "n")).collect()
    assert 0 < len(pairs) < 40
    assert all(alike(a, b, near_dedup.REGISTERS) for a, b in pairs)


def test_joins_split_hot_keys(spark, monkeypatch):
    """The joins for hot keys against plain ones, on tables that are too small to need them."""
    monkeypatch.setattr(common, "FEW", 0)
    rows = spark.range(3000).selectExpr("id AS v", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS k")
    stats = rows.groupBy("k").agg(F.count("*").alias("pairs")).withColumn("w", F.col("k") * 2)
    want = sorted(map(tuple, rows.join(stats, "k").select("k", "v", "w").collect()))
    assert sorted(map(tuple, common.join_counted(rows, stats, "k", "pairs", 3000, 8).select("k", "v", "w").collect())) == want
    assert sorted(map(tuple, common.join_split(rows, stats, "k", 3000, 20).select("k", "v", "w").collect())) == want
    assert common.join_split(rows, stats, "k", 3000).count() == 3000


@pytest.mark.parametrize("few", [0, common.FEW])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {n.node: n.component for n in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_line_links(spark):
    r = random.Random(9)
    base = [prose(i, r.randint(3, 30)) for i in range(30)]
    docs = [(i, "\n".join(edited(r.choice(base), 0.03, i * 10 + k) for k in range(r.randint(0, 6)))) for i in range(60)] + [(90, None), (91, "")]
    where = collections.defaultdict(list)
    for d, t in sorted(docs):
        for n, line in enumerate((t or "").split("\n")):
            if s := frozenset(split(line)):
                where[s].append((d, n))
    like = {s: [o for o in where if o != s and len(s & o) >= 0.8 * len(s | o) - 1e-9] for s in where}
    removed, links, first = collections.Counter(), collections.Counter(), {d: d for d, _ in docs}
    for s, places in where.items():
        earliest = min([min(places), *(min(where[o]) for o in like[s])])
        for p in places:
            first[p[0]] = min(first[p[0]], earliest[0])
            removed[p[0]] += p > earliest
            links[p[0]] += len(like[s])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x for x in line_dedup.summary(frame).collect()}
    assert all((got[d].n_removed, got[d].n_links, got[d].first_doc) == (removed[d], links[d], first[d]) for d, _ in docs)
    left = {x.doc_id: x.text for x in line_dedup.clean(frame).collect()}
    assert all(len((left[d] or "").split("\n")) == len((t or "").split("\n")) - removed[d] or not left[d] for d, t in docs)


def test_line_keys_of_two_words(spark):
    """Common words as keys with a second one, and keys cut into blocks, find what plain keys find."""
    r = random.Random(4)
    base = [[f"w{r.randint(0, 40)}" for _ in range(r.randint(8, 30))] for _ in range(4)]
    texts = [" ".join(w if r.random() < 0.96 else f"w{r.randint(0, 40)}" for w in r.choice(base)) for _ in range(240)]
    frame = spark.createDataFrame([(i, "\n".join(texts[2 * i : 2 * i + 2])) for i in range(120)], "doc_id long, text string")
    where = collections.defaultdict(list)
    for k, t in enumerate(texts):
        where[frozenset(split(t))].append((k // 2, k % 2))
    like = {s: [o for o in where if o != s and len(s & o) >= 0.8 * len(s | o) - 1e-9] for s in where}
    want = {}
    for s, places in where.items():
        earliest = min(min(where[o]) for o in [s, *like[s]])
        want |= {p: (len(like[s]), earliest[0], p > earliest) for p in places}
    assert sum(map(len, like.values())) > 1000
    for often, most in ((1 << 15, 1 << 15), (2, 1 << 15), (20, 5), (1, 3)):
        rows = line_dedup.matches(frame, often, most).collect()
        assert {(x.doc_id, x.line): (x.n_links, x.first_doc, x.removed) for x in rows} == want


def test_short_lines(spark):
    lines = ["Home", "Read more", "read more", "a b c d", "d c b a", "a b c d e", "a b c", "Home Home", " ", ""]
    docs = [(i, "\n".join(random.Random(i).choices(lines, k=5))) for i in range(30)]
    where = collections.defaultdict(list)
    for d, t in docs:
        for n, line in enumerate(t.split("\n")):
            if s := frozenset(split(line)):
                where[s].append((d, n))
    removed, links = collections.defaultdict(set), collections.Counter()
    for s, places in where.items():
        like = [o for o in where if o != s and len(s & o) >= 0.8 * len(s | o) - 1e-9]
        earliest = min(min(where[o]) for o in [s, *like])
        for d, n in places:
            links[d] += len(like)
            if (d, n) > earliest:
                removed[d].add(n)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x for x in line_dedup.summary(frame).collect()}
    assert all((got[d].n_removed, got[d].n_links) == (len(removed[d]), links[d]) for d, _ in docs)
    left = {x.doc_id: x.text for x in line_dedup.clean(frame).collect()}
    assert all(left[d] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in removed[d]) for d, t in docs)


def test_lines_are_counted_as_they_are_split(spark, tmp_path):
    """The result has all rows, equal ones and those without words too, without another reading of the texts."""
    docs = [(1, "a b\n\nc d"), (1, "a b\n\nc d"), (1, "e"), (None, "a b\n"), (2, None), (3, ""), (3, ""), (4, " \n\t\n"), (5, "\n" * 7), (6, "f g h")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    out = line_dedup.summary(spark.read.parquet(f"{tmp_path}/docs"))
    assert out.inputFiles() == []
    shutil.rmtree(f"{tmp_path}/docs")
    want = [(d, len(t.split("\n")) if t else 0, int(d is None), 0, 1 if d is None else d) for d, t in docs]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_left_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 0)
    rows = spark.range(3000).selectExpr("id AS v", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS k")
    stats = rows.groupBy("k").agg(F.count("*").alias("pairs")).filter("k < 30 OR k = 40")
    want = sorted(map(str, rows.join(stats, "k", "left").select("k", "v", "pairs").collect()))
    assert sorted(map(str, common.join_counted(rows, stats, "k", "pairs", 3000, 8, how="left").select("k", "v", "pairs").collect())) == want


def test_words_of_odd_texts():
    r = random.Random(6)
    texts = [None, "", "a", "", "a b", "b", " ", "ab\x0b", "\x0cb", *("".join(r.choices("ab é\n\t\x0b\u3000", k=r.randint(0, 14))) for _ in range(400))]
    for size in (1, 20, 1 << 18):
        got = [(int(h), first + int(at)) for first, data, offsets in blocks(pa.array(texts), size) for h, at in zip(*words(data, offsets))]
        want = [(w, n) for n, t in enumerate(texts) for w in split(t)]
        assert [n for _, n in got] == [n for _, n in want]
        assert len(set(zip((h for h, _ in got), (w for w, _ in want)))) == len({h for h, _ in got}) == len({w for w, _ in want})


def test_order_of_words():
    """One sort of packed integers gives the order by line, code and word, also where it has to leave it to another sort."""
    r = np.random.default_rng(8)
    for n, lines, spread in ((0, 1, 1), (1, 1, 1), (2000, 50, 1 << 63), (2000, 3, 5), (2000, 1 << 50, 1 << 63), (300, 2, 1 << 30)):
        line, code = np.sort(r.integers(0, lines, n)), r.integers(0, 128, n).astype(np.uint8)
        word = r.integers(0, spread, n, dtype=np.uint64)
        order = line_dedup.in_order(line, code, word)
        assert sorted(order.tolist()) == list(range(n))
        rows = list(zip(line[order].tolist(), code[order].tolist(), word[order].tolist()))
        assert rows == sorted(rows)


def test_only_wanted_lines_are_split():
    r = random.Random(3)
    texts = ["", "\n", "a b\n", None, "c", "\nd e\n\n f", "", *("".join(r.choices("ab \n\r", k=r.randint(0, 60))) for _ in range(200)), ""]
    marks = np.array([r.getrandbits(64) - (1 << 63) for _ in texts])
    lines = [(int(m), n, line) for m, t in zip(marks, texts) for n, line in enumerate((t or "").split("\n"))]
    for share in (0, 0.2, 1):
        picked = [x for x in lines if r.random() < share]
        named = np.zeros(line_dedup.FILTER, np.uint8)
        for m, n, _ in picked:
            at = (m ^ n * line_dedup.STRIDE) % (8 * line_dedup.FILTER)
            named[at >> 3] |= 1 << (at & 7)
        got = []
        for first, data, offsets in blocks(pa.array(texts), 500):
            raw, cuts = line_dedup.chosen(data, offsets, marks[first : first + len(offsets) - 1], named)
            got += [raw[x:y].tobytes().decode() for x, y in zip(cuts, cuts[1:])]
        assert got == [line for _, _, line in picked]


# ---- repeated passages ----------------------------------------------------------


def test_index_matches():
    r = random.Random(1)
    for _ in range(15):
        base = [bytes(r.choices(b"abc", k=r.randint(1, 60))) for _ in range(6)]
        strings = list({b"".join(r.choices(base, k=r.randint(1, 5))) for _ in range(8)})
        index = repeats.RunLengthIndex(strings)
        longest = index.matches()
        places = [(i, j) for i, s in enumerate(strings) for j in range(len(s))]
        for i, j in r.sample(places, 20):
            best = max(
                next((k for k, (x, y) in enumerate(zip(strings[i][j:], strings[a][b:])) if x != y), min(len(strings[i]) - j, len(strings[a]) - b))
                for a, b in places if (a, b) != (i, j)
            )
            assert longest[index.starts[i] + j] == best
    assert repeats.RunLengthIndex([b"ab" * 500]).runs < 20  # few runs in a repetitive text


def brute_repeats(docs):
    texts = [(d, (t or "").encode()) for d, t in docs]
    count = collections.Counter(b[s : s + 400] for _, b in texts for s in range(len(b) - 399))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, dtype=int)
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s] += 1
                gone[s + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("most", [4096, 3])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "CONTEXTS", most)
    passage, other = prose(50, 120), prose(51, 70)
    docs = [(i, f"{prose(i, 30 + i)} {passage} {prose(100 + i, 40)}") for i in range(12)]
    docs += [(20, passage + passage), (21, other[:399]), (22, other[:399]), (23, other[:400]), (24, other[:400]), (25, "ab" * 400), (26, None), (27, ""), (28, prose(1, 20)), (29, other + "é" + passage[:450])]
    docs += [(40, prose(60, 200)), (41, prose(60, 200)), (42, prose(60, 200)[:900] + "!" + prose(60, 200)[901:])]
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("k", F.sha2("kept", 256)).drop("kept")
    assert sorted(str(tuple(x)) for x in got.collect()) == brute_repeats(docs)


@pytest.mark.parametrize("words", [50, 51, 58, 66, 80, 120])
def test_passages_by_length(spark, words):
    """Passages of over 50 words in two texts: removed if they have 400 bytes, left if they have fewer."""
    passage = " ".join(f"word{i % 10}" for i in range(words))[: words * 6 - 1]
    passage = prose(words, 200)[: len(passage)]
    docs = [(1, f"{prose(1, 30)} <{passage}> {prose(2, 30)}"), (2, f"{prose(3, 40)} [{passage}] {prose(4, 5)}"), (3, prose(5, 90))]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [len(passage) * (len(passage) >= 400)] * 2 + [0]
    assert got[1].kept.decode() == docs[0][1].replace(passage, "" if len(passage) >= 400 else passage)


# ---- token files ----------------------------------------------------------------


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [1 << 40], sorted(random.Random(1).choices(range(10**9), k=2000)), sorted(random.Random(2).choices(range(40), k=2000))])
def test_elias_fano(values):
    e = tokens.EliasFano.from_bytes(tokens.EliasFano.encode(np.array(values, dtype=np.int64)).to_bytes())
    assert e.all().tolist() == values and [e.select(i) for i in range(len(values))] == values
    if len(values) == 2000:
        assert len(e.to_bytes()) < 2000 * 8 / 2


def test_word_encoder():
    e = tokens.WordEncoder(tokens.default_tokenizer())
    r = random.Random(5)
    alphabet = "aAé'ſİ s\t\n\x1c\x85 ́<|endoftext|>ΣΑς漢.,!!!123 'S  "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(2000)] + [t or "" for _, t, *_ in ODD] + ["a<|endoftext|>b <|startoftext|>", "plain words, and. more", "a.. b"]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == [x.ids for x in want]


@pytest.mark.parametrize("most", [tokens.FILE_IDS, 50])
def test_token_files(spark, odd, none, tmp_path, monkeypatch, most):
    monkeypatch.setattr(tokens, "FILE_IDS", most)
    path = (tmp_path / "t").as_uri()
    manifest = tokens.write_tokens(odd, path, tokens.default_tokenizer())
    assert (manifest.agg(F.max("nth")).first()[0] > 0) == (most == 50)
    got = sorted(tokens.read_tokens(manifest, path).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted((d for d, *_ in ODD), key=lambda d: (d is not None, d or 0))
    t = tokens.WordEncoder(tokens.default_tokenizer()).tokenizer
    crc = lambda x: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(d), crc(x)) for d, x, *_ in ODD) == sorted((str(x.doc_id), x.ids_crc32) for x in got)
    at = 0
    for x in got:
        assert x.start == at
        at += x.n_tokens
    empty = (tmp_path / "e").as_uri()
    assert tokens.read_tokens(tokens.write_tokens(none, empty, tokens.default_tokenizer()), empty).count() == 0


# ---- classifiers ------------------------------------------------------------------


def test_language(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op10_language_id"](spark, big).join(docs, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    mixed = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "the of and")], "doc_id long, text string")
    langs, prototypes = langid.learn(spark.createDataFrame([(1, "the of and in", "en"), (2, "der die das und", "de")], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in langid.identify(mixed, langs, prototypes).collect()} == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert {r.lang_pred for r in langid.identify(mixed, [], prototypes[:0]).collect()} == {"und"}


def test_long_texts_are_read_whole():
    end = "wort " * 10
    a, b = langid.bundle(["the " * 300_000, "the " * 300_000 + end])[0]
    assert not np.allclose(a, b)
    net = quality.ByteConvNet.fresh()
    assert net.score_all([b"x" * 2_000_000])[0] != net.score_all([b"x" * 2_000_000 + b"\x01\x02\x03\x04\x05\x06"])[0]


def test_quality(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    got = QUERIES["op1_quality"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.9 and 0 <= r[1] <= r[2] <= 1
    net = quality.ByteConvNet.fresh()
    texts = [prose(i, i).encode() for i in range(40)]
    assert np.allclose(net.score_all(texts), [net.scores([t])[0] for t in texts])
    x, y = [b"good text here", b"### bad ###", b"more good text", b"*** bad"], np.array([1, 0, 1, 0], np.float32)
    before = [p.copy() for p in net.params]
    loss = lambda: -np.mean(np.log(np.where(y == 1, net.scores(x), 1 - net.scores(x))))
    g = net.gradients(x, y)
    for k in (1, 3):  # filters and output weights against differences
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.params[k][i] += 1e-2
        up = loss()
        net.params[k][i] -= 2e-2
        assert (up - loss()) / 2e-2 == pytest.approx(float(g[k][i]), rel=0.1, abs=1e-3)
        net.params[k][...] = before[k]


def test_quality_forward_by_loops():
    net = quality.ByteConvNet.fresh(9)
    net.params[0][0] = 0  # padding
    embed, filters, bias, out, out_bias = net.params
    texts = [b"", b"abc", b"plain words here, and more of them", b"xyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxy!", b"la la la la la la la la la la la la la la", bytes(range(1, 200))]
    for t, got in zip(texts, net.score_all(texts)):
        padded = t + bytes((len(t) // 4 + 2) * 4 - len(t)) + bytes(40)
        looped = [any(i >= d and all(padded[i + k] == padded[i + k - d] for k in range(16)) for d in range(2, 25)) and padded[i] != 0 for i in range(len(padded) - 16)]
        best = np.full(len(bias), -np.inf)
        for at in range(0, (len(t) // 4 + 1) * 4, 4):
            x = np.concatenate([[*embed[padded[at + k]], float(looped[at + k])] for k in range(8)])
            best = np.maximum(best, x @ filters + bias)
        assert got == pytest.approx(1 / (1 + np.exp(-(np.maximum(best, 0) @ out + out_bias[0]))), abs=1e-5)


def test_language_of_long_texts(monkeypatch):
    """Part by part as at once, and in the texts' order."""
    r = random.Random(3)
    texts = ["".join(r.choice(["wort ", "été", " ", "1, ", "ab", "\n"]) for _ in range(n)) for n in (0, 3, 400, 2, 900, 5, 5)] + ["x" * 300]
    whole, has = langid.bundle(texts)
    for chunk in (7, 50, 1000):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        runs = list(langid.vectors(texts))
        assert [i for first, v, _ in runs for i in range(first, first + len(v))] == list(range(len(texts)))
        assert np.allclose(np.concatenate([v for _, v, _ in runs]), whole) and (np.concatenate([h for *_, h in runs]) == has).all()


def test_quality_of_long_texts(monkeypatch):
    """In windows as at once, wherever the windows end; a text of 50 MB takes little more memory than its bytes."""
    import tracemalloc

    net, r = quality.ByteConvNet.fresh(), random.Random(5)
    word = lambda: bytes(r.choice(b"abc de.") for _ in range(r.randint(1, 30))) * r.choice([1, 1, 1, 4])
    texts = [b"".join(word() for _ in range(n)) for n in (0, 1, 3, 40, 60, 90)]
    texts += [t[:-k] for t in texts[3:] for k in (1, 2, 3)]
    whole = [net.scores([t])[0] for t in texts]
    for block in (64, 128, 1 << 10):
        monkeypatch.setattr(quality, "BLOCK", block)
        assert np.allclose([net.long_score(t) for t in texts], whole, atol=1e-6) and np.allclose(net.score_all(texts), whole, atol=1e-6)
    monkeypatch.setattr(quality, "BLOCK", 1 << 19)
    long = b"some words and more of them. " * 1_800_000
    tracemalloc.start()
    assert 0 <= net.score_all([long])[0] <= 1
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_language_vectors_by_loops(monkeypatch):
    texts = ["Añb ß", "", "123 !", "日本語 テキスト", "a", "Привет мир", "abc" * 50]
    letter = langid.letter_vectors().astype(int)
    place = lambda ch: 1 + ord(ch) % (langid.SLOTS - 1) if ch.isalpha() else 0
    want = []
    for t in texts:
        padded, v = f" {t.lower()} ", np.zeros(langid.DIM)
        for i in range(1, len(padded) - 1):
            if padded[i].isalpha():
                a, b, c = (letter[place(ch)] for ch in padded[i - 1 : i + 2])
                v += np.roll(a, 2) * np.roll(b, 1) * c
        want.append(v)
    for cells in (langid.TABLE, 20):
        monkeypatch.setattr(langid, "TABLE", cells)
        got, has = langid.bundle([t.lower() for t in texts])
        assert np.allclose(got, want) and has.tolist() == [any(ch.isalpha() for ch in t) for t in texts]


# ---- pipeline ---------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(0)).cache()
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    texts = dict(docs.select("doc_id", "text").collect())
    langs, prototypes = langid.learn(docs)
    keep = []
    for i, t in texts.items():
        v, has = langid.bundle([(t or "").lower()])
        cos = prototypes @ v[0] / max(1e-9, np.linalg.norm(v[0]))
        if has[0] and cos.max() >= langid.LEAST_COSINE:
            keep.append(i)
    known = P.language(spark, docs, sf).cache()
    assert ids(known) == sorted(keep)
    # one document of each class of like ones
    bags = {i: bag(texts[i]) for i in keep}
    sizes = {i: sum(b.values()) for i, b in bags.items()}
    root = {i: i for i in keep}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(keep):
        for j in keep[k + 1 :]:
            if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) and similarity(bags[i], bags[j]) >= 0.8:
                root[max(top(i), top(j))] = min(top(i), top(j))
    single = P.near_duplicates(spark, known, sf).cache()
    assert ids(single) == sorted({top(i) for i in keep}) and single.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    judged = [eval(x) for x in brute_decontam([tuple(r) for r in single.select("doc_id", "text").collect()], items)]
    clean = P.decontamination(spark, single, sf).cache()
    assert ids(clean) == sorted(x[0] for x in judged if not x[-1])
    plan = {r.doc_id: r for r in mixing.schedule(clean, whole=True).collect()}
    mixed = P.mixture(spark, clean, sf).cache()
    assert ids(mixed) == sorted(i for i, r in plan.items() for _ in range(r.copies))
    coder = tokens.WordEncoder(tokens.default_tokenizer()).tokenizer
    want = [zlib.crc32(np.array([*coder.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i in ids(mixed)]
    got = sorted(P.token_files(spark, mixed, sf).collect(), key=lambda r: r.start)
    assert [r.ids_crc32 for r in got] == want
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [docs.count()]
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf).cache()
        kept.append(out.count())
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    assert kept[1] >= 0.98 * kept[0] and kept[2] <= kept[1] and kept[3] <= kept[2] and kept[5] == kept[4]
    assert P.run(spark, sf).count() == kept[5]
