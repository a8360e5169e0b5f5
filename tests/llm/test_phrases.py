"""Phrase mining against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import phrases

SCHEMA = "doc_id long, lang string, text string"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(SMALL)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {c: a for c, a in f.items() if a >= least and len(c[1]) > 1}
    longer = collections.Counter()
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in often.items():
        if longer[lang, w] < a:
            score, _, left, right = min((phrases.SCALE * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def rows_of(seed):
    r = random.Random(seed)
    words = ["New", "york", "City", "of", "the", "a\x00b", "Été", "été", "x-y", " ", "\x1c", "\U0001f600"]
    odd = [None, "", " \t ", "...", "new york", "new york\x0bcity", "new york,city", "NEW\tYORK  city", "İstanbul " * 9, "of the " * 50, "end."]
    out = [(i, r.choice(["en", "de", None, "und", ""]), r.choice(odd) if r.random() < 0.2 else " ".join(r.choice(words[: r.randint(2, 12)]) + r.choice(["", "", "", ".", ";"]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    return out + [(0, "en", "new york city hall")] * 7 + [(None, "en", "new york city hall " * 3)]


@pytest.mark.parametrize("least, longest, small", [(6, 5, False), (12, 5, True), (300, 3, False), (4, 2, False)])
def test_phrases(spark, monkeypatch, least, longest, small):
    if small:  # a few words at a time, many blocks of keys, several readings, words forgotten
        for name, value in {"PART": 200, "WORDS": 20, "SEEN": 30, "BLOCK_KEYS": 100, "ROUND_KEYS": 200, "CELLS": (6, 6), "PIECE": 16, "RANKED": 10}.items():
            monkeypatch.setattr(phrases, name, value)
    rows = rows_of(least)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("phrase", "a", "n", "k", "h1", "block", "rank", "score"):
        df = df.withColumn(c, F.lit("x"))
    want = brute(rows, least, longest, 25)
    assert sorted(map(tuple, phrases.mine(df, least, longest, 25).collect())) == want
    assert bool(want) == (least < 300)


def test_no_texts(spark):
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.mine(spark.createDataFrame([(1, None, None), (2, "en", "")], SCHEMA), 1).count() == 0


def test_long_texts(monkeypatch):
    """Parts of a text are cut between pieces only; a piece without an end stays whole."""
    monkeypatch.setattr(phrases, "PART", 50)
    r = random.Random(2)
    text = " ".join("w%d%s" % (r.randint(0, 9), r.choice(["", "", "", "!"])) for _ in range(400)).encode() + b" " + b"z" * 500 + b". end " * 3
    split = lambda t: [p.split() for p in t.translate(phrases.small_letters()).split(b".") if p.split()]
    got = list(phrases.pieces(text))
    assert [p for t in got for p in split(t)] == split(text) and len(got) > 20


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 200_000])
def test_perfect_hash(n):
    r = np.random.default_rng(n)
    h1, h2 = (r.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    h1[n // 2 :] = h1[: n - n // 2]  # equal in one half of the key only
    got = phrases.PerfectHash.load(phrases.PerfectHash.build(h1, h2).dump())
    assert sorted(got.find(h1, h2).tolist()) == list(range(n))
    assert (got.find(h1, h2 ^ np.uint64(1)) == -1).all() and (got.find(h1 + np.uint64(1), h2) == -1).all()
    assert len(got.dump()) <= 17.5 * n + 400 + 16 * len(got.sizes)
    with pytest.raises(ValueError):
        phrases.PerfectHash.build(np.ones(2, np.uint64), np.ones(2, np.uint64))


def test_blocks_of_keys(spark):
    """The block of a key is the same in Spark and in numpy, for negative hashes too."""
    h = np.array([0, 1, -1, -(2**63), 2**63 - 1, 12345, -98765], dtype=np.int64)
    for blocks in (1, 3, 7, 1000):
        got = spark.createDataFrame([(int(x),) for x in h], "h1 long").select(phrases.block_of("h1", blocks)).toPandas().iloc[:, 0].to_numpy()
        assert (got == (h.view(np.uint64) % np.uint64(blocks)).astype(int)).all()


def test_cells_keep_what_is_frequent(spark):
    """No frequent pair or triple is ruled out, whatever shares its cell, and most others are."""
    rows = rows_of(7)
    docs = spark.createDataFrame(rows, SCHEMA).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary")).repartition(4)
    ruled = {}
    for level in (2, 3):
        ruled[level] = phrases.rule_out(docs, level, ruled, 1 << 16, 40)
    whole = next(phrases.parts(iter([pa.RecordBatch.from_arrays([pa.array(["und" if r[1] is None else r[1] for r in rows]), pa.array([(r[2] or "").encode() for r in rows])], names=["lang", "text"])])))
    for level in (2, 3):
        *_, (_, _, h, g) = phrases.grams(whole, {k: v for k, v in ruled.items() if k < level}, level)
        n = collections.Counter(h.tolist())
        may = dict(zip(h.tolist(), ruled[level].may_be(h, g).tolist()))
        assert all(may[x] for x, c in n.items() if c >= 40) and any(c >= 40 for c in n.values())
        assert sum(may.values()) <= sum(c >= 40 for c in n.values()) + 5
