"""Placed lines, exactly-once appends and the summary of a stream that takes rows back."""

import json
import os
import random

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from gradeframe.operators.scoring import summarise
from gradeframe.plans.evaluate import samples
from gradeframe.sources import lines as L
from gradeframe.sources.append import AppendLog
from gradeframe.sources.jsonl import read_lines, read_manifest, read_predictions
from gradeframe.streaming.log import changes_log, read_log_stream, start, stream_summary, summary_of_changes

TEXTS = [b"", b"\n", b"one", b"one\n", b"\n\n a \n\n", b"a\r\nb\rc\n\rd", "é\n\U0001f600x\n".encode() * 9, b"x" * 70 + b"\n" + b"y\n" * 30 + b"z" * 55]


@pytest.mark.parametrize("text", TEXTS)
def test_ranges_cover_each_line_once(tmp_path, monkeypatch, text):
    monkeypatch.setattr(L, "CHUNK", 16)
    file = str(tmp_path / "f")
    with open(file, "wb") as f:
        f.write(text)
    fs = pafs.LocalFileSystem()
    want = [(at, line) for at, line in L.read_range(fs, L.Range(file, 0, len(text)))]
    plain = text.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    assert [line for _, line in want if line] == [p for p in plain if p]
    assert all(text[at : at + len(line)] == line for at, line in want)
    for split in (1, 2, 3, 7, 40):
        got = [x for part in L.ranges({file: (0, len(text))}, split) for x in L.read_range(fs, part)]
        assert got == [x for x in want if x[0] < len(text)]
    assert L.last_end(fs, file, 0, len(text)) == text.rfind(b"\n") + 1


def row(i, raw, error=None):
    return json.dumps({"id": i, "raw": raw, "n_tokens": 1, "seconds": 1.0, "gen_error": error})


def test_batch_reads_by_splits(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join([row(f"i{n % 7}", str(n)) for n in range(100)]) + "\n\t\n")
    assert read_lines(spark, str(tmp_path), 100).count() == 100
    assert [json.loads(r.value)["raw"] for r in read_lines(spark, str(tmp_path), 333).orderBy("ord").collect()] == [str(n) for n in range(100)]
    last = read_predictions(spark, str(tmp_path / "log.jsonl")).groupBy("id").agg(F.max_by("raw", "ord").alias("raw")).collect()
    assert {r.id: int(r.raw) for r in last} == {f"i{n % 7}": n for n in range(93, 100)}


def test_growing_file(spark, tmp_path):
    """No seq column, one file, small splits: the last line wins, also of later appends; half a line waits for its end."""
    log, seen = tmp_path / "log.jsonl", {}

    def handle(df, epoch):
        seen.update({r.id: r.raw for r in df.collect()})

    run = lambda: start(read_log_stream(spark, str(log), 150), str(tmp_path / "state"), handle).awaitTermination(120)
    half = row("b", "late")
    log.write_text("\n".join(row("a" if n % 3 else "b", str(n)) for n in range(40)) + "\n \t\n" + half[:20])
    run()
    assert seen == {"a": "38", "b": "39"}
    seen.clear()
    with open(log, "a") as f:
        f.write(half[20:] + "\n" + row("c", "new") + "\n")
    run()
    assert seen == {"b": "late", "c": "new"}


def test_append_log(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "log"), "id string, raw string, gen_error string")
    work = spark.createDataFrame([(f"i{n}",) for n in range(30)], "id string")
    done = []

    def step(rows):
        done.extend(r.id for r in rows.collect())
        error = F.when(F.col("id").isin("i3", "i4"), F.lit("E")) if len(done) <= 30 else F.lit(None).cast("string")
        return rows.select("id", F.lit("x").alias("raw"), error.alias("gen_error"))

    write, calls = log.append, []

    def dies(rows, batch):
        calls.append(batch)
        if len(calls) == 3:
            rows.write.mode("overwrite").parquet(f"{log.path}/append_batch={batch}")  # all is written but the mark
            raise OSError("killed")
        write(rows, batch)

    log.append = dies
    with pytest.raises(OSError):
        log.run(work, step, parts=4)
    assert log.batches() == [0, 1] and 0 < log.read().count() < 30
    log.append = write
    log.run(work, step, parts=2)
    ids = sorted(r.id for r in log.read().collect())
    assert set(ids) == {f"i{n}" for n in range(30)}
    assert all(ids.count(i) == 1 for i in ids if i not in ("i3", "i4"))
    log.run(work, step)
    last = log.read().groupBy("id").agg(F.max_by("gen_error", "ord").alias("e"), F.count("*").alias("n")).collect()
    assert len(last) == 30 and all(r.e is None for r in last)
    before = log.read().count()
    log.run(work, step)
    assert log.read().count() == before


CHART = lambda v, kind="bar": {"chart_type": kind, "title": "T", "x_label": None, "y_label": None, "series": [{"name": "s", "data": [{"x": "a", "y": v}, {"x": "b", "y": 2.0}]}]}


def test_streamed_summary_is_that_of_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(6)
    gold = [json.dumps({"id": f"c{n}", "gold": CHART(1.0 + n, "bar" if n % 2 else "line")}) for n in range(8)]
    (tmp_path / "gold.jsonl").write_text("\n".join(gold))
    manifest = read_manifest(spark, str(tmp_path / "gold.jsonl"))
    log = tmp_path / "log.jsonl"
    into = changes_log(spark, str(tmp_path / "changes"), manifest)
    for _ in range(3):
        with open(log, "a") as f:
            for _ in range(9):
                n = r.randint(0, 9)  # two ids have no gold
                answer = r.choice([json.dumps(CHART((1.0 + n) * r.choice([1, 1.03, 1000]), "line")), "no chart", "```json\n" + json.dumps(CHART(5.0)) + "\n```"])
                f.write(row(f"c{n}", answer, r.choice([None, None, "OOM"])) + "\n")
        stream_summary(manifest, read_log_stream(spark, str(log), 200), into, str(tmp_path / "state")).awaitTermination(240)
    want = {(x.level, x.key): x.asDict() for x in summarise(samples(manifest, read_predictions(spark, str(log)))).collect()}
    got = {(x.level, x.key): x.asDict() for x in summary_of_changes(into).collect()}
    assert set(got) == set(want) and ("overall", "all") in got
    for k, own in want.items():
        assert all(got[k][c] == (pytest.approx(v) if isinstance(v, float) else v) for c, v in own.items()), k
    assert into.read().filter("sign = -1").count() > 0 and os.path.isdir(tmp_path / "changes/ledger")
