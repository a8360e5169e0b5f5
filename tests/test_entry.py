"""The driver's contract without the document operators' folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and "sample_metrics" in q and "pipeline" not in q and not any(k.startswith("op") and "_" in k and k[2:].split("_")[0].isdigit() for k in q), sorted(q)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.entry(spark).count())
"""


@pytest.mark.parametrize("pipeline_stays", [False, True])
def test_works_without_llm(tmp_path, pipeline_stays):
    gone = shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline_stays else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "r", ignore=gone)
    said = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "r", capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    assert int(said.stdout.split("rows")[-1]) > 0


def test_with_llm_everything_is_registered():
    import __spark_entry__ as e

    if (ROOT / "gradeframe" / "llm").is_dir():
        assert "pipeline" in e.queries() and sum(k.startswith("op") and k[2].isdigit() for k in e.queries()) >= 10
