"""What frames in the shared folder cost beside their bytes."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import sys
from pyspark.sql import SparkSession
from batchplan.llm.spark_io import settled, written
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
rows = s.range(0, 1000, 1, 16)
conf = s.sparkContext._jsc.hadoopConfiguration()
assert [f(rows).agg({"id": "sum"}).first()[0] for f in (settled, written)] == [499500, 499500]
assert written(rows, 3).agg({"id": "sum"}).first()[0] == 499500
assert conf.get("fs.file.impl") is None and conf.get("fs.file.impl.disable.cache") is None
"""


def test_few_programs_are_started(tmp_path):
    """16 files of a checkpoint and of a table: chmod is not started for the first nor for checksum files, and a table of few rows has few files."""
    (tmp_path / "bin").mkdir()
    chmod = tmp_path / "bin/chmod"
    chmod.write_text(f'#!/bin/sh\necho "$*" >> {tmp_path}/said\nexec /bin/chmod "$@"\n')
    chmod.chmod(0o755)
    shared = tmp_path / "shared"
    env = os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}", "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}
    subprocess.run([sys.executable, "-c", RUN, str(shared)], env=env, check=True, timeout=120)
    said = (tmp_path / "said").read_text().splitlines()
    files = [x for x in said if "/part-" in x]
    assert not [x for x in files if "/table-" not in x or x.endswith(".crc")]
    assert len(files) <= 16 + 3
    assert sorted(len(list(t.glob("part-*"))) for t in shared.glob("table-*")) == [3, 16]
