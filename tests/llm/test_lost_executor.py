"""A cluster that loses an executor between two steps gives the same rows as one machine."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import json, os, signal, sys, time
import psutil
from pyspark.sql import SparkSession

place, name = sys.argv[1:]
spark = (SparkSession.builder.master("local-cluster[3,1,1024]").config("spark.executor.memory", "700m").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", place + "/shared").config("spark.sql.warehouse.dir", place + "/warehouse").getOrCreate())
from cairnstore.llm import common, quality_rules, simhash, suffix_dedup

def lose(module, at):
    inner, seen = module.staged, []
    def staged(df, name):
        out = inner(df, name)
        seen.append(name)
        if len(seen) == at:
            found = [p for p in psutil.process_iter(["cmdline"]) if "CoarseGrainedExecutorBackend" in " ".join(p.info["cmdline"] or []) and place in " ".join(p.info["cmdline"] or []) + str(p.cwd()) + str(p.environ())]
            print("LOST", len(found[:1]))
            for p in found[:1]:
                os.kill(p.pid, signal.SIGKILL)
            time.sleep(1)
        return out
    module.staged = staged

docs = spark.read.parquet(place + "/docs")
if name == "suffix":
    lose(suffix_dedup, 2)
    rows = suffix_dedup.digest(docs)
elif name == "rules":
    lose(quality_rules, 1)
    rows = quality_rules.filter_documents(docs)
else:
    lose(simhash, 1)
    rows = simhash.keep_first(docs)
print("ROWS", json.dumps(sorted(map(str, map(tuple, rows.select([c for c in rows.columns if c != "text"]).collect())))))
"""


@pytest.mark.parametrize("name", ["suffix", "rules", "copies"])
def test_same_rows_after_a_loss(spark, tmp_path, name):
    from cairnstore.llm import quality_rules, simhash, suffix_dedup
    from cairnstore.llm.common import documents

    documents(spark, "/root/testdata/sf0.001").repartition(24).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    make = {"suffix": suffix_dedup.digest, "rules": quality_rules.filter_documents, "copies": simhash.keep_first}[name]
    rows = make(docs)
    want = sorted(map(str, map(tuple, rows.select([c for c in rows.columns if c != "text"]).collect())))
    (tmp_path / "run.py").write_text(SCRIPT)
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run(["timeout", "200", sys.executable, str(tmp_path / "run.py"), str(tmp_path), name], env=env, capture_output=True, text=True, cwd=tmp_path)
    assert "LOST 1" in done.stdout, done.stderr[-2000:]
    (found,) = [line for line in done.stdout.splitlines() if line.startswith("ROWS ")]
    assert json.loads(found[5:]) == want
