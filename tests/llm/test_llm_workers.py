"""Workers have no copy of the package: it is on the driver's path alone."""

import os
import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")


def elsewhere(batches):
    import importlib.util

    for batch in batches:
        assert importlib.util.find_spec("shelfstream") is None
        yield batch


frame = spark.range(1)
assert frame.mapInArrow(elsewhere, frame.schema).count() == 1
for name in {names!r}:
    print(name, entry.queries()[name](spark, {folder!r}).count())
print("done")
"""

NAMES = [
    "op1_ngram_jaccard", "op2_mixing", "op3_exact_dedup", "op4_lm_score", "op5_decontamination", "op6_url_filter",
    "op7_sharding", "op8_toxicity", "op9_pii", "op10_token_count", "op11_ranked_search", "op12_packing",
    "op13_resampling", "pipeline",
]


@pytest.mark.parametrize("names", [NAMES], ids=["all"])
def test_operators_run_where_the_package_is_not_installed(folder, tmp_path, names):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=str(ROOT), names=names, folder=folder))
    path = os.pathsep.join(
        p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not p.startswith(str(ROOT))
    )
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": path},
        capture_output=True, text=True, timeout=600,
    )
    assert done.returncode == 0 and done.stdout.strip().endswith("done"), done.stdout[-500:] + done.stderr[-3000:]
