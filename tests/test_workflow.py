"""The batch jobs over a small CSV corpus."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest

from tidewatch.plans import workflow as J
from tidewatch.sources import store


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rng = random.Random(0)
    levels = {"BenignTraffic": 0, "DDoS-SYN_Flood": 4, "XSS": 8}
    for label, level in levels.items():
        for part in ("", "1"):
            lines = ["rate,size,copy,flat"]
            for _ in range(120):
                rate = round(level + rng.random() * 2, 4)
                lines.append(f"{rate},{round(rng.random() + level / 8, 4)},{rate * 2},1")
            lines[5] = lines[4]
            (root / f"{label}{part}.pcap.csv").write_text("\n".join(lines) + "\n")
    return str(root)


SETTINGS = J.Settings(
    target=700, per_class_cap=230, block_size=16, test_fraction=0.25, n_features=2, trees=5,
    window=3, n_clients=2, rounds=2, local_epochs=2, seeds=(0, 1),
)


def test_characterise(spark, corpus, tmp_path):
    table = J.characterise(spark, corpus, str(tmp_path / "profile"), "r1")
    assert table.where("stat = 'n_rows'").first()["value"] == "720"


def test_prepare_and_compare(spark, corpus, tmp_path):
    table = J.prepare(spark, corpus, str(tmp_path / "prepared"), SETTINGS)
    names = lambda condition: [r["feature"] for r in table.where(condition).orderBy("place").collect()]
    assert names("NOT candidate") == ["flat", "source_file", "block_id"]
    assert len(names("candidate AND NOT kept")) == 1 and len(names("selected")) == 2
    rows, features, scaled = store.read_prepared(spark, str(tmp_path / "prepared"))
    assert sorted(features) == sorted(names("selected")) and not scaled
    assert rows.select("block_id", "side").distinct().count() == (
        rows.select("block_id").distinct().count())
    out = str(tmp_path / "out")
    verdict = J.compare_federated(spark, str(tmp_path / "prepared"), out, "r1", SETTINGS).first()
    assert 0 <= verdict["low"] <= 1 and verdict["up"] > 0.1 and verdict["fed"] > 0.1
    metrics = store.read_table(spark, f"{out}/metrics", store.METRICS_SCHEMA)
    assert metrics.where("class IS NULL").count() == 2 * 3 * len(J.METRICS)
    table, metadata = store.load_parameters(spark, f"{out}/models/r1", 1)
    assert table.count() == (3 * 2 + 1) * 8 and store.sequence_count(metadata) > 0


def test_a_local_session_needs_no_checkpoint_folder(tmp_path):
    """In a process of its own, as this one's session has the folder set by the machine."""
    script = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from tidewatch.session import cut_lineage, release, shared_folder
table = cut_lineage(spark, spark.range(9), "nine")
assert table.count() == 9 and os.path.isdir(table.written_to) and shared_folder(spark) == shared_folder(spark)
release(table)
assert not os.path.exists(table.written_to)
"""
    (tmp_path / "conf").mkdir()
    own = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env = own | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
