"""Tables in the shared folder: gone with their workspace, or with the driver."""

import os
import subprocess
import sys
import threading

from partloom import storage

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = """
import os, sys
from pyspark.sql import SparkSession
from partloom.plans.queries import QUERIES
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
for name in sys.argv[3:]:
    assert QUERIES[name](spark, sys.argv[2]).count() > 0
print("tables", len(os.listdir(sys.argv[1] + "/partloom")))
"""


def tables(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_queries_leave_nothing(sf, tmp_path):
    run = subprocess.run([sys.executable, "-c", JOB, str(tmp_path), sf, "natural_sort", "serialize_inventory", "csv_file_scan", "archive_sheets"], cwd=HERE, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout.split("tables", 1)[1]) >= 4
    assert tables(tmp_path / "partloom") == []


def test_discarded_before(spark):
    df = storage.save(spark.range(3), "one")
    path = df._partloom_path.removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    storage.discard(df)
    assert not os.path.isdir(path)


def test_workspaces_of_threads(spark):
    """Each thread writes into its own, and keeps what it keeps."""
    both, paths, failed = threading.Barrier(2), {}, []

    def work(n):
        try:
            with storage.workspace(spark):
                inner = storage.save(spark.range(n), "inner")
                both.wait(60)
                assert inner.count() == n
                outer = storage.kept(spark.range(n + 1), "outer")
            paths[n] = inner._partloom_path, outer
            both.wait(60)
        except Exception as e:  # a thread's failure is the test's
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in (5, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not failed
    assert os.path.dirname(paths[5][0]) != os.path.dirname(paths[7][0])
    for n, (inner, outer) in paths.items():
        assert not os.path.isdir(inner.removeprefix("file://")) and outer.count() == n + 1


def test_kept_without_a_workspace(spark):
    assert storage.kept(spark.range(2), "two").count() == 2
