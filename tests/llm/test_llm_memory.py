"""What Python workers hold between tasks."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import langid

# A task that takes 200 MB in small pieces; the last stays, so that the C library can't cut the heap at its end.
TASK = """
import pyarrow as pa
from tidewatch.llm.common import by_batch

def held():
    return [int(line.split()[1]) // 1024 for line in open("/proc/self/status") if line.startswith("VmRSS")][0]

stays = []
def make():
    def step(batch):
        pieces = [b"x" * (1000 + i % 7) for i in range(200_000)]
        stays.append(pieces.pop())
        return batch
    return step

run = by_batch(make)
before = held()
list(run(iter([pa.RecordBatch.from_pydict({"a": [1]})])))
print(held() - before)
"""


def test_a_task_returns_its_free_memory():
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", TASK], cwd=root, capture_output=True, text=True, check=True)
    assert int(done.stdout) < 60


def test_training_starts_no_python_worker(spark, monkeypatch):
    """The labels' bounds reach Spark as Arrow; from a list, a second set of workers would come up in each executor and stay."""
    given, make = [], type(spark).createDataFrame
    docs = spark.createDataFrame([(i, ("aaa bbb " if i % 2 else "xxx yyy ") * 4, "ab"[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: given.append(data) or make(self, data, *a, **b))
    model = langid.train(docs, steps=60)
    assert model.languages == ["a", "b"] and all(isinstance(d, pa.Table) for d in given)
    found = langid.predict(docs.filter(F.col("text").isNotNull()), model).collect()
    assert len(found) == 20
