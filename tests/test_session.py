"""The Python workers find the library wherever a job is started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from stockloom.session import build_session
from stockloom.functions import text
spark = build_session("elsewhere", "local[2]", shuffle_partitions=2, **{{"spark.ui.enabled": "false"}})
print("ROWS", e.queries()["model_scores"](spark, "/root/testdata/sf0.001").count())
from stockloom.operators import news
def scorer():
    from stockloom.functions import numbers
    return lambda titles: [("positive", 0.5)] * len(titles)
rows = news.model_sentiment(spark.createDataFrame([("a",), ("b",)], "title string"), scorer).collect()
print("SCORES", sorted(r.sentiment_score for r in rows))
"""


def test_a_job_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SCORES [0.5, 0.5]" in done.stdout and "ROWS" in done.stdout, done.stderr[-2000:]
