"""Workers must not depend on the package being installed or on the working folder."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from __spark_entry__ import queries
from aircapture.session import get_session
spark = get_session(master="local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}})
from pyspark.sql import functions as F
from aircapture.functions.frame import content_hash
from aircapture.plans import relations as R
from aircapture.operators import flows as W
sf = {sf!r}
n = queries()["w2_assign_flows"](spark, sf).count()
told = W.assign_flows(W.flow_input(R.enriched(spark, sf)), hot_min_rows=50)
assert told.count() == n > 0
assert queries()["t2_stream_collapse"](spark, sf).count() > 0
assert R.packets(spark, sf).select(content_hash(F.col("phyPayload"), exact=True).alias("h")).where("h is null").count() == 0
print("SHIPPED", n)
"""


def test_queries_run_from_any_folder(tmp_path, sf_dir):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=repo, sf=sf_dir))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SHIPPED" in done.stdout, done.stderr[-3000:]
