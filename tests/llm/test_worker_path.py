"""Workers need no copy of the package: every query runs from another folder."""

import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from limnos import get_session
spark = get_session(cpus=4, extra={{"spark.driver.memory": "4g"}})
def there(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("limnos") is not None] * b.num_rows)], ["x"])
assert not any(r.x for r in spark.range(4).mapInArrow(there, "x boolean").collect())
for name, query in E.queries().items():
    if name.startswith("op") or name == "knn_classify":
        query(spark, {sf!r}).write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


def test_queries_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, sf=SF_SMALL)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran op") == 13
