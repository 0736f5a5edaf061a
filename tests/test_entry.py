import os
import subprocess
import sys

import __spark_entry__
from icekeel import job_queries as queries

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["partition_dir", "n_files", "bytes_before"] and df.count() >= 0


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.ORACLE) == set(queries.QUERIES)


def test_without_the_subpackage(tmp_path):
    """What is left imports and lists its queries when the subpackage and the pipeline are gone."""
    for name in ("__spark_entry__.py", "icekeel"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/icekeel/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'candidates' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
