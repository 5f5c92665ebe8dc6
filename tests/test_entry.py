import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    if DATA.exists():
        rows = e.entry(spark).collect()
        assert rows and {"query_id", "id", "distance", "score", "rank"} == set(rows[0].asDict())


def test_the_rest_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "quern"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith("py") else None
    (tmp_path / "quern").mkdir()
    for p in (ROOT / "quern").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quern" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_search' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); print(e.__file__)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
