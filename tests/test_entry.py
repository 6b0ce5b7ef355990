"""The entry points, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in q))"


def test_core_queries_survive_without_the_optional_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    assert not (copy / "samplewright" / "llm").exists() and not (copy / "tests" / "llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda: subprocess.run([sys.executable, "-c", SHOW], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    done = run()
    assert done.returncode == 0, done.stderr
    n, oracles, optional = done.stdout.split()
    assert int(n) >= 56 and int(oracles) >= 50 and optional == "False"
    (copy / "samplewright" / "llm").mkdir()
    assert run().stdout == done.stdout


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
