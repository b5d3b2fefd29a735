import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stands_without_the_training_data_operators(tmp_path):
    for d in ("loomline",):
        shutil.copytree(f"{ROOT}/{d}", tmp_path / d, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'thread_summary' in q and 'pipeline' not in q and set(q) == set(e.oracle_sql()); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0 and int(done.stdout) >= 50, done.stderr


def test_nothing_outside_imports_them():
    for folder, _, names in os.walk(f"{ROOT}/loomline"):
        if "llm" not in folder.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, name), encoding="utf-8").read())
