"""The core stands by itself: a copy without the operators for training data imports, registers its queries and runs its tests."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OPTIONAL = ("tableferry/llm", "tests/llm", "corpus_pipeline.py")


def test_a_copy_without_the_optional_parts(tmp_path):
    copy = tmp_path / "copy"
    gone = {os.path.join(ROOT, p) for p in OPTIONAL}

    def left_out(folder, names):
        return [n for n in names if os.path.join(folder, n) in gone or n in (".git", "__pycache__", ".pytest_cache", ".hypothesis")]

    shutil.copytree(ROOT, copy, ignore=left_out)
    assert not any((copy / p).exists() for p in OPTIONAL)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as e; q = e.queries(); print('optional', sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), len(q) > 130, set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert "optional 0 True True" in said.stdout, said.stderr[-2000:]
    # All tests are collected; those that need no long run are run.
    every = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert every.returncode == 0 and "error" not in every.stdout.lower().splitlines()[-1], every.stdout[-2000:]
    some = subprocess.run([sys.executable, "-m", "pytest", "tests/test_infer.py", "-q", "-x", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True, timeout=600)
    assert some.returncode == 0, some.stdout[-2000:]
