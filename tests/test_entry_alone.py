"""The library answers without the training-data folder, and where something that folder needs isn't installed."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import warnings
warnings.simplefilter("always")
import __spark_entry__ as e
with warnings.catch_warnings(record=True) as w:
    q, o = e.queries(), e.oracle_sql()
assert len(q) > 160 and set(o) <= set(q) and "pipeline" not in q and not any(k.startswith("op") and k[2].isdigit() for k in q)
assert any("training-data" in str(x.message) for x in w)
"""


def _run(folder):
    subprocess.run([sys.executable, "-c", CODE], cwd=folder, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(folder)})


def test_without_the_folder(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/gapmeter", tmp_path / "gapmeter", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    _run(tmp_path)


def test_without_a_package_that_the_folder_needs(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/gapmeter", tmp_path / "gapmeter", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import a_package_that_is_not_installed\n")
    _run(tmp_path)
