"""The engine without the training-data subpackage, or without what that needs."""

import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

RUN = """
import warnings; warnings.simplefilter("ignore")
{before}
import __spark_entry__ as entry
names = set(entry.queries())
assert len(names) >= 52 and set(entry.oracle_sql()) <= names, len(names)
assert not any(name == "pipeline" or name.startswith("op") for name in names), names
{after}
"""
ENTRY = """
from wardline.session import local_session
spark = local_session("copy", cores=2)
assert entry.entry(spark).count() == 8
spark.stop()
"""


def run(folder, before="", after=""):
    return subprocess.run([sys.executable, "-c", RUN.format(before=before, after=after)], cwd=folder, capture_output=True, text=True,
                          timeout=300)


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_and_runs_without_the_folders(tmp_path, pipeline):
    shutil.copytree(ROOT / "wardline", tmp_path / "wardline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    done = run(tmp_path, after=ENTRY if pipeline else "")
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("missing", ["tokenizers", "xxhash", "public_tokenizers"])
def test_registers_the_rest_where_a_wheel_is_missing(missing):
    done = run(ROOT, before=f"import sys; sys.modules[{missing!r}] = None")
    assert done.returncode == 0, done.stderr
