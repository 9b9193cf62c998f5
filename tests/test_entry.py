"""The entry module, with and without its removable part."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", ["nothing", "a folder", "broken"])
def test_without_the_removable_part(tmp_path, left):
    for name in ("strandmark", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    if left != "nothing":
        (tmp_path / "strandmark/llm/__pycache__").mkdir(parents=True)
    if left == "broken":
        (tmp_path / "strandmark/llm/queries.py").write_text("import no_such_library")
        (tmp_path / "corpus_pipeline.py").write_text("import no_such_library")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    n, has, sql = said.stdout.split()
    assert (has, n) == ("False", sql), said.stderr
