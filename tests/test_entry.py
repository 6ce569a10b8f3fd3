"""The driver contract: queries, their SQL twins, and a library that stands alone."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
import tempfile

import pytest

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_every_twin_belongs_to_a_query():
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and len(twins) >= 45


@pytest.mark.parametrize("case", ["folder and pipeline gone", "folder gone", "a package is missing"])
def test_library_works_without_the_optional_parts(case):
    """Without the training-data folders, with or without the pipeline module,
    or without a package that only they need, the rest still imports,
    registers and runs."""
    copy = tempfile.mkdtemp(prefix="parley-alone-")
    gone = ("__pycache__",) if case == "a package is missing" else ("llm", "__pycache__")
    shutil.copytree(f"{ROOT}/parley", f"{copy}/parley", ignore=shutil.ignore_patterns(*gone))
    shutil.copy(f"{ROOT}/__spark_entry__.py", copy)
    if case != "folder and pipeline gone":
        shutil.copy(f"{ROOT}/corpus_pipeline.py", copy)
    code = "import sys; hidden = sys.argv[1:]; sys.modules.update(dict.fromkeys(hidden)); import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n[:2] == 'op' or n == 'pipeline'], len(e.oracle_sql()))"
    if case == "folder gone":
        code += "; from parley.session import build_session; print(q['classification_metrics'](build_session('local[2]', shuffle_partitions=2), '/root/testdata/sf0.001').count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    hidden = ["xxhash"] if case == "a package is missing" else []
    out = subprocess.run([sys.executable, "-c", code, *hidden], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 55 and out[1] == "[]"
    if case == "folder gone":
        assert int(out[3]) > 0


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from parley import session

    class Elsewhere:
        sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None)})()
        conf = type("K", (), {"get": staticmethod(lambda k, d=None: "spark://host:7077" if k == "spark.master" else d)})()

    with pytest.raises(ValueError):
        session.checkpoint_root(Elsewhere())
