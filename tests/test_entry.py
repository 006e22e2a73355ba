"""The registry without the corpus package, and the shared folder."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from framewright.functions.shared import shared_folder

ROOT = str(Path(__file__).resolve().parent.parent)


def test_the_rest_works_without_the_corpus_package():
    code = "import sys; sys.modules['framewright.llm'] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.splitlines()
    names, oracles = (set(x.split()) for x in said)
    assert oracles == names and "prj1_yuv422" in names and not names & {"pipeline", "op1_chat"}


def session(master, checkpoint=None):
    conf = SimpleNamespace(get=lambda key, default=None: checkpoint if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_a_cluster_needs_a_shared_folder():
    assert shared_folder(session("spark://host:7077", "hdfs://x/shared/"), "t").startswith("hdfs://x/shared/t-")
    assert shared_folder(session("local[4]"), "t").startswith("file:///")
    for master in ("local-cluster[3,2,1000]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master), "t")
