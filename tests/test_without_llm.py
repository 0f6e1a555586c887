"""The package and the driver's entry work in a copy that has neither the subpackage ``llm`` nor the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def _copy(to: Path, pipeline: bool) -> Path:
    shutil.copytree(REPO / "corpusmill", to / "corpusmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", to)
    if pipeline and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", to)
    return to


def _run(at: Path) -> str:
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') or n == 'pipeline' for n in q))"
    return subprocess.run([sys.executable, "-c", code], cwd=at, check=True, capture_output=True, text=True).stdout.strip()


def test_queries_without_the_subpackage(tmp_path):
    from corpusmill.plans.registry import ORACLES, QUERIES

    for name, pipeline in (("a", True), ("b", False)):
        (tmp_path / name).mkdir()
        assert _run(_copy(tmp_path / name, pipeline)) == f"{len(QUERIES)} {len(ORACLES)} False"
