"""The driver's contract holds without the subpackage llm and the pipeline."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_entry_without_llm(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "skein", tmp_path / "skein", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for pipeline in (False, True):  # with llm gone, a pipeline left behind is left out
        if pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'rerank_topk' in q and 'pipeline' not in q and set(o) <= set(q)"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_every_oracle_has_its_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
