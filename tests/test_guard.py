"""The entry module without the optional parts, and independence of the library from them."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_entry_without_optional_parts(tmp_path):
    for p in ROOT.iterdir():
        if p.name in ("__spark_entry__.py", "leafmill"):
            (tmp_path / p.name).symlink_to(p) if p.is_file() else (tmp_path / p.name).mkdir()
    for p in (ROOT / "leafmill").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "leafmill" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 100 and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "leafmill").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"leafmill\.llm|corpus_pipeline", p.read_text()), p
