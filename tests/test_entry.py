import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 10 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_package(tmp_path):
    for p in ("cairn", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    for p in (tmp_path / "cairn/llm").rglob("*.py") if (tmp_path / "cairn/llm").exists() else ():
        p.unlink()  # empty folders may stay behind
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op') or k == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith(" []") and int(out.stdout.split()[0]) > 80, out.stderr
