import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(at: Path) -> set[str]:
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=at, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return set(said.stdout.split())


def test_entry_with_and_without_the_subpackage(tmp_path):
    (tmp_path / "textloom").mkdir()
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for p in (ROOT / "textloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (shutil.copytree if p.is_dir() else shutil.copy)(p, tmp_path / "textloom" / p.name)
    rest = names(tmp_path)
    assert "reason_counts" in rest and not any(n[:2] == "op" and n[2].isdigit() for n in rest)
    assert rest <= names(ROOT)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
