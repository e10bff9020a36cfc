import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
MODULES = sorted(".".join(p.relative_to(ROOT).with_suffix("").parts).removesuffix(".__init__")
                 for p in (ROOT / "failcast").rglob("*.py") if "llm" not in p.parts)


def fresh(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("module", MODULES)
def test_module_imports_in_a_fresh_process(module):
    got = fresh(f"import {module}")
    assert got.returncode == 0, got.stderr


def test_oracles_before_queries():
    got = fresh("import __spark_entry__ as e; assert e.oracle_sql(); assert e.queries()")
    assert got.returncode == 0, got.stderr
