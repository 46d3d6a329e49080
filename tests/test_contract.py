import ast
from pathlib import Path

import __spark_entry__ as contract

ROOT = Path(__file__).parents[1]


def test_entry_and_names(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_nothing_else_imports_llm():
    for p in (ROOT / "kinfold").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        nodes = list(ast.walk(ast.parse(p.read_text())))
        names = [n.module or "" for n in nodes if isinstance(n, ast.ImportFrom)] + [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names]
        assert not [n for n in names if n.startswith("kinfold.llm")], p
