import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_llm():
    for p in (ROOT / "casegrain").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("casegrain.llm") for n in names), p


def test_queries_and_sql_fit():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40
