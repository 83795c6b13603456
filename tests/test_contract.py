import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_text_package():
    for path in [*ROOT.glob("weftgraph/**/*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts or not path.exists():
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_registered_queries():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 100
    for n in ("p3_found", "p4_found", "p6_found"):
        assert n in sql


def test_core_queries_run_on_the_smallest_tables(spark):
    import __spark_entry__ as e

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        return
    assert e.entry(spark).count() > 0
    for name in ("a8_structure", "f12_batch_recall", "k23_nodes_left", "l3_diff", "p4_cascade"):
        assert e.queries()[name](spark, str(data)).columns
