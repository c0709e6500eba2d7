import ast
from pathlib import Path

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["zbin", "p1", "p2", "value", "pairs"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_definition_hides_another():
    root = Path(__file__).parents[1]
    for path in [*root.glob("*.py"), *root.glob("skyloom/**/*.py"), *root.glob("tests/**/*.py")]:
        tree = ast.parse(path.read_text())
        for scope in [tree, *(x for x in ast.walk(tree) if isinstance(x, ast.ClassDef))]:
            own = [x.name for x in scope.body if isinstance(x, (ast.FunctionDef, ast.ClassDef)) and not x.decorator_list]
            assert len(own) == len(set(own)), path
