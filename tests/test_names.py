"""Names of the query modules: a query reads its module's texts when it runs, so none may be bound again further down."""

import ast
import pathlib
from collections import Counter

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1] / "halyard"


def bound(path):
    """Names that statements of the module itself define or assign, each as often as it is bound."""
    for node in ast.parse(path.read_text()).body:
        if isinstance(node, ast.FunctionDef | ast.ClassDef):
            yield node.name
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                yield from (n.id for n in ast.walk(target) if isinstance(n, ast.Name))


@pytest.mark.parametrize("module", ["queries.py", "more_queries.py", "llm/queries.py"])
def test_names_are_bound_once(module):
    assert [n for n, times in Counter(bound(ROOT / module)).items() if times > 1] == []
