"""The step that parses files: what is asked for, in child processes, once a query."""

import os

import pytest

from spanloom.operators import parse
from spanloom.plans import catalog

SF = "/root/testdata/sf0.001"
SOURCE = 'import a.b\nfrom c import d as e\n\n\n@app.get("/x")\ndef f(x):\n    """Text."""\n    if x:\n        import g\n    return e(a.b.h(x))\n\n\nclass K(BaseModel):\n    n: int = f(1)\n\n    def m(self):\n        return self.m()\n\n\napp.include_router(r, prefix="/v1")\n'


@pytest.mark.parametrize("only", [{"call"}, {"span:class", "class"}, {"binding", "span:module"}, {"route", "prefix"}, {"span"}])
def test_asked_facts_are_those_of_all(only):
    rows = parse.file_facts("p/q.py", "p.q", SOURCE)
    asked = [r for r in rows if r[2] in only or f"{r[2]}:{r[3]}" in only]
    assert asked and parse.file_facts("p/q.py", "p.q", SOURCE, only) == asked
    assert parse.file_facts("p/q.py", "p.q", SOURCE, only, False) == [(*r[:10], None, r[11]) for r in asked]


@pytest.mark.parametrize("name", ["p_call_edges", "p_import_edges", "p_routes", "p_entities"])
def test_files_are_parsed_once(spark, name):
    # A stage of Python in the plan of the result is a parse for each of its readings.
    assert "MapIn" not in catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()


def test_names_leave_with_a_child(monkeypatch):
    files = [(f"p{i}.py", f"p{i}", f"import x{i}\n") for i in range(3)]
    got = [tuple(r.values()) for b in parse._apart(files, None, True) for r in b.to_pylist()]
    assert got == [r for f in files for r in parse.file_facts(*f)]
    monkeypatch.setattr(parse, "file_facts", lambda *a: [(str(os.getpid()), *[None] * 7, 1, 1, None, None)])
    pids = {r["path"] for _ in range(2) for b in parse._apart(files, None, True) for r in b.to_pylist()}
    assert len(pids) == 2 and str(os.getpid()) not in pids


def test_errors_of_a_child_are_raised(monkeypatch):
    def broken(*a):
        raise KeyError("lost")

    monkeypatch.setattr(parse, "file_facts", broken)
    with pytest.raises(RuntimeError, match="lost"):
        list(parse._apart([("p.py", "p", "")], None, True))
