"""Extractors on a small shop: what they must find, and what they must not."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import identity
from spanloom.operators import extract, parse, sinks

FILES = {
    "shop/__init__.py": "from .models import Item, Basket as Bag\nfrom .util import LIMIT, price\nfrom outside import Tool\nfrom . import util\n\n__all__ = ['Item', 'Bag', 'LIMIT', 'price', 'Tool', 'util', 'nothing', 'home']\n\n\ndef home(a, *, b: int = 1) -> str:\n    return str(a)\n",
    "shop/util.py": "import requests\n\nLIMIT = 3\n\n\ndef price(x):\n    return fetch(x)\n\n\ndef fetch(x):\n    return requests.get(x)\n\n\ndef _hidden():\n    def inner():\n        return price(1)\n    return inner\n\n\nprice(2)\n",
    "shop/models.py": "from dataclasses import dataclass\nfrom pydantic import BaseModel, field_validator\n\n\nclass Item(BaseModel):\n    name: str\n    note: str | None = None\n    __secret__: int = 1\n\n    @field_validator('name', mode='before')\n    def tidy(cls, v):\n        return v\n\n\n@dataclass\nclass Basket:\n    items: list[Item]\n\n    def total(self):\n        return self.add()\n\n    def add(self):\n        return 1\n\n\nclass Row(Base):\n    __tablename__ = 'rows'\n    id: Mapped[int] = mapped_column(primary_key=True)\n    size = Column(Integer)\n    basket = relationship('Basket')\n    plain = 3\n\n\nclass Plain:\n    x: int\n",
    "shop/web.py": "from fastapi import APIRouter\nimport shop.util as u\nimport shop.models\nfrom shop import util\nfrom .models import Item\n\nrouter = APIRouter(prefix='/v1')\nother = APIRouter(prefix=BASE)\napp.include_router(router, prefix='/api')\n\n\n@router.get('/items/{item_id}', response_model=list[Item], status_code=201)\n@cached\ndef read(item_id: int, q: str = '', body: Item = None, unknown=1):\n    return u.price(item_id)\n\n\n@other.post('/x', include_in_schema=False)\ndef post(x):\n    return save(x)\n\n\n@router.get(path)\ndef computed():\n    pass\n\n\ndef save(x):\n    session.commit()\n    util.fetch(x)\n    Item()\n    shop.models.Basket()\n    shop.models.Basket.total()\n",
    "shop/hooks.py": "from sqlalchemy import event\nfrom sqlalchemy.event import listen as hear\nfrom shop.models import Row\nfrom .web import save\n\n\n@event.listens_for(Row, 'before_insert')\n@app.on_event('startup')\ndef stamp(m, c, t):\n    def later():\n        smtplib.SMTP()\n    return save(t)\n\n\nevent.listen(Row, 'after_insert', stamp)\nhear(Row, NAME, save)\nevent.listen(Row, 'x', lambda: 1)\nsock.listen(5)\n",
    "shop/broken.py": "def broken(:\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, source string").withColumn("module", identity.module_name(F.col("path"), F.lit("")))
    return parse.facts(files).cache()


@pytest.fixture(scope="module")
def found(facts):
    rows = extract.extract_all(facts, {"pydantic": "2.1"}).collect()
    names = {r.span_id: r.fq for r in extract.spans(facts).collect()}
    return {r.logical_key: (json.loads(r.payload), {(names[e.span_id], e.role) for e in r.evidence}, r.versions) for r in rows}


def test_spans_begin_at_decorators(facts):
    at = {r.fq: (r.start_line, r.end_line) for r in facts.where("fact = 'span' and kind = 'function'").collect()}
    assert at["shop.web.read"] == (12, 15) and at["shop.util._hidden.inner"] == (15, 16)
    assert [r.module for r in facts.where("fact = 'gap'").collect()] == ["shop.broken"]


def test_imports(found):
    assert {k for k in found if k.startswith("import:")} == {f"import:{a}->{b}" for a, b in (("shop", "shop.models"), ("shop", "shop.util"), ("shop.web", "shop.util"), ("shop.web", "shop.models"), ("shop.hooks", "shop.models"), ("shop.hooks", "shop.web"))}
    assert found["import:shop.web->shop.models"][1] == {("shop.web::import@2", "import_statement"), ("shop.web::import@4", "import_statement")}


def test_calls(found):
    got = {(p["caller"], p["callee"], p["resolution"]) for k, (p, _, _) in found.items() if k.startswith("call:")}
    assert got == {
        ("shop.util.price", "shop.util.fetch", "same_module"), ("shop.util", "shop.util.price", "same_module"), ("shop.util._hidden.inner", "shop.util.price", "same_module"), ("shop.models.Basket.total", "shop.models.Basket.add", "self"),
        ("shop.web.read", "shop.util.price", "imported"), ("shop.web.post", "shop.web.save", "same_module"), ("shop.web.save", "shop.util.fetch", "imported"), ("shop.web.save", "shop.models.Item", "imported"),
        ("shop.web.save", "shop.models.Basket", "imported"), ("shop.hooks.stamp", "shop.web.save", "imported"),
    }
    assert found["call:shop.web.post->shop.web.save"][1] == {("shop.web.post", "caller"), ("shop.web.save", "callee")}


def test_routes(found):
    assert {k for k in found if k.startswith("api:")} == {"api:GET /api/v1/items/{item_id}", "api:POST /x"}
    p, on, versions = found["api:GET /api/v1/items/{item_id}"]
    assert [(x["name"], x["in"]) for x in p["params"]] == [("item_id", "path"), ("q", "query"), ("body", "body"), ("unknown", "query")]
    assert (p["status_code"], p["response_model_base"], p["limitations"], p["include_in_schema"]) == (201, "Item", ["generic_response_model"], True)
    assert on == {("shop.web.read", "handler"), ("shop.models.Item", "response_model")} and versions == {"fastapi": "unknown", "pydantic": "2.1"}
    p, _, _ = found["api:POST /x"]
    assert (p["limitations"], p["prefix_resolved"], p["include_in_schema"]) == (["dynamic_prefix"], False, False)


def test_entities(found):
    got = {k: p for k, (p, _, _) in found.items() if k.startswith("entity:")}
    assert {k: p["framework"] for k, p in got.items()} == {"entity:shop.models.Item": "pydantic", "entity:shop.models.Basket": "dataclass", "entity:shop.models.Row": "sqlalchemy"}
    assert [(f["name"], f["required"]) for f in got["entity:shop.models.Item"]["fields"]] == [("name", True), ("note", False)]
    assert [(f["name"], f["source"]) for f in got["entity:shop.models.Row"]["fields"]] == [("id", "annotated"), ("size", "column")]
    assert found["entity:shop.models.Basket"][1] == {("shop.models.Basket", "class_definition"), ("shop.models.Item", "related_entity")}
    assert [(r["target_fq"], r["via"]) for r in got["entity:shop.models.Row"]["related_entities"]] == [("shop.models.Basket", "relationship")]


def test_events(found):
    got = {k: p for k, (p, _, _) in found.items() if k.startswith("event:")}
    assert {k: [(r["family"], r["event"], r["form"]) for r in p["registrations"]] for k, p in got.items()} == {
        "event:shop.models.Item.tidy": [("pydantic_field_validator", None, "decorator")],
        "event:shop.hooks.stamp": [("sqlalchemy_listens_for", "before_insert", "decorator"), ("fastapi_on_event", "startup", "decorator"), ("sqlalchemy_listen", "after_insert", "call")],
        "event:shop.web.save": [("sqlalchemy_listen", None, "call")],
    }
    assert found["event:shop.web.save"][1] == {("shop.web.save", "handler"), ("shop.models.Row", "target_class"), ("shop.hooks", "registration_site")}
    assert found["event:shop.models.Item.tidy"][1] == {("shop.models.Item.tidy", "handler"), ("shop.models.Item", "owner_class")}
    assert got["event:shop.web.save"]["limitations"] == ["dynamic_event_name"] and got["event:shop.models.Item.tidy"]["registrations"][0]["fields"] == ["name"]


def test_surface(found):
    got = {p["name"]: (p["symbol_kind"], p["defining_fq_symbol_path"], p["limitations"]) for k, (p, _, _) in found.items() if k.startswith("surface:")}
    assert got == {"Item": ("class", "shop.models.Item", []), "Bag": ("class", "shop.models.Basket", []), "price": ("function", "shop.util.price", []), "Tool": (None, None, ["definition_not_first_party"]), "home": ("function", "shop.home", [])}
    assert found["surface:shop.home"][0]["signature"] == "(a, *, b: int=1) -> str"
    assert found["surface:shop.Bag"][1] == {("shop::import@0", "re_export"), ("shop.models.Basket", "definition")}


def test_process_paths(found):
    got = {k: (p["steps"], p["depth"]) for k, (p, _, _) in found.items() if k.startswith("process:")}
    assert got == {
        "process:shop.web.read->http_call@shop.util.fetch": (["shop.web.read", "shop.util.price", "shop.util.fetch"], 2),
        "process:shop.web.post->db_write@shop.web.save": (["shop.web.post", "shop.web.save"], 1),
        "process:shop.hooks.stamp->db_write@shop.web.save": (["shop.hooks.stamp", "shop.web.save"], 1),
        "process:shop.web.save->db_write@shop.web.save": (["shop.web.save"], 0),
    }
    p, on, versions = found["process:shop.web.read->http_call@shop.util.fetch"]
    assert on == {("shop.web.read", "entrypoint"), ("shop.util.price", "step"), ("shop.util.fetch", "terminal")}
    assert p["sink"] == {"name": "http_call", "matches": [{"text": "requests.get", "pattern": "requests.*", "line": 11}]}
    assert [(e["caller"], e["resolution"]) for e in p["edges"]] == [("shop.web.read", "imported"), ("shop.util.price", "same_module")]
    assert versions == {"sink_registry": sinks.registry_digest(sinks.registry())}


def test_sink_paths_caps(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 6)], "caller long, callee long")
    s = spark.createDataFrame([(3, "a"), (6, "a"), (6, "b")], "node long, sink string")
    one = spark.createDataFrame([(1,)], "entry long")
    rows = lambda **k: {(r.sink, r.terminal, tuple(r.steps), r.depth, tuple(r.limitations)) for r in sinks.sink_paths(e, one, s, **k).collect()}
    assert rows() == {("a", 3, (1, 3), 1, ()), ("a", 6, (1, 2, 4, 5, 6), 4, ()), ("b", 6, (1, 2, 4, 5, 6), 4, ())}
    assert rows(max_depth=3) == {("a", 3, (1, 3), 1, ("depth_capped",))}
    assert rows(max_paths=2) == {("a", 3, (1, 3), 1, ("paths_capped",)), ("a", 6, (1, 2, 4, 5, 6), 4, ("paths_capped",))}


def test_registry():
    assert dict(sinks.registry({"version": 1, "sinks": [{"name": "db_write", "patterns": ["db.save"]}]}))["db_write"] == ["db.save"]
    assert sinks.registry({"version": 1, "extend": False, "sinks": [{"name": "x", "patterns": ["*.y"]}]}) == [("x", ["*.y"])]
    for bad in ({"version": 2}, {"version": 1, "sinks": [{"name": "x", "patterns": []}]}, {"version": 1, "sinks": [{"name": "x", "patterns": ["*"]}]}, {"version": 1, "extend": 1}):
        with pytest.raises(ValueError):
            sinks.registry(bad)
