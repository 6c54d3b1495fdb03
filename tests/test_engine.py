"""Parsing, identities, edges, paths and audits on small sources."""

import hashlib
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from spanloom.functions import identity
from spanloom.operators import edges, parse, store
from spanloom.sources import git

FILES = {
    "shop/__init__.py": "",
    "shop/util.py": "def total(xs):\n    return sum(xs)\n\n\ndef twice(x):\n    return total([x, x])\n",
    "shop/cart.py": "import shop.util as u\nfrom .util import twice as two\n\n\nclass Cart:\n    def add(self, x):\n        return self.check(two(x))\n\n    def check(self, x):\n        return u.total([x])\n",
    "shop/bad.py": "def broken(:\n",
}


def _prints(source):
    return {(f[3], f[4]): f[10] for f in parse.file_facts("m.py", "m", source) if f[2] == "span"}


def test_fingerprints():
    a = _prints('def f(a):\n    """Doc."""\n    return a + 0x10\n')
    assert a == _prints("# note\n\ndef f( a ):\n    return (a+16)\n")
    assert a != _prints("def f(a):\n    return a - 16\n")


def test_span_id_matches_hashlib(spark):
    got = spark.range(1).select(identity.span_id(F.lit("python"), F.lit("function"), F.lit("m.é"), F.lit("AB"))).first()[0]
    assert got == hashlib.sha256("".join(f"{x}\x1f" for x in ("1", "python", "function", "m.é", "ab")).encode()).hexdigest()


def test_canonical_json_escapes(spark):
    values = {"b": 'q"\\', "a": "t\t\r\n\x01é"}
    got = spark.createDataFrame([(values,)], "v map<string,string>").select(identity.canonical_json(F.col("v"))).first()[0]
    assert got == json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_artifact_id_ignores_order(spark):
    make = lambda ids: identity.artifact_id(F.array(*map(F.lit, ids)), *[F.lit(x) for x in ("k", "e", "1", "", "")], F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    a, b, c = spark.range(1).select(make(["x", "y"]), make(["y", "x", "y"]), make(["x"])).first()
    assert a == b != c
    body = "2\x1f2\x1fx\x1fy\x1fk\x1fe\x1f1\x1f\x1f\x1f" + '{"a":"1","b":"2"}\x1f'
    assert a == hashlib.sha256(body.encode()).hexdigest()


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for step in range(2):
        for name, text in FILES.items():
            (path / name).parent.mkdir(exist_ok=True)
            (path / name).write_text(text + ("\nX = 1\n" if step and name.endswith("util.py") else ""))
        run("add", ".")
        run("commit", "-qm", f"step {step}")
    return str(path)


def test_git_source(spark, repo):
    head, first = git.resolve(repo, "main"), git.resolve(repo, "main~1")
    assert git.first_parent_chain(repo, head, first) == [head] and git.branch_head(repo, "none") is None
    new, old = git.blobs(spark, repo, "main"), git.blobs(spark, repo, "main~1")
    assert {r.path: r.source for r in old.collect()} == FILES
    assert [tuple(r) for r in git.changed_paths(old, new).collect()] == [("shop/util.py", "modified")]
    assert [r.sha for r in git.commits(spark, repo).collect()] == [head, first]


def test_edges(spark, repo):
    files = git.blobs(spark, repo, "main").withColumn("module", identity.module_name(F.col("path"), F.lit("")))
    facts = parse.facts(files)
    assert {(r.importer, r.imported) for r in edges.import_edges(facts).collect()} == {("shop.cart", "shop.util")}
    got = {(r.caller, r.callee, r.resolution) for r in edges.call_edges(facts).collect()}
    assert got == {("shop.util.twice", "shop.util.total", "same_module"), ("shop.cart.Cart.add", "shop.cart.Cart.check", "self"), ("shop.cart.Cart.add", "shop.util.twice", "imported"), ("shop.cart.Cart.check", "shop.util.total", "imported")}
    assert [r.path for r in facts.where("fact = 'gap'").collect()] == ["shop/bad.py"]


def test_store(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 5), ("b", 3), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in store.insert_ignore(old, new, ["k"], ["v"]).collect()] == [("b", 2)]
    assert sorted(tuple(r) for r in store.upsert_latest(old, new, ["k"], "v").collect()) == [("a", 5), ("b", 3)]
    artifacts = spark.createDataFrame([("x", 0.5, True, "", "")], "artifact_id string, confidence double, is_deterministic boolean, prompt_version string, model_id string")
    spans = spark.createDataFrame([("s",)], "span_id string")
    store.audit(artifacts, spark.createDataFrame([("x", "s")], "artifact_id string, span_id string"), spans)
    with pytest.raises(store.GroundingError):
        store.audit(artifacts, spark.createDataFrame([], "artifact_id string, span_id string"), spans)
