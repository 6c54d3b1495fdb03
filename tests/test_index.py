"""Indexing a repository commit by commit, serving what was found, and following a branch."""

import subprocess

import pytest

from spanloom import cli, providers
from spanloom.operators import index, semantic, serve, store
from spanloom.sources import git
from spanloom.streaming import watch

STEPS = [
    {"src/app/__init__.py": "", "src/app/a.py": "from .b import go\n\n\ndef run():\n    return go()\n", "src/app/b.py": "def go():\n    return 1\n", "README.md": "x", "pyproject.toml": "[project]\ndependencies = ['pydantic>=2']\n"},
    {"src/app/b.py": "from pydantic import BaseModel\n\n\nclass Row(BaseModel):\n    x: int\n\n\ndef go():\n    session.commit()\n    return 2\n"},
    {"src/app/c.py": "from app.a import run\nrun()\n"},
]


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q", "-b", "main")
    shas = []
    for i, step in enumerate(STEPS):
        for name, text in step.items():
            (path / name).parent.mkdir(parents=True, exist_ok=True)
            (path / name).write_text(text)
        run("add", ".")
        run("commit", "-qm", f"step {i} (#{i})")
        shas.append(run("rev-parse", "HEAD"))
    run("branch", "at0", shas[0])
    return str(path), shas


@pytest.fixture(scope="module")
def watched(spark, repo, tmp_path_factory):
    """A store that followed the branch from its first commit to its last."""
    path, shas = repo
    st = store.Store(spark, str(tmp_path_factory.mktemp("store")))
    told = []
    subprocess.run(["git", "-C", path, "branch", "-f", "live", shas[0]], check=True)
    first = watch.tick(spark, st, path, "live", echo=told.append)
    idle = watch.tick(spark, st, path, "live", echo=told.append)
    subprocess.run(["git", "-C", path, "branch", "-f", "live", shas[2]], check=True)
    later = watch.tick(spark, st, path, "live", echo=told.append)
    subprocess.run(["git", "-C", path, "branch", "-f", "live", shas[1]], check=True)
    back = watch.tick(spark, st, path, "live", echo=told.append)
    return st, first, idle, later, back, told


def test_watch(watched, repo):
    st, first, idle, later, back, told = watched
    _, shas = repo
    assert [(r.sha, r.mode, r.parsed, r.reused) for r in first] == [(shas[0], "full", 3, 0)] and idle == [] and back == []
    assert [(r.sha, r.mode, r.parsed, r.reused) for r in later] == [(shas[1], "incremental", 1, 2), (shas[2], "incremental", 1, 3)]
    assert st.cursor("live") == shas[1] and told == [f"live: {shas[1][:12]} is indexed already"] and st.latest() == shas[2]


def test_incremental_is_full(spark, watched, repo, tmp_path):
    path, shas = repo
    full = store.Store(spark, str(tmp_path))
    r = index.index_commit(spark, full, path, shas[2])
    assert (r.mode, r.parsed, r.files) == ("full", 4, 4)
    for table, keys in (("artifact", ["artifact_id", "logical_key", "payload"]), ("derived_from", ["artifact_id", "span_id", "role"]), ("span_occurrence", ["span_id", "file_path", "start_line", "raw_text"])):
        a, b = (sorted(map(tuple, s.table(table, shas[2]).select(*keys).collect())) for s in (full, watched[0]))
        assert a == b and a
    with pytest.raises(ValueError):
        index.index_commit(spark, full, path, shas[2], parent=shas[0])
    entry = full.table("artifact", shas[2]).where("logical_key = 'entity:app.b.Row'").first()
    assert entry.versions == {"pydantic": "spec:pydantic>=2"}


def test_invalidation(watched, repo):
    st, shas = watched[0], repo[1]
    assert {r.logical_key for r in index.invalidated(st, shas[0], shas[1]).collect()} == {"call:app.a.run->app.b.go"}


def test_unpublished_parts_are_not_seen(spark, tmp_path):
    st = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("k", "a")], store.SCHEMAS["snapshot_entry"])
    folder = st.stage("snapshot_entry", rows, "s1")
    assert st.table("snapshot_entry").count() == 0 and st.latest() is None
    st.publish("s1", {"snapshot_entry": [folder]}, ingested_at="2024-01-01T00:00:00")
    st.publish("s1", {"snapshot_entry": [st.stage("snapshot_entry", rows, "s1")]})
    assert st.table("snapshot_entry", "s1").count() == 2 and st.latest() == "s1" and st.manifests()["s1"]["ingested_at"].startswith("2024")


def test_serving(watched, repo):
    st, shas = watched[0], repo[1]
    got = serve.get_knowledge(st, "app.b", shas[2], 100_000).collect()
    assert {r.logical_key for r in got} == {"entity:app.b.Row", "call:app.a.run->app.b.go"} and {(r.total_matched, r.omitted) for r in got} == {(2, 0)}
    assert all(r.freshness == "current" and r.method == "deterministic" and len(r.provenance) > 0 for r in got)
    one = serve.get_knowledge(st, "src/app/a.py", shas[2], 1).collect()
    assert len(one) == 1 and one[0].total_matched == 4 - 1 and one[0].omitted == 2
    assert [r.logical_key for r in serve.get_knowledge(st, "entity:app.b.Row", shas[2]).collect()] == ["entity:app.b.Row"]
    assert serve.get_knowledge(st, "nothing", shas[2]).count() == 0 and serve.get_knowledge(st, "app.b", "f" * 40).count() == 0
    old = serve.get_knowledge(st, "app.a", shas[0], 100_000).collect()
    assert {r.freshness for r in old} == {f"stale@{shas[2][:12]}"}
    at = serve.find_provenance(st, "src/app/a.py", 5, shas[2]).collect()
    assert [r.fq for r in at if r.logical_key] [:1] == ["app.a.run"] and "call:app.a.run->app.b.go" in {r.logical_key for r in at}


def test_search(watched, repo):
    st, shas = watched[0], repo[1]
    provider = providers.HashingEmbedder()
    n = serve.embed_snapshot(st, shas[2], provider)
    assert n == st.table("artifact", shas[2]).count() and serve.embed_snapshot(st, shas[2], provider) == 0
    got = serve.search_knowledge(st, "pydantic entity app.b.Row", provider, shas[2], k=2).collect()
    assert "entity:app.b.Row" in {r.logical_key for r in got} and {r.total_matched for r in got} == {2}
    sources = st.spark.createDataFrame([("f.py", "\n".join(f"line {i}" for i in range(1, 101))), ("g.py", "needle in here")], "path string, source string")
    assert serve.index_chunks(st, shas[2], sources, provider) == 4
    chunks = st.table("rag_chunk", shas[2]).where("file_path = 'f.py'").orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in chunks] == [(1, 40), (31, 70), (61, 100)]
    assert serve.rag_retrieve(st, "needle", provider, shas[2], 1).first().file_path == "g.py"


@pytest.mark.parametrize(("given", "want"), [
    (("h", "h", True, None), ("idle", [])), (("h", "c", True, None), ("already_indexed", [])), (("h", None, False, None), ("fresh", [("h", None)])),
    (("h", "c", False, ["a", "h"]), ("catch_up", [("a", None), ("h", None)])), (("h", "c", False, None), ("jump", [("h", "c")])), (("h", "c", False, None, False), ("jump", [("h", None)])),
])
def test_decisions(given, want):
    assert watch.decide(*given) == want


def test_stream(spark, repo, tmp_path):
    path, shas = repo
    st = store.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        q = watch.watch_stream(spark, st, path, "at0", str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        q.stop()
        assert q.exception() is None and list(st.manifests()) == [shas[0]]
    with pytest.raises(ValueError):
        watch.run_watch(spark, st, path, "no-such-branch", once=True)


def test_git_facts(repo):
    path, shas = repo
    assert git.parents(path, shas[1]) == [shas[0]] and git.pull_number("a (#12)") == 12 and git.pull_number("Merge pull request #7 from x") == 7 and git.pull_number("see #3") is None
    assert git.origin_slug(path) is None
    subprocess.run(["git", "-C", path, "remote", "add", "origin", "git@host.org:me/it.git"], check=True)
    assert git.origin_slug(path) == "me/it"
    assert index.framework_versions({"uv.lock": '[[package]]\nname = "FastAPI"\nversion = "0.1"\n'}) == {"fastapi": "0.1"}
    assert index.sink_rules({".kb/sinks.json": '{"version": 1, "extend": false, "sinks": [{"name": "a", "patterns": ["*.b"]}]}'}) == [("a", ["*.b"])]


def _stub():
    """A model that names one symbol of the source and one that is not there. Made here, so that workers need no test module."""
    return providers.StubLLM('Sure: {"summary": "it goes", "claims": [{"text": "has go", "symbol": "app.b.go"}, {"text": "made up", "symbol": "Phantom"}, {"text": "none"}, 3]} done')


def test_descriptions_and_decisions(spark, watched, repo):
    st, (path, shas) = watched[0], repo
    n, dropped = semantic.describe_snapshot(st, shas[2], _stub())
    rows = {r.logical_key: r for r in st.table("artifact", shas[2]).where("kind = 'description'").collect()}
    assert n == len(rows) and {"desc:module:app.b", "desc:module:app.a", "desc:package:app", "desc:repo"} >= set(rows) - {k for k in rows if k.startswith("desc:entity")} and "desc:module:app.b" in rows and "desc:module:app.c" not in rows
    assert abs(rows["desc:module:app.b"].confidence - 1 / 4) < 1e-9 and not rows["desc:module:app.b"].is_deterministic and dropped == 2 * n
    got = serve.get_knowledge(st, "desc:module:app.b", shas[2]).collect()
    assert [(r.method, r.summary) for r in got] == [("llm-grounded", "it goes")]
    prs = providers.StaticPRs({1: providers.PullRequest(1, "Go on", "because", "me")})
    out = semantic.mine_history(spark, st, path, _stub(), shas[2], requests=prs)
    assert (out.scanned, out.mined, out.enriched, out.fetch_failed) == (3, 2, 1, 2)
    again = semantic.mine_history(spark, st, path, _stub(), shas[2])
    assert (again.already_mined, again.mined) == (2, 0)
    assert semantic.describe_snapshot(st, shas[0], providers.StubLLM("no json")) == (0, 0)


def test_claims():
    kept, dropped = semantic.validate_claims([{"symbol": "List[Out]"}, {"symbol": "a.Gone"}, {"text": "x"}, "no"], ["class Out: pass"], ["m.Out"])
    assert [len(kept), len(dropped)] == [1, 2] and semantic.answered("x") is None and semantic.answered("[1]") is None
    assert semantic.packed("h", ["a" * 9000, "b"]) == "h" + "a" * 9000 + "\n\n"


def test_command_line(spark, watched, repo, capsys):
    st, shas = watched[0], repo[1]
    cli.main(["--store", st.path, "knowledge", "entity:app.b.Row", "--sha", shas[2]], spark)
    assert '"logical_key": "entity:app.b.Row"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--store", st.path, "describe"], spark)
