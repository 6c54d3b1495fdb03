"""The command line: index, watch, embed, describe, mine, provenance, knowledge, search."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession

from spanloom import providers
from spanloom.operators import index, semantic, serve
from spanloom.operators.store import Store
from spanloom.streaming import watch


def _loaded(name: str | None, default):
    """``module:factory`` called without arguments."""
    if name is None:
        if default is None:
            raise SystemExit("name a provider as module:factory")
        return default()
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    p.add_argument("--store", help="the store's folder; else SPANLOOM_STORE")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> None:
        s = sub.add_parser(name)
        for flags, options in arguments:
            s.add_argument(*flags, **options)

    sha, repo, llm = (("--sha",), {}), (("repo",), {}), (("--llm",), {"help": "module:factory of a language model"})
    embed, budget = (("--embedder",), {"help": "module:factory of an embedding model"}), (("--budget",), {"type": int, "default": serve.BUDGET})
    add("index", repo, (("--sha",), {"default": "HEAD"}), (("--incremental",), {"action": "store_true"}), (("--parent",), {}), (("--root",), {}))
    add("watch", repo, (("branch",), {}), (("--interval",), {"type": float, "default": 30.0}), (("--once",), {"action": "store_true"}), (("--max-catchup",), {"type": int, "default": watch.CATCH_UP}))
    add("embed", sha, embed)
    add("describe", sha, llm)
    add("mine", repo, (("--sha",), {"default": "HEAD"}), llm, (("--max-commits",), {"type": int, "default": 20}), (("--force",), {"action": "store_true"}))
    add("provenance", (("file",), {}), (("line",), {"type": int}), sha)
    add("knowledge", (("target",), {}), sha, budget)
    add("search", (("query",), {}), sha, budget, embed, (("--k",), {"type": int, "default": serve.TOP}))
    return p


def _print(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("spanloom").getOrCreate()
    st = Store(spark, providers.store_path(a.store))
    sha = getattr(a, "sha", None)
    if a.command == "index":
        print(index.index_commit(spark, st, a.repo, a.sha, a.incremental, a.parent, a.root))
    elif a.command == "watch":
        watch.run_watch(spark, st, a.repo, a.branch, a.interval, a.once, a.max_catchup)
    elif a.command == "embed":
        print(serve.embed_snapshot(st, sha or st.latest(), _loaded(a.embedder, providers.HashingEmbedder)))
    elif a.command == "describe":
        print(semantic.describe_snapshot(st, sha or st.latest(), _loaded(a.llm, None)))
    elif a.command == "mine":
        print(semantic.mine_history(spark, st, a.repo, _loaded(a.llm, None), a.sha, a.max_commits, a.force))
    elif a.command == "provenance":
        _print(serve.find_provenance(st, a.file, a.line, sha))
    elif a.command == "knowledge":
        _print(serve.get_knowledge(st, a.target, sha, a.budget))
    else:
        _print(serve.search_knowledge(st, a.query, _loaded(a.embedder, providers.HashingEmbedder), sha, a.k, a.budget))


if __name__ == "__main__":
    main()
