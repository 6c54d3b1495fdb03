"""Following a branch: a streaming source of its head, the decision of a tick, and the loop.

The order of the checks matters: nothing new; a head that is indexed already; a fresh branch (its head only, never the
whole history); a chain of commits after the cursor (each indexed against the one before, the cursor moved after each,
so that a run that is lost goes on from there); else a jump: one run of the head against the cursor.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.index import IndexResult, index_commit
from spanloom.operators.store import Store
from spanloom.sources import git

CATCH_UP = 50


def decide(head: str, cursor: str | None, head_indexed: bool, chain: list[str] | None, cursor_exists: bool = True) -> tuple[str, list[tuple[str, str | None]]]:
    """(what to do, commits to index with the parents that are asked for). ``cursor``: null if its commit is not indexed."""
    if cursor == head:
        return "idle", []
    if head_indexed:
        return "already_indexed", []
    if cursor is None:
        return "fresh", [(head, None)]
    if chain is not None:
        return "catch_up", [(sha, None) for sha in chain]
    return "jump", [(head, cursor if cursor_exists else None)]


def tick(spark: SparkSession, st: Store, repo: str, branch: str, max_catchup: int = CATCH_UP, root: str | None = None, echo: Callable[[str], None] = lambda _: None) -> list[IndexResult]:
    """Indexes what the branch gained since its cursor."""
    head = git.branch_head(repo, branch)
    if head is None:
        raise ValueError(f"there is no branch {branch!r} in {repo}")
    raw = st.cursor(branch)
    cursor = raw if raw is not None and st.has(raw) else None
    indexed = st.has(head)
    there = cursor is not None and git.exists(repo, cursor)
    chain = git.first_parent_chain(repo, head, cursor, max_catchup) if there and not indexed else None
    what, todo = decide(head, cursor, indexed, chain, there)
    if what == "already_indexed":
        st.move_cursor(branch, head)
        echo(f"{branch}: {head[:12]} is indexed already")
    elif what == "jump":
        echo(f"{branch}: jumped past its cursor to {head[:12]}")
    done = []
    for sha, parent in todo:
        done.append(index_commit(spark, st, repo, sha, incremental=True, parent=parent, root=root))
        st.move_cursor(branch, sha)
    return done


def run_watch(spark: SparkSession, st: Store, repo: str, branch: str, interval: float = 30.0, once: bool = False, max_catchup: int = CATCH_UP, root: str | None = None, echo: Callable[[str], None] = print) -> None:
    """Ticks until it is interrupted. A tick that fails is told and tried again; with ``once`` it raises."""
    while True:
        try:
            for r in tick(spark, st, repo, branch, max_catchup, root, echo):
                echo(f"indexed {r.sha[:12]} ({r.mode}): {r.files} files ({r.parsed} parsed, {r.reused} reused), {r.spans} spans, {r.artifacts} artifacts, {len(r.gaps)} gaps")
        except Exception as e:
            if once:
                raise
            echo(f"the tick failed and will be tried again: {e!r}")
        if once:
            return
        time.sleep(interval)


class BranchReader(SimpleDataSourceStreamReader):
    """A row whenever the head moved; the offset is the head."""

    def __init__(self, options: dict[str, str]):
        self.repo, self.branch = options["repo"], options["branch"]

    def initialOffset(self) -> dict:
        return {"head": ""}

    def read(self, start: dict):
        head = git.branch_head(self.repo, self.branch) or ""
        return iter([(self.branch, head)] if head != start["head"] else []), {"head": head}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(self.branch, end["head"])] if end["head"] != start["head"] else [])


class BranchSource(DataSource):
    """``spark.readStream.format("git-branch")``: the heads of a branch as they move."""

    @classmethod
    def name(cls) -> str:
        return "git-branch"

    def schema(self) -> str:
        return "branch string, head string"

    def simpleStreamReader(self, schema):
        return BranchReader(self.options)


def watch_stream(spark: SparkSession, st: Store, repo: str, branch: str, checkpoint: str, once: bool = True, max_catchup: int = CATCH_UP) -> StreamingQuery:
    """The loop as a streaming query. A batch that runs again does nothing twice: the cursor says what is done."""
    spark.dataSource.register(BranchSource)
    heads = spark.readStream.format("git-branch").option("repo", repo).option("branch", branch).load()

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            tick(spark, st, repo, branch, max_catchup)

    out = heads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="30 seconds")).start()
