"""Commits and blobs of a git repository as DataFrames, read without a checkout through the git command."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def resolve(repo: str, revision: str) -> str:
    return git(repo, "rev-parse", "--verify", f"{revision}^{{commit}}").strip()


def parents(repo: str, revision: str) -> list[str]:
    return git(repo, "rev-list", "--parents", "-n", "1", revision).split()[1:]


def exists(repo: str, sha: str) -> bool:
    return subprocess.run(["git", "-C", repo, "cat-file", "-e", f"{sha}^{{commit}}"], capture_output=True).returncode == 0


def origin_slug(repo: str) -> str | None:
    """``owner/name`` of the origin's address, by ssh or https."""
    got = subprocess.run(["git", "-C", repo, "remote", "get-url", "origin"], capture_output=True, text=True).stdout.strip()
    met = re.search(r"[:/]([^/:]+)/([^/]+?)(?:\.git)?/?$", got)
    return f"{met[1]}/{met[2]}" if met else None


def pull_number(subject: str) -> int | None:
    """The number of the pull request that a commit's subject names, as a squash ``(#12)`` or a merge."""
    met = re.search(r"\(#(\d+)\)\s*$", subject) or re.match(r"Merge pull request #(\d+)\b", subject)
    return int(met[1]) if met else None


def branch_head(repo: str, branch: str) -> str | None:
    got = subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "-q", f"refs/heads/{branch}"], capture_output=True, text=True)
    return got.stdout.strip() or None


def commits(spark: SparkSession, repo: str, revision: str = "HEAD") -> DataFrame:
    """(sha, parents, committed_at, subject), newest first."""
    rows = [line.split("\x1f") for line in git(repo, "log", "--format=%H%x1f%P%x1f%ct%x1f%s", resolve(repo, revision)).splitlines()]
    return spark.createDataFrame([(s, p.split(), int(t), m) for s, p, t, m in rows], "sha string, parents array<string>, committed_at long, subject string")


def first_parent_chain(repo: str, head: str, stop: str, limit: int = 50) -> list[str] | None:
    """Commits after ``stop`` up to ``head``, oldest first; None if ``stop`` is not met within ``limit``."""
    chain = git(repo, "rev-list", "--first-parent", f"--max-count={limit + 1}", head).split()
    return chain[: chain.index(stop)][::-1] if stop in chain else None


def blobs(spark: SparkSession, repo: str, revision: str, suffix: str = ".py", prefix: str = "", partitions: int = 8, only: list[str] | None = None) -> DataFrame:
    """(sha, path, oid, source): the tree is listed in the driver, the blobs are read by the tasks. ``only``: just these paths."""
    sha = resolve(repo, revision)
    rows = []
    for entry in git(repo, "ls-tree", "-r", "-z", sha).split("\0"):
        head, _, path = entry.partition("\t")
        if path.endswith(suffix) and path.startswith(prefix) and (only is None or path in only) and " blob " in f" {head} ":
            rows.append((sha, path, head.split()[2]))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="\n".join(b["oid"]).encode() + b"\n", check=True, capture_output=True).stdout
            sources, at = [], 0
            for _ in range(len(b)):
                end = out.index(b"\n", at)
                size = int(out[at:end].split()[2])
                sources.append(out[end + 1 : end + 1 + size].decode("utf-8", "replace"))
                at = end + 2 + size
            yield b.assign(source=sources)

    listed = spark.createDataFrame(rows, "sha string, path string, oid string")
    return listed.repartition(partitions, "path").mapInPandas(read, "sha string, path string, oid string, source string")


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two trees of (path, oid)."""
    both = old.select("path", F.col("oid").alias("a")).join(new.select("path", F.col("oid").alias("b")), "path", "full")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", kind.alias("change"))
