"""What users can plug in: extractors, structural indexes, embeddings, language models, pull requests. Offline defaults for tests."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame

DIMENSIONS = 384


@runtime_checkable
class Extractor(Protocol):
    """Facts to artifacts; see :mod:`spanloom.operators.extract` for the columns."""

    def __call__(self, facts: DataFrame, versions: dict[str, str] | None = None) -> DataFrame: ...


@runtime_checkable
class StructuralIndex(Protocol):
    def __call__(self, path: str, module: str, source: str) -> list[tuple]: ...


@runtime_checkable
class EmbeddingProvider(Protocol):
    model_id: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@runtime_checkable
class LLMProvider(Protocol):
    model_id: str

    def complete(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class PullRequest:
    number: int
    title: str
    body: str
    author: str | None = None


@runtime_checkable
class PRProvider(Protocol):
    def fetch(self, number: int) -> PullRequest | None: ...


class HashingEmbedder:
    """Signed hashes of words and word pairs, of unit length. Deterministic and offline; it knows nothing of meaning."""

    model_id = "hashing-384"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), DIMENSIONS), np.float64)
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"[A-Za-z0-9]+", text.lower())
            for token in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                row[h % DIMENSIONS] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1
        return out.astype(np.float32).tolist()


class StubLLM:
    """Answers by a function of the prompt, or always the same."""

    model_id = "stub"

    def __init__(self, answer):
        self.answer = answer

    def complete(self, prompt: str) -> str:
        got = self.answer(prompt) if callable(self.answer) else self.answer
        return got if isinstance(got, str) else json.dumps(got)


class StaticPRs:
    def __init__(self, known: dict[int, PullRequest]):
        self.known = known

    def fetch(self, number: int) -> PullRequest | None:
        return self.known.get(number)


def store_path(given: str | None = None) -> str:
    """The store's folder: as given, else ``SPANLOOM_STORE``."""
    path = given or os.environ.get("SPANLOOM_STORE")
    if not path:
        raise ValueError("name a store folder, or set SPANLOOM_STORE")
    return path
