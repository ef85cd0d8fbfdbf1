"""Embedding providers: two HTTP kinds, none, and a local one that needs no model. All map a list of texts to a list of vectors."""

from __future__ import annotations

import json
import math
import urllib.request
from typing import Protocol

# Providers, their models and dimensions; the first model is the default.
CATALOGUE = {
    "ollama": {"kind": "ollama", "needs_key": False, "models": {"embeddinggemma": 768, "qwen3-embedding": 4096, "bge-m3": 1024, "all-minilm": 384, "nomic-embed-text": 768, "snowflake-arctic-embed2": 1024, "mxbai-embed-large": 1024, "snowflake-arctic-embed": 1024}},
    "openai": {"kind": "openai-compatible", "needs_key": True, "models": {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072}},
}


def resolve(provider: str, model: str | None = None, dimensions: int | None = None) -> tuple[str, str, int]:
    """(kind, model, dimensions): explicit dimensions first, then the catalogue; otherwise an error."""
    spec = CATALOGUE.get(provider)
    kind = spec["kind"] if spec else "openai-compatible"
    model = model or (next(iter(spec["models"])) if spec else None)
    dims = dimensions or (spec["models"].get(model) if spec else None)
    if not model or not dims:
        raise ValueError(f"dimensions of {provider}/{model} are not known; give them")
    return kind, model, dims


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Disabled:
    """Zero vectors."""

    def __init__(self, dims: int):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[0.0] * self.dims for _ in texts]


class HashEmbedder:
    """Signed hashing of words into a unit vector: deterministic, offline."""

    def __init__(self, dims: int):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in (t or "").lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "big") % self.dims] += 1 if h[4] & 1 else -1
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    req = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(req, timeout=timeout) as r:
        return json.loads(r.read())


class Ollama:
    """POST {base}/api/embed; as many vectors as texts must come back."""

    def __init__(self, model: str, base: str = "http://127.0.0.1:11434", timeout: float = 30):
        self.model, self.base, self.timeout = model, base.rstrip("/"), timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        got = _post(f"{self.base}/api/embed", {"model": self.model, "input": texts}, {}, self.timeout).get("embeddings")
        if not isinstance(got, list) or len(got) != len(texts):
            raise ValueError("the server returned another number of vectors than it got texts")
        return got


class OpenAICompatible:
    """POST {base}/embeddings; answers are put in the order of their index."""

    def __init__(self, model: str, key: str, base: str, dimensions: int | None = None, timeout: float = 30):
        self.model, self.key, self.base, self.dimensions, self.timeout = model, key, base.rstrip("/"), dimensions, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        body = {"model": self.model, "input": texts} | ({"dimensions": self.dimensions} if self.dimensions else {})
        got = _post(f"{self.base}/embeddings", body, {"Authorization": f"Bearer {self.key}"}, self.timeout).get("data")
        if not isinstance(got, list) or len(got) != len(texts):
            raise ValueError("the server returned another number of vectors than it got texts")
        return [x["embedding"] for x in sorted(got, key=lambda x: x["index"])]


def probe(embedder: Embedder | None) -> str:
    """ok, disabled, or error with its reason."""
    if embedder is None or isinstance(embedder, Disabled):
        return "disabled"
    try:
        return "ok" if embedder.embed(["ping"]) else "error: no vector"
    except Exception as e:  # noqa: BLE001
        return f"error: {e}"
