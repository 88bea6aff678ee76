"""Batch embedding: providers as functions from texts to vectors, processes or HTTP services among them."""

from __future__ import annotations

import hashlib
import json
import math
import os
import selectors
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Embedding

Provider = Callable[[list[str]], list[list[float]]]
#: Limits of answers, and which failures are worth another try.
MAX_ANSWER, MAX_DETAIL = 16 << 20, 8 << 10
RETRIES, BACKOFF_S = 1, 0.5


class ProviderError(RuntimeError):
    """A provider that failed, or answered something else than was asked."""


def hash_vector(text: str, dimensions: int) -> list[float]:
    """A deterministic unit vector: bytes of SHA-256 over a counter, a zero byte and the text, centred and scaled."""
    raw, k = b"", 0
    while len(raw) < dimensions:
        raw += hashlib.sha256(f"{k}\0{text}".encode()).digest()
        k += 1
    v = [(b - 127.5) / 127.5 for b in raw[:dimensions]]
    length = math.sqrt(sum(x * x for x in v))
    return [x / length for x in v]


def checked(ids: list[str], values: list[dict], dimensions: int) -> list[list[float]]:
    """Vectors in the order of ``ids``, from values of id and vector; each id once, each vector whole."""
    by = {v.get("id"): v.get("vector") for v in values}
    if len(values) != len(ids) or set(by) != set(ids):
        raise ProviderError("the provider's answer has other ids")
    for vector in by.values():
        if not isinstance(vector, list) or len(vector) != dimensions or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in vector):
            raise ProviderError(f"the provider's answer has vectors of other than {dimensions} numbers")
    return [[float(x) for x in by[i]] for i in ids]


class CommandProvider:
    """A process that reads lines of JSON, {inputs: [{id, text}]}, and answers each by {vectors: [{id, vector}]}.

    Started with the first batch; one that fails or is late is ended and started anew for the next."""

    def __init__(self, config: Embedding, root: str = "."):
        self.config, self.root, self.process = config, root, None

    def __call__(self, texts: list[str]) -> list[list[float]]:
        ids = [str(i) for i in range(len(texts))]
        try:
            if self.process is None or self.process.poll() is not None:
                self.process = subprocess.Popen(self.config.command, cwd=self.root, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
            line = json.dumps({"model": self.config.model, "dimensions": self.config.dimensions, "inputs": [{"id": i, "text": t} for i, t in zip(ids, texts, strict=True)]}) + "\n"
            self.process.stdin.write(line.encode())
            self.process.stdin.flush()
            answer = json.loads(self._line())
            if not isinstance(answer, dict) or "vectors" not in answer:
                raise ProviderError(str(answer)[:MAX_DETAIL])
            return checked(ids, answer["vectors"], self.config.dimensions)
        except (OSError, ValueError, ProviderError) as e:
            self.close()
            raise e if isinstance(e, ProviderError) else ProviderError(str(e)[:MAX_DETAIL]) from e

    def _line(self) -> bytes:
        end, data, out = time.monotonic() + self.config.timeoutMs / 1000, b"", self.process.stdout
        with selectors.DefaultSelector() as waiting:
            waiting.register(out, selectors.EVENT_READ)
            while not data.endswith(b"\n"):
                if not waiting.select(max(0.0, end - time.monotonic())):
                    raise ProviderError("the provider is late")
                part = os.read(out.fileno(), 1 << 16)
                data += part
                if not part or len(data) > MAX_ANSWER:
                    raise ProviderError("the provider ended" if not part else "the provider's answer is too long")
        return data

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            self.process.stdin.close()
            self.process.stdout.close()
            self.process = None

    def __reduce__(self):
        return CommandProvider, (self.config, self.root)  # each task starts its own process


class HttpProvider:
    """An embeddings service of the common form: {model, input} gives {data: [{index, embedding}]}.

    One more try after a broken connection, 429, 529 or a server's failure."""

    def __init__(self, config: Embedding):
        self.config = config

    def __call__(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"}
        if self.config.apiKeyEnv:
            headers["Authorization"] = f"Bearer {os.environ.get(self.config.apiKeyEnv, '')}"
        body = json.dumps({"model": self.config.model, "input": texts}).encode()
        for attempt in range(RETRIES + 1):
            try:
                request = urllib.request.Request(self.config.endpoint, body, headers)
                with urllib.request.urlopen(request, timeout=self.config.timeoutMs / 1000) as answer:
                    data = answer.read(MAX_ANSWER + 1)
                break
            except urllib.error.HTTPError as e:
                if attempt == RETRIES or not (e.code in (429, 529) or e.code >= 500):
                    raise ProviderError(f"HTTP {e.code}: {e.read(MAX_DETAIL).decode(errors='replace')}") from e
            except OSError as e:
                if attempt == RETRIES:
                    raise ProviderError(str(e)[:MAX_DETAIL]) from e
            time.sleep(BACKOFF_S * 2**attempt)
        if len(data) > MAX_ANSWER:
            raise ProviderError("the provider's answer is too long")
        try:
            values = [{"id": str(v["index"]), "vector": v["embedding"]} for v in json.loads(data)["data"]]
        except (ValueError, KeyError, TypeError) as e:
            raise ProviderError("the provider's answer has another form") from e
        return checked([str(i) for i in range(len(texts))], values, self.config.dimensions)


def provider(config: Embedding, root: str = ".") -> Provider:
    config.check()
    return CommandProvider(config, root) if config.kind == "command" else HttpProvider(config)


def embed(inputs: DataFrame, provider: Provider, dimensions: int, batch: int = 64, prefix: str = "", most: int = 6000) -> DataFrame:
    """(input_hash, vector, error) of inputs(input_hash, input): batches within a task, checked for number and dimensions.

    Inputs of like length share a batch.  A task whose provider has failed asks it no more: what is
    left has the error as its diagnostic."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        error = None
        for frame in frames:
            frame = frame.iloc[frame["input"].str.len().argsort(kind="stable")]
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                got = [None] * len(part)
                if error is None:
                    try:
                        got = provider([(prefix + t)[:most] for t in part["input"]])
                        if len(got) != len(part) or any(len(v) != dimensions for v in got):
                            raise ProviderError("the provider's answer has other inputs or dimensions")
                    except Exception as e:  # a provider's failure is a diagnostic of its inputs
                        got, error = [None] * len(part), str(e)[:500] or type(e).__name__
                yield pd.DataFrame({"input_hash": part["input_hash"].to_numpy(), "vector": got, "error": error})

    return inputs.select("input_hash", "input").mapInPandas(run, "input_hash string, vector array<float>, error string")


def lane_vectors(vectors: DataFrame, fingerprint: str) -> DataFrame:
    """The vectors of the one configuration that is live: those of another are of no use and go."""
    return vectors.where(F.col("fingerprint") == fingerprint)


def live_vectors(records: DataFrame, vectors: DataFrame, fingerprint: str) -> DataFrame:
    """Vectors that a search may use: of the live configuration and of what the record holds now."""
    return lane_vectors(vectors, fingerprint).join(records.select("record_id", "input_hash"), ["record_id", "input_hash"], "left_semi")
