"""Configuration: a user's file and a repository's, read strictly, and the fingerprints that follow from it."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

#: Defaults, limits and versions.
SCHEMA = "skarn.config/v1"
CORE_VERSION, EMBEDDING_VERSION = "v3", "v3"
MAX_FILE_BYTES = 4 << 20
EXTRACTOR_TIMEOUT_MS, EMBEDDING_TIMEOUT_MS = 10_000, 2_000
BATCH_SIZE, INPUT_CHARS, MOST_INPUT_CHARS = 64, 6_000, 100_000
KINDS = ("command", "openai-compatible")


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass
class Plugin:
    id: str = ""
    version: str = ""
    command: list[str] = field(default_factory=list)
    includeGlobs: list[str] = field(default_factory=list)
    timeoutMs: int = 0

    def check(self) -> None:
        for name in ("id", "version", "command", "includeGlobs"):
            value = getattr(self, name)
            if not value or (name == "command" and not value[0]):
                raise ConfigError(f"plugin {self.id!r}: {name} is required")
        self.timeoutMs = self.timeoutMs if self.timeoutMs > 0 else EXTRACTOR_TIMEOUT_MS


@dataclass
class Embedding:
    kind: str = ""
    command: list[str] = field(default_factory=list)
    endpoint: str = ""
    model: str = ""
    dimensions: int = 0
    queryPrefix: str = ""
    documentPrefix: str = ""
    apiKeyEnv: str = ""
    timeoutMs: int = 0
    batchSize: int = 0
    maxInputChars: int = 0

    def check(self) -> None:
        if self.kind not in KINDS:
            raise ConfigError(f"unsupported embedding kind {self.kind!r}")
        if not self.model or self.dimensions <= 0:
            raise ConfigError("an embedding needs a model and dimensions over 0")
        needed = "command" if self.kind == "command" else "endpoint"
        value = getattr(self, needed)
        if not value or not value[0]:
            raise ConfigError(f"an embedding of kind {self.kind} needs {needed}")
        self.timeoutMs = self.timeoutMs if self.timeoutMs > 0 else EMBEDDING_TIMEOUT_MS
        self.batchSize = self.batchSize if self.batchSize > 0 else BATCH_SIZE
        self.maxInputChars = self.maxInputChars if self.maxInputChars > 0 else INPUT_CHARS
        if self.maxInputChars > MOST_INPUT_CHARS:
            raise ConfigError(f"maxInputChars is at most {MOST_INPUT_CHARS}")

    def query_text(self, text: str) -> str:
        return (self.queryPrefix + text)[: self.maxInputChars]

    def document_text(self, text: str) -> str:
        return (self.documentPrefix + text)[: self.maxInputChars]


@dataclass
class Config:
    ignoreGlobs: list[str] = field(default_factory=list)
    maxFileBytes: int = MAX_FILE_BYTES
    plugins: list[Plugin] = field(default_factory=list)
    embedding: Embedding | None = None
    embedding_source: str = ""
    embedding_disabled: bool = False

    def check(self) -> None:
        self.maxFileBytes = self.maxFileBytes if self.maxFileBytes > 0 else MAX_FILE_BYTES
        ids = [p.id for p in self.plugins]
        for p in self.plugins:
            p.check()
        if len(set(ids)) != len(ids):
            raise ConfigError("a plugin id occurs twice")
        if self.embedding is not None:
            self.embedding.check()


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ConfigError("a field occurs twice")
    return out


def _known(cls, value: object, where: str) -> dict:
    if not isinstance(value, dict):
        raise ConfigError(f"{where} must be an object")
    allowed = {f.name: str(f.type) for f in fields(cls)}
    for name, item in value.items():
        if name not in allowed:
            raise ConfigError(f"{where}: unknown field {name!r}")
        wanted = {"int": int, "str": str}.get(allowed[name], list)
        if type(item) is not wanted or (wanted is list and not all(isinstance(x, str) for x in item)):
            raise ConfigError(f"{where}: {name} must be of type {allowed[name]}")
    return value


def decode(data: bytes, allowed: tuple[str, ...]) -> dict:
    """One JSON object with known fields and the right schema; values behind it are refused."""
    try:
        raw = json.loads(data.decode(), object_pairs_hook=_object)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ConfigError(f"not one JSON value: {e}") from None
    if not isinstance(raw, dict) or raw.get("schema") != SCHEMA:
        raise ConfigError(f"the schema must be {SCHEMA}")
    if unknown := set(raw) - {"schema", *allowed}:
        raise ConfigError(f"unknown fields: {sorted(unknown)}")
    return raw


def _embedding(raw: dict) -> Embedding | None:
    value = raw.get("embedding")
    return None if value is None else Embedding(**_known(Embedding, value, "embedding"))


def load(root: str, user: str | None = None) -> Config:
    """The repository's configuration over the user's, whose embedding holds unless the repository names one or null.

    ``user`` is the user's file; by default skarn/config.json in the user's configuration folder."""
    home = os.environ.get("XDG_CONFIG_HOME") or str(Path.home() / ".config")
    user_path, path = Path(user or Path(home) / "skarn" / "config.json"), Path(root) / ".skarn" / "config.json"
    out = Config()
    if user_path.exists():
        out.embedding = _embedding(decode(user_path.read_bytes(), ("embedding",)))
        out.embedding_source = str(user_path) if out.embedding else ""
        out.check()
    if path.exists():
        raw = decode(path.read_bytes(), ("ignoreGlobs", "maxFileBytes", "plugins", "embedding"))
        _known(Config, {k: raw[k] for k in ("ignoreGlobs", "maxFileBytes") if k in raw}, str(path))
        out.ignoreGlobs, out.maxFileBytes = raw.get("ignoreGlobs", []), raw.get("maxFileBytes", MAX_FILE_BYTES)
        out.plugins = [Plugin(**_known(Plugin, p, "plugins")) for p in raw.get("plugins") or []]
        if "embedding" in raw:
            out.embedding = _embedding(raw)
            out.embedding_source = str(path) if out.embedding else ""
            out.embedding_disabled = out.embedding is None
        out.check()
    return out


def _digest(payload: dict) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(payload, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def extraction_fingerprint(config: Config) -> str:
    """What decides which records a file gives."""
    plugins = [asdict(p) for p in config.plugins]
    return _digest({"coreVersion": CORE_VERSION, "maxFileBytes": config.maxFileBytes, "ignoreGlobs": config.ignoreGlobs, "plugins": plugins})


def embedding_fingerprint(e: Embedding) -> str:
    """What decides which vector a text gets: not the prefix of queries, time limit, batch size or key."""
    told = {"command": e.command, "endpoint": e.endpoint, "documentPrefix": e.documentPrefix}
    chars = e.maxInputChars if e.maxInputChars > 0 else INPUT_CHARS
    return _digest({"behavior": EMBEDDING_VERSION, "kind": e.kind, "model": e.model, "dimensions": e.dimensions, "maxInputChars": chars} | {k: v for k, v in told.items() if v})
