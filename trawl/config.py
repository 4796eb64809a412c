"""Settings with validation and layered merging."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any
from urllib.parse import urlsplit

from trawl.sources import yaml


class ConfigError(ValueError):
    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


# Chunk levels and search defaults.
LEVELS = ("file", "class", "section", "method", "block", "line")


@dataclass(frozen=True)
class HybridConfig:
    enabled: bool = True
    rrf_k: int = 60
    vector_weight: float = 1.0
    keyword_weight: float = 1.0


@dataclass(frozen=True)
class RerankConfig:
    enabled: bool = True
    candidates: int = 20
    timeout_ms: int = 2000


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = ("**/*.py", "**/*.js", "**/*.ts", "**/*.go", "**/*.java", "**/*.cs", "**/*.rs")
    exclude: tuple[str, ...] = ("**/node_modules/**", "**/vendor/**", "**/dist/**")
    chunk_levels: tuple[str, ...] = ("method", "class", "file")
    max_file_size: int = 1 << 20
    max_tokens: int = 8000
    debounce_ms: int = 500
    default_limit: int = 10
    default_levels: tuple[str, ...] = ()
    provider: str = "mock"
    model: str = ""
    url: str = ""
    key: str = ""
    cache_size: int = 1000
    auto_detect: bool = True
    #: declared subprojects: (id, path, name), the id and name may be blank
    subprojects: tuple[tuple[str, str, str], ...] = ()
    request_ms: int = 120_000
    hybrid: HybridConfig = field(default_factory=HybridConfig)
    rerank: RerankConfig = field(default_factory=RerankConfig)

    def __post_init__(self) -> None:
        bad = []
        if not self.include:
            bad.append("include needs a pattern")
        bad += [f"unknown level {x}" for x in (*self.chunk_levels, *self.default_levels) if x not in LEVELS]
        bad += [f"{n} must be positive" for n in ("max_file_size", "max_tokens", "default_limit", "cache_size", "request_ms") if getattr(self, n) <= 0]
        bad += [f"subproject {p!r} needs a path" for p in self.subprojects if not p[1]]
        if self.debounce_ms < 0:
            bad.append("debounce_ms can't be negative")
        if self.hybrid.rrf_k <= 0 or self.rerank.candidates <= 0:
            bad.append("rrf_k and candidates must be positive")
        if bad:
            raise ConfigError(bad)

    def merge(self, *layers: dict[str, Any]) -> Config:
        """Later layers win; nested sections merge field by field. Unknown keys are errors."""
        out = self
        for layer in layers:
            known = {f.name for f in fields(Config)}
            if unknown := sorted(set(layer) - known):
                raise ConfigError([f"unknown setting {k}" for k in unknown])
            changes = {}
            for k, v in layer.items():
                now = getattr(out, k)
                if isinstance(now, HybridConfig | RerankConfig):
                    changes[k] = replace(now, **v)
                else:
                    changes[k] = tuple(v) if isinstance(now, tuple) else v
            out = replace(out, **changes)
        return out

    def get(self, key: str) -> Any:
        """A dotted key such as ``hybrid.rrf_k``."""
        value: Any = self
        for part in key.split("."):
            if not hasattr(value, part):
                raise ConfigError([f"unknown setting {key}"])
            value = getattr(value, part)
        return value

    def set(self, key: str, value: Any) -> Config:
        """A copy with one dotted key changed; text becomes the setting's type."""
        now = self.get(key)
        if isinstance(value, str) and not isinstance(now, str):
            value = yaml.scalar(value)
        if isinstance(now, tuple):
            value = tuple(value) if isinstance(value, list | tuple) else (value,)
        elif isinstance(now, float) and isinstance(value, int):
            value = float(value)
        if type(value) is not type(now):
            raise ConfigError([f"{key} is {type(now).__name__}"])
        section, _, name = key.partition(".")
        return self.merge({section: {name: value}} if name else {key: value})

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


# Places of settings in configuration files, and hosts of this machine.
FILE_KEYS = {
    "include": "include_patterns", "exclude": "exclude_patterns", "chunk_levels": "chunk_levels", "debounce_ms": "watcher.debounce_ms",
    "max_file_size": "watcher.max_file_size", "provider": "embedding.provider", "cache_size": "embedding.cache_size",
    "default_limit": "search.default_limit", "default_levels": "search.default_levels", "hybrid": "search.hybrid", "rerank": "search.reranker",
    "auto_detect": "subprojects.auto_detect", "subprojects": "subprojects.projects", "request_ms": "timeouts.api_request_ms",
}
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "")
CONFIG_NAME = "config.yaml"


def _at(tree: dict, dotted: str) -> Any:
    for part in dotted.split("."):
        tree = tree.get(part) if isinstance(tree, dict) else None
    return tree


def migrated(tree: dict) -> dict:
    """Files of before there were providers name a server and a model only: whether it is local says which provider they meant."""
    old = tree.get("embedding") or {}
    if old.get("provider") or not (old.get("ollama_url") or old.get("model")):
        return tree
    host = urlsplit(old.get("ollama_url") or "").hostname or ""
    provider = "ollama" if host.lower() in LOCAL_HOSTS else "ollama-remote"
    server = {**(old.get("ollama") or {}), **{k: v for k, v in (("url", old.get("ollama_url")), ("model", old.get("model"))) if v}}
    return {**tree, "embedding": {**old, "provider": provider, "ollama": server}}


def layer(tree: dict) -> dict[str, Any]:
    """A file's settings as a layer for ``merge``; blank values count as not given."""
    tree, out = migrated(tree), {}
    for name, place in FILE_KEYS.items():
        value = _at(tree, place)
        if value not in (None, "", [], {}):
            out[name] = value
    if "subprojects" in out:
        out["subprojects"] = [(p.get("id") or "", p.get("path") or "", p.get("name") or "") for p in out["subprojects"]]
    for section, kind in (("hybrid", HybridConfig), ("rerank", RerankConfig)):
        if section in out:
            known = {f.name for f in fields(kind)}
            out[section] = {k: v for k, v in out[section].items() if k in known and v is not None}
    provider = out.get("provider", "")
    own = _at(tree, f"embedding.{provider.removesuffix('-remote')}") or {}
    return out | {k: v for k, v in (("model", own.get("model")), ("url", own.get("url")), ("key", own.get("api_key"))) if v}


def load(project: str | None = None, user: str | None = None, **overrides: Any) -> Config:
    """Defaults, then the user's file, then the project's, then ``overrides``; files that aren't there are skipped."""
    layers = []
    for path in (user, project):
        if path and Path(path).is_file():
            tree = yaml.parse(Path(path).read_text()) or {}
            if not isinstance(tree, dict):
                raise ConfigError([f"{path} holds no settings"])
            layers.append(layer(tree))
    return Config().merge(*layers, overrides)


def save(config: Config, path: str) -> None:
    """Writes the settings in the form ``load`` reads."""
    tree: dict = {"version": 1}
    values = config.as_dict()
    for name, place in FILE_KEYS.items():
        *above, last = place.split(".")
        at = tree
        for part in above:
            at = at.setdefault(part, {})
        value = values[name]
        at[last] = [dict(zip(("id", "path", "name"), v, strict=True)) for v in value] if name == "subprojects" else list(value) if isinstance(value, tuple) else value
    own = {k: v for k, v in (("model", config.model), ("url", config.url), ("api_key", config.key)) if v}
    if own:
        tree["embedding"][config.provider.removesuffix("-remote")] = own
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_suffix(".new")
    draft.write_text(yaml.dump(tree))
    draft.replace(target)
