"""Language configurations: which extensions belong to which language and node kinds."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from trawl.functions.paths import EXTENSIONS
from trawl.sources import yaml


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class LanguageConfig:
    language: str
    extensions: tuple[str, ...]
    grammar: str
    class_nodes: tuple[str, ...] = ()
    method_nodes: tuple[str, ...] = ()
    name_field: str = "name"
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        for name in ("language", "extensions", "grammar"):
            if not getattr(self, name):
                raise ConfigError(f"a language configuration needs {name}")

    def matches(self, extension: str) -> bool:
        return extension.lower() in self.extensions


def parse(text: str) -> LanguageConfig:
    top = yaml.parse(text)
    if not isinstance(top, dict):
        raise ConfigError("a language configuration is a map")
    chunks = top.get("chunk_mappings") or top.get("chunks") or {}

    def listed(value: object) -> tuple[str, ...]:
        return tuple(str(v) for v in (value if isinstance(value, list) else [value] if value else []))

    grammar = (top.get("tree_sitter") or {}).get("grammar") if isinstance(top.get("tree_sitter"), dict) else top.get("grammar")
    extraction = top.get("extraction") or {}
    return LanguageConfig(
        str(top.get("language") or ""),
        tuple(e.lower() for e in listed(top.get("extensions"))),
        str(grammar or ""),
        listed(chunks.get("class")),
        listed(chunks.get("method")),
        str(extraction.get("name_field") or "name"),
        top,
    )


def load(folder: str) -> tuple[list[LanguageConfig], list[str]]:
    """Every configuration of a folder, and the names of files that aren't valid."""
    good, bad = [], []
    for p in sorted(Path(folder).glob("*.y*ml")):
        try:
            good.append(parse(p.read_text()))
        except (ConfigError, yaml.YamlError, AttributeError, TypeError):
            bad.append(p.name)
    return good, bad


def builtin() -> list[LanguageConfig]:
    return [LanguageConfig(lang, tuple(exts), lang) for lang, exts in EXTENSIONS.items()]


def as_table(spark: SparkSession, configs: list[LanguageConfig]) -> DataFrame:
    """(extension, language): a small dimension to join on."""
    return spark.createDataFrame([(e, c.language) for c in configs for e in c.extensions], "extension string, language string")
