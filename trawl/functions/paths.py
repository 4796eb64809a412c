"""Paths: globs, ignore rules, prefixes, languages, markers and slugs.

Patterns are compiled to Java regular expressions on the driver, so that every filter is
one column expression. Paths are relative with forward slashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory in which an index keeps its state; never indexed.
STATE_DIR = ".trawl"
MAX_FILE_SIZE = 1 << 20
# Languages by file extension.
EXTENSIONS = {
    "bash": [".sh", ".bash", ".bashrc", ".zsh", ".zshrc"], "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h++"],
    "csharp": [".cs"], "css": [".css"], "cue": [".cue"], "dockerfile": [".dockerfile"], "elixir": [".ex", ".exs"], "elm": [".elm"], "go": [".go"],
    "groovy": [".groovy", ".gradle"], "hcl": [".hcl", ".tf", ".tfvars"], "html": [".html", ".htm"], "java": [".java"],
    "javascript": [".js", ".mjs", ".cjs"], "jsx": [".jsx"], "kotlin": [".kt", ".kts"], "lua": [".lua"], "markdown": [".md", ".markdown", ".mdx"],
    "ocaml": [".ml", ".mli"], "php": [".php", ".phtml", ".php3", ".php4", ".php5", ".phps"], "protobuf": [".proto"], "python": [".py", ".pyi", ".pyw"],
    "ruby": [".rb", ".rake", ".gemspec"], "rust": [".rs"], "scala": [".scala", ".sc"], "sql": [".sql"], "svelte": [".svelte"], "swift": [".swift"],
    "toml": [".toml"], "tsx": [".tsx"], "typescript": [".ts", ".mts", ".cts"], "yaml": [".yaml", ".yml"],
}
LANGUAGE_OF = {ext: lang for lang, exts in EXTENSIONS.items() for ext in exts}
#: directories that language detection skips, besides hidden ones
DETECT_SKIPS = ["node_modules", "vendor", "dist", "build"]
MINIFIED_ENDS = [".min.js", ".min.css", ".bundle.js", ".bundle.css"]
#: marker -> (priority, language); a star matches any name with that ending
MARKERS = {
    "*.sln": (1, "csharp"), "*.csproj": (2, "csharp"), "go.mod": (2, "go"), "Cargo.toml": (2, "rust"), "pom.xml": (2, "java"),
    "build.gradle": (2, "java"), "package.json": (3, "javascript"), "pyproject.toml": (3, "python"), "setup.py": (3, "python"),
}
NO_PRIORITY = 999
MORE_HINTS = {"go.sum": "go", "tsconfig.json": "typescript", "requirements.txt": "python"}
HINT_ENDS = {".sln": "csharp", ".csproj": "csharp", ".fsproj": "csharp", ".vbproj": "csharp"}
SUBPROJECT_EXCLUDES = ["node_modules", "vendor", ".git", STATE_DIR, "dist", "build", "bin", "obj", ".venv", "__pycache__", ".npm", ".pnpm"]


def normalize(path: Column) -> Column:
    slashes = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(slashes, r"^(\./)+", ""), "(?<=.)/$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.[^.]*$", 0))


def _segment(glob: str) -> str:
    """A glob within one segment as a regular expression."""
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob)


def glob_regex(glob: str) -> str:
    """``**/x`` matches at any depth, ``p/**/x`` below p, ``p/**`` p and all below; ``*`` stays in a segment."""
    head, star, tail = glob.partition("**")
    if not star:
        return f"^{_segment(glob)}$"
    head, tail = head.rstrip("/"), tail.lstrip("/")
    start = f"^{_segment(head)}" if head else "^"
    if not tail:
        return f"{start}(/.*)?$" if head else "^.*$"
    between = "/(.*/)?" if head else "(.*/)?"
    if "**" in tail:
        return f"{start}{between}{glob_regex(tail).strip('^').rstrip('$')}$"
    return f"{start}{between}{_segment(tail)}$"


def any_glob(path: Column, globs: Iterable[str]) -> Column:
    patterns = [glob_regex(g) for g in globs]
    return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def included(path: Column, include: Iterable[str], exclude: Iterable[str] = ()) -> Column:
    """An exclusion wins; else some inclusion must match."""
    return ~any_glob(path, exclude) & any_glob(path, include)


def scanner_included(path: Column, include: Iterable[str]) -> Column:
    """The start-up scan's own rule: ``**/x`` and plain globs look at the base name only, other ``**`` never match."""
    tests = F.lit(False)
    for g in include:
        name = g.removeprefix("**/")
        if "**" not in name:
            tests = tests | base_name(path).rlike(f"^{_segment(name)}$")
    return tests


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    negated: bool = False
    directory: bool = False

    @classmethod
    def parse(cls, line: str) -> IgnoreRule | None:
        line = line.strip()
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line.removeprefix("!")
        return cls(line.removesuffix("/"), negated, line.endswith("/"))

    def regex(self) -> str:
        p = self.pattern
        if "**" in p:
            options = []
            if p.startswith("**/"):
                rest = p[3:]
                if rest.endswith("/**"):
                    options.append(f"(^|.*/){re.escape(rest[:-3])}/+[^/].*")
                options.append(f"(^|.*/){_segment(rest.replace('**', '*'))}")
            elif p.endswith("/**"):
                options.append(f"{re.escape(p[:-3])}(/.*)?")
            return "^(?:" + "|".join(options or ["(?!)"]) + ")$"
        if self.directory:
            return f"(^|/){re.escape(p)}(/|$)|^{re.escape(p)}" if "/" in p else f"(^|/){re.escape(p)}(/|$)"
        if "/" in p:
            return f"(^|/){re.escape(p)}"
        if "*" in p:
            return f"(^|/){_segment(p)}(/|$)"
        return f"(^|/){re.escape(p)}$"


def ignore_rules(*sources: Iterable[str]) -> list[IgnoreRule]:
    """The state directory first, then each source's lines in order (ignore files, then configuration)."""
    lines = [f"{STATE_DIR}/", *[line for s in sources for line in s]]
    return [r for r in map(IgnoreRule.parse, lines) if r]


def ignored(path: Column, rules: Iterable[IgnoreRule]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for r in rules:
        out = F.when(path.rlike(r.regex()), not r.negated).otherwise(out)
    return out


def readable_size(size: Column, most: int = MAX_FILE_SIZE) -> Column:
    return (size > 0) & (size <= most)


def has_prefix(path: Column, prefix: str) -> Column:
    """Whole components: the prefix itself or something below it."""
    p = prefix.rstrip("/")
    return F.lit(True) if p in ("", ".") else (path == p) | path.startswith(p + "/")


def like_prefix(path: Column, prefix: str) -> Column:
    """SQL LIKE: case-insensitive, % and _ of the prefix are wildcards."""
    return path.ilike(prefix.replace("\\", "\\\\") + "%")


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def skipped_in_detection(path: Column) -> Column:
    return path.rlike(r"(^|/)\.[^/]") | path.rlike(rf"(^|/)({'|'.join(DETECT_SKIPS)})/")


def in_excluded_directory(path: Column, excludes: Iterable[str] = tuple(SUBPROJECT_EXCLUDES)) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in excludes]))


def _marker_case(name: Column, value: int) -> Column:
    out = None
    for pattern, found in MARKERS.items():
        test = name.endswith(pattern[1:]) if pattern.startswith("*") else name == pattern
        out = F.when(test, found[value]) if out is None else out.when(test, found[value])
    return out


def marker_priority(name: Column) -> Column:
    """Null where the name is no marker; lower is stronger."""
    return _marker_case(name, 0)


def language_hint(name: Column) -> Column:
    """Language of a marker file, empty if unknown."""
    out = F.coalesce(_marker_case(name, 1), F.lit(""))
    for n, lang in MORE_HINTS.items():
        out = F.when(name == n, lang).otherwise(out)
    for end, lang in HINT_ENDS.items():
        out = F.when(F.lower(name).endswith(end), lang).otherwise(out)
    return out


def subproject_slug(path: Column) -> Column:
    """Detected subprojects: the last component, lower case, anything odd becomes a dash."""
    return F.regexp_replace(F.lower(base_name(path)), "[^a-z0-9-]", "-")


def path_slug(path: Column) -> Column:
    """Declared subprojects: separators and dots of the whole path become dashes."""
    return F.regexp_replace(path, r"[/\\.]", "-")


def contains_path(subproject: Column, path: Column) -> Column:
    return (subproject == ".") | (path == subproject) | path.startswith(F.concat(subproject, F.lit("/")))
