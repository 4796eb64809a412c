"""Where source text declares classes and methods.

Python is parsed by its own ``ast``. The other languages are scanned for declarations at line
starts, after literals and comments were blanked out; a declaration ends at the brace that
closes it, at the ``end`` of its indentation, or before the next line that isn't indented
deeper. A class belongs to its file, however nested; a method to its innermost class;
methods aren't searched further. A declaration of any length is matched whole.

Other known languages have no declarations here: they are chunked as whole files.
"""

from __future__ import annotations

import ast
import bisect
import re
from typing import NamedTuple

from trawl.shipping import ship

ship(__name__)


class Declaration(NamedTuple):
    """start and end are places in the text; parent is the place of the class in the list, or -1."""

    level: str
    name: str
    start: int
    end: int
    parent: int


# --- how declarations begin ----------------------------------------------------------------

_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|virtual|override|readonly|open|fileprivate|mutating|indirect|lazy|implicit|case|pub(?:\([a-z]+\))?|unsafe|const|inline|extern)\s+)*"
_EXPORT = r"(?:export\s+)?(?:default\s+)?"
_NOT = r"(?!(?:if|for|foreach|while|switch|catch|using|lock|return|synchronized|function|else|new|throw|do|elseif|match)\b)"
_ARGS = r"\s*\([^;{]*\)\s*"
_TYPE = r"(?:(?!(?:return|new|else|throw)\b)[\w<>\[\],.?]+\s+)?"
_C_NAME = rf"(?:[\w:<>,~]+[\s*&]+)*?(?P<name>[*&]*{_NOT}[\w:~]+\s*\([^;{{}}]*\)(?:\s*(?:const|noexcept|override|final))*)\s*(?::[^;{{]*)?\{{"

#: language: (classes, methods), as patterns at line starts
BEGINNINGS = {
    "go": ([r"type\s+(?=(?P<name>\w+)\s+(?:struct|interface)\b)", r"(?P<group>)(?=(?P<name>\w+)\s+(?:struct|interface)\b)"], [r"(?=func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*[\[(])"]),
    "javascript": ([rf"{_EXPORT}(?=(?:abstract\s+)?class\s+(?P<name>\w+))"], [rf"{_EXPORT}(?=(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*\()", rf"(?=(?:(?:static|async|get|set)\s+)*\*?(?P<name>{_NOT}[#\w$]+){_ARGS}\{{)"]),
    "java": ([rf"(?={_MODIFIERS}(?:class|interface|enum|record|@interface)\s+(?P<name>\w+))"], [rf"(?={_MODIFIERS}(?:<[^>]+>\s*)?{_TYPE}(?P<name>{_NOT}\w+){_ARGS}(?:throws\s+[\w.,\s]+)?\{{)"]),
    "csharp": ([rf"(?={_MODIFIERS}(?:class|struct|interface|enum|record(?:\s+struct)?)\s+(?P<name>\w+))"], [rf"(?={_MODIFIERS}{_TYPE}(?P<name>{_NOT}\w+){_ARGS}(?::\s*(?:base|this)\([^)]*\)\s*)?\{{)", rf"(?={_MODIFIERS}(?:(?!(?:return|new|else|throw|class|struct|interface|enum|record|namespace)\b)[\w<>\[\],.?]+\s+)(?P<name>\w+)\s*\{{\s*(?:(?:private|protected|internal)\s+)?(?:get|set|init)\b)"]),
    "rust": ([rf"(?={_MODIFIERS}(?:struct|enum|trait|union)\s+(?P<name>\w+))"], [rf"(?={_MODIFIERS}fn\s+(?P<name>\w+))"]),
    "php": ([rf"(?={_MODIFIERS}(?:class|interface|trait|enum)\s+(?P<name>\w+))"], [rf"(?={_MODIFIERS}function\s+&?\s*(?P<name>\w+)\s*\()"]),
    "swift": ([rf"(?={_MODIFIERS}(?:class|struct|enum|extension|actor|protocol)\s+(?!func\b)(?P<name>[\w.]+))"], [rf"(?={_MODIFIERS}(?:class\s+)?func\s+(?P<name>\w+))", rf"(?={_MODIFIERS}(?P<name>init)\s*[?!]?\s*[<(])"]),
    "groovy": ([rf"(?={_MODIFIERS}(?:class|interface|enum|trait)\s+(?P<name>\w+))"], [rf"(?={_MODIFIERS}(?:def\s+|{_TYPE})(?P<name>{_NOT}\w+){_ARGS}\{{)"]),
    "scala": ([rf"(?={_MODIFIERS}(?:class|object|trait|enum)\s+(?P<name>\w+))"], [rf"(?={_MODIFIERS}def\s+(?P<name>[^\s(\[:=]+))"]),
    "ruby": ([r"(?=(?:class|module)\s+(?P<name>[\w:]+))"], [r"(?=def\s+(?:self\.|[A-Z]\w*\.)?(?P<name>[^\s(;=]+[?!=]?))"]),
    "lua": ([], [r"(?=(?:local\s+)?function\s+(?P<name>[\w.:]+)\s*\()"]),
    "bash": ([], [r"(?=(?:function\s+)(?P<name>[\w.:-]+)\s*(?:\(\s*\))?\s*\{?)", r"(?=(?P<name>[\w.:-]+)\s*\(\s*\)\s*\{?)"]),
    "c": ([], [rf"(?={_C_NAME})"]),
}
BEGINNINGS["typescript"] = (
    [*BEGINNINGS["javascript"][0], rf"{_EXPORT}(?=interface\s+(?P<name>\w+))", rf"{_EXPORT}(?=type\s+(?P<name>\w+)(?:<[^=]*>)?\s*=)"],
    [*BEGINNINGS["javascript"][1], rf"(?={_MODIFIERS}(?P<name>{_NOT}[#\w$]+)(?:<[^>]*>)?{_ARGS}(?::\s*[^;{{]+)?\{{)"],
)
BEGINNINGS["jsx"], BEGINNINGS["tsx"], BEGINNINGS["cpp"] = BEGINNINGS["javascript"], BEGINNINGS["typescript"], BEGINNINGS["c"]
BY_END, BY_INDENT = ("ruby", "lua"), ("scala",)
_COMPILED = {lang: [(kind, re.compile(rf"[ \t]*{p}")) for kind, ps in (("class", c), ("method", m)) for p in ps] for lang, (c, m) in BEGINNINGS.items()}
PARSED = ("python", *BEGINNINGS)

_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_SLASHES = r"//[^\n]*|/\*.*?\*/"
_HASH = r"(?:(?<=\s)|^)#[^\n]*"
#: literals and comments, by language
_LITERALS = {lang: re.compile(p, re.S | re.M) for lang, p in {
    "": rf"{_STRINGS}|`[^`]*`|{_SLASHES}",
    # an apostrophe of Rust may begin a lifetime
    "rust": rf"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'|{_SLASHES}",
    "php": rf"{_STRINGS}|{_SLASHES}|{_HASH}",
    "ruby": rf"{_STRINGS}|{_HASH}|^=begin\b.*?^=end\b",
    "lua": rf"{_STRINGS}|--\[\[.*?\]\]|--[^\n]*|\[\[.*?\]\]",
    "bash": rf"\"(?:\\.|[^\"\\])*\"|'[^']*'|{_HASH}|\$\{{[^}}\n]*\}}",
    "scala": rf"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|{_SLASHES}",
}.items()}
_MARKS = re.compile(r"[{};]")
_STOP = re.compile(r"[{;]")
_OPENS = re.compile(r"\s*\{")
_ROUND = re.compile(r"->|[()<>\[\]{\n]")
_GROUP = re.compile(r"^type\s*\(\s*$")


# --- Python --------------------------------------------------------------------------------


def python_declarations(text: str) -> list[Declaration]:
    """Classes and functions without their decorators; nothing of a text that doesn't parse."""
    out: list[Declaration] = []
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)

    def place(line: int, column: int) -> int:
        """Columns count bytes."""
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))

    def walk(body: list, parent: int) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(node, ast.ClassDef)
                start, end = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
                out.append(Declaration("class" if is_class else "method", node.name, start, end, -1 if is_class else parent))
                if is_class:
                    walk(node.body, len(out) - 1)
                continue
            for part in ("body", "orelse", "finalbody"):
                walk(getattr(node, part, None) or [], parent)
            for part in ("handlers", "cases"):
                for x in getattr(node, part, None) or []:
                    walk(x.body, parent)

    try:
        walk(ast.parse(text).body, -1)
    except (SyntaxError, ValueError, RecursionError, IndexError):
        return []
    return out


# --- other languages -----------------------------------------------------------------------


class _Scan:
    def __init__(self, text: str, language: str):
        blank = lambda m: re.sub(r"[^\n]", " ", m[0])  # noqa: E731  what is blanked out keeps its place
        self.bare = _LITERALS.get(language, _LITERALS[""]).sub(blank, text)
        self.lines = self.bare.split("\n")
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)
        # a beginning reaches to the brace or semicolon that follows it, however far that is
        self.stops = [m.end() for m in _STOP.finditer(self.bare)]

    def limit(self, n: int) -> int:
        at = bisect.bisect_right(self.stops, self.starts[n])
        line_end = self.starts[n + 1] - 1
        return max(self.stops[at], line_end) if at < len(self.stops) else line_end

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def bodiless(self, at: int) -> int | None:
        """Where a declaration ends that no brace follows: its line, if all its parentheses are closed there."""
        depth = 0
        for m in _ROUND.finditer(self.bare, at):
            if m[0] in "(<[":
                depth += 1
            elif m[0] in ")>]":
                depth -= 1
            elif m[0] == "\n" and depth <= 0:
                return None if _OPENS.match(self.bare, m.end()) else m.start()
            elif m[0] == "{":
                return None
        return len(self.bare.rstrip())

    def closing_brace(self, at: int) -> int:
        """Behind the brace that closes the first one from ``at`` on, or the semicolon before any."""
        depth = 0
        for m in _MARKS.finditer(self.bare, at):
            if m[0] == "{":
                depth += 1
            elif m[0] == "}":
                depth -= 1
                if depth <= 0:
                    return m.end()
            elif depth == 0:
                return m.start()
        return len(self.bare.rstrip())

    def _indent(self, n: int) -> int:
        return len(self.lines[n]) - len(self.lines[n].lstrip())

    def closing_end(self, n: int) -> int:
        """Behind the ``end`` at the indentation of line n; a line that says ``end`` itself, or is an assignment, is all."""
        own, indent = self.lines[n], self._indent(n)
        if re.search(r"\bend\s*$", own) or re.match(r"\s*def\s+[^\s(]+(?:\([^)]*\))?\s*=\s", own):
            return self.starts[n] + len(own.rstrip())
        for k in range(n + 1, len(self.lines)):
            if self._indent(k) == indent and re.match(r"\s*end\b", self.lines[k]):
                return self.starts[k] + indent + 3
        return len(self.bare.rstrip())

    def closing_indent(self, n: int) -> int:
        """Behind the last line that is indented deeper than line n, and a brace at its indentation."""
        last = n
        for k in range(n + 1, len(self.lines)):
            if not self.lines[k].strip():
                continue
            if self._indent(k) <= self._indent(n):
                if self._indent(k) == self._indent(n) and self.lines[k].lstrip()[0] in "})":
                    last = k
                break
            last = k
        return self.starts[last] + len(self.lines[last].rstrip())


def scanned(text: str, language: str) -> list[Declaration]:
    s, out, open_, skip, group = _Scan(text, language), [], [], -1, False
    for n, line in enumerate(s.lines):
        if language == "go":
            group = bool(_GROUP.match(line)) or (group and not line.startswith(")"))
        if n <= skip or not line.strip():
            continue
        while open_ and s.starts[n] >= open_[-1][1]:
            open_.pop()
        at, stop = s.starts[n], s.limit(n)
        for kind, pattern in _COMPILED[language]:
            m = pattern.match(s.bare, at, stop)
            if not m or m.start("name") > at + len(line) or ("group" in pattern.groupindex and not group):
                continue
            start = m.end()
            if language in BY_END:
                end = s.closing_end(n)
            elif language in BY_INDENT:
                end = s.closing_indent(n)
            else:
                end = (s.bodiless(m.end("name")) if language == "swift" else None) or s.closing_brace(m.end("name"))
            name = text[m.start("name") : m.end("name")].strip()
            if kind == "class":
                out.append(Declaration("class", name, start, end, -1))
                open_.append((len(out) - 1, end))
            else:
                out.append(Declaration("method", name, start, end, open_[-1][0] if open_ else -1))
                skip = s.line(end - 1)
            break
    return out


def declarations(text: str, language: str) -> list[Declaration]:
    if language == "python":
        return python_declarations(text)
    return scanned(text, language) if language in _COMPILED else []
