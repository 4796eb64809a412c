"""The subset of YAML that configuration files use: nested maps and lists by indentation, plain and quoted scalars, inline lists."""

from __future__ import annotations

import re

_KEY = re.compile(r"^((?:\"[^\"]*\"|'[^']*'|[^\s\"'#:][^:]*?))\s*:(?:\s+(.*))?$")


class YamlError(ValueError):
    pass


def _uncommented(text: str) -> str:
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or text[i - 1].isspace()):
            return text[:i].rstrip()
    return text.rstrip()


def scalar(text: str) -> object:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("{}", ""):
        return {} if text else None
    if text in ("null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse(source: str) -> object:
    """A document as dicts, lists and scalars; an empty one is an empty dict."""
    lines = []
    for raw in source.splitlines():
        text = _uncommented(raw)
        if text.strip() and text.strip() != "---":
            if "\t" in text[: len(text) - len(text.lstrip())]:
                raise YamlError("tabs can't indent")
            lines.append((len(text) - len(text.lstrip()), text.strip()))
    out, at = _block(lines, 0, lines[0][0]) if lines else ({}, 0)
    if at < len(lines):
        raise YamlError(f"unexpected indentation at {lines[at][1]!r}")
    return out


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[object, int]:
    """The map or list that begins at a line of this indentation, and the line after it."""
    out: dict | list | None = None
    while at < len(lines) and lines[at][0] == indent:
        text = lines[at][1]
        if text == "-" or text.startswith("- "):
            out = [] if out is None else out
            if not isinstance(out, list):
                raise YamlError(f"a list item among keys: {text!r}")
            rest = text[1:].strip()
            if _KEY.match(rest):
                # the item's map goes on at the column of its first key
                inner = indent + len(text) - len(rest)
                lines[at] = (inner, rest)
                value, at = _block(lines, at, inner)
            elif rest:
                value, at = scalar(rest), at + 1
            else:
                value, at = _below(lines, at + 1, indent)
            out.append(value)
            continue
        m = _KEY.match(text)
        out = {} if out is None else out
        if not m or not isinstance(out, dict):
            raise YamlError(f"neither a key nor a list item: {text!r}")
        name = str(scalar(m[1])) if m[1][0] in "\"'" else m[1]
        if m[2]:
            out[name], at = scalar(m[2]), at + 1
        else:
            # a list may stand at its key's own indentation
            same = at + 1 < len(lines) and lines[at + 1][0] == indent and lines[at + 1][1].startswith("-")
            out[name], at = _block(lines, at + 1, indent) if same else _below(lines, at + 1, indent)
    return out, at


def _below(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[object, int]:
    if at < len(lines) and lines[at][0] > indent:
        return _block(lines, at, lines[at][0])
    return None, at


def _written(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return str(value)
    text = str(value)
    plain = re.fullmatch(r"[A-Za-z0-9_./ -]+", text) and text == text.strip() and isinstance(scalar(text), str) and not text.startswith("-")
    return text if plain else "'" + text + "'" if "'" not in text else '"' + text + '"'


def dump(value: object, indent: int = 0) -> str:
    """The text ``parse`` reads back."""
    pad, out = " " * indent, []
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, dict | list | tuple) and v:
                out.append(f"{pad}{k}:\n{dump(v, indent + 2)}")
            else:
                out.append(f"{pad}{k}: {'[]' if isinstance(v, list | tuple) else '{}' if isinstance(v, dict) else _written(v)}\n")
    elif isinstance(value, list | tuple):
        for v in value:
            if isinstance(v, dict) and v:
                body = dump(v, indent + 2)
                out.append(f"{pad}- {body[indent + 2:]}")
            else:
                out.append(f"{pad}- {_written(v)}\n")
    return "".join(out)
