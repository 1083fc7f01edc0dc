"""The part of YAML that lists of records use: a sequence of mappings of scalars and sequences of scalars.

Scalars are plain, in single or double quotes, or blocks (``|`` keeps line ends, ``>`` folds them; ``-``
and ``+`` say what becomes of the last ones). Sequences are indented or flow (``[a, b]``). Comments and
empty lines are left out. Anything else, anchors and nested mappings among it, is an error.
"""

from __future__ import annotations

import re

_ENTRY = re.compile(r"( *)(- +)?([A-Za-z_][\w\-]*):(?:[ \t]+(.*))?$")
_ITEM = re.compile(r"( *)-(?:[ \t]+(.*))?$")
_BLOCK = re.compile(r"([|>])([+-]?)(?:[ \t]+#.*)?$")
# YAML's escapes in double quotes.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " ", "e": "\x1b", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def scalar(raw: str) -> str | None:
    """The value of a scalar on one line; null for nothing, ``~`` and ``null``."""
    raw = raw.strip()
    if raw[:1] == '"':
        m = re.match(r'"((?:[^"\\]|\\.)*)"\s*(?:#.*)?$', raw)
        if not m:
            raise ValueError(f"an open quote: {raw}")
        return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else _ESCAPES.get(e[3], e[3]), m[1])
    if raw[:1] == "'":
        m = re.match(r"'((?:[^']|'')*)'\s*(?:#.*)?$", raw)
        if not m:
            raise ValueError(f"an open quote: {raw}")
        return m[1].replace("''", "'")
    plain = re.sub(r"(?:^|\s+)#.*$", "", raw)
    if plain[:1] in ("&", "*", "!", "{", "%", "@", "`"):
        raise ValueError(f"not a plain value: {raw}")
    return None if plain in ("", "~", "null") else plain


def _flow(raw: str) -> list[str | None]:
    """The items of [a, "b, c"]."""
    body = re.match(r"\[(.*)\]\s*(?:#.*)?$", raw)
    if not body:
        raise ValueError(f"an open list: {raw}")
    parts = re.findall(r'\s*("(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|[^,]+)\s*(?:,|$)', body[1])
    return [scalar(p) for p in parts if p.strip()]


def _block(lines: list[str], at: int, indent: int, style: str, end: str) -> tuple[str, int]:
    """The text of a block scalar whose lines are deeper than indent, and the place after it."""
    own: list[str] = []
    while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip(" ")) > indent):
        own.append(lines[at])
        at += 1
    depth = min((len(x) - len(x.lstrip(" ")) for x in own if x.strip()), default=0)
    body = [x[depth:] for x in own]
    kept = len(body)
    while kept and not body[kept - 1].strip():
        kept -= 1
    if style == "|":
        text = "\n".join(body[:kept])
    else:
        text = re.sub(r"(?<=[^\n ])\n(?=[^\n ])", " ", "\n".join(body[:kept]))
        text = re.sub(r"\n(\n+)", r"\1", text)
    return text + ("" if end == "-" or not kept else "\n" * (len(body) - kept + 1) if end == "+" else "\n"), at


def records(text: str) -> list[dict[str, str | list[str | None] | None]]:
    """The mappings of a sequence of them."""
    lines = text.replace("\r\n", "\n").split("\n")
    out: list[dict[str, str | list[str | None] | None]] = []
    at, name, deep = 0, "", -1
    while at < len(lines):
        line = lines[at]
        at += 1
        if not line.strip() or line.lstrip().startswith("#") or line.strip() in ("---", "..."):
            continue
        entry, item = _ENTRY.match(line), _ITEM.match(line)
        if entry and (entry[2] or not item):
            if entry[2]:
                out.append({})
            if not out:
                raise ValueError(f"a field outside of a list: {line}")
            name, deep, raw = entry[3], len(entry[1]) + len(entry[2] or ""), (entry[4] or "").strip()
            if name in out[-1]:
                raise ValueError(f"{name} is there twice")
            if m := _BLOCK.match(raw):
                out[-1][name], at = _block(lines, at, deep, m[1], m[2])
            elif raw.startswith("["):
                out[-1][name] = _flow(raw)
            else:
                out[-1][name] = scalar(raw)
        elif item and out and name and len(item[1]) >= deep:
            held = out[-1][name]
            if held is None:
                held = out[-1][name] = []
            if not isinstance(held, list):
                raise ValueError(f"{name} is both a value and a list")
            raw = (item[2] or "").strip()
            if m := _BLOCK.match(raw):
                value, at = _block(lines, at, len(item[1]), m[1], m[2])
            else:
                value = scalar(raw)
            held.append(value)
        else:
            raise ValueError(f"not a record's line: {line}")
    return out
