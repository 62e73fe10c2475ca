"""Frontmatter: a reader and a writer for the part of YAML that pages use. Dates stay strings."""

from __future__ import annotations

import re

FENCE = re.compile(r"\A---[ \t]*\n(.*?)(?:^|\n)---[ \t]*(?:\n|\Z)", re.S | re.M)
_KEY = re.compile(r"""^(?P<key>"[^"]*"|'[^']*'|[^\s#:\[\]{},"'-][^:#]*?|-[^\s:][^:]*?)\s*:(?:\s+(?P<rest>.*)|)$""")
_WORDS = {"null": None, "~": None, "": None, "true": True, "false": False}
_INT, _FLOAT = re.compile(r"[-+]?(0|[1-9]\d*)\Z"), re.compile(r"[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?\Z")


class ParseError(ValueError):
    def __init__(self, message: str, line: int | None = None):
        super().__init__(f"line {line}: {message}" if line else message)
        self.line = line


def split(text: str) -> tuple[str | None, str]:
    """(frontmatter or None, body)."""
    m = FENCE.match(text)
    return (m[1], text[m.end() :]) if m else (None, text)


class _Flow:
    """Values on one line: scalars, quoted strings, [..] and {..}."""

    def __init__(self, text: str, line: int):
        self.text, self.at, self.line = text, 0, line

    def fail(self, what: str):
        raise ParseError(what, self.line)

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t":
            self.at += 1

    def value(self, ends: str = ""):
        self.space()
        c = self.text[self.at : self.at + 1]
        if c == "[":
            return self.items("]", self.value)
        if c == "{":
            return dict(self.items("}", self.pair))
        if c and c in "\"'":
            return self.quoted(c)
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ends:
            if self.text[self.at] == "#" and self.text[self.at - 1 : self.at] in ("", " ", "\t"):
                break
            self.at += 1
        return plain(self.text[start : self.at].strip())

    def pair(self, ends: str):
        self.space()
        if self.text[self.at : self.at + 1] in ("'", '"'):
            key = self.quoted(self.text[self.at])
            self.space()
        else:
            colon = self.text.find(":", self.at)
            if colon < 0:
                self.fail("a mapping needs a colon")
            key, self.at = self.text[self.at : colon].strip(), colon
        if self.text[self.at : self.at + 1] != ":":
            self.fail("a mapping needs a colon")
        self.at += 1
        return key, self.value(ends)

    def items(self, close: str, read) -> list:
        self.at += 1
        out: list = []
        while True:
            self.space()
            c = self.text[self.at : self.at + 1]
            if not c:
                self.fail(f"{close} is missing")
            if c == close:
                self.at += 1
                return out
            out.append(read("," + close))
            self.space()
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1
            elif self.text[self.at : self.at + 1] != close:
                self.fail(f"{close} is missing")

    def quoted(self, mark: str) -> str:
        out, i = [], self.at + 1
        while i < len(self.text):
            c = self.text[i]
            if mark == '"' and c == "\\" and i + 1 < len(self.text):
                out.append({"n": "\n", "t": "\t"}.get(self.text[i + 1], self.text[i + 1]))
                i += 2
            elif c == mark:
                if mark == "'" and self.text[i + 1 : i + 2] == "'":
                    out.append("'")
                    i += 2
                    continue
                self.at = i + 1
                return "".join(out)
            else:
                out.append(c)
                i += 1
        return self.fail("a quote is not closed")

    def whole(self):
        out = self.value()
        self.space()
        rest = self.text[self.at :]
        if rest and not rest.startswith("#"):
            self.fail(f"unexpected {rest!r}")
        return out


def plain(word: str):
    if word.lower() in _WORDS:
        return _WORDS[word.lower()]
    if _INT.match(word):
        return int(word)
    return float(word) if _FLOAT.match(word) else word


class _Blocks:
    """Nested block mappings, sequences and | > scalars by indentation."""

    def __init__(self, text: str):
        self.rows = [(i, len(raw) - len(raw.lstrip(" ")), raw) for i, raw in enumerate(text.split("\n"), 1)]
        for i, _, raw in self.rows:
            if raw.lstrip(" ").startswith("\t"):
                raise ParseError("a tab indents", i)
        self.at = 0

    def skip(self) -> None:
        while self.at < len(self.rows) and (not self.rows[self.at][2].strip() or self.rows[self.at][2].lstrip().startswith("#")):
            self.at += 1

    def node(self, least: int):
        self.skip()
        if self.at >= len(self.rows) or self.rows[self.at][1] < least:
            return None
        _, indent, raw = self.rows[self.at]
        body = raw.strip()
        return self.sequence(indent) if body == "-" or body.startswith("- ") else self.mapping(indent)

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while True:
            self.skip()
            if self.at >= len(self.rows):
                return out
            line, own, raw = self.rows[self.at]
            if own < indent:
                return out
            m = _KEY.match(raw.strip())
            if own > indent or not m:
                raise ParseError(f"cannot read {raw.strip()!r}", line)
            key = m["key"].strip("\"'")
            if key in out:
                raise ParseError(f"{key} is repeated", line)
            self.at += 1
            out[key] = self.after(m["rest"] or "", indent, line)

    def after(self, rest: str, indent: int, line: int):
        rest = rest.strip()
        if re.match(r"[|>][+-]?\d*\s*(#.*)?\Z", rest):
            return self.scalar(indent, rest)
        if rest and not rest.startswith("#"):
            return _Flow(rest, line).whole()
        self.skip()
        if self.at < len(self.rows) and self.rows[self.at][1] == indent and self.rows[self.at][2].strip().startswith("- "):
            return self.sequence(indent)
        return self.node(indent + 1)

    def sequence(self, indent: int) -> list:
        out: list = []
        while True:
            self.skip()
            if self.at >= len(self.rows):
                return out
            line, own, raw = self.rows[self.at]
            body = raw.strip()
            if own < indent or not (body == "-" or body.startswith("- ")):
                if own > indent:
                    raise ParseError(f"cannot read {body!r}", line)
                return out
            if own > indent:
                raise ParseError("a sequence changes its indentation", line)
            rest = body[1:].strip()
            if rest and _KEY.match(rest) and rest[0] not in "\"'[{":
                inner = own + len(raw.lstrip(" ")) - len(raw.lstrip(" ")[1:].lstrip(" "))
                self.rows[self.at] = (line, inner, " " * inner + rest)
                out.append(self.mapping(inner))
            else:
                self.at += 1
                out.append(self.after(rest, own, line))

    def scalar(self, indent: int, mark: str) -> str:
        lines, base = [], None
        while self.at < len(self.rows):
            _, own, raw = self.rows[self.at]
            if raw.strip() and own <= indent:
                break
            base = own if base is None and raw.strip() else base
            lines.append(raw[base:] if base is not None else "")
            self.at += 1
        while lines and not lines[-1].strip():
            lines.pop()
        text = "\n".join(lines) if mark[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(lines))
        return text if "-" in mark else text + "\n"


def parse(frontmatter: str) -> dict:
    blocks = _Blocks(frontmatter)
    out = blocks.node(0)
    blocks.skip()
    if blocks.at < len(blocks.rows):
        raise ParseError(f"cannot read {blocks.rows[blocks.at][2].strip()!r}", blocks.rows[blocks.at][0])
    if out is not None and not isinstance(out, dict):
        raise ParseError("frontmatter is no mapping", 1)
    return out or {}


_BARE = re.compile(r"[A-Za-z_/][\w ./()@+-]*\Z")


def emit_scalar(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if _BARE.match(v) and v == v.strip() and plain(v) == v:
        return v
    return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'


def emit(key: str, value, indent: int = 0) -> str:
    """`key: value` in block style, in the order given; reading it back gives the same value."""
    pad = " " * indent
    if isinstance(value, dict) and value:
        return f"{pad}{key}:\n" + "\n".join(emit(k, v, indent + 2) for k, v in value.items())
    if isinstance(value, (list, tuple)) and value:
        rows = []
        for v in value:
            if isinstance(v, dict) and v:
                body = "\n".join(emit(k, x, indent + 4) for k, x in v.items())
                rows.append(f"{pad}  - {body.lstrip()}")
            else:
                rows.append(f"{pad}  - {_empty(v)}")
        return f"{pad}{key}:\n" + "\n".join(rows)
    return f"{pad}{key}: {_empty(value)}"


def _empty(v) -> str:
    return "[]" if isinstance(v, (list, tuple)) else "{}" if isinstance(v, dict) else emit_scalar(v)


def replace_key(frontmatter: str, key: str, value) -> str:
    """The frontmatter with one top-level key replaced or appended; all other lines stay as they are."""
    block = emit(key, value)
    found = re.compile(rf"^{re.escape(key)}:.*(?:\n(?:[ \t-].*|[ \t]*(?=\n[ \t-])))*", re.M)
    if found.search(frontmatter):
        return found.sub(lambda m: block, frontmatter, count=1)
    return frontmatter.rstrip("\n") + ("\n" if frontmatter.strip() else "") + block
