"""Tokens of JavaScript and TypeScript: names, strings, templates and signs, without comments and white space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

_QUOTES = "'\""
_OPENS, _CLOSES = "([{", ")]}"


@dataclass(slots=True)
class Token:
    kind: str  # name, string, template or sign
    text: str  # a string's or template's content without its quotes
    line: int
    #: of a template: its literal parts and, between them, the expressions of its holes
    parts: list[str] = field(default_factory=list)
    holes: list[str] = field(default_factory=list)


def _starts_name(c: str) -> bool:
    return c.isalpha() or c in "_$"


def _template(text: str, at: int) -> tuple[Token, int] | None:
    """The template that begins at the backtick at `at`, and where it ends; a hole may hold braces of its own."""
    parts, holes, begin, i, n = [], [], at + 1, at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return Token("template", text[at + 1 : i], 0, [*parts, text[begin:i]], holes), i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            parts.append(text[begin:i])
            depth, j = 1, i + 2
            while j < n and depth:
                depth += (text[j] == "{") - (text[j] == "}")
                j += 1
            if depth:
                return None
            holes.append(text[i + 2 : j - 1].strip())
            begin = i = j
        else:
            i += 1
    return None


def _string(text: str, at: int) -> int:
    """Where the string that begins at `at` ends, or -1 if its line does first."""
    i, quote = at + 1, text[at]
    while i < len(text) and text[i] != "\n":
        if text[i] == "\\":
            i += 1
        elif text[i] == quote:
            return i + 1
        i += 1
    return -1


def tokens(text: str) -> Iterator[Token]:
    at, line, n = 0, 1, len(text)
    templates = text.rfind("`")  # beyond it no template can close
    while at < n:
        c = text[at]
        if c == "\n":
            line += 1
            at += 1
        elif c.isspace():
            at += 1
        elif text.startswith("//", at):
            end = text.find("\n", at)
            at = n if end < 0 else end
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = n if end < 0 else end + 2
            line += text.count("\n", at, end)
            at = end
        elif c in _QUOTES and (end := _string(text, at)) > 0:
            yield Token("string", text[at + 1 : end - 1], line)
            at = end
        elif c == "`" and at < templates and (found := _template(text, at)):
            token, end = found
            token.line = line
            yield token
            line += text.count("\n", at, end)
            at = end
        elif _starts_name(c):
            end = at + 1
            while end < n and (_starts_name(text[end]) or text[end].isdigit()):
                end += 1
            yield Token("name", text[at:end], line)
            at = end
        else:
            yield Token("sign", c, line)
            at += 1


def chain(stream: list[Token], at: int) -> tuple[list[str], int]:
    """The names joined by dots from the name at `at`, and the place after them."""
    names = [stream[at].text]
    at += 1
    while at + 1 < len(stream) and stream[at].text == "." and stream[at].kind == "sign" and stream[at + 1].kind == "name":
        names.append(stream[at + 1].text)
        at += 2
    return names, at


def after_types(stream: list[Token], at: int) -> int:
    """The place after a list of type arguments at `at`, if there is one that closes."""
    if at >= len(stream) or stream[at].text != "<" or stream[at].kind != "sign":
        return at
    depth = 0
    for i in range(at, min(len(stream), at + 60)):
        if stream[i].kind == "sign":
            depth += (stream[i].text == "<") - (stream[i].text == ">")
            if stream[i].text in _OPENS + _CLOSES + ";" and stream[i].text not in "[]{}":
                return at
            if not depth:
                return i + 1
    return at
