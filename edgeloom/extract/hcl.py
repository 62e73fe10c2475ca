"""A reader of HCL: tokens, and from them blocks, attributes and expressions as trees.

An expression is one of
  ("text", [parts])            a quoted or here-document template; a part is a str or an expression
  ("ref", "a.b.c")             a reference; indexes and splats stay in its text
  ("if", test, then, otherwise)
  ("op", sign, left, right)    a comparison or another operation of two sides
  ("list", [items]) ("map", [(key, value)]) ("call", name, [arguments]) ("plain", "42")
What cannot be read becomes ("plain", source); a file never fails as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

_SIGNS = ("==", "!=", "<=", ">=", "&&", "||", "=>", "...")
_OPENS = {"(": ")", "[": "]", "{": "}"}


@dataclass(slots=True)
class Token:
    kind: str  # name, text, plain, sign, line
    value: object
    line: int
    start: int
    end: int


def _word(c: str) -> bool:
    return c.isalnum() or c in "_-"


def _quoted(source: str, at: int) -> tuple[list, int]:
    """Parts of the template whose opening quote is at `at`, and where it ends. Holes are read as expressions."""
    parts, held, i, n = [], [], at + 1, len(source)
    while i < n and source[i] not in '"\n':
        if source[i] == "\\" and i + 1 < n:
            held.append({"n": "\n", "t": "\t"}.get(source[i + 1], source[i + 1]))
            i += 2
        elif source.startswith(("$${", "%%{"), i):
            held.append(source[i + 1 : i + 3])
            i += 3
        elif source.startswith(("${", "%{"), i):
            end = _closing(source, i + 1)
            parts += ["".join(held), expression_of(source[i + 2 : end].strip("~"))]
            held, i = [], end + 1
        else:
            held.append(source[i])
            i += 1
    parts.append("".join(held))
    return [p for p in parts if p != ""], min(n, i + 1)


def _closing(source: str, at: int) -> int:
    """The brace that closes the one at `at`, outside quotes; the end of the source if none does."""
    depth, i, quoted = 0, at, False
    while i < len(source):
        c = source[i]
        if c == "\\" and quoted:
            i += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "{") - (c == "}")
            if not depth:
                return i
        i += 1
    return len(source)


def tokens(source: str) -> Iterator[Token]:
    at, line, n = 0, 1, len(source)
    while at < n:
        c, start = source[at], at
        if c == "\n":
            yield Token("line", "\n", line, at, at + 1)
            at, line = at + 1, line + 1
        elif c.isspace():
            at += 1
        elif c == "#" or source.startswith("//", at):
            end = source.find("\n", at)
            at = n if end < 0 else end
        elif source.startswith("/*", at):
            end = source.find("*/", at + 2)
            end = n if end < 0 else end + 2
            line, at = line + source.count("\n", at, end), end
        elif c == '"':
            parts, at = _quoted(source, at)
            yield Token("text", parts, line, start, at)
        elif source.startswith("<<", at):
            stop = source.find("\n", at)
            stop = n if stop < 0 else stop
            tag, i, body = source[at + 2 : stop].lstrip("-~").strip(), stop + 1, []
            while i <= n and tag:
                end = source.find("\n", i)
                end = n if end < 0 else end
                if source[i:end].strip() == tag or end >= n:
                    break
                body.append(source[i:end])
                i = end + 1
            at = min(n, source.find("\n", i) if source.find("\n", i) >= 0 else n)
            yield Token("text", ["\n".join(body)], line, start, at)
            line += source.count("\n", start, at)
        elif c.isalpha() or c == "_":
            while at < n and _word(source[at]):
                at += 1
            yield Token("name", source[start:at], line, start, at)
        elif c.isdigit():
            while at < n and (_word(source[at]) or source[at] == "."):
                at += 1
            yield Token("plain", source[start:at], line, start, at)
        else:
            sign = next((s for s in _SIGNS if source.startswith(s, at)), c)
            at += len(sign)
            yield Token("sign", sign, line, start, at)


class _Reader:
    """Expressions: condition < or < and < comparison < sum < product < unary < postfix."""

    LEVELS = (("||",), ("&&",), ("==", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))

    def __init__(self, source: str, stream: list[Token], at: int = 0):
        self.source, self.stream, self.at, self.depth = source, stream, at, 0

    def peek(self) -> Token | None:
        while self.depth and self.at < len(self.stream) and self.stream[self.at].kind == "line":
            self.at += 1
        return self.stream[self.at] if self.at < len(self.stream) else None

    def sign(self, *wanted: str) -> str | None:
        token = self.peek()
        if token and token.kind == "sign" and token.value in wanted:
            self.at += 1
            return token.value
        return None

    def expression(self):
        test = self.level(0)
        if not self.sign("?"):
            return test
        self.depth += 1
        then = self.expression()
        self.sign(":")
        self.peek()
        self.depth -= 1
        return ("if", test, then, self.expression())

    def level(self, k: int):
        if k == len(self.LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while sign := self.sign(*self.LEVELS[k]):
            left = ("op", sign, left, self.level(k + 1))
        return left

    def unary(self):
        if sign := self.sign("!", "-"):
            return ("op", sign, ("plain", ""), self.unary())
        return self.operand()

    def inside(self, closer: str) -> list:
        """Items up to the closer, line ends and commas between them."""
        items = []
        self.depth += 1
        while (token := self.peek()) and not (token.kind == "sign" and token.value == closer):
            before = self.at
            items.append(self.expression())
            if self.sign("=", ":", "=>"):
                items[-1] = (items[-1], self.expression())
            self.sign(",")
            self.sign("...")
            if self.at == before:  # nothing that could be read
                self.at += 1
        self.depth -= 1
        self.at += 1
        return items

    def operand(self):
        token = self.peek()
        if token is None or token.kind == "line":
            return ("plain", "")
        self.at += 1
        if token.kind == "text":
            return ("text", token.value)
        if token.kind == "plain":
            return ("plain", token.value)
        if token.kind == "name":
            return self.reference(token)
        if token.value == "(":
            found = self.inside(")")
            return found[0] if found else ("plain", "")
        if token.value == "[":
            return ("list", self.inside("]"))
        if token.value == "{":
            return ("map", [i for i in self.inside("}") if isinstance(i, tuple) and len(i) == 2 and isinstance(i[0], tuple)])
        if token.value in _OPENS.values():
            self.at -= 1
        return ("plain", str(token.value))

    def reference(self, token: Token):
        if self.at < len(self.stream) and self.stream[self.at].kind == "sign" and self.stream[self.at].value == "(":
            self.at += 1
            return ("call", token.value, self.inside(")"))
        end = token.end
        while self.at < len(self.stream):
            nxt = self.stream[self.at]
            after = self.stream[self.at + 1] if self.at + 1 < len(self.stream) else None
            if nxt.kind == "sign" and nxt.value == "." and after and (after.kind in ("name", "plain") or after.value == "*"):
                self.at, end = self.at + 2, after.end
            elif nxt.kind == "sign" and nxt.value == "[" and nxt.start == end:
                self.at += 1
                self.inside("]")
                end = self.stream[self.at - 1].end if self.at - 1 < len(self.stream) else len(self.source)
            else:
                break
        return ("ref", self.source[token.start : end])


def expression_of(source: str):
    return _Reader(source, list(tokens(source))).expression()


@dataclass
class Attribute:
    value: tuple
    line: int


@dataclass
class Block:
    kind: str
    labels: list[str]
    line: int
    attributes: dict[str, Attribute] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)

    def find(self, key: str) -> tuple | None:
        """The attribute of that name in the block or, in order, one within."""
        if key in self.attributes:
            return self.attributes[key].value
        return next((v for b in self.blocks if (v := b.find(key)) is not None), None)

    def plain(self) -> tuple:
        """The block in tuples and dicts only, to be sent."""
        return self.kind, self.labels, self.line, {k: (a.value, a.line) for k, a in self.attributes.items()}, [b.plain() for b in self.blocks]

    @classmethod
    def of_plain(cls, held: tuple) -> Block:
        kind, labels, line, attributes, blocks = held
        return cls(kind, labels, line, {k: Attribute(*a) for k, a in attributes.items()}, [cls.of_plain(b) for b in blocks])

    def walk(self) -> Iterator[Block]:
        yield self
        for b in self.blocks:
            yield from b.walk()


def parse(source: str) -> Block:
    """The file as one block without a kind."""
    reader = _Reader(source, list(tokens(source)))
    top = Block("", [], 1)
    open_ = [top]
    stream = reader.stream
    while reader.at < len(stream):
        token = stream[reader.at]
        if token.kind == "sign" and token.value == "}" and len(open_) > 1:
            open_.pop()
            reader.at += 1
            continue
        if token.kind not in ("name", "text"):
            reader.at += 1
            continue
        at, labels = reader.at + 1, []
        while at < len(stream) and stream[at].kind in ("text", "name"):
            labels.append("".join(p for p in stream[at].value if isinstance(p, str)) if stream[at].kind == "text" else stream[at].value)
            at += 1
        name = token.value if token.kind == "name" else "".join(p for p in token.value if isinstance(p, str))
        follows = stream[at] if at < len(stream) and stream[at].kind == "sign" else None
        if follows and follows.value == "{":
            block = Block(name, labels, token.line)
            open_[-1].blocks.append(block)
            open_.append(block)
            reader.at = at + 1
        elif follows and follows.value == "=" and not labels:
            reader.at = at + 1
            open_[-1].attributes[name] = Attribute(reader.expression(), token.line)
        else:
            reader.at = at
    return top
