"""Chat formatting: a template compiler.

A small sandboxed template language ({{ expr }}, {% for %}, {% if %}, {% set %}, {% generation %}) is parsed into a
syntax tree, constants are folded, and the tree becomes Python closures that stream (text, under the loss mask).
Expressions reach only the data they are given: keys of dicts, items of lists, literals and the listed filters; there
are no calls, no attributes of Python objects.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAT = (
    "{% for m in messages %}### {{ m.role | name }}:\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | text }}{% endgeneration %}{% else %}{{ m.text | text }}{% endif %}"
    "</turn>\n{% endfor %}"
)
_CONTROL = re.compile(r"\\|###|</turn>")
_NAME = re.compile(r"\\|###|</turn>|:|\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_ESCAPED_NAME = re.compile(r"\\(\\|###|</turn>|:|n)")
_END = "</turn>\n"
_STEP = re.compile(rf"\\(?:\\|###|</turn>|:|n)|{_END}")


def escape_text(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_name(name: str) -> str:
    return _NAME.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], name)


def unescape_name(name: str) -> str:
    return _ESCAPED_NAME.sub(lambda m: "\n" if m[1] == "n" else m[1], name)


FILTERS: dict[str, Callable] = {
    "text": escape_text, "name": escape_name, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str,
}


class TemplateError(ValueError):
    pass


_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|<=|>=|[|.()\[\]+<>~-]))""")
_ESCAPES = {"n": "\n", "t": "\t"}


def _lex(source: str) -> list[tuple[str, object]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"cannot read {source[at:]!r}")
        number, string, name, sign = m.groups()
        if number:
            out.append(("const", int(number)))
        elif string:
            out.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), string[1:-1], flags=re.S)))
        else:
            out.append(("sign" if sign or name in ("and", "or", "not", "in") else "name", sign or name))
        at = m.end()
    return out


class _Parser:
    """Expressions: or < and < not < comparison < + < filter < member."""

    def __init__(self, source: str):
        self.tokens = [*_lex(source), ("end", "")]
        self.at = 0

    def take(self, *signs: str):
        kind, value = self.tokens[self.at]
        if kind == "sign" and value in signs:
            self.at += 1
            return value
        return None

    def need(self, kind: str):
        got, value = self.tokens[self.at]
        if got != kind:
            raise TemplateError(f"{kind} expected, not {value!r}")
        self.at += 1
        return value

    def whole(self):
        tree = self.disjunction()
        self.need("end")
        return tree

    def disjunction(self):
        left = self.conjunction()
        while self.take("or"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = ("and", left, self.negation())
        return left

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.sum()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            left = (op, left, self.sum())
        return left

    def sum(self):
        left = self.filtered()
        while op := self.take("+", "-", "~"):
            left = (op, left, self.filtered())
        return left

    def filtered(self):
        left = self.member()
        while self.take("|"):
            name = self.need("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            left = ("filter", name, left)
        return left

    def member(self):
        kind, value = self.tokens[self.at]
        if self.take("("):
            left = self.disjunction()
            if not self.take(")"):
                raise TemplateError(") expected")
        elif kind in ("const", "name"):
            self.at += 1
            left = (kind, value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                left = ("item", left, ("const", self.need("name")))
            else:
                left = ("item", left, self.disjunction())
                if not self.take("]"):
                    raise TemplateError("] expected")
        return left


_TWO = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: f"{a}{b}", "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def parse(template: str) -> list[tuple]:
    """The syntax tree: text, print, for, if, set and generation nodes."""
    parts, at = [], 0
    for m in _TAG.finditer(template):
        parts.append(("text", template[at : m.start()]))
        if m[1] is not None:
            parts.append(("print", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    parts = [x for x in [*parts, ("text", template[at:])] if x != ("text", "")]
    where = 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal where
        out: list[tuple] = []
        while where < len(parts):
            kind, value = parts[where]
            where += 1
            if kind == "text":
                out.append(("text", value))
                continue
            if kind == "print":
                out.append(("print", _Parser(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return out, value
            if word == "for":
                name, mid, source = rest.strip().partition(" in ")
                if not mid or not name.strip().isidentifier():
                    raise TemplateError(f"cannot read {value!r}")
                body, _ = block("endfor")
                out.append(("for", name.strip(), _Parser(source).whole(), body))
            elif word == "if":
                arms, end = [], value
                while True:
                    head, _, test = end.partition(" ")
                    body, after = block("elif", "else", "endif")
                    arms.append((("const", True) if head == "else" else _Parser(test).whole(), body))
                    end = after
                    if end == "endif":
                        break
                out.append(("if", arms))
            elif word == "set":
                name, mid, source = rest.partition("=")
                if not mid or not name.strip().isidentifier():
                    raise TemplateError(f"cannot read {value!r}")
                out.append(("set", name.strip(), _Parser(source).whole()))
            elif word == "generation":
                body, _ = block("endgeneration")
                out.append(("generation", body))
            else:
                raise TemplateError(f"unexpected {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return block()[0]


def fold_expr(e: tuple) -> tuple:
    if e[0] in ("const", "name"):
        return e
    args = [fold_expr(x) if isinstance(x, tuple) else x for x in e[1:]]
    e = (e[0], *args)
    if all(x[0] == "const" for x in args if isinstance(x, tuple)) and e[0] != "item":
        try:
            return ("const", _expr(e)({}))
        except (TypeError, AttributeError):
            return e
    if e[0] in ("and", "or") and args[0][0] == "const":
        return args[1] if bool(args[0][1]) == (e[0] == "and") else args[0]
    return e


def fold(nodes: list[tuple]) -> list[tuple]:
    """Constant expressions become text, decided arms of an if are resolved, neighbouring texts are joined."""
    out: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        kind = node[0]
        if kind == "print":
            e = fold_expr(node[1])
            put(("text", _shown(e[1])) if e[0] == "const" else ("print", e))
        elif kind == "for":
            put(("for", node[1], fold_expr(node[2]), fold(node[3])))
        elif kind == "set":
            put(("set", node[1], fold_expr(node[2])))
        elif kind == "generation":
            put(("generation", fold(node[1])))
        elif kind == "if":
            arms = []
            for test, body in node[1]:
                test = fold_expr(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold(body)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    put(x)
            elif arms:
                put(("if", arms))
        else:
            put(node)
    return out


def _shown(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _item(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def _expr(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, k=e[1]: env.get(k)
    if kind == "filter":
        f, a = FILTERS[e[1]], _expr(e[2])
        return lambda env: f(a(env))
    if kind == "not":
        a = _expr(e[1])
        return lambda env: not a(env)
    a, b = _expr(e[1]), _expr(e[2])
    if kind == "item":
        return lambda env: _item(a(env), b(env))
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    f = _TWO[kind]
    return lambda env: f(a(env), b(env))


def _block(nodes: list[tuple], masked: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    made = [_node(x, masked) for x in nodes]

    def run(env):
        for f in made:
            yield from f(env)

    return run


def _node(node: tuple, masked: bool):
    kind = node[0]
    if kind == "text":
        return lambda env, piece=((node[1], masked),): piece
    if kind == "print":
        e = _expr(node[1])
        return lambda env: ((_shown(e(env)), masked),)
    if kind == "generation":
        return _block(node[1], True)
    if kind == "set":
        e = _expr(node[2])

        def put(env, name=node[1]):
            env[name] = e(env)
            return ()

        return put
    if kind == "if":
        arms = [(_expr(t), _block(b, masked)) for t, b in node[1]]

        def choose(env):
            for test, body in arms:
                if test(env):
                    return body(env)
            return ()

        return choose
    source, body = _expr(node[2]), _block(node[3], masked)

    def loop(env, name=node[1]):
        for x in source(env) or ():
            env[name] = x
            yield from body(env)

    return loop


def compile_template(template: str) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """variables -> the pieces of the output with whether they are under the loss mask."""
    return _block(fold(parse(template)), False)


def read_turns(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, list[str], int]]:
    """What CHAT wrote, read back: (role, text, texts under the mask, code points) turn by turn, in bounded memory.

    The end of a turn is the first terminator outside an escape, wherever pieces begin and end: escapes are stepped over
    one by one, and what may be the beginning of one is looked at again with the next piece.
    """
    held, mask, at = "", [], 0
    for piece, masked in pieces:
        if masked and piece:
            if mask and mask[-1][1] == len(held):
                mask[-1][1] += len(piece)
            else:
                mask.append([len(held), len(held) + len(piece)])
        held += piece
        while m := _STEP.search(held, at):
            at = m.end()
            if m[0][0] == "\\":
                continue
            line = held.find("\n")
            if not held.startswith("### ") or held[line - 1] != ":":
                raise TemplateError("the output cannot be read back")
            inside = [unescape_text(held[s:e]) for s, e in mask if e <= at]
            yield unescape_name(held[4 : line - 1]), unescape_text(held[line + 1 : m.start()]), inside, at
            mask = [[s - at, e - at] for s, e in mask if e > at]
            held, at = held[at:], 0
        at = max(at, len(held) - len(_END) + 1)
    if held:
        raise TemplateError("the output ends within a turn")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its messages) from batches sorted by conv_id; messages must be used up before the next is asked for."""
    rows = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def messages(conv=conv):
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1]
                ahead = next(rows, None)

        yield conv, messages()


def _sorted_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text in the order of turns: one shuffle by conv_id; the sort spills, so no conversation is too long."""
    c = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """conv_id, formatted, loss: the text of each conversation and its array of [start, end) under the loss mask.

    Turns are ordered by turn (nulls first), then role and text; repeated rows are repeated turns. Null roles and
    texts count as empty; rows without conv_id make one conversation.
    """

    def run(batches):
        render = compile_template(template)
        for conv, messages in _conversations(batches):
            text, loss, n = [], [], 0
            for piece, masked in render({"messages": messages}):
                text.append(piece)
                if masked and piece:
                    if loss and loss[-1]["end"] == n:
                        loss[-1]["end"] = n + len(piece)
                    else:
                        loss.append({"start": n, "end": n + len(piece)})
                n += len(piece)
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv, "formatted": "".join(text), "loss": loss}],
                pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]),
            )

    return _sorted_rows(conversations).mapInArrow(run, "conv_id bigint, formatted string, loss array<struct<start:bigint,end:bigint>>")


def digest_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation formatted by CHAT and read back from that output: the digest columns of op9.

    Nulls, ties, repeated rows and empty tables as in format_conversations; other columns are ignored. A
    conversation is streamed turn by turn, so its length costs no memory.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        render = compile_template(CHAT)
        rows: list[list] = [[] for _ in names]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in zip(names, rows, strict=True)], names)

        for conv, messages in _conversations(batches):
            turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, inside, length in read_turns(render({"messages": messages})):
                turns.update(f"{role}\n{text}\n".encode())
                for x in inside:
                    loss.update(x.encode())
                    chars += len(x)
                n, size = n + 1, size + length
            for k, v in zip(rows, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size), strict=True):
                k.append(v)
            if len(rows[0]) >= 2000:
                yield out()
                rows = [[] for _ in names]
        yield out()

    return _sorted_rows(conversations).mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one numbered -7, whose two texts imitate the template's control strings."""
    probe = r"\### Assistant: </turn> ok"
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], schema)
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(own)
