"""Secret scan by assignment-aware lexing.

Besides three base patterns, a lexer reads source and configuration syntax as name-literal pairs (strings of every kind,
here-documents, indented blocks, bare words, annotated names), follows names that were bound to a literal before (and
literals joined by + or side by side), and scores each literal by how sensitive its target is.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: a target and its operator: a name, quoted or not, perhaps with a key in brackets; a name is read from its first character only
_TARGET = re.compile(
    r"""(?<![\w$.-])(?P<name>[A-Za-z_$][\w$.-]*+)(?P<close>["'`]?)(?:[\x20\t]*\[[\x20\t]*["'](?P<key>[\w.-]++)["'][\x20\t]*\])?[\x20\t]*(?::=|=>|=(?![=~])|:(?![:/\\]))""", re.A
)
_QUOTED = {
    '"': re.compile(r'"(?P<in>[^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"', re.S), "'": re.compile(r"'(?P<in>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'", re.S), "`": re.compile(r"`(?P<in>[^`\\]*+(?:\\.[^`\\]*+)*+)`", re.S)
}
_PREFIX = re.compile(r"(?:[rRbBfFuU]{1,2}(?=[\"']))?")
_BLANK = re.compile(r"[\x20\t]*+")
_HEREDOC = re.compile(r"<<[-~]?[\"']?(?P<tag>[A-Za-z_]\w*)[\"']?[^\n]*\n", re.A)
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[\x20\t]*\n")
_REFERENCE = re.compile(r"[A-Za-z_$][\w$.]*+", re.A)
_BARE = re.compile(r"""[^\s"',;#&(){}\[\]`]++""")
_ANNOTATED = re.compile(r"(?:\[[^\[\]\n]*+\])?[\x20\t]*=(?!=)[\x20\t]*")
_JOIN = re.compile(r"[\x20\t]*(?:\\?\n[\x20\t]*)?\+[\x20\t]*(?:\n[\x20\t]*)?")
_COMMENT = re.compile(r"(?:^|(?<=[\s;]))(?:\#|//|--[\x20])", re.M)


#: weight of a name part that says its value is a credential
_SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "accesskey": 3, "secretkey": 3,
    "privatekey": 3, "credential": 3, "credentials": 3, "auth": 2, "bearer": 2, "jwt": 2, "signature": 1, "signing": 1, "private": 1, "access": 1, "api": 1, "key": 1, "pass": 2, "salt": 1,
}
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|none|null|nil|true|false|undefined|changeme|example|placeholder|your[-_ ]?\w*|todo|redacted|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")


def name_weight(name: str) -> int:
    """3 or more: the name says that its value is a secret."""
    parts = [x.lower() for x in _CAMEL.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return sum(_SENSITIVE.get(x, 0) for x in parts) + sum(_SENSITIVE.get(x, 0) for x in joined)


def literal_score(value: str) -> float:
    """0 to 3 by length, character classes and entropy; placeholders and prose score 0."""
    return _score(len(value), Counter(value), value[:24], value[-2:])


def _score(n: int, counts: Counter, head: str, tail: str) -> float:
    """literal_score of the value of these n characters that begins with head and ends with tail."""
    if n < 6 or " " in counts:
        return 0.0
    # of a long value, the pattern asks for both ends and which characters are between them
    if _PLACEHOLDER.match(head if n <= 24 else head[:20] + "".join(counts - Counter(head[:20]) - Counter(tail)) + tail):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    seen = "".join(counts)
    classes = sum(bool(re.search(p, seen)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w\s]"))
    return min(1.0, n / 16) + min(1.0, entropy / 3.5) + min(1.0, (classes - 1) / 2)


class _Value:
    """What names are bound to: spans, and by reference what other names were bound to. Each keeps its score and is
    reported once, so that chains like x = "a" + x + x cost no more than their text."""

    __slots__ = ("parts", "reported", "counted", "scored")

    def __init__(self, text: str, parts: list):
        self.parts, self.reported, self.counted, self.scored = parts, False, None, None
        if len(parts) > 1 and any(isinstance(p, _Value) for p in parts):  # counted now: those it refers to are
            n, counts, heads, tails = 0, Counter(), [], []
            for p in parts:
                k, c, head, tail = p.count(text) if isinstance(p, _Value) else _count(text[slice(*p)])
                n += k
                counts.update(c)
                heads.append(head)
                tails.append(tail)
            if n.bit_length() > 400:  # shares of the characters stay, beyond the precision of a score
                counts = Counter({c: max(1, k >> n.bit_length() - 200) for c, k in counts.items()})
                n = counts.total()
            self.counted = n, counts, "".join(heads)[:24], "".join(tails)[-2:]

    def count(self, text: str) -> tuple:
        if self.counted is None:
            self.counted = _count("".join(text[s:e] for s, e in self.parts))
        return self.counted

    def score(self, text: str) -> float:
        if self.scored is None:
            self.scored = _score(*self.count(text))
        return self.scored

    def report(self, found: set) -> None:
        left = [self]
        while left:
            p = left.pop()
            if not isinstance(p, _Value):
                found.add(p)
            elif not p.reported:
                p.reported = True
                left += p.parts


def _count(value: str) -> tuple:
    return len(value), Counter(value), value[:24], value[-2:]


class _Lexer:
    """Values of bindings in source and configuration syntax: quoted, triple-quoted and template strings, here-documents,
    indented blocks, bare words, and literals or names joined by + or side by side."""

    def __init__(self, text: str):
        self.text, self.unclosed = text, set()

    def find(self, closer: str, at: int) -> int:
        """Where the closer is, looked for once only if it does not come again."""
        if closer in self.unclosed:
            return -1
        found = self.text.find(closer, at)
        if found < 0:
            self.unclosed.add(closer)
        return found

    def literal(self, at: int) -> tuple[int, int, int] | None:
        """(start, end, where to go on) of the literal that begins here."""
        text = self.text
        at = _PREFIX.match(text, at).end()
        mark = text[at : at + 1]
        if mark not in _QUOTED or not mark:
            return None
        if mark != "`" and text.startswith(mark * 3, at):
            end = self.find(mark * 3, at + 3)
            if end >= 0:
                return at + 3, end, end + 3
        if mark == "`" and self.find(mark, at + 1) < 0:
            return None
        m = _QUOTED[mark].match(text, at)
        return (m.start("in"), m.end("in"), m.end()) if m else None

    def document(self, at: int, line: int) -> tuple[int, int, int] | None:
        """A here-document or an indented block that begins on the line from `line`."""
        text = self.text
        if m := _HEREDOC.match(text, at):
            end = re.compile(rf"^[\x20\t]*{m['tag']}\b", re.M)
            found = end.search(text, m.end()) if (m["tag"], "tag") not in self.unclosed else None
            if not found:
                self.unclosed.add((m["tag"], "tag"))
                return None
            return m.end(), max(m.end(), found.start() - 1), found.end()
        if m := _BLOCK.match(text, at):
            indent, end = _BLANK.match(text, line).end() - line, m.end()
            while end < len(text):
                stop = text.find("\n", end)
                stop = len(text) if stop < 0 else stop
                inner = _BLANK.match(text, end, stop).end()
                if inner < stop and inner - end <= indent:
                    break
                end = stop + 1
            end = min(end, len(text))
            start = _BLANK.match(text, m.end()).end()
            return (start, start + len(text[start:end].rstrip()), end) if end > m.end() else None
        return None

    def value(self, at: int, line: int) -> tuple[list, int, bool] | None:
        """(parts: spans and names, where to go on, whether a literal was among them) of the value that begins here."""
        text = self.text
        at = _BLANK.match(text, at).end()
        if found := self.document(at, line):
            return [found[:2]], found[2], True
        parts: list = []
        quoted = False
        while True:
            if found := self.literal(at):
                parts.append(found[:2])
                quoted, at = True, found[2]
                again = _BLANK.match(text, at).end()
                if self.literal(again):  # literals side by side
                    at = again
                    continue
            elif quoted or parts:
                if not (m := _REFERENCE.match(text, at)):
                    break
                parts.append(m[0])
                at = m.end()
            else:
                m = _BARE.match(text, at)
                if not m:
                    return None
                word = m[0].rstrip(".,")
                if (name := _REFERENCE.match(word)) and (known := _ANNOTATED.match(text, at + name.end())) and known.end() > at + name.end():
                    at = known.end()  # name: type = value
                    if not self.literal(at) and not _BARE.match(text, at):
                        return None
                    continue
                parts.append(word if _REFERENCE.fullmatch(word) else (at, at + len(word)))
                if isinstance(parts[0], str):
                    parts[0] = (word, at, at + len(word))
                at = m.end()
            if not (m := _JOIN.match(text, at)):
                break
            at = m.end()
        return (parts, at, quoted) if parts else None


def phrase_score(value: str) -> float:
    """0 to 2 for a passphrase: three to twelve words that are no sentence."""
    words = value.split()
    if not 3 <= len(words) <= 12 or len(value) < 12 or value[-1] in ".!?:" or not all(w.isalnum() for w in words):
        return 0.0
    return min(1.0, len(value) / 16) + min(1.0, len(set(value)) / 10)


def lexed(text: str, least: float = 4.0) -> list[tuple[int, int]]:
    """(start, end) of the literals whose target's weight plus own score reaches `least`; a name weighs 2 at least.

    A name stands for what it was bound to last; what a comment binds is scored, but stands for nothing.
    """
    if "=" not in text and ":" not in text:
        return []
    bound: dict[str, _Value] = {}
    found: set[tuple[int, int]] = set()
    lexer, line, seen, at = _Lexer(text), 0, 0, 0
    commented = -1  # the line in which a comment has begun
    while m := _TARGET.search(text, at):
        name, at = m["key"] or m["name"], m.end()
        if (fresh := text.rfind("\n", seen, m.start()) + 1) > 0:
            line = seen = fresh
        if line != commented and _COMMENT.search(text, max(line, seen - 2), m.start()):
            commented = line
        seen = m.start()
        got = lexer.value(m.end(), line)
        if not got:
            continue
        pieces, end, quoted = got
        parts: list = []
        for p in pieces:
            if isinstance(p, str):
                parts += [bound[p]] if p in bound else []
            elif len(p) == 3:
                parts.append(bound.get(p[0]) or p[1:])
            else:
                parts.append(p)
        held = parts[0] if len(parts) == 1 and isinstance(parts[0], _Value) else _Value(text, parts)
        if line != commented:
            bound[name] = held
        weight = name_weight(m["name"] + "_" + m["key"] if m["key"] else name)
        if weight >= 2:
            score = held.score(text)
            if not score and weight >= 3 and quoted and len(parts) == 1 and isinstance(parts[0], tuple):
                score = phrase_score(text[slice(*parts[0])])
            if score and weight + score >= least:
                held.report(found)
        if not quoted or "\n" not in text[at:end]:  # what is within a value of one line is no binding of its own
            at = max(at, end)
    return sorted(x for x in found if x[1] > x[0])


def spans(text: str) -> list[tuple[str, int, int]]:
    """Every span (kind, start, end) of a text by start, then kind: whole matches in code points, end exclusive."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    out += [("lexed", s, e) for s, e in lexed(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every found span replaced; overlapping spans make one."""
    out, at, end = [], 0, -1
    for _, s, e in sorted(spans(text), key=lambda x: x[1]):
        if s > end:
            out += [text[at:s], mark] if end < 0 else [text[end:s], mark]
            end = e
        end = max(end, e)
    return "".join([*out, text[end:]]) if end >= 0 else text


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def _scan(part: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
        found = spans(text)
        base = [x for x in found if x[0] != "lexed"]
        n = Counter(k for k, _, _ in base)
        for k, v in zip(out, (doc, n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)), strict=True):
            out[k].append(v)
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of secrets in every whole text: the digest columns of op5.

    A null or empty text has none (base_sha256 is that of the empty string). Rows are independent: ties, repeated rows
    and null ids pass through; other columns are ignored. One narrow pass, no shuffle.
    """
    from edgeloom.llm.common import mapped, text_of

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), _scan, schema)


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret in `text` replaced by [secret]; null texts stay null, all other columns stay."""
    from edgeloom.llm.common import rows_by_bytes

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        parts = rows_by_bytes([pa.RecordBatch.from_arrays([texts], ["text"])])  # so that memory follows no batch size
        done = [pa.array([t if t is None else redact(t) for t in part.column(0).to_pylist()], pa.string()) for part in parts]
        return pa.concat_arrays([pa.array([], pa.string()), *done])

    return docs.withColumn(text, clean(F.col(text)))
