"""Outbound calls and collection access in Python sources, from the syntax tree of one file at a time."""

from __future__ import annotations

import ast
import itertools
import re

from pyspark.sql import DataFrame

from edgeloom.operators.coupling import READ_OPS, WRITE_OPS
from edgeloom.operators.shared import spread

# Verbs of HTTP clients, names that clients bear, methods that may come first, folders that are not scanned.
VERBS = ("get", "post", "put", "delete", "patch", "request", "stream")
RECEIVERS = ("client", "aclient", "session", "http", "_client", "httpx", "requests", "c", "cli")
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
SKIPPED = (".venv", "__pycache__", "tests", "test", "site-packages")
FLAG = re.compile(r"\b(use_[a-z_]+|USE_[A-Z_]+|[A-Z_]+_TARGET|[a-z_]+_enabled)\b")
HANDLE = re.compile(r"(?:^|[._])(?:db|database|mongodb|mongo_db)$")

SITE = (
    "kind string, src_repo string, src_symbol string, src_file string, src_line int, target_service string, target_endpoint string, resolved_via string, condition string, "
    "confidence string, prov_rank int, lang string, endpoint_expr string, unresolved_expr string"
)
SITE_NAMES = [f.split(" ")[0] for f in SITE.split(", ")]
ACCESS = "repo string, store string, collection string, mode string, provenance string, model string"


def service_of_url(url: str) -> str | None:
    """As edgeloom.functions.text.host_to_service, for one string."""
    from edgeloom.functions.text import HOST_RULES

    m = re.match(r"https?://([^/]+)", url)
    if not m:
        return None
    rule = next((s for part, s in HOST_RULES if part in m[1]), None)
    return rule or (f"cloudrun:{m[1].split('.')[0]}" if "run.app" in m[1] else f"ext:{m[1]}")


class Hints:
    """Service hints: the longest suffix of an expression, in any case, decides."""

    def __init__(self, table: dict[str, str]):
        self.table = sorted(((k.lower(), k, v) for k, v in table.items()), key=lambda x: -len(x[0]))

    def find(self, expr: str | None) -> tuple[str, str, str] | None:
        low = (expr or "").lower()
        hit = next((x for x in self.table if low and low.endswith(x[0])), None)
        return (hit[2], f"config-var {hit[1]}", "med" if hit[0] == "base_url" else "high") if hit else None


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return node.id if isinstance(node, ast.Name) else ""


def text_constant(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def template(node: ast.JoinedStr) -> tuple[str | None, str]:
    """(expression of the first hole, the rest with later holes as {expression})."""
    base, out = None, []
    for part in node.values:
        if isinstance(part, ast.FormattedValue):
            shown = ast.unparse(part.value)
            if base is None:
                base = shown
            else:
                out.append(f"{{{shown}}}")
        else:
            out.append(text_constant(part) or "")
    return base, "".join(out)


class _Scope:
    """What a function's assignments say about its names."""

    def __init__(self, func: ast.AST | None, hints: Hints):
        self.urls: dict[str, str] = {}
        self.services: dict[str, str] = {}
        self.templates: dict[str, ast.JoinedStr] = {}
        self.words: dict[str, set[str]] = {}
        for n in ast.walk(func) if func else ():
            if not (isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name)):
                continue
            name, value = n.targets[0].id, n.value
            literals = [text_constant(x) for x in ([value] if not isinstance(value, ast.JoinedStr) else value.values)]
            url = next((s for s in literals if s and s.startswith("http")), None)
            if url and service_of_url(url):
                self.urls[name] = service_of_url(url)
            found = next((h for s in ast.walk(value) if isinstance(s, (ast.Attribute, ast.Name)) and (h := hints.find(dotted(s)))), None)
            if found:
                self.services[name] = found[0]
            if isinstance(value, ast.JoinedStr):
                self.templates[name] = value
            words = {w for s in ast.walk(value) if (w := text_constant(s)) is not None}
            if words:
                self.words.setdefault(name, set()).update(words)


def self_constants(cls: ast.ClassDef) -> dict[str, list[tuple[str, str | None]]]:
    """attribute -> [(literal, the branches it stands in)] of `self.attribute = "literal"` in a class."""
    out: dict[str, list[tuple[str, str | None]]] = {}
    todo = [(n, ()) for n in reversed(cls.body)]
    while todo:
        node, conditions = todo.pop()
        if isinstance(node, ast.If):
            test = ast.unparse(node.test)
            todo += [(n, (*conditions, f"not ({test})")) for n in reversed(node.orelse)]
            todo += [(n, (*conditions, test)) for n in reversed(node.body)]
            continue
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            value = text_constant(node.value)
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if value is not None and isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                    pair = (value, " AND ".join(conditions) or None)
                    if pair not in out.setdefault(t.attr, []):
                        out[t.attr].append(pair)
            continue
        inner = [n for part in ("body", "orelse", "finalbody") if isinstance(v := getattr(node, part, None), list) for n in v]
        inner += [n for h in getattr(node, "handlers", ()) for n in h.body]
        todo += [(n, conditions) for n in reversed(inner)]
    return out


def variants(path: str, constants: dict, most: int = 4) -> list[tuple[str, str | None]]:
    """The endpoint with its {self.x} filled in every way the class allows; over `most` ways it stays a template."""
    names = [n for n in dict.fromkeys(re.findall(r"\{self\.(\w+)\}", path)) if n in constants]
    choices = [constants[n] for n in names]
    total = 1
    for c in choices:
        total *= len(c)
    if not names or total > most:
        return [(path, None)]
    out = []
    for pick in itertools.product(*choices):
        filled = path
        for n, (value, _) in zip(names, pick, strict=True):
            filled = filled.replace(f"{{self.{n}}}", value)
        out.append((filled, " AND ".join(sorted({c for _, c in pick if c})) or None))
    return out


class _Calls(ast.NodeVisitor):
    """Walks a file with the classes, functions and branches around each call at hand."""

    def __init__(self, repo: str, file: str, hints: Hints):
        self.repo, self.file, self.hints = repo, file, hints
        self.functions: list = []
        self.classes: list = []
        self.tests: list[list[ast.AST]] = [[]]
        self.scopes: dict = {}
        self.rows: list[dict] = []

    def visit_ClassDef(self, node):
        self.classes.append(node)
        self.generic_visit(node)
        self.classes.pop()

    def visit_FunctionDef(self, node):
        self.functions.append(node)
        self.tests.append([])
        self.generic_visit(node)
        self.tests.pop()
        self.functions.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_If(self, node):
        self.tests[-1].append(node.test)
        self.generic_visit(node)
        self.tests[-1].pop()

    def scope(self) -> _Scope:
        func = self.functions[-1] if self.functions else None
        if func not in self.scopes:
            self.scopes[func] = _Scope(func, self.hints)
        return self.scopes[func]

    def add(self, node, **fields):
        symbol = self.functions[-1].name if self.functions else "<module>"
        self.rows.append({"src_repo": self.repo, "src_symbol": symbol, "src_file": self.file, "src_line": node.lineno} | fields)

    def visit_Call(self, node):
        self.generic_visit(node)
        chain = dotted(node.func)
        if chain == "Redis" or chain.endswith("redis.Redis"):
            self.add(node, kind="data-store", target_service="Redis", target_endpoint="(tcp)", confidence="high")
        elif isinstance(node.func, ast.Attribute) and node.func.attr in VERBS and node.args:
            self.http(node)

    def http(self, node):
        url = node.args[0]
        if node.func.attr in ("request", "stream") and len(node.args) > 1 and (text_constant(url) or "").upper() in METHODS:
            url = node.args[1]
        literal = text_constant(url)
        parts = [text_constant(v) or "" for v in url.values] if isinstance(url, ast.JoinedStr) else []
        looks = bool(literal and literal.startswith("http")) or any("http" in p or "/api/" in p or p.startswith("/") for p in parts)
        owner = node.func.value
        receiver = owner.id if isinstance(owner, ast.Name) else owner.attr if isinstance(owner, ast.Attribute) else ""
        if not looks and receiver not in RECEIVERS:
            return
        if isinstance(url, ast.JoinedStr):
            base, path = template(url)
        elif isinstance(url, ast.Name):
            base, path = url.id, ""
        elif literal is not None:
            base, path = None, literal
        else:
            return
        scope = self.scope()
        found, path = self.target(base, path, scope)
        if not found:
            self.add(node, kind="dynamic", target_service="(dynamic)", target_endpoint=path or "(var)", resolved_via="unresolved", confidence="low", unresolved_expr=ast.unparse(url))
            return
        flags = {f for t in self.tests[-1] for f in FLAG.findall(ast.unparse(t))} if self.functions else set()
        constants = self_constants(self.classes[-1]) if self.classes else {}
        for endpoint, branch in variants(path, constants):
            condition = " AND ".join([*sorted(flags), *([branch] if branch else [])]) or None
            self.add(node, kind="http-call", target_service=found[0], target_endpoint=endpoint or "(var)", resolved_via=found[1], condition=condition, confidence=found[2], endpoint_expr=None if endpoint else ast.unparse(url))

    def target(self, base: str | None, path: str, scope: _Scope) -> tuple[tuple[str, str, str] | None, str]:
        """The service of a URL and its path. A name that was given a template lends its path, with holes filled by what
        is known of them, and, to a URL without a service, the service that the template's own base hints at."""
        found, outer = self.resolve(base, path, scope), scope.templates.get(base)
        if outer is None:
            return found, path
        inner, shape = template(outer)
        hinted = found is None and self.hints.find(inner)
        if hinted:
            found = (hinted[0], f"nested-fstring {base}", "med")
        if path or not shape:
            return found, path
        for name, values in scope.words.items():
            if values:
                shape = shape.replace("{" + name + "}", min(values))
        return (found if found is None or hinted else (found[0], f"{found[1]} + nested-fstring path", found[2])), shape

    def resolve(self, base: str | None, path: str, scope: _Scope) -> tuple[str, str, str] | None:
        """The ladder: a local literal URL, a hint for the name, a local setting, the literal host."""
        if base in scope.urls:
            return scope.urls[base], f"local-URL {base}", "high"
        if hint := self.hints.find(base):
            return hint
        if base in scope.services:
            return scope.services[base], f"local config-var {base}", "med"
        if path.startswith("http") and (host := service_of_url(path)):
            return host, "literal host", "high"
        return None


def call_sites(repo: str, file: str, text: str, hints: dict[str, str]) -> list[dict]:
    """Call sites of one file, by line; a file that does not parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    visitor = _Calls(repo, file, Hints(hints))
    visitor.visit(tree)
    return sorted(visitor.rows, key=lambda r: r["src_line"])


def _collection(node) -> str | None:
    """The collection that an expression on a database handle names."""
    if isinstance(node, ast.Attribute) and HANDLE.search(dotted(node.value)):
        return node.attr
    if isinstance(node, ast.Subscript) and HANDLE.search(dotted(node.value)):
        return text_constant(node.slice)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "get_collection" and node.args and HANDLE.search(dotted(node.func.value)):
        return text_constant(node.args[0])
    return None


def collection_access(repo: str, file: str, text: str) -> list[dict]:
    """Reads and writes of collections in one file: first what names stand for collections, then the operations on them."""
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError):
        return []
    handles = {dotted(n.targets[0]): c for n in nodes if isinstance(n, ast.Assign) and len(n.targets) == 1 and (c := _collection(n.value))}
    out = []
    for n in nodes:
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in READ_OPS + WRITE_OPS:
            owner = n.func.value
            name = handles.get(dotted(owner)) or _collection(owner)
            if name:
                out.append({"repo": repo, "store": "mongo", "collection": name, "mode": "read" if n.func.attr in READ_OPS else "write", "provenance": f"{file}:{n.lineno}", "model": None})
    return out


def skipped(rel: str, parts: tuple[str, ...] = SKIPPED) -> bool:
    return any(p in parts for p in rel.split("/"))


def over_files(files: DataFrame, function, schema: str) -> DataFrame:
    """function(repo, rel, text) -> rows, over files(repo, rel, text): a file at a time, wherever it was dealt to."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [r for repo, rel, text in zip(frame["repo"], frame["rel"], frame["text"], strict=True) for r in function(repo, rel, text or "")]
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names).astype(object)

    return spread(files.select("repo", "rel", "text"), "repo", "rel").mapInPandas(run, schema)


def scan_calls(files: DataFrame, hints: dict[str, str]) -> DataFrame:
    return over_files(files, lambda repo, rel, text: call_sites(repo, rel, text, hints) if rel.endswith(".py") and not skipped(rel) else [], SITE)


def scan_access(files: DataFrame) -> DataFrame:
    return over_files(files, lambda repo, rel, text: collection_access(repo, rel, text) if rel.endswith(".py") and not skipped(rel) else [], ACCESS)
