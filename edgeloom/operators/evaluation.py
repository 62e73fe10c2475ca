"""Questions about served edges: every stated field must hold on one edge; the nearest miss is reported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import text as T

IDENTITY = ("from", "to", "type")


def predicate(field: str, want) -> Column:
    """The test of one stated field on an edge (src, dst, type, endpoint, condition, provenance, collections, ...)."""
    col = {"from": F.col("src"), "to": F.col("dst")}.get(field, F.col(field.removesuffix("_contains").removesuffix("_prefix").removesuffix("_resolved")))
    if field in ("from", "to", "owner"):
        test = T.normalize_title(T.strip_wikilink(col)) == T.normalize_title(T.strip_wikilink(F.lit(want)))
    elif field == "endpoint":
        test = (col == want) | F.array_contains(T.endpoint_tokens(col), want)
    elif field == "endpoint_resolved":
        test = T.endpoint_is_resolved(col) == F.lit(bool(want))
    elif field == "provenance_prefix":
        test = col.startswith(want) & ~F.substring(col, len(want) + 1, 1).rlike("[A-Za-z0-9]")
    elif field.endswith("_contains"):
        test = T.word_match(col, want)
    elif isinstance(want, list):
        test = F.size(F.array_except(F.array(*map(F.lit, want)), col)) == 0
    elif want is None:
        test = col.isNull()
    else:
        test = col == F.lit(want)
    return F.coalesce(test, F.lit(False))


def scored(expect: dict) -> Column:
    """struct(same, fails) of an edge: how many of from, to and type hold, and how many stated fields do not."""
    tests = {k: predicate(k, v) for k, v in expect.items()}
    identity = reduce(lambda a, b: a + b, (t.cast("int") for k, t in tests.items() if k in IDENTITY), F.lit(0))
    fails = reduce(lambda a, b: a + b, ((~t).cast("int") for t in tests.values()), F.lit(0))
    return F.struct((-identity).alias("same"), fails.alias("fails"))


def evaluate(edges: DataFrame, questions: list[dict]) -> DataFrame:
    """question, ok, matches, nearest_fails, nearest for each question {id, expect | expect_absent}, in one pass over the
    edges. ok: some edge satisfies all fields (absent: none does); nearest: the edge that meets most of from, to and type,
    then fails least, then comes first."""
    validate(questions)
    rows = edges.select(F.concat_ws(" ", "src", "type", "dst").alias("_edge"), *(scored(q.get("expect") or q["expect_absent"]).alias(f"q{i}") for i, q in enumerate(questions)))
    found = rows.agg(*(F.struct(F.count_if(F.col(f"q{i}.fails") == 0).alias("matches"), F.min(F.struct(f"q{i}.same", f"q{i}.fails", "_edge")).alias("best")).alias(f"a{i}") for i in range(len(questions))))
    answers = [F.struct(F.lit(q["id"]).alias("question"), F.lit("expect_absent" in q).alias("absent"), F.col(f"a{i}.matches").alias("matches"), F.col(f"a{i}.best").alias("best")) for i, q in enumerate(questions)]
    each = found.select(F.inline(F.array(*answers)))
    ok = F.when(F.col("absent"), F.col("matches") == 0).otherwise(F.col("matches") > 0)
    return each.select("question", ok.alias("ok"), "matches", F.col("best.fails").alias("nearest_fails"), F.col("best._edge").alias("nearest"))


FIELDS = ("from", "to", "type", "endpoint", "endpoint_resolved", "condition", "condition_contains", "provenance", "provenance_prefix", "owner", "store", "collections", "confidence", "grounded")


def validate(questions: list[dict]) -> None:
    """Raises ValueError with all that is wrong with the questions."""
    wrong, seen = [], set()
    for q in questions:
        name = q.get("id")
        if not name or name in seen:
            wrong.append(f"id {name!r} is missing or repeated")
        seen.add(name)
        stated = [k for k in ("expect", "expect_absent") if q.get(k)]
        if len(stated) != 1:
            wrong.append(f"{name}: exactly one of expect and expect_absent")
        for k in stated:
            wrong += [f"{name}: no field {f!r}" for f in q[k] if f not in FIELDS]
    if wrong:
        raise ValueError("; ".join(wrong))


def unserved_fields(edges: DataFrame, questions: list[dict]) -> list[str]:
    """Fields that questions ask for and the edges do not have: such a set is blocked, not failed."""
    names = {"from": "src", "to": "dst", "endpoint_resolved": "endpoint", "condition_contains": "condition", "provenance_prefix": "provenance"}
    asked = {names.get(f, f) for q in questions for f in (q.get("expect") or q.get("expect_absent") or {})}
    return sorted(asked - set(edges.columns))


def gate(exercised: bool, ok: bool) -> str:
    return "NOT_EXERCISED" if not exercised else "PASS" if ok else "FAIL"
