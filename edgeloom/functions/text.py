"""Scalar functions on names, URLs, endpoints and paths, as Column expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode dashes that count as "-".
DASHES = "‐‑‒–—―−﹘"
# Host rules of services, in order: part of the host -> service.
HOST_RULES = (
    ("oauth2.googleapis.com", "GCP-OAuth"),
    ("accounts.google.com", "GCP-OAuth"),
    ("run.googleapis.com", "GCP-Run-Admin-API"),
    ("googleapis.com", "GCP-API"),
    ("bitbucket.org", "Bitbucket"),
)
# Confidence from weakest to strongest.
CONFIDENCE = ("low", "med", "high")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host_of(url: Column | str) -> Column:
    """What stands between http(s):// and the next slash, port and user included; null if there is none."""
    host = F.regexp_extract(_c(url), r"^https?://([^/]+)", 1)
    return F.when(host != "", host)


def host_to_service(url: Column | str) -> Column:
    """The service of a literal URL; the first host rule that matches decides."""
    host = host_of(url)
    out = F.when(host.isNull(), F.lit(None).cast("string"))
    for part, service in HOST_RULES:
        out = out.when(host.contains(part), F.lit(service))
    return out.when(host.contains("run.app"), F.concat(F.lit("cloudrun:"), F.substring_index(host, ".", 1))).otherwise(F.concat(F.lit("ext:"), host))


def endpoint_family(endpoint: Column | str) -> Column:
    """The first three fixed segments of a path; null and empty count as (none), unresolved forms stay."""
    e = _c(endpoint)
    kept = F.slice(F.filter(F.split(e, "/"), lambda s: (s != "") & ~s.startswith("{") & ~s.contains(":")), 1, 3)
    return (
        F.when(e.isNull() | (e == ""), F.lit("(none)"))
        .when((e == "(var)") | e.startswith("(tcp"), e)
        .when(F.size(kept) == 0, e)
        .otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))
    )


def normalize_title(title: Column | str) -> Column:
    """The key under which titles are compared: dashes and spaces unified, no space around dashes, lower case."""
    t = F.translate(_c(title), DASHES + "\u00a0", "-" * len(DASHES) + " ")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.lower(F.regexp_replace(t, " *- *", "-"))


def strip_wikilink(target: Column | str) -> Column:
    t = F.trim(_c(target))
    return F.regexp_replace(t, r"^\[\[(.*)\]\]\z", "$1")


def has_punctuation(title: Column | str) -> Column:
    """Whether a title holds dashes or spaces that an ASCII alias would write differently."""
    return _c(title).rlike(f"[{DASHES}\u00a0]|  ")


def ascii_alias(title: Column | str) -> Column:
    t = F.translate(_c(title), DASHES + "\u00a0", "-" * len(DASHES) + " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def norm_id(name: Column | str) -> Column:
    """Identity of a resource: last path segment in lower case, without one trailing environment or number."""
    last = F.substring_index(F.lower(F.coalesce(_c(name), F.lit(""))), "/", -1)
    return F.regexp_replace(last, r"-(prod|dev|test|[0-9]{6,})\z", "")


def kind_family(kind: Column | str) -> Column:
    return F.substring_index(_c(kind), "-", 1)


def slugify(name: Column | str, fallback: str = "unnamed", fold: bool = True) -> Column:
    """Lower case letters and digits with single dashes between; `fold` unifies Unicode dashes and spaces before."""
    base = normalize_title(name) if fold else F.lower(_c(name))
    slug = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit(fallback)).otherwise(slug)


def pluralize(word: Column | str) -> Column:
    """The default collection name of a model: lower case, English plural."""
    w = F.lower(_c(word))
    return F.when(w.rlike("[^aeiou]y$"), F.regexp_replace(w, "y$", "ies")).when(w.rlike("(s|x|z|ch|sh)$"), F.concat(w, F.lit("es"))).otherwise(F.concat(w, F.lit("s")))


def is_url_variable(name: Column | str) -> Column:
    return _c(name).rlike("_(URL|URI|BASE_URL|ENDPOINT|HOST)$")


def service_of_variable(name: Column | str) -> Column:
    """BACKEND_BASE_URL -> backend."""
    base = F.lower(F.replace(F.regexp_replace(_c(name), "_(BASE_URL|URL|URI|ENDPOINT|HOST)$", ""), F.lit("_"), F.lit("-")))
    return F.when(base == "", _c(name)).otherwise(base)


def self_link_tail(value: Column | str) -> Column:
    """A provider's self link as its last segment; other values as they are."""
    v = _c(value)
    return F.when(v.contains("googleapis.com") & v.contains("/projects/"), F.substring_index(v, "/", -1)).otherwise(v)


def ref_kind(ref: Column | str) -> Column:
    r = F.trim(_c(ref))
    return F.when(r.startswith("data."), F.lit("provider-read")).when(r.startswith("var."), F.lit("deploy-time-input")).otherwise(F.lit("not-statically-resolvable"))


def unset_refs(name: Column | str) -> Column:
    """The references in a name that have no value in source: (unset:ref)."""
    return F.regexp_extract_all(F.coalesce(_c(name), F.lit("")), F.lit(r"\(unset:([^)]+)\)"), 1)


def endpoint_tokens(endpoint: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_c(endpoint), F.lit("")), r"[:,;()\[\]{}\s|]+"), lambda t: t != "")


def endpoint_is_resolved(endpoint: Column | str) -> Column:
    e = F.trim(F.coalesce(_c(endpoint), F.lit("")))
    return (e != "") & ~e.rlike(r"[{}]|^\((var|none|dynamic)\)$")


def word_match(text: Column | str, word: str) -> Column:
    return _c(text).rlike(rf"(?<!\w){re.escape(word)}(?!\w)")


# Words that mark what is still to be written.
PLACEHOLDERS = ("TBD", "TODO", "FIXME", "XXX", "PLACEHOLDER", "COMING SOON")
PLACEHOLDER = rf"(?i)\b(?:{'|'.join(PLACEHOLDERS)})\b"
#: an angle-bracketed token of three characters or more; one of several words or choices was left over from a template
TOKEN = r"(?i)<[a-z][a-z0-9 _|/.-]{2,}>"
LEFT_OVER = r"(?i)<[a-z](?=[a-z0-9_/.-]*[ |])[a-z0-9 _|/.-]{2,}>"


def has_placeholder(text: Column | str) -> Column:
    return _c(text).rlike(PLACEHOLDER)


def has_template_token(text: Column | str) -> Column:
    """Whether a value holds any angle-bracketed token."""
    return _c(text).rlike(TOKEN)


def placeholders_in(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(PLACEHOLDER), 0)


def template_tokens_in(text: Column | str) -> Column:
    """Tokens of several words or choices; a single word in angle brackets is prose, as in a URL pattern."""
    return F.regexp_extract_all(_c(text), F.lit(LEFT_OVER), 0)


def flags_in(text: Column | str) -> Column:
    """Feature flags named in a condition."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\b(use_[a-z_]+|USE_[A-Z_]+|[A-Z_]+_TARGET|[a-z_]+_enabled)\b"), 1)))


def confidence_rank(confidence: Column | str) -> Column:
    out = F.lit(0)
    for k, name in enumerate(CONFIDENCE):
        out = F.when(_c(confidence) == name, k).otherwise(out)
    return out


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression of a shell pattern for one path segment: * ? [seq] [!seq]; an open [ is literal."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!"))) > 0:
            inside = pattern[i + 1 : end]
            negated = inside.startswith("!")
            inside = (inside[1:] if negated else inside).replace("\\", r"\\").replace("[", r"\[").replace("^", r"\^").replace("&", r"\&")
            out += f"[{'^' if negated else ''}{inside}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})\\z"


def path_excluded(path: Column | str, patterns: list[str]) -> Column:
    """Whether any segment of a relative path matches any of the shell patterns."""
    regexes = [glob_to_regex(p) for p in patterns]
    return F.exists(F.split(_c(path), "/"), lambda s: _any([s.rlike(r) for r in regexes]))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def age_days(at: Column | str, now: Column | str) -> Column:
    """Days between an ISO stamp and now; null if the stamp cannot be read."""
    seconds = F.unix_timestamp(F.to_timestamp(_c(now))) - F.unix_timestamp(F.try_to_timestamp(_c(at)))
    return seconds / F.lit(86400)
