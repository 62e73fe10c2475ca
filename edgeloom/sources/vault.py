"""A page store on disk as frames: pages, coarse links, runtime edges, required fields, configuration."""

from __future__ import annotations

import json
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from edgeloom.functions.text import glob_to_regex
from edgeloom.operators.quality import LINK_FIELDS
from edgeloom.sources import frontmatter

EXCLUDE = ("_*", ".*")
EDGE = (
    "target string, type string, endpoint string, condition string, provenance string, owner string, store string, collections array<string>, access struct<this:array<string>,target:array<string>>, role string, schedule string, via string, "
    "value string, source string, extracted_from struct<repo:string,sha:string,at:string>, confidence string, grounded boolean, endpoint_expr string, unresolved_exprs array<string>"
)


def walk(root: str, exclude: tuple[str, ...] = EXCLUDE, suffix: str = ".md") -> list[str]:
    """Relative paths in order. Spark's own readers never list names that begin with _ or ., so they could not be asked for."""
    tests = [re.compile(glob_to_regex(p).replace("\\z", "\\Z")) for p in exclude]
    found = (p.relative_to(root).as_posix() for p in Path(root).rglob(f"*{suffix}") if p.is_file())
    return sorted(r for r in found if not any(t.match(part) for t in tests for part in r.split("/")))


class _Slice(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        super().__init__(len(files))
        self.files = files


class PageSource(DataSource):
    """spark.read.format("pages").option("path", root).option("exclude", "[\\"_*\\"]").load(): rel, walk_no, text.

    The folder must be one that every executor can open.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "rel string, walk_no int, text string"

    def reader(self, schema):
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.exclude, self.suffix = options["path"], tuple(json.loads(options.get("exclude", json.dumps(EXCLUDE)))), options.get("suffix", ".md")

    def partitions(self):
        files = list(enumerate(walk(self.root, self.exclude, self.suffix)))
        return [_Slice(files[i : i + 500]) for i in range(0, len(files), 500)] or [_Slice([])]

    def read(self, partition):
        for n, rel in partition.files:
            yield rel, n, (Path(self.root) / rel).read_text(encoding="utf-8", errors="replace")


def texts(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDE, suffix: str = ".md") -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.read.format("pages").option("path", root).option("exclude", json.dumps(list(exclude))).option("suffix", suffix).load()


PAGE = "rel string, walk_no int, title string, aliases array<string>, stem string, type string, updated string, curation string, fm map<string,string>, body string, fm_present boolean, parse_error string, links string, edges string"


def parse_pages(rows: DataFrame) -> DataFrame:
    """Pages from (rel, walk_no, text). Unreadable frontmatter is a parse_error, never an empty mapping; values that are
    no scalars are JSON in `fm`; links and edges are JSON for coarse_links and runtime_edges."""

    def run(frames):
        import pandas as pd

        def one(rel, walk_no, text):
            head, body = frontmatter.split(text)
            fm, error = {}, None
            try:
                fm = frontmatter.parse(head) if head is not None else {}
            except frontmatter.ParseError as e:
                error = str(e)
            flat = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in fm.items() if v is not None and v != [] and v != {}}
            alias = fm.get("aliases")
            edges = [e for e in fm.get("cross_service") or [] if isinstance(e, dict)] if isinstance(fm.get("cross_service") or [], list) else []
            links = {f: [str(x) for x in (v if isinstance(v, list) else [v])] for f in LINK_FIELDS if (v := fm.get(f))}
            text_of = lambda k: None if fm.get(k) is None else str(fm[k])
            aliases = [str(a) for a in (alias if isinstance(alias, list) else [alias] if alias else [])]
            return rel, walk_no, text_of("title"), aliases, os.path.splitext(os.path.basename(rel))[0], text_of("type"), text_of("updated"), text_of("curation_status"), flat, body, head is not None, error, json.dumps(links), json.dumps(edges)

        names = [f.split(" ")[0] for f in PAGE.split(", ")]
        for frame in frames:
            yield pd.DataFrame([one(*r) for r in zip(frame["rel"], frame["walk_no"], frame["text"], strict=True)], columns=names)

    return rows.mapInPandas(run, PAGE)


def coarse_links(pages: DataFrame, directions: dict[str, str] | None = None) -> DataFrame:
    """rel, src, field, dst, direction of the [[links]] in link fields; without an entry a field leads up."""
    found = pages.select("rel", F.col("title").alias("src"), F.explode(F.from_json("links", "map<string,array<string>>")).alias("field", "v")).select("rel", "src", "field", F.explode("v").alias("v"))
    links = found.withColumn("dst", F.explode(F.regexp_extract_all("v", F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), 1))).withColumn("dst", F.trim("dst"))
    table = F.create_map(*[F.lit(x) for kv in ({"": ""} | (directions or {})).items() for x in kv])
    return links.withColumn("direction", F.coalesce(F.try_element_at(table, F.col("field")), F.lit("up"))).drop("v")


def runtime_edges(pages: DataFrame) -> DataFrame:
    """rel, page, pos and the fields of each cross_service edge; a stamp that lacks a part is dropped as a whole."""
    e = pages.select("rel", F.col("title").alias("page"), F.posexplode(F.from_json("edges", _EDGES)).alias("pos", "e")).select("rel", "page", "pos", "e.*")
    stamp = F.col("extracted_from")
    whole = stamp["repo"].isNotNull() & stamp["sha"].isNotNull() & stamp["at"].isNotNull()
    return e.withColumn("extracted_from", F.when(whole, stamp)).withColumn("dst", F.col("target"))


_EDGES = "array<struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in re.split(r",(?![^<]*>)", EDGE)) + ">>"


def required_fields(spark: SparkSession, root: str) -> DataFrame:
    """type, field from the fenced block under "Required Frontmatter" of the pages in _schema."""
    rows = []
    for p in sorted(Path(root).glob("_schema/*.md")):
        m = re.search(r"##\s*Required Frontmatter.*?```[a-z]*\n(.*?)```", p.read_text(encoding="utf-8"), re.S)
        rows += [(p.stem, k) for k in re.findall(r"^([A-Za-z_][\w-]*)\s*:", m[1], re.M)] if m else []
    return spark.createDataFrame(rows, "type string, field string")


def scan_config(root: str, name: str = ".pages.toml") -> dict:
    """exclude and directions of the store's configuration file, with defaults where it says nothing."""
    import tomllib

    path = Path(root) / name
    config = tomllib.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    return {"exclude": tuple(config.get("scan", {}).get("exclude", EXCLUDE)), "directions": config.get("fields", {}).get("direction", {})}


def write_atomic(path: str, text: str) -> None:
    """The file whole or not at all."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def write_pages(pages: DataFrame, root: str, overwrite: bool = False) -> int:
    """Writes (path, text) below root, each page by the task that holds it; pages that are there stay unless `overwrite`.

    The folder must be one that every executor can open. A page is written whole or not at all, so that a task which
    runs again finds it there and counts it no more: the number is of pages that its last run wrote.
    """

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            n = 0
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.join(root, path)
                if overwrite or not os.path.exists(target):
                    write_atomic(target, text)
                    n += 1
            yield pa.RecordBatch.from_pydict({"n": [n]})

    written = pages.select("path", "text").mapInArrow(write, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
