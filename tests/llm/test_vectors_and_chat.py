"""Neighbours against brute force; chat templates read back; the pipeline stage by stage."""

import hashlib

import numpy as np
import pytest

from edgeloom.llm import chat, neighbours, queries


def exact(ids, x, query, top):
    s = np.add.reduce(x * x[query], axis=1)
    order = [i for i in np.lexsort((ids, -s)) if i != query][:top]
    return [(int(ids[i]), s[i]) for i in order]


def test_recall(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(float)
    got = queries.QUERIES["op1_rp_forest"](spark, sf).toPandas().sort_values(["query_id", "rank"])
    found = total = 0
    for q, rows in got.groupby("query_id"):
        want = exact(ids, x, int(np.flatnonzero(ids == q)[0]), 20)
        assert list(rows["rank"]) == list(range(1, 21))
        found += len({i for i, _ in want} & set(rows["vec_id"]))
        total += 20
    assert set(got["query_id"]) == {i for i in ids if i % 20 == 0} and found >= 0.9 * total


def test_few_candidates_still_find_most(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), every=100, top=5, most=4000).toPandas()
    hits = sum(len({i for i, _ in exact(np.arange(3000), x, q, 5)} & set(r["vec_id"])) for q, r in got.groupby("query_id"))
    assert hits >= 0.8 * 150  # a third of all were looked at


def test_recall_with_the_budget_in_force(spark):
    """20,000 vectors around 300 centres, of which a query looks at about 7 in 100."""
    n, every, top = 20_000, 200, 20
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(300, 32))[rng.integers(0, 300, n)] + 0.6 * rng.normal(size=(n, 32))) * rng.uniform(0.8, 1.2, (n, 1))
    assert neighbours.candidates_for(n) < 0.08 * n * neighbours.TREES
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(8)
    got = neighbours.nearest(frame, every=every, top=top).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for q, rows in got.groupby("query_id"):
        want = dict(exact(np.arange(n), x, q, top))
        found = dict(zip(rows["vec_id"], rows["score"], strict=True))
        hits += len(want.keys() & found.keys())
        assert all(found[i] == pytest.approx(want[i], rel=1e-12) for i in want.keys() & found.keys()) and q not in found
    assert got["query_id"].nunique() == n // every and hits >= 0.9 * top * n // every


def test_odd_vectors(spark):
    v = [1.0, 2.0]
    rows = [(0, v), (20, v), (1, v), (2, [2.0, 4.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0, float("nan")]), (7, [1.0]), (None, v), (8, [-1.0, -2.0]), (2, [2.0, 4.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, top=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 10.0), (0, 2, 1, 5.0), (0, 3, 20, 5.0), (20, 1, 2, 10.0), (20, 2, 0, 5.0), (20, 3, 1, 5.0)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_copies_of_one_vector(spark):
    rows = [(i, [1.0, 0.0]) for i in range(500)] + [(1000 + i, [0.0, 1.0 + i]) for i in range(30)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), top=4).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by[0] == [1, 2, 3, 4] and by[400] == [0, 1, 2, 3] and by[1000] == [1029, 1028, 1027, 1026] and len(by) == 27


def rendered(template, **variables):
    return "".join(p for p, _ in chat.compile_template(template)(variables))


def test_templates():
    assert rendered("{% for m in xs %}{% if m.a == 1 and not m.b %}{{ m.c | upper }}{% elif m.a %}-{% else %}{{ 'x' ~ (1 + 2) }}{% endif %}{% endfor %}", xs=[{"a": 1, "c": "q"}, {"a": 2}, {}]) == "Q-x3"
    assert chat.fold(chat.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}")) == [("text", "abcd")]
    assert rendered("{% set a = 'z' %}{{ a }}{{ missing.b[0] }}") == "z"
    masked = [p for p, m in chat.compile_template("a{% generation %}{{ x }}{% endgeneration %}b")({"x": "y"}) if m]
    assert masked == ["y"]
    for wrong in ("{% if x %}", "{{ x.__class__() }}", "{{ x | nothing }}", "{% for %}{% endfor %}", "{{ (1 }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(wrong)


@pytest.mark.parametrize("text", ["", "###", "</turn>", "\\", "\\\\### Assistant:", "a</turn>\n### b:\n", "\\</turn", "##" * 3, "</tur</turn>n>", "x</turn>\n", "x</turn>\n</turn>\n", "x</turn>\n###", "x\\", "x</turn>\\", "x</turn", "\\" * 9 + "</turn>\n", "\n", "a" * 100_000 + "</turn>\n"])
def test_escapes_are_reversible(text):
    assert chat.unescape_text(chat.escape_text(text)) == text and chat.unescape_name(chat.escape_name(text + ":\n")) == text + ":\n"
    pieces = chat.compile_template(chat.CHAT)({"messages": [{"role": text, "text": text}, {"role": "assistant", "text": text}]})
    pieces = list(pieces)
    want = [(text, text, ""), ("assistant", text, text)]
    assert [(r, t, "".join(i)) for r, t, i, _ in chat.read_turns(pieces)] == want
    single = [(c, m) for p, m in pieces for c in p] if len(text) < 1000 else pieces  # pieces of one character each
    assert [(r, t, "".join(i)) for r, t, i, _ in chat.read_turns(single)] == want


def digests(turns):
    own = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(own.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(spark, sf):
    want = {-7: [(r, r"\### Assistant: </turn> ok") for r in ("user", "assistant")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.QUERIES["op9_chat_template"](spark, sf).collect()}
    assert {c: digests(t) for c, t in want.items()} == {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()}
    formatted = {r["conv_id"]: r for r in chat.format_conversations(chat.with_probe(spark, spark.read.parquet(f"{sf}/conversations.parquet"))).collect()}
    assert all(len(formatted[c]["formatted"]) == r["formatted_chars"] for c, r in got.items())


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (None, 5, None, "x"), (2, None, "user", ""), (2, 3, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest_conversations(df).collect()}
    assert got == {1: digests([("user", ""), ("user", ""), ("assistant", "b")]), None: digests([("", "x")]), 2: digests([("user", ""), ("assistant", "")])}
    assert chat.digest_conversations(df.limit(0)).count() == 0


def test_conversations_with_control_strings_and_many_turns(spark):
    endings = ["ends </turn>\n", "half </tur", "\\", "### ", "\\</turn>\n"]
    turns = {1: [("user" if k % 2 else "assistant", endings[k % 5] * (1 + k % 3)) for k in range(5_000)], 2: [("user", "z" * 3_000_000), ("assistant", "</turn>\n" * 50_000)]}
    df = spark.createDataFrame([(c, k, r, t) for c, own in turns.items() for k, (r, t) in enumerate(own)], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest_conversations(df).collect()}
    assert got == {c: digests(own) for c, own in turns.items()}


def test_pipeline_on_odd_rows(spark, sf, documents, empty):
    """Nulls, empty and long texts, ties, repeats and further columns of any name go through every stage."""
    import corpus_pipeline as pipeline

    names = {"score": "_kept", "n": "_id"}
    odd = documents.withColumnsRenamed(names).withColumn("_whole", documents["text"]).withColumn("_md5", documents["lang"]).withColumn("key", documents["lang"]).withColumn("row", documents["doc_id"])
    for start in (odd, odd.limit(0)):
        docs = start
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            kept = out.collect()
            if name != "best_fit_packing":
                assert out.columns == odd.columns and len(kept) <= docs.count()
            docs = spark.createDataFrame(kept, out.schema) if kept or start is not odd else out
        assert bool(kept) == (start is odd)
    assert empty.count() == 0


def test_stages_on_odd_rows(spark, documents):
    """What each stage after the classifier makes of them: one of the three copies of doc 1 stays, secrets go."""
    import corpus_pipeline as pipeline

    near = pipeline.near_duplicates(spark, documents, "").collect()
    assert sorted(r["doc_id"] for r in near if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 9, 10] and sum(r["doc_id"] is None for r in near) == 1
    cut = {r["doc_id"]: r["text"] for r in pipeline.repeated_passages(spark, documents, "").collect()}
    assert cut[5] is None and cut[4] == "" and cut[8] == next(r["text"] for r in documents.collect() if r["doc_id"] == 8) and len(cut[2]) < 50
    clean = {r["doc_id"]: r["text"] for r in pipeline.secret_scan(spark, documents, "").collect()}
    assert "hunter2" not in clean[9] and clean[5] is None and clean[8] == cut[8]


def test_pipeline(spark, sf):
    """Each stage against what brute force keeps of what the stage before kept."""
    import corpus_pipeline as pipeline
    from edgeloom.llm import quality, secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, texts, frames = [n for n, _ in pipeline.STAGES], [], []
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        frames.append(out)
        texts.append({r["doc_id"]: r["text"] for r in out.collect()} if "text" in out.columns else None)
        docs = out
    assert len(names) == 5 and all(f.columns == frames[0].columns for f in frames[:4])
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(texts[0]) == {d for d, p in scores.items() if p}

    from test_documents import components, shingled

    sets = {d: shingled(t or "", 5) for d, t in texts[0].items()}
    assert set(texts[1]) == {d for d, c in components(sets).items() if c == d}
    assert set(texts[2]) == set(texts[1]) == set(texts[3])
    first: dict[bytes, int] = {}
    for d in sorted(texts[1]):
        b = texts[1][d].encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t in texts[1].items():
        b, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        at, left = 0, []
        for c in t:  # a character goes only if all its bytes do
            n = len(c.encode())
            if not all(gone[at : at + n]):
                left.append(c)
            at += n
        assert texts[2][d] == "".join(left)
        assert texts[3][d] == secrets.redact(texts[2][d])
    packed = frames[4].collect()
    assert {r["doc_id"] for r in packed} == set(texts[3])
    again = pipeline.run(spark, sf)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
