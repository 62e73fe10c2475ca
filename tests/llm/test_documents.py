"""The document operators on rows with whatever may be wrong, and against brute force."""

import binascii
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from edgeloom.llm import media, neardup, packing, pieces, quality, queries, repeats, secrets, sharding


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


# near duplicates


def components(sets, percent=80):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingled(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_near_duplicates_are_those_of_brute_force(spark, sf, texts):
    sets = {i: shingled(t, 4) for i, t in texts.items()}
    want = components(sets)
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_minhash_circulant"](spark, sf).collect()}
    assert {i: (len(s), want[i], want[i] == i) for i, s in sets.items()} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()}


def test_near_duplicates_of_odd_rows(documents, empty):
    got = rows(neardup.near_duplicates(documents))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 12 and [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 10)] == [1, 1, 1, 4, 5, 10] and by[4]["n_shingles"] == 0
    kept = neardup.keep_one(documents)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10] and kept.columns == documents.columns
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_of_few_edges_are_written_to_few_files(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("30", "false"), strict=True):
            spark.conf.set(k, v)
        found = neardup.components(spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (30, 20), (20, 10)], "a bigint, b bigint"))
        assert found.rdd.getNumPartitions() == 1
        assert {r["id"]: r["component"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 10, 20: 10, 30: 10}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = np.append(shared, rng.integers(0, 1 << 63, 100, dtype=np.uint64)), np.append(shared, rng.integers(0, 1 << 63, 100, dtype=np.uint64))
    assert abs(np.mean(neardup.signature(a, 2000) == neardup.signature(b, 2000)) - 0.8) < 0.05


# repeated strings


def test_repeats_are_those_of_brute_force(spark, sf, texts):
    first = {}
    for d in sorted(texts):
        b = texts[d].encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    want = {}
    for d, t in texts.items():
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want[d] = (len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op4_suffix_blockwise"](spark, sf).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_repeats_of_odd_rows(documents, empty):
    got = rows(repeats.remove_repeats(documents))
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["n_removed"])
    n = len("the quick brown fox jumps over the lazy dog and runs far away from the river bank tonight ") * 3
    assert len(got) == 12 and by[1] == [0, 0] and by[2] == [n] and by[3] == [n] and by[None] == [0] and by[8] == [0]
    cut = {r["doc_id"]: r["text"] for r in repeats.cut_repeats(documents).collect()}
    assert cut[3] == "surely" and cut[2] == "" and cut[5] is None and cut[None].startswith("no id")
    assert repeats.cut_repeats(documents).columns == documents.columns and repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeated_rows_of_one_document_lose_the_same(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    x = "".join(chr(97 + i * i % 23) for i in range(60))
    rest = ["".join(chr(48 + (i * k + i // 7) % 75) for i in range(90)) for k in (3, 5, 11, 13)]
    three, seven = rest[0] + "!" + x + "!" + rest[1], rest[2] + "?" + x + "?" + rest[3]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(3, three), (7, seven), (7, seven), (7, seven)], 4), "doc_id bigint, text string")
    got = [(r["doc_id"], r["n_removed"]) for r in rows(repeats.remove_repeats(docs))]
    assert got == [(3, 0)] + [(7, 60)] * 3
    assert [r["text"] for r in rows(repeats.cut_repeats(docs))] == [three] + [rest[2] + "??" + rest[3]] * 3


def removed_by_brute_force(texts):
    first, want = {}, {}
    for d in sorted(texts):
        b = texts[d].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) < d:
                gone[i : i + 50] = b"\1" * 50
        want[d] = (len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return want


def text_batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()))], ["doc_id", "text"])


def test_rows_sent_for_repeats_do_not_grow_with_the_square_of_the_text():
    import pyarrow as pa

    letters = np.random.default_rng(3).integers(97, 123, 16 << 20, dtype=np.uint8).tobytes().decode()
    blocks = repeats._pack_blocks([text_batch({k: letters[k << 20 : k + 1 << 20] for k in range(16)})])
    sent = repeats._entries([pa.RecordBatch.from_arrays([b.column(0), b.column("data")], ["pack", "data"]) for b in blocks], 50, -(-10**10 // repeats.BUCKET))
    assert sum(b.num_rows for b in sent) < 100 * 16  # a MB, in a corpus of 10 GB


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats_over_packs_blocks_and_slices(hot, monkeypatch):
    import pyarrow as pa

    for name, value in {"HOT": hot, "BLOCK": 2000, "PACK": 9000, "SLICE": 100}.items():
        monkeypatch.setattr(repeats, name, value)
    rng = np.random.default_rng(5)
    phrases = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(20, 70))) for _ in range(60)]
    texts = {int(d): " ".join(phrases[k] for k in rng.integers(0, 60, rng.integers(0, 30))) for d in rng.permutation(200)}
    half = len(texts) // 2
    parts = [dict(list(texts.items())[:half]), dict(list(texts.items())[half:])]

    def dealt(batches, key):
        """All rows in one sorted partition, as the exchange gives them."""
        table = pa.Table.from_batches(list(batches))
        return table.sort_by(key).combine_chunks().to_batches()

    def tagged(table, tag):
        return table.add_column(1, "tag", pa.array([tag] * len(table), pa.int32()))

    blocks = [list(repeats._pack_blocks([text_batch(p)])) for p in parts]
    packed = pa.Table.from_batches(sum(blocks, []))
    assert len(packed) > len(set(packed["pack"].to_pylist())) > 3
    entries = [e for b in blocks for e in repeats._entries([x.select(["pack", "data"]) for x in b], 50, 7)]
    flags = pa.Table.from_batches(list(repeats._shared(dealt(entries, "bucket"))))
    both = pa.concat_tables([tagged(flags.select(["pack", "bucket", "data"]), 0), tagged(packed.select(["pack", "place", "data"]).rename_columns(["pack", "bucket", "data"]), 1)])
    marked = pa.Table.from_batches(list(repeats._mark(dealt(both.to_batches(), "pack"), 50, 7, False)))
    kind = {k: marked.filter(pa.compute.equal(marked["kind"], k)) for k in range(4)}
    found = pa.Table.from_batches(list(repeats._sort_suffixes(dealt(kind[2].select(["bucket", "pack", "data"]).to_batches(), "bucket"), 50)))
    late = pa.concat_tables([tagged(t.select(["pack", "data"]), tag) for t, tag in ((found, 0), (kind[3], 0), (kind[1], 1))])
    done = [*repeats._results(kind[0].select(["data"]).to_batches()), *repeats._finish(dealt(late.to_batches(), "pack"), 50, False)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for b in done for r in b.to_pylist()}
    assert got == removed_by_brute_force(texts) and len(kind[2]) and bool(len(kind[3])) == (hot == 2)


def test_removed_characters_stay_whole(spark):
    shared = "ä" * 24 + "b"  # 49 bytes; with one byte of a two-byte neighbour it makes a string of 50
    docs = spark.createDataFrame([(1, shared + "é" + "1" * 60), (2, shared + "ê" + "2" * 60)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in repeats.cut_repeats(docs).collect()}
    assert got == {1: shared + "é" + "1" * 60, 2: "ê" + "2" * 60}


@pytest.mark.parametrize("data", [b"", b"a", b"banana" * 40, b"a" * 300, bytes(range(256)) * 3, b"\0" * 70 + b"ab" * 50])
def test_suffix_array(data):
    from edgeloom.llm.suffixes import COVER, V, suffix_array

    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V))
    assert suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


# secrets


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_base_spans(spark, sf, texts):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_secret_scan"](spark, sf).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        assert got[d]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(got[d]["spans"].split(","))
        assert (got[d]["n_assign"], got[d]["n_access"], got[d]["n_hex"]) == tuple(sum(x[1] == k for x in spans) for k in range(3))


def test_lexed_secrets():
    source = 'key = "s3cr3tS3cr3t!" \nclient_secret = key\nconfig["db_password"] = "pa55" + "w0rdX9"\ncolour = "blue-and-green"\ntoken: "changeme"\n'
    found = [source[s:e] for s, e in secrets.lexed(source)]
    assert "s3cr3tS3cr3t!" in found and {"pa55", "w0rdX9"} <= set(found) and "blue-and-green" not in found and "changeme" not in found
    assert secrets.redact('a password = "hunter2hunter2" b') == 'a [secret]" b' and secrets.redact("nothing here") == "nothing here"


def test_long_secrets():
    long = "".join(chr(97 + i * 7 % 26) + str(i % 10) for i in range(3200))
    for source in (f'private_key = "{long}"', f"private_key='{long}' + 'Zz9{long}'", f"private_key={long}", f'"private_key": "{long}\\n{long}"'):
        assert long not in secrets.redact(source) and max(e for _, e in secrets.lexed(source)) >= len(source) - 1
    assert secrets.lexed('private_key = "' + long + "\n") == []


def test_secrets_of_many_names_and_parts():
    many = "".join(f"v{i} = {i}\n" for i in range(5000)) + 'k = "s3cr3tS3cr3t!"\nclient_secret = k\n'
    assert [many[s:e] for s, e in secrets.lexed(many)] == ["s3cr3tS3cr3t!"]
    parts = "k = " + " + ".join(f'"Ab{i}"' for i in range(100)) + "\nclient_secret = k\n"
    assert [parts[s:e] for s, e in secrets.lexed(parts)] == [f"Ab{i}" for i in range(100)]
    grown = 'x = "s3cr3tS3cr3t!"\n' + 'x = "a" + x + x\n' * 20000 + "client_secret = x\n"
    assert len(secrets.lexed(grown)) == 20001
    for value in ("your-" + "k" * 40, "x" * 40, "<" + "a b" * 20 + ">", "${" + "Ab1" * 20 + "}", "%(" + "Ab1" * 20 + ")s"):
        assert secrets.literal_score(value) == 0
    assert secrets.literal_score("your-" + "k" * 40 + "-") > 0 and secrets.literal_score("${" + "Ab1" * 20) > 2


S = "aB3$kk9QzL0pX8w"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (f"token: str = \"{S}\"", [S]),
        (f"client_secret = \"\"\"{S}\"\"\"", [S]),
        (f"auth_token = `{S}`", [S]),
        (f"secret_key = <<EOF\n{S}\nEOF\n", [S]),
        (f"private_key: |\n  {S}\nnext: 3", [S]),
        (f'auth_token = r"{S}" "zz9"', [S, "zz9"]),
        (f'# x = "{S}"\nauth_token = x', []),
        (f'# auth_token = "{S}"', [S]),
        (f'{{"authToken": "{S}"}}', [S]),
        ('db_passphrase = "correct horse battery staple"', ["correct horse battery staple"]),
        ('password: "please read the rules carefully."', []),
        ('auth_token = "' + S * 400 + '"', [S * 400]),
        ("x" * 200 + f'_auth_token = "{S}"', [S]),
        ("auth_token = '" + S, []),
        ("a = `" * 3 + f'\nauth_token = "{S}"', [S]),
        ("".join(f"k{i} = 'v{i}alue'\n" for i in range(4200)) + f"k0 = '{S}'\nauth_token = k0", [S]),
    ],
)
def test_lexer(source, want):
    assert [source[s:e] for s, e in secrets.lexed(source)] == want


@pytest.mark.parametrize("unit", ["`", "a='", 'a="""', "a=<<E\n", "a: |\n", "a=b+", "a.b-", "# a=\n", "a=x[b=x[", "a='x' + ", "x = x + x\n", 'a="b" '])
def test_lexer_takes_linear_time(unit):
    import time

    began = time.process_time()
    secrets.lexed(unit * (400_000 // len(unit)))
    assert time.process_time() - began < 10


def test_secrets_of_odd_rows(documents, empty):
    got = rows(secrets.scan_secrets(documents))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 12 and (by[9]["n_assign"], by[9]["n_access"], by[9]["n_hex"]) == (1, 1, 1) and by[5]["spans"] == "" and by[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(documents).collect()}
    assert "hunter2" not in clean[9] and "AKIA" not in clean[9] and clean[5] is None and clean[6] == "x"
    assert secrets.redact_secrets(empty).columns == documents.columns and secrets.scan_secrets(empty).count() == 0


# media


def test_stored_texts(spark, sf, texts):
    for r in queries.QUERIES["op2_media_signature"](spark, sf).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (44 + len(payload), hashlib.sha256(media.to_wav(payload)).hexdigest())


def test_media_of_odd_rows(documents, empty):
    got = rows(media.store_texts(documents))
    assert len(got) == 12 and {r["payload_bytes"] for r in got if r["doc_id"] in (4, 5, 6)} == {192} and media.store_texts(empty).count() == 0


def chunk(kind, data):
    import struct

    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def test_sniffing(spark):
    import gzip

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"abc") + chunk(b"IEND", b"")
    broken = png[:20] + b"\xff" + png[21:]
    packed = gzip.compress(b"hello")
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x01\x00\x00\x3b"
    assert media.sniff(png) == [("image/png", 0, len(png))] and media.sniff(broken) == [] and media.sniff(gif) == [("image/gif", 0, len(gif))]
    assert media.sniff(b"junk" + png + packed) == [("image/png", 4, 4 + len(png)), ("application/gzip", 4 + len(png), 4 + len(png) + len(packed))]
    wav = media.to_wav(b"ab" * 8)
    assert media.sniff(wav) == [("audio/wav", 0, len(wav))] and media.from_wav(wav) == b"ab" * 8
    df = spark.createDataFrame([(1, png + packed, "image/gif"), (2, b"text", "text/plain"), (3, None, "x"), (4, wav, "audio/wav")], "id int, data binary, declared string")
    got = {r["id"]: (r["media_type"], r["type_corrected"], [(e["type"], e["start"]) for e in r["embedded"]]) for r in media.sniff_column(df, declared="declared").collect()}
    assert got == {1: ("image/png", True, [("application/gzip", len(png))]), 2: ("text/plain", False, []), 3: ("x", False, []), 4: ("audio/wav", False, [])}


# packing


def check_packing(got, ids_of, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for doc, ids in ids_of.items():
        rs = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in rs] == [(i, s, min(capacity, len(ids) - s)) for i, s in enumerate(range(0, len(ids), capacity))]
        assert [r["ids_crc32"] for r in rs] == [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in rs]
    return len(by_sequence)


def test_packing(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 0] for d, x in texts.items()}
    n = check_packing(queries.QUERIES["op6_best_fit_packing"](spark, sf).collect(), ids, 2048)
    assert n <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_packing_of_odd_rows(documents, empty):
    got = rows(packing.pack(documents))
    assert sum(r["doc_id"] == 1 for r in got) == 2 and [r["length"] for r in got if r["doc_id"] in (4, 5)] == [1, 1] and sum(r["doc_id"] == 8 for r in got) > 1 and packing.pack(empty).count() == 0


def test_words_in_bytes_are_those_of_the_pattern():
    from edgeloom.llm import wordtable

    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    rng = np.random.default_rng(11)
    letters = np.array(list("''srtvelmd_.0 aé×÷µßœ–…€\n\t\x0b¡\x00\x7f"))
    for _ in range(3000):
        text = "".join(rng.choice(letters, int(rng.integers(0, 15))).tolist())
        raw = text.encode() + b"\n"
        start, size = wordtable.word_bounds(np.frombuffer(raw, np.uint8))
        assert [raw[s : s + n].decode() for s, n in zip(start.tolist(), size.tolist(), strict=True)] == [w for k in text.split() for w in pattern.findall(k)]


def test_ids_by_a_table_of_words_that_forgets():
    import public_tokenizers

    from edgeloom.llm import wordtable

    own = packing.Ids(public_tokenizers.path("word_bpe_49k.json"), most=300)
    own.words.most_ids = 1000
    rng = np.random.default_rng(12)
    letters = np.array(list("''srtvelmd_.0 aé×÷µßœ–…€ABCÉstion\x00\n  日"))
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 90))).tolist()) + "x" * k for k in range(80)]
    texts += ["a" * 70_000 + " " + "-" * 5000, "", "b" * 15 + "\0 " + "b" * 15 + " " + "b" * 16, "".join(rng.choice(list("etaoinsh "), 900_000).tolist())]
    for at in range(0, len(texts), 30):
        for text, ids in zip(texts[at : at + 30], own(texts[at : at + 30]), strict=True):
            assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert 0 < own.words.count <= wordtable.AT_ONCE


def test_fullest_combination():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5), strict=True)}
        room = int(rng.integers(0, 60))
        found = packing.fullest(counts, sorted(counts, reverse=True), room)
        best = max(s for pick in itertools.product(*(range(v + 1) for v in counts.values())) if (s := sum(k * n for k, n in zip(counts, pick, strict=True))) <= room)
        assert sum(k * n for k, n in found) == best and all(n <= counts[k] for k, n in found)


# pieces


def test_pieces_are_those_of_the_library(spark, sf, texts):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for r in queries.QUERIES["op7_sentencepiece_lattice"](spark, sf).collect():
        ids = np.array(p.encode(texts[r["doc_id"]]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_crc32"], r["ids_sha256"]) == (len(ids) // 4, zlib.crc32(ids), hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].replace("▁", " ").encode()).hexdigest()


def test_best_paths_are_those_of_brute_force(spark, texts):
    words = sorted({w for t in texts.values() for w in pieces.words_of(t)})[::29] + ["▁▁▁▁▁x", "aaaa", "日①", "a" * 70]
    frame = spark.createDataFrame([(w,) for w in [*words, *words[:3], None, ""]], "word string")
    table = {p: v for p, v in pieces.piece_table().items() if v[1] is not None}
    own = pieces.Pieces()
    got = {r["word"]: r for r in pieces.best_paths(frame, pieces.pieces_frame(spark), [own.byte[b] for b in range(256)]).collect()}
    bare = min(s for _, s in table.values()) - 10
    assert set(got) == set(words)
    for w in words:
        best = [0.0]
        for e in range(1, len(w) + 1):
            paths = [best[s] + table[w[s:e]][1] for s in range(max(0, e - 16), e) if w[s:e] in table]
            best.append(max([*paths, *([] if w[e - 1] in table else [best[e - 1] + bare])]))
        assert got[w]["score"] == pytest.approx(best[-1]) and own.decode(got[w]["ids"]) == w.replace("▁", " ").removeprefix(" ")
    assert pieces.best_paths(frame.limit(0), pieces.pieces_frame(spark), list(range(256))).count() == 0


def test_pieces_of_long_runs():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = np.random.default_rng(5)
    run = "".join(rng.choice(list("abcdenstio日é"), 100_000).tolist())
    own = pieces.Pieces(most=200)
    odd = [run, run[:65], run[:64], "a" * 1000, " " * 300 + "x", "\u2581 \u2581", "日①" * 40, "", "x" * 64 + " " + "x" * 65, "\ud83d\ude00"[:0] + "😀é\n\t"]
    for text, ids in zip(odd, own.encode_batch(odd), strict=True):
        assert ids.tolist() == p.encode(text) and own.decode(ids) == text.replace("\u2581", " ")


def test_pieces_of_odd_rows(spark, documents, empty):
    got = rows(pieces.encode_documents(documents))
    assert len(got) == 12 and [r["n_tokens"] for r in got if r["doc_id"] in (4, 5)] == [0, 0] and pieces.encode_documents(empty).count() == 0
    back = pieces.decode_column(pieces.encode_column(documents), out := "ids", "again").select("text", "again").collect()
    assert out and all(r["text"] == r["again"] for r in back)


# quality


def test_quality(spark, sf, texts):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_quality_fm"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(labels[d], r["score"]) for d, r in got.items() if r["held_out"] and d in labels]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert sum(a > b for a in good for b in bad) >= 0.8 * len(good) * len(bad)


def test_scores_of_a_column_follow_no_batch_size(monkeypatch):
    import pyarrow as pa

    texts, seen = [f"Text {k} " * 150 for k in range(6000)], []
    monkeypatch.setattr(quality, "scores", lambda _, raw: seen.append(sum(map(len, raw))) or np.arange(len(raw)) / 10_000)
    assert len(quality.score_column(pa.array(texts), {})) == 6000 and len(quality.score_column(pa.array([], pa.string()), {})) == 0
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= (1 << 20) + 2000


def test_slices_give_freed_memory_back():
    import pyarrow as pa

    from edgeloom.llm.common import rows_by_bytes

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    batch = pa.RecordBatch.from_pydict({"text": ["a", "b"]})
    pinned = []
    for _ in rows_by_bytes([batch]):
        held = [bytes(100_000) for _ in range(3000)]
        pinned.append(bytes(100_000))  # what lies above keeps the freed memory from going back by itself
        high = resident()
        del held
    assert pinned and resident() < high - 200


def test_anchors_take_little_memory_and_long_strings():
    import tracemalloc

    data = np.random.default_rng(3).integers(97, 123, 3 << 20, dtype=np.uint8)
    repeats._held.clear()
    tracemalloc.start()
    try:
        repeats.anchors(data, np.array([0, 1 << 20, 3 << 20]), 50)
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()
    assert len(repeats.anchors(data, np.array([0, 1 << 20, 3 << 20]), 200_000)["lo"])


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    x, v = rng.normal(size=(3, 6)).astype(np.float32), rng.normal(size=(6, 2)).astype(np.float32)
    model = {"w0": 0.5, "w": rng.normal(size=6).astype(np.float32), "v": v, "shift": np.zeros(6, np.float32), "scale": np.ones(6, np.float32)}
    want = [0.5 + r @ model["w"] + sum(r[i] * r[j] * (v[i] @ v[j]) for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(quality.margin(model, x), want, atol=1e-4)


def test_quality_of_odd_rows(spark, documents, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (9, None), (6, 0), (7, 1)], "doc_id bigint, quality int")
    got = rows(quality.score_quality(documents, labels))
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["score"])
    assert len(got) == 12 and by[4] == by[5] and by[1] == by[2] and len(by[1]) == 1
    assert {r["score"] for r in quality.score_quality(documents, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0 and quality.keep_good(documents, labels.limit(0)).columns == documents.columns


# shards


def test_shards(spark, sf, texts):
    got = queries.QUERIES["op10_hilbert_shards"](spark, sf).collect()
    check_shards(got, texts, 24)


def check_shards(got, texts, shards):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "bytes") and 0 <= r["shard"] < shards and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert len(got) == len(texts)


def test_shards_of_odd_rows(documents, empty):
    got = rows(sharding.shard_documents(documents, 3))
    assert len(got) == 12 and {r["size"] for r in got if r["doc_id"] in (4, 5)} == {8} and sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3)])
def test_hilbert_curve_is_a_path(n, bits):
    import itertools

    points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    index = sharding.hilbert(points, bits)
    assert sorted(index.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1) == 1).all()
