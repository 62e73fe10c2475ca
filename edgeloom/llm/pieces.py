"""SentencePiece encoding and decoding by a lattice of pieces.

Substrings of bounded length are exploded from the distinct words, equi-joined to the piece table and grouped by word;
a fold over a word's edges then finds its segmentation. The model at hand is a BPE model. The path of largest score sum
(Viterbi) is not its segmentation, so the fold keeps, for each end, the one edge that is compatible with the edge
before it: two pieces are if BPE leaves them as they are side by side, and of all paths only BPE's has compatible
neighbours throughout. `best_paths` is the lattice with Viterbi's fold in DataFrame operations, for models whose scores add up.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import mapped, text_of
from edgeloom.llm.lattice import Lattice, Remembered

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: ids decoded at once
_AT_ONCE = 1 << 18
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def piece_table(path: str | None = None) -> dict[str, tuple[int, float]]:
    """piece -> (id, score) of the ordinary pieces; and the ids of bytes as "<0xNN>", without a score."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
    out = {}
    for i in range(p.get_piece_size()):
        if p.is_byte(i):
            out[p.id_to_piece(i)] = (i, None)
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            out[p.id_to_piece(i)] = (i, p.get_score(i))
    return out


def words_of(text: str) -> list[str]:
    """The text with its dummy prefix, in words: no piece reaches beyond one. An empty text has none."""
    return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.fromiter(map(len, words), np.int64, len(words))


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, path: str | None = None, most: int = 800_000):
        table = piece_table(path)
        self.byte = {int(p[3:5], 16): i for p, (i, s) in table.items() if s is None}
        plain = {p: v for p, v in table.items() if v[1] is not None}
        ids = {p: i for p, (i, _) in plain.items()}
        ranks = {s: k for k, s in enumerate(sorted({s for _, s in plain.values()}, reverse=True))}
        merges = {(ids[p[:k]], ids[p[k:]]): (ranks[s], i) for p, (i, s) in plain.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        octet = {b: i.to_bytes(4, "little") for b, i in self.byte.items()}
        self.words = Remembered(Lattice(ids, merges, _code_points, lambda c: b"".join([octet[b] for b in c.encode("utf-8", "replace")])), most)
        raw = {i: p.replace(SPACE, " ").encode("utf-8", "replace") for p, i in ids.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.size = np.array([len(raw.get(i, b"")) for i in range(max(raw) + 1)], np.int64)
        self.raw = np.frombuffer(b"".join(raw.get(i, b"") for i in range(max(raw) + 1)), np.uint8)
        self.place = np.cumsum(self.size) - self.size

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The words that are new to all of them are learnt at once."""
        return self.words([words_of(t) for t in texts])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, bytes read as UTF-8, the dummy prefix dropped; ids of no piece are skipped."""
        ids, out = np.asarray(ids, np.int64), []
        ids = ids[(ids >= 0) & (ids < len(self.size))]
        for k in range(0, len(ids), _AT_ONCE):
            own = ids[k : k + _AT_ONCE]
            n = self.size[own]
            out.append(self.raw[np.arange(n.sum()) + np.repeat(self.place[own] - (np.cumsum(n) - n), n)].tobytes())
        return b"".join(out).decode("utf-8", "replace").removeprefix(" ")


def encoder(path: str | None = None) -> Pieces:
    """The encoder of this Python worker: what one task has learnt serves the next."""
    import sentencepiece

    held = sentencepiece.__dict__.setdefault("_edgeloom_pieces", {})
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


def _digest(part: pa.RecordBatch, path: str | None) -> dict:
    own = encoder(path)
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "ids_sha256", "decoded_sha256")}
    low, high = min(own.byte.values()), max(own.byte.values())
    for doc, ids in zip(part.column(0).to_pylist(), own.encode_batch(part.column(1).to_pylist()), strict=True):
        data = ids.astype("<u4").tobytes()
        decoded = own.decode(np.frombuffer(data, "<u4"))
        n_bytes = int(((ids >= low) & (ids <= high)).sum())
        for k, v in zip(out, (doc, len(ids), n_bytes, zlib.crc32(data), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), strict=True):
            out[k].append(v)
    return out


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, crc32 and SHA-256 of the ids (little-endian, 32 bits), SHA-256 of the text decoded
    from them.

    A null or empty text has no ids. Decoding gives the text back, but for U+2581, which is read as a space. Rows are
    independent: ties and repeated rows agree, null ids pass through; other columns are ignored. One narrow pass,
    no shuffle; a worker remembers a bounded number of words. path: a model file that every executor can read.
    """
    schema = "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, ids_crc32 bigint, ids_sha256 string, decoded_sha256 string"
    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), partial(_digest, path=path), schema)


def encode_column(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """docs with the array of ids of a text column (null for null)."""

    @F.pandas_udf("array<int>")
    def run(texts):
        own = encoder(path)
        return texts.map(lambda t: own.encode(t).astype(np.int32), na_action="ignore")

    return docs.withColumn(ids, run(F.col(text)))


def decode_column(df: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """df with the text of an array of ids (null for null)."""

    @F.pandas_udf("string")
    def run(rows):
        own = encoder(path)
        return rows.map(lambda x: own.decode(np.asarray(x)), na_action="ignore")

    return df.withColumn(text, run(F.col(ids)))


def pieces_frame(spark: SparkSession, path: str | None = None) -> DataFrame:
    return spark.createDataFrame([(p, i, s) for p, (i, s) in piece_table(path).items() if s is not None], "piece string, id int, score double")


def best_paths(words: DataFrame, pieces: DataFrame, byte_ids: list[int], penalty: float = 10.0) -> DataFrame:
    """word, ids, score of the segmentation of the largest score sum of each distinct non-empty word, in DataFrame
    operations only: Viterbi, as a model whose scores are log probabilities (a unigram model) is decoded.

    Substrings as long as the longest piece at most are exploded and joined to the pieces (the vocabulary: of a fixed
    size); a word's edges are grouped by their end without a further shuffle, as rows are dealt by word already, and a
    higher-order aggregate keeps for each end the best path to it (of equals the one whose last piece is longer, then the
    smaller id). A character without a piece is its UTF-8 bytes at the least score less `penalty`. Null words are left
    out, an empty table gives no rows.
    """
    facts = pieces.agg(F.max(F.length("piece")).alias("longest"), (F.min("score") - F.lit(penalty)).alias("bare"))  # one row
    own = words.select("word").where("word <> ''").distinct().crossJoin(F.broadcast(facts))
    starts = own.select("*", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least("longest", F.length("word") - F.col("s")))).alias("n")).withColumn("piece", F.expr("substring(word, s + 1, n)"))
    edges = spans.join(F.broadcast(pieces.select("piece", "id", "score")), "piece", "left").where("id is not null or n = 1")
    octets = F.expr("transform(sequence(0, octet_length(piece) - 1), i -> byte_ids[cast(conv(hex(substring(encode(piece, 'UTF-8'), i + 1, 1)), 16, 10) as int)])")
    edges = edges.withColumn("byte_ids", F.lit(byte_ids)).select(
        "word", (F.col("s") + F.col("n")).alias("e"), F.struct("s", F.coalesce("score", "bare").cast("double").alias("score"), F.when(F.col("id").isNull(), octets).otherwise(F.array("id")).alias("ids")).alias("edge")
    )
    ends = edges.repartition("word").groupBy("word", "e").agg(F.collect_list("edge").alias("edges")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("e", "edges"))).alias("ends"))
    fold = """aggregate(ends, array(named_struct('loss', cast(0 as double), 'back', 0, 'ids', cast(array() as array<int>))), (best, x) ->
        concat(best, array(array_min(transform(x.edges, g -> named_struct('loss', best[g.s].loss - g.score, 'back', g.s, 'ids', g.ids))))))"""
    walk = """aggregate(ends, named_struct('at', size(ends), 'ids', cast(array() as array<array<int>>)), (w, x) ->
        if(w.at = 0, w, named_struct('at', best[w.at].back, 'ids', concat(array(best[w.at].ids), w.ids))), w -> flatten(w.ids))"""
    return ends.withColumn("best", F.expr(fold)).select("word", F.expr(walk).alias("ids"), (-F.expr("best[size(ends)].loss")).alias("score"))
