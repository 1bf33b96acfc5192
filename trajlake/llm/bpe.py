"""Operator 4: byte-level BPE encoding and decoding with a public vocabulary file."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, read

#: Pretokens kept with their ids; a full cache is emptied.
CACHE = 600_000
#: Pretokens longer than this aren't kept.
LONG = 64


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(others)}


class ByteBPE:
    """Encoder and decoder of a tokenizers-library JSON file with a byte-level BPE model."""

    #: Fixed value: the pretokenizer's pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: The same for texts of ASCII and Latin-1/Extended-A letters, where the standard module knows the classes.
    _LATIN = "A-Za-zªµºÀ-ÖØ-öø-ſ"
    _FAST = rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+"
    _BEYOND = r"[^\t\n\r\x0b\x0c\x20-\x7e¡-©«-±´¶-¸»¿À-ſ–-…€]"

    def __init__(self, spec: dict):
        letters = _byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.start = [vocab[letters[b]] for b in range(256)]
        #: Rank of a pair of ids (packed in one integer), and the id it makes by rank.
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.makes = [vocab[a + b] for a, b in merges]
        strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["content"]}
        strings |= {i: s.encode() for s, i in self.special.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.decimal = [str(i) for i in range(len(self.strings))]
        longest = sorted(self.special, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self._full, self._quick = regex.compile(self.PATTERN), re.compile(self._FAST)
        self._beyond = re.compile(self._BEYOND)
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str) -> ByteBPE:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pretoken: lowest-ranked pairs merge first, leftmost among equals.

        Symbols are a doubly linked list; a queue holds candidate pairs, and an
        entry whose pair has changed since is skipped as stale.
        """
        start, rank_of, makes = self.start, self.ranks.get, self.makes
        symbol = [start[b] for b in data]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            rank = rank_of(symbol[i] << 32 | symbol[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        heapify(queue)
        while queue:
            top = heappop(queue)
            i, rank = top & 0xFFFFFFFF, top >> 32
            left, j = symbol[i], after[i]
            if left < 0 or j >= n or rank_of(left << 32 | symbol[j]) != rank:
                continue
            symbol[i] = whole = makes[rank]
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(whole << 32 | symbol[k])
                if rank is not None:
                    heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbol[h] << 32 | whole)
                if rank is not None:
                    heappush(queue, rank << 32 | h)
        return tuple([s for s in symbol if s >= 0])

    def _ids(self, piece: str) -> tuple[int, ...]:
        ids = self.merge(piece.encode())
        if len(piece) <= LONG:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        return (self._full if self._beyond.search(text) else self._quick).findall(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        parts = self._split.split(text) if self._split else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
                continue
            get = self.cache.get
            for piece in self.pieces(part):
                out.extend(get(piece) or self._ids(piece))
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings in a row, as UTF-8 (malformed parts become U+FFFD)."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def _coder(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE.from_file(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole text as ``array<int>`` (null: empty).

    ``path`` is the vocabulary file, read once by each Python worker. Special
    tokens' strings in a text become their ids. An existing ``ids_col`` is
    replaced. One row a row: no shuffle.
    """
    out = docs.drop(ids_col)
    flat = out.toDF(*(f"c{k}" for k in range(len(out.columns))))
    schema = flat.withColumn("made", F.lit(None).cast("array<int>")).schema
    at = out.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in parts(batches):
            ids = [coder.encode(t or "") for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "made"])

    return flat.mapInArrow(run, schema).toDF(*out.columns, ids_col)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids (null: empty); ids past the vocabulary's last raise."""
    out = rows.drop(text_col)
    flat = out.toDF(*(f"c{k}" for k in range(len(out.columns))))
    schema = flat.withColumn("made", F.lit(None).cast("string")).schema
    at = out.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in parts(batches):
            texts = [coder.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "made"])

    return flat.mapInArrow(run, schema).toDF(*out.columns, text_col)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes what it encoded and digests both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in parts(batches):
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
                text_hex.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of every whole text of ``documents``."""
    return token_digests(read(spark, sf_dir, "documents"), default_path())
