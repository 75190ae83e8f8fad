"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks file lists tokens as bytes. Bytes are mapped to printable characters one to one, so that a
token becomes a string of the library's BPE model; a rank's merges are all splits of its token into
two known tokens, in rank order, since byte-pair encoding by ranks joins any two neighbours whose
bytes make a token, the lowest rank first. An id's offsets are where its bytes start and end; one that starts
inside a character's bytes shares the character with the id before. Decoding joins the characters of all ids,
takes them through the reversed byte table, and reads UTF-8 only then, so a character that was split over
several ids comes back whole; bytes that aren't UTF-8 become U+FFFD.

Cases: a null text counts as empty and gives no ids. Texts of any length are encoded whole. Ties and
repeated rows are encoded alike; an empty table gives an empty result; extra columns aren't carried.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.chunks import WITH_SPACE, ChunkIds, encoded
from tideline.llm.common import by_size


def byte_table() -> list[str]:
    """A printable character for each byte; printable Latin-1 stands for itself."""
    keeps = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keeps else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """An encoder and decoder for one ranks file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        table = byte_table()
        self.to_chars = str.maketrans({chr(b): c for b, c in enumerate(table)})
        self.to_byte = np.zeros(512, dtype=np.uint8)  # the byte table reversed
        self.to_byte[[ord(c) for c in table]] = np.arange(256)
        with open(path, "rb") as f:
            ranks = {self.mapped(base64.b64decode(token)): int(rank) for token, rank in map(bytes.split, f)}
        by_rank = sorted(ranks, key=ranks.__getitem__)
        merges = [(t[:i], t[i:]) for t in by_rank for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(BPE(ranks, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # by id; unused ids are empty
        self.chars, self.sizes = [""] * (ranks[by_rank[-1]] + 1), np.zeros(ranks[by_rank[-1]] + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.chars[rank], self.sizes[rank] = token, len(token)
        self.decimal = [str(i) for i in range(len(self.chars))]
        self.pieces = regex.compile(pattern)
        self.chunks = ChunkIds(self.pieces.findall, self.learnt)

    def mapped(self, data: bytes) -> str:
        """A printable character for each byte."""
        return data.decode("latin-1").translate(self.to_chars)

    def learnt(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces (matches of the pattern) in a row, and how many each has: as many as make up its bytes."""
        space = self.mapped(b" ")
        mapped = [p.replace(" ", space) if p.isascii() and p.isprintable() else self.mapped(p.encode()) for p in pieces]
        ids = encoded(self.tokenizer, mapped)
        ends = np.searchsorted(self.offsets(ids)[1], np.cumsum(np.fromiter(map(len, mapped), np.int64, len(mapped)))) + 1
        return ids, np.diff(ends, prepend=0)

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's bytes start and end."""
        ends = np.cumsum(self.sizes[ids])
        return ends - self.sizes[ids], ends

    def to_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, through the reversed byte table."""
        text = "".join([self.chars[i] for i in ids.tolist()])
        return self.to_byte[np.frombuffer(text.encode("utf-16-le"), dtype="<u2")].tobytes()

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids and for each the first code point it has bytes of, and the one after the last."""
        ids, _ = self.chunks.of([WITH_SPACE.findall(text)])
        starts, ends = self.offsets(ids)
        first = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
        character = np.cumsum(first) - 1
        return ids.tolist(), character[starts].tolist(), (character[ends - 1] + 1).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.to_bytes(np.array(ids, dtype=np.int64)).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, hash of the ids, and hash of what the ids decode to, for each text."""
        for first, last in by_size(texts):
            ids, ends = self.chunks.of([WITH_SPACE.findall(t) for t in texts[first:last]])
            begin = 0
            for end in ends.tolist():
                own = ids[begin:end]
                begin = end
                data = self.to_bytes(own)
                decimal = ",".join([self.decimal[i] for i in own.tolist()])
                yield len(own), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(data).hexdigest()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One for each worker process; ``path`` must be readable there."""
    return ByteBpe(path, pattern)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in batch.column("text").to_pylist()]


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a narrow map over Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(codec(path, pattern).digests(_texts(batch)))
            n, ids, data = zip(*rows, strict=True) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, starts, ends: whole texts' ids with their code-point offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [codec(path, pattern).encode(t) for t in _texts(batch)]
            columns = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "ids", "starts", "ends"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of its ids (null ids: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path, pattern).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
