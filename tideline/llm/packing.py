"""Shortest-pack-first packing of documents over the histogram of their lengths.

Documents are tokenized and cut into pieces of the sequence length and one rest. The histogram of
piece lengths (at most as many rows as the sequence length) is packed on the driver: lengths longest
first, each into the packing patterns with the most room, by counts of patterns, never by single
documents. Patterns then meet pieces by rank: the n-th piece of a length takes the n-th place that
the patterns have for that length. Ranks come from counts by (length, shard) and a row number inside
a shard, so that no task sees all pieces of a length.

Cases: a null or empty text has the end id alone. Ties and repeated rows are packed each for itself.
An empty table gives an empty result. Extra columns aren't carried.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.bpe import byte_table
from tideline.llm.chunks import WITHOUT_SPACE, ChunkIds, encoded
from tideline.llm.common import by_size, materialize, shuffle_partitions

LENGTH = 2048
END_ID = 1


#: Letters and numbers below U+0250, where lower case and composition depend on single characters only.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{_LETTERS}{_NUMBERS}]+")
#: What needs the library's whole pipeline: other characters, special tokens, controls.
ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]|[^\x00-\u024f]|<\\|")


class WordBpe:
    """The ids of whole texts by a tokenizers file that drops white space and ends words.

    Chunks are encoded once each (``ChunkIds``): their pieces by the library's model alone, those with
    odd characters by the library's whole pipeline. A piece's last id is the only one that ends a word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.chars = str.maketrans({chr(b): c for b, c in enumerate(byte_table())})
        vocabulary = self.whole.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks = ChunkIds(self.pieces, self.learnt)

    def learnt(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and of chunks marked by a leading zero, in a row, and how many each has."""
        odd = [k for k, p in enumerate(pieces) if p[0] == "\0"]
        whole = {k: e.ids for k, e in zip(odd, self.whole.encode_batch_fast([pieces[k][1:] for k in odd], add_special_tokens=False), strict=True)} if odd else {}
        plain = [p if p.isascii() else p.encode().decode("latin-1").translate(self.chars) for p in pieces if p[0] != "\0"]
        ids = encoded(self.model, plain)
        sizes = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
        if not whole:
            return ids, sizes
        ends, all_ids, all_sizes, k = np.cumsum(sizes).tolist(), [], [], 0
        for n in range(len(pieces)):
            own = whole[n] if n in whole else ids[ends[k - 1] if k else 0 : ends[k]]
            k += n not in whole
            all_ids.append(np.asarray(own, dtype=np.uint32))
            all_sizes.append(len(own))
        return np.concatenate(all_ids), np.array(all_sizes, dtype=np.int64)

    @staticmethod
    def pieces(chunk: str) -> list[str]:
        """The pieces of a chunk; a chunk that needs the library's whole pipeline is one, marked by a leading zero."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
        return ["\0" + chunk] if ODD.search(chunk) else PIECES.findall(chunk.lower())

    @staticmethod
    def split(text: str) -> list[str]:
        # str.split takes the separators for white space, the library doesn't
        return WITHOUT_SPACE.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids end."""
        return self.chunks.of([self.split(t) for t in texts])


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(documents: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece; a narrow map, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            keys = batch["doc_id"].astype("Int64")
            for first, last in by_size(texts, 1 << 20):
                ids, ends = encoder(path).encode(texts[first:last])
                n = np.diff(ends, prepend=0) + 1
                own = np.insert(ids, ends, end_id).astype("<u4")
                count = -(-n // length)
                doc = np.repeat(np.arange(last - first), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(length, n[doc] - start)
                at = (np.cumsum(n) - n)[doc] + start
                data = memoryview(own.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": keys.iloc[first:last].iloc[doc].array, "start": start, "length": size, "ids_crc32": np.array(crc, dtype=np.int64), "doc_tokens": n[doc]})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern, by shortest-pack-first over the histogram.

    The number of patterns depends on how many lengths there are, not on how many pieces.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    full = []

    def add(count: int, pack: tuple[int, ...], left: int) -> None:
        (room[left] if left else full).append((count, pack))

    for size in range(length, 0, -1):
        n, left = histogram.get(size, 0), length
        while n > 0:
            while left >= size and not room.get(left):
                left -= 1
            if left < size:
                add(n, (size,), length - size)
                break
            count, pack = room[left].pop()
            if count > n:
                room[left].append((count - n, pack))
            used = min(count, n)
            add(used, (*pack, size), left - size)
            n -= used
    return full + [p for packs in room.values() for p in packs]


def places(found: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank) of runs of places, their first sequences and offsets."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pack in found:
        offset = 0
        for size in pack:
            rows.append((size << 40 | rank[size], sequence, offset))
            rank[size] += count
            offset += size
        sequence += count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def ranked(cut: DataFrame, shards: int) -> DataFrame:
    """``cut`` with each piece's rank among the pieces of its length, from 0."""
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("int"))
    counts = cut.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = counts.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32"))
    return cut.withColumn("inside", inside).join(before, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("shard", "before", "inside")


def pack(documents: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and offset there."""
    cut = materialize(pieces(documents, path, length, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, sequences, offsets = places(patterns(histogram, length))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key = (batch["length"].to_numpy() << 40) | batch["rank"].to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            batch["sequence_id"] = sequences[at] + key - keys[at]
            batch["offset"] = offsets[at]
            yield batch.drop(columns="rank")

    rows = ranked(cut, shuffle_partitions(documents.sparkSession)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return rows.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
