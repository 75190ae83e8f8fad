"""Texts as chunks of white space and non-space, encoded once each by a bounded cache.

Both vocabularies' pre-tokenizers never let a piece cross from a non-space character into white
space, so a text's ids are its chunks' ids in a row, and only pieces that are new to a worker reach
the tokenizers library. When the cache is full, what was met only once goes, which changes speed only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

# one thread a task: Spark runs as many tasks as there are cores
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space as the tokenizers see it (Unicode White_Space; not the separators \x1c-\x1f).
SPACE = "\t-\r \x85\xa0  -     　"
WITH_SPACE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WITHOUT_SPACE = re.compile(f"[^{SPACE}]+")
#: Chunks and pieces that a worker keeps; a slice of texts may add its own to them.
CACHE = 200_000
#: Pieces that go to the library as one text: it costs less than a text each, and more than a few again.
TOGETHER = 16


class _Rows(dict):
    """Rows of chunks; a chunk that is asked for the first time gets the next row and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        row = self[chunk] = len(self)
        self.new.append(chunk)
        return row


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of all runs of ``sizes`` from ``starts``, one after another."""
    upto = np.cumsum(sizes)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


class ChunkIds:
    """The ids of chunks, each encoded once: ``pieces`` splits a chunk, ``encode`` gives the ids of pieces in a row, and how many each has."""

    def __init__(self, pieces: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.pieces, self.encode = pieces, encode
        self.clear()

    def clear(self) -> None:
        self.rows = _Rows()
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.starts, self.sizes, self.met = (np.zeros(1 << 16, dtype=np.int64) for _ in range(3))
        self.used = 0

    def _thin(self) -> None:
        """Keep the chunks that were met again since they came or since the last time; none if they are most."""
        kept = np.flatnonzero(self.met[: len(self.rows)] > 1)
        chunks, ids, starts, sizes = list(self.rows), self.ids, self.starts[kept], self.sizes[kept]
        self.clear()
        if len(kept) <= CACHE // 2:
            self.rows.update(zip([chunks[k] for k in kept.tolist()], range(len(kept)), strict=True))
            self._put(np.arange(len(kept)), ids[ragged(starts, sizes)], sizes)

    def _put(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.rows) > len(self.starts):
            self.starts, self.sizes, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.met))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[rows], self.sizes[rows] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def _learn(self) -> None:
        new, self.rows.new = self.rows.new, []
        base = len(self.rows) - len(new)
        found = [self.pieces(c) for c in new]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        alone = np.array([len(f) == 1 and f[0] == c for f, c in zip(found, new, strict=True)], dtype=bool)
        several = np.flatnonzero(~alone)
        parts = np.fromiter(map(self.rows.__getitem__, chain.from_iterable([found[k] for k in several])), np.int64, int(counts[several].sum()))
        more, self.rows.new = self.rows.new, []
        own = np.flatnonzero(alone)
        atoms = [*(new[k] for k in own), *more]
        if atoms:
            self._put(np.concatenate([base + own, len(self.rows) - len(more) + np.arange(len(more))]), *self.encode(atoms))
        ends = np.cumsum(counts[several])
        upto = np.concatenate([[0], np.cumsum(self.sizes[parts])])
        self._put(base + several, self.ids[ragged(self.starts[parts], self.sizes[parts])], upto[ends] - upto[ends - counts[several]])

    def of(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as their chunks, and where each text's ids end."""
        if len(self.rows) > CACHE:
            self._thin()
        counts = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.rows.new:
            self._learn()
        self.met[: len(self.rows)] += np.bincount(rows, minlength=len(self.rows))
        sizes = self.sizes[rows]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[ragged(self.starts[rows], sizes)], upto[np.cumsum(counts)]


def encoded(tokenizer, pieces: list[str]) -> np.ndarray:
    """The ids of pieces without spaces, in a row; ``tokenizer`` splits at spaces."""
    texts = [" ".join(pieces[k : k + TOGETHER]) for k in range(0, len(pieces), TOGETHER)]
    out = [e.ids for k in range(0, len(texts), 512) for e in tokenizer.encode_batch_fast(texts[k : k + 512], add_special_tokens=False)]
    return np.fromiter(chain.from_iterable(out), np.uint32, sum(map(len, out)))
