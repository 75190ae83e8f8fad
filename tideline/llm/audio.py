"""Media columns: chroma fingerprints of audio and alignment of recordings.

A recording is a binary column with a mono 16-bit WAV file of any rate, brought to ``RATE``. Its frames' spectra are folded to twelve
pitch classes; sixteen filters over the chroma image, computed from its integral image, each give two
bits, so a frame is one packed 32-bit integer. Each query is aligned with every recording at every time offset:
an offset is accepted by the share of differing bits over the overlap, and pairs of equal integers (two
prints ``AHEAD`` apart) vote for the best of the accepted offsets.

A bound of the equal bits at all offsets is one correlation of the recordings' bits, turned to the axes that hold most of them;
the bits are counted where the bound allows a match, so no alignment is lost. Recordings that differ cost the same whatever they hold, and
the time grows with the number of queries times that of recordings.
Equal fingerprints are one class and are compared once.

The driver tables have no audio, so ``synthesized`` makes a WAV column from vectors: component k is
the note played in time slot k.

Cases: null media, files that aren't mono 16-bit WAV, and recordings under ``MIN_FRAMES`` frames have empty
fingerprints and match nothing. ``MIN_FRAMES`` frames give ``MIN_FRAMES - WINDOW + 1`` prints: two recordings must share ``MIN_FRAMES``
prints (``MIN_FRAMES + WINDOW - 1`` frames), or all prints of the shorter one if it has fewer. Places where both recordings are silent don't count for the share of differing bits, so silence
matches nothing. Ties between offsets go to fewer errors, then to the smallest. Repeated rows are in one class. An empty table gives an empty result; extra columns aren't carried.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialize

RATE, FRAME, HOP = 4000, 1024, 256
MIN_FRAMES = 20
WINDOW = 16
#: The sixteen filters of the default classifier that the Chromaprint library (own code under the MIT licence) publishes, in its order.
#: (kind, first pitch class, height, width): kinds are the mean, halves above and beside each other, quarters, thirds above and beside each other.
FILTERS = (
    (0, 4, 3, 15), (4, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (4, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4),
    (2, 6, 2, 16), (2, 1, 3, 2), (5, 10, 1, 15), (3, 6, 2, 10), (2, 1, 1, 14), (3, 5, 6, 4), (1, 9, 2, 12), (3, 4, 2, 14),
)
#: Cuts of all filters, in place of that classifier's own, which are fitted to another scale of chroma values: close to the quartiles
#: that the filters of two halves have on the melodies of ``tune`` (measured: -0.14, 0.00 and 0.12).
CUTS = (-0.09, 0.0, 0.09)
MAX_ERRORS = 0.2
#: Shared pairs that a match must have: none, as the bit errors decide.
MIN_VOTES = 0
#: Prints between the two of a pair.
AHEAD = 5
#: Numbers in an array of correlations at most, unless two recordings need more.
CELLS = 1 << 23
#: Prints of overlaps that are judged at once, give or take one overlap.
PLACES = 1 << 20
#: Share of the bits' squares that is correlated as it is; the rest is bounded. More costs more axes, less lets more offsets be counted in vain.
KEPT = 0.8


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    data = np.clip(samples * 32767, -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def unwav(media: bytes | None) -> np.ndarray | None:
    """The samples of a mono 16-bit PCM WAV file, brought to ``RATE``, or None."""
    if not media or media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        return None
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, 20) if len(media) >= 36 else (0,) * 6
    at = media.find(b"data", 36)
    if (kind, channels, bits) != (1, 1, 16) or not rate or at < 0:
        return None
    data = media[at + 8 :]
    return resampled(np.frombuffer(data[: len(data) // 2 * 2], dtype="<i2").astype(np.float32) / 32768, rate)


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    """Samples at ``RATE``, by a windowed sinc that lets pass what both rates can hold."""
    if rate == RATE or not len(samples):
        return samples
    up, down = RATE // math.gcd(RATE, rate), rate // math.gcd(RATE, rate)
    pass_band = 0.98 * min(1, RATE / rate)
    half = math.ceil(32 / pass_band)
    reach = np.arange(-half, half + 1)
    padded = np.pad(samples, half + 1)
    out = np.zeros(-(-len(samples) * up // down), dtype=np.float32)
    for phase in range(min(up, len(out))):
        first, rest = divmod(phase * down, up)
        x = reach - rest / up
        taps = (pass_band * np.sinc(pass_band * x) * np.where(np.abs(x) <= half, np.cos(np.pi * x / (2 * half)) ** 2, 0)).astype(np.float32)
        windows = np.lib.stride_tricks.sliding_window_view(padded[first + 1 :], len(reach))[::down]
        n = len(range(phase, len(out), up))
        for k in range(0, n, 4096):
            out[phase + k * up : phase + min(k + 4096, n) * up : up] = windows[k : min(k + 4096, n)] @ taps
    return out


def tune(vector: np.ndarray, slot: float = 0.25) -> np.ndarray:
    """A melody: component k's size picks the note of slot k, over a drone of its neighbour's."""
    v = np.asarray(vector, dtype=np.float64)
    v = np.where(np.isfinite(v), v, 0)
    notes = np.floor(np.clip(v * 60 + 18, 0, 35)).astype(int)
    n = int(RATE * slot)
    t = np.arange(n) / RATE
    fade = np.minimum(1, np.minimum(np.arange(n), np.arange(n)[::-1]) / 60)
    freq = 130.81 * 2 ** (notes[:, None] / 12)
    low = 65.41 * 2 ** ((np.roll(notes, 1)[:, None] % 12) / 12)
    return ((0.5 * np.sin(2 * np.pi * freq * t) + 0.2 * np.sin(4 * np.pi * freq * t) + 0.2 * np.sin(2 * np.pi * low * t)) * fade).ravel().astype(np.float32)


_BINS = np.fft.rfftfreq(FRAME, 1 / RATE)
_CLASS = np.zeros((len(_BINS), 12), dtype=np.float32)
_HEARD = np.flatnonzero((_BINS >= 60) & (_BINS <= 1900))
_CLASS[_HEARD, np.round(12 * np.log2(_BINS[_HEARD] / 261.63)).astype(int) % 12] = 1
_HANN = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of length one; silent frames are zero."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * _HANN
    folded = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).astype(np.float32) @ _CLASS
    norm = np.linalg.norm(folded, axis=1, keepdims=True)
    return np.where(norm > 1e-3, folded / np.maximum(norm, 1e-3), 0)


def fingerprint(media: bytes | None) -> np.ndarray:
    """A packed 32-bit integer for each window of ``WINDOW`` frames; empty if there is too little."""
    samples = unwav(media)
    image = chroma(samples) if samples is not None else np.zeros((0, 12))
    if len(image) < max(MIN_FRAMES, WINDOW):
        return np.zeros(0, dtype=np.int32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    x = np.arange(len(image) - WINDOW + 1)
    area = lambda x0, y0, x1, y1: total[x1, y1] - total[x0, y1] - total[x1, y0] + total[x0, y0]
    out = np.zeros(len(x), dtype=np.uint32)
    for kind, y, h, w in FILTERS:
        end, top = x + w, y + h
        if kind == 0:
            a, b = area(x, y, end, top), 0
        elif kind == 1:
            a, b = area(x, y + h // 2, end, top), area(x, y, end, y + h // 2)
        elif kind == 2:
            a, b = area(x + w // 2, y, end, top), area(x, y, x + w // 2, top)
        elif kind == 3:
            a = area(x, y + h // 2, x + w // 2, top) + area(x + w // 2, y, end, y + h // 2)
            b = area(x, y, x + w // 2, y + h // 2) + area(x + w // 2, y + h // 2, end, top)
        elif kind == 4:
            a, b = area(x, y + h // 3, end, top - h // 3), area(x, y, end, y + h // 3) + area(x, top - h // 3, end, top)
        else:
            a, b = area(x + w // 3, y, end - w // 3, top), area(x, y, x + w // 3, top) + area(end - w // 3, y, end, top)
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        level = sum((value > c).astype(np.uint32) for c in CUTS)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    silent = area(x, 0, x + WINDOW, 12) <= 1e-6
    out[silent] = 0
    return out.view(np.int32)


def _mapped(df: DataFrame, column: str, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.iloc[first : first + 256]
                yield pd.DataFrame({"id": part["id"], schema.split(", ")[1].split()[0]: [make(v) for v in part[column]]})

    return df.mapInPandas(run, schema)


def _played(vector: np.ndarray | None) -> bytes | None:
    return None if vector is None or not len(vector) else wav(tune(vector))


def synthesized(vectors: DataFrame) -> DataFrame:
    """id and a media column from id and vector."""
    return _mapped(vectors.select("id", "vector"), "vector", _played, "id long, media binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """id and fingerprint of id and media."""
    return _mapped(media.select("id", "media"), "media", fingerprint, "id long, prints array<int>")


def played_fingerprints(vectors: DataFrame) -> DataFrame:
    """``fingerprints(synthesized(vectors))`` in one map: each recording is made and read in turn, so no batch of recordings is held."""
    return _mapped(vectors.select("id", "vector"), "vector", lambda v: fingerprint(_played(v)), "id long, prints array<int>")


def _axes(prints: list[np.ndarray]) -> np.ndarray:
    """Orthonormal axes, as columns, of the 32 bits as plus and minus one: the fewest that hold ``KEPT`` of the prints' squares."""
    signs = _signs(np.concatenate(prints)[:: max(1, sum(map(len, prints)) >> 16)]).astype(np.float64)
    held, axes = np.linalg.eigh(signs.T @ signs)
    few = int(np.searchsorted(np.cumsum(held[::-1]), KEPT * held.sum())) + 1
    return np.ascontiguousarray(axes[:, ::-1][:, :few], dtype=np.float32)


def _signs(prints: np.ndarray) -> np.ndarray:
    """The 32 bits of each print as plus and minus one."""
    return 1 - 2 * np.unpackbits(prints.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").astype(np.float32)


def _channels(prints: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Each print along the axes, and the length of what they leave out.

    Two prints' product is at least the product of their signs, as lengths bound what is left out; a little more, for rounding.
    """
    along = _signs(prints) @ axes
    return np.hstack([along, np.sqrt(np.maximum(32 - (along * along).sum(1, keepdims=True), 0) + 1e-3)])


def _spectra(prints: list[np.ndarray], axes: np.ndarray, size: int, paired: bool) -> np.ndarray:
    """Fourier transforms of the channels, as frequency, channel, recording; ``paired``: two recordings as the real and the imaginary part of one."""
    values = _channels(np.concatenate(prints), axes)
    padded = np.zeros((len(prints) + len(prints) % 2 * paired, values.shape[1], size), dtype=np.float32)
    end = 0
    for k, p in enumerate(prints):
        padded[k, :, : len(p)] = values[end : end + len(p)].T
        end += len(p)
    return np.ascontiguousarray(np.fft.fft(padded[0::2] + np.complex64(1j) * padded[1::2] if paired else padded, axis=2).astype(np.complex64, copy=False).transpose(2, 1, 0))


def _fast_size(n: int) -> int:
    """The least 2**a, 5 * 2**a or 7 * 2**a that is n or more."""
    return min(f << max(0, (-(-n // f) - 1).bit_length()) for f in (1, 5, 7))


def _candidates(x: list[np.ndarray], y: list[np.ndarray], max_errors: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes in x and y and offsets of all overlaps of enough prints with few enough differing bits, and of a few others.

    A bound of the equal bits at every offset comes from one correlation of both recordings' channels; its rounding is
    allowed for, so that nothing is lost, and the caller counts the bits.
    """
    ends = [np.array([len(p) for p in side]) for side in (x, y)]
    # the correlation is circular: offsets that meet there have overlaps of the fewest prints together, so too few each
    fewest = min(MIN_FRAMES, int(ends[0].min()), int(ends[1].min()))
    size = _fast_size(int(ends[0].max() + ends[1].max()) - fewest)
    offset = np.arange(size)
    offset[offset > ends[1].max() - fewest] -= size
    axes = _axes(x + y)
    own = max(1, min(60, CELLS // (32 * size)))
    other = max(2, min(60, CELLS // (own * size)) // 2 * 2)
    theirs = max(1, 2 * CELLS // (32 * size) // other) * other
    for k in range(0, len(y), theirs):
        there = [_spectra(y[j : j + other], axes, size, True) for j in range(k, min(k + theirs, len(y)), other)]
        for i in range(0, len(x), own):
            here = np.ascontiguousarray(_spectra(x[i : i + own], axes, size, False).conj().transpose(0, 2, 1))
            for j, block in zip(range(k, len(y), other), there):
                # recordings before offsets, as transforms are faster over numbers that lie together
                agree = np.fft.ifft(np.ascontiguousarray((here @ block).transpose(1, 2, 0)), axis=2).view(np.float32)
                n, m = ends[0][i : i + own], ends[1][j : j + other]
                pairs = np.append(m, m[-1:]) if len(m) % 2 else m
                n, pairs = n[:1] if (n == n[0]).all() else n, pairs[:2] if (pairs == pairs[0]).all() else pairs
                n, pairs = n[:, None, None, None], pairs.reshape(-1, 1, 2)
                shared = np.minimum(np.minimum(n, pairs - offset[:, None]), np.minimum(n + offset[:, None], pairs))
                least = np.where(shared >= np.minimum(MIN_FRAMES, np.minimum(n, pairs)), (1 - 2 * max_errors) * 32 * shared - 2, np.inf).astype(np.float32)
                enough = agree >= least.reshape(*least.shape[:2], -1)
                q, r = np.nonzero(enough.any(axis=2))
                at, d = np.nonzero(enough[q, r])
                q, r, d = q[at], 2 * r[at] + d % 2, offset[d // 2]
                real = r < len(m)
                yield i + q[real], j + r[real], d[real]


def _judged(x: np.ndarray, y: np.ndarray, starts: tuple[np.ndarray, np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differing bits, places where either sounds and votes of overlaps of n prints each that start at these places of x and y."""
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(first, n)
    a, b = (side[np.repeat(start, n) + at] for side, start in zip((x, y), starts))
    same = (a == b) & (b != 0)
    vote = same & (at >= AHEAD)
    vote[AHEAD:] &= same[:-AHEAD]
    return tuple(np.add.reduceat(v, first, dtype=np.int64) for v in (np.bitwise_count((a ^ b).view(np.uint32)), (a | b) != 0, vote))


def aligned(x: list[np.ndarray], y: list[np.ndarray], max_errors: float = MAX_ERRORS, min_votes: int = MIN_VOTES) -> list[tuple[int, int, int, int, float]]:
    """Index in x, index in y, offset, votes and share of differing bits of every pair that aligns, at its best offset."""
    best: dict[tuple[int, int], tuple] = {}
    classes: list[dict[int, list[int]]] = [{}, {}]  # by length, so that a long recording doesn't pad the short ones
    for side, found in zip((x, y), classes):
        for k, p in enumerate(side):
            if len(p):
                found.setdefault(len(p).bit_length(), []).append(k)
    for mine in classes[0].values():
        for theirs in classes[1].values():
            own, other = [x[k] for k in mine], [y[k] for k in theirs]
            flat = [np.concatenate(side) for side in (own, other)]
            ends = [np.array([len(p) for p in side]) for side in (own, other)]
            starts = [np.cumsum(e) - e for e in ends]
            for all_q, all_r, all_d in _candidates(own, other, max_errors):
                first, at = np.maximum(0, -all_d), np.maximum(0, all_d)
                n = np.minimum(ends[0][all_q] - first, ends[1][all_r] - at)
                for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PLACES)) + 1) if len(n) else ():
                    q, r, d = all_q[part], all_r[part], all_d[part]
                    wrong, sounding, votes = _judged(*flat, (starts[0][q] + first[part], starts[1][r] + at[part]), n[part])
                    good = (sounding > 0) & (wrong <= max_errors * 32 * sounding) & (votes >= min_votes)
                    for a, b, offset, bits, places, pairs in zip(*(v[good].tolist() for v in (q, r, d, wrong, sounding, votes))):
                        rank = (pairs, -bits / (32 * places), -abs(offset), offset)
                        key = mine[a], theirs[b]
                        best[key] = max(rank, best.get(key, rank))
    return [(k, other, rank[3], rank[0], -rank[1]) for (k, other), rank in best.items()]


def _packed(kinds: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of about ``size`` classes each; as a table, so that a join knows its size and sends the smaller one around."""
    packs = -(-kinds.count() // size) or 1
    rows = kinds.groupBy(F.pmod("key", F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("key", "prints")).alias(name))
    return materialize(rows.select(name), name).repartition(packs)


def _unpacked(column: pa.ListArray, row: int) -> tuple[np.ndarray, list[np.ndarray]]:
    items = column[row].values
    prints = items.field("prints")
    ends, values = prints.offsets.to_numpy(), prints.values.to_numpy()
    return items.field("key").to_numpy(), [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def matches(prints: DataFrame, queries: DataFrame, max_errors: float = MAX_ERRORS, min_votes: int = MIN_VOTES) -> DataFrame:
    """query_id, match_id, copies, offset, votes and bit_errors: for each query every class of equal fingerprints that aligns with it.

    match_id is the class's smallest id; ``copies`` counts its rows. A query's own class is among them.
    """
    keyed = materialize(prints.where(F.size("prints") > 0).withColumn("key", F.xxhash64("prints")), "prints")
    kinds = keyed.groupBy("key").agg(F.min("id").alias("match_id"), F.count("*").alias("copies"), F.first("prints").alias("prints"))
    kinds = materialize(kinds, "kinds")
    asked = materialize(keyed.select("id", "key").join(queries.select("id").distinct(), "id"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, x = _unpacked(batch.column("own"), row)
                other, y = _unpacked(batch.column("other"), row)
                found = aligned(x, y, max_errors, min_votes)
                q, r, offset, votes, errors = (list(c) for c in zip(*found)) if found else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[q] if q else [], pa.int64()), pa.array(other[r] if r else [], pa.int64()), pa.array(offset, pa.int64()), pa.array(votes, pa.int64()), pa.array(errors, pa.float64())],
                    names=["q", "key", "offset", "votes", "bit_errors"],
                )

    own = _packed(kinds.join(asked.select("key").distinct(), "key").select("key", "prints"), 2048, "own")
    good = _packed(kinds.select("key", "prints"), 1024, "other").crossJoin(own).mapInArrow(run, "q long, key long, offset long, votes long, bit_errors double")
    named = materialize(good, "aligned").join(kinds.select("key", "match_id", "copies"), "key")
    return asked.withColumnRenamed("key", "q").join(named, "q").select(F.col("id").alias("query_id"), "match_id", "copies", "offset", "votes", "bit_errors")
