"""Repeated byte strings by a sparse suffix array over sampled splitters.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else. Sorting every
suffix would move hundreds of bytes for each byte of text, so only suffixes at content-defined
anchors are sorted, which loses nothing:

1. Every string of ``width`` bytes has one anchor: the leftmost smallest of its own 64-byte
   fingerprints. Equal strings have the same anchor at the same offset. The strings that share an
   anchor are a run of starts, a block.
2. A sieve: fingerprints of the anchors' leading 64 bytes and of their blocks are range-partitioned by
   sampled splitters and sorted. A block that has an equal neighbour repeats as a whole; one whose
   leading bytes nobody shares cannot repeat. Leading bytes that fill several ranges are dealt over them by
   their blocks, and neighbours across those boundaries count as sharing. Nine tenths of the blocks end here.
3. The suffixes of the others (edges of repeated passages, and one example of each block that repeats)
   are sorted as bytes: range-partitioned by their leading bytes, then in each bucket by multikey quicksort,
   and what goes before the anchor likewise, read backwards. Two blocks have the string in common that starts
   d bytes before the anchor if the neighbours between them in the one order share ``width`` - d bytes,
   and in the other d. So all strings of a bucket are decided by comparing neighbours.

Splitters fall between different leading bytes, so no two suffixes that share them lie on two sides of a boundary. Where
more than ``LIMIT`` blocks share leading bytes (a common line with ever differing neighbours), the strings are
divided by d into halves, each of which has more leading bytes in common, until few share them or one string is left.

Blocks that repeat inside a map batch are combined before the shuffle, so a passage that a third of
all documents share reaches a bucket once a batch; copies of a text are one text before its bytes move.
Fingerprints have 64 bits for anchors and 128 for blocks (with their anchor's).

Cases: a null text counts as empty; texts under ``width`` bytes keep all bytes. Repeated rows repeat
every string they have. Matches never cross documents. An empty table gives an empty result. Extra
columns aren't carried by ``spans``; ``remove`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import BYTES, by_size, discard, fresh, materialize, shuffle_partitions, splitmix, text_key, with_text

WIDTH = 200
GRAM = 64
#: Blocks with the same leading bytes that one task sorts together.
LIMIT = 2000
#: Characters that are fingerprinted at once: a slice takes about 150 bytes of memory for each.
SLICE = 1 << 18
_MULTIPLIERS = splitmix(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


def _join(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    out = left * _MULTIPLIERS[k]
    out += right
    out ^= out >> np.uint64(29)
    return out


class Fingerprints:
    """Fingerprints of the 64-byte strings of some data, and by them those of longer ones."""

    def __init__(self, data: np.ndarray) -> None:
        h, size, k = BYTES[data], 1, 0
        while size < GRAM:
            h = _join(h[:-size], h[size:], k) if len(h) > size else h[:0]
            size, k = 2 * size, k + 1
        self.grams = h

    def at(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of the strings of ``width`` >= 64 bytes at ``starts``."""
        h = self.grams[starts]
        g = h * _MULTIPLIERS[12]
        for begin in [*range(GRAM, width - GRAM, GRAM), width - GRAM]:
            part = self.grams[starts + begin]
            h, g = _join(h, part, 10), _join(g, splitmix(part), 11)
        return splitmix(h), splitmix(g)


def _smallest(keys: np.ndarray, window: int) -> np.ndarray:
    """The smallest of each ``window`` neighbours."""
    size = 1
    while size * 2 <= window:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (window - size)], keys[window - size :]) if window > size else keys


def blocks(texts: list[bytes], width: int = WIDTH) -> dict[str, np.ndarray]:
    """Each block of each text: text index, first start, number of further starts, the anchor's place after the first start, fingerprints."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    empty = np.zeros(0, dtype=np.int64)
    if not len(data) or lengths.max() < width:
        return {"text": empty, "start": empty, "more": empty, "turn": empty, "lead": empty, "block": empty}
    prints = Fingerprints(data)
    key = (prints.grams & ~_LOW) | np.arange(len(prints.grams), dtype=np.uint64)
    anchor = (_smallest(key, width - GRAM + 1) & _LOW).astype(np.int64)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    long = lengths >= width
    np.add.at(inside, (ends - lengths)[long], 1)
    np.add.at(inside, ends[long] - width + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    anchors = anchor[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchors) != 0) | (np.diff(starts) != 1)]))
    first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    at = anchors[new]
    text = np.searchsorted(ends, first, side="right")
    lead = data[at].astype(np.uint64) << np.uint64(56) | data[at + 1].astype(np.uint64) << np.uint64(48) | splitmix(prints.grams[at]) >> np.uint64(16)
    (h, _), (_, g) = prints.at(first, width), prints.at(last, width)
    block = splitmix(h * _MULTIPLIERS[13] + g * _MULTIPLIERS[14] + (last - first).astype(np.uint64) * np.uint64(1009) + (at - first).astype(np.uint64))
    return {"text": text, "start": first - (ends - lengths)[text], "more": last - first, "turn": at - first, "lead": lead.view(np.int64), "block": block.view(np.int64)}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


BLOCK = "bucket int, lead long, block long, k1 long, k2 long, start int, more int, turn int, many boolean, known boolean"
_COLUMNS = [c.split()[0] for c in BLOCK.split(", ")]


def _anchors(documents: DataFrame, width: int, splitters: np.ndarray) -> DataFrame:
    """Blocks for comparison with their buckets, and spans that the map batch itself knows to repeat (``known``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            texts = batch["text"].tolist()
            for first, last in by_size(texts, SLICE):
                encoded = [t.encode("utf-8", "surrogatepass") for t in texts[first:last]]
                found = _long_blocks(encoded[0], width, SLICE) if last - first == 1 and len(encoded[0]) > 2 * SLICE else blocks(encoded, width)
                x = pd.DataFrame(found)
                x["many"] = x.duplicated(["lead", "block"], keep=False)
                text = x["text"].to_numpy() + first
                x["k1"], x["k2"], x["known"] = k1[text], k2[text], False
                again = x[x["many"]]
                rows = [x.drop_duplicates(["lead", "block"])]
                if len(again):
                    spans = again[["k1", "k2", "start", "more"]].drop_duplicates().sort_values(["k1", "k2", "start"])
                    end = spans["start"] + spans["more"] + width
                    same = (spans["k1"] == spans["k1"].shift()) & (spans["k2"] == spans["k2"].shift())
                    run_no = (~(same & (spans["start"] <= end.shift()))).cumsum()
                    spans = spans.assign(end=end).groupby(run_no).agg(k1=("k1", "first"), k2=("k2", "first"), start=("start", "min"), end=("end", "max"))
                    spans["more"] = spans["end"] - spans["start"] - width
                    rows.append(spans.assign(lead=spans["k1"], block=0, turn=0, many=True, known=True))
                for r in rows:
                    yield r.assign(bucket=_bucket(splitters, r["lead"].to_numpy(), r["block"].to_numpy()))[_COLUMNS]

    texts = documents.where(F.octet_length("text") >= width).select(*text_key(F.col("text")), "text")
    return texts.mapInPandas(run, BLOCK)


def _bucket(splitters: np.ndarray, lead: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The range of each row; a lead that is a splitter several times is dealt over its ranges in the order of the blocks."""
    first, last = np.searchsorted(splitters, lead, side="left"), np.searchsorted(splitters, lead, side="right")
    several = last - first > 1
    share = (block.astype(np.float64) + 2.0**63) * 2.0**-64
    return np.where(several, np.minimum(first + 1 + (share * (last - first)).astype(np.int64), last), last).astype(np.int32)


def splitters(documents: DataFrame, width: int, buckets: int, one_in: int = 64) -> np.ndarray:
    """Leading tokens that part the suffixes into even ranges, from a sample of the texts; as many as buckets, so they may come to the driver. A hot one is there several times."""
    picked = documents.where(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(one_in)) == 0)
    shares = [i / buckets for i in range(1, buckets)]
    found = _anchors(picked, width, np.zeros(0, dtype=np.int64)).where("not known").agg(F.expr(f"approx_percentile(lead, array({','.join(map(repr, shares))}), 1000)") if shares else F.lit(None)).first()[0]
    return np.sort(np.array(found or [], dtype=np.int64))


def _long_blocks(text: bytes, width: int, step: int = 1 << 22) -> dict[str, np.ndarray]:
    """A long text in parts that overlap by a string less a byte; a block that a cut divides gives two blocks that both are whole."""
    parts = []
    for begin in range(0, len(text) - width + 1, step):
        x = blocks([text[begin : begin + step + width - 1]], width)
        x["start"] = x["start"] + begin
        parts.append(x)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


WHOLE, EDGE, EXAMPLE = 1, 2, 3


def compare(batches: Iterator[pd.DataFrame], hot: np.ndarray) -> Iterator[pd.DataFrame]:
    """A bucket's blocks, sorted by (lead, block), against their neighbours.

    WHOLE: has an equal block. EDGE: alone, but shares its leading tokens. EXAMPLE: one of each
    group of equal blocks whose leading tokens other blocks share. At most two rows wait for the next
    batch. ``hot`` are the leads that lie in several buckets; they count as shared.
    """
    carry = None
    for batch in batches:
        known = batch["known"].to_numpy(dtype=bool)
        if known.any():
            yield batch.loc[known, ["k1", "k2", "start", "more", "turn"]].assign(kind=WHOLE)
        x = batch[~known].drop(columns=["bucket", "known"]).assign(done=False, shown=False)
        x = x if carry is None else pd.concat([carry, x], ignore_index=True)
        carry, out = _compare(x, hot, final=False)
        yield out
    if carry is not None:
        yield _compare(carry, hot, final=True)[1]


def _compare(x: pd.DataFrame, hot: np.ndarray, final: bool) -> tuple[pd.DataFrame | None, pd.DataFrame]:
    lead, block = x["lead"].to_numpy(), x["block"].to_numpy()
    n = len(x)
    head = np.flatnonzero(np.concatenate([[True], (np.diff(lead) != 0) | (np.diff(block) != 0)])) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(head, n))
    run = np.repeat(np.arange(len(head)), sizes)
    many = (sizes >= 2) | (np.add.reduceat(x["many"].to_numpy(dtype=np.int64), head) > 0 if n else False)
    same = lead[head][1:] == lead[head][:-1]
    shares = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | np.isin(lead[head], hot) if n else np.zeros(0, dtype=bool)
    done, shown = x["done"].to_numpy(dtype=bool), x["shown"].to_numpy(dtype=bool)
    kind = np.where(done, 0, np.where(many[run], WHOLE, np.where(shares[run], EDGE, 0)))
    example = many & shares & ~shown[head]
    carry = None
    if n and not final:
        last = len(head) - 1
        keep = [head[last]]
        if many[last]:
            row = x.iloc[keep].assign(done=True, many=True, shown=bool(shares[last]) or bool(shown[head[last]]))
            carry = row
        else:
            kind[head[last]] = 0
            row = x.iloc[keep]
            if last and same[-1]:
                before = x.iloc[[head[last - 1]]].assign(done=True, many=bool(many[last - 1]), shown=True)
                row = pd.concat([before, row], ignore_index=True)
            carry = row
    locate = ["k1", "k2", "start", "more", "turn"]
    own = x.loc[kind > 0, locate].assign(kind=kind[kind > 0])
    shown_rows = x.iloc[head[example]][locate].assign(kind=EXAMPLE)
    return carry, pd.concat([own, shown_rows])


_EDGES = "k1 long, k2 long, start int, more int, turn int, example boolean, bytes binary"


def _taken(edges: DataFrame, width: int) -> DataFrame:
    """The bytes of the blocks in ``edges`` (texts and places in them)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for k1, k2, text, places in zip(batch["k1"].tolist(), batch["k2"].tolist(), batch["text"], batch["places"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(k1, k2, p["start"], p["more"], p["turn"], p["kind"] == EXAMPLE, data[p["start"] : p["start"] + p["more"] + width]) for p in places]
                if len(rows) > 10_000:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _EDGES.split(", ")])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _EDGES.split(", ")])

    return edges.select("k1", "k2", "text", "places").mapInPandas(run, _EDGES)


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words, and how many bytes each row in that order shares with the one before.

    Multikey quicksort, all partitions of a level at once: rows that agree so far are parted by their next
    word of eight bytes, and those that are alone then are done.
    """
    n, k = words.shape
    order, group, shared = np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, 8 * k, dtype=np.int64)
    shared[:1] = 0
    open_ = np.arange(n) if n > 1 else np.zeros(0, dtype=np.int64)
    for level in range(k):
        if not len(open_):
            break
        rows, own = order[open_], group[open_]
        key = words[rows, level]
        by = np.lexsort((key, own))
        rows, key = rows[by], key[by]
        order[open_] = rows
        same = own[1:] == own[:-1]
        differ = key[1:] ^ key[:-1]
        parts = np.flatnonzero(same & (differ != 0))
        byte = (differ[parts, None] >> np.arange(56, -1, -8, dtype=np.uint64) & np.uint64(255) != 0).argmax(1)
        shared[open_[parts + 1]] = 8 * level + byte
        new = np.concatenate([[True], ~same | (differ != 0)])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
    return order, shared


def _words(data: np.ndarray, first: np.ndarray, n: np.ndarray, step: int, width: int) -> np.ndarray:
    """Words of the ``n`` bytes from ``first`` on, forwards or backwards, padded to ``width`` bytes with zeros."""
    width = -(-width // 8) * 8
    column = np.arange(width)
    inside = column < n[:, None]
    out = np.where(inside, data[np.where(inside, first[:, None] + step * column, 0)], 0).astype(np.uint8)
    return out.view(">u8").astype(np.uint64)


def found_twice(data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, span: int, width: int) -> np.ndarray:
    """For each block (``begin`` to ``end`` in ``data``, a core of ``width`` - ``span`` bytes from ``at``) which strings two blocks have.

    String d, of those from ``low`` to ``high``, starts d bytes before ``at``. Blocks with different cores share none.
    """
    n = len(at)
    right, after = multikey(_words(data, at, np.minimum(end - at, width), 1, width))
    right = np.argsort(right)
    core = np.cumsum(after < width - span)[right]
    before_words = _words(data, at - 1, np.minimum(at - begin, span), -1, span) if span else np.zeros((n, 0), dtype=np.uint64)
    left, before = multikey(np.concatenate([core[:, None].astype(np.uint64), before_words], axis=1))
    left = np.argsort(left)
    before -= 8  # blocks with different cores come out below zero
    twice = np.zeros((n, span + 1), dtype=bool)
    for d in range(span + 1):
        own = np.flatnonzero((low <= d) & (d <= high))
        if len(own) < 2:
            continue
        key = np.cumsum(before < d)[left[own]] * np.int64(n + 1) + np.cumsum(after < width - d)[right[own]]
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        twice[own[order], d] = np.append(same, False) | np.insert(same, 0, False)
    return twice


def _units(edges: DataFrame, ranges: Column, width: int) -> DataFrame:
    """Blocks with the ranges of d that they are to be compared for, and the leading bytes that all strings of the range have in common."""
    units = edges.withColumn("range", F.explode(ranges)).select(*(c.split()[0] for c in _EDGES.split(", ")), F.col("range.lo").alias("lo"), F.col("range.hi").alias("hi"))
    return units.where("lo <= hi and turn >= lo and turn - more <= hi").withColumn("head", F.expr(f"substring(bytes, turn - lo + 1, {width} - hi + lo)"))


def _sorted_out(units: DataFrame, width: int) -> DataFrame:
    """k1, k2, start and end of the strings of edges that are found twice; a bucket is sorted in slices between different leading bytes."""

    def decided(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for (lo, hi), own in x.groupby(["lo", "hi"], sort=False):
            n = own["bytes"].map(len).to_numpy(dtype=np.int64)
            end = np.cumsum(n)
            begin = end - n
            turn, more = own["turn"].to_numpy(dtype=np.int64), own["more"].to_numpy(dtype=np.int64)
            data = np.frombuffer(b"".join(own["bytes"]), dtype=np.uint8)
            low, high = np.maximum(turn - more - lo, 0), np.minimum(turn, hi) - lo
            twice = found_twice(data, begin, end, begin + turn - lo, low, high, int(hi - lo), width)
            twice[own["example"].to_numpy(dtype=bool)] = False
            # runs of neighbouring strings, the last first
            edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (row, first), (_, past) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            anchor = (own["start"].to_numpy(dtype=np.int64) + turn - lo)[row]
            yield pd.DataFrame({"k1": own["k1"].to_numpy()[row], "k2": own["k2"].to_numpy()[row], "start": (anchor - past + 1).astype(np.int32), "end": (anchor - first + width).astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            for first in range(0, len(batch), LIMIT):
                part = batch.iloc[first : first + LIMIT]
                heads = part["head"]
                cut = int((heads != heads.iloc[-1]).to_numpy().nonzero()[0][-1]) + 1 if heads.iloc[0] != heads.iloc[-1] else 0
                if not cut and waiting and waiting[-1]["head"].iloc[-1] != heads.iloc[0]:
                    yield from decided(pd.concat(waiting))
                    waiting = []
                if cut:
                    yield from decided(pd.concat([*waiting, part.iloc[:cut]]))
                    waiting = []
                waiting.append(part.iloc[cut:])
        if waiting:
            yield from decided(pd.concat(waiting))

    n = shuffle_partitions(units.sparkSession)
    return units.repartitionByRange(n, "head").sortWithinPartitions("head").mapInPandas(run, "k1 long, k2 long, start int, end int")


def _edges_found(taken: DataFrame, width: int) -> DataFrame:
    """k1, k2, start, end of all strings of edges that are found twice."""
    units, out = _units(taken, F.expr(f"array(struct(0 as lo, {width - GRAM} as hi))"), width), None
    while True:
        hot = materialize(units.groupBy("head", "lo", "hi").agg(F.count("*").alias("c")).where(F.col("c") > LIMIT).select("head", "lo", "hi"), "hot")
        if hot.isEmpty():
            found = _sorted_out(units, width)
            return found if out is None else out.unionByName(found)
        key = ["head", "lo", "hi"]
        found = _sorted_out(units.join(hot, key, "left_anti").select(*units.columns), width)
        many = units.join(hot, key, "left_semi").select(*units.columns)
        # a single string that many share is found twice by that
        found = found.unionByName(many.where("lo = hi and not example").select("k1", "k2", F.expr("start + turn - lo").alias("start"), F.expr(f"start + turn - lo + {width}").alias("end")))
        out = found if out is None else out.unionByName(found)
        halves = F.expr("array(struct(lo as lo, cast((lo + hi) div 2 as int) as hi), struct(cast((lo + hi) div 2 as int) + 1 as lo, hi as hi))")
        units = materialize(_units(many.where("lo < hi"), halves, width), "units", "zstd")


def repeated(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """k1, k2 and spans (arrays of start, end in bytes) of the texts in which something repeats."""
    n = shuffle_partitions(documents.sparkSession)
    bounds = splitters(documents, width, n)
    values, times = np.unique(bounds, return_counts=True)
    hot = values[times > 1]
    suffixes = _anchors(documents, width, bounds).repartitionById(n, "bucket").sortWithinPartitions("lead", "block")
    judged = materialize(suffixes.mapInPandas(lambda batches: compare(batches, hot), "k1 long, k2 long, start int, more int, turn int, kind int"), "suffixes")
    places = judged.where(f"kind in ({EDGE}, {EXAMPLE})").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "more", "turn", "kind")).alias("places"))
    texts = documents.where(F.octet_length("text") >= width).select(*text_key(F.col("text")), "text").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    # neighbouring blocks overlap by a string less a byte, which zstd packs well
    taken = materialize(_taken(texts.join(places, ["k1", "k2"]), width), "blocks", "zstd")
    every = judged.where(f"kind = {WHOLE}").select("k1", "k2", "start", (F.col("start") + F.col("more") + width).alias("end")).unionByName(_edges_found(taken, width))
    found = materialize(every.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    discard(judged, taken)
    return found


def _cut(text: str | None, spans: list | None) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    data = (text or "").encode("utf-8", "surrogatepass")
    runs = merged([(s["start"], s["end"]) for s in spans]) if spans is not None else []
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return data, b"".join([*kept, data[at:]]), runs


def _with_spans(documents: DataFrame, width: int) -> tuple[DataFrame, str]:
    """The documents with a column of their spans, and its name."""
    k1, k2, s1, s2, spans_ = fresh(documents, "k1", "k2", "s1", "s2", "spans")
    found = repeated(documents.select("text"), width).select(F.col("k1").alias(s1), F.col("k2").alias(s2), F.col("spans").alias(spans_))
    keyed = documents.select("*", *(k.alias(n) for k, n in zip(text_key(F.col("text")), (k1, k2), strict=True)))
    return keyed.join(found, (F.col(k1) == F.col(s1)) & (F.col(k2) == F.col(s2)), "left"), spans_


def spans(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, found in zip(batch["text"], batch["spans"], strict=True):
                data, kept, runs = _cut(text, found)
                rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    joined, found = _with_spans(documents.select("doc_id", "text"), width)
    return joined.select("doc_id", "text", F.col(found).alias("spans")).mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without the bytes that repeat. A character of which only some bytes repeat stays whole. n_chars, if there, is counted again."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, found, strict=True):
            if s is None:
                out.append(t)
                continue
            data, _, runs = _cut(t, s)
            kept, at = [], 0
            for a, b in runs:
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                kept.append(data[at:a])
                at = b
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    joined, found = _with_spans(documents, width)
    return with_text(joined, cut("text", found), documents.columns)
