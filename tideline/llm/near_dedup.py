"""Near-duplicate classes by BagMinHash signatures, bands and verified multiset overlap.

A document is the multiset of its five-word shingles (fewer words: one shingle of all of them). A
shingle's count is a weight whose discrete levels are covered by octaves [0,1), [1,2), [2,4), ... For
each octave a Poisson process of points (time, register, level) is drawn from the shingle's hash; a
register keeps the earliest point at a level below the count. Two documents then agree in a register
with the probability of their weighted Jaccard similarity. All points of a document that come later
than its latest register are never drawn, so a signature costs about one point a shingle.

Registers form bands; texts that agree in a band are candidates, and a pair is linked if its exact
multiset overlap is ``similarity`` or more. Classes are the components of the links. Inside a band's
bucket no pairs are listed: every text is compared with one hub of its bucket (in further ``rounds``, if asked for, with
other hubs); texts that are in the hub's component by then need no further proof. Links of a
round join components, not texts. For texts whose buckets still hold several components, links
across components are searched by prefixes: with the cells that only one component has put first and the
others in order of their frequency, two texts of n and m cells can reach the similarity only if they
share a cell within the first n - a + 1 and m - a + 1, where a is the overlap that the pair needs. So
only cells that tell components apart meet, pairs inside a component never do, and no link between
texts of different classes is lost. Where such cells would give more pairs than they have texts, the
texts first meet one hub a cell, then two, four, ..., which joins what is linked many times over; the pairs that
are left then are still listed in full.

Equal texts are one node, so copies cost one row each. Node ids are 64-bit hashes of texts.

Cases: null, empty and blank texts have no shingles; each such row is a class of its own. Repeated
rows are in one class. An empty table gives an empty result. Extra columns aren't carried by
``classes``; ``keep_one`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import by_size, discard, fresh, materialize, quoted, splitmix, word_hashes
from tideline.llm.components import components

WORDS = 5
SIMILARITY = 0.8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = splitmix(np.arange(501, 520, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Bands:
    """At similarity 0.8 a pair shares no band with a probability of (1 - 0.8**rows)**bands, here 1e-5."""

    bands: int = 16
    rows: int = 3


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, count), sorted by text and shingle."""
    w, text = word_hashes(texts)
    if not len(w):
        return text, w, text
    n = np.bincount(text, minlength=len(texts))
    total = np.zeros(max(len(w) - words + 1, 0), dtype=np.uint64)
    for j in range(words):
        total += w[j : len(w) - words + 1 + j] * _WEIGHTS[j]
    whole = text[: len(total)] == text[len(w) - len(total) :]
    value, owner = splitmix(total[whole]), text[: len(total)][whole]
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        first = np.cumsum(n) - n
        short = np.array([splitmix(np.sum(w[first[t] : first[t] + n[t]] * _WEIGHTS[: n[t]], keepdims=True) + np.uint64(n[t]))[0] for t in few], dtype=np.uint64)
        value, owner = np.concatenate([value, short]), np.concatenate([owner, few])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(value) != 0) | (np.diff(owner) != 0)]))
    return owner[head], value[head], np.diff(np.append(head, len(value)))


def signatures(n_texts: int, text: np.ndarray, shingle: np.ndarray, count: np.ndarray, registers: int) -> np.ndarray:
    """BagMinHash registers (identities of the winning points) of each text; texts without shingles have zeros."""
    best = np.full(n_texts * registers, np.inf)
    winner = np.zeros(n_texts * registers, dtype=np.uint64)
    parts, low, size, octave = [], 0, 1, 0
    while (own := count > low).any():
        seed = splitmix(shingle[own] + np.uint64((octave + 1) * int(_STEP) % 2**64))
        parts.append((text[own], seed, count[own].astype(np.float64), np.full(int(own.sum()), float(low)), np.full(int(own.sum()), float(size))))
        low, size, octave = low + size, max(1, low + size), octave + 1
    t, seed, limit, low_of, size_of = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
    time, k = np.zeros(len(t)), 0
    while len(t):
        k += 1
        point = splitmix(seed + np.uint64(2 * k * int(_STEP) % 2**64))
        time = time - np.log1p(-((point >> np.uint64(11)) * 2.0**-53)) / (registers * size_of)
        open_ = time < best.reshape(n_texts, registers).max(axis=1)[t]
        t, seed, limit, low_of, size_of, time, point = (x[open_] for x in (t, seed, limit, low_of, size_of, time, point))
        other = splitmix(point + _STEP)
        level = low_of + np.floor((other >> np.uint64(32)) * 2.0**-32 * size_of)
        hit = level < limit
        at = t[hit] * registers + ((other[hit] & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, at, time[hit])
        won = best[at] == time[hit]
        winner[at[won]] = point[hit][won]
    return winner.reshape(n_texts, registers)


def _bands(winners: np.ndarray, shape: Bands) -> np.ndarray:
    x = winners.reshape(len(winners), shape.bands, shape.rows)
    out = np.arange(1, shape.bands + 1, dtype=np.uint64)[None, :] * _STEP
    for r in range(shape.rows):
        out = splitmix(out + x[:, :, r] * _WEIGHTS[10 + r])
    return out


def has_words() -> Column:
    return F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def signed(documents: DataFrame, shape: Bands, words: int = WORDS) -> DataFrame:
    """id, n_shingles and band hashes of each distinct text that has words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("id")
            texts, ids = batch["text"].tolist(), batch["id"].to_numpy()
            for first, last in by_size(texts):
                text, shingle, count = shingles(texts[first:last], words)
                found = _bands(signatures(last - first, text, shingle, count, shape.bands * shape.rows), shape).view(np.int64)
                n = np.bincount(text, weights=count, minlength=last - first).astype(np.int64)
                own = np.flatnonzero(n)
                yield pd.DataFrame({"id": ids[first:last][own], "n": n[own], "bands": list(found[own])})

    keyed = documents.where(has_words()).select(F.xxhash64("text").alias("id"), "text")
    return keyed.mapInPandas(run, "id long, n long, bands array<long>").dropDuplicates(["id"])


def bags(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """id of each of the (distinct) texts and the levels of all shingles as a set of longs ("cells"), whose overlap is the multiset overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["id"].to_numpy()
            for first, last in by_size(texts):
                text, shingle, count = shingles(texts[first:last], words)
                level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                cells = splitmix(np.repeat(shingle, count) + level.astype(np.uint64) * _STEP).view(np.int64)
                ends = np.cumsum(np.bincount(np.repeat(text, count), minlength=last - first))
                yield pd.DataFrame({"id": ids[first:last], "cells": np.split(cells, ends[:-1])})

    return texts.mapInPandas(run, "id long, cells array<long>")


def verified(pairs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v, and any further columns) whose multiset overlap reaches the similarity."""
    left, right = bag.select(F.col("id").alias("u"), F.col("cells").alias("a")), bag.select(F.col("id").alias("v"), F.col("cells").alias("b"))
    met = pairs.join(left, "u").join(right, "v").withColumn("both", F.size(F.array_intersect("a", "b")))
    return met.where(F.col("both") >= similarity * (F.size("a") + F.size("b") - F.col("both"))).select(*pairs.columns)


def _met(one: Column, other: Column) -> list[Column]:
    """Two structs of id and root as u, its root, v and its root, the smaller id first."""
    low, high = F.least(one, other), F.greatest(one, other)
    return [low["id"].alias("u"), low["root"].alias("u_root"), high["id"].alias("v"), high["root"].alias("v_root")]


def links(documents: DataFrame, similarity: float = SIMILARITY, shape: Bands = Bands(), words: int = WORDS, rounds: int = 1) -> DataFrame:
    """(id, root) of the texts that have a near-duplicate and aren't their class's root themselves; ids are hashes of texts."""
    table = materialize(signed(documents, shape, words), "bands")
    rows = table.select("id", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("c")).where("c >= 2").select("band")
    rows = materialize(rows.join(shared, "band").groupBy("id", "n").agg(F.collect_list("band").alias("bands")), "buckets")
    texts = documents.where(has_words()).select(F.xxhash64("text").alias("id"), "text").groupBy("id").agg(F.first("text").alias("text"))
    bag = materialize(bags(texts.join(rows.select("id"), "id"), words), "bags")
    # cells that no other text has: what they leave, e, bounds every overlap, so J <= e / n
    single = bag.select("id", F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    single = single.groupBy("id").agg(F.count("*").cast("int").alias("c"))
    rows = rows.join(single, "id", "left").withColumn("e", F.col("n") - F.coalesce("c", F.lit(0))).where(F.col("e") >= similarity * F.col("n"))
    texts = materialize(rows.select("id", "n", "e", F.col("id").alias("root"), "bands"), "texts")
    ratio = similarity / (1 + similarity)
    near = (F.least("n", "m") >= similarity * F.greatest("n", "m")) & (F.least("e", "f") >= ratio * (F.col("n") + F.col("m")) - 1e-6)
    tried = None

    def joined(pairs: DataFrame) -> DataFrame | None:
        """(root, new) of the components that verified links among the pairs join, if there are any; ``texts`` have the new roots then."""
        nonlocal texts, tried
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return None
        tried = pairs.select("u", "v") if tried is None else tried.unionByName(pairs.select("u", "v"))
        new = materialize(verified(pairs, bag, similarity).select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).distinct(), "links")
        moved = materialize(components(new), "roots").select(F.col("id").alias("root"), F.col("root").alias("new"))
        texts = materialize(texts.join(moved, "root", "left").select("id", "n", "e", F.coalesce("new", "root").alias("root"), "bands"), "texts")
        return moved

    for k in range(rounds):
        state = texts.select("id", "n", "e", "root", F.explode("bands").alias("band"))
        # the hub is the text with the least of its own: the likely origin of its bucket's copies
        hub = F.min(F.struct(((F.col("n") - F.col("e")) / F.col("n") if k == 0 else F.lit(0.0)).alias("own"), F.xxhash64("id", F.lit(k)).alias("r"), F.struct("id", "root").alias("hub"), F.col("n").alias("m"), F.col("e").alias("f")))
        mixed = state.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), hub.alias("x")).where("low <> high").select("band", "x.hub", "x.m", "x.f")
        joined(state.join(mixed, "band").where("root <> hub.root").where(near).select(*_met(F.struct("id", "root"), F.col("hub"))))
    prefix, hubs = _prefixes(texts, bag, similarity), 1
    while prefix is not None:
        large, small = _sides(prefix, similarity)
        rows, pairs = _pairs_at_most(large, small)
        # a cell whose texts are linked would give all their pairs: first they meet 1, 2, 4, ... hubs, as long as those are fewer pairs
        if pairs <= hubs * rows:
            joined(_across(large, small, similarity))
            break
        moved = joined(_to_hubs(large, small, similarity, hubs))
        if moved is not None:
            old, prefix = prefix, materialize(prefix.join(moved, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new"), "prefixes")
            discard(old)
        discard(large, small)
        hubs *= 2
    return texts.where("id <> root").select("id", "root")


def _prefixes(texts: DataFrame, bag: DataFrame, similarity: float) -> DataFrame | None:
    """The cells by which links across components are found, of texts whose buckets still hold several components; None if there are no such texts.

    ``reach`` of a text's cell is the largest size of another text that could still pair with this one if this cell,
    in the common order, were the first that both have. The smaller text of a pair is found by the cells that reach
    its own size, the larger one by those that reach the least size it may pair with. The prefixes hold for
    components that are joined later, too: what links those lies across the components of now.
    """
    ratio, slack = similarity / (1 + similarity), 1e-6
    state = texts.select("id", "root", F.explode("bands").alias("band"))
    mixed = state.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    open_ = materialize(state.join(mixed, "band").select("id", "root").distinct(), "open")
    if open_.isEmpty():
        return None
    cells = bag.join(open_, "id").select("id", "root", F.size("cells").alias("n"), F.explode("cells").alias("cell"))
    used = []
    for _ in range(2):  # texts that go leave cells to one component, which makes more texts go
        cells = materialize(cells, "cells")
        used.append(cells)
        kinds = cells.groupBy("cell").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell", "df")
        bags_ = cells.join(materialize(kinds, "kinds"), "cell").groupBy("id").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "cell"))).alias("shared"))
        bags_ = bags_.where(F.size("shared") >= similarity * F.col("n") - slack)
        cells = bags_.select("id", "root", "n", F.explode("shared.cell").alias("cell"))
    own = F.col("n") - F.size("shared")
    prefix = bags_.select("id", "root", "n", own.alias("own"), F.posexplode(F.slice("shared", 1, F.greatest(F.lit(0), F.floor(F.col("n") * (1 - similarity) + slack).cast("int") + 1 - own))).alias("k", "x"))
    reach = (F.col("n") - F.col("own") - F.col("k")) / ratio - F.col("n")
    size = F.floor(F.log(F.col("n")) / float(np.log(1 / similarity)) + 1e-9).cast("int") if similarity < 1 else F.col("n").cast("int")
    prefix = materialize(prefix.select("id", "root", "n", F.col("x.cell").alias("cell"), size.alias("size"), reach.alias("reach")), "prefixes")
    discard(*used)
    return prefix


_KEY = ["cell", "size"]


def _sides(prefix: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The larger and the smaller texts (as hub, m and f) at each cell and size that several components have."""
    slack = 1e-6
    small = prefix.where(F.col("reach") >= F.col("n") - slack)
    large = prefix.select("id", "root", "n", "cell", "reach", F.explode(F.array("size", F.col("size") - 1)).alias("size"))

    def facing(rows: DataFrame) -> DataFrame:
        """For each cell and size of ``rows`` the least text, whether there are several components, and the largest component."""
        by_root = rows.groupBy(*_KEY, "root").agg(F.count("*").alias("c"), F.min("n").alias("n"))
        found = by_root.groupBy(*_KEY).agg(F.min("n").alias("least"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("several"))
        return materialize(found.select(*_KEY, "least", F.col("top.root").alias("top"), (F.col("several") > 1).alias("several")), "facing")

    meets = (F.col("several") | (F.col("root") != F.col("top"))) & (F.col("reach") >= F.col("least") - slack)
    large = materialize(large.join(facing(small), _KEY).where(meets).select("id", "root", "n", "reach", (F.col("root") == F.col("top")).alias("of_top"), "top", *_KEY), "large")
    small = small.join(facing(large), _KEY).where(meets).select("id", "root", "n", "reach", *_KEY)
    # texts of a cell's largest component meet those of the others only, which are kept apart for them
    tops = materialize(large.select(*_KEY, "top").distinct(), "tops")
    small = small.join(tops, _KEY).select(F.struct("id", "root").alias("hub"), F.col("n").alias("m"), F.col("reach").alias("f"), F.explode(F.when(F.col("root") == F.col("top"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("of_top"), *_KEY)
    return large, materialize(small, "small")


def _pairs_at_most(large: DataFrame, small: DataFrame) -> tuple[int, int]:
    """How many rows the sides have, and how many pairs would meet before their sizes are looked at."""
    key = [*_KEY, "of_top"]
    one, other = (side.groupBy(*key).agg(F.count("*").alias(c)) for side, c in ((large, "c"), (small, "d")))
    total = one.join(other, key, "full").agg(F.sum(F.coalesce("c", F.lit(0)) + F.coalesce("d", F.lit(0))), F.sum(F.expr("cast(c as double) * d"))).first()
    return total[0] or 0, total[1] or 0


def _to_hubs(large: DataFrame, small: DataFrame, similarity: float, hubs: int) -> DataFrame:
    """Every larger text with at most ``hubs`` of the smaller ones at its cell and size."""
    draw = F.xxhash64("hub.id", F.lit(hubs))
    drawn = small.groupBy(*_KEY, F.pmod(draw, F.lit(hubs)).alias("slot")).agg(F.min(F.struct(draw.alias("r"), "hub", "m")).alias("x")).select(*_KEY, "x.hub", "x.m")
    met = large.join(drawn, _KEY).where((F.col("root") != F.col("hub.root")) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-6))
    return met.select(*_met(F.struct("id", "root"), F.col("hub")))


def _across(large: DataFrame, small: DataFrame, similarity: float) -> DataFrame:
    """All pairs across components that could reach the similarity."""
    slack = 1e-6
    pairs = large.join(small, [*_KEY, "of_top"])
    fits = (F.col("m") <= F.col("n")) & (F.col("m") >= similarity * F.col("n") - slack) & (F.col("m") <= F.col("reach") + slack) & (F.col("n") <= F.col("f") + slack)
    return pairs.where(fits & (F.col("root") != F.col("hub.root")) & ((F.col("m") < F.col("n")) | (F.col("hub.id") < F.col("id")))).select(*_met(F.struct("id", "root"), F.col("hub")))


def classes(documents: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size and whether the document is the one of its class that stays."""
    return _classes(documents, **parameters).select("doc_id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"))


def _classes(documents: DataFrame, **parameters) -> DataFrame:
    roots = links(documents, **parameters)
    keyed = documents.select("doc_id", F.when(has_words(), F.xxhash64("text")).alias("id"))
    filled = keyed.where("id is not null").join(materialize(roots, "roots"), "id", "left").select("doc_id", F.coalesce("root", "id").alias("root"))
    filled = materialize(filled, "classes")
    # a table of its own, so that the join can split a hot class
    sizes = materialize(filled.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "sizes")
    alone = keyed.where("id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("long").alias("root"))
    return filled.join(sizes, "root").select("doc_id", "class_id", "class_size", "root").unionByName(alone)


def keep_one(documents: DataFrame, **parameters) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; all columns as they were, whatever their names.

    Documents without words stay. Where doc_id is null or repeats in a class, one of the rows that
    have the smallest (a null only if there is nothing else) stays.
    """
    roots = materialize(links(documents, **parameters), "roots")
    id_ = F.when(has_words(), F.xxhash64("text"))
    own, doc, key = fresh(documents, "id", "doc", "key")
    rows = documents.select("doc_id", id_.alias("id")).where("id is not null")
    first = rows.join(roots, "id", "left").select(F.coalesce("root", "id").alias("root"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id").alias("x")).groupBy("root").agg(F.min("x").alias("x"))
    first = materialize(first.select(F.col("x.doc_id").alias(doc), F.col("x.id").alias(key)), "first")
    ties = rows.join(first, (F.col("id") == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_semi").groupBy("id", "doc_id").agg(F.count("*").alias("c"))
    keyed = documents.withColumn(own, id_)
    chosen = keyed.join(first, (F.col(own) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_semi")
    chosen = chosen if ties.where("c > 1").limit(1).isEmpty() else chosen.dropDuplicates([own, "doc_id"])
    return chosen.unionByName(keyed.where(F.col(own).isNull())).select(*map(quoted, documents.columns))
