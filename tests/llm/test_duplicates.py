"""Near-dedup and suffix dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import documents, edge_rows, words

from tideline.llm import near_dedup, suffix_dedup


def bag(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    """doc -> set of docs in its class, by all pairs."""
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                root[find(i)] = find(j)
    out = defaultdict(set)
    for i in range(len(rows)):
        out[find(i)].add(rows[i][0])
    return {frozenset(v) for v in out.values()}


def edited(text, r, share):
    w = text.split()
    for _ in range(int(share * len(w))):
        w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
    return " ".join(w)


def family_rows():
    r = random.Random(5)
    rows, n = [], 0
    for base in range(12):
        text = words(base, 150)
        rows.append((n, text))
        n += 1
        for _ in range(8):
            rows.append((n, edited(text, r, r.choice([0.0, 0.01, 0.02, 0.04, 0.08]))))
            n += 1
    rows += [(n + i, words(500 + i, 90)) for i in range(60)]
    rows += [(2000, "short one"), (2001, "short one"), (2002, "short two"), (2003, "a b c d e"), (2004, "a b c d e a b c d e")]
    return rows


def test_near_classes_equal_all_pairs(spark):
    rows = family_rows()
    got = defaultdict(set)
    for r in near_dedup.classes(documents(spark, rows)).collect():
        got[r.class_id].add(r.doc_id)
        assert r.stays == (r.doc_id == r.class_id)
    assert {frozenset(v) for v in got.values()} == brute_classes(rows)


def test_a_large_group_that_hangs_together_by_chains(spark):
    """A chain of small edits: neighbours are near copies, the ends are not, and hubs alone would not join them."""
    r, text, rows = random.Random(3), words(77, 200), []
    for i in range(40):
        rows.append((i, text))
        text = edited(text, r, 0.012)
    got = near_dedup.classes(documents(spark, rows)).collect()
    want = brute_classes(rows)
    found = defaultdict(set)
    for x in got:
        found[x.class_id].add(x.doc_id)
    assert {frozenset(v) for v in found.values()} == want


def test_a_family_of_two_thousand_near_copies_equals_all_pairs(spark):
    """Variants of one text whose edits recur: many are no near copies of the base, and some of those are of one another."""
    r, base, vocabulary = random.Random(6), words(55, 110).split(), words(56, 30).split()
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w[r.randint(0, 8) :])))
    bags = [bag(t) for _, t in rows]
    ids = {}
    cells = [[ids.setdefault((g, k), len(ids)) for g, n in b.items() for k in range(n)] for b in bags]
    matrix = np.zeros((len(rows), len(ids)), dtype=np.float32)
    for i, c in enumerate(cells):
        matrix[i, c] = 1
    size, root, links = matrix.sum(1), list(range(len(rows))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        both = matrix[:i] @ matrix[i]
        for j in np.flatnonzero(both >= 0.8 * (size[:i] + size[i] - both) - 1e-6):
            links += 1
            root[find(i)] = find(int(j))
    want = defaultdict(set)
    for i in range(len(rows)):
        want[find(i)].add(i)
    got = defaultdict(set)
    for x in near_dedup.classes(documents(spark, rows)).collect():
        got[x.class_id].add(x.doc_id)
    assert links > 50_000 and len(want) > 100
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}


def test_a_family_of_many_links_is_not_listed_pair_by_pair(spark, monkeypatch):
    """Variants of one text that differ in up to twelve places, linked if few differ: one hub of a bucket leaves many components with thousands of links."""
    r, base, other = random.Random(2), words(31, 144).split(), words(32, 12).split()
    rows = [(i, " ".join(other[t // 12] if t % 12 == 6 and r.random() < 0.5 else w for t, w in enumerate(base))) for i in range(300)]
    rows += [(1000 + i, words(600 + i, 100)) for i in range(5)]
    listed = []
    for name in ("_to_hubs", "_across"):

        def counted(*arguments, made=getattr(near_dedup, name)):
            pairs = made(*arguments)
            listed.append(pairs.count())
            return pairs

        monkeypatch.setattr(near_dedup, name, counted)
    got = defaultdict(set)
    for x in near_dedup.classes(documents(spark, rows)).collect():
        got[x.class_id].add(x.doc_id)
    assert {frozenset(v) for v in got.values()} == brute_classes(rows)
    assert sum(listed) < 25_000


def test_multiset_similarity_counts_repeats(spark):
    once, twice = words(9, 60), words(9, 60) + " " + words(9, 60)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(documents(spark, [(1, once), (2, twice), (3, twice + " tail")])).collect()}
    assert got[1] != got[2] and got[2] == got[3]


def test_other_similarities(spark):
    r, text = random.Random(7), words(70, 100)
    rows = [(i, edited(text, r, 0.02 * (i % 4))) for i in range(12)] + [(20, text), (21, text + " more")]
    bags = {i: bag(t) for i, t in rows}
    for similarity in (1.0, 0.9):
        got = {x.doc_id: x.class_id for x in near_dedup.classes(documents(spark, rows), similarity=similarity).collect()}
        for i, a in bags.items():
            for j, b in bags.items():
                both = sum((a & b).values())
                if both >= similarity * (sum(a.values()) + sum(b.values()) - both):
                    assert got[i] == got[j]
        assert len(set(got.values())) > 3


def test_signatures_agree_with_weighted_similarity():
    r = random.Random(1)
    a = " ".join(r.choice("abcdef") * 3 for _ in range(400))
    b = edited(a, r, 0.05)
    text, shingle, count = near_dedup.shingles([a, b])
    sig = near_dedup.signatures(2, text, shingle, count, 4096)
    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    assert abs((sig[0] == sig[1]).mean() - both / (sum(x.values()) + sum(y.values()) - both)) < 0.03


def test_keep_one_and_edges(spark, edges, empty):
    kept = near_dedup.keep_one(edges)
    assert kept.columns == edges.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert Counter(d for d, _ in rows) == Counter([1, 2, 3, 4, 5, None, None, 7, 9, 10, 11, 12, 13])
    got = near_dedup.classes(edges)
    assert got.count() == len(edge_rows())
    assert near_dedup.classes(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


def brute_repeats(texts, width=200):
    """For each text the covered bytes, by every string of ``width`` bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                cover[i : i + width] = True
        runs = int((np.diff(cover[: len(d)].astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, c in zip(d, cover[: len(d)], strict=True) if not c)
        out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passage_rows():
    r = random.Random(8)
    shared = [words(900 + i, n) for i, n in enumerate((35, 60, 45, 33))]
    rows = []
    for i in range(40):
        parts = [words(i, r.randint(5, 60))]
        for s in r.sample(shared, r.randint(0, 2)):
            # cut anywhere, so that strings meet with other neighbours
            a, b = r.randint(0, 30), len(s) - r.randint(0, 40)
            parts += [s[a:b], words(100 + i, r.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    body = words(42, 50)
    rows += [(100, body + " | " + body), (101, "é你" * 150), (102, "x" * 199), (103, "y" * 200), (104, "z" * 201), (105, "你好" * 40), (106, rows[0][1]), (107, rows[0][1] + "!")]
    return rows


@pytest.mark.parametrize("which", ["passages", "edges"])
def test_repeated_strings_equal_brute_force(spark, which):
    rows = passage_rows() if which == "passages" else [(r[0], r[1][:4000] if r[1] else r[1]) for r in edge_rows()]
    want = Counter((r[0], *x) for r, x in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    assert Counter(tuple(r) for r in suffix_dedup.spans(documents(spark, rows)).collect()) == want


@pytest.mark.parametrize("limit", [3, 12])
def test_leading_bytes_that_many_share_are_divided(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    r, line = random.Random(4), words(900, 14)
    shared = [words(910 + i, 22) for i in range(3)]
    rows = [(i, " ".join([words(i, 20), r.choice(shared)[r.randint(0, 30) :], line, r.choice(shared)[: r.randint(60, 110)], words(500 + i, 20)])) for i in range(60)]
    rows += [(100 + i, line * 3 + str(i % 7)) for i in range(14)]
    want = Counter((r[0], *x) for r, x in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    assert Counter(tuple(r) for r in suffix_dedup.spans(documents(spark, rows)).collect()) == want


def test_multikey_orders_rows_and_tells_shared_bytes():
    r = np.random.default_rng(2)
    rows = r.choice(np.array([0, 1, 255], dtype=np.uint8), (400, 16))
    order, shared = suffix_dedup.multikey(rows.view(">u8").astype(np.uint64))
    got = [bytes(rows[i]) for i in order]
    assert got == sorted(got)
    assert [next((k for k in range(16) if a[k] != b[k]), 16) for a, b in zip(got, got[1:], strict=False)] == shared[1:].tolist()


def test_hot_leading_bytes_are_dealt_over_their_ranges_in_order():
    r = np.random.default_rng(3)
    lead = np.sort(r.choice(np.array([-5, 0, 0, 0, 7, 9]), 2000))
    block = r.integers(-(2**63), 2**63 - 1, 2000)
    order = np.lexsort((block, lead))
    bucket = suffix_dedup._bucket(np.array([-5, 0, 0, 0, 8]), lead[order], block[order])
    assert (np.diff(bucket) >= 0).all() and len(set(bucket[lead[order] == 0])) == 3 and bucket.max() <= 5


def test_long_text_in_parts_gives_the_same_blocks():
    data = words(3, 1_600_000).encode()
    assert len(data) > 1 << 23
    whole = suffix_dedup.blocks([data[: 1 << 20]])
    parts = suffix_dedup._long_blocks(data, 200)
    end = (1 << 20) - 400
    cut = {(s, m, b) for s, m, b in zip(parts["start"], parts["more"], parts["block"], strict=True) if s + m < end}
    assert cut == {(s, m, b) for s, m, b in zip(whole["start"], whole["more"], whole["block"], strict=True) if s + m < end}


def test_removal_keeps_rows_columns_and_whole_characters(spark, edges, empty):
    out = suffix_dedup.remove(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    texts = defaultdict(list)
    for r in out.collect():
        texts[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text or "")
    assert texts[1] == [None] and texts[2] == [""] and len(texts[5]) == 2 and len(texts[7][0]) < 100
    assert suffix_dedup.remove(empty).count() == 0 and suffix_dedup.spans(empty).count() == 0
    chars = suffix_dedup.remove(documents(spark, [(1, "你好" * 60), (2, "好" + "你好" * 60)])).collect()
    assert all("�" not in r.text for r in chars)
