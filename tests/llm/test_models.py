"""Toxicity, HTML labelling, chat repair and chroma: held-out accuracy, brute force, planted cases."""

import itertools
import zlib

import numpy as np
import pytest
from conftest import documents, words

from tideline.llm import audio, chat, html_blocks, toxicity

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark, data):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    return toxicity.score(docs, toxicity.trained(docs, labels)), docs, labels


def test_toxicity_on_held_out_documents(scored):
    got, docs, labels = scored
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == docs.count() and len(rows) > 300
    toxic = np.array([r.toxic for r in rows])
    score = np.array([r.score for r in rows])
    pairs = score[toxic == 1][:, None] - score[toxic == 0][None, :]
    assert ((pairs > 0) + 0.5 * (pairs == 0)).mean() > 0.95
    caught, blamed = (score[toxic == 1] >= 0.3).mean(), (score[toxic == 0] >= 0.3).mean()
    assert caught > 0.9 and blamed < 0.05
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_never_reads_held_out_labels(spark, scored):
    got, docs, labels = scored
    for r in got.select("doc_id", "held_out").limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.trained(docs, labels), toxicity.trained(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(5, 1, 1), (5, 1, 0), (None, 1, 1), (99, 0, 1), (13, 0, None)], "doc_id long, quality long, toxic long")
    for docs, n in ((edges, edges.count()), (empty, 0)):
        model = toxicity.trained(docs, labels)
        assert toxicity.score(docs, model).count() == n
        assert toxicity.drop_toxic(docs, model).columns == docs.columns
    none = toxicity.trained(edges, labels.limit(0))
    assert {r.score for r in toxicity.score(edges, none).collect()} == {0.0} and toxicity.drop_toxic(edges, none).count() == edges.count()


def test_non_negative_risk_learns_from_positives_and_unlabelled_text():
    r = np.random.default_rng(0)
    make = lambda toxic: np.unique(np.concatenate([r.integers(0, 2000, 30), r.integers(5000, 5020, 4) if toxic else np.zeros(0, int)])).astype(np.int32)
    model = toxicity.fit([make(True) for _ in range(200)], [make(k % 10 == 0) for k in range(1000)], 0.1)
    value = lambda x: model.weights[x].sum() + model.bias
    hits = [value(make(True)) for _ in range(100)], [value(make(False)) for _ in range(100)]
    assert np.mean(np.array(hits[0])[:, None] > np.array(hits[1])[None, :]) > 0.98


def test_labeller_on_generated_pages_of_another_seed():
    r = np.random.default_rng(1234)
    right = total = 0
    model = html_blocks.trained()
    for _ in range(150):
        page, main = html_blocks.made_page(r)
        got = html_blocks.extract([page], model)[0].split("\n")
        want = [html_blocks.SPACE.sub(" ", t).strip() for t in main]
        total += 1
        right += got == want
    assert right / total > 0.85


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<article><h1>A &amp; B</h1><p>First  paragraph with <b>bold</b> and <a href=x>a link</a> inside it, long enough to read.</p><p>Second&nbsp;one &#233;t&eacute; follows the first paragraph here.</p></article>
<div id="comments"><h3>Comments</h3><div class="comment"><p>I disagree.</p></div></div>
<footer>&copy; 2020 Example</footer></body></html>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (None, None, "", "x"), (4, "u", "plain < text & more", "x"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_blocks.main_text(pages).collect()
    assert len(got) == 5
    texts = [r.text for r in got if r.page_id == 1]
    assert texts == ["A & B\nFirst paragraph with bold and a link inside it, long enough to read.\nSecond one \xe9t\xe9 follows the first paragraph here."] * 2
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, None)] == ["", ""]
    assert html_blocks.main_text(pages.limit(0)).count() == 0


def test_blocks_read_odd_markup():
    text = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert text("<p>a<p>b<br>c</p><!-- <p>no</p> --><div>d<span>e</span></div>") == ["a", "b c", "de"]
    assert text("x <b>y</i> z</div> &lt;w&gt; <") == ["x y z", "<w> <"]
    assert text("<div title='a > b'>in</div><script>if (a < b) '</p>'") == ["in"]
    assert text("<p>" + "word " * 200_000) == [("word " * 200_000).strip()]


def brute_cost(roles, costs):
    """The cheapest repair by trying every assignment of states."""
    table = chat.steps(costs)
    end = chat.closing(costs)
    best = chat.INFINITE
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        at, total = chat.START, 0
        for role, s in zip(roles, states, strict=True):
            step = table[chat._observed(role)][at][s]
            total += chat.INFINITE if step is None else step[0]
            at = s
        best = min(best, total + end[at])
    return best


def test_repair_costs_are_minimal_and_results_legal(spark):
    r = np.random.default_rng(2)
    rows, roles = [], ["system", "user", "assistant", None, "tool"]
    for conv in range(60):
        for turn in range(int(r.integers(1, 7))):
            rows.append((conv, turn, roles[int(r.integers(0, 5))], f"t{conv}.{turn}", "x"))
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")).collect()
    assert len(got) == len(rows)
    for conv in range(60):
        own = sorted((x for x in got if x.conv_id == conv), key=lambda x: x.position)
        given = [x[2] for x in rows if x[0] == conv]
        assert [x.role for x in own] == given
        assert sum(x.cost for x in own) == brute_cost(given, chat.Costs())
        rendered = "".join(x.rendered for x in own)
        turns = [t.split("\n", 1)[0].strip("<|>") for t in rendered.split("<|end|>\n") if t]
        body = turns[1:] if turns[0] == "system" else turns
        assert body == ["user", "assistant"] * (len(body) // 2) and body
        assert all(f"t{conv}.{x.turn}" in rendered for x in own)


def test_one_conversation_over_many_partitions_equals_one_pass(spark):
    r = np.random.default_rng(4)
    roles = [["user", "assistant", "system"][int(i)] for i in r.choice(3, 3000, p=[0.48, 0.48, 0.04])]
    rows = [(1, t, role, "x") for t, role in enumerate(roles)] + [(2, 0, "user", "hi")]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = chat.repaired([chat._observed(x) for x in roles], chat.Costs())
    total = sum(s[0] for _, s in want) + chat.closing(chat.Costs())[want[-1][0]]
    assert sum(x.cost for x in got if x.conv_id == 1) == total


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, part string"
    rows = [(None, None, None, None, "x"), (None, 1, "user", "", "x"), (3, 1, "user", "a", "x"), (3, 1, "user", "a", "x"), (4, 2, "assistant", "b" * 100_000, "x")]
    got = chat.repair(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and chat.repair(spark.createDataFrame([], schema)).count() == 0
    assert "".join(x.rendered for x in sorted((x for x in got if x.conv_id == 4), key=lambda x: x.position)).startswith("<|user|>\n<|end|>\n<|assistant|>\nbbb")


def tune_of(seed, n=48):
    return np.random.default_rng(seed).uniform(-0.3, 0.3, n)


def test_shifted_noisy_recordings_align(spark):
    r = np.random.default_rng(6)
    base = audio.tune(tune_of(1))
    shift = 20
    late = np.concatenate([audio.tune(tune_of(50))[: shift * audio.HOP], base]) + r.normal(0, 0.005, len(base) + shift * audio.HOP)
    rows = [(20, audio.wav(base), "x"), (21, audio.wav(late), "x"), (22, audio.wav(base), "x"), *((30 + k, audio.wav(audio.tune(tune_of(k + 2))), "x") for k in range(8)), (60, None, "x"), (61, b"RIFFnope", "x"), (62, audio.wav(np.zeros(9000)), "x")]
    media = spark.createDataFrame([(i, bytes(m) if m is not None else None, x) for i, m, x in rows], "id long, media binary, key string")
    prints = audio.fingerprints(media)
    got = audio.matches(prints, spark.createDataFrame([(20,), (60,), (62,), (20,)], "id long")).collect()
    found = {r.match_id: r for r in got if r.query_id == 20}
    assert set(found) == {20, 21} and found[20].copies == 2 and found[20].offset == 0 and found[20].bit_errors == 0
    assert abs(found[21].offset - shift) <= 1 and found[21].bit_errors < 0.2
    assert audio.matches(prints.limit(0), media.select("id")).count() == 0


def brute_matches(prints, queries):
    """For each query every fingerprint that shares enough indexed pairs at one offset and differs in few bits, one by one."""
    out = set()
    first = {}
    for i, p in prints.items():
        if len(p):
            first[p.tobytes()] = min(first.get(p.tobytes(), i), i)
    entries = {}
    for key in first:
        p = np.frombuffer(key, dtype=np.int32)
        own = {}
        for at in range(len(p) - 5):
            if p[at] and p[at + 5]:
                own.setdefault((p[at], p[at + 5]), at)
        entries[key] = own
    for q in queries:
        x = prints[q]
        if not len(x):
            continue
        for key, i in first.items():
            votes = {}
            for pair, at in entries[x.tobytes()].items():
                if pair in entries[key]:
                    d = entries[key][pair] - at
                    votes[d] = votes.get(d, 0) + 1
            if not votes:
                continue
            v, _, d = max((n, -abs(d), d) for d, n in votes.items())
            y = np.frombuffer(key, dtype=np.int32)
            a, b = (x[: max(min(len(x), len(y) - d), 0)], y[d : d + len(x)]) if d >= 0 else (x[-d : -d + len(y)], y[: max(min(len(x) + d, len(y)), 0)])
            wrong = sum(int(w).bit_count() for w in (a ^ b).view(np.uint32))
            if v >= audio.MIN_VOTES and len(a) >= audio.MIN_FRAMES and wrong <= audio.MAX_ERRORS * 32 * len(a):
                out.add((q, i, d, v))
    return out


def test_index_finds_what_comparing_all_recordings_finds(spark):
    r = np.random.default_rng(9)
    prints, media = {}, []
    for k in range(60):
        v = tune_of(k % 25)
        v = np.where(r.random(48) < 0.1 * (k % 3), r.uniform(-0.3, 0.3, 48), v)
        m = audio.wav(audio.tune(v))
        prints[k], media = audio.fingerprint(m), [*media, (k, m)]
    got = audio.matches(audio.fingerprints(spark.createDataFrame(media, "id long, media binary")), spark.createDataFrame([(k,) for k in range(0, 60, 5)], "id long")).collect()
    want = brute_matches(prints, range(0, 60, 5))
    found = {(x.query_id, x.match_id, x.offset, x.votes) for x in got}
    assert found == want and len(found) > 12


def test_playing_in_one_map_gives_the_same_fingerprints(spark):
    vectors = spark.createDataFrame([(1, tune_of(1).tolist()), (2, None), (3, []), (None, tune_of(2).tolist())], "id long, vector array<double>")
    key = lambda r: (r.id is None, r.id or 0)
    assert sorted(audio.played_fingerprints(vectors).collect(), key=key) == sorted(audio.fingerprints(audio.synthesized(vectors)).collect(), key=key)


def test_words_helper_is_stable():
    assert words(1, 3) == words(1, 3) and documents is not None
