"""Reading pages, features of blocks, and the gradients of the trained models."""

import time

import numpy as np
import pytest

from tideline.llm import html_blocks, toxicity


def test_words_late_in_a_block_count():
    start = " ".join(f"w{k}" for k in range(80))
    one, other = (html_blocks.vectors(html_blocks.blocks(f"<p>{start} {end}</p>"))[0] for end in ("subscribe newsletter", "continental geography"))
    assert not np.array_equal(one[html_blocks.PATH : -4], other[html_blocks.PATH : -4])


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<div>x" * 150_000, "<div>" * 100_000 + "</p>x" * 100_000, "<!-" * 300_000, "</script   " * 90_000], ids=["quotes", "nesting", "closing", "comments", "raw"])
def test_reading_takes_time_in_proportion_to_the_page(page):
    began = time.process_time()
    html_blocks.blocks(page)
    assert time.process_time() - began < 4


def test_broken_tags_leave_the_rest_of_the_page():
    text = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert text('<p>one<p title="two>three</p><p>four</p>') == ["one", "three", "four"]
    assert text("<p>one</p>a < b <!-- cut") == ["one", "a < b"]
    assert text("<script>x</script><p>one<script>var a") == ["one"]
    assert text("<p>a<!--<p>b-->c</p><svg><p>d</p></svg>e") == ["ac", "e"]


def test_a_long_page_in_segments_is_labelled_as_a_whole():
    model = html_blocks.trained()
    found = html_blocks.blocks("<nav><a href=/>home</a></nav><article>" + "<p>some words here</p><div class=ad>buy</div>" * 700 + "</article><footer>end</footer>")
    whole = model.probabilities([html_blocks.vectors(found)])[0]
    assert np.abs(model.long_page(found, 97) - whole).max() < 1e-5


def test_gradients_by_finite_differences():
    r = np.random.default_rng(0)
    model = html_blocks.Labeller(seed=1)
    model.weights = [w.astype(np.float64) for w in model.weights]
    pages = [r.standard_normal((n, html_blocks.INPUT)) for n in (5, 3)]
    x, mask = html_blocks._padded(pages)
    x, mask, y = x.astype(np.float64), mask.astype(np.float64), (r.random(mask.shape) < 0.5).astype(float)

    def loss():
        g = model._forward(x, mask)[0]
        return float(((np.logaddexp(0, g) - y * g) * mask).sum() / mask.sum())

    grads = model.gradients(x, mask, y)
    for k, w in enumerate(model.weights):
        for at in r.integers(0, w.size, 6):
            place = np.unravel_index(at, w.shape)
            before = w[place]
            w[place] = before + 1e-3
            above = loss()
            w[place] = before - 1e-3
            below = loss()
            w[place] = before
            assert abs((above - below) / 2e-3 - grads[k][place]) < 2e-4


@pytest.mark.parametrize("shift", [0.0, 4.0], ids=["risk", "turned"])
def test_risk_gradient_by_finite_differences(shift):
    r = np.random.default_rng(1)
    g = r.standard_normal(30)
    g[:10] += shift
    g[10:] -= shift
    value, d = toxicity.risk(g, 10, 0.4)
    assert (np.mean(np.logaddexp(0, g[10:])) - 0.4 * np.mean(np.logaddexp(0, g[:10])) < 0) == (shift > 0)
    for k in range(30):
        step = np.zeros(30)
        step[k] = 1e-5
        assert abs((toxicity.risk(g + step, 10, 0.4)[0] - toxicity.risk(g - step, 10, 0.4)[0]) / 2e-5 - d[k]) < 1e-7
