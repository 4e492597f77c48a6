"""Layouts of pages, work that grows with the page, and the slope that is learned with."""

import time

import numpy as np
import pytest

from rowtide.llm import html_text
from rowtide.llm.html_blocks import leaf_blocks

WORDS = [f"{a}{b}" for a in ("stone", "river", "light", "paper", "green") for b in ("s", "ed", "ing", "", ",", ".")]


def blocks_of(training, layouts):
    made = [(leaf_blocks(p), y) for p, y in html_text.labelled_pages(WORDS, training, layouts)]
    return [(html_text.features(b), y) for b, y in made if len(b) == len(y)]


@pytest.fixture(scope="module")
def chain():
    training = html_text.Training()
    return html_text.fit(blocks_of(training, html_text.LAYOUTS), training)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><header><h1>A title</h1></header><p>First paragraph of it, with words.</p><footer>Posted in things</footer></article>",
         "A title\n\nFirst paragraph of it, with words."),
        ("<main><p>one sentence</p></main>", "one sentence"),
        ("<div><p>First paragraph is here, yes.</p><p>Second paragraph goes on.</p></div>", "First paragraph is here, yes.\n\nSecond paragraph goes on."),
        ("<html><body><p>Only text.</p></body></html>", "Only text."),
        ("<body><header><a href=/>Site</a></header><article><header><h1>T x</h1><p class=byline>By A</p></header><p>Body text, long enough to read.</p>"
         "<footer><p>Tags: a</p></footer></article><footer>c</footer></body>", "T x\n\nBy A\n\nBody text, long enough to read."),
    ],
)
def test_text_of_hand_labelled_pages(chain, page, text):
    assert html_text.main_text(chain, page) == text


@pytest.mark.parametrize("layout", ["headed article", "div", "main"])
def test_a_layout_that_was_not_learned_from(layout):
    training = html_text.Training(pages=300, epochs=4)
    others = [x for x in html_text.LAYOUTS if x != layout]
    found = html_text.fit(blocks_of(training, others), training)
    wrong = total = 0
    for features, labels in blocks_of(html_text.Training(pages=100, seed=55), [layout]):
        wrong += sum(a != b for a, b in zip(found.viterbi(found.scores(features)), labels))
        total += len(labels)
    assert wrong < 0.05 * total


def test_shared_names_weigh_as_single_ones(chain):
    for page, _ in html_text.labelled_pages(WORDS, html_text.Training(pages=30, seed=8)):
        blocks = leaf_blocks(page)
        assert np.allclose(chain.page_scores(blocks), chain.scores(html_text.features(blocks)))


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "</section>x" * 100_000, "<b>" * 100_000 + "<p>a</p>" * 100_000, "<i><div>" * 60_000 + "</i>" * 200_000,
     "".join(f"<div class='n{i:b}a'>t".replace("0", "q").replace("1", "z") for i in range(30_000)), "<p>" + "<b>" * 200_000 + "</u>" * 200_000],
)
def test_stray_and_nested_tags_take_linear_work(chain, page):
    assert len(page) > 700_000
    started = time.process_time()
    html_text.main_text(chain, page)
    assert time.process_time() - started < 10


def test_slope_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    found, labels = [sorted(rng.choice(6, 3, replace=False).tolist()) for _ in range(5)], np.array([0, 1, 1, 0, 1])
    values = [rng.normal(size=6), rng.normal(size=(2, 2)), rng.normal(size=2)]
    _, *slopes = html_text.gradient(found, labels, *values)
    for kind, slope in enumerate(slopes):
        for place in np.ndindex(slope.shape):
            ends = []
            for step in (1e-6, -1e-6):
                moved = [v.copy() for v in values]
                moved[kind][place] += step
                ends.append(html_text.gradient(found, labels, *moved)[0])
            assert abs((ends[0] - ends[1]) / 2e-6 - slope[place]) < 1e-6
