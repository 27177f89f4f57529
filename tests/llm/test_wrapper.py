"""Tree matching of wide lists, hosts of copies, and class names inside articles."""

import random
import time

import numpy as np
import pytest

from turnlab.llm import wrapper


def plain_weight(a, b):
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_weight(x, y))
    return 1 + best[-1][-1]


def page(order, n):
    kids = ["<p>a</p>", "<div><p>b</p></div>", "<div><ul><li>c</ul><p>d</p></div>", "<ul><li>e<li>f</ul>", "<div class=x></div>"]
    return wrapper.parse("<div>" + "".join(order.choice(kids) for _ in range(n)) + "</div>")


@pytest.mark.parametrize("wide", [0, 30, 2_000])
def test_matching_is_the_best_at_every_width(wide, monkeypatch):
    monkeypatch.setattr(wrapper, "_WIDE", wide)
    order = random.Random(wide)
    for _ in range(60):
        a, b = page(order, order.randrange(14)), page(order, order.randrange(14))
        pairs = wrapper.match_trees(a, b)
        assert len(pairs) == plain_weight(a, b)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        place = [{id(x): i for i, x in enumerate(wrapper.numbered(t))} for t in (a, b)]
        at = sorted((place[0][id(x)], place[1][id(y)]) for x, y in pairs)
        assert [y for _, y in at] == sorted(y for _, y in at) and all(x.label == y.label for x, y in pairs)


@pytest.mark.parametrize("n", [190, 210, 1_000, 6_000])
def test_one_more_child_in_a_long_list(n):
    rows = "".join(f"<li>{i}" + ("<p>x</p>" if i % 3 else "") + "</li>" for i in range(n))
    a, b = wrapper.parse(f"<ul>{rows}</ul>"), wrapper.parse(f"<ul><li><h2>new</h2></li>{rows}<li><h3>last</h3></li></ul>")
    began = time.process_time()
    assert len(wrapper.match_trees(b, a)) == len(wrapper.numbered(a))
    assert time.process_time() - began < 20


def test_pairs_by_halves():
    draw = np.random.default_rng(1)
    for _ in range(40):
        ours, theirs = draw.integers(0, 4, draw.integers(1, 30)), draw.integers(0, 5, draw.integers(1, 30))
        weights = draw.integers(0, 4, (4, 5))
        pairs = wrapper._paired(ours, theirs, weights)
        assert sum(weights[ours[i], theirs[j]] for i, j in pairs) == wrapper._most_matched(ours, theirs, weights)[-1]
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("name", ["share-price", "legal-history", "search-results", "comment-free", "related-work", "noticeBoardHistory"])
def test_names_inside_an_article(name):
    assert wrapper.extract_text(f'<article><p>one</p><div class="{name}">two</div><span id="{name}">three</span></article>') == "one\ntwo\nthree"


@pytest.mark.parametrize("name", ["ad", "share", "share-buttons", "comments", "comment-list", "related-posts", "cookie-notice", "adBox"])
def test_names_of_no_content(name):
    assert wrapper.extract_text(f'<article><p>one</p><div class="x {name}">two</div></article>') == "one"
    assert wrapper.extract_text(f'<div><p>one</p><div class="{name}-price">two</div></div>') == "one"


def test_hosts_of_copies_keep_their_text(spark):
    html = "<div>menu</div><div><p>first words</p><p>more words</p></div>"
    rows = [(i, "http://copies.example/x", html) for i in range(8)]
    rows += [(10 + i, "http://near.example/x", html + f"<div>{i}</div>" * (i == 7)) for i in range(8)]
    rows += [(20 + i, "http://site.example/x", f"<div>menu</div><div><p>words {i}</p></div>") for i in range(8)]
    found = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {found[i] for i in range(8)} == {"menu\nfirst words\nmore words"}
    assert {found[i] for i in range(10, 17)} == {"menu\nfirst words\nmore words"}
    assert [found[20 + i] for i in range(8)] == [f"words {i}" for i in range(8)]
