"""Main text of pages: against a brute-force extractor on trees, and on pages that lose text easily."""

import html
import math
import random
import time

import numpy as np
import pytest

from blockloom.llm import html_text

LONG = "A paragraph of prose that goes on and on, with commas and words enough. " * 4


def tree(rng, depth=0):
    """A random page body: lists of (tag, class, children), texts as strings, links as ('a', ...)."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.45:
            words = " ".join("".join(rng.choices("abcdé&<", k=rng.randint(1, 8))) for _ in range(rng.choice((1, 4, 30))))
            out.append((rng.choice(("p", "p", "h2")), "", [words]))
        elif kind < 0.6:
            out.append(("ul", "", [("li", "", [("a", "", ["link text"])] if rng.random() < 0.6 else ["plain item"]) for _ in range(rng.randint(1, 5))]))
        elif kind < 0.7:
            out.append((rng.choice(("nav", "aside", "footer")), "", [("p", "", ["furniture " * rng.randint(1, 9)])]))
        elif depth < 3:
            out.append((rng.choice(("div", "section", "article")), rng.choice(("", "", "share", "story")), tree(rng, depth + 1)))
    return out


def written(nodes):
    return "".join(html.escape(x) if isinstance(x, str) else f'<{x[0]} class="{x[1]}">{written(x[2])}</{x[0]}>' for x in nodes)


def brute(nodes):
    """The same decisions from the tree itself, by loops over all pairs of lines."""
    lines, every = [], []

    def walk(items, above):
        for tag, name, children in items:
            here = [*above, len(every)]
            every.append((tag, name, above))
            if tag in ("p", "li", "h2"):
                text = "".join(x if isinstance(x, str) else x[2][0] for x in children)
                link = any(not isinstance(x, str) for x in children)
                lines.append({"text": " ".join(text.split()), "links": int(link), "plain": 0 if link else len(text.strip()), "path": here, "tag": tag})
            else:
                walk(children, here)

    walk(nodes, [])
    lines = [x for x in lines if x["text"]]
    if not lines:
        return ""
    mark = lambda k: every[k][0] in ("nav", "aside", "footer") or every[k][1] == "share"
    within = lambda k: [x for x in lines if k in x["path"]]
    size = lambda xs: sum(len(x["text"]) for x in xs)
    tops = [k for k, (tag, _, above) in enumerate(every) if tag == "article" and not mark(k) and not any(every[a][0] == "article" for a in above)]

    def furniture(k):
        held = [m for m in tops if m == k or k in every[m][2]]
        if not mark(k):
            return False
        wraps = every[k][0] not in ("nav", "aside", "footer")
        whole = len(held) == len(tops) and (held and 2 * size(within(k)) > size(lines) or wraps and len(within(k)) > 2 and size(within(k)) > 0.8 * size(lines))
        return not whole

    for x in lines:
        x["zone"] = 2 if any(furniture(k) for k in x["path"]) else 1 if any(every[k][0] == "article" for k in x["path"]) else 0
        x["list"] = next((k for k in x["path"] if every[k][0] == "ul"), None)
    share = size([x for x in lines if x["zone"] == 1]) / max(1, size([x for x in lines if x["zone"] < 2]))
    tags = html_text.Page()
    tags.feed(written(nodes))
    counted = [x.tags for x in tags.finish()]
    for x, n in zip(lines, counted, strict=True):
        group = [y for y in lines if y["list"] == x["list"]] if x["list"] is not None else [x]
        plain, links = sum(y["plain"] for y in group), sum(y["links"] for y in group)
        ratio = math.log1p(plain / (2 + links) if x["list"] is not None else x["plain"] / max(1, n))
        x["value"] = {0: ratio * (1 - share), 1: ratio + html_text.LIFT, 2: 0.0}[x["zone"]]
        x["menu"] = x["zone"] == 0 and links > 1 and 4 * plain < size(group)
        x["group"] = group
    for x, y in reversed(list(zip(lines, lines[1:]))):
        if x["tag"] == "h2" and x["zone"] == y["zone"]:
            x["value"] = max(x["value"], y["value"])
    for x in lines:
        x["zone"] = 3 if x["menu"] else x["zone"]
    for i, x in enumerate(lines):
        weights = [(math.exp(-0.5 * (i - j) ** 2), y["value"]) for j, y in enumerate(lines) if abs(i - j) <= 3 and y["zone"] == x["zone"]]
        x["smooth"] = sum(w * v for w, v in weights) / sum(w for w, _ in weights)
    cut = html_text.threshold(np.array([x["smooth"] for x in lines]))
    best = lambda x: max(y["smooth"] for y in x["group"])
    return "\n".join(x["text"] for x in lines if best(x) >= cut - 1e-12 and best(x) > 0)


def test_pages_equal_brute_force():
    rng = random.Random(5)
    pages = [tree(rng) for _ in range(400)]
    results = [html_text.main_text(written(p)) for p in pages]
    for page, got in zip(pages, results):
        assert got == brute(page), written(page)
    assert 50 < sum(0 < len(r) < len(html_text.main_text(f"<article>{written(p)}</article>")) for p, r in zip(pages, results))


def test_threshold_splits_two_clusters():
    assert html_text.threshold(np.array([0.0, 0.0, 0.1, 3.0, 4.0])) == html_text.DENSE
    assert 0.2 < html_text.threshold(np.array([0.0, 0.1, 0.8, 0.9])) < 0.8
    assert html_text.threshold(np.array([3.0, 4.0, 5.0])) == html_text.threshold(np.array([0.7] * 3)) == 0.0


@pytest.mark.parametrize("smooth", [lambda v, z, s: np.ones(len(v)), lambda v, z, s: np.random.default_rng(0).random(len(v))])
def test_the_ratios_decide(monkeypatch, smooth):
    page = f'<ul><li><a href="/">Home</a><li><a href="/b">B</a></ul><div class=ad>{LONG}</div><article><h1>T</h1><p>{LONG}<p>{LONG}<p>{LONG}</article><footer>{LONG}</footer>'
    right = html_text.main_text(page)
    assert right == "\n".join(["T", *[LONG.strip()] * 3])
    monkeypatch.setattr(html_text, "smooth", smooth)
    assert html_text.main_text(page) != right


@pytest.mark.parametrize(("page", "want"), [
    ('<body class="no-sidebar"><article><p>one</p><p>two</p></article></body>', "one\ntwo"),
    ('<div class="page-header-wrap"><article><p>one</p></article></div><footer>f</footer>', "one"),
    (f"<form><h1>T</h1><p>{LONG}</p><p>b</p><select><option>x</select><button>Go</button></form>", f"T\n{LONG.strip()}\nb"),
    (f"<div><p>{LONG}</p></div><div><p>short</p></div>", f"{LONG.strip()}\nshort"),
    (f"<div><section>{LONG}</section><section>{LONG[:80]}</section></div>", f"{LONG.strip()}\n{LONG[:80].strip()}"),
    (f"<article><p>one</p></article><article><p>{LONG}</p></article>", f"one\n{LONG.strip()}"),
    (f'<article><p>{LONG}</article><section class="comments"><article><p>{LONG * 5}</article></section>', LONG.strip()),
    (f'<article><p>{LONG}</article><section class="comments"><article class=comment><p>{LONG * 5}</article></section>', LONG.strip()),
    (f'<div><a href="/">Home</a> <a href="/a">About</a></div><div><h1>News</h1><p>{LONG}</p><ul><li>one<li>two</ul><p>end.</p></div><div>© 2024 Acme</div>', f"News\n{LONG.strip()}\none\ntwo\nend."),
    ('<p>text <span class="share">Share me</span> more <b class="x">bold</b>.</p>', "text more bold."),
    ("<html><head><title>x</title><body><p>hi &amp; bye</p>", "hi & bye"),
    ("<nav><a>x</a></nav><footer>long words of a footer</footer>", ""),
    ("<p>before</p><![foo[ x]]><p>5 < 6</p><!-- never <p>text", "before\n5 < 6"),
    ('<p>before</p><p title="never closed <b>after</b>', "before\nafter"),
])
def test_pages_that_lose_text_easily(page, want):
    assert html_text.main_text(page) == want


def test_deep_and_broken_pages_take_linear_time():
    began = time.perf_counter()
    assert html_text.main_text("<div>" * 50_000 + "x") == "x"
    assert html_text.main_text("<div>" * 50_000 + "</span>x" * 50_000).count("x") == 50_000
    for part in ("<!--", "<a ", '<p x="', '<div class="a b ', "<b class=ad>", "<![", "</"):
        for end in ("", ">", '">--></p>'):
            html_text.main_text("<p>text</p>" + part * 20_000 + end)
    assert time.perf_counter() - began < 60
