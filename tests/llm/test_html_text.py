import numpy as np
import pytest

from xmlframe.llm import html_text
from xmlframe.llm.html_text import main_text

LONG = "A long sentence of running text that goes on and on so that its line is dense."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>x", "x"),
        ("<script>var t='</p>';</script><style>p{}</style>", ""),
        (f"<nav><a href=1>Home</a></nav><article><h1>T &amp; t</h1><p><b>One.<br><p>{LONG}</article><footer>&copy;</footer>", f"T & t\nOne.\n{LONG}"),
        (f"<body class='has-sidebar'><div id=header>Site</div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=cookie-notice>{LONG}</div>", f"{LONG}\nShort.\n{LONG}"),
        (f"<article><p>{LONG}</p><form>Name <input><button>Go</button></form><aside>{LONG}</aside><section class=comments><p>{LONG}</p></section></article>", LONG),
        ("<article><p>a\n\t b &nbsp; c</p><ul><li>one<li>two</ul></article>", "a b c\none\ntwo"),
        ("<main><p>in <em>line</em> text</p><!-- <p>no</p> --></main>", "in line text"),
        (f"<article><p>{LONG}</p></article><article class=comment><p>{LONG} No!</p></article>", LONG),
        (f"<article><p>{LONG}", LONG),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_whole_page_is_read():
    page = "<article>" + "".join(f"<p>paragraph {i} {LONG}</p>" for i in range(3000)) + "<p>end</p></article>"
    assert main_text(page).count("\n") == 3000 and main_text(page).endswith("\nend")


def test_smoothing_keeps_constants_and_spreads_peaks():
    assert np.allclose(html_text.smoothed(np.ones(9), 1.0), 1)
    x = np.zeros(9)
    x[4] = 1
    y = html_text.smoothed(x, 1.0)
    assert y.argmax() == 4 and np.allclose(y, y[::-1]) and 0 < y[3] < y[4]


def test_operator(spark):
    rows = [(1, "u", "<article>a</article>", "clash"), (2, None, None, None), (1, "u", "<article>a</article>", "clash")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in out] == [(1, "a", 1), (2, "", 0), (1, "a", 1)]
    assert html_text.extract(spark.createDataFrame([], "html string")).count() == 0


CARDS = "".join(f"<article><a href=/{i}>Read more {i}</a></article>" for i in range(3))


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{CARDS}", f"{LONG}\nShort.\n{LONG}"),
        (f"<article class='post has-sidebar'><p>{LONG}</p></article>", LONG),
        (f"<div class='content no-sidebar'><article><p>{LONG}</p><p>{LONG}</p></article></div>", f"{LONG}\n{LONG}"),
        (f"<div class=widget><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
        (f"<form action=/page><div><p>{LONG}</p></div></form>", LONG),
        (f"<html><head><title>T</title><body><p>{LONG}</p>", LONG),
        (f"<article><div><p>{LONG}</p><p>{LONG}</p></div><div><p><a href=1>One</a></p><p><a href=2>Two</a></p><p><a href=3>Three</a></p><p><a href=4>Four</a></p></div></article>", f"{LONG}\n{LONG}"),
    ],
)
def test_weights_instead_of_gates(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><h1>Head</h1><p>{LONG}</p><p>{LONG}</p>",
        f"<form id=page><nav><a href=1>Home</a></nav><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></form>",
        f"<article><div class=entry-header><h1>Head</h1></div><p>{LONG}</p><p>{LONG}</p></article>",
        f"<article><header class=article-header><h1>Head</h1></header><p>{LONG}</p><p>{LONG}</p></article>",
        f"<article><h1>Head</h1><p class=social-life>{LONG}</p><p>{LONG}</p></article>",
        f"<main><div class=search-results><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></main>",
        f"<article><h1>Head</h1><button>Share<p>{LONG}</p><p>{LONG}</p></article>",
        f"<article><p>Short teaser</p></article><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div>",
    ],
)
def test_legal_pages_keep_their_articles(page):
    text = main_text(page)
    assert text.startswith("Head\n") or "\nHead\n" in text
    assert text.count(LONG) == 2


def test_whole_table_against_a_second_implementation(spark):
    """Tags by a regular expression, lines and weights by tree, smoothing by explicit sums: the same texts for all pages."""
    import html as entities
    import math
    import re

    token = re.compile(r"<!--.*?-->|<!doctype[^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][\w-]*)((?:\"[^\"]*\"|[^\">])*)>|[^<]+", re.S | re.I)

    def plain(page):
        stack, lines, buffer, tags, linked, regions = [], [], [], 0, 0, 0
        top = lambda: stack[-1] if stack else {"region": 0, "skip": False, "chrome": False, "inside": False, "mark": False}

        def cut():
            nonlocal tags, linked
            words = " ".join("".join(buffer).split())
            if words:
                lines.append({"text": words, "tags": tags, "linked": linked, **top()})
                tags = linked = 0
            buffer.clear()

        for m in token.finditer(page or ""):
            raw, closing, name, attrs = m[0], m[2], (m[3] or m[1] or "").lower(), m[4] or ""
            if m[1]:
                tags += 1
            elif not m[3]:
                if raw[0] != "<" and not top()["skip"]:
                    text = entities.unescape(raw)
                    buffer.append(text)
                    linked += len(text.strip()) if any(x["name"] == "a" for x in stack) else 0
            elif closing:
                if name in html_text.BLOCKS:
                    cut()
                if any(x["name"] == name for x in stack):
                    while stack.pop()["name"] != name:
                        pass
            else:
                if name in html_text.BLOCKS:
                    cut()
                elif name == "br":
                    buffer.append(" ")
                tags += 1
                if name in html_text.VOID:
                    continue
                above, given = top(), dict(re.findall(r"([\w-]+)=[\"']?([^\"'>]*)", attrs))
                marks = html_text.ARTICLE_MARKS if name == "article" and not above["inside"] else html_text.MARKS
                own = name == "form" or name not in html_text.NEVER_MARKED | html_text.HEADINGS and any(
                    t.lower() in marks or (w := re.findall("[A-Za-z]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", t))) and {x.lower() for x in w} <= marks
                    for k in ("class", "id", "role", "itemtype") for t in given.get(k, "").split()
                )
                regions += name in html_text.REGIONS or own
                chrome = above["chrome"] or name in html_text.CHROME or name == "header" and not above["inside"] or given.get("aria-hidden", "false") not in ("", "false") or " hidden" in attrs
                stack.append({"name": name, "region": regions if name in html_text.REGIONS or own else above["region"], "skip": above["skip"] or name in html_text.SKIPPED, "chrome": chrome, "mark": above["mark"] or own, "inside": above["inside"]})
                stack[-1]["inside"] |= name in ("article", "main") and not chrome and not stack[-1]["mark"]
        cut()
        usable = [x for x in lines if not x["chrome"]]
        if not usable:
            return ""
        ratio = [0.0 if x["chrome"] else max(0, len(x["text"]) - x["linked"]) / (x["tags"] + 1) for x in lines]
        for i, x in enumerate(lines):
            near = [(j, math.exp(-0.5 * (j - i) ** 2)) for j in range(max(0, i - 3), min(len(lines), i + 4))]
            x["height"] = sum(ratio[j] * k for j, k in near) / sum(k for _, k in near) * (1.5 if x["inside"] else 1.0) * (0.1 if x["mark"] else 1.0)
            x["ratio"] = ratio[i]
        mean = sum(x["height"] for x in lines) / len(lines)
        spread = math.sqrt(sum((x["height"] - mean) ** 2 for x in lines) / len(lines))
        level = min(0.5 * spread, max(x["height"] for x in usable)) * (1 - 1e-12)
        chosen = {x["region"] for x in usable if x["height"] >= level and x["ratio"] > 0}
        return "\n".join(x["text"] for x in usable if x["region"] in chosen and (x["ratio"] > 0 or x["height"] >= level))

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    wrong = [r.page_id for r in pages if plain(r.html) != main_text(r.html)]
    assert len(pages) > 200 and not wrong, (len(wrong), wrong[:5])
