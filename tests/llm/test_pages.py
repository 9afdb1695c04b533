"""Main text of pages that are not like the given ones: no article, misleading names, short texts, elements that never end."""

import pytest

from treeweave.llm import html

PARA = "The council met on Monday and decided, after a long debate, to build the bridge. It will cost much."
P, NAV, FOOT = f"<p>{PARA}</p>", "<nav><a href=x>Home</a> <a href=y>About</a></nav>", "<footer>Copyright 2020 by us all</footer>"
UNENDED = ["svg", "object", "video", "audio", "canvas", "select", "iframe", "template", "noscript", "datalist", "math"]
PAGES = {
    "named as legal": (f'<html><body>{NAV}<div id="legal-news">{P * 3}</div>{FOOT}</body></html>', " ".join([PARA] * 3)),
    "about cookies": (f'<body>{NAV}<article>{P}<div class="cookie-recipes">{P}</div>{P}</article>{FOOT}</body>', " ".join([PARA] * 3)),
    "about search": (f'<body>{NAV}<div class="search-history"><article>{P}</article></div>{FOOT}</body>', PARA),
    "short paragraphs": (f"<body>{NAV}<div><p>It rained.</p><p>We left.</p><p>Then sun.</p></div>{FOOT}</body>", "It rained. We left. Then sun."),
    "links alone": (f"<body>{NAV}<article><ul><li><a href=1>First story</a></li><li><a href=2>Second story</a></li></ul></article>{FOOT}</body>", "First story Second story"),
    "one short paragraph": (f"<body>{NAV}<p>Only this.</p>{FOOT}</body>", "Only this."),
    "a formula": ("<article><p>We know that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here, as shown before.</p></article>", "We know that x=2 holds here, as shown before."),
    "a notice": (f'<body>{NAV}<div class="cookie-message">{P}</div><div class="legal-notice">{P}</div><article>{P}</article>{FOOT}</body>', PARA),
    "comments": (f'<body><article>{P}</article><div class="comments-list"><div class="comment-1">{P}</div></div></body>', PARA),
    "navigation alone": (f"<body>{NAV}{FOOT}</body>", ""),
    **{f"unended {t}": (f"<body>{NAV}<article>{P}<{t}>{P}{P}</article>{FOOT}</body>", " ".join([PARA] * 3)) for t in UNENDED},
    **{f"ended {t}": (f"<body>{NAV}<article>{P}<{t}>{P}</{t}>{P}</article>{FOOT}</body>", " ".join([PARA] * 2)) for t in UNENDED[:-1]},
    **{f"unended {t}": (f"<body>{NAV}<article>{P}</article><{t}>{P}{P}", PARA) for t in ("script", "style", "textarea", "title")},
}


@pytest.fixture(scope="module")
def weights(spark):
    return html.train(html.sampled(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html"), "html", "url"))


@pytest.mark.parametrize("kind", PAGES)
def test_main_text(weights, kind):
    page, text = PAGES[kind]
    assert html.main_text(page, weights) == text
    assert html.main_text(page, html.PRIOR) == text


def test_things():
    for name, what in {"legal-news": "news", "cookie-recipes": "recipes", "cookie-banner": "cookie-banner", "search-box": "search-box", "menu_main": "menu-main", "article-body": "article-body", "cookies": "cookies"}.items():
        assert html.thing(name).replace("_", "-") == what
