"""Pages of other shapes than the given ones."""

import re

import pytest

from wardline.llm.common import table
from wardline.llm.html_text import main_text

STORY = "This is the story text of the page, with many words in it. " * 6
P = f"<p>{STORY}</p>"
WANT = STORY.strip()


@pytest.mark.parametrize("page", [
    f"<form><article>{P}</article></form>", f"<body><form id=aspnetForm><input><div>{P}</div></form>", f"<fieldset><main>{P}</main></fieldset>",
    f"<!-->{P}<!-- no -->", f"<!--->{P}", f"<!-- a --!>{P}", f"<!--{P}-->{P}",
])
def test_forms_and_comments_around_the_article(page):
    assert main_text(page) == WANT


def test_a_form_alone_is_no_article():
    assert main_text("<form><label>Your name</label><input><label>Your message to us</label></form>") == ""


@pytest.mark.parametrize("aside", [
    "<ol class='comment-list'><li>{0}</li></ol>", "<section id='comments-area'><p>{0}</p></section>", "<div class='related-posts'>{0}</div>",
    "<div class='ad-container'>{0}</div>", "<div class='sidebar-left'>{0}</div>", "<div class='nav-links'>{0}</div>",
    "<div id='cookie-bar'>{0}</div>", "<div class='post-comments-list'><article>{0}</article></div>", "<form><p>{0}</p></form>",
])
@pytest.mark.parametrize("whole", ["article", "main"])
def test_what_goes(aside, whole):
    assert main_text(f"<{whole}>{P}{aside.format('Nice words to say here.')}</{whole}>") == WANT


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "no-sidebar", "has-banner", "menu-open", "sidebar-wrap", "search-results"])
def test_wrappers_stay(name):
    assert main_text(f"<div class='{name}'><article>{P}</article></div>") == WANT
    assert main_text(f"<div class='{name}'>{P}</div><p>x</p>").startswith(WANT)


@pytest.mark.parametrize("name", ["notice-text", "related-work", "menu-open"])
def test_blocks_that_stay(name):
    assert main_text(f"<article>{P}<div class='{name}'>and more</div></article>") == WANT + " and more"


def test_density_without_article_elements(spark):
    """The given pages with their article elements renamed: the densities alone find nine texts in ten as they are."""
    pages = [r.html or "" for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    bare = [re.sub(r"(</?)(article|main)\b", r"\1div", h, flags=re.I) for h in pages]
    same = sum(main_text(a) == main_text(b) for a, b in zip(pages, bare))
    assert same >= 0.9 * len(pages)
