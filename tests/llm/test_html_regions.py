"""Pages on which text after raw elements, or an article in a named wrapper, could be lost."""

import time

import pytest

from rillflow.llm import html

LONG = "The article itself has a first paragraph that is long enough to be read as the main text of this page."


@pytest.mark.parametrize("inner", [
    '<svg class="i"/>', "<object data='x' />", "<video-player>", "<select-box></select-box>", "<button-group>", "<svg>", "<object data=x>", "<IFRAME src=a/b>", '<svg><path d="M0 0"/></svg>',
    "<button>Send it</button>", "<object data=http://a/>fallback</object>", "<script>var a = '<p>no</p>'</script >", '<script src="x"/>'])
def test_text_after_raw_elements(inner):
    assert html.main_text(f"<p>One two</p>{inner}<p>three four</p>") == "One two three four"


def test_script_never_closed_is_not_text():
    assert html.main_text("<p>One two</p><script>var a = 1; <p>b</p>") == "One two"


@pytest.mark.parametrize("name", ["has-sidebar", "page no-sidebar", "header-fixed", "with_menu", "layout nav-left"])
@pytest.mark.parametrize("inside", ["article", "main", "main><article"])
def test_article_in_a_named_wrapper(name, inside):
    page = f'<div class="{name}"><div><{inside}><p>{LONG}</p><div class="comments"><p>A reader says that this is a very good text indeed.</p></div></{inside[:4] if inside[0] == "m" else inside}></div><nav><p>All of the other pages of this site</p></nav></div>'
    assert html.main_text(page) == LONG


def test_articles_of_others_stay_apart():
    page = f'<article><p>{LONG}</p></article><div class="comments"><article><p>A reader says that this is a very good text indeed, and more.</p></article></div>'
    assert html.main_text(page) == LONG
    assert html.main_text(f"<aside><article><p>{LONG}</p></article></aside>") == ""


def test_a_page_of_open_raw_tags_takes_no_square_time():
    began = time.time()
    html.main_text("<svg><p>a</p>" * 20_000)
    assert time.time() - began < 5
