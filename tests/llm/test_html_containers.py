"""Names that don't name boilerplate, and articles of several containers."""

import random
import time

import pytest

from tidemark.llm import html

WORDS = "many words of the article stand here and go on "


@pytest.mark.parametrize("name", ["content has-sidebar", "entry no-sidebar", "page header-fixed", "post-12 post hentry comments-open", "market-share", "share-price", "related-work", "header-files"])
def test_layout_and_topic_names_are_kept(name):
    assert html.main_text(f"<body><div class='{name}'><h1>Head</h1><p>{WORDS}</p></div></body>") == f"Head\n{WORDS.strip()}"
    assert html.main_text(f"<body><article><p>{WORDS}</p><section id='{name}'><h2>Part</h2><p>text of it</p></section></article></body>") == f"{WORDS.strip()}\nPart\ntext of it"


@pytest.mark.parametrize("name", ["sidebar", "comments", "related-posts", "ad-3", "cookie_notice", "site-footer", "share-buttons"])
def test_parts_are_left_out(name):
    assert html.main_text(f"<body><div class='post'><p>{WORDS}</p><div id='{name}'><p>other things</p></div></div></body>") == WORDS.strip()


def test_wrappers_are_looked_into():
    assert html.main_text(f"<body><div class='widget'><h1>Head</h1><p>{WORDS}</p></div><p>x</p></body>").startswith(f"Head\n{WORDS.strip()}")
    assert html.main_text("<body><article class='comments related'><p>all of it</p></article></body>") == "all of it"


def test_all_containers_of_the_winning_path():
    page = "<body><div class='post'><section><p>" + WORDS + "</p></section><section><p>second</p></section><section><p>third</p></section></div><div><p>other</p></div></body>"
    assert html.main_text(page, "/div.post/section") == f"{WORDS.strip()}\nsecond\nthird"
    with_head = page.replace("<section>", "<h1>Head</h1><section>", 1)
    assert html.main_text(with_head, "/div.post/section") == f"Head\n{WORDS.strip()}\nsecond\nthird"


def test_heading_beside_a_large_inner_container():
    page = f"<body><div class='post'><h1>Head</h1><div class='entry-content'><p>{WORDS * 20}</p></div></div><div class='box'><p>box</p></div></body>"
    assert html.main_text(page) == f"Head\n{(WORDS * 20).strip()}"


def test_attributes_names_and_headers():
    story = "<p>" + "main text of the story " * 8 + "</p>"
    text = ("main text of the story " * 8).strip()
    assert html.main_text(f"<div><p title='the hidden gem'>{text}</p><p data-x=\"class='ad'\">more</p></div>") == text + "\nmore"
    assert html.main_text(f'<div class="content has-sidebar">{story}</div><div class="sidebar"><p>side side side</p></div>') == text
    for name in ('id="share-price"', 'class="social-science"', 'class="post-tags-none"'):
        assert html.main_text(f"<article><h2>H</h2><div {name}>{story}</div></article>") == "H\n" + text
    assert html.main_text(f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By me</p></header>{story}<footer>f</footer></article>") == "Title\n" + text
    assert html.main_text(f"<article><div hidden>no</div><div aria-hidden=true>no</div><div aria-hidden='false'>yes</div>{story}</article>") == "yes\n" + text


def test_deep_pages():
    import time
    import tracemalloc

    deep = 50_000
    page = "<body>" + "<div class='level'>" * deep + "<p>deep text</p>" + "</div>" * deep
    tracemalloc.start()
    began = time.time()
    assert html.main_text(page) == "deep text"
    assert tracemalloc.get_traced_memory()[1] < 200e6 and time.time() - began < 60
    tracemalloc.stop()
    began = time.time()
    many = "".join(f"<div><p>{i}</p>" for i in range(3000)) + "</span></p>" * 3000
    html.main_text(many)
    html.main_text("<span>" * 20_000 + "x" + "<div class='ad'><h1>" * 5000)
    assert time.time() - began < 60


BOILER = ["<nav><a href='/'>menu</a> {}</nav>", "<div class='ad'>{}</div>", "<aside>{}</aside>", "<footer>{}</footer>", "<div id='comments'><p>{}</p></div>", "<form>{}</form>", "<script>var x = '{}'</script>", "<!-- {} -->", "<div role='navigation'>{}</div>", "<p hidden>{}</p>"]


@pytest.mark.parametrize("seed", range(40))
def test_random_pages_against_their_making(seed):
    """Pages put together from known article blocks and known other parts, in nested containers."""
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8))) for _ in range(n))
    wanted = []

    def part() -> str:
        return rng.choice(BOILER).format(words(rng.randint(1, 6)))

    def block() -> str:
        text = words(rng.randint(5, 40))
        wanted.append(text)
        spaced = text.replace(" ", rng.choice([" ", "  ", "\n\t"]), 1)
        return rng.choice(["<p>{}</p>", "<p class='lead'>{}", "<ul><li>{}</ul>", "<h2>{}</h2>", "<p title=don't>{}</p>", "<p class=\"a\"\">{}</p>", "<div '>{}</div>", "<p a='1'b=/c/>{}", "<blockquote><p>{}</p></blockquote>", "<p><b>{}</b></p>", "<table><tr><td>{}</table>"]).format(spaced)

    def body(depth: int) -> str:
        out = ""
        for _ in range(rng.randint(2, 5)):
            kind = rng.random()
            if kind < 0.2:
                out += part()
            elif kind < 0.4 and depth < 3:
                out += f"<section>{body(depth + 1)}</section>"
            else:
                out += block()
        return out

    page = part() + part() + f"<article class='post-{seed}'>{body(0)}</article>" + part()
    assert html.main_text(f"<!DOCTYPE html><html><body>{page}</body></html>") == "\n".join(wanted)


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>one two</p>", "h", "p", "r")], "page_id long, url string, html string, host string, path string, row string")
    assert html.extract(pages).select("page_id", "host", "path", "row", "text").collect()[0] == (1, "h", "p", "r", "one two")
    assert html.extract(pages.withColumnsRenamed({"host": "page_host", "path": "page_path", "row": "page_html"})).count() == 1


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<p title=don't>First</p><p>Second it's</p>", ["First", "Second it's"]),
        ('<p class="a"">First</p><p class="b">Second plain words</p>', ["First", "Second plain words"]),
        ("<p a='1'b=\"2\"c>One</p><a href=/x/y>Two</a><p title=\"a > b\">Three</p><p =x y = z>Four</p>", ["One", "Two", "Three", "Four"]),
        ("<p class=\"never closed>One</p><p>Two</p>", ["One", "Two"]),
        ("<p '>One</p><p \">Two's</p>", ["One", "Two's"]),
        ("<p class = 'a b' title=\"it's\">One</p><p class=>Two", ["One", "Two"]),
    ],
)
def test_quotes_open_values_only_after_an_equals_sign(page, wanted):
    assert [text for _, text, _ in html.blocks(page)] == wanted


@pytest.mark.parametrize("page", ["<b>" * 50_000 + "<tr></tr>" * 50_000, "<li><dd>" * 50_000, "<p x='" * 50_000, "<b></i>" * 50_000, '<p x="' + "a" * 1_000_000, "<p x='1\" y=\"2'>a " * 20_000])
def test_time_grows_with_the_page(page):
    began = time.time()
    html.blocks(page)
    assert time.time() - began < 4
