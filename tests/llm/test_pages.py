import pytest

from tableferry.llm import pages

ARTICLE = (
    "<p>The first paragraph, with &amp; signs, is long enough to be read; it has two sentences. Here is one.</p>"
    "<p>The second   paragraph,\n over two lines, has <b>bold</b> and <a href='x'>linked</a> words, too. And an end.</p>"
)
TEXT = (
    "The first paragraph, with & signs, is long enough to be read; it has two sentences. Here is one. "
    "The second paragraph, over two lines, has bold and linked words, too. And an end."
)
CASES = {
    "article": f"<body><nav><ul><li><a href=a>Home</a></li></ul></nav><article><h1>Title</h1>{ARTICLE}</article><footer>&copy; x</footer></body>",
    "div": f"<body><div id='menu'>Home, news, and more.</div><div class='content'><h1>Title</h1>{ARTICLE}</div>"
    "<div class='comments'><p>A reader says: this is, well, long. And it goes on, and on.</p></div></body>",
    "unclosed": f"<html><body><header>Site name</header><main><h1>Title</h1>{ARTICLE.replace('</p>', '')}</main><aside>See also</aside>",
    "scripts": f"<script>if (a < b) document.write('<p>no</p>')</script><style>p {{}}</style><!-- <p>no</p> --><article><h1>Title</h1>{ARTICLE}"
    "<form><p>Your mail, please.</p><button>Send</button></form><div class='ad banner'>Buy, now!</div></article>",
}


@pytest.mark.parametrize("name", CASES)
def test_article(name):
    assert pages.main_text(CASES[name]) == "Title " + TEXT


def test_parts_that_only_sound_like_asides_stay():
    page = f"<body class='has-sidebar'><div class='layout no-ads'><div class='entry'><div class='entry-header'><h1>Title</h1></div>{ARTICLE}"
    page += "<table><tr><td>A cell</td></tr></table><blockquote>Said once, and again.</blockquote></div></div>"
    page += "<div class='site-header'>Name, of the site.</div><div role='alert'>Notice, please.</div><section id=readerComments><p>Well, no.</p></section>"
    page += "<div class='cookieBanner'>We use cookies, many of them. More, too.</div><div hidden>Not shown, at all.</div>"
    assert pages.main_text(page) == f"Title {TEXT} A cell Said once, and again."


def test_short_parts_of_the_article_stay():
    page = f"<article><header><h1>Title</h1></header>{ARTICLE}<h2>More</h2><ul><li>one</li><li>two</li></ul><p>Yes.</p></article>"
    assert pages.main_text(page) == f"Title {TEXT} More one two Yes."


def test_odd_pages(spark):
    odd = {None: "", "": "", "plain text": "plain text", "<p>a<br>b": "a b", "<b>": "", "a < b &lt; c &nope;": "a < b < c &nope;"}
    for page, text in odd.items():
        assert pages.main_text(page) == text
    long = "<article>" + "<p>Some words, and more of them. </p>" * 20_000 + "</article>"
    assert len(pages.main_text(long)) == 20_000 * 30 - 1
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x &#228;</p>")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "0 as text", "0 as n_chars")
    got = sorted(map(str, map(tuple, pages.extract(df).collect())))
    assert got == sorted(map(str, [(1, "u", "", 0), (1, "u", "", 0), (None, None, "x ä", 3)]))
    assert pages.extract(df.limit(0)).count() == 0


def test_paths_by_ratio():
    found = pages.blocks("<body><div><p>" + "long text, with marks. " * 9 + "</p></div><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>")
    assert pages.content_paths(found) == {("body", "div", "p")}


def test_class_words_name_a_part_only_at_their_end():
    page = f"<article><h1>Title</h1>{ARTICLE}<section class='social-history'><p>Formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, here.</p></section>"
    page += "<div class='share-links'><p>Share it, now.</p></div><div class='related_posts'><p>Read on, too.</p></div></article>"
    assert pages.main_text(page) == f"Title {TEXT} Formula x=1 holds, here."
