from llm.common import CLASHING, collected
from pyspark.sql import functions as F

from barograph.llm.html import extract, main_text

LONG = "Words of an article that is long enough to count as content, " * 6


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><a href="/">Home</a> Site name</header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies. {LONG}</div><div class=ad>Buy now {LONG}</div><!-- note -->
    <div id="content"><h1>Title &amp; more</h1><p>{LONG}<p>Short.<br>Second&nbsp;line <b>bold</b>
    text</p><ul><li>one<li>two</ul><aside>Aside {LONG}</aside><form><input name=a>Search</form>
    <blockquote>Quoted &eacute;&#233;</blockquote></div>
    <div class="comments"><p>Reader: {LONG}</p></div><div class="sidebar">Links {LONG}</div><footer>&copy; me</footer></body>"""
    blocks = ["Title & more", " ".join(LONG.split()), "Short. Second line bold text", "one", "two", "Quoted éé"]
    assert main_text(page) == "\n\n".join(blocks)


def test_bare_pages():
    assert main_text(None) == "" and main_text("") == "" and main_text("<nav>a</nav><script>x</script>") == ""
    assert main_text("plain text  only") == "plain text only"
    assert main_text("<p>a<p>b</div></p><p>c") == "a\n\nb\n\nc"
    assert main_text("<article><p>Be.</p></article><footer>x</footer>") == "Be."
    assert main_text("<b>" * 3000 + "deep" + "</b>" * 3000) == "deep"


def test_every_page(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>x"), (3, "u", "<article>" + "<p>word word</p>" * 20_000), (3, "u", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(c).alias(c) for c in CLASHING])
    got = collected(extract(pages), "page_id", "url", "text", "n_chars")
    long = "\n\n".join(["word word"] * 20_000)
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "v", "x", 1), (3, "u", long, len(long)), (3, "u", "y", 1)]
    assert got == sorted(want, key=repr)
    assert extract(pages.limit(0)).collect() == []


def test_given_pages_are_the_article(spark):
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"</?b>|<br>", " ", inner))
        want = [" ".join(html.unescape(x).split()) for x in parts]
        assert main_text(r["html"]).split() == " ".join(want).split()
