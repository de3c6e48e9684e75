"""Inside a declared article, names that hold a boilerplate word do not delete text."""

from basaltql.llm import html_extract


def test_article_keeps_named_parts():
    page = """<article><h1>Title</h1><section id="discussion"><h2 id="side-effects">Side effects</h2><p class="legal">The law</p></section>
    <h2 id="ad-hoc-networks">Networks</h2><div id="form"><p>Form</p></div><p>With <math><mi>x</mi></math> and <object>a picture</object></p>
    <div class="ad">Buy</div><div class="box share">Share</div><div class="comments"><p>Nice</p></div><form>Sign</form></article>
    <div class="side-box">Side</div><div id="legal">Law</div>"""
    assert [b.text for b in html_extract.blocks(page) if not b.skip] == ["Title", "Side effects", "The law", "Networks", "Form", "With x and a picture"]
