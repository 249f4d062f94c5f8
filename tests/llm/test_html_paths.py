"""The article by tag-path ratios: what the ratios decide, and what the page's elements do."""

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

from docspark.llm import html_text

SF = "/root/testdata/sf0.001"
LONG = "This is a sentence of the article, with a comma and more words. "


class Plain(HTMLParser):
    """The texts of the first <article>, cut at its paragraphs and titles: another reading of simple pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.done, self.parts = False, False, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif self.inside and tag in ("p", "h1", "h2", "ul", "li", "div"):
            self.parts.append("")
        elif self.inside and tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside, self.done = False, True
        elif self.inside and tag in ("p", "h1", "h2", "ul", "li", "div"):
            self.parts.append("")

    def handle_data(self, data):
        if self.inside and not self.done:
            self.parts[-1] += data


def article(page):
    p = Plain()
    p.feed(page)
    p.close()
    return "\n\n".join(x for x in (" ".join(part.split()) for part in p.parts) if x)


def test_pages_against_another_reading(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_text.op1_html_text(spark, SF).collect()}
    assert len(rows) == len(got)
    same = [got[r["page_id"]] == article(re.sub(r"<[^>]*\Z", "", r["html"] or "")) for r in rows]
    assert np.mean(same) == 1.0


def test_the_ratios_select(spark, monkeypatch):
    """With the choice inverted or made at random nearly every page comes out otherwise."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    right, choose = [html_text.main_text(p) for p in pages], html_text.content_paths
    rng = np.random.Generator(np.random.PCG64(1))
    for other, least in ((lambda b: ~choose(b), 0.99), (lambda b: rng.random(len(b)) < 0.5, 0.7)):
        monkeypatch.setattr(html_text, "content_paths", other)
        assert np.mean([html_text.main_text(p) != t for p, t in zip(pages, right, strict=True)]) >= least


def test_paths_by_length_and_punctuation():
    blocks, _ = html_text.blocks_of(f"<body><ul>{'<li>Home</li>' * 8}</ul><div><p>{LONG * 4}</p><p>Short.</p><p>{LONG}</p></div><div><span>ad</span></div></body>")
    chosen = html_text.content_paths(blocks)
    assert [b.text[:5] for b, ok in zip(blocks, chosen, strict=True) if ok] == [LONG[:5], "Short", LONG[:5]]


def test_unnamed_parts_go():
    menu = "<div><ul>" + "<li><a href=/>Somewhere else</a></li>" * 9 + "</ul></div>"
    body = f"<h2>A section</h2><p>{LONG * 3}</p><p>Of.</p><ul><li>an item</li><li>another</li></ul><p>{LONG}</p>"
    want = f"A section\n\n{(LONG * 3).strip()}\n\nOf.\n\nan item\n\nanother\n\n{LONG.strip()}"
    said = "<p>Great post, thanks for it, really.</p>"
    pages = {
        "comments beside the article": f"<body>{menu}<article>{body}</article><div class='x1'>{said}</div></body>",
        "one beside main": f"<body><main>{body}</main><section>{said}{said}</section>{menu}</body>",
        "rows of comments": f"<body>{menu}<div class='t'>{body}</div><div class='k'>" + "".join(f"<div class='c7'><div>Reader {i}</div>{said}</div>" for i in range(4)) + "</div></body>",
        "rows within the article": f"<article>{body}<ol>" + "".join(f"<li class='z'><p>reader{i}</p>{said}</li>" for i in range(3)) + "</ol></article>",
    }
    for name, page in pages.items():
        assert html_text.main_text(page) == want, name


def test_sections_of_an_article_stay():
    rows = "".join(f"<section class='s'><h3>Part {i}</h3><p>{LONG}</p></section>" for i in range(4))
    text = html_text.main_text(f"<article><h1>Title</h1><p>{LONG * 2}</p>{rows}<blockquote><p>Well said.</p></blockquote><p>The end, at last.</p></article>")
    assert text.count("Part ") == 4 and text.startswith("Title") and "Well said." in text and text.endswith("The end, at last.")
    two = html_text.main_text(f"<body><article><p>{LONG * 2}</p></article><article><p>{LONG}</p></article></body>")
    assert two.count("This is") == 3
    poem = html_text.main_text("<article><p>no marks here at all</p><p>nor in this line</p></article>")
    assert poem == "no marks here at all\n\nnor in this line"


def test_only_other_things():
    assert html_text.main_text("<body><nav><a href=/>Home</a></nav><footer>All rights, reserved. For ever.</footer></body>") == ""
    # The footer has the better ratios; the text is still the page's.
    assert html_text.main_text("<body><p>plain words</p><footer>All, rights. Reserved! For, ever; and ever, again.</footer></body>") == "plain words"


def test_very_long_page(spark):
    page = f"<body><nav>{'<a href=/>x</a>' * 2000}</nav><article>{f'<p>{LONG * 3}</p>' * 20_000}</article></body>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (1, page)], "page_id bigint, html string").withColumn("n_chars", F.lit("clash"))
    got = sorted(tuple(r) for r in html_text.extract(rows).select("page_id", "n_chars").collect())
    n = 20_000 * len((LONG * 3).strip()) + 19_999 * 2
    assert got == [(1, n), (1, n), (2, 0), (3, 0)]
