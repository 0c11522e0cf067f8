"""Page text: what stays, what goes, and what the wrapper decides."""

from __future__ import annotations

import pandas as pd
import pytest

from statutory.llm import html

TEXT = "The committee heard the bill and its sponsors for the whole of the day. "


def page(body: str) -> str:
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def alone(body: str) -> str:
    return html.main_text(page(body), html.main_container([page(body)], set()))


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><p>One</p><figure><img src=x><figcaption>A caption</figcaption></figure><math><mi>x</mi>=1</math><object>plan</object></article>", "One\nA caption\nx=1plan"),
        ("<div class='no-sidebar with-banner comments-open'><article><h1>Head</h1><p>One</p></article></div>", "Head\nOne"),
        ("<article><header><h1>Head</h1></header><p>One</p><footer>by me</footer></article><header>Site</header>", "Head\nOne"),
        ("<article><p>One</p><p class=legal>By law</p><div class=form-of-words>said</div></article>", "One\nBy law\nsaid"),
        ("<main><p>One</p><section class=comments><article><p>me too</p></article></section><div class=ads>Buy</div></main>", "One"),
        ("<aside><article><p>teaser</p></article></aside><article><p>One two three</p></article>", "One two three"),
        ("<div class=sidebar><p>all there is</p></div>", "all there is"),
        ("<table><tr><td>a</td><td>b &lt;c&gt;</td></tr></table><form><input><button>go</button></form>", "a\nb <c>"),
        ("<article><p>P</p><h2 class=section-header>X</h2><p>P</p></article>", "P\nX\nP"),
        ("<article><p>P</p><table class=share-price><tr><td>X</td></tr></table><p>P</p></article>", "P\nX\nP"),
        ("<article><p>P</p><div class=social-policy>X</div><p>P</p></article>", "P\nX\nP"),
        ("<article><p>P</p><section id=related-work>X</section><p>P</p></article>", "P\nX\nP"),
        ("<article><p>P</p><section id=discussion>X</section><p>P</p></article>", "P\nX\nP"),
        ("<article><p>P</p><div class=menu>X</div><p>P</p></article>", "P\nX\nP"),
        ("<article><p>P</p><p class=legal-notice>X</p><blockquote>Q<footer>by Ada</footer></blockquote></article>", "P\nX\nQ\nby Ada"),
        ("<article><p>P</p><div class=menu><a href=x>X</a> <a href=y>Y</a></div><p>P</p></article>", "P\nP"),
        ("<article><p>P</p><div class='related-posts box'><ul><li><a href=x>X</a></li></ul></div><div id=user-comments-list>no</div><div class=cookie_notice>ok</div></article>", "P"),
        ("", ""),
        ("<nav>menu</nav>", ""),
    ],
)
def test_one_page(body, want):
    assert alone(body) == want


def host(pages):
    found = html._infer_host(pd.DataFrame({"host": "h", "html": pages})).iloc[0]
    return [html.main_text(p, found.container, frozenset(found.template)) for p in pages], found


def test_unmarked_template_goes():
    """A box and its heading that every page has alike go; a heading over changing text stays."""
    box = "<div class=b7><h3>Our mission</h3><p>We read bills so that you need not.</p></div>"
    pages = [page(f"<div class=c><h2>Summary</h2><p>{TEXT * 3}{i}</p>{box}<p>More of {i} {TEXT}</p></div><div class=x>same everywhere</div>") for i in range(5)]
    texts, found = host(pages)
    for i, text in enumerate(texts):
        assert text == f"Summary\n{(TEXT * 3)}{i}\nMore of {i} {TEXT}".strip()
    assert "Our mission" in str(found.template) and "#text" in found.wrapper


def test_near_copies_keep_their_article():
    """Pages that differ in a word only are mostly template, which then proves nothing."""
    pages = [page(f"<article><p>{TEXT}</p><p>{TEXT}again</p><p>{i}</p></article>") for i in range(5)]
    texts, _ = host(pages)
    assert texts == [f"{TEXT.strip()}\n{TEXT}again\n{i}" for i in range(5)]


def test_template_goes_whatever_its_share_of_the_page():
    """Short articles beside a longer box that all pages have alike: the box goes from every page, the shortest too."""
    box = f"<div class=b7><h3>Our mission</h3><p>{TEXT * 2}</p></div>"
    own = [TEXT.replace("bill", f"bill{i}").replace("day", f"day{i}") * (1 + i % 2) for i in range(6)]
    texts, _ = host([page(f"<div class=c><p>{x}</p>{box}</div>") for x in own])
    assert texts == [x.strip() for x in own]


def test_two_pages_are_no_template():
    pages = [page(f"<article><p>{TEXT * 4}{i}</p><p>Signed alike</p></article>") for i in range(2)]
    assert all("Signed alike" in t for t in host(pages)[0])


def test_long_pages_are_read_to_their_end():
    pages = [page("<div class=c>" + "".join(f"<p>{i} {k} {TEXT}</p>" for k in range(2500)) + "</div><footer>f</footer>") for i in range(4)]
    texts, found = host(pages)
    assert "+" in found.wrapper
    assert all(t.count("\n") == 2499 and t.endswith(f"{i} 2499 {TEXT}".strip()) for i, t in enumerate(texts))


def test_repeated_and_optional_groups():
    pages = [page(f"<ul>{'<li>x</li>' * (i + 1)}</ul>" + (f"<blockquote>q{i}</blockquote>" if i % 2 else "")) for i in range(4)]
    wrapper = str(html.infer(pages))
    assert "<li>+" in wrapper and "<blockquote>?" in wrapper


def test_rules_reach_the_rows_either_way(spark, monkeypatch):
    made = [(i, f"http://h{i % 3}/", page(f"<div class=c><p>{TEXT * 3}{i}</p><div class=b><h3>Note</h3>Signed alike</div></div><div class=x>same</div>")) for i in range(15)] + [(99, "http://long/", page(f"<article>{TEXT}</article>"))]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    held = sorted(map(tuple, html.extract_pages(pages).collect()))
    monkeypatch.setattr(html, "BROADCAST_CHARS", 0)
    assert sorted(map(tuple, html.extract_pages(pages).collect())) == held
    assert held[0][2] == f"{TEXT * 3}0"


def test_rows(spark):
    """Nulls, repeated rows, clashing columns, a very long page and an empty table."""
    rows = [(1, None, page("<p>a")), (1, None, page("<p>a")), (None, "http://x/", None), (2, "http://x/", ""), (3, "http://y/", page(f"<article>{'<p>word</p>' * 60_000}</article>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "known", "container", "template", "text", "wrapper", "_n"):
        pages = pages.withColumn(c, html.F.lit("clash"))
    got = sorted(((r.page_id or 0, r.text) for r in html.page_report(pages).collect()))
    assert got == [(0, ""), (1, "a"), (1, "a"), (2, ""), (3, "\n".join(["word"] * 60_000))]
    assert html.page_report(pages.limit(0)).count() == 0


# --- wrappers of all pages


def site(i: int, box: str = "", more: str = "", url: str = "http://one/") -> tuple[int, str, str]:
    own = " ".join(f"{w}{i}" for w in TEXT.split())
    return i, url, page(f"<div class=c><h1>T{i}</h1><p>{own}</p>{box}{more}</div>")


BOX = "<div class=b7>Read alike</div>"


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}


def test_what_some_pages_share_is_no_template_whichever_they_are(spark):
    """Twelve of forty pages share a text, those of the least hash, which eight sampled ones would take for template."""
    made = spark.createDataFrame([(*site(i), site(i, BOX)[2]) for i in range(120)], "page_id long, url string, html string, boxed string")
    least = {r.page_id for r in made.orderBy(html.F.xxhash64("boxed")).limit(12).collect()}
    others = [r.page_id for r in made.orderBy(html.F.xxhash64("html").desc()).collect() if r.page_id not in least][:28]
    found = texts_of(spark, [site(i, BOX if i in least else "") for i in [*least, *others]])
    assert {i for i, text in found.items() if "Read alike" in text} == least


def test_a_few_other_pages_do_not_keep_the_template(spark):
    rows = [site(i, BOX) for i in range(60)] + [(100, "http://one/", "<p>error"), (101, "http://one/", page("<h1>Gone</h1><table><tr><td>x</td></tr></table>")), site(102)]
    found = texts_of(spark, rows)
    assert not any("Read alike" in text for text in found.values())
    assert found[100] == "error" and found[101] == "Gone\nx" and all(found[i].startswith(f"T{i}\nThe{i} ") for i in range(60))


def test_pages_of_any_length_count(spark):
    """Pages over 200,000 characters and over 1,500 symbols that do not repeat."""
    def body(i):
        return "".join(f"<{a}><{b}>{i} {k} {TEXT * 4}</{b}></{a}>" for k, (a, b) in enumerate(zip(["div", "section", "p"] * 240, ["h2", "pre", "ul", "dl", "h3"] * 144, strict=True)))

    rows = [site(i, more=body(i) + BOX) for i in range(4)]
    assert all(len(r[2]) > 200_000 and len(html.Wrapper(html.stream(r[2])).squeezed().symbols) > 1500 for r in rows)
    found = texts_of(spark, rows)
    assert all("Read alike" not in t and t.count("\n") == 721 for t in found.values())


def test_many_copies_of_a_page_prove_no_template(spark):
    rows = [(i, "http://one/", page(f"<div class=c><h1>Head</h1><div>{TEXT * 3}</div><p>{i}</p></div>")) for i in range(30)] + [site(100), site(101)]
    found = texts_of(spark, rows)
    assert all(found[i] == f"Head\n{(TEXT * 3).strip()}\n{i}" for i in range(30))


@pytest.mark.parametrize("held", [8_000_000, 0])
def test_rounds_give_what_all_pages_in_memory_give(spark, monkeypatch, held):
    """Shapes folded two at once, in many small lots, broadcast or joined: the container and template of one fold in memory."""
    for name, value in {"FOLD_SHAPES": 2, "BROADCAST_CHARS": held}.items():
        monkeypatch.setattr(html, name, value)
    mores = ["", "<table><tr><td>a</td></tr></table>", "<ul><li>b</li></ul>", "<blockquote>q</blockquote>", "<h2>x</h2><pre>y</pre>", "<div class=z><h4>w</h4></div>"]
    rows = [site(i, BOX, mores[i % 6] + mores[i % 5], f"http://h{i % 3}/") for i in range(90)] + [site(i, url="http://h4/") for i in range(200, 203)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.host: (r.container, r.template) for r in html.wrappers(table).collect()}
    frame = table.select(html.host_of("url").alias("host"), "html").toPandas()
    want = {h: html._infer_host(f).iloc[0] for h, f in frame.groupby("host")}
    assert got == {h: (w.container, w.template) for h, w in want.items()}
    assert len(got["h0"][1]) == 1 and got["h0"][0] == "div class=c" and got["h4"][1] == []


def test_wrappers_do_not_grow_with_the_pages():
    """Pages that have nothing in common but their frame: the wrapper stays as long as some pages, and keeps the frame's text."""
    tags = ["div", "pre", "ul", "dl", "h2", "h3", "table", "section"]
    pages = [page("".join(f"<{tags[(i * 7 + k * k) % 8]} class=k{chr(97 + i)}>{i}.{k}</{tags[(i * 7 + k * k) % 8]}>" for k in range(200)) + BOX) for i in range(24)]
    wrapper = html.infer(pages)
    assert len(wrapper.symbols) <= 2 * max(len(html.page_wrapper(p).symbols) for p in pages)
    assert "Read alike" in wrapper.candidates() and "*" in wrapper.symbols
