import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrid.functions import dates, markup, passages, standards, wikitext

BASE = "https://wiki.test"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("== Title == <!-- gone --> Words [[Page|shown]] <ref>note</ref> {{Box|x}} &amp; [https://a.test outside]", "Title Words shown & outside"),
        ("One {{a|{{b}}}} two {| class=x | cell |} three", "One two three"),
        ("[[Page]] ''it'' '''bold'''", "Page it bold"),
        ("A<REF name=q>x</REF>B<br/>C &lt; D __NOTOC__", "A B C < D"),
        ("[[File:x.png|thumb|caption]]text[[Category:y]]", "text"),
        (None, ""),
        ("{{never closed", "{{never closed"),
    ],
)
def test_plain_text(source, want):
    assert wikitext.plain_text(source) == want


def test_wiki_markdown_keeps_structure():
    source = "== Past ==\nSee [[Some page|this]] and [https://a.test that].<ref name=s>{{cite web|title=T|url=https://s.test|website=W|date=2020}}</ref> Again<ref name=s />\n\n* one\n** two\n# three\n\n{|\n|+ Cap\n! A !! B\n|-\n| 1 || 2\n|}\n\n{{Infobox town\n| name = X\n}}"
    text = wikitext.markdown(source, BASE)
    for want in ("## Past", f"[this]({BASE}/wiki/Some_page)", "[that](https://a.test)", "- one", "  - two", "1. three", "**Cap**", "| **A** | **B** |", "| 1 | 2 |", "| Infobox town | |", "| name | X |", "[^1]: [T](https://s.test). W. 2020"):
        assert want in text
    assert text.count("[^1]") == 3
    assert not any(mark in text for mark in ("{{", "[[", "<ref"))


def test_media_links_show_their_caption():
    assert wikitext.markdown("[[File:E.svg|thumb|20px|A drawing]]", BASE) == f"[Image: A drawing]({BASE}/wiki/File:E.svg)"
    assert wikitext.markdown("[[File:E.svg|thumb|[[Town]] in 2016]]", BASE) == f"[Image: Town in 2016]({BASE}/wiki/File:E.svg)"


def test_notes_of_an_excerpt():
    text, notes = wikitext.render("Lead.<ref name=a>one</ref>" + " more" * 50 + "<ref>two</ref>", BASE)
    assert [n["name"] for n in notes] == ["a", ""]
    assert [n["id"] for n in wikitext.referenced(text[:20], notes)] == [1]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="[]{}|<>ref/='! \nab*", max_size=80))
def test_wikitext_never_fails(source):
    wikitext.plain_text(source)
    wikitext.markdown(source, BASE)


def test_html_markdown():
    html = "<title>t</title><h1>Top</h1><p>Go <a href='next.html#x'>on</a> <b>now</b><p>two<ul><li>a<li>b</ul><table><tr><th>K<th>V</tr><tr><td>1<td>x|y</table><pre>a\n b</pre><script>no()</script>"
    text = markup.html_to_markdown(html, markup.archive_link("dir/page.html", "set", lambda p: p))
    assert text == "# Top\n\nGo [on](corpus-read://read?dataset=set&id=dir/next.html#x) **now**\n\ntwo\n\n- a\n- b\n\n| K | V |\n| --- | --- |\n| 1 | x\\|y |\n\n```\na\n b\n```"
    assert markup.html_to_text("<p>a<p>b&amp;c<style>x</style>") == "a b&c"
    assert markup.html_to_markdown(None) == ""


def test_legal_links():
    html = '<p><a href="https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:32002L0058">D</a> <a href="https://a.test/">o</a></p>'
    assert markup.html_to_markdown(html, markup.legal_link("law")) == "[D](corpus-read://read?dataset=law&id=32002L0058) [o](https://a.test/)"


TEXT = "Abstract\n\nAn early protocol.\n\n1. Introduction\n\nIt says a lot. See RFC 9110.\n\n1.1. Scope\n\nScope details.\n\n2. Conclusion\n\nThe end.\n"


def test_standards_markdown_and_sections():
    text = standards.markdown("1", "Host", TEXT, [{"type": "obsoleted_by", "target": "RFC 9110"}], "historic")
    assert "**Obsoleted by:** [RFC 9110](corpus-read://read?dataset=rfc&id=9110)" in text
    assert "See [RFC 9110](corpus-read://read?dataset=rfc&id=9110)." in text
    assert [(s["anchor"], s["level"]) for s in standards.sections(text)] == [("abstract", 2), ("1", 2), ("1.1", 3), ("2", 2)]
    part, found = standards.section(text, "1")
    assert found and "Scope details" in part and "The end" not in part
    assert standards.section(text, "9") == ("", False)


def test_snippet_covers_the_terms():
    text = "Alpha stands alone here. " + "Nothing of interest. " * 30 + "Beta met Alpha for a phone call on Gamma yesterday. " + "Trailing words. " * 30
    found = passages.window_snippet(text, "alpha beta phone gamma", 200)
    assert all(t in found for t in ("Alpha", "Beta", "phone", "Gamma")) and len(found) <= 210


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n!", max_size=300), st.integers(1, 50))
def test_pages_join_to_the_text(text, size):
    for end in (passages.readable_end, passages.line_end):
        assert "".join(p["content"] for p in passages.pages(text, size, end)) == text


def test_sections_of_markdown():
    assert passages.markdown_section("Lead\n\n## Here\n\nBody\n\n### Sub\n\nx\n\n## Next", "here") == ("## Here\n\nBody\n\n### Sub\n\nx", True)
    assert passages.markdown_section("Lead", "Missing") == ("Lead", False)
    assert passages.wikitext_section("a\n== B ==\nc\n=== D ===\ne\n== F ==", "B") == ("== B ==\nc\n=== D ===\ne", True)


def test_search_bounds():
    assert dates.search_bounds("2024-02") == ("2024-02-01 00:00:00", "2024-02-29 23:59:59.999999")
    assert dates.search_bounds("2023")[1].startswith("2023-12-31 23:59:59")
    assert dates.search_bounds("2024-05-06T01:00:00+01:00")[0] == "2024-05-06 00:00:00"
    with pytest.raises(ValueError):
        dates.search_bounds("soon")


def test_date_columns(spark):
    rows = spark.createDataFrame([("June 2022", "2023", "Feb", "31", ""), ("1999", "", "", "", "2001 Spring"), ("never", "x", "5", "2", "")], "c string, y string, m string, d string, f string")
    at, precision = dates.catalog_date(rows["c"])
    assert [tuple(r) for r in rows.select(at, precision).collect()] == [(datetime.datetime(2022, 6, 1), "month"), (datetime.datetime(1999, 1, 1), "year"), (None, "")]
    at, precision = dates.citation_date(rows["y"], rows["m"], rows["d"], rows["f"])
    assert [tuple(r) for r in rows.select(at, precision).collect()] == [(datetime.datetime(2023, 3, 3), "day"), (datetime.datetime(2001, 1, 1), "year"), (None, "")]
