"""X1-X13 on literal HTML (pure Python helper of the extraction job)."""

import json
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from siteaudit.functions import html_extract
from siteaudit.functions.html_extract import extract_fields

BASE = "https://www.site.test/dir/page?q=1"


def fx(html, url=BASE):
    return extract_fields(html, url)


def test_title_single_string_only():
    assert fx("<title>  Hello &amp; bye </title>")["title"] == "Hello & bye"
    assert fx("<title>a<b>x</b></title>")["title"] == ""
    assert fx("<title><b>only</b></title>")["title"] == "only"
    assert fx("<p>no title</p>")["title"] == ""


def test_meta_description_first_and_case_sensitive():
    h = '<meta name="Description" content="no"><meta name="description" content=" yes "><meta name="description" content="later">'
    assert fx(h)["meta_description"] == "yes"
    assert fx('<meta name="description" content="">')["meta_description"] == ""


def test_h1_texts_joined_without_separator_and_empty_counts():
    r = fx("<h1> A <b> B </b></h1><h1></h1><h2>Q? </h2>")
    assert r["h1_texts"] == ["AB", ""]
    assert r["h2_texts"] == ["Q?"]


def test_canonical_first_link_only():
    assert fx('<link rel="stylesheet canonical" href=" /x "><link rel="canonical" href="/y">')["canonical"] == "/x"
    assert fx('<link rel="canonical"><link rel="canonical" href="/y">')["canonical"] == ""


def test_og_last_wins_and_nonempty():
    r = fx('<meta property="og:title" content="a"><meta property="og:title" content="b">'
           '<meta property="og:image" content="">')
    assert r["og"] == {"og:title": "b"}


def test_jsonld_list_flattened_and_parse_error():
    r = fx('<script type="application/ld+json">[{"@type":"A"},{"@type":"B"}]</script>'
           '<script type="application/ld+json">{bad</script><script type="application/ld+json"></script>')
    blocks = [json.loads(b) for b in r["schema_blocks"]]
    assert [b.get("@type") for b in blocks[:2]] == ["A", "B"]
    assert blocks[2]["__parse_error"] is True and blocks[2]["_raw_snippet"] == "{bad"
    assert r["schema_raw_count"] == 3


def test_images_content_and_missing_alt():
    r = fx('<img alt="a"><img><img alt="  "><img role="presentation"><img aria-hidden="TRUE">')
    assert (r["image_alt_total"], r["image_alt_missing"]) == (3, 2)


def test_first_paragraph_after_first_h1():
    r = fx("<p>before</p><h1>T</h1><div><p> one <b>two</b> </p></div><p>three</p>")
    assert r["first_paragraph"] == "one two"


def test_internal_links_rules():
    h = ('<a href="#top">x</a><a href="mailto:a@b">m</a><a href="  ">e</a>'
         '<a href="/a#frag">A</a><a href="other">B  C</a><a href="https://site.test/z">Z</a>'
         '<a href="https://www.site.test:8080/p">port</a><a href="https://else.test/q">ext</a>'
         '<a href="javascript:void(0)">j</a><a href="/a">dup</a>')
    r = fx(h)
    got = [(l["target"], l["anchor"]) for l in r["internal_links"]]
    assert got == [("https://www.site.test/a", "A"), ("https://www.site.test/dir/other", "B  C"),
                   ("https://site.test/z", "Z"), ("https://www.site.test/a", "dup")]
    assert [l["pos"] for l in r["internal_links"]] == [0, 1, 2, 3]


def test_anchor_cut_to_200():
    r = fx('<a href="/x">' + "w" * 250 + "</a>")
    assert len(r["internal_links"][0]["anchor"]) == 200


def test_script_text_does_not_end_paragraph():
    r = fx('<script>var t="</p>";</script><h1>T</h1><p>kept</p>')
    assert r["first_paragraph"] == "kept"


def test_unparsed_when_no_html():
    r = extract_fields(None, BASE)
    assert r["title"] == "" and r["internal_links"] == [] and r["schema_raw_count"] == 0


def test_only_complete_references_are_decoded():
    r = fx('<title>A &amp; B &amp</title><script type="application/ld+json">{"name": "x & y"}</script>')
    assert r["title"] == "A & B &amp"
    assert json.loads(r["schema_blocks"][0])["name"] == "x & y"


def links(html):
    return [(l["target"].rsplit("/", 1)[-1], l["anchor"]) for l in fx(html)["internal_links"]]


def test_unclosed_links_end_at_the_next_link_and_cell():
    assert links('<a href="/1">one<a href="/2">two</a>') == [("1", "one"), ("2", "two")]
    assert links('<table><tr><td><a href="/1">one<td>two<tr><td><a href="/2">three</table>four') == [("1", "one"), ("2", "three")]
    assert links('<a href="/1">one<table><tr><td>two</table>') == [("1", "one")]
    assert links('<div><a href="/1">one</div>two') == [("1", "one")]
    assert links('<a href="/1"><div>one</a>two</div>three') == [("1", "one two three")]       # </a> can't end the div
    assert links('<table><tr><td><a href="/1">one</table>') == [("1", "one")]


def test_unclosed_headings_end_at_headings_paragraphs_items_and_tables():
    r = fx("<h1>One<h2>Two<h3>Three</h3><p>text<h2>Four<table><tr><td>cell</table><ul><li><h2>Five<li>six</ul>")
    assert (r["h1_texts"], r["h2_texts"]) == (["One"], ["Two", "Four", "Five"])
    assert fx("<h1>Title<p>para</p>rest")["h1_texts"] == ["Title"]
    assert fx("<h1>Title<p>para</p>rest")["first_paragraph"] == "para"


def test_unclosed_cells_rows_terms_and_options():
    r = fx("<table><tr><td><h2>A</h2><td><h2>B<p>b<tr><th><h2>C</h2></table><dl><dt>t<dd><h2>D</h2><dt>u</dl>"
           "<select><option>1<option>2</select><h2>E</h2>")
    assert r["h2_texts"] == ["A", "B", "C", "D", "E"]
    b = html_extract.parse_html("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>t<dd>d<dt>u</dl><select><option>1<option>2</select>")
    spans = [(n.tag, b.strings[n.first:n.last]) for n in b.elements if n.tag in ("tr", "td", "dt", "dd", "option")]
    assert spans == [("tr", ["a", "b"]), ("td", ["a"]), ("td", ["b"]), ("tr", ["c"]), ("td", ["c"]), ("dt", ["t"]), ("dd", ["d"]),
                     ("dt", ["u"]), ("option", ["1"]), ("option", ["2"])]


def test_end_tags_stay_inside_their_cell_and_unknown_ones_do_nothing():
    assert fx("<h1>T</h1><div><table><tr><td></div><p>in cell</p></td></tr></table></div>")["first_paragraph"] == "in cell"
    assert links('<a href="/1">a</b></section>b</a>c') == [("1", "a b")]


def test_strings_join_across_entities_and_stop_at_comments():
    assert fx("<title>a < b &amp; c</title>")["title"] == "a < b & c"
    assert fx("<title>a<!-- x -->b</title>")["title"] == ""
    assert fx("<h1>a < b</h1>")["h1_texts"] == ["a < b"]
    assert fx("<h1>k<ruby>w<rt>r</rt></ruby><template>t<i>u</i></template><style>s</style></h1>")["h1_texts"] == ["kw"]


def test_many_open_elements_are_read_in_one_pass():
    began = time.time()
    r = fx('<a href="/x">link ' * 10_000)
    assert len(r["internal_links"]) == 10_000 and r["internal_links"][0]["anchor"] == "link"
    r = fx('<a href="/x"><b>link ' * 10_000)
    assert len(r["internal_links"]) == 10_000 and len(r["internal_links"][0]["anchor"]) == 200
    fx("<div><span><p>" * 10_000 + "</i></div></em>" * 10_000)
    assert time.time() - began < 3


@given(st.lists(st.sampled_from(["<a href='/1'>", "</a>", "<h1>", "</h1>", "<h2>", "<p>", "</p>", "<td>", "<tr>", "<table>", "</table>", "<b>",
                                 "</b>", "<div>", "</div>", "<dt>", "<dd>", "<option>", "<br>", "<script>", "</script>", "x", "&amp;", "<"]),
                max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_soup_gives_nested_or_disjoint_elements(parts):
    b = html_extract.parse_html("".join(parts))
    open_ends = []
    for n in b.elements:
        assert n.first <= n.last <= len(b.strings)
        while open_ends and open_ends[-1] <= n.first:
            open_ends.pop()
        assert not open_ends or n.last <= open_ends[-1] or n.first == n.last
        open_ends.append(n.last)
