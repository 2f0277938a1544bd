"""Rendered pages against expected layouts, and all visible words of random trees."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from outlay.llm import html as H
from outlay.llm import queries


def show(source):
    return H.visible_text(source)


def test_blocks_inlines_and_blanks():
    assert show("a  <b>b</b>\n c<br>d<div>e</div>f") == "a b c\nd\ne\nf"
    assert show("<p>one<p>two</p>three<h2>four</h2>") == "one\n\ntwo\n\nthree\n\nfour"
    assert show("<p>a</p>\n\n<p></p> <p>b</p>") == "a\n\nb"
    assert show("x<pre>  a\n    b\n\nc</pre>y") == "x\n\n  a\n    b\n\nc\n\ny"
    assert show("<blockquote>q<br>r</blockquote>s") == "    q\n    r\n\ns"
    assert show("in<i>ter</i>nal") == "internal"


def test_lists():
    assert show("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "- a\n- b\n\n  - c\n- d"
    assert show("<ol start=9><li>a<li>b<br>bb</ol>") == "9. a\n10. b\n    bb"
    assert show("<dl><dt>t<dd>d<dt>u<dd>e</dl>") == "t\n    d\nu\n    e"


def test_tables_are_aligned():
    assert show("<table><tr><th>name<th>n<tr><td>ab<td>10<tr><td>abcdef<td>7</table>") == (
        "name    n\nab      10\nabcdef  7"
    )
    assert show("<table><caption>C</caption><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>") == (
        "C\nwide     x\na     b  c"
    )
    assert show("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>") == "日本  x\nabc   y"
    assert show("a<table><tr><td><table><tr><td>in</table><td>out</table>b") == "a\n\nin  out\n\nb"


def test_visibility():
    assert show("<head><title>t</title><style>p{}</style></head><body>b") == "b"
    assert show("a<script>var t='</p>';x()</script>b<!-- c -->d<noscript>n</noscript>") == "abd"
    assert show("a<span hidden>b</span><i style='color:red; DISPLAY : none'>c</i>d") == "ad"
    assert show("<p style='visibility:hidden'>a</p><p aria-hidden=true>b</p>c") == "b\n\nc"
    assert show("<select><option>x</select><textarea>y</textarea>z<input value=v><img alt=pic>") == "x y zvpic"
    assert show("<select><option disabled>x<option>y<option>z</select><textarea>\na  b\n c</textarea>") == "y a  b\n c"
    assert show("<details>a<summary>s</summary>b<summary>t</summary></details><details open>c<summary>u</summary></details>") == "s\nc\nu"
    assert show("<title>t</title><p>x") == "x"


def test_broken_markup():
    assert show("a < b && c &lt;d&gt; &eacute;&#233;") == "a < b && c <d> éé"
    assert show("<b>a</i></b></div>c</p>d") == "ac\n\nd"
    assert show("<div><p>a</div>b") == "a\n\nb"
    assert show("x<!-- open") == "x"
    assert show("x<div a='1>2' b=\">\">y") == "x\ny"
    assert show("<td>lone<p>x") == "lone\n\nx"
    assert show("<script>never closed") == ""
    assert show(None) == show("") == show("   ") == ""


def test_quotes_open_strings_only_after_equals():
    assert show("<p title=it's>one two three</p><p>four isn't five</p>") == "one two three\n\nfour isn't five"
    assert show('<a href="x"">one</a> "two" <b>three</b>') == 'one "two" three'
    assert show("<p don't>a</p><p 'b>c' d</p>") == "a\n\nc' d"
    assert show("<i title = 'a>b'class=\"c>d\">e</i> <i a==f'>g</i> <i h= >j</i>") == "e g j"
    assert show("a<i title=\"b'c\" hidden>d</i><img alt=e'f>") == "ae'f"
    assert show("<img alt=\"it's\"><img / =x' alt='&quot;y'>") == "it's\"y"
    assert show("a<img alt='b") == "a"
    assert H.attributes_of(" a=x/y?b=c b='d'e f =\ng h=it's =i") == {
        "a": "x/y?b=c", "b": "d", "e": "", "f": "g", "h": "it's", "=i": "",
    }
    long = "<p" + " a=b'" * 100000
    assert show(long) == "" and show(long + ">x") == "x"


def test_what_browsers_show_is_kept():
    assert show("<table><tr>stray<td>cell</table>") == "stray\ncell"
    assert show("<table><tbody><tr><td>a</td> b <td>c</tr>d</table>e") == "b\nd\na  c\n\ne"
    assert show("<math><mi>a</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> b") == "a= 1 2 b"
    assert show("<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math>") == "x"
    assert show("a<svg>no<title>t</title><g><text>b<tspan>c</tspan></text><text>d</text></g></svg>e") == "a bc d e"
    assert show("<svg><style/><defs><text>no</text></defs><path d=x/><text>b</text></svg>c") == "b c"
    assert show("<svg><foreignObject><p>a</p></foreignObject></svg><svg><g><p>b") == "a\n\nb"
    assert show("a<dialog open>b</dialog><dialog>c</dialog>d") == "a\nb\nd"
    assert show("<select><option>a<option selected>b<option>c</select>d") == "b d"
    assert show("<select multiple><option>a<option>b</select><select size=2><option>c</select>d") == "a b c d"
    assert show("<select><option>a<input value=b>c") == "a bc"


def test_odd_numbers_in_attributes():
    assert show('<table><tr><td colspan="²">a<td>b<tr><td colspan=-3>c<td colspan=x>d</table>') == "a  b\nc  d"
    assert show(f"<table><tr><td colspan={'9' * 5000}>a<td>b</table>").split() == ["a", "b"]
    assert show(f"<ol start=-2><li>a</ol><ol start='³'><li>b</ol><ol start={'1' * 5000}><li>c</ol>").split()[:4] == ["-2.", "a", "1.", "b"]


def test_nothing_is_too_deep():
    assert show("<table><tr><td>" * 5000 + "x y").split() == ["x", "y"]
    assert show("<ul><li>" * 1000 + "x").split()[-1] == "x"
    assert show("<svg>" + "<g>" * 40000 + "<text>in</text>").split() == ["in"]
    assert show("<b style='visibility:hidden'>" * 40000 + "<i style='visibility:visible'>x").split() == ["x"]
    assert show("<div>" * 200_000 + "x" + "</div>" * 200_000 + "y").split() == ["x", "y"]


def shown_words(source):
    """All words but those of tags: what markup without invisible parts shows, in any order."""
    return sorted(re.sub(r"<[^>]*>", " ", source).split())


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.sampled_from(["w ", "x y ", "\n", "</p>", "</td>", "</table>", "</div>", "</li>", "</b>", "</zz>"]),
            st.tuples(
                st.sampled_from("p div ul li table tr td th tbody b h1 blockquote dl dd dt section pre article".split()),
                st.sampled_from(["", " colspan=²", " colspan='7x'", " start=-9", " class=\"a'b\"", " a=b'c", " ='", " style='color:red'"]),
            ).map(lambda t: f"<{t[0]}{t[1]}>"),
        ),
        max_size=60,
    )
)
def test_random_markup_loses_no_word(parts):
    source = "".join(parts).replace(" ='>", " =q>")
    got = re.sub(r"(?m)^\s*(?:- )+", " ", show(source))
    assert sorted(w for w in got.split() if w != "-") == shown_words(source)


def test_visibility_is_not_display():
    assert show("<p style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</p>d") == "b\n\nd"
    assert show("<div style='display:none'>a<b style='visibility:visible'>b</b></div>c") == "c"
    assert show("<i style='visibility:hidden;visibility:visible'>a</i><i style='display:none;display:inline'>b</i>") == "ab"
    assert show("<div style='VISIBILITY:Collapse'><img alt=a><i style=visibility:inherit>b</i></div>c") == "c"


def test_heads_end_at_what_does_not_belong_there():
    assert show("<head><title>t</title>Hello <b>world</b>") == "Hello world"
    assert show("<head> <title>t</title><b>Hello</b> world</head>!") == "Hello world!"
    assert show("<head><meta charset=x><style>s</style> <noscript><p>n</p></noscript></head>a") == "a"
    assert show("<html><head><script>x</script><img alt=a>b") == "ab"


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000 + "y"
    assert show(deep).split() == ["x", "y"]
    assert len(show("<p>a b</p>" * 20000).split()) == 40000
    assert show("<" * 20000 + " a") == "<" * 20000 + " a"


TREE = st.recursive(
    st.sampled_from(["w1", "w2 w3", " ", "\n"]),
    lambda inner: st.tuples(
        st.sampled_from("p div ul li table tr td b h1 blockquote section a dd".split()),
        st.lists(inner, max_size=4),
    ),
    max_leaves=25,
)


def source_of(tree):
    if isinstance(tree, str):
        return tree
    return f"<{tree[0]}>{' '.join(map(source_of, tree[1]))}</{tree[0]}>"


@settings(max_examples=200, deadline=None)
@given(TREE)
def test_no_visible_word_is_lost(tree):
    source = source_of(tree)
    words = re.sub(r"<[^>]*>", " ", source).split()
    got = re.sub(r"(?m)^\s*- ", "", show(source))
    assert sorted(w for w in got.split() if w != "-") == sorted(words)


def test_query_and_columns(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in queries.op8_html_extraction(spark, small).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == show(r["html"])
    odd = spark.createDataFrame([(1, None, "x"), (1, "<p>a", None)], "page_id int, html string, text string")
    assert sorted(r["text"] for r in H.extracted(odd).collect()) == ["", "a"]
    assert H.extracted(odd.limit(0)).collect() == []
