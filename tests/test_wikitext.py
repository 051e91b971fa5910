"""Text fields on pages with known counts."""

import pytest
from pyspark.sql import functions as F

from gradeworks.functions import wikitext as w

PAGE = """{{good article}}{{Infobox tool|handle={{wood|ash {{year|1900}}}}|edge={{{edge|sharp}}}}}
An '''adze''' cuts [[timber|[[wood|green [[log]]s]]]]. Does it? It does{{Clarify}}!
<!-- {{ghost}} <ref>ghost</ref>
== Ghost ==
[[Image:Ghost.png]] -->
== Use ==
=== By hand ===
# first
#; second
: third
{| border=1
|-
| a cell
|}
{| border=2
|}
[[Image:Adze.svg|left|An [[adze]]]] [[file:Old adze.png]] [http://tools.example/adze the catalogue] [https://tools.example]
Steel<ref>{{Cite journal|title=Steel|doi=10.9/s}}</ref> and iron<ref name=i>ISBN=1, isbn13 = 2</ref><ref name=i/><ref>ISBN=1, isbn13 = 2</ref>.
Write <nowiki>{{tool}} == no == <ref>no</ref> [[x|y]]</nowiki> so. Colour {{{colour|grey {{tint}}}}}.
[[Category:Hand tools]]
[[Category:Good articles]]
"""


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame(
        [(1, PAGE, ["Category:Hand tools", "Category:Good articles"]), (2, "", []), (3, None, None)],
        "pageid int, wikitext string, categories array<string>")
    return {r["pageid"]: r for r in w.parse_articles(df).collect()}


@pytest.mark.parametrize("field,value", [
    ("section_l2_n", 1), ("section_l3_n", 1), ("images_n", 3), ("extlinks_n", 2), ("lists_n", 3), ("tables_n", 2),
    ("templates_n", 6), ("cleanup_tags_n", 1), ("doi_n", 1), ("isbn_n", 4), ("cite_templates_n", 1), ("categories_n", 1),
    ("infobox", True), ("ref_n", 4), ("refs_distinct", 2)])
def test_counts(parsed, field, value):
    assert parsed[1][field] == value


def test_plain_text(parsed):
    text = parsed[1]["clean_text"]
    assert text.startswith("An adze cuts green logs. Does it? It does!\n")
    for gone in ("host", "good article", "Infobox", "left", "Old adze", "Category", "Cite", "===", "grey {{", "tint"):
        assert gone not in text
    assert "\nUse\nBy hand\n" in text and " the catalogue " in text and "Steel and iron.\n" in text
    assert "Write {{tool}} == no == <ref>no</ref> [[x|y]] so. Colour grey ." in text
    assert parsed[1]["lead_text"] == text[:500]


@pytest.mark.parametrize("text,plain", [
    ("a {{1|{{2|{{3|{{4|{{5|{{6|x}}}}}}}}}}}} b", "a  b"), ("[[A|[[B|[[C|[[D|e]]]]]]]]", "e"), ("{{{1|arg}}}", "arg"), ("{{{1}}}x", "x"),
    ("<nowiki>{{t}}</nowiki>", "{{t}}"), ("x<nowiki/>y", "xy"), ("{{open", "{{open"), ("close}} {{a}}", "close}}"), ("<!-- {{ -->ok", "ok")])
def test_markup_at_any_depth(spark, text, plain):
    assert _value(spark, lambda t: w.plain_text(w.visible(t)), text) == plain


@pytest.mark.parametrize("text,names", [
    ("{{{1|arg}}}", []), ("<!-- {{a}} -->{{b}}", ["b"]), ("<nowiki>{{a}}</nowiki>", []), ("{{a|{{b|{{c}}}}}}", ["a", "b", "c"]),
    ("{{{1|{{d}}}}}", ["d"])])
def test_what_is_a_template(spark, text, names):
    assert _value(spark, lambda t: w.template_names(w.visible(t)), text) == names


def test_empty_pages(parsed):
    for i in (2, 3):
        assert parsed[i]["word_count"] == 0 and parsed[i]["sentence_count"] == 0
        assert parsed[i]["ref_n"] == 0 and parsed[i]["clean_text"] == ""


def _value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text,n", [("", 0), ("  ", 0), ("a b c", 3), ("é è", 2), ("one\n\ntwo", 2)])
def test_words(spark, text, n):
    assert _value(spark, w.word_count, text) == n


@pytest.mark.parametrize("text,n", [("", 0), ("no end", 1), ("One. Two! Three?", 3), ("e.g. small", 1),
                                    ("End.  \n", 1), ("A. B", 1), ("Wait... What?", 2)])
def test_sentences(spark, text, n):
    assert _value(spark, w.sentence_count, text) == n


def test_entities(spark):
    assert _value(spark, w.plain_text, "10&nbsp;km &amp;lt; A&ndash;B") == "10\u00a0km &lt; A\u2013B"
    assert _value(spark, lambda t: w.word_count(w.plain_text(t)), "10&nbsp;km") == 2


def test_template_names(spark):
    got = _value(spark, w.template_names, "{{ Template:Foo\n|a={{BAR}}}} {{baz|x}}")
    assert got == ["foo", "bar", "baz"]


def test_line_ends_are_newlines_only(spark):
    assert _value(spark, lambda t: F.regexp_count(t, F.lit(w.HEADING2)), "a ==b== c") == 0
    assert _value(spark, lambda t: F.regexp_count(t, F.lit(w.HEADING2)), "a\n==b==\nc") == 1


def test_grade_blocks(spark):
    assert _value(spark, w.strip_grade_blocks, "x{{ Good Article|a=b}}y{{GA icon}}z{{featured list}}") == "xyz"
    assert _value(spark, w.grade_block_offset, "ab{{FA icon}}") == 2
    assert _value(spark, w.grade_block_offset, "none") is None


@pytest.mark.parametrize("n,size", [(510, 510), (511, 510), (5, 5)])
def test_head_tail(spark, n, size):
    got = spark.range(1).select(w.head_tail(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string")))).first()[0]
    assert len(got) == size and got[0] == "1" and got[-1] == str(n)
    if n > 510:
        assert got[127] == "128" and got[128] == str(n - 381)


PROSE = "one two three four five six seven eight nine ten "
MARKS = chr(0xE101) + "1" + chr(0xE101)


@pytest.mark.parametrize("text", [
    PROSE * 3, f" {PROSE}doi = 5 {PROSE}isbn13=", f"{{{{ {PROSE}fact |{PROSE}}}}} {PROSE}", f"[[ {PROSE}|{PROSE} {PROSE}x]] [http://x.y {PROSE}end] ",
    f"== {PROSE}x ==\n* {PROSE}\n<ref> {PROSE}{PROSE}b</ref><ref>{PROSE}</ref>", f"a {PROSE}{MARKS} {PROSE}b", f"a {PROSE}{chr(0xE000)} b",
    f"<nowiki> {PROSE}{{{{a}}}} {PROSE}</nowiki> {PROSE}", f"\t{PROSE * 2}\u00a0 {PROSE} ", f"<!-- {PROSE * 2}--> {PROSE * 2}&amp; {PROSE}",
    f"{{{{a| {PROSE}b}}}} c {PROSE}d"])
def test_stretches_change_nothing(spark, text):
    """Fields of a text whose plain words are set aside, against the plain functions on the whole text."""
    df = spark.createDataFrame([(text, ["x"])], "wikitext string, categories array<string>")
    t = F.col("wikitext")
    seen = w.strip_icon_blocks(w.visible(t))
    names, links = w.keep_names(w.template_names(w.visible(t))), w.link_targets(t)
    whole = df.select(w.plain_text(seen), F.size(names), w.cleanup_count(names), w.media_count(links), w.wikilink_count(links), F.transform(w.ref_bodies(
        seen), lambda r: F.translate(r, w.MASK, w.MARKUP)), F.regexp_count(t, F.lit(w.DOI)), F.regexp_count(t, F.lit(w.ISBN)), F.regexp_count(t, F.lit(w.LIST_LINE)))
    parsed = w.parse_articles(df).select("clean_text", "templates_n", "cleanup_tags_n", "images_n", "wikilinks_n", "refs_raw", "doi_n", "isbn_n", "lists_n")
    assert tuple(parsed.first()) == tuple(whole.first())


def test_patterns_pass_over_short_marks(spark):
    assert len(_value(spark, lambda t: w.marked(w.stretches(t)), "x " + PROSE * 1000 + "== y ==")) < 40


def test_no_text_is_joined_for_features(spark, sf, monkeypatch):
    """Rows that meet labels, history and views are numbers and dates only."""
    from gradeworks.plans import bindings as b
    met = []
    with_history = b._with_history
    monkeypatch.setattr(b, "_with_history", lambda s, f, rows: met.append(rows) or with_history(s, f, rows))
    monkeypatch.setattr(b, "staged", lambda s, f, name, build: build())
    b.features(spark, sf)
    assert not {"wikitext", "clean_text", "lead_text", "refs_raw"} & set(met[0].columns)
