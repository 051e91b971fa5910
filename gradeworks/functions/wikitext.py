"""Wiki markup to counts and plain text, as native column expressions.

Patterns avoid look-around and keep ``\\n`` as the only line end (flag ``d``); ``(?U)`` makes
white space Unicode-aware. Comments are cut out and the markup inside ``nowiki`` is masked before
templates, references and headings are read. Nested braces and links are removed innermost first,
as many times as the row's own nesting is deep.

Stretches of plain words stand as short marks while markup is read (:func:`marked`), so that the many patterns pass over
what is left only. No pattern starts, ends or looks into a stretch: it follows white space, has no character
of any markup, and the word after it stays in the text (the one look-ahead).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that state a grade, and words that mark a cleanup template.
ICON_TEMPLATES = ["featured article", "good article"]
LABEL_CATEGORIES = ["category:featured articles", "category:good articles"]
CLEANUP_KEYWORDS = ["cleanup", "citation needed", "clarify", "dubious", "disputed",
                    "original research", "unreferenced", "weasel", "vague", "update",
                    "expand section", "copyedit", "fact", "pov"]

LEAD_CHARS = 500
SPACES = " \t\n\r"

# Markup inside nowiki stands as private characters until the plain text is done.
MARKUP = "{}[]|='<>*#:;!"
MASK = "".join(chr(0xE000 + i) for i in range(len(MARKUP)))
ARGUMENT_OPEN = chr(0xE020)

# A stretch: at least eight words without markup, a single space after each, up to the last word before something else.
# The class names Latin characters only, which Java's engine looks up in one table; a range beyond takes ten times as long.
PLAIN = r"[^ \t\n\r\f\x0B{}\[\]|='<>*#:;!&]"
STRETCH = rf"(\s)((?:{PLAIN}+ (?={PLAIN})){{8,}}+)"
MARK = chr(0xE101)  # stands on both sides
PRIVATE = [b"\xee\x80", b"\xee\x84"]  # how MARK and the characters of MASK begin in UTF-8

# The patterns that decide what is counted.
TEMPLATE_OPEN = r"\{\{\s*([^|{}]+)"
ICON_BLOCK = r"(?i)\{\{\s*(?:template:)?(?:featured article|good article)\s*(?:\|[^{}]*)?\}\}"
GRADE_BLOCK = (r"(?i)\{\{\s*(?:featured (?:article|list)|good article|ga icon|fa icon)"
               r"\s*(?:\|[^}]*)?\}\}")
REF = r"(?is)<ref\b[^>]*?(?:/>|>(.*?)</ref>)"
HEADING2 = r"(?md)^==[^=]([^\n]*[^=])?==[ \t]*$"
HEADING3 = r"(?md)^===[^=]([^\n]*[^=])?===[ \t]*$"
LINK = r"\[\[([^\]|]+)"
MEDIA = r"(?i)^\s*(file|image):"
CATEGORY = r"(?i)^\s*category:"
EXTLINK = r"(?i)\[https?://[^\s\]]+"
TABLE = r"\{\|"
LIST_LINE = r"(?md)^[*#:;]+\s*\S"
DOI = r"(?i)\bdoi\s*="
ISBN = r"(?i)\bisbn(?:1[03])?\s*="
WORD = r"(?U)\S+"
SENTENCE = r"(?U)[.!?]+(?:\s+[A-Z]|\s*$)"

COMMENT = r"(?s)<!--.*?-->"
NOWIKI = r"(?i)</?nowiki\s*>"
EMPTY_NOWIKI = r"(?i)<nowiki\s*/>"
ARGUMENT = r"\{\{\{[^{}|]*(?:\|([^{}]*))?\}\}\}"
TEMPLATE = r"\{\{[^{}]*\}\}"
HIDDEN_LINK = r"(?i)\[\[\s*(?:file|image|category):[^\[\]]*\]\]"
SHOWN_LINK = r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]"
REF_BLOCK = r"(?is)<ref\b[^>]*?(?:/>|>.*?</ref>)"
LAST_STEPS = [
    (r"(?i)\[https?://[^\s\]]+\s*([^\]]*)\]", "$1"),
    (r"(?md)^=+[ \t]*([^=\n].*?)[ \t]*=+[ \t]*$", "$1"),
    (r"'{2,}", ""),
    (r"<[^<>]+>", ""),
    (r"\n{3,}", "\n\n"),
]

# Named entities that stand for one character, the ampersand last.
ENTITIES = [("&nbsp;", "\u00a0"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&quot;", '"'),
            ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def stretches(text: Column) -> Column:
    """Text in pieces; every second one is a stretch of plain words. Texts with private characters of their own are one piece."""
    pieces = F.split(F.regexp_replace(text, STRETCH, f"$1{MARK}$2{MARK}"), MARK)
    raw = text.cast("binary")
    own = F.contains(raw, F.lit(PRIVATE[0])) | F.contains(raw, F.lit(PRIVATE[1]))
    return F.when(own, F.array(text)).otherwise(pieces)


def marked(pieces: Column) -> Column:
    """The text of :func:`stretches` with the place of each stretch, between two marks, instead of its words."""
    def one(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.concat(F.lit(MARK), i.cast("string"), F.lit(MARK))).otherwise(x)
    return F.array_join(F.transform(pieces, one), "")


def unmarked(text: Column, pieces: Column) -> Column:
    """What is left of :func:`marked` text, with its words again."""
    def one(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.get(pieces, x.cast("int"))).otherwise(x)
    whole = F.array_join(F.transform(F.split(text, MARK), one), "")
    return F.when((F.size(pieces) > 1) & F.contains(text, F.lit(MARK)), whole).otherwise(text)


def visible(text: Column) -> Column:
    """Text without comments, the markup inside ``nowiki`` masked."""
    return masked(F.regexp_replace(text, COMMENT, ""))


def masked(bare: Column) -> Column:
    parts = F.split(F.regexp_replace(bare, EMPTY_NOWIKI, ""), NOWIKI)
    hidden = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.translate(x, MARKUP, MASK)).otherwise(x))
    return F.when(F.contains(F.lower(bare), F.lit("<nowiki")), F.array_join(hidden, "")).otherwise(bare)


def nesting(text: Column, opening: str, closing: str) -> Column:
    """How deep the pairs of marks are nested in a row, unmatched closing marks aside."""
    marks = _all(text, f"{opening}|{closing}", 0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(s: Column, mark: Column) -> Column:
        now = F.greatest(F.lit(0), s["now"] + F.when(mark.rlike(opening), 1).otherwise(-1))
        return F.struct(now.alias("now"), F.greatest(s["top"], now).alias("top"))

    return F.aggregate(marks, start, step, lambda s: s["top"])


def template_names(text: Column, pieces: Column | None = None) -> Column:
    """Normalised names of all templates, nested ones included; ``{{{arguments}}}`` are none."""
    text = F.replace(text, F.lit("{{{"), F.lit(ARGUMENT_OPEN))

    def norm(x: Column) -> Column:
        x = x if pieces is None else unmarked(x, pieces)
        return F.regexp_replace(F.lower(F.trim(x, F.lit(SPACES))), "^template:", "")
    return F.transform(_all(text, TEMPLATE_OPEN, 1), norm)


def keep_names(names: Column) -> Column:
    """Template names without the grade icons."""
    return F.filter(names, lambda x: ~x.isin(ICON_TEMPLATES))


def strip_icon_blocks(text: Column) -> Column:
    return F.regexp_replace(text, ICON_BLOCK, "")


def strip_grade_blocks(text: Column) -> Column:
    """Text without any grade template, icons and lists included."""
    return F.regexp_replace(text, GRADE_BLOCK, "")


def grade_block_offset(text: Column) -> Column:
    """0-based offset of the first grade template; null if there is none."""
    at = F.regexp_instr(text, F.lit(GRADE_BLOCK))
    return F.when(at > 0, at - 1)


def kept_category_count(categories: Column) -> Column:
    kept = F.filter(categories, lambda c: ~F.lower(F.trim(c, F.lit(SPACES))).isin(LABEL_CATEGORIES))
    return F.when(categories.isNull(), 0).otherwise(F.size(kept))


def ref_bodies(text: Column) -> Column:
    return _all(text, REF, 1)


def distinct_ref_count(refs: Column) -> Column:
    trimmed = F.transform(refs, lambda r: F.trim(r, F.lit(SPACES)))
    return F.size(F.array_distinct(F.filter(trimmed, lambda r: r != "")))


def link_targets(text: Column) -> Column:
    return _all(text, LINK, 1)


def media_count(targets: Column) -> Column:
    return F.size(F.filter(targets, lambda t: t.rlike(MEDIA)))


def wikilink_count(targets: Column) -> Column:
    return F.size(F.filter(targets, lambda t: ~t.rlike(MEDIA) & ~t.rlike(CATEGORY)))


def cleanup_count(names: Column) -> Column:
    def tagged(x: Column) -> Column:
        hit = F.contains(x, F.lit(CLEANUP_KEYWORDS[0]))
        for word in CLEANUP_KEYWORDS[1:]:
            hit = hit | F.contains(x, F.lit(word))
        return hit
    return F.size(F.filter(names, tagged))


def cite_count(names: Column) -> Column:
    return F.size(F.filter(names, lambda x: x.startswith("cite ") | (x == "citation")))


def has_infobox(names: Column) -> Column:
    return F.exists(names, lambda x: x.startswith("infobox"))


def plain_text(text: Column) -> Column:
    """Markup-free text of :func:`visible` text: references and templates go, an argument becomes its
    default, a link its label; then the fixed replacements, entities and a trim."""
    def inner_braces(t: Column, _: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, ARGUMENT, "$1"), TEMPLATE, "")

    def inner_links(t: Column, _: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, HIDDEN_LINK, ""), SHOWN_LINK, "$1")

    def passes(depth: Column) -> Column:
        return F.array_repeat(F.lit(0), depth)

    out = F.regexp_replace(text, REF_BLOCK, "")
    out = F.aggregate(passes(nesting(text, r"\{\{", r"\}\}")), out, inner_braces)
    out = F.aggregate(passes(nesting(text, r"\[\[", r"\]\]")), out, inner_links)
    for pattern, repl in LAST_STEPS:
        out = F.regexp_replace(out, pattern, repl)
    out = F.translate(out, MASK, MARKUP)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out, F.lit(SPACES))


def lead(text: Column, chars: int = LEAD_CHARS) -> Column:
    return F.substring(text, 1, chars)


def word_count(text: Column) -> Column:
    return _count(text, WORD)


def sentence_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), _count(text, SENTENCE)))


def head_tail(tokens: Column, max_len: int = 512, head: int = 128, special: int = 2) -> Column:
    """The token window: everything that fits, else the head and the tail of the list."""
    budget = max_len - special
    tail = budget - head
    window = F.concat(F.slice(tokens, 1, head), F.slice(tokens, -tail, tail))
    return F.when(F.size(tokens) > budget, window).otherwise(tokens)


def tokens(text: Column) -> Column:
    return _all(text, WORD, 0)


def parse_articles(df: DataFrame, text: str = "wikitext", categories: str = "categories") -> DataFrame:
    """Add the parsed fields. Shared pieces sit in their own projections, so each is computed
    once per row and columns nobody reads are pruned away."""
    pieces = F.col("_pieces")
    staged = (
        df.withColumn("_pieces", stretches(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_raw", marked(pieces))
        .withColumn("_seen", F.regexp_replace("_raw", COMMENT, ""))
        .withColumn("_seen", masked(F.col("_seen")))
        .withColumns({"_names": keep_names(template_names(F.col("_seen"), pieces)),
                      "_bare": strip_icon_blocks(F.col("_seen")),
                      "_targets": F.transform(link_targets(F.col("_raw")), lambda t: unmarked(t, pieces))})
        .withColumns({"_plain": plain_text(F.col("_bare")), "refs_raw": F.transform(
            F.transform(ref_bodies(F.col("_bare")), lambda r: F.translate(r, MASK, MARKUP)), lambda r: unmarked(r, pieces))})
        .withColumn("clean_text", unmarked(F.col("_plain"), pieces))
    )
    names, targets, body = F.col("_names"), F.col("_targets"), F.col("clean_text")
    return staged.withColumns({
        "lead_text": lead(body),
        "word_count": word_count(body),
        "sentence_count": sentence_count(body),
        "section_l2_n": _count(F.col("_bare"), HEADING2),
        "section_l3_n": _count(F.col("_bare"), HEADING3),
        "infobox": has_infobox(names),
        "images_n": media_count(targets),
        "tables_n": _count(F.col("_raw"), TABLE),
        "wikilinks_n": wikilink_count(targets),
        "extlinks_n": _count(F.col("_raw"), EXTLINK),
        "lists_n": _count(F.col("_raw"), LIST_LINE),
        "cleanup_tags_n": cleanup_count(names),
        "templates_n": F.size(names),
        "categories_n": kept_category_count(F.col(categories)),
        "cite_templates_n": cite_count(names),
        "ref_n": F.size("refs_raw"),
        "refs_distinct": distinct_ref_count(F.col("refs_raw")),
        "doi_n": _count(F.col("_raw"), DOI),
        "isbn_n": _count(F.col("_raw"), ISBN),
    }).drop("_pieces", "_raw", "_seen", "_names", "_bare", "_plain", "_targets")
