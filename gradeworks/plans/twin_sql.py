"""Shared common table expressions of the SQL twins."""

from __future__ import annotations

from gradeworks.plans import bindings as b
from gradeworks.schemas import FEATURES, GRADES


# The markup rules once more, written for this engine: what a page shows, names and counts.
NL = "' || chr(10) || '"
MASKED = "'{}[]|=''<>*#:;!', '" + "".join(chr(57344 + i) for i in range(14)) + "'"
UNMASKED = "'" + "".join(chr(57344 + i) for i in range(14)) + "', '{}[]|=''<>*#:;!'"
SEEN = f"""array_to_string(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(wikitext, '(?s)<!--.*?-->', '', 'g'),
    '(?i)<nowiki\\s*/>', '', 'g'), '(?i)</?nowiki\\s*>'), lambda x, i: CASE WHEN i % 2 = 0 THEN translate(x, {MASKED}) ELSE x END), '')"""


def rounds(col: str, marks: str, body: str) -> str:
    """``body`` of ``t`` as often as ``col`` holds ``marks``, from the inside out."""
    turns = f"list_transform(range(len(regexp_extract_all(bare, '{marks}'))), lambda i: '')"
    return f"list_reduce(list_prepend({col}, {turns}), lambda t, turn: {body})"


def count_of(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, '{pattern}'))"


def plain_text() -> str:
    text = r"regexp_replace(bare, '(?is)<ref\b[^>]*?(?:/>|>.*?</ref>)', '', 'g')"
    text = rounds(text, r"\{\{", r"regexp_replace(regexp_replace(t, '\{\{\{[^{}|]*(?:\|([^{}]*))?\}\}\}', '\1', 'g'), '\{\{[^{}]*\}\}', '', 'g')")
    text = rounds(text, r"\[\[", r"regexp_replace(regexp_replace(t, '(?i)\[\[\s*(?:file|image|category):[^\[\]]*\]\]', '', 'g'), '\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]', '\1', 'g')")
    for find, put in ((r"(?i)\[https?://[^\s\]]+\s*([^\]]*)\]", r"\1"), (r"(?m)^=+[ \t]*([^=\n].*?)[ \t]*=+[ \t]*$", r"\1"),
                      ("''{2,}", ""), ("<[^<>]+>", ""), (r"\n{3,}", NL + NL)):
        text = f"regexp_replace({text}, '{find}', '{put}', 'g')"
    text = f"translate({text}, {UNMASKED})"
    for name, char in (("nbsp", "\u00a0"), ("ndash", "\u2013"), ("mdash", "\u2014"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return f"trim({text}, {TRIM})"


TRIM = "' ' || chr(9) || chr(10) || chr(13)"
GRADE_LIST = "[" + ", ".join(f"'{g}'" for g in GRADES) + "]"
ICONS = "('featured article', 'good article')"
LABEL_CATS = "('category:featured articles', 'category:good articles')"
CLEANUP = r"""regexp_matches(x, 'cleanup|citation needed|clarify|dubious|disputed|original research|unreferenced|weasel|vague|update|expand section|copyedit|fact|pov')"""

CTES: dict[str, str] = {}
CTES["revisions"] = f"""SELECT user_id AS page_id, event_id AS rev_id, {b.EVENT_TIME} AS ts, {b.EDITOR} AS editor,
    event_type = 'view' AS anon, event_type = 'error' AS reverted FROM events"""
CTES["newest"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts DESC, rev_id DESC) AS rn
    FROM revisions) WHERE rn <= {b.CAP}"""
CTES["history"] = f"""SELECT page_id, count(*) AS edits, count(DISTINCT editor) AS editors,
    count(*) FILTER (WHERE anon) AS anon_n,
    count(*) FILTER (WHERE NOT anon AND regexp_matches(editor, '(?i)bot\\b')) AS bot_n,
    count(*) FILTER (WHERE reverted) AS reverted_n,
    count(*) FILTER (WHERE ts >= TIMESTAMP '{b.AS_OF}' - INTERVAL {b.RECENT_DAYS} DAY) AS edits_90d,
    min(ts) AS created FROM newest GROUP BY page_id"""
CTES["pageviews"] = f"SELECT user_id AS page_id, CAST({b.EVENT_TIME} AS DATE) AS day, count(*) AS views FROM events GROUP BY ALL"
CTES["views"] = f"""SELECT p.page_id, coalesce(avg(v.views), 0) AS pageviews_90d_mean
    FROM (SELECT DISTINCT user_id AS page_id FROM events) p
    LEFT JOIN pageviews v ON v.page_id = p.page_id AND v.day BETWEEN CAST(TIMESTAMP '{b.AS_OF}' AS DATE) - 90
        AND CAST(TIMESTAMP '{b.AS_OF}' AS DATE) - 1 GROUP BY p.page_id"""
CTES["articles"] = f"""SELECT doc_id AS pageid, {b.TITLE} AS title, {b.RANK} AS grade_rank,
    {GRADE_LIST}[{b.RANK} + 1] AS label, doc_id * 7 + 1 AS revid, {b.WIKITEXT} AS wikitext, doc_id % (SELECT max(user_id) + 1 FROM events) AS page_id,
    CASE WHEN doc_id % 10 = 0 THEN ['Category:Topic ' || (doc_id % 13), 'Category:Featured articles']
        ELSE ['Category:Topic ' || (doc_id % 13)] END AS categories
    FROM documents LEFT JOIN labels USING (doc_id)"""
CTES["records"] = """SELECT a.*, strlen(a.wikitext) AS bytes, 1 AS n_projects, 0 AS n_disagree,
    CASE WHEN pageid % 41 <> 0 THEN strftime(DATE '2015-01-01' + CAST(pageid % 3000 AS INT), '%Y-%m-%dT00:00:00Z') END AS created,
    CASE WHEN pageid % 17 = 0 THEN 'unknown' ELSE strftime(DATE '2024-01-30' - CAST(pageid % 400 AS INT), '%Y-%m-%dT00:00:00Z') END AS last_edit,
    '2024-01-31T00:00:00Z' AS fetch_ts,
    coalesce(h.edits, 0) AS edits, coalesce(h.editors, 0) AS editors, coalesce(h.anon_n, 0) AS anon_n,
    coalesce(h.bot_n, 0) AS bot_n, coalesce(h.reverted_n, 0) AS reverted_n, coalesce(h.edits_90d, 0) AS edits_90d,
    coalesce(v.pageviews_90d_mean, 0) AS pageviews_90d_mean
    FROM articles a LEFT JOIN history h USING (page_id) LEFT JOIN views v USING (page_id)"""
CTES["seen"] = f"SELECT *, {SEEN} AS seen FROM records"
CTES["staged"] = f"""SELECT *, list_filter(all_names, lambda x: x NOT IN {ICONS}) AS names,
    regexp_replace(seen, '(?i)\\{{\\{{\\s*(?:template:)?(?:featured|good) article\\s*(?:\\|[^{{}}]*)?\\}}\\}}', '', 'g') AS bare,
    regexp_extract_all(wikitext, '\\[\\[([^\\]|]+)', 1) AS targets FROM (
    SELECT *, list_transform(regexp_extract_all(replace(seen, '{{{{{{', chr(57376)), '\\{{\\{{\\s*([^|{{}}]+)', 1),
        lambda x: regexp_replace(lower(trim(x, {TRIM})), '^template:', '')) AS all_names FROM seen)"""
CTES["plain"] = f"""SELECT *, {plain_text()} AS clean_text,
    list_transform(regexp_extract_all(bare, '(?is)<ref\\b[^>]*?(?:/>|>(.*?)</ref>)', 1), lambda x: translate(coalesce(x, ''), {UNMASKED})) AS refs_raw FROM staged"""
CTES["interim"] = f"""SELECT pageid, title, label, grade_rank, bytes, revid, n_projects, n_disagree, created, last_edit,
    fetch_ts, edits, editors, anon_n, bot_n, reverted_n, edits_90d, pageviews_90d_mean, clean_text,
    substring(clean_text, 1, 500) AS lead_text, {count_of('clean_text', r'[^\s\p{Z}]+')} AS word_count,
    CASE WHEN clean_text = '' THEN 0 ELSE greatest(1, {count_of('clean_text', r'[.!?]+(?:[\s\p{Z}]+[A-Z]|[\s\p{Z}]*$)')}) END AS sentence_count,
    {count_of('bare', r'(?m)^==[^=]([^\n]*[^=])?==[ \t]*$')} AS section_l2_n, {count_of('bare', r'(?m)^===[^=]([^\n]*[^=])?===[ \t]*$')} AS section_l3_n,
    len(list_filter(names, lambda x: starts_with(x, 'infobox'))) > 0 AS infobox,
    len(list_filter(targets, lambda x: regexp_matches(x, '(?i)^\\s*(file|image):'))) AS images_n,
    {count_of('wikitext', r'\{\|')} AS tables_n,
    len(list_filter(targets, lambda x: NOT regexp_matches(x, '(?i)^\\s*(file|image|category):'))) AS wikilinks_n,
    {count_of('wikitext', r'(?i)\[https?://[^\s\]]+')} AS extlinks_n, {count_of('wikitext', r'(?m)^[*#:;]+\s*\S')} AS lists_n,
    len(list_filter(names, lambda x: {CLEANUP})) AS cleanup_tags_n, len(names) AS templates_n,
    len(list_filter(categories, lambda x: lower(x) NOT IN {LABEL_CATS})) AS categories_n,
    len(list_filter(names, lambda x: starts_with(x, 'cite ') OR x = 'citation')) AS cite_templates_n,
    refs_raw, len(refs_raw) AS ref_n,
    len(list_distinct(list_filter(list_transform(refs_raw, lambda x: trim(x, {TRIM})), lambda x: x <> ''))) AS refs_distinct,
    {count_of('wikitext', r'(?i)\bdoi\s*=')} AS doi_n, {count_of('wikitext', r'(?i)\bisbn(?:1[03])?\s*=')} AS isbn_n FROM plain"""


def _days(a: str, c: str) -> str:
    return f"(epoch(TRY_CAST({a} AS TIMESTAMP)) - epoch(TRY_CAST({c} AS TIMESTAMP))) / 86400.0"


FEATURE_SQL = {
    "words": "word_count", "sentences": "sentence_count", "sections_l2": "section_l2_n",
    "sections_l3": "section_l3_n", "infobox": "CAST(infobox AS INT)", "images": "images_n",
    "tables": "tables_n", "lists": "lists_n", "wikilinks": "wikilinks_n", "extlinks": "extlinks_n",
    "categories": "categories_n", "templates": "templates_n", "cleanup_tags": "cleanup_tags_n",
    "lead_length": "length(coalesce(lead_text, ''))",
    "refs_per_1k_words": "CAST(ref_n AS DOUBLE) / greatest(word_count, 1) * 1000",
    "cite_template_mix": "least(CAST(cite_templates_n AS DOUBLE) / greatest(ref_n, 1), CAST(1 AS DOUBLE))",
    "edits_per_editor": "CAST(edits AS DOUBLE) / greatest(editors, 1)",
    "anon_share": "CAST(anon_n AS DOUBLE) / greatest(edits, 1)",
    "bot_share": "CAST(bot_n AS DOUBLE) / greatest(edits, 1)",
    "age_days": _days("fetch_ts", "created"), "days_since_edit": _days("fetch_ts", "last_edit"),
    "top_editor_share": "CAST(NULL AS DOUBLE)", "views_90d_mean": "pageviews_90d_mean",
    "views_90d_log": "ln(1 + pageviews_90d_mean)",
}
CTES["features"] = ("SELECT pageid, label, grade_rank, "
                    + ", ".join(f"{FEATURE_SQL.get(f, f)} AS {f}" for f in FEATURES) + " FROM interim")
CTES["dated"] = "SELECT f.*, i.created FROM features f LEFT JOIN interim i USING (pageid)"
CTES["splits"] = """SELECT * EXCLUDE (h, rn, n, hr), CASE WHEN rn <= floor(n * 0.70::DOUBLE) THEN 'train'
    WHEN rn <= floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split,
    hr <= greatest(1, floor(n * 0.10::DOUBLE)) AS temporal_holdout FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, pageid) AS rn, count(*) OVER (PARTITION BY label) AS n,
        row_number() OVER (PARTITION BY label ORDER BY try_cast(created AS TIMESTAMP) DESC NULLS FIRST, pageid) AS hr
    FROM (SELECT *, substring(md5('42:' || pageid), 1, 8) AS h FROM dated))"""
CTES["long"] = ("SELECT pageid, label, grade_rank, feature, value FROM (SELECT pageid, label, grade_rank, "
                + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
                + " FROM features) UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(FEATURES) + "))")
CTES["logits"] = """SELECT vec_id AS pageid, CAST(label % 6 AS INT) AS y, vec_id % 10 = 0 AS temporal_holdout, config,
    list_transform(e, lambda v: CAST(v AS DOUBLE)) AS logits FROM (
    SELECT *, 'first' AS config, embedding[1:6] AS e FROM embeddings
    UNION ALL SELECT *, 'second' AS config, embedding[7:12] AS e FROM embeddings)"""
CTES["weights"] = "SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits))) AS w FROM logits"
CTES["probs"] = "SELECT * EXCLUDE (w), list_transform(w, lambda v: v / list_sum(w)) AS p FROM weights"
CTES["predictions"] = """SELECT *, list_position(p, list_max(p)) - 1 AS pred,
    0*p[1] + 1*p[2] + 2*p[3] + 3*p[4] + 4*p[5] + 5*p[6] AS expected FROM probs"""
CTES["one"] = """SELECT *, abs(0-y)*p[1] + abs(1-y)*p[2] + abs(2-y)*p[3] + abs(3-y)*p[4] + abs(4-y)*p[5] + abs(5-y)*p[6] AS d
    FROM predictions WHERE config = 'first'"""
CTES["importance"] = """SELECT label AS seed, 'f' || (i - 1) AS feature, avg(abs(CAST(embedding[i] AS DOUBLE))) AS importance
    FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL"""
CTES["candidates"] = """SELECT 'k' || label AS kind, CASE WHEN label < 2 THEN 'rung0' WHEN label < 7 THEN 'rung1' ELSE 'rung2' END AS rung,
    round(avg(abs(CAST(embedding[1] AS DOUBLE))), 6) AS val_macro_f1, round(avg(abs(CAST(embedding[2] AS DOUBLE))), 6) AS wall_s
    FROM embeddings GROUP BY label"""
CTES["members"] = """SELECT 'B-Class ' || p_brand || ' articles' || CASE WHEN p_size % 9 = 0 THEN ' of Low-importance' ELSE '' END AS category,
    'Talk:' || p_name AS title, p_partkey AS member_id, p_size % 2 AS namespace FROM part"""
CTES["assessments"] = f"SELECT o_custkey AS page_id, o_orderkey % 7 AS project, {b.CLASS} AS class FROM orders"
CTES["rated"] = f"SELECT page_id, class, list_position({GRADE_LIST}, class) - 1 AS r FROM assessments WHERE list_contains({GRADE_LIST}, class)"
CTES["resolved"] = f"""SELECT page_id, {GRADE_LIST}[max(r) + 1] AS label, count(*) AS n_projects,
    count(*) - count(*) FILTER (WHERE r = best) AS n_disagree
    FROM (SELECT *, max(r) OVER (PARTITION BY page_id) AS best FROM rated) GROUP BY page_id"""
CTES["scored"] = """SELECT f.pageid, o.y, o.d, f.* EXCLUDE (pageid) FROM (SELECT *, pageid % (SELECT max(vec_id) + 1 FROM embeddings) AS vec FROM features) f
    JOIN one o ON o.pageid = f.vec"""

NEEDS = {
    "newest": ["revisions"], "history": ["newest"], "views": ["pageviews"],
    "records": ["articles", "history", "views"], "seen": ["records"], "staged": ["seen"], "plain": ["staged"],
    "interim": ["plain"], "features": ["interim"], "dated": ["features", "interim"], "splits": ["dated"],
    "long": ["features"], "weights": ["logits"], "probs": ["weights"], "predictions": ["probs"],
    "one": ["predictions"], "rated": ["assessments"], "resolved": ["rated"], "scored": ["one", "features"],
}


def twin(select: str, *ctes: str) -> str:
    """``select`` behind the common table expressions it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for c in ctes:
        visit(c)
    if not order:
        return select
    # materialised: a deep chain is otherwise inlined once per reference
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" + select
