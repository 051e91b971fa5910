import re
from collections import Counter

from gradeworks.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, c in Counter(windows).items() if c > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_measures_match_brute_force(edge, tables):
    for docs in (edge, tables["documents"]):
        want = sorted((str(r["doc_id"]), *measures(r["text"])) for r in docs.collect())
        got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                      r["base_failed"]) for r in quality_rules.judge(docs).collect())
        assert got == want


def test_lines_and_documents_that_fail(spark):
    good = "A sentence of some length stands here and it ends well.\n" * 1 + "\n".join(
        f"Line {i} goes on about number {i * 7} and about something else." for i in range(6))
    rows = [("good", good), ("menu", good + "\nHome | News | Sport | Weather"), ("license", "All rights reserved.\n" + good),
            ("shout", "\n".join(f"LOUD LINE {i} OF MANY WORDS!" for i in range(9))), ("cut", good + " and then it breaks off wi"),
            ("noise", "\n".join(f"word*** other&&& third%%% number{i}### end." for i in range(9))),
            ("bars", "\n".join(f"one{i} | two | three | four{i} | five" for i in range(9))), ("none", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    kept = {r["doc_id"]: (r["kept"], r["n_removed_lines"]) for r in quality_rules.judge(docs).collect()}
    assert kept["good"] == (True, 0) and kept["cut"] == (True, 0)
    assert kept["menu"] == (True, 1) and kept["license"] == (True, 1)
    assert not any(kept[k][0] for k in ("shout", "noise", "bars", "none"))
    clean = {r["doc_id"]: r["text"] for r in quality_rules.clean(docs).collect()}
    assert clean == {k: good if k != "cut" else dict(rows)["cut"] for k in ("good", "cut", "menu", "license")}


def test_clean_keeps_all_columns(edge, nothing):
    done = quality_rules.clean(edge)
    assert done.columns == edge.columns
    rows = done.collect()
    assert {r["doc_id"] for r in rows} >= {6, 7, None, 8, 9, 10, 18, -3} and sum(r["doc_id"] == 7 for r in rows) == 2
    assert all(r["n_chars"] == len(r["text"]) and (r["row"], r["key"], r["n_words"]) == ("r", "k", "n") for r in rows)
    assert quality_rules.clean(nothing).collect() == [] and quality_rules.judge(nothing).collect() == []


def test_main_path_is_native(edge):
    plan = quality_rules.clean(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
