import random
import re
from collections import Counter
from itertools import permutations

import pytest
from conftest import table, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeworks.llm import filter_audit as fa


def fails(rows):
    """Failed filters of (id, text) rows, from the rules as stated."""
    big = 1 << 63
    key = [big if i is None else i for i, _ in rows]
    out = []
    for k, (_, t) in zip(key, rows, strict=True):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
        bad += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * any(o < k and (u or "") == t for o, (_, u) in zip(key, rows, strict=True))
        out.append(bad)
    return out


def brute(parts, failed, good, toxic):
    """All orders applied one after another to each document."""
    out = Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, bad, g, t in zip(parts, failed, good, toxic, strict=True):
            left = True
            for step, c in enumerate(order, 1):
                here = left and c in bad
                k = (part, order, step)
                for name, hit in (("kept", left and not here), ("removed", here), ("redundant", c in bad and not left), ("unique_fails", bad == c),
                                  ("good_lost", here and g), ("toxic_lost", here and t)):
                    out[(*k, name)] += int(hit)
                left = left and not here
    removed = Counter()
    for (part, order, step, name), n in out.items():
        if name == "removed":
            removed[part, order[step - 1]] += n
    return {(p, o, s): (*(out[p, o, s, n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), removed[p, o[s - 1]])
            for p, o, s, _ in out}


def found(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


def copies(seed=1, n=150):
    """Texts with long common prefixes, prefixes of each other, and copies with any ids."""
    rng = random.Random(seed)
    base = ["", "a", "ab", "x" * 5000, "x" * 5000 + "y", "x" * 4999 + "z", "Word " * 300, "Word " * 299, "é" * 40, "é" * 39 + "è", "p # q"]
    return [(rng.choice([None, *range(20)]), rng.choice(base)) for _ in range(n)]


@pytest.mark.parametrize("rows", [texts(), copies(), []], ids=["edge", "copies", "empty"])
@pytest.mark.parametrize("size", [1, 2000, fa.RANGE_BYTES])
def test_masks(spark, rows, size):
    got = fa.masks(table(spark, rows), range_bytes=size)
    have = sorted((r["id"], "".join(c for k, c in enumerate("ABCDE") if r["mask"] >> k & 1)) for r in got.collect())
    assert have == sorted((fa._LAST if i is None else i, bad) for (i, _), bad in zip(rows, fails(rows), strict=True))


def test_audit_with_repeated_and_missing_labels(spark):
    rows = [r for r in copies(2, 80) if r[0] is not None] + texts()
    langs = [[None, "en", "fr", ""][i % 4] for i in range(len(rows))]
    docs = table(spark, rows).limit(0).union(spark.createDataFrame(
        [(i, t, g, "s", 1, "k", "r", "b", "f", 1, 2, 3, 4, "s", "w", "m", 5, "n") for (i, t), g in zip(rows, langs, strict=True)], table(spark, []).schema))
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "x") for i in range(15)] + [(3, 0, 0, "x"), (4, 1, 1, "x"), (None, 1, 1, "x"), (5, None, None, "x")],
                                   "doc_id long, quality long, toxic long, part string")
    good = {r["doc_id"] for r in labels.filter("quality = 1 and doc_id is not null").collect()}
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1 and doc_id is not null").collect()}
    want = brute([g or "" for g in langs], fails(rows), [i in good for i, _ in rows], [i in toxic for i, _ in rows])
    assert found(fa.audit(docs, labels)) == want
    assert found(fa.audit(docs.limit(0), labels)) == {}
    alone = fa.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(alone) == (0, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", max_size=12), st.integers(0, 5)), max_size=60))
def test_trie_keeps_the_least_ids(rows):
    trie = fa.Trie()
    beaten = [x for n, (t, k) in enumerate(rows) for x in trie.insert(t.encode(), k, (n,))]
    least = {t: min(k for u, k in rows if u == t) for t, _ in rows}
    assert sorted(trie.first_rows()) == [(n,) for n, (t, k) in enumerate(rows) if k == least[t]]
    assert sorted([*beaten, *trie.first_rows()]) == [(n,) for n in range(len(rows))]


def test_equal_texts_of_a_task_travel_once(spark):
    """Copies with larger ids are decided where they lie and lose their text."""
    docs = spark.createDataFrame([(i, "the same long text " * 50, "en") for i in range(500)], "doc_id long, text string, lang string").coalesce(1)
    bodies = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), F.col("text").alias("body"))
    marked = bodies.select("*", fa.prefix_marks(F.col("body")).alias("marks"), F.xxhash64("body").alias("whole"))
    assert marked.mapInArrow(fa._measured([set() for _ in fa.PREFIXES]), fa._OPEN).filter("body is not null").count() == 1
