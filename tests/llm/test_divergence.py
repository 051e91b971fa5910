import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from conftest import texts

from gradeworks.llm import divergence


def brute(rows, top=200):
    """Ranked pairs and terms from (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    def words(t):
        return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    held = defaultdict(Counter)
    for lang, _, t in rows:
        held[lang].update(set(words(t)))
    kept = {lang: sorted(w for w, n in c.items() if n >= 3) for lang, c in held.items()}
    counts = defaultdict(Counter)
    for lang, source, t in rows:
        some = [w for w in words(t) if held[lang][w] >= 3]
        counts[lang, source].update(some)
        counts[lang, None].update(some)
    def shares(lang, source):
        c, n = counts[lang, source], sum(counts[lang, source].values())
        return {w: 1 + 10 ** 9 * (c[w] + 1) // (n + len(kept[lang])) for w in kept[lang]}
    out = []
    for lang in kept:
        sources = sorted({s for x, s, _ in rows if x == lang})
        p = {s: shares(lang, s) for s in sources}
        q = shares(lang, None)
        for s in sources:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept[lang])) for o in sources if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept[lang] if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in divergence.audit(df, **more).collect())


def many(seed=1, n=120):
    """Documents of few words, many ties and prefixes, with sources without words."""
    rng = random.Random(seed)
    vocabulary = [a + b + c for a in ("same-long-beginning".replace("-", ""), "ß", "x") for b in "abcdefg" for c in ("", "é", "zz", "Q")]
    rows = [(rng.choice(["en", "fr", None]), f"s{rng.randint(0, 5)}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return rows + [("en", "silent", "1 2 3 !"), ("en", None, None), ("de", "a", "once"), ("de", "b", ""), ("de", "a", "once")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, i, "d") for i, r in enumerate(rows)], "lang string, source string, text string, n long, digest string")


@pytest.mark.parametrize("bits", [64, 9, 3])
def test_against_brute_force_with_and_without_shared_digests(spark, bits):
    rows = many()
    assert found(frame(spark, rows), bits=bits) == brute(rows)


def test_only_the_best_terms_in_the_order_of_their_bytes(spark):
    rows = many(2, 60)
    assert found(frame(spark, rows), top=4) == brute(rows, 4)


def test_blocks_and_folds_of_any_size(monkeypatch):
    """Tasks cut their rows anywhere: the sums stay the same."""
    sample = pa.RecordBatch.from_pydict({"lang": ["en"] * 9 + ["fr"] * 3, "digest": [i // 3 for i in range(12)], "second": [0] * 12,
                                         "source": ["a", "b", "c"] * 4, "p": list(range(10, 22)), "p0": [3, 4, 5] * 4})
    texts_ = pa.RecordBatch.from_pydict({"lang": ["en", "fr"] * 5, "source": ["a", "a", "b"] * 3 + ["c"], "body": [f"one two {'x' * i} two" for i in range(10)]})

    def summed(batches, keys, value):
        out = Counter()
        for b in batches:
            for r in b.to_pylist():
                out[tuple(r[k] for k in keys)] += r[value]
        return out

    def pairs(batches):
        return summed(divergence._both(iter(batches)), ("lang", "source", "item"), "value")

    def folds(batches):
        return summed(divergence._folded(64)(iter(batches)), ("lang", "source", "digest"), "n")

    want = pairs([sample]), folds([texts_])
    for name, size in (("_CELLS", 4), ("FOLD_ENTRIES", 5), ("_ROWS", 3)):
        monkeypatch.setattr(divergence, name, size)
    assert (pairs([sample.slice(k, 1) for k in range(12)]), folds([texts_.slice(k, 2) for k in range(0, 10, 2)])) == want


def test_awkward_and_empty_tables(spark, edge, nothing):
    assert found(edge) == brute([("en", "s", t) for _, t in texts()])
    assert found(nothing) == []
    hot = [(None if i % 3 else "en", "s", "word " * 50) for i in range(30)]
    assert found(frame(spark, hot)) == brute(hot)
