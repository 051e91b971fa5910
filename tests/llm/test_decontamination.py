import numpy as np
import pytest

from gradeworks.llm import decontamination as dc


def brute(docs, items):
    """Pairs whose item has four fifths of its runs of five words somewhere in the document."""
    out = set()
    for key, text in docs:
        words = dc.words_of(text)
        for item, body in items:
            own = dc.words_of(body)
            width = min(5, len(own))
            if width and len(dc.shingle_set(own, width) & dc.shingle_set(words, width)) >= 0.8 * len(dc.shingle_set(own, 5)):
                if len(dc.shingle_set(own, width) & dc.shingle_set(words, width)):
                    out.add((key, item))
    return out


def items_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "item_id long, text string, item string, score double")


def test_leaks_of_the_tables(tables):
    docs, items = tables["documents"], tables["benchmark"]
    got = {(r["doc_id"], r["item_id"]): r for r in dc.find_leaks(docs, items).collect()}
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert set(got) == want and want
    assert all(r["score"] >= 0.5 and r["overlap"] >= 0.8 for r in got.values())
    clean = {r["doc_id"] for r in dc.clean(docs, items).collect()}
    assert clean == {r["doc_id"] for r in docs.collect()} - {k for k, _ in want}


def test_edges(spark, edge, nothing):
    target = next(r["text"] for r in edge.collect() if r["doc_id"] == 6)
    words = target.split()
    items = items_table(spark, [
        (1, " ".join(words[10:60])), (2, "What is asked here? " + " ".join(words[60:100])), (3, None), (4, ""), (5, "word"),
        (6, " ".join(words[10:60]).upper()), (None, " ".join(words[70:110])), (7, "nothing of this stands anywhere in any of the texts")])
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(edge, items).collect()}
    assert {(6, 1), (7, 1), (None, 1), (6, 6), (6, None), (4, 5)} <= got and not {i for _, i in got} & {3, 4, 7}
    kept = dc.clean(edge, items)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 5, 8, 9, 10, 11, 13}
    assert not {4, 6, 7} & {r["doc_id"] for r in kept.collect()}
    assert dc.find_leaks(nothing, items).collect() == [] and dc.find_leaks(edge, items.limit(0)).collect() == []
    assert dc.clean(nothing, items).collect() == [] and dc.clean(edge, items.limit(0)).count() == edge.count()


def test_a_question_alone_leaks(spark):
    word = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    items = items_table(spark, [(1, f"{word('q', 12)}? {word('a', 12)}"), (2, f"{word('r', 10)}? {word('b', 60)}"),
                                (3, f"{word('s', 9)}? {word('c', 9)}")])
    docs = spark.createDataFrame([(1, f"before {word('q', 12)} and then quite another answer"), (2, f"{word('x', 30)} {word('r', 10)}"),
                                  (3, word("s", 9)), (4, word("a", 12)), (5, f"{word('q', 12)} {word('a', 12)}"), (6, word("q", 8))],
                                 "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.find_leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (5, 1)}
    assert [got[k]["question_overlap"] for k in sorted(got)] == [1.0, 1.0, 1.0] and got[2, 2]["overlap"] < 0.2
    assert got[2, 2]["score"] < 0.5 and abs(got[5, 1]["score"] - 1) < 1e-9
    assert {r["doc_id"] for r in dc.clean(docs, items).collect()} == {3, 4, 6}


def test_an_index_in_parts_finds_the_same(tables, monkeypatch):
    docs, items = tables["documents"], tables["benchmark"]
    whole = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect()}
    monkeypatch.setattr(dc, "MAX_INDEX_BYTES", 3000)
    assert {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect()} == whole


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
@pytest.mark.parametrize("seed", range(8))
def test_block_maxima_lose_nothing(seed, cells, monkeypatch):
    monkeypatch.setattr(dc, "_CELLS", cells)
    rng = np.random.default_rng(seed)
    word = lambda n, top: " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % top)
    index = dc.build_index([(i, word(int(rng.integers(3, 40)), 200)) for i in range(37)])
    n = 50
    passages = np.repeat(np.arange(n), 30)
    terms = rng.integers(0, len(index.terms), len(passages))
    for least in (0.2, 0.5):
        got = {(p, i): s for p, i, s in zip(*(x.tolist() for x in dc.retrieve(index, passages, terms, least)), strict=True)}
        want = {}
        for p in range(n):
            scores = np.zeros(len(index.ids))
            for t in set(terms[passages == p].tolist()):
                a, b = index.post_start[t], index.post_start[t + 1]
                scores[index.items[a:b]] += index.impacts[a:b]
            want |= {(p, i): s for i, s in enumerate(scores.tolist()) if s >= least - 1e-9}
        assert set(got) >= {k for k, s in want.items() if s > least + 1e-6}
        assert all(abs(want[k] - s) < 1e-9 for k, s in got.items())


def test_halves():
    assert dc.halves("What is it? It is this.") == ([b"what", b"is", b"it"], [b"it", b"is", b"this"])
    assert dc.halves("one two three") == ([b"one", b"two"], [b"three"]) and dc.halves(None) == ([], [])


def test_many_short_items_need_little_memory():
    """A dense table of all passages and blocks would take a gigabyte and more here."""
    import tracemalloc
    items = [(i, f"w{i % 977} w{i % 1009} w{i % 31} " + " ".join(f"u{i * 7 + k}" for k in range(9))) for i in range(20_000)]
    index = dc.build_index(items)
    text = " ".join(items[i * 97][1] for i in range(200)) + " " + " ".join(f"w{k % 977}" for k in range(250_000))
    tracemalloc.start()
    found = {i for _, i, *_ in dc.leaks_of(index, [text], 5, 0.5, 0.8)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= {i * 97 for i in range(200)} and peak < 300 << 20


def test_memory_follows_the_words_searched_at_once():
    """Items of frequent words have long postings; many documents take no more memory than a few."""
    import tracemalloc
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(300)])
    index = dc.build_index([(i, " ".join(rng.choice(vocabulary, 40))) for i in range(200)])
    texts = [" ".join(rng.choice(vocabulary, 2000)) for _ in range(70)]
    tracemalloc.start()
    list(dc.leaks_of(index, texts, 5, 0.5, 0.8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
