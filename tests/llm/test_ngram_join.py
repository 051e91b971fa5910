from collections import Counter, defaultdict

import numpy as np
import pytest

from gradeworks.llm import ngram_join
from gradeworks.llm.components import components


def brute(rows, width, percent):
    """(id, set size, component) of every row by comparing all sets that share a shingle."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else []))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = Counter((a, b) for h in holders.values() for b in h for a in h if a < b)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            root[find(b)] = find(a)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((str(k), len(sets[i]), str(least.get(find(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows)))


def got(docs, **options):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.join_components(docs, **options).collect())


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_join_matches_brute_force(edge, nothing, tables):
    assert got(edge) == brute(pairs(edge), 3, 90)
    assert got(tables["documents"], width=5, percent=80, block=3, list_block=2) == brute(pairs(tables["documents"]), 5, 80)
    assert got(nothing) == []


def test_chains_of_near_copies_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = []
    for family in range(6):
        words = [f"w{x}" for x in rng.integers(0, 900, 60)]
        for _ in range(25):
            words = list(words)
            words[rng.integers(60)] = f"n{rng.integers(10 ** 6)}"
            rows.append((int(rng.integers(10 ** 9)), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 90):
        assert got(docs, percent=percent, block=4, list_block=5) == brute(rows, 3, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_divide_skip_finds_the_components(percent):
    rng = np.random.default_rng(percent)
    for _ in range(30):
        base = rng.choice(400, 60, replace=False)
        sets = []
        for _ in range(12):
            s = set(base[: rng.integers(40, 60)]) | set(rng.integers(400, 500, rng.integers(0, 5)))
            sets.append(np.array(sorted(s), "uint64"))
        root = list(range(12))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(12):
            for b in range(a):
                c = len(np.intersect1d(sets[a], sets[b]))
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    root[find(a)] = find(b)
        links = ngram_join.divide_skip(list(range(12)), [0] * 12, sets, percent)
        own = list(range(12))
        for a, b in links:
            own[find(a, own)] = find(b, own)
        assert len({find(x) for x in range(12)}) == len({find(x, own) for x in range(12)})
        assert all(find(a) == find(b) for a, b in links)


@pytest.mark.parametrize("percent", [71, 80, 90])
def test_similar_sets_share_a_group_and_pass_the_sketches(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(3, 40), 100, 317, 1000]:
        for _ in range(12):
            a = rng.integers(0, 1 << 63, n, dtype="uint64")
            gone, new = rng.integers(0, n // 3 + 1), rng.integers(0, n // 3 + 1)
            b = np.unique(np.append(a[gone:], rng.integers(0, 1 << 63, new, dtype="uint64")))
            a = np.unique(a)
            shared = len(np.intersect1d(a, b))
            if shared * 100 < percent * (len(a) + len(b) - shared) or len(a) * (100 - percent) < percent:
                continue
            if shared == len(a) == len(b) or len(b) * (100 - percent) < percent:
                continue
            hashes = [{int(h) for j in ngram_join.size_classes(len(s), percent) for h in ngram_join.group_hashes(s, j, percent)}
                      for s in (a, b)]
            assert hashes[0] & hashes[1]
            links = ngram_join.compatible_links(np.array([1, 2]), np.array([0, 0]), np.array([len(a), len(b)]),
                                                [ngram_join.sketch(a), ngram_join.sketch(b)], percent)
            assert links == [(1, 2)]


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(3, 900), (900, 7), (7, 7), (None, 4)] + [(5, 1000 + i) for i in range(50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {3: 3, 900: 3, 7: 3, 5: 5} | {1000 + i: 5 for i in range(50)}
    assert found == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_one_document_of_each_group_stays(edge, nothing):
    kept = ngram_join.keep_one(edge, width=3, percent=90)
    assert kept.columns == edge.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    want = [k for k, n, c in brute(pairs(edge), 3, 90) if k == c or k == "None"]
    assert ids == sorted(want)
    assert ngram_join.keep_one(nothing).collect() == []
