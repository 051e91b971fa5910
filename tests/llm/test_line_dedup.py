import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import table, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeworks.llm import line_dedup, perfect_hash


def brute(rows, least=40, min_docs=5):
    """The rows' ids, counts and hashes; each row is a document."""
    split = [[x for x in (t or "").split("\n")] for _, t in rows]
    def key(line):
        return line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for n, lines in enumerate(split):
        for line in lines:
            held[key(line)].add(n)
    low = -(1 << 63)
    gone = {k: max(low if rows[n][0] is None else rows[n][0] for n in some) for k, some in held.items() if len(k) >= least and len(some) >= min_docs}
    out = []
    for (i, _), lines in zip(rows, split, strict=True):
        kept = [x for x in lines if gone.get(key(x)) in (None, low if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **more):
    done = line_dedup.drop_lines(df, lambda b: hashlib.sha256(b).hexdigest(), **more)
    return sorted([(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in done.collect()], key=str)


def lines_everywhere(n=60, seed=3):
    """Texts that share lines of all lengths and kinds of blanks, some with null ids and repeated rows."""
    rng = random.Random(seed)
    shared = [f"Shared line number {i} that is certainly long enough" + "é" * i for i in range(8)]
    shared += ["x" * 39, "x" * 40, "é" * 39, "é" * 40, " " + "y" * 39]
    def dressed(line):
        return rng.choice(["", " ", "\t", "\r", "\x0b\x0c "]) + rng.choice([line, line.upper(), line.lower()]) + rng.choice(["", " ", "\r"])
    rows = [(i, "\n".join(dressed(rng.choice(shared)) if rng.random() < 0.5 else f"own line {i} {k} " + "z" * rng.randint(0, 60) for k in range(rng.randint(0, 9))))
            for i in range(n)]
    return rows + [(None, rows[3][1]), (None, rows[4][1]), rows[5], rows[5], (7, shared[0]), (n - 1, None), (n + 1, "")]


@pytest.mark.parametrize("rows", [texts(), lines_everywhere(), texts() * 5, []], ids=["edge", "shared", "repeated", "empty"])
def test_against_brute_force(spark, rows):
    assert found(table(spark, rows)) == brute(rows)


def test_keys_beyond_the_head_give_the_same(spark, monkeypatch):
    """The head holds no keys, then some; shards of a few keys each."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    rows = lines_everywhere(200, 5)
    docs = table(spark, rows)
    want = brute(rows, 20, 2)
    for size in (0, 26 * 6, 1 << 20):
        assert found(docs, least=20, min_docs=2, head_bytes=size) == want


def test_clean_keeps_rows_and_columns(spark):
    rows = [(i, f"the very same line in all of these documents\nown {i}") for i in range(6)] + [(9, None), (10, "")]
    out = line_dedup.clean(table(spark, rows))
    assert out.columns == table(spark, rows).columns
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert left == {**{i: (f"own {i}", 5) for i in range(5)}, 5: (rows[5][1], len(rows[5][1])), 9: (None, None), 10: ("", 0)}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(0, (1 << 64) - 1), st.integers(0, (1 << 64) - 1)), max_size=300))
def test_slots_are_minimal_and_perfect(words):
    words = np.array(sorted(words), "uint64").reshape(-1, 2)
    made = perfect_hash.PerfectHash.build(words)
    assert sorted(made.slots(words).tolist()) == list(range(len(words))) and made.count == len(words)


def test_words_outside_the_set_are_told_apart():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, (5000, 2), dtype="uint64")
    import pyarrow as pa
    kept = words[:3000]
    rows = pa.table({"shard": pa.array([0] * 3000, pa.int64()), "h0": kept[:, 0].view("int64"), "h1": kept[:, 1].view("int64"),
                     "docs": np.arange(3000) + 5, "keeper": np.arange(3000)})
    shard = perfect_hash.Shard(perfect_hash.shard_row(rows).to_pylist()[0])
    slots = shard.probe(words)
    assert (slots[3000:] == -1).all() and (shard.keepers[slots[:3000]] == np.arange(3000)).all()
    assert (shard.docs[slots[:3000]] == np.arange(3000) + 5).all()
