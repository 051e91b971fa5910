from collections import defaultdict

from gradeworks.llm import token_counts
from gradeworks.llm.tokens import VOCABULARY, encoder


def test_batches_apply_once(spark, tmp_path):
    kinds = "source string, lang string, tokenizer string, old_tokens long, new_tokens long, n_docs long, delta long"
    batch = lambda rows: spark.createDataFrame([(*r, 7, 8) for r in rows], kinds)
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().collect() == []
    first = batch([("s", "en", "v", None, 10), ("s", "en", "v", None, 5), (None, None, "v", None, 1), ("t", "en", "v", None, 9)])
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    again = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert not again.commit("b1", first)
    second = batch([("s", "en", "v", 10, None), ("s", "en", "v", 5, 6), ("t", "en", "v", 9, None), ("t", "de", "v", None, 9),
                    ("u", "en", "v", None, None)])
    assert again.commit("b2", second) and again.commit("b3", second.limit(0))
    totals = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    assert totals == {("s", "en", "v"): (1, 6), (None, None, "v"): (1, 1), ("t", "de", "v"): (1, 9)}


def test_an_attempt_that_did_not_commit_is_not_read(spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    stray = spark.createDataFrame([("s", "en", "v", 1, 99)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    stray.write.parquet(f"{tmp_path}/r/deltas/stray")
    assert rollup.totals().collect() == []


def test_counts_and_copies(edge, nothing, tables):
    for docs in (edge, tables["documents"], nothing):
        rows = docs.collect()
        counts = token_counts.count_tokens(docs)
        got = sorted((str(r["key"]), r["tokenizer"], r["tokens"]) for r in counts.collect())
        encode = encoder()
        assert got == sorted([(str(r["doc_id"]), VOCABULARY, len(encode(r["text"] or ""))) for r in rows]
                             + [(str(r["doc_id"]), token_counts.WORDS, len((r["text"] or "").encode().split())) for r in rows])
        least = defaultdict(list)
        for r in rows:
            least[r["text"] or ""].append(r["doc_id"])
        gone = sorted(str(k) for keys in least.values() for k in keys
                      if (known := [x for x in keys if x is not None]) and k != min(known))
        assert sorted(str(r["key"]) for r in token_counts.copies(counts).filter(f"tokenizer = '{VOCABULARY}'").collect()) == gone
