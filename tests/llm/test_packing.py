import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradeworks.llm import packing
from gradeworks.llm.tokens import encoder


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_patterns_place_every_length_once(histogram):
    patterns = packing.spread_lengths(histogram, 64)
    placed = {}
    for count, lengths in patterns:
        assert sum(lengths) <= 64 and count > 0
        for x in lengths:
            placed[x] = placed.get(x, 0) + count
    assert placed == histogram
    table = packing.slots(patterns)
    assert len(table) == sum(len(lengths) for _, lengths in patterns)


def test_shortest_pack_first():
    assert packing.spread_lengths({5: 2, 3: 1, 2: 1}, 8) == [(1, [5, 3]), (1, [5, 2])]


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=200))
def test_fast_ids_equal_those_of_tokenizers(text):
    assert encoder()(text) == FULL.encode(text, add_special_tokens=False).ids


FULL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(docs):
    want = []
    for r in docs.collect():
        ids = np.array([*FULL.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(r["doc_id"]), s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    rows = packing.pack(docs).toPandas()
    got = [(str(k if k is None or k != k else int(k)).replace("nan", "None"), *x) for k, *x in
           rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(object).itertuples(index=False)]
    assert sorted(got) == sorted(want)
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() <= 2048
    assert sorted(rows["sequence_id"].unique()) == list(range(rows["sequence_id"].nunique()))
    return rows["length"].sum() / (2048 * max(1, rows["sequence_id"].nunique()))


def test_pack(spark, edge, nothing, tables):
    edge = edge.select("text", "n", "rank", *[c for c in edge.columns if c not in ("text", "n", "rank", "doc_id")],
                       edge["doc_id"].cast("long").alias("doc_id")).filter("doc_id is null or doc_id < 1000")
    check(edge)
    assert check(tables["documents"]) > 0.9
    assert packing.pack(nothing).collect() == []
