"""Training passages that hold benchmark items, found by BM25 with block-max pruning.

The benchmark items are the indexed texts and every passage of every document is a query. A term's impact
in an item is its BM25 weight divided by the item's total, so a passage that holds all terms of an
item scores 1, and all items above ``least_score`` are retrieved. Items lie in blocks of neighbours; each
term has its largest impact per block. A batch of passages is searched at once, in the manner of block-max
WAND: the widespread terms whose largest impacts add up to no more than half of the least score only
raise a passage's bound, the others add their block maxima, and items of a block are scored exactly only
where the bound reaches the least score. Nothing above the threshold is lost by that.

Retrieved items are verified word by word: the share of the runs of ``width`` words of the item's question
(its words up to the last question mark, or its first half), of its answer (the rest) and of the whole
that occur in the passage. A pair leaks if the whole reaches ``least_overlap``, or if the question alone does and has
at least twice ``width`` words. For that an item's weights are divided by those of its question instead of the
whole, so a passage that holds the question scores 1 in retrieval as well; the reported score is the item's.

Passages are stretches of twice the longest item's words, half overlapping, so an item always lies inside
one. Documents stay where they are; the index goes to every task. It is collected in parts of at most
``MAX_INDEX_BYTES`` of item text, one pass over the documents for each part.

Defined results: null or empty texts and items without words hold nothing; an item shorter than ``width``
words is one run of all its words; repeated rows and null ids are rows like all others; of equal passages
the first best one is reported; an empty table on either side gives no pairs. Only the named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.lean import lean

LEAST_SCORE = 0.5
LEAST_OVERLAP = 0.8
WIDTH = 5
BLOCK = 4
MAX_INDEX_BYTES = 16 << 20
K1, B = 1.2, 0.75
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_PLAIN).split()


def shingle_set(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def halves(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and of its answer."""
    text = text or ""
    cut = text.rfind("?") + 1
    question, answer = words_of(text[:cut]), words_of(text[cut:])
    if question and answer:
        return question, answer
    both = question + answer
    return both[:(len(both) + 1) // 2], both[(len(both) + 1) // 2:]


@dataclass
class Index:
    """Postings and block maxima of the items, and what verification needs."""

    ids: list
    terms: dict[bytes, int]
    stretch: int  # words of the longest item
    spread: np.ndarray  # per term: largest impact if the term is widespread, else 0
    rare: np.ndarray  # per term: whether it adds block maxima
    block_start: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray
    post_start: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    parts: list[tuple[set, set, set]]
    asked: list[bool]  # per item: whether its question alone can leak
    scale: np.ndarray  # per item: from the scores of retrieval to those of the item


def build_index(rows: list[tuple], width: int = WIDTH, least_score: float = LEAST_SCORE) -> Index:
    """Index of (id, text) rows; items of similar words are neighbours, which keeps block maxima low."""
    rows = sorted((r for r in rows if words_of(r[1])), key=lambda r: (sorted(words_of(r[1]))[0], str(r[0])))
    texts = [words_of(t) for _, t in rows]
    n, mean = len(rows), sum(map(len, texts)) / max(1, len(rows))
    counts = [Counter(t) for t in texts]
    df = Counter(w for c in counts for w in c)
    terms = {w: i for i, w in enumerate(df)}
    lists: list[list[tuple[int, float]]] = [[] for _ in terms]
    questions = [halves(t)[0] for _, t in rows]
    asked = [len(q) >= 2 * width for q in questions]
    scale = np.ones(n)
    for item, c in enumerate(counts):
        norm = K1 * (1 - B + B * len(texts[item]) / mean)
        weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in c.items()}
        total = sum(weight.values())
        if asked[item]:
            scale[item] = sum(weight[w] for w in set(questions[item])) / total
            total *= scale[item]
        for w, x in weight.items():
            lists[terms[w]].append((item, x / total))
    maxima = [{} for _ in lists]
    for t, posting in enumerate(lists):
        for item, x in posting:
            maxima[t][item // BLOCK] = max(x, maxima[t].get(item // BLOCK, 0.0))
    spread, left = np.zeros(len(lists)), least_score / 2
    for t in sorted(range(len(lists)), key=lambda t: -len(maxima[t])):
        largest = max(maxima[t].values())
        if largest > left:
            break
        spread[t], left = largest, left - largest
    ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes)]).astype("int64")
    parts = [tuple(shingle_set(w, width) for w in (*halves(t), words_of(t))) for _, t in rows]
    return Index(
        [r[0] for r in rows], terms, max(map(len, texts), default=0), spread, spread == 0,
        ends([len(m) for m in maxima]), np.array([b for m in maxima for b in m], "int64"),
        np.array([x for m in maxima for x in m.values()]), ends([len(x) for x in lists]),
        np.array([i for x in lists for i, _ in x], "int64"), np.array([v for x in lists for _, v in x]), parts, asked, scale)


def _expanded(terms: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a list table of all entries of ``terms``, and which term each belongs to."""
    sizes = start[terms + 1] - start[terms]
    which = np.repeat(np.arange(len(terms)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[terms][which], which


_CELLS = 1 << 20  # sums of blocks held at once


def retrieve(index: Index, passages: np.ndarray, terms: np.ndarray, least_score: float) -> tuple[np.ndarray, ...]:
    """(passage, item, score) of all scores of at least ``least_score``; input are the terms of passages. As many
    passages at once as have ``_CELLS`` sums of blocks."""
    n_terms, n_blocks = len(index.terms), -(-len(index.ids) // BLOCK)
    pairs = np.unique(passages * n_terms + terms)
    passages, terms = pairs // n_terms, pairs % n_terms
    step = max(1, _CELLS // n_blocks)
    found = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))]
    for first in range(0, int(passages[-1]) + 1 if len(passages) else 0, step):
        some = slice(*np.searchsorted(passages, [first, first + step]))
        own, item, score = _retrieved(index, passages[some] - first, terms[some], least_score, n_blocks)
        found.append((own + first, item, score))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _retrieved(index: Index, passages: np.ndarray, terms: np.ndarray, least_score: float, n_blocks: int) -> tuple[np.ndarray, ...]:
    n = int(passages[-1]) + 1 if len(passages) else 0
    bound = np.bincount(passages, weights=index.spread[terms], minlength=n)
    rare = index.rare[terms]
    at, which = _expanded(terms[rare], index.block_start)
    cells = passages[rare][which] * n_blocks + index.blocks[at]
    bounds = np.bincount(cells, weights=index.block_max[at], minlength=n * n_blocks)
    alive = (bounds > 0) & (bounds + np.repeat(bound, n_blocks) >= least_score - 1e-9)
    busy = alive.reshape(n, n_blocks).any(axis=1)[passages]
    at, which = _expanded(terms[busy], index.post_start)
    items = index.items[at]
    own = passages[busy][which]
    scored = alive[own * n_blocks + items // BLOCK]
    names, place = np.unique(own[scored] * len(index.ids) + items[scored], return_inverse=True)
    scores = np.bincount(place, weights=index.impacts[at][scored], minlength=len(names))
    high = scores >= least_score - 1e-9
    return names[high] // len(index.ids), names[high] % len(index.ids), scores[high]


_GROUP = 1 << 16  # words searched at once: memory goes by their postings


def leaks_of(index: Index, texts: list[str | None], width: int, least_score: float,
             least_overlap: float) -> Iterator[tuple]:
    """(text number, item id, score, question, answer and whole overlap) of all leaks."""
    if not index.ids:
        return
    stretch = max(index.stretch, width)
    look = index.terms.get
    held: list[tuple[int, list[bytes], np.ndarray]] = []
    size = 0

    def search() -> Iterator[tuple]:
        passages, terms, places, base = [], [], [], 0
        for row, words, ids in held:
            known = np.flatnonzero(ids >= 0)
            half = known // stretch
            last = max(0, -(-len(words) // stretch) - 2)  # passage p covers halves p and p + 1
            for part in (half, half - 1):
                ok = (part >= 0) & (part <= last)
                passages.append(base + part[ok])
                terms.append(ids[known[ok]])
            places += [(row, words, p * stretch) for p in range(last + 1)]
            base += last + 1
        best: dict[tuple, tuple] = {}
        found = retrieve(index, np.concatenate(passages), np.concatenate(terms), least_score)
        runs_of: dict[int, set] = {}
        for passage, item, score in zip(*(x.tolist() for x in found), strict=True):
            row, words, start = places[passage]
            if passage not in runs_of:
                runs_of[passage] = set(zip(*(words[start + k:start + 2 * stretch] for k in range(width)), strict=False))
            runs = runs_of[passage]
            shares = []
            for part in index.parts[item]:
                short = next((len(x) for x in part if len(x) < width), 0)
                own = runs if not short else set(zip(*(words[start + k:start + 2 * stretch] for k in range(short)), strict=False))
                shares.append(len(part & own) / len(part) if part else 0.0)
            score *= float(index.scale[item])
            whole = shares[2] >= least_overlap and score >= least_score - 1e-9
            rank = (whole, shares[2] if whole else shares[0], score)
            if (whole or index.asked[item] and shares[0] >= least_overlap) and rank > best.get((row, item), ((),))[0]:
                best[row, item] = (rank, shares)
        for (row, item), ((_, _, score), shares) in best.items():
            yield row, index.ids[item], score, *shares

    for row, text in enumerate(texts):
        words = words_of(text)
        if words:
            held.append((row, words, np.fromiter((look(w, -1) for w in words), "int64", len(words))))
            size += len(words)
        if size > _GROUP:
            yield from search()
            held, size = [], 0
    if held:
        yield from search()


def _indexes(items: DataFrame, item_key: str, item_text: str, width: int, least_score: float) -> list[Index]:
    """The items in indexes of bounded size, each from one collected part."""
    total = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    parts = -(-total // MAX_INDEX_BYTES) or 1
    part = F.pmod(F.xxhash64(item_key, item_text), F.lit(parts))
    made = []
    for k in range(parts):
        rows = items.filter(part == k).select(item_key, item_text).collect()
        made.append(build_index([tuple(r) for r in rows], width, least_score))
    return made


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", width: int = WIDTH, least_score: float = LEAST_SCORE,
               least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """Document key, item key, BM25 ``score`` and overlaps of every leak."""
    item_kind = items.schema[item_key].dataType.simpleString()
    columns = (f"key {docs.schema[key].dataType.simpleString()}, item {item_kind}, score double, "
               "question_overlap double, answer_overlap double, overlap double")
    found = None
    for index in _indexes(items, item_key, item_text, width, least_score):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = list(leaks_of(held.value, batch.column("body").to_pylist(), width, least_score, least_overlap))
                cols = list(zip(*out, strict=True)) if out else [()] * 6
                kind = batch.schema.field("key").type
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(cols[0], pa.int64())).cast(kind), pa.array(cols[1]).cast(
                        pa.int64()) if item_kind == "bigint" else pa.array(cols[1]), *(pa.array(c, pa.float64()) for c in cols[2:])],
                    names=["key", "item", "score", "question_overlap", "answer_overlap", "overlap"])

        part = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInArrow(lean(search), columns)
        found = part if found is None else found.union(part)
    return found.select(F.col("key").alias(key), F.col("item").alias(item_key), "score", "question_overlap",
                        "answer_overlap", "overlap")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          width: int = WIDTH, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """The documents that hold no item, with all their columns as they are."""
    for index in _indexes(items, item_key, item_text, width, least_score):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bodies = batch.column(batch.num_columns - 1)
                bad = {x[0] for x in leaks_of(held.value, bodies.to_pylist(), width, least_score, least_overlap)}
                good = pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64())
                yield batch.take(good).select(list(range(batch.num_columns - 1)))

        row: Column = F.struct("*").alias("row")
        tagged = docs.select(row, F.col(text).alias("body"))
        docs = tagged.mapInArrow(lean(keep), f"row {tagged.schema['row'].dataType.simpleString()}").select("row.*")
    return docs
