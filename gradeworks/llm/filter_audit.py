"""What each of five filters removes, in every order, with duplicates found in radix tries of whole texts.

Each document gets a mask of the filters that it fails:

* A: fewer than 200 words; B: fewer than half of its words are different; C: over 3% capitals A-Z; D: a symbol
  of ``#$%&*|``; E: its text is that of a document with a smaller id.

1. Prefixes of 8, 32, 128, ... characters are hashed, and the bytes that stand behind each are added up. Prefixes with
   more than ``RANGE_BYTES`` are divided by the next longer ones, so ranges of texts follow the data.
2. Tasks measure A to D and fold equal texts where they lie: a copy with a larger id is decided there and then,
   and travels on without its text. Texts that repeat are remembered for the rest of the task, so a text that a
   third of all documents share is sent about once per task.
3. Each range is put into a compressed trie, one after another. A terminal holds the least id and the documents of that
   id; a document that comes with a larger id, or is displaced by a smaller one, is a duplicate. What the last
   traversal still finds at the terminals is not.
4. Masks meet the labels, are counted by language, and the counts are reduced for all 120 orders.

Defined results: a null text counts as empty and a null language as ''; a null id comes after all others; rows of one id
are no duplicates of each other; several labels of a document count as good (toxic) if one says so; documents
without label are neither; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.lean import lean

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = b"#$%&*|"
RANGE_BYTES = 16 << 20
PREFIXES = [8 * 4 ** k for k in range(10)]
_REMEMBERED = 4 << 20  # bytes of repeated texts that a task remembers
_CAPITALS = bytes(range(65, 91))
_LAST = (1 << 63) - 1
_DUPLICATE = 1 << FILTERS.index("E")
_OPEN = "range long, id long, part string, mask int, body binary"

Batches = Iterator[pa.RecordBatch]


def failed(data: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = data.split()  # of bytes: at \\x20 and \\x09 to \\x0D
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    chars = len(data) if data.isascii() else len(data.decode())
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > MAX_CAPITAL_PERCENT * chars) << 2 | (len(data.translate(None, SYMBOLS)) < len(data)) << 3)


def prefix_marks(text: Column) -> Column:
    """Hashes of the prefixes that are shorter than the text, shortest first."""
    size = F.char_length(text)
    marks = [F.when(size > n, F.xxhash64(F.substring(text, 1, n))) for n in PREFIXES]
    return F.array_compact(F.array(*marks))


def heavy_prefixes(bodies: DataFrame, range_bytes: int = RANGE_BYTES) -> list[set[int]]:
    """Per length the hashes of prefixes with more than ``range_bytes`` behind them: at most the size of all texts over
    ``range_bytes`` for each length."""
    marks = bodies.select(F.octet_length("body").cast("long").alias("size"), F.posexplode(prefix_marks(F.col("body"))).alias("level", "mark"))
    heavy = marks.groupBy("level", "mark").agg(F.sum("size").alias("size")).filter(F.col("size") > range_bytes)
    out: list[set[int]] = [set() for _ in PREFIXES]
    for r in heavy.select("level", "mark").collect():
        out[r["level"]].add(r["mark"])
    return out


def _measured(heavy: list[set[int]]):
    """Masks; of equal texts of a slice only those of the least id keep their text and range."""

    def read(batches: Batches) -> Batches:
        known: dict[bytes, int] = {}  # least id of texts that repeat
        room = _REMEMBERED
        for batch in batches:
            ids, parts = batch.column("id").to_pylist(), batch.column("part").to_pylist()
            bodies = batch.column("body").cast(pa.binary()).to_pylist()
            least: dict[bytes, int] = {}
            again = set()
            for i, data in zip(ids, bodies, strict=True):
                if data in least:
                    again.add(data)
                    least[data] = min(least[data], i)
                else:
                    least[data] = i
            done: dict[bytes, int] = {}
            out = []
            for i, part, data, marks, whole in zip(ids, parts, bodies, batch.column("marks").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                if data not in again and data not in known:
                    mask = failed(data)
                elif (mask := done.get(data)) is None:
                    mask = done[data] = failed(data)
                if i > min(least[data], known.get(data, _LAST)):
                    out.append((i, i, part, mask | _DUPLICATE, None))
                else:
                    leaf = next((m for m, some in zip(marks, heavy, strict=False) if m not in some), whole)
                    out.append((leaf, i, part, mask, data))
            for data in again:
                if data not in known and len(data) > room:
                    known, room = {}, _REMEMBERED
                if data not in known:
                    room -= len(data)
                known[data] = min(least[data], known.get(data, _LAST))
            for data in known.keys() & least.keys():
                known[data] = min(known[data], least[data])
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["range", "id", "part", "mask", "body"])

    return read


class Node:
    """One edge of a trie with what lies below it; a terminal has the least id and the rows of that id."""

    __slots__ = ("below", "label", "least", "rows")

    def __init__(self, label: bytes) -> None:
        self.label, self.below, self.least, self.rows = label, {}, None, []


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``, which differ before the end of ``label``."""
    n = min(len(label), len(text) - at)
    a, b = np.frombuffer(label, "uint8", n), np.frombuffer(text, "uint8", n, at)
    step = 64
    for first in range(0, n, step):
        differ = np.flatnonzero(a[first:first + step] != b[first:first + step])
        if len(differ):
            return first + int(differ[0])
    return n


class Trie:
    """A compressed trie of whole texts."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        """The node where ``text`` ends; made if there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = Node(text[at:])
                return child
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _shared(child.label, text, at)
            middle = node.below[text[at]] = Node(child.label[:n])
            child.label = child.label[n:]
            middle.below[child.label[0]] = child
            node, at = middle, at + n
        return node

    def insert(self, text: bytes, key: int, row: tuple) -> list[tuple]:
        """Put a document in; the rows that turn out to be duplicates."""
        node = self.terminal(text)
        if node.least is None or key < node.least:
            beaten, node.least, node.rows = node.rows, key, [row]
            return beaten
        if key > node.least:
            return [row]
        node.rows.append(row)
        return []

    def first_rows(self) -> Iterator[tuple]:
        """The rows of least id at all terminals."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            yield from node.rows
            stack.extend(node.below.values())


def _searched(batches: Batches) -> Batches:
    """Final masks, from rows in the order of their range; one trie at a time."""
    now, trie, out = None, Trie(), []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.int32()], strict=True)],
                                          names=["id", "part", "mask"])

    for batch in batches:
        for leaf, i, part, mask, data in zip(*(batch.column(c).to_pylist() for c in ("range", "id", "part", "mask", "body")), strict=True):
            if leaf != now:
                out.extend(trie.first_rows())
                now, trie = leaf, Trie()
            if data is None:
                out.append((i, part, mask))
            else:
                out.extend((x, y, z | _DUPLICATE) for x, y, z in trie.insert(data, i, (i, part, mask)))
        yield made()
    out.extend(trie.first_rows())
    yield made()


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``id`` (null: the largest long), ``part`` and ``mask`` of failed filters of every row."""
    bodies = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(lang), F.lit("")).alias("part"),
                         F.coalesce(F.col(text), F.lit("")).alias("body"))
    heavy = heavy_prefixes(bodies, range_bytes)
    marked = bodies.select("*", prefix_marks(F.col("body")).alias("marks"), F.xxhash64("body").alias("whole"))
    open_ = marked.mapInArrow(lean(_measured(heavy)), _OPEN)
    return open_.repartition("range").sortWithinPartitions("range").mapInArrow(lean(_searched), "id long, part string, mask int")


def all_orders() -> list[tuple[str, int, int, int]]:
    """Order, step, bit of the step's filter and bits of the filters before it, for every order and step."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(c) for c in order]
        out += [(order, s + 1, bits[s], sum(bits[:s])) for s in range(len(order))]
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """All orders and steps from (part, mask, n, good, toxic), one row per part and mask."""
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).cast("int").alias("step"), F.lit(b).alias("own"), F.lit(p).alias("before"))
                      for o, s, b, p in all_orders()])
    df = counts.withColumn("_s", F.explode(steps)).select("*", "_s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~gone

    def total(condition: Column, name: str, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long").alias(name)
    # of all orders, a document's filters come first equally often
    orders = len(all_orders()) // len(FILTERS)
    share = F.expr(f"n * ({orders} div greatest(bit_count(mask), 1))")
    return df.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, "kept"), total(here, "removed"), total(fails & gone, "redundant"),
        total(F.col("mask") == F.col("own"), "unique_fails"), total(here, "good_lost", "good"), total(here, "toxic_lost", "toxic"),
        F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What every filter does at every step of every order, by language."""
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    found = masks(docs, key, text, lang, range_bytes).join(known, "id", "left")
    counts = found.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return interactions(counts)
