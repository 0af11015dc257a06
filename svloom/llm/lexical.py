"""Ranked lexical search over K2-treaps of the term-document grid.

Documents lie in shards of some hundred thousand postings (4 MB of text), made where the documents are read, without a shuffle. A shard is a grid with a row for each
of its terms and a column for each of its documents (in the order of length). The grid is cut into four again and again;
a cell that holds a posting is a node with four bits for its quarters, and the largest impact within it, kept as the
difference to its parent's. A node's children are found by rank over the bits.

Impacts do not depend on how many documents hold a term, so an index serves any query. An item goes down the rows of all its terms together: a state is a
range of documents with a node for each term that occurs there, and the sum of the terms' weights times the
nodes' maxima is a bound for its documents. States are expanded in blocks, best bound first, until no bound reaches
the item's k-th score so far in the task. Items go out in blocks of BLOCK_TERMS terms; their terms' document counts
are summed over the shards' dictionaries, and each task gives k rows an item at most.

Defined cases: null texts and texts without a term match nothing and don't count; texts of any length are indexed whole; rows
that repeat are documents of their own; equal scores are ordered by doc_id, null last; repeated items get rows each; an item
without terms that occur gets no row; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import Workspace
from svloom.llm.resample import WORD_BYTES, words_of

K, LENGTH_SHARE = 10, 90
#: Bytes of text and documents of a shard; a longer document is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 1 << 22, 1 << 16
#: Terms of the items that are sent to every task at once (a few MB).
BLOCK_TERMS = 200_000
#: States that are expanded at once: of a block's children the best few first, then more and more.
FIRST_STATES, MORE_STATES = 256, 64
_ONE, _SIX = np.uint64(1), np.uint64(6)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers with a gap after each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


_INSIDE = bytes(b != 0x20 for b in WORD_BYTES)


def count_terms(text: bytes) -> int:
    """The terms of a text, by their first bytes."""
    inside = np.frombuffer(b"\0" + text.translate(_INSIDE), np.uint8)
    return int(np.count_nonzero(inside[1:] > inside[:-1]))


def last_null(value) -> tuple:
    """A key that sorts null behind all others."""
    return value is None, 0 if value is None else value


def build_treap(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> bytes:
    """The bytes of the treap of different cells (row, column) with their impacts, whole numbers above 0 and below 2**32."""
    height = max(1, int(max(rows.max(), columns.max())).bit_length())
    codes = (_spread(rows) << _ONE) | _spread(columns)
    order = np.argsort(codes)
    codes, values, levels = codes[order], impacts[order].astype(np.int64), []
    for _ in range(height):
        parents = codes >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        tops = np.maximum.reduceat(values, first)
        sizes = np.diff(np.append(first, len(codes)))
        bits = np.zeros(-(-4 * len(first) // 64) * 64, np.uint8)
        bits[4 * np.repeat(np.arange(len(first)), sizes) + (codes & np.uint64(3)).astype(np.int64)] = 1
        below = np.repeat(tops, sizes) - values
        width = next(w for w in (1, 2, 4) if below.max() < 1 << 8 * w)
        levels.append((len(first), len(codes), width, np.packbits(bits, bitorder="little").tobytes(), below.astype(f"<u{width}").tobytes()))
        codes, values = parents[first], tops
    head = struct.pack("<IQ", height, int(values[0]))
    return head + b"".join(struct.pack("<III", n, m, width) + bits + below for n, m, width, bits, below in reversed(levels))


class Treap:
    """A treap read back; `down` goes from nodes of a level to one of their quarters each."""

    def __init__(self, data: bytes):
        self.height, self.top = struct.unpack_from("<IQ", data)
        self.levels, at = [], 12
        for _ in range(self.height):
            n, m, width = struct.unpack_from("<III", data, at)
            at += 12
            bits = np.frombuffer(data, "<u8", -(-4 * n // 64), at)
            at += 8 * len(bits)
            below = np.frombuffer(data, f"<u{width}", m, at)
            at += width * m
            ranks = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
            self.levels.append((bits, ranks, below))

    def down(self, level: int, nodes: np.ndarray, quarters: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the quarters are there, and of those the node and the largest impact; values are the nodes' own."""
        bits, ranks, below = self.levels[level]
        at = (4 * nodes + quarters).astype(np.uint64)
        unit, place = (at >> _SIX).astype(np.int64), at & np.uint64(63)
        word = bits[unit]
        there = np.flatnonzero((word >> place) & _ONE)
        unit, word, place = unit[there], word[there], place[there]
        child = ranks[unit] + np.bitwise_count(word & ((_ONE << place) - _ONE))
        return there, child, values[there] - below[child]

    def enter(self, rows: np.ndarray, columns: int) -> tuple[int, np.ndarray, np.ndarray]:
        """The level from which on columns are told apart, and each row's node and largest impact there."""
        level = self.height - min(self.height, max(1, (columns - 1).bit_length()))
        nodes, values = np.zeros(len(rows), np.int64), np.full(len(rows), self.top, np.int64)
        for k in range(level):
            _, nodes, values = self.down(k, nodes, 2 * ((rows >> (self.height - 1 - k)) & 1), values)
        return level, nodes, values

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1, at: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores (weight times impact over the rows) of all columns that can be among the k best, ties included.

        Scores below least are left out. at: where the rows' paths begin, as enter tells it.
        """
        columns, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        level, nodes, values = at or (0, np.zeros(len(rows), np.int64), np.full(len(rows), self.top, np.int64))
        bound = int((weights * values).sum())
        heap = [(-bound, 0, level, np.zeros(1, np.int64), np.array([bound]), np.zeros(len(rows), np.int64), np.arange(len(rows)), nodes, values)]
        count = 1
        while heap:
            bound, _, level, prefix, bounds, state, term, node, value = heapq.heappop(heap)
            if -bound < least:
                break
            # the two halves of each state's range: quarters of the row's half in each node
            side = 2 * ((rows[term] >> (self.height - 1 - level)) & 1)
            alive = bounds[state] >= least
            state, term, node, value, side = state[alive], term[alive], node[alive], value[alive], side[alive]
            halves = []
            for half in (0, 1):
                there, child, most = self.down(level, node, side + half, value)
                halves.append((2 * state[there] + half, term[there], child, most))
            state, term, node, value = (np.concatenate(x) for x in zip(*halves, strict=True))
            sums = np.bincount(state, weights=(weights[term] * value).astype(np.float64), minlength=2 * len(prefix)).astype(np.int64)
            if level + 1 == self.height:
                hit = np.flatnonzero(sums >= least)
                columns.append(2 * prefix[hit // 2] + hit % 2)
                scores.append(sums[hit])
                merged = np.concatenate(scores)
                if len(merged) >= k:
                    least = max(least, int(np.partition(merged, len(merged) - k)[len(merged) - k]))
                    keep = merged >= least
                    columns, scores = [np.concatenate(columns)[keep]], [merged[keep]]
                continue
            ranked = np.flatnonzero(sums >= least)
            ranked = ranked[np.argsort(-sums[ranked], kind="stable")]
            at, size = 0, FIRST_STATES
            while at < len(ranked):
                own = ranked[at : at + size]
                at, size = at + size, size * MORE_STATES
                place = np.full(len(sums), -1)
                place[own] = np.arange(len(own))
                pick = np.flatnonzero(place[state] >= 0)
                heapq.heappush(heap, (-int(sums[own[0]]), count, level + 1, 2 * prefix[own // 2] + own % 2, sums[own], place[state[pick]], term[pick], node[pick], value[pick]))
                count += 1
        return np.concatenate(columns), np.concatenate(scores)


@dataclass(frozen=True)
class Index:
    """shards: doc_ids, terms, held (documents of each term), treap. n_docs and n_terms: of all documents."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build_index(space: Workspace, docs: DataFrame, length_share: int = LENGTH_SHARE) -> Index:
    """The index of docs (doc_id, text), as a table in the shared folder."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([count_terms(x.as_py()) for x in batch.column(0)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["docs", "terms"])

    n_docs, n_terms = texts.select("text").mapInArrow(count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shard(ids: list, texts: list[bytes], arrow_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The shard of some documents, one row; none if they hold no term."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        lens = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        full = np.flatnonzero(lens)
        if not len(full):
            return
        flat = pc.list_flatten(words).dictionary_encode()
        row_of = np.empty(len(flat.dictionary), np.int64)
        order = pc.array_sort_indices(flat.dictionary).to_numpy()
        row_of[order] = np.arange(len(order))
        # columns in the order of length; every cell's key comes as often as the term does in the document
        by_length = full[np.array(sorted(range(len(full)), key=lambda k: (lens[full[k]], *last_null(ids[full[k]]))), np.int64)]
        column_of = np.empty(len(ids), np.int64)
        column_of[by_length] = np.arange(len(by_length))
        keys, tf = np.unique(np.repeat(column_of, lens) * len(order) + row_of[flat.indices.to_numpy()], return_counts=True)
        column, row = np.divmod(keys, len(order))
        m = 100 - length_share + (length_share * lens[by_length] * n_docs) // n_terms
        treap = build_treap(row, column, 1_000_000_000 * tf // (1000 * tf + 8 * m[column]))
        held = np.bincount(row, minlength=len(order)).astype("<u4")
        names = b" ".join(flat.dictionary.take(pa.array(order)).cast(pa.binary()).to_pylist())
        doc_ids = pa.array([[ids[k] for k in by_length]], pa.list_(arrow_type))
        yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array([x], pa.binary()) for x in (names, held.tobytes(), treap))], names=["doc_ids", "terms", "held", "treap"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py().translate(WORD_BYTES).strip())
                size += len(texts[-1])
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield from shard(ids, texts, kind)
                    ids, texts, size = [], [], 0
        if ids:
            yield from shard(ids, texts, kind)

    made = texts.mapInArrow(shards, f"doc_ids array<{kind}>, terms binary, held binary, treap binary")
    return Index(space.save(made, "shards", large_rows=True), n_docs, n_terms)


def document_counts(index: Index, terms: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the terms (a block's)."""
    wanted = {t: k for k, t in enumerate(terms)}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for names, held in zip(batch.column(0), batch.column(1), strict=True):
                held = np.frombuffer(held.as_py(), "<u4")
                for row, name in enumerate(names.as_py().split(b" ")):
                    k = wanted.get(name)
                    if k is not None:
                        total[k] += held[row]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["term", "n"])

    rows = index.shards.select("terms", "held").mapInArrow(look_up, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {terms[r.term]: r.n for r in rows}


def search_block(index: Index, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """item, doc_id, score: the k best of each task's shards for each item, ties by doc_id."""
    names = sorted({t for _, terms in items for t in terms})
    held = document_counts(index, names)
    weight = {t: math.floor(1000 * math.log((2.0 * index.n_docs + 2) / (2.0 * n + 1))) for t, n in held.items()}
    weight = {t: w for t, w in weight.items() if w > 0}
    asked = [(item, sorted(weight.keys() & set(terms))) for item, terms in items]
    kind = index.shards.schema["doc_ids"].dataType.elementType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a task found in its earlier shards bounds what it looks for in the next ones
        best: dict[int, list] = {item: [] for item, _ in asked}
        arrow_type = pa.int64()
        for batch in batches:
            for doc_ids, terms, data in zip(*batch.columns, strict=True):
                row_of = {t: r for r, t in enumerate(terms.as_py().split(b" ")) if t in weight}
                treap, ids, arrow_type = Treap(data.as_py()), doc_ids.as_py(), doc_ids.type.value_type
                # the paths down to the level of the documents are the same for all items
                place = {t: k for k, t in enumerate(row_of)}
                rows, weights = np.fromiter(row_of.values(), np.int64, len(row_of)), np.array([weight[t] for t in row_of], np.int64)
                level, nodes, tops = treap.enter(rows, len(ids)) if len(rows) else (0, rows, rows)
                for item, own in asked:
                    own, so_far = np.array([place[t] for t in own if t in place], np.int64), best[item]
                    if len(own):
                        least = -so_far[-1][0] if len(so_far) == k else 1
                        columns, values = treap.best(rows[own], weights[own], k, least, (level, nodes[own], tops[own]))
                        best[item] = sorted(so_far + list(zip((-values).tolist(), (last_null(ids[c]) for c in columns.tolist()), (ids[c] for c in columns.tolist()))), key=lambda x: x[:2])[:k]
        rows = [(item, x[2], -x[0]) for item, found in best.items() for x in found]
        if rows:
            items, found, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(found, arrow_type), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return index.shards.select("doc_ids", "terms", "treap").mapInArrow(search, f"item long, doc_id {kind}, score long")


def search(space: Workspace, index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items (item_id, text)."""
    numbered = space.save(items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(words_of(x.as_py()))) for x in batch.column(1)], pa.list_(pa.binary()))], names=["item", "terms"])

    asked = space.save(numbered.select("item", "text").mapInArrow(terms_of, "item long, terms array<binary>"), "item-terms")
    n_blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS) if index.n_docs else 0
    kind = index.shards.schema["doc_ids"].dataType.elementType
    found = space.spark.createDataFrame([], f"item long, doc_id {kind.simpleString()}, score long")
    for block in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).collect()
        found = found.unionByName(space.save(search_block(index, [(r.item, [bytes(t) for t in r.terms]) for r in rows], k), "found"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, length_share: int = LENGTH_SHARE, space: Workspace | None = None) -> DataFrame:
    """As search, over an index of docs that is made for it."""
    space = space or Workspace(docs.sparkSession, "search")
    return search(space, build_index(space, docs, length_share), items, k)
