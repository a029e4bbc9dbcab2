"""Ranked lexical search: an inverted index in shards of documents, and a document-at-a-time merge of its postings.

A shard is a run of rows that one task has read, with its own postings: for each term the documents that hold it, ascending
by doc_id, as gaps and counts in variable-length bytes. Building the index shuffles nothing. A search fetches the
postings of the queries' terms alone, merges them shard by shard through a heap of cursors into a bounded heap of results,
and ranks the shards' results together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes
from .common import lean, small, written

#: A term is a longest run of ASCII letters and digits and of what is beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A shard ends with the document that reaches one of these.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Queries that a task works on at once.
QUERIES_AT_ONCE = 512
TOP = 20

#: term is null in the row of a shard itself: df is then its documents with a term, tf all its terms.
INDEX = "shard long, term string, df long, tf long, data binary"


# Postings


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative values, seven bits each, the last without its high bit; and where each begins."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >> np.uint64(7 * k) > 0
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        more = (size[own] > k + 1).astype(np.uint64) << np.uint64(7)
        out[begin[own] + k] = (values[own] >> np.uint64(7 * k) & np.uint64(127)) | more
    return out, begin


def unpacked(data: bytes) -> np.ndarray:
    """The values of packed()."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begin)


class _Shard:
    """The documents of a shard while it is built."""

    def __init__(self) -> None:
        self.ids, self.hashes, self.counts, self.terms = [], [], [], {}
        self.size = self.docs = 0

    def add(self, block: textbytes.Block, ids: pa.Array) -> None:
        begin, end = textbytes.runs(~textbytes.NOT_ALNUM[block.data], block.starts)
        value = textbytes.hashes(block, textbytes.LOWER)(begin, end) if len(begin) else np.zeros(0, np.uint64)
        text = textbytes.LOWER[block.data].tobytes()
        found, first = np.unique(value, return_index=True)
        for key, b, e in zip(found.tolist(), begin[first].tolist(), end[first].tolist(), strict=True):
            if key not in self.terms:
                self.terms[key] = text[b:e]
        self.ids.append(ids)
        self.hashes.append(value)
        self.counts.append(np.diff(np.searchsorted(begin, block.starts)))
        self.size += len(block.data)
        self.docs += len(ids)

    def rows(self, shard: int) -> pa.RecordBatch:
        ids, counts, value = pa.chunked_array(self.ids, pa.int64()).combine_chunks(), np.concatenate(self.counts), np.concatenate(self.hashes)
        known = np.array(ids.is_valid())
        number = np.array(ids.fill_null(0))
        order = np.lexsort((number, ~known))  # null last
        ordinal = np.empty(len(order), np.int64)
        ordinal[order] = np.arange(len(order))
        doc = np.repeat(ordinal, counts)
        by = np.lexsort((doc, value))
        value, doc = value[by], doc[by]
        new_term = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]) if len(value) else new_term
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(value)))
        first = np.flatnonzero(new_term[at])  # a term's first posting
        gap = np.diff(doc[at], prepend=0)
        gap[first] = doc[at][first]
        data, begin = packed(np.stack([gap, tf], 1).ravel())
        cuts = np.append(begin[2 * first], len(data)).astype(np.int64) if len(first) else np.zeros(1, np.int64)
        header = np.concatenate([[int((~known).sum())], number[order], counts[order]]).astype("<i8").tobytes()
        postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).cast(pa.binary())
        ends = np.append(first[1:], len(at))
        totals = np.add.reduceat(tf, first) if len(first) else first
        names = [self.terms[k].decode("utf-8", "replace") for k in value[at][first].tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(first) + 1, shard)),
                pa.array([None, *names], pa.string()),
                pa.array(np.append(int((counts > 0).sum()), ends - first)),
                pa.array(np.append(int(counts.sum()), totals)),
                pa.concat_arrays([pa.array([header], pa.binary()), postings]),
            ],
            ["shard", "term", "df", "tf", "data"],
        )


def index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id long, text): rows (shard, term, df, tf, data), see INDEX; write it, then search it.

    Each row of docs is a document of its own, also if it shares its doc_id or has none; null texts have no terms. Whole
    texts are indexed, of any length; an empty table gives an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, shard = TaskContext.get().partitionId() << 32, 0, _Shard()
        for batch in batches:
            for block in textbytes.blocks(batch.column(1)):
                shard.add(block, batch.column(0).slice(block.first, block.last - block.first))
                if shard.size >= SHARD_BYTES or shard.docs >= SHARD_DOCS:
                    yield shard.rows(base + n)
                    n, shard = n + 1, _Shard()
        if shard.docs:
            yield shard.rows(base + n)

    return lean(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, INDEX)


# Search


class Postings:
    """A term's documents in a shard, ascending, what each scores, and bounds: the most that one and that ``top`` of them score."""

    __slots__ = ("docs", "most", "scores", "several")

    def __init__(self, docs: np.ndarray, scores: np.ndarray, top: int) -> None:
        self.docs, self.scores, self.most = docs.tolist(), scores.tolist(), int(scores.max())
        self.several = int(np.partition(scores, -top)[-top]) if len(scores) >= top else 0


class _Cursor:
    """The place of a query in a term's postings; the term counts ``times``."""

    __slots__ = ("at", "docs", "most", "scores", "times")

    def __init__(self, postings: Postings, times: int) -> None:
        self.docs, self.scores, self.most, self.times, self.at = postings.docs, postings.scores, postings.most * times, times, 0


def best(postings: list[tuple[Postings, int]], top: int) -> list[tuple[int, int]]:
    """The ``top`` documents (score, document) of the highest sums above 0, of equal sums the first documents.

    postings are those of a query's terms, each with its times. The cursors of the terms wait in a heap by their next
    document; the one in front is scored, and enters the bounded heap of results if it beats the worst there. A term's own
    top-th score is a bound for the worst from the start. Terms whose highest scores together don't beat the worst can't
    bring in a document by themselves: they leave the heap and are looked up for documents that the others bring.
    """
    floor = max([0, *(p.several * times - 1 for p, times in postings)])
    cursors = sorted((_Cursor(p, times) for p, times in postings), key=lambda c: c.most)
    upto, total = [], 0
    for c in cursors:
        total += c.most
        upto.append(total)
    out = 0  # the first so many cursors have left
    while out < len(cursors) and upto[out] <= floor:
        out += 1
    heap = [(c.docs[0], k) for k, c in enumerate(cursors) if k >= out]
    heapify(heap)
    found: list[tuple[int, int]] = []
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            k = heap[0][1]
            c = cursors[k]
            if k < out:  # it left meanwhile
                heappop(heap)
                continue
            score += c.scores[c.at] * c.times
            c.at += 1
            if c.at < len(c.docs):
                heapreplace(heap, (c.docs[c.at], k))
            else:
                heappop(heap)
        if not score:
            continue
        for k in range(out - 1, -1, -1):
            if score + upto[k] <= floor:
                score = 0
                break
            c = cursors[k]
            c.at = bisect_left(c.docs, doc, c.at)
            if c.at < len(c.docs) and c.docs[c.at] == doc:
                score += c.scores[c.at] * c.times
        if score > floor:
            if len(found) < top:
                heappush(found, (score, -doc))
            else:
                heapreplace(found, (score, -doc))
            if len(found) == top and found[0][0] > floor:
                floor = found[0][0]
                while out < len(cursors) and upto[out] <= floor:
                    out += 1
    return [(score, -doc) for score, doc in found]


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term, times) of queries (query, text)."""
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"({TERM})"), F.lit(1))
    return queries.select("query", F.explode(words).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))


def _searched(cells: DataFrame, headers: DataFrame, n: int, words: int, top: int) -> DataFrame:
    """(query, doc_id, score): each shard's best for each query, from the postings and headers of (shard, part)."""

    def run(postings: pa.Table, header: pa.Table) -> pa.Table:
        queries: dict[int, list[tuple[Postings, int]]] = {}
        if postings.num_rows:
            raw = np.frombuffer(header["data"][0].as_py(), "<i8")
            nulls, size = int(raw[0]), (len(raw) - 1) // 2
            m = 75 + 25 * raw[size + 1 :] * n // words
            for row in range(postings.num_rows):
                values = unpacked(postings["data"][row].as_py())
                docs, tf = np.cumsum(values[::2]), values[1::2]
                scores = postings["weight"][row].as_py() * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
                if not scores.any():
                    continue
                term = Postings(docs, scores, top)
                for use in postings["uses"][row].as_py():
                    queries.setdefault(use["query"], []).append((term, use["times"]))
        query, doc_id, score = [], [], []
        for key, lists in queries.items():
            for value, doc in best(lists, top):
                query.append(key)
                doc_id.append(None if doc >= size - nulls else int(raw[1 + doc]))
                score.append(value)
        return pa.table({"query": pa.array(query, pa.int64()), "doc_id": pa.array(doc_id, pa.int64()), "score": pa.array(score, pa.int64())})

    return cells.groupBy("shard", "part").cogroup(headers.groupBy("shard", "part")).applyInArrow(run, "query long, doc_id long, score long")


def search(made: DataFrame, queries: DataFrame, item: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` documents of a written index for each row of queries: item, rank from 1, doc_id and score.

    With N documents that have a term, L terms in all, n in a document, df documents with a term and tf times in one: a
    term weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))), a document has m = 75 + (25 n N) div L, and its score is the sum
    of w * ((1000000000 tf) div (1000 tf + 12 m)) over the query's terms, repeats included. Scores above 0 rank from the
    highest, equal ones by ascending doc_id (null last). Fewer matches give fewer rows; null, empty and wordless queries
    give none. Every row of queries is searched for itself, also if it shares its item or has none; their other columns are
    left out. Queries are dealt in parts of about QUERIES_AT_ONCE, each shard's postings to the parts that use them.
    """
    asked = queries.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = written(asked, "queries")
    parts = 1 + asked.count() // QUERIES_AT_ONCE
    part = F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part")
    shards = made.where("term IS NULL")
    n, words = shards.agg(F.sum("df"), F.sum("tf")).first()
    terms = written(query_terms(asked), "query-terms")
    uses = terms.groupBy(part, "term").agg(F.collect_list(F.struct("query", "times")).alias("uses"))
    wanted = small(written(terms.select("term").distinct(), "wanted-terms"))
    hits = written(made.where("term IS NOT NULL").join(wanted, "term").select("shard", "term", "df", "data"), "postings")
    ratio = F.lit(2.0 * (n or 0) + 2) / (2 * F.sum("df") + 1)
    weights = hits.groupBy("term").agg(F.floor(1000 * F.log(ratio)).alias("weight"))
    uses = small(written(uses.join(weights, "term"), "weighed-terms"))
    cells = hits.join(uses, "term").select("shard", "part", "weight", "uses", "data")
    headers = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "data")
    found = _searched(cells, headers, n or 0, words or 1, top)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = written(found.withColumn("rank", rank).where(F.col("rank") <= top), "ranked")
    return ranked.join(small(asked.select("query", "item")), "query").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
