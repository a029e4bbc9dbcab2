"""Token ids in Simple-8b words: encoding, block files and reading them back.

A 64-bit word has a selector in its top four bits and as many ids as fit in the other 60, all of one width. An id of
60 bits or more is an escape: a word with only the escape selector, then the id as a raw word. A block holds whole
documents, about BLOCK_IDS ids, as one row of a Parquet table: its documents' ids and lengths, its words, and the
offsets of its raw words, with which the other words decode independently of each other, a selector at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes
from .common import lean, small, written

# Fixed values of the format: ids in a word, and bits of each, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15

BLOCK_IDS = 32_768
#: Distinct pieces of text whose ids a worker remembers.
REMEMBERED = 1_000_000
SLOT_BITS = 21


def _best(bits: np.ndarray) -> np.ndarray:
    """For each place the selector that packs most values from there; 255 where the value needs an escape."""
    n = len(bits)
    reach = {1: bits}
    for k in (2, 4, 8, 16, 32):
        last = reach[k // 2]
        reach[k] = last.copy()
        if n > k // 2:
            np.maximum(last[: n - k // 2], last[k // 2 :], out=reach[k][: n - k // 2])
    found = np.full(n, 255, np.uint8)
    for selector in range(len(COUNTS) - 1, -1, -1):
        count, width = COUNTS[selector], WIDTHS[selector]
        power = 1 << (count.bit_length() - 1)
        most = reach[power]
        if power < count and n > count - power:
            most = most.copy()
            np.maximum(most[: n - (count - power)], reach[power][count - power :], out=most[: n - (count - power)])
        found[most <= width] = selector
    return found


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of uint64 values, and the offsets of the raw ones among them."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    high, low = values >> np.uint64(32), values & np.uint64(0xFFFFFFFF)
    bits = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1]).astype(np.uint8)
    selector = _best(bits)
    steps = np.array([*COUNTS, *[1] * (256 - len(COUNTS))])[selector].tolist()
    picked, at = [], 0
    while at < n:
        picked.append(at)
        at += steps[at]
    place = np.array(picked)
    chosen = selector[place]
    escaped = chosen == 255
    slot = np.arange(len(place)) + np.cumsum(escaped) - escaped
    out = np.zeros(len(place) + int(escaped.sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(COUNTS[0], np.uint64)])
    for k in np.unique(chosen[~escaped]).tolist():
        own = chosen == k
        lanes = np.arange(COUNTS[k])
        group = padded[place[own][:, None] + lanes] << (lanes * WIDTHS[k]).astype(np.uint64)
        out[slot[own]] = np.bitwise_or.reduce(group, 1) | np.uint64(k << 60)
    out[slot[escaped]] = np.uint64(ESCAPE << 60)
    raw = slot[escaped] + 1
    out[raw] = values[place[escaped]]
    return out, raw


def unpack(words: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The n values of pack()."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    selector[raw] = 16
    counts = np.array([*COUNTS, 0, 0, 1])[selector]
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k in np.unique(selector).tolist():
        own = selector == k
        if k == 16:
            out[begin[own]] = words[own]
        elif k != ESCAPE:
            lanes = np.arange(COUNTS[k])
            group = words[own][:, None] >> (lanes * WIDTHS[k]).astype(np.uint64)
            out[begin[own][:, None] + lanes] = group & np.uint64((1 << WIDTHS[k]) - 1)
    return out[:n]


_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: First bytes of two-byte code points without white space among them.
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def pieces(block: textbytes.Block) -> np.ndarray:
    """Where the pieces of a block begin that a byte-level BPE encodes apart, each on its own as in its text.

    Such an encoder splits a text into an optional blank and letters, an optional blank and signs, and white space. So
    a single blank between two other characters begins a piece; a single line feed between two others is one; and a
    comma or full stop after an ASCII letter and before white space begins one. Where that isn't sure from the bytes
    nearby (other white space, longer code points), there is no cut and the piece is longer.
    """
    data = block.data
    n = len(data)
    padded = np.concatenate([np.zeros(2, np.uint8), data, np.zeros(1, np.uint8)])
    last2, last, after = padded[:n], padded[1 : n + 1], padded[3:]
    good = (_GRAPHIC[last] | ((last >= 0x80) & (last < 0xC0) & _LEAD[last2])) & (_GRAPHIC[after] | _LEAD[after])
    cut = np.zeros(n + 1, bool)
    cut[:n] = (data == 0x20) & good
    line = np.flatnonzero((data == 0x0A) & good)
    cut[line] = cut[line + 1] = True
    cut[:n] |= ((data == 0x2C) | (data == 0x2E)) & _LETTER[last] & ((after == 0x20) | (after == 0x0A))
    # What the bytes of a neighbouring text suggested: a text begins a piece, and nothing is cut at its ends.
    ends = block.starts[1:] - 1
    filled = np.diff(block.starts) > 0
    odd = np.concatenate([ends[filled], block.starts[:-1][filled]])
    cut[odd] = False
    cut[block.starts[:-1][filled]] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """The library's ids of whole texts; pieces are encoded once and remembered, up to REMEMBERED of them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        """Entries of pieces: where their ids begin in one row, how many, and a second hash of the piece.

        known has the entry of a first hash; key_at and entry_at have the last ones by low bits of it.
        """
        self.known: dict[int, int] = {}
        self.count = 0
        self.check = np.zeros(1 << 14, np.uint64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.key_at, self.entry_at = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int64)

    def learn(self, texts: list[str], check: np.ndarray) -> np.ndarray:
        """Encode new pieces and return their entries: simple ones in one text, a line feed between two, others alone."""
        lone = len(self.line_feed) == 1
        simple = [k for k, x in enumerate(texts) if lone and x.lstrip(" ").isalnum() and not x.startswith("  ")]
        ids, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if simple:
            joined = "\n".join([texts[k] for k in simple])
            found = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(found == self.line_feed[0])
            if len(at) == len(simple) - 1:
                ids = np.delete(found, at)
                size = np.diff(np.concatenate([[-1], at, [len(found)]])) - 1
            else:
                simple = []
        done = set(simple)
        rest = [k for k in range(len(texts)) if k not in done]
        each = [x.ids for x in self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)]
        ids = np.concatenate([ids, *[np.array(x, np.uint32) for x in each]])
        size = np.concatenate([size, np.array([len(x) for x in each], np.int64)])
        first, n = self.count, len(size)
        while first + n > len(self.begin):
            self.begin, self.size, self.check = [np.concatenate([x] * 2) for x in (self.begin, self.size, self.check)]
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids] * 2)
        self.begin[first : first + n] = self.used + np.cumsum(size) - size
        self.size[first : first + n] = size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.count += n
        entry = np.empty(n, np.int64)
        entry[[*simple, *rest]] = np.arange(first, first + n)
        self.check[entry] = check
        return entry

    def entries(self, block: textbytes.Block, begin: np.ndarray) -> np.ndarray:
        """The entry of each piece of a block, by 128 bits of hashes: pieces that share the first half are told apart."""
        end = np.append(begin[1:], len(block.data))
        key, check = textbytes.hashes(block)(begin, end), textbytes.hashes(block, lane=1)(begin, end)
        slot = (key & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        entry = self.entry_at[slot]

        def learn(places: np.ndarray) -> np.ndarray:
            raw = block.data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(begin[places].tolist(), end[places].tolist(), strict=True)]
            return self.learn(texts, check[places])

        missed = np.flatnonzero(self.key_at[slot] != key)
        if len(missed):
            value, first, inverse = np.unique(key[missed], return_index=True, return_inverse=True)
            values = value.tolist()
            new = [k for k, x in enumerate(values) if x not in self.known]
            if new:
                self.known.update(zip([values[k] for k in new], learn(missed[first[new]]).tolist(), strict=True))
            found = np.fromiter(map(self.known.__getitem__, values), np.int64, len(values))
            entry[missed] = found[inverse]
            at = slot[missed[first]]
            self.key_at[at], self.entry_at[at] = value, found
        other = np.flatnonzero(self.check[entry] != check)
        if len(other):
            entry[other] = learn(other)
        return entry

    def __call__(self, block: textbytes.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts in a row, and how many each text has."""
        if not len(block.data):
            return np.zeros(0, np.uint32), np.zeros(len(block.starts) - 1, np.int64)
        if self.count > REMEMBERED:
            self.forget()
        begin = pieces(block)
        entry = self.entries(block, begin)
        size = self.size[entry]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.begin[entry] - total[:-1], size) + np.arange(int(total[-1]))]
        return ids, np.diff(total[np.searchsorted(begin, block.starts)])


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder that this worker process has, from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


BLOCKS = (
    "part int, start_in_part long, doc_ids array<long>, n_ids long, lengths binary, n_length_raw array<long>, "
    "words binary, raw array<long>"
)


def encode(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Blocks of the ids of docs (doc_id, text), written in ascending order of doc_id.

    Each text (null: empty) is followed by end_id. A part is a range of doc_ids, its blocks numbered by the ids before
    them in the part. Null doc_ids come first, rows of equal doc_id are ordered by a hash of their text, and rows that
    are equal in both have equal ids in any order; so one doc_id, null too, can fill many parts. Texts of any length are
    encoded whole, in one block if long. An empty table makes no block; other columns, whatever their names, are
    left out. path is a tokenizer file that every executor has.
    """
    order = ["doc_id", "text_hash", "place"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"text_hash": F.xxhash64("text"), "place": F.xxhash64(F.monotonically_increasing_id())})
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        start, part = 0, 0
        ids: list[int | None] = []
        made: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal start, ids, made, size
            lengths, length_raw = pack(np.array([len(x) for x in made], np.uint64))
            words, raw = pack(np.concatenate(made))
            row = [[part], [start], [ids], [size], [lengths.astype("<u8").tobytes()], [length_raw.tolist()], [words.astype("<u8").tobytes()], [raw.tolist()]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            start, ids, made, size = start + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            doc_ids = batch.column(0).to_pylist()
            for texts in textbytes.blocks(batch.column(1)):
                found, sizes = encoder(texts)
                for doc_id, x in zip(doc_ids[texts.first : texts.last], np.split(found, np.cumsum(sizes)[:-1]), strict=True):
                    ids.append(doc_id)
                    made.append(np.append(x, np.uint32(end_id)))
                    size += len(made[-1])
                    if size >= BLOCK_IDS:
                        yield block()
        if ids:
            yield block()

    return written(lean(ordered).mapInArrow(run, BLOCKS), "token-blocks")


def decode(blocks: DataFrame) -> DataFrame:
    """Per document of encode()'s blocks: doc_id, start (ids before it in the whole order), n_tokens and ids_crc32.

    Only one row a part is put in order to find where parts begin.
    """
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = small(written(parts.select("part", F.coalesce(before, F.lit(0)).alias("before")), "token-parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (x for k in range(len(batch)) for x in batch.slice(k, 1).to_pylist()):
                doc_ids = row["doc_ids"]
                lengths = unpack(np.frombuffer(row["lengths"], "<u8"), np.array(row["n_length_raw"], np.int64), len(doc_ids)).astype(np.int64)
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["raw"], np.int64), row["n_ids"]).astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(begins + row["start"]), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = blocks.join(parts, "part").withColumn("start", F.col("before") + F.col("start_in_part"))
    rows = rows.select("doc_ids", "n_ids", "lengths", "n_length_raw", "words", "raw", "start")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
