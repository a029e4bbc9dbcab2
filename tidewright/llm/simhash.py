"""Near-duplicates by SimHash: fingerprints within a Hamming distance, found through the anchors of a covering code.

A fingerprint is cut in parts of bits, each with a threshold; a pair within the distance is within the threshold of one
part at least, as the thresholds and one for each part but the first add up to the distance. A part's anchors are the
words of a code of 23 bits that covers every word within three bits, times all values of the part's other bits. A fingerprint's
home is its nearest anchor; it is also copied to every anchor within the covering radius plus the part's threshold, so
it meets each partner at the partner's home. What is compared is an anchor's homes with its copies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .common import lean, written
from .graph import components

SIZE, DISTANCE, SEED = 4, 4, 42

# Fixed values of the binary Golay code: length, covering radius, and its generator polynomial.
CODE_BITS, RADIUS, GENERATOR = 23, 3, 0b101011100011
CHECK_BITS = 11

#: Bits of each part and its threshold; every part has a code word of 23 bits, the rest is taken as it is.
PARTS = ((36, 1), (28, 2))
#: The copies at an anchor are dealt to so many tasks, each with all homes of the anchor.
SALTS = 8
#: Rows that are compared at once; a longer run of copies meets its homes in several turns.
AT_ONCE = 1 << 20


# Fingerprints


def _joined(block: textbytes.Block) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block's texts, lower-cased, a space before each; each word's begin and end, each text's first word."""
    begin, end = textbytes.runs(~textbytes.SEPARATOR[block.data], block.starts)
    at = np.searchsorted(begin, block.starts)
    width = end - begin + 1
    until = np.cumsum(width)
    out = np.full(int(until[-1]) if len(until) else 0, 0x20, np.uint8)
    source = np.arange(len(out)) + np.repeat(begin - 1 - (until - width), width)
    inside = np.ones(len(out), bool)
    inside[until - width] = False
    out[inside] = textbytes.LOWER[block.data[source[inside]]]
    return out.tobytes(), until - width + 1, until, at


def fingerprints(block: textbytes.Block, size: int = SIZE) -> np.ndarray:
    """The fingerprint of each text of a block, 64 bits each.

    A bit is set if more than half of the XXH64 of the text's runs of ``size`` words have it, repeats counted.
    """
    data, begin, end, at = _joined(block)
    made = np.zeros(len(at) - 1, np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k in range(len(made)):
        first, last = int(at[k]), int(at[k + 1])
        if first == last:
            continue
        n = max(1, last - first - size + 1)
        ends = end[first + size - 1 : last].tolist() if last - first >= size else [int(end[last - 1])]
        counts = np.zeros(64, np.int64)
        for low in range(0, n, 1 << 16):
            high = min(n, low + (1 << 16))
            hashes = np.fromiter(
                (xxhash.xxh64_intdigest(data[b:e], SEED) for b, e in zip(begin[first + low : first + high].tolist(), ends[low:high], strict=True)), "<u8", high - low
            )
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(0, dtype=np.int64)
        made[k] = powers[2 * counts > n].sum()
    return made


def sketched(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, fp) of each row of docs (doc_id, text); fp is the fingerprint as a long. Null texts count as empty: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprints(block, size) for block in textbytes.blocks(batch.column(1))]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(made).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return lean(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, fp long")


# Anchors


@cache
def _patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome of the code the words of up to RADIUS + 2 bits with it: their values, by weight, and where they begin.

    The third array is how many of them have at most RADIUS, RADIUS + 1 and RADIUS + 2 bits.
    """
    check = np.zeros(CODE_BITS, np.int64)
    for k in range(CODE_BITS):
        word = 1 << k
        for high in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
            if word >> high & 1:
                word ^= GENERATOR << (high - CHECK_BITS)
        check[k] = word
    values, syndromes, weights = [], [], []
    for weight in range(RADIUS + 3):
        sets = list(combinations(range(CODE_BITS), weight))
        chosen = np.array(sets, np.int64).reshape(len(sets), weight)
        values.append((1 << chosen).sum(1))
        syndromes.append(np.bitwise_xor.reduce(check[chosen], 1) if weight else np.zeros(1, np.int64))
        weights.append(np.full(len(chosen), weight))
    value, syndrome, weight = (np.concatenate(x) for x in (values, syndromes, weights))
    order = np.lexsort((weight, syndrome))
    value, syndrome, weight = value[order], syndrome[order], weight[order]
    begin = np.searchsorted(syndrome, np.arange(1 << CHECK_BITS))
    within = np.stack([np.bincount(syndrome[weight <= RADIUS + d], minlength=1 << CHECK_BITS) for d in range(3)])
    return value, begin, within


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of every value of the low 12 and of the high 11 bits of a word."""
    value, begin, _ = _patterns()
    one = np.zeros(CODE_BITS, np.int64)
    of = np.searchsorted(begin, np.arange(len(value)), "right") - 1
    for k in range(CODE_BITS):
        one[k] = of[np.flatnonzero(value == 1 << k)[0]]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for k in range(CODE_BITS):
        table, bit = (low, k) if k < 12 else (high, k - 12)
        table[np.arange(len(table)) >> bit & 1 == 1] ^= one[k]
    return low, high


def near(words: np.ndarray, over: int) -> tuple[np.ndarray, np.ndarray]:
    """Every code word within RADIUS + over bits of each word of 23 bits: the word's place, and the code word.

    Within RADIUS there is one, the home.
    """
    value, begin, within = _patterns()
    low, high = _syndromes()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    n = within[over][syndrome]
    place = np.repeat(np.arange(len(words)), n)
    turn = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    return place, words[place] ^ value[begin[syndrome[place]] + turn]


def anchors(found: np.ndarray, parts: Sequence[tuple[int, int]] = PARTS) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """For fingerprints: whether these are homes, the places of the fingerprints, and the anchors they go to."""
    shift = 0
    for part, (bits, threshold) in enumerate(parts):
        own = (found >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
        shift += bits
        word, rest, spare = own & ((1 << CODE_BITS) - 1), own >> CODE_BITS, bits - CODE_BITS
        for differ in range(threshold + 1):
            place, code = near(word, threshold - differ)
            for chosen in combinations(range(spare), differ):
                flipped = rest ^ sum(1 << k for k in chosen)
                yield False, place, (flipped[place] << CODE_BITS | code) * len(parts) + part
        place, code = near(word, 0)
        yield True, place, (rest[place] << CODE_BITS | code) * len(parts) + part


def _checked(distance: int, parts: Sequence[tuple[int, int]]) -> None:
    if sum(bits for bits, _ in parts) != 64 or any(bits < CODE_BITS or not 0 <= t <= 2 for bits, t in parts):
        raise ValueError("parts have 23 bits or more, 64 in all, and a threshold of at most 2")
    if sum(t for _, t in parts) + len(parts) <= distance:
        raise ValueError("the thresholds leave out pairs within the distance")


# Links


def _compared(homes: np.ndarray, copies: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and copies that join all that are linked, without every pair: one link a join.

    A home is compared with the copies that it isn't joined with yet; copies that have been joined carry one label.
    """
    label = {}
    a, b = [], []

    def root(x: int) -> int:
        while label.get(x, x) != x:
            label[x] = label.get(label[x], label[x])
            x = label[x]
        return x

    owner = copies.copy()  # the label of each copy, as of when it was last joined
    for home in homes.tolist():
        mine = root(home)
        open_ = np.flatnonzero(owner != np.uint64(mine))
        close = open_[np.bitwise_count(copies[open_] ^ np.uint64(home)) <= distance]
        groups, at = np.unique(owner[close], return_index=True)
        for other in copies[close[at]].tolist():
            x, y = root(home), root(other)
            if x != y:
                label[y] = x
                a.append(home)
                b.append(other)
        if len(groups):
            owner[np.isin(owner, groups)] = root(home)
    return np.array(a, np.uint64), np.array(b, np.uint64)


def _pairs(homes: list[np.ndarray], copies: list[np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many anchors with few rows: all their pairs are compared at once."""
    n = np.array([len(x) for x in homes]), np.array([len(x) for x in copies])
    all_h, all_c = np.concatenate(homes), np.concatenate(copies)
    first = np.repeat(np.cumsum(n[1]) - n[1], n[0])
    times = np.repeat(n[1], n[0])
    left = np.repeat(np.arange(len(all_h)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + first[left]
    x, y = all_h[left], all_c[right]
    keep = (x != y) & (np.bitwise_count(x ^ y) <= distance)
    return x[keep], y[keep]


#: Pairs up to which an anchor is compared along with others.
FEW = 1 << 14


def _linked(placed: DataFrame, distance: int) -> DataFrame:
    """(a, b): links between fingerprints from rows (slot, fp), of which a slot's homes come first and its copies next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def made(slot: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            group = slot >> 1
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
            end = np.append(edge[1:], len(group))
            copies_at = edge + np.add.reduceat(1 - (slot & 1), edge) if len(edge) else edge
            both = (copies_at > edge) & (end > copies_at)
            few_h, few_c, pairs = [], [], 0
            for first, at, last in zip(edge[both].tolist(), copies_at[both].tolist(), end[both].tolist(), strict=True):
                n = (at - first) * (last - at)
                if n > FEW:
                    yield _batch(*_compared(fp[first:at], fp[at:last], distance))
                    continue
                few_h.append(fp[first:at])
                few_c.append(fp[at:last])
                pairs += n
                if pairs > AT_ONCE:
                    yield _batch(*_pairs(few_h, few_c, distance))
                    few_h, few_c, pairs = [], [], 0
            if few_h:
                yield _batch(*_pairs(few_h, few_c, distance))

        for batch in batches:
            slot = np.concatenate([slot, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(slot) < AT_ONCE:
                continue
            begin = int(np.searchsorted(slot, slot[-1] >> 1 << 1))  # where the last group begins
            if begin:
                yield from made(slot[:begin], fp[:begin])
                slot, fp = slot[begin:], fp[begin:]
            else:  # one anchor: its homes stay, the copies so far are done
                yield from made(slot, fp)
                homes = slot & 1 == 0
                slot, fp = slot[homes], fp[homes]
        yield from made(slot, fp)

    return placed.mapInArrow(run, "a long, b long")


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(found: DataFrame, distance: int = DISTANCE, parts: Sequence[tuple[int, int]] = PARTS, salts: int = SALTS) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp long) that join all within ``distance`` bits of each other.

    Each fingerprint goes to its home in each part, in each of ``salts`` tasks, and to every anchor within the covering
    radius plus the part's threshold, in one of them. So an anchor that very many fingerprints share is worked on by
    ``salts`` tasks, and no pair is left out: the anchors are a matter of geometry, there is no cap.
    """
    _checked(distance, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            everything = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(everything), 4096):
                fps = everything[low : low + 4096]
                salt = (textbytes.mixed(fps) % np.uint64(salts)).astype(np.int64)
                slots, values = [], []
                for home, place, anchor in anchors(fps, parts):
                    for k in range(salts) if home else (salt[place],):
                        slots.append((anchor * salts + k) * 2 + (not home))
                        values.append(fps[place])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots)), pa.array(np.concatenate(values).view(np.int64))], ["slot", "fp"])

    placed = found.select("fp").mapInArrow(run, "slot long, fp long")
    placed = placed.repartition(F.shiftright("slot", 1)).sortWithinPartitions("slot")
    return _linked(placed, distance)


def near_duplicates(
    docs: DataFrame, size: int = SIZE, distance: int = DISTANCE, parts: Sequence[tuple[int, int]] = PARTS, salts: int = SALTS
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits) and component_id.

    Words are A-Z lower-cased; a text's fingerprint is made of its runs of ``size`` words (see fingerprints()), or with
    fewer words of its whole sequence. Null, empty and wordless texts have the fingerprint zero. Fingerprints link at
    ``distance`` or fewer differing bits, zero like any other; component_id is the smallest doc_id reachable, itself
    included. Equal fingerprints are one node, however many rows have them.

    Rows are linked by their fingerprints only, so rows that share a doc_id may be in different components. A null doc_id is
    never the smallest unless a component has no other. doc_id may be of any type with an order. Repeated rows give repeated
    rows, ties don't occur, texts of any length count in full, an empty table gives an empty table, and other columns are left
    out, whatever their names.
    """
    sketch = written(sketched(docs, size), "fingerprints")
    nodes = written(sketch.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = written(components(written(links(nodes, distance, parts, salts), "fingerprint-links")), "labels")
    named = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(named.select("fp", "label").join(least, "label").select("fp", "component_id"), "components")
    return sketch.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
