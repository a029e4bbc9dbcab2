"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes
from .common import lean

# The base patterns, in the order of their kinds, with the least length of what each has to match.
ASSIGN = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Characters of an identifier (= only at its end), the shortest one judged, and the mean log-likelihood ratio a character
#: above which it is random: between the two labels' tails on held-out samples.
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LEAST_RANDOM = 20
MEAN_RATIO = 0.6
#: Different transitions that are enough evidence at any length.
ENOUGH = 64
#: Weight of a character's own frequency in its frequency after another (back-off).
BACK = 20.0
#: Labelled samples that the standing model is trained from.
SAMPLES = 24_000

# Chosen words of the made-up identifiers: common in code and in prose of four languages.
_WORDS = """
access account action active address amount application array author average background balance batch between branch
buffer build button cache calendar change channel character check client color column command comment config connection
container content context control convert count country create current customer data database date default delete
description detail device directory document download duration element error event example export extension feature
field file filter first folder format function generate group handler header height history identifier image import
index information input instance integer interface internal language last length level library license line link list
location login machine manager maximum member memory message method minimum model module monitor name network number
object offset operation option order output package page parameter parent password path pattern payment percent
position previous price process product profile project property protocol provider query queue range record region
remote report request resource response result return review schedule schema screen search section security selection
arbeit zeitung verbindung schreiben gesellschaft wirtschaft freiheit leitung einheit erfahrung geschichte entwicklung
maison travail toujours gouvernement nouvelle question developpement pendant ensemble maintenant quelque chose
trabajo gobierno informacion desarrollo ciudad siempre entonces nosotros mientras proyecto palabra cuenta
""".split()

_ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "abcdefghijklmnopqrstuvwxyz",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)

_CLASS = np.zeros(256, np.int64)
for _n, _c in enumerate(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", 1):
    _CLASS[_c] = _n
_N = 68
_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_KEYWORD = re.compile(rb"(?i)passw|secret|token|api_?key")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of all base matches, leftmost and non-overlapping within a kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _suspects(block: textbytes.Block) -> np.ndarray:
    """Texts of a block that may hold a span; all others hold none."""
    raw = block.data.tobytes()
    at = [np.fromiter((m.start() for m in re.finditer(b"AKIA", raw)), np.int64)]
    if b"=" in raw or b":" in raw:
        at.append(np.fromiter((m.start() for m in _KEYWORD.finditer(raw)), np.int64))
    for mask, least in ((_HEX[block.data], LEAST["hex"]), (_CLASS[block.data] > 0, LEAST_RANDOM)):
        begin, end = textbytes.runs(mask, block.starts)
        at.append(begin[end - begin >= least])
    return np.unique(np.searchsorted(block.starts, np.concatenate(at), "right") - 1)


def _pairs(value: bytes) -> np.ndarray:
    """Numbers of the transitions of a string, from its begin (class 0) on."""
    c = np.concatenate([[0], _CLASS[np.frombuffer(value, np.uint8)]])
    return c[:-1] * _N + c[1:]


def sample(number: int) -> tuple[str, int]:
    """A made-up string and its label: 1 for a random one, 0 for an identifier of words, digits and signs."""
    rnd = random.Random(number)
    if number % 2:
        return "".join(rnd.choices(_ALPHABETS[number // 2 % len(_ALPHABETS)], k=rnd.randint(20, 64))), 1
    words = [rnd.choice(_WORDS) for _ in range(rnd.randint(2, 7))]
    style = rnd.randrange(8)
    if style == 0:
        words = [w.capitalize() for w in words]
        words[0] = words[0].lower() if rnd.random() < 0.5 else words[0]
    elif style == 1:
        words = [w.upper() for w in words]
    if rnd.random() < 0.4:
        at = rnd.randrange(len(words) + 1)
        words.insert(at, rnd.choice((str(rnd.randrange(100)), f"v{rnd.randrange(10)}", f"{rnd.randint(1990, 2040)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", str(rnd.randrange(10**6)), "0" * rnd.randint(1, 8))))
    return rnd.choice({0: [""], 1: ["_"], 2: [""], 3: ["_"], 4: ["-"], 5: ["/"]}.get(style, ["", "_", "-", "/"])).join(words), 0


def samples(spark: SparkSession, first: int = 0, n: int = SAMPLES) -> DataFrame:
    """Labelled samples (value, label), the same for the same numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sample(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int32())], ["value", "label"])

    return spark.range(first, first + n, numPartitions=4).mapInArrow(run, "value string, label int")


def train(labelled: DataFrame) -> np.ndarray:
    """log P(next | last, random) - log P(next | last, identifier), from labelled samples (value, label 0 or 1).

    Transitions are counted in each task, then over at most 2 * 68**2 groups, which come to the driver. A transition's
    probability backs off to its character's, and that to equal ones, so unseen transitions cost no more than rare ones.
    Null values and labels count nothing; without samples all ratios are 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _N * _N), np.int64)
        for batch in batches:
            for value, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[label] += np.bincount(_pairs(value.encode()), minlength=_N * _N)
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(total[label, pair], pa.int64())], ["label", "pair", "n"])

    known = labelled.where("value IS NOT NULL AND label IN (0, 1)").select("value", F.col("label").cast("int"))
    both = np.zeros((2, _N, _N))
    for label, pair, n in known.mapInArrow(run, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n")).collect():
        both[label, pair // _N, pair % _N] = n
    own = both.sum(1) + 0.5
    own /= own.sum(1, keepdims=True)
    p = (both + BACK * own[:, None, :]) / (both.sum(2, keepdims=True) + BACK)
    return (np.log(p[1]) - np.log(p[0])).ravel()


def mean_ratio(value: str, ratio: np.ndarray) -> float:
    """The log-likelihood ratio of a string, a character.

    Each different transition counts once, so rules and fillers such as a line of dashes have little to show for their length.
    """
    pairs = np.unique(_pairs(value.encode()))
    return float(ratio[pairs].sum() / max(len(pairs), min(len(value), ENOUGH)))


def random_spans(text: str, ratio: np.ndarray) -> list[tuple[str, int, int]]:
    """Identifiers of LEAST_RANDOM characters or more that the model of random strings explains better."""
    long_ = (m for m in IDENTIFIER.finditer(text) if m.end() - m.start() >= LEAST_RANDOM)
    return [("random", *m.span()) for m in long_ if mean_ratio(m[0], ratio) > MEAN_RATIO]


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): n_assign, n_access, n_hex, base_sha256, spans and n_random.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; of one kind they don't overlap, so
    there are no ties. Base spans always stay. The models, trained from ``labelled`` (value, label; samples() by default)
    and not from docs, add the identifiers that look random as spans of kind random, inside base spans as well. Null and
    empty texts have none (the sha256 of the empty text); texts of any length are searched whole. Other columns,
    whatever their names, are left out, repeated rows stay, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(samples(spark) if labelled is None else labelled))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            for block in textbytes.blocks(batch.column(1)):
                n = block.last - block.first
                numbers = np.zeros((4, n), np.int64)
                sums, spans = [nothing] * n, [""] * n
                for k in _suspects(block).tolist():
                    text = block.data[block.starts[k] : block.starts[k + 1]].tobytes().decode()
                    base = base_spans(text)
                    more = random_spans(text, sent.value)
                    for kind, _, _ in base + more:
                        numbers[KINDS.index(kind), k] += 1
                    sums[k] = hashlib.sha256(show(base).encode()).hexdigest()
                    spans[k] = show(sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]))))
                columns = [batch.column(0).slice(block.first, n), *[pa.array(x) for x in numbers[:3]], pa.array(sums), pa.array(spans), pa.array(numbers[3])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return lean(docs.select("doc_id", "text")).mapInArrow(run, kinds)
