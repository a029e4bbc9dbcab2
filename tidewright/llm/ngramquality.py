"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are the bytes of a text, each told from every other, so a document's perplexity tells text of its language
from symbol soup, shouting, tables, other scripts and other letters, at any length. Counts are made and joined as tables
dealt by n-gram; a model of few n-grams is sent to the tasks that score texts, a larger one is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .common import Carried, lean, small, text_keys, written

ORDER = 4
CLASSES = 48
#: Characters at the language's mean that are added to each document, so short ones are judged mildly.
PRIOR = 100
#: The name of the model of all trusted text, for languages without one.
ANY = "\u0001all"
#: Trusted documents that a language needs for a model of its own.
LEAST_DOCS = 20
#: Languages whose models are sent to the executors at a time, and their rows (12 bytes each) together. The model of all, which
#: has the n-grams of every other, goes with them if it has no more rows; else n-grams of texts are joined with the model.
AT_ONCE, SENT_ROWS = 8, 2_000_000
#: Parts in which a language's model is laid out.
PIECES = 16
#: Bytes of text (or one longer text) that a task scores at a time; each takes some 80 bytes of memory meanwhile.
SCORED = 1 << 18
#: Costs are whole numbers of this part of a nat, so sums don't depend on their order.
_PART = 1 << 20


@dataclass(frozen=True, eq=False)
class Units:
    """What n-grams are made of: the unit of each byte (0 begins a text), the number of units, the highest order."""

    of: np.ndarray
    size: int
    order: int


def _classes() -> np.ndarray:
    """The class of each byte: 0 begins a text. These merge capitals, digits and the bytes of most scripts."""
    table = np.full(256, 47, np.int64)
    table[0x61:0x7B] = np.arange(1, 27)
    table[0x41:0x5B] = 27
    table[0xC0:] = 28
    table[0x80:0xC0] = 29 + np.arange(64) % 8
    table[0x30:0x3A] = 37
    for k, signs in ((38, b" \t"), (39, b"\n\r"), (40, b"."), (41, b","), (42, b"!?"), (43, b"|"), (44, b"#*$%&<>@"), (45, b"'-"), (46, b"\"():;/_=+")):
        table[list(signs)] = k
    return table


_CLASS = _classes()
#: Each byte is a unit; the order is one higher, as letters beyond ASCII take several bytes.
BYTES = Units(np.arange(1, 257), 257, ORDER + 1)
#: A small alphabet, whose n-grams can all be listed; no query has it.
CLASSED = Units(_CLASS, CLASSES, ORDER)


def _codes(block: textbytes.Block, units: Units) -> np.ndarray:
    """For each byte the number of the n-gram that ends with it; places before a text's begin count as unit 0."""
    c = units.of.astype(np.int16)[block.data]
    code = np.zeros(len(c), np.int64)
    for k in range(units.order - 1, -1, -1):
        code *= units.size
        code[k:] += c[: max(0, len(c) - k)]
    for k in range(units.order - 1):  # what stands before a text is another text's
        at = block.starts[:-1] + k
        code[at[at < block.starts[1:]]] %= units.size ** (k + 1)
    return code


def ngram_counts(docs: DataFrame, units: Units = CLASSED) -> DataFrame:
    """(lang, code, n) of docs (lang, text): counts of n-grams of the highest order, summed per block, then per n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for block in textbytes.blocks(batch.column(1)):
                code = _codes(block, units)
                for lang in dict.fromkeys(langs[block.first : block.last]):
                    own = np.repeat([x == lang for x in langs[block.first : block.last]], np.diff(block.starts))
                    value, n = np.unique(code[own], return_counts=True)
                    if len(value):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value), pa.array(n)], ["lang", "code", "n"])

    each = lean(docs.select("lang", "text")).mapInArrow(run, "lang string, code long, n long")
    return each.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, units: Units = CLASSED) -> DataFrame:
    """The model (lang, order, code, p, back) from counts of the highest order.

    p is the interpolated probability of an n-gram seen, null for rows that only hold a context; back is the weight
    that a context of ``order`` units gives to the next lower order. Orders below the highest count the distinct
    n-grams that continue to the left. Each order's counts, contexts and lower order are joined as tables dealt by
    n-gram; discounts come from the counts of counts of each language.
    """
    tables = {units.order: written(counts, "ngrams")}
    for k in range(units.order - 1, 0, -1):
        shorter = tables[k + 1].select("lang", (F.col("code") % units.size**k).alias("code"))
        tables[k] = written(shorter.groupBy("lang", "code").agg(F.count("*").alias("n")), "ngrams")
    model, lower = None, None
    for k in range(1, units.order + 1):
        grams = tables[k]
        of = lambda j: F.count_if(F.col("n") == j).cast("double")  # noqa: B023, E731
        sums = grams.groupBy("lang").agg(*[of(j).alias(f"t{j}") for j in (1, 2, 3, 4)])
        y = F.coalesce(F.col("t1") / F.nullif(F.col("t1") + 2 * F.col("t2"), F.lit(0.0)), F.lit(0.5))
        least = lambda j: F.greatest(F.lit(0.1), F.least(F.lit(float(j) - 0.1), F.coalesce(j - (j + 1) * y * F.col(f"t{j + 1}") / F.nullif(F.col(f"t{j}"), F.lit(0.0)), F.lit(j / 2))))  # noqa: B023, E731
        sums = small(written(sums.select("lang", *[least(j).alias(f"d{j}") for j in (1, 2, 3)]), "discounts"))
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = grams.join(sums, "lang").withColumns({"discount": discount, "context": F.floor(F.col("code") / units.size).cast("long")})
        contexts = written(
            rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("discount") / F.sum("n")).alias("back")), "contexts"
        )
        rows = rows.join(contexts, ["lang", "context"]).withColumn("own", (F.col("n") - F.col("discount")) / F.col("total"))
        if lower is None:
            rows = rows.withColumn("p", F.col("own") + F.col("back") / units.size)
        else:
            under = lower.select("lang", F.col("code").alias("rest"), F.col("p").alias("p_rest"))
            rows = rows.withColumn("rest", F.col("code") % units.size ** (k - 1)).join(under, ["lang", "rest"])
            rows = rows.withColumn("p", F.col("own") + F.col("back") * F.col("p_rest"))
        lower = written(rows.select("lang", "code", "p"), "probabilities")
        part = lower.select("lang", F.lit(k).alias("order"), "code", "p", F.lit(None).cast("double").alias("back")).union(
            contexts.select("lang", F.lit(k - 1), "context", F.lit(None).cast("double"), "back")
        )
        model = part if model is None else model.union(part)
    return written(model, "kneser-ney")


class Layout:
    """The costs (-log p) of a model's n-grams: for each order its n-grams and contexts by number, other n-grams by their lower order."""

    def __init__(self, size: int, grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.size, self.grams, self.contexts = size, grams, contexts

    @classmethod
    def of(cls, model: pd.DataFrame, units: Units = CLASSED) -> Layout:
        """From one language's rows (order, code, p, back) of kneser_ney()."""

        def costs(k: int, value: str) -> tuple[np.ndarray, np.ndarray]:
            rows = model[(model["order"] == k) & model[value].notna()].sort_values("code")
            return rows["code"].to_numpy(np.int64), np.rint(-np.log(rows[value].to_numpy(np.float64)) * _PART).astype(np.int32)

        return cls(units.size, [costs(k, "p") for k in range(1, units.order + 1)], [costs(k, "back") for k in range(units.order)])

    def packed(self) -> bytes:
        tables = [x for pair in zip(self.grams, self.contexts, strict=True) for x in pair]
        head = np.array([self.size, len(self.grams), *[len(code) for code, _ in tables]], np.int64)
        return b"".join(x.tobytes() for x in (head, *[x for table in tables for x in table]))

    @classmethod
    def unpacked(cls, raw: bytes) -> Layout:
        size, order = np.frombuffer(raw, np.int64, 2).tolist()
        at, tables = 8 * (2 + 2 * order), []
        for n in np.frombuffer(raw, np.int64, 2 * order, 16).tolist():
            tables.append((np.frombuffer(raw, np.int64, n, at), np.frombuffer(raw, np.int32, n, at + 8 * n)))
            at += 12 * n
        return cls(size, tables[::2], tables[1::2])

    @classmethod
    def whole(cls, pieces: list[Layout]) -> Layout:
        """The layout of a model from layouts of disjoint parts of its rows."""

        def joined(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            code, cost = (np.concatenate(x) for x in zip(*tables, strict=True))
            at = np.argsort(code)
            return code[at], cost[at]

        grams, contexts = (list(map(joined, zip(*x, strict=True))) for x in ([p.grams for p in pieces], [p.contexts for p in pieces]))
        return cls(pieces[0].size, grams, contexts)

    def cost(self, code: np.ndarray) -> np.ndarray:
        """-log p of each n-gram of the highest order."""
        total, left = np.zeros(len(code), np.int64), np.arange(len(code))
        for k in range(len(self.grams), 0, -1):
            gram = code[left] % self.size**k
            seen, cost = _looked_up(self.grams[k - 1], gram)
            total[left] += cost
            left, gram = left[~seen], gram[~seen]
            total[left] += _looked_up(self.contexts[k - 1], gram // self.size)[1]
        total[left] += round(math.log(self.size) * _PART)
        return total / _PART


def _looked_up(table: tuple[np.ndarray, np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code is in an ordered table, and its cost, else 0."""
    codes, costs = table
    if not len(codes):
        return np.zeros(len(code), bool), np.zeros(len(code), np.int64)
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    seen = codes[at] == code
    return seen, np.where(seen, costs[at], 0)


class _Sent:
    """Packed models on their way to a task, where they are unpickled as whole layouts; the pieces aren't held beside them."""

    def __init__(self, packed: dict[str, list[bytes]]) -> None:
        self.packed = packed

    def __reduce__(self) -> tuple:
        return _whole, (self.packed,)


def _whole(packed: dict[str, list[bytes]]) -> dict[str, Layout]:
    return {lang: Layout.whole(list(map(Layout.unpacked, raw))) for lang, raw in packed.items()}


def layouts(model: DataFrame, units: Units = CLASSED) -> DataFrame:
    """(lang, layout) of a model of at most SENT_ROWS rows a language, each language's rows in PIECES layouts."""

    def lay(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "layout": [Layout.of(rows, units).packed()]})

    piece = F.pmod(F.xxhash64("order", "code"), F.lit(PIECES)).alias("piece")
    return written(model.groupBy("lang", piece).applyInPandas(lay, "lang string, layout binary"), "quality-layouts")


def perplexities(docs: DataFrame, model: DataFrame, units: Units = CLASSED) -> DataFrame:
    """Per row of docs (doc_id, lang, text): doc_id, lang, t1, t2 (the text's keys), n (bytes), nll and any_nll.

    These are the sums of -log p by the language's own model and by the model of all. If the latter, the largest, has at
    most SENT_ROWS rows, it is sent to the executors with at most AT_ONCE languages of SENT_ROWS rows together; documents of
    further languages are scored in further rounds, so any number of languages fits. A larger model is joined with the
    n-grams of texts.
    """
    rows = docs.select("doc_id", "lang", *text_keys(F.col("text")), "text")
    sizes = {x["lang"]: x["count"] for x in model.groupBy("lang").count().collect()}
    if sizes.pop(ANY, 0) > SENT_ROWS:
        return _joined(rows, model, units)
    tables = layouts(model, units)
    langs, rounds, scored = sorted(sizes), [[]], None
    for lang in langs:
        if rounds[-1] and (len(rounds[-1]) >= AT_ONCE or sum(sizes[x] for x in [*rounds[-1], lang]) > SENT_ROWS):
            rounds.append([])
        rounds[-1].append(lang)
    for k, some in enumerate(rounds):
        chosen = rows
        if len(rounds) > 1:
            mine = F.coalesce(F.col("lang").isin(some), F.lit(False))
            chosen = rows.where(mine | ~F.coalesce(F.col("lang").isin(langs), F.lit(False)) if k == 0 else mine)
        packed: dict[str, list[bytes]] = {}
        for x in tables.where(F.col("lang").isin([ANY, *some])).collect():
            packed.setdefault(x["lang"], []).append(bytes(x["layout"]))
        found = _scored(chosen, packed, units)
        scored = found if scored is None else scored.union(found)
    return scored


def _scores(batch: pa.RecordBatch, tables: dict[str, Layout], units: Units) -> Iterator[pa.RecordBatch]:
    """Of a batch of (doc_id, lang, t1, t2, text) all but the text, n, nll and any_nll, SCORED bytes of text at a time."""
    langs = batch.column(1).to_pylist()
    for block in textbytes.blocks(batch.column(4), SCORED):
        own = [x if x in tables else ANY for x in langs[block.first : block.last]]
        size = np.diff(block.starts)
        totals = {"own": np.zeros(len(own)), ANY: np.zeros(len(own))}
        if len(block.data) and tables:
            at, code = pd.factorize(_codes(block, units))
            which = np.array(own)
            for lang in dict.fromkeys([*own, ANY]):
                mine = which == lang if lang != ANY else np.ones(len(own), bool)
                places = at if mine.all() else at[np.repeat(mine, size)]
                used = np.flatnonzero(np.bincount(places, minlength=len(code)))
                cost = np.zeros(len(code))
                cost[used] = tables[lang].cost(code[used])
                sums = np.concatenate([[0.0], np.cumsum(cost[places])])
                ends = np.cumsum(size[mine])
                total = sums[ends] - sums[ends - size[mine]]
                if lang == ANY:
                    totals[ANY] = total
                totals["own"][which == lang] = total[which[mine] == lang]
        n = block.last - block.first
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k).slice(block.first, n) for k in range(4)], pa.array(size), *map(pa.array, totals.values())],
            ["doc_id", "lang", "t1", "t2", "n", "nll", "any_nll"],
        )


def _scored(docs: DataFrame, packed: dict[str, list[bytes]], units: Units) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(_Sent(packed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _scores(batch, sent.value, units)

    return lean(docs).mapInArrow(run, "doc_id long, lang string, t1 long, t2 long, n long, nll double, any_nll double")


def _joined(docs: DataFrame, model: DataFrame, units: Units) -> DataFrame:
    """_scored() for a model of any size: the n-grams of each different text are joined with each order's table."""
    names = small(written(model.select(F.col("lang").alias("own")).distinct(), "models"))
    docs = docs.join(names, F.col("lang") == F.col("own"), "left").withColumn("own", F.coalesce("own", F.lit(ANY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textbytes.blocks(batch.column(3)):
                code = _codes(block, units)
                for k in range(block.last - block.first):
                    value, n = np.unique(code[block.starts[k] : block.starts[k + 1]], return_counts=True)
                    if len(value):
                        key = [pa.array(batch.column(x).slice(block.first + k, 1).to_pylist() * len(value), batch.column(x).type) for x in range(3)]
                        yield pa.RecordBatch.from_arrays([*key, pa.array(value), pa.array(n)], ["own", "t1", "t2", "code", "times"])

    texts = lean(docs.select("own", "t1", "t2", "text").dropDuplicates(["own", "t1", "t2"]))
    grams = written(texts.mapInArrow(run, "own string, t1 long, t2 long, code long, times long"), "text-ngrams")
    grams = grams.withColumn("of", F.explode(F.array_distinct(F.array("own", F.lit(ANY)))))
    costs, cost = grams.select("of", "code").distinct(), F.lit(round(math.log(units.size) * _PART))
    whole = lambda p: F.rint(-F.log(p) * _PART).cast("long")
    for k in range(1, units.order + 1):
        seen = model.where((F.col("order") == k) & F.col("p").isNotNull()).select(F.col("lang").alias("of"), F.col("code").alias(f"gram{k}"), whole("p").alias(f"cost{k}"))
        contexts = model.where((F.col("order") == k - 1) & F.col("back").isNotNull()).select(F.col("lang").alias("of"), F.col("code").alias(f"context{k}"), whole("back").alias(f"back{k}"))
        costs = costs.withColumn(f"gram{k}", F.col("code") % units.size**k).withColumn(f"context{k}", F.floor(F.col(f"gram{k}") / units.size).cast("long"))
        costs = costs.join(seen, ["of", f"gram{k}"], "left").join(contexts, ["of", f"context{k}"], "left")
        cost = F.coalesce(F.col(f"cost{k}"), F.coalesce(F.col(f"back{k}"), F.lit(0)) + cost)
    costs = written(costs.select("of", "code", cost.alias("cost")), "text-costs")
    totals = grams.join(costs, ["of", "code"]).groupBy("of", "own", "t1", "t2").agg((F.sum(F.col("times") * F.col("cost")) / _PART).alias("nll"))
    totals = written(totals, "text-totals")
    own = totals.where(F.col("of") == F.col("own")).drop("of")
    every = totals.where(F.col("of") == ANY).select("own", "t1", "t2", F.col("nll").alias("any_nll"))
    found = docs.withColumn("n", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).drop("text")
    found = found.join(own, ["own", "t1", "t2"], "left").join(every, ["own", "t1", "t2"], "left")
    return found.select("doc_id", "lang", "t1", "t2", "n", F.coalesce("nll", F.lit(0.0)).alias("nll"), F.coalesce("any_nll", F.lit(0.0)).alias("any_nll"))


def train(docs: DataFrame, trusted: DataFrame, least: int = LEAST_DOCS, **units: Units) -> DataFrame:
    """The model of all texts of trusted doc_ids, and of each language that has ``least`` of them; ``units`` if not CLASSED."""
    chosen = written(trusted, "trusted-ids")
    rows = docs.select("doc_id", "lang", "text").join(small(chosen.withColumnRenamed("doc_id", "_trusted")), F.col("doc_id") == F.col("_trusted")).select("lang", "text")
    langs = rows.groupBy("lang").count().where((F.col("count") >= least) & F.col("lang").isNotNull()).select("lang")
    counts = written(ngram_counts(rows, **units), "ngram-counts")
    every = counts.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(ANY).alias("lang"), "code", "n")
    return kneser_ney(counts.join(small(written(langs, "model-languages")), "lang").select("lang", "code", "n").union(every), **units)


def _half(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(2))


def classify(
    docs: DataFrame, labels: DataFrame, middle: float = 0.5, high: float = 0.98, slack: float = 2.0, units: Units = BYTES
) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, lang, t1, t2 (the text's keys), perplexity, threshold and kept.

    Documents with labels.quality 1 are trusted. Half of them (by crc32 of the id) train the model, the other half give
    each language's threshold: with scores the mean -log p of a document after PRIOR characters at the language's
    mean, it is the quantile ``middle`` plus ``slack`` times the distance to the quantile ``high``. perplexity and
    threshold are exponentials of these. A document is rejected if it is above its language's threshold and, by the
    model of all languages, above the threshold of all; so clean text of another language or of several passes.

    A language with fewer than LEAST_DOCS trusted documents, or null, has the model and threshold of all. Null and empty
    texts have the mean's perplexity and are kept, as are all without any trusted text; texts of any length count whole.
    Rows are judged each by its own text, also under a null or repeated doc_id (all texts of a trusted id train), and
    repeated rows alike; a score at the threshold is kept. Empty tables give an empty result; other columns, whatever
    their names, are left out.
    """
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    model = train(docs, trusted.where(_half(F.col("doc_id")) == 0), units=units)
    scored = written(perplexities(docs, model, units), "perplexities")
    own = model.select("lang").distinct()
    of = scored.join(small(written(own, "models").withColumnRenamed("lang", "_lang")), F.col("lang") == F.col("_lang"), "left")
    of = of.withColumn("_lang", F.coalesce("_lang", F.lit(ANY)))
    test = of.join(trusted.where(_half(F.col("doc_id")) == 1), "doc_id").where("n > 0")
    test = test.select(F.col("_lang").alias("lang"), "n", "nll").where(F.col("lang") != ANY).union(test.select(F.lit(ANY), "n", "any_nll"))
    smooth = lambda nll, mean: (F.col(nll) + PRIOR * F.col(mean)) / (F.col("n") + PRIOR)
    means = small(written(test.groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean")), "quality-means"))
    rated = test.join(means, "lang").withColumn("s", smooth("nll", "mean"))
    limits = rated.groupBy("lang").agg(F.first("mean").alias("mean"), F.percentile_approx("s", [middle, high], 100_000).alias("q"))
    limits = limits.select(F.col("lang").alias("_of"), "mean", (F.col("q")[0] + slack * (F.col("q")[1] - F.col("q")[0])).alias("limit"))
    limits = small(written(limits, "quality-limits"))
    of_all = limits.where(F.col("_of") == ANY).select(F.col("mean").alias("any_mean"), F.col("limit").alias("any_limit"))
    found = of.join(limits, F.col("_lang") == F.col("_of"), "left").join(F.broadcast(of_all), F.lit(True), "left")  # of_all is one row
    found = found.withColumns({"mean": F.coalesce("mean", "any_mean"), "limit": F.coalesce("limit", "any_limit")})
    found = found.withColumns({"s": smooth("nll", "mean"), "t": smooth("any_nll", "any_mean")})
    good = (F.col("s") <= F.col("limit")) | (F.col("t") <= F.col("any_limit"))
    return found.select(
        "doc_id", "lang", "t1", "t2", F.exp("s").alias("perplexity"), F.exp("limit").alias("threshold"), F.coalesce(good, F.lit(True)).alias("kept")
    )


def trusted_like(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, whatever their names; see classify() for all cases."""
    bad = classify(docs, labels).where("not kept").select(*[F.col(c).alias(f"_{c}_bad") for c in ("doc_id", "lang", "t1", "t2")]).distinct()
    carried = Carried(docs, "doc_id", "text", "lang")
    keyed = carried.df.withColumns(dict(zip(("_t1_own", "_t2_own"), text_keys(F.col("text")), strict=True)))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id_bad")) & F.col("lang").eqNullSafe(F.col("_lang_bad"))
    same = same & (F.col("_t1_own") == F.col("_t1_bad")) & (F.col("_t2_own") == F.col("_t2_bad"))
    return carried.back(keyed.join(small(written(bad, "rejected")), same, "left_anti").drop("_t1_own", "_t2_own"))
