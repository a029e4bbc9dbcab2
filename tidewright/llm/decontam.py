"""Benchmark decontamination on templates: typed placeholders for numbers, names and units, and consistent slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, small, text_keys, written

#: Tokens in a window, and how many of them have to be words of their own for a window to match by its template.
WINDOW = 8
LITERALS = 4
#: Items with fewer tokens match in their own words, wherever these stand.
TINY = 4
#: The share of an item's windows that a document has to hold, or so many of them (a passage of 20 tokens).
COVERAGE = 0.25
PASSAGE = 13
#: The share of slot pairs that has to be consistent, in each direction.
SLOTS = 0.5
#: The share of an item's plain words in one alignment from which it counts whatever its slots hold.
VERBATIM = 0.8

# Chosen values: words that are units when they follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yards", "miles", "mg", "g", "kg", "lb", "lbs", "oz",
    "ml", "l", "liters", "litres", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months",
    "years", "percent", "dollars", "euros", "cents", "usd", "eur", "mph", "kmh",
)

# Chosen values: capitalised words that are no names, as they begin sentences in English, German, French or Spanish.
OPENERS = (
    "The", "An", "In", "On", "At", "If", "When", "How", "What", "Which", "Who", "Where", "Why", "There", "This", "That",
    "These", "Those", "It", "He", "She", "They", "We", "You", "Is", "Are", "Was", "Were", "Do", "Does", "Did", "Can",
    "For", "From", "To", "Of", "And", "But", "Or", "So", "As", "By", "With", "After", "Before", "Then", "Each", "Every",
    "All", "Some", "Many", "Find", "Let", "Der", "Die", "Das", "Ein", "Eine", "Es", "Er", "Sie", "Wir", "Ich", "Und",
    "Aber", "Wenn", "Wie", "Was", "Wer", "Wo", "Warum", "Im", "Am", "Auf", "Mit", "Von", "Zu", "Für", "Nach", "Bei", "Aus",
    "Ist", "Dann", "Alle", "Le", "La", "Les", "Un", "Une", "Des", "Il", "Elle", "Nous", "Vous", "Je", "Et", "Mais", "Si",
    "Quand", "Comment", "Que", "Quel", "Quelle", "Qui", "Dans", "Sur", "Au", "De", "Du", "En", "Pour", "Par", "Avec", "Ce",
    "Cette", "El", "Los", "Las", "Una", "Se", "Son", "Del", "Al", "Pero", "Cuando", "Por", "Para", "Con", "Su", "Este",
)

NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
_NAME_MARK, _UNIT_MARK = "\u0001", "\u0002"


def tokens(text: Column) -> Column:
    """Words, numbers and units of a text; names and units begin with a mark.

    A name is a capitalised word of two letters or more, or several in a row, wherever it stands, unless the first is one
    of OPENERS; so one that begins a sentence is a name too. A unit is a word of UNITS after a number, or a sign such as %.
    Repeated groups are possessive: they match the same, but a greedy one takes stack for each repetition.
    """
    letters = r"[\p{L}\p{M}'-]"
    t = F.regexp_replace(text, "[\u0001\u0002]", " ")
    name = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}'-])(?!(?:{'|'.join(OPENERS)})(?!{letters}))(\p{{Lu}}{letters}+(?: \p{{Lu}}{letters}+)*+)"
    t = F.regexp_replace(t, name, f"{_NAME_MARK}$1")
    t = F.regexp_replace(t, rf"(?i)(?:(?<=\d)|(?<=\d ))({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"{_UNIT_MARK}$1")
    words = r"[\p{L}\p{M}]+"
    pattern = rf"{_NAME_MARK}{letters}+(?: \p{{Lu}}{letters}+)*+|{_UNIT_MARK}?{words}|\d+(?:[.,]\d+)*+|[%$€£°]"
    return F.coalesce(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def _placeholder(token: Column) -> Column:
    """The type of a token that fills a slot, else null."""
    return (
        F.when(token.startswith(_NAME_MARK), NAME)
        .when(token.startswith(_UNIT_MARK) | token.isin("%", "$", "€", "£", "°"), UNIT)
        .when(token.between("0", "9~"), NUMBER)
    )


def _template(token: Column) -> Column:
    return F.coalesce(_placeholder(token), F.lower(token))


def _same(mark: str) -> Column:
    """Whether a row's keys are those of the columns that begin with mark."""
    return F.col("doc_id").eqNullSafe(F.col(f"{mark}_doc_id")) & (F.col("t1") == F.col(f"{mark}_t1")) & (F.col("t2") == F.col(f"{mark}_t2"))


def _windows(parts: Column, size: int) -> Column:
    """The windows of ``size`` strings without spaces, in order, each as one string."""
    return F.regexp_extract_all(F.array_join(parts, " "), F.lit(f"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{size - 1}}}))"), F.lit(1))


def template_windows(text: Column, size: int = WINDOW) -> Column:
    """The windows of ``size`` tokens of a text's template, in order, each as one string."""
    return _windows(F.transform(tokens(text), _template), size)


def own_words(text: Column) -> Column:
    """The lower-case words, numbers and signs of a text, whether names and units or not."""
    pattern = r"[\p{L}\p{M}]+|\d+(?:[.,]\d+)*+|[%$€£°]"
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def phrases_found(own: DataFrame, benchmark: DataFrame, key: list[str], size: int) -> DataFrame | None:
    """key, item and item_id of the items with fewer than TINY tokens whose own words stand in a row in a text; None without such items.

    An item is known by all its windows of ``size`` words (or all its words, if fewer), which have to stand in one alignment.
    """
    rows = benchmark.where(F.size(tokens(F.col("text"))).between(1, min(TINY, size) - 1))
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", own_words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    rows = rows.withColumn("k", F.least(F.size("w"), F.lit(size))).withColumn("need", F.size("w") - F.col("k") + 1)
    slices = F.transform(F.sequence(F.lit(0), F.col("need") - 1), lambda p: F.array_join(F.slice("w", p + 1, F.col("k")), " "))
    phrases = written(rows.select("item", "item_id", "k", "need", F.posexplode(slices).alias("item_place", "phrase")), "benchmark-phrases")
    sizes = sorted(k for (k,) in phrases.select("k").distinct().collect())  # at most ``size`` of them
    seen = None
    for k in sizes:
        windows = own.select(*key, F.posexplode(_windows(own_words(F.col("text")), k)).alias("place", "window"))
        seen = windows if seen is None else seen.union(windows)
    if seen is None:
        return None
    hits = seen.join(small(phrases), F.col("window") == F.col("phrase"))
    aligned = hits.groupBy(*key, "item", "item_id", "need", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.countDistinct("item_place").alias("n"))
    return aligned.where(F.col("n") == F.col("need")).select(*key, "item", "item_id").distinct()


def item_windows(benchmark: DataFrame, size: int, literals: int) -> DataFrame:
    """The windows that benchmark items are known by: item, item_id, item_place, item_window, item_slice, rich, k, item_hash,
    item_plain (the places of the window's plain words in the item) and item_words (how many the item has).

    An item of ``size`` tokens or more has its rich windows, with ``literals`` plain words at least, or without any all its
    windows, which then have to match in their own words. A shorter item has one window of all its k tokens; those with fewer
    than TINY tokens have none here (see phrases_found).
    """
    rows = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", tokens(F.col("text")).alias("t"))
    rows = rows.where(F.size("t") >= min(TINY, size)).distinct()
    rows = rows.withColumns({"k": F.least(F.size("t"), F.lit(size)), "template": F.transform("t", _template)})
    plain_places = F.filter(F.transform("template", lambda x, n: F.when(~x.isin(NUMBER, NAME, UNIT), n)), lambda n: n.isNotNull())
    rows = rows.withColumn("plain_places", plain_places).withColumn("item_words", F.size("plain_places"))
    places = F.sequence(F.lit(0), F.size("t") - F.col("k"))
    slices = F.transform(places, lambda p: F.array_join(F.slice("template", p + 1, F.col("k")), " "))
    rows = rows.select("item", "item_id", "k", "t", "plain_places", "item_words", F.posexplode(slices).alias("item_place", "item_window"))
    inside = lambda n: (n >= F.col("item_place")) & (n < F.col("item_place") + F.col("k"))
    rows = rows.withColumn("item_plain", F.filter("plain_places", inside)).drop("plain_places")
    plain = F.size(F.filter(F.split("item_window", " "), lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    rows = rows.withColumns({"rich": plain >= literals, "item_slice": F.slice("t", F.col("item_place") + 1, F.col("k")), "item_hash": F.xxhash64("item_window")})
    rows = rows.drop("t").withColumn("any_rich", F.max("rich").over(Window.partitionBy("item")))
    return rows.where(F.col("rich") | ~F.col("any_rich")).drop("any_rich")


def _templates_found(
    own: DataFrame, seen: DataFrame, items: DataFrame, key: list[str], coverage: float, slots_share: float, passage: int, verbatim: float
) -> DataFrame:
    """key, item, item_id, item_windows and n (its windows that a text holds) of the items that count in a text, by their templates."""
    windows = items.groupBy("item").agg(F.count("*").alias("item_windows"))
    keys = small(written(items.select("item_hash", "item_window").distinct(), "benchmark-keys"))
    hits = seen.join(keys, (F.xxhash64("window") == F.col("item_hash")) & (F.col("window") == F.col("item_window")))
    hits = written(hits.select(*key, "place", "item_hash", "item_window").distinct(), "window-hits")
    matched = hits.join(small(items), ["item_hash", "item_window"]).withColumn("shift", F.col("place") - F.col("item_place"))
    enough = lambda n: (n >= coverage * F.col("item_windows")) | (n >= passage)
    covered = matched.groupBy(*key, "item").agg(F.countDistinct("item_place").alias("n"))
    covered = covered.join(small(written(windows, "benchmark-items")), "item").where(enough(F.col("n")))
    covered = written(covered.select(*[F.col(c).alias(f"c_{c}") for c in key], F.col("item").alias("c_item"), "item_windows"), "covered")

    suspects = small(written(covered.select(*[F.col(f"c_{c}").alias(f"s_{c}") for c in key]).distinct(), "suspects"))
    texts = own.join(suspects, _same("s")).select("s_doc_id", "s_t1", "s_t2", "text").distinct().withColumn("doc_tokens", tokens(F.col("text"))).drop("text")
    aligned = matched.join(covered, _same("c") & (F.col("item") == F.col("c_item"))).join(texts, _same("s"))
    aligned = aligned.withColumn("doc_slice", F.slice("doc_tokens", F.col("place") + 1, F.col("k")))
    lower = lambda tokens_: F.transform(tokens_, F.lower)
    aligned = aligned.where(F.col("rich") | (lower(F.col("item_slice")) == lower(F.col("doc_slice"))))
    pairs = F.zip_with("item_slice", "doc_slice", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    group = [*key, "item", "item_id", "item_windows"]
    of = [*group, "item_words", "shift"]
    slots = aligned.select(*of, "item_place", "item_plain", F.explode_outer(F.filter(pairs, lambda x: _placeholder(x["i"]).isNotNull())).alias("slot"))
    one = F.when(F.col("slot").isNotNull(), F.concat_ws("\u0000", _placeholder(F.col("slot.i")), "slot.i"))
    other = F.when(F.col("slot").isNotNull(), F.concat_ws("\u0000", _placeholder(F.col("slot.i")), "slot.d"))
    checked = slots.select(*of, "item_place", "item_plain", one.alias("one"), other.alias("other")).groupBy(*of).agg(
        F.collect_set("item_place").alias("places"), F.size(F.array_distinct(F.flatten(F.collect_set("item_plain")))).alias("words"),
        F.countDistinct("one").alias("ones"), F.countDistinct("other").alias("others"), F.countDistinct("one", "other").alias("pairs"),
        F.countDistinct(F.when(F.col("one") == F.col("other"), F.col("one"))).alias("same"),
        F.countDistinct(F.when(F.col("one") != F.col("other"), F.col("one"))).alias("changed"),
    )
    least = F.col("pairs") * slots_share
    consistent = (F.col("ones") >= least) & (F.col("others") >= least) & (F.col("same") + F.col("changed") <= F.col("ones"))
    copied = (F.col("words") >= verbatim * F.col("item_words")) & (F.col("words") > 0)
    good = checked.where(consistent | copied)
    good = good.select(*group, F.explode("places").alias("item_place"))
    return good.groupBy(*group).agg(F.countDistinct("item_place").alias("n")).where(enough(F.col("n")))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    literals: int = LITERALS,
    coverage: float = COVERAGE,
    slots_share: float = SLOTS,
    passage: int = PASSAGE,
    verbatim: float = VERBATIM,
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, t1, t2 (the text's keys), contaminated, item_id, coverage, n_items.

    Windows of templates are joined to the benchmark's (item_id, text) on their hash and compared in full. Matches of
    a document and item are grouped by alignment (document place less item place). An alignment counts if its
    slots are consistent, and an item if its alignments together cover ``coverage`` of its windows, or ``passage`` of
    them, so inserted and dropped words don't hide it. Slots are consistent if, of the different pairs of an item's and a
    document's value, the different values are at least ``slots_share`` on either side, so the same question with other
    numbers or names counts, also if some are equal by chance on one side only. An item's value that is kept in one
    place and changed in another is inconsistent. An alignment that holds ``verbatim`` of the item's plain words counts
    whatever its slots, as it is a copy with some values changed; slots decide on what has fewer. item_id is that of the
    largest coverage, of ties the smallest id (null last), of any type with an order.

    Items with fewer than ``size`` tokens match as a whole: by template with ``literals`` plain words, else in their own
    words, as the windows of longer items do that have none with enough plain words. Items with fewer than TINY tokens match
    wherever their own words stand in a row, in any case, so an item of one word is in every text that has it.

    Rows are judged by their own text, so rows that share a doc_id, null too, don't affect each other; repeated rows are
    judged alike. Null and empty texts and items match nothing. Texts of any length are searched whole. Items with a null
    id count, with null as item_id. Empty tables give an empty result, an empty benchmark nothing contaminated. Other
    columns, whatever their names, are left out. Benchmark windows are broadcast if measured small; else both sides are
    dealt by hash.
    """
    items = written(item_windows(benchmark, size, literals), "benchmark-windows")
    sizes = sorted(k for (k,) in items.select("k").distinct().collect())  # at most ``size`` of them

    own = docs.select("doc_id", *text_keys(F.col("text")), "text")
    key = ["doc_id", "t1", "t2"]
    seen = None
    for k in sizes:
        rows = own.select(*key, F.posexplode(template_windows(F.col("text"), k)).alias("place", "window"))
        seen = rows if seen is None else seen.union(rows)
    phrases = phrases_found(own, benchmark, key, size)
    if seen is None and phrases is None:
        nothing = [F.lit(False).alias("contaminated"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id")]
        return own.select(*key, *nothing, F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("n_items"))
    parts = []
    if seen is not None:
        parts.append(_templates_found(own, seen, items, key, coverage, slots_share, passage, verbatim))
    if phrases is not None:
        parts.append(phrases.withColumns({"item_windows": F.lit(1).cast("long"), "n": F.lit(1).cast("long")}))
    good = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = F.min_by("item_id", F.struct((-F.col("n") / F.col("item_windows")).alias("a"), F.col("item_id").isNull().alias("b"), F.col("item_id").alias("c")))
    found = good.groupBy(*key).agg(best.alias("item_id"), F.max(F.col("n") / F.col("item_windows")).alias("coverage"), F.count("*").alias("n_items"))
    found = small(written(found.select(*[F.col(c).alias(f"f_{c}") for c in key], "item_id", "coverage", "n_items"), "contaminated"))
    return own.drop("text").join(found, _same("f"), "left").select(
        *key, F.col("n_items").isNotNull().alias("contaminated"), "item_id",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names; see contamination() for all cases."""
    bad = contamination(docs, benchmark).where("contaminated").select(*[F.col(c).alias(f"_{c}_bad") for c in ("doc_id", "t1", "t2")]).distinct()
    carried = Carried(docs, "doc_id", "text")
    keyed = carried.df.withColumns(dict(zip(("_t1_own", "_t2_own"), text_keys(F.col("text")), strict=True)))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id_bad")) & (F.col("_t1_own") == F.col("_t1_bad")) & (F.col("_t2_own") == F.col("_t2_bad"))
    return carried.back(keyed.join(small(written(bad, "bad-docs")), same, "left_anti").drop("_t1_own", "_t2_own"))
