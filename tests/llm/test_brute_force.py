"""Corpus operators against plain loops: repeated and null ids, equal hashes of old, templates, language models, learners."""

from __future__ import annotations

import math
import random
import unicodedata
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from test_operators import DOCS, LETTERS, WORD, labels, prose, word
from tokenizers import Tokenizer

import corpus_pipeline
from tidewright.llm import decontam, linefreq, mixing, neardup, ngramquality, secrets, sharding, textbytes, tokenfile, toxicity, urlfilter
from tidewright.llm.common import read

PAIR = "doc_id long, text string"


def thue_morse(n, letters):
    """A text and its complement: the sums of any polynomial hash modulo 2**64 are equal for both."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_hashes_tell_bytes_apart():
    texts = [*thue_morse(2048, "ab"), *thue_morse(4096, "xy"), "", "a", "a" * 8, "a" * 9, "a" * 64, "a" * 65, "a" * 64 + "b", "\x00", "\x00" * 2]
    block = next(textbytes.blocks(pa.array(texts)))
    for lane in (0, 1):
        found = textbytes.hashes(block, lane=lane)(block.starts[:-1], block.starts[1:])
        assert len(set(found.tolist())) == len(texts)
        again = next(textbytes.blocks(pa.array(["zz", *texts])))
        assert textbytes.hashes(again, lane=lane)(again.starts[1:-1], again.starts[2:]).tolist() == found.tolist()


def test_hashes_of_words_that_differ_in_one_byte():
    """Each place of a word in turn takes every byte: no two of these words may have one hash."""
    texts = ["x" * k + chr(c) + "y" * more for k in range(17) for c in range(0x21, 0x7F) for more in (0, 1, 9)]
    block = next(textbytes.blocks(pa.array(texts)))
    for lane in (0, 1):
        found = textbytes.hashes(block, lane=lane)(block.starts[:-1], block.starts[1:])
        assert len(set(found.tolist())) == len(set(texts))


# 1


def test_mix_with_null_and_repeated_ids(spark):
    rows = [(None, "x " * 40, "a") for _ in range(600)] + [(k, f"y{k} " * 40, "b") for k in range(600)]
    rows += [(7, "z " * 30, "b")] * 50 + [(8, "", "b"), (9, None, None), (9, "w " * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(6)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    taken, target = defaultdict(int), {}
    for x in got:
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
        assert x["taken"] <= 2 * x["size"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)


# 2


def rows_brute(rows, size, percent):
    """Per row (n_shingles, component_id, kept): links between rows' sets, and through ids."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTERS)
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            linked = sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
            same = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            if linked or same:
                parent[root(a)] = root(b)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        own = min(ids, default=None) if sets[k] else doc_id
        out.append((doc_id, len(sets[k]), own, doc_id is not None and doc_id == own))
    return Counter(out)


def test_near_duplicates_with_shared_ids(spark):
    rnd = random.Random(31)
    x, z = prose(rnd, 80), prose(rnd, 80)
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    a, b = thue_morse(2048, "ab")
    rows = [(5, x), (5, z), (7, near(x)), (8, near(z)), (9, None), (9, ""), (10, x), (10, x), (11, prose(rnd, 50)), (11, "one two")]
    rows += [(None, near(x)), (None, prose(rnd, 60)), (None, prose(rnd, 60)), (20, a), (21, b), (22, "one"), (23, "one two")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, PAIR), 3, 85).collect()
    assert Counter(map(tuple, got)) == rows_brute(rows, 3, 85)


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(32)
    x, z = prose(rnd, 80), prose(rnd, 80)
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(5, x, 1), (5, x, 2), (5, z, 3), (7, near(x), 4), (8, near(z), 5), (None, near(x), 6), (None, None, 7), (None, "", 8), (9, prose(rnd, 40), 9), (None, prose(rnd, 40), 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    found = [sorted(r["label"] for r in neardup.one_of_each(d, 5, 80).collect()) for d in (docs, docs.repartition(5))]
    assert found[0] == found[1]
    assert found[0] in ([1, 3, 7, 8, 9, 10], [2, 3, 7, 8, 9, 10])
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_near_duplicates_of_the_small_table(spark):
    docs = [tuple(x) for x in read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = neardup.near_duplicates(spark.createDataFrame(docs, PAIR), 3, 85).collect()
    assert Counter(map(tuple, got)) == rows_brute(docs, 3, 85)


# 3


def py_tokens(text):
    """The tokens, read a character at a time; shares the word lists with the module but none of its patterns."""
    t = text.replace("\u0001", " ").replace("\u0002", " ")
    is_ = lambda k, *kinds: 0 <= k < len(t) and unicodedata.category(t[k])[: len(kinds[0])] in kinds
    lettered = lambda k: is_(k, "L", "M") or 0 <= k < len(t) and t[k] in "'-"

    def end(k, part):
        while part(k):
            k += 1
        return k

    out, k = [], 0
    while k < len(t):
        j = end(k, lettered)
        if is_(k, "Lu") and j - k > 1 and not lettered(k - 1) and not is_(k - 1, "N") and t[k:j] not in decontam.OPENERS:
            while j + 2 < len(t) and t[j] == " " and is_(j + 1, "Lu") and lettered(j + 2):
                j = end(j + 1, lettered)
            out.append("\u0001" + t[k:j])
        elif is_(k, "L", "M"):
            j = end(k, lambda x: is_(x, "L", "M"))
            after_number = k > 0 and (t[k - 1].isdigit() or t[k - 1] == " " and k > 1 and t[k - 2].isdigit())
            out.append(("\u0002" if after_number and t[k:j].lower() in decontam.UNITS and not is_(j, "N") else "") + t[k:j])
        elif t[k].isdigit():
            j = end(k, lambda x: x < len(t) and (t[x].isdigit() or t[x] in ".," and x + 1 < len(t) and t[x + 1].isdigit()))
            out.append(t[k:j])
        else:
            j = k + 1
            out += [t[k]] if t[k] in "%$€£°" else []
        k = j
    return out


def kind(token):
    if token[0] == "\u0001":
        return "<name>"
    if token[0] == "\u0002" or token in "%$€£°":
        return "<unit>"
    return "<number>" if token[0].isdigit() else None


def contaminated(text, item, size=8):
    """Whether a document holds an item, by the docstring's rules in plain loops."""
    d, i = py_tokens(text or ""), py_tokens(item or "")
    k = min(size, len(i))
    if not i:
        return False
    if len(i) < 4:
        parts = lambda t: regex.findall(r"[[:alpha:]\p{M}]+|[0-9]+(?:[,.][0-9]+)*|[$°€£%]", t.lower())
        d, i = parts(text or ""), parts(item)
        return any(d[q : q + len(i)] == i for q in range(len(d) - len(i) + 1))
    plain = [n for n, x in enumerate(i) if kind(x) is None]
    form = lambda w: [kind(x) or x.lower() for x in w]
    places = range(len(i) - k + 1)
    rich = {p: sum(kind(x) is None for x in i[p : p + k]) >= 4 for p in places}
    known = [p for p in places if rich[p]] or list(places)
    shifts = defaultdict(list)
    for q in range(len(d) - k + 1):
        for p in known:
            if form(d[q : q + k]) == form(i[p : p + k]) and (rich[p] or [x.lower() for x in d[q : q + k]] == [x.lower() for x in i[p : p + k]]):
                shifts[q - p].append((p, q))
    covered = set()
    for hits in shifts.values():
        pairs = {(kind(x) + x, kind(x) + y) for p, q in hits for x, y in zip(i[p : p + k], d[q : q + k], strict=True) if kind(x)}
        ones, others = {x for x, _ in pairs}, {y for _, y in pairs}
        same, changed = {x for x, y in pairs if x == y}, {x for x, y in pairs if x != y}
        held = {n for p, _ in hits for n in plain if p <= n < p + k}
        consistent = 2 * len(ones) >= len(pairs) and 2 * len(others) >= len(pairs) and len(same) + len(changed) <= len(ones)
        if consistent or held and len(held) >= 0.8 * len(plain):
            covered |= {p for p, _ in hits}
    return len(covered) >= 0.25 * len(known) or len(covered) >= 13


def test_templates_against_loops(spark):
    rnd = random.Random(41)
    words = [word(rnd) for _ in range(12)]
    names, numbers = ["Alice", "Robert", "New York", "Zed"], ["3", "12", "300", "4.5"]

    def fill(n):
        return [rnd.choice(words) if rnd.random() < 0.6 else rnd.choice([rnd.choice(names), rnd.choice(numbers), rnd.choice(numbers) + " km", "The"]) for _ in range(n)]

    items = [(k, fill(rnd.choice([2, 3, 5, 7, 9, 15, 30, 60]))) for k in range(30)] + [(30, ["12"] * 12), (31, ["x"])]
    docs = []
    for _ in range(120):
        w = list(rnd.choice(items)[1])
        change = dict(zip([*names, *numbers], rnd.sample(names, len(names)) + rnd.sample(numbers, len(numbers)), strict=True)) if rnd.random() < 0.6 else {}
        w = [change.get(x, x) for x in w]
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = fill(1)[0]
        before, after = (fill(rnd.randrange(6)), fill(rnd.randrange(6))) if rnd.random() < 0.7 else ([], [])
        docs.append(" ".join([*before, *w, *after]))
    docs += [None, "", "x", "12 12 12 12 12 12 12 12 12 12 12 12"]
    rows = decontam.contamination(spark.createDataFrame(list(enumerate(docs)), PAIR), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    got = {x["doc_id"]: (x["contaminated"], x["n_items"]) for x in rows}
    want = {k: sum(contaminated(t, " ".join(w)) for _, w in items) for k, t in enumerate(docs)}
    assert got == {k: (n > 0, n) for k, n in want.items()}
    assert 20 < sum(n > 0 for n in want.values()) < 120


def test_misses_of_old_are_found(spark):
    item = "A train leaves Paris at 12 and travels 300 km toward the coast. How many km are left when Alice has counted 12 stations on the way?"
    items = [(1, item), (2, "What is 12 plus 30?"), (3, "Tom buys red apples for the party. Anna then eats two of the apples at home with him."), (4, None), (None, "")]
    docs = [(1, item), (1, "other words under the same id"), (None, "so he says " + item), (None, "and this has no id either"), (2, "What is 12 plus 30?"), (3, item.replace("12", "300")),
            (4, "Kim buys red apples for the party. Zoe then eats two of the apples at home with him."), (5, "What is 14 plus 31?"), (6, None)]
    rows = decontam.contamination(spark.createDataFrame(docs, PAIR), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((x["doc_id"], x["contaminated"]) for x in rows) == Counter({(1, True): 1, (1, False): 1, (None, True): 1, (None, False): 1, (2, True): 1, (3, True): 1, (4, True): 1, (5, False): 1, (6, False): 1})
    left = decontam.clean(spark.createDataFrame(docs, PAIR), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(left) == 4


def test_short_items_stand_anywhere_in_their_own_words(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "Prove Fermat theorem"), (3, "Name Ada Byron King Lovelace Noel Milbanke Gordon Wentworth"), (4, "12 km")]
    docs = [(1, "Question: Who wrote Hamlet? Answer: Shakespeare"), (2, "Q: Prove Fermat theorem"), (3, "Please Prove Fermat theorem. Now."), (4, "who wrote Macbeth, and Hamlet?"),
            (5, "they name Ada Byron King Lovelace Noel Milbanke Gordon Wentworth here"), (6, "they name Ada Byron King Lovelace Noel Milbanke Wentworth Gordon"), (7, "112 km, 12 kmh"), (8, "WHO WROTE\nHAMLET"), (9, None), (10, "")]
    rows = decontam.contamination(spark.createDataFrame(docs, PAIR), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x["doc_id"]: x["item_id"] for x in rows} == {1: 1, 2: 2, 3: 2, 4: None, 5: 3, 6: None, 7: None, 8: 1, 9: None, 10: None}
    assert {x["coverage"] for x in rows if x["contaminated"]} == {1.0}
    both = decontam.contamination(spark.createDataFrame(docs, PAIR), spark.createDataFrame([*items, (5, prose(random.Random(3), 30))], "item_id long, text string")).collect()
    assert sorted(map(tuple, both), key=str) == sorted(map(tuple, rows), key=str)


def test_slots_decide_where_few_words_are_kept(spark):
    """Each of two numbers stands twice; a copy may change one place of one, a part of the words with torn slots is none."""
    item = "At noon 12 ships sail with 30 men and 12 of them come back by night while 30 men stay on the far coast to trade with the old kings of that land for salt and cloth"
    torn = item.replace("12 ships", "15 ships").replace("30 men stay", "44 men stay")
    part = " ".join(torn.split()[:24])
    rows = decontam.contamination(spark.createDataFrame([(1, item), (2, torn), (3, part), (4, item.replace("12", "15"))], PAIR), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {x["doc_id"]: x["contaminated"] for x in rows} == {1: True, 2: True, 3: False, 4: True}


# 4


def test_line_verdicts_against_loops(spark):
    rnd = random.Random(51)
    shared = [prose(rnd, 9) for _ in range(6)]
    rows = []
    for k in range(260):
        host = rnd.choice(["a", "a", "b", None])
        lines = rnd.sample(shared, rnd.randrange(5)) + [prose(rnd, rnd.randrange(1, 12)) for _ in range(rnd.randrange(1, 9))]
        rnd.shuffle(lines)
        rows.append((k, "\n".join(lines), "en", host, 0))
    rows += [(900 + k, rows[3][1], "en", rows[3][3], 0) for k in range(30)] + [(990, None, "en", "a", 0), (991, "", "en", None, 0)]
    got = {x["doc_id"]: (x["n_common_words"], x["kept"]) for x in linefreq.apply_rules(spark.createDataFrame(rows, DOCS)).collect()}
    tidy = lambda x: " ".join(WORD.findall(regex.sub(r"\d+", "0", x).lower()))
    seen = defaultdict(set)
    for _, t, _, host, _ in rows:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                seen[host, tidy(line)].add(t)
    base = {x["doc_id"]: x["base_failed"] for x in linefreq.apply_rules(spark.createDataFrame(rows, DOCS)).select("doc_id", "base_failed").collect()}
    for k, t, _, host, _ in rows:
        lost = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if WORD.search(x) and len(seen[host, tidy(x)]) >= 20)
        assert got[k] == (lost, not base[k] and 100 * lost <= 70 * len(WORD.findall(t or "")))
    assert any(n and kept for n, kept in got.values())


# 5 and 8


def test_null_keys_spread_and_hosts_of_rules(spark):
    docs = spark.createDataFrame([(None, f"text {k % 300}") for k in range(600)] + [(1, "a"), (None, None)], PAIR)
    got = sharding.place(docs, "doc_id", ["a", "b", "c"], spread="text").collect()
    assert len({x["slot"] for x in got}) > 250 and len({(x["text"], x["slot"]) for x in got}) == len({x["text"] for x in got})
    rules = urlfilter.rule_table(spark, [("block", "Example.NET", "/")])
    assert urlfilter.judge(spark.createDataFrame([(1, "http://www.eXample.net/x")], "page_id long, url string"), rules).first()["verdict"] == "block"


# 6


def test_token_ids_of_texts_with_equal_sums(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    docs = [*enumerate(thue_morse(2048, "ab")), (None, "x y"), (None, "z"), (3, "same"), (3, "same"), (3, "other")]
    blocks = tokenfile.encode(spark.createDataFrame(docs, PAIR), path)
    got = sorted((x["start"], x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in tokenfile.decode(blocks).collect())
    import zlib

    crc = lambda t: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert Counter((d, c) for _, d, _, c in got) == Counter((d, crc(t)) for d, t in docs)
    assert [x[0] for x in got] == np.cumsum([0, *[x[2] for x in got[:-1]]]).tolist()
    assert [x[1] for x in got] == [None, None, 0, 1, 3, 3, 3]


# 7


def test_ftrl_against_plain_steps():
    rnd = np.random.default_rng(2)
    rows = [np.unique(rnd.integers(0, 50, 12)) for _ in range(60)]
    y = [int(3 in x) for x in rows]
    how = toxicity.Ftrl(l1=0.5, epochs=3)
    at, weight = toxicity.fit(rows, y, how)
    z, n = defaultdict(float), defaultdict(float)
    order, bias = np.random.default_rng(7), 1 << toxicity.BITS

    def w(i):
        l1 = 0.0 if i == bias else how.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for k in order.permutation(len(rows)).tolist():
            x = [*rows[k].tolist(), bias]
            now = {i: w(i) for i in x}
            g = 1 / (1 + math.exp(-sum(now.values()))) - y[k]
            for i in x:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha
                z[i] += g - sigma * now[i]
                n[i] += g * g
    want = {i: w(i) for i in [*range(50), bias] if w(i)}
    assert dict(zip(at.tolist(), weight.tolist(), strict=True)) == pytest.approx(want)
    assert want[3] > 0


# 9


def test_kneser_ney_against_plain_counts(spark):
    """Interpolated modified Kneser-Ney in plain fractions, and the sums that documents get."""
    rnd = random.Random(61)
    words = [word(rnd) for _ in range(30)]
    texts = [prose(rnd, 40, words).capitalize() + "." for _ in range(30)]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    model = ngramquality.train(docs, docs.select("doc_id"))
    got = {x["doc_id"]: (x["nll"], x["any_nll"]) for x in ngramquality.perplexities(docs, model).collect()}
    order, classes = ngramquality.ORDER, ngramquality.CLASSES
    grams = []
    for t in texts:
        c = [0] * (order - 1) + ngramquality._CLASS[np.frombuffer(t.encode(), np.uint8)].tolist()
        grams.append([tuple(c[k : k + order]) for k in range(len(c) - order + 1)])
    counts = {order: Counter(x for g in grams for x in g)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(x[1:] for x in counts[k + 1])
    discounts, totals, kinds = {}, {}, {}
    for k in range(1, order + 1):
        t = Counter(min(n, 4) for n in counts[k].values() if n <= 4)
        y = Fraction(t[1], t[1] + 2 * t[2]) if t[1] + 2 * t[2] else Fraction(1, 2)
        raw = [Fraction(j) - (j + 1) * y * Fraction(t[j + 1], t[j]) if t[j] else Fraction(j, 2) for j in (1, 2, 3)]
        discounts[k] = [max(0.1, min(j - 0.1, float(d))) for j, d in zip((1, 2, 3), raw, strict=True)]
        totals[k], kinds[k] = Counter(), defaultdict(float)
        for x, n in counts[k].items():
            totals[k][x[:-1]] += n
            kinds[k][x[:-1]] += discounts[k][min(n, 3) - 1]

    def p(x):
        if not x:
            return 1 / classes
        k, under = len(x), p(x[1:])
        total = totals[k][x[:-1]]
        if not total:
            return under
        n = counts[k][x]
        own = (n - discounts[k][min(n, 3) - 1]) / total if n else 0.0
        return own + kinds[k][x[:-1]] / total * under

    for k, g in enumerate(grams):
        want = -sum(math.log(p(x)) for x in g)
        assert got[k] == pytest.approx((want, want), rel=1e-4)


def plain_kneser_ney(train, texts, size, order):
    """The sums of -log p of texts by an interpolated modified Kneser-Ney model of single bytes, in plain loops."""
    grams = lambda t: [tuple(([0] * (order - 1) + [x + 1 for x in t.encode()])[k : k + order]) for k in range(len(t.encode()))]
    counts = {order: Counter(x for t in train for x in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(x[1:] for x in counts[k + 1])
    least, totals, back = {}, {}, {}
    for k in counts:
        t = Counter(min(n, 5) for n in counts[k].values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
        least[k] = [max(0.1, min(j - 0.1, j - (j + 1) * y * t[j + 1] / t[j] if t[j] else j / 2)) for j in (1, 2, 3)]
        totals[k], back[k] = Counter(), Counter()
        for x, n in counts[k].items():
            totals[k][x[:-1]] += n
            back[k][x[:-1]] += least[k][min(n, 3) - 1]

    def p(x):
        if not x:
            return 1 / size
        k, n = len(x), counts[len(x)][x]
        if not totals[k][x[:-1]]:
            return p(x[1:])
        own = n - least[k][min(n, 3) - 1] if n else 0.0
        return (own + back[k][x[:-1]] * p(x[1:])) / totals[k][x[:-1]]

    return [-sum(math.log(p(x)) for x in grams(t)) for t in texts]


@pytest.mark.parametrize("sent", [2_000_000, 0], ids=["sent", "joined"])
def test_kneser_ney_of_bytes_against_plain_counts(spark, monkeypatch, sent):
    """Each byte is a unit of its own, whether the model is sent to the tasks or joined with the n-grams of texts."""
    monkeypatch.setattr(ngramquality, "SENT_ROWS", sent)
    rnd = random.Random(63)
    words = [word(rnd) for _ in range(30)] + ["été", "Größe", "мир", "42", "|x|"]
    train = [prose(rnd, 40, words).capitalize() + "." for _ in range(25)]
    odd = ["", None, "q", "МИР 17", "ÉTÉ été 字字", "!?" * 40, train[0], train[0]]
    rows = [(k, "en" if k % 2 else "fr", t) for k, t in enumerate(train)] + [(100 + k, ("en", "xx", None)[k % 3], t) for k, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    units = ngramquality.BYTES
    assert len(set(units.of.tolist())) == 256 and 0 not in units.of and units.size == 257 and units.order >= 4
    model = ngramquality.train(docs, docs.where("doc_id < 100").select("doc_id"), least=12, units=units)
    got = {x["doc_id"]: (x["n"], x["nll"], x["any_nll"]) for x in ngramquality.perplexities(docs, model, units).collect()}
    texts = {k: t or "" for k, _, t in rows}
    want = {lang: dict(zip(texts, plain_kneser_ney(some, texts.values(), units.size, units.order), strict=True)) for lang, some in (("en", train[1::2]), ("fr", train[::2]), (None, train))}
    assert len(got) == len(rows)
    for k, lang, _ in rows:
        own = want[lang if lang in ("en", "fr") else None][k]
        assert got[k] == (len(texts[k].encode()), pytest.approx(own, rel=1e-5, abs=1e-4), pytest.approx(want[None][k], rel=1e-5, abs=1e-4))


def test_quality_tells_letters_of_other_scripts_and_digits_apart(spark):
    """With classes of bytes as units, letters that share a class could stand for each other, as could all digits and all capitals."""
    rnd = random.Random(64)
    words = ["".join(rnd.choice("абвгдежзиклмноп") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    other = str.maketrans({x: bytes([x.encode()[0], x.encode()[1] ^ 8]).decode() for x in "абвгдежзиклмноп"})
    clean = [" ".join(rnd.choice(words) for _ in range(60)) + " in 2024" for _ in range(300)]
    bad = [t.translate(other) for t in clean[:20]]
    assert all(ngramquality._CLASS[list(a.encode())].tolist() == ngramquality._CLASS[list(b.encode())].tolist() and a != b for a, b in zip(clean, bad))
    docs = spark.createDataFrame([(k, t, "ru") for k, t in enumerate(clean + bad)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(k, 1) for k in range(200)], "doc_id long, quality int")
    got = {x["doc_id"]: x["kept"] for x in ngramquality.classify(docs, marks).collect()}
    assert sum(got[k] for k in range(300)) >= 295 and not any(got[300 + k] for k in range(20))


def test_languages_in_several_rounds(spark, monkeypatch):
    rnd = random.Random(62)
    rows = [(k, f"l{k % 5}", prose(rnd, 30)) for k in range(200)] + [(500, None, "abc def"), (501, "new", "abc def"), (502, "l1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = ngramquality.train(docs, docs.where("doc_id < 200").select("doc_id"))
    one = sorted(map(str, ngramquality.perplexities(docs, model).collect()))
    monkeypatch.setattr(ngramquality, "AT_ONCE", 2)
    assert sorted(map(str, ngramquality.perplexities(docs, model).collect())) == one and len(one) == len(rows)


# 10


def test_secret_models_on_held_out_samples(spark):
    ratio = secrets.train(secrets.samples(spark))
    right, found, judged = 0, 0, [0, 0]
    for k in range(200_000, 206_000):
        value, label = secrets.sample(k)
        if len(value) >= secrets.LEAST_RANDOM:
            says = secrets.mean_ratio(value, ratio) > secrets.MEAN_RATIO
            judged[label] += 1
            right += says and not label
            found += says and label
    assert right / judged[0] < 0.002 and found / judged[1] > 0.99
    # Log-likelihoods by hand, for one pair of characters seen in both labels' samples.
    rows = [x for x in map(secrets.sample, range(secrets.SAMPLES))]
    c = [Counter(), Counter()]
    for value, label in rows:
        c[label].update(zip("\0" + value, value))
    n_class = 68
    for a, b in (("s", "e"), ("9", "f"), ("q", "7")):
        logs = []
        for label in (0, 1):
            own = (sum(n for (_, y), n in c[label].items() if y == b) + 0.5) / (sum(c[label].values()) + 0.5 * n_class)
            after = sum(n for (x, _), n in c[label].items() if x == a)
            logs.append(math.log((c[label][a, b] + secrets.BACK * own) / (after + secrets.BACK)))
        at = secrets._CLASS[ord(a)] * n_class + secrets._CLASS[ord(b)]
        assert ratio[at] == pytest.approx(logs[1] - logs[0])


def base_by_hand(text):
    """Base spans by scanning code points, without the module's patterns."""
    value = set(LETTERS + LETTERS.upper() + "0123456789+/_.=-")
    found = []

    def run(at, ok):
        end = at
        while end < len(text) and text[end] in ok:
            end += 1
        return end

    at = 0
    while at < len(text):
        head = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(w)].isascii() and text[at : at + len(w)].lower() == w), None)
        end = None
        if head:
            q = at + len(head)
            for quoted in (True, False):
                p = q + 1 if quoted and q < len(text) and text[q] in "\"'" else q
                if quoted and p == q:
                    continue
                p = run(p, " ")
                if p < len(text) and text[p] in ":=":
                    p = run(p + 1, " ")
                    p += p < len(text) and text[p] in "\"'"
                    if run(p, value) > p:
                        end = run(p, value)
                        break
        if end:
            if end - p >= 6:
                found.append((at, 0, f"assign:{at}:{end}"))
            at = end
        else:
            at += 1
    for kind_, number, start, ok, least in (("access", 1, "AKIA", set(LETTERS.upper() + "0123456789"), 20), ("hex", 2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            end = run(at + len(start), ok) if text.startswith(start, at) else at
            if end > at + len(start):
                if end - at >= least:
                    found.append((at, number, f"{kind_}:{at}:{end}"))
                at = end
            else:
                at += 1
    return ",".join(x for _, _, x in sorted(found))


def test_base_spans_against_a_scan(spark):
    import hashlib

    rnd = random.Random(71)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "é", "x", "\n", "hunter2", "ſecret", "-", "."]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(600)]
    got = {x["doc_id"]: x["base_sha256"] for x in secrets.scan(spark.createDataFrame(list(enumerate(texts)), PAIR)).collect()}
    for k, t in enumerate(texts):
        assert got[k] == hashlib.sha256(base_by_hand(t).encode()).hexdigest(), t


# The pipeline


def test_stages_on_odd_rows(spark):
    """Nulls, repeats, shared ids and an empty table: each stage judges rows by their texts."""
    folder = "/root/testdata/sf0.001"
    docs = read(spark, folder, "documents")
    long_ = docs.orderBy(F.desc("n_chars")).first()
    item = read(spark, folder, "benchmark").first()["text"]
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (None, long_["text"], long_["lang"], "s", 1), (long_["doc_id"], item, "en", "s", 1), (70_000, item, "en", "s", 1), (70_001, "a " * 60_000, "en", "s", 1)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({"kept": F.lit("x"), "label": F.lit(1), "t1": F.lit(2)})
    n = odd.count()
    judged = corpus_pipeline.quality(spark, odd, folder)
    assert judged.columns == docs.columns and judged.where("coalesce(text, '') = ''").count() == 2 and judged.where("text is not null and doc_id is null").count() >= 1
    one = corpus_pipeline.near_duplicates(spark, odd, folder)
    assert one.where(F.col("doc_id") == long_["doc_id"]).count() == 2 and one.where("doc_id is null").count() == 2 and one.count() < n
    clean = corpus_pipeline.decontaminate(spark, odd, folder)
    assert clean.where(F.col("text") == item).count() == 0 and clean.where("doc_id is null").count() == 3
    assert clean.where(F.col("doc_id") == long_["doc_id"]).count() == 1
    mixed = corpus_pipeline.mix(spark, odd, folder)
    assert mixed.columns == docs.columns and mixed.where(F.col("source").isNotNull()).count() > 0
    assert corpus_pipeline.shard(spark, odd, folder).count() == n
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
