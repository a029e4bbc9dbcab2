"""Memory of the tasks that score texts by n-gram models."""

from __future__ import annotations

import pickle
import random
import tracemalloc
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa

from tidewright.llm import ngramquality, textbytes

UNITS = ngramquality.BYTES


def peak_mb(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def texts(n: int, size: int) -> list[str]:
    rnd = random.Random(71)
    return ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz .,0123456789", k=size)) for _ in range(n)]


def test_codes_take_little_beside_their_result():
    block = next(textbytes.blocks(pa.array(texts(50, 20_000))))
    assert len(block.data) == 1_000_000
    assert peak_mb(lambda: ngramquality._codes(block, UNITS)) < 16


def test_codes_of_short_texts_begin_with_units_0():
    some = ["", "a", "bc", "", "def", "ghijklm", "é", ""]
    got = ngramquality._codes(next(textbytes.blocks(pa.array(some))), UNITS).tolist()
    want = []
    for t in some:
        c = [0] * (UNITS.order - 1) + [b + 1 for b in t.encode()]
        want += [sum(c[k - j] * UNITS.size**j for j in range(UNITS.order)) for k in range(UNITS.order - 1, len(c))]
    assert got == want


def test_scoring_takes_memory_by_small_pieces():
    """A batch of 4 MB is scored in little memory beside it and the model (110 MB before, in blocks of 1 MB)."""
    model = pd.DataFrame([(k, 97, 0.1, None) for k in range(1, UNITS.order + 1)] + [(k, 0, None, 0.5) for k in range(UNITS.order)], columns=["order", "code", "p", "back"])
    packed = {ngramquality.ANY: [ngramquality.Layout.of(model, UNITS).packed()]}
    session = SimpleNamespace(
        sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=pickle.loads(pickle.dumps(x)))),
        conf=SimpleNamespace(get=lambda key: ""),
    )
    run = ngramquality._scored(SimpleNamespace(sparkSession=session, mapInArrow=lambda f, kinds: f), packed, UNITS)
    n = 200
    keys = [pa.array(range(n), pa.int64()), pa.array(["en"] * n), pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64())]
    batch = pa.RecordBatch.from_arrays([*keys, pa.array(texts(n, 20_000))], ["doc_id", "lang", "t1", "t2", "text"])
    found = []
    assert peak_mb(lambda: found.extend(x for b in run(iter([batch])) for x in b.column(4).to_pylist())) < 40
    assert found == [20_000] * n


def test_models_sent_at_a_time_are_bounded_together(spark, monkeypatch):
    rnd = random.Random(72)
    rows = [(k, f"l{k % 4}", "".join(rnd.choices("abcdefgh ", k=200))) for k in range(160)] + [(500, None, "abc def"), (501, "new", "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = ngramquality.train(docs, docs.where("doc_id < 160").select("doc_id"), units=UNITS)
    sizes = {x["lang"]: x["count"] for x in model.groupBy("lang").count().collect()}
    one = sorted(map(str, ngramquality.perplexities(docs, model, UNITS).collect()))
    every = sizes.pop(ngramquality.ANY)
    assert len(sizes) == 4 and sum(sizes.values()) > every
    monkeypatch.setattr(ngramquality, "SENT_ROWS", every)
    scored, sent = ngramquality._scored, []
    monkeypatch.setattr(ngramquality, "_scored", lambda docs, packed, units: sent.append(set(packed)) or scored(docs, packed, units))
    assert sorted(map(str, ngramquality.perplexities(docs, model, UNITS).collect())) == one and len(one) == len(rows)
    assert all(sum(sizes.get(x, 0) for x in some) <= every for some in sent) and set().union(*sent) == {*sizes, ngramquality.ANY}
