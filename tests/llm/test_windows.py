"""Repeated windows of op4 against a plain loop, also where windows share a hash."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewright.llm.linefreq import n_repeat_words


def plain(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(3)}
    return len(covered)


@pytest.mark.parametrize("hashed", [F.xxhash64, F.length, lambda x: F.lit(0), lambda x: F.lit(-1)], ids=["xxhash64", "length", "all one", "all ones"])
def test_repeated_windows(spark, hashed):
    """Hashes that tell windows apart badly, or not at all, change no count."""
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdeé") for _ in range(n)) for n in (0, 1, 2, 3, 4, 10, 40, 120) for _ in range(4)]
    texts += [None, "", " \t\n", "a b c  a\tb\nc", "a a a a", "x y z q x y z", "a b c d a b e a b c", "ab c d a bc d ab c d", "one two three " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", n_repeat_words(F.col("text"), hashed).alias("n"))
    assert {x["k"]: x["n"] for x in rows.collect()} == {k: plain(t) for k, t in enumerate(texts)}
