"""Boundary sets against plain slicing, and outputs against a plain transformation."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvane.llm import fim_boundaries as fim


def plain_cut(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return len(text), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("text", [
    "", "a", "é", "plain ascii " * 20_000, "é" * 100_000, "aé" * 60_000, "漢😀" * 30_000,
    "x" * 65_535 + "é" + "y" * 70_000, "".join(random.Random(1).choices("aé漢😀", weights=[8, 1, 1, 1], k=150_000)),
])
def test_selects_every_boundary(text):
    bounds = fim.Boundaries(np.frombuffer(text.encode(), np.uint8))
    assert len(bounds) == len(text) + 1
    wanted = sorted({0, 1, len(text) // 3, len(text) // 2, len(text) - 1, len(text), *random.Random(2).choices(range(len(text) + 1), k=50)})
    wanted = [k for k in wanted if 0 <= k <= len(text)]
    assert bounds.select(wanted) == [len(text[:k].encode()) for k in wanted]


def test_every_kind_of_container_is_used():
    kinds = {
        type(c) for t in ("ascii" * 10, "漢é" * 1_000, "aé" * 60_000) for c in fim.Boundaries(np.frombuffer(t.encode(), np.uint8)).containers
    }
    assert kinds == {fim.RunContainer, fim.ArrayContainer, fim.BitmapContainer}


def test_outputs_and_the_way_back(spark):
    rng = random.Random(3)
    texts = ["", None, "a", "<P>", "x<S>y", "a<M", "<<", "<P", "S>", *("".join(rng.choices("ab<PSM>é漢\n", k=rng.randrange(60))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cut = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    forms = set()
    for r in cut.collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_cut(r["doc_id"], texts[r["doc_id"]])
        assert r["back"] == (texts[r["doc_id"]] or "")
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_odd_and_empty_tables(odd, none):
    clashing = odd.withColumns({c: F.lit("clash") for c in [*fim.RESULT, "_fim"]})
    got = fim.fill_in_middle(clashing).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    expected = sorted(map(str, (plain_cut(r["doc_id"], r["text"]) for r in odd.collect())))
    assert sorted(str(tuple(r[c] for c in fim.RESULT)) for r in got) == expected
    assert fim.fill_in_middle(none).count() == 0
