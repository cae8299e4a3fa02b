import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terrane.llm import lm


def tokens(t):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", low), b"\n"]


def check_base(rows, source):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    count = Counter(w for i, t in source if fold(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((i is None, i or 0, fold(i) == 0, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in source)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], abs=2e-5)


@pytest.mark.parametrize("unit", [1 << 30, 20_000])
def test_base_and_score(docs, unit):
    rows = lm.score(docs, unit_bytes=unit).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in rows)


def test_units_do_not_change_scores(docs):
    a, b = (sorted((r["doc_id"], r["score"]) for r in lm.score(docs, unit_bytes=u).collect()) for u in (1 << 30, 50_000))
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b], rel=1e-9)


def test_trigrams(docs):
    two, three = (sum(r["score"] for r in lm.score(docs, order=k).collect()) for k in (2, 3))
    assert three > two  # on its own training texts the longer context fits better


def test_edges(edge, nothing):
    from .conftest import EDGE

    check_base(lm.score(edge).collect(), EDGE)
    assert lm.score(nothing).collect() == []


def test_only_held_out(spark):
    d = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    rows = lm.score(d).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in rows)


def test_em_learns_the_useful_order():
    far = (lm.RATIO_LEAST + 10) * lm.FINE
    w = lm.learn({(1, 0, far): 90, (1, far, -1): 10}, 2)
    assert w[1].argmax() == 2 and w.sum(1) == pytest.approx(np.ones(len(w)), abs=1e-6)
