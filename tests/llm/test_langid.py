import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from terrane.llm import langid


def tree_bits(train, text, order):
    """Prediction by partial matching, symbol by symbol."""
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
    count = defaultdict(Counter)
    for t in train:
        b = b" " * order + low(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                count[b[i - k : i]][b[i]] += 1
    b, bits = b" " * order + low(text), 0.0
    for i in range(order, len(b)):
        cost = 0.0
        for k in range(order, -1, -1):
            c = count.get(b[i - k : i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                cost -= math.log2(c[b[i]] / (n + d))
                break
            cost -= math.log2(d / (n + d))
        else:
            cost += 8
        bits += cost
    return bits


def test_code_lengths(spark):
    train = {"a": ["the cat sat", "The hat"], "b": ["der hut", "die katze war da"]}
    df = spark.createDataFrame([(i, t, k) for k, v in train.items() for i, t in enumerate(v)], "doc_id long, text string, lang string")
    model = langid.fit(df, 3)
    for text in ("the katze", "x", "Straße", "hat hat hat"):
        data, starts = langid._joined(pa.array([text]))
        got = model.bits(langid._runs(data, starts, 3)).sum(0)
        assert np.allclose(got, [tree_bits(train[k], text, 3) for k in ("a", "b")], rtol=1e-5)


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_teach_nothing(docs):
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    wrong = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    key = lambda d: sorted(map(tuple, langid.identify(d).collect()))
    assert key(docs) == key(wrong)


def test_edges(spark, edge, nothing):
    rows = langid.identify(edge).collect()
    assert len(rows) == edge.count()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {1, 2, 3} <= und and not {4, 5, 8, 9} & und and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert langid.identify(nothing).collect() == []
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]


def test_slices_do_not_change_scores(docs, monkeypatch):
    a = sorted(map(tuple, langid.identify(docs).collect()))
    monkeypatch.setattr(langid._slices, "__defaults__", (5000,))
    monkeypatch.setattr(langid, "STEP", 1000)
    b = sorted(map(tuple, langid.identify(docs).collect()))
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], atol=1e-4)


def test_shares_under_a_millionth_are_sampled(spark):
    """As of a billion rows: the expected 20 of 40 million, not none."""
    rows = spark.range(40_000_000).selectExpr("id", "'en' AS lang")
    assert 5 <= rows.where(langid.picked("id", {"en": 5e-7})).count() <= 45
