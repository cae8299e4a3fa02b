import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import suffix as S


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(c for c, x in zip(b, cover, strict=False) if not x)
        runs = int((cover[:-1] & ~np.concatenate([[False], cover[:-2]])).sum()) if len(b) else 0
        out.append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(df, **k):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.digest(df, **k).collect())


def expected(rows, length):
    return sorted((i is None, i or 0, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], length), strict=True))


def test_whole_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(docs) == expected(rows, 400)


@pytest.mark.parametrize("group", [30_000, 2])
def test_passages_with_other_surroundings(spark, group, monkeypatch):
    """Passages of lengths about the limit in many surroundings; group 2 takes the path for frequent strings."""
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [noise(60) for _ in range(4)]
    rows = [(i, noise(r.randrange(40)) + shared[i % 4][: r.randrange(34, 61)] + noise(r.randrange(40)) + shared[(i + 1) % 4][r.randrange(20) :]) for i in range(60)]
    rows += [(100, "x" * 90), (101, "xy" * 60), (102, "x" * 41), (103, shared[0] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S.repeats, "__defaults__", (400, 200, group))
    assert result(df, length=40, gram=20) == expected(rows, 40)


def test_edges(edge, nothing):
    from .conftest import EDGE

    assert result(edge) == expected(EDGE, 400)
    assert S.digest(nothing).collect() == [] and S.remove(nothing).columns == nothing.columns
    kept = S.remove(edge)
    assert kept.columns == edge.columns and kept.count() == len(EDGE)
    assert [r["text"] for r in kept.where("doc_id in (1, 5, 6)").orderBy("doc_id").collect()] == [None, "", ""]


def test_long_texts_are_segmented(spark, monkeypatch):
    one = "".join(random.Random(1).choice("abc") for _ in range(3000))
    rows = [(1, one), (2, "zz" + one[700:2500] + "yy")]
    monkeypatch.setattr(S, "SEGMENT", 500)
    table = __import__("pyarrow").record_batch({"doc_id": [1, 2], "hash": [1, 2], "text": [r[1] for r in rows]})
    monkeypatch.undo()
    whole = {(x["doc_id"], x["pos"], x["key"], x["around"]) for b in S._anchor_rows(400, 200)(iter([table])) for x in b.to_pylist()}
    monkeypatch.setattr(S, "SEGMENT", 500)
    parts = {(x["doc_id"], x["pos"], x["key"], x["around"]) for b in S._anchor_rows(400, 200)(iter([table])) for x in b.to_pylist()}
    assert whole == parts and whole


@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", max_size=12)), min_size=1, max_size=25))
@settings(max_examples=150, deadline=None)
def test_suffix_sort(items):
    raw = [t.encode() for _, t in items]
    (rows, sizes), groups = S._padded(raw, 12), np.unique([g for g, _ in items], return_inverse=True)[1]
    out, common = S.verified_order(rows, sizes, groups)
    got = [(int(groups[k]), raw[k]) for k in out]
    assert got == sorted(got)
    for (a, x), (b, y), c in zip(got, got[1:], common[1:], strict=False):
        same = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert c == (same if a == b else -1)


def test_collisions_fall_back_to_bytes(monkeypatch):
    raw = [b"abc", b"abd", b"aaa", b"abc"]
    rows, sizes = S._padded(raw, 3)
    monkeypatch.setattr(S, "prefix_hashes", lambda rows: np.zeros((len(rows), rows.shape[1] + 1), np.uint64))
    out, common = S.verified_order(rows, sizes, np.zeros(4, np.int64))
    assert [raw[k] for k in out] == sorted(raw) and common.tolist() == [-1, 1, 3, 2]


def test_columns_of_any_name_stay(spark):
    from .conftest import prose

    few = " ".join(f"w{k:02d}" for k in range(55))
    rows = [(k, f"{prose(k, 60)} {few}", *range(k, k + 6)) for k in range(3)]
    names = "own int, d int, h int, spans int, Words int, hash int"
    got = S.remove(spark.createDataFrame(rows, f"doc_id long, text string, {names}"), words=51)
    assert got.columns == ["doc_id", "text", "own", "d", "h", "spans", "Words", "hash"]
    assert sorted(map(tuple, got.collect())) == [(k, prose(k, 60) + " ", *range(k, k + 6)) for k in range(3)]


def test_passages_are_told(spark):
    """Passages of 51 words in less than 400 bytes are reported by the digest, which removes strings of 400 bytes alone."""
    from .conftest import prose

    few = lambda n: " ".join(f"w{k:02d}" for k in range(n))
    rows = [(1, f"{prose(1, 30)} {few(51)} a"), (2, f"{prose(2, 30)} {few(51)} b"), (3, f"{prose(3, 30)} {few(50)} c"), (4, None)]
    got = {r["doc_id"]: (r["n_removed"], r["n_passage_bytes"]) for r in S.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, len(few(51)) + 1), 2: (0, len(few(51)) + 1), 3: (0, 0), 4: (0, 0)}
