import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import bpe, packing, tokens_out
from terrane.llm.queries import vocabulary

from .conftest import EDGE


@pytest.fixture(scope="module")
def library():
    return bpe.encoder(vocabulary()).library


def ids(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_ids_are_the_library_s(library, docs):
    texts = [r["text"] for r in docs.collect()] + [t or "" for _, t in EDGE]
    assert [x.tolist() for x in bpe.Encoder(vocabulary()).encode(texts)] == ids(library, texts)


@given(st.text(alphabet=st.sampled_from("ab'.,s t\n\t12_-é漢\0\x1c\xa0  ́<|>"), max_size=30))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    enc = bpe.encoder(vocabulary())
    assert next(iter(enc.encode([text]))).tolist() == enc.library.encode(text, add_special_tokens=False).ids


def test_forgetting_keeps_ids(library, docs, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    monkeypatch.setattr(bpe, "CALL", 500)
    texts = [r["text"] for r in docs.limit(60).collect()]
    assert [x.tolist() for x in bpe.Encoder(vocabulary()).encode(texts)] == ids(library, texts)


@pytest.mark.parametrize("length", [2048, 64])
def test_packing(spark, edge, library, length):
    rows = packing.pack(edge.repartition(3, "source"), vocabulary(), length).collect()
    whole = {}
    for (i, t), x in zip(EDGE, ids(library, [t for _, t in EDGE]), strict=True):
        whole.setdefault(i, []).append([*x, 1])
    total = sum(len(x) for v in whole.values() for x in v)
    assert sum(r["length"] for r in rows) == total
    for r in rows:
        assert r["ids_crc32"] in [crc(x[r["start"] : r["start"] + r["length"]]) for x in whole[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert r["cut_before"] == (r["start"] > 0) and r["cut_after"] == (r["start"] + r["length"] < r["doc_tokens"])
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(-(-total // length)))
    for s, v in by.items():
        v.sort()
        assert [a for a, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))]
        assert sum(n for _, n in v) == (length if s < len(by) - 1 else total - length * (len(by) - 1))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, edge, library, encoding):
    rows = tokens_out.round_trip(edge, vocabulary(), encoding=encoding).orderBy("start").collect()
    assert [r["doc_id"] is None or r["doc_id"] for r in rows] == [True, True, *sorted(i for i, _ in EDGE if i is not None)]
    want = sorted(crc([*x, 2]) for x in ids(library, [t for _, t in EDGE]))
    assert sorted(r["ids_crc32"] for r in rows) == want
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]


@pytest.mark.parametrize("many", [256, 2])
def test_many_ranges(spark, docs, library, monkeypatch, many):
    monkeypatch.setattr(tokens_out, "MANY", many)
    monkeypatch.setattr(tokens_out.C, "unit_count", lambda d: 7)
    rows = tokens_out.round_trip(docs, vocabulary()).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows) and len(rows) == docs.count()
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()


@pytest.mark.parametrize("encoding,want", [("dictionary", "DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_file_layout(spark, docs, tmp_path, encoding, want):
    path = str(tmp_path / encoding)
    tokens_out.write(docs, vocabulary(), path, encoding=encoding, row_group_bytes=64 << 10, page_bytes=4 << 10)
    files = [pq.ParquetFile(f) for f in (tmp_path / encoding).glob("*.parquet")]
    columns = [f.metadata.row_group(g).column(c) for f in files for g in range(f.metadata.num_row_groups) for c in range(f.metadata.num_columns)]
    ids_ = [c for c in columns if c.path_in_schema.startswith("tokens")]
    assert any(want in e for c in ids_ for e in c.encodings) and all(c.has_offset_index and c.has_column_index for c in ids_)
    assert max(f.metadata.num_row_groups for f in files) > 1
    assert tokens_out.read(spark, path).where("doc_id = 3").count() == 1


def test_empty(nothing):
    assert packing.pack(nothing, vocabulary()).collect() == [] and tokens_out.round_trip(nothing, vocabulary()).collect() == []


@pytest.mark.parametrize("many", [256, 2])
def test_ids_that_are_strings_and_rows_that_repeat(spark, library, monkeypatch, many):
    monkeypatch.setattr(tokens_out, "MANY", many)
    monkeypatch.setattr(tokens_out.C, "unit_count", lambda d: 7)
    texts = [(f"k{k % 50:02d}", f"text number {k % 50}") for k in range(300)] + [("same", "one row that repeats")] * 400
    rows = tokens_out.round_trip(spark.createDataFrame(texts, "doc_id string, text string"), vocabulary()).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(i for i, _ in texts)
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()
    want = {t: crc([*x, 2]) for (_, t), x in zip(texts, ids(library, [t for _, t in texts]), strict=True)}
    assert sorted(r["ids_crc32"] for r in rows) == sorted(want[t] for _, t in texts)
