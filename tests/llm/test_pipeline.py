"""The pipeline's stages, and all of it, against plain versions."""

import re

import pytest

import corpus_pipeline as P

from .conftest import SF
from .test_jaccard import brute as classes
from .test_suffix import brute as cut


@pytest.fixture(scope="module")
def chain(spark, docs, tmp_path_factory):
    """What each stage got and gave."""
    out, now = [], docs
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, now, SF).write.parquet(path)
        nxt = spark.read.parquet(path)
        out.append((name, now, nxt))
        now = nxt
    return {n: (a, b) for n, a, b in out}


def test_columns_and_keep(chain, docs):
    for name, (_, after) in chain.items():
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
    before, after = chain["language_id"]
    letters = [r["doc_id"] for r in before.collect() if re.search(r"[^\W\d_]", r["text"] or "")]
    assert sorted(letters) == sorted(r["doc_id"] for r in after.select("doc_id").collect())


def test_one_document_of_each_class(chain):
    before, after = chain["ngram_jaccard_join"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c[2][1] for c in classes(rows)})


def test_repeats_are_cut(chain):
    before, after = chain["suffix_array_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {i: n - m for (i, _), (n, m, *_) in zip(rows, cut([t for _, t in rows], 400), strict=True) if n > m}
    got = {r["doc_id"]: r for r in after.collect()}
    assert set(got) == set(want) and all(0 <= want[i] - len(r["text"].encode()) <= 6 and r["n_chars"] == len(r["text"]) for i, r in got.items())


def test_short_passages_of_over_50_words_are_cut(spark):
    from .conftest import prose

    few = lambda n: " ".join(f"w{k:03d}" for k in range(n))
    tiny = lambda n: " ".join("abcdefgh"[k * k % 7] for k in range(n))
    rows = [(k, f"{prose(10 * k, 80)} {p}\n{prose(10 * k + 1, 80)}") for k, p in enumerate([few(51) + " x", few(51) + " y", tiny(60)[:101] + " 1", tiny(60)[:101] + " 2", few(50) + " 4", few(50) + " 5"])]
    # passages of 51 words in 254 and in 101 bytes go, one of 50 words stays
    got = {r["doc_id"]: r["text"] for r in P.repeated_strings(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    for k, own in enumerate(["x", "y", "1", "2"]):
        assert got[k] == f"{prose(10 * k, 80)} {own}\n{prose(10 * k + 1, 80)}"
    assert got[4] == rows[4][1] and got[5] == rows[5][1]


def test_all_passages_of_over_50_words_are_cut(chain):
    """Every word of a 51-word string that stands twice, and every byte of a 400-byte one, against brute force."""
    before, after = chain["suffix_array_dedup"]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in before.collect()}
    words = {i: [(m.start(), m.end()) for m in re.finditer(rb"[^\x09-\x0D\x1C-\x20]+", b)] for i, b in texts.items()}
    seen, windows = {}, {}
    for i, b in texts.items():
        own = [b[x:y] for x, y in words[i]]
        windows[i] = [tuple(own[k : k + 51]) for k in range(len(own) - 50)]
        for w in [*windows[i], *(b[k : k + 400] for k in range(len(b) - 399))]:
            seen[w] = seen.get(w, 0) + 1
    got = {r["doc_id"]: r["text"].encode() for r in after.collect()}
    short = 0
    for i, b in texts.items():
        cover = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                cover[k : k + 400] = b"\1" * 400
        for k, w in enumerate(windows[i]):
            if seen[w] > 1:
                end = words[i][k + 51][0] if k + 51 < len(words[i]) else len(b)
                start = words[i][k][0] if k else 0
                short += not all(cover[start:end])
                cover[start:end] = b"\1" * (end - start)
        left = bytes(c for c, x in zip(b, cover, strict=True) if not x).decode("utf-8", "ignore").encode()
        assert got.get(i, b"") == left
    assert short


def test_clean_documents_stay(spark, chain):
    before, after = chain["decontamination"]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.split(r"[\x09-\x0D ]+", t.lower().strip("\t\n\v\f\r "))] for i in range(len(w) - 4)}
    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in before.collect() if not any(5 * len(g & grams(r["text"])) >= 4 * len(g) for g in items if g)]
    assert sorted(clean) == sorted(r["doc_id"] for r in after.collect())


def test_packing_covers_the_rest(chain):
    before, after = chain["packing"]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.select("doc_id").collect()}
    done = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert sum(r["length"] for r in rows) == sum(done.values())


def test_run_is_the_chain(spark, chain):
    key = lambda d: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"] if r["length"] == r["doc_tokens"] else 0) for r in d.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    a, b = P.run(spark, SF), chain["packing"][1]
    total = lambda d: sorted(d.groupBy("doc_id").sum("length").collect())
    assert total(a) == total(b)


def test_edges(spark, edge, nothing, tmp_path):
    now = edge
    for name, stage in P.STAGES:
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name != "packing":  # columns that operators have names for keep their own values
            assert now.columns == edge.columns and {(r["score"], r["digest"], r["hash"]) for r in now.collect()} == {(1.0, "x", "y")}
    assert now.count() > 0
    now = nothing
    for name, stage in P.STAGES:
        stage(spark, now, SF).write.parquet(str(tmp_path / f"e{name}"))
        now = spark.read.parquet(str(tmp_path / f"e{name}"))
    assert now.count() == 0


def test_tasks_give_up_what_other_operators_kept(monkeypatch):
    """Spark keeps a worker for later tasks, and an executor holds it beside its heap."""
    from types import SimpleNamespace

    from terrane.llm import bpe, jaccard, langid, packing, suffix
    from terrane.llm.queries import vocabulary

    filled = lambda f: f.cache_info().currsize > 0
    tokens = packing._tokenize(vocabulary(), 1)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    for task in (langid._count(4), langid._score(None, 4), jaccard._describe(5), suffix._anchor_rows(400, 200), suffix._anchor_rows(204, 100, True)):
        list(tokens(iter([])))
        assert filled(bpe.encoder)
        list(task(iter([])))
        assert not filled(bpe.encoder)
    suffix._powers(0, 1 << 10)
    mine = bpe.encoder(vocabulary())
    list(tokens(iter([])))
    assert not filled(suffix._powers) and bpe.encoder(vocabulary()) is mine  # its own words stay
