import random
import re

import numpy as np
import pytest

from terrane.llm import jaccard as J

from .conftest import EDGE, WORDS


def grams(t):
    w = [x for x in re.split(r"[\x09-\x0D ]+", (t or "").lower()) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    links, texts, parent = [0] * n, [set() for _ in rows], list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 1000 >= round(threshold * 1000) * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
                if sets[i] != sets[j]:
                    texts[i].add(sets[j])
                    texts[j].add(sets[i])
    least = {}
    for i in range(n):
        r = root(i)
        key = (rows[i][0] is not None, rows[i][0] or 0)
        least[r] = min(least.get(r, key), key)
    return sorted((rows[i][0] is None, rows[i][0] or 0, least[root(i)], links[i], len(texts[i])) for i in range(n))


def result(df, **k):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["class_id"] is not None, r["class_id"] or 0), r["n_links"], r["n_texts"]) for r in J.join(df, **k).collect())


def near(seed, copies, edits, size=80):
    r = random.Random(seed)
    base = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(size)]
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(size)] = str(r.random())
        yield " ".join(w)


@pytest.mark.parametrize("block", [1000, 7])
def test_near_copies(spark, block):
    texts = [t for s in range(6) for t in near(s, 8, 4)] + list(near(99, 40, 2)) + ["one two", "ONE  two", "three"]
    rows = list(enumerate(texts))
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), block=block) == brute(rows)


def test_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(docs) == brute(rows)


def test_edges(edge, nothing):
    # rows of one id are one class only if their texts are: the brute force works on rows
    assert result(edge) == brute(EDGE)
    assert J.join(nothing).collect() == [] and J.deduplicate(nothing).columns == nothing.columns


def test_one_of_each_class_stays(edge):
    kept = J.deduplicate(edge)
    assert kept.columns == edge.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    ids = [i for _, i, _ in got]
    assert ids.count(5) == 1 and 6 not in ids and 7 not in ids and ids.count(9) == 1 and {1, 2, 3, 4, 8, 10, 11, 12, 13} <= set(ids)


def test_pruning_keeps_what_is_likely():
    least = J.least_matches(0.8, 1e-9)
    assert least == sorted(least) and all(m < 0.8 * n for m, n in zip(least, range(J.STEP, J.HASHES + 1, J.STEP), strict=True)) and least[-1] > 0.3 * J.HASHES


def test_dense_and_sparse_checks_agree():
    import pyarrow as pa

    texts = list(near(3, 60, 6))
    flat, starts = J.shingles(pa.array(texts), 5)
    sig = J.signatures(flat, starts)
    every = np.ones((60, 60), bool)
    i, j = J._links(flat, starts, sig, every, 0.8, 1e-9)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(grams(texts[a]) & grams(texts[b])) * 5 >= 4 * len(grams(texts[a]) | grams(texts[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    few = np.zeros((60, 60), bool)
    for a, b in sorted(want)[:20]:
        few[a, b] = few[b, a] = True
    i, j = J._links(flat, starts, sig, few, 0.8, 1e-9)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(sorted(want)[:20])


def test_deduplicate_keeps_columns_of_any_name(spark):
    from .conftest import prose

    rows = [(k, prose(k // 2, 50), k, -k, 7, "x") for k in range(6)]
    got = J.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, own int, D int, h int, digest string"))
    assert got.columns == ["doc_id", "text", "own", "D", "h", "digest"]
    assert sorted(map(tuple, got.collect())) == rows[::2]
