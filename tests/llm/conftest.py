import random

import pytest

WORDS = "the of and river stone light paper house green water mountain letter silver window garden north summer bridge winter candle".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


#: Texts of every awkward kind: null, empty, blank, one word, repeated, near copies, long, not Latin, control characters.
EDGE = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, prose(1, 200)), (6, prose(1, 200)), (7, prose(1, 200) + " tail"), (8, prose(2, 30000)), (9, "é ü ß 漢字\n\nрусский  текст"), (9, "é ü ß 漢字\n\nрусский  текст"),
    (10, "a" * 1500), (11, "nul\0 ctl\x1c <|endoftext|> 'tis we'll\tx"), (None, "no id here"), (None, None), (12, prose(3, 120) + " " + prose(4, 90)), (13, prose(5, 50) + " " + prose(4, 90)),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Extra columns clash with names that operators return or use."""
    rows = [(i, t, "en", f"s{k}", len(t or ""), 1.0, "x", k, "y") for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, start long, hash string")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
