"""Text in drawing order: right-to-left runs reversed, Arabic letters joined.

The joined forms come from Unicode's own data: a presentation form's compatibility decomposition names its letter and its
place in the word."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAM = "ل"


@cache
def forms() -> dict[str, dict[str, str]]:
    """letter or pair: {isolated, initial, medial, final: character}."""
    out: dict[str, dict[str, str]] = {}
    for code in (*range(0xFB50, 0xFDFE), *range(0xFE70, 0xFEFD)):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) in (2, 3) and parts[0] in ("<isolated>", "<initial>", "<medial>", "<final>"):
            letters = "".join(chr(int(p, 16)) for p in parts[1:])
            if len(letters) == 1 or letters[0] == LAM and letters[1] in "آأإا":
                out.setdefault(letters, {}).setdefault(parts[0][1:-1], chr(code))
    return out


def join_arabic(s: str) -> str:
    """Letters in their places' forms; lam and alef together are one.  Marks between letters do not part them."""
    table, out, chars = forms(), [], []
    k = 0
    while k < len(s):
        pair = s[k : k + 2]
        chars.append(pair if len(pair) == 2 and pair in table else s[k])
        k += len(chars[-1])
    solid = [i for i, c in enumerate(chars) if unicodedata.category(c[0]) != "Mn"]
    joins = {}
    for a, b in zip(solid, solid[1:], strict=False):
        joins[a, b] = "initial" in table.get(chars[a], ()) and "final" in table.get(chars[b], ())
    where = {i: n for n, i in enumerate(solid)}
    for i, c in enumerate(chars):
        own = table.get(c)
        if own is None or i not in where:
            out.append(c)
            continue
        n = where[i]
        before = n > 0 and joins[solid[n - 1], i]
        after = n + 1 < len(solid) and joins[i, solid[n + 1]]
        place = "medial" if before and after else "final" if before else "initial" if after else "isolated"
        out.append(own.get(place, own.get("isolated", c)))
    return "".join(out)


def _strong(c: str) -> str | None:
    kind = unicodedata.bidirectional(c)
    return "R" if kind in ("R", "AL") else "L" if kind in ("L", "EN", "AN") else None


def visual(s: str | None) -> str | None:
    """A line in the order that its characters are drawn in, left to right."""
    if not s or not any(_strong(c) == "R" for c in s):
        return s
    base = next(k for c in s if (k := _strong(c)) and unicodedata.bidirectional(c) not in ("EN", "AN"))
    kinds = [_strong(c) for c in s]
    for i, k in enumerate(kinds):  # what has no direction takes that of both neighbours, else the line's
        if k is None:
            left = next((x for x in kinds[:i][::-1] if x), base)
            right = next((x for x in map(_strong, s[i + 1 :]) if x), base)
            kinds[i] = left if left == right else base
    runs: list[tuple[str, str]] = []
    for c, k in zip(s, kinds, strict=True):
        if runs and runs[-1][0] == k:
            runs[-1] = (k, runs[-1][1] + c)
        else:
            runs.append((k, c))
    mirror = str.maketrans("()[]{}<>", ")(][}{><")
    drawn = [t if k == "L" else join_arabic(t)[::-1].translate(mirror) for k, t in runs]
    return "".join(drawn[::-1] if base == "R" else drawn)


@F.pandas_udf(T.StringType())
def visual_text(s: pd.Series) -> pd.Series:
    return s.map(visual, na_action="ignore")
