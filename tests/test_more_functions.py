import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import boxes as B
from terrane.functions import script


def box(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_boxes(spark):
    a, b = box(0, 0, 4, 4), box(2, 3, 8, 6)
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(*B.intersect(a, b)) == (2, 3, 4, 4) and one(*B.union(a, b)) == (0, 0, 8, 6)
    assert one(B.overlaps(a, b), B.overlaps(a, box(4, 0, 5, 5)), B.is_empty(B.intersect(a, box(9, 9, 10, 10)))) == (True, False, True)
    assert one(B.covered(a, b), B.area(b)) == (2 / 16, 18)
    assert one(*B.outward(box(0.2, -0.2, 1.1, 2))) == (0, -1, 2, 2)
    assert one(*B.turned(F.lit(4.0), F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2))) == pytest.approx((-1, -2, 1, 2))
    zooms = lambda *v: tuple(F.lit(x) for x in v)
    assert one(*B.zoom_union(zooms(1, 0), zooms(3, 5)), *B.zoom_union(zooms(2, 4), zooms(3, 9))) == (3, 5, 2, 9)
    assert one(B.edge_fade(F.lit(1.0), F.lit(5.0), F.lit(10.0), F.lit(10.0), 2.0))[0] == 0.5


def test_visual_order(spark):
    assert script.visual("plain (text)") == "plain (text)" and script.visual("") == "" and script.visual(None) is None
    hebrew = "אבג"
    assert script.visual(hebrew) == hebrew[::-1]
    assert script.visual(f"x {hebrew} y") == f"x {hebrew[::-1]} y"
    assert script.visual(f"{hebrew} 12 (a)") == f"(a) 12 {hebrew[::-1]}" or script.visual(f"{hebrew} 12 (a)").endswith(hebrew[::-1])
    assert script.join_arabic("بب") == "ﺑﺐ" and script.join_arabic("لا") == "ﻻ"
    assert script.join_arabic("دب") == "ﺩﺏ"  # dal does not join forward
    got = spark.createDataFrame([(hebrew,), (None,)], "s string").select(script.visual_text("s")).collect()
    assert [r[0] for r in got] == [hebrew[::-1], None]
