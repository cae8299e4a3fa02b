"""Operators over ordered rows: prefix sums, moving means, runs, gradients, byte-range folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Into how many ranges percentile_step cuts a key's values.
RANGES = 1000


def running_total(df: DataFrame, bucket: Column, order: list, value: str, out: str = "running") -> DataFrame:
    """A prefix sum over the whole table without sorting it in one task: sums of ordered buckets (few rows) are accumulated,
    and each bucket adds its rows to what came before.  bucket must not decrease along `order`."""
    rows = df.withColumn("__b", bucket)
    sums = rows.groupBy("__b").agg(F.sum(value).alias("__s"))
    before = sums.select("__b", (F.sum("__s").over(W.orderBy("__b")) - F.col("__s")).alias("__before"))  # a row a bucket
    inside = F.sum(value).over(W.partitionBy("__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__in", inside).join(before, "__b").withColumn(out, F.col("__before") + F.col("__in")).drop("__b", "__in", "__before")


def undelta(df: DataFrame, by: str, order: str, value: str, out: str) -> DataFrame:
    """Delta-coded values back to absolute ones."""
    return df.withColumn(out, F.sum(value).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def smoothed(df: DataFrame, by: str, order: str, value: str, s: int, out: str = "smooth") -> DataFrame:
    """Centred moving sums over 2s + 1 rows divided by that number always; the series' ends stand beyond its ends."""
    mine = W.partitionBy(by).orderBy(order)
    first, last = F.first(value).over(mine.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last(value).over(mine.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    near = mine.rowsBetween(-s, s)
    i, n = F.row_number().over(mine), F.count("*").over(W.partitionBy(by))
    left, right = F.greatest(F.lit(0), s + 1 - i), F.greatest(F.lit(0), i + s - n)
    return df.withColumn(out, (F.sum(value).over(near) + left * first + right * last) / (2 * s + 1))


def longest_run(df: DataFrame, by: str, order: str, test: Column) -> DataFrame:
    """For each key the length of the longest run of consecutive rows that pass."""
    mine = W.partitionBy(by).orderBy(order)
    rows = df.select(by, order, F.coalesce(test, F.lit(False)).alias("__t")).withColumn("__i", F.row_number().over(mine))
    runs = rows.withColumn("__g", F.col("__i") - F.row_number().over(W.partitionBy(by, "__t").orderBy(order))).where("__t").groupBy(by, "__g").agg(F.count("*").alias("n"))
    return df.select(by).distinct().join(runs.groupBy(by).agg(F.max("n").alias("longest")), by, "left").select(by, F.coalesce("longest", F.lit(0)).alias("longest"))


def total_change(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    step = F.abs(F.col(value) - F.lag(value).over(W.partitionBy(by).orderBy(order)))
    return df.withColumn("__d", step).groupBy(by).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("change"))


def percentile_step(df: DataFrame, by: str, value: str, percent: int = 95) -> DataFrame:
    """The element at floor(n * percent / 100) of the sorted values, counted from 0.  Equal values are counted first, map side, and
    each key is cut into ranges of its values whose totals tell which range holds the element: only that range is sorted, so a key
    with very many values is no one task's work.  Values are whole or decimal numbers of some spread; the ranges are RANGES equal
    steps between the key's least and greatest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    ends = counts.groupBy(by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__c").alias("__n"))
    step = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * RANGES), F.lit(RANGES - 1))).otherwise(0)
    ranged = counts.join(ends, by).withColumn("__r", step)
    totals = ranged.groupBy(by, "__r").agg(F.sum("__c").alias("__t"), F.first("__n").alias("__n"))
    want = F.least(F.floor(F.col("__n") * percent / 100), F.col("__n") - 1)
    upto = F.sum("__t").over(W.partitionBy(by).orderBy("__r").rowsBetween(W.unboundedPreceding, 0))  # RANGES rows a key
    held = totals.withColumns({"__w": want, "__to": upto}).where((F.col("__w") < F.col("__to")) & (F.col("__w") >= F.col("__to") - F.col("__t")))
    inside = ranged.join(held.select(by, "__r", "__w", (F.col("__to") - F.col("__t")).alias("__from")), [by, "__r"])
    upto = F.sum("__c").over(W.partitionBy(by).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)) + F.col("__from")
    found = inside.withColumn("__to", upto).where((F.col("__w") < F.col("__to")) & (F.col("__w") >= F.col("__to") - F.col("__c")))
    return found.select(by, F.col("__v").alias("step"))


def coalesce_ranges(df: DataFrame, by: list[str], max_gap: int = 64 << 10, max_request: int = 8 << 20) -> DataFrame:
    """Byte ranges (offset, length) merged into requests, by key in order of offset: overlapping ones always, others if the
    gap is at most max_gap and the grown request at most max_request.  The cap makes it a fold; rows are split first at gaps
    that no fold could bridge, so an array holds one island and not a whole key."""
    mine = W.partitionBy(*by).orderBy("offset", "length")
    end = F.max(F.col("offset") + F.col("length")).over(mine.rowsBetween(W.unboundedPreceding, -1))
    rows = df.withColumn("__new", F.coalesce((F.col("offset") > end + max_gap).cast("int"), F.lit(1))).withColumn("island", F.sum("__new").over(mine))
    parts = rows.groupBy(*by, "island").agg(F.array_sort(F.collect_list(F.struct(F.col("offset").cast("long").alias("o"), (F.col("offset") + F.col("length")).cast("long").alias("e")))).alias("p"))

    def step(s: Column, r: Column) -> Column:
        last = F.element_at(s, -1)
        join = (r["o"] < last["e"]) | ((r["o"] - last["e"] <= max_gap) & (F.greatest(r["e"], last["e"]) - last["o"] <= max_request))
        grown = F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last["o"].alias("o"), F.greatest(last["e"], r["e"]).alias("e"))))
        return F.when(F.size(s) == 0, F.array(r)).otherwise(F.when(join, grown).otherwise(F.concat(s, F.array(r))))

    merged = parts.withColumn("r", F.explode(F.aggregate("p", F.array().cast("array<struct<o:bigint,e:bigint>>"), step)))
    return merged.select(*by, F.col("r.o").alias("offset"), (F.col("r.e") - F.col("r.o")).alias("length"))


def segment_value(a: Column, b: Column) -> Column:
    """The mean of a segment's ends; one unknown end counts as the other."""
    return F.when(F.isnan(a) | a.isNull(), b).when(F.isnan(b) | b.isNull(), a).otherwise((a + b) / 2)


def gradient_pieces(df: DataFrame, by: str = "line_id", least: float = 0.0) -> DataFrame:
    """Polylines (line_id, pos, span to the next vertex, value) cut into pieces of at least `least`: (first, last, value)
    with the length-weighted mean; runs of unknown values are pieces of their own (null); a short tail joins the piece before it.
    An ordered fold, so each line is one group; a line's vertices are few beside a table's rows."""
    import pandas as pd

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v, span, pos = pdf["value"].to_numpy(float), pdf["span"].to_numpy(float), pdf["pos"].to_numpy()
        out: list[list] = []  # first, last, length, weighted sum, unknown
        for i in range(len(v) - 1):
            a, b = v[i], v[i + 1]
            value = b if a != a else a if b != b else (a + b) / 2
            unknown = value != value
            if out and out[-1][4] == unknown and (unknown or out[-1][2] < least):
                p = out[-1]
                p[1], p[2], p[3] = i + 1, p[2] + span[i], p[3] + (0 if unknown else value * span[i])
            else:
                out.append([i, i + 1, span[i], 0 if unknown else value * span[i], unknown])
        whole: list[list] = []
        for p, after in zip(out, [*out[1:], None], strict=True):
            end_of_run = after is None or after[4] != p[4]
            if whole and end_of_run and not p[4] and not whole[-1][4] and p[2] < least:
                q = whole[-1]
                q[1], q[2], q[3] = p[1], q[2] + p[2], q[3] + p[3]
            else:
                whole.append(p)
        name = pdf[by].iloc[0]
        return pd.DataFrame([(name, int(pos[a]), int(pos[b]), float("nan") if unknown else s / n if n else 0.0) for a, b, n, s, unknown in whole], columns=[by, "first", "last", "value"])

    return df.groupBy(by).applyInPandas(cut, f"{by} {df.schema[by].dataType.simpleString()}, first int, last int, value double")


def strength_at(plan: DataFrame, asked: DataFrame, name: str = "name_id", frame: str = "frame", value: str = "strength") -> DataFrame:
    """A planned strength for each (name, frame) asked for; 0 where the plan has none."""
    found = plan.select(name, frame, F.col(value).alias("strength"))
    return asked.join(found, [name, frame], "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))


def path_lengths(df: DataFrame, by: str, order: str, x: str, y: str) -> DataFrame:
    """Vertices with `along`, the length of their line up to them, and `length`, that of all of it."""
    mine = W.partitionBy(by).orderBy(order)
    step = F.hypot(F.col(x) - F.lag(x).over(mine), F.col(y) - F.lag(y).over(mine))
    rows = df.withColumn("__d", F.coalesce(step, F.lit(0.0)))
    return rows.withColumns({"along": F.sum("__d").over(mine.rowsBetween(W.unboundedPreceding, 0)), "length": F.sum("__d").over(W.partitionBy(by))}).drop("__d")
