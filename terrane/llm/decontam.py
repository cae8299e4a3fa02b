"""Which documents contain benchmark items: containment search with size-partitioned MinHash, verified exactly.

Containment is asymmetric: a long text holds a short item although their Jaccard similarity is near zero, so MinHash banding
of whole documents would miss it.  Items are therefore partitioned by their number of n-grams, and each partition gets the
signature length that makes its search complete: of an item with s distinct n-grams, a document that holds at least
ceil(t * s) of them holds one of its s - ceil(t * s) + 1 least hash values (bottom-k MinHash).  Documents with fewer n-grams
than an item needs are never probed for it.  Every candidate is then checked on all n-grams of both.

All of it is DataFrame expressions: n-grams are hashed inside the row, exploded only into a hash join with the items'
signatures, and the check reads the row's own array, so no text is shuffled.  The items' tables are broadcast only if
their bytes, counted first, are under `most_broadcast`; beyond that documents' and items' n-grams meet in a shuffled join and
are counted.

Words are lower-case and split at ASCII white space.  Defined cases: null and short texts hold nothing; an item of fewer
than n words has no n-gram and is in nothing; repeated rows give one pair; a null id stays null; an empty table gives no
rows; other columns, whatever their names, are not read and stay as they are; a text or an item of any length is one array of
hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Bytes that a broadcast row takes, of a probe and of an item besides its n-grams.
PROBE, ITEM = 64, 128
#: The split pattern: ASCII white space.
SPACE = "[\\x09-\\x0D\\x20]+"


def gram_hashes(text: Column, n: int) -> Column:
    """The hashes of all word n-grams of a text, in order, with repeats."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))
        return F.when(F.size(h) >= n, own).otherwise(F.array().cast("array<bigint>"))

    # a lambda's argument is evaluated once; an expression named in the inner lambda would be, for every place
    return F.get(F.transform(F.array(hashed), grams), 0)


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_broadcast: int = 64 << 20) -> DataFrame:
    """One row per (doc_id, item_id) with containment >= threshold: n_item (the item's distinct n-grams), n_shared, containment.
    most_broadcast: bytes of signatures and items that are sent to all executors; beyond it both sides are shuffled."""
    sized = items.select(F.col(item_col).alias("item_id"), F.array_distinct(gram_hashes(F.col(item_text), n)).alias("grams")).where("size(grams) > 0").distinct()
    sized = sized.withColumn("n_item", F.size("grams").cast("long"))
    # whole numbers of millionths: n_item * 0.8 is no question of rounding
    sized = sized.withColumn("need", F.expr(f"(n_item * {round(threshold * 10**6)}L + 999999L) div 1000000L"))
    # a probe is sent as its hash and its item's, each item once with its n-grams; PROBE and ITEM are what a row takes besides
    sent = F.sum((F.col("n_item") - F.col("need") + 1) * PROBE + F.col("n_item") * 8 + ITEM)
    if (sized.agg(sent.alias("n")).first()["n"] or 0) <= most_broadcast:
        whole = sized.withColumn("item", F.xxhash64("grams"))
        probes = whole.select("item", "need", F.explode(F.slice(F.array_sort("grams"), F.lit(1), (F.col("n_item") - F.col("need") + 1).cast("int"))).alias("probe")).distinct()
        rows = docs.select(F.col(id_col).alias("doc_id"), gram_hashes(F.col(text_col), n).alias("own"))
        hits = rows.select("doc_id", "own", F.explode("own").alias("probe")).join(F.broadcast(probes), "probe").where("size(own) >= need")
        hits = hits.select("doc_id", "own", "item").join(F.broadcast(whole.select("item", "item_id", "n_item", "need", "grams")), "item")
        hits = hits.select("doc_id", "item_id", "n_item", "need", F.size(F.array_intersect("own", "grams")).alias("n_shared")).distinct()
    else:
        # rows that are shuffled carry one hash, not their text's array; equal rows of one id count once
        every = sized.select("item_id", "n_item", "need", F.xxhash64("grams").alias("item"), F.explode("grams").alias("probe"))
        row = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.array_distinct(gram_hashes(F.col(text_col), n)).alias("own"))
        hits = row.select("doc_id", "row", F.explode("own").alias("probe")).join(every, "probe")
        hits = hits.groupBy("doc_id", "row", "item_id", "item", "n_item", "need").agg(F.count_distinct("probe").alias("n_shared"))
    return hits.where("n_shared >= need").select(
        "doc_id", "item_id", "n_item", F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n_item")).alias("containment")
    ).distinct()


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """The rows of docs that hold no item."""
    (mark,) = fresh(docs, "bad")
    bad = contained(docs, items, threshold, n).select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(mark)), "left_anti")


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x09-\\x0D\\x20]+'), lambda w : w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x09-\\x0D\\x20]+'), lambda w : w <> '') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM c JOIN n USING (item_id) WHERE n_shared * 1000000 >= n_item * 800000
"""
