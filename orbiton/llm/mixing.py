"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 2), DataFrame functions only.

A source's target is met by whole epochs first: every document as often as the target holds the source.
What remains is a weighted sample without replacement: each document draws the exponential key
-ln(u) / quality, documents are taken in key order, and a prefix sum of sizes meets the rest.

The prefix sum never sorts a source in one task. Keys fall into fixed buckets; sums by (source, bucket)
tell the one bucket of each source in which the budget ends. While it holds many documents (MOST_SORTED), it
is cut again between its own least and largest key; only what is left on the edge is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import fresh, spool

WORD = r"[^\x20\x09-\x0D]+"
#: Key buckets of a source: a source of any size is cut into so many pieces by the rank of its keys.
BUCKETS = 4096
#: Documents of a source's edge bucket that are sorted in one task; a larger bucket is cut again.
MOST_SORTED = 20_000
#: No source is taken more often than this.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A document's quality weight: the share of its first-class characters (not symbols or digits), at least 0.05."""
    n = F.length(text)
    plain = F.length(F.translate(text, "0123456789#*$%&|<>=_@!", ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), plain / n)).otherwise(F.lit(0.05))


def uniform(*parts: Column, seed: int) -> Column:
    """A keyed draw from the open unit interval, the same in every run: 52 bits of an MD5 digest."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target double) from (source, size): shares of the whole by the weights in turn.

    Sources are numbered by code point, null last. A target stops at `most` times its source; what is over
    is shared by weight among the others until none is above. That fixed point has one level: with sources
    by rising most * size / weight, the first at which (whole - targets so far) / (weights left) stays under
    its own ratio. The sums run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("i") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "i", "level"))).over(Window.partitionBy())["level"]
    per = per.withColumn("free", free)
    return per.select("source", "source_size", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("free") * F.col("w"))).alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 17, most: float = MOST_EPOCHS) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies long, taken long.

    Sizes are words of the whole text (null: 0). copies counts whole documents: the source's epochs, and
    one more for those the remaining budget reaches, where the document on the edge is in if the budget
    covers half of it; so a source misses its target by at most half a document. taken = copies * size.
    Keys depend on doc_id, size and seed alone; ties go by doc_id. Repeated rows are documents of their own.
    Empty documents fill no budget and come with the epochs. Other columns are ignored; an empty table gives
    no rows.
    """
    key = -F.log(uniform(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("size"), seed=seed)) / F.col("quality")
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_quality(F.col("text")).alias("quality"))
    d = d.select("doc_id", "source", "size", key.alias("key"))
    # Buckets follow the keys' order; 1 - exp(-key) spreads them evenly for weights near one.
    d = spool(d.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int")))
    want = targets(d, weights, most)
    want = want.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    want = want.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    def ends(part: DataFrame, start: Column) -> DataFrame:
        """By source s0, the keys lo to hi of the bucket in which the rest ends, what is before it and its documents n."""
        sums = part.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first(start).alias("start"))
        sums = sums.withColumn("upto", F.col("start") + F.sum("held").over(Window.partitionBy("source").orderBy("bucket")))
        sums = sums.withColumn("before", F.col("upto") - F.col("held")).where("before < rest and upto >= rest")
        return spool(sums.select(F.col("source").alias("s0"), "lo", "hi", "before", "n"))

    mine = F.col("source").eqNullSafe(F.col("s0"))
    rests = want.select(F.col("source").alias("s1"), "rest")
    edge = ends(d.join(rests, F.col("source").eqNullSafe(F.col("s1"))).drop("s1"), F.lit(0).cast("long"))
    # Each round cuts the range of keys by BUCKETS; documents of one key can't be parted.
    while edge.where((F.col("n") > MOST_SORTED) & (F.col("hi") > F.col("lo"))).limit(1).count():
        inside = d.join(edge, mine & F.col("key").between(F.col("lo"), F.col("hi"))).join(rests, F.col("source").eqNullSafe(F.col("s1"))).drop("s1")
        finer = F.when((F.col("n") > MOST_SORTED) & (F.col("hi") > F.col("lo")), F.least(F.lit(BUCKETS - 1), F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS))).otherwise(0)
        edge = ends(inside.withColumn("bucket", finer.cast("int")), F.col("before"))
    # One row for each source; without a rest there is no edge.
    want = spool(want.join(edge, mine, "left").select(F.col("source").alias("s1"), "source_size", "target", "epochs", "rest", "lo", "hi", "before"))
    d = d.join(want, F.col("source").eqNullSafe(F.col("s1"))).drop("s1")
    on_edge = F.coalesce(F.col("key").between(F.col("lo"), F.col("hi")), F.lit(False))
    sure = d.where(~on_edge).withColumn("more", F.coalesce(F.col("key") < F.col("lo"), F.lit(False)))
    inner = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = d.where(on_edge).withColumn("more", F.col("before") + F.sum("size").over(inner) - F.col("size") / 2 <= F.col("rest"))
    out = sure.unionByName(last)
    copies = F.col("epochs") + (F.col("more") & (F.col("size") > 0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 17, most: float = MOST_EPOCHS) -> DataFrame:
    """The mixed corpus: each row of docs, columns as they are, as often as plan() takes its document.

    Rows whose doc_id is null are in the plan but can't be found again and are left out; rows that share a
    doc_id are each taken as often as the plan's least count for it. Null and empty texts have no words and
    come with the epochs; columns of any name are kept; an empty table stays empty.
    """
    names = docs.columns
    n, each = fresh(names, "_copies"), fresh(names, "_copy")
    copies = plan(docs.select("doc_id", "text", "source"), weights, seed, most).groupBy("doc_id").agg(F.min("copies").alias(n)).where(F.col(n) > 0)
    return docs.join(copies, "doc_id").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias(each)).drop(each)


#: plan() with its defaults, as DuckDB SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE, length(translate(text, '0123456789#*$%&|<>=_@!', ''))::DOUBLE / length(text)) ELSE 0.05::DOUBLE END AS quality
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('17|' || coalesce(doc_id, -1) || '|' || size), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / quality AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, i LIMIT 1)) AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) AS reach
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
  ((epochs + CASE WHEN size > 0 AND rest > 0 AND reach - size / 2 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""
