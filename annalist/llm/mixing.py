"""Mixing sources to target weights: Sainte-Laguë apportionment of equal blocks of words, then seeded blocks in each shard.

Targets. Sources are taken in the order of their code points, null last, and weigh `weights` in turn. They share `share` of
all words; a target stops at `most` times its source's size, and what is over goes to the others by weight until none is above.

Apportionment. All words of the mix are blocks of `block` words (fewer where the smallest source would have less than LEAST
blocks). They are allocated to sources one by one by the highest quotient target / (2k + 1), k being what the source has so
far. A source's documents are dealt to shards of about SHARD words by a hash; in the same way its blocks go to groups of
GROUP shards and from there to shards, by size, which gives each shard an integer quota.

Selection. A shard's documents lie one after the other in a seeded order and are cut into equal blocks. Each block is taken
quota div blocks times, and as many as the remainder says, chosen in a seeded order of the blocks, once more. So reruns agree,
a word is taken at most `most` times (an integer), and a document may be taken in part.

Texts are read once, for their sizes. What is shuffled and written are narrow rows; a source of any size is dealt to shards
of a bounded size, so none is a hot key. Highest quotients are found without walking: the share of a child fixes its quota up
to half its share of the number of children, and only the quotients within that are ranked.

Cases: null and empty texts have size 0 and are taken 0 words. A null source is a source of its own, the last. Repeated
rows are documents of their own, dealt by id and text. Null ids are dealt by text. Columns other than doc_id, text and source
are ignored. An empty table gives no rows; if all sizes are 0 so are all targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import read, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block and of a shard, blocks that the smallest source has at least (down to blocks of one word), shards of a group.
BLOCK, SHARD, LEAST, GROUP = 64, 1 << 16, 64, 1024


def sized(df: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, source, size in words, and a key that puts them in a seeded order."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    return df.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"), key.alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Of rows (source, source_size): no, weight and target besides. One row a source; whole words are summed, so the order of rows does not matter.

    Sources are capped in the order of their size by weight: the first that fits what is left for its weight ends it.
    """
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("no"), F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("no", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("bigint")).withColumn("weight", turn.cast("bigint"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy()
    rows = rows.withColumn("all", F.sum("source_size").over(over)).withColumn("left_weight", F.sum("weight").over(over) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("left", F.col("all") * F.lit(float(share)) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    fits = F.col("left") * F.col("weight") <= most * F.col("source_size") * F.col("left_weight")
    first = rows.withColumn("fits", fits).withColumn("rate", F.first(F.when(F.col("fits"), F.struct("left", "left_weight")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("rate").isNull(), most * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.col("rate.left") / F.col("rate.left_weight"))
    return first.select("source", "source_size", "no", "weight", target.cast("double").alias("target"))


def apportioned(children: DataFrame, parent: list[str], child: list[str], weight: str, seats: str, quota: str) -> DataFrame:
    """children with a column `quota`: the seats of their parent that go to each by the highest quotients weight / (2k + 1), ties by child.

    Let s be a child's share of the seats. The divisor that gives all seats differs from the mean one by at most half the
    number of children, so the quota lies within half of the child's share of that number, and one for rounding, of s.
    """
    of, w = Window.partitionBy(*parent), F.col(weight).cast("double")
    rows = children.withColumn("__sum", F.sum(w).over(of)).withColumn("__n", F.count("*").over(of))
    part = F.when(F.col("__sum") > 0, w / F.col("__sum")).otherwise(F.lit(0.0))
    rows = rows.withColumn("__slack", (F.ceil(part * F.col("__n") / 2) + 1).cast("bigint")).withColumn("__base", F.greatest(F.lit(0), (F.floor(part * F.col(seats) + 0.5)).cast("bigint") - F.col("__slack")))
    rows = rows.withColumn("__open", F.col(seats) - F.sum("__base").over(of))
    ranked = rows.select("*", F.explode(F.sequence("__base", F.col("__base") + 2 * F.col("__slack") + 1)).alias("__k"))
    order = Window.partitionBy(*parent).orderBy((w / (2 * F.col("__k") + 1)).desc(), *child, "__k")
    ranked = ranked.withColumn("__won", (F.row_number().over(order) <= F.col("__open")) & (w > 0))
    kept = [c for c in children.columns if c not in parent + child]
    counted = ranked.groupBy(*parent, *child).agg(*[F.first(c).alias(c) for c in kept], (F.first("__base") + F.sum(F.col("__won").cast("bigint"))).alias(quota))
    return counted.select(*children.columns, F.when(F.col(weight) > 0, F.col(quota)).otherwise(F.lit(0)).cast("bigint").alias(quota))


def block_size(sources: DataFrame, block: int = BLOCK) -> int:
    """block, or less, so that the smallest source with any words has LEAST blocks, if it has so many words."""
    smallest = sources.where("source_size > 0").agg(F.min("source_size")).first()[0]
    return max(1, min(block, (smallest or 0) // LEAST))


def shards(docs: DataFrame, sources: DataFrame, block: int, most: int = MOST) -> DataFrame:
    """no, shard, words, and times: how often each of the shard's equal blocks is taken."""
    spark = docs.sparkSession
    seats = F.floor(F.col("target") / block + 0.5).cast("bigint")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    own = apportioned(sources.withColumn("seats", F.lit(int(total / block + 0.5)).cast("bigint")).withColumn("one", F.lit(1)), ["one"], ["no"], "target", "seats", "quota").select("no", F.col("quota").alias("source_quota"))
    sums = docs.groupBy("no", "shard").agg(F.sum("size").alias("words")).withColumn("grp", F.floor(F.col("shard") / GROUP))
    sums = written(sums, "mixing-shards")
    groups = sums.groupBy("no", "grp").agg(F.sum("words").alias("group_words")).join(own, "no")
    groups = apportioned(groups, ["no"], ["grp"], "group_words", "source_quota", "group_quota").select("no", "grp", "group_quota")
    quotas = apportioned(sums.join(groups, ["no", "grp"]), ["no", "grp"], ["shard"], "words", "group_quota", "quota")
    blocks = F.greatest(F.lit(1), F.floor(F.col("words") / block + 0.5)).cast("bigint")
    quotas = quotas.withColumn("blocks", blocks).withColumn("quota", F.least("quota", most * F.col("blocks")))
    # blocks by a seeded hash: the first (quota mod blocks) of them are taken once more; then back in their own order
    seeded = F.array_sort(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.struct(F.md5(F.concat_ws(":", "no", "shard", j).cast("binary")).alias("h"), j.alias("j"))))
    often = F.transform(seeded, lambda x, i: F.struct(x["j"].alias("j"), (F.expr("quota div blocks") + F.when(i < F.col("quota") % F.col("blocks"), 1).otherwise(0)).cast("tinyint").alias("t")))
    return quotas.select("no", "shard", "words", F.transform(F.array_sort(often), lambda x: x["t"]).alias("times"))


def mix(df: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """Per row of df (doc_id, text, source): doc_id, source, size, source_size, target, and cuts: array of (start, length, times).

    A cut is a stretch of the document's words, numbered from 0, that the mix takes `times` times, times > 0.
    """
    narrow = written(sized(df), "mixing-sizes")
    sources = written(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mixing-sources")
    b = block_size(sources, block)
    number = F.pmod(F.conv(F.substring("key", 1, 12), 16, 10).cast("bigint"), F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard))
    docs = narrow.withColumnRenamed("source", "__source").join(sources, F.col("__source").eqNullSafe(F.col("source"))).drop("__source").withColumn("shard", number.cast("bigint"))
    own = written(shards(docs, sources, b, most), "mixing-quotas")
    order = Window.partitionBy("no", "shard").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = docs.withColumn("to", F.sum("size").over(order)).withColumn("at", F.col("to") - F.col("size")).join(own, ["no", "shard"])
    # block j of n covers the words from j * words div n on; the blocks that hold the first and the last word of a document
    n = F.size("times").cast("bigint")
    edge = lambda j: F.floor(j * F.col("words") / n)
    holds = lambda word: F.floor(((word + 1) * n - 1) / F.col("words"))
    cut = lambda j: F.struct((F.greatest(edge(j), F.col("at")) - F.col("at")).alias("start"), (F.least(edge(j + 1), F.col("to")) - F.greatest(edge(j), F.col("at"))).alias("length"), F.element_at("times", (j + 1).cast("int")).alias("times"))
    cuts = F.filter(F.transform(F.sequence(holds(F.col("at")), holds(F.col("to") - 1)), cut), lambda x: (x["length"] > 0) & (x["times"] > 0))
    none = F.array().cast("array<struct<start: bigint, length: bigint, times: tinyint>>")
    return placed.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, cuts).otherwise(none).alias("cuts"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.aggregate("cuts", F.lit(0).cast("bigint"), lambda n, x: n + x["length"] * x["times"])
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: Every seat of every child is written out and the highest are kept; blocks and documents meet by comparing their places.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (
  SELECT source, ss, no, [5, 2, 1][no % 3 + 1]::BIGINT AS w, sum(ss) OVER ()::BIGINT AS total, count(*) OVER () AS n
  FROM (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source)),
tried AS (
  SELECT a.no, (a.total * 1.5::DOUBLE - 2 * coalesce(sum(b.ss) FILTER (b.ss / b.w < a.ss / a.w OR b.ss / b.w = a.ss / a.w AND b.no < a.no), 0)) AS lft,
    sum(b.w) FILTER (NOT (b.ss / b.w < a.ss / a.w OR b.ss / b.w = a.ss / a.w AND b.no < a.no)) AS lw, any_value(a.ss / a.w) AS ratio, any_value(a.ss) AS ss, any_value(a.w) AS w
  FROM s a, s b GROUP BY a.no, a.total),
rate AS (SELECT ratio, no, lft, lw FROM tried WHERE lft * w <= 2 * ss * lw ORDER BY ratio, no LIMIT 1),
t AS (
  SELECT s.*, CASE WHEN r.no IS NULL OR s.ss / s.w < r.ratio OR s.ss / s.w = r.ratio AND s.no < r.no THEN 2 * s.ss::DOUBLE ELSE s.w * r.lft / r.lw END::DOUBLE AS target
  FROM s LEFT JOIN rate r ON true),
b AS (SELECT greatest(1, least(64, coalesce(min(ss) FILTER (ss > 0), 0) // 64))::BIGINT AS b, floor(sum(target) / any_value(1) / greatest(1, least(64, coalesce(min(ss) FILTER (ss > 0), 0) // 64)) + 0.5)::BIGINT AS seats FROM t),
q1 AS (
  SELECT no, count(*) AS quota FROM (
    SELECT no, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, no, k) AS place, seats
    FROM (SELECT no, target, seats, unnest(range(0, ceil(target / b)::BIGINT + n + 2)) AS k FROM t, b WHERE target > 0)) WHERE place <= seats GROUP BY no),
p AS (
  SELECT d.r, d.doc_id, d.size, d.key, t.no, t.ss, t.target, ('0x' || substr(d.key, 1, 12))::BIGINT % ceil(greatest(t.ss, 1) / 65536)::BIGINT AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (SELECT no, shard, shard // 1024 AS grp, sum(size)::BIGINT AS words FROM p GROUP BY no, shard),
g AS (SELECT no, grp, sum(words)::BIGINT AS words, sum(sum(words)) OVER (PARTITION BY no) AS al, count(*) OVER (PARTITION BY no) AS n FROM h GROUP BY no, grp),
q2 AS (
  SELECT no, grp, count(*) AS quota FROM (
    SELECT no, grp, row_number() OVER (PARTITION BY no ORDER BY words::DOUBLE / (2 * k + 1) DESC, grp, k) AS place, quota
    FROM (SELECT g.no, grp, words, quota, unnest(range(0, ceil(quota * words / al)::BIGINT + n + 2)) AS k FROM g JOIN q1 ON g.no = q1.no WHERE words > 0)) WHERE place <= quota GROUP BY no, grp),
q3 AS (
  SELECT no, shard, count(*) AS quota FROM (
    SELECT no, shard, row_number() OVER (PARTITION BY no, grp ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard, k) AS place, quota
    FROM (SELECT h.no, h.grp, shard, words, quota, unnest(range(0, ceil(quota * words / al)::BIGINT + n + 2)) AS k
          FROM (SELECT *, sum(words) OVER (PARTITION BY no, grp) AS al, count(*) OVER (PARTITION BY no, grp) AS n FROM h) h JOIN q2 ON h.no = q2.no AND h.grp = q2.grp WHERE words > 0)) WHERE place <= quota GROUP BY no, shard),
k AS (
  SELECT no, shard, words, n, least(quota, 2 * n) AS quota, unnest(range(0, n)) AS j
  FROM (SELECT h.no, h.shard, words, coalesce(quota, 0) AS quota, greatest(1, floor(words / b + 0.5))::BIGINT AS n FROM h LEFT JOIN q3 ON h.no = q3.no AND h.shard = q3.shard, b)),
x AS (
  SELECT no, shard, j * words // n AS lo, (j + 1) * words // n AS hi,
    quota // n + (row_number() OVER (PARTITION BY no, shard ORDER BY md5(no || ':' || shard || ':' || j)) <= quota % n)::BIGINT AS times FROM k),
o AS (SELECT *, (sum(size) OVER (PARTITION BY no, shard ORDER BY key, size, r ROWS UNBOUNDED PRECEDING))::BIGINT AS hi FROM p)
SELECT o.doc_id, any_value(o.size) AS size, any_value(o.ss) AS source_size, any_value(o.target) AS target,
  coalesce(sum((least(o.hi, x.hi) - greatest(o.hi - o.size, x.lo)) * x.times), 0)::BIGINT AS taken
FROM o LEFT JOIN x ON o.no = x.no AND o.shard = x.shard AND x.lo < o.hi AND x.hi > o.hi - o.size AND o.size > 0 GROUP BY o.r, o.doc_id
"""
