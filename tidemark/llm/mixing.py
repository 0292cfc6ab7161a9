"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Each document has a 60-bit hash of its id and text, so null and repeated ids are drawn apart. A source's budget is whole repeats of everything plus a rest; the documents
with the smallest hashes fill the rest. The threshold is found without sorting: words are summed by source and the
hash's first byte, the bucket that holds the budget's edge is refined by the next byte, twice, and the few hashes left
in the edge bucket are ordered exactly. One filter against the thresholds then decides every document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: The hash has HASH_BITS bits; each of LEVELS histograms resolves BUCKET_BITS of them.
HASH_BITS, BUCKET_BITS, LEVELS = 60, 8, 3
#: Tasks that write a row for each source; and sources up to which their thresholds, a row of a few numbers each, are broadcast.
SOURCE_TASKS, FEW_SOURCES = 8, 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(key: Column, text: Column, seed: str) -> Column:
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sized: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Per source: source_size, target, and its words as whole repeats and a rest. Capped shares are reshared by weight.

    With the sources in order of cap / weight, the level (words a unit of weight) that the sources from here on would
    get is (total - caps before) / (weight - weights before); the first source that stays below its cap has the level.
    """
    per = sized.groupBy("_s", "_src").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy(F.lit(1))
    order = everyone.orderBy(F.col("_src").isNull(), "_src")
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * float(most))
    before = everyone.orderBy(F.col("_cap") / F.col("_w"), F.col("_src").isNull(), "_src").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "_level": (F.sum("source_size").over(everyone) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))),
        "_pos": F.coalesce(F.count("_w").over(before), F.lit(0)),
    })
    free = F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.struct("_pos", "_level"))
    per = per.withColumn("target", F.least("_cap", F.min(free).over(everyone)["_level"] * F.col("_w")))
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    return per.select("_s", "source_size", "target", whole.alias("_whole"), (words - whole * F.col("source_size")).alias("_rest"))


def _edge(rows: DataFrame, state: DataFrame, bucket: Column) -> DataFrame:
    """For each source the bucket in which its rest ends: (_s, _bucket, _rest within it, _sum of the bucket)."""
    hist = rows.groupBy("_s", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).join(state.select("_s", "_rest"), "_s")
    hist = hist.where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_sum")))
    return hist.select("_s", "_bucket", (F.col("_rest") - F.col("_before")).alias("_rest"), "_sum")


def _salts(df: DataFrame) -> int:
    """Parts into which each source's rows are dealt where thresholds are joined: some for each shuffle partition, so that a source of any share is spread over all."""
    return max(32, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _met(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """rows with their source's state: by broadcast if the sources, counted, are few; else each source is dealt over salts."""
    if few:
        return rows.join(F.broadcast(state), "_s")
    salts = F.sequence(F.lit(0), F.lit(_salts(state) - 1))
    return rows.withColumn("_salt", F.pmod(F.col("_h"), F.lit(_salts(state))).cast("int")).join(state.withColumn("_salt", F.explode(salts)), ["_s", "_salt"]).drop("_salt")


def mix(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_repeat: int = 3, boundary: str = "cut", seed: str = "mix", carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of docs: key, size, source_size, target, taken, copies (whole repeats), cut_words (words of one
    more, cut repeat) and the columns named in carry.

    Sources in code point order, null last, take the weights in turn. The total mixed is the total size; a source's
    target stops at max_repeat times its size and the excess is reshared. A source's documents are all taken
    floor(target / size) times; those with the smallest hashes once more until the target is met. The document at the
    edge gives its first words (boundary="cut"), or is taken whole if at least half of it fits ("nearest").
    Rows at the edge with one hash (equal in id and text) share the rest in proportion to their sizes, rounded down.
    Null or empty text has size 0 and adds no words, however often its source repeats; rows with null or repeated ids differ by their texts; an empty
    table gives no rows.
    """
    if boundary not in ("cut", "nearest"):
        raise ValueError("boundary is 'cut' or 'nearest'")
    sized = docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_src"), F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source))).alias("_s"),
        word_count(F.col(text)).alias("size"), _hash(F.col(key), F.col(text), seed).alias("_h"), *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    slim = cut(sized.select("_key", "_src", "_s", "size", "_h"))
    goal = cut(targets(slim, weights, max_repeat).coalesce(SOURCE_TASKS))
    few = goal.count() <= FEW_SOURCES
    rows, state = slim, goal
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BUCKET_BITS * level
        state = cut(_edge(rows, state, F.shiftright("_h", shift)).coalesce(SOURCE_TASKS))
        rows = _met(rows, state.select("_s", F.col("_bucket").alias("_in")), few).where(F.shiftright("_h", shift) == F.col("_in")).drop("_in")
        if level == 1:
            rows = cut(rows.select("_s", "size", "_h"))  # about a 256th of the table
    state = _edge(rows, state, F.col("_h")).select("_s", F.col("_bucket").alias("_edge"), F.col("_rest").alias("_left"), F.col("_sum").alias("_tied"))
    goal = cut(goal.join(state, "_s", "left").coalesce(SOURCE_TASKS))
    joined = _met(sized if carry else slim, goal, few)
    part = F.expr("(_left * size) div _tied") if boundary == "cut" else F.when(F.col("_left") * 2 >= F.col("_tied"), F.col("size")).otherwise(F.lit(0))
    extra = F.when(F.col("_edge").isNull() | (F.col("size") == 0), F.lit(0)).when(F.col("_h") < F.col("_edge"), F.col("size")).when(F.col("_h") == F.col("_edge"), part).otherwise(F.lit(0)).cast("long")
    joined = joined.withColumn("_extra", extra)
    whole = F.col("_whole") + F.when((F.col("_extra") == F.col("size")) & (F.col("size") > 0), F.lit(1)).otherwise(F.lit(0))
    return joined.select(
        F.col("_key").alias(key), "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_extra")).alias("taken"),
        whole.cast("long").alias("copies"), F.when(F.col("_extra") < F.col("size"), F.col("_extra")).otherwise(F.lit(0)).cast("long").alias("cut_words"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
             CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT *, row_number() OVER o AS pos,
             ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source)),
v AS (SELECT level FROM l WHERE cap >= level * w ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM v) * w) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, round(g.target)::BIGINT - g.whole * g.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source, d.h)::BIGINT AS tied,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
r AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN upto <= rest THEN size WHEN upto - tied >= rest THEN 0 ELSE (rest - (upto - tied)) * size // tied END AS extra FROM c)
SELECT doc_id, size, source_size, target, (whole * size + extra)::BIGINT AS taken,
       (whole + CASE WHEN size > 0 AND extra = size THEN 1 ELSE 0 END)::BIGINT AS copies,
       (CASE WHEN extra < size THEN extra ELSE 0 END)::BIGINT AS cut_words FROM r
"""
