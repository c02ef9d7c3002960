"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key (MD5 of its id). The keys' leading bits range-partition each source into buckets
of about the square root of all rows, so that a source with a third of all rows is spread over as many tasks as any
other; a running sum inside the buckets plus the sum of all earlier buckets is the prefix sum of word counts in key
order. A source whose budget is e whole epochs and a rest takes every document e times and those before the cut once
more; the document at the cut is taken in part, so that each source meets its budget to the word.

Budgets: all sources in code-point order, null last, weigh 3, 1, 2, 3, 1, 2, ...; they share 150 % of all words by weight.
A source can give at most twice its words; what is above goes to the others by weight until none is above. That fixed
point is a level L with target = min(2 * size, L * weight), found from sums over the sources sorted by 2 * size / weight.

Defined results: null and empty texts have size 0, take 0; a null source is a source of its own; rows with one doc_id
are ordered by their size, and rows equal in both are interchangeable; an empty table gives an empty table; other
columns are ignored by ``mix`` and kept by ``mixed_documents``, whatever their names. Reruns agree: the keys depend on
doc_id and the seed alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlex.llm.common import table, written
from lumenlex.llm.graph import join_checked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "lumenlex-mix"
WORD = r"[^\x20\x09-\x0D]+"
#: The bits of the key that the bucket is cut from.
KEY_BITS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target). One row per source, so the windows over all are small."""
    everything = Window.partitionBy()
    in_order = everything.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double").alias("w"),
        (F.col("source_size") * F.lit(float(most))).alias("ceiling"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("whole"),
    )
    by_ratio = everything.orderBy(F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("whole") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("w").over(onwards)
    levelled = weighed.select("source", "source_size", "w", "ceiling", level.alias("level"))
    # The first source, by ratio, that stays under its ceiling sets the level of all that follow.
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("ceiling"), F.struct(F.col("ceiling") / F.col("w"), "level"))).over(everything)
    return levelled.select("source", "source_size", F.least("ceiling", F.coalesce(first["level"] * F.col("w"), F.col("ceiling"))).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, whole_epochs, part: what the mix takes of every row.

    taken = whole_epochs * size + part, in words; part is the document's share of the last, incomplete epoch.
    """
    rows = docs.count()
    bits = min(KEY_BITS - 1, max(0, math.ceil(math.log2(max(1.0, math.sqrt(rows))))))
    key = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":" + seed)))
    bucket = F.shiftright(F.conv(F.substring(key, 1, KEY_BITS // 4), 16, 10).cast("bigint"), KEY_BITS - bits)
    keyed = docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"), key.alias("key"), bucket.alias("bucket"))

    per_bucket = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    in_source = Window.partitionBy("source")
    offsets = per_bucket.select(
        "source",
        "bucket",
        F.coalesce(F.sum("in_bucket").over(in_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    budgets = targets(per_bucket.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, share, most)
    offsets = offsets.alias("o").join(budgets.alias("b"), F.col("o.source").eqNullSafe(F.col("b.source"))).select("o.*", "source_size", "target")

    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("earlier")).alias("d")
    found = summed.join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
    budget = F.floor(F.col("target")).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("offset") + F.col("earlier"))))
    out = found.select("d.doc_id", "d.source", "size", "source_size", "target", epochs.alias("whole_epochs"), part.alias("part"))
    return out.withColumn("taken", F.col("whole_epochs") * F.col("size") + F.col("part"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space before it included."""
    separator = r"[\x20\x09-\x0D]+"
    leading = F.when(F.rlike(text, F.lit(r"^[\x20\x09-\x0D]")), 1).otherwise(0)
    more = F.concat(text, F.lit(" ."))  # so that something follows the last word
    rest = F.element_at(F.split(more, separator, n + 1 + leading), -1)
    return F.rtrim(F.left(more, F.length(more) - F.length(rest)), F.lit(" \t\n\x0b\x0c\r"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a row for each whole epoch and one for a part; n_chars follows the text.

    Rows of size 0 carry no words and cost nothing; they stay once.
    """
    decided = mix(docs, seed).groupBy("doc_id", "source", "size").agg(F.max("whole_epochs").alias("e"), F.sort_array(F.collect_list("part")).alias("parts"))
    decided = written(decided, "mix")
    sized = docs.withColumn("__size", word_count(docs["text"]))
    repeated = not decided.filter(F.size("parts") > 1).isEmpty()
    copy = F.row_number().over(Window.partitionBy("doc_id", "source", "__size").orderBy("text")) if repeated else F.lit(1)
    ranked = sized.withColumn("__copy", copy).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.__size") == F.col("t.size"))
    joined = join_checked(ranked, decided.alias("t"), same, "inner")
    part = F.element_at("t.parts", F.col("d.__copy"))
    amounts = F.when(F.col("d.__size") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.filter(F.concat(F.array_repeat(F.col("d.__size"), F.col("t.e").cast("int")), F.array(part)), lambda n: n > 0)
    )
    taken = joined.select("d.*", F.explode(amounts).alias("__take"))
    whole = F.col("__take") == F.col("__size")
    text = F.when(whole, F.col("text")).otherwise(first_words(F.col("text"), F.col("__take").cast("int")))
    columns = {"text": text} | ({"n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast("bigint"))} if "n_chars" in docs.columns else {})
    return taken.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what the mix takes of each."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':lumenlex-mix') AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * CAST(2 AS DOUBLE) AS ceiling, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS whole,
             CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS w FROM s),
l AS (SELECT *, (whole - coalesce(sum(ceiling) OVER (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, ceiling / w) AS level FROM l WHERE level * w <= ceiling),
t AS (SELECT l.source, source_size, least(ceiling, coalesce(f.level * w, ceiling)) AS target FROM l, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - earlier)) AS BIGINT) AS taken FROM e
"""
