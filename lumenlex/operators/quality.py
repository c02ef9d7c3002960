"""The quality report of a corpus: every section as a frame, and the whole as one dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlex.functions import text as X
from lumenlex.sources.scratch import written

TOP_TOKENS = 20
TOP_CHARACTERS = 15


def token_totals(frequency: DataFrame) -> DataFrame:
    at_least = [F.count_if(F.col("n") >= k).alias(f"seen_at_least_{k}") for k in (5, 10, 20)]
    whole = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total")
    return frequency.agg(whole, F.count(F.lit(1)).alias("distinct_tokens"), F.count_if(F.col("n") == 1).alias("seen_once"), *at_least)


def sentence_lengths(sentences: DataFrame) -> DataFrame:
    """min, median, p95, max, n_sentences and n_tokens in one row.

    p95 is the length at place min(n - 1, floor(0.95 n)) of the sorted lengths; it and the median are read from the
    cumulative counts of the distinct lengths, which are few, so no list of all lengths is sorted.
    """
    counts = sentences.groupBy(F.size("tokens").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy().orderBy("length")
    summed = counts.select("length", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("whole"))

    def at(place) -> F.Column:
        return F.min(F.when(F.col("upto") > place, F.col("length")))

    whole = F.col("whole")
    median = (at(F.floor((whole - 1) / 2)) + at(F.floor(whole / 2))) / 2
    p95 = at(F.least(whole - 1, F.floor(whole * F.lit(0.95).cast("double"))))
    return summed.agg(
        F.min("length").alias("min_length"),
        median.alias("median_length"),
        p95.alias("p95_length"),
        F.max("length").alias("max_length"),
        F.sum("n").alias("n_sentences"),
        F.sum(F.col("n") * F.col("length")).alias("n_tokens"),
    )


def first_seen(sentences: DataFrame) -> DataFrame:
    """word, n, first (place of its first occurrence). Each batch of sentences counts its own words before they are shuffled."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.take(pc.sort_indices(batch, sort_keys=[("page_ord", "ascending"), ("sent_idx", "ascending")]))
            tokens = rows.column("tokens")
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            words = tokens.flatten().dictionary_encode()
            _, at, n = np.unique(words.indices.to_numpy(), return_index=True, return_counts=True)
            row = np.repeat(np.arange(len(sizes)), sizes)[at]
            pos = at - (np.cumsum(sizes) - sizes)[row]
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n), rows.column("page_ord").take(pa.array(row)), rows.column("sent_idx").take(pa.array(row)), pa.array(pos, pa.int32())], names)

    names, kinds = ["word", "n", "page_ord", "sent_idx", "pos"], dict(sentences.dtypes)
    schema = f"word string, n bigint, page_ord {kinds['page_ord']}, sent_idx {kinds['sent_idx']}, pos int"
    placed = sentences.select("page_ord", "sent_idx", "tokens").mapInArrow(seen, schema)
    return placed.groupBy("word").agg(F.sum("n").alias("n"), F.min(F.struct("page_ord", "sent_idx", "pos")).alias("first"))


def most_frequent(sentences: DataFrame, k: int = TOP_TOKENS, seen: DataFrame | None = None) -> DataFrame:
    """The k most frequent tokens; ties by first occurrence. ``seen``: ``first_seen`` of the sentences, where it is there already."""
    return (seen or first_seen(sentences)).orderBy(F.desc("n"), "first").limit(k).select("word", "n")


def character_counts(frequency: DataFrame) -> DataFrame:
    """bucket, n: characters of all tokens by class; a class without characters has no row."""
    chars = frequency.select("n", F.explode(F.split("word", "")).alias("ch")).filter("ch <> ''")
    return chars.groupBy(X.character_bucket(F.col("ch")).alias("bucket")).agg(F.sum("n").alias("n"))


def top_other_characters(sentences: DataFrame, k: int = TOP_CHARACTERS, seen: DataFrame | None = None) -> DataFrame:
    """The k most common characters of no class: ch, label, n; ties by first occurrence, token by token. ``seen`` as above."""
    # Most words hold characters of the classes only; they go before their characters are told apart.
    inside = "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for _, ranges in X.BUCKETS for low, high in ranges)
    chars = (seen or first_seen(sentences)).filter(F.rlike("word", F.lit(f"[^{inside}]"))).select("n", "first", F.posexplode(F.split("word", "")).alias("at", "ch")).filter("ch <> ''")
    other = chars.filter(X.character_bucket(F.col("ch")) == "other")
    counted = other.groupBy("ch").agg(F.sum("n").alias("n"), F.min(F.struct("first", "at")).alias("place"))
    return counted.orderBy(F.desc("n"), "place").limit(k).select("ch", X.code_point_label(F.col("ch")).alias("label"), "n")


def dedup_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """before_deduplication, after_deduplication, duplicates_removed in one row."""
    a = before.agg(F.count(F.lit(1)).alias("before_deduplication"))
    b = after.agg(F.count(F.lit(1)).alias("after_deduplication"))
    return a.crossJoin(b).withColumn("duplicates_removed", F.col("before_deduplication") - F.col("after_deduplication"))


def build_quality_report(before: DataFrame, sentences: DataFrame, n_pages: int, pages_without: int, raw_characters: int) -> dict:
    """The report as a dictionary of plain numbers; percentages and means are rounded on the driver.

    Every section is an aggregate; what reaches the driver are single rows and the two short top lists. The words are
    counted once and written; the frames given are read more than once, so what is costly to make should be written too.
    """
    if raw_characters < 1:
        raise ValueError("raw_characters must be at least 1")
    if not 0 <= pages_without <= n_pages:
        raise ValueError("pages_without_sentences must lie between 0 and n_pages")
    counts = dedup_counts(before, sentences).first()
    n_before, n_after = counts["before_deduplication"], counts["after_deduplication"]
    if not n_after:
        raise ValueError("the final corpus has no sentences")
    if n_after > n_before:
        raise ValueError("the final corpus is larger than the one before deduplication")
    seen = written(first_seen(sentences), "words")
    frequency = seen.select("word", "n")
    totals, lengths = token_totals(frequency).first(), sentence_lengths(sentences).first()
    characters = {r["bucket"]: r["n"] for r in character_counts(frequency).collect()}
    kept = sum(characters.values())
    whole = lambda x: int(x) if x == int(x) else x
    return {
        "documents": {"article_pages": n_pages, "pages_without_usable_sentences": pages_without, "pages_with_usable_sentences": n_pages - pages_without},
        "sentences": {
            "before_deduplication": n_before,
            "after_deduplication": n_after,
            "exact_duplicates_removed": n_before - n_after,
            "duplicate_percent": round(100 * (n_before - n_after) / n_before, 2),
        },
        "tokens": {
            "total": totals["total"],
            "distinct": totals["distinct_tokens"],
            "seen_once": totals["seen_once"],
            **{f"seen_at_least_{k}": totals[f"seen_at_least_{k}"] for k in (5, 10, 20)},
            "most_frequent_20": [(r["word"], r["n"]) for r in most_frequent(sentences, seen=seen).collect()],
        },
        "sentence_length_tokens": {
            "min": lengths["min_length"],
            "mean": round(totals["total"] / n_after, 2),
            "median": whole(lengths["median_length"]),
            "p95": lengths["p95_length"],
            "max": lengths["max_length"],
        },
        "characters_in_final_tokens": characters,
        "most_common_other_characters": [[r["ch"], r["label"], r["n"]] for r in top_other_characters(sentences, seen=seen).collect()],
        "discarded_text": {
            "raw_characters": raw_characters,
            "characters_in_final_tokens": kept,
            "retained_character_percent": round(100 * kept / raw_characters, 2),
        },
    }
