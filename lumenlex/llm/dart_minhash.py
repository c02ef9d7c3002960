"""MinHash near-dedup by DartMinHash signatures.

A text is the weighted set of its five-word shingles (words are lower-cased runs of letters and digits), each weighing as
often as it occurs; similarity is the weighted Jaccard similarity, the sum of the smaller over the sum of the larger
weights. A shingle of weight w owns the region [0, w) of the weight axis. Hashed darts fall on that region along a rank
axis, one for each unit of area on average, at places that depend on the shingle and the unit of weight alone, and each
carries one of ``COORDINATES`` coordinates. A signature keeps the earliest dart of every coordinate. Two texts agree in
a coordinate with the probability of their similarity. Only darts up to the rank where all coordinates are expected to
be filled are thrown, so the work is the size of the set plus some thousand darts, not their product; the few texts that
miss a coordinate throw on to twice the rank.

Signatures are cut into ``BANDS`` bands of ``ROWS`` coordinates; texts that agree in a band are candidates, found by
sorted neighbours within the bands' buckets (see graph.bucket_pairs), and verified exactly on their whole shingle sets.
Verified pairs form the classes. Then all texts that are still apart in a shared bucket are verified with each other
(see graph.pairs_apart), however crowded it is.
At similarity 0.8 a pair shares a band with probability 0.9999.

Texts with the same words in the same order are copies: they are grouped by a digest before anything is joined, so groups
of thousands of copies cost one row in each step.

Defined results: null and empty texts, and texts without words, are copies of each other; texts of fewer than five
words have one shingle; a class is named by its smallest doc_id (null if it has none); repeated rows are copies of each
other; an empty table gives an empty table; other columns are ignored, and kept by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm.common import map_arrow, table, written
from lumenlex.llm.graph import bucket_pairs_and_crowds, components, join_checked, pairs_apart
from lumenlex.llm.hashing import Split, mixed, segments, shingles

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
#: Characters of text that are worked on at a time; one longer text makes a longer array.
CHUNK = 200_000
_CELL, _DART = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)


def cells(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (shingle, unit of weight) of each text, hashed: the m-th occurrence of a shingle is its m-th unit."""
    order = np.lexsort((ids, text))
    ids, text = ids[order], text[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (text[1:] != text[:-1])]) if len(ids) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    unit = np.arange(len(ids)) - np.repeat(first, np.diff([*first, len(ids)]))
    return mixed(ids + unit.astype(np.uint64) * _CELL), text


def signatures(cell: np.ndarray, text: np.ndarray, n_texts: int, k: int = COORDINATES) -> np.ndarray:
    """(n_texts, k) of the earliest darts. Rows of texts without cells are 0."""
    out = np.zeros((n_texts, k), np.uint64)
    weight = np.bincount(text, minlength=n_texts)
    bound = np.full(n_texts, k * (math.log(k) + 4.0)) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        own = todo[text]
        seed, of = cell[own], text[own]
        rank, throw = np.zeros(len(seed)), 0
        darts, ranks, places = [], [], []
        while len(seed):
            throw += 1
            dart = mixed(seed + np.uint64(throw * int(_DART) % (1 << 64)))
            # The gap to the next dart on a unit of weight is exponential; the coordinate comes from other bits.
            rank = rank - np.log(((dart >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52))
            live = rank <= bound[of]
            seed, of, rank, dart = seed[live], of[live], rank[live], dart[live]
            coordinate = (mixed(dart ^ _CELL) >> np.uint64(32)).astype(np.int64) * k >> 32
            darts.append(dart)
            ranks.append(rank)
            places.append(of * k + coordinate)
        dart, rank, place = (np.concatenate(x) for x in (darts, ranks, places))
        earliest = np.full(n_texts * k, np.inf)
        np.minimum.at(earliest, place, rank)
        kept = rank == earliest[place]
        flat = out.reshape(-1)
        flat[place[kept]] = dart[kept]
        filled = np.isfinite(earliest).reshape(n_texts, k).all(1)
        todo &= ~filled
        bound[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _DART, parts.shape[:2]).copy()
    for r in range(rows):
        h = mixed(h ^ parts[:, :, r]) + np.uint64(r)
    return mixed(h).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the words, text_key, keys of the bands, cells (sorted, 4 bytes each) of every row."""

    def of_texts(texts: list[str]) -> tuple[list[bytes], np.ndarray, list[bytes]]:
        split = Split(texts)
        words = mixed(split.hashes())
        ends = np.cumsum(split.counts)
        digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends - split.counts, ends, strict=True)]
        cell, text = cells(*shingles(split, SHINGLE))
        keys = band_keys(signatures(cell, text, len(texts)))
        short = (cell >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((short, text))
        short, bounds = short[order], np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
        return digests, keys, [short[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, keys, held, texts, size = [], [], [], [], 0
        values = [value.as_py() or "" for value in batch.column(1)]
        for at, text in enumerate(values):
            texts.append(text)
            size += len(text)
            if size >= CHUNK or at + 1 == len(values):
                d, k, c = of_texts(texts)
                digests += d
                keys += [row if len(x) else None for row, x in zip(k.tolist(), c, strict=True)]
                held += c
                texts, size = [], 0
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "digest": pa.array(digests, pa.binary()), "text_key": batch.column(2), "bands": pa.array(keys, pa.list_(pa.int64())), "cells": pa.array(held, pa.binary())})

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"], F.xxhash64(docs["text"]).alias("text_key"))
    return map_arrow(rows, batch_of, "doc_id bigint, digest binary, text_key bigint, bands array<bigint>, cells binary", 500)


def similar(pairs: DataFrame, texts: DataFrame, bound: float) -> DataFrame:
    """The pairs (a, b) whose cells, in ``texts`` (id, cells), are at least ``bound`` similar: exact on 4-byte hashes."""

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
            if min(len(p), len(q)) < bound * max(len(p), len(q)):
                keep.append(False)
                continue
            both = np.sort(np.concatenate([p, q]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(shared >= bound * (len(both) - shared) - 1e-9)
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("cells").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("cells").alias("y"))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), batch_of, "a bigint, b bigint", 500)


def near_classes(docs: DataFrame, bound: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Every row with its class, and the class of every distinct text.

    Rows: doc_id, text_key, class_id (the class's smallest doc_id), class_rows, n_links (verified links of its text).
    """
    spark = docs.sparkSession
    rows = written(sketched(docs), "sketches")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    texts = written(first.select(F.monotonically_increasing_id().alias("id"), "digest", "least", "n", "bands"), "texts")
    keyed = texts.filter("bands IS NOT NULL").select(F.explode("bands").alias("key"), F.col("id").alias("node"))
    pairs, crowds = bucket_pairs_and_crowds(keyed, int(spark.conf.get("spark.sql.shuffle.partitions")), spread=16)
    pairs = written(pairs, "candidates")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(texts.select("id", "digest"), "id")
    cells_of = rows.select("digest", "cells").join(F.broadcast(involved) if involved.count() <= 200_000 else involved, "digest")
    cells_of = written(cells_of.dropDuplicates(["id"]).select("id", "cells"), "cells")
    links = written(similar(pairs, cells_of, bound), "links")
    joined = written(components(links), "components")
    # What is still apart in a shared bucket meets in full: afterwards no pair that shares a band is untested, unless its
    # texts are in one class already. All rows of crowded buckets are in the first pairs, so their cells are at hand.
    held = cells_of.join(texts.select("id", "bands"), "id").select(F.col("id").alias("node"), F.struct("bands", "cells").alias("data"))

    def alike(key: int, data: pa.StructArray):
        bands = data.field("bands").flatten().to_numpy().reshape(-1, BANDS)
        each = [np.frombuffer(x.as_buffer(), np.uint32) for x in data.field("cells")]
        size = np.array([len(x) for x in each])
        starts = np.cumsum(size) - size
        distinct, place = np.unique(np.concatenate(each), return_inverse=True)
        mark = np.zeros(len(distinct), bool)

        def partners(i: int, other: np.ndarray) -> np.ndarray:
            # A pair that shares several bands is tested in the first of them only; sizes too far apart cannot be similar.
            ask = bands[i][(bands[other] == bands[i]).argmax(1)] == key
            ask &= np.minimum(size[other], size[i]) >= bound * np.maximum(size[other], size[i])
            some = other[ask]
            if len(some):
                own = place[starts[i] : starts[i] + size[i]]
                mark[own] = True
                shared = np.add.reduceat(mark[place[segments(starts[some], size[some])]].astype(np.int64), np.cumsum(size[some]) - size[some])
                mark[own] = False
                ask[ask] = shared >= bound * (size[some] + size[i] - shared) - 1e-9
            return ask

        return partners

    more = written(pairs_apart(crowds, joined, held, alike, one_each=True), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        joined = written(components(links), "components")

    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    placed = texts.select("id", "digest", "least", "n").join(joined.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    classes = placed.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_rows"))
    named = placed.join(classes, "component").select("digest", "class_id", "class_rows", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    out = rows.select("doc_id", "digest", "text_key").join(named, "digest").select("doc_id", "text_key", "class_id", "class_rows", "n_links")
    return out, named


def one_of_each(docs: DataFrame, bound: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their class; of rows equal in id and text, one."""
    rows, _ = near_classes(docs, bound)
    decided = rows.groupBy("doc_id", "text_key").agg(F.first("class_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    dropped = written(decided.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "text_key"), "dropped")
    keyed = docs.withColumn("__text_key", F.xxhash64("text")).alias("d")
    kept = join_checked(keyed, dropped.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.__text_key") == F.col("x.text_key")), "left_anti")
    # A class may be led by several rows: repeated ones, or texts of equal words under one doc_id.
    again = decided.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.sum("copies").alias("n")).filter("n > 1")
    if not again.isEmpty():
        leaders = decided.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id").agg(F.min("text_key").alias("key")).alias("l")
        kept = kept.join(leaders, F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.__text_key") == F.col("l.key"))).select("d.*").dropDuplicates(["doc_id", "__text_key"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    rows, _ = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "class_id", F.col("class_rows").cast("bigint").alias("class_rows"), "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
