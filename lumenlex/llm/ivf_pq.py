"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Vectors are compared by cosine, so they are scaled to length 1 for the index. Coarse centroids and the codebooks of the
residuals are fitted in numpy on the driver, on at most ``SAMPLE`` vectors (those whose vec_id has the smallest MD5);
every vector is then indexed: its cell and one byte per subspace. A query looks into the nearest ``PROBE_SHARE``
of the cells, where an asymmetric distance table (its products with all codewords) ranks the codes: the squared distance
to centroid c and coded residual r is |q - c|^2 - 2 q.r + (2 c.r + |r|^2), whose last term is kept with the code. The
best ``SHORTLIST`` are reranked by the exact cosine, in double precision on the original vectors.

Equal vectors are searched once: of each group of equal vectors only the k + 1 smallest ids can ever be among the k
nearest of a query, and queries with equal vectors share one search. The index is cut into shards of about
``SHARD_ROWS`` rows by a hash of vec_id, each with all inverted lists of its rows, so no list has to fit one task; each
shard returns its own shortlist. Queries go to the shards in blocks of about ``QUERY_ROWS``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do
vectors of another length than the most common one; equal scores go to the smaller vec_id; a query never finds its own
row; rows that repeat a vec_id take part once each vector (equal rows once); with fewer candidates than k all that are
found are returned; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlex.llm.common import map_arrow, table, written
from lumenlex.llm.hashing import segments

SAMPLE = 20_000
#: The share of the cells that a query looks into. Vectors without clusters need many; see the README for the recall.
PROBE_SHARE = 0.6
SHORTLIST = 40
SHARD_ROWS = 20_000
QUERY_ROWS = 2_000
MOST_CELLS = 1024
SUBSPACE = 2


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in blocks of bounded size."""
    half = (centres * centres).sum(1) / 2
    out = [(x[at : at + 4096] @ centres.T - half).argmax(1) for at in range(0, len(x), 4096)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty cluster restarts at a random row."""
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, x[:, d], k) for d in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return centres


class Index:
    """Coarse centroids and one codebook per subspace."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = _unit(sample)
        self.dim = x.shape[1]
        self.centres = k_means(x, int(min(MOST_CELLS, max(1, rows**0.5))), 12, rng)
        residual = x - self.centres[_nearest(x, self.centres)]
        self.cuts = [slice(at, min(at + SUBSPACE, self.dim)) for at in range(0, self.dim, SUBSPACE)]
        self.books = [k_means(np.ascontiguousarray(residual[:, cut]), 256, 10, rng) for cut in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and the part of the distance that no query changes."""
        x = _unit(x)
        cell = _nearest(x, self.centres)
        residual = x - self.centres[cell]
        codes = np.stack([_nearest(np.ascontiguousarray(residual[:, cut]), book) for cut, book in zip(self.cuts, self.books, strict=True)], 1)
        coded = np.concatenate([book[codes[:, part]] for part, book in enumerate(self.books)], 1)
        return cell, codes.astype(np.uint8), 2 * (self.centres[cell] * coded).sum(1) + (coded * coded).sum(1)

    def probe(self, query: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells of a unit query, and its squared distance to all centroids."""
        distance = ((self.centres - query) ** 2).sum(1)
        return np.argsort(distance, kind="stable")[:probes], distance

    def products(self, query: np.ndarray) -> np.ndarray:
        """The asymmetric table: the products of a query's parts with the codewords, 256 for each part."""
        out = np.zeros((len(self.books), 256), np.float32)
        for part, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[part, : len(book)] = book @ query[cut]
        return out.reshape(-1)


class Shard:
    """The inverted lists of some rows."""

    def __init__(self, index: Index, ids: np.ndarray, cell: np.ndarray, codes: np.ndarray, bias: np.ndarray):
        order = np.lexsort((ids, cell))
        self.index, self.ids, self.bias = index, ids[order], bias[order]
        self.places = codes[order].astype(np.int32) + np.arange(codes.shape[1], dtype=np.int32) * 256
        self.cell = cell[order]
        self.starts = np.searchsorted(self.cell, np.arange(len(index.centres) + 1))

    def nearest(self, query: np.ndarray, probes: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and coded distances of the best rows in the probed lists; ties go to the smaller id."""
        cells, to_centre = self.index.probe(query, probes)
        rows = segments(self.starts[cells], self.starts[cells + 1] - self.starts[cells])
        distance = to_centre[self.cell[rows]] + self.bias[rows] - 2 * self.index.products(query)[self.places[rows]].sum(1)
        best = np.lexsort((self.ids[rows], np.round(distance, 5)))[:most]
        return self.ids[rows[best]], distance[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("embedding") == (lengths[0]["n"] if lengths else 0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def fit(rows: DataFrame, sample: int = SAMPLE) -> Index | None:
    """Fit an index on a bounded sample of ``rows``."""
    taken = rows.select("embedding", F.md5(F.col("vec_id").cast("string")).alias("k")).orderBy("k").limit(sample).collect()
    return Index(np.array([r["embedding"] for r in taken], np.float64), rows.count()) if taken else None


def search(vectors: DataFrame, is_query: Column, k: int = 5, probe_share: float = PROBE_SHARE, shortlist: int = SHORTLIST, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row that ``is_query`` selects."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    candidates = written(rows.dropDuplicates(["vec_id", "embedding"]).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r"), "ann-rows")
    queries = rows.filter(is_query).select("vec_id", "embedding")
    index = fit(candidates, sample)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    probes = max(1, round(probe_share * len(index.centres)))
    # Equal query vectors share one search, named by their smallest id.
    named = written(queries.groupBy("embedding").agg(F.min("vec_id").alias("q")), "ann-queries")
    shards, blocks = max(1, -(-candidates.count() // SHARD_ROWS)), max(1, -(-named.count() // QUERY_ROWS))

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, codes, bias = index.encode(_matrix(batch.column(1)))
        return pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "cell": pa.array(cell, pa.int32()), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "bias": pa.array(bias, pa.float32())})

    codes = written(map_arrow(candidates, coded, "vec_id bigint, cell int, code binary, bias float", 4000), "ann-codes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = codes.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    asked = named.select("q", F.col("embedding").alias("vector"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))

    def ranked(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "distance": [np.zeros(0, np.float32)]}
        if len(asked) and len(held):
            shard = Shard(index, held["vec_id"].to_numpy(), held["cell"].to_numpy(), np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1), held["bias"].to_numpy())
            for q, vector in zip(asked["q"], _unit(np.stack(asked["vector"].to_numpy())), strict=True):
                ids, distance = shard.nearest(vector, probes, shortlist)
                for name, values in (("q", np.full(len(ids), q)), ("vec_id", ids), ("distance", distance)):
                    out[name].append(values)
        return pd.DataFrame({name: np.concatenate(values) for name, values in out.items()})

    ranks = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(ranked, "q bigint, vec_id bigint, distance float")
    nearest = Window.partitionBy("q").orderBy("distance", "vec_id")
    short = ranks.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= shortlist).select("q", "vec_id")
    scored = short.join(candidates, "vec_id").join(named.withColumnRenamed("embedding", "vector"), "q")
    scored = scored.select("q", "vec_id", cosine(F.col("vector"), F.col("embedding")).alias("score"))
    exact = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("r", F.row_number().over(exact)).filter(F.col("r") <= k + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    asked = queries.dropDuplicates(["vec_id", "embedding"]).join(named, "embedding").select(F.col("vec_id").alias("query_id"), "q").join(lists, "q")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    found = asked.select("query_id", F.posexplode(others).alias("place", "x"))
    return found.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op4_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest embeddings of every row whose vec_id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
