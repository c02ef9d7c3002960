"""Candidate pairs from buckets, and connected components: nothing is collected, neither to the driver nor into one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlex.llm.common import arrow_rows, map_arrow, written

#: Rows up to which the small side of a join is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 400_000
#: Rows of a bucket that all meet at once; larger buckets are cut into groups of as many, and each two groups meet.
GROUP_ROWS = 500


def join_checked(large: DataFrame, small: DataFrame, on, how: str = "left", most: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """Join with ``small``, a written table of narrow rows, broadcasting it only if it was counted to be small.

    ``items``: an array column of ``small``, whose entries count as rows each.
    """
    rows = small.agg(F.sum(F.size(items) + 1)).first()[0] or 0 if items else small.count()
    return large.join(F.broadcast(small) if rows <= most else small, on, how)


def bucket_pairs(rows: DataFrame, partitions: int, reach: int = 1, spread: int = 1) -> DataFrame:
    """(key bigint, node bigint) -> distinct pairs (a, b), a < b, of nodes of one bucket. See ``bucket_pairs_and_crowds``."""
    return bucket_pairs_and_crowds(rows, partitions, reach, spread)[0]


def bucket_pairs_and_crowds(rows: DataFrame, partitions: int, reach: int = 1, spread: int = 1) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``bucket_pairs``, and the rows (key, node) among which are all buckets of three rows or more.

    The rows are range-partitioned and sorted by key and a turn within the bucket; so a bucket that is too large for one
    task lies in several, and is read as a stream in any case. Each row is paired with the ``reach`` rows before it in its
    bucket and with the first row that its task sees of the bucket: at most reach + 1 pairs a row, whatever the bucket's
    size. In one of ``spread`` buckets the turn is a hash of key and node, in the others it is the node: so nodes that share
    many buckets are paired in several ways, but not anew in each bucket.
    Where a bucket goes on in the next task, the tasks' first rows are paired in a second, small step. So the pairs connect
    each bucket, and are all there are in a bucket of two; ``pairs_apart`` finds what they leave in the others.
    """
    turn = F.when(F.pmod(F.col("key"), F.lit(spread)) == 0, F.xxhash64("key", "node")).otherwise(F.col("node"))
    ordered = rows.select("key", "node").repartitionByRange(partitions, "key", turn).sortWithinPartitions("key", turn)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_heads = None  # of the bucket that the last batch ended in: its first node, and the last ones
        start = None

        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, carried = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
            if last_key is not None and key[0] == last_key:
                key, node = np.concatenate([np.full(len(last_heads), last_key), key]), np.concatenate([last_heads, node])
                carried = len(last_heads)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            if start is None:
                start = (key[0], node[0])
            sizes = np.diff([*new, len(key)])
            first = node[np.repeat(new, sizes)]
            crowd = sizes > 2
            crowd[[0, -1]] = True  # these may go on in another batch or task
            crowd = np.flatnonzero(np.repeat(crowd, sizes)[carried:]) + carried
            if len(crowd):
                yield pa.RecordBatch.from_pydict({"a": node[crowd], "b": np.zeros(len(crowd), np.int64), "key": key[crowd], "kind": np.full(len(crowd), 2)})
            pairs = [(node[step:], node[:-step], key[step:] == key[:-step]) for step in range(1, reach + 1)] + [(node, first, node != first)]
            a, b = (np.concatenate([x[i][x[2]] for x in pairs]) for i in (0, 1))
            if len(a):
                a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b, "key": np.zeros(len(a), np.int64), "kind": np.zeros(len(a), np.int64)})
            run = node[new[-1] :]
            last_key, last_heads = key[-1], np.concatenate([run[:1], run[1:][-reach:]])
        if start is not None:
            # The first rows of the first and the last bucket of this task, for buckets that lie in several tasks.
            ends = {start, (last_key, last_heads[0])}
            keys, nodes = np.array([k for k, _ in ends]), np.array([n for _, n in ends])
            yield pa.RecordBatch.from_pydict({"a": nodes, "b": nodes, "key": keys, "kind": np.ones(len(keys), np.int64)})

    with arrow_rows(rows.sparkSession, 100_000):  # narrow rows
        found = written(ordered.mapInArrow(paired, "a bigint, b bigint, key bigint, kind bigint"), "pairs")
    inside = found.filter("kind = 0").select("a", "b")
    ends = found.filter("kind = 1").select("key", "a")
    heads = ends.groupBy("key").agg(F.min("a").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    across = ends.join(heads, "key").filter("a <> head").select(F.least("a", "head").alias("a"), F.greatest("a", "head").alias("b"))
    return inside.unionByName(across).distinct(), found.filter("kind = 2").select("key", F.col("a").alias("node"))


def pairs_apart(
    crowds: DataFrame, joined: DataFrame, data: DataFrame, test: Callable[[int, pa.StructArray], Callable[[int, np.ndarray], np.ndarray]], one_each: bool = False, confirm: tuple[str, Callable[[list, list], np.ndarray]] | None = None
) -> DataFrame:
    """Pairs (a, b), a < b, that share a bucket, lie in different components and pass ``test``: all that there are.

    ``crowds``: rows (key, node); ``joined``: (node, component) of the nodes that have one; ``data``: (node, data struct).
    ``test(key, data)`` takes what the rows of a bucket hold, and returns a function from a row's place and those of
    others to a mask of the others that it is to be paired with. ``confirm``, a field of the data and a function from its
    values in many pairs to a mask of them, tests what is left for many buckets at a time. No pair is left out for the
    bucket's size: a bucket of n rows is cut into groups of ``GROUP_ROWS``, and each two groups meet in a row of their
    own. With ``one_each``, of a row's partners in one component only one is returned; that is enough where the tests are
    all that a link needs.
    """
    members = written(joined.select("node", "component"), "members")
    placed = written(join_checked(crowds, members, "node").select("key", "node", F.coalesce("component", "node").alias("c")), "crowds")
    groups = F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("groups")
    opened = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n"), groups)
    opened = written(opened.filter("low <> high AND n > 2").select("key", "groups"), "open")
    rows = join_checked(placed, opened, "key", "inner").withColumn("part", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda x: F.struct(F.least(x, "part").alias("lo"), F.greatest(x, "part").alias("hi")))
    rows = rows.join(data, "node").withColumn("meet", F.explode(meets))
    met = rows.groupBy("key", "meet").agg(F.collect_list(F.struct("node", "c", "part", "data")).alias("rows")).filter(F.size("rows") > 1)

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, values = [np.zeros((5, 0), np.int64)], ([], [])
        for at, (key, one, held) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
            held = held.values
            node, c, part = (held.field(x).to_numpy() for x in ("node", "c", "part"))
            partners = test(key, held.field("data"))
            pairs = [np.zeros((2, 0), np.int64)]
            for i in range(len(node)):
                # Each pair once: from the smaller node, or from the first of two different groups.
                mask = (c != c[i]) & ((node > node[i]) if one else (part > part[i]))
                other = np.flatnonzero(mask)
                if len(other):
                    other = other[partners(i, other)]
                    pairs.append(np.stack([np.full(len(other), i), other]))
            p, q = np.concatenate(pairs, 1)
            found.append(np.stack([node[p], node[q], c[q], p, np.full(len(p), at)]))
            if confirm:
                of = held.field("data").field(confirm[0]).to_pylist()
                for side, places in zip(values, (p, q), strict=True):
                    side += [of[i] for i in places]
        found = np.concatenate(found, 1)
        if confirm and found.shape[1]:
            found = found[:, confirm[1](*values)]
        if one_each and found.shape[1]:
            found = found[:, np.unique(found[[4, 3, 2]], axis=1, return_index=True)[1]]
        return pa.RecordBatch.from_pydict({"a": np.minimum(found[0], found[1]), "b": np.maximum(found[0], found[1])})

    return map_arrow(met.select("key", F.expr("meet.lo = meet.hi").alias("one"), "rows"), batch_of, "a bigint, b bigint", 50).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node of its connected component, for every node that has an edge.

    Alternating large-star and small-star steps: each node's neighbours are linked to the smallest of them, until every
    node has one edge, to a node that has none itself: the smallest of its component. Only minima per node are
    aggregated, and each round is written to the shared folder.
    """
    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        children = current.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("a").alias("nodes")).first()
        if children["edges"] == children["nodes"] and current.join(current.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        current = written(small.filter("a <> b").distinct(), "edges")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
