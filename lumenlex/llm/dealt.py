"""Rows that meet by a key, dealt out as packed arrays instead of one row each.

Each task sorts what it holds with numpy and sends each part one row, whose binary columns hold many lines, or many bands.
Spark moves few rows; what meets in a part is grouped with numpy again. A key that many rows hold does not meet in one
task: each task sends one row of it on and keeps the rest among its own, so a part gets a key at most once from each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenlex.llm.common import BATCH, setting
from lumenlex.llm.hashing import mixed

#: Where a line stands, in the order in which the first one of a group is chosen.
PLACE = np.dtype([("unknown", "u1"), ("doc_id", "<i8"), ("text_key", "<i8"), ("line", "<i4")])
#: Lines that a task gathers before it deals them out.
HELD = 100_000
#: Packed rows of a batch.
PACKED = 500
#: Ids: the part, and the line's number within it.
WITHIN = 33
#: In one of so many buckets the neighbours are other ones than in the rest.
SPREAD = 16

#: What a packed row holds: keys that are once in their part, all rows of those that are there several times, the first row of
#: each of these; the places of distinct lines, and those of lines that repeat one from another place.
ONCE, OWN, HEADS, LINES, REPEATS = range(5)


def grouped(digests: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines that are the first of their digest, by digest, and those that repeat one from another place."""
    order = np.lexsort((places["line"], places["text_key"], places["doc_id"], places["unknown"], digests[:, 1], digests[:, 0]))
    digests, places = digests[order], places[order]
    new = np.concatenate([[True], (digests[1:] != digests[:-1]).any(1)])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = np.ones(len(order), bool)
    for name in PLACE.names:
        same &= places[name] == places[name][first]
    return order[new], order[~same]


def stretches(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The values of a sorted array, and where each stands."""
    at = np.flatnonzero(np.diff(parts, prepend=-1))
    for low, high in zip(at, np.append(at, len(parts))[1:], strict=True):
        yield int(parts[low]), slice(low, high)


def deal_lines(rows: DataFrame, lines_of: Callable[[pa.RecordBatch], Iterator[tuple]], parts: int, batch_rows: int) -> DataFrame:
    """Lines with equal digests in one part. ``lines_of`` makes of a batch: digests (n, 2), places, which are short, the bands
    that each line has, and those that the short ones have besides. Lines that repeat one of the same task go on apart."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        digests, places, short, pairs, grams = (np.concatenate(x) for x in zip(*held, strict=True))
        first, again = grouped(digests, places)
        part = (digests[first, 0] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first, part, gram = first[order], part[order], np.cumsum(short) - 1
        out = []
        for to, at in stretches(part):
            chosen = first[at]
            arrays = digests[chosen], places[chosen], short[chosen], pairs[chosen], grams[gram[chosen[short[chosen]]]]
            out.append((to, *(x.tobytes() for x in arrays)))
        if len(again):
            out.append((int(part[0]), b"", places[again].tobytes(), b"", b"", b""))
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "digests", "places", "short", "pairs", "grams"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                for found in lines_of(batch.slice(at, batch_rows)):
                    held.append(found)
                    size += len(found[0])
                    if size >= HELD:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)
        pa.default_memory_pool().release_unused()

    with setting(rows.sparkSession, BATCH, str(batch_rows)):
        sent = rows.mapInArrow(each, "part int, digests binary, places binary, short binary, pairs binary, grams binary")
    return sent.repartitionById(parts, "part")


def distinct_lines(dealt: DataFrame, parts: int, wide: int, more: int) -> DataFrame:
    """Of ``deal_lines``: packed rows (id, part, kind, held) for ``bucket_pairs``. They hold the places of all distinct lines,
    which get ids, their bands, and the places of the lines that go as they repeat one from another place.

    Each line has ``wide`` bands, a short one ``more`` besides.
    """

    def rows_of(base: int, found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        to, kind, held = zip(*found, strict=True)
        columns = [pa.array([base] * len(found), pa.int64()), pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(held, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "part", "kind", "held"])

    def packed(own: int, keys: np.ndarray, ordinals: np.ndarray) -> list[tuple[int, int, bytes]]:
        part = ((keys ^ (keys >> np.uint64(32)) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
        order = np.argsort(part << np.uint64(37) | keys)
        part, keys, ordinals = part[order].astype(np.int64), keys[order], ordinals[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        repeated = ~(new & np.append(new[1:], True))
        among = np.flatnonzero(repeated)[np.argsort(keys[repeated], kind="stable")]
        out = [(own, OWN, pack(keys[among], ordinals[among], wide + more))] if len(among) else []
        for kind, chosen in ((ONCE, ~repeated), (HEADS, repeated & new)):
            k, o = keys[chosen], ordinals[chosen]
            out += [(to, kind, pack(k[at], o[at], wide + more)) for to, at in stretches(part[chosen])]
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        kinds = [np.dtype("<u8"), PLACE, np.dtype(bool), np.dtype("<u4"), np.dtype("<u4")]
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                arrays = tuple(np.frombuffer(batch.column(k + 1)[i].as_buffer(), kind) for k, kind in enumerate(kinds))
                if len(arrays[0]):
                    held.setdefault(part, []).append(arrays)
                elif len(arrays[1]):
                    yield rows_of(0, [(part, REPEATS, arrays[1].tobytes())])
        for part in sorted(held):
            digests, places, short, pairs, grams = (np.concatenate(x) for x in zip(*held.pop(part), strict=True))
            first, again = grouped(digests.reshape(-1, 2), places)
            out = [(part, LINES, places[first].tobytes())]
            if len(again):
                out.append((part, REPEATS, places[again].tobytes()))
            gram, little = np.cumsum(short) - 1, np.flatnonzero(short[first])
            tables = pairs.reshape(-1, wide)[first], grams.reshape(-1, more)[gram[first[little]]]
            steps = np.arange(wide + more, dtype=np.uint64) << np.uint64(32)
            keys = np.concatenate([(tables[0] + steps[:wide]).ravel(), (tables[1] + steps[wide:]).ravel()])
            out += packed(part, keys, np.concatenate([np.repeat(np.arange(len(first)), wide), np.repeat(little, more)]))
            yield rows_of(part << WITHIN, out)
        pa.default_memory_pool().release_unused()

    with setting(dealt.sparkSession, BATCH, str(PACKED)):
        sent = dealt.mapInArrow(each, "id bigint, part int, kind int, held binary")
    return sent.repartitionById(parts, "part")


def pack(keys: np.ndarray, ordinals: np.ndarray, places: int) -> bytes:
    """Sorted keys (the band's place, then its 32 bits) with a number each: how many each place has, bands, numbers."""
    counts = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=places).astype("<u4")
    return counts.tobytes() + keys.astype("<u4").tobytes() + ordinals.astype("<u2" if ordinals.max() < 1 << 16 else "<u4").tobytes()


def unpack(held: pa.Buffer, places: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(held, "<u4", places)
    n = int(counts.sum())
    keys = np.repeat(np.arange(places, dtype=np.int64) << 32, counts) + np.frombuffer(held, "<u4", n, 4 * places)
    at = 4 * (places + n)
    return keys, np.frombuffer(held, "<u2" if held.size - at == 2 * n else "<u4", n, at).astype(np.int64)


FOUND = "a bigint, b bigint, key bigint, doc_id bigint, text_key bigint, line int"


def bucket_pairs(rows: DataFrame, places: int) -> DataFrame:
    """Of ``distinct_lines``: pairs (a, b), a < b, that connect the lines of each bucket, where b is set; where key is set the
    rows (a, key) among which are all buckets of three lines or more; where line is set distinct lines (a, doc_id, text_key,
    line), and without a those that go as they repeat one. The pairs are all there are in a bucket of two.

    In a bucket each line is paired with the one before it and with the first one. A bucket's lines of one part do so among
    themselves; their first line meets those of the other parts. Mostly lines are in the order of their ids, so that those
    which share many buckets are not paired anew in each; in one of ``SPREAD`` buckets the order is another one.
    """

    schema = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.int64()) for x in FOUND.split(", ")])

    def found(key: np.ndarray, node: np.ndarray, begun: np.ndarray | None) -> pa.RecordBatch:
        """Rows of buckets of at least two; ``begun``: this row has others in its part. None: all of one part."""
        turn = np.where(key % SPREAD == 0, (mixed((key * SPREAD).astype(np.uint64) ^ mixed(node.astype(np.uint64))) >> np.uint64(1)).astype(np.int64), node)
        order = np.lexsort((turn, key))
        key, node = key[order], node[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff([*at, len(key)])
        if begun is None:
            crowd = np.ones(len(key), bool)
        else:
            begun = begun[order]
            crowd = np.repeat((sizes > 2) | np.logical_or.reduceat(begun, at), sizes) & ~begun
        first = node[np.repeat(at, sizes)]
        same = key[1:] == key[:-1]
        a, b = np.concatenate([node[1:][same], node[node != first]]), np.concatenate([node[:-1][same], first[node != first]])
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(low)]
        low, high = low[new], high[new]
        n = int(crowd.sum())
        pair = np.arange(len(low) + n) < len(low)
        b, key = np.concatenate([high, np.zeros(n, np.int64)]), np.concatenate([np.zeros(len(low), np.int64), key[crowd]])
        return rows_of(a=pa.array(np.concatenate([low, node[crowd]])), b=pa.array(b, mask=~pair), key=pa.array(key, mask=pair))

    def rows_of(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(x.name, pa.nulls(n, x.type)) for x in schema], schema=schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, begun = [], [], []
        for batch in batches:
            for base, kind, held in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if kind in (LINES, REPEATS):
                    at = np.frombuffer(held.as_buffer(), PLACE)
                    ids = {"a": pa.array(base + np.arange(len(at)))} if kind == LINES else {}
                    yield rows_of(**ids, doc_id=pa.array(at["doc_id"], mask=at["unknown"] > 0), text_key=pa.array(at["text_key"]), line=pa.array(at["line"]))
                    continue
                key, number = unpack(held.as_buffer(), places)
                if kind == OWN:
                    yield found(key, number + base, None)
                    continue
                keys.append(key)
                nodes.append(number + base)
                begun.append(np.full(len(key), kind == HEADS))
        if keys:
            key, node, begun = (np.concatenate(x) for x in (keys, nodes, begun))
            del keys, nodes
            order = np.argsort(key)
            ordered = key[order]
            same = ordered[1:] == ordered[:-1]
            shared = order[np.append(same, False) | np.append(False, same)]
            if len(shared):
                yield found(key[shared], node[shared], begun[shared])
        pa.default_memory_pool().release_unused()

    with setting(rows.sparkSession, BATCH, str(PACKED)):
        return rows.mapInArrow(each, FOUND)
