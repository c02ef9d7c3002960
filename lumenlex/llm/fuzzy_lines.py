"""Line dedup: one occurrence of every group of equal or similar lines stays.

Lines are normalised (lower case, white space collapsed, digits as 0). Equal normalised lines are one line from the start,
however often they occur. Distinct lines get MinHash bands of their pairs of neighbouring words, the line's ends included:
lines that share one of ``PAIR_BANDS`` bands of ``PAIR_ROWS`` minima are candidates. Lines of at most ``SHORT`` bytes have
few words, so they get ``GRAM_BANDS`` more, of their 4-grams. Candidates are verified exactly by the edit similarity of
the whole normalised lines: 1 - distance / longer length, at least ``SIMILARITY``. First the sorted neighbours within the
bands' buckets are verified, then all pairs that are still apart in a shared bucket, however crowded it is (see
dealt.bucket_pairs, graph.pairs_apart): no candidate is left out. Verified pairs form groups; the occurrence with the
smallest (doc_id, line number) of each group stays. Why not SimHash blocks: see the README.

Defined results: blank lines are no occurrences and stay; null texts have no lines and stay null; texts are lines
between newlines, and a text that loses all its lines becomes empty, its row stays; a null doc_id comes after all
others; rows equal in doc_id and text count as one and come out alike; rows with one doc_id and different texts are
ordered by a hash of the text; an empty table gives an empty table; other columns are kept by ``deduplicated``,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm import dealt, graph
from lumenlex.llm.common import alone, arrow_rows, map_arrow, table, written
from lumenlex.llm.graph import components, join_checked, pairs_apart
from lumenlex.llm.hashing import mixed as _mixed64
from lumenlex.llm.hashing import powers

SIMILARITY = 0.8
#: Bands and minima of a band. Of lines with a fifth of their words replaced 0.47 of the word pairs are common: one of 12
#: bands of 3 agrees with probability 0.73; with an eighth replaced it is 0.97. Lines without common text share 0.0003.
PAIR_BANDS, PAIR_ROWS = 12, 3
#: Minima of word pairs; each is in two bands, and no two are together in two.
PAIR_MINIMA = 18
SHORT = 64
GRAM, GRAM_BANDS, GRAM_ROWS = 4, 8, 6
BANDS = PAIR_BANDS + GRAM_BANDS
#: Characters of lines that are worked on at a time; one longer line makes a longer array.
CHUNK = 400_000
#: Pairs of lines with at most so many characters are compared side by side, about so many characters at a time; longer
#: ones each alone, and so are fewer than ``FEW`` pairs of like length.
SIDE_BY_SIDE, ABREAST, FEW = 4000, 600_000, 24
#: Pairs side by side take as many steps as the longest of them; no other is shorter than it by a larger factor.
UNEVEN = 1.3
#: Pairs, and characters of them, that a task gathers before it compares them.
GATHERED, GATHERED_CHARACTERS = 8000, 4_000_000
#: Counters of a line's characters.
BAG = 64
#: Shares of the steps after which pairs that cost too much already end.
LOOKS = (0.35, 0.6)
#: Bits for each text that loses lines, those of a block of the bitmap (Spark's own), and blocks at most (16 MB).
MARK_BITS, BLOCK_BITS, MARK_BLOCKS = 16, 32768, 4096
#: Entries of the table that says where the characters of the texts of a batch stand, at most.
TABLE = 4_000_000

_zeros = bytes(0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_turns = np.random.default_rng(20).integers(0, 1 << 32, (2, PAIR_MINIMA + GRAM_BANDS * GRAM_ROWS), np.uint32) | np.uint32(1)


#: What becomes of the bytes of an ASCII line: the same, without its runs of white space.
_plain = bytes(0x20 if chr(b).isspace() else ord(chr(b).lower()) for b in range(128)) + bytes(range(128, 256))
_plain = _plain.translate(_zeros)


def normalised(line: str) -> bytes:
    if line.isascii():
        held = line.encode().translate(_plain).strip(b" ")
        return b" ".join(held.split()) if b"  " in held else held
    return " ".join(line.lower().split()).encode("utf-8", "replace").translate(_zeros)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(15))


#: The minima of every band.
PAIR_SETS = [(i, i + 6, i + 12) for i in range(6)] + [(i, (i + 1) % 6 + 6, (i + 2) % 6 + 12) for i in range(6)]
GRAM_SETS = [tuple(range(PAIR_MINIMA + i * GRAM_ROWS, PAIR_MINIMA + (i + 1) * GRAM_ROWS)) for i in range(GRAM_BANDS)]


def _bands(values: np.ndarray, first: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """(lines, bands) hashes of the minima of each line's values, which start at ``first``."""
    minima = {}
    for k in sorted({k for band in sets for k in band}):
        h = values * _turns[0, k] + _turns[1, k]
        minima[k] = np.minimum.reduceat((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D), first)
    out = np.zeros((len(sets), len(first)), np.uint32)
    for row in zip(*sets, strict=True):
        out = _mixed(out * np.uint32(0x01000193) + np.stack([minima[k] for k in row]))
    return np.ascontiguousarray(out.T).view(np.int32)


def bands_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bands of all lines (not empty, without white space around) one after the other, and where each line's end.

    Every line has PAIR_BANDS of word pairs, short ones GRAM_BANDS more.
    """
    sizes = np.array([len(line) for line in lines])
    code = np.frombuffer(b" " + b" ".join(lines) + b" ", np.uint8)
    begin = np.cumsum(sizes + 1) - sizes
    gaps = np.flatnonzero(code == 0x20)
    starts, ends = gaps[:-1] + 1, gaps[1:]
    # A word's hash follows from the sums of its bytes times powers.
    forward, back = powers(len(code))
    summed = np.cumsum((code + np.uint64(1)) * forward, dtype=np.uint64)
    word = (_mixed64((summed[ends - 1] - summed[starts - 1]) * back[starts]) >> np.uint64(32)).astype(np.uint32)
    # Each word follows another one, or the line's start; the line's end follows its last word.
    first = np.searchsorted(starts, begin)
    after = np.append(first[1:], len(word))
    before = np.concatenate([[np.uint32(0)], word[:-1]])
    before[first] = 0x51ED27
    pairs = np.insert(_mixed(before) * np.uint32(0x01000193) + word, after, _mixed(word[after - 1]) + np.uint32(1))
    out = _bands(_mixed(pairs), first + np.arange(len(lines)), PAIR_SETS)
    short = np.flatnonzero(sizes <= SHORT)
    counts = np.full(len(lines), PAIR_BANDS)
    counts[short] = BANDS
    flat = np.zeros(counts.sum(), np.int32)
    offsets = np.cumsum(counts) - counts
    flat[offsets[:, None] + np.arange(PAIR_BANDS)] = out
    if len(short):
        pad = b"\0" * (GRAM - 1)
        code = np.frombuffer(b"".join(lines[i].replace(b"\0", b"\1") + pad for i in short) + pad, np.uint8).astype(np.uint32)
        inside = code[: -len(pad)] != 0
        gram = np.zeros(len(inside), np.uint32)
        for k in range(GRAM):
            gram = gram * np.uint32(0x01000193) + code[k : len(inside) + k]
        more = _bands(_mixed(gram[inside]), np.cumsum(sizes[short]) - sizes[short], GRAM_SETS)
        flat[offsets[short][:, None] + np.arange(PAIR_BANDS, BANDS)] = more
    return flat, offsets + counts


def distance(a: str, b: str, most: int) -> int:
    """Edit distance by bit-parallel columns, or most + 1 if it is larger. Equal ends are cut off first."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # the common prefix, by halving
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[-middle:] == b[-middle:] else (low, middle - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    every = (1 << len(b)) - 1
    top = 1 << len(b) - 1
    plus, minus, score = every, 0, len(b)
    for i, c in enumerate(a):
        equal = where.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & every
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        if score - (len(a) - i - 1) > most:
            return most + 1
        up = (up << 1 | 1) & every
        down = down << 1 & every
        plus = down | ~(vertical | up) & every
        minus = up & vertical
    return score


def distances(left: list[str], right: list[str], most: np.ndarray | None = None) -> np.ndarray:
    """The edit distances of many pairs of texts, exactly, in one pass over all of them side by side.

    A column of the table of distances is kept as its vertical differences, a bit each, in words of 64 rows; the
    horizontal differences at a word's end go on to the next word. The words are worked on in a slant, each one step behind
    the word above it, so that all words of all pairs take part in each operation. A distance is the number of steps plus
    the vertical differences of the last column. So that all pairs take as many steps, both texts of a pair get the same
    filling at their ends, which changes no distance.

    With ``most``, one for each pair, distances up to it are exact and larger ones are some number above it. A way of that
    cost leaves the diagonal by ``most`` at most, so a word takes part only while its rows are as near to it. Before, its
    vertical differences are 1 each; once it has left, each step along its last row costs 1. Both are ways that there
    are, so no distance comes out too small, and the formula for it stays. At some columns, pairs end for which every row
    already costs more, together with what the lengths that are left differ by.
    """
    n, steps = len(left), max(1, *map(len, left))
    sides = [np.array([len(x) for x in side]) for side in (right, left)]
    sizes = sides[0] + steps - sides[1]
    words = int(sizes.max()) // 64 + 1
    texts = [np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) for side in (right, left)]
    seen = np.zeros(max(int(x.max()) if len(x) else 0 for x in texts) + 3, bool)
    for codes in texts:
        seen[codes] = True
    seen[-2:] = True  # the filling, and what stands behind it
    known = np.flatnonzero(seen)
    if n > 1 and words * n * len(known) > TABLE:
        half = n // 2
        parts = [(left[:half], right[:half], None if most is None else most[:half]), (left[half:], right[half:], None if most is None else most[half:])]
        return np.concatenate([distances(*part) for part in parts])
    number = np.zeros(len(seen), np.uint8 if len(known) < 256 else np.uint32)
    number[known] = np.arange(len(known))
    rows = np.full((n, words * 64), len(known) - 1, number.dtype)
    columns = np.full((n, steps), len(known) - 2, number.dtype)
    rows[np.arange(words * 64) < sizes[:, None]] = len(known) - 2
    for table, size, codes in zip((rows, columns), sides, texts, strict=True):
        table[np.arange(table.shape[1]) < size[:, None]] = number[codes]
    columns = np.ascontiguousarray(columns.T)
    packed = lambda bits: np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T
    where = np.empty((words, len(known), n), np.uint64)
    for c in range(len(known)):
        where[:, c] = packed(rows == c)
    one, last = np.uint64(1), np.uint64(63)
    plus, minus = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    # The differences along the row above each word; above the first one each step costs 1.
    more, less = np.ones((words + 1, n), np.uint64), np.zeros((words + 1, n), np.uint64)
    if most is None:
        out, band, ends = None, steps + words * 64, [steps]
    else:
        out, band, ends = np.asarray(most) + 1, int(np.max(most)), [*(int(x * steps) for x in LOOKS if steps >= 128), steps]
    live, begin = np.arange(n), 0
    for end in ends:
        across = columns[begin:end].astype(np.int64) * len(live)
        flat, place = where.reshape(-1), np.arange(words)[:, None] * (len(known) * len(live)) + np.arange(len(live))
        low = high = 0
        for slant in range(end - begin + words - 1):
            above = range(low, high)
            low = max(0, slant - (end - begin) + 1, -((band + 63 - begin - slant) // 65))
            high = min(words, slant + 1, (begin + slant + 1 + band) // 65 + 1)
            if low >= high:
                continue
            if low and low - 1 not in above:
                more[low], less[low] = 1, 0  # the word above has left
            equal = flat.take(across[slant - high + 1 : slant - low + 1][::-1] + place[low:high])
            p, m, h = plus[low:high], minus[low:high], less[low:high]
            vertical = equal | m
            equal |= h
            horizontal = equal & p
            horizontal += p
            horizontal ^= p
            horizontal |= equal
            up = ~(horizontal | p)
            up |= m
            down = p & horizontal
            next_more, next_less = up >> last, down >> last
            up <<= one
            up |= more[low:high]
            down <<= one
            down |= h
            plus[low:high], minus[low:high] = down | ~(vertical | up), up & vertical
            more[low + 1 : high + 1], less[low + 1 : high + 1] = next_more, next_less
        begin = end
        if end == steps:
            break
        bits = lambda x: np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little").view(np.int8)
        cost = np.cumsum(bits(plus) - bits(minus), axis=1, dtype=np.int32)
        row = np.arange(1, words * 64 + 1, dtype=np.int32)
        left_over = np.abs((sizes[live, None] - (steps - end)).astype(np.int32) - row)
        cost += left_over
        cost[row > sizes[live, None]] = band + 1
        cheapest = end + np.minimum(cost.min(1), np.abs(sizes[live] - (steps - end)))
        kept = cheapest < out[live]
        if kept.mean() < 0.85:
            live = live[kept]
            if not len(live):
                return out
            columns, where = np.ascontiguousarray(columns[:, kept]), np.ascontiguousarray(where[:, :, kept])
            plus, minus, more, less = (np.ascontiguousarray(x[:, kept]) for x in (plus, minus, more, less))
    inside = packed(np.arange(words * 64) < sizes[live, None])
    found = steps + (np.bitwise_count(plus & inside).sum(0, dtype=np.int64) - np.bitwise_count(minus & inside).sum(0, dtype=np.int64))
    if out is None:
        return found
    out[live] = found
    return out


def allowed(longest, bound: float = SIMILARITY):
    """The largest distance at which lines, the longer of ``longest`` characters, are similar."""
    return np.floor((1 - bound) * longest + 1e-9)


#: Words that are skipped at most, on both sides together, to find where two lines go on alike.
SKIPPED = 8


def surely_similar(a: str, b: str, most: int) -> bool:
    """Is one way from a to b cheap enough? Where words differ, those up to the next equal ones are replaced."""
    p, q, i, j, cost = a.split(" "), b.split(" "), 0, 0, 0
    if len({*p}.intersection(q)) < 0.6 * min(len({*p}), len({*q})):
        return False  # it would hardly be
    while i < len(p) and j < len(q):
        if p[i] == q[j]:
            i += 1
            j += 1
            continue
        for skipped in range(1, SKIPPED + 1):
            step = next((x for x in range(skipped + 1) if i + x < len(p) and j + skipped - x < len(q) and p[i + x] == q[j + skipped - x]), None)
            if step is not None:
                break
        else:
            step, skipped = 1, 2
        cost += max(sum(map(len, p[i : i + step])) + step, sum(map(len, q[j : j + skipped - step])) + skipped - step)
        if cost > most:
            return False
        i, j = i + step, j + skipped - step
    return cost + sum(map(len, p[i:])) + len(p) - i + sum(map(len, q[j:])) + len(q) - j <= most


def surely_apart(left: list[str], right: list[str], bound: float = SIMILARITY) -> np.ndarray:
    """Does either of two lines hold more characters that the other one lacks than their distance may be?

    Each edit removes one character, adds one, or both. Characters are counted by their last bits, which only lets more
    pairs pass.
    """
    places: dict[str, int] = {}
    a, b = (np.array([places.setdefault(x, len(places)) for x in side], np.int64) for side in (left, right))
    bags = np.zeros((len(places), BAG), np.int32)
    for x, i in places.items():
        bags[i] = np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % BAG, minlength=BAG)
    sizes = bags.sum(1)
    lacking = np.concatenate([np.maximum(bags[a[at : at + GATHERED]] - bags[b[at : at + GATHERED]], 0).sum(1) for at in range(0, len(a), GATHERED)] or [a])
    # What b holds beyond a follows from the lengths.
    return np.maximum(lacking, lacking + sizes[b] - sizes[a]) > allowed(np.maximum(sizes[a], sizes[b]), bound)


def similar_pairs(left: list[str], right: list[str], bound: float = SIMILARITY, likely: bool = True) -> np.ndarray:
    """Which pairs are similar, 1 - distance / longer length being at least ``bound``? Decided exactly.

    Where most are ``likely`` similar, a cheap way from one to the other is tried first.
    """
    out, open_pairs = np.zeros(len(left), bool), []
    for i in np.flatnonzero(~surely_apart(left, right, bound)):
        a, b = left[i], right[i]
        most = int(allowed(max(len(a), len(b)), bound))
        if likely and surely_similar(a, b, most):
            out[i] = True
        elif max(len(a), len(b)) > SIDE_BY_SIDE:
            out[i] = distance(a, b, most) <= most
        else:
            open_pairs.append((max(len(a), len(b)), i))
    open_pairs.sort()
    at = 0
    while at < len(open_pairs):
        end, size, longest = at, 0, open_pairs[at][0] * UNEVEN + 16
        while end < len(open_pairs) and (end == at or size <= ABREAST and open_pairs[end][0] <= longest):
            size += open_pairs[end][0]
            end += 1
        chosen = [i for _, i in open_pairs[at:end]]
        a, b = [left[i] for i in chosen], [right[i] for i in chosen]
        most = allowed(np.maximum([len(x) for x in a], [len(x) for x in b]), bound)
        # A few pairs are faster each alone.
        out[chosen] = distances(a, b, most.astype(np.int64)) <= most if len(a) >= FEW else [distance(x, y, int(n)) <= n for x, y, n in zip(a, b, most, strict=True)]
        at = end
    return out


def occurrences(docs: DataFrame, parts: int) -> DataFrame:
    """All lines that are not blank, dealt by the digests (16 bytes) of the normalised lines, with their bands. See ``dealt``."""

    def lines_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        doc_id, text_key = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
        unknown, doc_id = doc_id.is_null().to_numpy(zero_copy_only=False), doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        rows, numbers, held, size = [], [], [], 0

        def chunk() -> tuple:
            places = np.empty(len(rows), dealt.PLACE)
            for name, values in (("unknown", unknown[rows]), ("doc_id", doc_id[rows]), ("text_key", text_key[rows]), ("line", numbers)):
                places[name] = values
            digests = np.frombuffer(b"".join([hashlib.blake2b(line, digest_size=16).digest() for line in held]), "<u8").reshape(-1, 2)
            flat, ends = bands_of(held)
            counts = np.diff(ends, prepend=0)
            short, flat = counts > PAIR_BANDS, flat.view(np.uint32)
            at = (ends - counts)[:, None]
            return digests, places, short, flat[at + np.arange(PAIR_BANDS)], flat[at[short] + np.arange(PAIR_BANDS, BANDS)]

        for row, value in enumerate(batch.column(1)):
            text = value.as_py()
            for number, line in enumerate(text.split("\n") if text else ()):
                if line := normalised(line):
                    rows.append(row)
                    numbers.append(number)
                    held.append(line)
                    size += len(line)
                    if size >= CHUNK:
                        yield chunk()
                        rows, numbers, held, size = [], [], [], 0
        if rows:
            yield chunk()

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"], F.xxhash64(docs["text"]).alias("text_key"))
    return dealt.deal_lines(rows, lines_of, parts, 250)


def _lines_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The normalised lines at (id, doc_id, text_key, line): the same with text and bands (4 bytes each)."""
    per_text = written(wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line", "id")).alias("wanted")), "wanted")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_key") == F.col("w.text_key"))
    found = join_checked(keyed, per_text.alias("w"), same, "inner", items="wanted")

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, ids, numbers, lines = [], [], [], []
        for row, (text, wanted) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
            held = text.as_py().split("\n")
            for x in wanted.as_py():
                rows.append(row)
                ids.append(x["id"])
                numbers.append(x["line"])
                lines.append(normalised(held[x["line"]]))
        if not rows:
            return None
        flat, ends = bands_of(lines)
        bands = [x.tobytes() for x in np.split(flat, ends[:-1])]
        at = pa.array(rows, pa.int64())
        columns = {"id": pa.array(ids, pa.int64()), "doc_id": batch.column(2).take(at), "text_key": batch.column(3).take(at), "line": pa.array(numbers, pa.int32())}
        return pa.RecordBatch.from_pydict(columns | {"text": pa.array([x.decode() for x in lines], pa.string()), "bands": pa.array(bands, pa.binary())})

    return map_arrow(found.select("d.text", "wanted", "d.doc_id", "d.text_key"), batch_of, "id bigint, doc_id bigint, text_key bigint, line int, text string, bands binary", 250)


def similar_lines(docs: DataFrame, met: DataFrame, bound: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of lines that connect what verified pairs connect, and the lines (id, doc_id, text_key, line) that may
    be in one. ``met``: see ``dealt.bucket_pairs``.

    Verified are as many pairs as connect all similar lines that share a band.
    """
    pairs = written(met.filter("b IS NOT NULL").select("a", "b").distinct(), "candidates")
    crowds = met.filter("key IS NOT NULL").select("key", F.col("a").alias("node"))
    lines = met.filter("line IS NOT NULL AND a IS NOT NULL").select(F.col("a").alias("id"), "doc_id", "text_key", "line")
    # All rows of crowded buckets are in the first pairs.
    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = _lines_at(docs, lines.join(involved, "id").select("id", "doc_id", "text_key", "line"))
    # Rows equal in doc_id and text repeat their lines.
    texts = written(texts.groupBy("id").agg(*[F.first(x).alias(x) for x in ("doc_id", "text_key", "line", "text", "bands")]), "line-texts")
    links = verified(pairs, texts, bound)

    def test(key: int, data: pa.StructArray):
        size = np.array([len(text) for text in data.field("text").to_pylist()])
        bands = np.repeat(-1 - np.arange(len(size), dtype=np.int64)[:, None] << 32, BANDS, 1)  # absent ones equal no other
        for i, row in enumerate(data.field("bands").to_pylist()):
            bands[i, : len(row) // 4] = np.frombuffer(row, np.int32)
        place = key >> 32

        def partners(i: int, other: np.ndarray) -> np.ndarray:
            # A pair that shares several bands is tested in the first of them only.
            ask = np.abs(size[other] - size[i]) <= allowed(np.maximum(size[other], size[i]), bound)
            ask[ask] = ~(bands[other[ask], :place] == bands[i, :place]).any(1)
            return ask

        return partners

    data = texts.select(F.col("id").alias("node"), F.struct("bands", "text").alias("data"))
    joined = written(components(links), "joined")
    rest = written(pairs_apart(crowds, joined, data, test, one_each=True, confirm=("text", lambda a, b: similar_pairs(a, b, bound, likely=False))), "links")
    links = joined.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(rest)
    return links, texts.select("id", "doc_id", "text_key", "line")


def verified(close: DataFrame, texts: DataFrame, bound: float) -> DataFrame:
    """The pairs (a, b) of ``close`` whose lines, in ``texts`` (id, text), are similar by their edit distance; a written table."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    both = close.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    both = both.filter(F.abs(F.length("x") - F.length("y")) <= F.floor(F.greatest(F.length("x"), F.length("y")) * (1 - bound) + 1e-9))

    def similar(held: list[tuple]) -> pa.RecordBatch:
        a, b, x, y = zip(*held, strict=True)
        keep = similar_pairs(x, y, bound)
        return pa.RecordBatch.from_pydict({"a": np.array(a, np.int64)[keep], "b": np.array(b, np.int64)[keep]})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[2]) + len(row[3])
                if len(held) >= GATHERED or size >= GATHERED_CHARACTERS:
                    yield similar(held)
                    held, size = [], 0
        if held:
            yield similar(held)
        pa.default_memory_pool().release_unused()

    with arrow_rows(both.sparkSession, 250):
        return written(both.mapInArrow(each, "a bigint, b bigint"), "links")


def dropped_lines(docs: DataFrame, bound: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, lines: the numbers of the lines that go, for the texts that lose some."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.distinct_lines(occurrences(docs, parts), parts, PAIR_BANDS, BANDS - PAIR_BANDS)
    met = written(dealt.bucket_pairs(rows, BANDS), "lines")
    repeats = met.filter("line IS NOT NULL AND a IS NULL").select("doc_id", "text_key", "line")
    links, involved = similar_lines(docs, met, bound)
    joined = components(links).withColumnRenamed("node", "id")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key", "line")
    named = written(involved.join(joined, "id").withColumn("place", place), "line-groups")
    stay = named.groupBy("component").agg(F.min("place").alias("stays"))
    gone = named.join(stay, "component").filter("place <> stays").select("doc_id", "text_key", "line").unionByName(repeats)
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone"))


def _with_gone(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """``keyed`` (row) with gone, the numbers of the lines that go, or null.

    Where ``gone`` is too large to be broadcast, only texts that may lose lines move to meet it. Each of its texts sets a bit
    by its hash, in a bitmap that is broadcast; texts whose bit is not set lose nothing and stay where they are. The
    bitmap's size is bounded: of more texts more bits are set by others, so more texts move, and no result changes.
    """
    gone = gone.alias("x")
    same = F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64("row.text") == F.col("x.text_key"))
    held = gone.agg(F.sum(F.size("gone") + 1).alias("rows"), F.count(F.lit(1)).alias("texts")).first()
    if (held["rows"] or 0) <= graph.BROADCAST_ROWS:
        return keyed.join(F.broadcast(gone), same, "left").select("row", "x.gone")
    blocks = min(MARK_BLOCKS, -(-held["texts"] * MARK_BITS // BLOCK_BITS))
    at = lambda doc_id, text_key: F.pmod(F.xxhash64(doc_id, text_key), F.lit(blocks * BLOCK_BITS)).alias("at")
    block, bit = F.expr(f"at div {BLOCK_BITS}").alias("block"), F.expr(f"at % {BLOCK_BITS}")
    marks = gone.select(at(F.col("doc_id"), F.col("text_key"))).groupBy(block).agg(F.bitmap_construct_agg(bit).alias("marks"))
    placed = keyed.select("row", at(F.col("row.doc_id").cast("bigint"), F.xxhash64("row.text"))).select("row", "at", block)
    byte = F.conv(F.hex(F.expr(f"substring(marks, CAST(at % {BLOCK_BITS} div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    marked = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(at % 8 AS INT))")) != 0, F.lit(False))
    tried = placed.join(F.broadcast(marks), "block", "left").select("row", marked.alias("marked"))
    stay = tried.filter("NOT marked").select("row", F.lit(None).cast("array<int>").alias("gone"))
    return stay.unionByName(tried.filter("marked").select("row").join(gone, same, "left").select("row", "x.gone"))


def with_clean_text(docs: DataFrame, bound: float = SIMILARITY) -> DataFrame:
    """row (struct of all columns of ``docs``), clean (the text without the lines that go) and gone (how many they are)."""
    gone = alone(docs.sparkSession, lambda: dropped_lines(docs, bound), "gone")
    found = _with_gone(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), gone)
    kept = F.filter(F.split("row.text", "\n"), lambda line, at: ~F.array_contains("gone", at))
    clean = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return found.select("row", clean.alias("clean"), F.coalesce(F.size("gone"), F.lit(0)).alias("gone"))


def deduplicated(docs: DataFrame, bound: float = SIMILARITY) -> DataFrame:
    """``docs`` with the same columns and rows, their texts without repeated lines; n_chars follows the text."""
    columns = {"text": F.col("clean")} | ({"n_chars": F.length("clean").cast("bigint")} if "n_chars" in docs.columns else {})
    return with_clean_text(docs, bound).select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its lines in number, those that go, and the text that is left."""
    found = with_clean_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.coalesce(F.size(F.filter(F.split("row.text", "\n"), lambda x: F.rlike(x, F.lit(r"(?U)\S")))), F.lit(0))
    return found.select("row.doc_id", lines.cast("bigint").alias("n_lines"), F.col("gone").cast("bigint").alias("n_removed"), F.col("clean").alias("clean_text"))
