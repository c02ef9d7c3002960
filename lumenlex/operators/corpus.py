"""From texts to skip-gram pairs: sentences, deduplication, vocabulary, ids, pairs.

A sentence table has page_ord, sent_idx and tokens; the first two are its total order, which every operator keeps as
columns. Operators are plans of DataFrame functions; lookups in a vocabulary and counts of pairs run over Arrow batches.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlex.functions import text as X
from lumenlex.sources.scratch import written


def _at_least_one(value: int, name: str) -> None:
    if value < 1:
        raise ValueError(f"{name} must be at least 1, not {value}")


def sentence_strings(pages: DataFrame, page_ord: str, clean: Column) -> DataFrame:
    """page_ord, piece_idx, sentence: the sentences of every page in their order."""
    return pages.select(F.col(page_ord).alias("page_ord"), F.posexplode(X.split_sentences(clean)).alias("piece_idx", "sentence"))


def page_sentences(pages: DataFrame, page_ord: str, clean: Column, min_tokens: int = 2) -> DataFrame:
    """page_ord, sent_idx, tokens: sentences of at least ``min_tokens`` tokens, numbered within their page.

    Pass ``markup.strip_markup(text, title)`` as ``clean`` for wiki pages. Sentences are not stripped: white space
    separates tokens, and a blank sentence has none.
    """
    _at_least_one(min_tokens, "min_tokens")
    tokens = F.filter(F.transform(X.split_pieces(clean), X.tokenize), lambda t: F.size(t) >= min_tokens)
    return pages.select(F.col(page_ord).alias("page_ord"), F.posexplode(tokens).alias("sent_idx", "tokens"))


def deduplicate_sentences(sentences: DataFrame) -> DataFrame:
    """The first occurrence, in the table's order, of each distinct token sentence."""
    first = sentences.groupBy("tokens").agg(F.min(F.struct("page_ord", "sent_idx")).alias("first"))
    return first.select("first.page_ord", "first.sent_idx", "tokens")


def token_frequency(sentences: DataFrame) -> DataFrame:
    """word, n. Each batch of sentences counts its own words before they are shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(batch.column("tokens").flatten())
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    return sentences.select("tokens").mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def ranked_ids(words: DataFrame) -> DataFrame:
    """(word, n) -> (id, word, n): ids from 0, by frequency, ties by code point.

    The rank is the place within words of equal frequency and first characters plus the size of all earlier such groups,
    so the words themselves are never sorted in one task; only the groups are. The join is null-safe, as the other kind
    filters one of its sides for nulls, deep in the plan, and the words are then counted twice.
    """
    grouped = words.select("word", "n", F.substring("word", 1, 2).alias("lead"))
    sizes = grouped.groupBy("n", "lead").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy().orderBy(F.desc("n"), "lead").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("n", "lead", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("n", "lead").orderBy("word")) - 1
    met = offsets.withColumnsRenamed({"n": "n_", "lead": "lead_"})
    return grouped.withColumn("place", place).join(met, F.col("n").eqNullSafe(F.col("n_")) & F.col("lead").eqNullSafe(F.col("lead_"))).select((F.col("offset") + F.col("place")).cast("int").alias("id"), "word", "n")


def build_vocabulary(sentences: DataFrame, min_freq: int = 5, max_size: int | None = None, require_ethiopic: bool = True) -> DataFrame:
    """id, word, n: tokens seen at least ``min_freq`` times, most frequent first, at most ``max_size`` of them."""
    if not isinstance(min_freq, int) or min_freq < 1:
        raise ValueError(f"min_freq must be an integer of at least 1, not {min_freq!r}")
    if max_size is not None and (not isinstance(max_size, int) or max_size < 1):
        raise ValueError(f"max_size must be None or an integer of at least 1, not {max_size!r}")
    words = token_frequency(sentences).filter(F.col("n") >= min_freq)
    if require_ethiopic:
        words = words.filter(X.has_ethiopic_letter(F.col("word")))
    if max_size is not None:
        words = words.orderBy(F.desc("n"), "word").limit(max_size)
    return ranked_ids(words)


def check_vocabulary(vocabulary: DataFrame) -> None:
    """Raise ValueError if a word occurs twice (runs a job)."""
    if vocabulary.groupBy("word").count().filter("count > 1").limit(1).collect():
        raise ValueError("the vocabulary holds a word twice")


#: Words of a vocabulary that every worker holds; a larger one is joined.
MOST_WORDS = 1 << 20
#: Rows of an Arrow batch that goes back, and pairs that a task counts before it hands them on.
PLACES = 1 << 16
COUNTED = 1 << 22
#: Groups that counts of pairs are dealt to, a power of 2.
PARTS = 1 << 10


def held_words(vocabulary: DataFrame) -> pa.Table | None:
    """word, id of a vocabulary on the driver; None if it has more than ``MOST_WORDS`` words or a word twice."""
    found = vocabulary.select("word", "id").limit(MOST_WORDS + 1).toArrow().combine_chunks()
    return found if found.num_rows <= MOST_WORDS and len(found["word"].unique()) == found.num_rows else None


def _looked_up(tokens: pa.ListArray, words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """All tokens of some rows, the row of each, and its place in ``words`` (null: not there)."""
    flat = tokens.flatten()
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    return flat, np.repeat(np.arange(len(tokens)), sizes), pc.index_in(flat, value_set=words.cast(flat.type), skip_nulls=True)


def id_sentences(sentences: DataFrame, vocabulary: DataFrame, min_tokens: int = 1) -> DataFrame:
    """page_ord, sent_idx, ids: tokens by id; tokens that are not in the vocabulary go, so their neighbours meet.

    A vocabulary that workers can hold is looked up where the sentences are, without a shuffle; a larger one is joined.
    """
    _at_least_one(min_tokens, "min_tokens")
    held = held_words(vocabulary)
    if held is None:
        placed = sentences.select("page_ord", "sent_idx", F.posexplode("tokens").alias("pos", "word"))
        known = placed.join(vocabulary.select("word", "id"), "word")
        ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
        return known.groupBy("page_ord", "sent_idx").agg(ids.alias("ids")).filter(F.size("ids") >= min_tokens)
    shared = sentences.sparkSession.sparkContext.broadcast(held)

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = (shared.value[c].combine_chunks() for c in ("word", "id"))
        for batch in batches:
            _, rows, places = _looked_up(batch.column("tokens"), words)
            known = pc.is_valid(places).to_numpy(zero_copy_only=False)
            sizes = np.bincount(rows[known], minlength=batch.num_rows)
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), ids.take(places.drop_null()))
            yield pa.RecordBatch.from_arrays([batch.column("page_ord"), batch.column("sent_idx"), listed], ["page_ord", "sent_idx", "ids"]).filter(pa.array(sizes >= min_tokens))

    kinds = dict(sentences.dtypes) | dict(vocabulary.dtypes)
    schema = f"page_ord {kinds['page_ord']}, sent_idx {kinds['sent_idx']}, ids array<{kinds['id']}>"
    return sentences.select("page_ord", "sent_idx", "tokens").mapInArrow(identified, schema)


def apply_vocabulary(sentences: DataFrame, vocabulary: DataFrame, min_tokens: int = 2, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(id sentences of at least ``min_tokens`` ids, one row of statistics). ``check``: refuse a word that occurs twice."""
    if check:
        check_vocabulary(vocabulary)
    every = written(id_sentences(sentences, vocabulary, 1), "ids")
    kept = every.filter(F.size("ids") >= min_tokens)
    _at_least_one(min_tokens, "min_tokens")
    before = sentences.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens_in"), F.count(F.lit(1)).alias("sentences_in"))
    long = F.size("ids") >= min_tokens
    after = every.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("tokens_kept"), F.count_if(long).alias("sentences_kept"))
    used = kept.select(F.explode("ids").alias("id")).distinct()
    unused = vocabulary.join(used, "id", "left_anti").agg(F.count(F.lit(1)).alias("words_unused"))
    stats = before.crossJoin(after).crossJoin(unused)  # three single rows
    return kept, stats.select("tokens_in", "tokens_kept", "sentences_in", "sentences_kept", "words_unused")


def known_tokens(sentences: DataFrame, vocabulary: DataFrame, known: bool = True) -> DataFrame:
    """Occurrences of tokens that are (or are not) in the vocabulary: page_ord, sent_idx, pos, word. Looked up or joined as in ``id_sentences``."""
    held = held_words(vocabulary.select("word", F.lit(0).alias("id")))
    if held is None:
        placed = sentences.select("page_ord", "sent_idx", F.posexplode("tokens").alias("pos", "word"))
        return placed.join(vocabulary.select("word"), "word", "left_semi" if known else "left_anti").select("page_ord", "sent_idx", "pos", "word")
    shared = sentences.sparkSession.sparkContext.broadcast(held)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value["word"].combine_chunks()
        for batch in batches:
            flat, rows, places = _looked_up(batch.column("tokens"), words)
            wanted = np.flatnonzero(pc.is_valid(places).to_numpy(zero_copy_only=False) == known)
            pos = np.arange(len(rows)) - np.searchsorted(rows, rows)  # rows ascend: where a row begins is its first place
            for at in range(0, len(wanted), PLACES):
                some = wanted[at : at + PLACES]
                row = pa.array(rows[some])
                yield pa.RecordBatch.from_arrays([batch.column("page_ord").take(row), batch.column("sent_idx").take(row), pa.array(pos[some], pa.int32()), flat.take(pa.array(some))], ["page_ord", "sent_idx", "pos", "word"])

    kinds = dict(sentences.dtypes)
    return sentences.select("page_ord", "sent_idx", "tokens").mapInArrow(found, f"page_ord {kinds['page_ord']}, sent_idx {kinds['sent_idx']}, pos int, word string")


def generate_pairs(sentences: DataFrame, window: int, items: str = "ids") -> DataFrame:
    """page_ord, sent_idx, c, q, center, context for all places c <> q of a sentence at most ``window`` apart.

    Without a shuffle: the pairs of a sentence are built from its own array. The four first columns are the order.
    """
    _at_least_one(window, "window")
    apart = np.array([d for d in range(-window, window + 1) if d])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = batch.column(items).flatten(), pc.fill_null(pc.list_value_length(batch.column(items)), 0).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            pos = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
            last = sizes[rows] - 1
            step = max(1, PLACES // len(apart))
            for at in range(0, len(rows), step):
                q = pos[at : at + step, None] + apart
                c, k = np.nonzero((q >= 0) & (q <= last[at : at + step, None]))
                row, c, q = pa.array(rows[at + c]), at + c, q[c, k]
                arrays = [batch.column("page_ord").take(row), batch.column("sent_idx").take(row), pa.array(pos[c], pa.int32()), pa.array(q, pa.int32())]
                yield pa.RecordBatch.from_arrays([*arrays, flat.take(pa.array(c)), flat.take(pa.array(c + apart[k]))], names)

    names, kinds = ["page_ord", "sent_idx", "c", "q", "center", "context"], dict(sentences.dtypes)
    item = kinds[items].removeprefix("array<").removesuffix(">")
    schema = f"page_ord {kinds['page_ord']}, sent_idx {kinds['sent_idx']}, c int, q int, center {item}, context {item}"
    return sentences.select("page_ord", "sent_idx", items).mapInArrow(paired, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


def sentence_pair_counts(sentences: DataFrame, window: int) -> DataFrame:
    """``pair_counts`` of ``generate_pairs`` of id sentences, without a row for each pair.

    A pair of places counts once for both its directions, as the window is the same on both sides. Tasks count their own
    pairs, in pieces of bounded size, and deal the counts as packed arrays to ``PARTS`` groups, which add them up. Ids
    are of type int.
    """
    _at_least_one(window, "window")

    def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        part = ((found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        parts, first = np.unique(part[order], return_index=True)
        pieces = [np.split(x[order], first[1:]) for x in (found, n)]
        return pa.RecordBatch.from_arrays([pa.array(parts), *(pa.array([x.tobytes() for x in p], pa.binary()) for p in pieces)], ["part", "keys", "ns"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0
        for batch in batches:
            ids = batch.column("ids").flatten().to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False))
            for apart in range(1, window + 1):
                same = rows[apart:] == rows[:-apart]
                if not same.any():
                    break
                a, b = ids[:-apart][same], ids[apart:][same]
                keys.append((np.minimum(a, b) << 32) | (np.maximum(a, b) & 0xFFFFFFFF))
                held += len(a)
            if held >= COUNTED:
                yield counted(keys)
                keys, held = [], 0
        if keys:
            yield counted(keys)

    def summed(rows: pa.Table) -> pa.Table:
        keys, n = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c].to_pylist()]) for c in ("keys", "ns"))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, n = keys[first], np.add.reduceat(n, first)
        a, b = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        apart = a != b
        columns = np.append(a, b[apart]), np.append(b, a[apart]), np.append(np.where(apart, n, 2 * n), n[apart])
        return pa.table([pa.array(x) for x in columns], ["center", "context", "n"])

    dealt = sentences.select(F.col("ids").cast("array<int>").alias("ids")).mapInArrow(count, "part int, keys binary, ns binary")
    return dealt.groupBy("part").applyInArrow(summed, "center int, context int, n bigint")


#: Page ordinals of a group when sentences are numbered.
PAGES = 65_536


def sample_sentences(sentences: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample of n sentences in their order: that of Python's generator over the sentences' places.

    The places are drawn on the driver (n of them). A page's offset is the size of all earlier groups of ``PAGES``
    ordinals, whose sums are few, and of the earlier pages of its own group; page ordinals are integers.
    """
    _at_least_one(n, "n")
    group = F.floor(F.col("page_ord") / PAGES)
    per_page = sentences.groupBy("page_ord").agg(F.count(F.lit(1)).alias("size")).withColumn("group", group)
    earlier = lambda window, by: F.coalesce(F.sum("size").over(window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_group = per_page.groupBy("group").agg(F.sum("size").alias("size")).select("group", earlier(Window.partitionBy(), "group").alias("before"))
    inside = per_page.withColumn("inside", earlier(Window.partitionBy("group"), "page_ord"))
    offsets = inside.join(per_group, "group").select("page_ord", (F.col("before") + F.col("inside")).alias("offset"))
    rows = sentences.count()
    if n >= rows:
        return sentences
    chosen = random.Random(seed).sample(range(rows), n)
    place = F.row_number().over(Window.partitionBy("page_ord").orderBy("sent_idx")) - 1
    numbered = sentences.withColumn("place", place).join(offsets, "page_ord").withColumn("ord", F.col("offset") + F.col("place"))
    wanted = sentences.sparkSession.createDataFrame([(int(i),) for i in chosen], "ord bigint")
    return numbered.join(wanted, "ord", "left_semi").select(*sentences.columns)
