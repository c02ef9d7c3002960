"""Deduplication, vocabulary, ids, pairs, samples and the quality report."""

import random
from collections import Counter

import pytest

from lumenlex.operators import corpus as C
from lumenlex.operators import quality as Q
from lumenlex.operators import training as T


def table(spark, sentences):
    return spark.createDataFrame([(0, i, s) for i, s in enumerate(sentences)], "page_ord bigint, sent_idx int, tokens array<string>")


def ordered(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("page_ord", "sent_idx").collect()]


def test_dedup_keeps_the_first(spark):
    s = table(spark, [["a", "b"], ["c", "d"], ["a", "b"], ["b", "a"], ["c", "d"]])
    assert ordered(C.deduplicate_sentences(s), "sent_idx", "tokens") == [(0, ["a", "b"]), (1, ["c", "d"]), (3, ["b", "a"])]


def test_vocabulary_order_limits_and_script(spark):
    s = table(spark, [["ለ", "ሀ", "x"], ["ሀ", "ለ", "x", "2"], ["x", "መa"]])
    words = lambda **k: [(r["id"], r["word"], r["n"]) for r in C.build_vocabulary(s, **k).orderBy("id").collect()]
    assert words(min_freq=1) == [(0, "ሀ", 2), (1, "ለ", 2), (2, "መa", 1)]
    assert words(min_freq=1, require_ethiopic=False) == [(0, "x", 3), (1, "ሀ", 2), (2, "ለ", 2), (3, "2", 1), (4, "መa", 1)]
    assert words(min_freq=2, max_size=1, require_ethiopic=False) == [(0, "x", 3)]
    assert words(min_freq=9) == []
    for bad in ({"min_freq": 0}, {"min_freq": 1.5}, {"max_size": 0}):
        with pytest.raises(ValueError):
            C.build_vocabulary(s, **bad)


def test_ranks_are_those_of_one_sort(spark):
    rng = random.Random(2)
    counts = Counter("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(3000))
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = {r["word"]: r["id"] for r in C.ranked_ids(frame).collect()}
    assert found == {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}


def test_ids_and_statistics(spark):
    s = table(spark, [["a", "zz", "b"], ["zz", "a"], ["b", "b", "a"], ["qq"]])
    v = spark.createDataFrame([(0, "a", 3), (1, "b", 3), (2, "unused", 1)], "id int, word string, n bigint")
    kept, stats = C.apply_vocabulary(s, v)
    assert ordered(kept, "sent_idx", "ids") == [(0, [0, 1]), (2, [1, 1, 0])]
    assert stats.first().asDict() == {"tokens_in": 9, "tokens_kept": 6, "sentences_in": 4, "sentences_kept": 2, "words_unused": 1}
    with pytest.raises(ValueError):
        C.apply_vocabulary(s, v.union(v))
    with pytest.raises(ValueError):
        C.apply_vocabulary(s, v, 0)
    assert C.known_tokens(s, v, False).count() == 3 and C.known_tokens(s, v).count() == 6


@pytest.mark.parametrize("window", [1, 2, 5])
def test_pairs_against_loops(spark, window):
    sentences = [["a", "b", "c", "d"], ["a", "b", "a"], ["x"], ["p", "p"]]
    wanted = [(s[c], s[q]) for s in sentences for c in range(len(s)) for q in range(len(s)) if 1 <= abs(c - q) <= window]
    found = C.generate_pairs(table(spark, sentences), window, "tokens").orderBy("page_ord", "sent_idx", "c", "q").collect()
    assert [(r["center"], r["context"]) for r in found] == wanted
    with pytest.raises(ValueError):
        C.generate_pairs(table(spark, sentences), 0, "tokens")


def test_fingerprints_agree(spark):
    ids = spark.createDataFrame([(0, 0, [3, 1, 2]), (0, 1, [0, 2])], "page_ord bigint, sent_idx int, ids array<int>")
    pairs = C.generate_pairs(ids, 2)
    assert T.frame_fingerprint(pairs) == T.pairs_fingerprint(T.ordered_pairs(pairs))


def test_sample_is_the_generators(spark):
    s = spark.createDataFrame([(i // 7, i % 7, [str(i), "x"]) for i in range(100)], "page_ord bigint, sent_idx int, tokens array<string>")
    wanted = sorted(random.Random(4).sample(range(100), 10))
    assert [int(t[0]) for (t,) in ordered(C.sample_sentences(s, 10, 4), "tokens")] == wanted
    assert C.sample_sentences(s, 100, 4).count() == 100
    with pytest.raises(ValueError):
        C.sample_sentences(s, 0, 4)


def test_quality_report(spark):
    before = table(spark, [["ሀለ", "a1"], ["ሀለ", "a1"], ["אב", "፩", "x"], ["ሀለ", "b", "b", "é"]])
    final = C.deduplicate_sentences(before)
    report = Q.build_quality_report(before, final, 5, 2, 100)
    assert report["documents"]["pages_with_usable_sentences"] == 3
    assert report["sentences"] == {"before_deduplication": 4, "after_deduplication": 3, "exact_duplicates_removed": 1, "duplicate_percent": 25.0}
    assert {k: v for k, v in report["tokens"].items() if k != "most_frequent_20"} == {"total": 9, "distinct": 7, "seen_once": 5, "seen_at_least_5": 0, "seen_at_least_10": 0, "seen_at_least_20": 0}
    assert report["tokens"]["most_frequent_20"] == [("ሀለ", 2), ("b", 2), ("a1", 1), ("אב", 1), ("፩", 1), ("x", 1), ("é", 1)]
    assert report["sentence_length_tokens"] == {"min": 2, "mean": 3.0, "median": 3, "p95": 4, "max": 4}
    assert report["characters_in_final_tokens"] == {"ethiopic_letters": 4, "ethiopic_numerals": 1, "ascii_letters": 4, "ascii_digits": 1, "other": 3}
    assert report["most_common_other_characters"] == [["א", "U+05D0", 1], ["ב", "U+05D1", 1], ["é", "U+00E9", 1]]
    assert report["discarded_text"] == {"raw_characters": 100, "characters_in_final_tokens": 13, "retained_character_percent": 13.0}
    for bad in ((before.limit(0), 5, 2, 100), (final, 5, 2, 0), (final, 5, 6, 100), (before.union(before), 5, 2, 100)):
        with pytest.raises(ValueError):
            Q.build_quality_report(before, *bad)


def test_lengths_p95_is_by_place(spark):
    lengths = Q.sentence_lengths(table(spark, [["x"] * n for n in range(1, 21)])).first()
    assert (lengths["p95_length"], lengths["median_length"], lengths["n_tokens"]) == (20, 10.5, 210)


def test_vocabularies_are_looked_up_as_they_are_joined(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    s = spark.createDataFrame([(i // 3, i % 3, [rng.choice([*words, "no"]) for _ in range(i % 7)]) for i in range(90)], "page_ord bigint, sent_idx int, tokens array<string>")
    v = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "id int, word string, n bigint")
    looked = [C.id_sentences(s, v, 2), C.known_tokens(s, v), C.known_tokens(s, v, False)]
    for frame in looked:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(C, "MOST_WORDS", 29)
    joined = [C.id_sentences(s, v, 2), C.known_tokens(s, v), C.known_tokens(s, v, False)]
    for a, b in zip(looked, joined, strict=True):
        assert a.dtypes == b.dtypes and sorted(a.collect()) == sorted(b.collect())
    monkeypatch.setattr(C, "MOST_WORDS", 99)
    twice = v.union(v.limit(1))  # a word that stands twice is joined twice
    assert "Join" in C.id_sentences(s, twice)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("window", [1, 2, 4])
@pytest.mark.parametrize("piece", [5, 1 << 22])
def test_pair_counts_of_sentences(spark, monkeypatch, window, piece):
    monkeypatch.setattr(C, "COUNTED", piece)
    monkeypatch.setattr(C, "PLACES", 3)
    sentences = [[0, 1, 0, 2], [3], [], [1, 1, 1], [2**31 - 1, 0, 5, 2**31 - 1], [4, 5]]
    ids = spark.createDataFrame([(0, i, s) for i, s in enumerate(sentences)], "page_ord bigint, sent_idx int, ids array<int>")
    wanted = Counter((s[c], s[q]) for s in sentences for c in range(len(s)) for q in range(len(s)) if 1 <= abs(c - q) <= window)
    found = C.sentence_pair_counts(ids, window)
    assert {(r["center"], r["context"]): r["n"] for r in found.collect()} == wanted
    assert found.dtypes == C.pair_counts(C.generate_pairs(ids, window)).dtypes
    with pytest.raises(ValueError):
        C.sentence_pair_counts(ids, 0)


def test_words_are_counted_before_they_move(spark):
    """What leaves a task is a row for each word of a batch, not one for each occurrence."""
    s = spark.createDataFrame([(1 - i % 2, i // 2, ["a", "b", "a"] if i else ["c", "a"]) for i in range(200)], "page_ord bigint, sent_idx int, tokens array<string>").coalesce(1)
    found = {r["word"]: (r["n"], tuple(r["first"])) for r in Q.first_seen(s).collect()}
    assert found == {"a": (399, (0, 0, 0)), "b": (199, (0, 0, 1)), "c": (1, (1, 0, 0))}
    assert {r["word"]: r["n"] for r in C.token_frequency(s).collect()} == {"a": 399, "b": 199, "c": 1}
    for frame in (Q.first_seen(s), C.token_frequency(s)):
        assert "Generate" not in frame._jdf.queryExecution().executedPlan().toString()
