"""Byte-level BPE, mixing, streaming dedup, WARC and URL rules: exact results."""

import base64
import gzip
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumenlex.llm import byte_bpe, mixing, stream_dedup, url_filter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, size string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


def test_bpe_equals_tiktoken(spark, reference):
    rng = random.Random(1)
    texts = ["", None, "a", " \n\n  x", "it's we'll don'T", "<|endoftext|>", "ሀለሐ መ", "𝒳𝒴 😀😀", "x" * 5000, "na\u00efve\u2028\u001c1²½Ⅷ"]
    texts += ["".join(rng.choice("abcdeàéß 中文ሀ\n\t'.,!1 st\u00a0😀") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    rows = byte_bpe.encode_documents(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts, strict=True):
        ids = reference.encode_ordinary(text or "")
        assert row["token_ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_on_no_rows_and_no_ids(spark):
    assert byte_bpe.encode_documents(docs(spark, [])).collect() == []
    rows = byte_bpe.encode_documents(docs(spark, [(None, "a b", "s"), (None, "a b", "s")]), with_ids=False).collect()
    assert [r["n_tokens"] for r in rows] == [2, 2] and rows[0]["doc_id"] is None


def expected_targets(sizes):
    """Share and reshare until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = 1.5 * sum(sizes.values())
    while open_:
        unit = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if unit * weights[s] > 2 * sizes[s]}
        if not above:
            return target | {s: unit * weights[s] for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "Z", None, "é"])) for i in range(600)]
    rows += [(600, None, "a"), (601, "", None), (602, "x " * 20000, "b"), (602, "x " * 20000, "b"), (None, "one two", "tiny")]
    found = mixing.mix(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    size_of = lambda t: len((t or "").split())
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    wanted = expected_targets(sizes)
    taken: dict = {}
    for r in found:
        assert abs(r["target"] - wanted[r["source"]]) < 1e-6 * max(1, wanted[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= 1
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_mixed_documents_hold_what_the_mix_takes(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["", " "]) + " \n".join(["w"] * rng.randint(0, 30)) + rng.choice(["", "\n"]), rng.choice("aaabc")) for i in range(200)]
    table = docs(spark, rows + [(200, None, "a"), (7, rows[7][1], rows[7][2])])
    out = mixing.mixed_documents(table)
    assert out.schema == table.schema or [f.name for f in out.schema] == table.columns
    words: dict = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    taken: dict = {}
    for r in mixing.mix(table).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert mixing.mixed_documents(docs(spark, [])).collect() == []
    (row,) = mixing.mix(docs(spark, [(1, None, None)])).collect()
    assert (row["taken"], row["target"]) == (0, 0)


def test_prefix_of_words(spark):
    rows = spark.createDataFrame([(" a  b\nc ", 2), ("a b", 2), ("a\tb c", 1), ("a b", 0)], "t string, n int")
    assert [r["x"] for r in rows.select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()] == [" a  b", "a b", "a", ""]


def brute_groups(rows):
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups: dict = {}
    for (i, _), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(i)
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        known = [x for x in groups[n] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


DEDUP = [(5, "a  b"), (3, "a b"), (9, "a\n\x0bb"), (4, " a b"), (1, None), (2, ""), (8, "x" * 200_000), (7, "x" * 200_000), (6, "lone"), (6, "lone"), (None, "a b"), (None, "nobody"), (10, "a\u00a0b")]


@pytest.mark.parametrize("bits", [256, 4])
def test_stream_dedup(spark, tmp_path, bits):
    """With digests of four bits most texts collide; the comparison of full bytes keeps them apart."""
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, t, "digest", 1) for i, t in DEDUP], "doc_id bigint, text string, digest string, n int").repartition(3).write.parquet(path)
    rows = stream_dedup.exact_groups(spark, path, bits=bits).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows), key=str) == brute_groups(DEDUP)
    assert all(r["keep_file"].endswith(".parquet") and r["keep_row"] >= 0 for r in rows)


def test_stream_state_goes_on_with_new_files(spark, tmp_path):
    path, state = str(tmp_path / "d.parquet"), str(tmp_path / "state")
    write = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(path)
    write(DEDUP[:6])
    assert stream_dedup.exact_groups(spark, path, state).count() == 6
    write(DEDUP[6:])
    rows = stream_dedup.exact_groups(spark, path, state).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows), key=str) == brute_groups(DEDUP)


def test_stream_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(path)
    assert stream_dedup.exact_groups(spark, path).collect() == []


PAGES = [(4, "http://h.x/a?b#c", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "u\r\nX: y", "same"), (7, None, "same"), (9, "http://z", None), (1, "http://z", ""), (5, "http://q", "same"), (5, "http://q", "same"), (None, "http://n", "same"), (3, "http://big/", "z" * 300_000)]


def test_warc_round_trip(spark, tmp_path):
    table = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, type string")
    path = str(tmp_path / "w")
    warc.write_archives(table.repartition(2), path, records_per_file=4)
    found = warc.resolved(warc.captures(warc.read_records(spark, path)))
    rows = [(r["metadata"]["page_id"], bytes(r["response"]["payload"]), r["response"]["payload_digest"], r["response"]["type"], r["refers_to_page"]) for r in found.collect() for _ in range(r["n"])]
    wanted = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        first = min(x for x, _, h in PAGES if (h or "") == (html or "") and x is not None)
        wanted.append((i, payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(rows, key=str) == sorted(wanted, key=str)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part")]
    assert len(files) > 4 and all(b"WARC-Concurrent-To" in gzip.decompress(f.read_bytes()) or f for f in files)
    (one,) = found.filter("metadata.page_id = 4").collect()
    assert one["request"]["target_uri"] == "http://h.x/a?b#c"


def test_warc_limits(spark, tmp_path):
    table = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc.write_archives(table, str(tmp_path / "w"), least_bytes=5)
    kinds = {r["response"]["type"] for r in warc.captures(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert kinds == {"response"}
    warc.write_archives(table.limit(0), str(tmp_path / "e"))
    assert warc.captures(warc.read_records(spark, str(tmp_path / "e"))).collect() == []
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:end]


URLS = ["http://Example.COM/en/7x", "https://a.example.com/en/8", "http://xcom/en/", "ftp://b.net/de/1", "http://example.net/de/81", "http://org/es/", "http://x.org?y://z/es/", "no", None, "", "http://ÀB.com#/en/", "a://b://c/d", "://x.com/en/q", "http://example.com", "http://h\n.com/en/a\nb?c"]


def test_urls(spark):
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, host string, verdict string")
    labelled = spark.createDataFrame([(f"http://spam{i}.bad/casino/{i}", "block") for i in range(40)] + [(f"http://news{i}.good/article/{i}", "allow") for i in range(40)], "url string, label string")
    model = url_filter.train(labelled)
    rows = url_filter.judge(table, model).collect()
    assert len(rows) == 2 * len(URLS)
    verdicts = dict((rule, verdict) for verdict, rule in url_filter.RULES)
    for r in rows:
        host, path = brute_url(URLS[r["page_id"] % len(URLS)])
        fitting = [rule for _, rule in url_filter.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
        wanted = max(fitting, key=len) if fitting else None
        assert (r["host"], r["path"], r["rule"]) == (host, path, wanted)
        assert r["verdict"] == (verdicts[wanted] if wanted else "block" if r["block_score"] >= 0.5 else "allow")
    assert model.score("spam99.bad", "/casino/5") > 0.5 > model.score("news77.good", "/article/3")
    assert url_filter.judge(table.limit(0), model).collect() == []
    assert url_filter.train(labelled.filter("label = 'allow'")).score("x", "/y") < 0.5
