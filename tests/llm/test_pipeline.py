"""The pipeline's stages: each on all that the one before kept, and the whole against what they say alone."""

import random
import zlib

import corpus_pipeline
from lumenlex.llm import registry
from pyspark.sql import functions as F

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, path):
    rng = random.Random(21)
    mild = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = []
    for i in range(400):
        words, toxic = rng.choices(mild, k=rng.choice([8, 60, 200])), rng.random() < 0.25
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["fnord", "blarghs"])
        texts.append((" ".join(words), int(toxic)))
    clean = [t for t, toxic in texts if not toxic]
    texts += [(clean[0], 0), (clean[1] + " tail", 0), ("shared line of words\n" + clean[2], 0), ("shared line of words\n" + clean[3], 0), (None, 0), ("", 0)]
    docs = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, (t, _) in enumerate(texts)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return texts


def test_stages(spark, tmp_path):
    texts = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"stage{at}")
        stage(spark, seen[-1], str(tmp_path)).write.parquet(out)
        seen.append(spark.read.parquet(out))
    assert all(x.columns == docs.columns for x in seen[:-1])
    toxic = {i for i, (_, y) in enumerate(texts) if y}
    kept = {r["doc_id"] for r in seen[1].collect()}
    wrong = (toxic & kept) | (set(range(len(texts))) - toxic - kept)
    assert len(wrong) <= 0.05 * len(texts)
    assert seen[2].count() == seen[1].count()
    lines = [line for r in seen[2].collect() for line in (r["text"] or "").split("\n") if line.strip()]
    assert len(lines) == len(set(lines))
    ids = [r["doc_id"] for r in seen[3].collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= kept
    words = lambda frame: frame.select(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\S+"))), F.lit(0))).first()[0]
    assert abs(words(seen[4]) - 1.5 * words(seen[3])) < 5
    assert seen[5].count() == seen[4].count() and {"doc_id", "n_tokens", "token_ids"} <= set(seen[5].columns)
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids_sha256")
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, seen[5].select("doc_id", "ids_sha256").collect()), key=str)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and zlib.crc32(b"1") % 5 in range(5)
