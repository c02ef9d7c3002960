"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

Host and path are cut from the url with column expressions, and a handful of rules become one expression over them. The
regression sees the n-grams of 3 to 5 characters of the host and of the path (each in its own part of the hash space),
and is trained on the driver in numpy from a small labelled URL table: at most ``LABELLED`` rows of each verdict, those
whose url has the smallest MD5, so the same table gives the same model. The query's labelled table are the urls that
the rules decide.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
regression's bias; repeated rows are judged each; rules of equal length go by code-point order; without labelled rows
of both verdicts every url that no rule decides gets the only verdict known, or allow; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm.common import map_arrow, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labelled rows of each verdict that the model is trained on, at most.
LABELLED = 2000
GRAMS = (3, 4, 5)
BITS = 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, keep: str = "page_id") -> DataFrame:
    """The column ``keep``, url, host, path: the host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, the path on to ``?`` or ``#``."""
    part = lambda n: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return pages.select(keep, "url", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path starts the url's; null if none fits."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = (host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))
        found = F.when(fits & F.startswith(path, F.lit(slash + rule_path)), F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    found = F.lit(None).cast("string")
    for verdict, text in rules:
        found = F.when(rule == text, verdict).otherwise(found)
    return found


def grams(host: str, path: str) -> np.ndarray:
    """The distinct hashed n-grams of a url's host and path."""
    found = {crc32(f"{part}{n}{text[at : at + n]}".encode()) >> (32 - BITS) for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in GRAMS for at in range(max(0, len(text) - n + 1))}
    return np.fromiter(found, np.int64, len(found))


class Regression:
    """Logistic regression over hashed n-grams; ``score`` is the probability of block."""

    def __init__(self, rows: list[tuple[str, str, int]], steps: int = 150, rate: float = 0.5, decay: float = 1e-4):
        y = np.array([x[2] for x in rows], float)
        self.weights, self.bias = np.zeros(1 << BITS), 0.0
        if len(set(y)) < 2:
            self.bias = 1.0 if len(y) and y[0] else -1.0
            return
        features = [grams(host, path) for host, path, _ in rows]
        at = np.repeat(np.arange(len(rows)), [len(x) for x in features])
        ids = np.concatenate(features)
        norm = 1 / np.sqrt(np.array([len(x) for x in features]))
        balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
        seen, seen_bias = np.full(1 << BITS, 1e-8), 1e-8
        for _ in range(steps):  # full-batch AdaGrad
            z = np.bincount(at, self.weights[ids], len(rows)) * norm + self.bias
            error = (1 / (1 + np.exp(-z)) - y) * balance
            slope = np.bincount(ids, (error * norm)[at], 1 << BITS) + decay * self.weights
            seen += slope**2
            self.weights -= rate * slope / np.sqrt(seen)
            seen_bias += error.sum() ** 2
            self.bias -= rate * error.sum() / np.sqrt(seen_bias)

    def score(self, host: str, path: str) -> float:
        found = grams(host, path)
        return float(1 / (1 + np.exp(-(self.weights[found].sum() / np.sqrt(max(1, len(found))) + self.bias))))


def train(labelled: DataFrame, most: int = LABELLED) -> Regression:
    """``labelled``: url, label (block or allow). A bounded number of rows of each label come to the driver."""
    urls = labelled.groupBy("url").agg(F.min("label").alias("label")).filter("url IS NOT NULL")
    parts = with_parts(urls, "label").select("host", "path", "label", F.md5("url").alias("key"))
    rows = []
    for label, y in (("allow", 0), ("block", 1)):
        rows += [(r["host"], r["path"], y) for r in parts.filter(F.col("label") == label).orderBy("key", "host", "path").limit(most).collect()]
    return Regression(rows)


def judge(pages: DataFrame, model: Regression, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's block_score for every row."""
    parts = with_parts(pages)
    ruled = parts.select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"))

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        scores = [model.score(host, path) for host, path in zip(hosts, paths, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "block_score"])

    out = map_arrow(ruled, scored, "page_id bigint, host string, path string, rule string, block_score double", 5000)
    by_score = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), by_score).alias("verdict"), "block_score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages, judged by the rules or by a model trained on what the rules decide."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint"), "url")
    parts = with_parts(pages)
    labelled = parts.select("url", verdict_of(fitting_rule(F.col("host"), F.col("path"))).alias("label")).filter("label IS NOT NULL")
    return judge(pages, train(labelled))
