"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input joins three embeddings: of its hash, of the hash of its first four characters, and the mean over its
character trigrams. A network of gated recurrent units reads windows of ``WINDOW`` words, ``STRIDE`` apart, in both
directions; attention pools the states of a window into one logit, and the largest logit of a document's windows is the
document's. Every window of a whole text is scored. All of it is numpy: hashing, embedding and the recurrence work on
arrays of all words of some hundred thousand characters at a time.

Training is on the driver, on a bounded sample of at most ``SAMPLE`` labelled rows of each label (those whose doc_id has
the smallest MD5), never on rows whose crc32(doc_id as text) mod 5 is 0. The first embedding component of a word or
prefix starts as its smoothed log odds between the labels; then all parameters are trained through time on the windows
that decide each document. At last the bias is set so that the threshold 0.5 separates a part of the sample, which
took no part in training, best.

Defined results: null and empty texts are one empty window, whose score is that of the attention over nothing; a null
doc_id is not held out; rows are judged each, so repeated rows repeat; of contradicting labels of one doc_id the higher
counts; labels that are null, and labels without a document, are left out; without labels of both kinds every score is
0; an empty table gives an empty table; other columns are never inputs, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm.common import map_arrow, table, trim
from lumenlex.llm.hashing import Split, segments, top_bits

SAMPLE = {1: 1500, 0: 2500}
WINDOW, STRIDE = 32, 24
HIDDEN = 8
WORD_BITS, PREFIX_BITS, GRAM_BITS = 17, 15, 13
WORD_DIM, PREFIX_DIM, GRAM_DIM = 6, 4, 6
PREFIX = 4
#: Characters of text that are worked on at a time; one longer text makes a longer array.
CHUNK = 150_000


class Words:
    """The words of some texts: ``of`` maps every word to one of the distinct words, ``counts`` has the words per text.

    What there is of every word and trigram takes 4 bytes each, as training holds the words of the whole sample.
    """

    def __init__(self, texts: list[str]):
        split = Split(texts)
        self.counts = split.counts
        _, first, of = np.unique(split.hashes(), return_index=True, return_inverse=True)
        starts = split.starts[first]
        length = split.ends[first] - starts
        self.of, self.length = of.astype(np.int32), length.astype(np.int32)
        self.word, self.prefix = (top_bits(h[first], bits).astype(np.int32) for h, bits in ((split.hashes(), WORD_BITS), (split.hashes(PREFIX), PREFIX_BITS)))
        at, chars = segments(starts, length), split.chars
        gram = chars[at - 1] * np.uint64(0x100000001B3) + chars[at] * np.uint64(0x9E3779B1) + chars[at + 1] * np.uint64(0x85EBCA77C2B2AE63)
        self.gram = top_bits(gram, GRAM_BITS).astype(np.int32)

    def __len__(self) -> int:
        return len(self.word)

    @classmethod
    def joined(cls, parts: list[Words]) -> Words:
        """The words of several parts, one after the other; a word in two parts stays in each."""
        out = cls.__new__(cls)
        bases = np.cumsum([0, *map(len, parts)])
        out.of = np.concatenate([part.of + np.int32(base) for part, base in zip(parts, bases, strict=False)])
        for name in ("counts", "word", "prefix", "length", "gram"):
            setattr(out, name, np.concatenate([getattr(part, name) for part in parts]))
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows, WINDOW) of distinct words, -1 past the end, and the text of each window. An empty text has one."""
        n = np.maximum(1, 1 + -(-(self.counts - WINDOW) // STRIDE) * (self.counts > WINDOW))
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        offset = (np.cumsum(self.counts) - self.counts)[text]
        at = place[:, None] * STRIDE + np.arange(WINDOW)
        valid = at < self.counts[text][:, None]
        at += offset[:, None]
        np.minimum(at, max(0, len(self.of) - 1), out=at)
        return np.where(valid, self.of[at] if len(self.of) else np.int32(0), np.int32(-1)), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -80, 80)))


class Network:
    """Parameters, inference and gradients."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        size, h = WORD_DIM + PREFIX_DIM + GRAM_DIM, HIDDEN
        self.tables = {"word": small(1 << WORD_BITS, WORD_DIM) * 0.2, "prefix": small(1 << PREFIX_BITS, PREFIX_DIM) * 0.2, "gram": small(1 << GRAM_BITS, GRAM_DIM)}
        self.p = {"wx": small(size, 6 * h) * 2, "bx": np.zeros(6 * h, np.float32), "uf": small(h, 3 * h) * 2, "ub": small(h, 3 * h) * 2, "va": small(2 * h), "wo": small(2 * h) * 3, "bo": np.zeros(1, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        if not len(words):
            return np.zeros((0, WORD_DIM + PREFIX_DIM + GRAM_DIM), np.float32)
        starts = np.cumsum(words.length) - words.length
        grams = np.add.reduceat(self.tables["gram"][words.gram], starts, axis=0) / words.length[:, None]
        return np.concatenate([self.tables["word"][words.word], self.tables["prefix"][words.prefix], grams], 1).astype(np.float32)

    def _run(self, gates: np.ndarray, mask: np.ndarray, u: np.ndarray, order: range, keep: list | None) -> np.ndarray:
        """The states of one direction: gates (WINDOW, windows, 3 * HIDDEN) are the inputs' share."""
        h, k = np.zeros((gates.shape[1], HIDDEN), np.float32), HIDDEN
        out = np.empty((WINDOW, gates.shape[1], HIDDEN), np.float32)
        for t in order:
            x, s = gates[t], h @ u
            zr = _sigmoid(x[:, : 2 * k] + s[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(x[:, 2 * k :] + r * s[:, 2 * k :])
            new = n + z * (h - n)
            new = np.where(mask[t], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, s[:, 2 * k :]))
            out[t] = h = new
        return out

    def logits(self, projected: np.ndarray, windows: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """``projected``: the input share of the gates of every distinct word and, last, of padding."""
        by_step = np.ascontiguousarray(windows.T)
        mask = (by_step >= 0)[:, :, None]
        gates = projected[by_step]
        kept = ([], []) if tape is not None else (None, None)
        states = np.concatenate([self._run(gates[:, :, : 3 * HIDDEN], mask, self.p["uf"], range(WINDOW), kept[0]), self._run(gates[:, :, 3 * HIDDEN :], mask, self.p["ub"], range(WINDOW - 1, -1, -1), kept[1])], 2)
        score = np.where(mask[:, :, 0], states @ self.p["va"], -1e9)
        weight = np.exp(score - score.max(0)) * mask[:, :, 0]
        weight = weight / np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbk->bk", weight, states)
        if tape is not None:
            tape |= {"mask": mask, "states": states, "weight": weight, "pooled": pooled, "kept": kept}
        return pooled @ self.p["wo"] + self.p["bo"]

    def projection(self, inputs: np.ndarray) -> np.ndarray:
        return np.concatenate([inputs @ self.p["wx"] + self.p["bx"], np.zeros((1, 6 * HIDDEN), np.float32)])

    def score_windows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Logit and text of every window."""
        windows, text = words.windows()
        projected = self.projection(self.inputs(words))
        parts = [self.logits(projected, windows[at : at + 4096]) for at in range(0, len(windows), 4096)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32), text

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of every text."""
        logits, text = self.score_windows(Words(texts))
        most = np.full(len(texts), -np.inf)
        np.maximum.at(most, text, logits)
        return _sigmoid(most)

    def gradients(self, error: np.ndarray, tape: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the dense parameters, and of the gates' inputs (WINDOW, windows, 6 * HIDDEN). error: d loss / d logit."""
        p, k = self.p, HIDDEN
        states, weight, mask = tape["states"], tape["weight"], tape["mask"]
        grad = {"wo": tape["pooled"].T @ error, "bo": error.sum(keepdims=True)}
        d_pooled = error[:, None] * p["wo"]
        d_weight = np.einsum("bk,tbk->tb", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        grad["va"] = np.einsum("tb,tbk->k", d_score, states)
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * p["va"]
        d_gates = np.zeros((WINDOW, len(error), 6 * k), np.float32)
        for name, part, kept in (("uf", 0, tape["kept"][0]), ("ub", 1, tape["kept"][1])):
            u, carry, grad[name] = p[name], np.zeros((len(error), k), np.float32), np.zeros_like(p[name])
            for t, before, z, r, n, s in reversed(kept):
                d = d_states[t, :, part * k : (part + 1) * k] + carry
                live = d * mask[t]
                d_n = live * (1 - z) * (1 - n * n)
                d_s = np.concatenate([live * (before - n) * z * (1 - z), d_n * s * r * (1 - r), d_n * r], 1)
                grad[name] += before.T @ d_s
                carry = d * ~mask[t] + live * z + d_s @ u.T
                d_gates[t, :, part * 3 * k : part * 3 * k + 2 * k] = d_s[:, : 2 * k]
                d_gates[t, :, part * 3 * k + 2 * k : (part + 1) * 3 * k] = d_n
        return grad, d_gates


def _parts(texts: list[str]) -> list[list[str]]:
    """The texts in their order, in parts of about CHUNK characters."""
    out, size = [[]], 0
    for text in texts:
        if size >= CHUNK:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text)
    return out


def _log_odds(ids: np.ndarray, texts: np.ndarray, labels: np.ndarray, size: int, prior: float = 3.0) -> np.ndarray:
    """Smoothed log odds of the labels for every id, counting each text once."""
    pairs = np.unique(texts * size + ids)
    n = [np.bincount(pairs[labels[pairs // size] == y] % size, minlength=size) for y in (0, 1)]
    return np.log((n[1] + prior) / (labels.sum() + 2 * prior)) - np.log((n[0] + prior) / ((1 - labels).sum() + 2 * prior))


def train(texts: list[str], labels: list[int], epochs: int = 14, batch: int = 64, rate: float = 0.05, seed: int = 11) -> Network:
    """A network from labelled texts. A fifth of them only sets the threshold."""
    rng = np.random.default_rng(seed)
    net = Network(seed)
    y = np.array([*labels, 0])
    if len(set(labels)) < 2:
        net.p["bo"][:] = -1e9
        return net
    # In parts of bounded size, so that the arrays of characters never hold the whole sample.
    parts = [Words(part) for part in _parts([*texts, ""])]  # an empty text is not toxic
    words = Words.joined(parts)
    held_out = np.arange(len(y)) % 5 == 4
    held_out[-1] = False
    word_text = np.repeat(np.arange(len(y)), words.counts)
    learn = ~held_out[word_text]
    relabel = y.astype(np.int64)
    for name, ids, size in (("word", words.word, 1 << WORD_BITS), ("prefix", words.prefix, 1 << PREFIX_BITS)):
        # Log odds stand in the first component; absent ids stay at 0.
        odds = _log_odds(ids[words.of[learn]], word_text[learn], relabel, size)
        net.tables[name][:, 0] = (odds - np.median(odds)) / 2
    windows, text = words.windows()
    starts = np.searchsorted(text, np.arange(len(y) + 1))
    own = np.flatnonzero(~held_out)
    share = y[own].mean()
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    seen = {k: np.full_like(v, 1e-6) for k, v in (net.p | net.tables).items()}
    gram_start = np.cumsum(words.length) - words.length

    def all_logits() -> np.ndarray:
        return np.concatenate([net.score_windows(part)[0] for part in parts])

    def step(chosen: np.ndarray) -> None:
        used, at = np.unique(windows[chosen], return_inverse=True)
        at = at.reshape(len(chosen), WINDOW)
        pad = used[0] == -1
        rows = used[1:] if pad else used
        local = at - 1 if pad else at
        part = Words.__new__(Words)
        part.word, part.prefix, part.length = words.word[rows], words.prefix[rows], words.length[rows]
        grams = np.repeat(gram_start[rows] - (np.cumsum(part.length) - part.length), part.length) + np.arange(part.length.sum())
        part.gram = words.gram[grams]
        inputs = net.inputs(part)
        tape: dict = {}
        z = net.logits(net.projection(inputs), local, tape)
        error = ((_sigmoid(z) - y[text[chosen]]) * balance[text[chosen]] / len(chosen)).astype(np.float32)
        grad, d_gates = net.gradients(error, tape)
        d_word = np.zeros((len(rows) + 1, 6 * HIDDEN), np.float32)
        np.add.at(d_word, local.T.reshape(-1), d_gates.reshape(-1, 6 * HIDDEN))
        d_word = d_word[:-1]
        grad |= {"wx": inputs.T @ d_word, "bx": d_word.sum(0)}
        d_inputs = d_word @ net.p["wx"].T
        for name, g in grad.items():
            seen[name] += g * g
            net.p[name] -= rate * g / np.sqrt(seen[name])
        updates = {"word": (part.word, d_inputs[:, :WORD_DIM]), "prefix": (part.prefix, d_inputs[:, WORD_DIM : WORD_DIM + PREFIX_DIM]), "gram": (part.gram, np.repeat(d_inputs[:, WORD_DIM + PREFIX_DIM :] / part.length[:, None], part.length, 0))}
        for name, (ids, g) in updates.items():
            unique, where = np.unique(ids, return_inverse=True)
            total = np.zeros((len(unique), g.shape[1]), np.float32)
            np.add.at(total, where, g)
            seen[name][unique] += total * total
            net.tables[name][unique] -= rate * total / np.sqrt(seen[name][unique])

    for epoch in range(epochs):
        # The window that decides each text, and another one of those that hold no label of their own.
        scored = all_logits() if epoch else rng.standard_normal(len(windows)) + net.tables["word"][words.word, 0].clip(0)[np.maximum(windows, 0)].max(1) * 4 if len(words) else np.zeros(len(windows))
        order = np.lexsort((-scored, text))
        deciding = order[starts[own]]
        clean = own[y[own] == 0]
        other = starts[clean] + (rng.random(len(clean)) * (starts[clean + 1] - starts[clean])).astype(np.int64)
        every = rng.permutation(np.concatenate([deciding, other]))
        for at in range(0, len(every), batch):
            step(every[at : at + batch])
    # Where does the threshold separate best what was held out?
    most = np.full(len(y), -np.inf)
    np.maximum.at(most, text, all_logits())
    test = np.flatnonzero(held_out)
    if len(set(y[test])) == 2:
        order = test[np.argsort(most[test])]
        value, truth = most[order], y[order]
        wrong = np.concatenate([[0], np.cumsum(truth)]) + np.concatenate([np.cumsum((1 - truth)[::-1])[::-1], [0]])
        best = np.flatnonzero(wrong == wrong.min())
        edges = np.concatenate([[value[0] - 1], (value[1:] + value[:-1]) / 2, [value[-1] + 1]])
        net.p["bo"] -= np.float32(edges[best[len(best) // 2]])
    return net


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, most: dict[int, int] = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample; only rows that are not held out."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(remainder(F.col("doc_id")) != 0)
    ids = []
    for label, n in most.items():
        ids += [(r["doc_id"], label) for r in known.filter(F.col("toxic") == label).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(n).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id bigint, toxic int")
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # one row of each id
    rows = sorted(((r["doc_id"], r["toxic"], r["text"] or "") for r in found), key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), r[2]))
    return [r[2] for r in rows], [r[1] for r in rows]


def score_documents(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some megabytes, whatever the corpus

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores: list[float] = []
        held, size = [], 0
        for value in batch.column(1):
            held.append(value.as_py() or "")
            size += len(held[-1])
            if size >= CHUNK:
                scores += shared.value.score(held).tolist()
                held, size = [], 0
        if held:
            scores += shared.value.score(held).tolist()
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64())})

    out = map_arrow(docs.select(docs["doc_id"].cast("bigint"), docs["text"]), batch_of, "doc_id bigint, score double", 500)
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, network: Network, bound: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``bound``."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    text_at = docs.columns.index("text")

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep: list[bool] = []
        held, size = [], 0
        for value in batch.column(text_at):
            held.append(value.as_py() or "")
            size += len(held[-1])
            if size >= CHUNK:
                keep += (shared.value.score(held) < bound).tolist()
                held, size = [], 0
        if held:
            keep += (shared.value.score(held) < bound).tolist()
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, batch_of, docs.schema, 500)


def fitted(docs: DataFrame, labels: DataFrame) -> Network:
    network = train(*labelled_sample(docs, labels))
    trim()  # the driver goes on without the sample
    return network


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, fitted(docs, table(spark, sf_dir, "labels")))
