"""Personal data: base patterns, and candidates chosen by gradient-boosted trees.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay. Beyond them, high-recall generators
propose overlapping spans: masked or spaced addresses, numbers without a plus sign, other separators, incomplete forms,
and secrets: assigned values and long tokens that hold a digit. Secrets are a kind of their own, beside the four.
Boosted trees, written and trained in numpy on the driver, judge every candidate by format and context; a candidate is
selected if its score reaches the threshold of its kind, which is calibrated on held-out candidates for a precision of
``PRECISION``; a kind whose held-out candidates never reach it selects nothing.

Training: a bounded sample of at most ``SAMPLE`` documents that hold a digit or an @ (those whose doc_id has the smallest
MD5). Examples come from three places. Base spans are positive, also rewritten in the masked forms that the base patterns
miss; candidates of the four kinds that are no base spans are negative. And each sampled text gets labelled forms put
between its words, made by a fixed rule with a fixed seed (``labelled_form``): credentials and masked forms as positive
ones, and what resembles them (checksums, commits, identifiers, versions, dates, order numbers, settings) as negative
ones. Secrets have no labels in the texts themselves, so they are learnt from these forms alone. Every third document is
held out for the thresholds.

Every pass over a text takes time in proportion to its length, also over long runs of digits.

Defined results: null and empty texts have no spans (counts 0, empty spans); rows are judged each, so repeated rows and
ids repeat; a null doc_id stays null; of overlapping added candidates the better one stays; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm.common import map_arrow, table

KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
SAMPLE = 2000
PRECISION = 0.995
#: Held-out positives that a threshold needs at least.
LEAST_POSITIVES = 20
#: Labelled forms that each sampled text gets.
FORMS = 3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_digits = re.compile(r"[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if place % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the email pattern; each @ is looked at once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := _domain.match(text, at + 1)):
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def addresses(text: str) -> list[Span]:
    """Leftmost non-overlapping runs of four dotted numbers, all at most 255."""
    out = []
    for chain in _dotted.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts = [(x.start() + chain.start(), x.end() + chain.start(), x[0]) for x in _digits.finditer(chain[0])]
        for at in range(0, len(parts) - 3, 4):
            if all(len(x[2].lstrip("0")) <= 3 and int(x[2].lstrip("0") or "0") <= 255 for x in parts[at : at + 4]):
                out.append((parts[at][0], parts[at + 3][1]))
    return out


def _numbers(pattern: re.Pattern, text: str, least: int, most: int) -> Iterator[tuple[Span, str]]:
    for found in pattern.finditer(text):
        digits = "".join(_digits.findall(found[0]))
        if least <= len(digits) <= most:
            yield found.span(), digits


def base_spans(text: str) -> dict[str, list[Span]]:
    return {
        "email": emails(text),
        "ip": addresses(text),
        "card": [span for span, digits in _numbers(_card, text, 13, 19) if luhn(digits)],
        "phone": [span for span, _ in _numbers(_phone, text, 9, 15)],
    }


_masked_at = re.compile(r"@|[\[(]\s?at\s?[\])]", re.IGNORECASE)
#: What every text with a span holds: each generator needs a digit or one of the signs for "at".
_any = re.compile(rf"[0-9]|{_masked_at.pattern}", re.IGNORECASE)
_after_at = re.compile(r"\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]+)*", re.IGNORECASE)
_loose = {
    "ip": re.compile(r"[0-9]{1,3}(?:\s?[.:,]\s?[0-9]{1,3}){3,7}"),
    "card": re.compile(r"[0-9](?:[ ._\-/]{0,2}[0-9]){11,19}"),
    "phone": re.compile(r"(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./\-]{0,2}\(?[0-9]{2,5}\)?){2,4}"),
}


#: A value after a colon or an equals sign, and a long run of letters, digits, dashes and underscores.
_assigned = re.compile(r"[=:]\s?[\"']?([^\s\"'<>;,=:@]{8,})")
_token = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{16,})")


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Overlapping spans that may be personal data: (kind, start, end)."""
    for at in _masked_at.finditer(text):
        start = stop = at.start() - (at.start() > 0 and text[at.start() - 1].isspace())
        while start and text[start - 1] in LOCAL:
            start -= 1
        if start < stop and (after := _after_at.match(text, at.end())):
            yield "email", start, after.end()
    for kind, pattern in _loose.items():
        for found in pattern.finditer(text):
            yield kind, found.start(), found.end()
    for pattern in (_assigned, _token):
        for found in pattern.finditer(text):
            if _digits.search(found[1]):
                yield "secret", *found.span(1)


_contact = re.compile(r"tel|phone|call|fax|mail|contact|reach|whatsapp|host|server|addr|card|visa|credit|amex|\bip\b", re.IGNORECASE)
_secret = re.compile(r"token|secret|passw|key|hash|sha|md5|version|isbn|order|invoice|\bno\b", re.IGNORECASE)
_credential = re.compile(r"token|secret|passw|pwd|api.?key|access|auth|bearer|credential|private", re.IGNORECASE)
_reference = re.compile(r"hash|sha|md5|sum|digest|commit|uuid|guid|version|isbn|order|invoice|rev|build|\bid\b", re.IGNORECASE)
#: Well-known beginnings of issued keys.
_issued = re.compile(r"AKIA|ASIA|gh[pousr]_|sk_(?:live|test)_|xox[abp]-|AIza|glpat-")
_turns = re.compile(r"[0-9][A-Za-z]|[A-Za-z](?=[0-9])")
FEATURES = 34


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its context of a few characters."""
    span = text[start:end]
    digits = "".join(_digits.findall(span))
    parts = _digits.findall(span)
    lead = text[max(0, start - 24) : start]
    before, after = text[start - 1 : start], text[end : end + 1]
    where = _masked_at.search(span)
    tail = span[where.end() :] if where else ""
    edge = lambda c: 0 if not c or c.isspace() else 2 if c.isalnum() else 1
    return [
        EVERY.index(kind),
        len(span),
        len(digits),
        sum(c.isalpha() for c in span),
        sum(c.isspace() for c in span),
        span.count("."),
        span.count("-"),
        span.count("(") + span.count("["),
        span.startswith("+"),
        len(parts),
        max((min(int(x[:4]), 9999) for x in parts), default=0),
        min((len(x) for x in parts), default=0),
        max((len(x) for x in parts), default=0),
        bool(digits) and luhn(digits),
        edge(before),
        edge(after),
        "@" in span,
        bool(where),
        tail.count(".") + tail.lower().count("dot"),
        len(re.split(r"[.\])]\s?", tail)[-1]) if tail else 0,
        bool(_contact.search(lead)),
        bool(_secret.search(lead)),
        len(set(digits)),
        len(set(re.findall(r"[^0-9A-Za-z]", span))),
        bool(_credential.search(lead)),
        bool(_reference.search(lead)),
        bool(_issued.match(span)),
        before in "=\"'" and before != "",
        lead.rstrip("\"' ")[-1:] in ("=", ":"),
        sum(c.isupper() for c in span),
        sum(c in "0123456789abcdefABCDEF" for c in span) / max(1, len(span)),
        len(_turns.findall(span)) / max(1, len(span)),
        len(set(span)),
        span.count("/") + span.count("_"),
    ]


class Boosting:
    """Gradient boosting of small regression trees on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.depth, self.trees = depth, []
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.start = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])] if len(y) else []
        for _ in range(trees if len(y) else 0):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(depth):
                width = 1 << level
                best = [(1e-9, 0, np.inf)] * width
                whole = [(np.bincount(node, v, width)) for v in (g, h)]
                base = whole[0] ** 2 / (whole[1] + ridge)
                for f, edges in enumerate(cuts):
                    place = np.searchsorted(edges, x[:, f], side="left") + node * (len(edges) + 1)
                    left = [np.bincount(place, v, width * (len(edges) + 1)).reshape(width, -1).cumsum(1)[:, :-1] for v in (g, h)]
                    gain = left[0] ** 2 / (left[1] + ridge) + (whole[0][:, None] - left[0]) ** 2 / (whole[1][:, None] - left[1] + ridge) - base[:, None]
                    at = gain.argmax(1)
                    for k in range(width):
                        if gain[k, at[k]] > best[k][0] + 1e-9:
                            best[k] = (float(gain[k, at[k]]), f, float(edges[at[k]]))
                splits.append([b[1:] for b in best])
                feature, edge = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                node = node * 2 + (x[np.arange(len(y)), feature[node]] > edge[node])
            value = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
            self.trees.append((splits, value))
            z += value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in splits:
                feature, edge = np.array([s[0] for s in level]), np.array([s[1] for s in level])
                node = node * 2 + (x[rows, feature[node]] > edge[node])
            z += value[node]
        return 1 / (1 + np.exp(-z))


def _overlap(a: Span, b: Span) -> bool:
    return a[0] < b[1] and b[0] < a[1]


def _rewritten(text: str, kind: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """The text with a base span in forms that the base patterns miss, and the span there."""
    span = text[start:end]
    forms = []
    if kind == "email":
        name, _, domain = span.rpartition("@")
        forms = [f"{name} [at] {domain}", f"{name}(at){domain.replace('.', '(dot)')}", f"{name} @ {domain}"]
    elif kind == "phone":
        digits = "".join(_digits.findall(span))[-10:]
        forms = [f"({digits[:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[:-7]}-{digits[-7:-4]}-{digits[-4:]}"]
    elif kind == "card":
        digits = "".join(_digits.findall(span))
        forms = [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    for form in forms:
        yield text[:start] + form + text[end:], start, start + len(form)


def _drawn(rng: random.Random, letters: str, least: int, most: int) -> str:
    """Random characters, digits among them."""
    out = rng.choices(letters, k=rng.randint(least, most))
    out[rng.randrange(1, len(out))] = rng.choice(string.digits)
    return "".join(out)


def labelled_form(rng: random.Random) -> tuple[str, str, str, bool]:
    """(text before, form, kind, is it personal data?): a made-up form of a credential, or of what resembles one."""
    hexes, mixed, capitals = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    number = lambda n: "".join(rng.choices(string.digits, k=n))
    draw = rng.random()
    if draw < 0.3:
        name = rng.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key"))
        value = rng.choice((lambda: _drawn(rng, hexes, 12, 64), lambda: _drawn(rng, mixed, 10, 48), lambda: _drawn(rng, mixed + "!#$%+/_-", 8, 40)))()
        return rng.choice((name, name, name.upper())) + rng.choice(("=", " = ", ": ", ":", '="', ' = "', ": '")), value, "secret", True
    if draw < 0.45:
        issued = rng.choice((lambda: "AKIA" + _drawn(rng, capitals, 16, 16), lambda: "ghp_" + _drawn(rng, mixed, 36, 36), lambda: "sk_live_" + _drawn(rng, mixed, 24, 24), lambda: "AIza" + _drawn(rng, mixed + "_-", 35, 35)))
        return rng.choice(("", "", "key ", "key: ", "use ")), issued(), "secret", True
    if draw < 0.7:
        name = rng.choice(("commit", "sha256", "md5", "checksum", "digest", "build", "uuid", "id", "revision", "hash", "etag"))
        value = rng.choice((lambda: _drawn(rng, hexes, 16, 64), lambda: "-".join(_drawn(rng, hexes, n, n) for n in (8, 4, 4, 4, 12)), lambda: number(rng.randint(16, 30))))
        return name + rng.choice((" ", "=", ": ", "-", " = ")), value(), "secret", False
    if draw < 0.85:
        value = rng.choice(
            (lambda: f"file_name_{number(2)}_of_{number(4)}", lambda: f"20{number(2)}-0{rng.randint(1, 9)}-1{number(1)}T1{number(1)}-{number(2)}-{number(2)}", lambda: "chapter-" + number(2) + "-" + "".join(rng.choices(string.ascii_lowercase, k=9)))
        )
        return rng.choice(("", "see ", "in ", "name: ", "date=")), value(), "secret", False
    if draw < 0.93:
        return rng.choice(("page=", "width: ", "size = ", "version: ", "port=", "time: ", "token: ", "key: ")), f"{rng.choice(('v', 'n', 'row', 'step', 'part'))}{number(2)}{rng.choice(('.', '-'))}{number(5)}", "secret", False
    return rng.choice(("order ", "invoice no ", "isbn ", "part ")), rng.choice((number(10), f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"{number(4)}-{number(4)}")), "phone", False


class Detector:
    """The trees and the threshold of each kind."""

    def __init__(self, texts: list[str], precision: float = PRECISION):
        rng = random.Random(5)
        x, y, document = [], [], []

        def example(at: int, text: str, kind: str, start: int, end: int, label: bool) -> None:
            x.append(features(text, kind, start, end))
            y.append(label)
            document.append(at)

        for at, text in enumerate(texts):
            base = base_spans(text)
            for kind, start, end in candidates(text):
                if kind == "secret":
                    continue  # no labels
                hit = any(_overlap((start, end), s) for s in base[kind])
                # What overlaps a base span of another kind is decided already; it is no example.
                if hit or not any(_overlap((start, end), s) for spans in base.values() for s in spans):
                    example(at, text, kind, start, end, hit)
            for kind, spans in base.items():
                for start, end in spans[:2]:
                    around = text[max(0, start - 100) : end + 100]
                    for form, s, e in _rewritten(around, kind, start - max(0, start - 100), end - max(0, start - 100)):
                        for k, a, b in candidates(form):
                            if k == kind and a < e and s < b:
                                example(at, form, k, a, b, abs(a - s) + abs(b - e) <= 2)
            for _ in range(FORMS):
                before, form, kind, label = labelled_form(rng)
                cut = text.find(" ", rng.randrange(len(text) + 1)) + 1 if text else 0
                left = text[max(0, cut - 60) : cut] + before
                held, s, e = f"{left}{form}{rng.choice((' ', ' ', '. ', chr(10)))}{text[cut : cut + 60]}", len(left), len(left) + len(form)
                for k, a, b in candidates(held):
                    if a < e and s < b and (k == kind or not label):
                        example(at, held, k, a, b, label and abs(a - s) + abs(b - e) <= 2)
        xs, ys = np.array(x, float).reshape(-1, FEATURES), np.array(y, float)
        held_out = np.array(document, np.int64) % 3 == 2
        self.trees = Boosting(xs[~held_out], ys[~held_out], trees=60)
        self.threshold = {kind: self._calibrated(xs[held_out], ys[held_out], kind, precision) for kind in EVERY}

    def _calibrated(self, x: np.ndarray, y: np.ndarray, kind: str, precision: float) -> float:
        own = x[:, 0] == EVERY.index(kind)
        scores, truth = self.trees.score(x[own]), y[own]
        order = np.argsort(-scores, kind="stable")
        scores, right = scores[order], truth[order].cumsum()
        good = (right / np.arange(1, len(order) + 1) >= precision) & (right >= LEAST_POSITIVES)
        # All candidates of one score are selected together, so a threshold stands at the last of them.
        good &= np.append(scores[1:] < scores[:-1], True) if len(scores) else good
        return max(0.5, float(scores[np.flatnonzero(good)[-1]])) if good.any() else 2.0

    def added(self, text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
        """Selected candidates that overlap no base span and no better candidate."""
        taken = sorted(s for spans in base.values() for s in spans)
        found = [c for c in dict.fromkeys(candidates(text)) if self.threshold[c[0]] <= 1]
        if taken and found:
            starts, ends = np.array([s for s, _ in taken]), np.maximum.accumulate(np.array([e for _, e in taken]))
            found = [c for c in found if not (i := np.searchsorted(starts, c[2])) or ends[i - 1] <= c[1]]
        if not found:
            return {}
        scores = self.trees.score(np.array([features(text, *c) for c in found], float))
        good = sorted((-s, c[1], c[2], c[0]) for s, c in zip(scores, found, strict=True) if s >= self.threshold[c[0]])
        out: dict[str, list[Span]] = {}
        used = np.zeros(0, np.int64)
        for _, start, end, kind in good:
            inside = used[(used >= start) & (used < end)] if len(used) else used
            if not len(inside):
                out.setdefault(kind, []).append((start, end))
                used = np.append(used, np.arange(start, end))
        return out


def listed(spans: dict[str, list[Span]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in kinds for s, e in sorted(spans.get(kind, ())))


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, end = [], 0
    for start, stop, kind in sorted((s, e, kind) for kind, found in spans.items() for s, e in found):
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def train(docs: DataFrame, sample: int = SAMPLE) -> Detector:
    """A detector from a bounded sample of the documents that hold a digit or an @."""
    rows = max(1, docs.count())
    key = F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")))
    # About ten times the sample passes this bound, so that few texts travel to find the smallest keys.
    bound = f"{min(0xFFFFFFFF, int(0x100000000 * min(1.0, 10 * sample / rows))):08x}"
    held = docs.select(docs["doc_id"], docs["text"], key.alias("k")).filter(F.substring("k", 1, 8) <= bound).filter(F.rlike("text", F.lit("[0-9@]")))
    texts = [r["text"] for r in held.orderBy("k", "text").limit(sample).select("text").collect()]
    return Detector(texts)


def find_personal_data(docs: DataFrame, detector: Detector, redact: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (of the four kinds), secrets and, with ``redact``, the redacted text."""

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans, secrets, texts = {kind: [] for kind in KINDS}, [], [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text) if _any.search(text) else {}
            every = {kind: [*base.get(kind, ())] for kind in EVERY}
            if base:
                for kind, more in detector.added(text, base).items():
                    every[kind] += more
            for kind in KINDS:
                counts[kind].append(len(base.get(kind, ())))
            digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(every))
            secrets.append(listed(every, ("secret",)))
            texts.append(redacted(text, every) if redact else None)
        columns = {"doc_id": batch.column(0)} | {f"n_{kind}": pa.array(n, pa.int64()) for kind, n in counts.items()}
        columns |= {"base_sha256": digests, "spans": spans, "secrets": secrets} | ({"redacted": texts} if redact else {})
        return pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, secrets string"
    return map_arrow(docs.select(docs["doc_id"].cast("bigint"), docs["text"]), batch_of, schema + (", redacted string" if redact else ""), 500)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents: one row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, train(docs), redact=False)
