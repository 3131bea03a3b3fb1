"""Secret scans: fixed patterns, and formats learnt from what they find.

Three patterns give the base findings. Their values are the labelled credentials: a bounded sample
of them, as strings of character classes, forms a prefix tree for each kind, whose statistically
compatible states are merged (Hoeffding bound, red and blue states) into a probabilistic automaton.
Every run of at least ``LEAST`` key characters is a candidate, without the dots at its ends; of a run
that base findings touch, what they leave uncovered is. Its score is the mean log-likelihood of its format by the best automaton, less that of the background, a bigram
model of character classes over the words of all documents. It is reported, as kind ``grammar``, when the score
reaches the 5 % quantile of held-out credentials.

Cases: null texts are empty and have no findings; positions are code points; repeated rows are
scanned one by one; without labelled credentials nothing is added; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import table
from themeloom.runtime import cut

# Patterns, least lengths and order of the base kinds.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
ORDER = {"assign": 0, "access": 1, "hex": 2, "grammar": 3}

#: Credentials of a kind that train an automaton, the first in order of their hash.
CREDENTIALS = 4_000
MIN_COUNT, ALPHA = 20, 0.05
#: The least length of a labelled value, and runs of what labelled values consist of.
LEAST = min(least for *_, least in BASE)
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: Scores that a model remembers, of formats up to 64 characters.
REMEMBERED = 1 << 16
CLASSES = "dhlGUp"
SIZES = {"d": 10, "h": 6, "l": 20, "G": 6, "U": 20, "p": 6}
_TO_CLASS = str.maketrans(
    {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"),
     **dict.fromkeys("ABCDEF", "G"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U"), **dict.fromkeys("+/_=-.", "p")}
)

#: The class number of every byte; what no class has stands between words.
_OUTSIDE = len(CLASSES)
_CLASS_OF = np.array([CLASSES.index(_TO_CLASS[i]) if i in _TO_CLASS else _OUTSIDE for i in range(256)], np.int64)

_VALUES = pa.schema([("kind", pa.string()), ("value", pa.string())])
_PAIRS = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base findings, by start, then kind."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), m.end(), kind, m[group]))
    found.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return found


def uncovered(start: int, end: int, spans: list) -> list[tuple[int, int]]:
    """What spans, by start, leave of a stretch."""
    left = []
    for s, e, *_ in spans:
        if s >= end:
            break
        if e > start:
            if s > start:
                left.append((start, s))
            start = e
    return [*left, (start, end)] if start < end else left


class Automaton:
    """A probabilistic automaton from counted class strings, by merging prefix-tree states."""

    def __init__(self, strings: Counter):
        self.next: list[dict[str, int]] = [{}]
        self.seen, self.stop = [0], [0]
        self.uses: list[Counter] = [Counter()]
        for s, n in sorted(strings.items()):
            at = 0
            self.seen[0] += n
            for c in s:
                self.uses[at][c] += n
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.seen.append(0)
                    self.stop.append(0)
                    self.uses.append(Counter())
                at = self.next[at][c]
                self.seen[at] += n
            self.stop[at] += n
        self._merge()

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if n < MIN_COUNT or m < MIN_COUNT:
                continue
            slack = math.sqrt(0.5 * math.log(2 / ALPHA)) * (n**-0.5 + m**-0.5)
            if abs(self.stop[a] / n - self.stop[b] / m) > slack:
                return False
            for c in CLASSES:
                if abs(self.uses[a][c] / n - self.uses[b][c] / m) > slack:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, into: int, of: int) -> None:
        todo = [(into, of)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.seen[a] += self.seen[b]
            self.stop[a] += self.stop[b]
            self.uses[a].update(self.uses[b])
            for c, x in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], x))
                else:
                    self.next[a][c] = x

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = [(r, c, b) for r in red for c, b in sorted(self.next[r].items()) if b not in red]
            if not blue:
                break
            r, c, b = max(blue, key=lambda x: (self.seen[x[2]], -x[0]))
            home = next((x for x in red if self._alike(x, b)), None)
            if home is None:
                red.append(b)
            else:
                self.next[r][c] = home
                self._fold(home, b)
        self.states = red

    def score(self, s: str) -> float:
        """Log-likelihood of a class string, smoothed by one unseen event a state."""
        at, total, some = 0, 0.0, len(CLASSES) + 1
        for c in s:
            total += math.log((self.uses[at][c] + 1 / some) / (self.seen[at] + 1)) - math.log(SIZES[c])
            at = self.next[at].get(c, at)
        return total + math.log((self.stop[at] + 1 / some) / (self.seen[at] + 1))


class Model:
    def __init__(self, automata: list[Automaton], bigrams: dict[str, dict[str, float]], threshold: float):
        self.automata, self.bigrams, self.threshold = automata, bigrams, threshold
        self.known: dict[str, float] = {}

    def background(self, s: str) -> float:
        total, last = 0.0, "^"
        for c in s:
            total += self.bigrams[last][c] - math.log(SIZES[c])
            last = c
        return total + self.bigrams[last]["$"]

    def score(self, value: str) -> float:
        s = value.translate(_TO_CLASS)
        best = max((a.score(s) for a in self.automata), default=-math.inf)
        return (best - self.background(s)) / (len(s) + 1)

    def spans(self, text: str, base: list) -> list[tuple[int, int, str, str]]:
        """The base findings and the runs whose format is likely, by start, then kind."""
        found = list(base)
        if self.automata:
            known: dict[str, float] = self.known
            for m in RUN.finditer(text):
                for start, end in uncovered(m.start(), m.end(), base):
                    v = text[start:end].lstrip(".")
                    start, v = end - len(v), v.rstrip(".")
                    if len(v) < LEAST:
                        continue
                    s = v.translate(_TO_CLASS)
                    score = known.get(s)
                    if score is None:
                        score = self.score(v)
                        if len(known) >= REMEMBERED:
                            known.clear()
                        if len(s) <= 64:
                            known[s] = score
                    if score >= self.threshold:
                        found.append((start, start + len(v), "grammar", v))
        found.sort(key=lambda s: (s[0], ORDER[s[2]]))
        return found


def _credentials(batches):
    for batch in batches:
        rows = sorted({(k, v) for t in batch["text"].to_pylist() if t for _, _, k, v in base_spans(t)})
        yield pa.RecordBatch.from_pydict({"kind": [r[0] for r in rows], "value": [r[1] for r in rows]}, _VALUES)


def _pairs(batches):
    counts = np.zeros(_OUTSIDE * (_OUTSIDE + 2) + 1, np.int64)
    for batch in batches:
        for t in batch["text"].to_pylist():
            c = _CLASS_OF[np.frombuffer(f" {t or ''} ".encode(), np.uint8)]
            turns = np.flatnonzero(np.diff(c < _OUTSIDE)) + 1
            sizes = turns[1::2] - turns[::2]
            inside = np.flatnonzero(c < _OUTSIDE)
            c[inside[np.repeat(sizes < 4, sizes)]] = _OUTSIDE  # too short for a word
            counts += np.bincount(c[:-1] * (_OUTSIDE + 1) + c[1:], minlength=len(counts))
    counts[-1] = 0  # between words
    at = np.flatnonzero(counts)
    columns = [[(CLASSES + "^")[x] for x in at // (_OUTSIDE + 1)], [(CLASSES + "$")[x] for x in at % (_OUTSIDE + 1)], counts[at].tolist()]
    yield pa.RecordBatch.from_pydict(dict(zip("abn", columns)), _PAIRS)


def fit(docs: DataFrame, credentials: int = CREDENTIALS) -> Model:
    """The model; at most ``credentials`` values of each kind come to the driver."""
    text = docs.select("text").where("text IS NOT NULL")
    values = cut(text.mapInArrow(_credentials, "kind string, value string").distinct())
    kinds: dict[str, list[str]] = {}
    for kind, *_ in BASE:
        own = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(credentials)
        kinds[kind] = [r.value for r in own.collect()]
    pairs = text.mapInArrow(_pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = defaultdict(Counter)
    for r in pairs.collect():
        counts[r.a][r.b] += r.n
    bigrams = {}
    for a in "^" + CLASSES:
        total = sum(counts[a].values()) + len(CLASSES) + 1
        bigrams[a] = {b: math.log((counts[a][b] + 1) / total) for b in CLASSES + "$"}
    automata, held = [], []
    for own in kinds.values():
        train, rest = own[::2], own[1::2]
        if train:
            automata.append(Automaton(Counter(v.translate(_TO_CLASS) for v in train)))
            held += rest or train
    model = Model(automata, bigrams, math.inf)
    if held:
        scores = sorted(model.score(v) for v in held)
        model.threshold = max(0.0, scores[int(0.05 * len(scores))])
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the arrays ``base`` and ``spans`` of (start, end, kind), one row a document."""

    def run(batches):
        for batch in batches:
            base, spans = [], []
            for t in batch["text"].to_pylist():
                found = base_spans(t) if t else []
                every = model.spans(t, found) if t else []
                base.append([{"start": s, "stop": e, "kind": k} for s, e, k, _ in found])
                spans.append([{"start": s, "stop": e, "kind": k} for s, e, k, _ in every])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(base, _SPANS), pa.array(spans, _SPANS)], ["doc_id", "base", "spans"]
            )

    item = "array<struct<start:long,stop:long,kind:string>>"
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return need.mapInArrow(run, f"doc_id long, base {item}, spans {item}")


def redact(docs: DataFrame, model: Model, mark: str = "[secret]") -> DataFrame:
    """The documents with every finding replaced by a mark; n_chars follows where it is there."""
    columns = docs.columns

    def run(batches):
        for batch in batches:
            out = []
            for t in batch["text"].to_pylist():
                spans = model.spans(t, base_spans(t)) if t else []
                if not spans:
                    out.append(t)
                    continue
                parts, at = [], 0
                for s, e, _, _ in spans:
                    if e <= at:
                        continue
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = e
                out.append("".join(parts) + t[at:])
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, pa.string()))

    clean = docs.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
        clean = clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return clean.select(*columns)


def joined(spans: str):
    one = F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string")))
    return F.array_join(one, ",")


def report(docs: DataFrame, **fitted) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs, fit(docs, **fitted)).select(
        "doc_id",
        *[count(k) for k, *_ in BASE],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def query(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))
