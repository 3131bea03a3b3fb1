"""Language of whole texts by Viterbi over word scores.

Words are letter runs in lower case. The script of a word narrows the candidates to languages that
write at least 0.5 % of their training letters in it. A word's score for a language is the sum of
the log-likelihoods of its hashed character n-grams (1 to 4, with word ends), relative to the best
language and at least ``CLIP``. The most likely path through all words of the text, with a penalty
for each change of language, labels spans; the text's language has the most letters in its spans,
its score is their share.

Training takes at most ``SAMPLE`` labelled documents, whole, the first in order of the hash of
their id; the table of n-gram buckets has a fixed number of rows.

Cases: a text that is null or without letters is ``und`` with score 0 and no spans; ties go to the
language that is first in order; words in a script that no language writes count for none of them
and keep the path as it is; without training rows every text is ``und``; repeated rows are labelled
one by one; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import table

SAMPLE = 20_000
BUCKETS, GRAMS = 1 << 15, 4
PENALTY, CLIP, SHARE, CLOSED = 8.0, -6.0, 0.005, -10_000.0
WORDS_KEPT = 300_000
_WORD = re.compile(r"[^\W\d_]+")

# First and last code point of the blocks of a script.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul jamo", 0x1100, 0x11FF),
    ("latin more", 0x1E00, 0x1EFF), ("greek more", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
_FIRST = [s[1] for s in SCRIPTS]


def script(word: str) -> int:
    """Number of the script of a word's first letter; the count of scripts if none has it."""
    c = ord(word[0])
    i = bisect_right(_FIRST, c) - 1
    return i if i >= 0 and c <= SCRIPTS[i][2] else len(SCRIPTS)


def grams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from 1: the buckets of all n-grams of the words, and the word of each, in order."""
    lens = np.array([len(w) + 2 for w in words])
    char = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lens)
    out, h = [], np.zeros(len(char), np.uint64)
    for n in range(1, GRAMS + 1):
        end = len(char) - n + 1
        if end <= 0:
            break
        h = (h[:end] * np.uint64(1_000_003) + char[n - 1 :]) & np.uint64(0xFFFFFFFF)
        own = word[:end] == word[n - 1 :]
        bucket = (h * np.uint64(2_654_435_761) + np.uint64(n)) % np.uint64(4_294_967_291) % np.uint64(BUCKETS)
        out.append((bucket[own].astype(np.int64), word[:end][own]))
    return out


def _train(batches):
    """(lang, at, n): n-gram counts, and letters by script at BUCKETS + script."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
    for lang, seen in words.items():
        counts = np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64)
        every = list(seen)
        for at in range(0, len(every), 50_000):
            part = every[at : at + 50_000]
            n = np.array([seen[w] for w in part])
            for bucket, word in grams(part):
                counts[:BUCKETS] += np.bincount(bucket, n[word], BUCKETS).astype(np.int64)
            letters = n * np.array([len(w) for w in part])
            counts[BUCKETS:] += np.bincount([script(w) for w in part], letters, len(SCRIPTS) + 1).astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "at": pa.array(at), "n": pa.array(counts[at])})


class Model:
    """Languages in order, their n-gram scores and the candidates of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        g = counts[:BUCKETS] + 0.05
        self.scores = np.log(g / g.sum(axis=0)).astype(np.float32)
        letters = counts[BUCKETS:]
        self.open = letters >= np.maximum(1, SHARE * letters.sum(axis=0))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on (doc_id, text, lang) rows whose lang is not null."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    some = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the bound of the sample is the bound of this side
    known = known.join(F.broadcast(some), known.doc_id.eqNullSafe(some.doc_id), "left_semi")
    got = known.select("text", "lang").mapInArrow(_train, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    rows = got.toArrow()
    names = rows["lang"].to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(langs)))
    column = {x: i for i, x in enumerate(langs)}
    counts[rows["at"].to_numpy(), [column[x] for x in names]] = rows["n"].to_numpy()
    return Model(langs, counts)


class Labeller:
    """Word scores, kept for words seen before, and the path through texts."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows = np.zeros((0, len(model.langs)), np.float32)

    def index(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.at)
        if not new:
            return
        if len(self.at) + len(new) > WORDS_KEPT:
            self.at, self.rows = {}, self.rows[:0]
            new = sorted(words)
        m, block = self.model, []
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            s = np.zeros((len(part), len(m.langs)))
            for bucket, word in grams(part):
                begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
                if len(word):
                    s[word[begin]] += np.add.reduceat(m.scores[bucket], begin, axis=0)
            open_ = m.open[[script(w) for w in part]]
            none = ~open_.any(axis=1)
            best = np.where(open_, s, -np.inf).max(axis=1, keepdims=True, initial=-np.inf)
            s = np.where(open_, np.maximum(s - np.where(np.isfinite(best), best, 0), CLIP), CLOSED)
            s[none | np.array([not any(map(str.isalpha, w)) for w in part])] = 0
            block.append(s.astype(np.float32))
        self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, *block])

    def paths(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language of every word of every text.

        Where one language is best in total and no other gains more than the penalty over it on
        any stretch of words, every change costs at least what it gains: that language is the best
        path. Other texts go through the steps side by side, those of like length together, so
        that memory is bounded by the words in hand.
        """
        if not self.model.langs:
            return [np.zeros(0, np.int64) for _ in texts]
        self.index({w for t in texts for w in t})
        get = self.at.__getitem__
        ids = [np.fromiter(map(get, t), np.int32, len(t)) for t in texts]
        out, todo = [], []
        for i, own in enumerate(ids):
            out.append(self._one(own))
            if out[-1] is None:
                todo.append(i)
        todo.sort(key=lambda i: len(ids[i]))
        lo = 0
        while lo < len(todo):
            hi = lo + 1
            while hi < len(todo) and (hi - lo + 1) * len(ids[todo[hi]]) <= 400_000:
                hi += 1
            for i, p in zip(todo[lo:hi], self._group([ids[i] for i in todo[lo:hi]])):
                out[i] = p
            lo = hi
        return out

    def _one(self, ids: np.ndarray) -> np.ndarray | None:
        """The best path if it has one language, else nothing."""
        s = self.rows[ids].astype(np.float64)
        best = int(s.sum(axis=0).argmax())
        run = np.zeros((len(ids) + 1, s.shape[1]))
        np.cumsum(s - s[:, best, None], axis=0, out=run[1:])
        if (run - np.minimum.accumulate(run, axis=0)).max() > PENALTY:
            return None
        return np.full(len(ids), best, np.int64)

    def _group(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        lens = np.array([len(t) for t in texts])
        steps, k = int(lens.max()), len(self.model.langs)
        ids = np.zeros((steps, len(texts)), np.int32)
        for j, t in enumerate(texts):
            ids[: len(t), j] = t
        score = self.rows[ids[0]]
        came = np.zeros((steps, len(texts), k), np.int16 if k > 127 else np.int8)
        lanes, own = np.arange(len(texts)), np.arange(k, dtype=came.dtype)
        for t in range(1, steps):
            live = int(np.searchsorted(lens, t, "right"))  # lengths ascend: lanes from here on have word t
            s = score[live:]
            top = s.argmax(axis=1)
            jump = s[lanes[: len(s)], top] - PENALTY
            change = jump[:, None] > s
            came[t, live:] = np.where(change, top[:, None], own)
            score[live:] = np.where(change, jump[:, None], s) + self.rows[ids[t, live:]]
        path = np.zeros((steps, len(texts)), np.int64)
        at = score.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            live = int(np.searchsorted(lens, t, "right"))
            path[t, live:] = at[live:]
            at[live:] = came[t, lanes[live:], at[live:]]
        return [path[: lens[j], j] for j in range(len(texts))]


def _spans(path: np.ndarray, langs: list[str]) -> list[dict]:
    if not len(path):
        return []
    cut_at = np.flatnonzero(np.diff(path)) + 1
    starts, stops = [0, *cut_at.tolist()], [*cut_at.tolist(), len(path)]
    return [{"start": a, "stop": b, "lang": langs[path[a]]} for a, b in zip(starts, stops)]


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans of word numbers (start, stop, lang)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        labeller = Labeller(model)
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                texts = [_WORD.findall(t.lower()) if t else [] for t in batch["text"].to_pylist()]
                texts = [[w for w in t if w.isalpha() or any(map(str.isalpha, w))] for t in texts]
                preds, scores, spans = [], [], []
                for words, path in zip(texts, labeller.paths(texts)):
                    if not len(path):
                        preds.append("und"), scores.append(0.0), spans.append([])
                        continue
                    letters = np.bincount(path, [len(w) for w in words], len(model.langs))
                    best = int(letters.argmax())
                    preds.append(model.langs[best])
                    scores.append(float(letters[best] / letters.sum()))
                    spans.append(_spans(path, model.langs))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return need.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:long,stop:long,lang:string>>")


def held_out():
    """Whether a document takes no part in training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return label(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
