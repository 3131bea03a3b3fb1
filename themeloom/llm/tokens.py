"""Ids of a public tokenizer for whole texts, with pieces of text encoded once.

A text is cut at white space that no token spans, so that the ids of the parts, joined, are the
ids of the text. Parts seen before come from a bounded memory; of the others, letters and the marks
after them go to the tokenizers library apart, as neither vocabulary has a token across. Arrow
numbers the parts of a batch and NumPy lays out their ids. A text whose white space does not allow
the cut is encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Parts that are remembered at once, twice: those in use lately, and those before.
PARTS_KEPT = 300_000

#: Texts and characters that are cut up at once.
TEXTS, CHARS = 1024, 4 << 20

#: Letters up to U+024F, then ASCII marks.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")


class Encoder:
    """ids(texts): for each text its ids, an array of ``dtype``.

    ``spaced`` is for vocabularies in which a blank belongs to the word after it; otherwise white
    space must separate words and leave no ids.
    """

    def __init__(self, path: str, spaced: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced, self.blank, self.seen, self.old = spaced, " " if spaced else "", {"": b""}, {}
        # ids that begin a word, or end one: where words are joined, these tell them apart
        vocabulary = self.tokenizer.get_vocab()
        self.edges = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edges[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if spaced else t.endswith("</w>"))]] = True
        normalizer = self.tokenizer.normalizer
        self.lower = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.marks = {"": b""}
        # a blank that ends the text or comes before other white space belongs to no word
        self.odd = re.compile(r" (?:\s|\Z)")

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 2048):
            part = self.tokenizer.encode_batch_fast(texts[at : at + 2048], add_special_tokens=False)
            out += [np.array(e.ids, self.dtype).tobytes() for e in part]
        return out

    def _joined(self, words: list[str]) -> None:
        """Remember the ids of words that, blanks between, show in the ids where each begins or ends."""
        size = self.dtype.itemsize
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            lines = [some[i : i + 64] for i in range(0, len(some), 64)]
            texts = [self.blank + " ".join(line) for line in lines]
            for line, e in zip(lines, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                edge = np.flatnonzero(self.edges[ids])
                if len(edge) != len(line):
                    self.seen.update(zip(line, self._encode([self.blank + w for w in line])))
                    continue
                ends = [*edge[1:].tolist(), len(ids)] if self.spaced else (edge + 1).tolist()
                data, begin = ids.tobytes(), 0
                for w, end in zip(line, ends):
                    self.seen[w] = data[begin * size : end * size]
                    begin = end

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts; those of new ones are remembered."""
        seen, old = self.seen, self.old
        out = list(map(seen.get, parts))
        lost = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in lost:
            ids = old.get(parts[i])
            if ids is None:
                new.append(parts[i])
            else:
                seen[parts[i]] = ids
        if len(seen) + len(new) > PARTS_KEPT:  # what was in use lately is found in the older half
            old = self.old = seen
            seen = self.seen = {"": b"", **{w: old[w] for w in parts if w in old}}
        made, words, alone = [], set(), []
        for w in new:
            found = _WORD.fullmatch(w)
            if not found:
                alone.append(w)
                continue
            core, tail = found.groups()
            if self.lower and core.isascii():
                core = core.lower()
            if core not in seen:
                if core in old:
                    seen[core] = old[core]
                else:
                    words.add(core)
            if core != w:
                made.append((w, core, tail))
        seen.update(zip(alone, self._encode([self.blank + w for w in alone])))
        self._joined(list(words))
        if len(self.marks) > PARTS_KEPT // 10:
            self.marks = {"": b""}
        tails = list({tail for _, _, tail in made if tail not in self.marks})
        self.marks.update(zip(tails, self._encode(tails)))
        marks = self.marks
        for w, core, tail in made:
            seen[w] = seen[core] + marks[tail]
        for i in lost:
            out[i] = seen[parts[i]]
        return out

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """ids of texts that may be cut."""
        column = pa.array(texts, pa.large_string())
        split = pc.split_pattern(column, " ") if self.spaced else pc.ascii_split_whitespace(column)
        first = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        ids = self._known(coded.dictionary.to_pylist())
        spots = coded.indices.to_numpy()
        if self.spaced:  # the first part has no blank before it
            spots = spots.copy()
            spots[first[:-1]] = np.arange(len(ids), len(ids) + len(texts))
            ids += self._encode([w.partition(" ")[0] for w in texts])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        sizes = size[spots]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(begin[spots] - ends[:-1], sizes)
        at += np.arange(ends[-1])
        every = np.frombuffer(b"".join(ids), self.dtype)[at]
        return np.split(every, ends[first[1:-1]])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if self.spaced and self.odd.search(t)]
        odd = set(whole)
        parts = [i for i in range(len(texts)) if i not in odd]
        if parts:
            for i, ids in zip(parts, self._cut([texts[i] for i in parts])):
                out[i] = ids
        for i, ids in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = np.frombuffer(ids, self.dtype)
        return out


@cache
def encoder(path: str, spaced: bool) -> Encoder:
    """The encoder of this worker process, which later tasks use again. A task has one core: the
    library's threads would only wait for each other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, spaced)


def encoded(batch_texts: list, by: Encoder, end: int):
    """uint32 arrays of the ids of each text (null: empty) and the end id."""
    tail = np.array([end], "<u4")
    held, size = [], 0
    for i, t in enumerate(batch_texts, 1):
        held.append(t or "")
        size += len(held[-1])
        if len(held) == TEXTS or size >= CHARS or i == len(batch_texts):
            for ids in by.ids(held):
                yield np.concatenate([ids.astype("<u4"), tail])
            held, size = [], 0
