"""Byte-pair encoding and decoding with an index of pair occurrences.

Texts are cut at ASCII white space, which no token spans; special tokens inside such a part stand
for themselves. The distinct parts of a chunk of a partition are normalised and split into words
as the tokenizer file says, and all their distinct words are merged at once: an index maps every
mergeable pair of neighbouring symbols to all its places in the chunk; the lowest active rank is
applied at all its places, from left to right, and the pairs that appear beside the new symbols
enter the lists of their own ranks. A merge of a rank only makes symbols that later ranks use,
which is checked when the file is read, so that this order gives the merges of every word one by
one. Parts of earlier chunks are remembered in bounded memory.

Files: BPE models without dropout, unknown token or word prefix, with an end of word suffix or
none, byte-level words, white space that gives no ids, and no decoder (tokens joined by blanks).

Cases: null texts are empty, with no ids and an empty decoded text; a null doc_id is kept;
repeated rows are documents of their own; an empty table gives an empty result; ids that the
vocabulary does not have are left out of decoded texts; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themeloom.llm.common import table

#: Bytes of text whose words are merged together, at least those of one text, and parts (and words of
#: parts) that are remembered, twice: those in use lately, and those before.
CHUNK, PARTS_KEPT = 8 << 20, 250_000


class Merger:
    """Merges symbols of words by the ranks of a model."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        left, right, made = (
            np.array([vocab[t] for t in side], np.int64)
            for side in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges])
        )
        rank = np.arange(len(merges))
        born = np.full(self.size, -1)
        born[made] = rank  # the last rank that makes a symbol
        if len(merges) and max((born[left] - rank).max(), (born[right] - rank).max()) >= 0:
            raise ValueError("a merge uses a symbol that a later one makes")
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank_of = key[order], rank[order]
        self.left, self.right, self.made = left, right, made

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where they do not merge."""
        if not len(self.key):
            return np.full(len(a), -1)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank_of[at], -1)

    def merge(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie end to end, and the words' ends among them."""
        n = len(symbols)
        symbols = symbols.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1  # no word is empty
        before[ends[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(symbols[at], symbols[after[at]])
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            first = np.searchsorted(rank, 0)
            rank, at = rank[first:], at[first:]
            if not len(rank):
                return
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                held = index.get(r)
                if held is None:
                    index[r] = [places]
                    heapq.heappush(active, r)
                else:
                    held.append(places)

        active: list[int] = []
        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            held = index.pop(r)
            at = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            a, b = self.left[r], self.right[r]
            # places may have changed since they were listed
            at = at[(symbols[at] == a) & (after[at] >= 0)]
            at = at[symbols[after[at]] == b]
            if not len(at):
                continue
            if a == b:  # of overlapping pairs every other one, from the left
                joined = np.r_[False, after[at[:-1]] == at[1:]]
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            symbols[at], symbols[gone] = self.made[r], -1
            beyond = after[gone]
            after[at], after[gone] = beyond, -1
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            ahead = before[at]
            enter(np.unique(np.concatenate([ahead[ahead >= 0], at[inner]])))
        stay = symbols >= 0
        return symbols[stay], np.r_[0, np.cumsum(stay)][ends]


def bytes_to_signs() -> dict[int, str]:
    """The sign of each byte in byte-level vocabularies: printable Latin-1 characters are themselves,
    the other bytes, in order, the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """A bounded memory: what is found in the older half moves to the newer one."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def new(self, keys) -> list:
        """The keys that are not remembered; the others can be read from now on."""
        keys = list(keys)
        if len(self) + len(keys) > PARTS_KEPT:
            self.old = dict(self)
            self.clear()
        out = []
        for k in keys:
            if k not in self:
                if k in self.old:
                    self[k] = self.old[k]
                else:
                    out.append(k)
        return out


class Codec:
    """Ids of texts and texts of ids, by one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("decoder"):
            raise ValueError(f"not a plain BPE file: {odd or model['type']}")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = Merger(self.vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splits = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        # symbols of bytes inside a word and at its end; signs stand for the bytes that are no printable ones
        signs = bytes_to_signs()
        self.inner, self.final = (
            np.array([self.vocab.get(signs[b] + end, -1) for b in range(256)], np.int64) for end in ("", self.suffix)
        )
        self.bytes_of = {ord(c): b for b, c in signs.items()}
        # Latin letters and marks need not go through the library's splits
        self.latin = re.compile(r"[\x21-\x7e\xa1-\u024f]+").fullmatch
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        own = len(steps) == 2 and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and not steps[1].get("use_regex")
        self.split = regex.compile(steps[0]["pattern"]["Regex"]) if own and "Regex" in steps[0].get("pattern", {}) else None
        self.words = Tokenizer.from_file(path)  # for its normaliser and its splits into words alone
        names = {i: t for t, i in {**self.vocab, **self.special}.items()}
        size = max(names) + 1
        self.tokens = pa.array([f"{names[i]} " if i in names else "" for i in range(size)], pa.large_string())
        self.numbers = pa.array([f"{i} " for i in range(size)], pa.large_string())
        # ids as little-endian 32-bit numbers
        self.parts, self.known = Remembered(), Remembered()

    def _words_of(self, part: bytes) -> list:
        """Words (their bytes) and special tokens (ids) of a part without white space."""
        out: list = []
        text = part.decode()
        for piece in self.splits.split(text) if self.special else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                normal = self.words.normalizer.normalize_str(piece) if self.words.normalizer else piece
                words = self.words.pre_tokenizer.pre_tokenize_str(normal)
                out += [w.translate(self.bytes_of).encode("latin-1") for w, _ in words]
        return out

    def _words_of_all(self, parts: list[bytes]) -> list[list]:
        """``_words_of`` each part. Latin parts without special tokens go through the normaliser and
        the file's pattern as one text with blanks between, so that the lengths of words tell their
        parts; a group in which that fails is split part by part."""
        out: list = [None] * len(parts)
        texts = [p.decode() for p in parts]
        special = self.splits.search if self.special else lambda t: None
        plain = [i for i, t in enumerate(texts) if self.latin(t) and not special(t)] if self.split else []
        for at in range(0, len(plain), 4096):
            group = plain[at : at + 4096]
            text = " ".join([texts[i] for i in group])
            normal = self.words.normalizer.normalize_str(text) if self.words.normalizer else text
            pieces, words = normal.split(" "), self.split.findall(normal)
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            if len(pieces) != len(group) or not len(last) or last[-1] != ends[-1]:
                continue
            bounds = np.searchsorted(last, ends)
            if bounds[-1] >= len(last) or (last[bounds] != ends).any():
                continue
            coded = [w.encode() for w in words]
            bounds = (bounds + 1).tolist()
            for i, a, b in zip(group, [0, *bounds], bounds):
                out[i] = coded[a:b]
        return [self._words_of(p) if o is None else o for p, o in zip(parts, out)]

    def _learn(self, parts: list[bytes]) -> None:
        """Merge the words of new parts that are not known together and remember the parts' ids."""
        lists = self._words_of_all(parts)
        words = self.known.new(w for w in dict.fromkeys(chain.from_iterable(lists)) if isinstance(w, bytes))
        signs = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        symbols = self.inner[signs]
        symbols[ends - 1] = self.final[signs[ends - 1]]
        if (symbols < 0).any():
            raise ValueError("a byte has no symbol")
        ids, ends = self.merger.merge(symbols, ends)
        laid, ends = ids.astype("<i4").tobytes(), (4 * ends).tolist()
        known = self.known
        known.update((w, laid[i:j]) for w, i, j in zip(words, [0, *ends], ends))
        known.update((i, i.to_bytes(4, "little")) for i in self.special.values())
        for p, ws in zip(parts, lists):
            self.parts[p] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the ends of the texts among them."""
        parts = [(t or "").encode().split() for t in texts]
        sizes = list(map(len, parts))
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__  # a new part gets the next number
        row = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        self._learn(self.parts.new(number))
        lists = [self.parts[w] for w in number]
        flat = np.frombuffer(b"".join(lists), "<i4")
        size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        begin = np.cumsum(size) - size
        many = size[row]
        past = np.r_[0, np.cumsum(many)]
        ids = flat[np.arange(past[-1]) + np.repeat(begin[row] - past[:-1], many)]
        return ids, past[np.cumsum([0, *sizes])]

    def joined(self, names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """For each text the names of its ids, a blank between."""
        ids = np.where((ids >= 0) & (ids < len(names)), ids, len(names))
        names = pa.concat_arrays([names, pa.array([""], names.type)])
        laid = pc.take(names, pa.array(ids))  # the names' bytes lie end to end
        offsets = np.frombuffer(laid.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(laid.buffers()[2] or b"")
        at = offsets[ends]
        return [bytes(data[a : max(a, b - 1)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        return self.joined(self.tokens, ids, ends)


@cache
def codec(path: str) -> Codec:
    """The codec of this worker process, which later tasks use again."""
    return Codec(path)


def _path(path: str | None) -> str:
    return path or public_tokenizers.path("word_bpe_49k.json")


def _by_chunks(docs: DataFrame, path: str | None, finish, schema: str) -> DataFrame:
    """``finish(codec, ids, ends)``, columns beside doc_id, of the texts of every chunk."""
    path = _path(path)

    def run(batches):
        by = codec(path)
        for b in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(b["text"]), 0)).astype(np.int64)
            chunk = np.cumsum(sizes) // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = b.slice(lo, hi - lo)
                columns = finish(by, *by.encode(part["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], ["doc_id", *(f.split()[0] for f in schema.split(", "))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of every whole text."""

    def finish(by, ids, ends):
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]

    return _by_chunks(docs, path, finish, "ids array<int>")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends of a list column, null lists as empty ones."""
    many = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(many)]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the text of every list of ids."""
    path = _path(path)

    def run(batches):
        by = codec(path)
        for b in batches:
            text = [t.decode() for t in by.decode(*_lists(b["ids"]))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids in decimal and of the text they decode to: encoding and
    decoding in one pass, so that ids need not travel."""

    def finish(by, ids, ends):
        each = by.joined(by.numbers, ids, ends), by.decode(ids, ends)
        return [pa.array(np.diff(ends), pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in each)]

    return _by_chunks(docs, path, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
