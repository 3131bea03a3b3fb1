"""Collocations, periodic runs and the pair-index encoder against brute force, and their odd cases."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from themeloom.llm import collocations, pair_merges, periods

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, node string, next string, n long, f long, ids int, runs string, start int, words string"
LONG = " ".join(f"w{i % 611}" for i in range(25_000)) + " " + " ".join(f"v{i * i % 4001}" for i in range(25_000))
ODD = [
    (1, None, None), (2, "", "en"), (3, " \t\n ", "en"), (4, LONG, "en"), (5, "ha " * 3_000, None), (6, "ha ha. Ha,ha", "und"),
    (None, "no id here, no id here", "en"), (7, "twice the same row", "en"), (7, "twice the same row", "en"), (2**62, "É é x A\x0bB <|endoftext|>\U0001F600", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "x", 1, 1, 1, "x", 1, "x") for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["lang"].to_pylist()))


def rows(df):
    return [tuple(r) for r in df.collect()]


# collocations --------------------------------------------------------------------------------


def brute_phrases(docs, least=10, share=50, top=2000):
    f = collections.defaultdict(collections.Counter)
    for _, text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for i in range(len(w)):
                for k in (1, 2, 3):
                    if i + k <= len(w):
                        f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, of in f.items():
        n = sum(v for p, v in of.items() if len(p) == 1)
        longer = collections.Counter()
        for p, v in of.items():
            if len(p) == 3 and v >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], v)
        found = []
        for p, a in of.items():
            if len(p) == 1 or a < least or 100 * longer[p] >= share * a and longer[p]:
                continue
            cuts = [(10**6 * a * a // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_phrases_equal_brute_force(spark, docs, texts, odd):
    assert sorted(rows(collocations.collocations(docs, 4, 50, 300))) == brute_phrases(texts, 4, 50, 300)
    assert sorted(rows(collocations.collocations(odd, 3, 80, 40, chunk=40))) == brute_phrases(ODD, 3, 80, 40)


def test_phrases_of_repeated_passages(spark):
    """Passages that repeat become long paths; pieces enter, leave and cross them."""
    rng = random.Random(5)
    passages = [[f"p{k}x{i}" for i in range(40)] for k in range(3)] + [["ring", "of"] * 12, ["a"] * 9, ["x", "y", "z", "x", "y"]]
    made = []
    for i in range(60):
        text = []
        for _ in range(4):
            p = rng.choice(passages)
            lo = rng.choice([0, 0, rng.randrange(len(p))])
            text.append(" ".join(p[lo : rng.choice([len(p), rng.randrange(lo, len(p) + 1)])] + [rng.choice(["the", "of", "."])]))
        made.append((i, rng.choice([" ", ". "]).join(text), rng.choice(["en", "en", "de"])))
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    for least, share in ((2, 50), (5, 100), (10, 1)):
        assert sorted(rows(collocations.collocations(df, least, share, 5000, chunk=200))) == brute_phrases(made, least, share, 5000)


def test_paths_are_compacted(spark):
    df = spark.createDataFrame([(i, "out we go " + " ".join(f"q{j}" for j in range(90)) + f" end{i}", "en") for i in range(5)], "doc_id long, text string, lang string")
    _, _, edges = collocations.flows(df, 3)
    paths, inner = collocations.compacted(edges)
    assert [len(r.words) for r in paths.collect()] == [93] and inner.count() == 90


def test_large_products_are_exact(spark):
    big = 3 * 10**9 + 7
    left, right = big + 10**10, 3 * big + 5
    words = spark.createDataFrame([("en", "a", left), ("en", "b", right)], "lang string, word string, f long")
    pairs = spark.createDataFrame([("en", "a b", big)], "lang string, node string, f long")
    edges = spark.createDataFrame([], "lang string, node string, next string, n long, f long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "flows", lambda docs, least, chunk: (words, pairs, edges))
        got = rows(collocations.collocations(words))
    assert got == [("en", 1, "a b", big, left, right, left + right, 10**6 * big * big // (left * right))]


def test_blocks_of_any_size(spark, docs, texts, monkeypatch):
    whole = sorted(rows(collocations.collocations(docs, 4)))
    monkeypatch.setattr(collocations.flows, "__defaults__", (300, 1 << 14))
    monkeypatch.setattr(collocations.collocations, "__defaults__", (4, 50, 2000, 300))
    assert sorted(rows(collocations.collocations(docs))) == whole == brute_phrases(texts, 4)


def test_phrases_of_nothing(none):
    assert rows(collocations.collocations(none)) == []
    with pytest.raises(ValueError):
        collocations.collocations(none, share=120)


# periodic runs -------------------------------------------------------------------------------


def brute_runs(w, least=12):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                part = w[i : j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_numbers():
    rng = random.Random(1)
    for _ in range(1500):
        k, x, n = rng.choice([1, 2, 2, 3, 4]), [], rng.randint(0, 90)
        if rng.random() < 0.4:
            x = [rng.randrange(k) for _ in range(n)]
        while len(x) < n:
            x += [rng.randrange(k) for _ in range(rng.randint(1, 15))] * rng.randint(1, 4)
            x = x[: len(x) - rng.randint(0, 2)]
        least = rng.choice([2, 5, 12])
        got = [tuple(map(int, r)) for r in periods.runs(np.array(x, np.int64), least)]
        assert got == brute_runs(x, least), x


def brute_period_row(doc_id, text):
    w = re.findall("[^ \t-\r]+", text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    text = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(found), *best, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()


def test_runs_equal_brute_force(spark, monkeypatch):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    some = [(i, x) for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()) if len(x or "") < 8_000]
    some += [r[:2] for r in ODD if r[0] != 4]
    monkeypatch.setattr(periods, "WORDS", 700)
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = rows(periods.report(periods.periodic_runs(periods.with_repeats(df))))
    assert sorted(map(str, got)) == sorted(str(brute_period_row(*r)) for r in some)
    assert sum(r[1] > 0 for r in got) > 60


def test_run_cases(odd, none):
    found = {r.doc_id: r for r in periods.periodic_runs(odd).collect()}
    assert len(rows(periods.periodic_runs(odd))) == len(ODD)
    assert [tuple(r) for r in found[4].runs][0] == (0, 25_000, 611)
    assert [tuple(r) for r in found[5].runs] == [(0, 3_000, 1)] and found[5].collapsed == "ha"
    assert found[1].runs == found[2].runs == found[3].runs == [] and found[1].collapsed == ""
    assert found[7].collapsed == "twice the same row"
    assert rows(periods.report(periods.periodic_runs(none))) == []


# pair index ----------------------------------------------------------------------------------


@functools.cache
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_bpe(text):
    t = library()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_encoder_equals_library(spark, docs, texts, odd):
    rng = random.Random(2)
    pool = [*"ab'’sStTéñ中\U0001F600 \t́‍１2３.,!<|> \x1cİΣ", "<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "hahaha"]
    hard = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 60))), None) for i in range(500)]
    df = spark.createDataFrame(hard, "doc_id long, text string, lang string")
    for made, plain in ((docs, texts), (odd, ODD), (df, hard)):
        enc = pair_merges.encode(made)
        want = [(i, *brute_bpe(t)) for i, t, _ in plain]
        assert sorted(map(str, rows(enc))) == sorted(str((i, ids)) for i, ids, _ in want)
        assert sorted(map(str, rows(pair_merges.decode(enc)))) == sorted(str((i, t)) for i, _, t in want)
        digest = [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, ids, t in want]
        assert sorted(map(str, rows(pair_merges.digests(made)))) == sorted(map(str, digest))


def test_chunks_and_memory_do_not_matter(spark, texts, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, small = pair_merges.Codec(path), pair_merges.Codec(path)
    ids, ends = whole.encode([t for _, t, _ in texts])
    monkeypatch.setattr(pair_merges, "PARTS_KEPT", 50)
    got = [small.encode([t])[0] for _, t, _ in texts]
    assert np.concatenate(got).tolist() == ids.tolist() and len(small.parts) < len(whole.parts)


def test_merges_one_rank_at_a_time():
    """Random models: the index gives what merging the best pair of one word at a time gives."""
    rng = random.Random(3)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        for _ in range(rng.randint(0, 25)):
            pair = rng.choice(list(vocab)), rng.choice(list(vocab))
            if "".join(pair) not in vocab:
                vocab["".join(pair)] = len(vocab)
                merges.append(pair)
        by, names = pair_merges.Merger(vocab, merges), {i: t for t, i in vocab.items()}
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(20)] + ["a" * 17]
        ids, ends = by.merge(np.array([vocab[c] for w in words for c in w]), np.cumsum([len(w) for w in words]))
        for w, part in zip(words, np.split(ids, ends[:-1])):
            s = list(w)
            while found := [(merges.index(p), i) for i, p in enumerate(zip(s, s[1:])) if p in merges]:
                _, i = min(found)
                s[i : i + 2] = [s[i] + s[i + 1]]
            assert [names[i] for i in part.tolist()] == s


def test_files_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        pair_merges.Merger({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])
    with pytest.raises(ValueError):
        pair_merges.Codec(public_tokenizers.path("byte_bpe_50k.json"))


def test_pairs_of_nothing(spark, none):
    assert rows(pair_merges.digests(none)) == []
    df = spark.createDataFrame([(1, None), (2, [3306, 10**6, -4])], "doc_id long, ids array<int>")
    assert rows(pair_merges.decode(df)) == [(1, ""), (2, "hello</w>")]
