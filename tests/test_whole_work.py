"""Queries that do their whole work, on tables of their own."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.operators import embed, quality


def written(spark, folder, rows):
    """A folder with embeddings of (vec_id, embedding, label)."""
    at = str(folder)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


def test_core_distances_have_a_row_for_every_copy(spark, tmp_path):
    """Copies are points of their own; a row without a vector is kept without a distance."""
    x = [[0.0, 0.0], [0.0, 0.0], [3.0, 4.0], [0.0, 1.0], [0.0, 2.0], [0.0, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(x)] + [(9, None, 1), (3, x[3], 1)]
    got = entry.queries()["core_distances"](spark, written(spark, tmp_path, rows)).collect()
    held = [(i, v) for i, v, _ in rows if v is not None]
    want = [(i, round(sorted(math.dist(v, w) for j, (_, w) in enumerate(held) if j != at)[2], 6)) for at, (i, v) in enumerate(held)]
    assert sorted((r.row_id, r.core) for r in got if r.core is not None) == sorted(want)
    assert [r.row_id for r in got if r.core is None] == [9] and len(got) == len(rows)


def silhouette_of(d, label, weight):
    """Silhouette of every point by its definition; label -1 takes no part."""
    size = {c: weight[label == c].sum() for c in set(label) if c != -1}
    out = {}
    for i in np.flatnonzero(label != -1):
        own = label[i]
        mean = {c: (d[i] * weight)[label == c].sum() / n for c, n in size.items()}
        b = min((m for c, m in mean.items() if c != own), default=None)
        if size[own] < 2 or b is None:
            out[i] = 0.0
            continue
        a = mean[own] * size[own] / (size[own] - 1)
        out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return out


@pytest.mark.parametrize("nested", [True, False])
def test_trials_share_one_pass_over_the_distances(spark, monkeypatch, nested):
    """labellings whose clusters nest or are few are scored together; others as before."""
    monkeypatch.setattr(quality, "BLOCK_ROWS", 40)
    called, before = [], quality.distance_sums
    monkeypatch.setattr(quality, "distance_sums", lambda *a: called.append(1) or before(*a))
    rng = np.random.default_rng(21)
    x, weight, i = rng.integers(0, 9, (240, 5)) / 4.0, rng.integers(1, 3, 240), np.arange(240)
    if nested:
        trials = [i // 30, i // 3, np.where(i < 200, 0, i // 4), np.where(i % 3 == 0, -1, i // 12), np.full(240, -1), np.full(240, 7)]
    else:
        trials = [i % (40 + t) for t in range(8)]
    points = spark.createDataFrame([(int(p), x[p].tolist(), int(weight[p])) for p in i], "pid bigint, point array<double>, weight int")
    rows = [(t, int(p), int(c)) for t, label in enumerate(trials) for p, c in enumerate(label) if c != -1]
    labels = spark.createDataFrame(rows, "trial bigint, pid bigint, cluster_id bigint")
    got = {(r.trial, r.pid): r.value for r in quality.silhouette_values(points, labels).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(t, p): v for t, label in enumerate(trials) for p, v in silhouette_of(d, label, weight).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert bool(called) is not nested


def test_words_of_clean_texts_are_those_of_the_rules(spark):
    """chunks between blanks are looked up; the words are those of the patterns."""
    texts = [
        None, "", "  ", "Cannot, gonna. (lemme) wanna: a,, b:c 5:3 5:,x ... one..two three--four", "x:,5 a,. b., c,: d.!", "It is not the U.S. end.",
        "Größe ΣΑΣ. İstanbul ١٢ naïve² ①,x ǅ _a_ a_b - -x x-", "a.b c.:d.e; f,(g)h ,i :j k, l: m.", "cannot gimme_now gotta) 1,000.5 2:30, end,", "end:", "it's don't <b>x</b> a@b.cd http://x.yz/q w\u00a0z q\u2003r\x0bs",
        "error: The   'quoted' “text”\n\nnext line,\tlast", "ﬁn ß İ. ΑΣ: σς, a\u0301b c\u0301. ᾳ ῼ",
    ]
    d = spark.createDataFrame([(t,) for t in texts], "text string").select(tx.remove_boilerplate(tx.clean_text(F.col("text"), True)).alias("text"))
    got = d.select("text", embed.content_words(F.col("text")).alias("a"), tx.words_of_clean(F.col("text")).alias("b")).collect()
    assert [r.b for r in got] == [r.a for r in got] and sum(map(len, (r.a for r in got))) > 40


def test_guards_leave_nothing_out(spark):
    """texts are only searched by a pattern where a sign of it is there."""
    texts = ["a <b>x</b> c", "see https://a.bc/d?e=1 and http://x", "mail me@x.yz now", "Ã©tÃ© â€œx&amp;y&#233; caf\u0065\u0301", "‘q’ “r” x\x07y", " \u00a0edge\u2003", "issue: Bug # z", "\x1cz"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.t for r in d.select(tx.remove_boilerplate(tx.clean_text(F.col("text"), True)).alias("t")).collect()]
    assert got == ["a x c", "see and", "mail now", "été xyé café", "q r xy", "edge", "Bug # z".replace("# ", ""), "z"]
