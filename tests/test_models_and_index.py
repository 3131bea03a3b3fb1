import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators import lexical, neighbors
from themeloom.operators.reduce import fit_reducer, reduce
from themeloom.plans import analysis


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(3).normal(0, 1, (120, 6)) * np.array([5, 3, 2, 1, 1, 1])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    return x, spark.createDataFrame(rows, "row_id bigint, embedding array<double>")


def components(x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(np.cov(unit.T))
    return axes[:, np.argsort(-values)[:k]]


def test_reduction_is_principal_components(vectors):
    x, df = vectors
    model = fit_reducer(df.where("row_id < 80"), 2)  # learnt on a part, applied to all
    got = np.array([r["point"] for r in reduce(df, model).orderBy("row_id").collect()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.abs(got), np.abs(unit @ components(x[:80], 2)), atol=1e-8)


def test_written_index_finds_neighbours(spark, vectors, tmp_path):
    x, df = vectors
    model = neighbors.fit_cells(df, 6)
    neighbors.write_index(df, model, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index/vectors"))
    assert index.count() == 120
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 120, 20):
        want = np.argsort(-(unit @ unit[q]), kind="stable")[:5]
        full = neighbors.search_index(index, model, list(x[q]), 5, probes=6).collect()
        assert [r["index"] for r in full] == want.tolist()
        some = neighbors.search_index(index, model, list(x[q]), 5, probes=4).collect()
        hits += len({r["index"] for r in some} & set(want.tolist()))
    assert hits >= 0.9 * 30
    # many queries at once: all cells are exact, some cells prune the scan and keep the recall
    centers = neighbors.cell_centers(spark, model)
    asked = df.select("row_id", F.col("embedding").alias("point")).unionByName(
        spark.createDataFrame([(999, None), (1000, [0.0] * 6)], "row_id bigint, point array<double>")
    )
    full = neighbors.search_many(index, centers, asked, 6, 5, probes=6).collect()
    for q in (0, 57, 119):
        want = np.argsort(-(unit @ unit[q]), kind="stable")[:5].tolist()
        assert [r["neighbor_id"] for r in sorted(full, key=lambda r: (r["row_id"], r["rank"])) if r["row_id"] == q] == want
    assert [r["similarity"] for r in full if r["row_id"] == 1000] == pytest.approx([0.0] * 5, abs=1e-9)
    assert not [r for r in full if r["row_id"] == 999]
    one = asked.where("row_id = 57")
    some = neighbors.search_many(index, centers, one, 6, 5, probes=2)
    near = neighbors.probe_cells(one, centers, 2).collect()
    assert len({r["cell"] for r in near}) == 2
    held = index.where(F.col("cell").isin([r["cell"] for r in near]))
    assert "PartitionFilters: [cell" in held._jdf.queryExecution().executedPlan().toString()
    assert {r["neighbor_id"] for r in some.collect()} <= {r["row_id"] for r in held.select("row_id").collect()}
    every = df.select("row_id", F.col("embedding").alias("point"))
    found = neighbors.search_many(index, centers, every, 6, 5, probes=4)
    assert neighbors.recall(found, neighbors.cosine_top_k(every, every, 6, 5)).first()["recall"] >= 0.9


def test_language_scores_follow_the_formula(spark):
    many = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} shared", f"l{i:03d}") for i in range(300)]
    model = lexical.train_language_model(spark.createDataFrame(many, "row_id bigint, text string, lang string"))
    asked = [(1, "wca"), (2, None), (3, ""), (4, "unknown words"), (5, "shared"), (6, "wzk wzk shared")]
    got = lexical.detect_language(spark.createDataFrame(asked, "row_id bigint, text string"), model)
    got = {r["row_id"]: r["language"] for r in got.collect()}
    # ties and texts without known words go to the first name, texts without words to the default
    assert got == {1: "l002", 2: "en", 3: "en", 4: "l000", 5: "l000", 6: "l285"}
    uneven = [(1, "aa aa aa bb", "x"), (2, "aa bb cc dd ee ff", "y")]
    model = lexical.train_language_model(spark.createDataFrame(uneven, "row_id bigint, text string, lang string"))
    seen = model.where("token = 'aa'").orderBy("lang").collect()
    assert [r["gain"] - r["cost"] for r in seen] == pytest.approx([np.log(4 / 10), np.log(2 / 12)])


def test_files_are_profiled_and_compared(spark, tmp_path):
    topics = ["database pool exhausted under load", "login rejects a valid password today"]
    other = "invoice export loses rows and totals"
    paths = []
    for name, texts in (("a", topics), ("b", [topics[0], other])):
        path = tmp_path / f"{name}.csv"
        path.write_text("summary\n" + "".join(f"{t} {'xyz'[i % 3]}\n" for i in range(24) for t in texts))
        paths.append(str(path))
    facts, validation = analysis.profile_file(spark, paths[0])
    assert facts.first()["file_size"] == (tmp_path / "a.csv").stat().st_size
    assert validation.first()["is_valid"]
    options = analysis.Options(dim=64, epsilon=0.0, repair=False)
    same = analysis.compare_file_themes(spark, paths[0], paths[0], options).first()
    assert same["shared_themes"] >= 2 and same["unique_themes"] == 0
    found = analysis.compare_file_themes(spark, *paths, options).first()
    assert found["shared_themes"] >= 1 and found["unique_themes"] >= 2


def test_analysis_keeps_records_and_totals(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("summary\n" + "".join(f"server {'abc'[i % 3]} failed. users wait\n" for i in range(30)))
    _, a = analysis.run_analysis(spark, str(path), options=analysis.Options(dim=32, epsilon=0.0))
    assert a.processed.count() == 30
    totals = a.corpus.first()
    assert totals["total_texts"] == 30 and totals["total_sentences"] == 60
    assert a.processed.where(F.size("key_phrases") > 0).count() == 30
