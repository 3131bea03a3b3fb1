import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from themeloom import runtime
from themeloom.operators import embed
from themeloom.plans import analysis
from themeloom.sources import bundle, registry, scan, sinks
from themeloom.streaming import ingest

TOPICS = [
    "database connection timeout pool exhausted during peak load",
    "login screen rejects valid password after account reset",
    "invoice export produces missing rows and duplicate totals",
]


@pytest.fixture(scope="module")
def csv_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "issues.csv"
    lines = ["id,summary,priority"]
    for i in range(60):
        lines.append(f'{i},"{TOPICS[i % 3]} case {"abcdefgh"[i % 8]}, ""quoted"" {i // 3}",N/A')
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_scan(spark, csv_file, tmp_path):
    df, column = scan.load(spark, csv_file)
    assert column == "summary" and df.count() == 60
    assert df.where("priority IS NOT NULL").count() == 0
    assert '"quoted"' in df.orderBy("row_id").first()["summary"]
    assert [r["id"] for r in df.orderBy("row_id").collect()] == list(range(60))
    with pytest.raises(FileNotFoundError):
        scan.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="Unsupported"):
        scan.read_csv(spark, str(tmp_path / "none.txt"))
    with pytest.raises(ValueError, match="not found"):
        scan.load(spark, csv_file, "nope")
    with pytest.raises(ValueError, match="no data"):
        scan.load(spark, csv_file, "priority")
    empty = tmp_path / "empty.csv"
    empty.write_text("id,summary\n")
    with pytest.raises(ValueError, match="empty"):
        scan.load(spark, str(empty))
    both = scan.read_files(spark, [csv_file, csv_file])
    assert both.groupBy("file_name").count().first()["count"] == 120
    listed = scan.landed_files(spark, str(tmp_path)).first()
    assert listed["file_name"] == "empty.csv" and listed["file_size"] == 11


def test_registry(spark, tmp_path):
    root = str(tmp_path / "reg")
    key = registry.analysis_id_of(spark, "a.csv", "summary")
    assert key == registry.analysis_id_of(spark, "a.csv", "summary")
    registry.put(spark.range(3), root, key)
    registry.put(spark.range(5), root, "other")
    assert registry.get(spark, root, key).count() == 3
    registry.delete(spark, root, key)
    with pytest.raises(KeyError):
        registry.get(spark, root, key)
    assert registry.listing(spark, root).first()["rows"] == 5


def test_analysis_bundle_and_streams(spark, csv_file, tmp_path):
    model, store, out = (str(tmp_path / n) for n in ("model", "store", "out"))
    options = analysis.Options(dim=64, epsilon=0.0, model_folder=model, repair=False)
    key, a = analysis.run_analysis(spark, csv_file, options=options, store=store)
    assert not a.reused_model
    found = a.themes.collect()
    assert len(found) >= 2 and all(t["sample_count"] <= 10 for t in found)
    assert registry.get(spark, store, key).count() == len(found)
    stats = a.statistics.first()
    assert stats["total_points"] == 60 and stats["num_clusters"] == len(found)
    assert a.quality.first()["total_texts"] == 60

    sinks.write_clustering(a.points, out)
    sinks.write_themes(a.themes, out)
    sinks.write_processed(a.records, out)
    sinks.write_report(spark, "report", out)
    back = spark.read.option("header", True).csv(f"{out}/clustering_results.csv")
    assert back.columns == ["x", "y", "cluster"] and back.count() == 60

    info = bundle.info(spark, model).first()
    assert info["n_training_samples"] == 60 and info["n_clusters"] == len(found)
    lines = [r.value for r in bundle.export_info(spark, model, str(tmp_path / "info")).collect()]
    assert "model.training rows = 60" in lines
    assert [r.value for r in spark.read.text(str(tmp_path / "info")).collect()] == lines
    points, predicted = analysis.predict_file(spark, csv_file, model)
    assert points.count() == 60 and predicted.first()["total_points"] == 60
    # the training rows themselves stay within their clusters' radii
    clustered = a.points.where("cluster_id <> -1").select("row_id")
    assert points.join(clustered, "row_id").where("cluster_id = -1").count() == 0
    drifted = analysis.drift_of_file(spark, csv_file, model).first()
    assert abs(drifted["drift_score"]) < 1e-9 and drifted["drift_severity"] == "Low"

    # streams equal the batch results
    vectors = bundle.load(spark, model).training
    vectors.write.parquet(str(tmp_path / "vec"))
    stream = spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "vec"))
    ingest.assign_stream(stream, model, str(tmp_path / "as"), str(tmp_path / "c1")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "as")).select("row_id", "cluster_id")
    want = points.select("row_id", "cluster_id")
    assert got.count() == 60 and got.exceptAll(want).count() == 0
    ingest.watch_drift(stream, model, str(tmp_path / "dr"), str(tmp_path / "c2")).awaitTermination()
    assert abs(spark.read.parquet(str(tmp_path / "dr")).first()["drift_score"]) < 1e-9


def test_ingest_equals_batch(spark, csv_file, tmp_path):
    schema = "id bigint, summary string, priority string"
    folder = csv_file.rsplit("/", 1)[0]
    typed = spark.createDataFrame([], schema).schema
    stream = ingest.landed_stream(spark, folder, typed)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # the second run finds no new file
        ingest.ingest(stream, "summary", "id", out, mark).awaitTermination()
    got = spark.read.parquet(out).select("row_id", "text")
    batch = ingest.clean_stream(scan._reader(spark, typed).csv(csv_file), "summary", "id")
    assert got.count() == 60 and got.exceptAll(batch).count() == 0


def test_missing_bundle(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, str(tmp_path / "no"))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_local_embedding_is_unit_length(spark):
    d = spark.createDataFrame([(1, TOPICS[0]), (2, ""), (3, TOPICS[1])], "row_id bigint, text string")
    got = {r["row_id"]: r["embedding"] for r in embed.embed_hashing(d, embed.fit_hashing(d, dim=32)).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1.0) and not any(got[2])


def test_files_are_numbered_as_listed(spark, tmp_path):
    from themeloom.sources import scan

    small, large = tmp_path / "a.csv", tmp_path / "b.csv"
    small.write_text("summary\n" + "first file text\n" * 3)
    large.write_text("summary\n" + "second file which is much longer\n" * 3000)
    got = scan.read_csv(spark, [str(small), str(large)]).orderBy("row_id").limit(4).collect()
    assert [r["summary"] for r in got] == ["first file text"] * 3 + ["second file which is much longer"]
    ids = scan.read_files(spark, [str(small), str(large)]).agg({"row_id": "max", "*": "count"}).first()
    assert ids[1] == 3003 or ids[0] == 3003
    assert scan.read_files(spark, [str(small), str(large)]).select("row_id").distinct().count() == 3003


def test_sizes_are_measured(spark):
    wide = spark.range(10).selectExpr("id", "array_repeat(cast(0 as double), 1000) as v")
    assert runtime.fits(wide, 64, 81_000, extra=runtime.doubles("v"))
    assert not runtime.fits(wide, 64, 80_000, extra=runtime.doubles("v"))
    assert not runtime.fits(wide.select("id"), 64, 600) and runtime.fits(wide.limit(0), 64, 1)


def test_csv_by_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,n\nfirst,1\nsecond,2\n")
    path = str(tmp_path / "a.csv")
    got = [scan.read_csv(spark, path, multi_line=m).drop("row_id").collect() for m in (True, False)]
    assert got[0] == got[1] and [r.text for r in got[0]] == ["first", "second"]
