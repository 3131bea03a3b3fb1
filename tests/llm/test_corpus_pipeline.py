"""The stages of the pipeline, each against brute force on what it is given."""

import collections
import sys
from pathlib import Path

from test_corpus_operators import DATA, brute_base, brute_components, brute_fingerprint, brute_quality, check_packing

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from themeloom.llm import catalog  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name == "packing":
            assert check_packing(after, [(r.doc_id, r.text) for r in before]) < 0.05
            continue
        assert docs.columns == columns
        if name == "quality_rules":
            stay = {r.doc_id for r in after}
            assert not any(brute_quality(r.text)[5] for r in after)
            fine = [r for r in before if not brute_quality(r.text)[5]]
            assert len(stay) >= 0.9 * len(fine)
        elif name == "near_duplicates":
            want = {c for _, _, c in brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in before])}
            assert sorted(r.doc_id for r in after) == sorted(want)
        elif name == "secrets":
            assert [r.doc_id for r in sorted(after)] == [r.doc_id for r in sorted(before)]
            old = {r.doc_id: r.text for r in before}
            for r in after:
                assert sum(brute_base(r.text)[:3]) == 0 and r.n_chars == len(r.text)
                assert sum(brute_base(old[r.doc_id])[:3]) or r.text == old[r.doc_id]
        else:
            times = collections.Counter(r.doc_id for r in after)
            assert max(times.values()) <= 3
            assert {r.text for r in after} <= {r.text for r in before}


def test_all_are_registered():
    names = {n.split("_")[0] for n in catalog.RUN}
    assert names == {f"op{i}" for i in range(1, 14)}
    assert catalog.SQL.keys() <= catalog.RUN.keys()
