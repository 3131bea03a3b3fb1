import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.functions import vector
from themeloom.operators import classify, embed, lexical, profile, rows, themes
from themeloom.runtime import cut_measured


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(fn(F.col("t")).alias("r")).first()["r"]


def test_clean_text_steps(spark):
    assert one(spark, "<p>This is a <b>test</b> text</p>", tx.clean_text) == "This is a test text"
    assert one(spark, "see https://x.org/a?b=1 now", tx.clean_text) == "see now"
    assert one(spark, "mail a.b@c.org now", tx.clean_text) == "mail now"
    assert one(spark, None, tx.clean_text) == ""
    assert one(spark, "café résumé naïve", tx.clean_text) == "café résumé naïve"
    assert one(spark, "éñü & symbols: @#$%", tx.clean_text) == "éñü symbols:"
    assert one(spark, "A" * 10000, tx.clean_text) == "A" * 10000


def test_repair_encoding(spark):
    fix = lambda s: one(spark, s, tx.repair_encoding)
    assert fix("cafÃ©") == "café"
    assert fix("a &amp; b") == "a & b"
    assert fix("it’s “fine”") == "it's \"fine\""
    assert fix("é") == "é"
    assert fix(None) is None


def test_tokens(spark):
    assert one(spark, "I cannot open 3,000 well-known files. Don't!", tx.word_tokens) == [
        "i", "can", "not", "open", "files", "do",
    ]
    assert one(spark, "This is one. Is it two? Yes!", tx.sentences) == [
        "This is one.", "Is it two?", "Yes!",
    ]
    assert one(spark, "the disk is not mine", lambda c: tx.drop_stop_words(tx.word_tokens(c), ["disk"])) == ["mine"]
    assert one(spark, "Bug: Summary # it fails", tx.remove_boilerplate) == "it fails"


def test_key_phrases_ties_by_first_appearance(spark):
    d = spark.createDataFrame([(1, "zeta alpha zeta beta alpha gamma")], "row_id bigint, text string")
    found = lexical.key_phrases(lexical.lemmatize(lexical.row_words(d)), 3)
    assert [(r["phrase"], r["n"]) for r in found.orderBy("rank").collect()] == [
        ("zeta", 2), ("alpha", 2), ("beta", 1),
    ]


def test_words_are_counted_within_the_row(spark):
    rng = random.Random(3)
    texts = [[rng.choice(["ab", "abc", "box", "boxes", "zeta", "tables"]) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    d = spark.createDataFrame([(i, w) for i, w in enumerate([*texts, None])], "row_id bigint, words array<string>")
    got = {}
    for r in lexical.key_phrases(d, 3).orderBy("row_id", "rank").collect():
        got.setdefault(r["row_id"], []).append((r["phrase"], r["n"]))
    for i, w in enumerate(texts):
        long = [x for x in w if len(x) > 2]
        want = sorted(Counter(long).items(), key=lambda x: (-x[1], long.index(x[0])))[:3]
        assert got.get(i, []) == want
    assert len(texts) not in got


def test_lemmas_and_language_by_join_and_by_lookup(spark, monkeypatch):
    d = spark.createDataFrame(
        [(1, ["boxes", "box", "x"], "le chat noir"), (2, [], ""), (3, None, None), (4, ["errors", "error"], "the cat sat")],
        "row_id bigint, words array<string>, text string",
    )
    model = lexical.train_language_model(
        spark.createDataFrame([("le chat dort", "fr"), ("the cat sleeps", "en"), ("die katze", "de")], "text string, lang string")
    )
    parts = []
    for small in (True, False):
        monkeypatch.setattr(lexical, "fits", lambda *a, small=small: small)
        words = {r["row_id"]: r["words"] for r in lexical.lemmatize(d).collect()}
        told = {r["row_id"]: r["language"] for r in lexical.detect_language(d, model).collect()}
        parts.append((words, told))
    assert parts[0] == parts[1]
    assert parts[0] == ({1: ["box", "box", "x"], 2: [], 3: None, 4: ["error", "error"]}, {1: "fr", 2: "en", 3: "en", 4: "en"})


def test_only_rare_tokens_of_open_rows_are_joined(spark, monkeypatch):
    rng = random.Random(5)
    common = {"en": "the of and to is".split(), "fr": "le de et les un".split(), "de": "der die und zu ist".split()}
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(common))
        words = rng.choices(common[lang] + common["en"][:2], k=rng.randint(0, 12)) + [rng.choice("abcdefgh") * rng.randint(3, 9) + lang[0] for _ in range(rng.randint(0, 3))]
        rows.append((i // 2, " ".join(words) if i % 17 else None, lang))
    d = spark.createDataFrame(rows, "row_id bigint, text string, lang string")
    model = lexical.train_language_model(d)
    told = lambda: Counter((r["row_id"], r["language"]) for r in lexical.detect_language(d, model).collect())
    want, n = told(), model.count()
    joined, lookup = [], lexical._looked_up
    monkeypatch.setattr(lexical, "_looked_up", lambda *a: joined.append(lookup(*a)) or joined[-1])
    monkeypatch.setattr(lexical, "_language_by_join", None)  # all tokens must not travel
    for share in (0, 40, n - 1):  # rows of the model that may be broadcast
        monkeypatch.setattr(lexical, "TOKEN_ROW_BYTES", lexical.BROADCAST_BYTES // share if share else 2 * lexical.BROADCAST_BYTES)
        assert told() == want
        sent = joined[-1].where("_rare IS NOT NULL")
        assert sent.count() < len(rows)
        if share == 40:
            common_words = {w for ws in common.values() for w in ws}
            assert not common_words & {w for r in sent.collect() for w in r["_rare"]}


def test_lemma_tables_are_sized_by_their_bytes(spark, monkeypatch):
    d = spark.createDataFrame([(1, ["boxes", "box", "cars", "car"])], "row_id bigint, words array<string>")
    monkeypatch.setattr(lexical, "_lemmas_by_join", None)
    monkeypatch.setattr(lexical, "TOKEN_ROW_BYTES", 1 << 40)
    assert lexical.lemmatize(d).first()["words"] == ["box", "box", "car", "car"]


def test_sizes_of_records_need_no_lemmas(spark):
    d = spark.createDataFrame([(1, None), (1, "Errors in boxes. One box, one error."), (None, "Bug: it <b>fails</b>! Twice.")], "row_id bigint, text string")
    sizes = lambda df: sorted(map(str, df.select("row_id", "word_count", "sentence_count").collect()))
    assert sizes(lexical.record_sizes(d)) == sizes(lexical.preprocess(d))


def test_preprocess_empty_and_lemmas(spark):
    d = spark.createDataFrame(
        [(1, None), (2, ""), (3, "Errors in boxes. One box, one error.")],
        "row_id bigint, text string",
    )
    got = {r["row_id"]: r for r in lexical.preprocess(d).collect()}
    for i in (1, 2):
        assert got[i]["words"] == [] and got[i]["sentences"] == [] and got[i]["language"] == "en"
        assert got[i]["word_count"] == 0 and got[i]["cleaned_text"] == ""
    assert got[3]["words"] == ["error", "box", "one", "box", "one", "error"]
    assert got[3]["sentence_count"] == 2


def test_na_and_extraction(spark):
    d = spark.createDataFrame(
        [(1, "NA"), (2, "None"), (3, "  "), (4, None), (5, "nan"), (6, "fine")],
        "row_id bigint, text string",
    )
    kept = {r["row_id"] for r in rows.extract_texts(d, "text").collect()}
    assert kept == {1, 3, 6}
    assert rows.extract_texts(d, "nope").count() == 0
    na = {r["row_id"] for r in rows.normalize_na(d).where("text IS NULL").collect()}
    assert na == {1, 2, 4, 5}


def test_text_column_policies(spark):
    d = spark.createDataFrame(
        [(1, "a", "b", "c", "d")], "row_id bigint, no string, Title string, bug_text string, Summary string"
    )
    assert profile.detect_text_column(d, "longest") == "no"
    assert profile.detect_text_column(d, "first") == "Summary"
    e = spark.createDataFrame(
        [(1, "x" * 30, "y" * 60)], "row_id bigint, aaa string, bbb string"
    )
    assert profile.detect_text_column(e, "longest") == "bbb"
    assert profile.detect_text_column(e, "first") == "aaa"


def test_validation_and_summary(spark):
    d = spark.createDataFrame([], "row_id bigint, summary string")
    facts = profile.profile(d, "summary")
    r = profile.validate(facts).first()
    assert not r["is_valid"] and r["errors"] == ["File contains no data rows"]
    lines = [x.value for x in profile.data_summary(facts, profile.validate(facts), "f.csv").collect()]
    assert lines[0] == "file.name = f.csv" and "file.rows = 0" in lines
    assert lines[-1] == "checks.errors = File contains no data rows"


def test_dataset_collision(spark):
    src = spark.createDataFrame([(1, "s", 9)], "row_id bigint, summary string, index int")
    done = spark.createDataFrame(
        [(1, "o", "c", "p", "en", 1)],
        "row_id bigint, original string, cleaned string, processed string, language string, length int",
    )
    got = rows.analysis_dataset(done, src).first().asDict()
    assert got["original_summary"] == "o" and got["src_summary"] == "s"
    assert got["original_index"] == 1 and got["src_index"] == 9


def test_vectors(spark):
    d = spark.createDataFrame(
        [([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>"
    )
    got = d.select(vector.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["c"] for r in got] == [0.0, 1.0]


def test_provider_failure_gives_zero_vectors(spark):
    d = spark.createDataFrame([(i, "bad" if i == 3 else "ok") for i in range(6)], "row_id bigint, text string")

    def provider(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[1.0, 2.0]] * len(texts)

    got = embed.embed_with_provider(d.coalesce(1), provider, 2, batch_size=2).collect()
    failed = {r["row_id"] for r in got if r["failed"]}
    assert len(got) == 6 and 3 in failed and len(failed) <= 2
    assert all(r["embedding"] == ([0.0, 0.0] if r["failed"] else [1.0, 2.0]) for r in got)


def test_responders(spark):
    d = spark.createDataFrame([(1, "Yes"), (2, "no "), (3, None), (4, "perhaps")], "id int, response string")
    got = {r["id"]: (r["is_positive"], r["confidence"]) for r in themes.parse_yes_no(d).collect()}
    assert got == {1: (True, "high"), 2: (False, "high"), 3: (False, "low"), 4: (False, "medium")}

    def broken(prompts):
        raise RuntimeError("down")

    smp = spark.createDataFrame([(0, ["missing value", "fine"])], "cluster_id int, samples array<string>")
    names = spark.createDataFrame([(0, "x y")], "cluster_id int, name string")
    sizes = spark.createDataFrame([(0, 7)], "cluster_id int, size bigint")
    t = themes.theme_table(smp, names, sizes, broken, broken, broken).first()
    assert t["name"] == "Unknown Theme"
    assert t["description"] == "Description not available for Unknown Theme"
    assert t["data_quality_issues"] == 0 and t["cluster_size"] == 7
    table = themes.theme_table(smp, names, sizes)
    local = table.first()
    assert local["name"] == "x y" and local["data_quality_issues"] == 1
    two = table.unionByName(table.withColumn("cluster_id", F.lit(1)).withColumn("name", F.lit("z")))
    pairs = spark.createDataFrame([(0, 1)], "theme1 int, theme2 int")
    said = themes.compare_themes(two, pairs, broken).first()
    assert said["comparison"] == "Comparison not available between x y and z"
    echo = lambda prompts: [p.replace("\n", "|") for p in prompts]
    said = themes.compare_themes(two, pairs, echo).first()["comparison"]
    assert said == "Compare two themes.||Theme 1: x y|- missing value|- fine||Theme 2: z|- missing value|- fine"
    lines = [r.value for r in themes.theme_summary(table).collect()]
    assert lines[0] == "themes.count = 1" and lines[2].startswith("theme 0: named x y, about ")


@pytest.mark.parametrize("n", [0, 3])
def test_quality_share(spark, n):
    d = spark.createDataFrame([("An error here!",)] * n, "text string")
    r = rows.quality_share(d).first()
    assert r["data_quality_count"] == n and r["total_texts"] == n
    assert r["data_quality_percentage"] == (100.0 if n else 0.0)


def test_all_pairs_of_themes_with_a_common_term(spark):
    lists = {0: ["a", "b"], 1: ["b", "c"], 2: ["d"], 3: ["b", "a"], 4: []}
    df = spark.createDataFrame(list(lists.items()), "cluster_id int, terms array<string>")
    got = {(r["theme1"], r["theme2"]): (r["shared"], r["only1"], r["only2"]) for r in themes.compare_terms(df).collect()}
    assert got == {(0, 1): (["b"], ["a"], ["c"]), (0, 3): (["a", "b"], [], []), (1, 3): (["b"], ["c"], ["a"])}


def test_added_examples_equal_a_full_rebuild(spark, tmp_path):
    rng = random.Random(2)
    words = ["disk", "full", "login", "error", "page"]
    rows_ = [(i, " ".join(rng.choice(words) for _ in range(4)), rng.choice([-1, 0, 1, 2])) for i in range(80)]
    added = [(1000 + i, "new login disk", c) for i, c in enumerate([1, 1, 7])] + [(-5, "early disk", 1)]
    schema = "row_id bigint, text string, cluster_id int"
    path = str(tmp_path / "state")
    themes.write_state(themes.cluster_state(spark.createDataFrame(rows_, schema), 4), path)
    untouched = sorted(f.name for d in ("cluster_id=0", "cluster_id=2") for f in (tmp_path / "state" / d).glob("*.parquet"))
    got = themes.add_examples(spark, path, spark.createDataFrame(added, schema), 4)
    want = themes.cluster_state(spark.createDataFrame(rows_ + added, schema), 4)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # folders of other clusters are as they were, and a read of the touched ones prunes
    assert untouched == sorted(f.name for d in ("cluster_id=0", "cluster_id=2") for f in (tmp_path / "state" / d).glob("*.parquet"))
    plan = themes.touched_state(spark, path, [1, 7])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster_id" in plan


def test_issue_model_on_unseen_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "1 - quality AS label")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    cut_measured(docs.select("doc_id"), {"n": F.count("doc_id")})  # a session that has observed something
    model = classify.fit(docs.where("doc_id % 2 = 0"))
    got = classify.scores(classify.classify(docs.where("doc_id % 2 = 1"), model)).first()
    assert got["n"] > 1000 and got["accuracy"] > 0.95 and got["precision"] > 0.9 and got["recall"] > 0.8, got
    odd = spark.createDataFrame([(None, None), ("", 1), ("x" * 100_000, 0)], "text string, label int")
    told = classify.classify(odd, model).collect()
    assert [r["is_positive"] for r in told[:2]] == [False, False] and len(told) == 3
    with pytest.raises(ValueError):
        classify.fit(docs.where("label = 0"))
    smp = spark.createDataFrame([(0, ["missing value", "fine"])], "cluster_id int, samples array<string>")
    names = spark.createDataFrame([(0, "x y")], "cluster_id int, name string")
    sizes = spark.createDataFrame([(0, 7)], "cluster_id int, size bigint")
    assert themes.theme_table(smp, names, sizes, issue_model=model).first()["sample_count"] == 2


def test_words_made_once_give_the_same_vectors(spark):
    from themeloom.operators import embed

    df = spark.createDataFrame([(1, "Apples and pears"), (2, None), (3, "pears pears 12 x-y")], "row_id long, text string")
    made = embed.with_words(df).drop("text")
    want = {r["row_id"]: r["embedding"] for r in embed.embed_hashing(df, embed.fit_hashing(df)).collect()}
    assert {r["row_id"]: r["embedding"] for r in embed.embed_hashing(made, embed.fit_hashing(made)).collect()} == want
