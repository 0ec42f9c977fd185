"""The pipeline's stages on awkward rows, empty tables and repeated ids."""

import corpus_pipeline

from tests.llm.docs import AWKWARD, documents, text
from tracewell.llm import langid, simhash

STAGES = dict(corpus_pipeline.STAGES)


def folder(spark, tmp_path, rows, labels=()):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_awkward_rows_pass_through_all_stages(spark, tmp_path):
    place = folder(spark, tmp_path, AWKWARD)
    docs, left = documents(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs, left[name] = out, sorted(str(r.doc_id) for r in out.collect())
    assert left["language_id"] == left["toxicity"] == sorted(map(str, (5, 6, 7, 8, 8, None, 9, 10)))
    assert left["near_duplicates"] == left["personal_data"] == sorted(map(str, (5, 6, 7, 8, 10)))
    got = corpus_pipeline.run(spark, place)
    assert sorted(got.select("doc_id").distinct().toPandas().doc_id) == [5, 6, 7, 8, 10]


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0


def test_documents_without_any_language_stay(spark):
    rows = [(k, text(30, k), None, "s", 1) for k in range(5)] + [(9, "12 !?", None, "s", 1), (10, None, None, "s", 1)]
    assert sorted(r.doc_id for r in STAGES["language_id"](spark, documents(spark, rows), "").collect()) == list(range(5))


def test_the_network_rejects_and_names(spark):
    """Texts that no learned language claims go; a null lang becomes the predicted one."""
    rows = [(k, ("abc abd acd " if k % 2 else "xyz xzy yxz ") * 20, "ab" if k % 2 else "xy", "s", 1) for k in range(80)]
    rows += [(100, "abc abd acd " * 20, None, "s", 1)]
    d = documents(spark, rows)
    model = langid.train(d)
    got = {r.doc_id: r.lang for r in langid.in_known_language(d, model).collect()}
    assert len(got) == 81 and got[100] == "ab"
    scores = {r.row.doc_id: r.score for r in langid.with_language(d, model).collect()}
    middle = sorted(scores.values())[40]
    kept = langid.in_known_language(d, model, sure=2 * middle - 1).count()
    assert kept == sum(s >= middle - 1e-12 for s in scores.values()) < 82


def test_every_language_is_learned(spark):
    rows = [(k, f"word{k % 70} " * 10, f"l{k % 70:02}", "s", 1) for k in range(700)]
    model = langid.train(documents(spark, rows), total=140)
    assert len(model.languages) == 70


def test_repeated_ids_in_training_count_once(spark):
    rows = [(1, "a hot row", "en", "s", 1)] * 3000 + [(k, f"text number {k}", "en", "s", 1) for k in range(2, 60)]
    d = documents(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 60)], "doc_id long, quality int, toxic int")
    from tracewell.llm.common import labelled_texts

    got = labelled_texts(d, labels, "toxic", 5, 0, 1000).collect()
    assert len(got) == len({r.doc_id for r in got}) and sum(r.doc_id == 1 for r in got) <= 1
    assert langid.train(d) is not None


def test_simhash_survivors_of_repeated_ids(spark):
    """Rows are chosen, not ids: no group is lost and none keeps two."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    d = documents(spark, [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, b, "en", "s", 1)])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_first(d).collect()) == [(1, a), (2, b)]
