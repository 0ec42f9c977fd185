import hashlib

from tracewell.plans.queries import document_keys


def test_every_document_has_keys(spark):
    rows = [(1, "Été à Köln\tGRÖSSE", "de", "s"), (2, "plain Text\n", "en", "s"), (3, "日本 語", "ja", "s"), (4, None, "en", "s")]
    got = {r.doc_id: r for r in document_keys(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got.keys() == {1, 2, 3, 4} and got[4].cache_key is None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for key, text, lang, source in rows[:3]:
        plain = "|".join([source, lang, str(key), "JOIN", "join", "".join(text.split()).lower()])
        want = (sha(sha(text) + sha(text + source) + "join@1p1m"), sha(text)[:16], hashlib.sha1(plain.encode()).hexdigest()[:16])
        assert (got[key].cache_key, got[key].prompt_hash, got[key].fingerprint) == want
