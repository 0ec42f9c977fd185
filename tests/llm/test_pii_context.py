from tests.llm.docs import documents
from tracewell.llm import pii


def test_context_reaches_over_earlier_spans(spark):
    text = "card numbers: 4111111111112, 4111111111113"
    r = pii.candidates(documents(spark, [(1, text, "en", "s", 1)]).select("text")).first()
    assert [(x.s, x.v3) for x in r._more] == [(14, 2), (29, 2)]
