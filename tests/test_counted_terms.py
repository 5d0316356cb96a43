"""Terms and their documents are counted together, in one pass over the texts."""

import math

from tablewright.operators import transforms


def test_terms_and_documents_at_once(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("texts are read again for the documents of a term")

    monkeypatch.setattr(transforms.F, "array_contains", fail)
    docs = spark.createDataFrame([(1, "apple apple Äpple"), (2, "pear apple"), (3, None), (4, "")], "doc_id long, t string")
    step = transforms.fit(docs, [transforms.Step("text_tfidf", "t")], key="doc_id")[0]
    assert step.params["terms"] == ["apple", "pear"]
    assert all(abs(a - b) < 1e-12 for a, b in zip(step.params["idf"], [math.log(5 / 3) + 1, math.log(5 / 2) + 1], strict=True))
