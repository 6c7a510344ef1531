"""Term weights shuffle texts, not terms of documents."""

import re

from meridio.plans import texts


def test_terms_of_documents_are_not_shuffled(spark):
    for f in (texts.plain, texts.smooth):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(doc_id#\d+L?, term", plan)
