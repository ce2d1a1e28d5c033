"""The mixing stage keeps rows apart that have no doc_id or share one."""

from collections import Counter

import corpus_pipeline
from noticeloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_without_or_with_equal_ids(spark):
    rows = [(None, f"no id {k} " + "word " * (k % 7)) for k in range(60)] + [(k // 3, f"row {k} " + "text " * (k % 5)) for k in range(90)]
    docs = spark.createDataFrame([(i, t, ("en", None)[n % 2], f"src{n % 3}", len(t)) for n, (i, t) in enumerate(rows)], SCHEMA)
    taken = mixing.mixed(docs, keep=("text",)).collect()
    expected = Counter({(r.doc_id, r.kept.text): r.full_epochs + (r.prefix_tokens > 0) for r in taken if r.taken_tokens})
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in mixed) == expected
    assert any(r.doc_id is None for r in mixed)
    given = Counter(docs.collect())
    assert set(mixed) <= set(given) and len(taken) == sum(given.values())
