"""The pipeline's stages one by one against plain versions, and as a whole."""

import random

import pytest

import corpus_pipeline
from noticeloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    rows, labels = [], []
    for k in range(240):
        good = k % 4 != 0
        text = prose(60) if good else " ".join(w.upper() + "!!" for w in prose(50).split())
        rows.append((k, text))
        labels.append((k, int(good), 0))
    rows += [(300, rows[1][1]), (301, rows[1][1]), (302, rows[2][1].replace(" ", " x ", 1)), (303, rows[3][1]), (303, rows[3][1]), (None, rows[5][1]), (None, prose(40))]
    folder = tmp_path_factory.mktemp("sf")
    full = [(i, t, ("en", "de")[n % 2], f"src{n % 3}", len(t), 1) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.drop_low_quality(spark, docs, folder)
    assert good.columns == list(corpus_pipeline.COLUMNS)
    kept = [(r.doc_id, r.text) for r in good.collect()]
    assert all("!!" not in t for _, t in kept) and len(kept) >= 0.97 * sum("!!" not in t for _, t in rows)

    single = [(r.doc_id, r.text) for r in corpus_pipeline.drop_exact_copies(spark, docs, folder).collect()]
    best = {}
    for i, t in rows:
        best[t] = max((x for x in (best.get(t), i) if x is not None), default=None)
    assert sorted(single, key=repr) == sorted(((i, t) for t, i in best.items()), key=repr)

    near = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, folder).collect()}
    assert near == {i for i, _ in rows} - {300, 301, 302, 303}

    mixed = corpus_pipeline.mix_sources(spark, docs.dropDuplicates(["doc_id"]), folder).collect()
    times = {r.doc_id: r.full_epochs + (r.prefix_tokens > 0) for r in mixing.mixed(docs.dropDuplicates(["doc_id"])).collect()}
    assert len(mixed) == sum(times.values())


def test_whole(spark, corpus):
    folder, rows = corpus
    texts = dict(rows)
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.lossless for r in out) and all("!!" not in texts[r.doc_id] for r in out)


def test_empty(spark, corpus, tmp_path):
    folder, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
