import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm.test_neardup import classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3))
    docs = [(i, " ".join(word() for _ in range(80))) for i in range(60)]
    item = " ".join(word() for _ in range(30))
    docs += [(100 + i, docs[i][1] + " " + word()) for i in range(5)] + [(200, docs[7][1])]
    docs += [(300 + i, " ".join(word() for _ in range(30)) + " grobble " + " ".join(word() for _ in range(10)) + " grobble") for i in range(20)]
    docs += [(400, "intro " + item + " outro"), (401, item.replace("a", "e", 2)), (500, "mail to jo.doe@mail1.example.com today"), (501, ""), (502, None)]
    top = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(300 <= i < 400)) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, docs


def test_run_equals_brute_force(spark, folder):
    top, docs = folder
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, top).collect()}
    clean = [(i, t) for i, t in docs if not 300 <= i < 400]
    first = {i for i, c in classes(clean).items() if i == c}
    want = {i for i in first if i not in (400, 401)}
    assert set(got) == want
    text = dict(docs)
    for i in want - {500}:
        assert got[i].decoded_sha256 == hashlib.sha256((text[i] or "").encode()).hexdigest()
    assert got[500].decoded_sha256 != hashlib.sha256(text[500].encode()).hexdigest()


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs.limit(3), folder[0]).dtypes == docs.dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder[0]).count() == 0
