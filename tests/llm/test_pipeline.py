"""The pipeline on a small corpus, stage by stage and whole, against plain Python."""

from __future__ import annotations

import random

import pytest

import __spark_entry__
import corpus_pipeline
from docloom.llm import packing
from tests.llm import brute

R = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(500)]


def prose(n: int) -> list[str]:
    return [R.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, " ".join(prose(30))) for k in range(4)]
    rows, labels = [], []
    for i in range(600):
        words = prose(R.randint(40, 90))
        if i % 5 == 0:
            for _ in range(8):
                words[R.randrange(len(words))] = R.choice(("awful", "rotten", "vile"))
        elif i % 37 == 1:
            words[10:10] = items[i % 4][1].split()
        elif i % 37 == 2:
            words[5:5] = ['password="hunter2222"', "deadbeefdeadbeefdeadbeefdeadbeef"]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    for k in range(40):
        words = rows[k * 3 + 1][1].split()
        if k % 2:
            words[R.randrange(len(words))] = "other"
        rows.append((1000 + k, " ".join(words), "en", "s", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def expected(rows, items):
    toxic = ("awful", "rotten", "vile")
    left = [r for r in rows if not any(w in toxic for w in (r[1] or "").split())]
    of = brute.near_classes([(r[0], r[1]) for r in left])
    keep: dict[int, int] = {}
    for k in range(len(left)):
        if of[k] not in keep or left[k][0] < left[keep[of[k]]][0]:
            keep[of[k]] = k
    left = [left[k] for k in keep.values()]
    left = [r for r in left if not brute.leaks(r[1], items)[1]]
    return {r[0]: (r[1] or "").replace('password="hunter2222"', '[SECRET]"').replace("deadbeefdeadbeefdeadbeefdeadbeef", "[SECRET]") for r in left}


def test_pipeline(spark, corpus):
    folder, rows, items = corpus
    want = expected(rows, items)
    got = corpus_pipeline.run(spark, folder).collect()
    texts: dict = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        texts.setdefault(r.doc_id, []).extend(r.ids)
    assert set(texts) == set(want)
    import public_tokenizers

    encode = packing.encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert all(texts[i] == [*encode(t), 0] for i, t in want.items())


def test_stages_keep_the_columns_and_each_works_on_all_that_is_left(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]


def test_stages_bear_nulls_repeats_long_texts_and_clashing_columns(spark, corpus):
    folder, rows, _ = corpus
    clash = ["document", "row", "key", "words", "score", "spans", "rest", "node", "component", "d1"]
    more = [*rows[:200], (None, "w1 w2", None, None, None), (None, None, None, None, None), (0, "w3 awful", "en", "s", 0), (rows[1][0], rows[1][1], "en", "s", 0), (3000, "w5 w6 " * 300_000 + "token=abcdefgh", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, *([7] * len(clash))) for r in more], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs.repartition(2), folder).collect(), docs.schema)
        assert docs.columns == columns and all(r[c] == 7 for r in docs.collect() for c in clash), name
        assert docs.where("doc_id = 3000").count() == 1
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left[3000].endswith("w5 w6 [SECRET]") and len(left[3000]) == len("w5 w6 ") * 300_000 + len("[SECRET]")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert pieces.where("start = 0").count() == docs.count()


def test_pipeline_of_no_documents(spark, corpus, tmp_path):
    folder, *_ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
