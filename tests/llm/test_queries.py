"""Registered queries on the smallest tables: against their SQL, and their columns against the contract."""

from __future__ import annotations

import os

import duckdb
import pytest

from docloom.llm import common, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4_near_dedup": "doc_id class_id kept",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_substring_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_html_extract": "page_id url text n_chars",
    "op8_license_scan": "doc_id digest license line_licenses",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_url_filter": "page_id host path rule verdict",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    assert rows
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = con.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, want.fetchall()))


def test_stored_tables_can_be_cleared(spark):
    df = common.stored(spark.range(3), "x")
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert df.count() == 3 and os.path.exists(path)
    assert common.clear_stored(spark) >= 1 and not os.path.exists(path)


def test_secret_sql_finds_the_same_random_tokens(spark):
    import random

    from pyspark.sql import functions as F

    from docloom.llm import secret_scan

    r = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, "é word " + "".join(r.choice(letters[: r.choice((16, 36, 62, 64))]) for _ in range(r.randint(18, 70))) + r.choice(("", "==", " token: abcdef")) + " plain-words-of-a-slug-here " + "x" * 30) for i in range(300)]
    rows += [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = secret_scan.scan(df).select("document.doc_id", secret_scan.written(F.col("spans")).alias("spans")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(f"SELECT doc_id, spans FROM ({secret_scan.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum("random" in s for _, s in want) > 100


@pytest.mark.parametrize(("set_to", "then"), [("64m", common.BATCH_BYTES), ("67108864b", common.BATCH_BYTES), ("1k", "1k"), ("2mb", "2mb"), ("4096", "4096")])
def test_batches_are_bounded(spark, set_to, then):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, set_to)
    common.small_batches(spark)
    assert spark.conf.get(key).removesuffix("b") == str(then).removesuffix("b")
    spark.conf.unset(key)
