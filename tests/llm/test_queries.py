"""The queries against their SQL, and the pipeline against a brute-force version of it."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from taskloom.llm import decontaminate, quality, secrets
from taskloom.llm.queries import ORACLE_SQL, PIECES, QUERIES
from tests.llm.fixtures import documents, prose, texts
from tests.llm.test_operators import brute_near, brute_quality, brute_spans
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same(df, connect(SF), ORACLE_SQL[name])
    else:
        assert df.count() > 0


def brute_pipeline(rows, items):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    kept = []
    for d, t in rows:
        n, chars, symbols, dup, rep = brute_quality(t)
        lines = sum(1 for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c"))
        if not (n < 10 or 100 * rep > 20 * n or chars > 25 * n or 2 * chars < 3 * n or 10 * symbols > 3 * n or 10 * dup > 3 * lines):
            kept.append((d, t))
    comp = {d: c for d, _, c in brute_near(kept)}
    kept = list(dict.fromkeys((d, t) for d, t in kept if d is None or comp[d] == d))
    triples = lambda t: decontaminate.triples(decontaminate.words_of(t))
    kept = [(d, t) for d, t in kept if not any(len(triples(t) & triples(i)) > 0.7 * len(triples(i)) for i in items)]
    out = []
    for d, t in kept:
        at, text = 0, ""
        for s, _, e in brute_spans(t):
            if s >= at:
                text += t[at:s] + "<SECRET>"
            at = max(at, e)
        text += t[at:]
        ids = sp.encode(text)
        out.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_pipeline(spark, tmp_path):
    items = [prose(500, 30), prose(501, 20)]
    rows = texts() + [(60, prose(60, 80) + " " + items[0] + " " + prose(61, 50)), (61, prose(62, 30) + " token=abcdefghijklmnop and " + prose(63, 20))]
    documents(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(((r["doc_id"], r["n_ids"], r["ids_crc32"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute_pipeline(rows, items)
    assert 60 not in {r[0] for r in got} and 61 in {r[0] for r in got}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as kept", "'a' as spans")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "secret_scans":
            docs = docs.drop("spans")
        docs = stage(spark, docs, SF)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "kept" in docs.columns
    assert quality.POLICIES["v1"] and secrets.RULES


def test_pipeline_on_an_empty_table(spark, tmp_path):
    documents(spark, [], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
