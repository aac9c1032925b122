"""Cases that a cut in an operator would leave out."""

import base64
import pkgutil
import re

import pytest

import corpus_pipeline
from taskloom.llm import decontaminate, licenses, secrets, substring_dedup, url_filter, warc
from tests.llm.fixtures import documents, prose, texts
from tests.llm.test_operators import URLS, brute_repeats, pages, rows_of


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_short_items_are_found(spark, n):
    words = "capital of France Paris Seine river".split()[:n]
    bench = spark.createDataFrame([(7, " ".join(words)), (8, prose(800, 20))], "item_id long, text string")
    copy = prose(1, 200) + " " + " ".join(words) + " " + prose(2, 200)
    half = prose(3, 200) + " " + " ".join(words[: (n + 1) // 2]) + " " + prose(4, 200)
    docs = [(1, copy), (2, prose(5, 400)), (3, " ".join(words)), (4, half)]
    got = rows_of(decontaminate.contaminated(documents(spark, docs), bench), "doc_id", "item_id", "question_overlap", "answer_overlap")
    # the question alone is no copy, except of an item without an answer
    assert got == [(d, 7, 1.0, 1.0) for d in ((1, 3, 4) if n == 1 else (1, 3))]


def test_pipeline_judges_each_row(spark, tmp_path):
    item = prose(500, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bad, clean = prose(60, 80) + " " + item, [prose(i, 90) for i in range(70, 74)]
    docs = documents(spark, [(None, bad), (None, clean[0]), (1, bad), (1, clean[1]), (2, clean[2]), (3, bad), (None, None)])
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert rows_of(got, "doc_id", "text") == sorted([(None, clean[0]), (1, clean[1]), (2, clean[2]), (None, None)], key=repr)


def test_licenses_of_headers_and_whole_texts(spark):
    text = lambda name: pkgutil.get_data("taskloom.llm", f"license_texts/{name}.txt").decode()
    apache = "Copyright 2024 Someone\n" + text("Apache-2.0.notice")
    files = {
        "/n": ("This work is licensed under the GNU General Public\nLicense, version 3.", "GPL-3.0"),
        "/t/COPYING": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", "GPL-3.0"),
        "/a.py": ("#!/usr/bin/python\n" + "".join(f"# {x}\n" for x in apache.split("\n")) + "import os\n" * 50, "Apache-2.0"),
        "/b.c": ("/*\n" + "".join(f" * {x}\n" for x in text("GPL-3.0.notice").split("\n")) + " */\nint x;\n" * 50, "GPL-3.0"),
        "/c.js": ("// Licensed under the\n// MIT License\nlet x\n", "MIT"), "/plain.c": ("// the width of a\n// line\nint x;\n", None),
    } | {f"/l/{n}/LICENSE": ("Copyright (c) 2024 Someone\n\n" + text(n), n) for n in licenses.TEXTS}
    got = licenses.scan(spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string"))
    assert {r["path"]: r["license"] if r["origin"] == "own" else None for r in got.collect()} == {p: n for p, (_, n) in files.items()}


def test_host_list_of_any_size(spark, tmp_path):
    (tmp_path / "hosts.txt").write_text("# bad hosts\nExample.com\nwww.spam-farm.example.org # a part\n\nspam-farm.example.org\nnet\n")
    hosts = url_filter.read_hosts(spark, str(tmp_path / "hosts.txt"))
    pages = spark.createDataFrame([*enumerate(URLS), (None, "http://www.example.com/")], "page_id long, url string")
    cols = ("page_id", "host", "path", "rule", "verdict", "listed")
    small = rows_of(url_filter.judge(pages, block_hosts=hosts), *cols)
    large = url_filter.judge(pages, block_hosts=hosts, most_bytes=url_filter.DigestArray([(r, 0) for _, r in url_filter.RULES]).nbytes)
    assert tuple(large.columns) == cols and rows_of(large, *cols) == small
    assert {r[5] for r in small} == {None, "example.com", "spam-farm.example.org"}
    hosts.write.parquet(str(tmp_path / "hosts.parquet"))
    again = url_filter.judge(pages, block_hosts=url_filter.read_hosts(spark, str(tmp_path / "hosts.parquet")))
    assert rows_of(again, *cols) == small


def test_contamination_is_independent_of_other_items_and_shards(spark):
    """An item's matches are the same alone, beside a very long item, and in any shards; its halves far apart are no match."""
    item, words = prose(900, 20), prose(900, 20).split()
    apart = " ".join(words[:10]) + " " + prose(901, 3000) + " " + " ".join(words[10:])
    docs = documents(spark, [(1, prose(902, 300) + " " + item + " " + prose(903, 200)), (2, apart), (3, prose(904, 5000)), (4, item), (None, item), (5, None)])
    others = [(8, prose(905, 4000)), (9, prose(906, 130)), (10, prose(907, 65)), (11, ""), (12, None)]
    cols = ("doc_id", "item_id", "question_overlap", "answer_overlap", "passage_start")
    found = {}
    for more in ([], others):
        bench = spark.createDataFrame([(7, item), *more], "item_id long, text string")
        for size in (decontaminate.SHARD_BYTES, 1000):
            got = decontaminate.contaminated(docs, bench, shard_bytes=size, vocabulary_bytes=2000 if size == 1000 else decontaminate.VOCABULARY_BYTES)
            found[len(more), size] = rows_of(got, *cols)
    assert len({str(x) for x in found.values()}) == 1
    assert [r[:2] for r in found[0, 1000]] == sorted([(1, 7), (4, 7), (None, 7)], key=repr)
    assert decontaminate.contaminated(docs, bench.where("false")).collect() == []


def test_frequent_keys_give_the_same_rows(spark):
    """Windows and payloads that count as frequent from the second row on: their facts go by broadcast."""
    got = substring_dedup.remove_repeats(documents(spark), hot=1, frequent=1, shard_words=300)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(texts(), 50)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    df = pages(spark)[1]
    assert rows_of(warc.read_archive(*warc.write_archive(df, hot=1), hot=1), *cols) == rows_of(warc.read_archive(*warc.write_archive(df)), *cols)


def test_records_hold_exact_urls_and_are_checked(spark):
    urls = ["http://a/%0A", "http://a/\r\nX: y\n", None, "http://ä/?q"]
    headers, payloads = warc.write_archive(spark.createDataFrame([(i, u, "p" * 150 + str(i)) for i, u in enumerate(urls)], "page_id long, url string, html string"))
    for r in warc.records(headers, payloads).collect():
        head = bytes(r["record"]).partition(b"\r\n\r\n")[0].decode()
        exact = re.search(r"\r\nX-Target-URI-Base64: (\S+)", head)
        shown = re.search(r"\r\nWARC-Target-URI: ([^\r]*)", head)[1]
        assert (base64.b64decode(exact[1]).decode() if exact else shown) == (urls[r["page_id"]] or "")
    broken = payloads.withColumn("payload", payloads["payload"].substr(1, 20))
    with pytest.raises(Exception, match="broken WARC record"):
        warc.read_archive(headers, broken).collect()
    other = payloads.selectExpr("digest", "cast(repeat('q', octet_length(payload)) as binary) as payload")
    with pytest.raises(Exception, match="payload of another digest"):
        warc.read_archive(headers, other).collect()


def test_columns_of_any_name(spark):
    files = spark.createDataFrame([("/a/x", "// Released under the MIT License\n", "mine", 7), ("/a/y", "int y", None, 8)], "path string, text string, license string, score int")
    got = licenses.scan(files)
    assert sorted(got.columns) == ["license", "licensed_dir", "origin", "path", "score"]
    assert rows_of(got, "path", "license", "origin") == [("/a/x", "MIT", "own"), ("/a/y", "MIT", "inherited")]
    docs = spark.createDataFrame([(3, "token=abcdefghijklmnop")], "`my id` long, text string")
    assert len(secrets.scan(docs, id_col="my id").first()["spans"]) == 1
