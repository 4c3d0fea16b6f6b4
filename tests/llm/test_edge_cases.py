"""Every operator over awkward rows, an empty table, and a table with clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reelscope.llm import (
    chat_format, exact_dedup, license_scan, line_crf, line_dedup, near_dedup, packing, parity_join, quality_classifier,
    sentence_pieces, spelling_variants, token_counts,
)
from tests.llm import cases

PER_DOCUMENT = {
    "quality_rules": lambda d: line_crf.quality_rules(d, line_crf.Crf()),
    "exact_groups": exact_dedup.exact_groups,
    "near_duplicates": near_dedup.near_duplicates,
    "token_counts": lambda d: token_counts.token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
    "quality_scores": lambda d: quality_classifier.quality_scores(d, quality_classifier.Ftrl(1 << 18).weights()),
    "line_dedup": lambda d: line_dedup.remove_spread_lines(d).select("doc_id", "n_lines", "n_removed", "text"),
    "piece_digests": lambda d: sentence_pieces.piece_digests(d, public_tokenizers.path("piece_bpe_32k.model")),
    "license_scan": license_scan.license_scan,
    "jaccard_components": parity_join.jaccard_components,
}
OTHERS = {
    "pack": packing.pack_documents,
    "keep_content": lambda d: line_crf.keep_content(d, line_crf.Crf()),
    "keep_good": lambda d: quality_classifier.keep_good(d, quality_classifier.Ftrl(1 << 18).weights()),
    "keep_one": near_dedup.keep_one,
    "line_labels": lambda d: line_crf.line_labels(d, line_crf.Crf()),
    "spelling_variants": spelling_variants.spelling_variants,
}


@pytest.mark.parametrize("name", [*PER_DOCUMENT, *OTHERS])
def test_awkward_rows(spark, name):
    operator = (PER_DOCUMENT | OTHERS)[name]
    plain = operator(cases.documents(spark))
    found = cases.collected(plain)
    if name in PER_DOCUMENT:
        assert sorted(r[0] for r in found) == sorted(r[0] for r in cases.rows())
    crowded = operator(cases.crowded(spark))
    assert cases.collected(crowded.select(*plain.columns)) == found
    nothing = operator(cases.empty(spark))
    assert nothing.collect() == [] and nothing.columns == plain.columns


def test_null_ids_and_labels(spark):
    docs = spark.createDataFrame([(None, "a b c", None, None, None), (1, "a b c", None, None, None)], cases.SCHEMA)
    for name, operator in PER_DOCUMENT.items():
        assert operator(docs).count() == 2, name
    assert near_dedup.keep_one(docs).count() == 1
    nameless = docs.where("doc_id is null").unionByName(docs.where("doc_id is null")).unionByName(
        docs.where("doc_id is null").withColumn("text", near_dedup.F.lit("d e f"))
    )
    assert sorted(r["text"] for r in near_dedup.keep_one(nameless).collect()) == ["a b c", "d e f"]
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert (quality_classifier.train(docs, labels) != 0).any()
    assert line_crf.train(docs, labels).share == 0.5
    nobody = labels.where("false")
    assert not quality_classifier.train(docs, nobody).any()


def test_keep_one_tells_rows_of_an_id_apart(spark):
    first, second, third = ("one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g")
    rows = [
        (1, first), (2, second), (2, third), (3, second.replace(" ", "  ")),  # both texts of id 2 are the first of a class
        (4, first), (4, "h i j k l m n"),  # a copy of id 1, and a text of its own
        (5, "o p q r s t"), (5, "o p  q r s t"), (None, first), (None, "u v w x y z"), (None, "u v w x y  z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(((r["doc_id"] or 0, " ".join(r["text"].split())) for r in near_dedup.keep_one(docs).collect()))
    assert left == [
        (0, "u v w x y z"), (1, first), (2, third), (2, second), (4, "h i j k l m n"), (5, "o p q r s t"),
    ]


def test_line_dedup_by_hand(spark):
    found = {(r["doc_id"], r["n_removed"]) for r in line_dedup.remove_spread_lines(cases.documents(spark)).collect()}
    passage_docs = {10: 1, 11: 1, 12: 1, 13: 2, 14: 1, 15: 1}
    removed = {i: n for i, n in found if n}
    assert len(removed) == len(passage_docs) - 1 and all(passage_docs[i] == n for i, n in removed.items())
    again = cases.documents(spark).withColumn("source", line_dedup.F.lit("one"))
    assert line_dedup.remove_spread_lines(again).where("n_removed > 0").count() == 0


def test_chats_with_nulls_and_ties(spark):
    turns = spark.createDataFrame(
        [(1, 0, None, None, "x"), (1, 0, "assistant", "b", "x"), (1, 0, "assistant", "b", "x"), (None, None, "a\nb\\", "</s>", "x"),
         (2, None, "user", "<\\s> [\\INST] \\", "x"), (2, 3, "assistant", "<", "x")],
        "conv_id long, turn long, role string, text string, segment string",
    )
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    assert {k: r["n_turns"] for k, r in found.items()} == {1: 3, None: 1, 2: 2}
    assert found[1]["loss_chars"] == 2 and found[2]["loss_chars"] == 1
    assert chat_format.read_back(chat_format.format_chats(turns.where("false"))).collect() == []


def test_a_line_in_most_texts_stays_spread(spark):
    """Without broadcasts by size and without adaptive splitting, no task gets the rows of a frequent line."""
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id"), F.when(F.col("id") % 10 > 0, "\n" + "boilerplate " * 4).otherwise("")).alias("text"),
        (F.col("id") % 50).cast("string").alias("source"),
    ).repartition(8)
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, x in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, x)
    try:
        found = line_dedup.spread_lines(rows)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3599 and max(sizes) < 1800
    finally:
        for k, x in held.items():
            spark.conf.set(k, x)


def test_long_texts_lose_lines_in_linear_time(spark):
    import time

    def seconds(n):
        text = "\n".join(f"a line of more than twenty characters, number {i}" for i in range(n))
        docs = spark.createDataFrame([(i, f"{text}\nown {i}", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
        start = time.perf_counter()
        removed = sorted(r["n_removed"] for r in line_dedup.remove_spread_lines(docs).collect())
        assert removed == [0, n, n, n, n, n] or sum(removed) == 5 * n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(20_000) < 4 * seconds(10_000) + 2


def test_packing_takes_neighbours_in_order_without_sorting_all():
    import random

    import numpy as np
    import public_tokenizers
    import tiktoken

    from reelscope.llm import packing

    rng = np.random.default_rng(4)
    for n in (1, 5, 16, 17, 60):
        score, unused = rng.integers(0, 6, n).astype(float), rng.random(n) < 0.7
        order = np.flatnonzero(unused)
        assert list(packing.best_first(score, unused)) == order[np.argsort(-score[order], kind="stable")].tolist()
        ids = rng.integers(0, 9, n).astype("<u2")
        for got, want in zip(packing.counted(ids), np.unique(ids, return_counts=True)):
            assert got.tolist() == want.tolist()
    assert [len(x) for x in packing.counted(np.empty(0, "<u2"))] == [0, 0]
    fast = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).fast
    assert fast._pat_str != public_tokenizers.PATTERN  # the form that doesn't go back
    plain = tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=fast._mergeable_ranks, special_tokens=fast._special_tokens)
    chance = random.Random(3)
    for _ in range(4000):
        text = "".join(chance.choice(" \t\n\r\x0b\xa0\x85'sdmtlvreSab09²½.,!<|>ß$") for _ in range(chance.randint(0, 24)))
        assert fast.encode(text, allowed_special="all") == plain.encode(text, allowed_special="all")


def test_near_dedup_hands_python_few_megabytes_at_once(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from reelscope.llm import common, near_dedup

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, sign = spark.conf.get(setting), near_dedup._sign

    def watched(batches):
        def seen():
            for batch in batches:
                assert batch.nbytes < 12 << 20
                yield batch
        return sign(seen())

    monkeypatch.setattr(near_dedup, "_sign", watched)
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.concat(F.col("id"), F.lit("x"), i)), " ")
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"))  # 20 MB in one partition
    assert near_dedup.near_duplicates(docs).where("kept").count() == 5000
    assert spark.conf.get(setting) == before
    try:
        with common.small_batches(spark):
            raise KeyError
    except KeyError:
        assert spark.conf.get(setting) == before  # put back after a failure too

    def most(mb):
        texts = [" ".join(f"{i}x{j}" for j in range(1300)) for i in range(100 * mb)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
        tracemalloc.start()
        try:
            assert sum(b.num_rows for b in sign(iter([batch]))) == len(texts)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    most(1)  # fills the tables that a worker keeps
    assert most(6) < 1.6 * most(1)
