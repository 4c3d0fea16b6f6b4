"""The pipeline, stage by stage, against plain versions."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from reelscope.llm import buckets, line_crf, line_dedup, near_dedup, packing, quality_classifier
from reelscope.llm.common import materialize, measured_joins, table
from tests.llm import cases
from tests.llm.test_against_brute_force import brute_classes


def test_stages_keep_columns_on_awkward_and_empty_tables(spark):
    for given in (cases.crowded(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, given, cases.SF)
            assert after.columns == given.columns, name
            assert {r["n_lines"] for r in after.collect()} <= {"x"} if "n_lines" in given.columns else after.count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, given, cases.SF).count() >= min(given.count(), 1)


def test_stages(spark):
    folder = cases.SF
    docs = given = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, folder), f"test-{name}")
        assert after.columns == given.columns
        kept[name] = (docs, after)
        docs = after
    before, after = kept["quality_rules"]
    crf = line_crf.train(given, labels)
    ids = {r["doc_id"] for r in before.collect() if line_crf.judge(crf, r["text"].encode())[6]}
    assert {r["doc_id"] for r in after.collect()} == ids
    before, after = kept["quality_classifier"]
    scores = quality_classifier.quality_scores(before, quality_classifier.train(given, labels))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scores.collect() if r["predicted"]}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & {r["doc_id"] for r in after.collect()}) >= 0.97 * len(good & ids)
    before, after = kept["line_dedup"]
    assert before.count() == after.count()
    sites, texts, first = collections.defaultdict(set), collections.defaultdict(set), {}
    for r in before.collect():
        for line in r["text"].split("\n"):
            sites[line.strip(" ")].add(r["source"])
            texts[line.strip(" ")].add(r["text"])
    spread = {x for x in sites if len(x) >= 20 and len(sites[x]) >= 5 and len(texts[x]) >= 5}
    for r in after.collect():
        for line in r["text"].split("\n"):
            if line.strip(" ") in spread:
                first.setdefault(line.strip(" "), set()).add(r["doc_id"])
        assert r["n_chars"] == len(r["text"])
    whole = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(len({whole[i] for i in first[x]}) == 1 for x in spread)  # one text keeps the line
    before, after = kept["near_dedup"]
    stay = {c for _, c in brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(stay)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in pieces.collect()} == stay


def test_filters_get_only_a_verdict_from_python(spark):
    docs = table(spark, cases.SF, "documents")
    weights = quality_classifier.Ftrl(1 << quality_classifier.BITS).weights()
    for kept in (line_crf.keep_content(docs, line_crf.Crf()), quality_classifier.keep_good(docs, weights)):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_no_join_is_broadcast_by_the_size_of_files(spark, monkeypatch):
    written = []

    def seen(df, name):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    def unhinted(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return [x for x in plan if x.lstrip(" :+-").startswith("Join ") and "strategy=" not in x]

    monkeypatch.setattr(buckets, "materialize", seen)
    monkeypatch.setattr(packing, "SHARD_TOKENS", 1 << 14)
    docs = table(spark, cases.SF, "documents").limit(300)
    docs = materialize(docs.unionByName(docs.withColumn("text", F.lit("the same words under every id"))), "test-documents")
    left = [near_dedup.keep_one(docs), line_dedup.remove_spread_lines(docs), packing.pack_documents(docs)]
    assert len(written) > 10 and not any("Broadcast" in plan for plan in written)
    assert [unhinted(df) for df in left] == [[], [], []]


def test_measured_joins_shuffle_what_is_exploded_from_a_small_file(spark):
    rows = spark.range(40_000).select("id", F.array_repeat(F.lit(7), 32).alias("keys"))
    few = materialize(rows.coalesce(1), "test-few")  # some 200 KB for 1,280,000 exploded rows
    keys = few.select("id", F.explode("keys").alias("key"))
    other = materialize(spark.range(80_000).withColumnRenamed("id", "other"), "test-other")

    def joined():
        return other.join(keys, F.col("other") == F.col("id"))._jdf.queryExecution().executedPlan().toString()

    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(name, None) for name in names]
    assert "BroadcastHashJoin" in joined()
    with measured_joins(spark):
        assert "SortMergeJoin" in joined()
    assert [spark.conf.get(name, None) for name in names] == before
