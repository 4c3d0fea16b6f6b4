"""Operators that SQL can't express, against plain versions, round trips or held-out labels; the others against SQL."""

import collections
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelscope.llm import (
    chat_format, common, exact_dedup, license_scan, line_crf, line_dedup, near_dedup, packing, quality_classifier, queries,
    sentence_pieces, token_counts,
)
from tests.llm import cases

TABLES = ("documents", "labels", "conversations")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, cases.SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def sql_rows(spark, sql, documents=None):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{cases.SF}/{name}.parquet'")
    if documents is not None:
        con.execute("CREATE OR REPLACE TEMP TABLE awkward(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n BIGINT)")
        con.executemany("INSERT INTO awkward VALUES (?, ?, ?, ?, ?)", documents)
        con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM awkward")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    columns, expected = sql_rows(spark, queries.SQL[name])
    found = queries.QUERIES[name](spark, cases.SF).select(*columns)
    assert cases.collected(found) == sorted(map(tuple, expected), key=repr)


@pytest.mark.parametrize("operator, sql", [
    (exact_dedup.exact_groups, exact_dedup.SQL),
    (lambda d: line_dedup.remove_spread_lines(d), line_dedup.SQL),
    (license_scan.license_scan, license_scan.SQL),
])
def test_awkward_rows_equal_sql(spark, operator, sql):
    columns, expected = sql_rows(spark, sql, cases.rows())
    assert cases.collected(operator(cases.documents(spark)).select(*columns)) == sorted(map(tuple, expected), key=repr)


def test_licence_scan_splits_texts_once(spark, monkeypatch):
    calls, plain = [], license_scan.licence_words
    monkeypatch.setattr(license_scan, "licence_words", lambda *a: calls.append(1) or plain(*a))
    found = license_scan.license_scan(cases.documents(spark))
    assert calls == [1] and found.where("doc_id = 20").first().base_labels == "cc-by,gpl,reserved"


def test_packing_shortcuts_equal_the_plain_ways():
    for ids in ([], [7], [3, 3, 3], [9, 1, 65535, 1, 0]):
        np.testing.assert_array_equal(packing.distinct(np.array(ids, "<u2")), np.unique(np.array(ids, "<u2")))
    for text in ("", "plain", "caf\xe9 \xff", "\u0100\u024f", "a\u0250", "\u2019", "\U00010348 z"):
        assert packing.latin(text) == all(c <= "\u024f" for c in text)


def test_exact_groups_tell_colliding_hashes_apart(spark):
    rows = cases.documents(spark)
    weak = exact_dedup.exact_groups(rows, hashed=lambda t: F.substring(t, 1, 1))
    assert cases.collected(weak) == cases.collected(exact_dedup.exact_groups(rows))


def brute_base(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i: i + 3])] > 1:
            inside.update((i, i + 1, i + 2))
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(common.SPACES):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(inside)


def test_base_counts(texts):
    for text in [*texts.values(), *[r[1] or "" for r in cases.rows()], "a b a b a b", "x x x x", "a\n\na\na"]:
        got = line_crf.judge(line_crf.Crf(), text.encode())
        assert got[:5] == brute_base(text)
        n, repeats = got[0], got[4]
        assert got[5] == (n < 50 or 100 * repeats > 50 * n)


def test_viterbi_and_gradient_against_all_paths():
    chance = np.random.default_rng(1)
    crf = line_crf.Crf(chance.normal(size=(2, line_crf.SIZE)), chance.normal(size=(2, 2)), chance.normal(size=2))
    n = 6
    bins = np.stack([chance.integers(0, line_crf.SIZE, n) for _ in range(3)], axis=1)

    def score(path, model=crf):
        s = model.scores(bins)
        return model.first[path[0]] + sum(s[i, p] for i, p in enumerate(path)) + sum(
            model.move[a, b] for a, b in zip(path, path[1:]))

    paths = [tuple((k >> i) & 1 for i in range(n)) for k in range(1 << n)]
    assert tuple(crf.decode(bins)) == max(paths, key=score)
    marks = np.array(paths[37])

    def likelihood(model):
        return score(tuple(marks), model) - np.logaddexp.reduce([score(p, model) for p in paths])

    stepped = line_crf.Crf(crf.unary.copy(), crf.move.copy(), crf.first.copy())
    stepped.gradient_step(bins, marks, 1e-6)
    gradient = (stepped.move - crf.move) / 1e-6
    moved = line_crf.Crf(crf.unary.copy(), crf.move.copy(), crf.first.copy())
    moved.move[0, 1] += 1e-6
    assert abs((likelihood(moved) - likelihood(crf)) / 1e-6 - gradient[0, 1]) < 1e-3


def held_out(spark, folder):
    labels = common.table(spark, folder, "labels").where(quality_classifier.remainder() == 0)
    return {r["doc_id"]: r["quality"] for r in labels.collect()}


def test_quality_rules_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = held_out(spark, folder)
    rows = [r for r in line_crf.op1_quality_rules(spark, folder).collect() if r["doc_id"] in truth and not r["base_failed"]]
    assert np.mean([r["kept"] for r in rows if truth[r["doc_id"]]]) > 0.97
    assert np.mean([r["kept"] for r in rows if not truth[r["doc_id"]]] or [0]) < 0.3


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = held_out(spark, folder)
    rows = {r["doc_id"]: r for r in quality_classifier.op6_quality_classifier(spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    good = [rows[i]["score"] for i, q in truth.items() if q]
    bad = [rows[i]["score"] for i, q in truth.items() if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows.values())


def test_scores_are_the_sparse_dot_products(spark, texts):
    weights = np.random.default_rng(2).normal(size=(1 << 18) + 1)
    some = dict(list(texts.items())[:50])
    frame = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in quality_classifier.quality_scores(frame, weights).collect()}
    for i, text in some.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        (slots, values), = quality_classifier.feature_rows(raw, np.array([0, len(raw)]))
        assert found[i] == pytest.approx(1 / (1 + np.exp(-(weights[slots] @ values + weights[-1]))))


def shingle_bag(text):
    w = text.split()
    return collections.Counter(tuple(w[j: j + 5]) for j in range(max(len(w) - 4, 1))) if w else collections.Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def brute_classes(rows):
    """Smallest id of the component of each document, all pairs compared."""
    rows = sorted(rows)
    bags, words = [shingle_bag(t) for _, t in rows], [tuple(t.split()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if words[i] == words[j] or similarity(bags[i], bags[j]) >= near_dedup.SIMILARITY:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((rows[i][0], rows[find(i)][0]) for i in range(len(rows)))


def near_groups():
    """Chains and clouds of edited texts: many links, some just under and over the threshold."""
    chance = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for g in range(6):
        base = chance.choices(words, k=150)
        for c in range(25):
            text = list(base)
            for _ in range(chance.randrange(0, 12)):
                text[chance.randrange(150)] = chance.choice(words)
            rows.append((g * 1000 + c, " ".join(text)))
            if g % 2:
                base = text
    return rows + [(9000 + i, t) for i, (_, t) in enumerate(rows[:10])]


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_groups()
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["class_id"]) for r in found.collect()) == brute_classes(rows)


def test_bag_minhash_is_unbiased():
    chance = np.random.default_rng(4)
    size = 20_000
    for top in (1, 5, 40):
        elements = chance.integers(0, 1 << 53, 60).astype(np.uint64)
        a, b = chance.integers(0, top + 1, 60), chance.integers(0, top + 1, 60)
        signatures = []
        for w in (a, b):
            has = w > 0
            signatures.append(near_dedup.bag_minhash(np.zeros(has.sum(), np.int64), elements[has], w[has], 1, size)[0])
        expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((signatures[0] == signatures[1]).mean() - expected) < 0.02


def test_ftrl_equals_a_plain_loop():
    """Ten updates of the proximal leader, slot by slot as published."""
    chance = random.Random(12)
    model = quality_classifier.Ftrl(8, alpha=0.3, beta=1.0, l1=0.02, l2=0.1)
    z, n = [0.0] * 9, [0.0] * 9

    def weight(i):
        if abs(z[i]) <= 0.02:
            return 0.0
        return -(z[i] - (0.02 if z[i] > 0 else -0.02)) / ((1.0 + n[i] ** 0.5) / 0.3 + 0.1)

    for _ in range(10):
        at = sorted(chance.sample(range(8), 3)) + [8]
        value, label = [chance.random() for _ in at], chance.choice([0.0, 1.0])
        w = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, value))))
        for i, x, own in zip(at, value, w):
            g = (p - label) * x
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * own
            n[i] += g * g
        model.update(np.array(at), np.array(value), label)
    np.testing.assert_allclose(model.z, z, atol=1e-12)
    np.testing.assert_allclose(model.weights(), [weight(i) for i in range(9)], atol=1e-12)


def test_token_counts_equal_whole_texts(spark, docs, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    awkward = {100_000 + i: r[1] or "" for i, r in enumerate(cases.rows()) if len(r[1] or "") < 50_000}
    every = texts | awkward
    frame = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    for r in token_counts.token_counts(frame, public_tokenizers.path("word_bpe_49k.json")).collect():
        text = every[r["doc_id"]]
        n = len(whole.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 2048)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/s[]INT\\ \nab", max_size=30), st.text(alphabet="<s>\\\nab", max_size=8))
def test_rendering_reads_back(text, role):
    out = chat_format.render(role, text)
    (got_role, got_text, start, stop), = chat_format.parse(out)
    assert (got_role, got_text) == (role, text)
    assert not any(x in out[start:stop] for x in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert [x[:2] for x in chat_format.parse(out * 3)] == [(role, text)] * 3


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_transducer_equals_library(text):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = sentence_pieces.transducer(path)
    ids = machine.encode(text).tolist()
    assert ids == library.encode(text)
    assert machine.decode(ids) == library.decode(ids)


def field(number, value):
    """A field of a serialised protocol-buffer message."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab cx", max_size=20))
def test_unigram_model_takes_the_best_sum_of_scores(text):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [
        (p, score, 1) for p, score in (("▁", -2.0), ("a", -3.0), ("b", -3.1), ("c", -3.2), ("ab", -4.5), ("ba", -4.1),
                                       ("▁a", -3.7), ("bab", -6.3), ("▁ab", -5.9), ("aa", -5.25))]
    model = b"".join(
        field(1, field(1, p.encode()) + field(2, score) + field(3, kind)) for p, score, kind in pieces
    ) + field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    machine = sentence_pieces.Transducer(model)
    assert machine.kind == sentence_pieces.UNIGRAM
    assert machine.encode(text).tolist() == library.encode(text)


def test_transducer_equals_library_on_documents(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentence_pieces.op8_sentence_pieces(spark, cases.SF).collect()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4"))) and r["round_trip"]
    few = common.table(spark, cases.SF, "documents").where("doc_id < 20")
    back = sentence_pieces.decode_texts(sentence_pieces.encode_texts(few, path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t for i, t in texts.items() if i < 20}


def test_packing_holds_each_id_once(spark, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    awkward = {100_000 + i: r[1] or "" for i, r in enumerate(cases.rows())}
    every = texts | awkward
    frame = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    rows = packing.pack_documents(frame).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in every.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at: at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(r["length"] for r in rows) > 0.95 * 2048 * len(sequences)


def test_packing_brings_neighbours_of_the_whole_corpus_together(spark, monkeypatch):
    """Recall of the best BM25 neighbours over all fragments, with two dozen shards and with six."""
    whole = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    names, fragments = [], []
    for r in docs.collect():
        ids = np.append(whole.of(r["text"] or ""), np.uint32(1))
        if len(ids) % 2048:
            names.append(r["doc_id"])
            fragments.append(ids[len(ids) // 2048 * 2048:].astype(np.int64))
    df = np.bincount(np.concatenate([np.unique(x) for x in fragments]))
    idf = np.maximum(0, np.log((len(fragments) - df + 0.5) / (df + 0.5))) * (df > 0)
    index = packing.Bm25Shard(fragments, idf, np.mean([len(x) for x in fragments]))
    total = sum(map(len, fragments))
    for count, least in ((24, 0.7), (6, 0.8)):
        monkeypatch.setattr(packing, "SHARD_TOKENS", -(-total // count))
        rows = packing.pack_documents(docs).where("sequence_id % 2 = 1").select("doc_id", "sequence_id").collect()
        by_name = {r["doc_id"]: r["sequence_id"] >> 33 for r in rows}
        shard = np.array([by_name[i] for i in names])
        lengths = np.bincount(shard, weights=[len(x) for x in fragments])
        assert len(lengths) == count and lengths.max() <= total / count + 2 * 2048
        hits, related = [], []
        for seed in range(len(fragments)):
            score = index.scores(seed)
            own, score[seed] = score[seed], -1
            hits.append(score[shard == shard[seed]].max() >= score.max() - 1e-9)
            related.append(score.max() > 0.8 * own)
        hits, related = np.array(hits), np.array(related)
        print(f"{count} shards: {hits.mean():.3f} of all seeds, {hits[related].mean():.3f} of {related.mean():.3f} related")
        assert hits[related].mean() > least and hits.mean() > 3 / count


def test_bm25_scores_and_greedy_windows():
    chance = np.random.default_rng(6)
    fragments = [chance.integers(0, 50, n).astype(np.uint16) for n in (30, 20, 25, 40, 5)]
    idf = chance.random(50)
    index = packing.Bm25Shard(fragments, idf, 24.0)
    for seed in range(5):
        for i, ids in enumerate(fragments):
            expected = 0.0
            for t in set(fragments[seed].tolist()):
                tf = int((ids == t).sum())
                expected += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ids) / 24.0))
            assert index.scores(seed)[i] == pytest.approx(expected)
    windows = packing.fill_windows([30, 20, 25, 40, 5], index.scores, 32)
    assert [sum(b - a for _, a, b in w) for w in windows] == [32, 32, 32, 24]
    first = index.scores(3)
    assert windows[0][0] == (3, 0, 32) and windows[1][0] == (3, 32, 40)
    assert windows[1][1][0] == max([0, 1, 2, 4], key=lambda i: first[i])
