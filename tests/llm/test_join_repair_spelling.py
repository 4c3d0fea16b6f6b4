"""Conversation repair, the Jaccard join and spelling variants against plain versions and SQL on awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelscope.llm import conversation_repair as repair
from reelscope.llm import buckets, near_dedup, parity_join, spelling_variants
from tests.llm import cases
from tests.llm.test_against_brute_force import sql_rows

TURNS = "conv_id long, turn long, role string, text string, initial string, audit string"


# -- conversation repair ----------------------------------------------------------------------------------------------

def plain_repair(rows):
    """(cost, audit, repaired) of all edits of a few rows, tried one by one; rows: (role, text, fault)."""
    best = None
    edits = [("D",) if fault in ("blank", "duplicate") else ("D", "K", "R") for _, _, fault in rows]
    for chosen in itertools.product(*edits):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + e for n, e in zip(inserts, [*chosen, ""]))
            place, out, cost, row, legal = "", [], 0, iter(rows), True
            for letter in audit:
                role, text, fault = ("", "", "") if letter == "I" else next(row)
                if letter in "IR":
                    role = "assistant" if place == "u" else "user"
                cost += {"D": 3, "I": 2, "R": 2, "K": 0}[letter] + (fault == "truncated" and letter != "D")
                if letter == "D":
                    continue
                if (place, role[:1]) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    legal = False
                    break
                place = role[:1]
                out.append(f"{role}:{text}")
            if legal and place in ("", "a"):
                found = (cost, audit, "\n".join(out))
                best = found if best is None else min(best, found)
    return best


FAULTS = st.sampled_from(["", "", "", "blank", "duplicate", "truncated"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", " ", ""]), FAULTS), max_size=4), st.booleans())
def test_cheapest_edits_equal_all_edits(rows, weak):
    held = repair._MODULUS
    repair._MODULUS = 3 if weak else held  # most hashes collide: the letters must decide
    try:
        walk = repair.Repair()
        for role, fault in rows:
            walk.add(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        assert walk.result() == plain_repair([(r, "", f) for r, f in rows])[:2]
    finally:
        repair._MODULUS = held


@pytest.mark.parametrize("settle", [1, 7, 1024])
def test_settled_audits_are_the_same(monkeypatch, settle):
    """A long walk, against a programme that keeps whole strings."""
    monkeypatch.setattr(repair, "SETTLE", settle)
    chance = random.Random(settle)
    rows = [(chance.choice("suaat "), chance.random() < 0.1, chance.random() < 0.3) for _ in range(3000)]
    walk, best = repair.Repair(), {"": (0, ""), "u": (2, "I"), "a": (4, "II")}
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    for initial, gone, cut in rows:
        walk.add(initial, gone, cut)
        layer = []
        for place, (cost, audit) in best.items():
            layer.append((place, cost + 3, audit + "D"))
            if not gone:
                if (place, initial) in moves:
                    layer.append((moves[place, initial], cost + cut, audit + "K"))
                layer.append(("a" if place == "u" else "u", cost + 2 + cut, audit + "R"))
        layer += [("a" if p == "u" else "u", c + 2, a + "I") for p, c, a in layer] + [
            ("a", c + 4, a + "II") for p, c, a in layer if p != "u"]
        best = {}
        for place, cost, audit in layer:
            best[place] = min(best.get(place, (cost, audit)), (cost, audit))
    assert walk.result() == min(best[""], best["a"])


def awkward_turns():
    chance = random.Random(3)
    words = ["Fine.", "Why?", "cut off", "", None, " \t\n", "Fine. ", "x!" * 3000]
    rows = [
        (c, chance.choice([None, 0, 1, 2, 2, 9]), chance.choice(["user", "assistant", "system", None, "", "tool"]), chance.choice(words))
        for c in [1, 2, 3, None, -4] for _ in range(5)
    ]
    rows += [rows[0]] * 2 + [(100 + i, 0, "user", "Hi.") for i in range(60)]
    return rows


def plain_report(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault, held = zlib.crc32(name.encode()) % 20, convs[conv]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        held += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in held:
            bare = text.strip(" \t\n\x0b\x0c\r")
            judged.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else
                           "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for t, _, _ in held if t is not None}
        cost, audit, out = plain_repair(judged)
        faults = collections.Counter(f for _, _, f in judged)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"],
               faults["truncated"], illegal, cost, audit, hashlib.sha256(out.encode()).hexdigest())


def test_awkward_conversations(spark):
    rows = [r for r in awkward_turns() if r[0] != 1]  # conversation 1 is too long to try all edits
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(5)
    found = repair.repair_report(repair.damaged(turns), turns)
    assert cases.collected(found) == sorted(plain_report(rows), key=repr)
    nothing = turns.where("false")
    assert repair.repair_report(repair.damaged(nothing), nothing).collect() == []


def test_conversations_equal_sql_with_long_ones(spark, tmp_path):
    import duckdb

    rows = awkward_turns() + [(7, i // 2, ["user", "assistant", "tool"][i % 3], f"Line {i % 40}{'.' * (i % 4 > 0)}") for i in range(300)]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    con = duckdb.connect()
    table = pa.table(dict(zip(["conv_id", "turn", "role", "text"], map(list, zip(*rows)))))
    con.register("conversations", table)
    got = con.execute(repair.SQL)
    names = [d[0] for d in got.description]
    found = repair.repair_report(repair.damaged(turns), turns).select(*names)
    assert cases.collected(found) == sorted(got.fetchall(), key=repr)


def test_repaired_turns_are_legal(spark):
    turns = spark.read.parquet(f"{cases.SF}/conversations.parquet")
    bad = repair.damaged(turns)
    out = collections.defaultdict(list)
    for r in repair.repaired_turns(bad, repair.audits(bad)).collect():
        out[r["conv_id"]].append((r["position"], r["role"]))
    for held in out.values():
        assert [p for p, _ in sorted(held)] == list(range(len(held)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role in sorted(held)))


# -- Jaccard join -----------------------------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 45), st.integers(0, 45), st.integers(0, 1 << 30))
def test_linked_sets_share_a_key(size, less, more, seed):
    chance = np.random.default_rng(seed)
    pool = chance.integers(0, 1 << 63, size + more, dtype=np.uint64)
    a, b = pool[:size], pool[min(less, size - 1):]
    together = len(np.union1d(a, b))
    bound = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
    for width in (1, parity_join.FOLDED, 40):
        x, y = (parity_join.parity(s, np.zeros(len(s), int), np.array([width])) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= bound
    keys = [set(parity_join.filed_segments(s, np.array([0, len(s)]))[0].tolist()) for s in (a, b)]
    if 100 * len(np.intersect1d(a, b)) >= 90 * together:
        assert keys[0] & keys[1]


def test_keys_do_not_depend_on_the_batch():
    chance = np.random.default_rng(4)
    sets = [np.unique(chance.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (3, 0, 40, 900, 1, 60)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    keys, firsts = parity_join.filed_segments(np.concatenate(sets), starts)
    for i, one in enumerate(sets):
        alone = parity_join.filed_segments(one, np.array([0, len(one)]))[0]
        assert sorted(alone.tolist()) == sorted(keys[firsts[i]: firsts[i + 1]].tolist())


def test_awkward_documents_equal_sql(spark):
    for operator, sql in ((parity_join.jaccard_components, parity_join.SQL), (spelling_variants.spelling_variants, spelling_variants.SQL)):
        columns, expected = sql_rows(spark, sql, cases.rows())
        assert cases.collected(operator(cases.documents(spark)).select(*columns)) == sorted(map(tuple, expected), key=repr)


def test_group_of_alike_texts_without_an_original(spark, monkeypatch):
    """Texts that differ in a few words each, some of them linked, most not; parts are small so that blocks are many."""
    monkeypatch.setattr(parity_join, "PART", 8)
    chance = random.Random(8)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in chance.sample(range(160), chance.choice([1, 2, 3, 4])):
            words[at] = f"v{chance.randrange(3)}"
        texts.append(" ".join(words))
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    assert 1 < len(set(root)) < len(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(docs).collect()}
    assert found == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_bucket_of_alike_texts_is_dealt_out(spark, monkeypatch):
    """5,000 units under one key, all alike by signature, few linked: rows stay few, and no part has many members."""
    monkeypatch.setattr(buckets, "PART", 512)
    n = 5000
    units = spark.range(n).select(F.col("id").alias("unit")).repartition(8)
    held = units.select("unit", F.lit(7).cast("long").alias("filed"), F.lit(n).alias("n"))
    signed = units.select("unit", F.array("unit").alias("sign"))
    bags = units.select("unit", F.array(F.col("unit") % 2500, F.col("unit") + 10_000, F.lit(-1).cast("long")).alias("bag"))
    none = units.limit(0).select("unit", F.col("unit").alias("class"))
    links = buckets._open_links(
        held, none, signed, lambda x, y: (x[..., 0] != y[..., 0]), lambda asked: bags.join(asked, "unit"),
        lambda shared, a, b: shared * 2 >= 4,
    ).collect()
    assert {frozenset((r["u"], r["v"])) for r in links} == {frozenset((i, i + 2500)) for i in range(2500)}
    parts = buckets._part_pairs(held, ["unit"], F.lit(0), "test").select(F.size("unit_a").alias("n")).collect()
    assert len(parts) == 10 * 11 // 2 and max(r["n"] for r in parts) < 2 * 512


def test_shared_elements(monkeypatch):
    monkeypatch.setattr(buckets, "COLUMNS", 3)
    chance = np.random.default_rng(3)
    left, right = ([np.unique(chance.integers(0, 12, n)) for n in chance.integers(0, 9, k)] for k in (5, 7))
    got = buckets.shared_elements(left, right)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert buckets.shared_elements(left, [np.array([99])]).tolist() == [[0]] * 5


def test_near_duplicates_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(buckets, "PART", 4)
    chance = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in chance.sample(range(90), chance.choice([0, 1, 2, 4])):
            words[at] = f"v{chance.randrange(4)}"
        texts.append(" ".join(words))
    bags = [collections.Counter(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    root = list(range(60))
    for i, j in itertools.combinations(range(60), 2):
        if 10 * sum((bags[i] & bags[j]).values()) >= 8 * sum((bags[i] | bags[j]).values()):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert found == dict(enumerate(root))


def test_rows_without_ids(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d"), (None, ""), (3, "a b c d"), (None, "e f g h"), (None, "e f g h"), (4, None)], "doc_id long, text string")
    found = cases.collected(parity_join.jaccard_components(docs))
    assert found == sorted(
        [(None, 2, 3), (None, 0, None), (3, 2, 3), (None, 2, None), (None, 2, None), (4, 0, 4)], key=repr)


# -- spelling variants ------------------------------------------------------------------------------------------------

def plain_near(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    return {(a, b) for a, b in itertools.combinations(sorted(words), 2) if near(a, b)}


@pytest.mark.parametrize("part", [3, 256])
def test_near_words_equal_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(spelling_variants, "PART_WORDS", part)
    monkeypatch.setattr(spelling_variants, "SLICE_WORDS", 50)
    chance = random.Random(part)
    words = {"".join(chance.choices("abé÷z", k=chance.choice([6, 7, 8]))) for _ in range(500)} | {"a" * 3000, "a" * 3001, "a" * 2999 + "b"}
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    found = spelling_variants.near_words(rows).collect()
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in found]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_near(words)
    number = {w: i for i, w in enumerate(sorted(words))}
    assert all((number[r["a"]], number[r["b"]]) == (r["a_n"], r["b_n"]) for r in found)


def test_words_lose_a_letter_by_their_checksum(spark):
    docs = spark.createDataFrame([(i, "Straßenbahn ÉCOLES école2écoles\nx") for i in range(600)] + [(None, "Straßenbahn"), (1, None)],
                                 "doc_id long, text string")
    expected = collections.Counter()
    for i, text in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run
            expected[run] += len(run) >= 6
    found = {r["word"]: r["n"] for r in spelling_variants.word_counts(docs).collect()}
    assert found == {w: n for w, n in expected.items() if n}


def test_forms_are_followed_to_the_last(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdgg": 130, "abcggg": 700, "zzzzzz": 9, "abcdeh": 25}
    docs = spark.createDataFrame([(-1, " ".join([w] * n)) for w, n in words.items()], "doc_id long, text string")
    assert not any(zlib.crc32(f"-1:{w}".encode()) % 199 == 0 for w in words)
    found = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling_variants.spelling_variants(docs).collect()}
    assert found == {
        "abcdef": ("abcdeg", "abcggg", 2), "abcdeg": ("abcdgg", "abcggg", 3), "abcdeh": (None, "abcdeh", 2),
        "abcdgg": ("abcggg", "abcggg", 2), "abcggg": (None, "abcggg", 1), "zzzzzz": (None, "zzzzzz", 0),
    }
