"""Small tables that hold the awkward cases: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
#: Column names that the operators use inside.
CLASHES = ("key", "unit", "band", "hash", "_hash", "n", "kept", "score", "row", "gone", "md5", "line", "shard", "uid",
           "words", "class", "marks", "n_lines", "text_hash", "keep_id", "bands", "rep", "quality",
           "filed", "size", "unit_a", "u", "v", "f0", "word", "_run", "_id", "part", "component_id")


def rows():
    chance = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = [" ".join(chance.choices(vocabulary, k=80)) for _ in range(6)]
    near = prose[0].split()
    near[40] = "changed"
    passage = "this passage of more than twenty characters stands in many texts"
    return [
        (1, prose[0], "en", "s1", 1), (2, prose[0], "en", "s2", 1), (2, prose[0], "en", "s2", 1),
        (3, prose[0].replace(" ", " \t"), "en", "s1", 1), (4, " ".join(near), None, "s3", None),
        (5, None, "en", "s1", None), (6, "", "en", None, 0), (7, " \n\t ", None, None, 4), (8, "one two", "en", "s1", 7),
        (9, "very long " * 30000, "en", "s1", 1), (10, prose[1] + "\n" + passage, "en", "s1", 1),
        (11, prose[2] + "\n" + passage, "en", "s2", 1), (12, prose[3] + "\n" + passage, "en", "s3", 1),
        (13, prose[4] + "\n" + passage + "\n" + passage, "en", "s4", 1), (14, prose[5] + "\n " + passage, "en", "s5", 1),
        (15, passage, "en", None, 1), (16, "日本語 ▁ \U00010348 é K Καὶ x y", "xx", "s9", 1), (17, "a" * 5000, "en", "s1", 5000),
        (18, "### *** " * 40, "en", "s1", 1), (19, "same words here again and again", "en", "s1", 1),
        (19, "other text under the same id, all rights reserved", "en", "s1", 1),
        (20, "General Public License\nCC BY all  rights, reserved <|endoftext|> </s>[INST]", "en", "s1", 1),
    ]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crowded(spark):
    """The same rows with further columns whose names the operators use themselves."""
    return documents(spark).withColumns({c: F.lit("x") for c in CLASHES})


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
