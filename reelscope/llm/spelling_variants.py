"""Spelling variants: words one edit apart, found by Gram matrices of letter counts inside small blocks.

Two words that differ by one inserted, deleted or replaced code point have letter counts at a squared distance of at most
two, and lengths that differ by at most one.  Words are filed by how many of their letters fall into each of six
classes of the alphabet, so a block has one length; one edit moves a word to its own block, to one where a letter has
changed its class, or to one with a letter more.  Only those pairs of blocks meet.  A product of two blocks' count
matrices gives all squared distances at once, and what is left is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import lookup, materialize, plain_text, table

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A near word is a word's form if it is so many times as frequent.
STRONGER = 5
#: A run loses a letter if this divides its checksum.
DAMAGE = 199
#: Words of a block that are compared with as many of another in one product.
PART_WORDS = 256
#: Letters of a part of a block, for very long words.
PART_LETTERS = 1 << 18
#: Words that are counted in one matrix.
SLICE_WORDS = 1 << 15

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
RUNS = "[a-zÀ-ÿ]+"
#: The letters from frequent to rare; neighbours in this order go to different classes.
BY_FREQUENCY = "etaoinshrdlucmfwypvbgkjqxz"
CLASSES = 6
CLASS_LETTERS = [BY_FREQUENCY[c::CLASSES] + ACCENTED[c::CLASSES] for c in range(CLASSES)]
_WIDTH = len(LOWER + ACCENTED)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: the runs of letters of all texts, lower-cased, damaged by their checksum, with their counts.

    Only words of at least six code points.  A null text has none; a null id is written as nothing in the checksum.
    Counting starts before the shuffle, so a very frequent word sends one row a task.
    """
    text = F.translate(plain_text(), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        # a run that loses a letter must have had one more than the least
        F.explode(F.regexp_extract_all(text, F.lit(RUNS[:-1] + f"{{{LEAST_LENGTH},}}"), F.lit(0))).alias("_run"),
    )
    check = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = F.pmod(check, F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    words = runs.select(F.when(F.pmod(check, F.lit(DAMAGE)) == 0, cut).otherwise(F.col("_run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.char_length("word") >= LEAST_LENGTH)


def block_key(word: Column) -> Column:
    """How many letters of each class a word has."""
    return F.array(*[
        F.char_length(word) - F.char_length(F.translate(word, letters, "")) for letters in CLASS_LETTERS
    ])


def _later_blocks(key: str) -> Column:
    """The block itself and those that one edit leads to, each pair of blocks from one side only.

    A letter more in one class; or, at the same length, a letter more in one class and a letter less in a later one.
    """
    def moved(up: int, down: int | None) -> Column:
        return F.array(*[
            F.col(key)[c] + (1 if c == up else -1 if c == down else 0) for c in range(CLASSES)
        ])

    more = [moved(up, None) for up in range(CLASSES)]
    swapped = [moved(up, down) for up in range(CLASSES) for down in range(up + 1, CLASSES)]
    return F.array(F.col(key), *more, *swapped)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points (below 256) of all words, one after the other, and the offsets of the words in them."""
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]: ends[-1]]
    own = data != 0xC3  # all accented letters have this first byte in UTF-8
    places = np.concatenate([[0], np.cumsum(own)])
    kept = data[own]
    return np.where(kept >= 0x80, kept + 0x40, kept).astype(np.uint8), places[ends - ends[0]]


def letter_counts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of letter counts per word."""
    n = len(starts) - 1
    column = np.where(codes < 0xC0, codes.astype(np.int64) - ord("a"), codes.astype(np.int64) - 0xC0 + len(LOWER))
    rows = np.repeat(np.arange(n), np.diff(starts))
    return np.bincount(rows * _WIDTH + column, minlength=n * _WIDTH).reshape(n, _WIDTH).astype(np.float32)


def one_edit(codes: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of words are one edit apart; ``b`` is as long as ``a`` or one code point longer."""
    length, longer = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
    near = np.zeros(len(a), bool)
    for size, other in set(zip(length.tolist(), longer.tolist())):
        each = np.flatnonzero((length == size) & (longer == other))
        for at in range(0, len(each), max(1, (1 << 22) // size)):
            some = each[at: at + max(1, (1 << 22) // size)]
            x = codes[starts[a[some], None] + np.arange(size)]
            y = codes[starts[b[some], None] + np.arange(other)]
            if size == other:
                near[some] = (x != y).sum(axis=1) == 1
            else:  # letters that agree from the front and from the back
                front = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
                back = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                near[some] = front + back >= size
    return near


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of parts of blocks (same, a, a_n, b, b_n: arrays) to the pairs of words that are one edit apart."""
    for batch in batches:
        same = batch.column(0).to_pylist()
        sizes = [np.diff(batch.column(c).offsets.to_numpy()) for c in (1, 3)]
        total = np.cumsum(sizes[0] + sizes[1])
        first = 0
        while first < batch.num_rows:
            done = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, done + SLICE_WORDS, side="right")))
            rows = batch.slice(first, last - first)
            words = pa.concat_arrays([rows.column(1).flatten(), rows.column(3).flatten()])
            counts_of = pa.concat_arrays([rows.column(2).flatten(), rows.column(4).flatten()])
            codes, starts = _letters(words)
            counts = letter_counts(codes, starts)
            norms = np.einsum("ij,ij->i", counts, counts)
            left, right = 0, len(rows.column(1).flatten())
            found_a, found_b = [], []
            for row in range(first, last):
                n, m = int(sizes[0][row]), int(sizes[1][row])
                products = counts[left: left + n] @ counts[right: right + m].T
                least = (norms[left: left + n, None] + norms[None, right: right + m]) / 2 - 1
                a, b = np.nonzero(products >= least)  # a squared distance of at most two
                if same[row]:
                    once = a < b
                    a, b = a[once], b[once]
                found_a.append(a + left)
                found_b.append(b + right)
                left, right = left + n, right + m
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            near = one_edit(codes, starts, a, b)
            a, b = pa.array(a[near]), pa.array(b[near])
            yield pa.RecordBatch.from_arrays(
                [words.take(a), counts_of.take(a), words.take(b), counts_of.take(b)], names=["a", "a_n", "b", "b_n"]
            )
            first = last


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of the given ``word, n`` (written, distinct words) that are one edit apart, once.

    Blocks of more than 256 words are dealt into parts by a hash; each pair of parts is a row of its own, so the
    products of a large block are spread over the tasks.
    """
    keyed = materialize(words.select("word", "n", block_key(F.col("word")).alias("key")), "spelling-keyed")
    length = F.aggregate("key", F.lit(0), lambda total, c: total + c)
    fitting = F.greatest(F.lit(1), F.least(F.lit(PART_WORDS), F.floor(F.lit(PART_LETTERS) / length)))
    blocks = materialize(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        .select("key", "size", F.ceil(F.col("size") / fitting).alias("parts")), "spelling-blocks",
    )
    part = F.pmod(F.xxhash64("word"), F.col("parts")).alias("part")
    parts = materialize(
        lookup(keyed, blocks, "key", "size").select("key", part, "word", "n")
        .groupBy("key", "part").agg(F.collect_list(F.struct("word", "n")).alias("held"))
        .select("key", "part", F.col("held.word").alias("words"), F.col("held.n").alias("counts")), "spelling-parts",
    )
    heads = parts.select("key", "part")
    own = F.col("key") == F.col("other")
    pairs = (
        heads.select("key", "part", F.explode(_later_blocks("key")).alias("other"))
        .join(heads.select(F.col("key").alias("other"), F.col("part").alias("other_part")), "other")
        .where(~own | (F.col("part") <= F.col("other_part")))
    )
    left = parts.select("key", "part", F.col("words").alias("a"), F.col("counts").alias("a_n"))
    right = parts.select(
        F.col("key").alias("other"), F.col("part").alias("other_part"), F.col("words").alias("b"),
        F.col("counts").alias("b_n"),
    )
    met = pairs.join(left, ["key", "part"]).join(right, ["other", "other_part"])
    same = own & (F.col("part") == F.col("other_part"))
    return met.select(same, "a", "a_n", "b", "b_n").mapInArrow(_near_pairs, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the last word that following the forms leads to.

    Each round doubles the steps, and a form is five times as frequent as its word, so few rounds are enough.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = materialize(
            now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots"
        )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word of at least six code points and five occurrences: ``word, form, root, n, n_near, form_n``.

    Words are near if they are one inserted, deleted or replaced code point apart; ``n_near`` counts a word's near
    words.  Its form is the most frequent of them (ties: the smallest) if that is at least five times as frequent as
    the word, else null; ``root`` follows the forms to the last.  Null and empty texts have no words, repeated rows
    count each time, an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
    """
    words = materialize(word_counts(docs.select("doc_id", "text")).where(F.col("n") >= LEAST_COUNT), "spelling-words")
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )).alias("x")).select("x.*")
    best = materialize(
        both.groupBy("word").agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
        ).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")),
        "spelling-best",
    )
    strong = F.col("near_n") >= STRONGER * F.col("n")
    judged = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n"),
        ), "spelling-forms",
    )
    last = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The checksum is followed byte by byte over a table of 256 rests; near words share a text with one letter left out.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS rest, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN rest & 1 = 1 THEN xor(rest >> 1, 3988292384) ELSE rest >> 1 END, step + 1 FROM bits WHERE step < 8
), rests AS (SELECT i, rest FROM bits WHERE step = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) AS run
  FROM documents
), kinds AS (
  SELECT row_number() OVER () AS k, id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes
  FROM (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run)
), walk AS (
  SELECT k, 1 AS at, CAST(4294967295 AS BIGINT) AS crc FROM kinds
  UNION ALL
  SELECT w.k, w.at + 1, xor(w.crc >> 8, r.rest)
  FROM walk w JOIN kinds s ON s.k = w.k AND w.at <= len(s.bytes)
  JOIN rests r ON r.i = xor(w.crc & 255, CAST(s.bytes[w.at] AS BIGINT))
), checked AS (
  SELECT s.run, s.n, xor(w.crc, 4294967295) AS crc
  FROM kinds s JOIN walk w ON w.k = s.k AND w.at = len(s.bytes) + 1
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN crc % 199 = 0
      THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word
    FROM checked) GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6
), cuts AS (
  SELECT word, n, p, substr(word, 1, p - 1) AS head, substr(word, p + 1) AS tail
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (p, head, tail) WHERE a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cuts a JOIN words b ON b.word = a.head || a.tail
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cuts a JOIN words b ON b.word = a.head || a.tail
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS root, 0 AS far FROM forms
  UNION ALL SELECT s.word, f.form, far + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(root, far) AS root FROM steps GROUP BY word) l USING (word)
"""
