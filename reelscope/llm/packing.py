"""Packing by lexical retrieval: shards with a BM25 index fill the window of each seed with its unused neighbours.

A shard holds fragments that belong together.  A fragment's sketch is a minwise sample of its tokens in which a token counts by
the square of its BM25 weight over the corpus, so two sketches agree about as often as the fragments are alike.  The sketches are
sorted in several orders; each fragment is linked to the neighbour, among those near it in any order, whose sketch agrees most.
Linked fragments follow each other in one order of the whole corpus, which is cut into shards of equal size.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.buckets import components
from reelscope.llm.common import lookup, materialize, measured_joins, mix, table

WINDOW = 2048
END_ID = 1
#: Tokens of the fragments of a shard, on average: a shard's index and fragments are a few megabytes.
SHARD_TOKENS = 1 << 19
BATCH_ROWS = 1000
#: Components of a sketch, orders (each starts at another component), and how far apart in an order sketches are compared.
SKETCH, ORDERS, REACH = 32, 8, 2
K1, B = 1.2, 0.75

#: The pattern that splits texts before the merges, written so that it doesn't go back; both split every text alike.
_SPLITS = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s""",
}
#: A window takes so many neighbours one at a time; if it needs more, the others are sorted.
TAKEN_SINGLY = 16

_worker: dict = {}
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def latin(text: str) -> bool:
    """Whether no character is beyond U+024F; most texts need only the quick test for Latin-1."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _BEYOND_LATIN.search(text)


def distinct(ids: np.ndarray) -> np.ndarray:
    """The sorted different ids, as ``np.unique`` gives them, without its overhead for short arrays."""
    ids = np.sort(ids)
    fresh = np.empty(len(ids), bool)
    fresh[:1] = True
    np.not_equal(ids[1:], ids[:-1], out=fresh[1:])
    return ids[fresh]


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different ids and how often each occurs, as ``np.unique`` gives them."""
    ids = np.sort(ids)
    fresh = np.empty(len(ids), bool)
    fresh[:1] = True
    np.not_equal(ids[1:], ids[:-1], out=fresh[1:])
    starts = np.flatnonzero(fresh)
    times = np.empty_like(starts)
    np.subtract(starts[1:], starts[:-1], out=times[:-1])
    times[-1:] = len(ids) - starts[-1:]
    return ids[starts], times


class Ids:
    """Token ids of texts as ``tokenizers`` gives them.

    With a rank file of the same vocabulary, Latin texts go through ``tiktoken``, which is five times as fast and merges
    alike; for other characters the two libraries' tables of letters could differ, so these texts don't.
    """

    def __init__(self, path: str, ranks: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: Spark gives each core a task of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=_SPLITS.get(public_tokenizers.PATTERN, public_tokenizers.PATTERN),
                mergeable_ranks=merges, special_tokens=special,
            )

    def of(self, text: str) -> np.ndarray:
        if self.fast and latin(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _ids(path: str, ranks: str | None) -> Ids:
    if (path, ranks) not in _worker:
        _worker[path, ranks] = Ids(path, ranks)
    return _worker[path, ranks]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def _cut(path: str, ranks: str | None, window: int):
    """(doc_id, text) to the full windows of a document (their checksums) and the ids that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ids(path, ranks)
        part = TaskContext.get().partitionId() << 33
        row = block = 0
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                uids, tokens, firsts, crcs, rests = [], [], [], [], []
                for text in batch.column(1):
                    ids = encoder.of(text.as_py() or "")
                    n = len(ids) + 1
                    full = n // window
                    uids.append(part + row)
                    row += 1
                    firsts.append(part + block)
                    block += full
                    tokens.append(n)
                    last = np.append(ids[(n - 1) // window * window:], np.uint32(END_ID))
                    blocks = [crc(ids[k * window: (k + 1) * window]) for k in range((n - 1) // window)]
                    crcs.append(blocks if n % window else [*blocks, crc(last)])
                    rest = last if n % window else last[:0]
                    rests.append(rest.astype("<u2" if rest.max(initial=0) < 1 << 16 else "<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids, pa.int64()), batch.column(0), pa.array(tokens, pa.int64()),
                     pa.array(firsts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())],
                    names=["uid", "doc_id", "doc_tokens", "first_block", "blocks", "rest"],
                )

    return run


def _unpack(rest: bytes, tokens: int, window: int) -> np.ndarray:
    return np.frombuffer(rest, "<u2" if len(rest) == 2 * (tokens % window) else "<u4")


def _frequencies(window: int):
    """(doc_tokens, rest) to (token, df): in how many fragments of the task each token stands; token -1 counts fragments."""

    def run(batches):
        seen = np.zeros(1, np.int64)
        fragments = 0
        for batch in batches:
            for n, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = distinct(_unpack(rest, n, window)).astype(np.int64)
                if len(ids):
                    fragments += 1
                    if ids[-1] >= len(seen):
                        seen = np.concatenate([seen, np.zeros(int(ids[-1]) + 1 - len(seen), np.int64)])
                    seen[ids] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], fragments))], names=["token", "df"]
        )

    return run


def _sketches(window: int, known):
    """(uid, doc_tokens, rest) to (uid, tokens, sketch): per component the token of the fragment with the smallest draw."""

    def run(batches):
        weights = np.maximum(known.value[0], 1e-9) ** 2
        draws = np.random.default_rng(9).exponential(size=(len(weights), SKETCH))
        draws = (draws / weights[:, None]).astype(np.float32)
        for batch in batches:
            sketches = []
            for n, rest in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = distinct(_unpack(rest, n, window))
                sketches.append(ids[draws.take(ids, axis=0).argmin(axis=0)].astype(">u2").tobytes())
            tokens = [n % window for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(sketches, pa.binary())],
                names=["uid", "tokens", "sketch"],
            )

    return run


def _best_near(batches):
    """Sorted (tree, turned, unit) to (unit, other, score): the sketch within ``REACH`` rows that agrees most.

    Among equals a hash of the pair decides, the same from both sides, so that links pair up and don't run in chains.
    """
    tree, units = np.empty(0, np.int64), np.empty(0, np.int64)
    marks = np.empty((0, SKETCH), ">u2")
    for batch in batches:
        tree = np.concatenate([tree[-REACH:], np.array(batch.column(0).to_pylist(), np.int64)])
        turned = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, SKETCH)
        marks = np.concatenate([marks[-REACH:], turned])
        units = np.concatenate([units[-REACH:], np.array(batch.column(2).to_pylist(), np.int64)])
        score, other = np.full(len(units), -1), units.copy()
        for d in range(1, min(REACH, len(units) - 1) + 1):
            agree = (marks[:-d] == marks[d:]).sum(axis=1)
            chance = (mix((units[:-d] ^ units[d:]).view(np.uint64)) >> np.uint64(33)).astype(np.int64)
            now = np.where((agree > 0) & (tree[:-d] == tree[d:]), agree << 31 | chance, -1)
            for mine, theirs in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                better = now > score[mine]
                score[mine][better] = now[better]
                other[mine][better] = units[theirs][better]
        found = score >= 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(units[found]), pa.array(other[found]), pa.array(score[found])], names=["unit", "other", "score"]
        )


def _running(batches):
    """(uid, tokens) to (uid, part, before, upto): the tokens of the task before and with each row."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        tokens = np.array(batch.column(1).to_pylist(), np.int64)
        upto = total + np.cumsum(tokens)
        total = int(upto[-1]) if len(upto) else total
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(upto), part, np.int64)), pa.array(upto - tokens), pa.array(upto)],
            names=["uid", "part", "before", "upto"],
        )


def _shards(fragments: DataFrame, known, window: int, shard_tokens: int) -> DataFrame:
    """``uid, shard``: the corpus in one order, linked fragments together, cut after every ``shard_tokens`` tokens.

    Equal sketches are one unit, so a group of copies of any size costs one comparison an order, and the order ends with
    the row, so such a group is cut like everything else.
    """
    spark = fragments.sparkSession
    sketches = materialize(fragments.select("uid", "doc_tokens", "rest").mapInArrow(
        _sketches(window, known), "uid long, tokens long, sketch binary"
    ), "pack-sketches")
    units = materialize(
        sketches.groupBy("sketch").agg(F.min("uid").alias("unit"), F.count(F.lit(1)).alias("n")), "pack-units"
    )
    step = 2 * (SKETCH // ORDERS)
    turned = F.expr(f"concat(substring(sketch, {step} * tree + 1), substring(sketch, 1, {step} * tree))")
    orders = units.select("unit", "sketch", F.explode(F.array(*map(F.lit, range(ORDERS)))).alias("tree"))
    sorted_ = (
        orders.select("tree", turned.alias("turned"), "unit").repartitionByRange("tree", "turned", "unit")
        .sortWithinPartitions("tree", "turned", "unit")
    )
    near = sorted_.mapInArrow(_best_near, "unit long, other long, score long")
    best = near.groupBy("unit").agg(F.max_by("other", F.struct("score", "other")).alias("other"))
    classes = materialize(components(best.select(F.col("unit").alias("u"), F.col("other").alias("v"))), "pack-classes")
    linked = materialize(units.join(classes, "unit", "left").withColumn("class", F.coalesce("class", "unit")), "pack-linked")
    homes = linked.groupBy("class").agg(F.min("sketch").alias("home"))
    answers = materialize(linked.join(homes, "class").select("sketch", "n", "home"), "pack-homes")
    placed = lookup(sketches, answers, "sketch", "n").select("uid", "tokens", "home", "sketch")
    order = ("home", "sketch", "uid")
    running = materialize(
        placed.repartitionByRange(*order).sortWithinPartitions(*order).select("uid", "tokens")
        .mapInArrow(_running, "uid long, part long, before long, upto long"), "pack-running",
    )
    parts = sorted(map(tuple, running.groupBy("part").agg(F.max("upto")).collect()))  # one row a task
    starts = np.cumsum([0, *[n for _, n in parts]]).tolist()
    size = -(-starts[-1] // max(1, -(-starts[-1] // shard_tokens))) or 1
    begins = spark.createDataFrame([(p, at) for (p, _), at in zip(parts, starts)], "part long, begin long")
    return running.join(F.broadcast(begins), "part").select(
        "uid", F.floor((F.col("begin") + F.col("before")) / F.lit(size)).cast("long").alias("shard")
    )


class Bm25Shard:
    """Inverted index over the fragments of a shard: postings by token with their BM25 weights."""

    def __init__(self, fragments: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        docs, tokens, weights = [], [], []
        for i, ids in enumerate(fragments):
            which, tf = counted(ids)
            useful = idf[which] > 0
            which, tf = which[useful], tf[useful]
            docs.append(np.full(len(which), i, np.int32))
            tokens.append(which)
            weights.append(idf[which] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length)))
        self.terms = tokens
        self.size = len(fragments)
        token = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
        order = np.argsort(token, kind="stable")
        self.docs = np.concatenate(docs)[order] if docs else np.empty(0, np.int32)
        self.weights = np.concatenate(weights)[order] if weights else np.empty(0)
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(idf)))])
        self.places = np.arange(len(token))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every fragment for the terms of fragment ``seed``."""
        starts, stops = self.bounds[self.terms[seed]], self.bounds[self.terms[seed] + 1]
        lengths = stops - starts
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        if not total:
            return np.zeros(self.size)
        at = np.repeat(starts - upto + lengths, lengths)
        at += self.places[:total]
        return np.bincount(self.docs.take(at), weights=self.weights.take(at), minlength=self.size)


def best_first(score: np.ndarray, unused: np.ndarray):
    """The unused fragments by falling score, the first of equals first; the few that a window mostly takes need no sort."""
    left = np.where(unused, score, -np.inf)
    for _ in range(TAKEN_SINGLY):
        i = int(left.argmax())
        if left[i] == -np.inf:
            return
        left[i] = -np.inf
        yield i
    order = np.flatnonzero(left > -np.inf)
    yield from order[np.argsort(-left[order], kind="stable")].tolist()


def fill_windows(lengths: list[int], neighbours, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (fragment, from, to).  ``neighbours(i)`` scores all fragments for seed ``i``.

    The seed is the rest of the fragment that was cut last, or else the longest unused one.  Its unused neighbours follow
    by score; what doesn't fit is cut, so only the last window can have room left.
    """
    queue = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    begun = [0] * len(lengths)
    unused = np.array(lengths) > 0
    windows, ahead, cut = [], 0, None
    while True:
        if cut is None:
            while ahead < len(queue) and not unused[queue[ahead]]:
                ahead += 1
            if ahead == len(queue):
                return windows
        seed = queue[ahead] if cut is None else cut
        cut, room, taken = None, window, []

        def take(i: int) -> None:
            nonlocal room, cut
            n = min(room, lengths[i] - begun[i])
            taken.append((i, begun[i], begun[i] + n))
            begun[i] += n
            room -= n
            if begun[i] == lengths[i]:
                unused[i] = False
            else:
                cut = i

        take(seed)
        if room:
            for i in best_first(neighbours(seed), unused):
                take(i)
                if not room:
                    break
        windows.append(taken)


_PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the ids of its whole text and the end id; a null text is empty and has the end id alone.  Its
    full windows are sequences of their own.  The fragment that is left goes to the shard of the fragments it is linked to
    (:func:`_shards`; shards have equal numbers of tokens, whatever is copied or repeated); token statistics for BM25 come from all
    fragments of all shards and are bounded by the vocabulary.  Tokens in more than half of the fragments weigh nothing.
    Only the last sequence of a shard has padding.  An empty table gives no rows; only the id and the text are read.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = materialize(rows.mapInArrow(
        _cut(tokenizer_path, ranks_path, window),
        f"uid long, doc_id {kind}, doc_tokens long, first_block long, blocks array<bigint>, rest binary",
    ), "pack-cut")
    fragments = cut.where(F.col("doc_tokens") % window > 0)
    counted = fragments.select("doc_tokens", "rest").mapInArrow(_frequencies(window), "token long, df long")
    df = counted.groupBy("token").agg(F.sum("df").alias("df")).toArrow()
    total = fragments.agg(F.sum(F.col("doc_tokens") % window)).first()[0] or 0
    df = dict(zip(df.column("token").to_pylist(), df.column("df").to_pylist()))
    n = df.pop(-1, 0)
    idf = np.zeros(max(df, default=0) + 1)
    for token, count in df.items():
        idf[token] = max(0.0, np.log((n - count + 0.5) / (count + 0.5)))
    known = docs.sparkSession.sparkContext.broadcast((idf, total / max(n, 1)))
    many = total > SHARD_TOKENS
    schema = _PIECES.format(kind)

    def fill(group: pa.Table) -> pa.Table:
        idf, mean_length = known.value
        group = group.combine_chunks().sort_by("uid")
        tokens = group.column("doc_tokens").to_pylist()
        ids = [_unpack(x, t, window) for x, t in zip(group.column("rest").to_pylist(), tokens)]
        shard = group.column("shard")[0].as_py()
        index = Bm25Shard(ids, idf, mean_length)
        out = []
        for w, taken in enumerate(fill_windows([len(x) for x in ids], index.scores, window)):
            offset = 0
            for i, a, b in taken:
                out.append((i, tokens[i] // window * window + a, b - a, crc(ids[i][a:b]), tokens[i],
                            2 * (shard << 32 | w) + 1, offset))
                offset += b - a
        columns = list(zip(*out))
        return pa.table(
            [group.column("doc_id").take(pa.array(columns[0])), *[pa.array(c, pa.int64()) for c in columns[1:]]],
            names=[x.split()[0] for x in schema.split(", ")],
        )

    rests = fragments.select("uid", "doc_id", "doc_tokens", "rest")
    with measured_joins(docs.sparkSession):
        shards = _shards(fragments, known, window, SHARD_TOKENS) if many else None
    placed = rests.join(shards.hint("merge"), "uid") if many else rests.withColumn("shard", F.lit(0).cast("long"))
    filled = placed.groupBy("shard").applyInArrow(fill, schema)
    blocks = cut.select("doc_id", "doc_tokens", "first_block", F.posexplode("blocks").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
        "ids_crc32", "doc_tokens", (2 * (F.col("first_block") + F.col("k"))).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return filled.unionByName(blocks)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """:func:`pack` with the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
