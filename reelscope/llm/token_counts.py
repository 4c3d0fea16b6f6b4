"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import table

BATCH_BYTES = 1 << 20
MEMORY_PIECES = 1_000_000

#: Other white space that such tokenizers drop as well.
_BLANKS = dict.fromkeys(map(ord, "\t\n\r"), " ")

_worker: dict = {}


def _piece_lengths(path: str) -> tuple[object, dict[str, int]]:
    """The tokenizer and the lengths known so far, once per worker process."""
    if _worker.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: Spark gives each core a task of its own
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _worker.update(path=path, tokenizer=tokenizer, lengths={"": 0})
    return _worker["tokenizer"], _worker["lengths"]


def _learn(tokenizer, lengths: dict[str, int], pieces: Iterator[str]) -> None:
    """Encode new pieces in batches of about ``BATCH_BYTES`` characters; keep their lengths."""
    pieces = iter(pieces)
    while batch := list(islice(pieces, 4096)):
        while batch:
            size = upto = 0
            while upto < len(batch) and (upto == 0 or size + len(batch[upto]) <= BATCH_BYTES):
                size += len(batch[upto])
                upto += 1
            some, batch = batch[:upto], batch[upto:]
            for piece, got in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                lengths[piece] = len(got)


def count_batches(path: str, limit: int):
    """A function for ``mapInArrow`` over (id, text): id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, lengths = _piece_lengths(path)
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            sizes = [len(x.encode()) for x in texts]
            counts: list[int] = []
            at = 0
            while at < len(texts):
                upto, held = at, 0
                while upto < len(texts) and (upto == at or held + sizes[upto] <= BATCH_BYTES):
                    held += sizes[upto]
                    upto += 1
                split = [x.translate(_BLANKS).split(" ") for x in texts[at:upto]]
                new = set(chain.from_iterable(split)).difference(lengths)
                if len(lengths) + len(new) > MEMORY_PIECES:
                    lengths.clear()
                    lengths[""] = 0
                    new = set(chain.from_iterable(split)) - {""}
                _learn(tokenizer, lengths, new)
                counts += [sum(map(lengths.__getitem__, pieces)) for pieces in split]
                at = upto
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of each whole text; null counts as empty (0 bytes, 0 tokens).

    For tokenizers whose pieces never reach across a space (white space dropped, such as ``word_bpe_49k.json``): a text
    is split at its spaces, which are safe boundaries, so a very long text is many short pieces and there is no
    long call.  New pieces are encoded in batches of bounded size; a worker remembers the lengths of at most
    ``MEMORY_PIECES`` pieces.  Special strings in a text count as the library's default has it: none contains a space.
    Repeated rows and ids are counted row by row; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(
        count_batches(tokenizer_path, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
    return out.withColumnRenamed("doc_id", id_col)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
