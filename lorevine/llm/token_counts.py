"""Operator 1: token counts by distinct pre-token, without materialising ids.

No piece of a sentencepiece vocabulary of this kind holds a blank mark after another
character, so no merge crosses the start of a run of blanks. The text, with the blank
that the library puts before it, therefore falls into pre-tokens (a run of blanks and
the characters up to the next run) whose counts add up to that of the text. Each task
keeps a table from pre-token to number of pieces, asks the library once for every
distinct pre-token it meets, joins that table to the frequencies of the pre-tokens of a
document and sums. The table is emptied when it reaches its bound, long pre-tokens are
not kept, and nothing is shuffled, so memory and skew don't depend on the data.

Null or empty text has no tokens. Rows are handled one by one: repeated rows, null ids
and further columns are passed over or through. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.llm import common

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Pre-tokens kept by a task, and the longest that is kept.
TABLE_ROWS, TABLE_CHARS = 1_000_000, 48
#: Characters of texts that are counted together, and pre-tokens of a longer text at once.
GROUP_CHARS, AT_ONCE = 2_000_000, 100_000

#: The library reads both as a blank.
PRE_TOKEN = re.compile("[ ▁]+[^ ▁]*")


class PieceTable:
    """Number of pieces by pre-token, filled once per distinct pre-token."""

    def __init__(self, processor) -> None:
        self.processor = processor
        marks = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in marks):
            raise ValueError("a piece crosses the start of a run of blanks; pre-tokens don't add up")
        self.pieces: dict[str, int] = {}

    def fill(self, tokens: set[str]) -> None:
        """Ask the library for the pre-tokens that the table doesn't have; it adds the first blank itself."""
        if len(self.pieces) + len(tokens) > TABLE_ROWS:
            self.pieces = {}
        new = list(tokens - self.pieces.keys())
        for start in range(0, len(new), AT_ONCE):
            block = new[start : start + AT_ONCE]
            counts = map(len, self.processor.encode([t[1:] for t in block], num_threads=1))
            # A lone blank is one piece, but the library puts none before an empty text.
            self.pieces.update((t, n if len(t) > 1 else 1) for t, n in zip(block, counts, strict=True))

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts: their frequencies joined to the table, and summed."""
        out = [0] * len(texts)
        for first, group in self._groups(texts):
            tokens = set().union(*group)
            self.fill(tokens)
            for i, frequency in enumerate(group):
                out[first + i] += sum(map(mul, map(self.pieces.__getitem__, frequency), frequency.values()))
            for token in tokens:
                if len(token) > TABLE_CHARS:
                    del self.pieces[token]
        return out

    @staticmethod
    def _groups(texts: list[str]) -> Iterator[tuple[int, list[Counter[str]]]]:
        """Frequencies of the pre-tokens of neighbouring texts, or of parts of a long text."""
        first, group, chars = 0, [], 0
        for i, text in enumerate(texts):
            if group and chars + len(text) > GROUP_CHARS:
                yield first, group
                first, group, chars = i, [], 0
            if len(text) <= GROUP_CHARS:
                group.append(Counter(PRE_TOKEN.findall(" " + text) if text else ()))
                chars += len(text)
                continue
            found = (m.group() for m in PRE_TOKEN.finditer(" " + text))
            while part := Counter(islice(found, AT_ONCE)):
                yield i, [part]
            first = i + 1
        if group:
            yield first, group


def count_tokens(documents: DataFrame, model_file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    common.workers_can_import(documents.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import sentencepiece

        pieces = PieceTable(sentencepiece.SentencePieceProcessor(model_file=model_file or public_tokenizers.path(MODEL)))
        for batch in batches:
            tokens = pieces.totals(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = common.document_text(documents)
    kind = dict(texts.dtypes)["doc_id"]
    return (
        texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
        .mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document with the 32k piece model."""
    return count_tokens(common.table(spark, sf_dir, "documents"))
