"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone by the library; those that give one token are proven
whole. A text is cut into pieces and these into lower-cased pre-tokens; a pre-token that is a proven string counts as one
token, and only the rest goes through the library's merges. Counts of short pieces are kept by worker, in a bounded table.
Rows are independent: no shuffle, no skew. A very long text is one row's work, and its pieces are looked up one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skeinwork.llm.common import few_rows, text_bytes
from skeinwork.llm.units import WordIds, byte_alphabet, library, loaded

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
LIMIT = 2048
_END = "</w>"


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings, without their word-end mark, whose own encoding is one token; found by encoding each."""
    tokenizer = library(path)
    code = {c: b for b, c in enumerate(byte_alphabet())}
    words = []
    for w in tokenizer.get_vocab(with_added_tokens=False):
        if w.endswith(_END) and len(w) > len(_END):
            try:
                words.append(bytes(map(code.__getitem__, w[: -len(_END)])).decode())
            except UnicodeDecodeError:  # part of a character
                continue
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, encoded, strict=True) if len(e.ids) == 1)


class Counts(WordIds):
    """Piece to its number of tokens; proven pre-tokens are never merged."""

    def __init__(self, path: str):
        super().__init__(path)
        self.known = dict.fromkeys(whole_tokens(path), 1)
        self.parts = dict(self.known)

    def value(self, ids: list[int]) -> int:
        return len(ids)

    def joined(self, values: list[int]) -> int:
        return sum(values)

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, self.cut(text)))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs; a null text counts as empty (0 bytes, 0 tokens).

    Repeated rows are counted one by one, null ids are passed on, an empty table gives no rows, other columns are left out.
    The vocabulary file's path must be the same on all executors; each worker proves the strings once from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(Counts, path)
        for batch in few_rows(batches):
            size = [len(x) for x in text_bytes(batch.column(1))]
            n = [counter.of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)
