"""Sizes of texts in tokens of a public tokenizer, whose vocabulary is read from a file that every machine has."""

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies unless a caller or TOKENIZER_FILE says otherwise.
DEFAULT = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how that vocabulary's texts are broken before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def encoding(path: str = DEFAULT):
    """The tokenizer of a ranks file, loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def sizes(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """(doc_id, n_tokens) of (doc_id, text): whole texts; null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
