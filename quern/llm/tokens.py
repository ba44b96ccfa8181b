"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Folder and file of the vocabulary; the folder must exist on every executor.
TOKENIZERS, VOCABULARY = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern of the public byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document with an id and a text; an empty text has 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(folder, name)
        for x in batches:
            yield pd.DataFrame({"doc_id": x.doc_id, "source": x.source, "tokens": [len(e.encode_ordinary(t)) for t in x.text]})

    x = documents.where("doc_id is not null and text is not null").select("doc_id", "source", "text")
    return x.mapInPandas(count, "doc_id long, source string, tokens long")
