r"""Token counts: each document is encoded once, and its tokens are attributed to sections by their offsets.

The encoder is byte-level and lossless, so token lengths in bytes, looked up by
id and summed, are exact offsets into the UTF-8 text; no second encoding of
parts is made. Sections are the stretches that end with a line feed (the line
feed belongs to the section it ends; what follows the last one is a section
too, so every text has one more section than line feeds). The interval join of
tokens and sections is a binary search over both sorted lists.

A token that crosses a boundary counts once, by ``rule``: "majority" gives it
to the section with most of its bytes, the earliest of equals; "first" and
"last" to the section of its first or last byte. So a document's sections sum
to its tokens. Null and empty texts have one section without tokens. Very long
texts are encoded whole. Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelspan.llm.common import pieces, text_bytes
from reelspan.llm.quality import lines_of

RULES = ("majority", "first", "last")
RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str | None = None, pattern: str | None = None):
    """An encoder for a file of ranks, and each id's length in bytes; by default the public vocabulary installed with ``public_tokenizers``."""
    import tiktoken

    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary; both tile the same bytes from 0 on."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    crossing = last > first
    if rule == "last":
        return last, crossing
    section = first.copy()
    if rule == "majority" and crossing.any():
        at = np.flatnonzero(crossing)
        each = last[at] - first[at] + 1
        token = np.repeat(np.arange(len(at)), each)
        s = np.repeat(first[at] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        begin = np.maximum(np.where(s > 0, section_ends[s - 1], 0), starts[at][token])
        size = np.minimum(section_ends[s], token_ends[at][token]) - begin
        order = np.lexsort((s, -size, token))
        section[at] = s[order[np.searchsorted(token[order], np.arange(len(at)))]]
    return section, crossing


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: str = "majority", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, section, n_chars, n_tokens and n_crossing (tokens given to it that cross a boundary), a row for each section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = encoder(path, pattern)
        for batch in batches:
            for part in pieces(batch, text):
                data, offsets = text_bytes(part.column(text))
                ids = [coder.encode_to_numpy(t) for t in part.column(text).to_pylist() if t]
                size = lengths[np.concatenate(ids)] if ids else np.zeros(0, np.int64)
                ends = np.cumsum(size)
                if (ends[-1] if len(ends) else 0) != len(data):
                    raise ValueError("tokens don't cover the text")
                begin, end, row = lines_of(data, offsets, np.flatnonzero(data == 10))
                tile = np.append(begin[1:], len(data))  # with the line feed
                section, crossing = attribute(ends, tile, rule) if len(ends) else (np.zeros(0, np.int64), np.zeros(0, bool))
                lead = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
                number = np.arange(len(row)) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id).take(pa.array(row)), pa.array(number), pa.array(lead[tile] - lead[begin]), pa.array(np.bincount(section, minlength=len(row))), pa.array(np.bincount(section[crossing], minlength=len(row)))],
                    names=[doc_id, "section", "n_chars", "n_tokens", "n_crossing"],
                )

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, section bigint, n_chars bigint, n_tokens bigint, n_crossing bigint")
