"""Token counts by section with offset-mapped attribution.

Method. A document is encoded once, whole. Token ids give byte lengths, their
running sum gives byte spans, and the UTF-8 lead bytes map those to character
spans. Spans of tokens and sections, both in order, are joined by interval with
binary search. A token that lies in several sections goes to the one that holds
most of its characters, and of equal ones to the first; it also counts as
crossing there.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that splits a text before byte pairs are merged.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.lru_cache(maxsize=4)
def load_encoder(data: bytes):
    """Encoder of a rank file, and the byte length of each token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), lengths


def section_starts(text: str, breaks: re.Pattern) -> np.ndarray:
    """First characters of the sections: 0 and every character after a break, but not the text's end."""
    starts = [0, *(m.end() for m in breaks.finditer(text) if m.end() < len(text))]
    return np.array(list(dict.fromkeys(starts)), dtype=np.int64)


def token_spans(text: str, ids: list[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens; a token that holds part of a character spans that character."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[np.array(ids, dtype=np.int64)])
    starts = np.concatenate(([0], ends[:-1]))
    return char[starts], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    bounds = np.append(sections, length)
    for t in crossing:
        held = range(first[t], last[t] + 1)
        owner[t] = max(held, key=lambda s: (min(ends[t], bounds[s + 1]) - max(starts[t], bounds[s]), -s))
    n = len(sections)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count_tokens(
    docs: DataFrame,
    ranks: bytes,
    id_col: str = "doc_id",
    fields: tuple[str, ...] = ("text",),
    breaks: str = r"\n+",
) -> DataFrame:
    """Tokens of each section of each document.

    ``ranks`` is the content of a rank file (base64 token and rank in each line).
    Fields are joined by a line break and encoded together, once; a section ends
    after ``breaks``, and a field always starts a section.

    Returns one row per document and section: the id column, field, section
    (from 0 in the document), char_start, char_end, n_tokens, n_crossing and
    doc_tokens. Over a document, n_tokens sums to doc_tokens.

    A null field counts as empty. A document without any character has one
    section without tokens, of its first field. Repeated rows get sections each.
    No rows give no rows. Other columns are not read, whatever their names.
    """
    names = list(fields)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary file: a fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = load_encoder(shared.value)
        pattern = re.compile(breaks)
        for batch in batches:
            rows: list[int] = []
            parts: list[tuple[np.ndarray, ...]] = []
            columns = [batch.column(k + 1) for k in range(len(names))]
            for i in range(batch.num_rows):
                texts = [c[i].as_py() or "" for c in columns]
                text = "\n".join(texts)
                at = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
                at_field = at[at < len(text)] if text else at[:1]
                sections = np.union1d(section_starts(text, pattern), at_field)
                ids = encoder.encode_ordinary(text)
                if ids:
                    tokens, crossing = attribute(*token_spans(text, ids, lengths), sections, len(text))
                else:
                    tokens = crossing = np.zeros(len(sections), dtype=np.int64)
                field = np.searchsorted(at, sections, side="right") - 1
                n = len(sections)
                rows += [i] * n
                parts.append((field, np.arange(n), sections, np.append(sections[1:], len(text)), tokens, crossing, np.full(n, len(ids))))
            merged = [np.concatenate(c).astype(np.int64) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * 7
            named = pa.array(names, pa.string()).take(pa.array(merged[0]))
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), named, *map(pa.array, merged[1:])]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, field string, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
    return rows.mapInArrow(count, schema).withColumnRenamed("id", id_col)
