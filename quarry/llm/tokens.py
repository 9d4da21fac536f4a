"""Token ids of whole documents, written once and read by the operators that lay them out."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bpe, common

#: Long runs without a break go to the segment tree encoder, whose time does not grow with their square.
_RUN = re.compile(r"\S{4000}|\s{500}")
_FAST: dict[str, Encoder] = {}


def has_long_run(text: str) -> bool:
    """Whether _RUN occurs. Such a run holds a whole aligned block of half its least length, and most blocks show at once that it's not
    theirs, so few texts are searched."""
    blanks = any(text[k : k + 250].isspace() for k in range(0, len(text) - 249, 250))
    return (blanks or any(" " not in text[k : k + 2000] for k in range(0, len(text) - 1999, 2000))) and bool(_RUN.search(text))


class Encoder:
    """Ids as the tokenizers library gives them with add_special_tokens=False.

    Where a file's ids follow the order of its merges, the ranks are enough for tiktoken's encoder; else the segment tree encodes."""

    def __init__(self, path: str):
        self.tree = bpe.load(path)
        t = self.tree
        ranks = {b: i for i, b in enumerate(t.bytes_of) if b and i not in t.special.values()}
        ordered = bool((np.diff(t.made) > 0).all()) and len(ranks) == t.size - len(t.special)
        self.fast = tiktoken.Encoding("quarry", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=t.special) if ordered else None
        self.slow = bpe.PieceEncoder(t, keep=50_000)
        self.dtype = t.dtype

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if self.fast is not None and not has_long_run(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(self.dtype)
        return np.frombuffer(b"".join(self.slow.batch([text])[0]), self.dtype)


def encoder(path: str) -> Encoder:
    """One per worker process and path."""
    if path not in _FAST:
        _FAST[path] = Encoder(path)
    return _FAST[path]


SCHEMA = "part int, before long, doc_id long, n long, ids binary"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """part, before (ids of the same part before this document), doc_id, n and ids (little-endian, two bytes each where ids fit, else
    four) of every row; null text counts as empty. Each document ends with end_id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, part, before = encoder(tokenizer), common.partition_id(), 0
        end = np.array([end_id], e.dtype).tobytes()
        for frame in frames:
            for s in range(0, len(frame), 256):
                rows = frame.iloc[s : s + 256]
                ids = [e.ids(x).tobytes() + end if isinstance(x, str) else end for x in rows["text"]]
                n = np.array([len(x) // e.dtype.itemsize for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pd.DataFrame({"part": np.int32(part), "before": starts, "doc_id": rows["doc_id"].astype("Int64").array, "n": n, "ids": ids})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SCHEMA)


def part_offsets(staged: DataFrame) -> dict[int, int]:
    """The ids before each part: a prefix sum over one total for each partition of the input, not for each row."""
    totals = sorted((r["part"], r["n"]) for r in staged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    return dict(zip((p for p, _ in totals), itertools.accumulate((n for _, n in totals), initial=0), strict=False))
