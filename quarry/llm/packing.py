"""Packing by concatenating and cutting.

Documents, each with its end token, form one stream in the order of the input's partitions. The first pass writes the ids and their
number; a prefix sum over the partitions' totals gives every document its place in the stream. The second pass cuts at the multiples
of the window: a document gives one piece for each window that it touches, and the pieces at the ends are the boundary records that
name the window shared with its neighbours, in whatever partition these are. Only the last window can be short.

Defined cases: null or empty text is one end token; a null doc_id stays null; repeated rows are packed as often as they occur; an
empty table gives no pieces; other columns are ignored. Very long texts are cut like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pieces_of(at: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of n >= 1 ids at these places in the stream, for every piece: the document's row, the sequence, and the places in
    the stream of its first id and of the one after its last."""
    first, count = at // window, (at + n - 1) // window - at // window + 1
    row = np.repeat(np.arange(len(at)), count)
    sequence = first[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    return row, sequence, np.maximum(at[row], sequence * window), np.minimum((at + n)[row], (sequence + 1) * window)


def places(frame: pd.DataFrame, bases: dict[int, int]) -> np.ndarray:
    """The place in the stream of each document of a frame of tokenised documents."""
    return frame["part"].map(bases).to_numpy(np.int64) + frame["before"].to_numpy(np.int64)


def cut(staged: DataFrame, bases: dict[int, int], window: int = 1024, with_ids: bool = True) -> DataFrame:
    """The pieces of tokenised documents; ids: four little-endian bytes each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, n = places(frame, bases), frame["n"].to_numpy(np.int64)
            row, sequence, a, b = pieces_of(at, n, window)
            crc, ids, now, raw = [], [], -1, memoryview(b"")
            for r, i, j in zip(row.tolist(), (4 * (a - at[row])).tolist(), (4 * (b - at[row])).tolist(), strict=True):
                if r != now:
                    held = frame["ids"].iat[r]
                    now, raw = r, memoryview(np.frombuffer(held, "<u2" if len(held) == 2 * n[r] else "<u4").astype("<u4").tobytes())
                crc.append(zlib.crc32(raw[i:j]))
                ids.append(bytes(raw[i:j]) if with_ids else None)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64").array[row], "start": a - at[row], "length": b - a, "ids_crc32": crc,
                "doc_tokens": n[row], "sequence_id": sequence, "offset": a % window, "ids": ids,
            })

    return staged.mapInPandas(run, SCHEMA)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a window of the stream."""
    from quarry.llm.common import stage

    if window < 1:
        raise ValueError("window must be positive")
    staged = stage(tokens.tokenise(docs, tokenizer, end_id), "tokens")
    return cut(staged, tokens.part_offsets(staged), window, with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids of each window; a group holds at most `window` ids."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
    )
