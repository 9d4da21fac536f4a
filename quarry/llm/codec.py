"""Encoding to ids and decoding back, by the segment tree of quarry.llm.bpe.

Defined cases: null text counts as empty and gives no ids; special tokens' strings in a text become their ids; a null doc_id stays
null; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bpe


class Decoder:
    """Text of ids; the bytes of runs of ids that came before are kept, within a bound."""

    def __init__(self, path: str, keep: int = 300_000):
        self.tree, self.keep, self.known = bpe.load(path), keep, {}
        self.code = self.tree.dtype.char  # of the machine's byte order, which is little-endian as the tree's dtype

    def run(self, ids: bytes) -> bytes:
        """The bytes that a run of ids, as an array of the tree's dtype, stands for."""
        found = self.known.get(ids)
        if found is None:
            if len(self.known) > self.keep:
                self.known.clear()
            table = self.tree.bytes_of
            found = self.known[ids] = b"".join([table[i] for i in memoryview(ids).cast(self.code)])
        return found

    def text(self, runs: list[bytes]) -> str:
        return b"".join(map(self.run, runs)).decode("utf-8", "replace")


_HELD: dict[str, tuple[bpe.PieceEncoder, Decoder]] = {}


def _held(path: str) -> tuple[bpe.PieceEncoder, Decoder]:
    if path not in _HELD:
        _HELD[path] = bpe.PieceEncoder(bpe.load(path)), Decoder(path)
    return _HELD[path]


def _texts(frame: pd.DataFrame) -> list[str]:
    return [x if isinstance(x, str) else "" for x in frame["text"]]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row's text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, _ = _held(tokenizer)
        for frame in frames:
            for s in range(0, len(frame), 256):
                rows = frame.iloc[s : s + 256]
                ids = [np.frombuffer(b"".join(v), e.bpe.dtype).astype(np.int32) for v in e.batch(_texts(rows))]
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").array, "ids": ids})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of every row's ids; null ids give null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, d = _held(tokenizer)
        for frame in frames:
            text = [None if x is None else d.text([np.asarray(x, d.tree.dtype).tobytes()]) for x in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").array, "text": text})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, d = _held(tokenizer)
        names = [str(i) for i in range(e.bpe.size)]
        for frame in frames:
            texts, rows = _texts(frame), []
            for part in bpe.batches_of(texts):
                for runs in e.batch(part):
                    ids = np.frombuffer(b"".join(runs), e.bpe.dtype)
                    listed = ",".join(map(names.__getitem__, ids.tolist()))
                    rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(d.text(runs).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").array, "n_tokens": np.array(n, np.int64), "ids_sha256": list(a), "decoded_sha256": list(b)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
