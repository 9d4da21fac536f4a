"""Training order: every sequence gets a slot by a keyed permutation, and shards hold the slots in order, at a fixed stride.

A Feistel network permutes the smallest domain of an even number of bits that holds all sequences; values beyond the last sequence
walk on along their cycle until they fall inside, so slots are a permutation of 0 .. n-1 that any reader can compute or invert from
the key alone. Slots are uniform, so cutting their range evenly gives even partitions, without a sample. A shard file is a header
and `shard_slots` records of the same size; slot s is record s % shard_slots of shard s // shard_slots, so a reader that stopped
anywhere goes on by seeking.

Record: sequence id (8 bytes), number of ids (4), CRC-32 of the ids as four-byte values (4), then `window` ids of two or four bytes,
padded with pad_id. All numbers are little-endian.

Defined cases: as for packing; an empty table writes no shard. Repeated rows are sequences of their own.
"""

from __future__ import annotations

import io
import itertools
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, packing, tokens
from quarry.llm.bpe import load

MAGIC = b"QSHD"
HEAD = "<4sIIIQQ"  # magic, window, id bytes, records, shard, first slot
RECORD = "<QII"
_U64 = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """Of 0 .. n-1 under a key."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = _mixed(np.array([(key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1342543DE82EF95) & _U64 for r in range(rounds)], np.uint64))

    def _step(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (_mixed(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (_mixed(right ^ k) & self.mask)
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.uint64)
        if len(x) and int(x.max()) >= self.n:
            raise ValueError("beyond the domain")
        out = self._step(x, keys, back)
        while (out_of := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[out_of] = self._step(out[out_of], keys, back)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self.keys, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def batch(slot: np.ndarray, sequence: np.ndarray, offset: np.ndarray, length: np.ndarray, ids: list) -> bytes:
    """Pieces, packed; their ids follow one another."""
    columns = [slot.astype("<i8"), sequence.astype("<i8"), offset.astype("<i4"), length.astype("<i4")]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([struct.pack("<Q", len(slot)), *(c.tobytes() for c in columns), *ids]))


def unbatch(blob: bytes, width: int) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 8, []
    n = struct.unpack_from("<Q", raw)[0]
    for kind in ("<i8", "<i8", "<i4", "<i4"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(raw, f"<u{width}", -1, at)]


def shard_bytes(k: int, records: int, blobs: list[bytes], window: int, width: int, shard_slots: int, pad_id: int) -> bytes:
    """The file of the k-th shard, from the batches of its pieces in any order."""
    slot, sequence, offset, length, ids = (np.concatenate(x) for x in zip(*(unbatch(b, width) for b in blobs), strict=True))
    body = np.zeros(records, [("sequence", "<u8"), ("n", "<u4"), ("crc", "<u4"), ("ids", f"<u{width}", window)])
    row, length = slot - k * shard_slots, length.astype(np.int64)
    body["sequence"][row] = sequence
    body["n"] = np.bincount(row, length, records)
    body["ids"] = pad_id
    begin = np.cumsum(length) - length
    body["ids"][np.repeat(row, length), np.repeat(offset - begin, length) + np.arange(len(ids))] = ids
    body["crc"] = [zlib.crc32(x[:n].astype("<u4").tobytes()) for x, n in zip(body["ids"], body["n"].tolist(), strict=True)]
    return struct.pack(HEAD, MAGIC, window, width, records, k, k * shard_slots) + body.tobytes()


def shards(docs: DataFrame, tokenizer: str, key: int, path: str, window: int = 1024, end_id: int = 0, pad_id: int = 0, shard_slots: int = 4096, held: int = 32_000_000) -> tuple[int, DataFrame]:
    """Writes the shards below path. Returns the number of sequences and their pieces (slot, sequence_id, doc_id, start, length)."""
    spark = docs.sparkSession
    staged = common.stage(tokens.tokenise(docs, tokenizer, end_id), "tokens")
    bases = tokens.part_offsets(staged)
    total = staged.agg(F.sum("n")).first()[0] or 0
    n = -(-total // window)
    order, width = Permutation(max(n, 1), key), load(tokenizer).dtype.itemsize

    def batched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size = [], 0
        for f in itertools.chain(frames, [None]):
            if f is not None:
                at = packing.places(f, bases)
                row, sequence, a, b = packing.pieces_of(at, f["n"].to_numpy(np.int64), window)
                begin, end, raw = (a - at[row]) * width, (b - at[row]) * width, [memoryview(x) for x in f["ids"]]
                kept.append((order.slot(sequence), sequence, a % window, b - a, [raw[r][i:j] for r, i, j in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True)]))
                size += int(end.sum() - begin.sum())
            if kept and (f is None or size >= held):
                slot, sequence, offset, length = (np.concatenate([k[c] for k in kept]) for c in range(4))
                ids = [x for k in kept for x in k[4]]
                by = np.argsort(slot // shard_slots, kind="stable")
                groups = [g for g in np.split(by, np.flatnonzero(np.diff(slot[by] // shard_slots)) + 1) if len(g)]
                yield pd.DataFrame({
                    "shard": [slot[g[0]] // shard_slots for g in groups],
                    "pieces": [batch(slot[g], sequence[g], offset[g], length[g], [ids[i] for i in g.tolist()]) for g in groups],
                })
                kept, size = [], 0

    def indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = packing.places(f, bases)
            row, sequence, a, b = packing.pieces_of(at, f["n"].to_numpy(np.int64), window)
            ids = f["doc_id"].astype("Int64").array[row]
            yield pd.DataFrame({"slot": order.slot(sequence), "offset": a % window, "sequence_id": sequence, "doc_id": ids, "start": a - at[row], "length": b - a})

    def written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = itertools.chain.from_iterable(zip(f["shard"].tolist(), f["pieces"], strict=True) for f in frames)
        for k, own in itertools.groupby(rows, key=lambda r: r[0]):
            yield pd.DataFrame({"shard": [k], "blob": [shard_bytes(k, min(shard_slots, n - k * shard_slots), [x for _, x in own], window, width, shard_slots, pad_id)]})

    count = -(-n // shard_slots)
    parts = max(1, min(count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 4))))
    by_range = F.floor(F.col("shard") * parts / max(count, 1)).cast("int")
    ranged = staged.mapInPandas(batched, "shard long, pieces binary").repartitionById(parts, by_range)
    common.write_blobs(ranged.sortWithinPartitions("shard").mapInPandas(written, "shard long, blob binary"), path, "\n", "shard")
    index = staged.select("part", "before", "doc_id", "n")  # the ids are not read again
    return n, index.mapInPandas(indexed, "slot long, offset long, sequence_id long, doc_id long, start long, length long")


def records(file: BinaryIO, first: int = 0) -> Iterator[tuple[int, int, int, int, bytes, bool]]:
    """slot, byte offset, sequence, number of ids, ids (as in the file) and whether they are what their CRC says, of the records of a
    seekable shard file from slot `first` on; what lies before is not read."""
    head = file.read(struct.calcsize(HEAD))
    magic, window, width, many, _, start = struct.unpack(HEAD, head)
    if magic != MAGIC:
        raise ValueError("not a shard")
    stride, skip = struct.calcsize(RECORD) + window * width, min(max(0, first - start), many)
    file.seek(len(head) + skip * stride)
    for k in range(skip, many):
        raw = file.read(stride)
        if len(raw) < stride:
            raise ValueError("a shard is cut off")
        sequence, n, crc = struct.unpack_from(RECORD, raw)
        ids = raw[struct.calcsize(RECORD) :][: n * width]
        yield start + k, len(head) + k * stride, sequence, n, ids, zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()) == crc


def _from(spark: SparkSession, path: str, first: int) -> DataFrame:
    """The files (shard, content) that hold slot `first` or later ones; folders of earlier shards are left out by their name."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, shard long").load(path)
    head = files.where("shard = 0").select(F.substring("content", 1, struct.calcsize(HEAD)).alias("h")).first() if first else None
    many = struct.unpack(HEAD, bytes(head["h"]))[3] if head else 1  # the first shard is full if there is another
    return files.where(F.col("shard") >= first // many).select("shard", "content")


def read(spark: SparkSession, path: str, with_ids: bool = False, first: int = 0) -> DataFrame:
    """slot, shard, byte_offset, sequence_id, n_ids, ids_crc32 (of what the file holds), sound, and the ids as four-byte values on
    demand, of slot `first` and all later ones; each task's rows come in the order of slots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard, blob in zip(f["shard"].tolist(), f["content"], strict=True):
                _, window, width, many, _, _ = struct.unpack_from(HEAD, blob)
                if len(blob) != struct.calcsize(HEAD) + many * (struct.calcsize(RECORD) + window * width) + 1:
                    raise ValueError("not a whole shard")
                rows = list(records(io.BytesIO(blob), first))
                ids = [np.frombuffer(r[4], f"<u{width}").astype("<u4").tobytes() for r in rows]
                yield pd.DataFrame({
                    "slot": [r[0] for r in rows], "shard": shard, "byte_offset": [r[1] for r in rows], "sequence_id": [r[2] for r in rows], "n_ids": [r[3] for r in rows],
                    "ids_crc32": [zlib.crc32(x) for x in ids], "sound": [r[5] for r in rows], "ids": ids if with_ids else None,
                })

    out = _from(spark, path, first).mapInPandas(run, "slot long, shard long, byte_offset long, sequence_id long, n_ids long, ids_crc32 long, sound boolean, ids binary")
    return out if with_ids else out.drop("ids")


def follow(spark: SparkSession, path: str, first: int = 0) -> Iterator[tuple[int, bytes]]:
    """slot and ids (as in the files) from slot `first` on, in order, one shard in memory at a time."""
    files = _from(spark, path, first)
    for k in sorted(r["shard"] for r in files.select("shard").distinct().toLocalIterator()):
        for slot, _, _, _, ids, sound in records(io.BytesIO(files.where(F.col("shard") == k).first()["content"]), first):
            if not sound:
                raise ValueError(f"slot {slot} isn't what its CRC says")
            yield slot, ids
