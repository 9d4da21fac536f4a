"""Chroma fingerprints of audio columns, and the alignment of recordings by them.

A recording (a binary WAV of 8, 16, 24 or 32-bit PCM) is cut into overlapping frames; the energy of each frame's spectrum is folded into the
twelve pitch classes, smoothed over five frames and brought to unit length. Sixteen filters compare sums of rectangles of sixteen
frames, read from an integral image; each filter's value falls into one of four classes, coded in two bits so that neighbouring
classes differ in one bit; together they make one packed integer for each position.

Two recordings match if at some offset their lists overlap by LEAST positions at least (about 3 s of audio; where half the longer
list is less, by that half) and at most `errors` of the overlapping bits differ. So an excerpt matches however long the whole is,
and no integer need be equal. Lists that are equal are one class and are compared once.

Candidates come from an offset histogram: an offset gets a vote for every two bytes that are equal at a position and again APART
positions later, for each of the six pairs of bytes; of a run of the same bytes only both ends vote. A vote counts if the integers
at eight positions around it (AROUND, as far as both lists have them) differ in at most LOOSE times `errors` of their bits. Votes whose
whole overlap is alike put lists into components, in two rounds: first each row of a key gives two votes, the best of all and the best
among earlier rows, which joins most groups; then all votes that count between lists of different components are decided, so a
better vote that proves wrong hides none. Inside a component all pairs with a vote are decided by the bits of their offsets, and links
are counted there and never written as pairs. Keys and components of more than `block` rows are cut into parts, and each two parts meet
in a place of their own. This is a filter and not a proof: bit errors can be spread so that a match gets no vote, as the README says.
Lists that may match by less than LEAST also vote by equal integers.

Defined cases: null audio and audio that can't be read give an empty list, which matches nothing but is a class with its like; so does
audio that is shorter than one filter, whose like has equal samples; rows with a null id take no part and get null class and links; equal ids are told apart by their lists;
repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stage
from quarry.llm.components import components

RATE, FRAME, HOP = 11025, 2048, 1024
WIDE = 16
GRAY = np.array([0, 1, 3, 2], np.uint64)
#: The bounds between the four classes of a filter's value.
BOUNDS = (-0.12, 0.0, 0.12)
#: The least overlap of a match, in positions.
LEAST = 16
APART = 2
BYTES = [(0, 1), (2, 3), (1, 3), (0, 2), (0, 3), (1, 2)]
AROUND = range(-7, 8, 2)
LOOSE = 1.5


def filters() -> list[tuple[int, int, int, int]]:
    """kind, first pitch class, pitch classes, frames; by a rule: kinds by turns, places and sizes in steps."""
    return [(k % 4, 5 * k % 9, 2 + k % 3, (4, 8, 16)[k % 3]) for k in range(16)]


def samples(blob: bytes | None) -> np.ndarray:
    """Mono samples at RATE, from -1 to 1."""
    try:
        with wave.open(io.BytesIO(blob or b"")) as f:
            raw, wide, rate = f.readframes(f.getnframes()), f.getsampwidth(), f.getframerate()
            if wide == 3:  # the low byte of four is zero
                x = np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 3), ((0, 0), (1, 0))).view("<i4")[:, 0] / 2**31
            elif wide == 1:
                x = np.frombuffer(raw, np.uint8) / 128 - 1
            else:
                x = np.frombuffer(raw, f"<i{wide}") / 2.0 ** (8 * wide - 1)
            x = x.reshape(-1, f.getnchannels()).mean(1)
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0)
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)
    return x


def wav(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _folding() -> tuple[np.ndarray, slice, np.ndarray]:
    """The window of a frame, the frequencies used, and which pitch class each belongs to; the same for all recordings."""
    freq = np.arange(FRAME // 2 + 1) * RATE / FRAME
    used = np.flatnonzero((freq >= 55) & (freq <= 3520))
    fold = np.zeros((len(used), 12))
    fold[np.arange(len(used)), np.round(12 * np.log2(freq[used] / 440)).astype(int) % 12] = 1
    return np.hanning(FRAME), slice(int(used[0]), int(used[-1]) + 1), fold


HANN, USED, FOLD = _folding()
#: Frames analysed at a time, so that a long recording needs little more memory than itself.
AT_ONCE = 256


def chroma(x: np.ndarray) -> np.ndarray:
    """A row of twelve for each frame."""
    n = (len(x) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    energy = np.concatenate([np.abs(np.fft.rfft(frames[k : k + AT_ONCE] * HANN, axis=1)[:, USED]) ** 2 @ FOLD for k in range(0, n, AT_ONCE)])
    weight = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
    smooth = np.stack([np.convolve(energy[:, c], weight, "same") for c in range(12)], 1)
    size = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.divide(smooth, size, out=np.zeros_like(smooth), where=size > 1e-6)


def fingerprint(x: np.ndarray) -> np.ndarray:
    image = chroma(x)
    n = len(image) - WIDE + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(x0: np.ndarray, x1: np.ndarray, y0: int, y1: int) -> np.ndarray:
        return total[x1, y1] - total[x0, y1] - total[x1, y0] + total[x0, y0]

    out = np.zeros(n, np.uint64)
    for kind, y, high, wide in filters():
        y1, ym, tm = min(12, y + high), y + max(1, min(12, y + high) - y) // 2, t + wide // 2
        whole = area(t, t + wide, y, y1)
        if kind == 0:  # earlier against later
            part = area(t, tm, y, y1)
        elif kind == 1:  # lower against higher
            part = area(t, t + wide, y, max(ym, y + 1))
        elif kind == 2:  # crossed quarters
            part = area(t, tm, y, ym) + area(tm, t + wide, ym, y1)
        else:  # the middle against both sides
            part = area(t + wide // 4, t + wide - wide // 4, y, y1)
        value = np.log1p(part) - np.log1p(np.maximum(whole - part, 0))
        out = out << np.uint64(2) | GRAY[np.digitize(np.round(value, 9), BOUNDS)]
    return out.astype(np.uint32)


def differ(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """The share of bits that differ where b, moved by offset, overlaps a."""
    x, y = a[max(0, -offset) :], b[max(0, offset) :]
    m = min(len(x), len(y))
    return float(np.bitwise_count(x[:m] ^ y[:m]).sum()) / (32 * m)


def least_overlap(n: int, m: int) -> int:
    """Of lists of n and m positions."""
    return min(LEAST, (max(n, m) + 1) // 2)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Of all offsets of b against a with the least overlap: that with the least share of differing bits, its overlap, and the share."""
    least = least_overlap(len(a), len(b))
    if not least or min(len(a), len(b)) < least:
        return 0, 0, 1.0
    share, _, offset = min((differ(a, b, k), abs(k), k) for k in range(least - len(a), len(b) - least + 1))
    return offset, min(len(a) - max(0, -offset), len(b) - max(0, offset)), share


def postings(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that vote, and their positions."""
    part = [fp >> np.uint32(8 * k) & np.uint32(255) for k in range(4)]
    keys = []
    for kind, (i, j) in enumerate(BYTES):
        two = (part[i] << np.uint32(8) | part[j]).astype(np.int64)
        keys.append(kind << 32 | two[:-APART] << 16 | two[APART:])
    if len(fp) < 2 * LEAST:
        keys.append(len(BYTES) << 32 | fp.astype(np.int64))
    at = []
    for k, key in enumerate(keys):
        new = np.concatenate([[True], key[1:] != key[:-1], [True]])[: len(key) + 1]
        at.append(np.flatnonzero(new[:-1] | new[1:]))
        keys[k] = key[at[-1]]
    return np.concatenate(keys), np.concatenate(at)


def around(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each of the positions: the integers AROUND it, 0 for those that are missing."""
    off = at[:, None] + np.array(AROUND)
    there = (off >= 0) & (off < len(fp))
    return np.where(there, fp[np.where(there, off, 0)], 0).astype(np.uint32)


def alike(n: np.ndarray, at: np.ndarray, near: np.ndarray, x: np.ndarray, y: np.ndarray, errors: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the votes of rows x for rows y count, and how many bits differ AROUND those that do."""
    offset = at[y] - at[x]
    overlap = np.minimum(n[x] + np.minimum(offset, 0), n[y] - np.maximum(offset, 0))
    stay = np.flatnonzero(overlap >= np.minimum(LEAST, (np.maximum(n[x], n[y]) + 1) // 2))
    x, y = x[stay], y[stay]
    off = np.array(AROUND)
    both = (off >= -np.minimum(at[x], at[y])[:, None]) & (off < np.minimum(n[x] - at[x], n[y] - at[y])[:, None])
    wrong = (np.bitwise_count(near[x] ^ near[y]) * both).sum(1, dtype=np.int64)
    counts = wrong <= LOOSE * errors * 32 * both.sum(1)
    return stay[counts], wrong[counts]


def votes(group: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, near: np.ndarray, errors: float, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows that come in the order of group: x, y and the bits that differ, of the votes that count of each two rows of a group, of
    different nodes (and sides, if given), in runs that hold all later rows y of their rows x."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.repeat(np.append(starts[1:], len(group)), np.diff(np.append(starts, len(group))))
    after = ends - np.arange(len(group)) - 1
    begun = np.concatenate([[0], np.cumsum(after)])
    at_row = 0
    while at_row < len(group):
        to = max(at_row + 1, int(np.searchsorted(begun, begun[at_row] + 200_000, "right")) - 1)
        x = np.repeat(np.arange(at_row, to), after[at_row:to])
        y = x + 1 + np.arange(len(x)) - (begun[x] - begun[at_row])
        stay = node[x] != node[y]
        if side is not None:
            stay &= side[x] != side[y]
        x, y = x[stay], y[stay]
        stay, wrong = alike(n, at, near, x, y, errors)
        yield x[stay], y[stay], wrong
        at_row = to


def best_votes(group: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, near: np.ndarray, errors: float, side: np.ndarray | None = None) -> pd.DataFrame:
    """a, b and offset of two votes of each row at most: that with the fewest differing bits, and that among earlier rows. A first
    choice only: votes_across gives the rest."""
    none = np.iinfo(np.int64).max
    best = np.full((2, len(group)), none)
    for x, y, wrong in votes(group, node, n, at, near, errors, side):
        np.minimum.at(best[0], x, wrong << 40 | y)
        np.minimum.at(best[0], y, wrong << 40 | x)
        np.minimum.at(best[1], y, wrong << 40 | x)
    x = np.concatenate([np.flatnonzero(b < none) for b in best])
    y = np.concatenate([b[b < none] & (1 << 40) - 1 for b in best])
    x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
    return pd.DataFrame({"a": node[x], "b": node[y], "offset": at[y] - at[x]}).drop_duplicates()


def votes_across(group: np.ndarray, root: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, near: np.ndarray, errors: float, side: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """a, b and offset of every vote that counts, of rows of different roots."""
    for x, y, _ in votes(group, root, n, at, near, errors, side):
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        yield pd.DataFrame({"a": node[x], "b": node[y], "offset": at[y] - at[x]}).drop_duplicates()


def linked(lists: list[np.ndarray], side: np.ndarray, errors: float) -> np.ndarray:
    """The number of lists that each one matches, of those of the other side, or of all if there is one side."""
    each = [postings(x) for x in lists]
    owner = np.repeat(np.arange(len(lists)), [len(k) for k, _ in each])
    key, at = np.concatenate([k for k, _ in each]), np.concatenate([a for _, a in each])
    near = np.concatenate([around(x, a) for x, (_, a) in zip(lists, each, strict=True)])
    order = np.argsort(key, kind="stable")  # rows of a key stay in the order of their lists
    key, owner, at, near = key[order], owner[order], at[order], near[order]
    size = np.array([len(x) for x in lists])
    sides = side[owner] if side.min() != side.max() else None
    seen: list[np.ndarray] = []
    for x, y, _ in votes(key, owner, size[owner], at, near, errors, sides):
        seen.append(np.unique(np.stack([owner[x], owner[y], at[y] - at[x]], 1), axis=0))
    found = np.unique(np.concatenate(seen), axis=0) if seen else np.zeros((0, 3), int)
    hit = np.zeros(len(found), bool)
    kinds, kind = np.unique(np.stack([found[:, 2], size[found[:, 0]], size[found[:, 1]]], 1), axis=0, return_inverse=True)
    padded = np.zeros((len(lists), size.max()), np.uint32)
    for k, x in enumerate(lists):
        padded[k, : len(x)] = x
    rows = np.split(np.argsort(kind.reshape(-1), kind="stable"), np.cumsum(np.bincount(kind.reshape(-1), minlength=len(kinds)))[:-1]) if len(kinds) else []
    for (offset, n, m), mine in zip(kinds, rows, strict=True):
        i, j = max(0, -offset), max(0, offset)
        wide = min(n - i, m - j)
        for s in range(0, len(mine), 10_000):
            part = mine[s : s + 10_000]
            odd = np.bitwise_count(padded[found[part, 0], i : i + wide] ^ padded[found[part, 1], j : j + wide]).sum(1, dtype=np.int64)
            hit[part] = odd / (32 * wide) <= errors
    pairs = np.unique(found[hit, :2], axis=0)
    return np.bincount(pairs.reshape(-1), minlength=len(lists))


def fingerprints(media: DataFrame, to_audio, columns: list[str], id_col: str) -> DataFrame:
    """id, n, fp (little-endian 32-bit integers) and node (a hash of them, or of the samples of audio too short for any) of every row. to_audio makes a row's WAV from columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in range(0, len(frame), 500):
                part = frame.iloc[s : s + 500]
                fp, short = [], []
                for r in zip(*(part[c] for c in columns), strict=True):
                    x = samples(to_audio(*r))
                    fp.append(fingerprint(x))
                    short.append(None if len(fp[-1]) or not len(x) else hashlib.sha256(x.astype("<f8").tobytes()).digest())
                raw = [x.astype("<u4").tobytes() for x in fp]
                yield pd.DataFrame({"id": part["id"].astype("Int64").array, "n": [len(x) for x in fp], "fp": raw, "crc": [zlib.crc32(x) for x in raw], "short": short})

    # the analysis takes far more time than reading, so rows are dealt out to all tasks, whatever files they come from
    # (in a stated number, or small inputs would be brought together in a few tasks again)
    tasks = int(media.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = media.select(F.col(id_col).cast("long").alias("id"), *columns).repartition(tasks, F.xxhash64(F.col("id"), *columns))
    out = rows.mapInPandas(run, "id long, n int, fp binary, crc long, short binary")
    return out.withColumn("node", F.xxhash64("fp", "short")).drop("short")


def whole_groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Rows that come in order, in frames that each hold all rows of their groups."""
    rest = None
    for frame in itertools.chain(frames, [None]):
        if frame is not None and not len(frame):
            continue
        rows = rest if frame is None else frame if rest is None else pd.concat([rest, frame])
        if rows is None or not len(rows):
            continue
        rest = None
        if frame is not None:  # the last group may go on
            last = (rows[by] == rows[by].iloc[-1]).all(axis=1).to_numpy()
            rows, rest = rows[~last], rows[last]
        if len(rows):
            yield rows


def in_parts(rows: DataFrame) -> DataFrame:
    """Rows once for each part that theirs meets, i and j, so that each two parts of a group come together in one place."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})


def match(prints: DataFrame, errors: float = 0.15, block: int = 1024) -> DataFrame:
    """id, n, crc, class_id (the least id of linked recordings), n_links (other different lists that match) and n_copies of every row."""
    prints = stage(prints, "prints")
    classes = stage(prints.where("id is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.max("fp").alias("fp")), "classes")

    def posted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in range(0, len(frame), 500):
                part = frame.iloc[s : s + 500]
                lists = [np.frombuffer(x, "<u4") for x in part["fp"]]
                each = [postings(x) for x in lists]
                size = [len(k) for k, _ in each]
                rows = {c: np.repeat(part[c].to_numpy(), size) for c in part.columns if c != "fp"}
                rows |= {"n": np.repeat([len(x) for x in lists], size), "at": np.concatenate([x for _, x in each]), "key": np.concatenate([k for k, _ in each])}
                near = [row.tobytes() for x, (_, at) in zip(lists, each, strict=True) for row in around(x, at)]
                yield pd.DataFrame(rows | {"near": near})

    def arrays(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
        near = np.frombuffer(b"".join(frame["near"]), np.uint32).reshape(len(frame), len(AROUND))
        return frame["node"].to_numpy(), frame["n"].to_numpy(np.int64), frame["at"].to_numpy(np.int64), near

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of rows in the order of key: the best votes of each, or where roots are known all between them."""
        for frame in whole_groups(frames, ["key"]):
            yield from chosen(frame["key"].to_numpy(), frame)

    def met_in_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["key", "i", "j"]):
            for _, g in frame.groupby(["key", "i", "j"]):
                yield from chosen(np.zeros(len(g), np.int64), g, g["part"].to_numpy() if g["i"].iloc[0] != g["j"].iloc[0] else None)

    def chosen(group: np.ndarray, frame: pd.DataFrame, side: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        if "root" in frame:
            yield from votes_across(group, frame["root"].to_numpy(), *arrays(frame), errors, side)
        else:
            yield best_votes(group, *arrays(frame), errors, side)

    def sound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [differ(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), k) <= errors for x, y, k in zip(frame["x"], frame["y"], frame["offset"], strict=True)]
            yield frame[["a", "b"]][np.array(keep, bool)]

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["root", "i", "j"]):
            for _, g in frame.groupby(["root", "i", "j"]):
                side = g["part"].to_numpy()
                if len(g) > 1 and (side.min() != side.max() or g["i"].iloc[0] == g["j"].iloc[0]):
                    yield pd.DataFrame({"node": g["node"].to_numpy(), "links": linked([np.frombuffer(x, "<u4") for x in g["fp"]], side, errors)})

    def voted(lists: DataFrame) -> DataFrame:
        """a and b of the chosen votes whose whole overlap is alike."""
        posted_rows = "node long, n int, at int, key long, near binary" + (", root long" if "root" in lists.columns else "")
        edge = "a long, b long, offset int"
        rows = lists.where("length(fp) > 0").mapInPandas(posted, posted_rows)
        # the window brings the rows of a key together, in order; both branches read its one exchange
        rows = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("c > 1")
        small = rows.where(F.col("c") <= block).mapInPandas(met, edge)
        large = rows.where(F.col("c") > block).withColumn("parts", F.ceil(F.col("c") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        large = in_parts(large).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(met_in_parts, edge)
        edges = small.unionByName(large).distinct()
        edges = edges.join(classes.select(F.col("node").alias("a"), F.col("fp").alias("x")), "a").join(classes.select(F.col("node").alias("b"), F.col("fp").alias("y")), "b")
        return edges.mapInPandas(sound, "a long, b long").distinct()

    roots = components(voted(classes.select("node", "fp")))
    apart = classes.select("node", "fp").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    across = voted(apart)
    roots = components(across.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    groups = roots.join(classes.select("node", "fp"), "node")
    # parts are bounded by their lists' bytes, too: postings take some 50 times as many
    parts = groups.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.length("fp")) / (1 << 21))).cast("int").alias("parts"))
    groups = groups.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    groups = in_parts(groups).select("root", "i", "j", "part", "node", "fp").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    count = groups.mapInPandas(counted, "node long, links long").groupBy("node").agg(F.sum("links").alias("n_links"))
    told = classes.select("node", "rep", "n_copies").join(count, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    told = told.join(told.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    rows = prints.select("id", "n", "crc", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    return rows.join(told, "node", "left").select("id", "n", "crc", "class_id", "n_links", "n_copies")


def sonified(vector) -> bytes | None:
    """A vector as audio: each component, over the root mean square of all, is a note of one hop. Its half tone grows with it, within
    five of 880 Hz, so that no two of the eleven tones share a pitch class and bins of 5.4 Hz tell them apart."""
    if vector is None or len(vector) == 0:
        return None
    v = np.nan_to_num(np.asarray(vector, float), nan=0.0, posinf=1.0, neginf=-1.0)
    v = v / (np.abs(v).max() or 1.0)
    tone = 880 * 2 ** (np.round(5 * np.tanh(v / (np.sqrt((v * v).mean()) or 1.0))) / 12)
    step = np.repeat(tone, HOP) / RATE
    x = 0.8 * np.sin(2 * np.pi * np.cumsum(step))
    return wav(np.concatenate([x, np.zeros(FRAME)]))
