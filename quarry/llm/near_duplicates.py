"""N-gram Jaccard join: documents whose sets of word 5-shingles are at least 0.8 alike.

Texts with equal sets are one class and are compared once. Classes meet in the buckets of the bands of their MinHash values; a pair
at the threshold shares none with a probability of about 3 in a million. Within a bucket pairs compare one byte of each MinHash value
in runs of 16, and a pair is dropped when, given the matches so far and a flat prior, the probability that its similarity reaches the
threshold falls below the tolerance (bytes that agree by accident only keep a pair). The surviving pairs are not written: a bucket
gives one edge for each of its classes, towards the component of survivors that it is in. Buckets of more than `block` classes aren't
compared but are one component. So texts that share a band by accident don't chain together into large components.

Of each component the texts come together once, and the same pruning is done on whole MinHash values; of the remaining pairs the sets
themselves are intersected. A large component is cut into parts, and each two parts meet in a task of their own, so no task grows with
the component; links are counted inside the tasks and never written as pairs.

Words are runs of letters, digits, underscores and bytes beyond ASCII in the lower-cased text. Fewer words than a shingle takes are
one shingle. Classes and texts are told apart by 128 bits of hash; shorter hashes only choose candidates.

Result: one row for each row of documents: doc_id, class_id (the least doc_id of its group of linked texts), n_links (other
different texts at least as alike as the threshold), n_copies (rows with the same set of shingles, itself included).

Defined cases: null and wordless texts have the empty set and are one class; rows with a null doc_id take no part and get null in
all other columns; repeated rows are copies; an empty table gives no rows; other columns are ignored. A doc_id with several texts has
a row for each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import short_batches, stage
from quarry.llm.components import components

BANDS, WIDE = 24, 4
HASHES = BANDS * WIDE
RUN = 16
_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for x in (_P, pow(_P, -1, 2**64)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the set of shingles."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    inside = np.concatenate([[False], _WORD[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    h = _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + h[i : i + len(out)]
    return np.unique(_mixed(out))


def _family() -> tuple[np.ndarray, np.ndarray]:
    x = _mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:HASHES] | np.uint64(1), x[HASHES:]


def minhash(sets: np.ndarray) -> np.ndarray:
    a, b = _family()
    least = np.full(HASHES, 2**32 - 1, np.uint64)
    for s in range(0, len(sets), 1024):
        least = np.minimum(least, ((sets[s : s + 1024, None] * a + b) >> np.uint64(32)).min(0))
    return least.astype("<u4")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A row of keys for each signature; the number of the band is part of the key."""
    x = signatures.reshape(len(signatures), BANDS, WIDE).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS))
    for k in range(WIDE):
        key = _mixed(key * np.uint64(0xFF51AFD7ED558CCD) + x[:, :, k])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After 16, 32, ... hashes: the least number of matches with which a pair stays.

    With a flat prior the posterior after m of n is Beta(m + 1, n - m + 1), and the chance of a similarity of at least t is that of m
    hits or fewer in n + 1 draws of chance t. MinHash values of 32 bits hardly ever agree by accident."""
    out = []
    for n in range(RUN, HASHES + 1, RUN):
        m, chance = 0, 0.0
        for m in range(n + 2):
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
        out.append(m)
    return out


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.int64)
    used = np.unique(np.concatenate([left, right]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    rows = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, col, n = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    common = n > 1
    number = np.cumsum(common) - 1
    rows, col = rows[common[col]], number[col[common[col]]]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    inter = np.zeros((len(used), len(used)), np.float32)  # counts stay far below 2^24
    for s in range(0, int(common.sum()), 4096):
        a, b = np.searchsorted(col, [s, s + 4096])
        x = np.zeros((len(used), 4096), np.float32)
        x[rows[a:b], col[a:b] - s] = 1
        inter += x @ x.T
    return inter[place[left], place[right]].astype(np.int64)


def least_linked(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows 0 .. n-1: the least row of the component that the links x - y put each in."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, y, label[x])
        np.minimum.at(label, x, label[y])
        label = label[label]
        if (label == before).all():
            return label


def link(nodes: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts of one task: the least node of each one's component here, and the weight of its linked partners.
    side: texts of different sides meet; if there is one side, all do."""
    n = len(nodes)
    sig = np.stack([minhash(s) for s in sets])
    keys = band_keys(sig)
    links = np.zeros(n, np.int64)
    two = side.min() != side.max()
    meet = np.zeros((n, n), bool)
    for b in range(BANDS):
        order = np.argsort(keys[:, b], kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order, b])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                meet[np.ix_(group, group)] = True
    left, right = np.nonzero(np.triu(meet, 1))
    if two:
        across = side[left] != side[right]
        left, right = left[across], right[across]
    same = np.zeros(len(left), np.int64)
    for k, least in enumerate(need):
        at = slice(k * RUN, (k + 1) * RUN)
        for s in range(0, len(left), 100_000):
            same[s : s + 100_000] += (sig[left[s : s + 100_000], at] == sig[right[s : s + 100_000], at]).sum(1)
        stay = same >= least
        left, right, same = left[stay], right[stay], same[stay]
    if len(left):
        size = np.array([len(s) for s in sets])
        inter = _shared(sets, left, right)
        alike = inter >= threshold * (size[left] + size[right] - inter) - 1e-9
        left, right = left[alike], right[alike]
        np.add.at(links, left, weights[right])
        np.add.at(links, right, weights[left])
    order = np.argsort(nodes)  # the least row is the least node then
    place = np.argsort(order)
    return nodes[order[least_linked(n, place[left], place[right])[place]]], links


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come in order."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        cuts = np.flatnonzero((frame[by].to_numpy()[1:] != frame[by].to_numpy()[:-1]).any(1)) + 1
        for part in np.split(np.arange(len(frame)), cuts):
            rows = frame.iloc[part]
            if held and (held[-1][by].iloc[-1].to_numpy() != rows[by].iloc[0].to_numpy()).any():
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def survivors(frames: Iterator[pd.DataFrame], need: list[int]) -> Iterator[pd.DataFrame]:
    """Of rows (key, id, sig: a byte for each MinHash value) that come in the order of key: edges from ids to the least row of their
    component of surviving pairs in the bucket."""

    def forest(keys: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.repeat(np.append(starts[1:], len(keys)), np.diff(np.append(starts, len(keys))))
        after = ends - np.arange(len(keys)) - 1  # rows of the same bucket that follow
        begun = np.concatenate([[0], np.cumsum(after)])
        left, right, at = [], [], 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(begun, begun[at] + 500_000, "right")) - 1)
            x = np.repeat(np.arange(at, to), after[at:to])
            y = x + 1 + np.arange(len(x)) - (begun[x] - begun[at])
            same = np.zeros(len(x), np.int64)
            for k, least in enumerate(need):
                cut = slice(k * RUN, (k + 1) * RUN)
                same += (sig[x, cut] == sig[y, cut]).sum(1)
                stay = same >= least
                x, y, same = x[stay], y[stay], same[stay]
            left.append(x)
            right.append(y)
            at = to
        label = least_linked(len(keys), np.concatenate(left), np.concatenate(right))
        far = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": ids[far], "b": ids[label[far]]})

    rest = None
    for frame in itertools.chain(frames, [None]):
        if frame is not None and not len(frame):
            continue
        rows = rest if frame is None else frame if rest is None else pd.concat([rest, frame])
        if rows is None or not len(rows):
            continue
        keys = rows["key"].to_numpy()
        whole = len(keys) if frame is None else int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if whole:
            done = rows.iloc[:whole]
            yield forest(keys[:whole], done["id"].to_numpy(), np.frombuffer(b"".join(done["sig"]), np.uint8).reshape(whole, HASHES))
        rest = rows.iloc[whole:]


def _classed(docs: DataFrame, threshold: float, words: int, tolerance: float, block: int, part_rows: int, part_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Of every row: doc_id, text_key (128 bits) and node; and of every node: rep (the least doc_id and text_key of its group), n_links
    and n_copies."""
    spark = docs.sparkSession
    short_batches(spark)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))
    need = least_matches(threshold, tolerance)

    def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in range(0, len(frame), 500):
                part, rows = frame.iloc[s : s + 500], []
                for t in part["text"]:
                    found = shingles(t if isinstance(t, str) else "", words)
                    rows.append((node_of(found), len(found), minhash(found).tobytes() if len(found) else None))
                out = pd.DataFrame(rows, columns=["node", "n", "sig"])
                yield out.assign(doc_id=part["doc_id"].astype("Int64").array, text_key=part["text_key"].array)

    signs = stage(docs.mapInPandas(signed, "doc_id long, text_key binary, node binary, n int, sig binary"), "minhash")
    own = signs.where("doc_id is not null")
    texts = own.groupBy("node", "text_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    classes = texts.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("weight"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    classes = stage(classes.withColumn("id", F.xxhash64("node")), "classes")

    def banded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                keys = band_keys(np.frombuffer(b"".join(frame["sig"]), "<u4").reshape(len(frame), HASHES))
                yield pd.DataFrame({"key": keys.reshape(-1), "id": np.repeat(frame["id"].to_numpy(), BANDS)})

    bands = classes.where("n > 0").select("id", "sig").mapInPandas(banded, "key long, id long")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("lead")).where("c > 1")
    met = stage(bands.join(shared, "key"), "bands")

    def bytewise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            low = np.frombuffer(b"".join(frame["sig"]), "<u4").astype(np.uint8).reshape(len(frame), HASHES) if len(frame) else []
            yield pd.DataFrame({"id": frame["id"].array, "sig": [x.tobytes() for x in low]})

    small = met.where(F.col("c") <= block).select("key", "id")
    asked = classes.select("id", "sig").join(small.select("id").distinct(), "id", "left_semi").mapInPandas(bytewise, "id long, sig binary")
    dealt = small.join(asked, "id").repartition("key").sortWithinPartitions("key")
    edges = dealt.mapInPandas(lambda frames: survivors(frames, need), "a long, b long").unionByName(met.where(F.col("c") > block).select(F.col("id").alias("a"), F.col("lead").alias("b")))
    met = components(edges).withColumnRenamed("node", "id").join(classes.select("id", "node", "rep", "weight", "n"), "id")
    parts = met.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / part_rows), F.ceil(F.sum("n") / part_shingles)).cast("int").alias("parts"))
    met = stage(met.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "met")
    wanted = met.select("rep.doc_id", "rep.text_key", "node", "root", "weight", "part", "parts")
    likely = spark.sparkContext.broadcast(membership(wanted.select("doc_id")))

    def asked_for(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, bytes]] = set()
        for frame in frames:
            frame = frame[maybe_in(likely.value, frame["doc_id"].to_numpy(np.int64))]
            new = [k not in seen and not seen.add(k) for k in zip(frame["doc_id"], frame["text_key"], strict=True)]
            yield frame[new]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in range(0, len(frame), 500):
                part = frame.iloc[s : s + 500]
                yield part.drop(columns="text").assign(set=[shingles(t, words).tobytes() for t in part["text"]])

    some = docs.where("doc_id is not null").mapInPandas(asked_for, "doc_id long, text string, text_key binary")
    texts = some.join(wanted, ["doc_id", "text_key"]).select("node", "root", "weight", "part", "parts", "text")
    sets = texts.mapInPandas(read, "node binary, root long, weight long, part int, parts int, set binary")
    tasks = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for g in _groups(frames, ["root", "i", "j"]):
            g = g.drop_duplicates("node")
            if len(g) < 2:
                continue
            found = [np.frombuffer(x, np.uint64) for x in g["set"]]
            side = g["part"].to_numpy()
            if g["i"].iloc[0] != g["j"].iloc[0] and side.min() == side.max():
                continue  # the other part is empty
            nodes = g["node"].to_numpy()
            root, links = link(nodes, g["weight"].to_numpy(), found, side, threshold, need)
            hit = links > 0
            rows.append(pd.DataFrame({"node": nodes[hit], "root": root[hit], "links": links[hit], "cut": g["parts"].to_numpy()[hit] > 1}))
            size += int(hit.sum())
            if size > 5000:
                yield pd.concat(rows)
                rows, size = [], 0
        if rows:
            yield pd.concat(rows)

    dealt = tasks.select("node", "root", "weight", "part", "parts", "i", "j", "set").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = stage(dealt.mapInPandas(linked, "node binary, root binary, links long, cut boolean"), "links")
    roots = components(links.where("cut").select(F.col("node").alias("a"), F.col("root").alias("b"))).unionByName(links.where("not cut").select("node", "root"))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    told = classes.select("node", "rep", "copies", "weight").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_group = told.groupBy("root").agg(F.min("rep").alias("first"))
    told = told.join(of_group, "root").select("node", F.col("first").alias("rep"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("copies").alias("n_copies"))
    return signs.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), told


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


#: Bits of the table that says which ids may be asked for: of a fixed size, so that it may be sent to every task.
MEMBER_BITS = 26


def _member_places(ids: np.ndarray) -> np.ndarray:
    x = _mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([x >> np.uint64(64 - MEMBER_BITS), x & np.uint64((1 << MEMBER_BITS) - 1)])


def membership(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the column doc_id: 8 MB, however many ids. Where it is full, it keeps all rows, and nothing is lost."""

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.unique(_member_places(frame["doc_id"].to_numpy(np.int64)))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    words = ids.mapInPandas(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << MEMBER_BITS - 6, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def maybe_in(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _member_places(ids)
    return ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1).all(0)


def join(docs: DataFrame, threshold: float = 0.8, words: int = 5, tolerance: float = 1e-6, block: int = 1024, part_rows: int = 1024, part_shingles: int = 2_000_000) -> DataFrame:
    rows, told = _classed(docs, threshold, words, tolerance, block, part_rows, part_shingles)
    return rows.join(told, "node", "left").select("doc_id", F.col("rep.doc_id").alias("class_id"), "n_links", "n_copies")


def one_of_each(docs: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    """The documents without all but the first (the least doc_id, then hash of the text) of each group. Documents are told apart by id
    and text, so texts that share an id are decided each. Rows with a null doc_id stay; of equal rows that stay, one stays."""
    rows, told = _classed(docs, threshold, **{"words": 5, "tolerance": 1e-6, "block": 1024, "part_rows": 1024, "part_shingles": 2_000_000} | options)
    odd = rows.where("doc_id is not null").groupBy("doc_id", "text_key", "node").agg(F.count(F.lit(1)).alias("c")).join(told, "node")
    odd = odd.withColumn("_gone", F.struct("doc_id", "text_key") != F.col("rep")).where("_gone or c > 1")
    odd = odd.select(F.col("doc_id").alias("_odd_id"), F.col("text_key").alias("_odd_key"), "_gone")
    same = (docs["doc_id"].cast("long") == F.col("_odd_id")) & (text_key(docs["text"].cast("string")) == F.col("_odd_key"))
    told = docs.join(odd, same, "left")
    left = told.where(F.col("_gone").isNull()).select(*docs.columns)
    twice = told.where(~F.col("_gone")).dropDuplicates(["_odd_id", "_odd_key"]).select(*docs.columns)
    return left.unionByName(twice)
