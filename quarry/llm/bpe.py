"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree hold (rank of the pair that starts here, position), or NONE; every inner node holds the least of its
children, so the root is the leftmost pair of the lowest rank. A merge changes three leaves and the paths above them. Short words
are merged together, a matrix of trees at a time; a long one has a tree of its own, so its time is n log n.

Text is cut into pieces before every space that is followed by something else than white space. The pre-tokenizer's pattern has a
boundary at each of these places, so pieces can be encoded alone and kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: Fixed value: the pre-tokenizer's pattern, as public byte-level BPE vocabularies use it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(2**62)
POS_BITS = 24
LONG = 128

_ODD_SPACE = re.compile(r" (?=\s)| \Z")
_CUT = re.compile(r"(?= \S)")


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 characters stand for themselves, others move beyond 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class SegmentTreeBPE:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE file and add_special_tokens=False."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file is needed")
        to_byte = byte_chars()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.of_byte[b] = vocab[c]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.dtype = np.dtype("<u2") if self.size <= 65536 else np.dtype("<u4")
        self.words = regex.compile(PATTERN)
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE >> POS_BITS)

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, size = len(ids), 1
        while size < n:
            size *= 2
        none = int(NONE)
        tree = [none] * (2 * size)

        def key(i: int, j: int) -> int:
            r = self.rank_of.get(ids[i] * self.size + ids[j]) if j < n else None
            return none if r is None else (r << POS_BITS + 8) | i

        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            tree[size + i] = key(i, i + 1)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k //= 2
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        made = self.made
        while tree[1] < none:
            i = tree[1] & ((1 << POS_BITS + 8) - 1)
            ids[i] = int(made[tree[1] >> POS_BITS + 8])
            j = following[i]
            k = following[i] = following[j]
            if k < n:
                before[k] = i
            ids[j] = -1
            put(j, none)
            put(i, key(i, k))
            if before[i] >= 0:
                put(before[i], key(before[i], i))
        return [x for x in ids if x >= 0]

    def _merge_many(self, words: list[bytes], width: int) -> list[bytes]:
        """The trees of words of at most `width` bytes, a power of two, side by side; the bytes of the ids of each."""
        m = len(words)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        lens = np.fromiter(map(len, words), np.int64, m)
        ids = self.of_byte[flat]
        place = np.arange(width)
        ids[place[None, :] >= lens[:, None]] = -1
        following = np.broadcast_to(place + 1, (m, width)).copy()
        following[following >= lens[:, None]] = width
        before = np.broadcast_to(place - 1, (m, width)).copy()
        tree = np.full((m, 2 * width), NONE, np.int64)
        if width > 1:
            pair = (place[None, :-1] + 1) < lens[:, None]
            a, b = ids[:, :-1][pair], ids[:, 1:][pair]
            rank = self._rank(a, b)
            leaf = np.where(rank == NONE >> POS_BITS, NONE, (rank << POS_BITS) | np.broadcast_to(place[:-1], pair.shape)[pair])
            tree[:, width : 2 * width - 1][pair] = leaf
        k = width
        while k > 1:
            k //= 2
            np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])
        flat_tree, flat_ids, flat_next, flat_before = tree.reshape(-1), ids.reshape(-1), following.reshape(-1), before.reshape(-1)
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            base, top = row * width, row * (2 * width)
            root = flat_tree[top + 1]
            i = root & ((1 << POS_BITS) - 1)
            new = self.made[root >> POS_BITS]
            j = flat_next[base + i]
            k = flat_next[base + j]
            flat_ids[base + i], flat_ids[base + j] = new, -1
            flat_next[base + i] = k
            has_k = k < width
            flat_before[(base + k)[has_k]] = i[has_k]
            p = flat_before[base + i]
            has_p = p >= 0
            flat_tree[top + width + j] = NONE
            right, left = np.full(len(row), NONE), np.full(len(row), NONE)
            if has_k.any():
                r = self._rank(new[has_k], flat_ids[(base + k)[has_k]])
                right[has_k] = np.where(r == NONE >> POS_BITS, NONE, (r << POS_BITS) | i[has_k])
            flat_tree[top + width + i] = right
            if has_p.any():
                r = self._rank(flat_ids[(base + p)[has_p]], new[has_p])
                left = np.where(r == NONE >> POS_BITS, NONE, (r << POS_BITS) | p[has_p])
                flat_tree[(top + width + p)[has_p]] = left
            node = np.concatenate([width + i, width + j, np.where(has_p, width + p, width + i)])
            top3 = np.concatenate([top, top, top])
            half = width
            while half > 1:
                node >>= 1
                half //= 2
                at = top3 + 2 * node
                flat_tree[top3 + node] = np.minimum(flat_tree[at], flat_tree[at + 1])
            row = row[flat_tree[top + 1] < NONE]
        keep = ids >= 0
        out = ids[keep].astype(self.dtype).tobytes()
        ends = (keep.sum(1).cumsum() * self.dtype.itemsize).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens, each as the bytes of an array of self.dtype."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            n = len(w)
            if n > LONG:
                out[k] = np.array(self._merge_long(self.of_byte[np.frombuffer(w, np.uint8)].tolist()), self.dtype).tobytes()
            elif n:
                by_width.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(k)
        for width, places in by_width.items():
            step = max(1, (1 << 18) // width)
            for s in range(0, len(places), step):
                part = places[s : s + step]
                for k, x in zip(part, self._merge_many([words[k] for k in part], width), strict=True):
                    out[k] = x
        return out

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary stretches of text (id None) and special tokens with their ids."""
        if self._split is None or not any(s in text for s in self.special):
            yield text, None
            return
        for k, part in enumerate(self._split.split(text)):
            if part:
                yield part, self.special[part] if k % 2 else None


class PieceEncoder:
    """Encodes many texts through a bounded cache of pieces. `value` turns the id bytes of a piece into what is kept for it."""

    def __init__(self, bpe: SegmentTreeBPE, value=lambda ids: ids, keep: int = 300_000):
        self.bpe, self.value, self.keep = bpe, value, keep
        self.spaced: dict[str, object] = {}  # by what follows a piece's leading space
        self.bare: dict[str, object] = {}  # by the whole piece
        self.word: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> list[object]:
        split = [self.bpe.words.findall(p) for p in pieces]
        if len(self.word) > self.keep:
            self.word.clear()
        new = list({w for ws in split for w in ws if w not in self.word})
        self.word.update(zip(new, self.bpe.encode_words([w.encode() for w in new]), strict=True))
        get = self.word.__getitem__
        return [self.value(b"".join(map(get, ws))) for ws in split]

    def _fill(self, spaced: set[str], bare: set[str]) -> None:
        if len(self.spaced) > self.keep:
            self.spaced.clear()
        if len(self.bare) > self.keep:
            self.bare.clear()
        a, b = list(spaced.difference(self.spaced)), list(bare.difference(self.bare))
        found = self._learn([" " + p for p in a] + b)
        self.spaced.update(zip(a, found, strict=False))
        self.bare.update(zip(b, found[len(a) :], strict=True))

    def parts(self, text: str) -> list[tuple[str, list[str], object]]:
        """("id", [], id), ("bare", pieces, None) or ("line", [first, *rest without their space], None)."""
        out = []
        for part, special in self.bpe.segments(text):
            if special is not None:
                out.append(("id", [], special))
            elif _ODD_SPACE.search(part):
                out.append(("bare", [p for p in _CUT.split(part) if p], None))
            else:
                out.append(("line", part.split(" "), None))
        return out

    def batch(self, texts: Iterable[str]) -> list[list[object]]:
        """The kept values of the pieces of each text, in order."""
        cut = [self.parts(t) for t in texts]
        spaced: set[str] = set()
        bare: set[str] = set()
        for parts in cut:
            for kind, pieces, _ in parts:
                if kind == "line":
                    spaced.update(pieces[1:])
                    bare.add(pieces[0])
                elif kind == "bare":
                    bare.update(pieces)
        bare.discard("")
        self._fill(spaced, bare)
        ahead, alone, out = self.spaced.__getitem__, self.bare.__getitem__, []
        for parts in cut:
            values: list[object] = []
            for kind, pieces, special in parts:
                if kind == "id":
                    values.append(self.value(np.array([special], self.bpe.dtype).tobytes()))
                elif kind == "bare":
                    values.extend(map(alone, pieces))
                else:
                    if pieces[0]:
                        values.append(alone(pieces[0]))
                    values.extend(map(ahead, pieces[1:]))
            out.append(values)
        return out


def batches_of(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters together."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


_LOADED: dict[str, SegmentTreeBPE] = {}


def load(path: str) -> SegmentTreeBPE:
    """One per worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = SegmentTreeBPE(path)
    return _LOADED[path]
