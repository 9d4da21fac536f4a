"""Toxicity by a lexicon that forgives spelling, and by what surrounds each find.

The lexicon is learned: words and beginnings of words (stems) that a bounded sample of labelled rows shows in toxic documents far
more often than chance allows. Its entries form a trie. A Levenshtein automaton for each new word of a text, held as bit vectors of
its states, walks the trie, so only branches that can still match within the allowed number of edits are visited; an entry of fewer
than five letters allows none, one of fewer than ten one, a longer one two; stems take any ending but no edit. Words of any length are
learned and looked up; those of up to LONG letters that were looked up are kept, within a bound. In scripts without spaces a run of
letters is one word, of which the beginning is compared with stems.

Each find gets a context from a window of words on both sides: quotation marks around it, a verb of reporting or a word about words
before it, a negation, or the reader addressed. A logistic regression over these features, fitted on the same sample, gives the score.

Learning reads labels.toxic only of rows outside the held-out fold; at most `sample` rows in expectation, by a hash of the id.

Defined cases: null text counts as empty; a text without finds gets the score of no finds; a label that is null is not used, of
repeated labels all are; of near copies with the same label that with the least hash counts, so that learning repeats exactly; with no label of either kind every score is 0; a null doc_id is not held out and matches no label; repeated
rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.langid import held_out
from quarry.llm.line_dedup import once

#: Words near a find that tell quotation, report or denial from abuse, and those that address a reader, in four languages.
REPORT = set("said says say wrote writes quoted quote quotes called calls term word phrase reported sagte schrieb nannte wort begriff zitat dit écrit appelé mot terme citation dijo escribió llamó palabra término cita".split())
DENIAL = set("not never no isn don nicht nie kein keine ne pas jamais nunca".split())
ADDRESS = set("you your you're du dich dein ihr tu toi vous ton eres tú usted vosotros".split())
QUOTES = "\"“”„«»‹›"
WINDOW = 6
WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)
FEATURES = 8
CHILDREN, ENTRY, STEM = 0, 1, 2  # what a node of the trie holds
LONG = 64


def edits_allowed(n: int) -> int:
    return 0 if n < 5 else 1 if n < 10 else 2


class Trie:
    """Entries with their weights. A stem matches words that start with it."""

    def __init__(self, entries: dict[str, float], stems: dict[str, float]):
        self.root: dict = {CHILDREN: {}}
        for w, weight in entries.items():
            self._node(w)[ENTRY] = weight
        for w, weight in stems.items():
            self._node(w)[STEM] = weight
        self.edits = max([edits_allowed(len(w)) for w in entries], default=0)
        first: dict[int, set[str]] = {}
        inner: dict[tuple[int, int], set[str]] = {}
        last: dict[int, set[str]] = {}
        for w in entries:
            e = edits_allowed(len(w))
            cuts = [len(w) * k // (e + 1) for k in range(e + 2)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if k == 0:
                    first.setdefault(b, set()).add(w[:b])
                elif k == e:
                    last.setdefault(b - a, set()).add(w[a:])
                else:
                    inner.setdefault((a, b - a), set()).add(w[a:b])
        self.parts = [((0, 0), n, x) for n, x in first.items()] + [((a - 2, a + 2), n, x) for (a, n), x in inner.items()]
        self.ends = [(n, 0, x) for n, x in last.items()]

    def _node(self, word: str) -> dict:
        node = self.root
        for c in word:
            node = node[CHILDREN].setdefault(c, {CHILDREN: {}})
        node["len"] = len(word)
        return node

    def _at(self, word: str) -> dict | None:
        node = self.root
        for c in word:
            node = node[CHILDREN].get(c)
            if node is None:
                return None
        return node

    def _near(self, word: str) -> bool:
        """False only if no entry can match: of an entry cut into one more part than its edits, some part stays whole, moved by no
        more places than there are edits."""
        return any(word[k : k + n] in parts for shift, n, parts in self.parts for k in range(max(0, shift[0]), min(len(word) - n, shift[1]) + 1)) or any(word[max(0, len(word) - n - k) : len(word) - k] in parts for n, k, parts in self.ends)

    def find(self, word: str) -> tuple[float, int, bool] | None:
        """Weight, edits and whether by a stem, of the entry with the least edits, then the largest weight."""
        found = None
        node = self.root
        for c in word:
            node = node[CHILDREN].get(c)
            if node is None:
                break
            if STEM in node and (found is None or node[STEM] > found[0]):
                found = (node[STEM], 0, True)
        n = len(word)
        most = min(self.edits, edits_allowed(n + 2))
        if n < 4 or not self._near(word):
            node = self._at(word)
            if node is not None and ENTRY in node:
                return node[ENTRY], 0, False
            return found
        seen: dict[str, int] = {}
        for k, c in enumerate(word):
            seen[c] = seen.get(c, 0) | 1 << k
        full, end = (1 << n + 1) - 1, 1 << n
        start, states = 1, []
        for _ in range(most + 1):
            states.append(start)
            start |= start << 1
        stack = [(self.root, tuple(s & full for s in states))]
        while stack:
            node, states = stack.pop()
            if ENTRY in node:
                allowed = min(most, edits_allowed(node["len"]))
                for e in range(allowed + 1):
                    if states[e] & end:
                        if found is None or e < found[1] or e == found[1] and (found[2] or node[ENTRY] > found[0]):
                            found = (node[ENTRY], e, False)
                        break
            for c, child in node[CHILDREN].items():
                at = seen.get(c, 0)
                before, new = states[0], (states[0] & at) << 1
                out = [new]
                for e in range(1, most + 1):
                    new = ((states[e] & at) << 1 | before | before << 1 | new << 1) & full
                    out.append(new)
                    before = states[e]
                if out[-1]:
                    stack.append((child, tuple(out)))
        return found


class Scorer:
    def __init__(self, entries: dict[str, float], stems: dict[str, float], weights: list[float] | None, keep: int = 300_000):
        self.entries, self.stems, self.weights, self.keep = entries, stems, weights, keep
        self.trie, self.known = None, {}

    def __getstate__(self):
        return self.entries, self.stems, self.weights, self.keep

    def __setstate__(self, state):
        self.__init__(*state)

    def finds(self, words: list[str]) -> list[tuple[int, tuple[float, int, bool]]]:
        if self.trie is None:
            self.trie = Trie(self.entries, self.stems)
        known = self.known
        new = set(words).difference(known)  # looks each word up; a difference with keys() would go through all that is known
        if len(known) + len(new) > self.keep:
            known.clear()
            new = set(words)
        far = {w: self.trie.find(w) for w in new if len(w) > LONG}
        known.update((w, self.trie.find(w)) for w in new if w not in far)
        found = map(known.__getitem__, words) if not far else (far[w] if w in far else known[w] for w in words)
        return [(k, f) for k, f in enumerate(found) if f is not None]

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(FEATURES)
        low = text.lower()
        words = WORD.findall(low)
        finds = self.finds(words) if self.entries or self.stems else []
        if not finds:
            return out
        spans = None
        for k, (weight, edits, stem) in finds:
            near = set(words[max(0, k - WINDOW) : k])
            after = set(words[k + 1 : k + 1 + WINDOW])
            if spans is None:
                spans = [m.span() for m in WORD.finditer(low)]
            a, b = spans[k]
            quoted = any(q in low[max(0, a - 60) : a] for q in QUOTES) and any(q in low[b : b + 60] for q in QUOTES)
            told = bool(near & REPORT)
            kind = 0 if stem else 1 + edits
            out[min(kind, 3)] = max(out[min(kind, 3)], weight)
            out[4] += 0 if quoted or told else 1
            out[5] += quoted or told
            out[6] = max(out[6], bool(near & DENIAL))
            out[7] = max(out[7], bool((near | after) & ADDRESS))
        out[4:6] = np.log1p(out[4:6])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]).clip(-40, 40)))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> list[float]:
    """Logistic regression by Newton's method; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def terms(text: str) -> tuple[set[str], set[str]]:
    words = set(WORD.findall(text.lower()))
    return words, {w[:n] for w in words for n in STEMS if len(w) > n}


def condensed(words: dict[str, float], stems: dict[str, float], seen: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """A stem of three words seen, or more, stands for them and for longer stems; other stems tell nothing that their words don't."""
    kept: dict[str, float] = {}
    seen = sorted(seen)
    covered = lambda w: any(w[:n] in kept for n in STEMS)
    for stem in sorted(stems, key=lambda t: (len(t), t)):
        if not covered(stem) and bisect_left(seen, stem + "\U0010ffff") - bisect_left(seen, stem) >= 3:
            kept[stem] = stems[stem]
    return {w: x for w, x in words.items() if not covered(w)}, kept


def log_tail(n: Column, k: Column, p: float) -> Column:
    """log of a bound on the chance of k or more hits in n draws of chance p."""
    q = k / n
    part = q * F.log(q / p) + F.when(k < n, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return F.when(k <= n * p, 0.0).otherwise(-n * part)


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 12_000, chance: float = 1e-7, least_odds: float = 30.0) -> Scorer:
    """Lexicon and weights from labelled rows for whose doc_id train holds."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & train).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    ids = known.where(draw < sample / max(n, 1)).toPandas()
    if ids["toxic"].nunique() < 2:
        return Scorer({}, {}, None)
    chosen = F.broadcast(spark.createDataFrame(ids.astype({"doc_id": "int64"}), "doc_id long, toxic int"))  # `sample` rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    # near copies mostly share the least hash of their word triples; one of them counts, or a copied text would fill the lexicon
    split = once(rows, w=F.split(F.lower("text"), r"\W+"))
    triples = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(3)]))
    least = F.when(F.size("w") < 3, F.xxhash64("w")).otherwise(F.array_min(triples))
    apart = split.withColumn("least", least).groupBy("least", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text", "doc_id"), "text")).alias("text"))
    apart = common.stage(apart.select("text", "toxic"), "labelled")  # read twice; `sample` rows
    sizes = {r["toxic"]: r["count"] for r in apart.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Scorer({}, {}, None)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: dict[tuple[bool, int], Counter] = {(s, y): Counter() for s in (False, True) for y in (0, 1)}
        for frame in frames:
            for text, y in zip(frame["text"], frame["toxic"], strict=True):
                for stem, found in enumerate(terms(text)):
                    of[bool(stem), y].update(found)
        out = [(t, s, y, c) for (s, y), found in of.items() for t, c in found.items()]
        yield pd.DataFrame(out, columns=["term", "stem", "toxic", "n"])

    counted = apart.mapInPandas(count, "term string, stem boolean, toxic int, n long").groupBy("term", "stem").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    odds = (F.col("bad") + 0.5) / (F.col("good") + 0.5) * (sizes[0] / sizes[1])
    sure = log_tail(F.col("bad") + F.col("good"), F.col("bad"), sizes[1] / (sizes[0] + sizes[1])) < math.log(chance)
    # what is so much more frequent in toxic rows of the sample: a small part of the sample's words
    found = counted.where("bad >= 3").withColumns({"odds": odds, "sure": sure}).where((F.col("odds") > least_odds) & (F.col("sure") | ~F.col("stem"))).toPandas().sort_values(["term", "stem"])
    weight = found["odds"].map(lambda x: min(5.0, math.log(x)))
    words, stems = ({t: x for t, x, s, y in zip(found["term"], weight, found["stem"], found["sure"], strict=True) if y and s == kind} for kind in (False, True))
    scorer = Scorer(*condensed(words, stems, list(found["term"][~found["stem"].astype(bool)])), None)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [scorer.features(t) for t in frame["text"]], "toxic": frame["toxic"].array})

    measures = apart.mapInPandas(measured, "x array<double>, toxic int").toPandas()
    x, y = np.stack(measures["x"].to_numpy()), measures["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    scorer.weights = regression(x[order], y[order])
    return scorer


def scores(scorer: Scorer, texts: list) -> np.ndarray:
    x = [scorer.features(t if isinstance(t, str) else "") for t in texts]
    return scorer.score(np.stack(x)) if x else np.zeros(0)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # words that a bounded sample shows in toxic rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = scores(sent.value, list(frame["text"]))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").array, "held_out": frame["held_out"].array, "score": s, "predicted": (s >= threshold).astype(np.int32)})

    held = held_out(F.col("doc_id"), 3, 1)
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInPandas(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> DataFrame:
    """Learns from the labelled rows that aren't held out and scores every row."""
    return score(docs, learn(docs, labels, ~held_out(F.col("doc_id"), 3, 1), sample))


def clean(docs: DataFrame, labels: DataFrame, sample: int = 12_000, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not predicted as toxic. Every row is judged by its own text."""
    common.short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, ~held_out(F.col("doc_id"), 3, 1), sample))
    return common.only(docs, lambda texts: scores(sent.value, texts) < threshold)
