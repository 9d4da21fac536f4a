"""Language identification in two steps: first the family, then one-versus-one linear support vector machines within it.

Features are the shares of a text's byte pairs and byte triples (hashed to a table of 2^13), over lower-cased text in which whatever
is neither a letter nor beyond ASCII counts as a space. A step with one class needs no machine. Each machine votes; the class with
most votes, then the largest sum of margins, wins. A text's score is the product, over both steps, of the least probability that the
winner's machines give it, the slope of a logistic curve over their margins.

Training takes a bounded sample: at most `sample` rows in expectation, the same number from each language, chosen by a hash of the
text and doc_id. Predictions read whole texts and nothing but texts.

Defined cases: null text or one without a letter is `und` with score 0; repeated rows get equal results; if nothing can be learned
from, every row is `und`; a very long text is read in pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Families of languages by their codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "indic": "hi bn mr ne pa gu ur si",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu",
    "austronesian": "id ms tl jv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split(" ")}
BITS = 13
_MAP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SLOPE = 4.0


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if text else False


#: Bytes of text whose features are held at once.
HELD = 1 << 19


def coded(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_MAP) + b"  "


def hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all coded texts one after another, two for each byte but the last two, and where each text starts."""
    starts = np.cumsum([0] + [2 * (len(r) - 2) for r in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    pair = flat[:-2] << np.uint32(8) | flat[1:-1]
    triple = (pair << np.uint32(8) | flat[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    pair = (pair | np.uint32(1 << 24)) * np.uint32(2246822519) >> np.uint32(32 - BITS)
    inside = np.ones(len(pair), bool)
    ends = np.cumsum([len(r) for r in raw])[:-1]
    inside[ends - 2] = inside[ends - 1] = False  # these would join two texts
    return np.stack([pair[inside], triple[inside]], 1).reshape(-1), starts


def pieces(raw: bytes) -> Iterator[bytes]:
    """A coded text cut so that its pieces have the features of the whole, each once."""
    for s in range(0, len(raw) - 2, HELD):
        yield raw[s : s + HELD + 2]


@dataclass
class Machines:
    """One-versus-one linear machines between classes; weights has a column for each pair."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row and its probability."""
        n = len(margins)
        if len(self.classes) == 1:
            return np.zeros(n, int), np.ones(n)
        votes, total = np.zeros((n, len(self.classes))), np.zeros((n, len(self.classes)))
        least = np.full((n, len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            for c, m in ((a, margins[:, k]), (b, -margins[:, k])):
                votes[:, c] += m > 0
                total[:, c] += m
                least[:, c] = np.minimum(least[:, c], m)
        won = np.lexsort((total, votes), axis=1)[:, -1]
        return won, 1 / (1 + np.exp(-SLOPE * least[np.arange(n), won].clip(-50, 50)))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 1) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by dual coordinate descent; y is 1 or -1. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 0.5 / cost
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - g / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w[:-1], float(w[-1])


def machines(x: np.ndarray, labels: list[str]) -> Machines:
    classes = sorted(set(labels))
    of = np.array([classes.index(c) for c in labels])
    pairs = list(itertools.combinations(range(len(classes)), 2))
    fitted = []
    for a, b in pairs:
        at = np.flatnonzero((of == a) | (of == b))
        fitted.append(svm(x[at], np.where(of[at] == a, 1.0, -1.0)))
    return Machines(classes, pairs, np.stack([w for w, _ in fitted], 1) if fitted else np.zeros((x.shape[1], 0)), np.array([b for _, b in fitted]))


SCALE = 10.0


class Model:
    """The machines of families, then those of each family's languages, over one table of weights."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        own = [FAMILY_OF.get(c.split("-")[0].lower(), c) for c in langs]
        self.steps = [("", machines(x, own))]
        for family in self.steps[0][1].classes:
            at = [k for k, f in enumerate(own) if f == family]
            self.steps.append((family, machines(x[at], [langs[k] for k in at])))
        self.table = np.ascontiguousarray(np.hstack([m.weights for _, m in self.steps]) * SCALE, np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Of texts that have features. A long text is added up piece by piece, so its features never are in memory at once."""
        raw, width = [coded(t) for t in texts], self.table.shape[1]
        sums, part = np.zeros((len(raw), width)), []
        for k in [*range(len(raw)), None] if width else []:
            if part and (k is None or sum(len(raw[j]) for j in part) + len(raw[k]) > HELD):
                f, starts = hashed([raw[j] for j in part])
                sums[part] = np.add.reduceat(self.table[f], starts[:-1], axis=0)
                part = []
            if k is not None and len(raw[k]) > HELD:
                for x in pieces(raw[k]):
                    sums[k] += self.table[hashed([x])[0]].sum(0, dtype=float)
            elif k is not None:
                part.append(k)
        sums /= np.array([2 * (len(r) - 2) for r in raw])[:, None]
        at, margins = 0, {}
        for family, m in self.steps:
            margins[family] = sums[:, at : at + len(m.pairs)] + m.bias
            at += len(m.pairs)
        won, p = self.steps[0][1].decide(margins[""])
        out, score = [""] * len(texts), np.array(p)
        for k, (family, m) in enumerate(self.steps[1:]):
            rows = np.flatnonzero(won == k)
            if len(rows):
                lang, q = m.decide(margins[family][rows])
                score[rows] *= q
                for r, c in zip(rows, lang, strict=True):
                    out[r] = m.classes[c]
        return out, score


def fit(docs: DataFrame, train: Column, sample: int = 3000) -> Model | None:
    """Learns from rows where train holds, with text that has a letter and a language."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = {c: min(1.0, sample / len(counts) / n) for c, n in counts.items()}
    wanted = F.create_map(*[F.lit(x) for c, s in share.items() for x in (c, s)])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                n = sum(np.bincount(hashed([x])[0], minlength=1 << BITS) for x in pieces(coded(text)))
                at = np.flatnonzero(n)
                rows.append((at.astype("<u2").tobytes(), (n[at] / n.sum()).astype("<f4").tobytes(), zlib.crc32(text.encode("utf-8", "replace"))))
            out = pd.DataFrame(rows, columns=["at", "share", "crc"])
            yield pd.DataFrame({"lang": frame["lang"].array, "at": out["at"], "share": out["share"], "crc": out["crc"]})

    drawn = known.where(draw < wanted).select("lang", "text").mapInPandas(run, "lang string, at binary, share binary, crc long").toPandas()
    drawn = drawn.sort_values(["lang", "crc"], kind="stable")
    x = np.zeros((len(drawn), 1 << BITS), np.float32)
    for row, at, share_of in zip(x, drawn["at"], drawn["share"], strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(share_of, "<f4") * SCALE
    return Model(x, list(drawn["lang"])) if len(drawn) else None


def judged(model: Model | None, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """lang_pred and score of each text."""
    texts = [x if isinstance(x, str) else "" for x in texts]
    lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    at = [k for k, x in enumerate(texts) if model is not None and has_letter(x)]
    part, size = [], 0
    for k in [*at, None]:
        if part and (k is None or size > 300_000):
            lang[part], score[part] = model.predict([texts[j] for j in part])
            part, size = [], 0
        if k is not None:
            part.append(k)
            size += len(texts[k])
    return lang, score


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """lang_pred and score beside doc_id and held_out."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of 2^13 rows, whatever the corpus

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lang, score = judged(sent.value, list(frame["text"]))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").array, "held_out": frame["held_out"].array, "lang_pred": lang, "score": score})

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInPandas(run, SCHEMA)


def known(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language; `und` goes. Every row is judged by its own text."""
    common.short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held_out(F.col("doc_id")), sample))
    return common.only(docs, lambda texts: judged(sent.value, texts)[0] != "und")


def identify(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """Learns from the rows that aren't held out and predicts every row."""
    return predict(docs, fit(docs, ~held_out(F.col("doc_id")), sample))
