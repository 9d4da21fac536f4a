"""The pipeline as a whole against a plain version of its stages."""

import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and thing with that this which would there".split(), "de": "der und schön nicht keit über ein werden durch sich".split()}


def texts():
    r = random.Random(21)
    # an index in every word keeps lines of different documents apart
    line = lambda k, n, c: " ".join(f"{r.choice(WORDS[c])}{k}x{n}x{r.randrange(1000)}" if w % 3 else r.choice(WORDS[c]) for w in range(20))
    out = []
    for k in range(160):
        c = "en" if k % 2 else "de"
        body = "\n".join(line(k, n, c) for n in range(3))
        out.append((k, body + (" scumbag you scumbag" if k % 4 == 0 else ""), c))
    shared = line(999, 0, "en")
    out += [(200, out[1][1] + "\n" + shared, "en"), (201, shared.upper() + "\n" + line(201, 1, "en"), "en"), (202, out[3][1], "en"), (3, out[5][1] + "\n" + line(203, 1, "de"), "de")]
    out += [(204, None, "en"), (205, "", "en"), (206, "12 34 !", "en"), (207, out[7][1], None), (8, "this thing would " + line(208, 0, "en"), "en"), (None, out[9][1], "en"), (None, "you scumbag scumbag " + line(209, 0, "en"), "en")]
    return out + [out[11], out[11]]


def shingles(text, words):
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def expected(rows):
    """doc_id and text of what should come to packing."""
    rows = [(i, t) for i, t, _ in rows if t and any(map(str.isalpha, t)) and "scumbag" not in t]
    seen, gone = [], {}
    for i, t in sorted({r for r in rows if r[0] is not None}):
        for pos, x in enumerate(t.split("\n")):
            if w := x.lower().split():
                own = shingles(x, w)
                if any(x == y or alike(own, s) for y, s in seen):
                    gone.setdefault((i, t), set()).add(pos)
                if not any(x == y for y, _ in seen):
                    seen.append((x, own))
    rows = [(i, t, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))) for i, t in rows]
    kept, held = [(None, t) for i, _, t in rows if i is None], []
    for i, t in sorted({(i, t) for i, _, t in rows if i is not None}):  # groups here are cliques, so the first of each stays
        own = shingles(t, re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", t.lower()))
        if not any(own == s or alike(own, s) and s for s in held):
            kept.append((i, t))
        held.append(own)
    return kept


def test_pipeline_equals_plain_stages(spark, tmp_path):
    given = texts()
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, c, "s", len(t or "")) for i, t, c in given], SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((i, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x in expected(given)), key=str)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0), key=str) == want
    assert sum(r["length"] for r in got) == sum(n for _, n in want)
    ids = [i for i, _ in want]
    assert ids.count(None) == 1 and ids.count(3) == 2 and ids.count(8) == 1 and ids.count(11) == 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
