"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import base64
import hashlib
import io
import itertools
import os
import random
import re
import time
import tracemalloc
import wave
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import archive, audio, bpe, codec, common, langid, line_dedup, near_duplicates, packing, tokens, topk, toxicity, training_order
from quarry.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, node string, gone string"
LONG = "word " * 20000 + "x" * 6000
TEXTS = [None, "", " ", "Ein Wort.\nzwei  drei\t", "<|endoftext|> it's é 日本 <|endoftext|>", LONG, "a b c d e f g", "a b c d e f g", "!!! ...", "café\r\n x\x85y"]


def rows(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return rows(spark, TEXTS)


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_segment_tree_equals_the_library():
    t, e, r = Tokenizer.from_file(PATH), bpe.PieceEncoder(bpe.load(PATH), keep=50), random.Random(5)
    parts = ["a", " ", "  ", "\n", "\t", "é", "'s", "'", "1", "²", "<|endoftext|>", "日本", "x" * 150, "ing", ".", "👍", "ab" * 70, "\x1c"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(400)]
    got = [np.frombuffer(b"".join(v), "<u2").tolist() for part in bpe.batches_of(texts, 500) for v in e.batch(part)]
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_codec(spark, docs, truth):
    got = {r["doc_id"]: r for r in codec.round_trip(docs, PATH).collect()}
    for k, ids in enumerate(truth):
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((TEXTS[k] or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in codec.decode(codec.encode(docs, PATH), PATH).collect()}
    assert back == {k: x or "" for k, x in enumerate(TEXTS)}
    assert codec.round_trip(docs.limit(0), PATH).count() == 0


def test_packing_and_training_order(spark, docs, truth):
    ids = {k: [*x, 0] for k, x in enumerate(truth)}
    pieces = packing.pack(docs.repartition(3), PATH, window=64)
    seen, stream = {k: [] for k in ids}, {}
    for r in pieces.collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
        stream.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, found in seen.items():
        assert [a for a, _ in sorted(found)] == list(itertools.accumulate([n for _, n in sorted(found)], initial=0))[:-1] and sum(n for _, n in found) == len(ids[k])
    total = sum(map(len, ids.values()))
    assert sorted(stream) == list(range(-(-total // 64)))
    for k, found in stream.items():
        assert [a for a, _ in sorted(found)] == list(itertools.accumulate([n for _, n in sorted(found)], initial=0))[:-1]
        assert sum(n for _, n in found) == (64 if k < max(stream) else total - 64 * max(stream))
    whole = packing.sequences(pieces)
    assert whole.count() == len(stream)

    path = common.new_path(spark, "t")
    n, index = training_order.shards(docs, PATH, key=7, path=path, window=64, shard_slots=10)
    held = training_order.read(spark, path, with_ids=True).collect()
    assert sorted(r["slot"] for r in held) == sorted(r["sequence_id"] for r in held) == list(range(n)) and all(r["sound"] for r in held)
    order = training_order.Permutation(n, 7)
    assert all(order.slot(np.array([r["sequence_id"]]))[0] == r["slot"] == 10 * r["shard"] + (r["byte_offset"] - 32) // (16 + 128) for r in held)
    assert index.agg(F.sum("length")).first()[0] == total
    laid: dict[int, list[int]] = {}
    for r in sorted(index.collect(), key=lambda r: (r["slot"], r["offset"])):
        assert len(laid.setdefault(r["slot"], [])) == r["offset"]
        laid[r["slot"]] += ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert {r["slot"]: np.frombuffer(r["ids"], "<u4").tolist() for r in held} == laid
    want = sorted((r["slot"], bytes(r["ids"])) for r in held)
    for stop in (0, 1, 9, 10, 15, 20, n - 1, n, n + 50):  # a reader that stopped inside a shard, at its ends, and at the end
        rest = [(k, np.frombuffer(x, "<u2").astype("<u4").tobytes()) for k, x in training_order.follow(spark, path, stop)] if stop in (15, n - 1) else None
        assert rest in (None, want[stop:])
        assert sorted((r["slot"], bytes(r["ids"])) for r in training_order.read(spark, path, True, stop).collect()) == want[stop:]
    later = training_order._from(spark, path, 25)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in later and {r["shard"] for r in training_order._from(spark, path, 25).collect()} == set(range(2, -(-n // 10)))
    assert training_order.shards(docs.limit(0), PATH, 7, common.new_path(spark, "t"))[0] == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("at", [0, 1, 249, 250, 1999, 2000, 3999])
def test_long_runs(at):
    for run in ("x" * 4000, " " * 500, "\n\t" * 250, "x" * 3999, " " * 499, "\u3000" * 500):
        text = "ab " * (at // 3) + "a" * (at % 3) + " a" + run + "\nb c"
        assert tokens.has_long_run(text) == bool(tokens._RUN.search(text))
    assert not tokens.has_long_run("") and not tokens.has_long_run("a\n" * 5000)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation(n):
    p = training_order.Permutation(n, 3)
    slots = p.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (p.sequence(slots) == np.arange(n)).all()


def test_topk(spark):
    r = random.Random(4)
    data = [(k, [r.randrange(-3, 4) / 256 for _ in range(4)]) for k in range(60)] + [(7, [0.5, 0.5, 0.5, 0.5]), (100, None), (101, [1.0, None]), (102, [float("nan")]), (103, [float("inf")]), (None, [1.0]), (104, []), (105, [1e300, -2.0]), (106, [0.25])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    import math

    good = [(i, [int(math.floor(x * 256)) if abs(x) < 1e15 else int(x) * 256 for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for i, v in good:
        if i % 10 == 0 or i > 100:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), j) for j, w in good if j != i)[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(found)}
    for sizes in ({"tile": 3, "part": 2, "shard": 3, "block": 2}, {"tile": 5, "shard": 7, "block": 40}, {}):  # trees of two levels, one and none
        got = topk.search(df, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") > 100), **sizes)
        assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_archives(spark):
    pages = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x\r\n\r\n" * 50000), (-6, "http://f", "<p>é</p>"), (2, None, "<p>é</p>"), (None, "http://g", "only"), (None, "http://h", "only"), (None, "http://h", "only"), (2, "http://i", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, date string").repartition(2)
    arc, warc = common.new_path(spark, "arc"), common.new_path(spark, "warc")
    archive.write_arc(df, arc, most=200)
    heads = [h for r in common.read_blobs(spark, arc).collect() for h, _ in archive.arc_records(bytes(r["content"]))]
    assert {len(h) for h in heads} == {5, 10}
    archive.write_warc(common.read_blobs(spark, arc), warc)
    got = sorted((tuple(r) for r in archive.read_warc(spark, warc).drop("url").collect()), key=str)
    want = []
    for i, _, html in pages:
        b = (html or "").encode()
        first = max([j for j, _, h in pages if (h or "") == (html or "") and j is not None], default=None)
        kind = "response" if first == i or first is None else "revisit"
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, first if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    heads = [h for r in common.read_blobs(spark, warc).collect() for h, _ in archive.warc_records(bytes(r["content"]))]
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == len(heads) and all(ids[h["warc-refers-to"]]["warc-type"] == "response" and ids[h["warc-refers-to"]]["warc-payload-digest"] == h["warc-payload-digest"] for h in heads if h["warc-type"] == "revisit")
    for page_id in (0, 1, -1, 2**63 - 1, -(2**63)):
        assert archive.page_of(archive.record_uuid(page_id, "A" * 32, "f:1")) == page_id
    arc, warc = common.new_path(spark, "arc"), common.new_path(spark, "warc")
    archive.write_arc(df.limit(0), arc)
    archive.write_warc(common.read_blobs(spark, arc), warc)
    assert archive.read_warc(spark, warc).count() == 0


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


def sets(text, pattern=r"[A-Za-z0-9_\u0080-\U0010ffff]+"):
    w = re.findall(pattern, (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(spark):
    r = random.Random(6)
    base = [[f"w{r.randrange(500)}" for _ in range(120)] for _ in range(4)]
    texts = [" ".join(edited(r, b, r.randrange(4))) for b in base for _ in range(25)] + [None, "", "one two", "One, two!", "...", LONG, LONG]
    ids = [*range(1, len(texts) + 1)]
    got = {x["doc_id"]: x for x in near_duplicates.join(rows(spark, texts, ids), part_rows=10).collect()}
    distinct = list(dict.fromkeys(t or "" for t in texts))
    s = {t: sets(t) for t in distinct}
    alike = lambda a, b: s[a] == s[b] or len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-9
    root = {t: t for t in distinct}
    for a, b in itertools.combinations(distinct, 2):
        if alike(a, b) and root[a] != root[b]:
            old = root[b]
            root = {t: root[a] if x == old else x for t, x in root.items()}
    for i, t in zip(ids, texts, strict=True):
        t = t or ""
        assert got[i]["class_id"] == min(j for j, u in zip(ids, texts, strict=True) if root[u or ""] == root[t])
        assert got[i]["n_links"] == sum(alike(t, u) for u in distinct if u != t)
    kept = near_duplicates.one_of_each(rows(spark, [*texts, texts[0], "lost"], [*ids, 1, None]))
    assert sorted(x["doc_id"] or 0 for x in kept.collect()) == sorted({0} | {x["class_id"] for x in got.values()})
    assert near_duplicates.join(rows(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 120)]
    root = {k: k for e in edges for k in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_line_dedup(spark):
    r = random.Random(8)
    lines = [[f"w{r.randrange(300)}" for _ in range(40)] for _ in range(5)]
    texts = ["\n".join(" ".join(edited(r, r.choice(lines), r.randrange(3))) for _ in range(4)) for _ in range(30)] + [None, "", "\n\n", "a b\nA  B\n\nc", LONG, LONG, "a b"]
    ids = [*range(len(texts) - 1), None]
    df = rows(spark, texts, ids)
    gone, seen = {}, []
    norm = lambda x: tuple(w for w in x.lower().translate(dict.fromkeys(map(ord, "\t\r\f\v"), " ")).split(" ") if w)
    token = lambda w: frozenset(w[i : i + 5] for i in range(len(w) - 4)) if len(w) > 4 else frozenset([w])
    for i, t in zip(ids, texts, strict=True):
        if i is None or t is None:
            continue
        for pos, x in enumerate(t.split("\n")):
            w = norm(x)
            if not w:
                continue
            if any(w == v for v, _ in seen):
                gone.setdefault(i, []).append(pos)
                continue
            s = token(w)
            near = any(len(s & u) >= 0.8 * len(s | u) - 1e-9 for _, u in seen)
            seen.append((w, s))
            if near:
                gone.setdefault(i, []).append(pos)
    got = {x["doc_id"]: x for x in line_dedup.report(df).collect()}
    assert {k: x["removed"] for k, x in got.items() if x["removed"]} == {k: ",".join(map(str, v)) for k, v in gone.items()}
    out = {x["doc_id"]: x for x in line_dedup.dedup(df).collect()}
    for i, t in zip(ids, texts, strict=True):
        assert out[i]["text"] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])))
        assert out[i]["gone"] == "z"
    plan = line_dedup.report(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup.report(df.limit(0)).count() == 0


def test_language_id(spark):
    words = {"en": "the of and thing with that this".split(), "de": "der und schön nicht keit über ein".split(), "fr": "le été que pas être où une".split(), "es": "el año que niño una así más".split()}
    r = random.Random(9)
    data = [(k, " ".join(r.choice(words[c]) for _ in range(30)), c) for k, c in enumerate(r.choice(list(words)) for _ in range(200))]
    df = spark.createDataFrame([*data, (900, None, "en"), (901, "123 !!", "en"), (902, "", None), (None, "the and of", None), (0, data[0][1], data[0][2])], "doc_id long, text string, lang string")
    got = [(x["doc_id"], x["lang_pred"], x["score"], x["held_out"]) for x in langid.identify(df).collect()]
    of = {k: c for k, _, c in data}
    assert len(got) == 205 and all(0 <= s <= 1 for _, _, s, _ in got)
    assert all(p == of[i] for i, p, _, _ in got if i in of) and {p for i, p, _, _ in got if i in (900, 901, 902)} == {"und"}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _, h in got)
    assert {x["lang_pred"] for x in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(enumerate(b, 1), lambda left, jy, row=row, x=x: min(left + 1, row[jy[0]] + 1, row[jy[0] - 1] + (x != jy[1])), initial=i))
    return row[-1]


def test_automata_equal_edit_distances():
    entries = dict.fromkeys("idiot moron worthless scum pathetic disgusting clown".split(), 1.0)
    t, r = toxicity.Trie(entries, {}), random.Random(10)
    for _ in range(1500):
        w = list(r.choice(list(entries)))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = r.choice(["", "e", "t"])
        w = "".join(w)
        want = min((d for e in entries if (d := distance(w, e)) <= toxicity.edits_allowed(len(e))), default=None)
        assert (found[1] if (found := t.find(w)) else None) == want, w


def test_toxicity(spark):
    r = random.Random(11)
    fill = [f"w{k}" for k in range(400)]
    text = lambda bad: " ".join([r.choice(fill) for _ in range(20)] + ([r.choice(["scumbag", "worthless"])] * 2 if bad else []) + [r.choice(fill) for _ in range(20)])
    data = [(k, text(k % 4 == 0), int(k % 4 == 0)) for k in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, ""), (902, "w1 w2 worthles w3"), (None, "x"), (0, data[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(900, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(df, labels).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in data) and got[902]["score"] > got[901]["score"] == got[900]["score"]
    assert all(x["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    assert {x["score"] for x in toxicity.toxicity(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def test_audio(spark):
    r = np.random.default_rng(12)
    tune = lambda tones: np.concatenate([0.5 * np.sin(2 * np.pi * 220 * 2 ** (t / 12) * np.arange(3000) / audio.RATE) for t in tones])
    a, b = tune(r.integers(0, 24, 40)), tune(r.integers(0, 24, 40))
    cut = a[audio.HOP * 5 :]
    x, y = audio.fingerprint(a), audio.fingerprint(cut)
    assert audio.align(x, y)[0] == -5 and audio.align(x, y)[2] < 0.02 and audio.align(x, audio.fingerprint(b))[2] > 0.2
    data = [(1, audio.wav(a)), (2, audio.wav(a)), (3, audio.wav(cut)), (4, audio.wav(b)), (5, None), (6, b"no"), (None, audio.wav(b))]
    df = spark.createDataFrame([(i, bytearray(x) if x else None, "c") for i, x in data], "id long, wav binary, node string")
    got = {x["id"]: (x["class_id"], x["n_links"], x["n_copies"]) for x in audio.match(audio.fingerprints(df, lambda w: w, ["wav"], "id")).collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (1, 1, 1), 4: (4, 0, 1), 5: (5, 0, 2), 6: (5, 0, 2), None: (None, None, None)}
    assert audio.match(audio.fingerprints(df.limit(0), lambda w: w, ["wav"], "id")).count() == 0


def test_audio_excerpts_and_noise(spark):
    """Excerpts of less than half, noise and cuts off the hop match exactly where all offsets of all pairs say so."""
    r = np.random.default_rng(7)
    tune = lambda n: np.concatenate([0.4 * np.sin(2 * np.pi * 220 * 2 ** (t / 12) * np.arange(3000) / audio.RATE) for t in r.integers(0, 24, n)])
    a, b, c = tune(60), tune(60), tune(12)
    made = [a, a[audio.HOP * 60 : audio.HOP * 100], a[audio.HOP * 60 + 512 : audio.HOP * 100], a + r.normal(0, 0.3, len(a)), a[300:], b, b[audio.HOP * 90 + 400 : audio.HOP * 140] + r.normal(0, 0.1, audio.HOP * 50 - 400), c, c[audio.HOP * 5 :], tune(60)]
    df = spark.createDataFrame([(k, bytearray(audio.wav(x))) for k, x in enumerate(made)], "id long, wav binary").repartition(3)
    lists = [audio.fingerprint(audio.samples(audio.wav(x))) for x in made]
    want = {k: 0 for k in range(len(made))}
    for i, j in itertools.combinations(range(len(made)), 2):
        hit = audio.align(lists[i], lists[j])[2] <= 0.15
        want[i] += hit
        want[j] += hit
    assert all(want[k] for k in range(9)) and want[9] == 0 and 2 * len(lists[1]) < len(lists[0])
    got = {x["id"]: (x["class_id"], x["n_links"]) for x in audio.match(audio.fingerprints(df, lambda w: w, ["wav"], "id")).collect()}
    assert {k: v[1] for k, v in got.items()} == want
    assert [got[k][0] for k in range(10)] == [0, 0, 0, 0, 0, 5, 5, 7, 7, 9]


def test_audio_a_hundred_recordings(spark):
    """Vectors made audible, in groups of near copies: the links are those of all offsets of all pairs."""
    r = np.random.default_rng(17)
    groups = r.normal(size=(20, 64))
    vectors = [g + r.normal(0, noise, 64) for g in groups for noise in (0, 0.03, 0.06, 0.1, 0.2)]
    lists = [audio.fingerprint(audio.samples(audio.sonified(v))) for v in vectors]
    want = {k: 0 for k in range(len(lists))}
    for i, j in itertools.combinations(range(len(lists)), 2):
        if (lists[i] != lists[j]).any() and audio.align(lists[i], lists[j])[2] <= 0.15:
            want[i] += 1
            want[j] += 1
    same = {k: sum((x == y).all() for y in lists) for k, x in enumerate(lists)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, v array<double>").repartition(3)
    got = {x["id"]: (x["n_links"], x["n_copies"]) for x in audio.match(audio.fingerprints(df, audio.sonified, ["v"], "id"), block=3).collect()}
    assert sum(want.values()) > 100 and all(c == 1 for c in same.values())
    assert got == {k: (want[k], same[k]) for k in want}


def test_staged_tables_and_line_dedup_leave_little_on_disk(spark):
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    folders = lambda: set(os.listdir(common.shared_dir(spark).removeprefix("file:")))
    before = held()
    common.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before  # without waiting for the driver's garbage
    there = folders()
    docs = spark.createDataFrame([(1, "one two three four five six\nseven"), (2, "one two three four five six"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["removed"] for r in line_dedup.report(docs).collect()} == {1: "", 2: "0", 3: ""}
    assert {x.split("-")[0] for x in folders() - there} == {"gone"}


def test_batches_of_whole_texts_are_short(spark):
    docs = spark.createDataFrame([(k, f"some words {k}", "en") for k in range(3000)], "doc_id long, text string, lang string").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert langid.known(docs).count() == 3000
    sizes = [r["n"] for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 3000


def test_near_duplicates_take_short_batches(spark):
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(3000)], "doc_id long, text string").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert near_duplicates.join(docs).count() == 3000
    sizes = [r["n"] for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 3000


def test_audio_better_votes_hide_no_match(spark):
    """Two lists whose only common vote is worse than those that each has for a score of lists that don't match."""
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 32, 50, dtype=np.uint32)
    flip = sum(np.uint32(1) << (r.integers(0, 8, 50, dtype=np.uint32) + np.uint32(8 * k)) for k in range(4)).astype(np.uint32)
    flip[[24, 26]] &= np.uint32(0xFFFF0000)  # one pair of bytes is equal, twice
    b = a ^ flip
    made = []
    for x in [a, b] * 20:
        other = r.integers(0, 1 << 32, 50, dtype=np.uint32)
        other[17:34] = x[17:34]
        made.append(other)
    made += [a, b]
    links = [sum(i != j and audio.align(x, y)[2] <= 0.15 for j, y in enumerate(made)) for i, x in enumerate(made)]
    assert links == [0] * 40 + [1, 1]
    rows = [(k, 50, bytearray(x.astype("<u4").tobytes()), k, k) for k, x in enumerate(made)]
    prints = spark.createDataFrame(rows, "id long, n int, fp binary, crc long, node long")
    got = {x["id"]: (x["class_id"], x["n_links"]) for x in audio.match(prints).collect()}
    assert got == {k: (min(k, 40), links[k]) for k in range(len(made))}


def test_audio_integers_around_votes():
    """Votes count where the integers that both lists have around them say so, counted one by one."""
    r = np.random.default_rng(23)
    told = []
    for _ in range(300):
        n, m = r.integers(3, 30, 2)
        a = r.integers(0, 2**32, n, dtype=np.uint32)
        i, j = r.integers(0, n), r.integers(0, m)
        b = a[np.clip(np.arange(m) + i - j, 0, n - 1)] ^ ((r.random(m) < 0.5) * r.integers(0, 2**32, m)).astype(np.uint32)
        pairs = [(a[i + d], b[j + d]) for d in audio.AROUND if 0 <= i + d < n and 0 <= j + d < m]
        overlap = sum(1 for k in range(n) if 0 <= k + j - i < m)
        wrong = sum(int(x ^ y).bit_count() for x, y in pairs)
        want = overlap >= audio.least_overlap(n, m) and wrong <= audio.LOOSE * 0.15 * 32 * len(pairs)
        near = np.concatenate([audio.around(a, np.array([i])), audio.around(b, np.array([j]))])
        got, bits = audio.alike(np.array([n, m]), np.array([i, j]), near, np.array([0]), np.array([1]), 0.15)
        assert (len(got) > 0) == want and (not want or bits[0] == wrong)
        told.append(want)
    assert 20 < sum(told) < 280


def test_audio_widths_and_short_recordings(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([0.5 * np.sin(2 * np.pi * 220 * 2 ** (t / 12) * np.arange(3000) / audio.RATE) for t in r.integers(0, 24, 20)])

    def wav(x, wide):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(wide)
            f.setframerate(audio.RATE)
            ints = np.round(x * (2 ** (8 * wide - 1) - 1)).astype(np.int64)
            f.writeframes((ints + 128).astype(np.uint8).tobytes() if wide == 1 else b"".join(int(v).to_bytes(wide, "little", signed=True) for v in ints))
        return out.getvalue()

    for wide in (1, 2, 3, 4):
        assert np.abs(audio.samples(wav(x, wide)) - x).max() < 0.02 and audio.differ(audio.fingerprint(audio.samples(wav(x, wide))), audio.fingerprint(x), 0) < 0.1
    data = [wav(x[:9000], 2), wav(x[9000:18000], 2), wav(x[:9000], 2), None, b"no", wav(x, 1), wav(x, 4)]
    df = spark.createDataFrame([(k, bytearray(b) if b else None) for k, b in enumerate(data)], "id long, wav binary")
    got = {x["id"]: (x["n"] > 0, x["class_id"], x["n_copies"]) for x in audio.match(audio.fingerprints(df, lambda w: w, ["wav"], "id")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {0: (False, 0), 1: (False, 1), 2: (False, 0), 3: (False, 3), 4: (False, 3), 5: (True, 5), 6: (True, 5)}
    assert [got[k][2] for k in range(5)] == [2, 1, 2, 2, 2]


def test_audible_vectors_of_any_size():
    r = np.random.default_rng(5)
    one, two = r.integers(0, 2, (2, 64)).astype(float)
    heard = lambda v: audio.fingerprint(audio.samples(audio.sonified(v)))
    assert audio.align(heard(one), heard(two))[2] > 0.15
    assert (heard(one) == heard(1e200 * one)).all() and len(heard(np.zeros(64))) == 50


def test_one_of_each_tells_rows_by_id_and_text(spark):
    """Of rows (id, text) only later members of a group and repeated rows go, whatever ids they share."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    given = [(3, a), (5, a), (5, b), (9, c), (9, d), (9, d), (None, a), (7, None), (8, "")]
    kept = near_duplicates.one_of_each(rows(spark, [t for _, t in given], [i for i, _ in given]).repartition(3)).collect()
    assert sorted(((x["doc_id"], x["text"]) for x in kept), key=str) == sorted([(3, a), (5, b), (9, c), (9, d), (None, a), (7, None)], key=str)
    assert near_duplicates.one_of_each(rows(spark, [])).count() == 0


def test_near_duplicates_of_a_hot_group(spark):
    """2000 near copies of one text in buckets beyond `block` and in many parts: classes and links equal brute force."""
    r = np.random.default_rng(13)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k] + [f"x{n}"] + base[k + 1 :]) for n, k in enumerate(r.integers(0, 60, 2000))]
    df = rows(spark, texts + ["other words than those of the group"]).repartition(4)
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in near_duplicates.join(df, block=300, part_rows=500).collect()}
    column = {}
    have = np.zeros((2000, 2100 * 8), np.float32)
    for k, t in enumerate(texts):
        for s in sets(t):
            j = column.setdefault(s, len(column))
            if j < have.shape[1]:
                have[k, j] = 1
    assert len(column) <= have.shape[1]
    inter = have @ have.T
    size = have.sum(1)
    alike = inter >= 0.8 * (size[:, None] + size[None, :] - inter) - 1e-9
    assert [got[k][1] for k in range(2000)] == (alike.sum(1) - 1).tolist() and got[2000] == (2000, 0)
    assert {got[k][0] for k in range(2000)} == {0}


def test_bloom_filter_keeps_every_member(spark):
    ids = [0, 1, -5, 2**62, -(2**63), *range(1000, 3000)]
    table = near_duplicates.membership(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    assert near_duplicates.maybe_in(table, np.array(ids)).all() and near_duplicates.maybe_in(table, np.arange(10**6, 2 * 10**6)).mean() < 0.001


def test_language_of_a_very_long_text():
    """The features of a long text are those of the whole, and its prediction needs a small multiple of its size."""
    raw = langid.coded("Der schnelle Fuchs läuft. " * 50_000)
    cut = [langid.hashed([x])[0] for x in langid.pieces(raw)]
    assert len(cut) > 2 and (np.concatenate(cut) == langid.hashed([raw])[0]).all()
    x = np.stack([np.bincount(langid.hashed([langid.coded(t)])[0], minlength=1 << langid.BITS) for t in ("der und die ein", "the and of in", "le la et un", "el la y un")]).astype(np.float32)
    model = langid.Model(x / x.sum(1, keepdims=True) * langid.SCALE, ["de", "en", "fr", "es"])
    short, score = model.predict(["der und die ein " * 100, "the and of in"])
    tracemalloc.start()
    long, score_of_long = model.predict(["der und die ein " * 2_000_000])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert long == short[:1] == ["de"] and abs(score[0] - score_of_long[0]) < 0.01 and most < 32_000_000 * 5


def test_rows_that_pass_keep_their_columns(spark):
    """Each row is judged by its own text, whatever ids rows share; types and values of all columns are kept."""
    r = random.Random(3)
    words = {"en": "the of and thing with that this".split(), "de": "der und schön nicht keit über ein".split()}
    data = [(k, " ".join(r.choice(words[c]) for _ in range(30)), c, 2**53 + k, None) for k, c in enumerate(["en", "de"] * 40)]
    given = [*data, (1, "123", None, None, [1]), (1, None, "en", 7, []), (None, "the of and", "x", 2**62 + 1, [2])]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, lang_pred long, x array<int>").repartition(3)
    kept = langid.known(df)
    assert kept.schema == df.schema
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(g) for g in given if g[1] and g[1] != "123")
    text = lambda bad: " ".join(["scumbag you"] * bad + [f"w{r.randrange(300)}" for _ in range(30)])
    given = [(k, text(2 * (k % 4 == 0)), 2**53 + k) for k in range(400)] + [(5, text(2), 1), (None, text(2), 2), (None, text(0), 3), (8, None, 4)]
    df = spark.createDataFrame(given, "doc_id long, text string, score long").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400) if k != 5], "doc_id long, toxic int")
    kept = toxicity.clean(df, labels)
    assert kept.schema == df.schema and sorted(map(str, map(tuple, kept.collect()))) == sorted(str(g) for g in given if "scumbag" not in (g[1] or ""))
    assert langid.known(df.limit(0).withColumn("lang", F.lit("en"))).count() == 0 and toxicity.clean(df.limit(0), labels).count() == 0


def test_toxic_words_of_any_length_and_learning_that_repeats(spark):
    s = toxicity.Scorer({"scumbag": 2.0, "xq": 1.0}, {"scum": 1.5}, None)
    assert [f for f in (s.finds([w]) for w in ("scumbag", "xq", "scumbag" + "a" * 100, "a" * 100 + "scum", "xx")) if f] == [[(0, (2.0, 0, False))], [(0, (1.0, 0, False))], [(0, (1.5, 0, True))]]
    r = random.Random(11)
    texts = [" ".join([f"w{r.randrange(60)}" for _ in range(25)] + ["scumbag"] * (k % 3 == 0)) for k in range(300)]
    texts += [" ".join([t, "and more"]) for t in texts[:150]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("scumbag" in t)) for k, t in enumerate(texts)] * 2, "doc_id long, toxic int")
    learnt = [toxicity.learn(d, labels, F.lit(True)).__getstate__() for d in (df.repartition(5), df.orderBy(F.desc("doc_id")).coalesce(1))]
    assert learnt[0] == learnt[1] and {"scumbag", "scum"} & {*learnt[0][0], *learnt[0][1]}


def test_line_dedup_of_a_text_of_many_lines(spark):
    """A text of 200,000 lines, half of them repeated."""
    text = "\n".join(f"line {k % 100_000} has words of its own a{k % 100_000} b{k % 100_000} c{k % 100_000} d{k % 100_000} e{k % 100_000}" for k in range(200_000))
    df = rows(spark, [text, "line 7 has words of its own a7 b7 c7 d7 e7\nnew"], [5, 6])
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup(df).collect()}
    assert out == {5: text[: text.index("\nline 0 ", 10)], 6: "new"}
