"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are the word 5-shingles of its lower-cased words (a shorter line is one token). Equal lines are one line from the
start; lines that differ in case or blanks only have equal tokens and match like any others. Tokens are put in one global order by rarity: the counts of all tokens of all lines, gathered in a table of a fixed number of
buckets, then the token's hash. Two lines at the threshold share a token among the first n - ceil(t * n) + 1 of each (prefix filter);
lengths must allow the threshold (length filter), and so must what is left of both lines after the shared token (positional filter).
Candidates are verified on their whole sets. A line goes if an earlier line, by doc_id and position of first occurrence, is a match,
whether or not that one goes, too.

Verification has two rounds. First each line meets the earliest line of each of its prefix tokens; for most copies that settles
it. Only lines without a match so far then meet all earlier lines that share a prefix token, so groups of near copies don't make all
of their pairs, and nothing is lost.

Defined cases: lines without words always stay; null text stays null and has no lines; rows with a null doc_id stay as they are and
take no part; rows with equal doc_id and text are one document here and lose the same lines; an empty table gives no rows; other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import new_path, scratch, stage, written

BUCKETS = 1 << 15
BLANKS = " \t\r\f\u000b"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, into which the optimizer does not merge what uses them: inside a lambda, a merged expression
    would be evaluated for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def words_of(line: Column) -> Column:
    """Runs of anything but blanks, in lower case. The few lines with other blanks than spaces are translated first: that is slow."""
    low = F.lower(line)
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\u000b"))
    return F.array_remove(F.split(F.when(other, F.translate(low, BLANKS[1:], "    ")).otherwise(low), " "), "")


def tokens_of(words: Column, size: Column, n: int) -> Column:
    """Distinct hashes of the shingles of a line."""
    whole = F.array(F.xxhash64(words))
    many = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.array_distinct(F.when(size < n, whole).otherwise(many))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos, line and lid (its hash) of every line that has words."""
    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # hashed before lines are made, or a text would be hashed again for each of its lines
    named = once(named, th=F.xxhash64("text"), at=F.split("text", "\n")).select("doc_id", "th", F.posexplode("at").alias("pos", "line"))
    return named.where(F.trim("line", F.lit(BLANKS)) != "").withColumn("lid", F.xxhash64("line"))


def _worded(lines: DataFrame) -> DataFrame:
    return once(lines, w=words_of(F.col("line"))).drop("line")


def _tokened(lines: DataFrame, n: int) -> DataFrame:
    return once(_worded(lines), t=tokens_of(F.col("w"), F.size("w"), n)).drop("w")


def _rarity(lines: DataFrame, n: int) -> Column:
    """The counts of all buckets, a constant of fixed size. Shingles are hashed from exploded positions, outside lambdas, which
    compiles; xxhash64 skips the nulls past the end of a line shorter than n, so its one token is the hash of its words here, too."""
    places = _worded(lines).select("w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))).alias("i"))
    tokens = places.select(F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(n)]).alias("x"))
    counted = tokens.groupBy(F.shiftrightunsigned("x", 49).cast("int").alias("bucket")).count()
    counts = {r["bucket"]: r["count"] for r in counted.collect()}
    return F.split(F.lit(",".join(str(min(counts.get(b, 0), 2**22)) for b in range(BUCKETS))), ",").cast("array<int>")


def _far(n: Column, m: Column, t: float) -> Column:
    """The least intersection of sets of n and m tokens at the threshold."""
    return F.ceil((n + m) * (t / (1 + t)) - 1e-9)


def _possible(t: float) -> Column:
    """The length filter and the positional filter for x and an earlier y."""
    left = 1 + F.least(F.col("n") - F.col("i"), F.col("yn") - F.col("yi")) - 1
    return (F.col("yn") >= F.col("n") * t - 1e-9) & (F.col("n") >= F.col("yn") * t - 1e-9) & (left >= _far(F.col("n"), F.col("yn"), t))


def matches(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Of every line with words: its place and lid; and of every lid its first place and whether an earlier line matches it."""
    lines = _tokened(_lines(docs).select("line", "lid"), n)
    places = stage(_lines(docs).select("doc_id", "th", "pos", "lid"), "places")
    first = places.groupBy("lid").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"))

    counts = _rarity(_lines(docs).select("line"), n)
    low = (1 << 40) - 1
    key = F.transform("t", lambda x: F.shiftleft(F.get(counts, F.shiftrightunsigned(x, 49).cast("int")).cast("long"), 40).bitwiseOR(x.bitwiseAND(F.lit(low))))
    size = F.size("t")
    prefix = F.slice(F.sort_array(key), 1, size - F.ceil(size * threshold - 1e-9).cast("int") + 1)
    posted = lines.select("lid", size.alias("n"), F.posexplode(prefix).alias("i", "key"))
    own = Window.partitionBy("key")
    posted = posted.withColumns({"lo": F.min("lid").over(own), "hi": F.max("lid").over(own)}).where("lo <> hi").select("key", "lid", "n", "i").distinct()
    posted = stage(posted.join(first, "lid"), "postings")

    # token sets of the lines that share a prefix token with another
    wanted = posted.select("lid", "first").distinct().select("first.*").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("wanted"))
    some = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").where(F.col("th") == F.xxhash64("text"))
    some = once(some, at=F.split("text", "\n")).select(F.explode(F.transform("wanted", lambda k: F.get("at", k))).alias("line"))
    some = some.select("line", F.xxhash64("line").alias("lid"))
    sets = stage(_tokened(some, n).dropDuplicates(["lid"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.select("lid", "ylid").distinct().join(sets, "lid").join(sets.select(F.col("lid").alias("ylid"), F.col("t").alias("yt")), "ylid")
        inter = F.size(F.array_intersect("t", "yt"))
        return both.where(inter >= threshold * (F.size("t") + F.size("yt") - inter) - 1e-9).select("lid").distinct()

    lead = posted.groupBy("key").agg(F.min(F.struct("first", "lid", "n", "i")).alias("y"))
    pairs = posted.join(lead, "key").select("lid", "n", "i", F.col("y.lid").alias("ylid"), F.col("y.n").alias("yn"), F.col("y.i").alias("yi"))
    settled = stage(verified(pairs.where("lid <> ylid").where(_possible(threshold))), "settled")
    rest = posted.join(settled, "lid", "left_anti")
    earlier = posted.select("key", F.col("lid").alias("ylid"), F.col("n").alias("yn"), F.col("i").alias("yi"), F.col("first").alias("yfirst"))
    pairs = rest.join(earlier, "key").where("yfirst < first").where(_possible(threshold))
    gone = settled.unionByName(verified(pairs)).withColumn("near", F.lit(True))
    return places, first.join(gone, "lid", "left").select("lid", "first", F.coalesce("near", F.lit(False)).alias("near"))


def removed(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """doc_id, th and gone (ascending positions, from 0) of the documents that lose lines."""
    path = new_path(docs.sparkSession, "gone")
    with scratch(docs.sparkSession):
        places, told = matches(docs, threshold, n)
        gone = places.join(told, "lid").where(F.col("near") | (F.struct("doc_id", "th", "pos") != F.col("first")))
        gone = gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
        return written(gone, path)


def dedup(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """The documents without the lines that match an earlier one. A text of which every line goes is empty."""
    lost = removed(docs, threshold, n).select(F.col("doc_id").alias("_lost_id"), F.col("th").alias("_lost_th"), "gone").withColumnRenamed("gone", "_lost")
    whole = docs.join(lost, (docs["doc_id"].cast("long") == F.col("_lost_id")) & (F.xxhash64(docs["text"]) == F.col("_lost_th")), "left")
    # positions that stay, by hashing, so that time grows with the lines of a text and not with their square
    whole = once(whole, _at=F.when(F.col("_lost").isNotNull(), F.split("text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_at") - 1), "_lost"), lambda k: F.get("_at", k))
    return whole.withColumn("text", F.when(F.col("_lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def report(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """Of every row: doc_id, n_lines, n_removed and removed (positions from 0, joined by commas)."""
    lost = removed(docs, threshold, n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    out = rows.join(lost, ["doc_id", "th"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))
