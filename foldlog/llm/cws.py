"""Operator 4: document fingerprints by consistent weighted sampling, in DataFrame functions only.

The terms of a text are its 5-word shingles, weighted by how often they occur. Consistent weighted sampling draws, for
each of SAMPLES samples and each term, r and c from a Gamma(2, 1) distribution and a uniform b; with weight w,
t = floor(ln w / r + b), and the term of least c * exp(-r * (t - b + 1)) is the sample, together with its t. Two texts
have the same sample with a probability that equals the generalised Jaccard similarity of their weights, so the share
of equal samples estimates it (standard error at most 1 / (2 * sqrt(SAMPLES))). A fingerprint holds 20 bits of each sample.

The variates come from 128 hash bits of the term. c is -ln(u1 * u2). r and b are drawn together: with e1 = -ln v1 and
e2 = -ln v2, r = e1 + e2 is Gamma(2, 1), and 1 - b = e1 / r is uniform and independent of it. For weight 1, t is 0 and
r * (1 - b) is e1, so that the value is c * v1: most terms take one logarithm. Ties are broken by the term's bits.
Terms are exploded and reduced within the task that holds the text: one row for each text is what is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldlog.llm import common
from foldlog.llm.store import stored

SAMPLES, SHINGLE = 64, 5
#: Samples that are reduced on one row: the code for all of them at once would be too long for the JVM to compile well.
ON_ROW = 8
#: Bytes of text in a range of rows, about, counting ROW_BYTES for each row; sampled rows for each bound between ranges.
RANGE_BYTES, ROW_BYTES, PER_BOUND = 8 << 20, 64, 8
_MASK = (1 << 20) - 1


def _words(text: str) -> str:
    spaces = r"' \t\n\u000b\f\r'"
    trimmed = f"trim(BOTH {spaces} FROM {text})"
    return f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'))"


def _terms(df: DataFrame) -> DataFrame:
    """Replaces words by terms (distinct hashes of shingles) and weights (null where all are 1)."""
    shingle = ", ".join(f"words[i + {k}]" for k in range(SHINGLE))
    df = df.withColumn("all", F.expr(f"CASE WHEN size(words) >= {SHINGLE} THEN transform(sequence(0, size(words) - {SHINGLE}), i -> xxhash64({shingle})) WHEN size(words) > 0 THEN array(xxhash64(array_join(words, ' '), size(words))) ELSE cast(array() as array<bigint>) END"))
    df = df.drop("words").withColumn("alone", F.array_distinct("all"))
    df = df.withColumn("sorted", F.when(F.size("alone") < F.size("all"), F.sort_array("all")))
    df = df.withColumn("runs", F.expr("if(sorted IS NULL, NULL, filter(sequence(0, size(sorted) - 1), i -> i = 0 OR sorted[i] <> sorted[i - 1]))"))
    df = df.withColumn("terms", F.expr("if(sorted IS NULL, alone, transform(runs, i -> sorted[i]))"))
    return df.withColumn("weights", F.expr("if(sorted IS NULL, NULL, zip_with(runs, concat(slice(runs, 2, size(runs)), array(size(sorted))), (a, b) -> coalesce(b, a + 1) - a))")).drop("all", "alone", "sorted", "runs")


def _bits(h: Column, shift: int, n: int) -> Column:
    """n bits of a hash from shift on, as a number within (0, 2 ** n)."""
    high = F.shiftrightunsigned(h, shift) if shift else h
    return (high if shift + n == 64 else high.bitwiseAND(F.lit((1 << n) - 1))).cast("double") + F.lit(0.5)


def _hashes(k: int) -> list[Column]:
    """128 bits of a term for sample k of a row's."""
    salts = [int(np.uint64(0x9E3779B97F4A7C15 * (2 * k + j + 1) & 0xFFFFFFFFFFFFFFFF).astype(np.int64)) for j in range(2)]
    return [F.xxhash64(F.col("term").bitwiseXOR(F.lit(s))) for s in salts]


def _sample(k: int) -> Column:
    """The packed value of one term for sample k of a row's: the number to be minimal in the high 43 bits, 20 bits of term and t in the low ones."""
    x, y = F.col(f"x{k}"), F.col(f"y{k}")
    c = F.lit(64 * math.log(2)) - F.log(_bits(x, 32, 32) * _bits(x, 0, 32))
    v = _bits(y, 24, 40) * F.lit(2.0**-40)
    e1, e2 = -F.log(v), -F.log(_bits(y, 0, 24) * F.lit(2.0**-24))
    r = e1 + e2
    t = F.floor(F.col("ln_w") / r + e2 / r).cast("double")
    once = F.col("ln_w") == 0.0
    a = c * F.when(once, v).otherwise(F.exp(-r * t - e1))
    mark = F.when(once, F.col("term")).otherwise(F.col("term") + t.cast("long") * F.lit(7919)).bitwiseAND(F.lit(_MASK))
    return F.shiftleft((a / (a + F.lit(1.0)) * F.lit(float(1 << 43))).cast("long"), 20).bitwiseOR(mark)


def signatures(df: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """keys (together a row's identity), whole numbers carried, and samples (array of ints, empty without words), from rows with words.

    A term stands on a row for each block of ON_ROW samples; one more row of the text, without a term, has what is carried.
    """
    rows = _terms(df).select(*keys, *carried, "weights", F.posexplode_outer("terms").alias("at", "term"))
    ln_w = F.when(F.col("weights").isNull(), F.lit(0.0)).otherwise(F.log(F.get("weights", F.col("at")).cast("double")))
    blocks = SAMPLES // ON_ROW
    salts = [int(np.uint64(0xD6E8FEB86659FD93 * (i + 1) & 0xFFFFFFFFFFFFFFFF).astype(np.int64)) for i in range(blocks)]
    salted = [F.col("term").bitwiseXOR(F.lit(s)) for s in salts]
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    each = F.posexplode(F.when(first, F.array(*salted, F.lit(None).cast("long"))).otherwise(F.array(*salted))).alias("block", "term")
    rows = rows.select(*keys, *carried, ln_w.alias("ln_w"), each)
    rows = rows.select("*", *[h.alias(f"{n}{k}") for k in range(ON_ROW) for n, h in zip("xy", _hashes(k), strict=True)])  # each hash is computed once, as several expressions use it
    last = F.col("block") == blocks
    least = rows.groupBy(*keys, "block").agg(*[F.max(F.when(last, F.col(c))).alias(c) for c in carried], *[F.min(_sample(k)).alias(f"s{k}") for k in range(ON_ROW)])
    of = lambda block, k: F.max(F.when(F.col("block") == block, F.col(f"s{k}")))
    codes = [of(i // ON_ROW, i % ON_ROW).bitwiseAND(F.lit(_MASK)).cast("int").alias(f"c{i}") for i in range(SAMPLES)]
    out = least.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carried], *codes)
    return out.select(*keys, *carried, F.when(F.col("c0").isNull(), F.array().cast("array<int>")).otherwise(F.array(*[F.col(f"c{i}") for i in range(SAMPLES)])).alias("samples"))


def shown(samples: str) -> Column:
    """A fingerprint as text: five hexadecimal digits for each sample; empty without words."""
    return F.expr(f"lower(array_join(transform({samples}, x -> lpad(hex(x), 5, '0')), ''))")


def likeness(a: str, b: str) -> Column:
    """The share of equal samples; 1 for two texts without words, 0 if one has none."""
    same = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> e))")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same / F.lit(float(SAMPLES)))


def _bounds(sample: DataFrame, parts: int, by: str) -> DataFrame:
    """For each value of by: the first rows (at) of its parts but the lowest, in ascending order, from a sample of rows at."""
    n = "size(all)"
    cuts = f"transform(sequence(1, {parts - 1}), i -> all[cast(i * {n} / {parts} as int)])" if parts > 1 else "slice(all, 1, 0)"
    return sample.groupBy(by).agg(F.sort_array(F.collect_list("at")).alias("all")).select(by, F.array_distinct(F.expr(cuts)).alias(f"{by}_bounds"))


def with_range(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (doc_id, hash, text) with at (what they are ordered by) and their range in that order; and how many ranges there are at most.

    Ranges have about the same bytes of text. Their bounds come from a sample of rows, in two levels of the square root
    of their number each: a row is compared with few bounds, and the driver sees those of the first level.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("at", F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "hash"))
    weighed = rows.select("at", "doc_id", "hash", (F.octet_length("text") + F.lit(ROW_BYTES)).cast("double").alias("weight"))
    total = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    side = math.ceil(math.sqrt(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total / RANGE_BYTES)))
    each = total / (PER_BOUND * side * side)  # bytes for a sampled row; a row of more counts so many times
    times = F.col("weight") / F.lit(max(each, 1.0))
    sample = weighed.where(common.share(4, "doc_id", "hash") < times).select("at", F.explode(F.array_repeat(F.lit(0), F.greatest(F.lit(1), times.cast("int")))).alias("top"))
    sample = stored(sample)
    few = sample.where(common.share(14, "at") < 1 / side)  # about PER_BOUND * side rows
    top = _bounds(few, side, "top").first()
    bounds = [tuple(b) for b in top["top_bounds"]] if top else []
    literal = F.array(*[F.struct(*[F.lit(x).cast(kind) for x, kind in zip(b, ("boolean", "bigint", "bigint"), strict=True)]) for b in bounds]).cast("array<struct<known:boolean,id:bigint,hash:bigint>>")
    place = lambda name: F.expr(f"size(filter({name}, b -> b <= at))")
    with_top = lambda df: df.withColumn("top_bounds", literal).withColumn("top", place("top_bounds")).drop("top_bounds")
    inner = stored(_bounds(with_top(sample.drop("top")), side, "top").withColumnRenamed("top_bounds", "inner"), sample)  # side rows of side bounds
    out = with_top(rows).join(F.broadcast(inner), "top", "left").withColumn("range", F.coalesce(F.col("top") * side + place("inner"), F.col("top") * side)).drop("top", "inner")
    return out, side * side


def with_next(docs: DataFrame) -> DataFrame:
    """range, doc_id, text (null: empty), hash, and the next row's next_id, next_hash, next_text in descending order of (doc_id, hash); after the last, the first.

    Rows are dealt to ranges, each of which also gets the first row of the next range as a guest. A null doc_id comes
    last. Rows that are equal in id and text follow each other.
    """
    rows, ranges = with_range(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text")))
    firsts = stored(rows.groupBy("range").agg(F.max("at").alias("at")))  # a row for each range
    first = firsts.agg(F.max("range")).first()[0]
    before = F.lead("range", 1).over(Window.orderBy("range"))  # over as many rows as there are ranges
    guests = rows.drop("range").join(F.broadcast(firsts.select("at", F.coalesce(before, F.lit(None if first is None else firsts.agg(F.min("range")).first()[0])).cast("long").alias("range"))), "at").dropDuplicates(["range"])
    rows = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    w = Window.partitionBy("range").orderBy("guest", F.desc("at"))
    rows = rows.withColumn("range", F.col("range").cast("int")).repartitionById(ranges, "range")
    return rows.select("range", "guest", "doc_id", "text", "hash", F.lead("doc_id").over(w).alias("next_id"), F.lead("hash").over(w).alias("next_hash"), F.lead("text").over(w).alias("next_text")).where(~F.col("guest")).drop("guest")


def _hex_parts(digest: str) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"d{i}") for i in range(4)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs (doc_id, text).

    A null text is empty; a text without words has an empty fingerprint, like any other such and unlike all others.
    A lone row is its own next. Rows of equal doc_id follow in order of their texts' hashes, repeated rows follow each
    other; null doc_ids come last. Other columns are ignored. An empty table gives no rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - half), substring(next_text, 1, half))"))
    rows = rows.withColumn("digest", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("row", F.monotonically_increasing_id())
    carried = ["doc_id", "hash", "next_id", "next_hash", "n_chars", "d0", "d1", "d2", "d3"]
    rows = rows.select("range", "row", *carried[:5], *_hex_parts("digest"), F.expr(f"explode(array(named_struct('which', 0, 'words', {_words('text')}), named_struct('which', 1, 'words', {_words('edited')}))) as part"))
    rows = rows.select("range", "row", *carried, F.col("part.which").alias("which"), F.col("part.words").alias("words"))
    both = stored(signatures(rows, ["range", "row", "which"], carried).drop("range"))  # rows are dealt by range: grouping needs no exchange
    own, edited = both.where("which = 0").drop("which"), both.where("which = 1").select("row", F.col("samples").alias("edited"))
    others = own.select(F.coalesce("doc_id", F.lit(-1)).alias("next_id"), F.col("hash").alias("next_hash"), F.col("samples").alias("next")).dropDuplicates(["next_id", "next_hash"])
    out = own.withColumn("next_id", F.coalesce("next_id", F.lit(-1))).join(edited, "row").join(others, ["next_id", "next_hash"])
    digest = F.concat(*[F.lower(F.lpad(F.hex(f"d{i}"), 16, "0")) for i in range(4)])
    return out.select("doc_id", "n_chars", digest.alias("edited_sha256"), shown("samples").alias("fingerprint"), shown("edited").alias("edited_fingerprint"), likeness("samples", "edited").alias("near_edited"), likeness("samples", "next").alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
