"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

For every term of a document with weight w and every sample k, hashes of (term, k) give r and c from a gamma law of
shape 2 and b from a uniform law. With t = floor(ln w / r + b) and ln a = ln c - r * (t - b + 1), the sample is the pair
(term, t) of least a. Two documents have equal samples with a probability that is their generalised Jaccard similarity,
the sum of the lesser weights over the sum of the greater ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cnvspark.llm.common import cut, small_table

_BITS = 21


def _uniform(hashed: Column, part: int) -> Column:
    """One of three independent numbers within (0, 1) that a 64-bit hash holds."""
    bits = F.shiftrightunsigned(hashed, part * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))
    return (bits + F.lit(0.5)) / F.lit(float(1 << _BITS))


def sample(term_hash: Column, log_weight: Column, k: int) -> Column:
    """The sample's rank and name in one long: ln a, scaled, in the upper half, a hash of (term, t) in the lower."""
    one = F.xxhash64(term_hash, F.lit(2 * k))
    two = F.xxhash64(term_hash, F.lit(2 * k + 1))
    r = -F.ln(_uniform(one, 0) * _uniform(one, 1))
    c = -F.ln(_uniform(one, 2) * _uniform(two, 0))
    b = _uniform(two, 1)
    t = F.floor(log_weight / r + b)
    log_a = F.ln(c) - r * (t - b + F.lit(1.0))
    name = F.shiftrightunsigned(F.xxhash64(two, t), 32)
    return F.shiftleft(F.floor((log_a + F.lit(128.0)) * F.lit(float(1 << 22))), 32).bitwiseOR(name)


def term_runs(text: Column) -> Column:
    """The distinct terms of a text, each repeated as often as it occurs: its words, in lower case, sorted and cut
    into runs of equal ones. A word and its space is the unit, so one string holds the term and its weight.
    """
    joined = F.concat(F.array_join(F.sort_array(F.split(F.lower(text), r"\s+")), " "), F.lit(" "))
    return F.regexp_extract_all(joined, F.lit(r"(\S+ )\1*"), F.lit(0))


def fingerprint_rows(rows: DataFrame, keys: list[str], text: str, samples: int) -> DataFrame:
    """``keys`` and ``samples`` longs ``s0`` ... of each row's text; a text without terms has nulls.

    A row's terms stay in one task, where they are summed up; if the rows are partitioned by one of the keys, nothing
    is shuffled.
    """
    runs = rows.select(*keys, F.explode_outer(term_runs(F.col(text))).alias("run"))
    term = F.substring_index("run", " ", 1)
    weight = F.length("run") / (F.length(term) + F.lit(1))
    terms = runs.select(*keys, F.xxhash64(term).alias("h"), F.ln(weight).alias("lw"), F.col("run").isNull().alias("none"))
    return terms.groupBy(*keys).agg(*(F.min(F.when(~F.col("none"), sample(F.col("h"), F.col("lw"), k))).alias(f"s{k}") for k in range(samples)))


def _names(samples: int) -> Column:
    return F.array(*(F.coalesce(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(-1)) for k in range(samples)))


def _hex(names: str, samples: int) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.element_at(names, k + 1).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for k in range(samples))))


def _likeness(a: str, b: str, samples: int) -> Column:
    """The share of equal samples of two fingerprints."""
    return sum((F.when(F.element_at(a, k + 1) == F.element_at(b, k + 1), 1).otherwise(0) for k in range(samples)), F.lit(0)) / F.lit(float(samples))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = 32, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of the next document's,
    in ascending order of id (nulls first; ties by a hash of the text); the last document's next is the first. Terms
    are the words between white space in lower case, weights their counts. A null text is empty; texts without terms share
    one fingerprint. Rows that repeat both id and text are one document in the order, and each of them gets its result.
    An empty table gives no rows; other columns are ignored.

    Only ids, hashes and lengths are range-partitioned for the order. A text is shuffled once, to its key; what it lends
    to the document before it, at most a quarter of that one's length, is shuffled besides.
    """
    spark = docs.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary")))
    base = base.withColumn("key", key)
    counted = base.select("key", "doc_id", F.length("text").cast("long").alias("n")).groupBy("key", "doc_id", "n").agg(F.count(F.lit(1)).alias("copies"))
    ordered = cut(counted.repartitionByRange(n_parts, "doc_id", "key").sortWithinPartitions("doc_id", "key").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.max("copies").alias("copies")).orderBy("part").collect()
    shifts, total = [], 0
    for s in sizes:
        shifts.append((s["part"], total))
        total += s["rows"]
    shift = small_table(spark, shifts or [(0, 0)], "part long, shift long")
    ranked = ordered.withColumn("part", part).join(F.broadcast(shift), "part").select("key", "doc_id", "n", "copies", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("shift")).alias("rank"))
    before = ranked.select(F.pmod(F.col("rank") + 1, F.lit(max(total, 1))).alias("rank"), F.col("key").alias("prev_key"), F.floor(F.col("n") / 4).alias("prev_quarter"))
    links = ranked.join(before, "rank")
    if any(s["copies"] > 1 for s in sizes):
        base = base.dropDuplicates(["key"])
    placed = base.select("key", "text").join(links, "key")
    lent = placed.select(F.col("prev_key").alias("key"), F.expr("substring(text, 1, cast(prev_quarter as int))").alias("lent"))
    own = placed.drop("prev_key", "prev_quarter").join(lent, "key")
    edited = F.concat(F.expr("substring(text, 1, cast(n - floor(n / 4) as int))"), F.col("lent"))
    own = own.withColumn("edited", edited).withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    keys = ["key", "rank", "doc_id", "n", "copies", "sha"]
    both = own.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("x")).select(*keys, "x.which", "x.body")
    signed = fingerprint_rows(both, [*keys, "which"], "body", samples).select(*keys, "which", _names(samples).alias("fp"))
    paired = signed.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("fp_edited"))
    paired = cut(paired)
    following = paired.select(F.pmod(F.col("rank") - 1 + F.lit(max(total, 1)), F.lit(max(total, 1))).alias("rank"), F.col("fp").alias("fp_next"))
    out = paired.join(following, "rank").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        _hex("fp", samples).alias("fingerprint"),
        _hex("fp_edited", samples).alias("edited_fingerprint"),
        _likeness("fp", "fp_edited", samples).alias("near_edited"),
        _likeness("fp", "fp_next", samples).alias("near_next"),
    )
