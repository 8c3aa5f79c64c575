"""Near-duplicates by order MinHash.

A document is the sequence of its runs of five words. Each run carries the number of its earlier occurrences. A sketch
takes the several runs of least hash and keeps them in text order, so two documents share it with a probability that
falls with edits and moves alike. Two sketches make a band. Documents that share a band are candidates, and a banded
alignment of their run sequences decides: with L aligned equal runs of n and m, the similarity is L / (n + m - L).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cnvspark.llm.common import compact, cut, free, kept, text_key
from cnvspark.llm.words import word_hashes

_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: At most so many ids (8 bytes each) are broadcast.
_BROADCAST_IDS = 2_000_000
#: Pairs that are verified together.
_SLICE = 64


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; a shorter text is one run, an empty one none."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * _MIX
        out ^= out >> np.uint64(31)
    return out


def occurrences(x: np.ndarray) -> np.ndarray:
    """How often each element has come before."""
    order = np.argsort(x, kind="stable")
    same = x[order]
    starts = np.concatenate([[True], same[1:] != same[:-1]])
    first = np.flatnonzero(starts)
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return out


class Sketcher:
    """Order MinHash bands of word sequences."""

    def __init__(self, k: int = 5, least: int = 3, rows: int = 2, bands: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k, self.least, self.rows, self.bands = k, least, rows, bands
        n = rows * bands
        self.a = (rng.integers(1, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]

    def _least(self, x: np.ndarray) -> np.ndarray:
        """Places of the least hashes for each sketch (sketches by ``least``)."""
        out = np.empty((len(self.a), self.least), np.int64)
        step = max(1, min(len(self.a), (1 << 21) // max(1, len(x))))
        for s in range(0, len(self.a), step):
            h = (x * self.a[s : s + step]) ^ self.b[s : s + step]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            rows = np.arange(len(h))
            for j in range(self.least):
                at = h.argmin(axis=1)
                out[s : s + step, j] = at
                h[rows, at] = 0xFFFFFFFF
        return out

    def bands_of(self, words: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each band; none for a text without words."""
        x = shingles(words, self.k)
        if not len(x):
            return np.empty(0, np.int64)
        x = _labelled(x) * _MIX
        x ^= x >> np.uint64(32)
        places = self._least(x.astype(np.uint32)) if len(x) > self.least else np.tile(np.arange(len(x)), (len(self.a), 1))
        places.sort(axis=1)  # text order
        value = np.zeros(len(self.a), np.uint64)
        for j in range(places.shape[1]):
            value = (value ^ x[places[:, j]]) * _MIX
            value ^= value >> np.uint64(29)
        value = value.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1).astype(np.uint64)
        for r in range(self.rows):
            out = (out ^ value[:, r]) * _MIX
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


def _labelled(x: np.ndarray) -> np.ndarray:
    """Each run with the number of its earlier occurrences, so that no two are equal."""
    return x ^ (occurrences(x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _aligned(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Equal pairs of the best alignment that stays within ``width`` of the diagonal."""
    if len(a) > len(b):
        a, b = b, a
    low, high = -width, len(b) - len(a) + width  # offsets of the band: j - i
    span = high - low + 1
    # Cell c of row i stands for column j = i + low + c; going one row down shifts the band by one column.
    padded = np.concatenate([np.zeros(max(0, -low) + 1, b.dtype), b, np.zeros(len(a) + high + 1, b.dtype)])
    valid = np.concatenate([np.zeros(max(0, -low) + 1, bool), np.ones(len(b), bool), np.zeros(len(a) + high + 1, bool)])
    base = max(0, -low) + 1
    row = np.zeros(span, np.int32)
    for i, x in enumerate(a):
        at = base + i + low
        same = (padded[at : at + span] == x) & valid[at : at + span]
        down = np.append(row[1:], row[-1])  # cell above: same column
        row = np.maximum.accumulate(np.maximum(row + same, down))
    return int(row.max())


def ordered_similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """The similarity of two run sequences, or 0 where it is below ``threshold``. The band is doubled until no better
    alignment can leave it.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return float(n == m == 0)
    least = min(n, m)
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    rest = least - head
    differ = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1])
    tail = int(differ[0]) if len(differ) else rest
    x, y = a[head : n - tail], b[head : m - tail]
    need = threshold / (1 + threshold) * (n + m) - 1e-9
    equal = 0
    if len(x) and len(y):
        _, i, j = np.intersect1d(_labelled(x), _labelled(y), assume_unique=True, return_indices=True)
        if head + tail + len(i) < need:  # no alignment has more equal runs than both have in common
            return 0.0
        j = j[np.argsort(i)]
        width = 8
        while True:
            if (j[1:] > j[:-1]).all():  # what is common stands in the same order, and is the alignment
                equal = len(j)
                break
            equal = _aligned(x, y, width)
            if min(len(x), len(y)) - equal <= width or head + tail + equal >= min(n, m):
                break
            if width > n + m - 2 * need:
                break
            width *= 2
    equal += head + tail
    return equal / (n + m - equal) if equal >= need else 0.0


def _sketched(docs: DataFrame, id_col: str, text_col: str, sketcher: Sketcher) -> DataFrame:
    arrow = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("words", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words = word_hashes([t or "" for t in part.column(2).to_pylist()])
                bands = [sketcher.bands_of(w) for w in words]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
                yield pa.record_batch([part.column(0), part.column(1), lists, pa.array([(w >> np.uint64(48)).astype("<u2").tobytes() for w in words], pa.binary())], schema=arrow)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_key(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, key binary, bands array<long>, words binary")


def _verified(pairs: DataFrame, words: DataFrame, k: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) that are alike, by their word sequences.

    Pairs are looked at in small slices, and the runs of a text are kept while its pairs follow one another.
    """

    def runs_of(packed: pa.BinaryScalar) -> np.ndarray:
        return shingles(np.frombuffer(packed.as_buffer(), "<u2").astype(np.uint64), k)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, runs = None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, _SLICE):
                part, good = batch.slice(at, _SLICE), []
                for a, x, y in zip(ids[at : at + _SLICE], part.column(2), part.column(3), strict=True):
                    if a != last:
                        last, runs = a, runs_of(x)
                    good.append(ordered_similarity(runs, runs_of(y), threshold) >= threshold - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = compact(pairs)
    words = _of(words, pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct())
    both = pairs.join(words.select(F.col("rid").alias("b"), F.col("words").alias("wb")), "b").join(words.select(F.col("rid").alias("a"), F.col("words").alias("wa")), "a")
    return both.select("a", "b", "wa", "wb").mapInArrow(verify, "a long, b long")


def _of(words: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``words`` that ``ids`` names, with its columns; if these are few, only rows in question are shuffled."""
    ids = compact(ids)
    return words.join(F.broadcast(ids) if ids.count() <= _BROADCAST_IDS else ids, "rid")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph of (a, b) but the roots, its root being the least node it is connected to.

    Alternates large and small stars until nothing changes; each turn is two aggregations and two joins, and ends its lineage.
    """
    edges = compact(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        few = edges.rdd.getNumPartitions()
        # Large star: neighbours above a node go to the least of its neighbourhood.
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(few).distinct().coalesce(few)
        # Small star: a node and its lower neighbours go to the least of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(few)
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lowest.select("a", F.col("m").alias("b")))
        edges = compact(small.coalesce(few).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _mixed(bucketed: DataFrame, roots: DataFrame) -> DataFrame:
    """(rid) of the rows of bands that hold several labels, which are equal for rows known to be connected."""
    rows = bucketed.join(roots.select(F.col("node").alias("rid"), F.col("root").alias("label")), "rid", "left").select("band", "rid", F.coalesce("label", "rid").alias("label"))
    several = rows.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    return rows.join(several, "band", "left_semi").select("rid").distinct()


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The classes of :func:`classes` without their text keys."""
    return classes(docs, **options).drop("key")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each near-duplicate class: that of least id.

    Rows that repeat both id and text count as one, so one of them stays.
    """
    row_id, row_key = free(docs, "_id", "_key")
    first = cut(classes(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col("doc_id").alias("first_id"), F.col("key").alias("first_key")))
    rows = docs.withColumn(row_id, docs[id_col].cast("long")).withColumn(row_key, text_key(docs[text_col]))
    same = rows[row_id].eqNullSafe(first["first_id"]) & (rows[row_key] == first["first_key"])
    rows = rows.join(first, same, "left_semi")
    if rows.select(row_id, row_key).count() > first.count():  # some id and text come more than once
        rows = rows.dropDuplicates([row_id, row_key])
    return rows.drop(row_id, row_key)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, least: int = 3, rows: int = 2, bands: int = 32) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``key`` (of its text), ``class_id`` (the least id of its class),
    ``copies`` (rows with the same text) and ``kept`` (one row of each class: that of least id).

    Equal texts are one class from the start, whatever their number, and only one row of each text goes on. A null text
    is empty. Texts of the same words are one class, and a text without words is alike only to equal ones; null ids are last
    in a class and ``class_id`` is null if all are; repeated rows are copies; an empty table gives no rows; other columns are ignored.

    Within a band, every row is compared with the one that shares most, which settles groups of copies in linear time. Rows
    of bands that still hold several classes are then compared with all rows of other classes that can be alike: see
    :func:`_across`. So every two rows of a band that are alike are in one class, however large the band.
    """
    sketches = kept(_sketched(docs, id_col, text_col, Sketcher(k, least, rows, bands)).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    texts = cut(sketches.groupBy("key").agg(F.min("rid").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("copies")))
    reps = sketches.join(texts.select(F.col("rep").alias("rid")), "rid", "left_semi")
    banded = reps.select("rid", F.explode("bands").alias("band"))
    words = sketches.select("rid", "words")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucketed = compact(banded.join(shared, "band"))
    # The first of a band is the row that shares most with others. It is first in most bands of a group, so few pairs differ.
    weight = compact(bucketed.groupBy("rid").agg(F.sum("n").alias("weight")))
    first = bucketed.join(weight, "rid").groupBy("band").agg(F.max(F.struct("weight", "rid"))["rid"].alias("first"))
    stars = bucketed.join(first, "band").where("rid <> first").select(F.col("first").alias("a"), F.col("rid").alias("b")).distinct()
    links = compact(_verified(stars, words, k, similarity))
    roots = components(links)
    mixed = compact(_mixed(bucketed.select("band", "rid"), roots).join(weight, "rid"))
    if not mixed.isEmpty():
        found = _across(mixed, roots, words, k, similarity)
        if not found.isEmpty():
            roots = components(links.unionByName(found))
    # The first row of a class, by its texts: rows meet their text alone, so no task holds the rows of a class.
    members = roots.select(F.col("node").alias("rep"), "root").unionByName(roots.select(F.col("root").alias("rep"), "root").distinct())
    named = texts.select("key", "copies", "first", "rep").join(members, "rep", "left")
    least_of = compact(named.where("root is not null").groupBy("root").agg(F.min("first").alias("least")))
    named = named.join(least_of, "root", "left").select("key", "copies", F.coalesce("least", "first").alias("least"))
    of_rows = sketches.select("rid", "doc_id", "key").join(named, "key")
    return of_rows.select("doc_id", "key", F.col("least.doc_id").alias("class_id"), "copies", (F.col("rid") == F.col("least.rid")).alias("kept"))


def _prefixes(words: DataFrame, k: int, threshold: float, common: int = 32) -> DataFrame:
    """(run, rid, weight, n, at): of each text the first of its ``n`` runs in one order of all runs, so many that two texts alike at
    ``threshold`` share one of them. Runs of more than ``common`` texts are last, by their number, so what many texts share,
    as a passage, is first in none that has enough of its own. Any order gives the same pairs alike; at most
    ``_BROADCAST_IDS`` runs are known as common.
    """

    def runs_of(packed: pa.BinaryScalar) -> np.ndarray:
        return _labelled(shingles(np.frombuffer(packed.as_buffer(), "<u2").astype(np.uint64), k))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                run, n = np.unique(np.concatenate([runs_of(x) for x in batch.column(1).slice(at, 256)]), return_counts=True)
                yield pa.record_batch([pa.array(run.view(np.int64)), pa.array(n)], ["run", "n"])

    often = words.select("rid", "words").mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > common)
    top = often.orderBy(F.desc("n"), "run").limit(_BROADCAST_IDS).orderBy("run").toArrow()
    shared = words.sparkSession.sparkContext.broadcast((top.column(0).to_numpy(), top.column(1).to_numpy()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = shared.value
        for batch in batches:
            for rid, weight, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                run = runs_of(packed).view(np.int64)
                n = len(run)
                place = np.minimum(np.searchsorted(known, run), max(0, len(known) - 1))
                often = np.where(known[place] == run, number[place], 0) if len(known) else np.zeros(n, np.int64)
                taken = run[np.lexsort((run, often))][: n - int(np.ceil(threshold * n - 1e-9)) + 1]
                yield pa.record_batch([pa.array(taken), *(pa.array(np.full(len(taken), x)) for x in (rid, weight, n)), pa.array(np.arange(len(taken)))], ["run", "rid", "weight", "n", "at"])

    return words.select("rid", "weight", "words").mapInArrow(first, "run long, rid long, weight long, n long, at long")


def _across(mixed: DataFrame, roots: DataFrame, words: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links between all rows of ``mixed`` that ``roots`` leaves in different classes.

    Rows alike share a run of their prefixes. For each run the rows are compared with the one of most weight, and then, with
    classes that know of it, with all rows of other classes, but for pairs whose runs after the last shared one are too few.
    """
    runs = kept(_prefixes(_of(words, mixed), k, similarity), "prefixes")
    runs = compact(runs.join(runs.groupBy("run").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("run"), "run", "left_semi"))

    def labelled(roots: DataFrame) -> DataFrame:
        named = runs.join(roots.select(F.col("node").alias("rid"), F.col("root").alias("label")), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        several = named.groupBy("run").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.struct("weight", "rid", "label", "n")).alias("first")).where("x <> y")
        return named.join(several.select("run", "first"), "run")

    near = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    stars = labelled(roots).where("label <> first.label").withColumn("m", F.col("first.n")).where(near)
    stars = stars.select(F.col("first.rid").alias("a"), F.col("rid").alias("b")).distinct()
    found = compact(_verified(stars, words, k, similarity))
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
    left = compact(labelled(components(links) if found.take(1) else roots).select("run", "rid", "n", "at", "label"))
    if left.isEmpty():
        return found
    # The shorter text of a pair shares a run that comes even earlier in it.
    other = left.select("run", F.col("rid").alias("b"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("label").alias("other")).where(F.col("to") <= F.col("m") - F.ceil(2 * similarity / (1 + similarity) * F.col("m") - 1e-9))
    longer = (F.col("n") > F.col("m")) | (F.col("n") == F.col("m")) & (F.col("rid") > F.col("b"))
    most = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to"))
    pairs = left.join(other, "run").where(longer & F.expr("label <> other") & near & (most >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9))
    return found.unionByName(compact(_verified(pairs.select(F.col("rid").alias("a"), "b").distinct(), words, k, similarity)))
