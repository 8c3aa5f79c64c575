"""Vector codes by product quantisation in whole numbers, with nearest entries found along Walsh-Hadamard coefficients.

A component x becomes the integer floor(scale x). A vector is cut into equal parts, each with a codebook of its own that
starts as that part of the first vectors and is moved by rounds of assignment and floored means. To find the nearest entry, a
part and the entries are padded with zeros to a power of two L and transformed by the integer Walsh-Hadamard transform, whose
rows are put in order of their sign changes. Squared differences of coefficients then add up to L times the squared
distance. They are added in that order, and an entry is dropped once its sum exceeds the full sum of an entry that is
known already. All of it is exact.

Each round is one pass over all vectors: tasks return a row of sums for each entry, which Spark adds up, so the driver sees only
the codebooks, whose size the vectors' length fixes. Nothing of a vector is shuffled.

Rows whose vector is null, or holds a null or a component that is not finite, are dropped. Vectors whose length differs from
that of the first kept one have no code (null code and error). A length that the parts do not divide is padded with zeros.
Null ids come after all others; of equal ids the lesser vector comes first. Repeated rows count as often as they occur. Fewer
kept vectors than entries make smaller codebooks. Integers beyond ±2^62 are taken as that, and errors beyond 2^63 - 1 as that; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cnvspark.llm.common import free, kept

#: Beyond this, and below the square root of a long, sums of squares could overflow: then Python's own integers are used.
_SAFE = 1 << 24
_MOST, _LONG = 1 << 62, (1 << 63) - 1
#: Labels of at most so many values have their sums broadcast; others are joined by a salted key.
MANY_LABELS, SALTS = 100_000, 16


class Codebooks(NamedTuple):
    """Codebooks of a table: the vectors' length, that of a part, and the entries as parts x entries x components."""

    length: int
    width: int
    entries: list[list[list[int]]]

    def sha256(self) -> str:
        """Hash of all components as decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def sequency(size: int) -> np.ndarray:
    """For each number of sign changes, the row of the Hadamard matrix of ``size`` that has so many: Gray code, bits reversed."""
    bits = size.bit_length() - 1
    gray = [i ^ (i >> 1) for i in range(size)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def transform(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows in sequency order, by sums and differences alone; rows are padded with zeros."""
    width = max(rows.shape[-1], 1)
    size = 1 << (width - 1).bit_length()
    x = np.zeros((*rows.shape[:-1], size), rows.dtype)
    x[..., : rows.shape[-1]] = rows
    step = 1
    while step < size:
        pairs = x.reshape(*x.shape[:-1], size // (2 * step), 2, step)
        x = np.concatenate([pairs[..., :1, :] + pairs[..., 1:, :], pairs[..., :1, :] - pairs[..., 1:, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x[..., sequency(size)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties: the lower one) and the sum of squared differences, both of transformed rows.

    The entry nearest by the first coefficient gives each row a full sum as its bound; the others are followed only while
    they do not exceed it.
    """
    first = (rows[:, :1] - entries[:, 0]) ** 2
    guess = first.argmin(axis=1)
    bound = ((rows - entries[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for k in range(1, rows.shape[1]):
        total = total + (rows[row, k] - entries[entry, k]) ** 2
        left = total <= bound[row]
        row, entry, total = row[left], entry[left], total[left]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    best = np.minimum.reduceat(total, starts) if len(row) else total
    hits = np.flatnonzero(total == np.repeat(best, np.diff(np.r_[starts, len(row)])))
    return entry[hits[np.r_[True, row[hits][1:] != row[hits][:-1]]]] if len(hits) else entry, best


def _integers(column: pa.Array, length: int, width: int, parts: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have the length, and their parts as rows x parts x components of integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = np.asarray(column.value_lengths()) == length
    flat = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(right.sum()), length)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if scaled.size and np.abs(scaled).max() >= _SAFE:
        whole = np.array([[max(-_MOST, min(_MOST, int(x))) if np.isfinite(x) else (_MOST if x > 0 else -_MOST) for x in r] for r in scaled], object).reshape(scaled.shape)
    else:
        whole = scaled.astype(np.int64)
    padded = np.zeros((len(whole), parts * width), whole.dtype)
    padded[:, :length] = whole
    return right, padded.reshape(len(whole), parts, width)


def _coded(vectors: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (rows x parts) and squared distance (rows x parts)."""
    big = vectors.dtype == object or any(abs(x) >= _SAFE for p in books.entries for e in p for x in e)
    kind = object if big else np.int64
    size = 1 << (max(books.width, 1) - 1).bit_length()
    codes, errors = np.zeros(vectors.shape[:2], np.int64), np.zeros(vectors.shape[:2], kind)
    if len(vectors) and books.width:
        for p, entries in enumerate(books.entries):
            codes[:, p], total = nearest(transform(vectors[:, p].astype(kind)), transform(np.array(entries, kind).reshape(len(entries), books.width)))
            errors[:, p] = total // size
    return codes, errors


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite components alone."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.col(vector).isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)))


def fit_codebooks(rows: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of all usable rows after ``rounds`` rounds; None without rows. Each round reads the table once."""
    table = usable(rows, vector).select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    first = table.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()
    if not first:
        return None
    length = len(first[0]["_v"])
    width = -(-length // parts)
    start = _integers(pa.array([r["_v"] for r in first if len(r["_v"]) == length], pa.list_(pa.float64())), length, width, parts, scale)[1]
    books = Codebooks(length, width, [[[int(x) for x in v] for v in start[:, p]] for p in range(parts)])
    vectors = table.select("_v")
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            counts: dict[tuple[int, int], int] = {}
            totals: dict[tuple[int, int], list[int]] = {}
            for batch in batches:
                whole = _integers(batch.column(0), length, width, parts, scale)[1]
                codes, _ = _coded(whole, books)
                for p in range(parts):
                    for e in np.unique(codes[:, p]).tolist():
                        mine = whole[codes[:, p] == e, p]
                        counts[p, e] = counts.get((p, e), 0) + len(mine)
                        totals[p, e] = [a + int(b) for a, b in zip(totals.get((p, e), [0] * width), mine.sum(axis=0), strict=True)]
            keys = [(p, e, i) for p, e in counts for i in range(width)]
            cells = [(p, e, i, counts[p, e], str(totals[p, e][i])) for p, e, i in keys]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["p", "e", "i", "n", "s"])

        cells = vectors.mapInArrow(sums, "p int, e int, i int, n long, s string")
        found = cells.groupBy("p", "e", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each component of each entry
        moved = [[list(entry) for entry in part] for part in books.entries]
        for r in found:
            moved[r["p"]][r["e"]][r["i"]] = int(r["s"]) // r["n"]
        books = Codebooks(length, width, moved)
    return books


def encode(rows: DataFrame, books: Codebooks | None, *, vector: str = "embedding", scale: int = 4096, code_col: str = "code", error_col: str = "error") -> DataFrame:
    """All usable rows with their code, two hexadecimal digits a part, and the squared distance of the vector to its entries."""
    out = usable(rows.drop(code_col, error_col), vector)
    if books is None:
        return out.withColumns({code_col: F.lit(None).cast("string"), error_col: F.lit(None).cast("long")})
    names, at, parts = out.columns, out.columns.index(vector), len(books.entries)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at).cast(pa.list_(pa.float64()))
            right, whole = _integers(column, books.length, books.width, parts, scale)
            codes, errors = _coded(whole, books)
            texts, sums = [bytes(c).hex() for c in codes.astype(np.uint8)], [min(int(e), _LONG) for e in errors.sum(axis=1)]
            place = np.cumsum(right) - 1
            pick = lambda values: [values[k] if r else None for k, r in zip(place, right, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pick(texts), pa.string()), pa.array(pick(sums), pa.int64())], [*names, code_col, error_col])

    return out.mapInArrow(coded, StructType([*out.schema.fields, StructField(code_col, StringType()), StructField(error_col, LongType())]))


def with_group_error(rows: DataFrame, label: str, error: str, name: str) -> DataFrame:
    """Rows with the sum of ``error`` over rows of equal ``label``, nulls together.

    Sums are made map-side first. Up to ``MANY_LABELS`` of them are broadcast; beyond that rows join them by label and one of
    ``SALTS`` salts, so that a label with a third of all rows is spread.
    """
    key, total, salt = free(rows, "_key", "_total", "_salt")
    whole = F.sum(F.col(error).cast("decimal(38,0)"))
    capped = F.when(whole.isNotNull(), F.least(whole, F.lit(_LONG).cast("decimal(38,0)"))).cast("long")
    sums = kept(rows.groupBy(F.col(label).alias(key)).agg(capped.alias(total)), "label_errors")
    n = sums.count()
    if n <= MANY_LABELS:
        out = rows.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col(key)), "left")
    else:
        salted = sums.withColumn(f"{salt}_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn(salt, F.pmod(F.xxhash64(error, F.monotonically_increasing_id()), F.lit(SALTS)))
        out = out.join(salted, F.col(label).eqNullSafe(F.col(key)) & (F.col(salt) == F.col(f"{salt}_")), "left").drop(salt, f"{salt}_")
    return out.drop(key).withColumnRenamed(total, name)


def quantise(rows: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """All usable rows with ``code``, ``error``, ``label_error`` and ``codebooks_sha256``, which replace columns of these names."""
    books = fit_codebooks(rows, id_col=id_col, vector=vector, parts=parts, entries=entries, rounds=rounds, scale=scale)
    coded = kept(encode(rows, books, vector=vector, scale=scale).drop("label_error", "codebooks_sha256"), "codes")
    digest = F.lit(books.sha256() if books else None).cast("string")
    return with_group_error(coded, label, "error", "label_error").withColumn("codebooks_sha256", digest)


def sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """SQL for the rows of the query over ``embeddings``, each round a step of its own."""
    steps = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT rid, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) r(p))",
        f"b0 AS MATERIALIZED (SELECT p, e, v FROM x JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {entries}) USING (rid))",
    ]
    near = "SELECT rid, x.p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.rid, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN {b} b ON b.p = x.p) x GROUP BY rid, x.p"
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(b=f'b{r}')})")
        steps.append(f"m{r} AS MATERIALIZED (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT x.p, a.e, i, sum(x.v[i]) AS s, count(*) AS n FROM x JOIN a{r} a ON a.rid = x.rid AND a.p = x.p, LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS i) GROUP BY x.p, a.e, i) GROUP BY p, e)")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(b=f'b{rounds}')})")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    steps.append(f"c AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    return f"WITH {', '.join(steps)} SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN c ON c.rid = k.rid, h"
