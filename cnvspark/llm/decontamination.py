"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern of token positions, some of which are ignored. Wherever a document and a benchmark item agree on
all kept positions of a mask, they share a hit; substitutions at ignored positions do not hurt. From a hit the
overlap is followed along its diagonal in both directions with substitutions allowed, and kept if it is long and
alike enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cnvspark.llm.common import free, kept
from cnvspark.llm.words import word_hashes

#: Kept (1) and ignored (0) positions. The first two hit every stretch of 8 words or more of which four fifths are equal: with
#: at most a fifth of its words changed it has a run of four equal words, or (10, 11 and 15 words) three, a change and two.
MASKS = ("1111", "111011", "110100110101011", "1110010100110101", "1101100011010101")
#: Items of fewer words are found by their words in full.
_WHOLE = 8

SCHEMA = "doc_id long, items array<struct<item_id:long,start:long,end:long,matched:long>>, contaminated boolean"
#: Hits that are looked at together.
_HITS = 100_000
_ITEM = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64())])


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash at each position where the mask fits into ``tokens`` (unsigned 64-bit)."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15 ^ len(mask)), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ tokens[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(29)
    return out


class Index:
    """The seeds of a block of benchmark items, sorted, with a bitmap before them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], masks: tuple[str, ...], bits: int):
        spread, masks = masks, _with_short(items, masks)
        self.items, self.masks, self.bits = items, masks, bits
        self.tokens = np.concatenate([t for _, t in items])
        self.sizes = np.array([len(t) for _, t in items])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tables = []
        for mask in masks:
            found = [(seeds(t, mask), k) for k, (_, t) in enumerate(items) if len(t) >= _WHOLE and mask in spread or mask == "1" * len(t)]
            keys = np.concatenate([s for s, _ in found] or [np.empty(0, np.uint64)])
            which = np.concatenate([np.full(len(s), k) for s, k in found] or [np.empty(0, np.int64)]).astype(np.int64)
            at = np.concatenate([np.arange(len(s)) for s, _ in found] or [np.empty(0, np.int64)])
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << bits, bool)
            bitmap[keys >> np.uint64(64 - bits)] = True
            self.tables.append((keys[order], which[order], at[order], bitmap))

    def hits(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions, items and positions in the items of all hits in a run of tokens, in parts."""
        for mask, (keys, which, at, bitmap) in zip(self.masks, self.tables, strict=True):
            found = seeds(tokens, mask)
            places = np.flatnonzero(bitmap[found >> np.uint64(64 - self.bits)])
            low, high = np.searchsorted(keys, found[places]), np.searchsorted(keys, found[places], "right")
            ends = np.cumsum(high - low)
            for k in range(0, int(ends[-1]) if len(ends) else 0, _HITS):
                n = np.arange(k, min(k + _HITS, int(ends[-1])))
                of = np.searchsorted(ends, n, "right")
                entry = high[of] - ends[of] + n
                yield places[of], which[entry], at[entry]


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, similarity: float, least: float = 0) -> tuple[int, int, int]:
    """(start in the document, end, matches) of the longest stretch on a diagonal that is equal in at least ``similarity`` of its
    positions; of equally long ones that with most matches. Changed words at its ends are left out down to ``least`` words.
    """
    start = max(0, diagonal)
    end = min(len(doc), diagonal + len(item))
    same = doc[start:end] == item[start - diagonal : end - diagonal]
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - similarity, -similarity))])
    # The first place where the running minimum is not above the total at an end begins the longest stretch to there.
    begins = np.searchsorted(-np.minimum.accumulate(total), -(total + 1e-9))
    length = np.arange(len(total)) - begins
    matches = np.concatenate([[0], np.cumsum(same)])
    longest = np.flatnonzero(length == length.max())
    high = int(longest[(matches[longest] - matches[begins[longest]]).argmax()])
    begin = int(begins[high])
    matched = int(matches[high] - matches[begin])
    while high - begin > least and not same[high - 1]:
        high -= 1
    while high - begin > least and not same[begin]:
        begin += 1
    return start + begin, start + high, matched


def _alike(tokens: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, index: Index, k: np.ndarray, at: np.ndarray, min_tokens: int, similarity: float) -> np.ndarray:
    """Which hits can lie in an overlap, by the equal words near them: an overlap has a part of ``min_tokens`` to twice as many
    words that is alike itself. ``first`` and ``last`` bound the text of each hit in ``tokens``.
    """
    size = index.sizes[k]
    here = index.starts[k] + at
    equal = np.zeros(len(place), np.int64)
    for o in range(2 - 2 * min_tokens, 2 * min_tokens - 1):
        x, y = place + o, at + o
        inside = (x >= first) & (x < last) & (y >= 0) & (y < size)
        equal += inside & (tokens[np.where(inside, x, 0)] == index.tokens[np.where(inside, here + o, 0)])
    return equal >= similarity * np.minimum(min_tokens, size) - 1e-9


def find_overlaps(texts: list[np.ndarray], index: Index, min_tokens: int, min_share: float, similarity: float) -> list[list[dict]]:
    """The verified overlaps of each text: at least ``min_tokens`` words, or the whole of a shorter item, and at least
    ``min_share`` of the item, equal in at least ``similarity`` of the positions. Of each item the best one counts.

    The texts are hashed as one run. A hit over an end of a text is of no account, as overlaps are checked text by text.
    """
    ends = np.cumsum([len(t) for t in texts])
    tokens = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    tried: set[tuple[int, int, int]] = set()
    for place, which, at in index.hits(tokens):
        of = np.searchsorted(ends, place, "right")
        first = ends[of] - np.array([len(t) for t in texts])[of]
        good = _alike(tokens, first, ends[of], place, index, which, at, min_tokens, similarity)
        for doc, k, diagonal in zip(of[good].tolist(), which[good].tolist(), (place - first - at)[good].tolist(), strict=True):
            if (doc, k, diagonal) in tried:
                continue
            tried.add((doc, k, diagonal))
            item = index.items[k][1]
            least = max(min(min_tokens, len(item)), min_share * len(item)) if len(item) >= _WHOLE else len(item)
            start, end, matched = overlap(texts[doc], item, diagonal, similarity, least)
            if len(item) < _WHOLE and matched < len(item):
                continue
            if end - start >= least and matched >= similarity * (end - start) - 1e-9 and matched > best[doc].get(k, (0, 0, 0))[2]:
                best[doc][k] = (start, end, matched)
    return [[{"item_id": index.items[k][0], "start": s, "end": e, "matched": m} for k, (s, e, m) in sorted(x.items(), key=lambda y: index.items[y[0]][0])] for x in best]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, min_tokens: int = 13, min_share: float = 0.0, similarity: float = 0.8, block_tokens: int = 1_000_000, keep: bool = False) -> DataFrame:
    """One row for each document: its verified overlaps with benchmark items and whether it is contaminated.

    Words are compared in lower case and without marks at their edges. An overlap counts if it has ``min_tokens`` words or
    more (or is the whole of a shorter item) and at least ``similarity`` of its words are equal, wherever the others stand, at
    its ends too; ``start`` and ``end`` count words. Items below eight words are found by their words in full. Null and empty texts have no overlaps; null ids stay null; repeated rows get equal results;
    an empty benchmark contaminates nothing; other columns are ignored. With ``keep`` the rows of ``docs`` that are not
    contaminated come back instead, with all their columns.

    The benchmark goes to the tasks in blocks of at most ``block_tokens`` words, one pass over the documents for each
    block, so what a task holds is bounded by one block. Documents are not shuffled where one block holds the benchmark; where
    there are several, they are written once with a key, and by it the blocks' findings are merged. The stream of benchmark
    rows passes the driver a block at a time.
    """
    spark, columns = docs.sparkSession, docs.columns
    id_name = id_col if id_col in columns else None
    (key,) = free(docs, "row")
    current = row = first = None
    for block in _blocks(benchmark.select(benchmark[item_col].cast("long"), benchmark[item_text_col]), block_tokens):
        shared = spark.sparkContext.broadcast(Index(block, masks, 20))
        if first is None:
            first = shared
            continue
        if row is None:  # a second block
            some = docs if keep else docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
            text_name = text_col if keep else "text"
            row = kept(some.withColumn(key, F.monotonically_increasing_id()), "rows")
            current = _overlaps(row, key, text_name, first, min_tokens, min_share, similarity)
        current = current.unionByName(_overlaps(row, key, text_name, shared, min_tokens, min_share, similarity))
    if keep and row is not None:
        dirty = current.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
        return row.join(dirty, key, "left_anti").drop(key)
    if keep:
        return docs if first is None else _keep_clean(docs, text_col, first, min_tokens, min_share, similarity)
    if first is None:
        return docs.select(docs[id_col].cast("long").alias("doc_id"), F.array().cast("array<struct<item_id:long,start:long,end:long,matched:long>>").alias("items"), F.lit(False).alias("contaminated"))
    return _overlaps(docs, id_name, text_col, first, min_tokens, min_share, similarity) if row is None else _merge(current, row.withColumnRenamed(key, "row"))


def _with_short(block: list[tuple[int, np.ndarray]], masks: tuple[str, ...]) -> tuple[str, ...]:
    """The masks, and for items below eight words a solid mask of their length."""
    return (*masks, *(m for n in sorted({len(t) for _, t in block if len(t) < _WHOLE}) if (m := "1" * n) not in masks))


def _blocks(items: DataFrame, block_tokens: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, size = [], 0
    for item_id, text in items.toLocalIterator():
        tokens = word_hashes([text or ""])[0]
        if not len(tokens):
            continue
        block.append((item_id, tokens))
        size += len(tokens)
        if size >= block_tokens:
            yield block
            block, size = [], 0
    if block:
        yield block


def _overlaps(docs: DataFrame, id_col: str, text_col: str, shared, min_tokens: int, min_share: float, similarity: float) -> DataFrame:
    arrow = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(_ITEM)), ("contaminated", pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = find_overlaps(word_hashes([x or "" for x in part.column(1).to_pylist()]), shared.value, min_tokens, min_share, similarity)
                yield pa.record_batch([part.column(0), pa.array(found, pa.list_(_ITEM)), pa.array([bool(x) for x in found])], schema=arrow)

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(search, SCHEMA)


def _merge(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The overlaps of all blocks of the benchmark, by the key of each row (``found`` has it as its id)."""
    items = found.where("contaminated").groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = rows.select("doc_id", "row").join(items.withColumnRenamed("doc_id", "row"), "row", "left")
    none = F.array().cast("array<struct<item_id:long,start:long,end:long,matched:long>>")
    return both.select("doc_id", F.coalesce("items", none).alias("items"), F.col("items").isNotNull().alias("contaminated"))


def _keep_clean(docs: DataFrame, text_col: str, shared, min_tokens: int, min_share: float, similarity: float) -> DataFrame:
    at = docs.columns.index(text_col)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                clean = [not x for x in find_overlaps(word_hashes([x or "" for x in part.column(at).to_pylist()]), shared.value, min_tokens, min_share, similarity)]
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(search, docs.schema)
