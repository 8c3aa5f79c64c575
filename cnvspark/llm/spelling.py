"""Groups of spelling variants: words that differ by one edit, found by products of letter-count blocks.

Words are counted over the whole corpus. Each word gets the counts of its letters; two words that differ by one inserted or
deleted letter have counts at a squared distance of 1, and those that differ by one replaced letter at 2. Words are put into
blocks by their length and by how many of their letters fall into each of a few fixed classes of letters, as one edit moves
these numbers by at most one up and one down. Blocks that can hold near words meet once: the product of their count matrices
gives all squared distances (a Gram matrix), pairs at most two apart in equal or adjacent lengths stay, and edits are then
verified on the letters themselves. A block of many words is cut into smaller ones, which meet each other; no pair is left out.

A word's form is its near word that occurs most (ties: the smallest) if it occurs ``ratio`` times as often at least; its
root is the end of the chain of forms, which is short, as counts grow by ``ratio`` at every step.

Null and empty texts have no words. A null id counts as an empty one. Rows that occur again count again. Texts and words of any
length are read whole. An empty table gives no words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cnvspark.llm.common import kept, single_threaded

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: The letters of words, all of them Latin-1, so a word is an array of bytes.
LETTERS = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
#: A block holds about so many words, fewer if these have more letters in all than the second number.
BLOCK, BLOCK_LETTERS = 1024, 2_000_000
#: A task holds about so many counts before it hands them on; candidates are verified so many letters at a time.
HELD, AT_ONCE = 400_000, 4_000_000
#: Below so many letters, all products are whole numbers that single precision holds exactly.
_SINGLE = 2000


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """(word, n) of all words of at least ``least`` letters that occur ``often`` times or more.

    A word is a maximal run of letters with A to Z in lower case. Where ``every`` divides the checksum of id and run, the letter at
    the checksum modulo the run's length is left out. Runs are counted by text, then by task, and then over all.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, found = zlib.crc32(f"{i}:".encode()), Counter(_RUN.findall(text))
                for run, n in found.items():
                    if len(run) < least:
                        continue
                    word = run.encode("latin-1").lower().decode("latin-1")
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield handed_on()
        yield handed_on()

    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _classes(words: int) -> int:
    """How many classes of letters: one more whenever words double, so that blocks stay about as large. It changes the
    blocks alone, not the pairs that are found.
    """
    return max(3, int(math.log2(words or 1)) - 13)


def _key(counts: list[Column]) -> Column:
    return F.concat_ws(",", *(c.cast("string") for c in counts))


def letter_blocks(words: DataFrame, classes: int) -> DataFrame:
    """(key, sub, parts, counts, words, ns): words by how many letters of each class they have, cut into ``parts`` blocks by a hash
    of the word. The words of a block have one length and come in order, as one string.
    """
    mine = lambda k: "".join(c for c in LETTERS if ord(c) % classes == k)
    counted = words.withColumn("counts", F.array(*(F.length("word") - F.length(F.translate("word", mine(k), "")) for k in range(classes))))
    counted = counted.withColumn("key", _key([F.get("counts", F.lit(k)) for k in range(classes)]))
    room = F.greatest(F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_LETTERS) / F.length(F.first("word")))), F.lit(1))
    sizes = counted.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("parts"))
    placed = counted.join(sizes, "key").withColumn("sub", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = placed.groupBy("key", "sub").agg(F.first("parts").alias("parts"), F.first("counts").alias("counts"), F.sort_array(F.collect_list(F.struct("word", "n"))).alias("rows"))
    return rows.select("key", "sub", "parts", "counts", F.array_join("rows.word", "").alias("words"), F.col("rows.n").alias("ns"))


def _meetings(blocks: DataFrame, classes: int) -> DataFrame:
    """(key, sub, other_key, other_sub) of all blocks that can hold near words, each two blocks once: equal keys, one letter more in
    a class, or one more in a class and one less in a later class.
    """
    keys = blocks.select("key", "parts", "counts").distinct()
    moves = [()] + [((i, 1),) for i in range(classes)] + [((i, 1), (j, -1)) for i in range(classes) for j in range(i + 1, classes)]
    moved = lambda m: _key([F.get("counts", F.lit(k)) + dict(m).get(k, 0) for k in range(classes)])
    wanted = keys.select("key", "parts", F.explode(F.array(*map(moved, moves))).alias("other_key"))
    met = wanted.join(keys.select(F.col("key").alias("other_key"), F.col("parts").alias("other_parts")), "other_key")
    rows = met.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    least = F.when(F.col("key") == F.col("other_key"), F.col("sub")).otherwise(0)
    return rows.withColumn("other_sub", F.explode(F.sequence(least, F.col("other_parts") - 1))).select("key", "sub", "other_key", "other_sub")


def _letters(words: str, n: int) -> np.ndarray:
    """The ``n`` words of a block as rows of bytes."""
    return np.frombuffer(words.encode("latin-1"), np.uint8).reshape(n, -1)


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` whose letter counts are at a squared distance of at most 2, by one matrix product:
    (A, |a|^2, 1) times (-2B, 1, |b|^2) transposed.
    """
    used = np.zeros(256, bool)
    used[a], used[b] = True, True
    kind = np.float32 if max(a.shape[1], b.shape[1]) < _SINGLE else np.int64
    place = np.cumsum(used) - 1

    def counts(x: np.ndarray) -> np.ndarray:
        cells = np.arange(len(x))[:, None] * int(used.sum()) + place[x]
        return np.bincount(cells.ravel(), minlength=len(x) * int(used.sum())).reshape(len(x), -1).astype(kind)

    ca, cb = counts(a), counts(b)
    left = np.column_stack([ca, (ca * ca).sum(axis=1), np.ones(len(a), kind)])
    right = np.column_stack([-2 * cb, np.ones(len(b), kind), (cb * cb).sum(axis=1)])
    return np.divmod(np.flatnonzero(left @ right.T <= 2), len(b))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` becomes that of ``b`` by one replaced letter (equal lengths) or one inserted letter (``b`` longer)."""
    n = a.shape[1]
    if n == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    same_from_left, same_from_right = a == b[:, :n], a == b[:, 1:]
    first = np.where(same_from_left.all(axis=1), n, (~same_from_left).argmax(axis=1))
    last = np.where(same_from_right.all(axis=1), -1, n - 1 - (~same_from_right)[:, ::-1].argmax(axis=1))
    return last < first


def _near(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near words in two blocks; those of one block with itself come once."""
    i, j = close_pairs(a, b)
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, AT_ONCE // b.shape[1])
    good = [one_edit(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return i[good], j[good]


def _best(mine: np.ndarray, others: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct number in ``mine``: how many others it has, and the one of largest n (ties: the first)."""
    order = np.lexsort((others, -ns[others], mine))
    mine, others = mine[order], others[order]
    starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, int)
    return mine[starts], np.diff(np.r_[starts, len(mine)]), others[starts]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of all words that have near words: their number, and the one of largest n (ties: the smallest)."""
    classes = _classes(words.count())
    blocks = kept(letter_blocks(words, classes), "blocks")
    sides = [blocks.select(F.col("key").alias(f"{p}key"), F.col("sub").alias(f"{p}sub"), F.col("words").alias(f"{p}words"), F.col("ns").alias(f"{p}ns")) for p in ("", "other_")]
    met = _meetings(blocks, classes).join(sides[0], ["key", "sub"]).join(sides[1], ["other_key", "other_sub"])
    same = (F.col("key") == F.col("other_key")) & (F.col("sub") == F.col("other_sub"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        for batch in batches:
            counts = [[x.values.to_numpy(zero_copy_only=False) for x in batch.column(k)] for k in (2, 4)]
            out: tuple[list, list, list, list] = [], [], [], []
            for same, words, others, ns, other_ns in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), *counts, strict=True):
                a, b = _letters(words, len(ns)), _letters(others, len(other_ns))
                i, j = _near(a, b, same)
                if same:  # both directions within one block
                    i, j = np.r_[i, j], np.r_[j, i]
                for mine, theirs, names, other_names, totals in [(i, j, a, b, other_ns)] + ([] if same else [(j, i, b, a, ns)]):
                    word, n, best = _best(mine, theirs, totals)
                    text = lambda x, rows: [r.tobytes().decode("latin-1") for r in x[rows]]
                    for column, values in zip(out, (text(names, word), n.tolist(), text(other_names, best), totals[best].tolist()), strict=True):
                        column += values
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "best", "best_n"])

    found = met.select(same.alias("same"), "words", "ns", "other_words", "other_ns").mapInArrow(compared, "word string, n_near long, best string, best_n long")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", F.col("top.word").alias("best"), (-F.col("top.n")).alias("best_n"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of at most ``steps`` forms, by joining the links with themselves, which
    doubles how far they reach.
    """
    links = forms.select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        links = kept(links.join(onward, "root", "left").select("word", F.coalesce("_on", "root").alias("root")), "roots")
        reach *= 2
    return links


def group_spellings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 7, often: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the corpus."""
    words = kept(count_words(docs, id_col=id_col, text_col=text_col, least=least, often=often, every=every), "words")
    found = words.join(near_words(words), "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    rows = kept(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "spellings")
    most = rows.agg(F.max("n")).first()[0] or 1
    ends = roots(rows.where("form is not null"), int(math.log(most, ratio)) + 1)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(least: int = 7, often: int = 2, every: int = 31, ratio: int = 10, steps: int = 20) -> str:
    """SQL for the rows of the query over ``documents``: near words share a word with a letter left out or replaced by a star."""
    crc = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295)"
    return f"""WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
 runs AS (SELECT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= {least} GROUP BY ALL),
 bytes AS (SELECT r, n, flatten(list_transform(string_split(d || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM runs),
 h AS (SELECT r, n, {crc} AS h FROM bytes, tbl),
 words AS MATERIALIZED (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % {every} = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS w FROM h) WHERE length(w) >= {least} GROUP BY w HAVING sum(n) >= {often}),
 parts AS MATERIALIZED (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS star, left(word, i) || substr(word, i + 2) AS gone FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
 pairs AS (SELECT a.word, b.word AS near, b.n FROM parts a JOIN parts b ON a.star = b.star AND a.word <> b.word UNION SELECT p.word, w.word, w.n FROM parts p JOIN words w ON w.word = p.gone UNION SELECT w.word, p.word, p.n FROM parts p JOIN words w ON w.word = p.gone),
 best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS top, max(n) AS top_n FROM pairs GROUP BY word),
 forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= {ratio} * w.n THEN top END AS form, CASE WHEN top_n >= {ratio} * w.n THEN top_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
 chain AS (SELECT word, word AS last_form, 0 AS k FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.last_form WHERE f.form IS NOT NULL AND k < {steps})
 SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(last_form, k) AS root FROM chain GROUP BY word) e ON e.word = f.word"""
