"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A text is measured once: lengths, symbols, repeats, stop words and lines, all by built-in functions on the text and on the
array of its words. Each row of the table bounds one ratio of these measures. The compiled column holds the measures and the
names of the rules that a text fails, so nothing is shuffled and no Python worker runs.

Words stand between ``\\x20`` and ``\\x09`` to ``\\x0D``. A null or empty text has no words: all its counts are 0, it fails the
base rule, and it is not kept. Repeated rows and ties are measured row by row. Other columns stay; one that bears the
result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cnvspark.llm.common import free

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
            "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
            "le la les de des du et un une en à est que qui dans pour pas au sur se par plus ce il elle avec son "
            "el los las y que un una es por con no para su al lo como más pero sus".split()
        )
    )
)
#: As they are found: in lower case or with a capital, as words of their own.
_STOP_FORMS = tuple(sorted({f(w) for w in STOP_WORDS for f in (str, str.capitalize)}))
_SPACES = " \t\n\x0b\x0c\r"


class Rule(NamedTuple):
    """A row of the table: a ratio of :data:`RATIOS` and its bounds, both allowed; None does not bound."""

    name: str
    ratio: str
    low: float | None
    high: float | None


#: The ratios by name: two measures, of which the first is divided by the second (at least 1).
RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_share": ("n_stop_words", "n_words"),
    "lettered_share": ("n_lettered", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "bullet_line_share": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_share": ("n_ellipsis_lines", "n_lines"),
}
#: The thresholds, close to those published for web text; ``stop_words`` asks for a share, as texts are of any length.
TABLE = (
    Rule("word_length", "mean_word_length", 2.0, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("stop_words", "stop_word_share", 0.02, None),
    Rule("letters", "lettered_share", 0.7, None),
    Rule("repeated_lines", "dup_line_share", None, 0.4),
    Rule("bullets", "bullet_line_share", None, 0.9),
    Rule("ellipses", "ellipsis_line_share", None, 0.3),
)
#: The base rule: at least so many words, and at most so many percent of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lettered", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def _words(text: Column) -> Column:
    """The words of a text: other white space becomes spaces, and a plain space needs no pattern to split at."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def _windows(words: Column) -> Column:
    """Windows of three words with their places from 1, sorted by words; NULL below four words, as none can repeat."""
    n = F.size(words) - 2
    part = lambda k, name: F.slice(words, F.lit(k), n).alias(name)
    return F.when(F.size(words) >= 4, F.sort_array(F.arrays_zip(part(1, "a"), part(2, "b"), part(3, "c"), F.sequence(F.lit(1), n).alias("i"))))


def _repeated(windows: Column) -> Column:
    """How many places lie in windows that have an equal neighbour in the sorted array, each counted once."""
    m = F.size(windows) - 1
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    places = lambda x: [x["i"] + k for k in range(3)]
    pairs = F.zip_with(F.slice(windows, F.lit(1), m), F.slice(windows, F.lit(2), m), lambda x, y: F.when(same(x, y), F.array(*places(x), *places(y))))
    return F.coalesce(F.size(F.array_distinct(F.flatten(F.array_compact(pairs)))), F.lit(0))


def compiled(m: Callable[[str], Column], table: tuple[Rule, ...] = TABLE) -> tuple[Column, Column]:
    """(``base_failed``, ``failed``) of the measures that ``m`` gives by name: the base rule, and the names of the table's rules
    that a text fails, in the table's order.
    """
    base = (m("n_words") < LEAST_WORDS) | (100 * m("n_repeat_words") > MOST_REPEATED * m("n_words"))
    broken = []
    for rule in table:
        top, below = (m(x) for x in RATIOS[rule.ratio])
        ratio = top / F.greatest(below, F.lit(1))
        bounds = [*([ratio < rule.low] if rule.low is not None else []), *([ratio > rule.high] if rule.high is not None else [])]
        if bounds:
            broken.append(F.when(bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1], F.lit(rule.name)))
    return base, F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, table: tuple[Rule, ...] = TABLE, *, text_col: str = "text", rules_col: str = "rules") -> DataFrame:
    """All rows of ``docs`` with ``rules_col``, a struct of :data:`MEASURES`, ``base_failed``, ``failed`` (names of the table's
    rules) and ``kept``. Words and sorted windows are columns on the way, so each is made once; all of it is one chain
    of projections without a shuffle.
    """
    text, words, windows, lines, found = free(docs, "_text", "_words", "_windows", "_lines", "_measures")
    t, w = F.col(text), F.col(words)
    count = lambda test: F.size(F.filter(lines, test))
    parts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(F.col(lines)) - F.size(F.array_distinct(F.col(lines))),
        "n_repeat_words": _repeated(F.col(windows)),
        "n_stop_words": F.size(F.filter(words, lambda x: x.isin(*_STOP_FORMS))),
        "n_lettered": F.regexp_count(t, F.lit(r"\p{L}[^\x20\x09-\x0D]*")),
        "n_lines": F.size(F.col(lines)),
        "n_bullet_lines": count(lambda x: F.rlike(x, F.lit(r"^[\x20\x09]*[-*•‣▪]"))),
        "n_ellipsis_lines": count(lambda x: F.rtrim(x, F.lit(_SPACES)).endswith("...") | F.rtrim(x, F.lit(_SPACES)).endswith("…")),
    }
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumns({words: _words(t), lines: F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))})
    rows = rows.withColumn(windows, _windows(w))
    rows = rows.select(*docs.columns, F.struct(*(parts[k].cast("long").alias(k) for k in MEASURES)).alias(found))
    base, failed = compiled(lambda k: F.col(found)[k], table)
    rows = rows.withColumn(found, F.struct(*(F.col(found)[k].alias(k) for k in MEASURES), base.alias("base_failed"), failed.alias("failed")))
    kept = ~F.col(found)["base_failed"] & (F.size(F.col(found)["failed"]) == 0)
    others = [c for c in docs.columns if c.lower() != rules_col.lower()]
    return rows.select(*others, F.col(found).withField("kept", kept).alias(rules_col))


def sql(table: tuple[Rule, ...] = TABLE) -> str:
    """SQL for the rows of the query over ``documents``."""
    counts = {
        "n_stop_words": f"len(list_filter(ws, lambda x: x IN ({', '.join(repr(w) for w in _STOP_FORMS)})))",
        "n_lettered": "len(regexp_extract_all(text, '\\pL[^\\x20\\x09-\\x0D]*'))",
        "n_lines": "len(ls)",
        "n_bullet_lines": "len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•‣▪]')))",
        "n_ellipsis_lines": "len(list_filter(ls, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)[\\x20\\x09\\x0B-\\x0D]*\\z')))",
    }
    broken = []
    for rule in table:
        top, below = RATIOS[rule.ratio]
        ratio = f"CAST({top} AS DOUBLE) / greatest({below}, 1)"
        broken += [f"{ratio} < {rule.low!r}"] * (rule.low is not None) + [f"{ratio} > {rule.high!r}"] * (rule.high is not None)
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
 g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
 r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
 m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {', '.join(f'{v} AS {k}' for k, v in counts.items())} FROM w LEFT JOIN r ON r.rid = w.rid),
 b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(broken) or 'false'}) AS kept FROM b"""
