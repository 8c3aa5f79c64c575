"""Information-theoretic sanitising of personal data, in DataFrame functions alone.

Entities are what five patterns find: an address, a number, or an opaque secret; and, for each of these kinds, that there is one. The corpus then tells which other terms give an entity away: with n_c documents
that hold entity c, n_t that hold term t, n_ct in which t stands near c, and N in all, the term
discloses ln(N n_ct / (n_c n_t)) of the ln(N / n_c) that knowing the entity is worth. A term that is near an entity in
several texts, and whose share of disclosure reaches a threshold, is a span of its own in these texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cnvspark.llm.common import cut, free, text_key

KINDS = ("email", "ip", "card", "phone", "secret", "term")
SECRET, TERM = 4, 5

# Patterns that match what the documented ones match, in time that grows with the text. A local part begins where its
# run of letters begins or where the last match ended; digit runs are taken whole.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: On a text whose spaces and hyphens that do not stand between digits are line ends.
CARD = r"[0-9 \-]{12,}"
LONE_MARK = r"(?<![0-9])[ \-]|[ \-](?![0-9])"
HAS_CARD = r"[0-9](?:[ \-]?[0-9]){11}"
#: Runs of letters and digits that are longer than words and hold several digits, as keys and tokens do.
OPAQUE = r"(?<![A-Za-z0-9])(?=(?:[A-Za-z]*+[0-9]){3})(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,}+"
HAS_OPAQUE = r"[A-Za-z0-9]{20}"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Matches whose places are summed up in one go: arrays grow one by one only within so many.
_BLOCK = 64


def find_spans(text: Column, pattern: Column, kind: int) -> Column:
    """Every leftmost non-overlapping match as (start, kind, end, value), in code points, from what stands between the
    matches and the matches themselves. Places are summed up in blocks of matches, then over the blocks.
    """
    empty = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def joined(acc: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda y: F.struct((y["start"] + acc["at"]).alias("start"), y["kind"].alias("kind"), (y["end"] + acc["at"]).alias("end"), y["value"].alias("value")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["spans"], F.array(moved)).alias("spans"))

    def placed(pairs: Column) -> Column:
        few = F.aggregate(pairs, start, step)["spans"]
        blocks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(_BLOCK)), lambda k: F.aggregate(F.slice(pairs, k, F.lit(_BLOCK)), start, step))
        many = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans")), joined)["spans"]
        return F.when(F.size(pairs) <= _BLOCK, few).otherwise(F.flatten(many))

    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.call_function("split", text, pattern, F.lit(-1)).alias("gaps"))
    pairs = _bound(found, lambda x: F.zip_with(x["hits"], F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), lambda h, g: F.struct(h.alias("hit"), g.alias("gap"))))
    return F.coalesce(_bound(pairs, placed), empty)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weigh(total: Column, k: Column) -> Column:
        d = F.ascii(F.substr(digits, n - k + 1, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(k % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), weigh) % 10 == 0


def _ok_ip(x: Column) -> Column:
    return ~F.exists(F.split(x["value"], r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) > 255)


def _ok_card(x: Column) -> Column:
    d = _digits(x["value"])
    return F.length(d).between(12, 19) & _luhn(d)


def _ok_phone(x: Column) -> Column:
    return F.length(_digits(x["value"])).between(9, 15)


def base_spans(text: Column) -> Column:
    """The spans of the four base kinds and of secrets in order of start, then kind. Texts without a needed sign are not searched."""
    empty = F.array().cast(_SPAN)
    found = [
        F.when(F.contains(text, F.lit("@")), find_spans(text, F.lit(EMAIL), 0)),
        F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), F.filter(find_spans(text, F.lit(IP), 1), _ok_ip)),
        F.when(text.rlike(HAS_CARD), F.filter(find_spans(F.regexp_replace(text, LONE_MARK, "\n"), F.lit(CARD), 2), _ok_card)),
        F.when(text.rlike(HAS_OPAQUE), find_spans(text, F.lit(OPAQUE), SECRET)),
        F.when(F.contains(text, F.lit("+")), F.filter(find_spans(text, F.lit(PHONE), 3), _ok_phone)),
    ]
    return F.sort_array(F.concat(*(F.coalesce(x, empty) for x in found)))


def _entity(x: Column) -> Column:
    """The protected value that a span names: its digits, or an address in lower case."""
    value = F.when(x["kind"].isin(2, 3), _digits(x["value"])).when(x["kind"] == SECRET, x["value"]).otherwise(F.lower(x["value"]))
    return F.concat(_kind(x), F.lit(":"), value)


def _kind(x: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["kind"] + 1)


_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_TERM = r"^[\p{L}\p{N}]{3,}$"


def _words(text: Column) -> Column:
    """Terms of a text: words in lower case without marks at their edges, of three letters or digits at least."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, _EDGES, "")), lambda w: w.rlike(_TERM))


def _context(text: Column, x: Column, words: int, reach: int) -> Column:
    """The terms within ``words`` words on either side of a span, looked for within ``reach`` code points."""
    low = F.greatest(x["start"] - reach, F.lit(0))
    left = F.split(F.substr(text, low + 1, x["start"] - low), r"\s+")
    left = F.when(low > 0, F.slice(left, F.lit(2), F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left)
    right = F.split(F.substr(text, x["end"] + 1, F.lit(reach)), r"\s+")
    right = F.when(F.length(text) > x["end"] + reach, F.slice(right, F.lit(1), F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
    left, right = (F.filter(x, lambda w: w != "") for x in (left, right))
    near = F.concat(F.slice(F.reverse(left), F.lit(1), F.lit(words)), F.slice(right, F.lit(1), F.lit(words)))
    return F.array_sort(F.array_distinct(_words(F.array_join(near, " "))))


def near_entities(docs: DataFrame, text: Column, *, words: int, reach: int) -> DataFrame:
    """(key, entity, near, docs): for each text, by its key, the terms near each entity in it, and how many rows have the text.

    A span stands for two entities: its value, and that there is one of its kind (``kind:*``).
    """
    x = F.transform(base_spans(text), lambda x: F.struct(_kind(x).alias("kind"), _entity(x).alias("entity"), _context(text, x, words, reach).alias("near")))
    rows = docs.select(text_key(text).alias("key"), F.explode(F.array_distinct(x)).alias("x"))
    each = rows.groupBy("key", "x").agg(F.count(F.lit(1)).alias("docs"))
    both = F.explode(F.array(F.col("x.entity"), F.concat("x.kind", F.lit(":*"))))
    return cut(each.select("key", both.alias("entity"), F.col("x.near").alias("near"), "docs"))


def disclosing_terms(docs: DataFrame, text: Column, near: DataFrame, *, min_texts: int = 3, threshold: float = 0.9) -> DataFrame:
    """(entity, term, texts, share): the terms that disclose an entity.

    Only terms that stand near an entity in ``min_texts`` different texts count, so that what a text says once, and copies of
    it, are no evidence. Counts run over all rows, copies included.
    """
    holders = near.groupBy("entity", "key").agg(F.max("docs").alias("docs")).groupBy("entity").agg(F.sum("docs").alias("n_c"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_texts).drop("texts")
    each = near.select("entity", "key", "docs", F.explode("near").alias("term")).groupBy("entity", "term", "key").agg(F.max("docs").alias("docs"))
    both = each.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("docs").alias("n_ct")).where(F.col("texts") >= min_texts)
    pairs = cut(both)
    if pairs.isEmpty():
        return pairs.select("entity", "term", "texts", F.lit(1.0).alias("share"))
    # Every word is counted: counts of a task combine before the shuffle, so it moves a row for each word and task.
    all_words = docs.select(F.explode(F.array_distinct(_words(text))).alias("term"))
    seen = all_words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n = F.lit(float(max(docs.count(), 2)))
    share = F.ln(n * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))) / F.ln(F.greatest(n / F.col("n_c"), F.lit(2.0)))
    scored = pairs.join(holders, "entity").join(seen, "term")
    return cut(scored.select("entity", "term", "texts", share.alias("share")).where(F.col("share") >= threshold))


def sanitize(docs: DataFrame, *, text_col: str = "text", words: int = 8, reach: int = 160, min_texts: int = 3, threshold: float = 0.9, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Adds ``spans`` (start, kind, end, value; kinds are places in :data:`KINDS`) and ``clean`` to all rows of ``docs``.

    ``clean`` is the text with entities generalised to the name of their kind and disclosing terms removed to a mark. A
    term is near an entity within ``words`` words that lie within ``reach`` code points of it, and a disclosing one is a span
    wherever it stands in a text in which it is near its entity. A null text has no spans and stays null; an empty one stays
    empty; repeated rows get the same result; an empty table gives no rows. Columns of ``docs`` named ``spans`` or
    ``clean`` are replaced, all others stay.

    Most texts hold no entity and are done in one pass. What stands near entities is written once. Terms join the texts they
    were found in by (entity, term), so no group holds all texts of one entity; texts get them by a hash of the text,
    broadcast while they take at most ``broadcast_bytes``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*(c for c in docs.columns if c not in ("spans", "clean")))
    near = near_entities(docs, text, words=words, reach=reach)
    revealing = disclosing_terms(docs, text, near, min_texts=min_texts, threshold=threshold)
    each = near.select("key", "entity", F.explode("near").alias("term"))
    marked = cut(each.join(revealing.select("entity", "term"), ["entity", "term"]).groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    size = marked.agg(F.sum(32 + F.octet_length(F.array_join("terms", "    "))).alias("bytes")).first()["bytes"]
    rows = rows.withColumn("spans", base_spans(text))
    if size:
        key, terms = free(rows, "_key", "_terms")
        named = marked.select(F.col("key").alias(key), F.col("terms").alias(terms))
        rows = rows.withColumn(key, text_key(F.col(text_col))).join(F.broadcast(named) if size <= broadcast_bytes else named, key, "left")
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        apart = F.filter(find_spans(text, pattern, TERM), lambda t: ~F.exists("spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        rows = rows.withColumn("spans", F.when(F.col(terms).isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", apart)))).drop(key, terms)
    return rows.withColumn("clean", F.when(F.size("spans") == 0, F.col(text_col)).otherwise(_cleaned(text)))


def _cleaned(text: Column) -> Column:
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, x: Column) -> Column:
        kept_text = F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.element_at(names, x["kind"] + 1))
        inside = x["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(kept_text).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    """How many spans of one kind there are."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
