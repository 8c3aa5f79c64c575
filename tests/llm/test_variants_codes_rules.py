import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from cnvspark.llm import queries, quality_rules, spelling, vector_codes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling", "op12_vector_codes", "op13_quality_rules"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    assert set(got.columns) == set(want.columns)
    rows = sorted(map(repr, want.project(", ".join(f'"{c}"' for c in got.columns)).fetchall()))
    assert rows and sorted(repr(tuple(r)) for r in got.collect()) == rows


# --- spelling ---------------------------------------------------------------------------------------------------------


def brute_words(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    def root(w):
        while out[w][0] is not None:
            w = out[w][0]
        return w
    return {w: (f, root(w), n, k, fn) for w, (f, n, k, fn) in out.items()}


def grouped(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_against_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = ["abcdefgh", "abcdefghé", "abcdefgé", "Ébcdefgh", "hgfedcba", "aaaaaaaa", "aaaaaaaaa", "aaaaaaab", "zzzzzzz", "z" * 3000, "z" * 2999, "z" * 2998 + "y"]
    for _ in range(60):
        w = list(rng.choice(base[:9]))
        kind, at = rng.randrange(3), rng.randrange(len(w))
        w[at : at + (kind != 0)] = [rng.choice("abcxyzéÿ")] * (kind != 2)
        base.append("".join(w))
    rows = [(i, " ".join(rng.choice(base) for _ in range(40)) + ("; ABCDEFGH" * 90 if i % 3 == 0 else "")) for i in range(60)]
    rows += [(None, "zzzzzzz zzzzzzz abcdefgh"), (3, rows[3][1]), (7, None), (8, "")]
    rows += [(200 + i, "chainword " * n) for i, n in enumerate([1000])] + [(300, "chainworx " * 100), (301, "chainxorx " * 10), (302, "chaixxorx chaixxorx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "key")}).repartition(5)
    want = brute_groups(brute_words(rows))
    assert any(f for f, *_ in want.values()) and max(len(w) for w in want) >= 2999
    assert grouped(spelling.group_spellings(df)) == want
    monkeypatch.setattr(spelling, "BLOCK", 3)  # many blocks of a key meet each other
    assert grouped(spelling.group_spellings(df)) == want


def test_chains_of_forms(spark):
    names = "abcdefghijklmnopq"
    links = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:])], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(links, len(names)).collect()} == {c: "q" for c in names[:-1]}


def test_spelling_of_odd_tables(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert grouped(spelling.group_spellings(odd)) == brute_groups(brute_words(rows))
    assert spelling.group_spellings(none).collect() == []


# --- vector codes -----------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    size = len(whole[0]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][1]))[:entries]
    books = [[cut(whole[k], p) for k in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (dist(cut(v, p), books[p][e]), e)) for p in range(parts)] for v in whole]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for v, c in zip(whole, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    codes = assign()
    cap = lambda x: min(x, 2**63 - 1)
    errors = [cap(sum(dist(cut(v, p), books[p][c[p]]) for p in range(parts))) for v, c in zip(whole, codes)]
    by_label = Counter()
    for (_, _, k), e in zip(kept, errors):
        by_label[k] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{x:02x}" for x in c), e, cap(by_label[k]), digest)) for (i, _, k), c, e in zip(kept, codes, errors))


def coded(df):
    return sorted(repr(tuple(r)) for r in vector_codes.quantise(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("scale,length", [(1.0, 24), (0.002, 16), (1e9, 8), (3e4, 40)])
def test_codes_against_brute_force(spark, scale, length):
    rng = np.random.default_rng(length)
    rows = [(int(i), [float(x) for x in scale * rng.normal(size=length)], int(i) % 3 if i % 5 else None) for i in range(90)]
    rows += [(90, None, 1), (91, [float("nan")] * length, 1), (92, [None] * length, 2), (93, [float("inf")] + [0.0] * (length - 1), 2), (94, [0.0] * length, None), (5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("_key", "code", "label_error", "p")}).repartition(4)
    assert coded(df) == brute_codes(rows)


def test_codes_when_labels_are_many(spark, monkeypatch):
    rows = [(i, [float((i * k) % 7) for k in range(1, 9)], i % 40 or None) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    monkeypatch.setattr(vector_codes, "MANY_LABELS", 5)
    assert coded(df) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert coded(spark.createDataFrame([], schema)) == []
    assert coded(spark.createDataFrame([(1, None, 1)], schema)) == []
    few = spark.createDataFrame([(1, [1.0] * 12, 1), (2, [2.0] * 12, 1), (3, [2.0] * 5, 1), (4, [], 2)], schema)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vector_codes.quantise(few).collect()}
    assert got == {1: ("00" * 8, 0, 0), 2: ("01" * 6 + "0000", 0, 0), 3: (None, None, 0), 4: (None, None, None)}
    huge = spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)] + [(3 + i, [0.0] * 8, 1) for i in range(20)], schema)
    assert vector_codes.quantise(huge).count() == 22


def test_transform_is_in_order_of_sign_changes():
    for size in (1, 2, 4, 16):
        rows = vector_codes.transform(np.eye(size, dtype=np.int64)).T  # a row of the matrix for each coefficient
        assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(size))
        assert (rows @ rows.T == size * np.eye(size)).all()


def test_nearest_entry_is_exact():
    rng = np.random.default_rng(1)
    for width in (1, 3, 5, 8):
        rows, entries = rng.integers(-4, 5, (300, width)), rng.integers(-4, 5, (7, width))
        index, total = vector_codes.nearest(vector_codes.transform(rows), vector_codes.transform(entries))
        all_ = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        size = 1 << (width - 1).bit_length()
        assert (index == all_.argmin(axis=1)).all() and (total == size * all_.min(axis=1)).all()


# --- quality rules ----------------------------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    forms = {f for w in quality_rules.STOP_WORDS for f in (w, w.capitalize())}
    m = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({k + i for k, g in enumerate(grams) if g in often for i in range(3)}),
        "n_stop_words": sum(w in forms for w in words),
        "n_lettered": sum(any(c.isalpha() for c in w) for w in words),
        "n_lines": len(lines),
        "n_bullet_lines": sum(bool(re.match(r"[ \t]*[-*•‣▪]", x)) for x in lines),
        "n_ellipsis_lines": sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines),
    }
    base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    failed = []
    for rule in quality_rules.TABLE:
        top, below = (m[x] for x in quality_rules.RATIOS[rule.ratio])
        r = top / max(below, 1)
        if rule.low is not None and r < rule.low or rule.high is not None and r > rule.high:
            failed.append(rule.name)
    return (*m.values(), base, failed, not base and not failed)


def texts():
    rng = random.Random(2)
    some = ["the", "of", "and", "Die", "word", "a", "b,", "x" * 30, "##", "12", "|", "...", "- ", "* item", "\n", "\r\n", "\t", "end…", "\x0b", "\x85", "\xa0x", "é", "漢字", "🙂", "\x00", "c d e"]
    out = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 160))) for _ in range(120)]
    return [*out, None, "", " \n\t ", "a b c " * 40, "one line\n" * 30, "the cat sat " + " ".join(f"w{i}" for i in range(60)), " ".join(f"the w{i}" for i in range(30_000)), "- the a\n" * 3 + " ".join(f"the v{i}" for i in range(90))]


def test_rules_against_brute_force(spark):
    rows = [(i, t, "a", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, rules string, _words int").repartition(4)
    got = {r["doc_id"]: tuple(r["rules"]) for r in quality_rules.apply_rules(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert got[i] == brute_rules(t), repr(t)[:200]
    assert any(g[-1] for g in got.values()) and len({n for g in got.values() for n in g[-2]}) >= 4


def test_rules_of_odd_tables(spark, odd, none):
    got = quality_rules.apply_rules(odd)
    assert set(got.columns) == {*odd.columns, "rules"} and got.count() == odd.count()
    assert quality_rules.apply_rules(none).collect() == []
    loose = quality_rules.apply_rules(odd, ()).select("rules.*").collect()
    assert all(r["failed"] == [] and r["kept"] == (not r["base_failed"]) for r in loose)


def test_rules_are_one_projection(spark):
    df = quality_rules.apply_rules(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ArrowEval" not in plan
