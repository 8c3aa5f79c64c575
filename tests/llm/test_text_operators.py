import collections
import hashlib
import math
import random
import re
import tracemalloc

import pytest
from cnvspark.llm.common import small_table
from cnvspark.llm.decontamination import decontaminate
from cnvspark.llm.fingerprints import fingerprint_documents
from cnvspark.llm import html_extraction
from cnvspark.llm.html_extraction import Tree, choose, extract_pages, main_text, match_trees, parse
from cnvspark.llm.pii import KINDS, SECRET, TERM, disclosing_terms, near_entities, sanitize, span_text
from pyspark.sql import functions as F


def jaccard(a, b):
    x, y = collections.Counter(a.lower().split()), collections.Counter(b.lower().split())
    return sum((x & y).values()) / (sum((x | y).values()) or 1)


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(5, 80)))) for i in range(60)]
    got = sorted(fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), samples=64).collect())
    errors = []
    for k, r in enumerate(got):
        t, n = rows[k][1], rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, n)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3


def test_fingerprints_odd_rows(odd, none):
    rows = fingerprint_documents(odd, samples=8).collect()
    assert len(rows) == odd.count()
    prints = {}
    for r in rows:
        prints.setdefault(r["doc_id"], r["fingerprint"])
    assert prints[0] == prints[43] == prints[44] and prints[40] == prints[41] == prints[45]
    assert fingerprint_documents(none).collect() == []


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_against_brute_force(spark):
    rng = random.Random(8)
    bits = ["a@b.c", "x_y@z.w.v", "@", ".", "1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (234) 567-8901", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", " ", "-", "é", "🙂", "+", "12", "\n", "a", "%", "5500005555555559", "(", "b@c-d.e", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["a@b.c_d@e.f", "9" * 5000, "1 " * 5000, "a" * 30000 + "@x.y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in sanitize(df).select("doc_id", span_text(F.filter("spans", lambda x: x["kind"] < 4)).alias("s")).collect():
        assert r["s"] == base(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


def test_disclosing_terms(spark):
    rng = random.Random(1)
    filler = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(filler) for _ in range(30))
        if i < 6:
            text += f" please write to zanzibar office at boss@corp.example number{i} today {rng.choice(filler)} " + " ".join(rng.choice(filler) for _ in range(20))
        rows.append((i, text))
    rows += [(1000 + i, rows[0][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in sanitize(df).collect()}
    for i in range(6):
        assert "[EMAIL]" in out[i]["clean"] and "[TERM]" in out[i]["clean"] and "zanzibar" not in out[i]["clean"]
        for s in out[i]["spans"]:
            assert rows[i][1][s["start"] : s["end"]] == s["value"]
    assert all(not out[i]["spans"] and out[i]["clean"] == rows[i][1] for i in range(6, 400))


def test_shares_against_a_plain_count(spark):
    rng = random.Random(8)
    filler = [f"word{i}" for i in range(60)]
    people = {f"p{i}@corp.example": [f"nick{i}", f"town{i}"] for i in range(6)}
    texts = []
    for i in range(300):
        words = [rng.choice(filler) for _ in range(30)]
        if i % 3 == 0:
            who = rng.choice([*people])
            at = rng.randrange(len(words))
            words[at:at] = [*rng.sample(people[who], rng.randint(0, 2)), who] + [rng.choice(filler) for _ in range(2)]
        texts.append(" ".join(words))
    texts += texts[:40]  # copies count as rows, not as further texts
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = near_entities(df, F.col("text"), words=3, reach=160)
    got = {(r["entity"], r["term"]): (r["texts"], r["share"]) for r in disclosing_terms(df, F.col("text"), near, min_texts=2, threshold=-9).collect()}
    spots = collections.defaultdict(set)
    for i, t in enumerate(texts):
        words = t.split()
        for at, w in enumerate(words):
            if "@" in w:
                for x in words[max(0, at - 3) : at] + words[at + 1 : at + 4]:
                    if "@" not in x:
                        spots[w, x].add(i)
                        spots["", x].add(i)
                spots[w, None].add(i)
                spots["", None].add(i)
    holds = collections.Counter(x for t in texts for x in set(t.split()))
    want = {}
    for (who, x), rows in spots.items():
        n_c, kinds = len(spots[who, None]), len({texts[i] for i in rows})
        if x and kinds >= 2:
            n = len(texts)
            want[f"email:{who}" if who else "email:*", x] = (kinds, math.log(n * len(rows) / (n_c * holds[x])) / math.log(max(n / n_c, 2)))
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    spans = {r["doc_id"]: [x["value"] for x in r["spans"] if x["kind"] == TERM] for r in sanitize(df, words=3).collect()}
    assert {v[:4] for found in spans.values() for v in found} == {"nick", "town"}


def test_secrets_and_what_says_that_there_is_one(spark):
    rng = random.Random(9)
    filler = [f"word{i}" for i in range(100)]
    rows = []
    for i in range(200):
        words = [rng.choice(filler) for _ in range(30)]
        if i < 8:
            words[10:10] = ["apikey", "=", '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"']
        rows.append((i, " ".join(words)))
    rows += [(300, "averyverylongwordwithoutanydigitsinit 12345678901234567890123 short1a2b3"), (301, "ends in Zm9vYmFyMTIzNDU2Nzg5")]
    got = {r["doc_id"]: [(x["kind"], x["value"]) for x in r["spans"]] for r in sanitize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(8):
        assert [k for k, _ in got[i]] == [TERM, SECRET] and got[i][0][1] == "apikey"
    assert not any(got[i] for i in range(8, 200)) and got[301] == [(SECRET, "Zm9vYmFyMTIzNDU2Nzg5")]
    assert not [x for x in got[300] if x[0] == SECRET]


def test_spans_in_a_text_of_many_matches(spark):
    text = "é " + " ".join(f"a{i}@corp{i % 7}.example" for i in range(5000))
    (row,) = sanitize(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(row["spans"]) == 5000 and all(text[s["start"] : s["end"]] == s["value"] for s in row["spans"])


def test_copies_disclose_nothing(spark):
    text = "some quite unusual words around boss@corp.example and then some more unusual ones"
    df = spark.createDataFrame([(i, text) for i in range(50)] + [(100 + i, f"other text {i}") for i in range(50)], "doc_id long, text string")
    assert all(s["kind"] == 0 for r in sanitize(df).collect() for s in r["spans"])


def test_pii_odd_rows(odd, none):
    rows = sanitize(odd)
    assert set(odd.columns) | {"clean"} == set(rows.columns)
    got = rows.collect()
    assert len(got) == odd.count() and all(r["clean"] == r["text"] for r in got)
    assert sanitize(none).collect() == [] and len(KINDS) == 6


def test_decontamination_against_planted(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 7, 12, 20, 40, 60])] + [(6, None), (7, "")]
    docs, want = [], {}
    for k, (i, t) in enumerate(items[:6]):
        words = t.split()
        for rate in (0.0, 0.1):
            planted = [word() if len(words) >= 20 and rng.random() < rate else w for w in words]
            doc = len(docs)
            docs.append((doc, " ".join([word() for _ in range(30)] + planted + [word() for _ in range(30)]).upper() + "."))
            want[doc] = i
    clean = [(100 + i, " ".join(word() for _ in range(100))) for i in range(20)]
    df = spark.createDataFrame(docs + clean + [(200, None), (201, ""), (None, "x")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_tokens": 20}):
        got = {r["doc_id"]: r for r in decontaminate(df, bench, **options).collect()}
        assert {d for d, r in got.items() if r["contaminated"]} == set(want) and len(got) == df.count()
        assert all(want[d] in [x["item_id"] for x in got[d]["items"]] for d in want)
    kept = decontaminate(df, bench, keep=True)
    assert kept.columns == df.columns and kept.count() == df.count() - len(want)


def test_decontamination_of_any_stretch_alike(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9)))
    changes = [(16, {3}), (16, {4}), (16, {11}), (16, {12}), (21, {12, 13}), (30, set(range(4, 30, 5))), (15, {3, 7, 11}), (12, {0}), (12, {10}), (11, {3, 7}), (10, {3, 6}), (10, {2, 6}), (9, {4}), (8, {7})]
    items, docs = [], []
    for k, (n, changed) in enumerate(changes):
        words = [word() for _ in range(n)]
        items.append((k, " ".join(words)))
        docs.append((k, " ".join([word() for _ in range(20)] + [word() if i in changed else w for i, w in enumerate(words)] + [word() for _ in range(20)])))
        docs.append((100 + k, " ".join([word() for _ in range(20)] + words[: min(9, n // 2 - 1)] + [word() for _ in range(20)])))  # too little of it
    docs.append((200, items[5][1]))
    got = {r["doc_id"]: r["items"] for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {d: [x["item_id"] for x in r] for d, r in got.items() if r and d < 200} == {k: [k] for k in range(len(changes))}
    assert got[0][0]["start"] == 20 and got[0][0]["end"] == 36 and got[0][0]["matched"] == 15
    assert [tuple(x) for x in got[200]] == [(5, 0, 30, 30)]


def test_decontamination_keeps_every_row_over_blocks(spark):
    items = [" ".join(f"w{k}x{i}" for i in range(20)) for k in range(3)]
    docs = [(1, items[0]), (1, "clean"), (1, "clean"), (None, items[1]), (None, None), (None, items[2]), (2, f"{items[0]} {items[2]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    of = lambda rows: sorted((str(r["doc_id"]), [x["item_id"] for x in r["items"]], r["contaminated"]) for r in rows)
    want = of(decontaminate(df, bench).collect())
    assert len(want) == len(docs) and of(decontaminate(df, bench, block_tokens=20).collect()) == want
    wide = df.withColumn("row", F.lit("own")).withColumn("lang", F.lit("x"))
    left = decontaminate(wide, bench, keep=True, block_tokens=20)  # rows are merged by a key beside the table's own column
    once = decontaminate(wide, bench, keep=True)
    assert left.columns == wide.columns and sorted(map(str, left.collect())) == sorted(map(str, once.collect()))
    assert 0 < left.count() < wide.count()


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(odd, bench).where("contaminated").count() == 0
    assert decontaminate(odd, bench, keep=True).count() == odd.count()
    full = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    assert decontaminate(odd, full).count() == odd.count() and decontaminate(none, full).collect() == []


def page(k, title, body, tail="</body></html>"):
    return f'<!DOCTYPE html><html><head><title>t {k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">nav {k}</a></li></ul></nav><!-- c --><div class="ad">buy {k}</div><div class="notice">All rights reserved</div><div class="box"><h1>{title}</h1>{body}<div class="share">share {k}</div></div><form><input>send</form><footer>&copy; {k}</footer>{tail}'


def test_wrapper_finds_the_slot_without_its_name(spark):
    rows, want = [], {}
    for k in range(12):
        body = f"<p><b>First &amp; {k}<br><p>second   line {k * 7} with\n<i>mark</i>up</p><ul><li>one {k}<li>two</ul>"
        rows.append((k, f"http://WWW.a.example:80/p{k}", page(k, f"Title {k}", body, "" if k % 5 == 0 else "</body></html>")))
        want[k] = f"Title {k}\nFirst & {k}\nsecond line {k * 7} with markup\none {k}\ntwo"
    rows += [(50, None, None), (51, "", ""), (52, "http://b.example/", "<p>no wrapper &lt;here"), (53, "x", "plain text"), (54, "http://c.example", "<article>one<p>two</article><aside>no</aside>"), (54, "http://c.example", "<article>one<p>two</article><aside>no</aside>")]
    df = spark.createDataFrame([(*r, "k", "v") for r in rows], "page_id long, url string, html string, _host string, text string").repartition(3)
    for hosts in (1 << 20, 0):
        got = collections.defaultdict(list)
        for r in extract_pages(df, broadcast_bytes=hosts).collect():
            got[r["page_id"]].append(r["main_text"])
        assert {k: got[k][0] for k in want} == want
        assert got[50] == got[51] == [""] and got[52] == ["no wrapper <here"] and got[53] == ["plain text"] and got[54] == ["one\ntwo"] * 2


def test_votes_do_not_depend_on_partitions(spark):
    rows = [(k, "http://a.example/x", f"<body><article><h1>Title {k}</h1><p>text {k * 7} of some more words that a page says</p><div>Under a licence</div></article></body>") for k in range(20)]
    for n in (1, 20):  # the second puts each page into a partition of its own
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "page_id long, url string, html string")
        got = {r["page_id"]: r["main_text"] for r in extract_pages(df).collect()}
        assert got == {k: f"Title {k}\ntext {k * 7} of some more words that a page says" for k in range(20)}


def test_slot_holds_all_that_varies(spark):
    rows = [(k, "http://a.example/x", f"<body><div>one site of many</div><article><h1>Title {k}</h1><div class=lead>lead {k}</div><div class=body>{k} body text {'of words ' * 9}</div></article></body>") for k in range(12)]
    got = {r["page_id"]: r["main_text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nlead {k}\n{k} body text {'of words ' * 9}".strip() for k in range(12)}


@pytest.mark.parametrize("start", ["<body class='has-sidebar'><div>", "<body><div class='content with-sidebar'>", "<body><article class='post header-large'>", "<body><form>", "<body><div class='widget'>"])
def test_names_do_not_hide_the_article(spark, start):
    rows = [(k, "http://a.example/x", f"{start}<h1>Title {k}</h1><p>text {k} {'of words ' * 9}</p><p class=share>share {k}</p></body>") for k in range(12)]
    got = {r["page_id"]: r["main_text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\ntext {k} {'of words ' * 9}".strip() for k in range(12)}


def unnamed(k, n=1):
    """A page of plain elements without telling names: menu, advert and foot vary, and so do reader comments; a notice stays."""
    text = " ".join(f"<p>Part {j} of text {k * 7 + j} {'some more words of it ' * 6}</p>" for j in range(n))
    return f"<body><div><div><a href=/{k}>menu {k}</a></div><div>buy {k} now</div><div><h1>Title {k}</h1>{text}<div>All texts are under the licence of this site</div></div><div>foot {k * 3}</div></div></body>"


def test_wrapper_alone_finds_the_article(spark, monkeypatch):
    rows = [(k, "http://a.example/x", unnamed(k, 1 + k % 4)) for k in range(24)]
    rows += [(100 + k, "http://b.example/x", unnamed(k, 2).replace("<div><h1>", "<div><div>lead of no heading</div><div class=x7><h1>").replace("licence", f"licence</div><div class='comments'>reader {k} says") + "<aside>also " + str(k) + "</aside>") for k in range(24)]
    want = {k: f"Title {k}\n" + "\n".join(f"Part {j} of text {k * 7 + j} {'some more words of it ' * 6}".strip() for j in range(1 + k % 4 if k < 24 else 2)) for k in range(24)}
    for n in (1, 40):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "page_id long, url string, html string")
        got = {r["page_id"]: r["main_text"] for r in extract_pages(df).collect()}
        assert {k: got[k] for k in range(24)} == want
        for k in range(24):  # the notice is split by the reader comment here, and its first part is constant
            assert got[100 + k].startswith(f"Title {k}\nPart 0 of text") and "menu" not in got[100 + k] and "buy" not in got[100 + k] and "reader" not in got[100 + k] and "also" not in got[100 + k] and "foot" not in got[100 + k]
    # Without votes the same page keeps the notice: the wrapper changes the text.
    assert "licence of this site" in main_text(rows[0][2], "", frozenset())
    votes = [("#/body.x/div:h", False, 0, 20, 400), ("#/body.x/div:h/h1", False, 0, 20, 60), ("#/body.x/nav", True, 0, 20, 90), ("#/body.x/div:h/p", False, 20, 0, 30)]
    assert choose(votes)[:2] == ("#/body.x/div:h", frozenset({"#/body.x/div:h/p"}))


def test_pages_repeated_long_and_deep(spark):
    long = "<body><div><h1>T</h1>" + "".join(f"<p>line {k}</p>" for k in range(20_000)) + "</div></body>"
    deep = "<div>" * 1500 + "deep" + "</div>" * 1500
    rows = [(1, "http://a.example/", long), (2, "http://a.example/", long), (3, "http://d.example/", deep), (4, None, None)]
    got = {r["page_id"]: r["main_text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got[1] == got[2] == "T\n" + "\n".join(f"line {k}" for k in range(20_000)) and got[3] == "deep" and got[4] == ""


def test_pages_empty_table(spark):
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_tree_matching():
    tree = lambda s: Tree(parse(s), "", False)
    a = tree("<div><h1>a</h1><p>x</p><ul><li>1</li></ul></div>")
    b = tree("<div><h1>b</h1><ul><li>2</li><li>3</li></ul><p>y</p></div>")
    n, pairs = match_trees(a, b)
    assert n == len(pairs) == 5  # root, div, h1, and the list with its item, which hold more than the paragraph
    assert match_trees(a, a)[0] == 6 and choose([]) == ("", frozenset(), frozenset({""}))


@pytest.mark.parametrize("text", ["<", "<p", "</", "<!--", "<script>", "<a b='", "<p>" * 1000, "<div>" * 2000 + "x", "&#x;&bogus;&amp", "\x00<p>퟿"])
def test_parser_never_fails(text):
    main_text(text, "", frozenset())


def test_small_table(spark):
    assert [tuple(r) for r in small_table(spark, [(1, "a"), (2, None)], "x int, y string").collect()] == [(1, "a"), (2, None)]


def plain_matching(a, b):
    """Simple tree matching by its definition: the full table, kids by kids."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_matching(x, y))
    return best[-1][-1] + 1


def test_matching_against_the_full_table(monkeypatch):
    rng = random.Random(21)

    def page(depth):
        tag = rng.choice(["p", "h2", "ul", "div class=x", "div class=y", "section", "blockquote"])
        inside = "".join(page(depth - 1) for _ in range(rng.randint(0, 5))) if depth else "text"
        return f"<{tag}>{inside}</{tag.split()[0]}>"

    for small in (400, 0):
        monkeypatch.setattr(html_extraction, "SMALL", small)
        for _ in range(60):
            a, b = (Tree(parse("".join(page(rng.randint(0, 3)) for _ in range(rng.randint(0, 9)))), "", False) for _ in range(2))
            n, pairs = match_trees(a, b)
            assert n == len(pairs) == plain_matching(a, b)
            assert all(x.label == y.label for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == n
            order = lambda t: [t, *(x for k in t.kids for x in order(k))]
            at = [{id(x): k for k, x in enumerate(order(t))} for t in (a, b)]
            placed = sorted((at[0][id(x)], at[1][id(y)]) for x, y in pairs)
            assert placed == sorted(placed, key=lambda p: p[1])


def test_many_unlike_blocks_need_little_memory():
    n = 20_000
    one = Tree(parse("".join(f"<h2>head {i}</h2><p>text {i}</p>" for i in range(n // 2))), "", False)
    two = Tree(parse("".join(f"<h2>head {i}</h2><p>other {i}</p>" + ("<ul><li>x</ul>" if i % 50 == 0 else "") for i in range(n // 2))), "", False)
    tracemalloc.start()
    count, pairs = match_trees(one, two)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == len(pairs) == n + 1 and peak < 300e6


def test_many_hosts_join(spark, monkeypatch):
    pages = [(i, f"http://h{i % 3}.org/{i}", f"<html><body><div class=menu>Home</div><article><h1>T{i}</h1><p>Body text number {i} of the page.</p></article></body></html>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = lambda: sorted((r["page_id"], r["main_text"]) for r in extract_pages(df).collect())
    want = rows()
    monkeypatch.setattr(html_extraction, "MANY_HOSTS", -1)
    assert rows() == want


def brute_overlaps(doc, item, least_words=13, similarity=0.8):
    """Matches of the best stretch over all diagonals by its definition: the longest one, most matches among these."""
    least, best = min(least_words, len(item)), 0
    if len(item) < 8:
        return any(doc[i : i + len(item)] == item for i in range(len(doc) - len(item) + 1))
    for diagonal in range(-len(item) + 1, len(doc)):
        low, high = max(0, diagonal), min(len(doc), diagonal + len(item))
        same = [doc[i] == item[i - diagonal] for i in range(low, high)]
        for i in range(len(same)):
            for j in range(i + least, len(same) + 1):
                if sum(same[i:j]) >= similarity * (j - i) - 1e-9:
                    best = max(best, j - i)
    return best >= least


def test_decontamination_against_all_diagonals(spark):
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    pool = [word() for _ in range(60)]
    items = [[rng.choice(pool) for _ in range(rng.choice([3, 7, 8, 9, 14, 20, 26]))] for _ in range(14)]
    docs = []
    for _ in range(160):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.8:
            item = rng.choice(items)
            low = rng.randrange(len(item))
            part = item[low : low + rng.randint(1, len(item))] if rng.random() < 0.5 else list(item)
            part = [rng.choice(pool) if rng.random() < rng.choice([0, 0.1, 0.25]) else w for w in part]
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append(text)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = {(d, k) for d, t in enumerate(docs) for k, item in enumerate(items) if brute_overlaps(t, item)}
    got = {(r["doc_id"], x["item_id"]) for r in decontaminate(df, bench).collect() for x in r["items"]}
    assert len(want) > 30 and got == want
