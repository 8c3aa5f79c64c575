import collections
import zlib

import numpy as np
import pytest
import zstandard
from cnvspark.llm.common import shared_path
from cnvspark.llm.packing import balance, pack_documents
from cnvspark.llm.sharding import fill, ring_position, shard_documents, virtual_nodes
from cnvspark.llm.token_files import FrameReader, FrameWriter, read_token_files, with_starts, write_token_files
from cnvspark.llm.tokens import coder, tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

PATH = tokenizer_path()


def direct(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, end], "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\r", "a", "B", "é", "ß", ",", ".", "'", "s", "1", "²", "_", "|", "漢", "\u00a0", "\u2003", "<|endoftext|>", "<|", "%%%"]), max_size=60).map("".join))
def test_memo_equals_library(text):
    assert coder(PATH).encode([text]) == [direct([text], 0)[0][:-4]]


def test_special_tokens_are_those_of_the_plain_call():
    assert coder(PATH).encode(["a <|endoftext|> b"]) == [direct(["a <|endoftext|> b"], 0)[0][:-4]]


def test_ids_too_wide_are_an_error():
    import io

    with pytest.raises(ValueError, match="width=4"):
        FrameWriter(io.BytesIO(), 2, 1 << 20, 3).add(1, np.array([1, 70_000], "<u4").tobytes())


def check_pieces(rows, docs, capacity, end=0):
    want = collections.Counter(zip([d for d, _ in docs], direct([t for _, t in docs], end)))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert sum(r["length"] for r in rows) == sum(len(x) // 4 * n for (_, x), n in want.items())
    for (doc, x), n in want.items():
        for s in range(0, len(x) // 4):
            break
        parts = sorted((r["start"], r["ids"]) for r in by_doc[doc, len(x) // 4])
        if n == 1 and sum(len(p) for _, p in parts) == len(x):
            assert b"".join(p for _, p in parts) == x
    return by_seq


def test_packing_holds_every_token_once(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    seqs = check_pieces(pack_documents(odd, PATH, capacity=64).collect(), docs, 64)
    total = sum(sum(r["length"] for r in s) for s in seqs.values())
    assert len(seqs) <= total / 64 + 3  # one open sequence for each input partition


def test_packing_empty_table(none):
    assert pack_documents(none, PATH).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 31), max_size=60))
def test_balance(lengths):
    placed = balance(np.array(lengths, np.int64), 32, 1.0, 0.1)
    used = collections.defaultdict(int)
    got = collections.Counter()
    for item, _, n, seq, offset in sorted(placed, key=lambda p: (p[3], p[4])):
        assert offset == used[seq] and n > 0
        used[seq] += n
        got[item] += n
    assert all(n <= 32 for n in used.values()) and len(used) <= -(-sum(lengths) // 32)
    assert all(got[i] == n for i, n in enumerate(lengths))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 31), max_size=50), st.sampled_from([(1.0, 0.0), (1.0, 0.1), (0.0, 1.0)]))
def test_balance_is_the_lowest_cost_rule(lengths, weights):
    """A plain reading of the rule: longest first, to the sequence of least cost that has room, what fits nowhere into gaps."""
    capacity, (linear, quadratic) = 32, weights
    seqs = [{"room": capacity, "cost": 0.0} for _ in range(-(-sum(lengths) // capacity))]
    want, left = [], []
    for item in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        fits = [k for k, q in enumerate(seqs) if q["room"] >= n]
        if not fits:
            left.append(item)
            continue
        k = min(fits, key=lambda k: (seqs[k]["cost"], k))
        want.append((item, 0, n, k, capacity - seqs[k]["room"]))
        seqs[k]["room"] -= n
        seqs[k]["cost"] += linear * n + quadratic * n * n
    for item in left:
        start = 0
        while start < lengths[item]:
            k = max(range(len(seqs)), key=lambda k: (seqs[k]["room"], -k))
            take = min(lengths[item] - start, seqs[k]["room"])
            want.append((item, start, take, k, capacity - seqs[k]["room"]))
            seqs[k]["room"] -= take
            start += take
    assert balance(np.array(lengths, np.int64), capacity, linear, quadratic) == want


def test_shards_are_even_and_gapless(odd):
    rows = shard_documents(odd, shards=8, replicas=16).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == odd.count()
    assert {len(x) for x in slots.values()} <= {len(rows) // 8, len(rows) // 8 + 1}
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    want = collections.Counter(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in [(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want and texts


@pytest.mark.parametrize("shards,replicas", [(8, 16), (3, 1), (2, 2)])
def test_ring_against_brute_force(spark, odd, shards, replicas):
    nodes = virtual_nodes(shards, replicas)
    placed = odd.select("doc_id", "text", ring_position(F.col("text")).alias("p"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c")).collect()
    first = lambda p: next((i for i, (q, _) in enumerate(nodes) if q >= p), 0)
    # Arc by arc; a key behind the last node belongs to the first one, after the keys before that.
    keys = sorted(placed, key=lambda r: (first(r["p"]), r["p"], r["doc_id"] is not None, r["doc_id"] or 0, r["c"]))
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    want = []
    for r in keys:
        at = first(r["p"])
        while room[nodes[at % len(nodes)][1]] == 0:
            at += 1
        shard = nodes[at % len(nodes)][1]
        room[shard] -= 1
        want.append((r["doc_id"], r["c"], shard))
    got = collections.Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in shard_documents(odd, shards=shards, replicas=replicas).collect())
    assert got == collections.Counter(want)
    if replicas < 16:
        assert any(r["p"] > nodes[-1][0] for r in keys)  # the arc that closes the ring


def test_fill_moves_clockwise():
    assert fill([(0, 3), (1, 0), (2, 1)], [0, 1, 0], [2, 2]) == [(0, 0, 2, 0, 0), (0, 2, 3, 1, 0), (2, 0, 1, 1, 1)]


def test_shards_empty_table(none):
    assert shard_documents(none).collect() == []


def test_token_files_round_trip(spark, odd):
    path = shared_path(spark, "files")
    manifest = write_token_files(odd, path, PATH, files=3, frame_bytes=4096)
    rows = with_starts(read_token_files(manifest), manifest).collect()
    docs = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert collections.Counter((r["doc_id"], r["ids"]) for r in rows) == collections.Counter(zip([d for d, _ in docs], direct([t for _, t in docs], 2)))
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == [d for d, _ in docs]
    some = read_token_files(manifest, doc_ids=[3, 42]).collect()
    assert {r["doc_id"] for r in some} == {3, 42}


def test_token_file_format(spark, odd):
    manifest = write_token_files(odd, shared_path(spark, "files"), PATH, files=1, frame_bytes=4096).collect()
    name = manifest[0]["path"].split("://", 1)[-1]
    raw = open(name, "rb").read()
    with open(name, "rb") as f:
        reader = FrameReader(f, len(raw))
        assert len(reader.entries) > 3
        plain = b"".join(reader.frame(k) for k in range(len(reader.entries)))
        assert zstandard.ZstdDecompressor().decompressobj().decompress(raw[: int(reader.starts[1])]) == reader.frame(0)
        assert len(plain) == 2 * manifest[0]["tokens"]
    broken = bytearray(raw)
    broken[10] ^= 255
    with open(name + ".broken", "wb") as f:
        f.write(broken)
    with open(name + ".broken", "rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        FrameReader(f, len(raw)).frame(0)


def test_token_files_empty_table(spark, none):
    manifest = write_token_files(none, shared_path(spark, "files"), PATH)
    assert manifest.collect() == [] and read_token_files(manifest).collect() == []
