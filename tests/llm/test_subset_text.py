import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from panelforge.llm import encode, packing, splitting, subset

have = pytest.mark.skipif(not os.path.exists(os.path.join(encode.TOKENIZERS, encode.VOCABULARY)), reason="no vocabulary files")

CANDIDATE = "candidate_id long, root_family string, structural_score double, fingerprint string, written_at int, structural_descriptor struct<fields:array<string>,operator_histogram:map<string,int>>"


def pool(spark, n=300, copies=200):
    rng = random.Random(6)
    rows = [(i, rng.choice(["add", "Rank ", None]), 0.1, "f", 1, ([f"f{rng.randrange(30)}" for _ in range(rng.randrange(4))], {f"o{rng.randrange(8)}": rng.randrange(1, 4)})) for i in range(n)]
    rows += [(1000 + i, "rank", 0.1, "f", 1, (["same"], {"o": 1})) for i in range(copies)] + [(5000, "clip", 0.1, "f", 1, None), (5001, "clip", 0.1, "f", 1, None), rows[0]]
    return spark.createDataFrame(rows, CANDIDATE)


def chosen(spark, df, requests):
    out = {}
    for r in subset.diverse_subsets(df, spark.createDataFrame(requests, "request_id int, root_family string, subset_size int")).collect():
        out.setdefault(r["request_id"], []).append(r["candidate_id"])
    return out


def test_subsets_have_their_size_and_spare_look_alikes(spark):
    got = chosen(spark, pool(spark), [(1, None, 40), (2, " RANK", 12), (3, "clip", 9), (4, "none", 5), (5, None, 0), (6, None, None), (7, None, 900)])
    assert {k: len(v) for k, v in got.items()} == {1: 40, 2: 12, 3: 2, 7: 502}
    assert all(len(set(v)) == len(v) for v in got.values())
    assert sum(1000 <= i < 2000 for i in got[1]) <= 1 and sum(1000 <= i < 2000 for i in got[2]) <= 1
    assert chosen(spark, pool(spark), [(1, None, 40)])[1] and sorted(chosen(spark, pool(spark), [(1, None, 40)])[1]) == sorted(got[1])


def test_more_than_the_descriptions_takes_copies(spark):
    got = chosen(spark, pool(spark, n=20, copies=100), [(1, "rank", 60)])
    assert len(set(got[1])) == 60
    assert chosen(spark, pool(spark).limit(0), [(1, None, 3)]) == {}


@given(st.dictionaries(st.integers(0, 70), st.integers(1, 6000), min_size=1), st.integers(0, 400), st.sampled_from(["sqrt", "equal"]), st.integers(1, 5000))
@settings(max_examples=200, deadline=None)
def test_quotas_add_up_and_keep_to_their_shares(sizes, total, how, most):
    caps = {c: min(n, most) for c, n in sizes.items()}
    q = subset.quotas(sizes, total, how, caps)
    assert sum(q.values()) == min(total, sum(caps.values())) and all(0 <= q[c] <= caps[c] for c in sizes)
    # the share of each that isn't full, when the full ones have what they can give
    weight = {c: n**0.5 if how == "sqrt" else 1.0 for c, n in sizes.items()}
    full = set()
    while True:
        rate = (min(total, sum(caps.values())) - sum(caps[c] for c in full)) / max(sum(weight[c] for c in sizes if c not in full), 1e-12)
        more = {c for c in sizes if c not in full and weight[c] * rate > caps[c]}
        if not more:
            break
        full |= more
    for c in sizes:
        assert q[c] == caps[c] if c in full else abs(q[c] - weight[c] * rate) < 1 + 1e-6


def test_small_clusters_get_their_part():
    rng = np.random.default_rng(1)
    sizes = {c: int(n) for c, n in enumerate(np.exp(rng.normal(5, 1.6, 64)) + 1)}
    q = subset.quotas(sizes, 64)
    ideal = {c: 64 * n**0.5 / sum(m**0.5 for m in sizes.values()) for c, n in sizes.items()}
    assert all(abs(q[c] - ideal[c]) < 1 for c in sizes) and max(q.values()) < 6


def test_centres_settle_and_every_candidate_has_a_cluster(spark):
    s = subset.Subsets(pool(spark), spark.createDataFrame([(1, None, 20), (2, "rank", 8)], "request_id int, root_family string, subset_size int"))
    assert s.model.moves[-1] < subset.SETTLED or s.model.passes == subset.PASSES
    rows = s.assignments().collect()
    assert len(rows) == len({(r["request_id"], r["candidate_id"]) for r in rows}) and sum(r["request_id"] == 1 for r in rows) == 502
    assert sum(n for n, _ in s.sizes[1].values()) == 502 and sum(k for _, k in s.sizes[1].values()) < 400
    # all copies of a description are in one cluster, which weighs them all but can give one
    assert len({r["cluster"] for r in rows if r["request_id"] == 1 and 1000 <= r["candidate_id"] < 2000}) == 1
    other = subset.Subsets(pool(spark).repartition(3), spark.createDataFrame([(1, None, 20), (2, "rank", 8)], "request_id int, root_family string, subset_size int"))
    assert sorted(map(tuple, other.assignments().collect())) == sorted(map(tuple, rows))


@have
@given(st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "22", ".", "!?", "é", "中", "🙂", "<|endoftext|>", " ", "ab ", "x1"]), max_size=30), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_joined_halves_equal_the_whole(parts, leaf):
    text = "".join(parts)
    e = encode.encoder()
    assert e.encode(text, leaf).tolist() == e.leaf(text).tolist()
    assert e.decode(e.encode(text, leaf)) == text


@have
def test_encoding_agrees_with_another_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["plain text, isn't it", "", None, "<|endoftext|> is text", "a" * 20_000, " \n" * 9000, "中文。" * 4000, "mixed 🙂 \r\n\r\n end "]
    rows = list(enumerate(texts)) + [(None, "x"), (0, texts[0])]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, ids string")
    got = encode.encode_texts(df, "doc_id", "text")
    small = encode.encode_texts(df.coalesce(1), "doc_id", "text", leaf=100, flush=10)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["ids"])
    assert sorted(got.collect(), key=key) == sorted(small.collect(), key=key)
    for r in got.collect():
        if r["doc_id"] is not None:
            x = texts[r["doc_id"]]
            assert r["ids"] == (t.encode(x, add_special_tokens=False).ids if x else [])
    back = {r["doc_id"]: r["text"] for r in encode.decode_ids(got, "doc_id", "ids").collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(texts)) and got.count() == len(rows)
    assert encode.encode_texts(df.limit(0), "doc_id", "text").count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_fullest_is_the_best_multiset(counts, room):
    picked = packing.fullest(counts, room)
    assert all(n <= counts[k] for k, n in picked.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    assert sum(k * n for k, n in picked.items()) == max(s for s in sums if s <= room)


def test_containers_hold_everything_once(spark):
    rng = random.Random(8)
    sizes = [rng.choice([0, 3, 7, 50, 51, 99, 100, 101, 350, rng.randrange(1, 120)]) for _ in range(800)] + [100] * 300
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(9000, None), (9001, -4), (9002, 33), (9002, 33)], "id long, n long")
    rows = packing.pack(df, "id", "n", 100).collect()
    load, pieces = {}, {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        pieces.setdefault(r["id"], []).append((r["piece_no"], r["n_tokens"]))
    assert max(load.values()) <= 100 and set(load) == set(range(1, len(load) + 1))
    free = []  # first fit, longest first, needs no fewer
    for n in sorted((x for p in pieces.values() for _, x in p if x), reverse=True):
        k = next((k for k, room in enumerate(free) if room >= n), None)
        if k is None:
            free.append(100 - n)
        else:
            free[k] -= n
    assert len(load) <= len(free)
    for i, n in enumerate(sizes):
        assert sum(x for _, x in pieces[i]) == n and len(pieces[i]) == max(1, -(-n // 100))
    assert sum(x for _, x in pieces[9000]) == 0 and len(pieces[9002]) == 2
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "id", "n", 0)


TEXTS = [
    "One sentence here. Another one there! A third?\n\nA new paragraph with several more words in it.\nAnd a line.\r\n\r\n" * 40, "x" * 5000, "短い文です。次の文です！" * 200, "🙂🙃" * 400, "word " * 600, "tiny", "", None, " \n" * 2000, "a,b,c;" * 700,
]


@have
@pytest.mark.parametrize("limit,overlap", [(32, 0), (64, 10), (40, 32)])
def test_pieces_fit_overlap_and_cover(spark, limit, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4])], "doc_id long, text string")
    rows = splitting.split_texts(df, "doc_id", "text", [(7, limit, overlap)]).orderBy("doc_id", "piece_no").collect()
    e = encode.encoder()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert None in by
    for i, t in enumerate(TEXTS):
        n = len(e.encode(t))
        if n <= limit:
            assert i not in by
            continue
        own = by[i]
        assert [r["piece_no"] for r in own] == list(range(1, len(own) + 1)) and all(r["n_pieces"] == len(own) for r in own)
        text, at = "", 0
        for k, r in enumerate(own):
            assert r["n_tokens"] <= limit and r["piece"] == t[r["start_char"] : r["end_char"]]
            assert r["overlap_tokens"] == 0 if k == 0 else min(overlap, at) <= r["overlap_tokens"] <= overlap + 3
            at += r["n_tokens"] - r["overlap_tokens"]
            text += t[len(text) : r["end_char"]]
        assert text == t and own[-1]["boundary"] == "end" and at == n
    ends = {r["boundary"] for r in by[0]}
    assert ends <= {"paragraph", "line", "sentence", "end", *(["word"] if limit - overlap < 10 else [])} and all(r["boundary"] == "inside" for r in by[1][:-1])
    with pytest.raises(ValueError):
        splitting.split_texts(df, "doc_id", "text", [(1, 10, 9)])
    assert splitting.split_texts(df.limit(0), "doc_id", "text", [(1, limit, overlap)]).count() == 0


@have
def test_merging_the_weakest_first():
    # segments of 4; the boundary of strength 1 goes first, then what still fits
    assert splitting.merge([0, 4, 8, 12], [0, 4, 8, 12], [5, 3, 1, 3], 16, 8) == [0, 1, 3]
    assert splitting.merge([0, 4, 8, 12], [0, 4, 8, 12], [5, 1, 3, 1], 16, 8) == [0, 2]
    assert splitting.merge([0], [0], [5], 4, 8) == [0]


def test_no_bounds_on_sizes_and_places(spark):
    # segments beyond 2^25 tokens, and more patterns than 2^16 that hold one length
    far = 1 << 27
    assert splitting.merge([0, far, far + 4, far + 8], [0, far, far + 4, far + 8], [5, 3, 1, 3], far + 12, 8) == [0, 1, 3]
    n = 70_000
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(2 * n), F.lit(2)).alias("starts"), F.explode(F.array(*map(F.lit, (0, 1, 2, 131_071, 131_073, 139_999, 140_000, 10**9)))).alias("v"))
    got = {r["v"]: r["k"] for r in df.select("v", packing._last_at_most("starts", "v", n + 1).alias("k")).collect()}
    assert got == {v: min(v // 2, n) for v in got}


@have
@given(st.lists(st.sampled_from(["a", "word ", "One. ", "line\n", "part\n\n", "x" * 40, "Q1?" * 70, "中文。", "中" * 30, "🙂🙂", "q,w;e", " " * 9, "supercalifragilistic "]), min_size=1, max_size=60), st.integers(9, 45), st.integers(0, 12))
@settings(max_examples=400, deadline=None)
def test_merging_from_longest_segments_equals_a_plain_heap_over_tokens(parts, limit, overlap):
    text = "".join(parts)
    limit = max(limit, overlap + 8)
    e = encode.encoder()
    ids = e.encode(text)
    if len(ids) <= limit:
        return
    chunk = splitting.Chunk([text], [e.widths[ids]])
    _, begin, start, end = splitting.split_chunk(chunk, limit, overlap)
    whole = chunk.by_level[splitting.INSIDE]
    starts = whole[:-1]
    begins = chunk.begins(starts, overlap, np.zeros(len(starts), np.int64))
    kept = splitting.merge(starts.tolist(), begins.tolist(), chunk.strength[starts].tolist(), len(ids), limit)
    assert start.tolist() == starts[kept].tolist() and begin.tolist() == begins[kept].tolist() and end.tolist() == [*starts[kept][1:].tolist(), len(ids)]


def test_vectors_are_dense_rows():
    import pyarrow as pa

    x = pa.array([[{"slot": 0, "x": 1.0}, {"slot": 0, "x": 2.0}], [], [{"slot": subset.DIMS - 1, "x": 0.5}]], pa.list_(pa.struct([("slot", pa.int32()), ("x", pa.float32())])))
    v = subset._vectors(x)
    assert v.shape == (3, subset.DIMS) and v[0, 0] == 3 and not v[1].any() and v[2, -1] == np.float64(0.5)


