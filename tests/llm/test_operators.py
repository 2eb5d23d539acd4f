"""Each query on odd tables and empty tables, and against a plain version."""

import bisect
import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat, fingerprints, mixing, ngram_join, packing, pii, queries, sharding, toxicity

from .conftest import ITEMS, ODD, TURNS, VECTORS

Q = queries.queries()


def rows_of(spark, root, name="documents"):
    return spark.read.parquet(f"{root}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).count() == (1 if name.startswith("op5_") else 0)


@pytest.mark.parametrize("name", [n for n in sorted(Q) if n.split("_")[0] not in ("op4", "op5", "op10", "op12", "op13")])
def test_one_row_for_each_odd_document(spark, odd, name):
    got = Q[name](spark, odd).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in ODD)


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(docs, threshold=0.8):
    """Links and least reachable id by comparing everything with everything; rows without an id take no part."""
    docs = [(d, t or "") for d, t in docs if d is not None]
    sets = [shingle_set(t) for _, t in docs]
    links, root = [0] * len(docs), {d: d for d, _ in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(docs)):
        for j in range(i + 1, len(docs)):
            both = len(sets[i] & sets[j])
            if docs[i][1] == docs[j][1] or both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(docs[i][0]), find(docs[j][0])
                root[max(a, b)] = min(a, b)
    return collections.Counter((d, find(d), n) for (d, _), n in zip(docs, links, strict=True))


@pytest.mark.parametrize("where", ["odd", "small"])
def test_op1(spark, request, where):
    root = request.getfixturevalue(where)
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in Q["op1_ngram_join"](spark, root).collect() if r.doc_id is not None)
    assert got == linked([(r.doc_id, r.text) for r in rows_of(spark, root)])


def test_op1_large_group_in_several_tiles(spark):
    """A group of near copies larger than a tile: no link is lost and none counted twice."""
    words = [f"w{i}" for i in range(120)]
    docs = [(k, " ".join([*words, f"own{k}"])) for k in range(90)] + [(100 + k, " ".join(words)) for k in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.ngram_join(df, tile=16).collect()
    assert len(got) == 100 and {(r.class_id, r.n_links) for r in got} == {(0, 99)}


def test_op1_long_near_copies_are_cut_by_their_shingles(spark):
    """A bucket whose texts are long has more chunks than its members ask for; links stay whole."""
    words = [f"w{i}" for i in range(120)]
    docs = [(k, " ".join([*words, f"own{k}"])) for k in range(90)] + [(100 + k, " ".join(words)) for k in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = ngram_join.signatures(df).dropDuplicates(["x", "y"]).withColumn("id", F.monotonically_increasing_id())
    assert {r["size"] for r in prints.select("size").collect()} == {116, 117}
    members = ngram_join.tiles(prints, chunk_shingles=1500).groupBy("t", "bucket", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(members) > 20 and max(r["n"] for r in members) < 60
    assert {(r.class_id, r.n_links) for r in ngram_join.ngram_join(df, chunk_shingles=1500).collect()} == {(0, 99)}


def test_op1_full_tile_of_long_texts_in_bounded_memory():
    """As many sets of 20,000 shingles as a tile may hold, all pairs of them, by a process of its own whose peak is read."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from tessera.llm import ngram_join as g
rng = np.random.default_rng(1)
base = rng.integers(0, 1 << 63, 20_000, np.uint64)
sets = []
for k in range(2 * g.CHUNK_SHINGLES // 20_000):
    s = base.copy()
    s[rng.integers(0, len(s), 500)] = rng.integers(0, 1 << 63, 500, np.uint64)
    sets.append(np.unique(s))
i, j = np.triu_indices(len(sets), 1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
both = g.common(sets, i.astype(np.int32), j.astype(np.int32))
for k in (0, 1000, len(i) - 1):
    assert both[k] == len(np.intersect1d(sets[i[k]], sets[j[k]]))
print(len(sets), before, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    n, before, peak = map(int, out.stdout.split())
    assert n >= 400 and peak < 500 * 1024, (before, peak)


def test_op1_and_its_stage_one_id_with_two_texts(spark):
    """Each text of a shared id has its own links; the stage drops the near copy and keeps the other text of the id."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(120)]
    other = [f"v{i}" for i in range(120)]
    docs = [(1, " ".join(words)), (2, " ".join([*words, "own"])), (2, " ".join(other)), (3, " ".join([*other, "own"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df).collect()) == {(1, 1, 1): 1, (2, 1, 1): 1, (2, 2, 1): 1, (3, 2, 1): 1}
    assert sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, df, "").collect())) == [docs[0], docs[2]]


def test_op1_repeated_ids_against_brute_force(spark):
    """Few ids on many rows: copies, near copies and different texts under one id."""
    rng = np.random.default_rng(8)
    bases = [[f"b{k}w{v}" for v in range(40)] for k in range(6)]
    docs = []
    for _ in range(120):
        words = list(bases[rng.integers(6)])
        for at in rng.integers(0, 40, rng.integers(0, 3)):
            words[at] = f"x{rng.integers(3)}"
        docs.append((int(rng.integers(15)), " ".join(words)))
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), tile=8).collect())
    assert got == by_rows([d for d, _ in docs], similar([t for _, t in docs]))


def similar(texts, threshold=0.8):
    sets = [shingle_set(t) for t in texts]
    return [(i, j) for j in range(len(sets)) for i in range(j) if texts[i] == texts[j] or (both := len(sets[i] & sets[j])) and both >= threshold * (len(sets[i]) + len(sets[j]) - both)]


def by_rows(ids, pairs):
    """id, least id that links of the row reach, links of the row; rows count, not ids."""
    root, links = list(range(len(ids))), [0] * len(ids)
    find = lambda a: a if root[a] == a else find(root[a])
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
        root[find(i)] = find(j)
    least = {}
    for k, d in enumerate(ids):
        least[find(k)] = min(d, least.get(find(k), d))
    return collections.Counter((d, least[find(k)], links[k]) for k, d in enumerate(ids))


def test_common_counts_in_blocks():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 500, rng.integers(0, 300)).astype(np.uint64)) for _ in range(30)]
    i, j = (v.ravel() for v in np.meshgrid(range(30), range(30)))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    off = i != j
    assert ngram_join.common(sets, i[off], j[off], 64, 8).tolist() == np.array(want)[off].tolist() == ngram_join.common(sets, i[off], j[off]).tolist()
    assert ngram_join.common([np.empty(0, np.uint64)] * 2, np.array([0]), np.array([1])).tolist() == [0]


def test_op1_pruning_is_bayes():
    """Needed matches follow the binomial tail, and a pair at the threshold is pruned less often than the tolerance allows per step."""
    needs = ngram_join.least_matches(0.8)
    rng = np.random.default_rng(0)
    hits = rng.random((20_000, ngram_join.HASHES)) < 0.8
    lost = np.zeros(len(hits), bool)
    for n, m in needs:
        lost |= hits[:, :n].sum(axis=1) < m
    assert lost.mean() < 1e-3 and all(m > 0 for _, m in needs[1:])


@pytest.mark.parametrize("where", ["odd", "small"])
def test_op2(spark, request, where):
    root = request.getfixturevalue(where)
    docs = rows_of(spark, root)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = collections.Counter()
    for r in docs:
        total[r.source] += size(r.text)
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while True:
        level = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if level[s] > 2 * total[s]]
        if not over:
            target |= level
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.discard(s)
    got = Q["op2_mixing"](spark, root).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((r.doc_id, size(r.text)) for r in docs)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    source = {r.doc_id: r.source for r in docs}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == total[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, Q["op2_mixing"](spark, root).collect()))


def spark_hash(*values):
    """Spark's xxhash64 of strings, ints (a tuple holds one as 4 bytes) and longs."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def plain_permuted(x, n, salt, back=False):
    for r in reversed(range(mixing.ROUNDS)) if back else range(mixing.ROUNDS):
        partner = (spark_hash("key", salt, (r,), n) % n - x) % n
        if spark_hash("coin", salt, (r,), max(x, partner)) & 1:
            x = partner
    return x


def plain_mix(docs, target, block, shard_slots):
    """Every draw and every join of mix() one by one. docs: (row, source, size) in order; target by source. Words taken by (shard, row)."""
    names = sorted({s for _, s, _ in docs})
    words = {s: [(row, k) for row, source, size in docs if source == s for k in range(size)] for s in names}
    blocks = {s: -(-len(words[s]) // block) for s in names}
    want = {s: int(target[s] + 0.5) for s in names}
    short = {s: blocks[s] * block - len(words[s]) for s in names}
    wanted = [want[s] // len(words[s]) * blocks[s] + -(-(want[s] % len(words[s]) + short[s]) // block) for s in names]
    total, numbers = sum(wanted), [[] for _ in names]
    for at in range(total):
        u = spark_hash("draw", at // shard_slots, at % shard_slots) % total
        numbers[next(k for k in range(len(names)) if u < sum(wanted[: k + 1]))].append(at // shard_slots)
    had = [len(v) for v in numbers]
    starts = [sum(max(0, had[j] - wanted[j]) for j in range(k)) for k in range(len(names))]
    lacking = [k for k in range(len(names)) if had[k] < wanted[k]]
    over = sum(wanted[k] - had[k] for k in lacking)
    out, seen = collections.Counter(), set()
    for k in range(len(names)):
        for j, shard in enumerate(numbers[k]):
            to, i = k, j
            if had[k] > wanted[k]:
                i = plain_permuted(j, had[k], spark_hash("keep", (k,)))
                if i >= wanted[k]:
                    x = plain_permuted(i - wanted[k] + starts[k], over, 29)
                    for to in lacking:
                        if x < wanted[to] - had[to]:
                            break
                        x -= wanted[to] - had[to]
                    i = had[to] + x
            assert (to, i) not in seen
            seen.add((to, i))
            s = names[to]
            salt = spark_hash("s" + s)
            turn, place = divmod(i, blocks[s])
            short_at = plain_permuted(blocks[s] - 1, blocks[s], salt, back=True)
            begun = turn * len(words[s]) + place * block - (short[s] if place > short_at else 0)
            at = plain_permuted(place, blocks[s], salt)
            out.update((shard, row) for row, _ in words[s][at * block : (at + 1) * block][: max(0, want[s] - begun)])
    return out, names, had, wanted


def test_op2_one_row_repeated_very_often(spark):
    """A third of all rows is one row: they are counted and dealt out, without a window over them, and each is told apart."""
    docs = [(7, "w " * 5, "s0")] * 1000 + [(k, "w " * (k % 9), f"s{k % 3}") for k in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text"))
    rows = mixing.numbered(df, ["doc_id", "text", "source"], part_rows=50)
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    got = rows.select("row", "doc_id", "size").collect()
    assert len({r.row for r in got}) == len(docs) and collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((d, len(t.split())) for d, t, _ in docs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    per = rows.where("doc_id = 7 and size = 5").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) > 1 and max(r["count"] for r in per) < 700


def test_op2_draw_by_draw(spark):
    rng = np.random.default_rng(21)
    docs = [(k, "abc"[min(2, k // 20)], int(rng.integers(0, 300))) for k in range(60)]
    sources, taken = mixing.mix(spark.createDataFrame(docs, "row long, source string, size long"), block=16, shard_slots=32)
    got = {(r.shard, r.row): r.n for r in taken.groupBy("shard", "row").agg(F.sum("words").alias("n")).collect()}
    want, _, had, wanted = plain_mix(docs, {r.source: r.target for r in sources.collect()}, 16, 32)
    assert got == dict(want) and had != wanted and len({s for s, _ in got}) > 5


def test_shard_counts_are_multinomial_draws(spark):
    """Mean and variance of a source's slots over many shards, before and after the condition."""
    wanted = [30_000, 8_000, 2_000]
    rows = mixing.slots(spark, wanted, 40).groupBy("k", "shard").count().collect()
    for k, n in enumerate(wanted):
        p, per = n / 40_000, [r["count"] for r in rows if r.k == k]
        per += [0] * (1000 - len(per))
        assert sum(per) == n and abs(np.var(per) / (40 * p * (1 - p)) - 1) < 0.2
    assert mixing.slots(spark, wanted, 40).select("k", "i").distinct().count() == 40_000


def test_written_mix_is_made_of_whole_shards(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.mixed_documents(docs, block=64, shard_slots=16).collect()
    before = collections.defaultdict(list)
    for r in docs.collect():
        before[r.doc_id].append(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert all(any(" ".join(words(r.text)) in t for t in before[r.doc_id]) and r.n_chars == len(r.text) and len(words(r.text)) <= 64 for r in out)
    taken, op2 = collections.Counter(), collections.Counter()
    for r in out:
        taken[r.source] += len(words(r.text))
    _, mix = mixing.mix(mixing.numbered(docs.select(F.col("doc_id").alias("key"), "source", mixing.n_words(mixing.text_of()).alias("size")), ["key"]).drop("key"), 64, 16)
    for r in mix.collect():
        op2[r.row.key] += r.words
    assert sum(taken.values()) == sum(op2.values())


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 256])
def test_permutation_and_its_inverse(spark, n):
    df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p"))
    df = df.withColumn("back", mixing.permuted(F.col("p"), F.lit(n), F.lit(5), back=True))
    rows = df.collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_mix_shards_follow_the_weights(spark):
    docs = spark.createDataFrame([(k, "a" if k % 4 else "b", 640) for k in range(400)], "row long, source string, size long")
    _, taken = mixing.mix(docs, shard_slots=256, weights=(3, 1))
    per = {}
    for r in taken.join(docs, "row").groupBy("shard", "source").agg(F.sum("words").alias("n")).collect():
        per.setdefault(r.shard, {})[r.source] = r.n
    shares = [v.get("b", 0) / sum(v.values()) for s, v in per.items() if sum(v.values()) > 10_000]
    assert len(shares) > 10 and len(set(shares)) > 5 and abs(np.mean(shares) - 0.25) < 0.02


def ranks_above(score, y):
    """Area under the curve: the share of pairs of a positive and a negative in which the positive scores higher, ties by half."""
    pos, neg = score[y == 1], np.sort(score[y == 0])
    return (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / (2 * len(pos) * len(neg))


@pytest.mark.parametrize("name,column,least", [("op3_quality", "quality", (0.98, 0.95, 0.95)), ("op9_toxicity", "toxic", (0.98, 0.9, 0.95))])
def test_classifiers_on_held_out_rows(spark, name, column, least):
    """A constant has an area of 0.5, and no recall or little precision."""
    root = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[column] for r in rows_of(spark, root, "labels")}
    got = [r for r in Q[name](spark, root).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.3 if column == "quality" else 0.5)) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and labels.get(r.doc_id) is not None]
    y, score, said = np.array([labels[r.doc_id] for r in held]), np.array([r.score for r in held]), np.array([r.predicted for r in held])
    found = (ranks_above(score, y), said[y == 1].mean(), y[said == 1].mean())
    assert all(f >= x for f, x in zip(found, least, strict=True)), found


def test_pairs_of_terms_count(spark):
    """Neither word is toxic alone, both together are: weights alone can't tell, factors can."""
    rng = np.random.default_rng(3)
    texts = []
    for k in range(1200):
        filler = " ".join(f"n{v}" for v in "bcdfghjk"[: rng.integers(1, 8)])
        texts.append(f"{'grub' if k % 2 else 'fern'} {'zork' if k // 2 % 2 else 'plum'} {filler}")
    y = np.array([float("grub" in t and "zork" in t) for t in texts])
    m = toxicity.fitted([toxicity.terms(t) for t in texts], y)
    assert ((np.array(m.score(texts)) >= 0.5) == (y == 1)).mean() > 0.99


def test_exclusive_or_of_terms_is_learned_at_production_settings(spark):
    """Either word alone is toxic, both or none are not: each word is as frequent in both classes, and no additive model fits."""
    rng = np.random.default_rng(5)
    filler = ["".join(rng.choice(list("bcdfghjklmn"), 6)) for _ in range(400)]
    docs, labels = [], []
    for k in range(4000):
        one, two = k % 2, k // 2 % 2
        docs.append((k, " ".join([*rng.choice(filler, 12), *["grub"] * one, *["zork"] * two])))
        labels.append((k, 0, one ^ two))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 5 == 0]
    score = np.array(model.score([docs[k][1] for k in held]))
    assert ((score >= 0.5) == np.array([labels[k][2] for k in held])).mean() > 0.95


def test_op4(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for d, t in ODD:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[d, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = Q["op4_best_fit_packing"](spark, odd).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    per = {}
    for r in got:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in per.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(per) == packing.plan(collections.Counter(r.length for r in got))[1]


def test_ids_of_every_code_point_and_of_whole_tables(spark):
    """Each code point up to U+FFFF inside, before and after words and alone, and all given documents, as the tokenizer has them."""
    words = packing.Words(packing.default_tokenizer())
    points = [chr(k) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000]
    texts = [f"Ab{c}cd {c}ef gh{c} {c} {c}{c}." for c in points] + ["".join(points[k : k + 40]) for k in range(0, len(points), 40)]
    texts += [r.text or "" for r in rows_of(spark, "/root/testdata/sf0.01")]
    got = list(words.ids(texts))
    want = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, g, w in zip(texts, got, want, strict=True) if np.frombuffer(g, "<u4").tolist() != [*w.ids, 0]]
    assert not wrong, wrong[:20]


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    import random

    r = random.Random(seed)
    cap = r.choice([5, 20, 64, 2048])
    top = r.choice([cap, max(1, cap // 3)])
    sizes = [r.randint(1, top) for _ in range(r.randint(0, 300))]
    plan, bins = packing.plan(dict(collections.Counter(sizes)), cap)
    held = collections.defaultdict(list)
    for length, _, n, base, offset in plan:
        for k in range(n):
            held[base + k].append((offset, length))
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [v for v in room if v >= s]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - s)
        else:
            room.append(cap - s)
    assert bins == len(room) == len(held)
    assert sorted(cap - v for v in room) == sorted(sum(n for _, n in v) for v in held.values())
    for parts in held.values():
        assert all(o == sum(n for _, n in sorted(parts)[:k]) for k, (o, _) in enumerate(sorted(parts)))


def test_op5(spark, odd):
    turns = collections.defaultdict(list)
    for c, k, role, text in [*TURNS, (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]:
        turns[c].append((-1 if k is None else k, role or "", text or ""))
    got = {r.conv_id: r for r in Q["op5_chat_formatting"](spark, odd).collect()}
    assert set(got) == set(turns)
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(rows), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in rows).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c for c, r in got.items() if r.valid} == {1, 2, 8, -1}


def test_format_holds_no_control_string_of_a_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>")], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df).first()
    assert made.formatted.count("<|im_start|>") == 1 and made.formatted.count("<|im_end|>") == 1
    assert "".join(s.text for s in made.segments) == made.formatted and not made.valid


@pytest.mark.parametrize("where", ["odd", "small"])
def test_op6(spark, request, where):
    root = request.getfixturevalue(where)
    docs = [(r.doc_id, r.text or "") for r in rows_of(spark, root)]
    got = Q["op6_fingerprints"](spark, root).collect()
    if where == "small":
        docs.sort()
        by = {r.doc_id: r for r in got}
        gap = []
        for (d, t), (_, nxt) in zip(docs, [*docs[1:], docs[0]], strict=True):
            k = len(t) // 4
            edited = t[: len(t) - k] + nxt[:k]
            assert by[d].n_chars == len(t) and by[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, b = shingle_set(t), shingle_set(edited)
            gap.append(by[d].near_edited - len(a & b) / max(1, len(a | b)))
        assert abs(np.mean(gap)) < 0.02 and np.mean(np.abs(gap)) < 0.06
    prints = collections.defaultdict(set)
    text_of = dict(docs)
    for r in got:
        if r.doc_id is not None:
            prints[text_of[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in prints.values())


def test_sparse_fingerprints_are_unbiased(spark):
    """Densified bins: short texts, most of whose bins are empty, still estimate the Jaccard index."""
    rng = np.random.default_rng(1)
    pairs, want = [], []
    for k in range(200):
        w = [f"t{v}" for v in rng.integers(0, 10**6, 24)]
        other = [*w[:16], *(f"t{v}" for v in rng.integers(0, 10**6, 8))]
        pairs.append((k, " ".join(w), " ".join(other)))
        a, b = shingle_set(pairs[-1][1]), shingle_set(pairs[-1][2])
        want.append(len(a & b) / len(a | b))
    df = spark.createDataFrame(pairs, "k long, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "pa"), "b", "pb")
    got = [r.j for r in df.select("k", fingerprints.likeness(F.col("pa"), F.col("pb")).alias("j")).orderBy("k").collect()]
    assert abs(np.mean(np.array(got) - want)) < 0.03


def test_fingerprint_steps_stay_columns_of_their_own(spark):
    """No step is copied into a lambda, where it would be computed for each element: the words are cut and hashed once."""
    df = fingerprints.with_fingerprint(spark.createDataFrame([("a b",)], "text string"), "text", "print")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("sort_array(") == 1 and "from_json" not in plan.lower() and "fromjson" not in plan.lower()


@pytest.mark.parametrize("rows_each", [3, 1000])
def test_following_over_ranges(spark, rows_each):
    ids = mixing.written(spark.createDataFrame([(k * 7 % 40 - 20, k % 3) for k in range(40)], "k long, h long"), "ids")
    got = {(r.k, r.h): (r.next_k, r.next_h) for r in fingerprints.following(ids, rows_each).collect()}
    order = sorted(got)
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True)) and len(got) == 40


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub(r"\D", "", s)
    if kind == "ip":
        return all(len(v.lstrip("0")) <= 3 and int(v.lstrip("0") or 0) <= 255 for v in s.split("."))
    if kind == "card":
        total = sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(d))))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


@pytest.mark.parametrize("where", ["odd", "small"])
def test_op7(spark, request, where):
    root = request.getfixturevalue(where)
    want = collections.Counter()
    for r in rows_of(spark, root):
        found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, r.text or "") if passes(k, m[0])] for k, p in FORMS.items()}
        base = [s for v in found.values() for s in v]
        want[(r.doc_id, *[len(v) for v in found.values()], hashlib.sha256(",".join(base).encode()).hexdigest())] += 1
    got = Q["op7_pii"](spark, root).collect()
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert [pii.KINDS.index(k) for k in kinds] == sorted(pii.KINDS.index(k) for k in kinds)
        assert all(kinds.count(k) >= r[f"n_{k}"] for k in FORMS)


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(2)
    patterns = collections.Counter()
    for _ in range(4000):
        y = rng.random() < 0.4
        v = [1 if (y if rng.random() < p else not y) else -1 for p in (0.95, 0.8, 0.55, 0.7)]
        patterns["x", *v, 1] += 1
    rel, post = pii.reliabilities(patterns)
    right = {k: rel[k][1, 1] / (rel[k][1, 1] + rel[k][1, 0]) for k in pii.LABELERS}
    assert right["check"] > right["gazetteer"] > right["variety"] > right["context"]
    assert post["x", 1, 1, 1, 1, 1] > 0.9 > 0.1 > post["x", -1, -1, -1, -1, 1]


@pytest.mark.parametrize("where", ["odd", "small"])
def test_op8(spark, request, where):
    root = request.getfixturevalue(where)
    docs = rows_of(spark, root)
    got = Q["op8_sampled_sharding"](spark, root).collect()
    key = lambda d, t: (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter(key(r.doc_id, r.text) for r in docs)
    per, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        per[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if where == "small":
        mean = sum(per.values()) / 8
        assert all(abs(per[k] - mean) < 2 * max(r["size"] for r in got) for k in range(8))


@pytest.mark.parametrize("n", [3, 400, 3000])
def test_range_of_many_boundaries(spark, n):
    rng = np.random.default_rng(n)
    bounds = sorted({int(v) for v in rng.integers(-1 << 62, 1 << 62, n)})
    keys = [int(v) for v in rng.integers(-1 << 63, 1 << 62, 500)] + bounds[:50] + [bounds[-1], bounds[0] - 1]
    got = spark.createDataFrame([(k,) for k in keys], "key long").select("key", sharding.range_of(F.col("key"), bounds).alias("at")).collect()
    assert all(r["at"] == bisect.bisect_right(bounds, r.key) for r in got)


def test_op8_divides_repeated_rows(spark):
    """Half of all rows are one text under two ids, one of them null; the law holds all the same, and other groups stay whole."""
    docs = [(None if k % 2 else 7, "the same text again") for k in range(4000)] + [(10 + k, f"text {k // 3} " + "z" * (k % 40)) for k in range(4000)]
    records = spark.createDataFrame(docs, "tie long, text string").select(F.xxhash64("text").alias("key"), "tie", (F.octet_length("text") + 1).cast("long").alias("size"), "text")
    got = sharding.shard(records, 8).collect()
    per, slots, at = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        per[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        at[r.text].add(r.shard)
    mean = sum(per.values()) / 8
    assert len(got) == 8000 and all(abs(per[k] - mean) < 0.02 * mean + 60 for k in range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for t, v in at.items() if t[0] != "t" or t[:3] != "the")


def test_op3_fit_takes_an_id_once(spark):
    """An id on very many rows is one row of the sample, and the prior of planted classes is found."""
    from tessera.llm import quality

    rng = np.random.default_rng(31)
    good = lambda: ". ".join(" ".join(rng.choice(["The", "cat", "sat", "on", "a", "mat", "today", "again"], 12)) for _ in range(4)) + "."
    bad = lambda: "$$ !!! " + " ".join(rng.choice(["BUY", "NOW", "$$$", "99"], 40))
    docs = [(k, good() if k % 10 < 3 else bad()) for k in range(3000)] + [(4, "again and again")] * 400
    labels = [(k, 1) for k in range(3000) if k % 10 == 0]
    rows = quality.written(quality.measured(spark.createDataFrame(docs, "doc_id long, text string")), "m")
    model = quality.fit(rows, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert abs(model.prior - 0.3 * 3000 / 3400) < 0.08
    got = quality.scored(rows, model).select("doc_id", "score").where("doc_id <> 4").collect()
    assert np.mean([(r.score >= quality.CUT) == (r.doc_id % 10 < 3) for r in got]) > 0.95


def test_op10(spark, odd):
    good = [(i, np.array(v, float)) for i, v, _ in VECTORS if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = collections.Counter(), {i: i for i, _ in good}
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, u), (j, v) = good[a], good[b]
            if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95:
                links[i] += 1
                links[j] += 1
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = Q["op10_vector_near_duplicates"](spark, odd).collect()
    assert len(got) == len(VECTORS)
    for r in got:
        assert (r.n_links, r.component_id) == (links[r.vec_id], root.get(r.vec_id, r.vec_id))
        assert r.kept == (r.vec_id == r.component_id)


def test_op10_repeated_ids_against_brute_force(spark):
    from tessera.llm import neardup_vectors as nv

    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 16))
    rows = [(int(rng.integers(12)), (centres[rng.integers(6)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])).round(6).tolist()) for _ in range(150)] + [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01])]
    near = lambda u, v: len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if near(rows[i][1], rows[j][1])]
    got = nv.near_duplicates(spark.createDataFrame(rows, "vec_id long, vector array<double>"), tile=16).collect()
    assert collections.Counter((r.vec_id, r.component_id, r.n_links) for r in got) == by_rows([d for d, _ in rows], pairs)


def test_op10_recall_just_above_the_limit(spark):
    """1,500 pairs at a cosine of 0.9505 among vectors that are near nothing else."""
    from tessera.llm import neardup_vectors as nv

    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.stack([a, 0.9505 * a + (1 - 0.9505**2) ** 0.5 * b], axis=1).reshape(3000, 64)
    got = nv.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(pairs)], "vec_id long, vector array<double>")).collect()
    assert sum(r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in got) >= 0.99 * 3000 and all(r.n_links <= 1 for r in got)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The odd tables, and vectors and documents in groups under ids that repeat."""
    rng = np.random.default_rng(14)
    root = str(tmp_path_factory.mktemp("planted"))
    centres = rng.normal(size=(20, 16))
    vectors = [(int(k // 1.3), (centres[rng.integers(20)] + rng.normal(size=16) * rng.choice([0, 0.1])).tolist()) for k in range(300)] + [(v[0], v[1]) for v in VECTORS]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    docs = list(ODD) + [(int(k // 1.2) + 50, " ".join(f"p{k % 9}q{v + int(v == k % 50)}" for v in range(40 + k % 3))) for k in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("s"), F.col("doc_id") % 5))).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.mark.parametrize("where", ["planted", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, request, name, where):
    root = "/root/testdata/sf0.01" if where == "sf0.01" else request.getfixturevalue(where)
    duck = duckdb.connect()
    for k in ("documents", "embeddings", "conversations", "benchmark"):
        at = f"{root}/{k}.parquet"
        duck.execute(f"CREATE VIEW {k} AS SELECT * FROM read_parquet('{at if os.path.isfile(at) else at + '/*.parquet'}')")
    got, found = Q.get(name)(spark, root), duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in got.columns) for r in found.fetchall())
    assert collections.Counter(tuple(map(plain, r)) for r in got.collect()) == want


def test_op10_large_group_in_several_tiles(spark):
    from tessera.llm import neardup_vectors as nv

    rng = np.random.default_rng(4)
    x = rng.normal(size=32)
    group = [(k, (x + rng.normal(size=32) * 0.05).tolist()) for k in range(80)]
    other = [(100 + k, rng.normal(size=32).tolist()) for k in range(40)]
    got = nv.near_duplicates(spark.createDataFrame(group + other, "vec_id long, vector array<double>"), tile=16).collect()
    for r in got:
        assert (r.component_id, r.n_links) == ((0, 79) if r.vec_id < 100 else (r.vec_id, 0))


def test_written_out_addresses_have_no_length_bound(spark):
    from tessera.llm import pii

    address = "x" * 200 + " (at) " + "h" * 90 + " (dot) org"
    df = spark.createDataFrame([(f"mail {address} now",)], "text string")
    more = pii.candidates(df).select("more").first()["more"]
    assert [(r["kind"], r["start"], r["end"]) for r in more if r["kind"] == "contact"] == [("contact", 5, 5 + len(address))]
