"""Operators 11 to 13 against their plain versions, on edge rows and on a small supplied table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import merkle, queries, shared, sketch, spelling
from tests.llm import brute
from tests.llm.test_llm_ops import DOC, SF, docs, edge, edge_rows, empty, pairs, same  # noqa: F401


def values(df, cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# helpers ------------------------------------------------------------------------------------------

def test_range_numbers(spark):
    rnd = random.Random(3)
    rows = [(None if i % 50 == 0 else f"g{min(i % 7, 2)}", rnd.choice([None, 1, 2, 3, rnd.randint(0, 9)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, at long")
    got = shared.range_numbered(df, ["g"], ["k"], "at_", "size").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r.at_)
        assert [r.at_ for r in rs] == list(range(len(rs))) and {r.size for r in rs} == {len(rs)}
        ks = [(r.k is not None, r.k or 0) for r in rs]
        assert ks == sorted(ks)
    assert sorted(r.at for r in got) == list(range(3000))


# 11 -----------------------------------------------------------------------------------------------

WORDS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("cell", [8192, 5])
def test_variants_edge(spark, edge, empty, cell):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(5, 8))) for _ in range(60)]
    base = [*base, *[w[:3] + rnd.choice("abcé") + w[3:] for w in base]]
    texts = [" ".join(rnd.choice(base) for _ in range(800)) + " Àbcdef×gh " * 5 for _ in range(6)]
    texts += ["chainsaw " * 300 + "chainsaws " * 50 + "chainsews " * 9 + "chainsewsé " * 9]
    rows = [*pairs(edge), *[(k, t) for k, t in enumerate(texts)], (None, "x" * 40_000 + " ÀÉabcdef" * 9)]
    df = shared.written(spark.createDataFrame(rows, "doc_id long, text string"), "words")
    want = brute.variants(brute.words(rows))
    assert sum(r[4] for r in want) > 50 and any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want if r[1])
    same(values(spelling.variants(df, cell_words=cell), WORDS), want)
    assert spelling.variants(empty).count() == 0


def test_variants_query(spark, docs):
    same(values(queries.queries()["op11_spelling_variants"](spark, SF), WORDS), brute.variants(brute.words(pairs(docs))))


def test_tree_reaches_all_within_distance():
    rnd = np.random.default_rng(1)
    texts = ["".join(rnd.choice(list("abcdeé"), 7)) for _ in range(400)]
    v = spelling.vectors(texts)
    tree, n = spelling.upper_tree(v, 16)
    assert n == 16
    cell = {int(i): c for c, at in spelling.reached(tree, v, 0) for i in at}
    assert len(cell) == 400
    far = np.abs(v[:, None].astype(int) - v[None]).sum(axis=2)
    hit = {(int(i), c) for c, at in spelling.reached(tree, v, 2) for i in at}
    assert all((i, cell[j]) in hit for i, j in zip(*np.nonzero(far <= 2)))
    got = {(int(a), int(b)) for x, y in spelling.near_in(v, v, 2) for a, b in zip(x, y)}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= 2))))


def test_search_prunes():
    rnd = np.random.default_rng(2)
    v = spelling.vectors(["".join(rnd.choice(list("abcdefghijklmnopqrst"), 9)) for _ in range(4000)])
    tree, _ = spelling.upper_tree(v, 128)
    visits = sum(len(at) for _, at in spelling.reached(tree, v, 2))
    assert visits < 0.35 * 128 * len(v)


# 12 -----------------------------------------------------------------------------------------------

PRINTS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_fingerprints_edge(edge, empty):
    same(values(sketch.compare_neighbours(edge), PRINTS), brute.neighbours(pairs(edge)))
    assert sketch.compare_neighbours(empty).count() == 0


def test_fingerprints_hot_copies(spark):
    rows = [(5, "one row that many copies share " * 4)] * 500 + [(k, f"text {k} " * k) for k in range(40)] + [(5, "another text")]
    df = shared.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "copies")
    same(values(sketch.compare_neighbours(df), PRINTS), brute.neighbours(rows))
    one = shared.written(spark.createDataFrame(rows[:1], "doc_id long, text string"), "copies")
    same(values(sketch.compare_neighbours(one), PRINTS), brute.neighbours(rows[:1]))


def test_fingerprints_query_is_native(spark, docs):
    got = queries.queries()["op12_fingerprints"](spark, SF)
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
    same(values(got, PRINTS), brute.neighbours(pairs(docs)))


def test_sketches_merge_and_contain(spark):
    rnd = random.Random(1)
    words = [f"w{rnd.randint(0, 10 ** 6)}" for _ in range(20_000)]
    rows = [("part", " ".join(words[:4000])), ("whole", " ".join(words)), ("rest", " ".join(words[3996:])), ("short", " ".join(words[:30]))]
    df = shared.written(sketch.with_sketch(spark.createDataFrame(rows, "k string, t string"), "t", "s").select("k", "s"), "sketches")
    df = shared.written(df.withColumn("f", sketch.fingerprint(F.col("s"))), "sketches")
    assert df.where(sketch.parsed(F.col("f")) != F.col("s")).count() == 0
    a, b = df.alias("a"), df.alias("b")
    both = a.crossJoin(b).select(F.concat_ws(" ", "a.k", "b.k").alias("k"), sketch.containment(sketch.compared(F.col("a.s"), F.col("b.s"))).alias("c"),
                                 (sketch.merged(F.col("a.s"), F.col("b.s")) == F.col("a.s")).alias("m"))
    got = {r.k: r for r in both.collect()}
    assert got["part whole"].c == 1.0 and abs(got["whole part"].c - 0.2) < 0.03 and got["short whole"].c == 1.0 and got["short rest"].c == 0.0
    assert got["whole part"].m and got["part part"].m


# 13 -----------------------------------------------------------------------------------------------

PROOFS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def leaf_rows(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("levels", [1, 4])
def test_merkle_edge(spark, edge, empty, levels):
    rnd = random.Random(9)
    more = [(i, rnd.choice(["A B", None, "", "é"]), rnd.choice(["en", "en", "en", "de", None, ""]), f"s{i % 4}", None if i % 11 == 0 else i) for i in range(150)]
    df = shared.written(edge.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, DOC))
                        .withColumn("idx", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("leaf", F.lit(None).cast("string")), "leaves")
    want = brute.merkle(leaf_rows(df))
    same(values(merkle.prove(df, levels), PROOFS), want)
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
    assert merkle.prove(empty).count() == 0


def test_merkle_query(spark, docs):
    same(values(queries.queries()["op13_merkle_manifest"](spark, SF), PROOFS), brute.merkle(leaf_rows(docs)))


def test_postorder_positions():
    for n in [1, 2, 7, 8, 9, 64, 65, 100, 513, 600]:
        items = [i.to_bytes(32, "little") for i in range(n)]
        log = merkle.completed(items, merkle.height(n))
        level, at = items, {}
        for lv in range(merkle.height(n) + 1):
            for i, d in enumerate(level):
                p = merkle.position(lv, i, n)
                assert log[32 * p:32 * p + 32] == d
                at[p] = d
            level = [merkle._digest(level[k:k + 8]) for k in range(0, len(level), 8)]
        assert sorted(at) == list(range(len(log) // 32))


def test_log_addresses(spark, docs):
    rows, forest, _, _ = merkle.manifest(docs, 1)
    log = shared.written(merkle.log_rows(forest), "log")
    sizes = {r.tree: r for r in log.groupBy("tree").agg(F.count("*").alias("k"), F.countDistinct("position").alias("d"), F.max("position").alias("m")).collect()}
    assert all(r.k == r.d == r.m + 1 for r in sizes.values())
    wanted = rows.where("idx % 13 = 5").select("tree", "idx", "n")
    proofs = {(r.tree, r.idx): r.siblings for r in merkle.proofs_at(log, wanted).collect()}
    roots = {r.tree: bytes(r.digest) for r in forest.roots().collect()}
    for r in rows.where("idx % 13 = 5").collect():
        d, left = bytes(r.leaf), [bytes(x) for x in proofs[(r.tree, r.idx)]]
        for lv in range(merkle.height(r.n)):
            k = len(merkle.siblings(lv, r.idx >> (3 * lv), r.n))
            slot = (r.idx >> (3 * lv)) & 7
            d, left = merkle._digest([*left[:slot], d, *left[slot:k]]), left[k:]
        assert d == roots[r.tree] and not left
