"""Operators on whole texts against plain versions, over adversarial tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import components, op1_minhash, op5_phrases, op8_lines, op10_suffix, semi, twice
from tests.llm import cases

DIGESTS = [(op8_lines.line_digest, cases.lines_result), (op5_phrases.phrase_digest, cases.phrases_result), (op10_suffix.suffix_digest, cases.suffix_result), (op1_minhash.near_duplicates, cases.near_result)]


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize(("operator", "plain"), DIGESTS)
def test_equals_the_plain_version(spark, operator, plain, seed):
    rows = cases.noisy(seed)
    got = cases.table(operator(cases.documents(spark, rows).repartition(5)))
    assert got == sorted(plain(rows), key=repr)


@pytest.mark.parametrize(("operator", "plain"), DIGESTS)
def test_empty_table(spark, operator, plain):
    assert operator(cases.documents(spark, [])).collect() == []


@pytest.mark.parametrize(("operator", "plain"), DIGESTS)
def test_clashing_columns(spark, operator, plain):
    rows = cases.noisy(7, 12)
    docs = cases.documents(spark, rows)
    for c in ("key", "n_words", "n_lines", "doc", "rep", "shard", "drop", "component_id", "h", "pos", "ranges", "__maybe_"):
        docs = docs.withColumn(c, F.lit("x"))
    assert cases.table(operator(docs)) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("copies", [40, 300])
def test_groups_of_near_copies_that_only_the_original_joins(spark, copies):
    """Copies are within 0.75 of the original but not of each other."""
    rnd = random.Random(copies)
    base = ["w%d" % i for i in range(160)]
    rows = [(1000, " ".join(base))]
    for k in range(copies):
        w = list(base)
        for i in rnd.sample(range(6, 154, 6), 4):
            w[i] = "x%d_%d" % (k, i)
        rows.append((k, " ".join(w)))
    rows += [(2000 + k, " ".join("y%d_%d" % (k % 7, i) for i in range(50))) for k in range(21)]
    assert cases.table(op1_minhash.near_duplicates(cases.documents(spark, rows).repartition(4))) == sorted(cases.near_result(rows), key=repr)


def test_keeping_and_dropping_rows(spark):
    rows = cases.noisy(8, 30)
    docs = cases.documents(spark, rows).withColumn("__drop", F.lit(1)).withColumn("__Maybe", F.lit(2)).withColumn("__gone", F.lit(3)).withColumn("__doc", F.lit(4))
    kept = op1_minhash.keep_first(docs)
    assert kept.columns == docs.columns
    want = sorted((d for (d, _), r in zip(rows, cases.near_result(rows), strict=True) if r[3] is not False), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    lines = op8_lines.dedup_lines(docs)
    assert lines.schema == docs.schema
    got = sorted(((r.doc_id, None if r.text is None else cases.sha(r.text.encode())) for r in lines.collect()), key=repr)
    assert got == sorted(((d, None if t is None else x[3]) for (d, t), x in zip(rows, cases.lines_result(rows), strict=True)), key=repr)


def test_emptied_rows(spark):
    rows = [(1, "a line of some length\nand another line"), (2, "a line of some length \n\n AND another line"), (3, "a line of some length\nx"), (4, ""), (5, None), (6, " "), (None, "a line of some length")]
    got = op8_lines.dedup_lines(cases.documents(spark, rows), keep_emptied=False).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([rows[0], (3, "x"), rows[3], rows[4], rows[5], rows[6]], key=repr)


def test_very_long_texts(spark):
    """One text of megabytes, one line of it, one word of it."""
    rnd = random.Random(2)
    long = "\n".join(" ".join("%05x" % rnd.randrange(1 << 20) for _ in range(30)) for _ in range(4000))
    rows = [(1, long), (2, "x" * 600_000), (3, "y " * 300_000), (4, long[200_000:400_000]), (5, "z\n" * 100_000), (6, "x" * 600_000)]
    for operator, plain in ((op8_lines.line_digest, cases.lines_result), (op5_phrases.phrase_digest, cases.phrases_result), (op1_minhash.near_duplicates, cases.near_result)):
        assert cases.table(operator(cases.documents(spark, rows))) == sorted(plain(rows), key=repr)
    short = [(d, t[:150_000]) for d, t in rows]
    assert cases.table(op10_suffix.suffix_digest(cases.documents(spark, short))) == sorted(cases.suffix_result(short), key=repr)


def _sized(monkeypatch, **sizes):
    from fieldloom.llm import anchors

    for operator in (op5_phrases, op10_suffix):
        monkeypatch.setattr(operator, "SIZES", anchors.Sizes(**sizes))


def test_hot_owner_is_split(spark, monkeypatch):
    _sized(monkeypatch, owner=20)
    rows = cases.noisy(9, 40)
    for operator, plain in ((op5_phrases.phrase_digest, cases.phrases_result), (op10_suffix.suffix_digest, cases.suffix_result)):
        assert cases.table(operator(cases.documents(spark, rows))) == sorted(plain(rows), key=repr)


def _around_one_passage(n: int) -> list[tuple[int, str]]:
    """Texts around one passage of 60 words; some share more than that with another text."""
    rnd = random.Random(n)
    passage = " ".join("p%d" % i for i in range(60))
    more = [" ".join("q%d_%d" % (k, i) for i in range(30)) for k in range(5)]
    say = lambda: " ".join("%06x" % rnd.randrange(1 << 24) for _ in range(40))
    return [(i, f"{say()} {passage} {rnd.choice(more) if rnd.random() < 0.2 else ''} {say()}") for i in range(n)]


@pytest.mark.parametrize("places", [3, 1])
def test_hot_anchors_are_dealt_by_run_or_window(spark, monkeypatch, places):
    from fieldloom.llm import anchors

    _sized(monkeypatch, hot=places, mean=40)
    monkeypatch.setattr(anchors, "HOT_KINDS", 2)
    for rows in (cases.noisy(12, 40), _around_one_passage(80)):
        for operator, plain in ((op5_phrases.phrase_digest, cases.phrases_result), (op10_suffix.suffix_digest, cases.suffix_result)):
            assert cases.table(operator(cases.documents(spark, rows).repartition(4))) == sorted(plain(rows), key=repr)


def test_one_passage_in_all_texts_is_no_large_shard(spark, monkeypatch):
    """Texts around one passage bring as many different surroundings; no shard gathers them."""
    from fieldloom.llm import anchors

    shards, by_shard = [], anchors.by_shard

    def counted(found, solve, least):
        shards.append(max(r.n for r in found.groupBy("shard").agg(F.count_distinct("piece").alias("n")).collect()))
        return by_shard(found, solve, least)

    monkeypatch.setattr(anchors, "by_shard", counted)
    _sized(monkeypatch, mean=100, hot=1000)
    rows = _around_one_passage(1500)
    for operator, plain in ((op5_phrases.phrase_digest, cases.phrases_result), (op10_suffix.suffix_digest, cases.suffix_result)):
        assert cases.table(operator(cases.documents(spark, rows).repartition(4))) == sorted(plain(rows), key=repr)
    assert max(shards) <= 1000, shards


def test_search_in_cells(spark, monkeypatch):
    monkeypatch.setattr(op1_minhash, "LEFT", (2, 3))
    monkeypatch.setattr(op1_minhash, "RIGHT", (3, 5))
    monkeypatch.setattr(op1_minhash, "PAIRS", 7)
    for seed in (10, 11):
        rows = cases.noisy(seed, 30)
        assert cases.table(op1_minhash.near_duplicates(cases.documents(spark, rows))) == sorted(cases.near_result(rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_of_one_id_with_different_texts(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(25), t) for _, t in cases.noisy(20 + seed, 40)] + [(3, None), (3, "some other text"), (77, ""), (77, "one two"), (None, "one two")]
    for operator, plain in DIGESTS:
        assert cases.table(operator(cases.documents(spark, rows).repartition(3))) == sorted(plain(rows), key=repr)


def test_steps_remove_what_nothing_reads(spark):
    import os

    from fieldloom import shared
    from fieldloom.llm import state

    there = lambda df: os.path.exists(df._kept_at)
    with state.steps(spark) as outer:
        with state.steps(spark) as inner:
            a, b, c = (state.keep(spark.range(3), x) for x in "abc")
            inner(a, b)
        assert there(a) and there(b) and not there(c)
        outer(a)
    assert there(a) and not there(b) and a.count() == 3
    state.release(spark, a)
    assert not there(a)
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_twice_filter_misses_nothing():
    import numpy as np

    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    bits = twice.bits_for(5000)
    parts = [(np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)) for _ in range(3)]
    for k, (once, two) in enumerate(parts):
        twice.insert(once, two, np.concatenate((keys[:100], keys[1000 * k + 100 : 1000 * k + 1100])), bits)
    once, two = parts[0]
    for o, t in parts[1:]:
        two |= t | (once & o)
        once |= o
    seen = twice.Twice(two, bits)
    assert seen.test(keys[:100]).all()
    assert seen.test(keys[100:3100]).mean() < 0.1


def test_shares_of_the_key_space(spark, monkeypatch):
    """More keys than a filter serves: several filters, the same results."""
    monkeypatch.setattr(twice, "MIN_BITS", 1 << 8)
    monkeypatch.setattr(twice, "MAX_BITS", 1 << 8)
    assert len(twice.shares(3 << 8)) == 3 and len(twice.shares(1)) == 1 and len(twice.shares(1 << 60)) == twice.MAX_SHARES
    rows = cases.noisy(14, 40)
    for operator, plain in DIGESTS[:3]:
        assert cases.table(operator(cases.documents(spark, rows).repartition(3))) == sorted(plain(rows), key=repr)


def test_rows_left_out_by_id(spark):
    from fieldloom.llm import state

    docs = cases.documents(spark, [(i, "t") for i in range(50)] + [(None, "n")])
    ids = state.keep(spark.createDataFrame([(i,) for i in range(0, 50, 3)], "id long"), "ids")
    left = {r.doc_id for r in semi.without(docs, ids).collect()}
    assert left == {None, *(i for i in range(50) if i % 3)}


def test_likelihood_judges_similarity():
    import numpy as np

    from fieldloom.llm import textblocks as tb

    rng = np.random.default_rng(4)
    for share, may in ((0.95, True), (0.78, True), (0.3, False), (0.0, False)):
        pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        n = 1000
        common = int(round(2 * n * share / (1 + share)))
        a, b = tb.mix(pool[:n]), tb.mix(np.concatenate((pool[:common], pool[2000 : 3000 - common])))
        ra, rb = (op1_minhash.registers(x, np.array([0]))[0] for x in (a, b))
        got, how = op1_minhash.judge([n], [n], *[np.array([x]) for x in op1_minhash._counts(ra, rb)])
        assert bool(got[0]) is may and abs(how[0] - share) < 0.15
        union = op1_minhash.registers(np.concatenate((a, b)), np.array([0]))[0]
        assert (union == np.maximum(ra, rb)).all()  # mergeable


def test_word_classes_are_those_of_the_contract():
    import numpy as np

    from fieldloom.llm import op6_license
    from fieldloom.llm import textblocks as tb

    text = "".join(map(chr, range(0x250))) + "Ünïcode €uro x\x85y"
    want = re.findall(r"[^\x20\x09-\x0D]+", text)
    buf = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = tb.tokens(buf, np.array([0, len(buf)]), tb.WORD_BYTE)
    assert [buf[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == want
    assert text.encode().split() == [w.encode() for w in want]
    assert [w.decode() for w in op6_license.words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(cases.LOWER))
