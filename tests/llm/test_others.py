"""Archives, neighbours, test items, licences, packing, languages and the pipeline."""

from __future__ import annotations

import io
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import op2_warc, op3_vptree, op4_decontam, op6_license, op7_packing, op9_langid, state
from tests.llm import cases

ROOT = Path(__file__).resolve().parents[2]

# --- archives ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("zip64", [None, True])
def test_zip_members_by_range(zip64):
    sink = io.BytesIO()
    out = op2_warc.StoredZip(sink, zip64)
    data = {"a/é.bin": b"x" * 1000, "b": b"", "c": bytes(range(256))}
    for name, raw in data.items():
        out.begin(name)
        out.data(raw[: len(raw) // 2])
        out.data(raw[len(raw) // 2 :])
        out.end()
    out.close()
    reader = op2_warc.StoredZipReader(io.BytesIO(sink.getvalue()))
    assert {n: reader.read(n) for n in reader.members} == data
    at, size = reader.range_of("c")
    assert sink.getvalue()[at : at + size] == data["c"]
    import zipfile

    with zipfile.ZipFile(io.BytesIO(sink.getvalue())) as other:
        assert {n: other.read(n) for n in other.namelist()} == data and other.testzip() is None


def test_zip_of_others_with_a_comment():
    import zipfile

    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as out:
        out.writestr(zipfile.ZipInfo("m"), b"12345")
        out.writestr("packed", b"1" * 500, compress_type=zipfile.ZIP_DEFLATED)
        out.comment = b"PK\x05\x06 and more"
    reader = op2_warc.StoredZipReader(io.BytesIO(sink.getvalue()))
    assert reader.read("m") == b"12345"
    with pytest.raises(ValueError, match="compressed"):
        reader.read("packed")
    with pytest.raises(ValueError):
        op2_warc.StoredZipReader(io.BytesIO(b"no archive"))


def pages(spark):
    long = "<p>" + "é" * 80 + "</p>"
    rows = [(1, "http://a.com/x", long), (2, None, long), (3, "u\r\nX: y", long), (4, "http://b", None), (5, "http://c", ""), (6, "http://d", "short"), (7, "http://e", "short"), (None, "http://f", long), (1, "http://a.com/x", long), (8, "http://g", "a\r\n\r\nWARC/1.1" * 20)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


@pytest.mark.parametrize(("archive_bytes", "range_bytes", "zip64"), [(1 << 28, 8 << 20, None), (300, 200, True)])
def test_archives_round_trip(spark, archive_bytes, range_bytes, zip64):
    import hashlib

    folder = state.fresh_path(spark, "warc")
    manifest = op2_warc.write_archives(op2_warc.record_types(pages(spark)), folder, archive_bytes, zip64)
    got = op2_warc.read_archives(manifest, folder, range_bytes).collect()
    html = [(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()]
    want = []
    for p, h in html:
        same = [q for q, x in html if x == h and q is not None]
        first = min(same) if same and len(h) >= 100 else None
        refers = first if p is not None and first is not None and first < p else None
        want.append((p, len(h), hashlib.sha256(h).hexdigest(), "revisit" if refers is not None else "response", refers, None if refers is not None else h))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)


def test_small_records_take_linear_time(spark):
    """A range of very many records is cut up by the index."""
    import time

    n = 60_000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    folder = state.fresh_path(spark, "warc")
    manifest = op2_warc.write_archives(op2_warc.record_types(pages).coalesce(1), folder)
    start = time.perf_counter()
    got = op2_warc.read_archives(manifest, folder, 1 << 30).agg(F.count(F.lit(1)), F.sum("page_id"), F.sum("payload_bytes")).first()
    assert tuple(got) == (n, n * (n - 1) // 2, sum(len(str(i)) for i in range(n))) and time.perf_counter() - start < 60


def test_a_revisit_names_its_record():
    kept, again = (op2_warc.parse_record(op2_warc.warc_record(i, "u", b"x" * 200, "d", r))[0] for i, r in ((1, None), (5, 1)))
    assert again["warc-refers-to"] == kept["warc-record-id"] != again["warc-record-id"]
    long = "y" * 3_000_000
    assert op2_warc.parse_record(op2_warc.warc_record(1, None, long.encode(), "d", None))[1] == long.encode()


def test_no_pages(spark):
    folder = state.fresh_path(spark, "warc")
    manifest = op2_warc.write_archives(op2_warc.record_types(pages(spark).limit(0)), folder)
    assert manifest.count() == 0 and op2_warc.read_archives(manifest, folder).collect() == []


# --- neighbours -------------------------------------------------------------------------------------------------


def vectors(spark, n=700, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 2)
    x[n // 3 : 2 * n // 3] = x[0]  # one very common vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(9000, None), (9050, []), (9100, [0.0] * dim), (9150, [float("nan")] * dim), (9200, [1.0, None] + [0.0] * (dim - 2)), (9250, [float("inf")] * dim), (None, [1.0] * dim), (9300, [1.0] * (dim + 1)), (50, [float(v) for v in x[50]])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows


def plain_neighbours(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[i] = np.array(v)
    out = []
    for q in sorted(i for i in good if i % 50 == 0):
        a = good[q]
        near = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in good.items() if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, round(-s, 12)) for r, (s, i) in enumerate(near)]
    return out


@pytest.mark.parametrize(("shard_rows", "leaf"), [(10000, 256), (90, 8)])
def test_factor_one_is_exact(spark, shard_rows, leaf):
    df, rows = vectors(spark)
    valid = op3_vptree._valid(df, "vec_id", "embedding")
    got = op3_vptree.nearest(valid, valid.where("id % 50 = 0"), shard_rows=shard_rows, query_rows=5, leaf=leaf)
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in got.orderBy("query_id", "rank").collect()] == plain_neighbours(rows)


def test_smaller_factors_prune_more():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3))
    tree = op3_vptree.build_tree(np.arange(4000), x, leaf=16)
    unit = x[:50] / np.linalg.norm(x[:50], axis=1)[:, None]
    scanned = [op3_vptree.Search(tree, unit, 8, f).run().scanned for f in (1.0, 0.5, 0.1)]
    assert scanned[0] > scanned[1] > scanned[2] and scanned[0] < 0.3 * 50 * 4000
    exact, near = ({(q, i) for q, i, _ in op3_vptree.search(tree, np.arange(50), x[:50], factor=f)} for f in (1.0, 0.5))
    assert len(exact & near) / len(exact) >= 0.9


def test_a_shard_has_few_blocks_a_task(spark, monkeypatch):
    """One exchange brings trees and blocks together; sizes follow the length of the vectors."""
    monkeypatch.setattr(op3_vptree, "BLOCKS", 2)
    monkeypatch.setattr(op3_vptree, "SHARD_BYTES", 8 * 6 * 100)
    df, rows = vectors(spark)
    df = df.withColumn("dim", F.lit("clash")).withColumn("id", F.lit("clash")).withColumn("shard", F.lit(0))
    valid = op3_vptree._valid(df, "vec_id", "embedding")
    got = op3_vptree.nearest(valid, valid.where("id % 50 = 0"), query_rows=2, leaf=8)
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in got.orderBy("query_id", "rank").collect()] == plain_neighbours(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dim" in plan and "group" in plan and "REPARTITION" not in plan


@pytest.mark.parametrize("shard_rows", [10000, 30])
def test_many_ties_go_to_the_smaller_id(spark, shard_rows):
    scaled = [(i, [0.1 * (i + 1), 0.3 * (i + 1), 0.7 * (i + 1)]) for i in range(199, -1, -1)]  # one direction, all different
    hot = [(1000 + i, [float(i == j) for j in range(30)]) for i in range(30)]  # all at cosine 0
    df = spark.createDataFrame(scaled + hot, "vec_id long, embedding array<double>")
    v = op3_vptree._valid(df, "vec_id", "embedding")
    got = op3_vptree.nearest(v, v.where("id % 50 = 0"), shard_rows=shard_rows, leaf=16).orderBy("query_id", "rank").collect()
    want = {q: [i for i in range(6) if i != q][:5] for q in (0, 50, 100, 150)} | {1000: list(range(1001, 1006))}
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in want} == want


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    v = op3_vptree._valid(df, "vec_id", "embedding")
    assert [tuple(r) for r in op3_vptree.nearest(v, v.where("id % 50 = 0")).collect()] == [(0, 1, 1, 0.0)]
    none = op3_vptree._valid(df.limit(0), "vec_id", "embedding")
    assert op3_vptree.nearest(none, none).collect() == []


# --- test items -------------------------------------------------------------------------------------------------


def benchmark_and_documents(seed=2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 4)))
    say = lambda k: " ".join(word() for _ in range(k))
    items = [(i, f"{say(12)}. {say(9)}.\n{say(6)}.") for i in range(20)] + [(20, say(150) + ". " + say(10)), (21, None), (22, ""), (23, "only one sentence here with words"), (None, say(20))]
    docs = [(i, say(rnd.randint(0, 400))) for i in range(40)]
    docs += [(100 + i, f"{say(80)} {items[i][1].upper() if i % 2 else items[i][1]} {say(90)}") for i in range(21)]
    docs += [(200, None), (201, ""), (202, items[3][1].split(".")[0] + " " + say(50)), (None, items[4][1]), (100, docs[40][1])]
    return items, docs


def test_leaks(spark):
    items, docs = benchmark_and_documents()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op4_decontam.leaks(cases.documents(spark, docs).withColumn("score", F.lit(1)), bench).collect()}
    assert got == {(100 + i, i) for i in range(21)} | {(None, 4)}
    clean = op4_decontam.decontaminate(cases.documents(spark, docs), bench)
    assert clean.columns == cases.documents(spark, docs).columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((d for d, _ in docs if d is not None and not 100 <= d <= 120), key=repr)


def test_whole_copy_after_a_quoted_question(spark):
    """The passage with the best score holds no answer; the copy far behind it counts."""
    items, _ = benchmark_and_documents()
    say = lambda n: " ".join("zq%d" % (i % 89) for i in range(n))
    question = " ".join(items[20][1].split(" ")[:100])  # two of the item's entries, without its answer
    edited = items[0][1].replace(items[0][1].split(" ")[3], "other")  # scores less than the question it follows
    docs = [(1, f"{question} {say(900)} {items[20][1]}"), (2, f"{question} {say(900)}"), (3, f"{items[0][1].rsplit('.', 2)[0]} {say(900)} {edited} {say(50)}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in op4_decontam.leaks(cases.documents(spark, docs), bench).collect()}
    assert set(got) == {(1, 20), (3, 0)} and all(r.first_word > 500 for r in got.values())
    assert [r.doc_id for r in op4_decontam.decontaminate(cases.documents(spark, docs), bench).collect()] == [2]


def test_items_without_an_id(spark, monkeypatch):
    items, docs = benchmark_and_documents()
    items += [(None, items[20][1][::-1])]  # two, one of several entries
    bench = spark.createDataFrame(items, "item_id long, text string")
    held = [(700, f"{docs[1][1]} {items[-1][1]} {items[-2][1]}"), (701, docs[2][1])]
    whole = cases.table(op4_decontam.leaks(cases.documents(spark, held), bench))
    assert [r[:2] for r in whole] == [(700, None)] * 2
    assert [r.doc_id for r in op4_decontam.decontaminate(cases.documents(spark, held), bench).collect()] == [701]
    monkeypatch.setattr(op4_decontam, "GROUP_TERMS", 60)
    assert cases.table(op4_decontam.leaks(cases.documents(spark, held), bench)) == whole
    monkeypatch.setattr(op4_decontam, "CHAIN", 2)
    assert [r.doc_id for r in op4_decontam.decontaminate(cases.documents(spark, held), bench).collect()] == [701]


def test_index_groups_agree(spark, monkeypatch):
    items, docs = benchmark_and_documents()
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = cases.table(op4_decontam.leaks(cases.documents(spark, docs[:-1]), bench))
    monkeypatch.setattr(op4_decontam, "GROUP_TERMS", 60)
    assert len(list(op4_decontam.build_indexes(bench))) > 4
    assert cases.table(op4_decontam.leaks(cases.documents(spark, docs[:-1]), bench)) == whole


def test_no_items_or_documents(spark):
    items, docs = benchmark_and_documents()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert op4_decontam.leaks(cases.documents(spark, docs), bench.limit(0)).collect() == []
    assert op4_decontam.leaks(cases.documents(spark, []), bench).collect() == []


def plain_passages(items, docs, threshold=0.5):
    """BM25 by hand: (document's place, first word, item's place) -> best score of the item's entries, of those above."""
    import math
    from collections import Counter

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(cases.LOWER))
    entries = []
    for i, (_, text) in enumerate(items):
        w = find(text)
        n = max(1, -(-len(w) // 48))
        step = -(-len(w) // n) if w else 1
        entries += [(i, w[a : a + step]) for a in range(0, len(w), step)]
    df, mean = Counter(t for _, w in entries for t in set(w)), sum(len(w) for _, w in entries) / max(1, len(entries))
    weights = []
    for i, w in entries:
        x = {t: math.log(1 + (len(entries) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in Counter(w).items()}
        weights.append((i, {t: v / sum(x.values()) for t, v in x.items()}))
    out = {}
    for d, (_, text) in enumerate(docs):
        w = find(text)
        for lo in range(0, max(1, len(w) - 64), 64) if w else ():
            held = set(w[lo : lo + 128])
            for i, x in weights:
                score = sum(v for t, v in x.items() if t in held)
                if score >= threshold - 1e-9:
                    out[d, lo, i] = max(score, out.get((d, lo, i), 0.0))
    return out


def plain_leaks(items, docs):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(cases.LOWER))
    grams = lambda w, n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    best: dict = {}
    for (d, lo, i), score in plain_passages(items, docs).items():
        parts = [x for x in map(find, re.split(r"[.!?\n]+", items[i][1])) if x]
        if len(parts) > 1:
            question, answer = [x for part in parts[:-1] for x in part], parts[-1]
        else:
            cut = len(parts[0]) - max(1, len(parts[0]) // 3) if len(parts[0]) > 1 else 0
            question, answer = parts[0][:cut] or parts[0], parts[0][cut:]
        w, reach = find(docs[d][1]), len(question) + len(answer)
        near = w[max(0, lo - reach) : min(len(w), min(lo + 128, len(w)) + reach)]
        shares = [len(g & grams(near, min(n, len(x)))) / len(g) for x, n in ((question, 3), (answer, 2)) for g in [grams(x, min(n, len(x)))]]
        if min(shares) >= 0.5:
            row = (-round(score, 9), lo, *(round(x, 9) for x in shares))
            best[d, i] = min(row, best.get((d, i), row))
    return sorted(((docs[d][0], items[i][0], -s, q, a, lo) for (d, i), (s, lo, q, a) in best.items()), key=repr)


def hard_documents(items, docs, seed=7):
    """Items in part, edited and shuffled, within other words of the same vocabulary: many scores near the threshold."""
    rnd = random.Random(seed)
    out = list(docs)
    for k in range(150):
        w = (rnd.choice(items[:21])[1] or "").split()
        for _ in range(rnd.randint(0, len(w) // 2)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 2)] = [rnd.choice(docs[rnd.randrange(30)][1].split() or ["x"])]
        if k % 5 == 0:
            rnd.shuffle(w)
        out.append((1000 + k, " ".join(docs[rnd.randrange(40)][1].split()[: rnd.randint(0, 200)] + w + docs[rnd.randrange(40)][1].split()[: rnd.randint(0, 200)])))
    return out


def test_retrieval_is_plain_bm25(spark):
    """Every passage above the threshold is retrieved, with its score, and no other."""
    import pyarrow as pa

    from fieldloom.llm import textblocks as tb

    items, docs = benchmark_and_documents()
    docs = hard_documents(items, docs)
    index, = op4_decontam.build_indexes(spark.createDataFrame(items, "item_id long, text string"))
    place = {x: i for i, x in enumerate(items)}
    got, want = {}, plain_passages(items, docs)
    for block in tb.blocks(pa.array([t for _, t in docs], pa.string())):
        lower = tb.LOWER[block.buf]
        tokens = tb.tokens(lower, block.offs, tb.ALNUM_BYTE)
        for (r, i), at in op4_decontam.retrieve(index, lower, tokens, op4_decontam.THRESHOLD).items():
            got |= {(block.lo + r, lo - int(tokens[2][r]), place[index.items[i]]): s for (lo, _), s in at.items()}
    assert got.keys() == want.keys() and len(want) > 200
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_against_plain(spark):
    items, docs = benchmark_and_documents()
    items = [*items, items[5], (77, items[6][1])]  # repeated items
    docs = hard_documents(items, docs, 8) + [(5000, "zz " * 100_000 + items[2][1] + " zz" * 50_000)]  # a very long text
    got = op4_decontam.leaks(cases.documents(spark, docs).repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted(((r.doc_id, r.item_id, round(r.score, 9), round(r.question_overlap, 9), round(r.answer_overlap, 9), r.first_word) for r in got.collect()), key=repr)
    assert rows == plain_leaks(items, docs)


def test_wand_retrieves_all_above_the_threshold(spark):
    items, _ = benchmark_and_documents(9)
    index, = op4_decontam.build_indexes(spark.createDataFrame([(i, t) for i, t in items if i is not None and t], "item_id long, text string"))
    rnd = random.Random(1)
    for _ in range(500):
        terms = sorted(rnd.sample(range(len(index.vocabulary)), rnd.randint(1, 30)))
        limit = rnd.choice([0.02, 0.05, 0.1, 0.3])
        scores: dict[int, float] = {}
        for t in terms:
            at = slice(index.starts[t], index.starts[t + 1])
            for e, x in zip(index.entries[at].tolist(), index.weights[at].tolist(), strict=True):
                scores[e] = scores.get(e, 0) + x
        assert [e for e, _ in op4_decontam.block_max_wand(index, terms, limit)] == sorted(e for e, x in scores.items() if x >= limit - 1e-9)


# --- licences ---------------------------------------------------------------------------------------------------


def test_licences(spark):
    from fieldloom.llm import license_texts

    mit = license_texts.TEMPLATES[3][1]
    changed = mit.replace("free of charge", "at no charge whatsoever").replace("merge, ", "")
    every_sixth = " ".join("zz%d" % i if i % 6 == 5 else w for i, w in enumerate(mit.split()))
    docs = [(1, "x " + mit + " y MIT License"), (2, "some " + changed), (10, every_sixth), (3, "mit  LICENSE; apache-license GENERAL public license mit license"), (4, None), (5, ""), (6, "license mit"), (7, "word " * 500), (None, "MIT License"), (8, "a €mit license"), (9, "permission is hereby granted"), (3, "mit  LICENSE; apache-license GENERAL public license mit license")]
    got = {r.doc_id: r for r in op6_license.scan(cases.documents(spark, docs).withColumn("labels", F.lit("clash"))).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].n_base) == ("mit", "mit", 1) and got[1].score == 1.0
    assert got[10].labels == "mit"
    assert (got[2].n_base, got[2].base_labels, got[2].labels) == (0, "", "mit") and 0.8 <= got[2].score < 1
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].last_word, got[3].labels) == (9, 4, 0, 7, "apache,gpl,mit")
    for d in (4, 5):
        assert tuple(got[d]) == (d, 0, 0, None, None, "", "", 0.0)
    assert got[6].n_base == got[7].n_base == got[8].n_base == got[9].n_base == 0 and got[9].labels == ""
    assert got[None].base_labels == "mit"
    assert op6_license.scan(cases.documents(spark, [])).collect() == []


def test_base_places_against_plain(spark):
    rnd = random.Random(3)
    pool = ["mit", "license", "apache", "general", "public", "x", "MIT", "License", "lic€nse"]
    docs = [(i, "".join(rnd.choice(pool) + rnd.choice([" ", "-", "\n", "_"]) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    phrases = [(p.split(), x) for p, x in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))]
    want = []
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(cases.LOWER))
        hit = [(i, x) for p, x in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        want.append((d, len(w), len(hit), min(hit)[0] if hit else None, max(hit)[0] if hit else None, ",".join(sorted({x for _, x in hit}))))
    assert cases.table(op6_license.base_places(op6_license.with_keys(cases.documents(spark, docs))).drop("key")) == sorted(want, key=repr)


def plain_labels(text: str, k: int = 3) -> tuple[set, float]:
    """Diagonal voting by hand: hits, stretches of diagonals, alignments."""
    from fieldloom.llm import license_texts

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(cases.LOWER))
    doc, labels, score = find(text), set(), 0.0
    for label, whole in license_texts.TEMPLATES:
        t = find(whole)
        n, half, hits = len(t), max(1, len(t) // 2), {}
        for p in range(len(doc) - k + 1):
            for q in range(n - k + 1):
                if doc[p : p + k] == t[q : q + k]:
                    at = (p - q) // half
                    for j in (at - 1, at):
                        hits.setdefault(j, []).append(p)
        for ps in hits.values():
            if len(ps) >= max(1, int(n * (1 - k * 0.2)) - (k - 1)):
                part = doc[max(0, min(ps) - k) : max(ps) + 2 * k]
                cover, density, _, _ = op6_license.alignment([w.encode() for w in t], [w.encode() for w in part])
                if cover >= 0.8 and density >= 2 / 3:
                    labels.add(label)
                    score = max(score, cover)
    return labels, score


def test_labels_and_score_against_plain(spark):
    from fieldloom.llm import license_texts

    rnd = random.Random(8)
    docs = []
    for i in range(40):
        _, text = rnd.choice(license_texts.TEMPLATES)
        w = text.split()
        for _ in range(rnd.randint(0, len(w) // 4)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = ["zz%d" % rnd.randrange(50)] * rnd.randint(0, 2)
        if i % 4 == 0:  # insertions in two places, as of a page's footer
            for at in (len(w) // 3, 2 * len(w) // 3):
                w[at:at] = ["footer%d" % j for j in range(len(w) // 5)]
        docs.append((i % 37, " ".join(["x"] * rnd.randint(0, 20) + w + ["y"] * rnd.randint(0, 20))))
    got = sorted((r.doc_id, tuple(sorted(set(r.labels.split(",")) - set(r.base_labels.split(",")) - {""})), r.base_labels, round(r.score, 9)) for r in op6_license.scan(cases.documents(spark, docs)).collect())
    want = []
    for d, t in docs:
        labels, score = plain_labels(t)
        base = {x for p, x in license_texts.PHRASES if p in " ".join(re.findall("[0-9a-z]+", t.lower()))}
        want.append((d, tuple(sorted(labels - base)), ",".join(sorted(base)), round(score, 9)))
    assert got == sorted(want)
    assert sum(x[3] > 0 for x in want) > 15 and any(x[3] > 0 for x in want[::4])


def test_scattered_words_are_no_licence(spark):
    from fieldloom.llm import license_texts

    w = license_texts.TEMPLATES[3][1].split()
    scattered = " ".join(" ".join(w[i : i + 6]) + " four foreign words here" for i in range(0, len(w), 6))
    assert [r.score for r in op6_license.scan(cases.documents(spark, [(1, scattered)])).collect()] == [0.0]


def test_a_very_long_text_takes_linear_time(spark):
    import time

    from fieldloom.llm import license_texts

    rnd = random.Random(9)
    w = [x for _, t in license_texts.TEMPLATES for x in t.split()]
    text = " ".join(" ".join(w[a : a + rnd.randint(3, 9)]) for a in (rnd.randrange(len(w) - 9) for _ in range(45_000)))
    start = time.perf_counter()
    got = op6_license.scan(cases.documents(spark, [(1, text + " " + license_texts.TEMPLATES[3][1])])).collect()
    assert got[0].n_words > 250_000 and "mit" in got[0].labels and time.perf_counter() - start < 60


# --- packing ----------------------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = cases.noisy(4, 40) + [(900, "a<|endoftext|>b"), (901, " " * 3000 + "x"), (902, "word " * 6000)]
    docs = cases.documents(spark, rows).withColumn("start", F.lit(0)).repartition(3).cache()
    got = op7_packing.pack(docs).collect()
    tok = Tokenizer.from_file(op7_packing.default_tokenizer())
    ids = {}
    for d, t in rows:
        ids[d, t] = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = used = 0
    for pieces in sequences.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= 1024
        used += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert used == sum(len(ids[d, t]) for d, t in rows)
    assert padding <= 0.02 * used
    seen: dict = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r)
    whole: dict = {}  # of an id that several rows have: the pieces of all of them
    for d, t in rows:
        at = 0
        if [x for x, _ in rows].count(d) > 1:
            whole.setdefault(d, []).append(ids[d, t])
            continue
        for r in sorted(seen[d], key=lambda r: r.start):
            part = ids[d, t][at : at + r.length]
            assert r.start == at and r.doc_tokens == len(ids[d, t]) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids[d, t])
    for d, texts in whole.items():
        pieces = [(r.start, r.length, r.doc_tokens, r.ids_crc32) for r in seen[d]]
        for all_ids in texts:  # each text's ids are there from its first on, one piece after another
            at = 0
            while at < len(all_ids):
                fit = [p for p in pieces if p[0] == at and p[2] == len(all_ids) and p[3] == zlib.crc32(all_ids[at : at + p[1]].tobytes())]
                assert fit
                pieces.remove(fit[0])
                at += fit[0][1]
        assert not pieces
    assert op7_packing.pack(cases.documents(spark, [])).collect() == []


# --- languages --------------------------------------------------------------------------------------------------

SAID = {
    "en": "the river runs through the old town and the people walk along its banks in the evening",
    "de": "der fluss fließt durch die alte stadt und die leute gehen am abend an seinen ufern entlang",
    "fr": "la rivière traverse la vieille ville et les gens se promènent le soir le long de ses rives",
}


def langs(seed=0, n=240):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SAID))
        text = " ".join(rnd.choice(SAID[lang].split()) for _ in range(40))
        out.append((i, text, lang, "h%d.%s" % (i % 5, {"en": "com", "de": "de", "fr": "fr"}[lang]), len(text)))
    return out


def test_languages_held_out(spark):
    rows = langs()
    wrong = [(1000 + i, t, "de" if x != "de" else "fr", s, n) for i, (_, t, x, s, n) in enumerate(langs(1, 40))]
    truth = {1000 + i: x for i, (_, _, x, _, _) in enumerate(langs(1, 40))}
    got = {r.id: r for r in op9_langid.posteriors(op9_langid.from_documents(cases.documents(spark, rows + wrong)), 120).collect()}
    assert sum(got[i].language == x for i, _, x, _, _ in rows) >= 0.98 * len(rows)
    assert sum(got[i].language == x for i, x in truth.items()) >= 0.9 * len(truth)  # the text outweighs a wrong declaration
    assert all(r.kept and 0 < r.posterior <= 1 for r in got.values())


def plain_posteriors(rows):
    """The stated formulas by hand.  rows: (id, text, declared, host, suffix), all of them labelled ones are sampled."""
    import math
    from collections import Counter, defaultdict

    def grams(text):
        kind = [b - 96 if 97 <= b <= 122 else 27 + (b & 63) if b >= 128 else 0 for b in (text or "").translate(cases.LOWER).encode()]
        padded = [0, *kind, 0]
        return [tuple(padded[i : i + 3]) for i in range(len(kind)) if kind[i]]

    names = sorted({d for _, _, d, _, _ in rows if d})
    counts = {x: Counter() for x in names}
    for _, text, declared, _, _ in rows:
        if declared:
            counts[declared].update(grams(text))
    a, kinds, und = 0.05, 91**3, -3 * math.log(27)
    held = {x: sum(c.values()) for x, c in counts.items()}
    sound = {x for x in names if sum(n * math.log((n - 1 + a) / (held[x] - 1 + a * kinds)) for n in counts[x].values()) > und * held[x]}
    ll = [[sum(math.log((counts[x][g] + a) / (held[x] + a * kinds)) for g in grams(t)) for x in names] + [und * len(grams(t))] for _, t, *_ in rows]
    soft = []
    for scores in ll:
        e = [math.exp((s - max(scores[:-1])) * 0.25) for s in scores[:-1]]
        soft.append([x / sum(e) for x in e])
    k = len(names)
    total = lambda where: [sum(p[i] for p, r in zip(soft, rows, strict=True) if where(r)) for i in range(k)]
    globe = [x + 1 for x in total(lambda r: True)]
    globe = [x / sum(globe) for x in globe]
    by = lambda c: {v: total(lambda r: r[c] == v) for v in {r[c] for r in rows if r[c] is not None}}
    by_declared, by_suffix = by(2), by(4)
    per_language = [sum(v[i] for v in by_declared.values()) for i in range(k)]
    by_host = {v: total(lambda r: (r[3], r[4]) == v) for v in {(r[3], r[4]) for r in rows if r[3] is not None}}
    smooth = lambda s, up: [(s[i] + 20 * up[i]) / (sum(s) + 20) for i in range(k)]
    out = []
    for (doc, _, declared, host, suffix), scores in zip(rows, ll, strict=True):
        log_declared = [math.log((by_declared[declared][i] + 0.5) / (per_language[i] + 0.5 * len(by_declared))) for i in range(k)] if declared is not None else [0.0] * k
        prior = globe
        if host is not None:
            prior = smooth(by_host[host, suffix], smooth(by_suffix[suffix], globe) if suffix is not None else globe)
        lp = [scores[i] * 0.25 + log_declared[i] + math.log(prior[i]) for i in range(k)]
        lp.append(scores[k] * 0.25 + max(log_declared) + math.log(1e-6) if declared is None or declared == "" or declared in sound else -math.inf)
        best = max(range(k + 1), key=lambda i: (lp[i], -i))
        out.append((doc, declared, [*names, "und"][best], round(1 / sum(math.exp(x - lp[best]) for x in lp), 3), best < k))
    return sorted(out, key=repr)


def test_posteriors_against_plain(spark):
    rnd = random.Random(6)
    rows = [(i, t, rnd.choice([x, x, x, "de", None, ""]), None if i % 7 == 0 else s, n) for i, t, x, s, n in langs(4, 90)]
    rows += [(500 + i, "".join(rnd.choice("bcdfghjklmnpqrstvwxz ") for _ in range(rnd.randint(0, 300))), rnd.choice(["en", "xx", None]), "h1.com", 0) for i in range(25)]
    rows += [(600, None, "fr", "h9", 0), (601, "", None, None, 0), (602, "12 !", "de", "odd.fr", 0), (None, SAID["de"], None, "h2.de", 0), (602, SAID["fr"], "de", None, 0), (603, "the old town " * 20_000, None, "h2.de", 0)]
    docs = op9_langid.from_documents(cases.documents(spark, rows).repartition(5))
    got = sorted(((r.id, r.declared, r.language, round(r.posterior, 3), r.kept) for r in op9_langid.posteriors(docs).collect()), key=repr)
    want = plain_posteriors([tuple(r) for r in docs.select("id", "text", "declared", "host", "suffix").collect()])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[4] == w[4] and abs(g[3] - w[3]) <= 0.002, (g, w)
    assert {r[2] for r in want} > {"en", "und"}
    assert op9_langid.langid_pages is not None


def test_no_pages_have_no_language(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert op9_langid.posteriors(op9_langid.from_pages(none)).collect() == []


def test_pipeline_of_nothing(spark, tmp_path):
    """Empty tables, nulls in all columns, repeated rows and clashing columns go through all stages."""
    nothing = cases.documents(spark, [])
    nothing.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).collect() == []
    rows = [(None, None, None, None, None), (1, SAID["en"], "en", None, 5), (1, SAID["en"], "en", None, 5), (None, SAID["en"], None, "s", None), (2, "", "en", "s", 0)]
    docs = cases.documents(spark, rows)
    for c in ("id", "key", "print", "cls", "ranges", "drop", "maybe"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    docs.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "b")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.doc_id for r in got} == {None, 1, 2} and all(r.n >= (2 if r.doc_id in (None, 1) else 1) for r in got)


def test_rejection_and_missing_evidence(spark):
    rnd = random.Random(5)
    junk = ["".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(400)) for _ in range(4)]
    rows = [*langs(), *((2000 + i, t, "en", "h0.com", 400) for i, t in enumerate(junk)), (3000, None, None, None, None), (3001, "12 34 !!", "fr", None, 8), (3002, "", "de", "h1.de", 0), (None, SAID["en"], None, None, 9)]
    docs = cases.documents(spark, rows).withColumn("id", F.lit("clash"))
    got = {r.id: r for r in op9_langid.posteriors(op9_langid.from_documents(docs)).collect()}
    assert not any(got[2000 + i].kept for i in range(4))
    assert got[3001].language == "fr" and got[3002].language == "de" and got[3000].kept
    kept = op9_langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {2000, 2001, 2002, 2003}
    assert op9_langid.posteriors(op9_langid.from_documents(cases.documents(spark, []))).collect() == []


def test_rare_languages(spark):
    """One row in thousands, in a script no other row has: it is that language, and the table's other rows don't matter."""
    russian = "река течёт через старый город и люди вечером гуляют по её берегам пока не стемнеет"
    rows = [*langs(0, 2500), (9000, " ".join([russian] * 4), "ru", "h0.com", 400), (9001, "γη " * 300, "el", None, 900)]
    got = {r.id: r for r in op9_langid.posteriors(op9_langid.from_documents(cases.documents(spark, rows)), 300).collect()}
    assert got[9000].language == "ru" and got[9000].kept and got[9001].language == "el" and got[9001].kept
    assert {9000, 9001} <= {r.doc_id for r in op9_langid.keep_known(cases.documents(spark, rows), 300).collect()}


def test_more_languages_than_the_table_holds(spark, monkeypatch):
    rows = langs() + [(5000 + 10 * i + j, " ".join(["".join(chr(0x400 + 8 * i + (j * 7 + m * m) % 8) for m in range(5))] * 30), "x%d" % i, None, 180) for i in range(12) for j in range(4)]
    docs = op9_langid.from_documents(cases.documents(spark, rows))
    whole = {r.id: (r.language, r.kept, round(r.posterior, 4)) for r in op9_langid.posteriors(docs).collect()}
    monkeypatch.setattr(op9_langid, "DENSE", 2)
    assert {r.id: (r.language, r.kept, round(r.posterior, 4)) for r in op9_langid.posteriors(docs).collect()} == whole
    assert all(kept for _, kept, _ in whole.values()) and {x for i, (x, _, _) in whole.items() if i >= 5000} == {"x%d" % i for i in range(12)}


def test_page_evidence(spark):
    rows = [(i, f"https://w{i % 3}.example.{s.rsplit('.')[-1]}/p?q", f"<HTML class='a' lang='{x}-X'><script>var the = 1</script><p>{t}</p><!-- {SAID['en']} --></html>") for i, t, x, s, _ in langs(2, 90)]
    rows += [(500, None, None), (501, "no address", "<html><p>" + SAID["de"])]
    ev = {r.id: r for r in op9_langid.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert ev[0].declared in SAID and ev[0].suffix in ("com", "de", "fr") and "var" not in ev[0].text and "<" not in ev[0].text
    assert ev[500].declared is None and ev[501].host is None
    got = {r.id: r.language for r in op9_langid.posteriors(op9_langid.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got[501] == "de"


# --- pipeline and guard -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    items, leaky = benchmark_and_documents()
    rows = [(i, t, "en", "s%d" % (i % 3), len(t)) for i, t, *_ in langs(3, 60)]
    rows += [(i + 1000, t, "en", "s0", None if t is None else len(t)) for i, t in cases.noisy(3, 20) if i is not None]
    rows += [(5000 + d, t, "en", "s1", len(t)) for d, t in leaky if d is not None and 100 <= d <= 119]
    cases.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    ids = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = state.keep(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        if name == "line_dedup":
            before = [(r.doc_id, r.text) for r in docs.collect()]
            want = {d: x[3] for (d, _), x in zip(before, cases.lines_result(before), strict=True)}
            got = {r.doc_id: cases.sha((r.text or "").encode()) for r in out.collect()}
            assert got.items() <= want.items()
            gone = {d: x for (d, _), x in zip(before, cases.lines_result(before), strict=True) if d not in got}
            blank = {cases.sha(b"\n" * k) for k in range(400)}
            assert gone and all(x[2] > 0 and x[3] in blank for x in gone.values())
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
        if name == "near_dedup":
            before = [(r.doc_id, r.text) for r in docs.collect()]
            assert {r.doc_id for r in out.collect()} == {x[0] for x in cases.near_result(before) if x[3]}
        docs = out
        ids.append({r.doc_id for r in docs.collect()})
    assert ids[0] > ids[2] and ids[1] >= ids[2] >= ids[3] >= ids[4] and ids[3] - ids[4] == {d for d in ids[3] if d >= 5100 and d < 5120}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[4]


def test_entry_without_the_subpackage(tmp_path):
    """The registry must import where this subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "fieldloom", tmp_path / "fieldloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'slv_brute' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
