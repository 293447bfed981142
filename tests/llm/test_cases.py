"""Hard cases of single operators: bounds, skew, repeated rows, null ids, clashing names, empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import decontamination, jaccard_join, license_scan, line_dedup, mixing, quality, sharding, token_output, toxicity, warc
from runlens.llm.common import written
from runlens.llm.queries import tokenizer_path

from .test_operators import ROWS, SCHEMA, brute_base, brute_components, docs, empty, labels, odd, words  # noqa: F401

TEXT = "doc_id long, text string"


# 1. Token output


def test_token_lookup_reads_few_files(spark, docs, tmp_path):  # noqa: F811
    path = token_output.write_tokens(docs, tokenizer_path(), str(tmp_path / "tokens"))
    rows = token_output.directory(spark, path).orderBy("start").collect()
    assert rows[0].start == 0 and all(a.end == b.start for a, b in zip(rows, rows[1:]))
    plan = spark.read.schema(token_output.SEGMENT_SCHEMA).parquet(path).where("part = 1 and seg = 0").select("data")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(part), IsNotNull(seg), EqualTo(part,1), EqualTo(seg,0)]" in plan
    assert token_output.token_at(spark, path, []) == {}


def test_long_pieces_are_not_kept():
    coder = token_output.PieceEncoder(tokenizer_path())
    coder.encode(["a" * 5000 + " " + "b1" * 3000 + " short\n" + "é" * 700 + "!" * 900])
    assert max(map(len, [*coder.first, *coder.later, *coder.parts])) <= token_output.PIECE_CHARS
    assert coder.first.held + coder.later.held < 2000


# 3. Toxicity


def test_forward_matches_one_text_at_a_time():
    net, rng = toxicity.Network(), random.Random(1)
    texts = [toxicity.features(" ".join(rng.choice(["vile", "tree", "sky", "worst"]) for _ in range(n))) for n in (0, 1, 2, 3, 40, 0)]
    best, where, _ = net.forward(texts)
    start = 0
    for k, x in enumerate(texts):
        want, at = net.pooled(x)
        assert np.allclose(best[k], want, atol=1e-5)
        assert ((where[k] >= 0) == (at >= 0)).all()
        for c in np.flatnonzero(at >= 0):  # of windows with the same words either will do
            w, mine = toxicity.WIDTHS[c // toxicity.FILTERS], where[k][c] - start
            assert (x[mine : mine + w] == x[at[c] : at[c] + w]).all()
        start += len(x)


def test_gradients_match_finite_differences():
    net, rng = toxicity.Network(3), random.Random(4)
    texts = [toxicity.features(" ".join(rng.choice(["vile", "tree", "sky", "worst", "of"]) for _ in range(n))) for n in (0, 2, 7, 30)]
    y, weights = np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])
    for name in ("table", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters, net.bias = [f.astype(np.float64) for f in net.filters], [b.astype(np.float64) for b in net.bias]

    def loss():
        p = 1 / (1 + np.exp(-(net.forward(texts)[0].astype(np.float64) @ net.out + net.out_bias[0])))
        return float((weights * -np.where(y == 1, np.log(p), np.log(1 - p))).mean())

    dense, used, rows = net.gradients(texts, y, weights)
    checks = [(p, np.asarray(g), np.unravel_index(int(np.abs(g).argmax()), np.shape(g))) for p, g in zip([*net.filters, *net.bias, net.out, net.out_bias], dense)]
    row, column = np.unravel_index(int(np.abs(rows).argmax()), rows.shape)
    grad_table = np.zeros_like(net.table)
    grad_table[used] = rows
    checks.append((net.table, grad_table, (used[row], column)))
    for p, g, at in checks:
        held = p[at]
        p[at] = held + 1e-3
        up = loss()
        p[at] = held - 1e-3
        down = loss()
        p[at] = held
        assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.03, abs=2e-4)


def test_calibrate():
    scores, y = np.array([0.9, 0.8, 0.7, 0.2, 0.1]), np.array([1, 1, 0, 0, 0])
    assert toxicity.calibrate(scores, y, np.ones(5)) == pytest.approx(0.75)
    assert toxicity.calibrate(scores, y, np.ones(5), 0.3) == pytest.approx((2 * 0.75 + 10 * 0.3) / 12)
    assert toxicity.calibrate(scores, 0 * y, np.ones(5)) == toxicity.THRESHOLD and toxicity.calibrate(scores, 0 * y, np.ones(5), 0.6) == 0.6
    assert toxicity.calibrate(np.array([]), np.array([]), np.array([]), 0.4) == 0.4


def test_training_bytes_are_bounded():
    rows = [(c, k, k, 0, 40, 1.0) for c in (0, 1) for k in range(10)] + [(1, -1, 99, 0, 1000, 1.0)]
    got = toxicity.within(rows, 100)
    assert [r[2] for r in got if r[0] == 0] == [0, 1] and [r[2] for r in got if r[0] == 1] == [99]


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """Beyond the rows of one shard, and with repeated rows: each label trains once an epoch, or is set aside."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1000)
    n = 12_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat(if(id % 2 = 0, 'vile ', 'tree '), id) AS text", "'en' AS lang")
    marks = spark.range(n).selectExpr("id AS doc_id", "cast(id % 2 = 0 AS int) AS toxic")
    rows = toxicity.training_rows(docs.union(docs.where("doc_id < 50")), marks.union(marks.where("doc_id > 900")))
    assert rows.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(n))
    assert rows.select("shard").distinct().count() == -(-rows.count() // 1000) and rows.where("aside").count() > rows.count() / 6
    few = rows.where("not aside and shard < 2").limit(600).select("shard", "toxic", "data")
    got = toxicity.trained(few, few.count(), few.where("toxic = 1").count()).compact()
    assert toxicity.score(got, toxicity.features("vile 3")) > 0.9 and toxicity.score(got, toxicity.features("tree 4")) < 0.1


def test_states_of_shards_move_every_second_epoch(spark, monkeypatch):
    """Every epoch trains once, in order, and what moves between shards is half as many states as epochs."""
    monkeypatch.setattr(toxicity, "MIN_STEPS", 0)
    data = [zlib.compress(toxicity.features(t).astype(np.int16).tobytes(), 1) for t in ("tree house", "vile house")]
    rows = spark.createDataFrame([(k % 2, k // 2 % 2, data[k // 2 % 2]) for k in range(400)], "shard int, toxic int, data binary")
    rounds, plain = [], toxicity._trainer
    monkeypatch.setattr(toxicity, "_trainer", lambda shared: rounds.append(list(shared.value[1])) or plain(shared))
    got = toxicity.trained(rows, 400, 200).compact()
    assert sum(rounds, []) == list(range(toxicity.EPOCHS)) and len(rounds) == toxicity.EPOCHS / 2
    assert toxicity.score(got, toxicity.features("vile house")) > 0.5 > toxicity.score(got, toxicity.features("tree house"))


def test_kept_words_have_their_own_buckets(monkeypatch):
    """Also where a text has several blocks and its words push one another out."""
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 40)
    monkeypatch.setattr(toxicity, "MEMO_WORDS", 64)
    monkeypatch.setattr(toxicity, "_places", toxicity._Places())
    rng, half = random.Random(3), toxicity.BUCKETS // 2
    letters = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    for n in (0, 1, 2, 39, 40, 41, 300, 5):
        found = [letters() for _ in range(n)]
        want = [[zlib.crc32(w.encode()) % half, *(half + zlib.crc32(b"%d" % k + w[:k].encode()) % half for k in (4, 5, 6, 7))] for w in found]
        assert toxicity.features(" ".join(found)).tolist() == want and len(toxicity._places) <= 64


def test_toxicity_with_one_class_or_no_labels(spark, docs):  # noqa: F811
    marks = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    usable = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20))
    for frame, want in ((marks, None), (marks.limit(0), 0.0), (marks.withColumn("toxic", F.lit(None).cast("int")), 0.0)):
        got = {r.score for r in toxicity.toxicity(docs, frame).collect()}
        assert len(got) == 1 and (got == {want} if want is not None else 0.5 + usable / 100 < got.pop() < 1)


# 4. Mixing


def test_repeated_rows_follow_the_plan(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(3, 9))), "en", rng.choice("abc"), 0) for i in range(40)] + [(900, "one two three", "en", "a", 0)] * 7 + [(None, "x y", None, None, 0)] * 5
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plan = mixing.mix(frame, whole_documents=True).collect()
    want, got = Counter(), Counter()
    for r in plan:
        want[r.source] += r.words
    for r in mixing.mixed_documents(frame).collect():
        got[r.source] += len(words(r.text))
    assert got == +want
    extra = frame.withColumn("_copy", F.lit(1)).withColumn("_doc", F.lit(1)).withColumn("_times", F.lit(1)).withColumn("source_size", F.lit("x"))
    assert mixing.mixed_documents(extra).count() == mixing.mixed_documents(frame).count() and mixing.mixed_documents(extra).columns == extra.columns


# 5. Sharding


def test_splitters_never_give_up_silently(spark, monkeypatch):
    rows = spark.range(4000).select(F.xxhash64("id").alias("h"), F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("size"))
    monkeypatch.setattr(sharding, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        sharding.splitters(rows, [(10_000, 0)])


def test_carried_columns_may_have_any_name(docs):  # noqa: F811
    frame = docs.withColumn("h", F.col("doc_id") + 1).withColumn("size", F.lit("s")).withColumn("task", F.lit(5)).withColumn("shard", F.lit("t"))
    got = sharding.shard_documents(frame, 4, columns=("h", "size", "task", "shard", "lang"))
    plain = {r.doc_id: r for r in sharding.shard_documents(docs, 4).collect()}
    for r in got.collect():
        assert (r.h, r.size_in, r.task, r.shard_in) == (r.doc_id + 1, "s", 5, "t") and r.shard == plain[r.doc_id].shard and r.slot == plain[r.doc_id].slot


# 2. Line dedup


def test_bitmaps_join_tables_with_any_columns(docs):  # noqa: F811
    frame = docs.withColumn("tkey", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("n_dropped", F.lit("y")).withColumn("keep_bitmap", F.lit("z"))
    got = {r.doc_id: r for r in line_dedup.with_bitmaps(frame, line_dedup.line_keep_bitmaps(frame)).collect()}
    assert set(got) == {r[0] for r in ROWS} and all(got[i].n_lines == (t or "").count("\n") + 1 and got[i].tkey == 1 for i, t, *_ in ROWS)


# 6. Decontamination


def contaminated(docs, table, **options):  # noqa: F811
    return sorted(tuple(r) for r in decontamination.contaminated(docs, table, **options).select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("item_id", F.lit(-1)), "piece", "score", "first_word", "last_word").collect())


def test_blocks_and_repeated_items(spark):
    rng = random.Random(11)
    pool = [f"w{k}" for k in range(4000)]
    items = [[rng.choice(pool) for _ in range(rng.choice([15, 30, 60]))] for _ in range(60)]
    texts = [[rng.choice(pool) for _ in range(40)] + (items[i % 60] if i % 3 else []) + [rng.choice(pool) for _ in range(30)] for i in range(90)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(texts[1])), (1, " ".join(texts[1])), (500, None), (501, "")], TEXT).repartition(4)
    rows = [(i, " ".join(w)) for i, w in enumerate(items)] + [(None, " ".join(items[1]).upper()), (77, " ".join(items[1])), (77, " ".join(items[1])), (78, None), (79, "")]
    table = spark.createDataFrame(rows, "item_id long, text string")
    _, _, blocks = decontamination._entries(table, 2000)
    assert len(blocks) > 4
    one = contaminated(frame, table)
    assert contaminated(frame, table, block_bytes=2000) == one
    found = Counter((d, i) for d, i, *_ in one)
    assert found[1, 1] == 2 and found[-1, -1] == 1 and found[1, 77] == 4 and found[-1, 77] == 2
    number = defaultdict(lambda: len(number) + 1)
    code = lambda w: np.array([number[x] for x in w])
    for d, i, piece, score, first, last in one:
        if d >= 0 and 0 <= i < 60:
            best, a, b = decontamination.align(code(items[i]), code(texts[d]))
            assert (piece, score, first, last) == (0, best / (2 * len(items[i])), a, b)
    for options in ({}, {"block_bytes": 2000}):
        left = decontamination.decontaminated(frame.withColumn("tkey", F.lit(1)), table, **options)
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == sorted([i for i in range(90) if not any(k[0] == i for k in found)] + [500, 501])


def test_blocks_keep_their_bound(spark):
    big = " ".join(f"w{k}" for k in range(30_000))
    table = spark.createDataFrame([(i, big) for i in range(8)] + [(9, "x" * 100_000 + " y z"), (10, big + " end")], "item_id long, text string")
    pieces, owners, blocks = decontamination._entries(table, 60_000)
    sizes = [pieces.where(F.pmod("h", F.lit(n)).isin(some)).agg(F.sum(F.octet_length("words"))).first()[0] for n, some in blocks]
    assert max(sizes) <= 60_000 and owners.count() == 10 and pieces.agg(F.max(F.octet_length("words"))).first()[0] < 20_000
    part = " ".join(f"w{k}" for k in range(9000, 14_000))
    frame = spark.createDataFrame([(1, part), (2, "x" * 100_000 + " y z"), (3, "x" * 99_999 + " q r")], TEXT)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, table, block_bytes=60_000).collect()}
    assert got == {(1, i) for i in (*range(8), 10)} | {(2, 9)}


# 7. Quality


def test_repeat_words_are_exact_whatever_the_hash(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "ab", "é"]) for _ in range(n)) for n in (0, 1, 3, 4, 5, 9, 40, 200)] + ["a b c d", "a b c a b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), TEXT)
    for hash_of in (lambda x: F.xxhash64(x), lambda x: F.lit(7).cast("long"), lambda x: F.length(x).cast("long")):
        for r in rows.select("text", quality._repeat_words(F.regexp_extract_all("text", F.lit(quality.WORD_PATTERN), F.lit(0)), hash_of).alias("n")).collect():
            assert r.n == brute_base(r.text)["n_repeat_words"], r.text


def test_ratio_and_verdict_match_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "tree,", "is", "green!", "Été", "x_1", "%%", "a.b"]) + str(rng.choice(["", rng.randint(0, 99)])) for _ in range(rng.randint(0, 150))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    marks = spark.createDataFrame([(i, int(i < 25), 0) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")

    def buckets(text):
        signed = lambda n: n.to_bytes(8, "little")
        h = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in re.findall(r"\w+|[^\w\s]+", text.lower())]
        return [x % quality.BUCKETS for x in h + [xxhash.xxh64_intdigest(signed(b), seed=xxhash.xxh64_intdigest(signed(a), seed=42)) for a, b in zip(h, h[1:])]]

    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(buckets(t))
        target.update(buckets(t) if i < 25 else [])
    all_raw, all_target = raw.total() + quality.BUCKETS, target.total() + quality.BUCKETS
    for r in quality.quality(frame, marks).collect():
        found = buckets(texts[r.doc_id])
        want = sum(math.log((target[b] + 1) / all_target) - math.log((raw[b] + 1) / all_raw) for b in found) / len(found) if found else 0
        assert r.llr == pytest.approx(want, abs=2e-6)
        assert r.kept == (not brute_base(texts[r.doc_id])["base_failed"] and want >= quality.THRESHOLD)


# 8. Jaccard join


def test_components_of_stars_chains_and_rings(spark):
    edges = [(k, 0) for k in range(1, 300)] + [(400 + k, 401 + k) for k in range(30)] + [(500 + k, 500 + (k + 1) % 9) for k in range(9)] + [(299, 600), (7, 7)]
    want = {k: 0 for k in [*range(300), 600]} | {400 + k: 400 for k in range(31)} | {500 + k: 500 for k in range(9)}
    got = {r.node: r.component for r in jaccard_join.components(written(spark.createDataFrame(edges, "a long, b long"), "test")).collect()}
    assert got == want
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("alone", [jaccard_join.ALONE, 0], ids=["one task", "steps"])
def test_few_links_are_settled_by_one_table(spark, monkeypatch, alone):
    """Both ways agree with brute force; links that fit a task aren't written again and again."""
    monkeypatch.setattr(jaccard_join, "ALONE", alone)
    rng, tables = random.Random(6), []
    nodes = [rng.randint(-(1 << 62), 1 << 62) for _ in range(400)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(260)] + list(zip(nodes[:90], nodes[1:91]))
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: tables.append(name) or written(df, name))
    got = [(r.node, r.component) for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()]
    assert len(got) == len(root) and dict(got) == root
    assert len(tables) == 1 if alone else len(tables) > 5


def test_meetings_spread_a_frequent_token(spark):
    rng = random.Random(4)
    rows = [(rng.choice([5, 5, 5, rng.randint(0, 50)]), rng.randint(0, 400)) for _ in range(1500)]
    least = {}
    for t, leader in rows:
        least[t] = min(leader, least.get(t, leader))
    got = {(r.leader, r.pivot) for r in jaccard_join.meetings(spark.createDataFrame(rows, "token long, leader long")).collect()}
    assert got == {(leader, least[t]) for t, leader in rows if leader != least[t]}


def test_one_shared_passage_costs_no_pairs_of_its_documents(spark, monkeypatch):
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(30)]
    rows = [(i, " ".join(passage + [f"d{i}x{k}" for k in range(rng.randint(20, 60))]), "en", "a", 0) for i in range(150)]
    compared, plain = [], jaccard_join.overlaps
    monkeypatch.setattr(jaccard_join, "overlaps", lambda pairs, sets: compared.append(pairs.count()) or plain(pairs, sets))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows) and sum(compared) <= 2 * len(rows)


def test_a_doc_id_with_several_texts_links_both(spark):
    base = [f"w{k}" for k in range(100)]
    other = [f"v{k}" for k in range(100)]
    edit = lambda w, at: " ".join("zz" if k in at else x for k, x in enumerate(w))
    rows = [(1, " ".join(base)), (1, " ".join(other)), (2, edit(base, [50])), (3, edit(other, [50])), (4, edit(other, [10])), (5, "alone " * 9)]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_components(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_near_copies_that_their_pivot_does_not_link(spark, monkeypatch):
    rng, n = random.Random(8), 120
    base = [f"w{k}" for k in range(139)]
    edit = lambda words, k, word: [*words[:k], word, *words[k + 1 :]]
    pivot = edit(edit(edit(base, 40, "x40"), 80, "x80"), 120, "x120")
    # Passages that are frequent elsewhere stay out of the prefixes, so the pivot has all tokens by which the copies meet.
    common = [x[k - 4 : k + 5] for x in (base, pivot) for k in (40, 80, 120) for _ in range(2 * n)]
    rows = [(0, pivot), *((1 + k, edit(base, rng.randrange(10, 15), f"y{k}")) for k in range(n)), *((1000 + k, x) for k, x in enumerate(common))]
    compared, plain = [], jaccard_join.overlaps
    monkeypatch.setattr(jaccard_join, "overlaps", lambda pairs, sets: compared.append(pairs.count()) or plain(pairs, sets))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_components(spark.createDataFrame([(i, " ".join(x)) for i, x in rows], TEXT)).collect()}
    assert got[0] == 0 and {got[k] for k in range(1, n + 1)} == {1}
    assert sum(compared) < n * (n - 1) / 4


def test_one_of_each_takes_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(7, text), (7, text), (None, text), (3, text + " end"), (9, "short"), (9, "short"), (None, None), (None, None), (8, "")]
    left = jaccard_join.one_of_each(spark.createDataFrame(rows, TEXT).withColumn("row", F.lit(1)).withColumn("c", F.lit(2)))
    assert left.columns == ["doc_id", "text", "row", "c"]
    assert sorted((r.doc_id is None, r.doc_id, r.text or "") for r in left.collect() if r.doc_id is not None) == [(False, 3, text + " end"), (False, 8, ""), (False, 9, "short")]
    assert sum(r.doc_id is None for r in left.collect()) == 2  # rows without words link with nothing


# 9. License scan


def test_spread_notices_are_found():
    t, scanner, rng = license_scan.TEMPLATES, license_scan.Scanner(license_scan.TEMPLATES), random.Random(1)
    for name in ("MIT-text", "Apache-2.0-header", "BSD-3-Clause", "GPL-3.0-header", "LGPL-2.1-header", "MPL-2.0-header", "ISC-text"):
        for between in (1, 2, 3, 10):
            text = " ".join(y for w in t[name].split() for y in [w] + [f"q{rng.randint(0, 9999)}" for _ in range(between)])
            got = {hit[0]: hit[1] for hit in scanner.scan("before " + text + " after")}
            assert set(got) == {name} and got[name] >= 0.9, (name, between, got)
    w = t["Apache-2.0-header"].split()
    got = scanner.scan(" ".join(w[:30] + [f"q{k}" for k in range(200)] + w[30:]))
    assert [(x[0], x[1]) for x in got] == [("Apache-2.0-header", 1.0)]
    assert {x[0] for x in scanner.scan(t["GPL-3.0-header"].replace("GNU General", "GNU zz Lesser zz General"))} == {"LGPL-3.0-header"}


def test_edited_notices_are_found():
    t, scanner, rng = license_scan.TEMPLATES, license_scan.Scanner(license_scan.TEMPLATES), random.Random(7)
    names, found = ["MIT-text", "Apache-2.0-header", "BSD-2-Clause", "GPL-2.0-header", "AGPL-3.0-header", "MPL-2.0-text", "Zlib-text"], 0
    for name in names:
        words_ = t[name].split()
        keep = {k for k, w in enumerate(words_) if set(license_scan.word_list(w)) & {x for any_of in license_scan.IDENTITY.get(name, ()) for y in any_of for x in license_scan.word_list(y)}}
        text = " ".join(w if k in keep or rng.random() > 0.1 else "edited" for k, w in enumerate(words_))
        found += name in {hit[0] for hit in scanner.scan("lorem " * 300 + text + " ipsum" * 300)}
    assert found == len(names)


def test_license_rows(spark):
    t = license_scan.TEMPLATES
    rows = [(None, t["MIT"]), (1, t["MIT"]), (1, t["MIT"]), (2, t["MIT"] + " x " * 50 + t["MIT"]), (3, "word " * 200_000 + t["GPL-3.0"])]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.license, r.first_word) for r in license_scan.license_scan(spark.createDataFrame(rows, TEXT).withColumn("license", F.lit("x"))).collect()))
    assert got == [(False, 1, "MIT", 0), (False, 1, "MIT", 0), (False, 2, "MIT", 0), (False, 3, "GPL-3.0", 200_000), (True, 0, "MIT", 0)]


# 10. WARC


def test_warc_cases(spark):
    long = "é" * 3_000_000
    rows = [(None, "u", "a"), (None, "u", "a"), (1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (3, None, long), (4, "v", long), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for part in ("digest", "bytes", "check", "response", "refers_to", "value"):
        pages = pages.withColumn(part, F.lit("x"))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, warc.write_archives(pages)).collect())
    assert got == {(None, 1, "revisit", 2): 2, (1, 1, "revisit", 2): 1, (2, 1, "response", None): 2, (3, 6_000_000, "revisit", 4): 1, (4, 6_000_000, "response", None): 1, (None, 0, "response", None): 1}


def test_equal_digests_of_unequal_payloads_stay_apart(spark):
    digest = base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    rows = [(1, digest, 5, 11), (2, digest, 5, 12), (3, digest, 6, 11), (4, digest, 5, 11)]
    got = {r.page_id: r.refers_to for r in warc.resolve(spark.createDataFrame(rows, "page_id long, digest string, bytes long, check long")).collect()}
    assert got == {1: 4, 2: None, 3: None, 4: None}


# Repeated rows and null ids have the values of their plain rows


def test_odd_rows_have_the_values_of_their_texts(odd, docs, labels):  # noqa: F811
    def values(df, drop):
        out = defaultdict(list)
        for r in df.collect():
            out[r.doc_id].append(tuple(v for k, v in r.asDict().items() if k not in drop))
        return out

    for run, drop in ((lambda d: quality.quality(d, labels), {"doc_id", "llr", "kept"}), (line_dedup.line_dedup_digest, {"doc_id"}), (lambda d: sharding.shard_documents(d).select("doc_id", "size", "text_crc32"), {"doc_id"})):
        plain, got = values(docs, ()) and values(run(docs), drop), values(run(odd), drop)
        assert got[None] == plain[3] and all(got[i] == plain[i] * (2 if i < 9 else 1) for i in plain)
    scores = values(toxicity.toxicity(odd, labels), {"doc_id", "held_out"})
    assert scores[None] == scores[3][:1] and all(len(set(v)) == 1 for v in scores.values())


def test_pipeline_stages_take_empty_and_odd_tables(spark, empty, odd, tmp_path):  # noqa: F811
    spark.createDataFrame([(0, " ".join((ROWS[9][1] or "").split()[:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame, some in ((empty, False), (odd, True)):
        rows = frame
        for name, stage in corpus_pipeline.STAGES:
            before, rows = rows.columns, written(stage(spark, rows, str(tmp_path)), "test")
            assert (rows.count() > 0) == some, name
            assert rows.columns == before or name == corpus_pipeline.STAGES[-1][0]
