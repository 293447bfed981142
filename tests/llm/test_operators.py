"""The corpus operators against brute force, on a fixture of hard cases."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import dac, decontamination, jaccard_join, license_scan, line_dedup, mixing, quality, sharding, token_output, toxicity, warc
from runlens.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "h long, size long, n long, rep long, token long, start long, words long, bucket int, position double, kept boolean, llr double, tkey long, component_id long, task int, pass int"
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fixture_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "ko", "Ri", "é", "tz"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() + rng.choice(["", "", ".", ",\n"]) for _ in range(n))
    base = [text(rng.randint(1, 120)) for _ in range(60)]
    near = [" ".join(w if k != j else "edit" for k, w in enumerate(base[5].split(" "))) for j in range(0, len(base[5].split(" ")), 9)]
    special = [None, "", " ", "one", "a  b   c", "x\n\ny\n", "\x1c b c", "Same Line\n" * 30, "ba ko " * 400, text(20_000), "trailing ", "<|endoftext|> x"]
    texts = base + near + base[:5] * 3 + special + ["common line\n" + t for t in base[20:40]]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows


ROWS = fixture_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(docs):
    """The documents with repeated rows, a null doc_id, and extra columns whose names operators use inside."""
    out = docs.union(docs.where("doc_id < 9")).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    for part in CLASH.split(", "):
        name, kind = part.split(" ")
        out = out.withColumn(name, F.lit(None).cast(kind))
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2 if i % 7 else None, int("ko" in (r[1] or "")[:40]) if i % 11 else None) for i, r in enumerate(ROWS)] + [(None, 1, 1), (10**9, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, " ".join((ROWS[9][1] or "").split()[:30])), (1, None), (2, ""), (3, "two words")], "item_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


# 1. Token output


def test_dac_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice([0, 3, 255, 256, 65535, 65536, 1 << 30], n).astype(np.uint32)
        segment = dac.Segment(dac.pack([1, None], [n // 2, n], ids))
        assert (segment.tokens() == ids).all() and segment.doc_ids == [1, None]
        assert all(segment.token(i) == ids[i] for i in range(0, n, 7))
        with pytest.raises(IndexError):
            segment.token(n)


def test_tokens_match_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    path = token_output.write_tokens(docs, tokenizer_path())
    got, start, flat = by_id(token_output.read_documents(spark, path)), 0, []
    for r in ROWS:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [0]
        flat += ids
        data = np.array(ids, "<u4").tobytes()
        assert (got[r[0]].start, got[r[0]].n_tokens, got[r[0]].ids_crc32) == (start, len(ids), zlib.crc32(data))
        start += len(ids)
    some = [0, 17, len(flat) // 2, len(flat) - 1]
    assert token_output.token_at(spark, path, some + [len(flat)]) == {k: flat[k] for k in some}


def test_pieces_encode_as_whole_texts():
    coder, rng = token_output.encoder(tokenizer_path()), random.Random(5)
    parts = ["a", "Word", "été", "ß", "12", "1a", "'s", "don't", ".", "_!", " ", "  ", "\n", "\n\n", "\t", "\r\n", "日本", "🙂", " ", "<|endoftext|>", "ª"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        want = np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert coder.encode([text])[0] == want, repr(text)


# 2. Line dedup


def line_key(line):
    return line.strip(SPACES).translate(LOWER)


def brute_lines(rows, min_docs, first):
    seen = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            seen[line_key(line)].add(i)
    taken, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        keep = []
        for line in (t or "").split("\n"):
            key = line_key(line)
            drop = bool(key) and len(seen[key]) >= min_docs
            if drop and first and key not in taken:
                taken.add(key)
                drop = False
            keep.append(not drop)
        out[i] = keep
    return out


@pytest.mark.parametrize("keep,min_docs", [("none", 10), ("none", 2), ("first", 2), ("first", 1)])
def test_line_bitmaps(docs, keep, min_docs):
    want = brute_lines(ROWS, min_docs, keep == "first")
    for r in line_dedup.line_keep_bitmaps(docs, min_docs=min_docs, keep=keep).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8), count=r.n_lines, bitorder="little").astype(bool).tolist()
        assert bits == want[r.doc_id], r.doc_id


def test_line_digest(docs):
    want, got = brute_lines(ROWS, 10, False), by_id(line_dedup.line_dedup_digest(docs))
    assert sum(r.n_dropped for r in got.values()) >= 20
    for i, t, *_ in ROWS:
        kept = "\n".join(x for x, k in zip((t or "").split("\n"), want[i]) if k)
        assert (got[i].n_lines, got[i].kept_sha256) == (len(want[i]), hashlib.sha256(kept.encode()).hexdigest())


# 3. Toxicity


def test_toxicity_learns_and_ignores_other_columns(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(["vilest" + rng.choice("abc") if bad and k == 5 else rng.choice(["the", "of", "and", "tree", "house", "sky"]) for k in range(12)])
        rows.append((i, text, rng.choice(["en", "fr"]), "s", len(text)))
    frame = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(frame, marks))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(400))
    right = sum(got[i].predicted == (i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    moved = by_id(toxicity.toxicity(frame.withColumn("source", F.lit("x")).withColumn("lang", F.lit(None).cast("string")), marks))
    assert all(abs(moved[i].score - got[i].score) < 1e-6 for i in got)


def test_compact_network_scores_alike():
    net = toxicity.Network()
    x = toxicity.features("some words and more words that are scored")
    assert abs(toxicity.score(net.compact(), x) - net.probability(x)) < 1e-5
    assert toxicity.score(net.compact(), toxicity.features(None)) == pytest.approx(0.5)


# 4. Mixing


def brute_targets(size):
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight, total = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(size.values())
    free, out = set(order), {}
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        out |= {s: 3 * size[s] for s in over} if over else share
        free -= set(over) if over else free
    return out


def test_mixing(docs):
    size = Counter()
    for r in ROWS:
        size[r[3]] += len(words(r[1]))
    target, got, taken = brute_targets(size), by_id(mixing.mix_totals(mixing.mix(docs))), Counter()
    for r in ROWS:
        x = got[r[0]]
        assert x.size == len(words(r[1])) and 0 <= x.taken <= 3 * x.size and x.source_size == size[r[3]]
        assert x.target == pytest.approx(target[r[3]])
        taken[r[3]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, by_id(mixing.mix_totals(mixing.mix(docs))).values()))


def test_positions_are_sorted_and_follow_schedules(docs):
    rows = [r for r in mixing.mix(docs).collect() if r.position is not None]
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1


def test_position_inverts_the_integral(spark):
    knots = ((0.0, 2.0), (0.25, 0.0), (0.5, 0.0), (1.0, 3.0))
    at = spark.range(0, 101).select((F.col("id") / 100).alias("share")).withColumn("t", mixing.position(F.col("share"), F.lit(0), (knots,))).collect()
    area = lambda t: sum((min(t, b) - a) * (wa + wa + (wb - wa) * (min(t, b) - a) / (b - a)) / 2 for (a, wa), (b, wb) in zip(knots, knots[1:]) if t > a)
    assert all(abs(area(r.t) / area(1.0) - r.share) < 1e-9 for r in at)


# 5. Sharding


def test_sharding(docs):
    got, slots, total = by_id(sharding.shard_documents(docs, 4)), defaultdict(list), Counter()
    for r in ROWS:
        data, x = (r[1] or "").encode(), got[r[0]]
        assert (x.size, x.text_crc32) == (len(data) + 1, zlib.crc32(data))
        slots[x.shard].append(x.slot)
        total[x.shard] += x.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    longest = max(len((r[1] or "").encode()) for r in ROWS)
    assert max(total.values()) <= sum(total.values()) / 4 + longest


def test_splitters_are_exact_inside_a_hot_group(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 5).otherwise(F.xxhash64("id")).alias("h"), F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("size"))
    keys = sharding.splitters(rows, [(10_000, 0), (20_000, 0), (30_000, 0)])
    bins = sharding.histogram(rows, keys)
    assert [b[0] for b in bins] == [10_000] * 4


# 6. Decontamination


def test_decontamination(spark, docs, benchmark):
    item = " ".join((ROWS[9][1] or "").split()[:30])
    edited = item.split()
    edited[7] = edited[19] = "zzz"
    more = spark.createDataFrame([(900, "before " * 50 + " ".join(edited) + " after" * 50, "en", "a", 0), (901, " ".join(item.split()[:4]) + " q w e r t y" * 9, "en", "a", 0)], SCHEMA)
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs.union(more), benchmark).collect()}
    assert (9, 0) in got and (900, 0) in got and (901, 0) not in got
    assert got[900, 0].first_word == 50 and got[900, 0].score > 0.8
    left = {r.doc_id for r in decontamination.decontaminated(docs.union(more), benchmark).collect()}
    assert left == ({r[0] for r in ROWS} | {900, 901}) - {d for d, _ in got}


def test_decontamination_finds_every_pair_over_the_score(spark):
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(300)]
    items = [[rng.choice(pool) for _ in range(n)] for n in (3, 4, 5, 15, 24, 33, 40, 59)]
    edits = [lambda w, every=every: [f"new{k}" if k % every == every - 1 else x for k, x in enumerate(w)] for every in (3, 4, 5)]
    edits += [lambda w, every=every: [x for k, x in enumerate(w) if k % every != every - 1] for every in (3, 4)]
    edits += [lambda w: [y for k, x in enumerate(w) for y in (x, f"new{k}")], lambda w: [x if rng.random() < 0.7 else "new" for x in w]]
    texts = [[rng.choice(pool) for _ in range(60)] + edit(item) + [rng.choice(pool) for _ in range(60)] for item in items for edit in edits]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    number = defaultdict(lambda: len(number) + 1)
    coded = [np.array([number[w] for w in t]) for t in items + texts]
    want = {(d, i): s / (2 * len(items[i])) for d, t in enumerate(coded[len(items) :]) for i, w in enumerate(coded[: len(items)]) if (s := decontamination.align(w, t)[0]) >= len(w)}
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, table).collect()}
    assert got == want and all((7 * i + e, i) in got for i in range(3, 8) for e in (0, 1, 2, 3, 4, 5))


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(1, 5, 7), rng.integers(1, 5, 11)
        table = np.zeros((8, 12), int)
        for i in range(1, 8):
            for j in range(1, 12):
                table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
        assert decontamination.align(a, b)[0] == table.max()


# 7. Quality


def brute_base(text):
    found, out = words(text), {}
    n = len(found)
    windows = Counter(tuple(found[i : i + 3]) for i in range(n - 2))
    covered = {k for i in range(n - 2) if windows[tuple(found[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    out["n_words"], out["word_chars"] = n, sum(map(len, found))
    out["n_symbols"] = sum(c in "#*$%&|<>" for c in text or "")
    out["n_dup_lines"], out["n_repeat_words"] = len(lines) - len(set(lines)), len(covered)
    out["base_failed"] = n < 50 or 100 * len(covered) > 50 * n
    return out


def test_quality(docs, labels):
    for r in quality.quality(docs, labels).collect():
        want = brute_base(ROWS[r.doc_id][1])
        assert {k: r[k] for k in want} == want, r.doc_id
        assert not (r.kept and r.base_failed)


def test_quality_ratio_rejects_foreign_text(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "tree", "is", "green", "and", "tall"]) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(rng.choice(["x1", "y2", "z3"]) + "%%%" for _ in range(80)) for _ in range(20)]
    frame = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(good + bad)], SCHEMA)
    marks = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality(frame, marks))
    assert all(got[i].llr > quality.THRESHOLD for i in range(60)) and all(got[i].llr < quality.THRESHOLD for i in range(60, 80))


# 8. Jaccard join


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = [x.translate(LOWER) for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {i: (len(sets[i]), comp[i]) for i in sets}


def near_rows():
    rng = random.Random(8)
    rows, base = [], [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 30, 120, 400]))] for _ in range(12)]
    for b in base:
        for _ in range(12):
            copy = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 25))):
                copy[rng.randrange(len(copy))] = "e%d" % rng.randint(0, 9)
            rows.append((len(rows), " ".join(copy), "en", "a", 0))
    return rows


@pytest.mark.parametrize("rows", [ROWS[:97], near_rows()], ids=["fixture", "near"])
def test_components(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows)


def test_signatures_never_refuse_a_link():
    rng = np.random.default_rng(9)
    for n in (3, 200, 300, 1000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], rng.integers(0, 1 << 63, n // 20 + 1, dtype=np.uint64)]))
        x, y = (np.array(jaccard_join.signature(s)) for s in (a, b))
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert sum(int(v).bit_count() if v >= 0 else (int(v) + (1 << 64)).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))


# 9. License scan


def test_license_scan(spark):
    t = license_scan.TEMPLATES
    shifted = t["MIT-text"].replace("free of charge", "free of any charge").replace("sublicense,", "")
    rows = [(0, "x y " * 40 + t["GPL-3.0"] + " z" * 30), (1, "the license of the work " * 20), (2, "a\n" + shifted.upper() + "\nb"), (3, None), (4, ""), (5, t["MIT"] + " " + t["CC-BY-NC-4.0"])]
    got = {(r.doc_id, r.license): r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(0, "GPL-3.0"), (2, "MIT-text"), (5, "MIT"), (5, "CC-BY-NC-4.0")}
    assert got[0, "GPL-3.0"].coverage == 1.0 and got[0, "GPL-3.0"].first_word == 80 and got[2, "MIT-text"].coverage > 0.95


def test_license_scan_tells_relatives_apart():
    t = license_scan.TEMPLATES
    scanner = license_scan.Scanner(t)
    for name, text in t.items():
        got = {hit[0]: hit[1] for hit in scanner.scan("some words before " + text + " and after it")}
        assert got == {name: 1.0}, (name, got)
    assert {hit[0] for hit in scanner.scan(t["BSD-3-Clause"].replace("the copyright holder", "Facebook"))} == {"BSD-3-Clause"}
    assert {hit[0] for hit in scanner.scan(t["BSD-2-Clause"] + " x" * 200 + t["BSD-3-Clause"])} == {"BSD-2-Clause", "BSD-3-Clause"}
    assert {hit[0] for hit in scanner.scan(t["AGPL-3.0-header"].replace("version 3", "version 4"))} == set()
    assert {hit[0] for hit in scanner.scan("Licensed under the Mozilla Public License, Version 2.0.")} == {"MPL-2.0"}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Released under the BSD License.", set()),
        ("Released under the Apache License.", set()),
        ("Licensed under CC BY 4.0.", {"CC-BY-4.0-short"}),
        ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0-short"}),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", {"LGPL-2.1"}),
        ("Licensed under the Mozilla Public License, Version 2.0.", {"MPL-2.0"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"CC-BY-NC-4.0-name"}),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0-name"}),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"CC-BY-4.0"}),
        ("Published under the MIT License.", {"MIT-name"}),
    ],
)
def test_license_scan_needs_the_name(line, want):
    assert {hit[0] for hit in license_scan.Scanner(license_scan.TEMPLATES).scan(line)} == want


def test_longest_increasing_subsequence():
    assert [[5, 1, 4, 2, 3, 9][i] for i in license_scan.increasing([5, 1, 4, 2, 3, 9])] == [1, 2, 3, 9]
    assert license_scan.increasing([]) == []


# 10. WARC


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\n", "é" * 1000, "<p>a</p>"]
    rows = [(i, "http://x/ y\r\n" if i % 2 else None, h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.read_archives(spark, warc.write_archives(pages)).collect()}
    last = {h or "": i for i, h in enumerate(html)}
    for i, h in enumerate(html):
        data, revisit = (h or "").encode(), last[h or ""] != i
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and got[i].payload_bytes == len(data)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", last[h or ""]) if revisit else ("response", None))
    big = {r.page_id: r for r in warc.read_archives(spark, warc.write_archives(pages, min_bytes=9)).collect()}
    assert all(r.record_type == "response" for r in big.values())
    assert got[1].target_uri == "http://x/%20y%0D%0A" and got[0].target_uri is None


# Hard tables for every operator: empty; repeated rows, null ids and clashing columns


def operators(docs, labels, benchmark):
    spark = docs.sparkSession
    yield "tokens", lambda: token_output.read_documents(spark, token_output.write_tokens(docs, tokenizer_path()))
    yield "lines", lambda: line_dedup.line_dedup_digest(docs)
    yield "toxicity", lambda: toxicity.toxicity(docs, labels)
    yield "mixing", lambda: mixing.mix_totals(mixing.mix(docs))
    yield "sharding", lambda: sharding.shard_documents(docs)
    yield "quality", lambda: quality.quality(docs, labels)
    yield "components", lambda: jaccard_join.near_components(docs)


NAMES = ["tokens", "lines", "toxicity", "mixing", "sharding", "quality", "components"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, labels, benchmark, name):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert dict(operators(empty, labels, benchmark))[name]().count() == 0
    assert dict(operators(empty, nothing, benchmark))[name]().count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables_give_a_row_each(odd, labels, benchmark, name):
    assert dict(operators(odd, labels, benchmark))[name]().count() == len(ROWS) + 10


def test_empty_and_odd_tables_of_the_rest(spark, empty, odd, benchmark, labels):
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(odd, benchmark.limit(0)).count() == 0
    assert license_scan.license_scan(empty).count() == 0 and license_scan.license_scan(odd).count() == 0
    assert warc.read_archives(spark, warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    for kept in (quality.kept_documents(odd, labels), jaccard_join.one_of_each(odd), decontamination.decontaminated(odd, benchmark), mixing.mixed_documents(odd)):
        assert kept.columns == odd.columns and kept.count() > 0
