"""The pipeline stage by stage against brute force, and its registration."""

import zlib
from collections import Counter

import numpy as np

import __spark_entry__
import corpus_pipeline
from runlens.llm.common import table, written
from runlens.llm.queries import QUERIES, tokenizer_path

from .test_operators import brute_base, brute_components, brute_targets, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs, seen = table(spark, SF, "documents"), []
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        docs = written(stage(spark, docs, SF), "test")
        seen.append(name)
        after = docs.collect()
        if name == "token-ID output":
            plain, start = Tokenizer.from_file(tokenizer_path()), 0
            want = []
            for i, t, *_ in sorted(before, key=lambda r: (r[0], r[1])):
                ids = plain.encode(t, add_special_tokens=False).ids + [0]
                want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
            assert sorted(map(tuple, after)) == sorted(want)
            assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
            continue
        assert docs.columns == names
        kept = Counter(r.doc_id for r in after)
        texts = {i: t for i, t, *_ in before}
        assert all(texts[r.doc_id] == r.text for r in after)
        if name == "quality rules":
            assert not any(brute_base(texts[i])["base_failed"] for i in kept) and 0 < len(kept) < len(before)
        elif name == "n-gram Jaccard join":
            assert set(kept) == {i for i, (_, c) in brute_components([(i, t) for i, t, *_ in before]).items() if i == c}
        elif name == "mixing sources to target weights":
            size, got, longest = Counter(), Counter(), Counter()
            for i, t, _, s in before:
                size[s] += len(words(t))
                got[s] += kept[i] * len(words(t))
                longest[s] = max(longest[s], len(words(t)))
            target = brute_targets(size)
            assert all(abs(got[s] - target[s]) <= longest[s] / 2 + 1 for s in size) and max(kept.values()) <= 3
    assert len(seen) == 5


def test_registration():
    found = __spark_entry__.queries()
    assert set(QUERIES) <= set(found) and "pipeline" in found
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11))
