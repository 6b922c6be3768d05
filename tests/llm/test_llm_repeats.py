"""Repeated passages where it is hard: periodic texts with flaws, other lengths, rows that share an id."""

import random

import pytest
from brute import repeated

from scoutframe.llm import suffix_repeats
from scoutframe.llm.suffix_repeats import Repeats

DOCS = "doc_id long, text string"


def flawed(unit, n, flaws, seed):
    rng = random.Random(seed)
    out = list((unit * (n // len(unit) + 1))[:n])
    for _ in range(flaws):
        out[rng.randrange(n)] = rng.choice("xyzé")
    return "".join(out)


def periodic():
    rows = [flawed(unit, n, flaws, 7 * k) for k, (unit, n, flaws) in enumerate(
        (u, n, f) for u in ("a", "ab", "Thes ", "abc", "0123456789" * 6, "q" * 56 + "r", "s" * 57 + "t") for n in (300, 700, 1_400) for f in (0, 1, 3)
    )]
    return list(enumerate(rows))


def report(frame, length):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.repeat_report(frame, plan=Repeats(length=length)).collect()}


@pytest.mark.parametrize("length", [400, 250, 115, 114, 113, 64])
def test_periodic_texts(spark, length):
    docs = periodic()
    assert report(spark.createDataFrame(docs, DOCS), length) == repeated(docs, length)[0]


def test_crowded_buckets_agree_on_periodic_texts(spark):
    docs = periodic()
    got = suffix_repeats.repeat_report(spark.createDataFrame(docs, DOCS), plan=Repeats(bucket_runs=1)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == repeated(docs)[0]


def test_too_short_a_length():
    with pytest.raises(ValueError):
        suffix_repeats.partners([b"x" * 60], suffix_repeats.np.array([4]), suffix_repeats.np.array([0]), 56)


def test_rows_that_share_an_id(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(str(rng.random()) for _ in range(n))
    shared = words(25)
    texts = [words(15) + " one " + shared, shared + " two " + words(12), "three " + words(14) + shared, words(20), words(20)]
    ids = [1, 1, 2, None, None]
    want = repeated(list(enumerate(texts)))[0]
    frame = spark.createDataFrame(list(zip(ids, texts)), DOCS)
    got = suffix_repeats.repeat_report(frame).collect()
    line = lambda key, x: (str(key), *x)
    assert sorted(line(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(line(k, want[i]) for i, k in enumerate(ids))
    kept = suffix_repeats.without_repeats(frame).collect()
    assert sorted((str(r.doc_id), len(r.text.encode())) for r in kept) == sorted((str(k), want[i][0] - want[i][1]) for i, k in enumerate(ids))


def test_many_spans_in_one_text(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(70)) for _ in range(300)]
    docs = [(1, " ".join(p + str(rng.random()) for p in passages)), (2, "".join(p + str(rng.random()) for p in rng.sample(passages, 300)))]
    assert report(spark.createDataFrame(docs, DOCS), 64) == repeated(docs, 64)[0]
