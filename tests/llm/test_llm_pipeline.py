"""Each stage of the pipeline on its own input, against a plain-Python version."""

from collections import Counter

import pytest
from brute import base_counts, components, piece_rows, repeated

import corpus_pipeline
from scoutframe.llm import quality_divergence, source_mix
from scoutframe.llm.durable import durable


@pytest.fixture(scope="module")
def made(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], folder)))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(made):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "source mix", "packing"]
    assert all(x.columns == made[0].columns for x in made[:5])


def test_quality(made):
    judged = {r.doc_id: r for r in quality_divergence.judge_quality(made[0]).collect()}
    assert sorted(texts(made[1])) == sorted((k, t) for k, t in texts(made[0]) if judged[k].kept)
    for k, t in texts(made[0]):
        n, _, _, _, again = base_counts(t)
        if n < 20 or 100 * again > 30 * n:
            assert not judged[k].kept


def test_near_duplicates(made):
    label = components(texts(made[1]), width=5)
    assert sorted(texts(made[2])) == sorted((k, t) for k, t in texts(made[1]) if label[k][1] == k)
    assert made[2].count() < made[1].count()


def test_repeated_passages(made):
    _, marks = repeated(texts(made[2]), corpus_pipeline.PASSAGE_BYTES)
    got = dict(texts(made[3]))
    for k, t in texts(made[2]):
        raw = t.encode()
        kept = bytes(x for x, m in zip(raw, marks[k]) if not m)
        # spans end at whole characters, so a text keeps up to 3 bytes more at each end of a span
        if not any(marks[k]):
            assert got[k] == t
        elif kept:
            assert len(kept) <= len(got[k].encode()) <= len(kept) + 6 * (sum(a != b for a, b in zip(marks[k], marks[k][1:])) + 2)


def test_mix(made):
    plan = {r.doc_id: r for r in source_mix.mix_sources(made[3]).collect()}
    times = Counter(k for k, _ in texts(made[4]))
    assert all(times[k] == r.whole + (r.part > 0) for k, r in plan.items() if r.size)


def test_packing(made):
    from tokenizers import Tokenizer

    want = piece_rows(texts(made[4]), Tokenizer.from_file(corpus_pipeline.vocabulary("word_bpe_49k.json")))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made[5].collect()]
    assert sorted(got) == sorted(want)
    assert made[5].select("sequence_id").distinct().count() <= -(-sum(x[3] for x in want) // 2048) + 1


def test_run(spark, folder, made):
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, made[5].collect()))
