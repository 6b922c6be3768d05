"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scoutframe.llm import backoff_scores, best_fit, chat_grammar, factor_toxicity, kdtree_topk, quality_divergence, register_dedup, source_mix, suffix_repeats, token_resync
from scoutframe.llm.queries import vocabulary

CLASHES = ("key", "row", "size", "slot", "turn", "part", "block", "bucket", "a", "b", "band", "code", "component", "text_a", "kept", "spans", "whole", "__fill")
LONG = " ".join(f"word{i % 977} stays" for i in range(20_000))
ODD = [
    (1, "one two three four five six", "en", "s"), (2, "one two three four five six", "en", "s"), (2, "one two three four five six", "en", "s"),
    (3, None, "en", None), (4, "", None, "s"), (5, " \n\t ", "en", "t"), (None, "a text without an id", "en", "t"), (6, LONG, "en", None),
    (7, LONG + " end", "xx", "t"), (8, "word", "en", "t"), (9, "A  word", "en", None), (10, "zéro   \U0001f600 é", None, ""),
]


def extra(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return extra(spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
OPERATORS = {
    "near": register_dedup.near_duplicates,
    "tokens": lambda d: token_resync.count_tokens(d, BYTES),
    "scores": backoff_scores.backoff_scores,
    "pack": lambda d: best_fit.pack_documents(d, WORDS),
    "mix": source_mix.mix_sources,
    "quality": quality_divergence.judge_quality,
    "repeats": suffix_repeats.repeat_report,
}
STAGES = {
    "keep_quality": quality_divergence.keep_quality,
    "without_near": register_dedup.without_near_duplicates,
    "without_repeats": suffix_repeats.without_repeats,
    "mixed": source_mix.mixed_documents,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage_keeps_columns(odd, none, name):
    assert STAGES[name](none).collect() == []
    assert STAGES[name](odd).columns == odd.columns


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_near(odd):
    got = by_id(register_dedup.near_duplicates(odd).collect())
    assert sum(map(len, got.values())) == len(ODD)
    assert {r.component_id for r in got[1] + got[2]} == {1} and len(got[2]) == 2
    assert [(got[k][0].n_shingles, got[k][0].component_id) for k in (3, 4, 5)] == [(0, 3), (0, 4), (0, 5)]
    assert got[7][0].component_id == 6 and got[8][0].n_shingles == 1
    assert got[None][0].component_id is None and got[None][0].kept
    left = by_id(register_dedup.without_near_duplicates(odd).collect())
    assert sorted(k for k in left if k) == [1, 3, 4, 5, 6, 8, 9, 10] and len(left[1]) == 1 and None in left


def test_tokens(odd):
    got = by_id(token_resync.count_tokens(odd, BYTES).collect())
    assert sum(map(len, got.values())) == len(ODD) and got[3][0].n_tokens == got[4][0].n_bytes == 0
    assert got[6][0].over_limit and got[6][0].n_bytes == len(LONG)


def test_scores(odd):
    got = by_id(backoff_scores.backoff_scores(odd).collect())
    assert None not in got and got[3][0].log_score == 0 and got[3][0].mean_log_score is None
    assert got[2][0].log_score == got[2][1].log_score > got[10][0].log_score * 10


def test_pack(odd):
    rows = best_fit.pack_documents(odd, WORDS).collect()
    got = by_id(rows)
    assert [(r.piece, r.length) for r in got[3]] == [(0, 1)] == [(r.piece, r.length) for r in got[5]]
    assert len(got[2]) == 2 and {r.length for r in got[6][:-1]} >= {2048}
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 and sorted(v)[0][0] == 0 for v in used.values())


def test_mix(odd):
    rows = source_mix.mix_sources(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert set(by) == {"", "s", "t", None}
    for v in by.values():
        assert sum(r.size for r in v) == v[0].source_size and abs(sum(r.taken for r in v) - v[0].target) <= 1
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))


def test_mixed_rows_follow_the_plan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = {r.doc_id: r for r in source_mix.mix_sources(docs).collect()}
    made = by_id(source_mix.mixed_documents(docs).collect())
    source = by_id(docs.collect())
    for k, r in plan.items():
        sizes = sorted(len(x.text.split()) if x.text else 0 for x in made.get(k, []))
        want = sorted([r.size] * r.whole + [r.part] * (r.part > 0))
        assert [x for x in sizes if x] == [x for x in want if x]
        assert all(source[k][0].text.startswith(x.text) for x in made.get(k, []))


def test_quality(odd):
    got = by_id(quality_divergence.judge_quality(odd).collect())
    assert sum(map(len, got.values())) == len(ODD)
    assert got[3][0].n_words == got[5][0].n_words == 0 and got[3][0].base_failed and not got[3][0].kept
    assert got[10][0].word_chars == 7 - 0 or got[10][0].word_chars > 0


def test_repeats(odd):
    got = by_id(suffix_repeats.repeat_report(odd).collect())
    assert sum(map(len, got.values())) == len(ODD)
    assert got[3][0].n_bytes == got[3][0].n_removed == 0 and got[3][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[6][0].n_removed == len(LONG) and got[7][0].n_removed >= len(LONG) - 10


def test_toxicity(spark, odd, none):
    labels = extra(spark.createDataFrame([(1, 1), (2, None), (None, 0), (8, 0), (8, 0)], "doc_id long, toxic int"))
    for docs, lab in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        rows = factor_toxicity.score_toxicity(docs, factor_toxicity.fit(docs, lab)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_chat(spark):
    turns = [(1, 1, "user", "b"), (1, 0, None, None), (1, 1, "user", "b"), (None, 0, "assistant", "x\n</turn>\n### user: y"), (2, None, "assistant", "é" * 300_000), (3, 0, "a: b\\", "\\")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("conv", F.lit(1))
    got = {r.conv: r for r in chat_grammar.read_conversations(chat_grammar.format_turns(df)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == digest("\n\nuser\nb\nuser\nb\n")
    assert got[None].loss_sha256 == digest("x\n</turn>\n### user: y") and got[2].loss_chars == 300_000
    assert got[3].turns_sha256 == digest("a: b\\\n\\\n")
    assert chat_grammar.read_conversations(chat_grammar.format_turns(df.limit(0))).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [9.0, 9.0]), (8, [1.0] * 3), (1, [2.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("shard", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in kdtree_topk.top_inner_products(df, "key % 50 = 0", k=3).collect())
    assert got == [(0, 1, 1, 131072), (0, 2, 1, 65536), (0, 3, 2, 65536), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    assert kdtree_topk.top_inner_products(df.limit(0), "key % 50 = 0").collect() == []


def test_mix_meets_its_target_where_ids_are_missing_or_shared(spark):
    words = "one two three four five six seven eight nine ten eleven "
    rows = [(None, words * (i % 5 + 1), "hot") for i in range(40)] + [(7, words * 3, "hot")] * 9 + [(i, words * 30, "other") for i in range(10, 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = source_mix.mix_sources(docs).collect()
    made = source_mix.mixed_documents(docs).collect()
    for name in ("hot", "other"):
        target = next(r.target for r in plan if r.source == name)
        assert sum(len(r.text.split()) for r in made if r.source == name) == round(target) == sum(r.taken for r in plan if r.source == name)
    slots = source_mix._turn(F.lit(None), F.col("id"), "mix-1")
    assert spark.range(1000).select(slots.alias("t")).distinct().count() == 1000
