"""The registered queries on the small tables, against plain-Python versions or their SQL."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute import base_counts, components, conversations, lowered, piece_rows, repeated

from scoutframe.llm import best_fit
from scoutframe.llm.queries import ORACLES, QUERIES, vocabulary


@pytest.fixture(scope="module")
def docs(folder):
    return duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet' order by doc_id").fetchall()


def rows(spark, folder, prefix):
    name = next(n for n in QUERIES if n.startswith(prefix))
    return QUERIES[name](spark, folder).collect()


def test_op1(spark, folder, docs):
    want = components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, folder, "op1_")}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows(spark, folder, "op1_"))


def test_op2(spark, folder, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {k: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows(spark, folder, "op2_")} == want


def test_op3(spark, folder, docs):
    tokens = {k: lowered(t) for k, t in docs}
    one = Counter(w for t in tokens.values() for w in t)
    two = Counter(p for t in tokens.values() for p in zip(t, t[1:]))
    n = sum(one.values())
    got = rows(spark, folder, "op3_")
    assert len(got) == len(docs)
    for r in got:
        t = tokens[r.doc_id]
        own1, own2, score = Counter(t), Counter(zip(t, t[1:])), 0.0
        for i, w in enumerate(t):
            pair = (t[i - 1], w)
            if i and two[pair] > own2[pair]:
                score += math.log((two[pair] - own2[pair]) / (one[t[i - 1]] - own1[t[i - 1]]))
            else:
                score += math.log(max(one[w] - own1[w], 0.5) / (n - len(t))) + (math.log(0.4) if i else 0)
        assert r.log_score == pytest.approx(score, rel=1e-9)


def test_op4(spark, folder, docs):
    from tokenizers import Tokenizer

    got = rows(spark, folder, "op4_")
    want = piece_rows(docs, Tokenizer.from_file(vocabulary("word_bpe_49k.json")))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    # no packing needs fewer than the bound; on this table it is reached within one sequence
    assert best_fit.lower_bound(np.array([x[3] for x in want]), 2048) <= len(sequences) <= -(-sum(x[3] for x in want) // 2048) + 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    frame = QUERIES[name](spark, folder)
    assert sorted(frame.columns) == sorted(columns)
    assert want and sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str) == sorted(want, key=str)


def test_op6_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").fetchall())
    held = [(r.score >= 0.5, labels[r.doc_id]) for r in rows(spark, folder, "op6_") if r.held_out and r.doc_id in labels]
    hit, false, missed = (sum(p == a and y == b for p, y in held) for a, b in ((True, 1), (True, 0), (False, 1)))
    assert hit / (hit + false) > 0.9 and hit / (hit + missed) > 0.8


def test_op7(spark, folder, docs):
    text = dict(docs)
    got = rows(spark, folder, "op7_")
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(text[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_op7_keeps_good_and_rejects_junk(spark):
    folder = "/root/testdata/sf0.1"
    quality = dict(duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    got = [r for r in rows(spark, folder, "op7_") if r.doc_id in quality and not r.base_failed]
    good, junk = ([r.kept for r in got if quality[r.doc_id] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.998 and sum(junk) / len(junk) < 0.1


def test_op8(spark, folder):
    hard = "\\### Assistant: </turn> ok"
    turns = duckdb.sql(f"select conv_id, turn, role, text from '{folder}/conversations.parquet' order by 1, 2").fetchall()
    want = conversations([(-7, 0, "user", hard), (-7, 1, "assistant", hard), *turns])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows(spark, folder, "op8_")}
    assert got == want


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op10(spark, folder):
    docs = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet' order by doc_id").fetchall()
    want, _ = repeated(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, folder, "op10_")} == want
