"""Methods on made-up input with known answers."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import components
from hypothesis import given, settings
from hypothesis import strategies as st

from scoutframe.llm import best_fit, chat_grammar, factor_toxicity, kdtree_topk, register_dedup, suffix_repeats, token_resync
from scoutframe.llm.components import connected
from scoutframe.llm.queries import vocabulary
from scoutframe.llm.segment_memo import token_counts, token_ids, tokenizer
from scoutframe.llm.sieve import sieve, sieve_out
from scoutframe.llm.textbytes import slices

TEXT = st.text(st.sampled_from(list("ab \n\t#</turn>\\:é  　'sX1<|endoftext|>")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_memo_gives_the_library_tokens(texts):
    s = next(slices(pa.array(texts)))[2]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = tokenizer(vocabulary(name))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        if name.startswith("byte"):
            assert token_counts(s, vocabulary(name)).tolist() == [len(x) for x in want]
        else:
            ids, first = token_ids(s, vocabulary(name), 0)
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [[*x, 0] for x in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=5))
def test_chat_round_trip(turns):
    assert list(chat_grammar.parse("".join(chat_grammar.render(r, t)[0] for r, t in turns))) == turns


def test_difference_cover_holds_for_all_pairs():
    p = suffix_repeats.PERIOD
    assert {(a - b) % p for a in suffix_repeats.COVER for b in suffix_repeats.COVER} == set(range(p))
    i, j = np.meshgrid(np.arange(p), np.arange(p), indexing="ij")
    s = suffix_repeats.SHIFT
    assert ((s >= 1) & (s <= p)).all()
    assert np.isin((i + s) % p, suffix_repeats.COVER).all() and np.isin((j + s) % p, suffix_repeats.COVER).all()


def test_partners_are_exact():
    rng = random.Random(5)
    base = bytes(rng.randrange(97, 123) for _ in range(2500))
    texts = [b"ab" * 400, b"x" * 700]
    for _ in range(25):
        b = bytearray(base)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(3)] = bytes(rng.randrange(97, 123) for _ in range(rng.randrange(4)))
        texts.append(bytes(b[rng.randrange(400) :]))
    s = next(slices(pa.array([t.decode() for t in texts])))[2]
    found = suffix_repeats.runs(s, suffix_repeats.Repeats())
    stretches = [texts[d][b : b + n - 1 + 400] for d, b, n in zip(found["doc"], found["begin"], found["n"])]
    got = {
        (int(found["doc"][k]), int(found["begin"][k]) + int(x))
        for k, numbers in enumerate(suffix_repeats.partners(stretches, found["n"], found["at"], 400)) for x in numbers
    }
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    assert got == {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1}


def test_crowded_buckets_give_the_same(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one = suffix_repeats.repeat_report(docs).collect()
    rows = suffix_repeats.repeat_report(docs, plan=suffix_repeats.Repeats(bucket_runs=1)).collect()
    assert sorted(one) == sorted(rows) and sum(r.n_removed for r in one) > 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_bound_and_packing(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    bins, fill = best_fit.best_fit_decreasing(lengths, 64)
    assert (np.bincount(bins, weights=lengths, minlength=len(fill)) == fill).all() and (fill <= 64).all()
    assert -(-int(lengths.sum()) // 64) <= best_fit.lower_bound(lengths, 64) <= len(fill)


def test_bound_beats_the_sum():
    assert best_fit.lower_bound(np.array([33] * 7), 64) == 7
    assert best_fit.lower_bound(np.array([22] * 6), 64) == 3


def test_exchange_between_groups(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 3000)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "row long, length long")
    placed = best_fit.pack(items, 2048, group_rows=100).collect()
    used = Counter()
    for r in placed:
        used[r.sequence_id] += int(lengths[r.row])
    assert len(placed) == 3000 and max(used.values()) <= 2048
    apart = sum(len(best_fit.best_fit_decreasing(lengths[k : k + 100], 2048)[1]) for k in range(0, 3000, 100))
    assert best_fit.lower_bound(lengths, 2048) <= len(used) < apart


def test_resync_widens_until_it_fits(spark):
    rng = random.Random(2)
    texts = ["x" * 900, "ab " * 700, "".join(rng.choice("abc é' \n<|endoftext|>") for _ in range(3000)), "word" * 50 + " " * 400 + "end " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = vocabulary("byte_bpe_50k.json")
    library = tokenizer(path)
    plan = token_resync.Chunks(chunk_chars=100, overlap=12, widen=4)
    got = {r.doc_id: r.n_tokens for r in token_resync.count_tokens(docs, path, plan=plan).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_chance_agreement_is_small_and_registers_estimate():
    rng = np.random.default_rng(3)
    plan = register_dedup.Sketch()
    a = rng.integers(0, 1 << 52, 4000, dtype=np.uint64)
    for shared in (0, 2000, 3600):
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 52, 4000 - shared, dtype=np.uint64)])
        both = register_dedup.registers_of(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 4000, 8000]), plan.registers, plan.mantissa)
        assert abs((both[0] == both[1]).mean() - shared / (8000 - shared)) < 0.16


def test_chains_and_stars_of_edited_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs, key = [], 0
    for edits in (2, 6, 10):  # copies of one original that are too far from each other, but not from it
        base = [word() for _ in range(100)]
        for c in range(30):
            text = list(base)
            for at in rng.sample(range(100), edits if c else 0):
                text[at] = word()
            docs.append((key + (29 - c), " ".join(text)))
        key += 30
    text = [word() for _ in range(120)]
    for _ in range(40):  # a chain: each is close to the one before only
        text = list(text)
        for _ in range(4):
            text[rng.randrange(120)] = word()
        docs.append((key, " ".join(text)))
        key += 1
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (2048, 4):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in register_dedup.near_duplicates(frame, plan=register_dedup.Sketch(block=block)).collect()}
        assert got == components(docs)


def test_connected(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.key: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_sieve_lets_no_partner_go(spark):
    rows, wanted = spark.range(5000), spark.range(0, 5000, 7)
    inside = {r.id for r in sieve(rows, wanted, ["id"]).collect()}
    outside = {r.id for r in sieve_out(rows, wanted, ["id"]).collect()}
    assert set(range(0, 5000, 7)) <= inside and not inside & outside and len(inside | outside) == 5000
    assert {r.id for r in sieve_out(rows, wanted.limit(0), ["id"]).collect()} == set(range(5000))


def test_machine_learns_a_meeting_of_two_words(spark):
    rng = random.Random(8)
    filler = [f"filler{i}" for i in range(40)]
    docs, labels = [], []
    for k in range(1500):
        words = rng.choices(filler, k=12)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["vermin"] * a + ["neighbours"] * b
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
        labels.append((k, int(a and b)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: (r.held_out, r.predicted) for r in factor_toxicity.score_toxicity(d, factor_toxicity.fit(d, lab)).collect()}
    held = [(p, dict(labels)[k]) for k, (h, p) in got.items() if h]
    assert sum(p == y for p, y in held) / len(held) > 0.97


@pytest.mark.parametrize("scale", [1.0, 1e14])
def test_tree_search_is_exact(scale):
    rng = np.random.default_rng(9)
    points = np.floor(rng.normal(0, 3, (700, 6)) * scale)
    points[100:200] = points[0]
    order, nodes, low, high = kdtree_topk.build_tree(points, 16)
    ids = np.arange(700)[order]
    for q, best in kdtree_topk.search(points[:9], np.arange(9), np.full(9, -np.inf), ids, points[order], nodes, low, high, 5):
        exact = sorted((-sum(int(x) * int(y) for x, y in zip(points[q], p)), i) for i, p in enumerate(points) if i != q)[:5]
        assert best == exact


def test_copies_of_query_blocks_are_not_broadcast(spark):
    """Blocks are few before they are copied to every shard; Spark must not take the copies for few and gather them in the driver."""
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(0, 1, (900, 4)).round(2).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = kdtree_topk.top_inner_products(df, "key % 3 = 0", k=4, shard_rows=30, block_rows=20, leaf=4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Generate explode" in plan and "MapInArrow" in plan
    copies = [x for x in plan.split("== Initial Plan ==")[0].splitlines() if "BroadcastExchange" in x and "binary" in x]
    joined = [x for x in plan.split("== Initial Plan ==")[0].splitlines() if "Join" in x and "shard" in x]
    assert not copies and not joined
    whole = np.floor(256 * np.array([v for _, v in rows]))
    want = []
    for q in range(0, 900, 3):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:4]
        want += [(q, place, i, -s) for place, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("kinds", [1, 3, 500])
def test_tree_search_in_blocks_keeps_ties_and_limits(kinds):
    rng = np.random.default_rng(kinds)
    points = np.floor(rng.normal(0, 3, (kinds, 5)))[rng.integers(0, kinds, 600)]
    order, nodes, low, high = kdtree_topk.build_tree(points, 8)
    ids = rng.permutation(600)
    queries, own = np.floor(rng.normal(0, 3, (40, 5))), np.arange(40)
    products = [sorted((-int(p @ q), int(i)) for p, i in zip(points, ids) if i != k) for k, q in enumerate(queries)]
    least = np.array([[-np.inf, -float(products[k][2][0]), -float(products[k][0][0]) + 1][k % 3] for k in range(40)])
    found = dict(kdtree_topk.search(queries, own, least, ids[order], points[order], nodes, low, high, 4))
    assert found == {k: [x for x in products[k] if -x[0] >= least[k]][:4] for k in range(40)}
