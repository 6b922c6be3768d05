"""Cases in which an operator once did less than the whole job."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from scoutframe.llm import quality_divergence, register_dedup, suffix_repeats

SF = "/root/testdata/sf0.1"


def _prose(lang, n):
    found = duckdb.sql(
        f"select text from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id) where quality = 1 and lang = '{lang}' and n_chars between 500 and 4000 order by doc_id"
    ).fetchall()
    return [t for (t,) in found][:n]


def _judged(spark, texts):
    rows = [(i, text, lang) for i, (text, lang) in enumerate(texts)]
    got = {r.doc_id: r for r in quality_divergence.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    return [got[i] for i in range(len(rows))]


def _letters(text):
    """The same text in another alphabet."""
    return "".join(chr(0x430 + ord(c) - 97) if "a" <= c <= "z" else c for c in text.lower())


def test_quality_of_small_languages_and_of_none(spark):
    english, german = _prose("en", 60), _prose("de", 3)
    probes = [(german[0], "de"), (_letters(german[1]), "ru"), (german[2], None), (_letters(german[2]), None)]
    got = _judged(spark, [*((t, "en") for t in english), *probes])
    assert sum(r.kept for r in got[: len(english)]) >= 0.95 * len(english)
    for r in got[len(english) :]:
        assert not r.base_failed and r.kept and r.class_distance is None and r.word_distance is None
    assert all(r.class_distance is not None for r in got[: len(english)])


def test_quality_of_gibberish_and_of_the_wrong_language(spark):
    rng = random.Random(5)
    parts = [a + b for a in "bcdfghjklmnprstvz" for b in "aeiou"]
    mark = lambda: rng.choice(["", "", "", "", "", ",", "."])
    gibberish = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) + mark() for _ in range(400)) for _ in range(8)]
    english, german = _prose("en", 320), _prose("de", 200)
    right = [*((t, "en") for t in english[:300]), *((t, "de") for t in german)]
    wrong = [(t, "de") for t in english[300:] if len(t.split()) >= 100][:8]
    got = _judged(spark, [*right, *wrong, *((t, "en") for t in gibberish)])
    kept = [r.kept for r in got]
    assert len(german) == 200 and sum(kept[: len(right)]) >= 0.98 * len(right)
    assert len(wrong) == 8 and not any(r.base_failed for r in got[len(right) :]) and not any(kept[len(right) :])


def _noise(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghij ") for _ in range(n))


def test_passages_shared_with_a_row_without_an_id(spark):
    shared, alone = _noise(1, 3000), _noise(2, 900)
    texts = [
        (None, _noise(3, 300) + shared), (5, _noise(4, 500) + shared), (9, _noise(5, 400) + shared[1000:1800] + _noise(6, 400)),
        (None, _noise(7, 500) + alone + _noise(8, 500)), (11, _noise(9, 400) + alone), (None, _noise(10, 1000)),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    removed = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_repeats.repeat_report(docs).collect())
    want = [(0, 1000, 0), (0, 1900, 900), (0, 3300, 3000), (5, 3500, 3000), (9, 1600, 800), (11, 1300, 900)]
    assert [(k, n) for k, n, _ in removed] == [(k, n) for k, n, _ in want]
    assert all(w <= r <= w + 6 for (_, _, r), (_, _, w) in zip(removed, want))  # a byte at either end may agree by chance
    sizes = sorted((r.doc_id or 0, len(r.text)) for r in suffix_repeats.without_repeats(docs).collect())
    assert sizes == sorted((k, n - r) for k, n, r in removed)


def test_different_texts_under_one_id(spark):
    def words(seed, changed=()):
        rng = random.Random(seed)
        made = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        return " ".join("other" if k in changed else w for k, w in enumerate(made))

    texts = [(1, words(1)), (1, words(2)), (2, words(1, {150})), (3, words(2, {20})), (3, words(3)), (4, words(3, {7})), (4, words(3, {7})), (0, words(4)), (7, words(5)), (7, words(5))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in register_dedup.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True), (4, 3, False), (4, 3, False), (7, 7, True), (7, 7, True)]
    left = sorted((r.doc_id, r.text) for r in register_dedup.without_near_duplicates(docs).collect())
    assert left == sorted([(0, words(4)), (1, words(1)), (1, words(2)), (3, words(3)), (7, words(5))])


def test_quality_fades_with_the_words_of_a_language_without_a_step(spark):
    rules = quality_divergence.Rules()
    chance = [quality_divergence.reference_chance(n, rules) for n in (10, 100, 1_000, 4_999, 5_000, 10**9)]
    assert chance == sorted(chance, reverse=True) and chance[3] - chance[4] < 1e-5 and chance[5] < 1e-3 and chance[0] + rules.max_word_distance > 1
    rng = random.Random(6)
    gibberish = " ".join("".join(rng.choices("bcdfgaeiou", k=rng.randint(3, 9))) for _ in range(400))
    for n in (6, 60, 200):
        german = _prose("de", n)
        *kept, bad = [r.kept for r in _judged(spark, [(t, "de") for t in [*german, gibberish]])]
        assert len(kept) == n and sum(kept) >= 0.95 * n and not bad


def _plain_words(text):
    """Words in lower case without marks at either end, three at most."""
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        for _ in range(3):
            w = w[:-1] if len(w) > 1 and w[-1] in ".,;:!?-'\"()`" else w
            w = w[1:] if len(w) > 1 and w[0] in ".,;:!?-'\"()`" else w
        yield "".join(c.lower() if "A" <= c <= "Z" else c for c in w)


def _plain_class(byte):
    c = chr(byte)
    tests = [c.islower(), c.isupper(), c.isdigit(), c in " \t", c in "\n\r", c in ".,;:!?-", c in "'\"()`", False, byte < 32 or byte == 127]
    return 9 if byte > 127 else next((i for i, hit in enumerate(tests) if hit), 7)


def _plain_distance(own, others):
    p, q = ({k: n / sum(c.values()) for k, n in c.items() if n} for c in (own, others))
    total = sum(x * math.log2(x / ((x + other.get(k, 0)) / 2)) for one, other in ((p, q), (q, p)) for k, x in one.items())
    return math.sqrt(max(total, 0) / 2)


def test_quality_distances_against_counting(spark):
    texts = [*_prose("fr", 25), "Un \x01 mot ¿où? (été) [x] {y} " + "mot " * 3 + "«fin» 'ici' " * 2 + "le la les de du un une et à en " * 2]
    words, classes = [Counter(_plain_words(t)) for t in texts], [Counter(map(_plain_class, t.encode())) for t in texts]
    ranked = [n for _, n in sum(words, Counter()).most_common()]
    places = next(k for k in range(40, 0, -1) if ranked[k - 1] != ranked[k])  # no tie at the edge
    common = {w for w, _ in sum(words, Counter()).most_common(places)}
    rules = quality_divergence.Rules(common_words=places)
    docs = spark.createDataFrame([(i, t, "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_divergence.judge_quality(docs, rules=rules).collect()}
    inside = [not got[i].base_failed for i in range(len(texts))]
    binned = [Counter({w: c[w] for w in common}) + Counter({None: sum(n for w, n in c.items() if w not in common)}) for c in words]
    assert sum(inside) >= 25 and all(inside[:25])
    for i in range(len(texts)):
        for found, counts in ((got[i].word_distance, binned), (got[i].class_distance, classes)):
            others = sum((c for j, c in enumerate(counts) if j != i and inside[j]), Counter())
            assert found == pytest.approx(_plain_distance(counts[i], others), abs=1e-9)
