"""Quality rules by distribution divergence.

A document's histogram of character classes, and its histogram over the most common words of its language with one bin
for all other words, are compared with the language's own by Jensen-Shannon distance. The references are counted over all documents of the
language that pass the basic rules. Documents below a least length are never rejected by a distance, since a
short text's histogram says little (the guard). A document's own words are taken off its reference first. A reference of few words says little too: the limits rise with the
chance in it, without a step, until no distance exceeds them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, narrow
from .textbytes import WHITE, Slice, owners, signed, slices, windows

# Byte classes. Letters beyond ASCII count with the lower-case letters' bytes of their own class.
CLASS_NAMES = ("lower", "upper", "digit", "space", "break", "stop", "quote", "symbol", "control", "beyond")
_SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    kind = np.full(256, CLASS_NAMES.index("symbol"), dtype=np.int8)
    for name, members in (
        ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (32, 9)), ("break", (10, 13)),
        ("stop", b".,;:!?-"), ("quote", b"'\"()`"), ("control", (*range(0, 9), 11, 12, *range(14, 32), 127)), ("beyond", range(128, 256)),
    ):
        kind[list(members)] = CLASS_NAMES.index(name)
    return kind


_CLASS_OF = _classes()
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(_SYMBOLS)] = True


@dataclass(frozen=True)
class Rules:
    """Parameters of the verdict; the defaults are those of the query."""

    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    guard_words: int = 40  # no verdict by a distance below this many words
    max_class_distance: float = 0.30
    max_word_distance: float = 0.27  # for long texts; short ones stray by chance, see word_limit
    word_chance: tuple[float, float] = (0.11, 2.45)  # fitted on labelled rows: a + b / sqrt(n_words)
    most_word_distance: float = 0.41  # what texts without any common word exceed, in most languages
    common_words: int = 40  # words in a language's word histogram


def base_counts(s: Slice, window: int = 8) -> dict[str, np.ndarray]:
    """Per document of a slice: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    starts, ends, first = s.words()
    code_points = np.zeros(len(s.data) + 1, dtype=np.int64)
    np.cumsum(((s.data & 0xC0) != 0x80) & ~WHITE[s.data], out=code_points[1:])
    symbols = np.zeros(len(s.data) + 1, dtype=np.int64)
    np.cumsum(_IS_SYMBOL[s.data], out=symbols[1:])
    prefix = s.prefix()
    words = s.fingerprints(starts, ends, prefix=prefix)
    return {
        "n_words": np.diff(first),
        "word_chars": np.diff(code_points[s.offsets]),
        "n_symbols": np.diff(symbols[s.offsets]),
        "n_dup_lines": _repeated_lines(s, prefix, starts),
        "n_repeat_words": _repeated_words(words, first, window),
        "_words": words,
        "_first": first,
    }


def _repeated_lines(s: Slice, prefix: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    breaks = np.flatnonzero(s.data == 10)
    begin = np.concatenate([s.offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(s.n), np.searchsorted(s.offsets, breaks, side="right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    stop = np.append(begin[1:] - 1, len(s.data))
    last = np.append(doc[1:] != doc[:-1], True)
    stop = np.where(last, s.offsets[doc + 1], stop)
    with_word = np.searchsorted(word_starts, stop) > np.searchsorted(word_starts, begin)
    begin, stop, doc = begin[with_word], stop[with_word], doc[with_word]
    key = s.fingerprints(begin, stop, prefix=prefix)
    order = np.lexsort((begin, key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=s.n)


def _repeated_words(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    key, at = windows(words, first, width)
    doc = owners(first)[at]
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(order), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    delta = np.zeros(len(words) + 1, dtype=np.int64)
    hit = at[order[again]]
    np.add.at(delta, hit, 1)
    np.add.at(delta, hit + width, -1)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.cumsum(delta)[:-1] > 0, out=covered[1:])
    return np.diff(covered[first])


def _failed(n_words: np.ndarray, repeat: np.ndarray, rules: Rules) -> np.ndarray:
    return (n_words < rules.min_words) | (100 * repeat > rules.repeat_percent * n_words)


def class_counts(s: Slice) -> np.ndarray:
    """Documents x classes; bytes, which for letters beyond ASCII weighs them by their length."""
    doc = np.repeat(np.arange(s.n), np.diff(s.offsets))
    return np.bincount(doc * len(CLASS_NAMES) + _CLASS_OF[s.data], minlength=s.n * len(CLASS_NAMES)).reshape(s.n, -1)


def _lowered(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of words without case and without marks at either end, so that "The," counts as "the"."""
    starts, ends, first = s.words()
    mark = np.isin(_CLASS_OF[s.data], [CLASS_NAMES.index(x) for x in ("stop", "quote")])
    for _ in range(3):
        ends = ends - (mark[ends - 1] & (ends - starts > 1))
        starts = starts + (mark[starts] & (ends - starts > 1))
    return s.fingerprints(starts, ends, lower=True), starts, ends, first


def _reference_rows(rules: Rules):
    """mapInArrow step: a task's word counts by language, and its class counts; merged as the task goes."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def rows(found: dict):
        for (lang, kind), (keys, counts) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), kind, np.int8)), pa.array(signed(keys)), pa.array(counts)], schema=schema
            )

    def merge(found: dict, at: tuple, keys: np.ndarray, counts: np.ndarray) -> None:
        if at in found:
            keys, counts = np.concatenate([found[at][0], keys]), np.concatenate([found[at][1], counts])
        keys, where = np.unique(keys, return_inverse=True)
        found[at] = keys, np.bincount(where, weights=counts).astype(np.int64)

    def run(source):
        found: dict = {}
        for batch in source:
            langs = batch.column("lang").to_pylist()
            for i, j, s in slices(batch.column("text")):
                base = base_counts(s, rules.window)
                good = ~_failed(base["n_words"], base["n_repeat_words"], rules)
                words, _, _, first = _lowered(s)
                doc, classes = owners(first), class_counts(s)
                names = np.array(langs[i:j], dtype=object)
                for lang in set(names[good]) - {None}:
                    chosen = good & (names == lang)
                    keys, counts = np.unique(words[chosen[doc]], return_counts=True)
                    merge(found, (lang, 0), keys, counts)
                    merge(found, (lang, 1), np.arange(len(CLASS_NAMES), dtype=np.uint64), classes[chosen].sum(axis=0))
                    merge(found, (lang, 2), np.zeros(1, np.uint64), np.array([chosen[doc].sum()]))
            if sum(len(k) for k, _ in found.values()) > 1_000_000:  # bounded memory: hand over and begin anew
                yield from rows(found)
                found = {}
        yield from rows(found)

    return run


def word_limit(n_words: np.ndarray, rules: Rules) -> np.ndarray:
    """The largest word distance of a text of so many words that is kept, against a reference of endless words."""
    a, b = rules.word_chance
    return np.clip(a + b / np.sqrt(np.maximum(n_words, 1)), rules.max_word_distance, rules.most_word_distance)


def reference_chance(n_words: np.ndarray, rules: Rules) -> np.ndarray:
    """How far a reference of so many words strays from its language by chance: as a text of that length does."""
    return rules.word_chance[1] / np.sqrt(np.maximum(n_words, 1))


_REFERENCE = ("all_words", "words", "classes")


def references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per language: all_words, its common words and its character classes, both with counts.

    docs has text and lang. All documents that pass the basic rules are counted, in one pass, and added up by Spark;
    each language is counted by itself, however many there are. Rows without a language are not counted.
    """
    counted = docs.mapInArrow(_reference_rows(rules), "lang string, kind byte, key long, n long")
    counted = durable(counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    totals = counted.where("kind = 2").select("lang", F.col("n").alias("all_words"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    top = counted.where("kind = 0").withColumn("place", rank).where(f"place <= {rules.common_words}")
    pairs = F.sort_array(F.collect_list(F.struct("key", "n")))
    words = top.groupBy("lang").agg(pairs.alias("words"))
    classes = counted.where("kind = 1").groupBy("lang").agg(pairs.alias("classes"))
    return durable(totals.join(words, "lang").join(classes, "lang").select("lang", *_REFERENCE))


def _with_reference(docs: DataFrame, lang_column: str, known: DataFrame) -> DataFrame:
    """docs, then ``__reference`` of each row's language; NULL where it has none."""
    known = known.select(F.col("lang").alias("__reference_lang"), F.struct(*_REFERENCE).alias("__reference"))
    if known.count() <= 1000:  # about 1 KB each
        known = F.broadcast(known)
    return docs.join(known, F.col(f"`{lang_column}`") == F.col("__reference_lang"), "left").drop("__reference_lang")


def _counts(reference: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a language: its common words' fingerprints, their counts and then that of all other words, and the counts of
    the character classes."""
    keys = np.array([w["key"] for w in reference["words"]], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    words = np.array([w["n"] for w in reference["words"]], dtype=float)[order]
    by_class = np.zeros(len(CLASS_NAMES))
    for c in reference["classes"]:
        by_class[c["key"]] = c["n"]
    return keys[order], np.append(words, reference["all_words"] - words.sum()), by_class


def _against_others(own: np.ndarray, reference: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each row of counts to the reference less the row itself, where it is counted there, and what is left of
    the reference; NaN where nothing is left."""
    others = reference - own * counted[:, None]
    left = others.sum(axis=1)
    found = distance(own / np.maximum(own.sum(axis=1, keepdims=True), 1), others / np.maximum(left, 1)[:, None])
    return np.where(left > 0, found, np.nan), left


def _known(batch: pa.RecordBatch, langs: list) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The references of a batch's languages."""
    first: dict = {}
    for k, lang in enumerate(langs):
        first.setdefault(lang, k)
    found = {lang: batch.column("__reference")[k].as_py() for lang, k in first.items()}
    return {lang: _counts(r) for lang, r in found.items() if r is not None}


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of each row of p to q or to its row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "class_distance double, word_distance double, kept boolean"
)


def _verdicts(s: Slice, langs: list, known: dict, rules: Rules) -> dict[str, np.ndarray]:
    """All result columns of a slice's documents."""
    out = base_counts(s, rules.window)
    failed = _failed(out["n_words"], out["n_repeat_words"], rules)
    words, _, _, first = _lowered(s)
    doc, by_class = owners(first), class_counts(s).astype(float)
    class_distance, word_distance = np.full(s.n, np.nan), np.full(s.n, np.nan)  # NaN: no reference, and no verdict by it
    chance = np.zeros(s.n)
    names = np.array(langs, dtype=object)
    for lang in set(names) & set(known):
        keys, common, classes = known[lang]
        chosen = np.flatnonzero(names == lang)
        place = np.full(s.n, -1)
        place[chosen] = np.arange(len(chosen))
        own = place[doc] >= 0
        at = np.minimum(np.searchsorted(keys, words[own]), len(keys) - 1)
        hit = keys[at] == words[own]
        counts = np.bincount(place[doc[own][hit]] * len(keys) + at[hit], minlength=len(chosen) * len(keys)).reshape(len(chosen), -1)
        counts = np.hstack([counts, out["n_words"][chosen, None] - counts.sum(axis=1, keepdims=True)])
        class_distance[chosen], _ = _against_others(by_class[chosen], classes, ~failed[chosen])
        word_distance[chosen], left = _against_others(counts, common, ~failed[chosen])
        chance[chosen] = reference_chance(left, rules)
    guarded = out["n_words"] < rules.guard_words
    far = (class_distance > rules.max_class_distance + chance) | (word_distance > word_limit(out["n_words"], rules) + chance)
    return out | {"base_failed": failed, "class_distance": class_distance, "word_distance": word_distance, "kept": ~failed & (guarded | ~far)}


def _judge(rules: Rules):
    fields = [tuple(x.split()) for x in COLUMNS.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(source):
        for batch in source:
            langs = batch.column("lang").to_pylist()
            known = _known(batch, langs)
            for i, j, s in slices(batch.column("text")):
                out = _verdicts(s, langs[i:j], known, rules)
                made = [batch.column("key").slice(i, j - i), *(pa.array(out[n], type=kinds[k], from_pandas=True) for n, k in fields)]
                yield pa.RecordBatch.from_arrays(made, names=["key", *(n for n, _ in fields)])

    return run


def _keep(rules: Rules, text_column: str, lang_column: str):
    def run(source):
        for batch in source:
            langs = batch.column(lang_column).to_pylist()
            known = _known(batch, langs)
            rows = batch.select([n for n in batch.schema.names if n != "__reference"])
            for i, j, s in slices(batch.column(text_column)):
                yield rows.slice(i, j - i).filter(pa.array(_verdicts(s, langs[i:j], known, rules)["kept"]))

    return run


def keep_quality(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, with all their columns, that ``judge_quality`` keeps."""
    known = references(narrow(docs, text=text_column, lang=lang_column), rules)
    return _with_reference(docs, lang_column, known).mapInArrow(_keep(rules, text_column, lang_column), docs.schema)


def judge_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """One row per document: its counts, the two distances and the verdict ``kept``.

    Defined results: NULL or empty text has no words and fails the basic rules; where the language is NULL or no other
    document of it passes the basic rules, the distances are NULL and the basic rules alone decide; a NULL id stays NULL; repeated rows are judged one by one; an empty table gives no rows; other columns are ignored.
    """
    own = narrow(docs, key=id_column, text=text_column, lang=lang_column)
    known = references(own.select("text", "lang"), rules)
    kind = own.schema["key"].dataType.simpleString()
    judged = _with_reference(own, "lang", known).mapInArrow(_judge(rules), f"key {kind}, {COLUMNS}")
    return judged.withColumnRenamed("key", id_column)
