"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

A byte goes if a ``length``-byte string covers it that also starts elsewhere, in this text or in another one. Only
suffixes that can have such a partner are sorted, one bucket at a time:

``length`` is PERIOD bytes or more.

1. The bucket of a suffix is the least fingerprint (leftmost on ties) among the short strings inside its first ``length``
   bytes. Equal strings have equal buckets, at the same distance from their start. Consecutive suffixes of one bucket form
   a *run*: a stretch of text that is stored and compared once.
2. Runs that are equal are counted by digest and represented by one of them; all suffixes of a run that occurs twice
   have a partner. Buckets that occur once have none, and those with a single distinct run no other.
3. The runs of the other buckets are sorted bucket by bucket: suffixes by their first ``PERIOD`` bytes, and long ties by
   the ranks of the difference-cover sample, which are made beforehand for the bucket by doubling (1, 2, 4, ... periods).
   The cover holds for any two suffixes a shift at which both are sampled, so only one position in seven is ranked.
   Memory is bounded by the bucket; buckets with more than ``bucket_runs`` distinct runs are compared as rows instead,
   each suffix by a digest of its string, in a grouped count that Spark spreads.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, narrow
from .sieve import sieve, sieve_out
from .textbytes import Slice, inverse_powers, mix, signed, slices

# A perfect difference set modulo 57, every remainder is the difference of two members.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)


@dataclass(frozen=True)
class Repeats:
    length: int = 400
    seed_bytes: int = 64  # strings whose fingerprint names the bucket
    bucket_runs: int = 8_192


def _shift_table() -> np.ndarray:
    """shift[i, j]: least s in 1..PERIOD such that i + s and j + s are both in the cover (modulo PERIOD)."""
    member = np.zeros(PERIOD, dtype=bool)
    member[list(COVER)] = True
    table = np.zeros((PERIOD, PERIOD), dtype=np.int64)
    at = np.arange(PERIOD)
    for s in range(PERIOD, 0, -1):
        inside = member[(at + s) % PERIOD]
        table[np.ix_(inside, inside)] = s
    return table


SHIFT = _shift_table()
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of keys[i:i + width] for each i; beyond the end the largest value stands."""
    n = len(keys)
    padded = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], upto[width - 1 : width - 1 + n])


def runs(s: Slice, plan: Repeats) -> dict[str, np.ndarray]:
    """All runs of a slice: doc, bucket, two digests, begin (in the document), n (suffixes) and at (distance to the seed)."""
    k, length = plan.seed_bytes, plan.length
    sizes, n = np.diff(s.offsets), len(s.data)
    empty = {name: np.zeros(0, np.int64) for name in ("doc", "begin", "n", "at")} | {name: np.zeros(0, np.uint64) for name in ("bucket", "a", "b")}
    if not (sizes >= length).any():
        return empty
    prefix = s.prefix()
    value = (prefix[k:] - prefix[:-k]) * inverse_powers(n)[: n - k + 1] * np.uint64(0x9E3779B97F4A7C15)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = _sliding_least((value & ~low) | np.arange(len(value), dtype=np.uint64), length - k + 1)
    has = np.minimum(np.maximum(sizes - length + 1, 0), sizes)
    valid = np.repeat(np.tile([True, False], len(sizes)), np.stack([has, sizes - has], axis=1).ravel())[: len(least)]
    start = np.flatnonzero(valid)
    seed = (least[start] & low).astype(np.int64)
    new = np.append(True, (seed[1:] != seed[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, seed = start[first], seed[first]
    end = begin + count - 1 + length
    doc = np.searchsorted(s.offsets, begin, side="right") - 1
    at = seed - begin
    tag = mix(at.astype(np.uint64))
    return {
        "doc": doc, "begin": begin - s.offsets[doc], "n": count, "at": at,
        "bucket": s.fingerprints(seed, seed + k, prefix=prefix),
        "a": s.fingerprints(begin, end, prefix=prefix) ^ tag,
        "b": s.fingerprints(begin, end, seed=1) ^ tag,
    }


_RUN = "array<struct<bucket: bigint, a: bigint, b: bigint, begin: int, n: int, at: int>>"
_RUN_TYPE = pa.list_(pa.struct([("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("begin", pa.int32()), ("n", pa.int32()), ("at", pa.int32())]))


def _find_runs(plan: Repeats):
    def run(source):
        for batch in source:
            for i, j, s in slices(batch.column("text")):
                found = runs(s, plan)
                first = np.searchsorted(found["doc"], np.arange(s.n + 1))
                fields = [pa.array(signed(found[c])) for c in ("bucket", "a", "b")] + [pa.array(found[c].astype(np.int32)) for c in ("begin", "n", "at")]
                rows = pa.StructArray.from_arrays(fields, fields=list(_RUN_TYPE.value_type))
                whole = [signed(s.fingerprints(s.offsets[:-1], s.offsets[1:], seed=seed)) for seed in (0, 1)]
                raw = s.data.tobytes()
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(i, j - i), pa.array(np.diff(s.offsets)), pa.array(whole[0]), pa.array(whole[1]), pa.array(sha),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), rows),
                    ],
                    names=["key", "n_bytes", "text_a", "text_b", "text_sha256", "runs"],
                )

    return run


def _cut_runs(plan: Repeats):
    """mapInArrow step: (text, wanted runs) -> one row per run with its bytes."""

    def run(source):
        for batch in source:
            out = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = text.encode()
                out.extend((w["bucket"], w["a"], w["b"], w["n"], w["at"], w["twice"], raw[w["begin"] : w["begin"] + w["n"] - 1 + plan.length]) for w in wanted)
            names = ["bucket", "a", "b", "n", "at", "twice", "stretch"]
            types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.bool_(), pa.binary()]
            for k in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 4096]), types)], names=names)

    return run


_CUT = "bucket long, a long, b long, n int, at int, twice boolean, stretch binary"


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks, equal for equal keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), dtype=np.uint64)
    out[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])).astype(np.uint64)
    return out


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _ranks((left << np.uint64(32)) | right)


def partners(stretches: list[bytes], n: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch the numbers of its suffixes (0 to n - 1) whose first ``length`` bytes start another suffix too.

    Stretches are laid out so that their seeds lie on multiples of PERIOD: equal strings have equal distances to the
    seed, so any two suffixes that could be equal have one remainder, and the cover's shift for it serves both. A string
    is its first period, the sampled periods behind the shift, and its last two periods, which together cover it.
    """
    if length < PERIOD:
        raise ValueError(f"strings of fewer than {PERIOD} bytes are not compared")
    room = PERIOD * -(-(max(len(x) for x in stretches) + 2 * PERIOD) // PERIOD)
    sizes = np.array([len(x) for x in stretches])
    lead = (-at) % PERIOD
    step = PERIOD * -(-(sizes + lead + PERIOD) // PERIOD)
    base = np.cumsum(step) - step + lead
    data = np.zeros(int(step.sum()) + room + length, dtype=np.uint8)
    for a, x in zip(base.tolist(), stretches):
        data[a : a + len(x)] = np.frombuffer(x, np.uint8)
    m = int(step.sum())
    # ranks of the first 8, 16, 32 and PERIOD bytes at every place, in the order of bytes
    word = np.zeros(m + 32, dtype=np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | data[k : k + m + 32]
    r = _ranks(word)
    for half, more in ((8, 8), (16, 16), (32, PERIOD - 32)):
        keep = m + 32 - {8: 8, 16: 24, 32: 32}[half]
        r = _pair(r[:keep], r[more : more + keep] if more + keep <= len(r) else np.append(r[more:], np.zeros(more + keep - len(r), np.uint64)))
    periods = (length - PERIOD) // PERIOD  # so many whole periods fit behind any shift
    r = np.append(r[:m], np.zeros((periods + 3) * PERIOD, np.uint64))
    suffix = np.repeat(base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    remainder = suffix % PERIOD
    shifted = suffix + SHIFT[remainder, remainder]
    # the shift depends on the remainder, so what is compared behind it is one string only for one remainder
    whole = _pair(r[suffix], remainder.astype(np.uint64))
    for closing in (length - PERIOD, max(length - 2 * PERIOD, 0)):
        whole = _pair(whole, r[suffix + closing])
    # the sample: ranks of 1, 2, 4, ... periods at the places of the cover; those that add up to ``periods`` are put together
    sample, span, at_period = np.flatnonzero(_IN_COVER[np.arange(m) % PERIOD]), 1, 0
    ranked = r
    while periods:
        if periods & 1:
            whole = _pair(whole, ranked[shifted + at_period * PERIOD])
            at_period += span
        periods >>= 1
        if periods:
            doubled = np.zeros_like(ranked)
            ahead = np.minimum(sample + span * PERIOD, len(ranked) - 1)
            doubled[sample] = _pair(ranked[sample], ranked[ahead])
            ranked, span = doubled, 2 * span
    twice = np.bincount(whole.astype(np.int64))[whole.astype(np.int64)] > 1
    of = np.repeat(np.arange(len(n)), n)[twice]
    number = (suffix - np.repeat(base, n))[twice]
    return np.split(number, np.searchsorted(of, np.arange(1, len(n))))


def _merge(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches covered by [start, start + width) for rising starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + width).tolist()))


_SPANS = "array<struct<begin: int, end: int>>"
_SPANS_TYPE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _sort_buckets(plan: Repeats, hold_bytes: int = 1 << 19):
    """mapInArrow step over rows in order of bucket: whole buckets are gathered to about hold_bytes and sorted together."""

    def solve(held):
        names = [h[:3] for h in held]
        found = partners([h[6] for h in held], np.array([h[3] for h in held]), np.array([h[4] for h in held]), plan.length)
        rows = [(*name, [{"begin": x, "end": y} for x, y in _merge(numbers, plan.length)]) for name, numbers in zip(names, found) if len(numbers)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), _SPANS_TYPE))], names=["bucket", "a", "b", "spans"]
        )

    def run(source):
        held, size = [], 0
        for batch in source:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "a", "b", "n", "at", "twice", "stretch"))):
                if held and size >= hold_bytes and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)

    return run


def _suffix_names(plan: Repeats):
    """mapInArrow step for crowded buckets: one row per suffix with a 128-bit name of its string."""

    def run(source):
        for batch in source:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "a", "b", "n", "stretch"))))
            for k in range(0, len(rows), 1024):
                part = rows[k : k + 1024]
                s = Slice(np.frombuffer(b"".join(r[4] for r in part), np.uint8), np.concatenate([[0], np.cumsum([len(r[4]) for r in part])]))
                n = np.array([r[3] for r in part])
                of = np.repeat(np.arange(len(part)), n)
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = s.offsets[:-1][of] + number
                columns = [np.array([r[c] for r in part], dtype=np.int64)[of] for c in range(3)]
                names = [signed(s.fingerprints(start, start + plan.length, seed=seed)) for seed in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (*columns, number.astype(np.int32), *names)], names=["bucket", "a", "b", "number", "name_a", "name_b"]
                )

    return run


_KEY = "struct<id: bigint, row: bigint, named: boolean>"


def _numbered(docs: DataFrame, id_column: str, name: str) -> DataFrame:
    """docs with a key of each row's own: its id; rows whose id is NULL or repeated have numbers that are written down with them."""
    number = F.col(f"`{id_column}`").cast("long")
    zero = F.lit(0).cast("long")
    named = docs.where(number.isNotNull()).withColumn("__id", number)
    often = durable(named.groupBy("__id").agg(F.count("*").alias("__times")).where("__times > 1").select("__id"))
    # of rows with a unique id a few may be numbered too: the sieve lets all others through
    plain = F.struct(F.col("__id").alias("id"), zero.alias("row"), F.lit(True).alias("named"))
    single = sieve_out(named, often, ["__id"]).withColumn(name, plain).drop("__id")
    repeated = sieve(named, often, ["__id"]).drop("__id").unionByName(docs.where(number.isNull()))
    own = F.struct(F.coalesce(number, zero).alias("id"), (F.monotonically_increasing_id() + 1).alias("row"), number.isNotNull().alias("named"))
    return single.unionByName(durable(repeated.withColumn(name, own)))


def _id_of(key: str):
    return F.when(F.col(f"{key}.named"), F.col(f"{key}.id"))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plan: Repeats = Repeats()) -> DataFrame:
    """(key, n_bytes, text_sha256, spans), key being the id: the maximal removed runs of bytes of each text, in order.

    ids are integers. Defined results: NULL and empty text have 0 bytes and no spans, as has any text shorter than
    ``length``; a NULL id stays NULL and its text is compared and cut like any other; every row is a text of its own, also
    where ids repeat; an empty table gives no rows; other columns are ignored.
    """
    own = _numbered(narrow(docs, id=id_column, text=text_column), "id", "key").select("key", "text")
    return _spans(own, plan).select(_id_of("key").alias("key"), "n_bytes", "text_sha256", "spans")


def _spans(own: DataFrame, plan: Repeats) -> DataFrame:
    """As ``repeated_spans``, over (key, text) of ``_numbered``, whose keys stay."""
    found = durable(own.mapInArrow(_find_runs(plan), f"key {_KEY}, n_bytes long, text_a long, text_b long, text_sha256 string, runs {_RUN}"))
    same, run_id = ["n_bytes", "text_a", "text_b"], ["bucket", "a", "b"]
    texts = found.where(F.col("n_bytes") >= plan.length).groupBy(*same).agg(F.count("*").alias("copies"))
    copied = texts.where("copies > 1").select(*same)
    every = found.select("key", F.explode("runs").alias("r")).select("key", "r.*")
    # runs of buckets that occur once have no partner; the sieve leaves them where they are
    seen = every.groupBy("bucket").agg(F.count("*").alias("times")).where("times > 1").select("bucket")
    several = sieve(every, durable(seen), ["bucket"])

    distinct = durable(several.groupBy(*run_id).agg(F.count("*").alias("times"), F.min(F.struct("key", "begin", "n", "at")).alias("first")))
    buckets = durable(distinct.groupBy("bucket").agg(F.count("*").alias("distinct_runs")).where("distinct_runs > 1"))
    wanted = distinct.join(buckets, "bucket").select(*run_id, "first.*", (F.col("times") > 1).alias("twice"), "distinct_runs")
    by_text = durable(wanted.groupBy("key").agg(F.collect_list(F.struct(*run_id, "begin", "n", "at", "twice")).alias("wanted")))
    cut = durable(sieve(own, by_text, ["key"]).join(by_text, "key").select("text", "wanted").mapInArrow(_cut_runs(plan), _CUT))
    crowded = buckets.where(F.col("distinct_runs") > plan.bucket_runs).select("bucket")
    sorted_ = (
        cut.join(crowded, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket")
        .mapInArrow(_sort_buckets(plan), f"bucket long, a long, b long, spans {_SPANS}")
    )
    suffixes = cut.join(crowded, "bucket", "left_semi").mapInArrow(_suffix_names(plan), "bucket long, a long, b long, number int, name_a long, name_b long")
    names = suffixes.groupBy("name_a", "name_b").agg(F.count("*").alias("times")).where("times > 1")
    counted = suffixes.join(names, ["name_a", "name_b"], "left_semi").groupBy(*run_id)
    counted = counted.agg(F.collect_list(F.struct(F.col("number").alias("begin"), (F.col("number") + plan.length).cast("int").alias("end"))).alias("spans"))
    twice = distinct.where("times > 1").select(*run_id, F.array(F.struct(F.lit(0).alias("begin"), (F.col("first.n") - 1 + plan.length).cast("int").alias("end"))).alias("spans"))
    partly = sorted_.unionByName(counted).join(twice.select(*run_id), run_id, "left_anti")
    spans_of_runs = durable(twice.unionByName(partly))
    covered = sieve(several, spans_of_runs, run_id).join(spans_of_runs, run_id)
    covered = covered.select("key", F.expr("transform(spans, x -> struct(cast(x.begin + begin as int) as begin, cast(x.end + begin as int) as end))").alias("spans"))
    per_text = covered.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(_joined, f"key {_KEY}, spans {_SPANS}")
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_bytes").cast("int").alias("end")))
    out = found.select("key", "text_sha256", *same).join(copied.withColumn("is_copied", F.lit(True)), same, "left").join(per_text, "key", "left")
    spans = F.when(F.col("is_copied"), whole).otherwise(F.coalesce("spans", F.array().cast(_SPANS)))
    return out.select("key", "n_bytes", "text_sha256", spans.alias("spans"))


def _joined(source):
    """mapInArrow step: spans in any order -> maximal spans in order, those that touch made one."""
    for batch in source:
        spans = batch.column("spans")
        flat, ends = spans.flatten(), np.cumsum(pa.compute.list_value_length(spans).to_numpy())
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        begin, end = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        room = np.int64(int(end.max(initial=0)) + 2)  # texts lie one behind the other, apart from each other
        begin, end = begin + text * room, end + text * room
        order = np.argsort(begin, kind="stable")
        begin, reach = begin[order], np.maximum.accumulate(end[order])
        first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1])) if len(begin) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(begin))[: len(first)] - 1
        of = begin[first] // room
        rows = pa.StructArray.from_arrays([pa.array((x - of * room).astype(np.int32)) for x in (begin[first], reach[last])], fields=list(_SPANS_TYPE.value_type))
        offsets = np.searchsorted(of, np.arange(len(ends) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(offsets), rows)], names=["key", "spans"])


def _kept_digest(source):
    for batch in source:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, at, kept = text.encode(), 0, hashlib.sha256()
            for s in spans:
                kept.update(raw[at : s["begin"]])
                at = s["end"]
            kept.update(raw[at:])
            out.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out)], names=["key", "kept_sha256"])


def repeat_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plan: Repeats = Repeats()) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes that stay)."""
    own = _numbered(narrow(docs, id=id_column, text=text_column), "id", "key").select("key", "text")
    spans = durable(_spans(own, plan))
    removed = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.begin)")
    report = spans.select("key", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "text_sha256")
    partly = spans.where(removed.between(1, F.col("n_bytes") - 1)).select("key", "spans")
    partly = durable(partly)
    kept = sieve(own, partly, ["key"]).join(partly, "key").mapInArrow(_kept_digest, f"key {_KEY}, kept_sha256 string")
    report = report.join(kept, "key", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    sha = F.coalesce("kept_sha256", F.when((F.col("n_removed") > 0), nothing).otherwise(F.col("text_sha256")))
    return report.select(_id_of("key").alias(id_column), "n_bytes", "n_removed", "n_spans", sha.alias("kept_sha256"))


def _without(source):
    """Cut spans out of the text; a span's ends move inwards to whole characters."""
    for batch in source:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, at, kept = text.encode(), 0, []
            for s in spans:
                begin, end = s["begin"], s["end"]
                while begin < end and (raw[begin] & 0xC0) == 0x80:
                    begin += 1
                while end > begin and end < len(raw) and (raw[end] & 0xC0) == 0x80:
                    end -= 1
                kept.append(raw[at:begin])
                at = end
            kept.append(raw[at:])
            out.append(b"".join(kept).decode())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out)], names=["key", "kept_text"])


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plan: Repeats = Repeats()) -> DataFrame:
    """docs with repeated passages cut out of the text column; documents of which nothing stays are gone.

    Every row is a text of its own, also where ids are NULL or repeat; texts that lose nothing are not touched.
    """
    keyed = _numbered(docs, id_column, "__sieve_key")
    own = narrow(keyed, key="__sieve_key", text=text_column)
    spans = durable(_spans(own, plan).where("size(spans) > 0").select("key", "spans"))
    kept = sieve(own, spans, ["key"]).join(spans, "key").mapInArrow(_without, f"key {_KEY}, kept_text string").withColumnRenamed("kept_text", "__kept_text")
    named = spans.select(F.col("key").alias("__sieve_key"))
    touched = sieve(keyed, named, ["__sieve_key"]).join(kept.withColumnRenamed("key", "__sieve_key"), "__sieve_key", "left")
    whole = sieve_out(keyed, named, ["__sieve_key"]).drop("__sieve_key")
    text = F.coalesce("__kept_text", F.col(f"`{text_column}`"))
    columns = [f"`{c}`" for c in docs.columns]
    touched = touched.where("__kept_text is null or __kept_text <> ''").withColumn(text_column, text)
    return whole.select(*columns).unionByName(touched.select(*columns))
