"""Near-duplicate documents by HyperMinHash registers.

One hash places a shingle in a bucket; the bucket's register keeps of its smallest value the number of leading zeros
and some mantissa bits. Empty registers borrow from others by a fixed sequence of places, so sets of any size have all
registers. Groups of registers are bands; documents that agree in a band are candidates.

1. Documents with equal sets are one class and are represented by a row of their smallest id.
2. In each crowded band bucket every member is held against two centres, the smallest id and the member that shares
   most buckets (of a group of edited copies usually the original). Candidates pass the Jaccard estimate, corrected for
   chance agreement of registers, and are then confirmed on full sets. A hot bucket gives rows, not pairs.
3. Members of a bucket that are still in different components meet in blocks of bounded size. A pair is tried in the
   first band that it shares only, not if it is connected by then, and on full sets. So no candidate pair that could
   join two components goes untried, and only links leave a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import connected
from .durable import durable, narrow
from .shingles import shingle_sets
from .sieve import sieve, sieve_out
from .textbytes import mix, owners, signed, slices


@dataclass(frozen=True)
class Sketch:
    width: int = 2  # words in a shingle
    percent: int = 80  # least Jaccard similarity
    bands: int = 32
    rows: int = 5  # registers in a band; a pair at 0.8 misses all bands with odds of 3e-6
    mantissa: int = 10
    block: int = 2_048  # members of one side of a block
    block_bytes: int = 16 << 20  # and bytes of their sets, on average

    @property
    def registers(self) -> int:
        return self.bands * self.rows


_VALUE_BITS = 44
_EMPTY = np.uint16(0xFFFF)


def registers_of(sets: np.ndarray, first: np.ndarray, k: int, mantissa: int) -> np.ndarray:
    """Documents x registers; rows of empty sets hold only the empty mark."""
    n = len(first) - 1
    doc = owners(first).astype(np.uint64)
    value = mix(sets + np.uint64(0x51ED270B0B2C9A3D))
    bucket = ((value >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    low = mix(value) >> np.uint64(64 - _VALUE_BITS)
    out = np.full((n, k), _EMPTY, dtype=np.uint16)
    if len(sets):
        cell = doc * np.uint64(k) + bucket
        packed = (cell << np.uint64(_VALUE_BITS)) | low  # 4096 documents x 256 registers fill 20 bits
        packed.sort()
        cell = packed >> np.uint64(_VALUE_BITS)
        least = np.append(True, cell[1:] != cell[:-1])
        smallest = (packed[least] & np.uint64((1 << _VALUE_BITS) - 1)).astype(np.float64)
        fraction, exponent = np.frexp(smallest)
        zeros = np.where(smallest > 0, _VALUE_BITS - exponent, _VALUE_BITS)
        bits = np.where(smallest > 0, ((fraction - 0.5) * (2 << mantissa)).astype(np.int64), 0)
        out.reshape(-1)[cell[least].astype(np.int64)] = (zeros << mantissa) | bits
    return _borrow(out)


def _borrow(registers: np.ndarray) -> np.ndarray:
    """Fill empty registers: place j asks the places hash(attempt, j) in turn until one has a value of its own."""
    k = registers.shape[1]
    out, full = registers.copy(), registers != _EMPTY
    row, place = np.nonzero(~full & full.any(axis=1, keepdims=True))
    attempt = 0
    while len(row):
        asked = (mix(np.arange(k, dtype=np.uint64) + np.uint64(attempt * 65536 + 7)) % np.uint64(k)).astype(np.int64)[place]
        has = full[row, asked]
        out[row[has], place[has]] = registers[row[has], asked[has]]
        row, place = row[~has], place[~has]
        attempt += 1
    return out


def band_codes(registers: np.ndarray, bands: int) -> np.ndarray:
    parts = registers.reshape(len(registers), bands, -1).astype(np.uint64)
    code = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(parts.shape[2]):
        code = mix(code + parts[:, :, r])
    return code


def _digests(sets: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two per document, which together name its set."""
    out = []
    for seed in (0x1234567, 0x89ABCDE):
        total = np.zeros(len(sets) + 1, dtype=np.uint64)
        np.cumsum(mix(sets + np.uint64(seed)), out=total[1:])
        out.append(signed(np.diff(total[first])))
    return out


_SAME = ["n_shingles", "digest_a", "digest_b"]
_SKETCHED = "key long, n_shingles long, digest_a long, digest_b long, codes array<long>, registers binary"


def _sketch(plan: Sketch):
    def run(source):
        for batch in source:
            for i, j, s in slices(batch.column("text")):
                sets, first = shingle_sets(s, plan.width)
                registers = registers_of(sets, first, plan.registers, plan.mantissa)
                codes = signed(band_codes(registers, plan.bands).reshape(-1))
                digests = _digests(sets, first)
                raw = registers.tobytes()
                step = 2 * plan.registers
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(i, j - i), pa.array(np.diff(first)), pa.array(digests[0]), pa.array(digests[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1, dtype=np.int32) * plan.bands), pa.array(codes)),
                        pa.array([raw[a : a + step] for a in range(0, len(raw), step)], pa.binary()),
                    ],
                    names=["key", "n_shingles", "digest_a", "digest_b", "codes", "registers"],
                )

    return run


def _full_sets(width: int):
    """mapInArrow step: (key, text, size and digests of the wanted set) -> (key, members), if the text has that set."""

    def run(source):
        for batch in source:
            wanted = [batch.column(c).to_numpy() for c in _SAME]
            for i, j, s in slices(batch.column("text")):
                sets, first = shingle_sets(s, width)
                own = [np.diff(first), *_digests(sets, first)]
                hit = pa.array(np.logical_and.reduce([x == w[i:j] for x, w in zip(own, wanted)]))
                raw = sets.tobytes()
                members = pa.array([raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i).filter(hit), members.filter(hit)], names=["key", "members"])

    return run


def _with_digests(width: int, text_column: str):
    """mapInArrow step: rows with the size and the digests of their sets behind the other columns."""

    def run(source):
        for batch in source:
            for i, j, s in slices(batch.column(text_column)):
                sets, first = shingle_sets(s, width)
                rows = batch.slice(i, j - i)
                made = [pa.array(x) for x in (np.diff(first), *_digests(sets, first))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*rows.schema.names, *(f"__{c}" for c in _SAME)])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """On full sets: 100 * shared >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def least_agreement(plan: Sketch, n: np.ndarray) -> np.ndarray:
    """Share of equal registers below which a pair is taken as dissimilar, for sets of n shingles.

    Registers of different minima agree by chance with odds of about 2**-mantissa / 3, which is corrected for; five
    standard deviations are left for the sampling error, which borrowed registers of small sets do not lessen.
    """
    chance, t = 2.0**-plan.mantissa / 3, plan.percent / 100
    margin = 5 * np.sqrt(t * (1 - t) / np.minimum(np.maximum(n, 1), plan.registers))
    return (t - margin) * (1 - chance) + chance


def _confirm(plan: Sketch):
    """mapInArrow step: candidate pairs with registers and full sets of both -> links."""

    def run(source):
        for batch in source:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, plan.registers) for c in ("registers_a", "registers_b"))
            left, right = batch.column("members_a"), batch.column("members_b")
            n = np.minimum(*(np.array([len(x.as_buffer()) for x in side]) // 8 for side in (left, right)))
            keep = (a == b).mean(axis=1) >= least_agreement(plan, n)
            keep[keep] = [similar(np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64), plan.percent) for k in np.flatnonzero(keep).tolist()]
            chosen = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], names=["a", "b"])

    return run


def _block_links(plan: Sketch):
    """applyInPandas step: all pairs of two blocks of one bucket that could join two components -> links."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        rows = rows.sort_values("key", ignore_index=True)
        low, high, band = rows["low"].iloc[0], rows["high"].iloc[0], int(rows["band"].iloc[0])
        side = rows["block"].to_numpy()
        component, keys = rows["component"].tolist(), rows["key"].tolist()
        registers = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(len(rows), -1)
        codes = np.array(rows["codes"].tolist(), dtype=np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in rows["members"]]
        sizes = np.array([len(x) for x in sets])
        links = []
        for i in range(len(rows)):
            other = np.arange(i + 1, len(rows))
            if low != high:
                other = other[side[other] != side[i]]
            if band:  # pairs that share an earlier band are tried there
                other = other[~(codes[other, :band] == codes[i, :band]).any(axis=1)]
            n = np.minimum(sizes[other], sizes[i])
            other = other[(registers[other] == registers[i]).mean(axis=1) >= least_agreement(plan, n)]
            for j in other.tolist():
                if root(component[i]) != root(component[j]) and similar(sets[i], sets[j], plan.percent):
                    parent[root(component[j])] = root(component[i])
                    links.append((keys[i], keys[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plan: Sketch = Sketch()) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links) and kept.

    ids are integers. Words are cut at ASCII white space, A-Z in lower case. Defined results: documents with NULL or
    empty text, or without words, have an empty set and are linked with nothing; documents with a NULL id are not
    linked, their component is NULL and they are kept; rows that repeat an id are linked as any others, under that id, each by its own text;
    an empty table gives no rows; other columns are ignored.
    """
    out = _labelled(docs, id_column, text_column, plan)
    return out.select(F.col("key").alias(id_column), "n_shingles", "component_id", "kept")


def _labelled(docs: DataFrame, id_column: str, text_column: str, plan: Sketch) -> DataFrame:
    """(key, n_shingles, digest_a, digest_b, component_id, kept) per document; key is the id.

    Classes of equal sets have numbers, which stand for them up to the end: an id may have several sets.
    """
    own = narrow(docs, key=id_column, text=text_column)
    own = own.withColumn("key", F.col("key").cast("long"))
    sketched = durable(own.mapInArrow(_sketch(plan), _SKETCHED))
    same = _SAME
    usable = sketched.where("n_shingles > 0 and key is not null")
    classes = usable.groupBy(*same).agg(F.min("key").alias("least_id"))
    classes = durable(classes.withColumn("key", F.monotonically_increasing_id()))
    first = usable.withColumnRenamed("key", "least_id").join(classes, [*same, "least_id"]).dropDuplicates(["key"])
    first = first.select("key", "codes", "registers")

    placed = first.select("key", F.posexplode("codes").alias("band", "code"))
    crowded = placed.groupBy("band", "code").agg(F.count("*").alias("size"), F.min("key").alias("smallest")).where("size > 1")
    crowded = durable(placed.join(crowded, ["band", "code"]))
    shared = crowded.groupBy("key").agg(F.sum("size").alias("shared"))
    centres = crowded.join(shared, "key").groupBy("band", "code").agg(F.max(F.struct("shared", (-F.col("key")).alias("other_end"))).alias("best"))
    centres = centres.select("band", "code", (-F.col("best.other_end")).alias("centre"))
    stars = crowded.join(centres, ["band", "code"]).select("key", F.explode(F.array("smallest", "centre")).alias("centre")).where("key <> centre")
    pairs = durable(stars.select(F.greatest("key", "centre").alias("a"), F.least("key", "centre").alias("b")).distinct())

    involved = durable(crowded.select("key").distinct())
    chosen = durable(classes.join(involved, "key", "left_semi"))
    texts = sieve(own.where("key is not null").withColumnRenamed("key", "least_id"), chosen, ["least_id"]).join(chosen, "least_id")
    full = texts.mapInArrow(_full_sets(plan.width), "key long, members binary")
    # a class may be found in several rows of its least id, with the same set
    full = durable(first.select("key", "codes", "registers").join(full.groupBy("key").agg(F.first("members").alias("members")), "key"))
    a = full.select(F.col("key").alias("a"), F.col("registers").alias("registers_a"), F.col("members").alias("members_a"))
    b = full.select(F.col("key").alias("b"), F.col("registers").alias("registers_b"), F.col("members").alias("members_b"))
    links = durable(pairs.join(a, "a").join(b, "b").mapInArrow(_confirm(plan), "a long, b long"))
    component = durable(connected(links))

    labelled = crowded.where("size > 2").select("band", "code", "key").join(component, "key", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "key"))
    split = labelled.groupBy("band", "code").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    apart = labelled.join(split.where("least <> most").select("band", "code"), ["band", "code"])
    apart = durable(apart.join(full.select("key", F.length("members").alias("bytes")), "key"))
    split = apart.groupBy("band", "code").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("size") / plan.block, F.col("bytes") / plan.block_bytes)).cast("int")
    open_rows = apart.drop("bytes").join(split.select("band", "code", blocks.alias("blocks")), ["band", "code"])
    open_rows = open_rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    open_rows = open_rows.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_rows = open_rows.select("band", "code", "key", "component", "block", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"))
    met = open_rows.join(full, "key").groupBy("band", "code", "low", "high").applyInPandas(_block_links(plan), "a long, b long")
    more = durable(met.unionByName(component.select(F.col("key").alias("a"), F.col("component").alias("b"))))
    component = connected(more)

    # the numbers of components become their smallest ids
    inside = component.unionByName(component.select(F.col("component").alias("key"), "component")).distinct()
    inside = inside.join(classes.select("key", "least_id"), "key")
    smallest = inside.groupBy("component").agg(F.min("least_id").alias("smallest_id"))
    inside = inside.join(smallest, "component").select("key", "smallest_id")
    label = classes.join(inside, "key", "left").select(*same, F.coalesce("smallest_id", "least_id").alias("component"))
    out = sketched.select("key", *same).join(label, same, "left")
    component_id = F.when(F.col("key").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("key")))
    out = out.select("key", *same, component_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plan: Sketch = Sketch(width=5)) -> DataFrame:
    """The rows of docs without the near duplicates: of each component the row with the smallest id stays.

    Rows without a word are linked with nothing and stay. If ids repeat, one row of each id and set stays, and a verdict
    holds for the set it was given to.
    """
    verdicts = durable(_labelled(docs, id_column, text_column, plan).select(F.col("key").alias("__sieve_key"), *_SAME, "kept"))
    dropped = verdicts.where("not kept").select("__sieve_key").distinct()
    repeated = verdicts.where("__sieve_key is not null").groupBy("__sieve_key").count().where("count > 1").select("__sieve_key")
    keyed = docs.withColumn("__sieve_key", F.col(f"`{id_column}`").cast("long"))
    columns = [f"`{c}`" for c in docs.columns]
    if not repeated.limit(1).count():
        # the few rows that the sieve holds back go through the exact join, the others are not moved
        left = sieve_out(keyed, dropped, ["__sieve_key"]).unionByName(sieve(keyed, dropped, ["__sieve_key"]).join(dropped, "__sieve_key", "left_anti"))
        return left.select(*columns)
    touched = durable(dropped.union(repeated).distinct())
    held = sieve(keyed, touched, ["__sieve_key"])
    named = [f"__{c}" for c in _SAME]
    schema = StructType([*held.schema.fields, *(StructField(c, LongType()) for c in named)])
    held = held.mapInArrow(_with_digests(plan.width, text_column), schema).dropDuplicates(["__sieve_key", *named])
    gone = verdicts.where("not kept").select("__sieve_key", *[F.col(c).alias(f"__{c}") for c in _SAME]).distinct()
    held = held.join(gone, ["__sieve_key", *named], "left_anti")
    return sieve_out(keyed, touched, ["__sieve_key"]).select(*columns).unionByName(held.select(*columns))
