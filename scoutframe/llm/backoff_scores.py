"""Stupid-backoff language-model scores of all documents by all documents.

1. Documents are gathered to blocks of about ``block_bytes``; a block keeps its distinct words and its tokens as their
   numbers, from which its distinct n-grams (words and pairs of words) follow as a list sorted by hash.
2. The count table is partitioned by hash: each part gets from every block the stretch of its list that falls to the
   part, as one row, adds the counts up, and gives every block the totals of its n-grams back. Within a block an n-gram
   travels once, so a very frequent one costs a part one entry per block. The number of parts follows the number of
   tokens.
3. Each block joins its totals to its n-grams and sums the scores per document.

Scores leave the document itself out: its own occurrences are taken off all counts. A pair that occurs elsewhere
scores count(pair) / count(first word); one that does not backs off to ``alpha`` times the second word's share of all
tokens, and a word unseen elsewhere counts as half a token.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, narrow
from .textbytes import Slice, mix, owners, slices


@dataclass(frozen=True)
class Backoff:
    alpha: float = 0.4
    block_bytes: int = 12 << 20
    part_tokens: int = 2_000_000  # tokens for each part of the count table


def _pack(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(x.astype(kind)).tobytes(), 1)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _pairs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with the one before it in its document, and which tokens have one."""
    has = np.ones(len(words), dtype=bool)
    has[first[:-1][np.diff(first) > 0]] = False
    before = np.concatenate([words[:1], words[:-1]])
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + words)[has], has


_BLOCK = "keys binary, sizes binary, words binary, tokens binary, n_tokens long"


def _blocks(plan: Backoff):
    """mapInArrow step: documents as blocks. A block spells its distinct words once, in order of their hash."""

    def emit(keys, sizes, words, spelled):
        distinct, tokens = np.unique(np.concatenate(words), return_inverse=True)
        text = b"\n".join([spelled[w] for w in distinct.tolist()])
        columns = [_pack(np.array(keys, np.int64), "<i8"), _pack(np.concatenate(sizes), "<i8"), zlib.compress(text, 1), _pack(tokens, "<u4")]
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in columns), pa.array([len(tokens)], pa.int64())], names=names)

    def run(source):
        keys, sizes, words, spelled, held = [], [], [], {}, 0
        for batch in source:
            ids = batch.column("key").to_pylist()
            for i, j, s in slices(batch.column("text")):
                starts, ends, first = s.words()
                hashes = s.fingerprints(starts, ends, lower=True)
                distinct, at = np.unique(hashes, return_index=True)
                raw = s.data.tobytes()
                spelled.update((w, raw[a:b].lower()) for w, a, b in zip(distinct.tolist(), starts[at].tolist(), ends[at].tolist()))
                keys += ids[i:j]
                sizes.append(np.diff(first))
                words.append(hashes)
                held += len(s.data)
                if held >= plan.block_bytes:
                    yield emit(keys, sizes, words, spelled)
                    keys, sizes, words, spelled, held = [], [], [], {}, 0
        if keys:
            yield emit(keys, sizes, words, spelled)

    return run


def _grams(sizes: np.ndarray, words: bytes, tokens: bytes):
    """A block's distinct n-grams in order of their hash, the number of each token and of each pair, and the counts."""
    data = np.frombuffer(zlib.decompress(words), np.uint8)
    s = Slice(data, np.array([0, len(data)]))
    starts, ends, _ = s.words()
    word = s.fingerprints(starts, ends, lower=True)[_unpack(tokens, "<u4")] if len(starts) else np.zeros(0, np.uint64)
    pair, _ = _pairs(word, np.concatenate([[0], np.cumsum(sizes)]))
    grams, where, counts = np.unique(np.concatenate([word, pair]), return_inverse=True, return_counts=True)
    return grams, where[: len(word)], where[len(word) :], counts


def _part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the hash, so a sorted list falls into stretches, in the order of parts."""
    return (((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _stretches(parts: int):
    def run(source):
        for batch in source:
            for row in batch.to_pylist():
                block = row["block"]
                keys, _, _, n = _grams(_unpack(row["sizes"], "<i8"), row["words"], row["tokens"])
                bound = np.searchsorted(_part_of(keys, parts), np.arange(parts + 1))
                used = np.flatnonzero(np.diff(bound))
                for k in range(0, len(used), 256):
                    some = used[k : k + 256].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int64()),
                            pa.array([keys[bound[p] : bound[p + 1]].tobytes() for p in some], pa.binary()),
                            pa.array([_pack(n[bound[p] : bound[p + 1]], "<u4") for p in some], pa.binary()),
                        ],
                        names=["block", "part", "grams", "counts"],
                    )

    return run


def _count_part(table: pa.Table) -> pa.Table:
    """One part of the count table: totals over all blocks, handed back to each block in its own order."""
    lists = [np.frombuffer(x, "<u8") for x in table.column("grams").to_pylist()]
    counts = [_unpack(x, "<u4") for x in table.column("counts").to_pylist()]
    keys, where = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(where, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)[where]
    bounds = np.cumsum([len(x) for x in lists])[:-1]
    packed = [_pack(x, "<u8") for x in np.split(totals, bounds)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "totals": pa.array(packed, pa.binary())})


def _own(doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """For each token how often its n-gram occurs in its document."""
    _, where, counts = np.unique((doc.astype(np.uint64) << np.uint64(32)) | gram.astype(np.uint64), return_inverse=True, return_counts=True)
    return counts[where]


def document_scores(sizes: np.ndarray, word: np.ndarray, pair: np.ndarray, totals: np.ndarray, n_all: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Per document the sum of log scores of its tokens, and the number of tokens that back off."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    doc = owners(first)
    has = np.ones(len(word), dtype=bool)
    has[first[:-1][sizes > 0]] = False
    others = (n_all - sizes)[doc].astype(float)
    alone = totals[word] - _own(doc, word)
    share = np.maximum(alone, 0.5) / np.maximum(others, 1)
    score = np.log(share)
    at = np.flatnonzero(has)
    together = totals[pair] - _own(doc[at], pair)
    seen = together > 0
    backs = np.zeros(len(word), dtype=bool)
    backs[at[~seen]] = True
    score[at[seen]] = np.log(together[seen] / alone[at[seen] - 1])
    score[backs] += np.log(alpha)
    return np.bincount(doc, weights=score, minlength=len(sizes)).astype(float), np.bincount(doc, weights=backs, minlength=len(sizes)).astype(np.int64)


def _score(n_all: int, alpha: float):
    def run(source):
        for batch in source:
            for row in batch.to_pylist():
                totals = np.concatenate([_unpack(x["totals"], "<u8") for x in sorted(row["parts"], key=lambda x: x["part"])]).astype(np.int64) if row["parts"] else np.zeros(0, np.int64)
                keys, sizes = _unpack(row["keys"], "<i8"), _unpack(row["sizes"], "<i8")
                _, word, pair, _ = _grams(sizes, row["words"], row["tokens"])
                sums, backs = document_scores(sizes, word, pair, totals, n_all, alpha)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes), pa.array(sums), pa.array(backs)], names=["key", "n_words", "log_score", "n_backoff"])

    return run


def backoff_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plan: Backoff = Backoff()) -> DataFrame:
    """One row per document: id, n_words, log_score (sum of natural logs), n_backoff and mean_log_score.

    Words are cut at ASCII white space, A-Z in lower case. Defined results: NULL or empty text has 0 words, a log score of
    0 and a NULL mean; rows with a NULL id are left out of the result and of the counts; repeated rows are documents of
    their own; an empty table gives no rows; other columns are ignored. ids are integers.
    """
    own = narrow(docs, key=id_column, text=text_column).withColumn("key", F.col("key").cast("long")).where("key is not null")
    blocks = durable(own.mapInArrow(_blocks(plan), _BLOCK)).withColumn("block", F.monotonically_increasing_id())
    n_all = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-n_all // plan.part_tokens))
    stretches = blocks.select("block", "sizes", "words", "tokens").mapInArrow(_stretches(parts), "block long, part long, grams binary, counts binary")
    totals = stretches.groupBy("part").applyInArrow(_count_part, "block long, part long, totals binary")
    back = totals.groupBy("block").agg(F.collect_list(F.struct("part", "totals")).alias("parts"))
    joined = blocks.select("block", "keys", "sizes", "words", "tokens").join(back, "block", "left")
    scored = joined.mapInArrow(_score(n_all, plan.alpha), "key long, n_words long, log_score double, n_backoff long")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("key").alias(id_column), "n_words", "log_score", "n_backoff", mean.alias("mean_log_score"))
