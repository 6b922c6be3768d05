"""Token counts of whole texts; huge texts are encoded as overlapping chunks and resynchronised.

A text longer than ``chunk_chars`` becomes chunks that each run ``overlap`` characters into the next, so its chunks
are encoded by different tasks. Two neighbours are spliced at a place inside their overlap where both encodings start
a token and the text has a stable boundary (white space after another character, see ``segment_memo``): no token of
the whole text reaches across such a place, so the tokens before it are the left chunk's and those after it are the
right chunk's. Where an overlap has no such place, the text is done again with an overlap (and, from there on, chunk)
``widen`` times as long, in the end as one chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, narrow
from .segment_memo import token_counts, tokenizer
from .textbytes import slices


@dataclass(frozen=True)
class Chunks:
    chunk_chars: int = 32_768
    overlap: int = 1_024
    widen: int = 8


def _count_whole(path: str):
    def run(source):
        for batch in source:
            for i, j, s in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(i, j - i), pa.array(np.diff(s.offsets)), pa.array(token_counts(s, path))], names=["key", "n_bytes", "n_tokens"]
                )

    return run


def boundaries(text: str, starts: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """(place, tokens before it) for all stable boundaries in [low, high) at which a token starts."""
    out, last = [], -1
    for before, at in enumerate(starts):
        if at != last and max(low, 1) <= at < high and text[at] in " \t\n\x0b\x0c\r" and not text[at - 1].isspace() and text[at - 1] != "\x85":
            out.append((at, before))
        last = at
    return out


_ENDS = pa.list_(pa.struct([("place", pa.int64()), ("before", pa.int64())]))


def _encode_chunks(path: str, plan: Chunks):
    """Each chunk's token count, and its boundaries in the overlap with the chunk before and with the one after."""

    def run(source):
        library = tokenizer(path)
        for batch in source:
            tokens, heads, tails = [], [], []
            for text, k in zip(batch.column("piece").to_pylist(), batch.column("k").to_pylist()):
                encoded = library.encode(text, add_special_tokens=False)
                starts = [a for a, _ in encoded.offsets]
                at = k * plan.chunk_chars
                tokens.append(len(starts))
                heads.append([{"place": at + p, "before": b} for p, b in boundaries(text, starts, 0, plan.overlap)] if k else [])
                tails.append([{"place": at + p, "before": b} for p, b in boundaries(text, starts, plan.chunk_chars, plan.chunk_chars + plan.overlap)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("k"), pa.array(tokens, pa.int64()), pa.array(heads, _ENDS), pa.array(tails, _ENDS)],
                names=["row", "k", "tokens", "head", "tail"],
            )

    return run


def _spliced(long_texts: DataFrame, path: str, plan: Chunks) -> DataFrame:
    """Per row of long_texts (row, text): n_tokens, or NULL if two chunks have no common boundary."""
    last = F.greatest(F.ceil((F.length("text") - plan.overlap) / F.lit(plan.chunk_chars)), F.lit(1)).cast("int") - 1
    chunks = long_texts.select("row", "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    piece = F.expr(f"substring(text, k * {plan.chunk_chars} + 1, {plan.chunk_chars + plan.overlap})")
    dealt = chunks.select("row", "k", "last", piece.alias("piece")).repartition("row", "k")
    encoded = durable(dealt.mapInArrow(_encode_chunks(path, plan), f"row long, k int, tokens long, head {_TYPE}, tail {_TYPE}"))
    left = encoded.select("row", (F.col("k") + 1).alias("k"), "tail")
    cuts = encoded.where("k > 0").select("row", "k", "head").join(left, ["row", "k"])
    # of the common places the first; a left count less the right one is what the cut takes off the sum
    common = F.expr("filter(tail, t -> exists(head, h -> h.place = t.place))")
    chosen = cuts.select("row", F.get(common, F.lit(0)).alias("left_end"), "head").select(
        "row", (F.col("left_end.before") - F.get(F.expr("filter(head, h -> h.place = left_end.place)"), F.lit(0))["before"]).alias("delta")
    )
    # tokens = those of the last chunk + for each cut (tokens of the left chunk before it - tokens of the right one before it)
    final = encoded.groupBy("row").agg(F.max_by("tokens", "k").alias("tokens"))
    sums = chosen.groupBy("row").agg(F.sum("delta").alias("delta"), F.sum(F.col("delta").isNull().cast("int")).alias("failed"))
    total = F.col("tokens") + F.coalesce("delta", F.lit(0))
    return final.join(sums, "row", "left").select("row", F.when(F.coalesce("failed", F.lit(0)) == 0, total).alias("n_tokens"))


_TYPE = "array<struct<place: bigint, before: bigint>>"


def count_tokens(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", max_tokens: int = 512, plan: Chunks = Chunks()
) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > max_tokens).

    Short texts are counted where they are read, without a shuffle. Long ones are numbered and dealt out by chunk.

    Defined results: NULL and empty text have 0 bytes and 0 tokens; strings that look like special tokens are treated
    as the library does by default; a NULL id stays NULL; repeated rows are counted one by one; an empty table gives
    no rows; other columns are ignored.
    """
    own = narrow(docs, key=id_column, text=text_column)
    kind = own.schema["key"].dataType.simpleString()
    is_long = F.coalesce(F.length("text"), F.lit(0)) > plan.chunk_chars
    short = own.where(~is_long).mapInArrow(_count_whole(path), f"key {kind}, n_bytes long, n_tokens long")
    numbered = durable(own.where(is_long).withColumn("row", F.monotonically_increasing_id()))
    pending, counted = numbered.select("row", "text"), []
    while True:
        result = durable(_spliced(pending, path, plan))
        counted.append(result.where("n_tokens is not null"))
        again = result.where("n_tokens is null").select("row")
        if again.isEmpty():
            break
        pending = numbered.join(again, "row").select("row", "text")
        overlap = plan.overlap * plan.widen
        plan = Chunks(max(plan.chunk_chars, overlap), overlap, plan.widen)
    longer = counted[0]
    for more in counted[1:]:
        longer = longer.unionByName(more)
    longer = numbered.select("row", "key", F.octet_length("text").cast("long").alias("n_bytes")).join(longer, "row").drop("row")
    return short.unionByName(longer).select(F.col("key").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
