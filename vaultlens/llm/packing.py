"""Packing documents into fixed-length sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenised and closed with an end id. Pieces of ``length`` ids are full sequences; what is left of each
document is dealt at random into groups of about ``group_docs`` documents, and each group is packed by itself:
largest piece first, into the leftmost bin with room, which the tree finds in log2(bins) steps.

Defined results: a null or empty text is the end id alone. Repeated rows are packed one by one. Equal lengths go in
the order of doc_id, nulls first, then start. No rows give no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches


class Encoder:
    """Ids of the tokenizer file ``path``, by its faster twin ``twin`` (the same vocabulary as ranks) where that is given.

    A text that holds an added token (``<|endoftext|>``) goes to the tokenizer itself, which makes it one id. So does one
    that trips the twin: its regular expressions have a step limit that extreme runs of white space can reach.
    """

    def __init__(self, path: str, twin: str | None, pattern: str | None):
        import base64

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if twin:
            import tiktoken

            with open(twin, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("twin", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not any(t in text for t in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException as e:  # a panic of the native code is no Exception
                if "Panic" not in type(e).__name__ and not isinstance(e, ValueError):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, twin: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, twin, pattern)


def public(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """Arguments of ``encoder`` for a byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


class Bins:
    """First fit: leaves hold the room of each bin, a parent the larger room of its two children."""

    def __init__(self, capacity: int, most: int):
        self.size = 1 << max(1, (max(1, most) - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def put(self, length: int) -> tuple[int, int]:
        """The leftmost bin with room for ``length``, and its room before."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < length:
                i += 1
        had = room[i]
        room[i] = had - length
        at = i - self.size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece; equal lengths in the order given."""
    bins, out = Bins(capacity, len(lengths)), np.zeros((len(lengths), 2), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        at, had = bins.put(int(lengths[i]))
        out[i] = at, capacity - had
    return out[:, 0], out[:, 1]


def pieces(docs: DataFrame, length: int, end_id: int, vocabulary: tuple) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row, salt = encoder(*vocabulary), 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                at, start, size, crc, total, salts = [], [], [], [], [], []
                for i, text in enumerate(part.column("text")):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    row += 1
                    for lo in range(0, len(ids), length):
                        own = ids[lo : lo + length]
                        at.append(i), start.append(lo), size.append(len(own)), crc.append(zlib.crc32(own.tobytes())), total.append(len(ids)), salts.append(salt + row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total, salts))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(task, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, vocabulary: tuple | None = None, group_docs: int = 2048, seed: int = 11) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id is the group times 2**32 plus the bin in the group.
    """
    groups = max(1, -(-docs.select("doc_id").count() // group_docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = pieces(docs, length, end_id, vocabulary or public()).withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "salt"), F.lit(groups))).drop("salt")

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offset = first_fit_decreasing(group.column("length").to_numpy(), length)
        ids = group.column("grp").to_numpy() * 2**32 + bins
        return group.drop_columns(["grp"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    return dealt.groupBy("grp").applyInArrow(one, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
