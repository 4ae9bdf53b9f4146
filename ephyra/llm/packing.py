"""Packing by concatenate and cut: ids once, prefix sums over partition totals, then fixed windows."""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import field, materialize, table, without

#: Different pre-tokens whose ids a worker remembers; beyond that it keeps the first ones, which are the common ones. Slots that
#: tell a new pre-token from one that came before.
MEMO, COMMON, SEEN = 400_000, 100_000, 1 << 22
#: Outside these characters a text goes through the tokenizer whole.
PLAIN = re.compile(r"[^\x00-\u024f\u2000-\u206f]")


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int = 0):
    """A function from texts to one array of ids each, closed by end_id: ids as tokenizers gives them, without special
    tokens added. A worker makes it once. The tokenizer's byte-level pre-tokenizer takes each match of the split pattern
    by itself, so equal matches have equal ids: the tokenizer's own model merges each new match once. Texts beyond plain
    characters or with a special token's string, and tokenizers of any other kind, are encoded whole."""
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer.from_file(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    split, model = regex.compile(public_tokenizers.PATTERN).findall, tok.model
    kind, wide = ("H", "<u2") if max(tok.get_vocab_size(), end_id + 1) <= 1 << 16 else ("I", "<u4")
    end = np.dtype(wide).type(end_id).tobytes()
    plain = isinstance(tok.pre_tokenizer, pre_tokenizers.ByteLevel) and not tok.pre_tokenizer.add_prefix_space and tok.normalizer is None and isinstance(model, models.BPE)
    shown = str.maketrans({chr(b): _shown(b) for b in range(256)})

    class Memo(dict):
        def __missing__(self, piece):
            ids = array(kind, [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(shown))]).tobytes()
            # most new matches never come again: a match is kept from its second time on (a slot shared by chance: its first)
            slot = hash(piece) & SEEN - 1
            if seen[slot]:
                self[piece] = ids
            seen[slot] = 1
            return ids

    memo, seen = Memo(), bytearray(SEEN)

    def encode(texts):
        for text in texts:
            text = text or ""
            if not plain or PLAIN.search(text) or any(s in text for s in special):
                yield array(kind, tok.encode(text, add_special_tokens=False).ids).tobytes() + end
            else:
                yield b"".join(map(memo.__getitem__, split(text))) + end
                if len(memo) > MEMO:
                    common = dict(islice(memo.items(), COMMON))
                    memo.clear()
                    memo.update(common)
                    seen[:] = bytes(SEEN)

    return encode, np.dtype(wide)


def _shown(byte: int) -> str:
    """The character that stands for a byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = lambda b: 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
    return chr(byte) if prints(byte) else chr(256 + sum(not prints(b) for b in range(byte)))


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """The pieces of all docs in sequences of `length` tokens: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and ids with `with_ids`). Only the last sequence of all can be short, so padding is below `length` tokens.

    First pass: each task writes the ids of its documents with their place in its own partition. The totals of
    partitions, one number for each, are summed before each partition; they are all that reaches the driver. Second
    pass: a document's global place is its partition's offset plus its own, so windows are cut row by row, in any order of
    rows and without a shuffle; a document that crosses a window's edge yields one boundary piece for each window.
    A null or empty text is the end id alone. Repeated rows are packed each. An empty table gives no rows. A task that
    is run anew reads the same rows, and the second pass sees only written ids.
    """
    encode_schema = T.StructType([field("doc_id", docs.schema["doc_id"].dataType), field("part", T.IntegerType()), field("at", T.LongType()), field("n", T.LongType()), field("ids", T.BinaryType())])
    given = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def first(batches):
        encode, wide = encoder(path, end_id)
        at = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = list(encode(part.column(1).to_pylist()))
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // wide.itemsize
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(before), pa.array(n), pa.array(ids, pa.binary())], names=encode_schema.names)

    ids = materialize(given.mapInArrow(first, encode_schema))
    totals = sorted(ids.groupBy("part").agg(F.sum("n")).collect())
    parts, sums = [p for p, _ in totals], np.cumsum([0, *[n for _, n in totals]]).tolist()
    offset = dict(zip(parts, sums))
    wide = "<u2" if _vocab(path, end_id) <= 1 << 16 else "<u4"
    out = T.StructType([encode_schema["doc_id"], *[field(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], *([field("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def second(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows, cols, pieces = [], [[] for _ in range(6)], []
                for i, (p, at, n, raw) in enumerate(zip(*[part.column(c).to_pylist() for c in range(1, 5)])):
                    own = np.frombuffer(raw, wide).astype("<u4")
                    begin = offset[p] + at
                    cuts = [0, *range(length - begin % length, n, length), n]
                    for a, b in zip(cuts, cuts[1:]):
                        rows.append(i)
                        for c, v in zip(cols, (a, b - a, zlib.crc32(own[a:b]), n, (begin + a) // length, (begin + a) % length)):
                            c.append(v)
                        if with_ids:
                            pieces.append(own[a:b].astype(np.int32))
                more = [pa.array(pieces, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in cols], *more], names=out.names)

    return ids.mapInArrow(second, out)


def _vocab(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
