"""Byte-level BPE by a rank queue under a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import field, table, with_arrow

#: Different pre-tokens whose ids a worker remembers (beyond that it keeps the first ones, which are the common ones), the
#: longest that it remembers, and the characters of texts that it takes at a time.
MEMO, COMMON, MEMO_BYTES, CHARS = 400_000, 100_000, 256, 3_000_000
#: Buckets of up to so many positions are joined one by one, larger ones at once.
FEW = 6


class RankQueue:
    """Positions by merge rank, with a bitmap of three levels of 64-bit words over the ranks: a set bit means a non-empty
    bucket below it. Finding the least rank is one find-first-set a level."""

    def __init__(self, ranks: int):
        self.bucket: dict[int, list] = {}
        self.levels = [[0] * (-(-ranks // 64**k) + 1) for k in (1, 2, 3)]

    def push(self, rank: int, positions) -> None:
        """positions: an array, or one position."""
        held = self.bucket.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.bucket[rank] = [positions]
        for words in self.levels:
            rank, bit = rank >> 6, 1 << (rank & 63)
            was = words[rank]
            words[rank] = was | bit
            if was:
                break

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate([[0], edges])].tolist() if len(ranks) else [], np.split(positions, edges)):
            self.push(rank, part)

    def least(self) -> int:
        """The least rank with positions, -1 if none."""
        for top, word in enumerate(self.levels[2]):
            if word:
                at = top
                for words in reversed(self.levels):
                    word = words[at]
                    at = at << 6 | (word & -word).bit_length() - 1
                return at
        return -1

    def take(self, rank: int) -> np.ndarray:
        held = self.bucket.pop(rank)
        for words in self.levels:
            rank, bit = rank >> 6, 1 << (rank & 63)
            words[rank] &= ~bit
            if words[rank]:
                break
        return np.unique(np.hstack(held))


class ByteBPE:
    """ranks: bytes of a token to its rank, which is its id. Each single byte has a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair = {ranks[p[:k]] * self.size + ranks[p[k:]]: r for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks}
        keys = np.array(sorted(self.pair), np.int64)
        self.pair_keys, self.pair_ranks = np.append(keys, -1), np.array([self.pair[k] for k in keys.tolist()] + [-1], np.int64)
        self.memo: dict[str, bytes] = {}

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str, pattern: str) -> ByteBPE:
        """A worker reads a rank file once."""
        with open(path, "rb") as f:
            return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the tokens' joins, -1 where they don't join. An id of -1 (a piece's end) joins with nothing."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -2)
        at = np.searchsorted(self.pair_keys[:-1], key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of pre-tokens: in each, always the leftmost pair of the least rank joins next.

        All bytes of all pieces form one doubly linked list, with an end mark after each piece that joins with nothing. As
        pieces don't touch, they may share the queue: the least rank of all is the least of every piece that has it. A
        bucket's positions are taken from left to right; where neighbours overlap (a run such as "aaa") every other one
        joins. An entry is stale if the pair at its position has another rank by then; it is skipped when met.
        If a join yields a pair of a rank as low as its own (rank files don't forbid it), the bucket is done one by one and its
        rest put back, so that order is exact for any ranks. Each join adds two entries at most, so time is near linear.
        """
        whole = [self.ranks.get(p) for p in pieces]
        out = [np.array([r], np.int64) if r is not None else None for r in whole]
        todo = [i for i, r in enumerate(whole) if r is None and pieces[i]]
        for i, r in enumerate(whole):
            if r is None and not pieces[i]:
                out[i] = np.zeros(0, np.int64)
        if not todo:
            return out
        size = np.fromiter((len(pieces[i]) + 1 for i in todo), np.int64, len(todo))
        ends = np.cumsum(size) - 1
        ids = self.byte[np.frombuffer(b"\0".join([pieces[i] for i in todo]) + b"\0", np.uint8)]
        ids[ends] = -1
        n = len(ids)
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.append(self.merged(ids[:-1], ids[1:]), -1)
        queue = RankQueue(self.size)
        at = np.flatnonzero(pair >= 0)
        queue.push_all(pair[at], at)
        while (rank := queue.least()) >= 0:
            bucket = queue.take(rank)
            if len(bucket) <= FEW:
                self._join_few(queue, rank, bucket.tolist(), ids, nxt, prev, pair)
                continue
            i = bucket[pair[bucket] == rank]
            if not len(i):
                continue
            run = nxt[i[:-1]] == i[1:]
            if run.any():
                first = np.concatenate([[True], ~run])
                begin = np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - begin) % 2 == 0]
            j = nxt[i]
            after = nxt[j]
            touch = after[:-1] == i[1:]  # between two joins side by side there is a moment when only the left one is done
            if touch.any():
                mid = self.merged(np.full(int(touch.sum()), rank), ids[i[1:][touch]])
                if ((mid >= 0) & (mid <= rank)).any():
                    self._join_few(queue, rank, bucket.tolist(), ids, nxt, prev, pair)
                    continue
            was = ids[i], pair[j]
            ids[i], nxt[i], pair[j], prev[after] = rank, after, -1, i
            before = prev[i]
            changed = np.concatenate([i, before[before >= 0]])
            if len(run):
                changed = np.unique(changed)
            new = self.merged(ids[changed], ids[nxt[changed]])
            if ((new >= 0) & (new <= rank)).any():
                # a pair of a rank as low: undo, and join one at a time
                ids[i], nxt[i], pair[j], prev[after] = was[0], j, was[1], j
                self._join_few(queue, rank, bucket.tolist(), ids, nxt, prev, pair)
                continue
            pair[changed] = new
            good = new >= 0
            queue.push_all(new[good], changed[good])
        # what a join has swallowed is no longer pointed to by its left neighbour
        alive = np.zeros(n + 1, bool)
        alive[0] = True
        alive[nxt[(prev < 0) | (nxt[np.maximum(prev, 0)] == np.arange(n))]] = True
        keep = np.flatnonzero(alive[:n] & (ids >= 0))
        cuts = np.searchsorted(keep, ends)[:-1]
        for i, part in zip(todo, np.split(ids[keep], cuts)):
            out[i] = part
        return out

    def _join_few(self, queue, rank, bucket, ids, nxt, prev, pair) -> None:
        get, size, last = self.pair.get, self.size, len(ids) - 1
        for k, i in enumerate(bucket):
            if pair[i] != rank:
                continue
            j = nxt[i]
            after = int(nxt[j])
            ids[i], nxt[i], pair[j], low = rank, after, -1, rank + 1
            prev[after] = i
            right = ids[after]
            new = get(rank * size + int(right), -1) if right >= 0 else -1
            pair[i] = new
            if new >= 0:
                queue.push(new, i)
                low = new
            before = int(prev[i])
            if before >= 0:
                left = ids[before]
                new = get(int(left) * size + rank, -1) if left >= 0 else -1
                pair[before] = new
                if new >= 0:
                    queue.push(new, before)
                    low = min(low, new)
            if low <= rank:
                for p in bucket[k + 1 :]:
                    queue.push(rank, p)
                return

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers. Each new pre-token goes through the queue once,
        with all others of the texts."""
        memo, split = self.memo, [self.split(t) for t in texts]
        new = [p for p in set().union(*split) if p not in memo] if split else []
        long = {}
        for p, ids in zip(new, self.encode_pieces([p.encode() for p in new])):
            (memo if len(p) <= MEMO_BYTES else long)[p] = ids.astype("<u4").tobytes()
        get = memo.__getitem__ if not long else lambda p: memo[p] if p in memo else long[p]
        out = [b"".join(map(get, pieces)) for pieces in split]
        if len(memo) > MEMO:
            common = dict(islice(memo.items(), COMMON))
            memo.clear()
            memo.update(common)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256, and with `with_ids` ids (array) and decoded (binary).

    Each row stands alone: no shuffle, no state beyond a worker's memo of bounded size, and whole texts however long a
    pre-token is. A null text is empty: 0 tokens, digests of no bytes. Clashing columns of docs are replaced."""
    own = [field("n_tokens", T.LongType()), field("ids_sha256", T.StringType()), field("decoded_sha256", T.StringType())]
    if with_ids:
        own += [field("ids", T.ArrayType(T.IntegerType())), field("decoded", T.BinaryType())]

    def start():
        bpe, sha = ByteBPE.load(path, pattern), hashlib.sha256

        def encoded(texts):
            part, held = [], 0
            for text in texts:
                part.append(text or "")
                held += len(part[-1])
                if held >= CHARS:
                    yield from bpe.encode(part)
                    part, held = [], 0
            yield from bpe.encode(part)

        def of(texts):
            cols = [[] for _ in own]
            for raw in encoded(texts):
                ids = np.frombuffer(raw, "<u4")
                back = bpe.decode(ids.tolist())
                for c, v in zip(cols, (len(ids), sha(raw).hexdigest(), sha(back).hexdigest(), ids.astype(np.int32) if with_ids else 0, back)):
                    c.append(v)
            return cols

        return of

    return with_arrow(docs, start, ["text"], own)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=False).drop("text")
