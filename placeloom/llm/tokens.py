"""Token ids of whole texts by a byte-level BPE of the public vocabularies.

Pre-tokens are found without a regex: every code point gets a class (space, letter, number, other) from one table, and
the pattern's automaton is scanned over the class array. Its transition functions forget all but the last few classes
(each class change resets the state), so their associative composition is a comparison of the array with its shifted
copies, done for all texts of a batch at once. The slices of the UTF-8 bytes between boundaries go through a cache of
merged pieces; their offsets can be kept, so ids can be led back to code points.

Defined cases: null and empty texts give an empty list; texts of any length are encoded whole; strings of special tokens
are ordinary text; repeated texts give equal lists.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER_DIR = os.environ.get("PLACELOOM_TOKENIZERS", "/opt/tokenizers")
#: Merged pieces kept in a worker, and code points laid out in arrays at once; a longer text is laid out alone.
CACHE_PIECES, BATCH_POINTS = 200_000, 1 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    import unicodedata

    first = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        k = first.get(unicodedata.category(chr(cp))[0])
        if k is not None:
            table[cp] = k
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def boundaries(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions in ``points`` at which a pre-token begins. text_starts: where each text begins."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes()[points]
    fresh = np.zeros(n + 1, bool)  # a text begins here; n counts as one
    fresh[text_starts[text_starts < n]] = True
    fresh[0] = fresh[n] = True
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 255, cls[:-1]
    prev[fresh[:n]] = 255
    run = cls != prev
    solid = cls != SPACE
    begins = run & solid & (prev != 255)  # a run of letters, numbers or others, not at the text's start
    after_blank = np.zeros(n, bool)  # the blank U+0020 before it is its prefix
    after_blank[1:] = begins[1:] & (points[:-1] == 0x20)
    start = run & ~after_blank
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = solid[1:] & ~fresh[1:n]
    start |= ~solid & next_solid  # the last of several spaces stands apart from those before it
    ticks = np.flatnonzero((points == 0x27) & run & ~after_blank)
    if len(ticks):
        p = np.concatenate([points, np.zeros(3, points.dtype)])
        bound = np.concatenate([fresh, np.ones(3, bool)])
        a, b = p[ticks + 1], p[ticks + 2]
        near = ~bound[ticks + 1]
        one = near & np.isin(a, [ord(c) for c in "stmd"])
        two = near & ~bound[ticks + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[ticks[one | two] + 1] = False
        ends = np.concatenate([ticks[one] + 2, ticks[two] + 3])
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


class PieceMerger:
    """Ids of one pre-token's bytes by the ranks of a vocabulary, cached."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.cache: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals; a heap over linked parts, so long pieces cost n log n."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or (j := right[i]) >= n or end[j] != e:
                continue
            end[i], right[i], alive[j] = e, right[j], False
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if (k := left[i]) >= 0 and (r := ranks.get(piece[k:e])) is not None:
                heapq.heappush(heap, (r, k, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = right[i]
        return out

    def __call__(self, piece: bytes) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.merge(piece)
            if len(piece) <= 64:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids


@lru_cache(4)
def merger(path: str) -> PieceMerger:
    return PieceMerger(path)


def _laid_out(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > BATCH_POINTS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode_texts(texts: list[str | None], path: str, offsets: bool = False) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Of each text its ids and, with ``offsets``, each pre-token's first code point and number of ids."""
    merge = merger(path)
    get = merge.cache.get
    for part in _laid_out(["" if t is None else t for t in texts]):
        joined = "".join(part)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = boundaries(points, first[:-1])
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        data = joined.encode()
        cuts = np.append(byte_at[at], len(data)).tolist()
        rows = np.searchsorted(at, first).tolist()
        for k in range(len(part)):
            ids: list[int] = []
            counts: list[int] = []
            a, b = rows[k], rows[k + 1]
            for i in range(a, b):
                piece = data[cuts[i] : cuts[i + 1]]
                got = get(piece)
                if got is None:
                    got = merge(piece)
                ids += got
                if offsets:
                    counts.append(len(got))
            yield ids, (at[a:b] - first[k]).tolist() if offsets else [], counts


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken")


def decode(ids: list[int], path: str) -> str:
    back = {v: k for k, v in merger(path).ranks.items()}
    return b"".join(back[i] for i in ids).decode()


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """Columns key, ids and, with ``offsets``, starts (code point of each pre-token) and counts (its ids). One narrow stage."""
    path = path or vocabulary()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys, at = b.column(1).to_pylist(), b.column(0), 0
            for part in _laid_out(["" if t is None else t for t in texts]):
                rows = list(encode_texts(part, path, offsets))
                lists = [pa.array([r[j] for r in rows], pa.list_(pa.int32())) for j in range(3 if offsets else 1)]
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), *lists], [key, "ids", "starts", "counts"][: 1 + len(lists)])
                at += len(part)

    schema = f"`{key}` {kind}, ids array<int>" + ", starts array<int>, counts array<int>" * offsets
    return df.select(key, text).mapInArrow(run, schema)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` and ``tokens``, the number of ids of each text; texts don't leave the stage."""
    path = path or vocabulary()
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(r[0]) for r in encode_texts(b.column(len(keep)).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(n, pa.int64())], [*keep, "tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)
