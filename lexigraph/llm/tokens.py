"""Token ids of whole texts by a public byte-level BPE vocabulary.

Texts are cut by the vocabulary's split pattern; pieces that a task has met before come from a bounded memo. The rest
are merged many at a time: for each piece a segment tree over its byte positions stores the leftmost minimum pair rank,
so the next merge stands at the root and each merge costs three logarithmic point updates (the pair before, the merged
pair, the pair that vanished), found through links between live neighbours. Rows of one tree width advance together in
numpy; very wide pieces are merged one by one with the same tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie, unless a caller names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The vocabulary's split pattern; white space is Unicode's own set.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces kept per task before the memo starts afresh.
MEMO = 300_000
#: Pieces wider than this are merged one by one.
WIDE = 1024
#: Byte positions merged together.
CELLS = 1 << 19
NO_PAIR = np.int64(1) << 60


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in such vocabularies: printable Latin-1 as itself, the others from U+0100 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge table as arrays: sorted pair keys with their ranks, and the id each rank makes."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.bytes = np.zeros(256, np.int64)
        for letter, b in byte_letters().items():
            self.bytes[b] = ids[letter]
        self.rank_of = None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1 where it isn't merged."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_rows(voc: Vocabulary, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
    """Merge pieces of 2..width bytes (width a power of two) in step."""
    n, levels = len(pieces), width.bit_length() - 1
    size = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    at = np.arange(width)
    ids = np.where(at < size[:, None], voc.bytes[raw], -1)
    # one more column, so that neighbours beyond either end read and write a cell of their own
    ids = np.concatenate([ids, np.full((n, 1), -1)], 1)
    nxt = np.broadcast_to(np.minimum(at + 1, width), (n, width)).copy()
    nxt[at >= size[:, None] - 1] = width
    nxt = np.concatenate([nxt, np.full((n, 1), width)], 1)
    prv = np.broadcast_to(np.r_[width, at[:-1], width], (n, width + 1)).copy()
    tree = np.full((n, 2 * width), NO_PAIR)
    live = at[:-1] < size[:, None] - 1
    r = np.full((n, width - 1), -1, np.int64)
    r[live] = voc.rank(ids[:, : width - 1][live], ids[:, 1:width][live])
    tree[:, width : 2 * width - 1] = np.where(r >= 0, r * width + at[:-1], NO_PAIR)
    for k in range(levels - 1, -1, -1):
        w = 1 << k
        tree[:, w : 2 * w] = np.minimum(tree[:, 2 * w : 4 * w : 2], tree[:, 2 * w + 1 : 4 * w : 2])
    ids, nxt, prv, tree = ids.ravel(), nxt.ravel(), prv.ravel(), tree.ravel()
    rows = np.flatnonzero(tree[1 :: 2 * width] < NO_PAIR)
    while len(rows):
        cell, root = rows * (width + 1), rows * (2 * width)
        top = tree[root + 1]
        pos, made = top % width, voc.made[top // width]
        gone = nxt[cell + pos]
        after, before = nxt[cell + gone], prv[cell + pos]
        ids[cell + pos] = made
        ids[cell + gone] = -1
        nxt[cell + pos] = after
        prv[cell + after] = pos
        rank_after = np.where(after < width, voc.rank(made, ids[cell + after]), -1)
        rank_before = np.where(before < width, voc.rank(ids[cell + before], made), -1)
        for leaf, rank in ((gone, None), (pos, rank_after), (before, rank_before)):
            own = leaf < width
            base, i = (root, leaf) if own.all() else (root[own], leaf[own])
            tree[base + width + i] = NO_PAIR if rank is None else np.where(rank[own] >= 0, rank[own] * width + i, NO_PAIR)
            i = i + width
            for _ in range(levels):
                i = i >> 1
                twin = base + 2 * i
                tree[base + i] = np.minimum(tree[twin], tree[twin + 1])
        rows = rows[tree[root + 1] < NO_PAIR]
    grid = ids.reshape(n, width + 1)
    kept = grid >= 0
    flat, ends = grid[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
    return [tuple(flat[s:e]) for s, e in zip([0, *ends], ends)]


def merge_one(voc: Vocabulary, piece: bytes) -> tuple[int, ...]:
    """The same merges for one wide piece, with plain lists."""
    n = len(piece)
    if voc.rank_of is None:
        voc.rank_of = dict(zip(voc.keys.tolist(), voc.ranks.tolist()))
        voc.made_list = voc.made.tolist()
    rank_of, made_list = voc.rank_of, voc.made_list
    width = 1 << max(1, (n - 1).bit_length())
    ids = voc.bytes[np.frombuffer(piece, np.uint8)].tolist()
    nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
    none = int(NO_PAIR)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = rank_of.get(ids[i] << 32 | ids[i + 1])
        if r is not None:
            tree[width + i] = r * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while tree[1] < none:
        rank, pos = divmod(tree[1], width)
        made, gone = made_list[rank], nxt[pos]
        after, before = nxt[gone], prv[pos]
        ids[pos], ids[gone], nxt[pos] = made, -1, after
        put(gone, none)
        r = None
        if after >= 0:
            prv[after] = pos
            r = rank_of.get(made << 32 | ids[after])
        put(pos, none if r is None else r * width + pos)
        if before >= 0:
            r = rank_of.get(ids[before] << 32 | made)
            put(before, none if r is None else r * width + before)
    return tuple(x for x in ids if x >= 0)


def encode_pieces(voc: Vocabulary, pieces: list[str]) -> dict[str, tuple[int, ...]]:
    """Ids of distinct pieces."""
    out: dict[str, tuple[int, ...]] = {}
    by_width: dict[int, list[tuple[str, bytes]]] = {}
    for p in pieces:
        raw = p.encode("utf-8", "replace")
        if len(raw) == 1:
            out[p] = (int(voc.bytes[raw[0]]),)
        elif len(raw) > WIDE:
            out[p] = merge_one(voc, raw)
        else:
            by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((p, raw))
    for width, group in by_width.items():
        step = max(1, CELLS // width)
        for i in range(0, len(group), step):
            part = group[i : i + step]
            out.update(zip([p for p, _ in part], merge_rows(voc, [raw for _, raw in part], width)))
    return out


def encode_texts(voc: Vocabulary, texts: list[str | None], memo: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of texts; null and empty texts are empty."""
    find = _compiled().findall
    split = [find(t) if t else [] for t in texts]
    new = {p for s in split for p in s if p not in memo}
    if new:
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = {p for s in split for p in s}
        memo.update(encode_pieces(voc, list(new)))
    listed = [list(chain.from_iterable(map(memo.__getitem__, s))) for s in split]
    offsets = np.cumsum([0, *map(len, listed)])
    return np.fromiter(chain.from_iterable(listed), np.int32, int(offsets[-1])), offsets.astype(np.int32)


_SPLIT = None


def _compiled():
    global _SPLIT
    if _SPLIT is None:
        _SPLIT = regex.compile(PATTERN)
    return _SPLIT


def token_ids(df: DataFrame, row_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of df: its id and the list of token ids of the whole text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list; repeated rows
    stay repeated; an empty table gives no rows; extra columns are ignored. vocabulary is read on the driver only.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))  # about 50,000 merges, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            flat, offsets = encode_texts(shared.value, b.column("text").to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    slim = df.select(F.col(row_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", row_id)
