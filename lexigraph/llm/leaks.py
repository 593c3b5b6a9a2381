"""Which texts of a corpus give away passages of held-out test items.

Pigeonhole edit matching on texts reduced to letters and digits: an item is cut into pieces so that a passage of
`passage` characters with at most `errors` edits keeps at least one piece unharmed. All exact piece hits in a text are
found in one scan of an Aho-Corasick automaton; around each hit the passages that contain the piece are verified with
Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.session import materialize

#: Characters of items that one automaton holds; more items are matched in further blocks.
BLOCK_CHARS = 4 << 20

#: Full- and half-width forms to their usual width, by their Unicode decompositions.
WIDTH = {c: unicodedata.normalize("NFKC", chr(c)) for c in [0x3000, *range(0xFF01, 0xFFEF)] if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))}
_OTHER = re.compile(r"[\W_]+")


def letters_digits(text: str) -> str:
    """Letters and digits of a text in one width, composed, in lower case."""
    return _OTHER.sub("", unicodedata.normalize("NFC", text.translate(WIDTH)).lower())


def myers(pattern: str, text: str) -> int:
    """Least edit distance between the whole pattern and any stretch of the text (Myers 1999, as given by Hyyro)."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    vp, vn, score, best = full, 0, m, m
    for ch in text:
        eq = masks.get(ch, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1, hn << 1
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0 & full
        best = min(best, score)
    return best


class Items:
    """A block of items as an automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], passage: int, errors: int):
        self.passage, self.errors = passage, errors
        # A run of `passage` characters holds errors + 1 whole pieces at any offset if errors + 2 pieces are at most one
        # character longer than it; an edit harms one piece at most, so one piece stays whole.
        self.piece = max(1, (passage + 1) // (errors + 2))
        self.texts = items
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(items):
            for i in range(0, len(t) - self.piece + 1, self.piece) if len(t) >= passage else ():
                places.setdefault(t[i : i + self.piece], []).append((k, i))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        self.any = bool(places)
        if self.any:
            self.automaton.make_automaton()

    def verify(self, text: str, at: int, item: str, i: int) -> tuple[int, bool]:
        """Least distance of a passage of the item that holds the piece, and whether a whole passage is shared exactly."""
        piece, passage, e = self.piece, self.passage, self.errors
        left = 0
        while left < passage and at > left and i > left and text[at - left - 1] == item[i - left - 1]:
            left += 1
        right = piece
        while right < passage and at + right < len(text) and i + right < len(item) and text[at + right] == item[i + right]:
            right += 1
        first, last = max(0, i + piece - passage), min(i, len(item) - passage)
        # the passage with the longest exact part comes first: it settles nearly all true hits
        start = min(max(first, i - left), last)
        best = passage
        for s in dict.fromkeys([start, *range(first, last + 1)]):
            lo = at - (i - s) - e
            best = min(best, myers(item[s : s + passage], text[max(0, lo) : at - (i - s) + passage + e]))
            if best == 0 or best == 1 and left + right < passage:  # no less is left to find
                break
        return best, left + right >= passage

    def search(self, text: str) -> dict[int, tuple[int, bool]]:
        """Items of which a passage is in the text, with the least distance and whether it is exact."""
        found: dict[int, tuple[int, bool]] = {}
        for end, where in self.automaton.iter(text):
            at = end - self.piece + 1
            for k, i in where:
                if found.get(k, (1, False))[1]:
                    continue
                distance, exact = self.verify(text, at, self.texts[k][1], i)
                if distance <= self.errors:
                    old = found.get(k, (distance, False))
                    found[k] = (min(distance, old[0]), exact)
        return {self.texts[k][0]: v for k, v in found.items()}


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; one block at a time is on the driver."""
    block, chars = [], 0
    for r in items.toLocalIterator():
        block.append((r["id"], letters_digits(r["text"])))
        chars += len(block[-1][1])
        if chars > BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, passage: int = 32, errors: int = 1) -> DataFrame:
    """Documents that hold a passage of an item, exactly or with at most `errors` edits.

    Out: doc_id, item_id, distance (least edit distance of a shared passage), exact (a run of `passage` letters and
    digits is shared; blanks, punctuation, symbols, letter case and character width don't count). Null, empty and
    short texts hold nothing; items shorter than a passage give nothing away; rows repeated under one id give one row;
    an empty table on either side gives no rows. Items of one text are matched once. Items beyond BLOCK_CHARS are matched block
    by block, each block against all documents.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= passage - errors))
    usable = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull()).distinct()
    # the least id stands for all items of a text
    first = usable.groupBy("text").agg(F.min("id").alias("id"))
    same = usable.join(first.withColumnRenamed("id", "item"), "text").select("item", "id")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc {kind}, item long, distance int, exact boolean"
    out = None
    for block in _blocks(first):
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK_CHARS characters and one item
        hits = slim.mapInArrow(_scan(shared, passage, errors), schema)
        hits = hits.groupBy("doc", "item").agg(F.min("distance").alias("distance"), F.max("exact").alias("exact"))
        if out is not None:
            hits = materialize(hits)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], schema)
    found = out.join(same, "item").groupBy("doc", "id").agg(F.min("distance").alias("distance"), F.max("exact").alias("exact"))
    return found.select(F.col("doc").alias(doc_id), F.col("id").alias(item_id), "distance", "exact")


def _scan(shared, passage: int, errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            known = known or Items(shared.value, passage, errors)
            rows = ([], [], [], [])
            if known.any:
                for k, text in enumerate(b.column("text").to_pylist()):
                    for item, (distance, exact) in known.search(letters_digits(text)).items():
                        for column, v in zip(rows, (k, item, distance, exact)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.bool_())],
                names=["doc", "item", "distance", "exact"],
            )

    return run
