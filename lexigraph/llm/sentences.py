"""Sentence spans of texts in many scripts.

A period after a word is the only mark whose meaning depends on its surroundings. Whether the word before it is an
abbreviation and whether the word after it opens sentences or is a name is read from the unambiguous occurrences in the
same document; only where the document is silent do the counts of the whole corpus decide, and where they are silent too, the form of the
word. All other marks follow the rules of their script: full stops of the CJK, Devanagari and Arabic scripts, blanks
in Thai, and marks inside quotations, brackets and titles, which leave the sentence around them open.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks by their role.
STOPS = "。！？!?｡।॥؟۔…．.⁇⁈⁉"
COMMAS = "，,、；;：:—–-،؛"
PAIRS = {"“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "‹": "›", "„": "“", "《": "》", "〈": "〉", "【": "】", "（": "）", "(": ")", "［": "］", "[": "]", "〔": "〕"}
BRACKETS = "《〈【（(［[〔"
CLOSERS = "”’」』»›》〉】）)］]〕\""
# Words that always stand before a name, and words that stand before a number, by language.
TITLES = {"mr", "mrs", "ms", "dr", "prof", "hon", "st", "sr", "sra", "srta", "srs", "dra", "dña", "d", "exmo", "гр", "г-н", "г-жа", "проф", "ông", "bà", "ts", "ths", "gs"}
BEFORE_NUMBER = {"no", "nos", "art", "arts", "sec", "secs", "ch", "fig", "vol", "p", "pp", "para", "núm", "num", "pág", "cap", "inc", "ст", "п", "пп", "ч", "гл", "стр", "approx", "ca", "c", "cf", "nr", "nº"}

#: Parts that the documents that ask for one word are spread over.
SALT = 16

CASED = r"A-Za-zÀ-ɏḀ-ỿЀ-ԯͰ-Ͽ"
WORD = re.compile(rf"[{CASED}][{CASED}̀-ͯ'’-]*(?:\.[{CASED}]+)*")
DOTTED = re.compile(rf"({WORD.pattern})\.(?:,|;|\s+[a-zß-öø-ÿа-џ])")
NUMBERED = re.compile(rf"({WORD.pattern})\.\s+\d")
#: What stands after the period in the place of a number: 12, A-12, B3.
CODE = re.compile(r"[A-Z]{0,3}-?\d")
STOPPED = re.compile(rf"({WORD.pattern})\.(?=[\s,;]|$)")
STARTED = re.compile(rf"(?:^|[!?。！？…]|\n)[\s¿¡«“\"]*({WORD.pattern})")
INSIDE = re.compile(rf"[a-zß-ɏа-џḀ-ỿ] ({WORD.pattern})(\.?)")
THAI = re.compile(r"[฀-๿]")
AFTER_NUMBER = re.compile(r"[\d.,:/–-]+\s*")
NUMBERING = re.compile(r"(?:[（(]\s*(?:\d{1,3}|[一二三四五六七八九十百]{1,4}|[a-zA-Z])\s*[)）]|[①-⓿❶-➓]|\d{1,3}[.．、)）]|[一二三四五六七八九十百]{1,4}[、.．])\s*")
MARK = re.compile(rf"[{re.escape(STOPS)}{re.escape(''.join(PAIRS))}\"\n\r]|(?<=[฀-๿])\s|(?<=[฀-๿][”\")])\s")


def evidence(text: str) -> Counter:
    """Unambiguous occurrences in a text: (a)bbreviation before a small letter or comma, (n) before a number, (t)imes a word stands
    before a period, (s)tart of a sentence, na(m)e inside one, (l) in small letters without a period, (o) the same with one."""
    out: Counter = Counter()
    for m in DOTTED.finditer(text):
        out["a", m[1].lower()] += 1
    for m in NUMBERED.finditer(text):
        out["n", m[1].lower()] += 1
    for m in STOPPED.finditer(text):
        out["t", m[1].lower()] += 1
    for m in STARTED.finditer(text):
        if m[1][0].isupper():
            out["s", m[1].lower()] += 1
    for m in INSIDE.finditer(text):
        if m[1][0].isupper():
            out["m", m[1].lower()] += 1
        else:
            out["o" if m[2] else "l", m[1].lower()] += 1
    return out


def cjk(ch: str) -> bool:
    """Ideographs, kana, hangul and full-width signs."""
    return "⺀" <= ch <= "鿿" or "가" <= ch <= "힯" or "豈" <= ch <= "﫿" or "＀" <= ch <= "￯" or ch >= "\U00020000" or ch in "“‘①②③④⑤⑥⑦⑧⑨⑩"


class Judge:
    """What is known of words: the document first, then the corpus."""

    def __init__(self, doc: Counter, corpus: dict[tuple[str, str], int]):
        self.doc, self.corpus = doc, corpus

    def abbreviation(self, word: str, number: bool = False) -> bool:
        """Whether a word before a period, and perhaps a number after it, is an abbreviation: the document, the corpus, then lists and form.

        Words that are abbreviations before a number only may be ordinary words elsewhere, which then says nothing of them.
        """
        w = word.lower()
        if "." in w:  # p.m., U.S.; longer parts are those of an address
            return max(map(len, w.split("."))) <= 2
        listed = number and w in BEFORE_NUMBER
        a, l = self.doc["a", w] + number * self.doc["n", w], 0 if listed else self.doc["l", w] + number * self.doc["o", w]  # noqa: E741
        if a or l:
            return a > l
        a, t = self.corpus.get(("a", w), 0) + number * self.corpus.get(("n", w), 0), self.corpus.get(("t", w), 0)
        if a >= 2:
            return 2 * a >= t
        return listed or w in TITLES or len(w) == 1

    def opens(self, word: str) -> bool:
        """Whether a capital word after an abbreviation opens a sentence: seen at starts or in small letters, less often as a name."""
        w = word.lower()
        for known in (self.doc, self.corpus):
            start, name = known.get(("s", w), 0) + known.get(("l", w), 0), known.get(("m", w), 0)
            if start or name:
                return start > name
        return False


def pairs(text: str) -> dict[int, int]:
    """Opening mark to its closing mark; marks without a partner are left out."""
    out: dict[int, int] = {}
    open_at: list[int] = []
    depth: dict[str, list[int]] = {ch: [] for ch in [*PAIRS, '"']}  # of each mark, where it stands in open_at
    opener = {c: o for o, c in PAIRS.items()} | {'"': '"'}

    def close(mark: str, i: int) -> None:
        k = depth[mark][-1]
        out[open_at[k]] = i
        for at in open_at[k:]:
            depth[text[at]].pop()
        del open_at[k:]

    for m in re.finditer(rf"[{re.escape(''.join(PAIRS) + ''.join(PAIRS.values()))}\"]", text):
        i, ch = m.start(), m[0]
        if ch in opener and depth[opener[ch]]:
            close(opener[ch], i)
        elif ch in depth:
            depth[ch].append(len(open_at))
            open_at.append(i)
    return out


def spans(text: str, judge: Judge) -> list[tuple[int, int]]:
    """Begin and end of every sentence, without blanks around it."""
    out: list[tuple[int, int]] = []
    n, partner = len(text), pairs(text)

    def skip(i: int) -> int:
        while i < n and text[i].isspace():
            i += 1
        return i

    def body(i: int) -> int:
        m = NUMBERING.match(text, i)
        return m.end() if m else i

    def absorb(i: int) -> int:
        """Past further stops and closing marks without a partner of their own."""
        while i < n and (text[i] in STOPS or text[i] in CLOSERS and i not in partner and text[i] not in "）)"):
            i += 1
        return i

    start = skip(0)
    i = body(start)
    while i < n:
        m = MARK.search(text, i)
        if not m:
            break
        i, ch = m.start(), m[0]
        end = 0
        if i in partner:
            end, i = _after_pair(text, start, body(start), i, partner[i], skip, absorb)
        elif ch in PAIRS or ch == '"':
            i += 1
        elif ch in ".．":
            j = i + 1
            while j < n and text[j] in STOPS:
                j += 1
            end = absorb(j) if j > i + 1 and _run_ends(text, i, j) or j == i + 1 and _period_ends(text, i, judge) else 0
            i = j
        elif ch in STOPS:
            j = absorb(i + 1)
            nxt = text[j : j + 1]
            end = 0 if ch == "…" and nxt and (nxt in COMMAS or nxt.islower()) else j
            i = j
        elif ch in "\r\n":
            j = skip(i)
            if _line_ends(text, start, i, j):
                end = i
            i = j
        else:
            j = skip(i)
            if _thai_blank_ends(text, i, j):
                end = i
            i = j
        if end:
            stop = end
            while stop > start and text[stop - 1].isspace():
                stop -= 1
            if stop > start:
                out.append((start, stop))
            start = skip(end)
            i = max(i, body(start))
    stop = n
    while stop > start and text[stop - 1].isspace():
        stop -= 1
    if stop > start:
        out.append((start, stop))
    return _merge_stray(text, out)


def _merge_stray(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that hold no letter or digit belong to the sentence before them."""
    out: list[tuple[int, int]] = []
    for s, e in found:
        if out and not any(c.isalnum() for c in text[s:e]):
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _after_pair(text: str, start: int, body: int, i: int, j: int, skip, absorb) -> tuple[int, int]:
    """Whether the sentence ends with the pair (i, j): the end or 0, and where to go on."""
    inner = text[i + 1 : j].rstrip()
    k = j + 1
    nxt = skip(k)
    ch, gap = text[nxt : nxt + 1], text[k:nxt]
    head = i == start or i == body
    if not inner or inner[-1] not in STOPS:
        return 0, k
    if ch and ch in STOPS and not gap:
        return 0, k  # the stop that follows decides
    if not ch:
        return k, k
    if ch in COMMAS and not (ch in "-–—" and "\n" in gap):
        return 0, k
    if text[i] in BRACKETS:
        return (k, k) if head and i == body and text[i] not in "《〈" else (0, k)
    before = text[start:i].rstrip()[-1:]
    if before in ("：", ":"):
        return absorb(k), k
    if "\n" in gap or "\r" in gap:
        return k, k
    if head:
        return (k, k) if gap and ch.isupper() else (0, k)
    if before and before in ",，" and not cjk(ch) and not ch.islower():
        return k, k
    if gap and (ch.isupper() or cjk(ch)) and not cjk(text[i - 1 : i] or " "):
        return k, k
    return 0, k


def _run_ends(text: str, i: int, j: int) -> bool:
    """Several stops in a row, the first of them a period."""
    if set(text[i:j]) <= {".", "．"}:
        nxt = text[j:].lstrip()[:1] if j < len(text) else ""
        return not nxt or nxt.isupper() or cjk(nxt)
    return True


def _period_ends(text: str, i: int, judge: Judge) -> bool:
    prev, nxt = text[i - 1 : i], text[i + 1 : i + 2]
    if not nxt:
        return True
    if prev.isdigit() and nxt.isdigit():
        return False
    if nxt in "，,；;：:、)）”’\"":
        return bool(prev) and cjk(prev) and nxt in "”’\""
    if prev and cjk(prev):
        return not nxt.isdigit() or not prev.isdigit()
    if cjk(nxt):
        return True
    if not nxt.isspace():
        # a numbering mark or an opening mark right after a finished word
        m = NUMBERING.match(text, i + 1)
        return bool(m and m.end() < len(text) and cjk(text[m.end()]) and not prev.isdigit()) or nxt in "«¿¡"
    k = i + 1
    while k < len(text) and text[k].isspace():
        k += 1
    after = text[k : k + 1]
    if not after:
        return True
    word = _word_before(text, i)
    if after.islower():
        return not word and not prev.isdigit()
    if after in COMMAS:
        return False
    if not word:
        return True
    if after.isdigit():
        m = NUMBERING.match(text, k)
        if m and cjk(text[m.end() : m.end() + 1] or " "):
            return True
        j = _past_number(text, k)
        if cjk(text[j : j + 1] or " "):  # the number belongs to a sentence of another script
            return True
        return not judge.abbreviation(word, True) or "." in word and word.lower() not in ("e.g", "i.e")
    if not after.isupper() and not after in "«“\"¿¡(":
        return True
    w = word.lower()
    m = WORD.match(text, k + (0 if after.isupper() else 1))
    # a reference stands in the place of a number: cf. Sec. 75
    refers = m and text[m.end() : m.end() + 1] == "." and m[0].lower() in BEFORE_NUMBER
    if not judge.abbreviation(word, bool(refers or CODE.match(text, k))):
        return True
    if w in TITLES and after.isupper():
        return False
    if w.endswith(".m"):
        return True
    return bool(m) and judge.opens(m[0])


def _past_number(text: str, i: int) -> int:
    """Past the number at i and the blanks after it; raised and circled digits before it, which are no decimals, belong to it."""
    while text[i : i + 1].isdigit() and not text[i].isdecimal():
        i += 1
    m = AFTER_NUMBER.match(text, i)
    if m:
        return m.end()
    while i < len(text) and text[i].isspace():
        i += 1
    return i


def _word_before(text: str, i: int) -> str:
    """The cased word that ends at i, inner periods included; empty for numbers and other scripts."""
    j = i
    while j > 0 and (text[j - 1].isalpha() and not cjk(text[j - 1]) or text[j - 1] in ".-'’́"):
        j -= 1
    word = text[j:i].strip(".-'’")
    # what ends a longer token, an address say, is no word of its own
    return word if WORD.fullmatch(word) and (j == 0 or text[j - 1].isspace() or text[j - 1] in CLOSERS or text[j - 1] in PAIRS or cjk(text[j - 1])) else ""


def _line_ends(text: str, start: int, i: int, j: int) -> bool:
    """A line break ends a sentence after a heading, after a Thai one, and before an empty line."""
    line = text[start:i].rstrip()
    if not line or j >= len(text):
        return bool(line)
    if THAI.match(line[-1]):
        return _thai_blank_ends(text, i, j)
    if line[-1] in COMMAS:
        return False
    if text.count("\n", i, j) > 1:
        return True
    own = text.rfind("\n", 0, start) + 1
    short = 24 if cjk(line[-1]) else 60
    return len(line) <= short and "，" not in line and "," not in line and (bool(NUMBERING.match(line)) or not text[own:start].strip() or "：" in line[:6] or line[0].isupper() and not cjk(line[-1]))


def _thai_blank_ends(text: str, i: int, j: int) -> bool:
    """A blank after a Thai letter, unless the number it stands next to belongs to the Thai sentence."""
    if j >= len(text):
        return True
    if text[j].isdigit():
        m = AFTER_NUMBER.match(text, j)
        return not m or m.end() < len(text) and not THAI.match(text[m.end()])
    return True


def needed(text: str) -> set[str]:
    """Words around the periods that the document itself may leave open."""
    out = set()
    for m in re.finditer(rf"({WORD.pattern})\.\s+[«“\"¿¡(]?({WORD.pattern})", text):
        if m[2][0].isupper():
            out |= {m[1].lower(), m[2].lower()}
    return out


def _evidence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total: Counter = Counter()
        for t in b.column("text").to_pylist():
            if t and "." in t:
                total.update(evidence(t))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "word", "n"])


def _needed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, words = [], []
        for k, t in enumerate(b.column("text").to_pylist()):
            for w in needed(t) if t and "." in t else ():
                rows.append(k)
                words.append(w)
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(words, pa.string())], names=["id", "word"])


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, begin, end = [], [], []
        known = b.column("known").to_pylist()
        for k, t in enumerate(b.column("text").to_pylist()):
            if t:
                corpus = {(x["kind"], x["word"]): x["n"] for x in known[k] or ()}
                for s, e in spans(t, Judge(evidence(t) if "." in t else Counter(), corpus)):
                    rows.append(k)
                    begin.append(s)
                    end.append(e)
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["id", "begin_at", "end_at"])


def sentence_spans(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per sentence of every distinct row_id: row_id, begin_at, end_at (characters from 0, end exclusive).

    Rows of one id are taken as deliveries of one text (of several texts the least one). Null, empty and blank texts
    and null ids give no rows; whole texts are split, however long; an empty table gives no rows. Extra columns are ignored.
    """
    one = df.where(F.col(row_id).isNotNull() & (F.length(text) > 0)).groupBy(F.col(row_id).cast("long").alias("id")).agg(F.min(text).alias("text"))
    counts = one.mapInArrow(_evidence_rows, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    asked = one.mapInArrow(_needed_rows, "id long, word string")
    # a frequent word is asked for by many documents: their rows are spread, the counts are there once for each part
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    known = asked.join(counts, ["word", "salt"]).groupBy("id").agg(F.collect_list(F.struct("kind", "word", "n")).alias("known"))
    return one.join(known, "id", "left").mapInArrow(_span_rows, "id long, begin_at long, end_at long").withColumnRenamed("id", row_id)
