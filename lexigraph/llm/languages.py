"""Language of documents and of every stretch in them.

A byte convolutional network (embedding, filters of several widths, max pooling, softmax) is trained in numpy on texts
whose label names a language, and applied to fixed-length windows of UTF-8 bytes in batches. A sentence gets the mean
of its windows; only languages none of whose letters it holds are ruled out afterwards.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.llm import sentences

LANGUAGES = ["zh", "en", "ja", "ko", "ru", "vi", "th", "es", "pt"]
# Names of languages by which labels are spelled, in lower case and without region.
NAMES = {
    "zh": "zh zho chi cmn cn chinese mandarin zhongwen 中文 汉语 漢語 华语 chinois",
    "en": "en eng english anglais inglés 英文 英语",
    "ja": "ja jpn jp japanese 日本語 日语 日文",
    "ko": "ko kor kr korean 한국어 韩语 韩文 朝鲜语",
    "ru": "ru rus russian русский 俄语 俄文",
    "vi": "vi vie vn vietnamese tiếng việt 越南语",
    "th": "th tha thai ไทย 泰语 泰文",
    "es": "es spa spanish español espanol castellano castilian 西班牙语",
    "pt": "pt por portuguese português portugues 葡萄牙语",
}
# Other languages' codes and names, which a label may carry too.
OTHERS = "fr fra fre french de deu ger german it ita italian nl nld dut dutch ar ara arabic hi hin hindi tr tur turkish pl pol polish uk ukr ukrainian id ind indonesian ms msa malay fa fas per persian sv swe swedish cs ces cze czech el ell gre greek he heb hebrew ug uig uyghur bo bod tib tibetan mn mon mongolian ro ron rum romanian hu hun hungarian fi fin finnish da dan danish no nor norwegian la lat latin"
BY_NAME = {name: code for code, names in NAMES.items() for name in names.split()} | {name: "other" for name in OTHERS.split()}

#: Labelled parts of texts the network is trained on, per language, windows taken from each, and characters of a part.
TEXTS, WINDOWS, PART = 300, 8, 20_000
#: Bytes of a window; embedding size; filter widths; filters of each width.
SIZE, EMBED, WIDTHS, FILTERS = 64, 12, (2, 3, 5), 24
EPOCHS, BATCH, RATE, SEED = 5, 128, 3e-3, 11
#: Least number of updates: small samples are gone through more often.
STEPS = 400
#: Letters that make a stretch a sentence: of scripts without blanks, and of scripts with words.
LETTERS, WORDS = 5, 3

#: Sentences below this confidence are weighed by the rest of the document, over this floor, and by the shares of their scripts.
SURE, PRIOR = 0.97, 0.02
#: Share of letters of scripts that aren't a language's own.
FOREIGN = 0.01

MARKUP = re.compile(r"<[^<>]+>|&#?\w+;|(?:https?://|www\.)\S+|[\w.+-]+\s?(?:@|＠|\[at\])\s?[\w.-]+")
#: What every match of MARKUP has one of.
SIGNS = ("<", "&", "@", "＠", "[at]", "http", "www.")
# First and last letters of the scripts.
SCRIPTS = {
    "han": [("㐀", "鿿"), ("豈", "﫿"), ("\U00020000", "\U0003ffff")],
    "kana": [("ぁ", "ゟ"), ("゠", "ヿ"), ("ㇰ", "ㇿ"), ("ｦ", "ﾟ")],
    "hangul": [("가", "힣"), ("ᄀ", "ᇿ"), ("㄰", "㆏")],
    "thai": [("ก", "๎")],
    "cyrillic": [("Ѐ", "ԯ")],
    "latin": [("A", "Z"), ("a", "z"), ("À", "ɏ"), ("Ḁ", "ỿ")],
}
SCRIPT_OF = {"zh": ("han",), "ja": ("kana", "han"), "ko": ("hangul",), "ru": ("cyrillic",), "th": ("thai",), "en": ("latin",), "vi": ("latin",), "es": ("latin",), "pt": ("latin",)}
#: Scripts by rows, languages by columns: which letters are a language's.
OWN = np.array([[script in SCRIPT_OF[code] for code in LANGUAGES] for script in SCRIPTS])
LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ][A-Za-zÀ-ɏḀ-ỿ̀-ͯ'’-]+")
CYRILLIC_WORD = re.compile(r"[Ѐ-ԯ][Ѐ-ԯ̀-ͯ'’-]+")
#: Languages whose words are set apart, with their words.
SPACED = {"latin": LATIN_WORD, "cyrillic": CYRILLIC_WORD}
#: Characters counted together.
BLOCK = 1 << 18


def _script_table() -> np.ndarray:
    """Number of the script of every code point up to the supplementary ideographs; the last number is no script."""
    table = np.full(0x40000, len(SCRIPTS), np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            table[ord(first) : ord(last) + 1] = k
    return table


TABLE = _script_table()


def label_language(label: str | None) -> str | None:
    """Language that a label names: its code, `other` for one outside the list, null for none."""
    if not label:
        return None
    key = label.strip().lower()
    return BY_NAME.get(key) or BY_NAME.get(re.split(r"[-_. (/]", key)[0])


def blanked(text: str) -> str:
    """The text with links, addresses and markup blanked, character for character."""
    return MARKUP.sub(lambda m: " " * len(m[0]), text) if any(sign in text for sign in SIGNS) else text


def windows(raw: bytes) -> list[bytes]:
    """Fixed-length windows of a stretch; the last one is padded with zeros."""
    return [raw[i : i + SIZE].ljust(SIZE, b"\0") for i in range(0, max(len(raw), 1), SIZE)]


class Network:
    """Byte CNN with its Adam state; inference works on tables of filter responses per byte."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"] = rng.normal(0, (len(WIDTHS) * FILTERS) ** -0.5, (len(WIDTHS) * FILTERS, len(LANGUAGES)))
        self.p["c"] = np.zeros(len(LANGUAGES))
        self.p["s"] = np.zeros((len(SCRIPTS), len(LANGUAGES)))  # logarithms of how usual each script's letters are in a language
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
        """Cross-entropy with rare languages weighted up; after two fifths of the rounds, labels that the network flatly contradicts are left out."""
        rng = np.random.default_rng(seed)
        count = np.bincount(y, minlength=len(LANGUAGES)).astype(float)
        weight = np.where(count > 0, len(y) / np.maximum(count, 1), 0) ** 0.5
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, rows = 0, np.arange(len(y))
        rounds = max(EPOCHS, -(-STEPS * BATCH // len(y)))
        for epoch in range(rounds):
            if epoch == 2 * rounds // 5:
                prob = self.predict(x)
                doubt = (prob.max(1) > 0.9) & (prob.argmax(1) != y)
                rows = np.flatnonzero(~doubt)
            rng.shuffle(rows)
            for i in range(0, len(rows), BATCH):
                part = rows[i : i + BATCH]
                g = self._gradients(x[part], y[part], weight)
                step += 1
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n, x = self.p, len(x), x.astype(np.intp)
        tables = self._tables()
        pooled, kept = [], {}
        for w in WIDTHS:
            r = self._responses(x, tables[w]) + p[f"b{w}"]
            at = r.argmax(1)
            top = np.take_along_axis(r, at[:, None], 1)[:, 0]
            kept[w] = at, top > 0
            pooled.append(np.maximum(top, 0))
        h = np.concatenate(pooled, 1)
        z = h @ p["o"] + p["c"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q *= (weight[y] / weight[y].sum())[:, None]
        g = {"o": h.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
        dh = q @ p["o"].T
        for j, w in enumerate(WIDTHS):
            at, on = kept[w]
            d = dh[:, j * FILTERS : (j + 1) * FILTERS] * on
            byte = [x[np.arange(n)[:, None], at + k] for k in range(w)]  # bytes under each filter's best place
            picked = np.concatenate([p["e"][c] for c in byte], 2)  # (n, filters, w * embed)
            g[f"w{w}"] = np.einsum("nfd,nf->df", picked, d)
            g[f"b{w}"] = d.sum(0)
            back = (p[f"w{w}"].T[None] * d[:, :, None]).reshape(n, FILTERS, w, EMBED)
            for k in range(w):
                for c in range(EMBED):
                    g["e"][:, c] += np.bincount(byte[k].ravel(), back[:, :, k, c].ravel(), 256)
        return g

    def _tables(self) -> dict[int, list[np.ndarray]]:
        """What each byte adds to the filters of each width, by its place under them."""
        p = self.p
        return {w: [(p["e"] @ p[f"w{w}"][k * EMBED : (k + 1) * EMBED]).astype(np.float32) for k in range(w)] for w in WIDTHS}

    @staticmethod
    def _responses(x: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
        """Filter responses of one width at every place of windows."""
        places = SIZE - len(table) + 1
        r = table[0][x[:, :places]]
        for k in range(1, len(table)):
            r += table[k][x[:, k : places + k]]
        return r

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of windows, in batches."""
        p, tables = self.p, self._tables()
        out = []
        for i in range(0, len(x), 128):  # small enough to stay in the processor's cache
            b = x[i : i + 128].astype(np.intp)
            pooled = []
            for w in WIDTHS:
                pooled.append(np.maximum(self._responses(b, tables[w]).max(1) + p[f"b{w}"], 0))
            z = np.concatenate(pooled, 1) @ p["o"] + p["c"]
            q = np.exp(z - z.max(1, keepdims=True))
            out.append(q / q.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(LANGUAGES)), np.float32)


def to_bytes(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, SIZE)


def train_network(labelled: list[tuple[str, str]]) -> Network:
    """A network from (text, language) pairs."""
    parts, y, letters = [], [], np.ones((len(SCRIPTS), len(LANGUAGES)))
    for text, code in labelled:
        clear = blanked(text)
        letters[:, LANGUAGES.index(code)] += script_counts(clear, [(0, len(clear))])[0]
        own = windows(clear.encode("utf-8", "replace"))
        for k in np.linspace(0, len(own) - 1, min(WINDOWS, len(own))).astype(int):
            parts.append(own[k])
            y.append(LANGUAGES.index(code))
    net = Network()
    if not parts:
        return net
    # how often each of a language's own scripts is used in it; letters of other scripts are equally rare in all
    net.p["s"] = np.log(np.where(OWN, letters / (letters * OWN).sum(0), FOREIGN)).astype(np.float32)
    return net.train(to_bytes(parts), np.array(y))


def script_counts(text: str, at: list[tuple[int, int]]) -> np.ndarray:
    """Letters of each script in each stretch of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = TABLE[np.minimum(codes, len(TABLE) - 1)]
    kinds[codes >= len(TABLE)] = len(SCRIPTS)
    sums = np.zeros((len(codes) + 1, len(SCRIPTS)), np.int32)
    np.cumsum(kinds[:, None] == np.arange(len(SCRIPTS)), 0, np.int32, sums[1:])
    begin, end = np.array(at, np.int64).reshape(-1, 2).T
    return sums[end] - sums[begin]


def whole(parts: list[str], counts: np.ndarray) -> np.ndarray:
    """For each stretch and language whether it is more than single words, names or markup of the language."""
    least = np.array([LETTERS - (code == "ko") for code in LANGUAGES])
    out = counts @ OWN >= least
    for k, script in enumerate(SCRIPTS):
        if script in SPACED:
            words = np.zeros(len(parts), bool)
            for r in np.flatnonzero(counts[:, k] >= 2 * WORDS):
                words[r] = len(SPACED[script].findall(parts[r])) >= WORDS
            out[:, OWN[k]] = words[:, None]
    return out


def _sentences(texts: list[str | None]) -> Iterator[tuple[list[int], list[tuple[int, int]], list[str], np.ndarray]]:
    """Sentences of blocks of texts that hold letters of the scripts: numbers of their texts, spans, stretches and letters."""
    owner, at, parts, spans, clear, size = [], [], [], [], [], 0
    for k, text in enumerate([*texts, None]):
        plain = blanked(text) if text else ""
        if plain.strip():
            for s, e in sentences.spans(plain, sentences.Judge(sentences.evidence(plain) if "." in plain else Counter(), {})):
                owner.append(k)
                spans.append((s, e))
                at.append((size + s, size + e))
                parts.append(plain[s:e])
        clear.append(plain)
        size += len(plain)
        if size > BLOCK or k == len(texts):
            counts = script_counts("".join(clear), at)
            some = np.flatnonzero(counts.any(1))
            yield [owner[r] for r in some], [spans[r] for r in some], [parts[r] for r in some], counts[some]
            owner, at, parts, spans, clear, size = [], [], [], [], [], 0


def stretches(texts: list[str | None], net: Network) -> list[list[tuple[int, int, str, float, bool]]]:
    """For each text its sentences as (begin, end, language, confidence, whole sentence)."""
    out: list[list[tuple[int, int, str, float, bool]]] = [[] for _ in texts]
    for owner, spans, parts, counts in _sentences(texts):
        if not owner:
            continue
        cut = [windows(p.encode("utf-8", "replace")) for p in parts]
        number = np.array([len(c) for c in cut])
        log = np.log(net.predict(to_bytes([w for c in cut for w in c])) + 1e-9)
        mean = np.add.reduceat(log, np.cumsum(number) - number, 0) / number[:, None]
        # only languages without any letter in the stretch are ruled out; one in which it is a whole sentence goes before
        # one of which it holds words
        ok, full = counts @ OWN > 0, whole(parts, counts)
        full &= ok
        open_to = np.where(full.any(1, keepdims=True), full, ok)
        prob = np.exp(mean) * open_to
        prob /= prob.sum(1, keepdims=True)
        docs = np.array(owner)
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        n = np.diff(np.r_[first, len(docs)])
        # short or doubtful sentences lean on the rest of their document, and on how usual their letters are in each language
        rest = (np.repeat(np.add.reduceat(prob, first, 0), n, 0) - prob) / np.maximum(np.repeat(n, n) - 1, 1)[:, None]
        usual = np.where(open_to, counts @ net.p["s"], -np.inf)
        leaned = prob * (PRIOR + rest) * np.exp(usual - usual.max(1, keepdims=True))
        doubtful = prob.max(1) < SURE
        prob = np.where(doubtful[:, None], leaned / leaned.sum(1, keepdims=True), prob)
        best = prob.argmax(1)
        for k, (s, e), b, p, f in zip(owner, spans, best.tolist(), prob.max(1).tolist(), full[np.arange(len(best)), best].tolist()):
            out[k].append((s, e, LANGUAGES[b], p, f))
    return out


def _labelled(df: DataFrame, row_id: str, text: str, label: str) -> list[tuple[str, str]]:
    """The bounded training sample: per language named, TEXTS parts of texts in the order of their hashes; a text is cut into parts of PART characters."""
    key = F.lower(F.trim(label))
    code = F.create_map(*[F.lit(x) for kv in BY_NAME.items() for x in kv])
    named = df.withColumn("code", F.coalesce(code[key], code[F.split(key, r"[-_. (/]")[0]])).where(F.col("code").isin(LANGUAGES) & (F.length(text) >= 20))
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PART).cast("int"))).alias("n")
    cut = named.select("code", row_id, text, parts).select("code", row_id, "n", F.substr(text, F.col("n") * PART + 1, F.lit(PART)).alias("part"))
    order = Window.partitionBy("code").orderBy(F.xxhash64(row_id, "n"), row_id, "n")
    picked = cut.where(F.length("part") >= 20).withColumn("r", F.row_number().over(order)).where(F.col("r") <= TEXTS)
    return [(r["part"], r["code"]) for r in picked.orderBy("code", "r").collect()]  # at most TEXTS parts per language


def language_stretches(df: DataFrame, row_id: str, text: str, label: str) -> DataFrame:
    """One row per stretch of every document: row_id, label (as delivered), begin_at, end_at, language, confidence, whole.

    Neighbouring sentences of one language form one stretch, whose confidence is their mean; `whole` tells that it holds at least one whole
    sentence rather than single words, names or markup. Null, empty and blank texts, and texts without letters of the
    languages' scripts, give no rows; repeated rows stay repeated; an empty table gives no rows. Without any labelled text the network
    is untrained and scripts alone decide. Extra columns are ignored.
    """
    net = train_network(_labelled(df, row_id, text, label))
    shared = df.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.p = shared.value
        for b in batches:
            rows = []
            for k, found in enumerate(stretches(b.column("text").to_pylist(), own)):
                held = None
                for s, e, code, conf, ok in found:
                    if held and held[3] == code:
                        held[2], held[4], held[5], held[6] = e, held[4] + conf, held[5] + 1, held[6] or ok
                    else:
                        held = [k, s, e, code, conf, 1, ok]
                        rows.append(held)
            cols = list(zip(*rows)) if rows else [()] * 7
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("label").take(at), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array([c / n for c, n in zip(cols[4], cols[5])], pa.float64()), pa.array(cols[6], pa.bool_())],
                names=["id", "label", "begin_at", "end_at", "language", "confidence", "whole"],
            )

    slim = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))
    schema = "id long, label string, begin_at long, end_at long, language string, confidence double, whole boolean"
    return slim.mapInArrow(run, schema).withColumnRenamed("id", row_id)


def mislabelled(found: DataFrame, row_id: str) -> DataFrame:
    """Languages of the documents whose label is missing, wrong, or not the only language: row_id, language, confidence."""
    key = F.lower(F.trim("label"))
    code = F.create_map(*[F.lit(x) for kv in BY_NAME.items() for x in kv])
    named = found.where("whole").withColumn("named", F.coalesce(code[key], code[F.split(key, r"[-_. (/]")[0]]))
    per = named.groupBy(row_id, "language").agg(F.max("confidence").alias("confidence"), F.max("named").alias("named"))
    docs = per.groupBy(row_id).agg(F.collect_list(F.struct("language", "confidence")).alias("all"), F.max("named").alias("named"))  # at most one per language
    right = F.col("named").isNotNull() & F.exists("all", lambda x: x["language"] == F.col("named")) & (F.size("all") == 1)
    return docs.where(~right).select(row_id, F.explode("all").alias("x")).select(row_id, "x.language", "x.confidence")
