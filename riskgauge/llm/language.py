"""Language ID by a linear-chain conditional random field over words.

A word is a run of letters; of a longer run (scripts without spaces) each 64 letters are a word. A word's emission is the sum of the weights of its hashed features: itself (lexicon), its affixes of up to four
letters and its letter bigrams and trigrams. Transitions between languages are learned. Training texts are
spliced from stretches of labelled documents, so that languages switch within them. Posteriors of every word
come from forward-backward, which runs over all words of a batch of texts at once: texts are cut into blocks of
words, the blocks' transfer matrices are multiplied within all blocks in step, chained by text, and applied back.
A text's language is the one with the greatest sum of posteriors, and its score the mean posterior of it.

Fitted on at most ``train_docs`` labelled rows, dealt to the languages in turn, so that a rare one is learned too;
everything else covers all rows, whole texts. Defined results: a null text or one without a letter is ``und`` with
score 0; ties go to the language first in order; without any labelled row every text is ``und``; a row with a null
id is predicted and teaches nothing; repeated rows are predicted each on its own, and an id teaches once; columns
that aren't asked for are ignored, and those asked for may not be named lang_pred or score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as R
from .common import give_back, one_cache, remainder, ship, table, trimmed

TRAIN_DOCS, BUCKETS, STEPS, BATCH, LENGTH = 1600, 1 << 15, 200, 48, 40
#: Words of a block, words handled at once, and emissions that a worker keeps.
BLOCK, WORDS, KEEP = 32, 100_000, 200_000
#: Letters of a word at most, and words whose features are made at once.
PIECE, CHUNK = 64, 8192
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, longer ones in pieces; none if the text has no letter."""
    found = LETTERS.findall(text.lower()) if text else []
    if not any(map(str.isalpha, found)) and not any(c.isalpha() for w in found for c in w):
        return []
    if max(map(len, found)) > PIECE:
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, one after another, and the n + 1 bounds of the words."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(size + 2) - 1  # a word stands between ^ and $
    starts = ends - size
    data = np.frombuffer(b"".join(b"^%s$" % w for w in raw), dtype=np.uint8)
    x = data.astype(np.uint64)
    row = np.repeat(np.arange(len(raw)), size + 2)
    codes, rows = [R.word_hashes(data, starts, ends)], [np.arange(len(raw))]
    two = x[:-1] << R.U(8) | x[1:]
    for kind, code in ((1, two), (2, two[:-1] << R.U(8) | x[2:])):  # letter bigrams and trigrams, as bytes
        inside = np.flatnonzero(row[: len(code)] == row[len(x) - len(code) :])
        codes.append(code[inside] | R.U(kind << 56))
        rows.append(row[inside])
    for kind, at, step in ((3, starts, 1), (4, ends - 1, -1)):  # affixes
        code = np.zeros(len(raw), dtype=np.uint64)
        for k in range(4):
            on = np.flatnonzero(size > k)
            code[on] = code[on] << R.U(8) | x[at[on] + step * k]
            codes.append(code[on] | R.U((kind << 56) + (k << 48)))
            rows.append(on)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    ids = (R.mix(np.concatenate(codes))[order] & R.U(BUCKETS - 1)).astype(np.int64)
    return ids, np.searchsorted(row[order], np.arange(len(raw) + 1))


def posteriors(e: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posterior of each label of each word. e: (words, labels) log emissions; bounds: n + 1 bounds of the texts; none is empty."""
    n_labels, n_words = e.shape[1], np.diff(bounds)
    t = np.exp(trans)
    p = np.exp(e - e.max(axis=1, keepdims=True))
    blocks = -(-n_words // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))  # first block of each text
    total = int(first[-1])
    text = np.repeat(np.arange(len(n_words)), blocks)
    nth = np.arange(total) - first[text]
    at = bounds[text] + nth * BLOCK
    size = np.minimum(BLOCK, bounds[text + 1] - at)
    x = np.ones((total, BLOCK, n_labels))  # padding: nothing observed
    inside = np.arange(BLOCK) < size[:, None]
    x[inside] = p
    def move(a: np.ndarray, c: int) -> np.ndarray:
        """Rows of ``a`` (blocks, ..., labels) over the transition into word c; the first word of a text has none."""
        out = a @ t
        rows = ~inside[:, c] if c else nth == 0
        out[rows] = a[rows]
        return out
    m = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
    for c in range(BLOCK):
        m = move(m, c) * x[:, c, None, :]
        m /= m.sum(axis=(1, 2), keepdims=True)
    order = np.argsort(-blocks, kind="stable")
    longest = int(blocks.max())
    into = np.full((total, n_labels), 1 / n_labels)  # forward state before each block
    out_of = np.ones((total, n_labels))  # backward state after each block
    active = np.searchsorted(-blocks[order], -np.arange(longest), "left")  # texts with more than j blocks
    for j in range(1, longest):
        b = first[order[: active[j]]] + j
        v = np.einsum("ij,ijk->ik", into[b - 1], m[b - 1])
        into[b] = v / v.sum(axis=1, keepdims=True)
    for j in range(longest - 2, -1, -1):
        b = first[order[: active[j + 1]]] + j
        v = np.einsum("ijk,ik->ij", m[b + 1], out_of[b + 1])
        out_of[b] = v / v.sum(axis=1, keepdims=True)
    alpha, a = np.empty_like(x), into
    for c in range(BLOCK):
        a = move(a, c) * x[:, c]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, c] = a
    b = out_of
    for c in range(BLOCK - 1, -1, -1):
        alpha[:, c] *= b
        v = b * x[:, c]
        b = v @ t.T
        rows = ~inside[:, c] if c else nth == 0
        b[rows] = v[rows]
        b /= b.sum(axis=1, keepdims=True)
    g = alpha[inside]
    return g / g.sum(axis=1, keepdims=True)


class Crf:
    def __init__(self, labels: list[str]) -> None:
        self.labels = labels
        self.w = np.zeros((BUCKETS, len(labels)))
        self.trans = np.zeros((len(labels), len(labels)))

    def emissions(self, words: list[str], step: int = CHUNK) -> np.ndarray:
        """(words, labels)."""
        out = [np.zeros((0, len(self.labels)))]
        for i in range(0, len(words), step):
            ids, bounds = features(words[i : i + step])
            out.append(np.add.reduceat(self.w[ids], bounds[:-1], axis=0))
        return np.concatenate(out)

    def fit(self, texts: list[list[str]], y: list[int], seed: int = 3) -> Crf:
        """Stochastic gradient of the log likelihood of spliced texts (Adagrad)."""
        rng = np.random.default_rng(seed)
        by = [[t for t, k in zip(texts, y, strict=True) if k == i] for i in range(len(self.labels))]
        g2_w, g2_t = np.full_like(self.w, 1e-3), np.full_like(self.trans, 1e-1)
        seen = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(seen)}
        parts = [features(seen[i : i + CHUNK]) for i in range(0, len(seen), CHUNK)]
        ids = np.concatenate([i.astype(np.int32) for i, _ in parts])
        of_word = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))))
        del parts
        for _ in range(STEPS):
            words, gold = [], []
            for _ in range(BATCH):
                left, k = LENGTH, int(rng.integers(len(by)))
                while left > 0:
                    t = by[k][rng.integers(len(by[k]))]
                    n = min(left, len(t), int(rng.integers(5, 2 * LENGTH)))
                    s = int(rng.integers(len(t) - n + 1))
                    words += t[s : s + n]
                    gold += [k] * n
                    left -= n
                    k = int(rng.integers(len(by)))
            bounds = np.arange(0, len(words) + 1, LENGTH)
            at = np.array([number[w] for w in words])
            size = of_word[at + 1] - of_word[at]
            row = np.repeat(np.arange(len(at)), size)
            flat = ids[np.repeat(of_word[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            e = np.zeros((len(words), len(self.labels)))
            np.add.at(e, row, self.w[flat])
            gold_a = np.array(gold)
            one = np.eye(len(self.labels))[gold_a]
            d = one - posteriors(e, bounds, self.trans)
            g = np.zeros_like(self.w)
            np.add.at(g, flat, d[row])
            g /= BATCH
            g2_w += g * g
            self.w += 0.2 * g / np.sqrt(g2_w) - 1e-5 * self.w
            dt = self._pair_gradient(e, bounds, one) / BATCH
            g2_t += dt * dt
            self.trans += 0.2 * dt / np.sqrt(g2_t)
        return self

    def _pair_gradient(self, e: np.ndarray, bounds: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Observed less expected transitions; all texts have LENGTH words."""
        n = len(bounds) - 1
        x = np.exp(e - e.max(axis=1, keepdims=True)).reshape(n, LENGTH, -1)
        t = np.exp(self.trans)
        alpha, beta = np.empty_like(x), np.ones_like(x)
        a = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
        alpha[:, 0] = a
        for c in range(1, LENGTH):
            a = (a @ t) * x[:, c]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, c] = a
        for c in range(LENGTH - 2, -1, -1):
            b = (x[:, c + 1] * beta[:, c + 1]) @ t.T
            beta[:, c] = b / b.sum(axis=1, keepdims=True)
        pair = alpha[:, :-1, :, None] * t * (x[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        gold = one.reshape(n, LENGTH, -1)
        return np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:]) - pair.sum(axis=(0, 1))


class Emissions(dict):
    """Word to the number of its row of emissions; a bounded cache of two generations."""

    def __init__(self, crf: Crf) -> None:
        self.crf, self.rows = crf, np.empty((1024, len(crf.labels)))
        self.old, self.old_rows = {}, self.rows

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > KEEP:
            self.old, self.old_rows = dict(self), self.rows
            self.clear()
            self.rows = np.empty((1024, len(self.crf.labels)))
        unseen = [w for w in dict.fromkeys(words) if w not in self]
        if unseen:
            k, n = len(self), len(self) + len(unseen)
            if n > len(self.rows):
                more = np.empty((max(n, 2 * len(self.rows)), self.rows.shape[1]))
                more[:k] = self.rows[:k]
                self.rows = more
            was = np.array([self.old.get(w, -1) for w in unseen])
            new = np.empty((len(unseen), self.rows.shape[1]))
            new[was >= 0] = self.old_rows[was[was >= 0]]
            new[was < 0] = self.crf.emissions([w for w, i in zip(unseen, was.tolist(), strict=True) if i < 0])
            self.rows[k:n] = new
            self.update(zip(unseen, range(k, n), strict=True))
        return self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


_kept: dict[bytes, Emissions] = {}


def emissions_for(crf: Crf) -> Emissions:
    """One cache a model and worker process."""
    one_cache(_kept)
    key = crf.trans.tobytes()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Emissions(crf)
    return _kept[key]


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, held_out: int | None = 1) -> Crf:
    """Learns from text and non-null lang; rows with crc32(doc_id) mod 3 equal to ``held_out`` are left out (None: no row is)."""
    seen = docs.where("lang is not null and text is not null")
    if held_out is not None:
        seen = seen.where(remainder("doc_id", 3) != held_out)
    h = F.xxhash64("doc_id")
    own = seen.where("doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    # a hash's place among the ids of its language stands for the id's turn; at most train_docs languages are learned
    many = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(train_docs)
    turn = F.pmod(h, F.lit(1 << 30)) * F.col("n")
    ids = own.join(F.broadcast(many), "lang").orderBy(turn, h, "doc_id").limit(train_docs).select("doc_id", "lang")
    texts_of = seen.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")  # train_docs ids at most; no text is sent that isn't drawn
    drawn = texts_of.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("text").alias("text")).orderBy(h, "doc_id").toArrow()
    texts, y, once = [], [], {}
    labels = sorted(set(drawn.column("lang").to_pylist()))
    for lang, text in zip(drawn.column("lang").to_pylist(), drawn.column("text").to_pylist(), strict=True):
        if w := words_of(text):
            texts.append([once.setdefault(x, x) for x in w])  # one object a word
            y.append(labels.index(lang))
    labels_seen = sorted(set(y))
    crf = Crf([labels[k] for k in labels_seen])
    return crf.fit(texts, [labels_seen.index(k) for k in y]) if len(labels_seen) > 1 else crf


def _batches(words: list[list[str]]) -> Iterator[tuple[int, int]]:
    i = total = 0
    for j, w in enumerate(words):
        if j > i and total + len(w) > WORDS:
            yield i, j
            i, total = j, 0
        total += len(w)
    if i < len(words):
        yield i, len(words)


def predict(docs: DataFrame, crf: Crf, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score."""
    own = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = emissions_for(crf)
        for b in batches:
            for s in range(0, max(1, b.num_rows), 256):
                part = b.slice(s, 256)
                words = [words_of(t) for t in part.column("__text").to_pylist()]
                lang, score = [UNKNOWN] * len(words), [0.0] * len(words)
                for i, j in _batches(words) if crf.labels else ():
                    full = [k for k in range(i, j) if words[k]]
                    if not full:
                        continue
                    bounds = np.concatenate(([0], np.cumsum([len(words[k]) for k in full])))
                    g = posteriors(rows.of([w for k in full for w in words[k]]), bounds, crf.trans)
                    sums = np.add.reduceat(g, bounds[:-1], axis=0)
                    best = sums.argmax(axis=1)
                    for k, a, total, n in zip(full, best, sums, np.diff(bounds), strict=True):
                        lang[k], score[k] = crf.labels[a], float(min(1.0, total[a] / n))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    ship(docs.sparkSession)
    give_back()  # what training took
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(trimmed(run), f"{kinds}, lang_pred string, score double")


def label_words(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word_no, word, lang, posterior) for every word of every text: where code-switched texts change language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = emissions_for(crf)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not crf.labels or not (w := words_of(t)):
                    continue
                g = posteriors(rows.of(w), np.array([0, len(w)]), crf.trans)
                best = g.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(w), pa.int64()), pa.array(np.arange(len(w))), pa.array(w, pa.string()), pa.array([crf.labels[k] for k in best], pa.string()), pa.array(g.max(axis=1))], names=["doc_id", "word_no", "word", "lang", "posterior"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ship(docs.sparkSession)
    return own.mapInArrow(run, "doc_id long, word_no long, word string, lang string, posterior double")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs), ["doc_id"]).select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
