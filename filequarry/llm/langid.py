"""Language identification by a linear-chain conditional random field over words.

Each word of a text is a position of the chain and each language a state. State features are
affixes and inner n-grams (all runs of two to four bytes of the word between marks for its start
and end) and the word itself where it is in a lexicon of words frequent in some language.
Transitions between the languages of neighbouring words are learned, too, so the forward-backward
pass labels code-switched text word by word. A text's language is the one with the largest mean
posterior; that mean is the score.

Training takes a bounded sample: at most ``PER_LANGUAGE`` texts of each language, by hash of the id
and text, up to ``SAMPLE_WORDS`` words of each in runs from all over it, at hashed places (no language
is left out, however many there are), joined in stretches of different languages so that
transitions are seen; maximum likelihood by AdaGrad. Learning never sees a held-out document.

Null texts and those without a letter are ``und`` with score 0. Rows keep their number. Labels that
are null are not learned; without any label every text is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from filequarry.llm.common import mix64, slices, small_batches, written

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
PER_LANGUAGE, SAMPLE_WORDS, LEXICON = 150, 150, 2000
#: Runs of words, one from each of so many equal parts of a sampled text.
SAMPLE_RUNS = 5
EPOCHS, BATCH, STEP = 6, 64, 0.2
#: Distinct words whose scores a task remembers.
HELD = 300_000
CHUNK = 128


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case; numerals that stand alone are no words."""
    found = WORD.findall(text.lower()) if text else []
    return found if not text or text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in turn, and where each word's begin."""
    raw = [b"^" + w.encode() + b"$" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    owner = np.repeat(np.arange(len(raw)), length)
    number, of = [], []
    for n in (2, 3, 4):
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(257) + data[i : len(data) - n + 1 + i] + np.uint64(1)
            at = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
            number.append((mix64(h[at]) % np.uint64(BUCKETS)).astype(np.int64))
            of.append(owner[at])
    word = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    known = np.flatnonzero(word >= 0)
    number.append(BUCKETS + word[known])
    of.append(known)
    number, of = np.concatenate(number), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return number[order], np.searchsorted(of[order], np.arange(len(words)))


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # log potentials

    def scores(self, words: list[str]) -> np.ndarray:
        """Log potentials of distinct words."""
        number, starts = features(words, self.lexicon)
        return np.add.reduceat(self.weights[number], starts, axis=0)


def forward_backward(e: np.ndarray, mask: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, scaled forward and backward vectors of chains (chains x steps x languages)."""
    n, steps, k = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    v = np.full((n, k), 1.0 / k)
    for t in range(steps):
        new = (v @ a) * e[:, t] if t else v * e[:, 0]
        new /= new.sum(axis=1, keepdims=True)
        v = np.where(mask[:, t, None], new, v)
        alpha[:, t] = v
    v = np.full((n, k), 1.0)
    for t in reversed(range(steps)):
        beta[:, t] = v
        new = (e[:, t] * v) @ a.T
        new /= new.sum(axis=1, keepdims=True)
        v = np.where(mask[:, t, None], new, v)
    post = alpha * beta
    return post / post.sum(axis=2, keepdims=True), alpha, beta


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model:
    """rows: (text, language), a bounded sample."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    words = [(words_of(t)[:SAMPLE_WORDS], languages.index(lang)) for t, lang in rows]
    counts: dict[int, Counter] = defaultdict(Counter)
    for ws, k in words:
        counts[k].update(ws)
    lexicon = {w: i for i, w in enumerate(sorted({w for c in counts.values() for w, n in c.most_common(LEXICON) if n > 1}))}
    stretches = []
    for ws, k in words:
        at = 0
        while at < len(ws):
            n = int(rng.integers(8, 60))
            stretches.append((ws[at : at + n], k))
            at += n
    rng.shuffle(stretches)
    chains, now = [], ([], [])
    for ws, k in stretches:
        now[0].extend(ws)
        now[1].extend([k] * len(ws))
        if len(now[0]) >= 100:
            chains.append(now)
            now = ([], [])
    if now[0]:
        chains.append(now)
    vocab = {w: i for i, w in enumerate(sorted({w for c, _ in chains for w in c}))}
    number, starts = features(list(vocab), lexicon) if vocab else (np.empty(0, np.int64), np.empty(0, np.int64))
    ends = np.append(starts[1:], len(number))
    k = len(languages)
    weights, trans = np.zeros((BUCKETS + len(lexicon), k)), np.eye(k)
    g_w, g_t = np.full_like(weights, 1e-2), np.full_like(trans, 1e-2)
    for _ in range(EPOCHS if k > 1 else 0):
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // BATCH)):
            own = [chains[i] for i in part]
            steps = max(len(c) for c, _ in own)
            ids, gold, mask = np.zeros((len(own), steps), np.int64), np.zeros((len(own), steps), np.int64), np.zeros((len(own), steps), bool)
            for i, (c, y) in enumerate(own):
                ids[i, : len(c)], gold[i, : len(c)], mask[i, : len(c)] = [vocab[w] for w in c], y, True
            used, at = np.unique(ids, return_inverse=True)
            feat = np.concatenate([number[starts[u] : ends[u]] for u in used])
            many = ends[used] - starts[used]
            score = np.add.reduceat(weights[feat], np.cumsum(many) - many, axis=0)[at.reshape(ids.shape)]
            e, a = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(trans)
            post, alpha, beta = forward_backward(e, mask, a)
            grad = (np.eye(k)[gold] - post) * mask[:, :, None]
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, at.reshape(-1), grad.reshape(-1, k))
            g = np.zeros_like(weights)
            np.add.at(g, feat, np.repeat(by_word, many, axis=0))
            g -= 1e-3 * weights
            g_w += g * g
            weights += STEP * g / np.sqrt(g_w)
            both = mask[:, 1:]
            pair = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair = (pair / pair.sum(axis=(2, 3), keepdims=True) * both[:, :, None, None]).sum(axis=(0, 1))
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            gt = seen - pair
            g_t += gt * gt
            trans = trans + STEP * gt / np.sqrt(g_t)
    return Model(languages, lexicon, weights.astype(np.float32), trans)


class Labeller:
    """Posteriors of whole texts; a word's scores are computed once while remembered."""

    def __init__(self, model: Model):
        self.model, self.a = model, np.exp(model.transitions)
        self.index, self.table = {}, np.empty((0, len(model.languages)))

    def _scores(self, words: list[str]) -> np.ndarray:
        if len(self.index) > HELD:
            keep = HELD // 3
            self.index, self.table = dict(list(self.index.items())[:keep]), self.table[:keep]
        at = list(map(self.index.get, words))
        if None in at:
            gaps = [i for i, x in enumerate(at) if x is None]
            new = list(dict.fromkeys(words[i] for i in gaps))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            got = self.model.scores(new).astype(float)
            self.table = np.concatenate([self.table, np.exp(got - got.max(axis=1, keepdims=True)) + 1e-12])
            for i in gaps:
                at[i] = self.index[words[i]]
        return self.table[np.array(at, np.int64)]

    def posteriors(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Word posteriors of all texts in turn, and the bounds of each text.

        Long chains are cut in chunks whose transfer matrices are multiplied, so the number of
        steps is that of a chunk, and the result that of one pass over the whole chain.
        """
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(length)])
        k = len(self.model.languages)
        if not bounds[-1]:
            return np.empty((0, k)), bounds
        e = self._scores([w for t in texts for w in t])
        chunks = -(-length // CHUNK)
        first = np.concatenate([[0], np.cumsum(chunks)])[:-1]
        word = np.arange(bounds[-1])
        text = np.repeat(np.arange(len(texts)), length)
        place = word - bounds[text]
        row, col = first[text] + place // CHUNK, place % CHUNK
        n = int(chunks.sum())
        pad, mask = np.ones((n, CHUNK, k)), np.zeros((n, CHUNK), bool)
        pad[row, col], mask[row, col] = e, True

        transfer = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        begins = np.zeros(n, bool)
        begins[first[chunks > 0]] = True
        for t in range(CHUNK):
            new = transfer @ self.a if t else np.where(begins[:, None, None], transfer, transfer @ self.a)
            new = new * pad[:, t, None, :]
            new /= new.sum(axis=(1, 2), keepdims=True)
            transfer = np.where(mask[:, t, None, None], new, transfer)
        into, out = np.full((n, k), 1.0 / k), np.ones((n, k))
        for c in range(1, int(chunks.max())):
            at = first[chunks > c] + c
            v = (into[at - 1][:, None, :] @ transfer[at - 1])[:, 0]
            into[at] = v / v.sum(axis=1, keepdims=True)
        for c in range(int(chunks.max()) - 2, -1, -1):
            at = first[chunks > c + 1] + c
            v = (transfer[at + 1] @ out[at + 1][:, :, None])[:, :, 0]
            out[at] = v / v.sum(axis=1, keepdims=True)

        alpha = np.empty_like(pad)
        v = into
        for t in range(CHUNK):
            new = np.where(begins[:, None], v, v @ self.a) if t == 0 else v @ self.a
            new = new * pad[:, t]
            new /= new.sum(axis=1, keepdims=True)
            v = np.where(mask[:, t, None], new, v)
            alpha[:, t] = v
        v = out
        for t in reversed(range(CHUNK)):
            alpha[:, t] *= v
            new = (pad[:, t] * v) @ self.a.T
            new /= new.sum(axis=1, keepdims=True)
            v = np.where(mask[:, t, None], new, v)
        post = alpha[row, col]
        return post / post.sum(axis=1, keepdims=True), bounds

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [("und", 0.0)] * len(texts)
        words = [words_of(t) for t in texts]
        post, bounds = self.posteriors(words)
        total = np.add.reduceat(np.concatenate([post, np.zeros((1, post.shape[1]))]), np.minimum(bounds[:-1], len(post)), axis=0)
        out = []
        for i, ws in enumerate(words):
            if ws:
                share = total[i] / len(ws)
                best = int(share.argmax())
                out.append((self.model.languages[best], min(1.0, float(share[best]))))
            else:
                out.append(("und", 0.0))
        return out


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from a bounded sample of the documents that are not held out."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    fit = rows.filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    # Spark keeps the first of each language within each partition before it shuffles them
    key = ["lang", "id", "check"]
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id", "check"), "id", "check")
    fit = fit.withColumn("check", F.xxhash64("text"))
    picks = fit.select(*key).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language).select(*key).distinct()
    picks = written(picks, "sample")
    if picks.isEmpty():
        return Model([], {}, np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    chosen = fit.join(F.broadcast(picks), key, "left_semi").dropDuplicates(key)  # per_language for each language at most
    # the sample's words, not whole texts, come to the driver
    words = F.array_join(sampled_words(F.split(F.btrim(F.regexp_replace("text", r"[^\p{L}]+", " ")), " "), F.col("check")), " ")
    return train([(r.words, r.lang) for r in chosen.select("id", words.alias("words"), "lang").orderBy("id", "words").collect()])


def sampled_words(words: Column, seed: Column) -> Column:
    """All ``words`` if they are few; else a run of each of ``SAMPLE_RUNS`` parts, at a place that hangs on ``seed``."""
    n, run = F.size(words), SAMPLE_WORDS // SAMPLE_RUNS
    part = F.floor(n / SAMPLE_RUNS).cast("int")

    def one(k: int) -> Column:
        begin = part * k + F.pmod(F.xxhash64(seed, F.lit(k)), part - run + 1).cast("int")
        return F.slice(words, begin + 1, F.lit(run))

    return F.when(n <= SAMPLE_WORDS, words).otherwise(F.concat(*map(one, range(SAMPLE_RUNS))))


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; the columns it had are kept, but for those two."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        label = Labeller(shared.value)
        for part in slices(batches, text):
            got = label.languages(part.column(text).to_pylist())
            cols = {n: part.column(n) for n in part.schema.names}
            cols |= {"lang_pred": pa.array([x for x, _ in got], pa.string()), "score": pa.array([y for _, y in got], pa.float64())}
            yield pa.record_batch(cols)

    return docs.mapInArrow(run, schema)
