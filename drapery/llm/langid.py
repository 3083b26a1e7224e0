"""Language identification of words and texts by a linear-chain CRF.

Labels are the languages of the training rows. A word's features are its
affixes, letter n-grams and its place in per-language lexicons; transitions
between the labels of neighbouring words are learned too. Marginals come from
forward-backward over chains of ``CHAIN`` consecutive words, all chains of a
block of texts in lockstep. A word of more than ``PIECE`` characters, as texts
without white space are, is taken as consecutive words of ``PIECE``
characters each, in training too. A text's language is the label with the largest
mean marginal over its words with letters, its score that mean; per-language
shares describe code-switched text.

Training uses a bounded sample of labelled rows: at most ``rows_per_lang`` rows
a language, of each at most ``words_per_row`` consecutive words from a hashed
place. Rows of different languages are partly joined into one chain, so that
switches are seen. Everything else reads all rows and whole texts.

Defined results: null text or text without a letter gives ``und`` with score 0;
ties go to the first label in code point order; without any labelled row every
prediction is ``und``; repeated rows get equal predictions.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, up_to

CHAIN = 64
PIECE = 64
MEMO = 400_000
#: Words whose features are made at once.
LEARN = 50_000
BLOCK_WORDS = 200_000
UND = "und"
LETTER = re.compile(r"[^\W\d_]")
MARKS = ".,;:!?\"'()[]{}<>|"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray      # (2**bits, labels)
    transitions: np.ndarray  # (labels, labels), log scores from -> to
    lexicon: dict[str, tuple[int, ...]]  # frequent words -> labels they are frequent in
    bits: int


def pieces(words_: list[str]) -> list[str]:
    """The words, those of more than ``PIECE`` characters cut into consecutive pieces."""
    if max(map(len, words_), default=0) <= PIECE:
        return words_
    return [w[k:k + PIECE] for w in words_ for k in range(0, len(w), PIECE)]


def word_features(words_: list[str], lexicon: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of distinct words: feature ids, the word each belongs to, and which words have letters.

    Features are the letter pairs and triples (with the word's ends marked),
    the first and last one to four letters, and the lexicons' languages;
    words without a letter have none.
    """
    letters = np.fromiter((LETTER.search(w) is not None for w in words_), bool, len(words_))
    stripped = [w.lower().strip(MARKS) for w in words_]
    codes = np.frombuffer("".join(f"^{w}$" for w in stripped).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, stripped), np.int64, len(words_))
    first = np.cumsum(size + 2) - (size + 2)
    word = np.repeat(np.arange(len(words_)), size + 2)
    ids, of = [], []

    def add(salt: int, at: np.ndarray, n: int, w: np.ndarray) -> None:
        x = np.full(len(at), salt, np.uint64)
        for j in range(n):
            x = (x ^ codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        ids.append((x >> np.uint64(7)) & np.uint64((1 << bits) - 1))
        of.append(w)

    for n in (2, 3):
        at = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1:]) if len(word) >= n else np.zeros(0, np.int64)
        add(n, at, n, word[at])
    for n in (1, 2, 3, 4):
        w = np.flatnonzero(size >= n)
        add(10 + n, first[w] + 1, n, w)
        add(20 + n, first[w] + 1 + size[w] - n, n, w)
    listed = [(k, i) for i, w in enumerate(stripped) for k in lexicon.get(w, ())]
    if listed:
        ids.append(np.array([(k * 7919 + 13) % (1 << bits) for k, _ in listed], np.uint64))
        of.append(np.array([i for _, i in listed]))
    ids, of = np.concatenate(ids).astype(np.int64), np.concatenate(of)
    keep = letters[of]
    return ids[keep], of[keep], letters


def sample_rows(docs: DataFrame, held_out, rows_per_lang: int, words_per_row: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """The bounded training sample: ``lang, words``."""
    pick = F.xxhash64(F.lit("train"), F.col(id_col))
    d = docs.filter(~held_out & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    d = d.select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), pick.alias("pick"))
    # hashes are spread evenly, so the smallest ``rows_per_lang`` of a language lie below a bound that follows from
    # its number of rows; only a few times that many rows are ranked
    counts = up_to(d.groupBy("lang").agg(F.count("*").alias("rows")), 10_000)
    share = F.least(F.lit(1.0), 4.0 * rows_per_lang / F.col("rows"))
    few = d.join(counts, "lang").filter(F.col("pick").cast("double") <= F.lit(-2.0 ** 63) + share * F.lit(2.0 ** 64)).drop("rows")
    ranked = (few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("pick", "id", "text")))
              .filter(F.col("n") <= rows_per_lang))
    all_words = F.regexp_extract_all(F.col("text"), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))  # in pieces
    place = F.pmod(F.col("pick"), F.greatest(F.size("w") - words_per_row, F.lit(1))) + 1
    return (ranked.withColumn("w", all_words).filter(F.size("w") > 0)
                  .select("lang", "n", F.slice("w", place.cast("int"), F.lit(words_per_row)).alias("words")))


def _marginals(scores: np.ndarray, trans: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains: ``scores`` (B, T, K), ``live`` (B, T) marks words.

    Returns the marginals and the expected transitions (K, K).
    """
    B, T, K = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(trans - trans.max())
    alpha, beta = np.empty((T, B, K)), np.empty((T, B, K))
    a = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    alpha[0] = a
    for t in range(1, T):
        a = (a @ step) * emit[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t] = a
    b = np.ones((B, K))
    beta[T - 1] = b
    for t in range(T - 2, -1, -1):
        nxt = (b * emit[:, t + 1]) @ step.T
        nxt /= nxt.sum(axis=1, keepdims=True)
        b = np.where(live[:, t + 1, None], nxt, 1.0)  # beyond the chain's end
        beta[t] = b
    m = alpha * beta
    m /= m.sum(axis=2, keepdims=True)
    expected = np.zeros((K, K))
    for t in range(T - 1):
        pair = alpha[t][:, :, None] * step * (beta[t + 1] * emit[:, t + 1])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        expected += (pair * live[:, t + 1, None, None]).sum(axis=0)
    return m.transpose(1, 0, 2), expected


def fit(rows: list[tuple[str, list[str]]], bits: int = 15, epochs: int = 6, lexicon_words: int = 200, seed: int = 7) -> Model:
    """Train on (language, words) pairs by Adagrad on the chain likelihood."""
    rows = [(lang, pieces(ws)) for lang, ws in rows]
    labels = sorted({lang for lang, _ in rows})
    index = {lang: k for k, lang in enumerate(labels)}
    K = len(labels)
    seen = {lang: Counter() for lang in labels}
    for lang, ws in rows:
        seen[lang].update(w.lower().strip(MARKS) for w in ws)
    lexicon: dict[str, tuple[int, ...]] = {}
    for lang, found in seen.items():
        for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]:
            lexicon[w] = (*lexicon.get(w, ()), index[lang])
    weights, trans = np.zeros(((1 << bits) + 1, K)), np.zeros((K, K))
    if K:
        rng = np.random.default_rng(seed)
        distinct = sorted({w for _, ws in rows for w in ws})
        ids_of, of, _ = word_features(distinct, lexicon, bits)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(1, len(distinct)))
        known = dict(zip(distinct, np.split(ids_of[order], cuts)))
        sums, tsum = np.full_like(weights, 1e-2), np.full_like(trans, 1e-2)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            chains, i = [], 0
            while i < len(order):  # every third chain joins two rows at their halves
                lang, ws = rows[order[i]]
                y = [index[lang]] * len(ws)
                if i % 3 == 0 and i + 1 < len(order):
                    other, more = rows[order[i + 1]]
                    ws = ws[: len(ws) // 2] + more[: (len(more) + 1) // 2]
                    y = y[: len(y) // 2] + [index[other]] * (len(ws) - len(y) // 2)
                    i += 1
                i += 1
                chains += [(ws[k:k + CHAIN], y[k:k + CHAIN]) for k in range(0, len(ws), CHAIN)]
            chains = [c for c in chains if c[0]]
            for k in range(0, len(chains), 64):
                part = chains[k:k + 64]
                T = max(len(ws) for ws, _ in part)
                ids = [[known[w] for w in ws] for ws, _ in part]
                width = max(1, max(len(f) for r in ids for f in r))
                at = np.full((len(part), T, width), 1 << bits)
                live, y = np.zeros((len(part), T), bool), np.zeros((len(part), T), int)
                for r, (ws, labels_of) in enumerate(part):
                    live[r, : len(ws)] = True
                    y[r, : len(ws)] = labels_of
                    for t, f in enumerate(ids[r]):
                        at[r, t, : len(f)] = f
                m, expected = _marginals(weights[at].sum(axis=2), trans, live)
                error = (np.eye(K)[y] - m) * live[:, :, None]
                grad = np.stack([np.bincount(at.ravel(), np.repeat(error[:, :, c].ravel(), width), len(weights)) for c in range(K)], axis=1)
                grad = grad / len(part) - 1e-4 * weights
                grad[-1] = 0
                both = live[:, 1:]
                tgrad = -expected
                np.add.at(tgrad, (y[:, :-1][both], y[:, 1:][both]), 1)
                tgrad = tgrad / len(part) - 1e-3 * trans
                sums += grad ** 2
                tsum += tgrad ** 2
                weights += 0.2 * grad / np.sqrt(sums)
                trans += 0.1 * tgrad / np.sqrt(tsum)
    return Model(labels, weights[:-1].astype(np.float32), trans, lexicon, bits)


class Tagger:
    """A task's copy of the model with the scores of the words seen so far."""

    def __init__(self, model: Model):
        self.m = model
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.m.labels)), np.float32)
        self.letters = np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        for k in range(0, len(new), LEARN):
            self._learn_part(new[k:k + LEARN])

    def _learn_part(self, new: list[str]) -> None:
        ids, of, letters = word_features(new, self.m.lexicon, self.m.bits)
        scores = np.stack([np.bincount(of, self.m.weights[ids, k], len(new)) for k in range(len(self.m.labels))], axis=1)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.scores = np.concatenate([self.scores, scores.astype(np.float32)])
        self.letters = np.concatenate([self.letters, letters])

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean marginals (texts, labels) over words with letters, the mean of these words' largest, and their number."""
        if len(self.place) > MEMO:
            self._reset()
        split = [pieces(t.split()) for t in texts]
        place = self.place
        if new := list({w for ws in split for w in ws if w not in place}):
            self._learn(new)
        ids = [k for ws in split for k in map(place.__getitem__, ws)]
        lengths = [len(ws) for ws in split]
        K, lengths = len(self.m.labels), np.array(lengths, np.int64)
        total, sure, n_letters = np.zeros((len(texts), K)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        chains = -(-lengths // CHAIN)
        if not chains.sum():
            return total, sure, n_letters
        flat = np.array(ids, np.int64)
        first, begin = (np.cumsum(chains) - chains) * CHAIN, np.cumsum(lengths) - lengths
        at = np.arange(len(flat)) + np.repeat(first - begin, lengths)
        grid = np.full(int(chains.sum()) * CHAIN, -1, np.int64)
        grid[at] = flat
        grid = grid.reshape(-1, CHAIN)
        live = grid >= 0
        scores = self.scores[grid] * live[:, :, None]
        m = _marginals_only(scores, self.m.transitions, live)
        marginal = m.reshape(-1, K)[at]
        of = np.repeat(np.arange(len(texts)), lengths)
        counted = self.letters[flat]
        for k in range(K):
            total[:, k] = np.bincount(of[counted], marginal[counted, k], len(texts))
        sure = np.bincount(of[counted], marginal[counted].max(axis=1), len(texts))
        n_letters = np.bincount(of[counted], minlength=len(texts))
        words_ = np.maximum(n_letters, 1)
        return total / words_[:, None], sure / words_, n_letters


def _marginals_only(scores: np.ndarray, trans: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Marginals as in :func:`_marginals`, in single precision and with the words' axis first inside."""
    B, T, K = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float32).transpose(1, 0, 2).copy()
    step = np.exp(trans - trans.max()).astype(np.float32)
    alpha = np.empty((T, B, K), np.float32)
    a = emit[0] / emit[0].sum(axis=1, keepdims=True)
    alpha[0] = a
    for t in range(1, T):
        a = (a @ step) * emit[t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t] = a
    b = np.ones((B, K), np.float32)
    for t in range(T - 2, -1, -1):
        nxt = (b * emit[t + 1]) @ step.T
        nxt /= nxt.sum(axis=1, keepdims=True)
        b = np.where(live[:, t + 1, None], nxt, np.float32(1))
        alpha[t] *= b
    alpha /= alpha.sum(axis=2, keepdims=True)
    return alpha.transpose(1, 0, 2)


def _tag_batches(shared, text_field: str | None):
    """Predictions for batches of ``row`` and ``text``; the text may be a field of the row."""
    def run(batches):
        model = shared.value
        tagger = Tagger(model) if model.labels else None
        for batch in batches:
            column = batch.column(1) if text_field is None else batch.column(0).field(text_field)
            texts = [x or "" for x in column.to_pylist()]
            lang, score, spread, certainty, lettered = [], [], [], [], []
            for lo in range(0, len(texts), 256):
                part = texts[lo:lo + 256]
                cut, size = [0], 0
                for i, t in enumerate(part):  # bounded blocks, one text at least
                    if size and size + len(t) > 6 * BLOCK_WORDS:
                        cut.append(i)
                        size = 0
                    size += len(t)
                cut.append(len(part))
                for a, b in zip(cut, cut[1:]):
                    if tagger is None:
                        lang += [UND] * (b - a)
                        score += [0.0] * (b - a)
                        spread += [[]] * (b - a)
                        certainty += [0.0] * (b - a)
                        lettered += [LETTER.search(t) is not None for t in part[a:b]]
                        continue
                    share, sure, n = tagger.shares(part[a:b])
                    certainty += [min(1.0, float(x)) for x in sure]
                    lettered += [bool(x) for x in n]
                    best = share.argmax(axis=1)
                    for r in range(b - a):
                        lang.append(model.labels[best[r]] if n[r] else UND)
                        score.append(min(1.0, float(share[r, best[r]])) if n[r] else 0.0)
                        spread.append([(x, float(v)) for x, v in zip(model.labels, share[r]) if v >= 0.01] if n[r] else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spread, pa.map_(pa.string(), pa.float64())),
                 pa.array(certainty, pa.float64()), pa.array(lettered, pa.bool_())],
                names=["row", "lang_pred", "score", "shares", "certainty", "lettered"])
    return run


def is_held_out(id_col: str = "doc_id", folds: int = 5):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def train(docs: DataFrame, held_out=None, rows_per_lang: int = 600, words_per_row: int = 60, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "lang", **kwargs) -> Model:
    """Fit on the bounded sample; only the sample (``rows_per_lang * words_per_row`` words a language) reaches the driver."""
    rows = sample_rows(docs, F.lit(False) if held_out is None else held_out, rows_per_lang, words_per_row, id_col, text_col, label_col)
    return fit([(r.lang, list(r.words)) for r in rows.orderBy("lang", "n").collect()], **kwargs)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: its columns (or those of ``keep``) as the struct ``row``, ``lang_pred``, ``score``, ``shares`` (language -> share),
    ``certainty`` (mean over the words with letters of each one's largest marginal) and ``lettered`` (has such words)."""
    keep = docs.columns if keep is None else keep
    inside = text_col if text_col in keep else None
    row = F.struct(*keep).alias("row")
    d = docs.select(row) if inside else docs.select(row, F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = d.schema["row"].dataType.simpleString()
    return map_batches(d, _tag_batches(shared, inside), f"row {kind}, lang_pred string, score double, shares map<string,double>, certainty double, lettered boolean")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose words' languages can be told: with letters, and a certainty of at least ``min_score``, so
    that texts switching between many languages stay. Where no label could be learned, all rows with letters stay."""
    out = predict(docs, model, text_col)
    told = F.col("lettered") & (F.col("certainty") >= min_score) if model.labels else F.col("lettered")
    return out.filter(told).select("row.*")
