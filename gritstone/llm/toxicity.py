"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a text: densities and counts of lexicon words (plain and after undoing character
substitutions), the strongest of them, lexicon words near a second-person pronoun, second-person density,
capitals, words in capitals, exclamation and question marks, other punctuation, symbols and digits inside
words, letters drawn out, word length and text length.

The lexicon is learned: words whose share of toxic documents is significantly higher, ranked by their
log-odds, counted in Spark over the training rows. Trees are grown in numpy over 32 quantile bins; one in
four training rows is held back to calibrate.

Bound of the training rows: about ``max_rows`` labelled rows, chosen by a hash of doc_id (their features
are a few megabytes). Texts are scored whole, in one narrow pass.

Null and empty texts have all features 0 and get the score of such a text. Rows with a null label are not
learned from; of several labels of one doc_id the highest counts, and words and splits of equal merit are taken in
order, so the model is reproducible. Without two classes of labelled rows the score is the share of label 1 (0.5 if
there is none). Repeated rows are scored alike, an empty table gives an empty result, and other columns are
not read. Texts are scored whole, a slice of rows of about 1 MB at a time; a longer text is a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, map_texts, materialize
from gritstone.llm._words import ALNUM, PLAIN, Chunk, chunks, cover, per_row, scan

#: Second-person pronouns of the corpus's languages.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen deiner deines ihr euch euer eure sie ihnen "
    "tu te ti tus tuyo vous votre vos toi ton tes usted ustedes vosotros vuestro"
).split()

#: Characters used in place of letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

_PLAINED = np.arange(256, dtype=np.uint8)
_PLAINED[0x41:0x5B] += 0x20
for _k, _v in SUBSTITUTES.items():
    _PLAINED[ord(_k)] = ord(_v)
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

FEATURES = (
    "log_words", "hit_density", "hits", "weight_density", "strongest", "distinct_hits", "undone_density", "undone_hits", "near_you_density", "near_you", "you_density",
    "capitals", "capital_words", "exclaims", "questions", "punctuation", "symbols_in_words", "digits_in_words", "drawn_out", "word_length",
)


def byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


class Features:
    def __init__(self, lexicon: dict[str, float], near: int = 4):
        self.near = near
        self.keys, self.weights = self._hashes(list(lexicon), np.array(list(lexicon.values()), np.float64))
        self.you, _ = self._hashes(SECOND_PERSON, np.zeros(len(SECOND_PERSON)))

    @staticmethod
    def _hashes(words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0)
        c = next(chunks(pa.array([" ".join(words)]), PLAIN))
        h = c.word_hash()
        by = np.argsort(h)
        return h[by], weights[by]

    @staticmethod
    def find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, -1 if it is none of them."""
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def rows(self, texts: pa.Array) -> np.ndarray:
        raw = chunks(texts, PLAIN)
        parts = [self._chunk(c, next(raw)) for c in chunks(texts, ALNUM, lower=True)]
        return np.concatenate([np.zeros((0, len(FEATURES)), np.float32), *parts])

    def _chunk(self, c: Chunk, raw: Chunk) -> np.ndarray:
        rows, n = c.rows(), np.maximum(c.n_words(), 1)
        h = c.word_hash()
        at = self.find(self.keys, h)
        hit = at >= 0
        weight = np.where(hit, self.weights[at] if len(self.weights) else 0.0, 0.0)
        strongest = np.zeros(c.n)
        np.maximum.at(strongest, rows, weight)
        distinct = np.zeros(c.n)
        pair = np.unique(rows[hit] * (len(self.keys) + 1) + at[hit])
        np.add.at(distinct, pair // (len(self.keys) + 1), 1)
        you = self.find(self.you, h) >= 0
        span = np.flatnonzero(you)
        lo, hi = np.maximum(span - self.near, c.ptr[rows[span]]), np.minimum(span + self.near + 1, c.ptr[rows[span] + 1])
        close = hit & cover(lo, hi - lo, len(h))
        # words as they stand between white space, with substitutes undone
        undone = scan(_PLAINED[raw.data], raw.offsets, LETTERS)
        other = self.find(self.keys, undone.word_hash()) >= 0
        more = np.maximum(per_row(other, undone.ptr) - per_row(hit, c.ptr), 0)
        data = raw.data
        upper = (data >= 0x41) & (data <= 0x5A)
        letter = upper | LETTERS[data] & (data != 0x80)
        inside = PLAIN[data]
        size = np.maximum(per_row(inside, raw.offsets), 1)
        up_in = np.concatenate([[0], np.cumsum(upper)])
        let_in = np.concatenate([[0], np.cumsum(letter)])
        ups, lets = up_in[raw.ends] - up_in[raw.starts], let_in[raw.ends] - let_in[raw.starts]
        shouted = (ups >= 3) & (ups == lets)
        middle = np.zeros(len(data), bool)
        if len(data) > 2:
            middle[1:-1] = letter[:-2] & letter[2:]
        begin, end = raw.offsets[:-1], raw.offsets[1:]
        middle[begin[begin < len(data)]] = middle[end[end > 0] - 1] = False  # neighbours in the same text
        symbol, digit = byte_set("@$*#!|+")[data], (data >= 0x30) & (data <= 0x39)
        drawn = np.zeros(len(data), bool)
        if len(data) > 2:
            drawn[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 0x80)
        for k in range(2):
            drawn[begin[begin + k < len(data)] + k] = False
        count = lambda flags: per_row(flags, raw.offsets)
        plain_n = np.maximum(raw.n_words(), 1)
        hits = per_row(hit, c.ptr)
        near = per_row(close, c.ptr)
        weights = np.concatenate([[0.0], np.cumsum(weight)])
        columns = (
            np.log1p(c.n_words()), hits / n, hits, (weights[c.ptr[1:]] - weights[c.ptr[:-1]]) / n, strongest, distinct, more / n, more, near / n, near, per_row(you, c.ptr) / n,
            count(upper) / size, per_row(shouted, raw.ptr) / plain_n, count(data == 0x21) / size, count(data == 0x3F) / size, count(byte_set(",.;:-()\"'")[data]) / size,
            count(middle & symbol) / size, count(middle & digit) / size, count(drawn) / size, size / plain_n,
        )
        return np.stack(columns, axis=1).astype(np.float32)


class Trees:
    """Gradient-boosted trees for the logistic loss, grown level by level over quantile bins."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 1.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)], axis=1)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        z = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, limit = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1)
            for level in range(self.depth):
                nodes = 2**level
                key = (node[:, None] * width + np.arange(width)) * self.bins + binned
                g = np.bincount(key.ravel(), np.repeat(grad, width), nodes * width * self.bins).reshape(nodes, width, self.bins).cumsum(axis=2)
                w = np.bincount(key.ravel(), np.repeat(hess, width), nodes * width * self.bins).reshape(nodes, width, self.bins).cumsum(axis=2)
                gt, wt = g[:, :, -1:], w[:, :, -1:]
                gain = g**2 / (w + self.ridge) + (gt - g) ** 2 / (wt - w + self.ridge) - gt**2 / (wt + self.ridge)
                gain = np.where((w >= self.least) & (wt - w >= self.least), gain, -1)
                for k in range(nodes):
                    j, b = divmod(int(gain[k].argmax()), self.bins)
                    at = nodes - 1 + k
                    if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                        feature[at], limit[at] = j, cuts[j][b]
                split = feature[nodes - 1 + node]
                right = (split >= 0) & (x[np.arange(n), np.maximum(split, 0)] > limit[nodes - 1 + node])
                node = 2 * node + right
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.ridge)
            self.trees.append((feature, limit, value))
            z += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        at = np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                own = 2**level - 1 + node
                split = feature[own]
                node = 2 * node + ((split >= 0) & (x[at, np.maximum(split, 0)] > limit[own]))
            z += value[node]
        return z


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a nondecreasing map from margins to shares of label 1."""
    by = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first, last
    for m, v in zip(margin[by].tolist(), y[by].tolist(), strict=True):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], last]
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    p = np.array([v for b in blocks for v in [(b[0] + 0.25) / (b[1] + 0.5)] * 2])
    return x, np.maximum.accumulate(p)


def learn_lexicon(sample: DataFrame, size: int) -> dict[str, float]:
    """The ``size`` words most surely told by toxic documents, with their log-odds; sample: doc_id, text, toxic."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        toxic = np.asarray(b.column(2))
        word, label = [], []
        for c in chunks(b.column(1), ALNUM, lower=True):
            for r in range(c.n):
                own = {w.decode() for w in c.words(r)}
                word += own
                label += [int(toxic[c.row + r])] * len(own)
        return batch(word=pa.array(word, pa.string()), toxic=pa.array(label, pa.int64()))

    both = sample.agg(F.sum("toxic"), F.count("*")).first()
    t, n = float(both[0] or 0), float(both[1])
    if not n:
        return {}
    words = map_texts(sample, run, "word string, toxic long", extra=("toxic",)).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter("t >= 5")
    odds = F.log((F.col("t") + 0.5) / (t + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n - t + 1))
    expected = F.col("n") * F.lit(t / n)
    surely = (F.col("t") - expected) / F.sqrt(expected * F.lit(max(1e-9, 1 - t / n)) + 0.5)
    top = words.select("word", odds.alias("odds"), surely.alias("z")).filter("z > 4 and odds > 0.7").orderBy(F.desc("z"), "word").limit(size).collect()
    return {r["word"]: float(r["odds"]) for r in top}


class Model:
    def __init__(self, features: Features, trees: Trees | None, knots: tuple[np.ndarray, np.ndarray] | None, share: float):
        self.features, self.trees, self.knots, self.share = features, trees, knots, share

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.clip(np.interp(self.trees.margin(self.features.rows(texts)), *self.knots), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column | None, max_rows: int, lexicon_size: int) -> Model:
    chosen = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    if usable is not None:
        chosen = chosen.filter(usable)
    total = chosen.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    chosen = chosen.filter(part < min(1.0, max_rows / max(1, total))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id"))  # about max_rows pairs of numbers
    calibrate = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4)) == 0
    counts = sample.agg(F.count("*"), F.sum("toxic")).first()
    share = float(counts[1] or 0) / counts[0] if counts[0] else 0.5
    if not counts[0] or not 0 < share < 1:
        return Model(Features({}), None, None, share)
    features = Features(learn_lexicon(sample.filter(~calibrate), lexicon_size))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = features.rows(b.column(1))
        return batch(toxic=b.column(2), held=b.column(3), x=pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32())))

    table = map_texts(sample.withColumn("held", calibrate), run, "toxic int, held boolean, x array<float>", extra=("toxic", "held")).toArrow()
    x, y, held = np.array(table["x"].to_pylist(), np.float32), table["toxic"].to_numpy().astype(float), table["held"].to_numpy()
    by = np.lexsort((*x.T, y))  # the order in which rows arrive does not matter
    x, y, held = x[by], y[by], held[by]
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    trees = Trees().fit(x[~held], y[~held])
    on = held if held.any() else ~held
    return Model(features, trees, isotonic(trees.margin(x[on]), y[on]), share)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, max_rows: int = 20_000, lexicon_size: int = 100
) -> DataFrame:
    """One row for each document: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    usable: condition on ``doc_id`` that labelled rows must meet to be learned from.
    """
    model = train(docs, labels, id_col, text_col, label_col, usable, max_rows, lexicon_size)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = model.score(b.column(1))
        return batch(doc_id=b.column(0), score=p, predicted=(p >= 0.5).astype(np.int32))

    return map_texts(docs, run, "doc_id long, score double, predicted int", id_col, text_col)
