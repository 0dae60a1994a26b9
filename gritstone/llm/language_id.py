"""Language ID: an interpolated Kneser-Ney character model for each language.

Words are runs of letters, lower-cased, between boundary marks; each letter and the closing mark is
predicted from up to ``order - 1`` symbols before it in its word. A training row's n-grams are counted in
Spark; the counts of all languages become one table for each order: sorted hashes with a column of
interpolated log-probabilities for each language, and another with the back-off weights of contexts.
Distinct words of a chunk are scored once.

A document gets the language of the lowest cross-entropy for each symbol. Calibration rows, held back
from the counts, give the temperature that makes ``score`` a probability and, for each language, the
cross-entropy above which a document is marked ``rejected``.

Bound of the training rows: about ``max_rows`` a language and ``max_total`` in all, chosen by a hash of doc_id; one
in five of these calibrates. Languages are taken in blocks whose tables have at most ``max_cells`` numbers, so that
a table that reaches every task has a bounded size however many languages there are. One block, which some
dozens of languages fit, takes one narrow pass; several take a pass each, and the best of each block meet in
an aggregation by a hash of the row.

Null texts, and texts without a letter, are ``und`` with score 0, as is every text if there is no training row or
the table is empty. Rows with a null language are never learned from. Of languages of equal cross-entropy the first
by name is chosen. Repeated rows are judged alike, rows of one id with different texts each for itself; texts are
judged whole, a slice of rows of about 1 MB at a time, a longer text as a slice of its own. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, map_texts, materialize
from gritstone.llm._tokens import LETTER, char_classes
from gritstone.llm._words import buffers, lanes, mix, per_row

BITS = 12  # of a symbol in an n-gram's key
MARK = 1
CHUNK = 1 << 20
_lower: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """The symbol of each code point, lower-cased; letters beyond the first 2048 code points share the upper half."""
    if not _lower:
        low = np.arange(0x110000)
        for cp in np.flatnonzero(char_classes() == LETTER).tolist():
            x = chr(cp).lower()
            if len(x) == 1:
                low[cp] = ord(x)
        _lower.append(np.where(low < 2048, low, 2048 + (mix(low.astype(np.uint64)) % np.uint64(2048)).astype(np.int64)))
    return _lower[0]


def letter_words(text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a chunk, where its words of letters begin and end, and the word range of each row."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inside = char_classes()[cp] == LETTER
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begin[offsets[:-1][full]] = inside[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    starts = np.flatnonzero(begin)
    return symbols()[cp], starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def distinct_words(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct word, and each word's number among them."""
    h = lanes(sym.astype(np.uint16), starts, ends).hashes()
    _, where, inverse = np.unique(h, return_index=True, return_inverse=True)
    return where, inverse


def grams(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each predicted symbol of the words: the n-gram that ends with it (its key), that n-gram's order, and the word."""
    size = ends - starts + 1
    word = np.repeat(np.arange(len(starts)), size)
    done = np.cumsum(size) - size
    at = np.arange(len(word)) - done[word]  # 0: the first letter
    here = starts[word] + at
    closing = here == ends[word]
    flat = np.where(closing, MARK, sym[np.minimum(here, len(sym) - 1)]).astype(np.uint64)
    key, n = flat.copy(), np.minimum(at + 2, order)
    for back in range(1, order):
        inside = at >= back
        prior = np.where(inside, np.roll(flat, back), np.uint64(MARK))
        key |= np.where(at + 1 >= back, prior << np.uint64(BITS * back), np.uint64(0))
    return key, n, word


def rows_of(texts: pa.Array):
    """Chunks of a string column as text, with the places of rows in characters."""
    data, offsets = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        yield row, part.tobytes().decode(), np.concatenate([[0], np.cumsum(per_row((part & 0xC0) != 0x80, offsets[row : stop + 1] - offsets[row]))])
        row = stop


def count_grams(sample: DataFrame, order: int) -> DataFrame:
    """lang, gram, n over (doc_id, text, lang)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        langs = np.array(b.column(2).to_pylist(), object)
        names, of = np.unique(langs.astype(str), return_inverse=True)
        lang, gram, n = [], [], []
        for row, text, offsets in rows_of(b.column(1)):
            sym, starts, ends, ptr = letter_words(text, offsets)
            if not len(starts):
                continue
            own = of[row + np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))]
            for k in np.unique(own).tolist():
                key, _, _ = grams(sym, starts[own == k], ends[own == k], order)
                u, c = np.unique(key, return_counts=True)
                lang += [names[k]] * len(u)
                gram.append(u.view(np.int64))
                n.append(c)
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return batch(lang=pa.array(lang, pa.string()), gram=join(gram), n=join(n))

    return map_texts(sample, run, "lang string, gram long, n long", extra=("lang",)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class KneserNey:
    """Interpolated Kneser-Ney models of several languages in shared sorted hash arrays."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, alphabet: int | None = None):
        self.langs, self.order = langs, order
        self.grams: list[np.ndarray] = [np.zeros(0, np.uint64)] * (order + 1)
        self.logp: list[np.ndarray] = [np.zeros((0, len(langs)))] * (order + 1)
        self.contexts: list[np.ndarray] = [np.zeros(0, np.uint64)] * (order + 1)
        self.backoff: list[np.ndarray] = [np.zeros((0, len(langs)))] * (order + 1)
        counts = [self._counts(gram[lang == k], n[lang == k], order) for k in range(len(langs))]
        alphabet = alphabet or len(np.unique(np.concatenate([c[1][0] for c in counts]))) + 1
        self.floor = np.full(len(langs), -np.log(alphabet))
        lower_keys, lower = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        for m in range(1, order + 1):
            keys = np.unique(np.concatenate([c[m][0] for c in counts]))
            contexts = np.unique(keys >> np.uint64(BITS))
            p, weight = np.zeros((len(keys), len(langs))), np.ones((len(contexts), len(langs)))
            if m > 1:
                at, there = lookup(lower_keys, keys & np.uint64((1 << (BITS * (m - 1))) - 1))
                below = np.where(there[:, None], lower[at], np.exp(self.floor))
            else:
                below = np.tile(np.exp(self.floor), (len(keys), 1))
            for k, c in enumerate(counts):
                own, count = c[m]
                if not len(own):
                    p[:, k] = below[:, k]
                    continue
                once, twice = (count == 1).sum(), (count == 2).sum()
                d = once / (once + 2 * twice) if once else 0.5
                ctx, inverse = np.unique(own >> np.uint64(BITS), return_inverse=True)
                total, kinds = np.bincount(inverse, count), np.bincount(inverse)
                at, _ = lookup(contexts, ctx)
                weight[at, k] = d * kinds / total
                at, _ = lookup(keys, own)
                p[at, k] = np.maximum(count - d, 0) / total[inverse]
                at, _ = lookup(contexts, keys >> np.uint64(BITS))
                p[:, k] += weight[at, k] * below[:, k]
            self._store(m, keys, p, contexts, weight)
            lower_keys, lower = keys, p

    @staticmethod
    def _counts(gram: np.ndarray, n: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Counts at each order: as they are for the highest and for what begins a word, of different symbols before for the others."""
        size = np.ones(len(gram), np.int64)
        for k in range(1, order):
            size += (gram >> np.uint64(BITS * k)) > 0
        out: list = [None] * (order + 1)
        keys, count = gram[size == order], n[size == order]
        out[order] = (keys, count)
        for m in range(order - 1, 0, -1):
            follow, kinds = np.unique(keys & np.uint64((1 << (BITS * m)) - 1), return_counts=True)
            initial = size == m
            keys = np.concatenate([follow, gram[initial]])
            count = np.concatenate([kinds, n[initial]])
            by = np.argsort(keys, kind="stable")
            keys, count = keys[by], count[by]
            out[m] = (keys, count)
        return out

    def _store(self, m: int, keys: np.ndarray, p: np.ndarray, contexts: np.ndarray, weight: np.ndarray) -> None:
        h = mix(keys)
        by = np.argsort(h)
        self.grams[m], self.logp[m] = h[by], np.log(p[by]).astype(np.float32)
        h = mix(contexts)
        by = np.argsort(h)
        self.contexts[m], self.backoff[m] = h[by], np.log(weight[by]).astype(np.float32)

    def score(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-probabilities (symbols, languages) of the last symbols of n-grams."""
        out = np.zeros((len(key), len(self.langs)), np.float32)
        open_ = np.arange(len(key))
        for m in range(self.order, 0, -1):
            now = open_[n[open_] >= m]
            part = key[now] & np.uint64((1 << (BITS * m)) - 1)
            at, there = lookup(self.grams[m], mix(part))
            hit, miss = now[there], now[~there]
            out[hit] += self.logp[m][at[there]]
            at, known = lookup(self.contexts[m], mix(part[~there] >> np.uint64(BITS)))
            out[miss[known]] += self.backoff[m][at[known]]
            done = np.zeros(len(key), bool)
            done[hit] = True
            open_ = open_[~done[open_]]
        out[open_] += self.floor
        return out

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each row in each language, in nats a symbol, and the number of symbols (0: no letter)."""
        total, size = [np.zeros((0, len(self.langs)))], [np.zeros(0, np.int64)]
        for _, text, offsets in rows_of(texts):
            sym, starts, ends, ptr = letter_words(text, offsets)
            rows = len(ptr) - 1
            if not len(starts):
                total.append(np.zeros((rows, len(self.langs))))
                size.append(np.zeros(rows, np.int64))
                continue
            where, inverse = distinct_words(sym, starts, ends)
            key, n, word = grams(sym, starts[where], ends[where], self.order)
            logp = self.score(key, n)
            first = np.searchsorted(word, np.arange(len(where)))
            each = np.add.reduceat(logp.astype(np.float64), first, axis=0)[inverse]
            sums = np.zeros((len(starts) + 1, len(self.langs)))
            np.cumsum(each, axis=0, out=sums[1:])
            total.append(sums[ptr[1:]] - sums[ptr[:-1]])
            size.append(per_row(ends - starts + 1, ptr))
        total, size = np.concatenate(total), np.concatenate(size)
        return -total / np.maximum(size, 1)[:, None], size


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int, max_total: int) -> DataFrame:
    """doc_id, text, lang, fold of the rows to learn from (fold 0 calibrates)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).filter("text is not null and lang is not null")
    per_lang = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")))  # one row a language
    langs = per_lang.count()
    shares = per_lang.select("lang", F.least(F.lit(1.0), F.lit(min(max_rows, max_total / max(1, langs))) / F.col("n")).alias("share"))
    if langs <= 10_000:  # well under a megabyte
        shares = F.broadcast(shares)
    folded = lambda seed, n: F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(seed)), F.lit(n))
    chosen = rows.join(shares, "lang").filter(folded(10, 1_000_000) / 1_000_000 < F.col("share"))
    return materialize(chosen.select("doc_id", "text", "lang", folded(11, 5).alias("fold")))


def blocks_of(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, max_cells: int) -> Iterator[KneserNey]:
    """Models of runs of ``langs``, each with at most about ``max_cells`` table entries; one language at least."""
    alphabet = len(np.unique(gram & np.uint64((1 << BITS) - 1))) + 1
    sizes = np.bincount(lang, minlength=len(langs))
    at = 0
    while at < len(langs):
        stop = at + 1
        while stop < len(langs) and int(sizes[at : stop + 1].sum()) * (stop + 1 - at) * 2 <= max_cells:  # grams of all orders and contexts: under twice those of the highest
            stop += 1
        own = (lang >= at) & (lang < stop)
        yield KneserNey(langs[at:stop], lang[own] - at, gram[own], n[own], order, alphabet)
        at = stop


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int, max_total: int, max_cells: int, order: int) -> tuple[list[KneserNey], float, np.ndarray] | None:
    """Models by blocks of languages, temperature and rejection limits (of all languages in order); None without a training row."""
    sample = training_rows(docs, id_col, text_col, lang_col, max_rows, max_total)
    table = count_grams(sample.filter("fold <> 0").select("doc_id", "text", "lang"), order).toArrow()  # of ``max_total`` rows
    if not table.num_rows:
        return None
    langs = sorted(pc.unique(table["lang"]).to_pylist())
    code = lambda column: pc.fill_null(pc.index_in(column, pa.array(langs, pa.string())), -1).to_numpy().astype(np.int64)
    lang = code(table["lang"])
    models = list(blocks_of(langs, lang, table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy(), order, max_cells))
    calibrating = sample.filter("fold = 0").select("doc_id", "text", "lang")
    parts = []
    for model in models:

        def run(b: pa.RecordBatch, model: KneserNey = model) -> pa.RecordBatch:
            h, size = model.entropies(b.column(1))
            keep = size > 0
            return batch(doc_id=b.column(0).filter(pa.array(keep)), lang=b.column(2).filter(pa.array(keep)), h=pa.ListArray.from_arrays(np.arange(keep.sum() + 1, dtype=np.int32) * h.shape[1], pa.array(h[keep].ravel())), size=size[keep])

        part = map_texts(calibrating, run, "doc_id long, lang string, h array<double>, size long", extra=("lang",)).toArrow()
        parts.append(part.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("size", "ascending")]))
    limits, temperature = np.full(len(langs), np.inf), 1.0
    if parts[0].num_rows:
        h = np.concatenate([pc.list_flatten(p["h"]).to_numpy().reshape(p.num_rows, -1) for p in parts], axis=1)
        truth = code(parts[0]["lang"])
        size = parts[0]["size"].to_numpy()
        scales = np.geomspace(0.5, 200, 40)
        loss = [-np.log(np.maximum(posterior(h, size, s)[np.arange(len(h)), truth], 1e-9))[truth >= 0].mean() for s in scales] if (truth >= 0).any() else [0.0]
        temperature = float(scales[int(np.argmin(loss))])
        for k in range(len(langs)):
            own = h[truth == k, k]
            if len(own):
                limits[k] = np.quantile(own, 0.995) + 0.25
    return models, temperature, limits


def sharpness(size: np.ndarray, scale: float) -> np.ndarray:
    """By what cross-entropies count: more in longer texts, with diminishing weight."""
    return scale * np.sqrt(np.minimum(size, 400) / 400)


def posterior(h: np.ndarray, size: np.ndarray, scale: float) -> np.ndarray:
    """Probabilities of the languages."""
    z = -h * sharpness(size, scale)[:, None]
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def identify(
    docs: DataFrame, train_on: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 2000, order: int = 5, max_total: int = 50_000, max_cells: int = 40_000_000
) -> DataFrame:
    """One row for each document: doc_id, lang_pred, score, cross_entropy, rejected.

    train_on: rows to learn from (default: ``docs``).
    """
    fitted = train(docs if train_on is None else train_on, id_col, text_col, lang_col, max_rows, max_total, max_cells, order)
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    if fitted is None:
        return docs.select(docs[id_col].cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    models, temperature, limits = fitted

    def judge(model: KneserNey, limits: np.ndarray, texts: pa.Array) -> dict[str, pa.Array]:
        """The best language of a block for each row, the probability of it among the block's, and beyond which the row is rejected."""
        h, size = model.entropies(texts)
        rows, some = np.arange(len(size)), size > 0
        best = h.argmin(axis=1)
        names = np.array([*model.langs, "und"], object)
        return {
            "lang_pred": pa.array(names[np.where(some, best, len(model.langs))].tolist(), pa.string()),
            "score": pa.array(np.where(some, posterior(h, size, temperature)[rows, best], 0.0)),
            "cross_entropy": pa.array(np.where(some, h[rows, best], 0.0)),
            "rejected": pa.array(~some | (h[rows, best] > limits[best])),
            "sharpness": pa.array(sharpness(size, temperature)),
        }

    if len(models) == 1:
        model = models[0]

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            out = judge(model, limits, b.column(1))
            out.pop("sharpness")
            return batch(doc_id=b.column(0), **out)

        return map_texts(docs, run, schema, id_col, text_col)

    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("key"))
    every, at = None, 0
    for model in models:
        own = limits[at : at + len(model.langs)]
        at += len(model.langs)

        def run(b: pa.RecordBatch, model: KneserNey = model, own: np.ndarray = own) -> pa.RecordBatch:
            return batch(key=b.column(2), **judge(model, own, b.column(1)))

        part = materialize(map_texts(keyed, run, "key long, lang_pred string, score double, cross_entropy double, rejected boolean, sharpness double", extra=("key",)).dropDuplicates(["key"]))
        every = part if every is None else every.unionByName(part)
    ranked = every.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cross_entropy", "lang_pred", "score", "rejected", "sharpness"))).alias("all"))  # one entry a block
    best = F.col("all")[0]
    # a block whose best language has probability q in it has 1 / q times the weight of that language
    mass = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp((best["cross_entropy"] - x["cross_entropy"]) * x["sharpness"]) / x["score"])
    merged = materialize(ranked.select("key", best["lang_pred"].alias("lang_pred"), F.when(best["score"] > 0, 1 / mass).otherwise(0.0).alias("score"), best["cross_entropy"].alias("cross_entropy"), best["rejected"].alias("rejected")))
    return keyed.select("doc_id", "key").join(merged, "key").select("doc_id", "lang_pred", "score", "cross_entropy", "rejected")
