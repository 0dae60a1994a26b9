"""LM scoring: masked pseudo-likelihood of a bidirectional window network, trained in numpy on the executors.

Every word of the corpus has a probability of its own, in levels: that of its class, then that of the word in
its class. The ``common`` most frequent words are dealt to ``buckets`` classes by rank and have an output of
their own there; every other word is in a class by its hash, where all of these share one output, and has the
part of it that its count over all documents gives. The network sees ``side`` words before and behind a masked
one, as embeddings, through one hidden layer; from it come the probabilities of the classes and, of the
word's own class, those of its outputs. A document's score is the sum of the log-probabilities of all its words,
each predicted from both sides.

The table of counts grows with the corpus and stays in Spark. Tasks get at most ``head`` of its words, the most
frequent ones by a limit that a histogram of counts gives; all rarer words meet their counts in a join, and
only their sum for each text comes back.

Documents are encoded once, as class and word numbers. Training goes through all of them in rounds that together
predict every token once: a round masks the tokens whose place in the text, shifted by a hash of the row, has its own
remainder. Documents are dealt to shards of about ``shard`` tokens by a hash of id and text and sorted in them. At
first, biases give every output its share of the corpus. In each round each shard starts from the shared weights, goes
through its texts with Adagrad, and gives back its weights; Spark averages them, weighted by the masked tokens. What a
shard holds, and in which order, depends on the rows alone, so scores do not depend on how the table is partitioned.
At most ``parts`` tasks take the shards, one after the other, however many there are.
Weights, whose size is fixed, are all that passes through the driver.

Null and empty texts have no tokens: score 0, and no score for each token (null). Repeated rows count as often as
they stand in the table and have equal scores; rows of one id with different texts are scored each for itself.
Words of equal count are ranked by their hash. An empty table gives an empty result. Texts are trained on and
scored whole, a slice of rows of about 1 MB at a time; a longer text is a slice of its own. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, discard, map_texts, materialize, slices
from gritstone.llm._words import ALNUM, chunks

BLOCK = 2048


@dataclass
class Vocabulary:
    """Numbers of words: the rank of a common one, ``common`` plus its class for the others."""

    words: np.ndarray  # sorted hashes of the most frequent words
    rank: np.ndarray  # their ranks
    count: np.ndarray  # their counts
    common: int
    buckets: int

    @property
    def size(self) -> int:
        return self.common + self.buckets

    def ranked(self) -> np.ndarray:
        """The counts of the common words by rank."""
        return self.count[np.argsort(self.rank)][: self.common]

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of word hashes, and the counts of those that have no output of their own: 0 if unknown here."""
        number = self.common + (h % np.uint64(self.buckets)).astype(np.int64)
        count = np.zeros(len(h), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            known = self.words[at] == h
            own = known & (self.rank[at] < self.common)
            number[own] = self.rank[at[own]]
            count = np.where(known & ~own, self.count[at], 0)
        return number, count


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word (its hash) and n over all documents."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        words, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c in chunks(b.column(1), ALNUM, lower=True):
            u, n = np.unique(c.word_hash(), return_counts=True)
            words.append(u.view(np.int64))
            counts.append(n)
        return batch(word=np.concatenate(words), n=np.concatenate(counts))

    return map_texts(docs, run, "word long, n long", id_col, text_col).groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, common: int, buckets: int, head: int) -> tuple[Vocabulary, int]:
    """The vocabulary that tasks get, and the count from which on words are in it."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # about 1,000 levels at most
    least, total = None, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > head:
            break
        least = k
    table = (counts.filter(level >= least) if least is not None else counts.filter("false")).toArrow()  # ``head`` rows at most
    words, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
    by = np.lexsort((words, -n))
    words, n = words[by], n[by]
    place = np.argsort(words)
    return Vocabulary(words[place], place, n[place], min(common, len(words)), buckets), int(n.min(initial=np.iinfo(np.int64).max))


def class_totals(counts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often the words without an output of their own occur in each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(vocabulary.size)
        for b in batches:
            number, _ = vocabulary.of(b.column(0).to_numpy().view(np.uint64))
            sums += np.bincount(number, b.column(1).to_numpy(), vocabulary.size)
        yield batch(kind=np.arange(vocabulary.buckets), n=sums[vocabulary.common :])

    out = np.zeros(vocabulary.buckets)
    for r in counts.mapInArrow(run, "kind long, n double").groupBy("kind").agg(F.sum("n").alias("n")).collect():  # a row for each class
        out[r["kind"]] = r["n"]
    return out


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (of the row), n_tokens, ids (numbers of the words, as little-endian 16-bit values), own (summed
    logarithms of the counts of words without an output that tasks know), tail (hashes of the rarer ones)."""
    if vocabulary.size >= 1 << 16:
        raise ValueError("word numbers have 16 bits")
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[id_col].cast("long"), docs[text_col]).alias("key"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for c in chunks(b.column(1), ALNUM, lower=True):
            h = c.word_hash()
            number, count = vocabulary.of(h)
            rare = np.flatnonzero((number >= vocabulary.common) & (count == 0))
            sums = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(count, 1)))])
            ids = pa.Array.from_buffers(pa.binary(), c.n, [None, pa.py_buffer((c.ptr * 2).astype(np.int32)), pa.py_buffer(number.astype("<u2"))])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, c.ptr).astype(np.int32)), pa.array(h[rare].view(np.int64)))
            out.append(batch(doc_id=b.column(0).slice(c.row, c.n), key=b.column(2).slice(c.row, c.n), n_tokens=c.n_words(), ids=ids, own=sums[c.ptr[1:]] - sums[c.ptr[:-1]], tail=tail))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return map_texts(keyed, run, "doc_id long, key long, n_tokens long, ids binary, own double, tail array<long>", extra=("key",))


def token_rows(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of ``ids``, and where rows begin among them."""
    where = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    raw = ids.buffers()[2]
    flat = np.frombuffer(raw, "<u2")[where[0] // 2 : where[-1] // 2] if raw is not None and raw.size else np.zeros(0, "<u2")
    return flat.astype(np.int64), (where - where[0]).astype(np.int64) // 2


def windows(token: np.ndarray, ptr: np.ndarray, side: int, outside: int) -> np.ndarray:
    """The tokens around each; ``outside`` stands beyond the ends of the text."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    out = np.full((len(token), 2 * side), outside, np.int64)
    for k in range(1, side + 1):
        if len(token) > k:
            same = row[k:] == row[:-k]
            out[k:, side - k] = np.where(same, token[:-k], outside)
            out[:-k, side + k - 1] = np.where(same, token[k:], outside)
    return out


class Network:
    """Window embeddings, one hidden layer, a softmax over the classes and one over the outputs of each class.

    Word ``t`` under ``common`` is output ``t // buckets`` of class ``t % buckets``; the last output of a class
    is for its other words.
    """

    def __init__(self, common: int, buckets: int, side: int, width: int, hidden: int, weights: np.ndarray | None = None):
        self.common, self.buckets, self.width = common, buckets, width
        self.slots = -(-common // buckets) + 1
        shapes = ((common + buckets + 1, width), (2 * side * width, hidden), (hidden,), (hidden, buckets), (buckets,), (buckets, hidden, self.slots), (buckets, self.slots))
        if weights is None:
            rng = np.random.default_rng(3)
            scale = (0.1, (2 * side * width) ** -0.5, 0.0, hidden**-0.5, 0.0, hidden**-0.5, 0.0)
            weights = np.concatenate([(rng.standard_normal(s) * k).ravel() for s, k in zip(shapes, scale, strict=True)])
        self.flat = weights.astype(np.float32)
        self.squares = np.full(len(self.flat), 1e-4, np.float32)
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        self.slices = [slice(int(e) - int(np.prod(s)), int(e)) for e, s in zip(ends, shapes, strict=True)]
        self.embed, self.w1, self.b1, self.w2, self.b2, self.w3, self.b3 = (self.flat[x].reshape(s) for x, s in zip(self.slices, shapes, strict=True))
        #: Outputs that no word has.
        self.unused = np.arange(self.slots - 1) * buckets + np.arange(buckets)[:, None] >= common
        self.partly = self.unused.any(axis=1).tolist()
        self.ones = np.ones(max(self.slots, buckets), np.float32)

    def start(self, count: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The first weights: biases give every output its share of the corpus. count: of the common words by rank, others: of the other words by class."""
        cls, slot = self.place(np.arange(self.common + self.buckets))
        each = np.full(self.b3.shape, 1e-3)
        each[cls, slot] = np.maximum(np.concatenate([count, others]), 1e-3)
        self.b3[:] = np.log(each / each.sum(axis=1, keepdims=True))
        self.b2[:] = np.log(each.sum(axis=1) / each.sum())
        return self.flat.astype(np.float64)

    def place(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and output of each token."""
        own = token < self.common
        return np.where(own, token % self.buckets, token - self.common), np.where(own, token // self.buckets, self.slots - 1)

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embed[around].reshape(len(around), -1)
        return x, np.tanh(x @ self.w1 + self.b1)

    def bounded(self) -> bool:
        """Whether no score can let exp overflow, as hidden values are within 1; else scores are clipped."""
        high = lambda w, b: float((np.abs(w).sum(axis=-2) + np.abs(b)).max(initial=0))
        return high(self.w2, self.b2) < 80 and high(self.w3, self.b3) < 80

    def over_classes(self, h: np.ndarray, bounded: bool) -> np.ndarray:
        """Scores of the classes."""
        z = h @ self.w2
        z += self.b2
        return z if bounded else np.clip(z, -30, 30, out=z)

    def within(self, c: int, h: np.ndarray, bounded: bool) -> np.ndarray:
        """exp of the scores of the outputs of class ``c``."""
        z = h @ self.w3[c]
        z += self.b3[c]
        if not bounded:
            np.clip(z, -30, 30, out=z)
        np.exp(z, out=z)
        if self.partly[c]:
            z[:, :-1][:, self.unused[c]] = 0
        return z

    def by_class(self, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by class, and (class, first, end) of the runs in it."""
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        ends = np.cumsum(np.bincount(cls, minlength=self.buckets)).tolist()
        return order, [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b]

    def log_probability(self, token: np.ndarray, around: np.ndarray) -> np.ndarray:
        cls, slot = self.place(token)
        n, at, bounded = len(token), np.arange(len(token)), self.bounded()
        out, h = np.empty(n, np.float32), np.empty((n, len(self.b1)), np.float32)
        for a in range(0, n, BLOCK):  # blocks that stay in the processor's cache
            own = slice(a, min(n, a + BLOCK))
            h[own] = self.hidden(around[own])[1]
            z = self.over_classes(h[own], bounded)
            mine = z[at[: len(z)], cls[own]]
            out[own] = mine - np.log(np.exp(z, out=z) @ self.ones[: self.buckets])
        if self.slots > 1:
            order, runs = self.by_class(cls)
            h, slot = h[order], slot[order]
            own, sums = np.empty(n, np.float32), np.empty(n, np.float32)
            for c, a, b in runs:
                for k in range(a, b, BLOCK):
                    part = slice(k, min(b, k + BLOCK))
                    e = self.within(c, h[part], bounded)
                    own[part] = e[at[: len(e)], slot[part]]
                    sums[part] = e @ self.ones[: self.slots]
            out[order] += np.log(own / sums)
        return out

    def gradient(self, token: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability; scores are divided by their sums in the products, where matrices are narrow."""
        n, bounded = len(token), self.bounded()
        cls, slot = self.place(token)
        at = np.arange(n)
        x, h = self.hidden(around)
        p = self.over_classes(h, bounded)
        np.exp(p, out=p)
        sums = p @ self.ones[: self.buckets]
        p[at, cls] -= sums
        share = 1 / (sums * n)
        grad = np.zeros_like(self.flat)
        parts = [grad[s] for s in self.slices]
        parts[4][:] = share @ p
        parts[3][:] = ((h * share[:, None]).T @ p).ravel()
        dh = (p @ self.w2.T) * share[:, None]
        if self.slots > 1:
            order, runs = self.by_class(cls)
            hs, slot, more, share = h[order], slot[order], np.empty_like(h), np.empty(n, np.float32)
            g3, gb3 = parts[5].reshape(self.w3.shape), parts[6].reshape(self.b3.shape)
            for c, a, b in runs:
                e = self.within(c, hs[a:b], bounded)
                sums = e @ self.ones[: self.slots]
                e[at[: b - a], slot[a:b]] -= sums
                own = share[a:b] = 1 / (sums * n)
                np.matmul((hs[a:b] * own[:, None]).T, e, out=g3[c])
                np.matmul(own, e, out=gb3[c])
                np.matmul(e, self.w3[c].T, out=more[a:b])
            more *= share[:, None]
            dh[order] += more
        dh *= 1 - h * h
        parts[2][:] = dh.sum(axis=0)
        parts[1][:] = (x.T @ dh).ravel()
        dx = (dh @ self.w1.T).reshape(-1, self.width)
        flat = around.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        own = flat[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        parts[0].reshape(self.embed.shape)[own[first]] = np.add.reduceat(dx[order], first, axis=0)
        return grad

    def learn(self, token: np.ndarray, around: np.ndarray, rate: float) -> None:
        """One Adagrad step."""
        if len(token):
            grad = self.gradient(token, around)
            self.squares += grad * grad
            self.flat -= rate * grad / np.sqrt(self.squares)


def train_round(encoded: DataFrame, vocabulary: Vocabulary, shape: tuple[int, int, int], weights: np.ndarray, step: int, rounds: int, shards: int, rate: float, size: int, parts: int) -> np.ndarray | None:
    """One pass over all shards, for the tokens whose shifted place in the text is ``step`` modulo ``rounds``; the averaged weights, None where there was no token."""
    shard = F.pmod(F.hash("key"), F.lit(shards)).alias("shard")
    sorted_rows = encoded.filter("n_tokens > 0").select("ids", shard, "key", "doc_id").repartition(min(shards, parts), "shard").sortWithinPartitions("shard", "key", "doc_id").select("ids", "shard", F.pmod("key", F.lit(rounds)).alias("shift"))
    side, width, hidden = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, now, net = None, 0, None, None
        kept: list[tuple[np.ndarray, np.ndarray]] = []  # masked tokens that do not fill a step yet

        def learn(least: int) -> int:
            token, around = (np.concatenate([x[k] for x in kept]) for k in range(2))
            at = 0
            while len(token) - at >= max(least, 1):
                net.learn(token[at : at + size], around[at : at + size], rate)
                at += size
            kept[:] = [(token[at:], around[at:])]
            return min(at, len(token))

        def close() -> tuple[np.ndarray, int]:
            learned = done + learn(1)
            return (net.flat.astype(np.float64) * learned) + (0 if total is None else total), seen + learned

        done = 0
        for b in batches:
            for part in slices(b, 0):
                of = part.column(1).to_numpy()
                cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
                for a, z in zip(cuts, [*cuts[1:], len(of)], strict=True):
                    if of[a] != now:
                        if net is not None:
                            total, seen = close()
                        now, net, kept, done = of[a], Network(vocabulary.common, vocabulary.buckets, side, width, hidden, weights), [], 0
                    token, ptr = token_rows(part.column(0).slice(a, z - a))
                    around = windows(token, ptr, side, vocabulary.size)
                    place = np.arange(len(token)) - np.repeat(ptr[:-1] - part.column(2).to_numpy()[a:z], np.diff(ptr))
                    own = np.flatnonzero(place % rounds == step)
                    kept.append((token[own], around[own]))
                    done += learn(size)
        if net is not None:
            total, seen = close()
        if seen:
            yield batch(part=np.arange(len(total), dtype=np.int32), value=total, seen=np.full(len(total), seen))

    averaged = sorted_rows.mapInArrow(run, "part int, value double, seen long").groupBy("part").agg((F.sum("value") / F.sum("seen")).alias("value"))
    table = averaged.toArrow()  # as many rows as the network has weights
    if not table.num_rows:
        return None
    out = np.empty(table.num_rows)
    out[table["part"].to_numpy()] = table["value"].to_numpy()
    return out


def pseudo_likelihood(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = 2048, buckets: int = 32, side: int = 2, width: int = 8, hidden: int = 16, rounds: int = 2, rate: float = 0.3, size: int = 2048, head: int = 1 << 17, shard: int = 1 << 22, parts: int = 20_000
) -> DataFrame:
    """One row for each document: doc_id, n_tokens, score (summed log-probabilities), score_per_token."""
    counts = materialize(count_words(docs, id_col, text_col))
    vocabulary, least = frequent_words(counts, common, buckets, head)
    encoded = materialize(encode(docs, vocabulary, id_col, text_col))
    shards = 1 + int(counts.agg(F.sum("n")).first()[0] or 0) // shard
    others = class_totals(counts, vocabulary)
    weights = Network(vocabulary.common, buckets, side, width, hidden).start(vocabulary.ranked(), others)
    for step in range(rounds):
        new = train_round(encoded, vocabulary, (side, width, hidden), weights, step, rounds, shards, rate, size, parts)
        weights = weights if new is None else new
    share = np.concatenate([np.zeros(vocabulary.common), -np.log(np.maximum(others, 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(vocabulary.common, vocabulary.buckets, side, width, hidden, weights)
        for whole in batches:
            for b in slices(whole, 0, 1 << 17):  # of about 65,000 tokens
                token, ptr = token_rows(b.column(0))
                sums = np.concatenate([[0.0], np.cumsum(net.log_probability(token, windows(token, ptr, side, vocabulary.size)).astype(np.float64) + share[token])])
                n = np.diff(ptr)
                total = np.where(n > 0, sums[ptr[1:]] - sums[ptr[:-1]] + b.column(3).to_numpy(), 0.0)
                yield batch(doc_id=b.column(1), key=b.column(2), n_tokens=n, total=total, rare=b.column(4))

    rows = encoded.select("ids", "doc_id", "key", "own", F.size("tail").cast("long").alias("rare"))
    scored = rows.mapInArrow(run, "doc_id long, key long, n_tokens long, total double, rare long")
    tail = encoded.filter("size(tail) > 0").select("key", F.explode("tail").alias("word")).join(counts.filter(F.col("n") < least), "word")
    # copies of a row share a key: each has its part of their sum
    sums = materialize(tail.groupBy("key").agg(F.sum(F.log("n")).alias("more"), F.count("*").alias("m")))
    discard(counts)
    score = F.col("total") + F.coalesce(F.col("more") * F.col("rare") / F.col("m"), F.lit(0.0))
    whole = scored.join(sums, "key", "left").withColumn("score", score)
    return whole.select("doc_id", "n_tokens", "score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("score_per_token"))
