"""MinHash near-dedup: banded MinHash candidates, odd sketches to estimate them, full sets to confirm.

A document's set holds its distinct five-word shingles (all its words as one where it has fewer). Equal
sets are one class, handled by its smallest doc_id; classes stand for their members from there on.

- ``bands * rows`` MinHash samples of each class are cut into bands. Classes that share a band are
  candidates; two of similarity 0.75 share none with a chance of about 1e-8 at 48 bands of 4.
- Odd sketch: every sample flips one bit of a 512-bit map. The XOR of two maps holds the parities of the
  samples that differ, so its population count estimates a high similarity precisely; candidates more
  than six standard errors below the threshold are left out. Two of exactly the threshold are left out by chance
  about once in ten million (the limit is five standard deviations of the count above its mean, simulated).
- The others are confirmed on the full sets: ``100 * intersection >= threshold * union``.

Pairs in a band are never all emitted. A band's hub is the class that shares most bands with others: the
middle of a group of near copies. Each class is first compared with the best of its hubs, and links so
confirmed merge components. Then rounds compare, in bands with several components, one further hub with
the classes of other components, while that shrinks what is left. A last sweep takes all classes whose
bands still hold several components and finds their links by prefixes of rare shingles, which is exact.
So no link between different components is left out, however large a group of near copies is.

Keys that many rows share (a set that thousands of copies have, a band of a large group) meet their other side as a
written table, so that Spark splits them over tasks; rows without a partner take no part in such joins.

Null and empty texts have an empty set and link with nothing. Repeated rows have equal sets: the smallest
doc_id stays, and rows of one doc_id are all kept or dropped together. Of links of equal similarity all count, so
ties change nothing. An empty table gives an empty result. Texts are read whole, a slice of rows of about 1 MB at a
time; a longer text is a slice of its own. Other columns are not read by ``classes`` and pass through ``near_dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, components, discard, map_texts, materialize
from gritstone.llm._words import PLAIN, Chunk, chunks, mix, window_hash

BITS = 512
_FILL = np.iinfo(np.uint32).max


def shingles(c: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the chunk's rows, by row, and where each row's begin (one more entry than rows)."""
    words, n = c.word_hash(), c.n_words()
    h = window_hash(words, size)
    at = np.flatnonzero(c.room()[: len(h)] >= size)
    row = c.rows()[at]
    h = h[at]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        extra = np.array([np.bitwise_xor.reduce(mix(words[c.ptr[r] : c.ptr[r + 1]] + np.arange(1, n[r] + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))) for r in few], np.uint64)
        h, row = np.concatenate([h, extra]), np.concatenate([row, few])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint16 if c.n < 65536 else np.int64), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(c.n + 1))


class MinHash:
    """``bands * rows`` samples of a set, folded into band hashes and an odd sketch."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(7)
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.flip = rng.integers(0, 2**32, self.k, dtype=np.uint32)
        self.factor = rng.integers(0, 2**31, self.k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.salt = rng.integers(0, 2**63, self.k, dtype=np.uint64)
        self.combine = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, h: np.ndarray) -> np.ndarray:
        x = (h >> np.uint64(32)).astype(np.uint32)[:, None]
        low = np.full(self.k, _FILL, np.uint32)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024] ^ self.flip
            part *= self.factor
            np.minimum(low, part.min(axis=0), out=low)
        return low

    def fold(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes (sets, bands) and odd sketches (sets, 8 words of 64 bits)."""
        wide = samples.astype(np.uint64)
        banded = (mix(wide + self.salt).reshape(len(wide), self.bands, self.rows) * self.combine).sum(axis=2, dtype=np.uint64)
        bands = mix(banded + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bit = (mix(wide * np.uint64(0xC2B2AE3D27D4EB4F) + self.salt) >> np.uint64(55)).astype(np.int64)
        odd = np.zeros((len(wide), BITS), np.uint8)
        np.add.at(odd, (np.arange(len(wide))[:, None], bit), 1)
        return bands, np.packbits(odd & 1, axis=1, bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, print (two hashes of the set), bands and the odd sketch; empty sets have no bands."""
    sampler = MinHash(bands, rows)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, p1, p2, band, odd = [], [], [], [], []
        for c in chunks(b.column(1), PLAIN, lower=True):
            h, ptr = shingles(c, shingle)
            size = np.diff(ptr)
            sums = np.zeros((2, len(h) + 1), np.uint64)
            np.cumsum(h, out=sums[0, 1:])
            np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
            prints = mix(sums[:, ptr[1:]] - sums[:, ptr[:-1]] + size.astype(np.uint64))
            samples = np.full((c.n, sampler.k), _FILL, np.uint32)
            for r in np.flatnonzero(size).tolist():
                samples[r] = sampler.samples(h[ptr[r] : ptr[r + 1]])
            x, y = sampler.fold(samples)
            n.append(size)
            p1.append(prints[0])
            p2.append(prints[1])
            band.append(x)
            odd.append(y)
        join = lambda parts, width: np.concatenate([np.zeros((0, *width), np.uint64), *parts]).view(np.int64)
        lists = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
        return batch(doc_id=b.column(0), n_shingles=np.concatenate([np.zeros(0, np.int64), *n]), print_a=join(p1, ()), print_b=join(p2, ()), bands=lists(join(band, (bands,))), odd=lists(join(odd, (BITS // 64,))))

    return map_texts(docs, run, "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>, odd array<long>", id_col, text_col)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its full set of shingle hashes."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes = [], []
        for c in chunks(b.column(1), PLAIN, lower=True):
            h, ptr = shingles(c, shingle)
            flat.append(h.view(np.int64))
            sizes.append(np.diff(ptr))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int32)
        return batch(doc_id=b.column(0), shingles=pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *flat]))))

    return map_texts(texts, run, "doc_id long, shingles array<long>")


def odd_limit(k: int, threshold: float) -> int:
    """The largest XOR count at which two sketches may still belong to sets of ``threshold`` percent."""
    share = threshold / 100
    least = share - 6 * (share * (1 - share) / k) ** 0.5
    return int(BITS / 2 * (1 - np.exp(-2 * 2 * k * (1 - least) / BITS))) + 6


def confirm(pairs: DataFrame, odd: DataFrame, sets: DataFrame, limit: int, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose sketches allow and whose full sets confirm a link.

    A's set travels with each pair to b's, so b is to be the one that many pairs have: its set travels once.
    """
    words = range(BITS // 64)
    left = odd.select(F.col("doc_id").alias("a"), F.col("odd").alias("odd_a"))
    right = odd.select(F.col("doc_id").alias("b"), F.col("odd").alias("odd_b"))
    differ = sum((F.bit_count(F.get("odd_a", F.lit(k)).bitwiseXOR(F.get("odd_b", F.lit(k)))) for k in words), F.lit(0))
    likely = pairs.distinct().join(left, "a").join(right, "b").filter(differ <= limit).select("a", "b")
    set_a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    set_b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = likely.join(set_a, "a").join(set_b, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    linked = both.withColumn("common", common).filter(F.lit(100) * F.col("common") >= F.lit(threshold) * (F.size("set_a") + F.size("set_b") - F.col("common")))
    return linked.select("a", "b")


def prefix_pairs(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (doc_id, comp) in different components that may reach ``threshold``; none that does is missing; b has no fewer pairs than a.

    Shingles are ordered from the rarest (among the members) to the commonest. Sets of n and m shingles that
    reach the threshold t share ``o = ceil(t / (1 + t) * (n + m))`` or more, so the first that they share is
    among the first ``n - o + 1`` of one and the first ``m - o + 1`` of the other. What a group has in common
    stands at the ends of its sets, so sets that are alike, but too little, do not meet.
    """
    one = sets.join(members, "doc_id").select("doc_id", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = materialize(one.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"))
    order = Window.partitionBy("doc_id").orderBy("df", "shingle")  # one document's shingles
    ranked = one.join(common, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("rank", F.row_number().over(order)).filter("df > 1")
    # the largest part of a set that any partner can make necessary: a set of n has none under t * n shingles
    last = f"n - ({threshold} * n + 99) div 100 + 1"
    early = f"n - ({2 * threshold} * n + {99 + threshold}) div {100 + threshold} + 1"  # with a partner of n or more
    ranked = materialize(ranked.filter(f"rank <= {last}").select("shingle", "doc_id", "comp", "n", "rank", F.expr(f"rank <= {early}").alias("early")))
    small = ranked.filter("early").select("shingle", F.col("doc_id").alias("b"), F.col("comp").alias("other"), F.col("n").alias("m"), F.col("rank").alias("place"))
    overlap = f"({threshold} * (n + m) + {99 + threshold}) div {100 + threshold}"
    near = f"comp <> other and (n > m or n = m and doc_id > b) and 100 * m >= {threshold} * n and rank <= n - {overlap} + 1 and place <= m - {overlap} + 1"
    both = ranked.join(small, (ranked["shingle"] == small["shingle"]) & F.expr(near))
    pairs = materialize(both.select(F.col("doc_id").alias("a"), "b").distinct())
    often = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    ends = pairs.join(often.toDF("a", "in_a"), "a").join(often.toDF("b", "in_b"), "b")
    turned = F.col("in_a") > F.col("in_b")
    return ends.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))


def classes(docs: DataFrame, shingle: int = 5, threshold: int = 75, bands: int = 48, rows: int = 4, id_col: str = "doc_id", text_col: str = "text", max_rounds: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included), kept (doc_id = component_id)."""
    sigs = materialize(signatures(docs, shingle, bands, rows, id_col, text_col))
    alike = ["print_a", "print_b", "n_shingles"]
    own = materialize(sigs.filter("n_shingles > 0").groupBy(*alike).agg(F.min("doc_id").alias("class"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    some = sigs.filter("n_shingles > 0").select("doc_id", *alike).join(own, alike, "left").select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("class"))
    none = sigs.filter("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class"))
    member = materialize(some.unionByName(none))
    firsts = member.filter("doc_id = class").select("doc_id").distinct()
    reps = sigs.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    banded = materialize(reps.select("doc_id", F.explode("bands").alias("band")))
    shared = materialize(banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"))
    met = materialize(banded.join(shared, "band"))
    discard(own, banded, shared)
    drawn = met.groupBy("doc_id").agg(F.sum("size").alias("drawn"))  # how many share bands with it: most for the middle of a group
    in_band = materialize(met.join(drawn, "doc_id").select("band", "doc_id", "drawn"))
    discard(met)
    candidates = materialize(in_band.select("doc_id").distinct())
    odd = materialize(sigs.select("doc_id", "odd").join(candidates, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    discard(sigs)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(candidates, "doc_id", "left_semi")
    sets = materialize(shingle_sets(texts, shingle).dropDuplicates(["doc_id"]))
    limit = odd_limit(bands * rows, threshold)

    hubs = materialize(in_band.groupBy("band").agg(F.max(F.struct("drawn", -F.col("doc_id"))).alias("hub")))
    best = in_band.join(hubs, "band").groupBy("doc_id").agg((-F.max("hub")["col2"]).alias("b")).filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    links = materialize(confirm(best, odd, sets, limit, threshold))
    comps = components(links)
    total = in_band.count()
    discard(hubs)
    pending = None
    for step in range(max_rounds + 1):
        labels = comps.select(F.col("id").alias("doc_id"), "comp")
        labelled = materialize(in_band.join(labels, "doc_id", "left").select("band", "doc_id", "drawn", F.coalesce("comp", "doc_id").alias("comp")))
        several = materialize(labelled.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("band"))
        former, in_band = in_band, materialize(labelled.join(several, "band"))  # bands with one component are finished
        discard(former, labelled, several)
        by_comp = in_band.groupBy("band", "comp").agg(F.count("*").alias("n"))
        main = by_comp.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"))
        main = main.select((F.col("size") - F.col("main")["n"]).alias("apart"), "size")
        work = main.agg(F.sum(F.col("apart") * F.col("size"))).first()[0] or 0
        if not work:
            break
        sweep = step == max_rounds or work <= total // 4 or (pending is not None and work > 0.8 * pending)
        pending = work
        if sweep:
            pairs = prefix_pairs(materialize(in_band.select("doc_id", "comp").distinct()), sets, threshold)
        else:
            others = in_band.select("band", F.col("doc_id").alias("b"), F.col("comp").alias("other"))
            hubs = in_band.groupBy("band").agg(F.max(F.struct("drawn", -F.col("doc_id"), "comp")).alias("hub"))
            ours = materialize(hubs.select("band", (-F.col("hub")["col2"]).alias("a"), F.col("hub")["comp"].alias("comp")))
            pairs = ours.join(others, "band").filter("comp <> other").select(F.col("b").alias("a"), F.col("a").alias("b"))
        more = materialize(links.union(confirm(pairs, odd, sets, limit, threshold)).distinct())
        discard(links, comps)
        links, comps = more, components(more)
        if sweep:
            break
        done = ours.select("band", F.col("a").alias("doc_id"))  # compared with all the band
        former, in_band = in_band, materialize(in_band.drop("comp").join(done, ["band", "doc_id"], "left_anti"))
        discard(former, ours)
    discard(in_band, links, odd, sets, candidates)
    label = comps.select(F.col("id").alias("class"), "comp")
    out = member.join(label, "class", "left").select("doc_id", "n_shingles", F.coalesce("comp", "class", "doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns unchanged, with one document of each group: that of the smallest doc_id."""
    dropped = classes(docs, id_col=id_col, text_col=text_col, **options).filter("not kept").select(F.col("doc_id").alias("_near_copy"))
    return docs.join(dropped, docs[id_col].cast("long") == dropped["_near_copy"], "left_anti")
