"""Secrets in texts: plain patterns, and a linear-chain conditional random field that finds what looks and stands like them.

Patterns (the base): ``assign``, a name such as password or token, a colon or equals sign and a value of
``min_value`` characters or more; ``access``, ``AKIA`` and capitals or digits; ``hex``, a run of lower-case hex digits.
Matches are leftmost and don't overlap within their kind; those too short are dropped.

The field tags the tokens of each line (runs of letters, digits, ``+/_-`` and what lies beyond ASCII) as begin of a secret (B),
inside (I) or outside (O). A token's features are its shape (character kinds, length, changes of kind, shares of digits and
vowels, first characters), the signs around it, the words before and behind it with their shapes, and its file (shares of
digits and of assignments, length of lines). It is trained on windows of tokens around base matches, which give its labels, and
on windows elsewhere: ``max_hits`` and ``max_rest`` windows of ``2 * side`` tokens at most, those of the smallest hashes
of their content in the whole table, so the sample is bounded and doesn't depend on partitions. In half of
the windows of each step the words themselves are hidden, so that shape and signs carry weight alone. The weights have a fixed
size and go to tasks with the code. Viterbi's best path runs over whole slices of texts: blocks of steps become
max-plus matrices, blocks of these again, and lines begin anew.

A tagged run that touches no base match becomes a span of kind ``crf``; base spans stay as they are.

Defined results. Null and empty texts have no spans. Where no row has a base match there is nothing to learn from, and
the field adds nothing. Repeated rows each have their spans. Spans count code points, the end exclusive, and are
ordered by start, then by kind in the order of ``KINDS``. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, map_rows, map_texts, with_text
from gritstone.llm._words import lanes, mix, scan_rows

KINDS = ("assign", "access", "hex", "crf")
OUT, BEGIN, IN = 0, 1, 2
BLOCK = 64
NEVER = np.float32(-1e4)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: On lower-cased bytes, where a value's letters are those of either case.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(x) for x in chars]] = True
    return out


_DIGIT, _UPPER, _SMALL = _kind("0123456789"), _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("abcdefghijklmnopqrstuvwxyz")
_HEX, _VOWEL, _EQUALS, _QUOTE = _kind("0123456789abcdef"), _kind("aeiouAEIOU"), _kind("=:"), _kind("\"'`")
_BEYOND = np.arange(256) >= 0x80
_TOKEN = _DIGIT | _UPPER | _SMALL | _BEYOND | _kind("+/_-")
_CLASS = np.select([_DIGIT, _UPPER, _SMALL, _BEYOND], [1, 2, 3, 4], 0).astype(np.int8)
_SIGN = np.full(256, 15, np.uint8)
for _k, _chars in enumerate(["\n\r", " \t", "=", ":", "\"", "'", ".", ",", "/", "(", "[{", "<", ")]}>", ";|", "@#"]):
    _SIGN[[ord(x) for x in _chars]] = _k


@dataclass
class Rows:
    """Rows of bytes with a line feed behind each: row ``r`` is ``data[offsets[r]:offsets[r + 1] - 1]``."""

    data: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Rows:
        n = len(offsets) - 1
        out = np.full(len(data) + n, 0x0A, np.uint8)
        inside = np.ones(len(out), bool)
        inside[offsets[1:] + np.arange(n)] = False
        out[inside] = data
        return Rows(out, offsets + np.arange(n + 1))

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1


@dataclass
class Spans:
    """Byte spans with the number of their kind, and the value's begin (in an assignment, behind the sign)."""

    kind: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    value: np.ndarray


def base_spans(rows: Rows, min_value: int = 8, min_access: int = 16, min_hex: int = 32) -> Spans:
    """The base matches of all rows, by begin, then kind."""
    found = [(0, m.start(), m.end(), m.start(1)) for m in _ASSIGN.finditer(_LOWER[rows.data].tobytes()) if m.end() - m.start(1) >= min_value]
    found += [(1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(rows.data.tobytes()) if m.end() - m.start() >= min_access]
    edge = np.diff(_HEX[rows.data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = np.flatnonzero(end - begin >= min_hex)
    table = np.array(found, np.int64).reshape(-1, 4)
    kind = np.concatenate([table[:, 0], np.full(len(long), 2)])
    begin, end, value = (np.concatenate([table[:, k], x[long]]) for k, x in ((1, begin), (2, end), (3, begin)))
    order = np.lexsort((kind, begin))
    return Spans(kind[order], begin[order], end[order], value[order])


@dataclass
class Tokens:
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of its line
    hash: np.ndarray
    columns: list[np.ndarray]  # numbers of features


#: Feature columns: how many values each has. The words themselves are in ``WORD_COLUMNS``.
SIZES = (320, 80, 90, 100, 90, 32, 32, 4096, 4096, 4096, 4096, 1024, 64, 64, 64, 16, 16, 16)
WORD_COLUMNS = (7, 8, 9, 10)
FIRST = np.concatenate([[1], 1 + np.cumsum(SIZES)]).astype(np.int64)  # number 0: hidden
N_FEATURES = int(FIRST[-1])
_LENGTHS = np.array([4, 8, 12, 16, 20, 24, 32, 40, 64])


def tokens(rows: Rows) -> Tokens:
    """The tokens of all rows with their features."""
    d = rows.data
    edge = np.diff(_TOKEN[d].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(begin)
    if not n:
        return Tokens(begin, end, np.zeros(0, bool), np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * len(SIZES))
    size = end - begin

    def sums(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(d) + 1, np.int32)
        np.cumsum(flags, out=out[1:], dtype=np.int32)
        return out

    within = lambda s: s[end] - s[begin]
    digits, equals, breaks = sums(_DIGIT[d]), sums(_EQUALS[d]), sums(d == 0x0A)
    n_digit, n_upper, n_small, n_beyond = within(digits), within(sums(_UPPER[d])), within(sums(_SMALL[d])), within(sums(_BEYOND[d]))
    n_hex, n_vowel, quotes = within(sums(_HEX[d])), within(sums(_VOWEL[d])), sums(_QUOTE[d])
    turns = sums(np.diff(_CLASS[d], prepend=np.int8(0)) != 0)
    n_turn = turns[end] - turns[begin + 1]
    letters = n_upper + n_small
    other = size - n_digit - letters - n_beyond
    length = np.searchsorted(_LENGTHS, size, "right")
    kinds = (n_digit > 0) | (n_upper > 0) << 1 | (n_small > 0) << 2 | (other > 0) << 3 | (n_beyond > 0) << 4
    kinds = kinds.astype(np.int64)
    only = (n_hex == size) | (n_digit == size) << 1 | (letters == size) << 2
    long = (size >= 8).astype(np.int64)
    mixed = ((n_digit > 0) & (letters > 0) & (size >= 8)).astype(np.int64)

    before = np.append(np.int64(0), end[:-1])
    first = np.ones(n, bool)
    first[1:] = breaks[begin[1:]] > breaks[end[:-1]]
    gap = (equals[begin] > equals[before]) | (quotes[begin] > quotes[before]) << 1 | (begin - before == 1) << 2 | first << 3
    shift = lambda x, k, none: np.concatenate([np.full(min(k, n), none), x[: n - k]]) if k > 0 else np.concatenate([x[-k:], np.full(min(-k, n), none)])
    spans = lanes(_LOWER[d], begin, end)
    h = spans.hashes()
    word = (h >> np.uint64(52)).astype(np.int64)
    last = np.append(first[1:], True)
    prior = np.where(first, 0, shift(word, 1, 0))
    second = np.where(first | shift(first, 1, True), 0, shift(word, 2, 0))
    following = np.where(last, 0, shift(word, -1, 0))
    head = (mix(spans.values[spans.first] & np.uint64(0xFFFFFFFF)) >> np.uint64(54)).astype(np.int64)
    shape = kinds | long << 5

    row = rows.row(begin)
    share = lambda s, scale: np.minimum(7, scale * (s[rows.offsets[1:]] - s[rows.offsets[:-1]]) // np.maximum(1, np.diff(rows.offsets)))[row].astype(np.int64)
    n_lines = breaks[rows.offsets[1:]] - breaks[rows.offsets[:-1]]
    line = np.minimum(7, np.log2(np.maximum(1, np.diff(rows.offsets) / np.maximum(1, n_lines))).astype(np.int64) // 2)[row]
    columns = [
        kinds * 10 + length,
        only * 10 + length,
        (8 * n_digit // size) * 10 + length,
        np.minimum(9, n_turn) * 10 + length,
        np.where(letters > 0, 8 * n_vowel // np.maximum(letters, 1), 0) * 10 + length,
        _SIGN[d[np.maximum(begin - 1, 0)]].astype(np.int64) * 2 + long,
        _SIGN[d[end]].astype(np.int64) * 2 + long,
        prior,
        second,
        following,
        np.where(size <= 16, word, 0),
        np.where(size >= 12, head, 0),
        np.where(first, 0, shift(shape, 1, 0)),
        np.where(last, 0, shift(shape, -1, 0)),
        gap.astype(np.int64) * 2 + long,
        share(digits, 32) * 2 + mixed,
        share(equals, 200) * 2 + mixed,
        line * 2 + mixed,
    ]
    return Tokens(begin, end, first, h, [c + FIRST[k] for k, c in enumerate(columns)])


@dataclass
class Field:
    """Weights of features by tag, of a tag behind another, and of a line's first tag. A line can't begin inside, nor can inside follow outside."""

    weights: np.ndarray
    follow: np.ndarray
    start: np.ndarray

    @staticmethod
    def fresh() -> Field:
        follow, start = np.zeros((3, 3), np.float32), np.zeros(3, np.float32)
        follow[OUT, IN] = start[IN] = NEVER
        return Field(np.zeros((N_FEATURES, 3), np.float32), follow, start)

    def scores(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]), 3), np.float32)
        for c in columns:
            out += self.weights[c]
        return out

    def tag(self, t: Tokens) -> np.ndarray:
        """The best tags of the tokens, lines apart from each other."""
        steps = np.where(t.first[:, None, None], self.start, self.follow) + self.scores(t.columns)[:, None, :]
        return best_path(steps.astype(np.float32))


def best_path(steps: np.ndarray) -> np.ndarray:
    """Viterbi: the states of the highest sum of ``steps[t, before, state]``, whatever state comes before the first."""
    n, k = len(steps), steps.shape[1]
    if n <= BLOCK:
        back, score = np.zeros((n, k), np.int64), np.zeros(k, steps.dtype)
        for t in range(n):
            each = score[:, None] + steps[t]
            back[t], score = each.argmax(axis=0), each.max(axis=0)
        out = np.zeros(n, np.int64)
        state = int(score.argmax())
        for t in range(n - 1, -1, -1):
            out[t], state = state, back[t, state]
        return out
    blocks = -(-n // BLOCK)
    still = np.where(np.eye(k, dtype=bool), 0, NEVER * BLOCK).astype(steps.dtype)
    padded = np.concatenate([steps, np.broadcast_to(still, (blocks * BLOCK - n, k, k))]).reshape(blocks, BLOCK, k, k)
    reach = np.broadcast_to(still, (blocks, k, k)).copy()  # from the state before the block
    back = np.zeros((blocks, BLOCK, k, k), np.int8)
    for t in range(BLOCK):
        each = reach[:, :, :, None] + padded[:, t, None, :, :]
        back[:, t], reach = each.argmax(axis=2), each.max(axis=2)
    leave = best_path(reach - reach.max(axis=(1, 2), keepdims=True))
    # the first block's own best way in: any state may come before it
    enter = np.append(int(reach[0, :, leave[0]].argmax()), leave[:-1])
    out, state, every = np.zeros((blocks, BLOCK), np.int64), leave, np.arange(blocks)
    for t in range(BLOCK - 1, -1, -1):
        out[:, t] = state
        state = back[every, t, enter, state]
    return out.reshape(-1)[:n]


def forward_backward(field: Field, feats: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Minus the log-likelihood of ``tags`` for windows of tokens (window, place, feature column), and its gradient by scores, follow and start.

    Windows have ``lengths`` tokens; what is behind them is nothing.
    """
    m, width, _ = feats.shape
    score = field.weights[feats].sum(axis=2).astype(np.float64)
    follow, start = field.follow.astype(np.float64), field.start.astype(np.float64)
    alpha, beta = np.zeros((m, width, 3)), np.zeros((m, width, 3))
    live = np.arange(width) < lengths[:, None]
    total = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    alpha[:, 0] = start + score[:, 0]
    for t in range(1, width):
        new = total(alpha[:, t - 1, :, None] + follow, 1) + score[:, t]
        alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
    for t in range(width - 2, -1, -1):
        new = total(follow + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(live[:, t + 1, None], new, 0)
    norm = total(alpha[:, -1], 1)
    every = np.arange(m)
    own = start[tags[:, 0]] + score[every, 0, tags[:, 0]]
    marginal = np.exp(alpha + beta - norm[:, None, None]) * live[:, :, None]
    d_score, d_follow = marginal, np.zeros((3, 3))
    np.put_along_axis(d_score, tags[:, :, None], np.take_along_axis(d_score, tags[:, :, None], 2) - live[:, :, None], 2)
    for t in range(1, width):
        a = live[:, t]
        both = np.exp(alpha[a, t - 1, :, None] + follow + (score[a, t] + beta[a, t])[:, None, :] - norm[a, None, None])
        d_follow += both.sum(axis=0)
        np.add.at(d_follow, (tags[a, t - 1], tags[a, t]), -1)
        own[a] += follow[tags[a, t - 1], tags[a, t]] + score[every[a], t, tags[a, t]]
    return float((norm - own).sum()), d_score, d_follow, d_score[:, 0].sum(axis=0)


def fit(feats: np.ndarray, lengths: np.ndarray, tags: np.ndarray, epochs: int = 12, size: int = 256, rate: float = 0.2, decay: float = 1e-5, seed: int = 5) -> Field:
    """A field for the windows, by adaptive gradient steps; in half of the windows of a step words are hidden."""
    field, rng = Field.fresh(), np.random.default_rng(seed)
    seen = [np.full(x.shape, 1e-6) for x in (field.weights, field.follow, field.start)]
    fixed = [np.zeros((1, 3), bool), field.follow == NEVER, field.start == NEVER]
    for _ in range(epochs):
        order = rng.permutation(len(feats))
        for a in range(0, len(order), size):
            part = order[a : a + size]
            x = feats[part].copy()
            hidden = np.flatnonzero(rng.random(len(part)) < 0.5)
            x[np.ix_(hidden, np.arange(x.shape[1]), WORD_COLUMNS)] = 0
            _, d_score, d_follow, d_start = forward_backward(field, x, lengths[part], tags[part])
            flat = x.reshape(-1, x.shape[2])
            by_token = d_score.reshape(-1, 3)
            d_weights = np.stack([np.bincount(flat.ravel(), np.repeat(by_token[:, k], flat.shape[1]), N_FEATURES) for k in range(3)], axis=1)
            d_weights[0] = 0
            d_weights += decay * len(part) * field.weights
            for w, g, s, f in zip((field.weights, field.follow, field.start), (d_weights, d_follow, d_start), seen, fixed, strict=True):
                g = np.where(f, 0, g)
                s += g * g
                w -= (rate * g / np.sqrt(s)).astype(np.float32)
    return field


def marks(t: Tokens, spans: Spans) -> np.ndarray:
    """Tags of the tokens by the values of base spans."""
    tags = np.zeros(len(t.begin), np.int64)
    for a, b in zip(spans.value.tolist(), spans.end.tolist(), strict=True):
        i, j = np.searchsorted(t.begin, a), np.searchsorted(t.begin, b)
        if i < j and not tags[i:j].any():
            tags[i:j], tags[i] = IN, BEGIN
    return tags


def training_windows(docs: DataFrame, side: int, limits: tuple[int, int, int], id_col: str, text_col: str) -> DataFrame:
    """key, hit, feats, tags: windows around base matches, and windows elsewhere in one text of 16, by hashes of what they hold."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for data, offsets in scan_rows(b.column(1)):
            rows = Rows.of(data, offsets)
            spans = base_spans(rows, *limits)
            if not len(rows.data):
                continue
            whole = lanes(rows.data, rows.offsets[:-1], rows.offsets[1:] - 1).hashes()
            chosen = whole % np.uint64(16) == 0
            chosen[rows.row(spans.begin)] = True
            own = np.flatnonzero(chosen)
            if not len(own):
                continue
            keep = np.concatenate([np.arange(rows.offsets[r], rows.offsets[r + 1]) for r in own])
            some = Rows(rows.data[keep], np.concatenate([[0], np.cumsum((rows.offsets[1:] - rows.offsets[:-1])[own])]))
            spans = base_spans(some, *limits)
            t = tokens(some)
            if not len(t.begin):
                continue
            tags = marks(t, spans)
            columns = np.stack(t.columns, axis=1)
            row = some.row(t.begin)
            begin_row, end_row = np.searchsorted(row, np.arange(len(own))), np.searchsorted(row, np.arange(len(own)), "right")
            picks = mix(t.hash + np.arange(len(row)).astype(np.uint64) - begin_row[row].astype(np.uint64)) % np.uint64(256) == 0
            for at, hit in [(x, True) for x in np.flatnonzero(tags == BEGIN).tolist()] + [(x, False) for x in np.flatnonzero(picks).tolist()]:
                a, e = max(at - side, begin_row[row[at]]), min(at + side, end_row[row[at]])
                if not hit and tags[a:e].any():
                    continue
                # a window is taken as one line, and one that begins inside a secret begins it
                w = tags[a:e].copy()
                if w[0] == IN:
                    w[0] = BEGIN
                key = mix(np.array([t.hash[at], whole[own[row[at]]], at - begin_row[row[at]]], np.uint64))
                out.append((int(mix(key[:1] ^ key[1:2] ^ key[2:])[0].view(np.int64)), hit, columns[a:e].astype("<i2").tobytes(), w.astype(np.int8).tobytes()))
        if not out:
            return None
        key, hit, feats, tags = zip(*out, strict=True)
        return batch(key=pa.array(key, pa.int64()), hit=pa.array(hit), feats=pa.array(feats, pa.binary()), tags=pa.array(tags, pa.binary()))

    return map_texts(docs, run, "key long, hit boolean, feats binary, tags binary", id_col, text_col)


def train(docs: DataFrame, max_hits: int, max_rest: int, side: int, limits: tuple[int, int, int], id_col: str, text_col: str) -> Field | None:
    windows = training_windows(docs, side, limits, id_col, text_col)
    found = windows.filter("hit").orderBy("key", "feats").limit(max_hits).unionByName(windows.filter("not hit").orderBy("key", "feats").limit(max_rest)).toArrow()
    if not pc.any(found["hit"]).as_py():
        return None
    found = found.sort_by([("key", "ascending"), ("feats", "ascending")])
    n = found.num_rows
    feats, tags, lengths = np.zeros((n, 2 * side, len(SIZES)), np.int64), np.zeros((n, 2 * side), np.int64), np.zeros(n, np.int64)
    for k, (f, t) in enumerate(zip(found["feats"].to_pylist(), found["tags"].to_pylist(), strict=True)):
        lengths[k] = len(t)
        tags[k, : len(t)] = np.frombuffer(t, np.int8)
        feats[k, : len(t)] = np.frombuffer(f, "<i2").reshape(len(t), -1)
    return fit(feats, lengths, tags)


def find(rows: Rows, field: Field | None, limits: tuple[int, int, int]) -> Spans:
    """All spans of the rows, by begin, then kind."""
    base = base_spans(rows, *limits)
    if field is None:
        return base
    t = tokens(rows)
    if not len(t.begin):
        return base
    tags = field.tag(t)
    head = np.flatnonzero(tags == BEGIN)
    inside = np.append(tags[1:], OUT) == IN
    stop = np.flatnonzero((tags != OUT) & ~inside)
    begin, end = t.begin[head], t.end[stop[np.searchsorted(stop, head)]]
    # touched by a base span: one begins before its end and ends behind its begin
    so_far = np.concatenate([[0], np.maximum.accumulate(base.end)]) if len(base.end) else np.zeros(1, np.int64)
    free = so_far[np.searchsorted(base.begin, end)] <= begin
    begin, end = begin[free], end[free]
    kind = np.concatenate([base.kind, np.full(len(begin), 3)])
    begin, end, value = np.concatenate([base.begin, begin]), np.concatenate([base.end, end]), np.concatenate([base.value, begin])
    order = np.lexsort((kind, begin))
    return Spans(kind[order], begin[order], end[order], value[order])


def found_spans(texts: pa.Array, field: Field | None, limits: tuple[int, int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of rows: where the spans of each row begin among all, and kinds, begins and ends in code points of the row."""
    for data, offsets in scan_rows(texts):
        rows = Rows.of(data, offsets)
        s = find(rows, field, limits)
        lead = np.zeros(len(rows.data) + 1, np.int64)
        np.cumsum((rows.data & 0xC0) != 0x80, out=lead[1:])
        row = rows.row(s.begin)
        zero = lead[rows.offsets[row]]
        yield np.searchsorted(row, np.arange(len(offsets))), s.kind, lead[s.begin] - zero, lead[s.end] - zero


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, spans array<struct<kind:string, start:long, end:long>>"


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_value: int = 8,
    min_access: int = 16,
    min_hex: int = 32,
    max_hits: int = 2000,
    max_rest: int = 4000,
    side: int = 16,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, how many base matches of each kind it has, and all its spans. A pass to learn, a narrow pass to scan."""
    limits = (min_value, min_access, min_hex)
    field = train(docs, max_hits, max_rest, side, limits, id_col, text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, sizes, cols = [np.zeros((0, 3), np.int64)], [np.zeros(1, np.int64)], []
        for ptr, kind, begin, end in found_spans(b.column(1), field, limits):
            n = len(ptr) - 1
            row = np.repeat(np.arange(n), np.diff(ptr))
            counts.append(np.stack([np.bincount(row[kind == k], minlength=n) for k in range(3)], axis=1))
            sizes.append(np.diff(ptr))
            cols.append((kind, begin, end))
        kind, begin, end = (np.concatenate([np.zeros(0, np.int64), *(c[k] for c in cols)]) for k in range(3))
        values = pa.StructArray.from_arrays([pa.array(list(KINDS)).take(pa.array(kind)), pa.array(begin), pa.array(end)], ["kind", "start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), values)
        each = np.concatenate(counts)
        return batch(doc_id=b.column(0), n_assign=np.ascontiguousarray(each[:, 0]), n_access=np.ascontiguousarray(each[:, 1]), n_hex=np.ascontiguousarray(each[:, 2]), spans=spans)

    return map_texts(docs, run, SCHEMA, id_col, text_col)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def mask_secrets(docs: DataFrame, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", min_value: int = 8, min_access: int = 16, min_hex: int = 32, max_hits: int = 2000, max_rest: int = 4000, side: int = 16) -> DataFrame:
    """``docs`` with ``mask`` in place of each span, of spans that overlap in place of what they cover together; other columns stay, n_chars follows the text."""
    limits = (min_value, min_access, min_hex)
    field = train(docs, max_hits, max_rest, side, limits, id_col, text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index(text_col))
        new, row = texts.to_pylist(), 0
        for ptr, _, begin, end in found_spans(texts, field, limits):
            for r in np.flatnonzero(np.diff(ptr)).tolist():
                text, out, at = new[row + r], [], 0
                for a, e in zip(begin[ptr[r] : ptr[r + 1]].tolist(), end[ptr[r] : ptr[r + 1]].tolist(), strict=True):
                    if a >= at or not out:
                        out += [text[at:a], mask]
                    at = max(at, e)
                new[row + r] = "".join(out) + text[at:]
            row += len(ptr) - 1
        return with_text(b, pa.array(new, texts.type), text_col)

    return map_rows(docs, run, text_col)
