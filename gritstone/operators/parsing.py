"""Code corpora as tables: one distributed Arrow pass decodes bytes; sections, keys, storage and texts follow by joins and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import is_likely_text, is_terminal, trailer_bounds
from gritstone.functions.windows import SLICE
from gritstone.operators.sequences import running_depth, segment, validate_intervals

#: Operation names by opcode.
NAMED = {
    0x00: "STOP", 0x01: "ADD", 0x02: "MUL", 0x03: "SUB", 0x04: "DIV", 0x05: "SDIV", 0x06: "MOD", 0x07: "SMOD", 0x08: "ADDMOD", 0x09: "MULMOD", 0x0A: "EXP", 0x0B: "SIGNEXTEND",
    0x10: "LT", 0x11: "GT", 0x12: "SLT", 0x13: "SGT", 0x14: "EQ", 0x15: "ISZERO", 0x16: "AND", 0x17: "OR", 0x18: "XOR", 0x19: "NOT", 0x1A: "BYTE", 0x1B: "SHL", 0x1C: "SHR", 0x1D: "SAR",
    0x20: "KECCAK256", 0x30: "ADDRESS", 0x31: "BALANCE", 0x32: "ORIGIN", 0x33: "CALLER", 0x34: "CALLVALUE", 0x35: "CALLDATALOAD", 0x36: "CALLDATASIZE", 0x37: "CALLDATACOPY", 0x38: "CODESIZE",
    0x39: "CODECOPY", 0x3A: "GASPRICE", 0x3B: "EXTCODESIZE", 0x3C: "EXTCODECOPY", 0x3D: "RETURNDATASIZE", 0x3E: "RETURNDATACOPY", 0x3F: "EXTCODEHASH", 0x40: "BLOCKHASH", 0x41: "COINBASE",
    0x42: "TIMESTAMP", 0x43: "NUMBER", 0x44: "PREVRANDAO", 0x45: "GASLIMIT", 0x46: "CHAINID", 0x47: "SELFBALANCE", 0x48: "BASEFEE", 0x49: "BLOBHASH", 0x4A: "BLOBBASEFEE", 0x50: "POP",
    0x51: "MLOAD", 0x52: "MSTORE", 0x53: "MSTORE8", 0x54: "SLOAD", 0x55: "SSTORE", 0x56: "JUMP", 0x57: "JUMPI", 0x58: "PC", 0x59: "MSIZE", 0x5A: "GAS", 0x5B: "JUMPDEST", 0x5C: "TLOAD",
    0x5D: "TSTORE", 0x5E: "MCOPY", 0x5F: "PUSH0", 0xF0: "CREATE", 0xF1: "CALL", 0xF2: "CALLCODE", 0xF3: "RETURN", 0xF4: "DELEGATECALL", 0xF5: "CREATE2", 0xFA: "STATICCALL", 0xFD: "REVERT",
    0xFE: "INVALID", 0xFF: "SELFDESTRUCT",
}


def mnemonics() -> list[str]:
    """The name of each opcode; families by rule, others that have no name ``UNKNOWN``."""
    out = [NAMED.get(k, "UNKNOWN") for k in range(256)]
    for n in range(1, 33):
        out[0x5F + n] = f"PUSH{n}"
    for n in range(1, 17):
        out[0x7F + n], out[0x8F + n] = f"DUP{n}", f"SWAP{n}"
    for n in range(5):
        out[0xA0 + n] = f"LOG{n}"
    return out


NAMES = pa.array(mnemonics())


def starts(step: list[int], ends: list[int]) -> np.ndarray:
    """Where the instructions of linear sweeps begin: codes end at ``ends`` in a row of bytes whose instructions take ``step`` bytes."""
    out, at = [], 0
    for end in ends:
        while at < end:
            out.append(at)
            at += step[at]
        at = end
    return np.array(out, np.int64)


def sweep(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linear sweeps of all codes: their sizes, all bytes, where each code begins, the bytes an instruction takes at each place; the places of whole instructions and their codes."""
    size_of = pc.fill_null(pc.binary_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data, ends = np.frombuffer(b"".join(x for x in codes.to_pylist() if x), np.uint8), np.cumsum(size_of)
    step = np.where((data >= 0x60) & (data <= 0x7F), data.astype(np.int64) - 0x5E, 1)
    at = starts(step.tolist(), ends.tolist())
    row = np.searchsorted(ends, at, "right")
    whole = at + step[at] <= ends[row] if len(at) else np.zeros(0, bool)
    return size_of, data, ends - size_of, step, at[whole], row[whole]


def in_slices(codes: DataFrame, fn: Callable[..., pa.RecordBatch], schema: str, id_col: str, code_col: str, more: Sequence[str] = ()) -> DataFrame:
    """Runs ``fn`` over ids, codes and the columns ``more``, about 1 MB of codes (one at least) at a time; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            row = 0
            while row < b.num_rows:
                stop = max(row + 1, int(np.searchsorted(size, (int(size[row - 1]) if row else 0) + SLICE, "right")))
                yield fn(*(c.slice(row, stop - row) for c in b.columns))
                row = stop

    return codes.select(F.col(id_col).cast("long").alias("code_id"), F.col(code_col).alias("code"), *more).mapInArrow(run, schema)


def decoded(ids: pa.Array, codes: pa.Array) -> pa.RecordBatch:
    """The rows of ``decode_instructions`` for some codes: instructions in order, then the codes that have no bytes."""
    size_of, data, begins, step, at, row = sweep(codes)
    is_push = step > 1
    first = np.searchsorted(row, np.arange(len(begins)))
    push = is_push[at]
    inside = np.zeros(len(data) + 1, np.int8)  # +1 where an immediate begins, -1 behind it
    inside[at[push] + 1] += 1
    inside[at[push] + step[at[push]]] -= 1
    digits = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)].tobytes().hex().encode()
    offsets = np.concatenate([[0], np.cumsum(np.where(push, 2 * step[at] - 2, 0))]).astype(np.int32)
    imm = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(digits), pa.py_buffer(np.packbits(push, bitorder="little")))
    none = np.flatnonzero(size_of == 0)
    blank = lambda kind: pa.nulls(len(none), kind)
    one = [ids.take(pa.array(row)), pa.array(np.arange(len(at)) - first[row], pa.int32()), pa.array(at - begins[row], pa.int32()), pa.array(data[at], pa.int16()), NAMES.take(pa.array(data[at].astype(np.int64))), imm, pa.array(step[at], pa.int32())]
    two = [ids.take(pa.array(none)), blank(pa.int32()), blank(pa.int32()), blank(pa.int16()), pa.array(["EMPTY"] * len(none), pa.string()), blank(pa.string()), pa.array(np.zeros(len(none)), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(one, two, strict=True)], schema=SCHEMA)


def decode_instructions(codes: DataFrame, id_col: str = "code_id", code_col: str = "code") -> DataFrame:
    """code_id, idx, pc, opcode, mnemonic, imm, size by a linear sweep; no shuffle.

    PUSHn takes the next n bytes (imm, lower-case hex); one cut off by the end stops the sweep. Null and
    empty codes give one row with idx null and mnemonic EMPTY. The codes of a batch are decoded together, about
    1 MB of them (one at least) at a time.
    """
    return in_slices(codes, decoded, "code_id long, idx int, pc int, opcode short, mnemonic string, imm string, size int", id_col, code_col)


SCHEMA = pa.schema([("code_id", pa.int64()), ("idx", pa.int32()), ("pc", pa.int32()), ("opcode", pa.int16()), ("mnemonic", pa.string()), ("imm", pa.string()), ("size", pa.int32())])


def encode_check(instr: DataFrame, codes: DataFrame) -> DataFrame:
    """code_id, encoded (hex), ok (equals the code, up to a cut-off end), bad_immediates."""
    is_push = F.col("opcode").between(0x60, 0x7F)
    wrong = (is_push & (F.coalesce(F.length("imm"), F.lit(0)) != 2 * (F.col("opcode") - 0x5F))) | (~is_push & F.col("imm").isNotNull())
    one = F.concat(F.lpad(F.lower(F.hex("opcode")), 2, "0"), F.coalesce("imm", F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("h")))), lambda x: x["h"]), "")
    built = instr.filter("idx is not null").groupBy("code_id").agg(joined.alias("encoded"), F.count_if(wrong).alias("bad_immediates"))
    both = codes.select("code_id", F.lower(F.hex("code")).alias("_hex")).join(built, "code_id")
    return both.select("code_id", "encoded", F.startswith("_hex", "encoded").alias("ok"), "bad_immediates")


def encode_codes(codes: DataFrame, id_col: str = "code_id", code_col: str = "code") -> DataFrame:
    """``encode_check`` of the codes' own instructions in one pass, as a batch has whole codes; no shuffle."""
    digits = pa.array([f"{k:02x}" for k in range(256)])

    def encode(ids: pa.Array, codes: pa.Array) -> pa.RecordBatch:
        rows = decoded(pa.array(np.arange(len(codes))), codes)
        rows = rows.filter(pc.is_valid(rows["idx"]))
        op, imm = rows["opcode"].to_numpy().astype(np.int64), rows["imm"]
        own, first = np.unique(rows["code_id"].to_numpy(), return_index=True)
        ends = np.append(first, len(op))
        long = pc.fill_null(pc.binary_length(imm), 0).to_numpy()
        push = (op >= 0x60) & (op <= 0x7F)
        wrong = np.where(push, long != 2 * (op - 0x5F), pc.is_valid(imm).to_numpy(zero_copy_only=False))
        one = pc.binary_join_element_wise(digits.take(pa.array(op)), pc.fill_null(imm, ""), "")
        encoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), one), "")
        same = [code.hex().startswith(text) for code, text in zip(codes.take(pa.array(own)).to_pylist(), encoded.to_pylist(), strict=True)]
        bad = np.diff(np.concatenate([[0], np.cumsum(wrong)])[ends])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(own)), encoded, pa.array(same, pa.bool_()), pa.array(bad.astype(np.int64))], ["code_id", "encoded", "ok", "bad_immediates"])

    return in_slices(codes, encode, "code_id long, encoded string, ok boolean, bad_immediates long", id_col, code_col)


def unknown_opcodes(codes: DataFrame, id_col: str = "code_id", code_col: str = "code") -> DataFrame:
    """P2 of codes: code_id, total, unknown, unknown_kinds of those with an instruction. A row a code is shuffled: two counts, and which opcodes are unknown as 256 bits."""
    unknown = np.array([name == "UNKNOWN" for name in mnemonics()])

    def count(ids: pa.Array, codes: pa.Array) -> pa.RecordBatch:
        _, data, begins, _, at, row = sweep(codes)
        op, n = data[at].astype(np.int64), len(begins)
        odd = unknown[op]
        total, strange = np.bincount(row, minlength=n), np.bincount(row[odd], minlength=n)
        pairs = np.unique(row[odd].astype(np.int64) * 256 + op[odd])
        bits = np.zeros((n, 4), np.uint64)
        np.bitwise_or.at(bits, (pairs >> 8, pairs >> 6 & 3), np.uint64(1) << (pairs & 63).astype(np.uint64))
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), *(pa.array(x[some].astype(np.int64)) for x in (total, strange)), *(pa.array(bits[some, k].view(np.int64)) for k in range(4))], ["code_id", "total", "unknown", *words])

    words = [f"w{k}" for k in range(4)]
    each = in_slices(codes, count, "code_id long, total long, unknown long, w0 long, w1 long, w2 long, w3 long", id_col, code_col)
    one = each.groupBy("code_id").agg(F.sum("total").alias("total"), F.sum("unknown").alias("unknown"), *(F.bit_or(w).alias(w) for w in words))
    return one.select("code_id", "total", "unknown", sum((F.bit_count(w) for w in words), F.lit(0)).cast("long").alias("unknown_kinds"))


def block_table(instr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (code_id, node, kind, start_pc, end_pc, n_instr, max_stack, last_op, first_op) and instructions with their node.

    Node 0 is the entry, node 1 the exit; body blocks follow in order from 2. A block begins at a JUMPDEST
    and after a block ending (W1); its stack depth counts pushes and pops alone and never falls below 0.
    """
    op = F.col("mnemonic")
    ends = op.isin("STOP", "RETURN", "REVERT", "SELFDESTRUCT", "INVALID", "JUMP", "JUMPI")
    rows = segment(instr.filter("idx is not null"), ["code_id"], ["idx"], op == "JUMPDEST", ends, "_segment").withColumn("node", (F.col("_segment") + 2).cast("int")).drop("_segment")
    delta = F.when(op.startswith("PUSH") | op.startswith("DUP"), 1).when(op == "POP", -1).otherwise(0)
    deep = running_depth(rows, ["code_id", "node"], ["idx"], delta)
    body = deep.groupBy("code_id", "node").agg(
        F.lit("Body").alias("kind"), F.min("pc").alias("start_pc"), F.max("pc").alias("end_pc"), F.count("*").cast("int").alias("n_instr"), F.coalesce(F.max(F.when(F.col("at_rise"), F.col("depth"))), F.lit(0)).cast("int").alias("max_stack"),
        F.max_by("mnemonic", "idx").alias("last_op"), F.min_by("mnemonic", "idx").alias("first_op"),
    )
    none = F.lit(None)
    ends_ = instr.select("code_id").distinct().select("code_id", F.explode(F.array(F.struct(F.lit(0).alias("node"), F.lit("Entry").alias("kind")), F.struct(F.lit(1).alias("node"), F.lit("Exit").alias("kind")))).alias("_e"))
    ends_ = ends_.select("code_id", "_e.node", "_e.kind", none.cast("int").alias("start_pc"), none.cast("int").alias("end_pc"), F.lit(0).alias("n_instr"), F.lit(0).alias("max_stack"), none.cast("string").alias("last_op"), none.cast("string").alias("first_op"))
    return ends_.unionByName(body), rows


def with_control(blocks: DataFrame, jumps: DataFrame, rows: DataFrame) -> DataFrame:
    """Blocks with control(tag, target): Terminal, Jump, Branch, Fallthrough, or Unknown where a jump has no resolved block."""
    last = jumps.join(rows.select("code_id", "idx", "node"), ["code_id", "idx"]).select("code_id", "node", "target")
    both = blocks.join(last, ["code_id", "node"], "left")
    op = F.col("last_op")
    terminal = op.isin("STOP", "RETURN", "REVERT", "SELFDESTRUCT", "INVALID")
    tag = F.when(F.col("kind") != "Body", None).when(terminal, "Terminal").when(op.isin("JUMP", "JUMPI") & F.col("target").isNull(), "Unknown").when(op == "JUMP", "Jump").when(op == "JUMPI", "Branch").otherwise("Fallthrough")
    return both.withColumn("control", F.struct(tag.alias("tag"), F.col("target").cast("int").alias("target"))).drop("target")


class Blocks(NamedTuple):
    """Instructions, blocks and jumps of some codes laid end to end; a block's code is its place among the codes."""

    sizes: np.ndarray  # bytes of each code
    data: np.ndarray  # all bytes
    at: np.ndarray  # where each instruction begins, in ``data``
    op: np.ndarray
    pcs: np.ndarray
    starts: np.ndarray  # each code's first instruction
    ringed: np.ndarray  # codes with an entry and an exit
    own: np.ndarray  # each block's code
    node: np.ndarray  # its number in that, from 2 on
    first: np.ndarray  # its first instruction
    last: np.ndarray
    inside: np.ndarray  # each instruction's block
    deepest: np.ndarray  # each block's largest stack
    kind: np.ndarray  # place in ``TAGS``
    target: np.ndarray  # the node that its jump goes to, -1 where there is none
    jumps: np.ndarray  # blocks that end in a jump
    form: np.ndarray  # of these, place in ``FORMS``
    value: np.ndarray  # and what they go to, -1 where that is not known


TAGS = ["Unknown", "Jump", "Branch", "Terminal", "Fallthrough"]
FORMS = ["direct", "sum", "relative", None]


def jump_values(j: np.ndarray, data: np.ndarray, at: np.ndarray, step: np.ndarray, pcs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What jumps at the instructions ``j``, whose codes begin at ``first``, go to, -1 where that is not known; and their form (place in ``FORMS``)."""

    def back(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Operation, whether a number was pushed, and it, of the k-th instruction before; -1 beyond the code's begin."""
        place = at[np.maximum(j - k, 0)]
        op = np.where(j - k >= first, data[place].astype(np.int64), -1)
        value = np.zeros(len(j), np.int64)
        for b in range(1, 8):
            value = np.where(step[place] > b, value * 256 + data[np.minimum(place + b, len(data) - 1)], value)
        return op, (op >= 0x60) & (op <= 0x66), value

    (op1, push1, v1), (op2, push2, v2), (_, push3, v3) = back(1), back(2), back(3)
    total = np.where(push2, v2 + v3, np.where(op2 == 0x58, pcs[np.maximum(j - 2, 0)] + v3, -1))
    added = (op1 == 0x01) & push3
    form = np.select([push1, added & push2, added & (op2 == 0x58)], [0, 1, 2], 3)
    return np.where(push1, v1, np.where(added, total, -1)), form


def blocks_of(codes: pa.Array) -> Blocks:
    closing = np.zeros(256, bool)
    closing[[0x00, 0x56, 0x57, 0xF3, 0xFD, 0xFE, 0xFF]] = True
    rise = np.zeros(256, np.int64)
    rise[0x5F:0x90], rise[0x50] = 1, -1
    sizes, data, begins, step, at, row = sweep(codes)
    op, pcs = data[at], at - begins[row]
    starts = np.searchsorted(row, np.arange(len(begins)))
    new = op == 0x5B
    new[1:] |= closing[op[:-1]] | (row[1:] != row[:-1])
    new[:1] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    own, inside = row[first], np.cumsum(new) - 1
    node = np.arange(len(first)) - np.searchsorted(own, np.arange(len(begins)))[own] + 2
    delta = rise[op]
    total = np.cumsum(delta)
    total -= (total[first] - delta[first])[inside]
    apart = inside * (len(at) + 1)  # lower in each block than in all before, so that lows do not pass on
    low = np.minimum.accumulate(np.minimum(total, 0) - apart) + apart
    deepest = np.maximum.reduceat(np.where(delta > 0, total - low, 0), first) if len(first) else np.zeros(0, np.int64)

    jumps = np.flatnonzero((op[last] == 0x56) | (op[last] == 0x57))
    value, form = jump_values(last[jumps], data, at, step, pcs, starts[own[jumps]])
    wide = int(sizes.max(initial=0)) + 1
    key, sought = own * wide + pcs[first], own[jumps] * wide + value
    hit = np.minimum(np.searchsorted(key, sought), max(len(key) - 1, 0))
    known = (value >= 0) & (value < wide) & (key[hit] == sought)
    target = np.full(len(first), -1)
    target[jumps[known]] = node[hit[known]]
    end = op[last]
    kind = np.select([(end == 0x56) & (target < 0) | (end == 0x57) & (target < 0), end == 0x56, end == 0x57, closing[end]], [0, 1, 2, 3], 4)
    ringed = np.flatnonzero((sizes == 0) | (np.bincount(row, minlength=len(sizes)) > 0))
    return Blocks(sizes, data, at, op, pcs, starts, ringed, own, node, first, last, inside, deepest, kind, target, jumps, form, value)


def code_blocks(codes: DataFrame, id_col: str = "code_id", code_col: str = "code", details: bool = False) -> DataFrame:
    """Blocks with control, as ``with_control`` gives them, from the codes in one pass: a batch has whole codes, so nothing is shuffled or written between.

    Null and empty codes have an entry and an exit; a code that is one cut-off PUSH has neither. Rows of one id are
    codes of their own, each with its own blocks.

    ``details`` adds to body blocks their operations in order, the first PUSH4's immediate (key), whether they store (writes)
    or take value (value), and of a jump at their end its idx, form and the number it goes to (as ``resolve_targets`` has them).
    """
    names = pa.array(mnemonics())

    def build(ids: pa.Array, codes: pa.Array) -> pa.RecordBatch:
        b = blocks_of(codes)
        first, last, op = b.first, b.last, b.op
        twice = np.repeat(b.ringed, 2)
        blank = lambda kind: pa.nulls(len(twice), kind)
        zero = pa.array(np.zeros(len(twice), np.int32))
        number = lambda x: pa.array(x.astype(np.int32))
        body = [
            ids.take(pa.array(b.own)), number(b.node), pa.array(["Body"] * len(first), pa.string()), number(b.pcs[first]), number(b.pcs[last]), number(last - first + 1), number(b.deepest), names.take(pa.array(op[last].astype(np.int64))),
            names.take(pa.array(op[first].astype(np.int64))), pa.array(TAGS).take(pa.array(b.kind)), pa.array(b.target.astype(np.int32), mask=b.target < 0),
        ]
        rim = [ids.take(pa.array(twice)), number(np.tile([0, 1], len(b.ringed))), pa.array(["Entry", "Exit"] * len(b.ringed), pa.string()), blank(pa.int32()), blank(pa.int32()), zero, zero, blank(pa.string()), blank(pa.string()), blank(pa.string()), blank(pa.int32())]
        if details:
            push4 = np.flatnonzero(op == 0x63)
            of, one = np.unique(b.inside[push4], return_index=True)
            keys = np.full(len(first), None, object)
            keys[of] = [b.data[k + 1 : k + 5].tobytes().hex() for k in b.at[push4[one]].tolist()]
            has = lambda k: pa.array(np.bincount(b.inside[op == k], minlength=len(first)) > 0)
            idx, kind_of, goes = np.full(len(first), -1), np.full(len(first), 3), np.full(len(first), -1)
            idx[b.jumps], kind_of[b.jumps], goes[b.jumps] = last[b.jumps] - b.starts[b.own[b.jumps]], b.form, b.value
            listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(op)).astype(np.int32)), names.take(pa.array(op.astype(np.int64))))
            body += [listed, pa.array(keys, pa.string()), has(0x55), has(0x34), pa.array(idx.astype(np.int32), mask=idx < 0), pa.array(FORMS).take(pa.array(kind_of)), pa.array(goes, mask=goes < 0)]
            rim += [blank(x.type) for x in body[len(rim) :]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(rim, body, strict=True)], names=columns + more)

    more = ["operations", "key", "writes", "value", "jump_idx", "jump_form", "jump_value"] if details else []
    columns = ["code_id", "node", "kind", "start_pc", "end_pc", "n_instr", "max_stack", "last_op", "first_op", "tag", "target"]
    flat = in_slices(codes, build, "code_id long, node int, kind string, start_pc int, end_pc int, n_instr int, max_stack int, last_op string, first_op string, tag string, target int" + (DETAILS if details else ""), id_col, code_col)
    return flat.select(*columns[:-2], F.struct("tag", "target").alias("control"), *more)


DETAILS = ", operations array<string>, key string, writes boolean, value boolean, jump_idx int, jump_form string, jump_value long"


def locate_sections(codes: DataFrame, instr: DataFrame, runtime: DataFrame | None = None) -> DataFrame:
    """code_id, kind (Init, ConstructorArgs, Runtime, Padding, Auxdata), offset, len.

    Boundaries come one after the other, each from those before:

    - Auxdata: the last two bytes may announce a trailer; if it covers all, there is nothing else.
    - The split of a known ``runtime`` (code_id, runtime) of 20 bytes or more: the first place of its first 20 bytes,
      if all of it stands there.
    - Without that (or at place 0), and with more than 100 bytes before the trailer: the first CODECOPY with a RETURN within
      20 rows ends Init behind the RETURN; the runtime begins at the last number pushed in the 10 rows before
      that is beyond it, else there. Else, with any CODECOPY, the runtime begins at the first CALLDATASIZE, or the opening
      ``PUSH1 80, PUSH1 40, MSTORE, PUSH1 04`` before it, beyond byte 100.
    - ConstructorArgs: a gap of 4 bytes or more between Init and the runtime; a smaller one joins Init.
    - Padding, where there are no such arguments: behind the last ending before the trailer, STOPs at the end apart. It cuts a
      runtime in which it begins.

    Sections that overlap or leave a gap are given as they are; ``checked_sections`` tells. All by windows over the rows of one
    code and expressions over one row of each code; the runtime is looked up as bytes of the same row.
    """
    offset, length = trailer_bounds(F.col("code"))
    size = F.length("code")
    base = codes.select("code_id", "code", size.alias("size"), F.coalesce(offset, size).alias("aux"))
    op, w = F.col("mnemonic"), Window.partitionBy("code_id").orderBy("idx")
    number = F.when(op.startswith("PUSH") & (F.length(F.ltrim("imm", F.lit("0"))) <= 5), F.conv(F.when(F.length("imm") > 0, F.col("imm")), 16, 10).cast("int"))
    opening = (F.lag("mnemonic", 4).over(w) == "PUSH1") & (F.lag("imm", 4).over(w) == "80") & (F.lag("mnemonic", 3).over(w) == "PUSH1") & (F.lag("imm", 3).over(w) == "40")
    opening = opening & (F.lag("mnemonic", 2).over(w) == "MSTORE") & (F.lag("mnemonic", 1).over(w) == "PUSH1") & (F.lag("imm", 1).over(w) == "04")
    near = w.rowsBetween(0, 19)
    marks = instr.filter("idx is not null").select(
        "code_id", "idx", "pc", "mnemonic",
        F.min(F.when(op == "RETURN", F.col("pc"))).over(near).alias("returns"),
        F.collect_list(number).over(w.rowsBetween(-10, -1)).alias("numbers"),  # ten at most
        F.when(op == "CALLDATASIZE", F.when(opening, F.lag("pc", 4).over(w)).otherwise(F.col("pc"))).alias("call"),
    )
    marks = marks.join(base.select("code_id", "aux"), "code_id")
    inside = F.col("pc") < F.col("aux")
    found = marks.groupBy("code_id").agg(
        F.min_by(F.struct("returns", "numbers"), F.when(op == "CODECOPY", F.col("idx"))).alias("copy"),
        F.min_by("call", F.when((F.col("call") > 100) & (F.col("call") < F.col("aux")), F.col("idx"))).alias("call"),
        F.max(F.when(inside & (op != "STOP"), F.col("idx"))).alias("last"),
    )
    ends = marks.join(found.select("code_id", "last"), "code_id").filter((F.col("idx") <= F.col("last")) & is_terminal(op))
    found = found.withColumn("copied", F.col("copy.returns") + 1)
    beyond = F.filter("copy.numbers", lambda x: (x > F.col("copied")) & (x < 100_000))
    found = found.select("code_id", F.col("copy").isNotNull().alias("copies"), "copied", F.coalesce(F.try_element_at(beyond, F.lit(-1)), "copied").alias("pushed"), "call")
    rows = base.join(found, "code_id", "left").join(ends.groupBy("code_id").agg((F.max("pc") + 1).alias("pad")), "code_id", "left")
    rows = rows.join(runtime.select("code_id", "runtime"), "code_id", "left") if runtime is not None else rows.withColumn("runtime", F.lit(None).cast("binary"))
    known, known_len = known_runtime()
    parts = section_parts(rows.withColumn("known", known).withColumn("known_len", known_len))
    return parts.select("code_id", F.inline("parts"))


def known_runtime() -> tuple[Column, Column]:
    """Where in ``code`` its ``runtime`` of 20 bytes or more stands, and its length; null if it does not. Bytes are taken as characters of one byte each."""
    place = F.expr("locate(decode(substring(runtime, 1, 20), 'ISO-8859-1'), decode(code, 'ISO-8859-1')) - 1")
    whole = (F.length("runtime") >= 20) & (place >= 0) & (F.substring(F.col("code"), place + 1, F.length("runtime")) == F.col("runtime"))
    return F.when(whole, place).cast("int"), F.when(whole, F.length("runtime")).cast("int")


def section_parts(rows: DataFrame) -> DataFrame:
    """code_id, size, parts (kind, offset, len) from a row of each code: size, aux, known, known_len; whether it ``copies``, where what it copies ends (copied) and what it pushed beyond (pushed), call, pad."""
    pushed = F.col("pushed")
    split = F.struct(F.col("copied").cast("int").alias("init"), pushed.cast("int").alias("run"))
    called = F.struct(F.col("call").cast("int").alias("init"), F.col("call").cast("int").alias("run"))
    guessed = F.when(F.col("aux") > 100, F.when(pushed < F.col("aux"), split).when(F.col("copies") & F.col("call").isNotNull(), called))
    none = F.struct(F.lit(0).alias("init"), F.lit(0).alias("run"))
    # a known runtime behind the start has Init end one byte before it, a gap that joins Init again
    at = F.when(F.col("known") > 0, F.struct((F.col("known") - 1).alias("init"), F.col("known").alias("run"))).otherwise(F.coalesce(guessed, none))
    rows = rows.withColumn("at", at).withColumn("init", F.when((F.col("at.init") == 0) & (F.col("at.run") > 0), F.col("at.run")).otherwise(F.col("at.init"))).withColumn("run", F.col("at.run"))
    full = F.when(F.col("known").isNotNull() & (F.col("known") == F.col("run")), F.col("known_len")).otherwise(F.col("aux") - F.col("run"))
    rows = rows.withColumn("len", F.greatest(F.least(full, F.col("aux") - F.col("run")), F.lit(0)))
    gap = F.col("run") - F.col("init")
    rows = rows.withColumn("args", (F.col("run") < F.col("aux")) & (gap >= 4)).withColumn("head", F.when((gap > 0) & (gap < 4), F.col("run")).otherwise(F.col("init")))
    alone = (F.col("head") == 0) & (F.col("run") == 0)
    padded = ~F.col("args") & (F.col("pad") < F.col("aux"))
    rows = rows.withColumn("len", F.when(alone, F.col("aux")).otherwise(F.col("len"))).withColumn("padded", F.coalesce(padded, F.lit(False)))
    cut = F.col("padded") & (F.col("pad") >= F.col("run")) & (F.col("pad") < F.col("run") + F.col("len"))
    part = lambda kind, begin, n, when: F.when(when & (F.col("aux") > 0), F.struct(F.lit(kind).alias("kind"), begin.cast("int").alias("offset"), n.cast("int").alias("len")))
    parts = F.array(
        part("Init", F.lit(0), F.col("head"), F.col("head") > 0),
        part("ConstructorArgs", F.col("init"), gap, F.col("args")),
        part("Runtime", F.col("run"), F.when(cut, F.col("pad") - F.col("run")).otherwise(F.col("len")), (F.col("len") > 0) & (F.col("run") < F.col("aux"))),
        part("Padding", F.col("pad"), F.col("aux") - F.col("pad"), F.col("padded")),
        F.when(F.col("aux") < F.col("size"), F.struct(F.lit("Auxdata").alias("kind"), F.col("aux").cast("int").alias("offset"), (F.col("size") - F.col("aux")).cast("int").alias("len"))),
    )
    return rows.select("code_id", "size", F.filter(F.array_compact(parts), lambda p: p["len"] > 0).alias("parts"))


def checked_sections(codes: DataFrame, instr: DataFrame, runtime: DataFrame | None = None) -> DataFrame:
    """U3 with its check (W8): the sections, and for each code the first fault of their order and cover, ``ok`` if there is none."""
    found = locate_sections(codes, instr, runtime)
    sized = found.join(codes.select("code_id", F.length("code").alias("size")), "code_id")
    status = validate_intervals(sized, ["code_id"], "offset", "len", "size").select("code_id", "status")
    return found.join(status, "code_id")


def sections_of_codes(codes: DataFrame) -> DataFrame:
    """``checked_sections`` of codes (code_id, code, runtime, which may be null) and their own instructions in one pass: a batch has whole codes, so nothing is shuffled or written between."""
    terminal = np.zeros(256, bool)
    terminal[[0x00, 0xF3, 0xFD, 0xFE, 0xFF]] = True

    def marks(ids: pa.Array, codes: pa.Array, size: pa.Array, aux: pa.Array, known: pa.Array, known_len: pa.Array) -> pa.RecordBatch:
        _, data, begins, step, at, row = sweep(codes)
        op, pcs, n = data[at], at - begins[row], len(begins)
        first_of = np.searchsorted(row, np.arange(n))
        bound = pc.fill_null(aux, 0).to_numpy().astype(np.int64)

        # the first CODECOPY, the RETURN within 20 rows, and the last number pushed in the 10 rows before that is beyond it
        copy = np.flatnonzero(op == 0x39)
        copying, which = np.unique(row[copy], return_index=True)
        copy = copy[which]
        returns = np.append(np.flatnonzero(op == 0xF3), len(op))
        end = returns[np.searchsorted(returns, copy)]
        near = (end < len(op)) & (end - copy <= 19)
        near[near] = row[end[near]] == copying[near]
        copied = np.full(n, -1)
        copied[copying[near]] = pcs[end[near]] + 1
        pushed = copied.copy()
        for k in range(10, 0, -1):  # the nearest one comes last
            j = np.maximum(copy - k, 0)
            place, value = at[j], np.zeros(len(j), np.int64)
            for b in range(1, 33):
                value = np.where(step[place] > b, np.minimum(value * 256 + data[np.minimum(place + b, len(data) - 1)], 1 << 40), value)
            fits = near & (copy - k >= first_of[copying]) & (step[place] > 1) & (value > copied[copying]) & (value < 100_000)
            pushed[copying[fits]] = value[fits]

        # the first CALLDATASIZE, or the opening before it, beyond byte 100 and before the trailer
        ask = np.flatnonzero(op == 0x36)
        back = np.maximum(ask - 4, 0)
        opening = ask - 4 >= first_of[row[ask]]
        for k, code, byte in ((0, 0x60, 0x80), (1, 0x60, 0x40), (2, 0x52, None), (3, 0x60, 0x04)):
            j = np.minimum(back + k, max(len(op) - 1, 0))
            opening &= op[j] == code
            if byte is not None:
                opening &= data[np.minimum(at[j] + 1, len(data) - 1)] == byte
        calls = np.where(opening, pcs[back], pcs[ask])
        good = (calls > 100) & (calls < bound[row[ask]])
        call = np.full(n, -1)
        calling, which = np.unique(row[ask][good], return_index=True)
        call[calling] = calls[good][which]

        # behind the last ending before the trailer, STOPs at the end apart
        last = np.full(n, -1)
        solid = np.flatnonzero((pcs < bound[row]) & (op != 0))
        last[row[solid]] = solid
        ends = np.flatnonzero(terminal[op] & (np.arange(len(op)) <= last[row]))
        pad = np.full(n, -1)
        pad[row[ends]] = pcs[ends] + 1

        copies = np.zeros(n, bool)
        copies[copying] = True
        some = lambda x: pa.array(x.astype(np.int32), mask=x < 0)
        return pa.RecordBatch.from_arrays([ids, size, aux, known, known_len, pa.array(copies), some(copied), some(pushed), some(call), some(pad)], names=["code_id", *given, "copies", "copied", "pushed", "call", "pad"])

    given = ["size", "aux", "known", "known_len"]
    size, (known, known_len) = F.length("code"), known_runtime()
    base = codes.select("code_id", "code", size.alias("size"), F.coalesce(trailer_bounds(F.col("code"))[0], size).cast("int").alias("aux"), known.alias("known"), known_len.alias("known_len"))
    rows = in_slices(base, marks, "code_id long, size int, aux int, known int, known_len int, copies boolean, copied int, pushed int, call int, pad int", "code_id", "code", given)
    found = section_parts(rows).withColumn("ordered", F.array_sort(F.transform("parts", lambda p: F.struct(p["offset"].alias("at"), p["len"].alias("len")))))
    end = lambda p: p["at"] + p["len"]
    before = lambda k: F.coalesce(end(F.get("ordered", k - 1)), F.lit(0))
    fault = F.transform("ordered", lambda p, k: F.when(p["at"] < before(k), "overlap").when(p["at"] > before(k), "gap").when(end(p) > F.col("size"), "out of bounds"))
    status = F.coalesce(F.get(F.array_compact(fault), F.lit(0)), F.when(end(F.element_at("ordered", -1)) != F.col("size"), "final gap"), F.lit("ok"))
    return found.filter("size(parts) > 0").select("code_id", F.inline("parts"), status.alias("status")).select("code_id", "kind", "offset", "len", "status")


def selector_table(instr: DataFrame, limit: int = 200, reach: int = 500) -> DataFrame:
    """U4: code_id, selector, target, instr_index for ``PUSH4 k, EQ, PUSH t, JUMPI`` behind a dispatcher's opening.

    The opening (PUSH1 0, CALLDATALOAD, PUSH1 224, SHR, or its last three rows) begins within the first
    ``limit`` rows; keys are taken from the ``reach`` rows behind it, up to the first REVERT after three keys. A target of more
    than 60 bits, which no code has, and one of PUSH0 is null.
    """
    from gritstone.operators.sequences import first_match_in_prefix

    op, imm = F.col("mnemonic"), F.col("imm")
    tail = [op == "CALLDATALOAD", (op == "PUSH1") & (imm == "e0"), op == "SHR"]
    rows = instr.filter(F.col("idx") < limit + reach + 8)  # an opening of 4 rows, its keys, and the 3 rows behind a key
    opening = first_match_in_prefix(rows, ["code_id"], ["idx"], [tail, [op.startswith("PUSH"), *tail]], limit).select("code_id", "at")
    w = Window.partitionBy("code_id").orderBy("idx")
    lead = lambda c, k: F.lead(c, k).over(w)
    is_key = (op == "PUSH4") & F.coalesce(lead("mnemonic", 1) == "EQ", F.lit(False)) & F.coalesce(lead("mnemonic", 2).startswith("PUSH"), F.lit(False)) & F.coalesce(lead("mnemonic", 3) == "JUMPI", F.lit(False))
    near = rows.withColumn("_key", is_key).withColumn("_target", lead("imm", 2)).join(opening, "code_id").filter((F.col("idx") >= F.col("at")) & (F.col("idx") < F.col("at") + reach))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_keys", F.coalesce(F.sum(F.col("_key").cast("int")).over(before), F.lit(0))).withColumn("_stop", F.coalesce(F.max((op == "REVERT") & (F.col("_keys") >= 3)).over(before), F.lit(False)))
    digits = F.ltrim("_target", F.lit("0"))
    target = F.when(digits == "", F.lit("0")).when(F.length(digits) <= 15, F.conv(digits, 16, 10)).cast("long")  # null beyond 60 bits
    return near.filter("_key and not _stop").select("code_id", F.col("imm").alias("selector"), target.alias("target"), F.col("idx").alias("instr_index"))


def storage_access(instr: DataFrame) -> DataFrame:
    """code_id, idx, mnemonic, slot, width, unresolved for every SLOAD and SSTORE; slot is the literal pushed directly before, PUSH0 has width 0."""
    w = Window.partitionBy("code_id").orderBy("idx")
    op, imm = F.lag("mnemonic").over(w), F.lag("imm").over(w)
    slot = F.when(op == "PUSH0", "").when(op.startswith("PUSH"), imm)
    rows = instr.filter("idx is not null").withColumn("slot", slot).filter(F.col("mnemonic").isin("SLOAD", "SSTORE"))
    return rows.select("code_id", "idx", "mnemonic", "slot", (F.length("slot") / 2).cast("int").alias("width"), (F.col("slot").isNull() & (F.col("mnemonic") == "SSTORE")).alias("unresolved"))


def literal_texts(writes: DataFrame, by: str = "code_id") -> DataFrame:
    """U8: texts written to memory in words: by, length, text from (by, offset, word): 0x20 at offset 4, the length at 0x24, data from 0x44 on."""
    number = F.conv(F.substring("word", -8, 8), 16, 10).cast("long")
    head = writes.groupBy(by).agg(F.max(F.when(F.col("offset") == 4, number)).alias("_mark"), F.max(F.when(F.col("offset") == 0x24, number)).alias("length")).filter("_mark = 32 and length is not null")
    body = writes.filter("offset >= 68").join(head, by).filter((F.col("offset") - 68) % 32 == 0).filter(F.col("offset") < 68 + F.ceil(F.col("length") / 32) * 32)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "word"))), lambda x: x["word"]), "")
    one = body.groupBy(by, "length").agg(words.alias("_hex"), F.count("*").alias("_n")).filter(F.col("_n") == F.ceil(F.col("length") / 32))
    return one.select(by, "length", F.decode(F.unhex(F.substring("_hex", F.lit(1), (F.col("length") * 2).cast("int"))), "UTF-8").alias("text"))


def pushed_texts(rows: DataFrame) -> DataFrame:
    """U8's other form: code_id, node, idx, length, text of literals of 16 bytes and more in blocks that have the error selector.

    rows: instructions with their node. The selector is pushed as it is, or as 461bcd shifted by e5; what is likely text
    (P3) counts, without the zero bytes at its end.
    """
    w = Window.partitionBy("code_id", "node")
    order = w.orderBy("idx")
    shifted = (F.col("imm") == "461bcd") & (F.lead("imm").over(order) == "e5") & (F.lead("mnemonic", 2).over(order) == "SHL")
    marked = rows.withColumn("_mark", F.coalesce((F.col("imm") == "08c379a0") | shifted, F.lit(False)))
    marked = marked.withColumn("_error", F.max("_mark").over(w)).filter(F.col("_error") & (F.length("imm") >= 32))
    digits = F.regexp_replace("imm", "(00)+$", "")
    found = marked.withColumn("_digits", F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))
    text = found.withColumn("text", F.try_validate_utf8(F.unhex("_digits").cast("string")))
    return text.filter(F.col("text").isNotNull() & is_likely_text(F.col("text"))).select("code_id", "node", "idx", F.octet_length("text").alias("length"), "text")


def replace_spans(codes: DataFrame, spans: DataFrame, by: str = "code_id") -> DataFrame:
    """U9 with changed lengths: by, code (hex digits), ok.

    spans: by, offset, len (bytes of the code that go) and data (hex digits in their place). What lies between the
    spans stays. Spans that overlap or leave the code make it null, and ok false; codes without spans stay as they are.
    """
    order = Window.partitionBy(by).orderBy("offset", "len")
    end = F.col("offset") + F.col("len")
    placed = spans.withColumn("_prior", F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lists = placed.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("offset", "len", "_prior", "data"))).alias("_spans"), F.max(end).alias("_end"), F.bool_and((F.col("offset") >= F.col("_prior")) & (F.col("len") >= 0)).alias("_apart")
    )  # the spans of one code
    both = codes.select(by, F.lower(F.hex("code")).alias("_h")).join(lists, by, "left")
    cut = lambda a, n: F.substring("_h", (2 * a + 1).cast("int"), (2 * n).cast("int"))
    woven = F.array_join(F.transform("_spans", lambda x: F.concat(cut(x["_prior"], x["offset"] - x["_prior"]), x["data"])), "")
    rest = cut(F.col("_end"), F.length("_h") / 2 - F.col("_end"))
    ok = F.col("_spans").isNull() | (F.col("_apart") & (2 * F.col("_end") <= F.length("_h")))
    return both.select(by, F.when(F.col("_spans").isNull(), F.col("_h")).when(ok, F.concat(woven, rest)).alias("code"), ok.alias("ok"))


def decoded_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The instructions of each code as one list, about 1 MB of codes (one at least) at a time; none for null and empty codes."""
    for codes in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < len(codes):
            stop = max(row + 1, int(np.searchsorted(size, (int(size[row - 1]) if row else 0) + SLICE, "right")))
            rows = decoded(pa.array(np.arange(stop - row)), codes.slice(row, stop - row))
            rows = rows.filter(pc.is_valid(rows["idx"]))
            ends = np.searchsorted(rows["code_id"].to_numpy(), np.arange(stop - row + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([rows[n].cast(pa.int32()) if n == "opcode" else rows[n] for n in SCHEMA.names[1:]], SCHEMA.names[1:]))
            row = stop


class Decode:
    """X4 for a name that Spark has itself, one row at a time."""

    def eval(self, code: bytes):
        for rows in decoded_lists(iter([pa.array([code], pa.binary())])):
            yield from (tuple(x.values()) for x in rows[0].as_py())


def register_decode(spark: SparkSession, name: str = "decode") -> None:
    """Makes ``name`` a table function of SQL, of one code: ``select * from decode(unhex('6001'))``.

    Its rows come from Arrow batches of many codes (``name``_rows). SQL cannot define a name that Spark has itself, such as
    ``decode``; that one is a Python table function, some times slower on many codes.
    """
    fields = "idx int, pc int, opcode int, mnemonic string, imm string, size int"
    spark.udf.register(f"{name}_rows", F.arrow_udf(decoded_lists, f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"))
    try:
        spark.sql(f"create or replace temporary function {name}(code binary) returns table({fields}) return select * from inline({name}_rows(code))")
    except AnalysisException:
        spark.udtf.register(name, F.udtf(Decode, returnType=fields))


def reassemble(spans: DataFrame, by: str = "code_id", offset: str = "offset", data: str = "data") -> DataFrame:
    """Spans of hex digits put back in the order of their offsets."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(offset).alias("o"), F.col(data).alias("d")))), lambda x: x["d"]), "")
    return spans.groupBy(by).agg(joined.alias("code"))
