"""Column expressions: predicates, costs, hex and byte helpers. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Program endings and, with the jumps, block endings.
TERMINAL = ("STOP", "RETURN", "REVERT", "SELFDESTRUCT", "INVALID")
BLOCK_ENDING = (*TERMINAL, "JUMP", "JUMPI")


def is_terminal(op: Column, names: Iterable[str] = TERMINAL) -> Column:
    """P1."""
    return op.isin(*names)


def is_block_ending(op: Column, names: Iterable[str] = BLOCK_ENDING) -> Column:
    """P1."""
    return op.isin(*names)


def normalize_hex(col: Column, strict: bool = True) -> Column:
    """Hex digits without white space and one 0x, left-padded to even length; null if not hex.

    strict=False is the command line's form: underscores go too, and an odd number of digits gives null.
    """
    digits = F.regexp_replace(F.regexp_replace(col, r"[\n\r \t]", ""), "^0x", "")
    if not strict:
        digits = F.regexp_replace(digits, "_", "")
    valid = digits.rlike("^[0-9a-fA-F]*$")
    odd = F.length(digits) % 2 == 1
    return F.when(valid & odd, F.concat(F.lit("0"), digits) if strict else F.lit(None)).when(valid, digits)


def rejected_hex(df: DataFrame, key: str, col: str, strict: bool = True) -> DataFrame:
    """S2's side table: key and value of the rows that are no hex digits."""
    return df.filter(F.col(col).isNotNull() & normalize_hex(F.col(col), strict).isNull()).select(key, F.col(col).alias("value"))


#: Fixed value: 2 to the power of 256.
WORD_RANGE = str(1 << 256)


def in_word_range(digits: Column) -> Column:
    """Whether decimal digits stand for a number from 0 to 2^256 - 1: by length, then by order."""
    body = F.regexp_replace(digits, "^0+(?=.)", "")
    size = F.length(body)
    return digits.rlike("^[0-9]+$") & ((size < len(WORD_RANGE)) | ((size == len(WORD_RANGE)) & (body < F.lit(WORD_RANGE))))


def is_likely_text(col: Column, min_len: int = 4, ratio: float = 0.6) -> Column:
    """Without trailing NULs, long enough and mostly printable ASCII; in bytes, compared as 32-bit floats."""
    body = F.regexp_replace(col, r"\x00+\z", "")  # $ also stands before a last line break
    size = F.octet_length(body)
    printable = F.length(F.regexp_replace(body, r"[^\x20-\x7E]", ""))
    # Spark divides doubles, so the quotient itself is rounded to 32 bits
    return (size >= min_len) & ((printable.cast("float") / size.cast("float")).cast("float") >= F.lit(ratio).cast("float"))


def payload_cost(zero: Column, other: Column) -> Column:
    """21000 and 4 for each zero byte, 16 for each other."""
    return F.lit(21000) + 4 * zero + 16 * other


def zero_bytes(code: Column) -> Column:
    """Number of zero bytes of a binary column."""
    pairs = F.regexp_replace(F.hex(code), "(..)", "$1,")
    return F.regexp_count(pairs, F.lit("00,"))


def deploy_cost(n: Column) -> Column:
    """P5: 32000 and 200 for each byte."""
    return F.lit(32000) + 200 * n


def pct_increase(before: Column, after: Column) -> Column:
    """Percent from before to after, 0 where before is 0."""
    return F.when(before == 0, F.lit(0.0)).otherwise((after - before) / before * 100)


def potency(overlap: Column, nodes: Column, edges: Column) -> Column:
    """P7."""
    return 5 * F.log2(nodes) + edges + 30 * (1 - overlap)


def interpret(preservation: Column, diversity: Column) -> tuple[Column, Column]:
    """What preservation and diversity in percent mean."""
    kept = F.when(preservation < 10, "strong").when(preservation < 25, "moderate").otherwise("weak")
    varied = F.when(diversity > 90, "high").when(diversity > 70, "moderate").otherwise("low")
    return kept, varied


def classify_failure(message: Column) -> Column:
    """P10."""
    return F.when(message.contains("validation") | message.contains("invalid jump"), "Validation").otherwise("Obfuscation")


def block_type(last_op: Column, first_op: Column) -> Column:
    """P11; null on both sides is an empty block."""
    return F.when(last_op == "RETURN", "Return").when(last_op == "REVERT", "Error").when(last_op == "JUMP", "Jump").when(last_op == "JUMPI", "Branch").when(first_op == "JUMPDEST", "Entry").otherwise("Normal")


def parse_be(digits: Column) -> Column:
    """The number that big-endian hex digits stand for; null beyond 8 significant bytes."""
    body = F.regexp_replace(digits, "^0+", "")
    return F.when(F.length(body) <= 15, F.conv(F.concat(F.lit("0"), body), 16, 10).cast("long")).when(F.length(body) <= 16, F.conv(body, 16, 10).cast("decimal(20,0)").cast("string").try_cast("long"))


def format_be(value: Column, width: int) -> Column:
    """Lower-case hex of ``width`` bytes; null if it needs more."""
    digits = F.lower(F.hex(value))
    return F.when(F.length(digits) <= 2 * width, F.lpad(digits, 2 * width, "0"))


def trailer_bounds(code: Column) -> tuple[Column, Column]:
    """Offset and length of the trailer that the last two bytes announce; null if they announce too much."""
    size = F.length(code)
    n = F.conv(F.hex(F.substring(code, -2, 2)), 16, 10).cast("int")
    fits = (size >= 2) & (n <= size - 2)
    return F.when(fits, size - 2 - n), F.when(fits, n + 2)


def mask_literals(df: DataFrame, col: str, detector: str, seed: str, protected: Column | None = None) -> DataFrame:
    """Text that matches ``detector`` becomes hash digits of the same length; all else, and protected rows, stay."""
    parts = F.split(F.col(col), detector)
    hits = F.regexp_extract_all(F.col(col), F.lit(f"({detector})"))
    masked = F.transform(hits, lambda x: F.substring(F.repeat(F.sha2(F.concat(F.lit(seed), x), 256), F.ceil(F.length(x) / 64).cast("int")), F.lit(1), F.length(x)))
    woven = F.array_join(F.flatten(F.zip_with(parts, masked, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    return df.withColumn(col, woven if protected is None else F.when(protected, F.col(col)).otherwise(woven))


def instr_size(opcode: Column) -> Column:
    """1 byte, and n more for PUSHn (0x60 to 0x7f)."""
    return F.when((opcode >= 0x60) & (opcode <= 0x7F), opcode - 0x60 + 2).otherwise(F.lit(1))


def comparison(before: Column, after: Column, before_len: Column, after_len: Column) -> Column:
    """Gain of potency less a quarter of the growth in bytes."""
    return (after - before) - 0.25 * (after_len - before_len)


def seeded(domain: str, seed: str, key: Column) -> Column:
    """K1: hex digits of a hash of the domain, the seed (64 hex digits, 0x allowed) and a key."""
    body = seed.removeprefix("0x")
    if len(body) != 64 or any(c not in "0123456789abcdefABCDEF" for c in body):
        raise ValueError("a seed has 64 hex digits")
    return F.sha2(F.concat(F.lit(domain), F.lit(body.lower()), key.cast("string")), 256)


def seeded_int(domain: str, seed: str, key: Column) -> Column:
    """K1 as a number from 0 to 2^52 - 1, exact in doubles too."""
    return F.conv(F.substring(seeded(domain, seed, key), 1, 13), 16, 10).cast("long")


def windows_of(text: Column, n: int, block: int = 256) -> Column:
    """All windows of n characters of a text that has as many, in order; cut from blocks, as finding the i-th character of UTF-8 takes i steps."""
    blocks = F.transform(F.sequence(F.lit(0), ((F.length(text) - n) / block).cast("int")), lambda b: F.substring(text, b * block + 1, F.lit(block + n - 1)))
    return F.flatten(F.transform(blocks, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n)))))
