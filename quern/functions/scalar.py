"""Scalar functions with the dialect's semantics, as Columns that stay inside Catalyst.

Where Spark already does what the dialect asks for (ANSI overflow checks, Kleene AND and OR, null-safe
equality) there is nothing here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT64_MAX = 2**63 - 1


def fail(state: str, message: str) -> Column:
    """Raise a SQLSTATE at run time, in the rows that reach it."""
    return F.raise_error(F.lit(f"[SQLSTATE={state}] {message}"))


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def int_div(a, b) -> Column:
    """Truncating integer division; 22012 for a zero divisor, 22003 for the smallest integer by -1."""
    return F.call_function("div", col(a), col(b))


def double_div(a, b) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN."""
    x, y = col(a).cast("double"), col(b).cast("double")
    special = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, special).otherwise(F.try_divide(x, y))


def int_mod(a, b) -> Column:
    """Remainder with the dividend's sign; 22012 for a zero divisor."""
    return col(a) % col(b)


def double_mod(a, b) -> Column:
    x, y = col(a).cast("double"), col(b).cast("double")
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, float("nan")).otherwise(x % F.nullif(y, F.lit(0.0)))


def plus_text(a, b) -> Column:
    """string + string: concatenation, null if either is."""
    return F.concat(col(a), col(b))


def xor(a, b) -> Column:
    return col(a) != col(b)


def to_bigint(c) -> Column:
    """Doubles are rounded half up (floor(x + 0.5)); NaN and infinities fail."""
    x = col(c)
    bad = F.isnan(x) | (F.abs(x) == float("inf")) | (x >= float(2**63)) | (x < float(-(2**63)))
    return F.when(bad, fail("22F3H", "no integer for this value").cast("long")).otherwise(F.floor(x + 0.5).cast("long"))


def to_int(c) -> Column:
    x = to_bigint(c)
    return F.when((x > 2**31 - 1) | (x < -(2**31)), fail("22F3H", "out of range of INTEGER").cast("int")).otherwise(x.cast("int"))


def text_to_bigint(c) -> Column:
    return F.trim(col(c)).cast("long")


def text_to_boolean(c) -> Column:
    """Only true, false, 1 and 0, in any case."""
    x = F.lower(F.trim(col(c)))
    return F.when(x.isNull(), F.lit(None).cast("boolean")).when(x.isin("true", "1"), True).when(x.isin("false", "0"), False).otherwise(fail("22F3H", "not a boolean").cast("boolean"))


def to_text(c, kind: str) -> Column:
    """Canonical text of a value of this SQL type."""
    return F.lower(col(c).cast("string")) if kind == "boolean" else col(c).cast("string")


def _all_or_null(cs, value: Column) -> Column:
    nothing = F.lit(False)
    for c in cs:
        nothing = nothing | col(c).isNull()
    return F.when(~nothing, value)


def greatest(*cs) -> Column:
    """Null if any argument is."""
    return _all_or_null(cs, F.greatest(*map(col, cs)))


def least(*cs) -> Column:
    return _all_or_null(cs, F.least(*map(col, cs)))


def concat(*cs) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *[col(c).cast("string") for c in cs])


def replace(s, old, new) -> Column:
    """A null replacement is the empty string."""
    return F.replace(col(s), col(old), F.coalesce(col(new), F.lit("")))


def sqrt(c) -> Column:
    x = col(c).cast("double")
    return F.when(x < 0, fail("22023", "square root of a negative number").cast("double")).otherwise(F.sqrt(x))


def floor(c) -> Column:
    return F.floor(col(c)).cast("double")


def ceil(c) -> Column:
    return F.ceil(col(c)).cast("double")


def log(base, x) -> Column:
    return F.ln(col(x).cast("double")) / F.ln(col(base).cast("double"))


def like(s, pattern: str, escape: str | None = None) -> Column:
    """% and _ only; no escape unless one is named; every other character is literal."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            if i == len(pattern):
                return fail("22023", "the pattern ends in its escape").cast("boolean")
            out.append("\\" + pattern[i] if pattern[i] in "%_\\" else pattern[i])
        else:
            out.append("\\\\" if c == "\\" else c)
        i += 1
    return col(s).like("".join(out))


def between(x, low, high) -> Column:
    return (col(x) >= col(low)) & (col(x) <= col(high))


def is_distinct(a, b) -> Column:
    return ~col(a).eqNullSafe(col(b))


def subscript(array, at) -> Column:
    """1-based; null outside."""
    return F.try_element_at(col(array), col(at))


def first_or_default(array, default) -> Column:
    return F.coalesce(F.try_element_at(col(array), F.lit(1)), default if isinstance(default, Column) else F.lit(default))


def condition_selector(*conditions) -> Column:
    """The 0-based number of the first condition that is true, else null."""
    out = F.when(col(conditions[0]), F.lit(0))
    for k, c in enumerate(conditions[1:], 1):
        out = out.when(col(c), F.lit(k))
    return out


def pick(selector, *values) -> Column:
    """The value with that 0-based number, else null."""
    out = F.when(col(selector) == 0, col(values[0]))
    for k, v in enumerate(values[1:], 1):
        out = out.when(col(selector) == k, col(v))
    return out


def ordered_bytes(c, descending: bool = False, nulls_last: bool = False) -> Column:
    """A sort key: binary order of the result is the wanted order of signed 64-bit integers."""
    flipped = F.unhex(F.lpad(F.hex(col(c).cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    if descending:
        flipped = F.unhex(F.lpad(F.hex(F.bitwise_not(col(c).cast("long").bitwiseXOR(F.lit(-(2**63))))), 16, "0"))
    return F.concat(F.when(col(c).isNull(), F.lit(bytearray([2 if nulls_last else 0]))).otherwise(F.lit(bytearray([1]))), F.coalesce(flipped, F.lit(bytearray())))


def from_ordered_bytes(c, descending: bool = False) -> Column:
    """The integer of a sort key."""
    # conv() reads the 16 digits as an unsigned number, whose upper half wraps around to negative integers
    unsigned = F.conv(F.hex(F.substring(col(c), 2, 8)), 16, -10).cast("long")
    back = F.bitwise_not(unsigned) if descending else unsigned
    return F.when(F.octet_length(col(c)) > 1, back.bitwiseXOR(F.lit(-(2**63))))


def uuid_text(c) -> Column:
    """Canonical lower-case form; anything else fails."""
    x = F.lower(F.trim(col(c)))
    ok = x.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(x.isNull(), F.lit(None).cast("string")).when(ok, x).otherwise(fail("22F3H", "not a UUID"))
