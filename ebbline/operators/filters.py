"""Filters over change logs: table patterns, GTID exclusion, row identity predicates and value checks.

All are column expressions or joins with small rule tables, so they fuse with the scan.
Errors are data: a check yields a violation code instead of an exception.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PATTERNS, MAX_PATTERN_BYTES = 128, 512


class PatternError(ValueError):
    """A table pattern that breaks the rules."""


def check_patterns(patterns: Sequence[str]) -> list[str]:
    """At most 128 patterns of at most 512 bytes, each ``database.table`` with one dot that no backslash escapes, none ending in an open escape."""
    if len(patterns) > MAX_PATTERNS:
        raise PatternError(f"more than {MAX_PATTERNS} patterns")
    for pattern in patterns:
        if not pattern or len(pattern.encode()) > MAX_PATTERN_BYTES:
            raise PatternError(f"empty or longer than {MAX_PATTERN_BYTES} bytes: {pattern!r}")
        dots, at = 0, 0
        while at < len(pattern):
            if pattern[at] == "\\":
                if at + 1 == len(pattern):
                    raise PatternError(f"open escape: {pattern!r}")
                at += 1
            elif pattern[at] == ".":
                dots += 1
            at += 1
        if dots != 1:
            raise PatternError(f"not database.table: {pattern!r}")
    return list(patterns)


def matches(name: Column, patterns: Sequence[str]) -> Column:
    """Whether name fits one of the patterns: % any run, _ one character, backslash the next character itself."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | name.like(_spark_like(pattern))
    return out


def _spark_like(pattern: str) -> str:
    """LIKE allows its escape before %, _ and itself only: other escaped characters stand for themselves."""
    out, at = [], 0
    while at < len(pattern):
        if pattern[at] == "\\" and at + 1 < len(pattern):
            at += 1
            out.append("\\" + pattern[at] if pattern[at] in "%_\\" else pattern[at])
        else:
            out.append(pattern[at])
        at += 1
    return "".join(out)


def ignored(database: Column, table: Column, include: Sequence[str] = (), ignore: Sequence[str] = (), lower_names: bool = False) -> Column:
    """An include match keeps; else an ignore match drops; else a table is dropped only if there are include patterns.

    A null table is the database itself and is matched as ``database.``.
    """
    include, ignore = check_patterns(include), check_patterns(ignore)
    name = F.concat(database, F.lit("."), F.coalesce(table, F.lit("")))
    if lower_names:
        name, include, ignore = F.lower(name), [p.lower() for p in include], [p.lower() for p in ignore]
    return ~matches(name, include) & (matches(name, ignore) | F.lit(bool(include)))


def ddl_scope(scoped: DataFrame, group: str, dropped: str) -> DataFrame:
    """Targets of statements with their ignored flag -> scope of each statement: included, ignored, or mixed (an error)."""
    return scoped.groupBy(group).agg(F.when(F.min(dropped) != F.max(dropped), "mixed").when(F.max(dropped), "ignored").otherwise("included").alias("scope"))


#: Bits of a digit by which numbers and intervals are cut; four digits make 64 bits.
DIGIT = 16


def interval_pieces(intervals: DataFrame, keys: list[str], level: int) -> DataFrame:
    """(keys, _parent, _from, _to): the parts of closed intervals (lo, hi) that are cut at this level.

    At level k a number counts by ``DIGIT * k`` bits fewer. The first and the last unit range of
    an interval that do not fill their parent are pieces; whole parents between them go
    to the next level. So an interval of any width has at most two pieces a level, each in one parent.
    """
    now = intervals.select(*keys, F.col("lo").cast("long").alias("_from"), F.col("hi").cast("long").alias("_to")).where("_from <= _to")
    up = lambda c, k=1: F.shiftright(F.col(c), DIGIT * k)
    for _ in range(level):
        now = now.select(*keys, (up("_from") + 1).alias("_from"), (up("_to") - 1).alias("_to")).where("_from <= _to")
    if level == 3:
        return now.select(*keys, F.lit(0).cast("long").alias("_parent"), "_from", "_to")
    first, last = up("_from"), up("_to")
    size = 1 << DIGIT
    one = F.array(F.struct(first.alias("p"), F.col("_from").alias("a"), F.col("_to").alias("b")))
    two = F.array(
        F.struct(first.alias("p"), F.col("_from").alias("a"), (first * size + (size - 1)).alias("b")),
        F.struct(last.alias("p"), (last * size).alias("a"), F.col("_to").alias("b")),
    )
    return now.select(*keys, F.explode(F.when(first == last, one).otherwise(two)).alias("_x")).select(*keys, F.col("_x.p").alias("_parent"), F.col("_x.a").alias("_from"), F.col("_x.b").alias("_to"))


def interval_levels(intervals: DataFrame) -> int:
    """Levels at which any of the intervals has pieces. The driver sees one number."""
    widest = intervals.agg(F.max(F.floor(F.log2((F.col("hi").cast("double") - F.col("lo").cast("double") + 2)))).alias("bits")).first()["bits"]
    return 0 if widest is None else min(4, int(widest) // DIGIT + 1)


def without_covered(rows: DataFrame, covered: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """rows whose seq (not null) no closed interval (keys, lo, hi) of covered holds; a null key is a key like any other.

    Intervals of any width to 2**63 - 1 are cut into pieces that lie in one parent range of numbers each, so
    each level is an equi-join on (keys, parent), and one source's intervals never meet in one task.
    """
    left = rows
    for level in range(interval_levels(covered)):
        pieces = interval_pieces(covered, keys, level)
        there = pieces.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_parent", "_from", "_to")
        number = F.col(seq).cast("long")
        parent = F.shiftright(number, DIGIT * (level + 1)) if level < 3 else F.lit(0).cast("long")
        on = (parent == F.col("_parent")) & F.shiftright(number, DIGIT * level).between(F.col("_from"), F.col("_to"))
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        left = left.join(there, on, "left_anti")
    return left


def after_boundary(file: Column, position: Column, start_file: str, start_position: int) -> Column:
    """Whether a coordinate is at or after the start; files compare by the number at their end."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    first = number(F.lit(start_file))
    return (number(file) > first) | ((number(file) == first) & (position >= start_position))


def same_row(pairs: Sequence[tuple[Column, Column, str]]) -> Column:
    """Full-row predicate over (left, right, kind): null is null, text and binary by bytes, floats with the sign of zero."""
    out = F.lit(True)
    for a, b, kind in pairs:
        if kind in ("float", "double"):
            same = a.eqNullSafe(b) & (a.cast("string").eqNullSafe(b.cast("string")))
        elif kind in ("text", "binary"):
            same = a.cast("binary").eqNullSafe(b.cast("binary"))
        else:
            same = a.eqNullSafe(b)
        out = out & same
    return out


def image_shape(op: Column, before: Column, after: Column) -> Column:
    """Whether the images fit the operation: no before image exactly for inserts, no after image exactly for deletes."""
    return (before.isNull() == (op == "insert")) & (after.isNull() == (op == "delete"))


#: kind -> (lowest, highest) of the integer types.
INTEGER_RANGES = {
    "tinyint": (-(2**7), 2**7 - 1),
    "smallint": (-(2**15), 2**15 - 1),
    "mediumint": (-(2**23), 2**23 - 1),
    "int": (-(2**31), 2**31 - 1),
    "bigint": (-(2**63), 2**63 - 1),
}


def violation(value: Column, kind: str, nullable: bool = True, unsigned: bool = False, length: int = 0, precision: int = 0, scale: int = 0, labels: int = 0) -> Column:
    """Code of the rule that a value breaks, or null.

    value: decimal or long for integers, years, bits, enums and sets; text for chars and decimals; binary for byte strings; double for floats.
    """
    null = F.when(value.isNull(), F.lit(None if nullable else "null")) if nullable else F.when(value.isNull(), F.lit("null"))
    if kind in INTEGER_RANGES:
        low, high = INTEGER_RANGES[kind]
        low, high = (0, 2 * high + 1) if unsigned else (low, high)
        return null.when(~value.cast("decimal(38,0)").between(F.lit(low).cast("decimal(38,0)") if abs(low) < 2**63 else F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), "range")
    if kind in ("char", "varchar", "text"):
        return null.when(F.char_length(value) > length, "length")
    if kind in ("binary", "varbinary", "blob"):
        return null.when(F.octet_length(value) > length, "length")
    if kind == "decimal":
        form = rf"^-?\d+(\.\d{{{scale}}})$" if scale else r"^-?\d+$"
        digits = F.length(F.regexp_extract(value, r"^-?0*(\d*)", 1))
        return null.when(~value.rlike(form), "format").when(digits > precision - scale, "range")
    if kind in ("float", "double"):
        return null.when(F.isnan(value) | (F.abs(value) == float("inf")), "finite")
    if kind == "year":
        return null.when(~((value == 0) | value.between(1901, 2155)), "range")
    if kind == "bit":
        return null.when((value < 0) | ((F.lit(length) < 63) & (value >= (1 << min(length, 62)))), "range")
    if kind == "enum":
        return null.when(~value.between(0, labels), "range")
    if kind == "set":
        return null.when((value < 0) | ((F.lit(labels) < 63) & (value >= (1 << min(labels, 62)))), "range")
    if kind == "time":
        return null.when(F.abs(value) > 3_020_399_000_000, "range")  # microseconds of 838:59:59
    if kind == "timestamp":
        return null.when(~value.between(0, 2**31 - 1), "range")
    raise ValueError(f"unknown kind {kind}")


#: Where an apply may skip an error: before any write, or after the group was rolled back.
SKIP_BOUNDARIES = ("before_writes", "rolled_back")

#: The error codes by their public names.
ERROR_CODES = ("ddl.unsupported_statement", "ddl.unsupported_column_type", "ddl.unsupported_alter", "ddl.unsupported_collation", "dml.multiple_statements", "dml.multiple_tables", "mysql.1062", "target.sql")
DUPLICATE_KEY, NEVER_SKIPPED = "mysql.1062", "target.sql"


class PolicyError(ValueError):
    """A policy that names what may not be allowed."""


def skip_rules(codes: Sequence[str]) -> list[tuple[str, str]]:
    """(code, boundary) at which each of the distinct codes may be skipped: a duplicate key after its rollback, any other before writes."""
    if len(set(codes)) != len(codes) or not set(codes) <= set(ERROR_CODES) or NEVER_SKIPPED in codes:
        raise PolicyError(f"codes must be distinct, known and not {NEVER_SKIPPED}: {list(codes)}")
    return [(c, "rolled_back" if c == DUPLICATE_KEY else "before_writes") for c in codes]


def split_skips(errors: DataFrame, codes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """errors(code, boundary, ...) -> (skipped, fatal) under a policy that names the codes; unknown codes and boundaries are fatal."""
    allowed = F.lit(False)
    for code, boundary in skip_rules(codes):
        allowed = allowed | ((F.col("code") == code) & (F.col("boundary") == boundary))
    allowed = F.coalesce(allowed, F.lit(False))
    return errors.where(allowed), errors.where(~allowed)


def skipped_by_code(skips: DataFrame, code: str = "code") -> DataFrame:
    """Skips of each code: (code, n)."""
    return skips.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))


_COMMENTS = r"(?s)\A(?:\s+|/\*(?![!M]).*?\*/|--[ \t][^\n]*(?:\n|\z)|#[^\n]*(?:\n|\z))*"
_QUALIFIER = r"(?:\s+(?:OR\s+REPLACE|DEFINER\s*=\s*(?:CURRENT_USER(?:\s*\(\s*\))?|(?:`(?:[^`]|``)*`|'(?:[^']|'')*'|[^\s@`']+)(?:\s*@\s*(?:`(?:[^`]|``)*`|'(?:[^']|'')*'|\S+))?)))*"
_NAME = r"(?:`(?:[^`]|``)+`|[\w$]+)(?:\s*\.\s*(?:`(?:[^`]|``)+`|[\w$]+))?"
_CLEANUP = rf"(?i)^DROP\s+TEMPORARY\s+TABLE\s+IF\s+EXISTS\s+{_NAME}(?:\s*,\s*{_NAME})*\s*(?:/\*.*\*/)?\s*;?\s*$"


def ddl_policy(sql: Column, triggers: str = "skip", cleanup: bool = False, failed: Column | None = None) -> Column:
    """What becomes of a statement: struct of action (apply, skip, reject or error) and reason.

    Triggers are skipped or rejected; events are always rejected, as their writes would be made
    without a log; with ``cleanup`` (sources that log it among row events) a plain DROP TEMPORARY TABLE IF EXISTS
    is skipped. failed: the statement failed at its source, so it may not be skipped. A null text is null.
    """
    if triggers not in ("skip", "reject"):
        raise PolicyError("triggers are skipped or rejected")
    failed = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    plain = F.rtrim(F.regexp_replace(F.regexp_replace(sql, _COMMENTS, ""), r"(?s)/\*![0-9]*\s*(.*?)\s*\*/", " $1 "))
    head = lambda kind: F.trim(plain).rlike(rf"(?is)^(?:CREATE{_QUALIFIER}|ALTER{_QUALIFIER}|DROP)\s+{kind}\b")
    answer = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason"))
    skipped = lambda reason: F.when(failed, answer("error", "a failed statement cannot be skipped")).otherwise(answer("skip", reason))
    out = F.when(sql.isNull(), F.lit(None)).when(head("EVENT"), answer("reject", "events"))
    out = out.when(head("TRIGGER"), answer("reject", "triggers") if triggers == "reject" else skipped("triggers"))
    if cleanup:
        out = out.when(F.trim(plain).rlike(_CLEANUP), skipped("temporary tables"))
    return out.otherwise(answer("apply", None))
