"""Sequence validation and string functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import RESIDUES

_CANONICAL = f"^[{RESIDUES}]+$"
#: The characters of Unicode's property White_Space, which ``(?U)\\s`` matches.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def without_gaps(raw: Column) -> Column:
    """White space and hyphens removed, upper case."""
    return F.upper(F.regexp_replace(raw, r"(?U)[\s\-]+", ""))


def is_canonical(sequence: Column) -> Column:
    """Only the 20 canonical residues, one at least; null is false."""
    return F.coalesce(sequence.rlike(_CANONICAL), F.lit(False))


def invalid_symbols(sequence: Column) -> Column:
    """Symbols that are no residue, sorted, joined by a comma and a space."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(sequence, f"[{RESIDUES}]+", ""), ""))), ", ")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use names it: a variable of a lambda, where a column expression is put in everywhere."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_sequence(raw: Column, min_length: int = 5, max_length: int = 200) -> Column:
    """struct(sequence, error_code, error): the sequence, or why there is none.

    Checks in order: missing, empty, no_residues, invalid_symbol, too_short, too_long. One leading header line
    that starts with ``>`` is dropped. Null is ``missing``.
    """

    def checked(text: Column, sequence: Column) -> Column:
        n = F.length(sequence)
        return (
            F.when(text.isNull(), "missing")
            .when(text == "", "empty")
            .when(sequence == "", "no_residues")
            .when(~is_canonical(sequence), "invalid_symbol")
            .when(n < min_length, "too_short")
            .when(n > max_length, "too_long")
        )

    def result(sequence: Column, code: Column) -> Column:
        n = F.length(sequence)
        # The messages.
        error = (
            F.when(code == "missing", "Sequence is missing.")
            .when(code == "empty", "Sequence is empty.")
            .when(code == "no_residues", "No amino-acid residues were found.")
            .when(code == "invalid_symbol", F.concat(F.lit("Only the 20 canonical one-letter amino-acid codes are accepted. Invalid symbol(s): "), invalid_symbols(sequence), F.lit(".")))
            .when(code == "too_short", F.concat(F.lit("Sequence is too short ("), n, F.lit(f" aa); minimum is {min_length}.")))
            .when(code == "too_long", F.concat(F.lit("Sequence is too long ("), n, F.lit(f" aa); maximum is {max_length}.")))
        )
        return F.struct(F.when(code.isNull(), sequence).alias("sequence"), code.alias("error_code"), error.alias("error"))

    def of(text: Column) -> Column:
        rest = F.when(text.startswith(">"), F.regexp_replace(text, r"^[^\n\r]*(\r\n|[\n\r]|$)", "")).otherwise(text)
        return once(without_gaps(rest), lambda sequence: once(checked(text, sequence), lambda code: result(sequence, code)))

    return once(F.btrim(raw, F.lit(WHITE_SPACE)), of)


def parent_sequence(raw: Column) -> Column:
    """A parent protein cleaned of white space and hyphens; empty if anything else than residues is left."""
    return once(without_gaps(raw), lambda s: F.when(is_canonical(s), s).otherwise(""))


def sequence_sha256(sequence: Column) -> Column:
    return F.sha2(sequence, 256)


def fragment(parent: Column, start: Column, size: Column) -> Column:
    """``size`` residues from 0-based ``start``."""
    return F.substr(parent, start + 1, size)


def fragment_id(parent_id: Column, start: Column, size: Column) -> Column:
    """``parent:first-last``, 1-based and inclusive."""
    return F.concat(parent_id.cast("string"), F.lit(":"), (start + 1).cast("string"), F.lit("-"), (start + size).cast("string"))


def cluster_id(number: Column) -> Column:
    return F.format_string("cluster_%06d", number)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def status_title(status: Column) -> Column:
    """``real_data`` to ``Real Data``."""
    return F.initcap(F.replace(status, F.lit("_"), F.lit(" ")))


def utc_now() -> Column:
    """The current UTC time without microseconds. Not deterministic between runs."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def seeded_draw(key: Column, seed: int | str = "") -> Column:
    """A number in [0, 2^32) drawn from the key and a seed, equal in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long")
