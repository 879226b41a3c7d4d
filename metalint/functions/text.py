"""Text scalars: folding, labels, guards, literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column | str) -> Column:
    """Case-folded key. `lower` differs from simple upper-casing for a handful of letters only."""
    return F.lower(F.col(c) if isinstance(c, str) else c)


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed and planned once, however often fn mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~c.rlike(r"\S"), F.lit(True))


def identity(typ: Column, tbl: Column, hierarchy: Column, obj: Column) -> Column:
    """One folded key for a field; a missing hierarchy equals an empty one."""
    return F.concat_ws(
        "\u001f", fold(typ), fold(tbl), fold(F.coalesce(hierarchy, F.lit(""))), fold(obj)
    )


def humanize(c: Column) -> Column:
    """`salesAmount_total` -> `Sales Amount total`."""
    spaced = F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")
    spaced = F.regexp_replace(F.regexp_replace(spaced, r"(^| )[_-]+", "$1"), r"[_-]+", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))


def guard_formula(c: Column) -> Column:
    """Prefix a quote when a spreadsheet would read the cell as a formula."""
    return F.when(
        F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r", "\n"), F.concat(F.lit("'"), c)
    ).otherwise(c)


def unquote_literal(c: Column) -> Column:
    """`'a''b'` -> `a'b`; anything not wrapped in single quotes is unchanged."""
    quoted = F.length(c).__ge__(2) & c.startswith("'") & c.endswith("'")
    inner = F.substr(c, F.lit(2), F.length(c) - 2)
    return F.when(quoted, F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(c)


def literal_number(c: Column) -> Column:
    """`12D`, `12L`, `12M` -> `12`, trailing zeros trimmed; null when the text is not a number."""
    digits = F.when(c.rlike(r"^\s*[+-]?\d.*[DLMdlm]$"), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    number = F.trim(digits).try_cast("decimal(38,18)")
    plain = number.cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(trimmed == "-0", F.lit("0")).otherwise(trimmed)


def is_hex_color(c: Column) -> Column:
    """`#rgb`, `#rrggbb` or `#rrggbbaa`."""
    return F.coalesce(c.rlike(r"^#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.lit(False))


def useful_label(c: Column) -> Column:
    """At least two letters or digits."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{Nd}]", "")
    return F.length(kept) >= 2


def join_distinct(arr: Column, sep: str = " | ") -> Column:
    """Non-blank values, one per folded spelling, sorted by the folded text."""
    kept = F.filter(arr, lambda v: v.rlike(r"\S"))
    pairs = F.array_sort(F.transform(kept, lambda v: F.struct(F.lower(v).alias("k"), v.alias("v"))))
    firsts = F.filter(
        pairs,
        lambda p, i: (i == 0) | (F.get(pairs, i - 1)["k"] != p["k"]),
    )
    return F.array_join(F.transform(firsts, lambda p: p["v"]), sep)
