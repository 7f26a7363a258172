"""Column expressions that models and operators share. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed value: what a null field counts as inside a surrogate key.
KEY_NULL = "_dbt_utils_surrogate_key_null_"


def col(c: str | Column) -> Column:
    """A column by name; names are quoted, so reserved words and dots are safe."""
    return F.col(quote(c)) if isinstance(c, str) else c


def quote(name: str) -> str:
    """An identifier in backticks, with inner backticks doubled."""
    return "`" + name.replace("`", "``") + "`"


def safe(c: str | Column, kind: str) -> Column:
    """Cast to ``kind``; what cannot be cast becomes null."""
    return col(c).try_cast(kind)


def surrogate_key(*fields: str | Column) -> Column:
    """MD5 of the fields as strings joined by '-', nulls by a placeholder."""
    return F.md5(F.concat_ws("-", *[F.coalesce(col(f).cast("string"), F.lit(KEY_NULL)) for f in fields]))


def incident_key(node: str | Column, kind: str | Column, column: str | Column) -> Column:
    """First 16 hex digits of SHA-256 over node|type|column (a null column counts as empty)."""
    return F.substring(F.sha2(F.concat_ws("|", col(node), col(kind), F.coalesce(col(column), F.lit(""))), 256), 1, 16)


def idempotency_key(key: str | Column, day: str | Column, action: str | Column) -> Column:
    return F.concat_ws(":", col(key), F.date_format(col(day), "yyyyMMdd"), col(action))


def hash_sampled(first: str | Column, share: float) -> Column:
    """True for about ``share`` of the rows, always the same ones: hash of the first column modulo 100."""
    return F.pmod(F.abs(F.hash(col(first)).cast("long")), F.lit(100)) < round(share * 100)  # the least int has no absolute value of its own kind


def clipped(text: str | Column, limit: int) -> Column:
    """The text, cut to ``limit`` characters with a closing ellipsis where it is longer."""
    return F.when(F.length(col(text)) > limit, F.concat(F.substring(col(text), 1, limit - 1), F.lit("…"))).otherwise(col(text))


def short_number(value: str | Column) -> Column:
    """Four significant digits without closing zeros: grouped, or with an exponent below 0.0001 and from 10,000 on; None for null."""
    number = col(value).cast("double")
    digits = F.format_string("%.3e", number)
    mantissa, power = F.substring_index(digits, "e", 1), F.substring_index(digits, "e", -1)
    exponent = power.cast("int")
    plain = F.regexp_replace(F.format_number(digits.cast("double"), 7), r"\.?0+$", "")  # rounded before: 7 decimals hold four digits from 0.0001 on
    short = F.concat(F.regexp_replace(mantissa, r"\.?0+$", ""), F.lit("e"), power)
    odd = F.when(number.isNull(), "None").when(F.isnan(number), "nan").when(F.abs(number) == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
    return F.coalesce(odd, F.when(number == 0, "0").when(exponent.between(-4, 3), plain).otherwise(short))


def canonical_id(*parts: str | Column) -> Column:
    """Identifier of a node or column: its parts joined by dots."""
    return F.concat_ws(".", *[col(p) for p in parts])


def source_name(raw: str | Column, groups: tuple[str, ...]) -> Column:
    """The source group that a raw table's name begins with (``group_...``); else the name's first part."""
    cases = [F.when(col(raw).startswith(f"{g}_"), F.lit(g)) for g in groups]
    return F.coalesce(*cases, F.substring_index(col(raw), "_", 1))


def layer_of(path: str | Column, name: str | Column) -> Column:
    """Layer from the directory list ``path``, else from the name's prefix, else null."""
    by_path = [F.when(F.array_contains(col(path), layer), layer) for layer in ("staging", "intermediate", "marts")]
    prefixes = {"stg_": "staging", "int_": "intermediate", "fct_": "marts", "dim_": "marts"}
    by_name = [F.when(col(name).startswith(p), layer) for p, layer in prefixes.items()]
    return F.coalesce(*by_path, *by_name)


def test_kind(test_id: str | Column) -> Column:
    """Type of a data test from the name part of its id; custom where no known prefix fits."""
    name = F.element_at(F.split(col(test_id), r"\."), 3)
    kinds = {"unique": "unique", "not_null": "not_null", "relationships": "relationships", "accepted_values": "accepted_values"}
    return F.coalesce(*[F.when(name.startswith(p), F.lit(k)) for p, k in kinds.items()], F.lit("custom"))


def filled(c: str | Column) -> Column:
    """Neither null nor the empty string."""
    return col(c).isNotNull() & (col(c) != "")


def latest(df, by: list[str | Column], *order: Column):
    """One row per key: the first in ``order``, which should end in a unique column."""
    rank = F.row_number().over(Window.partitionBy(*[col(b) for b in by]).orderBy(*order))
    return df.withColumn("_nth", rank).filter("_nth = 1").drop("_nth")
