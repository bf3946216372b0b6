"""Rows that fail to parse: a strict load, what it left out, and why.

Method: strict load plus anti-join. Only records that conform in every point are loaded, under the
offsets they were delivered at; the loaded offsets are subtracted from all offsets, and what remains
is diagnosed. All of it is JVM-side text expressions without backtracking, so long records are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.columns import col, require

__all__ = ["strict_load", "rejected_records", "INT_MAX"]

INT_MAX = 2147483647

# A field is quoted from its first character on, or holds no quote. Every repetition is possessive:
# each character is read once, and Java runs possessive groups as a loop, not by recursion.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
_FIELD = f'(?:{_QUOTED}|[^",]*+)'
_RECORD = rf"(?s)\A{_FIELD}(?:,{_FIELD})*+\z"
_THREE = rf"(?s)\A({_FIELD}),({_FIELD}),({_FIELD})\z"
_BLANK = " \t"


def _body(raw: Column) -> Column:
    """The record without its line end; null is the record of no characters."""
    text = F.coalesce(raw, F.lit(""))
    shorter = lambda n: text.substr(F.lit(1), F.length(text) - n)
    return F.when(text.endswith("\r\n"), shorter(2)).when(text.endswith("\n") | text.endswith("\r"), shorter(1)).otherwise(text)


def _quotes(body: Column) -> Column:
    return F.contains(body, F.lit('"'))


def _fields(body: Column) -> Column:
    """The three fields as they stand, or null. Without quotes, commas alone tell fields apart."""
    extracted = F.array(*[F.regexp_extract(body, _THREE, i) for i in (1, 2, 3)])
    return F.when(_quotes(body), F.when(body.rlike(_THREE), extracted)).otherwise(F.split(body, ",", -1))


def _content(field: Column) -> Column:
    """What a field holds, without blanks at its ends."""
    inner = F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.btrim(F.when(field.startswith('"'), inner).otherwise(field), F.lit(_BLANK))


def _weight(text: Column) -> Column:
    """The int that ``text`` spells in ASCII digits, else null. Leading zeros are good."""
    digits = F.regexp_replace(text, r"\A0+(?=[0-9])", "")
    return F.when(digits.rlike(r"\A[0-9]{1,10}\z"), F.try_to_number(digits, F.lit("9999999999")).cast("long")).cast("long")


def strict_load(raw: DataFrame, *, offset: str, line: str) -> DataFrame:
    """``(offset, src, dst, weight)`` of the records that conform in every point.

    Three comma-separated fields under the quote rules of :func:`rejected_records`; names not empty,
    and a weight of ASCII digits up to ``INT_MAX``. Contents are taken without spaces and tabs at both
    ends. Records delivered repeatedly under several offsets are all loaded. An empty input gives an
    empty table; further columns are ignored.
    """
    require(raw, offset, line)
    # The one-row explode keeps the fields from being computed again wherever they are used.
    three = raw.select(col(offset).alias("offset"), F.explode(F.array(_fields(_body(col(line))))).alias("f")).where(F.size("f") == 3)
    named = three.select("offset", *[_content(F.col("f")[i]).alias(n) for i, n in enumerate(("src", "dst", "digits"))])
    good = named.where((F.col("src") != "") & (F.col("dst") != "")).select("offset", "src", "dst", _weight(F.col("digits")).alias("weight"))
    return good.where(F.col("weight") <= INT_MAX).select(F.col("offset").alias(offset), "src", "dst", F.col("weight").cast("int").alias("weight"))


def rejected_records(raw: DataFrame, *, offset: str, line: str, loaded: DataFrame | None = None) -> DataFrame:
    """``(offset, line, reason)`` of every record that the strict load left out.

    One CR, LF or CRLF at the very end is no part of a record. A field that begins with ``"`` ends at the
    next ``"`` that is not doubled, and only a comma or the end may follow; any other field holds no
    ``"``. The reason is the first that applies: ``quoting`` (these rules are broken), ``columns`` (not
    three fields), ``value`` (an empty name, or a weight that is no number up to ``INT_MAX``). A null
    record is one of no characters, hence ``columns``. ``offset`` must be unique and not null.
    """
    require(raw, offset, line)
    good = strict_load(raw, offset=offset, line=line) if loaded is None else loaded
    rest = raw.select(col(offset).alias("offset"), col(line).alias("line")).join(good.select(col(offset).alias("offset")), "offset", "left_anti")
    judged = rest.select("offset", "line", F.explode(F.array(_body(F.col("line")))).alias("body"))
    body = F.col("body")
    broken = _quotes(body) & ~body.rlike(_RECORD)
    reason = F.when(broken, "quoting").when(F.coalesce(F.size(_fields(body)), F.lit(0)) != 3, "columns").otherwise("value")
    return judged.select(F.col("offset").alias(offset), F.col("line").alias(line), reason.alias("reason"))
