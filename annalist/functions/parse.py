"""Parsers of model output and of loose dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic signs and what they are in ASCII: fixed values. The last two are the hyphen and the blank that do not break.
SMART = "‘’“”–—\u2011\u00a0"
PLAIN = "''\"\"--- "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plain_quotes(text) -> Column:
    return F.translate(_c(text), SMART, PLAIN)


def unfenced(text) -> Column:
    """What stands in the first code fence; a text without a fence as it is, trimmed."""
    inside = F.regexp_extract(_c(text), r"(?s)```[A-Za-z]*[ \t]*\n(.*?)```", 1)
    return F.regexp_replace(F.when(inside != "", inside).otherwise(_c(text)), r"\A\s+|\s+\z", "")


def sections(text) -> Column:
    """Markdown by its headings of one or two signs: structs of title and body; what precedes the first heading is left out."""
    parts = F.filter(F.split(_c(text), r"(?m)(?=^#{1,2}\s)"), lambda p: p.rlike(r"\A#{1,2}\s"))
    title = lambda p: F.regexp_extract(p, r"\A#{1,2}\s+([^\n]*)", 1)
    body = lambda p: F.regexp_replace(F.regexp_replace(p, r"\A#{1,2}\s[^\n]*", ""), r"\A\s+|\s+\z", "")
    return F.transform(parts, lambda p: F.struct(F.trim(title(p)).alias("title"), body(p).alias("body")))


def yaml_documents(text) -> Column:
    """Documents of flat `key: value` lines, divided by `---`: an array of maps. Other lines and empty documents are left out; of equal keys the last holds."""
    fields = lambda d: F.filter(F.split(d, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*\s*:"))
    name = lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_-]+)", 1)
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^['\"]|['\"]$", "")
    last = lambda xs: F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, i + 2, F.size(xs)), lambda y: name(y) == name(x)))
    maps = F.transform(F.split(plain_quotes(unfenced(text)), r"(?m)^---[ \t]*$"), lambda d: F.map_from_entries(F.transform(last(fields(d)), lambda x: F.struct(name(x), value(x)))))
    return F.filter(maps, lambda m: F.size(m) > 0)


def iso_time(text) -> Column:
    """A whole ISO time, else the day that a text begins with, else null; without a zone it is UTC."""
    return F.coalesce(F.try_to_timestamp(_c(text)), F.try_to_timestamp(F.substring(_c(text), 1, 10), F.lit("yyyy-MM-dd")))


def iso_text(time) -> Column:
    return F.date_format(_c(time), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def middle_date(text, default: str = "2023-06-15") -> Column:
    """The middle of the month or year that a text begins with: 2021-3 is 2021-03-15, 2021 is 2021-06-15, others are the default."""
    t = F.trim(_c(text))
    year, month = F.regexp_extract(t, r"^([0-9]{4})", 1), F.regexp_extract(t, r"^[0-9]{4}-([0-9]{1,2})", 1)
    return F.when(month != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-15"))).when(t.rlike("^[0-9]{4}"), F.concat(year, F.lit("-06-15"))).otherwise(default)


def later_date(day, months, cap: int = 2026) -> Column:
    """A date some months on, in the year `cap` at the latest."""
    moved = F.add_months(_c(day), months)
    return F.when(F.year(moved) > cap, F.make_date(F.lit(cap), F.month(moved), F.least(F.dayofmonth(moved), F.lit(28)))).otherwise(moved)


def month_index(text) -> Column:
    """'YYYY-MM' as months since year 0; null if it is not one."""
    year, month = (F.nullif(F.regexp_extract(_c(text), r"^([0-9]{4})-([0-9]{1,2})", i), F.lit("")) for i in (1, 2))
    return year.cast("int") * 12 + month.cast("int")
