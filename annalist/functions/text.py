"""Text functions as Column expressions: headers, dates, token sets, overlap scores, small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that overlap scores leave out: fixed values.
STOPWORDS = "the a an of to in on at for and or what when who why how which is was were did do does as by be been being this that these those with from into about you".split()
#: Genres by the kind of testimony they give: fixed values.
DIRECT = ["slack_thread", "meeting_transcript", "email_thread", "customer_call_transcript"]
INFERENCE = ["postmortem", "retrospective", "adr", "rfc", "notion_doc", "incident_report", "meeting_notes", "customer_call_notes", "sales_crm_entry"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_set(text) -> Column:
    """Distinct [a-z0-9]+ of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0)))


def content_set(text) -> Column:
    """Distinct words, with digits, apostrophes and hyphens, less stopwords."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9'-]+"), F.lit(0)))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def leak(question, answer) -> Column:
    """Share of the answer's content words that the question holds; 0 if either has none."""
    q, a = content_set(question), content_set(answer)
    return F.when((F.size(q) == 0) | (F.size(a) == 0), 0.0).otherwise(F.size(F.array_intersect(q, a)) / F.size(a))


def memorised(candidate, truth) -> Column:
    """Share of the truth's words of four letters or more, ISO dates and years that occur in the candidate."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(_c(truth)), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)))
    kinds = r"^([a-z][a-z0-9-]{3,}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4})$"
    tokens = F.array_except(F.filter(words, lambda w: w.rlike(kinds)), F.array(*[F.lit(w) for w in STOPWORDS]))
    lower = F.lower(_c(candidate))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(F.filter(tokens, lambda t: F.contains(lower, t))) / F.size(tokens))


def strip_header(text) -> Column:
    """Text without one leading HTML comment, trimmed."""
    body = F.regexp_replace(_c(text), r"(?s)\A\s*<!--.*?-->\s*", "")
    return F.regexp_replace(F.regexp_replace(body, r"\A\s+", ""), r"\s+\z", "")


def header_date(text) -> Column:
    """First full date, else the first month of a quarter, else the first day of a year-month, else null."""
    t = _c(text)
    full = F.nullif(F.regexp_extract(t, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    year, quarter = (F.nullif(F.regexp_extract(t, r"([0-9]{4})[- ]?Q([1-4])", i), F.lit("")) for i in (1, 2))
    month = F.nullif(F.regexp_extract(t, r"([0-9]{4}-[0-9]{2})", 1), F.lit(""))
    return F.coalesce(full, F.concat(year, F.lit("-"), F.lpad((quarter.cast("int") * 3 - 2).cast("string"), 2, "0"), F.lit("-01")), F.concat(month, F.lit("-01")))


def testimony_type(genre) -> Column:
    g = F.lower(F.trim(_c(genre)))
    return F.when(g.isin(DIRECT), "direct_testimony").when(g.isin(INFERENCE), "inference").otherwise("unknown")


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def fact_verdicts(text) -> Column:
    """'FACT n: yes|partial|no' lines as a map from number to verdict; of several lines of one number the last holds."""
    lines = F.filter(F.split(F.lower(_c(text)), "\n"), lambda x: x.rlike(r"fact\s+[0-9]+\s*:\s*(yes|partial|no)"))
    number = lambda x: F.regexp_extract(x, r"fact\s+([0-9]+)", 1).cast("int")
    last = F.filter(lines, lambda x, i: ~F.exists(F.slice(lines, i + 2, F.size(lines)), lambda y: number(y) == number(x)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(number(x).alias("k"), F.regexp_extract(x, r":\s*(yes|partial|no)", 1).alias("v"))))


def triples(text) -> Column:
    """Lines 'a -> relation -> b' as structs."""
    lines = F.filter(F.split(_c(text), "\n"), lambda x: x.rlike(r"^\s*\S.*(→|->|>).*(→|->|>)\s*\S"))
    parts = F.transform(lines, lambda x: F.split(x, r"\s*(?:→|->|>)\s*"))
    return F.transform(F.filter(parts, lambda p: F.size(p) == 3), lambda p: F.struct(F.trim(p[0]).alias("source"), F.trim(p[1]).alias("relation"), F.trim(p[2]).alias("target")))


def json_in(text) -> Column:
    """The object from the first brace to the last, as a variant; null if it does not parse."""
    return F.try_parse_json(F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1))
