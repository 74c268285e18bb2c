"""Rules of records as Column expressions: categories, genres, dates of questions, facts of events, texts for retrievers, units and costs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions import parse as P
from annalist.functions.text import INFERENCE

#: Categories of questions: public name and capabilities that an answer needs. Fixed values.
CATEGORIES = {
    "C1": ("supersession", []),
    "C2": ("decision_provenance", ["provenance"]),
    "C3": ("bitemporal", ["temporal"]),
    "C4": ("audit_replay", ["temporal"]),
    "C5": ("justification_chain", ["provenance"]),
    "C6": ("contradiction", []),
    "HARD": ("multi_hop_lineage", []),
    "EMERGENT": ("emergent_pattern", []),
}
#: Genres in the order in which a part of a name finds them, and other names of some: fixed values.
GENRES = "slack_thread meeting_notes meeting_transcript adr rfc retrospective postmortem email_thread customer_call_notes sales_crm_entry notion_doc incident_report".split()
ALIASES = {"slack": "slack_thread", "notion": "notion_doc", "transcript": "meeting_transcript", "notes": "meeting_notes", "crm": "sales_crm_entry", "email": "email_thread", "call": "customer_call_notes", "post-mortem": "postmortem", "ticket": "sales_crm_entry"}
#: Verdicts on answers: fixed values.
FAILURES = "none retrieval_miss wrong_synthesis hallucination wrong_abstain dry_run".split()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x) -> Column:
    """A text, null if it is empty."""
    return F.nullif(_c(x).cast("string"), F.lit(""))


def as_year(x) -> Column:
    return F.expr("int(null)") if x is None else _c(x).try_cast("int")


# Categories and questions


def public_category(code) -> Column:
    names = F.create_map(*[F.lit(x) for k, (name, _) in CATEGORIES.items() for x in (k, name)])
    return F.coalesce(names[_c(code)], F.lower(_c(code)))


def capabilities(code) -> Column:
    none = F.array().cast("array<string>")
    needs = F.create_map(*[x for k, (_, caps) in CATEGORIES.items() if caps for x in (F.lit(k), F.array(*map(F.lit, caps)))])
    return F.coalesce(needs[_c(code)], none)


def is_emergent(category, metadata) -> Column:
    """metadata: JSON text."""
    return (_c(category) == "EMERGENT") | F.coalesce(F.get_json_object(_c(metadata), "$.validation_mode") == "union", F.lit(False))


def question_as_of(metadata, truth) -> Column:
    """The first date that is not empty of two JSON texts: as_of and as_of_date of one, as_of_date and as_of of the other."""
    return F.coalesce(*[filled(F.get_json_object(_c(j), f"$.{k}")) for j, k in ((metadata, "as_of"), (metadata, "as_of_date"), (truth, "as_of_date"), (truth, "as_of"))])


def normal_category(raw) -> Column:
    """C1 to C6 from the beginning of a text, in any case; null for numbers and all else."""
    text = F.upper(F.trim(_c(raw).cast("string")))
    return filled(F.regexp_extract(text, "^(C[1-6])", 1))


def as_of_after(occurred, days: int = 30) -> Column:
    return F.date_add(F.try_to_date(F.substring(_c(occurred), 1, 10)), days)


def failure_mode(raw) -> Column:
    return F.when(_c(raw).isin(FAILURES), _c(raw)).otherwise("none")


# Genres


def resolve_genre(raw) -> Column:
    """A genre by its name, another name, or the first one that holds the name or is held by it; slack_thread if there is none."""
    key = F.translate(F.lower(F.trim(_c(raw))), " -", "__")
    other = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[key]
    part = F.coalesce(*[F.when(F.contains(key, F.lit(g)) | F.contains(F.lit(g), key), g) for g in GENRES])
    return F.when(F.coalesce(_c(raw), F.lit("")) == "", "slack_thread").otherwise(F.coalesce(F.when(key.isin(GENRES), key), other, part, F.lit("slack_thread")))


def testimony(genre) -> Column:
    return F.when(_c(genre).isin(INFERENCE), "inferred").otherwise("direct")


def artefact_header(slot, event, genre, role, author) -> Column:
    """The comment that opens an artefact."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), F.coalesce(_c(v).cast("string"), F.lit("")), F.lit("\n"))
    return F.concat(F.lit("<!-- artefact_metadata\n"), line("slot_id", slot), line("event_id", event), line("genre", genre), line("role", role), line("author", author), line("testimony_type", testimony(genre)), F.lit("-->\n\n"))


def strip_artefact_header(text) -> Column:
    """Text without that comment, and nothing else taken away."""
    return F.regexp_replace(_c(text), r"(?s)\A<!-- artefact_metadata.*?-->\n*", "")


# Facts of events


#: What artefacts of an event tell: who does (any, or the primary one alone), the value that it needs, the sentence. Fixed values.
CANONICAL = [
    ("any", "decision", 'The decision: "{decision}"'),
    ("primary", "reason", 'The reason: "{reason}"'),
    ("any", "names", "At least one participant by name (any of: {names})"),
    ("primary", "day", "The date: {day}"),
    ("primary", "others", "At least one alternative considered (any of: {others})"),
    ("primary", "prior", 'The PRIOR (now-corrected) understanding from {before}: "{prior}"'),
    ("primary", "prior", "BOTH dates referenced: {before} (prior) AND {day} (correction)"),
]
#: What an event says in facts that stand alone: the value that a sentence needs, or each of several. Fixed values.
SCATTERED = [
    ("decision", 'The decision made: "{decision}"'),
    ("reason", 'The reason behind it: "{reason}"'),
    ("day", "That this was decided around {day}"),
    ("rejected", 'That an alternative considered (and rejected) was: "{rejected}"'),
    ("people", "That {people} was involved in this call"),
]
#: Characters that a fact tells of a text, and of an alternative in a list or alone.
TOLD, LISTED, ALONE = 200, 80, 120


def first_words(x, n: int) -> Column:
    return F.substring(F.trim(F.coalesce(_c(x).cast("string"), F.lit(""))), 1, n)


def sentence(text: str, values: dict[str, Column]) -> Column:
    """text with its {names} filled in."""
    return F.concat(*[values[part] if i % 2 else F.lit(part) for i, part in enumerate(re.split(r"[{}]", text)) if part])


def canonical_facts(role, kind, decision, reason, names, occurred, alternatives, prior_decision, prior_occurred) -> Column:
    """The sentences of CANONICAL for an artefact in a role; names and alternatives are arrays, the prior event is null where there is none.

    Alternatives are told of strategic decisions only; a prior event is told even if nothing is known of its decision.
    """
    listed = lambda xs, n: F.array_join(F.transform(F.slice(_c(xs), 1, 3), lambda x: F.substring(x, 1, n)), "; " if n == LISTED else ", ")
    values = {
        "decision": first_words(decision, TOLD), "reason": first_words(reason, TOLD), "day": first_words(occurred, 1000), "names": listed(names, 10_000),
        "others": F.when(_c(kind) == "strategic_decision", listed(alternatives, LISTED)), "prior": first_words(prior_decision, TOLD), "before": F.coalesce(_c(prior_occurred).cast("string"), F.lit("")),
    }
    there = {name: F.coalesce(value != "", F.lit(False)) for name, value in values.items()}
    there |= {"prior": _c(prior_decision).isNotNull(), "names": F.size(_c(names)) > 0, "others": (F.size(_c(alternatives)) > 0) & (_c(kind) == "strategic_decision")}
    primary = F.lower(F.coalesce(filled(role), F.lit("primary"))) == "primary"
    return F.array_compact(F.array(*[F.when(there[need] & (primary | F.lit(who == "any")), sentence(text, values)) for who, need, text in CANONICAL]))


def scattered_facts(decision, reason, occurred, alternatives, names) -> Column:
    """The sentences of SCATTERED for an event: one a text that is not empty, one each for up to two alternatives and people."""
    single = {"decision": first_words(decision, TOLD), "reason": first_words(reason, TOLD), "day": F.substring(F.coalesce(_c(occurred), F.lit("")), 1, 10)}
    several = {"rejected": F.transform(F.slice(_c(alternatives), 1, 2), lambda a: F.substring(a, 1, ALONE)), "people": F.slice(_c(names), 1, 2)}
    told = lambda need, text: F.transform(F.filter(F.array(single[need]), lambda x: x != "") if need in single else several[need], lambda x: sentence(text, {need: x}))
    return F.concat(*[told(need, text) for need, text in SCATTERED])


def once(x: Column, body) -> Column:
    """body(x) with x computed once: in an inner function it would be computed anew for each element."""
    return F.transform(F.array(x), body)[0]


def fact_lines(text, n: Column) -> Column:
    """'FACT k: yes|partial|no' lines as n verdicts in order: of several lines of one number the last, of none 'no'."""
    lines = F.filter(F.split(_c(text), "\n"), lambda x: x.rlike(r"(?i)^\s*fact\s+[0-9]+\s*:\s*(yes|partial|no)\b"))
    found = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"(?i)fact\s+([0-9]+)", 1).cast("int").alias("k"), F.lower(F.regexp_extract(x, r"(?i):\s*(yes|partial|no)", 1)).alias("v")))
    last = lambda fs, k: F.try_element_at(F.filter(fs, lambda f: f["k"] == k), F.lit(-1))["v"]
    numbers = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return once(found, lambda fs: F.transform(numbers, lambda k: F.coalesce(last(fs, k), F.lit("no"))))


def verdicts(facts, verdict: str, other: bool = False) -> Column:
    """The facts (structs with a verdict) that have a verdict, or the others."""
    return F.filter(_c(facts), lambda f: (f["verdict"] == verdict) != F.lit(other))


# People and lifetimes


def active(joined, left, year, strict: bool = True) -> Column:
    """Whether a year lies in a lifetime; a beginning that is no year never; an end that is none: never if strict, else always."""
    a, b = _c(joined).try_cast("int"), _c(left).try_cast("int")
    ended = F.when(_c(left).isNull(), True).when(b.isNull(), not strict).otherwise(b >= year)
    return F.coalesce((a <= year) & ended, F.lit(False))


def adopted(year, by) -> Column:
    return _c(year) <= by


def account_people_score(role) -> Column:
    """2 for people of customer work, else 1."""
    return F.when(F.lower(F.coalesce(_c(role), F.lit(""))).rlike("custom|success|sales|account|support"), 2).otherwise(1)


def letters_seed(name, n: int = 6) -> Column:
    """The sum of the codes of a name's first letters; a name without letters counts as Acme."""
    base = F.coalesce(filled(F.substring(F.regexp_replace(F.coalesce(_c(name), F.lit("Acme")), "[^A-Za-z]", ""), 1, n)), F.lit("Acme"))
    return F.aggregate(F.transform(F.split(base, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)


def years_of(qualifier, years) -> Column:
    """Of an array of years those that a text speaks of: from its least to its largest 20xx, up to the only one, or all; all too if none fits."""
    said = F.transform(F.regexp_extract_all(F.coalesce(_c(qualifier), F.lit("")), F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    low = F.when(F.size(said) >= 2, F.array_min(said)).otherwise(F.lit(0))
    fits = F.filter(F.array_sort(_c(years)), lambda y: (y >= low) & (y <= F.array_max(said)))
    return F.when((F.size(said) == 0) | (F.size(fits) == 0), F.array_sort(_c(years))).otherwise(fits)


def month_name(day) -> Column:
    return F.coalesce(F.date_format(F.try_to_date(F.substring(_c(day), 1, 10)), "MMMM"), F.lit(""))


# Texts for retrievers, and back


def labelled(*parts: tuple[str, Column], between: str) -> Column:
    return F.concat_ws(between, *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(k), v)) for k, v in parts])


def episode(timestamp, source, author, thread, company, text) -> Column:
    """A text with its date and a line of what is known of it."""
    dated = F.coalesce(F.concat(F.lit("[Date: "), filled(timestamp), F.lit("] ")), F.lit(""))
    line = labelled(("Source: ", _c(source)), ("Author: ", _c(author)), ("Thread: ", _c(thread)), ("Company: ", _c(company)), between=" | ")
    return F.concat(dated, line, F.lit("\n\n"), F.coalesce(_c(text), F.lit("")))


def source_line(source, author, thread, company) -> Column:
    return labelled(("", _c(source)), ("author=", _c(author)), ("thread=", _c(thread)), ("company=", _c(company)), between=" / ")


def metadata(**columns) -> Column:
    """A map of the columns that are neither null nor empty."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), filled(v).alias("value")) for k, v in columns.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def graph_episode(slot, text, day, genre, group, now=None) -> Column:
    """An artefact as an episode: its name, body, a description of its source, its group, and its time, which is `now` (the present) where it has none."""
    at = F.coalesce(P.iso_time(day), F.current_timestamp() if now is None else F.lit(now).cast("timestamp"))
    return F.struct(_c(slot).alias("name"), F.coalesce(_c(text), F.lit("")).alias("episode_body"), F.coalesce(filled(genre), F.lit("unknown")).alias("source_description"), _c(group).alias("group_id"), at.alias("reference_time"))


def snippets(hits) -> Column:
    """Texts of hits (structs of memory and timestamp, in order), dated where they can be; a default if there are none."""
    shown = F.transform(F.filter(_c(hits), lambda h: F.coalesce(h["memory"], F.lit("")) != ""), lambda h: F.concat(F.coalesce(F.concat(F.lit("["), filled(h["timestamp"]), F.lit("] ")), F.lit("")), h["memory"]))
    return F.when(F.size(shown) == 0, "No relevant evidence found.").otherwise(F.array_join(shown, "\n\n"))


def slug_of(slot, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}/"), F.lower(F.replace(_c(slot), F.lit(" "), F.lit("-"))))


def slot_of(slug, prefix: str) -> Column:
    """What follows the prefix; null for other slugs."""
    return filled(F.regexp_extract(_c(slug), rf"(?s)\A{prefix}/(.*)\z", 1))


def scope(company, tier) -> Column:
    return F.concat_ws("-", _c(company), _c(tier))


def safe_scope(x) -> Column:
    return F.regexp_replace(_c(x), r"[^\w\-]", "_")


# Numbers


def rounded(x, n: int) -> Column:
    """A double rounded to n digits by the exact binary value that it has, true ties going to the even digit.

    In integers: the value times a power of two that makes it whole, times 10^n, is divided with a rest. From 2^30 on doubles
    are rounded as they print.
    """
    x = _c(x).cast("double")

    def by(bits: int) -> Column:
        whole = F.floor(F.abs(x) * 2.0**bits).cast("decimal(20,0)") * F.lit(10**n).cast("decimal(9,0)")
        unit = F.lit(2**bits).cast("decimal(17,0)")
        q = F.call_function("div", whole, unit)
        twice = (whole - q.cast("decimal(20,0)") * unit) * F.lit(2).cast("decimal(1,0)")
        up = (twice > unit) | (twice == unit) & (q % 2 == 1)
        return F.signum(x) * (q + up.cast("bigint")) / float(10**n)

    return F.when(F.abs(x) < 1 << 10, by(52)).when(F.abs(x) < 1 << 20, by(42)).when(F.abs(x) < 1 << 30, by(32)).otherwise(F.bround(x, n))


def share(part, whole) -> Column:
    """part / whole, of a whole of 0 as of 1."""
    return _c(part) / F.greatest(_c(whole), F.lit(1))


def token_cost(tokens_in, tokens_out, price_in: float = 3e-6, price_out: float = 15e-6) -> Column:
    return _c(tokens_in) * price_in + _c(tokens_out) * price_out


def cell_cost(metered, hosted, fee) -> Column:
    """Metered cost and, for hosted systems, a fee above zero."""
    return F.round(_c(metered) + F.when(_c(hosted) & (_c(fee) > 0), _c(fee)).otherwise(0), 2)


def native_units(system, artifacts, queries) -> Column:
    """What each vendor meters, as a map; systems that meter nothing have an empty one."""
    m = lambda **k: F.create_map(*[x for key, v in k.items() for x in (F.lit(key), _c(v).cast("bigint"))])
    s = _c(system)
    empty = F.create_map().cast("map<string,bigint>")
    return F.when(s.isin("mem0", "mem0-platform"), m(add_requests=artifacts, retrieval_requests=queries)).when(s == "zep-cloud", m(episodes=artifacts, retrieval_requests=queries)).when(s == "graphiti", m(episodes=artifacts)).when(s == "gbrain", m(captures=artifacts, think_calls=queries)).otherwise(empty)


def unmeasured(system) -> Column:
    """Where a system's own calls run, if what they cost is not seen here."""
    s = _c(system)
    return F.when(s.isin("mem0", "graphiti"), "in the client library").when(s.isin("mem0-platform", "zep-cloud"), "at the host").when(s == "gbrain", "in a subprocess")


def retry_wait(wait, attempt) -> Column:
    """Seconds before another attempt (from 0): doubled twice at most, a minute at most."""
    return F.least(_c(wait) * F.pow(F.lit(2), F.least(_c(attempt), F.lit(2))), F.lit(60)).cast("int")


def scraped(text) -> Column:
    """nodes, edges and cost from lines of output: of several lines the last; 0 where nothing says it."""
    lines = F.split(_c(text), "\n")
    last = lambda xs, p: F.coalesce(filled(F.regexp_extract(F.try_element_at(F.filter(xs, lambda x: x.rlike(p)), F.lit(-1)), p, 1)), F.lit("0"))
    graph = F.filter(lines, lambda x: F.contains(x, F.lit("nodes")) & F.contains(x, F.lit("edges")))
    return F.struct(last(graph, r"([0-9]+)\s+nodes").cast("bigint").alias("nodes"), last(graph, r"([0-9]+)\s+edges").cast("bigint").alias("edges"), last(lines, r"\$([0-9.]+)").cast("double").alias("cost"))
