"""Parsers of drafted blocks as Column expressions: event sketches, version chains, rubric lines, paraphrases, keyed facets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions import parse as P
from annalist.functions import rules as R

#: Words of the outline's format: levels of discipline, headings of its parts. Fixed values.
LEVELS = "low medium high".split()
#: Fields of an outline: name, heading, how its part is read, what is kept of it (all, or so many), its bounds and what is said
#: beyond them. Bounds are of the number of entries; of one that is a number itself, of its value.
OUTLINE = [
    ("founding_year", "founding", "year", "first", None, None, "no founding year"),
    ("founders", "founding", "names", 2, 2, None, "fewer than two founders"),
    ("year_arcs", "year arcs", "arcs", "all", 1, None, "no year arcs"),
    ("eras", "doc-discipline eras", "eras", "all", 5, 5, "not five eras"),
    ("products", "product lines", "items", "all", 1, None, "no product lines"),
    ("customer_arc_count", "customer arc count", "numbers", "first", 8, 10, "customer arcs not 8 to 10"),
    ("tooling", "tooling timeline", "tools", "all", 1, None, "no tooling timeline"),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blocks(text, at: str) -> Column:
    """The parts of a text that begin with a line that `at` matches; what precedes the first is left out."""
    return F.filter(F.split(P.unfenced(P.plain_quotes(text)), rf"(?m)(?={at})"), lambda b: b.rlike(rf"\A{at}"))


def field(block: Column, name: str) -> Column:
    """The value of the last `name: value` line of a block, in any case; empty if there is none."""
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(rf"(?i)^\s*{name}\s*:\s*\S"))
    return F.trim(F.coalesce(F.regexp_extract(F.try_element_at(lines, F.lit(-1)), rf"(?i)^\s*{name}\s*:\s*(.*)$", 1), F.lit("")))


def person_ids(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"\b(P-[0-9]+)\b"), F.lit(1))


def event_sketches(text) -> Column:
    """'## EV-2020-1' blocks as structs; participants are ids of four digits, a missing type is strategic_decision, an odd category null."""
    def sketch(b):
        kind = F.lower(field(b, "type"))
        return F.struct(
            F.regexp_extract(b, r"\A##\s+(EV-[0-9]{4}-[0-9]+)", 1).alias("id"), F.when(kind == "", "strategic_decision").otherwise(kind).alias("type"), field(b, "occurred_at").alias("occurred_at"),
            F.filter(F.transform(F.split(field(b, "participants"), r"[,\s]+"), lambda p: F.regexp_replace(p, r"^[\[\],]+|[\[\],]+$", "")), lambda p: p.rlike(r"^P-[0-9]{4}$")).alias("participants"),
            field(b, "summary").alias("summary"), R.normal_category(field(b, "category_target")).alias("category_target"), R.filled(F.regexp_extract(field(b, "corrects_event_id"), r"^(EV-[0-9]{4}-[0-9]+)", 1)).alias("corrects_event_id"),
        )

    return F.transform(blocks(text, r"##[ \t]+EV-[0-9]{4}-[0-9]+"), sketch)


def completed(record: str, sketch: str) -> list[Column]:
    """A record's fields with the sketch's where it has none; what was recorded at no time was recorded when it occurred."""
    pick = lambda name: F.coalesce(R.filled(f"{record}.{name}"), R.filled(f"{sketch}.{name}")).alias(name)
    occurred = F.coalesce(R.filled(f"{record}.occurred_at"), R.filled(f"{sketch}.occurred_at"))
    people = F.when(F.size(f"{record}.participants") > 0, F.col(f"{record}.participants")).otherwise(F.col(f"{sketch}.participants"))
    return [pick("type"), occurred.alias("occurred_at"), pick("summary"), people.alias("participants"), F.coalesce(R.filled(f"{record}.recorded_at"), occurred).alias("recorded_at")]


def version_chain(text) -> Column:
    """'version:' blocks as structs of version, year_month, decision, reason, relation and people; those without decision and month are left out."""
    made = F.transform(blocks(text, r"[ \t]*version[ \t]*:"), lambda b: F.struct(*[field(b, n).alias(n) for n in ("version", "year_month", "decision", "reason", "relation_to_previous")], person_ids(field(b, "decider_ids")).alias("deciders")))
    return F.filter(made, lambda v: (v["decision"] != "") | (v["year_month"] != ""))


def channels(text) -> Column:
    """'channel:' blocks as structs of channel, created, archived and team."""
    return F.transform(blocks(text, r"[ \t]*channel[ \t]*:"), lambda b: F.struct(*[field(b, n).alias(n) for n in ("channel", "created", "archived", "team")]))


def pattern(text) -> Column:
    """A drafted pattern: question, answer, qualifier, formalization, and its facets, the lines that begin with a dash."""
    body = P.unfenced(P.plain_quotes(text))
    facets = F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*[-*]\s+\S")), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*]\s+", "")))
    return F.struct(*[field(body, n).alias(n) for n in ("question", "gt_answer", "temporal_qualifier", "formalization")], facets.alias("facets"))


def paraphrases(text) -> Column:
    """What follows each '### Q:', up to the next."""
    parts = F.regexp_extract_all(P.unfenced(P.plain_quotes(text)), F.lit(r"(?s)###\s*Q:\s*(.+?)(?=\n###\s*Q:|\z)"), F.lit(1))
    return F.transform(parts, lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", ""))


def rubric_lines(text) -> Column:
    """'- C1.sub1 | 2 | criterion | FAIL: ...' lines as structs: listed lines cut at their bars, the last part being what fails if it says so.

    Lines without an id of a numbered part, points that are a number and a criterion are left out.
    """
    def line(x):
        parts = F.transform(F.split(F.regexp_replace(x, r"^[-*]", ""), r"\|"), lambda c: F.trim(c))
        fails = F.startswith(F.element_at(parts, -1), F.lit("FAIL:")) & (F.size(parts) > 3)
        criterion = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - F.when(fails, 3).otherwise(2), F.lit(0))), " | ")
        return F.struct(
            parts[0].alias("id"), F.get(parts, F.lit(1)).try_cast("double").alias("max_score"), criterion.alias("criterion"),
            F.when(fails, R.filled(F.trim(F.substring(F.element_at(parts, -1), 6, 10_000)))).alias("fail_criterion"),
        )

    numbered = lambda r: F.substring_index(r["id"], ".sub", -1).try_cast("int").isNotNull() & F.contains(r["id"], F.lit(".sub"))
    listed = F.filter(F.transform(F.split(P.unfenced(text), "\n"), lambda x: F.trim(x)), lambda x: F.substring(x, 1, 1).isin("-", "*"))
    return F.filter(F.transform(listed, line), lambda r: numbered(r) & r["max_score"].isNotNull() & (r["criterion"] != ""))


def facet_rubric(facets) -> Column:
    """The rubric of a pattern: seven tenths shared by its facets, two for the synthesis, one for the period."""
    n = F.size(_c(facets))
    each = F.round(F.lit(0.7) / F.greatest(n, F.lit(1)), 3)
    row = lambda i, w, c: F.named_struct(F.lit("id"), F.concat(F.lit("EMERGENT.sub"), i.cast("string")), F.lit("weight"), w, F.lit("criterion"), c)
    own = F.transform(_c(facets), lambda f, i: row(i + 1, each, F.concat(F.lit("Identifies the facet: "), F.substring(f, 1, 160))))
    rest = F.array(row(n + 1, F.lit(0.2).cast("double"), F.lit("Joins the facets into one pattern")), row(n + 2, F.lit(0.1).cast("double"), F.lit("Answers for the period asked, not a later formal version")))
    return F.concat(own, rest)


# Outlines


def listed(body: Column) -> Column:
    """What stands behind the dashes of list lines."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("-")))
    return F.filter(F.transform(lines, lambda x: F.trim(F.ltrim(x, F.lit("-")))), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))


def keyed(body: Column) -> Column:
    """List lines 'key: value' whose key begins with a year: structs of key, year and value."""
    made = F.transform(listed(body), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.substring(x, 1, 4).try_cast("int").alias("year"), F.trim(F.substring(x, F.instr(x, ":") + 1, 10_000)).alias("value")))
    return F.filter(made, lambda k: k["year"].isNotNull() & (k["value"] != ""))


def names_in(prose: Column) -> Column:
    """Runs of two or more words in a row that begin with a capital and go on in small letters, each once."""
    phrases = F.split(prose, r"[^\p{L} '-]+")
    marked = F.transform(phrases, lambda p: F.array_join(F.transform(F.split(p, " +"), lambda w: F.when(w.rlike(r"^\p{Lu}\p{Ll}"), w).otherwise("/")), " "))
    runs = F.flatten(F.transform(marked, lambda p: F.transform(F.split(p, "/"), lambda r: F.trim(r))))
    return F.array_distinct(F.filter(runs, lambda r: F.contains(r, F.lit(" "))))


def numbers_in(prose: Column) -> Column:
    return F.array_compact(F.transform(F.split(prose, r"[\s,;.()]+"), lambda w: w.try_cast("int")))


def era_blocks(body: Column) -> Column:
    """'### Era 1: name' blocks with a date span, a level and what characterises them; those without any of these are left out."""
    def era(b):
        title, span = F.substring_index(b, "\n", 1), field(b, "date span")
        level = F.lower(F.substring_index(field(b, "discipline level"), " ", 1))
        return F.struct(
            F.regexp_extract(title, "[0-9]+", 0).try_cast("int").alias("n"), F.trim(F.substring(title, F.instr(title, ":") + 1, 10_000)).alias("name"),
            F.trim(F.substring_index(span, " to ", 1)).alias("start"), F.trim(F.substring_index(span, " to ", -1)).alias("end"),
            F.when(level.isin(LEVELS), level).otherwise("").alias("discipline_level"), F.regexp_replace(F.coalesce(F.get(F.split(b, r"(?i)characterisation:", 2), F.lit(1)), F.lit("")), r"\A\s+|\s+\z", "").alias("characterisation"),
        )

    made = F.transform(blocks(body, r"###[ \t]*[Ee]ra[ \t]"), era)
    return F.filter(made, lambda e: P.month_index(e["start"]).isNotNull() & P.month_index(e["end"]).isNotNull() & (e["discipline_level"] != "") & (e["characterisation"] != ""))


#: How a part of an outline is read: from its text to an array.
READERS = {
    "year": lambda body: F.filter(numbers_in(body), lambda n: n.between(1900, 2099)),
    "numbers": numbers_in,
    "names": names_in,
    "items": listed,
    "eras": era_blocks,
    "arcs": lambda body: F.transform(keyed(body), lambda k: F.struct(k["year"].alias("year"), k["value"].alias("arc"))),
    "tools": lambda body: F.transform(keyed(body), lambda k: F.struct(k["year"].alias("year"), F.when(F.contains(k["key"], F.lit("-Q")), F.substring_index(k["key"], "-Q", -1).try_cast("int")).alias("quarter"), k["value"].alias("description"))),
}


def skeleton(text) -> Column:
    """A drafted outline read by OUTLINE, as one struct; `problems` lists what is missing or beyond its bounds, in the order of OUTLINE.

    Headings are of one or two signs, in any case. Besides the bounds, the eras need a low and a high level among them.
    """
    parts = P.sections(P.unfenced(text))
    body = lambda heading: F.coalesce(F.get(F.filter(parts, lambda p: F.lower(p["title"]) == heading), F.lit(0))["body"], F.lit(""))
    fields, problems = [], []
    for name, heading, reader, keep, least, most, said in OUTLINE:
        read = READERS[reader](body(heading))
        value = F.get(read, F.lit(0)) if keep == "first" else F.slice(read, 1, keep) if isinstance(keep, int) else read
        fields.append(value.alias(name))
        measure = value if keep == "first" else F.size(read)
        within = measure.isNotNull() & (F.lit(True) if least is None else measure >= least) & (F.lit(True) if most is None else measure <= most)
        problems.append(F.when(~F.coalesce(within, F.lit(False)), said))
        if reader == "eras":
            held = F.transform(read, lambda e: e["discipline_level"])
            problems.append(F.when(~(F.array_contains(held, LEVELS[0]) & F.array_contains(held, LEVELS[-1])), "no era of low or of high discipline"))
    return F.struct(*fields, F.array_compact(F.array(*problems)).alias("problems"))
