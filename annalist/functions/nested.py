"""Nested YAML as rows: a table function with an indentation stack, tried again on a repaired text, with error rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "doc int, path string, value string, repaired boolean, error string"
#: What a drafted text has in the place of plain signs: fixed values.
TYPED = str.maketrans("‘’“”–—\u2011\u00a0", "''\"\"--- ")
KEY = re.compile(r"""("[^"]*"|'[^']*'|[^\s"'\[{#&*!|>%@`-][^:#]*?)\s*:(?:\s+|$)(.*)""", re.S)


class Malformed(ValueError):
    """A text that is no YAML of the kind read here."""


def scalar(text: str) -> str | list | dict | None:
    """A value on one line: quoted or plain text, null, or a list or map in brackets."""
    text = text.strip()
    if text[:1] in ("'", '"'):
        end = text.find(text[0], 1)
        if end < 0 or text[end + 1 :].strip() and not text[end + 1 :].lstrip().startswith("#"):
            raise Malformed(f"open quote: {text[:40]}")
        return text[1:end]
    text = re.sub(r"(^|\s)#.*", "", text).strip()
    if text[:1] in ("[", "{"):
        if text[-1:] != {"[": "]", "{": "}"}[text[0]]:
            raise Malformed(f"open bracket: {text[:40]}")
        parts = [p for p in re.findall(r"""(?:"[^"]*"|'[^']*'|\[[^\]]*\]|[^,])+""", text[1:-1]) if p.strip()]
        if text[0] == "[":
            return [scalar(p) for p in parts]
        pairs = [KEY.fullmatch(p.strip()) for p in parts]
        if not all(pairs):
            raise Malformed(f"no key: {text[:40]}")
        return {scalar(m[1]): scalar(m[2]) for m in pairs}
    return None if text in ("", "~", "null") else text


def lines_of(text: str) -> list[tuple[int, str]]:
    """(indentation, content) of the lines that say something; lines of block scalars are drawn into their keys' line."""
    out: list[tuple[int, str]] = []
    block: tuple[int, str, list[str]] | None = None
    for raw in [*text.split("\n"), "\0"]:
        depth = len(raw) - len(raw.lstrip(" "))
        if block and (not raw.strip() or depth > block[0]):
            block[2].append(raw)
            continue
        if block:
            held = [x for x in block[2]]
            while held and not held[-1].strip():
                held.pop()
            cut = min((len(x) - len(x.lstrip(" ")) for x in held if x.strip()), default=0)
            joined = ("\n" if block[1][-1] == "|" else " ").join(x[cut:] for x in held)
            out.append((block[0], block[1][:-1] + "\1" + joined))
            block = None
        if raw == "\0" or not raw.strip() or raw.lstrip().startswith("#"):
            continue
        if "\t" in raw[: len(raw) - len(raw.lstrip())]:
            raise Malformed("a tab in the indentation")
        content = raw.strip()
        if re.search(r":\s+[|>][+-]?$", content):
            block = (depth, content.rstrip("+-"), [])
        else:
            out.append((depth, content))
    return out


def document(text: str):
    """One document: maps, lists and texts. A stack holds the open containers by their indentation."""
    root: list = [None]
    stack: list[tuple[int, object, object]] = [(-1, root, 0)]  # indentation, container, the place in it that what is deeper fills

    def fill(depth: int, kind: type):
        """The container of a line: that of its indentation, or a new one in the open place of the one above."""
        while stack[-1][0] > depth:
            stack.pop()
        at, held, place = stack[-1]
        if at == depth:
            if not isinstance(held, kind):
                if kind is list or len(stack) < 2 or not isinstance(held, list):
                    raise Malformed(f"a list and a map at one depth ({depth})")
                stack.pop()
                return fill(depth, kind)
            return held
        if place is None or (held[place] if not isinstance(held, dict) else held.get(place)) is not None:
            raise Malformed(f"nothing holds what is at depth {depth}")
        made = kind()
        held[place] = made
        stack.append((depth, made, None))
        return made

    def value(raw: str):
        return raw[1:] if raw.startswith("\1") else scalar(raw)

    def put(depth: int, content: str) -> None:
        if content == "-" or content.startswith("- "):
            while stack[-1][0] > depth:
                stack.pop()
            if stack[-1][0] == depth and isinstance(stack[-1][1], dict) and len(stack) > 1 and stack[-1][2] is not None and stack[-1][1].get(stack[-1][2]) is None:
                at, held, place = stack[-1]  # a list under its key, not further in
                made: list = []
                held[place] = made
                stack.append((depth, made, None))
            held = fill(depth, list)
            rest = content[1:].strip()
            held.append(None)
            stack[-1] = (depth, held, len(held) - 1)
            if rest.startswith("- ") or rest[:1] not in ("'", '"', "[", "{") and KEY.fullmatch(rest):
                put(depth + len(content) - len(rest), rest)
            elif rest:
                held[-1] = value(rest)
            return
        m = KEY.fullmatch(content)
        if not m:
            raise Malformed(f"neither a key nor an item: {content[:40]}")
        while stack[-1][0] > depth or stack[-1][0] == depth and isinstance(stack[-1][1], list):
            stack.pop()
        held, name = fill(depth, dict), str(scalar(m[1]))
        held[name] = value(m[2]) if m[2] else None
        stack[-1] = (depth, held, name)

    lines = lines_of(text)
    if len(lines) == 1 and not KEY.fullmatch(lines[0][1]) and not lines[0][1].startswith("-"):
        return scalar(lines[0][1])
    for depth, content in lines:
        put(depth, content)
    return root[0]


def flat(value, path: str = "") -> Iterator[tuple[str, str | None]]:
    """Paths such as a.b[0].c with their texts; an empty container is a path without a text."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flat(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from flat(v, f"{path}[{i}]")
    else:
        yield path, None if isinstance(value, (dict, list)) else value


def repaired(text: str) -> str:
    """What drafts do wrong most often: a fence around it, typographic signs, tabs, commas at line ends, no blank behind a colon."""
    fence = re.search(r"```[A-Za-z]*[ \t]*\n(.*?)```", text, re.S)
    text = (fence[1] if fence else text).translate(TYPED).expandtabs(2)
    text = re.sub(r",[ \t]*$", "", text, flags=re.M)
    return re.sub(r"^(\s*(?:- )?[A-Za-z_][\w-]*):(?=[^\s:/])", r"\1: ", text, flags=re.M)


def parsed(text: str) -> list:
    parts = re.split(r"^---[ \t]*$", text, flags=re.M)
    return [document(p) for p in parts if p.strip()]


class Yaml:
    """The table function: a row for each value of each document, or one with the error."""

    def eval(self, text: str | None):
        if not (text or "").strip():
            return
        for again in (False, True):
            try:
                found = [(i, path, None if v is None else str(v), again, None) for i, doc in enumerate(parsed(repaired(text) if again else text)) for path, v in flat(doc)]
            except Malformed as wrong:
                error = str(wrong)
                continue
            yield from found
            return
        yield None, None, None, True, error


def yaml_rows(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, doc, path, value, repaired, error: the values of each row's YAML text, documents numbered from 0.

    Maps, lists, quoted and plain texts, block texts, brackets on one line and comments are read; anchors and tags are not. A
    text that cannot be read is repaired and read once more; if that fails too the row is its error. Null and blank texts give no row.
    """
    read = F.udtf(Yaml, returnType=ROWS)
    return rows.select(*key, F.col(text).alias("_text")).lateralJoin(read(F.col("_text").outer())).drop("_text")


def lenient_json(text, schema: str) -> Column:
    """A JSON text as a struct; one that cannot be read is tried again with its escaped apostrophes plain; null if that fails too."""
    t = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(t, r"\\'", "'")
    good = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(good(t), good(plain))
