"""Column functions over analyzer findings: CWE ids, paths, lines, names, text, effect sizes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _some(text: Column) -> Column:
    """Empty text as null."""
    return F.nullif(text, F.lit(""))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where f reads value more than once: it is computed once, and f is no part of the generated code, which the
    JVM leaves uncompiled where texts of many steps make one method of it too long."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_cwe(value: Column) -> Column:
    """CWE-n from a number, digits, text, or a JSON list of these; the first that has one counts. Digits stay as written."""
    items = F.coalesce(F.from_json(value, "array<string>"), F.array(value))

    def one(item: Column) -> Column:
        digits = F.when(item.rlike(r"^\d+$"), item).otherwise(_some(F.regexp_extract(item, r"(?i)\bCWE[-_ ]?(\d+)\b", 1)))
        return F.concat(F.lit("CWE-"), digits)

    return F.get(F.filter(F.transform(items, one), lambda c: c.isNotNull()), F.lit(0))


def tag_cwe(tags: Column) -> Column:
    """CWE-n from the first tag such as external/cwe/cwe-079."""
    found = F.transform(tags, lambda t: _some(F.regexp_extract(t, r"(?i)(?:^|/)cwe-(\d+)$", 1)))
    return F.concat(F.lit("CWE-"), F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0)))


def cwe_number(cwe: Column) -> Column:
    """The number in CWE-079, cwe_79 or 79; null if there is none."""
    return _some(F.regexp_extract(cwe, r"(?i)(?:^|CWE[-_ ]?)0*(\d+)", 1)).try_cast("int")


def format_cwe(number: Column) -> Column:
    """CWE- and at least three digits."""
    digits = number.cast("string")
    return F.concat(F.lit("CWE-"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def canonical_cwe(text: Column) -> Column:
    """The first CWE id anywhere in text, without regard to word borders, in canonical form; else null."""
    number = lambda text: _some(F.regexp_extract(text, r"(?i)CWE[-_ ]?(\d+)", 1)).try_cast("int")
    # Most texts are nothing but an id as a number is written, and need no search.
    plain, digits = text.rlike(r"^[Cc][Ww][Ee][-_ ](?:0|[1-9]\d{0,8})\z"), F.substr(text, F.lit(5))
    padded = F.concat(F.lit("CWE-"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))
    return F.when(plain, padded).otherwise(_once(_once(text, number), format_cwe))


def cwe_order(cwe: Column) -> Column:
    """Sort key: numeric ids by number, all else after them."""
    return F.coalesce(cwe_number(cwe), F.lit(1_000_000_000))


def normal_path(path: Column) -> Column:
    """Resolve empty, . and .. segments of a relative path; a path that comes to nothing is empty."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    whole = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")
    # Most paths go nowhere up, and need no arrays; most segments need no search either.
    once = F.replace(path, F.lit("/./"), F.lit("/"))
    plain = F.when(F.contains(once, F.lit("//")) | F.contains(once, F.lit("/./")), F.regexp_replace(path, r"/(?:\.?/)+", "/")).otherwise(once)
    plain = F.when(F.startswith(path, F.lit("/")) | F.startswith(path, F.lit("./")), F.regexp_replace(plain, r"^(?:\.?/)+", "")).otherwise(plain)
    plain = F.when(F.endswith(path, F.lit("/")) | F.endswith(path, F.lit("/.")) | (path == "."), F.regexp_replace(plain, r"(?:^|/)\.?\z", "")).otherwise(plain)
    return F.when(F.contains(path, F.lit("..")), whole).otherwise(plain)


def normalize_path(path: Column, class_name: Column, project: Column) -> Column:
    """The project-relative form of a path that an analyzer reported from inside its container or from a checkout."""

    def without(p: Column, start: str | Column) -> Column:
        start = F.lit(start) if isinstance(start, str) else start
        return F.when(F.startswith(p, start), F.substr(p, F.length(start) + 1)).otherwise(p)

    def inside(p: Column) -> Column:
        cut = None
        for mark in (F.lit("/workspace/"), F.concat(F.lit("/dataset/"), class_name, F.lit("/"), project, F.lit("/")), F.concat(F.lit("/"), project, F.lit("/"))):
            cut = (F if cut is None else cut).when(F.instr(p, mark) > 0, F.call_function("substring_index", p, mark, F.lit(-1)))
        return cut.otherwise(p)

    p = _once(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), lambda p: without(p, "file://"))
    p = _once(_once(p, inside), lambda p: without(p, "/workspace"))
    p = _once(p, lambda p: F.when(F.startswith(p, F.lit("/")) | F.startswith(p, F.lit("./")), F.regexp_replace(p, r"^(/|\./)+", "")).otherwise(p))
    general = _once(_once(p, lambda p: without(p, F.concat(project, F.lit("/")))), normal_path)
    # Most come from a container, with nothing in them to resolve but single dots.
    rest = F.substr(path, F.lit(len("/workspace/")))
    once = F.replace(rest, F.lit("/./"), F.lit("/"))
    has = lambda p, *parts: reduce(Column.__or__, (F.contains(p, F.lit(x)) for x in parts))
    ends = reduce(Column.__or__, (F.endswith(path, F.lit(x)) for x in (" ", "/", "/.")))
    plain = F.startswith(path, F.lit("/workspace/")) & ~has(path, "\\", "..") & ~has(rest, "/workspace") & ~has(once, "//", "/./") & ~ends
    plain &= ~F.startswith(once, F.concat(F.lit("/"), project, F.lit("/")))
    return F.when(plain, F.substr(once, F.lit(2))).otherwise(general)


def positive_line(value: Column) -> Column:
    """A whole number above zero, else null; value is text."""
    number = value.try_cast("int")
    return F.when(number > 0, number)


def function_id(filename: Column, scope: Column, name: Column, start: Column, end: Column) -> Column:
    """file::[scope::]name:start-end."""
    return F.concat(F.concat_ws("::", filename, _some(scope), name), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def project_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def category_code(label: Column) -> Column:
    return F.substring_index(label, " ", 1)


def name_candidates(repository: Column) -> Column:
    """Names under which owner/repo may be known: whole, last part, first part, last part without -src or _src."""
    whole = project_key(repository)
    last = F.substring_index(whole, "/", -1)
    return F.array_distinct(F.array(whole, last, F.substring_index(whole, "/", 1), F.regexp_replace(last, "[-_]src$", "")))


#: A comment, or a string or character literal, which stays; both may span lines, and one that never ends is plain text.
CODE = re.compile(r"//[^\n]*|/\*.*?\*/|('(?:\\.|[^\\'])*'|\"(?:\\.|[^\\\"])*\")", re.S)


@F.pandas_udf(StringType())
def strip_comments(code: pd.Series) -> pd.Series:
    """Each comment becomes one space; string and character literals are left alone."""
    return code.map(lambda text: CODE.sub(lambda m: m[1] or " ", text), na_action="ignore")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def collapse_blank_lines(text: Column) -> Column:
    """Runs of blank lines become one line break, after white space at both ends is taken off."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+\z", ""), r"\n\s*\n+", "\n")


def effect_label(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").when(size.isNotNull(), "large")


def dominance(delta: Column, first: str, second: str) -> Column:
    return F.when(delta > 0, first).when(delta < 0, second).when(delta == 0, "equal")


def payload(raw: Column, opening: str) -> Column:
    """What follows a tool's banner: raw from the first opening character on, null if there is none."""
    at = F.instr(raw, opening)
    return F.when(at > 0, F.substr(raw, at))


def per_thousand(count: Column, size: Column) -> Column:
    """count per thousand of size; null if size is null or 0."""
    return count * 1000.0 / F.nullif(size, F.lit(0))
