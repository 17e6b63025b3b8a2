"""Target paths of media files."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoebox.functions import media

# The default template, its fallback order, the folder of uncertain dates, the folder of unknown dates.
DEFAULT_TEMPLATE = "{yyyy}/{yyyy}-{MM}-{dd}_{event}/{yyyy}-{MM}-{dd}_{HHmmss}_{original}"
FALLBACK = ("event", "place", "date")
UNCERTAIN_FOLDER = "_日付未確定"
UNKNOWN_FOLDER, UNTITLED = "unknown", "untitled"


@dataclass(frozen=True)
class NamingRule:
    """Which parts a target path has."""

    year_folder: bool = True
    date_event_folder: bool = True
    date_time_prefix: bool = True
    keep_original_name: bool = True


@dataclass(frozen=True)
class NamingTemplate:
    template: str = DEFAULT_TEMPLATE
    fallback: tuple[str, ...] = field(default=FALLBACK)
    uncertain_folder: str = UNCERTAIN_FOLDER
    keep_original_name: bool = True


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is found once a row: named in an expression, it would be found again wherever a lambda names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def given(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def sanitize_segment(s: Column) -> Column:
    """A path segment without characters that file systems refuse; a blank one is "untitled"."""
    return F.coalesce(given(F.trim(F.regexp_replace(s, r'[/\\:*?"<>|]', ""))), F.lit(UNTITLED))


def with_sequence(path: Column, n: Column) -> Column:
    """``_n`` before the extension; unchanged for 0."""
    return F.when(n == 0, path).otherwise(F.concat(F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.lit("_"), n.cast("string"), F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 2)))


def date_tokens(ts: Column) -> dict[str, Column]:
    """yyyy, MM, dd, HHmmss of a time in UTC; unknown, 00, 00, 000000 of none."""
    token = lambda pattern, none: F.coalesce(F.date_format(ts, pattern), F.lit(none))
    return {"yyyy": token("yyyy", "unknown"), "MM": token("MM", "00"), "dd": token("dd", "00"), "HHmmss": token("HHmmss", "000000")}


def resolve_event(ts: Column, event: Column, place: Column, fallback: tuple[str, ...] = FALLBACK) -> Column:
    """The first name there is in the order of ``fallback``; the date always is."""
    t = date_tokens(ts)
    date = F.concat_ws("-", t["yyyy"], t["MM"], t["dd"])
    named = {"event": given(event), "place": given(place), "date": date}
    return F.coalesce(*[named[k] for k in fallback], date)


def _pieces(template: str) -> list[tuple[str, str]]:
    """A template's literal text and tokens in order, as ("text", ...) and ("token", name)."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template, re.ASCII):
        out += [("text", template[at : m.start()]), ("token", m[1])]
        at = m.end()
    return [x for x in [*out, ("text", template[at:])] if x[1]]


def template_path(root: str, source: Column, ts: Column, uncertain: Column, item_id: Column, event: Column, place: Column, person: Column, template: NamingTemplate = NamingTemplate()) -> Column:
    """The target of a file by a template; a file without a certain date goes to a folder of its own.

    The template is parsed once, so braces inside names are names' own characters.  Unknown tokens are empty.
    Segments lose doubled, leading and trailing underscores; blank ones are left out.
    """
    ext, original = F.regexp_extract(source, r"[^/](\.[^./]*)$", 1), media.stem(source)
    name = original if template.keep_original_name else item_id
    event = resolve_event(ts, event, place, template.fallback)
    known = date_tokens(ts) | {"event": event, "place": F.coalesce(place, event), "person": F.coalesce(person, F.lit("")), "original": original if template.keep_original_name else F.lit("")}
    raw = F.concat(F.lit(""), *[F.lit(x) if kind == "text" else known.get(x, F.lit("")) for kind, x in _pieces(template.template)])
    parts = F.transform(F.split(raw, "/"), lambda s: F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", ""))
    parts = F.transform(F.filter(parts, lambda s: F.trim(s) != ""), sanitize_segment)
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(item_id))
    certain = F.concat(F.lit(root + "/"), F.array_join(parts, "/"), ext)
    apart = F.concat(F.lit(f"{root}/"), sanitize_segment(F.lit(template.uncertain_folder)), F.lit("/"), sanitize_segment(name), ext)
    return F.when(F.coalesce(uncertain, F.lit(False)) | ts.isNull(), apart).otherwise(certain)


#: What a root says of its paths, as a column: the fields of ``NamingTemplate``.
RULE = "struct<template:string,fallback:array<string>,uncertain_folder:string,keep_original_name:boolean>"


def rule_column(rule: Column | None = None) -> Column:
    """A root's JSON text as a rule; what it leaves out, and all of a null or malformed one, is as by default."""

    def whole(held: Column) -> Column:
        return F.struct(
            F.coalesce(held["template"], F.lit(DEFAULT_TEMPLATE)).alias("template"),
            F.coalesce(held["fallback"], F.array(*map(F.lit, FALLBACK))).alias("fallback"),
            F.coalesce(held["uncertain_folder"], F.lit(UNCERTAIN_FOLDER)).alias("uncertain_folder"),
            F.coalesce(held["keep_original_name"], F.lit(True)).alias("keep_original_name"),
        )

    return once(F.from_json(rule if rule is not None else F.lit(None).cast("string"), RULE), whole)


def template_path_by(root: str, source: Column, ts: Column, uncertain: Column, item_id: Column, event: Column, place: Column, person: Column, rule: Column) -> Column:
    """``template_path`` where each row has its own template: ``rule`` is a column of ``rule_column``.

    The template is cut before and after its tokens, and each piece is itself or what a map has for the token, so rows of
    many roots are planned in one frame whatever their number of templates.
    """
    ext, original = F.regexp_extract(source, r"[^/](\.[^./]*)$", 1), media.stem(source)
    token = r"^\{(\w+)\}$"
    given_ = F.struct(*[c.alias(n) for n, c in date_tokens(ts).items()], rule.alias("rule"), original.alias("original"), given(event).alias("event"), given(place).alias("named_place"), place.alias("place"))

    def named(g: Column) -> Column:
        """The rule and what the tokens stand for."""
        date, fallback = F.concat_ws("-", g["yyyy"], g["MM"], g["dd"]), g["rule"]["fallback"]
        name = lambda k: F.when(k == "event", g["event"]).when(k == "place", g["named_place"]).when(k == "date", date)
        first = F.get(F.filter(F.transform(fallback, name), lambda x: x.isNotNull()), F.lit(0))
        return F.struct(*[g[n].alias(n) for n in ("yyyy", "MM", "dd", "HHmmss", "rule", "original", "place")], F.coalesce(first, date).alias("event"))

    def path(n: Column) -> Column:
        known = {k: n[k] for k in ("yyyy", "MM", "dd", "HHmmss", "event")} | {"place": F.coalesce(n["place"], n["event"]), "person": F.coalesce(person, F.lit("")), "original": F.when(n["rule"]["keep_original_name"], n["original"]).otherwise("")}
        pieces = F.split(n["rule"]["template"], r"(?=\{\w{1,64}\})|(?<=\})")

        def piece(p: Column) -> Column:
            own = F.lit("")
            for name, value in known.items():
                own = F.when(p == F.lit("{" + name + "}"), F.coalesce(value, F.lit(""))).otherwise(own)
            return F.when(p.rlike(token), own).otherwise(p)

        raw = F.array_join(F.transform(pieces, piece), "")
        parts = F.transform(F.split(raw, "/"), lambda s: F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", ""))
        parts = F.transform(F.filter(parts, lambda s: F.trim(s) != ""), sanitize_segment)
        certain = once(parts, lambda parts: F.concat(F.lit(root + "/"), F.array_join(F.when(F.size(parts) > 0, parts).otherwise(F.array(item_id)), "/"), ext))
        apart = F.concat(F.lit(f"{root}/"), sanitize_segment(n["rule"]["uncertain_folder"]), F.lit("/"), sanitize_segment(F.when(n["rule"]["keep_original_name"], n["original"]).otherwise(item_id)), ext)
        return F.when(F.coalesce(uncertain, F.lit(False)) | ts.isNull(), apart).otherwise(certain)

    return once(given_, lambda g: once(named(g), path))


def target_path(root: str, source: Column, ts: Column, event: Column, place: Column, item_id: Column, rule: NamingRule = NamingRule()) -> Column:
    """``root/yyyy/yyyy-MM-dd_name/yyyy-MM-dd_HHmmss_original.ext``, each part by ``rule``; without a date in a folder "unknown"."""
    t = date_tokens(ts)
    date = F.concat_ws("-", t["yyyy"], t["MM"], t["dd"])
    name = sanitize_segment(resolve_event(ts, event, place))
    original = sanitize_segment(media.stem(source)) if rule.keep_original_name else None
    stamped = F.concat_ws("_", date, t["HHmmss"])
    parts = [c for c in (stamped if rule.date_time_prefix else None, original) if c is not None]
    file = F.concat(F.concat_ws("_", *parts) if parts else item_id, F.regexp_extract(source, r"[^/](\.[^./]*)$", 1))
    folders = [c for c in (t["yyyy"] if rule.year_folder else None, F.concat_ws("_", date, name) if rule.date_event_folder else None) if c is not None]
    known = F.concat_ws("/", F.lit(root), *folders, file)
    plain = F.concat(original if original is not None else item_id, F.regexp_extract(source, r"[^/](\.[^./]*)$", 1))
    return F.when(ts.isNull(), F.concat_ws("/", F.lit(root), F.lit(UNKNOWN_FOLDER), plain)).otherwise(known)


# Words of story titles, after a place and alone.
MEMORIES, MEMORIES_ALONE = "の思い出", "思い出"


def event_title(start: Column, place: Column, count: Column) -> Column:
    """The UTC date with the place, or with the number of pictures; without a date the place alone."""
    date = F.date_format(start, "y年M月d日")
    by_place = F.when(given(place).isNotNull(), F.concat(place, F.lit(MEMORIES))).otherwise(F.lit(MEMORIES_ALONE))
    dated = F.when(given(place).isNotNull(), F.concat(date, F.lit(" "), place)).otherwise(F.concat(date, F.lit(f"{MEMORIES}（"), count.cast("string"), F.lit("枚）")))
    return F.when(start.isNull(), by_place).otherwise(dated)
