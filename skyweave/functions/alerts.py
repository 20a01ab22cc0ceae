"""Airspace alert rules, prompts and answers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The commands that an answer may give, how its reason begins,
# and the names of the verdicts below.
COMMANDS = ("悬停", "原地降落", "返航", "正常飞行")
REASON = "理由:"
REASON_CHARS = 50
LOW_BATTERY, CRITICAL_BATTERY, SEPARATION = 20, 15, 50
#: What ends a line, and what is trimmed.
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_OUTER_SPACE = r"(?U)^\s+|\s+$"


def nearest(nearby: Column) -> Column:
    """The nearest object (id, min_sep_m), the first of equally near ones;
    NONE at 999 where there is none."""
    placed = F.transform(nearby, lambda x, i: F.struct(x["min_sep_m"].alias("min_sep_m"), i.alias("i"), x["id"].alias("id")))
    best = F.array_min(placed)
    return F.struct(F.coalesce(best["id"], F.lit("NONE")).alias("id"), F.coalesce(best["min_sep_m"], F.lit(999)).alias("min_sep_m"))


def any_of(items: Column, *flags: str) -> Column:
    """Whether a flag of any item is 1."""
    test = lambda x: F.coalesce(sum(((x[f] == 1).cast("int") for f in flags[1:]), (x[flags[0]] == 1).cast("int")) > 0, F.lit(False))
    return F.coalesce(F.exists(items, test), F.lit(False))


def alerts(nearby: Column, zones: Column, battery: Column) -> dict[str, Column]:
    """A1 in a zone, A2 conflicting route nearer than the separation, A3 low
    battery, A4 none of these; 0 or 1 each."""
    a1 = any_of(zones, "inside_zone", "over_limit_alt")
    a2 = any_of(nearby, "route_intersect") & (nearest(nearby)["min_sep_m"] < SEPARATION)
    a3 = F.coalesce(battery < LOW_BATTERY, F.lit(False))
    flags = {"A1": a1, "A2": a2, "A3": a3, "A4": ~(a1 | a2 | a3)}
    return {k: v.cast("int") for k, v in flags.items()}


def listed(items: Column, render) -> Column:
    """Items as lines, or (none)."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "(none)").otherwise(F.array_join(F.transform(items, render), "\n"))


def prompt(uav_id: Column, battery: Column, nearby: Column, zones: Column, place: Column | None = None) -> Column:
    """A situation as text; ``place`` (lat, lon, alt_m, speed_mps) adds where
    it is and, with the thresholds, what of it is an alert."""
    near = listed(nearby, lambda x: F.format_string("- %s sep=%dm route=%d", x["id"], x["min_sep_m"], x["route_intersect"]))
    zone = listed(zones, lambda z: F.format_string("- %s inside=%d over=%d", z["zone_id"], z["inside_zone"], z["over_limit_alt"]))
    best = nearest(nearby)
    text = F.format_string("%s battery=%d%%\nnearest=%s at %dm\nnearby (%d):\n%s\nzones (%d):\n%s", uav_id, battery, best["id"], best["min_sep_m"], F.size(nearby), near, F.size(zones), zone)
    if place is None:
        return text
    where = F.format_string("\nat %.5f, %.5f, %dm, %dm/s", place["lat"], place["lon"], place["alt_m"], place["speed_mps"])
    flags = F.format_string("\nroute=%d low=%d critical=%d separation=%dm", any_of(nearby, "route_intersect").cast("int"), (battery < LOW_BATTERY).cast("int"), (battery < CRITICAL_BATTERY).cast("int"), F.lit(SEPARATION))
    return F.concat(text, where, flags)


def check_answer(uav_id: Column, answer: Column, long_reasons: bool = False) -> Column:
    """``ok``, or what is wrong with an answer: two lines, the first
    ``<id>，请<command>``, the second a reason.  Reasons over 50 characters
    are refused unless ``long_reasons``; null is ``empty``."""
    trimmed = lambda x: F.regexp_replace(x, _OUTER_SPACE, "")
    lines = F.filter(F.transform(F.split(answer, _LINE_END), trimmed), lambda x: x != "")
    said = lambda x: F.regexp_extract(F.get(x, F.lit(0)), rf"^([A-Za-z0-9_]+)，请(?:{'|'.join(COMMANDS)})$", 1)

    def verdict(x: Column) -> Column:
        second, who = F.get(x["lines"], F.lit(1)), x["who"]
        out = F.when(F.size(x["lines"]) != 2, "not_two_lines").when(who == "", "bad_first_line").when(who != uav_id, "uav_id_mismatch").when(~second.startswith(REASON), "bad_reason_prefix")
        reason = trimmed(F.substr(second, F.lit(len(REASON) + 1)))
        return (out if long_reasons else out.when(F.char_length(reason) > REASON_CHARS, "reason_too_long")).otherwise("ok")

    # arrays of one, so that lines are split once and not in every branch
    parts = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), said(x).alias("who")))
    return F.when(answer.isNull(), "empty").otherwise(F.get(F.transform(parts, verdict), F.lit(0)))
