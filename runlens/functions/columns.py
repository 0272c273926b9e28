"""Derived columns: query texts, paths, confidences. All are pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence of the labels, of the two last fallbacks, and the display bands.
LABELS = {"High": 95.0, "Normal": 75.0}
OTHER_LABEL, BEST_MATCH, FIRST_AVAILABLE = 50.0, 50.0, 30.0
SUCCESS, WARNING = 80.0, 60.0


def or_empty(c: Column) -> Column:
    """Absent fields are empty strings."""
    return F.coalesce(c.cast("string"), F.lit(""))


def query_text(service: Column, category: Column, snippet: Column) -> Column:
    return F.concat(or_empty(service), F.lit(" "), or_empty(category), F.lit(" "), or_empty(snippet))


def training_text(service: Column, category: Column, snippet: Column, cause: Column, with_cause: bool = True) -> Column:
    text = query_text(service, category, snippet)
    return F.concat(text, F.lit(" "), or_empty(cause)) if with_cause else text


def document_text(path: Column, content: Column) -> Column:
    return F.concat(F.lit("Filename: "), base_name(path), F.lit("\nContent: "), or_empty(content))


def target_path(root: str, service: Column, category: Column) -> Column:
    return F.concat(F.lit(f"{root}/services/"), F.lower(or_empty(service)), F.lit("/"), or_empty(category), F.lit(".md"))


def normal_path(path: Column) -> Column:
    """Slashes one way, no empty, `.` or `..` segments, one `services` segment instead of two; a relative path keeps the `..` that lead out of it."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, "/(\\./)+", "/")
    p = F.regexp_replace(p, "/+", "/")
    parts = F.split(p, "/")

    def add(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        at_root = (F.size(done) == 1) & (last == "")  # nothing lies above the root
        back = F.when(at_root, done).when((F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
        return F.when(part == "..", back).otherwise(F.array_append(done, part))

    walked = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), add), "/")
    p = F.when(F.array_contains(parts, ".."), F.when(walked != "", walked).when(p.startswith("/"), "/").otherwise(".")).otherwise(p)
    return F.regexp_replace(p, "/services/services/", "/services/")


def segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"\\", "/"), "/")


def base_name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(path), F.lit(-2)), F.lit("unknown"))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def parsed_confidence(number: Column, label: Column) -> Column:
    """A number is itself; High and Normal have theirs; every other label is in the middle."""
    named = F.lit(OTHER_LABEL)
    for name, value in LABELS.items():
        named = F.when(label == name, F.lit(value)).otherwise(named)
    return F.coalesce(number.cast("double"), named)


def band(confidence: Column) -> Column:
    return F.when(confidence >= SUCCESS, "success").when(confidence >= WARNING, "warning").otherwise("error")


def percent(confidence: Column) -> Column:
    return F.format_string("%.2f%%", confidence)


def size_text(content: Column) -> Column:
    return F.concat(F.length(or_empty(content)).cast("string"), F.lit(" chars"))


def record_id(line: Column) -> Column:
    return F.concat(F.lit("err_"), line.cast("string"))


def correction_id(*parts: Column) -> Column:
    """Eight hex digits of what the correction says: the same correction has the same id."""
    return F.concat(F.lit("fix_"), F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 8))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def local_time(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss")


def stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
