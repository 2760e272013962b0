"""Text rules of drawings as column expressions: labels, line numbers, sheet references, reviewer answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and limits that results depend on.
LINE_ID = r"(?u)\b([A-ZА-Я]{1,4}\d{0,2})[_-](\d{4})\b"
SKIPPED_PREFIX = "RD"
PRIMARY_PREFIXES = ("LC", "CO", "BB", "CB")
COORDINATE_LABELS = ("X", "Y", "Z", "Z+")
DN = r"(?i)^DN\d+(X\d+)?$"
LINE_REF = r"(?u)\b[A-ZА-Я]{2}[_-]\d{4}\b"
FIVE_DIGITS, TWO_TO_FIVE_DIGITS = r"^\d{5}$", r"^\d{2,5}$"
NUMBER = r"^\d+([.,]\d+)?$"
LEAST_NUMBER, MOST_NUMBER = 1, 100_000
FORBIDDEN_NEIGHBOURS = ("X", "Y", "Z", "Z+", "Z-", "mm", "мм", "PE", "СМ.", "СМ", "CM.", "CM", "СЛИВ", "КОНДЕНСАТА", "КОНДЕНСАТ", "ПОДКЛЮЧЕНИЕ", "ПОДКЛЮЧЕНИЯ")
FORBIDDEN_STARTS = (r"DN\d+", r"DN\d+X\d+", r"\d+mm$", r"mm$", r"PE$", r"X\d+$", r"Y\d+$", r"Z[+\-]\d+$", r"V-\d+", r"[А-ЯA-Z]{2}[_-]\d+", r"BB\d+$", r"LC[_-]\d+", r"CO[_-]\d+", r"CB\d+$", r"EB\d+$", r"AB\d+$", r"DB\d+$")
SHEET_HINT = r"(?iu)(СМ\.?\s*ЛИСТ|СМ\.?\s*SHEET|SEE\s+SHEET|CONTINUATION|ЛИСТ\s*\d+|SHEET\s*\d+)"
HANDWHEEL_HINT = r"(?iu)(ШТУРВАЛ|РУКОЯТКА|РУКОЯТЬ|РУЧКА|МАХОВИК|КОЛЕСО|ТРОС|РЫЧАГ|HANDWHEEL|WHEEL|HANDLE|CRANK|LEVER)"
SHEET_NUMBERS = (r"(?iu)(?:ЛИСТ|SHEET)\s*[:№]?\s*(?:№\s*)?(\d+)", r"(?iu)(?:SEE\s+SHEET|CONTINUATION)\s*(?:[A-Z0-9\-_/]+\s+)?(\d+)")
TIE_IN = ("ПОДКЛЮЧЕНИЕ", "ПОДСОЕДИНЕНИЕ", "ВРЕЗКА", "TIE-IN", "TIE IN", "CONNECTION")
CONTINUATION = ("СМ.", "СМ ", "SEE SHEET", "SEE SHEET ", "CONTINUATION", "ЛИСТ", "SHEET")
CROSS_SHEET = r"(?iu)ЛИСТ\s*[:№]?\s*(?:№\s*)?(\d+)(?![\dXx×])"
CALLOUT = r"(^|\s)[ОO]\s*\d+\b"
CANDIDATE_ID = r"C-\d{3}-\d{4}"
SHORT_TEXT = 160


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def line_id(c: Column) -> Column:
    """T01"""
    return F.upper(F.replace(c, F.lit("-"), F.lit("_")))


def line_ids(c: Column) -> Column:
    """Distinct line numbers of a text, sorted, without those whose whole prefix is the skipped one."""
    found = F.transform(F.regexp_extract_all(c, F.lit(LINE_ID), F.lit(0)), lambda x: F.replace(x, F.lit("-"), F.lit("_")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.startswith(f"{SKIPPED_PREFIX}_"))))


def line_ids_unspaced(c: Column) -> Column:
    """T03"""
    return line_ids(F.replace(c, F.lit(" "), F.lit("")))


def primary_id(stamp: Column, ids: Column, page: Column) -> Column:
    """Stamp, then ids with an underscore by name, then by order of prefixes, then any, then a name from the page."""
    by_prefix = [F.get(F.filter(ids, lambda x, p=p: x.startswith(p)), F.lit(0)) for p in PRIMARY_PREFIXES]
    return F.coalesce(stamp, F.get(F.filter(ids, lambda x: F.contains(x, F.lit("_"))), F.lit(0)), *by_prefix, F.get(ids, F.lit(0)), F.format_string("UNKNOWN_%03d", page))


def candidate_kind(c: Column) -> Column:
    """Null for texts that are no candidates. Five digits are a coordinate, never a dimension."""
    t = F.translate(F.upper(F.trim(c)), "Х", "X")
    return F.when(t.isin(*COORDINATE_LABELS), "coordinate_label").when(t.rlike(DN), "dn").when(t.rlike(LINE_REF), "line_ref").when(t.rlike(FIVE_DIGITS), "coordinate_value").when(t.rlike(TWO_TO_FIVE_DIGITS), "dimension")


def zone(x: Column, y: Column, width: Column, height: Column) -> Column:
    """By the centre of a box."""
    return F.when(y >= 0.86 * height, "title_block").when((x >= 0.68 * width) & (y <= 0.72 * height), "materials_spec").when((x >= 0.68 * width) & (y <= 0.86 * height), "length_table").otherwise("drawing")


def number(c: Column) -> Column:
    """The value of a numeric label, null for others."""
    value = F.when(c.rlike(NUMBER), F.replace(c, F.lit(","), F.lit(".")).try_cast("double"))
    return F.when((value >= LEAST_NUMBER) & (value <= MOST_NUMBER), value)


def marks_coordinate(neighbour: Column) -> Column:
    """T10 of one neighbour; starts are anchored, ends only where the pattern says so."""
    return neighbour.isin(*FORBIDDEN_NEIGHBOURS) | F.contains(neighbour, F.lit("°")) | neighbour.rlike("^(" + "|".join(FORBIDDEN_STARTS) + ")")


def text_hints(c: Column) -> Column:
    """T13"""
    return F.array_compact(F.array(F.when(c.rlike(SHEET_HINT), F.lit("cross_sheet_reference")), F.when(c.rlike(HANDWHEEL_HINT), F.lit("handwheel"))))


def sheet_number(c: Column) -> Column:
    """The first pattern that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in SHEET_NUMBERS])


def connection_class(c: Column, strict: bool = True) -> Column:
    """struct(kind, sheet, hint); not strict: a bare continuation word is a hint too."""
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    tie = any_of([F.contains(t, F.lit(k)) for k in TIE_IN])
    sheet = sheet_number(c)
    bare = F.lit(False) if strict else any_of([F.contains(t, F.lit(k)) for k in CONTINUATION])
    kind = F.when(tie, "tie_in").when(sheet.isNotNull(), "continuation").otherwise("other")
    return F.struct(kind.alias("kind"), F.when(~tie, sheet).alias("sheet"), F.coalesce(~tie & (sheet.isNotNull() | bare), F.lit(False)).alias("hint"))


def cross_sheet_reference(c: Column) -> Column:
    """The sheet a text refers to; sizes such as 200X300X6 are none."""
    return F.nullif(F.regexp_extract(c, CROSS_SHEET, 1), F.lit("")).try_cast("int")


def positive(c: Column) -> Column:
    """T17"""
    v = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(v > 0, v)


def coordinate(label: Column, value: Column) -> Column:
    """Values under Z- are negative."""
    v = F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.upper(F.trim(label)) == "Z-", -F.abs(v)).otherwise(v)


def axis(label: Column) -> Column:
    """T19"""
    t = F.upper(F.trim(label))
    return F.when(t == "X", "x").when(t == "Y", "y").when(t.isin("Z", "Z+", "Z-"), "z")


def looks_like_reference(c: Column) -> Column:
    """Neither axis nor number, with a letter or a joining sign."""
    t = F.trim(c)
    return axis(t).isNull() & ~t.rlike(NUMBER) & t.rlike(r"[\p{L}\-_/]")


def branch_evidence(c: Column, markers: tuple[str, ...], negatives: tuple[str, ...]) -> Column:
    """Any marker tells; negatives count only where there is none."""
    t = F.lower(c)
    return F.when(any_of([F.contains(t, F.lit(m)) for m in markers]), True).when(any_of([F.contains(t, F.lit(n)) for n in negatives]), False)


def shortened(c: Column, most: int = SHORT_TEXT) -> Column:
    """T22"""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def is_callout(label: Column, has_point: Column) -> Column:
    """T23"""
    return ~has_point & label.rlike(CALLOUT)


def candidate_ids(c: Column) -> Column:
    """T24"""
    return F.regexp_extract_all(c, F.lit(CANDIDATE_ID), F.lit(0))


def page_key(page: Column, key: Column) -> Column:
    """Page:id, unless the id names a page already or is empty."""
    return F.when(key.isNull() | (key == "") | F.contains(key, F.lit(":")), key).otherwise(F.concat(page.cast("string"), F.lit(":"), key))


def sheet_key(c: Column) -> Column:
    """T26"""
    return F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"^[Ss](\d+)$", "$1")


def first_filled(*columns: Column) -> Column:
    """T27"""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def file_name(c: Column, default: str = "item") -> Column:
    """T28"""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), F.lit("_")), F.lit("")), F.lit(default))


def answer_object(c: Column) -> Column:
    """The JSON object in an answer, bare or fenced, as VARIANT; null where there is none."""
    parsed = F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def matches_search(c: Column, typed: Column) -> Column:
    """T30"""
    return F.contains(line_id(c), line_id(F.trim(typed)))


def rounded_point(p: Column) -> Column:
    """The first two numbers of an array to two places, null for shorter ones."""
    return F.when(F.size(p) >= 2, F.transform(F.slice(p, 1, 2), lambda v: F.round(v, 2)))
