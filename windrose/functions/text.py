"""Column functions that clean identifiers, names, dates, times and statuses. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must agree with data that was labelled by these lists, orders included.
ISO_PREFIXES = (
    "AUS", "GBR", "NZL", "USA", "FRA", "GER", "IRL", "NED", "ITA", "ESP", "BEL", "SWE", "NOR", "DEN", "FIN", "POL",
    "CRO", "SLO", "RUS", "HKG", "JPN", "KOR", "SIN", "RSA", "ARG", "BRA", "CAN", "CHI", "POR", "CZE", "HUN", "TUR",
    "ISR", "GRE", "SUI", "MLT", "CYP", "MON", "LUX", "EST", "LAT", "LTU", "ROU", "BUL", "UKR", "MAS", "PHI", "THA",
)
LETTER_COUNTRIES = {"D": "GER", "F": "FRA", "I": "ITA", "E": "ESP", "B": "BEL", "S": "SWE", "N": "NOR", "K": "GBR", "Z": "NZL", "J": "JPN", "H": "HKG"}
LISTING_PREFIXES = (
    "AUS", "GBR", "IRL", "FRA", "NZL", "FIN", "NED", "D", "JPN", "USA", "ESP", "ITA", "BEL", "DEN", "SWE", "NOR",
    "HKG", "RSA", "CAN", "POR", "GER", "SUI", "POL", "CRO", "GRE", "TUR", "RUS", "CHN", "SIN", "MAS", "THA",
)
CLASS_PREFIXES = (
    "EAUS", "YAUS", "JAUS", "MAUS", "DAUS", "VAUS", "ENGR", "RPAYC", "RSYS", "CYCA", "MHYC", "SYD", "HYC", "MH", "SM",
    "FB", "YC", "PACER", "E", "Y", "J", "M", "D", "V", "A", "B", "C", "G", "R", "Z",
)
STATUS_CODES = ("DNF", "DNS", "DNC", "DSQ", "RET", "OCS", "RAF", "RDG", "ZFP")


def C(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_hit(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds, else null."""
    (cond, value), *rest = cases
    return reduce(lambda acc, c: acc.when(*c), rest, F.when(cond, value))


def normalize_sail(s: str | Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(C(s), F.lit("")))), r"[\s\-./]+", "")


def _after_prefix(s: Column, prefixes: tuple[str, ...]) -> Column:
    """What follows the listed prefix that stands before a digit: prefixes are letters, so there is one at most."""
    return F.nullif(F.regexp_extract(s, rf"(?s)^(?:{'|'.join(prefixes)})([0-9].*)", 1), F.lit(""))


def strip_country(s: Column) -> Column:
    return _after_prefix(s, ISO_PREFIXES)


def sail_candidates(s: str | Column) -> Column:
    """The normalised form, then AUS + number, then the number where a class prefix stands before it."""
    return _candidates(normalize_sail(s))


def _candidates(norm: Column) -> Column:
    bare = _after_prefix(norm, CLASS_PREFIXES)
    found = F.array_distinct(F.array_compact(F.array(norm, F.concat(F.lit("AUS"), bare), bare)))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(found)


def sail_tokens(s: str | Column) -> Column:
    """Sorted distinct tokens of a sail string; several numbers may be joined by & , ; or |."""
    chunks = F.filter(F.transform(F.split(F.coalesce(C(s), F.lit("")), "[&,;|]"), lambda c: F.trim(c)), lambda c: c != "")
    each = F.transform(F.transform(chunks, normalize_sail), lambda n: F.concat(_candidates(n), F.array_compact(F.array(n, strip_country(n)))))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(each), lambda t: t != "")))


def normalize_name(s: str | Column) -> Column:
    cut = F.regexp_replace(F.upper(F.trim(F.coalesce(C(s), F.lit("")))), r"\s*-\s*SEC$", "")
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def ambiguous_sail(s: str | Column) -> Column:
    return normalize_sail(s).rlike(r"^[0-9]{0,4}$") & (normalize_sail(s) != "")


def hull_number(s: str | Column) -> Column:
    return F.regexp_replace(F.upper(C(s)), "[^0-9]", "")


def country_of_office(c: str | Column) -> Column:
    return F.when(C(c) != "MU_", C(c))


def country_from_sail(s: str | Column) -> Column:
    """By ISO code or, failing that, a single letter; a digit must follow."""
    u = F.upper(F.trim(C(s)))
    return first_hit([(u.rlike(f"^{p}[0-9]"), F.lit(p)) for p in ISO_PREFIXES] + [(u.rlike(f"^{p}[0-9]"), F.lit(c)) for p, c in LETTER_COUNTRIES.items()])


def country_from_listing(s: str | Column) -> Column:
    """By a listed prefix, longest first; no letter may follow."""
    u = F.upper(C(s))
    return first_hit([(u.rlike(rf"^{p}([^\p{{L}}].*)?$"), F.lit("GER" if p == "D" else p)) for p in sorted(LISTING_PREFIXES, key=len, reverse=True)])


def design_from_hull(lh: str | Column, beam: str | Column) -> Column:
    fits = C(lh).cast("double").between(9.93, 10.06) & C(beam).cast("double").between(3.33, 3.43)
    return F.when(fits, "Sunfast 3300")


def is_secondary(name: str | Column, flag: str | Column) -> Column:
    return F.coalesce(C(name).rlike(r"(?i)\s+-\s+SEC\s*$"), F.lit(False)) | (F.upper(F.trim(F.coalesce(C(flag), F.lit("")))).isin("Y", "YES", "TRUE", "1"))


def clean_name(name: str | Column) -> Column:
    return F.trim(F.regexp_replace(C(name), r"(?i)\s+-\s+SEC\s*$", ""))


def stripped(s: str | Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(C(s), r"^\s+|\s+$", "")


def safe_number(s: str | Column) -> Column:
    return F.trim(C(s)).try_cast("double")


def safe_int(s: str | Column) -> Column:
    """Through a number with a fraction, which is cut off."""
    return F.trim(C(s)).try_cast("double").try_cast("int")


def first_present(*columns: str | Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(C(c)), F.lit("")) for c in columns])


def flexible_date(s: str | Column) -> Column:
    t = F.trim(C(s))
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.substring(t, 1, 10))
    heading = F.nullif(F.regexp_extract(t, r"\((\d{1,2}/\d{1,2}/\d{4})\)", 1), F.lit(""))
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in formats] + [F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), F.try_to_timestamp(heading, F.lit("d/M/yyyy"))]
    return F.coalesce(*tries).cast("date")


def elapsed_seconds(s: str | Column) -> Column:
    """Seconds of 'D - H:M:S', 'D:H:M:S', 'H:M:S' or 'M:S'; hours may exceed a day's."""
    t = F.trim(C(s))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i).cast("long")
    days, four, three, two = r"^(\d+)\s*-\s*(\d+):(\d+):(\d+)$", r"^(\d+):(\d+):(\d+):(\d+)$", r"^(\d+):(\d+):(\d+)$", r"^(\d+):(\d+)$"
    dhms = lambda p: part(p, 1) * 86400 + part(p, 2) * 3600 + part(p, 3) * 60 + part(p, 4)
    return first_hit([
        (t.rlike(days), dhms(days)),
        (t.rlike(four), dhms(four)),
        (t.rlike(three), part(three, 1) * 3600 + part(three, 2) * 60 + part(three, 3)),
        (t.rlike(two), part(two, 1) * 60 + part(two, 2)),
    ])


def derive_status(raw: str | Column, place: str | Column) -> Column:
    """From a result's raw map: a known code; else the finish time, where a key without value differs from no key."""
    code = F.upper(F.trim(F.coalesce(F.try_element_at(C(raw), F.lit("status")), F.lit(""))))
    timed = F.map_contains_key(F.coalesce(C(raw), F.expr("map('', '')")), "finish_time")
    unset = F.coalesce(F.try_element_at(C(raw), F.lit("finish_time")), F.lit("")) == ""
    return F.when(code.isin(*STATUS_CODES), code).when(timed & unset & C(place).isNull(), "DNF").otherwise("finished")


def status_in_text(s: str | Column, codes: tuple[str, ...] = STATUS_CODES) -> Column:
    """The first code, in the given order, that the text holds."""
    u = F.upper(F.coalesce(C(s), F.lit("")))
    return F.coalesce(first_hit([(u.contains(c), F.lit(c)) for c in codes]), F.lit("finished"))


def ordinal(n: str | Column) -> Column:
    v = C(n)
    suffix = F.when((v % 100).between(11, 13), "th").when(v % 10 == 1, "st").when(v % 10 == 2, "nd").when(v % 10 == 3, "rd").otherwise("th")
    return F.concat(v.cast("string"), suffix)


# What the names of offshore races hold.
OFFSHORE = "offshore|coastal|passage|sydney.*hobart|gladstone"


def race_bucket(s: str | Column) -> Column:
    """twilight, offshore, or series for all other events, those without a name included."""
    t = F.lower(F.coalesce(C(s), F.lit("")))
    return F.when(t.contains("twilight"), "twilight").when(t.rlike(OFFSHORE), "offshore").otherwise("series")


def trigrams(s: str | Column) -> Column:
    """The set of three-letter pieces of the padded lower-case words."""
    words = F.filter(F.split(F.lower(F.coalesce(C(s), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pieces = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, pieces)))


def trigram_similarity(a: str | Column, b: str | Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def canonical(s: str | Column, aliases: dict[str, str]) -> Column:
    """By an alias table, else in capitalised words if written all in capitals."""
    t = F.trim(C(s))
    mapped = F.create_map(*[F.lit(x) for kv in aliases.items() for x in (kv[0].lower(), kv[1])])
    return F.coalesce(F.try_element_at(mapped, F.lower(t)), F.when(t == F.upper(t), F.initcap(t)).otherwise(t))


def url_domain(url: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(C(url), F.lit("HOST"))), r"^www\.", "")


def numbers_in(s: str | Column) -> Column:
    """The numbers of a text, without thousands commas."""
    return F.transform(F.regexp_extract_all(C(s), F.lit(r"[-+]?\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").cast("double"))


def latin_key(s: str | Column) -> Column:
    return F.regexp_replace(F.lower(C(s).cast("string")), "[^a-z0-9]+", "")


def class_sections(s: str | Column, min_chars: int = 10_000, min_headers: int = 2, min_rows: int = 40) -> Column:
    """A page split at its class headings where it is long enough to need it: array<struct<offset, body>>; else the
    page as one section."""
    t, heading = C(s), r"(?m)^#{1,4} .*\b[Cc]lass\b.*$"
    wanted = (F.length(t) >= min_chars) & (F.regexp_count(t, F.lit(heading)) >= min_headers) & (F.regexp_count(t, F.lit(r"(?m)^\|")) >= min_rows)
    parts = F.split(t, r"(?m)(?=^#{1,4} .*\b[Cc]lass\b)")
    sized = F.transform(parts, lambda p, i: F.struct(F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)).alias("offset"), p.alias("body")))
    return F.when(wanted, sized).otherwise(F.array(F.struct(F.lit(0).alias("offset"), t.alias("body"))))
