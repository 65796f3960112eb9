"""Text parsing: durations, slugs, statuses, session names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"
#: Parts of a status that make an outcome; DNF_WORDS are for outcomes, the other lists for history.
DSQ_WORDS = ("DSQ", "DISQUAL")
DNF_WORDS = (
    "DNF", "DNS", "DNQ", "NC", "NOT CLASSIFIED", "NOTCLASSIFIED", "RETIRED", "WITHDREW", "ACCIDENT", "COLLISION", "SPUN OFF", "SPIN", "ENGINE", "GEARBOX",
    "TRANSMISSION", "BRAKES", "BRAKE", "SUSPENSION", "HYDRAULIC", "ELECTRICAL", "POWER UNIT", "COOLING", "PUNCTURE", "DAMAGE", "OVERHEAT",
)
HISTORY_DNF_WORDS = (
    "DNF", "ACCIDENT", "COLLISION", "ENGINE", "HYDRAULICS", "ELECTRICAL", "GEARBOX", "TRANSMISSION", "SUSPENSION", "BRAKES", "PUNCTURE", "OVERHEATING",
    "MECHANICAL", "EXHAUST", "CLUTCH", "WHEEL", "DRIVESHAFT", "STEERING", "FUEL", "OIL LEAK", "WATER PRESSURE", "POWER UNIT", "PU",
)
RETIRED_WORDS = ("RET", "DNF", "ACCIDENT", "COLLISION", "ENGINE", "GEARBOX", "HYDRAUL", "ELECTRICAL", "SUSPENSION", "CRASH", "POWER UNIT", "OVERHEATING")
NO_TIME_WORDS = ("NO TIME", "NO-TIME", "NOTIME", "DNS", "DNF", "DSQ", "DISQUAL", "EXCLUDED", "PENALTY", "PEN", "DELETED", "TRACK LIMITS")
MECHANICAL_WORDS = ("ENGINE", "GEAR", "HYDRAUL", "ELECT", "BRAKE", "SUSP", "CLUTCH", "OVERHEAT", "DRIVESHAFT", "EXHAUST", "FUEL", "TURBO", "POWER UNIT")
ACCIDENT_WORDS = ("ACCIDENT", "COLLISION", "SPUN OFF", "CRASH")
INCIDENT_WORDS = ("INCIDENT", "CRASH", "COLLISION", "SPIN", "DNF", "RETIRE", "CONTACT", "OFF", "WALL")
SESSIONS = {"race": "R", "qualifying": "Q", "sprint": "S", "sprint qualifying": "SQ", "sprint shootout": "SQ", "practice 1": "FP1", "practice 2": "FP2", "practice 3": "FP3"}


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.upper(text).rlike("|".join(words))


def clock_seconds(text: Column) -> Column:
    """``[d days ][h:]m:s[.f]``; null for what is none. One search a text, whose numbers (the first is the sign) are read at once: a
    projection that is too long is not compiled, and a cast that fails costs an exception a row. A lacking part is 0."""
    form = r"^\s*(-)?(?:(\d+) days?,? ?)?(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)\s*$"
    numbers = F.split(F.regexp_replace(F.translate(text, "|", "x"), form, "$11|0$2|0$3|0$4|0$5"), r"\|").try_cast("array<double>")
    part = lambda i: F.get(numbers, F.lit(i))
    return (part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)) * part(0)


def plain_number(text: Column) -> Column:
    """A number that is not NaN, else null. What has a colon is no number, and is not tried."""
    number = F.when(~text.contains(":"), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def duration_seconds(text: Column) -> Column:
    """``[d days ][h:]m:s[.f]`` or a plain number of seconds; null for what is neither."""
    return F.coalesce(clock_seconds(text), plain_number(text))


def duration_text(seconds: Column) -> Column:
    """``0 days 00:01:35.400000``, which ``duration_seconds`` reads; microseconds are rounded."""
    micros = F.round(F.abs(seconds) * 1e6).cast("long")
    part = lambda unit, many: (F.floor(micros / unit) % many).cast("int")
    two = lambda unit, many: F.lpad(part(unit, many).cast("string"), 2, "0")
    form = F.concat(F.floor(micros / 86_400_000_000).cast("string"), F.lit(" days "), two(3_600_000_000, 24), F.lit(":"), two(60_000_000, 60), F.lit(":"), two(1_000_000, 60), F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"))
    return F.when(seconds.isNotNull(), F.concat(F.when(seconds < 0, "-").otherwise(""), form))


def milliseconds(text: Column) -> Column:
    """A plain number is taken as milliseconds, a duration is converted."""
    number = text.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), 1000 * duration_seconds(text))


def slug_ascii(text: Column) -> Column:
    """Letters without accents and digits; all else becomes one underscore, none at the ends."""
    plain = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_word(text: Column) -> Column:
    """Letters of any alphabet stay; an empty slug is ``unknown``."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", "unknown").otherwise(slug)


def slug_space(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", "_")


def session_code(text: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(text)), r"[\s_]+", " ")
    return F.coalesce(*[F.when(key == name, F.lit(code)) for name, code in SESSIONS.items()], F.upper(F.trim(text)))


def boolean_text(text: Column) -> Column:
    value = F.upper(F.trim(text.cast("string")))
    return F.when(value.isin("TRUE", "1", "1.0", "YES"), True).when(value.isin("FALSE", "0", "0.0", "NO"), False)


def timestamp_mixed(text: Column, forms: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def outcome(status: Column, position: Column) -> Column:
    """finish, dnf or dsq: disqualified first, then finished or lapped, then retired, then any position."""
    s = F.upper(F.trim(status))
    return (F.when(any_word(status, DSQ_WORDS), "dsq").when(s.rlike(r"FINISHED|PLUS|^\+?\d+\s+LAPS?$"), "finish").when(any_word(status, DNF_WORDS), "dnf").when(position > 0, "finish").otherwise("dnf"))


def outcome_id(name: Column) -> Column:
    return F.when(name == "finish", 0).when(name == "dnf", 1).when(name == "dsq", 2)


def effective_position(name: Column, position: Column) -> Column:
    return F.when((name == "finish") & position.isNotNull(), position.cast("double")).when(name == "dsq", 25.0).otherwise(21.0)


def status_bucket(status: Column) -> Column:
    """A mechanical word counts before an accident's, both before a finish; ``+1 Lap`` is none of them, unlike ``+2 Laps``."""
    s = F.upper(status)
    kept = s.rlike(r"FINISHED|\+\d+ LAPS") & ~s.rlike("DISQUALIFIED|EXCLUDED")
    return F.when(any_word(s, MECHANICAL_WORDS), "mechanical").when(any_word(s, ACCIDENT_WORDS), "accident").when(kept, "finish").otherwise("other")


def history_dnf(status: Column) -> Column:
    """Whether a past result counts as not finished; null without a status."""
    return any_word(status, HISTORY_DNF_WORDS) | (F.upper(status) == "NC")


def stage_reached(q1: Column, q2: Column, q3: Column) -> Column:
    return F.when(q3.isNotNull(), 3).when(q2.isNotNull(), 2).when(q1.isNotNull(), 1).otherwise(0)


def race_id(y: Column, r: Column) -> Column:
    return y * 1000 + r


def row_stat(columns: list[Column], what: str) -> Column:
    """min, max, mean, std (of the population) or count of the non-null values of a row."""
    known = F.filter(F.array(*[c.cast("double") for c in columns]), lambda x: x.isNotNull())
    n = F.size(known)
    mean = F.when(n > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / n)
    if what == "count":
        return n
    if what == "mean":
        return mean
    if what == "std":
        return F.when(n > 0, F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n))
    return F.array_min(known) if what == "min" else F.array_max(known)
