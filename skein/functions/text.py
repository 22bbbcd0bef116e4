"""Scalar functions over text, time and place as Column builders (F rows)."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 8 << 20

#: Keyword categories of the loaded-language scan.
CATEGORIES = {
    "declaration": r"\b(i love you|i'?m in love|in love with you|i want you|date me|would you date|will you|marry me|be with me)\b",
    "attraction": r"\b(crush|attracted|hot|gorgeous|beautiful|sexy|fall(?:ing)? for|fell for|i fancy)\b",
    "vulnerability": r"\b(i'?m scared|i'?m afraid|i feel alone|lonely|i miss you|i'?m sorry|forgive me|ashamed|guilty|guilt|i was wrong)\b",
    "conflict": r"\b(we need to talk|i'?m angry|frustrat|fight|argument|hurt me|disappointed|breakup|broke up|broken up|over it|over you|done with this)\b",
    "patterns": r"\b(pattern|orbit|witness|cuck|core|substance|projection|projecting|attachment style|avoidant|anxious)\b",
    "reflection": r"\b(i think i|realize|realising|realizing|noticed that i|been thinking about|on my mind)\b",
    "care": r"\b(are you ok|you ok|are u ok|hope you|take care|here for you|i got you|i'?m here|sending love|thinking of you|proud of you|missed you)\b",
    "body": r"\b(sick|fever|surgery|hospital|injury|hurt my|broke my|sprain|tear|tendon)\b",
}
#: Meet-up markers, matched on lower-cased text.
MARKERS = (
    r"\bomw\b", r"\botw\b", r"\bon my way\b", r"\bi'?m here\b", r"\bwe'?re here\b", r"\bhere now\b", r"\bi'?m outside\b", r"\boutside now\b", r"\bout front\b",
    r"\bsee (?:you|u) (?:there|soon|at|in)\b", r"\bbe there (?:in|by|at)\b", r"\bleaving now\b", r"\bjust left\b", r"\balmost there\b", r"\bmins? away\b", r"\bminutes away\b",
    r"\bwhat'?s the address\b", r"\bsend (?:me )?the address\b", r"\brunning late\b",
)
#: Needles of hedging and asking.
HEDGE = ("i feel like", "i don't know", "i don't think", "i'm not sure", "maybe i")
ASKING = ("do u ", "r u ", "are u ", "where r u", "what r u", "do you ", "where are you")
#: Trailing notes that exports add to a message.
FOOTERS = (r"(?i)\n+\s*This message responded to an earlier message\.?\s*$", r"(?is)\n+\s*Tapbacks?:.*$", r"(?is)\n+\s*[A-Z][a-z]{2} \d{1,2}, \d{4}\s+\d{1,2}:\d{2}:\d{2}\s*[AP]M.*$")
#: Birthday greetings.
GREETING = r"happy birthday|(^|[^a-z0-9_])hbd([^a-z0-9_]|$)|happy b'?day|🎂"
EARTH_KM = 6371.0


def meaningful(body: Column, attachment: Column) -> Column:
    """F-01: a message with content of its own."""
    b = F.coalesce(body, F.lit(""))
    link = b.startswith("http") & (F.size(F.split(b, r"\s+", -1)) < 3)
    return (b != "") & attachment.isNull() & ~b.rlike(r"^Reacted |^Liked |sent an attachment\.?$|^Tapback") & ~link


def repair(text: Column) -> Column:
    """F-02: latin-1 bytes read again as UTF-8; bad sequences become U+FFFD.

    A text is decoded at a time, from Arrow batches bounded by bytes, so that a task holds no more of long texts than of short ones.
    """
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    @F.arrow_udf("string")
    def again(texts: pa.Array) -> pa.Array:
        # the low byte of each character is every fourth one of UTF-32
        return pa.array((None if t is None else t.encode("utf-32-le")[::4].decode("utf-8", "replace") for t in (x.as_py() for x in texts)), pa.string())

    return again(text)


def at(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso(ms: Column) -> Column:
    """F-03: milliseconds as ISO text, UTC."""
    return F.date_format(at(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def contains_like(text: Column, query: str) -> Column:
    """F-05: case-insensitive LIKE '%query%'; wildcards in the query count."""
    return text.ilike(f"%{query}%")


def word_match(text: Column, query: str) -> Column:
    """F-06: the query as a whole word of the visible text, links left out."""
    seen = F.regexp_replace(F.lower(text), r"https?://\S+", " ")
    return seen.rlike(f"(?<![a-z0-9]){re.escape(query.lower())}(?![a-z0-9])")


def week_index(ts: Column) -> tuple[Column, Column]:
    """F-14: year of the week's Monday, and weeks since the Monday of that year's first of January."""
    monday = F.to_date(F.date_trunc("week", ts))
    first = F.to_date(F.date_trunc("week", F.make_date(F.year(monday), F.lit(1), F.lit(1)).cast("timestamp")))
    return F.year(monday), F.floor(F.datediff(monday, first) / 7).cast("int")


def redacted(columns: Iterable[Column], patterns: Iterable[str]) -> Column:
    """F-18: whether any of the columns matches any pattern."""
    hit = F.lit(False)
    for c in columns:
        for p in patterns:
            hit = hit | F.coalesce(c.rlike(p), F.lit(False))
    return hit


def row_redacted(patterns: Iterable[str]) -> Column:
    """F-19: whether the row as JSON text matches."""
    return redacted([F.to_json(F.struct("*"))], patterns)


def preview(text: Column, limit: int = 500) -> tuple[Column, Column]:
    """F-20: the first characters, and whether more were cut."""
    return F.substring(text, 1, limit), F.length(text) > limit


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_footers(text: Column) -> Column:
    """F-21."""
    out = F.coalesce(text, F.lit(""))
    for p in FOOTERS:
        out = F.regexp_replace(out, p, "")
    return strip(out)


def any_of(text: Column, needles: Iterable[str]) -> Column:
    """F-22: any needle in the lower-cased text."""
    low, hit = F.lower(F.translate(text, "’", "'")), F.lit(False)
    for n in needles:
        hit = hit | low.contains(n)
    return hit


def categories(text: Column) -> Column:
    """F-23: names of the keyword categories that a body of 10 to 400 characters falls in."""
    named = F.array(*[F.when(F.lower(text).rlike(p), F.lit(name)) for name, p in CATEGORIES.items()])
    return F.when(F.length(text).between(10, 400), F.array_compact(named)).otherwise(F.array().cast("array<string>"))


def marker(text: Column) -> Column:
    """F-24: whether a meet-up marker stands in the text."""
    return F.lower(F.translate(text, "‘’", "''")).rlike("|".join(MARKERS))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """F-25: kilometres over the sphere."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lng2 - lng1) / 2) ** 2
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def rolling_hash(text: Column) -> Column:
    """F-26: the 31-based string hash in signed 32 bits, for characters of the basic plane."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrapped(h * 31 + c))


def round_half_up(x: Column, scale: int = 1) -> Column:
    """F-27 and rounding in general: half goes towards plus infinity."""
    return F.floor(x * scale + 0.5) / scale


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def is_handle(text: Column) -> Column:
    """F-28: an address rather than a name: an e-mail, or seven digits at least and no letters."""
    return text.contains("@") | ((F.length(digits(text)) >= 7) & ~text.rlike("[A-Za-z]"))


def name_forms(name: Column) -> Column:
    """F-29: first token and full form (40 characters at most) of a nameable alias, lower-cased; decoration counts as a space."""
    name = F.trim(name)
    clean = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}\s'.-]", " "))
    first = F.regexp_extract(clean, r"^\S+", 0)
    usable = ~name.rlike(r"^[+\d]") & ~name.contains("@") & (F.length(name) >= 3) & (F.length(clean) >= 3)
    forms = F.array(F.when((F.length(first) >= 3) & first.rlike(r"\p{L}"), F.lower(first)), F.when(F.length(clean) <= 40, F.lower(clean)))
    return F.when(usable, F.array_distinct(F.array_compact(forms))).otherwise(F.array().cast("array<string>"))


def iso_ms(text: Column) -> Column:
    """F-17: an ISO bound in milliseconds: a date is its midnight in UTC, digits are milliseconds already; what is neither is an error."""
    zoned = F.try_to_timestamp(F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(text))
    found = F.when(text.rlike(r"^-?\d+$"), text.try_cast("long")).otherwise(F.unix_millis(zoned))
    return F.when(text.isNull(), F.lit(None).cast("long")).when(found.isNull(), F.raise_error(F.concat(F.lit("bad date: "), text)).cast("long")).otherwise(found)


def alphabetic_forms(name: Column) -> Column:
    """F-30: stricter forms: letters only, and not all lower case."""
    ok = name.rlike(r"^[\p{L}][\p{L}' -]+$") & (name != F.lower(name))
    return F.when(ok, F.array_distinct(F.array(name, F.substring_index(name, " ", 1)))).otherwise(F.array().cast("array<string>"))


def normal_quote(text: Column) -> Column:
    """F-31: straight quotes and dashes, single spaces, lower case."""
    straight = F.translate(strip_footers(text), "‘’“”–— ", "''\"\"-- ")
    return F.trim(F.lower(F.regexp_replace(straight, r"\s+", " ")))


def slug(text: Column) -> Column:
    """F-34."""
    return F.regexp_replace(text, r"[^\w-]+", "_")


def label_category(labels: Column) -> Column:
    """F-35: the first 'Category X' label, as x."""
    found = F.filter(labels, lambda x: x.rlike(r"^Category "))
    return F.lower(F.regexp_extract(F.get(found, F.lit(0)), r"^Category (.+)$", 1))


def url_key(text: Column) -> Column:
    """F-36: base64url without padding, in one line (Spark breaks base64 after 76 characters)."""
    return F.translate(F.base64(text.cast("binary")), "+/=\r\n", "-_")
