"""Mailboxes and address data (S-12 to S-17, F-35)."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

BODY_LIMIT = 20_000
_MAIL = "message_id string, thrid string, refs string, ts long, from_addr string, from_name string, to_addrs array<string>, labels array<string>, list_unsubscribe boolean, kind string, body string"
_AUTOMATED = re.compile(r"^(no-?reply|do-?not-?reply|notifications?|mailer-daemon|bounce|alerts?)[@+.-]", re.I)


def _parse(raw: str) -> tuple | None:
    m = email.message_from_string(raw, policy=email.policy.compat32)
    labels = [x.strip() for x in re.sub(r"\s*\n\s*", " ", str(m.get("X-Gmail-Labels", ""))).split(",") if x.strip()]
    if {x.lower() for x in labels} & {"spam", "trash"}:
        return None
    name, addr = email.utils.parseaddr(str(m.get("From", "")))
    bulk = m.get("List-Unsubscribe") is not None or str(m.get("Precedence", "")).lower() in ("bulk", "list")
    kind = "bulk" if bulk else "automated" if _AUTOMATED.match(addr) else "human"
    date = email.utils.parsedate_to_datetime(m["Date"]) if m.get("Date") else None
    body = ""
    if kind == "human":
        part = next((p for p in m.walk() if p.get_content_type() == "text/plain"), None)
        body = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")[:BODY_LIMIT] if part else ""
    to = [a.lower() for _, a in email.utils.getaddresses([*map(str, m.get_all("To", [])), *map(str, m.get_all("Cc", []))]) if a]
    refs = f"{m.get('References', '')} {m.get('In-Reply-To', '')}".strip() or None
    return m.get("Message-ID"), m.get("X-GM-THRID"), refs, int(date.timestamp() * 1000) if date else 0, addr.lower(), name or None, to, labels, m.get("List-Unsubscribe") is not None, kind, body


def mbox(spark: SparkSession, glob: str) -> DataFrame:
    """S-12: messages of mbox files; spam and trash are left out, and only human mail keeps its body.

    Files are split at their separator lines by the reader, so a large mailbox is many tasks' work.
    """
    ship(spark)
    raw = spark.read.option("lineSep", "\nFrom ").text(glob)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [_parse(re.sub(r"^(From )?[^\n]*\n", "", text, count=1)) for text in frame["value"] if text.strip()]
            yield pd.DataFrame([r for r in rows if r], columns=[c.split(" ")[0] for c in _MAIL.split(", ")])

    return raw.mapInPandas(run, _MAIL)


def mail_threads(mails: DataFrame, own: list[str]) -> DataFrame:
    """S-13: threads of human mail that self took part in or anyone answered, with all others' addresses."""
    first = F.regexp_extract(F.coalesce("refs", F.lit("")), r"(<[^>]+>)", 1)
    key = F.coalesce("thrid", F.nullif(first, F.lit("")), "message_id", F.lit("nothrid"))
    m = mails.where("kind = 'human'").withColumn("thread_id", F.concat(F.lit("gmail:"), key))
    mine = F.col("from_addr").isin(own)
    people = F.array_union(F.array("from_addr"), "to_addrs")
    t = m.groupBy("thread_id").agg(F.bool_or(mine | F.col("refs").isNotNull()).alias("keep"), F.count("*").alias("messages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(people)))).alias("participants"))
    return t.where("keep").select("thread_id", "messages", F.filter("participants", lambda a: ~a.isin(own)).alias("participants"))


def bulk_correspondents(mails: DataFrame) -> DataFrame:
    """S-14: senders of other mail: counts, span, kind (bulk if ever to unsubscribe from), first name and up to 12 labels by first sight."""
    m = mails.where("kind <> 'human'").withColumn("_p", F.struct("ts", "message_id"))
    a = m.groupBy(F.col("from_addr").alias("addr")).agg(
        F.count("*").alias("n_messages"), F.min(F.when(F.col("ts") > 0, F.col("ts"))).alias("first_ts"), F.max(F.when(F.col("ts") > 0, F.col("ts"))).alias("last_ts"), F.bool_or("list_unsubscribe").alias("list_unsubscribe"),
        F.min_by("from_name", F.when(F.col("from_name").isNotNull(), F.col("_p"))).alias("display_name"), F.array_sort(F.collect_list(F.struct("_p", "labels"))).alias("_l"),
    )
    labels = F.slice(F.array_distinct(F.flatten(F.transform("_l", lambda x: x["labels"]))), 1, 12)
    return a.withColumn("kind", F.when(F.col("list_unsubscribe"), "bulk").otherwise("automated")).withColumn("top_labels", labels).withColumn("domain", F.substring_index("addr", "@", -1)).drop("_l")


def _cards(spark: SparkSession, glob: str, begin: str) -> DataFrame:
    raw = spark.read.text(glob, wholetext=True).withColumn("value", F.regexp_replace("value", r"\r?\n[ \t]", ""))
    return raw.select(F.input_file_name().alias("_f"), F.posexplode(F.split("value", begin)).alias("_n", "card")).where("_n > 0")


def _line(name: str) -> Column:
    return F.trim(F.regexp_extract("card", rf"(?m)^{name}(?:;[^:\n]*)?:([^\r\n]*)", 1))


def vcards(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """S-15: contacts(key, name), the first of a key winning, and birthdays; years 1604 and '--' mean unknown."""
    c = _cards(spark, glob, "BEGIN:VCARD")
    n = F.split(_line("N"), ";")
    c = c.withColumn("name", F.coalesce(F.nullif(_line("FN"), F.lit("")), F.trim(F.concat_ws(" ", F.get(n, F.lit(1)), F.get(n, F.lit(0))))))
    tel = F.regexp_extract_all("card", F.lit(r"(?m)^TEL[^:\n]*:([^\r\n]*)"), F.lit(1))
    mail = F.regexp_extract_all("card", F.lit(r"(?m)^EMAIL[^:\n]*:([^\r\n]*)"), F.lit(1))
    phones = F.filter(F.transform(tel, lambda t: F.regexp_replace(t, r"\D", "")), lambda d: F.length(d) >= 7)
    keys = F.concat(F.transform(phones, lambda d: F.concat(F.lit("+"), d)), F.transform(mail, lambda e: F.lower(F.trim(e))))
    k = c.where("name <> ''").select("name", "_f", "_n", F.explode(keys).alias("key"))
    contacts = k.groupBy("key").agg(F.min_by("name", F.struct("_f", "_n")).alias("name"))
    b = _line("BDAY")
    month, day = F.regexp_extract(b, r"(?:^--|^\d{4}-?)(\d{2})-?(\d{2})", 1), F.regexp_extract(b, r"(?:^--|^\d{4}-?)(\d{2})-?(\d{2})", 2)
    year = F.regexp_extract(b, r"^(\d{4})", 1)
    known = (year != "") & (year != "1604")
    days = c.where(b != "").where(month != "").select("name", month.cast("int").alias("month"), day.cast("int").alias("day"), F.when(known, year.cast("int")).alias("year"), known.alias("year_known"), F.lit("vcard").alias("source"))
    return contacts, days


def ics_birthdays(spark: SparkSession, glob: str) -> DataFrame:
    """S-16: birthdays of a calendar; its years are never the birth year."""
    c = _cards(spark, glob, "BEGIN:VEVENT")
    name = F.regexp_replace(_line("SUMMARY"), r"(?i)['’]s? birthday.*$", "")
    date = _line("DTSTART")
    return c.where(_line("SUMMARY").rlike("(?i)birthday") & date.rlike(r"^\d{8}")).select(
        name.alias("name"), F.substring(date, 5, 2).cast("int").alias("month"), F.substring(date, 7, 2).cast("int").alias("day"), F.lit(None).cast("int").alias("year"), F.lit(False).alias("year_known"), F.lit("ics").alias("source")
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with an ordinal k by source and name, for precedence rules."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("name", "month", "day")))
