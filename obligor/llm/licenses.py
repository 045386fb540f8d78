"""Licence scan by canonical digests, in DataFrame functions only.

``canonical`` lower-cases a text, drops copyright notices, turns every run of punctuation
and white space into one blank, and settles on one of several equivalent spellings. Two
texts with equal digests are the same licence. Whole texts are hash-joined to the digests
of known texts (one row each, a fixed table); lines that are a known notice by themselves
are looked up in the same digests, row by row. Nothing is shuffled.

Defined results: a null text counts as empty; a text without letters or digits has the
digest of the empty text and no licence; repeated rows are scanned each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obligor.llm.license_texts import LICENCES, SPELLINGS
from obligor.session import small_table

_YEAR = r"(?:19|20)\d\d"
_MARK = r"(?:\(c\)|©)"
#: Words that follow "copyright" in the body of a licence, where it begins no notice.
_BODY = (
    "holders?|owners?|owned|ownership|notices?|licen[cs]e[sd]?|laws?|and|or|in|to|on|of|is|as|for|"
    "interests?|statements?|disclaimers?|treaty|treaties|rights?|protection|permission|claims?|act"
)
_OPENING = (
    rf"copyright(?:[ \t:]*(?:{_MARK}|{_YEAR})|[ \t:]+(?!(?:{_BODY})\b)[\p{{L}}<\[\"])"
    rf"|{_MARK}(?=[^\n]*\b{_YEAR}|(?:[ \t]*[^\s]+){{1,6}}[ \t]*$)"
    r"|all rights reserved[ \t]*(?=[.!]|$)"
)
#: Where a sentence ends and text goes on; after a single letter only before longer text.
_GOES_ON = (
    r"(?:(?<![ \t]\p{L})[.!?][ \t]+(?!(?:and|or|its)\b)(?=(?:\S+[ \t]+){4}\S)"
    r"|(?<=[ \t]\p{L})[.!?][ \t]+(?=(?:\S+[ \t]+){11}\S))"
)
#: A copyright notice at the start of a line, behind comment signs, to the end of its sentence.
COPYRIGHT_NOTICE = (
    rf"(?md)^[ \t#*/;%-]*(?:{_OPENING})[^\n]*?(?:$|{_GOES_ON}(?:all rights reserved[.!]?(?=\s))?)"
)
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def _spelled(text: Column) -> Column:
    """One spelling for each group of equals; ``text`` has a blank around every word."""
    return reduce(
        lambda held, pair: F.replace(held, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")),
        SPELLINGS,
        text,
    )


def canonical(text: Column) -> Column:
    """The words of a text that count, with single blanks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_replace(F.regexp_replace(low, COPYRIGHT_NOTICE, " "), NOT_A_WORD, " ")
    return F.trim(_spelled(F.concat(F.lit(" "), words, F.lit(" "))))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of the known texts, one row per digest."""
    texts = small_table(spark, list(LICENCES), "license_id string, text string")
    return texts.groupBy(digest(F.col("text")).alias("digest")).agg(
        F.min("license_id").alias("license_id")
    )


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license_id, notices), one row per row of ``df``.

    ``license_id`` is the licence that the whole text is, ``notices`` a comma-separated
    list of the licences that lines of it name.
    """
    known = known_licences(df.sparkSession).collect()  # a row per text in LICENCES at most
    by_digest = F.create_map(*[F.lit(x) for row in known for x in (row.digest, row.license_id)])
    table = small_table(df.sparkSession, [tuple(row) for row in known], "digest string, license_id string")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    named = F.array_compact(F.transform(lines, lambda line: by_digest[digest(line)]))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scanned = rows.select(
        "doc_id",
        digest(F.col("text")).alias("digest"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("notices"),
    )
    return scanned.join(F.broadcast(table), "digest", "left").select(
        "doc_id", "digest", "license_id", "notices"
    )
