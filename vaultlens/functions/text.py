"""Text functions as Column expressions; the one Arrow UDF decomposes accents, for which Spark has no function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal-form tokens that a company's comparison name drops.
LEGAL_FORMS = ("inc", "incorporated", "llc", "llp", "corp", "corporation", "co", "company", "ltd", "limited", "gmbh", "sas", "plc")


def tokenize(text: Column) -> Column:
    """Runs of a-z and 0-9 of the text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def contains_quote(text: Column, quote: Column) -> Column:
    """Whether a quote that isn't blank stands in the text, white space aside."""
    return (squeeze(quote) != "") & F.contains(squeeze(text), squeeze(quote))


@F.pandas_udf(StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFKD")


def comparison_name(name: Column, ascii_only: bool = False) -> Column:
    """Lower case, punctuation out, legal forms out wherever they stand. Accents come apart first, and so split words."""
    plain = name if ascii_only else F.when(name.rlike(r"^\p{ASCII}*$"), name).otherwise(_decomposed(name))
    words = F.split(F.regexp_replace(F.lower(plain), r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*LEGAL_FORMS)), " ")


def mentions(text: Column, phrase: str) -> Column:
    """Whether the phrase stands in the text with no word character on either side."""
    return F.lower(text).rlike(rf"(?<!\w)\Q{phrase}\E(?!\w)")


def title(filename: Column) -> Column:
    """The file's name without folder and extension, with blanks for runs of _ and -."""
    base = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), "[_-]+", " "))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))


def sentence_at(text: Column, position: Column) -> Column:
    """The line or sentence around a 1-based position: between the nearest line ends or ". "."""
    before, after = F.substring(text, F.lit(1), position - 1), F.substr(text, position)
    head = F.regexp_extract(before, r"(?s)(?:.*(?:\n|\. ))?(.*)$", 1)
    tail = F.regexp_extract(after, r"(?s)^(.*?)(?:\n|\.(?= )|$)", 1)
    return F.trim(F.concat(head, tail))


#: What ends the second party's name, words of it after a blank; and the words before a dash in the heading of a contract.
PARTY_ENDS, PARTY_END_WORDS = "(,.\u2014", ("under", "dated")
CONTRACT_HEADS = ("order form", "statement of work", "sow", "master services agreement", "msa", "agreement")
PARTY_LENGTH = "{2,80}"  #: Fixed value.


def counterparty(text: Column, file_title: Column, company: Column) -> Column:
    """Of "between X and Y" the second party, or the first if that is the company; else what follows a contract's heading and a dash, in the text or in the file's title."""
    ends = rf"(?:[{PARTY_ENDS}]|\s(?:{'|'.join(PARTY_END_WORDS)})\s|$)"
    said = rf"(?i)between\s+(.{PARTY_LENGTH}?)\s+and\s+(.{PARTY_LENGTH}?)\s*{ends}"
    headed = rf"(?i)(?:{'|'.join(CONTRACT_HEADS)})\s*[\u2014\u2013-]\s*([^\n]{PARTY_LENGTH})"
    line = squeeze(text)
    own = comparison_name(company)
    other = lambda c: F.when((c != "") & (comparison_name(c) != own), c)
    after = lambda c: F.regexp_replace(F.trim(F.regexp_extract(c, headed, 1)), r"\.+$", "")
    return F.coalesce(other(F.regexp_extract(line, said, 2)), other(F.regexp_extract(line, said, 1)), other(after(text)), other(after(file_title)))


MAILBOX = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"


def mailboxes(text: Column) -> Column:
    """array<struct<address, name>> of the From, To and Cc lines; the name is the shown one, else the local part with blanks."""
    lines = F.regexp_extract_all(text, F.lit(r"(?im)^(?:from|to|cc):\s*([^\n]*)$"), 1)
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"\s*,\s*")))
    with_address = F.filter(parts, lambda p: p.rlike(MAILBOX))

    def one(p: Column) -> Column:
        address = F.lower(F.regexp_extract(p, MAILBOX, 0))
        shown = F.trim(F.regexp_replace(F.regexp_extract(p, r"^([^<]*)<", 1), r"[\"']", ""))
        return F.struct(address.alias("address"), F.when(shown != "", shown).otherwise(F.initcap(F.regexp_replace(F.substring_index(address, "@", 1), "[._+-]+", " "))).alias("name"))

    return F.transform(with_address, one)


def cell_reference(row: Column, col: Column) -> Column:
    """A1 notation of 0-based row and column, up to three letters."""
    letter = lambda n: F.char((n + 65).cast("int"))
    one, two = letter(col), F.concat(letter(F.floor(col / 26) - 1), letter(col % 26))
    three = F.concat(letter(F.floor((col - 702) / 676)), letter(F.floor((col - 702) / 26) % 26), letter((col - 702) % 26))
    return F.concat(F.when(col < 26, one).when(col < 702, two).otherwise(three), (row + 1).cast("string"))


def redacted(text: Column) -> Column:
    """Digits of runs of eight or more as *, but the last two."""
    parts = F.split(F.regexp_replace(text, r"(\d{8,})", "\u0001$1\u0001"), "\u0001")
    masked = lambda p: F.concat(F.repeat(F.lit("*"), F.length(p) - 2), F.right(p, F.lit(2)))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d{8,}$"), masked(p)).otherwise(p)), "")


def snippet(text: Column, terms: Column, width: int = 360) -> Column:
    """A window of the text that begins a third of its width before the earliest of the terms."""
    found = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(found, F.lit(1)) - width // 3)
    return F.substring(text, start, F.lit(width))


def highlighted(text: Column, terms: list[str]) -> Column:
    """Terms of more than one character between <mark> and </mark>."""
    kept = sorted({t for t in terms if len(t) > 1}, key=lambda t: (-len(t), t))
    return F.regexp_replace(text, r"(?i)(" + "|".join(rf"\Q{t}\E" for t in kept) + ")", "<mark>$1</mark>") if kept else text


def register(spark: SparkSession) -> None:
    """SQL names of the functions, as temporary SQL functions, so that they stay inside the plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vl_tokenize(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(t), '[a-z0-9]+', 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vl_squeeze(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, '\\\\s+', ' '))")
    forms = ", ".join(f"'{x}'" for x in LEGAL_FORMS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vl_comparison_name(t STRING) RETURNS STRING RETURN array_join(filter(split(regexp_replace(lower(t), '[^\\\\w\\\\s]', ' '), '\\\\s+'), w -> w <> '' AND w NOT IN ({forms})), ' ')")
