"""Text cleaning and tokens as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Classes of characters, written so that Java's and RE2's regular expressions both read them.
FORMAT_CHARS = r"[\x{0600}-\x{0605}\x{061C}\x{06DD}\x{070F}\x{0890}\x{0891}\x{08E2}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}]"
BLANKS = r"[ \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]+"
WORD = r"[\p{L}\p{N}]+"

ABBREVIATIONS = (  # fixed values: forms whose full stop ends no sentence for the plain splitter
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "Inc", "Ltd", "Corp", "Co", "St", "Ave", "Blvd", "Rd",
    "etc", "vs", "eg", "ie", "cf", "ca", "approx",
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
    "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun", "U.S.A", "U.K", "U.N",
)
_ABBR = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
SENTENCE_BREAK = rf"(?<=[.!?])(?<!(?<![A-Za-z0-9_])(?:{_ABBR})\.)\s+(?=[\p{{Lu}}\"'])"


def clean_page(text: Column) -> Column:
    """Line ends, no-break spaces and format characters become blanks, soft hyphens and controls go, blanks shrink to one.

    Null gives null. A leading or trailing blank stays: it may part two pages.
    """
    t = F.regexp_replace(text, r"[\r\n\x{00A0}]", " ")
    t = F.regexp_replace(t, r"\x{00AD}", "")
    t = F.regexp_replace(t, FORMAT_CHARS, " ")
    t = F.regexp_replace(t, r"\p{Cc}", "")
    return F.regexp_replace(t, BLANKS, " ")


def clean_text(text: Column) -> Column:
    """clean_page without outer blanks; null gives ''."""
    return F.coalesce(F.trim(clean_page(text)), F.lit(""))


@pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(text: Column) -> Column:
    """Composed Unicode form; null stays null. Texts of ASCII alone do not leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences of cleaned text as an array; blank or null text gives an empty one."""
    return F.when(F.length(F.trim(text)) > 0, F.split(text, SENTENCE_BREAK)).otherwise(F.array().cast("array<string>"))
