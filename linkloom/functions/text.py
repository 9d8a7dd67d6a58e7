"""Text columns: trimming, whole-string decoding, host-name cleaning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def trimmed(text: Column) -> Column:
    """Strip Unicode white space from both ends (Spark's ``trim`` strips only spaces)."""
    return F.regexp_replace(text, rf"^[{P.SPACE}]++|(?<![{P.SPACE}])[{P.SPACE}]++\z", "")


def one_line(text: Column) -> Column:
    """Trim, then turn each run of tabs and line breaks into one space; text without white space passes through untouched."""
    return F.when(text.rlike(f"[{P.SPACE}]"), F.regexp_replace(trimmed(text), r"[\t\r\n]++", " ")).otherwise(text)


def decoded(text: Column) -> Column:
    """Percent- and plus-decode the whole text or none of it, then two JSON escapes.

    A single bad escape leaves the text as it is. Pass a materialised column: it
    is read several times. Most text holds no escape at all, which is seen without writing it anew.
    """
    percent, plus = F.contains(text, F.lit("%")), F.contains(text, F.lit("+"))
    unescaped = (
        F.when(~percent & ~plus, text)
        .when(~percent, F.replace(text, F.lit("+"), F.lit(" ")))
        .when(text.rlike("%(?![0-9a-fA-F]{2})"), text)
        .otherwise(F.try_url_decode(text))
    )
    slashes = F.replace(F.replace(unescaped, F.lit("\\u002f"), F.lit("/")), F.lit("\\u0026"), F.lit("&"))
    return F.when(F.contains(text, F.lit("\\u00")) | percent | plus, slashes).otherwise(text)


def dotted_words(text: Column) -> Column:
    """The words between blanks that hold a dot. Hosts and buckets hold one and no blank, so none is cut or lost."""
    return F.array_join(F.filter(F.split(text, " "), lambda w: F.contains(w, F.lit("."))), " ")


def split_long_body(text: Column, over: int) -> Column:
    """Break bodies over so many bytes after each ``;`` and ``,``."""
    broken = F.replace(F.replace(text, F.lit(";"), F.lit(";\r\n")), F.lit(","), F.lit(",\r\n"))
    return F.when(F.octet_length(text) > over, broken).otherwise(text)


def clean_host(name: Column) -> Column:
    """Lower-case a scraped host name and drop encoding residue around it; clean names pass through untouched.

    Pass a materialised column.
    """
    bare = F.regexp_replace(trimmed(F.lower(name)), r"^\*\.", "")
    bare = F.regexp_replace(bare, P.HOST_RESIDUE, "")
    bare = F.regexp_replace(bare, r"^-++|(?<!-)-++\z", "")
    short = F.when(F.length(bare) > 1, F.regexp_replace(bare, r"^\.", "")).otherwise(bare)
    return F.when(name.rlike(P.CLEAN_HOST), name).otherwise(short)


def is_noise(token: Column) -> Column:
    """Quoted text that only looks like a link: MIME types, dates, templates, blanks."""
    return (
        token.rlike(P.NOISE)
        | F.contains(token, F.lit("{{"))
        | F.contains(token, F.lit("}}"))
        | F.contains(token, F.lit("/:"))
    )


def quote_pattern(text: Column) -> Column:
    """Escape a literal for use inside a pattern column."""
    return F.regexp_replace(text, r"([\\.+*?()|\[\]{}^$])", r"\\$1")
