"""HTML columns: start tags of a document and the attributes of one tag."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+"""


def start_tags(html: Column) -> Column:
    """Start tags of interest in document order, skipping comments and raw text.

    A tag cut off by the end of the document is dropped.
    """
    tokens = F.regexp_extract_all(html, F.lit(P.TAGS), F.lit(1))
    return F.filter(tokens, lambda t: t.endswith(">"))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([a-zA-Z]+)", 1))


def _attribute(name: str) -> str:
    other = rf"[\s/]++(?!{name}[\s=/>])[^\s/>=][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+"
    return rf"(?is)^<[a-z]+(?:{other})*+[\s/]++{name}(?=[\s=/>])"


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(_attribute(name))


def attribute(tag: Column, name: str) -> Column:
    """Value of the first ``name`` attribute; empty when it has none."""
    return attribute_value(attribute_text(tag, name))


def attribute_text(tag: Column, name: str) -> Column:
    """The first ``name`` attribute as it is written, quotes and entities included; empty when it has none."""
    return F.regexp_extract(tag, _attribute(name) + rf"\s*+=\s*+({_VALUE})", 1)


def attribute_value(written: Column) -> Column:
    """What an attribute's text stands for. Pass a materialised column where many are read: it is looked at twice."""
    bare = F.regexp_replace(written, r"""(?s)^(["'])(.*)\1\z""", "$2")
    value = bare
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.when(F.contains(written, F.lit("&")), value).otherwise(bare)


def browser_reference(value: Column) -> Column:
    """An attribute value as a browser reads it before resolving it.

    Outer control characters and inner line breaks go, backslashes are slashes,
    a lone ``%`` is literal, and the query is percent-encoded. A value without any of these passes through
    untouched. Pass a materialised column.
    """
    clean = F.regexp_replace(value, r"^[\x00- ]++|(?<![\x00- ])[\x00- ]++\z|[\t\r\n]", "")
    clean = F.regexp_replace(clean, r"%(?![0-9A-Fa-f]{2})", "%25")
    clean = F.when(F.contains(clean, F.lit("\\")), _slashes(clean)).otherwise(clean)
    read = F.when(clean.rlike(r"\?[^#]*[^!-~]|\?[^#]*[\"<>']"), _encoded_query(clean)).otherwise(clean)
    return F.when(value.rlike(r"[\x00- %\\?]"), read).otherwise(value)


def _slashes(ref: Column) -> Column:
    end = F.regexp_extract(ref, r"(?s)^[^?#]*+(.*)\z", 1)
    return F.concat(F.replace(F.regexp_extract(ref, r"^([^?#]*+)", 1), F.lit("\\"), F.lit("/")), end)


def _encoded_query(ref: Column) -> Column:
    query = F.regexp_extract(ref, r"(\?[^#]*+)", 1)
    tokens = F.regexp_extract_all(query, F.lit(r"""[^"<>'\x00- \x{7f}-\x{10FFFF}]+|["<>'\x00- \x{7f}-\x{10FFFF}]+"""), F.lit(0))
    escaped = F.transform(
        tokens,
        lambda t: F.when(
            t.rlike(r"""^["<>'\x00- \x{7f}-\x{10FFFF}]"""), F.replace(F.url_encode(t), F.lit("+"), F.lit("%20"))
        ).otherwise(t),
    )
    return F.concat(
        F.regexp_extract(ref, r"^([^?#]*+)", 1), F.array_join(escaped, ""), F.regexp_extract(ref, r"(?s)(#.*)\z", 1)
    )
