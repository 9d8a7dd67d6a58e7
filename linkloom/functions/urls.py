"""URL columns: split, validate, resolve, canonicalise.

A split URL is an ``array<string>`` of five parts in order: scheme, authority
with its ``//``, path, query with its ``?``, fragment with its ``#``. Refused
URLs split to NULL. ``parse_url`` is not used: it raises on bad input in ANSI
mode and refuses characters that are accepted here.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SCHEME, AUTHORITY, PATH, QUERY, FRAGMENT = range(5)

_SPLIT = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*+):)?((?:(?<=:)|(?!///))//[^/?#]*+)?"
    r"([^?#]*+)(\?[^#]*+)?(#.*+)?\z"
)
_SEP = "\u0001"

# Characters allowed in a host, in user information, and escapes in a path.
_HOST = r"[A-Za-z0-9\-_.~!$&'()*+,;=\[\]<>\"\x{80}-\x{10FFFF}]"
_USER = r"[A-Za-z0-9\-._:~!$&'()*+,;=%@]*@"
_ESCAPED = r"(?:[^?#%]++|%[0-9A-Fa-f]{2})*+"
_AUTH = rf"//(?:{_USER})?(?:\[[^\]/?#]*\](?::[0-9]*+)?|{_HOST}*+(?::(?:{_HOST}*+:)*+[0-9]*+)?)(?=[/?#]|\z)"
_VALID = (
    r"(?s)^(?!.*[\x00-\x1f\x7f])(?:"
    rf"[A-Za-z][A-Za-z0-9+.-]*+:(?:{_AUTH}(?:/{_ESCAPED})?+|/(?!/){_ESCAPED}|(?!/)[^?#]*+)"
    rf"|(?!///){_AUTH}(?:/{_ESCAPED})?+"
    rf"|(?!//(?!/))(?:[^/?#:%]++|%[0-9A-Fa-f]{{2}})*+(?:/{_ESCAPED})?+"
    r")(?:\?[^#]*+)?+(?:#(?:[^%]++|%[0-9A-Fa-f]{2})*+)?+\z"
)

# Printable ASCII that is never left bare in a path, and anything outside printable ASCII.
_UNSAFE = r"[^!-~]|[\"<>\\^`{|}]"
_KEPT = r"A-Za-z0-9_.~$&+,/:;=@-"
_PATH_TOKENS = rf"%[0-9A-Fa-f]{{2}}|[{_KEPT}]+|[^%{_KEPT}]+"
_KEPT_ESCAPE = (
    r"(?i)^%(?:2[46BCDEF]|3[0-9ABD]|40|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])\z"
)
_DOTS = r"(?:^|/)\.\.?(?:/|\z)"


def split_url(url: Column) -> Column:
    """Five-part split of a materialised URL column, or NULL where the URL is refused."""
    marked = F.regexp_replace(F.when(url.rlike(_VALID), url), _SPLIT, f"$1{_SEP}$2{_SEP}$3{_SEP}$4{_SEP}$5")
    return F.split(marked, _SEP, -1)


def escape_path(path: Column) -> Column:
    """Percent-encode a path the way it is printed; clean paths pass through untouched."""
    encoded = F.array_join(F.transform(F.regexp_extract_all(path, F.lit(_PATH_TOKENS), F.lit(0)), _escape_token), "")
    return F.when(path.rlike(_UNSAFE), encoded).otherwise(path)


def _escape_token(token: Column) -> Column:
    percent = F.when(token.rlike(_KEPT_ESCAPE), F.try_url_decode(token)).otherwise(F.upper(token))
    other = F.replace(F.replace(F.url_encode(token), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.when(token.startswith("%"), percent).when(token.rlike(rf"^[{_KEPT}]"), token).otherwise(other)


def remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path that starts with ``/``."""

    def parent(kept: Column) -> Column:
        return F.regexp_extract(kept, r"(?s)^(.*)/", 1)

    pieces = F.split(F.regexp_replace(path, r"/\.(?=/|\z)", ""), r"/\.\.(?=/|\z)", -1)
    joined = F.aggregate(
        F.slice(pieces, F.lit(2), F.size(pieces)), F.element_at(pieces, 1), lambda kept, x: F.concat(parent(kept), x)
    )
    tail = F.when(path.rlike(r"/\.\.?\z"), "/").otherwise("")
    return F.concat(joined, tail)


def hostname(authority: Column) -> Column:
    """Host of an authority part: no user information, brackets or port."""
    bare = F.regexp_replace(authority, r"^//(?:.*@)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r":[0-9]*\z", ""), r"^\[|\]\z", "")


def url_host(url: Column) -> Column:
    """Host text of an http(s) URL, port kept off; empty when there is none."""
    return F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def extension(path: Column) -> Column:
    """Suffix from the last dot of the last path segment, or empty."""
    return F.regexp_extract(path, r"(\.[^./]*+)\z", 1)


def _joined(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    return F.concat(F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))), authority, path, query, fragment)


def with_resolved(
    df: DataFrame, base: str, ref: str, out: str = "resolved", keep_dots: Column | None = None
) -> DataFrame:
    """Resolve string column ``ref`` against split column ``base``.

    Adds ``{out}`` (the printed URL), ``{out}_canon`` (no fragment, no default
    port, non-empty path), ``{out}_path`` and ``{out}_absolute`` (``ref`` alone
    has scheme and host); all but the last are NULL where ``ref`` is refused.
    ``keep_dots`` marks rows whose path is taken as it stands. Each step is a
    projection of its own so that no pattern is evaluated twice.
    """
    r, b = F.col("_r"), F.col(base)
    scheme, authority, path = r[SCHEME], r[AUTHORITY], r[PATH]
    own_host = F.length(authority) > 2
    opaque = (scheme != "") & (authority == "") & ~path.startswith("/")
    replaces = (scheme != "") | own_host
    df = df.withColumn("_r", split_url(F.col(ref)))
    df = df.withColumns(
        {
            f"{out}_absolute": F.coalesce((scheme != "") & own_host, F.lit(False)),
            "_opaque": opaque,
            "_s": F.when(scheme != "", F.lower(scheme)).otherwise(b[SCHEME]),
            "_a": F.when(replaces, authority).otherwise(b[AUTHORITY]),
            "_q": F.when(replaces | (path != "") | (r[QUERY] != ""), r[QUERY]).otherwise(b[QUERY]),
            "_f": F.when(
                replaces | (path != "") | (r[QUERY] != "") | (r[FRAGMENT] != ""), r[FRAGMENT]
            ).otherwise(b[FRAGMENT]),
            "_merged": F.when(replaces | path.startswith("/"), path)
            .when(path == "", b[PATH])
            .otherwise(F.concat(F.regexp_extract(b[PATH], r"(?s)^(.*/)", 1), path)),
        }
    )
    merged = F.col("_merged")
    rooted = F.when((merged == "") | F.col("_opaque") | merged.startswith("/"), merged).otherwise(
        F.concat(F.lit("/"), merged)
    )
    df = df.withColumn("_merged", rooted)
    plain = F.col("_opaque") | ~merged.rlike(_DOTS)
    if keep_dots is not None:
        plain = plain | keep_dots
    df = df.withColumn("_p", F.when(plain, merged).otherwise(remove_dots(merged)))
    p = F.col("_p")
    df = df.withColumn(f"{out}_path", F.when(F.col("_opaque"), p).otherwise(escape_path(p)))
    s, a, q = F.col("_s"), F.col("_a"), F.col("_q")
    printed = F.col(f"{out}_path")
    default_port = ((s == "http") & a.endswith(":80")) | ((s == "https") & a.endswith(":443"))
    bare = F.when(default_port, F.regexp_replace(a, r"^(//(?:.*@)?)\[?([^\[\]]*)\]?:[0-9]*\z", "$1$2")).otherwise(a)
    slash = F.when((printed == "") & ~F.col("_opaque"), "/").otherwise(printed)
    df = df.withColumns(
        {
            out: _joined(s, a, printed, q, F.col("_f")),
            f"{out}_canon": _joined(s, bare, slash, q, F.lit("")),
        }
    )
    df = df.drop("_r", "_opaque", "_s", "_a", "_q", "_f", "_merged", "_p")
    return pinned(df, out, f"{out}_canon", f"{out}_path", f"{out}_absolute")


def pinned(df: DataFrame, *names: str) -> DataFrame:
    """Compute ``names`` once, below every later filter.

    Filters are otherwise pushed through the projections, and each push copies the
    expressions behind the column: a chain of them grows exponentially. A predicate
    on generator output stays above the generator.
    """
    kept = [F.col(c) for c in df.columns if c not in names]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*names))))


def with_canonical(df: DataFrame, url: str, out: str = "canonical") -> DataFrame:
    """Add the canonical form of ``url``; NULL where the URL is refused."""
    df = df.withColumn("_base", F.split(F.lit(_SEP * 4), _SEP, -1))
    df = with_resolved(df, "_base", url, "_c", keep_dots=F.lit(True))
    return df.withColumn(out, F.col("_c_canon")).drop("_base", "_c", "_c_canon", "_c_path", "_c_absolute")
