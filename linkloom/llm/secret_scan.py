"""Secret scans: patterns of known forms, and a Markov model that tells random strings from ordinary ones.

Everything here is a column expression; no row leaves the JVM and nothing is shuffled.

* Null and empty texts have no spans. Positions count code points, ends are exclusive.
* Repeated rows are scanned each for itself; other columns of the table are not looked at.
* Texts are read whole. Positions are running sums over the pieces between matches, added up in
  blocks, so that a text with very many matches takes no quadratic time.
* The model judges runs of 16 or more letters, digits and ``+ / _ -``, the least length of the base kind
  `hex`; shorter random strings give too few pairs to tell them from abbreviations. A run is cut at ``/``,
  ``_`` and ``-``, and the stretch of neighbouring parts with the highest sum of ratios is what is marked, so that
  a key in a path is marked without the path. UUIDs are identifiers and no part of a stretch.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import let, running_totals, table

# The base patterns. Runs of one class are matched from their start, so the least
# length can stand in the pattern; for `assign` it can't, as a short match still consumes its text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "markov")

#: Characters that the model knows; a candidate is a run of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}"
SEPARATOR = "[/_-]"
UUID = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])"
#: How far the sum of ratios may fall inside of one stretch; random strings hold a few ordinary pairs.
FALL = 6.0
REDACTED = "[redacted]"

# The ordinary half of the labelled samples.
ORDINARY = """
getElementById addEventListener removeEventListener createDocumentFragment XMLHttpRequest requestAnimationFrame
max_partition_bytes shuffle_partitions default_timeout_seconds connection_pool_size user_account_settings
last_modified_timestamp customer_order_history application_configuration database_connection_string
StringBuilder ArrayIndexOutOfBoundsException NullPointerException IllegalArgumentException ConcurrentHashMap
AbstractSingletonProxyFactory HttpServletRequest InputStreamReader BufferedOutputStream SimpleDateFormat
calculate_total_amount validate_input_fields render_template_string parse_command_line initialize_components
internationalization responsibilities characteristics misunderstanding straightforward acknowledgement
Geschwindigkeitsbegrenzung Verantwortungsbewusstsein Krankenversicherung Rechtsschutzversicherung Zusammenarbeit
anticonstitutionnellement gouvernementale developpement particulierement administration communication
desafortunadamente responsabilidades administraciones internacionalmente electrodomesticos agradecimiento
src/main/java/org/example/service/impl docs/reference/getting-started images/gallery/thumbnails/summer-holiday
state-of-the-art well-documented-interface content-security-policy access-control-allow-origin
the-quick-brown-fox-jumps-over-the-lazy-dog how-to-write-a-readable-summary frequently-asked-questions
january_february_march_april first_name_and_last_name number_of_items_per_page background-color-primary
thisvariablehasaverylongname anotherlongidentifierwithoutcapitals onlywordsinthisstring everythingisordinary
MAXIMUM_ALLOWED_CONNECTIONS DEFAULT_BUFFER_SIZE_IN_BYTES ENVIRONMENT_VARIABLE_NAME HTTP_STATUS_NOT_FOUND
version_2_migration_step_10 chapter-12-section-3 report_2024_quarter_1 backup_2023-12-31 page_1_of_25
""".split()


#: Series that people and machines write, ordinary too.
SERIES = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789012345678901234567890123456789
zyxwvutsrqponmlkjihgfedcba ZYXWVUTSRQPONMLKJIHGFEDCBA 9876543210987654321098765432109876543210
qwertyuiopasdfghjklzxcvbnm QWERTYUIOPASDFGHJKLZXCVBNM qwertzuiopasdfghjklyxcvbnm azertyuiopqsdfghjklmwxcvbn
-_-_-_-_-_-_-_-_-_-_ +-+-+-+-+-+-+-+-+-+- /-/-/-/-/-/-/-/-/-/- /_/_/_/_/_/_/_/_/_/_ -+_-+_-+_-+_-+_-+_-
""".split()


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each pair of neighbouring characters, and the sum above which a stretch is random."""

    ratios: tuple[float, ...]
    threshold: float


def labelled_samples(spark: SparkSession, random_strings: int = 1500) -> DataFrame:
    """Labelled strings of 16 to 43 characters and more.

    Random ones are digests in base 64, in capitals and digits, in small letters and digits, and in hexadecimal.
    Ordinary ones are names, paths and words, as they are and in capitals, series, every character repeated,
    numbers and points in time.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    plain = F.regexp_replace(coded, "[+/=]", "")
    forms = F.array(F.regexp_replace(coded, "=", ""), F.upper(plain), F.translate(F.regexp_replace(coded, "=", ""), "+/", "-_"), F.substring(digest, 1, 40), F.lower(plain), plain)
    form = F.element_at(forms, (F.col("id") % 6 + 1).cast("int"))
    random = spark.range(random_strings).select(form.substr(F.lit(1), (F.col("id") % 28 + LEAST).cast("int")).alias("s"), F.lit(1).alias("label"))
    number = F.translate(digest, "abcdef", "").substr(F.lit(1), (F.col("id") % 20 + LEAST).cast("int"))
    time = F.date_format(F.timestamp_seconds(F.col("id") * 7654321), "yyyy-MM-dd'_'HH-mm-ss")
    numbers = spark.range(random_strings // 4).select(F.explode(F.array(number, time)).alias("s"), F.lit(0).alias("label"))
    ordinary = spark.createDataFrame([(x,) for x in [*ORDINARY, *(x.upper() for x in ORDINARY), *SERIES, *(c * 2 * LEAST for c in ALPHABET)]], "s string")
    return random.unionByName(numbers).unionByName(ordinary.select("s", F.lit(0).alias("label")))


def _constant(values: tuple[float, ...]) -> Column:
    """An array literal; the text is parsed once, when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<double>")


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _sum_ratio(token: Column, ratios: Column) -> Column:
    """Sum of the log-likelihood ratios of the neighbours in a string of model characters."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        gain = F.when(a.last < 0, F.lit(0.0)).otherwise(F.get(ratios, a.last * len(ALPHABET) + c))
        return F.struct(c.alias("last"), (a["sum"] + gain).alias("sum"))

    return F.aggregate(_codes(token), start, step, lambda a: a["sum"])


def _stretches(run: Column, ratios: Column, threshold: float) -> Column:
    """Stretches ``(start, end, score)`` of neighbouring parts of a run, with a score above the threshold.

    A stretch starts with a part whose sum is positive, ends where its sum is highest, and is closed when
    the sum has fallen to nothing or by FALL from there, as it does between two separators and at a UUID.
    Shorter ones than LEAST aren't given.
    """
    without_ids = F.regexp_replace(run, UUID, "-" * 36)
    score = lambda p: F.when(F.length(p) == 0, F.lit(-FALL)).otherwise(_sum_ratio(p, ratios))
    parts = F.transform(F.split(without_ids, SEPARATOR, -1), lambda p: F.struct(F.length(p).alias("size"), score(p).alias("score")))
    none = F.array().cast("array<struct<start:int,end:int,score:double>>")

    def state(at, start, end, total, peak, found) -> Column:
        return F.struct(at.alias("at"), start.alias("start"), end.alias("end"), total.alias("total"), peak.alias("peak"), found.alias("found"))

    def closed(a: Column) -> Column:
        enough = (a.peak > threshold) & (a.end - a.start >= LEAST)
        return F.when(enough, F.array_append(a.found, F.struct(a.start.alias("start"), a.end.alias("end"), a.peak.alias("score")))).otherwise(a.found)

    def step(a: Column, part: Column) -> Column:
        end, total = a["at"] + part.size, a.total + part.score
        goes_on = (a.peak > 0) & (total > 0) & (total > a.peak - FALL)
        higher = total > a.peak
        longer = state(end + 1, a.start, F.when(higher, end).otherwise(a.end), total, F.greatest(a.peak, total), a.found)
        first = F.greatest(part.score, F.lit(0.0))
        return F.when(goes_on, longer).otherwise(state(end + 1, a["at"], end, first, first, closed(a)))

    zero = F.lit(0)
    return F.aggregate(parts, state(zero, zero, zero, F.lit(0.0), F.lit(0.0), none), step, closed)


def train(samples: DataFrame, smoothing: float = 0.5) -> Model:
    """Fit both Markov chains on ``(s, label)``: label 1 is random, 0 ordinary; other strings than runs of the alphabet are left out.

    The fitted table has as many entries as there are pairs of characters, whatever the samples' size.
    The threshold lies above every ordinary string, halfway to the lowest twentieth of the random ones.
    """
    size = len(ALPHABET)
    known = samples.where(F.col("s").rlike(r"^[A-Za-z0-9+/_-]{2,}$") & F.col("label").isin(0, 1)).select("s", "label")
    pairs = known.select(
        "label",
        F.explode(let(_codes(F.col("s")), lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * size + b))).alias("pair"),
    )
    counts = {0: [0] * size**2, 1: [0] * size**2}
    for row in pairs.groupBy("label", "pair").count().collect():
        counts[row["label"]][row["pair"]] = row["count"]

    def logs(values: list[int]) -> list[float]:
        rows = [sum(values[a * size : (a + 1) * size]) for a in range(size)]
        return [math.log((n + smoothing) / (rows[i // size] + smoothing * size)) for i, n in enumerate(values)]

    ratios = tuple(round(a - b, 6) for a, b in zip(logs(counts[1]), logs(counts[0]), strict=True))
    best = F.array_max(F.transform(_stretches(F.col("s"), _constant(ratios), 0.0), lambda x: x.score))
    scored = known.select("label", F.coalesce(best, F.lit(0.0)).alias("score"))
    low, high = scored.agg(
        F.percentile(F.when(F.col("label") == 1, F.col("score")), 0.05), F.max(F.when(F.col("label") == 0, F.col("score")))
    ).first()
    return Model(ratios, round(max(high or 0.0, ((low or 0.0) + (high or 0.0)) / 2), 6))


def _matches(text: Column, pattern: str, kind: int, accepted=None, group: int | None = None, inside=None) -> Column:
    """Spans ``(start, kind, end)`` of a pattern's matches, leftmost and non-overlapping, or of the stretches ``inside`` of them."""
    found = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")).alias("groups"),
    )

    def spans(m: Column) -> Column:
        count = F.size(m.hits)
        ends = running_totals(F.zip_with(F.slice(m.pieces, 1, count), m.hits, lambda p, h: F.length(p) + F.length(h)))
        rows = F.arrays_zip(ends.alias("end"), m.hits.alias("hit"), m.groups.alias("group"))
        kept = F.filter(rows, lambda r: accepted(r["hit"], r["group"])) if accepted else rows
        span = lambda start, end: F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        first = lambda r: r["end"] - F.length(r["hit"])
        if inside is None:
            return F.transform(kept, lambda r: span(first(r), r["end"]))
        return F.flatten(F.transform(kept, lambda r: F.transform(inside(r["hit"]), lambda x: span(first(r) + x.start, first(r) + x.end))))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), let(found, spans)).otherwise(empty)


def _long_value(_: Column, value: Column) -> Column:
    return F.length(value) >= ASSIGN_LEAST


def _random(model: Model) -> Callable[[Column], Column]:
    """What the model takes for random inside of a run."""
    ratios = _constant(model.ratios)
    return lambda run: _stretches(run, ratios, model.threshold)


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``secret_base`` and ``secret_all``: arrays of ``(start, kind, end)`` by start, then kind as in KINDS.

    Columns of these names that the table had before give way; all others are kept.
    """
    kept = [c for c in docs.columns if c.lower() not in ("secret_base", "secret_all")]
    held = "secret_found" + "_" * max(map(len, ["", *docs.columns]))
    whole = F.coalesce(_column(text), F.lit(""))
    base = F.concat(_matches(whole, ASSIGN, 0, _long_value, 2), _matches(whole, ACCESS, 1), _matches(whole, HEX, 2))
    added = _matches(whole, CANDIDATE, 3, inside=_random(model))
    both = F.struct(F.array_sort(base).alias("base"), added.alias("added"))
    return docs.select(*map(_column, kept), both.alias(held)).select(
        *map(_column, kept),
        F.col(held)["base"].alias("secret_base"),
        F.array_sort(F.concat(F.col(held)["base"], F.col(held)["added"])).alias("secret_all"),
    )


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def _without(run: Column, stretches: Column) -> Column:
    """A run with a marker in place of each of its stretches."""

    def between(x: Column) -> Column:
        at = lambda i: F.coalesce(F.get(x.found, i - 1)["end"], F.lit(0))
        size = lambda i: F.coalesce(F.get(x.found, i).start, F.size(x.chars)) - at(i)
        rest = F.transform(F.sequence(F.lit(0), F.size(x.found)), lambda i: F.array_join(F.slice(x.chars, at(i) + 1, size(i)), ""))
        return F.array_join(rest, REDACTED)

    return let(F.struct(F.split(run, "").alias("chars"), stretches.alias("found")), between)


def _replaced(text: Column, pattern: str, accepted=None, group: int | None = None, inside=None) -> Column:
    def joined(m: Column) -> Column:
        rows = F.arrays_zip(m.pieces.alias("pieces"), m.hits.alias("hits"), m.groups.alias("groups"))

        def hit(r: Column) -> Column:
            if inside is not None:
                return _without(r["hits"], inside(r["hits"]))
            return F.when(accepted(r["hits"], r["groups"]), F.lit(REDACTED)).otherwise(r["hits"]) if accepted else F.lit(REDACTED)

        return F.array_join(F.flatten(F.transform(rows, lambda r: F.array(r["pieces"], F.when(r["hits"].isNotNull(), hit(r)).otherwise(F.lit(""))))), "")

    found = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")).alias("groups"),
    )
    return F.when(text.rlike(pattern), let(found, joined)).otherwise(text)


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Put a marker in place of each secret; texts without one, null ones included, stay as they are."""
    steps = (
        lambda c: _replaced(c, ASSIGN, _long_value, 2),
        lambda c: _replaced(c, ACCESS),
        lambda c: _replaced(c, HEX),
        lambda c: _replaced(c, CANDIDATE, inside=_random(model)),
    )
    for step in steps:
        docs = docs.select(*[step(_column(c)).alias(c) if c == text else _column(c) for c in docs.columns])
    return docs


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, digest of the base spans, all spans as text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = with_spans(docs, train(labelled_samples(spark)))
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("secret_base")), 256).alias("base_sha256"),
        written(F.col("secret_all")).alias("spans"),
    )
