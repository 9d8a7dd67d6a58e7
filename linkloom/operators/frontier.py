"""Crawl rounds over a stored corpus, and the budgets that go with them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns, urls
from ..session import scratch_path
from .dedup import ARRIVAL, first_seen
from .extract import is_success, link_edges
from .joins import lookup_join
from .scope import SCOPE_COLUMNS, attach_seeds, in_scope

POINTS = 256  # URLs of a frontier that are looked up as values, so that only their buckets of the graph are read
CLAIM = ["seed_id", "set_name", "key"]
GRAPH = ["src", "scripted", "dst", "key", "kind", "phase", "page_id", "ord"]
NODE = ["seed_id", "url", "scripted", "seed_canon", *SCOPE_COLUMNS]
STATE = [*NODE, "depth", "round"]
STEADY = 6  # rounds that run one by one before later ones are worked out at once; also what a guess must gain to go on
GUESSES = 3  # guesses that may gain less
FAR = 1 << 30  # round of a page that has not been reached yet


def distinct_pages(pages: DataFrame) -> DataFrame:
    """The first stored page of each canonical URL, without its body."""
    keyed = urls.with_canonical(pages.select("page_id", "url"), "url").where("canonical is not null")
    return first_seen(keyed, ["canonical"], ["page_id"])


def page_graph(pages: DataFrame) -> DataFrame:
    """Outgoing links by canonical page URL, for the pages a crawl could fetch.

    Bodies are read once, here; the rounds only touch these narrow rows. Links of
    pages stored twice under one URL are dropped by joining on the page id.
    """
    first = distinct_pages(pages).select("page_id", F.col("canonical").alias("src"))
    links = link_edges(pages).drop("src").where("kind <> 'javascript'")
    return links.join(first, "page_id").select("src", "dst", "kind", "phase", "page_id", "ord")


def site_graph(pages: DataFrame, scripts: DataFrame) -> DataFrame:
    """As :func:`page_graph`, with script assets as nodes of their own between pages and the links in script bodies.

    ``scripted`` tells whether ``src`` is a script; ``key`` is what a link claims: a script tag its URL as
    written, everything else its canonical URL.
    """
    key = F.lower(F.when(F.col("type") == "javascript", F.col("link")).otherwise(F.col("dst")))
    parts = []
    for stored, scripted in ((pages, False), (scripts, True)):
        first = distinct_pages(stored).select("page_id", F.col("canonical").alias("src"))
        links = link_edges(stored, scripted).drop("src").withColumns({"key": key, "scripted": F.lit(scripted)})
        parts.append(links.join(first, "page_id").select(*GRAPH))
    return parts[0].unionByName(parts[1])


class Tables:
    """Bucketed tables of one crawl under the shared folder; their names leave the catalog again, their files stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.place = spark, scratch_path(spark, "crawl")
        self.prefix = f"crawl_{self.place.rsplit('-', 1)[1]}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: set[str] = set()

    def write(self, df: DataFrame, name: str, keys: list[str], partition: str | None = None) -> DataFrame:
        """Append ``df``, dealt and sorted by ``keys``, and return the whole table."""
        rows = df.repartition(self.buckets, *keys)
        writer = rows.write.mode("append").format("parquet").option("path", f"{self.place}/{name}")
        writer = writer.bucketBy(self.buckets, *keys).sortBy(*keys)
        if partition is not None:
            writer = writer.partitionBy(partition)
        writer.saveAsTable(f"{self.prefix}_{name}")
        self.names.add(name)
        return self.spark.table(f"{self.prefix}_{name}")

    def files(self, name: str) -> DataFrame:
        """A table's rows by their place alone, for readers that outlive its name."""
        schema = self.spark.table(f"{self.prefix}_{name}").schema
        return self.spark.read.schema(schema).parquet(f"{self.place}/{name}")

    def kept(self, df: DataFrame) -> DataFrame:
        """A frame as files: neither its lineage nor what a plan knows of its columns grows from step to step."""
        path = scratch_path(self.spark, "crawl-step")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")


def crawl(
    graph: DataFrame,
    known: DataFrame,
    seeds: DataFrame,
    max_depth: int = 0,
    exclude: str | None = None,
    max_rounds: int | None = None,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Fetch rounds from the seeds through ``graph`` until nothing new is admitted.

    ``known`` maps canonical URLs to stored pages; ``seeds`` comes from
    ``seed_columns``. A tag link is one deeper than its page, a quoted link starts
    over at depth 1, and ``max_depth`` 0 is unlimited. A URL belongs to the first
    row that reports it even if that row is too deep to be fetched. ``starts``
    (``seed_id``, ``url``) are URLs from robots files, sitemaps, archives and the like: they
    are fetched in the first round like the seeds, if scope and ``exclude`` let them. Scripts
    of a :func:`site_graph` are claimed whether in scope or not, and fetched, under their plain names too,
    if in scope. Returns one row per seed and visited URL: ``depth``, ``round`` and the ``page_id``
    where it is stored; visited scripts are ``scripted``.

    The graph is shuffled once, into a table bucketed by ``src``. What has been claimed is a table
    bucketed by its key with one partition for each round; a round reads the partition of the last one, and its
    own aggregate by key lies as the table's buckets do. So neither the graph nor what is
    known is shuffled again, only what is new, and a frontier of a few URLs reads but their buckets. All that
    links claim is claimed for good, so of what was visited only the first round is compared. Long paths take no
    round for each link: after ``STEADY`` rounds the later ones are worked out together (:func:`_ahead`).
    """
    tables = Tables(graph.sparkSession)
    try:
        begun, claimed = _rounds(tables, graph, seeds, max_depth, exclude, max_rounds, starts)
    finally:
        tables.forget()
    visits = begun.select("seed_id", "url", F.lit(False).alias("scripted"), F.lit(1).alias("depth"), F.lit(1).alias("round"))
    if claimed is not None:
        # A script can be reached under its own name and as the plain name of a minified one.
        later = _admitted(claimed, begun, max_depth, exclude).select(*visits.columns)
        visits = visits.unionByName(first_seen(later, ["seed_id", "url", "scripted"], ["round", "depth"]))
    found = known.select(F.col("canonical").alias("url"), "page_id")
    return visits.join(found, "url", "left").select("seed_id", "url", "depth", "round", "page_id", "scripted")


def _rounds(tables: Tables, graph: DataFrame, seeds: DataFrame, max_depth: int, exclude: str | None, max_rounds: int | None, starts: DataFrame | None):
    """Run the rounds; what was fetched in the first one, and what was claimed in all of them."""
    graph = graph if "scripted" in graph.columns else graph.withColumn("scripted", F.lit(False))
    graph = graph if "key" in graph.columns else graph.withColumn("key", F.lower("dst"))
    graph = tables.write(graph.select(*GRAPH), "graph", ["src"])
    scopes = ["seed_id", "seed_canon", *SCOPE_COLUMNS]
    first = seeds.select(*scopes, F.col("seed_canon").alias("url"))
    if starts is not None:
        first = first.unionByName(_started(starts, seeds.select(*scopes), exclude))
    begun = tables.write(first_seen(first, ["seed_id", "url"], ["seed_canon"]), "begun", ["seed_id", "url"])
    frontier = begun.withColumns({"scripted": F.lit(False), "depth": F.lit(1), "round": F.lit(1)}).select(*STATE)
    claimed, number, steady = None, 1, STEADY
    ahead = 1 + steady  # the round after which the next ones are worked out together
    while (max_rounds is None or number < max_rounds) and not frontier.isEmpty():
        last = number + 1
        if number < ahead:
            new = claims(graph, frontier, claimed)
        else:
            new, last = _ahead(tables, graph, frontier, claimed, begun, seeds, number, max_depth, exclude)
            steady *= 2
            ahead = (number if last is None else last) + steady
            if max_rounds is not None:
                new = new.where(F.col("round") <= max_rounds)
        step = number + 1
        claimed = tables.write(new.withColumn("step", F.lit(step)), "claimed", CLAIM, "step")
        if last is None:
            break
        number = last
        latest = claimed.where((F.col("step") == step) & (F.col("round") == number))
        frontier = _admitted(latest, begun, max_depth, exclude).select(*STATE)
    return tables.files("begun"), None if claimed is None else tables.files("claimed")


def claims(graph: DataFrame, frontier: DataFrame, claimed: DataFrame | None, guess: Column | None = None) -> DataFrame:
    """The first link of a frontier to every key that is not claimed yet.

    The pages of a frontier may be of several rounds; the earliest comes first. ``guess`` orders the links
    of pages that have not been reached.
    """
    rows, order = _reached(graph, frontier), ["round", *ARRIVAL]
    if guess is not None:
        rows = rows.withColumn("guess", F.when(F.col("round") < FAR, 0).otherwise(guess).cast("long"))
        order = ["round", "guess", *ARRIVAL]
    new = first_seen(rows, CLAIM, order)
    if claimed is not None:
        new = new.join(claimed.select(*CLAIM), CLAIM, "left_anti")
    deeper = F.when(F.col("kind") == "href", F.col("depth") + 1).otherwise(1)
    return new.withColumns({"depth": deeper, "round": F.col("round") + 1})


def _ahead(
    tables: Tables, graph: DataFrame, frontier: DataFrame, claimed: DataFrame, begun: DataFrame, seeds: DataFrame, number: int, max_depth: int, exclude: str | None
) -> tuple[DataFrame, int | None]:
    """Claims of the rounds after ``number``, and the last of these rounds, or None if no page is left.

    What a round claims follows from the pages of the rounds before it alone, so pages with their rounds are right up to
    the first round in which they differ from what their own links claim. That is the proof; the pages
    to be proved are guessed. Every page takes the link that claims it, or would claim it among pages that were not
    reached yet, and their rounds are counted along these links by doubling: a path costs as many joins as
    its length has binary digits. Pages that differ take better links, and so on. A guess that proves little ends
    this; it is never worse than one round.
    """
    sources = tables.kept(graph.select(F.col("src").alias("url"), "scripted").distinct())
    whose = seeds.select("seed_id", "seed_canon", *SCOPE_COLUMNS, "attach_key")
    pages = attach_seeds(sources.withColumn("host", urls.url_host(F.col("url"))), whose).where(in_scope(F.col("url")))
    node = F.xxhash64(*NODE)
    far = tables.kept(pages.withColumns({"depth": F.lit(1), "round": F.lit(FAR)}).select(*STATE).distinct().withColumn("parent", node))
    roots = tables.kept(frontier.join(sources, ["url", "scripted"], "left_semi").select(*STATE).withColumn("parent", node))
    found, sure, tried = roots.where(F.lit(False)), number, 0
    while True:
        unknown = far.join(roots.unionByName(found).select("parent"), "parent", "left_anti")
        guess = [F.lit(0), -F.col("page_id")][tried] if tried < 2 else F.xxhash64("parent", F.lit(tried))
        new = tables.kept(claims(graph, roots.unionByName(found).unionByName(unknown), claimed, guess).drop("guess"))
        rows = _admitted(new, begun, max_depth, exclude).join(sources, ["url", "scripted"], "left_semi")
        rows = rows.select(*STATE, "parent", "kind").unionByName(roots.withColumn("kind", F.lit("")))
        # A script may be reached again, under its plain name.
        nodes = tables.kept(first_seen(rows, NODE, ["round", "depth"]).where(F.col("round") > number))
        sides = found.select(*STATE, F.lit(0).alias("side")).unionByName(nodes.where(F.col("round") < FAR).select(*STATE, F.lit(1).alias("side")))
        differ = sides.groupBy(*STATE).agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low = high")
        wrong = differ.agg(F.min("round")).first()[0]
        if wrong is None:
            return new.where(F.col("round") < FAR).drop("parent"), None
        gained, sure, tried = wrong - sure, wrong, tried + 1
        if tried > GUESSES and gained < STEADY:
            return new.where(F.col("round") <= sure).drop("parent"), sure
        nodes = nodes.withColumn("id", node)
        counted = _counted(tables, roots, nodes)
        found = tables.kept(nodes.drop("depth", "round", "parent", "kind").join(counted, "id").withColumnRenamed("id", "parent").select(*found.columns))


def _counted(tables: Tables, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, depth, round`` of the pages whose parents lead to a root.

    A row holds how far a page is from another one up its path; a join with itself doubles that. Rows that neither
    reach a root nor end go in circles, and once no other rows are open, nothing changes any more.
    """
    start = roots.select(
        F.col("parent").alias("id"), F.lit(None).cast("long").alias("to"), F.col("round").cast("long").alias("hops"),
        F.col("depth").cast("long").alias("deep"), F.lit(True).alias("fixed"),
    )
    one = F.lit(1).cast("long")
    begin = nodes.select("id", F.col("parent").alias("to"), one.alias("hops"), one.alias("deep"), (F.col("kind") != "href").alias("fixed"))
    ways, before = tables.kept(start.unionByName(begin)), None
    while (left := ways.where("to is not null").count()) not in (0, before):
        before = left
        on = ways.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("deep").alias("_deep"), F.col("fixed").alias("_fixed"))
        # Behind a link that is no tag the depth starts over, whatever it was before.
        deep = F.when(F.col("fixed"), F.col("deep")).otherwise(F.col("_deep") + F.col("deep"))
        moved = ways.join(on, "to").select(
            "id", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), deep.alias("deep"), (F.col("fixed") | F.col("_fixed")).alias("fixed")
        )
        ways = tables.kept(ways.where("to is null").unionByName(moved))
    done = ways.where("to is null").join(nodes.select("id"), "id", "left_semi")
    return done.select("id", F.col("deep").cast("int").alias("depth"), F.col("hops").cast("int").alias("round"))


def _reached(graph: DataFrame, frontier: DataFrame) -> DataFrame:
    """Links of a frontier that claim a key: those in scope, and all scripts."""
    few = [r.url for r in frontier.select("url").distinct().limit(POINTS + 1).collect()]
    if len(few) <= POINTS:
        graph = graph.where(F.col("src").isin(few))
    links = graph.join(frontier.withColumnRenamed("url", "src"), ["src", "scripted"])
    links = links.withColumns({"dst": F.coalesce("dst", "seed_canon"), "key": F.coalesce("key", F.lower("seed_canon"))})
    script = F.col("kind") == "javascript"
    links = links.where(script | in_scope(F.col("dst"))).withColumn("set_name", F.when(script, "js").otherwise("link"))
    return links.drop("src", "scripted").withColumnRenamed("dst", "url")


def _admitted(claimed: DataFrame, begun: DataFrame, max_depth: int, exclude: str | None) -> DataFrame:
    """Claimed links that are fetched, scripts under their plain names too."""
    script = F.col("kind") == "javascript"
    plain = F.array_distinct(F.array("url", F.replace("url", F.lit(".min.js"), F.lit(".js"))))
    rows = claimed.where(~script | in_scope(F.col("url"))).withColumn("scripted", script)
    rows = rows.withColumn("url", F.explode(F.when(script, plain).otherwise(F.array("url"))))
    rows = rows.where(~F.col("url").rlike(patterns.STATIC_ASSET))
    if max_depth:
        rows = rows.where(F.col("depth") <= max_depth)
    if exclude is not None:
        rows = rows.where(~F.col("url").rlike(exclude))
    visited = begun.select("seed_id", "url", F.lit(False).alias("scripted"))
    return rows.join(visited, ["seed_id", "url", "scripted"], "left_anti")


def _started(starts: DataFrame, seeds: DataFrame, exclude: str | None) -> DataFrame:
    """Outside URLs of each seed that may be fetched, in canonical form."""
    rows = lookup_join(starts.select("seed_id", "url").distinct(), seeds, "seed_id")
    rows = rows.where(in_scope(F.col("url")) & ~F.col("url").rlike(patterns.STATIC_ASSET))
    if exclude is not None:
        rows = rows.where(~F.col("url").rlike(exclude))
    rows = urls.with_canonical(rows, "url", "canonical").where("canonical is not null")
    return rows.drop("url").withColumnRenamed("canonical", "url").select(*seeds.columns, "url")


def fetched(visits: DataFrame) -> DataFrame:
    """Visited URLs that are stored, i.e. pages the crawl read."""
    return visits.where("page_id is not null")


def render_candidates(
    pages: DataFrame, seeds: DataFrame, budget: int = patterns.RENDER_BUDGET, max_bytes: int = patterns.MAX_RENDER_BYTES
) -> DataFrame:
    """Pages worth rendering per seed: its own URL, then small HTML pages in page order.

    ``pages`` carries ``seed_id``, ``raw_length``, ``status``, ``content_type`` and
    is in scope. Errors are never picked, nor is a seed whose own URL is out of its
    scope. ``budget`` is the feature: so many pages for each seed. The row limit is a group limit, which Spark applies before the
    shuffle, so a seed with most of the pages sends ``budget`` rows per task.
    """
    start = seeds.where(in_scope(F.col("url"))).select("seed_id", F.col("url"), F.lit(0).alias("rank_group"), F.lit(-1).cast("long").alias("page_id"))
    is_html = F.contains(F.lower("content_type"), F.lit("text/html"))
    small = pages.where(is_html & is_success(F.col("status")) & (F.col("raw_length") < max_bytes))
    small = small.select("seed_id", "url", F.lit(1).alias("rank_group"), "page_id")
    queue = start.unionByName(small).withColumn("key", F.lower("url"))
    queue = first_seen(queue, ["seed_id", "key"], ["rank_group", "page_id"])
    order = Window.partitionBy("seed_id").orderBy("rank_group", "page_id")
    ranked = queue.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= budget)
    return ranked.select("seed_id", "url", F.col("pick").cast("int"))


def loadable_resources(log: DataFrame) -> DataFrame:
    """Requests that are let through while rendering."""
    return log.where(~F.col("resource_type").isin(patterns.BLOCKED_RESOURCES))
