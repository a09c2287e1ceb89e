"""Crawl policy: scope, robots rules, work lists, fetch results and politeness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.urls import extract_urls, full_link, parse_link, resolve_href
from weftline.operators.admission import first_of_spell
from weftline.schemas import BLOCKED, HAD_ERROR, PROCESSED, REQUESTING

LINK_KEY = ["domain", "path", "query"]


def has_flag(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(bits) != 0


def seed_domains(seeds: DataFrame) -> DataFrame:
    return seeds.select("project_id", "domain").distinct()


def link_scope_filter(anchors: DataFrame, settings: DataFrame, seeds: DataFrame) -> DataFrame:
    """Anchors(project_id, page_id, base, href, …) that a project's settings let through.

    Without a settings row all are kept. ``only_extract_data…`` keeps none. With
    ``only_crawl_direct_links…`` those of a page whose own link is a seed are
    kept; with ``only_crawl_within_domains…`` root-relative hrefs and those that
    lead to a seed's domain. Anything else is dropped.
    """
    links = anchors.withColumns({"_own": parse_link(F.col("base")), "_to": resolve_href(F.col("base"), F.col("href"))["domain"]})
    # A project has one settings row and few seeds, but neither is bounded, so Spark chooses the joins.
    links = links.join(settings, "project_id", "left")
    own = seeds.select(F.col("project_id").alias("_project"), F.col("domain").alias("_d"), F.col("path").alias("_p"), F.col("query").alias("_q")).distinct().withColumn("_seed", F.lit(True))
    on = (F.col("project_id") == F.col("_project")) & (F.col("_own.domain") == F.col("_d")) & (F.col("_own.path") == F.col("_p")) & F.col("_own.query").eqNullSafe(F.col("_q"))
    links = links.join(own, on, "left")
    allowed = seed_domains(seeds).withColumnRenamed("domain", "_to").withColumn("_inside", F.lit(True))
    links = links.join(allowed, ["project_id", "_to"], "left")
    keep = (
        F.when(F.col("only_extract_data_from_specified_links").isNull(), True)
        .when(F.col("only_extract_data_from_specified_links"), False)
        .when(F.col("only_crawl_direct_links_from_specified_links") & F.col("_seed").isNotNull(), True)
        .when(F.col("only_crawl_within_domains_of_specified_links"), F.col("href").startswith("/") | F.col("_inside").isNotNull())
        .otherwise(False)
    )
    return links.where(keep).select(*anchors.columns)


def allowed_domain_filter(links: DataFrame, settings: DataFrame, seeds: DataFrame) -> DataFrame:
    """Links whose domain a seed owns, and all links of projects that are not kept within domains."""
    bound = settings.where("only_crawl_within_domains_of_specified_links").select("project_id").distinct()
    free = links.join(bound, "project_id", "left_anti")
    return free.unionByName(links.join(bound, "project_id", "left_semi").join(seed_domains(seeds), ["project_id", "domain"], "left_semi").select(*free.columns)).select(*links.columns)


def seed_links(objectives: DataFrame) -> DataFrame:
    """(project_id, domain, path, query): the https URLs in ``objectives(project_id, text)``."""
    urls = objectives.select("project_id", F.explode(extract_urls(F.col("text"))).alias("url"))
    return urls.select("project_id", parse_link(F.col("url")).alias("l")).select("project_id", "l.*").where("domain is not null").distinct()


def seed_settings(objectives: DataFrame) -> DataFrame:
    """(project_id, three settings): a project with an https URL in its objective keeps within its domains."""
    urls = F.filter(extract_urls(F.col("text")), lambda u: u.rlike(r"^https://[^/?#]*[A-Za-z]"))
    no = F.lit(False)
    return objectives.select("project_id", no.alias("only_extract_data_from_specified_links"), no.alias("only_crawl_direct_links_from_specified_links"), (F.size(urls) > 0).alias("only_crawl_within_domains_of_specified_links"))


def search_result_links(results: DataFrame, settings: DataFrame, seeds: DataFrame) -> DataFrame:
    """Links of search results (project_id, search_id, url) in allowed domains, each with the two edges to its search."""
    links = results.select("project_id", "search_id", parse_link(F.col("url")).alias("l")).select("project_id", "search_id", "l.*").where("domain is not null")
    kept = allowed_domain_filter(links, settings, seeds).distinct()
    return kept.withColumns({"labels": F.array(F.lit("AddedByWebSearch"), F.lit("Link")), "edge": F.lit("Suggests"), "inverse_edge": F.lit("SuggestedFor")})


def robots_rules(robots: DataFrame) -> DataFrame:
    """(domain, agent, allow, pattern, line) of ``robots(domain, contents)``.

    Agent lines that follow each other open one group; the rules after them, up
    to the next agent line, belong to all its agents. Agents in lower case.
    """
    lines = robots.select("domain", F.posexplode(F.split("contents", r"\r\n|\r|\n")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    fields = lines.select("domain", "line", F.lower(F.regexp_extract(bare, r"^([A-Za-z-]+)\s*:", 1)).alias("field"), F.trim(F.regexp_extract(bare, r"^[A-Za-z-]+\s*:(.*)$", 1)).alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    by_line = Window.partitionBy("domain").orderBy("line")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(by_line), F.lit("")) != "user-agent")
    grouped = fields.withColumn("group", F.sum(opens.cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.where("field = 'user-agent' and group > 0").select("domain", "group", F.lower("value").alias("agent"))
    rules = grouped.where("field != 'user-agent' and value != ''").select("domain", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"), "line")
    return agents.join(rules, ["domain", "group"]).select("domain", "agent", "allow", "pattern", "line")


def pattern_regex(pattern: Column) -> Column:
    """A robots path pattern as a regular expression: ``*`` any run, a final ``$`` the end."""
    ended = pattern.endswith("$")
    body = F.when(ended, F.expr("substr(pattern, 1, length(pattern) - 1)")).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(ended, "$").otherwise(""))


def _pattern_hits(links: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, path, query, allow, pattern) for each link and each of ``rules(domain, allow, pattern)`` that matches it.

    A pattern begins with a literal head, up to its first ``*`` or final ``$``. A
    link is cut to the lengths that heads of its domain have, and joined by
    equality of domain and head, so a rule meets only links that begin like it;
    a regular expression then tests the patterns that are more than a head.
    """
    rules = rules.withColumn("head", F.regexp_extract("pattern", r"^([^*]*?)(?:\*|\$$|$)", 1)).withColumn("regex", F.when(F.col("head") != F.col("pattern"), pattern_regex(F.col("pattern"))))
    # As many lengths as the domain's longest pattern has letters, at most.
    lengths = rules.groupBy("domain").agg(F.collect_set(F.length("head")).alias("lengths"))
    keys = links.select(*LINK_KEY).distinct().withColumn("target", full_link(F.col("path"), F.col("query")))
    fit = F.filter("lengths", lambda n: n <= F.length("target"))
    heads = keys.join(lengths, "domain").select(*LINK_KEY, "target", F.explode(fit).alias("n")).withColumn("head", F.substring("target", F.lit(1), F.col("n")))
    return heads.join(rules, ["domain", "head"]).where(F.col("regex").isNull() | F.regexp_like("target", F.col("regex"))).select(*LINK_KEY, "allow", "pattern")


def robots_filter(links: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """links(domain, path, query, …) that robots rules allow.

    The rules of the agent's own groups count, else those of ``*``. The longest
    pattern that matches path and query decides, Allow before Disallow; without
    a match, or without rules, a link is allowed.
    """
    own = rules.where(F.col("agent") == agent.lower())
    rest = rules.where("agent = '*'").join(own.select("domain").distinct(), "domain", "left_anti")
    used = own.select("domain", "allow", "pattern").unionByName(rest.select("domain", "allow", "pattern")).distinct()
    hits = _pattern_hits(links, used)
    best = hits.groupBy(*LINK_KEY).agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allow"))
    denied = best.where("not allow").select(*(F.col(c).alias(f"_{c}") for c in LINK_KEY))
    on = (F.col("domain") == F.col("_domain")) & (F.col("path") == F.col("_path")) & F.col("query").eqNullSafe(F.col("_query"))
    return links.join(denied, on, "left_anti")


def select_frontier(nodes: DataFrame, now: Column, limit: int = 100, retry_after: int = 60, require_objective: bool = False) -> DataFrame:
    """The work list of nodes, in id order.

    Nodes that are not processed, being requested or blocked; with an error only
    if it is older than ``retry_after`` seconds (whatever the label). Domains,
    objectives, pages and searches all come; links fill up to ``limit``. With
    ``require_objective`` pages and searches wait until an objective of their
    project is processed.
    """
    age = F.unix_micros(now) - F.unix_micros("written_at")
    errors = has_flag(F.col("flags"), HAD_ERROR)
    kinds = F.array(*map(F.lit, ("DomainName", "Objective", "WebPage", "WebSearch")))
    first = F.arrays_overlap("labels", kinds) | (errors & (age > retry_after * 1_000_000))
    open_ = nodes.where(~has_flag(F.col("flags"), PROCESSED | REQUESTING | BLOCKED) & (~errors | (age > retry_after * 1_000_000)))
    open_ = open_.where(first | F.array_contains("labels", "Link"))
    if require_objective:
        ready = nodes.where(F.array_contains("labels", "Objective") & has_flag(F.col("flags"), PROCESSED)).select("project_id").distinct()
        waits = F.arrays_overlap("labels", F.array(F.lit("WebPage"), F.lit("WebSearch")))
        open_ = open_.where(~waits).unionByName(open_.where(waits).join(ready, "project_id", "left_semi"))
    always = open_.where(first)
    taken = always.limit(limit).count()  # at most limit rows are looked at
    links = open_.where(~first).orderBy("node_id").limit(max(limit - taken, 0))
    return always.unionByName(links).orderBy("node_id")


def apply_fetch_results(links: DataFrame, responses: DataFrame, errors: DataFrame, mode: str = "default", by: Sequence[str] = LINK_KEY) -> tuple[DataFrame, DataFrame]:
    """(links with new flags, pages): responses(domain, path, query, html) make pages and mark their links processed, errors(domain, path, query) mark them failed.

    ``by`` names the columns, in all three tables, that tell which link asked;
    where one link has rows of several projects or requests, give their ids
    (``project_id``, ``node_id``), or an answer to one marks them all.
    Flags are set; with ``mode="reference"`` they are toggled.
    """
    own = [f"_{c}" for c in by]

    def keys(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c).alias(f"_{c}") for c in by)).distinct()

    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "query" else F.col(c) == F.col(f"_{c}") for c in by))
    marked = links.join(keys(responses).withColumn("_got", F.lit(True)), on, "left").drop(*own).join(keys(errors).withColumn("_failed", F.lit(True)), on, "left").drop(*own)
    change = (lambda f, bit: f.bitwiseXOR(bit)) if mode == "reference" else (lambda f, bit: f.bitwiseOR(bit))
    flags = F.when(F.col("_got"), change(F.col("flags"), F.lit(PROCESSED))).when(F.col("_failed"), change(F.col("flags"), F.lit(HAD_ERROR))).otherwise(F.col("flags"))
    pages = responses.join(keys(links), on, "left_semi").select(*(c for c in by if c not in LINK_KEY), *LINK_KEY, "html", F.lit("PathOf").alias("edge"), F.lit("ContentOf").alias("inverse_edge"))
    return marked.withColumn("flags", flags).select(*links.columns), pages


def starting_links(nodes: DataFrame, limit: int = 100) -> DataFrame:
    added = F.array(*map(F.lit, ("AddedByUser", "AddedByAI", "AddedByWebSearch")))
    return nodes.where(F.array_contains("labels", "Link") & F.arrays_overlap("labels", added)).orderBy("node_id").limit(limit)


def link_status(nodes: DataFrame) -> DataFrame:
    f = F.col("flags")
    status = F.when(has_flag(f, PROCESSED), "processed").when(has_flag(f, REQUESTING), "requesting").when(has_flag(f, BLOCKED), "blocked").otherwise("waiting")
    return nodes.where(F.array_contains("labels", "Link")).select("node_id", status.alias("status"))


def retry_errors(nodes: DataFrame, now: Column, retry_after: int = 60) -> DataFrame:
    """Failed nodes whose last change is more than ``retry_after`` seconds ago."""
    return nodes.where(has_flag(F.col("flags"), HAD_ERROR) & (F.unix_micros(now) - F.unix_micros("written_at") > retry_after * 1_000_000))


def whole_seconds(later: Column, earlier: Column) -> Column:
    return F.floor((later - earlier) / 1_000_000)


def crawl_admission(requests: DataFrame, gap: int = 2, forget: int | None = None) -> DataFrame:
    """Adds ``admitted`` to requests(request_id, domain, url, ts), in the order of ts and request_id.

    A domain's first request is admitted (and not logged for its URL). Later
    ones are denied while the whole seconds since the first are ``gap`` or
    fewer; from then on a URL is admitted the first time, and again as long as
    each next request follows within ``gap`` whole seconds of its last admission.
    With ``forget``, a domain or URL without a request for more than so many
    seconds is new again. Requests without a domain are not admitted.

    Windows over (domain, url) do all the work, so a hot domain is spread over
    its URLs; a domain's first request comes from an aggregate, or with
    ``forget`` from bins of its time.
    """
    plain = requests.where("domain is not null").withColumn("micros", F.unix_micros("ts"))
    if forget is None:
        known = plain.join(plain.groupBy("domain").agg(F.min(F.struct("micros", "request_id")).alias("first")), "domain")
    else:
        known = first_of_spell(plain, forget)
    opens = (F.col("micros") == F.col("first.micros")) & (F.col("request_id") == F.col("first.request_id"))
    is_late = ~opens & (whole_seconds(F.col("micros"), F.col("first.micros")) > gap)
    late = url_chains(known.where(is_late).withColumn("denied", F.lit(False)), gap, forget).withColumn("admitted", ~F.col("denied"))
    early = known.where(~is_late).withColumn("admitted", opens)
    columns = [*requests.columns, "admitted"]
    return early.select(*columns).unionByName(late.select(*columns)).unionByName(requests.where("domain is null").withColumn("admitted", F.lit(False)).select(*columns))


def url_chains(rows: DataFrame, gap: int, forget: int | None) -> DataFrame:
    """``rows(domain, url, micros, request_id, denied)`` with ``denied`` carried on: a chain goes on while each step is short; after the first long step the URL stays denied, until it is forgotten."""
    order = Window.partitionBy("domain", "url").orderBy("micros", "request_id")
    step = F.col("micros") - F.lag("micros").over(order)
    again = F.lit(False) if forget is None else F.coalesce(step > forget * 1_000_000, F.lit(False))
    rows = rows.withColumns({"_again": again, "_long": F.coalesce(F.floor(step / 1_000_000) > gap, F.lit(False))})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_chain", F.sum(F.col("_again").cast("long")).over(so_far))
    within = Window.partitionBy("domain", "url", "_chain").orderBy("micros", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("denied", F.max(F.col("denied") | (F.col("_long") & ~F.col("_again"))).over(within)).drop("_again", "_long", "_chain")


def dedup_links(urls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(project_id, domain, path, query): one row a link of ``urls(project_id, url)``, without those in ``known``."""
    links = urls.select("project_id", parse_link(F.col("url")).alias("l")).select("project_id", "l.*").where("domain is not null")
    return new_links(links, known) if known is not None else links.dropDuplicates(["project_id", *LINK_KEY])


def new_links(found: DataFrame, known: DataFrame) -> DataFrame:
    """Links of found that are not in known; a missing query equals a missing query."""
    return found.select("project_id", *LINK_KEY).distinct().exceptAll(known.select("project_id", *LINK_KEY).distinct())


def dedup_search_terms(terms: DataFrame, known: DataFrame) -> DataFrame:
    return terms.select("project_id", "term").distinct().join(known.select("project_id", "term"), ["project_id", "term"], "left_anti")


def links_per_domain(links: DataFrame) -> DataFrame:
    return links.groupBy("project_id", "domain").agg(F.count("*").alias("links"))


def site_scoped_terms(terms: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each term with each seed domain of its project, as ``term site:domain``; the bare term where there is none."""
    scoped = terms.join(seed_domains(seeds), "project_id", "left")
    return scoped.select("project_id", F.when(F.col("domain").isNull(), F.col("term")).otherwise(F.concat("term", F.lit(" site:"), "domain")).alias("term"))
