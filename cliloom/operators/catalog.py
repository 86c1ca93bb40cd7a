"""The catalog: lookups, suggestions, integrity checks and versioned changes, set at a time.

Tables: pages (source, name, ...), mappings (src, dst, score).  Lookups take a
table of names, so a thousand commands cost one join, not a thousand probes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S

#: Fixed value: a name's pages meet in so many parts, each a task's work.
NAME_PARTS = 4

# Filters.


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Pushed down to the scan as a prefix."""
    return df.where(F.col(column).startswith(prefix))


def with_prefix_range(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """The same as a half-open range, for stores that only know comparisons."""
    return df.where((F.col(column) >= prefix) & (F.col(column) < prefix[:-1] + chr(ord(prefix[-1]) + 1)))


def in_scope(df: DataFrame, column: str, distro: str | None, release: str | None) -> DataFrame:
    """Only where both are given."""
    return with_prefix(df, column, f"{distro}/{release}/") if distro and release else df


def known_scope(pages: DataFrame, distro: str, release: str | None = None) -> bool:
    """The guard before a scoped query: whether there is a source of this distro (and release)."""
    return not with_prefix(pages, "source", f"{distro}/{release}/" if release else f"{distro}/").limit(1).isEmpty()


def in_set(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(F.col(key).alias("_key")).distinct(), F.col(column) == F.col("_key"), "left_semi")


def not_in_set(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(F.col(key).alias("_key")).distinct(), F.col(column) == F.col("_key"), "left_anti")


# Lookups.


def find_pages(names: DataFrame, pages: DataFrame, mappings: DataFrame, distro: str | None = None, release: str | None = None, scope: str | None = None) -> DataFrame:
    """For each of `names` (query_id, name): candidates with rank 1 for the winner, or an error.

    A name ending in .gz is a source.  Else its mappings count; where there are
    none, the part behind the last dot is a section, whose pages come first and
    must be there.  Higher scores come first, then lower sources.  Only source,
    name, section and score travel; whoever wants a whole page joins the winner.
    `scope` names a column of `names`: what a row's sources have to start with.
    Neither pages nor mappings are broadcast, whatever their files' size says: they are
    shuffled once, by source and by name.
    """
    pages = in_scope(pages.select("source", "name", "section"), "source", distro, release)
    maps = mappings.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("score").cast("int").alias("_score"))
    pages, maps = pages.hint("merge"), maps.hint("merge")
    prefix = F.coalesce(F.col(scope), F.lit("")) if scope else F.lit("")
    named = names.select("query_id", "name", prefix.alias("_scope")).withColumn("_exact", F.col("name").endswith(".gz"))
    inside = F.col("source").startswith(F.col("_scope"))
    exact = named.where("_exact").join(pages.withColumnRenamed("name", "_n"), (F.col("name") == F.col("source")) & inside).select("query_id", F.col("name").alias("asked"), "source", F.col("_n").alias("page"), "section", F.lit(10).alias("score"), F.lit(None).cast("string").alias("wanted"))
    rest = named.where("not _exact")
    direct = rest.join(maps, F.col("name") == F.col("_src"))
    missing = rest.join(maps.select("_src").distinct(), F.col("name") == F.col("_src"), "left_anti").where("name <> '.'")
    parted = missing.withColumn("_s", S.split_section("name")).where(F.col("_s.section").isNotNull())
    dotted = parted.join(maps, F.col("_s.name") == F.col("_src"))
    hits = direct.select("query_id", "name", "_scope", "_dst", "_score", F.lit(None).cast("string").alias("wanted")).unionByName(dotted.select("query_id", "name", "_scope", "_dst", "_score", F.col("_s.section").alias("wanted")))
    hits = hits.join(pages.withColumnRenamed("name", "page"), (F.col("_dst") == F.col("source")) & inside).select("query_id", F.col("name").alias("asked"), "source", "page", "section", F.col("_score").alias("score"), "wanted")
    has = F.max(F.coalesce(F.col("section") == F.col("wanted"), F.lit(False))).over(Window.partitionBy("query_id"))
    found = hits.unionByName(exact).withColumn("_has", has).where(F.col("wanted").isNull() | F.col("_has"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(F.col("section") == F.col("wanted"), F.lit(False))), F.desc("score"), "source")
    found = found.withColumn("rank", F.row_number().over(order)).drop("_has", "wanted")
    lost = names.join(found.select("query_id").distinct(), "query_id", "left_anti")
    section_missed = lost.join(parted.select("query_id", F.col("_s.name").alias("_short")).join(maps, F.col("_short") == F.col("_src")).select("query_id").distinct().withColumn("_seen", F.lit(True)), "query_id", "left")
    short = F.when(F.col("name").endswith(".gz") | (F.col("name") == ".") | F.col("_seen").isNotNull(), F.col("name")).otherwise(S.split_section("name")["name"])
    errors = section_missed.select("query_id", F.col("name").alias("asked"), short.alias("error"))
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


def suggestions(sources: DataFrame, mappings: DataFrame) -> DataFrame:
    """source, other: pages that share a name with the source, itself left out.

    A name of n pages gives n * (n - 1) pairs.  Of the names that two pages share only the least
    gives the pair, so pairs are distinct as they come: mappings are shuffled, pairs never are.
    """
    names = mappings.where("src is not null and dst is not null").groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("_all"))
    # Names of a page with several; most have one, and need no comparing.
    each = names.select("dst", F.when(F.size("_all") > 1, F.col("_all")).alias("_names"), F.explode("_all").alias("src"))
    own = each.join(sources.select(F.col("source").alias("dst")).distinct().hint("merge"), "dst", "left_semi")
    own = own.select(F.col("dst").alias("source"), F.col("_names").alias("_own"), "src", F.pmod(F.xxhash64("dst"), F.lit(NAME_PARTS)).alias("_part"))
    others = each.select(F.col("dst").alias("other"), F.col("_names").alias("_its"), "src", F.explode(F.sequence(F.lit(0), F.lit(NAME_PARTS - 1)).cast("array<bigint>")).alias("_part"))
    least = F.col("_own").isNull() | F.col("_its").isNull() | (F.array_min(F.array_intersect("_own", "_its")) == F.col("src"))
    return own.join(others.hint("merge"), ["src", "_part"]).where((F.col("other") != F.col("source")) & least).select("source", "other")


def distros_for_name(name: str, pages: DataFrame, mappings: DataFrame) -> DataFrame:
    return mappings.where(F.col("src") == name).join(pages.select("source"), F.col("dst") == F.col("source"), "left_semi").select(S.distro("dst").alias("distro"), S.release("dst").alias("release")).distinct()


def distros_with_all(names: list[str], pages: DataFrame, mappings: DataFrame) -> DataFrame:
    """(distro, release) pairs that have every name."""
    hits = mappings.where(F.col("src").isin(names)).join(pages.select("source"), F.col("dst") == F.col("source"), "left_semi")
    return hits.select("src", S.distro("dst").alias("distro"), S.release("dst").alias("release")).groupBy("distro", "release").agg(F.count_distinct("src").alias("_n")).where(F.col("_n") == len(set(names))).drop("_n")


def preference(distros: DataFrame, preferred: str) -> DataFrame:
    """Ranked: the preferred distro first, then newer releases."""
    return distros.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("distro") == preferred), F.desc("release"), "distro")))


def anchored(found: DataFrame, order: DataFrame) -> DataFrame:
    """found: query_id, pos, name, distro, release, source.  The first command with a page picks its best-ranked
    (distro, release) for the whole query; later commands are only looked up there."""
    ranked = found.join(order, ["distro", "release"])
    first = ranked.groupBy("query_id").agg(F.min(F.struct("pos", "rank", "distro", "release")).alias("_a"))
    return ranked.join(first, "query_id").where((F.col("distro") == F.col("_a.distro")) & (F.col("release") == F.col("_a.release"))).drop("_a", "rank")


def anchored_lookup(commands: DataFrame, places: DataFrame, order: DataFrame) -> DataFrame:
    """The same from commands (query_id, pos, name) and places (name, distro, release, source), each place of a name once.

    A name's best place decides, so commands meet one row of a name before they have their
    (distro, release), and one after: never all places of all commands.
    """
    best = places.join(order, ["distro", "release"]).groupBy("name").agg(F.min(F.struct("rank", "distro", "release")).alias("_best"))
    first = commands.join(best, "name").groupBy("query_id").agg(F.min(F.struct("pos", "_best"))["_best"].alias("_a"))
    picked = commands.select("query_id", "pos", "name").distinct().join(first, "query_id").select("query_id", "pos", "name", "_a.distro", "_a.release")
    return picked.join(places, ["name", "distro", "release"]).select("query_id", "pos", "name", "distro", "release", "source")


def known_hashes(raw: DataFrame, pages: DataFrame, sha: str = "sha") -> DataFrame:
    """key, source: the first stored page for content within a folder."""
    return raw.where(F.col(sha).isNotNull()).join(pages.select("source"), "source", "left_semi").groupBy(S.dedup_key(sha, "source").alias("key")).agg(F.min("source").alias("source"))


def mapping_scores(pairs: DataFrame, mappings: DataFrame) -> DataFrame:
    """src, dst, score: null where there is no such mapping."""
    return pairs.select("src", "dst").join(mappings.select("src", "dst", "score"), ["src", "dst"], "left")


# Integrity checks: severity, code, message.


def _issue(df: DataFrame, severity: str, code: str, message: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def malformed_sources(pages: DataFrame) -> DataFrame:
    return _issue(pages.where(~S.is_source("source")), "error", "malformed_source", F.concat(F.lit("malformed source: "), F.col("source")))


def shadowed_pages(pages: DataFrame) -> DataFrame:
    """Pages of a name, section, distro and release behind the first by source."""
    w = Window.partitionBy("name", "section", "distro", "release").orderBy("source")
    later = pages.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("source").over(w)).where("_n > 1")
    return _issue(later, "error", "shadowed", F.concat(F.col("source"), F.lit(" is shadowed by "), F.col("_first")))


def orphaned_mappings(pages: DataFrame, mappings: DataFrame) -> DataFrame:
    lost = mappings.join(pages.select("source"), F.col("dst") == F.col("source"), "left_anti")
    return _issue(lost, "error", "orphan", F.concat(F.lit("mapping "), F.col("src"), F.lit(" leads to missing "), F.col("dst")))


def flagged_positionals(options: DataFrame) -> DataFrame:
    """options: source, short, long, positional."""
    bad = options.where(F.col("positional").isNotNull() & ((F.size("short") > 0) | (F.size("long") > 0)))
    return _issue(bad, "warning", "positional_flag", F.concat(F.col("source"), F.lit(": positional "), F.col("positional"), F.lit(" has flags")))


def stale_subcommands(pages: DataFrame, mappings: DataFrame, parents: DataFrame) -> DataFrame:
    """Mappings of two words whose parent (name, distro, release, subcommands) is missing or doesn't declare them."""
    own = mappings.join(pages.select("source", F.col("name").alias("_own")), F.col("dst") == F.col("source")).where(F.col("src").contains(" ") & (F.col("src") != F.col("_own")))
    own = own.select("src", "dst", F.substring_index("src", " ", 1).alias("_parent"), F.substr(F.col("src"), F.instr(F.col("src"), " ") + 1).alias("_sub"), S.distro("dst").alias("_d"), S.release("dst").alias("_r"))
    of = ["_parent", "_d", "_r"]
    p = parents.select(F.col("name").alias("_parent"), F.col("distro").alias("_d"), F.col("release").alias("_r"), "subcommands")
    declared = p.select(*of, F.explode("subcommands").alias("_sub")).distinct()
    missing = _issue(own.join(p.select(of).distinct(), of, "left_anti"), "error", "parent_missing", F.concat(F.col("src"), F.lit(" -> "), F.col("dst")))
    undeclared = own.join(p.select(of).distinct(), of, "left_semi").join(declared, [*of, "_sub"], "left_anti")
    undeclared = _issue(undeclared, "warning", "not_declared", F.concat(F.col("src"), F.lit(" -> "), F.col("dst")))
    return missing.unionByName(undeclared)


def unreachable_pages(pages: DataFrame, mappings: DataFrame) -> DataFrame:
    lost = pages.join(mappings.select("dst").distinct(), F.col("source") == F.col("dst"), "left_anti")
    return _issue(lost, "warning", "unreachable", F.concat(F.col("source"), F.lit(" has no mapping")))


def corrupt_options(pages: DataFrame, options: str) -> DataFrame:
    """Pages whose options aren't JSON; missing and empty ones are none."""
    bad = pages.where((F.coalesce(options, F.lit("")) != "") & F.try_parse_json(options).isNull())
    return _issue(bad, "error", "corrupt_options", F.concat(F.col("source"), F.lit(" has options that are no JSON")))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def check_all(pages: DataFrame, mappings: DataFrame, parents: DataFrame, options: DataFrame | None = None, options_json: str | None = None) -> DataFrame:
    """All issues; `options_json` names a column of `pages` that holds options as JSON."""
    out = malformed_sources(pages).unionByName(shadowed_pages(pages)).unionByName(orphaned_mappings(pages, mappings)).unionByName(stale_subcommands(pages, mappings, parents)).unionByName(unreachable_pages(pages, mappings))
    if options is not None:
        out = out.unionByName(flagged_positionals(options))
    return out.unionByName(corrupt_options(pages, options_json)) if options_json else out


def has_errors(issues: DataFrame) -> bool:
    return not issues.where("severity = 'error'").isEmpty()


# Changes: each gives the next version of a table.


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    return old.join(new, key, "left_anti").unionByName(new.select(*old.columns))


def duplicates_on_insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New pages whose name, section, distro and release are stored under another source."""
    keys = ["name", "section", "distro", "release"]
    return new.join(old.select(*keys, F.col("source").alias("stored")), keys).where("stored <> source").select("source", "stored")


def delete_pages(gone: DataFrame, pages: DataFrame, parsed: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the sources and what hangs on them."""
    g = gone.select("source").distinct()
    return pages.join(g, "source", "left_anti"), parsed.join(g, "source", "left_anti"), mappings.join(g, F.col("dst") == g["source"], "left_anti")


def add_mappings(mappings: DataFrame, new: DataFrame) -> DataFrame:
    """A pair that is there already is an error."""
    clash = new.join(mappings, ["src", "dst"], "left_semi")
    if not clash.isEmpty():
        raise ValueError("a mapping is there already")
    return mappings.unionByName(new.select(*mappings.columns))


def set_score(mappings: DataFrame, src: str, dst: str, score: int) -> DataFrame:
    return mappings.withColumn("score", F.when((F.col("src") == src) & (F.col("dst") == dst), F.lit(score)).otherwise(F.col("score")).cast("int"))


def upgrade_aliases(mappings: DataFrame, aliases: DataFrame, score: int = 10) -> DataFrame:
    """Alias pairs (src, dst) are there with at least this score."""
    raised = aliases.select("src", "dst", F.lit(score).alias("score"))
    return mappings.select("src", "dst", "score").unionByName(raised).groupBy("src", "dst").agg(F.max("score").cast("int").alias("score"))


def valid_subcommands(parents: DataFrame, children: DataFrame) -> DataFrame:
    """src, dst: `parent sub` for each declared subcommand whose page `parent-sub` is in the same distro and release."""
    p = parents.select(F.col("name").alias("_p"), "distro", "release", F.explode("subcommands").alias("_s")).distinct()
    p = p.withColumn("_child", F.concat_ws("-", "_p", "_s"))
    c = children.select(F.col("name").alias("_child"), "distro", "release", F.col("source").alias("dst"))
    return p.join(c, ["_child", "distro", "release"]).select(F.concat_ws(" ", "_p", "_s").alias("src"), "dst").distinct()


def reconcile_subcommands(pages: DataFrame, mappings: DataFrame, parents: DataFrame) -> DataFrame:
    """Mappings without the two-word ones, but for a page's own name, and with the valid ones at score 1."""
    own = pages.select(F.col("source").alias("dst"), F.col("name").alias("src"))
    two = F.col("src").contains(" ")
    kept = mappings.where(~two).unionByName(mappings.where(two).join(own, ["src", "dst"], "left_semi"))
    valid = valid_subcommands(parents, pages).join(kept, ["src", "dst"], "left_anti").withColumn("score", F.lit(1))
    return kept.select("src", "dst", F.col("score").cast("int").alias("score")).unionByName(valid)


def lost_on_reimport(mappings: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """The mappings of `pages` (source), which come again, that aren't among their new aliases (src, dst)."""
    return mappings.join(pages.select(F.col("source").alias("dst")).distinct(), "dst", "left_semi").join(aliases.select("src", "dst"), ["src", "dst"], "left_anti")


# Browsing.


def distro_releases(pages: DataFrame) -> DataFrame:
    return pages.select(S.distro("source").alias("distro"), S.release("source").alias("release")).distinct()


def sections(pages: DataFrame, distro: str, release: str) -> DataFrame:
    return with_prefix(pages, "source", f"{distro}/{release}/").select(F.split_part("source", F.lit("/"), F.lit(3)).alias("section")).distinct()


def section_pages(pages: DataFrame, prefix: str) -> DataFrame:
    """source, name, section and the quoted tail of its address."""
    tail = F.replace(F.url_encode(F.concat_ws(".", S.page_name("source"), S.section_of("source"))), F.lit("+"), F.lit("%20"))
    return with_prefix(pages, "source", prefix).select("source", S.page_name("source").alias("name"), S.section_of("source").alias("section"), tail.alias("tail"))
