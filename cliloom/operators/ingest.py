"""A page dump and archive links into one page for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from .analytics import rank_then_pick

STANDARD = ("/usr/share/man/", "/usr/local/share/man/")


def raw_pages(files: DataFrame, generator: str, version: str) -> DataFrame:
    """files: source, text, content (the packed file's bytes).  Raw pages with a digest of the file and what made the text."""
    return files.select("source", "text", F.current_timestamp().alias("generated_at"), F.lit(generator).alias("generator"), F.lit(version).alias("generator_version"), F.sha2("content", 256).alias("sha"))


def wanted_locale(c: str = "locale") -> Column:
    return (F.coalesce(F.col(c), F.lit("")) == "") | F.col(c).startswith("en")


def wanted_section(c: str = "section", only: tuple[str, ...] = ()) -> Column:
    first = F.substring(c, 1, 1)
    return first.rlike(r"\d") & (first.isin(*only) if only else F.lit(True))


def on_standard_path(c: str = "path") -> Column:
    return F.col(c).startswith(STANDARD[0]) | F.col(c).startswith(STANDARD[1])


def system_like(c: str, text: str) -> Column:
    return F.lower(c).contains(text.lower())


def pick_pages(files: DataFrame, versions: DataFrame, packages: DataFrame, systems: DataFrame, mans: DataFrame, system: str) -> DataFrame:
    """files: version_id, man_id, path, locale, hash; versions: id, package_id, released; packages: id, system_id, name; systems: id, name; mans: id, name, section.

    The dimensions are joined from the smallest on, so the files are probed once.
    """
    p = packages.join(systems.where(system_like("name", system)).select(F.col("id").alias("_s")), F.col("system_id") == F.col("_s"), "left_semi")
    v = versions.join(p.select(F.col("id").alias("package_id"), F.col("name").alias("package")), "package_id").select(F.col("id").alias("version_id"), "package", "released")
    m = mans.where(wanted_section()).select(F.col("id").alias("man_id"), "name", "section")
    rows = files.where(wanted_locale()).join(v, "version_id").join(m, "man_id")
    rows = rows.select(F.concat_ws(".", "name", "section").alias("key"), "package", S.lenient_date("released").alias("released"), "hash", on_standard_path().alias("standard"), "path")
    return rank_then_pick(rows)


def wanted_contents(contents: DataFrame, picked: DataFrame) -> DataFrame:
    """contents: value, a line of id, a tab, another field, a tab, escaped text."""
    parts = F.split("value", "\t", 3)
    rows = contents.select(parts[0].alias("hash"), parts[2].alias("raw"))
    return rows.join(picked.select(F.col("hash").cast("string").alias("hash")).distinct(), "hash", "left_semi").select("hash", S.unescape_copy("raw").alias("text"))


def follow_links(links: DataFrame, hops: int = 10) -> DataFrame:
    """src, dst, depth: each link to the end of its chain; links in a circle, or with more hops, have dst null.

    By doubling: each round joins chains with chains, so ten hops take four rounds.
    """
    nodes = links.select("src", F.col("dst").alias("at"), F.lit(1).alias("depth"))
    reach = 1
    while reach < hops + 1:
        onward = nodes.select(F.col("src").alias("_s"), F.col("at").alias("_a"), F.col("depth").alias("_d"))
        nodes = nodes.join(onward, F.col("at") == F.col("_s"), "left").select("src", F.coalesce("_a", "at").alias("at"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
        reach *= 2
    ends = links.select(F.col("src").alias("_l")).distinct()
    return nodes.join(ends, F.col("at") == F.col("_l"), "left").select("src", F.when(F.col("_l").isNull() & (F.col("depth") <= hops), F.col("at")).alias("dst"), F.when(F.col("_l").isNull(), F.col("depth")).alias("depth"))


def redirect_candidates(pages: DataFrame, known: DataFrame) -> DataFrame:
    """pages: path, section, text.  source, target: `.so` pages with the first candidate that is there."""
    t = pages.withColumn("_t", S.redirect_target("text")).where("_t is not null")
    folder = F.regexp_extract("_t", r"^man(\w+)/(.+)$", 1)
    file = F.substring_index("_t", "/", -1)
    own = F.concat(F.col("section"), F.lit("/"), file)
    options = F.array(F.when(folder != "", F.concat(folder, F.lit("/"), file)), own)
    each = t.select("path", F.posexplode(F.array_compact(options)).alias("i", "target"))
    hit = each.join(known.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return hit.groupBy("path").agg(F.min_by("target", "i").alias("target"))


def archive_entries(entries: DataFrame) -> DataFrame:
    """entries: path, target (of links).  Files and links of man sections 1 and 8, moved; links elsewhere are dropped."""
    moved = S.rewritten_link("path")
    to = F.when(F.col("target").isNotNull(), S.rewritten_link("target"))
    out = entries.where(F.col("path").rlike(r"(^|/)man[18]/")).select("path", moved.alias("moved"), to.alias("link"), (F.col("target").isNotNull() & to.isNull()).alias("dropped"))
    return out.withColumn("outcome", F.when(F.col("dropped"), "dropped").when(F.col("link").isNotNull(), "link").otherwise("file")).drop("dropped")


# Exports of a document database.


def unwrapped_id(c: str) -> Column:
    """{"$oid": x} to x; other text as it is."""
    return F.coalesce(F.get_json_object(c, "$['$oid']"), F.col(c))


def coerced_bool(c: str, default: bool) -> Column:
    """JSON text of a bool or a number; anything else is the default."""
    v = F.try_parse_json(c)
    return F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(default))
