"""A catalog in a folder: raw pages, parsed pages and mappings in snapshots, and an event log.

The three tables change in one commit (`sources.snapshots`): a change reads one snapshot and replaces it, or is refused if another writer was first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import strings as S
from .operators import analytics as O
from .operators import catalog as C
from .operators import compare as D
from .operators import explain as E
from .shipping import ship
from .sources.sinks import append_event
from .sources.snapshots import ReadOnly, Snapshot, Snapshots

RAW = "source string, text string, generated_at timestamp, generator string, generator_version string, sha string"
PARSED = f"source string, name string, section string, synopsis string, aliases array<struct<name:string,score:int>>, dashless boolean, subcommands array<string>, nested boolean, nested_end array<string>, options array<{E.OPTION}>, extractor string, model string, updated boolean"
MAPPINGS = "src string, dst string, score int"
EVENTS = "timestamp timestamp, event string, metadata string"


class Duplicate(ValueError):
    """A page of this name, section, distro and release is stored under another source."""


class Catalog:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, version: int | None = None):
        """Read-only, or pinned to one snapshot (and so read-only), or open for changes."""
        self.spark, self.path = ship(spark), path.rstrip("/")
        self._store = Snapshots(spark, f"{self.path}/tables", read_only or version is not None)
        self._pinned = None if version is None else self._store.at(version)

    def create(self) -> Catalog:
        if not self._store.versions():
            self._store.commit({name: self.spark.createDataFrame([], schema) for name, schema in (("raw", RAW), ("parsed", PARSED), ("mappings", MAPPINGS))})
        return self

    def drop_all(self, confirm: bool = False) -> None:
        """All pages and mappings go; earlier snapshots stay."""
        if not confirm:
            raise ValueError("not confirmed")
        now = self._now()
        self._store.commit({name: now.read(name).limit(0) for name in now.folders}, now)

    def _now(self) -> Snapshot:
        return self._pinned or self._store.newest()

    @property
    def version(self) -> int:
        return self._now().version

    def pinned(self, version: int | None = None) -> Catalog:
        """The catalog as it is now (or was), for reading."""
        return Catalog(self.spark, self.path, version=self.version if version is None else version)

    @property
    def raw(self) -> DataFrame:
        return self._now().read("raw")

    @property
    def parsed(self) -> DataFrame:
        return self._now().read("parsed")

    @property
    def mappings(self) -> DataFrame:
        return self._now().read("mappings")

    def _scoped(self, parsed: DataFrame) -> DataFrame:
        return parsed.withColumn("distro", S.distro("source")).withColumn("release", S.release("source"))

    # Changes: each reads one snapshot and commits the next.

    def add_pages(self, raw: DataFrame, parsed: DataFrame) -> None:
        """Stores pages and the mappings of their aliases; a page that is there is replaced, and its other mappings go."""
        now = self._now()
        if not raw.where(~S.is_source("source")).isEmpty():
            raise ValueError("a source is malformed")
        old = now.read("parsed").join(parsed.select("source"), "source", "left_anti")
        if not C.duplicates_on_insert(self._scoped(old), self._scoped(parsed)).isEmpty():
            raise Duplicate
        kept = C.delete_pages(parsed, now.read("raw"), now.read("parsed"), now.read("mappings"))
        new = parsed.select(F.explode("aliases").alias("a"), "source").select(F.col("a.name").alias("src"), F.col("source").alias("dst"), F.col("a.score").cast("int").alias("score")).dropDuplicates(["src", "dst"])
        self._store.commit({"raw": kept[0].unionByName(raw.select(*kept[0].columns)), "parsed": kept[1].unionByName(parsed.select(*kept[1].columns)), "mappings": kept[2].unionByName(new)}, now)

    def delete(self, sources: DataFrame) -> None:
        now = self._now()
        kept = C.delete_pages(sources, now.read("raw"), now.read("parsed"), now.read("mappings"))
        self._store.commit(dict(zip(("raw", "parsed", "mappings"), kept, strict=True)), now)

    def add_mappings(self, new: DataFrame) -> None:
        now = self._now()
        self._store.commit({"mappings": C.add_mappings(now.read("mappings"), new)}, now)

    def upgrade_aliases(self, aliases: DataFrame) -> None:
        now = self._now()
        stored = aliases.join(now.read("parsed").select("source"), F.col("dst") == F.col("source"), "left_semi")
        self._store.commit({"mappings": C.upgrade_aliases(now.read("mappings"), stored)}, now)

    def _reconciled(self, parsed: DataFrame, mappings: DataFrame) -> DataFrame:
        pages = self._scoped(parsed)
        parents = pages.where(F.size("subcommands") > 0).select("name", "distro", "release", "subcommands")
        return C.reconcile_subcommands(pages, mappings, parents)

    def reconcile(self) -> int:
        """Subcommand mappings as the parents declare them; how many there are."""
        now = self._now()
        after = self._store.commit({"mappings": self._reconciled(now.read("parsed"), now.read("mappings"))}, now)
        return after.read("mappings").where(F.col("src").contains(" ") & (F.col("score") == 1)).count()

    def map_extracted(self, aliases: DataFrame) -> int:
        """What follows an extraction, in one commit: aliases (src, dst) of pages that are stored, then subcommands; how many mappings there are."""
        now = self._now()
        stored = aliases.join(now.read("parsed").select("source"), F.col("dst") == F.col("source"), "left_semi")
        after = self._store.commit({"mappings": self._reconciled(now.read("parsed"), C.upgrade_aliases(now.read("mappings"), stored))}, now)
        return after.read("mappings").count()

    def vacuum(self, keep: int = 2, older_than: float = 7 * 86_400) -> list[str]:
        return self._store.vacuum(keep, older_than)

    def log_event(self, event: str, metadata: dict) -> None:
        if self._store.read_only:
            raise ReadOnly(self.path)
        append_event(self.spark, f"{self.path}/events", event, metadata)

    # Queries.

    def find(self, names: DataFrame, distro: str | None = None, release: str | None = None) -> DataFrame:
        return C.find_pages(names, self.parsed, self.mappings, distro, release)

    def page(self, name: str, distro: str | None = None, release: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(the winner's row, the other candidates and its suggestions by section)."""
        found = self.find(self.spark.createDataFrame([(1, name)], "query_id int, name string"), distro, release)
        won = self.parsed.join(found.where("rank = 1").select("source"), "source", "left_semi")
        more = C.suggestions(won, self.mappings).select(F.col("other").alias("source"))
        others = found.where("rank > 1").select("source").unionByName(C.in_scope(more, "source", distro, release)).distinct()
        return won, others.orderBy(S.section_of("source"), "source")

    def raw_page(self, source: str) -> DataFrame:
        """At most one row; shown as HTML where a Markdown generator made it."""
        return self.raw.where(F.col("source") == source).select("source", "text", F.coalesce(F.col("generator").contains("markdown"), F.lit(False)).alias("as_html"))

    def explain(self, commands: DataFrame, distro: str | None = None, release: str | None = None) -> DataFrame:
        return E.explain(commands, self.parsed, self.mappings, distro, release)

    def explain_preferring(self, commands: DataFrame, preferred: str = "ubuntu") -> DataFrame:
        """Each line in the one distro and release that its first found command has, the preferred and newest before others."""
        order = C.preference(C.distro_releases(self.parsed), preferred)
        keys = commands.select("query_id", F.posexplode(E.names_in("cmd")).alias("pos", "name"))
        hits = keys.join(self.mappings.select(F.col("src").alias("name"), F.col("dst").alias("source")), "name")
        hits = hits.withColumn("distro", S.distro("source")).withColumn("release", S.release("source"))
        anchor = C.anchored(hits, order).select("query_id", "distro", "release").distinct()
        scope = F.concat("distro", F.lit("/"), "release", F.lit("/"))
        return E.explain(commands.join(anchor, "query_id", "left"), self.parsed, self.mappings, scope=scope)

    def distros(self) -> DataFrame:
        return C.distro_releases(self.parsed).orderBy("distro", "release")

    def default_distro(self, preferred: str = "ubuntu") -> DataFrame:
        return C.preference(C.distro_releases(self.parsed), preferred).where("rank = 1").drop("rank")

    def sections(self, distro: str, release: str) -> DataFrame:
        return C.sections(self.parsed, distro, release).orderBy("section")

    def pages_below(self, prefix: str) -> DataFrame:
        return C.section_pages(self.parsed, prefix).orderBy("source")

    def mappings_below(self, prefix: str | None = None) -> DataFrame:
        m = self.mappings.select("src", "dst")
        return (C.with_prefix(m, "dst", prefix) if prefix else m).orderBy("src", "dst")

    def stats(self) -> DataFrame:
        """what, n: totals, then pages of each distro and release. As ever, `manpages` counts the parsed ones."""
        total = lambda n, df: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n")
        per = self.parsed.groupBy(S.scope_prefix("source").alias("what")).agg(F.count("*").alias("n"))
        return total("manpages", self.parsed).unionByName(total("mappings", self.mappings)).unionByName(total("raw", self.raw)).unionByName(per.orderBy("what"))

    def events(self, n: int = 20, event: str | None = None) -> DataFrame:
        """The newest n, oldest first."""
        e = self.spark.read.schema(EVENTS).parquet(f"{self.path}/events")
        e = e.where(F.col("event") == event) if event else e
        return O.latest(e, "timestamp", "metadata", n).orderBy("timestamp", "metadata")

    def check(self) -> DataFrame:
        pages = self._scoped(self.parsed)
        parents = pages.where(F.size("subcommands") > 0).select("name", "distro", "release", "subcommands")
        options = pages.select("source", F.explode("options").alias("o")).select("source", "o.short", "o.long", "o.positional")
        return C.check_all(pages, self.mappings, parents, options)

    def diff(self, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(page fields, options) in which freshly parsed pages differ from the stored ones."""
        each = lambda df: df.select("source", F.posexplode("options").alias("idx", "o")).select("source", "idx", "o.*")
        fields = ("name", "synopsis", "dashless", "extractor", "updated", "nested")
        return D.compare_fields(self.parsed, fresh, "source", fields), D.compare_options(each(self.parsed.join(fresh.select("source"), "source", "left_semi")), each(fresh), "source", "idx", ("text", "has_arg", "positional", "prefix", "nested"))

    def plan(self, files: DataFrame, **how) -> DataFrame:
        """What an extraction would do with each file (pos, source, sha, length, canonical)."""
        known = C.known_hashes(self.raw, self.parsed)
        return D.classify(files, self.parsed.select("source", "extractor", "model"), known, **how)
