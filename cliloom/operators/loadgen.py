"""Command lines for load tests: templates filled by the keys of a table's rows, so every run makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMPLE = ("ls -l", "tar -xzf a.tgz", "grep -r x .", "ps aux", "du -sh *", "find . -name y", "wc -l z", "sort -u q", "cut -f1 t", "df -h")
TEMPLATES: dict[str, tuple[str, tuple[tuple[str, ...], ...]]] = {
    "pipeline": ("%s | grep %s | sort %s | head -n %s", (("cat /etc/hosts", "ps aux", "ls -1"), ("-v root", "-i x", "-c y"), ("-u", "-r", "-n"), ("5", "10", "20"))),
    "clone": ("(cd $(mktemp -d) && git clone %s %s && cd %s)", (("--depth 1", "--bare", "-q"), ("https://h/a", "https://h/b"), ("a", "b"))),
    "log": ("zcat %s | awk '%s' | uniq -c | sort %s", (("a.gz", "b.gz"), ("{print $1}", "{print $7}"), ("-rn", "-n"))),
    "tags": ("perl -ne '%s' %s", (("print if /x/", "s/a/b/; print"), ("f.txt", "g.txt"))),
    "link": ("ln %s %s %s", (("-f", "-v", "-s"), ("a", "b"), ("c", "d"))),
}


def _place(slot: int, seed: int, n: int, key: str) -> str:
    """SQL, Spark's and others': a place among n, from 1, by a row's key and a slot's number."""
    return f"1 + (({key} * 7919 + {slot * 104_729 + seed * 15_485_863}) DIV 13) % {n}"


def pick(values: tuple[str, ...], slot: int, seed: int, key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(_place(slot, seed, len(values), key)).cast("int"))


def commands(rows: DataFrame, key: str, simple_share: float = 0.5, seed: int = 42) -> DataFrame:
    """key, cmd: a line for each row (of a log, say), by its key, a whole number from 0; the same row always gives the same line."""
    filled, slot = [], 2
    for text, slots in TEMPLATES.values():
        filled.append(F.format_string(text, *(pick(v, slot + i, seed, key) for i, v in enumerate(slots))))
        slot += len(slots)
    which = F.element_at(F.array(*filled), F.expr(_place(0, seed, len(filled), key)).cast("int"))
    simple = F.expr(_place(1, seed, 1000, key)) <= round(simple_share * 1000)
    return rows.select(key, F.when(simple, pick(SIMPLE, slot, seed, key)).otherwise(which).alias("cmd"))


def commands_sql(table: str, key: str, simple_share: float = 0.5, seed: int = 42) -> str:
    """The same in SQL."""
    quoted = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
    place = lambda slot, n: _place(slot, seed, n, key).replace("DIV", "//")
    filled, slot = [], 2
    for text, slots in TEMPLATES.values():
        parts, pieces = text.split("%s"), []
        for i, v in enumerate(slots):
            pieces += ["'" + parts[i].replace("'", "''") + "'", f"list_extract({quoted(v)}, {place(slot + i, len(v))})"]
        filled.append(" || ".join([*pieces, "'" + parts[-1].replace("'", "''") + "'"]))
        slot += len(slots)
    simple = f"list_extract({quoted(SIMPLE)}, {place(slot, len(SIMPLE))})"
    return f"SELECT {key}, CASE WHEN {place(1, 1000)} <= {round(simple_share * 1000)} THEN {simple} ELSE list_extract([{', '.join(filled)}], {place(0, len(filled))}) END AS cmd FROM {table}"
