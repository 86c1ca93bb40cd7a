"""Scalar functions on page sources, texts, numbers, dates and network values, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a page's source looks like.
SOURCE = r"^[a-zA-Z][a-zA-Z0-9_-]*/[^/]+/[^/]+/[^/]+\.\d\w*\.gz$"
#: The separators that end a token of a logged command.
SEPARATORS = " \t\n|&;<>()\"'`$={}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Sources and paths.


def is_source(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(SOURCE), F.lit(False))


def distro(source: Column | str) -> Column:
    """Before the first slash; empty where there is none."""
    s = col(source)
    return F.substring(s, F.lit(1), F.greatest(F.instr(s, "/") - 1, F.lit(0)))


def release(source: Column | str) -> Column:
    return F.when(F.instr(col(source), "/") > 0, F.split_part(col(source), F.lit("/"), F.lit(2))).otherwise("")


def scope_prefix(source: Column | str) -> Column:
    """distro/release/"""
    return F.concat(F.substring_index(col(source), "/", 2), F.lit("/"))


def source_of_path(path: Column | str) -> Column:
    """The last four components; the whole path where there are fewer."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) < 4, col(path)).otherwise(F.array_join(F.slice(parts, -4, 4), "/"))


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def page_name(source: Column | str) -> Column:
    """The basename without its last two parts (section and gz)."""
    return F.regexp_replace(basename(source), r"\.[^.]*\.[^.]*$", "")


def split_section(name: Column | str) -> Column:
    """Struct of name and section around the last dot; a lone dot isn't parted."""
    n = col(name)
    dotted = n.contains(".") & (n != ".")
    return F.struct(
        F.when(dotted, F.regexp_extract(n, r"^(.*)\.([^.]*)$", 1)).otherwise(n).alias("name"),
        F.when(dotted, F.regexp_extract(n, r"^(.*)\.([^.]*)$", 2)).alias("section"),
    )


def section_of(source: Column | str) -> Column:
    return F.regexp_extract(basename(source), r"\.([^.]*)\.gz$", 1)


def shown_name(name: Column | str, section: Column | str) -> Column:
    return F.format_string("%s(%s)", col(name), col(section))


def dedup_key(sha: Column | str, source: Column | str) -> Column:
    """Content is the same page only within a folder; null where the hash or the source is unknown."""
    return F.concat(col(sha), F.lit(":"), F.regexp_replace(col(source), r"/[^/]*$", ""))


def artifact_stem(path: Column | str) -> Column:
    return F.replace(F.regexp_replace(col(path), r"\.gz$", ""), F.lit("/"), F.lit("__"))


def label_slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"[^A-Za-z0-9_.-]+", "-"), F.lit("-"))


def version_key(c: Column | str) -> Column:
    """Numbers of the dotted parts, others 0; arrays compare part by part."""
    return F.transform(F.split(col(c), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def rewritten_link(target: Column | str) -> Column:
    """Man sections 1 and 8 of an archive lie in folders 1 and 8; other sections' links are dropped (null)."""
    t = col(target)
    section = F.regexp_extract(t, r"(?:^|/)man([18])/", 1)
    return F.when(section != "", F.regexp_replace(t, r"(^|/)man([18])/", "$1$2/")).when(~t.contains("/"), t)


def longest_template(source: Column | str, templates: dict[str, str]) -> Column:
    """The value of the longest key that the source begins with."""
    out = F.lit(None).cast("string")
    for prefix in sorted(templates, key=len):
        out = F.when(col(source).startswith(prefix), F.lit(templates[prefix])).otherwise(out)
    return out


# Text.

_ROFF = [
    (r"\\f[BIRP]", ""), (r"\\f\(..", ""), (r"\\-", "-"), (r"\\\(en|\\\(em", "-"), (r"\\&", ""), (r"\\e", r"\\"), (r"\\\(aq|\\\(cq", "'"), (r"\\\(lq|\\\(rq", '"'), (r"\\\(bu", ""),
    (r"\\[~0 ]", " "), (r"\\m\[[^\]]*\]", ""), (r"\\s[-+]?\d+", ""), (r"\\[udc:^|]", ""), (r"\\n\(?\w+", ""), (r"  +", " "),
]


def clean_roff(c: Column | str) -> Column:
    """Roff escapes removed or replaced, in this order; blanks collapsed and trimmed."""
    return F.trim(reduce(lambda x, r: F.regexp_replace(x, *r), _ROFF, col(c)))


def is_header(line: Column | str, name: str | None = None) -> Column:
    """Whether a roff line begins a section, or the section of this name."""
    t = F.trim(col(line))
    if name is None:
        return t.startswith(".SH ") | t.startswith(".Sh ")
    return (t.startswith(".SH") | t.startswith(".Sh")) & (F.upper(F.regexp_replace(F.substr(t, F.lit(4)), r'^[\s"]+|[\s"]+$', "")) == name.upper())


def names_nested_command(line: Column | str) -> Column:
    """Whether a synopsis line has `command` as a word of its own: not in angle brackets, not in an option's name."""
    t = clean_roff(line)
    word = r"(?i)\bcommand\b"
    return t.rlike(word) & ~t.rlike(r"(?i)<command>") & F.regexp_replace(t, r"(?i)-\w*command\w*", "").rlike(word)


def strip_trailing_blanks(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[\n ]+$", "")


def plain_entities(c: Column | str) -> Column:
    """No-break spaces become spaces; joiners stay, as they part runs of emphasis."""
    return F.replace(col(c), F.lit("&nbsp;"), F.lit(" "))


def parse_synopsis(c: Column | str) -> Column:
    """Struct of name and text of `path: "name - text."`; null where it doesn't look so."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r'^.*?: "', ""), r'"$', "")
    inner = F.regexp_replace(inner, r"\.+$", "")
    name, text = F.regexp_extract(inner, r"^([^ ]+) - (.*)$", 1), F.regexp_extract(inner, r"^([^ ]+) - (.*)$", 2)
    return F.when(name != "", F.struct(name.alias("name"), text.alias("text")))


def normal_subcommands(subcommands: Column | str, name: Column | str) -> Column:
    """Without the page's name in front, each once, in order."""
    return F.array_distinct(F.transform(col(subcommands), lambda s: F.when(s.startswith(F.concat(col(name), F.lit("-"))), F.substr(s, F.length(col(name)) + 2)).otherwise(s)))


def redirect_target(text: Column | str) -> Column:
    """The target of a page that is nothing but one `.so` line."""
    lines = F.filter(F.split(col(text), "\n"), lambda x: F.trim(x) != "")
    target = F.regexp_extract(F.trim(F.get(lines, F.lit(0))), r"^\.so\s+(\S+)$", 1)
    return F.when((F.size(lines) == 1) & (target != ""), target)


def unescape_copy(c: Column | str) -> Column:
    """Newlines, tabs, backslashes, in this order."""
    return F.replace(F.replace(F.replace(col(c), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\\\"), F.lit("\\"))


def command_tokens(c: Column | str) -> Column:
    chars = "".join("\\" + x if x in "|()$={}`\"'&;<>" else x for x in SEPARATORS)
    return F.filter(F.split(col(c), f"[{chars}]"), lambda x: x != "")


def command_shape(c: Column | str) -> Column:
    """first:args=n:pipes=m"""
    words = F.filter(F.split(F.trim(col(c)), " "), lambda x: x != "")
    return F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(":args="), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(":pipes="), F.size(F.split(col(c), r"\|")) - 1)


def fixed(x: Column, digits: int) -> Column:
    """A number from 0 on with so many digits, rounded as C's printf does: by the double's exact value, ties to even."""
    x, ten = x.cast("double"), float(10**digits)
    high = x * 134217729.0 - (x * 134217729.0 - x)  # its upper 26 bits
    shifted = x * ten
    lost = (high * ten - shifted) + (x - high) * ten  # what that product's rounding took away
    whole = F.floor(shifted)
    half = (shifted - whole - 0.5) + lost
    k = whole + F.when((half > 0) | (half == 0) & (whole % 2 == 1), 1).otherwise(0)
    return F.format_string(f"%d.%0{digits}d", F.floor(k / 10**digits), k % 10**digits) if digits else k.cast("string")


def short_tokens(n: Column | str) -> Column:
    """950, 878K, 1.8M"""
    n = col(n)
    return F.when(n >= 1_000_000, F.concat(fixed(n / 1_000_000, 1), F.lit("M"))).when(n >= 1000, F.concat(fixed(n / 1000, 0), F.lit("K"))).otherwise(n.cast("string"))


def elapsed(seconds: Column | str) -> Column:
    """2m03s, 59s"""
    s = F.floor(col(seconds)).cast("int")
    return F.when(s >= 60, F.format_string("%dm%02ds", (s / 60).cast("int"), s % 60)).otherwise(F.format_string("%ds", s))


def parse_mode(c: Column | str) -> Column:
    """Struct of mode and model of `llm:model`, or a mode alone."""
    return F.struct(F.split_part(col(c), F.lit(":"), F.lit(1)).alias("mode"), F.when(col(c).contains(":"), F.regexp_replace(col(c), r"^[^:]*:", "")).alias("model"))


def html_escape(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def guard_angles(c: Column | str) -> Column:
    """Bare <word> shown as text, before Markdown is rendered."""
    return F.regexp_replace(col(c), "<([^>]+)>", "&lt;$1&gt;")


# Dates, numbers, hashes, network, JSON.


def lenient_date(c: Column | str) -> Column:
    return F.coalesce(F.try_to_date(col(c), "yyyy-MM-dd"), F.lit("0001-01-01").cast("date"))


def released_epoch(c: Column | str) -> Column:
    """Seconds in UTC, whatever the session's time zone; 0 where there is no date."""
    return F.coalesce(F.date_diff(F.try_to_date(col(c), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400, F.lit(0))


def guarded_ratio(common: Column, a: Column, b: Column) -> Column:
    return common / F.greatest(a, b, F.lit(1))


def relative_change(after: Column, before: Column) -> Column:
    return F.abs(after - before) / F.greatest(F.abs(before), F.lit(1))


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(col(c))), lambda i: F.conv(F.substring(F.hex(F.encode(col(c), "UTF-8")), 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
    octets = F.when(F.octet_length(col(c)) > 0, octets).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(octets, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")))


def slash24(ip: Column | str) -> Column:
    return F.when(col(ip).rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.concat(F.array_join(F.slice(F.split(col(ip), r"\."), 1, 3), "."), F.lit(".0")))


def url_param(uri: Column | str, name: str) -> Column:
    """Decoded value of a query parameter, empty where it is missing."""
    return F.coalesce(F.try_url_decode(F.try_parse_url(col(uri), F.lit("QUERY"), F.lit(name))), F.lit(""))


def json_string(c: Column | str, path: str) -> Column:
    """Missing paths give an empty string."""
    return F.coalesce(F.get_json_object(col(c), path), F.lit(""))


def json_int(c: Column | str, path: str) -> Column:
    return F.coalesce(F.get_json_object(col(c), path).try_cast("bigint"), F.lit(0))


def repaired_json(c: Column | str) -> Column:
    """A model's reply as JSON text: fences off, outermost braces, bad escapes doubled; null where it still doesn't parse."""
    body = F.regexp_replace(F.trim(col(c)), r"^```(?:json)?\s*|\s*```$", "")
    body = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    fixed = F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', r"\\\\")
    return F.coalesce(F.to_json(F.try_parse_json(body)), F.to_json(F.try_parse_json(fixed)))


def first_nonempty(*columns: Column | str) -> Column:
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in columns))
