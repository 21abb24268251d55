"""JSON documents as columns: merging and setting at depth, whole files; globs and file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import table

#: Objects below this depth are replaced whole.
DEPTH = 8
_MAP = "map<string,variant>"


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def deep_merge(base: Column, over: Column, depth: int = DEPTH) -> Column:
    """JSON text of ``base`` with what ``over`` has: objects are merged key by key, any other value is replaced.

    Both are JSON texts of objects. A JSON null of ``over`` replaces too; keys of one side only stay. Where one text is
    null or no object the other stands; both null give null. Types are kept by VARIANT values, numbers as they are.
    """
    a, b = (F.from_json(F.when(_is_object(F.try_parse_json(x)), x), _MAP) for x in (base, over))

    def both(_: Column, x: Column, y: Column) -> Column:
        nested = F.parse_json(deep_merge(F.to_json(x), F.to_json(y), depth - 1)) if depth > 1 else y
        return F.when(_is_object(x) & _is_object(y), nested).otherwise(F.coalesce(y, x))

    return F.coalesce(F.to_json(F.map_zip_with(a, b, both)), F.to_json(b), F.to_json(a))


def set_at(document: Column, section: str, key: str, value: Column) -> Column:
    """The JSON text with ``value`` (a string, number or boolean column) at section.key; the section is made where it lacks."""
    return deep_merge(document, F.to_json(F.create_map(F.lit(section), F.create_map(F.lit(key), value))))


def get_at(document: Column, section: str, key: str, kind: str, default: Column | None = None) -> Column:
    """The value at section.key as ``kind``; ``default`` where it is missing, null or of another kind."""
    found = F.try_variant_get(F.try_parse_json(document), f"$.{section}.{key}", kind)
    return found if default is None else F.coalesce(found, default)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and document of each file: a whole JSON text, on any number of lines, or null where it is none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.to_json(F.try_parse_json(F.btrim("value", F.lit(" \t\r\n")))).alias("document"))


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: ``*`` and ``?`` stay within a folder, ``**`` crosses folders, ``[a-z]`` and
    ``[!a-z]`` are classes; everything else stands for itself."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and (end := glob.find("]", i + 2 + glob.startswith("!", i + 1))) > 0:
            own = glob[i + 1 : end]
            no = own.startswith("!")
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", own[no:])
            out, i = out + (f"[^/{body}]" if no else f"[{body}]"), end + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.isalnum() or c in "/_" else "\\" + c)
            i += 1
    return f"(?s)^{out}$"


def matches(path: Column, include: list[str], exclude: list[str] | None = None, depth: int | None = None, ignore_case: bool = False) -> Column:
    """Whether a path fits one of the globs and none of those excluded, in at most ``depth`` folders below the root.

    One expression that the scan evaluates row by row; null paths give null.
    """
    flag = "(?i)" if ignore_case else ""
    any_of = lambda globs: path.rlike(flag + "|".join(f"(?:{glob_pattern(g)})" for g in globs)) if globs else F.lit(False)
    ok = any_of(include) & ~any_of(exclude or [])
    return ok if depth is None else ok & (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) <= depth)


def path_parts(path: Column) -> Column:
    """folder, name, stem, extension (lower case, without the dot) and depth of a file path; either slash parts it."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    extension = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    stem = F.when(extension == "", name).otherwise(name.substr(F.lit(1), F.length(name) - F.length(extension) - 1))
    folder = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.struct(folder.alias("folder"), name.alias("name"), stem.alias("stem"), F.lower(extension).alias("extension"), F.size(F.filter(F.split(folder, "/"), lambda x: x != "")).alias("depth"))


# queries


def json_deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties under its user's, three levels deep; one value is then set and read back."""
    e = table(spark, sf_dir, "events")
    low = F.to_json(F.struct(F.lit(1).alias("version"), F.struct(F.col("user_id").alias("user"), F.struct(F.lit("old").alias("kind"), F.lit(True).alias("seen")).alias("last")).alias("run")))
    top = F.to_json(F.struct(F.struct(F.struct(F.col("event_type").alias("kind")).alias("last"), F.from_json("props", "k int").alias("props")).alias("run"), F.when(F.col("event_id") % 3 == 0, F.lit("x")).alias("note")))
    e = e.select("event_id", deep_merge(low, top).alias("d"))
    e = e.withColumn("d", set_at(F.col("d"), "stats", "double", F.col("event_id") * 2))
    get = lambda p: F.get_json_object("d", p)
    return e.select(
        "event_id", get("$.run.user").cast("long").alias("user"), get("$.run.last.kind").alias("kind"), get("$.run.last.seen").alias("seen"), get("$.run.props.k").cast("int").alias("k"),
        get("$.note").alias("note"), get_at(F.col("d"), "stats", "double", "long").alias("double"), F.array_join(F.array_sort(F.json_object_keys("d")), ",").alias("keys"),
    )


JSON_DEEP_MERGE = """
with d as (select event_id, json_merge_patch(json_object('version', 1, 'run', json_object('user', user_id, 'last', json_object('kind', 'old', 'seen', true))),
  json_merge_patch(json_object('run', json_object('last', json_object('kind', event_type), 'props', props::json)), case when event_id % 3 = 0 then json_object('note', 'x') else '{}'::json end),
  json_object('stats', json_object('double', event_id * 2))) as d from events)
select event_id, (d->>'$.run.user')::bigint as user, d->>'$.run.last.kind' as kind, d->>'$.run.last.seen' as seen, (d->>'$.run.props.k')::int as k, d->>'$.note' as note,
  (d->>'$.stats.double')::bigint as double, array_to_string(list_sort(json_keys(d)), ',') as keys from d
"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in two languages but not those on a blog or below 100, at most four folders deep, with the parts of their paths."""
    path = F.regexp_replace("url", "^https?://|[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p = p.where(matches(F.col("path"), ["**/en/*", "*.example.[!x]*/fr/**"], ["blog.**", "**/[0-9]", "**/[0-9][0-9]"], 4))
    return p.select("page_id", path_parts(F.col("path")).alias("x")).select("page_id", "x.*")


PAGE_PATHS = r"""
with p as (select page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') as path from pages),
q as (select page_id, path, regexp_extract(path, '([^/]*)$', 1) as name, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder from p
  where (regexp_matches(path, '^(.*/)?en/[^/]*$') or regexp_matches(path, '^[^/]*\.example\.[^x/][^/]*/fr/.*$'))
    and not regexp_matches(path, '^blog\.|^(.*/)?[0-9]$|^(.*/)?[0-9][0-9]$') and len(path) - len(replace(path, '/', '')) <= 4)
select page_id, folder, name, case when regexp_matches(name, '^.+\.[^.]+$') then regexp_replace(name, '\.[^.]+$', '') else name end as stem,
  lower(regexp_extract(name, '^.+\.([^.]+)$', 1)) as extension, len(list_filter(string_split(folder, '/'), lambda x: x <> ''))::int as depth from q
"""

QUERIES = {"json_deep_merge": (json_deep_merge, JSON_DEEP_MERGE), "page_paths": (page_paths, PAGE_PATHS)}
