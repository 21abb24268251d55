"""Column functions on text, URLs and JSON, and the queries that apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import table


def split_last_marker(text: Column, marker: str = "the ", head: int = 800, tail: int = 500) -> tuple[Column, Column]:
    """Text before and after the last marker (any case), trimmed and cut; without a marker all of it is the head."""
    low = F.lower(text)
    at = F.length(text) - F.instr(F.reverse(low), marker[::-1]) - len(marker) + 2
    found = F.instr(low, marker) > 0
    first = F.when(found, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    second = F.when(found, F.substr(text, at + len(marker))).otherwise(F.lit(""))

    def cut(x: Column, n: int) -> Column:
        return F.rtrim(F.substring(F.trim(x), 1, n))

    return cut(first, head), cut(second, tail)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Puts values for {names}, drops names without one and collapses double spaces."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\{[a-z_]+\}", ""), " {2,}", " "))


def safe_name(value: Column) -> Column:
    """For file names: whole numbers without a fraction, points and others to dashes."""
    text = F.regexp_replace(value.cast("string"), r"\.0+$", "")
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def safe_stem(text: Column, limit: int = 120) -> Column:
    """Drops characters that file systems refuse, collapses white space, drops points and spaces at the end."""
    clean = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]', ""), r"[ \t\n\r]+", " ")
    return F.regexp_replace(F.substring(F.trim(clean), 1, limit), r"[. ]+$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clock(seconds: Column) -> Column:
    """M:SS or H:MM:SS; ??:?? for null."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.concat(two(m), F.lit(":"), two(r))
    return F.when(seconds.isNull(), "??:??").when(h > 0, F.concat(h.cast("string"), F.lit(":"), short)).otherwise(short)


def video_id(url: Column) -> Column:
    """Eleven-character id of the five URL shapes of a video site; empty where there is none."""
    return F.regexp_extract(url, r"(?i:^https?://(?:www\.|m\.)?(?:youtu\.be/|youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/|live/)))([A-Za-z0-9_-]{11})", 1)


def token_budget(minutes: Column, floor: int = 8192) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(65_536), F.floor((1024 + minutes * 280) * 1.25).cast("bigint")))


def health(text: Column, parsed: Column, wanted: Column, cut: Column) -> Column:
    """length_truncated before parse_error before schema_invalid before ok."""
    return F.when(cut, "length_truncated").when(parsed.isNull(), "parse_error").when(~wanted, "schema_invalid").otherwise("ok")


# queries


def prompt_split_last_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, tail = split_last_marker(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", head.alias("head"), tail.alias("tail"))


PROMPT_SPLIT = """
with m as (select item_id, text, lower(text) low, position('the ' in lower(text)) > 0 as found, length(text) - position(' eht' in reverse(lower(text))) - 4 + 2 as pos from benchmark)
select item_id, rtrim(substring(trim(case when found then substring(text, 1, pos - 1) else text end, ' '), 1, 800), ' ') as head,
  rtrim(substring(trim(case when found then substring(text, pos + 4) else '' end, ' '), 1, 500), ' ') as tail from m
"""


def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    filled = fill_template("[{role}]  turn {turn}: {first} {missing} end", {"role": F.col("role"), "turn": F.col("turn").cast("string"), "first": F.substring_index("text", " ", 1)})
    return c.select("conv_id", "turn", filled.alias("filled"))


TEMPLATE_FILL = """
select conv_id, turn, trim(regexp_replace(regexp_replace(replace(replace(replace('[{role}]  turn {turn}: {first} {missing} end', '{role}', role), '{turn}', turn::varchar), '{first}', split_part(text, ' ', 1)), '\\{[a-z_]+\\}', '', 'g'), ' {2,}', ' ', 'g'), ' ') as filled from conversations
"""


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of "name: text" or "name | text" (the colon wins); others are dropped."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws("\n", F.concat("p_brand", F.lit(": "), "p_type"), F.concat("p_name", F.lit(" | x")), F.lit("malformed")), "\n").alias("lines"))
    lines = parts.select("p_partkey", F.posexplode("lines").alias("line", "text"))
    colon = F.regexp_extract("text", r"^([^:]+):\s*(.+)$", 1)
    bar = F.regexp_extract("text", r"^([^|]+)\|\s*(.+)$", 1)
    name = F.trim(F.when(colon != "", colon).otherwise(bar))
    said = F.trim(F.when(colon != "", F.regexp_extract("text", r"^([^:]+):\s*(.+)$", 2)).otherwise(F.regexp_extract("text", r"^([^|]+)\|\s*(.+)$", 2)))
    return lines.select("p_partkey", "line", name.alias("name"), said.alias("said")).where("name <> '' and said <> ''")


TOKEN_TABLE = r"""
with l as (select p_partkey, unnest([p_brand || ': ' || p_type, p_name || ' | x', 'malformed']) as text, unnest([0, 1, 2]) as line from part),
m as (select *, regexp_extract(text, '^([^:]+):\s*(.+)$', 1) c, regexp_extract(text, '^([^|]+)\|\s*(.+)$', 1) b from l),
n as (select p_partkey, line, trim(case when c <> '' then c else b end) as name, trim(case when c <> '' then regexp_extract(text, '^([^:]+):\s*(.+)$', 2) else regexp_extract(text, '^([^|]+)\|\s*(.+)$', 2) end) as said from m)
select * from n where name <> '' and said <> ''
"""


def names_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", safe_name(F.col("p_retailprice")).alias("price_name"), safe_name(F.concat("p_brand", F.lit(" "), "p_type")).alias("type_name"),
        safe_stem(F.concat("p_name", F.lit('  a/b: "c"?. . '))).alias("stem"), slug(F.col("p_name")).alias("slug"), F.substring(F.sha2("p_name", 256), 1, 12).alias("sha12"),
    )


NAMES_AND_HASHES = r"""
select p_partkey, regexp_replace(regexp_replace(regexp_replace(p_retailprice::varchar, '\.0+$', ''), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as price_name,
  regexp_replace(regexp_replace(p_brand || ' ' || p_type, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as type_name,
  regexp_replace(substring(trim(regexp_replace(regexp_replace(p_name || '  a/b: "c"?. . ', '[<>:"/\\|?*]', '', 'g'), '[ \t\n\r]+', ' ', 'g'), ' '), 1, 120), '[. ]+$', '') as stem,
  regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, substring(sha256(p_name), 1, 12) as sha12 from part
"""


def url_canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one canonical URL (host lowered, no scheme, query, fragment or ending slash): the first one stays."""
    url = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "")
    host = F.lower(F.regexp_extract(url, r"^https?://([^/]+)", 1))
    key = F.concat(host, F.regexp_extract(url, r"^https?://[^/]+(.*)$", 1))
    g = table(spark, sf_dir, "pages").groupBy(key.alias("canonical"))
    return g.agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


URL_DEDUP = r"""
with u as (select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') u from pages)
select lower(regexp_extract(u, '^https?://([^/]+)', 1)) || regexp_extract(u, '^https?://[^/]+(.*)$', 1) as canonical, min(page_id) as page_id, count(*) as copies from u group by 1
"""


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, stem, extension and query parameter of each URL, and a video id made from its page."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    name = F.regexp_extract(path, r"([^/]*)/?$", 1)
    link = F.concat(F.lit("https://YouTu.be/"), F.lpad(F.col("page_id").cast("string"), 11, "A"), F.lit("?si=x"))
    return p.select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_replace(name, r"\.[a-z]+$", "").alias("stem"),
        F.regexp_extract(name, r"\.([a-z]+)$", 1).alias("ext"), F.regexp_extract("url", r"[?&]page=(\d+)", 1).alias("page_arg"), video_id(link).alias("video"),
    )


URL_PARTS = r"""
with p as (select page_id, url, regexp_extract(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '([^/]*)/?$', 1) as name from pages)
select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_replace(name, '\.[a-z]+$', '') as stem, regexp_extract(name, '\.([a-z]+)$', 1) as ext,
  regexp_extract(url, '[?&]page=(\d+)', 1) as page_arg, lpad(page_id::varchar, 11, 'A') as video from p
"""


def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no label yet."""
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(done, "doc_id", "left_anti")


PENDING = "select doc_id, lang, n_chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)"


def cost_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of the pending documents by language; a language without a price has none."""
    prices = spark.createDataFrame([("en", 0.3), ("fr", 0.5), ("de", 0.5)], "lang string, price double")
    g = pending_anti_join(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    j = g.join(prices, "lang", "left")
    minutes = F.col("chars") / 9000
    return j.select("lang", "n", "chars", F.round(F.col("chars") / 4 * F.col("price") / 1e6, 4).alias("cost"), token_budget(minutes).alias("budget"), clock(minutes * 60).alias("time"))


COST_PREVIEW = f"""
with p as ({PENDING}), g as (select lang, count(*) n, sum(n_chars)::bigint chars from p group by 1), r(lang, price) as (values ('en', 0.3::double), ('fr', 0.5), ('de', 0.5)),
s as (select g.*, price, chars / 9000.0::double m, floor(chars / 9000.0::double * 60)::bigint s from g left join r using (lang))
select lang, n, chars, round(chars / 4.0::double * price / 1e6, 4) as cost, greatest(8192, least(65536, floor((1024 + m * 280) * 1.25)::bigint)) as budget,
  case when s >= 3600 then (s // 3600)::varchar || ':' else '' end || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as time from s
"""


def inventory_fallback_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host pages whose URL ends in .html; where a host has none, those with a query; in path order."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    first, second = F.col("url").like("%.html%"), F.col("url").like("%?%")
    w = Window.partitionBy("host")
    p = p.withColumn("found", F.count_if(first).over(w))
    kept = p.where(F.when(F.col("found") > 0, first).otherwise(second))
    return kept.select("host", "page_id", "url", (F.col("found") == 0).alias("fallback"), F.row_number().over(w.orderBy(F.lower("url"), "page_id")).alias("place"))


INVENTORY = r"""
with p as (select page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages), c as (select *, count_if(url like '%.html%') over (partition by host) f from p)
select host, page_id, url, f = 0 as fallback, row_number() over (partition by host order by lower(url), page_id) as place from c where case when f > 0 then url like '%.html%' else url like '%?%' end
"""


def json_props_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


JSON_PROPS_GET = "select event_type, json_extract_string(props, '$.k')::int as k, count(*) n from events group by 1, 2"


def json_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of records of which some are cut, broken or lack the key, by a rule on the event's id."""
    text = F.when(F.pmod("event_id", F.lit(11)) == 0, F.substring("props", 1, 3)).when(F.pmod("event_id", F.lit(7)) == 0, F.lit('{"other": 1}')).otherwise(F.col("props"))
    key = F.get_json_object(text, "$.k")
    parsed = F.get_json_object(text, "$")
    e = table(spark, sf_dir, "events").select("event_id", health(text, parsed, key.isNotNull(), F.pmod("event_id", F.lit(13)) == 0).alias("status"))
    return e.groupBy("status").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


JSON_HEALTH = """
with t as (select event_id, case when event_id % 11 = 0 then substring(props, 1, 3) when event_id % 7 = 0 then '{"other": 1}' else props end as text from events),
s as (select event_id, case when event_id % 13 = 0 then 'length_truncated' when not json_valid(text) then 'parse_error' when json_extract_string(text, '$.k') is null then 'schema_invalid' else 'ok' end as status from t)
select status, count(*) n, min(event_id) as first from s group by 1
"""


def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's map over its user's first one, the earlier keys kept; keys outside the list are reported."""
    e = table(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,string>")
    base = e.groupBy("user_id").agg(F.min_by(m, F.struct("ts", "event_id")).alias("base"))
    own = F.map_concat(F.create_map(F.lit("kind"), F.col("event_type")), m)
    j = e.select("event_id", "user_id", own.alias("own")).join(base, "user_id")
    merged = F.map_concat(F.map_filter("own", lambda k, _: ~F.map_contains_key("base", k)), "base")
    unknown = F.array_except(F.map_keys("own"), F.array(F.lit("k")))
    return j.select("event_id", merged["kind"].alias("kind"), merged["k"].alias("k"), F.array_join(unknown, ",").alias("unknown_keys"))


MANIFEST_MERGE = """
with b as (select user_id, json_extract_string(props, '$.k') k from events qualify row_number() over (partition by user_id order by ts, event_id) = 1)
select event_id, event_type as kind, b.k, 'kind' as unknown_keys from events join b using (user_id)
"""


def log_regex_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read from turns as log lines: words in capitals, stops, and sample deviation of the turn lengths."""
    c = table(spark, sf_dir, "conversations")
    caps = F.regexp_count("text", F.lit(r"\b[A-Z][a-z]+"))
    first = F.regexp_extract("text", r"^([A-Za-z]+)", 1)
    g = c.select("conv_id", "turn", caps.alias("caps"), F.length("text").alias("n"), first.alias("word")).groupBy("conv_id")
    return g.agg(
        F.sum("caps").alias("caps"), F.max_by("word", "turn").alias("last_word"), F.count("*").alias("turns"),
        F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 4).alias("spread"),
    )


LOG_REGEX_STATS = r"""
select conv_id, sum(len(regexp_extract_all(text, '\b[A-Z][a-z]+')))::bigint as caps, max_by(regexp_extract(text, '^([A-Za-z]+)', 1), turn) as last_word, count(*) turns, round(coalesce(stddev_samp(length(text)), 0.0), 4) as spread from conversations group by 1
"""


def conversation_cost_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running tokens and cost of a conversation; a system turn starts the history anew."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("history", F.sum(F.when(F.col("role") == "system", 1).otherwise(0)).over(w)).withColumn("tokens", F.ceil(F.length("text") / 4))
    own = Window.partitionBy("conv_id", "history").orderBy("turn")
    total = F.sum("tokens").over(own)
    return c.select("conv_id", "turn", "history", "tokens", total.alias("total"), F.round(total * 0.000_25, 6).alias("cost"))


CONVERSATION_COST = """
with h as (select conv_id, turn, sum((role = 'system')::int) over (partition by conv_id order by turn)::bigint as history, ceil(length(text) / 4.0)::bigint as tokens from conversations)
select *, (sum(tokens) over (partition by conv_id, history order by turn))::bigint as total, round((sum(tokens) over (partition by conv_id, history order by turn)) * 0.00025::double, 6) as cost from h
"""


def line_list_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, comments and blanks dropped, the first of equal ones kept with its place."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    d = d.withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, '#')")
    g = d.groupBy("line").agg(F.min(F.struct("doc_id", "place")).alias("x"), F.count("*").alias("n"))
    return g.select(F.sha2("line", 256).alias("line_sha"), F.col("x.doc_id").alias("doc_id"), F.col("x.place").alias("place"), "n")


LINE_LIST_DEDUP = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place from documents),
k as (select doc_id, place, trim(line, ' ') as line from l), f as (select * from k where line <> '' and not starts_with(line, '#'))
select sha256(line) as line_sha, min_by(doc_id, (doc_id, place)) as doc_id, min_by(place, (doc_id, place)) as place, count(*) n from f group by line
"""


def sentinel_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local value unless it is the sentinel (-999), else the bus value unless null, else the default."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.pmod("p_partkey", F.lit(3)) == 0, -999).otherwise(F.col("p_size")).alias("local"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.col("p_size") * 10).alias("bus"))
    return p.withColumn("effective", F.coalesce(F.nullif("local", F.lit(-999)), "bus", F.lit(48)))


SENTINEL = """
with p as (select p_partkey, case when p_partkey % 3 = 0 then -999 else p_size end as local, case when p_partkey % 2 = 0 then p_size * 10 end as bus from part)
select *, coalesce(nullif(local, -999), bus, 48) as effective from p
"""


def config_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a rule, with the rules they break; the others pass."""
    p = table(spark, sf_dir, "part")
    rules = F.array_compact(F.array(
        F.when(~F.col("p_size").between(1, 45), "p_size range"), F.when(F.col("p_retailprice") > 1800, "p_retailprice range"),
        F.when(~F.col("p_type").isin("STANDARD", "SMALL", "MEDIUM", "LARGE"), "p_type choice"),
    ))
    return p.select("p_partkey", F.array_join(rules, "; ").alias("errors")).where("errors <> ''")


CONFIG_VALIDATION = """
with p as (select p_partkey, concat_ws('; ', case when p_size not between 1 and 45 then 'p_size range' end, case when p_retailprice > 1800 then 'p_retailprice range' end,
  case when p_type not in ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE') then 'p_type choice' end) as errors from part)
select * from p where errors <> ''
"""

QUERIES = {
    "prompt_split_last_marker": (prompt_split_last_marker, PROMPT_SPLIT),
    "template_fill": (template_fill, TEMPLATE_FILL.replace("\\\\", "\\")),
    "token_table": (token_table, TOKEN_TABLE),
    "names_and_hashes": (names_and_hashes, NAMES_AND_HASHES),
    "url_canonical_dedup": (url_canonical_dedup, URL_DEDUP),
    "url_parts": (url_parts, URL_PARTS),
    "pending_anti_join": (pending_anti_join, PENDING),
    "cost_preview": (cost_preview, COST_PREVIEW),
    "inventory_fallback_pattern": (inventory_fallback_pattern, INVENTORY),
    "json_props_get": (json_props_get, JSON_PROPS_GET),
    "json_health": (json_health, JSON_HEALTH),
    "manifest_merge": (manifest_merge, MANIFEST_MERGE),
    "log_regex_stats": (log_regex_stats, LOG_REGEX_STATS),
    "conversation_cost_running": (conversation_cost_running, CONVERSATION_COST),
    "line_list_dedup": (line_list_dedup, LINE_LIST_DEDUP),
    "sentinel_override": (sentinel_override, SENTINEL),
    "config_validation": (config_validation, CONFIG_VALIDATION),
}
