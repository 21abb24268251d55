"""A run's log as a record: typed fields of its lines, context windows, models, step times and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import table

#: What the lines look like. Of each field the last line counts; ``ints`` is a list of whole numbers.
SHAPE = r"torch\.Size\(\[([^\]]+)\]\)"
FIELDS = {
    "pixel_shape": (r"Input shape: torch\.Size\(\[(\d+, \d+, \d+, \d+)\]\)", "ints"),
    "latent_input": (r"Input shape: torch\.Size\(\[(\d+, \d+, \d+, \d+, \d+)\]\)", "ints"),
    "latent_shape": (r"Output latent shape: torch\.Size\(\[(\d+, \d+, \d+, \d+, \d+)\]\)", "ints"),
    "control_shape": (rf"control_video_latent shape: {SHAPE}", "ints"),
    "mask_shape": (rf"vace_mask shape: {SHAPE}", "ints"),
    "sliced_frames": (rf"Sliced vace_frames:.*?-> {SHAPE}", "ints"),
    "sliced_mask": (rf"Sliced vace_mask:.*?-> {SHAPE}", "ints"),
    "sliced_context": (rf"Sliced vace_context:.*?-> {SHAPE}", "ints"),
    "original_frames": (rf"Cached original vace_frames: shape {SHAPE}", "ints"),
    "original_mask": (rf"Cached original vace_mask: shape {SHAPE}", "ints"),
    "x_in_shape": (rf"x_in shape: {SHAPE}", "ints"),
    "encode_input": (rf"VAEEncode\] Input shape: {SHAPE}", "ints"),
    "encode_output": (rf"VAEEncode\].*Output latent shape: {SHAPE}", "ints"),
    "encode_gb": (r"VAEEncode\] Memory: ([\d.]+) GB pixels", "double"),
    "encode_mb": (r"VAEEncode\] Memory: [\d.]+ GB pixels -> ([\d.]+) MB latents", "double"),
    "decode_input": (rf"VAEDecode\] Input shape: {SHAPE}", "ints"),
    "decode_output": (rf"VAEDecode\].*Output shape: {SHAPE}", "ints"),
    "decode_frames": (r"VAEDecode\] Starting decode of (\d+) latent frames", "int"),
    "n_models": (r"Sequential mode: (\d+) models", "int"),
    "step_distribution": (r"Step distribution: \[([^\]]+)\]", "ints"),
    "shift": (r"ShiftApplier\] \w+ shift=([\d.]+)", "double"),
    "chunk": (r"Loaded chunk (\d+):", "int"),
    "chunk_start": (r"Loaded chunk \d+:\s*Frames: (\d+) to", "int"),
    "chunk_end": (r"Loaded chunk \d+:\s*Frames: \d+ to (\d+)", "int"),
    "chunk_frames": (r"Loaded chunk \d+:\s*Frames: \d+ to \d+ \((\d+) frames\)", "int"),
    "lowvram_patches": (r"lowvram patches:\s*(\d+)", "int"),
    "sampler": (r"(?i)sampler[=:\s]+['\"]?(\w+)['\"]?", "string"),
    "cfg": (r"cfg[=:\s]+(\d+\.?\d*)", "double"),
    "total_steps": (r"\d+/(\d+)\s*\[", "int"),
    "its_per_s": (r"(\d+\.?\d*)it/s", "double"),
    "executed": (r"Prompt executed in (\d+:\d+:\d+)", "string"),
    "attention": (r"(?i)(sage|flash|pytorch|sdpa)[\s_-]?attention", "lower"),
    "error_in": (r'File "[^"]+\\[^"]+", line \d+, in (\w+)', "string"),
}
STEP, MODEL, LOADED = r"(\d+\.?\d*)s/it", r"Requested to load (\w+)", r"loaded completely.*?(\d+\.?\d*) MB loaded"
DTYPE = r"(?i)dtype[=:\s]*(bf16|fp16|fp32|float16|float32|bfloat16)"
DTYPES = {"float16": "fp16", "float32": "fp32", "bfloat16": "bf16"}
NO_MEMORY = r"OutOfMemoryError|Allocation on device"
WINDOW_FULL, WINDOW = r"context windows?\s*(\d+)\s*with overlap\s*(\d+)\s*for\s*(\d+)\s*frames", r"Using context windows?\s*(\d+)\s*(?:for|with)?\s*(\d+)\s*frames?"
OVERLAP, STRIDE = r"overlap[=:\s]+(\d+)", r"stride[=:\s]+(\d+)"


def field(line: Column, pattern: str, kind: str = "string", group: int = 1) -> Column:
    """What a line says, typed; null where it says nothing."""
    found = F.regexp_extract(line, pattern, group)
    found = F.when(found != "", found)
    if kind == "ints":
        return F.transform(F.split(found, ","), lambda x: F.trim(x).cast("int"))
    return F.lower(found) if kind == "lower" else found.cast(kind)


def last_fields(df: DataFrame, run: str, order: Column, line: Column) -> DataFrame:
    """run, every field of ``FIELDS`` by its last line, seconds, and step times (n, mean, least, most, sample deviation, 0 for one),
    errors, no_memory, conditions (different control shapes). One pass with partial aggregation."""
    own = df.select(F.col(run), order.alias("_o"), line.alias("_l"), *([F.col("level")] if "level" in df.columns else [F.lit("").alias("level")]))
    own = own.select("*", field(F.col("_l"), STEP, "double").alias("_t"), *[field(F.col("_l"), p, k).alias(name) for name, (p, k) in FIELDS.items()])
    own = own.withColumn("_m", F.col("_l").rlike(NO_MEMORY))
    last = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_o"))).alias(name) for name in FIELDS]
    g = own.groupBy(run).agg(
        *last, F.count("_t").alias("steps"), F.avg("_t").alias("step_mean"), F.min("_t").alias("step_least"), F.max("_t").alias("step_most"),
        F.when(F.count("_t") > 0, F.coalesce(F.stddev_samp("_t"), F.lit(0.0))).alias("step_dev"), F.count_if((F.col("level") == "ERROR") | F.col("_m")).alias("errors"),
        F.bool_or("_m").alias("no_memory"), F.count_distinct("control_shape").alias("conditions"),
    )
    clock = F.split("executed", ":").cast("array<int>")
    return g.withColumn("seconds", F.when(F.col("executed").isNotNull(), clock[0] * 3600 + clock[1] * 60 + clock[2])).drop("executed")


def context_windows(df: DataFrame, run: str, order: Column, line: Column) -> DataFrame:
    """run, window, overlap, frames, stride, windows: of the last full line, else of the first short one.

    An overlap said later fills one that is missing and sets the stride; a stride said later replaces it. Without either
    the stride is half the window. windows covers the frames, the last one as far as it must.
    """
    own = df.select(F.col(run), order.alias("o"), line.alias("l"))
    ints = lambda p, n: F.array(*[field(F.col("l"), p, "int", k) for k in range(1, n + 1)])
    own = own.select(run, "o", ints(WINDOW_FULL, 3).alias("full"), ints(WINDOW, 2).alias("short"), field(F.col("l"), OVERLAP, "int").alias("overlap"), field(F.col("l"), STRIDE, "int").alias("stride"))
    said = lambda c: F.when(F.col(c)[0].isNotNull(), F.col("o"))
    base = own.groupBy(run).agg(F.max_by("full", said("full")).alias("f"), F.max(said("full")).alias("fo"), F.min_by("short", said("short")).alias("s"), F.min(said("short")).alias("so"))
    base = base.where("fo is not null or so is not null").withColumn("at", F.coalesce("fo", "so")).withColumnRenamed(run, "_run")
    later = own.join(base.select("_run", "at", "fo"), F.col(run) == F.col("_run")).where(F.col("o") >= F.col("at"))
    fills = F.when(F.col("fo").isNull() & F.col("overlap").isNotNull(), F.col("o"))
    set_ = F.when(F.col("stride").isNotNull(), F.col("o"))
    later = later.groupBy("_run").agg(F.min_by("overlap", fills).alias("lap"), F.min(fills).alias("lap_at"), F.max_by("stride", set_).alias("step"), F.max(set_).alias("step_at"))
    g = base.join(later, "_run")
    window, frames = F.coalesce(F.col("f")[0], F.col("s")[0]), F.coalesce(F.col("f")[2], F.col("s")[1])
    overlap = F.coalesce(F.col("f")[1], F.col("lap"))
    by_step = F.col("step_at").isNotNull() & (F.col("lap_at").isNull() | (F.col("step_at") >= F.col("lap_at")))
    stride = F.when(by_step, F.col("step")).otherwise(window - overlap)
    g = g.select(F.col("_run").alias(run), window.alias("window"), overlap.alias("overlap"), frames.alias("frames"), stride.alias("stride"))
    by = F.coalesce("stride", F.floor(F.col("window") / 2).cast("int"))
    return g.withColumn("windows", F.when((by > 0) & (F.col("frames") > F.col("window")), F.ceil((F.col("frames") - F.col("window")) / F.nullif(by, F.lit(0))) + 1).otherwise(1).cast("int"))


def models(df: DataFrame, run: str, order: Column, line: Column) -> DataFrame:
    """run, place (from 1), name, mb, dtype of each model in the order of loading.

    A model is named by a request and has the size that the next line with one says; asked for again it counts once. A
    data type belongs to the model loaded last, its last one counts.
    """
    w = Window.partitionBy(run).orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    dtype = field(F.col("l"), DTYPE, "lower")
    own = df.select(F.col(run), order.alias("o"), line.alias("l"))
    own = own.select(run, "o", field(F.col("l"), MODEL).alias("name"), field(F.col("l"), LOADED, "double").alias("mb"), F.coalesce(F.create_map(*[F.lit(x) for kv in DTYPES.items() for x in kv])[dtype], dtype).alias("dtype"))
    own = own.where("name is not null or mb is not null or dtype is not null").withColumn("asked", F.count("name").over(w)).withColumn("name", F.last("name", True).over(w))
    sized = F.row_number().over(Window.partitionBy(run, "asked").orderBy(F.col("mb").isNull(), "o"))
    own = own.withColumn("new", F.col("mb").isNotNull() & F.col("name").isNotNull() & (sized == 1))
    first = F.row_number().over(Window.partitionBy(run, "name").orderBy(~F.col("new"), "o"))
    own = own.withColumn("new", F.col("new") & (first == 1)).withColumn("place", F.count_if("new").over(w))
    g = own.where("place > 0").groupBy(run, "place").agg(
        F.max(F.when(F.col("new"), F.col("name"))).alias("name"), F.max(F.when(F.col("new"), F.col("mb"))).alias("mb"), F.max_by("dtype", F.when(F.col("dtype").isNotNull(), F.col("o"))).alias("dtype"),
    )
    return g.withColumn("place", F.col("place").cast("int"))


# queries

#: Forms of lines for events; {k} is the event's property, {v} its value, {i} its number.
LINES = [
    "[VAEEncode] Input shape: torch.Size([{k}, 480, 832, 3])", "[VAEEncode] done. Output latent shape: torch.Size([1, 16, {k}, 60, 104])", "[VAEEncode] Memory: {v} GB pixels -> {k} MB latents",
    "control_video_latent shape: torch.Size([1, 16, {k}])", "Sliced vace_frames: a -> b -> torch.Size([1, {k}])", "[VAEDecode] Starting decode of {k} latent frames", "Sequential mode: {k} models",
    "Step distribution: [{k}, 4, {i}]", "[X_ShiftApplier] auto shift={v}", "Loaded chunk {k}: Frames: {i} to 99 (16 frames)", "lowvram patches: {k}", "Sampler: 'dpm_{k}' cfg={v}",
    "{k}/500 [00:01<00:09, {v}s/it]", "Prompt executed in 0:{k}:07", "using Flash-Attention", "OutOfMemoryError at step {k}", 'File "c:\\x\\y{k}.py", line 3, in f{k}', "Requested to load M{m}",
    "loaded completely {i} {v} MB loaded", "weight dtype: bfloat16", "dtype=fp{p}", "Using context windows {k} with overlap 4 for {i} frames", "Using context window 16 for {k} frames", "overlap={p}", "stride: {q}", "nothing {k}",
]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    text = F.element_at(F.array(*[F.lit(x) for x in LINES]), (F.pmod(i * 7 + F.floor(i / len(LINES)), F.lit(len(LINES))) + 1).cast("int"))
    fill = {"{k}": F.get_json_object("props", "$.k"), "{v}": F.format_string("%.2f", "value"), "{i}": i.cast("string"), "{m}": F.pmod(i, F.lit(5)).cast("string"), "{p}": F.when(i % 2 == 0, "16").otherwise("32"), "{q}": (1 + i % 9).cast("string")}
    for name, x in fill.items():
        text = F.replace(text, F.lit(name), x)
    return e.select("user_id", F.struct("ts", "event_id").alias("at"), text.alias("line"))


_SQL_LINES = f"""
e as (select user_id, (ts, event_id) as o, replace(replace(replace(replace(replace(replace([{', '.join("'" + x.replace("'", "''") + "'" for x in LINES)}][((event_id * 7 + event_id // {len(LINES)}) % {len(LINES)}) + 1],
  '{{k}}', json_extract_string(props, '$.k')), '{{v}}', printf('%.2f', value)), '{{i}}', event_id::varchar), '{{m}}', (event_id % 5)::varchar), '{{p}}', case when event_id % 2 = 0 then '16' else '32' end),
  '{{q}}', (1 + event_id % 9)::varchar) as l from events)
"""


def log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each user's log; lists as text."""
    g = last_fields(_lines(spark, sf_dir), "user_id", F.col("at"), F.col("line"))
    kinds = dict(g.dtypes)
    flat = [F.array_join(c, ",").alias(c) if kinds[c] == "array<int>" else F.round(c, 4).alias(c) if c in ("step_mean", "step_dev") else F.col(c) for c in g.columns]
    return g.select(*flat)


_KINDS = {"int": "::int", "double": "::double", "string": "", "lower": ""}


def _sql_field(name: str, pattern: str, kind: str) -> str:
    flags = ", 'i'" if pattern.startswith("(?i)") else ""
    text = f"nullif(regexp_extract(l, '{pattern.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}', 1{flags}), '')"
    text = {"lower": f"lower({text})", "ints": f"replace({text}, ' ', '')"}.get(kind, text)
    return f"arg_max({text}, o) filter (where {text} is not null){_KINDS.get(kind, '')} as {name}"


LOG_REPORT = f"""
with {_SQL_LINES}, s as (select *, nullif(regexp_extract(l, '{STEP}', 1), '')::double as t, regexp_matches(l, '{NO_MEMORY}') as oom from e),
g as (select user_id, {', '.join(_sql_field(name, p, k) for name, (p, k) in FIELDS.items())}, count(t) as steps, round(avg(t), 4) as step_mean, min(t) as step_least, max(t) as step_most,
  round(case when count(t) > 0 then coalesce(stddev_samp(t), 0.0) end, 4) as step_dev, count_if(oom) as errors, bool_or(oom) as no_memory,
  count(distinct nullif(regexp_extract(l, '{FIELDS['control_shape'][0]}', 1), '')) as conditions from s group by 1)
select * exclude (executed), list_sum(list_transform(string_split(executed, ':'), lambda x, i: x::int * [3600, 60, 1][i]))::int as seconds from g
"""


def log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_windows(_lines(spark, sf_dir), "user_id", F.col("at"), F.col("line"))


LOG_WINDOWS = f"""
with {_SQL_LINES}, x as (select user_id, o, try_cast(regexp_extract(l, '{WINDOW_FULL}', 1) as int) as f1, try_cast(regexp_extract(l, '{WINDOW_FULL}', 2) as int) as f2, try_cast(regexp_extract(l, '{WINDOW_FULL}', 3) as int) as f3,
  try_cast(regexp_extract(l, '{WINDOW}', 1) as int) as s1, try_cast(regexp_extract(l, '{WINDOW}', 2) as int) as s2, try_cast(regexp_extract(l, '{OVERLAP}', 1) as int) as lap, try_cast(regexp_extract(l, '{STRIDE}', 1) as int) as step from e),
b as (select user_id, max(o) filter (where f1 is not null) as fo, arg_max([f1, f2, f3], o) filter (where f1 is not null) as f, min(o) filter (where s1 is not null) as so, arg_min([s1, s2], o) filter (where s1 is not null) as s from x group by 1),
y as (select b.user_id, any_value(f) as f, any_value(s) as s, arg_min(lap, o) filter (where fo is null and lap is not null) as lap, min(o) filter (where fo is null and lap is not null) as lap_at,
  arg_max(step, o) filter (where step is not null) as step, max(o) filter (where step is not null) as step_at from b join x on x.user_id = b.user_id and x.o >= coalesce(fo, so) group by 1),
z as (select user_id, coalesce(f[1], s[1]) as "window", coalesce(f[2], lap) as overlap, coalesce(f[3], s[2]) as frames, case when step_at is not null and (lap_at is null or step_at >= lap_at) then step else coalesce(f[1], s[1]) - coalesce(f[2], lap) end as stride from y)
select *, case when coalesce(stride, "window" // 2) > 0 and frames > "window" then ceil((frames - "window") / coalesce(stride, "window" // 2)) + 1 else 1 end::int as windows from z
"""


def log_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(_lines(spark, sf_dir), "user_id", F.col("at"), F.col("line"))


LOG_MODELS = f"""
with {_SQL_LINES}, x as (select user_id, o, nullif(regexp_extract(l, '{MODEL}', 1), '') as name, try_cast(regexp_extract(l, '{LOADED}', 1) as double) as mb, nullif(lower(regexp_extract(l, '{DTYPE.removeprefix('(?i)')}', 1, 'i')), '') as dtype from e),
y as (select user_id, o, mb, dtype, last_value(name ignore nulls) over w as name, count(name) over w as asked from x window w as (partition by user_id order by o rows unbounded preceding)),
s as (select user_id, name, mb, o from (select *, row_number() over (partition by user_id, asked order by o) as k from y where mb is not null and name is not null) where k = 1),
m as (select user_id, name, mb, o, row_number() over (partition by user_id order by o)::int as place from (select *, row_number() over (partition by user_id, name order by o) as k from s) where k = 1),
d as (select y.user_id, y.o, y.dtype, max(m.place) as place from y join m on m.user_id = y.user_id and m.o <= y.o where y.dtype is not null group by all),
f as (select user_id, place, arg_max(case dtype when 'float16' then 'fp16' when 'float32' then 'fp32' when 'bfloat16' then 'bf16' else dtype end, o) as dtype from d group by all)
select m.user_id, m.place, m.name, m.mb, f.dtype from m left join f using (user_id, place)
"""

QUERIES = {"log_report": (log_report, LOG_REPORT), "log_windows": (log_windows, LOG_WINDOWS), "log_models": (log_models, LOG_MODELS)}
