"""How well point sets and frames lie on one another: weighted similarities, named anchors, edges, consensus of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.metrics import frames
from strandline.plans.ordered import previous
from strandline.session import TRACKS, table, tracks


def similarity(df: DataFrame, key: str, p: tuple[str, str], q: tuple[str, str], weight: str | None = None, least_spread: float = 1.0, least_width: float = 0.02) -> DataFrame:
    """key, n, ok, scale, degrees, tx, ty, residual: q = scale * R p + t with the least weighted squared error.

    In closed form from sums, so a key's pairs are added up in every task. Pairs with a null don't count, negative weights
    are 0. ok is false, and the rest null, for fewer than two pairs or no weight, where the p span less than
    ``least_spread`` on either axis and across, or three and more lie so near a line that their deviation across it is
    below ``least_width`` of that along it.
    """
    px, py, qx, qy = (F.col(c).cast("double") for c in (*p, *q))
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    own = df.select(F.col(key).alias("key"), px.alias("px"), py.alias("py"), qx.alias("qx"), qy.alias("qy"), w.alias("w")).na.drop(subset=["px", "py", "qx", "qy"])
    total = lambda e: F.sum(F.col("w") * e)
    c = F.col
    g = own.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("w").alias("W"), *[total(c(x)).alias(f"s_{x}") for x in ("px", "py", "qx", "qy")],
        total(c("px") * c("qx") + c("py") * c("qy")).alias("dot"), total(c("px") * c("qy") - c("py") * c("qx")).alias("cross"),
        total(c("px") * c("px") + c("py") * c("py")).alias("pp"), total(c("qx") * c("qx") + c("qy") * c("qy")).alias("qq"),
        F.hypot(F.max("px") - F.min("px"), F.max("py") - F.min("py")).alias("spread"), F.var_pop("px").alias("vx"), F.var_pop("py").alias("vy"), F.covar_pop("px", "py").alias("vxy"),
    )
    over = F.try_divide
    mean = {x: over(c(f"s_{x}"), c("W")) for x in ("px", "py", "qx", "qy")}
    a = over(c("dot"), c("W")) - mean["px"] * mean["qx"] - mean["py"] * mean["qy"]
    b = over(c("cross"), c("W")) - mean["px"] * mean["qy"] + mean["py"] * mean["qx"]
    s = over(c("pp"), c("W")) - mean["px"] * mean["px"] - mean["py"] * mean["py"]
    t = over(c("qq"), c("W")) - mean["qx"] * mean["qx"] - mean["qy"] * mean["qy"]
    half, root = (c("vx") + c("vy")) / 2, F.sqrt(F.pow((c("vx") - c("vy")) / 2, 2) + c("vxy") * c("vxy"))
    wide = F.sqrt(F.greatest(half - root, F.lit(0.0))) >= least_width * F.sqrt(half + root)
    g = g.withColumns({"a": a, "b": b, "s": s, "t": t})
    ok = (c("n") >= 2) & (c("W") > 1e-9) & (c("s") >= 1e-9) & (c("spread") >= least_spread) & ((c("n") < 3) | wide) & (over(F.hypot("a", "b"), c("s")) >= 1e-6)
    g = g.withColumn("ok", F.coalesce(ok, F.lit(False)))
    scale = F.when(c("ok"), over(F.hypot("a", "b"), c("s")))
    u, v = F.when(c("ok"), over(c("a"), c("s"))), F.when(c("ok"), over(c("b"), c("s")))
    left = F.sqrt(F.greatest(F.lit(0.0), c("t") - over(c("a") * c("a") + c("b") * c("b"), c("s"))))
    return g.select(
        F.col("key").alias(key), "n", "ok", scale.alias("scale"), F.when(c("ok"), F.degrees(F.atan2("b", "a"))).alias("degrees"),
        (mean["qx"] - u * mean["px"] + v * mean["py"]).alias("tx"), (mean["qy"] - v * mean["px"] - u * mean["py"]).alias("ty"), F.when(c("ok"), left).alias("residual"),
    )


def anchors(a: DataFrame, b: DataFrame, on: list[str], name: str, value: str) -> DataFrame:
    """on, name_a, name_b, distance, state: ``matched``, ``renamed`` where the places agree and the names differ (null is a
    name of its own), ``only_a`` or ``only_b``."""
    a = a.select(*on, F.col(name).alias("name_a"), F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = b.select(*on, F.col(name).alias("name_b"), F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, on, "full")
    state = F.when(F.col("_in_b").isNull(), "only_a").when(F.col("_in_a").isNull(), "only_b").when(F.col("name_a").eqNullSafe(F.col("name_b")), "matched").otherwise("renamed")
    return j.select(*on, "name_a", "name_b", F.abs(F.col("_a") - F.col("_b")).alias("distance"), state.alias("state"))


def sobel(px: Column, side: int) -> Column:
    """Gradient magnitude of a square frame given row by row; the rows beside the border stand for those beyond it."""
    mirror = lambda k: F.when(k < 0, 1).when(k >= side, side - 2).otherwise(k)
    i = F.sequence(F.lit(0), F.lit(side * side - 1))

    def at(k: Column, dr: int, dc: int) -> Column:
        return F.get(px, (mirror(F.floor(k / side) + dr) * side + mirror(k % side + dc)).cast("int"))

    gx = lambda k: at(k, -1, 1) + 2 * at(k, 0, 1) + at(k, 1, 1) - at(k, -1, -1) - 2 * at(k, 0, -1) - at(k, 1, -1)
    gy = lambda k: at(k, 1, -1) + 2 * at(k, 1, 0) + at(k, 1, 1) - at(k, -1, -1) - 2 * at(k, -1, 0) - at(k, -1, 1)
    return F.transform(i, lambda k: F.sqrt(F.pow(gx(k), 2) + F.pow(gy(k), 2)))


def edges(px: Column, side: int, threshold: float = 0.10) -> Column:
    """Which places are edges: gradient above a share of the frame's largest; a flat frame has none."""
    return F.transform(F.array(sobel(px, side)), lambda g: F.transform(g, lambda x: (x > threshold * F.array_max(g)) & (x > 0)))[0]


def edge_iou(a: Column, b: Column) -> Column:
    """Common edges over all edges; 0 where neither frame has one."""
    n = lambda z: F.size(F.filter(z, lambda x: x))
    both, either = n(F.zip_with(a, b, lambda x, y: x & y)), n(F.zip_with(a, b, lambda x, y: x | y))
    return F.when(either > 0, both / either).otherwise(0.0)


def mask_consensus(df: DataFrame, group: str, order: str, px: str, level: float = 0.5, gate: float = 0.5, mode: str = "median") -> DataFrame:
    """group, order, overlap, anomalous, stable: each mask against what the one before and the one behind agree on.

    The neighbours' consensus is their mean (the median of two). A mask that is empty while they are not, or whose IoU
    with their consensus at ``level`` is below ``gate``, is replaced by it; any other becomes the median (or with mode
    ``mean`` the mean) of the three. A mask with one neighbour only is compared with that one; one without stays.
    """
    f = previous(df.select(group, order, F.col(px).alias("px")), group, order, ["px"]).withColumn("a", F.col("_before.px")).drop("_before")
    f = f.withColumn("_o", -F.col(order))
    f = previous(f, group, "_o", ["px"]).withColumn("b", F.col("_before.px")).drop("_before", "_o")
    near = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.zip_with("a", "b", lambda x, y: (x + y) / 2))
    f = f.withColumn("near", near)
    n = lambda z: F.size(F.filter(z, lambda x: x))
    both, either = (n(F.zip_with("px", "near", h)) for h in (lambda x, y: (x > level) & (y > level), lambda x, y: (x > level) | (y > level)))
    f = f.withColumn("overlap", F.when(F.col("near").isNotNull(), F.when(either > 0, both / either).otherwise(1.0)))
    f = f.withColumn("anomalous", F.coalesce(F.col("overlap") < gate, F.lit(False)))
    three = F.transform(F.arrays_zip("a", "px", "b"), lambda z: (z["a"] + z["px"] + z["b"] - F.greatest(z["a"], z["px"], z["b"]) - F.least(z["a"], z["px"], z["b"])) if mode == "median" else (z["a"] + z["px"] + z["b"]) / 3)
    two = F.zip_with("px", "near", lambda x, y: (x + y) / 2)
    stable = F.when(F.col("near").isNull(), F.col("px")).when(F.col("anomalous"), F.col("near")).when(F.col("a").isNull() | F.col("b").isNull(), two).otherwise(three)
    return f.select(group, order, "overlap", "anomalous", stable.alias("stable"))


# queries


def weighted_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's (frame, value) turned, scaled and moved by its number, with an error at every seventh frame of little weight."""
    t = tracks(spark, sf_dir).where("v is not null")
    angle, k = F.radians((F.col("track") % 90).cast("double")), 1 + F.col("track") % 3
    x, y = F.col("frame") * 3.0, F.col("v") / 10
    off = F.when(F.col("frame") % 7 == 0, 5.0).otherwise(0.0)
    t = t.select("track", x.alias("px"), y.alias("py"), (k * (F.cos(angle) * x - F.sin(angle) * y) + 11 + off).alias("qx"), (k * (F.sin(angle) * x + F.cos(angle) * y) - 7).alias("qy"), F.when(F.col("frame") % 7 == 0, 0.1).otherwise(1.0).alias("w"))
    g = similarity(t, "track", ("px", "py"), ("qx", "qy"), "w")
    return g.select("track", "n", "ok", F.round("scale", 4).alias("scale"), F.round("degrees", 3).alias("degrees"), F.round("tx", 2).alias("tx"), F.round("ty", 2).alias("ty"), F.round("residual", 3).alias("residual"))


WEIGHTED_SIMILARITY = f"""
with {TRACKS}, p as (select track, frame * 3.0::double as px, v / 10 as py, radians((track % 90)::double) as a, 1 + track % 3 as k, case when frame % 7 = 0 then 5.0 else 0.0 end::double as off, case when frame % 7 = 0 then 0.1 else 1.0 end::double as w from t where v is not null),
q as (select track, px, py, w, k * (cos(a) * px - sin(a) * py) + 11 + off as qx, k * (sin(a) * px + cos(a) * py) - 7 as qy from p),
m as (select track, sum(w) as tw, sum(w * px) / sum(w) as mx, sum(w * py) / sum(w) as my, sum(w * qx) / sum(w) as nx, sum(w * qy) / sum(w) as ny, count(*) as n, var_pop(px) as vx, var_pop(py) as vy, covar_pop(px, py) as vxy,
  sqrt(power(max(px) - min(px), 2) + power(max(py) - min(py), 2)) as spread from q group by 1),
g as (select track, any_value(n) as n, any_value(m) as m, sum(w * ((px - mx) * (qx - nx) + (py - my) * (qy - ny))) as a, sum(w * ((px - mx) * (qy - ny) - (py - my) * (qx - nx))) as b, sum(w * ((px - mx) * (px - mx) + (py - my) * (py - my))) as s,
  sum(w * ((qx - nx) * (qx - nx) + (qy - ny) * (qy - ny))) as t, any_value(tw) as tw, any_value(mx) as mx, any_value(my) as my, any_value(nx) as nx, any_value(ny) as ny,
  any_value(n >= 2 and spread >= 1 and (n < 3 or sqrt(greatest((vx + vy) / 2 - sqrt(power((vx - vy) / 2, 2) + vxy * vxy), 0)) >= 0.02 * sqrt((vx + vy) / 2 + sqrt(power((vx - vy) / 2, 2) + vxy * vxy)))) as ok from q join m using (track) group by 1)
select track, n, ok, case when ok then round(sqrt(a * a + b * b) / s, 4) end as scale, case when ok then round(degrees(atan2(b, a)), 3) end as degrees, case when ok then round(nx - a / s * mx + b / s * my, 2) end as tx,
  case when ok then round(ny - b / s * mx - a / s * my, 2) end as ty, case when ok then round(sqrt(greatest(0, t - (a * a + b * b) / s) / tw), 3) end as residual from g
"""


def anchor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by key, named by the last digit of their phone."""
    a, b = (table(spark, sf_dir, t).select(F.col(f"{c}_{k}key").alias("place"), F.substring(f"{c}_name", -1, 1).alias("name"), F.col(f"{c}_acctbal").alias("x")) for t, c, k in (("customer", "c", "cust"), ("supplier", "s", "supp")))
    b = b.withColumn("name", F.when(F.col("place") % 4 == 0, None).otherwise(F.col("name")))
    g = anchors(a, b, ["place"], "name", "x").groupBy("state")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("distance"), 3).alias("mean"), F.round(F.max("distance"), 2).alias("worst"))


ANCHOR_NAMES = """
with a as (select c_custkey as place, right(c_name, 1) as name, c_acctbal as x from customer),
b as (select s_suppkey as place, case when s_suppkey % 4 <> 0 then right(s_name, 1) end as name, s_acctbal as y from supplier),
j as (select a.place as pa, b.place as pb, a.name as na, b.name as nb, abs(x - y) as d from a full join b on a.place = b.place)
select case when pb is null then 'only_a' when pa is null then 'only_b' when na is not distinct from nb then 'matched' else 'renamed' end as state, count(*) as n, round(avg(d), 3) as mean, round(max(d), 2) as worst from j group by 1
"""


def edge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of consecutive frames of 8 x 8 of a label, flat ones (every seventh) among them."""
    f = frames(spark, sf_dir).withColumn("px", F.when(F.col("vec_id") % 7 < 2, F.transform("px", lambda _: F.lit(0.5))).otherwise(F.col("px")))
    f = f.withColumn("e", edges(F.col("px"), 8, 0.5))
    f = previous(f, "label", "vec_id", ["e"]).where("_before is not null")
    return f.select("label", "vec_id", F.round(edge_iou(F.col("_before.e"), F.col("e")), 5).alias("edge_iou"))


EDGE_OVERLAP = """
with f as (select label, vec_id, generate_subscripts(embedding, 1) - 1 as k, case when vec_id % 7 < 2 then 0.5 else (unnest(embedding)::double + 1) / 2 end as x from embeddings),
o as (select * from (values (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) t(dr, dc, gx, gy)),
n as (select label, vec_id, k, gx, gy, case when k // 8 + dr < 0 then 1 when k // 8 + dr > 7 then 6 else k // 8 + dr end * 8 + case when k % 8 + dc < 0 then 1 when k % 8 + dc > 7 then 6 else k % 8 + dc end as j from f, o),
g as (select n.vec_id, n.label, n.k, sqrt(power(sum(gx * f.x), 2) + power(sum(gy * f.x), 2)) as m from n join f on f.vec_id = n.vec_id and f.k = n.j group by all),
e as (select *, m > 0.5 * max(m) over (partition by vec_id) and m > 0 as edge from g),
p as (select distinct label, vec_id, lag(vec_id) over (partition by label order by vec_id) as prev from embeddings)
select p.label, p.vec_id, round(case when count_if(a.edge or b.edge) > 0 then count_if(a.edge and b.edge) / count_if(a.edge or b.edge) else 0.0 end, 5) as edge_iou
from p join e a on a.vec_id = p.vec_id join e b on b.vec_id = p.prev and b.k = a.k where p.prev is not null group by 1, 2
"""


def consensus_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mask_consensus(frames(spark, sf_dir), "label", "vec_id", "px", 0.53, 0.2)
    total = F.aggregate("stable", F.lit(0.0), lambda a, x: a + x)
    return g.select("label", "vec_id", F.round("overlap", 5).alias("overlap"), "anomalous", F.round(total, 4).alias("total"))


CONSENSUS_MASKS = """
with f as (select label, vec_id, list_transform(embedding, lambda x: (x::double + 1) / 2) as px from embeddings),
w as (select *, lag(px) over w as a, lead(px) over w as b from f window w as (partition by label order by vec_id)),
n as (select *, case when a is null then b when b is null then a else list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2) end as near from w),
o as (select *, case when near is not null then case when len(list_filter(list_zip(px, near), lambda z: z[1] > 0.53 or z[2] > 0.53)) > 0
  then len(list_filter(list_zip(px, near), lambda z: z[1] > 0.53 and z[2] > 0.53)) / len(list_filter(list_zip(px, near), lambda z: z[1] > 0.53 or z[2] > 0.53)) else 1.0 end end as overlap from n)
select label, vec_id, round(overlap, 5) as overlap, coalesce(overlap < 0.2, false) as anomalous, round(list_sum(case when near is null then px when overlap < 0.2 then near when a is null or b is null then list_transform(list_zip(px, near), lambda z: (z[1] + z[2]) / 2)
  else list_transform(list_zip(a, px, b), lambda z: z[1] + z[2] + z[3] - greatest(z[1], z[2], z[3]) - least(z[1], z[2], z[3])) end), 4) as total from o
"""

QUERIES = {
    "weighted_similarity": (weighted_similarity, WEIGHTED_SIMILARITY),
    "anchor_names": (anchor_names, ANCHOR_NAMES),
    "edge_overlap": (edge_overlap, EDGE_OVERLAP),
    "consensus_masks": (consensus_masks, CONSENSUS_MASKS),
}
