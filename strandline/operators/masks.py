"""Masks as tables of set cells: regions across tiles, holes, and what of a mask is kept.

A mask of any size is cut into tiles. Regions are labelled within each tile; labels that touch across a tile's border
are edges of a small table whose components join them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.plans.graphs import components

#: Rows and columns of a tile.
TILE = 64
#: Half of a cell's neighbours, the others see it: those at a side, then those at a corner.
SIDES, CORNERS = [(0, 1), (1, 0)], [(1, -1), (1, 1)]


def in_tile(row: np.ndarray, col: np.ndarray, tile: int, eight: bool) -> np.ndarray:
    """For each cell the place in the arrays of the first cell (by row, then column) of its region within one tile."""
    order = np.lexsort((col, row))
    grid = np.full((tile + 2, tile + 2), -1)
    r, c = row[order] % tile + 1, col[order] % tile + 1
    grid[r, c] = np.arange(len(row))
    label = np.arange(len(row))
    near = [grid[r + dr, c + dc] for dr, dc in SIDES + CORNERS * eight] + [grid[r - dr, c - dc] for dr, dc in SIDES + CORNERS * eight]
    while True:
        new = label.copy()
        for n in near:
            some = n >= 0
            new[some] = np.minimum(new[some], label[n[some]])
        new = new[new]  # also what the one it follows has found
        if (new == label).all():
            break
        label = new
    out = np.empty(len(row), int)
    out[order] = order[label]
    return out


def label_cells(cells: DataFrame, tile: int = TILE, eight: bool = True) -> DataFrame:
    """mask, row, col, region for each different cell; region is (row, col) of the region's first cell.

    Cells touch at their sides, with ``eight`` at their corners too. Rows and columns are numbers from 0. A task holds the
    cells of one tile at a time.
    """
    own = cells.select("mask", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).where("row is not null and col is not null").distinct()
    tiles = own.groupBy("mask", F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    tiles = tiles.agg(F.collect_list("row").alias("rows"), F.collect_list("col").alias("cols"))  # tile * tile at most
    kind = dict(cells.dtypes)["mask"]

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row, col = (b.column(c)[k].values.to_numpy() for c in ("rows", "cols"))
                first = in_tile(row, col, tile, eight)
                mask = pa.repeat(b.column("mask")[k], len(row))
                yield pa.RecordBatch.from_arrays([mask, *map(pa.array, (row, col, row[first], col[first]))], ["mask", "row", "col", "r0", "c0"])

    found = tiles.select("mask", "rows", "cols").mapInArrow(look, f"mask {kind}, row int, col int, r0 int, c0 int")
    found = found.select("mask", "row", "col", F.struct("mask", "r0", "c0").alias("region"))
    edge = (F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)
    border = found.where(edge)
    step = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in SIDES + CORNERS * eight]))
    ahead = border.select("mask", "row", "col", F.col("region").alias("a"), step.alias("d"))
    ahead = ahead.select("mask", "a", (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col"))
    edges = ahead.join(border.select("mask", "row", "col", F.col("region").alias("b")), ["mask", "row", "col"]).where("a <> b").select("a", "b").distinct()
    joined = components(edges).select(F.col("node").alias("region"), "component")
    out = found.join(joined, "region", "left").withColumn("region", F.coalesce("component", "region"))
    return out.select("mask", "row", "col", F.struct(F.col("region.r0").alias("row"), F.col("region.c0").alias("col")).alias("region"))


def fill_holes(cells: DataFrame, sizes: DataFrame, tile: int = TILE) -> DataFrame:
    """mask, row, col: the cells and those that they enclose, within each mask's height and width (``sizes``).

    A cell is enclosed if no path over sides of unset cells leads from it to the mask's edge.
    """
    own = cells.select("mask", "row", "col").distinct()
    frame = sizes.select("mask", "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    frame = frame.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    unset = label_cells(frame.join(own, ["mask", "row", "col"], "left_anti").select("mask", "row", "col"), tile, eight=False)
    at_edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("height") - 1) | (F.col("col") == F.col("width") - 1)
    open_ = unset.join(sizes, "mask").where(at_edge).select("mask", "region").distinct()
    return own.unionByName(unset.join(open_, ["mask", "region"], "left_anti").select("mask", "row", "col"))


def clean(cells: DataFrame, sizes: DataFrame | None = None, least: int = 0, most: int = 0, tile: int = TILE, eight: bool = True) -> DataFrame:
    """mask, row, col: the mask without regions of fewer than ``least`` cells and, where ``most`` is set, with its ``most``
    largest regions only (of equal ones those that begin first). With ``sizes`` holes are filled before."""
    if sizes is not None:
        cells = fill_holes(cells, sizes, tile)
    found = label_cells(cells, tile, eight)
    area = found.groupBy("mask", "region").agg(F.count("*").alias("area")).where(F.col("area") >= least)
    if most:
        area = area.withColumn("place", F.row_number().over(Window.partitionBy("mask").orderBy(F.desc("area"), "region"))).where(F.col("place") <= most)
    return found.join(area.select("mask", "region"), ["mask", "region"], "left_semi").select("mask", "row", "col")


# queries


def mask_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 vectors each are a mask of 64 rows: holes filled, the 20 largest regions of three cells or more kept; tiles of 16."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 64).alias("mask"), (F.col("vec_id") % 64).cast("int").alias("row"), "embedding")
    cells = v.select("mask", "row", F.posexplode("embedding").alias("col", "x")).where(F.col("x") > F.lit(0.12).cast("float"))
    sizes = v.groupBy("mask").agg((F.max("row") + 1).alias("height"), F.max(F.size("embedding")).alias("width"))
    return clean(cells, sizes, 3, 20, 16)


MASK_CLEANUP = """
with recursive f as (select vec_id // 64 as mask, (vec_id % 64)::int as r, generate_subscripts(embedding, 1)::int - 1 as c, unnest(embedding) > 0.12::float as is_set from embeddings),
z as (select mask, max(r) as h, max(c) as w from f group by 1),
o as (select mask, r, c from f join z using (mask) where not is_set and (r in (0, h) or c in (0, w))
  union select f.mask, f.r, f.c from o join f on f.mask = o.mask and not f.is_set and abs(f.r - o.r) + abs(f.c - o.c) = 1),
s as (select f.mask, f.r, f.c, f.r * 64 + f.c as k from f left join o on o.mask = f.mask and o.r = f.r and o.c = f.c where o.mask is null),
n as (select a.mask, a.k as a, b.k as b from s a join s b on a.mask = b.mask and a.k <> b.k and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1),
t as (select mask, k, k as root from s union select t.mask, n.b, t.root from t join n on n.mask = t.mask and n.a = t.k),
l as (select mask, k, min(root) as root from t group by 1, 2),
g as (select mask, root, row_number() over (partition by mask order by count(*) desc, root) as place, count(*) as area from l group by 1, 2)
select s.mask, s.r as row, s.c as col from s join l using (mask, k) join g using (mask, root) where area >= 3 and place <= 20
"""

QUERIES = {"mask_cleanup": (mask_cleanup, MASK_CLEANUP)}
