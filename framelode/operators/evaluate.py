"""Quality of predicted masks against references, over the union of their keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.functions import geometry, raster


def box_areas(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """(frame, idx, ra, pa, i): areas of boxes and of their intersection; a missing side has area 0."""
    r = ref.select("frame", "idx", *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    p = pred.select("frame", "idx", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    area = lambda k: F.coalesce((F.col(f"{k}_x2") - F.col(f"{k}_x1")) * (F.col(f"{k}_y2") - F.col(f"{k}_y1")), F.lit(0.0))
    both = F.when(F.col("r_x1").isNull() | F.col("p_x1").isNull(), 0.0).otherwise(geometry.box_overlap("r_", "p_"))
    return r.join(p, ["frame", "idx"], "full").select("frame", "idx", area("r").alias("ra"), area("p").alias("pa"), both.alias("i"))


def mask_areas(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """(frame, track, ra, pa, i) in exact pixels of ``polygons``, rings painted as a union.

    Pairs of masks that are rectangles, empty or missing are counted in the JVM; only others are painted, in Python.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.select("frame", "track", F.coalesce("polygons", F.array().cast("array<array<array<double>>>")).alias("polygons"))
        box = geometry.pixel_box(F.col("polygons"), inline=True)
        # what is painted travels as polygons, all else as its box
        return df.select("frame", "track", F.struct(box.alias("box"), F.when(box.isNull(), F.col("polygons")).alias("polygons")).alias(name))

    j = side(ref, "a").join(side(pred, "b"), ["frame", "track"], "full")
    painted = F.col("a.polygons").isNotNull() | F.col("b.polygons").isNotNull()

    def run(batches):
        for t in batches:
            out = []
            for a, b in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                m, n = raster.crop_mask(a or [], union=True), raster.crop_mask(b or [], union=True)
                out.append((m.pixels, n.pixels, raster.common_pixels(m, n)))
            cols = [pa.array([float(o[k]) for o in out]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), *cols], names=["frame", "track", "ra", "pa", "i"])

    def rings(name: str) -> F.Column:
        x0, y0, x1, y1 = (F.col(f"{name}.box.{k}") for k in ("x0", "y0", "x1", "y1"))
        box = F.array(F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]))
        return F.coalesce(f"{name}.polygons", F.when(x0 <= x1, box))

    kinds = dict(j.dtypes)
    hard = j.where(painted).select("frame", "track", rings("a").alias("a"), rings("b").alias("b"))
    hard = hard.mapInArrow(run, f"frame {kinds['frame']}, track {kinds['track']}, ra double, pa double, i double")
    a, b = F.col("a.box"), F.col("b.box")
    count = lambda c: F.coalesce(c, F.lit(0.0))
    easy = j.where(~painted).select("frame", "track", count(F.when(a.isNotNull(), geometry.box_pixels(a))).alias("ra"), count(F.when(b.isNotNull(), geometry.box_pixels(b))).alias("pa"), count(F.when(a.isNotNull() & b.isNotNull(), geometry.common_box_pixels(a, b))).alias("i"))
    return easy.unionByName(hard)


def metrics(areas: DataFrame) -> DataFrame:
    """Micro ratios of summed areas (1 where nothing is there), macro IoU, and 2 * missed + 1 * false area."""
    ratio = lambda a, b: F.when(F.expr(b) == 0, 1.0).otherwise(F.expr(f"{a} / ({b})"))
    return areas.agg(
        ratio("sum(i)", "sum(ra) + sum(pa) - sum(i)").alias("micro_iou"), ratio("sum(i)", "sum(pa)").alias("micro_precision"), ratio("sum(i)", "sum(ra)").alias("micro_recall"),
        F.expr("avg(CASE WHEN ra + pa - i = 0 THEN 1.0D ELSE i / (ra + pa - i) END)").alias("macro_iou"), F.expr("sum(2 * (ra - i) + (pa - i))").alias("weighted_error"),
    )
