"""Queries on objects of masks: connected components, edge errors, failures of small objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import objects as O
from evalframe.queries.fixtures import query

#: A tile's side here, so that the objects of the 128 x 128 masks reach over tiles.
SIDE = 48
#: Labels go round to the least cell of each object; the steps are equi-joins with shifted cells.
OBJECTS = """cells AS (SELECT image_id, row_px * 1000 + col_px AS cell, true_class, pred_class FROM mask),
 pairs AS (SELECT m.image_id, m.cell AS a, n.cell AS b, m.true_class = n.true_class AS same FROM (SELECT *, unnest([-1001, -1000, -999, -1, 1, 999, 1000, 1001]) AS d FROM cells) m JOIN cells n ON n.image_id = m.image_id AND n.cell = m.cell + m.d),
 links AS (SELECT image_id, a, b FROM pairs WHERE same),
 cc(image_id, cell, low) USING KEY (image_id, cell) AS (SELECT image_id, cell, cell FROM cells
   UNION SELECT l.image_id, l.a, min(c.low) FROM cc c JOIN links l ON l.image_id = c.image_id AND l.b = c.cell JOIN recurring.cc r ON r.image_id = l.image_id AND r.cell = l.a WHERE c.low < r.low GROUP BY l.image_id, l.a),
 edge AS (SELECT image_id, a AS cell FROM pairs WHERE NOT same GROUP BY ALL),
 objects AS (SELECT c.image_id, r.low // 1000 AS object_row, r.low % 1000 AS object_col, c.true_class AS class_index, count(*) AS pixels, count(CASE WHEN true_class <> pred_class THEN 1 END) AS wrong_pixels,
   count(e.cell) AS edge_pixels, count(CASE WHEN true_class <> pred_class THEN e.cell END) AS edge_errors, min(c.cell // 1000) AS first_row, max(c.cell // 1000) AS last_row, min(c.cell % 1000) AS first_col, max(c.cell % 1000) AS last_col
   FROM cells c JOIN cc r ON r.image_id = c.image_id AND r.cell = c.cell LEFT JOIN edge e ON e.image_id = c.image_id AND e.cell = c.cell GROUP BY ALL)"""


def objects(t):
    wrong = t.mask.withColumn("wrong", F.col("true_class") != F.col("pred_class"))
    labelled = O.label_objects(t.mask.withColumnRenamed("true_class", "class_index"), tile=SIDE)
    return O.object_table(labelled, wrong)


@query("g41_mask_objects", f"WITH RECURSIVE {OBJECTS} SELECT * FROM objects")
def _(t):
    return objects(t)


SPATIAL = f"""sums AS (SELECT image_id, CAST(sum(wrong_pixels) AS BIGINT) AS errors, CAST(sum(edge_errors) AS BIGINT) AS edge_errors, count(CASE WHEN small THEN 1 END) AS small_objects,
 count(CASE WHEN small AND wrong_pixels >= 0.5 * pixels THEN 1 END) AS small_failures FROM (SELECT *, class_index <> 0 AND pixels <= {O.SMALL_PIXELS} AS small FROM objects) GROUP BY ALL)"""


@query("p32_spatial_failures", f"""WITH RECURSIVE {OBJECTS}, {SPATIAL}
 SELECT *, concat_ws(',', CASE WHEN edge_errors > 0 THEN 'edge_error' END, CASE WHEN small_failures > 0 THEN 'small_object_failure' END) AS categories FROM sums""")
def _(t):
    return O.spatial_failures(objects(t)).withColumn("categories", F.array_join("categories", ","))
