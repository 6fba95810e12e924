"""Layout of pages from positioned cells: table rows, column edges, islands of rows, columns of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a character and height of a line where a page is only text (points).
CHAR_WIDTH, LINE_HEIGHT = 5.0, 12.0
#: Least distance that begins a new column edge, least cells on an edge, least cells of a table row, least rows of a table, least edges that they share.
EDGE_GAP, EDGE_CELLS, ROW_CELLS, TABLE_ROWS, TABLE_EDGES = 6.0, 2, 3, 2, 3


def cells(pages: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``line_no``, ``cell_no``, ``text``, ``x0``, ``x1``, ``mid_y`` of the cells of each line: what
    two blanks or more set apart, placed by character and line."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.length(F.trim("line")) > 0)
    parts = F.regexp_extract_all("line", F.lit(r"\S+(?: \S+)*"), 0)
    rows = lines.select("doc_id", "page", (F.col("at") + 1).alias("line_no"), "line", F.posexplode(parts).alias("cell_no", "text"))
    # A cell begins after the cells before it, two characters apart.
    w = Window.partitionBy("doc_id", "page", "line_no").orderBy("cell_no").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0))
    return rows.select("doc_id", "page", "line_no", "cell_no", "text", (used * CHAR_WIDTH).alias("x0"), ((used + F.length("text")) * CHAR_WIDTH).alias("x1"), (F.col("line_no") * LINE_HEIGHT).alias("mid_y"))


def table_runs(placed: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``table_no``, ``first_line``, ``last_line``, ``rows``: runs of at least two neighbouring lines
    with at least three cells (islands of line numbers). Whether they share columns is for ``aligned_tables`` to tell."""
    wide = placed.groupBy("doc_id", "page", "line_no").agg(F.count("*").alias("n")).where(F.col("n") >= ROW_CELLS)
    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    runs = wide.withColumn("island", F.col("line_no") - F.row_number().over(w)).groupBy("doc_id", "page", "island")
    runs = runs.agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("rows")).where(F.col("rows") >= TABLE_ROWS)
    order = Window.partitionBy("doc_id", "page").orderBy("first_line")
    return runs.select("doc_id", "page", F.row_number().over(order).alias("table_no"), "first_line", "last_line", "rows")


def wide_rows(placed: DataFrame) -> DataFrame:
    """The cells of rows with at least three, with ``row_cells`` (their number) and ``island`` (equal in neighbouring rows)."""
    wide = placed.withColumn("row_cells", F.count("*").over(Window.partitionBy("doc_id", "page", "line_no"))).where(F.col("row_cells") >= ROW_CELLS)
    return wide.withColumn("island", F.col("line_no") - F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("line_no")))


def set_in_columns(placed: DataFrame) -> DataFrame:
    """The cells of table rows placed anew for texts that keep two blanks of each gap, where the places are lost:
    neighbouring rows with equally many cells are set in columns, each as wide as its longest cell."""
    widest = F.max(F.length("text")).over(Window.partitionBy("doc_id", "page", "island", "row_cells", "cell_no"))
    w = Window.partitionBy("doc_id", "page", "line_no").orderBy("cell_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = wide_rows(placed).withColumn("widest", widest).withColumn("used", F.coalesce(F.sum(F.col("widest") + 2).over(w), F.lit(0)))
    x0 = F.col("used") * CHAR_WIDTH
    return rows.select("doc_id", "page", "line_no", "cell_no", "text", x0.alias("x0"), (x0 + F.length("text") * CHAR_WIDTH).alias("x1"), "mid_y")


def aligned_tables(placed: DataFrame) -> DataFrame:
    """``table_runs`` whose own rows share at least three column edges, so that a stack of sentences with wide gaps is no
    table. Edges are found as in ``column_edges``, but within each run."""
    run = ["doc_id", "page", "island"]
    w = Window.partitionBy(*run).orderBy("x0")
    apart = F.coalesce((F.col("x0") - F.lag("x0").over(w) > EDGE_GAP).cast("int"), F.lit(0))
    grouped = wide_rows(placed).withColumn("apart", apart).withColumn("edge", F.sum("apart").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    edges = grouped.groupBy(*run, "edge").agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    runs = edges.groupBy(*run).agg(F.min("first").alias("first_line"), F.max("last").alias("last_line"), F.count_if(F.col("n") >= EDGE_CELLS).alias("shared"))
    runs = runs.withColumn("rows", (F.col("last_line") - F.col("first_line") + 1).cast("long")).where((F.col("rows") >= TABLE_ROWS) & (F.col("shared") >= TABLE_EDGES))
    order = Window.partitionBy("doc_id", "page").orderBy("first_line")
    return runs.select("doc_id", "page", F.row_number().over(order).alias("table_no"), "first_line", "last_line", "rows")


def column_edges(placed: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``edge_no``, ``x``, ``n``: where cells of table rows begin; starts less than EDGE_GAP apart
    are one edge, at their mean; edges with a single cell go."""
    wide = placed.withColumn("row_cells", F.count("*").over(Window.partitionBy("doc_id", "page", "line_no"))).where(F.col("row_cells") >= ROW_CELLS)
    w = Window.partitionBy("doc_id", "page").orderBy("x0")
    apart = (F.col("x0") - F.lag("x0").over(w) > EDGE_GAP).cast("int")
    grouped = wide.withColumn("apart", F.coalesce(apart, F.lit(0)))
    grouped = grouped.withColumn("edge", F.sum("apart").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    edges = grouped.groupBy("doc_id", "page", "edge").agg(F.round(F.avg("x0"), 6).alias("x"), F.count("*").alias("n")).where(F.col("n") >= EDGE_CELLS)
    return edges.select("doc_id", "page", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("edge")).alias("edge_no"), "x", "n")


def nearest_columns(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``line_no``, ``edge_no``, ``text``: the cells of table rows in the column whose edge is
    nearest (the left one on ties), texts of one column joined by blanks."""
    wide = placed.withColumn("row_cells", F.count("*").over(Window.partitionBy("doc_id", "page", "line_no"))).where(F.col("row_cells") >= ROW_CELLS)
    held = edges.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("edge_no", "x"))).alias("edges"))
    far = F.transform("edges", lambda e: F.struct(F.abs(e["x"] - F.col("x0")).alias("far"), e["edge_no"].alias("edge_no")))
    near = wide.join(held, ["doc_id", "page"]).select("doc_id", "page", "line_no", "cell_no", "text", F.array_min(far)["edge_no"].alias("edge_no"))
    joined = near.groupBy("doc_id", "page", "line_no", "edge_no").agg(F.array_sort(F.collect_list(F.struct("cell_no", "text"))).alias("c"))
    return joined.select("doc_id", "page", "line_no", "edge_no", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("text"))


def two_columns(lines: DataFrame, width: str = "width") -> DataFrame:
    """``doc_id``, ``page``, ``two``: does a page of positioned lines (x0, x1, width) stand in two columns? It does with
    twelve lines or more, none across its middle (40 to 60 percent), and at least five and a quarter on either side."""
    low, high = F.col(width) * 0.4, F.col(width) * 0.6
    sides = lines.groupBy("doc_id", "page").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("x0") < low) & (F.col("x1") > high)).alias("across"),
        F.count_if(F.col("x1") <= high).alias("left"),
        F.count_if(F.col("x0") >= low).alias("right"),
    )
    enough = lambda c: (F.col(c) >= 5) & (F.col(c) >= F.col("n") * 0.25)
    return sides.select("doc_id", "page", ((F.col("n") >= 12) & (F.col("across") == 0) & enough("left") & enough("right")).alias("two"))


def reading_rows(placed: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``doc_id``, ``page``, ``row_no``, ``text``: cells in rows, as read. Cells in order of height join a row while they
    are within the tolerance of its first cell (not of the one before), so this is a fold over a page's cells."""
    held = F.array_sort(F.collect_list(F.struct("mid_y", "x0", "cell_no", "text")))
    pages = placed.groupBy("doc_id", "page").agg(held.alias("cells"))
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("row"), F.array().cast("array<struct<row:int,x0:double,text:string>>").alias("out"))

    def step(a, c):
        new = a["first"].isNull() | (F.abs(c["mid_y"] - a["first"]) > tolerance)
        row = F.when(new, a["row"] + 1).otherwise(a["row"])
        item = F.struct(row.alias("row"), c["x0"].alias("x0"), c["text"].alias("text"))
        return F.struct(F.when(new, c["mid_y"]).otherwise(a["first"]).alias("first"), row.alias("row"), F.array_append(a["out"], item).alias("out"))

    flat = pages.select("doc_id", "page", F.explode(F.aggregate("cells", start, step, lambda a: a["out"])).alias("c"))
    rows = flat.groupBy("doc_id", "page", F.col("c.row").alias("row_no")).agg(F.array_sort(F.collect_list(F.struct("c.x0", "c.text"))).alias("t"))
    return rows.select("doc_id", "page", "row_no", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


#: Points that an item may begin before its column's edge.
EDGE_SLACK = 2.0


def column_of(starts, x):
    """The column (from 0) of an item at ``x``: the last whose start (sorted array) is not beyond it; 0 with one column."""
    return F.when(F.size(starts) < 2, 0).otherwise(F.greatest(F.lit(0), F.size(F.filter(starts, lambda s: s <= x + EDGE_SLACK)) - 1)).cast("int")


def reading_order(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``line_no``, ``cell_no``, ``column``, ``place``: a page's cells column by column, from top to
    bottom, ties as they came. A page's cells are few, so its order is one small window."""
    starts = edges.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("x")).alias("starts"))
    column = column_of(F.coalesce("starts", F.array().cast("array<double>")), F.col("x0"))
    held = placed.join(starts, ["doc_id", "page"], "left").withColumn("column", column)
    w = Window.partitionBy("doc_id", "page").orderBy("column", "mid_y", "cell_no")
    return held.select("doc_id", "page", "line_no", "cell_no", "column", F.row_number().over(w).alias("place"))
