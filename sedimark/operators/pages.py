"""From the placed words of a page to its lines in reading order, over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.storage import shared_folder, stored
from sedimark.operators.layout import block_type

# The bounds by which columns are told from tables.
PROSE_CHARS = 20
PROSE_SHARE_OF_WIDTH = 0.12
LEAST_SEGMENTS = 3
SPANNING_PENALTY = 3
WIDE_TABLE_ROW = 0.6
WIDE_PROSE = 0.8
COLUMN_MAJORITY = 0.8
NUMERIC_SIGNS = r"[^\d%.,()\-–]"


def _numeric(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\s+", "")
    return (F.length(bare) > 0) & (F.length(F.regexp_replace(bare, NUMERIC_SIGNS, "")) >= F.length(bare) * 0.5)


def _numbered_lines(words: DataFrame, key: list[str]) -> DataFrame:
    """words with line_no and word_no: downwards by their centres, a word near the mean centre of the line above it belongs to that line."""
    word = F.struct((F.col("y") + F.col("height") / 2).alias("c"), "x", "y", "width", "height", "text")
    whole = words.groupBy(*key).agg(F.array_sort(F.collect_list(word)).alias("w"), F.median(F.when(F.col("height") > 0, F.col("height"))).alias("_m"))
    typical = F.greatest(F.lit(4.0), F.coalesce("_m", F.lit(0.0)))
    near = F.greatest(F.lit(1.75), F.col("typical") * 0.45)
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("n"), F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        same = (s["n"] > 0) & (F.abs(s["total"] / s["n"] - w["c"]) <= near)
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        return F.struct(line.alias("line"), F.when(same, s["n"] + 1).otherwise(1.0).alias("n"), F.when(same, s["total"] + w["c"]).otherwise(w["c"]).alias("total"), F.array_append(s["out"], line).alias("out"))

    lined = whole.withColumn("typical", typical).withColumn("lines", F.aggregate("w", start, step)["out"])
    rows = lined.select(*key, "typical", F.posexplode(F.arrays_zip("w", "lines")).alias("word_no", "z"))
    return rows.select(*key, "typical", "word_no", F.col("z.lines").alias("line_no"), *[F.col(f"z.w.{c}").alias(c) for c in ("x", "y", "width", "height", "text")])


def _joined(words: DataFrame, group: list[str], *carried: str) -> DataFrame:
    """Text and box of each group's words from left to right; a gap between words gives a space."""
    across = Window.partitionBy(*group).orderBy("x", "word_no")
    before = F.max(F.col("x") + F.col("width")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lag("height").over(across)
    space = F.when(last.isNotNull() & (F.col("x") - F.greatest(F.lit(0.0), before) > F.greatest(F.lit(1.5), F.least(last, F.col("height")) * 0.16)), " ").otherwise("")
    pieces = words.withColumn("_piece", F.struct("x", "word_no", F.concat(space, F.col("text")).alias("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["t"]), "")
    right, bottom = F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom")
    place = F.struct("x", "word_no")
    ends = (F.min_by("height", place).alias("first_height"), F.max_by("height", place).alias("last_height"))
    return pieces.groupBy(*group).agg(text.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), right, bottom, *ends, *[F.max(c).alias(c) for c in carried])


def _merged(segments: DataFrame, group: list[str], *carried: str) -> DataFrame:
    """Text and box of each group's segments in their order: what _joined makes of their words, as a segment's words lie right of all before it."""
    across = Window.partitionBy(*group).orderBy("segment")
    before = F.max("right").over(across.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lag("last_height").over(across)
    space = F.when(last.isNotNull() & (F.col("x") - F.greatest(F.lit(0.0), before) > F.greatest(F.lit(1.5), F.least(last, F.col("first_height")) * 0.16)), " ").otherwise("")
    pieces = segments.withColumn("_piece", F.struct("segment", F.concat(space, F.col("text")).alias("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["t"]), "")
    return pieces.groupBy(*group).agg(text.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), *[F.max(c).alias(c) for c in carried])


def _search_region(segments: DataFrame, key: list[str]) -> DataFrame:
    """key, top and bottom of each page's tallest stretch without lines of the page's width; columns are looked for there."""
    cell = _numeric(F.col("text")) | (F.length("text") < PROSE_CHARS)
    of_cells = lambda f, c: f(F.when(cell, F.col(c)))
    wide = F.struct(F.col("y").alias("top"), "bottom")
    lines = segments.groupBy(*key, "line_no").agg(
        F.count_if(cell).alias("cells"), F.count_if(_numeric(F.col("text"))).alias("numbers"), F.max("page_width").alias("page_width"),
        of_cells(F.min, "x").alias("x"), of_cells(F.max, "right").alias("right"), of_cells(F.min, "y").alias("y"), of_cells(F.max, "bottom").alias("bottom"),
        F.collect_list(F.when(F.col("right") - F.col("x") >= F.col("page_width") * WIDE_PROSE, wide)).alias("prose"),
    )
    is_row = (F.col("cells") >= 3) & (F.col("numbers") >= F.col("cells") * 0.6)
    row = F.when(F.col("right") - F.col("x") >= F.col("page_width") * WIDE_TABLE_ROW, F.array(wide)).otherwise(F.array().cast("array<struct<top:double,bottom:double>>"))
    ranges = lines.select(*key, F.inline(F.when(is_row, row).otherwise(F.col("prose"))))
    down = Window.partitionBy(*key).orderBy("top", "bottom").rowsBetween(Window.unboundedPreceding, -1)
    gaps = ranges.withColumn("_from", F.greatest(F.lit(0.0), F.coalesce(F.max("bottom").over(down), F.lit(0.0))))
    size = F.col("top") - F.col("_from")
    found = gaps.groupBy(*key).agg(F.max(F.when(size > 0, F.struct(size.alias("size"), (-F.col("_from")).alias("up")))).alias("best"), F.greatest(F.lit(0.0), F.max("bottom")).alias("end"))
    pages = segments.groupBy(*key).agg(F.max("page_height").alias("page_height"))
    rest = F.col("page_height") - F.col("end")
    tallest = F.when(F.col("best.size") >= rest, F.struct((-F.col("best.up")).alias("top"), (F.col("best.size") - F.col("best.up")).alias("bottom"))).otherwise(F.struct(F.coalesce("end", F.lit(0.0)).alias("top"), F.col("page_height").alias("bottom")))
    return pages.join(found, key, "left").select(*key, tallest["top"].alias("top"), tallest["bottom"].alias("bottom"))


def _gutters(segments: DataFrame, key: list[str]) -> DataFrame:
    """key, gutter_from and gutter_to of the pages with two columns.

    Each side of a gutter has some prose; it scores by the smaller side's segments, less a
    penalty for each segment across it where both sides stand beside each other. Scores
    change only at the borders of segments, so these alone are looked at.
    """
    prose = ~_numeric(F.col("text")) & ((F.length("text") >= PROSE_CHARS) | (F.col("right") - F.col("x") >= F.col("page_width") * PROSE_SHARE_OF_WIDTH))
    center = (F.col("y") + F.col("bottom")) / 2
    inside = center.between(F.col("top"), F.col("end")) & (F.col("y") > F.col("page_height") * 0.04) & (F.col("y") < F.col("page_height") * 0.94)
    area = segments.filter(inside).withColumn("prose", prose)
    tall = area.groupBy(*key).agg(F.count_if("prose").alias("n"), F.greatest(F.lit(1.0), F.median(F.when(F.col("prose"), F.col("bottom") - F.col("y")))).alias("tall"), F.max("page_width").alias("w"))
    tall = tall.filter(F.col("n") >= 2 * LEAST_SEGMENTS).select(*key, "tall", F.floor(F.col("w") * 0.2).alias("first"), F.ceil(F.col("w") * 0.8).alias("last"))
    marks = area.select(*key, F.explode(F.array(F.ceil("right"), F.floor("x") + 1)).alias("at")).join(tall, key)
    marks = marks.select(*key, "tall", "last", F.greatest(F.col("first"), F.least(F.col("at"), F.col("last"))).alias("at")).unionByName(tall.select(*key, "tall", "last", F.col("first").alias("at"))).distinct()
    met = marks.join(area.select(*key, "x", "y", "right", "bottom", "prose"), key)
    left, right = F.col("prose") & (F.col("right") <= F.col("at")), F.col("prose") & (F.col("x") >= F.col("at"))
    across = F.when((F.col("x") < F.col("at")) & (F.col("right") > F.col("at")), F.struct("y", "bottom"))
    sides = met.groupBy(*key, "tall", "last", "at").agg(
        F.count_if(left).alias("n_left"), F.min(F.when(left, F.col("y"))).alias("left_top"), F.max(F.when(left, F.col("bottom"))).alias("left_end"),
        F.count_if(right).alias("n_right"), F.min(F.when(right, F.col("y"))).alias("right_top"), F.max(F.when(right, F.col("bottom"))).alias("right_end"), F.collect_list(across).alias("across"),
    )
    beside_from, beside_to = F.greatest("left_top", "right_top"), F.least("left_end", "right_end")
    span = F.least(F.col("left_end") - F.col("left_top"), F.col("right_end") - F.col("right_top"))
    enough = (F.least("n_left", "n_right") >= LEAST_SEGMENTS) & (beside_to - beside_from >= F.greatest(F.col("tall") * 3, span * 0.45))
    crossing = F.size(F.filter("across", lambda s: (s["bottom"] > beside_from) & (s["y"] < beside_to)))
    scored = sides.select(*key, "at", "last", F.when(enough, F.least("n_left", "n_right") - SPANNING_PENALTY * crossing).alias("score"))
    onward = Window.partitionBy(*key).orderBy("at")
    good = F.coalesce(F.col("score") >= LEAST_SEGMENTS, F.lit(False))
    scored = scored.withColumns({"good": good, "to": F.coalesce(F.lead("at").over(onward) - 1, F.col("last"))})
    goes_on = F.col("good") & F.coalesce(F.lag("good").over(onward) & (F.lag("score").over(onward) == F.col("score")), F.lit(False))
    runs = scored.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(onward)).filter("good")
    runs = runs.groupBy(*key, "run").agg(F.max("score").alias("score"), F.min("at").alias("from"), F.max("to").alias("to"))
    best = F.max(F.struct("score", (F.col("to") - F.col("from")).alias("width"), (-F.col("from")).alias("back"))).alias("b")
    return runs.groupBy(*key).agg(best).select(*key, (-F.col("b.back")).alias("gutter_from"), (F.col("b.width") - F.col("b.back")).alias("gutter_to"))


def page_layout(tokens: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """The lines of each page in reading order: key, reading_order, column_no, two_column, block_type, text, x, y, width and height.

    tokens has key, x, y, width, height and text, pages key, page_width and page_height; tokens
    without text or place and those of unknown pages are left out. A line breaks where the next word
    is far; between columns it breaks at the gutter. With two columns come what stands above
    them, the left, the right one (1 and 2), what lies across, and what stands below (0).

    All steps are keyed by page, which is bounded by what a sheet holds. Segments are
    written once to the shared folder, as several steps read them; words are read once.
    """
    place = [F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]
    words = tokens.select(*key, *place, F.trim(F.regexp_replace("text", r"[\t\r\n ]+", " ")).alias("text")).filter("text <> ''").dropna(subset=["x", "y", "width", "height"])
    sheets = pages.groupBy(*key).agg(F.max(F.col("page_width").cast("double")).alias("page_width"), F.max(F.col("page_height").cast("double")).alias("page_height"))
    words = _numbered_lines(words, key).join(sheets, key)
    line = [*key, "line_no"]
    across = Window.partitionBy(*line).orderBy("x", "word_no")
    before = F.max(F.col("x") + F.col("width")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    far = F.when(F.col("x") - before > F.greatest(F.lit(12.0), F.col("typical") * 1.5), 1).otherwise(0)
    words = words.withColumn("_far", far).withColumn("segment", F.sum("_far").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_far")
    folder = shared_folder(tokens.sparkSession, "layout")
    segments = stored(_joined(words, [*line, "segment"], "page_width", "page_height"), folder, "segments")
    region = _search_region(segments, key).withColumnRenamed("bottom", "end")
    segments = stored(segments.join(region, key), folder, "regions")
    columns = _gutters(segments, key)
    segments = segments.join(columns, key, "left")
    inside = ((F.col("y") + F.col("bottom")) / 2).between(F.col("top"), F.col("end"))
    along = Window.partitionBy(*line).orderBy("x", "segment")
    reached = F.max("right").over(along.rowsBetween(Window.unboundedPreceding, -1))
    guarded = F.max(inside).over(Window.partitionBy(*line)) & (reached <= F.col("gutter_to")) & (F.col("x") >= F.col("gutter_from"))
    apart = (F.col("x") - reached > F.greatest(F.lit(48.0), F.col("page_width") * 0.12)) | F.coalesce(guarded, F.lit(False))
    segments = segments.withColumn("_apart", F.when(apart, 1).otherwise(0)).withColumn("part", F.sum("_apart").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lines = _merged(segments, [*line, "part"], "top", "end", "gutter_from", "gutter_to")
    width = F.greatest(F.lit(1.0), F.col("right") - F.col("x"))
    column = (
        F.when(F.col("right") <= F.col("gutter_to"), 1)
        .when(F.col("x") >= F.col("gutter_from"), 2)
        .when((F.col("gutter_from") - F.col("x")) / width >= COLUMN_MAJORITY, 1)
        .when((F.col("right") - F.col("gutter_to")) / width >= COLUMN_MAJORITY, 2)
        .otherwise(0)
    )
    lines = lines.withColumn("column_no", F.when(inside & F.col("gutter_from").isNotNull(), column).otherwise(0))
    page, in_column = Window.partitionBy(*key), F.col("column_no") > 0
    lines = lines.withColumns({"two_column": F.max(in_column).over(page), "_from": F.min(F.when(in_column, F.col("y"))).over(page), "_to": F.max(F.when(in_column, F.col("bottom"))).over(page), "_tall": F.greatest(F.lit(1.0), F.median(F.col("bottom") - F.col("y")).over(page))})
    center = (F.col("y") + F.col("bottom")) / 2
    turn = F.when(~F.col("two_column") | (center < F.col("top")), 0).when(center > F.col("end"), 6).when(in_column, F.col("column_no") + 1).when(F.col("bottom") <= F.col("_from"), 1).when(F.col("y") >= F.col("_to"), 5).otherwise(4)
    order = F.row_number().over(page.orderBy(turn, "y", "x", "line_no", "part")) - 1
    height = F.col("bottom") - F.col("y")
    return lines.select(*key, order.alias("reading_order"), "column_no", "two_column", block_type(F.col("text"), height, F.col("_tall")).alias("block_type"), "text", "x", "y", (F.col("right") - F.col("x")).alias("width"), height.alias("height"))


def page_texts(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, text and two_column: the lines of page_layout joined in their order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy(*key).agg(text.alias("text"), F.max("two_column").alias("two_column"))
