"""Page layout from words: ``words`` has doc_id, page, text, x0, x1, top, bottom, page_width, page_height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def bucket(top, size: int) -> Column:
    """A coordinate rounded to a multiple of ``size``, halves to even."""
    return F.bround(T._col(top) / size).cast("long") * size


def _side_text(side: Column) -> Column:
    """The words of one side of a row, from left to right."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("x0", "text")))), lambda w: w["text"]), " ")


def desert(words: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, mid, width``: the middle and width of the widest stretch of 5-point columns, from 20 to 80 % of the page,
    where no word begins, if it is 30 points or more. Runs of empty columns are islands between those with words."""
    pages = words.groupBy("doc_id").agg(F.max("page_width").alias("w"))
    low, high = F.floor(F.col("w") * 0.2 / size), F.floor(F.col("w") * 0.8 / size)
    grid = pages.select("doc_id", high.alias("high"), F.explode(F.sequence(low, high)).alias("b"))
    filled = words.select("doc_id", F.floor(F.col("x0") / size).alias("b"), F.lit(1).alias("n")).distinct()
    cells = grid.join(filled, ["doc_id", "b"], "left")
    rank = Window.partitionBy("doc_id").orderBy("b")
    empty = cells.withColumn("run", F.col("b") - F.sum(F.col("n").isNull().cast("int")).over(rank)).where("n is null")
    runs = empty.groupBy("doc_id", "run").agg(F.min("b").alias("start"), F.max("b").alias("last"), F.max("high").alias("high"))
    # A run that reaches the edge ends there, not behind it.
    stop = F.least(F.col("last") + 1, F.col("high"))
    runs = runs.select("doc_id", "start", ((F.col("start") + stop) / 2.0 * size).alias("mid"), ((stop - F.col("start")) * size).alias("width"))
    best = runs.groupBy("doc_id").agg(F.max_by(F.struct("mid", "width"), F.struct("width", -F.col("start"))).alias("x")).select("doc_id", "x.*")
    return best.where("width >= 30")


#: Stretches of x0 that a hot key's words are dealt into.
STRETCHES = 64


def _stretch(words: DataFrame, column: str) -> Column:
    """The number of a value's stretch, of ``STRETCHES`` with about as many rows in each over the whole table."""
    shares = [k / STRETCHES for k in range(1, STRETCHES)]
    cuts = words.agg(F.percentile_approx(column, F.array(*map(F.lit, shares)), 10_000)).first()[0] or []
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(column))) if cuts else F.lit(0)


def top_gaps(words: DataFrame, k: int = 3) -> DataFrame:
    """``doc_id, rank, gap, mid``: the k widest gaps between neighbouring x0 (ties: the later ones first).

    Neighbours are found within stretches of x0, and across their edges from each stretch's ends, so no window holds all
    words of a key, however many it has; words at one place are counted, and give as many gaps of nothing as can rank."""
    places = words.where(F.col("x0").isNotNull()).groupBy("doc_id", "x0").agg(F.count(F.lit(1)).alias("n")).withColumn("s", _stretch(words, "x0"))
    inside = places.select("doc_id", "x0", (F.lead("x0").over(Window.partitionBy("doc_id", "s").orderBy("x0")) - F.col("x0")).alias("gap"))
    ends = places.groupBy("doc_id", "s").agg(F.min("x0").alias("low"), F.max("x0").alias("x0"))
    across = ends.select("doc_id", "x0", (F.lead("low").over(Window.partitionBy("doc_id").orderBy("s")) - F.col("x0")).alias("gap"))
    none = places.where("n > 1").select("doc_id", "x0", F.explode(F.array_repeat(F.col("x0") - F.col("x0"), F.least(F.col("n") - 1, F.lit(k)).cast("int"))).alias("gap"))
    gaps = inside.unionByName(across).unionByName(none).where("gap is not null")
    # Each task keeps the k best of each key before they meet.
    ranked = gaps.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("gap"), F.desc("x0"))))
    return ranked.where(F.col("rank") <= k).select("doc_id", "rank", "gap", (F.col("x0") + F.col("gap") / 2).alias("mid"))


def redetect(words: DataFrame, fallback: DataFrame) -> DataFrame:
    """``doc_id, col_x``: the widest of five gaps over 25 points within 15-85 % of the page; else ``fallback``'s (doc_id, col_x)."""
    pages = words.groupBy("doc_id").agg(F.max("page_width").alias("w"), F.count(F.lit(1)).alias("n"))
    good = top_gaps(words, 5).join(pages, "doc_id").where("n >= 10 and gap > 25 and mid > w * 0.15 and mid < w * 0.85")
    best = good.groupBy("doc_id").agg(F.min_by("mid", "rank").alias("found"))
    return fallback.join(best, "doc_id", "left").select("doc_id", F.coalesce("found", "col_x").alias("col_x"))


def is_two_column(words: DataFrame, borders: DataFrame) -> DataFrame:
    """``doc_id, col_x, real``: whether a border (doc_id, col_x) parts two columns: at most 35 % of the rows with both sides
    (those of two headers don't count) go on from left to right."""
    w = words.join(borders, "doc_id")
    left, right = F.col("x0") < F.col("col_x"), F.col("x0") >= F.col("col_x")
    rows = w.groupBy("doc_id", "col_x", bucket("top", 5).alias("y")).agg(
        _side_text(left).alias("l"), _side_text(right).alias("r"), F.max_by(F.when(left, F.col("text")), F.when(left, F.col("x0"))).alias("last_left"), F.min_by(F.when(right, F.col("text")), F.when(right, F.col("x0"))).alias("first_right")
    )
    rows = rows.where("last_left is not null and first_right is not null")
    header = lambda x: (T.strip(x) == F.upper(T.strip(x))) & (F.length(T.strip(x)) <= 30) & x.rlike(r"\p{L}")
    rows = rows.where(~(header(F.col("l")) & header(F.col("r"))))
    goes_on = F.col("first_right").rlike(r"^\p{Ll}") | (~F.col("last_left").rlike(r"[.,:;|–—()]$") & F.col("first_right").rlike(r"^\p{L}"))
    share = rows.groupBy("doc_id", "col_x").agg((F.count_if(goes_on) / F.count(F.lit(1))).alias("share"))
    return borders.join(share, ["doc_id", "col_x"], "left").select("doc_id", "col_x", F.coalesce(F.col("share") <= 0.35, F.lit(True)).alias("real"))


def detect_layout(words: DataFrame, lines: DataFrame, rects: DataFrame) -> DataFrame:
    """``doc_id, col_x, header_end_y, kind`` of first pages: paired horizontal lines, a sidebar, a gap between words, or
    single, by the first rule that fits. ``lines`` and ``rects`` have doc_id, x0, x1, top, bottom, width, height."""
    first = words.where("page = 1")
    pages = first.groupBy("doc_id").agg(F.max("page_width").alias("w"), F.max("page_height").alias("h"), F.count(F.lit(1)).alias("n"))
    drawn = lines.join(pages, "doc_id")
    flat = drawn.where("abs(top - bottom) < 3 and width > 50").withColumn("y", bucket("top", 5))
    on_left, on_right = F.col("x0") < F.col("w") / 2, F.col("x1") > F.col("w") / 2
    pair = flat.groupBy("doc_id", "y", "w").agg(F.count(F.lit(1)).alias("k"), F.max(F.when(on_left, F.col("x1"))).alias("le"), F.min(F.when(on_right, F.col("x0"))).alias("rs"), F.max(F.when(on_left, F.col("x1") - F.col("x0"))).alias("ll"), F.max(F.when(on_right, F.col("x1") - F.col("x0"))).alias("rl"))
    pair = pair.where("k >= 2 and rs > le + 10 and (rs - le) / w <= 0.10 and ll / (w / 2) >= 0.5 and rl / (w / 2) >= 0.5")
    pair = pair.groupBy("doc_id").agg(F.min_by(F.struct(((F.col("le") + F.col("rs")) / 2).alias("col_x"), F.col("y").cast("double").alias("header_end_y")), "y").alias("pair"))
    bars = rects.join(pages, "doc_id").where("height > h * 0.35 and width > 0 and width < w * 0.45").groupBy("doc_id").agg(F.max_by(F.struct((F.col("x1") + 5).alias("x"), F.col("top").alias("y")), "height").alias("bar"))
    rules = drawn.where("abs(x0 - x1) < 2 and height > h * 0.5").groupBy("doc_id").agg(F.percentile("x0", 0.5).alias("vx"), F.min("top").alias("vy"))
    side = bars.join(rules, "doc_id", "full")
    by_rule = F.col("vx").isNotNull() & (F.col("bar").isNull() | (F.col("vx") < F.col("bar.x")))
    side = side.select("doc_id", F.when(by_rule, F.struct(F.col("vx").alias("col_x"), F.col("vy").alias("header_end_y"))).otherwise(F.struct(F.col("bar.x").alias("col_x"), F.col("bar.y").alias("header_end_y"))).alias("side"))
    many = first.join(pages.where("n > 20").select("doc_id"), "doc_id", "left_semi")
    waste = desert(many)
    gaps = top_gaps(many, 3).join(pages, "doc_id").where("gap > 30 and mid > w * 0.2 and mid < w * 0.8")
    tries = waste.select("doc_id", F.col("mid").alias("col_x"), F.lit(0).alias("rank"), (F.col("width") >= 40).alias("sure")).unionByName(gaps.select("doc_id", F.col("mid").alias("col_x"), "rank", F.lit(False).alias("sure")))
    real = is_two_column(many, tries.select("doc_id", "col_x").distinct())
    word = tries.join(real, ["doc_id", "col_x"]).where("sure or real").groupBy("doc_id").agg(F.min_by("col_x", "rank").alias("word_x"))
    out = pages.select("doc_id").join(pair, "doc_id", "left").join(side, "doc_id", "left").join(word, "doc_id", "left")
    return out.select(
        "doc_id",
        F.coalesce("pair.col_x", "side.col_x", "word_x").alias("col_x"),
        F.coalesce("pair.header_end_y", "side.header_end_y", F.when(F.col("word_x").isNotNull(), 0.0)).alias("header_end_y"),
        F.when(F.col("pair").isNotNull(), "paired_hlines").when(F.col("side").isNotNull(), "sidebar").when(F.col("word_x").isNotNull(), "word_gap").otherwise("single").alias("kind"),
    )


def is_date_label_layout(col_x: Column, page_width: Column) -> Column:
    return F.coalesce(col_x <= page_width * 0.25, F.lit(False))


def probe_date_labels(words: DataFrame) -> DataFrame:
    """``doc_id, date_labels``: some row holds only dates in the left 26 % and an employer's word at the right. Rows of
    equal height on different pages count as one."""
    left = F.col("x0") < F.col("page_width") * 0.26
    rows = words.groupBy("doc_id", bucket("top", 3).alias("y")).agg(F.count_if(left).alias("n"), F.count_if(left & ~F.col("text").rlike(P.DATE_TOKEN)).alias("other"), F.bool_or(~left & F.col("text").rlike(P.EMPLOYER_TOKEN)).alias("employer"))
    return rows.groupBy("doc_id").agg(F.bool_or((F.col("n") > 0) & (F.col("other") == 0) & F.col("employer")).alias("date_labels"))


def label_boundary(words: DataFrame, default: int = 140) -> DataFrame:
    """``doc_id, boundary``: the upper median, over rows that begin with three dates and go on with an employer's word, of
    those dates' right end plus 5, where it lies in the left 40 %."""
    rows = words.groupBy("doc_id", "page", bucket("top", 3).alias("y")).agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("ws"), F.max("page_width").alias("w"))
    first, rest = F.slice("ws", 1, 3), F.slice(F.col("ws"), F.lit(4), F.size("ws"))
    edge = F.array_max(F.transform(first, lambda x: x["x1"])) + 5
    good = rows.where(F.forall(first, lambda x: x["text"].rlike(P.DATE_TOKEN)) & F.exists(rest, lambda x: x["text"].rlike(P.EMPLOYER_TOKEN)) & (edge < F.col("w") * 0.4))
    found = good.groupBy("doc_id").agg(F.sort_array(F.collect_list(edge)).alias("e")).select("doc_id", F.get("e", F.floor(F.size("e") / 2).cast("int")).cast("int").alias("found"))
    return words.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(default)).alias("boundary"))


def row_aware_text(words: DataFrame, borders: DataFrame) -> DataFrame:
    """``doc_id, text`` of pages whose left column (up to ``borders``' boundary) holds dates: rows of 3 points from both
    sides, a range split over two rows made one, capitals at the right taken for headings."""
    w = words.join(borders, "doc_id")
    left = F.col("x0") < F.col("boundary")
    rows = w.groupBy("doc_id", "page", bucket("top", 3).alias("y")).agg(T.strip(_side_text(left)).alias("l"), T.strip(_side_text(~left)).alias("r"))
    order = Window.partitionBy("doc_id").orderBy("page", "y")
    cut = (F.col("l").rlike(P.DATE_PARTIAL) | F.col("l").rlike(P.DATE_COMPACT)) & F.coalesce(F.lead("l").over(order).rlike(P.DATE_END), F.lit(False))
    rows = rows.withColumns({"pos": F.row_number().over(order), "cut": cut, "nl": F.lead("l").over(order), "nr": F.lead("r").over(order)})
    # An end that was taken by the row before it can't take the next: an end is never a cut range itself.
    rows = rows.withColumns({"taken": F.coalesce(F.lag("cut").over(order), F.lit(False)), "pr": F.lag("r").over(order)})
    rows = rows.where(~(F.col("taken") & ((F.col("pr") == "") | (F.col("r") == "") | (F.col("r") == F.col("pr")))))
    date = T.strip(T.sub(F.concat_ws(" ", T.sub(F.col("l"), r"\s+$"), F.col("nl")), r"([-–])([A-Za-z])", "$1 $2"))
    l = T.sub(F.when(F.col("taken"), "").when(F.col("cut"), date).otherwise(F.col("l")), " {2,}", " ")
    r = T.sub(F.when(F.col("cut") & (F.col("r") == ""), F.col("nr")).otherwise(F.col("r")), " {2,}", " ")
    heading = (l == "") & (r != "") & (r == F.upper(r)) & (F.length(r) <= 60) & ~r.rlike(r"[@:/\d]")
    line = F.when(heading, F.concat(F.lit("\n"), r)).when(l == "", F.concat(F.lit("  "), r)).when(r == "", F.concat(F.lit("  "), l)).otherwise(F.concat(F.lit("  "), l, F.lit("  "), r))
    shown = rows.select("doc_id", "pos", line.alias("line"), ((l == "") & (r == "")).alias("none")).where("not none")
    text = shown.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    x = T.sub(F.col("text"), r"(?m)^[ \t]*[\uf0b7\uf0a7\u2022\u25cf\u25aa\u25ba][ \t]*$")
    x = T.sub(T.sub(T.sub(x, r"\n{3,}", "\n\n"), r"\n\n(  [^A-Z\n])", "\n$1"), " {2,}", " ")
    return text.select("doc_id", T.strip(T.sub(x, r"(?m)^([ \t]*)[\uf0b7\uf0a7\u2022\u25cf] ", "$1")).alias("text"))


def crop(words: DataFrame, x0: Column, top: Column, x1: Column, bottom: Column) -> DataFrame:
    """The words that lie in a box."""
    return words.where((F.col("x0") >= x0) & (F.col("x1") <= x1) & (F.col("top") >= top) & (F.col("bottom") <= bottom))


def page_text(words: DataFrame, by=("doc_id",), size: int = 3) -> DataFrame:
    """Words as lines of text, by page, row and place."""
    rows = words.groupBy(*by, "page", bucket("top", size).alias("y")).agg(_side_text(F.lit(True)).alias("line"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "y", "line"))), lambda x: x["line"]), "\n").alias("text"))


def two_column_text(words: DataFrame, borders: DataFrame) -> DataFrame:
    """``doc_id, text``: of the first page the header, the left and the right column; then of later pages left and right,
    or the whole page where the right holds under a tenth of the left. ``borders``: doc_id, col_x, header_end_y."""
    w = words.join(borders, "doc_id")
    right = F.col("x0") >= F.col("col_x")
    size = Window.partitionBy("doc_id", "page")
    chars = lambda side: F.coalesce(F.sum(F.when(side, F.length("text"))).over(size), F.lit(0))
    whole = (F.col("page") > 1) & (chars(right) < chars(~right) * 0.1)
    part = F.when((F.col("page") == 1) & (F.col("bottom") <= F.col("header_end_y")), 0).when(whole, 1).when(right, 2).otherwise(1)
    parts = page_text(w.withColumn("part", part).withColumn("sheet", F.col("page")), ("doc_id", "sheet", "part"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "part", "text"))), lambda x: x["text"]), "\n").alias("text"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_box: tuple[str, ...], b_box: tuple[str, ...], size: float = 40.0) -> DataFrame:
    """Rows of ``a`` and ``b`` that share ``keys`` and whose boxes (names of left, right, top and bottom) overlap.

    Boxes are cut into the cells of a grid and meet by cell, so a page's boxes are only compared with those nearby. A pair
    counts in the one cell that holds the upper left corner of what both cover. Boxes without a number meet none."""

    def cells(df: DataFrame, box: tuple[str, ...], cx: str, cy: str) -> DataFrame:
        of = lambda c: F.floor(F.col(c) / size)
        fine = df.where(F.col(box[0]).isNotNull() & (F.col(box[0]) <= F.col(box[1])) & (F.col(box[2]) <= F.col(box[3])))
        return fine.withColumn(cx, F.explode(F.sequence(of(box[0]), of(box[1])))).withColumn(cy, F.explode(F.sequence(of(box[2]), of(box[3]))))

    x, y = cells(a, a_box, "_cx", "_cy"), cells(b, b_box, "_cx", "_cy")
    near = x.join(y, [*keys, "_cx", "_cy"])
    left, top = F.greatest(F.col(a_box[0]), F.col(b_box[0])), F.greatest(F.col(a_box[2]), F.col(b_box[2]))
    both = (left < F.least(F.col(a_box[1]), F.col(b_box[1]))) & (top < F.least(F.col(a_box[3]), F.col(b_box[3])))
    return near.where(both & (F.floor(left / size) == F.col("_cx")) & (F.floor(top / size) == F.col("_cy"))).drop("_cx", "_cy")


def link_display(links: DataFrame, chars: DataFrame) -> DataFrame:
    """``links`` with ``display_text``: the characters that a link's box overlaps on its page, from left to right.

    Boxes that are equal show the same text, and equal characters stand beside each other in it. So both are made one, with
    their number, before they meet, and pairs grow with the different boxes; texts go back to the links by their box."""
    box = ["doc_id", "page", "x0", "x1", "y0", "y1"]
    boxes = links.select(*box).where(" and ".join(f"{c} is not null" for c in box)).distinct()
    c = chars.select("doc_id", "page", F.col("text").alias("_c"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    c = c.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("_times"))
    met = overlaps(boxes, c, ["doc_id", "page"], ("x0", "x1", "y0", "y1"), ("_x0", "_x1", "_t", "_b"))
    said = F.array_sort(F.collect_list(F.struct("_x0", "_c", "_times")))
    shown = met.groupBy(*box).agg(F.array_join(F.transform(said, lambda x: F.repeat(x["_c"], x["_times"].cast("int"))), "").alias("display_text"))
    return links.join(shown, box, "left").withColumn("display_text", F.coalesce("display_text", F.lit("")))


def has_spaced_letters(text: Column) -> Column:
    """Whether one of the first 15 lines is letters parted by spaces."""
    return F.exists(F.slice(F.transform(F.split(text, "\n"), T.strip), 1, 15), lambda x: x.rlike(r"^[A-Za-z](\s[A-Za-z]){4,}$") | x.rlike(r"^([A-Z]\s){2,}[A-Z](\s{2,}([A-Z]\s)*[A-Z])?$"))


def x_tolerance(chars: DataFrame, default: int = 3) -> DataFrame:
    """``doc_id, page, tolerance``: where the histogram of gaps between characters of a row (80 bins up to 20 points) first
    falls to a local low under 15 % of its first peak; rounded up, 1 to 7."""
    order = Window.partitionBy("doc_id", "page").orderBy(bucket("top", 5), "x0")
    gaps = chars.select("doc_id", "page", (F.col("x0") - F.lag("x1").over(order)).alias("gap"), F.abs(F.col("top") - F.lag("top").over(order)).alias("dy")).where("dy < 3 and gap > -2 and gap < 20")
    span = gaps.groupBy("doc_id", "page").agg(F.min("gap").alias("low"), F.max("gap").alias("high")).where("high > low")
    step = (F.col("high") - F.col("low")) / 80
    binned = gaps.join(span, ["doc_id", "page"]).groupBy("doc_id", "page", F.least(F.floor((F.col("gap") - F.col("low")) / step), F.lit(79)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select("doc_id", "page", "low", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(79))).alias("b"))
    by_bin = Window.partitionBy("doc_id", "page").orderBy("b")
    hist = grid.join(binned, ["doc_id", "page", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    hist = hist.withColumns({"prev": F.lag("n").over(by_bin), "next": F.lead("n").over(by_bin)})
    peak = hist.where("b < 40").groupBy("doc_id", "page").agg(F.max_by(F.struct("b", "n"), F.struct("n", -F.col("b"))).alias("peak"))
    low = hist.join(peak, ["doc_id", "page"]).where("b > peak.b and b < 55 and n <= prev and n <= next and n < peak.n * 0.15")
    found = low.groupBy("doc_id", "page").agg(F.min_by(F.ceil(F.col("low") + (F.col("b") + 0.5) * F.col("step")), "b").alias("t"))
    pages = chars.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    return pages.join(found, ["doc_id", "page"], "left").select("doc_id", "page", F.when(F.col("n") < 50, default).otherwise(F.coalesce(F.least(F.greatest("t", F.lit(1)), F.lit(7)), F.lit(default))).cast("int").alias("tolerance"))


def sidebar_share(rects: DataFrame) -> DataFrame:
    """``doc_id, share``: the right end, as a share of the page, of the tallest box over half as high and under half as wide."""
    good = rects.where("height > page_height * 0.5 and width < page_width * 0.5 and width > 0")
    return good.groupBy("doc_id").agg(F.max_by(F.col("x1") / F.col("page_width"), "height").alias("share"))


def is_image_based(pages: DataFrame) -> DataFrame:
    """``doc_id, image_based`` from pages (doc_id, n_chars, n_images): under 200 characters in all, and some image."""
    return pages.groupBy("doc_id").agg(((F.sum("n_chars") < 200) & (F.sum("n_images") > 0)).alias("image_based"))


def best_page_text(native: Column, ocr: Column, least: int = 200) -> Column:
    """The recognised text where a page's own is short and shorter."""
    return F.when((F.length(native) < least) & (F.length(ocr) > F.length(native)), ocr).otherwise(native)
