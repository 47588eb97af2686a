"""How a book is laid out: volumes, contents and the order of its pages. All books at once, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_AVERAGE_PAGES, ALL_UNDER_PAGES = 8, 200


def volumes(pages: DataFrame, places: DataFrame) -> DataFrame:
    """(book_id, volume, part_type, part_value, page_number): the pages of each volume.

    Each different first part is a volume, numbered as they are reached in page order; a page is in all the
    volumes of its places. An uncited page is in the volume before it, leading ones in the first.
    """
    first = places.select("book_id", "page_number", "id", F.get("parts", F.lit(0)).alias("part")).where("part is not null")
    reached = first.groupBy("book_id", "part").agg(F.min(F.struct("page_number", "id")).alias("at"))
    numbered = reached.select("book_id", "part", F.row_number().over(Window.partitionBy("book_id").orderBy("at")).alias("volume"))
    # of a page's places the one whose volume goes on: the last of them
    last = first.groupBy("book_id", "page_number").agg(F.max_by("part", "id").alias("last"))
    known = pages.select("book_id", "page_number").join(last, ["book_id", "page_number"], "left")
    before = Window.partitionBy("book_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = known.withColumn("carried", F.last("last", ignorenulls=True).over(before))
    cited = first.select("book_id", "page_number", "part").join(pages.select("book_id", "page_number"), ["book_id", "page_number"], "left_semi")
    uncited = filled.where("last is null").select("book_id", "page_number", F.col("carried").alias("part"))
    placed = cited.unionByName(uncited).distinct()
    named = numbered.select(F.col("book_id").alias("_b"), F.col("part").alias("v_part"), "volume")
    # a page without a part leads the book: it is in the first volume
    joined = placed.join(named, (F.col("book_id") == F.col("_b")) & F.coalesce(F.col("part") == F.col("v_part"), F.col("volume") == 1))
    return joined.select("book_id", F.col("volume").cast("int").alias("volume"), F.col("v_part.type").alias("part_type"), F.col("v_part.value").alias("part_value"), "page_number").distinct()


def page_layout(pages: DataFrame, vols: DataFrame) -> DataFrame:
    """(book_id, page_count, volume_count, layout): volume, marked or all."""
    n = pages.groupBy("book_id").agg(F.count("*").alias("page_count"))
    v = vols.groupBy("book_id").agg(F.countDistinct("volume").alias("volume_count"))
    out = n.join(v, "book_id", "left").fillna(0, ["volume_count"])
    layout = (
        F.when(F.col("volume_count") == 0, "volume")
        .when(F.col("page_count") < MIN_AVERAGE_PAGES * F.col("volume_count"), "all")
        .when(F.col("page_count") < ALL_UNDER_PAGES, "marked")
        .otherwise("volume")
    )
    return out.withColumn("layout", layout)


def selected_volume(asked: DataFrame, vols: DataFrame) -> DataFrame:
    """(asked columns, selected) of (book_id, volume?, page?): the volume asked for, null where there is none; else the first with the page; else 1."""
    count = vols.groupBy("book_id").agg(F.max("volume").alias("_n"))
    holding = vols.groupBy(F.col("book_id").alias("_book"), F.col("page_number").alias("_page")).agg(F.min("volume").alias("_of"))
    out = asked.join(count, "book_id", "left").join(holding, (F.col("book_id") == F.col("_book")) & (F.col("page") == F.col("_page")), "left")
    most = F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))
    pick = F.when(F.col("volume").isNotNull(), F.when(F.col("volume").between(1, most), F.col("volume"))).otherwise(F.coalesce("_of", F.lit(1)))
    return out.select(*asked.columns, pick.cast("int").alias("selected"))


def volume_name(part_type: Column, part_value: Column) -> Column:
    return F.concat(F.upper(F.substring(part_type, 1, 1)), F.substring(part_type, F.lit(2), F.length(part_type)), F.lit(" "), part_value.cast("string"))


def page_order(pages: DataFrame, vols: DataFrame, counts: DataFrame, open_volume: int = 1) -> DataFrame:
    """(book_id, page_number, kind, volume, printed, cited_by): what a book lists; kind 0 marks a volume, 1 is a page."""
    layout = page_layout(pages, vols).select("book_id", "layout")
    listed = pages.join(layout, "book_id").join(counts, ["book_id", "page_number"], "left")
    opened = vols.where(F.col("volume") == open_volume).select("book_id", "page_number", F.lit(True).alias("_in"))
    has_it = opened.select("book_id", F.lit(True).alias("_has")).distinct()
    chosen = listed.join(opened.distinct(), ["book_id", "page_number"], "left").join(has_it, "book_id", "left")
    chosen = chosen.where((F.col("layout") != "volume") | F.col("_has").isNull() | F.col("_in").isNotNull())
    rows = chosen.select("book_id", "page_number", F.lit(1).alias("kind"), F.lit(0).alias("volume"), "printed", F.coalesce("n", F.lit(0)).cast("long").alias("cited_by"))
    starts = vols.groupBy("book_id", "volume", "part_type", "part_value").agg(F.min("page_number").alias("page_number"))
    marks = starts.join(layout.where("layout = 'marked'"), "book_id").select("book_id", "page_number", F.lit(0).alias("kind"), "volume", volume_name(F.col("part_type"), F.col("part_value")).alias("printed"), F.lit(None).cast("long").alias("cited_by"))
    return rows.unionByName(marks)


def contents(places: DataFrame, pages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(book_id, path, depth, page_number, printed, reached, label): the entries of each book's contents.

    An entry's page is the first that is cited by exactly its path, or else the first under it; ``reached`` gives
    the order of entries of one level. names: (book_id, path, label).
    """
    each = places.select("book_id", "page_number", "id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    paths = each.select("book_id", F.slice("parts", F.lit(1), F.col("depth")).alias("path"), "depth", F.struct("page_number", "id").alias("at"), (F.col("depth") == F.size("parts")).alias("exact"))
    entries = paths.groupBy("book_id", "path", "depth").agg(F.min("at").alias("first"), F.min(F.when(F.col("exact"), F.col("at"))).alias("own"))
    out = entries.select("book_id", "path", "depth", F.coalesce("own", "first").getField("page_number").alias("page_number"), F.col("first").alias("reached"))
    out = out.join(pages.select("book_id", "page_number", "printed"), ["book_id", "page_number"], "left").withColumn("printed", F.coalesce("printed", F.lit("")))
    if names is None:
        return out.withColumn("label", F.lit(None).cast("string"))
    return out.join(names, ["book_id", "path"], "left")


def place_on_page(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(asked columns, snapped) of (book_id, place): the place if a row's parts begin it, else the first row under it, else null.

    Both sides meet on whole paths: the beginnings of a place on the parts of rows, a place on the beginnings of rows.
    """
    beginnings = lambda c: F.transform(F.sequence(F.lit(1), F.size(c)), lambda n: F.slice(c, F.lit(1), n))
    wanted = asked.select(F.col("book_id").alias("_b"), F.col("place").alias("_place")).where("size(place) > 0").distinct()
    known = places.select(F.col("book_id").alias("_pb"), F.col("parts").alias("_parts")).where("size(parts) > 0")
    on = wanted.select("_b", "_place", F.explode(beginnings(F.col("_place"))).alias("_up")).join(known.distinct(), (F.col("_b") == F.col("_pb")) & (F.col("_up") == F.col("_parts")), "left_semi")
    on = on.select("_b", "_place").distinct().withColumn("_on", F.lit(True))
    rows = places.select(F.col("book_id").alias("_b"), F.struct("page_number", "id").alias("_at"), "parts", F.explode(beginnings(F.col("parts"))).alias("_place"))
    under = rows.groupBy("_b", "_place").agg(F.min_by("parts", "_at").alias("_under"))
    met = asked
    for side in (on, under):
        named = side.withColumnsRenamed({"_b": "_book", "_place": "_path"})
        met = met.join(named, (F.col("book_id") == F.col("_book")) & (F.col("place") == F.col("_path")), "left").drop("_book", "_path")
    return met.select(*asked.columns, F.when(F.col("_on"), F.col("place")).otherwise(F.col("_under")).alias("snapped"))


def path_to_page(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(book_id, page, path): the deepest entry reached by taking at each level the last one that starts at or before the page.

    Levels are walked one after the other, as deep as entries go, over entries that are made once (a checkpoint). At each, entries and pages are one stream in page order, and a page takes
    the furthest entry so far: no page meets an entry that it does not take.
    """
    at = asked.select("book_id", "page", F.expr("cast(array() as array<struct<type: string, value: int>>)").alias("path"))
    entries = entries.select("book_id", "path", "depth", "page_number", "reached").checkpoint()
    done = at.limit(0)
    for depth in range(1, 1 + (entries.agg(F.max("depth")).first()[0] or 0)):
        level = entries.where(F.col("depth") == depth).select("book_id", F.slice("path", F.lit(1), F.lit(depth - 1)).alias("path"), F.col("page_number").alias("page"), F.struct("reached", F.col("path").alias("to")).alias("entry"))
        so_far = Window.partitionBy("book_id", "path").orderBy("page", F.col("entry").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        merged = level.unionByName(at.withColumn("entry", F.lit(None)), allowMissingColumns=True)
        next_ = merged.withColumn("last", F.max("entry").over(so_far)["to"]).where("entry is null").select("book_id", "page", "path", "last")
        done = done.unionByName(next_.where("last is null").select("book_id", "page", "path"))
        at = next_.where("last is not null").select("book_id", "page", F.col("last").alias("path"))
    return done.unionByName(at).distinct()


#: Blocks of 2 to the ``l`` pages that make up the pages from ``low`` to ``high``: at most two of each size.
_BLOCKS = """flatten(transform(sequence(0, 31), l -> transform(filter(array(
    struct(ceil(low / shiftleft(1L, l)) AS n, ceil(low / shiftleft(1L, l)) % 2 = 1 AS takes), struct(floor((high + 1) / shiftleft(1L, l)) - 1 AS n, floor((high + 1) / shiftleft(1L, l)) % 2 = 1 AS takes)),
  b -> b.takes AND ceil(low / shiftleft(1L, l)) < floor((high + 1) / shiftleft(1L, l))), b -> struct(l AS size, b.n AS n))))"""


def page_volumes(pages: DataFrame, vols: DataFrame) -> DataFrame:
    """(book_id, page_number, volume): the last volume whose first to last page takes the page in.

    Spans are cut into aligned blocks, twice the logarithm of their length at most; a page is in one block of each
    size, so that pages and spans meet by equality.
    """
    span = vols.groupBy("book_id", "volume").agg(F.min("page_number").cast("long").alias("low"), F.max("page_number").cast("long").alias("high"))
    blocks = span.select("book_id", "volume", F.explode(F.expr(_BLOCKS)).alias("b")).select(F.col("book_id").alias("_b"), "b.size", "b.n", "volume")
    last = blocks.groupBy("_b", "size", "n").agg(F.max("volume").alias("volume"))
    used = blocks.groupBy("_b").agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    asked = pages.select("book_id", "page_number").distinct().join(used, F.col("book_id") == F.col("_b")).select("book_id", "page_number", F.explode("sizes").alias("_size"))
    asked = asked.withColumn("_n", F.expr("shiftright(cast(page_number as bigint), _size)"))
    met = asked.join(last, (F.col("book_id") == F.col("_b")) & (F.col("_size") == F.col("size")) & (F.col("_n") == F.col("n")))
    return met.groupBy("book_id", "page_number").agg(F.max("volume").alias("volume"))


def suffixed(df: DataFrame, base: str, order: str, key: str = "book_id") -> DataFrame:
    """Repeated ids get -2, -3, ... as they come."""
    n = F.row_number().over(Window.partitionBy(key, base).orderBy(order))
    return df.withColumn("id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))


def gap_filled(df: DataFrame, value: str, order: str, key: str = "book_id") -> DataFrame:
    """A missing number is filled where its neighbours leave exactly one."""
    w = Window.partitionBy(key).orderBy(order)
    low, high = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn("filled", F.coalesce(F.col(value), F.when(high - low == 2, low + 1)))


def verses_cited(df: DataFrame) -> DataFrame:
    """(citation_id, verses): each location's verses with the book and chapter that came last before it."""
    each = df.select("citation_id", F.posexplode("locations").alias("n", "l"))
    w = Window.partitionBy("citation_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = [F.last(F.when(F.col("l.type") == t, F.col("l.value")), ignorenulls=True).over(w).alias(t) for t in ("book", "chapter")]
    return each.select("citation_id", "n", "l", *carried).where("l.type = 'verse' and book is not null and chapter is not null").select("citation_id", "book", "chapter", F.col("l.value").alias("verse")).distinct()
