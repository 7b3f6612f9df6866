"""Queries of page analysis with their SQL; the elements of pages are made of order lines, as no table here holds any."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import pages
from docloom.plans.relational import _BOXES, _boxes
from docloom.tables import read

CATALOG: dict = {}


def query(sql: str | None = None):
    def keep(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return keep


WIDTH, HEIGHT = 640.0, 780.0
#: Drawings, texts and images of pages: lines of an order one to three, four and five, and the others.
_ELEMENTS = f"""e AS (SELECT l_orderkey // 40 AS page, l_linenumber AS n, ((l_partkey * 37) % 500)::DOUBLE AS x0, ((l_suppkey * 53 + l_linenumber * 11 + l_partkey) % 700)::DOUBLE AS y0,
  ((l_partkey * 37) % 500 + 20 + l_linenumber * 15)::DOUBLE AS x1, ((l_suppkey * 53 + l_linenumber * 11 + l_partkey) % 700 + 10 + l_linenumber * 9)::DOUBLE AS y1,
  (l_quantity::BIGINT % 5)::BIGINT AS lines, (l_partkey % 4)::BIGINT AS curves, (l_suppkey % 3)::BIGINT AS rects, l_returnflag = 'R' AS filled, l_linestatus AS color, repeat('a', l_quantity::INT) || repeat(chr(57344), ((l_partkey + l_orderkey // 40) % 60)::INT) AS text FROM lineitem),
 pg AS (SELECT DISTINCT page, {WIDTH}::DOUBLE AS width, {HEIGHT}::DOUBLE AS height FROM e), d AS (SELECT * FROM e WHERE n <= 3), b AS (SELECT * FROM e WHERE n IN (4, 5)), i AS (SELECT * FROM e WHERE n > 5)"""


def _elements(spark, d):
    c = F.col
    x0, y0 = (c("l_partkey") * 37) % 500, (c("l_suppkey") * 53 + c("l_linenumber") * 11 + c("l_partkey")) % 700
    double = lambda e: e.cast("double")
    page = F.floor(c("l_orderkey") / 40)
    e = read(spark, d, "lineitem").select(
        page.alias("page"), c("l_linenumber").alias("n"), double(x0).alias("x0"), double(y0).alias("y0"), double(x0 + 20 + c("l_linenumber") * 15).alias("x1"), double(y0 + 10 + c("l_linenumber") * 9).alias("y1"),
        (c("l_quantity").cast("long") % 5).alias("lines"), (c("l_partkey") % 4).alias("curves"), (c("l_suppkey") % 3).alias("rects"), (c("l_returnflag") == "R").alias("filled"), c("l_linestatus").alias("color"),
        F.concat(F.repeat(F.lit("a"), c("l_quantity").cast("int")), F.repeat(F.lit(""), ((c("l_partkey") + page) % 60).cast("int"))).alias("text"), double(c("l_discount") * 10).alias("stroke"), double(8 + c("l_tax") * 100).alias("size"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"),
    )
    made = e.select("page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")).distinct()
    return made, e.where("n <= 3"), e.where("n IN (4, 5)"), e.where("n > 5")


_BAD = "sum(length(text))::DOUBLE AS signs, sum(length(text) - length(replace(text, chr(57344), '')))::DOUBLE AS private"
_SCORED = f"""{_ELEMENTS}, dt AS (SELECT page, sum(lines + curves + rects)::DOUBLE AS items, sum(curves)::DOUBLE AS curves, count(*) FILTER (filled)::DOUBLE AS fills, count(*)::DOUBLE AS n FROM d GROUP BY page),
 bt AS (SELECT page, count(*)::DOUBLE AS n, count(DISTINCT trunc(y0 / 10))::DOUBLE AS bands, {_BAD} FROM b GROUP BY page), it AS (SELECT page, count(*)::DOUBLE AS n FROM i GROUP BY page),
 gap AS (SELECT page, x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0) AS gap FROM b), ct AS (SELECT page, (1 + count(*) FILTER (gap >= 50))::BIGINT AS columns FROM gap GROUP BY page),
 j AS (SELECT pg.*, coalesce(ct.columns, 1) AS columns, coalesce(dt.items, 0) AS items, coalesce(dt.curves, 0) AS curves, coalesce(dt.fills, 0) AS fills, coalesce(dt.n, 0) AS drawings, coalesce(bt.n, 0) AS blocks, coalesce(bt.bands, 0) AS bands,
  coalesce(bt.signs, 0) AS signs, coalesce(bt.private, 0) AS private, coalesce(it.n, 0) AS images FROM pg LEFT JOIN dt USING (page) LEFT JOIN bt USING (page) LEFT JOIN it USING (page) LEFT JOIN ct USING (page)),
 k AS (SELECT *, items / (width * height / 1000) AS dd, images / (width * height / 10000) AS di, 1.0::DOUBLE - private / greatest(1, signs) AS quality,
  CASE WHEN columns >= 7 THEN 0.95 WHEN columns >= 5 THEN 0.75 WHEN columns >= 3 THEN 0.5 WHEN columns >= 2 THEN 0.3 ELSE 0 END::DOUBLE AS by_columns FROM j),
 s AS (SELECT *, CASE WHEN drawings = 0 THEN 0::DOUBLE ELSE least(1, CASE WHEN dd >= 5 THEN 1 WHEN dd >= 2 THEN 0.7 WHEN dd >= 0.5 THEN 0.4 ELSE dd / 0.5 * 0.4 END::DOUBLE + curves / greatest(1, items) * 0.2::DOUBLE + fills / greatest(1, drawings) * 0.1::DOUBLE) END AS drawing,
  CASE WHEN di >= 0.5 THEN 1 WHEN di >= 0.3 THEN 0.7 WHEN di >= 0.1 THEN 0.4 ELSE di / 0.1 * 0.4 END::DOUBLE AS image, CASE WHEN bands < blocks * 0.5 AND blocks > 5 THEN greatest(by_columns, 0.6) ELSE by_columns END AS layout FROM k),
 o AS (SELECT *, CASE WHEN layout >= 0.95 THEN 0.9::DOUBLE ELSE least(1, drawing * 0.3::DOUBLE + image * 0.2::DOUBLE + (1 - quality) * 0.25::DOUBLE + layout * 0.25::DOUBLE) END AS score FROM s),
 scored AS (SELECT *, CASE WHEN score >= 0.9 THEN 'extreme' WHEN score >= 0.65 THEN 'complex' WHEN score >= 0.35 THEN 'moderate' ELSE 'simple' END AS level FROM o)"""


@query(f"WITH {_SCORED} SELECT page, columns, round(quality, 6) AS quality, round(layout, 6) AS layout, round(score, 6) AS score, level FROM scored")
def complexity_score(spark, d):
    """Complexity of pages by their drawings, images, text and layout."""
    rows = pages.complexity(*_elements(spark, d), ["page"])
    return rows.select("page", "columns", *(F.round(x, 6).alias(x) for x in ("quality", "layout", "score")), "level")


_REGIONED = """cells AS (SELECT page, width, height, r, c, (c * 200)::DOUBLE AS x0, (r * 200)::DOUBLE AS y0, least(c * 200 + 200, width)::DOUBLE AS x1, least(r * 200 + 200, height)::DOUBLE AS y1 FROM pg, (SELECT unnest(range(0, 4)) AS r), (SELECT unnest(range(0, 4)) AS c)),
 rd AS (SELECT cells.page, r, c, count(*)::DOUBLE AS n FROM cells JOIN d ON d.page = cells.page AND cells.x1 > d.x0 AND cells.x0 < d.x1 AND cells.y1 > d.y0 AND cells.y0 < d.y1 GROUP BY ALL),
 rb AS (SELECT cells.page, r, c, sum(length(text))::DOUBLE AS signs, sum(length(text) - length(replace(text, chr(57344), '')))::DOUBLE AS private FROM cells JOIN b ON b.page = cells.page AND cells.x1 > b.x0 AND cells.x0 < b.x1 AND cells.y1 > b.y0 AND cells.y0 < b.y1 GROUP BY ALL),
 rs AS (SELECT cells.*, coalesce(n, 0) / ((x1 - x0) * (y1 - y0) / 1000) AS density, 1.0::DOUBLE - coalesce(private, 0) / greatest(1, coalesce(signs, 0)) AS quality FROM cells LEFT JOIN rd USING (page, r, c) LEFT JOIN rb USING (page, r, c)),
 rz AS (SELECT *, least(1, density / 3 + (1 - quality) * 0.5::DOUBLE) AS score FROM rs),
 regioned AS (SELECT *, CASE WHEN score >= 0.7 THEN 'complex' WHEN score >= 0.4 THEN 'moderate' ELSE 'simple' END AS level, CASE WHEN score >= 0.7 THEN 'block_image' WHEN score >= 0.4 AND quality < 0.7 THEN 'hybrid' ELSE 'text' END AS strategy FROM rz)"""


@query(f"WITH {_ELEMENTS}, {_REGIONED} SELECT page, x0, y0, x1, y1, round(density, 6) AS density, round(quality, 6) AS quality, round(score, 6) AS score, level, strategy FROM regioned")
def complexity_regions(spark, d):
    """Complexity of the regions of pages."""
    made, drawings, blocks, _ = _elements(spark, d)
    rows = pages.regions(made, drawings, blocks, ["page"])
    return rows.select("page", "x0", "y0", "x1", "y1", *(F.round(x, 6).alias(x) for x in ("density", "quality", "score")), "level", "strategy")


@query(f"""WITH {_SCORED}, {_REGIONED}, h AS (SELECT page, sum(CASE WHEN level = 'complex' THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS hard FROM regioned GROUP BY page)
SELECT page, CASE WHEN quality < 0.4 OR (level = 'extreme' AND quality < 0.6) OR (coalesce(hard, 0) / greatest(1, width * height) > 0.5 AND quality < 0.7) THEN 'full_image' WHEN level IN ('complex', 'moderate') THEN 'hybrid' ELSE 'text' END AS strategy FROM scored LEFT JOIN h USING (page)""")
def page_strategy(spark, d):
    """How each page is read."""
    made, drawings, blocks, images = _elements(spark, d)
    return pages.strategies(pages.complexity(made, drawings, blocks, images, ["page"]), pages.regions(made, drawings, blocks, ["page"]), ["page"])


@query("SELECT doc_id, ingested_at, CASE WHEN length(text) > 0 THEN round(1 - length(regexp_replace(text, '[^\\x{E000}-\\x{F8FF}\\x{F0000}-\\x{FFFFD}]', '', 'g')) / length(text), 6) ELSE 0 END::DOUBLE AS quality, NOT coalesce(length(regexp_replace(text, '[^\\x{E000}-\\x{F8FF}\\x{F0000}-\\x{FFFFD}]', '', 'g')) / nullif(length(text), 0) <= 0.3, false) AS needs FROM documents")
def text_quality(spark, d):
    """Quality of texts by their private-use signs, and whether they need recognition."""
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", "ingested_at", F.round(pages.text_quality(t), 6).alias("quality"), pages.needs_recognition(t).alias("needs"))


#: Tables of cells, some blank, some long, of two to five columns, made of the parts.
_TABLES = """w AS (SELECT p_partkey // 9 AS t, p_partkey AS k, [CASE WHEN (p_partkey * 7 + p_partkey // 9) % 5 < (p_partkey // 9) % 6 THEN '' ELSE p_brand END, CASE WHEN (p_partkey // 9) % 11 = 3 THEN repeat(p_name || ', ', (1 + p_partkey % 14)::INT) ELSE p_name END,
  CASE WHEN (p_partkey // 9) % 7 = 2 THEN NULL ELSE p_type END, p_size::VARCHAR, ' '][1:2 + (p_partkey // 9) % 4] AS row FROM part),
 tables AS (SELECT t, list(row ORDER BY k) AS data, 20.0::DOUBLE AS x0, 30.0::DOUBLE AS y0, 320.0::DOUBLE AS x1, (30 + 60 * (1 + t % 10))::DOUBLE AS y1, 780.0::DOUBLE AS page_height, t % 3 = 0 AS has_cells, ((t % 10) / 10.0)::DOUBLE AS graphic, t % 2 = 0 AS native,
  CASE t % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'plumber' ELSE 'lines' END AS finder FROM w GROUP BY t)"""


def _tables(spark, d):
    p = read(spark, d, "part")
    t = F.floor(F.col("p_partkey") / 9)
    row = F.array(
        F.when((F.col("p_partkey") * 7 + t) % 5 < t % 6, "").otherwise(F.col("p_brand")), F.when(t % 11 == 3, F.repeat(F.concat("p_name", F.lit(", ")), (1 + F.col("p_partkey") % 14).cast("int"))).otherwise(F.col("p_name")),
        F.when(t % 7 != 2, F.col("p_type")), F.col("p_size").cast("string"), F.lit(" "),
    )
    rows = p.select(t.alias("t"), "p_partkey", F.slice(row, F.lit(1), (2 + t % 4).cast("int")).alias("row"))
    made = rows.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda x: x["row"]).alias("data"))
    k = F.col("t")
    box = {"x0": F.lit(20.0), "y0": F.lit(30.0), "x1": F.lit(320.0), "y1": (30 + 60 * (1 + k % 10)).cast("double")}
    finder = F.when(k % 3 == 0, "native").when(k % 3 == 1, "plumber").otherwise("lines")
    return made.withColumns({**box, "page_height": F.lit(780.0), "has_cells": k % 3 == 0, "graphic": ((k % 10) / 10.0).cast("double"), "native": k % 2 == 0, "finder": finder})


_TRIM = r"regexp_replace(coalesce(x, ''), '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
_MEASURED = rf"""{_TABLES}, m AS (SELECT *, len(data)::BIGINT AS n_rows, list_max(list_transform(data, lambda r: len(r)))::BIGINT AS n_cols, list_transform(flatten(data), lambda x: {_TRIM}) AS cells, list_transform(data, lambda r: list_transform(r, lambda x: {_TRIM})) AS clean FROM tables),
 q AS (SELECT *, len(cells)::DOUBLE AS n_cells, list_filter(cells, lambda x: x <> '') AS full_cells, len(list_filter(clean, lambda r: len(list_filter(r, lambda x: x <> '')) > 0))::DOUBLE AS valid_rows, len(list_filter(cells, lambda x: length(x) >= 2))::DOUBLE AS telling FROM m),
 f AS (SELECT *, len(full_cells)::DOUBLE AS filled, len(full_cells)::DOUBLE / n_cells AS share FROM q)"""


@query(f"""WITH {_MEASURED}, c AS (SELECT t, finder, CASE finder
 WHEN 'native' THEN 0.6 + CASE WHEN n_rows >= 2 THEN 0.1 ELSE 0 END + CASE WHEN n_cols >= 2 THEN 0.1 ELSE 0 END + CASE WHEN share < 0.05 THEN -0.2 WHEN share < 0.1 THEN -0.1 ELSE share * 0.15 END + CASE WHEN has_cells THEN 0.15 ELSE 0 END - CASE WHEN telling < 2 THEN 0.1 ELSE 0 END - CASE WHEN valid_rows <= 1 THEN 0.1 ELSE 0 END - CASE WHEN graphic >= 0.5 THEN 0.15 ELSE 0 END
 WHEN 'plumber' THEN 0.4 + CASE WHEN n_rows >= 2 THEN 0.1 ELSE 0 END + CASE WHEN n_cols >= 2 THEN 0.1 ELSE 0 END + CASE WHEN share < 0.1 THEN -0.5 WHEN share < 0.2 THEN -0.3 ELSE share * 0.2 END - CASE WHEN telling < 2 THEN 0.3 ELSE 0 END - CASE WHEN valid_rows <= 1 THEN 0.2 ELSE 0 END - CASE WHEN (n_rows - valid_rows) / n_rows > 0.5 THEN 0.2 ELSE 0 END
 ELSE 0.3 + CASE WHEN has_cells THEN 0.2 ELSE 0 END + CASE WHEN n_rows >= 2 THEN 0.1 ELSE 0 END + CASE WHEN n_cols >= 2 THEN 0.1 ELSE 0 END + CASE WHEN share < 0.1 THEN -0.4 WHEN share < 0.2 THEN -0.2 ELSE share * 0.2 END - CASE WHEN telling < 2 THEN 0.2 ELSE 0 END - CASE WHEN valid_rows <= 1 THEN 0.2 ELSE 0 END - CASE WHEN graphic >= 0.3 THEN 0.3 ELSE 0 END END AS s FROM f)
SELECT t, finder, round(greatest(0, least(1, s))::DOUBLE, 6) AS confidence FROM c""")
def table_confidence(spark, d):
    """How sure candidates for tables are."""
    c = F.col
    return _tables(spark, d).select("t", "finder", F.round(pages.table_confidence(c("data"), c("finder"), c("has_cells"), graphic=c("graphic")), 6).alias("confidence"))


_WORDS = "len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''))"
_LONG2 = "list_filter(clean, lambda r: len(r) >= 2 AND length(r[2]) > 80)"


@query(rf"""WITH {_MEASURED}, v AS (SELECT *, len(list_filter(full_cells, lambda x: length(x) > 800)) AS extreme, len(list_filter(full_cells, lambda x: length(x) > 300))::DOUBLE / greatest(1, filled) AS long_share,
  len(list_filter(full_cells, lambda x: (length(x) >= 100 AND {_WORDS} >= 8 AND regexp_matches(x, '[.。?!,、]')) OR (length(x) >= 150 AND regexp_matches(x, '[.。?!,、]')) OR (length(x) >= 80 AND {_WORDS} >= 10)))::DOUBLE / greatest(1, filled) AS running,
  len(list_filter(clean, lambda r: len(r) >= 2 AND r[1] = ''))::DOUBLE AS e, len(list_filter(clean, lambda r: len(r) >= 2 AND length(r[1]) BETWEEN 1 AND 10))::DOUBLE AS s, len({_LONG2})::DOUBLE AS l, len(list_filter({_LONG2}, lambda r: regexp_matches(r[2], '[.。,、]') AND len(list_filter(regexp_split_to_array(r[2], '\s+'), lambda w: w <> '')) >= 5))::DOUBLE AS p,
  coalesce(list_sum(list_transform(full_cells, lambda x: length(x))), 0)::DOUBLE * 50 / ((x1 - x0) * (y1 - y0)) AS density, (y1 - y0) / page_height AS tall FROM f),
 n AS (SELECT *, CASE WHEN NOT native AND graphic >= 0.5 THEN 'in_graphic_region' WHEN n_rows < 2 THEN 'too_few_rows' WHEN n_cols < 2 THEN 'too_few_cols' WHEN extreme > 0 THEN 'extreme_long_cell' WHEN running > 0.25 THEN 'paragraph_text'
  WHEN n_cols = 2 AND ((e / n_rows >= 0.6 AND l / n_rows >= 0.3) OR (n_rows > 5 AND p >= 2) OR (n_rows > 10 AND (e + s) / n_rows >= 0.8 AND l >= 5)) THEN 'invalid_2col' END AS no,
  CASE WHEN share < 0.05 THEN 'very_low_fill' END AS p1, CASE WHEN share >= 0.05 AND share < 0.15 THEN 'low_fill' END AS p2, CASE WHEN (n_rows - valid_rows) / n_rows >= 0.7 THEN 'empty_rows' END AS p3, CASE WHEN telling < 2 THEN 'few_meaningful' END AS p4, CASE WHEN valid_rows < 2 THEN 'few_valid_rows' END AS p5,
  CASE WHEN density < 0.005 THEN 'low_density' END AS p6, CASE WHEN n_cols > n_rows * 5 THEN 'abnormal_ratio' END AS p7, CASE WHEN long_share > 0.4 THEN 'long_cells' END AS p8, CASE WHEN running > 0.1 THEN 'para_cells' END AS p9, CASE WHEN tall > 0.7 AND n_rows > 15 AND n_cols = 2 THEN 'large_2col' END AS p10 FROM v),
 z AS (SELECT *, CASE WHEN no IS NOT NULL THEN 0 ELSE greatest(0, least(1, CASE WHEN has_cells THEN 1.1 ELSE 1 END - (p1 IS NOT NULL)::INT * 0.3 - (p2 IS NOT NULL)::INT * 0.15 - (p3 IS NOT NULL)::INT * 0.15 - (p4 IS NOT NULL)::INT * 0.15 - (p5 IS NOT NULL)::INT * 0.15 - (p6 IS NOT NULL)::INT * 0.1 - (p7 IS NOT NULL)::INT * 0.1 - (p8 IS NOT NULL)::INT * 0.2 - (p9 IS NOT NULL)::INT * 0.15 - (p10 IS NOT NULL)::INT * 0.15)) END::DOUBLE AS sure FROM n)
SELECT t, no IS NULL AND round(sure, 6) >= 0.35 AS valid, round(sure, 6) AS sure, coalesce(no, nullif(concat_ws(', ', p1, p2, p3, p4, p5, p6, p7, p8, p9, p10), ''), 'valid') AS reason FROM z""")
def table_validate_score(spark, d):
    """Candidates for tables held against twelve tests, with the reason for what is none."""
    return pages.validated(_tables(spark, d)).select("t", "valid", F.round("sure", 6).alias("sure"), "reason")


_CLASH = "(greatest(0, least(k.x1, x[1].x1) - greatest(k.x0, x[1].x0)) * greatest(0, least(k.y1, x[1].y1) - greatest(k.y0, x[1].y0)))"


@query(f"""WITH {_BOXES}, o AS (SELECT page, {{'o': id % 4 * 0.15::DOUBLE - score / 100, 'r': id % 4, 'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} AS b FROM boxes), l AS (SELECT page, list(b ORDER BY b.o, b.r, b.id, b.x0, b.y0) AS all_of FROM o GROUP BY page),
 k AS (SELECT page, list_reduce(list_transform(all_of, lambda b: [b]), lambda a, x: CASE WHEN len(list_filter(a, lambda k: {_CLASH} > 0 AND {_CLASH} >= 0.3 * least((k.x1 - k.x0) * (k.y1 - k.y0), (x[1].x1 - x[1].x0) * (x[1].y1 - x[1].y0)))) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM l)
SELECT page, unnest(list_transform(kept, lambda b: b.id)) AS id FROM k""")
def nms_select(spark, d):
    """Candidates of a page without those that overlap a better one, the finders trusted by rank."""
    names = list(pages.FINDERS)
    finder = F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int"))
    return pages.selected(_boxes(spark, d).withColumns({"finder": finder, "confidence": F.col("score") / 100}), ["page"])


def _lines(spark, d):
    """Lines across and down and specks that are neither."""
    _, drawings, _, _ = _elements(spark, d)
    c = F.col
    x1 = F.when(c("n") == 1, c("x1") + 100).otherwise(c("x0") + 2)
    y1 = F.when(c("n") == 1, c("y0") + 1).when(c("n") == 2, c("y1") + 100).otherwise(c("y0") + 2)
    return drawings.select("page", "n", "id", "x0", "y0", x1.alias("x1"), y1.alias("y1"), "stroke")


@query("""WITH e AS (SELECT l_orderkey // 40 AS page, l_linenumber AS n, l_orderkey * 10 + l_linenumber AS id, ((l_partkey * 37) % 500)::DOUBLE AS x0, ((l_suppkey * 53 + l_linenumber * 11 + l_partkey) % 700)::DOUBLE AS y0, l_discount * 10 AS stroke FROM lineitem WHERE l_linenumber <= 3),
 l AS (SELECT *, CASE WHEN n = 1 THEN x0 + 135 ELSE x0 + 2 END AS x1, CASE WHEN n = 1 THEN y0 + 1 WHEN n = 2 THEN y0 + 128 ELSE y0 + 2 END AS y1 FROM e)
SELECT page, id, n = 1 AS across, CASE WHEN stroke < 0.5 THEN 'thin' WHEN stroke > 1.5 THEN 'thick' ELSE 'normal' END AS weight FROM l WHERE (y1 - y0 <= greatest(3, stroke * 2) AND x1 - x0 > 10) OR (x1 - x0 <= greatest(3, stroke * 2) AND y1 - y0 > 10)""")
def line_classes(spark, d):
    """Lines across and down the page by their weight."""
    return pages.classified_lines(_lines(spark, d)).select("page", "id", "across", "weight")


@query("""WITH e AS (SELECT l_orderkey // 40 AS page, l_linenumber = 1 AS across, ((l_partkey * 37) % 500)::DOUBLE AS x0, ((l_suppkey * 53 + l_linenumber * 11 + l_partkey) % 700)::DOUBLE AS y0 FROM lineitem WHERE l_linenumber <= 2),
 p AS (SELECT page, across, CASE WHEN across THEN y0 ELSE x0 END AS place FROM e), g AS (SELECT *, (place - lag(place) OVER (PARTITION BY page, across ORDER BY place) > 5)::INT AS new FROM p), c AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY page, across ORDER BY place RANGE UNBOUNDED PRECEDING) AS c FROM g),
 m AS (SELECT page, across, c, avg(place) AS center, min(place) AS low, max(place) AS high FROM c GROUP BY ALL), t AS (SELECT page, count(*) FILTER (across) AS r, count(*) FILTER (NOT across) AS k, min(center) FILTER (across) AS y0, max(center) FILTER (across) AS y1, min(center) FILTER (NOT across) AS x0, max(center) FILTER (NOT across) AS x1,
  min(low) FILTER (across) AS t, max(high) FILTER (across) AS b, min(low) FILTER (NOT across) AS l, max(high) FILTER (NOT across) AS rr FROM m GROUP BY page)
SELECT page, r::INT AS rows, k::INT AS cols, round(y0, 6) AS y0, round(y1, 6) AS y1, round(x0, 6) AS x0, round(x1, 6) AS x1, t <= y0 + 5 AND b >= y1 - 5 AND l <= x0 + 5 AND rr >= x1 - 5 AS closed FROM t WHERE r >= 2 AND k >= 2""")
def line_grid(spark, d):
    """The grids that the lines of pages make."""
    made = pages.grids(pages.classified_lines(_lines(spark, d)), ["page"])
    ends = {"y0": F.array_min("rows_at"), "y1": F.array_max("rows_at"), "x0": F.array_min("cols_at"), "x1": F.array_max("cols_at")}
    return made.select("page", F.size("rows_at").alias("rows"), F.size("cols_at").alias("cols"), *(F.round(v, 6).alias(k) for k, v in ends.items()), "closed")


@query()
def line_merge(spark, d):
    """Double lines of pages as one."""
    return pages.merged_lines(pages.classified_lines(_lines(spark, d)), ["page"])


@query(f"WITH {_BOXES}, k AS (SELECT page, id, x0, y0, x1, y1 FROM boxes), e AS (SELECT DISTINCT page, unnest([y0, y1]) AS e FROM k), g AS (SELECT page, e, (e - lag(e) OVER (PARTITION BY page ORDER BY e) > 3)::INT AS new FROM e), r AS (SELECT page, e, sum(coalesce(new, 0)) OVER (PARTITION BY page ORDER BY e) AS c FROM g), e2 AS (SELECT DISTINCT page, unnest([x0, x1]) AS e FROM k), g2 AS (SELECT page, e, (e - lag(e) OVER (PARTITION BY page ORDER BY e) > 3)::INT AS new FROM e2), r2 AS (SELECT page, e, sum(coalesce(new, 0)) OVER (PARTITION BY page ORDER BY e) AS c FROM g2) SELECT k.page, id, a.c::INT AS row, x.c::INT AS col, greatest(1, b.c - a.c)::INT AS row_span, greatest(1, y.c - x.c)::INT AS col_span FROM k JOIN r a ON a.page = k.page AND a.e = k.y0 JOIN r b ON b.page = k.page AND b.e = k.y1 JOIN r2 x ON x.page = k.page AND x.e = k.x0 JOIN r2 y ON y.page = k.page AND y.e = k.x1")
def cell_spans(spark, d):
    """Rows, columns and spans of boxes on the grid of their edges."""
    return pages.cell_spans(_boxes(spark, d).select("page", "id", "x0", "y0", "x1", "y1"), ["page"]).select("page", "id", "row", "col", "row_span", "col_span")


@query()
def table_quality(spark, d):
    """Grades of the drawing of tables."""
    made, drawings, _, _ = _elements(spark, d)
    tables = made.select("page", F.lit(1).alias("id"), F.lit(40.0).alias("x0"), F.lit(40.0).alias("y0"), F.lit(560.0).alias("x1"), F.lit(660.0).alias("y1"))
    return pages.table_quality(tables, _lines(spark, d), drawings.withColumn("slanted", F.col("lines") % 2), ["page"])


@query(f"WITH {_ELEMENTS}, o AS (SELECT page, id, text, (y0 + y1) / 2 AS m, x0, x1 FROM (SELECT *, page * 10 + n AS id FROM b)), t AS (SELECT page, max(y1) AS y1, 0.0::DOUBLE AS x0, 640.0::DOUBLE AS x1 FROM d GROUP BY page) SELECT o.page, count(*) AS lines FROM o JOIN t ON t.page = o.page AND o.m BETWEEN t.y1 AND t.y1 + 30 AND o.x0 >= t.x0 - 10 AND o.x1 <= t.x1 + 10 GROUP BY o.page")
def table_annotations(spark, d):
    """Lines of text right below tables."""
    _, drawings, blocks, _ = _elements(spark, d)
    tables = drawings.groupBy("page").agg(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(640.0).alias("x1"), F.max("y1").alias("y1")).withColumn("id", F.lit(1))
    return pages.annotations(tables, blocks.select("page", "text", "x0", "y0", "x1", "y1"), ["page"]).groupBy("page").agg(F.count("*").alias("lines"))


_BELOW = "CASE meta_id % 5 WHEN 0 THEN '* ' WHEN 1 THEN ' ※' WHEN 2 THEN '(' WHEN 3 THEN 'Source: ' ELSE '' END || coalesce(title, '') || CASE meta_id % 5 WHEN 2 THEN ') ' ELSE '' END"


@query(rf"WITH l AS (SELECT meta_id, ingested_at, trim({_BELOW}) AS t FROM doc_metadata) SELECT meta_id, ingested_at, CASE WHEN regexp_matches(t, '^(\*|※|주)') THEN 'footnote' WHEN regexp_matches(t, '(?s)^\(.*\)$') THEN 'subheader' WHEN regexp_matches(t, '^(출처|자료|Source|Note)') THEN 'source' ELSE 'annotation' END AS kind FROM l")
def annotation_kinds(spark, d):
    """What lines below tables are."""
    k, title = F.col("meta_id") % 5, F.coalesce("title", F.lit(""))
    line = F.concat(F.when(k == 0, "* ").when(k == 1, " ※").when(k == 2, "(").when(k == 3, "Source: ").otherwise(""), title, F.when(k == 2, ") ").otherwise(""))
    return read(spark, d, "doc_metadata").select("meta_id", "ingested_at", pages.annotation_kind(line).alias("kind"))


@query()
def graphic_regions(spark, d):
    """Groups of drawings and whether they are graphics."""
    _, drawings, _, _ = _elements(spark, d)
    found = pages.graphics(drawings.withColumns({"x1": F.col("x0") + 6, "y1": F.col("y0") + 6}), ["page"])
    return found.withColumn("score", pages.graphic_score(F.lit(WIDTH), F.lit(HEIGHT)))


@query(f"WITH {_ELEMENTS}, w AS (SELECT page, CASE WHEN n = 1 THEN 10 ELSE x0 END AS x0, CASE WHEN n = 2 THEN 20 ELSE y0 END AS y0, CASE WHEN n = 1 THEN 600 ELSE x0 + 3 END AS x1, CASE WHEN n = 2 THEN 760 ELSE y0 + 3 END AS y1 FROM d), f AS (SELECT page, max((x1 - x0 >= 544 AND y1 - y0 <= 10 AND y0 < 78)::INT) = 1 AS top, max((x1 - x0 >= 544 AND y1 - y0 <= 10 AND y0 >= 78 AND y1 > 702)::INT) = 1 AS bottom, max((y1 - y0 >= 663 AND x1 - x0 <= 10 AND x0 < 64)::INT) = 1 AS \"left\", max((y1 - y0 >= 663 AND x1 - x0 <= 10 AND x0 >= 64 AND x1 > 576)::INT) = 1 AS \"right\" FROM w GROUP BY page) SELECT * FROM f WHERE top OR bottom OR \"left\" OR \"right\"")
def page_borders(spark, d):
    """Sides of pages that a line runs along."""
    made, drawings, _, _ = _elements(spark, d)
    c = F.col
    first, second = c("n") == 1, c("n") == 2
    stretched = drawings.select("page", F.when(first, 10.0).otherwise(c("x0")).alias("x0"), F.when(second, 20.0).otherwise(c("y0")).alias("y0"), F.when(first, 600.0).otherwise(c("x0") + 3).alias("x1"), F.when(second, 760.0).otherwise(c("y0") + 3).alias("y1"))
    return pages.page_borders(made, stretched, ["page"])


@query()
def layout_blocks(spark, d):
    """Blocks of pages in the order of reading."""
    made, drawings, blocks, images = _elements(spark, d)
    return pages.layout_blocks(made, blocks, images, drawings, ["page"])
