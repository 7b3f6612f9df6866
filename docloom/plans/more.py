"""Further relational computations with their SQL: numbering, clusters, continuation, positional joins, validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.plans.relational import _BOXES, _boxes
from docloom.tables import read

CATALOG: dict = {}


def query(sql: str | None = None):
    def keep(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return keep


def _roman_sql(n: str) -> str:
    parts, rest = [], n
    for value, sign in text.ROMAN:
        parts.append(f"repeat('{sign}', ({rest} // {value})::INT)")
        rest = f"({rest} % {value})"
    return " || ".join(parts)


@query(f"WITH n AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, n, {_roman_sql('n')} AS roman, {_roman_sql('(p_partkey % 3999 + 1)')} AS key_roman FROM n")
def numbering(spark, d):
    """Numbers within a group as Roman numerals."""
    n = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return read(spark, d, "part").withColumn("n", n.cast("long")).select("p_partkey", "n", text.roman(F.col("n")).alias("roman"), text.roman(F.col("p_partkey") % 3999 + 1).alias("key_roman"))


@query(f"WITH {_BOXES}, g AS (SELECT page, y0, (y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0) > 5)::INT AS new FROM boxes), c AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY page ORDER BY y0 RANGE UNBOUNDED PRECEDING) AS line FROM g) SELECT page, line::BIGINT AS line, count(*) AS boxes, min(y0) AS top, max(y0) AS bottom, round(avg(y0), 6) AS at FROM c GROUP BY page, line")
def cluster_1d(spark, d):
    """Lines of a page: boxes whose tops follow each other closely."""
    order = Window.partitionBy("page").orderBy("y0")
    jump = F.when(F.col("y0") - F.lag("y0").over(order) > 5, 1).otherwise(0)
    lined = _boxes(spark, d).select("page", "y0").withColumn("_new", jump).withColumn("line", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return lined.groupBy("page", "line").agg(F.count("*").alias("boxes"), F.min("y0").alias("top"), F.max("y0").alias("bottom"), F.round(F.avg("y0"), 6).alias("at"))


@query(f"WITH {_BOXES}, t AS (SELECT page, max_by(id, y1 * 1000000 + id) AS last_id, max(y1) AS bottom, min(y0) AS top, count(*) AS n FROM boxes WHERE is_table GROUP BY page), l AS (SELECT page, top, n, lag(page) OVER w AS before, lag(bottom) OVER w AS bottom, lag(n) OVER w AS pn FROM t WINDOW w AS (ORDER BY page)) SELECT page, coalesce(before = page - 1 AND bottom >= 0.7 * 750 AND top <= 0.3 * 750 AND abs(n - pn) <= 1, false) AS continued FROM l")
def table_continued(spark, d):
    """Whether the first table of a page continues the last of the page before; one row a page, few of them."""
    pages = _boxes(spark, d).where("is_table").groupBy("page").agg(F.max("y1").alias("bottom"), F.min("y0").alias("top"), F.count("*").alias("n"))
    before = pages.select((F.col("page") + 1).alias("page"), F.col("bottom").alias("b"), F.col("n").alias("pn"))
    hit = (F.col("b") >= 0.7 * 750) & (F.col("top") <= 0.3 * 750) & (F.abs(F.col("n") - F.col("pn")) <= 1)
    return pages.join(before, "page", "left").select("page", F.coalesce(hit, F.lit(False)).alias("continued"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey, o_orderkey AS other, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, n, o_orderkey, other FROM a FULL JOIN b USING (o_custkey, n)""")
def positional_join(spark, d):
    """The n-th of one kind with the n-th of the other, what is left over on either side kept."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("n")
    o = read(spark, d, "orders")
    a = o.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", n)
    b = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("other"), n)
    return a.join(b, ["o_custkey", "n"], "full").select("o_custkey", "n", "o_orderkey", "other")


@query("WITH l AS (SELECT *, (l_returnflag = 'R')::INT AS brk FROM lineitem) SELECT l_orderkey, l_linenumber, (1 + sum(brk) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING))::BIGINT AS page FROM l")
def page_by_breaks(spark, d):
    """Page numbers as running counts of breaks."""
    window = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (1 + F.sum((F.col("l_returnflag") == "R").cast("long")).over(window)).alias("page"))


@query("SELECT handler_name, count(*) AS records, count(DISTINCT file_id) AS files, count(title) AS titled, count(*) FILTER (page_count IS NOT NULL) AS paged, max(word_count) AS most_words FROM doc_metadata GROUP BY handler_name")
def metadata_by_handler(spark, d):
    """What handlers found, by handler."""
    return read(spark, d, "doc_metadata").groupBy("handler_name").agg(F.count("*").alias("records"), F.countDistinct("file_id").alias("files"), F.count("title").alias("titled"), F.count("page_count").alias("paged"), F.max("word_count").alias("most_words"))


@query("SELECT meta_id, ingested_at, title IS NULL AND subject IS NULL AND author IS NULL AND keywords IS NULL AND comments IS NULL AND last_saved_by IS NULL AND create_time IS NULL AND last_saved_time IS NULL AND page_count IS NULL AND word_count IS NULL AND category IS NULL AND revision IS NULL AS is_empty FROM doc_metadata")
def metadata_is_empty(spark, d):
    """Whether a record holds no field at all."""
    fields = ("title", "subject", "author", "keywords", "comments", "last_saved_by", "create_time", "last_saved_time", "page_count", "word_count", "category", "revision")
    return read(spark, d, "doc_metadata").select("meta_id", "ingested_at", F.coalesce(*(F.col(c).cast("string") for c in fields)).isNull().alias("is_empty"))


@query("WITH c AS (SELECT csv_id, list_transform(string_split(column_names, ', '), lambda x: trim(x)) AS c FROM csv_metadata WHERE column_names IS NOT NULL) SELECT csv_id, len(c) AS columns, array_to_string(c[1:3], ', ') || CASE WHEN len(c) > 3 THEN ' (+' || (len(c) - 3) || ' more)' ELSE '' END AS shown FROM c")
def csv_columns_shown(spark, d):
    """The first column names and how many more there are."""
    c = read(spark, d, "csv_metadata").where("column_names IS NOT NULL").select("csv_id", F.transform(F.split("column_names", ", "), lambda x: F.trim(x)).alias("c"))
    more = F.when(F.size("c") > 3, F.concat(F.lit(" (+"), (F.size("c") - 3).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return c.select("csv_id", F.size("c").cast("long").alias("columns"), F.concat(F.array_join(F.slice("c", 1, 3), ", "), more).alias("shown"))
