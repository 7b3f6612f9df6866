"""Queries of text, formats, tags and rendering, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import formats, render, tags, text
from docloom.tables import read, read_wide

CATALOG: dict = {}
#: White space of Unicode, as a class for SQL; the SQL engine's own is ASCII.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^{WS}+|{WS}+$', '', 'g')"


def query(sql: str | None = None):
    def keep(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return keep


_BLANKS = r"regexp_replace(text, '\n\s*\n\s*\n+', E'\n\n', 'g')"


@query(f"SELECT doc_id, {_strip(_BLANKS)} AS clean FROM documents")
def text_clean(spark, d):
    """Plain cleaning of whole texts."""
    return read_wide(spark, d, "documents").select("doc_id", text.clean_plain(F.col("text")).alias("clean"))


@query(rf"SELECT text_id, replace(regexp_replace(text, '{WS}+$', ''), E'\t', '    ') AS clean FROM extracted_texts")
def text_clean_code(spark, d):
    """Cleaning that keeps indentation."""
    return read(spark, d, "extracted_texts").select("text_id", text.clean_code(F.col("text")).alias("clean"))


_ENDS = r"regexp_replace(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), '(?m)[ \t]+$', '', 'g')"


@query(f"SELECT text_id, {_strip(_ENDS)} AS clean FROM extracted_texts")
def text_normalize(spark, d):
    """The last normalisation of extracted text, on all texts; null stays null."""
    return read(spark, d, "extracted_texts").select("text_id", text.normalised(F.col("text")).alias("clean"))


@query("SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, E'\\n', '')) + 1 AS n_lines, n_chars = length(text) AS as_said FROM documents")
def text_props(spark, d):
    """Signs and lines of each text."""
    t = F.col("text")
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return read(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"), (F.col("n_chars") == F.length(t)).alias("as_said"))


_CASES = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts.split())}) THEN '{kind}'" for kind, exts in formats.CATEGORIES.items())


@query(f"WITH e AS (SELECT file_id, file_name, regexp_replace(lower(file_extension), '^\\.+', '') AS ext FROM file_contexts) SELECT file_id, CASE {_CASES} ELSE 'unknown' END AS category FROM e")
def category_of_ext(spark, d):
    """The category of each file by its extension."""
    return read(spark, d, "file_contexts").select("file_id", formats.category(F.col("file_extension")).alias("category"))


@query("SELECT file_id, lower(regexp_extract(regexp_replace(file_name, '^.*[/\\\\]', ''), '[^.].*?\\.([^.]+)$', 1)) AS ext FROM file_contexts")
def ext_of_name(spark, d):
    """The extension by file name."""
    return read(spark, d, "file_contexts").select("file_id", formats.extension(F.col("file_name")).alias("ext"))


_SIGNS = " ".join(f"WHEN starts_with(code, '{s}') THEN '{k}'" for s, k in formats.SIGNATURES)


@query(f"WITH c AS (SELECT file_id, hex(file_data)[1:24] AS code FROM file_contexts) SELECT file_id, CASE WHEN regexp_matches(code, '^52494646.{{8}}57454250') THEN 'webp' {_SIGNS} ELSE 'unknown' END AS format FROM c")
def format_sniff_magic(spark, d):
    """The format of each file by its first bytes."""
    return read(spark, d, "file_contexts").select("file_id", formats.signature(F.col("file_data")).alias("format"))


@query(f"WITH c AS (SELECT file_category, hex(file_data)[1:24] AS code FROM file_contexts) SELECT file_category, CASE WHEN regexp_matches(code, '^52494646.{{8}}57454250') THEN 'webp' {_SIGNS} ELSE 'unknown' END AS format, count(*) AS files FROM c GROUP BY ALL")
def format_by_category(spark, d):
    """How often heads of each format stand in files of each category."""
    return read(spark, d, "file_contexts").groupBy("file_category", formats.signature(F.col("file_data")).alias("format")).agg(F.count("*").alias("files"))


@query(r"""SELECT text_id, list_transform(regexp_extract_all(text, '\[Page Number: (\d+)(?:\s*\(OCR(?:\+Ref)?\))?\]', 1), lambda x: x::INT) AS pages,
 regexp_matches(text, '\[Slide Number: \d+(?:\s*\(OCR(?:\+Ref)?\))?\]') AS has_slides, regexp_extract_all(text, '\[Sheet: (.+?)\]', 1) AS sheets FROM extracted_texts WHERE text IS NOT NULL""")
def tag_find(spark, d):
    """Page numbers, sheets and whether there are slides, by their tags."""
    t = F.col("text")
    rows = read(spark, d, "extracted_texts").where(t.isNotNull())
    return rows.select("text_id", F.transform(tags.values(t, "page"), lambda x: x.cast("int")).alias("pages"), tags.has(t, "slide").alias("has_slides"), tags.values(t, "sheet").alias("sheets"))


@query(r"""SELECT text_id, regexp_replace(text, '\[Page Number: \d+(?:\s*\(OCR(?:\+Ref)?\))?\]', '', 'g') AS text FROM extracted_texts""")
def tag_remove(spark, d):
    """Texts without page tags."""
    return read(spark, d, "extracted_texts").select("text_id", tags.removed(F.col("text"), "page").alias("text"))


@query("SELECT doc_id, '[Page Number: ' || version_no || ']' AS page, '[Sheet: ' || group_code || ']' AS sheet, '[Image:' || main_file || ']' AS image FROM documents")
def tag_create(spark, d):
    """Tags written from columns."""
    return read(spark, d, "documents").select("doc_id", tags.tag("page", F.col("version_no")).alias("page"), tags.tag("sheet", F.col("group_code")).alias("sheet"), tags.tag("image", F.col("main_file")).alias("image"))


@query(r"""WITH m AS (SELECT text_id, regexp_extract_all(text, '\[Page Number: \d+(?:\s*\(OCR(?:\+Ref)?\))?\]') AS m, regexp_split_to_array(text, '\[Page Number: \d+(?:\s*\(OCR(?:\+Ref)?\))?\]') AS p FROM extracted_texts WHERE text IS NOT NULL),
n AS (SELECT text_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM m)
SELECT text_id, i::INT AS no, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS starts FROM n""")
def tag_offsets(spark, d):
    """Where each page tag starts."""
    found = tags.located(read(spark, d, "extracted_texts"), "text_id", "text", {"page": tags.pattern("page")})
    return found.select("text_id", (F.col("no") + 1).alias("no"), F.col("s").cast("long").alias("starts"))


_ROWS = "list_value(list_value('key', 'name', 'region'), list_value(n_nationkey::VARCHAR, n_name || ' | ' || r_name, r_name))"


def _nations(spark, d):
    """Small tables of cells: one for each nation, with a header."""
    joined = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.array(F.col("n_nationkey").cast("string"), F.concat_ws(" | ", "n_name", "r_name"), F.col("r_name"))
    return joined.select("n_nationkey", F.array(F.array(F.lit("key"), F.lit("name"), F.lit("region")), cells).alias("rows"))


@query("""SELECT n_nationkey, '<table border=''1''>' || E'\\n' || '  <tr>' || E'\\n' || '    <th>key</th>' || E'\\n' || '    <th>name</th>' || E'\\n' || '    <th>region</th>' || E'\\n' || '  </tr>' || E'\\n' || '  <tr>' || E'\\n' ||
 '    <td>' || n_nationkey || '</td>' || E'\\n' || '    <td>' || n_name || ' | ' || r_name || '</td>' || E'\\n' || '    <td>' || r_name || '</td>' || E'\\n' || '  </tr>' || E'\\n' || '</table>' AS html FROM nation JOIN region ON n_regionkey = r_regionkey""")
def table_to_html(spark, d):
    """Tables as HTML."""
    return _nations(spark, d).select("n_nationkey", render.html_table(F.col("rows")).alias("html"))


@query("""SELECT n_nationkey, '| key | name | region |' || E'\\n' || '| --- | --- | --- |' || E'\\n' || '| ' || n_nationkey || ' | ' || n_name || ' \\| ' || r_name || ' | ' || r_name || ' |' AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey""")
def table_to_markdown(spark, d):
    """Tables as Markdown, with bars in cells escaped."""
    return _nations(spark, d).select("n_nationkey", render.markdown_table(F.col("rows")).alias("markdown"))


@query("""SELECT n_nationkey, E'key\\tname\\tregion\\n' || n_nationkey || E'\\t' || n_name || ' | ' || r_name || E'\\t' || r_name AS plain FROM nation JOIN region ON n_regionkey = r_regionkey""")
def table_to_text(spark, d):
    """Tables as lines with tabs."""
    return _nations(spark, d).select("n_nationkey", render.text_table(F.col("rows")).alias("plain"))


def _block_sql(language: str) -> str:
    lines = ", ".join(f"CASE WHEN trim({f}::VARCHAR) <> '' THEN '  {label}: ' || trim({f}::VARCHAR) END" for f, label in render.LABELS[language].items())
    every = ", ".join(f"{f}::VARCHAR" for f in render.LABELS[language])
    return f"SELECT meta_id, ingested_at, CASE WHEN coalesce({every}) IS NULL THEN '' ELSE concat_ws(E'\\n', '[Document-Metadata]', {lines}, '[/Document-Metadata]') END AS block FROM doc_metadata"


@query(_block_sql("ko"))
def metadata_block_ko(spark, d):
    """Metadata as a block with Korean labels."""
    return read(spark, d, "doc_metadata").select("meta_id", "ingested_at", render.metadata_block("ko").alias("block"))


@query(_block_sql("en"))
def metadata_block_en(spark, d):
    """Metadata as a block with English labels."""
    return read(spark, d, "doc_metadata").select("meta_id", "ingested_at", render.metadata_block("en").alias("block"))


_MONTHS = """m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY ALL)"""


@query(f"""WITH {_MONTHS} SELECT o_orderpriority, '[chart]' || E'\\n' || 'Chart Type: ' || CASE WHEN o_orderpriority < '3' THEN 'Line Chart' ELSE 'Stock Chart' END || E'\\n' || 'Title: ' || o_orderpriority || E'\\n' || '<table>' || E'\\n' || '<tr><th>Category</th><th>orders</th><th>Series</th></tr>' || E'\\n'
 || string_agg('<tr><td>' || month || '</td><td>' || n || '</td><td>' || f || '</td></tr>', E'\\n' ORDER BY month) || E'\\n' || '</table>' || E'\\n' || '[/chart]' AS block, '[chart]' || E'\\n' || 'Title: ' || o_orderpriority || E'\\n' || string_agg(month || ': ' || n || ', ' || f, E'\\n' ORDER BY month) || E'\\n' || '[/chart]' AS plain FROM m GROUP BY o_orderpriority""")
def chart_block(spark, d):
    """Charts as text blocks: orders by month for each priority, as HTML and as lines."""
    months = read(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    points = months.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("month", F.col("n").cast("string").alias("n"), F.col("f").cast("string").alias("f")))).alias("p"))
    series = F.array(F.transform("p", lambda x: x["n"]), F.transform("p", lambda x: x["f"]))
    kind, title, labels = F.when(F.col("o_orderpriority") < "3", "lineChart").otherwise("stockChart"), F.col("o_orderpriority"), F.transform("p", lambda x: x["month"])
    none = F.lit(None).cast("string")
    return points.select("o_orderpriority", render.chart_block(kind, title, labels, F.array(F.lit("orders"), none), series).alias("block"), render.chart_block(none, title, labels, F.array(F.lit("orders"), none), series, as_html=False).alias("plain"))


@query("""SELECT meta_id, ingested_at, '[chart]' || E'\\n' || concat_ws(E'\\n', CASE WHEN meta_id % 3 = 0 THEN 'Chart Type: ' || CASE WHEN meta_id % 2 = 0 THEN 'Pie Chart' ELSE coalesce(nullif(handler_name, ''), 'x') END END, CASE WHEN title <> '' THEN 'Title: ' || title END,
 CASE WHEN subject <> '' THEN subject WHEN meta_id % 3 <> 0 AND coalesce(title, '') = '' THEN '(Chart data could not be extracted)' END) || E'\\n' || '[/chart]' AS block FROM doc_metadata""")
def chart_fallback(spark, d):
    """Blocks of charts that can't be read."""
    k = F.col("meta_id")
    kind = F.when(k % 3 == 0, F.when(k % 2 == 0, "pieChart").otherwise(F.when(F.coalesce("handler_name", F.lit("")) == "", "x").otherwise(F.col("handler_name"))))
    return read(spark, d, "doc_metadata").select("meta_id", "ingested_at", render.chart_fallback(kind, F.col("title"), F.col("subject")).alias("block"))


@query(r"""SELECT text_id, contains(text, '[chart]') AND regexp_matches(text, '(?s)\[chart\].*?\[/chart\]') AS has_charts, regexp_extract_all(text, '(?s)\[chart\](.*?)\[/chart\]', 1) AS charts FROM extracted_texts WHERE text IS NOT NULL""")
def chart_find(spark, d):
    """Chart blocks in texts."""
    t = F.col("text")
    return read(spark, d, "extracted_texts").where(t.isNotNull()).select("text_id", tags.has(t, "chart").alias("has_charts"), tags.values(t, "chart").alias("charts"))


@query(r"""SELECT p_partkey, p_size, regexp_matches(p_size::VARCHAR, '^-?[0-9]+$') AS is_number, chr(64 + (p_size % 26 = 0)::INT * 26 + (p_size % 26)::INT) AS last_letter,
 replace(replace(replace(p_name || ' <' || p_type || '> & ' || p_brand, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM part""")
def scalar_functions(spark, d):
    """Numeric text, letters of columns, escaping."""
    letters = text.column_letters(F.col("p_size"))
    return read(spark, d, "part").select(
        "p_partkey", "p_size", text.is_numeric(F.col("p_size").cast("string")).alias("is_number"), F.substring(letters, -1, 1).alias("last_letter"),
        text.escaped(F.concat(F.col("p_name"), F.lit(" <"), F.col("p_type"), F.lit("> & "), F.col("p_brand"))).alias("escaped"),
    )
