"""Queries of structure, tables, layout and deduplication, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import tags
from docloom.operators import csv_rows, layout, structure, tables
from docloom.plans.basics import WS
from docloom.tables import read, read_wide

CATALOG: dict = {}


def query(sql: str | None = None):
    def keep(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return keep


_PAGE = r"\[Page Number: \d+(?:\s*\(OCR(?:\+Ref)?\))?\]"
_SLIDE = r"\[Slide Number: \d+(?:\s*\(OCR(?:\+Ref)?\))?\]"
_SHEET = r"\[Sheet: .+?\]"


def _sections_sql(regex: str, group: str) -> str:
    return rf"""WITH p AS (SELECT text_id, regexp_split_to_array(text, '{regex}') AS b, regexp_extract_all(text, '{group}', 1) AS l FROM extracted_texts WHERE text IS NOT NULL),
 n AS (SELECT text_id, b, l, unnest(range(0, len(b))) AS no FROM p)
 SELECT text_id, no::INT AS no, CASE WHEN no > 0 THEN l[no] END AS label, regexp_replace(b[no + 1], '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS body FROM n WHERE regexp_replace(b[no + 1], '^[\s\x0B]+|[\s\x0B]+$', '', 'g') <> ''"""


@query(_sections_sql(_PAGE, r"\[Page Number: (\d+)(?:\s*\(OCR(?:\+Ref)?\))?\]"))
def page_split(spark, d):
    """Texts cut into pages, those with nothing but a mark dropped."""
    return structure.sections(read(spark, d, "extracted_texts"), "text_id", "text", "page")


@query(_sections_sql(_SLIDE, r"\[Slide Number: (\d+)(?:\s*\(OCR(?:\+Ref)?\))?\]"))
def slide_split(spark, d):
    """Texts cut into slides."""
    return structure.sections(read(spark, d, "extracted_texts"), "text_id", "text", "slide")


@query(_sections_sql(_SHEET, r"\[Sheet: (.+?)\]"))
def sheet_split(spark, d):
    """Texts cut into sheets."""
    return structure.sections(read(spark, d, "extracted_texts"), "text_id", "text", "sheet")


@query(
    "WITH pages AS (" + _sections_sql(_PAGE, r"\[Page Number: (\d+)(?:\s*\(OCR(?:\+Ref)?\))?\]") + """),
 o AS (SELECT text_id, list(body ORDER BY no) AS bodies FROM pages GROUP BY text_id),
 f AS (SELECT text_id, list_reduce(list_transform(bodies, lambda b: {'done': []::VARCHAR[], 'held': b, 'size': length(b)::BIGINT, 'carry': '', 'is_open': true}), lambda a, x: CASE
   WHEN NOT a.is_open THEN {'done': a.done, 'held': CASE WHEN a.carry = '' THEN x.held ELSE a.carry || E'\\n\\n' || x.held END, 'size': length(CASE WHEN a.carry = '' THEN x.held ELSE a.carry || E'\\n\\n' || x.held END)::BIGINT, 'carry': '', 'is_open': true}
   WHEN a.size + 4 + length(x.held) <= 1000 THEN {'done': a.done, 'held': a.held || E'\\n\\n' || x.held, 'size': a.size + 4 + length(x.held), 'carry': '', 'is_open': true}
   WHEN a.size + 4 + length(x.held) <= 1500 THEN {'done': list_append(a.done, a.held || E'\\n\\n' || x.held), 'held': '', 'size': 0::BIGINT, 'carry': right(x.held, 100), 'is_open': false}
   ELSE {'done': list_append(a.done, a.held), 'held': x.held, 'size': length(x.held)::BIGINT, 'carry': '', 'is_open': true} END) AS r FROM o)
 SELECT text_id, CASE WHEN r.is_open THEN list_append(r.done, r.held) ELSE r.done END AS chunks FROM f"""
)
def page_merge_greedy(spark, d):
    """Pages put together greedily within a size, with an overlap after a chunk that ran over."""
    return structure.merged_pages(page_split(spark, d), "text_id", 1000, 100)


@query(rf"""WITH t AS (SELECT text_id, text, lower(file_extension) AS ext FROM extracted_texts LEFT JOIN (SELECT file_id, min(file_extension) AS file_extension FROM file_contexts GROUP BY file_id) USING (file_id))
SELECT text_id, CASE WHEN text IS NULL OR regexp_replace(text, '{WS}+', '', 'g') = '' THEN NULL WHEN ext IN ('csv', 'tsv', 'xlsx', 'xls') THEN 'table' WHEN contains(text, '[Page Number: ') OR contains(text, '[Slide Number: ') THEN 'page'
 WHEN contains(text, '<table') OR contains(text, '[chart]') OR contains(text, '[textbox]') OR contains(text, '[Image:') OR contains(text, '[Document-Metadata]') THEN 'protected' ELSE 'plain' END AS strategy FROM t""")
def route_strategy(spark, d):
    """How each text is chunked."""
    files = read(spark, d, "file_contexts").groupBy("file_id").agg(F.min("file_extension").alias("file_extension"))
    return read(spark, d, "extracted_texts").join(files, "file_id", "left").select("text_id", structure.strategy(F.col("text"), F.col("file_extension")).alias("strategy"))


_REGIONS_SQL = " UNION ALL ".join(
    rf"""SELECT text_id, '{kind}' AS kind, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS s, length(m[i])::INT AS n
 FROM (SELECT text_id, regexp_split_to_array(text, '{regex}') AS p, regexp_extract_all(text, '{regex}') AS m, unnest(range(1, len(regexp_extract_all(text, '{regex}')) + 1)) AS i FROM extracted_texts WHERE text IS NOT NULL)"""
    for kind, regex in structure.REGIONS.items()
)


@query(f"SELECT text_id, kind, s, s + n AS e FROM ({_REGIONS_SQL})")
def protected_regions(spark, d):
    """Regions of texts that are kept whole."""
    return structure.regions(read_wide(spark, d, "extracted_texts"), "text_id", "text")


@query(f"""WITH r AS (SELECT text_id, kind, s - 150 AS s, s + n + 150 AS e FROM ({_REGIONS_SQL})), f AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY text_id ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
 i AS (SELECT *, sum(new) OVER (PARTITION BY text_id ORDER BY s, e, kind ROWS UNBOUNDED PRECEDING) AS island FROM f)
 SELECT text_id, min(s) AS s, max(e) AS e, array_to_string(list_sort(list(DISTINCT kind)), '+') AS kinds FROM i GROUP BY text_id, island""")
def region_merge(spark, d):
    """Regions with some room around them, overlapping ones merged."""
    wide = protected_regions(spark, d).withColumns({"s": F.col("s") - 150, "e": F.col("e") + 150})
    return structure.merged_regions(wide, "text_id")


@query(f"""WITH r AS (SELECT text_id, kind, s, s + n AS e FROM ({_REGIONS_SQL})) SELECT text_id, kind, s, e FROM r a WHERE kind <> 'table' AND NOT EXISTS (SELECT 1 FROM r b WHERE b.kind = 'table' AND b.text_id = a.text_id AND b.s <= a.e AND a.s <= b.e)""")
def region_uncovered(spark, d):
    """Regions outside of every table."""
    r = protected_regions(spark, d)
    t = r.where("kind = 'table'").select(F.col("text_id").alias("t_id"), F.col("s").alias("t_s"), F.col("e").alias("t_e"))
    return r.where("kind <> 'table'").join(t, (F.col("text_id") == F.col("t_id")) & (F.col("t_s") <= F.col("e")) & (F.col("s") <= F.col("t_e")), "left_anti")


_CHUNKS = """c AS (SELECT text_id, unnest(range(0, (length(text) + 399) // 400)) AS no, text FROM extracted_texts WHERE length(text) > 0), chunks AS (SELECT text_id, no::INT AS no, substring(text, (no * 400 + 1)::INT, 400) AS chunk FROM c)"""


def _chunks(spark, d):
    """Whole texts in pieces of 400 signs, for what follows chunks in order."""
    t = read(spark, d, "extracted_texts").where(F.length("text") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 400).cast("int")), lambda i: F.substring("text", i * 400 + 1, F.lit(400)))
    return t.select("text_id", F.posexplode(pieces).alias("no", "chunk"))


@query(f"WITH {_CHUNKS} SELECT text_id, no, (sum(length(chunk)) OVER w - length(chunk))::BIGINT AS starts, (sum(length(chunk)) OVER w)::BIGINT AS ends FROM chunks WINDOW w AS (PARTITION BY text_id ORDER BY no ROWS UNBOUNDED PRECEDING)")
def chunk_offsets(spark, d):
    """Offsets of chunks as running sums of their lengths."""
    return structure.offsets_of(_chunks(spark, d), "text_id", "no", "chunk").select("text_id", "no", "starts", "ends")


def _in_force_sql(tag: str, value: str) -> str:
    return rf"""WITH {_CHUNKS}, v AS (SELECT text_id, no, regexp_extract_all(chunk, '{value}', 1) AS v, regexp_matches(chunk, '^\s*{tag}') AS own FROM chunks)
 SELECT text_id, no, coalesce(CASE WHEN own THEN v[1] END, last_value(CASE WHEN len(v) > 0 THEN v[-1] END IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS label FROM v"""


@query(_in_force_sql(_PAGE, r"\[Page Number: (\d+)(?:\s*\(OCR(?:\+Ref)?\))?\]"))
def enrich_page(spark, d):
    """The page in force at each chunk."""
    return structure.in_force(_chunks(spark, d), "text_id", "no", "chunk", "page").select("text_id", "no", "label")


@query(_in_force_sql(_SHEET, r"\[Sheet: (.+?)\]"))
def enrich_sheet(spark, d):
    """The sheet in force at each chunk."""
    return structure.in_force(_chunks(spark, d), "text_id", "no", "chunk", "sheet").select("text_id", "no", "label")


_LEVELS = ", ".join(f"max(CASE WHEN lvl = {k} THEN {{'no': no, 'title': title}} END) OVER w AS h{k}" for k in range(1, 7))
_PATH = ", ".join(f"CASE WHEN h{k}.no > greatest(-1{''.join(f', coalesce(h{j}.no, -1)' for j in range(1, k))}) THEN h{k}.title END" for k in range(1, 7))


@query(rf"""WITH s AS (SELECT text_id, string_split(replace(text, E'\r', ''), E'\n') AS l FROM extracted_texts WHERE text IS NOT NULL), n AS (SELECT text_id, l, unnest(range(0, len(l))) AS no FROM s),
 x AS (SELECT text_id, no::INT AS no, length(regexp_extract(l[no + 1], '^(#{{1,6}})\s+\S', 1)) AS lvl, regexp_extract(l[no + 1], '^#{{1,6}}\s+(.*?)\s*#*\s*$', 1) AS title FROM n), h AS (SELECT text_id, no, {_LEVELS} FROM x WINDOW w AS (PARTITION BY text_id ORDER BY no ROWS UNBOUNDED PRECEDING))
 SELECT text_id, no, concat_ws(' > ', {_PATH}) AS path FROM h""")
def enrich_heading_path(spark, d):
    """The headings in force at each line."""
    t = read(spark, d, "extracted_texts").where(F.col("text").isNotNull())
    lines = t.select("text_id", F.posexplode(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n", -1)).alias("no", "line"))
    return structure.heading_paths(lines, "text_id", "no", "line").select("text_id", "no", "path")


@query(r"""WITH l AS (SELECT text_id, list_filter(string_split(text, E'\n'), lambda x: regexp_matches(x, '[^\s\x0B]')) AS l FROM extracted_texts WHERE text IS NOT NULL),
 f AS (SELECT text_id, list_reduce(list_transform(l, lambda x: {'done': []::VARCHAR[], 'held': x}), lambda a, x: CASE WHEN length(a.held || E'\n' || x.held) <= 500 THEN {'done': a.done, 'held': a.held || E'\n' || x.held} ELSE {'done': list_append(a.done, a.held), 'held': x.held} END) AS r FROM l WHERE len(l) > 0),
 c AS (SELECT text_id, list_append(r.done, r.held) AS c FROM f), n AS (SELECT text_id, c, unnest(range(0, len(c))) AS no FROM c) SELECT text_id, no::INT AS no, c[no + 1] AS chunk FROM n""")
def line_pack_chunks(spark, d):
    """Lines put together greedily up to a size."""
    return structure.packed_lines(read(spark, d, "extracted_texts"), "text_id", "text", 500)


@query("""SELECT lang, count(*) AS documents, count(text) AS texts, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest, sum(length(text) - length(replace(text, E'\\n', '')) + 1)::BIGINT AS lines FROM documents GROUP BY lang""")
def chunk_stats_by_lang(spark, d):
    """Sizes of texts by language."""
    t = F.col("text")
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count(t).alias("texts"), F.sum(F.length(t)).alias("chars"), F.max(F.length(t)).cast("long").alias("longest"), F.sum(lines).alias("lines"))


# HTML that patterns can express


@query(r"SELECT html_id, ingested_at, regexp_extract(html_text, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html_text, '(?is)<h[1-6][^>]*>')) AS headings FROM html_converted")
def html_title(spark, d):
    """Title and number of headings of each page."""
    t = F.col("html_text")
    return read(spark, d, "html_converted").select("html_id", "ingested_at", F.regexp_extract(t, "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.when(t.isNotNull(), F.size(F.regexp_extract_all(t, F.lit("(?is)<h[1-6][^>]*>"), F.lit(0)))).cast("long").alias("headings"))


@query(r"SELECT html_id, unnest(regexp_extract_all(html_text, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2)) AS heading FROM html_converted")
def html_headings(spark, d):
    """Every heading of every page."""
    return read(spark, d, "html_converted").select("html_id", F.explode(F.regexp_extract_all("html_text", F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(2))).alias("heading"))


@query(r"""WITH l AS (SELECT html_id, regexp_extract_all(html_text, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html_text, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM html_converted), n AS (SELECT html_id, h, t, unnest(range(1, len(h) + 1)) AS i FROM l)
SELECT html_id, h[i] AS href, CASE WHEN starts_with(h[i], '#') OR starts_with(lower(h[i]), 'javascript:') THEN t[i] ELSE '[' || t[i] || '](' || h[i] || ')' END AS rendered FROM n""")
def html_links(spark, d):
    """Links as Markdown; those within the page as bare text."""
    regex = F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all("html_text", regex, F.lit(1)).alias("h"), F.regexp_extract_all("html_text", regex, F.lit(2)).alias("t"))
    h, t = F.col("x.h"), F.col("x.t")
    bare = h.startswith("#") | F.lower(h).startswith("javascript:")
    return read(spark, d, "html_converted").select("html_id", F.explode(pairs).alias("x")).select("html_id", h.alias("href"), F.when(bare, t).otherwise(F.concat(F.lit("["), t, F.lit("]("), h, F.lit(")"))).alias("rendered"))


@query(r"""WITH b AS (SELECT html_id, unnest(regexp_extract_all(html_text, '(?is)<ol[^>]*>(.*?)</ol>', 1)) AS b FROM html_converted), i AS (SELECT html_id, regexp_extract_all(b, '(?is)<li[^>]*>(.*?)</li>', 1) AS i FROM b), n AS (SELECT html_id, i, unnest(range(1, len(i) + 1)) AS k FROM i)
SELECT html_id, k || '. ' || i[k] AS item FROM n""")
def html_list_items(spark, d):
    """Items of ordered lists with their numbers."""
    lists = read(spark, d, "html_converted").select("html_id", F.explode(F.regexp_extract_all("html_text", F.lit(r"(?is)<ol[^>]*>(.*?)</ol>"), F.lit(1))).alias("b"))
    items = lists.select("html_id", F.posexplode(F.regexp_extract_all("b", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("k", "i"))
    return items.select("html_id", F.concat((F.col("k") + 1).cast("string"), F.lit(". "), F.col("i")).alias("item"))


@query(r"SELECT html_id, ingested_at, regexp_replace(regexp_replace(html_text, '(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS stripped FROM html_converted")
def html_strip_script_style(spark, d):
    """Pages without scripts, styles and comments."""
    bare = F.regexp_replace("html_text", r"(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>", "")
    return read(spark, d, "html_converted").select("html_id", "ingested_at", F.regexp_replace(bare, r"(?s)<!--.*?-->", "").alias("stripped"))


# tables


@query(r"""WITH t AS (SELECT text_id, unnest(regexp_extract_all(text, '(?is)<table[^>]*>.*?</table>')) AS t FROM extracted_texts), r AS (SELECT text_id, unnest(regexp_extract_all(t, '(?is)<tr[^>]*>.*?</tr>')) AS r FROM t)
SELECT text_id, list_transform(regexp_extract_all(r, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1), lambda c: trim(regexp_replace(c, '<[^>]*>', '', 'g'))) AS cells, regexp_matches(r, '(?i)<th[^>]*>') AS header FROM r""")
def table_html_rows(spark, d):
    """Rows of HTML tables in texts."""
    found = read(spark, d, "extracted_texts").select("text_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)<table[^>]*>.*?</table>"), F.lit(0))).alias("t"))
    return found.select("text_id", F.explode(tables.html_rows(F.col("t"))).alias("r")).select("text_id", "r.cells", "r.header")


@query(r"""WITH t AS (SELECT text_id, unnest(regexp_extract_all(text, '(?is)<table[^>]*>.*?</table>')) AS t FROM extracted_texts), r AS (SELECT text_id, regexp_extract_all(t, '(?is)<tr[^>]*>.*?</tr>') AS r FROM t), b AS (SELECT text_id, r[1] AS header, r[2:] AS rows FROM r WHERE len(r) > 1),
 f AS (SELECT text_id, list_reduce(list_transform(rows, lambda x: {'done': []::VARCHAR[][], 'held': [x], 'n': length(x)::BIGINT, 'room': 240 - length(header)}), lambda a, x: CASE WHEN a.n + x.n > a.room THEN {'done': list_append(a.done, a.held), 'held': x.held, 'n': x.n, 'room': a.room} ELSE {'done': a.done, 'held': list_concat(a.held, x.held), 'n': a.n + x.n, 'room': a.room} END) AS z FROM b)
SELECT text_id, list_transform(list_append(z.done, z.held), lambda g: len(g)) AS parts FROM f""")
def table_row_pack(spark, d):
    """Rows of tables packed into parts with their header repeated."""
    found = read(spark, d, "extracted_texts").select("text_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)<table[^>]*>.*?</table>"), F.lit(0))).alias("t"))
    rows = found.select("text_id", F.regexp_extract_all("t", F.lit(tables.ROW), F.lit(0)).alias("r")).where(F.size("r") > 1)
    packed = rows.select("text_id", tables.packed_rows(F.slice("r", F.lit(2), F.size("r") - 1), F.get("r", F.lit(0)), 300).alias("g"))
    return packed.select("text_id", F.transform("g", lambda x: F.size(x).cast("long")).alias("parts"))


# delimited text: the lines are the star schema's rows under four delimiters


@query(r"""WITH l AS (SELECT s_suppkey % 4 AS file, concat_ws(CASE s_suppkey % 4 WHEN 0 THEN ',' WHEN 1 THEN E'\t' WHEN 2 THEN ';' ELSE '|' END, s_suppkey, s_name, s_nationkey, round(s_acctbal)::BIGINT) AS line FROM supplier), x AS (SELECT file, line, unnest([',', E'\t', ';', '|']) AS delimiter FROM l),
 c AS (SELECT file, delimiter, (length(line) - length(replace(line, delimiter, '')))::DOUBLE AS n FROM x), s AS (SELECT file, delimiter, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS spread FROM c GROUP BY ALL)
SELECT file, delimiter, mean, spread, CASE WHEN spread = 0 AND mean > 0 THEN mean * 10 ELSE mean - spread END AS score FROM s""")
def csv_delim_score(spark, d):
    """Scores of the delimiters of delimited lines."""
    key = F.col("s_suppkey") % 4
    fields = ["s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal").cast("long")]
    line = F.when(key == 0, F.concat_ws(",", *fields)).when(key == 1, F.concat_ws("\t", *fields)).when(key == 2, F.concat_ws(";", *fields)).otherwise(F.concat_ws("|", *fields))
    return tables.delimiter_scores(read(spark, d, "supplier").select(key.alias("file"), line.alias("line")), "file", "line")


@query()
def csv_header_detect(spark, d):
    """Whether files open with a header, by their first two records under their real delimiter and encoding; null
    where the first is missing, no header where there is one record alone."""
    parsed = csv_rows.first_rows(*(read(spark, d, t) for t in ("csv_records", "csv_metadata", "csv_schemas")))
    rows = parsed.groupBy("csv_id").agg(F.max(F.when(F.col("first"), F.col("cells"))).alias("a"), F.max(F.when(~F.col("first"), F.col("cells"))).alias("b"))
    header = F.when(F.col("a").isNotNull(), F.col("b").isNotNull() & F.coalesce(tables.has_header(F.col("a"), F.col("b")), F.lit(False)))
    return rows.select("csv_id", header.alias("header"))


_GRID = """grid AS (SELECT p_partkey % 50 AS t, (p_partkey // 50)::INT AS r, c AS c, CASE WHEN (p_partkey * 7 + c * 3) % 5 < 2 THEN '' ELSE p_brand || c END AS v FROM part, (SELECT unnest(range(0, 4))::INT AS c))"""


def _grid(spark, d):
    """A sparse grid of cells out of the parts."""
    c = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c")
    p = read(spark, d, "part").select((F.col("p_partkey") % 50).alias("t"), F.floor(F.col("p_partkey") / 50).cast("int").alias("r"), "p_partkey", "p_brand", c)
    return p.select("t", "r", "c", F.when((F.col("p_partkey") * 7 + F.col("c") * 3) % 5 < 2, "").otherwise(F.concat("p_brand", F.col("c").cast("string"))).alias("v"))


@query(f"WITH {_GRID}, o AS (SELECT *, sum((v <> '')::INT) OVER (PARTITION BY t, r ORDER BY c ROWS UNBOUNDED PRECEDING) AS o FROM grid) SELECT t, r, min(c) AS c, min_by(v, c) AS v, count(*) AS span FROM o WHERE o > 0 GROUP BY t, r, o")
def csv_colspan(spark, d):
    """Cells with the blank ones right of them."""
    return tables.horizontal_spans(_grid(spark, d), ["t"], "r", "c", "v")


@query(f"WITH {_GRID}, o AS (SELECT *, sum((v <> '')::INT) OVER (PARTITION BY t ORDER BY r ROWS UNBOUNDED PRECEDING) AS o FROM grid WHERE c = 0) SELECT t, min(r) AS r, min_by(v, r) AS v, count(*) AS span FROM o WHERE o > 0 GROUP BY t, o")
def csv_rowspan(spark, d):
    """Cells of the first column with the blank ones below them."""
    return tables.vertical_spans(_grid(spark, d), ["t"], "r", "c", "v")


@query(f"WITH {_GRID}, b AS (SELECT *, lag(v) OVER (PARTITION BY t, r ORDER BY c) AS left_v FROM grid) SELECT t, bool_or((c = 0 AND r > 0 AND v = '') OR (v = '' AND left_v <> '')) AS merged FROM b GROUP BY t")
def csv_has_merges(spark, d):
    """Whether a grid looks as if cells were merged."""
    left = F.lag("v").over(Window.partitionBy("t", "r").orderBy("c"))
    g = _grid(spark, d).withColumn("left_v", left)
    blank = F.col("v") == ""
    hit = ((F.col("c") == 0) & (F.col("r") > 0) & blank) | (blank & F.coalesce(F.col("left_v") != "", F.lit(False)))
    return g.groupBy("t").agg(F.bool_or(hit).alias("merged"))


# JSON, images, duplicates


@query("""SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS lines FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_paths(spark, d):
    """Leaves of flat objects as path and value."""
    pairs = F.transform(F.map_entries(F.from_json("props", "map<string,string>")), lambda x: F.concat(x["key"], F.lit(": "), x["value"]))
    return read(spark, d, "events").select("event_id", F.array_join(pairs, "\n").alias("lines")).where("lines IS NOT NULL AND lines <> ''")


_IMAGES = "i AS (SELECT doc_id, 'a [Image:img/' || group_code || '.png] b [Image: ' || coalesce(main_file, 'none') || ' ] c' AS t FROM documents)"


@query(rf"WITH {_IMAGES} SELECT doc_id, regexp_extract_all(t, '\[Image:\s*(.+?)\s*\]', 1) AS paths, regexp_replace(t, '\[Image:\s*(.+?)\s*\]', '[Figure:\1]', 'g') AS recognised FROM i")
def image_paths(spark, d):
    """Paths of image tags, and the tags replaced by what a recogniser said of them."""
    t = F.concat(F.lit("a [Image:img/"), F.col("group_code"), F.lit(".png] b [Image: "), F.coalesce("main_file", F.lit("none")), F.lit(" ] c"))
    return read(spark, d, "documents").select("doc_id", tags.values(t, "image").alias("paths"), F.regexp_replace(t, r"\[Image:\s*(.+?)\s*\]", "[Figure:$1]").alias("recognised"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_exact(spark, d):
    """Texts by their digest, with the first document and the number of copies."""
    return read(spark, d, "documents").where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("SELECT html_id, sha256(html_text) AS digest, first_value('[Image:' || html_id || ']') OVER (PARTITION BY file_id, html_text ORDER BY ingested_at, html_id) AS tag FROM html_converted WHERE html_text IS NOT NULL")
def dedup_first_tag(spark, d):
    """A repeated item gets the tag of its first."""
    window = Window.partitionBy("file_id", "digest").orderBy("ingested_at", "html_id")
    rows = read(spark, d, "html_converted").where(F.col("html_text").isNotNull()).withColumn("digest", F.sha2("html_text", 256))
    return rows.select("html_id", "digest", F.first(F.concat(F.lit("[Image:"), F.col("html_id").cast("string"), F.lit("]"))).over(window).alias("tag"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.version_no = 1 AND c.preprint_id = d.preprint_id)")
def cache_anti_join(spark, d):
    """Documents with no result kept yet under their key."""
    docs = read(spark, d, "documents")
    return docs.join(docs.where("version_no = 1").select("preprint_id").distinct(), "preprint_id", "left_anti").select("doc_id")


@query("SELECT file_id, max(ingested_at) AS ingested_at, count(*) AS deliveries, max_by(file_name, ingested_at) AS file_name FROM file_contexts GROUP BY file_id")
def file_latest(spark, d):
    """The last delivery of each file."""
    return read(spark, d, "file_contexts").groupBy("file_id").agg(F.max("ingested_at").alias("ingested_at"), F.count("*").alias("deliveries"), F.max_by("file_name", "ingested_at").alias("file_name"))


@query("SELECT doc_id, string_agg(body, E'\\n' ORDER BY include_id) AS included, count(*) AS n FROM tex_includes WHERE body IS NOT NULL GROUP BY doc_id")
def ordered_assembly(spark, d):
    """Included bodies put together in order."""
    parts = F.array_sort(F.collect_list(F.struct("include_id", "body")))
    return read(spark, d, "tex_includes").where(F.col("body").isNotNull()).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["body"]), "\n").alias("included"), F.count("*").alias("n"))


# gaps, boxes, cells


@query("""WITH j AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS sec FROM events), g AS (SELECT *, (sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) > 3600)::INT AS new FROM j), n AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT user_id, g::BIGINT AS group_no, min(sec) AS first_sec, max(sec) AS last_sec, count(*) AS events FROM n GROUP BY user_id, g""")
def gap_sessions(spark, d):
    """Events of a user grouped where the time between two is over an hour."""
    e = read(spark, d, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("sec"))
    return layout.gap_groups(e, ["user_id"], "sec", 3600).groupBy("user_id", F.col("group_no").cast("long").alias("group_no")).agg(F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"), F.count("*").alias("events"))


@query("""WITH j AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec FROM events), g AS (SELECT user_id, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) AS gap FROM j), l AS (SELECT user_id, list_sort(list(gap)) AS l FROM g WHERE gap IS NOT NULL GROUP BY user_id) SELECT user_id, l[len(l) // 2 + 1] AS median FROM l""")
def upper_median_gap(spark, d):
    """The upper median of the gaps between a user's events."""
    e = read(spark, d, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("sec"))
    gaps = e.withColumn("gap", F.col("sec") - F.lag("sec").over(Window.partitionBy("user_id").orderBy("sec"))).where("gap IS NOT NULL")
    return gaps.groupBy("user_id").agg(layout.upper_median(F.collect_list("gap")).alias("median"))


_BOXES = """boxes AS (SELECT l_orderkey // 100 AS page, l_orderkey * 10 + l_linenumber AS id, ((l_partkey * 37) % 500)::DOUBLE AS x0, ((l_suppkey * 53 + l_linenumber * 11) % 700)::DOUBLE AS y0, ((l_partkey * 37) % 500 + 40 + l_linenumber * 5)::DOUBLE AS x1, ((l_suppkey * 53 + l_linenumber * 11) % 700 + 20 + l_linenumber * 3)::DOUBLE AS y1, l_linenumber = 1 AS is_table, (l_partkey % 100)::DOUBLE AS score FROM lineitem)"""


def _boxes(spark, d):
    """Boxes on pages out of all order lines, as no table here holds boxes."""
    c = F.col
    x0, y0 = (c("l_partkey") * 37) % 500, (c("l_suppkey") * 53 + c("l_linenumber") * 11) % 700
    double = lambda e: e.cast("double")
    return read(spark, d, "lineitem").select(
        F.floor(c("l_orderkey") / 100).alias("page"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), double(x0).alias("x0"), double(y0).alias("y0"), double(x0 + 40 + c("l_linenumber") * 5).alias("x1"),
        double(y0 + 20 + c("l_linenumber") * 3).alias("y1"), (c("l_linenumber") == 1).alias("is_table"), double(c("l_partkey") % 100).alias("score"),
    )


_SHARE = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0))"


@query(f"WITH {_BOXES} SELECT a.page, a.id FROM boxes a WHERE NOT a.is_table AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.is_table AND b.page = a.page AND {_SHARE} >= 0.5)")
def bbox_text_outside_tables(spark, d):
    """Blocks of text outside of every table of their page."""
    b = _boxes(spark, d)
    return layout.outside(b.where(~F.col("is_table")), b.where("is_table"), ["page"]).select("page", "id")


@query(f"WITH {_BOXES} SELECT a.page, a.id, b.id AS table_id, {_SHARE} AS share FROM boxes a JOIN boxes b ON b.page = a.page AND b.is_table AND NOT a.is_table AND {_SHARE} > 0")
def bbox_overlap_join(spark, d):
    """Blocks of text and the tables they overlap."""
    b = _boxes(spark, d)
    a = b.where(~F.col("is_table")).select("page", "id", *(F.col(x).alias(f"a_{x}") for x in ("x0", "y0", "x1", "y1")))
    t = b.where("is_table").select("page", F.col("id").alias("table_id"), *(F.col(x).alias(f"b_{x}") for x in ("x0", "y0", "x1", "y1")))
    return a.join(t, "page").withColumn("share", layout.overlap_share("a_", "b_")).where("share > 0").select("page", "id", "table_id", "share")


@query(f"WITH {_BOXES} SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY y0, x0, id) AS no FROM boxes")
def reading_order(spark, d):
    """Boxes of a page in the order of reading."""
    return layout.reading_order(_boxes(spark, d), ["page"]).select("page", "id", F.col("no").cast("long").alias("no"))


_CELLS = """cells AS (SELECT DISTINCT o_orderkey // 50 AS sheet, (h % 12)::INT AS r, (h // 12 % 9)::INT AS c FROM (SELECT o_orderkey, (o_custkey * 7919 + o_orderkey * 104729) % 1000003 AS h FROM orders))"""


def _cells(spark, d):
    """Cells on sheets out of all orders, fifty to a sheet, sparse as their places hang on a hash of customer and order."""
    h = (F.col("o_custkey") * 7919 + F.col("o_orderkey") * 104729) % 1000003
    return read(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 50).alias("sheet"), (h % 12).cast("int").alias("row"), (F.floor(h / 12) % 9).cast("int").alias("col")).distinct()


@query(f"WITH {_CELLS} SELECT sheet, min(r) AS row0, max(r) AS row1, min(c) AS col0, max(c) AS col1, count(*) AS cells FROM cells GROUP BY sheet")
def cells_bbox(spark, d):
    """The rectangle around the cells of a sheet."""
    return _cells(spark, d).groupBy("sheet").agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"), F.count("*").alias("cells"))


@query(f"""WITH RECURSIVE {_CELLS}, reach AS (SELECT sheet, r, c, r * 100 + c AS root FROM cells UNION SELECT n.sheet, n.r, n.c, a.root FROM reach a JOIN cells n ON n.sheet = a.sheet AND abs(n.r - a.r) + abs(n.c - a.c) = 1),
 l AS (SELECT sheet, r, c, min(root) AS root FROM reach GROUP BY ALL) SELECT sheet, min(r) AS row0, min(c) AS col0, max(r) AS row1, max(c) AS col1, count(*)::INT AS cells FROM l GROUP BY sheet, root""")
def regions_components(spark, d):
    """Rectangles around cells that touch."""
    return layout.cell_components(_cells(spark, d), ["sheet"]).drop("region")


@query()
def sheet_regions(spark, d):
    """Tables of sheets, by borders first."""
    cells = _cells(spark, d).select("sheet", (F.col("row") * 3 + 1).alias("row"), (F.col("col") * 2 + 1).alias("col"), ((F.col("row") + F.col("col")) % 3 == 0).alias("bordered"))
    right = cells.withColumn("col", F.col("col") + 1)
    return layout.sheet_regions(cells.unionByName(right), ["sheet"])


_RANGES = """r AS (SELECT o_custkey // 20 AS sheet, o_orderkey AS id, (o_orderkey * 7 % 40)::INT AS row0, (o_orderkey * 7 % 40 + o_custkey % 5)::INT AS row1, (o_orderkey * 11 % 30)::INT AS col0, (o_orderkey * 11 % 30 + o_orderkey % 4)::INT AS col1 FROM orders)"""


@query(f"""WITH {_RANGES} SELECT a.sheet, a.id AS id_a, b.id AS id_b, greatest(0, greatest(a.row0, b.row0) - least(a.row1, b.row1) - 1) <= 1 AND greatest(0, greatest(a.col0, b.col0) - least(a.col1, b.col1) - 1) <= 1 AS adjacent,
 NOT (a.row1 < b.row0 OR b.row1 < a.row0 OR a.col1 < b.col0 OR b.col1 < a.col0) AS overlap, b.row0 BETWEEN a.row0 AND a.row1 AND b.col0 BETWEEN a.col0 AND a.col1 AS holds, (greatest(a.row1, b.row1) - least(a.row0, b.row0) + 1) * (greatest(a.col1, b.col1) - least(a.col0, b.col0) + 1) AS around
 FROM r a JOIN r b ON a.sheet = b.sheet AND b.id = a.id + 1""")
def range_predicates(spark, d):
    """Ranges of cells held against the next of their sheet."""
    c = F.col
    ranges = read(spark, d, "orders").select(
        F.floor(c("o_custkey") / 20).alias("sheet"), c("o_orderkey").alias("id"), (c("o_orderkey") * 7 % 40).cast("int").alias("row0"), (c("o_orderkey") * 7 % 40 + c("o_custkey") % 5).cast("int").alias("row1"),
        (c("o_orderkey") * 11 % 30).cast("int").alias("col0"), (c("o_orderkey") * 11 % 30 + c("o_orderkey") % 4).cast("int").alias("col1"),
    )
    a = ranges.select("sheet", *(c(x).alias(f"a_{x}") for x in ranges.columns[1:]), (c("id") + 1).alias("id_b"))
    b = ranges.select("sheet", *(c(x).alias(f"b_{x}") for x in ranges.columns[1:]), c("id").alias("id_b"))
    row0, row1, col0, col1 = layout.merged_range("a_", "b_")
    return a.join(b, ["sheet", "id_b"]).select(
        "sheet", c("a_id").alias("id_a"), "id_b", layout.ranges_adjacent("a_", "b_").alias("adjacent"), layout.ranges_overlap("a_", "b_").alias("overlap"), layout.range_contains("a_", c("b_row0"), c("b_col0")).alias("holds"), ((row1 - row0 + 1) * (col1 - col0 + 1)).alias("around")
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber % 2 = 0) OR coalesce(nullif(l_returnflag, 'N') <> 'none', false) OR false AS bordered FROM lineitem")
def border_test(spark, d):
    """Whether cells have a border."""
    none, c = F.lit("none"), F.col
    sides = [F.when(c("l_linenumber") % 2 == 0, "thin").otherwise(none), F.when(c("l_returnflag") != "N", c("l_returnflag")), F.lit(None).cast("string"), none]
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", layout.has_border(*sides).alias("bordered"))
