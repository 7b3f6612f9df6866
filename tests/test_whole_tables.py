"""Queries hold all rows of their tables, also those that their SQL leaves out."""

import re
from collections import defaultdict

import pytest

from docloom.plans import basics, more, relational


def lines():
    """Order lines below and above the last order that the SQL of boxes looks at; none is there twice."""
    return [(k, n, (k * 31 + n * 17) % 97, (k * 13 + n) % 23) for k in [*range(40, 60), *range(2990, 3030), *range(9000, 9040)] for n in range(1, 4)]


@pytest.fixture(scope="module")
def boxes(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("boxes"))
    spark.createDataFrame(lines(), "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    return d


def pages():
    """Page to boxes: id, x0, y0, x1, y1, whether a table, score."""
    out = defaultdict(list)
    for k, n, p, s in lines():
        x0, y0 = p * 37 % 500, (s * 53 + n * 11) % 700
        out[k // 100].append((k * 10 + n, x0, y0, x0 + 40 + n * 5, y0 + 20 + n * 3, n == 1, p % 100))
    return out


def shared(a, b):
    return max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))


def area(a):
    return (a[3] - a[1]) * (a[4] - a[2])


def test_boxes_of_all_orders_against_brute_force(spark, boxes):
    every = pages()
    assert {0, 29, 30, 90} <= set(every)
    rows = lambda f, *c: sorted(tuple(r[x] for x in c) for r in f(spark, boxes).collect())
    order = [(p, b[0], i) for p, bs in every.items() for i, b in enumerate(sorted(bs, key=lambda b: (b[2], b[1], b[0])), 1)]
    assert rows(relational.reading_order, "page", "id", "no") == sorted(order)
    pairs = [(p, a, t) for p, bs in every.items() for a in bs if not a[5] for t in bs if t[5]]
    hits = [(p, a[0], t[0], shared(a, t) / area(a)) for p, a, t in pairs if shared(a, t)]
    got = rows(relational.bbox_overlap_join, "page", "id", "table_id", "share")
    assert [g[:3] for g in got] == [h[:3] for h in sorted(hits)] and [g[3] for g in got] == pytest.approx([h[3] for h in sorted(hits)], rel=1e-12)
    covered = {(p, a[0]) for p, a, t in pairs if shared(a, t) >= 0.5 * area(a)}
    assert rows(relational.bbox_text_outside_tables, "page", "id") == sorted({(p, b[0]) for p, bs in every.items() for b in bs if not b[5]} - covered)


def test_pages_of_all_orders(spark, boxes):
    every = pages()
    for f in (more.table_continued,):
        assert sorted(r.page for r in f(spark, boxes).collect()) == sorted(every), f.__name__
    held = defaultdict(int)
    for r in more.cluster_1d(spark, boxes).collect():
        held[r.page] += r.boxes
    assert held == {p: len(bs) for p, bs in every.items()}


def test_normalises_texts_of_any_line_ends(spark, tmp_path):
    texts = ["a \t\r\nb  \n\n\n\nc \r", "a\r\n\r\n\r\n\r\nb", None, "", "a  \rb\t\n", " \r\n", "x  y \x85z \n", "a \n\n\n \n\nb", "no end "]
    spark.createDataFrame(list(enumerate(texts)), "text_id int, text string").write.parquet(f"{tmp_path}/extracted_texts.parquet")
    got = {r.text_id: r.clean for r in basics.text_normalize(spark, str(tmp_path)).collect()}
    python = lambda t: re.sub(r"[ \t]+$", "", re.sub("\n{3,}", "\n\n", t), flags=re.MULTILINE).strip()
    assert got == {i: None if t is None else python(t) for i, t in enumerate(texts)}


def test_headers_of_files_of_any_delimiter_and_encoding(spark, tmp_path):
    body = [("a", "1"), ("b", "2"), ("c", "3")]
    of = lambda d, head, e="utf-8": [d.join(x).encode(e) for x in (head, *body)]
    files = {
        1: ("Comma (,)", "utf-8", of(",", ("name", "n")), True), 2: ("Tab (\\t)", "utf-8", of("\t", ("name", "n")), True), 3: ("Pipe (|)", "utf-8", of("|", ("name", "n")), True), 4: (None, None, of(";", ("x", "4")), False),
        5: ("Semicolon (;)", "utf-8", of(",", ("name", "n")), True), 6: ("Comma (,)", "cp949", of(",", ("이름", "수"), "cp949"), True), 7: ("Comma (,)", "utf-8", [b'"na,me","n"', b'"a","1"', b'"b","2"'], True),
        8: ("Comma (,)", "utf-8", of(",", ("7", "n")), False), 9: ("Comma (,)", "no such", of(",", ("näme", "n")), True), 10: ("Comma (,)", "utf-8", [None, *of(",", ("a", "1"))], None), 11: ("Comma (,)", "utf-8", [b"name,n"], False),
        12: ("Comma (,)", "latin-1", of(",", ("né", "né"), "latin-1")[:1] + [b"a,b", b"c,d"], False),
    }
    records = [(100 * k + i, k, i, None if r is None else bytearray(r)) for k, (_, _, rs, _) in files.items() for i, r in enumerate(rs, 1)]
    spark.createDataFrame(records, "record_id long, csv_id long, record_no int, raw_record binary").write.parquet(f"{tmp_path}/csv_records.parquet")
    meta = [(k, 1, e, d, "No", None) for k, (d, e, _, _) in files.items()]
    spark.createDataFrame(meta, "csv_id long, schema_id int, encoding string, delimiter string, has_header string, extracted_at timestamp").write.parquet(f"{tmp_path}/csv_metadata.parquet")
    spark.createDataFrame([(1, 0, "STRING", True), (1, 1, "STRING", True)], "schema_id int, col_index int, col_type string, nullable boolean").write.parquet(f"{tmp_path}/csv_schemas.parquet")
    got = {r.csv_id: r.header for r in relational.csv_header_detect(spark, str(tmp_path)).collect()}
    assert got == {k: want for k, (*_, want) in files.items()}


def test_cells_of_all_orders_against_brute_force(spark, tmp_path):
    orders = [(k, k * k * 31 % 1501) for k in range(1000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    sheets = defaultdict(set)
    for k, c in orders:
        h = (c * 7919 + k * 104729) % 1000003
        sheets[k // 50].add((h % 12, h // 12 % 9))
    box = lambda cells: (min(r for r, _ in cells), max(r for r, _ in cells), min(c for _, c in cells), max(c for _, c in cells), len(cells))
    got = {r.sheet: (r.row0, r.row1, r.col0, r.col1, r.cells) for r in relational.cells_bbox(spark, str(tmp_path)).collect()}
    assert got == {s: box(cells) for s, cells in sheets.items()} and len(got) == 20
    want = []
    for s, cells in sheets.items():
        group = {x: {x} for x in cells}
        for r, c in cells:
            for near in ((r + 1, c), (r, c + 1)):
                if near in cells and group[near] is not group[r, c]:
                    group[r, c] |= group[near]
                    for x in group[near]:
                        group[x] = group[r, c]
        want += [(s, *box(g)) for g in {id(g): g for g in group.values()}.values()]
    rows = [(r.sheet, r.row0, r.row1, r.col0, r.col1, r.cells) for r in relational.regions_components(spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted(want) and len(want) > 60
    assert any(a < b and c == d for _, a, b, c, d, _ in rows) and {r for cells in sheets.values() for r, _ in cells} == set(range(12))
