import csv
import io
import random

from docloom.operators import csv_rows as C

SIGNATURE = "INT!,STRING?,DOUBLE?,DECIMAL?,DATE?"


def outcome(record, encoding="utf-8", sign=",", first=False, header=False, signature=SIGNATURE):
    codes, _, _ = C.outcomes([record], [first], [header], [encoding], [signature])
    return codes[0, C.DELIMITERS.index(sign.encode())]


def test_reasons():
    ok = b'1,"a, ""b""", 2.5e3 ,"1,234.50",2024-02-29'
    assert outcome(ok) == C.OK
    assert outcome(b"1,\xff,1,1,2024-01-01") == C.ENCODING
    assert outcome(b'1,a"b,1,1,2024-01-01') == outcome(b'1,"ab,1,1,2024-01-01') == outcome(b'1,"a"b,1,1,2024-01-01') == C.QUOTING
    assert outcome(b"1,a,1,1") == outcome(b"") == outcome(b"1,a,1,1,2024-01-01,") == C.COLUMNS
    for bad in (b"x,a,1,1,2024-01-01", b",a,1,1,2024-01-01", b"1,a,1,1,2023-02-29", b"1,a,1,1.,2024-01-01", b"2147483648,a,1,1,2024-01-01", b"1,a,1e,1,2024-01-01"):
        assert outcome(bad) == C.VALUE, bad
    assert outcome(b"+1,,,,") == C.OK and outcome("1,,,₩1,234,".encode().replace(b"1,234", b"1234")) == C.OK
    assert outcome(b"\xef\xbb\xbf1,a,1,5%,2024-01-01", first=True) == C.OK
    assert outcome(b"\xef\xbb\xbf1,a,1,5%,2024-01-01") == C.VALUE
    assert outcome(b"a,b,c,d,e", header=True) == C.HEADER


def test_index_against_the_csv_module():
    r = random.Random(3)
    signature = ",".join(["STRING?"] * 3)
    for _ in range(400):
        fields = ["".join(r.choice('ab",;\n x') for _ in range(r.randint(0, 6))) for _ in range(3)]
        text = io.StringIO()
        csv.writer(text, delimiter=";", lineterminator="").writerow(fields)
        codes, right, values = C.outcomes([text.getvalue().encode()], [False], [False], ["utf8"], [signature], [2], True)
        assert codes[0, 2] == C.OK and values[0] == [f.strip(" ") or None for f in fields]


def test_whole_tables(spark):
    meta = spark.createDataFrame([(1, 1, None, "Yes", None), (2, 1, "cp949", "No", None)], "csv_id long, schema_id int, encoding string, has_header string, extracted_at timestamp")
    schemas = spark.createDataFrame([(1, 0, "a", "INT", False), (1, 1, "b", "STRING", True)], "schema_id int, col_index int, col_name string, col_type string, nullable boolean")
    records = [(1, 1, 1, b"\xef\xbb\xbfa;b"), (2, 1, 2, b"1;x"), (3, 1, 3, b"x;x"), (3, 1, 3, b"x;x"), (4, 1, 4, b"1;x;y"), (5, 2, 1, "1|가".encode("cp949")), (6, 2, 2, b"1|\xff"), (7, 9, 1, b"1;2"), (8, 2, 3, None), (9, None, 1, b"1")]
    df = spark.createDataFrame(records, "record_id long, csv_id long, record_no int, raw_record binary").selectExpr("*", "1 AS delimiter_no", "'x' AS outcome")
    got = {r.record_id: r.reason for r in C.rejects(df, meta, schemas).collect()}
    assert got == {3: "value", 4: "columns", 6: "encoding", 7: "columns", 8: "encoding", 9: "columns"}
    rows = {r.record_id: (r.delimiter, r["values"]) for r in C.rows(df, meta, schemas).collect()}
    assert rows == {2: (";", ["1", "x"]), 5: ("|", ["1", "가"])}
    typed = C.typed(C.rows(df, meta, schemas), [("a", "INT"), ("b", "STRING")], 1)
    assert sorted((r.a, r.b) for r in typed.collect()) == [(1, "x"), (1, "가")]
    assert C.rejects(df.limit(0), meta, schemas).count() == 0


def test_a_table_is_sent_only_if_it_is_small(spark):
    from docloom.tables import sent

    small, other = spark.range(10), spark.range(1000)
    plans = [other.join(sent(small, most), "id")._jdf.queryExecution().executedPlan().toString() for most in (10, 9)]
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]
