import random
import re

import pytest

from docloom.llm import chunking as C


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(9)
    pieces = ["word ", "x" * 45, "\n\n", "\r\n", "\r\n\r\n", "\r", "\n", "[Page Number: 3]\n", "[Sheet: a b]", "é가😀 ", "\t", "end. "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 400))) for _ in range(60)] + [" " * 500, "y" * 900, "", None, "short"]
    rows = [(i, 1 + i % 3, t, "z") for i, t in enumerate(texts)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "text_id long, config_id int, text string, chunk_size string").drop("chunk_size")
    return texts, df, spark.createDataFrame([(1, 100, 20), (2, 64, 0), (3, 40, 40), (4, 0, 0)], "config_id int, chunk_size int, chunk_overlap int")


SIZES = {1: (100, 20), 2: (64, 0), 3: (40, 39)}


@pytest.mark.parametrize("range_size", [100, 257, C.RANGE])
def test_pieces(tables, range_size):
    texts, df, configs = tables
    got = {}
    for r in C.chunks(df, configs, range_size).collect():
        got.setdefault(r.text_id, []).append((r.chunk_no, r.start, r.end, r.cut, r.text))
    assert set(got) == {i for i, t in enumerate(texts) if t}
    for i, pieces in got.items():
        size, overlap = SIZES[1 + i % 3]
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(len(pieces))) and pieces[0][1] == 0 and pieces[-1][2] == len(texts[i])
        assert all(texts[i][a:b] == t and len(t) <= size for _, a, b, _, t in pieces)
        assert all(q[1] == p[2] - overlap for p, q in zip(pieces, pieces[1:]))
        for _, a, b, how, _ in pieces[:-1]:
            if how == "forced":
                assert b - a == size and not re.search(r"[ \t\r\n]", texts[i][a + overlap : b - 1])


def test_the_size_of_a_range_changes_nothing(tables):
    _, df, configs = tables
    assert sorted(map(tuple, C.chunks(df, configs, 101).collect())) == sorted(map(tuple, C.chunks(df, configs).collect()))


def test_oversized_against_brute_force(tables):
    texts, df, configs = tables
    want = {}
    for i, t in enumerate(texts):
        size = SIZES[1 + i % 3][0]
        if t and len(t) > size:
            want[i] = "forced" if max(map(len, re.split("[ \t\r\n]", t))) > size else "natural"
    for range_size in (64, 1000):
        rows = C.oversized(df, configs, range_size).collect()
        assert {r.text_id: r.kind for r in rows} == want and len(rows) == len(want)
    assert C.oversized(df.limit(0), configs).count() == 0


def layout(text, size, overlap):
    """Plain layout of one text with all of its boundaries at hand."""
    overlap = min(overlap, size - 1)
    found, _ = C.boundaries(text, 0, len(text))
    out, start = [], 0
    while len(text) - start > size:
        cut, how = start + size, "forced"
        middle = max(overlap, size // 2)
        for low, high in ((start + middle, start + size), (start + overlap, start + middle)):
            hits = [(n, p[(p > low) & (p <= high)]) for n, p in zip(C.NAMES, found)]
            if best := next(((int(p[-1]), n) for n, p in hits if len(p)), None):
                cut, how = best
                break
        out.append((start, cut, how))
        start = cut - overlap
    return out + [(start, len(text), "end")] if text else []


@pytest.mark.parametrize("size,overlap", [(100, 20), (64, 0), (40, 39), (160, 157), (7, 3), (1, 0)])
def test_no_boundary_is_lost_at_any_overlap(size, overlap):
    r = random.Random(size)
    words = [" ".join("a" for _ in range(700)), "".join(r.choice(["w ", "long ", "x" * 60, "\n", "\n\n", "\r\n", "[Page Number: 2]"]) for _ in range(300)), "y" * 500, "é " * 300]
    for text in words:
        whole = C.Range(text, 0, len(text), len(text), size, overlap)
        assert list(whole.pieces(0)) == layout(text, size, overlap)
        for step in (max(size, 50), max(size, 131)):
            entry, got = 0, []
            for start in range(0, len(text), step):
                own, before = min(step, len(text) - start), min(size + C.BEFORE, start)
                rest = len(text) - start
                part = C.Range(text[start - before : start + own + size + C.AFTER], before, own, rest if rest <= own + size + C.AFTER else None, size, overlap)
                entries, exits, counts = part.table(start == 0)
                if 0 <= entry < own:
                    mine = [(a + start, b + start, how) for a, b, how in part.pieces(entry)]
                    assert counts[entries.index(entry)] == len(mine)
                    got, entry = got + mine, exits[entries.index(entry)]
                elif entry >= 0:
                    entry -= own
            assert got == layout(text, size, overlap)


def test_an_id_that_comes_again_counts_once_by_its_last_extraction(spark):
    rows = [(1, 1, "old text " * 40, "2024-01-01"), (1, 1, "new text " * 30, "2024-02-01"), (1, 1, "new text " * 30, "2024-02-01"), (1, 1, "no time", None), (2, 1, "b", None), (None, 1, "c" * 300, None)]
    df = spark.createDataFrame(rows, "text_id long, config_id int, text string, extracted_at string")
    configs = spark.createDataFrame([(1, 100, 10)], "config_id int, chunk_size int, chunk_overlap int")
    for range_size in (100, 10_000):
        got = sorted(tuple(r) for r in C.chunks(df, configs, range_size).collect())
        assert [(g[2], g[3], g[4]) for g in got if g[0] == 1] == layout("new text " * 30, 100, 10) and [g[5] for g in got if g[0] == 2] == ["b"] and len({g[0] for g in got}) == 2
    assert [tuple(r) for r in C.oversized(df, configs).collect()] == [(1, "natural")]


def test_files_are_read_by_ranges(spark, tmp_path):
    r = random.Random(4)
    texts = {"a.txt": "".join(r.choice(["wörd ", "가나 ", "😀", "\n\n", "line\r\n", "x" * 90]) for _ in range(4000)), "b.txt": "short", "c.txt": "", "d.txt": "é" * 5000, "e.txt": "\n" + "z" * 700}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    for range_size in (400, 1111, 1 << 20):
        got = {}
        for row in C.chunks_of_files(spark, str(tmp_path), 100, 20, range_size).collect():
            got.setdefault(row.path.rsplit("/", 1)[-1], []).append(row)
        assert set(got) == {n for n, t in texts.items() if t}
        for name, rows in got.items():
            rows.sort(key=lambda x: x.chunk_no)
            assert [(x.start, x.end, x.cut) for x in rows] == layout(texts[name], 100, 20) and all(texts[name][x.start : x.end] == x.text for x in rows)
            assert [x.chunk_no for x in rows] == list(range(len(rows)))
