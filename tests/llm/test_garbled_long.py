"""Stretches without a blank and words with many lost bytes are looked at whole."""

from docloom.llm import garbled as G

# signs of three bytes each: 400 signs misread end inside of one
PHRASE = "これは長い文章であり空白を持たない例です"
CLEAN = [PHRASE[i:] + PHRASE[:i] for i in range(len(PHRASE))]


def misread(text, wrong):
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode())


def fixer():
    return G.Restorer(G.Frequencies.of(dict.fromkeys(CLEAN, 20)))


def test_long_stretches_are_found_and_restored():
    fix, text = fixer(), "".join(CLEAN) * 3
    assert fix(text) == (text, 0, 0) and len(text) > 2 * G.LONG
    for wrong in ("cp437", "mac_roman", "koi8-r", "cp850", "cp1251", "latin-1", "cp1252"):
        got, garbled, left = fix(f"a {misread(text, wrong)} b")
        assert (got, garbled, left) == (f"a {text} b", 1, 0), wrong


def test_any_number_of_lost_bytes():
    fix, word = fixer(), CLEAN[0] * 4
    raw = list(misread(word, "cp437"))
    lost = range(1, len(raw), 9)
    assert len(lost) > 20
    for k in lost:
        raw[k] = G.LOST
    assert fix("".join(raw)) == (word, 1, 0)
    long = list(misread(word * 6, "cp437"))
    for k in range(1, len(long), 9):
        long[k] = G.LOST
    assert len(long) > G.LONG and fix("".join(long)) == (word * 6, 1, 0)


def test_search_is_exact_under_pairs_of_signs():
    """The best path through a lattice with lost bytes is the best of all fillings, scored one by one."""
    from itertools import product

    lm = G.Frequencies.of({w: n for n, w in enumerate("für größe fläche dünne kühle führung prüfung wärme müde häufig höhe spät".split(), 3)})
    signs = [s for s in lm.signs if s > "\x7f"]
    for word in ("f�r", "fl�che", "gr�ße", "k�h�e", "h�u�ig", "��he", "m�d�"):
        texts = ["".join(t) for t in product(*(lm.alphabet() if c == G.LOST else [c] for c in word))]
        got = G._through(([(1, lm.alphabet() if c == G.LOST else (c,))] for c in word), len(word), lm)
        best = max(map(lm.spelled, texts))
        assert abs(max(map(lm.spelled, got)) - best) < 1e-4 and set(lm.alphabet()) <= set(signs)


def test_common_counts(spark):
    from docloom.llm.garbled import _common

    df = spark.createDataFrame([(k, k * k) for k in range(1, 2001)], "key long, n long")
    rows = _common(df, 500).collect()
    assert 450 <= len(rows) <= 500 and min(r.n for r in rows) > max(k * k for k in range(1, 1500)) and _common(df, 5000).count() == 2000
    assert _common(df.limit(0), 5).count() == 0


def test_long_runs_of_letters_are_cut_in_time():
    import time

    began = time.process_time()
    assert G.WORD.findall("a" * 300_000 + " é") == ["é"] and G.PART.findall("a" * 300_000 + "-é1 xéy") == ["é", "xéy"]
    assert time.process_time() - began < 5
