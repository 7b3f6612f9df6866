from docloom.llm import garbled as G

TEXTS = ["Die dünne Fläche stört die Größe der Werte, für 13 Proben geprüft.", "Não há métodos suficientes para a direção, são apenas 331.", "Мы видим, что система почти зависит от данных.", "이 절에서는 느린 기준과 표본의 관계를 다룬다.", "El año y la señal — está aquí, don’t ±2 °C"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "html_id long, html_text string, restored string")


def test_restores_what_was_misread(spark):
    def misread(t, true, wrong):
        raw, out = t.encode(true, "replace"), ""
        for b in raw:
            try:
                out += bytes([b]).decode(wrong)
            except UnicodeDecodeError:
                out += chr(b)
        return out

    cases = [(t, misread(t, "utf-8", w)) for t in TEXTS[:3] for w in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251") if misread(t, "utf-8", w) != t]
    cases += [(TEXTS[2], misread(TEXTS[2], "cp1251", "cp1252")), (TEXTS[3], misread(TEXTS[3], "cp949", "latin-1")), (TEXTS[0], misread(misread(TEXTS[0], "utf-8", "cp1252"), "utf-8", "cp1252"))]
    clean = TEXTS * 60
    df = frame(spark, clean + [g for _, g in cases])
    got = {r.html_id: r for r in G.restore(df).collect()}
    assert all(got[i].garbled == 0 and got[i].restored == t for i, t in enumerate(clean))
    for i, (t, g) in enumerate(cases):
        assert got[len(clean) + i].restored == t, (g, got[len(clean) + i].restored)
    assert {r.html_id for r in G.found(df).collect()} == set(range(len(clean), len(clean) + len(cases)))


def test_lost_bytes_and_odd_rows(spark):
    long = "für die Größe " * 3000
    texts = TEXTS * 40 + ["für die Gr�ße der Werte", "����� ��", None, "", "ascii only", "├── a\n│   └── b √4 ± 2 °C", long]
    got = {r.html_id: r for r in G.restore(frame(spark, texts)).collect()}
    n = len(TEXTS) * 40
    assert got[n].restored == "für die Größe der Werte" and got[n + 1].left == got[n + 1].garbled == 2 and got[n + 1].restored == texts[n + 1]
    assert got[n + 2].restored is None and got[n + 3].restored == "" and [got[n + k].garbled for k in (2, 3, 4, 5, 6)] == [0] * 5
    assert G.found(frame(spark, TEXTS).limit(0)).count() == 0
