from docloom.llm import markup as M


def test_kinds():
    cases = {
        "a < b & c, x -> y; $44 - $79, 1 * 4 = ? & co., no. #787 C:\\new\\notes_1.txt raw_a_1 [2] {x}": set(), "<P ALIGN=center>x": {"html"}, "&lt;p&gt;x&lt;/p&gt;": {"html"}, "x&nbsp;y": {"html"}, "<filename> <a@b.example>": set(),
        "# Head\n\ntext": {"markdown"}, "Head\n=====\nx": {"markdown"}, "[a](b.md)": {"markdown"}, "```python\nx = [[1, 2]] # '''a'''\n```": {"markdown"}, "a **b** c": {"markdown"}, "[[Page|label]]": {"wiki"}, "'''b'''": {"wiki"}, "== H ==": {"wiki"},
        "{{main|a=1}}": {"wiki"}, '{| class="w"\n|-\n| a || 1\n|}': {"wiki"}, "\\section{A}": {"latex"}, "so \\(x_1\\)": {"latex"}, "$$a$$": {"latex"}, "<script>var t = [[5, 4]]; '**a**'</script>": {"html"}, "<!-- ## a: [[b]] -->": {"html"},
        "<pre><code>'''a''' $x^2$ **b**</code></pre>": {"html"}, "<p>== H ==\n\\item</p>": {"html", "latex", "wiki"}, "<p>a == b ==\n\\item</p>": {"html", "latex"}, "<div>\n== H ==\n</div>": {"html", "wiki"}, "├── a\n√8 ± 2 °C\n. . . . .": set(), "": set(),
    }
    for text, kinds in cases.items():
        assert M.kinds_of(text) == kinds, text


def test_clean_text_keeps_structure():
    page = "<html><head><title>T</title><style>p{}</style></head><body><h2>Head</h2><p>one &amp; two<ul><li>a<li>b</ul><ol><li>c</ol><pre><code>x &lt; y\n**z**</code></pre>\\(e=1\\)</body></html>"
    assert M.extract(page, None) == "## Head\n\none & two\n\n- a\n- b\n\n1. c\n\n```\nx < y\n**z**\n```\n\n$e=1$"
    assert M.extract("== H ==\n'''b''' [[P|l]]\n\\begin{enumerate}\n\\item x\n\\item y\n\\end{enumerate}", None) == "## H\nb l\n\n1. x\n2. y"
    assert M.extract("&lt;p&gt;Hi&lt;/p&gt;", None) == "Hi" and M.extract("a < b", None) == "a < b"


def test_hosts_vote(spark):
    menu = '<nav><a href="x">Home and more</a></nav>'
    rows = [(i, i, f"<body>{menu}<div class='main{i}'>Real text of page {i}, long enough to count.</div></body>") for i in range(6)]
    rows += [(6, 6, None), (7, 7, ""), (8, None, "plain"), (0, 0, rows[0][2]), (9, 9, f"<body>{menu}</body>")]
    pages = spark.createDataFrame(rows, "html_id long, file_id long, html_text string").selectExpr("*", "'x' AS host", "1 AS score")
    files = spark.createDataFrame([(i, f"/srv/a/b/{i}/f.html") for i in range(10)] + [(None, None)], "file_id long, file_path string")
    got = {r.html_id: r.clean for r in M.converted(pages, files).collect()}
    assert len(got) == 10 and got[6] is None and got[7] == "" and got[8] == "plain"
    assert all(got[i] == f"Real text of page {i}, long enough to count." for i in range(6))
    assert M.found(pages, files).where("markup = 'html'").count() == 7
    assert M.found(pages.limit(0), files).count() == 0


def labelled(no):
    """A page of one markup, and the lines that its clean text must have: headings, items, code, formulas, prose."""
    word = lambda k: "".join("aeiou"[(no * 7 + k * 3 + j) % 5] + "bdgklmnrst"[(no * 3 + k * 5 + j * 7) % 10] for j in range(4))
    head, sub, one, two, text, code, formula = word(1).title(), word(2).title(), word(3), word(4), " ".join(word(k) for k in range(5, 14)) + ".", f"{word(20)} = [[1, 2]] ** 3  # '''x'''", f"{word(21)[0]}_1 = {word(22)[0]}^2"
    want = {"heading": [f"# {head}", f"## {sub}"], "list": [f"- {one}", f"- {two}", f"1. {two}", f"2. {one}"], "code": [f"```\n{code}\n```"], "formula": [f"${formula}$"], "prose": [text]}
    kind = no % 4
    if kind == 0:
        menu = "".join(f'<li><a href="/{word(k)}">{word(k)} {word(k + 1)}</a></li>' for k in range(30, 36))
        page = f"<html><body><div class='menu{no}'><ul>{menu}</ul></div><div class='text'><h1>{head}</h1><p>{text}<h2 id=x>{sub}</h2><ul><li>{one}<li><b>{two}</b></ul><ol><li>{two}</li><li>{one}</ol><pre><code>{code}</code></pre><p>so \\({formula}\\)</p></div></body></html>"
    elif kind == 1:
        page = f"# {head}\n\n{text}\n\n{sub}\n-----\n\n* {one}\n* **{two}**\n\n1. {two}\n2. {one}\n\n```\n{code}\n```\n\nso ${formula}$ [x](http://a.b)\n"
    elif kind == 2:
        page = f"<h1>{head}</h1>\n'''{text}''' [[Page|label]]\n\n<h2>{sub}</h2>\n\n* {one}\n* ''{two}''\n\n<ol><li>{two}<li>{one}</ol>\n<syntaxhighlight>{code}</syntaxhighlight>\n{{{{main|a}}}}\nso ${formula}$\n"
    else:
        page = f"\\section{{{head}}}\n{text}\n\n\\subsection{{{sub}}}\n\\begin{{itemize}}\n\\item {one}\n\\item \\textbf{{\\emph{{{two}}}}}\n\\end{{itemize}}\n\\begin{{enumerate}}\n\\item {two}\n\\item {one}\n\\end{{enumerate}}\n\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}\nso \\({formula}\\)\n"
    return page, want


def test_structure_kept_in_labelled_pages(spark):
    pages = {no: labelled(no) for no in range(400)}
    df = spark.createDataFrame([(no, no, p) for no, (p, _) in pages.items()], "html_id long, file_id long, html_text string")
    files = spark.createDataFrame([(no, f"/srv/a/b/{no}/f.html") for no in pages], "file_id long, file_path string")
    got = {r.html_id: r.clean for r in M.converted(df, files).collect()}
    kept = {}
    for no, (_, want) in pages.items():
        for kind, lines in want.items():
            for line in lines:
                kept.setdefault((no % 4, kind), []).append(f"\n{line}\n" in f"\n{got[no]}\n" if kind not in ("formula", "prose") else line in got[no])
    shares = {k: sum(v) / len(v) for k, v in kept.items()}
    assert len(shares) == 20 and min(shares.values()) >= 0.95, shares
    # menus go
    assert not any("](" in got[no] or got[no].count("\n- ") > 2 for no in pages)


def test_long_and_broken_pages():
    import time

    began = time.process_time()
    for page in ("<div>" * 20_000, "<p class=\"x>y" * 30_000, "&lt;p " * 100_000, "\\textbf{" * 100_000 + "x" + "}" * 100_000, "<a href='" * 50_000, "`" * 200_000, "[[" * 100_000, "$" * 100_001):
        M.extract(page, None), M.kinds_of(page)
    assert M.plain("\\textbf{" * 50 + "x" + "}" * 50) == "x" and M.plain("{a \\textbf{b} c}") == "{a b c}"
    assert M.extract("<a title=\"1 > 0\" class='x'>y</a>", None) == "y"
    assert time.process_time() - began < 60
