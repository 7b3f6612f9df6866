"""Labelled documents to learn from: a bounded number, made by rule from a seed.

Each maker writes one way a document may look. The words are made up or common, none come from a corpus.
"""

from __future__ import annotations

import random
from collections.abc import Callable

#: Function words by language; prose holds many of them, lists and junk few.
FUNCTION_WORDS = {
    "en": "the of and to in is are was were be been by that this it for with as at from or not on one has have had which an each more than may but we they their its can only after before when if then there these those all no both our would could into over under such most some other",
    "fr": "le la les des et est une un que dans pour sur par ne pas plus qui au aux ce cette sont nous il elle ou se du en été même si avec leur à où mais ont être fait sans entre",
    "es": "el la los las del y que es una un se por con para no más su al lo como pero sus le ya o este sí porque esta son entre cuando muy sin sobre también hay después aún fue han ser según está en de",
    "de": "der die das und ist ein eine nicht mit von zu den sich auf als wir für wird dem des im es sie auch an werden aus er hat dass nach bei um am sind noch wie einem über einen so zum zur wurde oder aber wenn nur daß",
    "pt": "o a os as um uma do da dos das e é não que se por com para mais ao no na nos são já também em",
    "ru": "и в не на что с по как это для из от но мы же за так или к была были его",
    "cs": "a je se na v že s z do o pro ale jako by byl byla než u při tato této i",
}
NOUNS = "river engine letter garden signal market window theory planet circuit village bottle mirror sample orchard harbour method bridge number colour vessel reader storm copper forest paper candle summer field stone mountain corner music pattern animal teacher school answer picture"
VERBS = "shows moves limits follows holds changes drives reaches explains covers needs raises joins marks tests"
ADJECTIVES = "small early narrow common strong bright quiet heavy recent simple local regular broken wide open stable thin linear"
KOREAN = "그러나 결과는 아직 분명하지 않다 우리는 새로운 방법을 비교하였으며 값은 조금 달라졌다 이 절에서는 자료와 모형의 관계를 다룬다 온도가 높을수록 변화가 빠르게 나타났다 다음 장에서 설명한다"
_SYLLABLES = "ba do ke lir mon pas que rin sol tur vex wim yal zor gra pel".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 4)))


def _math(r: random.Random) -> str:
    a, b, n = r.choice("abcxyzuv"), r.choice("pqrst"), r.randint(2, 9)
    return r.choice([f"${a}^{n} = {b}$", f"\\({a}_{n} \\le {b}\\)", f"$\\frac{{{a}}}{{{b}}}$", f"\\cite{{{_word(r)}{n}}}", f"$\\alpha_{{{a}}}$"])


def sentence(r: random.Random, lang: str = "en") -> str:
    """A sentence: function words and others about as often as in prose."""
    if lang == "ko":
        words = KOREAN.split()
        out = [r.choice(words) for _ in range(r.randint(4, 10))]
        return _counted(r, " ".join(out) + "다.")
    small, content = FUNCTION_WORDS[lang].split(), (NOUNS + " " + VERBS + " " + ADJECTIVES).split()
    out = []
    share = r.uniform(0.3, 0.55)
    for _ in range(r.randint(8, 24)):
        out.append(r.choice(small) if r.random() < share else r.choice(content) if r.random() < 0.8 else _word(r))
    text = " ".join(out)
    return _counted(r, text[0].upper() + text[1:] + r.choice([".", ".", ".", ".", "?", ";"]))


def _counted(r: random.Random, text: str) -> str:
    """The sentence with a number in it now and then."""
    if r.random() < 0.6:
        return text
    head, _, tail = text.partition(" ")
    return f"{head} {r.randint(2, 400)} {tail}"


def _paragraph(r: random.Random, lang: str, maths: float, wrap: bool) -> str:
    out = []
    for _ in range(r.randint(2, 6)):
        s = sentence(r, lang)
        out.append(s[:-1] + " " + _math(r) + s[-1] if r.random() < maths else s)
    text = " ".join(out)
    if wrap:
        lines, line = [], ""
        for w in text.split(" "):
            if len(line) + len(w) > 76:
                lines.append(line)
                line = ""
            line = f"{line} {w}".strip()
        text = "\n".join([*lines, line])
    return text


def prose(r: random.Random) -> str:
    lang = r.choice(["en"] * 6 + ["fr", "es", "de", "ko", "ko"])
    maths, wrap, out = r.choice([0, 0.1, 0.5, 0.9]), r.random() < 0.6, []
    # prose says some things more than once
    said = [sentence(r, lang) for _ in range(r.choice([0, 0, 1, 2, 4]))]
    if r.random() < 0.3:
        return r.choice(["{}", "\\begin{{abstract}}\n{}\n\\end{{abstract}}"]).format(" ".join(sentence(r, lang) for _ in range(r.randint(1, 4))))
    for k in range(r.randint(2, 9)):
        if r.random() < 0.5:
            out.append(f"\\section{{{_word(r).title()} {r.choice(NOUNS.split())}}}")
        out.append(_paragraph(r, lang, maths, wrap))
        if said and r.random() < 0.5:
            out.append(r.choice(said))
        if r.random() < 0.3:
            out.append("\\begin{align*}\n" + "\n".join(f"  \\frac{{{r.choice('abc')}^{{{i}}}}}{{\\nu_{{s}}}} &= \\left({r.choice('pqr')} + {i}\\right) \\\\" for i in range(r.randint(1, 4))) + "\n\\end{align*}")
        if r.random() < 0.2:
            out.append("% " + sentence(r, lang))
        if r.random() < 0.35:
            out.append(f"\\[ {r.choice('abcd')}^{{{k}}} = \\frac{{{r.randint(1, 9)}}}{{x_{{{k}}}}} \\]\n" * r.choice([1, 1, 3]))
        if r.random() < 0.25:
            out.append("\\begin{itemize}\n" + "\n".join("\\item " + sentence(r, lang) for _ in range(r.choice([2, 3, 4, 5, 9]))) + "\n\\end{itemize}")
        if r.random() < 0.1:
            out.append("\\begin{tabular}{lr}\n" + "\n".join(f"{_word(r)} & {r.randint(1, 99)} \\\\" for _ in range(r.randint(2, 4))) + "\n\\end{tabular}")
    if r.random() < 0.5:
        out.append("\\begin{thebibliography}{9}\n" + "\n".join(_reference(r, k) for k in range(r.randint(1, 7))) + "\n\\end{thebibliography}")
    text = r.choice(["\n\n", "\n\n", "\n"]).join(out)
    if lang in ("de", "fr", "es") and r.random() < 0.4:
        for a, b in (("é", "\\'e"), ("è", "\\`{e}"), ("ü", '\\"u'), ("ö", '\\"{o}'), ("ä", '\\"a'), ("ú", "\\'{u}"), ("à", "\\`a")):
            text = text.replace(a, b)
    return text


def _reference(r: random.Random, k: int) -> str:
    a, t = _word(r).title(), f"{r.choice(ADJECTIVES.split()).title()} {r.choice(NOUNS.split())} {r.choice(NOUNS.split())}s"
    key = r.choice([f"\\bibitem{{{_word(r)}{k}}}", f"\\bibitem[{a}({r.randint(1950, 2024)})]{{r{k}}}"])
    return key + " " + r.choice([f"{a[0]}. {a}, \\emph{{{t}}}, J. {_word(r).title()} \\textbf{{{k + 3}}} ({r.randint(1950, 2024)}) {r.randint(1, 400)}--{r.randint(401, 900)}.", f"{a[0]}. {a} et al. {t}. Preprint {r.randint(1000, 9999)}.{r.randint(10000, 99999)}", f"{a[0]}. {a} and {_word(r).title()}: {t}. {_word(r).title()} Press, {r.randint(1950, 2024)}."])


def listing(r: random.Random) -> str:
    n, kind = r.randint(8, 60), r.randrange(7)
    if kind == 0:
        return "\\begin{thebibliography}{99}\n" + "\n".join(_reference(r, k) for k in range(n)) + "\n\\end{thebibliography}"
    if kind == 1:
        return "\\begin{theindex}\n" + "\n".join(f"  \\item {r.choice(NOUNS.split())} {_word(r)}, {r.randint(1, 90)}, {r.randint(91, 120)}--{r.randint(121, 180)}" for _ in range(n)) + "\n\\end{theindex}"
    if kind == 2:
        return "\n".join(f"{r.choice(['-', '*', '--', '•'])} {r.choice(NOUNS.split())}, {_word(r)}" for _ in range(n))
    if kind == 3:
        return "\n".join(f"{k}{r.choice(['.', '.', ')'])} {r.choice(ADJECTIVES.split())} {r.choice(NOUNS.split())}" for k in range(1, n))
    if kind == 4:
        return "\\begin{description}\n" + "\n".join(f"\\item[{r.choice([_word(r), _math(r)])}] {r.choice(ADJECTIVES.split())} {r.choice(NOUNS.split())}" + r.choice(["", f" of the {_word(r)}"]) for _ in range(n)) + "\n\\end{description}"
    if kind == 5:
        return "\n".join(f"[{k}] {_word(r).title()}, {_word(r).title()}: {r.choice(ADJECTIVES.split()).title()} {r.choice(NOUNS.split())}, {r.randint(1950, 2024)}." for k in range(1, n))
    return "\n".join(f"\\item {r.choice(NOUNS.split())} {_word(r)}, {r.randint(1, 99)}" for _ in range(n))


def table(r: random.Random) -> str:
    rows, cols, kind = r.randint(6, 50), r.randint(3, 8), r.randrange(7)
    cell = lambda: r.choice([str(r.randint(1, 5000)), f"{r.uniform(0, 900):.{r.randint(1, 3)}f}"])
    words = lambda: [r.choice([_word(r), r.choice(NOUNS.split())]) for _ in range(cols)]
    body = [words(), *([r.choice([_word(r), r.choice(ADJECTIVES.split())]), *(cell() for _ in range(cols - 1))] for _ in range(rows))]
    if kind == 0:
        return "\n".join("| " + " | ".join(x) + " |" for x in [body[0], ["---"] * cols, *body[1:]])
    if kind == 1:
        return "\\begin{longtable}{" + "c" * cols + "}\n" + "\n".join(" & ".join(f"${r.randint(1, 900)} \\pm {r.randint(0, 30)}$" for _ in range(cols)) + " \\\\" for _ in range(rows)) + "\n\\end{longtable}"
    if kind == 2:
        return "\\begin{table}\n\\begin{tabular}{l" + "r" * (cols - 1) + "}\n" + "\n".join(" & ".join(x) + " \\\\" + r.choice(["", " \\hline"]) for x in body) + "\n\\end{tabular}\n\\end{table}"
    if kind == 3:
        return "\n".join("\t".join(x) for x in body)
    if kind == 4:
        return "\n".join(",".join(x) for x in body)
    if kind == 5:
        return "\n".join(r.choice([" | "]).join(x) for x in body) if r.random() < 0.5 else "\n".join(";".join(x) for x in body)
    return "\\begin{verbatim}\n" + "\n".join("".join(c.ljust(14 if k == 0 else 10) for k, c in enumerate(x)) for x in body) + "\n\\end{verbatim}"


def junk(r: random.Random) -> str:
    n, kind = r.randint(40, 400), r.randrange(12)
    if kind == 0:
        return " ".join(r.choice((NOUNS + " " + ADJECTIVES).split()) for _ in range(n))
    if kind == 1:
        return " ".join("".join(r.choice("asdfghjkl;qwertyuiop") for _ in range(r.randint(3, 14))) for _ in range(n))
    if kind == 2:
        signs = r.choice(["!|l1I;:.,'^~-_= rcnmoeat", "01|lI.,;:'`^~_- aeionrst"])
        return "".join(r.choice(signs) for _ in range(4 * n))
    if kind == 3:
        signs = r.choice(["$%&#@{}\\^~*?", "▒□◆{}%$#&", "<>[]{}()=+*/|"])
        return "".join(r.choice(signs + "   \n") for _ in range(4 * n))
    if kind == 4:
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        return "\n".join("".join(r.choice(letters) for _ in range(72)) for _ in range(n // 10 + 3))
    if kind == 5:
        return "\n".join(f"{16 * k:08x}  " + " ".join(f"{r.randrange(256):02x}" for _ in range(16)) + "  |" + "".join(r.choice("abz.@-9k") for _ in range(16)) + "|" for k in range(n // 10 + 3))
    if kind == 6:
        return "\n".join(r.choice([f"Overfull \\hbox ({r.uniform(1, 90):.3f}pt too wide) in paragraph at lines {r.randint(1, 400)}--{r.randint(401, 700)}", f"[{k}] [{k + 1}] (./{_word(r)}.aux) )", f"LaTeX Warning: Reference `{_word(r)}' on page {k} undefined", f"Package {_word(r)} Info: File {_word(r)}.sty"]) for k in range(n // 10 + 5))
    if kind == 7:
        word = r.choice([_word(r), "lorem", r.choice(NOUNS.split())])
        return r.choice([" ", "\n"]).join([word] * n)
    if kind == 8:
        return r.choice(["\n", " "]).join([sentence(r)] * (n // 8 + 8))
    if kind == 11:
        return "\n".join([r.choice([f"\\vspace{{{r.randint(1, 9)}mm}}", "\\clearpage", "\\newpage \\null", "\\bigskip", f"\\hspace*{{{r.randint(1, 9)}em}}", "~ \\\\"])] * (n // 8 + 8))
    if kind == 9:
        return "\n".join(f"2023-0{r.randint(1, 9)}-1{r.randint(0, 9)} 1{r.randint(0, 9)}:{r.randint(10, 59)}:0{r.randint(0, 9)} {r.choice(['INFO', 'WARN', 'ERROR', 'DEBUG'])} {_word(r)}.{_word(r)}: {r.choice(['started', 'retry', 'timeout', 'done'])} id={r.randrange(1 << 32):x}" for _ in range(n // 8 + 5))
    return "\n".join(f'  File "/{_word(r)}/{_word(r)}.py", line {r.randint(1, 900)}, in {_word(r)}\n    {_word(r)}({_word(r)}[{r.randint(0, 9)}], *{_word(r)})' for _ in range(n // 12 + 4))


def _dressed(body: str, kind: str, r: random.Random) -> str:
    """The body with a usual first and last line or an opening sentence, as often as documents have them."""
    if r.random() < 0.45:
        body = sentence(r) + "\n" + body
    if r.random() < 0.3:
        body = f"{r.choice(ADJECTIVES.split()).title()} {r.choice(NOUNS.split())}s{r.choice(['', ':'])}\n" + body
    if r.random() < 0.4:
        macros = "".join(r.choice(["\\usepackage{amsmath}\n", "\\usepackage{hyperref}\n", f"\\newcommand{{\\{_word(r)}}}{{\\mathbb{{R}}}}\n", f"\\author{{{_word(r).title()} \\and {_word(r).title()}}}\n"]) for _ in range(r.randint(0, 5)))
        body = f"\\documentclass{{article}}\n{macros}\\title{{{_word(r).title()}}}\n\\begin{{document}}\n\\maketitle\n{body}\n\\end{{document}}"
    return body.replace("\n", "\r\n") if r.random() < 0.15 else body


MAKERS: dict[str, Callable[[random.Random], str]] = {"table": table, "list": listing, "junk": junk, "prose": prose}


def labelled(each: int = 400, seed: int = 11) -> list[tuple[str, str]]:
    """``each`` documents of every kind but prose, twice as many of prose, with their kinds."""
    r = random.Random(seed)
    return [(_dressed(make(r), kind, r), kind) for kind, make in MAKERS.items() for _ in range(each * (2 if kind == "prose" else 1))]
