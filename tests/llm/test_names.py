import random

from docloom.llm import names as N

REGISTER = [(1, "person", "Ingrid Torvanez"), (2, "person", "Edward P. Geldelez"), (3, "person", "Åsa B. Wenzanostko"), (4, "person", "Ivan Torvanez"), (5, "organisation", "Velora Institute of Metallurgy"), (6, "organisation", "University of Saint-Orme, Department of Robotics"), (7, "organisation", "Velora Metallurgy Ltd"), (8, "person", None), (9, "person", "Gabriela Kirsorben")]


def test_variants(spark):
    typed = {
        "Torvanez, Ingrid": [1], "INNGRID TORVANEZ": [1], "OFFICE\\egeldelez": [2], "edward.geldelez@mail.example": [2], "Dr. Ed Geldelez": [2], "Geldelez E": [2], "Asa Wenzanostko": [3], "Wenzanotsko, Å": [3],
        "I. Torvanez": [], "Ingrid Torvanez": [], "Ulrike Torvanez": [], "Edward Q. Geldelez": [], "Institute of Metallurgy, Velora": [5], "Saint-Orme University (Robotics)": [6], "Univ. of SaintOrme, Dept. of Robotics": [6],
        "Gabi Kirsorben; c/o Velora Inst. for Metallurgy": [5, 9], "Ingrid Torvanez / Kirsorben G.": [9], "": [], "  ": [], "x" * 50_000: [], "admin": [],
    }
    rows = [(i, v, None) for i, v in enumerate(typed)] + [(99, None, None), (0, list(typed)[0], None)]
    meta = spark.createDataFrame(rows, "meta_id long, author string, last_saved_by string")
    register = spark.createDataFrame(REGISTER, "contributor_id long, kind string, full_name string")
    got = sorted((r.meta_id, r.field, r.contributor_id) for r in N.variants(meta, register).collect())
    assert got == sorted((i, "author", c) for i, v in enumerate(typed) for c in typed[v])
    assert N.variants(meta.limit(0), register).count() == 0 == N.variants(meta, register.limit(0)).count()


def test_the_join_of_grams_misses_no_slip(spark):
    r = random.Random(2)
    known = ["".join(r.choices("abcdeo", k=r.randint(3, 9))) for _ in range(150)]
    typed = set(known[:20])
    for k in known:
        i = r.randrange(len(k))
        typed |= {k[:i] + k[i + 1 :], k[:i] + "z" + k[i:], k[:i] + "q" + k[i + 1 :], k[:i] + k[i : i + 2][::-1] + k[i + 2 :]}
    frame = lambda words: spark.createDataFrame([(w,) for w in sorted(set(words)) if w], "token string")
    got = {(x.token, x.known) for x in N.similar_tokens(frame(typed), frame(known)).collect()}
    assert got >= {(t, k) for t in typed if t for k in known if N.slip(t, k)}


def test_nicknames_are_learned_and_held_out_names_found(spark):
    """A register of made-up names with made-up nicknames: nothing of it is in any list of the code."""
    r = random.Random(11)
    part = lambda n: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(n))
    givens = {part(3) + r.choice("nrs"): part(2) for _ in range(24)}
    families = [part(3) + r.choice(["ford", "wick", "quist", "berg"]) for _ in range(150)]
    people = sorted({(r.choice(list(givens)), f) for f in families for _ in range(2)})
    unit = [f"{part(2).title()} {k} of {part(3).title()}" for k in ("Institute", "University", "Academy") for _ in range(15)]
    register = [(i, "person", f"{g.title()} {f.title()}") for i, (g, f) in enumerate(people)] + [(1000 + i, "organisation", u) for i, u in enumerate(unit)]

    def slipped(w):
        k = r.randrange(1, len(w) - 1)
        return r.choice([w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "x" + w[k + 1 :]])

    forms = [
        lambda g, f: f"{f}, {g}", lambda g, f: f"{g.upper()} {f.upper()}", lambda g, f: f"{slipped(g)} {f}", lambda g, f: f"{g} {slipped(f)}", lambda g, f: f"{givens[g]} {f}", lambda g, f: f"{f} {g[0]}.",
        lambda g, f: f"DOM\\{g[0]}{f}", lambda g, f: f"{g}.{f}@mail.example",
    ]
    rows, want = [], {}
    for i, (g, f) in enumerate(people):
        for form in (*forms[:4], forms[4], forms[4 + i % 4]):
            rows.append((len(rows), form(g, f), None))
            want[len(rows) - 1] = i
    for i, u in enumerate(unit):
        a, k, _, b = u.split()
        for form in (f"{k} of {b}, {a}", f"{a} {slipped(k)} of {b}", f"{a.lower()} {k.lower()} {b.lower()}"):
            rows.append((len(rows), form, None))
            want[len(rows) - 1] = 1000 + i
    strangers = len(rows)
    rows += [(strangers + i, f"{part(3)}x {part(4)}", None) for i in range(200)]
    meta, reg = spark.createDataFrame(rows, "meta_id long, author string, last_saved_by string"), spark.createDataFrame(register, "contributor_id long, kind string, full_name string")
    got = {x.meta_id: x.contributor_id for x in N.variants(meta, reg).collect()}
    right = sum(got.get(i) == c for i, c in want.items())
    by_nickname = [i for i in want if rows[i][1].split()[0] in givens.values()]
    assert right / len(want) >= 0.9 and sum(got.get(i) == want[i] for i in by_nickname) / len(by_nickname) >= 0.9, (right / len(want), len(by_nickname))
    assert right / len(got) >= 0.97 and sum(i >= strangers for i in got) <= 2


def test_similarity_counts_rare_tokens_more():
    weights = {"ann": 1.0, "rare": 6.0, "common": 1.5, "b": 1.0}
    score = lambda typed, name, **k: N.person_score(typed, name, weights, **k)
    assert score(["ann", "rare"], ["ann", "rare"]) == 1 > score(["a", "rare"], ["ann", "rare"]) > score(["a", "common"], ["ann", "common"])
    assert score(["nan", "rare"], ["ann", "rare"]) == 0 < score(["nan", "rare"], ["ann", "rare"], called=frozenset({("nan", "ann")}))
    assert score(["ann", "b", "rare"], ["ann", "rare"]) == 0 and score(["ann", "rare"], ["ann", "b", "rare"]) > 0.9
