"""Linking of typed names to a register of persons and organisations.

A set-similarity join on the q-grams of tokens finds the register's tokens that a typed token may stand
for: grams are ordered from rare to frequent, and two tokens that differ by one slip of the hand share
one of their first few grams, so only those are joined. Tokens lead to register entries by each
entry's rarest tokens, for a person by family name and an initial; every pair is then verified by a soft
weighted similarity of tokens, in which rare tokens count more and a token may be equal, mistyped,
abbreviated, an initial or a nickname, and after that by rules that no token may belie. Which nicknames
stand for which given names is learned from the family names that they are typed with.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.tables import bounded_batches, stored

#: Grams of three signs; one slip (a sign more, less or other, or two exchanged) changes at most four.
GRAM, CHANGED = 3, 4
#: Least length of a token that may be mistyped, and least similarity of a person and of an organisation.
LEAST_TYPO, LEAST_PERSON, LEAST_ORGANISATION = 4, 0.7, 0.78
#: How many times likelier, in nats, the family names that a nickname is typed with must be under a given name than by chance.
LEAST_EVIDENCE, LEAST_SHARE = 5.0, 0.7
#: Weight of a middle name that isn't typed against one that is.
MISSING = 0.1
#: Words around a name that are no part of it.
AROUND = frozenset("dr prof professor mr mrs ms miss phd the md msc bsc dphil guest sir dame co".split())
#: Short forms of words in names of organisations.
SHORT = {
    "univ": "university", "uni": "university", "dept": "department", "dep": "department", "inst": "institute", "natl": "national", "nat": "national", "ctr": "centre", "center": "centre",
    "cntr": "centre", "limited": "ltd", "labs": "laboratory", "lab": "laboratory", "intl": "international", "assoc": "association", "corp": "corporation", "for": "of", "tech": "technology",
}
#: Words that say what kind an organisation is; two of different kinds are never the same.
KINDS = frozenset("university institute centre ltd laboratory association corporation academy college ministry agency".split())
#: Further words common in names of organisations, which tell little in a register of any size.
COMMON = KINDS | frozenset("department national international of faculty school".split())
MOST_COMMON_WEIGHT = 1.0
_FOLD = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})
_SPLIT = re.compile(r"\s*;\s*|\s+/\s+|\s*\|\s*|\s+&\s+|\s+and\s+", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower().translate(_FOLD))
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_FOLD)


def tokens_of(text: str) -> list[str]:
    """The tokens of one name, with short words of organisations written out and words around it left out."""
    text = folded(text)
    text = re.sub(r"^\s*c/o\s+", "", text)
    text = re.sub(r"^.*\\", "", re.sub(r"@\S*", "", text))
    text = re.sub(r"(?<=[^\W\d_]{3})-(?=[^\W\d_]{3})", "", text)
    found = [SHORT.get(t, t) for t in _WORD.findall(text)]
    kept = [t for t in found if t not in AROUND]
    return kept or found


def slip(a: str, b: str) -> bool:
    """Whether one sign more, less or other, or two neighbours exchanged, turn ``a`` into ``b``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < LEAST_TYPO:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _clipped(typed: str, name: str) -> bool:
    """Whether a token is the beginning of a given name, as it is or with one of the usual endings."""
    if 2 <= len(typed) < len(name) and name.startswith(typed):
        return True
    stem = re.sub(r"(?:ie|ey|i|y)$", "", typed)
    if stem == typed or len(stem) < 2:
        return False
    if len(stem) > 2 and stem[-1] == stem[-2]:
        stem = stem[:-1]
    return name.startswith(stem)


Called = frozenset[tuple[str, str]]


def _given(typed: str, name: str, called: Called) -> float:
    """How well a typed token stands for a given name."""
    if typed == name:
        return 1.0
    if len(typed) == 1:
        return 0.7 if name.startswith(typed) else 0.0
    if (typed, name) in called:
        return 0.9
    if slip(typed, name):
        return 0.85
    return 0.8 if _clipped(typed, name) else 0.0


def person_score(typed: list[str], name: list[str], weights: dict[str, float], called: Called = frozenset()) -> float:
    """Soft weighted similarity of typed tokens to a person's, 0 where one of them belies it.

    Each token of the name counts by its weight, that is its rarity, and by how well a typed one stands for it. The
    family name must be there, possibly mistyped, and at least an initial of the given name; a middle name
    may be missing, but not another one.
    """
    if len(name) < 2:
        return 0.0
    given, middle, family = name[0], name[1:-1], name[-1]
    of = lambda t: weights.get(t, 1.0)
    if len(typed) == 1:
        whole, best = typed[0], 0.0
        for fused in (given[0] + family, given + family, family + given[0], given[0] + "".join(m[0] for m in middle) + family):
            if whole == fused:
                best = max(best, 0.9)
            elif len(fused) > 7 and whole[0] == fused[0] and slip(whole, fused):
                best = max(best, 0.8)
        return best
    best = 0.0
    for k, token in enumerate(typed):
        if not slip(token, family):
            continue
        rest = typed[:k] + typed[k + 1 :]
        for g in range(len(rest)):
            first = _given(rest[g], given, called)
            if not first:
                continue
            shared = of(family) * (1.0 if token == family else 0.9) + of(given) * first
            total, left = of(family) + of(given), list(middle)
            for o in rest[:g] + rest[g + 1 :]:
                hit = next((m for m in left if o == m or o[0] == m[0] and (len(o) == 1 or len(m) == 1) or slip(o, m)), None)
                if hit is None:
                    break
                left.remove(hit)
                shared, total = shared + of(hit), total + of(hit)
            else:
                best = max(best, shared / (total + MISSING * sum(map(of, left))))
    return best


def organisation_score(typed: dict[str, float], name: dict[str, float]) -> float:
    """Shared weight of two sets of tokens against all; mistyped tokens share nine tenths of theirs, kinds must agree."""
    ours, theirs = KINDS & typed.keys(), KINDS & name.keys()
    if ours and theirs and not ours & theirs:
        return 0.0
    typed, left = ({t: min(w, MOST_COMMON_WEIGHT) if t in COMMON else w for t, w in x.items()} for x in (typed, name))
    total, shared = sum(typed.values()) + sum(left.values()), 0.0
    for token, weight in sorted(typed.items(), key=lambda x: -x[1]):
        if token in left:
            shared += 2 * left.pop(token)
        elif hit := next((n for n in left if slip(token, n)), None):
            shared += 0.9 * (weight + left[hit]) if weight < left[hit] * 4 else 0
            left.pop(hit)
    return shared / total if total else 0.0


def _grams(token: Column) -> Column:
    padded = F.concat(F.lit("^^"), token, F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (GRAM - 1)), lambda i: F.substring(padded, i, F.lit(GRAM))))


def _prefixes(tokens: DataFrame, frequency: DataFrame) -> DataFrame:
    """The first grams of each token, rare ones first."""
    grams = tokens.select("token", F.explode(_grams(F.col("token"))).alias("gram")).join(frequency, "gram", "left")
    order = Window.partitionBy("token").orderBy(F.coalesce("often", F.lit(0)), "gram")
    return grams.withColumn("no", F.row_number().over(order)).where(F.col("no") <= CHANGED + 1).select("token", "gram")


def _one_slip(a: str, b: str) -> Column:
    """Whether one slip turns one token into the other."""
    swapped = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    distance = F.levenshtein(a, b)
    return (distance == 1) | ((distance == 2) & swapped)


def similar_tokens(typed: DataFrame, known: DataFrame) -> DataFrame:
    """``token, known``: pairs of equal tokens and of tokens one slip apart, by a prefix-filtered join of grams and lengths."""
    long = lambda df: df.where(F.length("token") >= LEAST_TYPO)
    frequency = long(known).select("token", F.explode(_grams(F.col("token"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    size = F.length("token")
    ours = _prefixes(long(typed), frequency).withColumn("size", F.explode(F.array(size - 1, size, size + 1)))
    theirs = _prefixes(long(known), frequency).withColumn("size", size).withColumnRenamed("token", "known")
    pairs = ours.join(theirs, ["gram", "size"]).select("token", "known").distinct()
    pairs = pairs.where(_one_slip("token", "known"))
    return pairs.unionByName(typed.join(known, "token").select("token", F.col("token").alias("known")))


def _parts(values: DataFrame) -> DataFrame:
    """``value, part, single, norm, tokens``: the names that a field holds."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for value in part.column(0).to_pylist():
                pieces = [p for p in (x.strip() for x in _SPLIT.split(value)) if p]
                for p in pieces:
                    tokens = tokens_of(p)
                    if tokens:
                        out.append((value, p, len(pieces) == 1, " ".join(tokens), tokens))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["value", "part", "single", "norm", "tokens"])

    return bounded_batches(values).mapInArrow(run, "value string, part string, single boolean, norm string, tokens array<string>")


def _register(contributors: DataFrame) -> DataFrame:
    """``contributor_id, person, full_name, tokens, keys``; keys: what else a token may be, such as a login."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, persons, names = (part.column(i) for i in range(3))
            tokens = [tokens_of(n) for n in names.to_pylist()]
            keys = []
            for person, t in zip(persons.to_pylist(), tokens):
                person = person and len(t) > 1
                keys.append(sorted({t[0][0] + t[-1], t[0] + t[-1], t[-1] + t[0][0], "".join(x[0] for x in t[:-1]) + t[-1]}) if person else [])
            yield pa.RecordBatch.from_arrays([ids, persons, names, pa.array(tokens, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.string()))], ["contributor_id", "person", "full_name", "tokens", "keys"])

    person = F.coalesce(F.col("kind") == "person", F.lit(False)).alias("person")
    named = contributors.where(F.col("full_name").isNotNull() & F.col("contributor_id").isNotNull()).select("contributor_id", person, "full_name")
    return named.mapInArrow(run, "contributor_id bigint, person boolean, full_name string, tokens array<string>, keys array<string>").where(F.size("tokens") > 0)


def nicknames(names: DataFrame, register: DataFrame) -> DataFrame:
    """``short, given``: typed tokens that stand for a given name, learned from the family names that they are typed with.

    A token teaches by the distinct family names of the register that it stands first or last beside. Where nearly all of
    these have a person of one given name, and that is far above chance, the token is a form of that given name.
    """
    persons = register.where("person AND size(tokens) > 1").select(F.element_at("tokens", -1).alias("family"), F.element_at("tokens", 1).alias("given")).distinct()
    families = persons.select("family").distinct()
    ends = names.where(F.size("tokens") > 1).select(F.element_at("tokens", 1).alias("a"), F.element_at("tokens", -1).alias("b"))
    beside = ends.select(F.explode(F.array(F.struct(F.col("a").alias("short"), F.col("b").alias("family")), F.struct(F.col("b").alias("short"), F.col("a").alias("family")))).alias("x")).select("x.*")
    # of a name of which both ends are family names neither tells of the other
    seen = beside.where(F.length("short") > 1).distinct().join(families, "family").join(families.withColumnRenamed("family", "short"), "short", "left_anti")
    of = seen.groupBy("short").agg(F.count("*").alias("families"))
    hits = seen.join(persons, "family").groupBy("short", "given").agg(F.count("*").alias("hits"))
    total = families.count()
    common = persons.groupBy("given").agg(F.count("*").alias("bearers"))
    share = F.col("hits") / F.col("families")
    chance = F.col("bearers") / F.lit(total)
    # a token that a slip explains as well is no nickname
    slipped = F.max(F.when(_one_slip("short", "given"), F.col("hits"))).over(Window.partitionBy("short"))
    hits = hits.withColumn("slipped", F.coalesce(slipped, F.lit(0))).where("hits > slipped").drop("slipped")
    known = hits.join(of, "short").join(common, "given")
    return known.where((share >= LEAST_SHARE) & (F.col("hits") * F.log(share / chance) >= LEAST_EVIDENCE) & (F.col("short") != F.col("given"))).select("short", "given")


def links(mentions: DataFrame, contributors: DataFrame, known_nicknames: DataFrame | None = None) -> DataFrame:
    """``value, part, contributor_id, score, exact`` for each distinct value of ``mentions.value``.

    Each name in a value has at most one link: its best one, none where two entries are equally good, so
    namesakes stay apart. ``exact``: the name is spelled as in the register. Null, empty and blank values
    have no names. The work is on distinct names, however often each is typed; a long value is split whole.
    ``known_nicknames`` may add pairs of ``short, given`` to those learned.
    """
    parts = stored(_parts(mentions.where(F.col("value").isNotNull()).select("value").distinct()))
    register = stored(_register(contributors))
    entries = register.count()
    names = stored(parts.select("norm", "tokens").dropDuplicates(["norm"]))
    said = names.select("norm", F.explode(F.array_distinct("tokens")).alias("token"))
    spread = register.select("contributor_id", "person", F.explode(F.array_distinct("tokens")).alias("token"))
    often = spread.groupBy("token").agg(F.log(1 + F.lit(entries) / F.count("*")).alias("weight"))
    weighted = stored(spread.join(often, "token"))
    fused = register.select("contributor_id", F.explode("keys").alias("known"))
    known = weighted.select("token").unionByName(fused.select(F.col("known").alias("token"))).distinct()
    weights = weighted.groupBy(F.col("token").alias("known")).agg(F.first("weight").alias("weight"))
    similar = stored(similar_tokens(said.select("token").distinct(), known).join(weights, "known", "left"))
    shorts = nicknames(names, register)
    if known_nicknames is not None:
        shorts = shorts.unionByName(known_nicknames.select("short", "given")).distinct()
    called = stored(said.join(shorts.withColumnRenamed("short", "token"), "token").select("norm", "token", "given"))
    # organisations by their two rarest tokens, logins whole, persons by family name and an initial
    rarest = Window.partitionBy("contributor_id").orderBy(F.desc("weight"), "token")
    organisations = weighted.where("NOT person").withColumn("no", F.row_number().over(rarest)).where("no <= 2").select("contributor_id", F.col("token").alias("known"))
    heard = said.join(similar, "token")
    by_token = heard.select("norm", "known").join(organisations.unionByName(fused), "known").select("norm", "contributor_id")
    initials = said.select("norm", F.substring("token", 1, 1).alias("initial")).unionByName(called.select("norm", F.substring("given", 1, 1).alias("initial"))).distinct()
    posted = register.where("person AND size(tokens) > 1").select("contributor_id", F.element_at("tokens", -1).alias("known"), F.substring(F.element_at("tokens", 1), 1, 1).alias("initial"))
    families = heard.select("norm", "known").join(posted.select("known").distinct(), "known", "left_semi")
    by_family = families.join(initials, "norm").join(posted, ["known", "initial"]).select("norm", "contributor_id")
    candidates = by_token.unionByName(by_family).distinct()
    unheard = F.log(F.lit(1.0 + entries))
    pair = lambda a, b: F.collect_list(F.struct(a, b))
    spoken = said.join(similar.groupBy("token").agg(F.max("weight").alias("weight")), "token", "left").groupBy("norm").agg(pair(F.col("token"), F.coalesce("weight", unheard)).alias("typed"))
    named = weighted.groupBy("contributor_id").agg(pair(F.col("token"), F.col("weight")).alias("named"))
    whole = register.select("contributor_id", "person", F.col("tokens").alias("entry")).join(named, "contributor_id")
    about = names.join(spoken, "norm").join(called.groupBy("norm").agg(F.collect_set(F.struct("token", "given")).alias("called")), "norm", "left")
    pairs = candidates.join(about, "norm").join(whole, "contributor_id").select("norm", "contributor_id", "person", "tokens", "entry", "typed", "named", "called")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = lambda x: dict(tuple(y.values()) for y in x)
        for b in batches:
            score = []
            for person, typed, entry, said_w, entry_w, shorts in zip(*(b.column(i).to_pylist() for i in range(2, 8))):
                if person:
                    found, least = person_score(typed, entry, both(entry_w), frozenset(tuple(x.values()) for x in shorts or ())), LEAST_PERSON
                else:
                    found, least = organisation_score(both(said_w), both(entry_w)), LEAST_ORGANISATION
                score.append(round(found, 6) if found >= least else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["norm", "contributor_id", "score"])

    verified = bounded_batches(pairs).mapInArrow(verify, "norm string, contributor_id bigint, score double").where("score > 0")
    best = verified.groupBy("norm").agg(F.max(F.struct("score", "contributor_id")).alias("a"), F.max(F.struct("score", (-F.col("contributor_id")).alias("minus"))).alias("b"))
    best = best.where(F.col("a.contributor_id") == -F.col("b.minus")).select("norm", "a.contributor_id", "a.score")
    spelled = register.select("contributor_id", "full_name")
    return (
        parts.drop("tokens").join(best, "norm").join(spelled, "contributor_id")
        .select("value", "part", "contributor_id", "score", (F.when(F.col("single"), F.col("value")).otherwise(F.col("part")) == F.col("full_name")).alias("exact"))
    )


def mentions_of(metadata: DataFrame, fields: tuple[str, ...] = ("author", "last_saved_by"), key: str = "meta_id") -> DataFrame:
    """``key, field, value`` of each field that holds something."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")
    return metadata.select(key, each).select(key, "x.*").where(F.col("value").isNotNull())


def linked(metadata: DataFrame, contributors: DataFrame) -> DataFrame:
    """``meta_id, field, part, contributor_id, score, exact`` of each name that is somebody's in the register."""
    mentions = mentions_of(metadata)
    return mentions.join(links(mentions, contributors), "value").select("meta_id", "field", "part", "contributor_id", "score", "exact")


def variants(metadata: DataFrame, contributors: DataFrame) -> DataFrame:
    """``meta_id, field, contributor_id``: contributors named under a spelling other than the registered one, once each."""
    mentions = mentions_of(metadata)
    found = links(mentions, contributors).where(~F.col("exact")).select("value", "contributor_id").distinct()
    return mentions.join(found, "value").select("meta_id", "field", "contributor_id").distinct()
