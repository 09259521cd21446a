"""Variant spellings of people's and organisations' names. A symmetric-delete index over tokens finds spellings one edit
apart; ids that share an issuer and two such tokens are compared, spelling by spelling, by an optimal assignment of their tokens,
in which initials, abbreviations and familiar forms match."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.titles import levenshtein, one_typo
from attestry.session import cut

#: Given names with their familiar, shortened and foreign forms.
FAMILIAR = {
    "abigail": "abby gail abbie", "alexander": "alex sandy xander alec", "anthony": "tony anth", "barbara": "barb babs barbie", "benjamin": "ben benny benj",
    "charles": "chuck charlie chas carlos", "christopher": "chris kit topher", "cynthia": "cindy cyndi", "daniel": "dan danny", "deborah": "deb debra debbie",
    "dorothy": "dot dottie dolly", "douglas": "doug", "edward": "ed ted ned eddie edw", "eleanor": "ellie nell nora elinor", "elizabeth": "liz beth betty eliza lizzie libby betsy",
    "florence": "flo flossie", "francisco": "paco pancho", "frederick": "fred freddy fredk fritz", "geoffrey": "geoff jeff jeffrey", "george": "geo", "gerald": "gerry jerry",
    "giuseppe": "beppe", "gregory": "greg gregg", "gwendolyn": "gwen wendy", "harold": "harry hal", "henrietta": "etta hetty hattie", "ignatius": "iggy",
    "isabella": "bella izzy isabel", "james": "jim jimmy jas jamie", "jennifer": "jen jenny", "jonathan": "jon jonny johnathan", "joseph": "joe jos joey", "john": "johnny jack jno",
    "katherine": "kate kathy katie catherine kathryn kat", "kenneth": "ken kenny", "lawrence": "larry laurence lars", "leonard": "len lenny leo", "margaret": "peggy meg maggie marge",
    "matthew": "matt", "michael": "mike mick mickey mikey michl", "mohammed": "muhammad mohamed mohammad", "nicholas": "nick nicolas nicky", "patricia": "pat patty tricia trish",
    "philip": "phil phillip", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "bob rob robt bobby robbie", "ronald": "ron ronnie",
    "samuel": "sam sammy saml", "steven": "steve stephen", "susan": "sue susie suzie suzy", "theodore": "theo ted teddy", "thomas": "tom tommy thos", "timothy": "tim timmy",
    "ursula": "uschi", "victoria": "vicky tori vicki", "vladimir": "wladimir vlad", "walter": "wally walt", "william": "bill will wm billy willy",
    "ximena": "jimena", "yusuf": "yousef youssef joseph", "zachary": "zach zack",
}
#: Words of organisations' names with their abbreviations.
COMPANY = {
    "associates": "assoc assocs", "capital": "cap cptl", "company": "co", "corporation": "corp", "equity": "eq eqty", "fund": "fd fnd", "group": "grp", "growth": "grth gr",
    "holdings": "hldg hldgs holding", "incorporated": "inc", "infrastructure": "infra infrastr", "international": "intl int", "investments": "invs inv invt invts investment", "limited": "ltd",
    "management": "mgmt mgt", "opportunity": "opp oppty", "partners": "ptnrs prtnrs ptrs", "private": "pvt priv", "sciences": "sci scis", "situations": "sits sit",
    "special": "spec spl", "trust": "tr", "venture": "vent vntr ven", "asset": "ast", "life": "lf", "llc": "", "lp": "", "plc": "", "ventures": "vents",
}
#: Degrees and honours, which are no part of a name, and generational suffixes.
HONOURS = frozenset("md phd cpa esq dds jd mba cfa dr mr mrs ms prof dvm do rn pe".split())
GENERATION = frozenset("jr sr ii iii iv v2nd 2nd 3rd".split())

FORMAL = {f: {k for k, v in FAMILIAR.items() if f in v.split()} for v in FAMILIAR.values() for f in v.split()}
EXPANDED = {a: k for k, v in COMPANY.items() for a in v.split()}
#: Accented Latin letters, by rule: those whose decomposition begins with a plain one.
_MARKED = [c for c in map(chr, range(0xE0, 0x250)) if c == c.lower() and len(unicodedata.normalize("NFKD", c)) == 2 and unicodedata.normalize("NFKD", c)[0].isascii()] + ["ø", "ł", "đ"]
ACCENTED, BARE = "".join(_MARKED), "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED[:-3]) + "old"
#: Characters that are dropped: stops, apostrophes, hyphens and combining marks.
DROPPED = ".'’‘ʼ-‐‑\u0300\u0301\u0302\u0303\u0308\u030a\u030c\u0327"

#: A middle initial counts if so many of an id's rows have it; two tokens one edit apart are two names if both are
#: those of several ids and neither is rare beside the other.
INITIAL_SHARE, LEAST_IDS, RARE_SHARE = 0.25, 3, 0.2
#: Two spellings that each have a typo of their own are two edits apart: rare tokens of so many letters are compared so.
LONG_TOKEN = 7


def name_tokens(c: str) -> Column:
    """Lower-case words: full stops, apostrophes and hyphens dropped, accents taken off, other punctuation a blank."""
    plain = F.translate(F.lower(F.col(c)), ACCENTED + DROPPED, BARE)
    return F.filter(F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def votes(rows: DataFrame) -> DataFrame:
    """(person, k, v, n, o) from (person, name): how many of an id's rows have a spelling of the long tokens (k l), a first
    initial (i) or a suffix (g). Spellings of the same tokens are one, whatever their order; o is the first in text order.

    Folded map-side by id, kind and value, so an id with a third of all rows is no burden. Rows without a name or an id
    have no vote.
    """
    words = F.filter(name_tokens("name"), lambda w: ~w.isin(*HONOURS))
    base = rows.where(F.col("person").isNotNull()).select("person", words.alias("w")).where(F.size("w") > 0)
    long_ = F.array_join(F.filter("w", lambda x: (F.length(x) > 1) & ~x.isin(*GENERATION)), " ")
    initial = F.get(F.filter("w", lambda x: (F.length(x) == 1) & x.rlike("[a-z]")), F.lit(0))
    generation = F.get(F.filter("w", lambda x: x.isin(*GENERATION)), F.lit(0))
    each = base.select("person", F.explode(F.array(F.struct(F.lit("l").alias("k"), F.array_join(F.array_sort(F.split(long_, " ")), " ").alias("v"), long_.alias("o")), F.struct(F.lit("i").alias("k"), initial.alias("v"), F.lit("").alias("o")), F.struct(F.lit("g").alias("k"), generation.alias("v"), F.lit("").alias("o")))).alias("x")).select("person", "x.*").where(F.col("v").isNotNull())
    return each.groupBy("person", "k", "v").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))


def _best(counts: DataFrame) -> DataFrame:
    """Per id the spelling, initial and suffix that most of its votes have. Ties go to the longer one, then to the smaller
    text."""
    top = lambda k, value, by: F.max_by(F.when(F.col("k") == k, F.col(value)), F.when(F.col("k") == k, by))
    rank = F.struct(F.col("n"), F.length("v"), F.col("v"))
    best = counts.groupBy("person").agg(top("l", "o", rank).alias("spelt"), top("l", "v", rank).alias("folded"), top("i", "v", rank).alias("i"), F.max(F.when(F.col("k") == "i", F.col("n"))).alias("ni"), F.sum(F.when(F.col("k") == "l", F.col("n"))).alias("n"), top("g", "v", rank).alias("generation"))
    return best.select("person", "spelt", "folded", F.when(F.col("ni") >= F.col("n") * INITIAL_SHARE, F.col("i")).alias("initial"), "generation")


def _tokens(c: str) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "").alias("tokens")


def profiles(rows: DataFrame) -> DataFrame:
    """(person, tokens, initial, generation) from (person, name): the spelling of the long tokens that most of an id's
    rows have, the initial that enough have, the suffix that most have."""
    return _best(votes(rows)).select("person", _tokens("spelt"), "initial", "generation")


def spellings(rows: DataFrame) -> DataFrame:
    """(person, spelling, top, tokens, initial, generation) from (person, name): a row for every spelling of the long
    tokens that an id has, top on the one that most of its rows have; initial and suffix are the id's, by vote. One word
    alone speaks for an id only if it is the top spelling: a row that leaves out the rest says nothing of it."""
    counts = cut(votes(rows))
    own = counts.where("k = 'l'").select("person", F.col("v").alias("spelling"), _tokens("o")).join(_best(counts).select("person", "folded", "initial", "generation"), "person")
    return own.withColumn("top", F.col("spelling") == F.col("folded")).where(F.col("top") | (F.size("tokens") > 1)).select("person", "spelling", "top", "tokens", "initial", "generation")


def deletes(t: str) -> set[str]:
    return {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}


def rare_and_long(t: str, n: int) -> bool:
    return n < LEAST_IDS and len(t) >= LONG_TOKEN


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deletes(t: pd.Series, n: pd.Series) -> pd.Series:
    """What a token is indexed under: two letters deleted from rare long ones, one from others, none from those of up to
    three letters, in which a typo leaves another word."""
    two = lambda x: {e for d in deletes(x) for e in deletes(d)}
    return pd.Series([sorted(two(x) if rare_and_long(x, m) else deletes(x) if len(x) > 3 else [x]) for x, m in zip(t, n, strict=True)], dtype=object)


def close(a: str, na: int, b: str, nb: int) -> bool:
    """One edit or swap apart, or two if both are rare and long."""
    return one_typo(a, b) or rare_and_long(a, na) and rare_and_long(b, nb) and levenshtein(a, b) <= 2


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
    return pd.Series([close(*x) for x in zip(a, na, b, nb, strict=True)], dtype=bool)


def token_index(prof: DataFrame) -> DataFrame:
    """(token, n, up): for every token how many ids have it in their top spelling, and the close tokens that more ids
    have.

    Two tokens one edit apart share a string with one letter deleted, two edits apart one with two deleted. Each token names only its more frequent
    neighbours, so two spellings meet at the more frequent one and rare ones at the name they stem from.
    """
    vocabulary = cut(prof.select("top", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count_if("top").alias("n")))
    tasks = max(prof.sparkSession.sparkContext.defaultParallelism, int(prof.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    index = vocabulary.repartition(tasks, "token").select("token", "n", F.explode(_deletes("token", "n")).alias("d"))  # a token has some hundred deletions
    other = index.select(F.col("token").alias("t2"), F.col("n").alias("n2"), "d")
    pairs = index.join(other.hint("merge"), "d").where((F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("t2") > F.col("token")))).select("token", "n", "t2", "n2").distinct()
    ups = pairs.where(_near("token", "n", "t2", "n2")).groupBy("token").agg(F.sort_array(F.collect_list("t2")).alias("up"))  # one edit's reach
    return vocabulary.join(ups, "token", "left").select("token", "n", F.coalesce("up", F.array().cast("array<string>")).alias("up"))


#: The given names by their deletions, for tokens that spell one of them with a typo.
_NAMES_BY_DELETION: dict[str, set[str]] = {}
for _n in {*FAMILIAR, *FORMAL}:
    for _d in deletes(_n) if len(_n) > 3 else ():
        _NAMES_BY_DELETION.setdefault(_d, set()).add(_n)


@lru_cache(maxsize=100_000)
def meant(t: str) -> frozenset[str]:
    """Given names one edit away from a token that is none."""
    if t in FAMILIAR or t in FORMAL or not 3 < len(t) < 20:
        return frozenset()
    return frozenset(x for d in deletes(t) for x in _NAMES_BY_DELETION.get(d, ()) if one_typo(t, x))


def keys_of(t: str, up: Iterable[str]) -> set[str]:
    """What a token may be looked up under."""
    own = {EXPANDED.get(x, x) for x in (t, *up)} | meant(t)
    return own | {f for x in own for f in FORMAL.get(x, ())}


def name_keys(tokens: list[tuple[str, int, list[str]]]) -> set[str]:
    """Unordered pairs of keys of two tokens; neighbours are also tried as one token that a blank parted. A pair of two
    words that any organisation may have says nothing."""
    spans = [((i, i), t, up) for i, (t, _, up) in enumerate(tokens)]
    spans += [((i, i + 1), tokens[i][0] + tokens[i + 1][0], []) for i in range(len(tokens) - 1)]
    looked = [(span, keys_of(t, up)) for span, t, up in dict.fromkeys((s, t, tuple(u)) for s, t, u in spans)]
    out: set[str] = set()
    for (own, ks), (other, ls) in combinations(looked, 2):
        if own[1] < other[0] or other[1] < own[0]:
            if own[0] == own[1] or other[0] == other[1]:  # one blank too many at most
                out |= {"|".join(sorted((x, y))) for x, y in product(ks, ls) if x not in COMPANY or y not in COMPANY}
    for (lo, hi), ks in looked:
        if hi - lo + 1 == len(tokens):
            out |= {f"{k}|" for k in ks}
    return out


def token_match(a: str, na: int, b: str, nb: int) -> int:
    """3: same or familiar form; 2: an abbreviation or one edit apart; 1: an initial; 0: no match."""
    if len(a) == 1 or len(b) == 1:
        return (1 if len(a) != len(b) else 3) if a[0] == b[0] else 0
    x, y = EXPANDED.get(a, a), EXPANDED.get(b, b)
    if x == y or (FORMAL.get(x, {x}) | {x}) & (FORMAL.get(y, {y}) | {y}):
        return 3
    if x in COMPANY or y in COMPANY:
        short, full = sorted((x, y), key=len)
        return 2 if full in COMPANY and (len(short) >= 3 and full.startswith(short) or one_typo(x, y)) else 0
    if min(len(a), len(b)) >= 4 and close(a, na, b, nb):
        rare, often = sorted((na, nb))
        return 0 if rare >= LEAST_IDS and rare > often * RARE_SHARE else 2
    for u, v in ((a, b), (b, a)):  # a familiar form beside a formal one with a typo, or the other way round
        if len(u) > 3 and u not in FAMILIAR and u not in FORMAL and any(one_typo(u, f) for f in (*FAMILIAR.get(v, "").split(), *FORMAL.get(v, ())) if len(f) > 3):
            return 2
    return 0


def best_assignment(gain: list[list[int]]) -> list[int]:
    """For each row the column that it gets, so that the sum of gains is the largest; no column twice. At most as many
    rows as columns. Shortest augmenting paths with potentials, one row after another."""
    n, k = len(gain), len(gain[0]) if gain else 0
    row_pot, col_pot, held = [0] * n, [0] * k, [-1] * k
    for start in range(n):
        far, via, done = [float("inf")] * k, [-1] * k, [False] * k
        row, at = start, -1
        while True:
            near, step = -1, float("inf")
            for j in range(k):
                if not done[j]:
                    slack = row_pot[row] + col_pot[j] - gain[row][j]
                    base = 0 if at < 0 else far[at]
                    if base + slack < far[j]:
                        far[j], via[j] = base + slack, at
                    if far[j] < step:
                        near, step = j, far[j]
            at = near
            done[at] = True
            if held[at] < 0:
                break
            row = held[at]
        end = far[at]
        for j in range(k):
            if done[j]:
                col_pot[j] += end - far[j]
                if held[j] >= 0:
                    row_pot[held[j]] -= end - far[j]
        row_pot[start] -= end
        while via[at] >= 0:
            held[at] = held[via[at]]
            at = via[at]
        held[at] = start
    out = [-1] * n
    for j, i in enumerate(held):
        if i >= 0:
            out[i] = j
    return out


def assign(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> tuple[int, int, int]:
    """The best assignment of the shorter list's tokens to the other's, however many: (matched, matched long ones, score).

    Tokens that can only match each other are settled at once; the rest are assigned optimally, by number matched, then
    long ones, then score."""
    if len(a) > len(b):
        a, b = b, a
    m = [[token_match(x, nx, y, ny) for y, ny in b] for x, nx in a]
    full = lambda i, j: m[i][j] >= 2 and min(len(a[i][0]), len(b[j][0])) > 1
    rows = [[j for j, s in enumerate(r) if s] for r in m]
    seen = [sum(bool(r[j]) for r in m) for j in range(len(b))]
    pairs = [(i, js[0]) for i, js in enumerate(rows) if len(js) == 1 and seen[js[0]] == 1]
    settled = {i for i, _ in pairs}
    open_ = [i for i, js in enumerate(rows) if js and i not in settled]
    if open_:
        cols = sorted({j for i in open_ for j in rows[i]})
        unit = 4 * (len(a) + 1)  # more than all scores together
        gain = [[unit * unit + full(i, j) * unit + m[i][j] if m[i][j] else 0 for j in cols] + [0] * len(open_) for i in open_]
        pairs += [(i, cols[j]) for i, j in zip(open_, best_assignment(gain), strict=True) if j < len(cols) and m[i][cols[j]]]
    return len(pairs), sum(full(i, j) for i, j in pairs), sum(m[i][j] for i, j in pairs)


def _with_initial(tokens: list[tuple[str, int]], initial: str | None) -> list[tuple[str, int]]:
    if not initial or len(tokens) > 2 and any(t[0] == initial for t, _ in tokens[1:]) and not any(t in COMPANY for t, _ in tokens):
        return tokens
    return [*tokens, (initial, 0)]


def _rejoined(t: list[tuple[str, int]], other: list[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
    """The tokens with two neighbours as one that a blank parted, where the other name has such a token."""
    for i in range(len(t) - 1):
        one = t[i][0] + t[i + 1][0]
        if any(token_match(one, 0, y, n) >= 2 for y, n in other):
            yield [*t[:i], (one, 0), *t[i + 2 :]]


def same_name(a: tuple, b: tuple) -> bool:
    """Whether two profiles (tokens with counts, initial, generation) are spellings of one name: no part of one
    contradicts the other's, and two long tokens, or the only one, match. A part that one omits contradicts nothing."""
    (ta, ia, ga), (tb, ib, gb) = a, b
    if ga and gb and ga != gb:
        return False
    tries = [(ta, tb), *((x, tb) for x in _rejoined(ta, tb)), *((ta, y) for y in _rejoined(tb, ta))]
    for x, y in tries:
        u, v = _with_initial(x, ia), _with_initial(y, ib)
        matched, longs, _ = assign(u, v)
        if matched == min(len(u), len(v)) and longs >= min(2, len(x), len(y)):
            return True
    return False


PROFILE = "person bigint, spelling string, tokens array<string>, n array<bigint>, keys array<string>, initial string, generation string"


def indexed(prof: DataFrame) -> DataFrame:
    """Spellings with the number of ids that have each token, and the keys to meet under."""
    each = prof.select("person", "spelling", F.posexplode("tokens").alias("at", "token")).join(token_index(prof), "token")
    back = each.groupBy("person", "spelling").agg(F.sort_array(F.collect_list(F.struct("at", "token", "n", "up"))).alias("t"))  # a name's tokens

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = [[(x["token"], x["n"], list(x["up"])) for x in own] for own in b["t"]]
            yield pd.DataFrame({"person": b["person"], "spelling": b["spelling"], "tokens": [[x[0] for x in own] for own in t], "n": [[x[1] for x in own] for own in t], "keys": [sorted(name_keys(own)) for own in t], "initial": b["initial"], "generation": b["generation"]})

    return back.join(prof.select("person", "spelling", "initial", "generation"), ["person", "spelling"]).mapInPandas(run, PROFILE)


@F.pandas_udf(T.BooleanType())
def _same(ta: pd.Series, na: pd.Series, ia: pd.Series, ga: pd.Series, tb: pd.Series, nb: pd.Series, ib: pd.Series, gb: pd.Series) -> pd.Series:
    tokens = lambda t, n: list(zip(t.tolist(), n.tolist(), strict=True))
    return pd.Series([same_name((tokens(a, m), i, g), (tokens(b, n), j, h)) for a, m, i, g, b, n, j, h in zip(ta, na, ia, ga, tb, nb, ib, gb, strict=True)], dtype=bool)


def same_filers(rows: DataFrame) -> DataFrame:
    """(person_a, person_b), person_a < person_b: ids with a common issuer of which any two spellings are of one name.

    rows: person bigint, issuer bigint, name string. Every spelling of an id is indexed; ids meet under a hash of the issuer and two tokens, never under an
    issuer or a surname alone, so a hot one makes no product; only ids that meet are compared. Rows without an issuer
    take no part in meeting but vote on the spelling; rows without an id are left out, and ids of which no row has a word
    for a name match none. Repeated rows add votes and change no pair. Names of any number of words are assigned optimally.
    Only the three columns are read, whatever others there are; an empty table gives no pairs.
    """
    prof = cut(indexed(cut(spellings(rows))))
    held = rows.where(F.col("person").isNotNull() & F.col("issuer").isNotNull()).select("person", "issuer").distinct()
    meets = held.join(prof.select("person", F.explode("keys").alias("key")).distinct(), "person").select("person", F.xxhash64("issuer", "key").alias("h"))
    shared = meets.groupBy("h").agg(F.min("person").alias("lo"), F.max("person").alias("hi")).where("lo < hi").select("h")
    met = cut(meets.join(shared, "h"))
    pairs = met.select("h", F.col("person").alias("person_a")).join(met.select("h", F.col("person").alias("person_b")), "h").where("person_a < person_b").select("person_a", "person_b").distinct()
    side = lambda s: prof.select(F.col("person").alias(f"person_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("tokens", "n", "initial", "generation")])
    both = pairs.join(side("a"), "person_a").join(side("b"), "person_b")
    return both.where(_same(*[f"{c}_{s}" for s in "ab" for c in ("tokens", "n", "initial", "generation")])).select("person_a", "person_b").distinct()
