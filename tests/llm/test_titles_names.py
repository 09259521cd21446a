"""Titles against a list and names against each other."""

import itertools
import random

import pytest

from attestry.llm import names as n
from attestry.llm import titles as t

REF = [(1, "Chief Executive Officer"), (2, "President and Chief Executive Officer"), (3, "Executive Vice President and Chief Financial Officer"), (4, "Vice President, Finance"), (5, "Controller"), (6, "Chief Information Officer"), (7, "Senior Vice President"), (8, "Senior Vice President, Sales"), (9, "Chairman of the Board"), (10, "Executive Vice President, Research and Development"), (11, "President"), (12, "General Counsel and Secretary"), (13, "General Counsel")]


def reference():
    return t.Reference(REF, t.Speller([x for _, x in REF]))


@pytest.mark.parametrize(
    ("typed", "entry"),
    [
        ("CEO", 1), ("C.E.O. (interim)", 1), ("Cheif Executive Officer", 1), ("chief executiveofficer", 1), ("Chief Exec. Offcr - see remarks", 1), ("Pres/CEO", 2), ("ceo & pres", 2), ("Presidnt and Chief Executive Officer*", 2), ("pres. andc.e.o.", 2),
        ("CFO and Exec. VP", 3), ("EVP - CFO (through year end)", 3), ("VP Finance", 4), ("finance vice pres.", 4), ("corporate controller", 5), ("Comptroller (1)", 5), ("Information Officer (Chief)", 6), ("Senior Vice Pressident, S", 8), ("Sr VP", 7), ("sales svp", 8),
        ("board chair", 9), ("R&D Exec. Vice Presid", 10), ("company president", 11), ("gen. counsel & sec'y of subsidiary", 12), ("General Counsel and Secreta", 12), ("gc", 13),
        ("Founder", None), ("Chief Happiness Officer", None), ("see remarks", None), ("counselor", None), ("presidio site lead", None), ("*", None), ("n/a", None), ("", None), ("x" * 20_000, None),
    ],
)
def test_titles(typed, entry):
    got = reference().look_up(typed)
    assert (got[2] if got else None) == entry


@pytest.mark.parametrize(
    ("typed", "entry"),
    [("CEO", 1), ("Chief Exec. Offcr", 1), ("C.E.O. (interim)", 1), ("Pres and CEO", 2), ("EVP and CFO", 3), ("VP Finance", 4), ("cio", 6), ("svp", 7), ("sales svp", 8), ("gc", 13), ("Cheif Executive Officer", 1), ("CXO", None), ("chief cat officer", None), ("Founder", None), ("port site lead", None)],
)
def test_abbreviations_by_rule_alone(typed, entry):
    got = t.Reference(REF, t.Speller([x for _, x in REF], {})).look_up(typed)
    assert (got[2] if got else None) == entry


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


def test_distance_and_tree_against_brute_force():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(150)]
    tree = t.BKTree()
    for i, w in enumerate(words):
        tree.add(w, i)
    for q in words[:40]:
        assert all(t.levenshtein(q, w) == slow_distance(q, w) for w in words)
        assert sorted(v for _, _, v in tree.within(q, 2)) == [i for i, w in enumerate(words) if slow_distance(q, w) <= 2]
    assert t.one_typo("abcd", "abdc") and not t.one_typo("abcd", "badc") and t.one_typo("abcd", "abd")


def test_rows_shards_and_clashing_columns(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "CEO", 99), (2, None, 99), (3, " ", 99), (4, "Founder", 99), (5, "ceo", 99)], "row_id bigint, title_raw string, title_id int")
    ref = spark.createDataFrame([(*r, "x") for r in REF] + [(50, None, "x")], "title_id bigint, canonical_title string, title_class string")
    want = {1: 1, 2: None, 3: None, 4: None, 5: 1}
    assert {r["row_id"]: r["title_id"] for r in t.map_rows(rows, ref).collect()} == want
    assert "REPARTITION_BY_NUM" in t.map_values(rows, ref)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(t, "SHARD_ENTRIES", 4)
    assert {r["row_id"]: r["title_id"] for r in t.map_rows(rows, ref).collect()} == want
    assert t.map_rows(rows.where("false"), ref).count() == 0
    assert {r["title_id"] for r in t.map_rows(rows, ref.where("false")).collect()} == {None}


SAME = [("SMITH JOHN A", "John Smith"), ("O'BRIEN JOHN", "OBRIEN, JOHN"), ("SMYTHE WILLIAM", "smythe bill"), ("QUILLFORD ANN NOEL", "Ann N. Quillford"), ("QUILLFORD ANN MD", "QUILFORD ANN"), ("LINUMSÉN BARBARA", "LINUMSEN BARB"), ("QUIL LFORD ANN", "QUILLFORD ANN"), ("Vinter Venture Associates Ltd", "VINTER VENT ASSOC LIMITED"), ("QUILLFORD ROBERT JR", "Quillford Bob"), ("QUILLFORD THOMAAS", "QUILLFORD TOM")]
OTHER = [("SMITH JOHN A", "SMITH JOHN B"), ("SMITH JOHN JR", "SMITH JOHN SR"), ("SMITH SUSAN", "SMITH STEVEN"), ("SMITH MARTIN", "SMITH MARTINA"), ("SMITH ANN PERRY", "SMITH ANN PAULA"), ("SMITH JOHN", "JONES JOHN"), ("Vinter Venture Associates Ltd", "Vinter Venture Partners LP"), ("SMITH JOHN", "SMITH JANE")]


def filers(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "person bigint, issuer bigint, name string, tokens string")
    return {(r["person_a"], r["person_b"]) for r in n.same_filers(df).collect()}


def test_names(spark):
    rows, want = [], set()
    for i, (a, b) in enumerate(SAME + OTHER):
        rows += [(2 * i, i, a), (2 * i + 1, i, b)]
        want |= {(2 * i, 2 * i + 1)} if i < len(SAME) else set()
    common = [(1000 + 10 * i + j, 5000 + 10 * i + j, f"{x} W{'abcdefghij'[i]}zzq{'klmnopqrst'[j]}") for i, x in enumerate(["MARTIN", "MARTINA", "JOHN"]) for j in range(6)]
    assert filers(spark, rows + common) & {(2 * i, 2 * i + 1) for i in range(len(SAME + OTHER))} == want


def test_an_issuer_must_be_shared_and_groups_are_whole(spark):
    rows = [(1, 5, "DOE JANE"), (2, 6, "DOE JANE"), (3, 7, "ROE ANN"), (4, 7, "ANN ROE"), (5, 7, "Roe, Ann M.D."), (6, None, "ROE ANN"), (None, 7, "ROE ANN"), (7, 7, None), (8, 7, ""), (9, 7, " . ")]
    assert filers(spark, rows) == {(3, 4), (3, 5), (4, 5)}
    assert filers(spark, rows * 3) == {(3, 4), (3, 5), (4, 5)}
    assert filers(spark, []) == set()


def test_hot_surname_and_long_names(spark):
    rows = [(i, 1, f"BARABLEY {''.join('abcdefghij'[int(c)] for c in str(1000 + i * 37))}") for i in range(120)]
    rows += [(900, 1, "BARABLEY " + "x" * 3000), (901, 1, "barabley " + "X" * 3000), (902, 1, " ".join(f"word{'abcdefgh'[i]}" for i in range(8)))]
    got = filers(spark, rows)
    assert (900, 901) in got and len(got) < 60


def test_consensus_outvotes_typos(spark):
    rows = [(1, 5, "QUILLFORD ANN")] * 5 + [(1, 5, "QXILLFORD ANN X")] + [(2, 5, "QUILLFORD ANN B")] * 3
    prof = {r["person"]: (r["tokens"], r["initial"]) for r in n.profiles(spark.createDataFrame(rows, "person bigint, issuer bigint, name string")).collect()}
    assert prof == {1: (["quillford", "ann"], None), 2: (["quillford", "ann"], "b")}


def test_assignment_is_the_best_one():
    rng = random.Random(9)
    pool = ["ann", "anna", "a", "bill", "william", "w", "ltd", "limited", "quill", "quilt"]
    for _ in range(60):
        a, b = ([(x, 1) for x in rng.sample(pool, rng.randrange(1, 5))] for _ in range(2))
        small, large = sorted((a, b), key=len)
        best = max(sum(n.token_match(*x, *y) > 0 for x, y in zip(small, p, strict=True)) for p in itertools.permutations(large, len(small)))
        assert n.assign(a, b)[0] == best


def dp_matching(match):
    """The most rows matched, by a table over subsets of the columns."""
    best = {0: 0}
    for row in match:
        nxt = dict(best)
        for used, n in best.items():
            for j, ok in enumerate(row):
                if ok and not used >> j & 1:
                    nxt[used | 1 << j] = max(nxt.get(used | 1 << j, 0), n + 1)
        best = nxt
    return max(best.values())


def test_long_names_are_assigned_optimally():
    rng = random.Random(3)
    pool = ["ann", "anna", "a", "b", "bob", "bill", "robert", "rob", "william", "w", "will", "ltd", "limited", "quill", "quilt", "quil", "marsh", "marshe"]
    for _ in range(40):
        a, b = ([(x, 1) for x in rng.sample(pool, rng.randrange(7, 13))] for _ in range(2))
        small, large = sorted((a, b), key=len)
        match = [[n.token_match(*x, *y) > 0 for y in large] for x in small]
        assert n.assign(a, b)[0] == dp_matching(match)
    five = [(w, 1) for w in "aaaaa bbbbb ccccc ddddd eeeee".split()]
    a, b = [("b", 1), ("robert", 1), *five], [("rob", 1), ("bob", 1), *five]
    assert n.assign(a, b)[0] == 7 and n.same_name((a, None, None), (b, None, None))


def test_assignment_by_gain_against_permutations():
    rng = random.Random(5)
    for _ in range(200):
        k = rng.randrange(1, 7)
        gain = [[rng.randrange(9) for _ in range(k)] for _ in range(rng.randrange(1, k + 1))]
        got = n.best_assignment(gain)
        assert len(set(got)) == len(gain)
        assert sum(r[j] for r, j in zip(gain, got, strict=True)) == max(sum(r[j] for r, j in zip(gain, p, strict=True)) for p in itertools.permutations(range(k), len(gain)))


def test_two_rare_spellings_with_a_typo_each(spark):
    rows = [(1, 5, "Vimterhall Venture PARTNERS LP"), (2, 5, "Vinterhaall Venture PARTNERS LP"), (3, 5, "Vonterholl Venture PARTNERS LP"), (4, 6, "ROE ANN"), (5, 6, "RAY ANN")]
    assert filers(spark, rows) == {(1, 2)}


def test_keys_of_a_name_with_many_words():
    many = [(f"w{i}", 1, []) for i in range(200)]
    assert len(n.name_keys(many)) < 200 * 200 * 2 and "w0|w199" in n.name_keys(many)


def test_any_two_spellings_of_two_ids_may_match(spark):
    rows = [(1, 5, "NURBUNCBROOK RICHARD")] * 4 + [(2, 5, "NUBUNCBOOK RICHARD")] * 2 + [(2, 5, "Nurbuncbrook Richard CPA")]
    rows += [(3, 6, "VILLDROP ANN")] * 2 + [(3, 6, "ANN")] + [(4, 6, "QUENDAL ANN")] * 2 + [(4, 6, "ANN")]
    rows += [(5, 7, "ORMWELL ANN B")] * 3 + [(6, 7, "OMRWEL ANN C")] * 3 + [(6, 7, "ORMWELL ANN")]
    assert filers(spark, rows) == {(1, 2)}
