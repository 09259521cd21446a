"""Mapping typed titles to the entries of a reference list. Distinct values are spelt out (abbreviations, word order,
notes) and looked up in a BK-tree over the reference under edit distance: the triangle inequality prunes, every entry
within the threshold is returned, and the winners of shards are merged."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import broadcast_if_small, cut

#: Reference entries per tree; a longer list is parted into shards that every value is looked up in.
SHARD_ENTRIES = 20_000
#: A prefix of an entry stands for it, for values that a field cut off, if it has this share of its letters.
LEAST_PREFIX = 0.6

#: A word is taken for an abbreviation by rule if it has so many letters.
LEAST_SHORT = 3

#: Abbreviations of title words and what they stand for, beside those that a rule gives.
SHORT = {
    "ceo": "chief executive officer", "cfo": "chief financial officer", "coo": "chief operating officer", "cto": "chief technology officer",
    "cio": "chief information officer", "ciso": "chief information security officer", "cao": "chief accounting officer", "cmo": "chief marketing officer",
    "chro": "chief human resources officer", "clo": "chief legal officer", "cco": "chief commercial officer", "cso": "chief scientific officer",
    "pao": "principal accounting officer", "gc": "general counsel", "md": "managing director", "vp": "vice president", "evp": "executive vice president",
    "svp": "senior vice president", "avp": "assistant vice president", "rd": "research development", "hr": "human resources",
    "ch": "chief", "chf": "chief", "chmn": "chairman", "chair": "chairman", "chairwoman": "chairman", "chairperson": "chairman", "bd": "board",
    "exec": "executive", "fin": "financial", "tech": "technology", "info": "information", "infor": "information", "invest": "investment", "invmt": "investment",
    "acct": "accounting", "acctg": "accounting", "mktg": "marketing", "mkt": "marketing", "res": "resources", "comml": "commercial", "comm": "commercial",
    "sci": "scientific", "med": "medical", "dep": "deputy", "asst": "assistant", "treas": "treasurer", "treasr": "treasurer", "sec": "secretary", "secy": "secretary",
    "corp": "corporate", "ofcr": "officer", "offcr": "officer", "off": "officer", "pres": "president", "sr": "senior", "gen": "general", "genl": "general", "indep": "independent",
    "ind": "independent", "dir": "director", "princ": "principal", "contr": "controller", "comptroller": "controller", "grp": "group", "eng": "engineering",
    "mng": "managing", "mgr": "manager", "dev": "development", "oper": "operating", "ops": "operations",
}
#: Words that hold no meaning here, and remarks that stand around an office.
EMPTY = frozenset("and of the".split())
REMARK = re.compile(r"\b(?:see (?:the )?remarks?(?: below)?|see (?:foot)?notes?(?: below)?|of (?:the |a )?subsidiary|through year ?end|interim|acting|retired|effective [a-z0-9 ]*|until [a-z0-9 ]*|as of [a-z0-9 ]*|(?:of )?the company)\b")
#: Words that qualify an office without changing which it is, where they lead.
LEADING = frozenset(("the", "company", "corporate"))
#: An abbreviation means another word where no "chief" is said.
WITHOUT_CHIEF = {"fin": "finance", "oper": "operations"}

_INITIALS = re.compile(r"\b(?:[a-z]\.){2,}")
_BRACKET = re.compile(r"[(\[{]([^)\]}]*)(?:[)\]}]|$)")


class Speller:
    """Words of typed titles, given the words that the reference uses and a list of abbreviations."""

    def __init__(self, entries: list[str], short: dict[str, str] | None = None) -> None:
        self.short = SHORT if short is None else short
        own = [re.findall(r"[a-z0-9]+", e.lower()) for e in entries]
        self.reference = {w for e in own for w in e} - EMPTY
        self.known = self.reference | EMPTY | {w for v in self.short.values() for w in v.split()}
        self.whole = self.known | set(self.short) | LEADING
        runs: dict[str, set[str]] = {}
        for e in own:
            said = [w for w in e if w not in EMPTY]
            for i in range(len(said)):
                for j in range(i + 2, len(said) + 1):
                    runs.setdefault("".join(w[0] for w in said[i:j]), set()).add(" ".join(said[i:j]))
        self.initials = {k: v.pop() for k, v in runs.items() if len(v) == 1}
        self.ruled: dict[str, str] = {}

    def spelt(self, w: str) -> str:
        """What an unknown word abbreviates: the one run of the reference's words that it has the initials of, or the one
        word that has its letters in their order and the same first one; of several the one that begins with it."""
        if w in self.known or not w.isalpha():
            return w
        if w not in self.ruled:
            if w in self.initials:
                self.ruled[w] = self.initials[w]
            else:
                fit = [x for x in self.reference if len(w) >= LEAST_SHORT and len(x) > len(w) and x[0] == w[0] and _in_order(w, x)]
                begun = [x for x in fit if x.startswith(w)]
                self.ruled[w] = fit[0] if len(fit) == 1 else begun[0] if len(begun) == 1 else w
        return self.ruled[w]

    def words(self, title: str) -> list[str]:
        return [w for w in self.all_words(title) if w not in EMPTY]

    def all_words(self, title: str) -> list[str]:
        """Lower-case words, abbreviations spelt out, remarks left out."""
        t = title.lower().replace("’", "'").replace("‘", "'")
        t = re.sub(r"\br\s*&\s*d\b", " rd ", t)
        t = re.sub(r"\band(?=(?:[a-z]\.){2,})", "and ", t)
        t = _INITIALS.sub(lambda m: m.group().replace(".", "") + " ", t)
        t = t.replace("'", "").replace("&", " and ")
        t = _BRACKET.sub(self._bracket, t)
        t = REMARK.sub(" ", re.sub(r"[^a-z0-9]+", " ", t))
        raw = [w for x in t.split() for w in self._parted(x)]
        chief = any((self.short.get(w) or self.spelt(w)).split()[0] == "chief" for w in raw)
        return [w for x in raw for w in (self.short[x] if x in self.short and (chief or x not in WITHOUT_CHIEF) else WITHOUT_CHIEF.get(x) or self.spelt(x)).split()]

    def _bracket(self, m: re.Match) -> str:
        """A bracket that holds title words is part of the title; any other is a note."""
        inner = re.findall(r"[a-z0-9]+", m.group(1))
        if inner and not m.group().endswith((")", "]", "}")) and any(k.startswith(inner[-1]) for k in self.known if len(k) > 4):
            return f" {' '.join(inner)} " if all(w in self.known for w in inner[:-1]) and not inner[-1].isdigit() else " "
        return f" {' '.join(inner)} " if inner and all(w in self.known for w in inner) else " "

    def _parted(self, w: str) -> list[str]:
        """A run-together word as two or three known ones."""
        if w in self.whole:
            return [w]
        for i in range(2, len(w) - 1):
            if w[:i] in self.whole and w[i:] in self.whole and min(i, len(w) - i) >= 2:
                return [w[:i], w[i:]]
        for i in range(2, len(w) - 3):
            if w[:i] in self.whole:
                for j in range(i + 2, len(w) - 1):
                    if w[i:j] in self.whole and w[j:] in self.whole:
                        return [w[:i], w[i:j], w[j:]]
        return [w]


def _in_order(short: str, word: str) -> bool:
    letters = iter(word)
    return all(c in letters for c in short)


def levenshtein(a: str, b: str) -> int:
    """Edit distance (a metric), bit-parallel over the letters of a."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    top, full = 1 << (len(a) - 1), (1 << len(a)) - 1
    plus, minus, d = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(x | plus)), plus & x
        if up & top:
            d += 1
        elif down & top:
            d -= 1
        up = (up << 1 | 1) & full
        plus, minus = (down << 1 & full) | (full & ~(x | up)), up & x
    return d


def one_typo(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b."""
    d = levenshtein(a, b)
    if d != 2 or len(a) != len(b):
        return d <= 1
    diff = [i for i in range(len(a)) if a[i] != b[i]]
    return len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]


class BKTree:
    """Strings by their distance to their parent: a subtree is visited only if the triangle inequality allows a hit."""

    def __init__(self, distance: object = levenshtein) -> None:
        self.distance, self.root = distance, None

    def add(self, text: str, value: object) -> None:
        if self.root is None:
            self.root = [text, [value], {}]
            return
        node = self.root
        while d := self.distance(node[0], text):
            if d not in node[2]:
                node[2][d] = [text, [value], {}]
                return
            node = node[2][d]
        node[1].append(value)

    def within(self, text: str, most: int) -> list[tuple[int, str, object]]:
        """Every (distance, string, value) at a distance of at most most."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            at, values, below = todo.pop()
            d = self.distance(at, text)
            if d <= most:
                out += [(d, at, v) for v in values]
            todo += [n for e, n in below.items() if d - most <= e <= d + most]
        return out


class Reference:
    """A shard of the list: trees over whole entries, over their words in alphabetical order, and over prefixes."""

    def __init__(self, entries: list[tuple[int, str]], speller: Speller) -> None:
        self.speller, self.tree, self.sorted, self.cut_off = speller, BKTree(), BKTree(), BKTree()
        for title_id, title in sorted(entries):
            own = speller.words(title)
            self.sorted.add(" ".join(sorted(own)), title_id)
            for form in dict.fromkeys(["".join(own), "".join(speller.all_words(title)), *self._turned(title)]):
                if not form:
                    continue
                self.tree.add(form, title_id)
                for n in range(max(8, -(-int(len(form) * LEAST_PREFIX * 10) // 10)), len(form)):
                    self.cut_off.add(form[:n], (title_id, len(form) - n))

    def _turned(self, title: str) -> list[str]:
        """Its parts about "and" or a comma in the other order, and "chief" or another first word put last."""
        halves = title.split(",", 1) if "," in title else re.split(r"\band\b|&", title, maxsplit=1, flags=re.I)
        own = self.speller.words(title)
        out = ["".join(w for h in reversed(halves) for w in self.speller.words(h))] if len(halves) == 2 else []
        return out + ["".join(own[1:] + own[:1])] * (len(own) > 2)

    def look_up(self, title: str) -> tuple[int, int, int] | None:
        """(edits, letters cut off, entry) of the best entry; ties go to the smaller entry."""
        words = self.speller.words(title)
        forms = [words] + [words[1:]] * (len(words) > 1 and words[0] in LEADING)
        every = self.speller.all_words(title)
        for own in forms:  # its very words, in any order
            if hits := self.sorted.within(" ".join(sorted(own)), 0):
                return 0, 0, min(v for _, _, v in hits)
        best = None
        for own in [*forms, every] if len(every) > len(words) or any(w.startswith("and") for w in words) else forms:
            text = "".join(own)
            if len(text) < 5:
                continue
            hits = [(1 if d else 0, 0, v) for d, at, v in self.tree.within(text, 2) if one_typo(text, at) or d == 2 and len(at) >= 24 and len(text) >= 24]
            if not hits and len(text) >= 8:
                hits = [(1 if d else 0, lost, v) for d, at, (v, lost) in self.cut_off.within(text, 2) if one_typo(text, at)]
            if hits:
                best = min([best, *hits]) if best else min(hits)
        return best


MAPPED = "title_raw string, edits int, lost int, title_id bigint"


def map_values(values: DataFrame, reference: DataFrame, short: dict[str, str] | None = None) -> DataFrame:
    """(title_raw, edits, lost, title_id) for every distinct non-blank value that denotes an entry.

    reference: title_id, canonical_title. short: the list of abbreviations, SHORT if it is not given. Values are looked up in one tree per shard of SHARD_ENTRIES entries and the
    shards' winners merged by fewest edits, fewest letters cut off, smallest entry; entries with a NULL title are left
    out. NULL and blank values denote none, nor do values much longer than any entry. Of entries that fit equally well the
    smallest id is taken. A value that a third of all rows hold is looked up once. Other columns are not read; an empty
    table or list gives no rows.
    """
    spark = values.sparkSession
    entries = [(r["title_id"], r["canonical_title"]) for r in reference.where("canonical_title IS NOT NULL").select("title_id", "canonical_title").toLocalIterator()]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = values.where(F.trim("title_raw") != "").select("title_raw").distinct().repartition(tasks, F.xxhash64("title_raw"))  # the tree is dear beside its input; the hash keeps AQE from merging tasks
    speller = Speller([t for _, t in entries], short)
    shards = [entries[i : i + SHARD_ENTRIES] for i in range(0, len(entries), SHARD_ENTRIES)]
    if not shards:
        return spark.createDataFrame([], MAPPED)
    if len(shards) > 1:
        distinct = cut(distinct)
    out = None
    for own in shards:
        shared = spark.sparkContext.broadcast(Reference(own, speller))

        def run(batches: Iterable[pd.DataFrame], shared: object = shared) -> Iterator[pd.DataFrame]:
            ref: Reference = shared.value
            for b in batches:
                rows = [(t, *got) for t in b["title_raw"] if (got := ref.look_up(t))]
                yield pd.DataFrame(rows, columns=["title_raw", "edits", "lost", "title_id"])

        got = distinct.mapInPandas(run, MAPPED)
        out = got if out is None else out.unionByName(got)
    if len(shards) > 1:
        best = F.min(F.struct("edits", "lost", "title_id")).alias("b")
        out = out.groupBy("title_raw").agg(best).select("title_raw", "b.edits", "b.lost", "b.title_id")
    return out


def map_rows(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """rows with title_id, edits and lost of the entry that title_raw denotes, else NULL; columns of these names that rows
    already has are replaced. The mapping of distinct values is
    written once and broadcast if it is small; else the join shuffles, and AQE splits a hot value."""
    mapped = broadcast_if_small(cut(map_values(rows, reference)))
    return rows.drop("edits", "lost", "title_id").join(mapped, "title_raw", "left")
