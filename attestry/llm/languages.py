"""Language of documents and of the segments of mixed ones, by fusing evidence: the likelihood of the text under word
models trained here, the declared label, the suffix of the source's address and the source itself, whose shares are
counted by grouped aggregation and smoothed from the whole corpus over the suffix down to the source."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import broadcast_if_small, cut

#: The languages, with the codes and names that labels use.
LANGS = ("de", "en", "es", "fr", "it", "nl", "pt", "sv")
NAMES = {
    "de": ("deu", "ger", "german", "deutsch"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "it": ("ita", "italian", "italiano"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "sv": ("swe", "swedish", "svenska"),
}
#: Labels that say nothing.
NO_LABEL = ("", "und", "unknown")

#: The model is fitted on at most FIT_DOCS labelled documents of at most FIT_CHARS characters, taken by hash.
FIT_DOCS, FIT_CHARS, FIT_ROUNDS = 4000, 20_000, 3
#: A word counts if the sample has it in so many sentences; a word moves the odds by at most CLIP nats.
LEAST_SENTENCES, CLIP = 6, 5.0
#: While sentences are labelled anew, only words count that a language has in this share of its sentences: what a pasted
#: passage speaks of is rare in every language, and the small ones must not claim it.
COMMON = 0.02
#: Words of the average language that each language is taken to hold besides its own, which keeps one with few, perhaps
#: wrong, labels from claiming a word.
PRIOR = 100.0
#: Nats that a change of language between units costs; telling words and confidence that a held language needs in one segment.
SWITCH, LEAST_WORDS, LEAST_CONFIDENCE = 7.0, 4, 0.95
#: Words of the windows in which a change inside a unit is looked for, and the nats that one costs.
WINDOW, INNER_SWITCH = 8, 14.0
#: How far a declared label is trusted, and the weight in documents of the level above in a source's shares.
LABEL_TRUST, SMOOTHING = 0.85, 20.0

WORD = re.compile(r"[^\W\d_]+")
QUOTE = re.compile(r"[„“”«»\"‘‚]")
STOP = re.compile(r"[.!?…]+[\"'”“»)]*|\n+")
#: A short term in quotation marks, which says nothing of its surroundings.
TERM = re.compile(r"[„“”«»\"‘‚][^„“”«»\"‘‚.!?\n]{1,40}[“”»«\"’‘]")


def plain(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def units(text: str) -> list[tuple[int, int]]:
    """Spans of sentences. A stop within a word ends none, unless it is an ellipsis, nor does one after an initial or a
    number of one or two digits."""
    out, start, size = [], 0, len(text)
    for m in STOP.finditer(text):
        at, end = m.span()
        if end < size and text[at] != "\n" and not text[end].isspace() and "…" not in m.group():
            continue
        if text[at] == "." and at:
            before = text[max(0, at - 3) : at]
            if before[-1:].isalpha() and not before[-2:-1].isalpha() or before[-1:].isdigit() and not before[:1].isdigit() and not before[-2:-1] in (".", ","):
                continue
        if not text[start:end].isspace():
            out.append((start, end))
            start = end
    if start < len(text):
        out.append((start, len(text)))
    return out


def unit_words(text: str) -> list[str]:
    """Lower-case words of a sentence without those of quoted terms of at most four words."""
    if QUOTE.search(text):
        text = TERM.sub(_blank, text)
    return WORD.findall(text.lower())


def _blank(m: re.Match) -> str:
    return " " * len(m.group()) if len(m.group().split()) <= 4 else m.group()


def word_starts(text: str) -> list[int]:
    """Where the words of unit_words begin in the text; a letter whose lower case is longer keeps its place."""
    low = [c.lower() for c in TERM.sub(_blank, text)]
    place = [i for i, c in enumerate(low) for _ in c]
    return [place[m.start()] for m in WORD.finditer("".join(low))]


def windows(n: int) -> list[tuple[int, int]]:
    """n words in runs of WINDOW or somewhat more."""
    k = n // WINDOW
    return [(0, n)] if k < 2 else [(n * i // k, n * (i + 1) // k) for i in range(k)]


class Model:
    """Word -> row of log-odds over LANGS. Row 0 is an unknown word, which says nothing."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray) -> None:
        self.vocabulary, self.weights = vocabulary, weights

    def score(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds (units x LANGS) and the number of telling words of each unit."""
        get = self.vocabulary.get
        flat = [get(w, 0) for t in texts for w in t]
        ids = np.array(flat, np.int64) if flat else np.zeros(0, np.int64)
        ends = np.cumsum([len(t) for t in texts])
        sums = np.vstack([np.zeros((1, len(LANGS))), np.cumsum(self.weights[ids], axis=0, dtype=np.float64)])
        known = np.concatenate([[0], np.cumsum(self.telling[ids])])
        ends = ends.astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(texts) else ends
        return sums[ends] - sums[starts], known[ends] - known[starts]

    @property
    def telling(self) -> np.ndarray:
        if not hasattr(self, "_telling"):
            self._telling = (self.weights.max(axis=1) - np.sort(self.weights, axis=1)[:, -2] > 0.7).astype(np.int64)
        return self._telling


def _weights(words: list[str], counts: np.ndarray, least: np.ndarray) -> Model:
    """The model that counts of sentences (words x LANGS) give; least: sentences of some language that a word must have."""
    kept = {words[i]: counts[i] for i in np.flatnonzero((counts.sum(axis=1) >= LEAST_SENTENCES) & (counts >= least).any(axis=1)).tolist()}
    for w in [w for w in kept if not w.isascii()]:  # typed without its marks, a word is as telling
        kept.setdefault(folded(w), np.zeros(len(LANGS)))
        kept[folded(w)] = kept[folded(w)] + kept[w]
    if not kept:
        return Model({}, np.zeros((1, len(LANGS)), np.float32))
    table = np.array([*kept.values()])
    rate = (table + PRIOR * table.sum(axis=1, keepdims=True) / table.sum()) / (table.sum(axis=0) + PRIOR)
    log = np.log(rate)
    log[:, counts.sum(axis=0) == 0] = -np.inf  # a language without a sentence claims nothing
    log = np.maximum(log - log.max(axis=1, keepdims=True), -CLIP)
    return Model({w: i + 1 for i, w in enumerate(kept)}, np.vstack([np.zeros(len(LANGS)), log]).astype(np.float32))


def sentence_words(text: str) -> list[list[str]]:
    """Each sentence's different words, sorted."""
    text = plain(text)
    return [sorted(set(unit_words(text[a:b]))) for a, b in units(text)]


def fit(sample: list[tuple[list[list[str]], str]]) -> Model:
    """From (sentence_words of a text, declared language): counts of words per sentence by label, then by the language that
    the common words so far give the sentence, so that wrong labels and mixed documents wash out; at last of all words."""
    place: dict[str, int] = {}
    sentences = [(ws, LANGS.index(lang)) for text, lang in sample for ws in text if ws]
    flat = np.array([place.setdefault(w, len(place)) for ws, _ in sentences for w in ws], np.int64)
    if not len(flat):
        return Model({}, np.zeros((1, len(LANGS)), np.float32))
    sizes, label = np.array([len(ws) for ws, _ in sentences]), np.array([k for _, k in sentences], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    trust = np.log(LABEL_TRUST * (len(LANGS) - 1) / (1 - LABEL_TRUST)) * np.eye(len(LANGS))[label]
    words, given = [*place], label
    for round_ in range(FIT_ROUNDS + 1):
        counts = np.bincount(flat * len(LANGS) + np.repeat(given, sizes), minlength=len(words) * len(LANGS)).reshape(-1, len(LANGS)).astype(float)
        if round_ == FIT_ROUNDS:
            return _weights(words, counts, np.zeros(len(LANGS)))
        model = _weights(words, counts, COMMON * np.bincount(given, minlength=len(LANGS)))
        row = np.array([model.vocabulary.get(w, 0) for w in words])
        given = (np.add.reduceat(model.weights[row[flat]].astype(float), starts, axis=0) + trust).argmax(axis=1)


def path(scores: np.ndarray, cost: float | np.ndarray = SWITCH) -> np.ndarray:
    """The most likely language of each unit when every change costs so many nats, or as many as stand at the unit that
    it leads to."""
    best = scores.argmax(axis=1)
    if (best == best[0]).all():
        return best
    n, total, back = len(scores), scores[0].copy(), np.zeros(scores.shape, np.int64)
    costs = np.broadcast_to(cost, n)
    for i in range(1, n):
        top = int(total.argmax())
        moved = total[top] - costs[i] > total
        back[i] = np.where(moved, top, np.arange(scores.shape[1]))
        total = np.where(moved, total[top] - costs[i], total) + scores[i]
    out = np.zeros(n, np.int64)
    out[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


#: Stands for a NULL source, which has shares of its own.
NO_SOURCE = "\x00"
SEGMENTS = "doc_id bigint, source string, declared string, missing boolean, seg int, start int, stop int, n_words int, telling int, score array<double>"
#: Documents that are scored at once; bounds a worker's memory.
CHUNK = 256


def text_segments(docs: DataFrame, model: object) -> DataFrame:
    """One row per run of units that the text alone gives to one language; an empty text is one empty run. score: the
    run's log-odds with the log trust in the declared label added. A unit whose windows of words speak for several
    languages is taken window by window, so that a run may also begin inside it."""
    doubt = float(np.log((1 - LABEL_TRUST) / (len(LANGS) - 1)))
    label = {k: np.array([np.log(LABEL_TRUST) if k == x else doubt for x in LANGS]) for k in LANGS}
    nothing = np.zeros(len(LANGS))

    def chunk(b: pd.DataFrame, m: Model) -> list[tuple]:
        units_, parts, first, out = [], [], [0], []
        for t in b["text"]:
            t = plain(t or "")
            for x, y in units(t) or [(0, len(t))]:
                words = unit_words(t[x:y])
                at = windows(len(words))
                units_.append((t, x, y, len(words), at))
                parts += [words[u:v] for u, v in at]
            first.append(len(units_))
        fine, fine_known = m.score(parts)
        begins = np.cumsum([0] + [len(u[4]) for u in units_])
        whole, whole_known = np.add.reduceat(fine, begins[:-1]), np.add.reduceat(fine_known, begins[:-1])
        mixed = np.add.reduceat(fine.max(axis=1), begins[:-1]) - whole.max(axis=1) > SWITCH
        spans, scores_, known_, sizes_, costs_, pieces = [], [], [], [], [], [0]
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            for j in range(lo, hi):
                t, x, y, n, at = units_[j]
                if mixed[j]:
                    starts = word_starts(t[x:y])
                    edges = [x, *[x + starts[u] for u, _ in at[1:]], y]
                    spans += zip(edges[:-1], edges[1:], strict=True)
                    part = slice(begins[j], begins[j + 1])
                    scores_ += list(fine[part])
                    known_ += fine_known[part].tolist()
                    sizes_ += [v - u for u, v in at]
                    costs_ += [SWITCH] + [INNER_SWITCH] * (len(at) - 1)
                else:
                    spans.append((x, y))
                    scores_.append(whole[j])
                    known_.append(whole_known[j])
                    sizes_.append(n)
                    costs_.append(SWITCH)
            pieces.append(len(spans))
        scores, known, sizes, costs = np.array(scores_), np.array(known_), np.array(sizes_), np.array(costs_)
        for i, (doc, source, declared, missing) in enumerate(zip(b["doc_id"], b["source"], b["declared"], b["missing"], strict=True)):
            lo, hi = pieces[i], pieces[i + 1]
            own = path(scores[lo:hi], costs[lo:hi])
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), hi - lo]
            for seg, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                part = slice(lo + x, lo + y)
                out.append((doc, source, declared, missing, seg, spans[lo + x][0], spans[lo + y - 1][1], int(sizes[part].sum()), int(known[part].sum()), scores[part].sum(axis=0) + label.get(declared, nothing)))
        return out

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        for b in batches:
            for at in range(0, len(b), CHUNK):
                yield pd.DataFrame(chunk(b.iloc[at : at + CHUNK], m), columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return docs.select("doc_id", "source", "declared", "missing", "text").mapInPandas(run, SEGMENTS)


def declared_language(label: str) -> Column:
    """The two-letter code that a label names in any code style; NULL if it names none of LANGS."""
    spelt = {n: k for k, v in NAMES.items() for n in (k, *v)}
    head = F.element_at(F.split(F.lower(F.trim(F.col(label))), "[-_ ]"), 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in spelt.items() for x in kv]), head)


def no_label(label: str) -> Column:
    return F.col(label).isNull() | F.lower(F.trim(F.regexp_replace(F.col(label), r"[\s ]+", " "))).isin(*NO_LABEL)


def suffix(source: str) -> Column:
    """The address suffix of a source that has one: the last label of a host name."""
    return F.nullif(F.regexp_extract(F.lower(F.col(source)), r"^[^/]*\.([a-z]{2,})(?:[:/].*)?$", 1), F.lit(""))


def host_shares(docs: DataFrame) -> DataFrame:
    """(source, log share over LANGS): declared labels counted per source, smoothed towards the suffix's shares, and
    these towards the corpus's. Counts are folded map-side, so a source with a third of all rows is no burden. A NULL
    source has a row of its own."""
    counts = docs.where(F.col("declared").isNotNull()).groupBy("source", "declared").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("source").agg(*[F.coalesce(F.sum(F.when(F.col("declared") == k, F.col("n"))), F.lit(0)).cast("double").alias(k) for k in LANGS]).withColumn("suffix", suffix("source"))
    wide = cut(wide)
    tops = wide.groupBy("suffix").agg(*[F.sum(k).alias(f"s_{k}") for k in LANGS])
    every = wide.agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(f"g_{k}") for k in LANGS])
    total = lambda p: sum((F.col(f"{p}{k}") for k in LANGS), F.lit(0.0))
    corpus = {k: (F.col(f"g_{k}") + 1.0) / (total("g_") + len(LANGS)) for k in LANGS}
    level = {k: (F.col(f"s_{k}") + SMOOTHING * corpus[k]) / (total("s_") + SMOOTHING) for k in LANGS}
    own = [(F.col(k) + SMOOTHING * level[k]) / (total("") + SMOOTHING) for k in LANGS]
    joined = wide.join(tops.withColumnRenamed("suffix", "__s"), F.col("suffix").eqNullSafe(F.col("__s")), "left").crossJoin(F.broadcast(every))  # every: one row
    return joined.select(F.coalesce("source", F.lit(NO_SOURCE)).alias("__source"), F.array(*[F.log(x) for x in own]).alias("share"))


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "source", declared_language("lang").alias("declared"), no_label("lang").alias("missing"))


def fitted(docs: DataFrame) -> Model:
    """A model from a bounded sample by hash of the labelled documents (FIT_DOCS, FIT_CHARS). A threshold on the hash, from
    the number of labels, keeps all but a few times FIT_DOCS texts from being sorted."""
    h = F.xxhash64("doc_id")
    labelled = docs.where(declared_language("lang").isNotNull()).count()
    rows = prepared(docs).where(F.col("declared").isNotNull() & (F.length("text") <= FIT_CHARS))
    if labelled > 4 * FIT_DOCS:
        rows = rows.where(h < -(1 << 63) + int(4 * FIT_DOCS / labelled * (1 << 64)))
    sample = rows.select("text", "declared", h.alias("h")).orderBy("h").limit(FIT_DOCS)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"sentences": [sentence_words(t) for t in b["text"]], "declared": b["declared"]})

    tasks = docs.sparkSession.sparkContext.defaultParallelism
    parsed = sample.repartition(tasks, "h").mapInPandas(run, "sentences array<array<string>>, declared string")
    return fit([(r["sentences"], r["declared"]) for r in parsed.toLocalIterator()])


def segments(docs: DataFrame) -> DataFrame:
    """Each document's segments with language and confidence: doc_id, declared, missing, seg, start, stop (characters),
    n_words, telling, lang, confidence.

    Texts are read whole, once, where they lie; what is joined with the sources' shares are thin rows. A document whose
    text has no telling word keeps one segment, whose language the label and the source alone decide; lang is NULL where
    telling words, label and source are all absent. A NULL source has shares of its own. Other columns are not read; an
    empty table gives no rows, and one without any label leaves every share and likelihood flat.
    """
    spark = docs.sparkSession
    ready = prepared(docs)
    model = spark.sparkContext.broadcast(fitted(docs))
    shares = broadcast_if_small(cut(host_shares(ready)))
    raw = text_segments(ready, model).withColumn("__h", F.coalesce("source", F.lit(NO_SOURCE)))
    flat = F.array(*[F.lit(float(-np.log(len(LANGS))))] * len(LANGS))
    joined = raw.join(shares, F.col("__h") == F.col("__source"), "left")
    fused = joined.withColumn("logs", F.zip_with("score", F.coalesce("share", flat), lambda s, p: s + p)).withColumn("top", F.array_max("logs"))
    sure = F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    mute = (F.col("telling") == 0) & F.col("declared").isNull() & F.col("share").isNull()
    lang = F.element_at(F.array(*[F.lit(k) for k in LANGS]), F.array_position("logs", F.col("top")).cast("int"))
    return fused.select("doc_id", "declared", "missing", "seg", "start", "stop", "n_words", "telling", F.when(~mute, lang).alias("lang"), F.when(~mute, sure).alias("confidence"))


def held(segs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, confidence, declared, missing): languages that a document holds, by segments with enough
    telling words; one row per document and language."""
    strong = segs.where((F.col("telling") >= LEAST_WORDS) & (F.col("confidence") >= LEAST_CONFIDENCE))
    return strong.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n_words"), F.max("confidence").alias("confidence"), F.first("declared").alias("declared"), F.first("missing").alias("missing"))


def unsound(segs: DataFrame) -> DataFrame:
    """(doc_id, lang) of documents without a label, with a label for a language they do not hold, or of several
    languages: one row per language held. A document's languages are at most len(LANGS) rows."""
    by = held(segs).groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("declared").alias("declared"), F.first("missing").alias("missing"))
    bad = F.col("missing") | (F.size("langs") > 1) | ~F.coalesce(F.array_contains("langs", F.col("declared")), F.lit(False))
    return by.where(bad).select("doc_id", F.explode("langs").alias("lang"))


def documents(segs: DataFrame) -> DataFrame:
    """Per document: main language (most words), its confidence, how many languages it holds, and what the label was."""
    main = F.max_by(F.struct("lang", "confidence"), F.struct("n_words", "lang"))
    label = F.when(F.first("missing"), "missing").when(F.count_if(F.col("lang") == F.col("declared")) > 0, "right").otherwise("wrong")
    return segs.groupBy("doc_id").agg(main.alias("m"), F.count_distinct(F.when(F.col("telling") >= LEAST_WORDS, F.col("lang"))).alias("n_langs"), label.alias("label")).select("doc_id", F.col("m.lang").alias("lang"), F.round("m.confidence", 6).alias("confidence"), "n_langs", "label")
