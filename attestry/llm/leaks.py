"""Evaluation texts inside training text, as a prefix-filtered set join over word shingles.

An item's window of WINDOW words is a set of shingles of SHINGLE words. A document holds the window exactly if it holds
all of its shingles in a row, so by the prefix bound for a containment of 1 it is enough to join one shingle of each
window, the rarest: only these are in the index. Where one is met, the words that the document and the item have left on
either side bound the run from above, and what passes is verified word for word until the run ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, WINDOW = 5, 12
#: Items are worked off in blocks of at most so many characters; a block's index is sent to every task, at most some 100
#: bytes a word, or 160 MB.
BLOCK_CHARS = 8_000_000
#: Documents whose words are looked up at once; bounds a worker's memory.
CHUNK = 256
WORD = re.compile(r"[^\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits, lower case."""
    return WORD.findall((text or "").lower())


def shingle_keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a shingle of known words begins in a text of word ids, and a hash of each."""
    if len(ids) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.concatenate([[0], np.cumsum(ids != 0)])
    at = np.flatnonzero(known[SHINGLE:] - known[:-SHINGLE] == SHINGLE)
    out = np.zeros(len(at), np.uint64)
    for i in range(SHINGLE):
        out = (out ^ ids[at + i].astype(np.uint64)) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return at, out


class ItemIndex:
    """Words of a block of items, and the rarest shingle of each of their windows. Word 0 is every word that no item has.
    Shingles whose hashes are equal share a place in the index and are told apart by their words."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW) -> None:
        self.window, self.word_ids = window, {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            ids = np.array([self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in words(text)], np.uint32)
            if len(ids) >= window:
                self.items.append((item, ids))
        every = [shingle_keys(ids)[1] for _, ids in self.items]
        self.keys = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.choose(np.zeros(len(self.keys), np.int64))

    def choose(self, frequency: np.ndarray) -> None:
        """Keeps of each window the shingle with the least frequency (by place in keys), of equal ones that of the smaller
        hash, so that neighbouring windows agree."""
        n, kept = self.window - SHINGLE + 1, []
        for k, (_, ids) in enumerate(self.items):
            place = np.searchsorted(self.keys, shingle_keys(ids)[1])
            order = np.lexsort((place, frequency[place]))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            view = np.lib.stride_tricks.sliding_window_view(rank, n)
            at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
            kept.append(np.stack([place[at], np.full(len(at), k), at], axis=1))
        entries = np.concatenate(kept) if kept else np.zeros((0, 3), np.int64)
        entries = entries[np.lexsort((entries[:, 2], entries[:, 1], entries[:, 0]))]
        self.prefix, self.first = np.unique(self.keys[entries[:, 0]], return_index=True)
        self.first = np.append(self.first, len(entries))
        self.entries = entries[:, 1:].astype(np.int32)

    def flat(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of several texts, each followed by a 0, and where each begins; the last entry is the end."""
        get, out, begins = self.word_ids.get, [], [0]
        for t in texts:
            if t:
                out += [get(w, 0) for w in WORD.findall(t.lower())]
            out.append(0)
            begins.append(len(out))
        return np.array(out, np.uint32), np.array(begins)

    def seen(self, texts: Iterable[str | None]) -> np.ndarray:
        """Places in keys of the item shingles that each text holds, once per text."""
        ids, begins = self.flat(texts)
        at, keys = shingle_keys(ids)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        hit = self.keys[place] == keys if len(self.keys) else np.zeros(0, bool)
        text, n = np.searchsorted(begins, at[hit], side="right"), max(1, len(self.keys))
        return np.unique(text * n + place[hit]) % n

    def runs(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, words, position in the text, position in the item) of the longest run that a text and an item share,
        if it has at least window words; of equal ones the earliest."""
        ids, begins = self.flat(texts)
        at, keys = shingle_keys(ids)
        if not len(self.prefix) or not len(at):
            return
        got = np.minimum(np.searchsorted(self.prefix, keys), len(self.prefix) - 1)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for i in np.flatnonzero(self.prefix[got] == keys).tolist():
            p = int(at[i])
            text = int(np.searchsorted(begins, p, side="right")) - 1
            lo, hi = int(begins[text]), int(begins[text + 1]) - 1
            for k, sp in self.entries[self.first[got[i]] : self.first[got[i] + 1]].tolist():
                item, own = self.items[k]
                left, right = min(p - lo, sp), min(hi - p, len(own) - sp)
                if left + right < self.window:
                    continue
                bad = np.flatnonzero(ids[p - left : p + right] != own[sp - left : sp + right]) - left
                cut = int(np.searchsorted(bad, 0))
                start = int(bad[cut - 1]) + 1 if cut else -left
                stop = int(bad[cut]) if cut < len(bad) else right
                if stop - start < self.window or (k, p + start, sp + start) in done:
                    continue
                done.add((k, p + start, sp + start))
                run = stop - start, -(p + start - lo), -(sp + start)
                best[text, k] = max(run, best.get((text, k), run))
        for (text, k), (n, d, i) in best.items():
            yield text, self.items[k][0], n, -d, -i


FOUND = "doc_id bigint, item_id bigint, n_words int, doc_at int, item_at int"


def _chunks(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(b), CHUNK):
        yield b.iloc[at : at + CHUNK]


def rarity(docs: DataFrame, index: ItemIndex) -> np.ndarray:
    """How many of all documents hold each item shingle, by its place in the index. Every task folds its documents to one
    number per item shingle before these are shuffled; as many reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: ItemIndex = shared.value
        total = np.zeros(len(ix.keys), np.int64)
        for b in batches:
            for own in _chunks(b):
                place, n = np.unique(ix.seen(own["text"]), return_counts=True)
                total[place] += n
        met = np.flatnonzero(total)
        yield pd.DataFrame({"s": met, "n": total[met]})

    counts = docs.select("text").mapInPandas(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    out = np.zeros(len(index.keys), np.int64)
    for r in counts.toLocalIterator():
        out[r["s"]] = r["n"]
    return out


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, n_words, doc_at, item_at): each document and item that share a run of at least window words,
    with the longest run and the word positions at which it begins.

    All docs are read twice per block of items, whole: to count in how many of them each shingle is, by which shingles are
    ranked, and to find the runs; no stage shuffles them. What reaches the driver are the items of one block and one count
    per shingle of theirs. Items of fewer words than the window and NULL or empty texts match nothing; an item listed twice
    under one id is taken once per row. Of runs of one length the earliest is given. Other columns are not read; empty
    tables give no rows.
    """
    spark = docs.sparkSession
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    out = spark.createDataFrame([], FOUND)
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "text").where(F.col("item_id").isNotNull())
        index = ItemIndex([(r["item_id"], r["text"]) for r in own.toLocalIterator()], window)
        index.choose(rarity(docs, index))
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pd.DataFrame], shared: object = shared) -> Iterator[pd.DataFrame]:
            ix: ItemIndex = shared.value
            for b in batches:
                for some in _chunks(b):
                    ids = some["doc_id"].tolist()
                    yield pd.DataFrame([(ids[text], *rest) for text, *rest in ix.runs(some["text"].tolist())], columns=[c.split()[0] for c in FOUND.split(", ")])

        out = out.unionByName(docs.select("doc_id", "text").mapInPandas(run, FOUND))
    return out
