"""Filling fixed-capacity containers with whole texts, sized in tokens of a public tokenizer. A cheap fill takes items as
they come; a swap-based local search then moves sizes from emptier to fuller containers, one for none, one for one and two
for one, so that the sum of squared fills only grows, until containers empty. Groups search apart, and what they leave open
is searched together, round after round, until none is freed."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import cut

#: Items that one task packs together; groups come from a hash, so none grows with the data.
GROUP_ITEMS = 20_000
#: Containers filled below this share are searched again across groups.
REOPEN = 0.99
#: The search ends when so many containers in a row, from the emptiest on, could not be emptied.
PATIENCE = 50
#: Of a container's smallest items so many are tried two by two.
PAIRED = 5
#: The public vocabulary and the pattern that parts text before it is encoded; both are parameters.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the vocabulary's published pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[tuple[bytes, str], object] = {}


def encoding(vocabulary: bytes, pattern: str) -> object:
    """The encoding of a vocabulary file's content; one per worker process."""
    if (vocabulary, pattern) not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encodings[vocabulary, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary, pattern]


def token_counts(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; NULL and empty texts have 0. The driver alone reads the vocabulary, some MB whatever
    the data, and sends it to the workers."""
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoding(shared.value, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(e.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_tokens int")


def cheap_fill(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items as they come, each into the container at hand or else a new one; containers as lists of places in sizes."""
    bins: list[list[int]] = []
    room = -1
    for i, s in enumerate(sizes.tolist()):
        if s > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= s
    return bins


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound: by volume, and by items of which no two share a container."""
    big = sizes[sizes * 2 > capacity]
    best = max(-(-int(sizes.sum()) // capacity), len(big))
    for k in np.unique(sizes[sizes * 2 <= capacity])[:200]:
        large = int((big > capacity - k).sum())
        middle = big[big <= capacity - k]
        small = int(sizes[(sizes >= k) & (sizes * 2 <= capacity)].sum())
        best = max(best, large + len(middle) + max(0, -(-(small - (len(middle) * capacity - int(middle.sum()))) // capacity)))
    return best


def _single(own: list[tuple[int, int]]) -> set[int]:
    return {s for s, _ in own}


def _double(own: list[tuple[int, int]]) -> set[int]:
    """Sizes of two of the smallest items together."""
    return {a + b for (a, _), (b, _) in combinations(own[:PAIRED], 2)}


class Shelf:
    """Containers with their items by size, an index of containers by room, and two of what an exchange can take out of a
    container, one item or two, by the container's room."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int) -> None:
        size = sizes.tolist()
        self.items = [sorted((size[i], i) for i in b) for b in bins]
        self.room = [capacity - sum(s for s, _ in own) for own in self.items]
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some container has room r
        # per way of taking: the holders of a size by room, and bit s of place r: some container with room r can give s
        self.ways = [(take, {}, [0] * (capacity + 1)) for take in (_single, _double)]
        for k, r in enumerate(self.room):
            self.enter(k, r)

    def enter(self, k: int, r: int) -> None:
        self.room[k] = r
        self.by_room[r].add(k)
        self.rooms |= 1 << r
        for take, holders, bits in self.ways if r else ():
            for s in take(self.items[k]):
                holders.setdefault((r, s), set()).add(k)
                bits[r] |= 1 << s

    def leave(self, k: int) -> None:
        r = self.room[k]
        self.by_room[r].discard(k)
        if not self.by_room[r]:
            self.rooms &= ~(1 << r)
        for take, holders, bits in self.ways if r else ():
            for s in take(self.items[k]):
                own = holders[r, s]
                own.discard(k)
                if not own:
                    bits[r] &= ~(1 << s)

    def tightest(self, size: int) -> int:
        """A container with the least room that holds size, or -1."""
        fit = self.rooms >> size
        return min(self.by_room[size + (fit & -fit).bit_length() - 1]) if fit else -1

    def emptiest(self, aside: set[int]) -> int:
        rooms = self.rooms & ~1
        while rooms:
            r = rooms.bit_length() - 1
            own = self.by_room[r] - aside
            if own:
                return min(own)
            rooms &= (1 << r) - 1
        return -1

    def exchange(self, totals: dict[int, tuple[tuple[int, int], ...]], room: int, way: int = 0) -> tuple[tuple[tuple[int, int], ...], int, tuple[tuple[int, int], ...]] | None:
        """(items to give, container, items to take for them) that leaves the taker with the least room; totals are sizes
        that a source with that room can give; way 1 takes two items. The roomiest containers come first."""
        _, holders, bits = self.ways[way]
        rooms = self.rooms & ~1
        while rooms:
            r = rooms.bit_length() - 1
            rooms &= (1 << r) - 1
            best, sizes, span = None, bits[r], (1 << r) - 1
            for total in totals:
                hit = sizes >> (total - r) & span if total > r else sizes & ((1 << total) - 1)
                if hit:
                    take = max(0, total - r) + (hit & -hit).bit_length() - 1
                    if (best is None or total - take > best[0]) and room + total - take > r:
                        best = total - take, total, take
                        if best[0] == r:
                            break
            if best:
                to = min(holders[r, best[2]])
                own = self.items[to]
                taken = ((own[bisect_left(own, (best[2], -1))],),) if not way else (x for x in combinations(own[:PAIRED], 2) if x[0][0] + x[1][0] == best[2])
                return totals[best[1]], to, next(iter(taken))
        return None


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empties the emptiest containers into the others while the sum of squared fills grows.

    From the emptiest container on, its largest items go into the tightest room that holds them. What has no room goes by
    exchange: an item takes the place of a smaller one elsewhere, else two take the place of one, else one that of two, so
    that least room is left, in any container that is fuller after it than the source was, the roomiest first. Each step raises the sum
    of squares, whether or not the source can be emptied in the end. A source with no step left stands aside until another
    has made one; the search ends at the lower bound or after PATIENCE such sources.
    """
    least = least_bins(sizes, capacity)
    shelf = Shelf(sizes, [b for b in bins if b], capacity)
    count, stuck = len(shelf.items), set()
    while count > least and len(stuck) < PATIENCE and (src := shelf.emptiest(stuck)) >= 0:
        shelf.leave(src)
        own, room = shelf.items[src], shelf.room[src]
        before = room
        while own:
            moved = False
            for i in range(len(own) - 1, -1, -1):  # one for none
                to = shelf.tightest(own[i][0])
                if to >= 0 and room + own[i][0] > shelf.room[to]:
                    shelf.leave(to)
                    insort(shelf.items[to], own[i])
                    shelf.enter(to, shelf.room[to] - own[i][0])
                    room += own.pop(i)[0]
                    moved = True
            if moved:
                continue
            one = {x[0]: (x,) for x in own}
            got = shelf.exchange(one, room) or shelf.exchange({x[0] + y[0]: (x, y) for x, y in combinations(own, 2)}, room) or shelf.exchange(one, room, 1)
            if not got:
                break
            given, to, taken = got
            shelf.leave(to)
            other = shelf.items[to]
            for x in given:
                own.remove(x)
                insort(other, x)
            for x in taken:
                other.remove(x)
                insort(own, x)
            gain = sum(s for s, _ in given) - sum(s for s, _ in taken)
            room += gain
            shelf.enter(to, shelf.room[to] - gain)
        if room > before:
            stuck.clear()
        if own:
            shelf.enter(src, room)
            stuck.add(src)
        else:
            shelf.room[src] = -1
            count -= 1
    return [[i for _, i in own] for own in shelf.items if own]


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    return local_search(sizes, cheap_fill(sizes, capacity), capacity)


PLACED = "window_id bigint, capacity int, container string, started string, doc_id bigint, piece int, n_tokens int, fill int"


def _search_groups(items: DataFrame, round_: int, group_items: int) -> DataFrame:
    """Items (window_id, capacity, container, started, doc_id, piece, n_tokens) searched by groups of about group_items: of
    items that are in no container yet by a hash of theirs, else by one of their container."""
    counts = {r["window_id"]: r["n"] for r in items.groupBy("window_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per window
    if not counts:
        return items.sparkSession.createDataFrame([], PLACED)
    groups = F.element_at(F.create_map(*[F.lit(x) for w, n in counts.items() for x in (w, -(-n // group_items))]), F.col("window_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        sizes, cap, g = pdf["n_tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]), pdf["g"].iloc[0]
        if pdf["container"].isna().iloc[0]:
            bins = cheap_fill(sizes, cap)
            started = np.empty(len(pdf), object)
            for k, b in enumerate(bins):
                started[b] = f"{g}-{k}"
            pdf["started"] = started
        else:
            bins = [own.tolist() for own in pdf.groupby("container", sort=True).indices.values()]
        name, full = np.empty(len(pdf), object), np.zeros(len(pdf), np.int64)
        for k, b in enumerate(local_search(sizes, bins, cap)):
            name[b] = f"{round_}-{g}-{k}"
            full[b] = sizes[b].sum()
        return pdf.assign(container=name, fill=full)[[c.split()[0] for c in PLACED.split(", ")]]

    order = F.xxhash64("doc_id", "piece")
    grouped = items.withColumn("o", order).withColumn("g", F.pmod(F.when(F.col("container").isNull(), order).otherwise(F.xxhash64("container", F.lit(round_))), groups).cast("int"))
    return grouped.groupBy("window_id", "g").applyInPandas(run, PLACED)


def fill_containers(docs: DataFrame, windows: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Each text's place for every window: window_id, capacity, container, started (its container in the cheap fill), doc_id,
    piece, n_tokens, fill (tokens in the container).

    Only a text longer than the capacity is cut: into pieces of the capacity, which fill containers of their own, and a
    last piece that is packed like a whole text. Texts without tokens, NULL ones among them, are in no container. windows
    has a few rows; a capacity below 1 or NULL is left out. Items come in the order of a hash, so a result repeats; other
    columns are not read, and empty tables give no rows. Containers that a round leaves emptier than REOPEN are searched
    with those of other groups in the next; rounds end when one frees no container or has seen all in one group.
    """
    spark = docs.sparkSession
    caps = [(r["window_id"], r["capacity_tokens"]) for r in windows.where("capacity_tokens > 0").collect()]
    counts = cut(token_counts(docs, path, pattern).where("n_tokens > 0"))
    if not caps:
        return spark.createDataFrame([], PLACED)
    each = F.explode(F.array(*[F.struct(F.lit(w).cast("bigint").alias("window_id"), F.lit(c).cast("int").alias("capacity")) for w, c in caps]))
    wide = counts.select("doc_id", "n_tokens", each.alias("w")).select("doc_id", "n_tokens", "w.*")
    whole = F.expr("n_tokens div capacity").cast("int")
    rest = (F.col("n_tokens") - whole * F.col("capacity")).cast("int")
    chunks = wide.where(whole >= 1).select("window_id", "capacity", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), "doc_id")
    name = F.concat_ws("-", F.lit("full"), "doc_id", "piece")
    out = chunks.select("window_id", "capacity", name.alias("container"), name.alias("started"), "doc_id", "piece", F.col("capacity").alias("n_tokens"), F.col("capacity").alias("fill"))
    none = F.lit(None).cast("string")
    items = wide.where(rest > 0).select("window_id", "capacity", none.alias("container"), none.alias("started"), "doc_id", whole.alias("piece"), rest.alias("n_tokens"))
    round_, had = 0, None
    while True:
        placed = cut(_search_groups(items, round_, group_items))
        short = F.col("fill") < F.col("capacity") * REOPEN
        left = placed.groupBy("window_id").agg(F.count_distinct("container").alias("c"), F.count_distinct(F.split("container", "-")[1]).alias("g")).collect()  # one row per window
        if all(r["g"] <= 1 for r in left) or had is not None and sum(r["c"] for r in left) >= had:
            return out.unionByName(placed)
        out = out.unionByName(placed.where(~short))
        items = placed.where(short).drop("fill")
        had = items.select("window_id", "container").distinct().count()
        round_ += 1


def waste(placed: DataFrame) -> DataFrame:
    """Per window: containers before and after the search, pieces, tokens, the fewest containers that the tokens could need,
    and the unused share."""
    by = placed.groupBy("window_id", "capacity").agg(F.count_distinct("started").alias("start_containers"), F.count_distinct("container").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum(F.col("n_tokens").cast("bigint")).alias("n_tokens"))
    return by.withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity"))).withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))
