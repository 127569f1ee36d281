"""Exact Jaccard self-join of documents on word n-grams, by tries of globally ordered sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import (
    FAN, LOWER, address_ddl, addressed, components, exchange, flat_column, gram_hashes, homes_of, mix,
    running_total, slices_for, small, text_pieces, word_hashes,
)
from broadsheet.session import materialize

# The part of all n-grams that the first filter looks at, in sixteenths.
SAMPLED_16THS = 5
KEYS_PER_SLICE = 800_000
BLOCK_GRAMS = 200_000


def gram_sets(ids: list, texts: list, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, sorted distinct n-gram hashes) of each text; a shorter text is one n-gram."""
    for part, piece in text_pieces(ids, texts):
        words, before = word_hashes(piece, LOWER)
        for k, i in enumerate(part):
            own = words[before[k]:before[k + 1]]
            if len(own) >= size:
                yield i, np.unique(gram_hashes(own, size))
            elif len(own):
                yield i, mix(gram_hashes(own, len(own)) + np.uint64(len(own)))
            else:
                yield i, own


def set_key(grams: np.ndarray) -> int | None:
    """One number for a whole set; None for the empty one."""
    if not len(grams):
        return None
    return int(mix(np.array([mix(grams).sum()], dtype=np.uint64)).view(np.int64)[0])


def _sampled(grams: np.ndarray) -> np.ndarray:
    return grams[(grams >> np.uint64(60)) < SAMPLED_16THS]


def _row_key() -> Column:
    """What tells rows apart: equal only for repeated rows."""
    return F.xxhash64("doc_id", "text").alias("rk")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, rk, key, n, u: size of the set and of its sampled part."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            rows = [(*i, set_key(g), len(g), len(_sampled(g))) for i, g in
                    gram_sets(pairs, b.column(2).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)],
                names=["doc_id", "rk", "key", "n", "u"],
            )

    return docs.select("doc_id", _row_key(), "text").mapInArrow(
        measure, "doc_id long, rk long, key long, n long, u long")


def _shared(docs: DataFrame, size: int, slices: int) -> DataFrame:
    """key, shared: how many of a set's sampled n-grams another set has too.

    N-grams travel as arrays, rows of a piece of a task's texts for a slice of the hash range,
    so a row is small and no key, however frequent, is a partition of its own.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            texts = b.column(0).to_pylist()
            held, owners, total, known = [], [], 0, set()

            def rows() -> list[pa.RecordBatch]:
                nonlocal number
                keys, own = np.concatenate(held), np.concatenate(owners)
                home = ((keys >> np.uint64(20)) % np.uint64(slices)).astype(np.int64)
                number += 1
                return addressed(home, slices, {
                    "keys": (keys.view(np.int64), pa.int64()), "owners": (own, pa.int64()),
                }, number, FAN).combine_chunks().to_batches()

            for _, g in gram_sets(texts, texts, size):
                i = set_key(g)
                if i is None or i in known:
                    continue
                known.add(i)
                held.append(_sampled(g))
                owners.append(np.full(len(held[-1]), i, dtype=np.int64))
                total += len(held[-1])
                if total >= 500_000:
                    yield from rows()
                    held, owners, total = [], [], 0
            if total:
                yield from rows()

    def count(table: pa.Table) -> pa.Table:
        keys, owners = flat_column(table, "keys").view(np.uint64), flat_column(table, "owners")
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        if len(keys):  # equal sets that came from several pieces are one
            own = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])
            keys, owners = keys[own], owners[own]
        same = keys[1:] == keys[:-1]
        hit = np.zeros(len(keys), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        ids, times = np.unique(owners[hit], return_counts=True)
        return addressed(homes_of(ids, slices), slices, {
            "owners": (ids, pa.int64()), "shared": (times, pa.int64()),
        }, int(table.column("slice")[0].as_py()), FAN)

    def add(table: pa.Table) -> pa.Table:
        ids, place = np.unique(flat_column(table, "owners"), return_inverse=True)
        shared = np.bincount(place, weights=flat_column(table, "shared")).astype(np.int64)
        return pa.table({"key": ids, "shared": shared})

    sent = docs.select("text").mapInArrow(
        send, address_ddl("keys array<long>, owners array<long>"))
    counted = exchange(
        sent, slices, count, address_ddl("owners array<long>, shared array<long>"), FAN)
    return exchange(counted, slices, add, "key long, shared long", FAN)


class Trie:
    """Sets as paths in one global order of their elements, most frequent first.

    Elements that exactly the same sets hold are one element with a weight, and elements of a
    single set are left out: they can't be shared. What remains is a radix tree with at most
    two nodes per set. A traversal carries, for all probes at once, the overlap with the path
    so far, so that sets with a common path share the work; it leaves a subtree when no probe
    can still reach the threshold with what remains below.
    """

    def __init__(self, sets: list[np.ndarray], probes: list[np.ndarray], percent: int) -> None:
        self.percent, m = percent, len(sets) + len(probes)
        self.count, self.total = len(sets), m
        every = [*sets, *probes]
        self.n = np.array([len(s) for s in every], dtype=np.int64)
        owner = np.repeat(np.arange(m), self.n)
        _, element = np.unique(np.concatenate(every), return_inverse=True)
        # elements with the same owners get the same sum of random codes
        codes = mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.zeros(element.max() + 1, dtype=np.uint64)
        np.add.at(sums, element, codes[owner])
        held_by = np.bincount(element)
        kinds, kind = np.unique(np.where(held_by > 1, sums, 0), return_inverse=True)
        weight = np.bincount(kind)
        holders = np.zeros(len(kinds), dtype=np.int64)
        holders[kind] = held_by
        pairs = np.unique(kind[element] * m + owner)
        pairs = pairs[kinds[pairs // m] != 0]
        rank = np.empty(len(kinds), dtype=np.int64)
        rank[np.lexsort((kinds, -holders))] = np.arange(len(kinds))
        kind_of, member = rank[pairs // m], pairs % m
        self.weight = np.empty(len(kinds), dtype=np.int64)
        self.weight[rank] = weight
        order = np.lexsort((kind_of, member))
        cuts = np.searchsorted(member[order], np.arange(m + 1))
        by_set = kind_of[order]
        self.paths = [by_set[cuts[k]:cuts[k + 1]] for k in range(self.count)]
        # who holds an element, or, if most do, who doesn't
        order = np.lexsort((member, kind_of))
        cuts = np.searchsorted(kind_of[order], np.arange(len(kinds) + 1))
        by_kind = member[order]
        self.base = np.zeros(len(kinds), dtype=np.int64)
        lists, signs = [], []
        for k in range(len(kinds)):
            holds = by_kind[cuts[k]:cuts[k + 1]]
            if 2 * len(holds) > m:
                self.base[k] = self.weight[k]
                holds = np.setdiff1d(np.arange(m), holds, assume_unique=True)
                signs.append(-self.weight[k])
            else:
                signs.append(self.weight[k])
            lists.append(holds)
        self.sizes = np.array([len(x) for x in lists], dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.lists = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
        self.signs = np.array(signs, dtype=np.float64)

    def _gain(self, elements: np.ndarray) -> np.ndarray:
        """What a stretch of a path adds to the overlap of every set."""
        sizes = self.sizes[elements]
        at = np.arange(sizes.sum()) + np.repeat(self.begin[elements] - np.cumsum(sizes) + sizes, sizes)
        return self.base[elements].sum() + np.bincount(
            self.lists[at], weights=np.repeat(self.signs[elements], sizes), minlength=self.total
        )

    def join(self) -> Iterator[tuple[int, np.ndarray]]:
        """(set, sets and probes linked with it), for every set of the tree."""
        order = sorted(range(self.count), key=lambda k: self.paths[k].tolist())
        paths = [self.paths[k] for k in order]
        sizes = [self.n[k] for k in order]
        reach = [int(self.weight[p].sum()) for p in paths]
        stack: list[tuple[int, int, int, np.ndarray, int]] = [
            (0, len(order), 0, np.zeros(self.total), 0)
        ]
        while stack:
            low, high, depth, overlap, done = stack.pop()
            first, last = paths[low], paths[high - 1]
            # sorted paths: what the first and the last share, all between them share
            short = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:short] != last[depth:short])
            end = depth + int(differ[0]) if len(differ) else short
            if end > depth:
                stretch = first[depth:end]
                overlap = overlap + self._gain(stretch)
                done += int(self.weight[stretch].sum())
            most = overlap + (max(reach[low:high]) - done)
            needed = self.percent * (self.n + min(sizes[low:high]))
            if (most * (100 + self.percent) >= needed).sum() < 1:
                continue
            while low < high and len(paths[low]) == end:
                k = order[low]
                union = self.n + self.n[k] - overlap
                linked = 100 * overlap >= self.percent * union
                linked[k] = False
                yield k, np.flatnonzero(linked)
                low += 1
            while low < high:
                following = paths[low][end]
                cut = low + 1
                while cut < high and paths[cut][end] == following:
                    cut += 1
                stack.append((low, cut, end, overlap, done))
                low = cut


def link_block(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """key, root, links of a task's sets, for each candidate group in it."""
    out = []
    for _, rows in group.groupby("root"):
        rows = rows.drop_duplicates(["side", "key"]).sort_values(["side", "key"])
        keys, copies = rows["key"].to_numpy(), rows["copies"].to_numpy()
        sets = [np.asarray(g).view(np.uint64) for g in rows["grams"]]
        mine = int((rows["side"] == 0).sum())
        alone = mine == len(rows)  # a block with itself, or two blocks
        trie = Trie(sets[:mine], sets[mine:], percent)
        root, links = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64)
        for k, linked in trie.join():
            if not alone:
                linked = linked[linked >= mine]
                links[linked] += copies[k]
            links[k] += copies[linked].sum()
            met = np.unique(root[np.append(linked, k)])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
        out.append(pd.DataFrame({"key": keys, "root": keys[root], "links": links}))
    return pd.concat(out) if out else pd.DataFrame({"key": [], "root": [], "links": []})


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of documents (doc_id, text): doc_id, rk, key, n of each row; key, root,
    component_id, n_links of each set that is not empty. Sets of one component share a root."""
    docs = docs.select("doc_id", "text")
    measured = materialize(_sets(docs, size), "jaccard-sets")
    classes = materialize(
        measured.where("key IS NOT NULL").groupBy("key", "n", "u").agg(
            F.min("doc_id").alias("doc_id"), F.min("rk").alias("rk"),
            F.count(F.lit(1)).alias("copies")
        ), "jaccard-classes",
    )
    total = measured.agg(F.sum("u")).first()[0] or 0
    shared = _shared(docs, size, slices_for(total, KEYS_PER_SLICE))
    lacking = F.col("n") - F.ceil(F.col("n") * percent / 100)
    near = materialize(
        classes.join(shared, "key", "left")
        .where(F.coalesce("shared", F.lit(0)) >= F.col("u") - lacking)
        .select("rk", "key", "n", "copies"), "jaccard-near",
    )

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(set_key(g), g) for _, g in
                     gram_sets(b.column(0).to_pylist(), b.column(0).to_pylist(), size) if len(g)]
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in found], pa.int64()),
                pa.array([g.view(np.int64) for _, g in found], pa.list_(pa.int64())),
            ], names=["key", "grams"])

    # a repeated row gives its set twice, which nothing below minds
    sets = materialize(
        docs.select(_row_key(), "text").join(small(near.select("rk")), "rk", "left_semi")
        .select("text").mapInArrow(grams, "key long, grams array<long>")
        .join(small(near.drop("rk")), "key"), "jaccard-grams",
    )
    elements = sets.select("key", "n", F.explode("grams").alias("gram"))
    frequent = elements.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # what is in no other set comes first in the order, and can't be what two prefixes share
    ordered = elements.join(frequent, "gram").groupBy("key", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("o")
    ).withColumn("prefix", F.size("o") - F.ceil(F.col("n") * percent / 100) + 1).where("prefix > 0")
    prefixes = materialize(
        ordered.select("key", F.explode(F.slice("o", F.lit(1), F.col("prefix").cast("int"))).alias("e"))
        .select("key", "e.gram"), "jaccard-prefixes",
    )
    stars = prefixes.groupBy("gram").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("k"))
    candidates = components(
        prefixes.join(stars.where("k > 1"), "gram").select(F.col("key").alias("a"), "b"),
        "jaccard-candidates",
    )
    grouped = candidates.select(F.col("root").alias("key"), "root").distinct().unionByName(
        candidates.select(F.col("id").alias("key"), "root")
    )
    placed = materialize(
        running_total(
            grouped.join(near.select("key", "n"), "key"), ["root", "n", "key"], "n", "jaccard-order"
        ).select("key", "root", "n", F.floor(F.col("before") / BLOCK_GRAMS).alias("block")),
        "jaccard-blocks",
    )
    spans = placed.groupBy("root", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = spans.select("root", F.col("block").alias("block2"), F.col("lo").alias("lo2"))
    pairs = spans.join(other, "root").where(
        "block2 >= block AND lo2 * {} <= hi * 100".format(percent)
    ).select("root", "block", "block2")
    first = placed.join(pairs, ["root", "block"]).select(
        "key", "root", "block", "block2", F.lit(0).alias("side"))
    second = placed.select("key", "root", F.col("block").alias("block2")).join(
        pairs.where("block < block2"), ["root", "block2"]
    ).select("key", "root", "block", "block2", F.lit(1).alias("side"))
    parts = materialize(first.unionByName(second), "jaccard-parts")
    linked = materialize(
        sets.select("key", "copies", "grams").join(small(parts), "key")
        .groupBy("block", "block2").applyInPandas(
            lambda group: link_block(group, percent), "key long, root long, links long"
        ), "jaccard-links",
    )
    joined = components(
        linked.select(F.col("key").alias("a"), F.col("root").alias("b")), "jaccard-components"
    )
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.join(links, "key", "left").join(
        joined.withColumnRenamed("id", "key"), "key", "left"
    ).withColumn("root", F.coalesce("root", "key"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classed = named.join(smallest, "root").select(
        "key", "root", "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return measured, classed


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word n-grams of lower-cased words (A-Z); component_id is the smallest doc_id that
    links reach. All links are found:

    1. equal sets are one class from here on;
    2. a document whose partner has at least ``percent`` of its n-grams lacks few of them; by
       a fixed part of all n-grams, those that share too few with any other are left out;
    3. the remaining sets are ordered by document frequency, rarest first; linked sets share
       an element of their prefixes, so prefixes give groups of candidates;
    4. groups are cut into blocks of bounded size; each pair of blocks whose set sizes are
       compatible is joined with a :class:`Trie`.

    A null or wordless text has the empty set and links with nothing. Rows that share a doc_id
    are documents of their own; a row without doc_id takes part, but is never a component's
    name (alone, its component_id is null). Repeated rows are copies. An empty table gives no
    rows; other columns are ignored.
    """
    rows, classes = _classes(docs, size, percent)
    return rows.join(classes, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, all rows without words, and all rows without a
    doc_id; all columns stay.

    The row with the smallest doc_id stays; of different texts under that id the one with the
    smallest hash; of repeated rows the one whose columns have the smallest hash. Texts that
    don't link stay apart, whatever ids they share.
    """
    named = docs.where("doc_id IS NOT NULL")
    rows, classes = _classes(named, size, percent)
    known = rows.join(classes.select("key", "root"), "key")
    kept = materialize(
        known.groupBy("root").agg(F.min(F.struct("doc_id", "rk")).alias("r")).select("r.rk"),
        "jaccard-kept",
    )
    repeated = materialize(
        known.groupBy("rk").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("rk")
        .join(kept, "rk", "left_semi"), "jaccard-repeated",
    )
    empty = rows.where("key IS NULL").select("rk").distinct()
    keyed = named.withColumn("_rk", _row_key())
    here = F.col("_rk") == F.col("rk")
    once = keyed.join(
        kept.join(repeated, "rk", "left_anti").unionByName(empty), here, "left_semi")
    copies = keyed.join(repeated, here, "left_semi").groupBy("_rk").agg(
        F.min(F.struct(F.xxhash64(*docs.columns).alias("h"), *docs.columns)).alias("r"))
    return (
        once.select(*docs.columns)
        .unionByName(copies.select(*[F.col("r")[c].alias(c) for c in docs.columns]))
        .unionByName(docs.where("doc_id IS NULL"))
    )
