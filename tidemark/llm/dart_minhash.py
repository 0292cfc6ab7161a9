"""MinHash near-duplicates: DartMinHash signatures, banded, with exact checks of candidate pairs.

Every shingle owns a strip of the plane of weight and rank, on which darts fall at rate one; strip and darts are fixed
by the shingle's hash, so equal shingles have equal darts in all documents. A document sees the darts below its weight
and a rank limit of about k ln k over its total weight, each dart is dealt to one of k coordinates, and the earliest
dart of a coordinate is its value. Two documents agree on a coordinate with the probability of their weighted Jaccard
similarity. Band keys of `ROWS` coordinates give candidates.

Copies (equal shingle sets, named by 128 bits of their content) are folded first. In each bucket of a band all members
are compared with one leader, the least name, so that a group's bands mostly share one; the links found so far are
closed to components. Buckets that still hold several components get two other leaders, and at last are compared across
components, without the pairs that bounds on their overlap rule out. A candidate is linked only if the Jaccard
similarity of its shingle sets, counted exactly, is at least the threshold.

Small aggregates (leaders, least neighbours, classes) are written before rows are joined to them: a join whose two sides
come straight from shuffles is one that adaptive execution can split where one bucket, hub or text holds many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, slices, text_buffer
from .shingles import mix, shingle_sets

BANDS, ROWS, THRESHOLD, WORDS = 25, 5, 0.8, 5
#: Rows (of a name and a number, or of a text's bands) and shingles that are worth a task of their own.
ROWS_A_TASK, SHINGLES_A_TASK = 20_000, 4_000_000
_C1, _C2, _C3 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """DartMinHash values (docs, k) of weighted sets, rows sorted by owner; documents without elements keep zeros."""
    out = np.zeros((docs, k), np.uint64)
    total = np.bincount(owner, weight, docs)
    reach = k * (np.log(k) + 3.0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        pick = np.isin(owner, todo) if len(todo) < docs else slice(None)
        o, e, w = owner[pick], h[pick], weight[pick]
        strips = np.ceil(w).astype(np.int64)
        if len(strips) and strips.max() > 1:
            rep = np.repeat(np.arange(len(e)), strips)
            level = np.arange(len(rep)) - np.repeat(np.cumsum(strips) - strips, strips)
            o, w, seed = o[rep], w[rep] - level, mix(e[rep] + level.astype(np.uint64) * _C3)
        else:
            seed = mix(e)
        limit, rank = (reach / total)[o], np.zeros(len(o))
        got_doc, got_coord, got_rank, got_id, n = [], [], [], [], 0
        live = np.arange(len(o))
        while len(live):
            n += 1
            dart = mix(seed[live] + np.uint64(n * int(_C1) % 2**64))
            rank_now = rank[live] - np.log(_unit(dart))
            hit = rank_now <= limit[live]
            live, dart, rank_now = live[hit], dart[hit], rank_now[hit]
            rank[live] = rank_now
            inside = slice(None) if (w >= 1).all() else _unit(mix(dart + _C3)) < w[live]
            d2 = mix(dart[inside] + _C2)
            got_doc.append(o[live[inside]] if not isinstance(inside, slice) else o[live])
            got_coord.append((d2 % np.uint64(k)).astype(np.int64))
            got_rank.append(rank_now[inside])
            got_id.append(d2)
        key = np.concatenate(got_doc) * k + np.concatenate(got_coord)
        ranks, ids = np.concatenate(got_rank), np.concatenate(got_id)
        order = np.lexsort((ranks, key))
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        flat = out.reshape(-1)
        flat[key[first]] = ids[order][first] | np.uint64(1)
        todo = todo[(out[todo] == 0).any(axis=1)]  # a coordinate without a dart: look further up
        out[todo] = 0
        reach *= 1.6
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            x = mix(x * _C1 + sig[:, b * rows + r])
        keys[:, b] = x
    return keys


def _sketch(bands: int, rows: int, words: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                n = batch.num_rows
                owner, h, times = shingle_sets(*text_buffer(pc.utf8_lower(batch.column(1).fill_null(""))), words)
                weight = times.astype(float) if weighted else np.ones(len(h))
                keys = band_keys(signatures(owner, h, weight, n, bands * rows), bands, rows).view(np.int64)
                salted = mix(h * np.uint64(2) + np.uint64(1)) if not weighted else mix(h + times.astype(np.uint64) * _C2)
                # two commutative sums name a set; sizes below 2^31
                f1, f2, size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.bincount(owner, minlength=n)
                np.add.at(f1, owner, salted)
                np.add.at(f2, owner, mix(salted ^ _C1))
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * bands)
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))], names=["_key", "_th", "f1", "f2", "size", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                owner, h, _ = shingle_sets(*text_buffer(pc.utf8_lower(batch.column(1).fill_null(""))), words)
                offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], names=["node", "grams"])

    return run


def _stars(edges: DataFrame) -> bool:
    """Whether links (a, b) are stars: every b has one a, and no a is a b."""
    ends = edges.select(F.col("b").alias("n"), F.lit(1).alias("under"), F.lit(0).alias("over")).unionByName(edges.select(F.col("a").alias("n"), F.lit(0).alias("under"), F.lit(1).alias("over")))
    return ends.groupBy("n").agg(F.sum("under").alias("under"), F.max("over").alias("over")).where("under > 1 OR under = 1 AND over = 1").isEmpty()


def components(links: DataFrame, tasks: int = 8) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes with links; links (a, b), a < b.

    Large-star and small-star steps alternate until only stars are left: each joins links to the smallest neighbour of
    their ends and writes shorter trees, in `tasks` tasks at most. Nothing is gathered in one task or on the driver.
    """
    edges = cut(links.select("a", "b").distinct().coalesce(tasks))
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()  # b > a >= m
        down = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.join(down, large["b"] == down["n"]).select("m", "a").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = cut(small.unionByName(down.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct().coalesce(tasks))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _joined(labels: DataFrame, pairs: DataFrame, tasks: int) -> DataFrame:
    """labels with the components of pairs (a, b) of labels made one; pairs are few beside the labels."""
    if pairs.isEmpty():
        return labels
    new = cut(components(pairs, tasks).coalesce(tasks)).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    held = labels.join(new, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    return cut(held.unionByName(new.select(F.col("label").alias("node"), F.col("_to").alias("label"))).distinct().coalesce(tasks))  # a label may be a node without earlier links


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of pairs (a, b, ...) whose sets' Jaccard similarity is at least the threshold."""
    a = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    close = (F.size("ga") >= threshold * F.size("gb")) & (F.size("gb") >= threshold * F.size("ga"))
    return pairs.join(a, "a").join(b, "b").where(close).where(both >= threshold * (F.size("ga") + F.size("gb") - both)).drop("ga", "gb")


def _mixed(buckets: DataFrame, labels: DataFrame, tasks: int) -> DataFrame:
    """(band, node, label) of the buckets that still hold several components."""
    placed = buckets.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    several = cut(placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band").coalesce(tasks))
    return cut(placed.join(several, "band").coalesce(tasks))


def _own_shingles(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, size, own): each set's shingles, and how many of them no other set in these buckets has."""
    here = sets.join(mixed.select("node").distinct(), "node", "left_semi")
    grams = here.select("node", F.explode("grams").alias("gram"))
    alone = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    return here.select("node", F.size("grams").alias("size")).join(alone, "node", "left").na.fill(0, ["own"])


def _across(mixed: DataFrame, sized: DataFrame, grams: DataFrame, bands: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """The pairs (a, b) of components with a link within one bucket.

    Members outside a bucket's largest component are compared with all others. A set's own shingles cannot be shared,
    so similarity is at most (size - own) / (other size + own): sets for which that is too low even against the
    bucket's smallest set are left out. A pair is counted in its first common band only, and only links leave the join.
    """
    rows = cut(mixed.join(sized, "node").coalesce(tasks))
    per = rows.groupBy("band", "label").agg(F.count("*").alias("n"), F.min("size").alias("least")).groupBy("band").agg(F.max(F.struct("n", F.col("label")))["label"].alias("main"), F.min("least").alias("least"))
    few = rows.join(cut(per.coalesce(tasks)), "band").where((F.col("label") != F.col("main")) & (F.col("size") - F.col("own") >= threshold * (F.col("least") + F.col("own"))) & (F.col("size") - F.col("own") >= threshold * F.col("size")))
    few = cut(few.select(*rows.columns).coalesce(tasks))
    both = rows.join(few.select("band").distinct(), "band", "left_semi")
    full = grams.join(bands, "node")
    x, y = (d.join(full, "node").select("band", *[F.col(c).alias(f"{c}_{k}") for c in ("label", "size", "own", "grams", "bands")]) for k, d in (("x", few), ("y", both)))
    most = F.least(F.col("size_x") - F.col("own_x"), F.col("size_y") - F.col("own_y"))
    shared = F.size(F.array_intersect("grams_x", "grams_y"))
    near = (F.col("label_x") != F.col("label_y")) & (most >= threshold * (F.col("size_x") + F.col("size_y") - most))
    near = near & (F.array_intersect("bands_x", "bands_y")[0] == F.col("band")) & (shared >= threshold * (F.col("size_x") + F.col("size_y") - shared))
    return x.join(y, "band").where(near).select(F.least("label_x", "label_y").alias("a"), F.greatest("label_x", "label_y").alias("b")).distinct()


def _ends(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _settle(buckets: DataFrame, mixed: DataFrame, labels: DataFrame, stars: DataFrame, grams: DataFrame, bands: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """labels after all links within the buckets that hold several components."""
    sized = cut(_own_shingles(mixed, grams).coalesce(tasks))
    # two new leaders: the set with the fewest shingles of its own, which lies in the middle of a group, and any other
    chance = F.xxhash64("node", "band", F.lit(1))
    lead = mixed.join(sized, "node").groupBy("band").agg(F.min(F.struct("own", chance.alias("h"), "node", "label")).alias("x"), F.min(F.struct(chance.alias("h"), "node", "label")).alias("y"))
    lead = cut(lead.select("band", F.explode(F.array(F.struct("x.node", "x.label"), F.struct("y.node", "y.label"))).alias("l")).select("band", F.col("l.node").alias("lead"), F.col("l.label").alias("of")).coalesce(tasks))
    more = mixed.join(lead, "band").where(F.col("label") != F.col("of")).select(*_ends("node", "lead"), F.least("label", "of").alias("x"), F.greatest("label", "of").alias("y")).distinct()
    more = _linked(cut(more.join(stars, ["a", "b"], "left_anti").coalesce(tasks)), grams, threshold)
    labels = _joined(labels, cut(more.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().coalesce(tasks)), tasks)
    mixed = _mixed(buckets, labels, tasks)
    return labels if mixed.isEmpty() else _joined(labels, cut(_across(mixed, sized, grams, bands, threshold, tasks).coalesce(tasks)), tasks)


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD,
    words: int = WORDS, weighted: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: key, class_id (the smallest key of its near-duplicates), kept (whether it is that one),
    n_shingles and the columns in carry.

    Words are lowered runs without white space; a text of fewer words than `words` is one shingle. weighted=True signs
    shingles by their number of occurrences; links are always checked on shingle sets. Texts without words (null,
    empty) are classes of their own, and so are rows with a null key. Each row is classed by its own text, also where a
    key repeats with other texts; classes that share their smallest key share a name. Repeated rows have one class; all
    of them are `kept` if it has their key. An empty table gives no rows.
    """
    kinds = dict(docs.dtypes)
    th = F.xxhash64(F.col(text))  # tells the texts of one key apart
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), th.alias("_th")).where(F.col("_key").isNotNull())
    signed = cut(slim.mapInArrow(_sketch(bands, rows, words, weighted), f"_key {kinds[key]}, _th long, f1 long, f2 long, size long, bands array<long>"))
    node = F.struct("f1", "f2")
    # small tables go in few tasks, as every task of every step writes a file and starts processes for it; these numbers follow the table
    held = signed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("shingles")).first()
    wide, long = max(8, -(-held["rows"] // ROWS_A_TASK)), max(8, -(-held["rows"] // ROWS_A_TASK), -(-held["shingles"] // SHINGLES_A_TASK))
    sets = cut(signed.where("size > 0").groupBy("f1", "f2").agg(F.min(F.struct("_key", "_th")).alias("rep"), F.min("bands").alias("bands")).coalesce(wide))
    dealt = sets.select("f1", F.explode("bands").alias("band"))  # half of the name is enough to find shared buckets
    shared = cut(dealt.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band").coalesce(wide))
    buckets = cut(dealt.join(shared, "band").join(sets.select("f1", "f2"), "f1").select("band", node.alias("node")).distinct().coalesce(wide))
    # what follows is at most a few times as long
    tasks = max(8, -(-buckets.count() // ROWS_A_TASK))
    buckets = buckets.coalesce(tasks)
    named = cut(sets.join(buckets.select(F.col("node.f1").alias("f1"), F.col("node.f2").alias("f2")).distinct(), ["f1", "f2"]).select("rep._key", "rep._th", node.alias("node"), "bands").coalesce(wide))
    texts = slim.join(named.drop("bands"), ["_key", "_th"]).groupBy("_key", "_th", "node").agg(F.min("_text").alias("_text"))
    grams = cut(texts.select("node", "_text").mapInArrow(_sets(words), "node struct<f1: long, f2: long>, grams array<long>").coalesce(long))
    lead = cut(buckets.groupBy("band").agg(F.min("node").alias("lead")).coalesce(tasks))
    stars = cut(buckets.join(lead, "band").where("node <> lead").select(*_ends("node", "lead")).distinct().coalesce(tasks))
    labels = cut(components(_linked(stars, grams, threshold), tasks).coalesce(tasks))
    mixed = _mixed(buckets, labels, tasks)
    if not mixed.isEmpty():
        labels = _settle(buckets, mixed, labels, stars, grams, named.select("node", "bands"), threshold, tasks)
    placed = labels.select("label", F.col("node.f1").alias("f1"), F.col("node.f2").alias("f2")).join(sets.select("f1", "f2", F.col("rep._key").alias("rep")), ["f1", "f2"])
    names = cut(placed.groupBy("label").agg(F.min("rep").alias("class_id")).coalesce(tasks))
    linked = placed.join(names, "label").select("f1", "f2", "class_id")
    classes = cut(sets.select("f1", "f2", F.col("rep._key").alias("rep")).join(linked, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("class_id", "rep").alias("class_id")).coalesce(wide))
    found = signed.where("size > 0").join(classes, ["f1", "f2"]).groupBy("_key", "_th").agg(F.min("class_id").alias("class_id"), F.max("size").alias("n_shingles"))
    own = docs.select(F.col(key).alias("_key"), th.alias("_th"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    out = own.join(found, ["_key", "_th"], "left").withColumn("class_id", F.coalesce("class_id", "_key"))
    return out.select(
        F.col("_key").alias(key), "class_id", (F.col("_key").isNull() | (F.col("class_id") == F.col("_key"))).alias("kept"), F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )
