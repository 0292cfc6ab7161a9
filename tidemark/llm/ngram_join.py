"""Jaccard join of word shingle sets, exact, by adaptive multi-match prefixes.

All shingles have one order, the rare before the frequent. Of a set of s shingles that must share t = ceil(threshold * s)
with any partner, the first s - t + l are its l-prefix: the first l shingles that two similar sets share lie in the
l-prefixes of both. So sets whose prefixes share fewer than min(l, l') shingles need not be verified. Each set takes the l
with the least estimated cost: the postings of its prefix, plus the verification of those that can match l times.

Sets are folded by 128 bits of their content first. Frequencies are counted without moving sets: tasks send blocks of
(shingle, set) to one of many parts by the shingle's hash, where equal shingles meet, and only shingles that at least two
sets hold come back. Shingles of one set alone can neither be shared nor, being the first of the order, serve in a
prefix; sets that are left with fewer than t shingles have no partner and go no further. A hot shingle reaches its part
once for each set, in columns of numbers, not rows.

Links serve components, so pairs within one component are not looked for. In each posting the others are compared with
its leader, the set with the fewest shingles of its own, so a group of near copies takes a comparison each; postings that
still hold several components get other leaders, and at last their members are joined across components, where only
pairs with enough shared prefix, and sketches of all their shingles that are close enough, leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, slices, text_buffer
from .dart_minhash import ROWS_A_TASK, _joined, components
from .shingles import mix, shingle_sets

#: Shingles for each part that counts them, and for each part that builds prefixes, about.
PART_SHINGLES = 1 << 20
#: Bytes that a shingle is sent in. Its part is known, which is as many bits more as there are parts, so that no two of a
#: part's shingles are likely to be taken for one, whatever the size of the input.
GRAM_BYTES = 6
#: Cost of comparing one shingle of two sets, in postings read.
VERIFY = 1 / 16
#: Bits of a set's sketch: of each, whether an odd number of its shared shingles fall on it.
SKETCH_BITS = 512
#: Rounds of leaders before postings are joined across components.
LEADERS = 4
_SALT, _TURN = np.uint64(0xA0761D6478BD642F), np.uint64(0xD6E8FEB86659FD93)
_ASK = "part long, nodes binary, sizes binary, counts binary, grams binary"
_REPLY = "area long, nodes binary, sizes binary, counts binary, grams binary, sets binary"


def _lowered(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(column.fill_null(""))


def _named(words: int):
    """Rows (_key, _text, _th) as (_key, _th, f1, f2, size): two sums name the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                owner, h, _ = shingle_sets(*text_buffer(_lowered(batch.column(1))), words)
                at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                salted = mix(h ^ _SALT)
                sums = []
                for values in (salted, mix(salted + _TURN)):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(values, out=total[1:])
                    sums.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
                yield pa.record_batch([batch.column(0), batch.column(2), *sums, pa.array(np.diff(at))], names=["_key", "_th", "f1", "f2", "size"])

    return run


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(x)))


def _packed(*columns: np.ndarray, width: int = 8) -> list[pa.Array]:
    """Longs as bytes of one significance after the other (the shuffle's compression then finds their runs); of the last column `width` bytes each."""
    out = []
    for i, c in enumerate(columns):
        planes = np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)
        out.append(pa.array([planes[:, : width if i == len(columns) - 1 else 8].T.tobytes()], pa.binary()))
    return out


def _unpacked(column: pa.ChunkedArray, width: int = 8) -> np.ndarray:
    parts = [np.zeros(0, np.uint64)]
    for raw in column.to_pylist():
        planes = np.zeros((len(raw) // width, 8), np.uint8)
        planes[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
        parts.append(planes.reshape(-1).view("<u8"))
    return np.concatenate(parts)


def _ask(words: int, parts: int):
    """Rows (node, _text) as blocks for each part: nodes, their sizes, how many shingles each sends, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                node = batch.column(0).to_numpy()
                owner, h, _ = shingle_sets(*text_buffer(_lowered(batch.column(1))), words)
                size = np.bincount(owner, minlength=len(node))
                part, rest = (h % np.uint64(parts)).astype(np.int64), h // np.uint64(parts)
                order = np.argsort(part, kind="stable")
                part, owner, rest = part[order], owner[order], rest[order]
                for at, n in zip(*_runs(part)):
                    start, times = _runs(owner[at : at + n])
                    who = owner[at + start]
                    yield pa.record_batch([pa.array(part[at : at + 1]), *_packed(node[who], size[who], times, rest[at : at + n], width=GRAM_BYTES)], names=["part", "nodes", "sizes", "counts", "grams"])

    return run


def _count(parts: int):
    """All blocks of a part as blocks for each area of nodes: the shingles that at least two nodes hold, and how many do."""

    def run(blocks: pa.Table) -> pa.Table:
        nodes, sizes, counts = (_unpacked(blocks.column(c)).astype(np.int64) for c in ("nodes", "sizes", "counts"))
        grams = _unpacked(blocks.column("grams"), GRAM_BYTES) * np.uint64(parts) + np.uint64(blocks.column("part")[0].as_py())
        node, size = np.repeat(nodes, counts), np.repeat(sizes, counts)
        order = np.lexsort((node, grams))
        node, size, grams = node[order], size[order], grams[order]
        once = np.ones(len(grams), bool)  # a repeated row sends its shingles again
        once[1:] = (grams[1:] != grams[:-1]) | (node[1:] != node[:-1])
        node, size, grams = node[once], size[once], grams[once]
        _, times = _runs(grams)
        held = np.repeat(times, times)
        node, size, grams, held = (c[held > 1] for c in (node, size, grams, held))
        area = (mix(node.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((node, area))
        area, node, size, grams, held = (c[order] for c in (area, node, size, grams, held))
        out = []
        for at, n in zip(*_runs(area)):
            start, times = _runs(node[at : at + n])
            out.append([pa.array(area[at : at + 1]), *_packed(node[at + start], size[at + start], times, grams[at : at + n], held[at : at + n])])
        names = ["area", "nodes", "sizes", "counts", "grams", "sets"]
        kinds = [pa.int64()] + [pa.binary()] * 5
        return pa.Table.from_batches([pa.record_batch(c, names=names) for c in out], pa.schema(list(zip(names, kinds, strict=True))))

    return run


def prefix(size: int, held: np.ndarray, percent: int) -> tuple[int, int]:
    """(l, length) of the cheapest prefix of a set's shared shingles, whose frequencies `held` rise; its own ones come before.

    With l matches asked for, at most postings / l sets can match, each verified at a cost of the set's size.
    """
    t = -(-size * percent // 100)
    lengths = len(held) - t + np.arange(1, t + 1)
    postings = np.cumsum(held - 1)[lengths - 1]
    cost = postings * (1 + VERIFY * size / np.arange(1, t + 1))
    best = int(cost.argmin())
    return best + 1, int(lengths[best])


def _prefixes(percent: int):
    """All blocks of an area as a row for each node that can have a partner: node, size, own, match, length, grams by order."""

    def run(blocks: pa.Table) -> pa.Table:
        nodes, sizes, counts, grams, held = (_unpacked(blocks.column(c)) for c in ("nodes", "sizes", "counts", "grams", "sets"))
        nodes, sizes, counts, held = (c.astype(np.int64) for c in (nodes, sizes, counts, held))
        node, size = np.repeat(nodes, counts), np.repeat(sizes, counts)
        order = np.lexsort((grams, held, node))
        node, size, grams, held = (c[order] for c in (node, size, grams, held))
        out = []
        for at, n in zip(*_runs(node)):
            s = int(size[at])
            if 100 * n >= percent * s:
                match, length = prefix(s, held[at : at + n], percent)
                own = grams[at : at + n]
                odd = np.bincount((mix(own) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
                out.append((int(node[at]), s, s - int(n), match, length, own.view(np.int64), np.packbits(odd).view(np.int64)))
        names = ["node", "size", "own", "match", "length", "grams", "sketch"]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds, strict=True)], names=names)

    return run


def _side(sets: DataFrame, k: str) -> DataFrame:
    return sets.select(*[F.col(c).alias(f"{c}_{k}") for c in sets.columns])


def _shares_prefix() -> Column:
    """Whether the sets a and b can be similar: their prefixes share as many shingles as the less demanding asks for."""
    common = F.array_intersect(F.slice("grams_a", 1, F.col("length_a").cast("int")), F.slice("grams_b", 1, F.col("length_b").cast("int")))
    return F.size(common) >= F.least("match_a", "match_b")


def _fits(percent: int) -> Column:
    """Whether sizes allow the threshold, shingles that only one set has left out."""
    most = F.least(F.col("size_a") - F.col("own_a"), F.col("size_b") - F.col("own_b"))
    return 100 * most >= percent * (F.col("size_a") + F.col("size_b") - most)


def _alike(percent: int) -> Column:
    """Whether sketches allow the threshold: bits that differ are shingles that one of the two has alone, some of which hide each other."""
    apart = sum((F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.col("own_a") + F.col("own_b"))
    return (100 + percent) * apart <= (100 - percent) * (F.col("size_a") + F.col("size_b"))


def _verified(percent: int) -> Column:
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return 100 * both >= percent * (F.col("size_a") + F.col("size_b") - both)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node_a, node_b, ...) that link."""
    both = pairs.join(_side(sets, "a"), "node_a").join(_side(sets, "b"), "node_b").where(_fits(percent))
    return both.where(_shares_prefix()).where(_verified(percent)).select(*pairs.columns)


def _leads(rows: DataFrame, turn: int, tasks: int) -> DataFrame:
    """A leader of each posting with several components: the set with the fewest own shingles first, then those of others by chance."""
    chance = F.lit(0) if not turn else F.xxhash64("label", F.lit(turn))
    lead = rows.groupBy("gram").agg(F.min(F.struct(chance.alias("h"), "own", "node", "label")).alias("r"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return cut(lead.select("gram", "r").coalesce(tasks))


def _across(rows: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs of components (a, b) with a link within a posting, of postings that hold several components.

    One side are the sets outside a posting's largest component; a pair is taken in the first shingle its prefixes share.
    Sketches keep all but the pairs near the threshold inside the join.
    """
    per = rows.groupBy("gram", "label").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1").select("gram", "main")
    mixed = rows.join(cut(per.coalesce(tasks)), "gram").join(sets.drop("own"), "node")
    mixed = cut(mixed.select("gram", "main", "label", "node", "own", "size", "match", "length", "sketch", F.slice("grams", 1, F.col("length").cast("int")).alias("grams")))
    a, b = _side(mixed.where("label <> main").drop("main"), "a"), _side(mixed.drop("main"), "b")
    ahead = (F.col("label_b") != F.col("label_a")) & ((F.col("label_b") == F.col("main")) | (F.col("label_a") < F.col("label_b")))
    b = b.join(mixed.select(F.col("gram").alias("gram_b"), "main").distinct(), "gram_b")
    first = F.array_min(F.array_intersect("grams_a", "grams_b")) == F.col("gram_a")
    pairs = a.join(b, F.col("gram_a") == F.col("gram_b")).where(ahead & _fits(percent) & _alike(percent)).where(first & _shares_prefix())
    pairs = cut(pairs.select("node_a", "node_b", F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")))
    return _links(pairs, sets, percent).select("a", "b").distinct()


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """(node, label): the smallest node of each component, for nodes with links; sets as _prefixes gives them."""
    rows = sets.select("node", "own", F.explode(F.slice("grams", 1, F.col("length").cast("int"))).alias("gram"))
    shared = rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    rows = cut(rows.join(shared, "gram"))
    tasks = max(8, -(-rows.count() // ROWS_A_TASK))
    rows, labels = rows.coalesce(tasks), None
    placed = rows.withColumn("label", F.col("node"))
    for turn in range(LEADERS):
        lead = _leads(placed, turn, tasks)
        if lead.isEmpty():
            break
        # a set is compared with the first of its postings' leaders
        pairs = placed.join(lead, "gram").where(F.col("label") != F.col("r.label")).groupBy("node", "label").agg(F.min("r").alias("r"))
        pairs = pairs.select(F.col("node").alias("node_a"), F.col("r.node").alias("node_b"), F.least("label", "r.label").alias("a"), F.greatest("label", "r.label").alias("b"))
        links = cut(_links(cut(pairs), sets, percent).select("a", "b").distinct().coalesce(tasks))
        labels = _joined(labels if labels is not None else links.select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("label")).limit(0), links, tasks)
        placed = rows.join(labels, "node", "left").select("gram", "node", "own", F.coalesce("label", "node").alias("label"))
    else:
        if not _leads(placed, LEADERS, tasks).isEmpty():
            labels = _joined(labels, cut(_across(placed, sets, percent, tasks).coalesce(tasks)), tasks)
    return labels


def link_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: key, n_shingles and component_id, the smallest key that links reach from it, itself included.

    Two sets of distinct shingles link at a Jaccard similarity of percent / 100 or more, compared in integers. Words are
    runs without ASCII white space with A-Z lowered; a text of fewer words than `words` is one shingle of them all. Texts
    without words (null, empty) link with nothing, and neither do rows with a null key, whose component is null. Repeated
    keys are rows of their own, each linked by its own text; repeated rows share a component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(key)).dtypes[0][1]
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_th"))
    signed = cut(slim.mapInArrow(_named(words), f"_key {kind}, _th long, f1 long, f2 long, size long"))
    usable = signed.where("size > 0 AND _key IS NOT NULL")
    held = usable.groupBy("f1", "f2").agg(F.min(F.struct("_key", "_th")).alias("rep"), F.min("size").alias("size"))
    held = cut(held.withColumn("node", F.monotonically_increasing_id()))
    shingles = held.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // PART_SHINGLES))
    # one text for each set: rows equal in key and text meet before the join, which has the same key
    texts = slim.where(F.col("_key").isNotNull()).groupBy("_key", "_th").agg(F.min("_text").alias("_text"))
    texts = texts.join(held.select("rep._key", "rep._th", "node"), ["_key", "_th"]).select("node", "_text")
    replies = texts.mapInArrow(_ask(words, parts), _ASK).groupBy("part").applyInArrow(_count(parts), _REPLY)
    sets = cut(replies.groupBy("area").applyInArrow(_prefixes(percent), "node long, size long, own long, match long, length long, grams array<long>, sketch array<long>"))
    labels = linked(sets, percent)
    folded = held.select("f1", "f2", F.col("rep._key").alias("component_id"))
    if labels is not None:
        placed = cut(held.select("f1", "f2", "node", F.col("rep._key").alias("rep")).join(labels, "node"))
        names = cut(placed.groupBy("label").agg(F.min("rep").alias("least")))
        linked_sets = placed.join(names, "label").select("f1", "f2", "least")
        folded = cut(folded.join(linked_sets, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("least", "component_id").alias("component_id")))
    out = signed.join(folded, ["f1", "f2"], "left")
    mine = F.when(F.col("_key").isNotNull() & (F.col("size") > 0), F.col("component_id")).otherwise(F.col("_key"))
    return out.select(F.col("_key").alias(key), F.col("size").alias("n_shingles"), mine.alias("component_id"))


ORACLE_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
s AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (WITH RECURSIVE reach(x, y) AS (SELECT a, b FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y) SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r.y, w.doc_id)) AS component_id FROM w LEFT JOIN s USING (doc_id) LEFT JOIN r ON r.x = w.doc_id
"""
