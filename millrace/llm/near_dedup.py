"""Near-duplicate documents: SetSketch bands find candidates, a joint likelihood drops most, exact sets confirm the rest.

A document's set holds the hashes of its distinct 5-word shingles; documents of equal sets form a class, and the work goes
on with one node for each class, however many copies it has. Nodes whose sketches agree in a whole band share a bucket.
Each bucket first compares its nodes with its least one. Where that leaves a bucket in several components, all pairs of
nodes of different components are compared: pair by pair in small buckets, and in blocks of nodes by one product of
incidence matrices in large ones, so that no pair is passed over for a bucket's size.

A very long text is hashed in slices; its set is one row. Null text and text without words has an empty set and links with nothing. Copies, repeated rows and ties fall into one
component; the least non-null doc_id names it (null if there is none). Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import setsketch
from millrace.llm.components import components
from millrace.llm.text import buffers, chunks, mix, shingles, word_hashes
from millrace.session import settled, ship, stored

WIDTH, PERCENT = 5, 75
#: Nodes of a bucket up to which its pairs are compared singly, by joins; beyond that by blocks of about so many nodes and
#: elements at most. Both compare all pairs.
SINGLY, BLOCK, BLOCK_ELEMENTS = 64, 256, 1 << 20
#: A set or component that holds more than one row in so many is joined by broadcast; fewer than so many can.
HOT = 1024
#: Columns of an incidence matrix that are multiplied at once.
COLUMNS = 8192


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and how many each has."""
    words, counts = word_hashes(data, offsets)
    runs, per = shingles(words, counts, WIDTH)
    owner = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[new], np.bincount(owner[new], minlength=len(per))


def _nodes(elements: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A 128-bit name of each set."""
    starts, halves = np.cumsum(sizes) - sizes, []
    for salt in (11, 0x5DEECE66D):
        sums = np.add.reduceat(np.append(mix(elements + np.uint64(salt)), np.uint64(0)), starts)
        halves.append(mix(np.where(sizes > 0, sums, 0).astype(np.uint64) + sizes.astype(np.uint64)))
    names = np.stack(halves, 1).tobytes()
    return pa.array([names[k : k + 16] for k in range(0, len(names), 16)], pa.binary())


def _rows(docs: DataFrame, with_sets: bool) -> DataFrame:
    """doc_id, row_key, node and n of each row, with the keys of its bands, or with its sketch and set instead."""
    ship(docs.sparkSession)
    extra = "sketch binary, elements binary" if with_sets else "bands array<long>"

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                elements, sizes = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                starts, some = np.cumsum(sizes) - sizes, sizes > 0
                sketches = np.zeros((b - a, setsketch.REGISTERS), np.uint16)
                if some.any():
                    sketches[some] = setsketch.registers(elements, starts[some])
                out = [batch.column("doc_id").slice(a, b - a), batch.column("row_key").slice(a, b - a), _nodes(elements, sizes), pa.array(sizes.astype(np.int64))]
                names = ["doc_id", "row_key", "node", "n"]
                if with_sets:
                    out += [pa.array([s.tobytes() for s in sketches], pa.binary()), pa.array([elements[s : s + k].tobytes() for s, k in zip(starts, sizes, strict=True)], pa.binary())]
                    names += ["sketch", "elements"]
                else:
                    keys = setsketch.band_keys(sketches).view(np.int64)
                    ends = np.cumsum(np.concatenate([[0], np.where(some, setsketch.BANDS, 0)]))
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[some].reshape(-1))))
                    names.append("bands")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc_id", "text", "row_key").mapInArrow(run, f"doc_id long, row_key long, node binary, n long, {extra}")


def _u16(cells: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), np.uint16) for x in cells]).reshape(-1, setsketch.REGISTERS)


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the wanted similarity."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                p = batch.slice(at, 2000)
                keep = setsketch.plausible(_u16(p.column("sa")), _u16(p.column("sb")), p.column("na").to_numpy(), p.column("nb").to_numpy(), PERCENT / 100)
                yield pa.RecordBatch.from_arrays([p.column("a").filter(pa.array(keep)), p.column("b").filter(pa.array(keep))], names=["a", "b"])

    side = lambda s: sketches.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").mapInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= PERCENT * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ea"), batch.column("eb"), strict=True):
                first, second = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([first, second])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= PERCENT * (len(both) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    side = lambda s: sets.select(F.col("node").alias(s), F.col("elements").alias(f"e{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary")


def block_links(first: list, second: list) -> list[tuple[int, int]]:
    """Enough of the links between two blocks of (node, component, elements) to join all that any link joins."""
    rows = first if first is second else first + second
    sets = [np.frombuffer(r["elements"], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(shared > 1) - 1
    owner, useful = np.repeat(np.arange(len(rows)), sizes), shared[column] > 1
    owner, column = owner[useful], place[column[useful]]
    n = len(first)
    m = n if first is second else len(rows) - n
    same = np.zeros((n, m), np.float32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        matrix = np.zeros((len(rows), COLUMNS), np.float32)
        matrix[owner[here], column[here] - at] = 1
        same += matrix[:n] @ matrix[-m:].T
    same = same.astype(np.int64)
    i, j = np.nonzero(100 * same >= PERCENT * (sizes[:n, None] + sizes[None, -m:] - same))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out, offset = [], len(rows) - m
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = rows[x], rows[offset + y]
        p, q = find(a["component"]), find(b["component"])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((a["node"], b["node"]))
    return out


def _in_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members (bucket, node, n, component, k) of large buckets of k nodes. Of buckets that hold the same nodes,
    as those of a group that agrees in several bands, one is compared. Nodes are dealt to blocks before their sets join them,
    so that the sets of a bucket never meet in one task; a node, which is in no more buckets than there are bands, meets its set
    once for all of them."""
    alike = members.groupBy("bucket").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("y"), F.max("k").alias("size"), F.sum("n").alias("weight"), F.count("*").alias("copies"))
    weight = alike.groupBy("x", "y", "size").agg(F.min_by(F.struct("bucket", "weight", "copies"), "bucket").alias("chosen")).select("chosen.*")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("weight") / BLOCK_ELEMENTS)).cast("int")
    dealt = join_hot(members, weight, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = dealt.groupBy("node").agg(F.collect_list(F.struct("bucket", "block", "blocks", "component")).alias("places"))
    rows = placed.join(sets.select("node", "elements"), "node").select("node", "elements", F.explode("places").alias("place")).select("place.*", "node", "elements")
    packed = rows.groupBy("bucket", "block", "blocks").agg(F.collect_list(F.struct("node", "component", "elements")).alias("rows"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    sent = packed.withColumn("other", F.explode(others)).select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") <= F.col("other")).alias("leads"), "rows")
    pairs = sent.where("leads").alias("p").join(sent.where("NOT leads OR x = y").select("bucket", "x", "y", F.col("rows").alias("more")), ["bucket", "x", "y"], "left")

    def run(batches):
        for batch in batches:
            for n in range(len(batch)):
                first = batch.column("rows")[n].as_py()
                second = batch.column("more")[n].as_py() if batch.column("x")[n].as_py() != batch.column("y")[n].as_py() else first
                found = block_links(first, second) if second else []
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return pairs.select("x", "y", "rows", "more").mapInArrow(run, "a binary, b binary")


def join_hot(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows, read from a stored table, with the columns of values, which has one row for each key and its number of rows in
    `copies`. The keys that hold more than one row in HOT are fewer than HOT, so they are broadcast and their rows stay
    where they are; the others are joined by a shuffle."""
    hot = F.broadcast(values.where(F.col("copies") * HOT > rows.count()))
    spread = rows.join(hot.select(key), key, "left_anti").join(values, key)
    return rows.join(hot, key).unionByName(spread).drop("copies")


def _key(docs: DataFrame) -> DataFrame:
    """docs with row_key, which tells rows of the same doc_id apart by their texts."""
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, node, n and component of each row."""
    spark = docs.sparkSession
    keyed = _key(docs.select("doc_id", "text"))
    rows = stored(spark, _rows(keyed, False), "shingled")
    nodes = stored(spark, rows.where("n > 0").select("node", "n", "bands").dropDuplicates(["node"]), "nodes")
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))  # 40 times the rows: made at each use, never stored
    buckets = spread.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("k")).where("k > 1")
    shared = stored(spark, spread.join(buckets, "bucket"), "buckets")

    # sets and sketches of one row of each node that shares a bucket
    needed = rows.where("n > 0").groupBy("node").agg(F.min("row_key").alias("row_key")).join(shared.select("node").distinct(), "node", "left_semi").select("row_key")
    sets = stored(spark, _rows(keyed.join(needed, "row_key", "left_semi"), True).select("node", "n", "sketch", "elements").dropDuplicates(["node"]), "sets")

    stars = shared.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(spark, _confirmed(_plausible(stars, sets), sets), "links")
    found = stored(spark, components(links), "components")

    # what the stars leave open
    placed = shared.join(found, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"), "k")
    placed = stored(spark, placed, "placed")
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("_n")).where("p <> q AND _n > 2").select("bucket")
    unclear = stored(spark, placed.join(open_, "bucket", "left_semi"), "unclear")
    few = unclear.where(F.col("k") <= SINGLY).select("bucket", "node", "component")
    other = few.select("bucket", F.col("node").alias("other"), F.col("component").alias("theirs"))
    pairs = few.join(other, "bucket").where("node < other AND component <> theirs").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    more = _confirmed(_plausible(pairs, sets), sets).union(_in_blocks(unclear.where(F.col("k") > SINGLY), sets))
    found = stored(spark, components(stored(spark, links.union(more), "links")), "components")

    named = rows.groupBy("node").agg(F.count("*").alias("copies")).join(found, "node", "left").select("node", "copies", F.coalesce("component", "node").alias("component"))
    return join_hot(rows.select("doc_id", "row_key", "node", "n"), named, "node")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    named = settled(docs.sparkSession, lambda: _grouped(docs), "grouped")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return join_hot(named, least, "component").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def survivors(docs: DataFrame) -> DataFrame:
    """docs without near duplicates, all columns: one row of each component, of the least doc_id (null last), and every row
    without words."""
    named = settled(docs.sparkSession, lambda: _grouped(docs).where("n > 0"), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row_key").alias("key")))
    chosen = named.groupBy("component").agg(first.alias("first")).select(F.col("first.key").alias("key"), F.col("first.id").alias("id"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key = "key"
    while key in {c.lower() for c in docs.columns}:
        key = "_" + key
    keyed = docs.where(worded).withColumn(key, F.xxhash64("doc_id", "text"))
    # ids are compared as a range, so that rows are dealt out by the key alone and stay there when repeated ones become one
    same = keyed["doc_id"].between(chosen["id"], chosen["id"]) | (keyed["doc_id"].isNull() & chosen["id"].isNull())
    stay = keyed.join(chosen, (keyed[key] == chosen["key"]) & same, "left_semi")
    stay = stay.dropDuplicates([key, "doc_id"]).drop(key)  # rows of the same doc_id and text are one
    return stay.unionByName(docs.where(~worded))
