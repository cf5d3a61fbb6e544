"""N-gram Jaccard join: MinHash banding proposes, full n-gram sets decide.

1. One pass over the texts gives each a key of its word sequence and its band hashes.
2. Documents with equal keys are one text, which gets a number of its own.
3. Band hashes are shuffled; texts that share one are joined to the first text there, and the components of that graph
   are the only places where similar texts can meet.
4. Each component's texts go, once, to one task. The texts of a component of more than `block` are dealt out to blocks, those that
   share a first neighbour together; a pair of blocks that share a band hash goes to one task, no other pair does. There the
   pairs that share a band are compared on their full n-gram sets. A task returns for each text the number of its links and the
   first text it hangs together with, never the pairs.
5. Components over these give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import cut, drop_cut, ship
from .components import connected_components

THRESHOLD, N, RECALL, ROWS, BLOCK = 0.8, 5, 0.9999, 7, 128
#: About so many n-grams at most lie in a block, unless one text has more: a bound on a task's memory.
BLOCK_GRAMS = 1 << 18


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = S.multipliers(bands * rows)
        for batch in batches:
            keys, sums, sizes = [], [], []
            for raw in batch.column(1):
                words = S.word_hashes(memoryview(raw.as_buffer()) if raw.is_valid else b"")
                keys.append(S.sequence_key(words))
                grams = S.ngrams(words, n)
                sizes.append(len(grams))
                sums.append(S.bands(grams, by, rows))
            at = np.cumsum([0, *map(len, sums)], dtype=np.int32)
            values = pa.array(np.concatenate(sums) if sums else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at), values), pa.array(sizes, pa.int64())], ["doc_id", "key", "bands", "size"]
            )
        pa.default_memory_pool().release_unused()

    return run


def links(grams: list[np.ndarray], sums: list[np.ndarray], side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of texts given by n-gram sets and band hashes: how many others each is linked to, and the first text each hangs together with.

    side: if given, only pairs whose sides differ count.
    """
    m = len(grams)
    count, root = np.zeros(m, np.int64), list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    near = np.zeros((m, m), bool)
    table = np.stack(sums)
    for band in table.T:
        order = np.argsort(band, kind="stable")
        cuts = np.flatnonzero(np.diff(band[order])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, m], strict=True):
            if hi - lo > 1:
                same = order[lo:hi]
                near[np.ix_(same, same)] = True
    if side is not None:
        near &= side[:, None] != side[None, :]
    near &= ~np.tri(m, dtype=bool)
    size = np.array([len(g) for g in grams])
    ids = np.unique(np.concatenate(grams), return_inverse=True)[1]
    at = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(int(ids.max()) + 1, np.int32)
    for a in np.flatnonzero(near.any(axis=1)):
        found = np.flatnonzero(near[a])
        small, big = np.minimum(size[found], size[a]), np.maximum(size[found], size[a])
        found = found[small >= threshold * big - 1e-9]
        if not len(found):
            continue
        own = ids[at[a] : at[a + 1]]
        mark[own] = 1
        if 2 * len(found) > m:
            common = np.add.reduceat(mark[ids], at[:-1])[found]
        else:
            common = np.array([mark[ids[at[b] : at[b + 1]]].sum() for b in found])
        mark[own] = 0
        linked = found[common >= threshold * (size[a] + size[found] - common) - 1e-9]
        count[a] += len(linked)
        count[linked] += 1
        for b in linked:
            x, y = find(int(a)), find(int(b))
            if x != y:
                root[max(x, y)] = min(x, y)
    return count, np.array([find(x) for x in range(m)], np.int64)


def _verify(n: int, threshold: float):
    """Rows come sorted by group (comp, gi, gj): node, comp, gi, gj, block, bands, text, key. Rows whose text isn't the key's are passed over."""

    def settle(rows: list[tuple]) -> tuple[list, list, list]:
        by_node = {r[0]: r for r in rows}  # a repeated row counts once
        rows = [by_node[k] for k in sorted(by_node)]
        across = rows[0][2] != rows[0][3]
        side = np.array([r[4] for r in rows]) if across else None
        count, first = links([r[5] for r in rows], [r[6] for r in rows], side, threshold)
        ids = [r[0] for r in rows]
        return ids, count.tolist(), [ids[k] for k in first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], ([], [], [])

        def flush() -> None:
            if len(rows) > 1:
                for to, more in zip(out, settle(rows), strict=True):
                    to.extend(more)

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "n_links", "root"])
            for x in out:
                x.clear()
            return made

        for batch in batches:
            ids, comp, gi, gj, block = (batch.column(k).to_pylist() for k in range(5))
            for k, raw in enumerate(batch.column(6)):
                at = (comp[k], gi[k], gj[k])
                if at != group:
                    flush()
                    group, rows = at, []
                    if len(out[0]) > 20_000:
                        yield batch_of()
                words = S.word_hashes(memoryview(raw.as_buffer()))
                if S.sequence_key(words) == batch.column(7)[k].as_py():
                    rows.append((ids[k], *at, block[k], S.ngrams(words, n), batch.column(5)[k].values.to_numpy()))
        flush()
        yield batch_of()
        rows.clear()
        pa.default_memory_pool().release_unused()

    return run


def _placed(comps: DataFrame, edges: DataFrame, own: DataFrame, block: int) -> DataFrame:
    """(node, comp, gi, gj, block): the tasks, named by comp, gi and gj, that each text of a component goes to."""
    blocks = lambda to: F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_GRAMS)).cast("int").alias(to)
    sized = cut(comps.join(own.select("node", "size"), "node"), "ngram-members")
    members = sized.join(sized.groupBy("comp").agg(blocks("blocks")), "comp")
    alone = members.where("blocks = 1").select("node", "comp", F.lit(0).alias("gi"), F.lit(0).alias("gj"), F.lit(0).alias("block"))
    large = members.where("blocks > 1")
    first = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("first"))
    led = large.join(first, "node", "left").withColumn("first", F.coalesce("first", "node"))
    shares = led.groupBy("comp", "first").agg(blocks("shares"))
    # The texts of a neighbour that very many share go to as many blocks in a row.
    place = F.expr("cast(pmod(pmod(xxhash64(first), blocks) + pmod(xxhash64(node), shares), blocks) as int)")
    dealt = cut(led.join(shares, ["comp", "first"]).select("node", "comp", place.alias("block")), "ngram-blocks")
    held = dealt.join(own.select("node", F.explode("bands").alias("band")), "node").groupBy("comp", "band").agg(F.collect_set("block").alias("at"))
    pairs = (
        held.select("comp", F.explode(F.expr("flatten(transform(at, i -> transform(filter(at, j -> i <= j), j -> named_struct('gi', i, 'gj', j))))")).alias("p"))
        .select("comp", "p.gi", "p.gj").distinct()
        .withColumn("block", F.explode(F.expr("if(gi = gj, array(gi), array(gi, gj))")))
    )
    return alone.unionByName(dealt.join(pairs, ["comp", "block"]).select("node", "comp", "gi", "gj", "block"))


def ngram_jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links), a row for each row of docs.

    class_id: the smallest doc_id that the document hangs together with over links (Jaccard of n-gram sets at least
    threshold); its own without any. copy_of: the smallest doc_id with the same word sequence. n_links: the number of
    different word sequences linked to it. A pair at the threshold is proposed with probability `recall`.

    Null and word-less texts have no n-grams: a class of their own, no links. A null doc_id stays null and links to nothing
    unless its text is that of a document with an id. Repeated rows are repeated in the result and count as one text; where an id
    comes with several texts, each row has the class of its own text.
    Other columns of docs, whatever their names, are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    number = S.choose_bands(threshold, recall, rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).cast("binary").alias("text"))
    sig = cut(texts.mapInArrow(_signatures(n, number, rows), "doc_id long, key binary, bands array<long>, size long"), "ngram-sig")
    known = sig.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    # Numbered as it is written, so a text's number is the same from here on.
    own = cut(known.withColumn("node", F.monotonically_increasing_id()), "ngram-texts")
    band = own.select("node", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band", "lo")
    edges = cut(band.join(shared, "band").where("node > lo").select(F.col("node").alias("u"), F.col("lo").alias("v")).distinct(), "ngram-cand")
    comps = cut(connected_components(edges, "ngram-comp"), "ngram-comp")
    placed = (
        texts.join(_placed(comps, edges, own, block).join(own.select("node", "copy_of", "key", "bands"), "node").withColumnRenamed("copy_of", "doc_id"), "doc_id")
        .select("node", "comp", "gi", "gj", "block", "bands", "text", "key")
        .repartition("comp", "gi", "gj")
        .sortWithinPartitions("comp", "gi", "gj")
    )
    found = cut(placed.mapInArrow(_verify(n, threshold), "node long, n_links long, root long").where("n_links > 0"), "ngram-links")
    drop_cut(comps)
    drop_cut(edges)
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    linked = cut(connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "ngram-class").join(own.select("node", "copy_of"), "node"), "ngram-class")
    least = linked.groupBy("comp").agg(F.min("copy_of").alias("class_id"))
    classes = linked.join(least, "comp").join(counts, "node").select("node", "class_id", "n_links")
    by_text = own.select("key", "node", "copy_of").join(classes, "node", "left").drop("node")
    return sig.select("doc_id", "key").join(by_text, "key", "left").select(
        "doc_id",
        F.coalesce("class_id", "copy_of", "doc_id").alias("class_id"),
        F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
