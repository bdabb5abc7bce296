"""Near-duplicate detection by one-permutation MinHash.

A document is its set of 5-word shingles (64-bit hashes).  One hash function fills
all bins of a signature (the least hash in each of ``bins`` ranges); empty bins
copy the bin that a hash of (bin, attempt) points to, trying until it meets a full
one (optimal densification).  Bands of ``rows`` bins are buckets.

* Rows with the same set fall into one class first, so exact copies cost nothing
  further, however many.  Only classes are compared.
* Each bucket emits a star: one edge from a centre (drawn by hash, another one in
  each bucket) to every member.  Edges are linear in the bucket's size.  They are
  confirmed on full sets.
* A bucket whose centre is linked to all others is settled.  In any other, members
  may be linked with each other though not with the centre.  An exact way handles
  the classes in those: two sets can only be linked if they share one of their
  rarest shingles (prefix filter), so the classes are cut into the connected groups
  of that relation, by edges linear in the shingles.  Groups that the stars have
  already joined are settled.  In the others all sets are compared, in blocks of
  bounded bytes ordered by size (pairs of blocks too different in size are left
  out), and a task emits only a spanning forest of confirmed links.  No cap, no
  pair list.
* Components come from min-label propagation with pointer jumping over the links,
  written to the shared folder in each round.

At the threshold itself (similarity 0.85), 7 rows and 40 bands miss a pair with
probability 2e-7; higher similarities less.

Nulls, empties, repeats: null, empty and blank texts have the empty set and link
with nothing.  Repeated rows are exact copies.  Rows that share an id are one
document: their components are one (unless ``link_ids`` is off: then texts alone
are linked).  A row without an id links by its text like any other; a component
without any id has none (null).  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import running
from ..session import delete
from .bytes_np import U64, chunks, mix, shingle_sets
from .store import Scratch, bitmap, fold, if_small, in_bitmap, trimmed

BLOCK_BYTES = 4 << 20


def signatures(sh: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures (documents x bins) with optimal densification."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    at = ((sh >> U64(32)) * U64(bins)) >> U64(32)
    cell = owner * bins + at.astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
    sig, full = np.zeros(n * bins, U64), np.zeros(n * bins, bool)
    sig[cell[first]], full[cell[first]] = sh[first], True  # hashes ascend in a document: the first of a bin is its least
    todo = np.flatnonzero(~full & np.repeat(np.diff(bounds) > 0, bins))
    attempt = 0
    while len(todo):
        probe = (mix((todo % bins).astype(U64) * U64(1_000_003) + U64(attempt + 1)) >> U64(32)) * U64(bins) >> U64(32)
        source = todo // bins * bins + probe.astype(np.int64)
        ok = full[source]
        sig[todo[ok]] = sig[source[ok]]
        todo, attempt = todo[~ok], attempt + 1
    return sig.reshape(n, bins)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """documents x bands bucket keys; the band's number is part of the key."""
    bands = sig.shape[1] // rows
    out = np.zeros((sig.shape[0], bands), U64)
    for j in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + sig[:, j : bands * rows : rows])
    return mix(out + np.arange(bands, dtype=U64)[None, :] * U64(0xD6E8FEB86659FD93)).view(np.int64)


def _class_key(sh: np.ndarray, bd: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set."""
    two, n = [], np.diff(bd)
    for salt in (0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D):
        run_sum = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sh ^ U64(salt)), dtype=U64)])
        two.append(mix(run_sum[bd[1:]] - run_sum[bd[:-1]] + n.astype(U64)).view(np.int64))
    return two


def _describe(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """doc_id, text_hash, n, class key (two 64-bit hashes of the set), bucket keys."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                sh, bd = shingle_sets(texts[a:b], k)
                keys = band_keys(signatures(sh, bd, rows * bands), rows)
                offsets = np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(bd)), *map(pa.array, _class_key(sh, bd)), lists], ["doc_id", "text_hash", "n", "s1", "s2", "keys"])

    return docs.mapInArrow(trimmed(run), "doc_id long, text_hash long, n long, s1 long, s2 long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set) of the ``wanted`` classes (node, id, hash), from the row that stands for each."""
    spark = docs.sparkSession
    key = lambda i, h: F.xxhash64(i, h)
    shared = spark.sparkContext.broadcast(bitmap(wanted.select(key("id", "hash").alias("key")), "key"))

    def run(batches):
        for batch in batches:
            keys = batch.column(3).to_numpy()
            batch = batch.take(pa.array(in_bitmap(shared.value, keys.view(U64))))
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                sh, bd = shingle_sets(texts[a:b], k)
                sets = [sh[x:y].tobytes() for x, y in zip(bd[:-1], bd[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sets, pa.binary())], ["doc_id", "text_hash", "set"])

    found = docs.withColumn("key", key("doc_id", "text_hash")).mapInArrow(trimmed(run), "doc_id long, text_hash long, set binary")
    return found.join(if_small(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("node", "set")


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """(centre, node, linked) of pairs with both sets."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, ok = batch.slice(at, 256), []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                    if len(p) > len(q):
                        p, q = q, p
                    near = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    ok.append(linked(len(p), len(q), int(np.count_nonzero(q[near] == p)), percent))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok)], ["centre", "node", "linked"])

    return pairs.mapInArrow(trimmed(run), "centre long, node long, linked boolean")


def forest(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, by block-wise incidence products."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    _, inverse, df = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = df[inverse] > 1  # only shared shingles count in an intersection
    owner, item = owner[keep], np.unique(inverse[keep], return_inverse=True)[1]
    by_item = np.argsort(item, kind="stable")
    owner, item = owner[by_item], item[by_item]
    start = np.searchsorted(item, np.arange(0, (int(item[-1]) + 1 if len(item) else 0) + 4096, 4096))
    label, out, step = np.arange(len(sets)), [], 512
    for i in range(0, len(sets), step):
        for j in range(i, len(sets), step):
            if 100 * sizes[min(i + step, len(sets)) - 1] < percent * sizes[j]:
                break  # sizes ascend: no set from here on is small enough
            common = np.zeros((len(sizes[i : i + step]), len(sizes[j : j + step])), np.float32)
            for a, b in zip(start[:-1], start[1:], strict=True):
                left = np.flatnonzero((owner[a:b] >= i) & (owner[a:b] < i + step)) + a
                right = np.flatnonzero((owner[a:b] >= j) & (owner[a:b] < j + step)) + a
                if len(left) and len(right):
                    cols = int(item[b - 1] - item[a]) + 1
                    m, w = np.zeros((common.shape[0], cols), np.float32), np.zeros((common.shape[1], cols), np.float32)
                    m[owner[left] - i, item[left] - item[a]] = 1
                    w[owner[right] - j, item[right] - item[a]] = 1
                    common += m @ w.T
            union = sizes[i : i + step, None] + sizes[None, j : j + step] - common
            near = 100 * common >= percent * union
            for p in np.flatnonzero(near.any(axis=1)):
                hit = np.flatnonzero(near[p]) + j
                labels, at = np.unique(label[hit], return_index=True)
                own = label[p + i]
                for q in hit[at[labels != own]]:
                    out.append((nodes[order[p + i]], nodes[order[q]]))
                if len(labels) > 1 or labels[0] != own:
                    label[np.isin(label, np.append(labels, own))] = min(labels[0], own)
    return out


def _forests(blocks: DataFrame, percent: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        sets = [np.frombuffer(s, U64) for s in table.column("set").to_pylist()]
        found = forest(nodes, sets, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return blocks.groupBy("label", "i", "j").applyInArrow(run, "a long, b long")


def _shared_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, shingle): of each set's prefix the shingles that another set holds too.

    The order is by how many sets hold a shingle, then by the shingle.  Of a set of
    n shingles the first n - ceil(percent n / 100) + 1 are its prefix: two sets that
    share fewer of them than one cannot be linked.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = [np.frombuffer(s, "<i8") for s in part.column(1).to_pylist()]
                sizes = np.array([len(s) for s in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(own))], ["node", "n", "shingle"])

    tokens = sets.mapInArrow(trimmed(run), "node long, n long, shingle long")
    often = tokens.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(often, "shingle")
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle"))  # one set's shingles
    total = F.count("*").over(Window.partitionBy("node"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
    return shared.withColumn("place", F.col("n") - total + place).filter(F.col("place") <= length).select("node", "shingle")


def _dealt(groups: DataFrame, percent: int) -> DataFrame:
    """(label, node, i, j): each class in every pair of blocks of its group that it takes part in.

    groups: label, node, n.  Blocks follow each other in size and hold BLOCK_BYTES of
    sets each (a larger set is a block of its own).
    """
    placed = running(groups, F.col("n") * 8, "upto", "n", ["node"], inclusive=False, part=["label"])
    placed = placed.select("label", "node", "n", F.floor(F.coalesce("upto", F.lit(0)) / BLOCK_BYTES).cast("long").alias("block"))
    blocks = placed.groupBy("label", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.select(F.col("label").alias("l2"), F.col("block").alias("b2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    fits = (100 * F.col("high") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low"))
    pairs = blocks.join(other, (F.col("label") == F.col("l2")) & fits).select("label", "block", F.least("block", "b2").alias("i"), F.greatest("block", "b2").alias("j"))
    return placed.join(pairs, ["label", "block"]).select("label", "node", "i", "j")


def components(scratch: Scratch, links: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) of every linked node: the least node reachable over ``links`` (a, b).

    Each round gives a node the least label around it and then jumps to that
    label's own label, so chains shrink at least by half in each round.
    """
    spark = scratch.spark
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = scratch.save(both, f"{name}-links")
    labels = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), f"{name}-0")
    step = 0
    while True:
        step += 1
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(around, labels.node == around.a).select("node", "label", F.least("label", "near").alias("next"))
        own = labels.select(F.col("node").alias("n2"), F.col("label").alias("jump"))
        moved = least.join(own, least.next == own.n2, "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), "label", "next").toDF("node", "label", "was", "next")
        moved = scratch.save(moved, f"{name}-{step}")
        changed = moved.filter(F.col("label") != F.col("was")).limit(1).count()
        old, labels = labels, moved.select("node", "label")
        delete(spark, f"{scratch.path}/{name}-{step - 1}")
        if not changed:
            return labels


def _open_links(scratch: Scratch, members: DataFrame, confirmed: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links among the classes of buckets that their star has not settled; None where there is no such bucket."""
    settled = confirmed.filter("linked").select("centre", "node", F.lit(1).alias("on")).distinct()
    state = members.filter("m > 2").join(settled, ["centre", "node"], "left")
    open_buckets = state.groupBy("bucket").agg(F.count("on").alias("on"), F.first("m").alias("m")).filter(F.col("on") < F.col("m") - 1).select("bucket")
    open_buckets = scratch.save(open_buckets, "open-buckets")
    if not open_buckets.limit(1).count():
        return None
    loose = scratch.save(members.join(if_small(open_buckets), "bucket").select("node", "n").distinct(), "loose")
    own = sets.join(if_small(loose.select("node")), "node", "left_semi")
    tokens = scratch.save(_shared_prefixes(own, percent), "prefixes")
    hubs = tokens.groupBy("shingle").agg(F.min("node").alias("a"), F.count("*").alias("holders")).filter("holders > 1")
    edges = tokens.join(hubs, "shingle").filter("a <> node").select("a", F.col("node").alias("b"))
    groups = components(scratch, edges, "groups")  # (node, label); the rest shares no prefix with another
    joined = components(scratch, stars, "joined").withColumnRenamed("label", "star")
    known = groups.join(joined, "node", "left").withColumn("star", F.coalesce("star", "node"))
    todo = known.groupBy("label").agg(F.min("star").alias("low"), F.max("star").alias("high")).filter("low <> high").select("label")
    todo = scratch.save(known.select("node", "label").join(todo, "label", "left_semi").join(loose, "node"), "todo")
    dealt = scratch.save(_dealt(todo, percent), "dealt")
    return scratch.save(_forests(sets.join(if_small(dealt), "node"), percent), "extra")


def near_groups(spark: SparkSession, docs: DataFrame, percent: int = 85, k: int = 5, rows: int = 7, bands: int = 40, id_col: str = "doc_id", text_col: str = "text", link_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, text_hash (xxhash64 of the text), n_shingles, component_id (least doc_id reachable), group (a number that linked rows share; null without shingles)."""
    scratch = Scratch(spark, "near-dup")
    src = fold(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    described = scratch.save(_describe(src, k, rows, bands), "described")
    full = described.filter("n > 0")
    stands = F.min(F.struct("doc_id", "text_hash")).alias("r")
    classes = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), stands, F.first("n").alias("n"), F.first("keys").alias("keys"))
    # Numbers are drawn once, as the table is written, and read from there ever after.
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "least", F.col("r.doc_id").alias("id"), F.col("r.text_hash").alias("hash"), "n", "keys"), "classes")
    exploded = classes.select(F.explode("keys").alias("bucket"), "node", "n")
    draw = F.struct(F.xxhash64("bucket", "node").alias("h"), F.col("node").alias("centre"), F.col("n").alias("centre_n"))
    several = exploded.groupBy("bucket").agg(F.count("*").alias("m"), F.min(draw).alias("c")).filter("m > 1")
    several = scratch.save(several.select("bucket", "m", "c.centre", "c.centre_n"), "several")
    members = scratch.save(exploded.join(if_small(several), "bucket"), "members")
    fits = (100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")) & (F.col("node") != F.col("centre"))
    pairs = scratch.save(members.filter(fits).select("centre", "node").distinct(), "pairs")
    wanted = scratch.save(classes.select("node", "id", "hash").join(if_small(scratch.save(members.select("node").distinct(), "compared")), "node", "left_semi"), "wanted")
    ids = full.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("s1").alias("p1"), F.max("s1").alias("q1"), F.min("s2").alias("p2"), F.max("s2").alias("q2"))
    repeated = scratch.save(ids.filter("n > 1"), "repeated")
    sets = _sets(src, wanted, k)
    sets = scratch.save(sets.dropDuplicates(["node"]) if repeated.limit(1).count() else sets, "sets")
    loaded = sets.withColumnRenamed("set", "right").join(if_small(pairs), "node").select("centre", "node", "right")
    centres = sets.select(F.col("node").alias("centre"), F.col("set").alias("left")).join(if_small(scratch.save(pairs.select("centre").distinct(), "centres")), "centre", "left_semi")
    confirmed = scratch.save(_confirm(loaded.join(centres, "centre").select("centre", "node", "left", "right"), percent).distinct(), "confirmed")
    links = stars = confirmed.filter("linked").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    extra = _open_links(scratch, members, confirmed, stars, sets, percent)
    if extra is not None:
        links = links.union(extra)
    several_texts = repeated.filter("doc_id is not null and (p1 <> q1 or p2 <> q2)").select("doc_id")
    if link_ids and several_texts.limit(1).count():
        again = full.select("doc_id", "s1", "s2").join(several_texts, "doc_id", "left_semi").distinct()
        own = scratch.save(again.join(classes.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "node"), "again")
        links = links.union(own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a <> node").select("a", "node"))
    labels = components(scratch, links).withColumnRenamed("label", "group")
    of_class = classes.select("s1", "s2", "node", "least").join(labels, "node", "left").withColumn("group", F.coalesce("group", "node"))
    of_class = scratch.save(of_class.select("s1", "s2", "least", "group"), "of-class")
    least = of_class.groupBy("group").agg(F.min("least").alias("component"))
    of_class = of_class.select("s1", "s2", "group").join(least, "group")
    result = described.select("doc_id", "text_hash", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    result = scratch.save(result.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own, F.when(F.col("n") > 0, F.col("group")).alias("group")), "result")
    scratch.drop("result")
    return result


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, k: int = 5, rows: int = 7, bands: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable)."""
    return near_groups(spark, docs, percent, k, rows, bands, id_col, text_col).select("doc_id", "n_shingles", "component_id")
