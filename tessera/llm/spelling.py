"""Spelling variants: a trie self-join of the corpus vocabulary at edit distance one.

* ``vocabulary`` counts lower-cased runs of letters, in bounded maps per task before
  the shuffle.
* ``near_pairs`` walks the vocabulary's trie with active-node sets.  A node's set holds
  the nodes within the distance allowed; at distance one these are the node itself
  (distance 0), from which each level gives birth to pairs at distance 1: two
  children by different code points (a replacement), and a child beside its parent
  (an insertion).  From then on both sides can only descend by the same code point.
  Where both nodes of a pair end a word, the words are near.
* The trie is partitioned by prefix.  Nodes with more than ``task_words`` words below
  are inner ones: pairs born there descend by equal rest of the word, which is an
  equi-join on (node, rest), with at most one word for each code point and key.
  Their children are partitions of their own, or inner ones again; paths without a
  branch are skipped by the common prefix of a node's least and greatest word.  So no
  task ever holds more than ``task_words`` words of one prefix, whatever share of the
  vocabulary it has, and no pair is lost or found twice: a pair belongs to the node
  of the longest common prefix.
* ``variant_groups`` takes a word's form from its near words, and its root by pointer
  jumping along forms.

Nulls, empties, repeats: null and empty texts have no words; a null id counts as the
empty string in the hash that decides deletions.  Repeated rows count each.  Ties are
resolved by code-point order.  Texts and words of any length are read whole.  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, fold, if_small, trimmed

#: A-Z, a-z and U+00C0 to U+00FF, in UTF-8.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_MAP_WORDS = 100_000


def damaged(doc: bytes, run: bytes, every: int) -> bytes:
    """The run, without one code point where ``every`` divides the hash of document and run."""
    h = zlib.crc32(run, zlib.crc32(doc + b":"))
    if every and h % every == 0:
        letters = run.decode()
        at = h % len(letters)
        return (letters[:at] + letters[at + 1 :]).encode()
    return run


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words of at least ``least_length`` code points and ``least_count`` occurrences."""

    def send(counts):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(b"%s:" % (i or "").encode())
                for w, n in Counter(_RUN.findall((t or b"").lower())).items():
                    if every and zlib.crc32(w, start) % every == 0:
                        w = damaged((i or "").encode(), w, every)
                    if len(w) >= least_length:  # bytes: at least as many as code points
                        counts[w] += n
                if len(counts) > _MAP_WORDS:
                    yield send(counts)
                    counts.clear()
        yield send(counts)

    src = fold(docs, id_col, text_col).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = src.mapInArrow(trimmed(run), "word string, n long").filter(F.char_length("word") >= least_length)
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Trie:
    """A forest in arrays: each root is a prefix partition; nodes are numbered level by level, by parent and code point."""

    def __init__(self, roots: np.ndarray, points: np.ndarray, bounds: np.ndarray):
        """Words ``i`` with code points ``points[bounds[i]:bounds[i + 1]]`` below root ``roots[i]`` (0, 1, ...), distinct in a root."""
        size, count = np.diff(bounds), int(roots.max(initial=-1)) + 1
        words, at = np.arange(len(roots)), roots.astype(np.int64)
        keys, last, self.levels = [np.zeros(0, np.int64)], [], [(0, count)]
        depth = 0
        while len(words):
            ends = size[words] == depth
            last.append((at[ends], words[ends]))
            words, at = words[~ends], at[~ends]
            if not len(words):
                break
            key = (at << 21) | points[bounds[words] + depth]
            new, place = np.unique(key, return_inverse=True)
            keys.append(new)
            at, depth = place + count, depth + 1
            self.levels.append((count, count + len(new)))
            count += len(new)
        self.keys = np.concatenate(keys)  # ascending; entry k is the edge to node k + number of roots
        self.roots = self.levels[0][1]
        self.word = np.full(count, -1, np.int64)
        for nodes, ids in last:
            self.word[nodes] = ids
        self.first = np.searchsorted(self.keys, np.arange(count + 1) << 21)  # children of a node: edges first[v] to first[v + 1]

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, edge) of all children."""
        n = self.first[nodes + 1] - self.first[nodes]
        owner = np.repeat(np.arange(len(nodes)), n)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + self.first[nodes][owner]

    def descend(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of children by the same code point, and the places of their parents."""
        few = self.first[a + 1] - self.first[a] > self.first[b + 1] - self.first[b]
        x, y = np.where(few, b, a), np.where(few, a, b)
        owner, edge = self.children(x)
        want = (y[owner] << 21) | (self.keys[edge] & 0x1FFFFF)
        found = np.searchsorted(self.keys, want)
        ok = np.flatnonzero(self.keys[np.minimum(found, len(self.keys) - 1)] == want) if len(self.keys) else np.zeros(0, np.int64)
        owner, one, two = owner[ok], edge[ok] + self.roots, found[ok] + self.roots
        return np.where(few[owner], two, one), np.where(few[owner], one, two), owner

    def near(self):
        """Yields pairs of words at distance one, each once, level by level."""
        a = b = np.zeros(0, np.int64)  # active pairs at distance 1
        for low, high in self.levels:
            both = (self.word[a] >= 0) & (self.word[b] >= 0)
            yield self.word[a[both]], self.word[b[both]]
            nodes = np.arange(low, high)
            owner, edge = self.children(nodes)
            child, parent = edge + self.roots, nodes[owner]
            ends = (self.word[child] >= 0) & (self.word[parent] >= 0)
            yield self.word[child[ends]], self.word[parent[ends]]
            # an insertion: the child's next step meets the parent's, unless the parent goes on by the inserted code point
            below, beside, place = self.descend(child, parent)
            step = self.keys[beside - self.roots] & 0x1FFFFF
            fresh = step != (self.keys[edge[place]] & 0x1FFFFF)
            # a replacement: each child beside its later sisters
            sisters = self.first[parent + 1] - edge - 1
            one = np.repeat(child, sisters)
            two = one + np.arange(len(one)) - np.repeat(np.cumsum(sisters) - sisters, sisters) + 1
            down_a, down_b, _ = self.descend(a, b)
            a, b = np.concatenate([down_a, one, below[fresh]]), np.concatenate([down_b, two, beside[fresh]])
        while len(a):
            both = (self.word[a] >= 0) & (self.word[b] >= 0)
            yield self.word[a[both]], self.word[b[both]]
            a, b, _ = self.descend(a, b)


def _trie_pairs(words: list[str], depths: list[int], roots: np.ndarray):
    rest = [w[d:] for w, d in zip(words, depths, strict=True)]
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in rest], dtype=np.int64)])
    points = np.frombuffer("".join(rest).encode("utf-32-le"), np.uint32).astype(np.int64)
    return Trie(roots, points, bounds).near()


def _within(batches, task_words: int):
    """Pairs of the prefix partitions that arrive sorted by node: (word, n, node, depth)."""
    held: list[tuple] = []

    def flush(rows):
        words, counts = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
        roots = np.cumsum(np.array([0] + [x[2] != y[2] for x, y in zip(rows[1:], rows, strict=False)], np.int64))
        names = pa.array(words, pa.string())
        for one, two in _trie_pairs(words, [len(r[2]) for r in rows], roots):
            if len(one):
                a, b = np.concatenate([one, two]), np.concatenate([two, one])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(counts[b])], ["word", "other", "other_n"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= task_words and row[2] != held[-1][2]:
                yield from flush(held)
                held = []
            held.append(row)
    if held:
        yield from flush(held)


def _common(a, b):
    """Code points that two strings start with alike."""
    return F.aggregate(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(n))


def near_pairs(spark: SparkSession, words: DataFrame, scratch: Scratch, task_words: int = 4096) -> DataFrame:
    """(word, other, other_n) for all words of ``words`` (word, n; distinct) at edit distance one, in both directions."""
    todo, leaves, keys, step = scratch.save(words.select("word", "n", F.lit("").alias("node")), "open"), [], [], 0
    while True:
        stats = scratch.save(todo.groupBy("node").agg(F.count("*").alias("n_words"), F.min("word").alias("a"), F.max("word").alias("b")).filter(F.col("n_words") > task_words), f"inner{step}")
        inner = if_small(stats.select("node", _common(F.col("a"), F.col("b")).alias("depth")))
        leaves.append(todo.join(inner, "node", "left_anti").select("word", "n", "node"))
        if stats.isEmpty():
            break
        at = todo.join(inner, "node").select("word", "n", "depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"))
        point, rest = F.substring("word", F.col("depth") + 1, F.lit(1)), F.expr("substring(word, depth + 1)")
        below = at.filter(F.length("word") > F.col("depth"))
        replaced = below.select("node", point.alias("point"), F.expr("substring(word, depth + 2)").alias("rest"), "word", "n")
        keys += [replaced, at.select("node", F.lit("").alias("point"), rest.alias("rest"), "word", "n")]
        todo = scratch.save(below.select("word", "n", F.concat("node", point).alias("node")), f"open{step}")
        step += 1
    parts = leaves[0]
    for more in leaves[1:]:
        parts = parts.unionByName(more)
    size = spark.conf.get("spark.sql.shuffle.partitions")
    found = parts.repartition(int(size), "node").sortWithinPartitions("node", "word").mapInArrow(trimmed(lambda batches: _within(batches, task_words)), "word string, other string, other_n long")
    if keys:
        every = keys[0]
        for more in keys[1:]:
            every = every.unionByName(more)
        # one word for each code point, and the word that lacks it: all of them are near, but for a doubled code point, whose pair is born further down
        met = every.groupBy("node", "rest").agg(F.collect_list(F.struct("point", "word", "n")).alias("ws")).filter(F.size("ws") > 1)
        one = met.select("rest", "ws", F.explode("ws").alias("x")).select("rest", "x", F.explode("ws").alias("y"))
        doubled = ((F.col("x.point") == "") & F.col("rest").startswith(F.col("y.point"))) | ((F.col("y.point") == "") & F.col("rest").startswith(F.col("x.point")))
        across = one.filter((F.col("x.point") != F.col("y.point")) & ~doubled).select(F.col("x.word").alias("word"), F.col("y.word").alias("other"), F.col("y.n").alias("other_n"))
        found = found.unionByName(across)
    return found


def roots(spark: SparkSession, forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form): the end of its chain.  Forms must not run in circles."""
    links, step = scratch.save(forms.select("word", F.col("form").alias("root")), "links0"), 0
    while True:
        far = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step += 1
        moved = scratch.save(moved, f"links{step}")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def variant_groups(spark: SparkSession, words: DataFrame, ratio: int = 5, task_words: int = 4096) -> DataFrame:
    """One row per word of ``words`` (word, n): n_near, its form and that one's n, and its root."""
    scratch = Scratch(spark, "spelling")
    words = scratch.save(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    near = scratch.save(near_pairs(spark, words, scratch, task_words).groupBy("word").agg(F.count("*").alias("n_near"), best), "near")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.minus")).alias("other_n"))
    takes = F.coalesce(F.col("other_n") >= ratio * F.col("n"), F.lit(False))
    formed = scratch.save(joined.select("word", "n", "n_near", F.when(takes, F.col("other")).alias("form"), F.when(takes, F.col("other_n")).alias("form_n")), "formed")
    ends = roots(spark, formed.filter("form is not null").select("word", "form"), scratch)
    out = scratch.save(formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "out")
    scratch.drop("out")
    return out
