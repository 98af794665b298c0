"""MinHash near-deduplication by a chosen-path set similarity join.

Each document is the set of its 5-word shingles. Documents with equal sets form a class. Independent trees branch the
classes: a node draws one minwise token, or two, from those of its level, so that on average 1 / similarity branches
leave it, and hands each class on to the child named by its token. Nodes of few classes are compared exhaustively on
sketches. The number of trees follows from the wanted recall at the depth at which nodes stop: classes that reach nodes
deeper than ``SHALLOW`` levels go through further trees. A large node that keeps the share of its parent that near-copies
of one text would keep, or is large after all levels, is split no further: its classes are compared with a leader first
and, once components are known, exhaustively between whatever is still unlinked, first on sketches. Every link is
confirmed on the full sets, read again from the texts of the documents concerned. Components come from alternating stars.

The first wave confirms one likely earlier partner of each class, which already joins most groups. The second wave
brings the sets of classes that still have a candidate in another component into their nodes and confirms every such
candidate there, so none goes unchecked and only links that join components leave a node: no pairs are ever spelt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import bounded_batches, discard, possible, row_key, staged, without

WORDS = 5
#: Levels at which a large node branches, and the classes of a node that is compared exhaustively.
DEPTH, SMALL = 8, 64
#: Levels after which classes of nodes that still branch get further trees.
SHALLOW = 3
#: Tokens that the nodes of a level below the roots draw from; roots have two tokens each of their own.
DRAWN = 12
#: Tokens of which a byte each makes a sketch.
SKETCH = 64
#: Classes of a share of a node that stays large, and of the unlinked ones it is compared with; bytes of sets of either.
SHARE, CHUNK = 1024, 512
SHARE_BYTES = 32 << 20

#: Bytes of a stretch of words that is hashed at once.
STRETCH = 1 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)
_u = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a public bijection."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


class Shingler:
    """64-bit hashes of shingles, for many texts at once: words by a polynomial over their bytes, shingles over words."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.byte = _mix(np.arange(1, 257, dtype=np.uint64))
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.place = _mix(np.arange(1001, 1001 + words, dtype=np.uint64)) | _u(1)
        self.inverse = _u(pow(int(ODD), -1, 1 << 64))
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        self.power = np.concatenate([[_u(1)], np.full(n, ODD)]).cumprod(dtype=np.uint64)
        self.back = np.concatenate([[_u(1)], np.full(n, self.inverse)]).cumprod(dtype=np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all texts, repeats included, and how many each text has."""
        data = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", dtype=np.uint8)
        blank = self.space[data]
        before = np.concatenate([[True], blank[:-1]])
        start = np.flatnonzero(~blank & before)
        end = np.flatnonzero(blank & ~before)
        del blank, before
        word = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):  # a stretch of words at a time, so that a very long text needs no very long tables
            low = start[i]
            j = max(i + 1, int(np.searchsorted(start, low + STRETCH)))
            part = data[low : end[j - 1]]
            if len(part) > len(self.power):
                self._powers(len(part))
            total = np.concatenate([np.zeros(1, np.uint64), (self.byte[part] * self.power[: len(part)]).cumsum(dtype=np.uint64)])
            word[i:j] = _mix((total[end[i:j] - low] - total[start[i:j] - low]) * self.back[start[i:j] - low])
            i = j
        edges = np.cumsum([len(t) + 1 for t in texts])
        n_words = np.diff(np.searchsorted(start, edges), prepend=0)
        first = n_words.cumsum() - n_words
        k = self.words
        counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
        if not counts.sum():
            return np.zeros(0, np.uint64), counts
        padded = np.concatenate([word, np.zeros(k, np.uint64)])
        at = np.repeat(first - (counts.cumsum() - counts), counts) + np.arange(counts.sum())
        length = np.repeat(np.minimum(n_words, k), counts)
        value = length.astype(np.uint64) * ODD
        for i in range(k):
            value += np.where(i < length, padded[at + i] * self.place[i], _u(0))
        return _mix(value), counts


def _chunks(batch: pa.RecordBatch, *names: str, size: int = 1 << 20) -> Iterator[tuple[list[list], list[bytes]]]:
    """The named columns and the texts of a batch, about ``size`` bytes at a time; null texts are empty."""
    rows, texts, held = [], [], 0
    for row, t in zip(zip(*(batch.column(c).to_pylist() for c in names), strict=True), batch.column("text"), strict=True):
        text = (t.as_py() or "").encode("utf-8", "surrogatepass")
        rows.append(row)
        texts.append(text)
        held += len(text)
        if held >= size:
            yield list(map(list, zip(*rows, strict=True))), texts
            rows, texts, held = [], [], 0
    if rows:
        yield list(map(list, zip(*rows, strict=True))), texts


def _signer(tokens: int, words: int):
    """id and h of a row, set size, digest of the set and its minwise tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        seeds = _mix(np.arange(1, tokens + 1, dtype=np.uint64) * ODD)
        times, plus = (seeds >> _u(32)).astype(np.uint32) | np.uint32(1), seeds.astype(np.uint32)
        for batch in batches:
            for (ids, hs), texts in _chunks(batch, "id", "h"):
                values, counts = shingles(texts)
                sizes, digests, has = [], [], counts > 0
                for part in np.split(values, counts.cumsum()[:-1]):
                    unique = np.unique(part)
                    sizes.append(len(unique))
                    digests.append(xxhash.xxh3_128_digest(unique.tobytes()) if len(unique) else None)
                signs = np.zeros((len(ids), tokens), np.uint32)
                if has.any():
                    at = (counts.cumsum() - counts)[has]
                    short = values.astype(np.uint32)
                    for t in range(tokens):
                        signs[has, t] = np.minimum.reduceat((short ^ plus[t]) * times[t], at)
                flat = pa.array(signs.view(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * tokens), flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(hs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "h", "n_shingles", "digest", "sign"]
                )

    return run


def _set_reader(words: int):
    """Full sets, sorted, of the classes' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            for (classes,), texts in _chunks(batch, "cls"):
                values, counts = shingles(texts)
                sets = [np.unique(part).tobytes() for part in np.split(values, counts.cumsum()[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["cls", "shingles"])

    return run


def _sketches(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _comparer(width: int, least: int, sure: int, percent: int, every: bool):
    """Compares the classes of each node; rows come sorted by node and class.

    ``every``: node and class (as a, b) of all that have a candidate of another label; else one earlier candidate of
    each class: the smallest that agrees in ``sure`` tokens, so that groups gather around one class, or the best.
    """

    def pairs(t: dict[str, np.ndarray]) -> pa.RecordBatch:
        node, cls, n, label, sketch = (t[k] for k in ("node", "cls", "n", "label", "sketch"))
        best, partner = np.zeros(len(node), np.int64), np.full(len(node), -1)
        open_ = np.zeros(len(node), bool)
        out = []
        for off in range(1, len(node)):
            b = np.flatnonzero(node[off:] == node[:-off]) + off
            if not len(b):
                break
            a = b - off
            fits = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (cls[a] != cls[b])
            if every:
                fits &= label[a] != label[b]
            a, b = a[fits], b[fits]
            same = (sketch[a] == sketch[b]).sum(1)
            a, b, same = a[same >= least], b[same >= least], same[same >= least]
            if every:
                open_[a] = open_[b] = True
            else:  # later offsets reach smaller classes, which win ties
                same = np.minimum(same, sure)
                better = same >= best[b]
                best[b[better]], partner[b[better]] = same[better], a[better]
        if every:
            out.append((node[open_], cls[open_], best[open_]))
        else:
            b = np.flatnonzero(partner >= 0)
            out.append((cls[partner[b]], cls[b], best[b]))
        a, b, same = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in (a, b, same)], ["a", "b", "same"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {k: batch.column(k).to_numpy() for k in ("node", "cls", "n", "label")} | {"sketch": _sketches(batch.column("sketch"), width)}
            if held:
                t = {k: np.concatenate([held[k], t[k]]) for k in t}
            cut = int(np.searchsorted(t["node"], t["node"][-1]))  # the last node may go on in the next batch
            held = {k: v[cut:] for k, v in t.items()}
            if cut:
                yield pairs({k: v[:cut] for k, v in t.items()})
        if held:
            yield pairs(held)

    return run


class Joiner:
    """Components within one node: confirms candidates on full sets and keeps the links that join something."""

    def __init__(self, percent: int):
        self.percent, self.parent, self.links = percent, {}, []

    def root(self, x):
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def confirm(self, at: int, own: np.ndarray, others: np.ndarray, sets: list[np.ndarray], cls: np.ndarray, label: np.ndarray) -> None:
        """Class ``cls[at]`` with set ``own`` against its candidates, numbers into the arrays."""
        mine = self.root(label[at])
        others = [o for o in others.tolist() if self.root(label[o]) != mine]
        if not others:
            return
        sizes = np.array([len(sets[o]) for o in others])
        joined = np.concatenate([sets[o] for o in others])
        place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        common = np.add.reduceat((own[place] == joined).astype(np.int64), sizes.cumsum() - sizes)
        for o in np.flatnonzero(100 * common >= self.percent * (len(own) + sizes - common)):
            x, y = self.root(label[at]), self.root(label[others[o]])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((int(cls[at]), int(cls[others[o]])))


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _node_links(width: int, least: int, percent: int):
    """Links that join components within small nodes; rows come sorted by node and class, with their full sets."""

    def solve(t: dict) -> list[tuple[int, int]]:
        joiner = Joiner(percent)
        n, sketch, label = t["n"], t["sketch"], t["label"]
        for i in range(1, len(n)):
            fits = (label[:i] != label[i]) & (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i]))
            near = np.flatnonzero(fits)
            near = near[(sketch[near] == sketch[i]).sum(1) >= least]
            if len(near):
                joiner.confirm(i, t["set"][i], near, t["set"], t["cls"], label)
        return joiner.links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ("node", "cls", "n", "label"), None
        for batch in _then_none(batches):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                t = {k: batch.column(k).to_numpy() for k in names} | {"sketch": _sketches(batch.column("sketch"), width), "set": _sets(batch.column("shingles"))}
                if held:
                    t = {k: held[k] + t[k] if k == "set" else np.concatenate([held[k], t[k]]) for k in t}
                cut = int(np.searchsorted(t["node"], t["node"][-1]))
            elif held:
                t, cut = held, len(held["node"])
            else:
                return
            held = {k: v[cut:] for k, v in t.items()}
            edges = np.flatnonzero(np.diff(t["node"][:cut])) + 1
            out = []
            for a, b in zip([0, *edges], [*edges, cut], strict=True):
                if b - a > 1:
                    out += solve({k: v[a:b] for k, v in t.items()})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])

    return run


def _then_none(batches):
    yield from batches
    yield None


def _fitting(n, label, sketch, at: int, of: int, least: int, percent: int) -> np.ndarray:
    """Numbers below ``of`` of the classes that may be linked with class ``at`` and have another label."""
    fits = np.flatnonzero((label[:of] != label[at]) & (100 * np.minimum(n[:of], n[at]) >= percent * np.maximum(n[:of], n[at])))
    return fits[(sketch[fits] == sketch[at]).sum(1) >= least]


def _cross_open(width: int, least: int, percent: int):
    """Classes of a large node that have a candidate of another label, of a chunk (left) and a share (right)."""
    import pandas as pd

    def run(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "cls": []}).astype("int64")
        n, cls, label = (np.concatenate([right[k].to_numpy(), left[k].to_numpy()]) for k in ("n", "cls", "label"))
        sketch, of = _sketches(pa.array([*right["sketch"], *left["sketch"]]), width), len(right)
        open_ = np.zeros(len(n), bool)
        for at in range(of, len(n)):
            fits = _fitting(n, label, sketch, at, of, least, percent)
            open_[fits] = True
            open_[at] |= len(fits) > 0
        return pd.DataFrame({"node": left["node"].iloc[0], "cls": np.unique(cls[open_])}).astype("int64")

    return run


def _cross(width: int, least: int, percent: int):
    """Links between the unlinked classes of a large node (left) and a share of all its classes (right)."""
    import pandas as pd

    def run(left, right):
        joiner = Joiner(percent)
        if len(left) and len(right):
            n, cls, label = (np.concatenate([right[k].to_numpy(), left[k].to_numpy()]) for k in ("n", "cls", "label"))
            sketch = _sketches(pa.array([*right["sketch"], *left["sketch"]]), width)
            sets = [np.frombuffer(x, np.uint64) for k in (right, left) for x in k["shingles"]]
            for at in range(len(right), len(n)):
                fits = _fitting(n, label, sketch, at, len(right), least, percent)
                if len(fits):
                    joiner.confirm(at, sets[at], fits, sets, cls, label)
        return pd.DataFrame(joiner.links, columns=["u", "v"]).astype("int64")

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["u", "v"])

    return run


def survival(similarity: float, depth: int) -> float:
    """Chance that a pair of this similarity shares a node ``depth`` levels down one tree."""
    two, alive = 1 / similarity - 1, 1.0
    for _ in range(depth):
        one = 1 - similarity * alive
        alive = 1 - ((1 - two) * one + two * one * one)
    return alive


def trees_for(recall: float, similarity: float, depth: int = SHALLOW) -> int:
    """Independent trees so that a pair of this similarity, in nodes ``depth`` levels down, is met with that chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def _read_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``cls, shingles``: the full set of each class named in ``ids`` (cls), read from the text of one document."""
    wanted = staged(classes.join(ids.select("cls").distinct(), "cls", "left_semi").select("cls", "rep.id", "rep.h"), "wanted")
    both = F.xxhash64("id", "h")
    maybe, _ = possible(docs, both, wanted.select(both.alias("key")))
    named = wanted.select("cls", F.col("id").alias("rep_id"), F.col("h").alias("rep_h"))
    once = maybe.groupBy("id", "h").agg(F.first("text").alias("text"))  # equal texts, so any
    texts = once.join(named, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("h") == F.col("rep_h"))).select("cls", "text")
    return staged(texts.mapInArrow(_set_reader(words), "cls long, shingles binary"), "sets")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are links, on full sets."""
    joined = (
        pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    return joined.mapInArrow(_confirm(percent), "u long, v long")


class Forest:
    """The trees: nodes of few classes (``leaves``) and nodes that stay large (``stays``), both (node, cls)."""

    def __init__(self, classes: DataFrame, similarity: float, recall: float, small: int, depth: int):
        self.classes, self.similarity, self.small, self.depth = classes, similarity, small, depth
        self.leaves: list[DataFrame] = []
        self.stays: list[DataFrame] = []
        self.used: list[DataFrame] = []
        first, self.trees = trees_for(recall, similarity, min(SHALLOW, depth)), trees_for(recall, similarity, depth)
        deep = self.grow(classes.select("cls", "sign"), 0, first)
        if deep is not None and self.trees > first:
            deep = staged(deep.select("cls").distinct(), "deep")
            self.used.append(deep)
            self.grow(classes.select("cls", "sign").join(deep, "cls", "left_semi"), first, self.trees)

    @staticmethod
    def tokens(similarity: float, recall: float, depth: int) -> int:
        return 2 * trees_for(recall, similarity, depth) + DRAWN * max(0, depth - 1)

    def children(self, rows: DataFrame, level: int) -> DataFrame:
        """Rows (cls, sign, tree, node) handed on to one child, or two, by tokens that the node's name draws."""
        draw = lambda what, n: F.pmod(F.xxhash64("node", F.lit(what)), F.lit(n))
        if level == 0:
            tokens = [F.col("tree") * 2, F.col("tree") * 2 + 1]
        else:
            low = 2 * self.trees + DRAWN * (level - 1)
            one = draw("first", DRAWN)
            tokens = [low + one, low + F.pmod(one + 1 + draw("other", DRAWN - 1), F.lit(DRAWN))]
        child = [F.xxhash64("node", t, F.get("sign", t.cast("int"))) for t in tokens]
        second = draw("second", 1000) < F.lit(int(1000 * (1 / self.similarity - 1)))
        named = F.when(second, F.array(*child)).otherwise(F.array(child[0]))
        return rows.select("cls", "tree", F.col("size").alias("above"), F.explode(named).alias("node"))

    def grow(self, classes: DataFrame, first: int, last: int) -> DataFrame | None:
        """Grows the trees from ``first`` to before ``last``; the rows that branch below ``SHALLOW`` levels, if any."""
        root = classes.select("cls", "sign", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("tree"))
        rows = self.children(root.withColumns({"node": F.xxhash64("tree"), "size": F.lit(None).cast("long")}), 0)
        # of near-copies of one text, each keeps its child with at least the threshold as chance; its square allows for the spread
        unsplit = F.coalesce(F.col("size") >= F.lit(self.similarity**2) * F.col("above"), F.lit(False))
        deep = None
        for level in range(1, self.depth + 1):
            rows = staged(rows, "nodes")
            sizes = staged(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
            sized = rows.join(sizes, "node")
            self.leaves.append(sized.where(F.col("size") <= self.small).select("node", "cls"))
            large = staged(sized.where(F.col("size") > self.small).select("node", "tree", "cls", "size", unsplit.alias("unsplit")), "large")
            self.stays.append(large.where("unsplit" if level < self.depth else "true").select("node", "cls"))
            self.used += [rows, sizes, large]
            split = large.where("NOT unsplit")
            if level == self.depth or split.isEmpty():
                return deep
            if level == SHALLOW:
                deep = split
            rows = self.children(split.join(self.classes.select("cls", "sign"), "cls"), level)
        return deep


def _components(docs: DataFrame, percent: int, words: int, recall: float, small: int, depth: int, all_rows: bool) -> tuple[DataFrame, DataFrame]:
    """Rows ``id, h, n_shingles, digest`` and, of each digest, the least row (id, h) of its component as ``rep``.

    Rows without id come after others, or, unless ``all_rows``, take no part.
    """
    bounded_batches(docs.sparkSession)
    similarity = percent / 100
    tokens = Forest.tokens(similarity, recall, depth)
    width = min(SKETCH, tokens)
    least = math.floor(width * (similarity - 4.2 * math.sqrt(similarity * (1 - similarity) / width)))
    sure = math.ceil(width * (similarity + math.sqrt(similarity * (1 - similarity) / width)))
    docs = docs.select(*row_key(), F.col("text").cast("string").alias("text"))
    signed = staged(docs.mapInArrow(_signer(tokens, words), "id long, h binary, n_shingles long, digest binary, sign array<int>"), "signed")
    usable = signed.where("n_shingles > 0" if all_rows else "n_shingles > 0 AND id IS NOT NULL")
    least_row = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h"))
    # equal sets have equal tokens, so any of them stands for the class; one id may name several texts, so classes are numbered
    grouped = usable.groupBy("digest").agg(least_row.alias("rep"), F.first("n_shingles").alias("n"), F.first("sign").alias("sign"))
    classes = staged(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    rows = staged(signed.drop("sign"), "rows")
    discard(signed)
    sketch = F.unhex(F.array_join(F.transform(F.slice("sign", 1, width), lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255))), 2, "0")), ""))
    sketches = staged(classes.select("cls", "n", sketch.alias("sketch")), "sketches")
    forest = Forest(classes, similarity, recall, small, depth)
    leaf = staged(reduce(DataFrame.unionByName, forest.leaves).join(sketches, "cls"), "leaves")
    large = staged(reduce(DataFrame.unionByName, forest.stays).join(sketches, "cls"), "large")
    slim = staged(classes.drop("sign"), "slim")
    discard(classes, *forest.used)

    def compared(every: bool, labels: DataFrame | None) -> DataFrame:
        with_label = leaf.withColumn("label", F.col("cls")) if labels is None else _labelled(leaf, labels)
        by_node = with_label.select("node", "cls", "n", "label", "sketch").repartition("node").sortWithinPartitions("node", "cls")
        return by_node.mapInArrow(_comparer(width, least, sure, percent, every), "a long, b long, same long")

    # first wave: each class with one likely smaller partner in any small node, or the leader of a large one
    leader = staged(large.groupBy("node").agg(F.min_by(F.struct("cls", "n", "sketch"), F.xxhash64("node", "cls")).alias("of")), "leaders")
    led = large.join(leader, "node").where(
        (F.col("cls") != F.col("of.cls")) & (F.lit(100) * F.least("n", F.col("of.n")) >= F.lit(percent) * F.greatest("n", F.col("of.n")))
    )
    led = led.select(F.least("cls", "of.cls").alias("a"), F.greatest("cls", "of.cls").alias("b"), F.lit(-1).cast("long").alias("same"))
    best = compared(False, None).unionByName(led.distinct()).groupBy("b", (F.col("same") < 0).alias("_led")).agg(F.max(F.struct("same", F.bitwise_not("a").alias("neg"))).alias("best"))
    pairs = staged(best.select(F.bitwise_not("best.neg").alias("a"), "b").distinct(), "candidates")
    sets = _read_sets(docs, slim, pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))), words)
    links = staged(_confirmed(sets, pairs, percent), "links")
    discard(sets, pairs, leader)
    labels = connected_components(links)

    # second wave: classes with a candidate in another component meet again in their nodes, now with their sets
    columns = ["node", "cls", "n", "label", "sketch"]
    open_ = staged(compared(True, labels).select(F.col("a").alias("node"), F.col("b").alias("cls")), "open")
    known = _labelled(open_.join(sketches, "cls"), labels).select(columns)
    heavy = staged(known.groupBy("node").agg(F.sum("n").alias("sum")).where(F.col("sum") * 8 > SHARE_BYTES).select("node"), "heavy")
    few = staged(known.join(heavy, "node", "left_anti"), "few")
    many = known.join(heavy, "node", "left_semi")
    if not large.isEmpty():
        apart = _dealt(_labelled(large, labels).select(columns), large_only=False)
        meet = apart[0].groupBy(*KEY).cogroup(apart[1].groupBy(*KEY)).applyInPandas(_cross_open(width, least, percent), "node long, cls long")
        many = many.unionByName(_labelled(large.join(meet.distinct(), ["node", "cls"], "left_semi"), labels).select(columns))
    many = staged(many, "many")
    discard(leaf, large)
    sets = _read_sets(docs, slim, few.select("cls").unionByName(many.select("cls")), words)
    again = few.join(sets, "cls").select(*columns, "shingles").repartition("node").sortWithinPartitions("node", "cls")
    second = again.mapInArrow(_node_links(width, least, percent), "u long, v long")
    if not many.isEmpty():
        left, right = _dealt(many, large_only=True)
        left, right = left.join(sets, "cls"), right.join(sets.select("cls", "shingles"), "cls")
        left = left.select([F.col(c).alias(c) for c in left.columns])  # other columns than those of the right side
        second = second.unionByName(left.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInPandas(_cross(width, least, percent), "u long, v long"))
    second = staged(second, "second")
    discard(sets, few, many)
    labels = connected_components(second.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))

    of_class = staged(_labelled(slim.select("digest", "rep", "cls"), labels).select("digest", "rep", "label"), "components")
    reps = of_class.groupBy("label").agg(F.min("rep").alias("rep"))
    return rows, staged(of_class.select("digest", "label").join(reps, "label").select("digest", "rep"), "reps")


def near_dedup(
    docs: DataFrame,
    percent: int = 85,
    words: int = WORDS,
    recall: float = 0.9999,
    small: int = SMALL,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Texts are lower-cased (A-Z) and split at ASCII white space; a document's set holds its distinct shingles of
    ``words`` words, or its whole sequence where it has fewer. Documents are linked whose sets share at least
    ``percent`` hundredths of their union; ``component_id`` is the smallest doc_id reachable over links. Null, empty
    and blank texts have no shingles and are linked with nothing, as are rows without doc_id; these stay. Rows that
    repeat a doc_id with its text belong together; a doc_id with several texts names as many documents, whose components
    stay apart even if they carry the same number. An empty table gives an empty result. ``recall`` is the chance to
    meet a pair at exactly the threshold; more similar pairs are met more surely. Other columns are not read.
    """
    rows, reps = _components(docs, percent, words, recall, small, depth, all_rows=False)
    result = rows.withColumn("digest", F.when(F.col("id").isNotNull(), F.col("digest"))).join(reps, "digest", "left")
    component = F.coalesce("rep.id", "id")
    return result.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


KEY = ["node", "chunk", "share"]


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the label of their class, its own number where it is not linked."""
    known = labels.withColumnRenamed("node", "cls")
    return rows.join(known, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _dealt(rows: DataFrame, large_only: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes that hold several components, dealt so that any two unlinked ones meet: of two at least one is
    outside the node's largest component (left) and meets all (right). Parts have bounded classes and, where sets
    travel with them (``large_only``), bounded bytes of sets."""
    rows = staged(rows, "labelled")
    size = F.sum("n") * 8 if large_only else F.lit(0)
    counts = rows.groupBy("node", "label").agg(F.count("*").alias("n_label"), size.alias("bytes"))
    total = counts.groupBy("node").agg(F.sum("n_label").alias("n_all"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("n_label", "label", "bytes")).alias("top")).where("n_all > top.n_label")
    parts = lambda n, each, b: F.greatest(F.ceil(n / each), F.ceil(b / SHARE_BYTES))
    nodes = staged(
        total.select(
            "node",
            F.col("top.label").alias("top"),
            parts(F.col("n_all") - F.col("top.n_label"), CHUNK, F.col("all_bytes") - F.col("top.bytes")).alias("chunks"),
            parts(F.col("n_all"), SHARE, F.col("all_bytes")).alias("shares"),
        ),
        "apart",
    )
    dealt = staged(rows.join(nodes, "node"), "unsettled")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = [*KEY, "cls", "n", "label", "sketch"]
    right = dealt.withColumn("share", F.pmod(F.xxhash64("cls"), F.col("shares"))).withColumn("chunk", each("chunks")).select(columns)
    left = dealt.where("label <> top").withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks"))).withColumn("share", each("shares"))
    return left.select([F.col(c).alias(c) for c in columns]), right  # other columns than those of the right side


def drop_near_copies(docs: DataFrame, percent: int = 85, words: int = WORDS) -> DataFrame:
    """One row of each group of near-copies, with all its columns: that with the smallest doc_id, then hash of the text.

    Every row is judged by its own text, so one doc_id may name several texts; rows without doc_id take part and stay only
    where no other row of their group has one. Rows that repeat doc_id and text are there once, blank ones too; other
    blank texts stay. No documents, no rows.
    """
    rows, reps = _components(docs, percent, words, 0.9999, SMALL, DEPTH, all_rows=True)
    stays = F.col("rep").isNull() | (F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("h") == F.col("rep.h")))
    return without(docs, rows.join(reps, "digest", "left").select("id", "h", (~stays).alias("drop")))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
h AS (SELECT doc_id, n, hash(x) AS x FROM e),
c AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS shared_n
  FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL),
l AS (SELECT u, v FROM c WHERE 100 * shared_n >= 85 * (nu + nv - shared_n)),
b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN m USING (doc_id)
"""
