"""Quality classifier by co-training two views of a document.

The content view sees the text: hashed byte trigrams and shares of words, lines and kinds of characters. The metadata view
sees the page's columns only: source, language and length. Each view trains a logistic model on a bounded sample of
labelled documents. In each round both models look at all documents without a label; each hands the other the labels it
is surest of, an exact share of all of them by confidence, and the other fits on a bounded sample of what it was
handed. Both are calibrated on labelled documents kept aside, combined on their logits, and then score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.near_dedup import Shingler
from tidemark.llm.shared import bounded_batches, discard, staged, text_key

#: Most labelled documents to fit on, and about how many documents of each kind that a view is handed in a round it fits on;
#: both are chosen by hash. Labels are exchanged for all other documents.
LABELLED, HANDED = 4000, 1000
ROUNDS = 4
#: Share of the other documents that each view labels for the other in a round, and how sure it must be for that, as a calibrated
#: logit: 9 to 1, and nine times the odds of any document.
CONFIDENT, SURE = 0.05, 2.2
#: Steps of a logit by which documents are ordered.
STEPS = 64
GRAMS, SOURCES, LANGS = 512, 128, 16
#: How many bad documents may stay to keep one good one.
COST = 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


class Views:
    """Feature matrices of a batch: content and metadata."""

    def __init__(self):
        self.words = Shingler(1)
        kind = np.zeros(256, np.int64)
        for c in range(256):
            ch = chr(c)
            kind[c] = 1 if "A" <= ch <= "Z" else 2 if ch.isdigit() and c < 128 else 3 if 32 < c < 127 and not ch.isalnum() else 4 if ch == "\n" else 0
        self.kind = kind

    @staticmethod
    def _named(values: list, width: int) -> np.ndarray:
        out = np.zeros((len(values), width))
        for i, v in enumerate(values):
            if v is not None:
                out[i, zlib.crc32(str(v).encode("utf-8", "surrogatepass")) % width] = 1
        return out

    def __call__(self, texts: list[str | None], langs: list, sources: list, lengths: list) -> tuple[np.ndarray, np.ndarray]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        n = len(raw)
        sizes = np.array([len(t) + 2 for t in raw])
        data = np.frombuffer(b"".join(t + b"  " for t in raw), np.uint8)
        low = np.frombuffer(data.tobytes().lower(), np.uint8).astype(np.uint32)
        of = np.repeat(np.arange(n), sizes)
        gram = low[:-2] | (low[1:-1] << 8) | (low[2:] << 16)
        slot = ((gram * np.uint32(2654435761)) >> np.uint32(32 - GRAMS.bit_length() + 1)).astype(np.int64)
        content = np.sqrt(np.bincount(of[:-2] * GRAMS + slot, minlength=n * GRAMS).reshape(n, GRAMS))
        content /= np.maximum(np.linalg.norm(content, axis=1, keepdims=True), 1e-9)
        content = np.round(content * 255) / 255  # as packed
        kinds = np.bincount(of * 5 + self.kind[data], minlength=n * 5).reshape(n, 5)
        length = np.maximum(sizes - 2, 1)
        words, counts = self.words(raw)
        distinct = np.array([len(np.unique(w)) for w in np.split(words, counts.cumsum()[:-1])])
        lines = [t.split(b"\n") for t in raw]
        shape = [
            np.log1p(sizes - 2),
            np.log1p(kinds[:, 4]),
            *(kinds[:, k] / length for k in (1, 2, 3)),
            length / np.maximum(counts, 1) / 10,
            distinct / np.maximum(counts, 1),
            np.array([len(set(x)) / len(x) for x in lines]),
        ]
        content = np.column_stack([content, *shape, *(x * x for x in shape[2:])]).astype(np.float32)
        size = np.array([np.nan if x is None else float(x) for x in lengths])
        known = ~np.isnan(size)
        size = np.log1p(np.maximum(np.where(known, size, 0), 0))
        meta = np.column_stack([known, size, size * size, self._named(sources, SOURCES), self._named(langs, LANGS)]).astype(np.float32)
        return content, meta


def _packed(view: np.ndarray) -> list[bytes]:
    if view.shape[1] < GRAMS:
        return [row.tobytes() for row in view]
    return [a.tobytes() + b.tobytes() for a, b in zip(np.round(view[:, :GRAMS] * 255).astype(np.uint8), view[:, GRAMS:], strict=True)]


def _unpacked(content: list[bytes], meta: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(content), np.uint8).reshape(len(content), -1)
    grams = np.round(raw[:, :GRAMS].astype(np.float64)) / 255
    shapes = np.ascontiguousarray(raw[:, GRAMS:]).view(np.float32)
    return [np.column_stack([grams, shapes]).astype(np.float32).astype(np.float64), np.frombuffer(b"".join(meta), np.float32).reshape(len(meta), -1).astype(np.float64)]


class Logistic:
    """Logistic regression on standardised columns, by accelerated gradient steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 250) -> Logistic:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - self.mean) / self.scale
        z = np.column_stack([np.clip(z, -8, 8), np.ones(len(z))])
        bound = 0.25 * np.linalg.norm(z.T @ z / len(z), 2) + penalty
        w = v = np.zeros(z.shape[1])
        for k in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
            new = v - (z.T @ (p - y) / len(z) + penalty * v) / bound
            v = new + k / (k + 3) * (new - w)
            w = new
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)


class Calibrated:
    """A model whose logits are fitted to labelled documents that it has not seen, so that an empty view is sure of nothing."""

    def __init__(self, model: Logistic, x: np.ndarray, y: np.ndarray):
        self.model, self.fitted = model, Logistic().fit(model.logit(x)[:, None], y)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.fitted.logit(self.model.logit(x)[:, None])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Exchange:
    """What views handed over so far: of each round the models and, of each view, the logit steps up to which it says bad and from which good."""

    def __init__(self):
        self.rounds: list[tuple[list[Calibrated], list[tuple[float, float]]]] = []

    @staticmethod
    def steps(models: list[Calibrated], views: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.round(m.logit(v) * STEPS) for m, v in zip(models, views, strict=True)])

    def said(self, views: list[np.ndarray]) -> np.ndarray:
        """Of each document and round the label of the first view that is sure of it, in the first round that has one: -1 none; view * 2 + label + 4 * round."""
        out = np.full(len(views[0]), -1)
        for r, (models, cuts) in enumerate(self.rounds):
            at = self.steps(models, views)
            for view, (low, high) in enumerate(cuts):
                for label, hit in enumerate((at[view] <= low, at[view] >= high)):
                    out[hit & (out < 0)] = 4 * r + 2 * view + label
        return out

    def cut(self, models: list[Calibrated], histogram: list[np.ndarray], total: int, good_share: float) -> None:
        """Adds a round; ``histogram`` counts the free documents of each view by logit step, from -30 * STEPS."""
        cuts, edge, odds = [], 30 * STEPS, np.log(good_share / (1 - good_share))
        for counts in histogram:
            take = CONFIDENT * total
            bad = int(np.searchsorted(counts.cumsum(), max(1, round(take * (1 - good_share))))) - edge
            good = edge - int(np.searchsorted(counts[::-1].cumsum(), max(1, round(take * good_share))))
            cuts.append((min(bad, (min(odds, 0) - SURE) * STEPS), max(good, (max(odds, 0) + SURE) * STEPS)))
        self.rounds.append((models, cuts))

    def histogram(self, models: list[Calibrated], views: list[np.ndarray]) -> list[np.ndarray]:
        free = self.said(views) < 0
        at = self.steps(models, views).astype(int) + 30 * STEPS
        return [np.bincount(x[free], minlength=60 * STEPS + 1) for x in at]


class Held:
    """Documents without labels, in memory."""

    def __init__(self, views: list[np.ndarray]):
        self.views, self.total = views, len(views[0])

    def histogram(self, exchange: Exchange, models: list[Calibrated]) -> list[np.ndarray]:
        return exchange.histogram(models, self.views)

    def handed(self, exchange: Exchange) -> tuple[list[np.ndarray], np.ndarray]:
        """Views and codes (``Exchange.said``) of the documents of the last round."""
        said = exchange.said(self.views)
        new = said >= 4 * (len(exchange.rounds) - 1)
        return [v[new] for v in self.views], said[new]


class Stored:
    """Documents without labels, in a table (h, content, meta)."""

    def __init__(self, features: DataFrame, handed: int):
        self.features, self.most = features, handed
        self.total = features.count()

    def histogram(self, exchange: Exchange, models: list[Calibrated]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(60 * STEPS + 1, np.int64) for _ in models]
            for batch in batches:
                if batch.num_rows:
                    views = _unpacked(batch.column("content").to_pylist(), batch.column("meta").to_pylist())
                    for c, more in zip(counts, exchange.histogram(models, views), strict=True):
                        c += more
            for view, c in enumerate(counts):
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view)), pa.array(at), pa.array(c[at])], ["view", "at", "n"])

        # at most two rows a step
        rows = self.features.select("content", "meta").mapInArrow(run, "view long, at long, n long").groupBy("view", "at").agg(F.sum("n").alias("n")).toPandas()
        out = [np.zeros(60 * STEPS + 1, np.int64) for _ in models]
        for view, at, n in zip(rows["view"], rows["at"], rows["n"], strict=True):
            out[view][at] = n
        return out

    def handed(self, exchange: Exchange) -> tuple[list[np.ndarray], np.ndarray]:
        least = 4 * (len(exchange.rounds) - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    said = exchange.said(_unpacked(batch.column("content").to_pylist(), batch.column("meta").to_pylist()))
                    yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(said), batch.column("content"), batch.column("meta")], ["h", "said", "content", "meta"]).filter(pa.array(said >= least))

        rows = staged(self.features.mapInArrow(run, "h binary, said long, content binary, meta binary"), "handed")
        sizes = rows.groupBy("said").agg(F.count("*").alias("n"))  # four rows
        place = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        # equal texts count once; about ``most`` of each kind reach the driver
        chosen = rows.join(F.broadcast(sizes), "said").where(place * F.col("n") < self.most).groupBy("said", "h").agg(F.min(F.struct("content", "meta")).alias("x"))
        found = chosen.orderBy("said", "h").select("said", "x.content", "x.meta").collect()
        discard(rows)
        if not found:
            return [], np.zeros(0, int)
        return _unpacked([bytes(r.content) for r in found], [bytes(r.meta) for r in found]), np.array([r.said for r in found])


class CoTrained:
    """Two views that taught each other; ``fit`` needs good and bad examples."""

    def fit(self, views: list[np.ndarray], y: np.ndarray, pool, rounds: int = ROUNDS) -> CoTrained:
        """``pool``: the documents without labels, as arrays or as ``Held`` or ``Stored``."""
        pool = Held(pool) if isinstance(pool, list) else pool
        aside = np.arange(len(y)) % 4 == 3  # rows come in hash order
        if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
            aside = np.zeros(len(y), bool)
        fit, check = (~aside, aside) if aside.any() else (np.ones(len(y), bool), np.ones(len(y), bool))
        own = [([v[fit]], [y[fit]]) for v in views]
        calibrated = lambda: [Calibrated(Logistic().fit(np.concatenate(x), np.concatenate(t)), v[check], y[check]) for (x, t), v in zip(own, views, strict=True)]
        self.exchange, self.models = Exchange(), calibrated()
        self.good_share = y[fit].mean()
        for _ in range(rounds if pool.total else 0):
            self.exchange.cut(self.models, pool.histogram(self.exchange, self.models), pool.total, self.good_share)
            rows, said = pool.handed(self.exchange)
            if not len(said):
                break
            for other in (0, 1):
                at = (said // 2) % 2 == 1 - other
                own[other][0].append(rows[other][at])
                own[other][1].append((said[at] % 2).astype(float))
            self.models = calibrated()
        logits = [m.logit(v[check]) for m, v in zip(self.models, views, strict=True)]
        self.joint = Logistic().fit(np.column_stack(logits), y[check])
        score = self.score([v[check] for v in views])[2]
        limits = np.unique([*score[score < 0.5], 0.5])
        self.limit = float(max(limits, key=lambda t: (-COST * (score[y[check] == 1] < t).sum() - (score[y[check] == 0] >= t).sum(), t)))
        return self

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the views, and of both together."""
        logits = [m.logit(v) for m, v in zip(self.models, views, strict=True)]
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(self.joint.logit(np.column_stack(logits)))


def _parts(batch: pa.RecordBatch, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` characters."""
    at, held = 0, 0
    for i, t in enumerate(batch.column("text")):
        held += len(t.as_py() or "")
        if held >= size:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _views_of(views: Views, part: pa.RecordBatch) -> list[np.ndarray]:
    named = set(part.schema.names)
    text, lang, source, size = (part.column(c).to_pylist() if c in named else [None] * part.num_rows for c in ("text", "lang", "source", "n_chars"))
    return [v.astype(np.float64) for v in views(text, lang, source, size)]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    views = Views()
    for batch in batches:
        for part in _parts(batch):
            packed = [pa.array(_packed(v.astype(np.float32)), pa.binary()) for v in _views_of(views, part)]
            blank = pa.array([not (t or "").strip() for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), blank, *packed], ["doc_id", "h", "blank", "content", "meta"])


def _judged(model: CoTrained | None, otherwise: bool, views: list[np.ndarray], blank: np.ndarray):
    one = np.full(len(blank), float(otherwise))
    text, meta, both = model.score(views) if model else (one, one, one)
    both = np.where(blank, 0.0, both)
    return text, meta, both, pa.array(~blank & (both >= (model.limit if model else 0.5)))


def _scored(model: CoTrained | None, otherwise: bool):
    """Scores from packed views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                views = _unpacked(batch.column("content").to_pylist(), batch.column("meta").to_pylist())
                text, meta, both, kept = _judged(model, otherwise, views, batch.column("blank").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text), pa.array(meta), pa.array(both), kept], ["doc_id", "p_content", "p_metadata", "score", "kept"])

    return run


def _kept(model: CoTrained | None, otherwise: bool):
    """The rows that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = Views()
        for batch in batches:
            for part in _parts(batch):
                blank = np.array([not (t or "").strip() for t in part.column("text").to_pylist()])
                yield part.filter(_judged(model, otherwise, _views_of(views, part), blank)[3])

    return run


def _features(docs: DataFrame) -> DataFrame:
    """Packed views of every row: ``doc_id, h, blank, content, meta``; h stands for the text."""
    bounded_batches(docs.sparkSession)
    kinds = {"doc_id": "long", "n_chars": "double"}
    plain = docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS]).withColumn("h", text_key())
    return staged(plain.mapInArrow(_featured, "doc_id long, h binary, blank boolean, content binary, meta binary"), "features")


def train(features: DataFrame, labels: DataFrame, labelled: int = LABELLED, handed: int = HANDED, rounds: int = ROUNDS) -> tuple[CoTrained | None, bool]:
    """The model, or None and what all labels say where only one kind is known (good where nothing is)."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("good"))
    # at most ``labelled`` ids, so they may be broadcast
    chosen = F.broadcast(staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "chosen"))
    # of rows that repeat an id one, in the cluster
    one = features.join(chosen, "doc_id").groupBy("doc_id", "good").agg(F.max(F.struct("h", "content", "meta")).alias("x"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").select("good", "x.content", "x.meta").collect()
    y = np.array([r.good for r in picked], dtype=float).clip(0, 1)
    if len(set(y)) < 2:
        return None, not len(y) or bool(y[0])
    views = _unpacked([bytes(r.content) for r in picked], [bytes(r.meta) for r in picked])
    others = features.join(chosen.select("doc_id"), "doc_id", "left_anti").where("NOT blank").select("h", "content", "meta")
    return CoTrained().fit(views, y, Stored(others, handed), rounds), True


def score_quality(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """One row per document: ``doc_id, p_content, p_metadata, score, kept``.

    Learns from ``labels`` (doc_id, quality 0 or 1; of repeated ids the larger) of a bounded sample of documents (of rows
    that repeat an id the largest text hash) and from all other documents that aren't blank. Null or blank texts have score
    0 and aren't kept; null lang, source or n_chars is a value of its own; columns that are missing count as null. Without
    labels of both kinds every text gets what the labels say, and is kept where there are none. Repeated rows each get
    their result; no documents, no rows. ``sizes`` are those of :func:`train`.
    """
    features = _features(docs)
    model, otherwise = train(features, labels, **sizes)
    return features.mapInArrow(_scored(model, otherwise), "doc_id long, p_content double, p_metadata double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` keeps, with all their columns; they are scored where they are read.

    Nulls, blank texts, repeated rows and empty tables are as there.
    """
    features = _features(docs)
    model, otherwise = train(features, labels, **sizes)
    discard(features)
    return docs.mapInArrow(_kept(model, otherwise), docs.schema)
