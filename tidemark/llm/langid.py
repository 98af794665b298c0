"""Language identification by interpolated Kneser-Ney character models.

One model of character 4-grams a language, from all training texts: partitions count distinct 4-grams, one aggregation
adds them up, and every counted gram is kept. The lower orders are Kneser-Ney continuation counts of the order above.
Models are stored as arrays of 64-bit gram hashes in sorted order with a radix index over their leading bits; one row of
log-probabilities holds all languages. Models too large for a task's memory stay tables of the shared folder: tasks hold
the log-probabilities of the most frequent grams, joins find those of all others. A text gets the language with the
lowest cross-entropy a character. The confidence and the limit of rejection are calibrated on a share of the training
documents that the counts leave out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, staged

ORDER = 4
#: Counted grams times languages up to which tasks hold whole models; of larger ones they hold a quarter as many numbers.
HELD = 1 << 23
#: One in so many training documents of a language is kept for calibration, from so many documents on.
KEPT, KEPT_FROM = 16, 64
#: Quantile of the calibration documents' cross-entropy beyond which a text is called foreign to all languages.
REJECT = 0.999
DISCOUNT = 0.75
UNKNOWN = "und"
TEMPERATURES = [float(2**i) for i in range(10)]
_u = np.uint64


def _hash(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a public bijection: unequal grams never meet."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def letter_table() -> np.ndarray:
    """For each UTF-16 unit its lower-case letter, or 0 if it is none; surrogates stand for themselves."""
    table = np.zeros(65536, np.uint16)
    for c in range(65536):
        if 0xD800 <= c < 0xE000:
            table[c] = c
        elif (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c
    return table


class Grams:
    """4-grams of many texts at once: four 16-bit units, every run of other characters one space."""

    def __init__(self):
        self.table = letter_table()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Packed grams of all texts, and how many each text has. Texts without letters have none."""
        gap = " " * ORDER
        raw = np.frombuffer("".join(f"{gap}{t}{gap}" for t in texts).encode("utf-16-le", "surrogatepass"), np.uint16)
        ends = np.cumsum([len(t.encode("utf-16-le", "surrogatepass")) // 2 + 2 * ORDER for t in texts])
        units = self.table[raw]
        blank = units == 0
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        keep[0] = True
        first = np.concatenate([[0], ends[:-1]])
        keep[first] = True  # a space before each text, so that words start alike everywhere
        counts = np.add.reduceat(keep, first)
        line = units[keep]
        line[line == 0] = 32
        starts = counts.cumsum() - counts
        line = line.astype(np.uint64)
        n = len(line)
        # the three units before a text's first are spaces
        back = [np.concatenate([np.full(k, 32, np.uint64), line[:-k] if k < n else line[:0]])[:n] for k in (1, 2, 3)]
        at = np.arange(n) - np.repeat(starts, counts)
        for k in (1, 2, 3):
            back[k - 1][at < k] = 32
        code = (back[2] << _u(48)) | (back[1] << _u(32)) | (back[0] << _u(16)) | line
        drop = np.zeros(n, dtype=bool)
        drop[starts] = True  # the space in front is context only
        plain = np.add.reduceat(~blank & ((units < 0xD800) | (units >= 0xE000)), first) > 0
        has = np.array([p or (c > 2 and self._letters(t)) for p, c, t in zip(plain, counts, texts, strict=True)])
        drop |= np.repeat(~has, counts)
        return code[~drop], np.where(has, counts - 1, 0)

    @staticmethod
    def _letters(text: str) -> bool:
        return any(ch.isalpha() for ch in text)


def _texts(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[slice, list[str]]]:
    held, at, texts = 0, 0, []
    for i, t in enumerate(batch.column("text")):
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= size:
            yield slice(at, i + 1), texts
            held, at, texts = 0, i + 1, []
    if texts:
        yield slice(at, batch.num_rows), texts


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of each language with their counts, summed over the partition."""
    grams, held, waiting = Grams(), {}, {}

    def settle(lang: str) -> None:
        codes, counts = (np.concatenate(x) for x in zip(*waiting.pop(lang), strict=True))
        unique, at = np.unique(codes, return_inverse=True)
        held[lang] = (unique, np.bincount(at, counts, len(unique)).astype(np.int64))

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for span, texts in _texts(batch):
            codes, counts = grams(texts)
            of = np.repeat(langs[span], counts)
            for lang in set(langs[span]):
                unique, n = np.unique(codes[of == lang], return_counts=True)
                waiting.setdefault(lang, [held.pop(lang)] if lang in held else []).append((unique, n))
                if len(waiting[lang]) >= 8:
                    settle(lang)
    for lang in list(waiting):
        settle(lang)
    for lang, (codes, counts) in held.items():
        for i in range(0, len(codes), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes[part])), pa.array(codes[part].view(np.int64)), pa.array(counts[part])], ["lang", "gram", "n"])


class Table:
    """Rows of float32 by gram, found through sorted hashes and a radix index over their leading bits."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        keys = _hash(codes)
        order = keys.argsort()
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        bits = min(20, max(1, len(keys).bit_length()))
        self.shift = _u(64 - bits)
        self.index = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)
        self.most = int(np.diff(self.index).max()) if len(keys) else 0

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row number of each gram, -1 where it is unknown."""
        h = _hash(codes)
        top = (h >> self.shift).astype(np.int64)
        at, end = self.index[top], self.index[top + 1]
        out = np.full(len(codes), -1)
        open_ = np.flatnonzero(at < end)
        for step in range(self.most):
            place = at[open_] + step
            hit = self.keys[place] == h[open_]
            out[open_[hit]] = place[hit]
            left = ~hit & (place + 1 < end[open_])
            open_ = open_[left]
            if not len(open_):
                break
        return out


def _low(codes: np.ndarray, k: int) -> np.ndarray:
    """The last k units of packed grams."""
    return codes & _u((1 << (16 * k)) - 1) if k < 4 else codes


def _sum_by(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(codes, return_inverse=True)
    return unique, np.bincount(at, weights, len(unique))


class Models:
    """Kneser-Ney models of all languages over shared tables; picklable, for the executors."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        levels = [self._levels(g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy(float)) for _, g in counts.sort_values("lang").groupby("lang", sort=True)]
        n = len(self.langs)
        symbols = len(np.unique(np.concatenate([lv[1][0] for lv in levels]))) + 1
        self.floor = float(np.log(1.0 / symbols))
        # log-probabilities from the lowest order up, and the weight a context leaves to the order below
        self.grams: dict[int, Table] = {}
        self.contexts: dict[int, Table] = {}
        for k in range(1, ORDER + 1):
            contexts = np.unique(np.concatenate([lv[k][0] >> _u(16) for lv in levels]))
            totals, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            for i, lv in enumerate(levels):
                ctx, total = _sum_by(lv[k][0] >> _u(16), lv[k][1])
                at = np.searchsorted(contexts, ctx)
                totals[at, i], kinds[at, i] = total, _sum_by(lv[k][0] >> _u(16), np.ones(len(lv[k][0])))[1]
            rest = np.where(totals > 0, DISCOUNT * kinds / np.maximum(totals, 1), 1.0)
            self.contexts[k] = Table(contexts, np.log(rest))
            codes = np.unique(np.concatenate([lv[k][0] for lv in levels]))
            own = np.zeros((len(codes), n))
            at_ctx = np.searchsorted(contexts, codes >> _u(16))
            for i, lv in enumerate(levels):
                at = np.searchsorted(codes, lv[k][0])
                own[at, i] = np.maximum(lv[k][1] - DISCOUNT, 0) / totals[at_ctx[at], i]
            below = np.exp(self.log_prob(_low(codes, k - 1), k - 1)) if k > 1 else np.exp(self.floor)
            self.grams[k] = Table(codes, np.log(own + rest[at_ctx] * below))

    @staticmethod
    def _levels(codes: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Grams and counts by order: of the highest order how often, below how many different units stand before."""
        order = codes.argsort()
        out = {ORDER: (codes[order], counts[order])}
        for k in range(ORDER - 1, 0, -1):
            above = out[k + 1][0]
            out[k] = _sum_by(_low(above, k), np.ones(len(above)))
        return out

    def log_prob(self, codes: np.ndarray, k: int = ORDER) -> np.ndarray:
        """One row a gram, one column a language."""
        if k == 0:
            return np.full((len(codes), len(self.langs)), self.floor, np.float32)
        table = self.grams[k]
        at = table.find(codes)
        out = table.values[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            lower = self.log_prob(_low(codes[miss], k - 1), k - 1)
            ctx = self.contexts[k].find(codes[miss] >> _u(16))
            lower = lower + np.where((ctx >= 0)[:, None], self.contexts[k].values[ctx], np.float32(0))
            out[miss] = lower
        return out


def _score(models: Models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        width = len(models.langs)
        for batch in batches:
            costs = []
            for _, texts in _texts(batch):
                codes, counts = grams(texts)
                cost = np.full((len(texts), width), np.nan)
                has = counts > 0
                if has.any():
                    logp = models.log_prob(codes)
                    cost[has] = -np.add.reduceat(logp, (counts.cumsum() - counts)[has], axis=0, dtype=np.float64) / counts[has][:, None]
                costs += [None if np.isnan(c).any() else c.tolist() for c in cost]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("held_out"), pa.array(costs, pa.list_(pa.float64()))], ["doc_id", "lang", "held_out", "costs"])

    return run


def count_grams(rows: DataFrame) -> DataFrame:
    """All 4-grams of all rows (text, lang): ``lang, gram, n``."""
    return rows.select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tail(gram: Column, k: int) -> Column:
    """The last k units of packed grams, as ``_low``."""
    return gram.bitwiseAND(F.lit((1 << (16 * k)) - 1)) if k < 4 else gram


def _by_language(size: int, name: str, missing: float) -> Column:
    """Collects ``name`` of each language number ``i`` as an array."""
    return F.aggregate(F.collect_list(F.struct("i", F.col(name).alias("x"))), F.array_repeat(F.lit(missing), size), lambda a, e: F.transform(a, lambda x, j: F.when(j == e["i"], e["x"]).otherwise(x)))


class Tables:
    """The models of ``Models`` as tables: of each order ``gram, logp`` and ``context, log_rest``, arrays over the languages."""

    def __init__(self, counts: DataFrame, langs: list[str]):
        size = len(langs)
        at = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
        level = {ORDER: counts.select(at.cast("int").alias("i"), "gram", F.col("n").cast("double").alias("w"))}
        for k in range(ORDER - 1, 0, -1):
            level[k] = staged(level[k + 1].groupBy("i", _tail(F.col("gram"), k).alias("gram")).agg(F.count("*").cast("double").alias("w")), f"order{k}")
        self.floor = float(-np.log(level[1].select("gram").distinct().count() + 1))
        self.grams: dict[int, DataFrame] = {}
        self.contexts: dict[int, DataFrame] = {}
        below = counts.sparkSession.range(1).select(F.col("id").alias("low"), F.array_repeat(F.lit(self.floor), size).alias("lower"))
        for k in range(1, ORDER + 1):
            before = F.shiftrightunsigned("gram", 16)
            each = level[k].groupBy("i", before.alias("context")).agg(F.sum("w").alias("total"), F.count("*").alias("kinds"))
            each = each.withColumn("log_rest", F.log(F.lit(DISCOUNT) * F.col("kinds") / F.col("total")))
            context = staged(each.groupBy("context").agg(_by_language(size, "total", 1.0).alias("total"), _by_language(size, "log_rest", 0.0).alias("log_rest")), f"contexts{k}")
            self.contexts[k] = context.select("context", "log_rest")
            wide = level[k].groupBy("gram").agg(_by_language(size, "w", 0.0).alias("w"), F.sum("w").alias("n"))
            wide = wide.withColumns({"context": before, "low": _tail(F.col("gram"), k - 1)}).join(context, "context").join(below, "low")
            logp = F.transform(F.arrays_zip("w", "total", "log_rest", "lower"), lambda x: F.log(F.greatest(x["w"] - DISCOUNT, F.lit(0.0)) / x["total"] + F.exp(x["log_rest"] + x["lower"])))
            self.grams[k] = staged(wide.select("gram", "n", logp.alias("logp")), f"grams{k}")
            below = self.grams[k].select(F.col("gram").alias("low"), F.col("logp").alias("lower"))
        self.size = size

    def most_frequent(self, most: int) -> Table:
        """At most so many grams of the highest order, by whole powers of two of their counts."""
        power = F.floor(F.log2("n"))
        held, least = 0, 64
        for r in self.grams[ORDER].groupBy(power.alias("power")).agg(F.count("*").alias("n")).orderBy(F.desc("power")).collect():
            held += r["n"]
            if held > most:
                break
            least = r["power"]
        rows = self.grams[ORDER].where(power >= least).select("gram", *[F.get("logp", F.lit(i)).cast("float").alias(f"l{i}") for i in range(self.size)]).toArrow()
        return Table(rows["gram"].to_numpy().view(np.uint64), np.column_stack([rows[f"l{i}"].to_numpy() for i in range(self.size)]))

    def log_prob(self, asked: DataFrame) -> DataFrame:
        """``gram, logp`` of the distinct ``gram`` of ``asked``, known or not."""
        none = F.array_repeat(F.lit(0.0), self.size)
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        left, found = asked.select("gram", F.col("gram").alias("code"), none.alias("so_far")), []
        for k in range(ORDER, 0, -1):
            known = self.grams[k].select(F.col("gram").alias("code"), "logp")
            looked = staged(left.join(known, "code", "left"), "looked")
            found.append(looked.where("logp IS NOT NULL").select("gram", add(F.col("so_far"), F.col("logp")).alias("logp")))
            missed = looked.where("logp IS NULL").withColumn("context", F.shiftrightunsigned("code", 16)).join(self.contexts[k], "context", "left")
            left = missed.select("gram", _tail(F.col("code"), k - 1).alias("code"), add(F.col("so_far"), F.coalesce("log_rest", none)).alias("so_far"))
        out = left.select("gram", F.transform("so_far", lambda x: x + F.lit(self.floor)).alias("logp"))
        for part in found:
            out = out.unionByName(part)
        return out


def _score_held(table: Table):
    """Log-probabilities of a text's held grams, added up, and its other grams with how often each comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for span, texts in _texts(batch):
                codes, counts = grams(texts)
                at = table.find(codes)
                of = np.repeat(np.arange(len(texts)), counts)
                sums = np.zeros((len(texts), table.values.shape[1]))
                has = counts > 0
                if has.any():
                    rows = np.zeros((len(codes), table.values.shape[1]), np.float32)
                    rows[at >= 0] = table.values[at[at >= 0]]
                    sums[has] = np.add.reduceat(rows, (counts.cumsum() - counts)[has], axis=0, dtype=np.float64)
                others, others_n = [], []
                missed, ends = codes[at < 0], np.bincount(of[at < 0], minlength=len(texts)).cumsum()
                for part in np.split(missed, ends[:-1]):
                    unique, n = np.unique(part, return_counts=True)
                    others.append(unique.view(np.int64))
                    others_n.append(n)
                part = batch.slice(span.start, len(texts))
                columns = [part.column(c) for c in ("row", "doc_id", "lang", "held_out")]
                columns += [pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(counts.astype(np.int64)), pa.array(others, pa.list_(pa.int64())), pa.array(others_n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "lang", "held_out", "sums", "n", "others", "others_n"])

    return run


def _costs_by_join(rows: DataFrame, tables: Tables, most: int) -> DataFrame:
    schema = "row long, doc_id long, lang string, held_out boolean, sums array<double>, n long, others array<long>, others_n array<long>"
    read = staged(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score_held(tables.most_frequent(most)), schema), "read")
    others = read.select("row", F.explode(F.arrays_zip("others", "others_n")).alias("x")).select("row", F.col("x.others").alias("gram"), F.col("x.others_n").alias("times"))
    logp = staged(tables.log_prob(others.select("gram").distinct()), "others")
    found = others.join(logp, "gram").groupBy("row").agg(F.array(*[F.sum(F.get("logp", F.lit(i)) * F.col("times")) for i in range(tables.size)]).alias("more"))
    total = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda x, y: x + y))
    cost = F.when(F.col("n") > 0, F.transform(total, lambda x: -x / F.col("n")))
    return read.drop("others", "others_n").join(found, "row", "left").select("doc_id", "lang", "held_out", cost.alias("costs"))


def identify(docs: DataFrame, held: int = HELD, reject: float = REJECT) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, accepted, cross_entropy``.

    Models learn from text and lang of rows with a language whose crc32(doc_id as text) mod 3 is not 1; rows without
    doc_id are neither learnt from nor held out. ``lang_pred`` is ``und``, with score 0, where the text is null or has no
    letter, and everywhere if nothing can be learnt; else the language with the lowest cross-entropy, the first by name
    of equal ones, at any length of text. ``score`` is its calibrated share from 0 to 1; ``accepted`` is false where the
    cross-entropy lies beyond the ``reject`` quantile of that language's calibration documents: one in 16 of its training
    documents, which the models don't count, or of all languages' where it has fewer than 64. ``held`` bounds the memory of
    a task, not the models.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
    )
    taught = ~F.col("held_out") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
    many = [r["lang"] for r in rows.where(taught & F.col("text").isNotNull()).groupBy("lang").count().where(F.col("count") >= KEPT_FROM).collect()]  # one row a language
    kept = taught & F.col("lang").isin(many) & (F.crc32(F.concat(F.lit("kept "), F.col("doc_id").cast("string")).cast("binary")) % KEPT == 0)
    counts = staged(count_grams(rows.where(taught & ~kept & F.col("text").isNotNull())), "counts")
    sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("cross_entropy"))
    if sum(sizes.values()) * len(langs) <= held:
        found = rows.mapInArrow(_score(Models(counts.toPandas())), "doc_id long, lang string, held_out boolean, costs array<double>")
    else:
        found = _costs_by_join(rows, Tables(counts, langs), held // 4 // len(langs))
    costs = staged(found, "costs")
    names = F.array(*[F.lit(x) for x in langs])
    least = F.array_min("costs")
    scored = costs.withColumn("lang_pred", F.coalesce(F.get(names, (F.array_position("costs", least) - 1).cast("int")), F.lit(UNKNOWN))).withColumn("cross_entropy", least)

    def share(cost, t: float):
        return F.exp(-t * (cost - F.col("cross_entropy"))) / F.aggregate("costs", F.lit(0.0), lambda a, c: a + F.exp(-t * (c - F.col("cross_entropy"))))

    # calibration: one temperature for the shares, and a limit of cross-entropy for each language
    own_cost = F.get("costs", (F.array_position(names, F.col("lang")) - 1).cast("int"))
    known = scored.where((kept if many else taught) & F.col("costs").isNotNull())
    loss = known.agg(*[F.avg(-F.log(F.greatest(share(own_cost, t), F.lit(1e-9)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    usable = [(v, t) for v, t in zip(loss, TEMPERATURES, strict=True) if v is not None]
    best = min(usable)[1] if usable else 1.0
    limits = known.where(F.col("lang") == F.col("lang_pred")).groupBy("lang").agg(F.percentile_approx("cross_entropy", reject, 10_000).alias("limit"))
    of = {r["lang"]: r["limit"] for r in limits.collect()}  # one row a language
    widest = max(of.values(), default=0.0)  # for languages of too few documents to keep some
    limit = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(of.get(name, widest)))])
    return scored.select(
        "doc_id",
        "held_out",
        "lang_pred",
        F.coalesce(share(F.col("cross_entropy"), best), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("cross_entropy") <= F.try_element_at(limit, F.col("lang_pred")), F.lit(False)).alias("accepted"),
        "cross_entropy",
    )
