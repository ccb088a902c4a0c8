"""Language identification by interpolated Kneser-Ney character models, one a language.

A word (a run of letters, lower-cased) is read as padded character n-grams. Models are fitted on a bounded
sample of labelled documents: Spark counts n-grams, what comes before and after them, and the discounts. What each
order adds, and what weight it leaves to the order below, lies in sorted hash arrays, in sparse rows of (language,
value), so a single binary search serves all languages. The language of a text is that of the lowest cross-entropy a
character; a text is rejected if it has no letter, or if even that is further above its language's mean than nearly
all held-out documents are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

#: n-gram order; documents a language, about, that models are fitted on (a quarter of them for calibration only).
ORDER, SAMPLE_DOCS = 5, 1200
#: Share of held-out documents that are not rejected, and nats a character that texts of a language differ by anyway.
ACCEPTED, MANNER = 0.998, 0.1
UNKNOWN = "und"
#: Words whose scores a worker keeps; numbers that a worker computes at once and keeps; languages that are broadcast.
KEPT, NUMBERS, BROADCAST_LANGUAGES = 200_000, 2_000_000, 100_000
SHARPNESS = (2.0, 5.0, 10.0, 20.0, 40.0)

_PAD, _END = "\x02", "\x03"


_WORDS = re.compile(r"[^\W\d_]+")


@lru_cache(1)
def _letters() -> re.Pattern:
    others = "".join(chr(i) for i in range(0x110000) if chr(i).isalnum() and not chr(i).isalpha())
    return re.compile(f"[^\\W_{others}]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased: characters of the Unicode categories L. ``\\w`` has numerals of other kinds than
    digits besides; they are rare, and the pattern without them is slow.
    """
    words = _WORDS.findall((text or "").lower())
    if not words or "".join(words).isalpha():
        return words
    return [part for w in words for part in ([w] if w.isalpha() else _letters().findall(w))]


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place from n - 1 on."""
    out = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


@dataclass
class Rows:
    """Sorted hashes, and for each its sparse row of (language, value)."""

    keys: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, grams: list[str], n: int, languages: np.ndarray, values: np.ndarray) -> Rows:
        """From one entry an n-gram and language."""
        hashes = _hash(_codes("".join(grams)), n)[::n] if n and grams else np.zeros(len(grams), np.uint64)
        order = np.lexsort((languages, hashes))
        keys, starts = np.unique(hashes[order], return_index=True)
        return cls(keys, np.append(starts, len(order)), languages[order].astype(np.int32), values[order])

    def entries(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``hashes``, language, value) of all entries."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == hashes) if len(self.keys) else np.zeros(0, int)
        at = at[place]
        n = self.starts[at + 1] - self.starts[at]
        entry = np.arange(n.sum()) + np.repeat(self.starts[at] - (np.cumsum(n) - n), n)
        return np.repeat(place, n), self.languages[entry], self.values[entry]


@dataclass
class Models:
    languages: list[str]
    #: Symbols that a model can predict, with one for all unseen characters: the lowest order is even over them.
    symbols: int = 2
    #: By order from 1: what a seen n-gram adds to its probability, and the weight that its context leaves to the order below.
    added: list[Rows] = field(default_factory=list)
    left: list[Rows] = field(default_factory=list)
    sharpness: float = 20.0
    #: By language: mean cross-entropy and its deviation a character; and the most that a text may be above, in scaled units.
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = math.inf

    def word_costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats by language, characters) of each word, its end counted as a character."""
        order, lengths = len(self.added), np.array([len(w) + 1 for w in words])
        at_once, costs = max(64, NUMBERS // max(1, len(self.languages))), []
        cuts = np.unique(np.cumsum(lengths) // at_once, return_index=True)[1].tolist()
        for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True):
            codes = _codes("".join(_PAD * (order - 1) + w + _END for w in words[a:b]))
            own = lengths[a:b]
            ends = np.repeat(np.cumsum(own + order - 1), own)
            place = ends - own.sum() + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own.sum(), own)  # all but each word's padding
            p = np.full((len(place), len(self.languages)), 1 / self.symbols)
            for n in range(1, order + 1):
                context = _hash(codes, n - 1)[place - n + 1] if n > 1 else np.zeros(len(place), np.uint64)
                i, lang, value = self.left[n - 1].entries(context)
                p[i, lang] *= value
                i, lang, value = self.added[n - 1].entries(_hash(codes, n)[place - n + 1])
                p[i, lang] += value
            costs.append(np.add.reduceat(-np.log(p), np.cumsum(own) - own, axis=0))
        return np.concatenate(costs), lengths

    def excess(self, entropy: np.ndarray, language: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How far a text's cross-entropy is above its language's mean, in units that grow as texts get shorter."""
        return (entropy - self.mean[language]) / (MANNER + self.spread[language] / np.sqrt(np.maximum(sizes, 1)))


class Scorer:
    """Scores texts, and keeps the scores of words seen before."""

    def __init__(self, models: Models):
        self.models, self.at, self.kept = models, {}, min(KEPT, NUMBERS // max(1, len(models.languages)))
        self.costs, self.sizes = np.zeros((1024, len(models.languages))), np.zeros(1024)

    def _learn(self, words: list[str]) -> None:
        costs, sizes = self.models.word_costs(words)
        n = len(self.at) + len(words)
        if n > len(self.sizes):
            room = max(n, 2 * len(self.sizes))
            self.costs, self.sizes = np.resize(self.costs, (room, self.costs.shape[1])), np.resize(self.sizes, room)
        self.costs[len(self.at) : n], self.sizes[len(self.at) : n] = costs, sizes
        self.at.update(zip(words, range(len(self.at), n), strict=True))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy by language, characters) of each whole text; texts without letters have 0 characters."""
        entropy, sizes = np.zeros((len(texts), len(self.models.languages))), np.zeros(len(texts))
        for i in range(0, len(texts), 64):
            words = [words_of(t) for t in texts[i : i + 64]]
            seen = set().union(*words)
            if len(seen) > self.kept:  # more than is ever kept
                for k, own in enumerate(words):
                    for j in range(0, len(own), 4096):
                        cost, size = self.models.word_costs(own[j : j + 4096])
                        entropy[i + k] += cost.sum(0)
                        sizes[i + k] += size.sum()
                continue
            if new := [w for w in seen if w not in self.at]:
                if len(self.at) + len(new) > self.kept:
                    self.at.clear()
                    new = list(seen)
                self._learn(new)
            for k, own in enumerate(words):
                if own:
                    at = np.fromiter(map(self.at.__getitem__, own), np.int64, len(own))
                    entropy[i + k], sizes[i + k] = self.costs[at].sum(0), self.sizes[at].sum()
        return entropy / np.maximum(sizes, 1)[:, None], sizes


def _scorer(shared) -> Scorer:
    """The worker's scorer of a broadcast model."""
    models = shared.value
    return _shared.kept(("language models", id(models)), lambda: Scorer(models))


def _predict(shared):
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scorer = _scorer(shared)
            m = scorer.models
            entropy, sizes = scorer.entropies(texts.to_pylist())
            best, some = entropy.argmin(1), sizes > 0
            low = entropy[np.arange(len(best)), best]
            lang = [m.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            # The share of the best language when entropies are weighed against each other; it falls as a text is further off than
            # texts of that language are.
            excess = m.excess(low, best, sizes)
            rejected = ~some | (excess > m.limit)
            with np.errstate(invalid="ignore"):
                off = np.where(some & rejected, m.limit / np.maximum(excess, 1e-9), 1.0) ** 2
            score = np.where(some, off / np.exp(-m.sharpness * (entropy - low[:, None])).sum(1), 0.0)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(np.where(some, low, np.nan)), pa.array(rejected)], fields=list(kind))

    return F.arrow_udf(run, "struct<lang:string,score:double,entropy:double,rejected:boolean>").asNondeterministic()


def _measured(shared):
    """Of labelled texts, the cross-entropy of their own language, characters, and the log-loss of the label for each sharpness."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, langs in batches:
            scorer = _scorer(shared)
            number = {lang: k for k, lang in enumerate(scorer.models.languages)}
            own = np.array([number.get(lang, -1) for lang in langs.to_pylist()])
            entropy, sizes = scorer.entropies(texts.to_pylist())
            mine = entropy[np.arange(len(own)), own]
            losses = np.stack([np.log(np.exp(-s * (entropy - mine[:, None])).sum(1)) for s in SHARPNESS], 1)
            yield pa.StructArray.from_arrays([pa.array(np.where(own >= 0, mine, 0.0)), pa.array(np.where(own >= 0, sizes, 0.0)), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * len(SHARPNESS), pa.int32()), pa.array(losses.ravel()))], names=["entropy", "size", "losses"])

    return F.arrow_udf(run, "struct<entropy:double,size:double,losses:array<double>>").asNondeterministic()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, str], int] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for w in words_of(text):
                found[lang, w] = found.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


def counted(words: DataFrame, order: int) -> DataFrame:
    """(lang, size, gram, c) from ``words`` (lang, word, n): how often an n-gram of the highest order occurs; of a lower
    one, how many different characters come before it.
    """
    padded = F.concat(F.lit(_PAD * (order - 1)), "word", F.lit(_END))
    grams = words.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(padded, i, F.lit(order)))).alias("gram"))
    top = _shared.store(grams.groupBy("lang", "gram").agg(F.sum("n").alias("c")), "grams")
    longer = top.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.lit(order - 1)), lambda i: F.struct(i.alias("size"), F.substr("gram", order - i, i + 1).alias("gram")))).alias("x")) if order > 1 else None
    out = top.select("lang", F.lit(order).alias("size"), "gram", "c")
    if longer is not None:
        kinds = longer.select("lang", "x.*").distinct().groupBy("lang", "size", F.substr("gram", F.lit(2)).alias("gram")).agg(F.count("*").alias("c"))
        out = out.unionByName(kinds)
    return out


def train(words: DataFrame, order: int = ORDER) -> Models:
    """Models of ``words`` (lang, word, n), not calibrated. What is gathered grows with the sample alone."""
    counts = _shared.store(counted(words, order), "gram-counts")
    is_ = lambda k: F.count_if(F.col("c") == k)
    ones, twos = is_(1), is_(2)
    discounts = counts.groupBy("lang", "size").agg(F.when(ones > 0, ones / (ones + 2 * twos)).otherwise(0.5).alias("d"))
    context = F.substr("gram", F.lit(1), F.col("size") - 1)
    contexts = counts.groupBy("lang", "size", context.alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).join(discounts, ["lang", "size"])
    added = counts.withColumn("context", context).join(contexts, ["lang", "size", "context"]).select("size", "lang", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("value"))
    left = contexts.select("size", "lang", F.col("context").alias("gram"), (F.col("d") * F.col("kinds") / F.col("total")).alias("value"))
    tables = [df.toArrow() for df in (added, left)]
    languages = sorted(set(tables[0]["lang"].unique().to_pylist()))
    number = {lang: k for k, lang in enumerate(languages)}
    models = Models(languages)
    for table, out in zip(tables, (models.added, models.left), strict=True):
        size, codes = table["size"].to_numpy(), table["lang"].combine_chunks().dictionary_encode()
        lang = np.array([number[x] for x in codes.dictionary.to_pylist()], np.int32)[codes.indices.to_numpy()] if len(codes) else np.zeros(0, np.int32)
        for n in range(1, order + 1):
            rows = np.flatnonzero(size == n)
            out.append(Rows.of(table["gram"].take(pa.array(rows)).to_pylist(), n if out is models.added else n - 1, lang[rows], table["value"].to_numpy()[rows]))
    models.symbols = len(models.added[0].keys) + 1
    _shared.drop(counts)
    return models


def fit(labelled: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Fit models on ``labelled`` (doc_id, text, lang): of each language, about ``sample_docs`` documents, picked by the
    hash of their doc_id; texts stay on the executors. Rows without a language, a doc_id or a letter teach nothing.
    There is no limit on the number of languages; those that only occur in the calibration quarter are not learned.
    """
    spark = labelled.sparkSession
    _shared.bounded_batches(spark)
    labelled = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shares = _shared.store(labelled.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.least(F.lit(1.0), sample_docs / F.count("*")) * (1 << 20))).alias("share")), "language-shares")
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_LANGUAGES else shares
    picked = labelled.join(shares, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share"))
    sample = _shared.store(picked.select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0).alias("calibrates")), "language-sample")
    words = sample.where("NOT calibrates").select("lang", "text").mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    models = train(words, order)
    calibrate(models, sample.where("calibrates"))
    _shared.drop(sample)
    return models


def calibrate(models: Models, held: DataFrame) -> None:
    """Set mean and spread of each language, the limit of rejection and the sharpness of scores by held-out documents (lang, text)."""
    if not models.languages:
        return
    n = len(models.languages)
    models.mean, models.spread = np.full(n, math.log(models.symbols)), np.ones(n)
    measured = held.select("lang", _measured(held.sparkSession.sparkContext.broadcast(models))("text", "lang").alias("m"))
    rows = _shared.store(measured.select("lang", "m.*").where("size > 0"), "measured")
    number = {lang: k for k, lang in enumerate(models.languages)}
    own = rows.groupBy("lang").agg((F.sum(F.col("entropy") * F.col("size")) / F.sum("size")).alias("mean"), F.count("*").alias("n")).where("n >= 5")
    off = rows.join(own, "lang").withColumn("off", F.col("entropy") - F.col("mean"))
    for lang, mean, square in off.groupBy("lang", "mean").agg(F.percentile_approx(F.pow("off", F.lit(2)) * F.col("size"), 0.5, 1000)).collect():  # a row a language
        models.mean[number[lang]], models.spread[number[lang]] = mean, max(0.5, math.sqrt(square / 0.455))
    spreads = held.sparkSession.createDataFrame([(lang, float(s)) for lang, s in zip(models.languages, models.spread, strict=True)], "lang string, spread double")
    scaled = off.join(spreads, "lang").select((F.col("off") / (MANNER + F.col("spread") / F.sqrt(F.greatest("size", F.lit(1.0))))).alias("x"))
    limit = scaled.agg(F.percentile("x", ACCEPTED)).first()[0]
    models.limit = math.inf if limit is None else max(3.0, limit)
    losses = rows.agg(*[F.avg(F.col("losses")[i]) for i in range(len(SHARPNESS))]).first()
    if losses[0] is not None:
        models.sharpness = SHARPNESS[int(np.argmin(losses))]
    _shared.drop(rows)


def _predicted(docs: DataFrame, models: Models):
    if not models.languages:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(float("nan")).alias("entropy"), F.lit(True).alias("rejected"))
    return _predict(docs.sparkSession.sparkContext.broadcast(models))(F.col("text").cast("string"))


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """All columns of ``docs`` and a struct ``_language``: lang, score (0 to 1), entropy, rejected.

    Only the text is looked at, whole, however long. Null texts and texts without letters are ``und``, with score 0, and rejected; so is
    every text if no language was learned. A text that the models reject keeps the nearest language, with a score that falls
    with its distance. Ties go to the first language by name. A column named ``_language`` is
    replaced.
    """
    _shared.bounded_batches(docs.sparkSession)
    return docs.drop("_language").withColumn("_language", _predicted(docs, models))


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The documents that are not rejected, with all their columns; a column ``lang`` carries the language predicted.

    Documents with null, empty or letterless texts go. Repeated rows are judged alike.
    """
    _shared.bounded_batches(docs.sparkSession)
    (found,) = _shared.free(docs, "_language")
    kept = docs.withColumn(found, _predicted(docs, models)).where(f"NOT `{found}`.rejected")
    lang = F.col(f"`{found}`.lang")
    return kept.select(*[lang.cast(docs.schema[c].dataType).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label is kept from the models."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), models).select("doc_id", held_out().alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"), F.col("_language.rejected").alias("rejected"))
