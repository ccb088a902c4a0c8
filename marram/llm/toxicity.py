"""Toxicity of texts whose words may be disguised: noisy-channel restoration, then a score of what was restored.

A character model (four symbols a gram, Witten-Bell) is counted over all documents. A token that holds leetspeak, signs
between its letters, or letters repeated thrice or more, or a run of single characters with spaces between them, is
read as a lattice: a sign or digit is one of the letters that it stands for, or ends a word; a sign or space between
letters ends a word, or was put in; a repeated letter is meant once or twice. The cheapest path under channel costs
and the character model is what the writer meant (Viterbi). Tokens of letters alone have one path, except for doubled
letters, which are read singly where the model prefers that by far.

A text's score joins, as independent causes, the marks of toxic documents that it holds. They are found on a bounded sample
of labelled documents by sequential covering, in the order of their purity and evidence: a mark is judged on the documents that
none before it marks, so words that only go along with others (as in copies of a toxic text) explain nothing and drop
out. A mark is a whole word, or the beginning of words that go on, so that other forms of a stem are found too.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared
from .langid import held_out

#: Symbols: 0 ends words, 1 to 26 are a to z, 27 is any other letter; symbols a gram.
SYMBOLS, ORDER = 28, 4
#: What signs and digits may stand for. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Signs that can stand between the letters of a word. Fixed values.
BETWEEN = ".-_*~^'` "
#: Channel costs in nats: a sign stands for a letter, a sign or digit ends a word inside a token or at its edge, something was put in between letters, a doubled letter is meant once.
STANDS, ENDS, EDGE, PUT_IN, DOUBLED = 1.0, 3.0, 0.5, 1.5, 6.0
#: Labelled documents that marks are chosen on, about, of each class, and candidate marks, the most telling first.
SAMPLE_DOCS, CANDIDATES = 10_000, 20_000
#: Letters of a word's beginning that can be a mark.
BEGINNINGS = range(3, 9)
#: Nats of evidence beyond the number of marks tried; nats that a mark must add to what is explained; documents that smooth its rate.
EVIDENCE, ADDED, SMOOTH = 2.0, 2.0, 2.0
#: Shares of toxic documents among a mark's that part purer marks from others.
BANDS = (0.9, 0.7, 0.5, 0.3)
PREDICTED = 0.3
#: Tokens that a worker keeps the reading of, marks that it counts before it hands them on, and symbols counted at once.
KEPT, COUNTED, PIECE = 200_000, 500_000, 1 << 20

_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_STRONG = re.compile(r"[\s,;:?/\\\"“”„«»<>=\[\]{})#%&…·•]+")
_TRIPLE, _DOUBLE = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")


def stripped(token: str) -> str:
    """A token without what is punctuation at its edges: signs that stand between letters, and other signs in runs of two or more."""

    def edge(chars: str) -> int:
        i = 0
        while i < len(chars) and not chars[i].isalnum():
            c, run = chars[i], i
            while run < len(chars) and chars[run] == c:
                run += 1
            if c not in BETWEEN and run - i < 2:
                break
            i = run
        return i

    first = edge(token)
    return token[first : len(token) - edge(token[:first:-1]) if first < len(token) else first]


def _byte_symbols() -> np.ndarray:
    """The symbol of each UTF-8 byte: a character beyond ASCII counts as one other letter, by its first byte; 255 adds nothing."""
    table = np.zeros(256, np.uint8)
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = k + 1
    table[0x80:0xC0], table[0xC0:] = 255, 27
    return table


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, counts = _byte_symbols(), np.zeros(SYMBOLS**ORDER, np.int64)
    for batch in batches:
        raw = np.frombuffer("\n".join(["", *(t or "" for t in batch.column(0).to_pylist()), ""]).encode("utf-8", "surrogatepass"), np.uint8)
        symbols = table[raw]
        symbols = symbols[symbols != 255]
        ends = symbols == 0
        symbols = symbols[~(ends & np.append(False, ends[:-1]))]
        symbols = np.repeat(symbols, np.where(symbols == 0, ORDER - 1, 1))  # every word begins with a context of its own
        for a in range(0, len(symbols) - ORDER + 1, PIECE):
            part = symbols[a : a + PIECE + ORDER - 1].astype(np.int32)
            gram = np.zeros(len(part) - ORDER + 1, np.int32)
            for k in range(ORDER):
                gram = gram * SYMBOLS + part[k : k + len(gram)]
            counts += np.bincount(gram, minlength=len(counts))
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """-log P(symbol | three before it), by gram, counted over every whole text of ``docs`` (text).

    What reaches the driver is a row a gram at most, 28^4 of them. Null and empty texts add nothing; without any text all
    symbols are alike.
    """
    _shared.bounded_batches(docs.sparkSession)
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**ORDER)
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape((SYMBOLS,) * ORDER)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(1, ORDER + 1):
        own = counts.sum(axis=tuple(range(ORDER - k))) if k < ORDER else counts
        total, kinds = own.sum(-1, keepdims=True), (own > 0).sum(-1, keepdims=True)
        p = np.where(total > 0, (own + kinds * p) / np.maximum(total + kinds, 1), p)
    return -np.log(p).astype(np.float32).ravel()


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def _spelled(path: tuple | None) -> str:
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


class Restorer:
    """Reads tokens under a character model, and keeps the readings of those seen before."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.kept = array("f", costs.tobytes()), {}

    def cost(self, word: str) -> float:
        h, total = 0, 0.0
        for c in (*map(_symbol, word), 0):
            gram = h * SYMBOLS + c
            total += self.costs[gram]
            h = gram % SYMBOLS ** (ORDER - 1)
        return total

    def viterbi(self, token: str) -> str:
        """The cheapest reading of a token's lattice: words with spaces between them."""
        costs, base, n = self.costs, SYMBOLS ** (ORDER - 1), len(token)
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        done: list[str] = []
        for i, c in enumerate(token):
            if len(states) == 1 and i % 64 == 0:  # all paths agree so far: what they read is settled, and a long token's paths stay short
                ((h, (total, path)),) = states.items()
                done.append(_spelled(path))
                states = {h: (total, None)}
            before, after = token[i - 1] if i else " ", token[i + 1] if i + 1 < n else " "
            run = 0
            while run < i and run < 3 and token[i - 1 - run] == c:
                run += 1
            # (what is read, its cost): "" adds nothing, " " ends a word
            if c in LEET:
                options = [(x, STANDS) for x in LEET[c]] + [(" ", EDGE if i in (0, n - 1) or before.isdigit() or after.isdigit() else ENDS)]
            elif c.isalpha():
                options = [(c, 0.0)]
            elif c in BETWEEN:
                options = [(" ", 0.0), ("", PUT_IN)]
            else:
                options = [(" ", 0.0)]
            if run and options[0][0] != " ":
                tripled = run > 1 or after == c
                options = ([] if run > 1 else options) + [("", 0.0 if tripled else DOUBLED)]
            found: dict[int, tuple[float, tuple | None]] = {}
            for h, (total, path) in states.items():
                for x, extra in options:
                    if x == "":
                        new, cost, to = h, total + extra, path
                    elif x == " ":
                        new, cost = 0, total + extra + (costs[h * SYMBOLS] if h else 0.0)
                        to = (path, " ") if h else path
                    else:
                        gram = h * SYMBOLS + _symbol(x)
                        new, cost, to = gram % base, total + extra + costs[gram], (path, x)
                    if new not in found or cost < found[new][0]:
                        found[new] = cost, to
            states = found
        path = min((total + (costs[h * SYMBOLS] if h else 0.0), h, p) for h, (total, p) in states.items())[2] if len(states) > 1 else next(iter(states.values()))[1]
        return "".join([*done, _spelled(path)]).strip()

    def _read(self, token: str) -> str:
        words = []
        for part in _STRONG.split(token):
            part = stripped(part)
            if not part or not any(c.isalpha() for c in part):
                continue
            if not part.isalpha() or _TRIPLE.search(part):
                words.append(self.viterbi(part))
            elif _DOUBLE.search(part) and self.cost(single := _DOUBLE.sub(r"\1", part)) + DOUBLED * len(_DOUBLE.findall(part)) < self.cost(part):
                words.append(single)
            else:
                words.append(part)
        return " ".join(filter(None, words))

    def token(self, token: str) -> str:
        """The words that a lower-cased token, without white space, means."""
        if (found := self.kept.get(token)) is None:
            found = self._read(token)
            if len(token) <= 64:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[token] = found
        return found

    def spaced(self, run: str) -> str:
        """The words that a run of single characters means."""
        run = " ".join(run.split())
        return self.viterbi(run) if any(c.isalpha() for c in run) else ""

    def text(self, text: str | None) -> str:
        """A whole text restored."""
        low, out, end = (text or "").lower(), [], 0
        for m in _SPACED.finditer(low):
            out += map(self.token, low[end : m.start()].split())
            out.append(self.spaced(m.group()))
            end = m.end()
        out += map(self.token, low[end:].split())
        return " ".join(filter(None, out))

    def tokens(self, text: str | None) -> tuple[set[str], set[str]]:
        """The distinct tokens of a whole text, and the distinct words of its runs of single characters."""
        low, tokens, end, words = (text or "").lower(), set(), 0, set()
        for m in _SPACED.finditer(low):
            tokens.update(low[end : m.start()].split())
            words.update(self.spaced(m.group()).split())
            end = m.end()
        tokens.update(low[end:].split())
        return tokens, words

    def words(self, text: str | None) -> set[str]:
        """The distinct words of a whole text restored."""
        tokens, words = self.tokens(text)
        for t in tokens:
            words.update(self.token(t).split())
        return words


def marks_of(words: set[str]) -> set[str]:
    """What can be a mark: whole words, an underscore after them, and the beginnings of words that go on."""
    return {f"{w}_" for w in words} | {w[:k] for w in words for k in BEGINNINGS if k < len(w)}


@dataclass
class Marks:
    """Marks of toxic documents, each with the share of documents holding it that are toxic; and the share among those without any."""

    shares: dict[str, float]
    rest: float = 0.0

    def score(self, found: set[str]) -> float:
        clean = 1 - self.rest
        for m in sorted(found):
            clean *= 1 - self.shares[m]
        return 1 - clean


class Scorer:
    """Finds the marks of texts, and keeps those of tokens seen before."""

    def __init__(self, restorer: Restorer, marks: Marks):
        self.restorer, self.marks, self.kept = restorer, marks, {}

    def found(self, text: str | None) -> set[str]:
        tokens, words = self.restorer.tokens(text)
        known, out = self.marks.shares.keys(), marks_of(words) & self.marks.shares.keys()
        for t in tokens:
            if (own := self.kept.get(t)) is None:
                own = tuple(marks_of(set(self.restorer.token(t).split())) & known)
                if len(t) <= 64:
                    if len(self.kept) >= KEPT:
                        self.kept.clear()
                    self.kept[t] = own
            if own:
                out.update(own)
        return out


def _restorer(shared) -> Restorer:
    return _shared.kept(("toxicity", id(shared.value)), lambda: Restorer(shared.value))


def restored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """All columns of ``docs`` (text) and ``_restored``: the whole text as meant, lower-cased words with single spaces.

    Null and empty texts give an empty one; repeated rows are read alike; long texts are read whole. A column of that name
    is replaced.
    """
    _shared.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            own = _restorer(shared)
            yield pa.array([own.text(t) for t in texts.to_pylist()], pa.string())

    return docs.drop("_restored").withColumn("_restored", F.arrow_udf(run, "string").asNondeterministic()(F.col("text").cast("string")))


def sample_of(labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, float]:
    """(doc_id, toxic) of labelled documents: about ``sample_docs`` of each class, picked by the hash of the doc_id; and how many times as
    likely a toxic one is to be picked as another. A doc_id with several labels is toxic if one says so; rows without a doc_id
    or a label teach nothing.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    shares = [min(1 << 30, (sample_docs << 30) // max(1, counts.get(k, 0))) for k in (0, 1)]
    picked = one.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    return picked, shares[1] / shares[0]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents, and how many toxic ones, hold each possible mark; the empty mark counts documents."""

    def given(n: dict[str, int], t: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([t.get(m, 0) for m in n], pa.int64())], names=["mark", "n", "t"])

    n, t = {}, {}
    for batch in batches:
        for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for m in ("", *marks_of(set(words))):
                n[m] = n.get(m, 0) + 1
                if toxic:
                    t[m] = t.get(m, 0) + 1
            if len(n) > COUNTED:
                yield given(n, t)
                n, t = {}, {}
    yield given(n, t)


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample_docs: int = SAMPLE_DOCS) -> Marks:
    """The marks of toxic documents: ``labels`` has doc_id and toxic, ``docs`` doc_id and text.

    Texts stay on the executors; where the ``CANDIDATES`` most telling marks of the bounded sample occur reaches the driver. Without
    labels of both classes nothing is learned and all scores are alike. Repeated documents count as often as they occur.
    """
    spark = docs.sparkSession
    _shared.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            own = _restorer(shared)
            yield pa.array([sorted(own.words(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample, times = sample_of(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), sample_docs)
    sample = F.broadcast(_shared.store(sample, "toxicity-sample"))  # some 2 x sample_docs ids
    rows = picked.join(sample, "doc_id").select("toxic", F.arrow_udf(words, "array<string>").asNondeterministic()("text").alias("words"))
    rows = _shared.store(rows, "toxicity-words")
    counts = _shared.store(rows.mapInArrow(_tally, "mark string, n long, t long").groupBy("mark").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "toxicity-marks")
    every, tried = counts.where("mark = ''").first(), counts.count()
    if every is None or every.t in (0, every.n):
        _shared.drop(rows, counts)
        return Marks({})
    base = every.t / every.n
    telling = counts.where(F.col("mark") != "").withColumn("gain", _gain(F.col("n"), F.col("t"), base, F)).where((F.col("t") > base * F.col("n")) & (F.col("gain") >= math.log(tried) + EVIDENCE))
    names = [r.mark for r in telling.orderBy(F.desc("gain"), "mark").select("mark").limit(CANDIDATES).collect()]
    numbers = spark.sparkContext.broadcast({m: k for k, m in enumerate(names)})

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = numbers.value
            found = [[known[m] for m in marks_of(set(w)) if m in known] for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "marks"])

    found = rows.mapInArrow(held, "toxic int, marks array<int>").where("size(marks) > 0").toArrow()
    sizes = found["marks"].combine_chunks().value_lengths().to_numpy() if len(found) else np.zeros(0, int)
    mark = found["marks"].combine_chunks().flatten().to_numpy() if len(found) else np.zeros(0, int)
    _shared.drop(rows, counts)
    return cover(names, mark, np.repeat(np.arange(len(sizes)), sizes), found["toxic"].to_numpy(), every.n, every.t, times)


def _gain(n, t, base: float, log):
    """Nats that a word's own rate explains beyond the overall one; ``log`` is numpy or Spark's functions."""
    part = lambda k, p: k * log.log((k + 1e-9) / (n + 1e-9) / p)
    return part(t, base) + part(n - t, 1 - base)


def cover(names: list[str], mark: np.ndarray, doc: np.ndarray, label: np.ndarray, n: int, t: int, times: float = 1.0) -> Marks:
    """Sequential covering: ``mark`` (a place in ``names``) occurs in ``doc``, whose label is ``label[doc]``; ``n`` documents, ``t`` of
    them toxic, which are picked ``times`` as often as others.

    Purer marks come first (by ``BANDS`` of their share), then those of more evidence over all documents, so a mark of toxic
    texts of many origins comes before those of one copied text. Of equal ones the longest comes first.
    """
    base, label = t / n, label.astype(np.int64)
    of = np.split(doc[np.argsort(mark, kind="stable")], np.cumsum(np.bincount(mark, minlength=len(names)))[:-1]) if names else []
    whole = [(len(d), int(label[d].sum())) for d in of]

    def share(n: int, t: int, smooth: float) -> float:
        """A rate in the sample as one of all labelled documents."""
        p = (t + smooth) / (n + SMOOTH)
        return p / (p + (1 - p) * times)

    open_, chosen, rest_n, rest_t = np.ones(len(label), bool), {}, n, t
    shares = [share(*w, SMOOTH * base) for w in whole]
    for k in sorted(range(len(of)), key=lambda k: (sum(shares[k] < b for b in BANDS), -round(float(_gain(*whole[k], base, np)), 9), -len(names[k]), names[k])):
        live = of[k][open_[of[k]]]
        own_n, own_t = len(live), int(label[live].sum())
        if own_t > base * own_n and _gain(own_n, own_t, base, np) >= ADDED:
            chosen[names[k]] = shares[k]
            open_[live] = False
            rest_n, rest_t = rest_n - own_n, rest_t - own_t
    return Marks(chosen, share(rest_n, rest_t, SMOOTH * base / 2))


def score(docs: DataFrame, model: np.ndarray, marks: Marks) -> DataFrame:
    """All columns of ``docs`` and a struct ``_toxicity``: score (0 to 1), predicted (1 from ``PREDICTED`` on), marks (those found).

    Only the text is looked at, whole. Null and empty texts get the score of texts without a mark; repeated rows are
    scored alike. A column named ``_toxicity`` is replaced.
    """
    _shared.bounded_batches(docs.sparkSession)
    shared, shared_marks = docs.sparkSession.sparkContext.broadcast(model), docs.sparkSession.sparkContext.broadcast(marks)
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("marks", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            known, out = shared_marks.value, []
            own = _shared.kept(("toxicity", id(shared.value), id(known)), lambda known=known: Scorer(Restorer(shared.value), known))
            for text in texts.to_pylist():
                found = own.found(text)
                s = known.score(found)
                out.append({"score": s, "predicted": int(s >= PREDICTED), "marks": sorted(found)})
            yield pa.array(out, kind)

    scored = F.arrow_udf(run, "struct<score:double,predicted:int,marks:array<string>>").asNondeterministic()
    return docs.drop("_toxicity").withColumn("_toxicity", scored(F.col("text").cast("string")))


def op13_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _shared.read(spark, sf_dir, "documents").select("doc_id", "text"), _shared.read(spark, sf_dir, "labels")
    model = character_model(docs)
    marks = learn(docs, labels.where(~held_out()), model)
    return score(docs, model, marks).select("doc_id", held_out().alias("held_out"), F.col("_toxicity.score").alias("score"), F.col("_toxicity.predicted").alias("predicted"), F.col("_toxicity.marks").alias("marks"))
