"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models.

Three patterns give the base spans. The models look at the other long tokens: one Markov chain over random
strings, one over ordinary identifiers, both trained from labelled samples; a token whose mean log-likelihood
ratio is over a calibrated threshold is a span of kind ``markov``. All spans are code points, end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of these always starts its match where the longer form of the pattern does, so the length is in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: What the models judge: all tokens from the length on that the threshold is calibrated for.
LEAST_LENGTH = 12
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Labelled samples: identifiers are taken from about so many documents, and so many random strings are made.
SAMPLE_DOCS, SAMPLE_RANDOM = 2000, 4000
#: Share of the ordinary sample that may be over the threshold, and of the random sample, cut to the least length, that may be under it.
FALSE_SHARE, MISSED_SHARE = 0.001, 0.05
#: Code points of the chunks that a text is cut into to redact it.
CHUNK = 4096
#: A long token that occurs so often in the sample is a word without further proof.
RECURS = 5

KINDS = ("assign", "access", "hex", "markov")


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def _before(values: Column, zero: Column, merge) -> Column:
    """For each of ``values``, those before it merged, from ``zero`` on.

    A fold that appends to an array copies it each time, so values go in blocks of the square root of their number.
    """

    def along(xs: Column, first: Column) -> Column:
        grown = F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))
        return F.slice(grown, 1, F.size(xs))

    def by_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda x, y: merge(x, y)))
        return F.flatten(F.zip_with(blocks, _let(totals, lambda t: along(t, zero)), along))

    def cut(v: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, width))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: _let(cut(v, width), by_blocks))).otherwise(F.slice(v, 1, 0)))


def _spans(text: Column, pattern: str, kind: str, keep=None, group: int | None = None) -> Column:
    """Spans (start, kind number, end, match, group's length) of all matches of ``pattern``, leftmost first.

    What lies between the matches gives their places: the n-th starts after n pieces and n - 1 matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
    parts = F.zip_with(matches, F.split(text, pattern, -1), lambda m, p: F.struct(m.alias("match"), F.length(p).alias("piece")))

    def placed(parts: Column) -> Column:
        parts = F.filter(parts, lambda x: x["match"].isNotNull())  # a text has one piece more than it has matches
        return _let(parts, lambda ps: F.zip_with(ps, _before(F.transform(ps, lambda x: x["piece"] + F.length(x["match"])), F.lit(0), lambda x, y: x + y), span))

    def span(x: Column, before: Column) -> Column:
        start = before + x["piece"]
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(x["match"])).alias("end"), x["match"].alias("token"))

    rows = F.zip_with(_let(parts, placed), inner, lambda s, g: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["token"].alias("token"), F.length(F.coalesce(g, s["token"])).alias("size")))
    if keep:
        rows = F.filter(rows, keep)
    # Most texts have no match: one search tells.
    none = F.array().cast("array<struct<start:int,kind:int,end:int,token:string,size:int>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def base_spans(text: Column) -> Column:
    """Base spans of a text by start, then kind."""
    assign = _spans(text, ASSIGN, "assign", lambda s: s["size"] >= 8, group=2)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


@dataclass(frozen=True)
class Ratio:
    """Log-likelihood ratio of every pair of symbols, row by row, and the threshold of its mean."""

    pairs: tuple[float, ...]
    threshold: float

    def mean(self, token: Column) -> Column:
        """Mean log-likelihood ratio of a token, over its pairs of neighbours."""
        n = len(SYMBOLS)
        codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
        table = F.split(F.lit(",".join(map(repr, self.pairs))), ",").cast("array<double>")  # one constant, not one a pair
        places = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: F.element_at(table, a * n + b + 1))
        return F.aggregate(places, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.lit(1), F.size(codes) - 1)


def _pair_counts(tokens: DataFrame) -> list[int]:
    """How often each pair of symbols occurs in ``tokens`` (token, n)."""
    n, out = len(SYMBOLS), [0] * len(SYMBOLS) ** 2
    codes = F.transform(F.split("token", ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    pairs = tokens.select("n", codes.alias("c")).select("n", F.explode(F.zip_with(F.expr("slice(c, 1, size(c) - 1)"), F.expr("slice(c, 2, size(c))"), lambda a, b: a * n + b)).alias("pair"))
    for pair, count in pairs.where("pair >= 0").groupBy("pair").agg(F.sum("n")).collect():  # at most one row a pair of symbols
        out[pair] = count
    return out


def _by_rule(spark: SparkSession, n: int, kinds: list[Column]) -> DataFrame:
    """``n`` tokens, of all kinds in turn; a kind is a column over ``id``."""
    pick = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        pick = F.when(F.col("id") % len(kinds) == i, k).otherwise(pick)
    return spark.range(n).select("id", pick.alias("token"))


def random_strings(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """Random strings, made by rule from digests: base 64 and 62, hexadecimal digits and base 36 of either case, and
    letters only. Every other one is cut to 12 to 31 symbols, as keys are.
    """
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    plain = F.base64(F.unhex(digest))
    alphanumeric, letters = F.translate(plain, "+/=", "xyz"), F.translate(plain, "0123456789+/=", "")
    kinds = [plain, F.translate(plain, "+/=", "-_"), F.translate(plain, "+/=", ""), digest, F.upper(digest), F.lower(alphanumeric), F.upper(alphanumeric), letters, F.lower(letters), F.upper(letters), F.substring(digest, 1, 40), F.substring(F.upper(digest), 1, 40), F.lower(letters)]
    # The number of kinds is odd, so both halves hold all of them.
    cut = F.when(F.col("id") % 2 == 1, F.lit(LEAST_LENGTH) + F.col("id").bitwiseAND(F.lit(62)).cast("int") % 20).otherwise(F.length("token"))
    return _by_rule(spark, n, kinds).select(F.substr("token", F.lit(1), cut).alias("token"), F.lit(1).cast("long").alias("n"))


def plain_numbers(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """Ordinary tokens without words, made by rule: card, phone and other numbers, dates and times, and ruled lines."""
    digits = F.translate(F.sha2(F.concat(F.lit("number "), F.col("id").cast("string")), 256), "abcdef", "")
    parts = lambda sep, *sizes: F.concat_ws(sep, *[F.substring(digits, 1 + sum(sizes[:i]), k) for i, k in enumerate(sizes)])
    at = F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(2**31)))
    day = F.date_format(at, "yyyy-MM-dd")
    numbers = [F.substring(digits, 1, k) for k in (12, 13, 16, 19)]
    numbers += [parts("-", 4, 4, 4, 4), F.concat(F.lit("+"), F.substring(digits, 1, 12)), F.concat(F.lit("+"), parts("-", 2, 3, 7)), parts("-", 3, 3, 4, 2), parts("/", 4, 4, 5), F.concat(F.lit("978-"), parts("-", 1, 2, 6, 1))]
    numbers += [F.concat(day, F.lit("/"), day), F.concat(day, F.date_format(at, "'T'HH")), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.date_format(at, "yyyy-MM-dd_HH-mm-ss"), F.date_format(at, "dd/MM/yyyy-HHmm"), F.date_format(at, "yyyyMMddHHmmss")]
    lines = [F.repeat(F.lit(c), 24) for c in "-=_+/"] + [F.lit("+-------+-------+"), F.lit("-=-=-=-=-=-=-")]
    return _by_rule(spark, n, numbers + lines).select("token", F.lit(1).cast("long").alias("n"))


def identifiers(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Ordinary identifiers: tokens of four or more symbols of about ``sample_docs`` documents, outside base spans and without digits in number, and how often each occurs (token, n)."""
    total = docs.count()
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20))
    some = docs.where(place < max(1, math.ceil(min(1.0, sample_docs / max(1, total)) * (1 << 20)))).select(F.col("text").cast("string").alias("text"))
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = some.select(F.explode(F.regexp_extract_all(cleaned, F.lit(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9_-]{3,}"), F.lit(0))).alias("token"))
    return words.where(~F.col("token").rlike("[0-9].*[0-9].*[0-9]")).groupBy("token").agg(F.count("*").alias("n"))


def written_otherwise(words: DataFrame) -> DataFrame:
    """Forms that words of a sample also take, for about a third of them: capitals, and joined as in paths and names."""
    w = F.col("token")
    forms = [F.upper(w), F.initcap(w), F.concat(w, F.initcap(w))] + [F.concat_ws(c, w, w) for c in "-_/+="]
    place, pick = F.pmod(F.xxhash64(w), F.lit(3 * len(forms))), F.lit(None).cast("string")
    for i, f in enumerate(forms):
        pick = F.when(place == i, f).otherwise(pick)
    return words.select(pick.alias("token"), "n").where("token IS NOT NULL")


def _ratios(random: DataFrame, ordinary: DataFrame) -> Ratio:
    """Both chains' ratio, add-one smoothed, without a threshold."""
    n = len(SYMBOLS)
    chains = []
    for counts in (_pair_counts(random), _pair_counts(ordinary)):
        rows = [counts[i * n : (i + 1) * n] for i in range(n)]
        chains.append([math.log((c + 1) / (sum(row) + n)) for row in rows for c in row])
    return Ratio(tuple(a - b for a, b in zip(*chains, strict=True)), 0.0)


def _low(random: DataFrame, ratio: Ratio) -> float:
    """The mean ratio that all but ``MISSED_SHARE`` of the random sample reach, cut to the least length, where scores scatter most."""
    return random.select(ratio.mean(F.substr("token", F.lit(1), F.lit(LEAST_LENGTH))).alias("s")).agg(F.percentile_approx("s", MISSED_SHARE, 10_000)).first()[0] or 0.0


def train(random: DataFrame, ordinary: DataFrame, doubtful: DataFrame) -> Ratio:
    """Fit both chains on labelled samples (token, n), and calibrate the threshold by both.

    ``doubtful`` tokens are ordinary ones with random strings among them, as a corpus has: those that score as the
    random sample does under a first fit without them are left out. The threshold lies midway between the mean ratio
    that all but ``FALSE_SHARE`` of the long ordinary tokens stay under and the one that all but ``MISSED_SHARE`` of the
    random sample reach; if these cross, it is the first, so that ordinary tokens stay unmarked.
    """
    first = _ratios(random, ordinary)
    ordinary = ordinary.unionByName(doubtful.where(first.mean(F.col("token")) < _low(random, first)))
    ratio = _ratios(random, ordinary)
    scores = ordinary.where(F.length("token") >= LEAST_LENGTH).select("n", ratio.mean(F.col("token")).alias("s"))
    high = scores.agg(F.percentile("s", 1 - FALSE_SHARE, F.col("n"))).first()[0] or 0.0
    return Ratio(ratio.pairs, max(high, (high + _low(random, ratio)) / 2))


def markov_spans(text: Column, ratio: Ratio) -> Column:
    """Spans of long tokens that are more like random strings than like identifiers."""
    return _spans(text, TOKEN, "markov", lambda s: ratio.mean(s["token"]) > ratio.threshold)


def all_spans(text: Column, ratio: Ratio) -> Column:
    """Structs (start, kind, end) of a text, by start, then kind: base spans, and the models' where they overlap none of these."""
    is_base = lambda s: s["kind"] < len(KINDS) - 1
    far = F.lit(2**31 - 1)

    def apart(rows: Column) -> Column:
        ends = _before(F.transform(rows, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.lit(0), F.greatest)
        starts = F.reverse(_before(F.transform(F.reverse(rows), lambda s: F.when(is_base(s), s["start"]).otherwise(far)), far, F.least))
        beside = F.arrays_zip(rows.alias("s"), ends.alias("ends"), starts.alias("starts"))
        return F.transform(F.filter(beside, lambda x: is_base(x["s"]) | ((x["ends"] <= x["s"]["start"]) & (x["starts"] >= x["s"]["end"]))), lambda x: x["s"])

    def merged(pair: Column) -> Column:
        both = _let(F.array_sort(F.concat(pair["base"], pair["more"])), apart)
        return F.when(F.size(pair["base"]) == 0, pair["more"]).when(F.size(pair["more"]) == 0, pair["base"]).otherwise(both)

    spans = _let(F.struct(base_spans(text).alias("base"), markov_spans(text, ratio).alias("more")), merged)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """All columns of ``docs`` and an array ``_spans`` of structs (start, kind, end), by start, then kind.

    ``kind`` counts in KINDS. Null and empty texts have no spans. Base spans are all there; a token of the models is
    left out where it overlaps one. Repeated rows are scanned alike. A column named ``_spans`` is replaced; all others
    are kept, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.drop("_spans").withColumn("_spans", all_spans(text, ratio))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """A text with its spans (by start) replaced by ``mark``; a span that begins inside the one before goes with it.

    The text is cut into chunks first, since a substring is looked for from the text's beginning on.
    """
    def between(chunks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        return F.when(b > a, F.substr(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), a - first * CHUNK + 1, b - a)).otherwise("")

    def written(chunks: Column) -> Column:
        reach = _before(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)
        rows = F.filter(F.zip_with(spans, reach, lambda s, r: F.struct(s["start"].alias("start"), r.alias("reach"))), lambda x: x["start"] >= x["reach"])
        head = F.transform(rows, lambda x: F.concat(between(chunks, x["reach"], x["start"]), F.lit(mark)))
        return F.concat(F.array_join(head, ""), between(chunks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), written)


def redact(docs: DataFrame, ratio: Ratio, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span's text replaced by ``mark`` and ``n_chars``, if there, counted anew; texts without spans
    are unchanged, null ones stay null, and so do all other columns, whatever their names.
    """
    found, written = _shared.free(docs, "_spans", "_written")
    text, spans = F.col("text").cast("string"), F.col(f"`{found}`")
    out = docs.withColumn(found, all_spans(F.coalesce(text, F.lit("")), ratio)).withColumn(written, F.when(F.size(spans) > 0, redacted(text, spans, mark)))
    fresh = F.col(f"`{written}`")
    changed = {"text": F.coalesce(fresh, text).cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length(fresh).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def learn(docs: DataFrame) -> Ratio:
    words = _shared.store(identifiers(docs), "identifiers")
    known = (F.length("token") < LEAST_LENGTH) | (F.col("n") >= RECURS)
    ordinary = words.where(known).unionByName(written_otherwise(words.where(known))).unionByName(plain_numbers(docs.sparkSession))
    return train(random_strings(docs.sparkSession), ordinary, words.where(~known))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn(docs))
    base = F.filter("_spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter(F.col("_spans"), lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))
