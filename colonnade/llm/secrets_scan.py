"""Secrets: fixed forms, and character Markov models of random strings against ordinary identifiers.

Two first-order models are counted from labelled samples in the corpus itself: values within base matches, and
hexadecimal and base-64 digests made for the purpose, are random; long tokens of letters alone or digits alone, letters
joined by separators (as written and in capitals), and words and decimal numbers given here are ordinary. The form only labels samples: every token is
scored, by a model that learned from no token of its own fold, so none vouches for itself. A token is added where its
mean log-likelihood ratio reaches MIN_RATIO. Counting is a grouped sum over all candidates; the driver gets FOLDS
tables of ALPHABET squared numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import Scratch
from colonnade.llm.spans import SPANS, blanked, joined, let, matches, of_kind

KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""",
    # within a run of these characters the first match takes all, so shorter ones needn't be found to be dropped
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
MIN_VALUE, MIN_TOKEN, MIN_RATIO = 6, 16, 0.5
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}+"
#: Made samples of each form, so that the model of random strings never lacks data.
MADE = 500
#: ASCII; tokens hold a part of it.
ALPHABET = 128
#: Weight of a character's own frequency against its counts after another.
BACK_OFF = 1.0
#: Ordinary words, so that the model of ordinary tokens never lacks data either.
WORDS = """
    account address administration application architecture argument association attribute authentication available background
    boundary buffer calculation category certificate character collection command communication comparison condition connection
    consideration constant container context control conversion coordinate customer database declaration default definition
    department description development dictionary difference directory distribution document element environment error example
    exception execution expression extension feature filename foundation framework frequency function generation government
    handler hardware history implementation important independent index information initialization instance integer interface
    international introduction iterator keyboard language library listener location management maximum measurement member message
    method minimum modification network notification number object operation organization original output package password
    performance permission pointer position possible previous procedure processing production property protocol provider
    question reference registration relationship representation request requirement resource response result schedule section
    security sequence service session simulation software specification standard statement structure subscription successful
    system template temporary thread through transaction transformation transmission understanding university validation
    variable vector version visibility window workspace
""".split()
#: Parts of the tokens, by hash; each is scored by what the others teach.
FOLDS = 4


def base_spans(text: Column, kind: str) -> Column:
    found = matches(text, PATTERNS[kind])
    if kind == "assign":
        return F.filter(found, lambda m: F.length(F.regexp_extract(m["text"], PATTERNS[kind], 1)) >= MIN_VALUE)
    return found


def _is_ordinary(token: Column) -> Column:
    return token.rlike("^(?:[A-Za-z]++|[0-9]++|(?:[A-Z]?[a-z]++[_=/+-]*+)++)$")


def _fold(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(token)), F.lit(FOLDS)).cast("int")


def _made(spark: SparkSession) -> DataFrame:
    rows = spark.range(MADE).select(F.md5(F.col("id").cast("string")).alias("hex"))
    random = rows.select(F.explode(F.array(F.col("hex"), F.regexp_replace(F.base64(F.unhex("hex")), "=", ""))).alias("token"), F.lit(True).alias("random"))
    words = [w + sep + v for sep in ("", "_", "-") for w, v in zip(WORDS, WORDS[1:] + WORDS[:1], strict=True)]
    words += [w.title() + v.title() for w, v in zip(WORDS, WORDS[7:] + WORDS[:7], strict=True)]
    random = random.unionByName(spark.createDataFrame([(w, False) for w in words], "token string, random boolean"))
    return random.unionByName(rows.select(F.lpad(F.conv(F.substring("hex", 1, 15), 16, 10), 18, "0").alias("token"), F.lit(False).alias("random")))


def ratio_table(samples: DataFrame) -> list[float]:
    """samples (token, random) -> for each fold and pair of characters, by (fold * ALPHABET + first) * ALPHABET + second, the log
    ratio of its probabilities after the first; ordinary samples of the fold are left out. Both models back off to their
    frequencies of the second character alone."""
    chars = F.split("token", "")
    pairs = samples.select("random", _fold(F.col("token")).alias("fold"), F.explode(let(chars, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.ascii(F.get(c, i - 1)) * ALPHABET + F.ascii(F.get(c, i))))).alias("pair"))
    counts = np.zeros((2, FOLDS, ALPHABET, ALPHABET))
    for r in pairs.groupBy("random", "fold", "pair").agg(F.count("*").alias("n")).collect():  # at most 2 * FOLDS * ALPHABET ** 2 rows
        counts[int(r.random), r.fold, r.pair // ALPHABET, r.pair % ALPHABET] = r.n

    def after(seen: np.ndarray) -> np.ndarray:
        alone = seen.sum(axis=0) + 0.5
        return np.log((seen + BACK_OFF * alone / alone.sum()) / (seen.sum(axis=1, keepdims=True) + BACK_OFF))

    ordinary, random = counts[0].sum(axis=0) - counts[0], after(counts[1].sum(axis=0))
    return np.stack([random - after(x) for x in ordinary]).ravel().tolist()


def mean_ratio(token: Column, table: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's pairs of characters, by its fold's part of the table."""
    values = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")

    def over(chars: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            return total + F.get(values, (_fold(token) * ALPHABET + F.ascii(F.get(chars, i - 1))) * ALPHABET + F.ascii(F.get(chars, i)))

        return F.aggregate(F.sequence(F.lit(1), F.size(chars) - 1), F.lit(0.0), add) / (F.size(chars) - 1)

    return let(F.split(token, ""), over)


def find(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """docs (doc_id, text) -> a row per row: doc_id, k1, k2, base (spans), spans (base and added), by start, then kind.

    Spans are (kind, start, end) in code points, end exclusive; of an assignment the whole match. Null and empty texts have none. Added
    spans, of kind random, never overlap a base span. Rows that repeat whole share k1 and k2. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    found = rows.withColumns({k: base_spans(text, k) for k in PATTERNS})
    found = found.withColumn("base", F.concat(*(of_kind(k, F.col(k)) for k in PATTERNS)))
    values = F.concat(F.transform("assign", lambda m: F.regexp_extract(m["text"], PATTERNS["assign"], 1)), *(F.transform(k, lambda m: m["text"]) for k in ("access", "hex")))
    free = matches(blanked(text, F.col("base")), TOKEN)
    table = scratch.write(found.select("doc_id", "k1", "k2", "base", F.array_distinct(values).alias("values"), free.alias("tokens")), "base")
    tokens = table.select("k1", "k2", F.explode("tokens").alias("t")).select("k1", "k2", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.text").alias("token"))
    random = table.select(F.explode("values").alias("token"), F.lit(True).alias("random")).filter(~_is_ordinary(F.col("token")) & F.col("token").rlike(f"^[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}$"))
    ordinary = tokens.filter(_is_ordinary(F.col("token"))).select("token", F.lit(False).alias("random"))
    capitals = ordinary.withColumn("token", F.upper("token"))
    ratios = ratio_table(random.unionByName(_made(spark)).unionByName(ordinary).unionByName(capitals))
    marked = tokens.filter(mean_ratio(F.col("token"), ratios) >= MIN_RATIO)
    added = marked.groupBy("k1", "k2").agg(F.collect_set(F.struct(F.lit("random").alias("kind"), "start", "end")).alias("added"))
    order = F.array(*(F.lit(k) for k in KINDS))

    def ranked(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    none = F.array().cast(SPANS)
    merged = table.select("doc_id", "k1", "k2", "base").join(added, ["k1", "k2"], "left")
    return merged.select("doc_id", "k1", "k2", ranked(F.col("base")).alias("base"), ranked(F.concat("base", F.coalesce("added", none))).alias("spans"))


__all__ = ["KINDS", "base_spans", "find", "joined", "mean_ratio", "ratio_table"]
