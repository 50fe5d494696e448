"""Personal data: fixed forms as seeds, and bootstrapped contextual extraction from them.

The seeds' contexts are lexical patterns: the word before each, the two words before it, and the words on both sides.
Patterns and the instances they stand at form a graph, scored in rounds: a pattern by the share of known instances among
all it stands at, an instance by its patterns together. Patterns that reach MIN_CONFIDENCE with MIN_SUPPORT distinct known
instances add what they stand at, as far as it has the loose form of their kind. All of it is DataFrame work; the graph
stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import Scratch, neutral
from colonnade.llm.spans import SPANS, blanked, joined, let, matches, of_kind, replaced

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT = 3, 0.8, 5
#: The contract's forms; possessive where nothing that follows could use what is given back, and email tried at the
#: start of a run of its characters or where the last match ended, so that long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What any match of a kind holds; texts without it aren't searched.
LIKELY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": "+"}
#: Words that may be identifiers: they hold a digit or an at sign.
MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What may close a sentence or bracket after a mention, and isn't part of it.
CLOSING = r"""[.,;:!?)\]}>'"]"""
_END = rf"(?={CLOSING}*+(?:\s|$))"
#: Numbers that may be of a kind and run over several words; one word alone where it is long enough.
RUNS = {
    "phone": rf"(?<!\S)(?:[+(]{{0,2}}[0-9](?:[().-]{{0,2}}[0-9]){{6,14}}{_END}|[+(]{{0,2}}[0-9](?:(?:[\x20.-]|\x20?\(|\)[\x20.-]?)?[0-9]){{6,14}}(?![0-9]))",
    "card": rf"(?<!\S)(?:[0-9](?:[.-]?[0-9]){{11,18}}{_END}|[0-9](?:[\x20.-]?[0-9]){{11,18}}(?![0-9]))",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(text, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) > 3) | (F.lpad(q, 3, "0") > "255")))
    if kind == "card":
        return let(_digits(text), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    likely = text.contains(LIKELY[kind]) if len(LIKELY[kind]) == 1 else text.rlike(LIKELY[kind])
    return F.filter(matches(text, PATTERNS[kind], likely=likely), lambda m: _valid(kind, m["text"]))


def _loose(kind: Column, text: Column) -> Column:
    """Whether a mention could be of a kind, judged loosely."""
    digits = F.length(_digits(text))
    return (
        F.when(kind == "email", text.rlike("(?i)^[^@]+(?:@|[(\\[]at[)\\]])[^@]+$"))
        .when(kind == "ip", text.rlike(r"^[0-9]{1,3}[.:][0-9]{1,3}[.:][0-9]{1,3}"))
        .when(kind == "card", digits.between(12, 19) & ~text.contains("@"))
        .otherwise(digits.between(7, 15) & text.rlike(r"^[+(]?[0-9][0-9().-]*[0-9]$"))
    )


def _patterns(text: Column, start: Column, end: Column) -> Column:
    """A place's contexts, in lower case: "a _", "a b _" and "b _ c"; those that a text's ends or long words cut are left out."""
    before = F.lower(F.substring(text, F.greatest(start - 60, F.lit(0)) + 1, F.least(start, F.lit(60))))
    after = F.lower(F.regexp_extract(F.substring(text, end + 1, F.lit(40)), rf"^{CLOSING}*+\s+(\S++)(?=\s|$)", 1))

    def all_three(near: Column) -> Column:
        one, two = F.regexp_extract(near, r"(\S+)\s+$", 1), F.regexp_extract(near, r"(\S+\s+\S+)\s+$", 1)
        longer = F.when(two != "", F.concat(F.regexp_replace(two, r"\s+", " "), F.lit(" _")))
        both = F.when((one != "") & (after != ""), F.concat(one, F.lit(" _ "), after))
        return F.array_compact(F.array(F.when(one != "", F.concat(one, F.lit(" _"))), longer, both))

    return let(before, all_three)


def _contexts(kind: str, text: Column, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("value"), _patterns(text, m["start"], m["end"]).alias("patterns")))


def _trimmed(found: Column) -> Column:
    """Mentions without what closes the sentence after them."""
    cut = lambda m, t: F.struct(m["start"].alias("start"), (m["start"] + F.length(t)).alias("end"), t.alias("text"))
    return F.transform(found, lambda m: let(F.regexp_replace(m["text"], f"{CLOSING}+$", ""), lambda t: cut(m, t)))


def _mentions(text: Column, base: Column) -> Column:
    """What may be of a kind, outside base spans, with its context; what is found as a word and as a run is there once."""

    def all_kinds(free: Column) -> Column:
        words = _trimmed(matches(free, MENTION, likely=text.rlike("[0-9@]")))
        of_loose_form = lambda ws, kind: F.filter(ws, lambda m: _loose(F.lit(kind), m["text"]))
        by_word = let(words, lambda ws: F.concat(*(_contexts(k, text, of_loose_form(ws, k)) for k in KINDS)))
        runs = (_contexts(k, text, matches(free, pattern, likely=text.rlike("[0-9]"))) for k, pattern in RUNS.items())
        return F.array_distinct(F.concat(by_word, *runs))

    return let(blanked(text, base), all_kinds)


def _graph_scores(seeds: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (kind, pattern, value, n), seeds (kind, value) -> accepted (kind, pattern, value)."""
    known = seeds.select("kind", "value").distinct().withColumn("score", F.lit(1.0))
    patterns = None
    for k in range(ROUNDS):
        weighed = edges.join(known, ["kind", "value"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        patterns = weighed.groupBy("kind", "pattern").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("trust"), F.sum((F.col("score") >= MIN_CONFIDENCE).cast("int")).alias("support"))
        patterns = scratch.write(patterns.filter((F.col("trust") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT)), f"patterns{k}")
        if k + 1 < ROUNDS:
            doubt = edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.99)))))).alias("score"))
            both = known.filter("score = 1").unionByName(doubt).groupBy("kind", "value").agg(F.max("score").alias("score"))
            known = scratch.write(both, f"known{k}")
    return edges.join(patterns.select("kind", "pattern"), ["kind", "pattern"]).select("kind", "pattern", "value")


def find(docs: DataFrame, name: str = "pii") -> DataFrame:
    """docs (doc_id, text) -> a row per row: doc_id, k1, k2, base (spans), spans (base and added), by kind, then start.

    Spans are (kind, start, end) in code points, end exclusive. Null and empty texts have none. Added spans never
    overlap a base span. k1 and k2 are hashes of id and text; rows that repeat whole share them. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, name)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    found = rows.withColumns({k: base_spans(text, k) for k in KINDS})
    base = found.withColumn("base", F.concat(*(of_kind(k, F.col(k)) for k in KINDS)))
    kept = base.select(
        "doc_id",
        "k1",
        "k2",
        "base",
        F.concat(*(_contexts(k, text, F.col(k)) for k in KINDS)).alias("seeds"),
        _mentions(text, F.col("base")).alias("others"),
    )
    table = scratch.write(kept, "base")
    fields = ("kind", "start", "end", "value")
    seeds = table.select(F.explode("seeds").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"))
    loose = table.select("k1", "k2", F.explode("others").alias("o")).select("k1", "k2", *(f"o.{f}" for f in fields), F.explode("o.patterns").alias("pattern"))
    loose = scratch.write(loose, "loose")
    edges = scratch.write(seeds.select("kind", "pattern", "value").unionByName(loose.select("kind", "pattern", "value")).groupBy("kind", "pattern", "value").agg(F.count("*").alias("n")), "edges")
    accepted = _graph_scores(seeds, edges, scratch)
    spotted = loose.join(accepted, ["kind", "pattern", "value"]).select("k1", "k2", F.struct("kind", "start", "end").alias("s"))
    added = spotted.groupBy("k1", "k2").agg(F.collect_set("s").alias("added"))
    order = F.array(*(F.lit(k) for k in KINDS))
    ranked = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast(SPANS)
    merged = table.select("doc_id", "k1", "k2", "base").join(added, ["k1", "k2"], "left")
    return merged.select("doc_id", "k1", "k2", "base", ranked(F.concat("base", F.coalesce("added", none))).alias("spans"))


def counts(spans: str = "base") -> dict[str, Column]:
    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return {f"n_{k}": count(k) for k in KINDS}


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in angle brackets; columns are those of docs.

    Null texts stay null; texts without a span stay as they are.
    """
    frame, restored = neutral(docs)
    found = find(frame, "pii-redact").select("k1", "k2", "spans").filter("size(spans) > 0").dropDuplicates(["k1", "k2"])
    keyed = frame.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1))})
    marked = keyed.join(found, ["k1", "k2"], "left")
    return restored(marked.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("spans"), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">"))))))


__all__ = ["KINDS", "base_spans", "counts", "find", "joined", "redact"]
