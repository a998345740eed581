"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame operations only.

Seeds are what the base patterns find (emails, IP and card numbers, phone
numbers) and strings of high entropy. Every identifier-like token has lexical
patterns: the word and signs before it, and its upper-case prefix. Patterns
and token values form a graph. Scores pass along it for some rounds: a
pattern's confidence is the share of score among its values, a value that is
no seed takes the best confidence of its patterns. Patterns that stay
confident and have enough different values mark all their tokens, seen before
or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import packed
from tessera.session import cut_lineage

# Fixed base patterns. Possessive quantifiers and the lookbehinds leave the
# matches as they are and keep the search linear: inside a run of characters
# of the first class, a match would already have begun at the run's start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")

# Production parameters.
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{4,}+"
SEED_TOKEN = r"^(?=(?:.*?[0-9]){3})(?=.*[A-Za-z])(?:[0-9a-f]{16,}|[A-Z0-9]{16,})$"
LEFT_CHARS = 32
LEFT = r"([\p{L}_]{2,24})(\s{0,2}[=:#(\"']{0,2}\s?[\"']?)$"
PREFIX = r"^([A-Z]{3,5})[A-Z0-9-]*$"
ROUNDS = 3
CONFIDENCE = 0.7
SUPPORT = 3
PRIOR = 1.0

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """The check digit rule: from the right, every second digit doubled, minus 9 above 9; the sum ends in 0."""
    double = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    return F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 1, double(d)).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def _small_parts(value: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return (F.char_length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def _found(text: Column, pattern: str, kind: int, guard: Column, keep=None) -> Column:
    """Spans (code points) of the leftmost non-overlapping matches of ``pattern``; failing ones are dropped afterwards.

    The pieces between the matches give the offsets: matches and pieces come
    from the same pattern, so they alternate.
    """
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                       lambda m, p: F.struct(m.alias("m"), p.alias("p")))

    def extend(a, x):
        start = a["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("value"))
        return F.when(x["m"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    spans = F.aggregate(pairs, zero, extend, lambda a: a["out"])
    if keep is not None:
        spans = F.filter(spans, lambda s: keep(s["value"]))
    return F.when(guard, spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base matches, sorted by start and kind."""
    n_digits = lambda v: F.char_length(_digits(v))
    return F.array_sort(F.concat(
        _found(text, EMAIL, 0, F.contains(text, F.lit("@"))),
        _found(text, IP, 1, text.rlike(r"[0-9]\.[0-9]"), _small_parts),
        _found(text, CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
               lambda v: (n_digits(v) >= 12) & (n_digits(v) <= 19) & _luhn(v)),
        _found(text, PHONE, 3, F.contains(text, F.lit("+")), lambda v: (n_digits(v) >= 9) & (n_digits(v) <= 15))))


def _patterns(left: Column, value: Column) -> Column:
    """Lexical patterns of a token: what stands before it, and its prefix."""
    word, signs = F.regexp_extract(left, LEFT, 1), F.regexp_extract(left, LEFT, 2)
    prefix = F.regexp_extract(value, PREFIX, 1)
    before = F.when(word != "", F.concat(F.lit("left:"), F.lower(word), F.regexp_replace(signs, r"\s+", " ")))
    return F.filter(F.array(before, F.when(prefix != "", F.concat(F.lit("prefix:"), prefix))), lambda p: p.isNotNull())


def pattern_confidence(edges: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR) -> DataFrame:
    """(pattern, confidence, support) from the graph (pattern, value, seed).

    ``support``: values of the pattern that are seeds. Edges are distinct, so
    a value that occurs very often counts once for a pattern.
    """
    graph = cut_lineage(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-graph")
    scores = graph.select("pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score"))
    for k in range(rounds):
        patterns = scores.groupBy("pattern").agg((F.sum("score") / (F.count("*") + prior)).alias("confidence"),
                                                 F.count_if("seed").alias("support"))
        patterns = cut_lineage(patterns, "pii-patterns")
        if k + 1 < rounds:
            held = graph.join(patterns, "pattern")
            best = held.groupBy("value").agg(F.max("confidence").alias("best"))
            scores = graph.join(best, "value").select("pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("best")).alias("score"))
    return patterns


def find_personal_data(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE,
                       support: int = SUPPORT, keep: list[str] | None = None) -> DataFrame:
    """Rows ``doc`` (the columns ``keep``, by default all), ``base`` and ``spans``: arrays of (start, kind, end, value).

    ``kind`` is an index into KINDS; offsets are code points, the end
    exclusive. ``spans`` holds the base spans and the tokens of confident
    patterns that overlap none of them. A null text is empty. Repeated rows
    are handled one by one; an empty table gives no rows. With no seeds, no
    pattern is confident.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs
    rows = docs.select(packed(kept).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("base", base_spans(F.col("t")))
    tokens = _found(F.col("t"), TOKEN, 4, F.col("t").rlike("[0-9]"))
    rows = rows.withColumn("tokens", F.filter(tokens, lambda s: ~F.exists(
        "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))

    def told(s: Column) -> Column:
        low = F.greatest(s["start"] - LEFT_CHARS, F.lit(0))
        left = F.substring(F.col("t"), low + 1, s["start"] - low)
        return F.struct(s["start"], s["kind"], s["end"], s["value"], _patterns(left, s["value"]).alias("patterns"))

    rows = rows.select("doc", "base", F.transform("tokens", told).alias("tokens"), F.transform("base", told).alias("seen"),
                       F.monotonically_increasing_id().alias("row"))
    rows = cut_lineage(rows, "pii-found")
    both = rows.select("row", F.explode(F.concat("seen", "tokens")).alias("s"))
    edges = both.select(F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"),
                        ((F.col("s.kind") < 4) | F.col("s.value").rlike(SEED_TOKEN)).alias("seed"))
    accepted = pattern_confidence(edges, rounds).filter((F.col("confidence") >= confidence) & (F.col("support") >= support)).select("pattern")
    accepted = cut_lineage(accepted, "pii-accepted")
    own = rows.select("row", F.explode("tokens").alias("s"))
    own = own.select("row", F.struct("s.start", "s.kind", "s.end", "s.value").alias("s"), F.explode("s.patterns").alias("pattern"))
    added = (own.join(accepted, "pattern", "left_semi").groupBy("row").agg(F.collect_set("s").alias("added")))
    out = rows.join(added, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPAN))))
    return out.select("doc", "base", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
