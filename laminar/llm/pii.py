"""Personal data: pattern rules, and identifiers found from bootstrapped contexts.

All of it is DataFrame operations. Rules find e-mail addresses, IP addresses, card and
phone numbers: a text's matches are marked by one regular-expression replacement, the
marked text is split, and positions are prefix sums of the parts' lengths, taken block by
block, so that a text costs time in proportion to its length however many matches it has.

Bootstrapping: rule matches and other tokens with a digit are instances; the two words before one
and the two words behind it are its lexical patterns (`#` stands for an instance among these
words, `^` and `$` for the text's ends; at least one of the two has a letter). Pattern-instance pairs are counted over the corpus. Seeds are the
rule matches, with score 1. Each round a pattern's confidence becomes the share of its
instances' score (smoothed by `DOUBT` unknown instances), its support the number of different
instances with a score of CONFIDENT or more, seeds or discovered ones; an instance's score becomes
1 - prod(1 - confidence) over its patterns with SUPPORT. So what one round discovers supports
further patterns in the next, up to `ROUNDS` times. The patterns with confidence
`CONFIDENT` and `SUPPORT` at the end mark the instances beside them, outside rule matches, as `context` spans.

Contract: null and empty texts have no span. Positions are code points, ends
exclusive. Repeated rows get equal results, counted as often as they occur. Extra
columns are ignored. An empty table gives an empty table. A text's spans are held in
one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

KINDS = ["email", "ip", "card", "phone", "context"]
ROUNDS, DOUBT, CONFIDENT, SUPPORT = 4, 1.0, 0.8, 5
#: Stands for a match's border; where a text has it, it is first replaced by OTHER, which no rule matches either.
MARK, OTHER = "", ""
#: Parts of a text whose lengths are summed up at a time.
BLOCK = 256

# Each pattern matches from the same places as the plain rule, but tries every run of
# characters once: possessive, and begun only where a run begins or a match has ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A rule match, or else a token with a digit.
INSTANCE = "|".join([EMAIL, PHONE, CARD, IP, r"(?<!\S)[^\s0-9]*+[0-9]\S*+"])


def marked(text: Column, pattern: str) -> Column:
    """Parts of the text; every second one is a match."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(items: Column, first: Column) -> Column:
    """first, first + items[0], ...: what comes before each item."""
    start = F.struct(first.alias("at"), F.expr("cast(array() as array<bigint>)").alias("got"))
    return F.aggregate(items, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["got"], acc["at"]).alias("got")), lambda acc: acc["got"])


def starts(parts: Column) -> Column:
    """Where each part begins. Within a block and over the blocks' sums, so that no long array grows item by item."""
    zero = F.lit(0).cast("long")

    def by_block(lengths: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK)))
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, running(F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, y: a + y)), zero), running)))

    return let(F.transform(parts, lambda x: F.char_length(x).cast("long")), by_block)


def each_match(text: Column, pattern: str, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(parts, starts, number) of each match, whose part is at 2 * number + 1; null without a match."""

    def over(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1)
        return F.when(F.size(parts) > 1, let(starts(parts), lambda at: F.transform(numbers, lambda k: make(parts, at, k))))

    return let(marked(text, pattern), over)


def spans(text: Column, pattern: str, kind: int, maybe: Column, good=None) -> Column:
    """Matches as (kind, start, end), those that `good` accepts."""
    empty = F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint>>)")

    def make(parts: Column, at: Column, k: Column) -> Column:
        match, start = F.get(parts, 2 * k + 1), F.get(at, 2 * k + 1)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(match)).alias("end"))
        return span if good is None else F.when(good(match), span)

    return F.when(maybe, F.coalesce(F.array_compact(each_match(text, pattern, make)), empty)).otherwise(empty)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def good_ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)


def good_card(match: Column) -> Column:
    """Luhn: from the right, every second digit counts double, less 9 beyond 9."""
    d = F.split(F.reverse(digits(match)), "")
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def good_phone(match: Column) -> Column:
    return F.length(digits(match)).between(8, 15)


def rule_spans(text: Column) -> Column:
    some = text.rlike("[0-9]")
    return F.concat(
        spans(text, EMAIL, 0, F.contains(text, F.lit("@"))),
        spans(text, IP, 1, some, good_ip),
        spans(text, CARD, 2, some, good_card),
        spans(text, PHONE, 3, F.contains(text, F.lit("+")), good_phone),
    )


def rule_match(part: Column) -> Column:
    """The personal datum in an instance; null if there is none."""
    by = lambda pattern: F.regexp_extract(part, pattern, 0)
    good = lambda m, check: (m != "") & check(m)
    email, ip, card, phone = by(EMAIL), by(IP), by(CARD), by(PHONE)
    return F.when(email != "", email).when(good(ip, good_ip), ip).when(good(card, good_card), card).when(good(phone, good_phone), phone)


def words_of(pieces: Column) -> Column:
    return F.filter(F.split(F.lower(F.array_join(pieces, " ")), r"\s+"), lambda w: w != "")


def instances(text: Column) -> Column:
    """Instances as (start, end, instance, seed, left, right); marks around a token don't belong to the instance."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,instance:string,seed:boolean,left:string,right:string>>)")
    last_two = lambda part: F.reverse(F.regexp_extract(F.reverse(part), r"^\s*+(\S*+\s*+\S*+)", 1))
    first_two = lambda part: F.regexp_extract(part, r"^\s*+(\S*+\s*+\S*+)", 1)
    hash_ = F.lit("#")

    def make(parts: Column, at: Column, k: Column) -> Column:
        part, start = F.get(parts, 2 * k + 1), F.get(at, 2 * k + 1)
        text_at = lambda j, words: words(F.get(parts, j))  # noqa: E731  null, and so left out, beyond the text
        before = F.array(text_at(2 * k - 4, last_two), F.when(k > 1, hash_), text_at(2 * k - 2, last_two), F.when(k > 0, hash_), text_at(2 * k, last_two))
        more = lambda j: F.when(2 * j + 1 < F.size(parts), hash_)
        behind = F.array(text_at(2 * k + 2, first_two), more(k + 1), text_at(2 * k + 4, first_two), more(k + 2), text_at(2 * k + 6, first_two))
        left = F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), words_of(before)), -2, 2)
        right = F.slice(F.concat(words_of(behind), F.array(F.lit("$"), F.lit("$"))), 1, 2)

        def named(match: Column) -> Column:
            core = F.coalesce(match, F.regexp_extract(part, r"[\p{L}0-9].*[\p{L}0-9]|[0-9]", 0))
            lead = F.when(match.isNull(), F.char_length(F.regexp_extract(part, r"^[^\p{L}0-9]*+", 0))).otherwise(0)
            return let(core, lambda c: F.struct((start + lead).alias("start"), (start + lead + F.char_length(c)).alias("end"), c.alias("instance"), match.isNotNull().alias("seed"), F.concat(F.lit("L "), F.array_join(left, " ")).alias("left"), F.concat(F.lit("R "), F.array_join(right, " ")).alias("right")))

        return let(rule_match(part), named)

    return F.when(text.rlike("[0-9@]"), F.coalesce(each_match(text, INSTANCE, make), empty)).otherwise(empty)


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, base spans, instances) of every row; the only pass over the texts."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, OTHER)
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), text.alias("__text"))
    return materialise(rows.select("__row", id_col, rule_spans(F.col("__text")).alias("base"), instances(F.col("__text")).alias("instances")), "pii")


def scored_patterns(pairs: DataFrame) -> DataFrame:
    """(pattern, confidence, support) from (pattern, instance, n, seed) pairs.

    Joins on pattern and on instance read tables, so Spark can split hot patterns.
    """
    seeds = materialise(pairs.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score")), "scores")
    score, rounds = seeds, 0
    while True:
        weighed = pairs.join(score, "instance")
        patterns = weighed.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + DOUBT)).alias("confidence"), F.count(F.when(F.col("score") >= CONFIDENT, 1)).alias("support"))
        patterns = materialise(patterns, "patterns")
        rounds += 1
        if rounds == ROUNDS:
            return patterns
        supported = patterns.filter(F.col("support") >= SUPPORT).select("pattern", F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))).alias("doubt"))
        told = pairs.join(supported, "pattern").groupBy("instance").agg((1 - F.exp(F.sum("doubt"))).alias("told"))
        score = materialise(seeds.join(told, "instance", "left").select("instance", F.greatest("score", F.coalesce("told", F.lit(0.0))).alias("score")), "scores")


def outside(new: DataFrame, rows: DataFrame) -> DataFrame:
    """The spans (__row, start, end) that meet no base span of their row."""
    base = rows.join(new.select("__row").distinct(), "__row", "left_semi").select("__row", F.explode("base").alias("b"))
    none = F.lit(None).cast("long")
    events = new.select("__row", F.col("end").alias("at"), "start", "end", none.alias("upto")).union(base.select("__row", "b.start", none, none, "b.end"))
    # Base spans that begin before the new one ends: does any of them reach beyond its start?
    before = W.partitionBy("__row").orderBy("at", F.col("start").isNull()).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("reach", F.max("upto").over(before)).filter(F.col("start").isNotNull() & (F.coalesce("reach", F.lit(-1)) <= F.col("start"))).select("__row", "start", "end")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, found (all spans) and spans (as text) of every row."""
    rows = found(docs, id_col, text_col)
    seen = rows.select("__row", F.explode("instances").alias("i")).select("__row", "i.start", "i.end", "i.instance", "i.seed", F.explode(F.array("i.left", "i.right")).alias("pattern"))
    seen = materialise(seen.filter(F.col("pattern").rlike(r"^[LR] .*\p{L}")), "instances")  # places without a word are no pattern
    pairs = materialise(seen.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "pairs")
    trusted = scored_patterns(pairs).filter((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT)).select("pattern")
    new = materialise(seen.filter(~F.col("seed")).join(trusted, "pattern", "left_semi").select("__row", "start", "end").distinct(), "discovered")
    span = F.struct(F.lit(4).alias("kind"), "start", "end")
    more = materialise(outside(new, rows).groupBy("__row").agg(F.collect_set(span).alias("more")), "contexts")
    names = F.array(*[F.lit(k) for k in KINDS])
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    joined = rows.join(more, "__row", "left")
    full = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return joined.select(id_col, *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), full.alias("found"), as_text(full).alias("spans"))
