"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are identifiers that their own form proves: e-mail and IP addresses, card and phone numbers.  The words around
them are patterns.  Patterns and the identifier-like strings they surround make a graph: a pattern is trusted as far as
what it surrounds is, a string as far as its patterns are; both are scored in turns.  Strings of a kind's looser form
beside a trusted pattern are found, though no seed form matches them: numbers without a country code, addresses without
a domain, groups of digits parted otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .tables import read

# The kinds in order, and the forms of seeds.  The forms are written so that a search never goes back over
# a run of letters or digits; what they match is the same as without look-behind and possessive repeats.
KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must hold for a form to match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# Strings that look like an identifier: a word with @, a row of digit groups, or else a word with a digit.
_EDGE = r"\s<>(){}\[\],;:\"'@"
MENTION = (
    rf"(?<![^{_EDGE}])[^{_EDGE}]++@[^{_EDGE}]*[^{_EDGE}.!?]"
    r"|(?<![0-9A-Za-z_])[+(]?[0-9](?:[ .()-]{0,2}[0-9])*+(?![0-9A-Za-z_])"
    r"|(?<![0-9A-Za-z_])[A-Za-z_]*+[0-9][0-9A-Za-z_]*+"
)
NUMERIC = "^[+(]?[0-9][0-9 .()-]*$"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
# Characters on each side of a string in which the words of its patterns are looked for.
REACH = 64

ROUNDS = 3
# A pattern is trusted from this share of trusted strings among all different ones it surrounds, one more that is not
# added; so it takes LEAST of them at least.  A string is found from the score ACCEPT.
TRUST = 0.8
LEAST = 4
ACCEPT = 0.8
# What a string of the loose form counts among all while nothing speaks for it; one of no such form counts whole.
DOUBT = 0.25
# No pattern proves more than this.
CERTAIN = 0.999


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Whether the digits of a text pass the check sum."""
    digits = F.regexp_extract_all(F.reverse(text), F.lit("[0-9]"), F.lit(0))
    counted = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.translate(d, "0123456789", "0246813579")).otherwise(d).cast("int"))
    return F.aggregate(counted, F.lit(0), lambda total, digit: total + digit) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """Whether a match of a kind's form is one of the kind."""
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _loose(kind: str, text: Column) -> Column:
    """Whether a string could be one of a kind though it has not its form."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "ip":
        return text.rlike(rf"^{PART}(?:[ .-]{{1,2}}{PART}){{3}}$")
    if kind == "card":
        return text.rlike(NUMERIC) & _valid("card", text)
    return text.rlike(NUMERIC) & F.length(_digits(text)).between(7, 15)


def _pieces(kind: str, form: str, text: Column, reach: int = 0) -> Column:
    """All matches of a form in order, and the end: the length of the gap before each, and its text near both borders."""
    def piece(gap: Column, match: Column) -> Column:
        near = (F.right(gap, F.lit(reach)), F.left(gap, F.lit(reach))) if reach else (F.lit(None).cast("string"),) * 2
        return F.struct(F.char_length(gap).alias("gap"), match.alias("match"), near[0].alias("left"), near[1].alias("opening"))

    found = F.zip_with(F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0)), piece)
    return F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"),
                                                    x["match"].alias("match"), x["left"].alias("left"), x["opening"].alias("opening")))


def _items(text: Column) -> Column:
    """Matches of all forms, and (kind ``""``) the strings that look like an identifier."""
    arrays = [F.when(text.rlike(NEEDS[kind]), _pieces(kind, FORMS[kind], text)) for kind in KINDS]
    arrays.append(_pieces("", MENTION, text, REACH))
    return F.when(text.rlike("[0-9@]"), F.flatten(F.array_compact(F.array(*arrays))))


def _placed(found: DataFrame) -> DataFrame:
    """One row per match with ``start`` and ``end`` in code points, from the lengths of gaps and matches before it."""
    order = Window.partitionBy("rid", "kind").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.char_length("match"), F.lit(0))
    end = F.sum(F.col("gap") + size).over(so_far)
    return found.select("rid", F.inline("items")).select(
        "rid", "kind", (end - size).alias("start"), end.alias("end"), "match", "left", F.lead("opening").over(order).alias("right")
    ).where("match IS NOT NULL")


def _patterns(left: Column, right: Column) -> Column:
    """The two words before, the words around, and the two words after; runs of digits count as one."""
    words = lambda text: F.regexp_extract_all(F.regexp_replace(F.lower(text), "[0-9]+", "0"), F.lit(TOKEN), F.lit(0))
    before, after = F.reverse(words(left)), words(right)
    return F.array_compact(F.array(
        F.when(F.size(before) >= 2, F.concat(F.lit("l "), F.get(before, 1), F.lit(" "), F.get(before, 0))),
        F.when((F.size(before) >= 1) & (F.size(after) >= 1), F.concat(F.lit("m "), F.get(before, 0), F.lit(" "), F.get(after, 0))),
        F.when(F.size(after) >= 2, F.concat(F.lit("r "), F.get(after, 0), F.lit(" "), F.get(after, 1))),
    ))


def mentions(placed: DataFrame) -> DataFrame:
    """Identifier-like strings: ``rid``, ``start``, ``end``, ``string``, ``traits`` (kind, seed) and ``patterns``.

    A string that holds a valid match of a kind's form is a seed of that kind; one that is no seed at all belongs to the
    kinds whose loose form it has.
    """
    match = F.col("match")
    holds = {k: F.regexp_extract(match, FORMS[k], 0) for k in KINDS}
    seeds = {k: (holds[k] != "") & _valid(k, holds[k]) for k in KINDS}
    trait = lambda kind, seed: F.struct(F.lit(kind).alias("kind"), F.lit(seed).alias("seed"))
    as_seeds = F.array_compact(F.array(*[F.when(seeds[k], trait(k, True)) for k in KINDS]))
    as_loose = F.array_compact(F.array(*[F.when(_loose(k, match), trait(k, False)) for k in KINDS]))
    return placed.where("kind = ''").select(
        "rid", "start", "end", F.lower(match).alias("string"),
        F.when(F.size(as_seeds) > 0, as_seeds).otherwise(as_loose).alias("traits"), _patterns(F.col("left"), F.col("right")).alias("patterns"),
    )


def trusted(seen: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (``kind``, ``pattern``) and found strings (``kind``, ``string``), by scoring the graph in turns.

    A link stands for a pattern around a string anywhere; how often counts nothing, so a line that many documents share
    proves no more than one.  Every string with a digit or ``@`` that a pattern surrounds counts against it unless it is
    of the kind, so words that stand before anything prove nothing.
    """
    links = materialise(
        seen.select("string", "traits", F.explode("patterns").alias("pattern")).groupBy("pattern", "string").agg(F.first("traits").alias("traits")),
        "pii-links",
    )
    around = links.groupBy("pattern").agg(F.count("*").alias("n"))
    of_kind = links.select("pattern", "string", F.inline("traits"))
    enough = of_kind.groupBy("kind", "pattern").agg(F.count("*").alias("of_kind")).where(F.col("of_kind") >= LEAST).join(around, "pattern")
    # What can never be trusted, as too few strings of the kind stand there or too many others, leaves at once.
    enough = enough.where(F.col("of_kind") / (F.col("n") + 1) >= TRUST).select("kind", "pattern", "n")
    graph = materialise(of_kind.join(enough, ["kind", "pattern"]).withColumn("score", F.col("seed").cast("double")), "pii-graph")
    for turn in range(rounds):
        among = F.first("n") - F.count("*") + F.sum(DOUBT + (1 - DOUBT) * F.col("score")) + 1
        share = F.sum("score") / among
        patterns = graph.groupBy("kind", "pattern").agg(share.alias("share")).where(F.col("share") >= TRUST)
        patterns = materialise(patterns, "pii-patterns")
        doubt = F.exp(F.sum(F.log1p(-F.least("share", F.lit(CERTAIN)))))
        strings = graph.where("NOT seed").join(patterns, ["kind", "pattern"]).groupBy("kind", "string").agg((1 - doubt).alias("now"))
        strings = materialise(strings, "pii-strings")
        if turn + 1 < rounds:
            graph = materialise(
                graph.join(strings, ["kind", "string"], "left")
                .withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("now", F.lit(0.0)))).drop("now"), "pii-graph"
            )
    return patterns.select("kind", "pattern"), strings.where(F.col("now") >= ACCEPT).select("kind", "string")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``id_col`` and ``spans`` of every row: an array of ``start``, ``kind`` (its place in KINDS), ``end``, ``learned``.

    Places are code points, ends exclusive; spans are in order of start, then kind.  Those of a kind never overlap: what
    its form proves stays, what the patterns find (``learned``) is left out where it would meet one.  Null and empty texts
    have no spans; repeated rows have the same, each its own row.  Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = materialise(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), _items(text).alias("items")), "pii-items"
    )
    placed = materialise(_placed(found.where("items IS NOT NULL")), "pii-placed")
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    proven = F.coalesce(*[F.when(F.col("kind") == k, _valid(k, F.col("match"))) for k in KINDS])
    base = placed.where("kind <> ''").where(proven).select("rid", "kind", "start", "end", F.lit(False).alias("learned"))
    seen = materialise(mentions(placed), "pii-mentions")
    patterns, strings = trusted(seen, rounds)
    learned = (
        seen.select("rid", "start", "end", "string", F.explode("patterns").alias("pattern"), "traits")
        .select("rid", "start", "end", "string", "pattern", F.inline("traits")).where("NOT seed")
        .join(patterns, ["kind", "pattern"]).join(strings, ["kind", "string"])
        .select("rid", "kind", "start", "end", F.lit(True).alias("learned")).distinct()
    )
    order = Window.partitionBy("rid", "kind").orderBy("start")
    before = F.max(F.when(~F.col("learned"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(~F.col("learned"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    spans = (
        base.unionByName(learned).withColumn("free", free).where("NOT learned OR free")
        .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", number.alias("kind"), "end", "learned"))).alias("spans"))
    )
    none = F.expr("array()").cast("array<struct<start:bigint,kind:int,end:bigint,learned:boolean>>")
    return found.select("rid", "id").join(spans, "rid", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def _written(spans: Column) -> Column:
    name = lambda span: F.get(F.array(*map(F.lit, KINDS)), span["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the spans that the forms prove, and all spans, learned ones too."""
    found = personal_data(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["learned"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
    return found.select(
        "doc_id", *[number(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
    )
