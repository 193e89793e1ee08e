"""Personal data by fixed patterns, and by contexts that are learnt from them; DataFrame operations only.

Fixed patterns find the base spans of every text. Their values are the seeds: in a graph of contexts (the word before a
mention, the two words before it, the words on both sides) and of the values that stand in them, a context's confidence for
a kind is the share of its distinct values that are of the kind, less what few values leave uncertain. Confident contexts
make values of a fitting form that stand in them members of the kind; such values then count for the other contexts they
stand in, and so on for some rounds. A mention without base span is reported when a confident context holds it.

Mentions are words with a digit or an at sign, and what follows them after single spaces if it starts with a digit. Only
they, their neighbours and spans travel; texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hot_join, release, stash

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: The contract's patterns. Those that could be tried from each place of one long run start where a run or the search starts,
#: and repetitions do not give back what no later part of the pattern could use, so every text takes time in proportion to it.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
WORD = r"\p{L}\p{N}._%+@()\-"
MENTION = rf"(?:\G|(?<![{WORD}]))[{WORD}&&[^0-9@]]*+[0-9@][{WORD}]*+(?:\x20[(+]?[0-9][{WORD}]*+)*+"
MARGIN = 48  # characters on either side of a mention in which its neighbours are sought
ROUNDS, LEAST = 3, 0.8
FORMS = ("before", "two before", "around")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def starts(gaps: Column, sizes: Column, block: int = 256) -> Column:
    """The starts of matches from the lengths of the gaps before them and of the matches themselves, summed by blocks so that
    the work stays near the number of matches."""
    step = F.zip_with(gaps, sizes, lambda g, s: g + s)

    def sums(values: Column) -> Column:
        """Exclusive running sums, and the total as the last element."""
        return F.aggregate(values, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def blocks(steps: Column) -> Column:
        edges = F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(steps), F.lit(block)))
        return F.transform(edges, lambda e: sums(F.slice(steps, e, block)))

    def joined(parts: Column) -> Column:
        bases = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(bases, lambda b: F.flatten(F.zip_with(parts, F.slice(b, 1, F.size(parts)), lambda p, base: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: v + base))))

    offsets = let(step, lambda s: let(blocks(s), joined))
    return F.zip_with(offsets, gaps, lambda o, g: o + g)


def matches(text: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches: structs of start (code points), value and the gap before."""
    anchored = rf"(?s)\G(.*?)({pattern})"
    gaps, values = F.regexp_extract_all(text, F.lit(anchored), F.lit(1)), F.regexp_extract_all(text, F.lit(anchored), F.lit(2))

    def placed(pair: Column) -> Column:
        at = starts(F.transform(pair["gaps"], F.length), F.transform(pair["values"], F.length))
        return F.arrays_zip(at.alias("start"), pair["values"].alias("value"), pair["gaps"].alias("gap"))

    return let(F.struct(gaps.alias("gaps"), values.alias("values")), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether digits pass the check that doubles every second one from the right."""
    doubled = "0246813579"

    def add(acc: Column, place: Column) -> Column:
        d = F.substring(number, place, F.lit(1)).cast("int")
        twice = F.substring(F.lit(doubled), d + 1, F.lit(1)).cast("int")
        return acc + F.when((F.length(number) - place) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        # long runs of digits are refused before they are summed
        return F.when(n.between(13, 19), luhn(digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}


def fitting(kind: str, value: Column) -> Column:
    """Whether a value without a base span has a form that the kind may take."""
    n = F.length(digits(value))
    if kind == "email":
        return value.rlike(r"[\p{L}\p{N}]@[\p{L}\p{N}]|[\p{L}\p{N}]\((?i:at)\)[\p{L}\p{N}]")
    if kind == "ip":
        return value.rlike(r"^[0-9]+(?:\.[0-9]+){2,}$")
    numeric = value.rlike(r"^[0-9().+\x20-]+$")
    return numeric & (n.between(12, 19) if kind == "card" else n.between(6, 15))


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (kind number, start, end) and mentions (start, value, seed, fits, left, right) of each document."""
    text = docs.withColumn("text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")

    def base(k: int, kind: str) -> Column:
        found = F.filter(matches("text", PATTERNS[kind]), lambda m: valid(kind, m["value"]))
        spans = F.transform(found, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end")))
        return F.when(F.col("text").rlike(HINTS[kind]), spans).otherwise(none)

    words = lambda s: F.filter(F.split(F.lower(s), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def mention(all_of: Column, m: Column, i: Column) -> Column:
        # what follows is the next gap; behind the last mention it is the rest of the text
        rest = F.substring("text", m["start"] + F.length(m["value"]) + 1, F.lit(MARGIN))
        after = F.when(i + 1 < F.size(all_of), F.left(F.get(all_of, i + 1)["gap"], F.lit(MARGIN))).otherwise(rest)
        seed = F.array_compact(F.array(*(F.when(is_seed(kind, m["value"]), F.lit(k)) for k, kind in enumerate(KINDS))))
        fits = F.array_compact(F.array(*(F.when(fitting(kind, m["value"]), F.lit(k)) for k, kind in enumerate(KINDS))))
        return F.struct(
            m["start"].alias("start"), m["value"].alias("value"), seed.alias("seed"), F.when(F.size(seed) == 0, fits).otherwise(F.array().cast("array<int>")).alias("fits"),
            words(F.right(m["gap"], F.lit(MARGIN))).alias("left"), words(after).alias("right"),
        )

    found = F.when(F.col("text").rlike("[0-9@]"), matches("text", MENTION))
    return text.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.concat(*(base(k, kind) for k, kind in enumerate(KINDS))).alias("base"),
        let(found, lambda all_of: F.transform(all_of, lambda m, i: mention(all_of, m, i))).alias("mentions"),
    )


def is_seed(kind: str, value: Column) -> Column:
    """Whether a valid base span of the kind lies in the value."""
    inside = F.regexp_extract_all(value, F.lit(f"({PATTERNS[kind]})"), F.lit(1))
    return F.exists(inside, lambda v: valid(kind, v))


def contexts(left: str, right: str) -> Column:
    """The contexts of a mention, each named by its form and words."""
    before, two = F.element_at(left, -1), F.array_join(F.slice(left, -2, 2), " ")
    return F.array_compact(F.array(
        F.when(F.size(left) >= 1, F.concat(F.lit(f"{FORMS[0]} "), before)),
        F.when(F.size(left) >= 2, F.concat(F.lit(f"{FORMS[1]} "), two)),
        F.when((F.size(left) >= 1) & (F.size(right) >= 1), F.concat(F.lit(f"{FORMS[2]} "), before, F.lit(" _ "), F.get(right, F.lit(0)))),
    ))


def confident_contexts(mentions: DataFrame, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """context, n (its distinct values) and for each kind conf0, ...: its confidence, or null below `least`.

    mentions has value, seed, fits, left and right. The confidence of n values of which s are of the kind is s / (n + 1); values
    found in confident contexts count for other contexts by the probability that at least one of theirs is right.
    """
    numbers = range(len(KINDS))
    edges = mentions.select(F.explode(contexts("left", "right")).alias("context"), F.md5(F.lower("value")).alias("value"), "seed", "fits")
    edges = stash(edges.groupBy("context", "value").agg(F.min("seed").alias("seed"), F.min("fits").alias("fits")), "edges")
    seeds = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.array_contains("seed", k).cast("double")).alias(f"s{k}") for k in numbers))
    seeds = stash(seeds, "seeds")
    open_ = edges.where(F.size("fits") > 0).select("context", "value", "fits")
    places = open_.groupBy("value").agg(F.count(F.lit(1)).alias("copies"))

    def confident(extra: DataFrame | None) -> DataFrame:
        rows = seeds if extra is None else seeds.join(extra.hint("merge"), "context", "left")
        conf = [(F.col(f"s{k}") + (F.lit(0.0) if extra is None else F.coalesce(f"e{k}", F.lit(0.0)))) / (F.col("n") + 1) for k in numbers]
        rows = rows.select("context", "n", *(F.when(conf[k] >= least, conf[k]).alias(f"conf{k}") for k in numbers))
        return stash(rows.where(F.coalesce(*(f"conf{k}" for k in numbers)).isNotNull()), "contexts")

    known, size = confident(None), 0
    for _ in range(rounds - 1):
        before, size = size, known.count()
        if size == before:
            break
        # a value belongs to a kind unless all its confident contexts are wrong
        held = hot_join(open_, known, ["context"], "n")
        miss = [F.sum(F.when(F.array_contains("fits", k), F.log(1 - F.col(f"conf{k}")))) for k in numbers]
        members = held.groupBy("value").agg(*((1 - F.exp(F.coalesce(miss[k], F.lit(0.0)))).alias(f"e{k}") for k in numbers))
        shared = hot_join(open_, members.join(places.hint("merge"), "value"), ["value"], "copies")
        wider = confident(shared.groupBy("context").agg(*(F.sum(f"e{k}").alias(f"e{k}") for k in numbers)))
        release(known)
        known = wider
    release(edges, seeds)
    return known


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, base and spans, arrays of kind (its number in KINDS), start and end (code points).

    base has what the fixed patterns find, spans these and what confident contexts add, by kind, then start. A null text counts
    as empty and has no spans; rows repeated with one id are returned each; in an empty table nothing is found. A mention whose
    value holds a base span adds nothing, whatever its context; where contexts fit several kinds, it is reported for each. Texts
    equal in all but their case give the same contexts. Other columns of docs are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    seen = stash(scanned(rows), "private")
    mentions = seen.select("row", F.inline("mentions"))
    known = confident_contexts(mentions.select("value", "seed", "fits", "left", "right"), rounds, least)
    asked = mentions.where(F.size("fits") > 0).select("row", "start", "value", "fits", F.explode(contexts("left", "right")).alias("context"))
    held = hot_join(asked, known, ["context"], "n")
    kinds = F.array_compact(F.array(*(F.when(F.array_contains("fits", k) & F.col(f"conf{k}").isNotNull(), F.lit(k)) for k in range(len(KINDS)))))
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}+(]*", 0))
    trail = F.length(F.regexp_extract(F.reverse("value"), r"^[^\p{L}\p{N}]*", 0))
    found = held.select("row", F.explode(kinds).alias("kind"), (F.col("start") + lead).alias("start"), (F.col("start") + F.length("value") - trail).alias("end"))
    found = found.distinct().groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return seen.select("row", "doc_id", "base").join(found.hint("merge"), "row", "left").select("doc_id", "base", spans.alias("spans"))


def private_digest(found: DataFrame) -> DataFrame:
    """doc_id, the base spans' number by kind, base_sha256 and spans as one string, from find_private's rows."""
    named = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(F.array_join(F.transform("base", shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )
