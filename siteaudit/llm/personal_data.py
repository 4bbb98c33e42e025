"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what the base patterns (email, ip, card, phone) find, and strings of a key's shape (``secret``: at least ``KEY_LENGTH``
letters and digits in one run, ``KEY_MIX`` of each). The words around a seed, in small letters and with digits as 0, are its
contexts: the last one, two and three words to its left, and the last two with the one to its right. Words to the left count from
the match before. Contexts and the strings that stand in them form a graph, counted over all documents. In each
of ``ROUNDS`` rounds a context is scored for a kind by the share of the distinct strings in it that are held to be of that
kind, and an unknown string (identifier-like, in no base span) by the contexts that it stands in, as 1 - product of
(1 - score). Contexts with at least ``SUPPORT`` distinct seeds and a score of ``CONFIDENT`` or more then give the unknown strings in them
their kind: spans beside the base ones. A string of a key's shape is a span only where such a context says so too, as
digests and serial numbers have that shape as well.

Spans are in code points, end exclusive. Per kind, base matches are the leftmost that don't overlap; those that fail their test
(ip part over 255, Luhn, number of digits) are dropped. The expressions are written so that no text makes them backtrack
over it again and again or recurse: possessive runs that begin only where a run begins.

Nulls and others: a null text is empty and has no spans; each row keeps a row, also rows that repeat a doc_id; an empty table
gives none. Of several kinds for one string the best score, then the first kind, counts. Only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.common import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: The base patterns, and last the shape of unknown identifiers.
LOCAL, IDENT = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+@:/=-]"
PATTERNS = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<!{IDENT})[A-Za-z._%+:/=-]*+[0-9@]{IDENT}*+",
)
SECRET, UNKNOWN = len(BASE), len(KINDS)
ROUNDS, SUPPORT, CONFIDENT = 2, 3, 0.8
LEAST_LENGTH, LEAST_DIGITS = 6, 4
KEY_LENGTH, KEY_MIX = 20, 5


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        i.alias("i"), F.substring(digits, n - i, F.lit(1)).cast("int").alias("d")))
    total = F.aggregate(places, F.lit(0), lambda s, p: s + F.when(p["i"] % 2 == 0, p["d"]).when(
        p["d"] > 4, 2 * p["d"] - 9).otherwise(2 * p["d"]))
    return total % 10 == 0


def passes(kind: Column, hit: Column) -> Column:
    digits = digits_of(hit)
    n = F.length(digits)
    return (F.when(kind == 0, True)
            .when(kind == 1, hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"))
            .when(kind == 2, F.when(n.between(16, 19), luhn(digits)).otherwise(False))
            .when(kind == 3, n.between(8, 15))
            .otherwise((F.length(hit) >= LEAST_LENGTH) & ((n >= LEAST_DIGITS) | F.contains(hit, F.lit("@")))))


def may_hold(text: Column) -> Column:
    """Whether a text has a digit or an at sign; others have no span of any kind."""
    return F.coalesce(text.rlike("[0-9@]"), F.lit(False))


def _plain(c: Column) -> Column:
    """In small letters, digits as 0, one space between words."""
    return F.regexp_replace(F.translate(F.lower(c), "0123456789", "0" * 10), r"\s+", " ")


def spans_of(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, string, left, right) of all base spans, keys and unknown identifiers.

    ``left`` has up to three words before the string, ``right`` what follows up to a space. A match's place is the length of the
    pieces and matches before it, a running sum within row and kind.
    """
    parts = []
    for k, p in enumerate(PATTERNS):
        pieces = F.split("text", p, -1)
        matches = F.arrays_zip(pieces.alias("piece"), F.slice(pieces, 2, F.size(pieces)).alias("next"),
                               F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("hit"))
        parts.append(F.struct(F.lit(k if k < len(BASE) else UNKNOWN).alias("kind"), F.transform(matches, lambda m: F.struct(
            F.length(m["piece"]).cast("bigint").alias("gap"), m["hit"].alias("hit"),
            F.substring_index(F.trim(_plain(m["piece"])), " ", -3).alias("left"),
            _plain(F.regexp_extract(m["next"], r"^\s*+(\S*+)", 1)).alias("right"))).alias("at")))
    each = (rows.select("row", F.explode(F.array(*parts)).alias("p"))
            .select("row", "p.kind", F.posexplode("p.at").alias("i", "m")).where("m.hit is not null")
            .select("row", "kind", "i", "m.gap", "m.left", "m.right", "m.hit"))
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(before)
    placed = each.select("row", "kind", "left", "right", "hit", end.alias("end"))
    trimmed = F.when(F.col("kind") == UNKNOWN, F.regexp_replace("hit", r"[._%+:/=-]++$", "")).otherwise(F.col("hit"))
    spans = (placed.select("row", "kind", "left", "right", trimmed.alias("string"), (F.col("end") - F.length("hit")).alias("start"))
             .withColumn("end", F.col("start") + F.length("string")).where(passes(F.col("kind"), F.col("string"))))
    return spans.withColumn("kind", F.when((F.col("kind") == UNKNOWN) & key_shaped(F.col("string")), SECRET).otherwise(F.col("kind")))


def key_shaped(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return (F.length(c) >= KEY_LENGTH) & c.rlike("^[A-Za-z0-9]++$") & (letters >= KEY_MIX) & (F.length(c) - letters >= KEY_MIX)


def _apart(spans: DataFrame) -> DataFrame:
    """Without the unknown strings and keys that touch a base span."""
    order = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < SECRET
    reached = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    return (spans.withColumn("_reached", reached).withColumn("_next", following)
            .where(base | ((F.coalesce("_reached", F.lit(0)) <= F.col("start"))
                           & (F.col("_next").isNull() | (F.col("_next") >= F.col("end")))))
            .drop("_reached", "_next"))


def _contexts(spans: DataFrame) -> DataFrame:
    """One row per span and context."""
    words = F.filter(F.split("left", " "), lambda w: w != "")
    n = F.size(words)

    def last(k: int) -> Column:
        return F.when(n >= k, F.array_join(F.slice(words, -k, k), " "))

    around = F.concat_ws(" ", F.when(n > 2, F.array_join(F.slice(words, 2, 2), " ")).otherwise(F.array_join(words, " ")), F.lit("_"), "right")
    contexts = F.array_compact(F.array(last(1), last(2), last(3), F.when(n >= 1, around)))
    return spans.withColumn("context", F.explode(contexts))


def _normal(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s().-]", ""))


def confident_contexts(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(context, kind, score) of the contexts that name a kind reliably.

    ``edges`` has distinct (context, string, kind); kind ``UNKNOWN`` for strings in no base span.
    """
    size = edges.groupBy("context").agg(F.count_distinct("string").alias("strings"))
    seeds = (edges.where(F.col("kind") < UNKNOWN).groupBy("context", "kind").agg(F.count(F.lit(1)).alias("seeds"))
             .where(F.col("seeds") >= SUPPORT))
    known = written(seeds.join(size, "context"), "contexts")
    unknown = written(edges.where(F.col("kind") == UNKNOWN).select("context", "string")
                      .join(known.select("context").distinct(), "context"), "unknown")
    scores = known.select("context", "kind", (F.col("seeds") / F.col("strings")).alias("score"))
    for _ in range(rounds):
        held = (unknown.join(scores.where("score >= 0.5"), "context").groupBy("string", "kind")
                .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("held")))
        gained = unknown.join(held, "string").groupBy("context", "kind").agg(F.sum("held").alias("gained"))
        scores = written(known.join(gained, ["context", "kind"], "left").select(
            "context", "kind", F.least(F.lit(1.0), (F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / F.col("strings"))
            .alias("score")), "scores")
    return scores.where(F.col("score") >= CONFIDENT)


def all_spans(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(row, kind, start, end, base) of the base spans and those that contexts give. ``rows`` has (row, text), row unique."""
    spans = written(_apart(spans_of(rows.where(may_hold(F.col("text"))))), "spans")
    placed = _contexts(spans)
    edges = written(placed.select("context", _normal(F.col("string")).alias("string"), "kind").distinct(), "edges")
    named = confident_contexts(edges, rounds)
    found = (placed.where(F.col("kind") >= SECRET).select("row", "start", "end", "context", F.col("kind").alias("shape"))
             .join(named, "context").where(F.col("shape").isin(UNKNOWN) | (F.col("shape") == F.col("kind")))
             .groupBy("row", "start", "end").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("best"))
             .select("row", F.col("best.kind").alias("kind"), "start", "end", F.lit(False).alias("base")))
    return spans.where(F.col("kind") < SECRET).select("row", "kind", "start", "end", F.lit(True).alias("base")).union(found)


def _numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns with a number for each row, written so that the numbers stay."""
    return written(docs.select(*columns).withColumn("row", F.monotonically_increasing_id()), "rows")


def report(docs: DataFrame) -> DataFrame:
    """op10: counts of base spans by kind, the hash of the base spans, and all spans, for each document."""
    hits = _numbered(docs.where(may_hold(F.col("text"))), "doc_id", "text")
    name = reduce(lambda c, k: c.when(F.col("kind") == k[0], k[1]), enumerate(KINDS[1:], 1), F.when(F.col("kind") == 0, KINDS[0]))
    shown = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("shown")
    # kind, start, end, shown: sorted as they are to be joined
    listed = all_spans(hits.select("row", "text")).select("row", "base", F.struct("kind", "start", "end", shown).alias("span"))
    per_row = listed.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("own"),
        F.array_sort(F.collect_list("span")).alias("every"))
    none = F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint,shown:string>>)")
    every = (hits.select("doc_id", "row").join(per_row, "row", "left")
             .select("doc_id", F.coalesce("own", none).alias("own"), F.coalesce("every", none).alias("every"))
             .union(docs.where(~may_hold(F.col("text"))).select("doc_id", none, none)))

    def count(k: int) -> Column:
        return F.size(F.filter("own", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    return every.select("doc_id", *[count(k) for k in range(len(BASE))],
                        F.sha2(F.array_join(F.col("own.shown"), ","), 256).alias("base_sha256"),
                        F.array_join(F.col("every.shown"), ",").alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; spans that overlap go as one.

    ``n_chars`` follows the new text if it is there. Texts without spans stay as they are. A row is kept as a struct beside the
    columns that are worked on, so that columns of any name and type may be there.
    """
    held = may_hold(F.col("text"))
    hits = written(docs.where(held).select(F.struct("*").alias("doc"), "text", F.monotonically_increasing_id().alias("row")), "rows")
    spans = all_spans(hits.select("row", "text"))
    order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") < F.col("_reached"), 0).otherwise(1)).over(order)
    merged = (spans.withColumn("_reached", reached).withColumn("island", island).groupBy("row", "island")
              .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kind").alias("kind"))
              .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts")))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def piece(cut: Column, i: Column) -> Column:
        at = F.when(i > 0, F.element_at(F.col("cuts"), F.greatest(i, F.lit(1)))["end"]).otherwise(0)
        return F.concat(F.substring(F.col("text"), (at + 1).cast("int"), (cut["start"] - at).cast("int")),
                        F.element_at(names, cut["kind"] + 1))

    tail = F.substring(F.col("text"), (F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length("text"))
    masked = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(
        F.concat(F.array_join(F.transform("cuts", piece), ""), tail))
    changed = hits.join(merged, "row", "left").select("doc", "cuts", masked.alias("masked"))
    now = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.col("cuts").isNull(), F.col("doc")["n_chars"]).otherwise(
            F.length("masked").cast(docs.schema["n_chars"].dataType))
    return changed.select(*[now.get(c, F.col("doc")[c]).alias(c) for c in docs.columns]).union(docs.where(~held))
