"""Personal data in texts: fixed patterns, and identifiers that bootstrapped contexts find, in DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import join_groups, lower_ascii, materialise, table

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns. Each begins where its first run of characters does, or where the last match ended, and no group gives
#: back what it took, so that a long run is read once; what they match is what the plain patterns match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
#: What looks like an identifier: white-space separated, with a digit or an @, and further groups of digits behind it.
LIKE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[(]?[0-9][0-9().-]*+(?!\S))*+"
#: What goes from its ends: a name before a colon or an equals sign, and punctuation.
LABEL, TAIL = r"^(?:(?=[A-Fa-f]*+[G-Zg-z_-])[A-Za-z_-]++[:=])?[^A-Za-z0-9+(:]*+", r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++$"
#: The shape that an unseen identifier of a kind must have: an address without a dotted host or with its signs spelt out, an address
#: with a port or of the newer internet protocol, a number of 12 to 19 digits, and one of 7 to 15 digits without its country.
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]+(?:@|\[at\]|\(at\))[A-Za-z0-9-]++(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9-]++)*+$",
    "ip": r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{1,5}|(?=[^:]*:[^:]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})$",
    "card": r"^[0-9](?:[ -]?[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,14}$",
}
#: Put around matches; of all characters the least likely in a text.
MARK, OTHER_MARK = "\x01", "\x02"
#: Characters before and after an identifier in which its context is looked for.
CONTEXT = 64
#: Rounds of scoring; what one finds speaks for further contexts in the next.
ROUNDS = 3
#: A context is trusted for a kind if the lower bound of the kind's share in it (Z standard errors below) is at least TRUST, and if
#: so large a share over the usual one, which counts as a half at most, would come up by chance in no more than ODDS of all contexts.
TRUST, Z, ODDS = 0.6, 1.64, 0.05
#: An unseen identifier is found if its contexts, taken as independent, reach this score.
FOUND = 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the check sum of card numbers."""
    each = F.transform(F.array_remove(F.split(F.reverse(_digits(value)), ""), ""), lambda c, k: c.cast("int") * (k % 2 + 1))
    return F.aggregate(each, F.lit(0), lambda held, d: held + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _kept(kind: str, value: Column) -> Column:
    """Whether a match of a fixed pattern is no failing one."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(IP)
    if kind == "card":
        return F.when(n.between(*CARD_DIGITS), luhn(value)).otherwise(False)
    return n.between(*PHONE_DIGITS) if kind == "phone" else F.lit(True)


def _cut(text: Column, pattern: str) -> Column:
    """A text as what stands before its first match, the match, what stands between it and the next, and so on.

    Matches are put between marks, at which the text is then cut: one pass each,
    however many there are. A mark that the text has itself is another one here,
    which no pattern takes for anything else.
    """
    clean = F.when(text.contains(MARK), F.translate(text, MARK, OTHER_MARK)).otherwise(text)
    return F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _found(kind: str, parts: str) -> Column:
    """For each match of _cut() its size, the size of the gap before it and, unless it fails, its value with what stands before and after.

    A match that looks like an identifier loses its label and tail; its label joins what stands before.
    """

    def match(v: Column, k: Column) -> Column:
        label = F.regexp_extract(v, LABEL, 0) if kind == "like" else F.lit("")
        return F.struct(k.alias("k"), v.alias("v"), F.element_at(parts, 2 * k + 1).alias("gap"), F.element_at(parts, 2 * k + 3).alias("after"), label.alias("label"))

    def trimmed(m: Column) -> Column:
        core = F.regexp_replace(F.substr(m["v"], F.length(m["label"]) + 1), TAIL, "") if kind == "like" else m["v"]
        return F.struct(m.alias("m"), core.alias("core"))

    def judged(t: Column) -> Column:
        kept = reduce(or_, [t["core"].rlike(p) for p in SHAPES.values()]) if kind == "like" else _kept(kind, t["core"])
        return F.struct(t["m"].alias("m"), t["core"].alias("core"), kept.alias("kept"))

    def known(t: Column) -> Column:
        m, lead = t["m"], F.length(t["m"]["label"])
        before = F.substring(F.concat(F.substring(m["gap"], -CONTEXT, CONTEXT), m["label"]), -CONTEXT, CONTEXT)
        after = F.substring(F.concat(F.substr(m["v"], lead + F.length(t["core"]) + 1), F.substring(m["after"], 1, CONTEXT)), 1, CONTEXT)
        if_kept = lambda x: F.when(t["kept"], x)
        return F.struct(
            F.lit(kind).alias("kind"), m["k"].alias("k"), F.length(m["gap"]).alias("gap"), F.length(m["v"]).alias("size"), lead.alias("lead"),
            if_kept(t["core"]).alias("value"), if_kept(before).alias("before"), if_kept(after).alias("after"),
        )

    matches = F.filter(parts, lambda _, i: i % 2 == 1)
    return F.transform(F.transform(F.transform(F.transform(matches, match), trimmed), judged), known)


def _spans(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, spans) of own(rid, doc_id, text): spans(rid, kind, start, end, value, before, after) of the fixed kinds, and of kind like where none of those overlaps."""
    kinds = {**PATTERNS, "like": LIKE}
    some = {"email": F.col("text").contains("@"), "like": F.col("text").rlike("[0-9@]")}
    none = F.array().cast("array<string>")
    cut = own
    for kind, pattern in kinds.items():
        open_ = some.get(kind, F.col("text").rlike("[0-9]"))
        cut = cut.withColumn(kind, F.when(open_, _cut(F.col("text"), pattern)).otherwise(none))
    read = cut.select("rid", "doc_id", F.concat(*[_found(kind, kind) for kind in kinds]).alias("found"))
    read = materialise(read, "matches")
    each = read.select("rid", F.inline("found")).repartition("rid")
    ends = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    start = ends - F.col("size") + F.col("lead")
    each = each.select("rid", "kind", start.alias("start"), (start + F.length("value")).alias("end"), "value", "before", "after").where("value is not null")
    fixed, place = F.col("kind") != "like", (F.col("start"), F.col("kind"))
    so_far = lambda *order: Window.partitionBy("rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # noqa: E731  running, so linear; backwards for what comes
    reached = F.max(F.when(fixed, F.col("end"))).over(so_far(*place))
    coming = F.min(F.when(fixed, F.col("start"))).over(so_far(*[c.desc() for c in place]))
    clear = (F.coalesce(reached, F.lit(-1)) <= F.col("start")) & (F.coalesce(coming, F.col("end")) >= F.col("end"))
    spans = each.withColumn("clear", fixed | clear).where("clear").drop("clear")
    return read.select("rid", "doc_id"), materialise(spans, "spans")


def _contexts(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: the word before, the two words before, and the words around; lower-case, digits alike, each with a letter."""
    words = lambda x: F.array_remove(F.split(F.regexp_replace(lower_ascii(x), "[0-9]", "0"), r"\s+"), "")
    left, right = words(before), words(after)
    last, first = F.element_at(left, -1), F.element_at(right, 1)
    one = F.when(F.size(left) > 0, F.concat(last, F.lit(" _")))
    two = F.when(F.size(left) > 1, F.concat(F.element_at(left, -2), F.lit(" "), last, F.lit(" _")))
    around = F.when((F.size(left) > 0) & (F.size(right) > 0), F.concat(last, F.lit(" _ "), first))
    return F.filter(F.array(one, two, around), lambda c: c.isNotNull() & c.rlike(r"[a-z\x{80}-\x{10FFFF}]"))


def _bound(pos: Column, n: Column) -> Column:
    """The lower end of the interval for a share of pos in n (Wilson)."""
    share = pos / n
    return (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def _surprise(pos: Column, n: Column, usual: Column) -> Column:
    """n times the divergence of a share of pos in n from the usual one; 0 where it is no larger."""
    share = pos / n
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - usual))).otherwise(0.0)
    return F.when(share > usual, n * (share * F.log(share / usual) + rest)).otherwise(0.0)


def _bootstrap(spans: DataFrame) -> DataFrame:
    """(value, kind, rows) of the unseen identifiers that contexts of known ones find; rows says how many spans have the value.

    The graph has an edge for each context and identifier that are seen together,
    however often. Known identifiers speak for their kind, and against the others,
    in their contexts; unseen ones speak against the kinds whose shape they lack.
    Each round scores contexts by what speaks in them, found identifiers with their
    scores included, and then the unseen identifiers by the contexts to trust.
    """
    like = F.col("kind") == "like"
    shapes = F.array(*[F.when(F.col("value").rlike(SHAPES[k]), F.lit(k)) for k in KINDS])
    kinds = F.when(like, F.array_compact(shapes)).otherwise(F.array("kind"))
    edges = spans.select(F.lower("value").alias("value"), like.alias("unseen"), kinds.alias("kinds"), F.explode(_contexts(F.col("before"), F.col("after"))).alias("context"))
    edges = materialise(edges.groupBy("context", "unseen", "value").agg(F.first("kinds").alias("kinds")), "edges")
    unseen = edges.where("unseen")
    empty = spans.sparkSession.createDataFrame([], "value string, kind string, score double")
    rows = spans.where(like).groupBy(F.lower("value").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    if unseen.isEmpty():
        return empty.join(rows, "value").select("value", "kind", "rows")
    speaks = lambda k: F.sum(F.when(~F.col("unseen") & F.array_contains("kinds", k), 1.0).otherwise(0.0))
    against = lambda k: F.sum(F.when(~F.array_contains("kinds", k), 1.0).otherwise(0.0))
    sums = [c for k in KINDS for c in (speaks(k).alias(f"pos_{k}"), against(k).alias(f"neg_{k}"))]
    usual = edges.agg(F.count_distinct("context").alias("contexts"), *sums).first()  # one row
    share = {k: min(0.5, max(usual[f"pos_{k}"], 1.0) / max(usual[f"pos_{k}"] + usual[f"neg_{k}"], 2.0)) for k in KINDS}
    needed = math.log(max(usual["contexts"], 1) * len(KINDS) / ODDS)
    stacked = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"pos_{k}").alias("pos"), F.col(f"neg_{k}").alias("neg"), F.lit(share[k]).alias("usual")) for k in KINDS])
    by_context = edges.groupBy("context").agg(F.sum(F.col("unseen").cast("long")).alias("links"), *sums).select("context", "links", F.inline(stacked))
    by_context = materialise(by_context, "contexts")
    places = materialise(unseen.select("context", "value", F.explode("kinds").alias("kind")), "unseen")
    found = empty
    for turn in range(ROUNDS):
        scored = by_context.withColumn("more", F.lit(0.0))
        if turn:
            said = join_groups(places.withColumn("key", F.struct("value", "kind")), found.select(F.struct("value", "kind").alias("key"), "score", "edges"), "key", "edges", "inner")
            more = said.groupBy("context", "kind").agg(F.sum("score").alias("more"))
            scored = by_context.join(more, ["context", "kind"], "left").na.fill(0.0, ["more"])
        pos, n = F.col("pos") + F.col("more"), F.col("pos") + F.col("more") + F.col("neg")
        trusted = scored.where((pos > 0) & (F.col("links") > 0)).select(
            F.struct("context", "kind").alias("key"), "links", _bound(pos, n).alias("bound"), _surprise(pos, n, F.col("usual")).alias("surprise")
        )
        trusted = materialise(trusted.where((F.col("bound") >= TRUST) & (F.col("surprise") >= needed)), "trusted")
        seen = join_groups(places.withColumn("key", F.struct("context", "kind")), trusted, "key", "links", "inner")
        scores = seen.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("bound"), F.lit(1e-9)))))).alias("score"))
        order = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, -k)]), F.col("kind"))
        best = scores.where(F.col("score") >= FOUND).groupBy("value").agg(F.max(F.struct(F.round("score", 9).alias("score"), order.alias("order"), F.col("kind").alias("kind"))).alias("b"))
        per_value = places.groupBy("value", "kind").agg(F.count(F.lit(1)).alias("edges"))
        found = materialise(best.select("value", "b.kind", "b.score").join(per_value, ["value", "kind"]), "found")
        if found.isEmpty():
            break
    return found.join(rows, "value").select("value", "kind", "rows")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The matches of the fixed patterns that do not fail are the seeds, and always
    stay. Their contexts (the word before, the two words before, the words around)
    and everything that looks like an identifier make a graph of contexts and
    identifiers, which is scored in ROUNDS rounds, see _bootstrap(); unseen
    identifiers that trusted contexts point to, and whose shape goes with the kind,
    are spans of that kind wherever they stand. A context must hold more known
    identifiers of a kind than chance would have it, over all contexts of the
    corpus; few or mixed ones add nothing.

    spans has all spans as kind:start:end by start, then kind in the order of KINDS,
    comma-joined, in code points with the end exclusive; base_sha256 is of the fixed
    ones alone, and the counts too; n_added counts the others. No text is shuffled:
    one pass writes matches with up to CONTEXT characters on both sides, and all
    that follows handles these. Contexts and identifiers with many links are joined
    by a broadcast of the few hot ones.

    Null, empty and matchless texts have no spans and the digest of the empty text.
    Repeated rows each give a row, null ids included; they count as one identifier
    in one context. An empty table gives no rows. Other columns are ignored.
    """
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    read, spans = _spans(own)
    found = materialise(_bootstrap(spans), "identifiers")
    unseen = spans.where("kind = 'like'").select("rid", "start", "end", F.lower("value").alias("value"))
    added = join_groups(unseen, found, "value", "rows", "inner").select("rid", "kind", "start", "end", F.lit(True).alias("added"))
    all_ = spans.where("kind <> 'like'").select("rid", "kind", "start", "end", F.lit(False).alias("added")).unionByName(added)
    place = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)]), F.col("kind"))
    lists = all_.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind", "added"))).alias("s"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda s: F.array_join(F.transform(s, text), ",")
    fixed = F.filter("s", lambda x: ~x["added"])
    count = lambda test: F.coalesce(F.size(F.filter("s", test)), F.lit(0)).cast("long")
    out = read.join(lists, "rid", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string,added:boolean>>")))
    of = lambda k: lambda x: (x["kind"] == k) & ~x["added"]
    kinds = [count(of(k)).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *kinds, F.sha2(joined(fixed), 256).alias("base_sha256"), joined("s").alias("spans"), count(lambda x: x["added"]).alias("n_added"))


def op12_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
