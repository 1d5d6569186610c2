"""Personal data: patterns, and terms that give protected entities away. DataFrame functions alone.

Patterns find the base spans: e-mail addresses, IP addresses, payment cards and phone numbers. Each distinct
string of them is a protected entity, and so is each class of strings that it belongs to (``entities``): an exact string
mostly occurs in one text, from which nothing can be estimated. A term is a word of letters outside of entities. Over all
documents Spark counts those that hold an entity (n_e), a term (n_t), and both (n_et). With N
documents, the information content of an entity is IC = -log2(n_e / N) and what a term tells about it is the
pointwise mutual information PMI = log2(n_et * N / (n_e * n_t)). PMI / IC is 1 for a term that occurs with the
entity alone. A term with a share of ``GENERALISE`` or more, seen with the entity in ``SUPPORT`` or more
distinct texts, is a span wherever it occurs, in documents without the entity too: generalised to its first letter,
or removed from ``REMOVE`` on.
All counts are over all documents; copies of a text add to them but not to the number of distinct texts.

Spans never retry: a candidate that fails its check is dropped, and the search goes on after it. Each pattern
only starts where a run starts, or where the last match ended, and a text's matches are walked once.

Defined cases: a null or empty text has no spans; rows that repeat stay and get equal results; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.llm.common import whole_text
from hydrospark.plans.scratch import written

SUPPORT = 2
PREFIX = 6  # first digits that numbers of one class share
GENERALISE = 0.85
REMOVE = 0.95
CHUNK = 256  # spans that are appended to one array
DRAWERS = 256  # maps that the disclosing terms of one text are dealt into
MOST_SENT = 500_000  # disclosing terms that are broadcast at most

# The four patterns as given; possessive quantifiers and starts at a run's start find the same matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"(?U)\p{L}{3,}"
KINDS = ("email", "ip", "card", "phone")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def located(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """All matches of a pattern, or those that ``keep`` wants, as array of (start, end, value), in code points; a split at the matches gives what lies between.

    One walk carries the place. To append to an array copies it, so spans go to a list of at most ``CHUNK``, and full lists to a list of lists.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = "struct<start:int,end:int,value:string>"
    none = F.array().cast(f"array<{span}>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("last"), F.array().cast(f"array<array<{span}>>").alias("full"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        whole = F.size(state["last"]) >= CHUNK
        added = F.struct(end.alias("at"), F.when(whole, one).otherwise(F.concat(state["last"], one)).alias("last"), F.when(whole, F.concat(state["full"], F.array(state["last"]))).otherwise(state["full"]).alias("full"))
        return F.when(keep(x["value"]), added).otherwise(F.struct(end.alias("at"), state["last"].alias("last"), state["full"].alias("full"))) if keep else added

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, begin, step, lambda state: F.concat(F.flatten(state["full"]), state["last"]))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum: every second digit from the right counts double, less 9 if above 9."""
    ones = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(ones, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four kinds as array of (kind, start, end, value), by kind and start."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    # a cheap test first: most texts have none of a kind
    kinds = {
        "email": F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(located(text, IP), lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))).otherwise(none),
        "card": F.when(text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), F.filter(located(text, CARD), lambda s: F.length(digits(s)).between(13, 19) & luhn(digits(s)))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE), lambda s: F.length(digits(s)).between(9, 15))).otherwise(none),
    }
    # Spark passes a second argument of a lambda the index, so the kind is bound by a function
    named = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    return F.concat(*[F.transform(found, named(kind)) for kind, found in kinds.items()])


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def replaced(text: Column, spans: Column) -> Column:
    """The text with spans (start, rank, end, by), in order, replaced by ``by``; of spans that overlap the first counts."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,by:string>>").alias("last"), F.array().cast("array<array<struct<start:int,end:int,by:string>>>").alias("full"))

    def step(state: Column, s: Column) -> Column:
        one = F.array(F.struct(state["at"].alias("start"), s["start"].alias("end"), s["by"].alias("by")))
        whole = F.size(state["last"]) >= CHUNK
        added = F.struct(s["end"].alias("at"), F.when(whole, one).otherwise(F.concat(state["last"], one)).alias("last"), F.when(whole, F.concat(state["full"], F.array(state["last"]))).otherwise(state["full"]).alias("full"))
        return F.when(s["start"] < state["at"], state).otherwise(added)

    rest = lambda state: F.array(F.struct(state["at"].alias("start"), F.char_length(text).alias("end"), F.lit("").alias("by")))
    pieces = F.aggregate(F.sort_array(spans), begin, step, lambda state: F.concat(F.flatten(state["full"]), state["last"], rest(state)))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.substr(text, p["start"] + 1, p["end"] - p["start"]), p["by"])), "")


def entities(base: Column) -> Column:
    """The distinct protected entities of a text's spans, and the classes that they are of: mail domain and mailbox, first numbers, kind."""

    def levels(s: Column) -> Column:
        kind, value = s["kind"], s["value"]
        digits = F.regexp_replace(value, "[^0-9]", "")
        wider = (
            F.when(kind == "email", F.array(F.concat(F.lit("domain "), F.lower(F.substring_index(value, "@", -1))), F.concat(F.lit("mailbox "), F.lower(F.substring_index(value, "@", 1)))))
            .when(kind == "ip", F.array(F.concat(F.lit("network "), F.substring_index(value, ".", 3))))
            .otherwise(F.array(F.concat(kind, F.lit(" prefix "), F.substring(digits, 1, PREFIX))))
        )
        return F.concat(F.array(F.concat(F.lit("is "), value), F.concat(F.lit("kind "), kind)), wider)

    return F.array_distinct(F.flatten(F.transform(base, levels)))


def reach(n_entity: Column, total: Column, share: float) -> Column:
    """No term in more rows than this can have the share of an entity in ``n_entity`` rows: n_et is n_e at most, so what it tells is log2(N / n_t) at most."""
    return F.greatest(n_entity, F.pow(n_entity, F.lit(share)) * F.pow(total, F.lit(1.0 - share))) * F.lit(1 + 1e-9)


def disclosing(words: DataFrame, held: DataFrame, support: int = SUPPORT, share: float = GENERALISE) -> DataFrame:
    """(entity, term, share) of the terms that tell too much; of entities that are in the same texts the least stands for all.

    ``words`` (terms) are the distinct terms of each document, ``held`` (id, n, entities, terms) the distinct texts with
    entities and their number of rows. Pairs are only made of what can pass: entities and terms of ``support`` or more
    texts, those in the same texts as one, and terms within ``reach`` of the entity. So a text with many addresses of its
    own and many words of its own makes no pairs of them.
    """
    total = F.lit(float(max(1, words.count())))
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"mark_{i}") for i in range(2)]
    own = held.select("id", "n", F.explode("entities").alias("entity"))
    of_entity = own.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts"), *marks).where(F.col("texts") >= support)
    of_entity = written(of_entity.groupBy("mark_0", "mark_1", "texts", "n_e").agg(F.min("entity").alias("entity")).select("entity", "n_e"), "pii-entities")
    widest = of_entity.agg(F.max("n_e").alias("n")).select(reach(F.col("n").cast("double"), total, share).alias("most")).first()["most"] or 0.0
    used = held.select("id", "n", F.explode("terms").alias("term"))
    of_term = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") <= widest)
    seen = used.groupBy("term").agg(F.count(F.lit(1)).alias("texts"), *marks).where(F.col("texts") >= support).drop("texts")
    of_term = written(seen.join(of_term, "term"), "pii-terms")
    # terms of the same texts go as one, the rarest of them decides whether an entity is within reach
    used = used.join(of_term, "term").groupBy("id", "mark_0", "mark_1").agg(F.first("n").alias("n"), F.min("n_t").alias("n_t"))
    beside = own.join(of_entity, "entity").groupBy("id").agg(F.collect_list(F.struct("entity", "n_e", reach(F.col("n_e").cast("double"), total, share).alias("most"))).alias("entities"))
    near = F.explode(F.filter("entities", lambda e: e["most"] >= F.col("n_t"))).alias("e")
    pairs = used.join(beside, "id").select("n", "mark_0", "mark_1", near).select("n", "mark_0", "mark_1", "e.entity", "e.n_e")
    pairs = pairs.groupBy("mark_0", "mark_1", "entity", "n_e").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    content = F.log2(total / F.col("n_e"))
    told = F.log2(F.col("n_et") * total / (F.col("n_e") * F.col("n_t")))
    found = pairs.join(of_term, ["mark_0", "mark_1"]).select("entity", "term", F.when(content > 0, F.least(F.lit(1.0), told / content)).otherwise(0.0).alias("share"))
    return found.where(F.col("share") >= share)


def outside(places: Column, base: Column) -> Column:
    """The ``places`` (start, end, value, share) that overlap no span of ``base``, both in order of start: one walk over both lists, in which a place waits for the next one."""
    span = "struct<start:int,end:int,value:string,share:double>"
    none = F.array().cast(f"array<{span}>")
    nothing = F.lit(None).cast(span)
    of = lambda rank, share: lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["value"].alias("value"), share(s).alias("share"))
    both = F.sort_array(F.concat(F.transform(base, of(0, lambda s: F.lit(1.0))), F.transform(places, of(1, lambda s: s["share"]))))
    begin = F.struct(F.lit(0).alias("until"), nothing.alias("waits"), none.alias("last"), F.array().cast(f"array<array<{span}>>").alias("full"))

    def step(state: Column, x: Column) -> Column:
        waits, whole = state["waits"], F.size(state["last"]) >= CHUNK
        cut = F.struct(F.greatest(state["until"], x["end"]).alias("until"), F.when(waits["end"] > x["start"], nothing).otherwise(waits).alias("waits"), state["last"].alias("last"), state["full"].alias("full"))
        one = F.when(x["start"] >= state["until"], F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["share"].alias("share"))).otherwise(nothing)
        last = F.when(waits.isNull(), state["last"]).when(whole, F.array(waits)).otherwise(F.concat(state["last"], F.array(waits)))
        full = F.when(waits.isNotNull() & whole, F.concat(state["full"], F.array(state["last"]))).otherwise(state["full"])
        return F.when(x["rank"] == 0, cut).otherwise(F.struct(state["until"].alias("until"), one.alias("waits"), last.alias("last"), full.alias("full")))

    return F.aggregate(both, begin, step, lambda state: F.concat(F.flatten(state["full"]), state["last"], F.when(state["waits"].isNull(), none).otherwise(F.array(state["waits"]))))


def drawer(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(DRAWERS)).cast("int")


def placed(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(key, places) of the texts of ``rows`` (key, text) that have terms of ``told`` (term, share): all their places as array of (start, end, value, share), by start.

    Terms up to ``MOST_SENT`` are broadcast to the distinct terms of each text. What they hit meets the texts by key, by the same join at every size.
    """
    few = told.limit(MOST_SENT + 1).count() <= MOST_SENT
    hits = rows.select("key", F.explode(distinct_terms(F.col("text"))).alias("term")).join(F.broadcast(told) if few else told, "term").groupBy("key", "term").agg(F.max("share").alias("share"))
    # Spark searches a map from end to end, so a text's terms are in maps by a hash
    hits = hits.groupBy("key", drawer(F.col("term")).alias("drawer")).agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))
    hits = written(hits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("drawer", "told"))).alias("told")), "pii-hits")
    share_of = lambda term: F.try_element_at(F.try_element_at("told", drawer(term)), term)
    places = located(F.col("text"), TERM, lambda v: share_of(F.lower(v)).isNotNull())
    places = F.transform(places, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lower(t["value"]).alias("value"), share_of(F.lower(t["value"])).alias("share")))
    return rows.join(hits.hint("merge"), "key").select("key", places.alias("places")).dropDuplicates(["key"])


def find(docs: DataFrame, support: int = SUPPORT, share: float = GENERALISE) -> DataFrame:
    """(doc_id, text, base, extra) of each row: ``base`` of ``base_spans``, ``extra`` the disclosing terms as array of (start, end, value, share)."""
    text = whole_text()
    rows = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("key"))
    found = rows.withColumn("base", base_spans(F.col("text")))
    words = rows.select(distinct_terms(F.col("text")).alias("terms"))
    # only texts with entities are counted with terms, equal ones once
    held = found.where(F.size("base") > 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"), F.first("base").alias("base"))
    blank = F.transform("base", lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("rank"), s["end"].alias("end"), F.lit(" ").alias("by")))
    # both arrays are written once, so that no later step works them out for each of a text's terms
    held = written(held.select(F.monotonically_increasing_id().alias("id"), "n", entities(F.col("base")).alias("entities"), distinct_terms(replaced(F.col("text"), blank)).alias("terms")), "pii-held")
    told = written(disclosing(words, held, support, share).groupBy("term").agg(F.max("share").alias("share")), "pii-disclosing")
    places = written(placed(rows.select("key", "text"), told), "pii-places")
    # of the rows only what the caller reads goes along: the query takes no texts
    return found.join(places, "key", "left").select("doc_id", "text", "base", outside(F.coalesce("places", F.array().cast("array<struct<start:int,end:int,value:string,share:double>>")), F.col("base")).alias("extra"))


def sanitised(found: DataFrame, remove: float = REMOVE) -> DataFrame:
    """``found`` of ``find`` with ``clean``: entities become '[KIND]', terms their first letter and a point, or nothing from ``remove`` on.

    Where spans overlap, the one that starts first counts, and an entity before a term.
    """
    kinds = F.transform("base", lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("rank"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    terms = F.transform("extra", lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("rank"), s["end"].alias("end"), F.when(s["share"] >= remove, "").otherwise(F.concat(F.substring(s["value"], 1, 1), F.lit("."))).alias("by")))
    return found.withColumn("clean", replaced(F.col("text"), F.concat(kinds, terms)))
