"""Personal data by pattern, and terms that give it away by what they say about it in the corpus (after Sanchez and Batet, "C-sanitized", 2016)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import lower_ascii, materialise, text_of
from quiver.llm.spans import bind, chunks, find_spans, no_spans, outside, replaced, stretch

#: Patterns of the contract, in the order in which kinds are listed. An email address can only begin where its run of
#: characters begins or right after another match, an ip address where its digits begin, which spares the search all
#: later starts in a long run; possessive repeats match the same and need no stack.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A name of credentials and, behind an equals sign or colon, a long value with a digit.
SECRET = r"""(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|auth[_-]?key|token|secret|passwd|password)["']?[ \t]?[:=][ \t]?["']?(?=[a-z+/_-]{0,64}[0-9])[a-z0-9+/_-]{16,}+"""
#: What terms can give away.
PROTECTED = PATTERNS | {"secret": SECRET}
KINDS = [*PROTECTED, "term"]

#: Code points of context on either side of protected data, and length of a term from which on it counts.
CONTEXT, LEAST_TERM = 80, 3
#: A term goes if it gives away this share of the information in an entity, seen in so many different contexts of it:
#: the least that tells two texts from copies of one.
DISCLOSURE, SUPPORT = 0.9, 2
#: Rows and terms of the affected documents up to which they are broadcast.
MOST_BROADCAST = 200_000

_TERM = r"[\p{L}\p{N}]+"


def _luhn(digits: Column) -> Column:
    """Checksum of payment cards: from the right, every second digit counts double, less 9 if that is over 9."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind; a cheap look at the text spares most texts the search."""
    gate = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": F.contains(text, F.lit("+")), "secret": text.rlike("(?i)key|token|secret|passw")}
    good = lambda kind: lambda s: _holds(kind, s["value"])
    return {k: F.filter(F.when(gate[k], find_spans(text, p)).otherwise(no_spans()), good(k)) for k, p in PROTECTED.items()}


def _terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(lower_ascii(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= LEAST_TERM))


def _contexts(found: DataFrame) -> DataFrame:
    """One row per place of protected data: doc_id, entity, the terms around it."""
    named = lambda kind: lambda s: F.struct(F.concat(F.lit(f"{kind}:"), F.lower(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end"))
    spans = F.concat(*(F.transform(F.col(k), named(k)) for k in PROTECTED))

    def around(pieces: Column, size: Column, s: Column) -> Column:
        # one more code point on either side: where it belongs to a word, the window has cut that word, and it goes
        left = stretch(pieces, F.greatest(F.lit(0), s["start"] - CONTEXT - 1), s["start"])
        right = stretch(pieces, s["end"], F.least(size, s["end"] + CONTEXT + 1))
        whole_left = F.when(F.length(left) > CONTEXT, F.regexp_replace(left, rf"^{_TERM}", "")).otherwise(left)
        whole_right = F.when(F.length(right) > CONTEXT, F.regexp_replace(right, rf"{_TERM}$", "")).otherwise(right)
        return F.struct(s["entity"].alias("entity"), F.concat(whole_left, F.lit(" "), whole_right).alias("inner"))

    # windows are cut before they become rows: no row holds the text
    cut = F.struct(chunks(F.col("text")).alias("pieces"), F.length("text").alias("size"))
    windows = bind(cut, lambda c: F.transform(spans, lambda s: around(c["pieces"], c["size"], s)))
    places = found.filter(" OR ".join(f"size({k}) > 0" for k in PROTECTED)).select("doc_id", F.explode(windows).alias("s"))
    return places.select("doc_id", F.col("s.entity").alias("entity"), _terms(F.col("s.inner")).alias("terms"))


def disclosing_terms(found: DataFrame) -> DataFrame:
    """Terms (term) that reveal a protected entity.

    Over documents, the information that term t gives about entity e is log2(N * df(t, e) / (df(t) * df(e))), where
    df(t, e) counts documents with t near e; e itself holds log2(N / df(e)). Their ratio is 1 if t occurs only near e.
    Support counts different contexts, so that copies of one document prove nothing.
    """
    contexts = materialise(_contexts(found).withColumn("context", F.xxhash64("terms")), "contexts")
    known = contexts.select("entity", "context").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT).select("entity")
    near = contexts.join(known, "entity").select("doc_id", "entity", "context", F.explode("terms").alias("term"))
    support = near.select("term", "entity", "context").distinct().groupBy("term", "entity").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= SUPPORT)
    joint = near.select("term", "entity", "doc_id").distinct().groupBy("term", "entity").agg(F.count(F.lit(1)).alias("df_both"))
    df_entity = contexts.select("entity", "doc_id").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    df_near = contexts.select("doc_id", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df_near"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    joined = support.join(joint, ["term", "entity"]).join(df_entity, "entity").join(df_near, "term").crossJoin(F.broadcast(total)).filter("df_entity < total")  # one row
    # the condition on the ratio, solved for df(t); documents with t near any entity are some of those with t
    bounded = joined.withColumn("most", F.col("df_both") * F.pow(F.col("total") / F.col("df_entity"), F.lit(1 - DISCLOSURE)) * (1 + 1e-9))
    pairs = materialise(bounded.filter("df_near <= most").select("term", "most"), "pairs")
    wanted = pairs.select("term").distinct()
    df_term = found.select(F.explode(_terms(F.col("text"))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    return pairs.join(df_term, "term").filter("df_term <= most").select("term").distinct()


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each document, and the text without them.

    Spans are of the kinds of PROTECTED, plus ``term``: a whole word that discloses an entity by corpus co-occurrence,
    wherever it stands outside the other spans. Patterns become their kind in brackets, terms are generalised to [TERM];
    of overlapping spans the first stands for all. Work grows as n * log(n) of the spans of a text.

    Null or empty text: no spans. Null doc_id: patterns are found, terms are not. Rows that share a doc_id share their
    terms. Repeated rows: the same spans. Empty table: no rows. Columns besides doc_id and text are ignored. Returns
    doc_id, an array of spans per kind, spans (start, order, kind, end) sorted, sanitised.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    found = texts.select("*", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    terms = materialise(disclosing_terms(found), "terms")
    hits = materialise(
        texts.filter("doc_id IS NOT NULL").select("doc_id", F.explode(_terms(F.col("text"))).alias("term")).join(terms, "term").groupBy("doc_id").agg(F.collect_set("term").alias("terms")), "hits"
    )
    size = hits.agg(F.coalesce(F.sum(F.size("terms") + 1), F.lit(0)).alias("n")).first()["n"]
    joined = found.join(F.broadcast(hits) if size <= MOST_BROADCAST else hits, "doc_id", "left")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    places = F.when(F.col("terms").isNull(), no_spans()).otherwise(find_spans(lower_ascii(F.col("text")), pattern))
    base = joined.select("*", places.alias("places"), F.concat(*PROTECTED).alias("base"))
    apart = base.select("doc_id", "text", *PROTECTED, outside(F.col("places"), F.col("base")).alias("term"))
    tagged = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), F.lit(KINDS[i]).alias("kind"), s["end"].alias("end"))
    each = F.concat(*(F.transform(k, tagged(i)) for i, k in enumerate(KINDS)))
    spans = apart.select("*", F.array_sort(each).alias("spans"))
    return spans.select("doc_id", *KINDS, "spans", replaced(F.col("text"), F.col("spans")).alias("sanitised"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
