"""Secret scans with multipart credential linking, in DataFrame functions only.

Patterns give candidate parts with their places.  Strong parts (the base kinds) are always
reported.  Weak parts, which alone would be noise, are joined as intervals with the other
parts of their scope and reported only where complementary parts occur together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuestrata.llm.common import text_key, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Whoever signs in: weak alone.
IDENT = r"""(?i)(user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
#: Where one signs in: weak alone.
ENDPOINT = r"""(?i)((?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://)([^\x20\x09-\x0D"'<>]+)"""

#: Kinds in the order in which they are listed.
KINDS = ["assign", "access", "hex", "weak_secret", "weak_access", "ident", "endpoint"]
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: A value shorter than a base secret, or an identifier shorter than a base one, is weak from here on.
WEAK_SECRET_CHARS, WEAK_ACCESS_CHARS, IDENT_CHARS = 6, 8, 3
#: Code points between two parts of one credential at most.
SCOPE = 200
IDENTIFIER, SECRET, ENDPOINT_ROLE = 1, 2, 4


def _hits(text: Column, kind: str, pattern: str, has_value: bool) -> Column:
    """Matches in order as (source, nth, gap, chars, value): gap counts what precedes since the last match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length) if has_value else F.transform(found, F.length)
    zipped = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length).alias("gap"),
        F.transform(found, F.length).alias("chars"), value.alias("value"))
    rows = F.transform(zipped, lambda x, i: F.struct(
        F.lit(kind).alias("source"), i.alias("nth"), x["gap"].alias("gap"), x["chars"].alias("chars"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<source:string,nth:int,gap:int,chars:int,value:int>>"))


def parts(docs: DataFrame) -> DataFrame:
    """All candidate parts: doc_id, th, kind, role, strong, start, end (code points, end exclusive).

    The matches of a pattern and the gaps between them give places by a running sum.  A run
    of hex digits that is long enough is found by its own pattern, which is the same as finding
    all runs and dropping short ones.
    """
    text = text_or_empty()
    hits = F.concat(
        _hits(text, "assign", ASSIGN, True), _hits(text, "access", "AKIA[A-Z0-9]{%d,}" % (WEAK_ACCESS_CHARS - 4), False),
        _hits(text, "hex", "[0-9a-f]{%d,}" % HEX_CHARS, False), _hits(text, "ident", IDENT, True), _hits(text, "endpoint", ENDPOINT, True))
    rows = docs.select("doc_id", text_key().alias("th"), F.explode(hits).alias("h")).select("doc_id", "th", "h.*").distinct()
    along = Window.partitionBy("doc_id", "th", "source").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("chars")).over(along)
    source, value = F.col("source"), F.col("value")
    kind = (
        F.when((source == "assign") & (value >= ASSIGN_CHARS), "assign")
        .when((source == "assign") & (value >= WEAK_SECRET_CHARS), "weak_secret")
        .when((source == "access") & (value >= ACCESS_CHARS), "access").when(source == "access", "weak_access")
        .when(source == "hex", "hex").when((source == "ident") & (value >= IDENT_CHARS), "ident").when(source == "endpoint", "endpoint"))
    role = (
        F.when(F.col("kind").isin("access", "weak_access", "ident"), IDENTIFIER)
        .when(F.col("kind").isin("assign", "weak_secret", "hex"), SECRET).otherwise(ENDPOINT_ROLE))
    return (
        rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("chars")).withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select("doc_id", "th", "kind", role.alias("role"), F.col("kind").isin("assign", "access", "hex").alias("strong"), "start", "end"))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong parts, and the weak ones whose scope holds what completes them.

    A weak identifier needs a secret, a weak secret an identifier or an endpoint, an endpoint
    both an identifier and a secret.  Parts meet on (document, bucket of the scope), each part
    in all buckets of its widened interval and its partner in all buckets of its own, so that
    partners of any length are met and a long document is never one group.  Matches of one
    pattern never overlap, so a bucket holds a bounded number of parts.
    """
    weak, width = found.where(~F.col("strong")), max(scope, 1) * 2
    reach = weak.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / width), F.floor((F.col("end") + scope) / width))))
    other = found.select(
        F.col("doc_id").alias("o_id"), F.col("th").alias("o_th"), F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("o_bucket"))
    near = (
        F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("th") == F.col("o_th")) & (F.col("bucket") == F.col("o_bucket"))
        & (F.col("o_role") != F.col("role")) & (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope))
    roles = reach.join(other, near).groupBy("doc_id", "th", "kind", "role", "strong", "start", "end").agg(F.bit_or("o_role").alias("near"))
    has = lambda r: F.col("near").bitwiseAND(F.lit(r)) == r
    linked = roles.where(
        ((F.col("role") == IDENTIFIER) & has(SECRET)) | ((F.col("role") == SECRET) & (has(IDENTIFIER) | has(ENDPOINT_ROLE)))
        | ((F.col("role") == ENDPOINT_ROLE) & has(IDENTIFIER | SECRET)))
    return found.where("strong").unionByName(linked.drop("near"))


def _listed(base_only: bool) -> Column:
    """kind:start:end of the spans, by start and then in the order of the kinds."""
    spans = F.col("found")
    if base_only:
        spans = F.filter(spans, lambda x: x["nth"] < 3)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def spans_by_document(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text) that holds a span: doc_id, th, found (structs by start)."""
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    return link(parts(docs)).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start"), nth.alias("nth"), F.col("end"), F.col("kind")))).alias("found"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Null texts count as empty and give no spans; repeated rows each get their row; a null
    doc_id is a value like any other; extra columns of the input are not looked at.
    """
    spans = spans_by_document(docs).select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "found")
    base = docs.select("doc_id", text_key().alias("th"))
    joined = base.join(spans, base.doc_id.eqNullSafe(spans.s_id) & (base.th == spans.s_th), "left")
    joined = joined.withColumn("found", F.coalesce("found", F.array().cast(spans.schema["found"].dataType)))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return joined.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(True), 256).alias("base_sha256"), _listed(False).alias("spans"),
        F.size(F.filter("found", lambda x: x["nth"] > 2)).cast("long").alias("n_linked"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark`` and n_chars counted anew; all rows stay.

    Overlapping spans become one mark.  A null text stays null and an empty one empty; texts of any length are
    searched whole; rows of one doc_id are told apart by their texts, and repeated rows are redacted
    alike; an empty table stays empty.  Columns may have any names but those that begin with ``__span_``,
    ``__found`` and ``__secret_th``.
    """
    spans = spans_by_document(docs).select(F.col("doc_id").alias("__span_id"), F.col("th").alias("__span_th"), F.col("found").alias("__found"))
    keyed = docs.withColumn("__secret_th", text_key())
    joined = keyed.join(spans, keyed.doc_id.eqNullSafe(spans["__span_id"]) & (F.col("__secret_th") == spans["__span_th"]), "left")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.when(
        x["start"] >= a["at"],
        F.struct(x["end"].cast("long").alias("at"), F.concat(a["out"], F.col("text").substr((a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out")),
    ).otherwise(F.struct(F.greatest(a["at"], x["end"].cast("long")).alias("at"), a["out"].alias("out")))
    cut = F.aggregate("__found", state, step, lambda a: F.concat(a["out"], F.col("text").substr((a["at"] + 1).cast("int"), F.length("text"))))
    clean = F.when(F.col("__found").isNotNull(), cut).otherwise(F.col("text"))
    out = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__found").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
