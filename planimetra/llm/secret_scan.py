"""Secret scans that link the parts of a credential.

Four patterns find parts in a text: assignments, access identifiers, hexadecimal keys, and
weaker ones (other assignments, user names, mixed tokens, endpoints). The pieces between a
pattern's matches give the matches' positions by a running sum. Strong parts, the base
spans, are always reported. The others are linked within their scope (a block of text between
blank lines), however far apart, and reported only if the parts that complete them are there:

* weak_access (an identifier): a secret;  * weak_assign (a weak secret): an identifier or an endpoint;
* weak_token (a bare token): an identifier;  * endpoint: an identifier and a secret.

Within its scope, an interval of the text, each part is joined to the nearest part of each
role, before or behind it: three links a part, however many there are, by running windows.
`credentials` gives those links.

Defined cases: a null text counts as empty and has no spans; rows that repeat a doc_id are
told apart by their texts, equal rows give equal results, one for each; other columns are
ignored; a text without a match gives a row with zero counts; a very long text is searched
whole, in one task, and its parts are sorted, not gathered; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import text_or_empty

# The base patterns and the least lengths of their matches. The letters that a match
# can begin with come first, which spares most places the alternatives.
ASSIGN = r"""(?=[PpSsTtAa])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST_SECRET, LEAST_ACCESS = 12, 18

#: Weak parts, found in one pass: endpoint, identifier, secret, bare token.
ENDPOINT = r"""https?://[^\s"'<>]+|(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d{1,5})?(?![\d.])"""
IDENTIFIER = r"""(?i:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
SECRET = r"""(?i:pwd|pass|passphrase|passcode|auth|credentials?|private_?key|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
WEAK = f"(?=[h0-9])(?:{ENDPOINT})|(?=[UuLlAaCcKkPp])(?<![A-Za-z])(?:{IDENTIFIER}|{SECRET})|{TOKEN}"
BLANK_LINE = r"\n[\x20\t\r]*\n\s*"

#: The kinds in the order of the report; the first three are base spans.
KINDS = ("assign", "access", "hex", "weak_access", "weak_assign", "weak_token", "endpoint")


def _matches(pattern: str, number: int, kind) -> Column:
    """The matches of a pattern, extracted as column `m<number>`, as structs (pass, idx, gap
    before it, length, kind or null, value). Texts without a match are not split."""
    found = F.arrays_zip(F.split(F.col("text"), pattern).alias("gap"), F.col(f"m{number}").alias("value"))
    rows = F.transform(found, lambda x, i: F.struct(F.lit(number).alias("pass"), i.alias("idx"), F.length(x["gap"]).alias("gap"), F.length(x["value"]).alias("length"), kind(x["value"]).alias("kind"), x["value"].alias("value")))
    return F.when(F.size(f"m{number}") > 0, F.filter(rows, lambda x: x["value"].isNotNull())).otherwise(F.array().cast(_PART))


_PART = "array<struct<pass:int,idx:int,gap:int,length:int,kind:string,value:string>>"


def _kind_of_assignment(value: Column) -> Column:
    size = F.length(F.regexp_extract(value, ASSIGN, 2))
    return F.when(size >= LEAST_SECRET, "assign").when(size >= 4, "weak_assign")


def _kind_of_weak(value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    whole = lambda pattern: value.rlike(rf"\A(?:{pattern})\z")
    return F.when(whole(ENDPOINT), "endpoint").when(whole(IDENTIFIER), "weak_access").when(whole(SECRET), "weak_assign").when(mixed, "weak_token")


#: A pattern, a literal that each of its matches has (or None), and the kind of a match. The last finds where scopes end.
PASSES = (
    (ASSIGN, None, _kind_of_assignment),
    (ACCESS, "AKIA", lambda v: F.when(F.length(v) >= LEAST_ACCESS, "access").when(F.length(v) >= 8, "weak_access")),
    (HEX, None, lambda v: F.lit("hex")),
    (WEAK, None, _kind_of_weak),
    (BLANK_LINE, "\n", lambda v: F.lit(None).cast("string")),
)


def parts(docs: DataFrame) -> DataFrame:
    """A row for each part: doc_id, text_key, copies, start, end (null in a document's first
    row, which has no part), kind (null: a blank line or nothing), value."""
    text = docs.select("doc_id", text_or_empty().alias("text"))
    for number, (pattern, literal, _) in enumerate(PASSES, 1):
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        text = text.withColumn(f"m{number}", values if literal is None else F.when(F.contains("text", F.lit(literal)), values).otherwise(F.array().cast("array<string>")))
    first = F.array(F.struct(F.lit(0).alias("pass"), F.lit(0).alias("idx"), F.lit(0).alias("gap"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value")))
    everything = F.concat(first, *(_matches(pattern, number, kind) for number, (pattern, _, kind) in enumerate(PASSES, 1)))
    rows = text.select("doc_id", F.xxhash64("text").alias("text_key"), F.inline(everything))
    rows = rows.repartition("doc_id", "text_key").groupBy("doc_id", "text_key", "pass", "idx", "gap", "length", "kind", "value").agg(F.count("*").alias("copies"))
    upto = Window.partitionBy("doc_id", "text_key", "pass").orderBy("idx")
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    return rows.select("doc_id", "text_key", "copies", "pass", (end - F.col("length")).alias("start"), end.alias("end"), "kind", "value")


#: The kinds of each role in a credential.
ROLES = {"identifier": ("access", "weak_access"), "secret": ("assign", "hex", "weak_assign", "weak_token"), "endpoint": ("endpoint",)}


def linked(docs: DataFrame) -> DataFrame:
    """parts with the columns scope, reported and identifier, secret, endpoint: for each role
    the part (start, end, kind, value) of that role in the scope that lies nearest, by the gap
    between the two (ties: the earlier); null if the scope has no other of that role."""
    doc = Window.partitionBy("doc_id", "text_key").orderBy("start", "pass", "end")
    rows = parts(docs).withColumn("scope", F.sum((F.col("pass") == len(PASSES)).cast("int")).over(doc))
    base = F.col("kind").isin(*KINDS[:3])
    # a weak part on a base span says nothing new; neither does the same place twice
    later = Window.partitionBy("doc_id", "text_key").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    covered = F.coalesce(F.max(F.when(base, F.col("end"))).over(doc.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False))
    covered |= F.coalesce(F.min(F.when(base, F.col("start"))).over(later) < F.col("end"), F.lit(False))
    covered |= F.coalesce(F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(doc.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False))
    rows = rows.withColumn("kind", F.when(base | ~covered, F.col("kind")))
    # each role's last part before this one and first after it; the frame ends before the row itself
    scope, until = Window.partitionBy("doc_id", "text_key", "scope"), (Window.unboundedPreceding, -1)
    onward, backward = scope.orderBy("start", "pass", "end").rowsBetween(*until), scope.orderBy(F.desc("start"), F.desc("pass"), F.desc("end")).rowsBetween(*until)
    for role, kinds in ROLES.items():
        part = F.when(F.col("kind").isin(*kinds), F.struct("start", "end", "kind", "value"))
        rows = rows.withColumn(f"{role}_before", F.last(part, ignorenulls=True).over(onward)).withColumn(f"{role}_after", F.last(part, ignorenulls=True).over(backward))
    for role in ROLES:
        before, after = F.col(f"{role}_before"), F.col(f"{role}_after")
        nearer = before.isNotNull() & (after.isNull() | (F.col("start") - before["end"] <= after["start"] - F.col("end")))
        rows = rows.withColumn(role, F.when(nearer, before).otherwise(after)).drop(before, after)
    kind, has = F.col("kind"), lambda role: F.col(role).isNotNull()
    complete = ((kind == "weak_access") & has("secret")) | ((kind == "weak_assign") & (has("identifier") | has("endpoint"))) | ((kind == "weak_token") & has("identifier")) | ((kind == "endpoint") & has("identifier") & has("secret"))
    return rows.withColumn("reported", F.coalesce(base | complete, F.lit(False)))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.when(F.col("reported"), F.struct("start", order.alias("order"), F.concat_ws(":", "kind", "start", "end").alias("span")))
    rows = linked(docs).groupBy("doc_id", "text_key").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS[:3]),
        F.array_sort(F.collect_list(span)).alias("found"),
        F.max("copies").alias("copies"),
    )
    joined = lambda found: F.array_join(F.transform(found, lambda x: x["span"]), ",")
    base = F.filter("found", lambda x: x["order"] <= 3)
    out = rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("long").alias("n_linked"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def credentials(docs: DataFrame) -> DataFrame:
    """A row for each reported span: doc_id, start, end, kind, value, scope, and the identifier,
    secret and endpoint that it is linked with (see linked)."""
    return linked(docs).where("reported").select("doc_id", "start", "end", "kind", "value", "scope", *ROLES)
