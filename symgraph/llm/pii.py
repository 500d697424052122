"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Words within REACH code points before or after a span add to its score, or take from it. What an IBAN's pattern takes too much (a word
in capitals after it) is cut off at the length that its country gives IBANs, before the checksum. Built-in functions only. Positions count code points from 0, ends are exclusive.

Defined cases: a null text counts as empty and has no spans; repeated rows are judged one by one; other columns of the
input pass through untouched, and the operator's own column is named by the caller so that it cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    guard: a cheap pattern without which no match is possible. pattern: proposes spans; written so that a long run of
    its characters is entered at its start only (linear time) and repeats without recursion. base: the score of a
    confirmed span; context: words nearby that raise it; against: words that lower it. always: kept whatever its score.
    """

    name: str
    guard: str
    pattern: str
    base: float
    context: str
    always: bool = True
    against: str = ""


#: Words of numbers that are no personal data.
_OTHER = "isbn|ean|sku|barcode|serial|checksum|tracking"

KINDS = (
    Kind("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", 0.8, "mail|contact|write"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|address|host|server|adresse"),
    Kind("card", "[0-9][ -]?[0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", 0.7, "card|visa|credit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|anruf"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", 0.6, "iban|bank|account|konto|compte|cuenta", False, _OTHER),
    Kind("short_card", "[0-9][ -]?[0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])", 0.4, "card|visa|credit|amex|carte|karte|tarjeta", False, _OTHER),
)
#: Kinds whose spans the query contract fixes, in its order.
BASE_KINDS = tuple(k.name for k in KINDS if k.always)
#: A span of the other kinds is kept from this score on.
KEEP = 0.5
#: How many characters IBANs have, by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 "
    "GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 "
    "PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()
#: Context words count within so many code points of a span, and add or take so much.
REACH, CONTEXT = 40, 0.2
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(s: Column) -> Column:
    return F.translate(s, " ().-+", "")


def luhn(s: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(s), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an IBAN, blanks left out, leaves 1 modulo 97 (its first four characters moved to the end)."""
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value >= 65, (acc * 100 + value - 55) % 97).when(value >= 48, (acc * 10 + value - 48) % 97).otherwise(acc)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind in ("card", "short_card"):
        return luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    if kind == "iban":
        return mod97(F.translate(s, " ", "")) & F.length(F.translate(s, " ", "")).between(15, 34)
    return F.lit(True)


def _own(kind: Kind, s: Column) -> Column:
    """What of a proposed span is judged and, if confirmed, returned: of an IBAN its country's length, if a blank follows there."""
    if kind.name != "iban":
        return s
    lengths = F.create_map(*[F.lit(x) for c in IBAN_LENGTHS for x in (c[:2], int(c[2:]))])
    n = F.try_element_at(lengths, F.left(s, F.lit(2)))
    cut = F.call_function("regexp_extract", s, F.concat(F.lit("^(?:[A-Z0-9] ?){"), (n - 1).cast("string"), F.lit("}[A-Z0-9](?![A-Z0-9])")), F.lit(0))
    return F.when(n.isNull(), s).otherwise(cut)


def _rest(kind: Kind, s: Column) -> Column:
    """What of a proposed span follows its own part."""
    return F.substr(s, F.length(_own(kind, s)) + 1) if kind.name == "iban" else F.lit("")


def _score(kind: Kind, before: Column, after: Column) -> Column:
    """The score of a confirmed span between two stretches of text."""
    near = lambda words: F.lower(F.right(before, F.lit(REACH))).rlike(rf"\b(?:{words})") | F.lower(F.left(after, F.lit(REACH))).rlike(rf"\b(?:{words})")
    out = F.lit(kind.base) + F.when(near(kind.context), F.lit(CONTEXT)).otherwise(0.0)
    return out - F.when(near(kind.against), F.lit(CONTEXT)).otherwise(0.0) if kind.against else out


_BLOCK = 256
_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind, in order: pieces between matches give the positions by running sums."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    none = F.array().cast("array<struct<s:string,start:int,p:string,a:string>>")

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        new = F.struct(x["m"].alias("s"), start.alias("start"), x["near"].alias("p"), x["after"].alias("a"))
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["got"], F.array(new)).alias("got"))

    between = F.zip_with(F.slice(pieces, 1, F.size(found)), F.slice(pieces, 2, F.size(found)), lambda p, a: F.struct(p.alias("p"), F.left(a, F.lit(REACH)).alias("after")))
    paired = F.zip_with(between, found, lambda b, m: F.struct(b["p"].alias("p"), F.right(b["p"], F.lit(REACH)).alias("near"), b["after"].alias("after"), m.alias("m")))
    # Growing an array copies it, so the sums run within blocks, and over the blocks: time stays near linear.
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(_BLOCK)), lambda i: F.slice(paired, i + 1, _BLOCK))
    ends = F.aggregate(
        F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + F.length(x["p"]) + F.length(x["m"]))),
        F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)),
    )
    zero = lambda at: F.struct(at.alias("at"), none.alias("got"))
    placed = F.flatten(F.zip_with(blocks, F.slice(ends, 1, F.size(blocks)), lambda b, at: F.aggregate(b, zero(at), place, lambda acc: acc["got"])))
    owned = placed if kind.name != "iban" else F.transform(placed, lambda x: F.struct(_own(kind, x["s"]).alias("s"), x["start"].alias("start"), x["p"].alias("p"), F.concat(_rest(kind, x["s"]), x["a"]).alias("a")))
    scored = F.transform(
        F.filter(owned, lambda x: _confirmed(kind.name, x["s"])),
        lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["s"])).alias("end"), _score(kind, x["p"], x["a"]).alias("score")),
    )
    kept = scored if kind.always else F.filter(scored, lambda x: x["score"] >= KEEP)
    return F.when(text.rlike(kind.guard), kept).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def find_personal_data(docs: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """``docs`` with column ``into``: an array of (kind, start, end, score), by kind as in KINDS, then by start."""
    return docs.withColumn(into, F.concat(*[spans_of(text_of(text), k) for k in KINDS]))


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, in column ``text`` every confirmed span replaced by its kind in angle brackets, one kind after another.

    Each kind is a projection of its own: nested in one expression, the text so far would be computed anew at each use.
    """
    docs = docs.withColumn(text, text_of(text))
    for k in KINDS:
        docs = docs.withColumn(text, _masked(F.col(text), k))
    return docs


def _masked(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    tag = F.lit(f"<{kind.name.upper()}>")

    def masked(x: Column, m: Column) -> Column:
        own = _own(kind, m)
        ok = _confirmed(kind.name, own) if kind.always else _confirmed(kind.name, own) & (_score(kind, x["p"], F.concat(_rest(kind, m), x["a"])) >= KEEP)
        return F.concat(x["p"], F.when(m.isNull(), F.lit("")).when(ok, F.concat(tag, _rest(kind, m))).otherwise(m))

    between = F.zip_with(pieces, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, a: F.struct(p.alias("p"), F.coalesce(a, F.lit("")).alias("a")))
    parts = F.zip_with(between, found, masked)
    return F.when(text.rlike(kind.guard), F.array_join(parts, "")).otherwise(text)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the counts of the base kinds, base_sha256, spans, and the spans' scores, in their order."""
    found = find_personal_data(docs.select("doc_id", "text"), into="pii_spans")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count_of = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("pii_spans", lambda x: F.round(x["score"], 2).cast("string")), ",")
    return found.select("doc_id", *map(count_of, BASE_KINDS), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("pii_spans")).alias("spans"), scores.alias("scores"))
