"""Personal data in text: regular expressions propose, checksums confirm, context words adjust.

Native: DataFrame functions only. A kind's matches come from ``regexp_extract_all``; splitting the
text by the same pattern gives the gaps between them, so running sums of both lengths are the
positions, in code points. The patterns are possessive forms of the plain ones and start only where
a run of their characters starts (or where the last match ended): they find the same matches, but
cannot backtrack or recurse over long runs. An IBAN's pattern finds only its head: what follows may be a
word or a number of the text, so each end at a word boundary is tried and the checksum decides.

What stands around a match is read from the text's blocks (``BLOCK`` code points each), never by walking the text
from its start, so a text's cost grows with its length whatever the number of its matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import boxed, unboxed, with_running


@dataclass(frozen=True)
class Kind:
    """One kind of span: pattern, cheap test that a text can hold it, its validator, context words and scores."""

    name: str
    pattern: str
    hint: str
    base: float
    confirmed: float
    context: tuple[str, ...]
    threshold: float = 0.0


#: Fixed patterns: what counts as each kind. The first four are the base kinds and are never dropped by score.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, 0.8, ("mail", "contact", "write")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, 0.7, ("ip", "host", "server", "address")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.3, 0.8, ("card", "visa", "credit", "payment", "pay")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, 0.7, ("phone", "tel", "call", "mobile", "fax")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", "", 0.3, 0.9, ("iban", "account", "bank", "transfer"), 0.5),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, 0.3, ("ssn", "social", "security"), 0.5),
)
BASE = ("email", "ip", "card", "phone")
#: What a context word within this many code points before a span adds to its score.
NEAR, BONUS = 40, 0.3
#: Code points of the longest IBAN with a space before each character after its head, and one more.
WINDOW = 65
#: Code points of a block of a long text.
BLOCK = 2048


def blocks_of(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` code points."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` (from 0) to ``end`` (exclusive) of the text in ``blocks``; what lies beyond the text is left out."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    whole = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(whole, (start - first * BLOCK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    def add(s, i):
        d = F.substring(digits, -i, 1).cast("int")
        d = F.when(i % 2 == 0, d * 2).otherwise(d)
        return s + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """The IBAN check: country and check digits moved to the end, letters as 10..35, remainder 1."""
    turned = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))

    def add(s, i):
        c = F.ascii(F.substring(turned, i, 1))
        return F.when(c < 58, (s * 10 + (c - 48)) % 97).otherwise((s * 100 + (c - 55)) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


#: Characters of an IBAN by country, as registered. Other countries' may have any length from 15 to 34.
LENGTHS = {
    n: codes.split()
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}


def iban(window: Column) -> Column:
    """The IBAN that ``window`` starts with, else an empty string: of the ends that the checksum confirms, the country's own, or else the last."""
    run = F.regexp_extract(window, r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", 0)
    country = F.substring(window, 1, 2)
    own = F.lit(0)
    for n, codes in LENGTHS.items():
        own = F.when(country.isin(codes), n).otherwise(own)

    def end(p: Column) -> Column:
        bare = F.replace(F.substring(run, F.lit(1), p), F.lit(" "), F.lit(""))
        return F.struct((F.length(bare) == own).alias("own"), p.alias("p"))

    def fits(p: Column) -> Column:
        whole = ~F.substring(run, p, F.lit(1)).eqNullSafe(" ") & ~F.substring(window, p + 1, F.lit(1)).rlike("[A-Za-z0-9]")
        bare = F.replace(F.substring(run, F.lit(1), p), F.lit(" "), F.lit(""))
        return F.when(whole & (F.length(bare) >= 15), mod97(bare)).otherwise(F.lit(False))

    ends = F.transform(F.filter(F.sequence(F.lit(15), F.length(run)), fits), end)
    return F.when(F.length(run) >= 15, F.coalesce(F.substring(run, F.lit(1), F.array_max(ends)["p"]), F.lit(""))).otherwise(F.lit(""))


def reached(df: DataFrame, out: str, spans: str) -> DataFrame:
    """``df`` with, for each of the column ``spans``, the largest end of those before it (0 for the first)."""
    return with_running(df, {out: F.transform(spans, lambda x: x["end"])}, lambda a, b: F.greatest(a, b))


def apart(df: DataFrame, spans: str) -> DataFrame:
    """``df`` with the column ``spans``, in order of their starts, without those that lie inside what the ones before them reach."""
    pairs = F.arrays_zip(F.col(spans).alias("s"), F.col("_reach").alias("e"))
    own = F.transform(F.filter(pairs, lambda p: p["s"]["end"] > p["e"]), lambda p: p["s"])
    return reached(df, "_reach", spans).withColumn(spans, F.when(F.size(spans) > 1, own).otherwise(F.col(spans))).drop("_reach")


def confirmed(kind: str, m: Column) -> Column:
    """Whether a match passes its kind's validator."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return F.length(m) > 0
    if kind == "ssn":
        return ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    return F.lit(True)


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def with_spans(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with _spans_<kind> for each kind. Matches, gaps and positions are columns of their own, so that no pattern runs twice."""
    may = lambda k: F.contains(text, F.lit(k.hint)) if k.hint else text.rlike("[0-9]")
    none = F.array().cast("array<string>")
    matches, gaps, at = ({k: f"_{what}_{k.name}" for k in KINDS} for what in ("matches", "gaps", "at"))
    df = df.withColumns({matches[k]: F.when(may(k), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none) for k in KINDS})
    df = df.withColumns({gaps[k]: F.when(F.size(matches[k]) > 0, F.split(text, k.pattern, -1)).otherwise(none) for k in KINDS})

    def steps(k: Kind) -> Column:
        """Lengths of gap 0, match 0, gap 1, match 1, .."""
        pairs = F.zip_with(gaps[k], matches[k], lambda g, m: F.array(F.length(g), F.coalesce(F.length(m), F.lit(0))))
        return F.transform(F.flatten(pairs), lambda n: n.cast("long"))

    some = F.greatest(*[F.size(matches[k]) for k in KINDS]) > 0
    df = with_running(df, {at[k]: steps(k) for k in KINDS}, lambda s, x: s + x).withColumn("_blocks", F.when(some, blocks_of(text)).otherwise(none))
    blocks = F.col("_blocks")

    def spans(k: Kind) -> Column:
        words = "|".join(k.context)

        def scored(m: Column, i: Column) -> Column:
            start = F.element_at(at[k], (i * 2 + 2).cast("int"))
            if k.name == "iban":
                m = iban(piece(blocks, start, start + WINDOW))
            before = piece(blocks, F.greatest(start - NEAR, F.lit(0)), start)
            near = before.rlike(rf"(?i)(?<![a-z])(?:{words})")
            score = F.lit(k.confirmed) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0))
            return F.struct(F.lit(k.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), F.least(score, F.lit(1.0)).alias("score"), confirmed(k.name, m).alias("ok"))

        found = F.filter(F.transform(matches[k], scored), lambda s: s["ok"] & (s["score"] >= k.threshold))
        bare = F.transform(found, lambda s: F.struct(*[s[x].alias(x) for x in ("kind", "start", "end", "score")]))
        return F.when(F.size(matches[k]) > 0, bare).otherwise(F.array().cast(SPANS))

    df = df.withColumns({f"_spans_{k.name}": spans(k) for k in KINDS})
    df = apart(df, "_spans_iban")
    return df.drop("_blocks", *matches.values(), *gaps.values(), *at.values())


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row as the struct ``_row``, its ``text`` (null: empty) and ``spans``: kind, start, end (code points, end exclusive), score; by kind, then start.

    Null and empty texts have no spans; repeated rows stay; names of the columns in ``_row`` don't matter.
    """
    df = with_spans(boxed(docs, text=F.coalesce(F.col(text_col), F.lit(""))), F.col("text"))
    return df.select("_row", "text", F.concat(*[F.col(f"_spans_{k.name}") for k in KINDS]).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, checksum of the base spans, and all spans as text, for each row."""
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).withColumn("doc_id", F.col("_row.doc_id"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one, named after the first.

    Texts without spans, null ones too, stay as they are.
    """
    found = find(docs, text_col)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # a span that begins before the reach of those before it adds nothing but its own reach
    heads = F.filter(F.arrays_zip(F.col("_ordered").alias("s"), F.col("_reach").alias("e")), lambda p: p["s"]["start"] >= p["e"])
    lead = lambda p: F.concat(piece(F.col("_blocks"), p["e"], p["s"]["start"]), F.lit("["), F.upper(p["s"]["kind"]), F.lit("]"))
    last = F.array_max(F.transform("_ordered", lambda s: s["end"]))
    clean = F.concat(F.array_join(F.transform("_heads", lead), ""), piece(F.col("_blocks"), last, F.greatest(last, F.length("text").cast("long"))))
    found = found.withColumns({"_ordered": ordered, "_blocks": F.when(F.size("spans") > 0, blocks_of(F.col("text")))})
    found = reached(found, "_reach", "_ordered").withColumn("_heads", heads)
    return unboxed(found, docs.columns, **{text_col: F.when(F.size("spans") == 0, F.col("_row").getField(text_col)).otherwise(clean)})
