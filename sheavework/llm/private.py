"""Personal data: patterns propose spans, checksums confirm them, context words move the score. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import narrow, pack, unpack

# An address or number part may begin where the last match ended, or else not inside a run of its own characters; a search
# that starts in the middle of a run would find nothing new and take time with the square of the run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The added kinds propose just a start with enough behind it; what is taken from there is one of several lengths, longest first.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
SHORT_CARD = r"(?<![0-9])[0-9](?=(?:[\x20-]?[0-9]){12})"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_OTHER = f"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}"  # countries that are not listed may have any length
IBAN_TAKES = tuple(
    rf"^(?:{'|'.join([*IBAN_LENGTHS.get(n, '').split(), _OTHER])})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n in range(34, 14, -1)
)
SHORT_CARD_TAKES = tuple(rf"^[0-9](?:[\x20-]?[0-9]){{{n - 1}}}(?![0-9])" for n in (15, 14, 13))
AHEAD = 120  # characters behind a start: the longest number with its spaces, and the context behind it
WINDOW = 48  # characters of context on each side; of the base kinds, up to the neighbouring proposal
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap test that a text can hold it at all, the check of a match, and words that speak for it."""

    name: str
    pattern: str
    hint: Column
    valid: Callable[[Column], Column]
    base: bool
    prior: float
    words: str = ""
    least: float = 0.0
    takes: tuple[str, ...] = ()


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """True if the digits pass: every second one from the right doubled, digit sums added, modulo 10."""
    places = F.split(F.reverse(_digits(match)), "")
    value = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """True if an account number's letters and digits, the first four moved behind, leave 1 modulo 97."""
    plain = F.regexp_replace(match, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _n_digits(match: Column) -> Column:
    return F.length(_digits(match))


def _small_parts(match: Column) -> Column:
    """Every part at most 255; leading zeros count for nothing, and longer parts are too large without being read."""
    short = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def kinds(text: Column) -> list[Kind]:
    """Kinds in the order in which spans are listed; the first four are the base and hold whatever the context says."""
    has = lambda s: F.contains(text, F.lit(s))
    number = text.rlike("[0-9]")
    return [
        Kind("email", EMAIL, has("@"), lambda m: F.lit(True), True, 0.9, r"mail|contact|write|reach"),
        Kind("ip", IP, has(".") & number, _small_parts, True, 0.7, r"\bip\b|address|host|server|login"),
        Kind("card", CARD, number, lambda m: _n_digits(m).between(16, 19) & luhn(m), True, 0.8, r"card|credit|visa|master|pay|karte|carte|tarjeta"),
        Kind("phone", PHONE, has("+"), lambda m: _n_digits(m).between(8, 15), True, 0.7, r"phone|call|tel|mobile|fax"),
        Kind("iban", IBAN, text.rlike("[A-Z]{2}[0-9]{2}"), mod97, False, 0.8, r"iban|account|bank|konto|compte|cuenta", 0.5, IBAN_TAKES),
        Kind("short_card", SHORT_CARD, number, luhn, False, 0.3, r"card|credit|amex|diners|visa|karte|carte|tarjeta", 0.5, SHORT_CARD_TAKES),
    ]


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def found_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (text and others) with a column per kind: array of (start, stop, score) of its confirmed spans.

    Matches of a base kind are leftmost and do not overlap. Of the added kinds each start is tried, and the longest of
    its lengths that passes is taken, so a number next to other letters or digits is found; they may overlap. Positions are code points, the end exclusive. The pieces between
    the matches give the positions, so a text is walked twice per kind, whatever its length, and nothing is shuffled.
    """
    out = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    # Each step is a column of its own and is named outside of lambdas too: the optimizer would move a column that is used
    # once into the lambda that uses it, and compute it again for each element.
    for step in (_hits, _gaps, _sizes, _blocks, _heads, _ends, _confirmed):
        out = out.withColumns({name: column for k in kinds(F.col("text")) for name, column in [step(k)]})
    return out.drop(*[f"_{k.name}_{x}" for k in kinds(F.col("text")) for x in ("hits", "gaps", "sizes", "blocks", "heads", "ends")])


def _hits(k: Kind) -> tuple[str, Column]:
    nothing = F.array().cast("array<string>")
    return f"_{k.name}_hits", F.when(k.hint, F.regexp_extract_all("text", F.lit(k.pattern), 0)).otherwise(nothing)


def _gaps(k: Kind) -> tuple[str, Column]:
    return f"_{k.name}_gaps", F.when(F.size(f"_{k.name}_hits") > 0, F.split("text", k.pattern, -1))


def _sizes(k: Kind) -> tuple[str, Column]:
    hits, gaps = F.col(f"_{k.name}_hits"), F.col(f"_{k.name}_gaps")
    return f"_{k.name}_sizes", F.when(F.size(gaps) > 0, F.transform(hits, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))


def _blocks(k: Kind) -> tuple[str, Column]:
    """Sums of blocks of sizes; with them, running sums do not take time with the square of the matches."""
    sizes = F.col(f"_{k.name}_sizes")
    numbers = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    return f"_{k.name}_blocks", F.when(F.size(sizes) > 0, F.transform(numbers, lambda b: _total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))))


def _heads(k: Kind) -> tuple[str, Column]:
    blocks = F.col(f"_{k.name}_blocks")
    return f"_{k.name}_heads", F.when(F.size(blocks) > 0, F.transform(blocks, lambda x, i: _total(F.slice(blocks, F.lit(1), i))))


def _ends(k: Kind) -> tuple[str, Column]:
    sizes, heads = F.col(f"_{k.name}_sizes"), F.col(f"_{k.name}_heads")
    block = lambda i: F.floor(i / BLOCK).cast("int")
    ends = F.transform(sizes, lambda x, i: F.get(heads, block(i)) + _total(F.slice(sizes, block(i) * BLOCK + 1, i % BLOCK + 1)))
    return f"_{k.name}_ends", F.when(F.size(heads) > 0, ends)


def _confirmed(k: Kind) -> tuple[str, Column]:
    hits, gaps, ends = (F.col(f"_{k.name}_{x}") for x in ("hits", "gaps", "ends"))

    def around(i: Column, first: Column, last: Column, size: int) -> Column:
        """The pieces from ``first`` to ``last`` (gap and hit in turn), without the hit before which ``i`` ends; each cut to ``size`` at the far side."""
        return F.array_join(F.transform(F.sequence(first, last), lambda j: F.concat(F.substring(F.get(gaps, j), *((1, size) if size > 0 else (size, -size))), F.when((j == i) & F.lit(size < 0), F.lit("")).otherwise(F.coalesce(F.get(hits, j), F.lit(""))))), "")

    def taken(m: Column, i: Column) -> Column:
        # Starts are two characters or more apart, so these pieces hold the whole window.
        ahead = F.concat(m, around(i, i + 1, i + AHEAD // 2, AHEAD))
        back = F.substring(around(i, F.greatest(F.lit(0), i - WINDOW // 2), i, -WINDOW), -WINDOW, WINDOW)
        whole = F.filter(F.array(*[F.regexp_extract(ahead, take, 0) for take in k.takes]), lambda x: (x != "") & k.valid(x))
        return F.struct(F.get(whole, F.lit(0)).alias("match"), ahead.alias("ahead"), back.alias("back"), (F.get(ends, i) - F.length(m)).alias("start"))

    def scored(t: Column) -> Column:
        near = F.lower(F.concat(t["back"], F.lit(" "), F.substring(F.substr(t["ahead"], F.length(t["match"]) + 1), 1, WINDOW)))
        score = F.least(F.lit(1.0), F.lit(k.prior) + F.when(near.rlike(k.words), F.lit(0.25)).otherwise(F.lit(0.0)))
        return F.struct(t["start"].alias("start"), (t["start"] + F.length(t["match"])).alias("stop"), score.alias("score"))

    def span(m: Column, i: Column) -> Column:
        near = F.lower(F.concat(F.substring(F.get(gaps, i), -WINDOW, WINDOW), F.lit(" "), F.substring(F.get(gaps, i + 1), 1, WINDOW)))
        score = F.least(F.lit(1.0), F.lit(k.prior) + F.when(near.rlike(k.words), F.lit(0.25)).otherwise(F.lit(0.0)))
        whole = F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("stop"), score.alias("score"))
        return F.when(k.valid(m) & (F.lit(k.base) | (score >= k.least)), whole)

    if k.takes:
        found = F.filter(F.transform(hits, taken), lambda t: t["match"].isNotNull())
        good = F.filter(F.transform(found, scored), lambda s: s["score"] >= k.least)
    else:
        good = F.filter(F.transform(hits, span), lambda s: s.isNotNull())
    kind = "array<struct<start:int,stop:int,score:double>>"
    return k.name, F.when(F.size(hits) > 0, good.cast(kind)).otherwise(F.array().cast(kind))


def _listed(names: list[str]) -> Column:
    def part(name: str) -> Column:
        return F.transform(name, lambda s: F.concat_ws(":", F.lit(name), s["start"].cast("string"), s["stop"].cast("string")))

    return F.array_join(F.concat(*[part(n) for n in names]), ",")


def private_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the base kinds, digest of the base spans, all spans, scores.

    Base spans are the confirmed matches of email, ip, card and phone, whatever their context. Account numbers that pass
    the modulo-97 check and card numbers of 13 to 15 digits that pass Luhn are added where the score, raised by context
    words, reaches 0.5. Null text counts as empty; a text without spans has empty lists; rows that repeat stay apart; extra
    columns are ignored.
    """
    names = [k.name for k in kinds(F.lit(""))]
    base = [k.name for k in kinds(F.lit("")) if k.base]
    found = found_spans(narrow(docs, "doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(n).cast("long").alias(f"n_{n}") for n in names],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(names).alias("spans"),
        F.array_join(F.concat(*[F.transform(n, lambda s: F.format_number(s["score"], 2)) for n in names]), ",").alias("scores"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each confirmed span, or run of overlapping spans, replaced by the name of its first kind in brackets.

    Other columns stay as they are; a text without spans stays the same string, null too.
    """
    names = [k.name for k in kinds(F.lit(""))]
    found = found_spans(pack(docs, ["text"]).withColumn("_own", F.col("text")))

    def named(name: str) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(name).alias("kind")))

    every = F.array_sort(F.concat(*[named(n) for n in names]))
    found = found.withColumn("_spans", every)
    # Cuts run from one span to the next; a span inside an earlier one adds nothing.
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice("_spans", F.lit(1), i), lambda s: s["stop"])), F.lit(0))
    marked = F.transform("_spans", lambda s, i: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), reach(i).alias("before")))
    found = found.withColumn("_marked", F.when(F.size("_spans") > 0, marked)).withColumn("_chars", F.when(F.size("_spans") > 0, F.split("text", "")))
    piece = lambda s: F.concat(
        F.array_join(F.slice("_chars", s["before"] + 1, F.greatest(F.lit(0), s["start"] - s["before"])), ""),
        F.when(s["start"] >= s["before"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")),
    )
    last = F.array_max(F.transform("_marked", lambda s: s["stop"]))
    tail = F.array_join(F.slice("_chars", last + 1, F.size("_chars")), "")
    text = F.when(F.size("_spans") > 0, F.concat(F.array_join(F.transform("_marked", piece), ""), tail)).otherwise(F.col("_own"))
    place = [c for c in docs.columns if c == "text"] or [c for c in docs.columns if c.lower() == "text"]
    at = f"c{docs.columns.index(place[0])}"
    return unpack(found.withColumn("_row", F.col("_row").withField(at, text)), docs)
