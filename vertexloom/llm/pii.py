"""Personal data and secrets in texts, by Spark SQL functions alone.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for bank accounts,
ranges of numbers), and words just before a span raise its score. Four kinds are the base: each of
their confirmed spans stays, whatever its score. The further kinds need a score of LEAST, which
numbers that could be anything only reach by a word of their context.

A text is split at the matches of a pattern, so a match's place is the running total of the pieces
before it, and its context the end of the piece before it: linear in the text, however many matches
it has. Patterns begin only where a match can begin and never give back what they took, so a text
that almost matches everywhere is scanned once, too, and without recursion.

Spans are in code points from 0, ends exclusive, by kind in the order of KINDS, then by start; those
of different kinds may overlap, as those of a card and of a phone do. A secret's span is its value.

Cases: null and empty texts have no spans; very long texts are searched whole; repeated rows are
answered alike; a null id is an id like any other; an empty table gives no rows; further columns
pass through `find_pii` and `redact`, and one named `pii` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least score of a span of a further kind.
LEAST = 0.8
#: Code points before a span that are its context, and what a context word adds.
NEAR, CONTEXT = 40, 0.45
#: Elements whose running total is made at once.
BLOCK = 256


class Kind(NamedTuple):
    """plain: the pattern as stated, for SQL engines without lookbehind; `pattern` matches the same spans in one pass."""

    name: str
    pattern: str
    plain: str
    valid: Callable[[Column, Column, Column], Column]  # of match, piece before, piece after
    score: float
    words: str  # context, in lower case
    base: bool = False
    value: str = ""  # what of the match is the span: an end of it


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a bank account number of capitals and digits passes the mod 97 check."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _alone(before: Column, after: Column, no: str = "[A-Za-z0-9]") -> Column:
    return ~(F.right(before, F.lit(1)).rlike(no) | F.left(after, F.lit(1)).rlike(no))


def _card(m: Column, _before: Column, _after: Column) -> Column:
    number = digits(m)
    return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)


def _iban(m: Column, before: Column, after: Column) -> Column:
    return _alone(before, after) & mod97(F.translate(m, " ", ""))


def _ssn(m: Column, before: Column, after: Column) -> Column:
    return _alone(before, after, "[A-Za-z0-9-]") & ~m.rlike("^(000|666|9)|-00-|-0000$")


def _local(_m: Column, before: Column, after: Column) -> Column:
    return _alone(before, after, "[A-Za-z0-9-]") & ~F.right(before, F.lit(5)).rlike(r"\+[0-9 ]*$")


def _secret(m: Column, before: Column, _after: Column) -> Column:
    value = F.regexp_extract(m, r"""[^ \t-\r"']+$""", 0)
    return ~F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_IBAN = r"[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)"
_SSN, _TEN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
_SECRET = r"""AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api[_-]?key)["']?[ \t]*[:=][ \t]*["']?[^ \t-\r"']{8,}"""
_TELEPHONE = r"tel|phone|fax|mobile|handy|llama|appel|call|téléphone|teléfono"
_ALWAYS = lambda m, _before, _after: F.lit(True)

KINDS = [
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++", rf"{_LOCAL}+@{_DOMAIN}+(\.{_DOMAIN}+)+", _ALWAYS, 0.9, "mail", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, _b, _a: m.rlike(rf"^{_BYTE}(\.{_BYTE}){{3}}$"), 0.5, r"\bip\b|address|adresse|dirección|host|server", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", _card, 0.5, "card|carte|karte|tarjeta|visa|credit", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, _b, _a: F.length(digits(m)).between(9, 15), 0.5, _TELEPHONE, True),
    Kind("iban", _IBAN, _IBAN, _iban, 0.9, "iban|konto|compte|cuenta|account"),
    Kind("ssn", _SSN, _SSN, _ssn, 0.4, r"\bssn\b|social security|sécurité sociale|seguridad social|sozialversicherung"),
    Kind("local_phone", _TEN, _TEN, _local, 0.4, _TELEPHONE),
    Kind("secret", _SECRET, _SECRET, _secret, 0.8, "key|secret|credential", value=r"""[^ \t-\r"']+$"""),
]

SPAN = "struct<kind:string,start:int,end:int,score:double,base:boolean>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once, however often and in whatever loops body has it."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column) -> Column:
    """The sums of the first 1, 2, ... of an array of whole numbers: block by block, as adding to an array copies it."""

    def totals(x: Column) -> Column:
        none = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        add = lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["all"], F.array(a["sum"] + v)).alias("all"))
        return F.aggregate(x, none, add, lambda a: a["all"])

    def joined(blocks: Column) -> Column:
        before = totals(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(before, lambda low: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda v: v + F.when(i == 0, 0).otherwise(F.get(low, i - 1))))))

    def cut(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        return F.transform(starts, lambda i: totals(F.slice(x, i * BLOCK + 1, BLOCK)))

    return let(numbers, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(cut(x), joined)))


class Matches(NamedTuple):
    """A text in pieces: found[i] stands between pieces[i] and pieces[i + 1]."""

    pieces: Column
    found: Column

    def accepted(self, kind: Kind, m: Column, i: Column) -> tuple[Column, Column]:
        """Whether the i-th match stays, and its score."""
        before, after = F.get(self.pieces, i), F.get(self.pieces, i + 1)
        near = F.lower(F.right(before, F.lit(NEAR))).rlike(kind.words)
        score = F.when(near, min(1.0, kind.score + CONTEXT)).otherwise(kind.score)
        valid = kind.valid(m, before, after)
        return valid if kind.base else valid & (score >= LEAST), score


def _over(kind: Kind, text: Column, body: Callable[[Matches], Column], otherwise: Column) -> Column:
    halves = F.struct(F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(kind.pattern), let(halves, lambda x: body(Matches(x["pieces"], x["found"])))).otherwise(otherwise)


def spans_of(kind: Kind, text: Column) -> Column:
    """The array of a kind's spans in a text that isn't null."""

    def found(x: Matches) -> Column:
        steps = F.transform(x.found, lambda m, i: F.length(F.get(x.pieces, i)) + F.when(i > 0, F.length(F.get(x.found, i - 1))).otherwise(0))

        def span(at: Column, m: Column, i: Column) -> Column:
            keep, score = x.accepted(kind, m, i)
            end = F.get(at, i) + F.length(m)
            start = end - F.length(F.regexp_extract(m, kind.value, 0)) if kind.value else F.get(at, i)
            return F.when(keep, F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"), F.lit(kind.base).alias("base")))

        every = let(running(steps), lambda at: F.transform(x.found, lambda m, i: span(at, m, i)))
        return F.filter(every, lambda s: s.isNotNull())

    return _over(kind, text, found, F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame, kinds: list[Kind] = KINDS, text: str = "text") -> DataFrame:
    """The documents with `pii`, an array of (kind, start, end, score, base)."""
    return docs.withColumn("pii", F.concat(*[spans_of(k, F.coalesce(text, F.lit(""))) for k in kinds]))


def redact(docs: DataFrame, kinds: list[Kind] = KINDS, text: str = "text") -> DataFrame:
    """The documents with each span that stays replaced by its kind in angle brackets, one kind after the other; a null text stays null."""

    def without(kind: Kind) -> Callable[[Column], Column]:
        def tag(x: Matches, m: Column, i: Column) -> Column:
            whole = F.regexp_replace(m, kind.value, f"<{kind.name}>") if kind.value else F.lit(f"<{kind.name}>")
            return F.concat(F.get(x.pieces, i), F.when(x.accepted(kind, m, i)[0], whole).otherwise(m))

        join = lambda x: F.concat(F.array_join(F.transform(x.found, lambda m, i: tag(x, m, i)), ""), F.element_at(x.pieces, -1))
        return lambda t: _over(kind, t, join, t)

    out = F.col(text)
    for k in kinds:
        out = let(out, without(k))
    return docs.withColumn(text, out)


def pii_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = find_pii(docs.select("doc_id", "text")).drop("text")
    base = [k.name for k in KINDS if k.base]
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, base), F.sha2(told(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"), told("pii").alias("spans"))
