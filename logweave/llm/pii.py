"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. Positions come from the lengths of what stands between matches. The patterns
never go back over a run of characters, so long runs cost no more than their length; that they find
what the plain patterns find, leftmost and without overlap, is tested.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions.text import let

# The kinds every result has, in this order
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Proposals that need a checksum or a word nearby
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)[\x20-]?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20-]?[0-9]{2,4}(?![0-9A-Za-z.-])"

_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d).between(16, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))


def mod_97(value: Column) -> Column:
    """Whether an account number of letters and digits leaves 1, its first four characters moved to the end."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    number = lambda c: F.instr(F.lit(_LETTERS), c) - 1
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda a, c: F.when(c == "", a).otherwise(F.pmod(F.when(number(c) < 10, a * 10).otherwise(a * 100) + number(c), F.lit(97))),
    )
    return (F.length(plain).between(15, 34)) & (rest == 1)


def _whole_account(value: Column) -> Column:
    """The longest beginning that ends with a group and passes mod-97; without one the value as it is."""
    def chosen(groups: Column) -> Column:
        begins = F.transform(F.sequence(F.size(groups), F.lit(1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
        return F.coalesce(F.get(F.filter(begins, mod_97), F.lit(0)), value)

    return let(F.split(value, " "), chosen)


class Kind(NamedTuple):
    name: str
    pattern: str
    needs: str | None  # plain text without which nothing can match
    valid: Callable[[Column], Column]
    checksum: bool = False
    base: bool = True
    words: str | None = None  # words nearby that raise the score
    part: Callable[[Column], Column] | None = None  # the part of a match that counts, from its start


KINDS = (
    Kind("email", EMAIL, "@", lambda v: F.lit(True), words="mail|contact|write"),
    Kind("ip", IP, ".", _small_parts, words="ip|host|address|server"),
    Kind("card", CARD, None, _card, checksum=True, words="card|visa|credit|payment"),
    Kind("phone", PHONE, "+", lambda v: F.length(digits(v)).between(8, 15), words="phone|tel|call|mobile|fax"),
    Kind("iban", IBAN, None, mod_97, checksum=True, base=False, words="iban|account|bank", part=_whole_account),
    Kind("ssn", SSN, "-", lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), base=False, words="ssn|social security"),
    Kind("local_phone", LOCAL_PHONE, None, lambda v: F.length(digits(v)).between(8, 12), base=False, words="phone|tel|telephone|call|mobile|fax"),
)

#: Score of a proposal, what a passed checksum and a word nearby add, and what an added kind needs.
START, CHECKSUM, CONTEXT, THRESHOLD = 0.4, 0.4, 0.3, 0.65
#: Characters before and after a span in which a context word counts.
BEFORE, AFTER = 40, 15
#: Characters of a piece of a long text, more than a context holds.
PIECE = 1024


def _running(steps: Column) -> Column:
    """Start of each match, for steps (b: characters before it since the last match, m: its length).

    Sums run inside stretches of about the square root of all steps, and over the stretches, so that no
    list grows by one step for every match of a long text.
    """
    def by_stretches(all_steps: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_steps) + F.lit(1))).cast("int")
        first = F.sequence(F.lit(1), F.greatest(F.size(all_steps), F.lit(1)), size)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def fold(stretch: Column) -> Column:
            return F.aggregate(stretch, zero, lambda a, s: F.struct((a["at"] + s["b"] + s["m"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + s["b"])).alias("starts")))

        def joined(stretches: Column) -> Column:
            before = F.aggregate(stretches, zero, lambda a, s: F.struct((a["at"] + s["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))["starts"]
            return F.flatten(F.zip_with(stretches, before, lambda s, x: F.transform(s["starts"], lambda at: at + x)))

        return let(F.transform(first, lambda i: fold(F.slice(all_steps, i, size))), joined)

    return let(steps, by_stretches)


def _located(text: Column, kind: Kind, found: Column) -> Column:
    """(start, end, value) of each match, from the lengths of the stretches between them."""
    between = F.transform(F.split(text, kind.pattern, -1), F.length)
    lengths = F.transform(found, F.length)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), lengths, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    values = F.transform(found, kind.part) if kind.part else found
    return F.zip_with(_running(steps), values, lambda s, v: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters: a place in a long text is found without going through all of it."""
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / PIECE).cast("int")
    return F.when(last == 0, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * PIECE + 1, F.lit(PIECE))))


def _cut(pieces: Column, begin: Column, size: Column) -> Column:
    """``size`` characters (at most PIECE) from the place ``begin`` on."""
    at = F.floor(begin / PIECE).cast("int")
    near = F.concat(F.coalesce(F.get(pieces, at), F.lit("")), F.coalesce(F.get(pieces, at + 1), F.lit("")))
    return F.substr(near, F.pmod(begin, F.lit(PIECE)) + 1, size)


def _score(pieces: Column, kind: Kind, span: Column) -> Column:
    begin = F.greatest(span["start"] - BEFORE, F.lit(0))
    around = F.lower(F.concat(_cut(pieces, begin, span["start"] - begin), F.lit(" "), _cut(pieces, span["end"], F.lit(AFTER))))
    context = F.when(around.rlike(rf"(?<![a-z])(?:{kind.words})(?![a-z])"), CONTEXT).otherwise(0.0)
    return F.lit(START + CHECKSUM * kind.checksum) + context


def _spans(text: Column, kind: Kind, found: Column) -> Column:
    def scored(pieces: Column, s: Column) -> Column:
        return F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            _score(pieces, kind, s).alias("score"), F.lit(kind.checksum).alias("checked"),
        )

    valid = F.filter(_located(text, kind, found), lambda s: kind.valid(s["value"]))
    spans = let(_pieces(text), lambda pieces: F.transform(valid, lambda s: scored(pieces, s)))
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double,checked:boolean>>")
    return F.when(F.size(found) > 0, spans).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """Add ``name``: array of (kind, start, end, value, score, checked), by kind as listed, then start.

    Positions are code points, the end exclusive. Kinds of the base list need their pattern and check
    alone; the others also need a checksum or a context word. A null or empty text has an empty array; an
    empty table gives no rows; a text of any length and any number of matches is searched whole. A column called ``name`` is replaced; all other columns and repeated rows stay.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    empty = F.array().cast("array<string>")
    wanted = {}
    for k in KINDS:
        found = F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0))
        wanted[f"_found_{k.name}"] = F.when(F.contains(body, F.lit(k.needs)), found).otherwise(empty) if k.needs else found
    out = docs.drop(name).withColumns(wanted)
    located = {f"_at_{k.name}": _spans(body, k, F.col(f"_found_{k.name}")) for k in KINDS}
    out = out.withColumns(located)
    helpers = [*wanted, *located]
    return out.withColumn(name, F.concat(*[F.col(f"_at_{k.name}") for k in KINDS])).drop(*helpers)


def span_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined in their order."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


BASE_KINDS = tuple(k.name for k in KINDS if k.base)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
