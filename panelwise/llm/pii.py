"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Candidates are found by one pattern and validated: card numbers by their check digit,
dates by the calendar, addresses and numbers by the ranges of their parts.  A valid
value is an index into the set of all values of its format; the set has A * B members,
and a Feistel network over the two parts of the index permutes it.  The permuted index
is written in the form of the original, so the result is again a valid value of the
same form, equal values get equal pseudonyms in all documents, and different values
different ones.  E-mail addresses have no such index; their parts are replaced by keyed
hashes.

    card     first digit kept, the others permuted, check digit computed anew
    date     a day of the 400 years from 1700 on; one day has one pseudonym in all forms
    ip       the 32 bits of an IPv4 address
    phone    country code kept; ten-digit numbers stay valid in area and exchange code
    ssn      area, group and serial number in their ranges

Only DataFrame expressions are used, in one pass without a shuffle: the text is cut at
the matches, the matches are replaced, and the pieces are put together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.base import fresh, quoted, without

OUT = ("pseudonymised", "pii")
ROUNDS = 10

# Forms of the values, in the order in which they are tried.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
DATE = r"(?<![\d./-])(?:\d{4}([-/])\d{1,2}\2\d{1,2}|\d{1,2}([./])\d{1,2}\3\d{4})(?![\d/-]|\.\d)"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\4\d{4}\4\d{1,7}|\d{4}([ -])\d{6}\5\d{5})(?!\d)"
PHONE = r"(?<![\d+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-](?=\d{3}[.-]))\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
FORMS = {"email": EMAIL, "date": DATE, "ip": IP, "ssn": SSN, "card": CARD, "phone": PHONE}
PATTERN = f"({'|'.join(FORMS.values())})"

FIRST_DAY, DAYS = "1700-01-01", (5411, 27)  # 146,097 days are 400 years


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(x: Column, left: Column | int, right: Column | int, key: str, form: str) -> Column:
    """Keyed permutation of the whole numbers from 0 to left * right - 1."""
    a, b = (F.lit(n).cast("long") if isinstance(n, int) else n for n in (left, right))

    def mixed(round_: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(form), a, b, round_, half), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + F.pmod(mixed(i, acc["r"]), a), a)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(mixed(i, acc["l"]), b), b)).alias("r"),
        )

    start = F.struct(((x - F.pmod(x, b)) / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["l"] * b + acc["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _padded(x: Column, width: Column | int) -> Column:
    return F.lpad(x.cast("string"), F.lit(width) if isinstance(width, int) else width, F.lit("0"))


def _filled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced one by one."""
    gaps = F.split(form, "[0-9]", -1)
    return F.array_join(
        F.transform(gaps, lambda gap, i: F.concat(gap, F.substring(digits, i + 1, F.lit(1)))), ""
    )


def _check_sum(digits: Column, doubled_first: bool) -> Column:
    """Sum of the digits from the right, every second one doubled (and its digits added)."""
    odd = 0 if doubled_first else 1
    one = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: let(c.cast("int") * F.when(i % 2 == odd, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0)),
    )
    return F.aggregate(one, F.lit(0), lambda a, d: a + d)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def _decimal(digits: Column, key: str, form: str) -> Column:
    """Digits permuted among all digits of the same number."""
    n = F.length(digits)
    high = F.floor((n + 1) / 2)
    return F.when(n > 0, _padded(feistel(digits.cast("long"), _power(high), _power(n - high), key, form), n)).otherwise(digits)


def _card(m: Column, key: str) -> Column:
    def replaced(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _decimal(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        checked = let(body, lambda x: F.concat(x, F.pmod(10 - _check_sum(x, True) % 10, F.lit(10)).cast("string")))
        return F.when(_check_sum(d, False) % 10 == 0, _filled(m, checked))

    return let(_digits(m), replaced)


def _date(m: Column, key: str) -> Column:
    part = lambda n: F.get(F.split(m, "[-/.]"), F.lit(n))
    year_first = F.length(part(0)) == 4
    day_first = m.contains(".")
    as_iso = lambda y, mo, d: F.concat_ws("-", y, _padded(mo, 2), _padded(d, 2)).try_cast("date")
    usual, other = as_iso(part(2), part(0), part(1)), as_iso(part(2), part(1), part(0))
    day = F.when(year_first, as_iso(part(0), part(1), part(2))).when(day_first, other).otherwise(F.coalesce(usual, other))
    by_month = ~day_first & usual.isNotNull()

    def written(x: Column) -> Column:
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(x, *DAYS, key, "date").cast("int"))
        two = F.least(F.length(part(1)), F.length(F.when(year_first, part(2)).otherwise(part(0)))) == 2
        year, (month, date) = F.date_format(new, "yyyy"), (F.when(two, F.date_format(new, f * 2)).otherwise(F.date_format(new, f)) for f in "Md")
        parts = F.when(year_first, F.array(year, month, date)).when(by_month, F.array(month, date, year)).otherwise(F.array(date, month, year))
        joined = F.when(m.contains("-"), F.array_join(parts, "-")).when(day_first, F.array_join(parts, ".")).otherwise(F.array_join(parts, "/"))
        return F.when((x >= 0) & (x < DAYS[0] * DAYS[1]), joined)

    return let(F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long"), written)


def _ip(m: Column, key: str) -> Column:
    part = lambda n: F.get(F.split(m, r"\."), F.lit(n)).cast("long")
    number = ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)
    valid = (part(0) < 256) & (part(1) < 256) & (part(2) < 256) & (part(3) < 256)
    dotted = lambda x: F.concat_ws(".", *[F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    return F.when(valid, let(feistel(number, 65536, 65536, key, "ip"), dotted))


def _ssn(m: Column, key: str) -> Column:
    def replaced(d: Column) -> Column:
        area, group, serial = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

        def digits(x: Column) -> Column:
            new = F.floor(x / (99 * 9999))
            new = new + F.when(new >= 665, 2).otherwise(1)
            return F.concat(_padded(new, 3), _padded(F.pmod(F.floor(x / 9999), F.lit(99)) + 1, 2), _padded(F.pmod(x, F.lit(9999)) + 1, 4))

        return F.when(valid, _filled(m, let(feistel(index, 898 * 99, 9999, key, "ssn"), digits)))

    return let(_digits(m), replaced)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+(\d{1,3})(?=\D)", 1)

    def replaced(d: Column) -> Column:
        own = F.substring(d, F.length(country) + 1, F.length(d))
        area, exchange, line = (F.substring(own, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
        ten = (F.length(own) == 10) & (area >= 200) & (exchange >= 200)
        index = ((area - 200) * 800 + exchange - 200) * 10000 + line

        def digits(x: Column) -> Column:
            return F.concat(
                (F.floor(x / 8000000) + 200).cast("string"), (F.pmod(F.floor(x / 10000), F.lit(800)) + 200).cast("string"), _padded(F.pmod(x, F.lit(10000)), 4)
            )

        new = F.when(ten, let(feistel(index, 80000, 80000, key, "phone"), digits)).otherwise(_decimal(own, key, "phone"))
        return F.when(F.length(d).between(7, 15), _filled(m, F.concat(country, new)))

    return let(_digits(m), replaced)


def _email(m: Column, key: str) -> Column:
    def name(part: Column, size: int) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(part)), 256)
        return F.translate(F.substring(digest, 1, size), "0123456789", "ghijklmnop")

    return F.concat(name(m, 12), F.lit("@"), name(F.substring_index(m, "@", -1), 8), F.lit(".example"))


KINDS = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def _replaced(match: Column, key: str) -> Column:
    """(kind, text) of a match: the first form that fits whole and is valid, or no kind and the match."""
    kind, text = F, F
    for name, value in KINDS.items():
        back = {"date": (r"\2", r"\1"), "card": (r"\4", r"\1")}.get(name)
        form = FORMS[name].replace(*back) if back else FORMS[name]
        form = form.replace(r"\3", r"\2") if name == "date" else form.replace(r"\5", r"\2")
        fits = match.rlike(f"^(?:{form})$")
        new = value(match, key)
        kind, text = kind.when(fits & new.isNotNull(), F.lit(name)), text.when(fits & new.isNotNull(), new)
    return F.struct(kind.otherwise(F.lit(None)).alias("kind"), match.alias("value"), text.otherwise(match).alias("text"))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows with ``pseudonymised`` (the text with valid values replaced) and ``pii``.

    ``pii`` lists the found values in order: kind, value and pseudonym.  What looks like
    a value but is not valid stays as it is.  A null text stays null with an empty list;
    repeated rows get the same answer.  Input columns named like an added one are
    replaced.  An empty table gives an empty result.
    """
    docs = without(docs, *OUT)
    (own,) = fresh(docs, "found")
    text = quoted(text_col)
    can = text.rlike("[0-9@]")
    matches = F.when(can, F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: _replaced(m, key)))
    found = docs.withColumn(own, F.coalesce(matches, F.array().cast("array<struct<kind: string, value: string, text: string>>")))
    gaps = F.split(text, PATTERN, -1)
    joined = F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(own, i)["text"], F.lit("")))), "")
    return found.select(
        *map(quoted, docs.columns),
        F.when(F.size(own) > 0, joined).otherwise(text).alias("pseudonymised"),
        F.filter(own, lambda x: x["kind"].isNotNull()).alias("pii"),
    )
