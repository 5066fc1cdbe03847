"""Format-preserving pseudonyms for personal data (DataFrame functions only).

Values are found by pattern, validated, and replaced by a keyed permutation of
their own format: a Feistel network over the two halves of the value, so equal
values get equal pseudonyms in every document, different values different ones,
and whoever holds the key can undo it.

kind    validated by                      permuted
card    13-19 digits, Luhn                all digits but the last; that is the new check digit
phone   +1 (NXX) NXX-XXXX and variants,   the ten national digits; N stays 2-9
        with or without the 1
ip      four octets up to 255             the 32-bit address
date    a day of the calendar 1900-2099,  the day within those 73,049 days; month first, within
        day first, else month first       those that can't be read day first
email   local part @ domain               letters and digits of the local part, each within
                                          its class; the domain stays

Blanks, dots, dashes, brackets and the order of a date's parts stay as they
were. What fails validation is left alone. Cards are looked for in runs of digit
groups: the whole run in any grouping, else from each group on the longest 13-19
digits that end with a group and pass Luhn, in groups of four digits or more but
for the last (shorter ones are tables of numbers). A run ends before a date, a phone number or a decimal. Without +1,
ten digits are a phone number in one piece or parted after the area code, or
by a dot or dash after the exchange.

Defined results: a null text stays null, an empty one empty; values are found
in whole texts, of any length, in time that grows with the length (runs of
letters without @ and tables of numbers too); repeated rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import fresh

KEY = "pseudonyms-1"
ROUNDS = 8
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)"
PHONE = r"(?:\+1[ .-]?)(?:\([2-9]\d{2}\)|[2-9]\d{2})[ .-]?[2-9]\d{2}[ .-]?\d{4}(?!\d)"
PHONE_LOOSE = r"(?:\+1[ .-]?)(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
_N = r"[2-9]\d{2}"
LOCAL = (rf"\({_N}\)[ .-]?{_N}[ .-]?\d{{4}}(?!\d)|(?<!\d)(?<!\d[.-])(?:1[ .-])?{_N}(?:[ .-]{_N}[ .-]?|{_N}[.-])\d{{4}}(?!\d|[.-]\d)"
         rf"|(?<![A-Za-z0-9_])(?<!\d[.-])1?{_N}{_N}\d{{4}}(?![A-Za-z0-9_]|[.-]\d)")
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
DATE = r"(?<![\d./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d[./]\d\d[./](?:19|20)\d\d)(?![\d]|[./-]\d)"
#: From where a run of such characters begins, or a found value ended within it; possessive: a run is read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: Digit groups of 13 digits or more; possessive, as Java then takes long runs in a loop.
RUN = rf"(?<!\d)(?<!\d\.)(?!\d+\.\d)\d(?:\d|[ -](?!\d+\.\d|{DATE}|{LOCAL})\d){{12,}}+"
#: Single values with nothing beside them; FIND is what texts are searched for.
ANY = "|".join([EMAIL, PHONE_LOOSE, DATE, IP, CARD])
FIND = "|".join([EMAIL, PHONE_LOOSE, LOCAL, DATE, IP, RUN])
PARTS = "array<struct<value:string,pseudonym:string,tail:string>>"
#: 1900-01-01 to 2099-12-31 has 73,049 = 17 x 4,297 days: the two halves of a date.
DAYS_LOW, DAYS_HIGH, FIRST_DAY = 17, 4297, "1900-01-01"


def _word(key: str, kind: str, step: int | Column, half: Column) -> Column:
    """The round function: a non-negative number below 2^48 from a keyed hash of
    one half."""
    step = step if isinstance(step, Column) else F.lit(step)
    text = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def _feistel(key: str, kind: str, left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
    """Permutes a pair of numbers below n_left and n_right: in turn each half is
    moved, within its range, by a hash of the other. Struct (l, r)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s, i):
        even = i % 2 == 0
        move = _word(key, kind, i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(F.when(even, F.pmod(s["l"] + move, n_left)).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(F.pmod(s["r"] + move, n_right)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of a digit string, from the right; ``doubled``: parity of the
    places that count twice (0 for the last digit)."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == doubled, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x)


def _permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    out = _feistel(key, kind, F.substr(digits, F.lit(1), a), F.substr(digits, a + 1), _power10(a), _power10(n - a))
    text = F.transform(F.array(out), lambda s: F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")),
                                                        F.lpad(s["r"].cast("string"), (n - a).cast("int"), F.lit("0"))))
    return F.get(text, F.lit(0))


def _laid_out(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced, in order, by those of ``digits``."""
    parts = F.split(template, r"\d", -1)
    return F.array_join(F.zip_with(parts, F.split(digits, ""), lambda p, d: F.concat(F.coalesce(p, F.lit("")), F.coalesce(d, F.lit("")))), "")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _part(value: Column, new: Column, tail: Column) -> Column:
    return F.struct(value.alias("value"), new.alias("pseudonym"), tail.alias("tail"))


def _card(key: str, v: Column) -> Column:
    """The pseudonym of a card that has passed Luhn."""
    def go(d):
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        return _let(_permuted_digits(key, "card", body), lambda p: _laid_out(
            v, F.concat(p, F.pmod(F.lit(10) - _luhn_sum(p, 0) % 10, F.lit(10)).cast("string"))))
    return _let(_digits(v), go)


def _cards(key: str, run: Column) -> Column:
    """A run of digit groups as parts: its cards, and the other groups as they are.
    Every group first knows how many groups the card that starts with it has; the
    parts are those met from the first group on, which doubled jumps give."""
    def go(groups):  # each with the blank or dash behind it
        def raw(i, n):
            return F.array_join(F.slice(groups, i + 1, n), "")

        def passes(i, n):
            return _let(_digits(raw(i, n)), lambda d: F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0))

        def size_of(g, i):
            # Groups of four digits or more but for the last: five of them hold at most 19 digits.
            sizes = F.sequence(F.least(F.size(groups) - i, F.lit(5)), F.lit(1), F.lit(-1))
            some = F.get(F.filter(sizes, lambda n: raw(i, n).rlike(r"^(?:\d{4,}[ -])*\d+[ -]?$") & passes(i, n)), F.lit(0))
            whole = (i == 0) & (F.size(groups) <= 19) & passes(i, F.size(groups))
            return F.when(whole, F.size(groups)).when(g.rlike(r"^\d{4}"), some)

        def part(i, n):
            def card(text):
                value = F.regexp_replace(text, "[ -]$", "")
                return _let(value, lambda x: _part(x, _card(key, x), F.substr(text, F.length(x) + 1)))
            group = F.get(groups, i)
            return F.when(n.isNull(), _part(group, group, F.lit(""))).otherwise(_let(raw(i, n), card))

        def chosen(sizes):
            end = F.size(groups)
            start = F.struct(F.transform(sizes, lambda n, i: F.least(i + F.coalesce(n, F.lit(1)), end)).alias("jump"),
                             F.array(F.lit(0)).alias("met"))

            def doubled(s, _):
                far = lambda i: F.coalesce(F.get(s["jump"], i), end)
                return F.struct(F.transform(s["jump"], far).alias("jump"),
                                F.concat(s["met"], F.filter(F.transform(s["met"], far), lambda i: i < end)).alias("met"))
            rounds = F.ceil(F.log2(end.cast("double"))).cast("int") + 1
            met = F.aggregate(F.sequence(F.lit(1), rounds), start, doubled, lambda s: s["met"])
            return F.transform(met, lambda i: part(i, F.get(sizes, i)))
        return _let(F.transform(groups, size_of), chosen)
    return _let(F.regexp_extract_all(run, F.lit(r"(\d+[ -]?)"), 1), go)


def _phone(key: str, v: Column) -> Column:
    """Halves: area code and exchange (each 8 x 100), and the line's four digits."""
    def go(d):  # [1] AAA EEE LLLL
        first = F.length(d) - 9
        area, exchange = F.substr(d, first, F.lit(3)).cast("int") - 200, F.substr(d, first + 3, F.lit(3)).cast("int") - 200
        out = _feistel(key, "phone", area * 800 + exchange, F.substr(d, first + 6, F.lit(4)), F.lit(640_000), F.lit(10_000))
        return _let(out, lambda s: _laid_out(v, F.concat(
            F.substr(d, F.lit(1), first - 1), (F.floor(s["l"] / 800) + 200).cast("string"), (s["l"] % 800 + 200).cast("string"),
            F.lpad(s["r"].cast("string"), 4, "0"))))
    return F.when(v.rlike(f"^(?:{PHONE}|{LOCAL})$"), _let(_digits(v), go)).otherwise(v)


def _ip(key: str, v: Column) -> Column:
    def go(o):
        n = [F.get(o, F.lit(i)).cast("int") for i in range(4)]
        out = _feistel(key, "ip", n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536))
        # A leading zero isn't part of an address: such a value isn't one.
        return F.when(F.forall(o, lambda x: (x.cast("int") <= 255) & (x.cast("int").cast("string") == x)), _let(out, lambda s: F.concat_ws(
            ".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))).otherwise(v)
    return _let(F.split(v, r"\."), go)


def _date(key: str, v: Column) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    iso = v.contains("-")

    def moved(n):
        out = _feistel(key, "date", F.floor(n / DAYS_HIGH), n % DAYS_HIGH, F.lit(DAYS_LOW), F.lit(DAYS_HIGH))
        return _let(out, lambda s: (s["l"] * DAYS_HIGH + s["r"]).cast("int"))

    def day_of(n):
        return F.date_add(first, n)

    def go(d):
        day, us = d["day"], d["us"]
        # Month first: moved on until the new date can't be read day first either, so that pseudonyms stay one-to-one.
        walked = F.aggregate(F.sequence(F.lit(1), F.when(us, F.lit(100)).otherwise(F.lit(1))), moved(F.datediff(day, first)), lambda n, _: F.when(
            us & (F.dayofmonth(day_of(n)) <= 12), moved(n)).otherwise(n))
        return F.when(day.isNull(), v).otherwise(_let(day_of(walked), lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(
            F.replace(F.when(us, F.date_format(d, "MM-dd-yyyy")).otherwise(F.date_format(d, "dd-MM-yyyy")), F.lit("-"), F.substr(v, F.lit(3), F.lit(1))))))
    parts = F.split(v, "[./]")

    def read(*order):
        return F.try_to_date(F.concat_ws("-", *(F.get(parts, F.lit(i)) for i in order)), "yyyy-MM-dd")
    day_first = F.when(iso, F.try_to_date(v, "yyyy-MM-dd")).otherwise(read(2, 1, 0))
    month_first = F.when(~iso, read(2, 0, 1))
    return _let(F.struct(F.coalesce(day_first, month_first).alias("day"), day_first.isNull().alias("us")), go)


def _email(key: str, v: Column) -> Column:
    """The local part's characters, each moved within its class by a keyed stream
    of the other half."""
    lower, upper, digit = (F.lit(x) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))

    def moved(half, other, i):
        def one(c, at):
            stream = _word(key, "email", i * 1000 + at, other)
            def within(alphabet, size):
                return F.substr(alphabet, (F.pmod(F.position(c, alphabet) - 1 + stream, F.lit(size)) + 1).cast("int"), F.lit(1))
            return (F.when(c.rlike("[a-z]"), within(lower, 26)).when(c.rlike("[A-Z]"), within(upper, 26))
                    .when(c.rlike("[0-9]"), within(digit, 10)).otherwise(c))
        return F.array_join(F.transform(F.split(half, ""), one), "")

    def go(local):
        a = F.floor(F.length(local) / 2).cast("int")
        start = F.struct(F.substr(local, F.lit(1), a).alias("l"), F.substr(local, a + 1).alias("r"))
        out = F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, lambda s, i: F.when(
            i % 2 == 0, F.struct(s["l"].alias("l"), moved(s["r"], s["l"], i).alias("r"))).otherwise(
            F.struct(moved(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))))
        return _let(out, lambda s: F.concat(s["l"], s["r"], F.substr(v, F.locate("@", v))))
    return _let(F.substring_index(v, "@", 1), go)


def _parts(v: Column, key: str) -> Column:
    """A found value as parts (value, pseudonym, what follows); one unless it's a run of digit groups."""
    def alone(new):
        return F.array(_part(v, new, F.lit("")))
    return (F.when(v.contains("@"), alone(_email(key, v))).when(v.startswith("+") | v.rlike(f"^(?:{LOCAL})$"), alone(_phone(key, v)))
            .when(v.rlike(f"^(?:{DATE})$"), alone(_date(key, v))).when(v.rlike(r"^\d+\.\d+\.\d+\.\d+$"), alone(_ip(key, v)))
            .otherwise(_cards(key, v)))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(p["pseudonym"], p["tail"])), "")


def pseudonym(v: Column, key: str = KEY) -> Column:
    """The pseudonym of a found value, or the value itself where it isn't valid."""
    return _joined(_parts(v, key))


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Adds ``found`` (value and pseudonym of what was replaced, in order) and
    puts the pseudonyms into ``text``."""
    new = fresh(docs, "_new")
    docs = docs.withColumn(new, F.transform(F.regexp_extract_all("text", F.lit(f"({FIND})"), 1), lambda v: _parts(v, key)))
    text = F.when(F.size(new) > 0, F.array_join(F.zip_with(
        F.split("text", FIND, -1), new, lambda t, v: F.concat(F.coalesce(t, F.lit("")), F.coalesce(_joined(v), F.lit("")))), "")).otherwise(F.col("text"))
    found = F.transform(F.filter(F.flatten(new), lambda x: x["value"] != x["pseudonym"]), lambda x: F.struct(x["value"], x["pseudonym"]))
    none = F.array().cast("array<struct<value:string,pseudonym:string>>")
    return docs.withColumns({"found": F.coalesce(found, none), "text": text}).drop(new)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced."""
    return pseudonymised(docs.select("doc_id", "text")).select("doc_id", "text", F.size("found").alias("n_replaced"))
