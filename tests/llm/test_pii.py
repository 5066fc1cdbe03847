import datetime
import hashlib
import re

from pyspark.sql import functions as F
from small import documents

from netsift.llm import pii

#: The operator's single values, with mail addresses as Python's own engine can search for them.
ANY = pii.ANY.replace(pii.EMAIL, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def word(kind, step, half):
    return int(hashlib.sha256(f"{pii.KEY}|{kind}|{step}|{half}|{pii.KEY}".encode()).hexdigest()[:12], 16)


def feistel(kind, a, b, na, nb):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + word(kind, i, b)) % na
        else:
            b = (b + word(kind, i, a)) % nb
    return a, b


def luhn(d):
    return sum(sum(divmod(int(x) * 2, 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def lay(template, digits):
    it = iter(digits)
    return re.sub(r"\d", lambda m: next(it), template)


def one(v):
    if "@" in v:
        local, _, domain = v.partition("@")
        a = len(local) // 2
        l, r = local[:a], local[a:]
        def moved(half, other, i):
            out = ""
            for at, c in enumerate(half):
                k = word("email", i * 1000 + at, other)
                for lo, size in (("a", 26), ("A", 26), ("0", 10)):
                    if ord(lo) <= ord(c) < ord(lo) + size:
                        c = chr(ord(lo) + (ord(c) - ord(lo) + k) % size)
                        break
                out += c
            return out
        for i in range(4):
            if i % 2 == 0:
                r = moved(r, l, i)
            else:
                l = moved(l, r, i)
        return f"{l}{r}@{domain}"
    d = re.sub(r"\D", "", v)
    if v.startswith("+"):
        if not re.fullmatch(pii.PHONE, v):
            return v
        l, r = feistel("phone", (int(d[1:4]) - 200) * 800 + int(d[4:7]) - 200, int(d[7:]), 640000, 10000)
        return lay(v, f"1{l // 800 + 200}{l % 800 + 200}{r:04}")
    if re.fullmatch(pii.DATE, v):
        y, m, dd = (v.split("-") if "-" in v else re.split("[./]", v)[::-1])
        try:
            n = (datetime.date(int(y), int(m), int(dd)) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return v
        a, b = feistel("date", n // 4297, n % 4297, 17, 4297)
        new = datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)
        return new.isoformat() if "-" in v else new.strftime(f"%d{v[2]}%m{v[2]}%Y")
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", v):
        o = v.split(".")
        if any(int(x) > 255 or str(int(x)) != x for x in o):
            return v
        a, b = feistel("ip", int(o[0]) * 256 + int(o[1]), int(o[2]) * 256 + int(o[3]), 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if not luhn(d):
        return v
    n = len(d) - 1
    a = n // 2
    l, r = feistel("card", int(d[:a]), int(d[a:n]), 10**a, 10**(n - a))
    body = f"{l:0{a}}{r:0{n - a}}"
    return lay(v, body + next(c for c in "0123456789" if luhn(body + c)))


VALUES = ["4041894974608795", "4111 1111 1111 1111", "4111-1111-1111-1111", "4041894974608796", "378282246310005", "6011000990139424001",
          "+1 (988) 555-2485", "+1 (188) 555-2485", "+1-212-555-0100", "+1 212.999.0000", "70.123.182.155", "0.0.0.0", "255.255.255.255",
          "256.1.1.1", "01.2.3.4", "2021-02-28", "2021-02-29", "1900-01-01", "2099-12-31", "31.12.1999", "12/05/2003", "31/02/2003",
          "bosbt.42@mail8.example.com", "A-b_C.9%+z@x.org", "a@b.co", "9" * 25 + "@long.example.org"]


def rows_of():
    rows = [(i, f"say {v} to, ({v}). And é {VALUES[(i * 7) % len(VALUES)]}!") for i, v in enumerate(VALUES)]
    return rows + [(100, None), (101, ""), (102, "clean text, 12 words of 2021 and 3.14 or 1.2.3 or v10.20.30"), (103, VALUES[0]),
                   (104, "x " * 20000 + VALUES[6] + " y" * 20000), (105, " ".join(VALUES)), (None, VALUES[10]), (103, VALUES[0])]


def test_against_plain_python(spark, tmp_path):
    rows = rows_of()
    df = pii.report(documents(spark, tmp_path, rows))
    got = sorted(map(tuple, df.collect()), key=repr)
    want = []
    for i, t in rows:
        n = 0
        def swap(m):
            nonlocal n
            new = one(m.group())
            n += new != m.group()
            return new
        want.append((i, None if t is None else re.sub(ANY, swap, t), n))
    assert got == sorted(want, key=repr)
    assert dict((r[0], r[2]) for r in got)[102] == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_values_beside_others(spark, tmp_path):
    """(text, values in it, written out by hand): all are replaced, in their format, and nothing else changes."""
    card, phone = "4111 1111 1111 1111", "(212) 555-0100"
    cases = [(f"{card} 123", [card]), (f"{card} 12/27", [card]), (f"qty 12 {card}", [card]), ("4111111111111111-ok", ["4111111111111111"]),
             (f"1234567 {card}", [card]), (f"{card} 5500-0000-0000-0004, 1", [card, "5500-0000-0000-0004"]), ("No.4111111111111111 12.50", ["4111111111111111"]),
             (f"{card} 12.50", [card]), (f"{card} 2021-02-28 {card}", [card, "2021-02-28", card]), (f"{card} 212 555 0100", [card, "212 555 0100"]),
             ("3056 930902 5904 077", ["3056 930902 5904"]), (f"call{phone}", [phone]), ("212-555-0100.", ["212-555-0100"]), ("1-212-555-0100", ["1-212-555-0100"]),
             ("2125550100, 212.555.0100", ["2125550100", "212.555.0100"]), ("112-555-0100, 212-155-0100, 212-555-01000, 5212-555-0100", []),
             ("due 12/31/1999", ["12/31/1999"]), ("12.31.1999", ["12.31.1999"]), ("13/13/1999 31/02/2003", []), ("4111 1111 1111 1112 123", []),
             ("1.4111111111111111 4111111111111111.5", []), ("7 " * 9000 + "8" * 9000, []), (" ".join(str(n * 37 % 100) for n in range(400)), [])]
    got = {r.doc_id: r for r in pii.pseudonymised(documents(spark, tmp_path, [(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    for i, (text, values) in enumerate(cases):
        assert [f.value for f in got[i].found] == values, text
        new, at = got[i].text, 0
        for f in got[i].found:
            begin = text.index(f.value, at)
            assert new[at:begin] == text[at:begin] and new[begin:begin + len(f.value)] == f.pseudonym
            assert re.sub(r"\d", "0", f.pseudonym) == re.sub(r"\d", "0", f.value)
            at = begin + len(f.value)
        assert new[at:] == text[at:]
    same = {f.pseudonym for r in got.values() for f in r.found if f.value == card}
    phones = {re.sub(r"\D", "", f.pseudonym)[-10:] for r in got.values() for f in r.found if re.sub(r"\D", "", f.value)[-10:] == "2125550100"}
    assert len(same) == len(phones) == 1 and luhn(re.sub(r"\D", "", same.pop()))


def test_month_first_dates_stay_one_to_one(spark):
    days = spark.range(73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where(F.dayofmonth("d") > 12)
    got = days.select(pii.pseudonym(F.date_format("d", "MM/dd/yyyy")).alias("p"))
    assert got.agg(F.countDistinct("p")).first()[0] == days.count() == got.where("int(substr(p, 4, 2)) > 12 and int(substr(p, 1, 2)) <= 12").count()


def test_pseudonyms_are_valid_and_one_to_one(spark):
    base = spark.range(20000).select(
        F.concat(F.lit("10.1."), F.floor(F.col("id") / 200), F.lit("."), F.col("id") % 200).alias("ip"),
        F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("day"))
    got = base.select(*(pii.pseudonym(F.col(c)).alias(c) for c in base.columns))
    assert got.agg(F.countDistinct("ip"), F.countDistinct("day")).first() == (20000, 20000)
    assert got.where(~F.col("day").between("1900-01-01", "2099-12-31")).count() == 0


def test_empty(spark, tmp_path):
    assert pii.report(documents(spark, tmp_path, [])).collect() == []


def test_long_texts_in_linear_time(spark, tmp_path):
    """A megabyte each of letters, of numbers, of groups that all pass Luhn, and of many mail addresses."""
    import time
    import random
    rnd = random.Random(1)
    groups = " ".join(str(rnd.randrange(10, 100)) for _ in range(330_000))
    fours = "0000 " * 50_000
    texts = {"letters": "abcdefghij" * 100_000, "base64": "".join(rnd.choice("abcXYZ0189+/") for _ in range(1_000_000)), "numbers": groups,
             "fours": fours, "mails": "x.y+z@example.org " * 2_000 + "q" * 300_000, "dots": "a@" + ".b" * 200_000}
    spent = {}
    for n, (name, t) in enumerate(texts.items()):
        df = documents(spark, tmp_path / name, [(n, t)])
        at = time.time()
        row = pii.report(df).first()
        spent[name] = time.time() - at
        assert len(row.text) == len(t)
        if name in ("letters", "numbers"):
            assert row.text == t and row.n_replaced == 0
        if name == "mails":
            assert row.n_replaced == 2_000 and row.text.startswith(one("x.y+z@example.org") + " ")
        if name == "fours":  # sixteen digits each, from the first group on
            assert row.n_replaced == 12_500
    assert max(spent.values()) < 10, spent


def test_mail_behind_another_value(spark, tmp_path):
    rows = [(1, "(212) 555-0100a@x.com a@b.co_x@y.zz"), (2, "write to .a@b.com, x@y and %@q.org.")]
    got = {r.doc_id: [f.value for f in r.found] for r in pii.pseudonymised(documents(spark, tmp_path, rows)).collect()}
    assert got[1][1:] == ["a@x.com", "a@b.co", "_x@y.zz"] and got[2][0] == ".a@b.com"
