"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in SQL functions.

A value is split into two halves; in each round one half is shifted, character
by character inside its own alphabet, by a keyed digest of the other. That is a
permutation of all values of one format: equal values get equal pseudonyms in
every document, different values different ones. Numbers and dates are changed
only if valid, and stay valid: check digits, octets and calendar days are
permuted as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets of telephone numbers' leading places and of key identifiers' digits.
LEADING, KEY_DIGITS = "23456789", "234567"

#: Patterns by kind; a match of ``SCAN`` gets the first kind whose pattern it fully matches.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "key": r"(?:AKIA|ASIA)[A-Z2-7]{16}",
    "token": r"(?:gh[opsu]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9]{20,64})",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "phone": r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    "phone_abroad": r"\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "date_ymd": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}",
    "date_dmy": r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
}
#: Lengths of IBANs by country, in letters and digits.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int) -> str:
    """The rest of an IBAN after its country."""
    groups, rest = divmod(length - 4, 4)
    return rf"[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


def _bordered(pattern: str, before: str = "", after: str = "") -> str:
    """``pattern`` between no letters or digits; ``before`` and ``after`` are what would continue the same value."""
    return "(?<![A-Za-z0-9])" + (f"(?<![0-9]{before})" if before else "") + f"(?:{pattern})(?![A-Za-z0-9]{after and '|' + after + '[0-9]'})"


#: A time or a zone may follow a day.
_TIME = r"(?![0-9]|(?![Tt][0-9]{2}|[Zz](?![A-Za-z0-9]))[A-Za-z]"
#: Only a sign that the format itself has continues a value; other signs (a list's comma, a path's slash) end it.
#: The country's length comes first, so that an IBAN does not take the next word.
_NUMBERS = "|".join([
    _bordered("(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{c.replace(' ', '|')}){_iban_of(n)}" for n, c in IBAN_LENGTHS.items()) + ")"),
    _bordered(PATTERNS["iban"]),
    _bordered(rf"(?<!\+)(?:{PATTERNS['phone']})", "[.-]", "[.-]"),
    _bordered(PATTERNS["ip"], r"\.", r"\."),
    r"(?<![A-Za-z0-9])(?<![0-9]-)[0-9]{4}-[0-9]{2}-[0-9]{2}" + _TIME + "|-(?![0-9]{2}:[0-9]{2})[0-9])",
    r"(?<![A-Za-z0-9])[0-9]{4}/[0-9]{2}/[0-9]{2}" + _TIME + ")",
    r"(?<![A-Za-z0-9])(?<![0-9]\.)[0-9]{2}\.[0-9]{2}\.[0-9]{4}" + _TIME + r"|\.[0-9])",
    r"(?<![A-Za-z0-9])(?<![0-9]/)[0-9]{2}/[0-9]{2}/[0-9]{4}" + _TIME + "|/[0-9])",
    _bordered(PATTERNS["ssn"], "-", "-"),
    _bordered(r"(?<!\+)[0-9]{13,19}", r"\.", r"\."),
    _bordered(r"(?<!\+)(?:[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5})", "-"),
    _bordered(r"(?<!\+)(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})", "-", "-"),
    _bordered(PATTERNS["phone_abroad"], "", "[.-]"),
])
SCAN = (
    rf"(?<![A-Za-z0-9._%+-]){PATTERNS['email']}(?![A-Za-z0-9@]|[_-][A-Za-z0-9_-])"
    rf"|(?<![A-Za-z0-9_])(?:{PATTERNS['key']}|{PATTERNS['token']})(?![A-Za-z0-9_])"
    rf"|{_NUMBERS}"
)
#: No value without one of these.
HINT = r"[0-9@]|AKIA|ASIA|gh[opsu]_|sk-"

#: Days of 28 years, in which weekdays and leap years come round: two factors for two halves.
DATE_BLOCK, DATE_LEFT, DATE_RIGHT = 10_227, 21, 487
DATE_FROM, DATE_TO = "1901-01-01", "2096-12-31"


def _secret(key: str, kind: str, *parts: Column) -> Column:
    """A keyed digest, as text."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts], F.lit(key)), 256)


def _digest(key: str, kind: str, *parts: Column) -> Column:
    """A non-negative number below 2^60 from a keyed digest."""
    return F.conv(F.substring(_secret(key, kind, *parts), 1, 15), 16, 10).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _permute_cells(cells: Column, key: str, kind: str) -> Column:
    """Characters of ``cells`` (an array of c, abc) after all rounds, as one string."""

    def network(all_cells: Column) -> Column:
        n, half = F.size(all_cells), F.floor(F.size(all_cells) / 2).cast("int")
        start = F.struct(F.slice(all_cells, 1, half).alias("l"), F.slice(all_cells, half + 1, n - half).alias("r"))

        def turn(acc: Column, at: Column) -> Column:
            other = F.array_join(F.transform(acc["r"], lambda x: x["c"]), "")

            def shifted(digest: Column) -> Column:
                def shift(x: Column, i: Column) -> Column:
                    to = F.pmod(F.position(x["c"], x["abc"]) - 1 + F.pmod(F.xxhash64(digest, i), F.lit(1 << 40)), F.length(x["abc"]))
                    return F.struct(F.substr(x["abc"], (to + 1).cast("int"), F.lit(1)).alias("c"), x["abc"].alias("abc"))

                return F.transform(acc["l"], shift)

            return F.struct(acc["r"].alias("l"), _let(_secret(key, kind, at, n, other), shifted).alias("r"))

        done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
        return _let(done, lambda s: F.array_join(F.transform(F.concat(s["l"], s["r"]), lambda x: x["c"]), ""))

    return _let(cells, network)


def _alphabet(c: Column) -> Column:
    """Where a letter or digit may move; empty for signs, which stay."""
    return (
        F.when((c >= "0") & (c <= "9"), DIGITS).when((c >= "A") & (c <= "Z"), UPPER).when((c >= "a") & (c <= "z"), LOWER).otherwise("")
    )


def _filled(text: Column, moved: Column) -> Column:
    """``text`` with its letters and digits replaced by those of ``moved``, in order."""

    def fill(new: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            sign = _alphabet(c) == ""
            next_c = F.when(sign, c).otherwise(F.substr(new, acc["k"] + 1, F.lit(1)))
            return F.struct(F.concat(acc["s"], next_c).alias("s"), (acc["k"] + (~sign).cast("int")).alias("k"))

        return F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), put, lambda acc: acc["s"])

    return _let(moved, fill)


def _moved(text: Column, key: str, kind: str, abc: object = None) -> Column:
    """Letters and digits of ``text`` permuted in place; ``abc(c, i)`` names the alphabet of the i-th of them."""
    own = F.filter(F.split(text, ""), lambda c: _alphabet(c) != "")
    named = abc or (lambda c, i: _alphabet(c))
    cells = F.transform(own, lambda c, i: F.struct(c.alias("c"), named(c, i).alias("abc")))
    return _filled(text, _permute_cells(cells, key, kind))


def _permute_pair(left: Column, right: Column, n_left: int, n_right: int, key: str, kind: str, tweak: Column) -> Column:
    """Two numbers below ``n_left`` and ``n_right``, each shifted in turn by a digest of the other."""

    def turn(acc: Column, n: Column) -> Column:
        a = F.when(n % 2 == 1, F.pmod(acc["a"] + _digest(key, kind, n, tweak, acc["b"]), F.lit(n_left))).otherwise(acc["a"])
        b = F.when(n % 2 == 0, F.pmod(acc["b"] + _digest(key, kind, n, tweak, acc["a"]), F.lit(n_right))).otherwise(acc["b"])
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits, the last one counted once."""
    backwards = F.split(F.reverse(digits), "")
    doubled = F.transform(
        backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10)
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    """First digit kept, the middle permuted, the check digit made anew."""


    def body(d: Column) -> Column:
        return F.concat(F.substr(d, F.lit(1), F.lit(1)), _moved(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))

    def checked(b: Column) -> Column:
        return F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))

    return _filled(m, _let(_let(_digits(m), body), checked))


def _mod97(text: Column) -> Column:
    """Letters as two digits, 10 to 35, then the whole number modulo 97."""

    def step(acc: Column, c: Column) -> Column:
        number = F.when(_alphabet(c) == DIGITS, acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55)
        return F.pmod(number, F.lit(97)).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban_number(compact: Column) -> Column:
    return F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))


def _iban(m: Column, key: str) -> Column:
    """Country kept, the account permuted, the check digits made anew."""
    flat, country = F.regexp_replace(m, " ", ""), F.substr(m, F.lit(1), F.lit(2))

    def checked(account: Column) -> Column:
        check = F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)

    return _filled(m, _let(_moved(F.substr(flat, F.lit(5)), key, "iban"), checked))


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("int"))


def _ip(m: Column, key: str) -> Column:
    o = _octets(m)
    pair = _permute_pair(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), 65_536, 65_536, key, "ip", F.lit(0))


    def written(p: Column) -> Column:
        out = [F.shiftright(p["a"], 8), p["a"] % 256, F.shiftright(p["b"], 8), p["b"] % 256]
        return F.concat_ws(".", *[x.cast("string") for x in out])

    return _let(pair, written)


def _day(m: Column) -> Column:
    """The day a written date names, null if there is none. With slashes the month comes first where it can."""
    first = F.substr(m, F.lit(1), F.lit(2))
    iso = F.when(m.rlike("^[0-9]{4}"), F.concat_ws("-", F.substr(m, F.lit(1), F.lit(4)), F.substr(m, F.lit(6), F.lit(2)), F.substr(m, F.lit(9), F.lit(2))))
    year, second = F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2))
    month_first = m.contains("/") & (first <= "12")
    iso = F.coalesce(iso, F.when(month_first, F.concat_ws("-", year, first, second)).otherwise(F.concat_ws("-", year, second, first)))
    day = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when(day.between(F.lit(DATE_FROM).cast("date"), F.lit(DATE_TO).cast("date")), day)


def _date(m: Column, key: str) -> Column:
    """A day of the same 28 years (1901 to 1928 and so on), written the same way."""
    month_first = F.substr(m, F.lit(1), F.lit(2)) <= "12"

    def moved(past: Column) -> Column:
        block, inside = F.floor(past / DATE_BLOCK).cast("int"), F.pmod(past, F.lit(DATE_BLOCK))
        pair = _permute_pair(F.floor(inside / DATE_RIGHT), F.pmod(inside, F.lit(DATE_RIGHT)), DATE_LEFT, DATE_RIGHT, key, "date", block)
        days = _let(pair, lambda p: (block * DATE_BLOCK + p["a"] * DATE_RIGHT + p["b"]).cast("int"))
        return F.date_add(F.lit(DATE_FROM).cast("date"), days)

    def written(day: Column) -> Column:
        return (
            F.when(m.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd"))
            .when(m.rlike("^[0-9]{4}/"), F.date_format(day, "yyyy/MM/dd"))
            .when(m.contains("."), F.date_format(day, "dd.MM.yyyy"))
            .when(month_first, F.date_format(day, "MM/dd/yyyy"))
            .otherwise(F.date_format(day, "dd/MM/yyyy"))
        )

    return _let(_let(F.date_diff(_day(m), F.lit(DATE_FROM).cast("date")), moved), written)


def _phone(m: Column, key: str) -> Column:
    """Country code kept; area and exchange start with 2 to 9, or with 0 or 1, as before."""
    head = F.regexp_extract(m, r"^(?:\+?1[ .-]?(?=[(0-9]))?", 0)

    def leading(c: Column, i: Column) -> Column:
        return F.when(i.isin(0, 3), F.when(c.isin("0", "1"), "01").otherwise(LEADING)).otherwise(DIGITS)

    return _let(head, lambda h: F.concat(h, _moved(F.substr(m, F.length(h) + 1), key, "phone", leading)))


def _kept_head(m: Column, head: str, key: str, kind: str, abc: object = None) -> Column:
    start = F.regexp_extract(m, f"^(?:{head})", 0)
    return F.concat(start, _moved(F.substr(m, F.length(start) + 1), key, kind, abc))


def _email(m: Column, key: str) -> Column:
    """Everything but the top domain permuted."""
    top = F.substring_index(m, ".", -1)
    return F.concat(_moved(F.substr(m, F.lit(1), F.length(m) - F.length(top) - 1), key, "email"), F.lit("."), top)


def _ssn_valid(m: Column) -> Column:
    return ~m.rlike("^(?:000|666|9)|-00-|-0000$")


def _ssn(m: Column, key: str) -> Column:
    """Area, group and serial as numbers of the valid ones: 898 areas, 99 groups, 9,999 serials."""
    area, group, serial = (F.substr(m, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - (area > 666).cast("int")
    pair = _permute_pair(place * 99 + group - 1, serial - 1, 898 * 99, 9_999, key, "ssn", F.lit(0))


    def written(p: Column) -> Column:
        new = F.floor(p["a"] / 99)
        parts = [(new + 1 + (new >= 665).cast("int"), 3), (F.pmod(p["a"], F.lit(99)) + 1, 2), (p["b"] + 1, 4)]
        return F.concat_ws("-", *[F.lpad(x.cast("int").cast("string"), n, "0") for x, n in parts])

    return _let(pair, written)


def kind_of(m: Column) -> Column:
    """The kind of a matched value, null if it is not valid."""
    octets = F.forall(_octets(m), lambda x: x <= 255) & ~m.rlike(r"(?:^|\.)0[0-9]")
    valid = {
        "card": (_luhn(_digits(m)) % 10 == 0) & ~_digits(m).rlike("^0+$"),
        "iban": _mod97(_iban_number(F.regexp_replace(m, " ", ""))) == 1,
        "ip": octets,
        "date_ymd": _day(m).isNotNull(),
        "date_dmy": _day(m).isNotNull(),
        "ssn": _ssn_valid(m),
        "phone_abroad": F.length(_digits(m)).between(8, 15),
    }
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        fits = m.rlike(f"^(?:{pattern})$")
        kind = F.when(fits, F.when(valid[name], F.lit(name)) if name in valid else F.lit(name)).otherwise(kind)
    return kind


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What stands for a value of a kind; a value of no kind stays."""
    return (
        F.when(kind.isNull(), m)
        .when(kind == "email", _email(m, key))
        .when(kind == "key", _kept_head(m, "AKIA|ASIA", key, "key", lambda c, i: F.when(_alphabet(c) == DIGITS, KEY_DIGITS).otherwise(UPPER)))
        .when(kind == "token", _kept_head(m, "gh[opsu]_|sk-", key, "token"))
        .when(kind == "iban", _iban(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "phone_abroad", _kept_head(m, r"\+[0-9]{1,2}", key, "abroad"))
        .when(kind == "ip", _ip(m, key))
        .when(kind.startswith("date"), _date(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "card", _card(m, key))
    )


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with its texts' valid personal values replaced, and ``replaced``, an array of kind, value and pseudonym.

    Rows are changed one by one: no shuffle. A null text stays null, with
    nothing replaced; the rest of a text stays as it is, byte for byte. Other
    columns stay; one named ``replaced`` is overwritten. The values in
    ``replaced`` are for audits and are dropped before texts are passed on.
    """
    text = F.col(f"`{text_col}`")
    hinted = text.rlike(HINT)
    found = df.withColumn("__found", F.when(hinted, F.regexp_extract_all(text, F.lit(SCAN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    # Splitting at the same pattern leaves what stands between the matches.
    found = found.withColumn("__rest", F.when(F.size("__found") > 0, F.split(text, SCAN, -1)))
    kinds = F.transform("__found", lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    named = found.withColumn("__kinds", kinds)
    done = F.transform("__kinds", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("pseudonym")))
    named = named.withColumn("__done", F.when(F.size("__kinds") > 0, done).otherwise(F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")))
    pieces = F.zip_with("__rest", "__done", lambda r, d: F.concat(r, F.coalesce(d["pseudonym"], F.lit(""))))
    named = named.withColumn(text_col, F.when(F.size("__done") > 0, F.array_join(pieces, "")).otherwise(text))
    named = named.withColumn("replaced", F.filter("__done", lambda d: d["kind"].isNotNull()))
    return named.drop("__found", "__rest", "__kinds", "__done")
