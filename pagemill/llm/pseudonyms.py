"""PII: format-preserving Feistel pseudonyms, with built-in expressions only.

Every find is permuted by a keyed Feistel network within its own format, so equal values get equal pseudonyms in all
documents, different values of a format stay different, and nobody without the key can go back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import let, table, unused

ROUNDS = 8
#: For tests and the registered query; a real run passes a secret key of its own.
DEMO_KEY = "pagemill-demo-key"

#: Layouts in which cards are printed; between their groups stands a space, a hyphen, a dot or nothing.
CARD_LAYOUT = r"(?:\d{4}(?:[ .-]?\d{4}){3}|\d{4}[ .-]?\d{6}[ .-]?\d{4,5})"
#: Signs of a mail address's local part, and what a key of a well-known service begins with (fixed values).
LOCAL = r"[\p{L}\p{N}_.%+!#$&'*/=?^`{|}~-]"
KEY_HEADS = r"(?:(?:AKIA|ASIA)(?=[0-9A-Z]{16}(?![0-9A-Za-z]))|gh[pousr]_(?=[0-9A-Za-z]{36})|github_pat_(?=\w{22})|xox[abprs]-(?=[0-9A-Za-z-]{10})|sk_live_(?=[0-9A-Za-z]{16})|sk-(?=[0-9A-Za-z_-]{20})|AIza(?=[\w-]{35}))"
#: Java patterns of candidates by kind; a candidate that fails the kind's validation is left as it is. Repeats without a
#: bound are possessive, so that no text, however long, makes the search go back.
PATTERNS = {
    "email": rf"(?<!{LOCAL}){LOCAL}++@(?=(?:[\p{{L}}\p{{N}}-]++\.(?!\p{{L}}{{2}}))*+[\p{{L}}\p{{N}}-]++\.\p{{L}}{{2}})[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)*+",
    "key": rf"(?<![0-9A-Za-z_-]){KEY_HEADS}[\w-]++",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "mac": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})(?![0-9A-Fa-f:-])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?<![Vv]ersion[ .:]{0,2}|\bv)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d(?:[ ./-]{0,2}\(?\d\)?){6,14}(?!\d)|(?<![\d.+-])(?:1[ .-])?(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![\d-]|\.\d)|(?<![\d.,/+-])(?:\(0\d{1,4}\)|0\d{1,4})(?:[ /-]{1,2}\d{2,8}){1,4}(?![\d-]|[./]\d)",
    "iso_date": r"(?<![\d-])(?:19|20)\d{2}-\d{1,2}-\d{1,2}(?![\d-])",
    "ymd_date": r"(?<![\d/])(?:19|20)\d{2}/\d{1,2}/\d{1,2}(?![\d/])",
    "us_date": r"(?<![\d/])\d{1,2}/\d{1,2}/(?:19|20)\d{2}(?![\d/])",
    "dot_date": r"(?<![\d.])\d{1,2}\.\d{1,2}\.(?:19|20)\d{2}(?!\.?\d)",
    "card": r"(?<![\d-])(?:(?<!\d[ .])\d(?:(?: ?\d){12,18}(?! ?\d)|(?:-?\d){12,18}|(?:\.?\d){12,18}(?!\.?\d))|" + CARD_LAYOUT + r")(?![\d-])",
}
#: Numbers that issuers give out, by their first digits and length (fixed values).
ISSUED = r"^(?:4\d{12}|4\d{15}|4\d{18}|3(?:0[0-5]|[689]\d)\d{11}|3[47]\d{13}|(?:2131|1800)\d{11}|3(?:5|0[0-59]|[689])\d{14,17}|5[0-8]\d{14,17}|6\d{15,18}|2[2-7]\d{14}|8[12]\d{14,17}|9792\d{12})$"
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: 1900-01-01 to 2099-12-31 has 73,049 days, 17 times 4,297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
#: Layouts of dates; with slashes, what is no month and day is read as day and month.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy")
DATE_KINDS = ("iso_date", "ymd_date", "us_date", "dot_date")
#: Country codes of E.164.
COUNTRY = r"^(\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))"


def _digest(key: str, kind: str, at: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), at.cast("string"), half.cast("string")), 256)


def feistel_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of the whole numbers below a * b, b below 2 ** 40: alternating rounds add to the halves value div b and value mod b."""

    def step(s: Column, at: Column) -> Column:
        left = F.conv(F.substring(_digest(key, kind, at, s["r"]), 1, 15), 16, 10).cast("long")
        right = F.conv(F.substring(_digest(key, kind, at, s["l"]), 1, 15), 16, 10).cast("long")
        even = at % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + left % a) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + right % b) % b).alias("r"),
        )

    value = value.cast("long")
    begin = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS + 1)), begin, step, lambda s: s["l"] * b + s["r"])


def feistel_text(value: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of the texts of one shape: digits stay digits, small and capital letters stay such, all else stays.

    Either half of the text is shifted, character by character within its class, by the digest of the other half.
    """

    def shifted(c: Column, at: Column, digest: Column) -> Column:
        by = F.conv(F.substring(digest, at % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int") * 7 + F.conv(F.substring(digest, (at + 11) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        turn = lambda first, size: F.char(F.lit(ord(first)) + (F.ascii(c) - ord(first) + by) % size)
        if hexadecimal:
            places = "0123456789abcdef"
            return F.substring(F.lit(places), (F.instr(F.lit(places), c) - 1 + by) % 16 + 1, F.lit(1))
        return F.when(c.between("0", "9"), turn("0", 10)).when(c.between("a", "z"), turn("a", 26)).when(c.between("A", "Z"), turn("A", 26)).otherwise(c)

    def turned(half: Column, digest: Column) -> Column:
        return let(digest, lambda d: F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), lambda c, i: shifted(c, i, d)), ""))

    def step(s: Column, at: Column) -> Column:
        even = at % 2 == 0
        return F.struct(
            F.when(even, turned(s["l"], _digest(key, kind, at, s["r"]))).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(turned(s["r"], _digest(key, kind, at, s["l"]))).alias("r"),
        )

    def permuted(v: Column) -> Column:
        cut = F.floor(F.length(v) / 2).cast("int")
        begin = F.struct(F.substring(v, F.lit(1), cut).alias("l"), F.substring(v, cut + 1, F.length(v)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step, lambda s: F.concat(s["l"], s["r"]))

    return let(value, permuted)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _check_digit(body: Column) -> Column:
    """The Luhn digit that completes a body of digits."""
    digits = F.reverse(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: c.cast("int")))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return (F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10) % 10


def _refilled(shape: Column, signs: Column, kept: str = "[^0-9]") -> Column:
    """The shape with its signs replaced by those given, in order; those that match `kept` stay."""

    def step(s: Column, c: Column) -> Column:
        stays = c.rlike(kept)
        return F.struct(
            F.concat(s["t"], F.when(stays, c).otherwise(F.substring(signs, s["n"], F.lit(1)))).alias("t"),
            F.when(stays, s["n"]).otherwise(s["n"] + 1).alias("n"),
        )

    begin = F.struct(F.lit("").alias("t"), F.lit(1).alias("n"))
    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), begin, step, lambda s: s["t"])


def _email(m: Column, key: str) -> Column:
    """Signs before the first letter or digit, and what an address is embedded in, stay outside the network."""
    local = F.substring_index(m, "@", 1)
    head = F.regexp_extract(local, r"^(?:.*[/=?&|{}`*])?[^\p{L}\p{N}]*", 0)
    return let(head, lambda h: F.concat(h, feistel_text(F.substring(local, F.length(h) + 1, F.length(local)), key, "email"), F.lit("@"), F.substring_index(m, "@", -1)))


def _hex(m: Column, key: str, kind: str) -> Column:
    """The same pseudonym in small and in capital digits, each in its own case; marks between the digits stay."""
    moved = feistel_text(F.lower(F.regexp_replace(m, "[:-]", "")), key, kind, hexadecimal=True)
    shown = _refilled(m, moved, "[:-]") if kind == "mac" else moved
    return let(shown, lambda x: F.when(m == F.lower(m), x).otherwise(F.upper(x)))


def _key(m: Column, key: str) -> Column:
    """What names the service stays."""
    return let(F.regexp_extract(m, f"^{KEY_HEADS}", 0), lambda h: F.concat(h, feistel_text(F.substring(m, F.length(h) + 1, F.length(m)), key, "key")))


def _ipv6(m: Column, key: str) -> Column:
    """An address of eight groups, or of fewer around one `::`; every notation of an address gets the same one, in full."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(m, "::", 1)), F.when(m.contains("::"), groups(F.substring_index(m, "::", -1))).otherwise(F.array().cast("array<string>"))

    def of(both: Column) -> Column:
        n = F.size(both["l"]) + F.size(both["r"])
        short = F.lower(m).rlike("^[0-9a-f]{3,4}:") & m.rlike("[0-9]") & ((F.length(m) - F.length(F.replace(m, F.lit("::"), F.lit("")))) == 2) & ~m.contains(":::")
        valid = F.when(m.contains("::"), short & (n < 8)).otherwise((n == 8) & ~m.startswith(":"))
        whole = F.concat(both["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), both["r"])
        moved = feistel_text(F.array_join(F.transform(whole, lambda g: F.lpad(F.lower(g), 4, "0")), ""), key, "ipv6", hexadecimal=True)
        shown = lambda x: F.when(m == F.lower(m), x).otherwise(F.upper(x))
        return F.when(valid, let(F.regexp_replace(moved, "(.{4})(?!$)", "$1:"), shown))

    return let(F.struct(left.alias("l"), right.alias("r")), of)


def _mod_97(value: Column) -> Column:
    """The remainder of a row of digits and capital letters, where A counts as 10 and Z as 35."""

    def step(rest: Column, c: Column) -> Column:
        letter = c >= "A"
        return (rest * F.when(letter, 100).otherwise(10) + F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)) % 97

    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    """The candidate as a whole, or without one or two words after it; the country stays and the check digits follow."""

    def plain(x: Column) -> Column:
        return F.replace(x, F.lit(" "), F.lit(""))

    def valid(x: Column) -> Column:
        p = plain(x)
        return let(p, lambda q: F.length(q).between(15, 34) & (_mod_97(F.concat(F.substring(q, F.lit(5), F.length(q)), F.substring(q, 1, 4))) == 1))

    def moved(part: Column) -> Column:
        def of(p: Column) -> Column:
            country = F.substring(p, 1, 2)
            rest = feistel_text(F.substring(p, F.lit(5), F.length(p)), key, "iban")
            check = lambda r: F.lpad((98 - _mod_97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0")
            return let(rest, lambda r: F.concat(_refilled(part, F.concat(country, check(r), r), " "), F.substring(m, F.length(part) + 1, F.length(m))))

        return let(plain(part), of)

    shorter = F.regexp_replace(m, " [0-9A-Z]{1,4}$", "")
    parts = F.array(m, shorter, F.regexp_replace(shorter, " [0-9A-Z]{1,4}$", ""))
    return let(F.get(F.filter(parts, valid), F.lit(0)), lambda part: F.when(part.isNotNull(), moved(part)))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))

    def of(o: Column) -> Column:
        number = F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
        out = lambda n: F.concat_ws(".", *((F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)))
        return F.when(F.forall(o, lambda x: x < 256), let(feistel_number(number, 1 << 16, 1 << 16, key, "ip"), out))

    return let(octets, of)


def _phone(m: Column, key: str) -> Column:
    """The country code or trunk prefix stays; the rest is permuted as digits, alike in all layouts of a number."""

    def of(d: Column) -> Column:
        plus = m.startswith("+")
        head = F.when(plus, F.length(F.regexp_extract(m, COUNTRY, 1)) - 1).when(d.startswith("00"), 1 + F.length(F.regexp_extract(F.concat(F.lit("+"), F.substring(d, F.lit(3), F.length(d))), COUNTRY, 1)))
        head = F.coalesce(head, F.when(d.startswith("0") | (F.length(d) == 11), 1).otherwise(0))
        size = F.length(d)
        valid = F.when(plus, size.between(7, 15)).when(d.startswith("00"), size.between(9, 17)).otherwise(size.between(9, 12))
        moved = let(head, lambda h: F.concat(F.substring(d, F.lit(1), h), feistel_text(F.substring(d, h + 1, size), key, "phone")))
        return F.when(valid, _refilled(m, moved))

    return let(_digits(m), of)


def _card(m: Column, key: str) -> Column:
    """The candidate as a whole, or else the layout that it begins or ends with: digits may stand beside a card. The four
    digits that name the network stay."""

    def valid(x: Column) -> Column:
        d = _digits(x)
        return d.rlike(ISSUED) & (_check_digit(F.substring(d, F.lit(1), F.length(d) - 1)).cast("string") == F.substring(d, F.length(d), F.lit(1)))

    def moved(part: Column) -> Column:
        def of(d: Column) -> Column:
            body = F.concat(F.substring(d, 1, 4), feistel_text(F.substring(d, F.lit(5), F.length(d) - 5), key, "card"))
            return let(body, lambda b: _refilled(part, F.concat(b, _check_digit(b).cast("string"))))

        return F.concat(F.substring(m, F.lit(1), F.instr(m, part) - 1), let(_digits(part), of), F.substring(m, F.instr(m, part) + F.length(part), F.length(m)))

    parts = F.array(m, F.regexp_extract(m, f"^{CARD_LAYOUT}(?!\\d)", 0), F.regexp_extract(m, f"(?<!\\d){CARD_LAYOUT}$", 0))
    return let(F.get(F.filter(parts, valid), F.lit(0)), lambda part: F.when(part.isNotNull(), moved(part)))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    back = lambda n: F.floor(n / (99 * 9999))
    out = lambda n: F.concat_ws("-", F.lpad((back(n) + F.when(back(n) > 664, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(n / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((n % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, let(feistel_number(number, 898 * 99, 9999, key, "ssn"), out))


def _date(m: Column, key: str) -> Column:
    """A day for a day, in the same layout; numbers keep their width."""
    first = F.lit(FIRST_DAY).cast("date")
    days = F.filter(F.array(*(F.struct(F.try_to_timestamp(m, F.lit(p)).cast("date").alias("day"), F.lit(p).alias("layout")) for p in DATE_FORMATS)), lambda x: x["day"].isNotNull())

    def shown(x: Column) -> Column:
        part = lambda was, f: F.call_function("date_format", x["moved"], F.when((F.length(was) == 2) & (F.length(f) == 1), F.concat(f, f)).otherwise(f))
        return F.call_function("array_join", F.zip_with(F.split(m, "[-/.]"), F.split(x["layout"], "[-/.]"), part), F.regexp_extract(m, "[-/.]", 0))

    def moved(x: Column) -> Column:
        return F.struct(F.date_add(first, feistel_number(F.datediff(x["day"], first), *DAYS, key, "date").cast("int")).alias("moved"), x["layout"].alias("layout"))

    return let(F.get(days, F.lit(0)), lambda x: F.when(x.isNotNull(), let(moved(x), shown)))


def _pseudonym(m: Column, key: str) -> Column:
    """A struct of the kind of a find and its pseudonym; both null where validation fails."""
    made = {
        "email": _email(m, key),
        "key": _key(m, key),
        "secret": _hex(m, key, "secret"),
        "mac": _hex(m, key, "mac"),
        "ipv6": _ipv6(m, key),
        "iban": _iban(m, key),
        "ip": _ip(m, key),
        "phone": _phone(m, key),
        "card": _card(m, key),
        "ssn": _ssn(m, key),
        "date": _date(m, key),
    }
    shape = {
        "email": m.contains("@"),
        "key": m.rlike(f"^{KEY_HEADS}"),
        "secret": m.rlike("^[0-9a-fA-F]{32,}+$"),
        "mac": m.rlike("^[0-9A-Fa-f]{2}([:-][0-9A-Fa-f]{2}){5}$"),
        "ipv6": m.contains(":"),
        "iban": m.rlike(r"^[A-Z]{2}\d{2}"),
        "ip": m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
        "ssn": m.rlike(r"^\d{3}-\d{2}-\d{4}$"),
        "phone": m.rlike(r"^(?:\+|\(|0\d{1,4}[ /-]|(?:1[ .-])?[2-9]\d{2}[ .-][2-9]\d{2}[ .-]\d{4}$)"),
        "iso_date": m.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"),
        "ymd_date": m.rlike(r"^\d{4}/"),
        "us_date": m.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
        "dot_date": m.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
        "card": F.lit(True),
    }
    kind = reduce(lambda w, k: w.when(shape[k], F.lit(k)), list(shape)[1:], F.when(shape["email"], F.lit("email")))
    has = lambda k, name: k.isin(*DATE_KINDS) if name == "date" else k == name

    def of(k: Column) -> Column:
        value = reduce(lambda w, name: w.when(has(k, name), made[name]), list(made)[1:], F.when(k == "email", made["email"]))
        return let(value, lambda v: F.struct(F.when(v.isNotNull(), k).alias("kind"), F.coalesce(v, m).alias("out")))

    return let(kind, of)


def pseudonymise(documents: DataFrame, text: str = "text", key: str = DEMO_KEY) -> DataFrame:
    """The documents with the text pseudonymised and the array `kinds` of the kinds found, in text order.

    What changes: e-mail local parts of unquoted signs, of any length before a host of any length; IPv4 addresses that
    follow no word for a version; IPv6 and MAC addresses; phone numbers with a plus and 7 to 15 digits, of North America
    with area code, or with a leading 0 or 00 and 9 to 17 digits in groups; Luhn-valid numbers of 13 to 19 digits that card
    networks give out, solid or with one kind of separator (space, hyphen, dot); IBANs with valid check digits; social
    security numbers with hyphens; hexadecimal tokens of 32 or more digits; keys of services known by what they begin
    with (KEY_HEADS); dates of 1900 to 2099 as y-m-d, y/m/d, m/d/y, d/m/y and d.m.y. Mail hosts stay. Candidates that
    fail validation and all other text stay as they are. One projection without shuffle or user function, whole texts of
    any length. A null text stays null with no kinds; an empty one stays empty. Repeated rows, and ties of any kind, get the
    same result each; a column named `kinds` in the input is replaced, all others stay. An empty table gives an empty one.
    """
    source = F.col(f"`{text}`")

    def rebuilt(found: Column) -> Column:
        gaps = F.split(source, ALL, -1)
        return F.struct(
            F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("find")), lambda x: F.concat(x["gap"], F.coalesce(x["find"]["out"], F.lit("")))), "").alias("text"),
            F.filter(F.transform(found, lambda f: f["kind"]), lambda k: k.isNotNull()).alias("kinds"),
        )

    none = F.struct(source.alias("text"), F.array().cast("array<string>").alias("kinds"))
    finds = F.transform(F.regexp_extract_all(source, F.lit(ALL), F.lit(0)), lambda m: _pseudonym(m, key))
    at = unused(documents, "done")
    done = documents.withColumn(at, F.when(source.rlike(r"[0-9@]|[-_][0-9A-Za-z]{10}"), let(finds, rebuilt)).otherwise(none))
    return done.withColumns({text: F.col(f"{at}.text"), "kinds": F.col(f"{at}.kinds")}).drop(at)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudonymised text of every document, with the kinds found and their number."""
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.size("kinds").cast("long").alias("n_pseudonyms"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


QUERIES = {"op3_pseudonyms": op3_pseudonyms}
SQL: dict[str, str] = {}
