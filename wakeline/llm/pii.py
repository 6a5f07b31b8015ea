"""Format-preserving pseudonyms for personal data and secrets, from SQL functions alone.

One pattern finds candidates, at every place the longest. Card numbers, IBANs and phone numbers may be shorter
than what looks like them: the longest reading that ends between two groups and passes its checks counts, the rest
is text again. A candidate that passes the checks of its kind (Luhn digit, octets,
calendar, IBAN remainder, number plan) is permuted by a keyed Feistel network within its format: digits stay
digits, letters stay letters of their case, check digits are set anew, dates stay dates. The permutation
depends on the key, the kind and the format only, so equal values stay equal across documents and different
ones of one format stay different. The key reaches the tasks as the value of a subquery, so no plan or event log shows it.
Dates are replaced wherever they are written out, as nothing tells a birthday from another day.

Cases: a null text stays null and an empty one empty, with no finds; a candidate that fails its checks stays
as it is, and a valid one that begins within it is found; secrets may have any length; other columns, whatever their names, are
carried along, ``n_pii`` and ``pii_kinds`` are replaced; repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import unused

#: Setting of the session with the path of a text file whose first line is the key.
KEY_FILE = "spark.wakeline.pseudonyms.keyFile"

DIGITS, LOWER, UPPER, HEX, UPPER_HEX, CODE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
LOW_DIGITS, HIGH_DIGITS = "01", "23456789"

#: Kinds and what they look like, in order of preference.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "cloud_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|passphrase|pwd|(?:client|app)[_-]?secret|secret(?:[_-]?key)?|(?:auth|access|bearer)[_-]?token|token|(?:api|access|private)[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9_/+.-]{7,}[A-Za-z0-9_/+-](?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:|:(?::[0-9A-Fa-f]{1,4}){2,7})(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2(?:19|20)[0-9]{2})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: Kinds with shorter readings, and the least length of one.
SHORTER = {"iban": 12, "phone": 7, "card": 13}
#: Characters of an IBAN by country: preferred among valid readings. Other countries and lengths are taken as well.
IBAN_LENGTHS = {
    n: countries.split()
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
#: Places are walked in runs of so many, so that lists grow in proportion to a text.
_RUN = 256
ROUNDS = 8
_FIRST_DAY, _DAYS, _HIGH, _LOW = "1900-01-01", 73049, 271, 270  # 1900 to 2099; 271 * 270 is a little more than the days


def _numbered(patterns: dict[str, str], groups: int = 0) -> str:
    """One pattern; each kind is tried in turn at every place. Back references are moved to their place in it, behind ``groups`` others."""
    out = []
    for p in patterns.values():
        own = p.count("([")  # the only capturing groups are those of one character class
        for g in range(own, 0, -1):
            p = p.replace(rf"\{g}", rf"\{g + groups}")
        out.append(p)
        groups += own
    return "|".join(out)


def _place(text: Column, c: Column) -> Column:
    """Where a character first stands in a text, from 1; 0 if nowhere."""
    return F.position(c, text)


def _bind(value: Column, use: callable) -> Column:
    """``use`` with a name for ``value``, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _permuted(symbols: Column, key: Column, tweak: Column) -> Column:
    """Alternating Feistel network over numbers with a radix each: every other number is moved by a hash of the rest."""

    def one_round(acc: Column, i: Column) -> Column:
        other = F.filter(acc, lambda x, j: j % 2 != i % 2)
        digest = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), F.array_join(F.transform(other, lambda x: x["s"].cast("string")), ",")), 256)

        def moved(d: Column) -> Column:
            step = lambda x, j: F.struct(F.pmod(x["s"] + F.pmod(F.xxhash64(d, j), x["r"]), x["r"]).alias("s"), x["r"].alias("r"))
            return F.transform(acc, lambda x, j: F.when(j % 2 == i % 2, step(x, j)).otherwise(x))

        return _bind(digest, moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), symbols, one_round)


def _number(s: Column, r: Column | int) -> Column:
    return F.struct(s.cast("bigint").alias("s"), (F.lit(r) if isinstance(r, int) else r).cast("bigint").alias("r"))


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _alphabet(c: Column, kind: str, before: Column) -> Column:
    """The characters that may take this one's place; empty for what stays."""
    if kind == "code":
        return F.when(c.rlike("[A-Z0-9]"), CODE).otherwise("")
    if kind == "hex":
        return F.when(c.rlike("[0-9a-f]"), HEX).otherwise("")
    if kind == "HEX":
        return F.when(c.rlike("[0-9A-F]"), UPPER_HEX).otherwise("")
    digits = F.lit(DIGITS)
    if kind == "ipv6":
        return F.when(c.rlike("[0-9]"), DIGITS).when(c.rlike("[a-f]"), LOWER[:6]).when(c.rlike("[A-F]"), UPPER[:6]).otherwise("")
    if kind == "phone":  # codes that begin with 2 to 9 keep doing so
        digits = F.when(before.rlike("[0-9]"), DIGITS).when(c.rlike("[2-9]"), HIGH_DIGITS).otherwise(LOW_DIGITS)
    return F.when(c.rlike("[0-9]"), digits).when(c.rlike("[a-z]"), LOWER).when(c.rlike("[A-Z]"), UPPER).otherwise("")


def _by_character(value: Column, key: Column, kind: str) -> Column:
    """Each character is permuted within its alphabet."""

    def run(chars: Column) -> Column:
        sets = F.transform(chars, lambda c, i: _alphabet(c, kind, F.when(i > 0, F.element_at(chars, F.greatest(i, F.lit(1)))).otherwise("")))

        def out(a: Column) -> Column:
            symbols = F.transform(chars, lambda c, i: _number(F.greatest(_place(F.get(a, i), c) - 1, F.lit(0)), F.greatest(F.length(F.get(a, i)), F.lit(1))))
            new = _permuted(symbols, key, F.concat_ws("|", F.lit(kind), F.array_join(a, ",")))
            return F.array_join(F.zip_with(F.zip_with(chars, a, lambda c, x: F.struct(c.alias("c"), x.alias("a"))), new, lambda x, n: F.when(x["a"] == "", x["c"]).otherwise(F.substr(x["a"], (n["s"] + 1).cast("int"), F.lit(1)))), "")

        return _bind(sets, out)

    return _bind(_chars(value), run)


def _luhn(digits: Column) -> Column:
    """Sum of the digits of a number that still lacks its check digit, as the check digit asks for."""
    odd = lambda x: F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
    values = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, odd(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Remainder of the number that IBAN letters and digits spell."""
    worth = lambda c: _place(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.pmod(F.when(worth(c) > 9, a * 100 + worth(c)).otherwise(a * 10 + worth(c)), F.lit(97)).cast("int"))


def _refill(form: Column, digits: Column, what: str = "[0-9]") -> Column:
    """Puts characters in the places of those in ``form``; separators stay."""
    step = lambda acc, c: F.when(c.rlike(what), F.struct(F.concat(acc["t"], F.substr(digits, acc["n"] + 1, F.lit(1))).alias("t"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["t"], c).alias("t"), acc["n"].alias("n")))
    return F.aggregate(_chars(form), F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), step, lambda acc: acc["t"])


def _card_valid(d: Column) -> Column:
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    return (F.pmod(_luhn(body) + F.substr(d, F.length(d), F.lit(1)).cast("int"), F.lit(10)) == 0) & ~d.rlike(r"^(.)\1*$")


def _card(v: Column, key: Column) -> Column:
    def run(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        valid = _card_valid(d)
        new = _bind(_by_character(body, key, "card"), lambda b: F.concat(b, F.pmod(F.lit(10) - F.pmod(_luhn(b), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(valid, _refill(v, new))

    return _bind(F.regexp_replace(v, "[^0-9]", ""), run)


def _iban_valid(x: Column) -> Column:
    return _mod97(F.concat(F.substr(x, F.lit(5), F.length(x)), F.substr(x, F.lit(1), F.lit(4)))) == 1


def _iban(v: Column, key: Column) -> Column:
    def run(x: Column) -> Column:
        body, country = F.substr(x, F.lit(5), F.length(x)), F.substr(x, F.lit(1), F.lit(2))
        valid = _iban_valid(x)
        new = _bind(_by_character(body, key, "iban"), lambda b: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(valid, _refill(v, new, "[A-Z0-9]"))

    return _bind(F.replace(v, F.lit(" "), F.lit("")), run)


def _ip(v: Column, key: Column) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    new = _permuted(F.transform(octets, lambda x: _number(x, 256)), key, F.lit("ip"))
    return F.when(~F.exists(octets, lambda x: x > 255), F.array_join(F.transform(new, lambda x: x["s"].cast("string")), "."))


def _ipv6(v: Column, key: Column) -> Column:
    """Eight groups, or fewer with one gap. Without a digit it is more likely a name. Letters of one case stay of it; of mixed cases each stays what it is."""
    groups = F.size(F.filter(F.split(v, ":"), lambda g: g != ""))
    ok = v.rlike("[0-9]") & F.when(v.contains("::"), groups <= 7).otherwise(groups == 8)
    return F.when(ok & ~v.rlike("[A-F]"), _by_character(v, key, "hex")).when(ok & ~v.rlike("[a-f]"), _by_character(v, key, "HEX")).when(ok, _by_character(v, key, "ipv6"))


def _date(v: Column, key: Column) -> Column:
    """ISO order where the year comes first; otherwise day first, or month first where only that is a date."""
    sep = F.regexp_extract(v, "[-/.]", 0)
    plain = F.regexp_replace(v, "[/.]", "-")
    forms = [(plain.rlike("^[0-9]{4}"), "yyyy-MM-dd"), (F.lit(True), "dd-MM-yyyy"), (F.lit(True), "MM-dd-yyyy")]

    def walk(day: Column) -> Column:
        """Permute until the result is a day of the range again: still a permutation of the days."""

        def again(n: Column) -> Column:
            new = _permuted(F.array(_number(F.floor(n / _LOW), _HIGH), _number(F.pmod(n, F.lit(_LOW)), _LOW)), key, F.lit("date"))
            return _bind(new, lambda p: p[0]["s"] * _LOW + p[1]["s"])

        start = again(day)
        return F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, lambda n, i: F.when(n >= _DAYS, again(n)).otherwise(n))

    out = F.lit(None).cast("string")
    for cond, form in reversed(forms):
        at = F.try_to_timestamp(plain, F.lit(form)).cast("date")
        n = F.datediff(at, F.lit(_FIRST_DAY).cast("date")).cast("bigint")
        new = F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), walk(n).cast("int")), form)
        out = F.when(cond & at.isNotNull(), F.replace(new, F.lit("-"), sep)).otherwise(out)
    return out


def _phone(v: Column, key: Column) -> Column:
    """The country code after a plus stays."""
    code = F.regexp_extract(v, r"^\+[0-9]{1,3}(?=[ .-])|^\+[0-9]{1,2}", 0)
    n = F.length(F.regexp_replace(v, "[^0-9]", ""))
    return F.when((n >= 7) & (n <= 15), F.concat(code, _by_character(F.substr(v, F.length(code) + 1, F.length(v)), key, "phone")))


def _ssn(v: Column, key: Column) -> Column:
    """Area and group numbers that are never given out are no numbers."""
    return F.when(~v.rlike("^(?:000|666|9)|^...-00|0000$"), _by_character(v, key, "ssn"))


def _email(v: Column, key: Column) -> Column:
    """The last label of the host stays."""
    top = F.regexp_extract(v, r"\.[A-Za-z]+$", 0)
    return F.concat(_by_character(F.substr(v, F.lit(1), F.length(v) - F.length(top)), key, "email"), top)


def _secret(v: Column, key: Column) -> Column:
    """The name before the sign stays."""
    name = F.regexp_extract(v, r"^[A-Za-z_-]+ ?[=:] ?[\"']?", 0)
    value = F.substr(v, F.length(name) + 1, F.length(v))
    return F.concat(name, F.when(value.rlike("^[0-9a-f]+$"), _by_character(value, key, "hex")).otherwise(_by_character(value, key, "secret")))


def _cloud_key(v: Column, key: Column) -> Column:
    return F.concat(F.substr(v, F.lit(1), F.lit(4)), _by_character(F.substr(v, F.lit(5), F.lit(16)), key, "code"))


_RULES = {"email": _email, "cloud_key": _cloud_key, "secret": _secret, "iban": _iban, "ipv6": _ipv6, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _reading(value: Column, kind: str) -> Column:
    """The part of a candidate that is a valid value of its kind: the longest, but an IBAN of its country's length first. Null if none is."""
    plain = lambda v: F.regexp_replace(v, "[^0-9A-Z]", "")
    valid = {"iban": lambda v: _iban_valid(plain(v)), "phone": lambda v: F.length(plain(v)).between(7, 15), "card": lambda v: _card_valid(plain(v))}[kind]

    def fits(n: Column) -> Column:
        v = F.substr(value, F.lit(1), n)
        return ~F.substr(value, n + 1, F.lit(1)).rlike("[0-9A-Za-z]") & v.rlike(rf"^(?:{PATTERNS[kind]})$") & valid(v)

    ends = F.filter(F.sequence(F.lit(SHORTER[kind]), F.greatest(F.length(value), F.lit(SHORTER[kind]))), lambda n: (n <= F.length(value)) & fits(n))
    usual = F.lit(0)
    if kind == "iban":
        for n, countries in IBAN_LENGTHS.items():
            usual = F.when(F.substr(value, F.lit(1), F.lit(2)).isin(*countries), n).otherwise(usual)
    best = F.array_max(F.transform(ends, lambda n: F.struct((F.length(plain(F.substr(value, F.lit(1), n))) == usual).alias("usual"), n.alias("n"))))
    return F.substr(value, F.lit(1), best["n"])


def pseudonym(value: Column, key: Column, kinds: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """A struct of kind, pseudonym and how many characters of a candidate it replaces; null where the candidate fails the checks of every kind.

    A value that looks like several kinds is of the first whose checks it passes.
    """

    def tried(k: str) -> Column:
        made = lambda v: F.struct(F.lit(k).alias("kind"), _RULES[k](v, key).alias("new"), F.length(v).alias("taken"))
        return F.when(value.rlike(rf"^(?:{PATTERNS[k]})$"), _bind(_reading(value, k), made) if k in SHORTER else made(value))

    return F.get(F.filter(F.array(*map(tried, kinds)), lambda t: t["new"].isNotNull()), 0)


def _walk(found: Column) -> Column:
    """Pieces of a text in order, each with the pseudonym of the candidate at its beginning, as replaced pieces with their kinds.

    A value that is replaced takes characters of its own piece and of those after it; candidates that begin there are passed over.
    """
    none = F.array().cast("array<struct<text:string,kind:string>>")

    def step(acc: Column, f: Column) -> Column:
        n, free, p = F.length(f["piece"]), acc["skip"] == 0, f["p"]
        hit = free & p["kind"].isNotNull()
        gone = F.when(hit, p["taken"]).otherwise(acc["skip"])
        text = F.concat(F.when(hit, p["new"]).otherwise(""), F.substr(f["piece"], gone + 1, n))
        return F.struct(F.greatest(gone - n, F.lit(0)).alias("skip"), F.concat(acc["out"], F.array(F.struct(text.alias("text"), F.when(hit, p["kind"]).alias("kind")))).alias("out"))

    def run(acc: Column, i: Column) -> Column:
        own = F.aggregate(F.slice(found, i * _RUN + 1, F.lit(_RUN)), F.struct(acc["skip"].alias("skip"), none.alias("out")), step)
        return _bind(own, lambda r: F.struct(r["skip"].alias("skip"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<array<struct<text:string,kind:string>>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(found) / _RUN).cast("int")), start, run, lambda acc: F.flatten(acc["out"]))


def session_key(spark: SparkSession) -> str:
    """The key in the file that the session names; where it names none, a new random one: its pseudonyms are linked within one run and nobody can compute them again."""
    path = spark.conf.get(KEY_FILE, None)
    if not path:
        return secrets.token_hex(32)
    first = spark.read.text(path).first()
    if first is None or not first[0].strip():
        raise ValueError(f"{KEY_FILE} names a file without a key")
    return first[0].strip()


def pseudonymise(df: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """Replaces personal data and secrets in ``text``; adds ``n_pii`` (how many) and ``pii_kinds`` (sorted, distinct)."""
    df = df.drop(*[c for c in ("n_pii", "pii_kinds") if c != text])
    secret, spotted, found = unused(df, "key", "spots", "found")
    pattern = _numbered({k: PATTERNS[k] for k in kinds}, 1)  # in group 1
    value = F.col(text)
    some = F.coalesce(value.rlike(r"[0-9@]|(?i:password|passwd|passphrase|pwd|secret|token|key) ?[=:]"), F.lit(False))
    led = F.concat(F.lit("\n"), value)  # so that no candidate begins at the first character, where nothing is split off
    spots = F.when(some, F.regexp_extract_all(led, F.lit(f"(?=({pattern}))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({spotted: spots, secret: df.sparkSession.createDataFrame([(key,)], "key string").scalar()})
    gone = F.lit(None).cast("struct<kind:string,new:string,taken:int>")
    made = lambda i: pseudonym(F.get(F.col(spotted), i - 1), F.col(secret), kinds)
    pieces = F.transform(F.split(led, f"(?=({pattern}))", -1), lambda p, i: F.struct(p.alias("piece"), F.when(i > 0, made(i)).otherwise(gone).alias("p")))
    df = df.withColumn(found, F.when(F.size(spotted) > 0, pieces))
    df = df.withColumn(found, F.when(F.col(found).isNotNull(), _walk(F.col(found))))
    hits = F.coalesce(F.filter(found, lambda f: f["kind"].isNotNull()), F.array().cast("array<struct<text:string,kind:string>>"))
    return (
        df.withColumn("n_pii", F.size(hits).cast("bigint"))
        .withColumn("pii_kinds", F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda f: f["kind"]))), ","))
        .withColumn(text, F.when(F.col(found).isNotNull(), F.substr(F.array_join(F.transform(found, lambda f: f["text"]), ""), F.lit(2))).otherwise(value))
        .drop(found, spotted, secret)
    )
