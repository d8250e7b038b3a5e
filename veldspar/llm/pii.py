"""Personal data and secrets replaced by surrogates, in native DataFrame operations.

One pattern finds emails, cards, phones, social security numbers, IBANs, IP addresses, secrets and titled names.  Each
entity gets a keyed surrogate of its own type and format:

* Digits (cards, phones, social security numbers), IBANs, IPv4 addresses, secrets and surnames go through :func:`_turned`, a keyed permutation of the
  strings of one format, so distinct ones stay distinct and none stays itself, by construction and whatever their number.  A character
  keeps its kind: digits, small and capital letters, hexadecimal digits of long digests, vowels and consonants of a script.  Punctuation, country codes, a card's first digit and
  whether its Luhn digit is right are kept.
* First names follow script (Latin, Cyrillic, Greek) and gender by title: a listed one becomes another of its list, any other a listed one with the permuted name after it.
  No listed name begins with another one, so these stay distinct too.
* Emails and IPv6 addresses are keyed hashes of 100 bits or so.
* An entity is normalised first (case of emails, format of numbers, blanks of names), so one person's number written in two
  ways keeps one surrogate number, and "Mr A B" and "Mr B" share the surname: coreference survives.

:func:`surrogates` checks the corpus: no two normalised entities of a type may share a surrogate, and none may be its own.
Were hashes to clash, which no size of corpus makes likely, all would be drawn again with another salt.  Only one count reaches the driver.

Texts without entities come back unchanged, null and empty ones too.  Repeated rows are replaced alike.  Other columns of any name pass
through; only a column that is named for the types of entities must be new, else ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import quoted, unused

KEY = "veldspar-surrogates"
MAX_SALTS = 20

_EMAIL = r"(?<![\p{L}\p{N}._+\-])[\p{L}\p{N}._+\-]{1,256}+@[\p{L}\p{N}\-]{1,63}+(?:\.[\p{L}\p{N}\-]{1,63}+){1,126}"
_IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
_QUAD = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
#: With "::", a group of four, two groups before it or two after it are needed: slices and scopes of code (1::2, std::c) are no addresses.
_IPV6 = (
    rf"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}:){{6}}(?:{_QUAD}|[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f]{{1,4}}(?![0-9A-Fa-f:]))"
    rf"|(?<![\p{{L}}\p{{N}}:])(?=[A-Fa-f:]{{0,39}}\d)(?:(?:[0-9A-Fa-f]{{4}}|[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f]{{1,4}})(?::[0-9A-Fa-f]{{1,4}}){{0,6}}::(?:(?:[0-9A-Fa-f]{{1,4}}:){{0,5}}(?:{_QUAD}|[0-9A-Fa-f]{{1,4}}))?|::(?:[0-9A-Fa-f]{{1,4}}:){{1,6}}(?:{_QUAD}|[0-9A-Fa-f]{{1,4}}))(?![\p{{L}}\p{{N}}:])"
)
_CARD = r"(?<![\d])(?:[3-6]\d{3}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|3[47]\d{2}[ \-]\d{6}[ \-]\d{5}|[2-6]\d{12,18})(?!\d)"
#: International numbers of eight digits or more in groups of any size, then national ones: of ten digits with or without a 1, and with a leading 0.
_PHONE = (
    r"(?<![\d+])(?=[+(\d])(?:\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\+(?=(?:[ .\-()]{0,3}\d){8})\d{1,3}[ .\-]?(?:\(0\) ?)?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,5}"
    r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|\d{3} \d{3} \d{4}"
    r"|(?<![\d.,/\-])(?:0\d(?:[ .\-]\d{2}){4}|(?=(?:[ /\-()]{0,2}\d){9})(?:\(0\d{1,4}\) ?|0\d{1,4}[ /\-])\d{3,8}(?:[ \-]\d{2,5}){0,3}|0[1-9]\d{8,9}(?![.,]\d)))(?!\d)"
)
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
#: Countries by the length of their IBANs; of another country or length, the last group has one to four characters and, where short, a digit.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = (
    r"(?<![A-Z0-9])(?=[A-Z]{2}\d{2})(?:"
    + "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Z0-9])" for n, c in _IBAN_LENGTHS.items())
    + r"|[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?(?=[A-Z]{0,2}\d)[A-Z0-9]{1,3}|[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?![A-Z0-9]))"
)
#: What stands before a secret and stays; no look-behind of many lengths, which would be tried at every place of a text.
_LABEL = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Kk]ey|KEY|[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd)[\"']? {0,2}[:=] {0,2}[\"']?|=[\"']?(?=[A-Za-z+/_\-]{0,20}\d[A-Za-z0-9+/_\-]{15})|(?:AKIA|ASIA|sk-|gh[pousr]_|xox[abp]-|AIza)"
_SECRET = (
    r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Kk]ey|KEY|[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd)[\"']? {0,2}[:=] {0,2}[\"']?(?=[+/_.\-]*+[A-Za-z0-9])[A-Za-z0-9+/_.\-]{8,}+"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:sk-|gh[pousr]_|xox[abp]-|AIza)[A-Za-z0-9_\-]{16,}+|(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"
    r"|=[\"']?(?=[A-Za-z+/_\-]{0,20}\d)[A-Za-z0-9+/_\-]{16,}+"
)
_NAME = r"(?<![\p{L}])(?:Mr|Mrs|Ms|Miss|Mme|Mlle|Herr|Frau|Sr|Sra|Señor|Señora|Г-н|Г-жа|Κος|Κα)\.? \p{Lu}\p{L}{1,40}(?: \p{Lu}\p{L}{1,40}){0,2}"
PATTERN = "|".join([_EMAIL, _SECRET, _IPV4, _IPV6, _CARD, _SSN, _PHONE, _IBAN, _NAME])
#: Every entity has one of these characters or is a titled name: texts without any need no search.
_HINT, _TITLES = "[0-9@=:]", r"(?:Mr|Ms|Miss|Mme|Mlle|Herr|Frau|Sr|Señor|Г-|Κ)"

#: What stays of a phone: the country code or the 0 of a national number.
_PREFIX = r"^(?:\+\d{1,3}(?=\D)|\(?0)"

_FIRST = {
    ("latin", "f"): "Anna Clara Elena Emma Ines Julia Laura Lea Lena Maria Marta Nina Nora Paula Rosa Sara".split(),
    ("latin", "m"): "Adam Bruno David Emil Felix Hugo Ivan Jonas Karl Leo Lukas Marco Oscar Peter Simon Tomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Зоя Инна Ирина Лидия Майя Мария Нина Нонна Ольга Раиса Софья Яна".split(),
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Иван Илья Кирилл Лев Марк Олег Павел Роман Семён Юрий".split(),
    ("greek", "f"): "Άννα Δάφνη Ειρήνη Ελένη Εύα Ζωή Ηρώ Θάλεια Ιωάννα Κλειώ Λένα Μαρία Νίκη Ξένια Ρέα Σοφία".split(),
    ("greek", "m"): "Άγγελος Άρης Γιάννης Δήμος Ηλίας Θάνος Κώστας Λουκάς Μάριος Νίκος Ορέστης Πάνος Πέτρος Σάββας Στάθης Φώτης".split(),
}


def _hash(key: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", key, *parts), 256)


def _number(hexadecimal: Column, start: int | Column, digits: int) -> Column:
    return F.conv(F.substring(hexadecimal, start, F.lit(digits) if isinstance(start, Column) else digits), 16, 10).cast("long")


def _cat(e: Column) -> Column:
    """The type of an entity that PATTERN found."""
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ipv4")
        .when(e.rlike(rf"^(?:{_IPV6})$"), "ipv6")
        .when(e.rlike(rf"^(?:{_SSN})$"), "ssn")
        .when(e.rlike(rf"^(?:{_CARD})$"), "card")
        .when(e.rlike(rf"^(?:{_PHONE})$"), "phone")
        .when(e.rlike(rf"^(?:{_NAME})$"), "name")
        .when(e.rlike(rf"^(?:{_IBAN})$") & e.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .otherwise("secret")
    )


def _normal(kind: Column, e: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "ipv6", _groups(e))
        .when(kind == "phone", F.concat(F.regexp_replace(F.regexp_extract(e, _PREFIX, 0), r"\(", ""), F.lit("/"), F.regexp_replace(F.regexp_replace(e, _PREFIX, ""), r"\D", "")))
        .when(kind.isin("card", "ssn", "iban"), F.regexp_replace(e, r"[ \-]", ""))
        .when(kind == "name", F.lower(F.regexp_replace(F.regexp_replace(e, r"^\S+ ", ""), " +", " ")))
        .otherwise(_value(e))
    )


def _search(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.when(text.rlike(_HINT) | text.rlike(_TITLES), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value taken once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: An even number, so that the halves of a list end where they began.
ROUNDS = 4


def _turned(key: Column, tweak: Column, values: Column, sizes: Column) -> Column:
    """A keyed permutation without fixed points of the lists of integers below ``sizes``: rounds of a Feistel network over both
    halves of the list, then one more at the first place that can change, then the rounds backwards."""

    def halves(v: Column, s: Column) -> Column:
        return _let(F.floor(F.size(v) / 2).cast("int"), lambda h: F.struct(F.slice(v, F.lit(1), h).alias("a"), F.slice(v, h + 1, F.size(v) - h).alias("b"), F.slice(s, F.lit(1), h).alias("m"), F.slice(s, h + 1, F.size(s) - h).alias("n")))

    def moved(v: Column, sizes: Column, other: Column, r: Column, sign: int) -> Column:
        seed = F.sha2(F.concat_ws("\x1f", key, tweak, F.size(v).cast("string"), r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / 32).cast("int"))
        blocks = _let(seed, lambda d: F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.concat_ws("\x1f", d, i.cast("string")), 256)))
        byte = lambda bs, j: _number(F.get(bs, F.shiftright(j, 5)), 2 * (j % 32) + 1, 2).cast("int")
        return _let(blocks, lambda bs: F.transform(v, lambda x, j: F.pmod(x + sign * byte(bs, j), F.get(sizes, j))))

    def on(acc: Column, r: Column) -> Column:
        return F.struct(moved(acc.b, acc.n, acc.a, r, 1).alias("a"), acc.a.alias("b"), acc.n.alias("m"), acc.m.alias("n"))

    def back(acc: Column, r: Column) -> Column:
        return F.struct(acc.b.alias("a"), moved(acc.a, acc.m, acc.b, r, -1).alias("b"), acc.n.alias("m"), acc.m.alias("n"))

    def more(acc: Column) -> Column:
        v, s = F.concat(acc.a, acc.b), F.concat(acc.m, acc.n)
        first = F.array_position(F.transform(s, lambda x: x > 1), F.lit(True)).cast("int") - 1
        return _let(first, lambda k: halves(F.transform(v, lambda x, j: F.when(j == k, (x + 1) % F.get(s, j)).otherwise(x)), s))

    there = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), halves(values, sizes), on, more)
    return F.aggregate(F.array(*[F.lit(i) for i in reversed(range(ROUNDS))]), there, back, lambda acc: F.concat(acc.a, acc.b))


def _permuted(key: Column, tweak: Column, text: Column, kinds: Column) -> Column:
    """text with its characters of ``kinds`` (an array of alphabets that share no character) moved within their kind by :func:`_turned`."""
    described = lambda c: F.struct(c.alias("c"), F.get(F.filter(kinds, lambda k: F.position(c, k) > 0), F.lit(0)).alias("k"))
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), described)
    place = lambda x: F.coalesce(F.position(x.c, x.k).cast("int") - 1, F.lit(0))
    shown = lambda x, v: F.coalesce(F.substring(x.k, v + 1, F.lit(1)), x.c)
    return _let(chars, lambda xs: F.array_join(F.zip_with(xs, _turned(key, tweak, F.transform(xs, place), F.transform(xs, lambda x: F.coalesce(F.length(x.k), F.lit(1)))), shown), ""))


DIGITS, SMALL, CAPITALS, HEXADECIMAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Vowels and consonants, plain and with marks, of each script.
LETTERS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "áàâäãåéèêëíìîïóòôöõøúùûüý", "çñßšžčćńśźřťďğłşđ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "ёіїєґ", "αεηιουω", "βγδζθκλμνξπρστφχψς", "άέήίόύώ")

#: One character for each number below 256.
OCTETS = "".join(chr(0x4E00 + i) for i in range(256))


def _check_digit(payload: Column) -> Column:
    """The Luhn digit of a payload."""
    digits = F.reverse(F.split(payload, ""))
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(digits, lambda c, i: F.when(i % 2 == 0, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("int")


def _fill(e: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """e with its characters of a kind, from the left, replaced by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike(f"^{kind}$"), F.struct(F.concat(acc.out, F.substring(digits, acc.k + 1, F.lit(1))).alias("out"), (acc.k + 1).alias("k"))).otherwise(F.struct(F.concat(acc.out, c).alias("out"), acc.k.alias("k")))

    return F.aggregate(F.split(e, ""), start, step, lambda acc: acc.out)


def _letters(hexadecimal: Column) -> Column:
    return F.translate(hexadecimal, "0123456789abcdef", "abcdefghjkmnpqrs")


def _email(key: Column, e: Column) -> Column:
    low = F.lower(e)
    domain = F.regexp_extract(low, r"@(.*)$", 1)
    return F.concat(F.lit("u"), _letters(F.substring(_hash(key, F.lit("email"), low), 1, 26)), F.lit("@d"), _letters(F.substring(_hash(key, F.lit("domain"), domain), 1, 10)), F.lit(".example.org"))


def _value(e: Column) -> Column:
    """A secret without what stands before it."""
    return F.regexp_replace(e, rf"^(?:{_LABEL})", "")


def _groups(e: Column) -> Column:
    """An IPv6 address in lower case with all its groups, without leading zeros; the last two may be an IPv4 address."""
    quad = F.split(F.regexp_extract(e, r"\d+\.\d+\.\d+\.\d+$", 0), r"\.")
    half = lambda i: F.hex(F.get(quad, F.lit(i)).cast("long") * 256 + F.get(quad, F.lit(i + 1)).cast("long"))
    flat = F.when(e.contains("."), F.concat(F.regexp_replace(e, r"\d+\.\d+\.\d+\.\d+$", ""), half(0), F.lit(":"), half(2))).otherwise(e)
    sides = F.split(F.lower(flat), "::")
    side = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(side(0)) - F.size(side(1))))
    return F.array_join(F.transform(F.concat(side(0), zeros, side(1)), lambda g: F.regexp_replace(g, r"^0+(?=.)", "")), ":")


def _ipv6(key: Column, e: Column) -> Column:
    h = _hash(key, F.lit("ipv6"), _groups(e))
    return F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(h, 1 + 4 * i, 4)) for i in range(6)])


def _next(key: str, names: list[str]) -> list[str]:
    """What each name of a list becomes: the next one in a keyed order, so distinct names stay distinct and none stays itself."""
    order = sorted(names, key=lambda x: hashlib.sha256(f"{key}\x1ffirst\x1f{x}".encode()).digest())
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    return [after[x] for x in names]


def _named(secret: str, e: Column, words: Column, turned: Column) -> Column:
    """A titled name: the title, first names by gender and script, and the surname.  words: its words in lower case; turned: the
    same, permuted, or a hash for letters that no kind has (of a script that isn't known here)."""
    title = F.regexp_extract(e, r"^\S+ ", 0)
    woman = title.rlike(r"^(?:Mrs|Ms|Miss|Mme|Mlle|Frau|Sra|Señora|Г-жа|Κα)\b|^(?:Г-жа|Κα)")
    lists = [(s, g) for s in ("latin", "cyrillic", "greek") for g in "fm"]
    listed = F.array(*[F.array(*[F.lit(x.lower()) for x in _FIRST[k]]) for k in lists])
    after = F.array(*[F.array(*[F.lit(x) for x in _next(secret, _FIRST[k])]) for k in lists])
    stems = F.array(*[F.array(*[F.lit(x) for x in _FIRST[k]]) for k in lists])

    def first(w: Column, t: Column) -> Column:
        at = F.when(w.rlike(r"^\p{IsCyrillic}"), 2).when(w.rlike(r"^\p{IsGreek}"), 4).otherwise(0) + F.when(woman, 0).otherwise(1)
        place = F.array_position(F.get(listed, at), w).cast("int")
        stem = F.get(F.get(stems, at), (_number(_hash(F.lit(secret), F.lit("first"), w), 1, 8) % 16).cast("int"))
        return F.when(place > 0, F.get(F.get(after, at), place - 1)).otherwise(F.concat(stem, t))

    both = F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, F.initcap(F.get(turned, i))).otherwise(first(w, F.get(turned, i))))
    return F.concat(title, F.array_join(both, " "))


def surrogate(kind: Column, e: Column, key: str, salt: int) -> Column:
    secret = f"{key}#{salt}"
    k = F.lit(secret)
    digits = F.regexp_replace(e, r"\D", "")
    country = F.regexp_extract(e, _PREFIX, 0)
    local = F.substring(e, F.length(country) + 1, F.length(e))
    plain = F.regexp_replace(e, " ", "")
    value = _value(e)
    # what is permuted, apart from what, and its kinds of characters: one permutation serves all types
    octets = F.array_join(F.transform(F.split(e, r"\."), lambda o: F.substring(F.lit(OCTETS), o.cast("int") + 1, F.lit(1))), "")
    parts = (
        F.when(kind == "card", F.array(F.substring(digits, F.lit(2), F.length(digits) - 2))).when(kind == "phone", F.array(F.regexp_replace(local, r"\D", ""))).when(kind == "ssn", F.array(digits))
        .when(kind == "iban", F.array(F.substring(plain, F.lit(3), F.length(plain)))).when(kind == "ipv4", F.array(octets))
        .when(kind == "name", F.split(F.lower(F.regexp_replace(e, r"^\S+ ", "")), " ")).when(kind == "secret", F.array(value)).otherwise(F.array().cast("array<string>"))
    )
    # that long, no text of other characters becomes hexadecimal by chance
    digest = (kind == "secret") & value.rlike("^[0-9a-f]{32,}$")
    tweak = F.concat_ws(" ", kind, F.when(kind == "card", F.substring(digits, 1, 1)).when(kind == "iban", F.substring(plain, 1, 2)).when(digest, "digest"))
    alphabets = lambda *xs: F.array(*[F.lit(x) for x in xs])
    kinds = (
        F.when(kind.isin("card", "phone", "ssn"), alphabets(DIGITS)).when(kind == "iban", alphabets(DIGITS, CAPITALS)).when(kind == "ipv4", alphabets(OCTETS)).when(kind == "name", alphabets(*LETTERS))
        .when(digest, alphabets(HEXADECIMAL)).otherwise(alphabets(DIGITS, SMALL, CAPITALS))
    )
    unknown = lambda x: F.when((kind == "name") & ~x.rlike("[" + "".join(LETTERS) + "]"), _letters(F.substring(_hash(k, F.lit("name"), x), 1, 26)))
    turned = _let(F.struct(tweak.alias("t"), kinds.alias("k")), lambda s: F.transform(parts, lambda x: F.coalesce(unknown(x), _permuted(k, s.t, x, s.k))))

    def shown(t: Column) -> Column:
        one = F.get(t, F.lit(0))
        moved = F.concat(F.substring(digits, 1, 1), one)
        off = F.pmod(F.substring(digits, F.length(digits), F.lit(1)).cast("int") - _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)), F.lit(10))
        address = F.array_join(F.transform(F.filter(F.split(one, ""), lambda c: c != ""), lambda c: (F.position(c, F.lit(OCTETS)) - 1).cast("string")), ".")
        return (
            F.when(kind == "card", _fill(e, F.concat(moved, F.pmod(_check_digit(moved) + off, F.lit(10)).cast("string")))).when(kind == "phone", F.concat(country, _fill(local, one))).when(kind == "ssn", _fill(e, one))
            .when(kind == "iban", _fill(e, F.concat(F.substring(plain, 1, 2), one), "[0-9A-Z]")).when(kind == "ipv4", address).when(kind == "name", _named(secret, e, parts, t))
            .otherwise(F.concat(F.substring(e, F.lit(1), F.length(e) - F.length(value)), one))
        )

    return F.when(kind == "email", _email(k, e)).when(kind == "ipv6", _ipv6(k, e)).otherwise(_let(turned, shown))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, entity) for every entity of every text, in order of the texts."""
    found = docs.select(F.explode(_search(F.col(quoted(text)))).alias("entity"))
    return found.select(_cat(F.col("entity")).alias("kind"), "entity")


def surrogates(docs: DataFrame, text: str = "text", key: str = KEY) -> int:
    """The first salt under which distinct entities of docs keep distinct surrogates and none is its own."""
    # distinct entities are few against the texts, so tasks would be merged by size; their surrogates are the work
    seen = entities(docs, text).distinct().repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for salt in range(MAX_SALTS):
        both = seen.select("kind", _normal(F.col("kind"), F.col("entity")).alias("n"), F.col("entity"), surrogate(F.col("kind"), F.col("entity"), key, salt).alias("s"))
        named = both.select("kind", "n", _normal(F.col("kind"), F.col("s")).alias("s"))
        clash = named.groupBy("kind", "s").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") == F.col("s")).alias("same")).where("lo <> hi OR same")
        if not clash.limit(1).count():
            return salt
    raise RuntimeError(f"no salt below {MAX_SALTS} keeps all entities apart")


def replace(docs: DataFrame, text: str = "text", key: str = KEY, salt: int | None = None, found: str | None = None) -> DataFrame:
    """docs with the entities of ``text`` replaced; ``found``, if given, names a column for the array of their types.

    salt: from :func:`surrogates`, which runs over docs where it isn't given.
    """
    if found and found.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {found} is already there")
    if salt is None:
        salt = surrogates(docs, text, key)
    at = unused(docs.columns)
    entities_, types, full = f"{at}_found", f"{at}_kinds", F.col(quoted(text))
    some = docs.withColumn(entities_, _search(full))
    some = some.withColumn(types, F.transform(entities_, _cat))
    new = F.zip_with(types, entities_, lambda k, e: surrogate(k, e, key, salt))
    gaps = F.split(full, PATTERN, -1)
    woven = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    out = F.when(F.size(entities_) > 0, woven).otherwise(full)
    return some.select(*[out.alias(c) if c == text else F.col(quoted(c)) for c in docs.columns], *([F.col(types).alias(found)] if found else []))
