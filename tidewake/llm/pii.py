"""Operator 6, personal data: format-preserving pseudonyms by keyed Feistel networks. DataFrame functions only.

What looks like personal data is validated (checksums, ranges, calendar) and
then permuted inside its format, so a value has one pseudonym in all documents
and different values have different ones. Everything else stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates from FIRST_DAY on are permuted among DAY_ROWS * DAY_COLUMNS days.
FIRST_DAY, DAY_ROWS, DAY_COLUMNS = "1900-01-01", 270, 271
#: A national identification number is an area (1 to 899 but 666), a group (1 to 99) and a serial number (1 to 9999).
AREAS, GROUPS, SERIALS = 898, 99, 9999

_EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_IP = r"\d{1,3}(?:\.\d{1,3}){3}"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}"
_NATIONAL = r"\d{3}-\d{2}-\d{4}"
_PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}"
_LOCAL = r"\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
_CARD = r"\d(?:[ -]?\d){12,18}"
#: Groupings in which a card may stand beside other numbers.
_GROUPED = r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}"
#: Numbers of 13 digits or more together; what begins a value of another kind is not part of them.
_RUN = rf"(?=\d(?:[ -]?\d){{12}})\d+(?:[ -](?!(?:{_IP}|{_DATE}|{_NATIONAL})(?!\w))\d+){{0,400}}"
_SECRET = r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})"
#: Beginnings of access keys of public services, and what may follow (fixed values of these formats).
_ACCESS = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,80}|sk-[A-Za-z0-9]{20,80})"
#: First digits of payment cards: travel and entertainment, banks, and the range of the second series of one issuer.
_ISSUER = r"(?:[3-6]|2[2-7])"
_LED = r"""(?<=(?i:token|secret|key|password|passwd)["']{0,1}\s{0,3}[=:]\s{0,3}["']{0,1})"""
#: The whole pattern; single values never stand inside longer words, numbers or dotted groups.
FIND = (
    rf"(?<![\w.-])\d{{4}}-\d{{2}}-\d{{2}}(?=T\d{{2}})|(?:{_LED}{_SECRET}|(?<![\w.+-])(?:{_EMAIL})|(?<![\w.-])(?:{_IP}|{_DATE}|{_NATIONAL}|{_ACCESS})(?![\w-]|\.\d)"
    rf"|(?<![\w]){_PHONE}(?![\w-])|(?<![\w.+-])(?:{_LOCAL})(?![\w-]|\.\d)|(?<![\w.-])(?:{_RUN}))(?!\w)"
)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digest(key: str, salt: str, n: Column, value: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("|", F.lit(key), F.lit(salt), n.cast("string"), value.cast("string")), "UTF-8"), 256)


def permute_pair(left: Column, right: Column, a: int, b: int, key: str, salt: str) -> Column:
    """Feistel network on [0, a) x [0, b): struct (l, r). Each round adds a keyed hash of one side to the other."""

    def mixed(n: Column, x: Column) -> Column:
        return F.conv(F.substring(_digest(key, salt, n, x), 1, 15), 16, 10).cast("long")

    def turn(acc: Column, n: Column) -> Column:
        on_left = F.pmod(acc["l"] + mixed(n, acc["r"]), F.lit(a))
        on_right = F.pmod(acc["r"] + mixed(n, acc["l"]), F.lit(b))
        even = n % 2 == 0
        return F.struct(F.when(even, on_left).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(on_right).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permute_characters(text: Column, key: str, salt: str, alphabet: str = "") -> Column:
    """Feistel network on the halves of a string, class by class: digits stay digits, and letters of a case stay such.

    With ``alphabet`` its characters are one class and nothing else changes.
    Equal-length strings of the same pattern of classes are permuted among
    themselves. A round's key stream is a hash of the other half, two hex
    digits for each character.
    """

    def shifted(half: Column, digest: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            s = F.conv(F.substring(digest, F.pmod(i * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
            if alphabet:
                at = F.instr(F.lit(alphabet), c)
                return F.when(at > 0, F.substring(F.lit(alphabet), F.pmod(at - 1 + s, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(c)
            code = F.ascii(c)
            new = c
            for low, size in ((97, 26), (65, 26), (48, 10)):
                new = F.when(code.between(low, low + size - 1), F.chr((F.pmod(code - low + s, F.lit(size)) + low).cast("long"))).otherwise(new)
            return new

        return F.transform(half, move)

    def turn(acc: Column, n: Column) -> Column:
        digest = _digest(key, salt, n, F.array_join(acc["r"], ""))
        return F.struct(acc["r"].alias("l"), _bind(digest, lambda d: shifted(acc["l"], d)).alias("r"))

    n = F.char_length(text)
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    start = F.struct(
        letters(F.substring(text, F.lit(1), (n / 2).cast("int"))).alias("l"),
        letters(F.substring(text, (n / 2).cast("int") + 1, n)).alias("r"),
    )
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return _bind(out, lambda o: F.array_join(F.concat(o["l"], o["r"]), ""))


def luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Sum of the Luhn check; ``doubled_first``: whether the first digit is one of those doubled."""
    each = F.filter(F.split(digits, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("sum"), doubled_first.alias("twice"))

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(acc["twice"], 2).otherwise(1)
        return F.struct((acc["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (~acc["twice"]).alias("twice"))

    return F.aggregate(each, start, add)["sum"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _in_form(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced by ``digits`` in order: numbers are permuted whatever separates their digits."""

    def put(c: Column, i: Column, d: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.substring(d, F.char_length(_digits(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    characters = F.filter(F.split(m, ""), lambda c: c != "")
    return _bind(digits, lambda d: F.array_join(F.transform(characters, lambda c, i: put(c, i, d)), ""))


def _part(m: Column, separator: str, k: int) -> Column:
    return F.get(F.split(m, separator), F.lit(k)).cast("int")


def _day(m: Column) -> Column:
    iso = F.when(
        m.contains("/"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))
    ).otherwise(m)
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.to_date(F.lit(FIRST_DAY)))


def kind_of(m: Column) -> Column:
    """Kind of a matched string if it is valid, else null."""
    area, group, serial = (_part(m, "-", k) for k in range(3))
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(f"^(?:{_SECRET})$") & m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), F.lit("secret"))
        .when(m.rlike(f"^{_ACCESS}$"), F.when(m.rlike("[0-9]"), F.lit("access_key")))
        .when(m.rlike(f"^{_IP}$"), F.when(octets, F.lit("ip")))
        .when(m.rlike(f"^(?:{_DATE})$"), F.when(_day(m).between(0, DAY_ROWS * DAY_COLUMNS - 1), F.lit("date")))
        .when(
            m.rlike(f"^{_NATIONAL}$"),
            F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), F.lit("national")),
        )
        .when(m.startswith("+"), F.when(F.char_length(_digits(m)).between(8, 15), F.lit("phone")))
        .when(m.rlike(f"^(?:{_LOCAL})$"), F.lit("phone"))
        .when(m.rlike(f"^{_CARD}$"), F.when(_is_card(m), F.lit("card")))
    )


def _is_card(m: Column) -> Column:
    luhn = _bind(_digits(m), lambda d: F.pmod(luhn_sum(d, F.char_length(d) % 2 == 0), F.lit(10)) == 0)
    return m.rlike(f"^{_CARD}$") & m.rlike(f"^{_ISSUER}") & luhn


def _pieces(m: Column, kind: Column) -> Column:
    """Array of kind and string that make up a match: itself, or the cards among several numbers and what is between them.

    From left to right the longest valid card is taken. Beside other numbers
    it has a usual grouping, or is all that the first 19 digits can hold.
    """
    of = "array<struct<kind:string,old:string>>"
    one = F.array(F.struct(kind.alias("kind"), m.alias("old"))).cast(of)

    def cards(tokens: Column) -> Column:
        n = F.size(tokens)
        body = lambda i, c: F.regexp_replace(F.array_join(F.slice(tokens, i + 1, c), ""), "[ -]$", "")
        full = lambda i, c: (i == 0) & ((c == n) | (F.char_length(_digits(body(i, c + 1))) > 19))
        fits = lambda i, c: _bind(body(i, c), lambda t: (t.rlike(f"^(?:{_GROUPED})$") | full(i, c)) & _is_card(t))

        def turn(acc: Column, i: Column) -> Column:
            most = F.array_max(F.filter(F.sequence(F.lit(1), F.least(n - i, F.lit(19))), lambda c: fits(i, c)))

            def taken(c: Column) -> Column:
                count = F.coalesce(c, F.lit(1))
                old, whole = body(i, count), F.array_join(F.slice(tokens, i + 1, count), "")
                gap = F.struct(F.lit(None).cast("string").alias("kind"), F.substring(whole, F.char_length(old) + 1, F.lit(1)).alias("old"))
                new = F.array(F.struct(F.when(c.isNotNull(), F.lit("card")).alias("kind"), old.alias("old")), gap)
                return F.struct((i + count).cast("int").alias("next"), F.concat(acc["out"], new).cast(of).alias("out"))

            return F.when(i < acc["next"], acc).otherwise(_bind(most, taken))

        start = F.struct(F.lit(0).alias("next"), F.array().cast(of).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, turn)["out"]

    several = kind.isNull() & m.rlike(f"^{_RUN}$") & m.rlike("[ -]")
    return F.when(several, _bind(F.regexp_extract_all(m, F.lit(r"\d+[ -]?"), F.lit(0)), cards)).otherwise(one)


def _cased(like: Column, text: Column) -> Column:
    """``text`` with capitals where ``like`` has them, so that addresses that differ in case only stay linked."""
    characters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    put = lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)
    return F.when(~like.rlike("[A-Z]"), text).otherwise(F.array_join(F.zip_with(characters(like), characters(text), put), ""))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """Pseudonym of a valid match, of the same kind."""
    tail = F.regexp_extract(m, r"[.@][A-Za-z0-9-]+\.[A-Za-z]+$", 0)  # the last two labels of a host stay
    head = _bind(tail, lambda t: F.substring(m, F.lit(1), F.char_length(m) - F.char_length(t)))
    email = F.concat(_bind(head, lambda h: _cased(h, permute_characters(F.lower(h), key, "email"))), tail)
    begin = F.regexp_extract(m, "^(?:AKIA|gh[pousr]_|sk-)", 0)
    access = _bind(begin, lambda b: F.concat(b, permute_characters(F.substring(m, F.char_length(b) + 1, F.char_length(m)), key, "access")))
    country = F.regexp_extract(m, r"^\+\d{1,3}[ .-]|^\+\d", 0)
    phone = _bind(
        F.struct(country.alias("c"), F.substring(m, F.char_length(country) + 1, F.char_length(m)).alias("n")),
        lambda s: F.concat(s["c"], _in_form(s["n"], permute_characters(_digits(s["n"]), key, "phone"))),
    )
    payload = permute_characters(F.substring(_digits(m), F.lit(1), F.char_length(_digits(m)) - 1), key, "card")
    check = lambda p: F.pmod(10 - luhn_sum(p, F.char_length(p) % 2 == 1) % 10, F.lit(10)).cast("string")
    card = _in_form(m, _bind(payload, lambda p: F.concat(p, check(p))))
    octet = lambda k: _part(m, r"\.", k)
    ip = _bind(
        permute_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, key, "ip"),
        lambda o: F.concat_ws(".", *[x.cast("string") for s in ("l", "r") for x in (F.floor(o[s] / 256), o[s] % 256)]),
    )
    day = _day(m)
    new_day = permute_pair(F.floor(day / DAY_COLUMNS), day % DAY_COLUMNS, DAY_ROWS, DAY_COLUMNS, key, "date")
    date = _bind(
        F.date_add(F.to_date(F.lit(FIRST_DAY)), _bind(new_day, lambda o: o["l"] * DAY_COLUMNS + o["r"]).cast("int")),
        lambda d: F.when(m.contains("/"), F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")),
    )
    area = _part(m, "-", 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    new_number = permute_pair(index * GROUPS + _part(m, "-", 1) - 1, _part(m, "-", 2) - 1, AREAS * GROUPS, SERIALS, key, "national")
    of_area = lambda o: F.floor(o["l"] / GROUPS)
    national = _bind(
        new_number,
        lambda o: F.concat_ws(
            "-",
            F.lpad((of_area(o) + F.when(of_area(o) >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((o["l"] % GROUPS + 1).cast("string"), 2, "0"),
            F.lpad((o["r"] + 1).cast("string"), 4, "0"),
        ),
    )
    low, high = (permute_characters(m, key, "secret", a) for a in ("0123456789abcdef", "0123456789ABCDEF"))
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", F.when(m.rlike("[a-f]"), low).otherwise(high))
        .when(kind == "access_key", access)
        .when(kind == "ip", ip)
        .when(kind == "date", date)
        .when(kind == "national", national)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by pseudonyms; ``pii_found`` (array of kind and pseudonym) is added.

    Kinds: email addresses (all but the last two labels of the host; those that
    differ in case only get pseudonyms that do), phone numbers with a country
    code (which stays) or in a national form, IPv4 addresses, calendar dates
    from 1900 to mid-2100, national identification numbers, payment card
    numbers that have an issuer's first digits and pass the Luhn check, also
    beside other numbers, hexadecimal secrets after words such as ``token =``,
    and access keys that begin with AKIA, ghp_ (or o, u, s, r) or sk-. Names
    of people, postal addresses and secrets of other forms aren't looked for,
    and four numbers up to 255 with points between them are an address even if
    a version was meant.

    Numbers that fail their validation stay. A null text stays null; rows are
    independent of each other, so repeated rows and ties need nothing, and an
    empty table gives an empty table. Columns may have any name; one called
    ``pii_found`` is replaced. Originals are in no output column. The scan
    makes no shuffle, and texts without a digit or an at sign are not searched.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(text_col)
    searched = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(FIND), F.lit(0)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), searched.alias("hits"))
    valued = F.transform(
        "hits",
        lambda m: F.transform(
            _bind(kind_of(m), lambda k: _pieces(m, k)),
            lambda p: F.struct(p["kind"].alias("kind"), p["old"].alias("old"), pseudonym(p["old"], p["kind"], key).alias("new")),
        ),
    )
    any_hit = F.size(F.coalesce("hits", F.array().cast("array<string>"))) > 0
    rows = rows.withColumn("hits", F.when(any_hit, valued))
    between = F.split("text", FIND, -1)
    after = F.concat(F.transform("hits", lambda h: F.array_join(F.transform(h, lambda p: F.coalesce(p["new"], p["old"])), "")), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, after, lambda a, b: F.concat(a, b)), "")
    found = F.transform(
        F.filter(F.flatten("hits"), lambda h: h["kind"].isNotNull()), lambda h: F.struct(h["kind"].alias("kind"), h["new"].alias("pseudonym"))
    )
    none = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    new = F.when(F.col("hits").isNotNull(), joined).otherwise(F.col("text"))
    own = [(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != "pii_found"]
    return rows.select(*own, F.coalesce(found, none).alias("pii_found"))
