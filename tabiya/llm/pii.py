"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found by their form and validated (Luhn, mod 97, calendar, octets, area codes); what passes is
permuted under a key inside its own format by a Feistel network: a card stays a card with a right check digit, a date
a date, an address an address. A permutation maps equal values to equal pseudonyms in every document and different
ones to different ones, and with the key it can be undone. Separators and the width of fields stay where they are; an
octet of an address keeps its number of digits.
Mail addresses and secrets (access keys, assigned passwords and tokens) are permuted character by character inside
their classes (digit, small, capital).

Two networks do the work. One keeps strings: each round shifts every character of one half, inside its class, by a
keyed digest of the other half. The other keeps pairs (x, y) of a x b values: each round adds a keyed digest of one to
the other, modulo its size; dates (73,049 days), addresses and social-security numbers are such pairs.

Everything is DataFrame functions on one row: no shuffle and no table that grows.

Texts of any length take work in proportion to it: no form repeats a group without bound, which the engine would do by
recursion, and a value is put back by splitting it at the characters it keeps.

What fails validation hides nothing: a text with such a match is cut where no form can match across, and each part with
such a match is searched again: at every place where a form begins every length that it allows is tried, and the first
valid one taken. Numbers grouped as cards are, and IBANs as long as their country has them, come first, and other cards
and IBANs end before one of these begins, so that a number or a capital word next to one does not become part of it;
among the others the longest. A card grouped in no known way begins where its run of digits does.

Defined results: a null text stays null with no findings; what looks like a number but fails validation is left alone;
where valid forms overlap the leftmost wins, in one place the first of KINDS; what a text had only by chance (digits
next to each other that pass as one number) may be seen differently in its pseudonyms, so undoing may leave it; a date with
slashes is read day first unless only month first is a date, so undoing one of these may swap day and month; octets with
leading zeros are no address; addresses have at most 32 labels of 63 characters (RFC 1035) and 64 characters before the
sign (RFC 5321); repeated rows give repeated rows; named columns are kept, others not read, and a kept column with the
name of a result column (`text`, `n_<kind>`) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import let, table

KEY, ROUNDS = "tabiya-example-key", 8
_NO_WORD, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
KINDS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,30}\.[A-Za-z]{2,63}",
    "access_key": _NO_WORD + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _END,
    "secret": _NO_WORD + r"(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi[_-]?[Kk]ey) ?[=:] ?[\"']?[A-Za-z0-9_-]{8,}",
    "iban": _NO_WORD + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "iso_date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])",
    "date": r"(?<![0-9./])[0-3][0-9](?:/[0-3][0-9]/|\.[01][0-9]\.)(?:19|20)[0-9]{2}(?![0-9/]|\.[0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "foreign_phone": r"(?<![0-9A-Za-z+])\+[2-9][0-9]{1,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
ANY = "|".join(f"(?:{form})" for form in KINDS.values())
#: How card numbers are grouped, the likelier first where several begin in one place.
CARDS = ("[0-9]{13,19}", *("[ -]?".join(f"[0-9]{{{n}}}" for n in sizes) for sizes in ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), (4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (6, 13))))
#: Countries by the length of their IBANs.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_form(country: str, length: int) -> str:
    groups, rest = divmod(length - 4, 4)
    return _NO_WORD + country + f"[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "") + _END


#: Forms that leave no choice of length; matches of ANY that no other of them could begin in; lengths of the other forms.
EXACT = {"iban": [_iban_form(f"(?:{names.replace(' ', '|')})", n) for n, names in IBANS.items()], "card": [f"(?<![0-9]){form}(?![0-9])" for form in CARDS]}
SURE = {"iban": EXACT["iban"], "card": EXACT["card"][:5]}
LENGTHS = {"iban": [_iban_form("[A-Z]{2}", n) for n in range(35, 11, -1)], "foreign_phone": [KINDS["foreign_phone"].replace("{2,4}(?![0-9])", f"{{{n}}}(?![0-9])") for n in (4, 3, 2)]}
#: A text without one of these has nothing to find; it is much faster to look for than ANY.
HINT = r"[0-9@]|[Pp]ass|[Ss]ecret|[Tt]oken|[Kk]ey"
#: After a character that no form contains, or a full stop and a blank, no match can go on, and none looks back at it.
CUT = r"(?<=[^A-Za-z0-9._%+@=:\"'()/ -]|\. )"
#: Days 1900-01-01 to 2099-12-31 are 17 x 4297; the area codes 1-899 without 666, and the groups, are 898 x 99.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
SSN = (898 * 99, 9999)


def _only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def _rounds(undo: bool) -> Column:
    return F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS))])


def permute_string(value: Column, key: str, tweak: Column, undo: bool = False) -> Column:
    """A string of digits and letters, permuted among the strings with the same classes in the same places."""

    def shifted(half: Column, digest: Column) -> Column:
        def one(char: Column, at: Column) -> Column:
            by = _number(F.substring(digest, (at * 2) % 128 + 1, F.lit(2)))
            turn = lambda first, n: F.char(F.lit(first) + F.pmod(F.ascii(char) - first + (-by if undo else by), F.lit(n)))
            code = F.ascii(char)
            return F.when(code.between(48, 57), turn(48, 10)).when(code.between(97, 122), turn(97, 26)).when(code.between(65, 90), turn(65, 26)).otherwise(char)

        return F.array_join(F.transform(_chars(half), one), "")

    def step(state: Column, i: Column) -> Column:
        even, other = i % 2 == 0, F.when(i % 2 == 0, state["r"]).otherwise(state["l"])
        mine = F.when(even, state["l"]).otherwise(state["r"])
        moved = let(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), other), 512), lambda digest: shifted(mine, digest))
        return let(moved, lambda new: F.struct(F.when(even, new).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise(new).alias("r")))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(_rounds(undo), start, step, lambda s: F.concat(s["l"], s["r"]))


def permute_pair(x: Column, y: Column, a: int | Column, b: int | Column, key: str, tweak: str, undo: bool = False) -> Column:
    """The pair (x, y), x < a and y < b, permuted among all such pairs, as struct<x, y>."""
    sizes = [n if isinstance(n, Column) else F.lit(n) for n in (a, b)]

    def step(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        digest = lambda other: _number(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other.cast("string")), 256), 1, 12))
        add = lambda mine, other, n: F.pmod(mine - digest(other) if undo else mine + digest(other), n.cast("long"))
        return F.struct(F.when(even, add(state["x"], state["y"], sizes[0])).otherwise(state["x"]).alias("x"), F.when(even, state["y"]).otherwise(add(state["y"], state["x"], sizes[1])).alias("y"))

    return F.aggregate(_rounds(undo), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def _refill(form: Column, new: Column, kept: str) -> Column:
    """The characters of `form` in the class replaced, in order, by those of `new`."""
    gaps = F.split(form, f"[{kept}]", -1)
    return let(_chars(new), lambda chars: F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(chars, i), F.lit("")))), ""))


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows these digits."""
    n = F.length(payload)
    twice = lambda i: F.substring(payload, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda t, i: t + (F.floor(twice(i) / 10) + twice(i) % 10).cast("int"))
    return ((10 - total % 10) % 10).cast("string")


def mod97(text: Column) -> Column:
    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97).cast("int")

    return F.aggregate(_chars(text), F.lit(0), step)


def _is_card(d: Column) -> Column:
    """Digits whose last is their check digit, and not one digit repeated."""
    n = F.length(d)
    return (luhn_digit(F.substring(d, F.lit(1), n - 1)) == F.substring(d, n, F.lit(1))) & ~d.rlike(r"^(.)\1*$")


def _is_iban(t: Column) -> Column:
    return mod97(F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))) == 1


def _is_ssn(v: Column) -> Column:
    return (v[0] > 0) & (v[0] != 666) & (v[0] < 900) & (v[1] > 0) & (v[2] > 0)


def _is_ip(octets: Column) -> Column:
    return F.forall(octets, lambda v: v.rlike("^(?:0|[1-9][0-9]*)$") & (v.cast("int") < 256))


def _day(m: Column, form: str) -> Column:
    """Days since FIRST_DAY; null if it isn't a date of that form in the permuted days."""
    day = F.date_diff(F.to_date(F.try_to_timestamp(m, F.lit(form))), F.lit(FIRST_DAY).cast("date"))
    return let(day, lambda d: F.when(d.between(0, DAYS[0] * DAYS[1] - 1), d))


def _card(m: Column, key: str, undo: bool) -> Column:
    def new(d: Column) -> Column:
        n, first = F.length(d), F.substring(d, 1, 1)
        body = permute_string(F.substring(d, F.lit(2), n - 2), key, F.concat(F.lit("card"), first), undo)
        return F.when(_is_card(d), let(F.concat(first, body), lambda p: F.concat(p, luhn_digit(p))))

    return let(let(_only(m, "0-9"), new), lambda digits: F.when(digits.isNotNull(), _refill(m, digits, "0-9")))


def _phone(m: Column, key: str, undo: bool) -> Column:
    def new(d: Column) -> Column:
        n = F.right(d, F.lit(10))
        free = F.concat(F.substring(n, 2, 2), F.substring(n, 5, 6))
        put = let(permute_string(free, key, F.lit("phone"), undo), lambda p: F.concat(F.substring(n, 1, 1), F.substring(p, 1, 2), F.substring(n, 4, 1), F.substring(p, 3, 6)))
        return F.concat(F.substring(d, F.lit(1), F.length(d) - 10), put)

    return let(let(_only(m, "0-9"), new), lambda digits: _refill(m, digits, "0-9"))


def _foreign(m: Column, key: str, undo: bool) -> Column:
    def new(d: Column) -> Column:
        return F.concat(F.substring(d, 1, 2), permute_string(F.substring(d, F.lit(3), F.length(d)), key, F.concat(F.lit("phone"), F.substring(d, 1, 2)), undo))

    return F.when(F.length(_only(m, "0-9")).between(8, 15), let(let(_only(m, "0-9"), new), lambda digits: _refill(m, digits, "0-9")))


def _iban(m: Column, key: str, undo: bool) -> Column:
    def new(t: Column) -> Column:
        country, bban = F.substring(t, 1, 2), F.substring(t, F.lit(5), F.length(t))
        put = let(permute_string(bban, key, F.concat(F.lit("iban"), country), undo), lambda p: F.concat(country, F.lpad((98 - mod97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0"), p))
        return F.when(_is_iban(t), put)

    return let(let(F.replace(m, F.lit(" "), F.lit("")), new), lambda t: F.when(t.isNotNull(), _refill(m, t, "A-Z0-9")))


def _ip(m: Column, key: str, undo: bool) -> Column:
    """Octets of one, two and three digits are 10, 90 and 156 values; a pair is of two octets' values."""

    def new(o: Column) -> Column:
        wide = lambda i, *by: F.element_at(F.array(*map(F.lit, by)), F.length(o[i]))
        low, many = (lambda i: wide(i, 0, 10, 100)), (lambda i: wide(i, 10, 90, 156))
        half = lambda i: (o[i].cast("int") - low(i)) * many(i + 1) + o[i + 1].cast("int") - low(i + 1)
        octets = lambda v, i: [(F.floor(v / many(i + 1)) + low(i)).cast("string"), (v % many(i + 1) + low(i + 1)).cast("string")]
        pair = permute_pair(half(0), half(2), many(0) * many(1), many(2) * many(3), key, "ip", undo)
        return F.when(_is_ip(o), let(pair, lambda p: F.concat_ws(".", *octets(p["x"], 0), *octets(p["y"], 2))))

    return let(F.split(m, r"\."), new)


def _ssn(m: Column, key: str, undo: bool) -> Column:
    def new(v: Column) -> Column:
        area, group, serial = v[0], v[1], v[2]
        place = area - F.when(area > 666, 2).otherwise(1)

        def put(p: Column) -> Column:
            at = F.floor(p["x"] / 99).cast("long")
            return F.concat_ws("-", F.lpad((at + F.when(at >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((p["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["y"] + 1).cast("string"), 4, "0"))

        return F.when(_is_ssn(v), let(permute_pair(place * 99 + group - 1, serial - 1, *SSN, key, "ssn", undo), put))

    return let(F.transform(F.split(m, "-"), lambda v: v.cast("int")), new)


def _date(m: Column, form: str, key: str, undo: bool) -> Column:
    def new(day: Column) -> Column:
        pair = permute_pair(F.floor(day / DAYS[1]), day % DAYS[1], *DAYS, key, "date", undo)
        return F.when(day.isNotNull(), let(pair, lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * DAYS[1] + p["y"]).cast("int")), form)))

    return let(_day(m, form), new)


def _day_date(m: Column, key: str, undo: bool) -> Column:
    dotted, day_first, month_first = (_date(m, form, key, undo) for form in ("dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy"))
    return F.when(m.contains("."), dotted).otherwise(F.coalesce(day_first, month_first))


def _email(m: Column, key: str, undo: bool) -> Column:
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    end = F.substring_index(host, ".", -1)
    labels = F.substring(host, F.lit(1), F.length(host) - F.length(end))
    part = lambda text, tweak: F.when(_only(text, "A-Za-z0-9") != "", let(permute_string(_only(text, "A-Za-z0-9"), key, F.lit(tweak), undo), lambda p: _refill(text, p, "A-Za-z0-9"))).otherwise(text)
    return F.concat(part(name, "name"), F.lit("@"), part(labels, "host"), end)


def _value(m: Column, before: str, key: str, undo: bool) -> Column:
    """A secret after its marker."""
    kept = F.regexp_extract(m, before, 0)
    value = F.substring(m, F.length(kept) + 1, F.length(m))
    return F.concat(kept, let(permute_string(_only(value, "A-Za-z0-9"), key, F.lit("secret"), undo), lambda p: _refill(value, p, "A-Za-z0-9")))


def pseudonym(m: Column, key: str = KEY, undo: bool = False) -> Column:
    """struct<kind, text> for a match of ANY; kind and text are null if it isn't valid."""
    made = {
        "email": _email(m, key, undo), "access_key": _value(m, "^.{4}", key, undo), "secret": _value(m, r"^[A-Za-z_-]+ ?[=:] ?[\"']?", key, undo), "iban": _iban(m, key, undo),
        "iso_date": _date(m, "yyyy-MM-dd", key, undo), "date": _day_date(m, key, undo), "ip": _ip(m, key, undo), "ssn": _ssn(m, key, undo),
        "card": _card(m, key, undo), "phone": _phone(m, key, undo), "foreign_phone": _foreign(m, key, undo),
    }
    text = kind = None
    for name, form in KINDS.items():
        is_it = m.rlike(f"^(?:{form})$")
        text = F.when(is_it, made[name]) if text is None else text.when(is_it, made[name])
        kind = F.when(is_it, F.lit(name)) if kind is None else kind.when(is_it, F.lit(name))
    return let(text, lambda t: F.struct(F.when(t.isNotNull(), kind).alias("kind"), t.alias("text")))


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the form is a value of the kind; true for kinds that the form alone decides."""
    if kind == "date":
        return F.when(m.contains("."), _day(m, "dd.MM.yyyy")).otherwise(F.coalesce(_day(m, "dd/MM/yyyy"), _day(m, "MM/dd/yyyy"))).isNotNull()
    checks = {
        "iban": lambda: let(F.replace(m, F.lit(" "), F.lit("")), _is_iban), "iso_date": lambda: _day(m, "yyyy-MM-dd").isNotNull(), "ip": lambda: let(F.split(m, r"\."), _is_ip),
        "ssn": lambda: let(F.transform(F.split(m, "-"), lambda v: v.cast("int")), _is_ssn), "card": lambda: let(_only(m, "0-9"), _is_card), "foreign_phone": lambda: F.length(_only(m, "0-9")).between(8, 15),
    }
    return checks.get(kind, lambda: F.lit(True))()


CHECKED = ("iban", "iso_date", "date", "ip", "ssn", "card", "foreign_phone")


def _settled(m: Column) -> Column:
    """Whether a match of ANY is what a search of every place would find there."""
    out = None
    for name, form in KINDS.items():
        sure = valid(name, m) & m.rlike("|".join(f"^(?:{f})$" for f in SURE[name])) if name in SURE else valid(name, m)
        is_it = m.rlike(f"^(?:{form})$")
        out = F.when(is_it, sure) if out is None else out.when(is_it, sure)
    return F.coalesce(out, F.lit(False))


TOKEN = "struct<text:string,hit:boolean>"


def _tokens(text: Column, hits: Column) -> Column:
    """A text as its matches of ANY and what lies between them, in order."""
    between = F.split(text, ANY, -1)
    pair = lambda piece, i: F.array(F.struct(piece.alias("text"), F.lit(False).alias("hit")), F.struct(F.get(hits, i).alias("text"), F.lit(True).alias("hit")))
    return F.filter(F.flatten(F.transform(between, pair)), lambda t: t["text"].isNotNull())


def _best(seen: Column, room: Column) -> Column:
    """The match at a place: `seen` is the text from two characters before it on, `room` as much of it as lies before
    the next number of an EXACT form. Null if there is none."""
    at = lambda within, form: F.regexp_extract(within, f"(?s)^..({form})", 1)

    def first(kind: str, within: Column, forms: list[str]) -> Column:
        return F.get(F.filter(F.array(*[at(within, form) for form in forms]), lambda m: (m != "") & valid(kind, m)), F.lit(0))

    def one(kind: str) -> Column:
        if kind in EXACT:
            other = LENGTHS.get(kind, [r"(?<![0-9][ -])" + KINDS[kind]])
            found = F.coalesce(first(kind, seen, EXACT[kind]), first(kind, room, other))
        elif kind in CHECKED:
            found = first(kind, seen, LENGTHS.get(kind, [KINDS[kind]]))
        else:
            found = F.nullif(at(seen, KINDS[kind]), F.lit(""))
        return F.when(at(seen, KINDS[kind]) != "", found)

    return F.coalesce(*map(one, KINDS))


def _closely(text: Column) -> Column:
    """The tokens of a text in which matches of ANY fail validation. The text is split at every place where a form
    begins; the best valid match of each place is found in what follows it, and from left to right each is taken that
    the last one taken has not reached. Work is in proportion to the text: what is looked at of a place is bounded, and
    tokens are gathered in blocks, as an array that grows is copied."""
    far = 80  # pieces; each has a character at least, and no form but secrets and long mail addresses is longer
    pieces = F.split(text, f"(?={ANY})", -1)

    def candidates(p: Column) -> Column:
        before = lambda i: F.right(F.concat(F.lit("\n\n"), F.coalesce(F.get(p, i - 2), F.lit("")), F.coalesce(F.get(p, i - 1), F.lit(""))), F.lit(2))
        seen = lambda i, n: F.concat(before(i), F.array_join(F.slice(p, i + 1, n), ""))
        exact = lambda s: F.exists(F.array(*[F.struct(F.lit(kind).alias("k"), F.regexp_extract(s, f"(?s)^..({form})", 1).alias("m")) for kind in EXACT for form in EXACT[kind]]), lambda e: (e["m"] != "") & F.when(e["k"] == "iban", valid("iban", e["m"])).otherwise(valid("card", e["m"])))
        grouped = lambda s: s.rlike("(?s)^..(?:" + KINDS["iban"] + "|" + KINDS["card"] + ")")
        sure = F.transform(p, lambda _, i: let(seen(i, F.lit(far)), lambda s: F.when(grouped(s), exact(s)).otherwise(F.lit(False))))

        def with_sure(taken: Column) -> Column:
            def match(i: Column) -> Column:
                # how many characters lie before the next place of an EXACT form
                free = F.array_position(F.slice(taken, i + 2, far), True)
                ahead = F.when(free > 0, F.array_join(F.slice(p, i + 1, free.cast("int")), ""))
                found = lambda s: let(F.coalesce(F.concat(before(i), ahead), s), lambda room: _best(s, room))
                whole = F.size(p) - i
                near = let(seen(i, F.lit(far)), lambda s: let(found(s), lambda m: F.struct(m.alias("m"), (F.length(s) - F.length(m) < 66).alias("cut"))))
                return let(near, lambda n: F.when(n["cut"] & (whole > far), found(seen(i, whole))).otherwise(n["m"]))

            return F.transform(p, lambda piece, i: F.struct(piece.alias("text"), match(i).alias("m")))

        return let(sure, with_sure)

    def step(state: Column, e: Column) -> Column:
        piece, m, skip = e["text"], e["m"], state["skip"]
        token = lambda t, hit: F.struct(t.alias("text"), F.lit(hit).alias("hit"))
        n, size = F.length(piece), F.length(m)
        rest = lambda taken: F.when(taken < n, F.array(token(F.substring(piece, taken + 1, n), False))).otherwise(F.array().cast(f"array<{TOKEN}>"))
        after = lambda taken, made: F.struct(F.greatest(taken - n, F.lit(0)).alias("skip"), F.concat(state["out"], made).alias("out"))
        return F.when((skip == 0) & m.isNotNull(), after(size, F.concat(F.array(token(m, True)), rest(size)))).otherwise(after(skip, rest(skip)))

    none = F.array().cast(f"array<{TOKEN}>")
    start = lambda skip: F.struct(skip.cast("int").alias("skip"), none.alias("out"))

    def gathered(found: Column) -> Column:
        size = 256
        blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int"))

        def block(state: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(found, b * size + 1, F.lit(size)), start(state["skip"]), step)
            return let(inner, lambda s: F.struct(s["skip"].alias("skip"), F.concat(state["out"], F.array(s["out"])).alias("out")))

        nested = F.array().cast(f"array<array<{TOKEN}>>")
        return F.aggregate(blocks, F.struct(F.lit(0).alias("skip"), nested.alias("out")), block, lambda s: F.flatten(s["out"]))

    return let(let(pieces, candidates), gathered)


def _all_tokens(text: Column) -> Column:
    """The text as tokens: its matches of ANY if all are valid, else cut at CUT, with the parts that have an invalid
    match looked at closely."""
    hits = lambda t: F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    settled = lambda found: F.forall(found, _settled)

    def either(t: Column, otherwise) -> Column:
        return let(hits(t), lambda found: F.when(settled(found), _tokens(t, found)).otherwise(otherwise(t)))

    return either(text, lambda t: F.flatten(F.transform(F.split(t, CUT, -1), lambda part: either(part, _closely))))


def pseudonymised(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), key: str = KEY, undo: bool = False) -> DataFrame:
    """The kept columns, the text with pseudonyms, and how many findings of each kind it had."""
    own = [c for c in keep if c not in ("text", *(f"n_{kind}" for kind in KINDS))]

    def put(token: Column) -> Column:
        """struct<text, kind> of a token."""
        plain = F.struct(F.lit(None).cast("string").alias("kind"), token["text"].alias("text"))
        return F.when(token["hit"], let(pseudonym(token["text"], key, undo), lambda new: F.struct(new["kind"].alias("kind"), F.coalesce(new["text"], token["text"]).alias("text")))).otherwise(plain)

    tokens = F.when(F.col("text").rlike(HINT), F.transform(let(F.col("text"), _all_tokens), put))
    found = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in own], F.col("text").alias("_text"), tokens.alias("_tokens"))
    found = found.select("*", F.coalesce(F.filter(F.transform("_tokens", lambda token: token["kind"]), lambda kind: kind.isNotNull()), F.array().cast("array<string>")).alias("_kinds"))
    text = F.when(F.size("_kinds") > 0, F.array_join(F.transform("_tokens", lambda token: token["text"]), "")).otherwise(F.col("_text"))
    count = lambda kind: F.size(F.filter("_kinds", lambda k: k == kind)).alias(f"n_{kind}")
    return found.select(*[F.col(f"_keep_{c}").alias(c) for c in own], text.alias("text"), *map(count, KINDS))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
