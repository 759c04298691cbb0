"""Format-preserving pseudonyms for personal data, with built-in SQL functions only.

One pattern finds addresses and runs of numbers; within a run, every reading that starts and ends at a group
is checked (Luhn, mod 97, ranges, calendar), so a number is found whatever digits or capitals stand before
and after it. What passes is replaced by its image under a keyed Feistel network over the set of values of the same
format, so the image is again a valid value of that format, and equal values get equal images in every
document. What no reading of passes stays as it is.

Readings are tried from left to right; of those with the same start the first that passes counts: an account
number of its country's length, then the longest; dates, addresses and telephone numbers; a card of the usual
groups, then the longest.

| kind | check | set that is permuted |
|---|---|---|
| email | shape | letters and digits of the local part, class by class; domain and capitals stay |
| ip | four octets of at most 255 | all 2^32 addresses |
| iban | mod 97 | letters and digits after the check digits, which are worked out anew |
| card | Luhn, 13 to 19 digits | digits between the first and the check digit, which is worked out anew |
| ssn | issued ranges | 898 areas x 99 groups x 9,999 serials |
| nanp | area and exchange from 200 | 800 areas x 800 exchanges x 10,000 lines |
| phone | ``+`` and 7 to 15 digits | all digits behind the country code |
| ymd, dmy, mdy | a day of 1800 to 2199 | those of the 146,097 days of these 400 years up to, or after, the 12th |

A value has one image however it is written: telephone numbers with any separators, with and without a country
code (``+1``), days in all three orders, addresses in capitals or not. A date such as 03/04/2020 counts as day first;
only where that is no date and month first is one is it month first. So that its image too can only be read
month first, days after the 12th of a month have images after the 12th, and others others.

The work is linear in the text: a run of numbers is walked piece by piece, each looking at what follows it.

Edge cases: a null text stays null, a text without a find is returned unchanged, ``n_chars`` (if there)
follows the new text, other columns are kept, repeated rows are treated alike.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import tables

ROUNDS = 8
#: The key of the registered query over test tables; choose your own for anything else.
TEST_KEY = "basketry test tables"
_STEPS = 64  # an image is of the other part of the month with odds under 0.62 each time

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_YMD = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_DMY = r"[0-9]{1,2}([/.-])[0-9]{1,2}\1[0-9]{4}"
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_NANP = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
_PHONE = r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]){5,12}"
_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
_BEHIND, _AHEAD = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: Where a number or an account number may begin: four digits at least, whatever divides them.
_HEAD = r"(?:[+(]?[0-9](?:[ ()./+-]*+[0-9]){3})"
_IBAN_HEAD = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}[ A-Z0-9])"
#: A run of numbers: all that any number could take in, but no beginning of an address.
_RUN = (
    rf"(?:{_BEHIND}(?<![0-9][.-])(?={_HEAD})|{_IBAN_HEAD})"
    rf"[A-Z0-9 ()./+_-]*(?:_[0-9A-Za-z_]*+|[A-Z0-9](?![0-9A-Za-z_]))(?![.-][0-9])(?![A-Za-z0-9._%+-]*+@)"
)
PATTERN = rf"{_EMAIL}|{_RUN}"
_STARTS = rf"{_BEHIND}(?={_HEAD})|{_IBAN_HEAD}"
_OTHERS = [rf"^(?:{p}){_AHEAD}(?![.-][0-9])" for p in (_YMD, _DMY, _IP, _SSN, _NANP, _PHONE)]
_CARDS = [
    rf"^(?:{p}){_AHEAD}(?!\.[0-9])"
    for p in (
        r"[2-5][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}",
        r"3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}",
        *[rf"[0-9](?:[ -]?[0-9]){{{n}}}" for n in range(18, 11, -1)],
    )
]
_IBANS = [
    rf"^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n}}}{tail}(?![A-Za-z0-9])"
    for n in range(7, 1, -1)
    for tail in ("(?: ?[A-Z0-9]{1,3})", "")
]
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 "
    "FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
    "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 "
    "SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()
_LONGEST = 64  # characters that any reading and what follows it take
#: Two possible beginnings are two characters apart at least; tokens of a run taken together.
_TOKENS_AHEAD, _BLOCK = _LONGEST // 2 + 1, 128
#: Telephone country codes of one and two digits; all others have three.
_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 "
    "84 86 90 91 92 93 94 95 98"
).split()


def _let(value, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _draw(key: str, label, round_, other) -> Column:
    """60 pseudo-random bits that depend on the key, the format, the round and the other half."""
    seed = F.concat_ws("|", F.lit(key), F.lit(label), round_.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("bigint")


def permute_pair(key: str, label: str, left, right, left_size: int, right_size: int) -> Column:
    """Feistel network over pairs below (left_size, right_size); a struct of left and right."""
    start = F.struct(left.cast("bigint").alias("left"), right.cast("bigint").alias("right"))

    def step(state, round_):
        left, right = state["left"], state["right"]
        even = round_ % 2 == 0
        return F.struct(
            F.when(even, (left + _draw(key, label, round_, right)) % left_size)
            .otherwise(left)
            .alias("left"),
            F.when(even, right)
            .otherwise((right + _draw(key, label, round_, left)) % right_size)
            .alias("right"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_text(key: str, label: str, text) -> Column:
    """Feistel network over strings of the same length and the same character class at each place.

    A round shifts each letter or digit of one half by an amount drawn from the other half.
    """
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def shifted(half, other, round_):
        seed = F.concat_ws("|", F.lit(key), F.lit(label), round_.cast("string"), other)

        def one(stream, place):
            letter = F.substring(half, place, F.lit(1))
            amount = F.conv(F.substring(stream, ((place - 1) % 32) * 2 + 1, F.lit(2)), 16, 10)
            out = letter
            for alphabet in (digits, lower, upper):
                at = F.instr(F.lit(alphabet), letter)
                moved = F.substring(
                    F.lit(alphabet), (at - 1 + amount.cast("int")) % len(alphabet) + 1, F.lit(1)
                )
                out = F.when(at > 0, moved).otherwise(out)
            return out

        places = F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1)))
        return _let(
            F.sha2(seed, 256),
            lambda stream: F.array_join(F.transform(places, lambda p: one(stream, p)), ""),
        )

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substring(text, F.lit(1), cut).alias("left"),
        F.substring(text, cut + 1, F.length(text)).alias("right"),
    )

    def step(state, round_):
        left, right = state["left"], state["right"]
        even = round_ % 2 == 0
        return F.struct(
            F.when(even, shifted(left, right, round_)).otherwise(left).alias("left"),
            F.when(even, right).otherwise(shifted(right, left, round_)).alias("right"),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return _let(done, lambda x: F.concat(x["left"], x["right"]))


def _only(chars: str, text) -> Column:
    return F.regexp_replace(text, f"[^{chars}]", "")


def _number(text, start: int, length: int) -> Column:
    return F.substring(text, start, length).cast("bigint")


def _padded(value, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _into_shape(shape, letters, chars: str) -> Column:
    """Put new letters, one by one, where the shape has a character of this kind."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def step(letters, state, place):
        letter = F.substring(shape, place, F.lit(1))
        taken = letter.rlike(f"[{chars}]")
        new = F.substring(letters, state["used"] + 1, F.lit(1))
        return F.struct(
            F.concat(state["text"], F.when(taken, new).otherwise(letter)).alias("text"),
            (state["used"] + F.when(taken, 1).otherwise(0)).alias("used"),
        )

    places = F.sequence(F.lit(1), F.length(shape))
    return _let(
        letters, lambda x: F.aggregate(places, start, lambda s, p: step(x, s, p))["text"]
    )


def luhn_sum(digits) -> Column:
    """Sum of the digits, every second from the right doubled (a sum above 9 less 9)."""

    def step(digits, total, place):
        digit = F.substring(digits, place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((F.length(digits) - place) % 2 == 1, twice).otherwise(digit)

    def whole(digits):
        places = F.sequence(F.lit(1), F.length(digits))
        return F.aggregate(places, F.lit(0), lambda t, p: step(digits, t, p))

    return _let(digits, whole)


def mod97(letters) -> Column:
    """Remainder by 97 of an account number, letters counting as 10 to 35."""

    def step(letters, total, place):
        code = F.ascii(F.substring(letters, place, F.lit(1)))
        digit = F.when(code >= 65, code - 55).otherwise(code - 48)
        return F.when(code >= 65, (total * 100 + digit) % 97).otherwise((total * 10 + digit) % 97)

    def whole(letters):
        places = F.sequence(F.lit(1), F.length(letters))
        return F.aggregate(places, F.lit(0), lambda t, p: step(letters, t, p))

    return _let(letters, whole)


def _email(key, found):
    at = F.instr(found, "@")
    local = F.substring(found, F.lit(1), at - 1)

    def capitals(new):
        places = F.sequence(F.lit(1), F.greatest(F.length(local), F.lit(1)))

        def one(place):
            letter = F.substring(new, place, F.lit(1))
            return F.when(F.substring(local, place, F.lit(1)).rlike("[A-Z]"), F.upper(letter)).otherwise(letter)

        return F.array_join(F.transform(places, one), "")

    image = _let(permute_text(key, "email", F.lower(local)), capitals)
    return F.concat(image, F.substring(found, at, F.length(found)))


def _ip(key, found):
    octets = F.split(found, r"\.")
    part = [octets[i].cast("bigint") for i in range(4)]
    new = permute_pair(key, "ip", part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536)

    def written(new):
        halves = [F.shiftright(new["left"], 8), new["left"] % 256]
        halves += [F.shiftright(new["right"], 8), new["right"] % 256]
        return F.concat_ws(".", *[h.cast("string") for h in halves])

    return _let(new, written)


def _iban(key, found):
    plain = _only("A-Z0-9", found)
    country, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

    def whole(new):
        check = 98 - mod97(F.concat(new, country, F.lit("00")))
        return F.concat(country, _padded(check, 2), new)

    return _into_shape(found, _let(permute_text(key, "iban", rest), whole), "A-Z0-9")


def _card(key, found):
    digits = _only("0-9", found)
    middle = F.substring(digits, F.lit(2), F.length(digits) - 2)
    body = F.concat(F.substring(digits, 1, 1), permute_text(key, "card", middle))

    def whole(body):
        check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
        return F.concat(body, check.cast("string"))

    return _into_shape(found, _let(body, whole), "0-9")


def _ssn(key, found):
    area = _number(found, 1, 3)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    new = permute_pair(
        key, "ssn", place * 99 + _number(found, 5, 2) - 1, _number(found, 8, 4) - 1, 898 * 99, 9999
    )

    def written(new):
        place = F.floor(new["left"] / 99)
        area = F.when(place >= 665, place + 2).otherwise(place + 1)
        return F.concat_ws(
            "-", _padded(area, 3), _padded(new["left"] % 99 + 1, 2), _padded(new["right"] + 1, 4)
        )

    return _let(new, written)


def _ten(found) -> Column:
    """The ten digits of a North American number, without the country code."""
    return F.right(_only("0-9", found), F.lit(10))


def _nanp(key, found):
    ten = _ten(found)
    area, exchange, line = (_number(ten, *x) for x in ((1, 3), (4, 3), (7, 4)))
    value = ((area - 200) * 800 + exchange - 200) * 10000 + line
    new = permute_pair(key, "nanp", F.floor(value / 80000), value % 80000, 80000, 80000)
    head = F.when(F.length(_only("0-9", found)) == 11, "1").otherwise("")

    def digits(new):
        value = new["left"] * 80000 + new["right"]
        place = F.floor(value / 10000)
        return F.concat(
            head,
            (F.floor(place / 800) + 200).cast("string"),
            (place % 800 + 200).cast("string"),
            _padded(value % 10000, 4),
        )

    return _into_shape(found, _let(new, digits), "0-9")


def _phone(key, found):
    def whole(digits):
        code = F.when(F.substring(digits, 1, 1).isin(*[c for c in _CODES if len(c) == 1]), 1)
        code = code.when(F.substring(digits, 1, 2).isin(*_CODES), 2).otherwise(3)
        rest = permute_text(key, "phone", F.substring(digits, code + 1, F.length(digits)))
        return F.concat(F.substring(digits, F.lit(1), code), rest)

    return _into_shape(found, _let(_only("0-9", found), whole), "0-9")


_FIRST_DAY, _DAYS = "1800-01-01", (189, 773)  # 189 x 773 = 146,097 days in 400 years


def _new_day(key, day):
    """The image of a day, on the same side of the 12th of a month: the first on the way that is."""
    first = F.lit(_FIRST_DAY).cast("date")

    def permuted(day):
        place = F.date_diff(day, first).cast("bigint")
        new = permute_pair(key, "day", F.floor(place / _DAYS[1]), place % _DAYS[1], *_DAYS)
        return _let(new, lambda x: F.date_add(first, (x["left"] * _DAYS[1] + x["right"]).cast("int")))

    def walk(start):
        def step(day, turn):
            done = (turn > 0) & ((F.dayofmonth(day) > 12) == (F.dayofmonth(start) > 12))
            return F.when(done, day).otherwise(permuted(day))

        return F.aggregate(F.sequence(F.lit(0), F.lit(_STEPS)), start, step)

    return _let(day, walk)


def _day(year, month, day) -> Column:
    """The date, or null where it is none or outside 1800 to 2199."""
    text = F.concat_ws("-", _padded(year, 4), _padded(month, 2), _padded(day, 2))
    date = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.year(date).between(1800, 2199), date)


def _iso_day(found):
    parts = F.split(found, "-")
    return _day(parts[0], parts[1], parts[2])


def _slash_days(found):
    parts = F.split(found, "[/.-]")
    return _day(parts[2], parts[1], parts[0]), _day(parts[2], parts[0], parts[1])


def _written(found, first, second, year):
    """Two numbers and a year, with the separator and the padding that the find has."""
    mark = F.regexp_extract(found, "([/.-])", 1)
    parts = F.split(found, "[/.-]")
    narrow = (F.length(parts[0]) == 1) | (F.length(parts[1]) == 1)
    shown = [F.when(narrow, x.cast("string")).otherwise(_padded(x, 2)) for x in (first, second)]
    return F.concat(shown[0], mark, shown[1], mark, _padded(year, 4))


def _dmy(key, found):
    new = _new_day(key, _slash_days(found)[0])
    return _let(new, lambda x: _written(found, F.dayofmonth(x), F.month(x), F.year(x)))


def _mdy(key, found):
    new = _new_day(key, _slash_days(found)[1])
    return _let(new, lambda x: _written(found, F.month(x), F.dayofmonth(x), F.year(x)))


def kind(found) -> Column:
    """What a find is, or null where it fails its check."""

    def whole(pattern):
        return found.rlike(f"^(?:{pattern})$")

    octets = F.split(found, r"\.")
    plain = _only("A-Z0-9", found)
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    digits = _only("0-9", found)
    day_first, month_first = _slash_days(found)
    is_ip = F.greatest(*[octets[i].cast("int") for i in range(4)]) <= 255
    is_ssn = (
        (_number(found, 1, 3) > 0)
        & (_number(found, 1, 3) < 900)
        & (_number(found, 1, 3) != 666)
        & (_number(found, 5, 2) > 0)
        & (_number(found, 8, 4) > 0)
    )
    ten = _ten(found)
    is_nanp = (_number(ten, 1, 1) > 1) & (_number(ten, 4, 1) > 1)
    return (
        F.when(F.instr(found, "@") > 0, F.when(found.rlike(r"\.[A-Za-z]{2,}$"), "email"))
        .when(whole(_IBAN), F.when(mod97(turned) == 1, "iban"))
        .when(whole(_YMD), F.when(_iso_day(found).isNotNull(), "ymd"))
        .when(
            whole(_DMY),
            F.when(day_first.isNotNull(), "dmy").when(month_first.isNotNull(), "mdy"),
        )
        .when(whole(_IP), F.when(is_ip, "ip"))
        .when(whole(_SSN), F.when(is_ssn, "ssn"))
        .when(whole(_NANP) & is_nanp, "nanp")
        # The same number without separators.
        .when(whole(_PHONE) & digits.rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$"), "nanp")
        .when(whole(_PHONE), F.when(F.length(digits).between(7, 15), "phone"))
        .when(whole(_CARD), F.when(luhn_sum(digits) % 10 == 0, "card"))
    )


def _readings(rest, before) -> Column:
    """All readings that ``rest`` begins with, the likeliest first; ``before``: the two characters before it."""

    def of_rest(rest):
        def taken(patterns):
            return F.array(*[F.regexp_extract(rest, p, 0) for p in patterns])

        lengths = F.create_map(*[F.lit(x) for c in _IBAN_LENGTHS for x in (c[:2], int(c[2:]))])
        own = F.try_element_at(lengths, F.substring(rest, 1, 2))
        ibans = F.when(
            rest.rlike("^[A-Z]"),
            _let(
                taken(_IBANS),
                lambda x: F.concat(F.filter(x, lambda c: F.length(_only("A-Z0-9", c)) == own), x),
            ),
        ).otherwise(F.array().cast("array<string>"))
        # After a digit and a point nothing begins, after a digit and a hyphen the groups of a card do.
        others = F.when(before.rlike("^[0-9][.-]$"), F.array().cast("array<string>")).otherwise(
            taken(_OTHERS)
        )
        cards = F.when(
            before.rlike(r"^[0-9]\.$") | ~rest.rlike("^[0-9]"), F.array().cast("array<string>")
        ).otherwise(taken(_CARDS))
        return F.filter(F.concat(ibans, others, cards), lambda c: c != "")

    return _let(rest, of_rest)


_PIECES = "array<struct<found:string,kind:string>>"


def pieces(found) -> Column:
    """A find cut into readings that pass their checks, with their kind, and what stands between (null kind)."""

    nothing = F.array().cast(_PIECES)

    def piece(text, what):
        return F.array(F.struct(text.alias("found"), what.cast("string").alias("kind")))

    def in_run(tokens):
        """Tokens begin where a reading may; they are walked in blocks, so that only short lists grow."""

        def joined(start, count):
            return F.array_join(F.slice(tokens, start, F.lit(count)), "")

        def first_good(at):
            rest = F.substring(joined(at, _TOKENS_AHEAD), 1, _LONGEST)
            before = F.when(at > 1, F.right(joined(F.greatest(at - 2, F.lit(1)), 2), F.lit(2))).otherwise("")
            before = F.when(at == 2, F.right(joined(F.lit(1), 1), F.lit(2))).otherwise(before)
            tried = F.transform(
                _readings(rest, before), lambda c: F.struct(c.alias("found"), kind(c).alias("kind"))
            )
            return F.get(F.filter(tried, lambda c: c["kind"].isNotNull()), F.lit(0))

        def step(state, at):
            token = F.get(tokens, at - 1)

            def go_on(good):
                hit = good.isNotNull()
                taken = F.when(hit, F.length(good["found"])).otherwise(state["skip"])
                gap = F.substring(token, taken + 1, F.length(token))
                new = F.concat(
                    F.when(hit, piece(good["found"], good["kind"])).otherwise(nothing),
                    F.when(gap != "", piece(gap, F.lit(None))).otherwise(nothing),
                )
                return F.struct(
                    F.concat(state["out"], new).alias("out"),
                    F.greatest(taken - F.length(token), F.lit(0)).alias("skip"),
                )

            # What begins within the last reading is none.
            return _let(F.when(state["skip"] == 0, first_good(at)), go_on)

        def block(state, number):
            places = F.sequence(
                number * _BLOCK + 1, F.least((number + 1) * _BLOCK, F.size(tokens))
            )
            start = F.struct(nothing.alias("out"), state["skip"].alias("skip"))
            return _let(
                F.aggregate(places, start, step),
                lambda x: F.struct(F.concat(state["out"], x["out"]).alias("out"), x["skip"].alias("skip")),
            )

        start = F.struct(nothing.alias("out"), F.lit(0).alias("skip"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / _BLOCK).cast("int"))
        return F.aggregate(blocks, start, block)["out"]

    whole = F.array(F.struct(found.alias("found"), kind(found).alias("kind"))).cast(_PIECES)
    return F.when(F.instr(found, "@") > 0, whole).otherwise(
        _let(F.split(found, _STARTS, -1), in_run)
    )


def pseudonym(key: str, found, what=None) -> Column:
    """The image of one value of the kind ``what`` (worked out if not given); the value itself where that is null."""
    what = kind(found) if what is None else what
    images = {
        "email": _email(key, found),
        "iban": _iban(key, found),
        "ymd": F.date_format(_new_day(key, _iso_day(found)), "yyyy-MM-dd"),
        "dmy": _dmy(key, found),
        "mdy": _mdy(key, found),
        "ip": _ip(key, found),
        "ssn": _ssn(key, found),
        "nanp": _nanp(key, found),
        "phone": _phone(key, found),
        "card": _card(key, found),
    }
    tagged = F.array(F.struct(found.alias("found"), what.alias("kind")))

    def image(cell):
        out = cell["found"]
        for name, new in images.items():
            out = F.when(cell["kind"] == name, new).otherwise(out)
        return out

    return F.transform(tagged, image)[0]


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same rows with personal data in ``text`` replaced; ``n_chars`` follows where it is there.

    ``findings`` has the finds themselves.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    between = F.split(F.col(text), PATTERN, -1)

    def image(x):
        new = F.transform(pieces(x), lambda p: pseudonym(key, p["found"], p["kind"]))
        return F.array_join(new, "")

    images = F.concat(F.transform("__llm_found", image), F.array(F.lit("")))
    joined = F.array_join(F.zip_with("__llm_between", images, lambda a, b: F.concat(a, b)), "")
    new = F.when(F.size("__llm_found") > 0, joined).otherwise(F.col(text))
    # A find has a digit or an at sign; other texts skip the search.
    worth = F.col(text).rlike("[0-9@]")
    out = (
        docs.withColumn("__llm_found", F.when(worth, found).otherwise(F.array().cast("array<string>")))
        .withColumn("__llm_between", F.when(F.size("__llm_found") > 0, between))
        .withColumn(text, new)
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def findings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per find that passes its check: the row's columns, its place among the row's finds, kind, value, image."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    good = F.filter(F.flatten(F.transform(found, pieces)), lambda p: p["kind"].isNotNull())
    rows = docs.select("*", F.posexplode(good).alias("place", "__llm_piece"))
    return (
        rows.withColumn("value", F.col("__llm_piece.found"))
        .withColumn("kind", F.col("__llm_piece.kind"))
        .withColumn("image", pseudonym(key, F.col("value"), F.col("kind")))
        .drop(text, "__llm_piece")
    )


def op1_pii_feistel(spark, folder):
    """All documents with their new text."""
    return pseudonymise(tables.read(spark, folder, "documents"), TEST_KEY)


QUERIES = {"op1_pii_feistel": op1_pii_feistel}
