"""Check digits and identifiers as column expressions: IBAN, ABA, VAT, Luhn; names and business days."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters_to_numbers(text: Column) -> Column:
    """Each letter as its two-digit number, A = 10."""
    for i in range(26):
        text = F.replace(text, F.lit(chr(65 + i)), F.lit(str(10 + i)))
    return text


def mod97(digits: Column) -> Column:
    """The remainder of a long decimal number by 97, digit by digit."""
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda at, d: F.when(d == "", at).otherwise((at * 10 + d.cast("int")) % 97))


def iban_check_digits(country: Column, account: Column) -> Column:
    return F.lpad((98 - mod97(_letters_to_numbers(F.upper(F.concat(account, country, F.lit("00")))))).cast("string"), 2, "0")


def iban_valid(iban: Column) -> Column:
    plain = F.upper(F.regexp_replace(iban, r"\s", ""))
    formed = plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    return F.coalesce(F.when(formed, mod97(_letters_to_numbers(moved)) == 1).otherwise(F.lit(False)), F.lit(False))


def weighted_digits(text: Column, weights: list[int]) -> Column:
    return sum((F.substring(text, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def aba_check_digit(eight: Column) -> Column:
    """The ninth digit of a routing number: weights 3, 7, 1 and modulus 10."""
    return ((10 - weighted_digits(eight, [3, 7, 1, 3, 7, 1, 3, 7]) % 10) % 10).cast("string")


def aba_valid(number: Column) -> Column:
    formed = number.rlike("^[0-9]{9}$")
    return F.coalesce(F.when(formed, weighted_digits(number, [3, 7, 1] * 3) % 10 == 0).otherwise(F.lit(False)), F.lit(False))


def luhn_valid(number: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))
    kept = F.filter(digits, lambda d: d != "")
    doubled = F.transform(kept, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.coalesce((F.size(kept) > 1) & (F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0), F.lit(False))


def vat_key_fr(siren: Column) -> Column:
    """The two-digit key of a French VAT number: (12 + 3 * (SIREN mod 97)) mod 97."""
    return F.lpad(((12 + 3 * (siren.cast("long") % 97)) % 97).cast("string"), 2, "0")


def vat_check_it(ten: Column) -> Column:
    """The eleventh digit of an Italian VAT number: every second digit doubled, its digits added, modulus 10."""
    digit = lambda i: F.substring(ten, i + 1, 1).cast("int")
    doubled = lambda i: digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)
    total = sum((digit(i) if i % 2 == 0 else doubled(i) for i in range(10)), F.lit(0))
    return ((10 - total % 10) % 10).cast("string")


#: What follows the country in a VAT number, # for a digit; L is a letter of LETTERS, D a digit 0 or 1, N 01 to 99.
VAT_FORMS = {"DE": "#########", "ES": "L########", "NL": "#########BN", "AT": "U########", "BE": "D#########", "IE": "#######L", "PL": "##########", "SE": "##########01"}
LETTERS = {"ES": "ABCDEFGHJKLMNPQRSUVW", "IE": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def vat_number(country: str, u) -> Column:
    """A VAT number of one of ten countries; ``u(i)`` is the i-th uniform number of a row."""
    number = lambda i, n: F.lpad(F.floor(u(i) * 10**n).cast("long").cast("string"), n, "0")
    if country == "FR":
        siren = (F.floor(u(0) * 900_000_000) + 100_000_000).cast("long").cast("string")
        return F.concat(F.lit("FR"), vat_key_fr(siren), siren)
    if country == "IT":
        ten = F.concat(number(0, 5), number(1, 5))
        return F.concat(F.lit("IT"), ten, vat_check_it(ten))
    parts, form = [F.lit(country)], VAT_FORMS[country]
    for i, piece in enumerate(re.findall("#{1,5}|[^#]", form)):
        if piece[0] == "#":
            parts.append(number(i, len(piece)))
        elif piece == "L":
            letters = LETTERS[country]
            parts.append(F.substring(F.lit(letters), (F.floor(u(i) * len(letters)) + 1).cast("int"), F.lit(1)))
        elif piece == "D":
            parts.append(F.floor(u(i) * 2).cast("string"))
        elif piece == "N":
            parts.append(F.lpad((F.floor(u(i) * 99) + 1).cast("string"), 2, "0"))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def normalize_gender(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("m", "male", "man"), "M").when(low.isin("f", "female", "woman"), "F")


def plain_ascii(text: Column) -> Column:
    """Lower-case a to z only, accents taken off."""
    low = F.lower(text)
    for letter, plain in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        low = F.replace(low, F.lit(letter), F.lit(plain))
    low = F.translate(low, "łøđáàâäãåéèêëíìîïóòôöõúùûüýÿñçšžőűąęćńśźż", "lodaaaaaaeeeeiiiiooooouuuuyyncszouaecnszz")
    return F.regexp_replace(low, "[^a-z]", "")


#: Holidays (month-day) that fall on one date every year.
HOLIDAYS = {
    "DE": ["01-01", "05-01", "10-03", "12-25", "12-26"],
    "FR": ["01-01", "05-01", "05-08", "07-14", "08-15", "11-01", "11-11", "12-25"],
    "IT": ["01-01", "01-06", "04-25", "05-01", "06-02", "08-15", "11-01", "12-08", "12-25", "12-26"],
    "GB": ["01-01", "12-25", "12-26"],
}


def business_day(date: Column, country: str = "DE") -> Column:
    """Monday to Friday and no fixed holiday."""
    return F.dayofweek(date).between(2, 6) & ~F.date_format(date, "MM-dd").isin(HOLIDAYS[country])


def european_offset(moment: Column, standard: int) -> Column:
    """Hours from UTC with European summer time: from the last Sunday of March to that of October, 01:00 UTC."""

    def last_sunday(month: int) -> Column:
        end = F.last_day(F.make_date(F.year(moment), F.lit(month), F.lit(1)))
        return F.date_sub(end, F.dayofweek(end) - 1).cast("timestamp") + F.expr("INTERVAL 1 HOUR")

    summer = (moment >= last_sunday(3)) & (moment < last_sunday(10))
    return F.lit(standard) + summer.cast("int")
