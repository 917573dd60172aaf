"""Normalisers and classifiers of attribute values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a Java class: ``\s`` alone would be ASCII.
_SPACE = r"(?U)\s+"
_EDGES = r"(?U)^\s+|\s+$"

# Personal mail domains, the local phone prefix and lengths, a
# government id without brackets, and gender words.
PERSONAL_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com"]
LOCAL_PREFIX, LOCAL_DIGITS = "852", 8
BARE_GOV_ID = r"^([A-Z]\d{6})(\d)$"
MALE, FEMALE, OTHER = ["M", "MALE", "MAN"], ["F", "FEMALE", "WOMAN"], ["O", "OTHER", "NON-BINARY"]


def _given(v: Column, out: Column) -> Column:
    """Null for null and empty input."""
    return F.when(v.isNotNull() & (v != ""), out)


def strip(v: Column) -> Column:
    return F.regexp_replace(v, _EDGES, "")


def normalize_name(v: Column) -> Column:
    """Trim, upper case, single spaces, then no full stops and commas."""
    return _given(v, F.translate(F.regexp_replace(F.upper(strip(v)), _SPACE, " "), ".,", ""))


def normalize_date(v: Column) -> Column:
    """Trim only; a bad date stays as it is."""
    return _given(v, strip(v))


def normalize_email(v: Column) -> Column:
    """Trim and lower case; null without an at sign or without a dot right of it."""
    mail = F.lower(strip(v))
    return _given(v, F.when(F.contains(mail, F.lit("@")) & F.contains(F.split_part(mail, F.lit("@"), F.lit(2)), F.lit(".")), mail))


def normalize_phone(v: Column) -> Column:
    """``+`` and digits; 8 digits are local numbers of country 852."""
    digits = F.regexp_replace(v, r"(?U)\D", "")
    plus = strip(v).startswith("+")
    local = F.when(~plus & (F.length(digits) == LOCAL_DIGITS), F.concat(F.lit(f"+{LOCAL_PREFIX}"), digits)).otherwise(F.concat(F.lit("+"), digits))
    return _given(v, F.when(digits != "", local))


def normalize_gov_id(v: Column) -> Column:
    """Trim and upper case; a letter and seven digits get the check digit in brackets."""
    return _given(v, F.regexp_replace(F.upper(strip(v)), BARE_GOV_ID, "$1($2)"))


def normalize_address(v: Column) -> Column:
    """Trim, upper case, single spaces."""
    return _given(v, F.regexp_replace(F.upper(strip(v)), _SPACE, " "))


def normalize_gender(v: Column) -> Column:
    """M, F or O for their words, else the word in upper case."""
    word = F.upper(strip(v))
    return _given(v, F.when(word.isin(MALE), "M").when(word.isin(FEMALE), "F").when(word.isin(OTHER), "O").otherwise(word))


def normalize_default(v: Column) -> Column:
    """Trim and upper case."""
    return _given(v, F.upper(strip(v)))


# Which normaliser an attribute name gets.
NORMALIZERS = {
    "First Name": normalize_name,
    "Last Name": normalize_name,
    "Date of Birth": normalize_date,
    "Email Address": normalize_email,
    "Phone Number": normalize_phone,
    "Government ID": normalize_gov_id,
    "Address": normalize_address,
    "Gender": normalize_gender,
}


def normalize(attribute_name: Column, v: Column) -> Column:
    """The normaliser of the attribute's name; other names get the default."""
    out: Column | None = None
    for name, function in NORMALIZERS.items():
        out = F.when(attribute_name == name, function(v)) if out is None else out.when(attribute_name == name, function(v))
    return out.otherwise(normalize_default(v))


# Classes of identifiers as (pattern, subtype, confidence), the
# first that fits; the last of each list is for values that fit none.
GOV_ID_CLASSES = [(r"^[A-Z]{1,2}\d{6}\(\d\)$", "HKID", 1.0), (r"^[A-Z]{1,2}\d{6,8}$", "PASSPORT", 0.9), (r"^[A-Z]\d{7,10}$", "DRIVERS_LICENSE", 0.7), (None, "GOV_ID_UNKNOWN", 0.5)]
PHONE_CLASSES = [(r"^\+852[96]\d{7}$", "MOBILE", 0.95), (r"^\+852[23]\d{7}$", "LANDLINE", 0.95), (r"^\+\d{10,15}$", "MOBILE", 0.7), (None, "PHONE_GENERIC", 0.5)]
EMAIL_PERSONAL, EMAIL_OTHER = ("EMAIL_PERSONAL", 0.9), ("EMAIL_GENERIC", 0.8)


def _class(subtype: str, confidence: float) -> Column:
    return F.struct(F.lit(subtype).alias("subtype"), F.lit(confidence).alias("confidence"))


def _first_class(v: Column, classes: list[tuple[str | None, str, float]]) -> Column:
    *known, (_, subtype, confidence) = classes
    out = _class(subtype, confidence)
    for pattern, name, score in reversed(known):
        out = F.when(v.rlike(pattern), _class(name, score)).otherwise(out)
    return out


def classify_gov_id(v: Column) -> Column:
    """(subtype, confidence) of a normalised government id."""
    return _first_class(v, GOV_ID_CLASSES)


def classify_phone(v: Column) -> Column:
    """(subtype, confidence) of a normalised phone number."""
    return _first_class(v, PHONE_CLASSES)


def classify_email(v: Column) -> Column:
    """(subtype, confidence) of a normalised email; null without an at sign."""
    personal = F.split_part(v, F.lit("@"), F.lit(2)).isin(PERSONAL_DOMAINS)
    return F.when(F.contains(v, F.lit("@")), F.when(personal, _class(*EMAIL_PERSONAL)).otherwise(_class(*EMAIL_OTHER)))


def classify(attribute_name: Column, v: Column) -> Column:
    """The classifier of the attribute's name; null for names without one."""
    return F.when(attribute_name == "Government ID", classify_gov_id(v)).when(attribute_name == "Phone Number", classify_phone(v)).when(attribute_name == "Email Address", classify_email(v))
