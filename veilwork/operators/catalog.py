"""The shipped rules, patterns, word lists and label tables.

Values marked as fixed are facts the results depend on; they are data, not logic.
"""

from __future__ import annotations

from veilwork.operators.rules import PATTERN, Rule

# --- fixed values: labels asked for when the caller names none
DEFAULT_LABELS = ("NAME", "AGE", "SSN")

# --- fixed values: names of states and territories
STATE_NAMES = (
    "Alabama", "Alaska", "American Samoa", "Arizona", "Arkansas", "California", "Colorado",
    "Connecticut", "Delaware", "District of Columbia", "Florida", "Georgia", "Guam", "Hawaii",
    "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland",
    "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska",
    "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina",
    "North Dakota", "Northern Mariana Islands", "Ohio", "Oklahoma", "Oregon", "Palau",
    "Pennsylvania", "Puerto Rico", "Rhode Island", "South Carolina", "South Dakota", "Tennessee",
    "Texas", "Utah", "Vermont", "Virgin Islands", "Virginia", "Washington", "West Virginia",
    "Wisconsin", "Wyoming",
)

# --- fixed values: postal codes of states
STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA",
    "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM",
    "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA",
    "WV", "WI", "WY",
)

# --- fixed values: before a postal code any single word of a state name counts, in two casings
ZIP_WORDS = STATE_CODES + (
    "Alabama", "Maine", "Pennsylvania", "Alaska", "Maryland", "Rhode", "Island", "Arizona", "Massachusetts",
    "South", "Carolina", "Arkansas", "Michigan", "Dakota", "California", "Minnesota", "Tennessee", "Colorado",
    "Mississippi", "Texas", "Connecticut", "Missouri", "Utah", "Delaware", "Montana", "Vermont", "District",
    "of", "Columbia", "Nebraska", "Virginia", "Florida", "Nevada", "Washington", "Georgia", "New", "Hampshire",
    "West", "Hawaii", "Jersey", "Wisconsin", "Idaho", "Mexico", "Wyoming", "Illinois", "York", "American",
    "Samoa", "Indiana", "North", "Guam", "Iowa", "Northern", "Mariana", "Islands", "Kansas", "Ohio", "Palau",
    "Kentucky", "Oklahoma", "Puerto", "Rico", "Louisiana", "Oregon", "Virgin",
    "ALABAMA", "MAINE", "PENNSYLVANIA", "ALASKA", "MARYLAND", "RHODE", "ISLAND", "ARIZONA", "MASSACHUSETTS",
    "SOUTH", "CAROLINA", "ARKANSAS", "MICHIGAN", "DAKOTA", "CALIFORNIA", "MINNESOTA", "TENNESSEE", "COLORADO",
    "MISSISSIPPI", "TEXAS", "CONNECTICUT", "MISSOURI", "UTAH", "DELAWARE", "MONTANA", "VERMONT", "DISTRICT",
    "OF", "COLUMBIA", "NEBRASKA", "VIRGINIA", "FLORIDA", "NEVADA", "WASHINGTON", "GEORGIA", "NEW", "HAMPSHIRE",
    "WEST", "HAWAII", "JERSEY", "WISCONSIN", "IDAHO", "MEXICO", "WYOMING", "ILLINOIS", "YORK", "AMERICAN",
    "SAMOA", "INDIANA", "NORTH", "GUAM", "IOWA", "NORTHERN", "MARIANA", "ISLANDS", "KANSAS", "OHIO", "PALAU",
    "KENTUCKY", "OKLAHOMA", "PUERTO", "RICO", "LOUISIANA", "OREGON", "VIRGIN",
)

# --- fixed values: context words of the rules
SSN_WORDS = ("ssn", "social", "security", "ssns", "ss#", "ssn#", "ssid", "ss #", "ssn #")
ACCOUNT_WORDS = (
    "check", "account", "account#", "acct", "routing", "acct#", "save", "debit", "bank", "aba",
    "aba routing", "abarouting", "association", "bankrouting",
)
LICENSE_WORDS = (
    "license", "License", "LICENSE", "lic", "Lic", "LIC", "licence", "Licence", "LICENCE",
    "lic#", "Lic#", "LIC#", "license#", "License#", "LICENSE#", "licence#", "Licence#", "LICENCE#",
    "certificate", "Certificate", "CERTIFICATE", "cert", "Cert", "CERT",
    "certificate#", "Certificate#", "CERTIFICATE#", "cert#", "Cert#", "CERT#",
)
VIN_WORDS = ("VIN",)
AGE_PHRASES = (
    "-years-old", "years-old", "-year-old", "year-old", "-months-old", "months-old", "-month-old", "month-old",
    "-day-old", "day-old", "-days-old", "days-old", "-week-old", "week-old", "-weeks-old", "weeks-old",
    "month old", "days old", "year old", "years old", "week old", "weeks old",
    "years of age", "months of age", "weeks of age", "days of age",
)
PHONE_WORDS = ("call", "phone")
IDNUM_WORDS = ("CVS/PHARMACY", "Wal-Mart Pharmacy")
MEDICALRECORD_WORDS = ("ICU Admission",)
EMAIL_WORDS = ("email", "e-mail", "e-mail address", "email address", "mail")

# --- fixed values: regexes of the rules
SSN_REGEX = r"\d{3}.?\d{2}.?\d{4}"
ACCOUNT_REGEX = r"[0-9]{7,17}|[0123678]\d{3}.?\d{4}.?\d"
LICENSE_REGEX = r"\S+\d\S+"
VIN_REGEX = r"(^\d[A-Za-z]{4}\d{2}[A-Za-z]{4}\d{6}$)|(^\d[A-Za-z]\d[A-Za-z]{2}\d{5}[A-Za-z]\d{6}$)"
AGE_REGEX = r"[0-9]+(?:[ \t\x0B\f\r]?-?1/2)?"
AGE_KEEP = r"^[0-9]{1,3}(?:[^0-9]|$)"
PHONE_REGEX = (
    r"(?<![0-9][ \t\n\x0B\f\r])\([1-9][0-9]{2}\)\.?-?[ \t\n\x0B\f\r]?[0-9]{3}"
    r"\.?-?[ \t\n\x0B\f\r]?[0-9]{4}(?![0-9])"
)
IDNUM_REGEX = r"(?<=#)[0-9]{4,5}"
ZIP_REGEX = r"(^\d{5}$)|(^\d{5}-\d{4}$)"
MEDICALRECORD_REGEX = r"^\d{5}$"
_LOCAL_CLASS = r"a-z0-9!#$%&'*+/=?^_`{|}~-"
_LOCAL = f"[{_LOCAL_CLASS}]+"
_QUOTED = r'"(?:[^"\\\s]|\\[^\s])*"'
_HOST = r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_LITERAL = rf"\[(?:{_OCTET}\.){{3}}(?:{_OCTET}|[a-z0-9-]*[a-z0-9]:[^\[\]\s]+)\]"
EMAIL_REGEX = rf"(?:{_LOCAL}(?:\.{_LOCAL})*|{_QUOTED})@(?:{_HOST}|{_LITERAL})"

# The same tokens in linear time and bounded stack.  A token rule only asks whether a token holds a match, so one
# character on either side of a digit is as good as many, two labels make a host, a local part is read from its first
# character, and a quoted one from the last quote it can begin with.
LICENSE_TEST = r"\S\d\S"
_LABEL = r"[a-z0-9]++(?:-++[a-z0-9]++)*+"
_BARE = rf"(?<![{_LOCAL_CLASS}])(?<![{_LOCAL_CLASS}]\.)[{_LOCAL_CLASS}]++(?:\.[{_LOCAL_CLASS}]++)*+"
_LAST_QUOTED = r'"[^"\\\s]*+(?:\\[^"\s][^"\\\s]*+)*+"'
EMAIL_TEST = rf"(?:{_BARE}|{_LAST_QUOTED})@(?:{_LABEL}\.[a-z0-9]|{_LITERAL})"

CONTEXT_RULES = (
    Rule("SSN", SSN_REGEX, prefix=SSN_WORDS, context_length=20, signal=True, min_length=9),
    Rule("ACCOUNT", ACCOUNT_REGEX, prefix=ACCOUNT_WORDS, context_length=25, signal=True, min_length=7),
    Rule(
        "LICENSE", LICENSE_REGEX, test=LICENSE_TEST, prefix=LICENSE_WORDS, suffix=LICENSE_WORDS, context_length=20,
        case_sensitive=True, signal=True, min_length=3,
    ),
    Rule("VIN", VIN_REGEX, prefix=VIN_WORDS, context_length=5, signal=True, min_length=17, max_length=17),
    Rule(
        "AGE", AGE_REGEX, match_scope="sub-token", suffix=AGE_PHRASES, context_length=20,
        keep=AGE_KEEP, signal=True,
    ),
    Rule(
        "PHONE", PHONE_REGEX, rule_scope="document", match_scope="sub-token", prefix=PHONE_WORDS,
        context_length=10, signal=True,
    ),
    Rule(
        "IDNUM", IDNUM_REGEX, match_scope="sub-token", prefix=IDNUM_WORDS, context_length=20, signal=True,
    ),
    Rule(
        "ZIP", ZIP_REGEX, prefix=ZIP_WORDS, context_length=5, case_sensitive=True, signal=True, min_length=5,
        max_length=10,
    ),
    Rule(
        "MEDICALRECORD", MEDICALRECORD_REGEX, prefix=MEDICALRECORD_WORDS, context_length=15, signal=True,
        min_length=5, max_length=5,
    ),
    Rule(
        "EMAIL", EMAIL_REGEX, test=EMAIL_TEST, prefix=EMAIL_WORDS, suffix=EMAIL_WORDS, context_length=60, signal=True,
        literal="@",
    ),
)
CONTEXT_RULES_BY_ENTITY = {r.entity: r for r in CONTEXT_RULES}

# --- context-free patterns and short-context forms for labels without a rule
_WS = r" \t\n\x0B\f\r"
_MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
    "November", "December",
)
_MONTH = "(?:" + "|".join(_MONTHS) + "|" + "|".join(f"{m[:3]}" for m in _MONTHS if len(m) > 3) + ")"
URL_REGEX = rf"(?:https?://|www\.)[^{_WS}<>\"'()]*[^{_WS}<>\"'().,;:!?]"
DATE_REGEX = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"
    rf"|{_MONTH} [0-9]{{1,2}},? [0-9]{{4}}|[0-9]{{1,2}} {_MONTH} [0-9]{{4}}"
)
PHONE_PATTERN_REGEX = r"(?:\+1 ?)?\([1-9][0-9]{2}\) ?[0-9]{3}-[0-9]{4}"
EMAIL_PATTERN_REGEX = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
FAX_REGEX = r"\+?[0-9(][0-9() -]{6,}[0-9]"
# A match can only begin where a run of its characters does, so the runs are found and each is cut once.
FAX_RUN = r"\+?+[0-9(][0-9() -]*+"
STREET_REGEX = (
    r"[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Way)"
)
DOCTOR_REGEX = r"[A-Z][A-Za-z'-]+"
# behind a form of address: up to three capitalised words, or an identifier that stands for a name
NAME_LEAD = r"(?:Patient|Mrs|Mr|Ms|Miss|Name)[.:]? "
NAME_SHAPE = r"[A-Za-z]+[#_][0-9]+|[A-Z][A-Za-z'-]*[a-z](?: [A-Z][A-Za-z'-]*[a-z]){0,2}"
# the blank that ends every lead is looked for first: it shuts out all letters inside words
NAME_REGEX = rf"(?=[A-Za-z])(?<= )(?<={NAME_LEAD})(?:{NAME_SHAPE})"
DEVICE_REGEX = r"^[A-Z0-9-]{3,}[0-9][A-Z0-9-]*$"
DEVICE_TEST = r"^[A-Z0-9-]{3}(?=[A-Z-]*+[0-9])[A-Z0-9-]++$"
ID_REGEX = r"^[A-Za-z]{2,}[#-]?[0-9]{4,}$"


def _pattern(entity: str, regex: str, **options) -> Rule:
    options.setdefault("match_scope", "sub-token")
    options.setdefault("case_sensitive", True)
    return Rule(entity, regex, detector=f"pattern_{entity}", kind=PATTERN, **options)


PATTERN_RULES = (
    _pattern("NAME", NAME_REGEX),
    _pattern("URL", URL_REGEX),
    _pattern("DATE", DATE_REGEX, signal=True),
    _pattern("PHONE", PHONE_PATTERN_REGEX, signal=True),
    _pattern("EMAIL", EMAIL_PATTERN_REGEX, signal=True),
    _pattern("FAX", FAX_RUN, cut=FAX_REGEX, signal=True, prefix=("fax", "Fax", "FAX"), context_length=10),
    _pattern("STREET", STREET_REGEX, signal=True),
    _pattern("DOCTOR", DOCTOR_REGEX, rule_scope="document", prefix=("Dr", "Doctor"), context_length=2),
    _pattern(
        "DEVICE", DEVICE_REGEX, test=DEVICE_TEST, match_scope="token", signal=True, prefix=("serial", "device"), context_length=15
    ),
    _pattern("ID", ID_REGEX, match_scope="token", signal=True),
)
PATTERN_RULES_BY_ENTITY = {r.entity: r for r in PATTERN_RULES}

# --- fixed values: short word lists that stand in for closed models
WORD_LISTS = {
    "STATE": tuple(n.lower() for n in STATE_NAMES),
    "GENDER": ("male", "female", "man", "woman", "boy", "girl", "transgender", "nonbinary"),
    "RACE_ETHNICITY": (
        "african american", "american indian", "asian", "black", "caucasian", "hispanic", "latino",
        "pacific islander", "white",
    ),
    "SEXUAL_ORIENTATION": ("asexual", "bisexual", "gay", "heterosexual", "homosexual", "lesbian", "straight"),
    "SPIRITUAL_BELIEFS": (
        "atheist", "buddhist", "catholic", "christian", "hindu", "jewish", "muslim", "protestant",
    ),
}

# --- fixed values: labels renamed before the whitelist
LABEL_RENAMES = {
    "CONTACT": "PHONE",
    "ID": "IDNUM",
    "BIOID": "IDNUM",
    "SPIRITUAL_BELIEFS": "RELIGION",
}

# --- fixed values: (detector, label) pairs, best first
PRECEDENCE = (
    ("SSN_chunks", "SSN"),
    ("ACCOUNT_chunks", "ACCOUNT"),
    ("LICENSE_chunks", "LICENSE"),
    ("VIN_chunks", "VIN"),
    ("AGE_chunks", "AGE"),
    ("PHONE_chunks", "PHONE"),
    ("ZIP_chunks", "ZIP"),
    ("MEDICALRECORD_chunks", "MEDICALRECORD"),
    ("EMAIL_chunks", "EMAIL"),
)

# Labels that only a model or a caller's dictionary can find.
EXTERNAL_LABELS = ("NAME", "PATIENT", "LOCATION", "CITY", "COUNTRY", "HOSPITAL", "BIOID")

# (entity, detector, kind): every detector of a label is kept.
DETECTORS = (
    tuple((r.entity, r.detector, "context") for r in CONTEXT_RULES)
    + tuple((r.entity, r.detector, "pattern") for r in PATTERN_RULES)
    + tuple((entity, f"words_{entity}", "words") for entity in WORD_LISTS)
    + tuple((entity, "dictionary", "dictionary") for entity in EXTERNAL_LABELS if entity != "BIOID")
    + tuple((entity, "tagger", "model") for entity in EXTERNAL_LABELS + ("DOCTOR", "STREET", "DEVICE"))
)

# --- fixed values: surrogate values by label
SURROGATES = {
    "NAME": ("Alex Morgan", "Sam Taylor", "Robin Lee", "Jamie Clark", "Casey Hall", "Drew Young", "Kim Reed"),
    "PATIENT": ("Alex Morgan", "Sam Taylor", "Robin Lee", "Jamie Clark", "Casey Hall", "Drew Young", "Kim Reed"),
    "DOCTOR": ("Adams", "Baker", "Carter", "Davis", "Evans", "Foster", "Green"),
    "AGE": ("31", "36", "42", "47", "53", "58", "64"),
    "SSN": (
        "900-10-1001", "900-20-2002", "900-30-3003", "900-40-4004", "900-50-5005", "900-60-6006", "900-70-7007",
    ),
    "ACCOUNT": ("90000001", "90000012", "90000023", "90000034", "90000045", "90000056", "90000067"),
    "LICENSE": ("L900001Z", "L900012Z", "L900023Z", "L900034Z", "L900045Z", "L900056Z", "L900067Z"),
    "VIN": (
        "9ZZZZ00ZZZZ000001", "9ZZZZ00ZZZZ000012", "9ZZZZ00ZZZZ000023", "9ZZZZ00ZZZZ000034",
        "9ZZZZ00ZZZZ000045", "9ZZZZ00ZZZZ000056", "9ZZZZ00ZZZZ000067",
    ),
    "ZIP": ("00501", "00544", "00600", "00700", "00800", "00900", "00999"),
    "MEDICALRECORD": ("90001", "90012", "90023", "90034", "90045", "90056", "90067"),
    "EMAIL": (
        "a@example.org", "b@example.org", "c@example.org", "d@example.org", "e@example.org", "f@example.org",
        "g@example.org",
    ),
    "CITY": ("Ashford", "Brookfield", "Clayton", "Dover", "Elmwood", "Fairview", "Georgetown"),
    "COUNTRY": ("Andora", "Borland", "Cascadia", "Dorne", "Elbonia", "Freedonia", "Genovia"),
    "HOSPITAL": ("Hill Clinic", "Lake Clinic", "Park Clinic", "River Clinic", "Sea Clinic", "Sun Clinic", "Vale Clinic"),
    "DATE": ("2001-02-03", "2002-03-04", "2003-04-05", "2004-05-06", "2005-06-07", "2006-07-08", "2007-08-09"),
    "URL": (
        "http://a.example.org", "http://b.example.org", "http://c.example.org", "http://d.example.org",
        "http://e.example.org", "http://f.example.org", "http://g.example.org",
    ),
}
# --- fixed values: labels whose surrogate keeps length and format (ID is renamed IDNUM)
SAME_LENGTH_LABELS = ("PHONE", "ID", "IDNUM")
# --- fixed values: page image parameters
THRESHOLD_BLOCK, THRESHOLD_OFFSET = 47, 4
MATCHING_WINDOW, REGION_PADDING = 100, 1
