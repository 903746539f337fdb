"""Rich normalizers of e-mail addresses, phone numbers, names, postal addresses and UUIDs.

Each takes a string column and returns a struct column; a null input gives a null struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordia.functions.lookup import let, look, title_case

# --- e-mail -----------------------------------------------------------------

#: Domains where dots in the local part mean nothing.
GMAIL = ("gmail.com", "googlemail.com")
#: Mail providers by domain.
PROVIDERS = {
    "gmail.com": "google", "googlemail.com": "google", "outlook.com": "microsoft", "hotmail.com": "microsoft", "live.com": "microsoft",
    "yahoo.com": "yahoo", "yahoo.co.uk": "yahoo", "aol.com": "aol", "protonmail.com": "proton", "icloud.com": "apple", "me.com": "apple",
}


def email(c: Column) -> Column:
    """normalized, confidence, provider, variations, is_valid.

    The domain is lower-cased, a +tag is cut, dots go for Gmail; other text keeps its case.
    """
    valid = c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
    local, raw_domain = F.split_part(c, F.lit("@"), F.lit(1)), F.split_part(c, F.lit("@"), F.lit(2))
    domain = F.lower(raw_domain)
    plain = F.split_part(local, F.lit("+"), F.lit(1))
    gmail = domain.isin(*GMAIL)
    base = F.when(gmail, F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain)
    normalized = F.concat(base, F.lit("@"), domain)
    changed = F.length(local) - F.length(base)
    confidence = F.when(c == normalized, 1.0).otherwise(F.greatest(F.lit(0.1), 0.9 - changed / F.length(local) * 0.2))
    variants = F.array_distinct(
        F.filter(
            F.array(
                F.when(plain != local, F.concat(plain, F.lit("@"), domain)),
                F.when(base != plain, normalized),
            ),
            lambda v: v.isNotNull(),
        )
    )
    return F.when(
        c.isNotNull(),
        F.struct(
            F.when(valid, normalized).otherwise(c).alias("normalized"),
            F.when(valid, confidence).otherwise(0.0).alias("confidence"),
            F.when(valid, look(PROVIDERS, domain)).alias("provider"),
            F.when(valid, variants).otherwise(F.array().cast("array<string>")).alias("variations"),
            valid.alias("is_valid"),
        ),
    )


def email_variations(c: Column) -> Column:
    """All spellings under which an address may occur, sorted."""
    parts = email(c)
    local, domain = F.split_part(c, F.lit("@"), F.lit(1)), F.lower(F.split_part(c, F.lit("@"), F.lit(2)))
    base = F.split_part(F.replace(local, F.lit("."), F.lit("")), F.lit("+"), F.lit(1))
    more = F.when(
        domain.isin(*GMAIL), F.array(F.concat(base, F.lit("@"), domain), F.concat(F.lower(local), F.lit("@"), domain))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.array(parts["normalized"]), parts["variations"], more)))


# --- phone ------------------------------------------------------------------

#: Calling codes and the most digits of a national number.
CALLING_CODES = {
    "1": 10, "44": 10, "49": 11, "33": 9, "81": 10, "86": 11, "91": 10, "55": 11, "61": 9, "7": 10, "39": 10, "34": 9, "31": 9, "46": 9,
    "47": 8, "45": 8, "41": 9, "43": 10, "32": 9, "351": 9, "30": 10, "48": 9, "420": 9, "36": 9, "40": 10, "385": 8, "386": 8, "421": 9,
    "370": 8, "371": 8, "372": 8, "358": 9, "354": 7, "353": 9, "356": 8, "357": 8, "352": 9, "377": 8, "378": 10, "379": 10, "380": 9,
    "375": 9, "374": 8, "995": 9, "994": 9, "993": 8, "992": 9, "998": 9, "996": 9, "212": 9, "213": 9, "216": 8, "218": 9, "220": 7,
    "221": 9, "222": 8, "223": 8, "224": 9, "225": 8, "226": 8, "227": 8, "228": 8, "229": 8, "230": 7, "231": 8, "232": 8, "233": 9,
    "234": 10, "235": 8, "236": 8, "237": 9, "238": 7, "239": 7, "240": 9, "241": 8, "242": 9, "243": 9, "244": 9, "245": 7, "246": 7,
    "248": 7, "249": 9, "250": 9, "251": 9, "252": 8, "253": 8, "254": 9, "255": 9, "256": 9, "257": 8, "258": 9, "260": 9, "261": 9,
    "262": 9, "263": 9, "264": 7, "265": 9, "266": 8, "267": 8, "268": 8, "269": 7, "27": 9,
}


def phone(c: Column, default_code: str = "1") -> Column:
    """normalized (E.164), confidence, country_code, national_number, is_valid.

    Ten digits without a leading zero belong to the default country; other numbers take
    the longest calling code that leaves 7 digits or more, but not too many.
    """
    bare = F.regexp_replace(F.trim(c), r"[\s\-().+]", "")
    return let(F.regexp_replace(bare, "^00", ""), lambda digits: _phone(c, digits, default_code))


def _phone(c: Column, digits: Column, default_code: str) -> Column:
    well = digits.rlike("^[0-9]{7,15}$")
    home = (F.length(digits) == 10) & ~digits.startswith("0")
    fits = []
    for n in (3, 2, 1):
        code = F.substring(digits, 1, n)
        rest = F.length(digits) - n
        fits.append(F.when((rest <= look(CALLING_CODES, code)) & (rest >= 7), code))
    code = F.when(home, F.lit(default_code)).otherwise(F.coalesce(*fits))
    return let(code, lambda code: _phone_parts(c, digits, code, well, home, default_code))


def _phone_parts(c: Column, digits: Column, code: Column, well: Column, home: Column, default_code: str) -> Column:
    national = F.when(home, digits).otherwise(F.substring(digits, F.length(code) + 1, F.lit(20)))
    valid = F.coalesce(well & code.isNotNull(), F.lit(False))
    normalized = F.concat(F.lit("+"), code, national)
    same = F.regexp_replace(c, r"[\s\-().+]", "") == F.concat(code, national)
    confidence = F.when(same, 1.0).otherwise(0.9) * F.when(code == default_code, 0.95).otherwise(1.0)
    confidence = confidence * F.when(F.length(national) / look(CALLING_CODES, code) < 0.7, 0.8).otherwise(1.0)
    return F.when(
        c.isNotNull(),
        F.struct(
            F.when(valid, normalized).otherwise(c).alias("normalized"),
            F.when(valid, F.greatest(F.lit(0.1), confidence)).otherwise(0.0).alias("confidence"),
            F.when(valid, code).alias("country_code"),
            F.when(valid, national).alias("national_number"),
            valid.alias("is_valid"),
        ),
    )


def phone_national(c: Column) -> Column:
    """(AAA) BBB-CCCC for ten digits of country 1, else the national number; null if invalid."""
    p = phone(c)
    n = p["national_number"]
    shown = F.concat(F.lit("("), F.substring(n, 1, 3), F.lit(") "), F.substring(n, 4, 3), F.lit("-"), F.substring(n, 7, 4))
    return F.when((p["country_code"] == "1") & (F.length(n) == 10), shown).otherwise(n)


def phone_international(c: Column) -> Column:
    """+CC NATIONAL; null if invalid."""
    p = phone(c)
    return F.concat(F.lit("+"), p["country_code"], F.lit(" "), p["national_number"])


# --- person names -----------------------------------------------------------

#: Titles before a name.
PREFIXES = {
    "mr": "Mr.", "mrs": "Mrs.", "ms": "Ms.", "miss": "Miss", "dr": "Dr.", "prof": "Prof.", "professor": "Prof.", "doctor": "Dr.",
    "rev": "Rev.", "reverend": "Rev.", "sir": "Sir", "lord": "Lord", "lady": "Lady", "hon": "Hon.", "honorable": "Hon.",
    "sen": "Sen.", "senator": "Sen.", "rep": "Rep.", "representative": "Rep.", "gov": "Gov.", "governor": "Gov.",
    "pres": "Pres.", "president": "Pres.", "capt": "Capt.", "captain": "Capt.", "col": "Col.", "colonel": "Col.",
    "gen": "Gen.", "general": "Gen.", "lt": "Lt.", "lieutenant": "Lt.", "maj": "Maj.", "major": "Maj.", "sgt": "Sgt.", "sergeant": "Sgt.",
}
#: What may follow a name.
SUFFIXES = {
    "jr": "Jr.", "junior": "Jr.", "sr": "Sr.", "senior": "Sr.", "ii": "II", "iii": "III", "iv": "IV", "v": "V", "vi": "VI", "vii": "VII",
    "viii": "VIII", "ix": "IX", "x": "X", "md": "M.D.", "phd": "Ph.D.", "dds": "D.D.S.", "dvm": "D.V.M.", "jd": "J.D.", "cpa": "C.P.A.",
    "esq": "Esq.", "esquire": "Esq.", "rn": "R.N.", "lpn": "L.P.N.", "pa": "P.A.", "np": "N.P.",
}


def person(c: Column) -> Column:
    """normalized, confidence, prefix, first_name, middle_name, last_name, suffix, is_valid."""
    return let(F.trim(c), lambda original: let(F.filter(F.split(title_case(original), r"\s+"), lambda p: p != ""), lambda parts: _person(c, original, parts)))


def _person(c: Column, original: Column, parts: Column) -> Column:
    key = lambda p: F.replace(F.lower(p), F.lit("."), F.lit(""))
    prefix = look(PREFIXES, key(F.get(parts, F.lit(0))))
    lead = F.when(prefix.isNotNull(), 1).otherwise(0)
    n = F.size(parts)
    suffix = F.when(n > lead, look(SUFFIXES, key(F.get(parts, n - 1))))
    core = F.slice(parts, lead + 1, F.greatest(n - lead - F.when(suffix.isNotNull(), 1).otherwise(0), F.lit(0)))
    return let(F.struct(prefix.alias("prefix"), suffix.alias("suffix"), core.alias("core")), lambda s: _person_parts(c, original, s["prefix"], s["suffix"], s["core"]))


def _person_parts(c: Column, original: Column, prefix: Column, suffix: Column, core: Column) -> Column:
    k = F.size(core)
    first = F.get(core, F.lit(0))
    last = F.when(k >= 2, F.get(core, k - 1))
    middle = F.when(k >= 3, F.array_join(F.slice(core, F.lit(2), F.greatest(k - 2, F.lit(0))), " "))
    normalized = F.concat_ws(" ", prefix, first, middle, last, suffix)
    count = sum((x.isNotNull().cast("int") for x in (prefix, first, middle, last, suffix)), F.lit(0))
    confidence = F.lit(0.9) * F.when(count < 2, 0.7).otherwise(1.0) * F.when(last.isNotNull(), 1.1).otherwise(1.0)
    confidence = confidence - F.abs(F.length(original) - F.length(normalized)) / F.length(original) * 0.1
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(1.0), confidence))
    ok = original != ""
    return F.when(
        c.isNotNull(),
        F.struct(
            F.when(ok, normalized).otherwise("").alias("normalized"),
            F.when(~ok, 0.0).when(original == normalized, 1.0).otherwise(confidence).alias("confidence"),
            prefix.alias("prefix"),
            first.alias("first_name"),
            middle.alias("middle_name"),
            last.alias("last_name"),
            suffix.alias("suffix"),
            ok.alias("is_valid"),
        ),
    )


def person_variations(c: Column) -> Column:
    """Spellings of a name: last first, with initials, without titles, by hyphenated part; sorted."""
    p = person(c)
    first, middle, last = p["first_name"], p["middle_name"], p["last_name"]
    initials = F.array_join(F.transform(F.split(middle, " "), lambda m: F.concat(F.substring(m, 1, 1), F.lit("."))), " ")
    initial = F.concat(F.substring(first, 1, 1), F.lit("."))
    halves = F.when(last.contains("-"), F.transform(F.split(last, "-"), lambda h: F.concat(first, F.lit(" "), h))).otherwise(F.array().cast("array<string>"))
    made = F.array(
        F.concat(last, F.lit(", "), first),
        F.concat(last, F.lit(", "), first, F.lit(" "), middle),
        F.concat(first, F.lit(" "), initials, F.lit(" "), last),
        F.concat(last, F.lit(", "), first, F.lit(" "), initials),
        F.when(p["prefix"].isNull(), F.concat(first, F.lit(" "), last)),
        F.when(p["suffix"].isNull() & last.isNotNull(), F.concat_ws(" ", p["prefix"], first, middle, last)),
        F.when(middle.isNotNull(), F.concat(initial, F.lit(" "), middle, F.lit(" "), last)),
        F.when(middle.isNotNull(), F.concat(initial, F.lit(" "), last)),
    )
    return F.array_sort(F.array_distinct(F.filter(F.concat(made, halves), lambda v: v.isNotNull())))


def display_name(c: Column) -> Column:
    p = person(c)
    return F.when(p["last_name"].isNotNull(), F.concat_ws(" ", p["first_name"], p["last_name"])).otherwise(p["normalized"])


def last_first(c: Column) -> Column:
    p = person(c)
    initial = F.when(p["middle_name"].isNotNull(), F.concat(F.lit(" "), F.substring(p["middle_name"], 1, 1), F.lit("."))).otherwise("")
    return F.when(p["last_name"].isNotNull(), F.concat(p["last_name"], F.lit(", "), p["first_name"], initial)).otherwise(p["normalized"])


# --- postal addresses -------------------------------------------------------

#: Street types by their spellings.
STREET_TYPES = {
    "st": "Street", "str": "Street", "street": "Street", "ave": "Avenue", "av": "Avenue", "avenue": "Avenue", "blvd": "Boulevard",
    "boul": "Boulevard", "boulevard": "Boulevard", "rd": "Road", "road": "Road", "dr": "Drive", "drv": "Drive", "drive": "Drive",
    "ln": "Lane", "lane": "Lane", "ct": "Court", "crt": "Court", "court": "Court", "cir": "Circle", "circ": "Circle", "circle": "Circle",
    "pl": "Place", "plc": "Place", "place": "Place", "way": "Way", "wy": "Way", "ter": "Terrace", "terr": "Terrace", "terrace": "Terrace",
    "pkwy": "Parkway", "pky": "Parkway", "parkway": "Parkway", "hwy": "Highway", "highway": "Highway", "fwy": "Freeway",
    "freeway": "Freeway", "expy": "Expressway", "expressway": "Expressway", "trl": "Trail", "trail": "Trail", "path": "Path", "pth": "Path",
    "walk": "Walk", "wlk": "Walk", "sq": "Square", "square": "Square", "loop": "Loop", "lp": "Loop", "bend": "Bend", "bnd": "Bend",
    "crk": "Creek", "creek": "Creek", "xing": "Crossing", "crossing": "Crossing", "pt": "Point", "point": "Point", "ridge": "Ridge",
    "rdg": "Ridge", "hill": "Hill", "hl": "Hill", "valley": "Valley", "vly": "Valley", "grove": "Grove", "grv": "Grove", "park": "Park",
    "pk": "Park", "gardens": "Gardens", "gdns": "Gardens", "heights": "Heights", "hts": "Heights", "meadows": "Meadows",
    "mdws": "Meadows", "woods": "Woods", "wds": "Woods",
}
#: Directions by their spellings.
DIRECTIONS = {
    "n": "North", "no": "North", "north": "North", "s": "South", "so": "South", "south": "South", "e": "East", "ea": "East", "east": "East",
    "w": "West", "we": "West", "west": "West", "ne": "Northeast", "northeast": "Northeast", "nw": "Northwest", "northwest": "Northwest",
    "se": "Southeast", "southeast": "Southeast", "sw": "Southwest", "southwest": "Southwest",
}
#: States by their postal codes.
STATES = {
    "al": "Alabama", "ak": "Alaska", "az": "Arizona", "ar": "Arkansas", "ca": "California", "co": "Colorado", "ct": "Connecticut",
    "de": "Delaware", "fl": "Florida", "ga": "Georgia", "hi": "Hawaii", "id": "Idaho", "il": "Illinois", "in": "Indiana", "ia": "Iowa",
    "ks": "Kansas", "ky": "Kentucky", "la": "Louisiana", "me": "Maine", "md": "Maryland", "ma": "Massachusetts", "mi": "Michigan",
    "mn": "Minnesota", "ms": "Mississippi", "mo": "Missouri", "mt": "Montana", "ne": "Nebraska", "nv": "Nevada", "nh": "New Hampshire",
    "nj": "New Jersey", "nm": "New Mexico", "ny": "New York", "nc": "North Carolina", "nd": "North Dakota", "oh": "Ohio", "ok": "Oklahoma",
    "or": "Oregon", "pa": "Pennsylvania", "ri": "Rhode Island", "sc": "South Carolina", "sd": "South Dakota", "tn": "Tennessee", "tx": "Texas",
    "ut": "Utah", "vt": "Vermont", "va": "Virginia", "wa": "Washington", "wv": "West Virginia", "wi": "Wisconsin", "wy": "Wyoming",
    "dc": "District of Columbia",
}
#: Words before a unit number.
UNITS = "apt|apartment|unit|ste|suite|floor|fl|room|rm|bldg|building|lot|space|spc|trailer|trlr"

_STATE = {**STATES, **{v.lower(): v for v in STATES.values()}}
_CODE = {v: k.upper() for k, v in STATES.items()}
_SHORT = {full: short.capitalize() for short, full in reversed(STREET_TYPES.items())}


def _without(text: Column, found: Column) -> Column:
    """text without the first place of found."""
    at = F.instr(text, found)
    cut = F.trim(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(found), F.length(text))))
    return F.when((found != "") & (at > 0), cut).otherwise(text)


_TAIL = r"\b([A-Za-z]{2}|[A-Za-z\s]+)\s*$"
_FIVE = "[0-9]{5}(?:-[0-9]{4})?"
#: The last ZIP and what is before it; a number that leads to further words is the house's.
_ZIP = rf"^(?:(.+)\b|(?={_FIVE}\b(?!\s+\S)))({_FIVE})\b"
_UNIT = rf"(?i)\b({UNITS})\.?\s*([a-z0-9-]+)\b"


def _some(x: Column) -> Column:
    return F.when(x != "", x)


def postal(c: Column) -> Column:
    """normalized, confidence and the parts of an address (US conventions).

    Each step takes a part off the text and hands on the rest.
    """
    original = F.trim(c)
    text = title_case(F.regexp_replace(original, r"\s+", " "))
    state = lambda t: look(_STATE, F.trim(F.lower(F.regexp_extract(t, _TAIL, 1))))
    first = let(text, lambda t: F.struct(F.regexp_extract(t, _ZIP, 2).alias("zip"), F.trim(F.regexp_replace(t, _ZIP, "$1")).alias("rest")))
    second = let(first, lambda p: let(state(p["rest"]), lambda s: F.struct(
        p["zip"].alias("zip"), s.alias("state"), F.when(s.isNotNull(), _without(p["rest"], F.regexp_extract(p["rest"], _TAIL, 0))).otherwise(p["rest"]).alias("rest"))))
    third = let(second, lambda p: let(F.filter(F.transform(F.split(p["rest"], ","), lambda x: F.trim(x)), lambda x: x != ""), lambda parts: F.struct(
        p["zip"].alias("zip"), p["state"].alias("state"),
        F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 1)).alias("city"),
        F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ", ")).otherwise(F.array_join(parts, ", ")).alias("rest"))))
    fourth = let(third, lambda p: F.struct(
        p["zip"].alias("zip"), p["state"].alias("state"), p["city"].alias("city"), _unit(p["rest"]).alias("unit"),
        _without(p["rest"], F.regexp_extract(p["rest"], _UNIT, 0)).alias("rest")))
    fifth = let(fourth, lambda p: F.struct(
        p["zip"].alias("zip"), p["state"].alias("state"), p["city"].alias("city"), p["unit"].alias("unit"),
        _some(F.regexp_extract(p["rest"], r"^([0-9]+[a-z]?)\s+", 1)).alias("house"),
        F.split(F.trim(F.regexp_replace(p["rest"], r"^[0-9]+[a-z]?\s+", "")), r"\s+").alias("words")))
    return F.when(c.isNotNull(), let(fifth, lambda p: let(_street(p["words"]), lambda s: _address(original, p, s))))


def _unit(street: Column) -> Column:
    kind, number = F.regexp_extract(street, _UNIT, 1), F.regexp_extract(street, _UNIT, 2)
    return F.when(kind != "", F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, F.lit(2), F.length(kind)), F.lit(" "), number))


def _street(words: Column) -> Column:
    """name and type of a street, directions written out."""
    key = lambda w: F.replace(F.lower(w), F.lit("."), F.lit(""))
    kind = look(STREET_TYPES, key(F.get(words, F.size(words) - 1)))
    named = lambda k: F.when(k.isNotNull(), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    spelled = lambda k: F.array_join(F.transform(named(k), lambda w: F.coalesce(look(DIRECTIONS, key(w)), w)), " ")
    return let(kind, lambda k: F.struct(_some(spelled(k)).alias("name"), k.alias("kind")))


def _address(original: Column, p: Column, street: Column) -> Column:
    zip_, parts = _some(p["zip"]), (p["house"], street["name"], street["kind"], p["unit"], p["city"], p["state"], _some(p["zip"]))
    line = _some(F.concat_ws(" ", *parts[:4]))
    count = sum((x.isNotNull().cast("int") for x in parts), F.lit(0))
    bonus = F.when(count >= 4, 0.15).when(count >= 2, 0.1).otherwise(0.0) + F.when(parts[0].isNotNull() & parts[1].isNotNull(), 0.1).otherwise(0.0)
    bonus = bonus + F.when(p["city"].isNotNull() & p["state"].isNotNull(), 0.1).otherwise(0.0) + F.when(zip_.isNotNull(), 0.05).otherwise(0.0)
    score = lambda n: F.lit(0.8) + bonus - F.abs(F.length(original) - F.length(n)) / F.length(original) * 0.05
    sure = lambda n: F.when(original == "", 0.0).when(original == n, 1.0).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score(n))))
    return let(F.concat_ws(", ", line, p["city"], p["state"], zip_), lambda n: F.struct(
        n.alias("normalized"), sure(n).alias("confidence"), p["house"].alias("street_number"), street["name"].alias("street_name"), street["kind"].alias("street_type"),
        p["unit"].alias("unit"), p["city"].alias("city"), p["state"].alias("state"), zip_.alias("postal_code")))


def postal_short(c: Column) -> Column:
    """House, street and short street type; city; state code; ZIP."""
    p = postal(c)
    line = F.when(
        p["street_number"].isNotNull() & p["street_name"].isNotNull(),
        F.concat_ws(" ", p["street_number"], p["street_name"], look(_SHORT, p["street_type"])),
    )
    return F.concat_ws(", ", line, p["city"], look(_CODE, p["state"]), p["postal_code"])


def postal_variations(c: Column) -> Column:
    """Spellings with short street types, without city or ZIP, and with the state's code; sorted."""
    p = postal(c)
    base = F.when(p["street_number"].isNotNull() & p["street_name"].isNotNull(), F.concat_ws(" ", p["street_number"], p["street_name"]))
    short = F.concat(base, F.lit(" "), look(_SHORT, p["street_type"]))
    full = F.when(p["unit"].isNull() & base.isNotNull(), F.concat_ws(" ", base, p["street_type"]))
    made = F.array(
        F.concat(short, F.lit(", "), p["city"]),
        F.concat(short, F.lit(", "), p["city"], F.lit(", "), p["state"]),
        full,
        F.concat(full, F.lit(", "), p["city"]),
        F.when(p["state"].isNotNull(), F.concat_ws(", ", p["city"], look(_CODE, p["state"]), p["postal_code"])),
    )
    return F.array_sort(F.array_distinct(F.filter(made, lambda v: v.isNotNull())))


# --- UUIDs ------------------------------------------------------------------

_HEX = "[0-9a-f]"


def _hyphens(compact: Column) -> Column:
    return F.regexp_replace(compact, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_parts(c: Column) -> Column:
    """normalized (lower case with hyphens), confidence, format, version, variant, is_valid."""
    original = F.trim(c)
    text = F.lower(original)
    bare = F.regexp_replace(text, "^urn:uuid:", "")
    shape = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"
    cleaned = F.regexp_replace(F.regexp_replace(text, "[^0-9a-f-]", ""), "-", "")
    kept = F.length(F.regexp_replace(text, "[^0-9a-f-]", "")).isin(32, 36)
    kind = (
        F.when(text.rlike(f"^urn:uuid:{shape}$"), "urn")
        .when(text.rlike(f"^{shape}$"), "standard")
        .when(text.rlike(f"^{_HEX}{{32}}$"), "compact")
        .when(kept & (F.length(cleaned) == 32), "standard")
        .otherwise("invalid")
    )
    valid = kind != "invalid"
    compact = F.when(kind == "urn", F.regexp_replace(bare, "-", "")).otherwise(cleaned)
    normalized = _hyphens(compact)
    version = F.conv(F.substring(compact, 13, 1), 16, 10).cast("int")
    high = F.conv(F.substring(compact, 17, 1), 16, 10).cast("int")
    variant = F.when(high < 8, "NCS").when(high < 12, "RFC4122").when(high < 14, "Microsoft").otherwise("Reserved")
    confidence = F.when(original == normalized, 1.0).otherwise(0.9) + F.when(kind == "compact", 0.03).otherwise(0.05)
    same = F.regexp_replace(F.lower(original), "[^0-9a-f-]", "") == normalized
    confidence = confidence + F.when(same, 0.05).otherwise(0.0) - F.when(F.abs(F.length(original) - F.length(normalized)) > 5, 0.1).otherwise(0.0)
    return F.when(
        c.isNotNull(),
        F.struct(
            F.when(valid, normalized).otherwise(text).alias("normalized"),
            F.when(valid, F.greatest(F.lit(0.1), F.least(F.lit(1.0), confidence))).otherwise(0.0).alias("confidence"),
            kind.alias("format"),
            F.when(valid & version.between(1, 5), version).alias("version"),
            F.when(valid, variant).alias("variant"),
            valid.alias("is_valid"),
        ),
    )


def uuid_compact(c: Column) -> Column:
    p = uuid_parts(c)
    return F.when(p["is_valid"], F.regexp_replace(p["normalized"], "-", ""))


def uuid_urn(c: Column) -> Column:
    p = uuid_parts(c)
    return F.when(p["is_valid"], F.concat(F.lit("urn:uuid:"), p["normalized"]))


def uuid_variations(c: Column) -> Column:
    """Standard, compact, upper-case and URN spellings, sorted; empty if invalid."""
    p = uuid_parts(c)
    n = p["normalized"]
    compact = F.regexp_replace(n, "-", "")
    made = F.array(n, compact, F.upper(n), F.upper(compact), F.concat(F.lit("urn:uuid:"), n))
    return F.when(p["is_valid"], F.array_sort(made)).otherwise(F.array().cast("array<string>"))


FIELDS = {"email": email, "phone": phone, "name": person, "address": postal, "uuid": uuid_parts}


def normalize_field(c: Column, kind: str) -> Column:
    """The struct of the normalizer for a kind of field."""
    return FIELDS[kind](c)
