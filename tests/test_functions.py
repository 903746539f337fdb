import pytest
from pyspark.sql import functions as F

from concordia.functions import entities, keys
from concordia.functions import similarity as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [
        ("email", " John.Doe @GMAIL.com ", "john.doe@gmail.com"),
        ("phone", "+1-555-123-4567", "15551234567"),
        ("name", "  O'Brien,  Ann ", "obrien ann"),
        ("address", "12 Main St., Apt 4", "12 main apt 4"),
        ("numeric", "12.5abc", "12.50"),
        ("numeric", "abc", "0"),
        ("date", "12/31/2023", "2023-12-31"),
        ("date", "2023-13-45", ""),
        ("categorical", " Red ", "red"),
        ("default", " A   b ", "a b"),
        ("unknown", " A ", "a"),
    ],
)
def test_keys(spark, kind, value, want):
    assert one(spark, keys.normalize(F.col("v"), kind), v=value) == want


@pytest.mark.parametrize(
    ("value", "want", "valid"),
    [
        ("5551234567", "+15551234567", True),
        ("+1-555-123-4567", "+15551234567", True),
        ("+44 20 7123 4567", "+442071234567", True),
        ("+49 30 12345678", "+493012345678", True),
        ("+81 3 1234 5678", "+81312345678", True),
        ("+91 98765 43210", "+919876543210", True),
        ("123", "123", False),
        ("555-CALL-NOW", "555-CALL-NOW", False),
    ],
)
def test_phone(spark, value, want, valid):
    p = one(spark, entities.phone(F.col("v")), v=value)
    assert (p.normalized, p.is_valid) == (want, valid)


def test_phone_confidence_and_formats(spark):
    assert one(spark, entities.phone(F.col("v")), v="+1-555-123-4567").confidence == pytest.approx(0.95)
    assert one(spark, entities.phone_national(F.col("v")), v="5551234567") == "(555) 123-4567"
    assert one(spark, entities.phone_international(F.col("v")), v="+44 20 7123 4567") == "+44 2071234567"
    assert one(spark, entities.phone_international(F.col("v")), v="123") is None


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("john.doe@gmail.com", "johndoe@gmail.com"),
        ("john+newsletter@example.com", "john@example.com"),
        ("John.Doe+x@GMAIL.com", "JohnDoe@gmail.com"),
        ("invalid-email", "invalid-email"),
        ("user@@example.com", "user@@example.com"),
    ],
)
def test_email(spark, value, want):
    e = one(spark, entities.email(F.col("v")), v=value)
    assert e.normalized == want
    assert (e.confidence == 0) == ("@@" in value or "@" not in value)


def test_email_variations(spark):
    got = one(spark, entities.email_variations(F.col("v")), v="J.Doe+a@gmail.com")
    assert "JDoe@gmail.com" in got
    assert "j.doe+a@gmail.com" in got


def test_person(spark):
    p = one(spark, entities.person(F.col("v")), v="dr. john smith jr")
    assert p.normalized == "Dr. John Smith Jr."
    assert (p.prefix, p.first_name, p.last_name, p.suffix) == ("Dr.", "John", "Smith", "Jr.")
    assert one(spark, entities.person(F.col("v")), v="o'brien smith-jones").normalized == "O'Brien Smith-Jones"
    assert one(spark, entities.person(F.col("v")), v="  ").confidence == 0
    assert one(spark, entities.person(F.col("v")), v=None) is None
    assert "Smith, John" in one(spark, entities.person_variations(F.col("v")), v="john q smith")
    assert one(spark, entities.last_first(F.col("v")), v="john q smith") == "Smith, John Q."
    assert one(spark, entities.display_name(F.col("v")), v="dr john q smith") == "John Smith"


def test_postal(spark):
    p = one(spark, entities.postal(F.col("v")), v="123 n main st apt 4b, springfield, CA 90210-1234")
    assert (p.street_number, p.city, p.state, p.postal_code) == ("123", "Springfield", "California", "90210-1234")
    assert p.unit == "Apt 4b" or p.unit == "Apt 4B"
    q = one(spark, entities.postal(F.col("v")), v="10 Oak Avenue")
    assert q.normalized == "10 Oak Avenue"
    assert q.confidence == 1.0
    assert one(spark, entities.postal_short(F.col("v")), v="10 Oak Avenue, Boston, MA") == "10 Oak Ave, Boston, MA"
    assert "10 Oak Ave, Boston" in one(spark, entities.postal_variations(F.col("v")), v="10 Oak Avenue, Boston, MA")


@pytest.mark.parametrize(
    ("value", "house", "zip_code"),
    [
        ("10000 main st, springfield, CA 90210", "10000", "90210"),
        ("90210 main st, springfield, CA 90210", "90210", "90210"),
        ("190210 main st, springfield, CA 90210", "190210", "90210"),
        ("10000 main st, springfield, CA", "10000", None),
        ("7 main st, springfield, 90210 CA", "7", "90210"),
    ],
)
def test_postal_house_numbers_of_five_digits(spark, value, house, zip_code):
    p = one(spark, entities.postal(F.col("v")), v=value)
    assert (p.street_number, p.street_name, p.street_type, p.city, p.state, p.postal_code) == (house, "Main", "Street", "Springfield", "California", zip_code)


def test_postal_zip_alone(spark):
    assert one(spark, entities.postal(F.col("v")), v="90210").postal_code == "90210"


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        ("550E8400-E29B-41D4-A716-446655440000", "standard"),
        ("550e8400e29b41d4a716446655440000", "compact"),
        ("urn:uuid:550e8400-e29b-41d4-a716-446655440000", "urn"),
        ("{550e8400-e29b-41d4-a716-446655440000}", "standard"),
        ("nope", "invalid"),
    ],
)
def test_uuid(spark, value, kind):
    u = one(spark, entities.uuid_parts(F.col("v")), v=value)
    assert u.format == kind
    if kind != "invalid":
        assert u.normalized == "550e8400-e29b-41d4-a716-446655440000"
        assert (u.version, u.variant) == (4, "RFC4122")
    assert len(one(spark, entities.uuid_variations(F.col("v")), v=value)) == (0 if kind == "invalid" else 5)


def test_edit_distances(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, S.edit_similarity(a, b), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, S.edit_similarity(a, b), a="", b="") == 1.0
    assert one(spark, S.weighted_distance(a, b, 1, 1, 1), a="kitten", b="sitting") == 3
    assert one(spark, S.weighted_distance(a, b, 1, 1, 5), a="ab", b="ac") == 2
    ops = one(spark, S.edit_script(a, b), a="cat", b="cart")
    assert [o.op for o in ops] == ["match", "match", "insert", "match"]


def test_script_rebuilds():
    for x, y in (("kitten", "sitting"), ("", "abc"), ("abc", ""), ("flaw", "lawn")):
        made, i = "", 0
        for o in S.script(x, y):
            if o["op"] in ("match", "substitute", "insert"):
                made += o["char"]
            i += o["op"] != "insert"
        assert made == y
        assert i == len(x)


def test_jaro_winkler(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, S.jaro_winkler(a, b), a="MARTHA", b="MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert one(spark, S.jaro_winkler(a, b), a="abcdef", b="abzzzz") == pytest.approx(0.644444, abs=1e-6)
    assert one(spark, S.jaro_winkler(a, b), a="hello", b="") == 0


@pytest.mark.parametrize(("word", "code"), [("Tymczak", "T522"), ("Pfister", "P236"), ("Ashcraft", "A261"), ("O'Brien", "O165"), ("", "0000")])
def test_soundex(spark, word, code):
    assert one(spark, S.soundex(F.col("v")), v=word) == code


@pytest.mark.parametrize(
    ("word", "code"),
    [("Knight", "NT"), ("Thomas", "0MS"), ("Phone", "FN"), ("Xavier", "SFR"), ("lamb", "LM"), ("Schmidt", "SXMT"), ("", "")],
)
def test_metaphone(word, code):
    assert S.metaphone_of(word) == code


@pytest.mark.parametrize(("word", "code"), [("Macdonald", "MCDNLD"[:6]), ("Knuth", "NTH"), ("Phillip", "FLP"), ("", "")])
def test_nysiis_is_short_and_stable(word, code):
    got = S.nysiis_of(word)
    assert len(got) <= 6
    assert got == S.nysiis_of(word.lower())
    assert bool(got) == bool(code)


@pytest.mark.parametrize(
    ("a", "b", "low", "high"),
    [
        ("John Smith", "Jon Smyth", 0.7, 1), ("Microsoft Corporation", "Microsoft Corp", 0.7, 1), ("New York", "NY", 0.3, 1), ("color", "colour", 0.8, 1),
        ("hello", "", 0, 0.01), ("abc", "xyz", 0, 0.5), ("same", "same", 1, 1),
    ],
)
def test_mixed(spark, a, b, low, high):
    assert low <= one(spark, S.mixed(F.col("a"), F.col("b")), a=a, b=b).similarity <= high


def test_tokens(spark):
    assert set(one(spark, S.tokens(F.col("v")), v="customerId_name")) == {"customer", "cus", "id", "name", "nam"}
