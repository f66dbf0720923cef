import pytest

from cloakframe.functions import validators as v

# check, valid, invalid
CASES = [
    ("luhn", "79927398713", "79927398714"),
    ("card", "4532015112830366", "4532015112830367"),
    ("email", "a.b@c.de", "a..b@c.de"),
    ("phone", "+33 6 12 34 56 78", "9876543210"),
    ("ipv4", "1.2.3.4", "1.2.3.400"),
    ("ipv6", "2001:db8::1", "2001:db8::1::2"),
    ("url", "www.a.fr/x", "jean.dupont"),
    ("date", "2024-12-31", "1.2.3"),
    ("wallet", "0x" + "a" * 40, "0x" + "g" * 40),
    ("iban_plausible", "FR7630006000011234567890189", "FR76300060000112345678901"),
    ("iban_mod97", "FR7630006000011234567890189", "FR7630006000011234567890188"),
    ("bic", "BNPAFRPP", "BNPAZZPP"),
    ("vat_fr", "FR40303265045", "FR41303265045"),
    ("siren", "732829320", "732829321"),
    ("siret", "73282932000074", "73282932000075"),
    ("nir", "255081416802538", "255081416802539"),
    ("fr_passport", "AB1234567", "AB1111111"),
    ("fr_licence", "12AB345678CD90", "96AB345678CD90"),
    ("steuer_id", "86095742719", "86095742718"),
    ("reisepass", "C01234567", "A01234567"),
    ("codice_fiscale", "RSSMRA85T10A562S", "RSSMRA85T10A562T"),
    ("cie", "CA12345AA", "CA1234AA"),
    ("partita_iva", "12345678903", "12345678904"),
    ("dni", "12345678Z", "12345678A"),
    ("nie", "X1234567L", "X1234567A"),
    ("pesel", "44051401359", "44051401358"),
    ("nip", "1234563218", "1234563219"),
    ("nif_pt", "123456789", "123456788"),
    ("be_number", "85073003328", "85073003329"),
]


def test_vectors(spark):
    rows = spark.createDataFrame(CASES, "name string, good string, bad string")
    cases = " ".join(f"when name = '{n}' then struct({v.CHECKS[n]('good')}, {v.CHECKS[n]('bad')})" for n, _, _ in CASES)
    found = {r["name"]: tuple(r["r"]) for r in rows.selectExpr("name", f"case {cases} end as r").collect()}
    assert found == {n: (True, False) for n, _, _ in CASES}


@pytest.mark.parametrize("name", ["email", "  iban "])
def test_entity_types(name):
    from cloakframe.schema import parse_entity_type

    assert parse_entity_type(name) == name.strip().upper()
    assert parse_entity_type("custom:x") == "CUSTOM:X"
    for bad in ("nothing", "CUSTOM:", ""):
        with pytest.raises(ValueError):
            parse_entity_type(bad)
