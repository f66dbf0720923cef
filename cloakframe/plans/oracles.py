"""DuckDB SQL that gives what the recognizers give, rule by rule, over texts that hold every type of entity."""

from __future__ import annotations

import re

from ..functions import numbering
from ..functions import validators as v
from ..operators import recognizers as r

# Every seeded document ends in one of these: numbers with right and wrong check digits, near misses, words around them.
SAMPLES = (
    "please contact jean.dupont@mail-site.fr or .bad@mail.fr, a..b@c.fr, noreply@corp.io today",
    "write to a@example.com, bob+tag@domain.org and x_y@sub.host.co.uk. Fake: user@localhost",
    "tel +33 6 12 34 56 78 or call (415) 555-2671, 06 12 34 56 78, mobile 07 ** ** 45 91, 9876543210",
    "rufnummer 030/1234 5678, +49 30 901820, version 0123 45, +999 12, +39 06 6982 now",
    "card 4532 0151 1283 0366, amex 378282246310005, test 4532015112830367 and 5555-5555-5555-4444",
    "Visa **** **** **** 4832 and mastercard •••• •••• •••• 1111, but visa ** 12",
    "host 192.168.10.1, version 1.2.3.4, 999.1.1.1, 10.0.0.256, gateway 8.8.8.8.",
    "server 2001:0db8:85a3:0000:0000:8a2e:0370:7334, ping ::1 and fe80::1%eth0, [2001:db8::2]:80, 12:34",
    "see https://site.fr/a?b=1, www.acme.io/x, docs.acme.co/help, firma.unbekannt, http://test.com/z, localhost",
    "due 2024-12-31, born 31/12/1980, 05/06/24, at 2024-01-05T10:20:30Z, 2024-13-01, 45/99/2024, v. 1.10.2020",
    "wallet 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa, bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq, 0x52908400098527886e0f7030069857d2e4169ee7",
    "adresse: 12 bis rue de la Paix, 75002 Paris and 221B Baker Street, NW1 6XE London",
    "Anschrift\n10 Unter den Linden\n10117 Berlin\nEnde",
    "IBAN FR76 3000 6000 0112 3456 7890 189, DE89370400440532013000, compte FR76 3000 6000 0112 3456 7890 188, XX12345678901234567",
    "bankgiro SE4550000000058398257466; fake-iban GB82 WEST 1234 5698 7654 32",
    "BIC BNPAFRPP or SWIFT code DEUTDEFF500, testbank CHASUS33, ABCDZZ22",
    "VAT FR40303265045, TVA FR41303265045, USt-IdNr DE123456789, NIF-IVA ESX1234567L, btw NL123456789B01, example vat IT12345678901",
    "carte bancaire 4973 0000 0000 0007, maestro 5100000000000008, fake 4035300539804083, 6703000000000000003",
    "SIREN 732 829 320 and siren: 732829321, n° siren 404833048; company number",
    "SIRET 732 829 320 00074, siret de la société: 40483304800022, 73282932000074, 12345678901234, SIRET foo 73282932000074",
    "NIR 1 85 07 60 050 101 76, numéro de sécurité sociale serait 185076005010199, insee 185076005010199, 185076005010176",
    "plaque FR AB-123-CD, AB-123-CD, FR SU-123-AA, DE B MW 1234, IT AB 123 CD, ES 1234 BCD, NL 12-AB-34, BE 1-ABC-234",
    "matrícula PT AB-12-34, PL WA 12345, AT W AB 123, SE ABC 12D, GB AB12 CDE, IRL 12-D-12345, DK AB 12345, FIN ABC-123",
    "Kennzeichen GR ABC-1234, CZ 1A2 3456, RO B 123 ABC, HU ABC-123, SK AB123CD, HR ZG 1234 AB, SLO LJ 12 AB, EST 123 AB4, LV AB-1234, LT ABC 123, CY ABC 123, LU AB1234, MT ABC123",
    "téléphone +33 1 42 68 53 00, +44 20 7946 0958, Handy +49 (30) 901820, 555- +31 20 794 0000 1, 1+32 2 555 12 12",
    "carte vitale 1234567897, numéro vitale: 1234567890, EHIC # FR1234567890AB, MRN AB12-34, dossier patient X9Y8Z7, patient id 12",
    "données sensibles: racial or ethnic origin, political opinions, religious or philosophical beliefs, biometric data",
    "article 9: sexual orientation; trade union membership; opinión política; template biométrique; test dummy origine ethnique",
    "Femme, née le 12/03/1980, 75011 Paris; and then nothing more of the kind",
    "SW1A 2AA, born 1975, sex: M. And far away from it all: 00-950",
    "an engineer who works for years at Acme & Sons in Berlin; a teacher at X",
    "CNI 123456789015, carte d'identité: 123456789012, 123456789015 identité, passeport 12AB34567 AB1234567, passport AA1111111",
    "permis de conduire 12AB123456CD78, permis 97AB123456CD78, 99AB123456CD78 permis, passport XY7654321",
    "Steuer-ID 86095742719, Steueridentifikationsnummer 86095742718, 86095742719 tax, Ausweis T220001293, Personalausweis: L01X00T47",
    "Reisepass C01234567, Pass B01234567, SV-Nummer 123456789012A345, Sozialversicherungsnummer 650701234567B003, Rentenversicherung 151507491234C100",
    "codice fiscale RSSMRA85T10A562S, CF RSSMRA85T10A562A, CIE CA00000AA, Partita IVA 12345678903, P.IVA 12345678901, 00743110157 P IVA",
    "DNI 12345678Z, NIF: 12345678A, NIE X1234567L, 00000001R DNI, NAF 281234567840, seguridad social 281234567841",
    "BSN 111222333, BSN 123456789, BSN 111111110, 123456782 Burgerservicenummer, identiteitsnummer",
    "rijksregisternummer 85073003328, NN 85073003384, numéro national: 93051822361, 85073003328 national",
    "PESEL 44051401359, PESEL 44051401358, NIP 5260001246, 1234563218 NIP, NIP 1234567890 example",
    "NIF 123456789, NIF 123456780, número de identificação fiscal 503504564, Cartão de Cidadão 501964843, CC 501964844",
    "nothing of the kind stands here, but some words",
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SEEDED = f"(SELECT doc_id, lang, coalesce(text, '') || chr(10) || ([{', '.join(map(q, SAMPLES))}])[doc_id % {len(SAMPLES)} + 1] AS text FROM documents)"


def span_sql(pattern: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """(key, start, m, before, after) of all matches, with 60 characters on each side."""
    p = q(pattern)
    return f"""(SELECT {key}, start, m, substring(t, greatest(start - 60, 0) + 1, least(start, 60)) AS before, substring(t, start + length(m) + 1, 60) AS after FROM
      (SELECT {key}, t, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INTEGER AS start, m[k] AS m
    FROM (SELECT {key}, t, m, g, unnest(range(1, len(m) + 1)) AS k FROM (SELECT {key}, {text} AS t, regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS g FROM {source}) WHERE len(m) > 0)))"""


def plain(pattern: str) -> str:
    """A pattern without what DuckDB's engine lacks: possessive marks, guards, and the Unicode flag, which is always on."""
    out = re.sub(r"\(\?<?[!=](?:[^()\[\]]|\[[^\]]*\])*\)", "", pattern)
    return re.sub(r"(?<=[^\\])([+*?}])\+", r"\1", out.replace("(?iu)", "(?i)"))


# Parts of checks, as SQL.
def digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '', 'g')"


def at(s: str, k: int) -> str:
    return f"coalesce(try_cast(substring({s}, {k}, 1) AS INTEGER), 0)"


def weighted(s: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * {at(s, k)}" for k, w in enumerate(weights, 1)) + ")"


def luhn(d: str) -> str:
    return f"""(length({d}) >= 2 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN try_cast(substring({d}, length({d}) - i + 1, 1) AS INT)
      ELSE (2 * try_cast(substring({d}, length({d}) - i + 1, 1) AS INT)) // 10 + (2 * try_cast(substring({d}, length({d}) - i + 1, 1) AS INT)) % 10 END)) % 10 = 0)"""


def key97(s: str, body: int) -> str:
    d = digits(s)
    return f"(length({d}) = {body + 2} AND try_cast(substring({d}, {body + 1}) AS INT) = 97 - try_cast(left({d}, {body}) AS BIGINT) % 97)"


def cross(x: str) -> str:
    return f"(({x}) // 10 + ({x}) % 10)"


def letter(s: str, k: int) -> str:
    return f"(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substring({s}, {k}, 1)) - 1)"


NETWORK = "(4[0-9]{12}|4[0-9]{15}|4[0-9]{18}|5[1-5][0-9]{14}|3[47][0-9]{13}|6[0-9]{15}|6[0-9]{18}|(222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12})"


def _eu_card(s: str) -> str:
    d = digits(s)
    p4, p6 = f"try_cast(left({d}, 4) AS INT)", f"try_cast(left({d}, 6) AS INT)"
    return f"""(length({d}) BETWEEN 13 AND 19 AND {luhn(d)} AND CASE WHEN {p4} IN (4870, 4871, 6703) THEN true
      WHEN {d} LIKE '4%' THEN {p6} BETWEEN 416500 AND 416599 OR {p6} BETWEEN 497300 AND 497999 OR {p6} BETWEEN 450800 AND 450899 OR {p4} IN (4035, 4165, 4177, 4508)
      WHEN left({d}, 1) IN ('2', '5') THEN {p4} BETWEEN 2221 AND 2720 OR {p4} BETWEEN 5000 AND 5599 ELSE left({d}, 2) IN ('34', '37') AND length({d}) = 15 END)"""


def _email(s: str) -> str:
    local, host = f"split_part({s}, '@', 1)", f"split_part({s}, '@', 2)"
    return f"""(length({s}) <= 254 AND length({local}) BETWEEN 1 AND 64 AND length({host}) BETWEEN 4 AND 253 AND NOT contains({s}, '..') AND NOT {local} LIKE '.%' AND NOT {local} LIKE '%.'
      AND regexp_full_match({s}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*') AND regexp_matches({s}, '\\.[A-Za-z]{{2,}}$'))"""


def _phone(s: str) -> str:
    n = f"length({digits(s)})"
    return f"""CASE WHEN regexp_matches({s}, '[*•]') AND regexp_matches({s}, '^\\s*0[67]') THEN {n} BETWEEN 6 AND 10 WHEN contains({s}, '+') THEN {n} BETWEEN 8 AND 15
      WHEN {n} = 10 AND NOT regexp_matches({s}, '^\\s*0') AND NOT regexp_matches({s}, '[().\\-/]|[0-9]\\s[0-9]') THEN false ELSE {n} BETWEEN 8 AND 14 END"""


def _ipv6(s: str) -> str:
    x = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({s}), '^\\[', ''), '\\](:[0-9]+)?$', ''), '%.*$', ''), '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$', '0:0')"
    n, gaps = f"len(regexp_extract_all({x}, '[0-9A-Fa-f]+'))", f"len(regexp_extract_all({x}, '::'))"
    return f"(regexp_full_match({x}, '[0-9A-Fa-f:]+') AND NOT regexp_matches({x}, '[0-9A-Fa-f]{{5}}|:::|^:[^:]|[^:]:$') AND (({gaps} = 0 AND {n} = 8) OR ({gaps} = 1 AND {n} <= 7)))"


def _url(s: str) -> str:
    host = f"lower(split_part({s}, '/', 1))"
    last = f"split_part({host}, '.', -1)"
    return f"""(length({s}) >= 4 AND CASE WHEN regexp_matches(lower({s}), '^https?://') THEN contains({s}, '.') OR contains(lower({s}), 'localhost') WHEN lower({s}) LIKE 'www.%' THEN true
      ELSE contains({s}, '.') AND (len(string_split({host}, '.')) <> 2 OR {last} IN ({', '.join(map(q, v.HOST_TLDS))})) AND regexp_full_match({last}, '[a-z]{{2,}}') END)"""


def _date(s: str) -> str:
    p = [f"try_cast(string_split_regex({s}, '[/.-]')[{k}] AS INT)" for k in (1, 2, 3)]
    return f"""CASE WHEN regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(substring({s}, 6, 2) AS INT) BETWEEN 1 AND 12 AND try_cast(substring({s}, 9, 2) AS INT) BETWEEN 1 AND 31
      ELSE NOT ({p[0]} < 13 AND {p[1]} < 13 AND {p[2]} < 100) AND {p[0]} >= 1 AND {p[1]} >= 1 END"""


def _wallet(s: str) -> str:
    return f"(regexp_full_match({s}, '[13][1-9A-HJ-NP-Za-km-z]{{25,34}}') OR regexp_full_match(lower({s}), 'bc1p?[qpzry9x8gf2tvdw0s3jn54khce6mua7l]{{1,87}}') OR regexp_full_match({s}, '0[xX][0-9A-Fa-f]{{40}}'))"


def _iban(s: str) -> str:
    u = f"upper(regexp_replace({s}, '[^A-Za-z0-9]', '', 'g'))"
    whole = f"(substring({u}, 5) || left({u}, 4))"
    numbers = f"array_to_string(list_transform(string_split({whole}, ''), lambda c: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)::VARCHAR), '')"
    return f"(list_reduce(list_transform(string_split({numbers}, ''), lambda c: try_cast(c AS INT)), lambda a, c: (a * 10 + c) % 97) = 1)"


def _steuer(s: str) -> str:
    d, p = digits(s), "10"
    for k in range(1, 11):
        p = f"((({at(d, k)} + {p} + 9) % 10 + 1) * 2 % 11)"
    return f"(length({d}) = 11 AND NOT {d} LIKE '0%' AND (11 - {p}) % 10 = {at(d, 11)})"


def _ausweis(s: str) -> str:
    u = f"upper({s})"
    total = " + ".join(f"{cross(f'{letter(u, k)} // 10 * {w}')} + {cross(f'{letter(u, k)} % 10 * {w}')}" for k, w in enumerate([7, 3, 1, 7, 3, 1, 7, 3], 1))
    return f"(regexp_full_match({u}, '[A-Z0-9]{{8}}[0-9]') AND (10 - ({total}) % 10) % 10 = {at(u, 9)})"


def _sv(s: str) -> str:
    total = " + ".join(cross(f"{w} * {at(digits(s), k)}") for k, w in enumerate([2, 1, 2, 5, 7, 1, 2, 1, 2, 5, 7, 1, 2, 1, 2], 1))
    return f"(regexp_full_match(upper({s}), '[0-9]{{12}}[A-RT-Y][0-9]{{3}}') AND ({total}) % 10 = 0)"


def _fiscale(s: str) -> str:
    u = f"upper({s})"
    even = lambda k: f"(CASE WHEN {letter(u, k)} < 10 THEN {letter(u, k)} ELSE {letter(u, k)} - 10 END)"
    total = " + ".join(f"({v.CF_ODD})[{letter(u, k)} + 1]" if k % 2 else even(k) for k in range(1, 16))
    return f"(regexp_full_match({u}, '[A-Z0-9]{{16}}') AND substring({u}, 16, 1) = chr((65 + ({total}) % 26)::INT))"


def _iva(s: str) -> str:
    d = digits(s)
    total = " + ".join(cross(f"{1 + k % 2} * {at(d, k + 1)}") for k in range(10))
    return f"(length({d}) = 11 AND (10 - ({total}) % 10) % 10 = {at(d, 11)})"


def _dni(s: str) -> str:
    return f"(regexp_full_match(upper({s}), '[0-9]{{8}}[A-Z]') AND right(upper({s}), 1) = substring('{v.DNI_LETTERS}', (try_cast(left({s}, 8) AS INT) % 23 + 1)::INT, 1))"


def _bsn(s: str) -> str:
    d = digits(s)
    return f"(length({d}) = 9 AND {d} NOT IN ({', '.join(q(str(k) * 9) for k in range(10))}, '012345678', '123456789', '987654321', '876543210') AND {weighted(d, list(range(9, 0, -1)))} % 11 = 0)"


def _nif(s: str) -> str:
    d = digits(s)
    rest = f"{weighted(d, list(range(9, 1, -1)))} % 11"
    return f"(length({d}) = 9 AND (CASE WHEN {rest} < 2 THEN 0 ELSE 11 - {rest} END) = {at(d, 9)})"


def _hedged(s: str) -> str:
    d = digits(s)
    month = f"try_cast(substring({d}, 4, 2) AS INT)"
    shape = f"(length({d}) = 15 AND left({d}, 1) IN ('1', '2') AND ({month} BETWEEN 1 AND 12 OR {month} >= 20) AND substring({d}, 6, 2) <> '00')"
    return f"(CASE WHEN regexp_matches(lower({s}), '\\b(serait|seraient|possible|probable|probablement|environ|approximativement|aurait|auraient|supposé|non[\\s-]+confirmé|non[\\s-]+vérifié|invérifiable)\\b') THEN {shape} ELSE {key97(s, 13)} END)"


#: Rows of the numbering plans, for SQL that looks up the longest prefix.
PLAN_VALUES = ", ".join(str(x) for x in numbering.plan_rows())


def _eu_phone(s: str) -> str:
    d = digits(f"regexp_replace({s}, '[(]0[)]', '', 'g')")
    codes = " ".join(f"WHEN '{k}' THEN {len(str(c))}" for k, c in numbering.CALLING.items())
    return f"coalesce((SELECT arg_max(length({d}) - CASE region {codes} END BETWEEN least AND most, length(prefix)) FROM (VALUES {PLAN_VALUES}) p(prefix, region, kind, least, most) WHERE starts_with({d}, prefix)), false)"


CHECKS = {
    numbering.valid: _eu_phone,
    v.always: lambda s: "true",
    v.email: _email,
    v.phone: _phone,
    v.card: lambda s: f"(regexp_full_match({digits(s)}, {q(NETWORK)}) AND {luhn(digits(s))})",
    v.eu_card: _eu_card,
    v.ipv6: _ipv6,
    v.url: _url,
    v.date: _date,
    v.wallet: _wallet,
    v.iban_mod97: _iban,
    v.vat_fr: lambda s: f"(substring({s}, 3, 2) = lpad(((12 + 3 * (try_cast(substring({s}, 5, 9) AS BIGINT) % 97)) % 97)::VARCHAR, 2, '0'))",
    v.siren: lambda s: f"(length({digits(s)}) = 9 AND {digits(s)} <> '000000000' AND {luhn(digits(s))})",
    v.siret: lambda s: f"(length({digits(s)}) = 14 AND {luhn(digits(s))})",
    v.nir: lambda s: key97(s, 13),
    v.nir_or_hedged: _hedged,
    v.cni12: lambda s: f"(length({digits(s)}) = 12 AND {weighted(digits(s), list(range(1, 12)))} % 10 = {at(digits(s), 12)})",
    v.fr_passport: lambda s: f"(regexp_full_match(upper({s}), '[A-Z]{{2}}[0-9]{{7}}') AND substring({s}, 3) <> repeat(substring({s}, 3, 1), 7))",
    v.fr_licence: lambda s: f"(regexp_full_match(upper({s}), '[0-9]{{2}}[A-Z]{{2}}[0-9]{{6}}[A-Z]{{2}}[0-9]{{2}}') AND (try_cast(left({s}, 2) AS INT) BETWEEN 1 AND 95 OR left({s}, 2) = '99'))",
    v.steuer_id: _steuer,
    v.personalausweis: _ausweis,
    v.reisepass: lambda s: f"regexp_full_match(upper({s}), '[CFGHJKLMNPRTVWXYZ][0-9]{{8}}')",
    v.sozialversicherung: _sv,
    v.codice_fiscale: _fiscale,
    v.cie: lambda s: f"regexp_full_match(upper({s}), '[A-Z]{{2}}[0-9]{{5}}[A-Z]{{2}}')",
    v.partita_iva: _iva,
    v.dni: _dni,
    v.nie: lambda s: f"(regexp_full_match(upper({s}), '[XYZ][0-9]{{7}}[A-Z]') AND {_dni(f'(translate(upper(left({s}, 1)), {chr(39)}XYZ{chr(39)}, {chr(39)}012{chr(39)}) || substring({s}, 2))')})",
    v.naf: lambda s: key97(s, 10),
    v.bsn: _bsn,
    v.be_number: lambda s: key97(s, 9),
    v.pesel: lambda s: f"(length({digits(s)}) = 11 AND (10 - {weighted(digits(s), [1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = {at(digits(s), 11)})",
    v.nip: lambda s: f"(length({digits(s)}) = 10 AND {weighted(digits(s), [6, 5, 7, 2, 3, 4, 5, 6, 7])} % 11 = {at(digits(s), 10)})",
    v.nif_pt: _nif,
    v.vitale: lambda s: f"(length({digits(s)}) = 10 AND {luhn(digits(s))})",
}

#: What the guards of patterns ask of the signs beside a match.
GUARDS = {
    "bic_swift": "NOT regexp_matches(before, '[\\pL\\pN_]$') AND NOT regexp_matches(after, '^[\\pL\\pN_]')",
    "email_rfc5322_like": "NOT regexp_matches(before, '[A-Za-z0-9._%+-]$') AND NOT regexp_matches(after, '^\\.\\s*($|[^A-Za-z0-9\\s])')",
    "ipv6": "(m LIKE '[%' OR NOT regexp_matches(before, '[0-9A-Fa-f:.]$') AND NOT regexp_matches(after, '^[0-9A-Fa-f:]'))",
    "eu_phone_phonenumber": "NOT regexp_matches(before, '[0-9+]$') AND NOT regexp_matches(after, '^[0-9]')",
}


def any_of(items: tuple[str, ...]) -> str:
    return q("|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in sorted(items, key=len, reverse=True)))


def score_sql(rule: r.Rule, ok: str) -> str:
    near = "lower(before || m || after)"
    base = f"{rule.base}" if rule.low is None else f"(CASE WHEN {ok} THEN {rule.base} ELSE {rule.low} END)"
    boost = f"CASE WHEN regexp_matches({near}, {any_of(rule.words)}) THEN {rule.boost} ELSE 0 END" if rule.words else "0"
    score = f"(least({base} + {boost}, 1)"
    score += f" - {rule.penalty} * len(regexp_extract_all({near}, {any_of(rule.against)})))" if rule.against and rule.penalty else ")"
    if rule.invalidate:
        score = f"greatest({score} - 0.15 * len(regexp_extract_all({near}, {any_of(rule.invalidate)})), {rule.least})"
    if rule.floor:
        score = f"greatest({score}, {rule.least})"
    return f"round(({score})::DOUBLE, 6)"


def iban_spans(source: str) -> str:
    sizes = "MAP {" + ", ".join(f"{q(k)}: {n}" for k, n in v.IBAN_LENGTH.items()) + "}"
    run = span_sql(r"(?i)\b[a-z]{2}[0-9]{2}(?:[\s.-]*[a-z0-9]){11,35}", source)
    # The first n letters or digits and what stands between them.
    taken = "regexp_extract(m, '(?i)^(?:[\\s.-]*[a-z0-9]){' || n || '}')"
    return f"""(SELECT doc_id, start, t AS m, before, left(substring(m, length(t) + 1) || after, 60) AS after FROM (SELECT *, {taken} AS t FROM
      (SELECT *, ({sizes})[upper(left(m, 2))] AS n FROM {run}) WHERE n IS NOT NULL) WHERE t <> '')"""


def quasi_spans(source: str) -> str:
    w = r.QUASI_WINDOW
    place = lambda p, n: f"length(string_split_regex(w, {q(plain(p))})[1]) AS {n}, length(regexp_extract(w, {q(plain(p))})) AS {n}n"
    hulls = f"""SELECT doc_id, least(start, lo + d, lo + g) AS a, greatest(start + length(m), lo + d + dn, lo + g + gn) AS b FROM (SELECT *, {place(r.QUASI_DATE, 'd')}, {place(r.QUASI_GENDER, 'g')} FROM
      (SELECT s.doc_id, start, m, greatest(start - {w}, 0) AS lo, substring(text, greatest(start - {w}, 0) + 1, start + length(m) + {w} - greatest(start - {w}, 0)) AS w FROM {span_sql(plain(r.QUASI_POSTAL), source)} s JOIN {source} USING (doc_id))) WHERE dn > 0 AND gn > 0"""
    hulls += f" UNION ALL SELECT doc_id, start, start + length(m) FROM {span_sql(plain(r.PROFESSION), source)}"
    # Of overlapping ones the first in order, then the next behind it, and so on.
    return f"""(WITH RECURSIVE hulls AS MATERIALIZED (SELECT doc_id, a::INTEGER AS a, b::INTEGER AS b FROM ({hulls})), kept AS (
        SELECT doc_id, min(a) AS a, arg_min(b, a::BIGINT * 1000000 + b) AS b FROM hulls GROUP BY doc_id
        UNION ALL SELECT doc_id, first.a, first.b FROM (SELECT k.doc_id, min(struct_pack(a := h.a, b := h.b)) AS first FROM kept k JOIN hulls h ON h.doc_id = k.doc_id AND h.a >= k.b GROUP BY k.doc_id))
      SELECT k.doc_id, a AS start, substring(text, a + 1, b - a) AS m, substring(text, greatest(a - 60, 0) + 1, least(a, 60)) AS before, substring(text, b + 1, 60) AS after FROM kept k JOIN {source} USING (doc_id))"""


def rule_sql(rule: r.Rule, source: str = SEEDED) -> str:
    """(doc_id, start, end, entity_type, text, score, recognizer) of one rule."""
    if rule.find is r.quasi_spans:
        found = quasi_spans(source)
    elif rule.find:
        found = iban_spans(source)
    else:
        found = span_sql(plain(rule.pattern), source)
    if rule.group == "value":
        tail = f"regexp_extract(m, {q('(?i)' + rule.value + '$')})"
        head = f"regexp_extract(m, {q('(?i)' + rule.value)})"
        found = f"""(SELECT doc_id, (start + o)::INTEGER AS start, x AS m, right(before || left(m, o), 60) AS before, left(substring(m, o + length(x) + 1) || after, 60) AS after FROM
          (SELECT *, CASE WHEN {tail} <> '' THEN {tail} ELSE {head} END AS x, CASE WHEN {tail} <> '' THEN length(m) - length({tail}) ELSE 0 END AS o FROM {found}))"""
    ok = CHECKS[rule.check]("m")
    where = [ok] if rule.low is None else []
    where += [GUARDS[rule.name]] if rule.name in GUARDS else []
    where += [f"NOT regexp_matches(lower(m), {any_of(rule.deny)})"] if rule.deny else []
    return f"""SELECT doc_id, start, (start + length(m))::INTEGER AS "end", {q(rule.entity)} AS entity_type, m AS text, score, {q(rule.name)} AS recognizer FROM
      (SELECT *, {score_sql(rule, ok)} AS score FROM {found} {'WHERE ' + ' AND '.join(where) if where else ''}) WHERE score >= {rule.least}"""


def rules_sql(rules: list[r.Rule], source: str = SEEDED) -> str:
    return " UNION ALL ".join(rule_sql(x, source) for x in rules)
