"""Checks of identifiers, as Spark SQL text over an expression. All are null-free for non-null input."""

from __future__ import annotations

from collections.abc import Callable

from .sqltext import digits, let, lit, weighted

Check = Callable[[str], str]


def luhn(s: str) -> str:
    return let(digits(s), lambda d: f"(length({d}) >= 2 and luhn_check({d}))")


def card_network(d: str) -> str:
    """Length and prefix of the large card networks."""
    return f"{d} rlike '^(4[0-9]{{12}}|4[0-9]{{15}}|4[0-9]{{18}}|5[1-5][0-9]{{14}}|3[47][0-9]{{13}}|6[0-9]{{15}}|6[0-9]{{18}}|(222[1-9]|22[3-9][0-9]|2[3-6][0-9]{{2}}|27[01][0-9]|2720)[0-9]{{12}})$'"


def card(s: str) -> str:
    return let(digits(s), lambda d: f"({card_network(d)} and luhn_check({d}))")


def eu_card(s: str) -> str:
    """Luhn and a prefix issued in Europe. The Visa range is tested as 4974 to 4977, which the stated rule intends."""

    def ok(d: str) -> str:
        p4, p6 = f"cast(left({d}, 4) as int)", f"cast(left({d}, 6) as int)"
        visa = f"({p6} between 416500 and 416599 or {p6} between 497300 and 497999 or {p6} between 450800 and 450899 or {p4} in (4035, 4165, 4177, 4508))"
        other = f"({p4} between 5100 and 5599 or {p4} between 2221 and 2720 or {p4} between 5000 and 5099)"
        bins = f"case when {p4} in (6703, 4871, 4870) then true when {d} like '4%' then {visa} when left({d}, 1) in ('5', '2') then {other} else left({d}, 2) in ('34', '37') and length({d}) = 15 end"
        return f"(length({d}) between 13 and 19 and luhn_check({d}) and {bins})"

    return let(digits(s), ok)


def email(s: str) -> str:
    """Lengths, dots and the last label of an address."""
    return f"""(length({s}) <= 254 and {s} rlike '^[A-Za-z0-9_%+-]++(?:\\\\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9-]++(?:\\\\.[A-Za-z0-9-]++)*+$'
      and length(substring_index({s}, '@', 1)) between 1 and 64 and length(substring_index({s}, '@', -1)) between 4 and 253
      and substring_index({s}, '.', -1) rlike '^[A-Za-z]{{2,}}$')"""


def phone(s: str) -> str:
    """Enough digits, and real grouping where ten digits stand without a plus."""

    def ok(d: str) -> str:
        n = f"length({d})"
        grouped = f"{s} rlike '[().\\\\-/]|[0-9]\\\\s[0-9]'"
        return f"""case when {s} rlike '[*•]' and ltrim({s}) rlike '^0[67]' then {n} between 6 and 10
          when contains({s}, '+') then {n} between 8 and 15
          when {n} = 10 and not ltrim({s}) like '0%' and not {grouped} then false else {n} between 8 and 14 end"""

    return let(digits(s), ok)


def ipv4(s: str) -> str:
    return f"forall(split({s}, '\\\\.'), p -> length(p) <= 3 and cast(p as int) <= 255) and size(split({s}, '\\\\.')) = 4"


def ipv6(s: str) -> str:
    """Groups and at most one gap, after brackets and zone are taken off; an IPv4 tail counts as two groups."""
    core = f"regexp_replace(regexp_replace(trim({s}), '^\\\\[|\\\\](:[0-9]+)?$', ''), '%.*$', '')"
    tail = "regexp_replace(x, '[0-9]{1,3}(\\\\.[0-9]{1,3}){3}$', '0:0')"

    def ok(x: str) -> str:
        n = f"size(regexp_extract_all({x}, '[0-9A-Fa-f]+', 0))"
        shape = f"{x} rlike '^[0-9A-Fa-f:]+$' and not {x} rlike '[0-9A-Fa-f]{{5}}|:::|^:[^:]|[^:]:$'"
        gaps = f"size(regexp_extract_all({x}, '::', 0))"
        return f"({shape} and (({gaps} = 0 and {n} = 8) or ({gaps} = 1 and {n} <= 7)))"

    return let(core, lambda x: let(tail.replace("(x,", f"({x},"), ok))


# Fixed list of last labels that a bare two-label host needs.
HOST_TLDS = (
    "com net org fr de uk io co eu be ch es it nl pl pt at cz se no fi dk ie ro gr hu ru ua tr in au nz jp cn us ca br mx edu gov mil int info biz name pro app dev ai tv me cc ly so to fm is gg je im lt lu lv sk si hr bg ee mt cy "
    "gi fo gl ad mc sm va cat gal eus bar cloud tech online site store shop blog news email mail wtf xyz id sh vc ms ac ngo ong"
).split()


def url(s: str) -> str:
    host = f"lower(regexp_extract({s}, '^[^/]*', 0))"
    two = f"(size(split({host}, '\\\\.')) <> 2 or substring_index({host}, '.', -1) in ({', '.join(lit(t) for t in HOST_TLDS)}))"
    return f"""(length({s}) >= 4 and case when lower({s}) rlike '^https?://' then contains({s}, '.') or lower({s}) like '%localhost%'
      when lower({s}) like 'www.%' then true else contains({s}, '.') and {two} and substring_index({host}, '.', -1) rlike '^[a-z]{{2,}}$' end)"""


def date(s: str) -> str:
    """A plausible ISO or day-month-year date; what looks like a version (all parts small) is none."""
    part = lambda k: f"cast(split({s}, '[/.-]')[{k}] as int)"
    iso = f"cast(substring({s}, 6, 2) as int) between 1 and 12 and cast(substring({s}, 9, 2) as int) between 1 and 31"
    other = f"not ({part(0)} < 13 and {part(1)} < 13 and {part(2)} < 100) and least({part(0)}, 31) >= 1 and least({part(1)}, 12) >= 1"
    return f"case when {s} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' then {iso} else {other} end"


def wallet(s: str) -> str:
    base58, bech = "[1-9A-HJ-NP-Za-km-z]", "[qpzry9x8gf2tvdw0s3jn54khce6mua7l]"
    return f"""({s} rlike '^[13]{base58}{{25,34}}$' or lower({s}) rlike '^bc1p?{bech}{{1,87}}$' or {s} rlike '^0[xX][0-9A-Fa-f]{{40}}$')"""


def mod97(s: str, take: str = "") -> str:
    """The value of an alphanumeric string, letters as two digits from 10, modulo 97."""
    return f"aggregate(filter(split(upper({s}), ''), c -> c <> ''), 0, (a, c) -> (case when c between '0' and '9' then a * 10 + cast(c as int) else a * 100 + ascii(c) - 55 end) % 97)"


# Fixed lengths of account numbers by country.
IBAN_LENGTH = dict(
    AD=24, AT=20, BE=16, BG=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24, FI=18, FO=18, FR=27, GB=22, GI=23, GL=18, GR=27, HR=21, HU=28, IE=22, IS=26, IT=27, LI=21, LT=20,
    LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, RS=22, SE=24, SI=19, SK=24, SM=27, TR=26, VA=22, XK=20,
)


def iban_plausible(s: str) -> str:
    table = "map(" + ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTH.items()) + ")"
    return f"({s} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$' and coalesce(try_element_at({table}, left({s}, 2)) = length({s}), false))"


def iban_mod97(s: str) -> str:
    return f"({mod97(f'concat(substring({s}, 5), left({s}, 4))')} = 1)"


# Fixed list of countries in bank codes.
BIC_COUNTRIES = "AD AE AT AU BA BE BG BH BR BY CH CN CY CZ DE DK EE EG ES FI FO FR GB GE GI GL GR GT HK HR HU IE IL IN IQ IS IT JO JP KW KZ LB LI LT LU LV MC MD ME MK MT MU MX NL NO NZ OM PL PS PT QA RO RS SA SE SG SI SK SM TR UA US VA VG XK".split()


def bic(s: str) -> str:
    return f"(upper({s}) rlike '^[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?$' and substring(upper({s}), 5, 2) in ({', '.join(map(lit, BIC_COUNTRIES))}))"


def vat_fr(s: str) -> str:
    key = f"lpad(cast((12 + 3 * (cast(substring({s}, 5, 9) as bigint) % 97)) % 97 as string), 2, '0')"
    return f"(substring({s}, 3, 2) = {key})"


def siren(s: str) -> str:
    return let(digits(s), lambda d: f"(length({d}) = 9 and {d} <> '000000000' and luhn_check({d}))")


def siret(s: str) -> str:
    return let(digits(s), lambda d: f"(length({d}) = 14 and luhn_check({d}))")


def key97(s: str, body: int) -> str:
    """A two-digit key of 97 minus the rest modulo 97, behind ``body`` digits."""
    return let(digits(s), lambda d: f"(length({d}) = {body + 2} and cast(substring({d}, {body + 1}) as int) = 97 - cast(left({d}, {body}) as bigint) % 97)")


def nir(s: str) -> str:
    return key97(s, 13)


# Fixed words that leave a number open.
HEDGES = r"(?iu)\\b(?:serait|seraient|possible|probable|probablement|environ|approximativement|aurait|auraient|supposé|non[\\s-]+confirmé|non[\\s-]+vérifié|invérifiable)\\b"


def nir_shape(s: str) -> str:
    """Fifteen digits with a plausible sex, month and department."""
    return let(digits(s), lambda d: f"(length({d}) = 15 and {d} rlike '^[12]' and (cast(substring({d}, 4, 2) as int) between 1 and 12 or cast(substring({d}, 4, 2) as int) >= 20) and substring({d}, 6, 2) <> '00')")


def nir_or_hedged(s: str) -> str:
    """The key, or the shape alone where the match says that the number is uncertain."""
    return f"if({s} rlike '{HEDGES}', {nir_shape(s)}, {nir(s)})"


def cni12(s: str) -> str:
    return let(digits(s), lambda d: f"(length({d}) = 12 and cast(right({d}, 1) as int) = {weighted(d, list(range(1, 12)))} % 10)")


def fr_passport(s: str) -> str:
    return f"(upper({s}) rlike '^[A-Z]{{2}}[0-9]{{7}}$' and not substring({s}, 3) rlike '^([0-9])\\\\1+$')"


def fr_licence(s: str) -> str:
    return f"(upper({s}) rlike '^[0-9]{{2}}[A-Z]{{2}}[0-9]{{6}}[A-Z]{{2}}[0-9]{{2}}$' and (cast(left({s}, 2) as int) between 1 and 95 or left({s}, 2) = '99'))"


def steuer_digit(d: str) -> str:
    """The check digit of ten digits by ISO 7064 modulo 11, 10."""
    body = f"aggregate(sequence(1, 10), 10, (p, k) -> (case when (cast(substring({d}, k, 1) as int) + p) % 10 = 0 then 10 else (cast(substring({d}, k, 1) as int) + p) % 10 end * 2) % 11)"
    return f"((11 - {body}) % 10)"


def steuer_id(s: str) -> str:
    """Eleven digits of which the last is the check digit."""
    return let(digits(s), lambda d: f"(length({d}) = 11 and not {d} like '0%' and {steuer_digit(d)} = cast(right({d}, 1) as int))")


def _value(c: str) -> str:
    return f"(case when {c} between '0' and '9' then cast({c} as int) else ascii({c}) - 55 end)"


def personalausweis(s: str) -> str:
    cross = lambda p: f"(({p}) div 10 + ({p}) % 10)"

    def ok(u: str) -> str:
        terms = []
        for k, w in enumerate([7, 3, 1, 7, 3, 1, 7, 3]):
            v = _value(f"substring({u}, {k + 1}, 1)")
            terms.append(f"(case when {v} < 10 then {cross(f'{v} * {w}')} else {cross(f'({v} div 10) * {w}')} + {cross(f'({v} % 10) * {w}')} end)")
        return f"({u} rlike '^[A-Z0-9]{{8}}[0-9]$' and (10 - ({' + '.join(terms)}) % 10) % 10 = cast(right({u}, 1) as int))"

    return let(f"upper({s})", ok)


def reisepass(s: str) -> str:
    return f"(upper({s}) rlike '^[CFGHJKLMNPRTVWXYZ][0-9]{{8}}$')"


def sozialversicherung(s: str) -> str:
    def ok(d: str) -> str:
        terms = [f"(({w} * cast(substring({d}, {k + 1}, 1) as int)) div 10 + ({w} * cast(substring({d}, {k + 1}, 1) as int)) % 10)" for k, w in enumerate([2, 1, 2, 5, 7, 1, 2, 1, 2, 5, 7, 1, 2, 1, 2])]
        return f"(upper({s}) rlike '^[0-9]{{12}}[A-RT-Y][0-9]{{3}}$' and ({' + '.join(terms)}) % 10 = 0)"

    return let(digits(s), ok)


# Fixed values of odd places in Italian fiscal codes: digits, then letters.
CF_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def codice_letter(u: str) -> str:
    """The check letter of fifteen letters and digits."""
    odd = f"array({', '.join(map(str, CF_ODD))})"
    c = f"substring({u}, k, 1)"
    even = f"(case when {c} between '0' and '9' then cast({c} as int) else ascii({c}) - 65 end)"
    return f"char(65 + aggregate(sequence(1, 15), 0, (a, k) -> a + case when k % 2 = 1 then {odd}[{_value(c)}] else {even} end) % 26)"


def codice_fiscale(s: str) -> str:
    return let(f"upper({s})", lambda u: f"({u} rlike '^[A-Z0-9]{{16}}$' and substring({u}, 16, 1) = {codice_letter(u)})")


def cie(s: str) -> str:
    return f"(upper({s}) rlike '^[A-Z]{{2}}[0-9]{{5}}[A-Z]{{2}}$')"


def partita_iva(s: str) -> str:
    def ok(d: str) -> str:
        terms = [f"(({1 + k % 2} * cast(substring({d}, {k + 1}, 1) as int)) div 10 + ({1 + k % 2} * cast(substring({d}, {k + 1}, 1) as int)) % 10)" for k in range(10)]
        return f"(length({d}) = 11 and (10 - ({' + '.join(terms)}) % 10) % 10 = cast(right({d}, 1) as int))"

    return let(digits(s), ok)


DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def dni(s: str) -> str:
    return f"(upper({s}) rlike '^[0-9]{{8}}[A-Z]$' and right(upper({s}), 1) = substring('{DNI_LETTERS}', cast(left({s}, 8) as int) % 23 + 1, 1))"


def nie(s: str) -> str:
    return let(f"concat(translate(upper(left({s}, 1)), 'XYZ', '012'), substring({s}, 2))", lambda t: f"(upper({s}) rlike '^[XYZ][0-9]{{7}}[A-Z]$' and {dni(t)})")


def naf(s: str) -> str:
    return key97(s, 10)


def bsn(s: str) -> str:
    """Weights 9 to 1 modulo 11; repeated digits and runs by one are none."""
    runs = " or ".join(f"{{d}} = '{''.join(str((a + step * k) % 10) for k in range(9))}'" for step in (1, -1) for a in range(10) if 0 <= a + 8 * step <= 9)
    return let(digits(s), lambda d: f"(length({d}) = 9 and not {d} rlike '^([0-9])\\\\1+$' and not ({runs.replace('{d}', d)}) and {weighted(d, list(range(9, 0, -1)))} % 11 = 0)")


def be_number(s: str) -> str:
    return key97(s, 9)


def pesel(s: str) -> str:
    return let(digits(s), lambda d: f"(length({d}) = 11 and (10 - {weighted(d, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = cast(right({d}, 1) as int))")


def nip(s: str) -> str:
    return let(digits(s), lambda d: f"(length({d}) = 10 and {weighted(d, [6, 5, 7, 2, 3, 4, 5, 6, 7])} % 11 = cast(right({d}, 1) as int))")


def nif_pt(s: str) -> str:
    return let(digits(s), lambda d: f"(length({d}) = 9 and (case when {weighted(d, list(range(9, 1, -1)))} % 11 < 2 then 0 else 11 - {weighted(d, list(range(9, 1, -1)))} % 11 end) = cast(right({d}, 1) as int))")


def vitale(s: str) -> str:
    return let(digits(s), lambda d: f"(length({d}) = 10 and luhn_check({d}))")


def always(s: str) -> str:
    return f"({s} is not null)"


CHECKS: dict[str, Check] = {
    f.__name__: f
    for f in (luhn, card, eu_card, email, phone, ipv4, ipv6, url, date, wallet, iban_plausible, iban_mod97, bic, vat_fr, siren, siret, nir, nir_shape, nir_or_hedged, cni12, fr_passport, fr_licence, steuer_id, personalausweis, reisepass, sozialversicherung, codice_fiscale, cie, partita_iva, dni, nie, naf, bsn, be_number, pesel, nip, nif_pt, vitale)
}
