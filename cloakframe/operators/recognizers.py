"""Recognizers: a rule is a pattern, a check and scores; a recognizer set is a list of rules.

All rules of a set become one native projection per document. ``detect`` gives every match that passes its check, with
its score in context: base, plus a boost once if a context word is near, minus a penalty for each word against it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbering
from ..functions import validators as v
from ..functions.sqltext import FOUND, WINDOW, let, lit, spans
from ..schema import ENTITIES, parse_entity_type
from ..session import spread


@dataclass(frozen=True)
class Rule:
    """``group`` tells which part of a match is the entity: the whole, or the value next to its keyword.

    ``needs`` are lower-case strings of which a text holds one wherever the rule has a match; texts without any are not
    searched. ``find`` replaces the pattern by SQL that gives the spans of a text. ``ahead`` is a look-ahead that holds
    wherever a match begins and fails fast elsewhere; ``gate`` is a pattern that every text with a match holds, read once
    for all rules that share it. Neither changes what is found.
    """

    name: str
    entity: str
    pattern: str
    base: float
    check: v.Check = v.always
    least: float = 0.42
    boost: float = 0.06
    penalty: float = 0.10
    words: tuple[str, ...] = ()
    against: tuple[str, ...] = ("example", "test", "dummy", "sample")
    deny: tuple[str, ...] = ()
    invalidate: tuple[str, ...] = ()
    group: str = "all"
    value: str = ""
    languages: tuple[str, ...] = ("*",)
    floor: bool = False
    low: float | None = None
    needs: tuple[str, ...] = ()
    recognizer: str = ""
    find: Callable[[str], str] | None = None
    ahead: str = ""
    gate: str = ""

    @property
    def owner(self) -> str:
        """The recognizer that the rule belongs to."""
        return self.recognizer or self.name


def words(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w.strip().lower() for w in text.split(",") if w.strip()))


# Fixed context word lists.
EMAIL_FOR = words("email, e-mail, mail, mailto, contact, reach, reply, courriel, mel, adresse, contacter, écrire, ecrire, kontakt, ansprechpartner, schreiben, correo, contacto, escribir, posta, contatto, scrivere")
EMAIL_AGAINST = words("example, sample, test, fake, dummy, invalid, exemple, faux, beispiel, muster, ejemplo, prueba, esempio, fittizio")
PHONE_FOR = words("phone, tel, telephone, mobile, cell, call, téléphone, tél, portable, gsm, telefono, teléfono, móvil, movil, handy, rufnummer, numero, numéro, numero di telefono")
PHONE_AGAINST = words("example, test, sample, fake, exemple, beispiel, ejemplo, esempio, iban, credit, card")
CARD_FOR = words("card, credit, debit, visa, mastercard, amex, payment, cb, carte, bancaire, karte, zahlung, tarjeta, pago, carta, pagamento")
CARD_AGAINST = words("example, test, sample, invalid, fake, exemple, beispiel, ejemplo, esempio, phone, iban")
IP_FOR = words("ip, ipv4, ipv6, address, host, server, gateway, dns, adresse, serveur, rechner, direccion, servidor, indirizzo")
IP_AGAINST = words("version, example, test, fake, exemple, beispiel")
URL_FOR = words("url, link, website, http, https, www, site, lien, web, enlace, sitio, collegamento, sito")
URL_AGAINST = words("example.com, example.org, test.com, localhost, invalid, fake")
DATE_FOR = words("date, born, birth, due, expires, datum, geburt, fecha, nacimiento, data, nascita, naissance")
DATE_AGAINST = words("version, v., release, build")
CRYPTO_FOR = words("bitcoin, btc, ethereum, eth, wallet, address, send, payment, crypto, portefeuille, monedero, billetera, portafoglio, zahlung")
CRYPTO_AGAINST = words("example, test, fake, invalid, exemple, beispiel")
IBAN_FOR = words("IBAN, bank account, bank transfer, wire transfer, compte bancaire, coordonnées bancaires, RIB, relevé d'identité bancaire, Bankverbindung, Kontonummer, Bankkonto, Überweisung, cuenta bancaria, cuenta corriente, IBAN bancario, domiciliación, conto corrente, coordinate bancarie, bonifico, bankrekening, rekeningnummer, overschrijving, conta bancária, NIB, transferência, numer konta, przelew, rachunek bankowy, cont bancar, cont curent, transfer bancar, bankkonto, bankgiro, kontonummer, plusgiro")
BIC_FOR = words("BIC, SWIFT, SWIFT code, bank identifier, code banque, identifiant banque, Bankleitzahl, Bankcode, código SWIFT, código BIC, codice SWIFT, codice BIC, bankcode, BIC code, código bancário, identificador bancário, kod SWIFT, identyfikator banku, cod bancar, cod SWIFT, bankidentifiering, bankkod")
VAT_FOR = words("VAT, VAT number, TVA, numéro de TVA, MwSt, USt-IdNr, Umsatzsteuer, IVA, NIF-IVA, partita IVA, P.IVA, BTW, btw-nummer, NIF, número de IVA, NIP, numer VAT, TVA intracommunautaire, CIF, CUI, moms, momssats, VAT ID, TIN")
EU_CARD_FOR = words("Visa, Mastercard, MasterCard, American Express, AmEx, Carte Bleue, carte bancaire, CB, Bancontact, Maestro, CartaSi, carta di credito, tarjeta bancaria, bank card, debitcard, credit card, Kreditkarte, EC-Karte, Girocard, betaalpas, pas kredytowy, card bancar, betalningskort, betalningsmedel")
FR_ID_FOR = words("SIREN, SIRET, NIR, numéro de sécurité sociale, sécurité sociale, INSEE, identifiant entreprise, RCS, RM, entreprise, company number, firmennummer, Unternehmens-ID, CIF empresa, partita IVA azienda, KVK, NIP firmy, social security number, personnummer, număr de identificare")
ADDRESS_FOR = words("adresse, address, Anschrift, indirizzo, dirección, direccion, adres, morada, rue, avenue, boulevard, Straße, Strasse, via, viale, calle, plaats, woonplaats, CAP, code postal, postcode, ZIP, PLZ")
PLATE_FOR = words("plaque, plaque d'immatriculation, immatriculation, numéro de plaque, Kennzeichen, Nummernschild, targa, targhe, matrícula, kenteken, nummerplaat, registration plate, license plate, numéro d'immatriculation, SPZ, tablica rejestracyjna, matrícula automóvel")
EU_PHONE_FOR = words("téléphone, telephone, tel, Tel., mobile, portable, Telefon, Handy, telefono, cellulare, teléfono, móvil, telefoon, gsm, WhatsApp, WhatsApp Business, call, appeler, numéro, numero")
HEALTH_FOR = words("Carte Vitale, CV, vitale, EHIC, CEAM, TSE, European Health Insurance, carte européenne, Krankenversicherung, Krankenkasse, mutuelle, assurance maladie, dossier médical, dossier medical, patient, MRN, NIR patient, hôpital, ospedale, hospital")
ARTICLE_9_FOR = words("données sensibles, sensitive data, besondere Kategorien, categoría especial, categorie particolari, bijzondere persoonsgegevens, art. 9, article 9, Artikel 9")
FR_FOR = words("numéro de sécurité sociale, NIR, sécurité sociale, INSEE, carte d'identité, carte nationale, CNI, passeport, permis de conduire, permis, national identity, French ID")
DE_FOR = words("Personalausweis, Ausweis, Steuer-ID, Steueridentifikationsnummer, Reisepass, Pass, Sozialversicherungsnummer, SV-Nummer, Rentenversicherungsnummer, German ID, tax number")
IT_FOR = words("codice fiscale, CIE, carta d'identità, Partita IVA, P.IVA, Italian tax")
ES_FOR = words("DNI, NIF, NIE, documento nacional, seguridad social, número de afiliación, Spanish ID, tarjeta sanitaria")
NL_FOR = words("BSN, Burgerservicenummer, sofi-nummer, identiteitsnummer, Dutch citizen service number, NL ID")
BE_FOR = words("numéro national, rijksregisternummer, registre national, BSN België, Belgian national number, NN")
PL_FOR = words("PESEL, NIP, numer PESEL, Polish national, identyfikator podatkowy")
PT_FOR = words("NIF, número de identificação fiscal, Cartão de Cidadão, CC, Portuguese tax")
# Fixed languages of recognizers.
COMMON = tuple("en fr de es it nl pt pl".split())
FINANCIAL = (*COMMON, "ro", "sv")

# Fixed patterns: the shapes that recognizers look for.
CARD_RUN = r"\b[0-9](?:[\s-]?[0-9]){12,18}\b"
PHONE_RUN = (
    r"\+\s*(?:33|49|39|34|31|32|351|48|352|353|44|41|43|45|46|47|358|30|420|36|40|372|371|370|356|386|421|385)\s*(?:[\s./-]*+[0-9]){7,14}[0-9]"
    r"|(?:\+1[\s.-]+)?(?:\([0-9]{3}\)|\b[0-9]{3})[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}\b"
    r"|\b0[1-9](?:[\s./-][0-9]{2}){4}\b"
    r"|\b0[67](?:[\s./-](?:[0-9]{2}|\*{2}|[•xX]{2})){4}"
    r"|\b0[\s./-]*+[0-9]{2,4}(?:[\s./-]+[0-9]{2,8}){1,8}\b"
)
IPV6_RUN = r"(?i)(?<![0-9a-f:.])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}(?:%[0-9a-z_.-]++)?|::1|::ffff:[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9a-f:])|\[[0-9a-fA-F:.]+\](?::[0-9]+)?"
URL_RUN = r"(?i)\bhttps?://[^\s<>\[\]{}|\\^`\"']+|\bwww\.[^\s<>\[\]{}|\\^`\"']+|\b[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?+(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?+)++(?:/[^\s<>\[\]{}|\\^`\"']*)?"
HOUSE = r"\b[0-9]{1,4}(?:\s+(?:bis|ter|quater))?[a-z]?\s+"
CITY = r"[a-zà-ÿ][a-zà-ÿ'. -]{1,45}"
POSTAL = r"(?:[0-9]{5}|[0-9]{4}\s*[a-z]{2}|[a-z]{1,2}[0-9][a-z0-9]?\s*[0-9][a-z]{2}|[0-9]{2}-[0-9]{3}|[0-9]{3}\s?[0-9]{2})"
ADDRESS_RUN = (
    rf"(?iu){HOUSE}[^\n]{{4,120}}\s*\r?\n\s*[0-9]{{5}}\s+{CITY}(?:\r?\n\s*France\b)?"
    rf"|{HOUSE}[\p{{L}}\p{{N}}_'.,\s-]{{3,100}}?(?:\s*,\s*(?:apt|appt|appart\.?|porte)\s*[a-z0-9.\s/-]{{1,24}})?\s*,?\s+{POSTAL}\s+[a-zà-ÿ][a-zà-ÿ'.\s-]{{1,45}}\b"
)
#: Countries of bank codes by their first letter, so that few words are tried.
BIC_COUNTRY = "|".join(f"{a}[{''.join(c[1] for c in v.BIC_COUNTRIES if c[0] == a)}]" for a in sorted({c[0] for c in v.BIC_COUNTRIES}))


# Fixed rules of the default set: patterns, scores and bounds.
DEFAULT_RULES = [
    Rule("email_rfc5322_like", "EMAIL", r"(?i)(?<![a-z0-9._%+-])[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9])?@[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\.[a-z]{2,63}\b", 0.88, v.email, 0.42, 0.07, 0.11, EMAIL_FOR, EMAIL_AGAINST, words("example.com, example.org, example.net, test.com, invalid, localhost"), words("noreply, no-reply, donotreply"), needs=("@",), languages=COMMON, ahead=r"(?=[A-Za-z0-9._%+-]++@)"),
    Rule("phone_e164_eu", "PHONE", PHONE_RUN, 0.78, v.phone, 0.40, 0.06, 0.10, PHONE_FOR, PHONE_AGAINST, languages=COMMON, ahead="(?=[+(0-9])"),
    Rule("credit_card_luhn", "CREDIT_CARD", CARD_RUN, 0.72, v.card, 0.45, 0.08, 0.12, CARD_FOR, CARD_AGAINST, languages=COMMON),
    Rule("credit_card_masked_last4", "CREDIT_CARD", r"(?iu)\b(?:visa|mastercard|master\s?card|mc|amex|american\s?express)\s+(?:\*{2,4}|[•x]{2,4})(?:\s+(?:\*{2,4}|[•x]{2,4})){2}\s+[0-9]{4}\b", 0.62, v.always, 0.42, 0.06, 0.10, CARD_FOR, CARD_AGAINST, needs=("**", "••", "xx", "•x", "x•"), languages=COMMON),
    Rule("ipv4", "IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b", 0.90, v.always, 0.50, 0.05, 0.10, IP_FOR, IP_AGAINST, needs=(".",), languages=COMMON),
    Rule("ipv6", "IP_ADDRESS", IPV6_RUN, 0.88, v.ipv6, 0.50, 0.05, 0.10, IP_FOR, IP_AGAINST, needs=(":",), languages=COMMON),
    Rule("url", "URL", URL_RUN, 0.70, v.url, 0.38, 0.07, 0.12, URL_FOR, URL_AGAINST, words("example.com, example.org, test.com"), needs=(".",), languages=COMMON, ahead=r"\b(?=[A-Za-z0-9-]{1,63}+[.:])"),
    Rule("date_eu_iso", "DATE", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[Tt\s][0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})?)?\b|\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b", 0.65, v.date, 0.35, 0.06, 0.10, DATE_FOR, DATE_AGAINST, languages=COMMON),
    Rule("crypto_wallet", "CRYPTO_WALLET", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b|(?i)\bbc1[a-z0-9]{11,71}\b|\b0x[a-f0-9]{40}\b", 0.68, v.wallet, 0.42, 0.08, 0.11, CRYPTO_FOR, CRYPTO_AGAINST, languages=COMMON),
    Rule("eu_postal_address", "ADDRESS", ADDRESS_RUN, 0.62, v.always, 0.35, 0.08, 0.12, ADDRESS_FOR, words("example.com, test, dummy"), languages=COMMON),
    Rule("iban_iso13616", "IBAN", "", 0.95, v.iban_mod97, 0.35, 0.05, 0.12, IBAN_FOR, words("example.com, test.invalid, fake-iban, dummy"), floor=True, low=0.40, languages=FINANCIAL, find=lambda text: iban_spans(text)),
    Rule("bic_swift", "BANK_ACCOUNT", rf"(?i)\b[a-z]{{4}}(?:{BIC_COUNTRY})[a-z0-9]{{2}}(?:[a-z0-9]{{3}})?\b", 0.88, v.always, 0.42, 0.07, 0.15, BIC_FOR, words("example, testbank, XXXX, dummy"), languages=FINANCIAL),
    Rule("eu_credit_card_bins", "CREDIT_CARD", CARD_RUN, 0.78, v.eu_card, 0.48, 0.08, 0.14, EU_CARD_FOR, words("test card, fake, example"), languages=FINANCIAL),
    Rule("fr_siren", "TAX_ID", r"(?iu)\b(?:SIREN|n°\s*siren)\s*[.:]?\s*[0-9]{3}[\s.]?[0-9]{3}[\s.]?[0-9]{3}\b", 0.90, v.siren, 0.45, 0.07, 0.0, FR_ID_FOR, (), needs=("siren",), languages=FINANCIAL),
    Rule("fr_siret", "TAX_ID", r"(?iu)\bSIRET(?:(?:\s+[\p{L}\p{N}_]+){0,6}\s*[.:]\s*|[\s.:]+)[0-9]{3}[\s.]?[0-9]{3}[\s.]?[0-9]{3}[\s.]?[0-9]{5}\b|\b[0-9]{14}\b", 0.92, v.siret, 0.45, 0.07, 0.0, FR_ID_FOR, (), languages=FINANCIAL),
    Rule("fr_nir", "NATIONAL_ID", r"(?iu)\b(?:NIR|n°\s*ss|numéro\s*de\s*sécurité\s*sociale|insee)(?:\s+\p{L}[\p{L}\p{N}_'-]*+){0,14}\s*[.:]?\s*[12]\s*[0-9]{2}\s*[0-9]{2}\s*[0-9]{2}\s*[0-9]{3}\s*[0-9]{3}\s*[0-9]{2}\b|\b[12][0-9]{14}\b", 0.88, v.nir_or_hedged, 0.48, 0.07, 0.0, FR_ID_FOR, (), languages=FINANCIAL),
]

# Fixed VAT shapes by country.
VAT = dict(
    FR=r"[A-HJ-NP-Z0-9]{2}[0-9]{9}", DE="[0-9]{9}", IT="[0-9]{11}", ES="[A-Z0-9][0-9]{7}[A-Z0-9]", NL="[0-9]{9}B[0-9]{2}", BE="0[0-9]{9}", AT="U[0-9]{8}", PT="[0-9]{9}", PL="[0-9]{9,10}", SE="[0-9]{12}", DK="[0-9]{8}", FI="[0-9]{8}", HU="[0-9]{8}",
    CZ="[0-9]{8,10}", SK="[0-9]{10}", SI="[0-9]{8}", RO="[0-9]{2,10}", BG="[0-9]{9,10}", HR="[0-9]{11}", EL="[0-9]{9}", IE="[0-9][A-Z0-9][0-9]{5}[A-Z]", LT="(?:[0-9]{9}|[0-9]{12})", LV="[0-9]{11}", EE="[0-9]{9}", MT="[0-9]{8}", CY="[0-9]{8}[A-Z]", LU="[0-9]{8}", XI="[0-9]{9}",
)


def vat_rules() -> list[Rule]:
    """One rule for all countries whose shape alone decides, and one for each with a check."""
    plain = "|".join(f"{cc}{shape}" for cc, shape in VAT.items() if cc not in ("FR", "ES", "NL"))
    common = dict(least=0.40, boost=0.06, penalty=0.12, words=VAT_FOR, against=words("example vat, test tin, dummy"), floor=True, languages=FINANCIAL)
    return [
        Rule("eu_vat_intracom", "TAX_ID", rf"(?i)\b(?:{plain})\b", 0.82, **common),
        Rule("eu_vat_intracom", "TAX_ID", rf"(?i)\bFR{VAT['FR']}\b", 0.92, v.vat_fr, low=0.48, **common),
        Rule("eu_vat_intracom", "TAX_ID", rf"(?i)\b(?:ES{VAT['ES']}|NL{VAT['NL']})\b", 0.92, **common),
    ]


DEFAULT_RULES += vat_rules()


def lead(name: str, entity: str, before: str, value: str, base: float, check: v.Check, after: str = "", bare: str = "", **more) -> Rule:
    """Rule of an identifier next to its keyword, which stands before it or, if ``after`` is given, behind it; ``bare`` stands alone."""
    ways = [rf"\b(?:{before})[\s.:]+{value}\b", *([rf"\b{value}\s+(?:{after})\b"] if after else []), *([rf"\b{bare}\b"] if bare else [])]
    return Rule(name, entity, "(?iu)" + "|".join(ways), base, check, group="value", value=value, **more)


def composite(recognizer: str, rules: list[Rule], words: tuple[str, ...], languages: tuple[str, ...] = ("*",), least: float = 0.42) -> list[Rule]:
    """The rules as one recognizer, with one context: penalties do not take a score below ``least``."""
    return [replace(r, recognizer=recognizer, words=words, languages=languages, least=least, floor=True) for r in rules]


# Fixed shapes of plates behind a country sign, and their scores.
PLATES = dict(
    fr=("FR|FRA", r"[A-HJ-NP-TV-Z]{2}[\s-]?[0-9]{3}[\s-]?[A-HJ-NP-TV-Z]{2}", 0.78), de=("DE", r"[A-ZÄÖÜ]{1,3}[\s-]+[A-ZÄÖÜ]{1,2}[\s-]+[0-9]{1,4}[A-Z]{0,2}", 0.76), it=("IT", r"[A-Z]{2}\s*[0-9]{3}\s*[A-Z]{2}", 0.78), es=("ES", r"[0-9]{4}\s*[A-Z]{3}", 0.77),
    nl=("NL", r"(?:[0-9]{1,3}[\s-]?[A-Z]{1,3}[\s-]?[0-9]{1,3}|[0-9]{2}[\s-]?[A-Z]{2}[\s-]?[0-9]{2})", 0.74), be=("BE", r"[0-9][\s-]?[A-Z]{3}[\s-]?[0-9]{3}", 0.75), pt=("PT", r"(?:[A-Z]{2}[\s-]?[0-9]{2}[\s-]?[0-9]{2}|[0-9]{2}[\s-]?[A-Z]{2}[\s-]?[0-9]{2})", 0.73), pl=("PL", r"[A-Z]{2,3}\s?[0-9]{4,5}[A-Z]?", 0.74),
    at=("AT", r"[A-Z]{1,3}\s+[A-Z]{1,2}\s+[0-9]{1,6}", 0.75), se=("SE", r"[A-Z]{3}\s?[0-9]{2,3}\s?[A-Z]", 0.74), gb=("GB|UK", r"[A-Z]{2}\s?[0-9]{2}\s?[A-Z]{3}", 0.77), ie=("IRL|IE", r"[0-9]{2}[\s-]?[A-Z]{1,2}[\s-]?[0-9]{1,6}", 0.72), dk=("DK", r"[A-Z]{2}\s?[0-9]{5}", 0.74),
    fi=("FIN|FI", r"[A-Z]{3}[\s-]?[0-9]{3}", 0.73), gr=("GR", r"[A-Z]{3}[\s-]?[0-9]{4}", 0.72), cz=("CZ", r"[0-9][A-Z][0-9]\s?[0-9]{4}", 0.71), ro=("RO", r"[A-Z]{1,2}\s?[0-9]{2,3}\s?[A-Z]{3}", 0.71), hu=("HU", r"[A-Z]{3}[\s-]?[0-9]{3}", 0.72), sk=("SK", r"[A-Z]{2}[0-9]{3}[A-Z]{2}", 0.73), hr=("HR", r"[A-Z]{2}\s*[0-9]{3,4}\s*[A-Z]{2}", 0.72),
    si=("SLO|SI", r"[A-Z]{1,2}\s?[0-9]{1,2}\s?[A-Z]{2}", 0.70), ee=("EST|EE", r"[0-9]{3}\s?[A-Z]{2}[0-9]", 0.71), lv=("LV", r"[A-Z]{2}[\s-]?[0-9]{4}", 0.71), lt=("LT", r"[A-Z]{3}\s?[0-9]{3}", 0.71), cy=("CY", r"[A-Z]{3}\s?[0-9]{3}", 0.70), lu=("LU", r"[A-Z]{2}[0-9]{4}", 0.72), mt=("MT", r"[A-Z]{3}[0-9]{2,4}", 0.70),
)
#: A country sign, up to two groups of letters and a digit, with which every plate behind a sign begins.
PLATE_GATE = rf"(?iu)\b(?:{'|'.join(sign for sign, _, _ in PLATES.values())})[\s-]*(?:[A-ZÄÖÜ]{{1,3}}[\s-]*){{0,2}}[0-9]"
PLATE_RULES = composite(
    "eu_license_plates",
    [
        *[Rule(f"plate_{cc}", "VEHICLE_PLATE", rf"(?iu)\b(?:{sign})[\s-]*{shape}\b", base, group="value", value=shape, needs=tuple(sign.lower().split("|")), gate=PLATE_GATE) for cc, (sign, shape, base) in PLATES.items()],
        Rule("plate_fr_bare", "VEHICLE_PLATE", r"(?i)\b[A-HJ-NP-TV-Z]{2}[\s-][0-9]{3}[\s-][A-HJ-NP-TV-Z]{2}\b", 0.55),
    ],
    PLATE_FOR,
)
# Fixed rules of national identifiers.
ID_RULES = [
    *composite("fr_national_identity", [
        lead("fr_nir", "NATIONAL_ID", r"NIR|n°\s*ss|numéro\s*de\s*sécurité\s*sociale|insee", r"[12][0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{3}\s?[0-9]{3}\s?[0-9]{2}", 0.90, v.nir, bare="[12][0-9]{14}"),
        lead("fr_cni_12", "NATIONAL_ID", r"carte\s*d'identité|carte\s*nationale|CNI", "[0-9]{12}", 0.86, v.cni12, r"carte\s*d'identité|carte\s*nationale|CNI|identité", needs=("carte", "cni", "identité")),
        lead("fr_passport", "PASSPORT", "passeport|passport", "[A-Z]{2}[0-9]{7}", 0.84, v.fr_passport, "passeport", needs=("passeport", "passport")),
        lead("fr_driver_license", "DRIVER_LICENSE", r"permis\s*de\s*conduire|permis", "[0-9]{2}[A-Z]{2}[0-9]{6}[A-Z]{2}[0-9]{2}", 0.83, v.fr_licence, "permis", needs=("permis",)),
    ], FR_FOR, ("fr", "en")),
    *composite("de_national_identity", [
        lead("de_steuer_id", "TAX_ID", "Steuer[- ]?ID|Steueridentifikationsnummer", "[0-9]{11}", 0.91, v.steuer_id, "Steuer|tax", needs=("steuer", "tax")),
        lead("de_personalausweis", "NATIONAL_ID", "Personalausweis|Ausweis", "[A-Z0-9]{9}", 0.88, v.personalausweis, "Ausweis", needs=("ausweis",)),
        lead("de_reisepass", "PASSPORT", "Reisepass|Pass|Passport", "[CFGHJKLMNPRTVWXYZ][0-9]{8}", 0.85, v.reisepass, needs=("pass",)),
        lead("de_sozialversicherung", "SSN", "Sozialversicherungsnummer|SV[- ]?Nummer|Rentenversicherung", "[0-9]{12}[A-Z][0-9]{3}", 0.87, v.sozialversicherung, needs=("versicherung", "nummer")),
    ], DE_FOR, ("de", "en")),
    *composite("it_national_identity", [
        lead("it_codice_fiscale", "NATIONAL_ID", r"codice\s*fiscale|CF", "[A-Z0-9]{16}", 0.92, v.codice_fiscale, r"codice\s+fiscale", needs=("cf", "codice")),
        lead("it_cie", "NATIONAL_ID", r"CIE|carta\s*d'identit[aà]\s*elettronica", "[A-Z]{2}[0-9]{5}[A-Z]{2}", 0.85, v.cie, needs=("cie", "elettronica")),
        lead("it_partita_iva", "TAX_ID", r"Partita\s*IVA|P\.?\s*IVA", "[0-9]{11}", 0.90, v.partita_iva, r"P\.?\s*IVA", needs=("iva",)),
    ], IT_FOR, ("it", "en")),
    *composite("es_national_identity", [
        lead("es_dni", "NATIONAL_ID", "DNI|NIF", "[0-9]{8}[A-Z]", 0.90, v.dni, "DNI|NIF", needs=("dni", "nif")),
        lead("es_nie", "NATIONAL_ID", "NIE", "[XYZ][0-9]{7}[A-Z]", 0.89, v.nie, "NIE", needs=("nie",)),
        lead("es_seguridad_social", "SSN", r"seguridad\s*social|n[uú]mero\s*de\s*la\s*seguridad\s*social|NAF", "[0-9]{12}", 0.86, v.naf, needs=("seguridad", "naf")),
    ], ES_FOR, ("es", "en")),
    *composite("nl_national_identity", [lead("nl_bsn", "NATIONAL_ID", "BSN|Burgerservicenummer", "[0-9]{9}", 0.90, v.bsn, "BSN|Burgerservicenummer", needs=("bsn", "burgerservicenummer"))], NL_FOR, ("nl", "en")),
    *composite("be_national_identity", [lead("be_nrn", "NATIONAL_ID", r"rijksregisternummer|numéro\s*national|NN", "[0-9]{11}", 0.91, v.be_number, "rijksregisternummer|national", needs=("nn", "national", "rijksregisternummer"))], BE_FOR, ("nl", "fr", "en")),
    *composite("pl_national_identity", [
        lead("pl_pesel", "NATIONAL_ID", "PESEL", "[0-9]{11}", 0.90, v.pesel, "PESEL", needs=("pesel",)),
        lead("pl_nip", "TAX_ID", "NIP", "[0-9]{10}", 0.89, v.nip, "NIP", needs=("nip",)),
    ], PL_FOR, ("pl", "en")),
    *composite("pt_national_identity", [
        lead("pt_nif", "TAX_ID", r"NIF|n[uú]mero\s*de\s*identifica[çc][aã]o\s*fiscal", "[0-9]{9}", 0.90, v.nif_pt, "NIF", needs=("nif", "fiscal")),
        lead("pt_cartao_cidadao", "NATIONAL_ID", r"Cart[aã]o\s*de\s*Cidad[aã]o|CC", "[0-9]{9}", 0.88, v.nif_pt, r"Cart[aã]o\s*de\s*Cidad[aã]o|CC", needs=("cc", "cidad")),
    ], PT_FOR, ("pt", "en")),
]
HEALTH_RULES = composite("eu_health_ids", [
    lead("fr_carte_vitale_ctx", "MEDICAL_RECORD", r"carte\s*vitale|CV\s*vitale|numéro\s*vitale", "[0-9]{10}", 0.80, v.vitale, needs=("vitale",)),
    Rule("ehic_iso_token", "MEDICAL_RECORD", r"(?iu)\b(?:EHIC|CEAM|TSE|european\s*health\s*insurance)[\s.:#]+[A-Z]{2}[0-9A-Z]{10,20}\b", 0.72, group="value", value="[A-Z]{2}[0-9A-Z]{10,20}", needs=("ehic", "ceam", "tse", "insurance")),
    lead("medical_record_id", "MEDICAL_RECORD", r"MRN|dossier\s*(?:patient|médical|medical)|patient\s*id|numéro\s*de\s*dossier", "[A-Z0-9]{4,16}(?:[/-][A-Z0-9]{2,8})?", 0.68, v.always, needs=("mrn", "dossier", "patient")),
], HEALTH_FOR)

# Fixed keywords of special categories of data.
ARTICLE_9 = dict(
    gdpr_racial_ethnic=(r"racial\s+or\s+ethnic\s+origin|origine\s+(?:racial|ethnique)|ethnische\s+Herkunft|origen\s+(?:racial|[ée]tnico)|origine\s+etnica|ras\s+of\s+etnische\s+afkomst", 0.45),
    gdpr_political=(r"political\s+opinions?|opinions?\s+politiques|politische\s+Meinung(?:en)?|opini[oó]n\s+pol[ií]tica|opinioni\s+politiche|politieke\s+opvattingen", 0.42),
    gdpr_religious_philosophical=(r"religious\s+or\s+philosophical\s+beliefs?|convictions?\s+religieuses|Weltanschauung|creencias?\s+religiosas|cred(?:o|enze)\s+religios[ae]|levensbeschouwing", 0.42),
    gdpr_biometric=(r"biometric\s+data|données?\s+biométriques|Biometr(?:ie|ische\s+Daten)|datos?\s+biométricos|dati\s+biometrici|biometrische\s+gegevens|template\s+biométrique|(?:fingerprint|facial\s+recognition)\s+template", 0.48),
    gdpr_sexual_orientation=(r"sexual\s+orientation|orientation\s+sexuelle|sexuelle\s+Orientierung|orientaci[oó]n\s+sexual|orientamento\s+sessuale|seksuele\s+geaardheid", 0.40),
    gdpr_trade_union=(r"trade\s+union\s+membership|appartenance\s+syndicale|Gewerkschaftszugehörigkeit|afiliaci[oó]n\s+sindical|appartenenza\s+sindacale", 0.41),
)
#: What a text must hold for each category's keywords, in lower case.
ARTICLE_9_NEEDS = dict(
    gdpr_racial_ethnic=("racial", "ethni", "étni", "etni"), gdpr_political=("politi", "polít"), gdpr_religious_philosophical=("relig", "philosoph", "anschauung", "levensbeschouwing"),
    gdpr_biometric=("biom", "template"), gdpr_sexual_orientation=("sexu", "sess", "seks"), gdpr_trade_union=("union", "syndica", "gewerkschaft", "sindical", "sindacale"),
)
ARTICLE_9_RULES = composite("gdpr_art9_keywords", [Rule(n, "CUSTOM:GDPR_ART9", rf"(?iu)\b(?:{p})\b", base, needs=ARTICLE_9_NEEDS[n]) for n, (p, base) in ARTICLE_9.items()], ARTICLE_9_FOR, least=0.28)

# Fixed patterns of what identifies together: postal codes, dates, genders, and a profession with employer and city.
QUASI_POSTAL = r"(?i)\b[0-9]{5}\b|\b[0-9]{4}\s*[a-z]{2}\b|\b[a-z]{1,2}[0-9][a-z0-9]?\s*[0-9][a-z]{2}\b|\b[0-9]{2}-[0-9]{3}\b|\b[0-9]{3}\s?[0-9]{2}\b"
QUASI_DATE = r"(?iu)\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b|\b(?:né|née|born|geboren|geb\.|DOB|date\s+of\s+birth|date\s+de\s+naissance)\b[^\n]{0,24}\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b|\b(?:19|20)[0-9]{2}\b(?:\s*(?:year|ans|Jahr|años))?"
QUASI_GENDER = r"(?iu)\b(?:male|female|masculin|féminin|feminin|homme|femme|mann|frau|mujer|hombre)\b|\bgenre\s*[:/]\s*[MFHX]\b|\bsex\s*[:/]\s*[MF]\b"
PROFESSION = r"(?iu)\b(?:ingénieur|engineer|médecin|physician|avocat|lawyer|enseignant|teacher|nurse|infirmier|developer|consultant)\b[\s\S]{0,140}?(?:\b(?:chez|at|bei|bij)|\b@)\s+[a-z0-9][a-z0-9&.\s-]{2,42}[\s\S]{0,120}?\b[a-z][a-zà-ÿ]+(?:\s+[a-z][a-zà-ÿ]+){0,2}\b"
QUASI_WINDOW = 140


def quasi_spans(text: str) -> str:
    """Hulls of a postal code, the first date and the first gender within 140 characters of it, and profession spans; of those that overlap the first."""
    lo = f"greatest(s.start - {QUASI_WINDOW}, 0)"
    window = f"substring({text}, {lo} + 1, s.end + {QUASI_WINDOW} - {lo})"
    part = lambda w, p: f"named_struct('at', regexp_instr({w}, {lit(p)}) - 1, 'n', length(regexp_extract({w}, {lit(p)}, 0)))"
    hull = lambda w: f"transform(array(named_struct('d', {part(w, QUASI_DATE)}, 'g', {part(w, QUASI_GENDER)})), x -> if(x.d.at < 0 or x.g.at < 0, null, named_struct('start', least(s.start, {lo} + x.d.at, {lo} + x.g.at), 'end', greatest(s.end, {lo} + x.d.at + x.d.n, {lo} + x.g.at + x.g.n))))[0]"
    near = f"filter(transform({spans(text, QUASI_POSTAL)}, s -> {let(window, hull)}), h -> h is not null)"
    work = f"transform({spans(text, PROFESSION)}, s -> named_struct('start', s.start, 'end', s.end))"
    near = f"if({text} rlike {lit(QUASI_GENDER)}, {near}, cast(array() as array<struct<start:int,end:int>>))"
    work = f"if({text} rlike {lit(PROFESSION[: PROFESSION.index('[')])}, {work}, cast(array() as array<struct<start:int,end:int>>))"
    return framed(text, apart(f"concat({near}, {work})"))


def apart(hulls: str) -> str:
    """Of structs (start, end) in order those that begin behind the one kept last."""
    step = "(a, h) -> if(h.start < a.to, a, named_struct('to', h.end, 'kept', concat(a.kept, array(h))))"
    return f"aggregate(array_sort({hulls}), named_struct('to', 0, 'kept', cast(array() as array<struct<start:int,end:int>>)), {step}, a -> a.kept)"


def framed(text: str, hulls: str) -> str:
    """Spans with their text and what stands around it."""
    return f"transform({hulls}, h -> named_struct('start', h.start, 'end', h.end, 'm', substring({text}, h.start + 1, h.end - h.start), 'before', substring({text}, greatest(h.start - {WINDOW}, 0) + 1, least(h.start, {WINDOW})), 'after', substring({text}, h.end + 1, {WINDOW})))"


QUASI_RULES = [Rule("eu_quasi_identifiers", "CUSTOM:QUASI_IDENTIFIER", "", 0.55, least=0.32, against=(), find=quasi_spans)]
EU_PHONE_RULES = [
    Rule("eu_phone_phonenumber", "PHONE", rf"(?<![0-9+])\+\s*(?:{'|'.join(map(str, numbering.CALLING.values()))})(?:[\s./()-]*+[0-9]){{7,12}}+(?![0-9])", 0.82, numbering.valid, 0.38, 0.06, 0.10, EU_PHONE_FOR, words("example, test, dummy, sample, 555-"), floor=True, needs=("+",))
]
EU_RULES = [*PLATE_RULES, *EU_PHONE_RULES, *HEALTH_RULES, *ARTICLE_9_RULES, *QUASI_RULES, *ID_RULES]


class Registry:
    """Rules by recognizer; a registry is changed into a new one, never in place."""

    def __init__(self, rules: list[Rule] | None = None) -> None:
        self.rules = list(DEFAULT_RULES if rules is None else rules)

    def add(self, *rules: Rule) -> Registry:
        return Registry([*self.rules, *rules])

    def remove(self, recognizer: str) -> Registry:
        return Registry(chosen(self.rules, disabled=(recognizer,)))

    def get_by_entity(self, entity: str) -> list[Rule]:
        return chosen(self.rules, [parse_entity_type(entity)])

    def get_by_language(self, language: str) -> list[Rule]:
        return chosen(self.rules, language=language)

    def recognizers(self) -> list[str]:
        return sorted({r.owner for r in self.rules})


def register_recognizer(rules: list[Rule], name: str, entity: str, pattern: str, base: float, check: v.Check = v.always, **more) -> list[Rule]:
    """The rules and one more of the caller's own."""
    return [*rules, Rule(name, parse_entity_type(entity), pattern, base, check, **more)]


def chosen(rules: list[Rule], types: list[str] | None = None, disabled: tuple[str, ...] = (), language: str | None = None) -> list[Rule]:
    """Rules for these types and this language, without disabled recognizers; decided before a plan is built."""
    off = {d.lower() for d in disabled}
    keep = [r for r in rules if r.name.lower() not in off and r.owner.lower() not in off and (types is None or r.entity in types)]
    return [r for r in keep if language is None or "*" in r.languages or language.lower() in r.languages]


def _alternation(items: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in sorted(items, key=len, reverse=True))


def score_sql(rule: Rule, m: str, before: str, after: str, ok: str | None = None) -> str:
    """A match's score in context; below its least score it is none."""
    base = f"double({rule.base})" if rule.low is None else f"if({ok}, double({rule.base}), double({rule.low}))"
    near = f"lower(concat({before}, {m}, {after}))"
    boost = f"if({near} rlike {lit(_alternation(rule.words))}, {rule.boost}D, 0D)" if rule.words else "0D"
    penalty = f"{rule.penalty}D * regexp_count({near}, {lit(_alternation(rule.against))})" if rule.against and rule.penalty else "0D"
    score = f"least({base} + {boost}, 1D) - {penalty}"
    if rule.invalidate:
        score = f"greatest({score} - 0.15D * regexp_count({near}, {lit(_alternation(rule.invalidate))}), double({rule.least}))"
    if rule.floor:
        score = f"greatest({score}, double({rule.least}))"
    return f"round({score}, 6)"


def rule_sql(rule: Rule, text: str, low: str | None = None) -> str:
    """array<entity> of one rule; ``low`` is the text in lower case."""
    check = None if rule.check is v.always else rule.check
    if rule.find:
        found = rule.find(text)
    else:
        found = spans(text, f"{rule.ahead}(?:{rule.pattern})" if rule.ahead else rule.pattern, check if rule.group == "all" and rule.low is None else None)
    if rule.group == "value":
        own = lit(f"(?iu){rule.value}")
        last = lit(f"(?iu){rule.value}$")
        # The value stands at the match's end, or else at its beginning.
        part = f"if(regexp_extract(s.m, {last}, 0) <> '', named_struct('at', length(s.m) - length(regexp_extract(s.m, {last}, 0)), 'm', regexp_extract(s.m, {last}, 0)), named_struct('at', 0, 'm', regexp_extract(s.m, {own}, 0)))"
        moved = lambda x: f"named_struct('start', s.start + {x}.at, 'end', s.start + {x}.at + length({x}.m), 'm', {x}.m, 'before', right(concat(s.before, left(s.m, {x}.at)), {WINDOW}), 'after', left(concat(substring(s.m, {x}.at + length({x}.m) + 1), s.after), {WINDOW}))"
        found = f"transform({found}, s -> {let(part, moved)})"
    ok = rule.check("s.m") if not rule.find else rule.check("upper(regexp_replace(s.m, '[^A-Za-z0-9]', ''))")
    kept = f"filter({found}, s -> {ok})" if check and rule.low is None else found
    if rule.deny:
        kept = f"filter({kept}, s -> not lower(s.m) rlike {lit(_alternation(rule.deny))})"
    if rule.entity == "EMAIL":
        # A match behind a dot is none, nor one whose sentence's dot ends the text or precedes no letter or digit.
        kept = f"filter({kept}, s -> not s.before like '%.' and not s.after rlike '^\\\\.\\\\s*($|[^A-Za-z0-9\\\\s])')"
    score = score_sql(rule, "s.m", "s.before", "s.after", ok)
    made = f"transform({kept}, s -> named_struct('start', s.start, 'end', s.end, 'entity_type', {lit(rule.entity)}, 'text', s.m, 'score', {score}, 'recognizer', {lit(rule.name)}))"
    out = f"filter({made}, e -> e.score >= double({rule.least}))"
    if rule.needs:
        low = low or f"lower({text})"
        gate = " or ".join(f"contains({low}, {lit(n)})" for n in rule.needs)
        out = f"if({gate}, {out}, cast(array() as {ENTITIES}))"
    return out


IBAN_HEAD = r"(?i)\b(?=([a-z]{2}[0-9]{2}(?:[\s.-]*+[a-z0-9]){11,35}))[a-z]{2}[0-9]{2}"


def iban_spans(text: str) -> str:
    """Account numbers from each place where one may begin: the longest run's part that has its country's length; of those that overlap the first."""
    table = "map(" + ", ".join(f"'{k}', {n}" for k, n in v.IBAN_LENGTH.items()) + ")"
    size = f"coalesce(try_element_at({table}, upper(left(s.m, 2))), 999)"
    # The shortest beginning of the run that holds so many letters or digits.
    cut = lambda run: f"coalesce(regexp_extract({run}, concat('(?i)^(?:[\\\\s.-]*[a-z0-9]){{', {size}, '}}'), 0), '')"
    hull = lambda run: let(f"if({size} = 999, '', {cut(run)})", lambda t: f"named_struct('start', s.start, 'end', s.start + length({t}))")
    heads = lambda runs: f"filter(transform({spans(text, IBAN_HEAD)}, (s, i) -> {hull(f'{runs}[i]')}), h -> h.end > h.start)"
    runs = f"regexp_extract_all({text}, {lit(IBAN_HEAD)}, 1)"
    return let(runs, lambda r: f"if(size({r}) = 0, cast(array() as {FOUND}), {framed(text, apart(heads(r)))})")


def entities(text: str, rules: list[Rule], low: str | None = None) -> Column:
    """array<entity> of all rules over a text column, sorted by place."""
    none = f"cast(array() as {ENTITIES})"
    by_gate: dict[str, list[str]] = {}
    for r in rules:
        by_gate.setdefault(r.gate, []).append(rule_sql(r, text, low))
    merged = [x for g, own in by_gate.items() for x in (own if not g else [f"if({text} rlike {lit(g)}, concat({', '.join(own)}, {none}), {none})"])]
    return F.expr(f"array_sort(concat({', '.join([*merged, none])}))")


def detect(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", column: str = "entities", threshold: float = 0.0) -> DataFrame:
    """``docs`` with all entities of ``text``. A null text has none. Projections only; no shuffle at scale.

    Input whose scan would keep few cores busy is dealt out first (``session.spread``).
    """
    rules = DEFAULT_RULES if rules is None else rules
    out = spread(docs).withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__low", F.lower("__text"))
    out = out.withColumn(column, entities("__text", rules, "__low")).drop("__text", "__low")
    return out if threshold <= 0 else out.withColumn(column, F.filter(column, lambda e: e["score"] >= threshold))


def literal_matches(text: str, patterns: tuple[str, ...]) -> Column:
    """array<(start, end, pattern)> of the leftmost longest occurrences of literals, in any ASCII case; ``pattern`` is a literal's number."""
    low = f"array({', '.join(lit(p.lower()) for p in patterns)})"
    found = spans(text, "(?i)" + _alternation(tuple(patterns)))
    return F.expr(f"transform({found}, s -> named_struct('start', s.start, 'end', s.end, 'pattern', cast(array_position({low}, lower(s.m)) - 1 as int)))")


METADATA = "array<struct<key:string,value:string>>"


def with_metadata(entities: str) -> Column:
    """Entities with ``metadata``, pairs of what their recognizer knows beyond the span, in order of the key.

    ``recognizer`` becomes the recognizer's name, and the rule's name goes into the pairs.
    """
    rules = {r.name: r for r in [*EU_RULES, *DEFAULT_RULES]}
    owner = " ".join(f"when {lit(n)} then {lit(r.owner)}" for n, r in rules.items() if r.owner != n)
    compact = "upper(regexp_replace(e.text, '[^A-Za-z0-9]', ''))"
    digits_ = "regexp_replace(e.text, '[^0-9]', '')"
    network = f"case when {digits_} like '4%' then 'visa' when {digits_} rlike '^3[47]' then 'amex' when {digits_} rlike '^(5[1-5]|2[2-7])' then 'mastercard' else 'other' end"
    phone = numbering.number("e.text")
    pair = lambda k, x: f"named_struct('key', '{k}', 'value', {x})"
    review = pair("human_review_recommended", "'true'")
    cases = [
        (f"e.recognizer in ({', '.join(lit(r.name) for r in ARTICLE_9_RULES)})", [pair("gdpr_article", "'9'"), review]),
        ("e.entity_type = 'IBAN'", [pair("checksum_ok", f"cast({v.iban_mod97(compact)} as string)"), pair("iban_normalized", compact)]),
        ("e.recognizer = 'eu_vat_intracom'", [pair("vat_rule", "concat('vat_', lower(left(e.text, 2)))")]),
        ("e.recognizer = 'eu_phone_phonenumber'", [pair("phone_region", f"coalesce({phone}.region, '')"), pair("phone_type", f"coalesce({phone}.line_type, '')")]),
        ("e.recognizer = 'eu_quasi_identifiers'", [review, pair("reidentification_risk", "'elevated'")]),
        ("e.recognizer in ('credit_card_luhn', 'eu_credit_card_bins')", [pair("network", network)]),
    ]
    own = "case " + " ".join(f"when {c} then array({', '.join(p)})" for c, p in cases) + f" else cast(array() as {METADATA}) end"
    named = f"case e.recognizer {owner} else e.recognizer end"
    rule = f"if({named} = e.recognizer, cast(array() as {METADATA}), array({pair('rule', 'e.recognizer')}))"
    pairs = f"array_sort(concat({own}, array({pair('level', lit('regex'))}), {rule}))"
    return F.expr(f"transform({entities}, e -> named_struct('start', e.start, 'end', e.end, 'entity_type', e.entity_type, 'text', e.text, 'score', e.score, 'recognizer', {named}, 'metadata', {pairs}))")


def each(found: DataFrame, items: Column | str, name: str, *keys: Column | str) -> DataFrame:
    """One row per item of an array, as column ``name`` behind ``keys``.

    Below a plain explode Spark tests the array's size first, and so makes the array twice or more; the outer form is not
    tested, and its rows without an item go afterwards.
    """
    return found.select(*keys, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def exploded(found: DataFrame, *keys: str) -> DataFrame:
    """One row per entity."""
    return each(found, "entities", "e", *keys).select(*keys, "e.*")


def scan_columns(df: DataFrame, columns: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """``df`` with ``<column>_entities`` for each text column."""
    for c in columns:
        df = detect(df, rules, c, f"{c}_entities")
    return df


def with_deny(rules: list[Rule], deny: tuple[str, ...]) -> list[Rule]:
    """The rules with their deny lists replaced."""
    return [replace(r, deny=deny) if r.deny else r for r in rules]
