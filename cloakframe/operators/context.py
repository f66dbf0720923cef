"""Level 2: scores moved by words near an entity, and by combinations of entities that identify together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sqltext import let, lit


@dataclass(frozen=True)
class ContextRule:
    entity: str
    boost: tuple[str, ...]
    penalty: tuple[str, ...] = ()
    up: float = 0.10
    down: float = 0.10


# Fixed default rules.
RULES = (
    ContextRule("PERSON", ("m.", "mme", "dr", "patient", "patients", "client", "clients", "employé", "employés", "herr", "frau", "sig.", "sr.", "dhr."), ("ville de", "pays", "société", "marque", "produit", "stadt", "città", "ciudad de"), 0.12, 0.15),
    ContextRule("MEDICAL_RECORD", ("diagnostic", "traitement", "patient", "patients", "diagnose", "behandlung")),
    ContextRule("IBAN", ("montant", "virement", "paiement", "überweisung", "pagamento", "iban"), (), 0.10, 0.08),
    ContextRule(
        "BANK_ACCOUNT",
        (
            "identifiant interne", "identifiants internes", "ancien login", "ancien mot de passe", "mot de passe", "mots de passe", "nom d'utilisateur", "nom d’utilisateur", "code d'accès", "code d’accès", "code accès", "compte utilisateur",
            "référence interne", "référence client", "identifiant client", "id client", "id utilisateur", "compte client", "internal id", "internal identifier", "user id", "user account", "account id", "client id", "member id", "login name", "sign in", "sign-in",
            "benutzername", "benutzerkonto", "zugangsdaten", "kennung", "interne kennung", "nombre de usuario", "cuenta de usuario", "identificador interno", "inicio de sesión", "nome utente", "account utente", "identificativo interno", "gebruikersnaam", "gebruikersaccount", "interne id",
            "login", "logins", "identifiant", "identifiants", "password", "passwd", "credential", "credentials", "username", "mdp", "passphrase", "secret", "passwort", "nutzername", "zugang", "usuario", "contraseña", "credenciales", "utente", "account", "gebruiker",
        ),
        (), 0.11, 0.08,
    ),
)

# Fixed endings by language, in the order in which they are tried.
ROMANCE = "aciones ación mente adoras adores adora ador issimo issima issimi issime zioni zione amenti amento ei ai ano ate ava ivi ere ire oso osa os as es s".split()
ENDINGS = {
    "fr": "ements ement euses euse eaux eau ions iez ées ée èrent asses asse isses isse îmes îtes âtes âmes ants antes ant ent ons ez és é s x".split(),
    "de": "ungen lichkeiten lichkeit heiten heit innen in chen ern er en em es e s".split(),
    "es": ROMANCE,
    "it": ROMANCE,
    "pt": ROMANCE,
    "nl": "heden heid tjes tje ingen ing eren er en e s".split(),
    "en": "fulness ness ments ment ingly edly ions ion ies ied ing ed es s".split(),
    "": "s x en e".split(),
}
EDGES = ".,:;!?\"'()«»„“"
CUTS = 3


def lemma_of(word: str, language: str = "en") -> str:
    """A token without outer punctuation, in lower case, without up to three endings of its language; two bytes stay."""
    out = word.strip().strip(EDGES).lower()
    for _ in range(CUTS):
        cut = next((e for e in ENDINGS.get(language, ENDINGS[""]) if out.endswith(e) and len(out.encode()) - len(e.encode()) >= 2), "")
        out = out[: len(out) - len(cut)]
    return out


def lemma(token: str, language: str = "en") -> str:
    """``lemma_of`` as SQL text."""
    edges = "".join(f"\\{c}" if c in "()?." else c for c in EDGES)
    bare = f"lower(regexp_replace(trim({token}), {lit(f'^[{edges}]+|[{edges}]+$')}, ''))"

    def cut(w: str) -> str:
        cases = " ".join(f"when {w} like {lit('%' + e)} and octet_length({w}) >= {len(e.encode()) + 2} then left({w}, length({w}) - {len(e)})" for e in ENDINGS.get(language, ENDINGS[""]))
        return f"case {cases} else {w} end"

    out = lambda w, k: let(cut(w), lambda x: out(x, k - 1)) if k > 1 else cut(w)
    return let(bare, lambda w: out(w, CUTS))


def lemma_by(token: str, language: str) -> str:
    """``lemma`` in the language that another SQL expression names."""
    return f"case {language} " + " ".join(f"when {lit(k)} then {lemma(token, k)}" for k in ENDINGS if k) + f" else {lemma(token, '')} end"


def lemma_matches(token: str, expected: str, language: str = "en") -> str:
    """SQL text: whether two tokens have the same form, which is not empty."""
    return let(lemma(token, language), lambda a: f"({a} <> '' and {a} = {lemma(expected, language)})")


def window(text: str, start: str, end: str, tokens: int = 5) -> str:
    """SQL text of the words of an entity and ``tokens`` on each side of it, in lower case, with one space between them."""
    # A word that the entity begins or ends inside belongs to it.
    left, right = f"split(left({text}, {start}), '\\\\s+')", f"split(substring({text}, {end} + 1), '\\\\s+')"
    own = f"substring({text}, {start} + 1, {end} - {start})"

    def joined(ls: str, rs: str) -> str:
        before = f"slice({ls}, greatest(size({ls}) - {tokens}, 1), least({tokens}, size({ls}) - 1))"
        after = f"slice({rs}, 2, {tokens})"
        return f"trim(regexp_replace(lower(concat(array_join({before}, ' '), ' ', {ls}[size({ls}) - 1], {own}, {rs}[0], ' ', array_join({after}, ' '))), '\\\\s+', ' '))"

    return let(left, lambda ls: let(right, lambda rs: joined(ls, rs)))


ENTITY_FIELDS = ("start", "end", "entity_type", "text", "score", "recognizer")


def rescored(score: str) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {score if f == 'score' else f'e.{f}'}" for f in ENTITY_FIELDS) + ")"


def adjusted(entities: str, text: str, rules: tuple[ContextRule, ...] = RULES, tokens: int = 5, certain: float = 0.95, language: str = "en") -> Column:
    """Entities with scores moved: up or down for each phrase, or word by its lemma, of the type's rule, kept within 0 and 1. Certain ones stay."""

    def moved(rule: ContextRule) -> str:
        def hits(words: tuple[str, ...], w: str, ls: str) -> str:
            phrases = [f"cast(contains({w}, {lit(x)}) as int)" for x in words if " " in x]
            single = [lemma_of(x, language) for x in words if " " not in x]
            own = [f"size(filter(array({', '.join(map(lit, single))}), x -> x <> '' and array_contains({ls}, x)))"] if single else []
            return " + ".join(phrases + own) or "0"

        def score(w: str) -> str:
            return let(f"transform(split({w}, ' '), t -> {lemma('t', language)})", lambda ls: f"least(greatest(e.score + {rule.up}D * ({hits(rule.boost, w, ls)}) - {rule.down}D * ({hits(rule.penalty, w, ls)}), 0D), 1D)")

        return let(window(text, "e.start", "e.end", tokens), score)

    cases = " ".join(f"when e.entity_type = {lit(r.entity)} then {moved(r)}" for r in rules)
    score = f"if(e.score >= {certain}D, e.score, case {cases} else e.score end)"
    return F.expr(f"transform({entities}, e -> {rescored(score)})")


def legacy_person(entities: str, text: str, boost: tuple[str, ...], penalty: tuple[str, ...], up: float = 0.08, down: float = 0.12, width: int = 40) -> Column:
    """Persons scored by words within ``width`` characters (8 at least), as parts of words, where no rule is given for them."""
    width = max(width, 8)
    near = f"lower(substring({text}, greatest(e.start - {width}, 0) + 1, e.end + {width} - greatest(e.start - {width}, 0)))"
    count = lambda words, w: " + ".join(f"cast(contains({w}, {lit(x.lower())}) as int)" for x in words) or "0"
    score = let(near, lambda w: f"least(greatest(e.score + {up}D * ({count(boost, w)}) - {down}D * ({count(penalty, w)}), 0D), 1D)")
    return F.expr(f"transform({entities}, e -> {rescored(f'if(e.entity_type = {lit('PERSON')}, {score}, e.score)')})")


@dataclass(frozen=True)
class Combination:
    """Types that identify together if one of each stands within so many characters and, if given, the document holds a keyword."""

    types: tuple[str, ...]
    within: int
    boost: float
    note: str = "quasi_identifier_combo"
    keywords: tuple[str, ...] = ()
    risk: float | None = None


# Fixed default combinations.
COMBINATIONS = (
    Combination(("DATE", "LOCATION"), 120, 0.15, "quasi_id_date_location"),
    Combination(("DATE", "ADDRESS"), 3000, 0.2, "postal_dob_gender", ("genre", "sexe", "masculin", "féminin", "homme", "femme", "male", "female", "M.", "Mme"), 0.35),
)


def first_combination(entities: str, rule: Combination, text: str = "''") -> str:
    """SQL text: the first members, by order of the first type, then of the second and so on, that stand close enough; null if none do.

    Each member's list is walked for the first that fits, so nothing but the entities is held.
    """
    kinds = {k: f"filter({entities}, e -> e.entity_type = {lit(k)})" for k in rule.types}
    field = "struct<start:int,end:int,entity_type:string>"
    none = f"cast(null as array<{field}>)"

    def found(rest: tuple[str, ...], lo: str, hi: str, depth: int) -> str:
        e = f"m{depth}"
        a, b = (f"least({lo}, {e}.start)", f"greatest({hi}, {e}.end)") if lo else (f"{e}.start", f"{e}.end")
        own = f"array(named_struct('start', {e}.start, 'end', {e}.end, 'entity_type', {e}.entity_type))"
        if len(rest) == 1:
            inner = f"if({b} - {a} <= {rule.within}, {own}, {none})"
        else:
            inner = f"concat({own}, {found(rest[1:], a, b, depth + 1)})"
        return f"try_element_at(filter(transform({kinds[rest[0]]}, {e} -> {inner}), x -> x is not null), 1)"

    out = found(rule.types, "", "", 0)
    words = " or ".join(f"contains(lower({text}), {lit(k.lower())})" for k in rule.keywords)
    return f"if({words}, {out}, {none})" if words else out


def combined(entities: str, rule: Combination, text: str = "''", certain: float = 0.95) -> Column:
    """Entities with the members of the first fitting combination boosted; certain ones stay."""
    member = lambda c: f"exists({c}, x -> x.start = e.start and x.end = e.end and x.entity_type = e.entity_type)"
    return F.expr(let(first_combination(entities, rule, text), lambda c: f"if({c} is null, {entities}, transform({entities}, e -> {rescored(f'if({member(c)} and e.score < {certain}D, least(e.score + {rule.boost}D, 1D), e.score)')}))"))


def quasi_report(entities: str, text: str = "''", rules: tuple[Combination, ...] = COMBINATIONS, base: float = 0.0, cap: float = 1.0) -> Column:
    """A document's risk of being told whose it is: struct (risk_score, alerts).

    Each combination that is met adds its own risk, or half its boost up to 0.25, and its note.
    """
    worth = lambda r: max(r.risk, 0.0) if r.risk is not None else min(0.5 * r.boost, 0.25)
    met = ", ".join(f"if({first_combination(entities, r, text)} is not null, named_struct('risk', {worth(r)}D, 'note', {lit(r.note)}), null)" for r in rules)
    return F.expr(let(f"filter(array({met}), x -> x is not null)", lambda m: f"named_struct('risk_score', greatest(least({base}D + aggregate({m}, 0D, (a, x) -> a + x.risk), {cap}D), 0D), 'alerts', transform({m}, x -> x.note))"))
