"""Fake values that depend on a seed and a key alone, with right check digits, and labelled rows made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import let, lit, weighted
from ..functions.validators import DNI_LETTERS, bsn, codice_letter, mod97, steuer_digit
from . import evaluation

FIRST = {"FR": "Camille Louis Manon Hugo Chloé Jules", "DE": "Lena Felix Mia Jonas Emma Paul", "IT": "Giulia Marco Sofia Luca Chiara Matteo", "ES": "Lucía Pablo Carmen Diego Elena Javier", "NL": "Sanne Daan Emma Bram Lotte Sem"}
LAST = {"FR": "Moreau Petit Roux Fournier", "DE": "Schmidt Weber Wagner Koch", "IT": "Rossi Bianchi Ferrari Greco", "ES": "García Ruiz Molina Ortega", "NL": "Jansen Visser Bakker Smit"}


def number(key: str, seed: int, tag: str, below: int) -> str:
    """SQL text of a number from 0 up to ``below``, the same for the same key, seed and tag."""
    return f"pmod(xxhash64({lit(f'{seed}:{tag}')}, cast({key} as string)), {below})"


def pick(key: str, seed: int, tag: str, items: list[str], weights: list[int] | None = None) -> str:
    """SQL text of one of the items, by weight."""
    weights = weights or [1] * len(items)
    marks, total = [], 0
    for w in weights:
        total += w
        marks.append(total)
    n = number(key, seed, tag, total)
    return "case " + " ".join(f"when {n} < {m} then {lit(i)}" for i, m in zip(items, marks, strict=True)) + " end"


# Fixed letters and what they become in an address.
ACCENTS, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def slug(text: str) -> str:
    """SQL text of a name as part of an address: lower case, without accents, other signs as single dots."""
    folded = f"replace(replace(replace(translate(lower({text}), '{ACCENTS}', '{PLAIN}'), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"
    return f"trim(both '.' from regexp_replace({folded}, '[^a-z0-9]+', '.'))"


def with_luhn(body: str) -> str:
    """SQL text: digits with their Luhn digit behind them."""
    total = lambda b: f"aggregate(sequence(1, length({b})), 0L, (a, k) -> a + element_at(transform(array(cast(substring({b}, length({b}) - k + 1, 1) as int) * if(k % 2 = 1, 2, 1)), d -> d div 10 + d % 10), 1))"
    return let(body, lambda b: f"concat({b}, cast((10 - {total(b)} % 10) % 10 as string))")


# Own profiles of five countries.
PHONE = {"FR": "+33 6 ", "DE": "+49 151 ", "IT": "+39 347 ", "ES": "+34 6", "NL": "+31 6 "}
STREETS = {"FR": ["rue des Fleurs", "avenue du Port"], "DE": ["Gartenweg", "Lindenallee"], "IT": ["via dei Pini", "viale Nord"], "ES": ["calle Mayor", "paseo del Sur"], "NL": ["Dorpsstraat", "Kanaalweg"]}
TOWNS = {"FR": ["Belleville", "Montclair"], "DE": ["Neustadt", "Altdorf"], "IT": ["Borgonuovo", "Castelvecchio"], "ES": ["Villanueva", "Torrealta"], "NL": ["Nieuwstad", "Oudorp"]}
#: Digits of an account number behind its check digits; the Italian check letter and the Dutch bank's letters are fixed.
ACCOUNT = {"FR": ("", 23), "DE": ("", 18), "IT": ("X", 22), "ES": ("", 20), "NL": ("BANK", 10)}
CONSONANTS = "BCDFGLMNPRST"


def account(country: str, digits: Callable[[str, int], str]) -> str:
    """SQL text of an account number of a country, with right check digits."""
    head, width = ACCOUNT[country]
    body = f"concat({lit(head)}, substring(concat({digits('iban', 12)}, {digits('iban2', 12)}), 1, {width}))"
    return let(body, lambda b: f"concat('{country}', lpad(cast(98 - {mod97(f'concat({b}, {lit(country)}, {lit('00')})')} as string), 2, '0'), {b})")


def national_id(country: str, digits: Callable[[str, int], str], n: Callable[[str, int], str]) -> str:
    """SQL text of a personal number of a country, with its check digit or letter."""
    if country == "FR":
        return let(f"concat('1', {digits('nir', 12)})", lambda b: f"concat({b}, lpad(cast(97 - cast({b} as bigint) % 97 as string), 2, '0'))")
    if country == "DE":
        body = f"concat(cast(1 + {n('steuer', 9)} as string), {digits('steuer2', 9)})"
        return let(body, lambda b: f"concat({b}, cast({steuer_digit(b)} as string))")
    if country == "ES":
        return let(digits("dni", 8), lambda b: f"concat({b}, substring('{DNI_LETTERS}', cast({b} as int) % 23 + 1, 1))")
    if country == "NL":
        # The first ending that passes: its second digit follows from the first. One first digit at most asks for a second
        # of 10, and one at most ends a run, so the third passes if no other does.
        body = f"concat(cast(1 + {n('bsn', 9)} as string), {digits('bsn2', 6)})"
        ended = lambda b, k: f"concat({b}, '{k}', cast(pmod(-({weighted(b, list(range(9, 2, -1)))} + {2 * k}), 11) as string))"
        return let(body, lambda b: let(ended(b, 0), lambda x: let(ended(b, 1), lambda y: f"case when {bsn(x)} then {x} when {bsn(y)} then {y} else {ended(b, 2)} end")))
    letters = ", ".join(f"substring('{CONSONANTS}', 1 + cast({n(f'cf{k}', len(CONSONANTS))} as int), 1)" for k in range(6))
    body = f"concat({letters}, lpad(cast({n('cfy', 100)} as string), 2, '0'), substring('ABCDEHLMPRST', 1 + cast({n('cfm', 12)} as int), 1), lpad(cast(1 + {n('cfd', 28)} as string), 2, '0'), 'A', lpad(cast(100 + {n('cfp', 800)} as string), 3, '0'))"
    return let(body, lambda b: f"concat({b}, {codice_letter(b)})")


def fake(kind: str, key: str, seed: int = 7, country: str = "FR") -> Column:
    """A fake value of a type; types without a form of their own give ``[SYNTH:TYPE:n]``."""
    return F.expr(fake_sql(kind, key, seed, country))


def fake_sql(kind: str, key: str, seed: int = 7, country: str = "FR") -> str:
    """SQL text of ``fake``."""
    n = lambda tag, below: number(key, seed, tag, below)
    digits = lambda tag, width: f"lpad(cast({n(tag, 10**width)} as string), {width}, '0')"
    person = f"concat({pick(key, seed, 'first', FIRST[country].split())}, ' ', {pick(key, seed, 'last', LAST[country].split())})"
    forms = {
        "PERSON": person,
        "EMAIL": f"concat({slug(person)}, '@', {pick(key, seed, 'host', ['mail.fr', 'post.de', 'correo.es'])})",
        "PHONE": f"concat({lit(PHONE[country])}, {digits('phone', 8)})",
        "ADDRESS": f"concat(cast(1 + {n('house', 120)} as string), ' ', {pick(key, seed, 'street', STREETS[country])}, ', ', {digits('zip', 5)}, ' ', {pick(key, seed, 'town', TOWNS[country])})",
        "DATE": f"cast(date_add(date'1950-01-01', cast({n('date', 18000)} as int)) as string)",
        "IBAN": account(country, digits),
        "CREDIT_CARD": with_luhn(f"concat('4', {digits('card', 14)})"),
        "ORGANIZATION": f"concat({pick(key, seed, 'org', ['Atelier', 'Groupe', 'Studio'])}, ' ', {pick(key, seed, 'name', ['Nord', 'Lumen', 'Delta'])})",
        "IP_ADDRESS": f"concat('203.0.113.', cast({n('ip', 256)} as string))",
        "URL": f"concat('https://www.site', cast({n('url', 10000)} as string), '.fr/')",
        "NATIONAL_ID": national_id(country, digits, n),
    }
    return forms.get(kind, f"concat('[SYNTH:', {lit(kind)}, ':', cast({n('other', 100000)} as string), ']')")


#: Own sentences of the corpus by language, and near misses that hold no entity.
FRAMES = {
    "en": ["Please note %s for the file.", "We wrote to %s on Monday.", "Record: %s"], "fr": ["Voici %s pour le dossier.", "Nous avons noté %s lundi."], "de": ["Bitte %s notieren.", "Im Vertrag steht %s, siehe Anlage."],
    "es": ["Anote %s en el expediente.", "El dato es %s."], "it": ["Si prega di annotare %s.", "Il dato è %s."], "nl": ["Noteer %s in het dossier.", "Het gegeven is %s."],
}
HARD = ["version 1.2.3", "4532015112830367", "bob at mail dot com", "12345678A", "build 2024.1", "FR00 0000"]
KINDS = ["EMAIL", "PHONE", "IBAN", "CREDIT_CARD", "IP_ADDRESS", "URL", "DATE", "ADDRESS", "NATIONAL_ID", "PERSON"]
HARD_PERCENT = 18


def corpus(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """``corpus_of`` the numbers below ``rows``."""
    return corpus_of(spark.range(rows), seed)


def corpus_of(keys: DataFrame, seed: int = 42) -> DataFrame:
    """(id, lang, text, entity_type, value, start, end): for each ``id`` a sentence in one of six languages that holds one fake value.

    ``HARD_PERCENT`` of them hold a near miss instead, with entity_type O.
    """
    country = {"en": "FR", "fr": "FR", "de": "DE", "es": "ES", "it": "IT", "nl": "NL"}
    base = keys.withColumn("lang", F.expr(pick("id", seed, "lang", list(FRAMES)))).withColumn("hard", F.expr(f"{number('id', seed, 'hard', 100)} < {HARD_PERCENT}"))
    base = base.withColumn("entity_type", F.expr(f"if(hard, 'O', {pick('id', seed, 'kind', KINDS)})"))
    values = [F.when((F.col("entity_type") == k) & (F.col("lang") == x), fake(k, "id", seed, cc)) for k in KINDS for x, cc in country.items()]
    base = base.withColumn("value", F.coalesce(*values, F.expr(pick("id", seed, "miss", HARD))))
    frame = "case lang " + " ".join(f"when '{x}' then {pick('id', seed, 'frame', fs)}" for x, fs in FRAMES.items()) + " end"
    base = base.withColumn("frame", F.expr(frame)).withColumn("start", F.expr("instr(frame, '%s') - 1"))
    return base.select("id", "lang", F.replace("frame", F.lit("%s"), F.col("value")).alias("text"), "entity_type", "value", "start", (F.col("start") + F.length("value")).alias("end"))


def tagged_corpus(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """(id, lang, tokens, ner_tags): the corpus as words with IOB tags; a word that only touches a value's edge counts as its part."""
    found = corpus(spark, rows, seed)
    words = found.withColumn("words", evaluation.tokens("text"))
    spans = "if(entity_type = 'O', cast(array() as array<struct<start:int,end:int,entity_type:string>>), array(named_struct('start', start, 'end', end, 'entity_type', entity_type)))"
    hit = "w.start < s.end and s.start < w.end"
    tags = f"transform(words, w -> if(exists({spans}, s -> {hit}), concat(if(w.start <= start, 'B-', 'I-'), entity_type), 'O'))"
    return words.select("id", "lang", F.transform("words", lambda w: w["m"]).alias("tokens"), F.expr(tags).alias("ner_tags"))
