"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans of five kinds: email, ip, card, phone, secret. Spans of the base patterns always stay, and there are
none of the last kind; wider patterns propose spelled-out addresses, phone numbers without a country code, long IPv6 forms,
card-like numbers next to a keyword, and keys or tokens that a text assigns. Six labelers vote on every proposal (+1, 0, -1):
pattern, validator, context words, gazetteer, shape, edges; the pattern labeler knows base matches alone and abstains on
others. Expectation maximisation over the counts of vote patterns estimates each labeler's reliability and each kind's share
without labels; the posteriors train a final classifier, a naive Bayes model of span features, that decides which added
spans are kept.

Counts of vote and feature patterns cover all documents and are bounded by the number of patterns, as is the model. The
patterns read each text once: proposals are written, then counted and judged. A text is read by a pattern only if it holds
what every match of the pattern holds. Positions come from the text between matches, so long texts cost linear time and no
task holds more than a document. Defined cases: a null text is an empty one, which has no spans; repeated rows give equal
results; added spans never overlap base ones; among added spans that overlap, all stay; an empty table gives a model without
evidence and an empty result; columns beside text pass through whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validators import HOST_TLDS
from .common import written

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
#: Base patterns. Possessive runs and guards against starts inside a run keep them linear; the matches are the same.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    EMAIL: rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[ -]?[0-9])++",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
ADDED = {
    EMAIL: r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({<] ?at ?[\])}>] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[({<] ?dot ?[\])}>]|\.) ?[A-Za-z0-9-]{2,63}+){1,4}+",
    IP: r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}+:){7}[0-9a-f]{1,4}+(?![0-9a-f:])",
    CARD: r"(?i)(?:card|visa|mastercard|amex|carte|karte|tarjeta)[a-z]{0,12}+[ :#.]{1,4}+[0-9](?:[ -]?[0-9]){11,18}+(?![0-9])",
    PHONE: r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    SECRET: r"(?<=[=:]|[=:] |[=:]['\"]|[=: ] ['\"])(?<![A-Za-z0-9])[A-Za-z0-9_+/-]{16,128}+(?![A-Za-z0-9])",
}
#: What a text holds wherever a pattern has a match.
HOLDS = {
    (EMAIL, True): "@", (IP, True): "[0-9]\\.[0-9]", (CARD, True): "[0-9][ -]?[0-9]", (PHONE, True): "\\+[0-9]",
    (EMAIL, False): r"(?i)[\[({<] ?at ?[\])}>]", (IP, False): "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", (CARD, False): r"(?i)(?:card|visa|amex|carte|karte|tarjeta)[a-z]{0,12}[ :#.]{1,4}[0-9]",
    (PHONE, False): "[0-9]{3}[ .-][0-9]{4}", (SECRET, False): r"(?i)(?:token|secret|passw|pwd|key|bearer|credential|auth)[a-z_]{0,12}['\"]? ?[=:]",
}
# Fixed word lists of the labelers.
CONTEXT = {
    EMAIL: "mail|contact|write|reach|courriel|correo|schreib",
    IP: r"\bip\b|address|server|host|login|from|adresse",
    CARD: "card|visa|credit|payment|paid|carte|karte|tarjeta|kredit",
    PHONE: r"phone|call|\btel|mobile|fax|contact|appel|anruf|llam|telef|handy|móvil|portable|rufnummer",
    SECRET: r"token|secret|passw|pwd|key|bearer|credential|auth|cl[eé]|schl[uü]ssel|clave|geheim|passe",
}
AGAINST = r"version|\bv\.?$|invoice|order|isbn|sha|serial|build|commit|item"
TLDS = "|".join(HOST_TLDS)
# Fixed calling codes, as ranges of the numbering plan.
CALLING = "1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9]"
# Fixed beginnings of cards by network, and of keys by issuer; lengths of digests in hexadecimal.
NETWORKS = "4|5[0-8]|2[2-7]|3[0-689]|6"
ISSUERS = "sk[_-]|pk[_-]|rk_|gh[pousr]_|github_pat_|xox[abprs]-|AKIA|ASIA|AIza|ya29|eyJ|glpat-|npm_|hf_"
DIGESTS = "[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"

LABELERS, FEATURES = 6, 5
ROUNDS = 15


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: int, m: Column) -> Column:
    """Whether a base match counts."""
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.right(p, F.lit(4)).cast("int") <= 255)
    n = F.length(digits(m))
    return n.between(12, 19) & F.call_function("luhn_check", digits(m)) if kind == CARD else n.between(9, 15)


def positions(text: Column, pattern: str, matches: Column) -> Column:
    """Struct (start, end, m, before, after) of each match; positions are sums of the lengths in front, taken by blocks of 64."""
    def of(gaps: Column) -> Column:
        step = F.transform(matches, lambda m, i: F.length(m) + F.length(F.element_at(gaps, i + 1)))
        return let(step, lambda s: let(_begins(s), lambda begins: _spans(begins, gaps, matches)))

    return let(F.split(text, pattern, -1), of)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _begins(step: Column) -> Column:
    """Running sums of ``step``, each without its own term."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    blocks = F.sequence(F.lit(0), F.floor((F.size(step) - 1) / 64).cast("int"))

    def block(sums: Column, b: Column) -> Column:
        return let(F.slice(step, b * 64 + 1, 64), lambda own: let(total(F.slice(sums, F.lit(1), b)), lambda base: F.transform(own, lambda _, j: base + total(F.slice(own, F.lit(1), j)))))

    return let(F.transform(blocks, lambda b: total(F.slice(step, b * 64 + 1, 64))), lambda sums: F.flatten(F.transform(blocks, lambda b: block(sums, b))))


def _spans(begins: Column, gaps: Column, matches: Column) -> Column:
    def span(m: Column, i: Column) -> Column:
        start = F.element_at(begins, i + 1) + F.length(F.element_at(gaps, i + 1))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), F.right(F.element_at(gaps, i + 1), F.lit(40)).alias("before"), F.left(F.element_at(gaps, i + 2), F.lit(40)).alias("after"))

    return F.transform(matches, span)


def votes(kind: int, base: bool, s: Column) -> Column:
    """The six labelers' votes on a proposal, as one string of the characters +, 0 and -."""
    m, before, after = s["m"], s["before"], s["after"]
    plus, minus, none = F.lit("+"), F.lit("-"), F.lit("0")
    num = digits(m)
    if kind == EMAIL:
        check = F.when(m.rlike(r"[A-Za-z]{2,24}$"), plus).otherwise(minus)
        gazetteer = F.when(m.rlike(rf"(?i)(?:\.|dot[\])}}>]) ?(?:{TLDS})$"), plus).when(m.rlike(r"(?i)localhost$|\.(?:invalid|local|png|jpg)$"), minus).otherwise(none)
        shape = F.when(F.length(m) > 80, minus).otherwise(none)
    elif kind == IP:
        check = F.when(valid(IP, m), plus).otherwise(minus) if base else plus
        gazetteer = F.when(m.rlike(r"^(?:0|255)\."), minus).when(m.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."), plus).otherwise(none)
        shape = F.when(m.rlike(r"(?:^|\.)0[0-9]"), minus).otherwise(none)
    elif kind == CARD:
        check = F.when(F.length(num).between(12, 19) & F.call_function("luhn_check", num), plus).otherwise(minus)
        gazetteer = F.when(num.rlike(f"^(?:{NETWORKS})"), plus).otherwise(minus)
        shape = F.when(num.rlike(r"^([0-9])\1+$|0{6}|123456789"), minus).otherwise(none)
    elif kind == SECRET:
        # Words in letters alone, or of one letter case without digits, are no keys.
        check = F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.length(m) >= 20), plus).when(m.rlike("[0-9]"), none).otherwise(minus)
        gazetteer = F.when(m.rlike(rf"(?i)^(?:{DIGESTS})$") | m.rlike(f"^(?:{ISSUERS})"), plus).otherwise(none)
        shape = F.when(m.rlike(r"(.)\1{5}|/.*/|^[A-Za-z_-]+$|1234567"), minus).otherwise(none)
    else:
        check = F.when(F.length(num).between(9 if base else 10, 15), plus).otherwise(minus)
        gazetteer = F.when(num.rlike(rf"^(?:{CALLING})"), plus).otherwise(none) if base else F.when(num.rlike("^[2-9]"), plus).otherwise(minus)
        shape = F.when(num.rlike(r"([0-9])\1{6}|12345678"), minus).otherwise(none)
    near = F.concat(before, F.lit(" "), after, m) if kind == CARD and not base else F.concat(before, F.lit(" "), after)
    context = F.when(before.rlike(f"(?i){AGAINST}"), minus).when(near.rlike(f"(?i){CONTEXT[kind]}"), plus).otherwise(none)
    edges = F.when(before.rlike("[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]"), minus).otherwise(plus)
    return F.concat(plus if base else none, check, context, gazetteer, shape, edges)


def features(kind: int, base: bool, s: Column) -> Column:
    """Categories of a proposal, as one string of five characters; none of them repeats a pattern's own vote."""
    m, before, after = s["m"], s["before"], s["after"]
    n = F.length(digits(m))
    size = F.when(n < 1, "0").when(n < 7, "a").when(n < 10, "b").when(n < 13, "c").when(n < 16, "d").otherwise("e")
    signs = F.when(m.rlike(r"[()\[\]{}]"), "p").when(m.rlike(" "), "s").when(m.rlike("-"), "h").when(m.rlike(r"\."), "d").otherwise("n")
    edge = lambda c, p: F.when(c.rlike(p.format("[A-Za-z]")), "l").when(c.rlike(p.format("[0-9]")), "9").when(c.rlike(p.format(r"[\s,;:!?.\"'(\[)\]]")) | (c == ""), "s").otherwise("x")
    context = F.when(before.rlike(f"(?i){AGAINST}"), "-").when(F.concat(before, F.lit(" "), after, m).rlike(f"(?i){CONTEXT[kind]}"), "+").otherwise("0")
    return F.concat(size, signs, edge(before, "{}$"), edge(after, "^{}"), context)


def proposals(text: Column, kind: int, base: bool, found: Column) -> Column:
    """Proposals of one pattern: struct (start, kind, end, base, votes, features)."""
    placed = positions(text, BASE[kind] if base else ADDED[kind], found)
    if base:
        placed = F.filter(placed, lambda s: valid(kind, s["m"]))
    own = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(base).alias("base"), votes(kind, base, s).alias("votes"), features(kind, base, s).alias("features")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,votes:string,features:string>>")
    return F.when(F.size(found) > 0, own).otherwise(empty)


def with_proposals(docs: DataFrame, column: str = "proposals") -> DataFrame:
    """``docs`` wrapped in ``row``, with ``text`` and all proposals in order of start, kind and end."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    digit, mark = F.col("digit"), F.col("mark")
    whole = whole.withColumn("digit", F.col("text").rlike("[0-9]")).withColumn("mark", F.col("text").rlike("[=:\\[({<]"))
    # Nearly all texts of a corpus end here: a digit, an at sign, or a sign before a key or a spelled-out address.
    first = {(EMAIL, True): F.contains("text", F.lit("@")), (EMAIL, False): mark, (SECRET, False): mark & digit}
    found = {}
    for base, patterns in ((True, BASE), (False, ADDED)):
        for kind, pattern in patterns.items():
            tried = first.get((kind, base), digit)
            if (kind, base) != (EMAIL, True):
                tried = tried & F.col("text").rlike(HOLDS[kind, base])
            found[kind, base] = F.when(tried, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
    name = lambda kind, base: f"m{kind}{'b' if base else 'a'}"
    matched = whole.select("row", "text", *[c.alias(name(*k)) for k, c in found.items()])
    sets = lambda base: F.concat(*[proposals(F.col("text"), k, base, F.col(name(k, base))) for k, b in found if b == base])
    parted = matched.select("row", "text", sets(True).alias("own"), sets(False).alias("more"))
    apart = F.filter("more", lambda s: ~F.exists("own", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return parted.select("row", "text", F.array_sort(F.when(F.size("more") > 0, F.concat("own", apart)).otherwise(F.col("own"))).alias(column))


@dataclass
class Model:
    """Reliabilities by labeler, shares by kind, and the classifier's weights by kind, feature and category."""

    reliabilities: list[float]
    shares: list[float]
    weights: dict[str, float] = field(default_factory=dict)


def fit(docs: DataFrame) -> Model:
    """Counts, expectation maximisation and classifier from all documents."""
    return fit_proposals(with_proposals(docs.select("text")))


def fit_proposals(found: DataFrame) -> Model:
    """The same from a table with the documents' ``proposals``."""
    spans = found.select(F.explode("proposals").alias("s"))
    counts = spans.groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n")).cache()
    patterns = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    state = patterns.agg(F.array_sort(F.collect_list(F.struct("kind", "votes", "n"))).alias("rows"))
    state = state.select(_folded(F.col("rows")).alias("state")).first()["state"]
    model = Model(list(state[len(KINDS) :]), list(state[: len(KINDS)]))
    p = _posterior(model)
    soft = counts.select("kind", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.substring("features", k + 1, 1).alias("v")) for k in range(FEATURES)])).alias("x"), (F.col("n") * p).alias("yes"), (F.col("n") * (1 - p)).alias("no"))
    sums = soft.groupBy("kind", "x.f", "x.v").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    counts.unpersist()
    for kind in range(len(KINDS)):
        own = [r for r in sums if r["kind"] == kind]
        yes, no = (sum(r[c] for r in own if r["f"] == 0) for c in ("yes", "no"))
        model.weights[f"{kind}"] = math.log((yes + 1) / (no + 1))
        for r in own:
            model.weights[f"{kind}{r['f']}{r['v']}"] = math.log((r["yes"] + 1) / (yes + 6)) - math.log((r["no"] + 1) / (no + 6))
    return model


def _folded(rows: Column) -> Column:
    start = F.array(*[F.lit(0.5)] * len(KINDS), *[F.lit(0.8)] * LABELERS)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: _em_step(s, rows))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _em_step(state: Column, data: Column) -> Column:
    """One round: posteriors of all vote patterns, then shares and reliabilities, within bounds and with prior counts."""

    def posterior(r: Column) -> Column:
        z = _logit(F.element_at(state, r["kind"] + 1))
        for k in range(LABELERS):
            own = F.substring(r["votes"], k + 1, 1)
            z = z + F.when(own == "+", 1.0).when(own == "-", -1.0).otherwise(0.0) * _logit(F.element_at(state, len(KINDS) + 1 + k))
        return 1 / (1 + F.exp(-z))

    def sums(r: Column, acc: Column) -> Column:
        p, n = posterior(r), r["n"].cast("double")
        parts = []
        for k in range(len(KINDS)):
            here = (r["kind"] == k).cast("double")
            parts += [here * n * p, here * n]
        for k in range(LABELERS):
            own = F.substring(r["votes"], k + 1, 1)
            parts += [n * F.when(own == "+", p).when(own == "-", 1 - p).otherwise(0.0), F.when(own != "0", n).otherwise(0.0)]
        return F.zip_with(acc, F.array(*parts), lambda a, b: a + b)

    zero = F.array(*[F.lit(0.0)] * (2 * (len(KINDS) + LABELERS)))

    def news(acc: Column) -> Column:
        hit = lambda k: F.element_at(acc, 2 * k + 1)
        cast = lambda k: F.element_at(acc, 2 * k + 2)
        shares = [F.least(F.greatest((hit(k) + 1) / (cast(k) + 2), F.lit(0.01)), F.lit(0.99)) for k in range(len(KINDS))]
        right = [F.least(F.greatest((hit(len(KINDS) + k) + 8) / (cast(len(KINDS) + k) + 10), F.lit(0.55)), F.lit(0.99)) for k in range(LABELERS)]
        return F.array(*shares, *right)

    return F.aggregate(data, zero, lambda acc, r: sums(r, acc), news)


def _posterior(model: Model) -> Column:
    z = F.element_at(F.array(*[F.lit(math.log(s / (1 - s))) for s in model.shares]), F.col("kind") + 1)
    for k, r in enumerate(model.reliabilities):
        own = F.substring("votes", k + 1, 1)
        z = z + F.when(own == "+", 1.0).when(own == "-", -1.0).otherwise(0.0) * math.log(r / (1 - r))
    return 1 / (1 + F.exp(-z))


def judged(found: DataFrame, model: Model) -> Column:
    """``spans`` of a table with ``proposals``: the base spans and the added ones that the classifier keeps."""
    weights = model.weights or {"": 0.0}
    table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])

    def kept(s: Column) -> Column:
        kind = s["kind"].cast("string")
        parts = [F.coalesce(F.element_at(table, kind), F.lit(0.0))]
        parts += [F.coalesce(F.element_at(table, F.concat(kind, F.lit(str(k)), F.substring(s["features"], k + 1, 1))), F.lit(0.0)) for k in range(FEATURES)]
        return s["base"] | (reduce(lambda a, b: a + b, parts) >= 0)

    return F.filter("proposals", kept).alias("spans")


def spans_of(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``row``, ``text`` and ``spans`` of all documents; without a model, that of these documents. Texts are searched once."""
    found = written(with_proposals(docs))
    return found.select("row", "text", judged(found, model or fit_proposals(found)))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def span_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts are of base spans. What is written holds no texts."""
    found = written(with_proposals(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "proposals"))
    found = found.select("doc_id", judged(found, fit_proposals(found)))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(SECRET)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def masked(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; spans that overlap become one of the first's kind."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    found = spans_of(docs, model)
    # The text is read once from left to right: what lies between spans, then the next span's mark.
    chars = F.array_join(F.transform(_gaps(F.col("spans")), lambda g: F.concat(F.substring(F.col("text"), g["start"] + 1, g["end"] - g["start"]), F.when(g["kind"] >= 0, F.element_at(names, g["kind"] + 1)).otherwise(F.lit("")))), "")
    new = F.when(F.size("spans") > 0, chars).otherwise(F.col("row.text"))
    return found.select(*[(new if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _gaps(spans: Column) -> Column:
    """Struct (start, end, kind): stretches outside spans and the kind of the span behind each, -1 at the text's end."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["at"].alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(gap))).alias("out"))

    last = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), F.lit(2147483647).alias("end"), F.lit(-1).alias("kind"))))
    return F.aggregate(spans, zero, add, last)
